"""Readers and writers: CSV of any common encoding, polygons, item lists, JSON records, models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried in this order.
ENCODINGS = ["utf-8", "windows-1252", "iso-8859-1"]
UNDEFINED_1252 = [0x81, 0x8D, 0x8F, 0x90, 0x9D]


def read_csv_robust(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All-string CSV; each file is read with the first encoding that can decode it.

    The check runs line by line over splittable scans (the text source keeps
    raw bytes), so file size does not matter; only the list of file names of
    each kind comes to the driver, as any reader call needs it there.
    """
    lines = spark.read.text(path)
    bad_1252 = "[" + "".join(chr(b) for b in UNDEFINED_1252) + "]"
    byte_wise = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    per_file = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(byte_wise.rlike(bad_1252)).alias("odd")
    )
    kind = F.when(F.col("utf8"), ENCODINGS[0]).when(~F.col("odd"), ENCODINGS[1]).otherwise(ENCODINGS[2])
    kinds = per_file.groupBy(kind.alias("kind")).agg(F.collect_list("path").alias("paths")).collect()
    parts = []
    for row in kinds:
        # Spark reads no windows-1252 directly; both single-byte kinds are read byte for byte
        encoding = "UTF-8" if row["kind"] == ENCODINGS[0] else "ISO-8859-1"
        part = spark.read.option("header", header).option("encoding", encoding).option("multiLine", True).csv(row["paths"])
        parts.append(_from_1252(part) if row["kind"] == ENCODINGS[1] else part)
    if not parts:
        raise FileNotFoundError(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _from_1252(df: DataFrame) -> DataFrame:
    """Map the control range of a byte-wise read to the windows-1252 characters."""
    codes = [c for c in range(0x80, 0xA0) if c not in UNDEFINED_1252]
    wrong = "".join(chr(c) for c in codes)
    right = bytes(codes).decode("cp1252")
    return df.select(*[F.translate(F.col(f"`{c}`"), wrong, right).alias(c.translate(str.maketrans(wrong, right))) for c in df.columns])


def read_typed_csv(spark: SparkSession, path: str, schema: str, corrupt: str = "_corrupt", **options) -> DataFrame:
    """CSV with a declared schema; lines that do not fit keep their raw text in ``corrupt``."""
    reader = spark.read.schema(f"{schema}, {corrupt} string").option("header", True).option("mode", "PERMISSIVE")
    return reader.options(columnNameOfCorruptRecord=corrupt, **options).csv(path)


def read_boundaries(
    spark: SparkSession, path: str, county: str, area: str, counties: list[str] | None = None, crs: str | None = None
) -> DataFrame:
    """Polygons of a GeoJSON file as one row per ring: area_id, County, SubCounty, ring, points.

    The coordinate system must be given or stated in the file, and be WGS84.
    An area without a geometry is one row without ring and points; collections
    are unfolded; geometries other than polygons stop the read.
    """
    point = T.ArrayType(T.DoubleType())
    simple = [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
    geometry = T.StructType([*simple, T.StructField("geometries", T.ArrayType(T.StructType(simple)))])
    properties = T.MapType(T.StringType(), T.StringType())
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    stated_crs = T.StructType([T.StructField("properties", properties)])
    doc = T.StructType([T.StructField("features", T.ArrayType(feature)), T.StructField("crs", stated_crs)])
    raw = spark.read.schema(doc).option("multiLine", True).json(path)
    stated = crs or next((r[0] for r in raw.select(F.col("crs.properties")["name"]).limit(1).collect()), None)
    if stated is None:
        raise ValueError("the boundary file names no coordinate system; pass crs=")
    if not any(ok in stated.upper() for ok in ("4326", "CRS84", "WGS84", "WGS 84")):
        raise ValueError(f"boundaries must be in WGS84, not {stated}")
    one = raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties")[county].alias("County"), F.col("f.properties")[area].alias("SubCounty"),
        F.col("f.geometry").alias("g"),
    )
    if counties is not None:
        one = one.filter(F.col("County").isin(counties))
    rings = T.ArrayType(T.ArrayType(point))
    single = F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"))
    parts = F.when(F.col("g.type") == "GeometryCollection", F.col("g.geometries")).when(F.col("g.type").isNotNull(), F.array(single))

    def polygons(g):
        unread = F.raise_error(F.concat(F.lit("no polygon: "), g["type"])).cast(T.ArrayType(rings))
        return (
            F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], rings)))
            .when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], T.ArrayType(rings)))
            .otherwise(unread)
        )

    spread = one.select("County", "SubCounty", F.posexplode_outer(F.flatten(F.flatten(F.transform(parts, polygons)))).alias("ring", "xy"))
    points = F.transform("xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return spread.select(F.concat_ws("|", "County", "SubCounty").alias("area_id"), "County", "SubCounty", "ring", points.alias("points"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blanks and lines starting with # are skipped."""
    line = F.trim("value")
    lines = spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.startswith(F.col("url"), F.lit("#")))
    blank = F.lit("")
    return lines.select("url", blank.alias("title"), blank.alias("snippet"), blank.alias("source_name"), F.lit("manual").alias("discovered_via"))


ITEM_SCHEMA = "url string, title string, snippet string, source_name string, discovered_via string"


def read_items(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed feed items as JSON lines, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ITEM_SCHEMA).json(path)


# --- writers ------------------------------------------------------------------------------

def write_step(df: DataFrame, root: str, step: str, fmt: str = "parquet") -> str:
    """One folder per pipeline step."""
    path = f"{root.rstrip('/')}/{step}"
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_horizon(df: DataFrame, path: str, horizon: str = "horizon_months") -> None:
    """One table, one partition folder per forecast horizon."""
    df.write.mode("overwrite").partitionBy(horizon).parquet(path)


def read_horizon(spark: SparkSession, path: str, months: int, allowed: list[int], horizon: str = "horizon_months") -> DataFrame:
    if months not in allowed:
        raise ValueError(f"horizon must be one of {allowed}")
    return spark.read.parquet(path).filter(F.col(horizon) == months)


def write_split(df: DataFrame, flag: str, path: str) -> None:
    """Flagged and clear rows in one pass, one folder each."""
    df.withColumn(flag, F.coalesce(flag, F.lit(False))).write.mode("overwrite").partitionBy(flag).parquet(path)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN as null, dates and timestamps as ISO text."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept as null."""
    ready = json_ready(df)
    return ready.select(F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"}).alias("json"))


def geojson_features(layer: DataFrame, rings: str) -> DataFrame:
    """One GeoJSON Feature text per row; ``rings`` is an array of arrays of (x, y)."""
    ready = json_ready(layer.drop(rings)).columns
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.when(
        F.col(rings).isNotNull(), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    )
    typed = json_ready(layer.select(*ready)).schema
    props = {f.name: f for f in typed.fields}
    fixed = layer.select(F.col(rings), *[_json_value(layer, n).alias(n) for n in props])
    return fixed.select(
        F.to_json(
            F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry")),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )


def _json_value(df: DataFrame, name: str):
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(name)), F.col(name))
    if isinstance(kind, T.DateType):
        return F.date_format(name, "yyyy-MM-dd")
    return F.col(name)


def write_geojson(layer: DataFrame, rings: str, path: str) -> None:
    """Line-delimited GeoJSON features."""
    geojson_features(layer, rings).write.mode("overwrite").text(path)


def stack(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Union of result tables with a column naming each; missing columns become null."""
    tagged = [df.withColumn(name, F.lit(tag)) for tag, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# --- models -------------------------------------------------------------------------------

def save_model(spark: SparkSession, model: PipelineModel, path: str, **facts) -> None:
    """The fitted pipeline and a one-row table of facts (horizon, cutoff, threshold, features)."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([facts]).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/facts").first().asDict()

"""Place-name normalisation and fuzzy matching against a canonical area list."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard import fixed_values as fv
from panelyard.functions.similarity import weighted_ratio
from panelyard.session import fits

def _plain_letters() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one plain letter and marks, and that letter."""
    found = {}
    for code in range(0x80, 0x10000):
        bare = [c for c in unicodedata.normalize("NFKD", chr(code)).lower() if c.isascii()]
        if len(bare) == 1 and bare[0].isalpha():
            found[chr(code)] = bare[0]
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _plain_letters()
#: Joined letters that decompose into several.
LIGATURES = {c: unicodedata.normalize("NFKD", c).lower() for c in "ﬀﬁﬂﬃﬄﬅﬆĳŉǆǉǌǳ"}


def normalize_name(c: Column, aliases: dict[str, str] = fv.NAME_ALIASES) -> Column:
    """Lower case, plain letters, apostrophes and single blanks; null becomes ''."""
    plain = F.translate(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), ACCENTED, PLAIN)
    for joined, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(joined), F.lit(letters))
    letters = F.regexp_replace(F.regexp_replace(plain, "-", " "), r"[^a-z'\s]", "")
    tidy = F.trim(F.regexp_replace(letters, r"\s+", " "))
    out = tidy
    for raw, canonical in aliases.items():
        out = F.when(tidy == raw, F.lit(canonical)).otherwise(out)
    return out


def canonical_areas(
    census: DataFrame,
    county: str = "County",
    area: str = "SubCounty",
    counties: list[str] | None = fv.TARGET_COUNTIES,
) -> DataFrame:
    """Distinct (county, area) with their normalised names, one row per area name and county."""
    rows = census.select(F.col(county).alias("County"), F.col(area).alias("SubCounty"))
    if counties is not None:
        rows = rows.filter(F.col("County").isin(counties))
    return rows.distinct().withColumns(
        {"area_norm": normalize_name(F.col("SubCounty")), "county_norm": normalize_name(F.col("County"))}
    )


_CHOICE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("matched_county", T.StringType()),
        T.StructField("matched_subcounty", T.StringType()),
    ]
)


def _best_in_list(choices: list[tuple[str, str, str, str]]):
    """An Arrow function from (name, county or None) to the best canonical area."""
    by_county: dict[str, list[tuple[str, str, str, str]]] = {}
    for choice in choices:
        by_county.setdefault(choice[1], []).append(choice)

    @F.pandas_udf(_CHOICE)
    def best(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, hints in parts:
            rows = []
            for name, hint in zip(names, hints):
                pool = by_county.get(hint) or choices
                scored = [(weighted_ratio(name, c[0]), c) for c in pool]
                top = max(s for s, _ in scored)
                winner = min(c[2:] for s, c in scored if s == top)
                rows.append((top, *winner))
            yield pd.DataFrame(rows, columns=["score", "matched_county", "matched_subcounty"])

    return best


def match_areas(
    df: DataFrame,
    area: str,
    canonical: DataFrame,
    county: str | None = None,
    cutoff: float = fv.NAME_SCORE_CUTOFF,
    max_listed: int = 20_000,
) -> DataFrame:
    """Best canonical area per row: exact, fuzzy (score >= cutoff) or unmatched.

    Only distinct (name, county hint) pairs are scored. A hint restricts the
    choice to its county; a missing or unknown hint falls back to all areas.
    Equal scores are settled by county and area name. Up to ``max_listed``
    canonical areas (checked) ride along with the scoring function; a longer
    list is cut in chunks that meet the names through an equi-join.
    """
    hint = normalize_name(F.col(county)) if county else F.lit("")
    keyed = df.withColumns({"_name": normalize_name(F.col(area)), "_hint": hint})
    pairs = keyed.select("_name", "_hint").distinct().filter(F.col("_name") != "")
    if county:
        known = canonical.select(F.col("county_norm").alias("_hint")).distinct().withColumn("_county_known", F.lit(True))
        asked = pairs.join(known, "_hint", "left")
    else:
        asked = pairs.withColumn("_county_known", F.lit(None).cast("boolean"))

    exact_of = canonical.groupBy("area_norm", "county_norm").agg(F.min(F.struct("County", "SubCounty")).alias("_hit"))
    in_county = exact_of.select(
        F.col("area_norm").alias("_name"), F.col("county_norm").alias("_hint"), F.col("_hit").alias("_in_county")
    )
    anywhere = exact_of.groupBy(F.col("area_norm").alias("_name")).agg(F.min("_hit").alias("_anywhere"))
    looked = (
        asked.join(in_county, ["_name", "_hint"], "left")
        .join(anywhere, "_name", "left")
        .withColumn("_exact", F.when(F.col("_county_known"), F.col("_in_county")).otherwise(F.col("_anywhere")))
        .select("_name", "_hint", "_county_known", "_exact")
    )
    hits = looked.filter(F.col("_exact").isNotNull()).select(
        "_name", "_hint", F.lit(100.0).alias("_score"), F.col("_exact").alias("_area"), F.lit("exact").alias("_how")
    )
    open_names = looked.filter(F.col("_exact").isNull()).select(
        "_name", F.col("_hint"), F.when(F.col("_county_known"), F.col("_hint")).alias("_pool")
    )
    scored = _score_all(open_names, canonical, max_listed)
    enough = F.col("_best.score") >= cutoff
    near = scored.select(
        "_name",
        "_hint",
        F.col("_best.score").alias("_score"),
        F.when(
            enough,
            F.struct(
                F.col("_best.matched_county").alias("County"), F.col("_best.matched_subcounty").alias("SubCounty")
            ),
        ).alias("_area"),
        F.when(enough, F.lit("fuzzy")).otherwise(F.lit("unmatched")).alias("_how"),
    )
    found = hits.unionByName(near)
    return (
        keyed.join(found, ["_name", "_hint"], "left")
        .withColumns(
            {
                "matched_county": F.col("_area.County"),
                "matched_subcounty": F.col("_area.SubCounty"),
                "match_score": F.coalesce(F.col("_score"), F.lit(0.0)),
                "match_method": F.coalesce(F.col("_how"), F.lit("unmatched")),
            }
        )
        .drop("_name", "_hint", "_score", "_area", "_how")
    )


def _score_all(open_names: DataFrame, canonical: DataFrame, max_listed: int) -> DataFrame:
    fields = ["area_norm", "county_norm", "County", "SubCounty"]
    if fits(canonical, max_listed):
        choices = [tuple(r) for r in canonical.select(*fields).collect()]
        if not choices:
            return open_names.withColumn("_best", F.lit(None).cast(_CHOICE))
        best = _best_in_list(choices)
        return open_names.withColumn("_best", best(F.col("_name"), F.col("_pool")))

    chunks = 64
    listed = canonical.withColumn("_chunk", F.pmod(F.xxhash64("area_norm", "county_norm"), F.lit(chunks)).cast("int"))
    hinted = open_names.filter(F.col("_pool").isNotNull()).join(
        canonical.withColumnRenamed("county_norm", "_pool"), "_pool"
    )
    free = (
        open_names.filter(F.col("_pool").isNull())
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .join(listed, "_chunk")
    )
    columns = ["_name", "_hint", "_pool", "area_norm", "County", "SubCounty"]

    @F.pandas_udf(T.DoubleType())
    def score(names: pd.Series, areas: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(a, b) for a, b in zip(names, areas)], dtype=float)

    pairs = hinted.select(*columns).unionByName(free.select(*columns))
    top = pairs.withColumn("score", score("_name", "area_norm")).groupBy("_name", "_hint", "_pool").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "County", "SubCounty")).alias("_top")
    )
    return top.select(
        "_name",
        "_hint",
        "_pool",
        F.struct(
            (-F.col("_top.s")).alias("score"),
            F.col("_top.County").alias("matched_county"),
            F.col("_top.SubCounty").alias("matched_subcounty"),
        ).alias("_best"),
    )


def match_report(matched: DataFrame) -> DataFrame:
    """Rows and share per match method."""
    from panelyard.operators.explore import value_counts

    return value_counts(matched, "match_method")


def areas_without_match(canonical: DataFrame, matched: DataFrame, matched_area: str = "matched_subcounty") -> DataFrame:
    """Canonical areas that no record was matched to."""
    return canonical.join(
        matched.select(F.col(matched_area).alias("SubCounty")).distinct(), "SubCounty", "left_anti"
    )

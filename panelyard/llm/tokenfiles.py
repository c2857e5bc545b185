"""Token ids as ORC files in ascending document order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.common import id_encoder, small_batches, whole_text, written


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 32, stride: int = 1000
) -> None:
    """Writes (doc_id, ids) as ORC: files, stripes and rows ascend by document id.

    Texts are dealt out by id ranges and encoded behind that shuffle, so the
    ranges are sampled from ids alone. Ids are 32-bit integers under ORC's
    run-length encoding; a row index every ``stride`` rows (1000 at least) and Bloom filters on
    the document id let readers skip stripes. A null or empty text is its end
    id alone; a null id sorts first; rows with one id stay all, ordered by text.
    An empty table gives files without rows.
    """

    def encoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder, end = id_encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 500):
                rows = [encoder.encode(t) + end for t in texts.slice(at, 500).to_pylist()]
                ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "orc.compress": "ZSTD", "orc.stripe.size": str(stripe_mb << 20), "orc.row.index.stride": str(stride), "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    with small_batches(docs.sparkSession):
        ranged.mapInArrow(encoded, "doc_id long, ids array<int>").write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on ``doc_id`` skip stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def token_spans(spark: SparkSession, path: str) -> DataFrame:
    """Per stored row: ``doc_id``, ``start`` (ids of all rows before it), ``n_tokens`` and ``ids_crc32``.

    Stripes are read side by side. ``start`` is the sum of the files before
    plus the rows before within the file; rows of one id follow their order in
    the file. Only one row per file meets in one place.
    """

    def digested(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(1)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "file", "place", "n_tokens", "ids_crc32"],
            )

    # a file's name carries the number of the range it holds
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = read_token_files(spark, path).select("doc_id", "ids", number.alias("file"), F.monotonically_increasing_id().alias("place"))
    light = rows.mapInArrow(digested, "doc_id long, file long, place long, n_tokens long, ids_crc32 long")
    light = written(light, "spans")
    files = light.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, -1)
    held = light.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return held.join(files, "file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")

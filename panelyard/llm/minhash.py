"""Near-duplicate groups by one-permutation hashing, banded buckets and star edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import join_groups, whole_text, written
from panelyard.operators.graph import connected_components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Stragglers and members that one block compares.
BLOCK_LEFT, BLOCK_RIGHT = 256, 1024
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDS_KEPT = 120_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers (the splitmix64 one)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


_words = _WordHashes()
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
#: The bins an empty bin asks in turn, the same for all sets.
_PROBES = (mixed(np.arange(1, BINS * 64 + 1, dtype=np.uint64) * _GOLD) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; a shorter text is one shingle."""
    words = _WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = len(h) - width + 1
    width = width if n > 0 else len(h)
    out = np.full(max(n, 1), np.uint64(width), dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _GOLD + h[k : k + len(out)])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The least hash of each of ``BINS`` bins; an empty bin takes that of the first filled bin among its probes."""
    at = np.searchsorted(sets, _EDGES)
    held = sets[np.minimum(at, len(sets) - 1)]
    filled = (at < len(sets)) & (held >> np.uint64(64 - BINS.bit_length() + 1) == np.arange(BINS, dtype=np.uint64))
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        hits = filled[_PROBES[empty]]
        source[empty] = np.where(hits.any(axis=1), _PROBES[empty, hits.argmax(axis=1)], np.flatnonzero(filled)[0])
    return held[source]


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band, different between bands."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for k in range(ROWS):
        key = mixed(key + rows[:, k])
    return key.astype(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, keys) of every row; digest and keys are null without words."""

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_buffer().to_pybytes(), width)
                n.append(len(found))
                digest.append(_digest(found) if len(found) else None)
                keys.append(band_keys(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(signed, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _digest(found: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the full sets of ``nodes`` (node, least, digest), from the rows with that id and digest."""

    def built(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes(), width) for t in batch.column(1)]
            own = pa.array([_digest(f) == d for f, d in zip(found, batch.column(2).to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "shingles"])
            yield out.filter(own)

    rows = docs.select(F.col(id_col).cast("long").alias("least"), whole_text(text_col).cast("binary").alias("text"))
    # an id with several texts meets each of its nodes; the digest tells which text is whose
    found = rows.join(nodes, "least").select("node", "text", "digest").mapInArrow(built, "node long, shingles binary")
    return found.dropDuplicates(["node"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets."""

    def confirm(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [_linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _alike(n: str, m: str, percent: int):
    """Sizes that allow a link at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _stragglers(members: DataFrame, hubs: DataFrame, comps: DataFrame, sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Links from nodes that their bucket's star left apart, found by comparing them with all others of the bucket.

    A bucket is cut into blocks of a few hundred stragglers against a
    thousand members; pairs are compared inside a block and no pair leaves it,
    only one link per straggler and component. A pair that shares several
    buckets is compared in the first of them.
    """
    rows = members.join(comps, "node").join(hubs, "bucket").join(comps.select(F.col("node").alias("hub"), F.col("component").alias("home")), "hub")
    rows = rows.withColumn("apart", F.col("component") != F.col("home"))
    # with two members the star was all
    sums = rows.filter("size > 2").groupBy("bucket").agg(F.sum(F.col("apart").cast("long")).alias("away"), F.count(F.lit(1)).alias("all")).filter("away > 0")
    sums = sums.select("bucket", F.ceil(F.col("away") / BLOCK_LEFT).alias("lefts"), F.ceil(F.col("all") / BLOCK_RIGHT).alias("rights"))
    rows = rows.select("bucket", "node", "component", "apart").join(sums, "bucket")
    deal = F.xxhash64("node")
    ask = rows.filter("apart").withColumn("i", F.pmod(deal, "lefts")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)))
    told = rows.withColumn("j", F.pmod(deal, "rights")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)))
    columns = ["bucket", "i", "j", "node", "component"]
    blocks = written(ask.select(*columns, F.lit(True).alias("asks")).unionByName(told.select(*columns, F.lit(False).alias("asks"))), "blocks")
    parts = max(64, blocks.count() // 1500)
    full = blocks.join(sets, "node").join(keys, "node").withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts)))

    def compare(frame):
        import pandas as pd

        out = []
        for (bucket, _, _), block in frame.groupby(["bucket", "i", "j"], sort=False):
            asks, told = block[block["asks"]], block[~block["asks"]]
            if asks.empty or told.empty:
                continue
            bands = np.stack(told["keys"].to_list())
            band = int(np.flatnonzero(bands[0] == bucket)[0])
            size = np.array([len(s) // 8 for s in told["shingles"]])
            node, comp = told["node"].to_numpy(), told["component"].to_numpy()
            pool = np.concatenate([np.frombuffer(s, np.uint64) for s in told["shingles"]])
            starts = np.cumsum(size) - size
            for a, home, own, keys in zip(asks["node"], asks["component"], asks["shingles"], asks["keys"]):
                mine = np.frombuffer(own, np.uint64)
                n = len(mine)
                first = (bands == keys).argmax(axis=1) == band
                may = first & (comp != home) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
                if not may.any():
                    continue
                chosen = np.flatnonzero(may)
                if len(chosen) * 4 < len(size):
                    both = np.array([len(np.intersect1d(mine, pool[starts[c] : starts[c] + size[c]], assume_unique=True)) for c in chosen])
                else:
                    at = np.minimum(np.searchsorted(mine, pool), n - 1)
                    both = np.add.reduceat((mine[at] == pool).astype(np.int64), starts)[chosen]
                hit = chosen[100 * both >= percent * (size[chosen] + n - both)]
                links = dict(zip(comp[hit], node[hit]))
                out += [(a, b) for b in links.values()]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return full.groupBy("part").applyInPandas(compare, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``n_shingles``, ``component_id`` and ``kept``.

    A row's set holds the distinct shingles of ``width`` words, A-Z
    lower-cased. Rows link when 100 * intersection >= percent * union;
    ``component_id`` is the smallest id reachable. Rows with equal sets are
    folded first. Bands of the densified signatures make buckets; the member
    that shares most buckets is the hub and gets a candidate edge to every
    other member. Candidates are confirmed on full sets; what a star leaves
    apart is compared with the rest of its bucket. Bands miss a pair at
    the threshold with a chance below 1e-7.

    Null, empty and wordless texts have no shingles and stand alone. A short
    text is one shingle. Rows repeating the smallest id are all kept. An empty
    table gives no rows; other columns are ignored.
    """
    signed = written(signatures(docs, width, id_col, text_col), "signed")
    n_rows = signed.count()
    folded = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a set is a node by its own number: an id may have several texts
    folded = written(folded.withColumn("node", F.monotonically_increasing_id()), "folded")
    first = folded.select("node", "digest", F.col("least").alias("doc_id"))
    nodes = signed.join(first, ["doc_id", "digest"]).select("node", "n_shingles", "keys")
    nodes = nodes.dropDuplicates(["node"])
    spread = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(spread.join(sizes, "bucket"), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    best = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("last"), "n")).alias("h"))
    hubs = written(best.select("bucket", (-F.col("h.last")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    star = members.join(hubs, "bucket").filter((F.col("node") != F.col("hub")) & _alike("n", "hub_n", percent))
    pairs = star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    wanted = folded.select("node", "least", "digest").join(weight.select("node"), "node", "left_semi")
    sets = written(_sets(docs, wanted, width, id_col, text_col), "sets")
    links = written(_confirmed(pairs, sets, percent), "links")
    comps = written(connected_components(weight, links, "node"), "comps")
    keys = nodes.select("node", "keys").join(weight.select("node"), "node", "left_semi")
    late = written(_stragglers(members, hubs, comps, sets, keys, percent), "late")
    if late.count():
        comps = connected_components(weight, links.unionByName(late), "node")
    known = written(folded.join(comps, "node", "left").select("digest", "copies", "least", F.coalesce("component", "node").alias("comp")), "known")
    least = known.groupBy("comp").agg(F.min("least").alias("_component"), F.count(F.lit(1)).alias("variants"))
    known = join_groups(known.drop("least"), least, "comp", "variants", n_rows).select("digest", "_component", "copies")
    known = written(known, "named")
    light = signed.select("doc_id", "n_shingles", "digest")
    alone = light.filter("digest is null").withColumn("_component", F.lit(None).cast("long"))
    every = join_groups(light.filter("digest is not null"), known, "digest", "copies", n_rows).drop("copies").unionByName(alone)
    every = every.withColumn("component_id", F.coalesce("_component", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return every.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group: that with the smallest id.

    Rows that share an id share the decision and stay if one of them stays;
    rows with a null id stay.
    """
    groups = written(near_groups(docs, width, percent, id_col, text_col).select(F.col(id_col).alias("_gone"), "kept"), "groups")
    gone = groups.groupBy("_gone").agg(F.max("kept").alias("kept")).filter("not kept").select("_gone")
    gone = written(gone, "gone")
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")

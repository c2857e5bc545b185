"""The registered queries: each operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import tokenizer_path, written
from panelyard.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_near_dedup",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM w),
    g AS (SELECT doc_id, p, n, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, concat_ws(' ', w, w1, w2, w3) AS sh FROM g WHERE w3 IS NOT NULL OR (p = 1 AND n < 4)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
    """,
)
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=4)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.tokencount import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.toxicity import fit, held_out, passages

    docs = table(spark, sf_dir, "documents")
    found = passages(docs, fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.7).cast("int")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"), F.size("passages").alias("n_passages"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.tokenfiles import token_spans, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_spans(spark, path)


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.htmltext import main_text

    pages = main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.packing import cut_pieces, place_pieces

    pieces = cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    light = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    placed = place_pieces(light)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    "op8_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.exactdedup import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Verdict and rule, as the contract of the query gives them.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op11_resampling",
    rf"""
    WITH RECURSIVE step AS (
      SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
      SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    dw AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
    bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1),
    v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
    y AS (SELECT w, list_prepend(4294967295::UBIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)) AS bytes FROM v),
    f AS MATERIALIZED (SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS b FROM y, crc),
    s AS (SELECT b, sum(n)::DOUBLE AS n FROM dw JOIN f USING (w) GROUP BY 1),
    t AS (SELECT b, sum(n)::DOUBLE AS n FROM bw JOIN f USING (w) GROUP BY 1),
    z AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
    g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((s.n + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), z),
    x AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dw JOIN f USING (w) JOIN g USING (b) GROUP BY 1),
    o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN x USING (doc_id)),
    e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
    """,
)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_fill_in_middle",
    r"""
    WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
    d AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
    f AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
      sha256(pre || mid || suf) AS restored_sha256
    FROM p
    """,
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.fillmiddle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"))


@query(
    "op13_repeats",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS p, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS k
      FROM w WHERE len(ws) >= 50),
    f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS place FROM g JOIN f USING (k) WHERE m < doc_id),
    t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM w),
    k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY place) AS kept FROM t ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
)
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.llm.recompression import repeats

    found, _ = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")

"""Topic, attribution and streaming queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelyard.functions.text import add_clean_text
from panelyard.operators import explain as E
from panelyard.operators import forecast as G
from panelyard.operators import topics as T
from panelyard.plans.inputs import PANEL, panel, r6
from panelyard.plans.model_queries import horizon_table
from panelyard.plans.record_queries import AREAS, KEYWORDS
from panelyard.plans.registry import query, table
from panelyard.streaming import flows as S


def topical(spark, d):
    """Cleaned documents with their source number as topic; every seventh one is an outlier."""
    docs = add_clean_text(table(spark, d, "documents"), "text", [], [])
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return docs.select(
        "doc_id", "clean_tokens", F.when(F.col("doc_id") % 7 == 0, F.lit(-1)).otherwise(number).alias("topic_id")
    )


TOPICAL = r"""
tok AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE CAST(regexp_extract(source, '(\d+)$', 1) AS INT) END AS topic_id,
    list_filter(regexp_split_to_array(lower(regexp_replace(text, 'https?://\S+', ' ', 'g')), '[^\p{L}\p{N}'']+'),
      lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[\p{N}'']+')) AS w FROM documents),
grams AS (SELECT doc_id, topic_id, unnest(w) AS term FROM tok
  UNION ALL SELECT doc_id, topic_id, a || ' ' || b FROM (SELECT doc_id, topic_id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM tok WHERE len(w) >= 2)),
counts AS (SELECT topic_id, term, count(*) AS n FROM grams GROUP BY ALL),
sizes AS (SELECT topic_id, sum(n) AS words FROM counts GROUP BY 1),
totals AS (SELECT term, sum(n) AS tot FROM counts GROUP BY 1),
idf AS (SELECT term, ln(1 + (SELECT floor(avg(words)) FROM sizes) / tot) AS idf FROM totals),
weights AS (SELECT c.topic_id, c.term, c.n, idf, c.n / words * idf AS weight FROM counts c JOIN idf ON idf.term = c.term JOIN sizes s ON s.topic_id = c.topic_id)"""


@query(
    "ctfidf_terms",
    f"""WITH {TOPICAL}
    SELECT topic_id, term, n, round(weight, 8) AS weight, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 12) DESC, term) AS rank
    FROM weights QUALIFY rank <= 10""",
)
def ctfidf_terms(spark, d):
    best = T.top_terms(T.topic_weights(topical(spark, d), "topic_id", "clean_tokens"), "topic_id")
    return best.select("topic_id", "term", "n", F.round("weight", 8).alias("weight"), "rank")


@query(
    "topic_names",
    f"""WITH {TOPICAL}, r AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 12) DESC, term) AS rank FROM weights)
    SELECT topic_id, topic_id || '_' || string_agg(term, '_' ORDER BY rank) AS topic_name FROM r WHERE rank <= 4 GROUP BY 1""",
)
def topic_names(spark, d):
    return T.topic_names(T.topic_weights(topical(spark, d), "topic_id", "clean_tokens"), "topic_id")


@query(
    "outlier_reassign",
    f"""WITH {TOPICAL},
    docs AS (SELECT doc_id, g.term, count(*) * any_value(idf) AS v FROM grams g JOIN idf ON idf.term = g.term WHERE topic_id = -1 GROUP BY 1, 2),
    dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM docs GROUP BY 1),
    tn AS (SELECT topic_id, sqrt(sum(weight * weight)) AS n FROM weights WHERE topic_id <> -1 GROUP BY 1),
    sims AS (SELECT docs.doc_id, w.topic_id, sum(v * weight) / (any_value(dn.n) * any_value(tn.n)) AS sim
      FROM docs JOIN weights w ON w.term = docs.term AND w.topic_id <> -1 JOIN dn ON dn.doc_id = docs.doc_id JOIN tn ON tn.topic_id = w.topic_id GROUP BY ALL),
    best AS (SELECT doc_id, topic_id FROM sims WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, topic_id) = 1)
    SELECT t.doc_id, t.topic_id, CASE WHEN t.topic_id = -1 THEN coalesce(b.topic_id, -1) ELSE t.topic_id END AS new_topic
    FROM tok t LEFT JOIN best b ON b.doc_id = t.doc_id""",
)
def outlier_reassign(spark, d):
    moved = T.reassign_outliers(topical(spark, d), "doc_id", "topic_id", "clean_tokens")
    return moved.select("doc_id", "topic_id", "new_topic")


@query(
    "topic_similarity",
    f"""WITH {TOPICAL}, u AS (SELECT topic_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY topic_id)) AS w FROM weights WHERE topic_id <> -1)
    SELECT a.topic_id AS t1, b.topic_id AS t2, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.topic_id < b.topic_id GROUP BY 1, 2""",
)
def topic_similarity(spark, d):
    sims = T.topic_similarity(T.topic_weights(topical(spark, d), "topic_id", "clean_tokens"), "topic_id")
    return sims.select("t1", "t2", r6("similarity"))


@query(
    "topic_merges",
    f"""WITH RECURSIVE {TOPICAL}, u AS (SELECT topic_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY topic_id)) AS w FROM weights WHERE topic_id <> -1),
    ids AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT topic_id AS t FROM tok WHERE topic_id <> -1)),
    near AS (SELECT a.topic_id AS t1, b.topic_id AS t2, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.term = b.term AND a.topic_id < b.topic_id GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT x.i AS i, y.i AS j, coalesce(s, 0) AS s FROM ids x JOIN ids y ON x.t < y.t LEFT JOIN near ON t1 = x.t AND t2 = y.t),
    state AS (
      SELECT 0 AS step, list(t ORDER BY t) AS g FROM ids
      UNION ALL
      SELECT step + 1, list_transform(g, lambda x: CASE WHEN x = p[2] THEN p[1] ELSE x END) FROM (
        SELECT step, g, (SELECT [least(g[i], g[j]), greatest(g[i], g[j])] FROM m WHERE g[i] <> g[j] GROUP BY 1
          ORDER BY round(avg(s), 12) DESC, 1 LIMIT 1) AS p FROM state WHERE len(list_distinct(g)) > 10)),
    last AS (SELECT g FROM state ORDER BY step DESC LIMIT 1)
    SELECT doc_id, topic_id, coalesce(g[i], -1) AS coarse_topic FROM tok LEFT JOIN ids ON t = topic_id, last""",
)
def topic_merges(spark, d):
    docs = topical(spark, d)
    sims = T.topic_similarity(T.topic_weights(docs, "topic_id", "clean_tokens"), "topic_id")
    mapping, _ = T.merge_topics(sims, docs, "topic_id", 10)
    return T.with_coarse(docs.select("doc_id", "topic_id"), "topic_id", mapping)


@query("text_vectors")
def text_vectors(spark, d):
    docs = topical(spark, d)
    model = T.fit_text_vectors(docs, "clean_tokens", vocabulary=2000, dimensions=50)
    return T.text_vectors(docs, model).select("doc_id", "vector")


@query("topic_kmeans")
def topic_kmeans(spark, d):
    vectors = table(spark, d, "embeddings")
    model = T.fit_topics(vectors, "embedding", n_clusters=12)
    return model.assign(vectors, "embedding").select("vec_id", "topic_id", "topic_probability")


@query("topics_temporal")
def topics_temporal(spark, d):
    """Document topics from embeddings, shaped by the records before 2020-10-01 only."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 366).cast("int"))
    vectors = table(spark, d, "embeddings").withColumn("day", day)
    docs = topical(spark, d).withColumnRenamed("doc_id", "vec_id").drop("topic_id")
    both = vectors.join(docs, "vec_id").drop("label")
    out = T.fit_topics_before(both, "vec_id", "embedding", "clean_tokens", "day", "2020-10-01", n_clusters=12, min_topic_size=5, target=6)
    return out.select("vec_id", "is_train", "topic_id", "topic_name")


# --- attribution ---------------------------------------------------------------------------

COEFFICIENTS = {"conflict_persistence": 0.05, "conflict_severity_weighted": -0.01}
LINEAR = f"""{PANEL},
m AS (SELECT avg(conflict_persistence) AS a, avg(conflict_severity_weighted) AS b FROM panel),
attr AS (SELECT area, panel_date, 'conflict_persistence' AS feature, 0.05 * (conflict_persistence - a) AS attribution FROM panel, m
  UNION ALL SELECT area, panel_date, 'conflict_severity_weighted', -0.01 * (conflict_severity_weighted - b) FROM panel, m)"""


def linear(spark, d):
    return E.linear_attribution(panel(spark, d), ["area", "panel_date"], COEFFICIENTS)


@query("shap_linear", f"WITH {LINEAR} SELECT area, panel_date, feature, round(attribution, 6) AS attribution FROM attr")
def shap_linear(spark, d):
    return linear(spark, d).withColumn("attribution", F.round("attribution", 6))


# the test years, explained against the mean of the train years
TESTED = f"""{PANEL},
m AS (SELECT avg(conflict_persistence) AS a, avg(conflict_severity_weighted) AS b FROM panel WHERE year(panel_date) < 2000),
tested AS (SELECT * FROM panel WHERE year(panel_date) >= 2000),
attr AS (SELECT 'conflict_persistence' AS feature, 0.05 * (conflict_persistence - a) AS attribution FROM tested, m
  UNION ALL SELECT 'conflict_severity_weighted', -0.01 * (conflict_severity_weighted - b) FROM tested, m)"""


def tested(spark, d):
    train, test = G.temporal_split(panel(spark, d).withColumn("Year", F.year("panel_date")), 2000)
    return E.linear_attribution(test, ["area", "panel_date"], COEFFICIENTS, background=train)


@query(
    "attribution_summary",
    f"""WITH {TESTED} SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs_shap,
      round(avg(attribution), 6) AS mean_signed_shap FROM attr GROUP BY 1""",
)
def attribution_summary(spark, d):
    summary = E.attribution_summary(tested(spark, d))
    return summary.select("feature", r6("mean_abs_shap"), r6("mean_signed_shap"))


@query(
    "policy_statements",
    f"""WITH {TESTED}, s AS (SELECT feature, avg(abs(attribution)) AS a, avg(attribution) AS g FROM attr GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY a DESC, feature) AS rank FROM s)
    SELECT rank::INT AS rank, feature, rank || '. ' || feature || ': mean |SHAP| = ' || printf('%.4f', a) || ' -- ' ||
      CASE WHEN g > 0 THEN 'HIGHER values of this feature INCREASE predicted risk' WHEN g < 0 THEN 'HIGHER values of this feature DECREASE predicted risk'
           ELSE 'direction is mixed/ambiguous across records' END AS statement FROM r WHERE rank <= 5""",
)
def policy_statements(spark, d):
    summary = E.attribution_summary(tested(spark, d))
    return E.policy_statements(summary).select("rank", "feature", "statement")


@query("shap_tree")
def shap_tree(spark, d):
    """Exact attributions of a boosted model on the test years."""
    rows, features = horizon_table(spark, d)
    train, test = G.temporal_split(rows, 2000)
    model = G.fit(G.boosting, train, features, {"rounds": 5, "depth": 3}, True)
    return E.tree_attribution(test, ["area", "panel_date"], features, model.stages[-1])


@query("feature_importances")
def feature_importances(spark, d):
    rows, features = horizon_table(spark, d)
    train, _ = G.temporal_split(rows, 2000)
    model = G.fit(G.forest, train, features, {"trees": 10, "depth": 5, "leaf": 5})
    return G.importances(model, features, spark)


# --- streams -------------------------------------------------------------------------------

@query("stream_intake")
def stream_intake(spark, d):
    """Pages arriving as items, each URL once, filtered by scope."""
    source = table(spark, d, "pages")
    arriving = spark.readStream.schema(source.schema).option("pathGlobFilter", "pages.parquet").parquet(d)
    from panelyard.functions import drafts as D

    landed = arriving.select(
        F.timestamp_seconds(F.col("page_id") * 60).alias("seen_at"), "page_id",
        F.regexp_replace("url", r"[?#].*$", "").alias("url"), D.page_title(F.col("html")).alias("title"),
        F.lit("").alias("snippet"), F.when(F.col("page_id") % 10 == 0, F.lit("manual")).otherwise(F.lit("rss")).alias("discovered_via"),
    )
    found = S.drain(S.candidate_stream(landed, "seen_at", KEYWORDS, AREAS), "intake")
    return found.select("url", "manual_override", "matched_keyword", "matched_county")


def event_stream(spark, d):
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query(
    "stream_counts",
    """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n_events FROM events
    GROUP BY event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
)
def stream_counts(spark, d):
    counts = S.drain(S.period_counts(event_stream(spark, d), "event_type", "at", "window", "2 days", "1 day"), "counts")
    return counts.select("event_type", F.date_format("period_start", "yyyy-MM-dd").alias("day"), "n_events")


@query(
    "stream_month_counts",
    """SELECT o_orderpriority, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n_events FROM orders
    GROUP BY o_orderpriority, date_trunc('month', o_orderdate)
    HAVING date_trunc('month', o_orderdate) <= (SELECT max(date_trunc('month', o_orderdate)) - INTERVAL 40 DAY FROM orders)""",
)
def stream_month_counts(spark, d):
    """Orders arriving as a stream; a month is told once the watermark of 40 days has passed its start."""
    source = table(spark, d, "orders")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    arriving = stream.withColumn("at", F.col("o_orderdate").cast("timestamp"))
    counts = S.drain(S.period_counts(arriving, "o_orderpriority", "at"), "months")
    return counts.select("o_orderpriority", F.date_format("period_start", "yyyy-MM").alias("month"), "n_events")

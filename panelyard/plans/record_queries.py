"""Duplicates, ids, joins, intake and record-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions import drafts as D
from panelyard.functions.names import normalize_name
from panelyard.operators import dedupe as U
from panelyard.operators import intake as I
from panelyard.operators import records as R
from panelyard.plans.registry import query, table
from panelyard.session import checkpointed, scratch_path, stored
from panelyard.sources import tables as S


def copied_records(spark, d):
    """Documents with colliding ids: equal texts share a row content, ids repeat every 700."""
    docs = table(spark, d, "documents")
    return docs.select((F.col("doc_id") % 700).alias("rid"), "lang", "source", F.md5("text").alias("body"))


@query(
    "exact_dupes",
    """WITH r AS (SELECT doc_id % 700 AS rid, lang, source, md5(text) AS body FROM documents),
    c AS (SELECT *, count(*) OVER (PARTITION BY rid, lang, source, body) AS nf, count(*) OVER (PARTITION BY rid) AS ni FROM r)
    SELECT count(*) FILTER (nf > 1) AS rows_in_full_duplicates, count(*) FILTER (ni > 1) AS rows_sharing_id,
           count(*) FILTER (ni > 1 AND nf = 1) AS conflicting_rows FROM c""",
)
def exact_dupes(spark, d):
    return R.duplicate_report(copied_records(spark, d), "rid")


@query(
    "repeated_rows",
    """SELECT doc_id, md5(text) AS body FROM documents
    WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""",
)
def repeated_rows(spark, d):
    return R.repeated(table(spark, d, "documents").select("doc_id", F.md5("text").alias("body")), ["body"])


@query(
    "id_collisions",
    """WITH r AS (SELECT doc_id, 'K' || (doc_id % 37) || CASE WHEN doc_id % 41 = 0 THEN '-B' ELSE '' END AS rid FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY doc_id) AS rk FROM r),
    m AS (SELECT *, CASE WHEN rk = 1 THEN rid WHEN rk <= 26 THEN rid || '-' || chr((64 + rk)::INT) ELSE rid || '-' || rk END AS new FROM n)
    SELECT doc_id, rid AS "Original_rid",
           CASE WHEN rk > 1 AND new IN (SELECT rid FROM r) THEN new || '-r' || doc_id ELSE new END AS rid FROM m""",
)
def id_collisions(spark, d):
    rid = F.concat(
        F.lit("K"), (F.col("doc_id") % 37).cast("string"), F.when(F.col("doc_id") % 41 == 0, F.lit("-B")).otherwise(F.lit(""))
    )
    docs = table(spark, d, "documents").select("doc_id", rid.alias("rid"))
    return R.resolve_collisions(docs, "rid", "doc_id")


@query(
    "keep_first",
    """SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice
    FROM orders GROUP BY 1""",
)
def keep_first(spark, d):
    return R.keep_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(
    "enrichment_join",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic, e.label FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def enrichment_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = table(spark, d, "labels").withColumn("lang", F.lit("not taken"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return R.enrich(docs, "doc_id", labels, vectors)


@query(
    "key_join",
    """SELECT s_suppkey, lower(n_name) || '|' || n_regionkey AS name_key, n_nationkey < 20 AS key_matched,
           CASE WHEN n_nationkey < 20 THEN n_nationkey END AS n_nationkey
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def key_join(spark, d):
    nations = table(spark, d, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    rows = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(F.lit(" "), F.upper("n_name"), F.lit("  ")).alias("area"), F.col("region").alias("county")
    )
    # the shapes of some nations are spelt in another way and so find no row
    spelt = F.when(F.col("n_nationkey") < 20, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit(" area")))
    shapes = nations.select("n_nationkey", spelt.alias("n_name"), "region")
    joined = R.key_join(rows, shapes, ("area", "county"), ("n_name", "region"))
    return joined.select("s_suppkey", R.composite_key(F.col("area"), F.col("county")).alias("name_key"), "key_matched", "n_nationkey")


@query(
    "filter_members",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, o_orderpriority) AS src_label,
           o_totalprice AS src_o_totalprice
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')""",
)
def filter_members(spark, d):
    chosen = R.members_of(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "3-MEDIUM"])
    label = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), F.col("o_orderpriority"))
    return R.with_prefix(chosen.select("o_orderkey", label.alias("label"), "o_totalprice"), "src", ["label", "o_totalprice"])


@query(
    "dictionary_lookup",
    """SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' ELSE 'UNK' END AS code,
           count(*) AS n FROM orders GROUP BY ALL""",
)
def dictionary_lookup(spark, d):
    code = R.lookup(F.col("o_orderpriority"), {"1-URGENT": "U", "2-HIGH": "H"}, F.lit("UNK"))
    return table(spark, d, "orders").groupBy("o_orderpriority", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- near duplicates --------------------------------------------------------------------

def dated_documents(spark, d):
    """Documents with a language as county and a start and end day from the id."""
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
    end = F.when(F.col("doc_id") % 3 != 0, F.date_add(start, (F.col("doc_id") % 45).cast("int")))
    return table(spark, d, "documents").select("doc_id", "lang", "text", "source", start.alias("start"), end.alias("end"))


def twice_reported_turns(spark, d):
    """Conversation turns as short summaries, each told again a week later with the words turned round."""
    turns = table(spark, d, "conversations")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 500).cast("int"))
    first = turns.select(
        (F.col("conv_id") * 2000 + F.col("turn") * 2).alias("rid"), (F.col("conv_id") % 25).alias("area"), "text", start.alias("start"),
        F.when(F.col("conv_id") % 3 != 0, F.date_add(start, (F.col("turn") * 9).cast("int"))).alias("end"),
    )
    again = F.concat_ws(" ", F.reverse(F.split("text", r"\s+")), F.lit("again"))
    second = first.select(
        (F.col("rid") + 1).alias("rid"), "area", again.alias("text"), F.date_add("start", 7).alias("start"), F.lit(None).cast("date").alias("end")
    )
    return first.unionByName(second)


@query("near_dup_pairs")
def near_dup_pairs(spark, d):
    return U.near_duplicate_pairs(twice_reported_turns(spark, d), "rid", "text", "area", "start", "end")


@query("near_dup_documents")
def near_dup_documents(spark, d):
    """The same over whole documents of any length, with their sources."""
    return U.near_duplicate_pairs(dated_documents(spark, d), "doc_id", "text", "lang", "start", "end", source="source")


@query(
    "near_dup_copies",
    r"""WITH t AS (SELECT doc_id, lang, CAST('2020-01-01' AS DATE) + CAST(doc_id % 500 AS INT) AS s,
        CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 45 AS INT) END AS e,
        array_to_string(list_sort(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), ' ') AS k FROM documents)
    SELECT doc_id AS record, min(doc_id) OVER (PARTITION BY lang, s, e, k) AS representative,
           count(*) OVER (PARTITION BY lang, s, e, k) AS copies FROM t WHERE k <> ''""",
)
def near_dup_copies(spark, d):
    return U.copy_members(dated_documents(spark, d), "doc_id", "text", "lang", "start", "end")


INTAKE = r"""
new AS (SELECT doc_id AS id, lang AS county, CASE WHEN doc_id % 4 <> 0 THEN CAST('2020-01-01' AS DATE) + CAST(doc_id % 500 AS INT) END AS day,
    list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS w FROM documents),
old AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'en' END AS county,
    CASE WHEN item_id % 3 = 0 THEN CAST('2020-01-01' AS DATE) + CAST(item_id % 500 AS INT) END AS day,
    list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS w FROM benchmark),
other AS (SELECT 'new' AS side, *, len(w) AS n FROM new UNION ALL SELECT 'existing', *, len(w) FROM old),
lw AS (SELECT id, county, day, n, unnest(w) AS word FROM other WHERE side = 'new'),
rw AS (SELECT side, id, county, day, n, unnest(w) AS word FROM other),
pairs AS (
  SELECT a.id, b.side, b.id AS other, a.n AS la, b.n AS lb, count(*) AS shared
  FROM lw a JOIN rw b ON a.word = b.word
  WHERE (b.side = 'existing' OR a.id <> b.id) AND (a.county = b.county OR a.county IS NULL OR b.county IS NULL)
   AND coalesce(abs(date_diff('day', a.day, b.day)) <= 30, true)
  GROUP BY ALL),
hits AS (SELECT id, side, other, shared / (la + lb - shared) AS sim FROM pairs WHERE shared / (la + lb - shared) >= 0.30)"""


def intake_sides(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    start = F.lit("2020-01-01").cast("date")
    new_args = (
        docs, "doc_id", F.col("text"), F.col("lang"),
        F.when(F.col("doc_id") % 4 != 0, F.date_add(start, (F.col("doc_id") % 500).cast("int"))),
    )
    old = U.intake_variants(
        items, "item_id", F.col("text"), F.when(F.col("item_id") % 2 == 0, F.lit("en")),
        F.when(F.col("item_id") % 3 == 0, F.date_add(start, (F.col("item_id") % 500).cast("int"))),
    )
    return new_args, old


@query(
    "jaccard_pairs",
    rf"""WITH {INTAKE} SELECT id AS record, other, round(sim, 6) AS similarity FROM hits WHERE side = 'existing'""",
)
def jaccard_pairs(spark, d):
    """Record-level pairs of documents with benchmark passages (few per document)."""
    new_args, old = intake_sides(spark, d)
    variants, members = U.intake(*new_args)
    pairs = stored(U.similar_pairs(stored(variants, "variants", "zstd"), checkpointed(old)), "pairs")
    members = members.withColumnRenamed("representative", "a_record")
    return pairs.join(members.select("record", "a_record"), "a_record").select(
        "record", F.col("b_record").alias("other"), F.round("similarity", 6).alias("similarity")
    )


@query(
    "dedupe_flagged",
    rf"""WITH {INTAKE}, s AS (SELECT id, count(*) AS n, max(sim) AS best FROM hits GROUP BY 1)
    SELECT new.id AS record, s.id IS NOT NULL AS is_flagged, coalesce(s.n, 0) AS n_matches, round(s.best, 6) AS best_similarity
    FROM new LEFT JOIN s ON s.id = new.id WHERE len(w) > 0""",
)
def dedupe_flagged(spark, d):
    new_args, old = intake_sides(spark, d)
    variants, members = U.intake(*new_args)
    flagged = U.flag_duplicates(members, U.intake_matches(variants, old))
    return flagged.select("record", "is_flagged", "n_matches", F.round("best_similarity", 6).alias("best_similarity"))


@query("dedupe_reasons")
def dedupe_reasons(spark, d):
    new_args, old = intake_sides(spark, d)
    variants, _ = U.intake(*new_args)
    matches = U.intake_matches(variants, old)
    return matches.select("record", U.match_reason(F.col("similarity"), F.col("side"), F.col("other")).alias("reason"), "n_other")


# --- candidate intake -------------------------------------------------------------------

KEYWORDS = ["tion ther", "nicht die", "quel", "thon and tion"]
AREAS = ["Ther", "eaux", "Lich"]


def _scope_sql(text: str) -> str:
    def present(keyword):
        return " AND ".join(f"contains({text}, '{w}')" for w in D.significant(keyword))

    keyword = " ".join(f"WHEN {present(k)} THEN '{k}'" for k in KEYWORDS)
    place = " ".join(f"WHEN contains({text}, '{a.lower()}') THEN '{a}'" for a in AREAS)
    return f"CASE {keyword} ELSE '' END AS matched_keyword, CASE {place} ELSE '' END AS matched_county"


@query(
    "scope_filter",
    f"""WITH t AS (SELECT page_id, url, lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || ' ' || url) AS x FROM pages),
    s AS (SELECT page_id, url, {_scope_sql("x")} FROM t)
    SELECT page_id, matched_keyword, matched_county FROM s WHERE matched_keyword <> '' AND matched_county <> ''""",
)
def scope_filter(spark, d):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    tests = D.scope(title, F.col("url"), KEYWORDS, AREAS)
    pages = table(spark, d, "pages").withColumns(tests).filter("in_scope")
    return pages.select("page_id", "matched_keyword", "matched_county")


def items(spark, d):
    """Pages as discovered items; repeated URLs and some hand-listed ones."""
    return table(spark, d, "pages").select(
        "page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), D.page_title(F.col("html")).alias("title"),
        F.lit("").alias("snippet"), F.when(F.col("page_id") % 10 == 0, F.lit("manual")).otherwise(F.lit("rss")).alias("discovered_via"),
        F.lit("").alias("source_name"), "html",
    )


@query(
    "discover_candidates",
    f"""WITH t AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url,
          trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages),
    f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    s AS (SELECT page_id, url, page_id % 10 = 0 AS manual_override, {_scope_sql("lower(title || ' ')")} FROM f)
    SELECT page_id, url, manual_override, CASE WHEN manual_override THEN '' ELSE matched_keyword END AS matched_keyword,
           CASE WHEN manual_override THEN '' ELSE matched_county END AS matched_county
    FROM s WHERE manual_override OR (matched_keyword <> '' AND matched_county <> '')""",
)
def discover_candidates(spark, d):
    found = I.discover(items(spark, d), "page_id", KEYWORDS, AREAS)
    return found.select("page_id", "url", "manual_override", "matched_keyword", "matched_county")


SOURCES = {"example.org": "Court Record", "blog.": "NGO", "m.": "Government"}


@query(
    "source_type",
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
    SELECT page_id, host, CASE WHEN contains(host, 'example.org') THEN 'Court Record' WHEN contains(host, 'blog.') THEN 'NGO'
      WHEN contains(host, 'm.') THEN 'Government' ELSE 'Print/Online News' END AS source_type FROM h""",
)
def source_type(spark, d):
    return table(spark, d, "pages").select(
        "page_id", D.host(F.col("url")).alias("host"), D.source_type(F.col("url"), SOURCES).alias("source_type")
    )


def _page_text_sql(c: str) -> str:
    sql = f"regexp_replace({c}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("head", "script", "style", "nav", "footer", "aside", "form"):
        sql = rf"regexp_replace({sql}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    sql = f"regexp_replace({sql}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in D.ENTITIES.items():
        quoted = char.replace("'", "''")
        sql = f"replace({sql}, '{name}', '{quoted}')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


@query(
    "page_text",
    f"""WITH t AS (SELECT page_id, {_page_text_sql("html")} AS text FROM pages)
    SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
)
def page_text(spark, d):
    read = table(spark, d, "pages").select("page_id", D.page_text(F.col("html")).alias("text"))
    return read.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "record_ids",
    """SELECT c_custkey, 'KEN-' || CASE c_mktsegment WHEN 'BUILDING' THEN 'NBI' WHEN 'MACHINERY' THEN 'TRK' ELSE 'UNK' END || '-' ||
           CASE WHEN length(CAST(rn AS VARCHAR)) < 4 THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END AS record_id
    FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)""",
)
def record_ids(spark, d):
    from panelyard.operators.ordering import numbered

    customers = numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "rn")
    codes = {"BUILDING": "NBI", "MACHINERY": "TRK"}
    return customers.select("c_custkey", I.record_id(F.col("c_mktsegment"), F.col("rn"), codes).alias("record_id"))


def reports(spark, d):
    """Order rows written as short news texts with casualty and displacement sentences."""
    o = table(spark, d, "orders")
    n = F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    harm = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("At least "), n, F.lit(" people were\n killed near the dam"))).otherwise(
        F.lit("No one was hurt")
    )
    away = F.when(F.col("o_orderkey") % 4 == 0, F.lit("Hundreds fled the  area")).otherwise(F.lit("Nobody moved"))
    return o.select(
        "o_orderkey", F.concat(F.lit("On "), day, F.lit(" it began. "), harm, F.lit(". "), away, F.lit(". More than "), n, F.lit(" words")).alias("text"),
        F.concat(F.lit("around noon; "), day, F.lit("; "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dates"),
    )


REPORTS = """
r AS (SELECT o_orderkey, o_custkey, day(o_orderdate) || strftime(o_orderdate, ' %B %Y') AS day_text, CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query(
    "draft_fields",
    f"""WITH {REPORTS}
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'At least ' || o_custkey || ' people were killed near the dam.' ELSE '' END AS casualty,
           o_orderkey % 3 = 0 AS casualty_is_lower_bound,
           CASE WHEN o_orderkey % 4 = 0 THEN 'Hundreds fled the area.' ELSE '' END AS displacement,
           day_text AS dates, round((1 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 4 = 0)::INT) / 5.0, 2)::DOUBLE AS share FROM r""",
)
def draft_fields(spark, d):
    text = F.col("text")
    cols = reports(spark, d).select(
        "o_orderkey", D.casualty_sentence(text).alias("casualty"), D.displacement_sentence(text).alias("displacement"),
        F.array_join(D.dates_in(text), "; ").alias("dates"),
    )
    share = D.completeness_share([F.lit(""), F.col("dates"), F.lit(None), F.col("casualty"), F.col("displacement")])
    return cols.withColumns({"casualty_is_lower_bound": D.is_lower_bound(F.col("casualty")), "share": share})


@query("first_date", f"WITH {REPORTS} SELECT o_orderkey, day AS first_date FROM r")
def first_date(spark, d):
    return reports(spark, d).select("o_orderkey", D.first_date(F.col("dates")).alias("first_date"))


@query(
    "first_items",
    r"""SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))), 1, 5), '|') AS first_five
    FROM documents""",
)
def first_items(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(D.first_of(words, 5), "|").alias("first_five"))


@query("draft_rows")
def draft_rows(spark, d):
    """Full drafts from candidate pages that are in scope."""
    terms = {"Thon": "Place", "The": "River", "that": "Community", "Des": "Institution"}
    found = I.discover(items(spark, d), "page_id", KEYWORDS, AREAS)
    return I.draft_rows(found, "page_id", terms=terms)


# --- record shapes ----------------------------------------------------------------------

@query(
    "json_records",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, strftime(ts, '%Y-%m-%d') AS day,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_records(spark, d):
    events = table(spark, d, "events")
    gaps = events.select(
        "event_id", F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.to_date("ts").alias("day"), F.from_json("props", "k long")["k"].alias("k"),
    )
    text = S.json_records(gaps)
    return text.select(F.from_json("json", "event_id long, value double, day string, k long").alias("r")).select("r.*")


@query(
    "split_flag",
    """SELECT month(o_orderdate) = 1 AND day(o_orderdate) = 1 AS is_suspect, count(*) AS n, min(o_orderkey) AS first_key
    FROM orders GROUP BY 1""",
)
def split_flag(spark, d):
    """Suspect and clear orders written to a folder each, and both folders read back."""
    from panelyard.functions.cleaning import suspect_date, without_suspect_dates
    from panelyard.sources.tables import write_split

    flagged = table(spark, d, "orders").withColumn("is_suspect", suspect_date(F.col("o_orderdate")))
    path = scratch_path(spark, "split")
    write_split(flagged, "is_suspect", path)
    # a folder's name gives the flag back as text
    back = spark.read.parquet(path).withColumn("is_suspect", F.col("is_suspect").cast("boolean"))
    kept = without_suspect_dates(back, "is_suspect", exclude=True)
    return back.filter("is_suspect").unionByName(kept).groupBy("is_suspect").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key")
    )


@query(
    "typed_read",
    """SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
)
def typed_read(spark, d):
    """Write orders as text in a CSV folder and read them back with a schema."""
    path = scratch_path(spark, "orders-csv")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    S.write_csv(o, path)
    return S.read_typed_csv(spark, path, "o_orderkey long, o_totalprice double, o_orderdate date").drop("_corrupt")


@query(
    "metrics_union",
    """SELECT o_orderstatus AS grp, 'orders' AS model, round(avg(o_totalprice), 4) AS mean_price, NULL::DOUBLE AS mean_quantity FROM orders GROUP BY 1
    UNION ALL SELECT l_linestatus, 'lines', NULL, round(avg(l_quantity), 4) FROM lineitem GROUP BY 1""",
)
def metrics_union(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("grp")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))
    return S.stack({"orders": a, "lines": b}, "model")

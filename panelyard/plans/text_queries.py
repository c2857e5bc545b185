"""Cleaning, text and name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import cleaning as C
from panelyard.functions import labels as L
from panelyard.functions import names as N
from panelyard.functions import similarity as M
from panelyard.functions import text as X
from panelyard.plans.inputs import r6
from panelyard.plans.registry import query, table

LAND = ["orantion", "hehely", "nicht", "tion"]
WATER = ["rewh", "thatin", "elle", "than"]
PLACES = {
    "Thon": "Place", "Then the": "Place", "The": "River", "Der": "River", "On the": "Water_Infrastructure",
    "that": "Community", "nicht": "Community", "Des": "Institution", "of the": "Institution",
}


# --- dirty incident fields derived from the order tables ----------------------------------

def dirty_counts(spark, d):
    """Counts as found in raw records: plain, lower bounds, thousands commas, Unknown, blanks, null."""
    o = table(spark, d, "orders")
    whole = F.floor("o_totalprice").cast("string")
    kind = F.col("o_orderkey") % 7
    raw = (
        F.when(kind == 0, F.concat(whole, F.lit("+"))).when(kind == 1, F.lit(" Unknown "))
        .when(kind == 2, F.concat(F.lit(" "), whole)).when(kind == 3, F.lit("5,000+"))
        .when(kind == 4, F.lit("")).when(kind == 5, F.lit(None)).otherwise(whole)
    )
    other = F.when(F.col("o_custkey") % 3 == 0, F.lit("unknown")).otherwise((F.col("o_custkey") % 50).cast("string"))
    return o.select("o_orderkey", raw.alias("Casualties_Reported"), other.alias("Displaced_Persons"))


DIRTY_COUNTS = """
dirty AS (
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN CAST(floor(o_totalprice)::BIGINT AS VARCHAR) || '+' WHEN 1 THEN ' Unknown '
           WHEN 2 THEN ' ' || CAST(floor(o_totalprice)::BIGINT AS VARCHAR) WHEN 3 THEN '5,000+' WHEN 4 THEN '' WHEN 5 THEN NULL
           ELSE CAST(floor(o_totalprice)::BIGINT AS VARCHAR) END AS c,
         CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS p
  FROM orders),
counts AS (
  SELECT o_orderkey,
    CASE WHEN coalesce(lower(trim(c)) = 'unknown', false) THEN NULL ELSE TRY_CAST(rtrim(trim(c), '+') AS DOUBLE) END AS c_num,
    coalesce(ends_with(trim(c), '+'), false) AS c_low, coalesce(lower(trim(c)) = 'unknown', false) AS c_unk,
    CASE WHEN lower(trim(p)) = 'unknown' THEN NULL ELSE TRY_CAST(rtrim(trim(p), '+') AS DOUBLE) END AS p_num,
    lower(trim(p)) = 'unknown' AS p_unk
  FROM dirty)"""


@query(
    "parse_counts",
    f"""WITH {DIRTY_COUNTS}
    SELECT o_orderkey, c_num AS casualties, c_low AS is_lower_bound, c_unk AS is_unknown,
           CASE WHEN c_unk AND p_unk THEN NULL
                ELSE round(ln(1 + coalesce(c_num, 0)) + 0.5 * ln(1 + coalesce(p_num, 0)), 6) END AS severity_score
    FROM counts""",
)
def parse_counts(spark, d):
    counted = C.clean_counts(dirty_counts(spark, d)).withColumn("severity_score", F.round(C.severity(), 6))
    return counted.select(
        "o_orderkey", F.col("Casualties_Reported_numeric").alias("casualties"),
        F.col("Casualties_Reported_is_lower_bound").alias("is_lower_bound"),
        F.col("Casualties_Reported_is_unknown").alias("is_unknown"), "severity_score",
    )


RAW_DATES = """
raw AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 13 = 0 THEN '13/45/2010' WHEN o_orderkey % 17 = 0 THEN NULL
         WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS a,
    CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL 1 DAY * CAST(o_custkey % 400 AS INT), '%m/%d/%Y') END AS b,
    CASE WHEN o_orderkey % 23 = 0 THEN 'A Long-Running dispute' WHEN o_orderkey % 29 = 0 THEN 'ongoing' ELSE o_orderpriority END AS notes
  FROM orders),
parsed AS (SELECT o_orderkey, notes, CAST(try_strptime(a, '%m/%d/%Y') AS DATE) AS a, CAST(try_strptime(b, '%m/%d/%Y') AS DATE) AS b FROM raw)"""


def raw_dates(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    plain = F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))
    start = (
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("13/45/2010")).when(F.col("o_orderkey") % 17 == 0, F.lit(None))
        .when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(plain)
    )
    end = F.date_format(F.date_add(day, (F.col("o_custkey") % 400).cast("int")), "MM/dd/yyyy")
    notes = (
        F.when(F.col("o_orderkey") % 23 == 0, F.lit("A Long-Running dispute"))
        .when(F.col("o_orderkey") % 29 == 0, F.lit("ongoing")).otherwise(F.col("o_orderpriority"))
    )
    return o.select(
        "o_orderkey", start.alias("Date_Start"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit("")).otherwise(end).alias("Date_End"), notes.alias("Notes"),
    )


@query(
    "parse_dates",
    f"""WITH {RAW_DATES}
    SELECT o_orderkey, a AS "Date_Start_parsed", b AS "Date_End_parsed", date_diff('day', a, b) AS duration_days,
           coalesce(month(a) = 1 AND day(a) = 1, false) AS date_precision_suspect FROM parsed""",
)
def parse_dates(spark, d):
    return C.parse_dates(raw_dates(spark, d)).drop("Date_Start", "Date_End", "Notes")


@query(
    "failed_dates",
    f"""WITH {RAW_DATES}
    SELECT 'Date_Start' AS "column", count(*) FILTER (a IS NOT NULL AND try_strptime(a, '%m/%d/%Y') IS NULL) AS failed FROM raw
    UNION ALL SELECT 'Date_End', count(*) FILTER (b IS NOT NULL AND try_strptime(b, '%m/%d/%Y') IS NULL) FROM raw""",
)
def failed_dates(spark, d):
    return C.failed_dates(raw_dates(spark, d), ["Date_Start", "Date_End"])


@query(
    "composite_flags",
    f"""WITH {RAW_DATES}, flags AS (
      SELECT o_orderkey, coalesce(date_diff('day', a, b) > 180, false) AS is_long_duration,
             regexp_matches(notes, '(?i)composite|chronic|long[- ]running|long[- ]term|multiple sources|ongoing|sustained') AS notes_mentions_chronic
      FROM parsed)
    SELECT *, is_long_duration OR notes_mentions_chronic AS "Is_Composite" FROM flags""",
)
def composite_flags(spark, d):
    flagged = C.flag_composite(C.parse_dates(raw_dates(spark, d)))
    return flagged.select("o_orderkey", "is_long_duration", "notes_mentions_chronic", "Is_Composite")


def broken_text(spark, d):
    """Documents whose accents were read with the wrong encoding."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("good"))
    wrong = F.decode(F.encode("good", "UTF-8"), "ISO-8859-1")
    return docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, wrong).otherwise(F.col("good")))


@query(
    "repair_text",
    """SELECT lang, count(*) AS n, count(*) AS n_right FROM documents GROUP BY 1""",
)
def repair_text(spark, d):
    fixed = C.repair_text(broken_text(spark, d), ["text"])
    return fixed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == F.col("good")).alias("n_right")
    )


# --- names ------------------------------------------------------------------------------

NAME_SQL = r"""
  trim(regexp_replace(regexp_replace(replace(strip_accents(lower(trim({c}))), '-', ' '), '[^a-z''\s]', '', 'g'), '\s+', ' ', 'g'))"""


def dirty_names(spark, d):
    """Part names with hyphens, accents, punctuation and case noise."""
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
        .when(kind == 1, F.concat(F.lit("  "), F.replace("p_name", F.lit("e"), F.lit("é")), F.lit(" 7")))
        .when(kind == 2, F.concat(F.col("p_name"), F.lit("'s!")))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", "p_name", "p_brand", name.alias("raw_name"))


@query(
    "normalize_names",
    f"""WITH dirty AS (
      SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-'))
        WHEN 1 THEN '  ' || replace(p_name, 'e', 'é') || ' 7' WHEN 2 THEN p_name || '''s!' ELSE p_name END AS raw_name FROM part)
    SELECT p_partkey, {NAME_SQL.format(c="raw_name")} AS norm FROM dirty""",
)
def normalize_names(spark, d):
    return dirty_names(spark, d).select("p_partkey", N.normalize_name(F.col("raw_name")).alias("norm"))


def canonical_parts(spark, d):
    """Part names as canonical areas with the first word as their county."""
    p = table(spark, d, "part")
    return N.canonical_areas(
        p.select(F.split("p_name", " ")[0].alias("County"), F.col("p_name").alias("SubCounty")), counties=None
    )


def matched_parts(spark, d):
    typo = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring("raw_name", 1, 4), F.substring("raw_name", 6, 100))).otherwise(
        F.col("raw_name")
    )
    hint = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).otherwise(F.split("p_name", " ")[0])
    rows = dirty_names(spark, d).withColumns({"typed": typo, "hint": hint})
    return N.match_areas(rows, "typed", canonical_parts(spark, d), "hint")


@query("fuzzy_match")
def fuzzy_match(spark, d):
    return matched_parts(spark, d).select(
        "p_partkey", "matched_county", "matched_subcounty", r6("match_score"), "match_method"
    )


@query("match_report")
def match_report(spark, d):
    """The real mix of exact, fuzzy and unmatched names."""
    matched = N.match_areas(dirty_names(spark, d), "raw_name", canonical_parts(spark, d))
    return N.match_report(matched).withColumn("share", F.round("share", 6))


@query(
    "exact_match_share",
    f"""WITH canon AS (SELECT DISTINCT {NAME_SQL.format(c="p_name")} AS norm FROM part),
    dirty AS (
      SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-'))
        WHEN 1 THEN '  ' || replace(p_name, 'e', 'é') || ' 7' WHEN 2 THEN p_name || '''s!' ELSE p_name END AS raw_name FROM part)
    SELECT p_partkey, {NAME_SQL.format(c="raw_name")} IN (SELECT norm FROM canon) AS is_exact FROM dirty""",
)
def exact_match_share(spark, d):
    """Which of all the dirtied names are found exactly."""
    matched = N.match_areas(dirty_names(spark, d), "raw_name", canonical_parts(spark, d))
    return matched.select("p_partkey", (F.col("match_method") == "exact").alias("is_exact"))


@query(
    "missing_areas",
    """SELECT n_name AS "SubCounty" FROM nation WHERE n_name NOT IN (
      SELECT CASE WHEN n_nationkey % 7 = 0 THEN n_name || ' area' ELSE n_name END FROM nation JOIN supplier ON s_nationkey = n_nationkey)""",
)
def missing_areas(spark, d):
    nations = table(spark, d, "nation")
    areas = N.canonical_areas(
        nations.select(F.col("n_regionkey").cast("string").alias("County"), F.col("n_name").alias("SubCounty")), counties=None
    )
    spelt = F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.col("n_name"), F.lit(" area"))).otherwise(F.col("n_name"))
    rows = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("spelt", spelt)
    return N.areas_without_match(areas, rows, "spelt").select("SubCounty")


@query("token_sort_ratio")
def token_sort_ratio(spark, d):
    """Each document against the benchmark passages that open with the same word."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)).alias("w"))
    items = table(spark, d, "benchmark").select(
        "item_id", F.col("text").alias("passage"), F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)).alias("w")
    )
    pairs = docs.join(items, "w")
    return pairs.select("doc_id", "item_id", F.round(M.token_sort_ratio(F.col("text"), F.col("passage")), 6).alias("score"))


@query(
    "token_jaccard",
    r"""WITH a AS (SELECT doc_id, regexp_extract(text, '^\s*(\S+)', 1) AS w,
        list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS s FROM documents),
    b AS (SELECT item_id, regexp_extract(text, '^\s*(\S+)', 1) AS w,
        list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS s FROM benchmark)
    SELECT doc_id, item_id, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0
      ELSE round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) END AS similarity
    FROM a JOIN b ON a.w = b.w""",
)
def token_jaccard(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("w"), M.word_set(F.col("text")).alias("a")
    )
    items = table(spark, d, "benchmark").select(
        "item_id", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("w"), M.word_set(F.col("text")).alias("b")
    )
    return docs.join(items, "w").select("doc_id", "item_id", F.round(M.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


# --- text features ----------------------------------------------------------------------

# RE2 has only ASCII word boundaries: separators are doubled so that each term can take one on both sides.
BOUND = r"regexp_replace(' ' || text || ' ', '([^\p{L}\p{M}\p{N}_])', '\1\1', 'g')"


def _terms_sql(terms: list[str], flags: str = "(?i)") -> str:
    inner = "|".join(t.replace(" ", r"\s\s") for t in terms)
    return rf"regexp_extract_all({BOUND}, '{flags}[^\p{{L}}\p{{M}}\p{{N}}_]({inner})[^\p{{L}}\p{{M}}\p{{N}}_]', 1)"


DOMAINS = f"""
found AS (
  SELECT doc_id, lang, source, n_chars, list_sort(list_distinct(list_transform({_terms_sql(LAND)}, lambda x: lower(x)))) AS land,
         list_sort(list_distinct(list_transform({_terms_sql(WATER)}, lambda x: lower(x)))) AS water
  FROM documents),
domains AS (
  SELECT *, CASE WHEN len(land) > 0 AND len(water) > 0 THEN 'Mixed' WHEN len(land) > 0 THEN 'Land-only'
                 WHEN len(water) > 0 THEN 'Water-only' ELSE 'Neither' END AS conflict_domain FROM found)"""


def documents_by_domain(spark, d):
    docs = table(spark, d, "documents").withColumn("keywords", F.lit(None).cast("string"))
    return X.add_domain(docs, "keywords", "text", LAND, WATER)


@query(
    "domain_classify",
    f"""WITH {DOMAINS}
    SELECT doc_id, conflict_domain, array_to_string(land, ', ') AS matched_land_terms,
           array_to_string(water, ', ') AS matched_water_terms FROM domains""",
)
def domain_classify(spark, d):
    return documents_by_domain(spark, d).select("doc_id", "conflict_domain", "matched_land_terms", "matched_water_terms")


@query(
    "domain_by_lang",
    f"""WITH {DOMAINS}
    SELECT lang, count(*) FILTER (conflict_domain = 'Land-only') AS "Land-only",
           count(*) FILTER (conflict_domain = 'Water-only') AS "Water-only",
           count(*) FILTER (conflict_domain = 'Mixed') AS "Mixed", count(*) FILTER (conflict_domain = 'Neither') AS "Neither"
    FROM domains GROUP BY 1""",
)
def domain_by_lang(spark, d):
    from panelyard.operators.explore import crosstab

    return crosstab(documents_by_domain(spark, d), "lang", "conflict_domain", ["Land-only", "Water-only", "Mixed", "Neither"])


def _entities_sql() -> str:
    order = sorted(PLACES, key=lambda t: (-len(t), t))
    hits = f"list_transform({_terms_sql(order, '')}, lambda x: replace(x, '  ', ' '))"
    columns = []
    for category in dict.fromkeys(PLACES.values()):
        own = ", ".join(f"'{t}'" for t, c in PLACES.items() if c == category)
        columns.append(
            f"""array_to_string(list_filter(hits, lambda x, i: list_contains([{own}], x) AND list_position(hits, x) = i), '|')
            AS "entities_{category}" """
        )
    return f"WITH h AS (SELECT doc_id, {hits} AS hits FROM documents) SELECT doc_id, {', '.join(columns)} FROM h"


@query("entity_gazetteer", _entities_sql())
def entity_gazetteer(spark, d):
    found = X.add_entities(table(spark, d, "documents"), "text", PLACES)
    names = [c for c in found.columns if c.startswith("entities_")]
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in names])


STOP = ["the", "and", "der", "die", "und", "les", "que", "county"]


def _clean_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return rf"""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, 'https?://\S+', ' ', 'g')),
                 '[^\p{{L}}\p{{N}}'']+'), lambda w: w <> '') AS w FROM documents),
    k AS (SELECT doc_id, len(w) AS n, list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[\p{{N}}'']+')
                 AND NOT list_contains([{stop}], x)) AS kept FROM t)
    SELECT doc_id, len(kept) AS n_tokens, n - len(kept) AS n_tokens_removed, md5(array_to_string(kept, ' ')) AS clean_md5 FROM k"""


@query("token_clean", _clean_sql())
def token_clean(spark, d):
    cleaned = X.add_clean_text(table(spark, d, "documents"), "text", STOP, [])
    return cleaned.select(
        "doc_id", F.size("clean_tokens").alias("n_tokens"), "n_tokens_removed", F.md5("clean_text").alias("clean_md5")
    )


@query(
    "split_delimited",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts
                  FROM documents)
    SELECT doc_id, len(parts) AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM p""",
)
def split_delimited(spark, d):
    parts = table(spark, d, "documents").withColumn("parts", X.split_list(F.col("text"), ","))
    return parts.select("doc_id", F.size("parts").alias("n_parts"), F.md5(F.array_join("parts", "|")).alias("parts_md5"))


def _words_sql() -> str:
    from panelyard.fixed_values import WORD_CLOUD_STOPWORDS

    stop = ", ".join(f"'{w}'" for w in WORD_CLOUD_STOPWORDS)
    return rf"""
    WITH t AS (SELECT unnest(CASE WHEN lang = 'de' THEN
        list_filter(list_transform(string_split(lower(text), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2)
      ELSE list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+'),
        lambda x: length(x) > 3 AND NOT list_contains([{stop}], x)) END) AS text FROM documents)
    SELECT text, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60"""


@query("word_frequency", _words_sql())
def word_frequency(spark, d):
    docs = table(spark, d, "documents")
    return X.word_frequency(docs, F.when(F.col("lang") == "de", F.col("text")), F.col("text"))


def _stopword_sql() -> str:
    from panelyard import fixed_values as fv

    rivers = [r.lower() for r in fv.RIVERS]
    listed = {
        *rivers, *[r.removesuffix(" river") for r in rivers], *[c.lower() for c in fv.TARGET_COUNTIES],
        *fv.OTHER_PLACES, *fv.GEOGRAPHY_WORDS,
    }
    fixed = ", ".join(f"('{w}')" for w in sorted(listed))
    order = sorted(PLACES, key=lambda t: (-len(t), t))
    own = ", ".join(f"'{t}'" for t, c in PLACES.items() if c in ("Place", "River"))
    protected = ", ".join(f"'{w}'" for w in sorted({w for p in (*fv.LAND_TERMS, *fv.WATER_TERMS) for w in p.split()}))
    return f"""
    WITH h AS (SELECT unnest(list_transform({_terms_sql(order, '')}, lambda x: replace(x, '  ', ' '))) AS place FROM documents),
    w AS (SELECT unnest(string_split(lower(place), ' ')) AS word FROM h WHERE place IN ({own}))
    SELECT * FROM (VALUES {fixed}) AS f(word)
    UNION SELECT word FROM w WHERE length(word) > 2 AND word NOT IN ({protected})"""


@query("stopword_set", _stopword_sql())
def stopword_set(spark, d):
    return X.place_stopwords(X.add_entities(table(spark, d, "documents"), "text", PLACES))


LISTED_STOP = ["Le la", "les DES", "of the and"]


@query(
    "stopword_union",
    r"""WITH own AS (SELECT DISTINCT lower(regexp_extract(text, '^\s*(\S+)', 1)) AS word FROM benchmark)
    SELECT word FROM own WHERE word <> '' UNION SELECT unnest(['le', 'la', 'les', 'des', 'of', 'the', 'and'])
    UNION SELECT DISTINCT lang FROM documents""",
)
def stopword_union(spark, d):
    """Opening words of the passages, listed words and language codes as one stop-word set."""
    opening = table(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)).alias("word"))
    langs = table(spark, d, "documents").select(F.col("lang").alias("word"))
    return X.union_words(LISTED_STOP, opening.filter("word <> ''"), langs)


VALENCES = [("the", 0.4), ("and", -0.3), ("nicht", -1.5), ("elle", 1.2), ("thon", 2.0), ("tion", -2.2), ("des", 0.7)]
NEGATIONS = ["of", "un", "in"]


@query(
    "lexicon_sentiment",
    rf"""WITH lex(word, valence) AS (VALUES {", ".join(f"('{w}', {v})" for w, v in VALENCES)}),
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, 'https?://\S+', ' ', 'g')),
                 '[^\p{{L}}\p{{N}}'']+'), lambda w: w <> '') AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS word, unnest(list_concat([''], w[:-2])) AS before FROM t),
    s AS (SELECT doc_id, sum(valence * CASE WHEN before IN ('of', 'un', 'in') THEN -0.74 ELSE 1.0 END) AS s
          FROM e JOIN lex USING (word) GROUP BY 1),
    c AS (SELECT d.doc_id, coalesce(s, 0) / sqrt(coalesce(s, 0) ** 2 + 15) AS score FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)
    SELECT doc_id, round(score, 6) AS sentiment_score,
           CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM c""",
)
def lexicon_sentiment(spark, d):
    lexicon = spark.createDataFrame(VALENCES, "word string, valence double")
    toned = X.add_tone(table(spark, d, "documents"), "doc_id", "text", "lexicon", lexicon=lexicon, negations=NEGATIONS)
    return toned.select("doc_id", r6("sentiment_score"), "sentiment_label")


@query(
    "map_labels",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High'
             WHEN 4 THEN 'High' ELSE 'No data' END AS label,
           CASE WHEN o_orderstatus = 'P' THEN 0.4 ELSE round(least(ln(1 + o_totalprice), 10) / 10, 6) END AS heat
    FROM orders""",
)
def map_labels(spark, d):
    raw = F.get(F.array(*map(F.lit, ["Low", "Lower", "Medium", "High", "Higher", None])), F.col("o_orderkey") % 6)
    known = F.when(F.col("o_orderstatus") != "P", F.log1p("o_totalprice"))
    return table(spark, d, "orders").select(
        "o_orderkey", L.map_risk_label(raw).alias("label"), F.round(L.heat_weight(known), 6).alias("heat")
    )


@query(
    "hotspot_label",
    """WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) AS z, (o_orderkey % 200) / 1000.0 AS p FROM orders)
    SELECT o_orderkey, CASE WHEN p > 0.10 THEN 'Not significant' ELSE
      CASE WHEN z > 0 THEN 'Hotspot' ELSE 'Coldspot' END || ' (' ||
      CASE WHEN p < 0.01 THEN '99%' WHEN p < 0.05 THEN '95%' ELSE '90%' END || ' confidence)' END AS hotspot_category FROM z""",
)
def hotspot_label(spark, d):
    from panelyard.operators.ordering import attach

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    scored = attach(o, o.agg(F.avg("o_totalprice").alias("m")), [])
    return scored.select(
        "o_orderkey", L.hotspot_label(F.col("o_totalprice") - F.col("m"), (F.col("o_orderkey") % 200) / 1000).alias("hotspot_category")
    )

"""Keyword domains, gazetteer entities, tokens, stop words and tone, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard import fixed_values as fv
from panelyard.functions.cleaning import strip


def either(terms: Sequence[str]) -> str:
    """Whole-word alternation with Unicode word boundaries, in the given order."""
    return r"\b(" + "|".join(re.escape(t).replace(r"\-", "-").replace(r"\ ", " ") for t in terms) + r")\b"


def matched_terms(text: Column, terms: Sequence[str], longest_first: bool = False) -> Column:
    """Sorted distinct lower-case terms found in the text, regardless of case."""
    listed = sorted(terms, key=len, reverse=True) if longest_first else list(terms)
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?iU)" + either(listed)), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(hits, F.lower)))


def domain_label(land: Column, water: Column) -> Column:
    on_land, on_water = F.size(land) > 0, F.size(water) > 0
    return (
        F.when(on_land & on_water, "Mixed").when(on_land, "Land-only").when(on_water, "Water-only").otherwise("Neither")
    )


def with_fallback(first: Column, second: Column) -> Column:
    """The first text unless it is null or blank."""
    return F.when(strip(F.coalesce(first, F.lit(""))) != "", first).otherwise(F.coalesce(second, F.lit("")))


def add_domain(
    df: DataFrame,
    keywords: str = "NLP_Keywords",
    fallback: str | None = "Incident_Summary",
    land_terms: Sequence[str] = tuple(fv.LAND_TERMS),
    water_terms: Sequence[str] = tuple(fv.WATER_TERMS),
    longest_first: bool = False,
) -> DataFrame:
    """Land-only, Water-only, Mixed or Neither, with the matched terms joined by ', '."""
    source = with_fallback(F.col(keywords), F.col(fallback)) if fallback in df.columns else F.col(keywords)
    found = df.withColumns(
        {
            "_land": matched_terms(source, land_terms, longest_first),
            "_water": matched_terms(source, water_terms, longest_first),
        }
    )
    return found.withColumns(
        {
            "conflict_domain": domain_label(F.col("_land"), F.col("_water")),
            "matched_land_terms": F.array_join("_land", ", "),
            "matched_water_terms": F.array_join("_water", ", "),
        }
    ).drop("_land", "_water")


def split_list(c: Column, delimiter: str = ",") -> Column:
    """Trimmed non-empty parts of a delimited text."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(delimiter)), strip)
    return F.filter(parts, lambda v: v != "")


def list_literal(c: Column) -> Column:
    """An array from text such as ``['a', "b"]``; null when it is not a list."""
    single = F.regexp_replace(F.regexp_replace(c, r"(?<=[\[,]\s?)'|'(?=\s?[\],])", '"'), r"\\'", "'")
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(single, T.ArrayType(T.StringType())))


def english_stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def raw_tokens(text: Column) -> Column:
    """Lower-case words and numbers after URLs are taken out."""
    free = F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " ")
    return F.filter(F.split(F.lower(free), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def kept_tokens(tokens: Column, stopwords: Sequence[str], shortest: int = 3) -> Column:
    """Tokens that are words of some length and not stop words."""
    return F.filter(
        tokens, lambda w: (F.length(w) >= shortest) & ~w.rlike(r"^[\p{N}']+$") & ~w.isin(list(stopwords))
    )


def add_clean_text(
    df: DataFrame,
    text: str,
    stopwords: Sequence[str] | None = None,
    domain_stopwords: Sequence[str] = tuple(fv.DOMAIN_STOPWORDS),
) -> DataFrame:
    """clean_tokens, clean_text and the number of tokens dropped."""
    words = list(stopwords if stopwords is not None else english_stopwords()) + list(domain_stopwords)
    split = df.withColumn("_all", raw_tokens(F.col(text)))
    kept = split.withColumn("clean_tokens", kept_tokens(F.col("_all"), words))
    return kept.withColumns(
        {
            "clean_text": F.array_join("clean_tokens", " "),
            "n_tokens_removed": F.size("_all") - F.size("clean_tokens"),
        }
    ).drop("_all")


def with_lemmas(df: DataFrame, key: str, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Replace tokens by their dictionary form from a (word, lemma) table; one row per key comes back."""
    spread = df.select(key, F.posexplode(tokens).alias("_at", "word"))
    named = spread.join(lemmas.select("word", "lemma"), "word", "left")
    back = named.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_at", F.coalesce("lemma", "word").alias("w")))).alias("_seq")
    )
    joined = df.drop(tokens).join(back, key, "left")
    return joined.withColumn(
        tokens, F.coalesce(F.transform("_seq", lambda s: s["w"]), F.array().cast("array<string>"))
    ).drop("_seq")


# --- gazetteer --------------------------------------------------------------------------

def gazetteer(areas: Sequence[str] = ()) -> dict[str, str]:
    """Term to category; the first category of a term wins."""
    listed = {
        "Place": [*fv.TARGET_COUNTIES, *areas],
        "River": fv.RIVERS,
        "Water_Infrastructure": fv.WATER_INFRASTRUCTURE,
        "Community": fv.COMMUNITIES,
        "Institution": fv.INSTITUTIONS,
    }
    terms: dict[str, str] = {}
    for category, words in listed.items():
        for word in words:
            terms.setdefault(word, category)
    return terms


def add_entities(df: DataFrame, text: str, terms: dict[str, str] | None = None) -> DataFrame:
    """One array of distinct entities per category, in order of appearance.

    All terms compete in one alternation, longest first, so a place name inside
    a river name is part of the river.
    """
    terms = terms or gazetteer()
    pattern = "(?U)" + either(sorted(terms, key=lambda t: (-len(t), t)))
    hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1))
    found = df.withColumn("_hits", F.array_distinct(hits))
    columns = {}
    for category in dict.fromkeys(terms.values()):
        own = F.array(*[F.lit(t) for t, c in terms.items() if c == category])
        columns[f"entities_{category}"] = F.array_intersect("_hits", own)
    other = F.array().cast("array<struct<text:string,label:string>>")
    return found.withColumns({**columns, "other_entities": other}).drop("_hits")


# --- stop words and word frequencies ------------------------------------------------------

def union_words(phrases: Sequence[str], *sources: DataFrame) -> DataFrame:
    """Distinct words of listed phrases and of one-column word tables."""
    words = sorted({w for phrase in phrases for w in phrase.lower().split()})
    fixed = sources[0].sparkSession.createDataFrame([(w,) for w in words], "word string")
    return reduce(DataFrame.unionByName, sources, fixed).distinct()


def place_stopwords(
    df: DataFrame,
    entity_columns: Sequence[str] = ("entities_Place", "entities_River"),
    areas: Sequence[str] = (),
    protected_phrases: Sequence[str] = (*fv.LAND_TERMS, *fv.WATER_TERMS),
) -> DataFrame:
    """Distinct stop words: listed places, rivers and geography words plus the words of found places."""
    rivers = [r.lower() for r in fv.RIVERS]
    listed = {
        *rivers, *[r.removesuffix(" river") for r in rivers], *[c.lower() for c in fv.TARGET_COUNTIES],
        *[a.lower() for a in areas], *fv.OTHER_PLACES, *fv.GEOGRAPHY_WORDS,
    }
    fixed = df.sparkSession.createDataFrame([(w,) for w in sorted(listed)], "word string")
    protected = sorted({w for phrase in protected_phrases for w in phrase.lower().split()})
    found = [
        df.select(F.explode(c).alias("place"))
        .select(F.explode(F.split(F.regexp_replace(F.lower("place"), "-", " "), r"\s+")).alias("word"))
        .filter((F.length("word") > 2) & ~F.col("word").isin(protected))
        for c in entity_columns
        if c in df.columns
    ]
    return reduce(DataFrame.unionByName, found, fixed).distinct()


def word_terms(
    keywords: Column, summary: Column, stopwords: Sequence[str] = tuple(fv.WORD_CLOUD_STOPWORDS)
) -> Column:
    """Keywords (over 2 letters) when there are any, else summary words (over 3 letters) without stop words."""
    from_keywords = F.filter(F.transform(F.split(F.lower(keywords), ","), strip), lambda t: F.length(t) > 2)
    words = F.split(F.regexp_replace(F.lower(summary), r"[^a-z\s]", " "), r"\s+")
    from_summary = F.filter(words, lambda t: (F.length(t) > 3) & ~t.isin(list(stopwords)))
    return F.when(F.coalesce(keywords, F.lit("")) != "", from_keywords).otherwise(from_summary)


def word_frequency(df: DataFrame, keywords: Column, summary: Column, top: int = 60) -> DataFrame:
    """The ``top`` most frequent terms; equal counts are ordered by term."""
    terms = df.select(F.explode(word_terms(keywords, summary)).alias("text"))
    return terms.groupBy("text").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "text").limit(top)


# --- tone -------------------------------------------------------------------------------

def tone_label(score: Column) -> Column:
    return (
        F.when(score >= fv.POSITIVE_FROM, "positive").when(score <= fv.NEGATIVE_TO, "negative").otherwise("neutral")
    )


def lexicon_tone(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: DataFrame,
    negations: Sequence[str] = ("not", "no", "never"),
    negated_factor: float = -0.74,
    damping: float = 15.0,
) -> DataFrame:
    """Score in (-1, 1): s / sqrt(s^2 + damping) over the summed (word, valence) lexicon.

    A word right after a negation counts with ``negated_factor``. Words meet
    the lexicon in an equi-join and are summed per record before the shuffle.
    """
    words = raw_tokens(F.col(text))
    spread = df.select(key, words.alias("_w")).select(
        key,
        F.explode(
            F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit("")), F.col("_w")).alias("before"))
        ).alias("_p"),
    ).select(key, F.col("_p.word").alias("word"), F.col("_p.before").isin(list(negations)).alias("_neg"))
    valued = spread.join(lexicon.select("word", "valence"), "word")
    sums = valued.groupBy(key).agg(
        F.sum(F.col("valence") * F.when(F.col("_neg"), F.lit(negated_factor)).otherwise(F.lit(1.0))).alias("_s")
    )
    scored = df.join(sums, key, "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    score = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(damping))
    return scored.withColumn("sentiment_score", score).withColumn(
        "sentiment_label", tone_label(F.col("sentiment_score"))
    ).drop("_s")


def model_tone(df: DataFrame, key: str, text: str, make_predict: Callable, batch_size: int = 16) -> DataFrame:
    """Tone from the caller's classifier.

    ``make_predict`` returns a function from an array of texts to an array of
    signed confidences: positive for the positive class, negative for the other.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    scored = df.withColumn("sentiment_score", predict(F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumn(
        "sentiment_label", F.when(F.col("sentiment_score") >= 0, "positive").otherwise("negative")
    )


TONE_BACKENDS: dict[str, Callable[..., DataFrame]] = {"lexicon": lexicon_tone, "model": model_tone}


def add_tone(df: DataFrame, key: str, text: str, backend: str = "lexicon", **options) -> DataFrame:
    """Tone by the named backend."""
    if backend not in TONE_BACKENDS:
        raise ValueError(f"unknown tone backend {backend!r}; known: {sorted(TONE_BACKENDS)}")
    return TONE_BACKENDS[backend](df, key, text, **options)

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import drafts as D
from panelyard.functions import text as X
from panelyard.operators import intake as I


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_domain(spark):
    rows = [
        ("water pan by Land Grabbing", "x"), (None, "river eviction"), ("  ", "evictions"), ("dam", None), ("", None), ("Éviction", "x"),
    ]
    df = spark.createDataFrame(rows, "NLP_Keywords string, Incident_Summary string")
    got = [(r["conflict_domain"], r["matched_land_terms"], r["matched_water_terms"]) for r in X.add_domain(df).collect()]
    assert got == [
        ("Mixed", "land grabbing", "water"), ("Mixed", "eviction", "river"), ("Neither", "", ""), ("Water-only", "", "dam"),
        ("Neither", "", ""), ("Neither", "", ""),
    ]
    longest = X.add_domain(df, longest_first=True).first()
    assert longest["matched_water_terms"] == "water pan"


def test_entities_prefer_the_longer_term(spark):
    df = spark.createDataFrame([("Nairobi River floods Nairobi; WRA and the Maasai near a water tower. Nairobi",), (None,)], "t string")
    got, empty = X.add_entities(df, "t").collect()
    assert got["entities_River"] == ["Nairobi River"] and got["entities_Place"] == ["Nairobi"]
    assert got["entities_Institution"] == ["WRA"] and got["entities_Water_Infrastructure"] == ["water tower"]
    assert empty["entities_Place"] == [] and empty["other_entities"] == []


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "See https://x.org/a?b The county's 12 Boreholes,\nand RIVER an"), (2, None)], "id int, t string")
    a, b = X.add_clean_text(df, "t").orderBy("id").collect()
    assert a["clean_tokens"] == ["see", "county's", "boreholes", "river"] and a["n_tokens_removed"] == 4
    assert b["clean_tokens"] == [] and b["clean_text"] == ""
    lemmas = spark.createDataFrame([("boreholes", "borehole")], "word string, lemma string")
    lemmatised = X.with_lemmas(X.add_clean_text(df, "t"), "id", "clean_tokens", lemmas).orderBy("id").collect()
    assert lemmatised[0]["clean_tokens"] == ["see", "county's", "borehole", "river"] and lemmatised[1]["clean_tokens"] == []


def test_lists(spark):
    assert one(spark, " a, b ,,\tc\n", lambda c: X.split_list(c)) == ["a", "b", "c"]
    assert one(spark, "a;b", lambda c: X.split_list(c, ";")) == ["a", "b"]
    assert one(spark, "['Nairobi', 'Athi River']", X.list_literal) == ["Nairobi", "Athi River"]
    assert one(spark, "[]", X.list_literal) == [] and one(spark, "nan", X.list_literal) is None


def test_stopwords_protect_theme_words(spark):
    df = spark.createDataFrame([(["Kangemi", "Mukuru-kwa Njenga", "Big Dam"],)], "entities_Place array<string>")
    words = {r["word"] for r in X.place_stopwords(df, areas=["Lang'ata"]).collect()}
    assert {"kangemi", "mukuru", "kwa", "njenga", "big", "lang'ata", "nairobi river", "tana", "kajiado"} <= words
    assert "dam" not in words


def test_word_terms(spark):
    df = spark.createDataFrame([("Land, RIVER bank ,ab", "x"), (None, "The county-wide floods2 over villages!")], "k string, s string")
    got = [r[0] for r in df.select(X.word_terms(F.col("k"), F.col("s"))).collect()]
    assert got == [["land", "river bank"], ["wide", "floods", "villages"]]


def test_tone(spark):
    df = spark.createDataFrame([(1, "good good day"), (2, "not good"), (3, None), (4, "bad")], "id int, t string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    got = {r["id"]: r for r in X.add_tone(df, "id", "t", "lexicon", lexicon=lexicon).collect()}
    assert np.isclose(got[1]["sentiment_score"], 4 / np.sqrt(31)) and got[1]["sentiment_label"] == "positive"
    assert got[2]["sentiment_label"] == "negative" and got[3]["sentiment_score"] == 0 and got[4]["sentiment_label"] == "negative"
    with pytest.raises(ValueError):
        X.add_tone(df, "id", "t", "other")


def test_model_tone(spark):
    def make():
        def predict(texts):
            return np.array([0.9 if "good" in t else -0.8 for t in texts])

        return predict

    df = spark.createDataFrame([(1, "good"), (2, None)], "id int, t string")
    got = {r["id"]: (r["sentiment_score"], r["sentiment_label"]) for r in X.add_tone(df, "id", "t", "model", make_predict=make).collect()}
    assert got == {1: (0.9, "positive"), 2: (-0.8, "negative")}


def test_urls_and_dates(spark):
    assert one(spark, "https://WWW.Nation.africa:80/x?y", D.host) == "nation.africa:80"
    assert one(spark, "https://www.nation.africa/x", D.source_type) == "Print/Online News"
    assert one(spark, "http://reports.kenyalaw.org", D.source_type) == "Court Record"
    assert str(one(spark, "soon; 14 March 2024; 2020-01-01", D.first_date)) == "2024-03-14"
    assert one(spark, "soon", D.first_date) is None and one(spark, None, D.first_date) is None
    assert one(spark, "On March 3, 2021 and 14 March 2024.", D.dates_in) == ["14 March 2024", "March 3, 2021"]


def test_sentences(spark):
    text = "Calm. At least\n 12 people were   killed here. Many more died. no full stop 5 dead"
    assert one(spark, text, D.casualty_sentence) == "At least 12 people were killed here."
    assert one(spark, "5 dead", D.casualty_sentence) == "" and one(spark, None, D.casualty_sentence) == ""
    assert one(spark, "Thousands fled.", D.displacement_sentence) == "Thousands fled."
    assert one(spark, "Over 5 died", D.is_lower_bound) and not one(spark, "overly 5 died", D.is_lower_bound)


def test_scope_needs_keyword_and_place(spark):
    rows = [("Riparian land encroachments", "in Nairobi"), ("river", "Kiambu"), ("eviction", ""), (None, "cattle raid turkana")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [(r["matched_keyword"], r["matched_county"], r["in_scope"]) for r in df.withColumns(D.scope(F.col("a"), F.col("b"))).collect()]
    assert got == [("riparian encroachment", "Nairobi", True), ("", "Kiambu", False), ("eviction", "", False), ("cattle raid", "Turkana", True)]
    with pytest.raises(ValueError):
        D.scope(F.col("a"), F.col("b"), ["a of b"])


def test_drafts(spark):
    html = "<html><head><title>T</title></head><body><nav>menu</nav><p>Nairobi &amp; Athi River: 3 people died. On 14 March 2024 the Maasai left</p></body></html>"
    rows = [
        (1, "https://www.nema.go.ke/a", "Eviction in Nairobi", "", "rss", "", html),
        (2, "https://www.nema.go.ke/a", "Eviction in Nairobi again", "", "rss", "", html),
        (3, "https://x.org/b", "nothing", "", "manual", "X", html), (4, "", "eviction Nairobi", "", "rss", "", html),
        (5, "https://x.org/c", "nothing", "", "rss", "", html),
    ]
    items = spark.createDataFrame(rows, "n int, url string, title string, snippet string, discovered_via string, source_name string, html string")
    found = I.discover(items, "n")
    assert sorted((r["n"], r["manual_override"], r["matched_county"]) for r in found.collect()) == [(1, False, "Nairobi"), (3, True, "")]
    drafts = I.draft_rows(found, "n").orderBy("Record_ID").collect()
    first = drafts[0]
    assert [r["Record_ID"] for r in drafts] == ["KEN-NBI-0001", "KEN-UNK-0002"]
    assert first["Sub_Location"] == "Athi River; Nairobi" and first["Casualties_Reported"] == "Nairobi & Athi River: 3 people died."
    assert first["Date_Start"] == "14 March 2024" and first["Source_Name"] == "nema.go.ke" and first["Data_Source_Type"] == "Government"
    assert first["Confidence_Score"] == 0.8 and first["Verified"] is False and drafts[1]["Source_Name"] == "X"

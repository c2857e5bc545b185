"""Column expressions for candidate intake: scope, hosts, dates, sentences, page text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard import fixed_values as fv

# Date layouts a suggested date may have.
DATE_LAYOUTS = ["d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "yyyy-MM-dd", "M/d/yyyy"]
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE_TEXT = rf"\b(\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})\b"
NUMBER_WORDS = r"\b(\d+|dozens?|scores?|several|many)\b"
MORE_NUMBER_WORDS = r"\b(\d+|dozens?|scores?|several|many|hundreds?|thousands?)\b"
HARM_WORDS = r"\b(died|killed|dead|casualt\w+|injured|wounded)\b"
FLIGHT_WORDS = r"\b(displaced|fled|evacuat\w+|homeless)\b"


def squeeze(c: Column) -> Column:
    """Single blanks between words."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def host(url: Column) -> Column:
    """Lower-case network location without a leading ``www.``."""
    place = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(place, r"^www\.", "")


def source_type(
    url: Column, known: dict[str, str] = fv.SOURCE_TYPES, default: str = fv.DEFAULT_SOURCE_TYPE
) -> Column:
    """Type of the first listed domain that is part of the host."""
    place = host(url)
    hits = [F.when(F.contains(place, F.lit(domain)), F.lit(kind)) for domain, kind in known.items()]
    return F.coalesce(*hits, F.lit(default))


def significant(phrase: str) -> list[str]:
    return [w for w in phrase.lower().split() if len(w) > 3]


def scope(
    title: Column,
    snippet: Column,
    keywords: Sequence[str] = tuple(fv.SCOPE_KEYWORDS),
    places: Sequence[str] = tuple(fv.TARGET_COUNTIES),
) -> dict[str, Column]:
    """First keyword and first place in list order, and whether both were found.

    A keyword is present when each of its words over three letters is part of
    some word of the text. Phrases without such a word are refused.
    """
    empty = [k for k in keywords if not significant(k)]
    if empty:
        raise ValueError(f"keywords need a word of more than three letters: {empty}")
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))

    def present(keyword: str) -> Column:
        # a word without blanks is part of some text word exactly when it is part of the text
        first, *more = [F.contains(text, F.lit(part)) for part in significant(keyword)]
        return reduce(lambda x, y: x & y, more, first)

    keyword = F.coalesce(*[F.when(present(k), F.lit(k)) for k in keywords], F.lit(""))
    place = F.coalesce(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p)) for p in places], F.lit(""))
    return {"matched_keyword": keyword, "matched_county": place, "in_scope": (keyword != "") & (place != "")}


def first_date(c: Column, layouts: Sequence[str] = tuple(DATE_LAYOUTS)) -> Column:
    """The first readable date of a ``;`` separated list."""
    parsed = F.transform(
        F.split(c, ";"),
        lambda part: F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(part), F.lit(x))) for x in layouts]),
    )
    return F.get(F.filter(parsed, lambda x: x.isNotNull()), F.lit(0))


def dates_in(text: Column) -> Column:
    """Distinct sorted date texts."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE_TEXT), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(hits, squeeze)))


def sentence_with(text: Column, numbers: str, words: str) -> Column:
    """The first sentence (ended by a full stop) with a number word followed by one of ``words``."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\.", -1)
    ended = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hits = F.filter(ended, lambda s: s.rlike(rf"(?is){numbers}.*{words}"))
    return F.when(F.size(hits) > 0, squeeze(F.concat(F.get(hits, F.lit(0)), F.lit(".")))).otherwise(F.lit(""))


def casualty_sentence(text: Column) -> Column:
    return sentence_with(text, NUMBER_WORDS, HARM_WORDS)


def displacement_sentence(text: Column) -> Column:
    return sentence_with(text, MORE_NUMBER_WORDS, FLIGHT_WORDS)


def is_lower_bound(sentence: Column) -> Column:
    return sentence.rlike(f"(?i){fv.LOWER_BOUND_PHRASE}")


def first_of(items: Column, k: int) -> Column:
    """The first ``k`` distinct items in sorted order."""
    return F.slice(F.sort_array(F.array_distinct(items)), 1, k)


def completeness_share(fields: Sequence[Column]) -> Column:
    """Filled share of the given text fields, two decimals."""
    filled = [F.when(F.coalesce(f, F.lit("")) != "", 1).otherwise(0) for f in fields]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return F.round(total / F.lit(len(filled)), 2)


# Named character references decoded in page text.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


def page_text(html: Column) -> Column:
    """Readable text of a page: no head, script, navigation, advert, footer or tags."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "nav", "footer", "aside", "form"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return squeeze(text)


def page_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))

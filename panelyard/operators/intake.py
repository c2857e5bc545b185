"""Candidate discovery and draft rows from landed items and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions import drafts as D
from panelyard.functions.text import add_entities
from panelyard.operators.ordering import numbered
from panelyard.operators.records import keep_first, lookup


def discover(
    items: DataFrame,
    order: str,
    keywords: Sequence[str] = tuple(fv.SCOPE_KEYWORDS),
    places: Sequence[str] = tuple(fv.TARGET_COUNTIES),
) -> DataFrame:
    """First item per URL that is in scope, or was listed by hand."""
    first = keep_first(items.filter(F.coalesce(F.col("url"), F.lit("")) != ""), ["url"], order)
    tests = D.scope(F.col("title"), F.col("snippet"), keywords, places)
    manual = F.coalesce(F.col("discovered_via") == "manual", F.lit(False))
    checked = first.withColumns(tests).withColumn("manual_override", manual)
    kept = checked.filter(F.col("manual_override") | F.col("in_scope")).drop("in_scope")
    blank = {c: F.when(F.col("manual_override"), F.lit("")).otherwise(F.col(c)) for c in ("matched_keyword", "matched_county")}
    return kept.withColumns({**blank, "discovery_date": F.current_date()})


def record_id(county: Column, number: Column, codes: dict[str, str] = fv.COUNTY_CODES) -> Column:
    return F.format_string("KEN-%s-%04d", lookup(county, codes, F.lit(fv.UNKNOWN_COUNTY_CODE)), number)


def draft_rows(
    pages: DataFrame, order: str, html: str = "html", terms: dict[str, str] | None = None,
    text_limit: int | None = None,
) -> DataFrame:
    """Incident drafts in the 24-field layout from candidate pages (url, title, county, source).

    Suggestions are drawn from the whole text, which is also stored whole
    unless ``text_limit`` asks for an excerpt. Pages without text are skipped.
    """
    read = pages.withColumn("_text", D.page_text(F.col(html))).filter(F.col("_text") != "")
    found = add_entities(numbered(read, order, "_number"), "_text", terms)
    places = F.concat(*[F.col(c) for c in ("entities_Place", "entities_River") if c in found.columns])
    parties = F.concat(*[F.col(c) for c in ("entities_Community", "entities_Institution") if c in found.columns])
    spots = F.sort_array(F.array_distinct(places))
    people = D.first_of(parties, 15)
    keywords = F.sort_array(F.array_union(F.slice(spots, 1, 5), F.slice(people, 1, 5)))
    harm, flight = D.casualty_sentence(F.col("_text")), D.displacement_sentence(F.col("_text"))
    url = F.col("url")
    named = F.coalesce(F.nullif(F.col("source_name"), F.lit("")), D.host(url))
    filled = {
        "Record_ID": record_id(F.col("matched_county"), F.col("_number")),
        "County": F.coalesce("matched_county", F.lit("")),
        "Sub_Location": F.array_join(F.slice(spots, 1, 8), "; "),
        "Date_Start": F.array_join(F.slice(D.dates_in(F.col("_text")), 1, 5), "; "),
        "Incident_Summary": F.coalesce("title", F.lit("")),
        "Parties_Involved": F.array_join(people, "; "),
        "Full_Text_Description": F.col("_text") if text_limit is None else F.substring("_text", 1, text_limit),
        "Source_Name": named,
        "Source_URL": url,
        "Data_Source_Type": D.source_type(url),
        "Casualties_Reported": harm,
        "Displaced_Persons": flight,
        "NLP_Keywords": F.array_join(keywords, ", "),
    }
    rows = found.select(*[c.alias(n) for n, c in filled.items()])
    share = D.completeness_share([F.col(c) for c in fv.SUGGESTED_FIELDS])
    rows = rows.withColumns(
        {
            "Verified": F.lit(False),
            "Confidence_Score": share,
            "Notes": F.lit(fv.DRAFT_NOTE),
            "casualty_is_lower_bound": D.is_lower_bound(F.col("Casualties_Reported")),
            "displacement_is_lower_bound": D.is_lower_bound(F.col("Displaced_Persons")),
        }
    )
    blank = [f for f in fv.INCIDENT_FIELDS if f not in rows.columns]
    return rows.withColumns({f: F.lit("") for f in blank}).select(
        *fv.INCIDENT_FIELDS, "casualty_is_lower_bound", "displacement_is_lower_bound"
    )

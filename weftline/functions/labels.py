"""Citations, document names, order keys and public dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import values as V


def federal_citation(title: Column, part: Column, section: Column) -> Column:
    """40 CFR 60.5360a, or 40 CFR Part 60 without a section."""
    number = F.regexp_replace(F.trim(section), r"^(§+\s*|[Ss]ec(tion|\.)?\s+)", "")
    return F.when(F.coalesce(number, F.lit("")) == "", F.concat(title, F.lit(" CFR Part "), part)).otherwise(F.concat(title, F.lit(" CFR "), number))


def label_of(node_id: Column) -> Column:
    """The dotted label of a node id: what follows its document key; of a part the word and its letter."""
    rest = F.regexp_extract(node_id, r"^sec-[^-]+-(.+)$", 1)
    return F.when(rest.rlike("^P-"), F.concat(F.lit("Part "), F.substring(rest, 3, 100))).otherwise(F.replace(rest, F.lit("-"), F.lit(".")))


def display_name(key: Column) -> Column:
    """A document key in words: reg7 is Regulation 7, gp03 General Permit GP03, oooob Subpart OOOOb, others in capitals."""
    reg, permit, sub = F.regexp_extract(key, r"^reg(\d+)$", 1), F.regexp_extract(key, r"^gp(\d\d)$", 1), F.regexp_extract(key, r"^([a-z]{4})([a-c]?)$", 0)
    return F.when(reg != "", F.concat(F.lit("Regulation "), reg)).when(permit != "", F.concat(F.lit("General Permit GP"), permit)).when(
        sub != "", F.concat(F.lit("Subpart "), F.upper(F.substring(sub, 1, 4)), F.substring(sub, 5, 1))
    ).otherwise(F.upper(key))


def order_key(key: Column) -> Column:
    """struct to sort documents by: regulations by number, then permits, then the rest by name."""
    number = F.nullif(F.regexp_extract(key, r"(\d+)", 1), F.lit("")).cast("int")
    group = F.when(key.rlike(r"^reg\d"), 0).when(key.rlike(r"^gp\d"), 1).otherwise(2)
    return F.struct(group.alias("group"), F.coalesce(number, F.lit(2147483647)).alias("number"), key.alias("key"))


def number_key(section: Column) -> Column:
    """Numbers of a section label as an array, so that 3162.2-10 sorts after 3162.2-9."""
    return F.transform(F.regexp_extract_all(section, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def public_day(c: Column, zone: str = V.ZONE) -> Column:
    """The day of a date as written, or of an instant in the zone; null for a day that doesn't exist."""
    plain = F.try_to_date(F.nullif(F.regexp_extract(c, r"^(\d{4}-\d\d-\d\d)$", 1), F.lit("")), "yyyy-MM-dd")
    return F.coalesce(plain, V.civil_day(F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d"), c)), zone))


def printed_effective_date(text: Column) -> Column:
    """The date of "effective January 5, 2024" or "effective 1/5/2024" in a text."""
    long = F.regexp_extract(text, r"(?i)\beffective:?\s+(?:date:?\s+)?((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})", 1)
    short = F.regexp_extract(text, r"(?i)\beffective:?\s+(?:date:?\s+)?(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.coalesce(F.try_to_date(F.nullif(long, F.lit("")), "MMMM d, yyyy"), F.try_to_date(F.nullif(short, F.lit("")), "M/d/yyyy"))


def named_documents(question: Column, patterns: dict[str, str]) -> Column:
    """array<string>: keys of the documents that a question names, in the order of their first mention; a search is limited to
    a document if exactly one is named."""
    low = F.lower(question)
    places = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.length(F.regexp_extract(low, f"(?s)^(.*?)(?:{p})", 1)).alias("at"), F.lit(k).alias("key"))) for k, p in patterns.items()]))
    return F.transform(F.array_sort(places), lambda x: x["key"])


def scope(question: Column, patterns: dict[str, str]) -> Column:
    named = named_documents(question, patterns)
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def permit_numbers(question: Column) -> Column:
    """array<string>: permits named by number, as GP03, once each."""
    found = F.regexp_extract_all(F.lower(question), F.lit(r"\b(?:gp\s?|general permit\s+(?:no\.?\s+)?)0?(\d{1,2})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("GP"), F.lpad(n, 2, "0"))))


def expanded(text: Column, acronyms: dict[str, str]) -> Column:
    """Each known abbreviation is kept and its phrase put behind it, once."""
    out = text
    for short, phrase in acronyms.items():
        out = F.regexp_replace(out, rf"(?i)\b({short})\b(?! \({phrase}\))", f"$1 ({phrase})")
    return out


def badge(status: Column, reviewed_at: Column) -> Column:
    """struct<class, day>: no badge for rejected rows, a dated one for reviewed ones, else pending."""
    return F.when(status == "rejected", F.lit(None)).when(
        status.isin("approved", "edited"), F.struct(F.lit("reviewed").alias("class"), V.civil_day(reviewed_at).alias("day"))
    ).otherwise(F.struct(F.lit("pending").alias("class"), F.lit(None).cast("date").alias("day")))


def destination(viewer: str, is_public: Column, public_document: Column) -> Column:
    """Where a row opens for a viewer: reader, preview or signup."""
    if viewer == "subscriber":
        return F.lit("reader")
    return F.when(public_document, "reader").when(is_public, "preview").otherwise("signup")


def context_key(node_id: Column, families: list[str]) -> Column:
    """The document of a node if it is of the families with an applicability context."""
    key = V.document_key(node_id)
    return F.when(key.isin(families) | F.regexp_replace(key, "[a-c]$", "").isin(families), key)

"""Keys, dates, hashes, vectors and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Denver"
MONTHS = ["Jan.", "Feb.", "March", "April", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]


def document_key(node_id: Column) -> Column:
    """The document of a node id sec-<document>-...; null if it has none."""
    return F.nullif(F.regexp_extract(node_id, "^sec-([^-]+)-", 1), F.lit(""))


def kind(node_id: Column) -> Column:
    """root, part, appendix or section, from the id."""
    return F.when(node_id.contains("-top-REG-"), "root").when(node_id.rlike("^sec-[^-]+-P-[^-]+$"), "part").when(node_id.rlike("^sec-[^-]+-A-"), "appendix").otherwise("section")


def in_subtree(node_id: Column, focus: Column | str) -> Column:
    """The focus itself or a descendant by id; characters of patterns mean themselves."""
    focus = F.lit(focus) if isinstance(focus, str) else focus
    return (node_id == focus) | F.startswith(node_id, F.concat(focus, F.lit("-")))


def related(a: Column, b: Column) -> Column:
    """One id is the other or above it."""
    return in_subtree(a, b) | in_subtree(b, a)


def civil_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def us_date(c: Column) -> Column:
    return F.try_to_date(c, "M/d/yyyy")


def day_month_year(day: Column) -> Column:
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.date_format(day, "MMMM yyyy"))


def ap_date(day: Column) -> Column:
    """Month names as newspapers shorten them."""
    return F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day)), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))


def content_hash(text: Column, model: str) -> Column:
    """SHA-256 of model, a zero byte, text."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text).cast("binary"), 256)


def dot(a: Column, b: Column) -> Column:
    """In double, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def words_in(query: str) -> int:
    """Words of a query; a blank one counts as one."""
    return max(1, len(query.split()))


def clamp(n: int | None, low: int, high: int, default: int) -> int:
    """``n`` if it is between ``low`` and ``high``, else ``default``."""
    return n if n is not None and low <= n <= high else default


def fused_score(score: Column, sem_rank: Column, kw_rank: Column, long_query: bool, bonus: float, k: int = 60) -> Column:
    """Reciprocal ranks for short queries; for sentences the similarity over a floor and a bonus that fades with the rank."""
    zero = F.lit(0.0)
    if long_query:
        faded = F.coalesce(F.lit(bonus) / (1 + (kw_rank - 1) / 10), zero)
        return (F.greatest(F.coalesce(score, zero).cast("double") - 0.40, F.lit(0.01)) + faded).cast("float")
    return (F.coalesce(1 / (k + sem_rank), zero) + F.coalesce(1 / (k + kw_rank), zero)).cast("float")

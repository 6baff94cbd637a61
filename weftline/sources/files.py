"""File sources: layout text, XML parts, id lists, manifests, version feeds and scraped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.schema import MANIFEST


def layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line, text) of layout text with form feeds between pages; lines keep their indentation."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    pages = whole.select("file", F.posexplode(F.split("value", "\f")).alias("page", "body"))
    return pages.select("file", "page", F.posexplode(F.split("body", "\n")).alias("line", "raw")).select("file", "page", "line", F.rtrim("raw").alias("text"))


def without_furniture(lines: DataFrame, header: int = 3, footer: str = r"^\s*(Page\s+)?\d+\s*$", banner: str = r"(?i)^\s*code of .* regulations\b") -> DataFrame:
    """Drops what repeats on pages: the first ``header`` lines if they recur on another page of the file, page numbers and banners."""
    bare = F.trim(F.regexp_replace("text", r"\d+", "#"))
    marked = lines.withColumn("bare", bare)
    pages = F.size(F.collect_set("page").over(W.partitionBy("file", "bare")))
    marked = marked.withColumn("recurs", (F.col("line") < header) & (F.col("bare") != "") & (pages > 1))
    return marked.filter(~F.col("recurs") & ~F.col("text").rlike(footer) & ~F.col("text").rlike(banner)).drop("bare", "recurs")


def body_start(lines: DataFrame, heading: str, source_line: str = r"^\s*Source:") -> DataFrame:
    """Lines from the first one after ``source_line`` that follows the last ``heading`` (a contents list repeats headings)."""
    place = F.struct("page", "line")
    last = lines.filter(F.col("text").rlike(heading)).groupBy("file").agg(F.max(place).alias("at"))
    after = lines.join(last, "file").filter(F.col("text").rlike(source_line) & (place > F.col("at"))).groupBy("file").agg(F.min(place).alias("source_at"))
    start = last.join(after, "file", "left").select("file", F.coalesce("source_at", "at").alias("start"))
    return lines.join(start, "file").filter(place > F.col("start")).drop("start")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements ``row_tag`` of XML files; attributes are columns that start with an underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id): one id a line, comments from # on, the first of repeated ones in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    ids = lines.select("line", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("id")).filter("id <> ''")
    first = ids.groupBy("id").agg(F.min("line").alias("line"))
    return first.select((F.row_number().over(W.orderBy("line")) - 1).alias("pos"), "id")  # a list of the command line


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, version_id, effective_date, as_of, permits) of a JSON manifest."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json(F.get_json_object("value", "$.sources"), MANIFEST)).alias("key", "v"))
    return entries.select("key", "v.kind", F.col("v.ruleVersionId").alias("version_id"), "v.effective_date", "v.as_of", "v.permits")


def version_of(kind: Column, version_id: Column, effective_date: Column, as_of: Column) -> Column:
    """The version that a manifest entry of a kind stands for."""
    return F.when(kind == "rule", F.coalesce(version_id, effective_date)).when(kind == "feed", as_of).otherwise(F.coalesce(effective_date, as_of))


def latest_feed_date(json: Column) -> Column:
    """The greatest amendment date (or date where it has none) of a version feed."""
    versions = F.from_json(F.get_json_object(json, "$.content_versions"), "array<struct<date: string, amendment_date: string>>")
    return F.array_max(F.transform(versions, lambda v: F.try_to_date(F.coalesce(v["amendment_date"], v["date"]))))


def rule_page(html: Column) -> Column:
    """struct<version_id, effective_date>: number in the first script call, and the first US date after it."""
    call = r"(?s)openWindow\('?(\d+)'?\)(.*)"
    rest = F.regexp_extract(html, call, 2)
    day = F.try_to_date(F.nullif(F.regexp_extract(rest, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), "M/d/yyyy")
    return F.struct(F.nullif(F.regexp_extract(html, call, 1), F.lit("")).alias("version_id"), day.alias("effective_date"))


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the anchors of a page, labels without markup."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(0))
    label = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]+>", " "), r"\s+", " "))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, "href=\"([^\"]*)\"", 1).alias("href"), label(a).alias("label")))


def feed_url(base: str, title: Column, part: Column, subpart: Column) -> Column:
    """Address of a version feed; the subpart is optional."""
    return F.concat(F.lit(base), F.lit("/title-"), title, F.lit(".json?part="), part, F.when(subpart.isNotNull(), F.concat(F.lit("&subpart="), subpart)).otherwise(""))


def xml_tables(spark: SparkSession, path: str) -> DataFrame:
    """(key, caption, rows): tables of XML parts; the key is the caption's letters and digits, rows are cells of cells."""
    cells = "array<struct<TD: array<string>, TH: array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "TABLE").schema(f"CAPTION string, TR {cells}").load(path)
    key = F.regexp_replace(F.lower("CAPTION"), "[^a-z0-9]", "")
    return rows.select(key.alias("key"), F.col("CAPTION").alias("caption"), F.transform("TR", lambda r: F.coalesce(r["TD"], r["TH"])).alias("rows"))


def values_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): strings of the first VALUES list of a SQL file; quotes in them are doubled."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?is)\bvalues\b(.*?)(?:;|\bas\b|$)", 1)
    return text.select(F.explode(F.regexp_extract_all(body, F.lit(r"\(\s*'((?:[^']|'')*)'"), F.lit(1))).alias("value")).select(F.replace("value", F.lit("''"), F.lit("'")).alias("value"))

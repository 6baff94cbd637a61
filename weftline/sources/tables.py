"""Loading: driver tables, and the corpus model derived from them.

Timestamps of the files carry no zone; they are read as UTC instants. The session zone has to be UTC for that.

The node table takes ``documents`` as text nodes: the parent of document d is document d div 10 (documents 0 to 9 are
roots), so every scale has a forest of some levels. Changes come from ``events``, vectors from ``embeddings``, review
states from ``labels``, the deep star tree from region down to lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; columns without a zone become instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def node_id(source: str = "source", number: str = "doc_id"):
    return F.concat(F.lit("sec-"), F.col(source), F.lit("-"), F.col(number).cast("string"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``nodes`` that a document has by itself. Nothing is joined, so what reads texts only shuffles none."""
    return read(spark, sf_dir, "documents").select(
        node_id().alias("id"), "doc_id", F.col("source").alias("reg_key"), F.concat(F.upper("source"), F.lit("."), F.col("doc_id").cast("string")).alias("citation"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"), F.col("text").alias("full_text"), (F.col("doc_id") * 10).alias("sort_order"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table: schema NODE and doc_id, reg_key."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    parents = docs.select(F.col("doc_id").alias("parent_number"), node_id().alias("parent_id"))
    own = docs.withColumn("parent_number", F.when(F.col("doc_id") >= 10, F.floor(F.col("doc_id") / 10)))
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    rows = own.join(parents, "parent_number", "left").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        node_id().alias("id"), "doc_id", F.col("source").alias("reg_key"),
        F.concat(F.upper("source"), F.lit("."), F.col("doc_id").cast("string")).alias("citation"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.when(F.col("lang") == "en", "federal").when(F.col("lang") == "de", "county").otherwise("state").alias("jurisdiction_level"),
        "parent_id", F.col("text").alias("full_text"),
        F.when(F.col("quality").isNotNull(), F.substring("text", 1, 200)).alias("ai_summary"),
        (F.col("doc_id") % 5 == 0).alias("is_public"), (F.col("doc_id") * 10).alias("sort_order"), status.alias("summary_status"),
    )


#: The same in DuckDB; other statements start with it.
NODES_SQL = """
nodes AS (
  SELECT 'sec-' || d.source || '-' || d.doc_id AS id, d.doc_id, d.source AS reg_key, upper(d.source) || '.' || d.doc_id AS citation,
    split_part(d.text, chr(10), 1) AS title,
    CASE d.lang WHEN 'en' THEN 'federal' WHEN 'de' THEN 'county' ELSE 'state' END AS jurisdiction_level,
    CASE WHEN d.doc_id >= 10 THEN 'sec-' || p.source || '-' || p.doc_id END AS parent_id, d.text AS full_text,
    CASE WHEN l.quality IS NOT NULL THEN substr(d.text, 1, 200) END AS ai_summary, d.doc_id % 5 = 0 AS is_public, d.doc_id * 10 AS sort_order,
    CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS summary_status
  FROM documents d LEFT JOIN documents p ON d.doc_id >= 10 AND p.doc_id = d.doc_id // 10 LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec_id, label, embedding): one vector for each of the first nodes."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "label", "embedding")


def star_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, title, sort_order): region, nation, customer, order."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    level = lambda name, prefix, c, parent, title: read(spark, sf_dir, name).select(key(prefix, c).alias("id"), parent.alias("parent_id"), F.col(title).cast("string").alias("title"), F.col(c).cast("long").alias("sort_order"))
    return (
        level("region", "R", "r_regionkey", F.lit(None).cast("string"), "r_name")
        .unionByName(level("nation", "N", "n_nationkey", key("R", "n_regionkey"), "n_name"))
        .unionByName(level("customer", "C", "c_custkey", key("N", "c_nationkey"), "c_name"))
        .unionByName(level("orders", "O", "o_orderkey", key("C", "o_custkey"), "o_orderpriority"))
    )


STAR_SQL = """
star AS (
  SELECT 'R' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS title, r_regionkey::BIGINT AS sort_order FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, n_nationkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, c_custkey FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, o_orderpriority, o_orderkey FROM orders
)"""

#: What event types stand for in the change log.
EVENT_CHANGES = {"click": "summary_regenerated", "purchase": "summary_approved", "signup": "summary_edited", "view": "text_updated", "error": "removed"}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: (change_id, node_id, reg_key, created_at, change_type) of events."""
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_CHANGES.items() for x in kv])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_id"), F.concat(F.lit("sec-u"), F.col("user_id") % 7, F.lit("-"), F.col("user_id")).alias("node_id"),
        F.concat(F.lit("u"), F.col("user_id") % 7).alias("reg_key"), F.col("ts").alias("created_at"), kinds[F.col("event_type")].alias("change_type"),
    )


CHANGES_SQL = """
changes AS (
  SELECT event_id AS change_id, 'sec-u' || (user_id % 7) || '-' || user_id AS node_id, 'u' || (user_id % 7) AS reg_key, ts AS created_at,
    CASE event_type WHEN 'click' THEN 'summary_regenerated' WHEN 'purchase' THEN 'summary_approved' WHEN 'signup' THEN 'summary_edited'
      WHEN 'view' THEN 'text_updated' WHEN 'error' THEN 'removed' END AS change_type
  FROM events
)"""

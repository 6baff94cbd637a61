"""Named queries over the driver tables, with the same in DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.functions import values as V
from weftline.operators import batch, changes, context, documents, hybrid, lexical, links, quality, sampling, tree, vector, writes
from weftline.plans import search_sql
from weftline.sources import tables as S
from weftline.sources.shared import staged

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
ASKED = "the and idiot"
WORDS = ["that", "tion"]


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function under its name, with its SQL."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return S.read(spark, d, name)


def _r(c, n: int = 6):
    return F.round(c, n)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(F.col(c).cast("double"), 4) for c in columns})


# --- scans, projections, predicates -------------------------------------------------------------------------------


@query(f"WITH {S.NODES_SQL} SELECT id, reg_key, citation, jurisdiction_level, parent_id, is_public, sort_order, summary_status FROM nodes")
def scan_nodes(spark, d):
    return S.nodes(spark, d).select("id", "reg_key", "citation", "jurisdiction_level", "parent_id", "is_public", "sort_order", "summary_status")


@query(f"WITH {S.NODES_SQL} SELECT id, sort_order FROM nodes WHERE reg_key = 'src3'")
def scan_document(spark, d):
    return S.nodes(spark, d).filter("reg_key = 'src3'").select("id", "sort_order")


@query(f"WITH {S.NODES_SQL} SELECT id, CASE WHEN is_public THEN ai_summary END AS summary, is_public FROM nodes WHERE summary_status <> 'rejected'")
def visible_rows(spark, d):
    rows = S.nodes(spark, d).filter("summary_status <> 'rejected'")
    return rows.select("id", F.when(F.col("is_public"), F.col("ai_summary")).alias("summary"), "is_public")


@query(f"WITH {S.NODES_SQL} SELECT reg_key, count(*) FILTER (summary_status = 'pending') AS pending, count(*) FILTER (summary_status = 'approved') AS approved, count(*) FILTER (summary_status = 'rejected') AS rejected FROM nodes GROUP BY reg_key")
def status_counts(spark, d):
    one = lambda s: F.count_if(F.col("summary_status") == s).alias(s)
    return S.nodes(spark, d).groupBy("reg_key").agg(one("pending"), one("approved"), one("rejected"))


@query(f"WITH {S.NODES_SQL} SELECT n.id, coalesce(s.n, 0) = 0 AND n.ai_summary IS NOT NULL AS summary_visible FROM nodes n LEFT JOIN (SELECT reg_key, count(*) AS n FROM nodes WHERE summary_status = 'rejected' GROUP BY 1) s USING (reg_key)")
def gated_summaries(spark, d):
    rows = S.nodes(spark, d)
    pending = rows.filter("summary_status = 'rejected'").groupBy("reg_key").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(pending, "reg_key", "left").select("id", ((F.coalesce("n", F.lit(0)) == 0) & F.col("ai_summary").isNotNull()).alias("summary_visible"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, length(html) AS n_chars, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_fields(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.length("html").cast("long").alias("n_chars"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# --- text, dates, hashes, JSON ------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), chr(160), ' '), '\s+', ' ', 'g')) AS plain FROM pages")
def strip_pages(spark, d):
    return _t(spark, d, "pages").select("page_id", T.strip_html_plain(F.col("html")).alias("plain"))


@query("SELECT page_id, md5(regexp_replace(lower(regexp_replace(html, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g')) AS text_key FROM pages")
def letters_key(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.letters_digits(F.col("html")).cast("binary")).alias("text_key"))


@query(r"SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS n FROM pages".replace('\\"', '"'))
def escaped_pages(spark, d):
    return _t(spark, d, "pages").select("page_id", F.length(T.escape_html(F.col("html"))).cast("long").alias("n"))


@query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::BIGINT AS words FROM documents")
def word_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT doc_id, sha256('voyage' || chr(0) || text) AS hash FROM documents")
def content_hashes(spark, d):
    return _t(spark, d, "documents").select("doc_id", V.content_hash(F.col("text"), "voyage").alias("hash"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def title_slugs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query()
def summary_texts(spark, d):
    text = F.col("text")
    over = T.overview(text, 2, 30)
    cut = T.honest_cut(text, 400)
    return _t(spark, d, "documents").select("doc_id", T.first_sentence(text).alias("first"), T.cap_at_sentence(text, 300).alias("capped"), over["overview"].alias("overview"), over["cut"].alias("overview_cut"), cut["text"].alias("honest"), T.snippet(text, 120).alias("snippet"))


@query("SELECT event_id, strftime(timezone('America/Denver', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events")
def civil_days(spark, d):
    return _t(spark, d, "events").select("event_id", V.civil_day(F.col("ts")).cast("string").alias("day"))


@query("SELECT o_orderkey, CASE month(o_orderdate) WHEN 1 THEN 'Jan.' WHEN 2 THEN 'Feb.' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'Aug.' WHEN 9 THEN 'Sept.' WHEN 10 THEN 'Oct.' WHEN 11 THEN 'Nov.' ELSE 'Dec.' END || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS day FROM orders")
def order_dates(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", V.ap_date(F.col("o_orderdate")).alias("day"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def event_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_type, md5(string_agg(k, ',' ORDER BY k)) AS checksum FROM (SELECT event_type, event_id::VARCHAR AS k FROM events) GROUP BY event_type")
def checksums(spark, d):
    """Order-independent: ids are sorted before hashing. A digest of sorted ids can't be made of parts, so each type's ids go through one
    digest, but a batch at a time, after a sort that spills: none is held whole."""
    return sampling.sorted_digests(_t(spark, d, "events").select("event_type", F.col("event_id").cast("string").alias("k")), "event_type", "k")


# --- joins --------------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark, d):
    """Dimensions are 25 and 5 rows by definition."""
    dims = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _t(spark, d, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), _r(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark, d):
    big = _t(spark, d, "orders").filter("o_totalprice > 100000")
    return _t(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b USING (k)")
def full_outer(spark, d):
    a = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = _t(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full_outer")


@query("SELECT e.event_id, min(r.ts) AS reviewed_at FROM events e LEFT JOIN events r ON r.user_id = e.user_id AND r.event_type = 'purchase' AND r.ts >= e.ts AND r.ts < e.ts + INTERVAL 24 HOURS WHERE e.event_type = 'click' GROUP BY e.event_id")
def interval_join(spark, d):
    rows = _t(spark, d, "events")
    clicks = rows.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return changes.first_after(clicks, rows.filter("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts", "ts", 24, "reviewed_at").select("event_id", "reviewed_at")


@query("SELECT o.o_orderkey, max(l.l_extendedprice) AS best FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY 1")
def best_child_price(spark, d):
    best = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("best"))
    return _t(spark, d, "orders").select("o_orderkey").join(best, "o_orderkey", "left")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_discount > 0.09) AS high FROM lineitem GROUP BY ALL")
def line_summary(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), _r(F.sum(price), 2).alias("revenue"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.bool_or(F.col("l_discount") > 0.09).alias("high"),
    )


@query("SELECT event_type, count(*) AS n, grouping(event_type)::INT AS is_total FROM events GROUP BY ROLLUP (event_type)")
def rollup_events(spark, d):
    return _t(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("int").alias("is_total"))


@query("SELECT max_n AS furthest, count(*) AS users FROM (SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS max_n FROM events GROUP BY 1) GROUP BY 1")
def funnel(spark, d):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)
    return sampling.funnel(_t(spark, d, "events").select(F.col("user_id").alias("session"), step.alias("step"))).withColumnRenamed("sessions", "users")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def pivot_events(spark, d):
    rows = _t(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1)))
    return rows.select("user_id", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("view", "views"), ("click", "clicks"), ("error", "errors"))])


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    """Digests are grouped, not texts; only one text of each repeated digest is read again."""
    rows = _t(spark, d, "documents").select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    twice = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1 and digest is not null")
    return rows.join(twice.drop("digest"), "doc_id").select("text", "n")


@query("SELECT user_id, sum(CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN 1 ELSE 0 END)::BIGINT AS last_day, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 3")
def rate_counts(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).alias("last_day"), F.count(F.lit(1)).alias("n")).filter("n > 3")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def proportional_split(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(F.col("l_extendedprice") / F.sum("l_extendedprice").over(W.partitionBy("l_orderkey"))).alias("share"))


@query("SELECT p_brand, string_agg(p_type, '|' ORDER BY p_type, p_partkey) AS types FROM part WHERE p_size > 45 GROUP BY 1")
def ordered_concat(spark, d):
    row = F.sort_array(F.collect_list(F.struct("p_type", "p_partkey")))
    return _t(spark, d, "part").filter("p_size > 45").groupBy("p_brand").agg(row.alias("r")).select("p_brand", F.array_join("r.p_type", "|").alias("types"))


# --- windows, top-k, sets -----------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def top_per_group(spark, d):
    over = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, d, "customer").withColumn("rn", F.row_number().over(over)).filter("rn <= 5").select("c_nationkey", "c_custkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, d):
    return _t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_of_kind(spark, d):
    over = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _t(spark, d, "events").withColumn("n", F.row_number().over(over).cast("long")).filter("n = 1").select("user_id", "event_id", "n")


@query("SELECT user_id, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOURS AS gap FROM events")
def gaps(spark, d):
    over = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("user_id", "event_id", ((F.col("ts") - F.lag("ts").over(over)) > F.expr("interval 6 hours")).alias("gap"))


@query("SELECT user_id, after, count(*) AS n_hidden FROM (SELECT user_id, event_type = 'purchase' AS shown, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) WHERE NOT shown GROUP BY ALL")
def hidden_rows(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("shown"))
    return tree.hidden_after(rows, "user_id", "event_id", "shown")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(spark, d, "orders").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersection(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT k, sum(n)::BIGINT AS n FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, -count(*) FROM events WHERE event_type = 'click' GROUP BY 1) GROUP BY 1 HAVING sum(n) > 0")
def multiset_difference(spark, d):
    rows = _t(spark, d, "events")
    left = rows.filter("event_type = 'view'").select(F.col("user_id").alias("k")).exceptAll(rows.filter("event_type = 'click'").select("user_id"))
    return left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# --- hierarchy ----------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {S.STAR_SQL}, up AS (
  SELECT s.id, p.id AS anc, p.parent_id, p.title, 1 AS k FROM star s JOIN star p ON p.id = s.parent_id
  UNION ALL SELECT up.id, p.id, p.parent_id, p.title, k + 1 FROM up JOIN star p ON p.id = up.parent_id WHERE k < 12)
SELECT s.id, string_agg(up.title, ' › ' ORDER BY k DESC) FILTER (up.parent_id IS NOT NULL) AS path FROM star s LEFT JOIN up ON up.id = s.id GROUP BY s.id""")
def breadcrumbs(spark, d):
    return tree.breadcrumbs(S.star_tree(spark, d).withColumn("citation", F.col("id")))


@query(f"""WITH RECURSIVE {S.STAR_SQL}, t AS (SELECT id, 0::BIGINT AS depth FROM star WHERE parent_id IS NULL UNION ALL SELECT s.id, depth + 1 FROM star s JOIN t ON s.parent_id = t.id) SELECT id, depth FROM t""")
def tree_depths(spark, d):
    return tree.depths(S.star_tree(spark, d))


@query(f"""WITH RECURSIVE {S.STAR_SQL}, t AS (SELECT id, NULL::VARCHAR AS group_id FROM star WHERE parent_id IS NULL UNION ALL SELECT s.id, coalesce(t.group_id, s.id) FROM star s JOIN t ON s.parent_id = t.id) SELECT id, group_id FROM t""")
def tree_groups(spark, d):
    return tree.top_groups(S.star_tree(spark, d))


@query(f"""WITH RECURSIVE {S.STAR_SQL}, t AS (
  SELECT f.id AS focus_id, s.id, 1 AS depth, [(s.sort_order, s.id)] AS way FROM star f JOIN star s ON s.parent_id = f.id WHERE f.id LIKE 'N%'
  UNION ALL SELECT t.focus_id, s.id, depth + 1, list_append(way, (s.sort_order, s.id)) FROM t JOIN star s ON s.parent_id = t.id)
SELECT focus_id, id, depth, row_number() OVER (PARTITION BY focus_id ORDER BY way) AS position FROM t""")
def tree_descendants(spark, d):
    rows = S.star_tree(spark, d)
    return tree.descendants(rows, rows.filter("id like 'N%'")).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {S.NODES_SQL} SELECT parent_id, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1")
def child_counts(spark, d):
    return tree.children(S.nodes(spark, d)).select("parent_id", "n_children")


@query(f"WITH {S.NODES_SQL} SELECT id FROM nodes n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id)")
def orphan_nodes(spark, d):
    return tree.orphans(S.nodes(spark, d)).select("id")


# --- search -------------------------------------------------------------------------------------------------------

_INDEX_SQL = S.NODES_SQL + r""", words AS (
  SELECT id, sort_order, list_filter(regexp_split_to_array(lower(citation), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a,
    list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS b,
    list_filter(regexp_split_to_array(lower(regexp_replace(full_text, '<[^>]+>', ' ', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS c FROM nodes
), tf AS (
  SELECT id, sort_order, len(a) + len(b) + len(c) AS n, Q.w, len(list_filter(a, lambda x: x = Q.w)) AS na, len(list_filter(b, lambda x: x = Q.w)) AS nb, len(list_filter(c, lambda x: x = Q.w)) AS nc
  FROM words, (SELECT unnest(['the', 'idiot']) AS w) Q
)"""


@query(f"WITH {_INDEX_SQL} SELECT id, round(sum(na * 1.0 + nb * 0.4 + nc * 0.2) / (1 + ln(max(n))), 6) AS score FROM tf GROUP BY id HAVING min(na + nb + nc) > 0")
def keyword_matches(spark, d):
    asked = lexical.Query([[("the",)], [("idiot",)]])
    found = lexical.matches(lexical.index(S.nodes(spark, d), asked.words()), asked)
    return found.select("id", _r("score").alias("score"))


@query(r"SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])idiot([^\p{L}\p{N}]|$)') OR regexp_matches(lower(text), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)')")
def match_count(spark, d):
    asked = lexical.user_query('idiot or "of the"')
    table = lexical.index(S.nodes(spark, d).withColumn("citation", F.lit("")).withColumn("title", F.lit("")), asked.words())
    return lexical.matches(table, asked).agg(F.count(F.lit(1)).alias("n"))


_STRUCTURED = "(idiot | clown | license) & !(redistribution <-> and) & (of <-> the | in <2> of)"


@query(f"""WITH {S.NODES_SQL}, l AS (
  SELECT id, list_concat(list_concat({search_sql._split("citation")}, {search_sql._split("title")}), {search_sql._split("regexp_replace(coalesce(full_text, ''), '<[^>]+>', ' ', 'g')")}) AS w,
    {search_sql._split("citation")} AS a, {search_sql._split("title")} AS b FROM nodes
), p AS (SELECT *, list_filter(range(1, len(w)), lambda i: w[i] = 'redistribution' AND w[i + 1] = 'and') AS x, list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the') AS y, list_filter(range(1, len(w) - 1), lambda i: w[i] = 'in' AND w[i + 2] = 'of') AS z,
  list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('idiot', 'clown', 'license', 'of', 'the', 'in')) AS hits FROM l
) SELECT id, round(list_sum(list_transform(hits, lambda i: CASE WHEN i <= len(a) THEN 1.0::DOUBLE WHEN i <= len(a) + len(b) THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END)) / (1 + ln(len(w)::DOUBLE)), 6) AS score
FROM p WHERE (list_contains(w, 'idiot') OR list_contains(w, 'clown') OR list_contains(w, 'license')) AND len(x) = 0 AND (len(y) > 0 OR len(z) > 0)""")
def structured_matches(spark, d):
    """A structured query: brackets, not, neighbours and distances."""
    return lexical.found_by(lexical.index(S.nodes(spark, d)), _STRUCTURED).select("id", _r("score").alias("score"))


@query()
def stemmed_search(spark, d):
    """Words by their stems, held against brute force by a test."""
    return _rounded(lexical.search(S.texts(spark, d), "licensing or idiots", 25, by_stem=True), "score").select("id", "score", "headline")


@query(search_sql.keyword([["the"], ["of"]], ["clown"], 25))
def keyword_search(spark, d):
    rows = S.nodes(spark, d)
    return _rounded(lexical.search(rows, "the of -clown", 25, paths=tree.breadcrumbs(rows)), "score")


@query(search_sql.keyword([["the"], ["and"], ["of"]], [], 10, where="reg_key = 'src1'", paths=False))
def document_search(spark, d):
    rows = S.nodes(spark, d).filter("reg_key = 'src1'")
    return _rounded(lexical.search(rows, "the and of", 10), "score")


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id::VARCHAR AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id::VARCHAR LIMIT 20""")
def vector_search(spark, d):
    rows = S.vectors(spark, d)
    q = rows.filter("vec_id = 0").select("embedding").first()["embedding"]
    found = vector.nearest(rows.withColumn("is_basis", F.lit(False)), list(q), 20)
    return found.select("id", _r(F.col("score").cast("double"), 4).alias("score"))


@query("""SELECT id, neighbor_id, round(score, 4) AS score, rank FROM (
  SELECT a.vec_id::VARCHAR AS id, b.vec_id::VARCHAR AS neighbor_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id::VARCHAR)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label <> b.label) WHERE rank <= 5""")
def neighbour_graph(spark, d):
    found = vector.neighbours(S.vectors(spark, d), 5, family="label")
    return found.select("id", "neighbor_id", _r(F.col("score").cast("double"), 4).alias("score"), "rank")


@query()
def neighbour_index(spark, d):
    """The same over inverted lists; approximate, so held against ``neighbour_graph`` by a test."""
    rows = S.vectors(spark, d)
    index = vector.VectorIndex.fit(rows, 5, family="label")
    return index.neighbours(spark).select("id", "neighbor_id", _r(F.col("score").cast("double"), 4).alias("score"), "rank")


def _paths(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Headings above the rows of a page of results; no others are walked."""
    return lambda ids: tree.breadcrumbs(rows, rows.join(F.broadcast(ids), "id", "left_semi"))


def _hybrid(spark: SparkSession, d: str, text: str, n: int = 20) -> DataFrame:
    rows = S.nodes(spark, d)
    vectors = _t(spark, d, "embeddings").join(rows.select("id", "doc_id"), F.col("vec_id") == F.col("doc_id")).select("id", "vec_id", "embedding")
    q = vectors.filter("vec_id = 7").select("embedding").first()["embedding"]
    return hybrid.search(rows, vectors, text, list(q), n, paths=_paths(rows), texts=S.texts(spark, d))


@query(search_sql.hybrid([["idiot"], ["clown"]], short=True, long=False, federal=False, state=False))
def hybrid_short(spark, d):
    return _rounded(_hybrid(spark, d, "idiot clown"), "score", "fused")


@query(search_sql.hybrid([["which"], ["federal"], ["rule"], ["is"], ["that"], ["of"], ["the"], ["and", "in"], ["colorado"], ["state"]], short=False, long=True, federal=True, state=True))
def hybrid_sentence(spark, d):
    return _rounded(_hybrid(spark, d, "which federal rule is that of the and or in colorado state"), "score", "fused")


@query(search_sql.completed([["the"], ["idiot"]], short=True, long=False))
def completed_list(spark, d):
    hits = _hybrid(spark, d, "the idiot").select("id", "position")
    return hybrid.complete_lists(hits, S.nodes(spark, d))


# --- changes ------------------------------------------------------------------------------------------------------

_CLASSED = S.CHANGES_SQL + """, regen AS (
  SELECT c.*, (SELECT min(r.created_at) FROM changes r WHERE r.node_id = c.node_id AND r.change_type IN ('summary_approved', 'summary_edited') AND r.created_at >= c.created_at AND r.created_at < c.created_at + INTERVAL 24 HOURS) AS reviewed_at
  FROM changes c WHERE change_type = 'summary_regenerated'
), classed AS (
  SELECT change_id, node_id, reg_key, created_at, change_type FROM changes WHERE change_type IN ('text_updated', 'removed')
  UNION ALL SELECT change_id, node_id, reg_key, created_at, change_type FROM changes c WHERE change_type IN ('summary_approved', 'summary_edited') AND NOT EXISTS (SELECT 1 FROM regen g WHERE g.node_id = c.node_id AND g.reviewed_at = c.created_at)
  UNION ALL SELECT change_id, node_id, reg_key, created_at, CASE WHEN reviewed_at IS NULL THEN 'summary_rewritten_reviewed_later'
    WHEN EXISTS (SELECT 1 FROM changes r WHERE r.node_id = g.node_id AND r.created_at = g.reviewed_at AND r.change_type = 'summary_edited') THEN 'summary_rewritten_corrected' ELSE 'summary_rewritten_reviewed' END FROM regen g
), counts AS (
  SELECT strftime(timezone('America/Denver', timezone('UTC', created_at)), '%Y-%m-%d') AS day, reg_key, change_type,
    count(DISTINCT CASE WHEN change_type = 'removed' THEN change_id::VARCHAR ELSE node_id END) AS provision_count, max(created_at) AS latest FROM classed GROUP BY ALL
)"""


@query(f"WITH {_CLASSED} SELECT day, reg_key, change_type, provision_count, latest FROM counts")
def changelog_counts(spark, d):
    return changes.daily_counts(changes.classified(S.changes(spark, d))).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {_CLASSED} SELECT day, reg_key, coalesce(sum(provision_count) FILTER (change_type = 'text_updated'), 0)::BIGINT AS text_updated, coalesce(sum(provision_count) FILTER (change_type = 'removed'), 0)::BIGINT AS removed,
  coalesce(sum(provision_count) FILTER (change_type IN ('summary_approved', 'summary_edited')), 0)::BIGINT AS reviewed, coalesce(sum(provision_count) FILTER (change_type = 'summary_edited'), 0)::BIGINT AS corrected,
  coalesce(sum(provision_count) FILTER (change_type IN ('summary_rewritten_reviewed', 'summary_rewritten_corrected')), 0)::BIGINT AS rewritten_reviewed,
  coalesce(sum(provision_count) FILTER (change_type = 'summary_rewritten_reviewed_later'), 0)::BIGINT AS rewritten_reviewed_later FROM counts GROUP BY day, reg_key""")
def changelog_lines(spark, d):
    out = changes.lines(changes.daily_counts(changes.classified(S.changes(spark, d))))
    return out.select(F.col("day").cast("string").alias("day"), "reg_key", "text_updated", "removed", "reviewed", "corrected", "rewritten_reviewed", "rewritten_reviewed_later")


_VERSIONS = " old AS (SELECT doc_id::VARCHAR AS id, text AS full_text FROM documents WHERE doc_id % 11 <> 1), new AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN '<b>' || text || '</b>' WHEN doc_id % 5 = 0 THEN text || ' x' ELSE text END AS full_text FROM documents WHERE doc_id % 13 <> 2 OR doc_id % 11 = 1)"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the corpus: some rows go, some come, some change, some get markup; every document is in at least one."""
    docs = _t(spark, d, "documents")
    now = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<b>"), "text", F.lit("</b>"))).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    key = F.col("doc_id").cast("string").alias("id")
    return docs.filter("doc_id % 11 <> 1").select(key, F.col("text").alias("full_text")), docs.filter("doc_id % 13 <> 2 or doc_id % 11 = 1").select(key, now.alias("full_text"))


@query(f"""WITH {_VERSIONS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'obsolete' WHEN o.full_text = n.full_text THEN 'identical'
  WHEN regexp_replace(lower(regexp_replace(o.full_text, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(regexp_replace(n.full_text, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') THEN 'markup' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON n.id = o.id""")
def version_difference(spark, d):
    return changes.difference(*_versions(spark, d))


@query(f"WITH {_VERSIONS} SELECT o.id, md5(o.full_text) AS hash FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.id = o.id) UNION ALL SELECT id, md5(full_text) FROM new")
def upserted(spark, d):
    old, new = _versions(spark, d)
    return changes.upsert(old, new, ["id"]).select("id", F.md5(F.col("full_text").cast("binary")).alias("hash"))


@query(f"WITH {_VERSIONS} SELECT n.id, greatest(1, ceil(length(n.full_text) / 1000.0))::BIGINT AS n_chunks, o.id IS NULL OR o.full_text <> n.full_text AS embed FROM new n LEFT JOIN old o ON o.id = n.id")
def embedding_plan(spark, d):
    """Chunks of 1,000 characters of two versions; a text with any chunk that is new, other or left over is embedded again."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("full_text") / 1000).cast("int") - 1))
    cut = lambda df: df.select("id", "full_text", F.explode(steps).alias("chunk_index"))
    chunk = lambda df: cut(df).select("id", "chunk_index", V.content_hash(F.substring("full_text", F.col("chunk_index") * 1000 + 1, F.lit(1000)), "m").alias("text_hash"))
    old, new = _versions(spark, d)
    return changes.embedding_plan(chunk(new), chunk(old))


# --- documents, links, quality ------------------------------------------------------------------------------------


@query(search_sql.CHUNKS)
def chunks(spark, d):
    return documents.chunk_texts(S.nodes(spark, d), "voyage").select("id", "chunk_index", F.length("text").alias("n_chars"), "text_hash")


@query()
def document_outlines(spark, d):
    lines = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return documents.outlines(lines)


@query("""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def page_links(spark, d):
    found = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query(f"""WITH {S.NODES_SQL} SELECT id FROM nodes WHERE length(full_text) >= 50 AND (length(full_text) - length(replace(full_text, substr(full_text, 1, 50), ''))) / 50 >= 3""")
def repeated_blocks(spark, d):
    return S.nodes(spark, d).filter(quality.repeated_block(F.col("full_text"))).select("id")


@query(search_sql.quality())
def quality_suite(spark, d):
    return quality.suite(S.nodes(spark, d))


@query(f"WITH {S.NODES_SQL} SELECT min(id) AS id, count(*) AS n FROM nodes GROUP BY reg_key, title HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return S.nodes(spark, d).groupBy("reg_key", "title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "n")


@query("SELECT bucket, count(*) AS n FROM (SELECT unnest(CASE WHEN len(b) > 0 THEN b ELSE ['other'] END) AS bucket FROM (SELECT list_filter([CASE WHEN regexp_matches(lower(text), 'license') THEN 'license' END, CASE WHEN regexp_matches(lower(text), 'idiot|clown') THEN 'rude' END, CASE WHEN regexp_matches(text, '[|]') THEN 'table' END], lambda x: x IS NOT NULL) AS b FROM documents)) GROUP BY 1")
def reason_buckets(spark, d):
    rows = _t(spark, d, "documents").select(F.col("text").alias("reason"))
    return sampling.buckets(rows, {"license": "license", "rude": "idiot|clown", "table": "[|]"})


# --- samples ------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT source AS stratum, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, size * 100 / (sum(size) OVER ()) AS x FROM (SELECT stratum, size FROM s)),
f AS (SELECT stratum, size, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, stratum) AS o, 100 - sum(floor(x)) OVER () AS l FROM e)
SELECT stratum, size, least(size, f + CASE WHEN o <= l THEN 1 ELSE 0 END)::BIGINT AS take FROM f""")
def sample_allocation(spark, d):
    sizes = _t(spark, d, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return sampling.allocation(sizes, 100).withColumn("take", F.col("take").cast("long"))


@query(f"""WITH {S.NODES_SQL}, s AS (SELECT reg_key, count(*) AS size FROM nodes GROUP BY 1), e AS (SELECT *, size * 100 / (sum(size) OVER ()) AS x FROM s),
f AS (SELECT reg_key, size, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, reg_key) AS o, 100 - sum(floor(x)) OVER () AS l FROM e),
r AS (SELECT id, reg_key, row_number() OVER (PARTITION BY reg_key ORDER BY md5('7:' || id), id) AS r FROM nodes)
SELECT id, reg_key FROM r JOIN f USING (reg_key) WHERE r <= least(size, f + CASE WHEN o <= l THEN 1 ELSE 0 END)""")
def stratified_sample(spark, d):
    rows = S.nodes(spark, d).select("id", "reg_key")
    return sampling.stratified(rows, "reg_key", 100, seed=7)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(q, text, vector): every text of ``benchmark`` as a question; its vector is a node's, moved a little, so that node should be found."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: x + F.lit(0.001) * (((i + 1) * 7 + F.col("q")) % 11 - 5))
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text").join(vectors, "q").select("q", "text", moved.alias("vector"))


def _batch(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    rows = S.nodes(spark, d)
    vectors = _t(spark, d, "embeddings").join(rows.select("id", "doc_id"), F.col("vec_id") == F.col("doc_id")).select("id", "embedding")
    return batch.search(rows, vectors, questions, paths=_paths(rows), texts=S.texts(spark, d))


def _expected(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    own = S.nodes(spark, d).select(F.col("doc_id").alias("q"), F.array("id").alias("expect"))
    return questions.select("q", "text").join(own, "q").select("q", "text", "expect", F.array(F.lit("sec-src9-")).alias("forbid"), F.lit(10).alias("top_n"))


@query(search_sql.BATCH)
def search_batch(spark, d):
    """All questions through all stages of the hybrid search in one plan."""
    found = _batch(spark, d, _questions(spark, d))
    return _rounded(found, "score", "fused").select("q", "position", "id", "keyword_hit", "is_basis", "score", "fused", "path")


@query(search_sql.EVALUATION)
def search_evaluation(spark, d):
    asked = _questions(spark, d)
    return batch.evaluated(_batch(spark, d, asked), _expected(spark, d, asked)).select("q", "expected_at", "forbidden", "passed")


@query()
def search_margins(spark, d):
    """How near each question is to another outcome; held against trying shifts one by one in a test."""
    asked = _questions(spark, d)
    return batch.evaluated(_batch(spark, d, asked), _expected(spark, d, asked)).select("q", _r("margin").alias("margin"), "at_least", "thin")


@query()
def search_stability(spark, d):
    """Each question with its vector and four moved ones."""
    asked = _questions(spark, d)
    runs = batch.perturbed(asked, 5, 0.02).select("q", "question", "run", "text", "vector")
    found = staged(_batch(spark, d, runs.select("q", "text", "vector")), "stability")
    expected = _expected(spark, d, asked).select(F.col("q").alias("question"), "expect", "forbid", "top_n")
    verdicts = batch.evaluated(found, runs.select("q", "question", "text").join(expected, "question"))
    return batch.stability(found, verdicts, runs).withColumns({c: _r(c) for c in ("least_margin", "greatest_margin")})


# --- labels, context, writes --------------------------------------------------------------------------------------


@query(f"WITH {S.NODES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY reg_key ORDER BY sort_order, id) AS r, count(*) OVER (PARTITION BY reg_key) AS size FROM nodes) SELECT reg_key, string_agg(id, ' ' ORDER BY r) AS ids, max(greatest(size - 5, 0))::BIGINT AS n_more FROM r WHERE r <= 5 GROUP BY 1")
def capped_groups(spark, d):
    found = context.capped_groups(S.nodes(spark, d).select("id", "reg_key", "sort_order"), "reg_key", ["sort_order", "id"], 5)
    return found.select("reg_key", F.array_join("ids", " ").alias("ids"), F.col("n_more").cast("long").alias("n_more"))


@query("SELECT event_type AS reg_key, count(*) || ':' || max(event_id) AS version FROM events GROUP BY 1")
def version_keys(spark, d):
    return context.version_key(_t(spark, d, "events").select(F.col("event_type").alias("reg_key"), F.col("event_id").alias("updated_at")))


@query("SELECT p_partkey, '40 CFR ' || p_size || '.' || p_partkey AS citation, CASE WHEN p_size % 2 = 0 THEN 'Regulation ' || p_size ELSE 'SRC' || p_size END AS name FROM part")
def labels(spark, d):
    section = F.concat(F.lit("§ "), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    key = F.concat(F.when(F.col("p_size") % 2 == 0, "reg").otherwise("src"), F.col("p_size").cast("string"))
    return _t(spark, d, "part").select("p_partkey", L.federal_citation(F.lit("40"), F.lit("60"), section).alias("citation"), L.display_name(key).alias("name"))


@query(f"WITH {_VERSIONS} SELECT change_type, count(*) AS n FROM (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.full_text = n.full_text THEN NULL WHEN regexp_replace(lower(regexp_replace(o.full_text, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(regexp_replace(n.full_text, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g') THEN 'links_updated' ELSE 'text_updated' END AS change_type FROM old o FULL JOIN new n ON n.id = o.id) WHERE change_type IS NOT NULL GROUP BY 1")
def change_capture(spark, d):
    return writes.text_changes(*_versions(spark, d), F.current_timestamp()).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.CHANGES_SQL} SELECT change_id, CASE WHEN reg_key IN ('u1', 'u2') AND created_at >= TIMESTAMP '2024-01-15' AND change_type IN ('text_updated', 'removed') THEN 'transcription_corrected' ELSE change_type END AS change_type FROM changes")
def import_finalized(spark, d):
    versions = spark.createDataFrame([("u1", "v"), ("u2", "v"), ("u3", "v")], "key string, version string")
    now = spark.createDataFrame([("u1", "v"), ("u2", "v"), ("u3", "w")], "key string, version string")
    return writes.finalized(S.changes(spark, d), versions, now, F.lit("2024-01-15").cast("timestamp")).select("change_id", "change_type")


@query(f"WITH {S.NODES_SQL} SELECT p.id, p.summary_status, CASE WHEN p.summary_status = 'pending' THEN 'approved' ELSE p.summary_status END AS after FROM nodes p")
def verdicts_applied(spark, d):
    rows = S.nodes(spark, d).withColumn("reviewed_by", F.lit(None).cast("string")).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    given = rows.select("id", F.lit("approve").alias("verdict"), F.lit(None).cast("string").alias("summary"))
    after, _ = writes.verdicts(rows, given, "x", F.current_timestamp())
    return rows.select("id", "summary_status").join(after.select("id", F.col("summary_status").alias("after")), "id")


@query()
def prompts(spark, d):
    rows = S.nodes(spark, d)
    found = context.prompts(rows, rows.filter("is_public").select("id"), texts=S.texts(spark, d))
    return found.select("id", "page", F.length("prompt").alias("n_chars"), F.sha2(F.col("prompt").cast("binary"), 256).alias("hash"))


@query(r"""SELECT source, count(*) AS n, count(*) FILTER (kept) AS kept FROM (SELECT source, regexp_matches(text, '[.!?)\]"]\*?\s*\z') AS kept FROM documents) GROUP BY 1""")
def cut_off_texts(spark, d):
    rows = _t(spark, d, "documents").select("source", (~T.looks_cut_off(F.col("text"))).alias("kept"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The entry query: keyword search with headings and highlights."""
    return keyword_search(spark, d)

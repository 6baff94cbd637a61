"""Context of a node for prompts and readers: ancestors and descendants as text within budgets, lists of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import tree
from weftline.sources.shared import staged


def stripped(texts: DataFrame) -> DataFrame:
    """(id, citation, title, plain, words, line_size): what blocks are made of, a row a node, written once. What follows reads the columns that
    it needs, so no text is stripped twice, and lengths are joined before texts are. ``line_size``: characters of an ancestor's line."""
    plain = texts.select("id", "citation", "title", T.strip_html(F.col("full_text")).alias("plain"))
    words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)  # parted by one space each
    return staged(plain.select("*", words.alias("words"), F.length(_ancestor_line()).alias("line_size")), "stripped")


def _ancestor_line() -> Column:
    return F.concat_ws(" ", "citation", F.concat("title", F.lit(":")), "plain")


def ancestor_block(nodes: DataFrame, start: DataFrame, budget: int = 2000, least: int = 80, texts: DataFrame | None = None) -> DataFrame:
    """(id, block): "citation title: text" of the ancestors from the top. The nearest get their text first; the farthest is cut to
    what is left of ``budget`` characters, and dropped where that is under ``least``. ``texts``: the nodes' ``stripped`` texts, if they are there.

    Lengths decide which ancestors are kept, and no more than ``budget`` characters of these are joined."""
    texts = stripped(nodes) if texts is None else texts
    up = tree.ancestors(nodes, start).join(texts.select(F.col("id").alias("ancestor_id"), "line_size"), "ancestor_id")
    near = W.partitionBy("id").orderBy("distance")
    up = up.withColumn("before", F.coalesce(F.sum("line_size").over(near.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("before")
    up = up.filter(left >= F.least(F.lit(least), F.col("line_size"))).select("id", "ancestor_id", "distance", left.alias("left"))
    # a character more than the budget shows whether the line is longer
    kept = up.join(texts.select(F.col("id").alias("ancestor_id"), F.substring(_ancestor_line(), 1, budget + 1).alias("line")), "ancestor_id")
    kept = kept.repartition("id")  # lines are cut where their blocks are: ancestors can all be in the first file's task
    kept = kept.withColumn("line", T.honest_cut(F.col("line"), budget)["text"])
    kept = kept.withColumn("line", F.when(F.length("line") <= F.col("left"), F.col("line")).otherwise(F.concat(F.expr("substring(line, 1, left)"), F.lit("…"))))
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(-F.col("distance"), "line"))).alias("up")).select("id", F.array_join("up.line", "\n").alias("block"))


#: Lines of one page of a block.
PAGE_LINES = 2000
#: Words of a row without a title that stand for it in an outline.
OPENING_WORDS = 12


def descendant_block(nodes: DataFrame, focus: DataFrame, most_words: int = 3000, page_lines: int = PAGE_LINES, texts: DataFrame | None = None) -> DataFrame:
    """(id, page, outline, block): the text of all below a node in reading order; beyond ``most_words`` its outline of citations and titles, or
    opening words where there is no title, and a last line that says how many bodies were left out.

    Words are summed before any text is gathered, so only blocks under the limit gather texts, and a page has ``page_lines`` lines at most:
    the outline of a node with millions below it is many rows, none of which is large. A title isn't repeated before a text that
    begins with it. ``texts``: the nodes' ``stripped`` texts, if they are there."""
    texts = stripped(nodes) if texts is None else texts
    below = staged(tree.descendants(nodes, focus).join(texts.select("id", "words"), "id"), "below-foci")
    counted = below.groupBy("focus_id").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n_below"))
    sized = staged(below.drop("words").join(counted.select("focus_id", (F.col("words") > most_words).alias("outline"), "n_below"), "focus_id"), "below-sized")
    name, title = F.trim(F.coalesce("citation", "id")), F.trim(F.coalesce("title", F.lit("")))
    label = F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit(".")))
    opens = F.startswith(F.lower(F.substring("plain", 1, 200)), F.lower(F.substring(title, 1, 40)))
    titled = F.when((title != "") & ~opens, F.concat(label, F.lit(" "), title, F.lit(":"))).otherwise(label)
    listed = F.split("plain", r"\s+", OPENING_WORDS + 1)
    opening = F.concat(F.array_join(F.slice(listed, 1, OPENING_WORDS), " "), F.when(F.size(listed) > OPENING_WORDS, "…").otherwise(""))
    # lines without their indent, made before they are joined; a text of more words than a block may have is in none
    whole = texts.filter(F.col("words") <= most_words).select("id", F.rtrim(F.concat(titled, F.lit(" "), "plain")).alias("line"))
    brief = texts.select("id", F.rtrim(F.concat(label, F.lit(" "), F.when(title != "", title).otherwise(opening))).alias("line"))
    lines = sized.filter("not outline").join(whole, "id").unionByName(sized.filter("outline").join(brief, "id"))
    lines = lines.select(F.col("focus_id").alias("id"), "position", "outline", "n_below", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "line").alias("line"))
    note = F.concat(F.lit("["), F.col("n_below").cast("string"), F.lit(" provisions inside; bodies omitted for length]"))
    last = sized.filter(F.col("outline") & (F.col("position") == F.col("n_below"))).select(F.col("focus_id").alias("id"), (F.col("position") + 1).alias("position"), "outline", "n_below", note.alias("line"))
    paged = lines.unionByName(last).withColumn("page", F.floor((F.col("position") - 1) / page_lines).cast("int"))
    made = paged.groupBy("id", "page", "outline").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("x"))
    return made.select("id", "page", "outline", F.array_join("x.line", "\n").alias("block"))


def prompts(nodes: DataFrame, start: DataFrame, least_words: int = 25, texts: DataFrame | None = None) -> DataFrame:
    """(id, page, prompt): the parts that a summary is asked with; rows of few words and nothing below get none. Pages after the first hold what is
    below only. ``texts``: the nodes' id, citation, title and full_text where these are at hand without the joins that made the nodes."""
    texts = nodes if texts is None else texts
    skeleton = staged(nodes.select("id", "parent_id", "sort_order"), "skeleton")
    foci = staged(skeleton.join(start.select("id"), "id", "left_semi"), "foci")
    own = (texts if set(start.columns) == {"id"} else start).select("id", "citation", "title", "full_text").join(foci.select("id"), "id", "left_semi")
    plain = stripped(texts)
    up, down = ancestor_block(skeleton, foci, texts=plain), descendant_block(skeleton, foci.select("id"), texts=plain)
    rows = own.join(up.withColumnRenamed("block", "above"), "id", "left").join(down.select("id", "page", F.col("block").alias("below")), "id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    text = T.strip_for_prompt(F.col("full_text"))
    rows = rows.filter(F.col("below").isNotNull() | (T.word_count(text) >= least_words))
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:\n"), c))
    first = lambda c: F.when(F.col("page") == 0, c)
    parts = [first(part("Context", F.col("above"))), first(part("Provision", F.concat_ws(" ", "citation", "title"))), first(part("Text", text)), part("Below", F.col("below"))]
    return rows.select("id", "page", F.concat_ws("\n\n", *parts).alias("prompt"))


def capped_groups(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """(group, ids, n_more): the first ``cap`` ids of each group and how many more there are."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    first = ranked.filter(F.col("r") <= cap).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("x"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return first.join(size, group).select(group, F.col("x.id").alias("ids"), F.greatest(F.col("size") - cap, F.lit(0)).alias("n_more"))


def coverage(roots: DataFrame) -> DataFrame:
    """(jurisdiction_level, heading, names): documents by level and heading; runs of numbered names are one name with a range."""
    number = F.nullif(F.regexp_extract("name", r"(\d+)$", 1), F.lit("")).cast("int")
    stem = F.regexp_replace("name", r"\s*\d+$", "")
    rows = roots.select("jurisdiction_level", "heading", "name", stem.alias("stem"), number.alias("number"))
    run = F.col("number") - F.row_number().over(W.partitionBy("jurisdiction_level", "heading", "stem").orderBy("number"))
    grouped = rows.withColumn("run", run).groupBy("jurisdiction_level", "heading", "stem", "run").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.min("name").alias("name"))
    name = F.when(F.col("high") > F.col("low"), F.concat("stem", F.lit(" "), F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string"))).otherwise(F.col("name"))
    return grouped.groupBy("jurisdiction_level", "heading").agg(F.sort_array(F.collect_list(F.struct("stem", "low", name.alias("name")))).alias("x")).select("jurisdiction_level", "heading", F.col("x.name").alias("names"))


def version_key(nodes: DataFrame, updated: str = "updated_at") -> DataFrame:
    """(reg_key, version): count and latest change of a document; what is rendered from it is valid while it is the same."""
    return nodes.groupBy("reg_key").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max(updated).cast("string")).alias("version"))


def cited_rows(rows: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """(id, cited_id): nodes whose label a text mentions as (a) or paragraphs (a)-(c), in the same parent; the node itself and
    its relatives by id aren't taken, and ``most`` at most."""
    spans = F.regexp_extract_all(F.col("full_text"), F.lit(r"\(([a-z])\)(?:\s*(?:-|–|through)\s*\(([a-z])\))?"), F.lit(0))
    low = lambda s: F.ascii(F.regexp_extract(s, r"\(([a-z])\)", 1))
    high = lambda s: F.ascii(F.regexp_extract(s, r"\(([a-z])\)$", 1))
    letters = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(low(s), F.greatest(low(s), high(s))), lambda c: F.char(c)))))
    asked = rows.select("id", "parent_id", F.posexplode(letters).alias("pos", "letter"))
    target = nodes.select(F.col("id").alias("cited_id"), F.col("parent_id"), F.regexp_extract("id", "-([a-z])$", 1).alias("letter")).filter("letter <> ''")
    found = asked.join(target, ["parent_id", "letter"]).filter("cited_id <> id")
    return found.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("pos"))).filter(F.col("r") <= most).select("id", "cited_id")

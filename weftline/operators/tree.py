"""Hierarchies as tables: ancestors, breadcrumbs, descendants, depths, groups, and what is broken in them.

What each node needs to know of the nodes above it (how many, their names, the topmost) is found by jumping pointers: a row a node,
which points at an ancestor and holds what lies between. A round joins the rows to themselves; each pointer then reaches
twice as far, so a tree of depth 100,000 takes 17 rounds of as many rows as there are nodes. Only ``ancestors`` returns all
pairs, since these are its result. Each round is written to the shared folder. ``max_depth`` ends a walk on purpose.

Nodes in a cycle or below one have no top: their depth, group and path are null, and they are below nothing; ``ancestors`` ends where an ancestor comes back.
Ids are unique; a null id has no children. A parent that isn't in the table ends a walk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.sources.shared import staged


def _jumped(rows: DataFrame, merge: Callable[[Column, Column], Column], each: Callable[[DataFrame], None] | None = None, rounds: int | None = None) -> DataFrame:
    """(id, up, value) when no pointer goes on: up is null, or the node is in or below a cycle.

    ``rows``: id, up (null at the end), value of the way from id to up. ``merge`` puts the value of the way above in front of that
    of the way below. ``each`` sees the rows before every round."""
    open_before = None
    while True:
        seen = Observation()
        rows = staged(rows.observe(seen, F.count("up").alias("open")), "pointers")
        still = seen.get["open"]
        if each and still:
            each(rows)
        if not still or still == open_before or rounds == 0:  # a round that ends no walk leaves cycles only
            return rows
        open_before, rounds = still, None if rounds is None else rounds - 1
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("value").alias("over"))
        further = rows.filter("up is not null").join(above, "up").select("id", F.col("next").alias("up"), merge(F.col("over"), F.col("value")).alias("value"))
        rows = rows.filter("up is null").unionByName(further)


def _with_parent(nodes: DataFrame, *extra: Column) -> DataFrame:
    """Nodes with whether their parent is there (has), and columns of it."""
    above = nodes.select(F.col("id").alias("__up"), F.lit(True).alias("__has"), *extra)
    return nodes.join(above, F.col("parent_id") == F.col("__up"), "left").withColumn("has", F.coalesce("__has", F.lit(False))).drop("__up", "__has")


def _measured(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The staged pairs and their greatest distance, which is taken while they are written."""
    seen = Observation()
    kept = staged(pairs.observe(seen, F.max("distance").alias("far")), "ancestors")
    return kept, seen.get["far"] or 0


def _doubled(nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, ancestor_id, distance) of all nodes."""
    ids = nodes.select(F.col("id").alias("ancestor_id"))
    pairs = nodes.select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")).filter("ancestor_id <> id")
    pairs, far = _measured(pairs.join(ids, "ancestor_id", "left_semi").select("id", "ancestor_id", "distance"))
    reach = 1
    while far == reach and (max_depth is None or reach < max_depth):
        above = pairs.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"), F.col("distance").alias("more"))
        more = pairs.filter(F.col("distance") == reach).join(above, "ancestor_id")
        more = more.select("id", F.col("next_id").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        every = pairs.unionByName(more.filter("id <> ancestor_id"))
        pairs, far = _measured(every.groupBy("id", "ancestor_id").agg(F.min("distance").alias("distance")))
        reach *= 2
    return pairs if max_depth is None else pairs.filter(F.col("distance") <= max_depth)


def _climbed(nodes: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, ancestor_id, distance) of the nodes of ``start``."""
    up = nodes.select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("next_id"))
    step = start.select("id", F.col("parent_id").alias("next_id"), F.array("id").alias("seen"))
    found, distance = None, 0
    while max_depth is None or distance < max_depth:
        distance += 1
        here = step.filter("next_id is not null and not array_contains(seen, next_id)").select("id", F.col("next_id").alias("ancestor_id"), "seen").join(up, "ancestor_id")
        here = here.select("id", "ancestor_id", F.lit(distance).alias("distance"), "next_id", F.array_append("seen", F.col("ancestor_id")).alias("seen"))
        step = staged(here, "ancestors")
        rows = step.select("id", "ancestor_id", "distance")
        found = rows if found is None else found.unionByName(rows)
        if step.isEmpty():
            break
    return found


def ancestors(nodes: DataFrame, start: DataFrame | None = None, max_depth: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ancestor_id, distance, carry...): every ancestor of every node of ``start`` (all by default), from distance 1."""
    found = _doubled(nodes, max_depth) if start is None else _climbed(nodes, start, max_depth)
    return found.join(nodes.select(F.col("id").alias("ancestor_id"), *carry), "ancestor_id").select("id", "ancestor_id", "distance", *carry) if carry else found


def breadcrumbs(nodes: DataFrame, start: DataFrame | None = None, separator: str = " › ", max_depth: int | None = None) -> DataFrame:
    """(id, path): headings above each node from the top, without the root and without bare numbering; null if none.

    ``nodes``: id, parent_id, title, citation. With ``start`` or ``max_depth`` only these nodes, or so many levels, are walked."""
    bare = F.trim("title").eqNullSafe(F.trim("citation"))
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("citation"))
    if start is None and max_depth is None:
        own = F.when(bare | F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array(name))
        rows = _with_parent(nodes).select("id", F.when(F.col("has"), F.col("parent_id")).alias("up"), F.struct(own.alias("names"), F.size(own).alias("own")).alias("value"))
        done = _jumped(rows, lambda over, value: F.struct(F.concat(over["names"], value["names"]).alias("names"), value["own"].alias("own")))
        over = F.slice("value.names", F.lit(1), F.size("value.names") - F.col("value.own"))
        path = F.array_join(F.filter(over, lambda x: x.isNotNull()), separator)
        return done.select("id", F.when(F.col("up").isNull() & (F.size(over) > 0), path).alias("path"))
    over = ancestors(nodes, start, max_depth, ("title", "citation")).join(nodes.filter("parent_id is null").select(F.col("id").alias("root")), F.col("ancestor_id") == F.col("root"), "left_anti")
    listed = over.filter(~bare).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(-F.col("distance"), name.alias("name")))).alias("up"))
    joined = listed.select("id", F.array_join("up.name", separator).alias("path"))
    return (start if start is not None else nodes).select("id").join(joined, "id", "left")


#: Ids of rows below which a reader's indentation starts again.
RESTARTS = ["-top-REG-", "-PART-", "-APPENDIX-", "-ATTACHMENT-"]


def restarts(node_id: Column) -> Column:
    """Whether a row is a root, a part or an appendix, from its id."""
    found = F.lit(False)
    for mark in RESTARTS:
        found = found | node_id.contains(mark)
    return found


def depths(nodes: DataFrame, restart: Callable[[Column], Column] | None = restarts) -> DataFrame:
    """(id, depth): steps to the nearest row above that ``restart`` holds for (from its id), or to the top: 0 for a row without a parent,
    1 for one whose parent isn't there. ``restart`` None: steps to the top."""
    stop = F.coalesce(restart(F.col("parent_id")), F.lit(False)) if restart else F.lit(False)
    first = F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long")
    rows = _with_parent(nodes).select("id", F.when(F.col("has") & ~stop, F.col("parent_id")).alias("up"), first.alias("value"))
    done = _jumped(rows, lambda over, value: over + value)
    return done.select("id", F.when(F.col("up").isNull(), F.col("value")).alias("depth"))


def top_groups(nodes: DataFrame) -> DataFrame:
    """(id, group_id): the ancestor right below the root; of such a node itself; null for a root, and where no root is above."""
    root = F.col("__top") & F.col("has")
    rows = _with_parent(nodes, F.col("parent_id").isNull().alias("__top"))
    rows = rows.select("id", F.when(F.col("has") & ~F.col("__top"), F.col("parent_id")).alias("up"), F.when(root, F.col("id")).alias("value"))
    done = _jumped(rows, lambda over, value: over)
    return done.select("id", F.when(F.col("up").isNull(), F.col("value")).alias("group_id"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with position: 1, 2, ... within each group by ``order``. Rows are sorted over all tasks and each task's rows are counted, so a
    group that holds most rows isn't one task's. Rows of no group (null) are a group."""
    index = F.monotonically_increasing_id()
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    cut = staged(cut.select("*", F.spark_partition_id().alias("__part"), index.alias("__index")), "numbered")
    sizes = cut.groupBy("__part", F.col(group).alias("__group")).agg(F.min("__index").alias("__first"), F.count(F.lit(1)).alias("__n"))  # tasks and their groups
    before = F.sum("__n").over(W.partitionBy("__group").orderBy("__part")) - F.col("__n")
    sizes = sizes.select(F.col("__part").alias("__task"), "__group", "__first", before.alias("__before"))
    position = (F.col("__index") - F.col("__first") + F.col("__before") + 1).alias("position")
    return cut.join(sizes, (F.col("__part") == F.col("__task")) & F.col(group).eqNullSafe(F.col("__group"))).select(*rows.columns, position)


def descendants(nodes: DataFrame, focus: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(focus_id, id, depth, position): nodes below each focus in reading order (depth-first, by sort_order and id).

    Pointers that reach 1, 2, 4, ... levels up are kept; a node at distance 5 below a focus is found over the one 4 below it. A
    row holds its way from its focus, as that is what it is sorted by."""
    step = F.array(F.struct(F.col("sort_order").cast("bigint").alias("sort_order"), F.col("id")))
    rows = _with_parent(nodes).select("id", F.when(F.col("has"), F.col("parent_id")).alias("up"), step.alias("value"))
    reach: list[DataFrame] = []
    rounds = None if max_depth is None else max(0, max_depth.bit_length() - 1)
    done = _jumped(rows, lambda over, value: F.concat(over, value), lambda r: reach.append(r.filter("up is not null")), rounds)
    below = focus.select(F.col("id").alias("focus_id"), "id", F.lit(0).alias("depth"), F.array().cast("array<struct<sort_order: bigint, id: string>>").alias("way")).distinct()
    for k in reversed(range(len(reach))):
        further = reach[k].join(below.select("focus_id", F.col("id").alias("up"), "depth", "way"), "up").filter("id <> focus_id")
        further = further.select("focus_id", "id", (F.col("depth") + 2**k).alias("depth"), F.concat("way", "value").alias("way"))
        if max_depth is not None:
            further = further.filter(F.col("depth") <= max_depth)
        below = staged(below.unionByName(further), "below")
    found = below.filter("depth > 0")
    if max_depth is None:
        found = found.join(done.filter("up is not null").select("id"), "id", "left_anti")  # cycles
    return numbered(found, "focus_id", ["way"]).select("focus_id", "id", "depth", "position")


def children(nodes: DataFrame) -> DataFrame:
    """(parent_id, n_children, children): ids in printed order."""
    listed = F.sort_array(F.collect_list(F.struct("sort_order", "id")))
    return nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), listed.alias("listed")).select("parent_id", "n_children", F.col("listed.id").alias("children"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't there."""
    ids = nodes.select(F.col("id").alias("parent_id"))
    return nodes.filter("parent_id is not null").join(ids, "parent_id", "left_anti")


def prefix_collisions(nodes: DataFrame) -> DataFrame:
    """(id, longer_id): pairs where an id is a dash-prefix of another that isn't below it by parents."""
    cut = nodes.select(F.col("id").alias("longer_id"), "parent_id", F.regexp_replace("id", "-[^-]+$", "").alias("id"))
    return cut.filter("id <> longer_id").join(nodes.select("id"), "id", "left_semi").filter(~F.col("parent_id").eqNullSafe(F.col("id"))).select("id", "longer_id")


def nearest_lower(rows: DataFrame, group: str = "doc", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds parent_pos: the last earlier row of the group with a smaller level, whatever the levels are.

    Rows are sorted over all tasks and each task keeps a stack of levels. Rows that find no parent in their task wait, and what is
    left on a task's stack goes on: these few rows, at most two for each level and task, meet by group and are put through a
    stack again. Rows of no group (null) are a group; a row without a level has no parent and is none."""
    names, keep = rows.columns, rows.select(group, pos, level).columns
    out_type = t.StructType([*(t.StructField(f.name, f.dataType) for f in rows.schema), t.StructField("parent_pos", rows.schema[pos].dataType), t.StructField("__kind", t.IntegerType())])
    g, p, v = (names.index(c) for c in keep)

    def stacked(final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stack: list[tuple] = []
            here, fields = object(), None

            def rest() -> pa.RecordBatch:
                columns = [pa.nulls(len(stack), f.type) for f in fields]
                for at, values in ((g, [here] * len(stack)), (p, [x for _, x in stack]), (v, [x for x, _ in stack])):
                    columns[at] = pa.array(values, fields[at].type)
                return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(stack), fields[p].type), pa.array([2] * len(stack), pa.int32())], names=[*names, "parent_pos", "__kind"])

            for batch in batches:
                fields = fields or [batch.schema.field(i) for i in range(len(names))]
                parents, kinds = [], []
                asks = batch.column(len(names)).to_pylist() if final else [None] * batch.num_rows
                for a, at, x, ask in zip(batch.column(g).to_pylist(), batch.column(p).to_pylist(), batch.column(v).to_pylist(), asks):
                    if a != here:
                        if stack and not final:
                            yield rest()
                        stack, here = [], a
                    if x is None:
                        parents.append(None)
                        kinds.append(0)
                        continue
                    if ask == 1:  # a row that waits: what it left behind comes as a row of its own
                        parents.append(next((y for z, y in reversed(stack) if z < x), None))
                        kinds.append(0)
                        continue
                    while stack and stack[-1][0] >= x:
                        stack.pop()
                    parents.append(stack[-1][1] if stack else None)
                    kinds.append(0 if stack or final else 1)
                    stack.append((x, at))
                columns = [*(batch.column(i) for i in range(len(names))), pa.array(parents, fields[p].type), pa.array(kinds, pa.int32())]
                out = pa.RecordBatch.from_arrays(columns, names=[*names, "parent_pos", "__kind"])
                yield out.filter(pa.array([k == 1 for k in asks])) if final else out
            if stack and not final:
                yield rest()

        return run

    cut = rows.repartitionByRange(group, pos).sortWithinPartitions(group, pos)
    first = staged(cut.mapInArrow(stacked(False), out_type), "levels")
    waiting = first.filter("__kind > 0").select(*names, "__kind")
    second = waiting.repartition(group).sortWithinPartitions(group, pos, "__kind").mapInArrow(stacked(True), out_type)
    return first.filter("__kind = 0").unionByName(second).drop("__kind")


def hidden_after(rows: DataFrame, group: str, pos: str, shown: str) -> DataFrame:
    """(group, after, n_hidden): hidden rows counted at the shown row before them."""
    over = W.partitionBy(group).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("after", F.last(F.when(F.col(shown), F.col(pos)), ignorenulls=True).over(over))
    return marked.filter(~F.col(shown)).groupBy(group, "after").agg(F.count(F.lit(1)).alias("n_hidden"))


def visible_subtree(nodes: DataFrame, focus: str, is_focus_below: Column | None = None) -> DataFrame:
    """Public rows of a focus and below it, by id; none unless the focus itself is public."""
    from weftline.functions.values import in_subtree

    rows = nodes.filter(in_subtree(F.col("id"), focus) if is_focus_below is None else is_focus_below)
    gate = nodes.filter((F.col("id") == focus) & F.col("is_public")).select(F.lit(True).alias("is_public")).limit(1)
    return rows.filter("is_public").join(gate, "is_public", "left_semi")

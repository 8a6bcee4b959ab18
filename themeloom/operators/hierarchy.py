"""Parent-child rows as full hierarchies: root, depth, path and descendants of every node, cycles told.

Method: connected components by alternating large-star and small-star rounds, each component co-located in one task and walked
depth-first with node colours. A component too large for one task is never gathered: it is resolved by doubling the parent pointers
in joins, with the same result in every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FOREST = "node bigint, kind string, root bigint, depth bigint, path array<bigint>, n_descendants bigint, back_edge boolean, n_parents bigint"
_NAMES = [c.split()[0] for c in FOREST.split(", ")]


def _kept_apart(df: DataFrame, within: str | None):
    """The column that keeps hierarchies apart, as text."""
    return (F.lit("") if within is None else F.col(within).cast("string")).alias("g")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", within: str | None = None) -> DataFrame:
    """``(node, component)``, the component being the smallest node that is connected with the node; a self edge makes its node known. With the column
    `within` nodes of different values are different: ``(g, node, component)``, g being that value as text.

    Edges with a null end are left out, repeated ones don't matter. Each round moves an edge at most twice and collects nothing per node, so
    a hub with a third of all edges is only a larger key of a minimum and of a join that adaptive execution splits.
    """
    e = edges.select(_kept_apart(edges, within), F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("g is not null and u is not null and v is not null")
    nodes = materialise(e.select("g", F.col("u").alias("node")).union(e.select("g", "v")).distinct())
    e = materialise(e.where("u <> v").select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select("g", "v", "u"))
        low = both.groupBy("g", "u").agg(F.min("v").alias("m")).select("g", "u", F.least("u", "m").alias("m"))
        large = both.join(low, ["g", "u"]).where("v > u and v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["g", "u"]).select("g", F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialise(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    of = e.groupBy(F.col("g").alias("h"), "u").agg(F.min("v").alias("m"))
    out = nodes.join(of, (F.col("g") == F.col("h")) & (F.col("node") == F.col("u")), "left").select("g", "node", F.coalesce("m", "node").alias("component"))
    return out.drop("g") if within is None else out


def walk_component(parent: dict[int, int | None], paths: bool = True) -> Iterator[tuple]:
    """Rows of `FOREST`, but for the last column, for one component, given each node's parent (None: it is a root), in ascending order of the nodes.

    Iterative depth-first walk upward with colours: an edge to a grey node closes a cycle; the back edge of the cycle is counted at its smallest node. Paths are put together one at a time.
    """
    white, grey, black = 0, 1, 2
    colour, kind, back = dict.fromkeys(parent, white), {}, set()
    root, depth = {}, {}
    for start in sorted(parent):
        trail, node = [], start
        while node is not None and colour[node] == white:
            colour[node] = grey
            trail.append(node)
            node = parent[node]
        if node is not None and colour[node] == grey:
            circle = trail[trail.index(node) :]
            back.add(min(circle))
            for x in circle:
                kind[x], colour[x] = "on_cycle", black
        for x in reversed(trail):
            if colour[x] == grey:
                up = parent[x]
                if up is None:
                    kind[x], root[x], depth[x] = "tree", x, 0
                elif kind[up] == "tree":
                    kind[x], root[x], depth[x] = "tree", root[up], depth[up] + 1
                else:
                    kind[x] = "below_cycle"
                colour[x] = black
    below = dict.fromkeys(depth, 0)
    for x in sorted(depth, key=lambda n: -depth[n]):
        if parent[x] is not None:
            below[parent[x]] += below[x] + 1
    for x in sorted(parent):
        path = None
        if paths and x in depth:
            path = [x]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            path.reverse()
        yield x, kind[x], root.get(x, 0), depth.get(x, -1), path, below.get(x), x in back


def _walk(rows: DataFrame, paths: bool) -> DataFrame:
    """Depth-first walks over the co-located components of ``(g, component, node, parent, n_parents)``; a task holds one component at a time."""

    def components(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[int, int | None], dict[int, int]]]:
        held: dict[int, int | None] = {}
        parents: dict[int, int] = {}
        current = None
        for batch in batches:
            for g, component, node, parent, n in zip(batch["g"], batch["component"], batch["node"], batch["parent"], batch["n_parents"], strict=True):
                if (g, component) != current:
                    if held:
                        yield current[0], held, parents
                    current, held, parents = (g, component), {}, {}
                held[node] = None if parent is None or parent is pd.NA else int(parent)
                parents[node] = n
        if held:
            yield current[0], held, parents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for g, held, parents in components(b.astype({"parent": "Int64"}) for b in batches):
            for row in walk_component(held, paths):
                out.append((g, *row, parents[row[0]]))
                size += 1 + len(row[4] or ())
                if size >= 200_000:
                    yield pd.DataFrame(out, columns=["g", *_NAMES])
                    out, size = [], 0
        yield pd.DataFrame(out, columns=["g", *_NAMES])

    # a number and null in one column would reach pandas as floats, which hold 53 bits only
    exact = rows.select("g", "component", "node", F.col("parent").cast("string").alias("parent"), "n_parents")
    return exact.repartition("g", "component").sortWithinPartitions("g", "component").mapInPandas(run, f"g string, {FOREST}")


def _double(rows: DataFrame, with_paths: bool, largest: int) -> DataFrame:
    """The same for components of any size, up to `largest` nodes, by pointer doubling over ``(g, node, parent, n_parents)``.

    After k rounds `jump` is the ancestor 2 ** k steps up, null beyond the root, `top` the highest ancestor that is known, `low` the smallest node on the way and
    `below` the number of nodes fewer than 2 ** k steps below, itself included: a node adds what it has to the node that it jumps to. A jump over more steps than there are nodes ends on a
    cycle, and every node of the cycle is such an end.
    """
    first = F.coalesce("parent", "node")
    step = rows.select("g", "node", F.col("parent").alias("jump"), first.alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.least("node", first).alias("low"), F.lit(1).cast("bigint").alias("below"))
    step = materialise(step)
    for _ in range(max(1, largest.bit_length())):
        if step.where("jump is not null").isEmpty():
            break
        up = step.select(F.col("g").alias("g2"), F.col("node").alias("n2"), F.col("jump").alias("jump2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("low").alias("low2"))
        more = step.where("jump is not null").groupBy(F.col("g").alias("g3"), F.col("jump").alias("n3")).agg(F.sum("below").alias("more"))
        moved = step.join(up, (F.col("g") == F.col("g2")) & (F.col("jump") == F.col("n2")), "left").join(more, (F.col("g") == F.col("g3")) & (F.col("node") == F.col("n3")), "left")
        step = materialise(moved.select("g", "node", F.col("jump2").alias("jump"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.least("low", "low2").alias("low"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
    circle = step.where("jump is not null").select(F.col("g").alias("g2"), F.col("jump").alias("n2")).distinct().withColumn("on", F.lit(True))
    known = step.join(circle, (F.col("g") == F.col("g2")) & (F.col("node") == F.col("n2")), "left").join(rows.select("g", "node", "n_parents"), ["g", "node"])
    tree, on = F.col("jump").isNull(), F.coalesce("on", F.lit(False))
    none = F.lit(None).cast("array<bigint>")
    out = known.select(
        "g", "node", F.when(tree, "tree").when(on, "on_cycle").otherwise("below_cycle").alias("kind"), F.when(tree, F.col("top")).otherwise(0).alias("root"), F.when(tree, F.col("depth")).otherwise(-1).alias("depth"),
        none.alias("path"), F.when(tree, F.col("below") - 1).alias("n_descendants"), (on & (F.col("low") == F.col("node"))).alias("back_edge"), "n_parents",
    )
    if not with_paths:
        return out
    paths = materialise(rows.join(step.where("jump is null").select("g", "node"), ["g", "node"]).select("g", "node", F.col("parent").alias("next"), F.array("node").alias("path")))
    while not paths.where("next is not null").isEmpty():
        up = paths.select(F.col("g").alias("g2"), F.col("node").alias("n"), F.col("next").alias("next2"), F.col("path").alias("path2"))
        moved = paths.where("next is not null").join(up, (F.col("g") == F.col("g2")) & (F.col("next") == F.col("n"))).select("g", "node", F.col("next2").alias("next"), F.concat("path2", "path").alias("path"))
        paths = materialise(paths.where("next is null").union(moved))
    return out.drop("path").join(paths.select("g", "node", "path"), ["g", "node"], "left").select("g", *_NAMES)


def descendants(forest: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` for every node of a tree and everything below it, from the paths: no join, no group is gathered. Other columns of `forest` than those of `FOREST` come first."""
    others = [c for c in forest.columns if c not in _NAMES]
    out = forest.where("path is not null").select(*others, F.posexplode("path").alias("i", "anc"), F.col("node").alias("d"), F.size("path").alias("n")).where("anc <> d")
    return out.select(*others, F.col("anc").alias("node"), F.col("d").alias("descendant"), (F.col("n") - 1 - F.col("i")).cast("bigint").alias("distance"))


def hierarchy(links: DataFrame, child: str, parent: str, known: DataFrame | None = None, task_nodes: int = 200_000, paths: bool = True, within: str | None = None) -> DataFrame:
    """`FOREST`, a row per node, of the links child -> parent (bigint numbers). With the column `within` of the links each of its values has a hierarchy of its own, and comes first as text.

    Nodes are the children and those of their parents that are in `known` (one column; all parents when None); another parent isn't
    followed, so its child is a root. A child with several such parents follows the smallest number; `n_parents` counts them all, and each is a node. Links with a null child are left out, a null
    parent makes the child a root, a node that is its own parent is on a cycle; repeated links count once. `kind` is ``tree``, ``on_cycle`` or
    ``below_cycle``; the latter two have root 0, depth -1, no path and no number of descendants. `back_edge` marks the smallest node of each cycle. Without `paths` the path is null for
    all nodes: paths are as long as the hierarchy is deep. No component above `task_nodes` nodes is ever held by a single task.
    """
    given = links.select(_kept_apart(links, within), F.col(child).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent")).where("g is not null and node is not null").distinct()
    if known is not None:
        there = known.select(F.col(known.columns[0]).cast("bigint").alias("k")).distinct()
        given = given.join(there, F.col("parent") == F.col("k"), "left").select("g", "node", F.col("k").alias("parent"))
    given = materialise(given)
    children = given.groupBy("g", "node").agg(F.min("parent").alias("parent"), F.count("parent").alias("n_parents"))
    tops = given.where("parent is not null").select("g", F.col("parent").alias("node")).distinct().join(children, ["g", "node"], "left_anti").select("g", "node", F.lit(None).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("n_parents"))
    rows = children.unionByName(tops)
    of = connected_components(rows.select("g", "node", F.coalesce("parent", "node").alias("up")), "node", "up", "g")
    rows = materialise(rows.join(of, ["g", "node"]).select("g", "component", "node", "parent", "n_parents"))
    large = materialise(rows.groupBy("g", "component").count().where(F.col("count") > task_nodes))
    largest = large.agg(F.max("count")).first()[0]
    if largest is None:
        out = _walk(rows, paths)
    else:
        held = rows.join(large.select("g", "component"), ["g", "component"], "left_anti")
        out = _walk(held, paths).unionByName(_double(rows.join(large.select("g", "component"), ["g", "component"], "left_semi"), paths, largest))
    return out.drop("g") if within is None else out.select(F.col("g").alias(within), *_NAMES)

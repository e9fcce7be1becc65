"""Graph algorithms as rounds of joins.

Frontiers, distances and labels stay distributed: every round is one join with the
edges and is written to the folder of spark.checkpoint.dir, which cuts the lineage
and survives lost executors. The driver only asks whether a round found anything.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.joins import dealt, neighbors
from graphloom.operators.merge import positions
from graphloom.sources.tables import cut


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


#: Rounds whose new nodes are read one by one before they are put together.
ROUNDS = 8
#: Edges of a component that one task follows by itself (some 100 bytes each in memory).
#: Components with more are followed by rounds of joins over all tasks.
LOCAL = 1_000_000


def by_component(ids: DataFrame, pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """pairs (source, target) with ``component``, and (component, small): whether it has
    ``most`` edges or fewer. Ends without a node count as nodes."""
    ends = pairs.select(F.explode(F.array("source", "target")).alias("id"))
    labels = components(ids.select("id").union(ends), pairs, most)
    placed = cut(pairs.join(labels.withColumnRenamed("id", "source"), "source"), "placed")
    sizes = placed.groupBy("component").agg((F.count(F.lit(1)) <= most).alias("small"))
    return placed, cut(sizes, "sizes")


def hops(part: pd.DataFrame, start: list[str], most: int | None) -> pd.DataFrame:
    """(id, distance) of all that the edges (source, target) of one component reach from
    nodes at distance 0."""
    codes, names = pd.factorize(pd.concat([part["source"], part["target"], pd.Series(start, dtype=object)]))
    n, m = len(part), len(names)
    order = np.argsort(codes[:n], kind="stable")
    source, target = codes[:n][order], codes[n : 2 * n][order]
    first = np.searchsorted(source, np.arange(m + 1))
    far, front, hop = np.full(m, -1), np.unique(codes[2 * n :]), 0
    far[front] = 0
    while len(front) and (most is None or hop < most):
        hop += 1
        found = np.unique(target[runs(first[front], first[front + 1])])
        front = found[far[found] < 0]
        far[front] = hop
    return pd.DataFrame({"id": names[far >= 0], "distance": far[far >= 0]})


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from low up to high (excluded) of each pair, one after the other."""
    size = high - low
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


def reach(edges: DataFrame, start: str, most: int | None = None, undirected: bool = False, local: int = LOCAL) -> DataFrame:
    """(id, distance) of all nodes that edges reach from start, itself included at
    0, up to ``most`` hops. Each round expands the last round's nodes only and
    writes what is new. If the end is not near, only the component of start is looked
    at from then on: one of up to ``local`` edges by one task, a larger one by rounds."""
    pairs = edges.select("source", "target")
    if undirected:
        pairs = pairs.union(pairs.select("target", "source"))
    pairs = cut(pairs, "pairs")
    front = edges.sparkSession.createDataFrame([(start, 0)], "id string, distance int")  # one row
    fronts, hop, whole = [front], 0, True
    while most is None or hop < most:
        hop += 1
        seen = reduce(DataFrame.union, fronts)
        step = pairs.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("distance", F.lit(hop)), "front")
        if front.isEmpty():
            break
        fronts.append(front)
        if len(fronts) > ROUNDS:
            fronts = [cut(reduce(DataFrame.union, fronts), "seen")]
            if whole and (most is None or hop < most):
                whole = False
                pairs = cut(pairs.filter("source <> target").distinct(), "pairs")
                ends = pairs.select(F.explode(F.array("source", "target")).alias("id"))
                labels = components(ends, pairs, local)
                own = labels.filter(F.col("id") == start).select("component")  # one row
                inside = labels.join(F.broadcast(own), "component").select(F.col("id").alias("source"))
                pairs = cut(pairs.join(inside, "source", "left_semi"), "pairs")
                if pairs.count() <= local:
                    return pairs.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(lambda part: hops(part, [start], most), "id string, distance int")
    return reduce(DataFrame.union, fronts)


def dependencies(edges: DataFrame, node_id: str, transitive: bool = True) -> DataFrame:
    """(id): what node_id points at, directly (a self-loop counts) or at all (itself
    does not count)."""
    if not transitive:
        return edges.filter(F.col("source") == node_id).select(F.col("target").alias("id")).distinct()
    return reach(edges, node_id).filter("distance > 0").select("id")


def dependents(edges: DataFrame, node_id: str, transitive: bool = True) -> DataFrame:
    return dependencies(_reversed(edges), node_id, transitive)


def removal_impact(edges: DataFrame, node_id: str) -> DataFrame:
    """One row: direct and indirect dependents, risk and its grade."""
    found = reach(_reversed(edges), node_id).filter("distance > 0")
    row = found.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("indirect"), F.count(F.lit(1)).alias("affected"))
    n = F.col("affected")
    risk = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.15 + 0.4 * F.log10(n)))
    grade = F.when(n == 0, "low").when(n <= 8, "MODERATE").otherwise("HIGH")
    return row.select(F.lit(node_id).alias("id"), "direct", "indirect", "affected", F.round(risk, 6).alias("risk"), grade.alias("grade"))


def shortest_paths(edges: DataFrame, start: str) -> DataFrame:
    """(id, distance, before): least sums of weights (a null weight is 0) from start,
    and the node before (by id, of those that give it). A round relaxes only nodes
    that the last one improved."""
    cost = edges.select("source", "target", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    cost = cut(cost.groupBy("source", "target").agg(F.min("weight").alias("weight")), "cost")
    known = edges.sparkSession.createDataFrame([(start, 0.0, None)], "id string, distance double, before string")  # one row
    front = known
    while not front.isEmpty():
        step = cost.join(front.select(F.col("id").alias("source"), "distance"), "source")
        step = step.groupBy(F.col("target").alias("id")).agg(
            F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("source").alias("before"))).alias("new")
        )
        old = known.select("id", F.col("distance").alias("old"), F.col("before").alias("old_before"))
        better = step.join(old, "id", "left").filter(F.col("old").isNull() | (F.col("new.distance") < F.col("old")))
        front = cut(better.select("id", "new.distance", "new.before"), "front")
        known = cut(known.join(front, "id", "left_anti").unionByName(front), "known")
    return known


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(position, id, distance) along a least path; no rows if there is none. The
    path is followed back in jumps: after round n every node knows who stands 2^n
    steps before it, and the path found so far doubles, so a long one takes few
    rounds."""
    found = cut(shortest_paths(edges, start), "found")
    # of the nodes before that give the distance the least id, where that is a step down
    far = found.select(F.col("id").alias("target"), F.col("distance").alias("d"))
    step = edges.select("source", "target", F.coalesce("weight", F.lit(0.0)).alias("weight")).join(found.select(F.col("id").alias("source"), "distance"), "source").join(far, "target")
    least = step.filter((F.col("distance") < F.col("d")) & (F.col("distance") + F.col("weight") == F.col("d"))).groupBy(F.col("target").alias("id")).agg(F.min("source").alias("least"))
    known = cut(found.join(least, "id", "left").select("id", "distance", F.coalesce("least", "before").alias("before")), "known")
    path = known.filter(F.col("id") == end).select("id", F.lit(0).cast("long").alias("back"))
    jumps, step = known.filter("before is not null").select("id", F.col("before").alias("to")), 1
    while True:
        more = path.join(jumps, "id").select(F.col("to").alias("id"), (F.col("back") + step).alias("back"))
        longer = cut(path.union(more).distinct(), "path")
        if longer.count() == path.count():
            break
        path, step = longer, step * 2
        onward = jumps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        jumps = cut(jumps.join(onward, "to").select("id", F.col("further").alias("to")), "jumps")
    length = path.agg(F.max("back").alias("last"))  # one row
    return path.join(F.broadcast(length)).join(known, "id").select((F.col("last") - F.col("back")).cast("int").alias("position"), "id", "distance")


def chains(part: pd.DataFrame) -> pd.DataFrame:
    """(id, depth), as topological, of the nodes of whole components of edges (source,
    target, known: whether the target is a node; one that is none is never placed)."""
    codes, names = pd.factorize(pd.concat([part["source"], part["target"]]))
    n, m = len(part), len(names)
    order = np.argsort(codes[n:], kind="stable")
    source, target = codes[:n][order], codes[n:][order]
    first, waits = np.searchsorted(target, np.arange(m + 1)), np.bincount(source, minlength=m)
    waits[codes[n:][~part["known"].to_numpy(bool)]] = n + 1
    depth, free, level = np.full(m, -1), np.flatnonzero(waits == 0), 0
    while len(free):
        depth[free] = level
        above, less = np.unique(source[runs(first[free], first[free + 1])], return_counts=True)
        waits[above] -= less
        free, level = above[waits[above] == 0], level + 1
    return pd.DataFrame({"id": names, "depth": pd.Series(depth, dtype="Int32").mask(depth < 0)})


def topological(edges: DataFrame, nodes: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, depth): the longest chain of dependencies below each node; null for
    nodes on or above a cycle. Components of up to ``local`` edges are each placed by one
    task. In larger ones round n places the nodes whose targets all are placed."""
    pairs, ids = cut(edges.select("source", "target").distinct(), "pairs"), cut(nodes.select("id").distinct(), "ids")
    placed, sizes = by_component(ids, pairs, local)
    # components are dealt to groups of some local edges each, so many small ones make few groups
    groups = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * placed.count() / max(local, 1)))
    known = placed.join(sizes.filter("small"), "component", "left_semi").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left")
    dealt = known.select("source", "target", F.coalesce("known", F.lit(False)).alias("known"), F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"))
    small = cut(dealt.groupBy("group").applyInPandas(chains, "id string, depth int"), "chains")
    large = sizes.filter("NOT small")
    alone = ids.join(pairs.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti").withColumn("depth", F.lit(0))
    done = ids.join(small, "id").unionByName(alone)
    if large.isEmpty():
        return done
    pairs = cut(placed.join(large, "component", "left_semi").select("source", "target"), "pairs")
    left = cut(ids.join(done, "id", "left_anti"), "left")
    return done.unionByName(topological_rounds(pairs, left))


def topological_rounds(pairs: DataFrame, left: DataFrame) -> DataFrame:
    """topological of different pairs and ids, by rounds of joins."""
    placed, depth = None, 0
    while True:
        waits = pairs.select(F.col("source").alias("id")).distinct()
        free = cut(left.join(waits, "id", "left_anti").withColumn("depth", F.lit(depth)), "free")
        if free.isEmpty():
            break
        placed = free if placed is None else cut(placed.unionByName(free), "placed")
        left = cut(left.join(free, "id", "left_anti"), "left")
        pairs = cut(pairs.join(free.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"), "pairs")
        depth += 1
    rest = left.withColumn("depth", F.lit(None).cast("int"))
    return rest if placed is None else placed.unionByName(rest)


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(length, cycle): simple directed cycles of up to ``longest`` nodes, each once,
    from its least id. Paths only grow over ids above their start, so a cycle is
    found from one start and not once for each of its nodes."""
    pairs = edges.select("source", "target").distinct()
    loops = pairs.filter("source = target").select(F.array("source").alias("path"))
    paths = pairs.filter("source < target").select(F.array("source", "target").alias("path"), F.col("target").alias("at"))
    found = [loops]
    step = pairs.select(F.col("source").alias("at"), F.col("target").alias("next"))
    for length in range(2, longest + 1):
        grown = paths.join(step, "at")
        found.append(grown.filter(F.col("next") == F.col("path")[0]).select("path"))
        if length < longest:
            open_ends = grown.filter((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
            paths = open_ends.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
    return reduce(DataFrame.union, found).select(F.size("path").alias("length"), F.array_join("path", ">").alias("cycle"))


def joined_up(part: pd.DataFrame) -> pd.DataFrame:
    """(n, root) of the ends of undirected edges (a, b): the least number that they reach."""
    codes, names = pd.factorize(pd.concat([part["a"], part["b"]]), sort=True)
    a, b = codes[: len(part)], codes[len(part) :]
    root = np.arange(len(names))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"n": names, "root": np.asarray(names)[root]})


def components(nodes: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, component): the least id that undirected edges reach; a lone node is its
    own. Nodes are numbered in the order of their ids. Each round a node is put into one
    of its neighbours or itself, the one of least hash, which leaves about half of the
    nodes of long chains and fewer of others; the next round has the edges between these
    alone. Up to ``local`` edges that are left are followed by one task."""
    # a range of ids in each task, so the numbers go up with the ids
    ranged = nodes.select("id").repartitionByRange("id").distinct().sortWithinPartitions("id")
    ids = cut(ranged.withColumn("n", F.monotonically_increasing_id()), "numbered")
    number = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
    near = edges.filter("source <> target").join(number("source", "p"), "source").join(number("target", "q"), "target")
    once = lambda rows: cut(rows.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "pairs")
    pairs, rounds = once(near), []
    while pairs.count() > local:
        rank = lambda c: F.xxhash64(c, F.lit(len(rounds)))  # noqa: B023, E731
        either = pairs.union(pairs.select("b", "a"))
        least = either.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"), F.min(rank("b")).alias("rank"))
        into = cut(least.select(F.col("a").alias("n"), F.when(F.col("rank") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("into")), "into")
        rounds.append(into)
        put = lambda c, to: into.select(F.col("n").alias(c), F.col("into").alias(to))  # noqa: B023, E731
        pairs = once(pairs.join(put("a", "p"), "a").join(put("b", "q"), "b").filter("p <> q"))
    roots = pairs.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(joined_up, "n long, root long")  # up to local edges
    for into in reversed(rounds):
        roots = into.join(roots.select(F.col("n").alias("into"), "root"), "into", "left").select("n", F.coalesce("root", "into").alias("root"))
    placed = cut(ids.join(roots, "n", "left").select("id", "n", F.coalesce("root", "n").alias("root")), "roots")
    first = placed.groupBy("root").agg(F.min("n").alias("n"))
    named = first.join(ids, "n").select("root", F.col("id").alias("component"))
    return cut(placed.select("id", "root").join(named, "root").select("id", "component"), "labels")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, members, internal_edges, cohesion) of components with two or more
    nodes; edges count once for each pair of nodes."""
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("id"), F.greatest("source", "target").alias("other")).distinct()
    pairs = cut(pairs, "undirected")  # read twice, and edges may be found by parsing
    labels = components(nodes, pairs.select(F.col("id").alias("source"), F.col("other").alias("target")))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    inner = pairs.join(labels, "id").groupBy("component").agg(F.count(F.lit(1)).alias("internal_edges"))
    rows = sizes.filter("members > 1").join(inner, "component", "left")
    edge = F.coalesce("internal_edges", F.lit(0)).cast("long")
    return rows.select("component", "members", edge.alias("internal_edges"), F.round(edge / (F.col("members") - 1), 6).alias("cohesion"))


def component_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, part, a, b): a row for each member (a, b null) and for each pair of
    members with edges (a < b, once whatever their number and way) of components with
    two or more nodes. A component of any size is no more than many rows."""
    labels = components(nodes, edges)
    large = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    members = labels.join(large, "component", "left_semi").select("component", F.lit("member").alias("part"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inner = pairs.join(labels.withColumnRenamed("id", "a"), "a").join(labels.select(F.col("id").alias("b")), "b", "left_semi")
    return members.unionByName(inner.select("component", F.lit("edge").alias("part"), "a", "b"))


def ego(nodes: DataFrame, edges: DataFrame, start: str, radius: int = 2) -> DataFrame:
    """(id, label, type, distance) around start, edges taken in either direction."""
    return nodes.select("id", "label", "type").join(reach(edges, start, radius, undirected=True), "id")


def trace(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One hop around a decision: depends_on or depended_by."""
    way = F.when(F.col("direction") == "out", "depends_on").otherwise("depended_by")
    return neighbors(nodes, edges, node_id).select("neighbor", "neighbor_label", "relation", way.alias("direction"))


def story_pairs(edges: DataFrame, relations: list[str]) -> DataFrame:
    """(a, b), a < b: the different pairs of neighbours over the given relations."""
    some = edges.filter(F.col("relation").isin(relations)).filter("source <> target")
    return dealt(some.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")), "a", "b").distinct()


def two_paths(edges: DataFrame, relations: list[str]) -> DataFrame:
    """(middle, paths): pairs of different neighbours around a middle node over the
    given relations, counted from the number of neighbours, not enumerated."""
    n = F.count(F.lit(1))
    ends = story_pairs(edges, relations).select(F.explode(F.array("a", "b")).alias("middle"))
    return ends.groupBy("middle").agg((n * (n - 1) / 2).cast("long").alias("paths")).filter("paths > 0")


def paths_through(edges: DataFrame, relations: list[str], middles: DataFrame) -> DataFrame:
    """(a, middle, b): the paths themselves, of the middle nodes (id) asked for. A
    path is a pair of neighbours, so what is asked for is a view's nodes, not all.
    Only their edges are put together: the nodes asked for meet the edges in each scan."""
    some = edges.filter(F.col("relation").isin(relations)).filter("source <> target")
    either = some.select(F.col("target").alias("middle"), F.col("source").alias("end")).union(some.select("source", "target"))
    ends = either.join(F.broadcast(middles.select(F.col("id").alias("middle"))), "middle", "left_semi").distinct()  # a view's nodes
    other = ends.select("middle", F.col("end").alias("b"))
    return ends.withColumnRenamed("end", "a").join(other, "middle").filter("a < b").select("a", "middle", "b")


def ring_layout(nodes: DataFrame, edges: DataFrame, start: str, spacing: float = 180.0, most: int | None = None) -> DataFrame:
    """(id, ring): hops from start, 3 for what is not reached (in ``most`` hops, if given;
    and for start, whose distance is no number of hops)."""
    far = reach(edges, start, most, undirected=True)
    ring = F.when(F.coalesce("distance", F.lit(0)) == 0, 3).otherwise(F.col("distance"))
    return nodes.select("id").join(far, "id", "left").select("id", ring.alias("ring"), (ring * spacing).alias("radius"))


def layers(topo: DataFrame, spacing: float = 180.0, height: float = 130.0) -> DataFrame:
    """(id, x, y) by depth and order of id within a depth."""
    rows = positions(topo.filter("depth is not null").select("depth", "id"), "depth", ["id"])
    return rows.select("id", (F.col("position") * spacing).alias("x"), (F.col("depth") * height).alias("y"))


def principal_axes(vectors: DataFrame, rounds: int = 25) -> DataFrame:
    """(chunk_id, x, y) in 0 to 1: two principal axes by power iteration.

    Rows stay distributed: one pass sums the second moments (as many numbers as
    the square of the width, whatever the rows), the iteration runs on that small
    matrix, and a last pass projects. Under three rows there is no result."""
    import numpy as np

    n = vectors.count()
    if n < 3:
        return vectors.select("chunk_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    width = len(vectors.select("vector").first()[0])

    def moments(batches):
        import pandas as pd

        total, outer = np.zeros(width), np.zeros((width, width))
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), float)
            total, outer = total + x.sum(axis=0), outer + x.T @ x
        yield pd.DataFrame({"i": range(width), "s": total, "row": outer.tolist()})

    parts = vectors.select("vector").mapInPandas(moments, "i int, s double, row array<double>")
    sums = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)]
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), *sums).orderBy("i").toPandas()  # width rows
    mean = rows["s"].to_numpy() / n
    scatter = rows[[f"c{j}" for j in range(width)]].to_numpy() - n * np.outer(mean, mean)
    axes = []
    for seed in (np.ones(width), np.where(np.arange(width) % 2, -1.0, 1.0)):
        v = seed / np.linalg.norm(seed)
        for _ in range(rounds):
            for a in axes:
                v = v - (v @ a) * a
            v = scatter @ v
            size = np.linalg.norm(v)
            if size == 0:
                break
            v = v / size
        axes.append(v)
    along = lambda a: F.aggregate(F.zip_with("vector", F.array(*map(F.lit, a.tolist())), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    placed = vectors.select("chunk_id", along(axes[0]).alias("x"), along(axes[1]).alias("y"))
    spans = placed.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scale = lambda c: F.when(F.col(f"{c}1") > F.col(f"{c}0"), (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0"))).otherwise(0.0).alias(c)
    return placed.join(F.broadcast(spans)).select("chunk_id", scale("x"), scale("y"))  # one row of spans

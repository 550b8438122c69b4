"""Near-duplicate vectors by dual traversal of cover trees: all pairs above a cosine, exactly.

On unit vectors a cosine is a distance, so the triangle inequality holds. The upper levels
are nets over a bounded sample, each with half the radius of the one above; they place
every vector and have measured covering radii. Pairs of nodes whose balls are farther
apart than the threshold are pruned, pairs whose balls lie within it are linked as a
whole, and what remains is split further or compared vector by vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tables import components, matched, staged

#: Vectors the upper levels are fitted on; every vector is placed, whatever the sample.
SAMPLE = 4096
#: Nodes of the upper levels, vectors of a lower node, vectors a task holds of one side.
NODES, NODE, SHELF = 256, 512, 8192
#: A node of more vectors than a shelf is split by a net of FAN centres, drawn from so many of
#: its vectors, if they nearly all lie within SHRINK times its radius; up to LEAVES nodes.
FAN, FAN_SAMPLE, SHRINK, LEAVES = 16, 256, 0.75, 4096
#: Slack for rounding in bounds; links themselves are decided by the cosine alone.
SLACK = 1e-9


def unit(values: list | None) -> np.ndarray | None:
    """A vector of length 1 in double precision; None for one that links with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.linalg.norm(x)


def nets(points: np.ndarray, most: int = NODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nested nets: points in farthest-first order, their levels, and their parents' places.

    The points up to level l are more than 2 / 2**l apart and cover the sample within
    that radius, as far as ``most`` points go. A parent is the nearest point of a
    lower level number.
    """
    order, reach = [0], [2.0]
    near = np.linalg.norm(points - points[0], axis=1)
    while len(order) < min(most, len(points)) and near.max() > 0:
        order.append(int(near.argmax()))
        reach.append(float(near.max()))
        near = np.minimum(near, np.linalg.norm(points - points[order[-1]], axis=1))
    level = np.ceil(np.log2(2 / np.array(reach)) + 1e-12).astype(int)
    level[0] = 0
    parent = np.full(len(order), -1)
    for i in range(1, len(order)):
        upper = np.flatnonzero(level[:i] < level[i])
        gaps = np.linalg.norm(points[[order[u] for u in upper]] - points[order[i]], axis=1)
        parent[i] = upper[gaps.argmin()]
    return np.array(order), level, parent


def walk(parent: np.ndarray) -> list[int]:
    """Nodes in depth-first order, so that near ones are next to each other."""
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent.tolist()):
        children.setdefault(p, []).append(i)
    out, todo = [], [-1]
    while todo:
        node = todo.pop()
        if node >= 0:
            out.append(node)
        todo += children.get(node, [])[::-1]
    return out


def node_pairs(centres: np.ndarray, radius: np.ndarray, parent: np.ndarray,
               limit: float) -> set[tuple[int, int]]:
    """Pairs of nodes that may hold a link, found from the root pair down.

    ``radius`` is that of a node's own vectors; below it a subtree is covered by the
    largest distance to a descendant plus that one's radius.
    """
    children: dict[int, list[int]] = {}
    cover = radius.copy()
    for i in range(len(parent) - 1, -1, -1):
        children.setdefault(int(parent[i]), []).append(i)
        up = int(parent[i])
        while up >= 0:
            cover[up] = max(cover[up], np.linalg.norm(centres[up] - centres[i]) + radius[i])
            up = int(parent[up])
    found, seen, todo = set(), set(), [(0, 0)] if len(parent) else []
    while todo:
        a, b = pair = todo.pop()
        if pair in seen:
            continue
        seen.add(pair)
        gap = np.linalg.norm(centres[a] - centres[b])
        if gap - cover[a] - cover[b] > limit + SLACK:
            continue
        if gap - radius[a] - radius[b] <= limit + SLACK:
            found.add((min(a, b), max(a, b)))
        for x in [a, *children.get(a, [])]:
            for y in [b, *children.get(b, [])]:
                todo.append((min(x, y), max(x, y)))
    return found


class Node:
    """Some vectors with a centre that is one of them, split on demand into halves of the radius."""

    def __init__(self, rows: np.ndarray, points: np.ndarray):
        self.rows = rows
        self.points = points[rows]
        self.centre = self.points[0]
        gaps = np.linalg.norm(self.points - self.centre, axis=1)
        self.radius = float(gaps.max())
        self.gaps = gaps
        self._parts: list[Node] | None = None

    def parts(self, points: np.ndarray) -> list[Node]:
        if self._parts is None:
            near, home = self.gaps.copy(), np.zeros(len(self.rows), int)
            for k in range(1, 8):
                if near.max() <= self.radius / 2:
                    break
                far = self.points[near.argmax()]
                gaps = np.linalg.norm(self.points - far, axis=1)
                home[gaps < near] = k
                near = np.minimum(near, gaps)
            self._parts = [Node(self.rows[home == k], points) for k in np.unique(home)]
        return self._parts


class Links:
    """How many vectors each vector is linked to, and which hang together."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        self.up = np.arange(len(weights))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def tie(self, rows: np.ndarray) -> None:
        roots = {self.root(i) for i in rows.tolist()}
        for r in roots:
            self.up[r] = min(roots)

    def add(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray | None, same: bool) -> None:
        """Links of rows ``a`` with rows ``b`` where ``hit`` (None: everywhere)."""
        if hit is None:
            self.counts[a] += self.weights[b].sum() - (self.weights[a] if same else 0)
            if not same:
                self.counts[b] += self.weights[a].sum()
            self.tie(np.concatenate([a, b]))
            return
        if same:
            np.fill_diagonal(hit, False)
        left, right = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(left):
            return
        hit = hit[np.ix_(left, right)]
        a, b = a[left], b[right]
        self.counts[a] += hit @ self.weights[b]
        if not same:
            self.counts[b] += self.weights[a] @ hit
        todo = np.ones(len(a), bool)
        while todo.any():
            rows = np.zeros(len(a), bool)
            rows[todo.argmax()] = True
            while True:
                columns = hit[rows].any(0)
                more = rows | hit[:, columns].any(1)
                if (more == rows).all():
                    break
                rows = more
            self.tie(np.concatenate([a[rows], b[columns]]))
            todo &= ~rows


def traverse(a: Node, b: Node, points: np.ndarray, cosine: float, links: Links) -> None:
    """All links between two nodes (or within one), by descending in both."""
    limit = float(np.sqrt(2 - 2 * cosine))
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        gap = float(np.linalg.norm(a.centre - b.centre))
        if a is not b and gap - a.radius - b.radius > limit + SLACK:
            continue
        if a is b and 2 * a.radius <= limit - SLACK or gap + a.radius + b.radius <= limit - SLACK:
            links.add(a.rows, b.rows, None, a is b)
        elif len(a.rows) <= NODE and len(b.rows) <= NODE:
            links.add(a.rows, b.rows, a.points @ b.points.T >= cosine, a is b)
        elif a is b:
            parts = a.parts(points)
            if len(parts) == 1:
                parts = a._parts = [Node(r, points) for r in np.array_split(a.rows, 2)]
            todo += [(x, y) for i, x in enumerate(parts) for y in parts[i:]]
        elif len(a.rows) > NODE and (len(b.rows) <= NODE or a.radius >= b.radius):
            todo += [(x, b) for x in halves(a, points)]
        else:
            todo += [(a, y) for y in halves(b, points)]


def halves(node: Node, points: np.ndarray) -> list[Node]:
    parts = node.parts(points)
    if len(parts) == 1:
        parts = node._parts = [Node(r, points) for r in np.array_split(node.rows, 2)]
    return parts


PLACED = "dim int, node int, gap double, least long, weight long, unit binary"


class Ball:
    """A node of the levels between tasks: its centre, and how many vectors lie how far from it."""

    def __init__(self, centre: np.ndarray, n: int = 0, radius: float = -np.inf):
        self.centre, self.n, self.radius = centre, n, radius


def deepened(at: DataFrame, centres: dict, shelf: int) -> tuple[DataFrame, dict, dict]:
    """Vectors placed in smaller nodes where theirs has more of them than a shelf.

    A large node gets a net of its own, one level below, as long as that makes balls smaller
    and there are not more than LEAVES nodes. Returns the vectors, every node as a ``Ball`` by
    (dim, node), with its measured radius, and the nodes below a split one. What reaches the
    driver is bounded: nodes, and FAN_SAMPLE vectors of each node that is split.
    """
    spark = at.sparkSession

    def measure(frame: DataFrame) -> None:
        for r in frame.groupBy("dim", "node").agg(
                F.count("*").alias("n"), F.max("gap").alias("radius")).collect():
            balls[r["dim"], r["node"]].n, balls[r["dim"], r["node"]].radius = r["n"], r["radius"]

    balls, kids, tried = {k: Ball(c) for k, c in centres.items()}, {}, set()
    measure(at)
    while True:
        large = sorted((k for k, b in balls.items() if b.n > shelf and k not in tried and k not in kids),
                       key=lambda k: -balls[k].n)[:max(LEAVES - len(balls), 0) // FAN]
        if not large:
            return at, balls, kids
        tried.update(large)
        wanted = F.broadcast(spark.createDataFrame(large, "dim int, node int"))
        rank = F.row_number().over(Window.partitionBy("dim", "node").orderBy(
            F.xxhash64("unit"), "least"))
        drawn: dict[tuple, list] = {}
        for r in (at.join(wanted, ["dim", "node"]).withColumn("rank", rank)
                  .where(F.col("rank") <= FAN_SAMPLE).select("dim", "node", "unit").collect()):
            drawn.setdefault((r["dim"], r["node"]), []).append(np.frombuffer(r["unit"]))
        nets_ = {}
        for key, found in drawn.items():
            points = np.array(found)
            own = points[nets(points, FAN)[0]]
            gaps = np.linalg.norm(points[:, None] - own[None], axis=2).min(1)
            if np.quantile(gaps, 0.9) <= SHRINK * balls[key].radius:
                first = max(node for dim, node in balls if dim == key[0]) + 1
                kids[key] = list(range(first, first + len(own)))
                balls.update({(key[0], first + i): Ball(c) for i, c in enumerate(own)})
                nets_[key] = (first, own)
        if nets_:
            at = staged(_replaced(at, spark.sparkContext.broadcast(nets_)), "placed")
            measure(at.join(F.broadcast(spark.createDataFrame(
                [(d, k) for (d, n), own in kids.items() if (d, n) in nets_ for k in own],
                "dim int, node int")), ["dim", "node"]))


def _replaced(at: DataFrame, shared) -> DataFrame:
    """Vectors of split nodes in the nearest of the nodes below."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, node, gap = (np.array(batch.column(i).to_numpy()) for i in (0, 1, 2))
            for d, k in sorted(set(zip(dim.tolist(), node.tolist())) & shared.value.keys()):
                own = np.flatnonzero((dim == d) & (node == k))
                first, centres = shared.value[d, k]
                x = np.frombuffer(b"".join(batch.column(5).take(pa.array(own)).to_pylist())).reshape(
                    len(own), -1)
                near = (x @ centres.T).argmax(1)
                node[own], gap[own] = first + near, np.linalg.norm(x - centres[near], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int32()), pa.array(gap), *batch.columns[3:]],
                ["dim", "node", "gap", "least", "weight", "unit"])

    return at.mapInArrow(place, PLACED)


def below(kids: dict, dim: int, node: int) -> list[int]:
    """The leaves of a node in order, itself if it isn't split."""
    if (dim, node) not in kids:
        return [node]
    return [leaf for k in kids[dim, node] for leaf in below(kids, dim, k)]


def leaf_pairs(balls: dict, kids: dict, dim: int, a: int, b: int, limit: float) -> set[tuple[int, int]]:
    """Pairs of leaves below two nodes whose balls are within the limit of each other."""
    one, two = (np.array([x for x in below(kids, dim, n) if balls[dim, x].n], int) for n in (a, b))
    if not len(one) or not len(two):
        return set()
    centres, radius = ([np.array([getattr(balls[dim, x], what) for x in side]) for side in (one, two)]
                       for what in ("centre", "radius"))
    cosine = centres[0] @ centres[1].T
    lengths = [(c * c).sum(1) for c in centres]
    gap = np.sqrt(np.maximum(lengths[0][:, None] + lengths[1][None] - 2 * cosine, 0))
    near = np.argwhere(gap - radius[0][:, None] - radius[1][None] <= limit + 1e-7)
    one, two = one.tolist(), two.tolist()
    return {(min(one[i], two[j]), max(one[i], two[j])) for i, j in near.tolist()}


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id",
                 column: str = "embedding", sample: int = SAMPLE, shelf: int = SHELF) -> DataFrame:
    """Per row of ``vectors``: key, ``n_links``, ``component_id`` and ``kept``.

    Two vectors of equal dimension are linked if their cosine in double precision is at
    least ``cosine``. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing. Equal vectors are compared as one and counted as many.
    Rows that repeat a key and a vector count as many, rows that repeat a key with other
    vectors share their links. A row with a null key links with nothing. An empty table gives no
    row. Further columns are ignored, whatever their names.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(v) for v in batch.column(1).to_pylist()]
            raw = [u.tobytes() if u is not None else None for u in units]
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column(0), "unit": pa.array(raw, pa.binary()),
                 "name": pa.array([xxhash.xxh3_128_digest(r) if r else None for r in raw], pa.binary())})

    rows = staged(vectors.select(F.col(key).cast("long").alias("key"), column)
                  .mapInArrow(read, "key long, unit binary, name binary"), "vectors")
    # equal vectors as one, named by their smallest key
    heads = staged(rows.where("name is not null and key is not null").groupBy("name").agg(
        F.min("key").alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
        .withColumn("dim", (F.length("unit") / 8).cast("int")), "heads")
    drawn = heads.orderBy(F.xxhash64("name"), "name").limit(sample).select("dim", "unit").collect()
    dims = sorted({r["dim"] for r in heads.select("dim").distinct().collect()})
    trees = {}
    for dim in dims:
        points = [np.frombuffer(r["unit"]) for r in drawn if r["dim"] == dim]
        points = np.array(points or [np.eye(1, dim)[0]])
        order, _, parent = nets(points)
        trees[dim] = (points[order], parent)
    spark, limit = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    shared = spark.sparkContext.broadcast(trees)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array(batch.column(0).to_pylist())
            unit_ = batch.column(1).to_pylist()
            node, gap = np.zeros(len(dim), int), np.zeros(len(dim))
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                x = np.array([np.frombuffer(unit_[i]) for i in own])
                near = x @ shared.value[int(d)][0].T
                node[own] = near.argmax(1)
                centre = shared.value[int(d)][0][node[own]]
                gap[own] = np.linalg.norm(x - centre, axis=1)
            yield pa.RecordBatch.from_pydict({
                "dim": batch.column(0), "node": pa.array(node, pa.int32()), "gap": gap,
                "least": batch.column(2), "weight": batch.column(3), "unit": batch.column(1)})

    at = staged(heads.select("dim", "unit", "least", "weight").mapInArrow(placed, PLACED), "placed")
    at, measured, kids = deepened(at, {(d, i): c for d in dims for i, c in enumerate(trees[d][0])}, shelf)
    nodes, near = [], []
    for dim in dims:
        centres, parent = trees[dim]
        radius = np.array([measured[dim, i].radius for i in range(len(centres))])
        leaves = [leaf for node in walk(parent) for leaf in below(kids, dim, node)]
        size = {leaf: measured[dim, leaf].n for leaf in leaves}
        # leaves in depth-first order fill shelves; a large one fills several of its own
        start, full = 0, 0
        for node in leaves:
            n = size[node]
            if n and full and full + n > shelf:
                start, full = start + 1, 0
            parts = -(-n // shelf)
            if n:
                nodes.append((dim, node, start, parts))
                full += n
                if parts > 1:
                    start, full = start + parts, 0
        near += [(dim, a, b) for pair in node_pairs(centres, radius, parent, limit)
                 for a, b in leaf_pairs(measured, kids, dim, *pair, limit)]
    node = spark.createDataFrame(nodes, "dim int, node int, start int, parts int")
    shelved = (at.join(F.broadcast(node), ["dim", "node"]).withColumn(
        "shelf", (F.col("start") + F.pmod(F.xxhash64("least"), "parts")).cast("int"))
        .select("dim", "node", "shelf", "least", "weight", "unit"))
    # which shelves meet follows from the pairs of nodes, whose number is bounded
    span = F.sequence("start", F.col("start") + F.col("parts") - 1)
    spans = node.select("dim", "node", span.alias("span"))
    meet = (spark.createDataFrame(near, "dim int, a int, b int")
            .join(spans.select("dim", F.col("node").alias("a"), F.explode("span").alias("s")), ["dim", "a"])
            .join(spans.select("dim", F.col("node").alias("b"), F.explode("span").alias("t")), ["dim", "b"])
            .select("dim", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y")).distinct())
    meet = staged(meet, "meet")
    left = shelved.join(meet.withColumn("shelf", F.col("x")), ["dim", "shelf"])
    right = shelved.join(meet.where("x <> y").withColumn("shelf", F.col("y")), ["dim", "shelf"])
    pairs = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def compared(group: pa.Table) -> pa.Table:
        points = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(len(group), -1)
        own, side = group.column("node").to_numpy(), group.column("side").to_numpy()
        links = Links(group.column("weight").to_numpy())
        trees = [[Node(np.flatnonzero((side == s) & (own == n)), points)
                  for n in np.unique(own[side == s])] for s in (0, 1)]
        alone = group.column("x")[0] == group.column("y")[0]
        together = ([(a, b) for i, a in enumerate(trees[0]) for b in trees[0][i:]] if alone
                    else [(a, b) for a in trees[0] for b in trees[1]])
        for a, b in together:
            traverse(a, b, points, cosine, links)
        least = group.column("least").to_numpy()
        touched = np.flatnonzero(links.counts)
        return pa.table({"a": pa.array(least[touched], pa.int64()),
                         "b": pa.array([least[links.root(i)] for i in touched.tolist()], pa.int64()),
                         "n": pa.array(links.counts[touched], pa.int64())})

    found = staged(pairs.groupBy("dim", "x", "y").applyInArrow(compared, "a long, b long, n long"), "near")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.select("a", "b"))
    each = (heads.select("name", "least", "weight").join(counts, F.col("least") == F.col("a"), "left")
            .join(groups, F.col("least") == F.col("node"), "left")
            .select("name", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("component", "least").alias("component_id")))
    named = matched(rows.where("name is not null and key is not null"), each, ["name"], "weight",
                    rows.count()).select("key", "n_links", "component_id")
    alone = rows.where("name is null or key is null").select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return named.union(alone).select(
        F.col("key").alias(key), "n_links", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))

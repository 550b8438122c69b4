"""Prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its depth and two 64-bit numbers,
the exclusive or of hashes of (position, turn); so a running value per conversation names all
its prefixes, also if one conversation is cut over many tasks. Nodes are an aggregate of the
conversations' rows, pre-aggregated, so a first turn that many share is no large group.

Sums over subtrees are found in components of the parent-edge forest. How much hangs below a
node (rows of rebuilt conversations from it on) is known without walking the tree. With W such
rows, a part of at most B = sqrt(3 * W) of them is a component by itself if the part of its
parent is larger. The nodes above, the heavy ones, fall into centroid paths: a node's level is
the logarithm of what hangs below it, and at most one child has half of it, so nodes of one
level that hang together are a path. There are at most 2 * W / B of them, which are cut every B
nodes. So a component has at most B nodes, and there are at most B heavy ones. Component totals
are aggregated first, the forest of the heavy components is solved next, and its results enter
the components where they hang. Each component, and the forest of components too, is split by
centroids: the centroid's total is added along the path from the centroid to the top, and the
pieces are split in turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.llm.tables import staged
from threadloom.operators import timeline as tl
from threadloom.operators.timeline import Timeline

#: Conversations whose number is in one group of this size share the group's first turns;
#: at most this many of them.
FAMILY, HEAD = 20, 4
#: Nodes a component may have in any case, rows of one conversation per task, ids in a chunk.
LEAST, ROWS, CHUNK = 1024, 200_000, 1 << 16
#: Parents of more than 1 / HOT of all nodes are handed out by broadcast: at most HOT of them.
HOT = 20_000
NODE = ["depth", "a", "b"]
WORD = r"[^\x20\x09-\x0D]+"


def _mark(position: Column, number: int) -> Column:
    """One of the two hashes of a turn at its place in the rebuilt conversation."""
    return F.xxhash64(F.lit(number), position.cast("long"), F.col("t1"), F.col("t2"))


def _xor(value: Column) -> tl.Scan:
    """Exclusive or of all values so far."""
    return tl.Scan(local=lambda w, _: F.bit_xor(value).over(w),
                   carry=lambda c, w: F.bit_xor(c).over(w),
                   merge=lambda before, here: F.coalesce(before, F.lit(0)).bitwiseXOR(here))


def narrow(conversations: DataFrame) -> DataFrame:
    """Per turn what the trie needs: its order, two hashes of role and text, and its words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"),
                    F.timestamp_micros(F.col("turn").cast("long")).alias("ts"),
                    digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
            .select("conv_id", "ts", F.xxhash64(F.lit(1), "digest").alias("t1"),
                    F.xxhash64(F.lit(2), "digest").alias("t2"), "words",
                    F.monotonically_increasing_id().alias("tie")))


def rebuilt(turns: DataFrame, rows_per_task: int = ROWS) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one included.

    ``conv_id``, its node (``depth``, ``a``, ``b``) and the parent's (``pa``, ``pb``), ``words`` of
    the last turn, and ``len``, the number of turns of the whole.
    """
    order = ["ts", "t1", "t2", "tie"]
    timeline = Timeline(keys=("conv_id",), ts="ts", seq=("t1", "t2", "tie")).measured(
        turns, rows_per_task)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    first = (turns.withColumn("rank", rank).where(F.col("rank") < HEAD)
             .groupBy("conv_id").agg(F.array_sort(F.collect_list(
                 F.struct("rank", "t1", "t2", "words"))).alias("head")))
    bases = first.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    size = F.size("head").cast("long")
    # one row per conversation; a base has at most FAMILY of them
    known = (turns.groupBy("conv_id").agg(F.count("*").alias("n"))
             .withColumn("h", shared).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
             .join(bases, "base", "left")
             .withColumn("head", F.expr("slice(coalesce(base_head, array()), 1, h)"))
             .select("conv_id", "h", "head", size.alias("m"),
                     (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    known = known.select("*", *[_after(i, F.size("head")).alias(f"x{i}") for i in (1, 2)])
    heads = (known.select("conv_id", "len", "head", F.explode(F.sequence(
                F.lit(0), F.size("head"))).alias("at"))
             .select("conv_id", F.col("at").cast("long").alias("depth"),
                     *[_after(i, F.col("at")).alias(n) for i, n in ((1, "a"), (2, "b"))],
                     *[F.when(F.col("at") > 0, _after(i, F.col("at") - 1)).alias(n)
                       for i, n in ((1, "pa"), (2, "pb"))],
                     F.when(F.col("at") > 0, F.expr("head[at - 1].words")).otherwise(0).alias("words"),
                     "len"))
    place = timeline.running(turns, {"pos": tl.count()}, per_key=known.drop("head"))
    own = (place.where("pos > h").withColumn("depth", F.expr("pos - h + m"))
           .withColumns({f"g{i}": _mark(F.col("depth"), i) for i in (1, 2)}))
    own = timeline.running(own, {f"s{i}": _xor(F.col(f"g{i}")) for i in (1, 2)})
    name = [F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)]
    own = own.select("conv_id", "depth", name[0].alias("a"), name[1].alias("b"),
                     name[0].bitwiseXOR(F.col("g1")).alias("pa"),
                     name[1].bitwiseXOR(F.col("g2")).alias("pb"), "words", "len")
    return heads.unionByName(own)


def _after(number: int, turns: Column) -> Column:
    """Exclusive or of the marks of the first ``turns`` turns of ``head``."""
    marks = F.transform(F.slice("head", F.lit(1), turns.cast("int")), lambda e: F.xxhash64(
        F.lit(number), e["rank"].cast("long"), e["t1"], e["t2"]))
    return F.aggregate(marks, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


# -- components ----------------------------------------------------------------

def centroid_sums(parent: list[int], values: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sum of ``values`` over the subtree of every node of a forest, by its centroids.

    ``parent`` is the place of each node's parent, which comes before it; -1 for a top.
    """
    n, kinds = len(parent), len(values[0]) if values else 0
    sums = [[0] * n for _ in range(kinds)]
    label, size = [0] * n, [0] * n
    trees: dict[int, list[int]] = {}
    for v, p in enumerate(parent):
        label[v] = label[p] if p >= 0 else v
        trees.setdefault(label[v], []).append(v)
    todo = list(trees.values())
    while todo:
        nodes = todo.pop()
        if len(nodes) == 1:
            v = nodes[0]
            for s, x in zip(sums, values[v]):
                s[v] += x
            continue
        top = nodes[0]
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes):
            if v != top:
                size[parent[v]] += size[v]
        # the nodes with half of the component below them are a chain; the last is the centroid
        half = (len(nodes) + 1) // 2
        centre = top
        for v in nodes:
            if size[v] >= half:
                centre = v
        pieces: dict[int, list[int]] = {}
        below = [0] * kinds
        label[top] = top
        for v in nodes:
            p = parent[v]
            if v != top:
                label[v] = v if p == centre or v == centre else label[p]
            mine = label[v]
            if v != centre:
                pieces.setdefault(mine, []).append(v)
            # the pieces that hang on the centroid, and the centroid itself
            if v == centre or mine != top or centre == top:
                for k in range(kinds):
                    below[k] += values[v][k]
        v = centre
        while True:
            for k in range(kinds):
                sums[k][v] += below[k]
            if v == top:
                break
            v = parent[v]
        todo.extend(pieces.values())
    return list(zip(*sums)) if kinds else []


VALUES = ["n_leaves", "saved_tokens"]


def solved(rows: DataFrame, component: list[str]) -> DataFrame:
    """The two values summed over the subtrees of each component's nodes, as texts.

    ``rows`` has the columns of ``component``, a node, its parent and the two values as texts.
    A task holds one component of size at a time, or several small ones.
    """
    width = len(component)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != current and len(held) >= LEAST:
                    yield answer(held)
                    held = []
                current = row[:width]
                held.append(row)
        if held:
            yield answer(held)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        place, parent, values = {}, [], []
        for i, row in enumerate(rows):
            depth, a, b, up_a, up_b, leaves, saved = row[width:]
            place[row[:width], depth, a, b] = i
            parent.append(place.get((row[:width], depth - 1, up_a, up_b), -1))
            values.append((int(leaves), int(saved)))
        sums = centroid_sums(parent, values)
        keys = list(zip(*(row[width:width + 3] for row in rows)))
        return pa.RecordBatch.from_pydict({
            **{n: pa.array(k, pa.int64()) for n, k in zip(NODE, keys)},
            "n_leaves": [str(s[0]) for s in sums], "saved_tokens": [str(s[1]) for s in sums]})

    return (rows.select(*component, *NODE, "pa", "pb", *VALUES).repartition(*component)
            .sortWithinPartitions(*component, "depth")
            .mapInArrow(solve, "depth long, a long, b long, n_leaves string, saved_tokens string"))


def forest(parts: DataFrame) -> DataFrame:
    """``parts`` with their values summed over all parts that hang below them.

    One task holds them all: there are at most B, see above. ``part`` and ``parent`` are texts,
    ``depth`` orders parents before children.
    """
    names = ["part", "parent", "depth", "pa", "pb", *VALUES]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))),
                      key=lambda row: row[2])
        if rows:
            place = {row[0]: i for i, row in enumerate(rows)}
            sums = centroid_sums([place.get(row[1], -1) for row in rows],
                                 [(int(row[5]), int(row[6])) for row in rows])
            yield pa.RecordBatch.from_pydict({
                **{n: pa.array([row[k] for row in rows], pa.int64())
                   for k, n in ((2, "depth"), (3, "pa"), (4, "pb"))},
                **{v: [str(s[k]) for s in sums] for k, v in enumerate(VALUES)}})

    return parts.select(*names).repartition(1).mapInArrow(
        solve, "depth long, pa long, pb long, n_leaves string, saved_tokens string")


def _sums(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The values, which are texts, summed by ``keys``."""
    return rows.groupBy(*keys).agg(*[F.sum(F.col(v).cast("decimal(38,0)")).cast("string").alias(v)
                                     for v in VALUES], *more)


def _added(nodes: DataFrame, hanging: DataFrame) -> DataFrame:
    """The values of ``nodes`` with those of ``hanging`` added, which names their nodes."""
    more = _sums(hanging, NODE).withColumnsRenamed({v: f"_{v}" for v in VALUES})
    both = {v: (F.col(v).cast("decimal(38,0)") + F.coalesce(F.col(f"_{v}"), F.lit("0"))
                .cast("decimal(38,0)")).cast("string") for v in VALUES}
    return nodes.join(more, NODE, "left").withColumns(both).drop(*more.columns[len(NODE):])


def _above() -> list[Column]:
    """The node a row's node hangs on."""
    return [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]


def rollup(nodes: DataFrame, rows: DataFrame, total: int, least: int = LEAST) -> DataFrame:
    """A node's two sums over its subtree; ``nodes`` as ``linked`` gives them.

    ``total`` is the number of ``rows`` that ``rebuilt`` gave. Every node learns its component
    from its smallest member: on the way down a conversation meets one top of a light
    component at most, and one centroid path of each level.
    """
    most = max(least, math.isqrt(3 * total) + 1)
    heavy = F.col("below") > most
    top = ~heavy & ((F.col("depth") == 0) | (F.col("parent_below") > most))
    values = (nodes.withColumn("level", F.when(heavy, F.floor(F.log2("below"))).otherwise(-1))
              .withColumn("n_leaves", (F.col("n_children") == 0).cast("int").cast("string"))
              .withColumn("saved_tokens", ((F.col("n_convs") - 1).cast("decimal(19,0)")
                                           * F.col("words").cast("decimal(19,0)")).cast("string")))
    met = values.where(heavy | top).select(*NODE, "level", "n_convs")
    # the rows of a node of many conversations don't meet in one task: at most HOT such nodes
    crowd = max(most, total // HOT)
    many = F.broadcast(met.where(F.col("n_convs") > crowd).drop("n_convs"))
    passed = rows.select("conv_id", *NODE)
    seen = passed.join(many, NODE).unionByName(
        passed.join(many.drop("level"), NODE, "left_anti").join(met.drop("n_convs"), NODE))
    block = F.expr(f"depth div {most}")
    ways = (seen.groupBy("conv_id", "level").agg(
        F.min(F.struct(*NODE)).alias("top"), F.max("depth").alias("last"))
        .select("conv_id", "level", *[F.col(f"top.{c}").alias(f"top_{c}") for c in NODE],
                F.explode(F.when(F.col("level") < 0, F.array(F.lit(0).cast("long"))).otherwise(
                    F.sequence(F.expr(f"top.depth div {most}"), F.expr(f"last div {most}"))))
                .alias("block")))
    part = ["top_depth", "top_a", "top_b", "block"]
    placed = staged(values.withColumn("block", F.when(F.col("level") < 0, 0).otherwise(block))
                    .join(ways, ["conv_id", "level", "block"])
                    .select(*part, "level", *NODE, "pa", "pb", *VALUES), "placed")
    low = staged(solved(placed.where("level < 0"), part), "light-sums")
    tops = placed.where("level < 0 and depth = top_depth and depth > 0").select(*NODE, "pa", "pb")
    hanging = low.join(tops, NODE).select(*_above(), *VALUES)
    upper = staged(_added(placed.where("level >= 0"), hanging), "heavy-nodes")
    # the forest of heavy components
    start = F.min(F.struct("depth", "pa", "pb")).alias("start")
    parts = _sums(upper, part, start).select(*part, "start.*", *VALUES)
    named = F.concat_ws("/", *part)
    homes = upper.select(F.col("depth").alias("home"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                         named.alias("parent"))
    parts = (parts.withColumn("home", F.col("depth") - 1).withColumn("part", named)
             .join(homes, ["home", "pa", "pb"], "left")
             .select("part", "parent", "depth", "pa", "pb", *VALUES))
    ports = forest(parts).where("depth > 0").select(*_above(), *VALUES)
    high = solved(_added(upper, ports), part)
    return low.unionByName(high).select(*NODE, *[F.col(v).cast("decimal(38,0)").cast("long").alias(v)
                                                 for v in VALUES])


# -- nodes ---------------------------------------------------------------------

def linked(rows: DataFrame) -> DataFrame:
    """Nodes with their members, children, what hangs below them, and their parent's part."""
    nodes = staged(rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        (F.sum("len") - F.count("*") * (F.col("depth") - 1)).alias("below"),
        F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb")), "nodes")
    up = ["up", "pa", "pb"]
    children = nodes.where("depth > 0").groupBy(*_above()).agg(F.count("*").alias("n_children"))
    nodes = (nodes.join(children, NODE, "left").fillna(0, ["n_children"])
             .withColumn("up", F.col("depth") - 1))
    parents = nodes.select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                           F.col("conv_id").alias("parent_conv_id"),
                           F.col("below").alias("parent_below"), F.col("n_children").alias("brood"))
    # the children of a node of many don't meet in one task: at most HOT such parents
    crowd = max(LEAST, nodes.count() // HOT)
    many = F.broadcast(parents.where(F.col("brood") > crowd))
    return staged(nodes.join(many, up).unionByName(
        nodes.join(many.select(*up), up, "left_anti").join(parents, up, "left")).drop("brood", "up"),
        "linked-nodes")


def endings(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which conversations end.

    The ids of a node are sorted over many tasks, which pack them into chunks of text; a hash
    has to see them in order, so one task reads the chunks of a node, one at a time.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) >= CHUNK:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = key, []
                ids.append(conv)
            if out:
                yield chunks(out)
        if ids:
            yield chunks([(*node, ids[0], ",".join(map(str, ids)))])

    def chunks(out: list[tuple]) -> pa.RecordBatch:
        *numbers, text = zip(*out)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(n, pa.int64()) for n in numbers), pa.array(text, pa.string())],
            [*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield digests(out)
        if sha:
            yield digests([(*node, sha.hexdigest())])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        *numbers, text = zip(*out)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(n, pa.int64()) for n in numbers), pa.array(text, pa.string())],
            [*NODE, "ends_sha256"])

    last = rows.where("depth = len").select(*NODE, "conv_id")
    packed = (last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
              .mapInArrow(pack, "depth long, a long, b long, first long, ids string"))
    return (packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").drop("first")
            .mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string"))


def trie(conversations: DataFrame, least: int = LEAST, rows_per_task: int = ROWS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 (all it has,
    none if it is absent) and its own turns after the first h, h being crc32(decimal c) % 4.
    Turns are in order of ``turn``, null first; turns of equal ``turn``, repeated rows too, in
    the order of two hashes of role and text, so always the same. A null role or text is an
    empty one. Rows with a null conv_id belong to no conversation and are left out. A
    conversation without rebuilt turns is a member of the root and ends there. An empty table
    has no node. Further columns are ignored. ``conv_id`` and ``depth`` name a node.
    """
    turns = staged(narrow(conversations), "turns")
    rows = staged(rebuilt(turns, rows_per_task), "prefixes")
    nodes = linked(rows)
    sums = rollup(nodes, rows, rows.count(), least)
    return (nodes.join(sums, NODE).join(endings(rows), NODE, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
                    .alias("ends_sha256")))

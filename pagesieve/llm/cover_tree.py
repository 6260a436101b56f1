"""Embedding near-dedup: cover trees and a dual traversal, exact for a cosine threshold.

On unit vectors the cosine is a distance: cos >= t is the same as a chord of at most
sqrt(2 - 2t), and chords obey the triangle inequality. So two nodes of a cover tree whose
centres are further apart than both covering radii and that chord have no link between
them, and two that are close enough have all of them.

Equal vectors are one point with a weight. The upper levels of the trees are Spark
tables: a node with too many points is split around a net of centres, whose separation
halves from level to level; points go to their nearest centre in salted groups, so one
large label is many tasks. The centres are picked from a bounded, documented sample of
the node (``CENTRES``); the covering radii are measured over all points, so the choice
decides how much is pruned and never what is found. The traversal goes down level by
level and keeps the node pairs that the bounds leave. Of each pair of lowest nodes,
which are blocks of bounded size, one task builds the two trees further down and
traverses them together.

Only counts and the edges of a spanning forest leave a task, never all pairs of a group.

Defined results
    label null; vector null, empty, zero, or with a null or non-finite component;
    vec_id null              linked with nothing, component_id = vec_id, kept
    vectors of other length  not compared, like those of another label
    repeated rows            equal vectors, so linked with each other
    columns of other names   not read
    empty table              no rows
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.components import components
from pagesieve.llm.storage import stored

#: Parameters: the threshold; points of a block, about; most centres of a split; the
#: levels of a tree above its blocks; points of a leaf.
COSINE = 0.98
BLOCK = 4096
CENTRES = 64
LEVELS = 6
LEAF = 32
_SLACK = 1e-9


def unit_rows(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix in double precision, and its rows scaled to length 1."""
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return raw, raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


class Node:
    """Points around a centre: ``radius`` covers them all; a leaf has no children."""

    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, units: np.ndarray, points: np.ndarray, centre: int, reach: float):
        self.centre, self.points, self.children = units[centre], points, []
        gap = _chords(units[points], self.centre)
        self.radius = float(gap.max())
        if len(points) <= LEAF or self.radius == 0:
            return
        while reach / 2 > self.radius:
            reach /= 2
        left, first, parts = points, centre, []
        while len(left):
            near = _chords(units[left], units[first]) <= reach / 2
            near |= left == first
            parts.append((first, left[near]))
            left = left[~near]
            if len(parts) == LEAF and len(left) > len(points) // 2:
                return  # the net is as fine as the points; levels would not prune
            first = int(left[0]) if len(left) else -1
        if len(parts) > 1 or reach > 1e-6:
            self.children = [Node(units, p, c, reach / 2) for c, p in parts]


def _chords(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((rows - centre) ** 2).sum(axis=-1), 0))


class Links:
    """What a dual traversal finds: weighted link counts, and which points hang together."""

    def __init__(self, raw: np.ndarray, units: np.ndarray, weights: np.ndarray):
        self.raw, self.units, self.weights = raw, units, weights
        self.counts = np.zeros(len(units), np.int64)
        self.group = np.arange(len(units))
        self.chord = math.sqrt(2 - 2 * COSINE)

    def traverse(self, top: Node, other: Node) -> None:
        stack = [(top, other)]
        while stack:
            a, b = stack.pop()
            gap = float(np.sqrt(((a.centre - b.centre) ** 2).sum()))
            if gap > a.radius + b.radius + self.chord + _SLACK:
                continue
            if gap + a.radius + b.radius < self.chord - _SLACK or not (a.children or b.children):
                self._compare(a, b, all_linked=gap + a.radius + b.radius < self.chord - _SLACK)
            elif a is b:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            elif a.children and (not b.children or a.radius >= b.radius):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, y) for y in b.children]

    def _compare(self, a: Node, b: Node, all_linked: bool) -> None:
        p, q = a.points, b.points
        if all_linked:
            self._count(p, q, self.weights[q].sum(), self.weights[p].sum(), a is b)
            self._join(np.concatenate([p, q]))
            return
        for begin in range(0, len(p), 1024):
            part = p[begin : begin + 1024]
            cosine = self.units[part] @ self.units[q].T
            linked = cosine >= COSINE
            for i, j in np.argwhere(np.abs(cosine - COSINE) < _SLACK):
                x, y = self.raw[part[i]], self.raw[q[j]]
                linked[i, j] = x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= COSINE
            if a is b:
                linked[np.arange(len(part)), begin + np.arange(len(part))] = True
            rows = np.flatnonzero(linked.any(axis=1))
            self._count(part, q, linked @ self.weights[q], self.weights[part] @ linked, a is b)
            for i in rows.tolist():
                self._join(np.append(q[linked[i]], part[i]))

    def _count(self, p: np.ndarray, q: np.ndarray, of_p, of_q, same: bool) -> None:
        """Add what p has in q and the other way round; a node with itself counts once."""
        self.counts[p] += of_p - (self.weights[p] if same else 0)
        if not same:
            self.counts[q] += of_q

    def _join(self, points: np.ndarray) -> None:
        groups = np.unique(self.group[points])
        if len(groups) > 1:
            self.group[np.isin(self.group, groups)] = groups[0]


def _comparable() -> Column:
    """Whether a row of ``vec_id, label, embedding`` can have links; never null."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of ``vectors (vec_id, embedding, label)``."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>").alias("embedding")
    )
    good = rows.filter(_comparable()).withColumn(
        "point",
        F.concat(F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64("embedding", "label"))),
    )
    points = stored(
        good.groupBy("point", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("tree", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding"))),
        "cover-points",
    )
    blocks, pairs = _blocks(points)
    found = stored(_linked(blocks, pairs), "cover-links")
    counts = found.groupBy("point").agg(F.sum("n").alias("n"))
    roots = components(found.filter(F.col("point") != F.col("other")), "point", "other")
    placed = (
        points.select("point", "rep", "weight")
        .join(counts, "point", "left")
        .join(roots.withColumnRenamed("node", "point"), "point", "left")
        .withColumn("root", F.coalesce("root", "point"))
    )
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "root").select(
        "point", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    ids = good.select("vec_id", "point").join(named, "point").select("vec_id", "n_links", "component_id")
    rest = rows.filter(~_comparable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return ids.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_SPLIT = "node string, point string, gap double"


def _assigned(key, points: pa.Table, nets: pa.Table) -> pa.Table:
    """Each point of a salted group with the nearest centre of its node."""
    if not points.num_rows or not nets.num_rows:
        return pa.table({"node": pa.array([], pa.string()), "point": pa.array([], pa.string()), "gap": pa.array([], pa.float64())})
    _, units = unit_rows(points["embedding"])
    _, centres = unit_rows(nets["embedding"])
    nearest = (units @ centres.T).argmax(axis=1)
    names = np.array(nets["child"].to_pylist(), object)[nearest]
    gaps = _chords(units, centres[nearest])
    return pa.table({"node": pa.array(names, pa.string()), "point": points["point"], "gap": gaps})


def _net(separation: float):
    """Of a node's sampled points those that are ``separation`` apart, as its centres."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        _, units = unit_rows(table["embedding"])
        chosen: list[int] = []
        for i in range(len(units)):
            if not chosen or _chords(units[chosen], units[i]).min() > separation:
                chosen.append(i)
        names = [f"{n}/{i}" for i, n in enumerate(table["node"].take(chosen).to_pylist())]
        return table.take(chosen).select(["node", "embedding"]).append_column("child", pa.array(names))

    return run


def _blocks(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with their block, and the pairs of blocks that may have links (a <= b)."""
    placed = stored(points.select("tree", F.col("tree").alias("node"), "point", "weight", "embedding"), "cover-nodes")
    pairs = placed.select("node").distinct().select(F.col("node").alias("a"), F.col("node").alias("b"))
    separation = 1.0
    for level in range(LEVELS):
        sizes = placed.groupBy("node").agg(F.count("*").alias("n"))
        large = stored(sizes.filter(F.col("n") > BLOCK), "cover-large")
        if large.isEmpty():
            break
        wanted = F.least(F.ceil(F.col("n") * 2 / BLOCK), F.lit(CENTRES))
        rank = F.pmod(F.xxhash64("point", F.lit(level)), F.lit(1 << 30))
        sampled = placed.join(large, "node").filter(rank * F.col("n") < wanted * (1 << 30))
        nets = stored(
            sampled.select("node", "point", "embedding")
            .groupBy("node")
            .applyInArrow(_net(separation), "node string, embedding array<float>, child string"),
            "cover-nets",
        )
        split = nets.select("node").distinct()
        salts = F.ceil(F.col("n") / BLOCK).cast("int")
        salted = placed.join(large.join(split, "node"), "node").withColumn("salt", F.pmod(F.xxhash64("point"), salts))
        copies = nets.join(large, "node").withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))
        )
        moved = (
            salted.select("node", "salt", "point", "embedding")
            .groupBy("node", "salt")
            .cogroup(copies.select("node", "salt", "child", "embedding").groupBy("node", "salt"))
            .applyInArrow(_assigned, _SPLIT)
        )
        moved = stored(moved, "cover-moved")
        reach = moved.groupBy("node").agg(F.max("gap").alias("radius"))
        children = stored(
            nets.select(F.col("node").alias("parent"), F.col("child").alias("node"), "embedding").join(reach, "node"),
            "cover-children",
        )
        placed = stored(
            placed.join(moved.select(F.col("node").alias("to"), "point"), "point", "left")
            .withColumn("node", F.coalesce("to", "node"))
            .drop("to"),
            "cover-nodes",
        )
        pairs = stored(_descended(pairs, children), "cover-pairs")
        separation /= 2
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sizes = stored(sizes, "cover-sizes")
    block = F.concat_ws("#", "node", F.pmod(F.xxhash64("point"), F.col("parts")).cast("string"))
    blocks = placed.join(sizes, "node").withColumn("block", block)
    parts = sizes.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    named = parts.select("node", F.concat_ws("#", "node", F.col("k").cast("string")).alias("block"))
    side = lambda n: named.select(F.col("node").alias(n), F.col("block").alias(f"block_{n}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    out = out.filter((F.col("a") != F.col("b")) | (F.col("block_a") <= F.col("block_b")))
    return blocks, out.select("block_a", "block_b")


def _descended(pairs: DataFrame, children: DataFrame) -> DataFrame:
    """The next level of the traversal: pairs of children that the bounds leave.

    A node that was not split stands for itself; its bounds were tested before, with a
    radius of at most those of its parents.
    """

    def down(of: str) -> DataFrame:
        return children.select(
            F.col("parent").alias(of),
            F.col("node").alias(f"{of}_child"),
            F.col("embedding").alias(f"{of}_centre"),
            F.col("radius").alias(f"{of}_radius"),
        )

    both = pairs.join(down("a"), "a", "left").join(down("b"), "b", "left")
    both = both.withColumn("x", F.coalesce("a_child", "a")).withColumn("y", F.coalesce("b_child", "b"))
    both = both.filter((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + t * t))
    dot = F.aggregate(
        F.zip_with(double("a_centre"), double("b_centre"), lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t
    )
    cosine = dot / (length(double("a_centre")) * length(double("b_centre")))
    gap = F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0)))
    chord = math.sqrt(2 - 2 * COSINE)
    far = gap > F.col("a_radius") + F.col("b_radius") + chord + 1e-6
    return both.filter(~F.coalesce(far, F.lit(False))).select(F.col("x").alias("a"), F.col("y").alias("b"))


_FOUND = "point string, other string, n long"


def _pair_links(table: pa.Table) -> pa.Table:
    """Counts and forest edges of one pair of blocks, by a dual traversal of their trees."""
    table = table.sort_by([("side", "ascending"), ("point", "ascending")])
    raw, units = unit_rows(table["embedding"])
    links = Links(raw, units, table["weight"].to_numpy())
    sides = table["side"].to_numpy()
    trees = [Node(units, p, int(p[0]), 2.0) for s in (0, 1) if len(p := np.flatnonzero(sides == s))]
    if sides.min() == 0 and (len(trees) == 2 or table["alone"][0].as_py()):
        links.traverse(trees[0], trees[-1])
    names = table["point"].to_pylist()
    some = np.flatnonzero((links.counts > 0) | (links.group != np.arange(len(units))))
    return pa.table(
        {
            "point": pa.array([names[i] for i in some], pa.string()),
            "other": pa.array([names[i] for i in links.group[some]], pa.string()),
            "n": pa.array(links.counts[some], pa.int64()),
        }
    )


def _linked(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """``point, other, n``: links that a task counted for a point, and a forest edge."""
    own = blocks.select("block", "point", "weight", "embedding")
    alone = F.col("block_a") == F.col("block_b")
    first = pairs.select(F.col("block_a").alias("block"), "block_a", "block_b", alone.alias("alone"), F.lit(0).alias("side"))
    second = pairs.filter(~alone).select(
        F.col("block_b").alias("block"), "block_a", "block_b", F.lit(False).alias("alone"), F.lit(1).alias("side")
    )
    return own.join(first.unionByName(second), "block").drop("block").groupBy("block_a", "block_b").applyInArrow(_pair_links, _FOUND)

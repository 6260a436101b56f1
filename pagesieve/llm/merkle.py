"""A Merkle manifest of a table: one root digest, and a proof for every row.

Every row is a leaf, the digest of its fields. The leaves of a group (a language) are
ordered; every eight neighbours become one node, level by level, until one is left. The
groups' last nodes, ordered by group, become the root in the same way.

The trees are kept as content-addressed records, digest to children. Four levels, 4096
places, are built and read together: a record names the digest at the top of its
segment, so that the records of a segment are found by one digest. A request for a leaf
descends from the root by the digits of its rank in base eight, takes down the children
that it does not enter, and turns the segments of that path around to get the proof.
Requests that share an upper path share its descent.

Ranks come from one sort by ranges and a running sum over the sizes of the ranges, so a
group may hold any share of the rows.

Defined results
    null in a field         written as "-", which no other value gives
    null group              a group of its own, before all others
    null order, ties        null first; equal orders by the leaf's digest
    repeated rows           every row is a leaf and has a proof
    empty and long texts    digested whole
    other columns           come back with the proofs; clashing ones are replaced by the new ones
    empty table             no proofs; the manifest has no root
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.storage import stored

FAN = 8
#: Levels that are built and read together, and the places below them.
HEIGHT = 4
SEGMENT = FAN**HEIGHT

#: Columns that the proofs add to a leaf's own.
PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Manifest(NamedTuple):
    """``leaves(tree, pos, n, leaf, claim, row)``, ``trees(tree, place, n, subroot)``,
    ``records(top, digest, children)`` and the root, None if there is no leaf."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: bytes | None
    most: int
    n_trees: int


def field(value: Column) -> Column:
    """``value`` with its length in bytes, so that no two rows give the same text."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def manifest(rows: DataFrame, group: str, order: str, carried: Sequence[str] = ()) -> Manifest:
    """The manifest of ``rows``, which have ``leaf`` and ``claim`` (digests as binary).

    ``claim`` is what a holder of the row shows when the proof is checked, null for the
    leaf itself. ``carried`` columns come along to the proofs.
    """
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("order"),
        "leaf",
        "claim",
        F.struct(*carried, F.lit(0).alias("_")).alias("row"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = ranked(stored(leaves, "leaves"), ["tree"], ["order", "leaf", "tie"])
    nodes = leaves.select("tree", "pos", "n", F.col("leaf").alias("digest"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, records = built(nodes, most)
    trees = ranked(stored(tops, "subroots"), [], ["tree"])
    n_trees = trees.count()
    roots, upper = built(
        trees.select(F.lit("").alias("tree"), "pos", "n", "digest"), n_trees
    )
    sizes = leaves.filter("pos = 0").select("tree", "n")
    trees = trees.select("tree", F.col("pos").alias("place"), F.col("digest").alias("subroot"))
    root = roots.first()
    return Manifest(
        leaves.drop("order", "tie"),
        stored(trees.join(sizes, "tree"), "trees"),
        reduce(DataFrame.union, [*records, *upper]) if records or upper else _no_records(rows),
        bytes(root.digest) if root else None,
        most,
        n_trees,
    )


def _no_records(df: DataFrame) -> DataFrame:
    schema = "top binary, digest binary, children array<binary>"
    return df.sparkSession.createDataFrame([], schema)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the rank in its group from 0, and ``n``, the group's size.

    ``monotonically_increasing_id`` holds the range and the place in it. What stands
    before a range comes from the sizes of the ranges alone.
    """
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("range", F.shiftright("at", 33))
    sizes = placed.groupBy(*group, "range").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("size")
    )
    all_of_group = Window.partitionBy(*group)
    before = all_of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *group,
        "range",
        "first",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
        F.sum("size").over(all_of_group).alias("n"),
    )
    ranks = placed.join(sizes, [*group, "range"])
    return ranks.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop(
        "at", "range", "first", "before"
    )


def built(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of every tree, and the records of all nodes above ``nodes``.

    ``nodes`` has ``tree``, ``pos``, ``n`` (nodes of the tree) and ``digest``; ``most`` is
    the largest ``n``.
    """
    records = []
    while most > 1:
        segment = F.floor(F.col("pos") / SEGMENT)
        made = stored(
            nodes.filter("n > 1").groupBy("tree", segment.alias("segment")).applyInArrow(
                _segment_records,
                "tree string, pos long, n long, top binary, digest binary, children array<binary>",
            ),
            "records",
        )
        records.append(made.filter("children IS NOT NULL").select("top", "digest", "children"))
        tops = made.filter("children IS NULL").select("tree", "pos", "n", F.col("top").alias("digest"))
        nodes = nodes.filter("n = 1").select("tree", "pos", "n", "digest").union(tops)
        most = -(-most // SEGMENT)
    return nodes.select("tree", "digest"), records


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def _hex_digest(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _segment_records(nodes: pa.Table) -> pa.Table:
    """All records of one segment, and a row without children for its top."""
    nodes = nodes.sort_by("pos")
    tree, pos, n = (nodes.column(c)[0].as_py() for c in ("tree", "pos", "n"))
    row, made = nodes.column("digest").to_pylist(), []
    for _ in range(min(HEIGHT, levels(n))):
        runs = [row[i : i + FAN] for i in range(0, len(row), FAN)]
        row = [_hex_digest(run) for run in runs]
        made += zip(row, runs, strict=True)
    size = len(made) + 1
    return pa.table(
        {
            "tree": pa.array([tree] * size, pa.string()),
            "pos": pa.array([pos // SEGMENT] * size, pa.int64()),
            "n": pa.array([-(-n // SEGMENT)] * size, pa.int64()),
            "top": pa.array(row * size, pa.binary()),
            "digest": pa.array([*(d for d, _ in made), None], pa.binary()),
            "children": pa.array([*(c for _, c in made), None], pa.list_(pa.binary())),
        }
    )


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The proof of every leaf, checked against what its holder shows (``claim``).

    ``requests`` are some rows of ``m.leaves``; None asks for all of them.
    """
    wanted = m.leaves if requests is None else requests
    if m.root is None:
        carried = wanted.select("row.*").drop("_")
        return carried.select("*", *(F.lit(None).cast(t).alias(c) for c, t in _fields(PROOF)))
    spark = wanted.sparkSession
    start = spark.createDataFrame(
        [("", 0, m.root, [], m.root)],
        "tree string, pos long, cursor binary, path array<binary>, subroot binary",
    )
    places = m.trees.select(F.lit("").alias("tree"), F.col("place").alias("pos"))
    to_trees = start
    for k in reversed(range(_rounds(m.n_trees))):
        to_trees = _entered(m, to_trees, places, k)
    frontier = stored(
        m.trees.join(
            to_trees.select(F.col("pos").alias("place"), "cursor", "path"), "place"
        ).select("tree", "n", "cursor", "path", "subroot"),
        "paths",
    )
    start_at = reduce(
        lambda left, k: F.when(F.col("n") > SEGMENT**k, k + 1).otherwise(left),
        range(1, _rounds(m.most)),
        F.lit(1),
    )
    top = F.lit(0).cast("long").alias("pos")
    starts = frontier.select("tree", top, "cursor", "path", "subroot", start_at.alias("round"))
    return _leaf_proofs(m, starts, wanted)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(", ")]


def _rounds(n: int) -> int:
    """Segments on the way from the top of a tree of ``n`` leaves to a leaf, at least one."""
    return max(1, -(-levels(n) // HEIGHT))


def _entered(m: Manifest, frontier: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """One segment further down: cursors and paths of the places asked for in round ``k``."""
    at = places.select("tree", F.floor(F.col("pos") / SEGMENT**k).alias("pos")).distinct()
    asked = at.withColumn("segment", F.floor(F.col("pos") / SEGMENT))
    return stored(
        asked.groupBy("tree", "segment").cogroup(
            _segments(m, frontier).groupBy("tree", "segment")
        ).applyInArrow(
            _paths, "tree string, pos long, cursor binary, path array<binary>, subroot binary"
        ),
        "paths",
    )


def _segments(m: Manifest, frontier: DataFrame) -> DataFrame:
    """The rows of ``frontier`` and, beside each, the records of the segment below it."""
    here = frontier.select("tree", F.col("pos").alias("segment"), "cursor", "path", "subroot")
    below = here.select("tree", "segment", F.col("cursor").alias("top")).join(m.records, "top")
    return here.select(
        "tree", "segment", "cursor", "path", "subroot",
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<binary>").alias("children"),
    ).union(
        below.select(
            "tree", "segment", F.lit(None).cast("binary"), F.lit(None).cast("array<binary>"),
            F.lit(None).cast("binary"), "digest", "children",
        )
    )


class _Segment:
    """The records below one cursor, and the way to it."""

    def __init__(self, rows: pa.Table):
        self.children, self.cursor, self.above, self.subroot = {}, None, [], None
        for r in rows.select(["cursor", "path", "subroot", "digest", "children"]).to_pylist():
            if r["digest"] is None:
                self.cursor, self.above, self.subroot = r["cursor"], r["path"], r["subroot"]
            else:
                self.children[r["digest"]] = r["children"]
        self.depth, node = 0, self.cursor
        while node in self.children:
            node, self.depth = self.children[node][0], self.depth + 1

    def descend(self, rank: int) -> tuple[bytes, list[bytes]]:
        """What stands at ``rank``, and the path to it from the cursor.

        A step of the path is the digit taken and then the children that were not.
        """
        node, path = self.cursor, []
        for level in reversed(range(self.depth)):
            digit = rank // FAN**level % FAN
            kids = self.children[node]
            path.append(bytes([digit]) + b"".join(kids[:digit] + kids[digit + 1 :]))
            node = kids[digit]
        return node, path


def _paths(asked: pa.Table, rows: pa.Table) -> pa.Table:
    out: dict[str, list] = {"tree": [], "pos": [], "cursor": [], "path": [], "subroot": []}
    if asked.num_rows and rows.num_rows:
        segment = _Segment(rows)
        for tree, pos in zip(*(asked.column(c).to_pylist() for c in ("tree", "pos")), strict=True):
            node, path = segment.descend(pos % SEGMENT)
            for c, v in zip(out, (tree, pos, node, segment.above + path, segment.subroot), strict=True):
                out[c].append(v)
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})


def _leaf_proofs(m: Manifest, starts: DataFrame, wanted: DataFrame) -> DataFrame:
    frontier = starts.filter(F.col("round") > _rounds(m.most)).drop("round")
    for k in reversed(range(1, _rounds(m.most))):
        here = starts.filter(F.col("round") == k + 1).drop("round").union(frontier)
        frontier = _entered(m, here, wanted.select("tree", "pos"), k)
    frontier = starts.filter("round = 1").drop("round").union(frontier)
    root = m.root

    def proven(asked: pa.Table, rows: pa.Table) -> pa.Table:
        segment = _Segment(rows)
        upper = [(s[0], s[1:].hex().encode()) for s in segment.above]
        found = {c: [] for c, _ in _fields(PROOF)}
        for pos, leaf, claim in zip(
            *(asked.column(c).to_pylist() for c in ("pos", "leaf", "claim")), strict=True
        ):
            node, path = segment.descend(pos % SEGMENT)
            if node != leaf:
                raise ValueError(f"the manifest does not hold the leaf at {pos}")
            steps = upper + [(s[0], s[1:].hex().encode()) for s in path]
            steps.reverse()
            folded = (claim or leaf).hex().encode()
            for digit, others in steps:
                cut = digit * 64
                folded = hashlib.sha256(others[:cut] + folded + others[cut:]).hexdigest().encode()
            proof = hashlib.sha256(b"".join(o for _, o in steps)).hexdigest()
            folded_root = folded.decode()
            values = (leaf.hex(), segment.subroot.hex(), root.hex(), proof, folded_root, folded_root == root.hex())
            for c, v in zip(found, values, strict=True):
                found[c].append(v)
        kinds = {c: pa.bool_() if t == "boolean" else pa.string() for c, t in _fields(PROOF)}
        return pa.table(
            {"row": asked.column("row")} | {c: pa.array(v, kinds[c]) for c, v in found.items()}
        )

    asked = wanted.withColumn("segment", F.floor(F.col("pos") / SEGMENT))
    row_type = wanted.schema["row"].dataType.simpleString()
    done = asked.groupBy("tree", "segment").cogroup(
        _segments(m, frontier).groupBy("tree", "segment")
    ).applyInArrow(proven, f"row {row_type}, {PROOF}")
    kept = [c for c in wanted.schema["row"].dataType.names if c != "_"]
    new = {c for c, _ in _fields(PROOF)}
    return done.select(
        *(F.col("row")[c].alias(c) for c in kept if c.lower() not in new),
        *(c for c, _ in _fields(PROOF)),
    )


#: Fields of a leaf of ``documents``, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``leaf`` and ``claim`` of every document.

    The claim is the leaf of a tampered copy, null where none is: where three divides the
    CRC-32 of the decimal id, the capitals A-Z of the text became small letters.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    small = F.translate("text", capitals, capitals.lower())
    return docs.select(
        "doc_id",
        "lang",
        leaf_digest(map(F.col, FIELDS)).alias("leaf"),
        F.when(tampered, leaf_digest([*map(F.col, FIELDS[:-1]), small])).alias("claim"),
    )


def document_proofs(docs: DataFrame) -> DataFrame:
    """Every document's proof, checked with its tampered copy where there is one."""
    m = manifest(document_leaves(docs), "lang", "doc_id", ["doc_id"])
    return proofs(m)

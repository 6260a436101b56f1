"""Line dedup: documents that overlap are aligned, and the later one loses what is common.

Every line of five words or more that occurs in two documents or more is an anchor. It
pairs each later document with the first document that has the line, so a line held by
any number of documents makes one pair for each of them and never a pair for each two.
How rare an anchor is plays no part: none is left out for being common, because copies in
thousands make their lines common too.

A document that has a line for the k-th time is also paired with the first document that
has it k times. So is every run of neighbouring lines that reaches five words, which
finds passages whose lines are all short. This needs no rounds: whatever earlier document
has a line as often, the first one that does is a partner.

Of each pair the sequences of lines that both have are aligned by patience diff: equal lines at
both ends, then the lines that each side has once, longest increasing first, then the
gaps between them. Runs of aligned lines that are neighbours in both documents are
blocks; a block of five words or more is deleted from the later document. Blocks that are
left on both sides because their order differs are then matched where they stand, each
line of the earlier document once. Alignments are made on the input, so the first copy of
a line always stays. Copies, runs and other orders are looked for with ``whole`` only,
which the registered queries set.

Lines are compared without white space at their ends. Lines without a word are neither
compared nor deleted, and do not part a block.

Defined results
    null text                 no lines; text stays null
    empty text                one line without a word; stays
    repeated rows             same doc_id and text: one document, all copies alike
    equal doc_ids             neither is the later one: not aligned with each other
    null doc_id               later than all others, not aligned with each other
    one repeated line         at least as many copies go as one earlier document has; what
                              several partners delete is united, so more can go
    columns of other names    kept as they are
    empty table               no rows
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm.quality import words_of
from pagesieve.llm.storage import fresh_name, stored

#: Words of an anchor, and of a block that is deleted.
LEAST_WORDS = 5
_BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) that a patience diff matches, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        anchors = _increasing(_unique(a, i, m), _unique(b, j, n))
        if not anchors:
            continue
        for x, y in anchors:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    return sorted(out)


def _unique(keys: list, begin: int, end: int) -> dict:
    """Place of each key that stands once in the range."""
    seen: dict = {}
    for k in range(begin, end):
        seen[keys[k]] = None if keys[k] in seen else k
    return {key: k for key, k in seen.items() if k is not None}


def _increasing(of_a: dict, of_b: dict) -> list[tuple[int, int]]:
    """Longest run of common keys that is in order on both sides."""
    both = sorted((x, of_b[key]) for key, x in of_a.items() if key in of_b)
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(both):
        at = bisect_left(ends, y)
        before.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(y)
            last.append(k)
        else:
            ends[at], last[at] = y, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def deleted_places(a: list[tuple], b: list[tuple], whole: bool = False) -> list[int]:
    """Line numbers that b loses to a; rows are (ordinal, line number, words, key).

    With ``whole``, also the blocks that the alignment leaves because of their order.
    """
    both = {x[3] for x in a} & {x[3] for x in b}
    a, b = ([x for x in side if x[3] in both] for side in (a, b))
    used, gone, block, words = set(), set(), [], 0
    previous = (-2, -2)

    def close() -> None:
        if words >= LEAST_WORDS:
            used.update(i for i, _ in block)
            gone.update(j for _, j in block)

    for i, j in aligned([x[3] for x in a], [x[3] for x in b]):
        here = (a[i][0], b[j][0])
        if here != (previous[0] + 1, previous[1] + 1):
            close()
            block, words = [], 0
        block.append((i, j))
        words += b[j][2]
        previous = here
    close()
    if whole:
        _out_of_order(a, b, used, gone)
    return [b[j][1] for j in sorted(gone)]


def _least_run(rows: list[tuple], begin: int, out: set[int]) -> int:
    """End of the shortest block from ``begin`` that is long enough; 0 if there is none."""
    words, k = 0, begin
    while k < len(rows) and k not in out and rows[k][0] - rows[begin][0] == k - begin:
        words += rows[k][2]
        k += 1
        if words >= LEAST_WORDS:
            return k
    return 0


def _out_of_order(a: list[tuple], b: list[tuple], used: set[int], gone: set[int]) -> None:
    """Match blocks that the alignment left on both sides, wherever they stand.

    Every line of a is used once. Afterwards no block that is long enough is left on both
    sides. One pass over b, each start in a is looked at a bounded number of times.
    """
    names = lambda rows, k, end: tuple(x[3] for x in rows[k:end])
    ends = {j: end for j in range(len(b)) if (end := _least_run(b, j, gone))}
    wanted = {names(b, j, end) for j, end in ends.items()}
    if not wanted:
        return
    starts: dict[tuple, deque] = {}
    for i in range(len(a)):
        end = _least_run(a, i, used)
        if end and (name := names(a, i, end)) in wanted:
            starts.setdefault(name, deque()).append(i)

    def fits(i: int, j: int, by: int) -> bool:
        """Whether a block can go on from the lines i and j to the next ones."""
        x, y = i + by, j + by
        return (
            0 <= x < len(a) and 0 <= y < len(b) and x not in used and y not in gone
            and a[x][3] == b[y][3] and a[x][0] == a[i][0] + by and b[y][0] == b[j][0] + by
        )

    for j, end in ends.items():
        if not _least_run(b, j, gone):
            continue
        places = starts.get(names(b, j, end), deque())
        while places and not _least_run(a, places[0], used):
            places.popleft()
        if not places:
            continue
        i, size, before = places.popleft(), end - j, 0
        while fits(i + size - 1, j + size - 1, 1):
            size += 1
        while fits(i - before, j - before, -1):
            before += 1
        used.update(range(i - before, i + size))
        gone.update(range(j - before, j + size))


def anchors_of(rows: list[tuple]) -> list[bytes]:
    """Anchors of a document besides its single lines; rows are as in ``deleted_places``.

    Runs of neighbouring lines, so that every line of a block of five words is in a run
    of that block, and lines and runs that come again, with their number.
    """
    out, times = [], {}
    for i, (first, _, least, _) in enumerate(rows):
        words, name = 0, b""
        for j in range(i, len(rows)):
            if rows[j][0] - first != j - i:
                break
            words += rows[j][2]
            name += rows[j][3]
            if words >= LEAST_WORDS and min(words - least, words - rows[j][2]) < LEAST_WORDS:
                times[name] = times.get(name, 0) + 1
                if j > i or times[name] > 1:
                    out.append(hashlib.md5(name + times[name].to_bytes(8, "little")).digest())
            if words - least >= LEAST_WORDS:
                break
    return out


def _lines(text: Column) -> Column:
    """Lines with a word, as (ordinal, place, words, key)."""
    rows = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x, i: F.struct(
            i.alias("place"),
            F.size(words_of(x)).alias("words"),
            F.unhex(F.md5(F.regexp_replace(x, _BLANKS, "").cast("binary"))).alias("key"),
        ),
    )
    worded = F.filter(rows, lambda r: r["words"] > 0)
    return F.transform(worded, lambda r, i: r.withField("ordinal", i))


def _deletions(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                rows = ([(r["ordinal"], r["place"], r["words"], r["key"]) for r in x] for x in (a, b))
                places.append(deleted_places(*rows, whole))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(places, pa.list_(pa.int32()))], names=["doc", "places"]
            )

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            anchors_of([(r["ordinal"], r["place"], r["words"], r["key"]) for r in x])
            for x in batch.column("lines").to_pylist()
        ]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(rows), pa.array([y for x in found for y in x], pa.binary())],
            names=["doc", "anchor"],
        )


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``doc, places, partners``: line numbers that documents lose.

    ``doc`` is the struct of doc_id and the digest of the text; documents that lose
    nothing are not there. ``whole`` is explained at ``without_repeats``.
    """
    doc = F.struct(F.col(doc_id).cast("long").alias("id"), _digest(F.col(text)).alias("mark"))
    rows = stored(
        docs.select(doc.alias("doc"), F.inline(_lines(F.col(text)))).distinct(), "line-rows"
    )
    # A null id sorts first; here it has to be the last.
    order = F.struct(F.col("doc.id").isNull().alias("none"), "doc").alias("order")
    held = rows.select("key", "doc", order).groupBy("key")
    shared = stored(
        held.agg(F.min("order").alias("first"), F.max("order").alias("last"))
        .filter(F.col("first") != F.col("last"))
        .select("key", F.col("first.doc").alias("first")),
        "line-shared",
    )
    common = stored(rows.join(shared, "key"), "line-common")
    later = F.col("first.id").isNotNull() & (
        F.col("doc.id").isNull() | (F.col("doc.id") > F.col("first.id"))
    )
    sequence = common.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "place", "words", "key"))).alias("lines")
    )
    sequence = stored(sequence, "line-sequences")
    pairs = common.filter(later & (F.col("words") >= LEAST_WORDS)).select("doc", "first")
    if whole:
        anchors = stored(
            sequence.mapInArrow(_anchors, "doc struct<id:long,mark:binary>, anchor binary").select("*", order),
            "line-anchors",
        )
        heads = (
            anchors.groupBy("anchor")
            .agg(F.min("order").alias("first"), F.max("order").alias("last"))
            .filter(F.col("first") != F.col("last"))
            .select("anchor", F.col("first.doc").alias("first"))
        )
        pairs = pairs.union(anchors.join(heads, "anchor").filter(later).select("doc", "first"))
    pairs = pairs.distinct()
    side = lambda n, d: sequence.select(F.col("doc").alias(d), F.col("lines").alias(n))
    both = pairs.select("doc", "first").join(side("b", "doc"), "doc").join(side("a", "first"), "first")
    found = both.select("doc", "a", "b").mapInArrow(_deletions(whole), "doc struct<id:long,mark:binary>, places array<int>")
    return (
        found.groupBy("doc")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.count("*").alias("partners"))
        .filter(F.size("places") > 0)
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def without_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", into: str = "lines", whole: bool = False
) -> DataFrame:
    """``docs`` with the lines deleted from ``text``, and the struct ``into``.

    Its fields are ``n_lines``, ``n_removed``, ``n_partners`` (documents it was aligned
    with) and ``emptied`` (there were words, and none are left). An older column of that
    name is replaced.

    Without ``whole``, a document is aligned once with the first holder of each of its
    lines, and what stands there in another order or more often stays. With it, of every
    line of five words at least as many copies go as one earlier document has: every copy
    has its own first holder, and blocks are also matched out of order. Nothing goes but
    lines of blocks of five words that an earlier document has too. What the partners of a
    document delete is united: of x, y, x both x go if one earlier document is x and
    another is y, x.
    """
    docs = docs.drop(into) if into not in (doc_id, text) else docs
    places, mark, partners = (fresh_name(docs, x) for x in ("places", "mark", "partners"))
    found = stored(deletions(docs, doc_id, text, whole), "line-deletions").select(
        F.col("doc.id").alias("own_id"), F.col("doc.mark").alias("own_mark"),
        F.col("places").alias(places), F.col("partners").alias(partners),
    )
    marked = docs.withColumn(mark, _digest(F.col(text)))
    rows = marked.join(
        found, marked[doc_id].cast("long").eqNullSafe(F.col("own_id")) & (marked[mark] == F.col("own_mark")), "left"
    ).select(*docs.columns, places, partners)
    kind = T.StructType(
        [
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_partners", T.LongType()),
            T.StructField("emptied", T.BooleanType()),
        ]
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(into, kind)])
    arrow = pa.struct(
        [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_partners", pa.int64()), ("emptied", pa.bool_())]
    )
    own, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, facts = [], []
            for value, gone, n in zip(*(batch.column(c).to_pylist() for c in (text, places, partners)), strict=True):
                lines = [] if value is None else value.split("\n")
                emptied = False
                if gone:
                    out = set(gone)
                    kept = [x for i, x in enumerate(lines) if i not in out]
                    value = "\n".join(kept)
                    emptied = not value.encode().split()
                texts.append(value)
                facts.append(
                    {"n_lines": len(lines), "n_removed": len(gone or ()), "n_partners": n or 0, "emptied": emptied}
                )
            columns = list(batch.select(own).columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(facts, arrow)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, *, whole: bool = False, **columns: str) -> DataFrame:
    """``docs`` without repeated lines; documents that lose all their words go."""
    into = fresh_name(docs, "lines")
    return without_repeats(docs, into=into, whole=whole, **columns).filter(~F.col(into)["emptied"]).drop(into)

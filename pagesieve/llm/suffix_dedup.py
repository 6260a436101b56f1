"""Suffix-array dedup: bytes under a 50-byte string of an earlier document go.

Every place of a text at which 50 bytes begin is a suffix that matters in its first 50
bytes. Suffixes with equal beginnings have to meet in one task, so they are dealt out by
an anchor: the 16 bytes of least hash among the 50. Neighbouring suffixes mostly have the
same anchor and travel as one piece of text, compressed, in buckets.

First the anchors go without any text, to find those that two documents have. They come
back to slabs of documents, and only their pieces are sent. In a bucket, their suffixes
are sorted deep-shallow. A multikey quicksort on words of eight bytes orders them to a shallow
depth, and leaves off wherever a suffix stands alone. What is still together then has a
long common prefix: such groups are ordered by blind tries, which skip from one branching
bit to the next and never look at the bytes between. All groups take a step at a time, as
arrays. Suffixes that end up together are equal for 50 bytes, and each of them is covered
if the least doc_id among them is smaller than its own.

What is found goes back to the documents as runs of places, in slabs of documents.

Defined results
    null or empty text, or fewer than 50 bytes    nothing removed
    equal doc_ids          not compared with each other; each row has its own result
    null doc_id            not compared; nothing removed
    matches inside one document    do not count
    very long texts        cut into overlapping stretches, without an effect on results
    columns of other names not read
    empty table            no rows
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.arrow import parts
from pagesieve.llm.minhash import mixed
from pagesieve.llm.storage import stored

#: Bytes of a match, of an anchor; anchors in a match.
MATCH = 50
ANCHOR = 16
_WINDOW = MATCH - ANCHOR + 1
#: Bytes of text that are scanned at a time, of pieces in a bucket, of text in a slab.
STRETCH = 1 << 20
SCAN_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
SLAB_BYTES = 8 << 20
#: Partitions of buckets; above that a task takes one bucket after the other.
MOST_PARTITIONS = 20_000
#: Words of eight bytes that the quicksort looks at; the tries take over from there.
SHALLOW = 3
_WORDS = -(-MATCH // 8)
_TAIL = np.uint64((1 << 64) - (1 << (8 * (8 * _WORDS - MATCH))))
_RUN = np.dtype([("doc", "<i8"), ("mark", "<u4"), ("start", "<i8"), ("end", "<i8")])
_ANCHOR = np.dtype([("hash", "<u4"), ("doc", "<i8")])
_HEAD = np.dtype([("hash", "<u4"), ("doc", "<i8"), ("mark", "<u4"), ("start", "<i8"), ("size", "u1")])


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from every place on."""
    h, by = data.astype(np.uint64) + np.uint64(1), 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    while by < ANCHOR:
        h = mixed(h[:-by] * factor + h[by:]) if by == ANCHOR // 2 else h[:-by] * factor + h[by:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        by *= 2
    return h


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, start and number of suffixes of each piece of one stretch of text."""
    n = len(data)
    if n < MATCH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _anchor_hashes(np.frombuffer(data, np.uint8))
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 21) - 1)
    least, by = (hashes & ~low) | place, 1
    while 2 * by <= _WINDOW:
        least = np.minimum(least[:-by], least[by:])
        by *= 2
    rest = _WINDOW - by
    least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return hashes[anchor[start]], start, np.diff(np.append(start, len(anchor)))


def _stretches(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of a text that overlap so that every suffix is in exactly one of them."""
    for begin in range(0, max(1, len(data) - MATCH + 1), STRETCH):
        yield begin, data[begin : begin + STRETCH + MATCH - 1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def packed_heads(heads: np.ndarray) -> bytes:
    """Heads as planes of bytes, documents as differences: most planes are then all zero."""
    out = []
    for name in heads.dtype.names:
        column = heads[name]
        if name == "doc":
            column = np.diff(column, prepend=np.int64(0))
        out.append(np.ascontiguousarray(column).view(np.uint8).reshape(len(heads), -1).T.tobytes())
    return b"".join(out)


def unpacked_heads(data: bytes, kind: np.dtype = _HEAD) -> np.ndarray:
    """The inverse of ``packed_heads``."""
    n, at = len(data) // kind.itemsize, 0
    heads = np.zeros(n, kind)
    for name in kind.names:
        of = kind[name]
        planes = np.frombuffer(data, np.uint8, n * of.itemsize, at).reshape(of.itemsize, n)
        column = np.ascontiguousarray(planes.T).view(of).reshape(n)
        heads[name] = np.cumsum(column) if name == "doc" else column
        at += n * of.itemsize
    return heads


def _groups(number: np.ndarray) -> list[np.ndarray]:
    """Places of each number, in order."""
    order = np.argsort(number, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket takes the upper half of a hash; a head has of the lower one."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _slab_number(docs: np.ndarray, slabs: int) -> np.ndarray:
    return (mixed(docs.astype(np.uint64)) % np.uint64(slabs)).astype(np.int64)


def _anchors(buckets: int):
    """Anchors of the documents of a batch, packed by bucket: 24 bits of the hash, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in chain.from_iterable(parts(b, SCAN_BYTES) for b in batches):
            found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                for _, stretch in _stretches(text.encode()) if doc is not None and text else ():
                    found.append(pieces(stretch)[0])
                    docs.append(np.full(len(found[-1]), doc))
            hashes = np.concatenate(found)
            heads = np.zeros(len(hashes), _ANCHOR)
            heads["hash"], heads["doc"] = hashes & _LOW, np.concatenate(docs)
            bucket = _bucket_of(hashes, buckets)
            groups = _groups(bucket)
            yield _batch(
                bucket=[int(bucket[g[0]]) for g in groups],
                anchors=[packer.compress(packed_heads(heads[g])) for g in groups],
            )

    return run


_LOW = np.uint64((1 << 24) - 1)


def _batch(**columns: list) -> pa.RecordBatch:
    """Numbers (the first column) and bytes as a batch."""
    kinds = [pa.int32()] + [pa.binary()] * (len(columns) - 1)
    arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _shared(slabs: int):
    """Anchors that two documents have, packed by slab; rows come by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for bucket, rows in _by_bucket(batches, ("anchors",)):
            heads = np.concatenate([unpacked_heads(unpacker.decompress(a), _ANCHOR) for (a,) in rows])
            order = np.argsort(heads["hash"], kind="stable")
            hashes, docs = heads["hash"][order], heads["doc"][order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            two = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            chosen = np.sort(order[np.repeat(two, np.diff(np.append(first, len(order))))])
            slab = _slab_number(heads["doc"][chosen], slabs)
            groups = _groups(slab)
            keys = [_keys(bucket, heads["hash"][chosen[g]], heads["doc"][chosen[g]]) for g in groups]
            yield _batch(
                slab=[int(slab[g[0]]) for g in groups],
                keys=[packer.compress(np.unique(k).astype("<u4").tobytes()) for k in keys],
            )

    return run


def _keys(bucket, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """32 bits that name an anchor of a document inside its slab. Two with one name only
    send a piece that nobody needs."""
    both = hashes.astype(np.uint64) << np.uint64(32) | np.asarray(bucket).astype(np.uint64)
    return mixed(mixed(both) + docs.astype(np.uint64)) >> np.uint64(32)


def _by_bucket(
    batches: Iterator[pa.RecordBatch], names: tuple[str, ...]
) -> Iterator[tuple[int, list[tuple[bytes, ...]]]]:
    bucket, rows = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in names)
        for b, *values in zip(batch.column("bucket").to_pylist(), *columns, strict=True):
            if b != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = b, []
            rows.append(tuple(values))
    if rows:
        yield bucket, rows


def _pieces_sent(buckets: int, marked: bool):
    """Pieces of the documents of a slab whose anchors are shared, packed by bucket.

    Where doc_ids repeat, rows of one are told apart by a mark of their text.
    """

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        packer, text_packer = (zstandard.ZstdCompressor(level=k) for k in (3, 6))
        unpacker = zstandard.ZstdDecompressor()
        wanted = [np.frombuffer(unpacker.decompress(k), "<u4") for k in shared["keys"].to_pylist()]
        wanted = np.unique(np.concatenate([np.zeros(0, "<u4"), *wanted]))
        heads, texts, dealt = [np.zeros(0, _HEAD)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for doc, text in _documents(docs) if len(wanted) else ():
            if doc is None or not text:
                continue
            data = text.encode()
            mark = _mark(data, marked)
            for begin, stretch in _stretches(data):
                hashes, start, count = pieces(stretch)
                bucket = _bucket_of(hashes, buckets)
                key = _keys(bucket, hashes & _LOW, np.full(len(hashes), doc))
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                sent = wanted[at] == key
                hashes, start, count = hashes[sent], start[sent], count[sent]
                head = np.zeros(len(hashes), _HEAD)
                head["hash"], head["doc"], head["mark"] = hashes & np.uint64(0xFFFFFFFF), doc, mark
                head["start"], head["size"] = start + begin, count + MATCH - 1
                heads.append(head)
                texts.append(np.frombuffer(stretch, np.uint8)[_ranges(start, count + MATCH - 1)])
                dealt.append(bucket[sent])
        head, text, bucket = (np.concatenate(x) for x in (heads, texts, dealt))
        sizes = head["size"].astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        groups = _groups(bucket)
        return pa.Table.from_batches(
            [
                _batch(
                    bucket=[int(bucket[g[0]]) for g in groups],
                    heads=[packer.compress(packed_heads(head[g])) for g in groups],
                    texts=[text_packer.compress(text[_ranges(begins[g], sizes[g])].tobytes()) for g in groups],
                )
            ]
        )

    return run


def deep_shallow_classes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each suffix of ``text``; equal exactly if their first 50 bytes are.

    The numbers also order the suffixes, except that single ones keep the place that they
    had when they came to stand alone.
    """
    n = len(places)
    padded = np.concatenate([text, np.zeros(8 * _WORDS, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    word = lambda ids, k: _cut(words[places[ids] + 8 * k].astype(np.uint64), k)
    classes = np.empty(n, np.int64)
    # Multikey quicksort: rank by one word within each group, then go on with the groups.
    active, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(SHALLOW):
        key = word(active, depth)
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        active, key, group = active[order], key[order], group[order]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(active)))
        number = _numbered(group, first, size)
        classes[active] = number
        together = np.repeat(size > 1, size)
        active, group = active[together], number[together]
    _blind_tries(active, group, word, classes)
    return classes


def _cut(values: np.ndarray, k: int) -> np.ndarray:
    return values & _TAIL if k == _WORDS - 1 else values


def _numbered(group: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Group numbers after a split: that of the old group plus the place within it."""
    old = group[first]
    begin = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]])) if len(first) else first
    offset = first - np.repeat(first[begin], np.diff(np.append(begin, len(first))))
    return np.repeat(old + offset, size)


def _blind_tries(active: np.ndarray, group: np.ndarray, word, classes: np.ndarray) -> None:
    """Split groups with a long common prefix at one branching bit after the other."""
    deep = range(SHALLOW, _WORDS)
    far = 64 * len(deep)
    keys = np.stack([word(active, k) for k in deep]) if len(active) else np.zeros((len(deep), 0), np.uint64)
    while len(active):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(active)))
        leader = np.repeat(first, size)
        differs = np.full(len(active), far, np.int64)
        for k in range(len(deep) - 1, -1, -1):
            x = keys[k] ^ keys[k][leader]
            unequal = x != 0
            differs[unequal] = 64 * k + _leading_zeros(x[unequal])
        branch = np.minimum.reduceat(differs, first)
        open_ = np.repeat(branch < far, size)
        if not open_.any():
            return
        active, group, keys = active[open_], group[open_], keys[:, open_]
        at = np.repeat(branch, size)[open_]
        bit = (keys[at >> 6, np.arange(len(active))] >> (np.uint64(63) - (at & 63).astype(np.uint64))) & np.uint64(1)
        order = np.lexsort((bit, group))
        active, group, keys, bit = active[order], group[order], keys[:, order], bit[order]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (bit[1:] != bit[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(active)))
        group = _numbered(group, first, size)
        classes[active] = group
        together = np.repeat(size > 1, size)
        active, group, keys = active[together], group[together], keys[:, together]


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Zero bits above the highest set one, of numbers that are not 0."""
    high = (x >> np.uint64(32)).astype(np.int64)
    top = np.where(high > 0, high, (x & np.uint64(0xFFFFFFFF)).astype(np.int64))
    length = np.frexp(top.astype(np.float64))[1]
    return np.where(high > 0, 32, 64) - length


def covered_runs(heads: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Runs of places covered by an earlier document, among the pieces of one bucket."""
    if not len(heads):
        return np.zeros(0, _RUN)
    sizes = heads["size"].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(heads["hash"], kind="stable")
    hashes, docs = heads["hash"][order], heads["doc"][order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    count = np.diff(np.append(first, len(order)))
    shared = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    ids = order[np.repeat(shared, count)]
    if not len(ids):
        return np.zeros(0, _RUN)
    # Equal pieces are sorted once, under their least doc_id.
    whole = text.tobytes()
    names = [
        xxhash.xxh3_128_digest(whole[b : b + s]) for b, s in zip(begins[ids].tolist(), sizes[ids].tolist(), strict=True)
    ]
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(x, len(number)) for x in names), np.int64, len(names))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, heads["doc"][ids])
    example = np.zeros(len(number), np.int64)
    example[of] = ids
    many = sizes[example] - MATCH + 1
    classes = deep_shallow_classes(text, _ranges(begins[example], many))
    by = np.argsort(classes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(classes[by]) != 0]))
    earliest = np.empty(len(classes), np.int64)
    owner = np.repeat(np.arange(len(number)), many)
    earliest[by] = np.repeat(
        np.minimum.reduceat(least[owner[by]], starts), np.diff(np.append(starts, len(by)))
    )
    # Back to every piece: which of its suffixes have an earlier document.
    own = many[of]
    at = _ranges((np.cumsum(many) - many)[of], own)
    piece = np.repeat(np.arange(len(ids)), own)
    covered = earliest[at] < heads["doc"][ids][piece]
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (piece[1:] != piece[:-1])
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1][covered[cuts[:-1]]], cuts[1:][covered[cuts[:-1]]]
    chosen = ids[piece[begin]]
    inner = np.cumsum(own) - own
    out = np.zeros(len(begin), _RUN)
    out["doc"], out["mark"] = heads["doc"][chosen], heads["mark"][chosen]
    out["start"] = heads["start"][chosen] + begin - inner[piece[begin]]
    out["end"] = out["start"] + (end - begin) + MATCH - 1
    return out


def _mark(data: bytes, marked: bool) -> int:
    return xxhash.xxh32_intdigest(data) if marked else 0


def _match(slabs: int):
    """Covered runs of the buckets of a partition, packed by slab; rows come by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for _, rows in _by_bucket(batches, ("heads", "texts")):
            heads = np.concatenate([unpacked_heads(unpacker.decompress(h)) for h, _ in rows])
            text = np.concatenate([np.frombuffer(unpacker.decompress(t), np.uint8) for _, t in rows])
            runs = covered_runs(heads, text)
            slab = _slab_number(runs["doc"], slabs)
            groups = _groups(slab)
            yield _batch(slab=[int(slab[g[0]]) for g in groups], runs=[runs[g].tobytes() for g in groups])

    return run


def _slab_of(slabs: int):
    """Documents packed by slab. Those without an id lose nothing and may be in any slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in chain.from_iterable(parts(b, SCAN_BYTES) for b in batches):
            ids = part.column("doc_id")
            slab = _slab_number(np.where(ids.is_null(), np.arange(len(ids)), ids.fill_null(0).to_numpy()), slabs)
            groups = _groups(slab)
            yield _batch(
                slab=[int(slab[g[0]]) for g in groups],
                docs=[packer.compress(_serialized(part.take(pa.array(g)))) for g in groups],
            )

    return run


def _serialized(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _documents(packed: pa.Table) -> Iterator[tuple[int | None, str | None]]:
    unpacker = zstandard.ZstdDecompressor()
    for data in packed["docs"].to_pylist():
        batch = pa.ipc.open_stream(unpacker.decompress(data)).read_all()
        yield from zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut_out(docs: pa.Table, runs: pa.Table, marked: bool) -> pa.Table:
    """The documents of one slab without what is covered."""
    packed = [np.frombuffer(x.as_py(), _RUN) for x in runs["runs"]]
    found = np.concatenate(packed) if packed else np.zeros(0, _RUN)
    found = found[np.lexsort((found["start"], found["mark"], found["doc"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["mark"][1:] != found["mark"][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found))
    where = {(int(found["doc"][a]), int(found["mark"][a])): (a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)}
    out = []
    for doc, text in _documents(docs):
        data = (text or "").encode()
        kept, spans, at = [], 0, 0
        a, b = where.get((doc, _mark(data, marked)), (0, 0)) if doc is not None else (0, 0)
        end = -1
        for s, e in zip(found["start"][a:b].tolist(), found["end"][a:b].tolist(), strict=True):
            if s > end:
                kept.append(data[max(at, 0) : s])
                spans += 1
            end = max(end, e)
            at = end
        kept.append(data[at:])
        rest = b"".join(kept)
        out.append((doc, len(data), len(data) - len(rest), spans, rest))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans")
    columns = {n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)}
    return pa.table(columns | {"kept": pa.array([r[4] for r in out], pa.binary())})


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs (doc_id, text)``.

    ``kept`` are the bytes that are left; cuts can fall inside a character.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, slabs = total * 4 // BUCKET_BYTES + 1, total // SLAB_BYTES + 1
    marked = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tasks = min(buckets, MOST_PARTITIONS)

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    anchors = rows.mapInArrow(_anchors(buckets), "bucket int, anchors binary")
    shared = by_bucket(anchors).mapInArrow(_shared(slabs), "slab int, keys binary")
    placed = rows.mapInArrow(_slab_of(slabs), "slab int, docs binary").groupBy("slab")
    sent = placed.cogroup(shared.groupBy("slab")).applyInArrow(
        _pieces_sent(buckets, marked), "bucket int, heads binary, texts binary"
    )
    runs = stored(by_bucket(sent).mapInArrow(_match(slabs), "slab int, runs binary"), "suffix-runs")

    def cut_out(docs: pa.Table, runs: pa.Table) -> pa.Table:
        return _cut_out(docs, runs, marked)

    return placed.cogroup(runs.groupBy("slab")).applyInArrow(cut_out, RESULT)

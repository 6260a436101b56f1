"""MinHash near-dedup: bands find candidates, b-bit signatures thin them, sets decide.

Documents with the same set of word shingles are one class. Of each class the minima of
128 hash functions are taken. Runs of four full minima are the bands that make classes
candidates; of every minimum only the two lowest bits are kept, packed into 256 bits.
Equal bit pairs, counted by bit operations and corrected for those that agree by
chance, estimate the similarity of a candidate pair. Pairs whose estimate is six
deviations below the threshold are dropped; all others are decided on the full sets.

Pairs within a bucket are never all written out. First each class of a bucket is held
against one hub of the bucket. What that links is settled: within one component nothing
more has to be known. Classes that are not in their hub's component are then held
against the whole bucket, in blocks of bounded size, and only real links come out.
So no link between different components is overlooked, whatever the size of a bucket.

Defined results
    null or empty text       no shingles; linked with nothing, kept
    fewer words than four    the whole sequence is the one shingle
    repeated rows            one class, so linked
    equal doc_ids            each row belongs to the class of its own text
    null doc_id              linked with nothing, component_id null, kept
    columns of other names   not read
    empty table              no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.components import components
from pagesieve.llm.storage import fresh_name, stored

#: Parameters of the method. A pair of similarity 0.8 shares none of the bands with
#: probability (1 - 0.8 ** ROWS) ** BANDS, which is 5e-8.
ROWS = 4
BANDS = 32
BITS = 2
WORDS = 4
PERCENT = 80
#: Lowest estimate that is still looked at: 0.8 less six deviations of the estimate.
LEAST_ESTIMATE = 0.8 - 6 * 0.042
#: Sets of a block, and bytes of their shingles, on the average of a bucket.
BLOCK = 1024
BLOCK_BYTES = 32 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_240_501)
_MULTIPLY = _SEEDS.integers(1, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, 1 << 63, ROWS * BANDS, np.uint64)
_PLACE = _SEEDS.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of ``text``.

    A-Z count as lower case. A text of fewer words is one shingle; one without words
    has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    if n < 1:
        whole = np.sum(hashes * _PLACE[: len(words)], dtype=np.uint64) + np.uint64(len(words))
        return mixed(np.array([whole]))
    total = hashes[:n] * _PLACE[0]
    for k in range(1, width):
        total += hashes[k : n + k] * _PLACE[k]
    return np.unique(mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over ``shingles``."""
    out = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 512):
        part = shingles[begin : begin + 512]
        np.minimum(out, (part[:, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return out


def bands_of(least: np.ndarray) -> np.ndarray:
    """One number for each band of minima, different between bands."""
    rows = least.reshape(BANDS, ROWS) * _PLACE[:ROWS]
    return mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signature_of(least: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, packed into 64-bit numbers."""
    per = 64 // BITS
    low = (mixed(least) & np.uint64((1 << BITS) - 1)).reshape(-1, per)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return (low << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two signatures show, less the bit pairs that agree by chance."""
    odd = 0x5555555555555555
    words = ROWS * BANDS * BITS // 64
    unequal = F.lit(0)
    for k in range(words):
        x = a[k].bitwiseXOR(b[k])
        unequal += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))
    agree = 1 - unequal / (ROWS * BANDS)
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


SKETCH = "doc_id long, n_shingles long, cls binary, bands array<long>, signature array<long>"


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, cls, bands, signature`` of ``docs (doc_id, text)``.

    ``cls`` names the set of shingles; it is null where there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, bands, signatures = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                if not len(found):
                    names.append(None)
                    bands.append(None)
                    signatures.append(None)
                    continue
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                least = minima(found)
                bands.append(bands_of(least))
                signatures.append(signature_of(least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "cls", "bands", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, classes: DataFrame, width: int = WORDS) -> DataFrame:
    """``cls, shingles`` (packed) of ``classes (cls, rep)``, from the text of ``rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for text, name in zip(*(batch.column(c).to_pylist() for c in ("text", "cls")), strict=True):
                packed = shingle_set(text, width).tobytes()
                if xxhash.xxh3_128_digest(packed) == name:
                    names.append(name)
                    sets.append(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "shingles"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    rows = texts.join(classes.select("rep", "cls"), "rep").select("text", "cls")
    return rows.mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are as similar as the threshold asks."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (n + m - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b"))
            good = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda n: sets.select(F.col("cls").alias(n), F.col("shingles").alias(f"shingles_{n}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a binary, b binary")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the open rows and all rows of each block; rows come sorted by block."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(rows: list[dict]) -> list[dict]:
        opened = [r for r in rows if r["open"]]
        every = [r for r in rows if not r["open"]]
        if not opened or not every:
            return []
        signature = lambda x: np.array([r["signature"] for r in x], np.int64).view(np.uint64)
        bands = lambda x: np.array([r["bands"] for r in x], np.int64)
        names = np.array([r["cls"] for r in every], object)
        roots = np.array([r["root"] for r in every], object)
        sig, band = signature(every), bands(every)
        odd, total = np.uint64(0x5555555555555555), ROWS * BANDS
        sets: dict[int, np.ndarray] = {}
        out = []
        for r, own, mine in zip(opened, signature(opened), bands(opened), strict=True):
            x = sig ^ own
            unequal = np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1)
            near = (1 - unequal / total - 2.0**-BITS) / (1 - 2.0**-BITS) >= LEAST_ESTIMATE
            near &= roots != r["root"]
            places = np.flatnonzero(near)
            if not len(places):
                continue
            # A pair that meets in several buckets is looked at in the first of them.
            first = (band[places] == mine).argmax(axis=1)
            places = places[mine[first] == r["key"]]
            if not len(places):
                continue
            a = np.frombuffer(r["shingles"], np.uint64)
            for i in places.tolist():
                if i not in sets:
                    sets[i] = np.frombuffer(every[i]["shingles"], np.uint64)
                if similar(a, sets[i]):
                    out.append({"a": r["cls"], "b": names[i]})
        return out

    block, rows = None, []
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            here = (r["key"], r["i"], r["j"])
            if here != block:
                found += links(rows)
                block, rows = here, []
            rows.append(r)
        yield pa.RecordBatch.from_pylist(found, schema=schema)
    yield pa.RecordBatch.from_pylist(links(rows), schema=schema)


def near_duplicates(docs: DataFrame, *, width: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    named = F.when(F.col("doc_id").isNotNull(), F.col("cls"))
    all_rows = stored(sketches(docs, width).withColumn("cls", named), "minhash-sketches")
    classes = stored(
        all_rows.filter(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        ),
        "minhash-classes",
    )
    in_bands = classes.select("cls", "rep", "n_shingles", "signature", F.explode("bands").alias("key"))
    by_chance = F.xxhash64("cls")
    buckets = stored(
        in_bands.groupBy("key")
        .agg(
            F.min(F.struct(by_chance.alias("order"), "cls", "signature")).alias("hub"),
            F.count("*").alias("n"),
            F.sum("n_shingles").alias("size"),
        )
        .filter(F.col("n") > 1),
        "minhash-buckets",
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    shared = stored(
        in_bands.join(buckets, "key").select("key", "cls", "rep", "signature", "hub", blocks.alias("blocks")),
        "minhash-shared",
    )
    sets = stored(shingle_sets(docs, shared.select("cls", "rep").distinct(), width), "minhash-sets")
    stars = (
        shared.filter(F.col("cls") != F.col("hub.cls"))
        .filter(estimate(F.col("signature"), F.col("hub.signature")) >= LEAST_ESTIMATE)
        .select(F.col("cls").alias("a"), F.col("hub.cls").alias("b"))
        .distinct()
    )
    links = stored(confirmed(stars, sets), "minhash-links")
    more = stored(_remaining_links(shared, classes, sets, components(links)), "minhash-links")
    roots = components(links.union(more))
    root = F.coalesce("root", "cls")
    placed = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "rep", root.alias("root")
    )
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "root").select("cls", "component_id")
    found = all_rows.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _remaining_links(
    shared: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame
) -> DataFrame:
    """Links of the classes that are not in the component of their bucket's hub."""
    label = roots.select(F.col("node").alias("cls"), "root")
    hub_label = roots.select(F.col("node").alias("hub_cls"), F.col("root").alias("hub_root"))
    rows = (
        shared.select("key", "cls", "blocks", F.col("hub.cls").alias("hub_cls"))
        .join(label, "cls", "left")
        .join(hub_label, "hub_cls", "left")
        .select(
            "key",
            "cls",
            "blocks",
            F.coalesce("root", "cls").alias("root"),
            (F.coalesce("root", "cls") != F.coalesce("hub_root", "hub_cls")).alias("open"),
        )
    )
    facts = classes.select("cls", "signature", "bands").join(sets, "cls")
    blocked = (
        in_blocks(stored(rows, "minhash-rows"))
        .join(facts, "cls")
        .select("key", "i", "j", "open", "cls", "root", "signature", "bands", "shingles")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return blocked.mapInArrow(_block_links, "a binary, b binary").distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows (key, cls, blocks, root, open)`` dealt to pairs of blocks ``i, j`` of their bucket.

    Open rows are in block ``i`` and meet all rows of the bucket in every ``j``. The rows
    of ``j`` are repeated only for blocks ``i`` that hold an open row, so a bucket with one
    open row has each of its rows once more.
    """
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    open_rows = rows.filter("open").withColumn("i", own)
    every = rows.join(open_rows.select("key", "i").distinct(), "key").select(
        "key", "cls", "blocks", "root", F.lit(False).alias("open"), "i", own.alias("j")
    )
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return open_rows.withColumn("j", F.explode(others)).unionByName(every)


def one_of_each(docs: DataFrame, *, width: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies.

    The row with the least doc_id stays, and of equal rows one. A null doc_id stays.
    """
    at = fresh_name(docs, "row")
    marked = stored(docs.withColumn(at, F.monotonically_increasing_id()), "minhash-documents")
    rows = near_duplicates(marked.select(F.col(at).alias("doc_id"), "text"), width=width)
    first = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("d"), F.col(at).alias("r"))
    placed = marked.select("doc_id", at).join(rows.withColumnRenamed("doc_id", at), at)
    stay = placed.groupBy("component_id").agg(F.min(first).alias("s")).select(F.col("s.r").alias(at))
    return marked.join(stay, at, "left_semi").drop(at)

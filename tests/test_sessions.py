"""Sessions in a batch and in a stream, late rows, changed pages, and restarts."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import tuples
from pagesieve import operators as op
from pagesieve.sources import PAGE_SCHEMA
from pagesieve.streaming import SessionTables, append_changes, stream_pages

SCHEMA = "id long, k int, t long"
GAP = 10


def expected_sessions(rows):
    found = []
    for k in {k for _, k, t in rows if k is not None}:
        times = sorted(t for _, j, t in rows if j == k and t is not None)
        for i, t in enumerate(times):
            if i and t <= times[i - 1] + GAP:
                start, _, n = found[-1][1:]
                found[-1] = (k, start, t, n + 1)
            else:
                found.append((k, t, t, 1))
    return sorted(found)


def some_rows(seed=5, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0, 1, 1, 1, 2]), rng.choice([None, *range(-300, 900)])) for i in range(n)] + [(n, 2, 7)] * 3


@pytest.mark.parametrize("width", [1, 7, 10, 10_000])
def test_sessions(spark, width):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert tuples(op.sessions(df, "k", "t", GAP, width)) == sorted(expected_sessions(rows), key=repr)
    assert op.sessions(df.limit(0), "k", "t", GAP, width).isEmpty()


@pytest.mark.parametrize("width", [3, 50])
def test_sessions_of_sessions(spark, width):
    """Spans that reach over many slices are merged, and counts are added."""
    rows = some_rows(6)
    first = op.sessions(spark.createDataFrame(rows[::2], SCHEMA), "k", "t", GAP, width)
    rest = spark.createDataFrame(rows[1::2], SCHEMA).select("k", F.col("t").alias("start"), F.col("t").alias("end"), F.lit(1).alias("n"))
    merged = op.merged_sessions(first.unionByName(rest), "k", GAP, width)
    assert tuples(merged) == sorted(expected_sessions(rows), key=repr)


def test_sessions_like_the_built_in_window(spark):
    rows = [r for r in some_rows(7) if None not in r]
    df = spark.createDataFrame(rows, SCHEMA)
    window = F.session_window(F.timestamp_seconds("t"), f"{GAP} seconds")
    built_in = df.groupBy("k", window).count().select(
        "k", F.unix_seconds("session_window.start"), F.unix_seconds("session_window.end") - GAP, "count"
    )
    assert tuples(op.sessions(df, "k", "t", GAP, 40)) == tuples(built_in)


def test_a_busy_key_is_as_many_groups_as_it_has_slices(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    found = op.sessions(df, "k", "t", 2, 10)
    assert tuples(found) == [(1, 0, 2999, 3000)]
    windows = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if " Window [" in x]
    assert windows and all("slice" in x for x in windows)


def write_files(df, folder, parts):
    """One file for each filter of ``parts``, each a minute younger than the one before."""
    for i, part in enumerate(parts):
        known = set(os.listdir(folder)) if os.path.exists(folder) else set()
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
        for name in set(os.listdir(folder)) - known:
            os.utime(f"{folder}/{name}", (1_700_000_000 + 60 * i,) * 2)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFileAge", "36500d").option("maxFilesPerTrigger", 1).parquet(folder)


def by_batch(rows, delay, parts=5):
    """Rows on time and late ones, as micro-batches of ``id % parts`` see them."""
    on_time, late, latest = [], [], None
    for i in range(parts):
        batch = [r for r in rows if r[0] % parts == i]
        for r in batch:
            bad = r[1] is None or r[2] is None or (latest is not None and r[2] < latest - delay)
            (late if bad else on_time).append(r)
        latest = max([r[2] for r in batch if r[2] is not None] + ([latest] if latest is not None else []), default=None)
    return on_time, late, latest


def drifting_rows():
    """Each file is mostly later than the one before, some rows are very late."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        t = 200 * (i % 5) + rng.randrange(260) - (rng.randrange(400) if i % 7 == 0 else 0)
        rows.append((i, rng.choice([None, 1, 1, 1, 2, 3]), None if i % 50 == 3 else t))
    return rows


@pytest.mark.parametrize(("delay", "fails_in"), [(0, None), (10_000, None), (60, 0), (60, 2)])
def test_stream_of_sessions(spark, tmp_path, delay, fails_in):
    """Closed and open sessions are those of a batch job over all rows on time, late rows
    are all others, and a failure between two tables loses and repeats nothing."""
    rows = drifting_rows()
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    write_files(spark.createDataFrame(rows, SCHEMA), source, [f"id % 5 = {i}" for i in range(5)])
    tables = SessionTables(str(tmp_path / "out"), "k", "t", GAP, delay, width=25)
    if fails_in is not None:

        def failing(batch, number):
            tables.take(batch, number)
            if number == fails_in:
                raise RuntimeError("lost")

        query = (
            stream(spark, source).writeStream.foreachBatch(failing).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        with pytest.raises(StreamingQueryException):
            query.awaitTermination()
    tables.start(stream(spark, source), checkpoint).awaitTermination()
    tables.start(stream(spark, source), checkpoint).awaitTermination()  # finds nothing new
    on_time, late, latest = by_batch(rows, delay)
    assert tuples(tables.late(spark)) == sorted(late, key=repr)
    closed, still_open = tables.closed(spark).collect(), tables.open(spark).collect()
    assert sorted(map(tuple, closed + still_open)) == expected_sessions(on_time)
    assert all(r.end + GAP < latest - delay for r in closed) and all(r.end + GAP >= latest - delay for r in still_open)
    assert sum(r.n for r in closed + still_open) + len(late) == len(rows)
    whole = op.sessions(spark.createDataFrame(on_time, SCHEMA), "k", "t", GAP, 25)
    assert tuples(whole) == sorted(map(tuple, closed + still_open), key=repr)


def test_rows_of_a_micro_batch_that_is_not_whole_are_not_read(spark, tmp_path):
    tables = SessionTables(str(tmp_path), "k", "t", GAP, 0, width=25)
    with pytest.raises(ValueError):
        tables.closed(spark)
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    tables.take(df((1, 1, 0), (2, None, 5), (3, 1, 50)), 0)
    tables.take(df((4, 1, 60), (5, 1, 49)), 1)
    assert tuples(tables.closed(spark)) == [(1, 0, 0, 1)] and tuples(tables.open(spark)) == [(1, 50, 60, 2)]
    before = [tuples(f(spark)) for f in (tables.closed, tables.open, tables.late)]
    clock = tables._slot(2, "clock")
    spark.read.parquet(clock).write.parquet(str(tmp_path / "old"))
    tables.take(df((6, 1, 500), (7, 1, 1)), 2)
    after = [tuples(f(spark)) for f in (tables.closed, tables.open, tables.late)]
    spark.read.parquet(str(tmp_path / "old")).write.mode("overwrite").parquet(clock)  # as if it had not come so far
    assert [tuples(f(spark)) for f in (tables.closed, tables.open, tables.late)] == before
    tables.take(df((6, 1, 500), (7, 1, 1)), 2)
    assert [tuples(f(spark)) for f in (tables.closed, tables.open, tables.late)] == after != before


def expected_changes(rows, parts):
    seen, out = {}, []
    for i in range(parts):
        for page_id, url, html in sorted((r for r in rows if r[0] % parts == i), key=lambda r: r[0]):
            before = seen.get(url)
            out.append((page_id, url, "new" if before is None or url is None else "same" if before == html else "changed"))
            seen[url] = html
    return sorted(out, key=repr)


@pytest.mark.parametrize("stopped", [False, True])
def test_changed_pages(spark, tmp_path, stopped):
    rng = random.Random(9)
    rows = [
        (i, rng.choice([None, "", "http://a/", "http://b/", *(f"http://c/{j}" for j in range(9))]), rng.choice(["<p>x", "<p>y", "<p>z"]))
        for i in range(120)
    ]
    source, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    write_files(spark.createDataFrame(rows, PAGE_SCHEMA), source, [f"page_id % 4 = {i}" for i in range(4)])
    if stopped:  # in the middle, once the first micro-batch is written
        query = append_changes(stream_pages(spark, source, 1), table, checkpoint)
        while query.isActive and not os.path.exists(f"{checkpoint}/commits/0"):
            query.awaitTermination(0.05)
        query.stop()
    for _ in range(2):
        append_changes(stream_pages(spark, source, 1), table, checkpoint).awaitTermination()
    assert tuples(spark.read.parquet(table)) == expected_changes(rows, 4)


def test_markup_that_nobody_sees_is_no_change(spark, tmp_path):
    versions = ["<title>t</title><p>x", "<title>t</title><!-- c --><p  class=a>x", "<title>u</title><p>x", None, None]
    rows = [(i, "http://a/", html) for i, html in enumerate(versions)]
    source, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    write_files(spark.createDataFrame(rows, PAGE_SCHEMA), source, ["true"])
    append_changes(stream_pages(spark, source), table, checkpoint).awaitTermination()
    assert [r.status for r in spark.read.parquet(table).orderBy("page_id").collect()] == ["new", "same", "changed", "changed", "same"]

"""Sessions of a stream, with late rows kept in a table of their own.

Event time ends ``delay`` behind the latest time of all earlier micro-batches. Rows
before that bound are late. The others are merged with the sessions that were open, by
the same operator as in a batch job, so a busy key is many tasks here too. A session that
no row on time can reach any more is closed.

Open sessions are a table that each micro-batch writes anew, in one of two folders in
turn. A micro-batch reads what the one before it wrote and overwrites only what it would
write itself, so one that is repeated after a failure gives the same rows once. Readers
see micro-batches whose clock is written, which is the last thing that one does. The
folder and the checkpoint belong together: give both or none of an earlier run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesieve.operators.sessions import merged_sessions

_CLOCK = "batch long, latest long"


@dataclass(frozen=True)
class SessionTables:
    """Sessions of key ``on`` by the whole number ``time``, below ``folder``.

    ``gap`` and ``width`` are those of ``operators.sessions``; ``delay`` is how far a row
    may be behind the latest one of earlier micro-batches.
    """

    folder: str
    on: str
    time: str
    gap: int
    delay: int
    width: int

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all files of the stream ``rows`` not taken before, then end."""
        return (
            rows.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; ``batch`` counts from 0."""
        spark, key, at = rows.sparkSession, F.col(self.on), F.col(self.time)
        before, latest = None, rows.agg(F.max(at)).first()[0]
        late = key.isNull() | at.isNull()
        if batch:
            before = self._clock(spark, batch - 1).first().latest
            latest = max((x for x in (before, latest) if x is not None), default=None)
        if before is not None:
            late = late | (at < before - self.delay)
        spans = rows.filter(~late).select(
            key, at.alias("start"), at.alias("end"), F.lit(1).cast("long").alias("n")
        )
        if batch:
            spans = spans.union(self._state(spark, batch - 1).filter("open").select(*spans.columns))
        found = merged_sessions(spans, self.on, self.gap, self.width)
        is_open = F.lit(True) if latest is None else F.col("end") + self.gap >= latest - self.delay

        late_rows = rows.filter(late).select(F.lit(batch).cast("long").alias("batch"), F.struct("*").alias("row"))
        late_rows.write.mode("overwrite").parquet(f"{self.folder}/late/{batch}")
        found.withColumn("open", is_open).write.mode("overwrite").parquet(self._slot(batch, "spans"))
        closed = self._state(spark, batch).filter("NOT open").drop("open")
        closed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
            f"{self.folder}/sessions/{batch}"
        )
        clock = spark.range(1).select(
            F.lit(batch).cast("long").alias("batch"), F.lit(latest).cast("long").alias("latest")
        )
        clock.write.mode("overwrite").parquet(self._slot(batch, "clock"))

    def closed(self, spark: SparkSession) -> DataFrame:
        """``on, start, end, n`` of sessions that are closed."""
        return self._whole(spark, "sessions").drop("batch")

    def open(self, spark: SparkSession) -> DataFrame:
        """``on, start, end, n`` of sessions that a row on time can still reach."""
        return self._state(spark, self._last(spark)).filter("open").drop("open")

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came late or have no key or time, with their columns."""
        return self._whole(spark, "late").select("row.*")

    def _whole(self, spark: SparkSession, table: str) -> DataFrame:
        last = self._last(spark)
        return spark.read.parquet(f"{self.folder}/{table}/*").filter(F.col("batch") <= last)

    def _slot(self, batch: int, table: str) -> str:
        return f"{self.folder}/state/{batch % 2}/{table}"

    def _state(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.parquet(self._slot(batch, "spans"))

    def _clock(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(_CLOCK).parquet(self._slot(batch, "clock")).filter(F.col("batch") == batch)

    def _last(self, spark: SparkSession) -> int:
        """Number of the last whole micro-batch."""
        found = []
        for batch in (0, 1):
            try:
                clock = spark.read.schema(_CLOCK).parquet(self._slot(batch, "clock"))
                found += [r.batch for r in clock.collect()]
            except AnalysisException:  # no second micro-batch yet
                continue
        if not found:
            raise ValueError(f"no micro-batch has been written to {self.folder}")
        return max(found)

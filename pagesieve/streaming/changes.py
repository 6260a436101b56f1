"""New, changed and unchanged pages of a stream.

The state is one digest for each URL: that of the page's facts (language, title, meta
tags, links and text), so markup that a reader does not see makes no change. Digests are
made before the shuffle and no page moves. With very many URLs, let the session keep
state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesieve.plans.one_scan import page_facts

#: Places over which pages without a URL are spread.
_SPREAD = 64


def _compared(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Statuses of the pages of one URL in a micro-batch, by page_id."""
    url = key[0]
    rows = pd.concat(list(parts)).sort_values(["page_id", "digest"], ignore_index=True)
    if url is None:
        status = pd.Series(["new"] * len(rows))
    else:
        before = rows["digest"].shift(fill_value=state.get[0] if state.exists else "")
        status = (rows["digest"] == before).map({True: "same", False: "changed"})
        if not state.exists:
            status.iloc[0] = "new"
        state.update((rows["digest"].iloc[-1],))
    yield pd.DataFrame({"page_id": rows["page_id"], "url": url, "status": status})


def page_changes(pages: DataFrame) -> DataFrame:
    """``page_id, url, status`` for every page of the stream ``pages``.

    ``status`` is ``new`` for the first page of a URL, else ``changed`` or ``same`` beside
    the page of that URL before it: in order of micro-batches, and by ``page_id`` in one.
    A page without a URL is always ``new``. A page that comes twice is ``same`` then.
    """
    # The facts carry page_id along, whatever it is.
    named = pages.select(F.struct("page_id", "url").alias("page_id"), "html")
    facts = F.struct("lang", "title", "meta", "hrefs", "text")
    digests = page_facts(named).select("page_id.*", F.sha2(F.to_json(facts), 256).alias("digest"))
    spread = F.when(F.col("url").isNull(), F.pmod(F.xxhash64("page_id"), F.lit(_SPREAD)))
    return (
        digests.withColumn("spread", spread)
        .groupBy("url", "spread")
        .applyInPandasWithState(
            _compared,
            "page_id long, url string, status string",
            "digest string",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def append_changes(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the statuses of all page files not seen before to ``table``, then end."""
    return (
        page_changes(pages)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )

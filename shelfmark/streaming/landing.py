"""Structured Streaming jobs over a folder where pages and URLs land."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark import fixed_values as fixed
from shelfmark.functions import triage
from shelfmark.operators import gate, store
from shelfmark.operators.markup import ExtractConfig
from shelfmark.operators.products import extract_products
from shelfmark.schema import PAGES
from shelfmark.session import saved
from shelfmark.sources.products import in_store_form


def read_landing(spark: SparkSession, path: str, schema: T.StructType = PAGES,
                 max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """New parquet files below ``path``; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def start_extract(pages: DataFrame, store_path: str, checkpoint: str, *,
                  seq: str = "page_id", config: ExtractConfig | None = None,
                  locale: str | None = None, triage_pages: bool = True,
                  failed_path: str | None = None,
                  on_saved: Callable[[DataFrame, int], None] | None = None,
                  **trigger) -> StreamingQuery:
    """Landed pages -> valid products -> store, once per URL, resumable.

    Pages whose URL is stored already are dropped before they are parsed; only buckets of the store that
    may hold one of the batch's URLs are opened for that. A batch that is run again after a failure finds
    its rows in the store and adds none. ``on_saved`` sees the rows of each batch before they are written.
    Pages are triaged as in the batch job; pages that could not be parsed are written to ``failed_path``
    as (url, seq, error) in a folder per batch, which a batch that is run again replaces.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        held = store.open_store(batch.sparkSession, store_path)
        todo = held.drop_known(batch)
        if triage_pages:
            todo = triage.product_pages(todo)
        # parsed once and ranked once, however often the rows are read from there on
        made = saved(extract_products(todo, keep=(seq,), config=config, locale=locale), "parsed-rows")
        if failed_path is not None:
            write_batch(gate.failed_pages(made, seq), failed_path, batch_id)
        good = gate.valid_products(made.where(F.col("_error").isNull())).drop("_error")
        fresh = saved(in_store_form(store.first_per_url(good, seq).drop(seq)), "fresh-rows")
        if on_saved is not None:
            on_saved(fresh, batch_id)
        held.append(fresh, fresh.select("url"))

    return (pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """A side output of one micro-batch; running the batch again replaces its own rows only."""
    (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def distinct_urls(urls: DataFrame, within: str | None = None, ts: str = "ts") -> DataFrame:
    """Each URL once.

    Without ``within`` the state keeps every URL ever seen, as the rule says;
    with it (``"7 days"``) the state is bounded and a URL may come again later.
    """
    if within is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(ts, within).dropDuplicatesWithinWatermark(["url"])


_OUTCOME = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("attempt_id", T.LongType()),
    T.StructField("retry_no", T.IntegerType()),
    T.StructField("outcome", T.StringType()),
])


def retry_outcomes(attempts: DataFrame, retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Failed attempts with their outcome; the state of a URL is one counter.

    Attempts of a micro-batch are taken in (ts, attempt_id) order. A group
    comes in parts; between parts only the earliest few rows are held back,
    so a URL with very many failures does not have to fit in memory.
    """
    def outcome(url: str, rows: pd.DataFrame, first: int) -> pd.DataFrame:
        """Numbered from ``first``; 0 marks an attempt past the last retry."""
        numbers = range(first, first + len(rows)) if first else 0
        return pd.DataFrame({"url": url, "attempt_id": rows["attempt_id"].to_numpy(),
                             "retry_no": numbers, "outcome": "requeue" if first else "discard"})

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        early = None
        for part in parts:
            rows = part if early is None else pd.concat([early, part])
            rows = rows.sort_values(["ts", "attempt_id"])
            early, late = rows.iloc[:retries - used], rows.iloc[retries - used:]
            if len(late):
                yield outcome(key[0], late, 0)
        state.update((used + len(early),))
        if len(early):
            yield outcome(key[0], early, used + 1)

    return (attempts.where(~F.col("ok")).select("url", "ts", "attempt_id").groupBy("url")
            .applyInPandasWithState(step, _OUTCOME, "used int", "append",
                                    GroupStateTimeout.NoTimeout)
            .withColumn("retry_no", F.nullif("retry_no", F.lit(0))))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed so far into a parquet folder and stop."""
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())

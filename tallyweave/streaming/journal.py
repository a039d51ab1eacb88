"""Streams: appending to hash chains, deduplication, windows, replay and first-wins points, with Structured Streaming state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.operators.logs import GENESIS

ENTRY = "journal string, seq bigint, prev_hash string, body string, entry_hash string"


def chain(observations: DataFrame, key: str, at: str, body: str) -> DataFrame:
    """Journal entries of a stream of observations: each chained on its journal's last, whose number and hash are the state.

    Within a micro-batch observations are appended in order of `at`, then body. Works on streams only; state is keyed by
    journal, so journals are spread over tasks. A journal's observations of one micro-batch are ordered in memory: bound
    the batches of large sources by their own options (maxFilesPerTrigger, maxBytesPerTrigger, maxOffsetsPerTrigger).
    """

    def append(group: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, prev = state.get if state.exists else (0, GENESIS)
        out = []
        for when, text in sorted((r.at, "" if r.body is None else r.body) for b in batches for r in b.itertuples()):
            digest = hashlib.sha256("\n".join((group[0], str(seq), prev, text)).encode()).hexdigest()
            out.append((group[0], seq, prev, text, digest))
            seq, prev = seq + 1, digest
        state.update((seq, prev))
        yield pd.DataFrame(out, columns=["journal", "seq", "prev_hash", "body", "entry_hash"])

    slim = observations.select(F.col(key).cast("string").alias("journal"), F.col(at).alias("at"), F.col(body).cast("string").alias("body"))
    return slim.groupBy("journal").applyInPandasWithState(append, ENTRY, "seq bigint, prev string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: list[str], at: str, delay: str = "5 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, at: str, width: str, keys: list[str], delay: str = "5 minutes") -> DataFrame:
    """(window start, keys, count): events by tumbling window; late ones beyond the watermark are left out."""
    x = events.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("events"))
    return x.select(F.col("window.start").alias("start"), *keys, "events")


def within_replay(events: DataFrame, signed_at: str, received_at: str, seconds: int = 300) -> DataFrame:
    """Events received at most so long after they were signed, and not before."""
    gap = F.unix_timestamp(received_at) - F.unix_timestamp(signed_at)
    return events.filter((gap >= 0) & (gap <= seconds))


def first_points(records: DataFrame) -> DataFrame:
    """(contributor, content_hash): the credited records of a stream, one per hash for ever; first come, first served."""

    def mint(group: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("index")
        if state.exists or rows.empty:
            yield pd.DataFrame({"contributor": [], "content_hash": []})
            return
        state.update((int(rows["index"].iloc[0]),))
        yield pd.DataFrame({"contributor": [rows["contributor"].iloc[0]], "content_hash": [group[0]]})

    bound = records.filter("author_bound").select(F.lower("content_hash").alias("content_hash"), F.lower("contributor").alias("contributor"), "index")
    return bound.groupBy("content_hash").applyInPandasWithState(mint, "contributor string, content_hash string", "first bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an appending stream over what its source holds now into parquet files below `folder`; gives them as a table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

"""File-event streams: deduplication, windows, debouncing, delta application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE, MAX_WAIT = 5.0, 30.0


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a time-zoned event time and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, width: str, *keys: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, keys, n, total); on a stream or a table."""
    return _windowed(df, F.window(ts, width), keys, value)


def sliding(df: DataFrame, width: str, slide: str, *keys: str, ts: str = "ts", value: str = "value") -> DataFrame:
    return _windowed(df, F.window(ts, width, slide), keys, value)


def sessions(df: DataFrame, gap: str, *keys: str, ts: str = "ts") -> DataFrame:
    """(keys, session_start, session_end, n): events of a key until it is silent for ``gap``."""
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _windowed(df: DataFrame, w: Column, keys: tuple[str, ...], value: str) -> DataFrame:
    out = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def latest_event(df: DataFrame, *keys: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last event of every key, by aggregation: the state of a stream is one row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("e")).select(*keys, "e.*")


def exact_duplicates_removed(df: DataFrame, *keys: str) -> DataFrame:
    """Streams: repeated events within the watermark go."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def debounced(df: DataFrame, key: str = "path", ts: str = "ts", gap: float = DEBOUNCE, cap: float = MAX_WAIT) -> DataFrame:
    """(key, first_event, last_event, n): bursts that end after ``gap`` silent seconds or ``cap`` seconds in all.

    A session window has no greatest length, so a stateful operator keeps the open burst of each key and a timer. ``ts``: timestamp
    with a watermark on a stream; on a table bursts are the same."""
    schema = f"{key} string, first_event double, last_event double, n long"

    def bursts(state: tuple | None, times: Iterator[float]) -> Iterator[tuple]:
        """Closed bursts, then the open one marked by a trailing True."""
        for t in times:
            if state is None:
                state = (t, t, 1)
            elif t - state[1] >= gap or t - state[0] >= cap:
                yield (*state, False)
                state = (t, t, 1)
            else:
                state = (state[0], t, state[2] + 1)
        if state is not None:
            yield (*state, True)

    if not df.isStreaming:
        import pandas as pd

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, state = None, None
            for pdf in batches:  # rows sorted by key and time, as they come: no key's history is held
                out = []
                for k, t in zip(pdf[key], pdf["t"], strict=True):
                    if state is not None and k != name:
                        out.append((name, *state))
                        state = None
                    name = k
                    for *burst, open_ in bursts(state, iter([t])):
                        if open_:
                            state = tuple(burst)
                        else:
                            out.append((k, *burst))
                yield pd.DataFrame(out, columns=[key, "first_event", "last_event", "n"])
            if state is not None:
                yield pd.DataFrame([(name, *state)], columns=[key, "first_event", "last_event", "n"])

        timed = df.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").cast("double").alias("t"))
        return timed.repartition(key).sortWithinPartitions(key, "t").mapInPandas(whole, schema)

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((k[0], *state.get))
            state.remove()
        else:
            times = sorted(t for pdf in pdfs for t in pdf["t"])
            for first, last, n, open_ in bursts(state.get if state.exists else None, iter(times)):
                if open_:
                    state.update((first, last, n))
                    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(min(last + gap, first + cap) * 1000)))
                else:
                    out.append((k[0], first, last, n))
        yield pd.DataFrame(out, columns=[key, "first_event", "last_event", "n"])

    timed = df.select(F.col(key).cast("string").alias(key), F.col(ts).cast("double").alias("t"), ts)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "first_event double, last_event double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def cooled_down(df: DataFrame, *keys: str, ts: str = "ts", seconds: float = 10.0) -> DataFrame:
    """Events with ``deferred`` set where the key's event before came less than ``seconds`` ago (tables)."""
    from pyspark.sql import Window

    before = F.lag(F.col(ts).cast("timestamp").cast("double")).over(Window.partitionBy(*keys).orderBy(ts, "event_id"))
    return df.withColumn("deferred", F.coalesce(F.col(ts).cast("timestamp").cast("double") - before < seconds, F.lit(False)))


def significant(changes: DataFrame, least: str = "MODERATE") -> DataFrame:
    """Changes that are worth a new embedding: of this significance or a higher one. ``changes``: uid, change, significance."""
    levels = ["MODERATE", "HIGH"]
    return changes.where(F.col("change").isin("added", "modified") & F.col("significance").isin(*levels[levels.index(least) :]))


def with_backlog(batch: DataFrame, backlog: DataFrame | None, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(to be tried now, given up): a micro-batch with what earlier ones left open, tried less than ``attempts`` times so far (column ``tries``)."""
    now = batch.withColumn("tries", F.lit(0))
    if backlog is None:
        return now, now.where("false")
    return now.unionByName(backlog.where(F.col("tries") < attempts), allowMissingColumns=True), backlog.where(F.col("tries") >= attempts)


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], park: Callable[[DataFrame, int, Exception], None], checkpoint: str, keys: tuple[str, ...] = ("project_name", "path"), attempts: int = 5, **trigger) -> StreamingQuery:
    """Run ``apply`` on the latest event per key of every micro-batch. A batch that fails ``attempts`` times is handed to ``park`` (a dead-letter
    table) and the stream goes on; offsets in ``checkpoint`` make a restart resume where it stopped."""

    def one(batch: DataFrame, epoch: int) -> None:
        latest = latest_event(batch, *keys)
        for attempt in range(attempts):
            try:
                return apply(latest, epoch)
            except Exception as error:  # noqa: BLE001  the batch is parked with its error
                if attempt == attempts - 1:
                    park(latest, epoch, error)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

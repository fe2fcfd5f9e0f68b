"""Timers as state of a stream: workers that fall silent, drains that run out.

State lies in the RocksDB state store and goes when its timer fires, so it is as large as the keys that are alive. Keys are dealt to BUCKETS buckets, each with one value of state and
one timer, so that a batch's rows are taken side by side and a call into Python serves many keys. The time is that of the rows; a watermark drives it. Rows of a key that come in one batch are taken in order of time; across batches a row older than what its key has seen
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The store that keeps state with timers; to be set before a query starts.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of keys; a stream goes on with the number that its checkpoint began with.
BUCKETS = 512


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def keyed(after: int, names: list[str]) -> type[StatefulProcessor]:
    """The base of the processors: the state of a bucket's keys, as one table (key, seen, value) with the time of each key's last row, and one timer at the first of them to
    run out, `after` milliseconds later. A class of its own each time, so that it travels with the query and executors need no installation of this package."""

    class Keyed(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("keys", "data binary, timer bigint")

        def _load(self) -> None:
            self.keys, self.seen, self.value, self.timer = [], np.empty(0, np.int64), np.empty(0, np.int64), None
            if self.state.exists():
                data, self.timer = self.state.get()
                with pa.ipc.open_stream(bytes(data)) as stream:
                    held = stream.read_all()
                self.keys, self.seen, self.value = held["key"].to_pylist(), held["seen"].to_numpy(), held["value"].to_numpy()

        def _keep(self, fired: bool = False) -> None:
            """Writes the state and sets the timer anew. A timer fires when the watermark has passed it, hence one millisecond less."""
            timer = int(self.seen.min()) + after - 1 if self.keys else None
            if timer != self.timer:
                if self.timer is not None and not fired:
                    self.handle.deleteTimer(self.timer)
                if timer is not None:
                    self.handle.registerTimer(timer)
            if timer is None:
                self.state.clear()
                return
            batch = pa.record_batch([pa.array(self.keys, pa.string()), pa.array(self.seen), pa.array(self.value)], ["key", "seen", "value"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            self.state.update((sink.getvalue().to_pybytes(), timer))

        def _find(self, keys: pd.Series) -> np.ndarray:
            """Places of the keys in the state, -1 for none."""
            return pd.Index(self.keys, dtype=object).get_indexer(keys)

        def _put(self, at: np.ndarray, keys: pd.Series, seen: np.ndarray, value: np.ndarray) -> None:
            """Sets each of these different keys."""
            new = at < 0
            now_seen, now_value = self.seen.copy(), self.value.copy()
            now_seen[at[~new]], now_value[at[~new]] = seen[~new], value[~new]
            self.keys = [*self.keys, *keys[new]]
            self.seen, self.value = np.concatenate([now_seen, seen[new]]), np.concatenate([now_value, value[new]])

        def _forget(self, until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Takes out the keys (key, seen, value) that have run out."""
            due, keys = self.seen + after <= until, np.array(self.keys, object)
            out = keys[due], self.seen[due], self.value[due]
            self.keys, self.seen, self.value = keys[~due].tolist(), self.seen[~due], self.value[~due]
            return out

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            self._load()
            out = self.take(rows)
            self._keep()
            yield out[names]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._load()
            out = self.gone(*self._forget(timerValues.getCurrentWatermarkInMs()))
            self._keep(fired=True)
            yield out[names]

        def close(self) -> None:
            pass

    return Keyed


def by_bucket(rows: DataFrame, key: str, ts: str, more: list[Column], delay: str, processor: StatefulProcessor, out: list[str]) -> DataFrame:
    """Runs a processor over the rows (key, ts, more), dealt to buckets by their key. The first column that comes out is the key."""
    at, kind = F.col(ts).cast("timestamp"), rows.schema[key].dataType
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a null key is a key
    own = rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), text.alias("key"), at.alias("_at"), F.unix_millis(at).alias("ts"), *more).withWatermark("_at", delay)
    schema = StructType().add("key", "string")
    for name in out[1:]:
        schema = schema.add(name, "long")
    got = own.groupBy("bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
    return got.select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(key), *out[1:])


def expiry(after: int) -> StatefulProcessor:
    """The processor of `expiries`."""

    class Expiry(keyed(after, ["key", "started", "expired"])):
        """Of rows (key, ts, starts): one that starts sets the key's timer anew, `after` milliseconds ahead; one that does not takes it away. A timer that runs out before the key's
        next row gives (key, started, expired)."""

        def take(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(list(rows)).sort_values(["key", "ts", "tie"], kind="stable")
            at = self._find(part["key"])
            known = at >= 0
            fresh = ~known
            fresh[known] = part["ts"].to_numpy(np.int64)[known] >= self.seen[at[known]]
            part, at, known = part[fresh], at[fresh], known[fresh]
            keys, ts, starts = part["key"].to_numpy(object), part["ts"].to_numpy(np.int64), part["starts"].to_numpy(bool)
            first = np.ones(len(ts), bool)
            first[1:] = keys[1:] != keys[:-1]
            before, running = np.roll(ts, 1), np.roll(starts, 1)  # the row before, or what the state holds
            running[first] = False
            held = first & known
            before[held], running[held] = self.seen[at[held]], self.value[at[held]] > 0
            over = running & (before + after < ts)
            last = np.roll(first, -1)  # a key's last row comes before the next key's first
            self._put(at[last], part["key"][last], ts[last], starts[last].astype(np.int64))
            return pd.DataFrame({"key": keys[over], "started": before[over], "expired": before[over] + after})

        def gone(self, keys: np.ndarray, seen: np.ndarray, value: np.ndarray) -> pd.DataFrame:
            ran = value > 0
            return pd.DataFrame({"key": keys[ran], "started": seen[ran], "expired": seen[ran] + after})

    return Expiry()


def expiries(rows: DataFrame, key: str, ts: str, starts, tie: str, after_ms: int, delay: str = "0 seconds") -> DataFrame:
    """A stream's rows as expiries (key, started, expired), times in milliseconds; append mode. A timer fires once the watermark, the latest time less `delay`,
    has reached it."""
    return by_bucket(rows, key, ts, [starts.alias("starts"), F.col(tie).alias("tie")], delay, expiry(after_ms), [key, "started", "expired"])


def offline_workers(pings: DataFrame, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Workers that sent no ping for the timeout: (worker_id, started: the last ping, expired)."""
    return expiries(pings, "worker_id", "ts", F.lit(True), "event_id", timeout_ms, delay)


def drained(rows: DataFrame, ticks_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Drains that ran their time: rows (pair, ts, begins, event_id); one that does not begin a drain takes it back."""
    return expiries(rows, "pair", "ts", F.col("begins"), "event_id", ticks_ms, delay)


def echo(after: int) -> StatefulProcessor:
    """The processor of `echo_changes`."""

    class Echo(keyed(after, ["key", "before", "now", "at"])):
        """Of pings (key, ts, id): keeps the id of the key's last ping and when it came; gives (key, before, now, at) when the id changes, with null for none. A key
        without a ping for `after` milliseconds is forgotten, which is a change to none."""

        def take(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
            last = None
            for part in rows:  # no more than the last ping of each key is held
                part = part if last is None else pd.concat([last, part])
                last = part.sort_values(["ts", "tie"], kind="stable").drop_duplicates("key", keep="last")
            at = self._find(last["key"])
            known = at >= 0
            fresh = ~known
            fresh[known] = last["ts"].to_numpy(np.int64)[known] >= self.seen[at[known]]
            last, at, known = last[fresh], at[fresh], known[fresh]
            ts, now, before = last["ts"].to_numpy(np.int64), last["id"].to_numpy(np.int64), np.zeros(len(last), np.int64)
            before[known] = self.value[at[known]]
            self._put(at, last["key"], ts, now)
            out = pd.DataFrame({"key": last["key"].to_numpy(object), "before": pd.arrays.IntegerArray(before, ~known), "now": pd.array(now, "Int64"), "at": ts})
            return out[~known | (before != now)]

        def gone(self, keys: np.ndarray, seen: np.ndarray, value: np.ndarray) -> pd.DataFrame:
            none = pd.arrays.IntegerArray(np.zeros(len(keys), np.int64), np.ones(len(keys), bool))
            return pd.DataFrame({"key": keys, "before": pd.array(value, "Int64"), "now": none, "at": seen + after})

    return Echo()


def echo_changes(pings: DataFrame, after_ms: int, delay: str = "0 seconds") -> DataFrame:
    """A stream's pings (worker_id, ts, applied_id, event_id) as changes (worker_id, before, now, at) of what workers that are online echo; -1 is an echo of nothing."""
    more = [F.coalesce(F.col("applied_id").cast("bigint"), F.lit(-1)).alias("id"), F.col("event_id").alias("tie")]
    return by_bucket(pings, "worker_id", "ts", more, delay, echo(after_ms), ["worker_id", "before", "now", "at"])


def run_to_end(spark: SparkSession, out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The stream over what its source holds now, as a table in `folder`; a second call goes on from the first one's checkpoint."""
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")

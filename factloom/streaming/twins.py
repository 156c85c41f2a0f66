"""Streaming twins of stateful operators; each gives what its batch operator gives over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructType

#: Keys of a stream are dealt to so many buckets. Each is one group for Spark, whose keys are worked on together; a call for each key costs milliseconds.
BUCKETS, BUCKET = 1024, "_bucket"


def _dealt(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """The state of a bucket: a table with a row for each of its keys."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _held(state: GroupState) -> list[pd.DataFrame]:
    """The table of a bucket's state, if there is one."""
    return [pa.ipc.open_stream(bytes(state.get[0])).read_pandas()] if state.exists else []


def _behind(held: list[pd.DataFrame], rows: pd.DataFrame, *keys: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """What is held and the rows after it, the number of each one's key by first appearance, and which of them are rows."""
    both = pd.concat([*held, rows], ignore_index=True).astype({k: object for k in rows.columns if rows[k].dtype == object})
    new = np.arange(len(both)) >= len(both) - len(rows)
    return both, both.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy(), new


def tally_stream(episodes: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(begin, state, n) in event-time windows; rows later than the watermark are left out."""
    at = episodes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "state").agg(F.count("*").alias("n"))
    return at.select(F.col("w.start").alias("begin"), "state", "n")


def reinforce_stream(sights: DataFrame) -> DataFrame:
    """Running provenance (s, r, o, source, confidence, count, last_seen), in complete or update mode."""
    from ..operators.provenance import reinforced

    return reinforced(sights)


def drift_stream(episodes: DataFrame) -> DataFrame:
    """Drift events as they arrive; the last state and symbol of each subject and relation is kept.

    Rows are ordered by (ts, id) within a micro-batch.
    """
    cols = ["subject", "relation", "state", "symbol"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], ignore_index=True)
        both, code, new = _behind(_held(state), rows[cols], "subject", "relation")
        by = both.groupby(code)
        was, now = by[["state", "symbol"]].shift(), both[["state", "symbol"]]
        moved = ((was != now) & ~(was.isna() & now.isna())).any(axis=1) & (by.cumcount() > 0)
        state.update(_packed(both[~pd.Series(code).duplicated(keep="last")]))
        rows[["was_state", "was_symbol"]] = was[new].to_numpy()
        yield rows.loc[moved[new].to_numpy(), ["id", "subject", "relation", "was_state", "state", "was_symbol", "symbol"]]

    return _dealt(episodes, "subject", "relation").groupBy(BUCKET).applyInPandasWithState(step, "id long, subject string, relation string, was_state string, state string, was_symbol string, symbol string", "keys binary", "append", GroupStateTimeout.NoTimeout)


def fold_stream(log: DataFrame) -> DataFrame:
    """(s, r, o, n): copies left of each fact after each micro-batch of a log (seq, op, s, r, o), in update mode."""
    cols = ["s", "r", "o"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        both, code, new = _behind(_held(state), rows[cols].assign(n=rows["op"].eq("store").mul(2).sub(1)), *cols)
        run = both["n"].groupby(code).cumsum()  # what is held is where the sum begins
        sums = run.groupby(code)
        left = both[cols][~pd.Series(code).duplicated()].assign(n=(sums.last() - sums.min().clip(upper=0)).to_numpy("int64"))
        state.update(_packed(left[left["n"] > 0]))
        yield left[np.bincount(code[new], minlength=len(left)) > 0]

    return _dealt(log, *cols).groupBy(BUCKET).applyInPandasWithState(step, "s string, r string, o string, n long", "keys binary", "update", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(subject, begin, end, n) of events (subject, ts): runs without a longer gap, in append mode.

    A session is given once the watermark has passed its end; its state goes then.
    """
    at = events.withWatermark("ts", late).groupBy("subject", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return at.select("subject", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def distinct_stream(events: DataFrame, key: str = "id", late: str = "1 day") -> DataFrame:
    """Each event once, however often it arrives within the watermark; the state holds keys only as long."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def referred(turns: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Read turns (conv, turn, ts, ..., own_entity, own_relation) with last_entity and last_relation of their conversation, in append mode.

    A conversation's turns come in order. Its state ends when the watermark is so far
    past its last turn, and what comes later begins anew.
    """
    schema = StructType(list(turns.schema.fields)).add("last_entity", StringType()).add("last_relation", StringType())
    own, last = ["own_entity", "own_relation"], ["last_entity", "last_relation"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, past = _held(state), state.getCurrentWatermarkMs()
        ends = held[0] if held else pd.DataFrame({"conv": [], "ends": []})
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("turn", ignore_index=True)
            both, code, new = _behind(held, rows[["conv", *own]].assign(ends=np.maximum(rows["ts"].to_numpy("datetime64[ms]").astype("int64"), past) + keep_ms), "conv")
            seen = both[own].astype(object).groupby(code).ffill()
            rows[last] = seen.groupby(code).shift()[new].to_numpy()
            yield rows[schema.names]
            both[own], both["spoke"] = seen, np.bincount(code[new], minlength=code.max() + 1)[code] > 0
            both["ends"] = both["ends"].where(new | ~both["spoke"], 0).groupby(code).transform("max")  # turns put the end anew
            ends = both[~pd.Series(code).duplicated(keep="last")]
            ends = ends[ends["spoke"] | (ends["ends"] >= past)][["conv", *own, "ends"]]
        else:
            ends = ends[ends["ends"] >= past]
        if len(ends):
            state.update(_packed(ends))
            state.setTimeoutTimestamp(int(ends["ends"].min()))
        else:
            state.remove()

    return _dealt(turns.withWatermark("ts", late), "conv").groupBy(BUCKET).applyInPandasWithState(step, schema, "keys binary", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Drives a stream over what there is; write gets each micro-batch once. Returns how many rows came after their watermark and were left out."""
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])

"""Streams that keep more than a running aggregate: connections, and data that wait for their template.

The processors keep their state in RocksDB (``keep_state_in_rocksdb``), let go of it by event-time timers, and handle the
rows of a key and micro-batch as arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sessions import KEYS, with_ends
from ..operators.tcp import FACTS, STATES, machine
from ..sources.netflow import FIELDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """For the queries that start from now on; ``transformWithState`` asks for it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


TCP_ROW = "ep_a string, ep_b string, protocol string, start_us long, state string, handshake boolean, rtt_ms double, packets long, fwd_duplicates long, rev_duplicates long, fwd_out_of_order long, rev_out_of_order long, expired boolean"
TCP_STATE = "initiator string, number int, start_us long, last_us long, syn_us long, handshake boolean, rtt_ms double, packets long, again array<long>, late array<long>, expected array<long>, timer_ms long"


class Connections(StatefulProcessor):
    """The connection of one pair of ends: its state in one value, its sequence numbers in a map."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", TCP_STATE)
        self.seen = handle.getMapState("seen", "forward boolean, seq long, length long", "n long")
        self.table = machine()

    def _row(self, key, s: dict, expired: bool) -> list:
        return [*key, s["start_us"], STATES[s["number"] // 4], s["handshake"], s["rtt_ms"], s["packets"], *s["again"][::-1], *s["late"][::-1], expired]

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TCP_ROW.split(", ")])

    def _begin(self, rows: pd.DataFrame) -> dict:
        self.seen.clear()
        first = rows.iloc[0]
        return {"initiator": first["src"], "number": 0, "start_us": int(first["ts_us"]), "last_us": 0, "syn_us": None, "handshake": False, "rtt_ms": None, "packets": 0, "again": [0, 0], "late": [0, 0], "expected": [0, 0], "timer_ms": 0}

    def _fold(self, s: dict, rows: pd.DataFrame) -> None:
        """The packets of one session, in order. Lists of two hold the reverse direction first."""
        forward = (rows["src"] == s["initiator"]).to_numpy()
        code = sum((forward if f == "forward" else rows[f].to_numpy().astype(bool)).astype(int) << i for i, f in enumerate(FACTS))
        times = rows["ts_us"].to_numpy()
        number = s["number"]
        for c, t in zip(code.tolist(), times.tolist()):
            number, mark = self.table[number][c]
            if mark == "open":
                s["syn_us"] = t
            elif mark == "shake":
                s["handshake"] = True
                if s["syn_us"] is not None:
                    s["rtt_ms"] = (t - s["syn_us"]) / 1000
        s["number"] = number
        for d, q, n, reset in zip(forward.astype(int).tolist(), rows["tcp_seq"].tolist(), rows["payload_len"].tolist(), rows["rst"].tolist()):
            if 0 < s["expected"][d] and q < s["expected"][d] and not reset:
                s["late"][d] += 1
            elif q > 0:
                s["expected"][d] = max(s["expected"][d], q + max(n, 1))
        counts = pd.DataFrame({"d": forward, "q": rows["tcp_seq"], "n": rows["payload_len"]}).value_counts()
        for (d, q, n), count in counts.items():
            place = (bool(d), int(q), int(n))
            before = self.seen.getValue(place)[0] if self.seen.containsKey(place) else 0
            self.seen.updateValue(place, (before + int(count),))
            s["again"][int(d)] += int(count) - (0 if before else 1)
        s["packets"] += len(rows)
        s["last_us"] = int(times[-1])

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"], kind="stable")
        s = self.now.get() if self.now.exists() else None
        s = dict(zip([x.split()[0] for x in TCP_STATE.split(", ")], map(lambda v: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v, s))) if s else None
        out = []
        for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(frame["ts_us"].to_numpy()) > self.timeout_us) + 1):
            rows = frame.iloc[part]
            if s and int(rows["ts_us"].iloc[0]) - s["last_us"] > self.timeout_us:
                out.append(self._row(key, s, True))
                s = self._begin(rows) | {"timer_ms": s["timer_ms"]}
            s = s or self._begin(rows)
            self._fold(s, rows)
        out.append(self._row(key, s, False))
        if not s["timer_ms"]:
            s["timer_ms"] = self._deadline(s, timerValues)
            self.handle.registerTimer(s["timer_ms"])
        self.now.update(tuple(s.values()))
        yield self._frame(out)

    def _deadline(self, s: dict, timerValues) -> int:
        return max((s["last_us"] + self.timeout_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = dict(zip([x.split()[0] for x in TCP_STATE.split(", ")], self.now.get()))
        due = (s["last_us"] + self.timeout_us) // 1000 + 1
        if due > expiredTimerInfo.getExpiryTimeInMs():  # packets came since the timer was set
            s["timer_ms"] = max(due, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(s["timer_ms"])
            self.now.update(tuple(s.values()))
            yield self._frame([])
            return
        self.now.clear()
        self.seen.clear()
        yield self._frame([self._row(key, s, True)])

    def close(self) -> None:
        pass


def stream_tcp_state(flows: DataFrame, timeout_us: int, watermark: str = "0 seconds") -> DataFrame:
    """By connection and session (``start_us``), after each micro-batch that has it and once more when it ends: state,
    handshake, round trip, packets, and each way the repeats of (tcp_seq, payload_len) and the packets below what was
    expected. A session ends when no packet came for the timeout; its state leaves then.

    Packets of one micro-batch are taken in order of time, those of the next after them; rows later than the watermark are
    dropped and counted by Spark."""
    rows = with_ends(flows.where("protocol = 'TCP'")).select("ts", "ts_us", "event_id", F.col("_src").alias("src"), *KEYS, *[f for f in FACTS if f != "forward"], F.coalesce("tcp_seq", F.lit(0)).alias("tcp_seq"), F.coalesce("payload_len", F.lit(0)).cast("long").alias("payload_len"))
    return rows.withWatermark("ts", watermark).groupBy(*KEYS).transformWithStateInPandas(Connections(timeout_us), TCP_ROW, "append", "EventTime")


DATA = ["seq", "unix_secs", "uptime_ms", "body"]
WAITING = "seq long, unix_secs long, uptime_ms long, body binary"
RESOLVED = f"source_id long, template_id int, {WAITING}, fields string, resolution string"


class Templates(StatefulProcessor):
    """The newest template of one exporter, and the data that came before any."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "seq long, fields string")
        self.waiting = handle.getListState("waiting", WAITING)

    def _frame(self, key, rows: pd.DataFrame, fields, resolution) -> pd.DataFrame:
        out = rows[DATA].copy()
        out.insert(0, "source_id", key[0])
        out.insert(1, "template_id", key[1])
        return out.assign(fields=fields, resolution=resolution)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["seq", "fields"], kind="stable")
        data, new = frame[frame["fields"].isna()], frame[frame["fields"].notna()]
        marks = [tuple(self.newest.get())] if self.newest.exists() else []
        marks += [*zip(new["seq"].tolist(), new["fields"].tolist())]
        if not marks:
            if not self.waiting.exists():
                self.handle.registerTimer(max(int(frame["unix_secs"].max()) * 1000, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
            self.waiting.appendList([(int(q), int(u), int(m), bytes(b)) for q, u, m, b in data[DATA].itertuples(index=False)])
            return
        marks.sort()
        if self.waiting.exists():
            data = pd.concat([pd.DataFrame([*self.waiting.get()], columns=DATA), data[DATA]])
            self.waiting.clear()
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
        if len(new):
            self.newest.update(marks[-1])
        at = np.searchsorted([m[0] for m in marks], data["seq"].to_numpy(), side="right") - 1
        fields = np.array([m[1] for m in marks], object)[np.maximum(at, 0)]
        if len(data):
            yield self._frame(key, data, fields, np.where(at >= 0, "before", "after"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows = pd.DataFrame([*self.waiting.get()], columns=DATA)
        self.waiting.clear()
        if len(rows):
            yield self._frame(key, rows, None, "none")

    def close(self) -> None:
        pass


def stream_template_join(flowsets: DataFrame, wait: str = "1 hour", watermark: str = "1 minute", shards: int = 8) -> DataFrame:
    """Data flowsets of a stream (source_id, template_id, seq, kind, unix_secs, uptime_ms, fields, body) with the fields of
    their template, as ``templates.template_join`` gives them: the newest at or before ``seq``, or the first that comes where
    there was none. Data that wait longer than ``wait`` leave with resolution none.

    An exporter's data are dealt to ``shards`` states, and its few templates go to each. A template that is older than the
    newest counts for the data of its own micro-batch alone."""
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    deal = F.when(F.col("kind") == "template", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod("seq", F.lit(shards)).cast("int")))
    rows = flowsets.where("kind in ('template', 'data')").withColumn("ts", F.timestamp_seconds("unix_secs")).withColumn("shard", F.explode(deal))
    fields = F.when(F.col("kind") == "template", F.to_json("fields"))
    rows = rows.select("ts", F.col("source_id").cast("long"), F.col("template_id").cast("int"), "shard", "seq", "unix_secs", "uptime_ms", F.coalesce("body", F.lit(b"")).alias("body"), fields.alias("fields"))
    out = rows.withWatermark("ts", watermark).groupBy("source_id", "template_id", "shard").transformWithStateInPandas(Templates(wait_ms), RESOLVED, "append", "EventTime")
    return out.withColumn("fields", F.from_json("fields", FIELDS))

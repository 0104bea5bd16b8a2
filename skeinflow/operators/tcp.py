"""The state machine of a TCP connection as one declared table, and its two readers: column expressions for a fold in a
batch, and a table of integers for a stream."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STATES = ("SYN_SENT", "SYN_RCVD", "ESTABLISHED", "MIDSTREAM_ESTABLISHED", "HALF_OPEN_OBSERVED", "FIN_WAIT", "CLOSED")
#: What is known of a packet, in this order in a packet's code.
FACTS = ("forward", "syn", "ack", "fin", "rst")

#: (state or None for any, what must hold, next state, mark); the first rule that holds is the transition, without one the
#: state stays. ``peer_fin``: the other side has finished. Marks: finish - this side has; open - the time of the SYN counts;
#: shake - the handshake is complete.
RULES = (
    (None, {"rst": True}, "CLOSED", None),
    (None, {"fin": True, "peer_fin": True}, "CLOSED", "finish"),
    (None, {"fin": True}, "FIN_WAIT", "finish"),
    ("SYN_SENT", {"forward": True, "syn": True, "ack": False}, "SYN_SENT", "open"),
    ("SYN_SENT", {"forward": False, "syn": True, "ack": True}, "SYN_RCVD", None),
    ("SYN_SENT", {"forward": True, "syn": False}, "MIDSTREAM_ESTABLISHED", None),
    ("SYN_SENT", {"forward": False, "syn": False}, "HALF_OPEN_OBSERVED", None),
    ("SYN_RCVD", {"forward": True, "ack": True, "syn": False}, "ESTABLISHED", "shake"),
)


def start_state() -> Column:
    """The state before the first packet."""
    none = F.lit(None)
    return F.struct(F.lit("SYN_SENT").alias("state"), F.lit(False).alias("fwd_fin"), F.lit(False).alias("rev_fin"), none.cast("long").alias("syn_us"), F.lit(False).alias("handshake"), none.cast("double").alias("rtt_ms"))


def step(state: Column, row: Column) -> Column:
    """The state of a connection after a packet (forward, syn, ack, fin, rst, ts_us)."""
    facts = {f: row[f] for f in FACTS} | {"peer_fin": F.when(row["forward"], state["rev_fin"]).otherwise(state["fwd_fin"])}
    after = mark = None
    for was, needs, becomes, sets in RULES:
        holds = F.lit(True) if was is None else state["state"] == was
        for fact, wanted in needs.items():
            holds = holds & (facts[fact] if wanted else ~facts[fact])
        after = F.when(holds, becomes) if after is None else after.when(holds, becomes)
        mark = F.when(holds, F.lit(sets)) if mark is None else mark.when(holds, F.lit(sets))
    is_marked = lambda m: F.coalesce(mark == m, F.lit(False))
    rtt = F.when(is_marked("shake") & state["syn_us"].isNotNull(), (row["ts_us"] - state["syn_us"]) / 1000.0).otherwise(state["rtt_ms"])
    return F.struct(
        after.otherwise(state["state"]).alias("state"), (state["fwd_fin"] | (is_marked("finish") & row["forward"])).alias("fwd_fin"), (state["rev_fin"] | (is_marked("finish") & ~row["forward"])).alias("rev_fin"),
        F.when(is_marked("open"), row["ts_us"]).otherwise(state["syn_us"]).alias("syn_us"), (state["handshake"] | is_marked("shake")).alias("handshake"), rtt.alias("rtt_ms"),
    )


def machine() -> list[list[tuple[int, str | None]]]:
    """The rules as a table: state number and packet code -> (state number, mark). A state number is the place in ``STATES``
    times four, with two bits for which side has finished (forward 1, reverse 2); a code has a bit for each of ``FACTS``."""
    out = []
    for number in range(4 * len(STATES)):
        row = []
        for code in range(1 << len(FACTS)):
            facts = {f: bool(code >> i & 1) for i, f in enumerate(FACTS)}
            facts["peer_fin"] = bool(number & (2 if facts["forward"] else 1))
            rule = next((r for r in RULES if r[0] in (None, STATES[number // 4]) and all(facts[f] == w for f, w in r[1].items())), None)
            after, mark = (STATES.index(rule[2]), rule[3]) if rule else (number // 4, None)
            fins = number & 3 | ((1 if facts["forward"] else 2) if mark == "finish" else 0)
            row.append((4 * after + fins, mark))
        out.append(row)
    return out

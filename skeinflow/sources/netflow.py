"""NetFlow v9 export: datagrams -> flowsets and templates -> records. The data-template join is ``templates.template_join``."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FIELDS = "array<struct<type:int,len:int>>"
FLOWSET = f"source_id long, seq long, unix_secs long, uptime_ms long, kind string, template_id int, fields {FIELDS}, body binary, scope_fields int"

#: Field types that records give, and protocol numbers.
FIELD_TYPES = {"in_bytes": 1, "in_packets": 2, "protocol": 4, "tcp_flags": 6, "src_port": 7, "src_v4": 8, "dst_port": 11, "dst_v4": 12, "last_ms": 21, "first_ms": 22}
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPV6"}
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def _split(payload: bytes):
    """(kind, template_id, fields, body, scope fields) of each flowset; kind "corrupt" for what breaks its bounds. An options
    template's fields are those of its scope, so many, and then its options."""
    if payload is None or len(payload) < 20 or struct.unpack_from("!H", payload)[0] != 9:
        return (0, 0, 0, 0), [("corrupt", None, None, None, None)]
    _, _, uptime, secs, seq, source = struct.unpack_from("!HHIIII", payload)
    at, out = 20, []
    while at + 4 <= len(payload):
        which, size = struct.unpack_from("!HH", payload, at)
        if size < 4 or at + size > len(payload):
            out.append(("corrupt", None, None, None, None))
            break
        body = payload[at + 4 : at + size]
        if which == 0:
            i = 0
            while i + 4 <= len(body):
                template, n = struct.unpack_from("!HH", body, i)
                if template < 256 or i + 4 + 4 * n > len(body):
                    break
                pairs = struct.unpack_from(f"!{2 * n}H", body, i + 4)
                out.append(("template", template, [{"type": t, "len": l} for t, l in zip(pairs[::2], pairs[1::2])], None, None))
                i += 4 + 4 * n
        elif which >= 256:
            out.append(("data", which, None, body, None))
        elif which == 1:
            i = 0
            while i + 6 <= len(body):
                template, scope, options = struct.unpack_from("!HHH", body, i)
                n = (scope + options) // 4
                if template < 256 or i + 6 + 4 * n > len(body):
                    break
                pairs = struct.unpack_from(f"!{2 * n}H", body, i + 6)
                out.append(("options", template, [{"type": t, "len": l} for t, l in zip(pairs[::2], pairs[1::2])], None, scope // 4))
                i += 6 + 4 * n
        else:
            out.append(("reserved", which, None, body, None))
        at += size
    return (source, seq, secs, uptime), out


def _flowsets(batches):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.list_(pa.struct([("type", pa.int32()), ("len", pa.int32())])), pa.binary(), pa.int32()]
    names = [x.split()[0] for x in ("source_id", "seq", "unix_secs", "uptime_ms", "kind", "template_id", "fields", "body", "scope_fields")]
    for batch in batches:
        rows = [(head[0], arrival, head[2], head[3], *part) for arrival, payload in zip(*(c.to_pylist() for c in batch.columns)) for head, parts in [_split(payload)] for part in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [()] * 9, kinds)], names)


def netflow_flowsets(datagrams: DataFrame) -> DataFrame:
    """Rows (source_id, seq, unix_secs, uptime_ms, kind, template_id, fields, body, scope_fields) of datagrams (arrival_seq,
    payload); kind is template, data, options (a template of options), reserved or corrupt, ``seq`` is the arrival."""
    return datagrams.select(F.col("arrival_seq").cast("long"), F.col("payload").cast("binary")).mapInArrow(_flowsets, FLOWSET)


def _number(data: Column, start: Column, size: Column) -> Column:
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def netflow_decode(joined: DataFrame) -> DataFrame:
    """One row per record of data flowsets with their template's ``fields``: ts_us, ends, protocol, bytes, flags and the
    number of fields that are not known. All fields are fixed-width, so a record is a place in the body."""
    ends = F.aggregate("fields", F.array().cast("array<int>"), lambda a, f: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + f["len"])))
    rows = joined.where("fields is not null and size(fields) > 0").withColumn("_ends", ends).withColumn("_size", F.element_at("_ends", -1)).where("_size > 0")
    count = F.floor(F.length("body") / F.col("_size")).cast("int")
    rows = rows.where(count > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))

    def field(kind: int) -> Column:
        at = F.array_position(F.transform("fields", lambda f: f["type"]), kind).cast("int")
        size = F.try_element_at("fields", at)["len"]
        start = F.col("_i") * F.col("_size") + F.try_element_at("_ends", at) - size + 1
        return F.when(at > 0, _number(F.col("body"), start, size))

    safe = lambda kind: F.when(F.array_contains(F.transform("fields", lambda f: f["type"]), kind), field(kind))
    ip = lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    got = {name: safe(kind) for name, kind in FIELD_TYPES.items()}
    proto = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PROTOCOLS.items() for x in p]), got["protocol"].cast("int")), F.concat(F.lit("IP_PROTO_"), F.coalesce(got["protocol"], F.lit(0)).cast("string")))
    late = F.when((got["first_ms"] > 0) & (F.col("uptime_ms") > 0), F.col("uptime_ms") - got["first_ms"]).otherwise(0)
    flags = F.coalesce(got["tcp_flags"], F.lit(0))
    unknown = F.size(F.filter("fields", lambda f: ~f["type"].isin(*FIELD_TYPES.values())))
    return rows.select(
        "source_id", "seq", "template_id", (F.col("unix_secs") * 1_000_000 - late * 1000).alias("ts_us"), F.when(got["src_v4"].isNotNull(), ip(got["src_v4"])).alias("src_ip"), F.coalesce(got["src_port"], F.lit(0)).alias("src_port"),
        F.when(got["dst_v4"].isNotNull(), ip(got["dst_v4"])).alias("dst_ip"), F.coalesce(got["dst_port"], F.lit(0)).alias("dst_port"), proto.alias("protocol"), F.coalesce(got["in_bytes"], F.lit(0)).alias("length"), F.coalesce(got["in_packets"], F.lit(0)).alias("packets"),
        *[(flags.bitwiseAND(F.lit(b)) != 0).alias(f) for f, b in FLAG_BITS.items()], unknown.alias("unknown_fields"),
    )

"""TLS fingerprints of hello messages: numbers are walked out of the bytes, the texts and digests are column functions."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PARTS = "hello int, version int, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, sni string"
_TYPE = pa.struct([("hello", pa.int32()), ("version", pa.int32()), ("ciphers", pa.list_(pa.int32())), ("extensions", pa.list_(pa.int32())), ("curves", pa.list_(pa.int32())), ("formats", pa.list_(pa.int32())), ("sni", pa.string())])


def parse_hello(data: bytes | None) -> dict | None:
    """The numbers of a client (1) or server (2) hello record; None for what is none, or breaks its bounds."""
    try:
        if not data or data[0] != 22 or data[5] not in (1, 2):
            return None
        hello, version, at = data[5], struct.unpack_from("!H", data, 9)[0], 43
        at += 1 + data[at]
        if hello == 1:
            n = struct.unpack_from("!H", data, at)[0]
            ciphers = [*struct.unpack_from(f"!{n // 2}H", data, at + 2)]
            at += 2 + n
            at += 1 + data[at]
        else:
            ciphers = [struct.unpack_from("!H", data, at)[0]]
            at += 3
        out = {"hello": hello, "version": version, "ciphers": ciphers, "extensions": [], "curves": [], "formats": [], "sni": None}
        if at + 2 > len(data):
            return out
        end = at + 2 + struct.unpack_from("!H", data, at)[0]
        at += 2
        while at + 4 <= min(end, len(data)):
            kind, n = struct.unpack_from("!HH", data, at)
            body = data[at + 4 : at + 4 + n]
            out["extensions"].append(kind)
            if kind == 0 and hello == 1 and len(body) > 5:
                out["sni"] = body[5 : 5 + struct.unpack_from("!H", body, 3)[0]].decode("ascii", "replace")
            elif kind == 10 and len(body) >= 2:
                out["curves"] = [*struct.unpack_from(f"!{struct.unpack_from('!H', body)[0] // 2}H", body, 2)]
            elif kind == 11 and body:
                out["formats"] = [*body[1 : 1 + body[0]]]
            at += 4 + n
        return out
    except (struct.error, IndexError):
        return None


def _parts(batches):
    for batch in batches:
        at = batch.schema.get_field_index("_payload")
        parsed = pa.array([parse_hello(p) for p in batch.column(at).to_pylist()], _TYPE)
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), parsed], [*(n for i, n in enumerate(batch.schema.names) if i != at), "tls"])


def hello_parts(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``tls``, the numbers of its payload's hello."""
    shape = df.withColumn("tls", F.lit(None).cast(f"struct<{PARTS.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")).schema
    return df.withColumn("_payload", F.col(payload)).mapInArrow(_parts, shape)


def without_grease(values: Column) -> Column:
    """The values that are not reserved ones, whose bytes are equal and end in A."""
    return F.filter(values, lambda v: ~((v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(v, 8) == v.bitwiseAND(F.lit(255)))))


def _text(values: Column) -> Column:
    return F.array_join(F.transform(without_grease(values), lambda v: v.cast("string")), "-")


def ja3_fingerprint(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ja3_string, ja3 and sni of client hellos; null for other payloads."""
    t = F.col("tls")
    text = F.concat_ws(",", t["version"].cast("string"), _text(t["ciphers"]), _text(t["extensions"]), _text(t["curves"]), _text(t["formats"]))
    rows = hello_parts(df, payload).withColumn("ja3_string", F.when(t["hello"] == 1, text))
    return rows.withColumn("ja3", F.md5("ja3_string")).withColumn("sni", t["sni"]).drop("tls")


def ja3s_fingerprint(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ja3s_string and ja3s of server hellos; null for other payloads."""
    t = F.col("tls")
    text = F.concat_ws(",", t["version"].cast("string"), _text(t["ciphers"]), _text(t["extensions"]))
    rows = hello_parts(df, payload).withColumn("ja3s_string", F.when(t["hello"] == 2, text))
    return rows.withColumn("ja3s", F.md5("ja3s_string")).drop("tls")

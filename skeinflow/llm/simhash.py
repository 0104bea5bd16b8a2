"""SimHash near-duplicate detection with multi-index hashing.

Fingerprints: words are runs of bytes other than space and \\t..\\r of the text with A-Z lower-cased, shingles are four
consecutive words joined by one space (fewer words: the whole sequence, none: fingerprint 0), hashed by XXH64 with seed 42.
A bit is set where over half of a document's shingles, repeats included, have it set.

Links: two fingerprints link when they differ in ``MAX_BITS`` = 4 bits or fewer. The 64 bits are two segments of 32; by the
pigeonhole principle a linked pair differs in at most two bits of one of them. Every fingerprint enumerates the radius-1 ball
of either segment (2 * 33 keys), and the balls of any two segments up to two bits apart meet. Keys that meet are verified on
all 64 bits. Fingerprints are distinct before any join, so exact copies never pair up, and the candidates of one
key are random collisions or close fingerprints only.

Defined results: a null text is an empty one (fingerprint 0); rows with a null ``doc_id`` take part in linking and
may connect others, but the smallest id of a group is the smallest non-null one (null if there is none); ids are below 2^63 - 2^41; repeated rows give repeated result rows; other
columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .caches import lean
from .passing import hidden_pass
from .store import settle

MAX_BITS = 4
SHINGLE_WORDS = 4
_CHUNK = 1 << 18


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    digest, last = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE_WORDS + 1)
    for at in range(0, last, _CHUNK):
        part = words[at : min(last, at + _CHUNK) + SHINGLE_WORDS - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[min(len(part), SHINGLE_WORDS) - 1 :].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


@lean
def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long with the same 64 bits."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _forest(ids: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints: at most one edge for each of them."""
    edges, left = [], np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]) <= MAX_BITS
            for y in left[near]:
                edges.append((int(ids[x]), int(ids[y])))
                queue.append(y)
            left = left[~near]
    return edges


@lean
def _link_batches(batches):
    """Rows (key, fp, id) in order of key -> edges (a, b) between ids of fingerprints that share a key and link.

    Memory is one batch and the rows of the key at its end: 24 bytes a row.
    """
    held = [np.empty(0, np.int64)] * 3

    def linked(key, prints, ids):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        two = first[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= MAX_BITS]
        edges = list(zip(ids[two].tolist(), ids[two + 1].tolist()))
        for at, n in zip(first[size > 2], size[size > 2]):
            edges += _forest(ids[at : at + n], prints[at : at + n])
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
        held = [x[cut:] for x in rows]
        if cut:
            yield linked(rows[0][:cut], rows[1][:cut].view(np.uint64), rows[2][:cut])
    if len(held[0]):
        yield linked(held[0], held[1].view(np.uint64), held[2])


def link_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links connect, for a table (fp, id) of distinct fingerprints."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.concat(F.transform(flips, lambda m: high.bitwiseXOR(m)), F.transform(flips, lambda m: low.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    rows = prints.select(F.explode(keys).alias("key"), "fp", "id")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = settle(fingerprints(docs), "fingerprints")
    # a fingerprint whose rows have no id at all gets one above all others, which no result shows
    unnamed = F.lit((1 << 63) - 1).cast("long") - F.pmod(F.xxhash64("fp"), F.lit(1 << 40))
    distinct = settle(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), unnamed).alias("id")), "distinct")
    groups = connected_components(link_edges(distinct))
    own = F.coalesce("component", "id")
    named = distinct.join(groups, distinct.id == groups.node, "left").select("fp", F.when(own < F.lit((1 << 63) - (1 << 41)), own).alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@hidden_pass
def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: the row that has the group's smallest doc_id.

    Of rows that repeat that id the one with the smallest text hash stays. Rows without an id stay as they are: nothing
    names them.
    """
    chosen = simhash_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_sh_id")).distinct()
    kept = docs.where("doc_id is not null").join(chosen, F.col("doc_id").cast("long") == F.col("_sh_id"), "left_semi")
    first = Window.partitionBy(F.col("doc_id").cast("long")).orderBy(F.xxhash64("text"))
    kept = kept.withColumn("_sh_row", F.row_number().over(first)).where("_sh_row = 1").drop("_sh_row")
    return kept.unionByName(docs.where("doc_id is null"))

"""Periodic runs of words: detection and collapse.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least max(6, 4q) words that
no neighbouring word extends. Documents are independent, so nothing is shuffled; a task lays the words of many documents
out as one array of numbers, with a number of its own after each document, and works on that array:

* Periods up to ``SHORT`` are too short for windows: a direct scan compares the array with itself at each lag.
* Scale w = 2 ``SHORT``, 4 ``SHORT``, ... finds the periods from w/2 + 1 to w. Hashes of w words are doubled from those of
  w/2, and the minima of all windows of w/2 such hashes are the scale's minimizers. A run has the same minimizers one period
  on: with at least 4q words, the window at its start and the one q later both lie inside it; and as w >= q, equal
  hashes stand exactly q apart. So two neighbouring equal minimizers with a distance in the scale's range are a seed, which
  is extended word by word to both sides. Shorter documents leave before the scales whose periods they cannot hold.

A seed's words are equal over w words at a distance of at most w, so it always lies in a repetition of two periods at
least; those have a total length in O(n log n), which bounds the extensions. Words are compared by their dictionary
numbers; 64-bit hashes only propose seeds (two of n hashes agree by chance with probability under n^2 / 2^64).

Defined results: a null text has no words; null doc_id and repeated rows pass through; other columns are ignored. Texts
are handled as bytes, whole; memory follows the longest text of a batch or ``GROUP_WORDS`` words, whichever is more.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Periods up to this are scanned for directly; a power of two.
SHORT = 8
LEAST_WORDS, LEAST_PERIODS = 6, 4
GROUP_WORDS = 1 << 20

RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary"

#: Odd multipliers of the hash.
ONE, TWO, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def least_words(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= THREE
    x ^= x >> np.uint64(29)
    return x


def _doubled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k."""
    out = hashes * ONE
    out[:-k] += hashes[k:] * TWO
    return _mixed(out)


def _is_primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of four periods has no smaller period: that would divide this one."""
    rest, f = period, 2
    word = ids[start : start + period]
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            step = period // f
            if np.array_equal(word[step:], word[: period - step]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _reach(ids: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest [a, b) around i where ids[x] == ids[x + lag]."""
    b, step = i, 64
    while b + lag < len(ids):
        end = min(b + step, len(ids) - lag)
        differ = ids[b:end] != ids[b + lag : end + lag]
        if differ.any():
            b += int(differ.argmax())
            break
        b, step = end, step * 2
    a, step = i, 64
    while a > 0:
        begin = max(0, a - step)
        differ = (ids[begin:a] != ids[begin + lag : a + lag])[::-1]
        if differ.any():
            a -= int(differ.argmax())
            break
        a, step = begin, step * 2
    return a, b


def _scan(ids: np.ndarray, period: int):
    """Runs of a short period, by comparing every word with the one a period later."""
    if len(ids) <= period:
        return
    equal = np.zeros(len(ids) - period + 2, np.int8)
    equal[1:-1] = ids[:-period] == ids[period:]
    edges = np.flatnonzero(np.diff(equal))
    starts, ends = edges[::2], edges[1::2]
    for k in np.flatnonzero(ends - starts >= least_words(period) - period):
        if _is_primitive(ids, start := int(starts[k]), period):
            yield start, int(ends[k]) - start + period, period


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that are a minimum of some window of so many hashes; all of them, where equal ones share the minimum."""
    least, s = hashes.copy(), 1
    while s < window:
        np.minimum(least[:-s], least[s:], out=least[:-s])
        s *= 2
    s = 1
    while s < window:
        np.maximum(least[s:], least[:-s], out=least[s:])
        s *= 2
    return np.flatnonzero(least == hashes)


def _seeds(hashes: np.ndarray, scale: int):
    """(period, position) of neighbouring equal minimizers at a distance in (scale/2, scale], in that order."""
    places = _minimizers(hashes, scale // 2)
    places = places[np.argsort(hashes[places], kind="stable")]
    apart = np.diff(places)
    fits = (hashes[places[1:]] == hashes[places[:-1]]) & (apart > scale // 2) & (apart <= scale)
    periods, at = apart[fits], places[:-1][fits]
    order = np.lexsort((at, periods))
    return zip(periods[order].tolist(), at[order].tolist())


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the texts of ``ids``, by start and period. Text k has lengths[k] numbers and
    one number of its own after them."""
    found = [run for p in range(1, SHORT + 1) for run in _scan(ids, p)]
    origin = np.arange(len(ids))
    hashes, k, scale = _mixed(ids.astype(np.uint64) * ONE), 1, 2 * SHORT
    while True:
        fits = lengths >= least_words(scale // 2 + 1)
        if not fits.any():
            return sorted(found, key=lambda r: (r[0], r[2]))
        if not fits.all():
            kept = np.repeat(fits, lengths + 1)
            ids, origin, hashes, lengths = ids[kept], origin[kept], hashes[kept], lengths[fits]
        while k < scale:
            hashes, k = _doubled(hashes, k), 2 * k
        reached = (0, 0)
        for period, i in _seeds(hashes, scale):
            if reached[0] == period and i < reached[1]:
                continue  # in the stretch that an earlier seed has found
            a, b = _reach(ids, i, period)
            reached = period, b
            if b - a + period >= least_words(period) and _is_primitive(ids, a, period):
                found.append((int(origin[a]), b - a + period, period))
        scale *= 2


def runs_of_texts(texts: list[bytes]):
    """(number of words, runs, words kept joined by one space) of each text."""
    number = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # of bytes: splits at the six white spaces of ASCII alone
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    ids = np.empty(starts[-1], np.int64)
    for k, own in enumerate(words):
        ids[starts[k] : starts[k + 1] - 1] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        ids[starts[k + 1] - 1] = -1 - k
    runs = find_runs(ids, lengths)
    of = np.searchsorted(starts, [r[0] for r in runs], "right") - 1 if runs else []
    grouped = defaultdict(list)
    for k, (start, length, period) in zip(of, runs):
        grouped[int(k)].append((start - int(starts[k]), length, period))
    for k, own in enumerate(words):
        kept = own
        if k in grouped:
            drop = np.zeros(len(own), bool)
            for start, length, period in grouped[k]:
                drop[start + period : start + length] = True
            kept = [own[i] for i in np.flatnonzero(~drop)]
        yield len(own), grouped.get(k, ()), b" ".join(kept)


def _groups(texts: list[bytes]):
    """Neighbouring texts of about ``GROUP_WORDS`` words together, taking six bytes for a word."""
    group, size = [], 0
    for text in texts:
        group.append(text or b"")
        size += len(group[-1])
        if size >= 6 * GROUP_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _batches(batches):
    struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    for batch in batches:
        at = 0
        for group in _groups(batch.column(1).to_pylist()):
            sizes, runs, texts = zip(*runs_of_texts(group))
            flat = [r for own in runs for r in own]
            offsets = np.concatenate([[0], np.cumsum([len(own) for own in runs])])
            columns = [pa.array(c, pa.int64()) for c in (zip(*flat) if flat else [()] * 3)]
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=[*struct]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])
            at += len(group)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text): the runs (start, length, period) by start
    and period, and the text without the words that a run contains after its first period, joined by one space."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_batches, FOUND)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the decimal doc_id, ends in words that repeat with a period. A
    text is only put together anew where words are planted; rows without an id stay as they are."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), words_of(F.col("text"))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " "))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row of plain columns for each row of ``periodic_runs``: the number of runs, the longest one (the first of equal
    ones), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length = -F.col("_best.l")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), length.alias("length"), F.col("_best.p").alias("period"), F.floor(length * 1000 / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Spectral profile of the contacts of a host pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SCHEMA = "src_ip string, dst_ip string, contacts long, dominant_hz double, dominant_s double, spectral_power double"
MOST_BINS = 1024
SHORT_CONTACTS, SHORT_US = 6, 10_000_000
LEAST_GAP_US = 50_000
#: Strengths within this share of the strongest are as strong as it, and those below this share of the contacts are none: what
#: is left of exact zeros and ties by rounding decides nothing. The lowest frequency of the strongest counts.
NEAR = 1e-9
#: Cells of pairs times bins that are transformed together.
CELLS = 1 << 22


def _spectrum(times: np.ndarray, sizes: np.ndarray, spans: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the strongest frequency, its share of all strengths) of rows of sorted times, filled up at the end, by one
    transform of their histograms of so many bins."""
    place = np.minimum((times - times[:, :1]) * bins // spans[:, None], bins - 1)
    there = np.arange(times.shape[1])[None, :] < sizes[:, None]
    rows = np.broadcast_to(np.arange(len(times))[:, None], times.shape)
    counts = np.zeros((len(times), bins))
    np.add.at(counts, (rows[there], place[there]), 1)
    strength = np.abs(np.fft.rfft(counts, axis=1))
    strength[:, 0] = 0
    strength[strength < NEAR * sizes[:, None]] = 0
    peak = (strength >= strength.max(1, keepdims=True) * (1 - NEAR)).argmax(1)
    total = strength.sum(1)
    share = np.where(total > 0, strength[np.arange(len(times)), peak] / np.where(total > 0, total, 1), 0.0)
    return np.where(total > 0, peak, 0), share


def profiles(times: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, period, share of the strongest) of rows of sorted times in microseconds, ``sizes`` of them in each."""
    n, width = times.shape
    spans = times[np.arange(n), sizes - 1] - times[:, 0]
    gaps = np.diff(times, axis=1)
    counts = (np.arange(width - 1)[None, :] < sizes[:, None] - 1) & (gaps > LEAST_GAP_US)
    number = np.maximum(counts.sum(1), 1)
    mean = np.where(counts, gaps, 0).sum(1) / number / 1e6
    deviation = np.sqrt((np.where(counts, gaps / 1e6 - mean[:, None], 0) ** 2).sum(1) / number)
    some = mean > 0
    hz = np.where(some, 1 / np.where(some, mean, 1), 0.0)
    period, power = mean.copy(), np.where(some & (deviation < 0.1 * mean), 0.9, 0.5)
    long = np.flatnonzero((sizes >= SHORT_CONTACTS) & (spans > SHORT_US))
    bins = np.minimum(spans // 1_000_000 + 1, MOST_BINS)
    for b in np.unique(bins[long]):
        same = long[bins[long] == b]
        for at in range(0, len(same), step := max(1, CELLS // int(b))):
            own = same[at : at + step]
            peak, power[own] = _spectrum(times[own], sizes[own], spans[own], int(b))
            hz[own] = peak / (spans[own] / 1e6)
            period[own] = np.where(peak > 0, spans[own] / 1e6 / np.maximum(peak, 1), 0.0)
    return hz, period, power


def _profile_batches(batches):
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        if not len(sizes):
            continue
        flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
        at = starts[:, None] + np.minimum(np.arange(sizes.max())[None, :], sizes[:, None] - 1)
        found = profiles(flat[at], sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), *map(pa.array, found)], [x.split()[0] for x in SCHEMA.split(", ")])


def spectral_profile(flows: DataFrame, max_samples: int = 64, least: int = 4) -> DataFrame:
    """By host pair with ``least`` contacts: number among the newest ``max_samples``, and the strongest frequency, its period
    and its share of a histogram of their times in at most ``MOST_BINS`` bins; short series by their mean gap. The pairs of an
    Arrow batch that have as many bins share one Fourier transform."""
    newest = Window.partitionBy("src_ip", "dst_ip").orderBy(F.desc("ts_us"), F.desc("event_id"))
    kept = flows.select("src_ip", "dst_ip", "ts_us", F.row_number().over(newest).alias("r")).where(F.col("r") <= max_samples)
    listed = kept.groupBy("src_ip", "dst_ip").agg(F.array_sort(F.collect_list("ts_us")).alias("times")).where(F.size("times") >= least)
    return listed.select("src_ip", "dst_ip", "times").mapInArrow(_profile_batches, SCHEMA)

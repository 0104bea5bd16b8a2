"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text. One goes on with what toxic training texts have and
ordinary ones lack, the other with as much more ordinary text. A window of ``WINDOW`` words gains as many bytes as it
compresses shorter with the toxic dictionary than with the ordinary one; a document's distance is the mean of its two
largest gains, over all windows of its whole text. A logistic curve fitted on labelled texts that made no dictionary turns
the distance into a score whose 0.5 is the calibrated threshold.

What toxic texts have and ordinary ones lack: the ``GRAM``-byte strings of words that stand in more different contexts (the
word before) in toxic texts than chance allows: Chernoff's bound under e^-``SURPRISE``, and ``LIFT`` times as often. Neighbouring ones join to fragments,
which are the toxic training text.

Fitting reads labelled rows whose crc32(doc_id as text) mod 5 is not 0: of each class those with the smallest hash of the id,
``TOXIC_ROWS`` and ``ORDINARY_ROWS`` at most, each with its whole text. Labels, languages, sources and ids are
no inputs of a score. Scoring is independent by row, without a shuffle.

Defined results: null and empty texts have no windows and the distance 0; without labelled texts of both classes every score
is 0.25; an id that labels call both is toxic; of texts that repeat an id the least in order trains; a null doc_id counts as held out of training; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 16
GRAM = 6
SURPRISE = 12.0
LIFT = 8.0
LEVEL = 9
BASE_BYTES = 32768
MOST_BYTES = 8192
TOXIC_ROWS = 1500
ORDINARY_ROWS = 6000
#: Bounds of the model, all of them parameters: fragments that the toxic dictionary takes, commonest first; ordinary words that
#: each half of the ordinary text is drawn from; and from how many samples, and times the dictionary's size, zstandard's
#: training chooses among them - with fewer it has nothing to choose from, and all of them are the dictionary.
FRAGMENTS = 600
ORDINARY_WORDS = 60_000
LEAST_SAMPLES, LEAST_TIMES = 200, 20


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    slope: float
    intercept: float


def _words(text: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().split()]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def distance(text: bytes | None, toxic, ordinary) -> float:
    words = (text or b"").lower().split()
    gains = [0, 0]
    for at in range(0, len(words), WINDOW):
        window = b" " + b" ".join(words[at : at + WINDOW]) + b" "
        gain = len(ordinary.compress(window)) - len(toxic.compress(window))
        if gain > gains[0]:
            gains = sorted((gain, gains[1]))
    return sum(gains) / 2


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's training picks from the samples; the samples themselves where they are few."""
    total = sum(map(len, samples))
    if len(samples) > LEAST_SAMPLES and total > LEAST_TIMES * size:
        header = 300  # tables come first, content last
        return zstandard.train_dictionary(size + header, samples, k=32, d=6).as_bytes()[header:]
    return b"".join(samples)[-size:]


def _fragments(word: bytes, grams: set[bytes]) -> list[bytes]:
    spans: list[list[int]] = []
    for i in range(len(word) - GRAM + 1):
        if word[i : i + GRAM] in grams:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + GRAM
            else:
                spans.append([i, i + GRAM])
    return [word[a:b] for a, b in spans]


def _contexts(texts: list[bytes]) -> tuple[Counter, int]:
    """How many different (word before, word) hold each gram, and the number of those pairs: copies count once."""
    before: dict[bytes, set[int]] = {}
    for t in texts:
        last = 0
        for w in _words(t):
            before.setdefault(w, set()).add(last)
            last = zlib.crc32(w)
    counts: Counter = Counter()
    for w, found in before.items():
        for gram in {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}:
            counts[gram] += len(found)
    return counts, sum(map(len, before.values()))


def telling_fragments(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Fragments of the toxic texts' words, with the numbers of their occurrences."""
    (bad, n), (good, m) = _contexts(toxic), _contexts(ordinary)
    if not n or not m:
        return Counter()
    share, grams = n / (n + m), set()
    for gram, a in bad.items():
        if a < 3:
            continue
        b = good[gram]
        own = a / (a + b)
        # Chernoff's bound on so large a part of its places by chance
        surprise = a * math.log(own / share) + (b * math.log((1 - own) / (1 - share)) if b else 0.0)
        if a / n > LIFT * (b + 0.5) / m and surprise > SURPRISE:
            grams.add(gram)
    return Counter(f for t in toxic for w in _words(t) for f in _fragments(w, grams))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def fit(texts: list[bytes], toxic: list[int]) -> Model:
    """A model of labelled texts; every third one is kept for the threshold."""
    by = [[t for t, y in zip(texts, toxic) if y == k] for k in (0, 1)]
    ordinary, bad = ([t for i, t in enumerate(x) if i % 3] for x in by)
    kept = [[t for i, t in enumerate(x) if i % 3 == 0] for x in by]
    fragments = telling_fragments(bad, ordinary)
    if not fragments or not all(kept):
        return Model(b"", b"", 0.0, float(np.log(1 / 3)))
    words = [w for t in ordinary for w in _words(t)]
    order = np.random.default_rng(1).permutation(len(words))
    half = min(len(words) // 2, ORDINARY_WORDS)
    base = _trained([words[i] for i in order[:half]], BASE_BYTES)
    # the commonest stand last, where a match costs least
    own = b"".join(f for f, _ in fragments.most_common(FRAGMENTS)[::-1])[-MOST_BYTES:]
    more = _trained([words[i] for i in order[half : 2 * half]], len(own))
    pair = _compressor(base + own), _compressor(base + more)
    x = np.array([distance(t, *pair) for k in (0, 1) for t in kept[k]])
    y = np.array([k for k in (0, 1) for _ in kept[k]], float)
    return Model(base + own, base + more, *_logistic(x, y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled documents, as the module describes."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((0, ORDINARY_ROWS), (1, TOXIC_ROWS))]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # ORDINARY_ROWS + TOXIC_ROWS rows at most
    texts = docs.join(chosen, F.col("doc_id").cast("long") == F.col("_id")).select("_id", "toxic", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.groupBy("_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("_id")
    return fit([t.encode() for t in rows["text"]], rows["toxic"].tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spread = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        model = spread.value
        pair = (_compressor(model.toxic), _compressor(model.ordinary)) if model.toxic else None
        for batch in batches:
            gains = np.array([distance(t, *pair) if pair else 0.0 for t in batch.column(2).cast(pa.binary()).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(model.slope * gains + model.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

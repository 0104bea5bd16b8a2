import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from skeinflow.llm import periods as P, queries

from .conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(words):
    """Runs by the definition: every period, every stretch."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(a, a + length - d)) for d in range(1, q)):
                out.append((a, length, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digests(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapse(words, runs))


def check(spark, docs):
    frame = P.run_digests(P.periodic_runs(P.with_planted_runs(docs)))
    assert sorted(map(tuple, frame.collect()), key=str) == sorted((digests(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)


def test_equals_brute_force(spark, documents):
    short = documents.where("length(text) < 6000")
    check(spark, short)
    assert sum(r["n_runs"] for r in queries.op12_periods(spark, SF).collect()) > 10


def test_odd_documents(spark, odd, empty):
    check(spark, odd.where("doc_id is null or doc_id <> 5"))
    check(spark, empty)
    found = {r["doc_id"]: r for r in P.periodic_runs(odd).collect()}
    assert [tuple(r) for r in found[5]["runs"]] == [(0, 30_000, 1)] and found[5]["collapsed"] == "long"
    assert found[3]["n_words"] == 0 and found[3]["runs"] == [] and found[3]["collapsed"] == ""


def test_words_split_at_ascii_white_space_only(spark):
    text = "a\x1cb\xa0c d\x85e f\x0bg\th\x00i"
    [row] = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["n_words"] == len(WORD.findall(text)) == 4 and row["collapsed"] == " ".join(WORD.findall(text))
    assert spark.createDataFrame([(text,)], "t string").select(P.words_of(F.col("t"))).first()[0] == WORD.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=90), min_size=1, max_size=5), st.randoms())
def test_any_words(texts, rng):
    texts = [w * rng.choice([1, 1, 4, 5]) for w in texts]
    for words, (n, runs, kept) in zip(texts, P.runs_of_texts([" ".join(w).encode() for w in texts])):
        assert (n, list(runs), kept.decode()) == (len(words), brute(words), collapse(words, brute(words)))


@pytest.mark.parametrize("period", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 250, 256, 257])
def test_every_scale(period):
    """Runs of four periods exactly, inside text without any, with a periodic word inside each period too."""
    rng = random.Random(period)
    for trial in range(6):
        word = [str(rng.randrange(3 if trial % 2 else 10**6)) for _ in range(period)]
        if trial > 3 and period > 12:
            word[3:11] = ["x", "y"] * 4
        before, after = ([str(rng.random()) for _ in range(rng.randint(0, 300))] for _ in range(2))
        words = before + word * max(4, -(-6 // period)) + after
        [(_, runs, _)] = P.runs_of_texts([" ".join(words).encode()])
        assert list(runs) == brute(words)


def test_time_follows_length():
    """A million words of one long run, of a word alone, and of none."""
    rng = np.random.default_rng(1)
    tail = [str(x) for x in rng.integers(0, 10**6, 200_000)]
    texts = [" ".join(t).encode() for t in (tail * 5, ["w"] * 1_000_000, tail)]
    found = [runs for _, runs, _ in P.runs_of_texts(texts)]
    assert list(found[0]) == [(0, 1_000_000, 200_000)] and list(found[1]) == [(0, 1_000_000, 1)] and not found[2]

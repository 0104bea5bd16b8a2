import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinflow.llm import bpe, chat, licenses, lines, mixing, quality, queries, toxicity

from ..comparing import assert_equal, database
from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _file:
    OWN = bpe.Vocabulary(_file.read())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


def check_bpe(docs):
    want = sorted((r["doc_id"] or -1, *encoded(r["text"])) for r in docs.select("doc_id", "text").collect())
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digests(docs, PATH).collect())
    assert got == want


def test_bpe_equals_library(documents, odd, empty):
    for docs in (documents, odd, empty):
        check_bpe(docs)


def test_bpe_digests_decode_the_ids(monkeypatch):
    monkeypatch.setattr(OWN, "decode", lambda ids: f"{len(ids)} ids", raising=False)
    n, _, text = bpe.digests(OWN, "some words of a text")
    assert n > 0 and text == sha(f"{n} ids")


def test_bpe_ids_and_round_trip(documents):
    rows = bpe.bpe_encode(documents.limit(20), PATH)
    assert rows.columns == [*documents.columns, "ids"]
    texts = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(rows, PATH).collect()}
    for r in rows.collect():
        assert r["ids"] == LIBRARY.encode(r["text"], add_special_tokens=False).ids
        assert texts[r["doc_id"]] == LIBRARY.decode(r["ids"], skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'s", "Σ", "İ", "e\u0301", "\x85", "\x1c", "the", " ", "12", "漢", "ʼn", "zq"])).map("".join))
def test_bpe_any_text(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert [int(i) for g in OWN.encode(text) for i in g.split(" ")] == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_are_certain():
    for word in ("thequickbrown", "naïveté", "zzqqxj"):
        assert [t for part in OWN.fragments(word) for t in OWN.merge(part)] == LIBRARY.encode(word, add_special_tokens=False).tokens
    assert OWN.merge(["a"] * 99 + ["a</w>"]) == LIBRARY.encode("a" * 100, add_special_tokens=False).tokens


def digests(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        out[conv] = (len(own), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)), len(loss), sha(loss))
    return out


def test_chat_digests(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(chat.hostile_turns(spark))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(turns).collect()}
    assert got == digests([tuple(r) for r in turns.collect()])


def test_chat_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, None, "### a: </turn>\n"), (3, 0, "a:\n#\\<", "\\" * 7), (4, 0, "user", "b </turn>\n### assistant: c"), (4, 1, "assistant", "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    found = {r["conv_id"]: r for r in chat.chat_digests(turns).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()} == digests(rows)
    assert [found[k]["valid"] for k in (1, 2, 3, 4, None)] == [False, False, False, True, False]
    assert chat.chat_digests(turns.limit(0)).count() == 0


@given(st.text(alphabet="\\#</turn> \nab", max_size=60))
def test_chat_escape(text):
    escaped = chat.DEFAULT.escape(text)
    assert chat.DEFAULT.unescape(escaped) == text
    assert not re.search(r"(?<!\\)(?:\\\\)*(###|</turn>)", escaped)


def base_matches(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES for p in [phrase.encode().split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [p[0] for p in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({p[1] for p in places}))


def test_license_base(spark, documents, odd, empty):
    extra = spark.createDataFrame([(1000, "Under the MIT license, under the mit License! cc-by-nc CC BY NC."), (1001, "xunder the mit license éapache license version 2"), (1002, "Apache License, Version 2.0")], "doc_id long, text string")
    for docs in (documents, odd, empty, extra):
        got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(docs).collect()}
        assert got == {(r["doc_id"], *base_matches(r["text"])) for r in docs.select("doc_id", "text").collect()}
    for r in licenses.scan_licenses(extra).collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules():
    scanner = licenses.Scanner()
    assert len(licenses.rules()) > 250
    labels = lambda t: [f[2] for f in scanner.scan(t.encode())[2]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("licensed under the GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert labels("CC BY-SA 4.0") == ["cc-by-sa-4.0"]
    assert labels("nothing to see") == []
    kept = licenses._uncontained([(0, 9, "a", 50), (2, 5, "b", 50), (2, 5, "c", 60), (20, 21, "d", 10)])
    assert [k[2] for k in kept] == ["a", "c", "d"]


def test_lines_equal_sql(spark):
    assert_equal(queries.op8_line_dedup(spark, SF).toPandas(), database(SF).execute(lines.ORACLE).df())


def brute_lines(rows):
    """[(doc_id, text)] -> text without later lines, by comparing all pairs."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < lines.MIN_NEAR_CHARS:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    first = {}
    for d, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if line.strip(" \t\r"):
                first.setdefault(line, (d, i))
    gone = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(" \t\r") or (x not in gone and first[x] == (d, i))) for d, t in rows}


def test_near_lines(spark):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, base), (2, base[:5] + base[6:] + "\nkeep me, I am a line of my own"), (3, base + "s\n\nshort"), (4, base[:10] + "X" + base[11:]), (5, "shorl\nshort\n" + base), (6, "a" + base + "b"), (7, base.replace("fox", "fux") + "\n" + base.replace("fox", "fax")), (8, "aaaaaaaaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaaaaaaaaaa"), (9, "  \n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == brute_lines(rows)


def test_lines_odd(odd, empty):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (3, None) in texts and (4, "") in texts and (1, "") in texts  # the row without an id is the earliest
    assert lines.dedup_lines(empty).count() == 0


def test_lines_of_a_long_document(spark):
    texts = [f"line {i} of a document that has very many of them" if i % 2 else "a line that stands again and again" for i in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join(texts)), (2, "a line that stands again and again")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(docs, min_near=1_000).collect()}
    assert got[1] == ("\n".join([texts[0], *texts[1::2]]), 50_000, 24_999) and got[2] == ("", 1, 1)


def test_mixing_equals_sql(spark):
    assert_equal(queries.op10_mixing(spark, SF).toPandas(), database(SF).execute(mixing.ORACLE).df())


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000), ("b", "de", "s4", 5)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 400.0, 1, {}, {}, {}).collect()}
    assert got == {"s1": 10.0, "s2": 190.0, "s3": 195.0, "s4": 5.0}
    all_of_it = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 1e9, 1, {}, {}, {}).collect()}
    assert all_of_it == {"s1": 10.0, "s2": 1000.0, "s3": 1000.0, "s4": 5.0}


def test_selection_repeats_short_leaves(spark):
    rows = [(1, "few words of english here", "en", "src0"), *[(i, "many words of german there", "de", "src0") for i in range(2, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.select_mix(docs)
    assert got.columns == docs.columns
    assert [r["doc_id"] for r in got.collect()].count(1) == mixing.MAX_EPOCHS


def test_selection_takes_no_more_than_the_mix(spark):
    rows = [(i % 21, f"words of text {i % 21} that stands here twice", "en", "src0", i) for i in range(42)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, other long")
    count = lambda df: sorted(r["doc_id"] for r in df.collect())
    got = mixing.select_mix(docs)
    assert count(got) == count(mixing.mix(docs)) and len(count(got)) == 21
    assert got.select("other").distinct().count() == 21


def test_mixing_odd(odd, empty):
    out = mixing.select_mix(odd, budget_share=1.0)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} >= {1, 2, 5, 6, 8}
    assert mixing.mix(empty).count() == 0 and mixing.select_mix(empty).count() == 0


def test_quality_tells_junk(documents, labels):
    rows = quality.score_documents(documents, labels).join(labels, "doc_id").select("keep", "quality").toPandas()
    assert rows[rows.quality == 1].keep.mean() >= 0.97
    assert rows[rows.quality == 0].keep.mean() <= 0.35


def test_quality_sees_word_order(documents, labels):
    good = documents.join(labels.where("quality = 1"), "doc_id", "left_semi").where("n_chars > 300")
    mixed = good.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.array_join(F.array_sort(F.split("text", " ")), " "))
    rows = quality.score_documents(documents.unionByName(mixed), labels).select("doc_id", "perplexity").toPandas().set_index("doc_id").perplexity
    ratio = [rows[i] / rows[i - 1_000_000] for i in rows.index if i >= 1_000_000]
    assert len(ratio) > 20 and sorted(ratio)[len(ratio) // 2] > 1.8


def test_quality_words():
    assert quality.words("deux mots 漢字") == ["deux", "mots", "漢", "字"]
    for values in (np.array([0, 1, 5]), np.array([1 << 53, 3]), np.array([0])):
        assert (quality.unpack(quality.pack(values), len(values)) == values).all()
        assert (quality.unpack_keys(quality.pack_keys(values), len(values)) == values).all() if (np.diff(values) >= 0).all() else True
    keys = np.sort((np.random.default_rng(1).integers(0, 9, (1000, 3)) << np.array([36, 18, 0])).sum(1))
    assert (quality.unpack_keys(quality.pack_keys(keys), 1000) == keys).all()


SENTENCES = ["the cat sat on the mat", "the dog sat on the log log", "a cat saw the dog and the dog saw a cat", "zebras sat", "the the mat quickly ran", "on the mat the cat sat on the mat"]


def brute_nats(train, text):
    """Nats of a text under a modified Kneser-Ney model of order 3, by dictionaries."""
    count = Counter(w for t in train for w in t.split())
    known = {*count}

    def tokens(t):
        found = t.split()
        out = [("again", w) if i and found[i - 1] == w else ("", w) for i, w in enumerate(found)]
        flat = [x for mark, w in out for x in ((["<again>"] if mark else []) + [w if w in known else "<other>"])]
        return ["<b>", "<b>", *flat, "<b>"]

    c = {3: Counter()}
    for t in train:
        seq = tokens(t)
        c[3].update(zip(seq, seq[1:], seq[2:]))
    c[2] = Counter(g[1:] for g in c[3])
    c[1] = Counter(g[1:] for g in c[2])

    def discount(order):
        n = [sum(v == i for v in c[order].values()) for i in (1, 2, 3, 4)]
        return quality.discounts(*n)

    d = {k: discount(k) for k in c}

    def p(gram, last):
        order = len(gram)
        if not order:
            return {"<b>": 1 / 3, "<other>": 1 / 3, "<again>": 1 / 3}.get(last, 0.0)
        own = [(g, n) for g, n in c[order].items() if g[:-1] == gram[:-1]]
        total = sum(n for _, n in own)
        if not total:
            return p(gram[1:], last)
        n = c[order][gram]
        return (n - d[order][min(n, 3)]) / total + sum(d[order][min(n, 3)] for _, n in own) / total * p(gram[1:], last)

    others = sorted({w for w, n in count.items() if n == 1})
    letters = sorted({x for w in others for x in w})

    def spelled(w):
        c3 = Counter()
        for o in others:
            o = "\0\0" + o + "\0"
            c3.update(zip(o, o[1:], o[2:]))
        model = {3: c3, 2: Counter(g[1:] for g in c3)}
        model[1] = Counter(g[1:] for g in model[2])
        dd = {k: quality.discounts(*[sum(v == i for v in m.values()) for i in (1, 2, 3, 4)]) for k, m in model.items()}

        def q(g):
            if not g:
                return 1 / (quality.LETTERS + 2)
            own = [n for h, n in model[len(g)].items() if h[:-1] == g[:-1]]
            n = model[len(g)][g]
            return (n - dd[len(g)][min(n, 3)]) / sum(own) + sum(dd[len(g)][min(x, 3)] for x in own) / sum(own) * q(g[1:]) if own else q(g[1:])

        w = "".join(x if x in letters else "\1" for x in w)
        w = "\0\0" + w + "\0"
        return -sum(math.log(q(g)) for g in zip(w, w[1:], w[2:]))

    seq = tokens(text)
    return -sum(math.log(p(g, g[-1])) for g in zip(seq, seq[1:], seq[2:])) + sum(spelled(w) for w in text.split() if w not in known)


@pytest.mark.parametrize("shards,hot", [(1, 1), (5, 1), (3, 1_000)])
def test_quality_equals_brute_force(spark, monkeypatch, shards, hot):
    monkeypatch.setattr(quality, "HOT", hot)
    monkeypatch.setattr(quality, "PART", 10)
    texts = [*SENTENCES, "a cat sat on the log", "unseen words: mat mat on dogs"]
    rows = spark.createDataFrame([(i, "en", t, i < len(SENTENCES)) for i, t in enumerate(texts)], "row long, lang string, text string, trains boolean")
    tokens, model = quality.train(rows.where("trains"), shards)
    assert len(model.hot) > 3 if hot > 1 else not len(model.hot)
    got = {r["row"]: r["nats"] for r in quality.document_nats(rows, tokens, model, shards).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_nats(SENTENCES, t) / len(t), rel=1e-6)
    # every probability after a context, summed over the vocabulary
    ids = tokens.value.ids["en"]
    trigrams = np.unique([(ids[b] << 36) | (ids[a] << 18) | ids[c] for t in SENTENCES for seq in [["\n", "\n", *t.split()]] for a, b, c in zip(seq, seq[1:], seq[2:]) if {a, b, c} <= ids.keys()])
    for a, b in (("the", "cat"), ("on", "the"), ("mat", "mat")):
        wanted = np.sort(np.array([(ids[b] << 36) | (ids[a] << 18) | i for i in range(len(model.single))]))
        if hot == 1:
            total = np.exp(-quality.negative_logs(model, trigrams, np.ones(len(trigrams), np.int64))(wanted)).sum()
            assert total == pytest.approx(1.0, rel=1e-9)


def test_quality_vocabulary_in_tasks(spark, monkeypatch):
    """The most frequent words, ties by language and word; the driver gets these alone, not each task's."""
    monkeypatch.setattr(quality, "VOCABULARY", 2_000)
    rng = np.random.default_rng(3)
    texts = [(lang, " ".join(f"{w:x}" for w in [*rng.integers(0, 900, 5_000), *rng.integers(1 << 40, 1 << 41, 4_000)])) for lang in ("de", "en") for _ in range(8)]
    asked = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    context = spark.sparkContext
    context.setJobGroup("vocabulary", "vocabulary")
    try:
        found = quality.lexicon(spark.createDataFrame(texts, "lang string, text string"), 16)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    count = Counter((lang, w) for lang, text in texts for w in text.split())
    want = sorted(count, key=lambda k: (-count[k], *k))[:2_000]
    assert {k: i for i, k in enumerate(want)} == {(lang, w): i for lang, ids in found.ids.items() for w, i in ids.items() if i < 2_000}
    assert found.hot.tolist() == [i for i, k in enumerate(want) if count[k] * quality.HOT > sum(count.values())]
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("vocabulary") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    assert 0 < max(store.lastStageAttempt(s).resultSize() for s in stages) < 500_000


@pytest.mark.parametrize("most", [0, 1, 3, 4, 7, 9])
def test_quality_most_frequent(spark, most):
    rows = [("b", "x", 5), ("a", "y", 2), ("a", "x", 2), ("b", "a", 2), ("c", "z", 1), ("a", "z", 1), ("a", "", 1)]
    langs, found, n, total = quality.most_frequent(spark.createDataFrame(rows, "lang string, word string, n long"), most)
    assert [*zip(langs, found, n.tolist())] == sorted(rows, key=lambda r: (-r[2], *r[:2]))[:most] and total == 14
    langs, found, n, total = quality.most_frequent(spark.createDataFrame([], "lang string, word string, n long"), most)
    assert (langs, found, len(n), total) == ([], [], 0, 0)


def test_quality_odd(odd, empty, labels):
    out = quality.score_documents(odd, labels)
    assert out.columns[:2] == ["doc_id", "text"] and out.count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() >= 0.93
    assert rows[rows.toxic == 0].predicted.mean() <= 0.05


def test_toxicity_odd(odd, empty, labels, documents):
    train = documents.select("doc_id", "text")
    got = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(r["score"] == pytest.approx(0.25) for r in got)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(train.unionByName(odd.select("doc_id", "text")), labels).collect())
    assert toxicity.score_toxicity(empty, labels).count() == 0

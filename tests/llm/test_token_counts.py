import json

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from skeinflow.llm import bpe, queries, tokens

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
with open(PATH, encoding="utf-8") as _file:
    OWN = bpe.Vocabulary(_file.read())
WHOLE = frozenset(tokens.proven_whole(OWN))
COUNTER = tokens.Counter(OWN, WHOLE)


def expected(doc_id, text):
    n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
    return doc_id, len((text or "").encode()), n, n > 2048


def check(found, docs):
    want = sorted((expected(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == want


def test_equals_library(spark, documents, odd, empty):
    check(queries.op13_token_counts(spark, SF), documents)
    for docs in (odd, empty):
        check(tokens.token_counts(docs, PATH), docs)


def test_whole_strings_are_one_token():
    """The library gives one token for each proven string that is a pre-token by itself, and nearly every ending is proven."""
    assert len(WHOLE) > 30_000
    for word in sorted(WHOLE):
        if OWN.split(word) == [word]:
            assert len(LIBRARY.encode(word, add_special_tokens=False).ids) == 1, word


def test_unreachable_tokens_are_not_proven():
    """A string of the vocabulary that its merges do not reach is merged like any other."""
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    broken = next(m for m in spec["model"]["merges"][20_000:] if (m if isinstance(m, list) else m.split(" "))[1].endswith("</w>"))
    spec["model"]["merges"].remove(broken)
    other = bpe.Vocabulary(json.dumps(spec))
    word = "".join(broken if isinstance(broken, list) else broken.split(" ")).removesuffix("</w>")
    if word.isascii():
        found = frozenset(tokens.proven_whole(other))
        assert word in WHOLE and word not in found
        assert tokens.Counter(other, found).count(word)[0] == tokens.pieces(other, word) > 1


def test_shortcut_counts_most_words(spark):
    total = queries.op13_token_counts(spark, SF).groupBy().sum("n_words", "n_whole").first()
    assert 0.3 * total[0] < total[1] < total[0]


def test_limit(spark):
    docs = spark.createDataFrame([(1, "the " * 2048), (2, "the " * 2049), (3, "the")], "doc_id long, text string")
    assert {r["doc_id"]: r["over_limit"] for r in tokens.token_counts(docs, PATH).collect()} == {1: False, 2: True, 3: False}
    assert all(not r["over_limit"] for r in tokens.token_counts(docs, PATH, 5000).collect())


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'s", "Σ", "İ", "é", "\x85", "\x1c", "the", " ", "12", "漢", "ʼn", "zq"])).map("".join))
def test_any_text(text):
    assert COUNTER.count(text)[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)

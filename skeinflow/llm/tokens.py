"""Token counts by whole-token shortcut.

Before any text is read, every string of the vocabulary that ends a word is encoded alone: those that come out as one token
are *proven* whole. A pre-token of a text that is such a string counts one; only the rest is cut at certain boundaries and
merged (see ``bpe``). The proof depends on the vocabulary alone, is made once on the driver and is broadcast with the
vocabulary file, so what is broadcast is bounded by that file.

Rows are independent: no shuffle. A task keeps the counts of at most ``CACHE_WORDS`` short merged words.

Defined results: a null text is an empty one (no bytes, no tokens); null doc_id and repeated rows pass through; special
strings inside a text count one token each, as the library counts them by default; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .caches import held

CACHE_WORDS = 500_000
CACHE_CHARS = 64

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_words long, n_whole long"


def pieces(vocabulary: bpe.Vocabulary, word: str) -> int:
    """The number of tokens of a pre-token, by its merges."""
    return sum(len(vocabulary.merge(part)) for part in vocabulary.fragments(word))


def proven_whole(vocabulary: bpe.Vocabulary) -> list[str]:
    """The strings of the vocabulary that stand for whole pre-tokens and whose merges give exactly that one token."""
    byte = {c: b for b, c in enumerate(vocabulary.chars)}
    found = []
    for token in vocabulary.ids:
        if not token.endswith(vocabulary.suffix) or token in vocabulary.special or token == vocabulary.suffix:
            continue
        try:
            word = bytes(byte[c] for c in token.removesuffix(vocabulary.suffix)).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: no pre-token is this string
        if pieces(vocabulary, word) == 1:
            found.append(word)
    return found


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, vocabulary: bpe.Vocabulary, whole: frozenset[str]):
        self.vocabulary, self.whole, self.known = vocabulary, whole, {}

    def merged(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = pieces(self.vocabulary, word)
            if len(word) <= CACHE_CHARS:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and how many of these are proven whole."""
        tokens = words = whole = at = 0
        for special in [*self.vocabulary.at_special.finditer(text), None]:
            part = self.vocabulary.split(text[at : special.start()] if special else text[at:] if at else text)
            rest = [w for w in part if w not in self.whole]
            words += len(part)
            whole += len(part) - len(rest)
            tokens += len(part) - len(rest) + sum(map(self.merged, rest))
            if special:
                tokens, at = tokens + 1, special.end()
        return tokens, words, whole


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_words, n_whole) of every row of ``docs`` (doc_id, text): UTF-8 bytes, tokens,
    whether these are over ``limit``, pre-tokens, and pre-tokens that the shortcut counted."""
    content, key = bpe._spread(docs, path)
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole(bpe._vocabulary(content.value, key)))

    def run(batches):
        counter = held("tokens", key, lambda: Counter(bpe.Vocabulary(content.value), frozenset(whole.value)))
        for batch in batches:
            found = [counter.count(t) if t else (0, 0, 0) for t in batch.column(2).to_pylist()]
            tokens, words, shortcut = (pa.array(c, pa.int64()) for c in ([*zip(*found)] or [()] * 3))
            over = pa.array([f[0] > limit for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, over, words, shortcut], [c.split()[0] for c in COUNTS.split(", ")])

    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), size.alias("n_bytes"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTS)

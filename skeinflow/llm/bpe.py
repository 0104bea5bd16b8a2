"""BPE encoding and decoding with forced boundaries.

The vocabulary is a public ``tokenizers`` file whose model is BPE with an end-of-word suffix and whose pre-tokenizer splits
by a pattern and maps bytes to characters. A text is cut at every place that no token can span: at the special tokens, at
the edges of what the pattern matches, and inside a word between two bytes that stand side by side in no token of the
vocabulary. No merge ever reaches over such a cut, so each fragment is merged by itself, in order of merge rank, and the ids
are concatenated; only the last fragment of a word has the end-of-word suffix.

Rows are independent: no shuffle. A task keeps the ids of words it has met, up to twice
``CACHE_WORDS`` short ones, of which the older half goes first. Decoding joins the tokens by one space, special tokens included, which is what the library does for a file
without a decoder.

Defined results: a null text is an empty one (no ids; the decoded text is empty); null doc_id, repeated rows and other
columns pass through unchanged; long words take time in proportion to n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .caches import held
from .passing import hidden_pass

CACHE_WORDS = 300_000
CACHE_CHARS = 64
LONG_SYMBOLS = 48
NEVER = 1 << 60
#: Rows of a batch whose ids are in memory at a time, as four bytes each.
PART_ROWS = 500

#: Texts of these characters alone have the same words under any version of Unicode.
PLAIN = regex.compile("[\\x00-\\x1b\\x20-\\u012f\\u0131-\\u024f\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u205e\\u4e00-\\u9fa5]*+").fullmatch


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _normalizer(spec: dict):
    kinds = {"NFC": lambda n: normalizers.NFC(), "Lowercase": lambda n: normalizers.Lowercase(), "Replace": lambda n: normalizers.Replace(Regex(n["pattern"]["Regex"]), n["content"])}
    return normalizers.Sequence([kinds[n["type"]](n) for n in spec["normalizer"]["normalizers"]])


class Vocabulary:
    """The merges of a vocabulary file, and what follows from them."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = dict(model["vocab"])
        self.shown = {t: str(i) for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.chars = byte_characters()
        #: Pairs of characters that stand side by side inside some token: every other pair is a certain cut.
        bare = (t.removesuffix(self.suffix) for t in self.ids)
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        #: Words met lately, and those met before them: word -> ids joined by one space.
        self.recent: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.normalizer, self.splitter = _normalizer(spec), pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)

    def fragments(self, word: str) -> list[list[str]]:
        """The symbols of a word, cut where no token can span; the last symbol has the suffix."""
        text = word if word.isascii() and word.isprintable() else "".join(map(self.chars.__getitem__, word.encode()))
        symbols = [*text]
        symbols[-1] += self.suffix
        if self.inside.issuperset(map(str.__add__, text, text[1:])):
            return [symbols]
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside), len(text)]
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, symbols: list[str]) -> list[str]:
        """The merges of one fragment: always the pair of lowest rank, the leftmost of equal ones."""
        if len(symbols) > LONG_SYMBOLS:
            return self._merge_long(symbols)
        parts, rank = [*symbols], self.ranks.get
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and linked neighbours."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        parts: list[str | None] = [*symbols]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (found := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (found, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def encode_word(self, word: str) -> str:
        """The ids of a word, joined by one space."""
        found = self.older.get(word)
        if found is None:
            found = " ".join([self.shown[t] for part in self.fragments(word) for t in self.merge(part)])
        if len(word) <= CACHE_CHARS:
            if len(self.recent) >= CACHE_WORDS:
                self.recent, self.older = {}, self.recent
            self.recent[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """The normalized words. Characters whose classes differ between Unicode versions go through the library's own
        normalizer and pattern."""
        if PLAIN(text):
            return self.words(unicodedata.normalize("NFC", text).lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode(self, text: str) -> list[str]:
        """The ids of a text, in groups that are joined by one space."""
        ids, at = [], 0
        for found in [*self.at_special.finditer(text), None]:
            words = self.split(text[at : found.start() if found else len(text)])
            known = [*map(self.recent.get, words)]
            if None in known:
                known = [k or self.recent.get(w) or self.encode_word(w) for k, w in zip(known, words)]
            ids += known
            if found:
                ids.append(str(self.special[found[0]]))
                at = found.end()
        return ids

    def decode(self, ids: list[int]) -> str:
        names = self.__dict__.get("names") or self.__dict__.setdefault("names", {i: t for t, i in (self.ids | self.special).items()})
        return " ".join(names[i] for i in ids)


def _vocabulary(content: str, key: str) -> Vocabulary:
    """One for each worker process: it lasts over tasks."""
    return held("bpe", key, lambda: Vocabulary(content))


def _spread(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        content = file.read()
    return docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content.encode()).hexdigest()


@hidden_pass
def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with column ``ids`` array<int> (an input column of that name gives way), for any further columns."""
    content, key = _spread(docs, path)
    kept = docs.drop("ids")
    names = [*kept.columns, "ids"]

    def run(batches):
        vocabulary = _vocabulary(content.value, key)
        for batch in (whole.slice(at, PART_ROWS) for whole in batches for at in range(0, whole.num_rows, PART_ROWS)):
            found = [np.fromiter(map(int, " ".join(vocabulary.encode(t or "")).split()), np.int32) for t in batch.column("_bpe_text").to_pylist()]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            kept_columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_bpe_text"]
            yield pa.RecordBatch.from_arrays([*kept_columns, ids], names)

    return kept.withColumn("_bpe_text", F.col("text").cast("string")).mapInArrow(run, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def bpe_decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the tokens of the ids, joined by one space; null ids give an empty text."""
    content, key = _spread(rows, path)

    def run(batches):
        vocabulary = _vocabulary(content.value, key)
        for batch in batches:
            texts = [vocabulary.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(vocabulary: Vocabulary, text: str | None) -> tuple[int, str, str]:
    """The number of ids of a text, and the digests of the ids and of what they decode to."""
    ids = " ".join(vocabulary.encode(text or ""))
    numbers = [*map(int, ids.split(" "))] if ids else []
    return len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(vocabulary.decode(numbers).encode()).hexdigest()


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the decimal ids joined by one space and of
    the decoded text, made where the ids are, so that neither leaves its task."""
    content, key = _spread(docs, path)

    def run(batches):
        vocabulary = _vocabulary(content.value, key)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                for column, value in zip((counts, of_ids, of_text), digests(vocabulary, text)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

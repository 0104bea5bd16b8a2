"""Quality classifier: an interpolated modified Kneser-Ney model of the words of trusted text gives each document's perplexity,
and a document goes if that is above a quantile of what its language's trusted documents have.

Tokens. Words are what stands between blanks, as written; ideographs and kana are words of their own. The vocabulary is the
``VOCABULARY`` most frequent pairs of language and word in the training text. Each language has three tokens more: the boundary
before (twice) and after a text, any other word, and a mark before a word that repeats the last; what the discounts of single
words leave is theirs. No word is lost by that: what the class of other words leaves open is the spelling, which a model of
characters adds (Kneser-Ney too, over the ``LETTERS`` most frequent characters of the language and one class for the rest). It
learns from the training words that stand once or are not in the vocabulary.
The numbers of bigrams and trigrams grow with the corpus without a bound; what is broadcast is bounded by the vocabulary.

Counts. Four fifths of the trusted documents, by a hash of their id, are the training text. Tasks count trigrams by blocks of
texts and send them to shards by their middle word, so a trigram, its context, the bigram that it ends on and that one's context
meet in one shard. Words that are over a ``HOT``-th of the training text are dealt out by the word before, too; their bigrams
(``HOT`` times the vocabulary at most) are summed over the shards and broadcast. The shards' counts of counts give the
discounts, and the numbers of words that each word follows give the single words' probabilities.

Scores. The trigrams of every document go to the same shards, packed by blocks (sorted, as differences, compressed), with their
documents and whether those train. A shard counts what trains, joins it by sorted search with all trigrams, and returns for each
block the sums of negative logarithms of its documents, as multiples of 2^-24, which are added up in any order with the same result.

Thresholds. A text of n characters is judged by (its nats a character - the median) * n / (n + ``SHORT_CHARS``), as a few
characters prove little. The limit is the ``QUANTILE`` quantile of that over the other fifth of the language's trusted
documents. Every document is scored on its whole text.

Which documents are trusted is a join with the labels, broadcast up to ``BROADCAST_IDS`` ids after counting them; the results
are the same.

Defined results: documents with a null or empty text, and those in a language without training text, have no perplexity and
stay; a null language is a language; a null doc_id is scored like any other but is never trusted; an id that labels call both
good and bad is trusted; repeated rows are scored alike; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .caches import lean
from .passing import hidden_pass
from .store import discard, settle

FOLDS = 5
QUANTILE = 0.99
SHORT_CHARS = 64
VOCABULARY = 1 << 17
LETTERS = 62
HOT = 64
BLOCK_WORDS = 1 << 20
PART = 600_000
SLICE = 1 << 18
SHARD_CHARS = 32_000_000
BROADCAST_IDS = 2_000_000
SCALE = 1 << 24
NONE = "\x00"  # stands for a null language
BITS = 18  # of a token's number
MASK = (1 << BITS) - 1
BOUNDARY, OTHER, REPEAT = "\n", "\r", "\t"  # no words
#: Ideographs, kana and hangul one by one, and runs of anything else but blanks.
_SINGLE = "⺀-鿿가-힣豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_SINGLE}]|[^\\s{_SINGLE}]+")


def words(text: str) -> list[str]:
    return text.split() if text.isascii() else _WORD.findall(text)


# --- discounts -------------------------------------------------------------------------------------------------------


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from the numbers of n-grams seen once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    some = lambda a, b, i: min(i - 0.01, max(i - (i + 1) * y * b / a, 0.01)) if a and y else 0.5
    return np.array([0.0, some(n1, n2, 1), some(n2, n3, 2), some(n3, n4, 3)])


def _times(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]


# --- spelling of words outside the vocabulary ------------------------------------------------------------------------


def spelling(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The negative logarithms of character trigrams, from the counts of those in ``codes``; ``size`` classes, 0 the end."""
    c3 = np.zeros(size**3)
    c3[codes] = counts
    c3 = c3.reshape(size, size, size)
    c2 = (c3 > 0).sum(0).astype(float)
    c1 = (c2 > 0).sum(0).astype(float)
    p = np.full(size, 1.0 / size)
    for c in (c1, c2, c3):
        d = discounts(*_times(c.ravel()))[np.minimum(c, 3).astype(int)]
        total = c.sum(-1, keepdims=True)
        lower = np.where(total > 0, d.sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
        p = (c - d) / np.maximum(total, 1) + lower * p
    return -np.log(p).ravel().astype(np.float32)


def _codes(found: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The character trigrams of words, one for each character and one for the end, and where each word's begin."""
    points = np.frombuffer(("\x00\x00" + "\x00\x00\x00".join(found) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    classes = np.where(points == 0, 0, np.where(letters[at] == points, at + 1, LETTERS + 1))
    size = LETTERS + 2
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lengths) - lengths
    own = np.arange(lengths.sum()) + np.repeat(np.arange(len(found)) * 2, lengths)
    return (classes[own] * size + classes[own + 1]) * size + classes[own + 2], starts


# --- tokens ----------------------------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Numbers of tokens; ``language`` of each number; the numbers of hot words; by language the letters and their scores."""

    ids: dict[str, dict[str, int]]
    language: np.ndarray
    hot: np.ndarray
    letters: dict[str, np.ndarray]
    spelled: dict[str, np.ndarray]


class _Numbers(dict):
    """The number of each word of a language; words outside the vocabulary get negative ones until ``forget``."""

    def __init__(self, lexicon: Lexicon, lang: str):
        super().__init__(lexicon.ids[lang])
        self.others: list[str] = []
        self.letters, self.spelled = lexicon.letters.get(lang), lexicon.spelled.get(lang)

    def __missing__(self, word: str) -> int:
        self.others.append(word)
        self[word] = -len(self.others)
        return -len(self.others)

    def costs(self) -> np.ndarray:
        """The spellings of the words with the numbers -1, -2, ..."""
        out = np.zeros(len(self.others))
        for at in range(0, len(self.others), 50_000):
            part = self.others[at : at + 50_000]
            if self.letters is None:  # no other word in the training text: characters are all alike
                out[at : at + len(part)] = [(len(w) + 1) * np.log(LETTERS + 2.0) for w in part]
            else:
                codes, starts = _codes(part, self.letters)
                out[at : at + len(part)] = np.add.reduceat(self.spelled[codes].astype(np.float64), starts)
        return out

    def forget(self) -> None:
        for word in self.others:
            del self[word]
        self.others = []


@dataclass
class Block:
    """Trigrams of some texts: keys (middle word, word before, word), the document of each, and by document its key, its length,
    the cost of spellings and whether it trains."""

    keys: np.ndarray
    doc: np.ndarray
    rows: np.ndarray
    chars: np.ndarray
    extra: np.ndarray
    trains: np.ndarray


def _block(numbers: dict[str, _Numbers], held: list[tuple]) -> Block:
    tokens, special = [], []
    for _, lang, text, _ in held:
        own = numbers[lang]
        found = words(text)
        ids = np.fromiter(map(own.__getitem__, found), np.int64, len(found))
        edge = own[BOUNDARY]
        tokens.append(np.concatenate([[edge, edge], ids, [edge]]))
        special.append((own[OTHER], own[REPEAT]))
    sizes = np.array([len(t) for t in tokens])
    doc, ids = np.repeat(np.arange(len(held), dtype=np.int32), sizes), np.concatenate(tokens)
    del tokens
    special = np.array(special)
    first = np.cumsum(sizes) - sizes
    predicted = np.ones(len(ids), bool)
    predicted[first] = predicted[first + 1] = False
    again = np.r_[False, ids[1:] == ids[:-1]] & predicted
    extra = np.zeros(len(held))
    names = [lang for _, lang, _, _ in held]
    for lang in set(names):
        costs = numbers[lang].costs()
        if len(costs):
            at = np.flatnonzero((ids < 0) & np.array([n == lang for n in names])[doc])
            extra += np.bincount(doc[at], costs[-1 - ids[at]], len(held))
        numbers[lang].forget()
    ids, again = np.where(ids < 0, special[doc, 0], ids), np.flatnonzero(again)
    ids, predicted, doc = np.insert(ids, again, special[doc[again], 1]), np.insert(predicted, again, True), np.insert(doc, again, doc[again])
    at = np.flatnonzero(predicted)
    keys = (ids[at - 1] << (2 * BITS)) | (ids[at - 2] << BITS) | ids[at]
    doc = doc[at]
    del ids, predicted, again, at
    order = np.argsort(keys, kind="stable")
    return Block(keys[order], doc[order], np.array([h[0] for h in held], np.int64), np.array([len(h[2]) for h in held], np.int64), np.rint(extra * SCALE).astype(np.int64), np.array([h[3] for h in held], bool))


def _blocks(batches, lexicon: Lexicon):
    """Blocks of (row, lang, text, trains), of some ``BLOCK_WORDS`` words each."""
    numbers = {lang: _Numbers(lexicon, lang) for lang in lexicon.ids}
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[2] and row[1] in numbers:
                held.append(row)
                size += len(row[2]) // 5 + 3
                if size >= BLOCK_WORDS:
                    yield _block(numbers, held)
                    held, size = [], 0
    if held:
        yield _block(numbers, held)


def shard_of(keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a trigram follows its middle word, and the word before that if the middle word is hot."""
    middle = keys >> (2 * BITS)
    mixed = middle + np.where(np.isin(middle, hot), ((keys >> BITS) & MASK) + 1, 0) * 0x1F123BB5
    mixed = (mixed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % np.uint64(shards)).astype(np.int32)


def _by_shard(keys: np.ndarray, hot: np.ndarray, shards: int):
    """(shard, positions) for sorted keys."""
    found = shard_of(keys, hot, shards)
    order = np.argsort(found, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(found[order]) != 0]) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(found[order[a]]), order[a:b]


def pack(values: np.ndarray) -> bytes:
    """Integers by their lowest bytes first, all first bytes before all second ones, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(planes[: int(planes.any(1).nonzero()[0].max(initial=0)) + 1].tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted trigrams: middle words as differences, and the words before and after as differences within one middle word and
    one context, else as they are."""
    a, b, c = keys >> (2 * BITS), (keys >> BITS) & MASK, keys & MASK
    same_a = np.r_[False, a[1:] == a[:-1]]
    same_b = np.r_[False, b[1:] == b[:-1]] & same_a
    b, c = b - np.where(same_a, np.r_[0, b[:-1]], 0), c - np.where(same_b, np.r_[0, c[:-1]], 0)
    return b"".join(len(x).to_bytes(8, "little") + x for x in map(pack, (np.diff(a, prepend=0), b, c)))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    parts, at = [], 0
    for _ in range(3):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(unpack(data[at + 8 : at + 8 + size], n))
        at += 8 + size
    a, b, c = parts
    new = a != 0
    new[0] = True
    a, b = np.cumsum(a), _sums_from(b, new)
    new[1:] |= b[1:] != b[:-1]
    return (a << (2 * BITS)) | (b << BITS) | _sums_from(c, new)


def _sums_from(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums that begin again where ``new`` is."""
    sums, first = np.cumsum(values), np.flatnonzero(new)
    return sums - np.repeat(sums[first] - values[first], np.diff(np.r_[first, len(values)]))


# --- training --------------------------------------------------------------------------------------------------------


@lean
def _count_words(batches, shards: int):
    """(shard, lang, size, words, n) of (lang, text): words and their numbers, summed over many texts, by a hash of the word."""
    counts: dict[tuple[str, str], int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word in words(text or ""):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        if len(counts) > 500_000:
            yield _word_batch(counts, shards)
            counts = {}
    if counts:
        yield _word_batch(counts, shards)


def _word_batch(counts: dict, shards: int) -> pa.RecordBatch:
    parts: dict[tuple[int, str], list] = {}
    for (lang, word), n in sorted(counts.items()):
        parts.setdefault((zlib.crc32(word.encode("utf-8", "surrogatepass")) % shards, lang), []).append((word, n))
    out = []
    for (shard, lang), found in parts.items():
        text = "\n".join([w for w, _ in found]).encode("utf-8", "surrogatepass")
        out.append((shard, lang, len(found), zstandard.compress(text), pack(np.array([n for _, n in found]))))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "lang", "size", "words", "n"])


@lean
def _sum_words(batches):
    """Shards of ``_count_words`` -> (lang, word, n)."""
    for rows in _runs(batches):
        counts: dict[tuple[str, str], int] = {}
        for r in rows:
            found = zstandard.decompress(r["words"]).decode("utf-8", "surrogatepass").split("\n")
            for word, n in zip(found, unpack(r["n"], r["size"]).tolist()):
                counts[r["lang"], word] = counts.get((r["lang"], word), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


def _spell_batches(letters: dict[str, np.ndarray]):
    def run(batches):
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for name in set(lang.tolist()):
                part = batch.column(1).filter(pa.array(lang == name)).to_pylist()
                codes, n = np.unique(_codes(part, letters[name])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    return run


def most_frequent(counted: DataFrame, most: int) -> tuple[list[str], list[str], np.ndarray, int]:
    """The languages, words and numbers of the ``most`` most frequent of (lang, word, n), ties by language and word, and the sum
    of all numbers.

    How many words stand n times comes to the driver first: one row for each n, so under sqrt(2 * the sum of all numbers) rows.
    Words below the number that fills the vocabulary go where they are. The others are ordered by Spark's tasks and come as
    Arrow columns: rows collected in order would be each task's ``most``, merged on the driver."""
    times = counted.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    n, rows = (times.column(c).to_numpy() for c in ("n", "rows"))
    total, order = int(n @ rows), np.argsort(-n)
    filled = np.flatnonzero(np.cumsum(rows[order]) >= most)
    least = int(n[order[filled[0]]]) if len(filled) else 1
    known = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "lang", "word").limit(most).toArrow()
    return known.column("lang").to_pylist(), known.column("word").to_pylist(), known.column("n").to_numpy(), total


def lexicon(training: DataFrame, shards: int) -> Lexicon | None:
    """The tokens of training texts (lang, text)."""
    packed = training.mapInArrow(lambda b: _count_words(b, shards), "shard int, lang string, size long, words binary, n binary")
    counted = settle(to_shards(packed, shards).mapInArrow(_sum_words, "lang string, word string, n long"), "words")
    known_langs, known_words, times, total = most_frequent(counted, VOCABULARY)
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not languages:
        return None
    ids: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for at, (lang, word) in enumerate(zip(known_langs, known_words)):
        ids[lang][word] = at
    after = len(times)
    for lang in languages:
        for word in (BOUNDARY, OTHER, REPEAT):
            ids[lang][word] = after
            after += 1
    if after > MASK:
        raise ValueError(f"{len(languages)} languages are too many for tokens of {BITS} bits")
    language = np.zeros(after, np.int32)
    for i, lang in enumerate(languages):
        language[list(ids[lang].values())] = i
    hot = np.flatnonzero(times * HOT > total)
    # a word outside the vocabulary is one text for the spelling, however often it stands
    least = (int(times[-1]), known_langs[-1], known_words[-1]) if len(times) == VOCABULARY else (1, "", "")
    n, lang, word = F.col("n"), F.col("lang"), F.col("word")
    others = counted.where((n < least[0]) | (n == 1) | ((n == least[0]) & ((lang > least[1]) | ((lang == least[1]) & (word > least[2])))))
    chars = others.select("lang", F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("lang", "c").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "c"))
    letters = {}
    for lang, c in chars.withColumn("r", rank).where(F.col("r") <= LETTERS).select("lang", "c").collect():
        if len(c) == 1:
            letters.setdefault(lang, []).append(ord(c))
    letters = {lang: np.array(sorted(set(found)), np.uint32) for lang, found in letters.items()}
    codes = others.where(F.length("word") > 0).select("lang", "word").mapInArrow(_spell_batches(letters), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    spelled = {lang: spelling(part["code"].to_numpy(), part["n"].to_numpy(), LETTERS + 2) for lang, part in codes.groupby("lang")}
    discard(counted)
    return Lexicon(ids, language, hot.astype(np.int64), {k: v for k, v in letters.items() if k in spelled}, spelled)


@lean
def _trigram_batches(batches, lexicon: Lexicon, shards: int):
    """(shard, size, keys, n) of the training texts: distinct trigrams of a block and their numbers."""
    for block in _blocks(batches, lexicon):
        keys, n = np.unique(block.keys, return_counts=True)
        out = [(s, len(at), pack_keys(keys[at]), pack(n[at])) for s, at in _by_shard(keys, lexicon.hot, shards)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "size", "keys", "n"])


def _runs(batches, key: str = "shard"):
    """The rows of each key, of rows in order of it, with bytes as views of their batch; memory: the batches of one key."""
    held: list[dict] = []
    for batch in batches:
        values = [[x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
        for row in (dict(zip(batch.schema.names, found)) for found in zip(*values)):
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, np.diff(keys) != 0]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _bigrams(trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams (middle word, word) that distinct trigrams end on, and how many words stand before them."""
    return np.unique(((trigrams >> (2 * BITS)) << BITS) | (trigrams & MASK), return_counts=True)


@lean
def _statistics(batches, lexicon: Lexicon):
    """(kind, a, b, n): 3 and 2, language a: how many trigrams and bigrams are counted b times; 1: how many words stand before
    word a; 0: how many stand before bigram a of a hot word, in this shard."""
    for rows in _runs(batches):
        keys = np.concatenate([unpack_keys(r["keys"], r["size"]) for r in rows])
        trigrams, c3 = _summed(keys, np.concatenate([unpack(r["n"], r["size"]) for r in rows]))
        bigrams, c2 = _bigrams(trigrams)
        is_hot = np.isin(bigrams >> BITS, lexicon.hot)
        parts = [(np.zeros(is_hot.sum(), np.int64), bigrams[is_hot], np.zeros(is_hot.sum(), np.int64), c2[is_hot])]
        word, n = np.unique(bigrams[~is_hot] & MASK, return_counts=True)
        parts.append((np.ones(len(word), np.int64), word, np.zeros(len(word), np.int64), n))
        for kind, own, counts in ((3, trigrams >> (2 * BITS), c3), (2, bigrams[~is_hot] >> BITS, c2[~is_hot])):
            code, n = np.unique(lexicon.language[own] * 8 + np.minimum(counts, 5), return_counts=True)
            parts.append((np.full(len(code), kind), code // 8, code % 8, n))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], ["kind", "a", "b", "n"])


@dataclass
class Model:
    """The language of each token; by order and language what is taken off a count; the probability of each word alone; hot
    words and their bigrams."""

    language: np.ndarray
    discount: dict[int, np.ndarray]
    single: np.ndarray
    hot: np.ndarray
    hot_bigrams: np.ndarray
    hot_counts: np.ndarray


def train(training: DataFrame, shards: int) -> tuple[Broadcast, Model] | None:
    """The lexicon, broadcast, and the model of texts (row, lang, text, trains) that all train; what comes to the driver is
    bounded by ``HOT`` * ``VOCABULARY``."""
    found = lexicon(training.select("lang", "text"), shards)
    if found is None:
        return None
    spread = training.sparkSession.sparkContext.broadcast(found)
    packed = training.mapInArrow(lambda b: _trigram_batches(b, spread.value, shards), "shard int, size long, keys binary, n binary")
    rows = to_shards(packed, shards).mapInArrow(lambda b: _statistics(b, spread.value), "kind long, a long, b long, n long")
    # Arrow's columns as they come: a frame would hold them twice
    found_rows = rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    kind, a, b, n = (found_rows.column(c).to_numpy() for c in ("kind", "a", "b", "n"))
    language, languages = found.language, len(found.ids)
    times = {3: np.zeros((languages, 8)), 2: np.zeros((languages, 8))}
    for k in (2, 3):
        times[k][a[kind == k], b[kind == k]] = n[kind == k]
    hot = np.flatnonzero(kind == 0)
    hot = hot[np.argsort(a[hot], kind="stable")]
    hot_bigrams, hot_counts = a[hot], n[hot]
    np.add.at(times[2], (language[hot_bigrams >> BITS], np.minimum(hot_counts, 5)), 1)
    before = np.zeros(len(language), np.int64)
    np.add.at(before, a[kind == 1], n[kind == 1])
    np.add.at(before, hot_bigrams & MASK, 1)
    discount = {k: np.stack([discounts(*t[1:5]) for t in x]) for k, x in times.items()}
    single = np.zeros(len(language))
    for i in range(languages):
        own = np.flatnonzero(language == i)
        d = discounts(*_times(before[own]))[np.minimum(before[own], 3)]
        total = before[own].sum()
        single[own] = (before[own] - d) / max(total, 1)
        # what the words seen leave goes to the language's last three tokens
        single[own[-3:]] += (d.sum() / total if total else 1.0) / 3
    return spread, Model(language, discount, single, found.hot, hot_bigrams, hot_counts)


# --- scoring ---------------------------------------------------------------------------------------------------------


def _contexts(context: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of sorted n-grams, their totals and weights, and the context of each n-gram."""
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    names, of = context[new], np.cumsum(new, dtype=np.int32) - 1
    total = np.bincount(of, counts, len(names))
    return names, total, np.bincount(of, d, len(names)) / np.maximum(total, 1), of


def _at(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted one in sorted names, and whether it is there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


def negative_logs(model: Model, trigrams: np.ndarray, counts: np.ndarray):
    """The function of sorted trigrams of one shard, from the shard's training counts."""
    language = model.language
    d3 = model.discount[3][language[trigrams >> (2 * BITS)], np.minimum(counts, 3)]
    context3, total3, weight3, of3 = _contexts(trigrams >> BITS, counts, d3)
    bigrams, c2 = _bigrams(trigrams)
    if len(model.hot):
        cold = ~np.isin(bigrams >> BITS, model.hot)
        bigrams, c2 = _summed(np.concatenate([bigrams[cold], model.hot_bigrams]), np.concatenate([c2[cold], model.hot_counts]))
    d2 = model.discount[2][language[bigrams >> BITS], np.minimum(c2, 3)]
    context2, total2, weight2, of2 = _contexts(bigrams >> BITS, c2, d2)
    first2 = (c2 - d2) / total2[of2]
    first3 = (counts - d3) / total3[of3]

    def scored(part: np.ndarray) -> np.ndarray:
        middle, word = part >> (2 * BITS), part & MASK
        at, there = _at(context2, middle)
        p = model.single[word] * (np.where(there, weight2[at], 1.0) if len(weight2) else 1.0)
        at, there = _at(bigrams, (middle << BITS) | word)
        p = p + (np.where(there, first2[at], 0.0) if len(first2) else 0.0)
        at, there = _at(context3, part >> BITS)
        p = p * (np.where(there, weight3[at], 1.0) if len(weight3) else 1.0)
        at, there = _at(trigrams, part)
        return -np.log(p + (np.where(there, first3[at], 0.0) if len(first3) else 0.0))

    return scored


@lean
def _document_batches(batches, lexicon: Lexicon, shards: int):
    """(shard, size, docs, block, keys, doc, trains): the trigrams of a block for a shard, with the numbers of their documents in
    the block. One row for each block has size 0 and what belongs to the documents: their keys, lengths and costs of spellings.

    A block is named by its documents. Blocks alike share a name; their sums are then of all of them, as are the lengths."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
    for block in _blocks(batches, lexicon):
        name = int.from_bytes(blake2b(block.rows.tobytes() + block.trains.tobytes(), digest_size=8).digest(), "little", signed=True)
        docs, trains = len(block.rows), np.packbits(block.trains).tobytes()
        out = [(name % shards, 0, docs, name, block.rows.tobytes(), pack(block.chars), pack(block.extra))]
        out += [(shard, len(at), docs, name, pack_keys(block.keys[at]), pack(block.doc[at]), trains) for shard, at in _by_shard(block.keys, lexicon.hot, shards)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["shard", "size", "docs", "block", "keys", "doc", "trains"])


def _parts(rows: list[dict], offsets: np.ndarray):
    """(keys, doc) of a shard's rows in parts of about ``PART`` trigrams, cut between middle words; each part reads the packed
    rows again, so that one part at a time is in memory."""
    sample = np.concatenate([unpack_keys(r["keys"], r["size"])[:: 1 + len(rows) // 4].copy() for r in rows])
    count = -(-sum(r["size"] for r in rows) // PART)
    cuts = np.unique(np.quantile(sample >> (2 * BITS), np.arange(1, count) / count, method="nearest").astype(np.int64)) << (2 * BITS)
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), 1 << 62]):
        keys, doc = [], []
        for r, offset in zip(rows, offsets):
            own = unpack_keys(r["keys"], r["size"])
            at = slice(*np.searchsorted(own, [low, high]))
            keys.append(own[at].copy())
            doc.append((unpack(r["doc"], r["size"])[at] + offset).astype(np.int32))
        keys, doc = np.concatenate(keys), np.concatenate(doc)
        if len(keys):
            order = np.argsort(keys)
            part = keys[order], doc[order]
            del keys, doc, order, own
            yield part
            del part


@lean
def _score_batches(batches, model: Model):
    """Shards of ``_document_batches`` -> (block, docs, nats, row, chars): sums of a block's documents in the shard; the rows
    that tell of the documents pass with their keys and lengths."""
    for rows in _runs(batches, "shard"):
        told, rows = [r for r in rows if not r["size"]], [r for r in rows if r["size"]]
        out = [(r["block"], r["docs"], *(bytes(r[c]) for c in ("trains", "keys", "doc"))) for r in told]
        offsets = np.cumsum([0, *(r["docs"] for r in rows)])
        nats = np.zeros(offsets[-1])
        if rows:
            trains = np.concatenate([np.unpackbits(np.frombuffer(r["trains"], np.uint8), count=r["docs"]) for r in rows]).astype(bool)
        for keys, doc in _parts(rows, offsets) if rows else ():
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            seen, wanted = np.add.reduceat(trains[doc].astype(np.int32), first), keys[first]
            scored = negative_logs(model, wanted[seen > 0], seen[seen > 0].astype(np.int64))
            first = np.r_[first, len(keys)]
            for at in range(0, len(wanted), SLICE):
                costs = np.repeat(np.rint(scored(wanted[at : at + SLICE]) * SCALE), np.diff(first[at : at + SLICE + 1]))
                # sums of whole numbers below 2^53 are exact in doubles
                nats += np.bincount(doc[first[at] : first[at] + len(costs)], costs, offsets[-1])
            del keys, doc, first, seen, wanted, scored, costs  # the next part is unpacked before they are bound again
        nats = nats.astype(np.int64)
        out += [(r["block"], r["docs"], pack(nats[a:b]), None, None) for r, a, b in zip(rows, offsets, offsets[1:])]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "docs", "nats", "row", "chars"])


@lean
def _sum_batches(batches):
    """Blocks of ``_score_batches`` -> (row, nats, chars)."""
    for rows in _runs(batches, "block"):
        nats = sum(unpack(r["nats"], r["docs"]) for r in rows)
        told = [r for r in rows if r["row"] is not None]
        row, chars = np.frombuffer(told[0]["row"], np.int64), sum(unpack(r["chars"], r["docs"]) for r in told)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(nats), pa.array(chars)], ["row", "nats", "chars"])


def to_shards(packed: DataFrame, shards: int) -> DataFrame:
    """Rows with a column ``shard``, each shard in one task."""
    return packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def document_nats(flagged: DataFrame, tokens: Broadcast, model: Model, shards: int) -> DataFrame:
    """(row, nats): nats a character of texts (row, lang, text, trains); equal rows are one."""
    spread = flagged.sparkSession.sparkContext.broadcast(model)
    packed = flagged.mapInArrow(lambda b: _document_batches(b, tokens.value, shards), "shard int, size long, docs long, block long, keys binary, doc binary, trains binary")
    sums = to_shards(packed, shards).mapInArrow(lambda b: _score_batches(b, spread.value), "block long, docs long, nats binary, row binary, chars binary")
    rows = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_batches, "row long, nats long, chars long")
    return rows.groupBy("row").agg((F.sum("nats") / F.lit(SCALE) / F.sum("chars")).alias("nats"))


def _language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(NONE)) if "lang" in docs.columns else F.lit(NONE)


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(_language(docs), F.col("text").cast("string"))


@hidden_pass
def score_documents(docs: DataFrame, labels: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` with the columns ``perplexity`` (a character), ``threshold`` and ``keep`` after its own; trusted are the
    documents that ``labels`` (doc_id, quality) gives quality 1."""
    docs = docs.drop("perplexity", "threshold", "keep", "nats")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), _row(docs).alias("row"), _language(docs).alias("lang"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64("_id"), F.lit(FOLDS))
    trusted = texts.join(good, F.col("_id") == F.col("_good"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(4, -(-chars // shard_chars))
    trained = train(trusted.where(fold > 0).select("row", "lang", "text", F.lit(True).alias("trains")), shards)
    if trained is None:
        found = docs.sparkSession.createDataFrame([], "row long, nats double")
    else:
        flagged = texts.join(good, F.col("_id") == F.col("_good"), "left")
        found = document_nats(flagged.select("row", "lang", "text", (F.col("_good").isNotNull() & (fold > 0)).alias("trains")), *trained, shards)
    nats = settle(found.withColumnRenamed("row", "_row"), "nats")

    n = F.col("_n")
    held = trusted.where(fold == 0).select("lang", F.col("row").alias("_row"), F.length("text").alias("_n")).join(nats, "_row")
    held = settle(held, "held")
    medians = held.groupBy("lang").agg(F.percentile_approx("nats", F.lit(0.5), F.lit(100_000)).alias("_median"))
    distance = (F.col("nats") - F.col("_median")) * n / (n + SHORT_CHARS)
    limits = held.join(F.broadcast(medians), "lang").groupBy(F.col("lang").alias("_limit_lang"), "_median").agg(F.percentile_approx(distance, F.lit(QUANTILE), F.lit(100_000)).alias("_limit"))
    rows = docs.withColumn("_row", _row(docs)).withColumn("_n", F.length(F.col("text").cast("string"))).join(nats, "_row", "left")
    rows = rows.join(F.broadcast(settle(limits, "limits")), _language(docs) == F.col("_limit_lang"), "left")
    keep = F.coalesce(distance <= F.col("_limit"), F.lit(True))
    return rows.select(*docs.columns, F.exp("nats").alias("perplexity"), F.exp(F.col("_median") + F.col("_limit")).alias("threshold"), keep.alias("keep"))


@hidden_pass
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had."""
    odd = {c: f"_own_{c}" for c in ("perplexity", "threshold", "keep", "nats") if c in docs.columns}
    kept = score_documents(docs.withColumnsRenamed(odd), labels).where("keep")
    return kept.select(*[F.col(odd.get(c, c)).alias(c) for c in docs.columns])

"""License scans: ordered signature rules, each gated by a keyword, with priorities and interval containment.

A rule is a regex over the normalized words of a text, written ``" word word ... "``: A-Z lower-cased, words are runs of
ASCII letters and digits and of all other characters from U+0080 on. Rules are tried only where their keyword stands in
the text. Detections that lie inside another detection of higher priority, or inside a longer one of the same priority, are
suppressed; the base phrases, which a caller counts, are never suppressed.

Some 300 signatures of license texts, headers, expressions, links and notices are written by hand (``license_rules``). Mentions
of a license by name come from the families below: each license has names, each name may have versions, and each phrasing
gives one more rule. Priority follows how much a rule says: a license's own text or a grant over a reference or bare mention.

Rows are independent, no shuffle; whole texts are scanned. Defined results: a null text is an empty one (no words, score 0);
null doc_id, repeated rows: as they are; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .license_rules import SIGNATURES

#: Phrase and label.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that must stand in the text, regex of the name, versions (their words, and their end in the label).
FAMILIES = (
    ("mit", "mit", "mit(?: x11)?", ()),
    ("apache", "apache", "apache(?: software)?", (("1 0", "-1.0"), ("1 1", "-1.1"), ("2(?: 0)?", "-2"))),
    ("gpl", "general", "(?:gnu )?general public", (("1(?: 0)?", "-1"), ("2(?: 0)?", "-2"), ("3(?: 0)?", "-3"))),
    ("gpl", "gpl", "(?:gnu )?gpl", (("1(?: 0)?", "-1"), ("2(?: 0)?", "-2"), ("3(?: 0)?", "-3"))),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public", (("2(?: 0)?", "-2"), ("2 1", "-2.1"), ("3(?: 0)?", "-3"))),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", (("2(?: 0)?", "-2"), ("2 1", "-2.1"), ("3(?: 0)?", "-3"))),
    ("agpl", "affero", "(?:gnu )?affero general public", (("1(?: 0)?", "-1"), ("3(?: 0)?", "-3"))),
    ("agpl", "agpl", "(?:gnu )?agpl", (("1(?: 0)?", "-1"), ("3(?: 0)?", "-3"))),
    ("gfdl", "documentation", "(?:gnu )?free documentation", (("1 1", "-1.1"), ("1 2", "-1.2"), ("1 3", "-1.3"))),
    ("mpl", "mozilla", "mozilla public", (("1 0", "-1.0"), ("1 1", "-1.1"), ("2(?: 0)?", "-2"))),
    ("epl", "eclipse", "eclipse public", (("1(?: 0)?", "-1"), ("2(?: 0)?", "-2"))),
    ("cddl", "development", "common development and distribution", (("1 0", "-1.0"), ("1 1", "-1.1"))),
    ("cpl", "common", "common public", (("1 0", "-1.0"),)),
    ("eupl", "european", "european union public", (("1 1", "-1.1"), ("1 2", "-1.2"))),
    ("osl", "open", "open software", (("2 1", "-2.1"), ("3 0", "-3.0"))),
    ("afl", "academic", "academic free", (("2 1", "-2.1"), ("3 0", "-3.0"))),
    ("artistic", "artistic", "artistic", (("1 0", "-1.0"), ("2 0", "-2.0"))),
    ("bsd", "bsd", "(?:new |modified |simplified )?bsd", (("2 clause", "-2"), ("3 clause", "-3"), ("4 clause", "-4"))),
    ("boost", "boost", "boost software", (("1 0", "-1.0"),)),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib", ()),
    ("psf", "python", "python software foundation", (("2(?: 0)?", "-2"),)),
    ("php", "php", "php", (("3 0", "-3.0"), ("3 01", "-3.01"))),
    ("wtfpl", "wtfpl", "wtfpl", (("2(?: 0)?", "-2"),)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("odbl", "database", "open (?:data commons open )?database", (("1 0", "-1.0"),)),
    ("ofl", "font", "(?:sil )?open font", (("1 0", "-1.0"), ("1 1", "-1.1"))),
    ("cc0", "cc0", "cc0", (("1 0", "-1.0"),)),
)

#: Creative Commons codes and the words of their names.
CREATIVE_COMMONS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:ative)?s"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)

#: Priority and phrasing of a family's name {n} and version {v}.
PHRASINGS = (
    (90, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?{v}"),
    (80, "under (?:the )?(?:terms of (?:the )?)?{n} licen[cs]e{v}"),
    (70, "spdx license identifier {n}{v}"),
    (60, "{n} licen[cs]e{v}"),
)

@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first, then signatures before families, in their order."""
    lines = (x.split(" ", 3) for x in SIGNATURES.splitlines() if x and not x.startswith("#"))
    out = [Rule(int(p), label, k, r) for p, label, k, r in lines]
    for label, keyword, name, versions in FAMILIES:
        for priority, phrase in PHRASINGS:
            out += [Rule(priority + 5, label + end, keyword, phrase.format(n=name, v=f"(?: version)?(?: v ?| ){words}(?: or later)?")) for words, end in versions]
            out.append(Rule(priority, label, keyword, phrase.format(n=name, v="")))
    for code, words in CREATIVE_COMMONS:
        short = code.replace("-", " ")
        for name, keyword in ((f"creative commons {words}", "creative"), (f"cc {short}", "cc")):
            for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
                out.append(Rule(65, f"cc-{code}-{version.replace(' ', '.')}", keyword, f"{name} {version}"))
            out.append(Rule(60, f"cc-{code}", keyword, name))
    return tuple(sorted(out, key=lambda r: -r.priority))


_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_WORDS = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


class Scanner:
    def __init__(self):
        self.rules = [(r, re.compile(b" " + r.pattern.encode() + b"(?= )")) for r in rules()]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, (rule, _) in enumerate(self.rules):
            self.by_keyword.setdefault(rule.keyword.encode(), []).append(i)
        self.keywords = frozenset(self.by_keyword) | {w.encode() for phrase, _ in BASE_PHRASES for w in phrase.split()[-1:]}
        self.base = [(b" " + phrase.encode() + b" ", label) for phrase, label in BASE_PHRASES]

    def scan(self, text: bytes):
        """(number of words, base places [(first word, label)], kept detections [(first, last word, label, priority)])."""
        words = text.translate(_TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        present = self.keywords.intersection(words) if words else ()
        if not present:
            return len(words), [], []
        starts: list[int] = []

        def word_at(i: int) -> int:
            if not starts:
                at = 0
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            return bisect_right(starts, i) - 1

        places = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append((word_at(at), label))
                at = line.find(phrase, at + 1)
        found = []
        for i in sorted(i for word in present for i in self.by_keyword.get(word, ())):
            rule, pattern = self.rules[i]
            for m in pattern.finditer(line):
                found.append((word_at(m.start()), word_at(m.end() - 1), rule.label, rule.priority))
        return len(words), places, _uncontained(found)


def _uncontained(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections not inside a kept one of higher priority, or of the same priority and longer or earlier in the rules.

    Kept intervals are swept in order of start with the furthest end so far, so the cost is n log n for each priority."""
    kept: list[tuple[int, int, str, int]] = []
    for priority in sorted({f[3] for f in found}, reverse=True):
        own = sorted((f for f in found if f[3] == priority), key=lambda f: (f[0], -f[1]))
        above = sorted((f[0], f[1]) for f in kept)
        reach, i, furthest = -1, 0, -1
        for f in own:
            while i < len(above) and above[i][0] <= f[0]:
                reach = max(reach, above[i][1])
                i += 1
            if f[1] > reach and f[1] > furthest:
                kept.append(f)
                furthest = f[1]
    return sorted(kept)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _batches(batches):
    scanner = Scanner()
    kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
    for batch in batches:
        out = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            n, places, found = scanner.scan(text or b"")
            at = [p[0] for p in places]
            base = {p[1] for p in places}
            covered = sum(f[1] - f[0] + 1 for f in found)
            score = max((f[3] for f in found), default=60 if base else 0) / 100 if n else 0.0
            out.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[2] for f in found})), min(1.0, score + 0.05 * (covered > 0.2 * n and covered > 0))))
        columns = [*zip(*out)] or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; the score is the highest
    priority among its detections, out of 100, and a little more where they cover over a fifth of the words."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_batches, _SCHEMA)


def _spans(batches):
    scanner = Scanner()
    for batch in batches:
        out = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) for f in scanner.scan(t or b"")[2]]
        columns = [*zip(*out)] or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "first_word", "last_word", "label", "priority"])


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, label, priority): every detection that nothing suppresses."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_spans, "doc_id long, first_word long, last_word long, label string, priority int")

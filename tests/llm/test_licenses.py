import itertools
import random
import re
from re import _constants as C, _parser

from hypothesis import given, settings, strategies as st

from skeinflow.llm import licenses

SCANNER = licenses.Scanner()


def variants(tree, most=6):
    """Some strings that match a parsed pattern: the first of each choice, every branch once, optional parts out and in."""
    out = [""]
    for kind, value in tree:
        if kind is C.LITERAL:
            parts = [chr(value)]
        elif kind is C.NOT_LITERAL:
            parts = ["z"]
        elif kind is C.IN:
            parts = ["z" if value[0][0] is C.NEGATE else chr(value[0][1][0] if value[0][0] is C.RANGE else value[0][1])]
        elif kind is C.SUBPATTERN:
            parts = variants(value[3])
        elif kind is C.BRANCH:
            parts = [s for branch in value[1] for s in variants(branch)[:2]]
        elif kind is C.MAX_REPEAT:
            inner = variants(value[2])
            parts = [inner[0] * value[0], *(s * max(1, value[0]) for s in inner)]
        else:
            raise AssertionError(kind)
        tails = itertools.cycle(parts)
        wide = [a + b for a, b in zip(out, tails)] + [out[0] + b for b in parts[1:]]
        out = list(dict.fromkeys([out[0] + parts[0], *wide]))[: most if len(parts) == 1 else None]
    return out


def samples(rule):
    return variants(_parser.parse(rule.pattern))


def plain(text):
    """Base labels, labels and score by the definition: every rule everywhere, containment by comparing all pairs."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    line = " " + " ".join(words) + " "
    base = {label for phrase, label in licenses.BASE_PHRASES if f" {phrase} " in line}
    found = []
    for rule in licenses.rules():
        for m in re.finditer(" " + rule.pattern + "(?= )", line):
            first = line[: m.start()].count(" ")
            found.append((first, line[: m.end()].count(" ") - 1, rule.label, rule.priority))
    kept = []
    for f in sorted(found, key=lambda f: (-f[3], f[0], -f[1])):
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    covered = sum(k[1] - k[0] + 1 for k in kept)
    score = max((k[3] for k in kept), default=60 if base else 0) / 100
    score = min(1.0, score + (0.05 if covered > 0.2 * len(words) else 0)) if words else 0.0
    return ",".join(sorted(base)), ",".join(sorted(base | {k[2] for k in kept})), score


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["base_labels"], r["labels"], r["score"]) for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


def test_hundreds_by_hand():
    by_hand = [x for x in licenses.SIGNATURES.splitlines() if x and not x.startswith("#")]
    assert len(by_hand) >= 290 and len(set(by_hand)) == len(by_hand)
    assert len(licenses.rules()) > len(by_hand) + 250


def test_each_rule_hits_and_misses():
    for i, (rule, pattern) in enumerate(SCANNER.rules):
        for sample in samples(rule):
            words = sample.split(" ")
            assert rule.keyword in words, (rule, sample)
            whole = f" {sample} ".encode()
            assert pattern.match(whole), (rule, sample)
            assert any(f[2:] == (rule.label, rule.priority) or f[3] >= rule.priority for f in SCANNER.scan(f"so, {sample}.".encode())[2]), (rule, sample)
        assert not pattern.search(f" {' '.join(words[:-1])}x ".encode()) or len(samples(rule)) > 1, rule
        assert not pattern.search(b" " + " ".join(w + "q" for w in words).encode() + b" "), rule


def test_labels_and_scores_by_brute_force(spark, documents):
    rng = random.Random(7)
    texts = [r["text"] or "" for r in documents.limit(60).collect()]
    every = [s for rule in licenses.rules() for s in samples(rule)[:1]]
    mixed = [" ... ".join(rng.sample(every, 4) + [rng.choice(texts)[:400]]) for _ in range(120)]
    texts += mixed + ["", "Under the MIT license", "© 2021 Someone. Alle Rechte vorbehalten!", "tous droits réservés"]
    for text, (base, labels, score) in zip(texts, scanned(spark, texts)):
        want = plain(text)
        assert (base, labels) == want[:2], text
        assert abs(score - want[2]) < 1e-12, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.sampled_from("abc"), st.sampled_from([30, 50, 90])), max_size=14))
def test_suppression_by_brute_force(drawn):
    found = [(a, a + n, label, p) for a, n, label, p in drawn]
    kept = []
    for f in sorted(found, key=lambda f: (-f[3], f[0], -f[1])):
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    assert licenses._uncontained(found) == sorted(kept)


def test_clean_prose_has_no_label():
    text = "The committee will permit a public reading; a common language, open doors and a free evening are for all of us. " * 200
    assert SCANNER.scan(text.encode())[2] == []

import pathlib
import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinflow.llm import bpe, mixing, queries, store

from .conftest import SF
from .test_neighbours import groups_of, plain_fingerprint
from .test_text_operators import brute_lines


def test_stages_keep_columns(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns, name
        assert after.schema.simpleString() == documents.schema.simpleString(), name
        assert 0 < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_run_is_the_stages(spark, documents):
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert got == {r["doc_id"]: r["n_tokens"] for r in bpe.bpe_digests(docs, queries.VOCABULARY).collect()}


def test_run_leaves_one_table(spark):
    """Of all that the stages write, the last stage's input alone is still there."""
    folder = pathlib.Path(store.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, SF)
    assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == ["stage-mixing"]
    assert out.count() > 0


def test_stages_equal_brute_force(spark, documents):
    """Each stage after the classifier against plain code or SQL, over what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = store.settle(stages["quality"](spark, documents, SF), "brute")
    deduped = store.settle(stages["line_dedup"](spark, docs, SF), "brute")
    assert rows(deduped) == brute_lines([*rows(docs).items()])
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())
    chosen = store.settle(stages["simhash"](spark, deduped, SF), "brute")
    texts = rows(deduped)
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    group = groups_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert rows(chosen) == {d: t for d, t in texts.items() if group[d] == d}
    mixed = store.settle(stages["mixing"](spark, chosen, SF), "brute")
    db = duckdb.connect()
    db.register("documents", chosen.toPandas())
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r[0] for r in db.execute(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall())
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {*texts.items()}
    library = Tokenizer.from_file(queries.VOCABULARY)
    got = sorted((r["doc_id"], r["ids"], r["n_tokens"]) for r in stages["bpe"](spark, mixed, SF).collect())
    ids = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed.collect()]
    assert got == sorted((d, i, len(i)) for d, i in ids)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_documents(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd, SF).count() > 0
    assert stage(spark, empty, SF).count() == 0


def working_names():
    """Every name with an underscore in front that the operators' modules write."""
    folder = pathlib.Path(bpe.__file__).parent
    return sorted({n for f in folder.glob("*.py") for n in re.findall(r'"(_[a-z][a-z_0-9]*)"', f.read_text())})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_names_of_working_columns_pass(spark, documents, name):
    """Columns named like the operators' own come back unchanged, and change nothing."""
    names = working_names()
    assert {"_n", "_row", "_limit", "_d", "_h", "_near", "_row_key", "_drop", "_mix_place", "_own_key", "_sh_row", "_bpe_text"} <= set(names)
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents.where("doc_id < 120")
    clashing = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    plain, found = stage(spark, docs, SF), stage(spark, clashing, SF)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert sorted(tuple(r[c] for c in docs.columns) for r in rows) == sorted(map(tuple, plain.collect()))


def test_names_of_working_columns_pass_the_encoder(spark, documents):
    names = working_names()
    docs = documents.limit(5).withColumns({n: F.lit(n) for n in names})
    found = bpe.bpe_encode(docs, queries.VOCABULARY)
    assert found.columns == [*docs.columns, "ids"]
    assert all(r[n] == n for r in found.collect() for n in names)

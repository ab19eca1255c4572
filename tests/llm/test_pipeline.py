"""The corpus pipeline against a plain version, and the queries' contracts."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from palimpsest.llm import common as C
from palimpsest.llm import quality, queries, token_store

from ..oracle import connect, same_rows
from .test_dedup import jaccard_brute, prose


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def test_stages(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = raw, []
    for name, stage in P.STAGES:
        docs = C.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.append(docs)
        if name != P.STAGES[-1][0]:
            assert docs.schema == raw.schema, name
    rows = {r.doc_id: r.text for r in raw.collect()}
    # each stage from its own input, by plain means
    model = quality.learn(quality.with_statistics(raw, ["doc_id"]), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(quality.with_statistics(raw, ["doc_id"]), model).collect() if r.score >= 0.3}
    assert {r.doc_id for r in kept[0].collect()} == good
    last = {}
    for i in sorted(good):
        last[rows[i]] = i
    distinct = set(last.values())
    assert {r.doc_id for r in kept[1].collect()} == distinct
    near = jaccard_brute([(i, rows[i]) for i in distinct])
    first = {i for i in distinct if near[i][1] == i}
    assert {r.doc_id for r in kept[2].collect()} == first
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = {i for i in first if any(t in rows[i] for t in items)}
    clean = {r.doc_id for r in kept[3].collect()}
    assert clean <= first and not clean & exact and len(first - clean - exact) <= 2
    packed = {}
    for r in kept[4].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    tk = Tokenizer.from_file(token_store.default_tokenizer())
    assert packed == {i: len(tk.encode(rows[i], add_special_tokens=False).ids) + 1 for i in clean}


NAMES = ("n", "h", "part", "blob", "row", "key", "comp", "grams", "score", "x", "label", "_null", "ids", "shard", "text_", "a.b")


def tables(spark, folder, documents, labels=(), items=()):
    """A folder of the pipeline's inputs, with columns of clashing names beside the documents'."""
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in NAMES})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_empty_tables(spark, tmp_path):
    assert P.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_run_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    long = "several plain words that go on " * 300_000
    item = "which of these many words is the one that nobody could have written before today. the answer is certainly this."
    rows = [(k, prose(rng, 80, 900)) for k in range(60)] + [(None, prose(rng, 40, 900)), (None, None), (100, None), (101, ""), (102, long), (103, long + "x")]
    rows += [(200, rows[0][1]), (201, rows[1][1] + " tail"), (300, f"{prose(rng, 50, 900)} {item.upper()}"), (400, rows[5][1]), (400, rows[5][1])]
    docs = [(i, t, None if k % 3 else "en", "hot", len(t or "")) for k, (i, t) in enumerate(rows)]
    folder = tables(spark, tmp_path, docs, items=[(1, item), (2, None)])
    kept, d = [], C.documents(spark, folder)
    schema = d.schema
    for name, stage in P.STAGES[:-1]:
        d = C.materialise(stage(spark, d, folder), name.replace(" ", "-"))
        assert d.schema == schema and all(r["a.b"] == "a.b" and r["_null"] == "_null" for r in d.select("`a.b`", "_null").collect())
        kept.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in d.select("doc_id").collect()))
    plain = [-1 if i is None else i for i, _ in rows]
    assert kept[0] == sorted(plain)  # no labels: nothing is rejected
    # of equal texts the largest id: 0 and 200; 5, 400, 400; the null texts and the empty one
    assert kept[1] == sorted(set(range(1, 60)) - {5} | {-1, 101, 102, 103, 200, 201, 300, 400})
    assert kept[2] == sorted(set(kept[1]) - {201, 103})
    assert kept[3] == sorted(set(kept[2]) - {300})
    packed = P.run(spark, folder).collect()
    assert {(-1 if r.doc_id is None else r.doc_id) for r in packed} == set(kept[3]) and all(len(r.ids) == 2 * r.n_tokens for r in packed)

"""The pipeline beside a brute-force version, and its stages on odd inputs."""

import random

import pytest

import corpus_pipeline
from factloom.llm import secrets

from .test_operators import ODD, WORDS, classes, contamination, edited, own_encoding, prose, shingle_sets

RNG = random.Random(11)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    item = prose(30, RNG)
    base = prose(90, RNG)
    texts = [*ODD, *(prose(RNG.randint(30, 120), RNG) for _ in range(30)), *(edited(base, k % 3, RNG) for k in range(8)), item + " " + prose(40, RNG), prose(20, RNG) + " password: abcdef12 " + prose(20, RNG)]
    rows = [(i, t, "xx" if i % 9 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(texts)), item


def test_run_equals_brute_force(spark, folder):
    path, texts, item = folder
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.language(spark, docs, path).collect()}
    letters = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert set(kept) <= letters and set(range(len(ODD), len(texts))) <= set(kept)
    ids = sorted(kept)
    root = classes(shingle_sets([kept[i] for i in ids]))
    kept = {ids[k]: kept[ids[k]] for k in range(len(ids)) if root[k] == k}
    bad = {i for i, r in contamination(kept.items(), [(0, item)]).items() if r[3]}
    assert len(bad) == 1
    enc = own_encoding()
    want = {}
    for i, t in kept.items():
        if i not in bad:
            spans = secrets.scan(t)
            for _, a, b in reversed(spans):
                t = t[:a] + "[SECRET]" + t[b:]
            want[i] = enc.encode_ordinary(t)
    assert {i: r["ids"] for i, r in out.items()} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), path)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(docs.columns)


def test_rows_are_decided_by_id_and_text(spark, folder):
    path, _, item = folder
    rng = random.Random(23)
    text, other, bad = (" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(3))
    rows = [(None, text), (3, text), (3, text), (4, text), (3, other), (None, other + " end"), (7, bad), (7, item), (None, item), (None, None), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = corpus_pipeline.one_of_each(spark, docs, path)
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(3, text), (3, other), (7, bad), (7, item), (None, None), (None, None), (5, ""), (5, "")], key=str)
    clean = corpus_pipeline.decontaminated(spark, docs, path).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted((r for r in rows if r[1] != item), key=str)

"""The corpus pipeline on a small dataset, stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(2000)]
    text = lambda n: " ".join(str(w) for w in rng.choice(words, n)) + "."
    rows = [(i, text(int(rng.integers(30, 90))), "en", f"s{i % 3}", 0) for i in range(120)]
    for i in range(0, 120, 4):
        rows[i] = (i, rows[i][1] + " zzvile qqnasty zzvile qqnasty.", "en", rows[i][3], 0)
    rows += [(200 + i, rows[1][1], "en", "s1", 0) for i in range(3)]
    passage = text(60)
    rows += [(300 + i, f"{text(30)} {passage} {text(30)}", "en", "s2", 0) for i in range(3)]
    rows += [(None, "a row without id", None, None, 0), (400, None, None, None, None), (401, "", "en", "s0", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: [r.doc_id for r in rows] for name, rows in left.items()}
    assert sum(i is not None and i < 120 and i % 4 == 0 for i in ids["toxicity"]) <= 2
    assert sum(i is not None and i < 120 and i % 4 != 0 for i in ids["toxicity"]) >= 88
    assert sum(i in (1, 200, 201, 202) for i in ids["near_dedup"]) == 1 and len(set(ids["near_dedup"])) == len(ids["near_dedup"])
    cut = {r.doc_id: r for r in left["substring_dedup"]}
    assert all(len(cut[i].text.split()) == 60 and cut[i].n_chars == len(cut[i].text) for i in (300, 301, 302))
    assert len(left["substring_dedup"]) == len(left["near_dedup"])
    words = sum(len((r.text or "").split()) for r in left["substring_dedup"])
    assert words - 6 <= sum(len((r.text or "").split()) for r in left["mixing"]) <= words
    assert {r.doc_id for r in left["packing"]} == set(ids["mixing"])


def test_repeated_and_missing_ids(spark):
    """Other texts under one id stay; copies without id go as others do."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(7, a), (7, b), (7, b), (9, a), (None, c), (None, c), (None, b), (8, d), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {(7, a), (7, b), (None, c), (8, d), (None, None), (5, None)}
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(got) == len(want) and set(got) == want
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    whole = {(i, t) for i, t in rows if t}
    assert len({(r.doc_id, r.text) for r in mixed} & whole) >= len(whole) - 1 and all(any(r.doc_id == i and t.startswith(r.text) for i, t in whole) for r in mixed)


def test_empty_tables_and_clashing_columns(spark, sf_dir):
    """No rows stay no rows; columns with names that stages use inside change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("rid", "order", "key", "taken", "size", "component_id", "kept_text", "marks", "piece", "range"):
        docs = docs.withColumn(name, F.lit(7))
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), sf_dir).count() == 0, name
    some = docs.where("doc_id >= 200 OR doc_id IS NULL")
    cut = corpus_pipeline.cut_repeats(spark, some, sf_dir)
    assert cut.columns == list(corpus_pipeline.COLUMNS) and cut.count() == some.count()
    mixed = corpus_pipeline.mix_sources(spark, some, sf_dir)
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and mixed.count() > 0

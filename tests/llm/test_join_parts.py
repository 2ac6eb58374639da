"""The reducers of the n-gram join tell a pair once in each part of the key space: parts follow the data, not the session."""

import pytest

from cadenza.llm import ngram_join as join
from tests.llm.test_copies import classes
from tests.llm.test_join_group import near_group


@pytest.mark.parametrize("shuffles", [3, 20])
def test_rows_of_reducers_do_not_follow_the_shuffles(spark, make_docs, monkeypatch, shuffles):
    rows = near_group(100)
    made = []
    real = join._stars

    def counted(*how):
        out = real(*how).cache()
        made.append((out.count(), out.select("p1", "p2", "d1", "d2").distinct().count()))
        return out

    monkeypatch.setattr(join, "_stars", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        got = join.ngram_join(make_docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, sizes = classes(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], want[i]) for i, *_ in rows}
    assert made[0][0] == made[0][1] >= 99


def test_bands_of_blocks_have_no_neighbourhoods(make_docs, monkeypatch):
    rows = near_group(150)
    made = {}
    real = join.stage

    def staged(df, name, *how):
        made[name] = out = real(df, name, *how)
        if name in ("short", "neighbourhoods"):
            made[name] = out.collect()
        return out

    monkeypatch.setattr(join, "stage", staged)
    got = join.ngram_join(make_docs(rows), bucket_pairs=100).collect()
    want, sizes = classes(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], want[i]) for i, *_ in rows}
    blocked = {r.band for r in made["short"] if r.rest}
    assert {r.band for r in made["short"] if not r.rest} & blocked
    assert not {r.key & 63 for r in made["neighbourhoods"]} & blocked

"""The pipeline on planted cases, stage by stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cashlens.llm import bpe
from cashlens.llm.common import vocabulary

COMMON = "the of and river stone light water under old houses walk green fall rain".split()


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(8)
    text = lambda n=60: " ".join(rng.choice(COMMON) + rng.choice(["", "", "s", "ed", str(rng.randrange(30))]) for _ in range(n))
    leak = " ".join(f"bench{i}" for i in range(15))
    rows, labels, kinds = [], [], {}
    for i in range(240):
        body = text()
        if i % 4 == 0:
            words = body.split()
            words[i % 50] = rng.choice(["snarkel", "grumpfl"])
            body, kinds[i] = " ".join(words), "toxic"
        rows.append((i, body, "en", len(body)))
        labels.append((i, int(i % 4 == 0)))
    clean = {i: t for i, t, *_ in rows if i % 4}
    for i, body, kind in (
        (300, clean[1], "copy"),
        (301, clean[2].replace(clean[2].split()[30], "changed", 1), "copy"),
        (302, f"{text(20)} {leak} {text(20)}", "leak"),
        (303, leak, "only leak"),
        (304, f"{text(20)} token = '0123456789abcdef01234567' {text(20)}", "secret"),
        (305, "", "empty"),
    ):
        rows.append((i, body, "en", len(body)))
        kinds[i] = kind
    rows.append((306, None, "en", 0))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, kinds


def test_stages(spark, world, tmp_path):
    folder, texts, kinds = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns and result.schema == docs.schema, name
        result.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(out["toxicity"]) == {i for i in texts if kinds.get(i) != "toxic"}
    assert set(out["jaccard_join"]) == {i for i in out["toxicity"] if kinds.get(i) != "copy"}
    assert set(out["decontaminate"]) == set(out["jaccard_join"]) - {303}
    assert "bench" not in out["decontaminate"][302]["text"]
    changed = {i for i, r in out["secrets"].items() if (r["text"] or "") != (texts[i] or "")}
    assert changed == {302, 304}
    assert "0123456789abcdef" not in out["secrets"][304]["text"] and "[secret]" in out["secrets"][304]["text"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in out["secrets"].values())
    import json

    encoder = bpe.Encoder(json.load(open(vocabulary())))
    for i, r in out["bpe"].items():
        assert r["ids"] == [x for f in encoder.encode(out["secrets"][i]["text"] or "") for x in f[3]]


def test_run_equals_the_stages(spark, world):
    folder, texts, kinds = world
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {i for i in texts if kinds.get(i) not in ("toxic", "copy", "only leak")}
    assert got.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark, tmp_path):
    """Rows equal in id and shingles are one, the first by text; other rows of a kept id are no copies."""
    rng = random.Random(9)
    one, two, three = (" ".join(rng.choice(COMMON) + str(rng.randrange(99)) for _ in range(40)) for _ in range(3))
    rows = [(1, one, "en"), (1, two, "en"), (1, two.upper(), "en"), (1, two, "de"), (1, None, "en"), (2, three, "en"), (3, three, "en"), (None, one, "en"), (None, one, "en")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string").repartition(3)
        got = corpus_pipeline.jaccard_stage(spark, docs, str(tmp_path))
        assert got.schema == docs.schema
        want = [(1, None, "en"), (1, one, "en"), (1, min(two, two.upper()), "en"), (2, three, "en"), (None, one, "en"), (None, one, "en")]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

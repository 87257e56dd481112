import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa

import corpus_pipeline
from colloquy.functions import materialize
from colloquy.llm import packing, quality
from colloquy.llm.common import utf8


def tables(spark, folder):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(400):
        junk = i % 5 == 0
        text = sentence(rng.randint(30, 120))
        rows.append((i, " ".join(f"{w}!!" for w in text.upper().split()) if junk else text, "en", f"s{i % 3}", 0))
        labels.append((i, int(not junk), 0))
    items = [(k, sentence(25)[:-1]) for k in range(4)]
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[1][1], "en", "s", 0), (1002, sentence(30) + " " + items[0][1] + " " + sentence(20), "en", "s", 0)]
    rows += [(1003, sentence(40) + " write to tom@example.com or 63.161.90.218 " + sentence(20), "en", "s", 0), (1004, None, None, None, None)]
    spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_take_effect(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ordinary = {i for i in range(400) if i % 5}
    assert len(ordinary - set(kept["quality"])) <= 2 and len(set(range(0, 400, 5)) & set(kept["quality"])) <= 2
    assert {1000, 1001} <= set(kept["quality"]) and not {1000, 1001} & set(kept["near_duplicates"]) and 1 in kept["near_duplicates"]
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1002}
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert "tom@" not in kept["pii"][1003] and "[EMAIL] or [IP]" in kept["pii"][1003]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(kept["pii"])
    encode = packing.encoder(packing._ranks_path()).encode
    for r in pieces:
        if r.doc_id == 1003:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*encode(kept["pii"][1003]), 2]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == len(pieces)


def test_statistics_of_nothing():
    assert np.isfinite(quality.measured(*utf8(pa.array([None, ""], pa.string())))).all()


def test_stages_over_nothing_nulls_and_clashing_names(spark, tmp_path):
    rows, _ = tables(spark, tmp_path)
    nulls = [(None, None, None, None, None), (5, None, None, None, None), (None, "null id " * 30, "en", "s", 1), (6, "", "en", "s", 0), (6, "x" * 100_000, "en", "s", 1)]
    names = ["_row", "_spans", "_gone", "_quality", "_statistics", "_key", "root", "kind", "length", "_first"]
    docs = spark.createDataFrame(nulls, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"1 as {n}" for n in names))
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= given.count(), name
        packed = corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path))
        assert packed.select("doc_id", "text" if "text" in packed.columns else "piece").distinct().count() >= (given.count() > 0)


def test_run_keeps_no_tables_but_the_last_stage_s(spark, tmp_path):
    tables(spark, tmp_path)
    folder = Path(urlparse(materialize._tables(spark)).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "stage-pii" in left and not left & {"stage-quality", "stage-near_duplicates", "stage-decontamination", "near-duplicates", "spans"}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(rows) == key(docs)

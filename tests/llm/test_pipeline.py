"""The pipeline's stages, each against brute force on what the one before it kept."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from foliant.llm import queries
from foliant.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_quality_stage(spark, steps):
    kept = {r.doc_id for r in steps[0].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels]
    assert np.mean(right) > 0.9 and all(r.doc_id in kept for r in labels if r.quality == 1)


def test_dedup_stage(spark, steps):
    groups = near_duplicates(steps[0]).collect()
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted({r.component_id for r in groups})


def test_decontamination_stage(spark, steps):
    same = lambda x: " ".join(x.lower().split())
    items = [same(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in steps[1].collect() if not any(i in same(r.text) for i in items)}
    assert {r.doc_id for r in steps[2].collect()} == want


def test_mixing_stage(spark, steps, tmp_path):
    steps[2].write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    taken = dict(con.execute(f"select doc_id, taken from ({queries.ORACLE['op7_mix_sources']}) where taken > 0").fetchall())
    got: dict = {}
    for r in steps[3].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == taken


def test_token_stage(spark, steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((r.doc_id, crc(r.text)) for r in steps[3].collect()) == sorted((r.doc_id, r.ids_crc32) for r in steps[4].collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)[:3]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_unusual_rows_in_sequence(spark, tmp_path):
    from ._rows import table, texts

    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no text holds this passage of some length"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (texts(), []):
        docs = table(spark, rows)
        for name, stage in pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}-{len(rows)}"))
            before, docs = docs, spark.read.parquet(str(tmp_path / f"{name}-{len(rows)}"))
            if name != "tokens":
                assert docs.columns == before.columns
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (docs.count() > 0) == bool(rows)

import os

import pytest

import corpus_pipeline
from attesta import llm

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    again = corpus_pipeline.run(spark, DATA)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert key(again) == key(docs)
    fill = docs.groupBy("sequence_id").sum("length")
    assert fill.where("`sum(length)` > 2048").count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 11)) and set(llm.ORACLE_SQL) <= set(llm.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = llm.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = c.execute(llm.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[x] for x in columns]) for r in df.collect()) == sorted(repr([r[names.index(x)] for x in columns]) for r in found.fetchall())

import corpus_pipeline
import pytest
from lettermill.llm import decontam, minhash, quality, toxicity
from lettermill.llm.queries import ORACLE_SQL, QUERIES

from .data import documents
from .test_models import corpus

DATA = "/root/testdata/sf0.001"


def test_stages_are_their_operators(spark):
    """Each stage's rows, against the operator's own report on the same input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = corpus_pipeline.materialize(stage(spark, docs, DATA), "stage")
        if k == 0:
            expected = ids(quality.classify(docs, labels).where("predicted = 1"))
        elif k == 1:
            expected = ids(toxicity.classify(docs, labels).where("predicted = 0"))
        elif k == 2:
            expected = ids(minhash.near_duplicates(docs).where("kept"))
        elif k == 3:
            expected = ids(decontam.report(docs, bench).where("not contaminated"))
        else:
            expected = ids(docs)
            assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert ids(got) == expected
        assert k == 4 or got.columns == docs.columns
        docs = got
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(docs)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    plain = lambda v: v if v is None or isinstance(v, str | bool) else f"{v:.6f}"
    key = lambda rows: sorted(str(tuple(map(plain, r))) for r in rows)
    assert key(QUERIES[name](spark, DATA).select(*columns).collect()) == key(expected.fetchall())


def test_every_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in QUERIES if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing columns pass all stages; so does an empty table."""
    rows, labels = corpus(200)
    rows = [*rows, (3, rows[3][1], rows[3][2]), (900, " \t", None), (901, None, "s0"), (901, None, "s0")]
    documents(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    documents(spark, rows).limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    bench = spark.createDataFrame([(1, rows[5][1], 2), (None, None, 2)], "item_id long, text string, doc_id int")
    for d in "ab":
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, docs, f"{tmp_path}/a"), "stage")
        assert kept.columns == docs.columns
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0

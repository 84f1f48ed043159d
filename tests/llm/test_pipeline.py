import pytest
from pyspark.sql import functions as F


def test_stages_and_run(spark, docs, rows, tmp_path):
    import corpus_pipeline as C

    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    out = C.run(spark, folder)
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_toxicity_stage_keeps_a_score_column(spark, docs, tmp_path):
    import corpus_pipeline as C

    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    plain = {tuple(r) for r in C.without_toxic(spark, docs, folder).select("doc_id", "text").collect()}
    named = C.without_toxic(spark, docs.withColumn("Score", F.lit("x")), folder)
    assert named.columns == [*docs.columns, "Score"] and {(r["doc_id"], r["text"]) for r in named.collect()} == plain
    assert {r["Score"] for r in named.collect()} <= {"x"}


def test_entry_has_all():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    with pytest.raises(KeyError):
        names["op14_"]

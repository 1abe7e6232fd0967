import corpus_pipeline
from souklens.llm import queries


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs.count(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
            seen.append(made.count())
        docs = made
    assert before > seen[0] > seen[1] >= seen[2] == seen[3] > 0
    assert docs.select("doc_id").distinct().count() == seen[-1]


def test_run_equals_the_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    total = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, total)) == sorted(map(tuple, docs.groupBy("doc_id").sum("length").collect()))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

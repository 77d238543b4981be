"""The pipeline's stages one after another, each on what the one before has kept."""


def test_run(spark, sf_dir):
    import corpus_pipeline as pipeline
    from chalkline.llm import decontaminate, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = docs.cache()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())

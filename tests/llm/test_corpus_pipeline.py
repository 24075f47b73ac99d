"""The pipeline's stages one by one on the smallest tables."""

import corpus_pipeline
from topicloom.llm import registry


def test_names():
    assert [n.split("_")[0] for n in registry.QUERIES if n.startswith("op")] and len({n.split("_")[0] for n in registry.QUERIES}) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "sentencepiece"]


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    assert sizes[1] > 0.97 * sizes[0]
    assert docs.where("NOT decodes").count() == 0 and docs.where("n_tokens = 0").count() == 0


def test_pipeline_on_no_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0

"""The stages one by one, each on what the one before it left."""

import corpus_pipeline
import __spark_entry__ as entry


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "mix", "pack"]
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf).cache()
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids and left
        ids = left
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert {d for r in packed for d in r["doc_ids"]} == ids


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_decontamination_stage_fits_on_all_rows(spark, sf, monkeypatch):
    """The products of the SVD run over every row of the stage, whatever its id."""
    import corpus_pipeline
    from graphloom.llm import decontam

    seen, plain = [], decontam.gram_products

    def products(rows, *rest):
        seen.append(rows.count())
        return plain(rows, *rest)

    monkeypatch.setattr(decontam, "gram_products", products)
    docs = spark.range(7000).selectExpr("IF(id % 7 = 0, NULL, id) AS doc_id", "IF(id % 5 = 0, NULL, concat('some words ', id)) AS text")
    assert corpus_pipeline.decontaminate_stage(spark, docs, sf).count() == 7000
    assert seen == [7000, 7000]

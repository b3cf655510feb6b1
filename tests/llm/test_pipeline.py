"""The stages in order, on a small table with planted cases."""

import corpus_pipeline


def test_stages(spark, rows, tables, tmp_path):
    item = " ".join(rows[10][1].split()[:30])
    documents = spark.createDataFrame(
        [(r[0], r[1], "en", r[2], len(r[1] or "")) for r in rows] + [(5000, "start " + item + " end", "en", "s", 9)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = tables(documents, benchmark=bench, labels=labels)
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns, name
        if name == "simhash near-dedup":
            ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
        if name == "benchmark decontamination":
            assert not {10, 5000} & {r.doc_id for r in docs.collect()}
        if name == "pii":
            assert docs.where("text like '%boss@corp%'").count() == 0
            assert docs.where("text is not null and n_chars <> length(text)").count() == 0
    assert counts[0] == documents.count() > counts[1] > counts[2] == counts[3]
    assert corpus_pipeline.run(spark, folder).count() == counts[4]

"""The pipeline's stages, one after the other, and the registry."""

import corpus_pipeline
from affinis.llm import packing, quality, rules, simhash
from affinis.llm.common import written


def test_stages_on_odd_documents(spark, odd_documents, no_documents, tmp_path, odd_labels, no_labels):
    for docs, labels, sf in ((odd_documents, odd_labels, "odd"), (no_documents, no_labels, "none")):
        folder = f"{tmp_path}/{sf}"
        labels.write.parquet(f"{folder}/labels.parquet")
        before = docs
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, before, folder), name)
            n = after.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
            if name in ("quality_rules", "quality_classifier", "near_duplicates"):
                assert n <= before.count()
            assert n > 0 or sf == "none"
            before = after


def test_run_against_its_parts(spark, tiny):
    """Each stage keeps exactly what its operator's own decision keeps."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    kept = {r["doc_id"] for r in rules.verdicts(docs, labels).where("kept").collect()}
    first = written(rules.keep_good(docs, labels), "t")
    assert {r["doc_id"] for r in first.collect()} == kept
    good = {r["doc_id"] for r in quality.score(first, labels).where("predicted = 1").collect()}
    second = written(quality.keep_good(first, labels), "t")
    assert {r["doc_id"] for r in second.collect()} == good
    third = written(simhash.keep_one(second), "t")
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({r["component_id"] for r in simhash.classes(second).collect()})
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "offset", "length"}
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in third.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mix_sources", "pack_windows"]
    assert packing.WINDOW == 2048


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_oracles_agree(spark, tiny):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            ours = entry.queries()[name](spark, tiny)
            columns = sorted(ours.columns)
            theirs = con.sql(sql).df()
            assert sorted(theirs.columns) == columns
            assert sorted(map(tuple, ours.select(columns).toPandas().astype(str).values.tolist())) == sorted(map(tuple, theirs[columns].astype(str).values.tolist())), name

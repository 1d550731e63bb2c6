import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(ids)


EXTRA = ("score", "key_", "row_", "__text", "__row", "__marked")


def test_stages_on_edge_rows(spark, edge_rows, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, edge_rows[10][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(i, t, None, x, None if t is None else len(t), *[x] * len(EXTRA)) for i, t, x in edge_rows]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = sorted((repr(r["doc_id"]), repr(r["text"])) for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    given = sorted((repr(i), repr(t)) for i, t, _ in edge_rows)
    assert set(kept["quality classifier"]) <= set(given)
    base = repr(edge_rows[0][1])
    assert [i for i, t in kept["near duplicates"] if t == base] == ["1"]
    assert {i for i, _ in given} - {i for i, _ in kept["near duplicates"]} == {"2"}
    assert kept["benchmark decontamination"] == [x for x in given if x[0] != "8"]
    assert kept["personal data"] == given
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(given)

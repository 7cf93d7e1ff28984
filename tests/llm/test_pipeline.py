import pytest

import corpus_pipeline
from tests.llm.conftest import ODD
from tidewatch.llm.decontaminate import brute_force


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    base = "the plain words of one language with a number of more words in it and some %d others to be told apart by a reader"
    rows = ODD + [(i, "item %d: " % i + base % i + " q%d r%d" % (i, i * 7)) for i in range(20, 60)]
    rows += [(100, rows[12][1]), (101, "before. A test item of some length that must not leak. after and more"), (102, "write to jo.doe@mail.org today, it is urgent")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a test  item of some length that must not leak.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        if name != "tokens":
            assert docs.columns == columns
        if name == "language":
            assert not ids & {1, 2, 3, 4} and {5, 100, 101, 102, None} <= ids
        if name == "near_duplicates":
            assert 100 not in ids and 21 in ids
        if name == "decontamination":
            assert set(before) - ids == {i for i, _, _ in brute_force(list(before.items()), [(1, "a test item of some length that must not leak.")])} == {101}
        if name == "personal_data":
            text = {r.doc_id: r.text for r in rows}
            assert text[102] == "write to [EMAIL] today, it is urgent" and set(text) == set(before)
        if name == "tokens":
            assert all(r.exact and r.n_tokens == len(r.ids) for r in rows) and ids == set(before)
    assert corpus_pipeline.run(spark, folder).count() == len(ids) + sum(r.doc_id == 9 for r in rows) - (9 in ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]

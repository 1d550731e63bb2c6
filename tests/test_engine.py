import pytest

from tarnsearch.api import Engine, as_json, simple_search
from tarnsearch.streaming import ingest


def test_engine_from_ingestion_to_answers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("red fox jumps over lazy dog")
    (folder / "b.txt").write_text("blue whale sings")
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.add_source(str(folder)) == {"new": 2}
    version = engine.version
    assert engine.add_source(str(folder)) == {"unchanged": 2}
    assert engine.version == version
    (folder / "b.txt").write_text("blue whale dives")
    (folder / "a.txt").unlink()
    assert engine.add_source(str(folder)) == {"changed": 1, "missing": 1}
    engine.add_text("a red text about a fox")
    again = Engine(spark, str(tmp_path / "store"))
    assert {(r["name"], r["type"], r["chunk_count"]) for r in again.sources().collect() if r["type"] == "file"} == {("b.txt", "file", 1)}
    for mode in ("hybrid", "keyword", "semantic", "other"):
        assert again.search("whale dives", 2, mode).first()["file_name"] == "b.txt"
    assert again.search("fox", 1).count() == 1 and as_json(again.search("fox", 1)).count() == 1
    assert "Question: whale?" in again.answer("whale?", lambda system, prompt: prompt)
    whale = next(r["doc_id"] for r in again.sources().collect() if r["name"] == "b.txt")
    assert again.content(whale).first()["text"] == "blue whale dives"
    assert again.reembed(whale) and not again.reembed(999)
    assert again.delete(whale) and not again.delete(whale)
    assert again.search("whale", 1).collect() == []
    with pytest.raises(ValueError):
        again.search(" ")
    again.clear()
    assert Engine(spark, str(tmp_path / "store")).sources().collect() == []


def test_one_shot_search(spark):
    assert simple_search(spark, ["green tea tastes fine", "black coffee"], "coffee", 1).first()["chunk_text"] == ["black coffee"]


def test_streaming_ingestion(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("streams carry words")
    engine = Engine(spark, str(tmp_path / "store"))
    ingest.start(engine, str(folder), str(tmp_path / "check"), once=True).awaitTermination()
    (folder / "b.md").write_text("more words")
    ingest.start(engine, str(folder), str(tmp_path / "check"), once=True).awaitTermination()
    assert {r["name"] for r in engine.sources().collect()} == {"a.txt", "b.md"}


def test_versions_stay_for_a_while_and_crashes_leave_the_last(spark, tmp_path):
    store = tmp_path / "store"
    engine = Engine(spark, str(store))
    engine.add_text("red fox")
    before, first = engine.search("fox", 1, "keyword"), engine.version
    engine.add_text("blue whale")
    assert before.first()["doc_id"] is not None
    (store / "v-000000000003-crashed").mkdir()
    assert Engine(spark, str(store)).version == engine.version
    other = Engine(spark, str(store))
    other.add_text("green tea")
    with pytest.raises(RuntimeError, match="another process"):
        engine.add_text("black coffee")
    other.add_text("white milk")
    assert not (store / first).exists()
    assert Engine(spark, str(store)).sources().count() == 4

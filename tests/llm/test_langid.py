import random

from tarnsearch.llm import langid


def _rows():
    rng = random.Random(1)
    kinds = {"aa": "ka ti mo re la su".split(), "bb": "schr pfl ung heit ver der".split(), "cc": "tion eau oux eux que les".split()}
    return [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randint(20, 200))), k) for i in range(300) for k in [rng.choice(list(kinds))]]


def test_held_out_accuracy_and_edges(spark, edge, none):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identified(docs).collect()
    assert len(got) == len(rows)
    truth = {i: k for i, _, k in rows}
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    content = langid.fit(docs)
    found = langid.predict(edge, content).collect()
    assert len(found) == edge.count()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in found if r["doc_id"] in (3, 4, 5))
    assert langid.predict(none, content).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, {}).collect()} == {"und"}
    assert langid.fit(none.withColumnRenamed("score", "lang")) == {}


def test_long_texts_and_many_languages_are_learned(spark):
    """A language of long texts only, one of a single letter, and 300 more."""
    rng = random.Random(6)
    rows = [(i, t, k) for i, t, k in _rows() if k == "aa"]
    rows += [(1000 + i, " ".join("".join(rng.choice(["schr", "pfl", "ung"]) for _ in range(3)) for _ in range(4000)), "long") for i in range(8)]
    rows += [(2000, "q", "one")] + [(3000 + i, f"zz{i} yy{i} xx{i}", f"l{i}") for i in range(300)]
    content = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(content) == {k for _, _, k in rows} and all(len(x) >= 8 for x in content.values())
    held = spark.createDataFrame([(1, "schrpflung ungpflpfl pflschrung schrungung")], "doc_id long, text string")
    assert langid.predict(held, content).first()["lang_pred"] == "long"

import pytest
from pyspark.sql import functions as F

from tarnsearch.functions import text as tx

CASES = [
    ("", []),
    ("the and of", []),
    ("a bb " + "c" * 50 + " " + "d" * 51, ["bb", "c" * 50]),
    ("I'm gonna go, don't", ["going to", "go", "don"]),
    ("pi is 3.14 or a_b costs $5", ["pi", "14", "costs", "$5"]),
    ("Tab\tLine\nEND", ["tab", "line", "end"]),
]


def test_tokens_agree_with_cases_and_with_the_driver_form(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", tx.tokens(F.col("t")).alias("x")).collect()}
    assert got[99] == []
    for i, (text, expected) in enumerate(CASES):
        assert got[i] == expected == tx.tokens_of(text)


def test_numbers_can_be_left_out(spark):
    options = tx.TokenOptions(remove_numbers=True)
    row = spark.createDataFrame([("42 forty2 7",)], "t string").select(tx.tokens(F.col("t"), options).alias("x")).first()
    assert row["x"] == ["forty2"] == tx.tokens_of("42 forty2 7", options)


def model_chunks(text: str) -> list[str]:
    """The chunk rule, step by step."""
    rest, out = " ".join(text.split()), []
    while rest:
        window = rest[:256]
        cut = len(window)
        if len(window) >= 120:
            ends = [i + 1 for i, c in enumerate(window) if c in ".!?" and i + 1 >= 121]
            cut = ends[-1] if ends else cut
        out.append(window[:cut])
        rest = rest[cut:]
    return out


@pytest.mark.parametrize("text", ["", "x", "a" * 119, "a" * 120, "a" * 121, "a" * 256, "a" * 257, "a" * 119 + "." + "b" * 300, "a" * 120 + "." + "b" * 300, ("word. " * 300), "\U0001f600" * 300, "no end " * 100])
def test_chunks_agree_with_the_rule_and_add_up(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tx.chunks(F.col("t")).alias("c"), tx.normal_text(F.col("t")).alias("n")).first()
    assert got["c"] == model_chunks(text)
    assert "".join(got["c"]) == got["n"]


def test_small_helpers(spark):
    row = spark.createDataFrame([("https://a.b/c?d=é__1", b"ok \xff")], "u string, b binary")
    got = row.select(tx.safe_name(F.col("u")).alias("n"), tx.decoded(F.col("b")).alias("d"), tx.base_name(F.lit("/x/y.txt")).alias("f"), tx.snippet(F.lit("z" * 201)).alias("s")).first()
    assert got["n"] == "https_a_b_c_d_é_1" and got["d"] == "ok �" and got["f"] == "y.txt" and got["s"] == "z" * 200 + "..."

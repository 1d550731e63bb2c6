import math
import random
from itertools import combinations

import pyarrow as pa

from tarnsearch.llm import decontaminate as dc
from tarnsearch.llm._bytes import texts

from .conftest import prose


def _case():
    rng = random.Random(4)
    items = [(k, " ".join(prose(rng, 40).split())) for k in range(6)] + [(6, "short item of seven plain little words"), (7, None), (8, "")]
    docs, truth = [], set()
    for i in range(60):
        words = prose(rng, 200).split()
        if i % 3 == 0:
            k = rng.randrange(6)
            item = items[k][1].upper().split()
            for p in range(5, len(item), 10):
                item[p] = "changed"
            words[50:50] = [w + "," for w in item]
            truth.add((i, k))
        if i % 10 == 1:
            words[20:20] = items[6][1].split()
            truth.add((i, 6))
        docs.append((i, " ".join(words)))
    return items, docs, truth


def brute(items, docs) -> set:
    """Every alignment of every item with every document."""
    out = set()
    cut = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    for k, item in items:
        a = cut(item or "")
        for i, text in docs:
            b = cut(text)
            for shift in range(-len(a) + 1, len(b)):
                score = run = best = same = 0
                for j in range(max(0, -shift), min(len(a), len(b) - shift)):
                    equal = a[j] == b[j + shift]
                    score, run = score + (1 if equal else -dc.MISMATCH), run + equal
                    if score < 0:
                        score = run = 0
                    if score > best:
                        best, same = score, run
                if a and same >= min(dc.MIN_TOKENS, len(a)):
                    out.add((i, k))
    return out


def test_agrees_with_all_alignments_and_in_blocks(spark, monkeypatch):
    items, docs, truth = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert brute(items[:7], docs) == truth
    assert {(r["doc_id"], r["item_id"]) for r in dc.find(rows, bench).collect()} == truth
    monkeypatch.setattr(dc, "blocks", lambda b, f=dc.blocks: f(b, block_bytes=300))
    assert {(r["doc_id"], r["item_id"]) for r in dc.find(rows, bench).collect()} == truth
    left = dc.drop_overlapping(rows.withColumnRenamed("doc_id", "item_id"), bench)
    assert {r["item_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in truth}


def test_short_items_with_replaced_words_are_found():
    rng = random.Random(12)
    for n in range(1, 17):
        item = [f"item{k}" for k in range(n)]
        block = dc.Block([(1, " ".join(item))])
        for wrong in range(n + 1):
            for at in combinations(range(n), wrong) if wrong < 3 else [rng.sample(range(n), wrong) for _ in range(20)]:
                words = [f"doc{k}" for k in range(30)]
                words[9:9] = ["other" if k in at else w for k, w in enumerate(item)]
                h, _ = dc.tokens(*texts(pa.array([" ".join(words)])))
                found = block.overlaps(h)
                assert bool(found) == (n - wrong >= min(13, math.ceil(n * 4 / 5))), (n, at)
    sixteen = ["other" if k in (1, 14) else f"item{k}" for k in range(16)]
    h, _ = dc.tokens(*texts(pa.array([" ".join(sixteen)])))
    assert dc.Block([(1, " ".join(f"item{k}" for k in range(16)))]).overlaps(h) == [(0, 0, 16, 14)]


def test_edges(spark, edge, none, edge_rows):
    bench = spark.createDataFrame([(1, edge_rows[0][1]), (None, edge_rows[10][1])], "item_id long, text string")
    got = sorted(str(r["doc_id"]) for r in dc.find(edge, bench).collect())
    assert got == ["1", "2", "2", "8", "None"]
    assert dc.find(none, bench).count() == 0 and dc.find(edge, bench.limit(0)).count() == 0
    assert dc.drop_overlapping(edge, bench).count() == edge.count() - 5

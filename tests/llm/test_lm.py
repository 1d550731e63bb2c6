import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tarnsearch.llm import lm
from tarnsearch.llm._bytes import texts

from .conftest import prose


def _tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def test_scores(spark, edge_rows, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(5, 60)).capitalize()) for i in range(100, 300)] + [(i, t) for i, t, _ in edge_rows]
    monkeypatch.setattr(lm, "FREQUENT", 8)  # the rare words' join is used too
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.scored(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(_tokens(t)), sum(counts[w] > 0 for w in _tokens(t)), n) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = sorted(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in _tokens(t)) for _, t in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    kind, noise = (np.mean([r["bits_per_byte"] for r in got if cond(r["doc_id"])]) for cond in (lambda i: i and i >= 100, lambda i: i == 7))
    assert kind < noise


def _counted(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([own for _, own in rows])], ["text", "train"])
    return next(lm.occurrences(iter([batch])))


def test_occurrences():
    rows = [("the cat sat on the matter", True), ("the matting dog sat", False), ("the cat", True), ("", True), (None, False)]
    gram, n, times = _counted(rows)
    want, train = Counter(), Counter()
    for text, own in rows:
        line = b"\0" * lm.PAST + (text or "").encode() + b"\0"
        for i in range(lm.PAST, len(line)):
            past = line[i - lm.PAST : i]
            for k in range(lm.PAST + 1, lm.WORD + 1):  # farther bytes as far as they are of the same word
                if len(past) < k - 1 or set(line[i - k : i]) & {0, 32}:
                    break
                past = line[i - k : i]
            g = int.from_bytes(past + line[i : i + 1], "big")
            want[g] += 1
            train[g] += own
    assert dict(zip(gram.tolist(), times.tolist(), strict=True)) == want
    assert {g: c for g, c in zip(gram.tolist(), n.tolist(), strict=True) if c} == +train
    sums = lm.totals(gram, n, np.zeros((256, 256)))
    for k, size in ((1, 3), (2, 4), (3, 5)):
        of = lambda g: g >> 8 & (1 << 8 * size) - 1  # noqa: B023, E731
        for i, g in enumerate(gram.tolist()):
            for s in range(9):
                assert sums[k, s, i] == sum(c for x, c in train.items() if of(x) == of(g) and (x & 255) >> s == (g & 255) >> s)


def test_probabilities_of_next_bytes_add_up():
    gram, n, _ = _counted([("the cat sat on the mat", True), ("the dog sat", True)])
    every = np.concatenate([gram, gram[7] & ~np.uint64(255) | np.arange(256, dtype=np.uint64)])
    every, first = np.unique(every, return_index=True)
    of = np.where(first < len(gram), np.append(n, np.zeros(256, np.int64))[first], 0)
    one = np.bincount((gram & np.uint64(0xFFFF)).astype(int), n, 1 << 16).reshape(256, 256)
    sums = lm.totals(every, of, one)
    mixer, known = lm.Mixer.start(), of > 0
    mixer.learn(every[known], of[known], sums[:, :, known], np.full(mixer.weights.shape, 1e-6))
    bits = mixer.bits(every, sums)[every >> np.uint64(8) == gram[7] >> np.uint64(8)]
    assert len(bits) == 256 and math.isclose(float((2.0**-bits).sum()), 1.0, rel_tol=1e-5)
    name = lm.mix(every)
    found = lm.Lookup(name, of, np.arange(len(name)), bits=6)(name)  # small tables: entries push each other out
    assert np.isnan(found).any() and all(name[int(k)] == x for k, x in zip(found, name, strict=True) if not np.isnan(k))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(5, 60))) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(lm, "FREQUENT_GRAMS", 64)  # the join of other grams is used too
    one, seven = ({r["doc_id"]: r["score"] for r in lm.scored(docs.repartition(k)).collect()} for k in (1, 7))
    assert all(math.isclose(one[i], seven[i], rel_tol=1e-6) for i in one)


def test_empty(none):
    assert lm.scored(none).count() == 0

import math
import random

import pyarrow as pa
from tokenizers import Tokenizer, models

from tarnsearch.llm import tokencount as tc
from tarnsearch.llm._bytes import texts

SCORES = {"▁": -5.0, "▁a": -2.0, "ab": -3.0, "abc": -3.5, "b": -4.0, "c": -4.0, "▁abc": -6.0, "a": -4.5, "bca": -4.0}


def brute(token: str) -> tuple[int, float]:
    """All segmentations."""
    floor = min(SCORES.values()) - tc.BYTE_PENALTY
    best = {0: (0.0, 0)}
    for j in range(1, len(token) + 1):
        options = [(best[i][0] + SCORES[token[i:j]], -best[i][1] - 1) for i in range(j) if token[i:j] in SCORES]
        n = len(token[j - 1].encode())
        options.append((best[j - 1][0] + floor * n, -best[j - 1][1] - n))
        s, few = max(options)
        best[j] = (s, -few)
    return best[len(token)][1], best[len(token)][0]


def test_trie_agrees_with_all_segmentations():
    tokens = [tc.MARK + a + b + c for a in ("", "a", "ab", "é") for b in ("abc", "bca", "z") for c in ("", "c", "abcabc")]
    tokens += [tc.MARK + "abcbca" * 60, tc.MARK + "abcbca" * 60 + "é", "a" * tc.DEEP, "ab" * tc.DEEP]
    random.Random(3).shuffle(tokens)
    trie = tc.Trie(SCORES)
    for token in tokens:
        end, want = trie.insert(token), brute(token)
        assert trie.number[end] == want[0] and math.isclose(trie.best[end], want[1])


def test_shared_prefixes_are_scored_once():
    trie = tc.Trie(SCORES)
    for token in ("abca", "bc", "abcb", "abc", "b"):
        trie.insert(token)
    assert trie.scored == len({"a", "ab", "abc", "abca", "abcb", "b", "bc"})


def test_segmentation_is_a_unigram_models():
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(300)} | set("abcde") | {tc.MARK})
    scores = {p: -rng.uniform(2, 9) * len(p) ** 0.5 for p in pieces}
    library = Tokenizer(models.Unigram([("<unk>", -30.0), *scores.items()], unk_id=0, byte_fallback=False))
    trie = tc.Trie(scores)
    for _ in range(400):
        token = tc.MARK + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 90)))
        want = library.encode(token).tokens
        end = trie.insert(token)
        assert trie.number[end] == len(want)
        assert math.isclose(trie.best[end], sum(scores[p] for p in want), rel_tol=1e-9)


def test_a_new_trie_changes_no_count(monkeypatch):
    rng = random.Random(6)
    batches = [pa.array([" ".join("".join(rng.choice("abcz") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(5)]) for _ in range(4)]
    whole, small = tc.Counter(SCORES), tc.Counter(SCORES)
    want = [whole(*texts(b)) for b in batches]
    monkeypatch.setattr(tc, "NODES", 50)
    for b, w in zip(batches, want, strict=True):
        assert all((x == y).all() for x, y in zip(small(*texts(b)), w, strict=True))


def test_counts_of_texts(spark, edge, edge_rows, none):
    got = tc.count_tokens(edge, SCORES).collect()
    want = sorted((str(i), len((t or "").split()), sum(brute(tc.MARK + w)[0] for w in (t or "").split())) for i, t, _ in edge_rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in got) == want
    assert tc.count_tokens(none, SCORES).count() == 0

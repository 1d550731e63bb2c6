import math
import random
from collections import Counter, defaultdict

from tarnsearch.llm import neardup as nd
from tarnsearch.llm.components import components

from .conftest import prose


def _set(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(25):
        base = prose(rng, rng.randint(60, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 1)):
                own[rng.randrange(len(own))] = "edited"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    sets = {i: _set(t) for i, t in rows}
    for i in got:
        for j in got:
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if s >= 0.9:
                assert got[i] == got[j]
            if group[i] != group[j]:
                assert got[i] != got[j]


def test_weights_are_of_exact_document_frequencies(spark, monkeypatch):
    monkeypatch.setattr(nd, "FREQUENT", 8)  # the rare words' join is used too
    rng = random.Random(9)
    # More words than any table of fixed size has room for; the texts to weigh come last.
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(4000))) for i in range(50)]
    rows += [(100 + i, prose(rng, 30) + f" w{i}x7 rare{i}") for i in range(20)] + [(200, None), (201, "")]
    df = Counter(w for _, t in rows for w in set((t or "").lower().split()))
    seen = []
    real = nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda *a: seen.extend((out := real(*a)).collect()) or out)
    assert nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    got = {r["name"]: r["weight"] for r in seen}
    for i, t in rows:
        w = (t or "").split()
        tf = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        want = sum((1 + math.log(n)) * sum(math.log1p(len(rows) / df[x]) for x in s) / 5 for s, n in tf.items())
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_edges(edge, none):
    got = defaultdict(set)
    for r in nd.classes(edge).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[1] == got[2] == {1} and got[None] == {1, None} and got[3] == {3} and got[4] == {4} and got[5] == {5}
    kept = nd.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]
    assert nd.classes(none).count() == 0 and nd.keep_first(none).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_few_edges_take_one_write(spark, monkeypatch):
    from tarnsearch.llm import components as module

    rng, writes, real = random.Random(8), [], module.settle
    monkeypatch.setattr(module, "settle", lambda x: writes.append(1) or real(x))
    names = [f"n{k:03}" for k in range(300)]
    edges = [(names[k], names[k + 1]) for k in range(60)] + [(rng.choice(names[100:]), rng.choice(names[100:])) for _ in range(150)]
    docs = spark.createDataFrame(edges + [("x", "x")], "a string, b string")
    got = sorted(map(tuple, components(docs).collect()))
    assert len(writes) == 1
    monkeypatch.setattr(module, "SHORT", -1)
    assert got == sorted(map(tuple, components(docs).collect())) and len(writes) > 2
    assert ("n060", "n000") in got
    monkeypatch.undo()
    assert components(docs.limit(0)).collect() == []


def test_each_distinct_word_is_looked_up_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = "one two three two one " * 5000
    raw, off = nd.texts(pa.array([text, "two four", "", None]))
    own, owner, which = nd._in_texts(raw, off)
    assert sorted(zip(owner.tolist(), own[which].tolist())) == sorted((k, int(h)) for k, t in enumerate((text, "two four")) for h in {*nd.word_hashes(*nd.texts(pa.array([t])))[0].tolist()})
    h, _ = nd.word_hashes(raw, off)
    known = np.sort(own)
    asked, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: asked.append(len(v)) or real(a, v, *x, **y))
    idf = nd.Weigher(known, np.arange(1.0, 5.0), 7).idf(h, pa.array([[]] * 4, pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))))
    assert idf.tolist() == [math.log1p(7 / (1 + known.tolist().index(x))) for x in h.tolist()]
    assert asked == [4]


def test_driver_garbage_is_collected():
    from types import SimpleNamespace as Some

    from tarnsearch.llm._spark import tidy

    state = {"used": 0, "live": 100, "runs": 0}
    heap = Some(maxMemory=lambda: 750, totalMemory=lambda: 700, freeMemory=lambda: 700 - state["used"])
    collect = lambda: state.update(used=state["live"], runs=state["runs"] + 1)
    spark = Some(sparkContext=Some(_jvm=Some(Runtime=Some(getRuntime=lambda: heap), System=Some(gc=collect))))
    for used, live, runs in ((249, 100, 0), (251, 200, 1), (399, 200, 1), (401, 100, 2), (249, 100, 2), (251, 100, 3)):
        state |= {"used": used, "live": live}
        tidy(spark)
        assert state["runs"] == runs


def test_classes_equal_all_pairs(spark):
    """Components of all pairs of weighted Jaccard similarity 0.8 or more, by plain Python; families are far under it to over it."""
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        base = prose(rng, 150).split()
        for _ in range(30):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(400)}"
            rows.append((len(rows), " ".join(own)))
    df = Counter(w for _, t in rows for w in set(t.lower().split()))
    weights = []
    for _, t in rows:
        w = t.lower().split()
        tf = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        weights.append({s: (1 + math.log(n)) * sum(math.log1p(len(rows) / df[x]) for x in s) / 5 for s, n in tf.items()})
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    links, near = 0, 0
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(x, weights[j][s]) for s, x in weights[i].items() if s in weights[j])
            similar = both / (sum(weights[i].values()) + sum(weights[j].values()) - both)
            near += 0.6 < similar < 0.8
            if similar >= 0.8:
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert links > 80 and near > 300  # both sides of the threshold are tried
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_bounds_are_never_under_the_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = (np.sort(rng.choice(pool, 40, replace=False)) for _ in "ab")
        x, y = (a, rng.random(40) * 9 + 0.1), (b, rng.random(40) * 9 + 0.1)
        low = np.minimum(nd.sketch(*x), nd.sketch(*y)).sum() / nd.UNIT
        assert low / (x[1].sum() + y[1].sum() - low) >= nd.similarity(x, y)


def test_survivors_do_not_depend_on_partitions(spark):
    rows = [(1, "a b c d e f g", k % 3) for k in range(6)] + [(2, "a b c d e f g", 9), (3, None, 1), (3, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_ int")
    got = [sorted(map(tuple, nd.keep_first(docs.repartition(n)).collect()), key=str) for n in (1, 3)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 3]

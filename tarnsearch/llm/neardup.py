"""Near duplicates by consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's shingles are its runs of five words (a shorter text is one shingle), A-Z as a-z. A shingle weighs
(1 + ln tf) * idf, idf being the mean over its words of ln(1 + N/df). Document frequencies are of all texts and exact by
word hash: those of at most FREQUENT words are sent to all tasks, the others are joined with the texts that have them, so
what every task needs has a bound and weights are the same at any size. (Frequencies of whole shingles would make a large group of near copies unlike each other: what its members
share would weigh little for being shared.)

Improved consistent weighted sampling gives each text BANDS * ROWS samples, each the same for two texts with the
probability of their weighted Jaccard similarity. Texts that agree in all samples of a band are candidates.

Exact copies are first made one node. Inside a band's bucket no pairs are listed at first: for HUB_ROUNDS rounds members
are compared with hubs, and verified links join components. A hub is a member that shares many buckets with many others;
the first round has one a bucket, later ones two: another of the hub's component, and one of what that component lacks.
What remains is exact: members of a bucket that are still in different components are compared with each other, unless
they have been, or unless a bound of their similarity is too small. Bounds are never under the true value: the lesser
total weight by the greater, and sums over BINS bins of shingles of the lesser weight of a bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._bytes import U64, mix, pieces, shingles, texts, word_hashes
from tarnsearch.llm._spark import discard
from tarnsearch.llm._spark import settle_tidy as settle
from tarnsearch.llm.components import components
from tarnsearch.llm.lm import frequent

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 5
HUB_ROUNDS = 3
FREQUENT = 1 << 18
BINS = 128
UNIT = 16  # of a bin's weight, rounded up
_TABLE_BITS = 14
_PIECE = 1 << 20  # bytes of text at a time


def _draws() -> tuple[np.ndarray, ...]:
    """Fixed pseudo-random tables of r and c, both Gamma(2, 1), and beta, uniform: r, 1/r, ln c - r (1 - beta), beta; and
    a multiplier a sample."""
    u = lambda k: (mix(np.arange(1 << _TABLE_BITS, dtype=U64) + U64(k << 32)) >> U64(11)).astype(np.float64) / 2.0**53 + 2.0**-54
    r, c, beta = -np.log(u(1) * u(2)), -np.log(u(3) * u(4)), u(6)
    odd = mix(np.arange(BANDS * ROWS, dtype=U64) + U64(5 << 32)) | U64(1)
    return *(x.astype(np.float32) for x in (r, 1 / r, np.log(c) - r * (1 - beta), beta)), odd


def samples(h: np.ndarray, log_weight: np.ndarray, draws: tuple[np.ndarray, ...]) -> np.ndarray:
    """The BANDS * ROWS samples of a weighted set of distinct hashes in ascending order, as 64-bit names."""
    r, inverse, level, beta, odd = draws
    best, found = None, None
    for at in range(0, len(h), 512):
        part, lw = h[at : at + 512], log_weight[at : at + 512]
        place = (part[None, :] * odd[:, None] >> U64(64 - _TABLE_BITS)).astype(np.intp)
        t = inverse.take(place)
        t *= lw
        t += beta.take(place)
        np.floor(t, out=t)
        value = level.take(place)
        value -= r.take(place) * t  # ln c - r (t - beta + 1)
        i = np.argmin(value, 1)[:, None]
        low = np.take_along_axis(value, i, 1)[:, 0]
        name = mix(part[i[:, 0]] + np.take_along_axis(t, i, 1)[:, 0].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
        if best is None:
            best, found = low, name
        else:
            less = low < best
            best, found = np.where(less, low, best), np.where(less, name, found)
    return found


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    grid = found.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=U64) + U64(1)
    for k in range(ROWS):
        out = mix(out * U64(31) + grid[:, k])
    return out.astype(np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes by first place, index among them of each hash), by a hash table: a sort takes ten times as long."""
    code = pa.array(h).dictionary_encode()
    return code.dictionary.to_numpy(), code.indices.to_numpy()


class Weigher:
    """Distinct shingles and weights of texts, with the corpus's document frequencies: of frequent words in ascending
    order, and of the texts' other words as given with them."""

    def __init__(self, word: np.ndarray, frequency: np.ndarray, n_docs: int):
        self.word, self.frequency, self.n_docs = word, frequency, n_docs

    def idf(self, h: np.ndarray, rare: pa.Array) -> np.ndarray:
        """ln(1 + N/df) of words; rare has (word, n) lists."""
        own = rare.flatten()
        word, at = np.unique(own.field("word").to_numpy(zero_copy_only=False).astype(U64), return_index=True)
        distinct, which = _distinct(h)
        df = np.ones(len(distinct))
        for known, n in ((self.word, self.frequency), (word, own.field("n").to_numpy(zero_copy_only=False)[at])):
            if len(known):
                place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                hit = known[place] == distinct
                df[hit] = n[place[hit]]
        return np.log1p(self.n_docs / df)[which]

    def __call__(self, raw: np.ndarray, off: np.ndarray, rare: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h, first = word_hashes(raw, off)
        s, to = shingles(h, first, WORDS)
        sums = np.concatenate([[0.0], np.cumsum(self.idf(h, rare))])
        for k in range(len(off) - 1):
            n_words, n = int(first[k + 1] - first[k]), int(to[k + 1] - to[k])
            width = min(WORDS, n_words)
            if not n:
                yield s[:0], np.zeros(0)
                continue
            begin = int(first[k])
            idf = (sums[begin + width : begin + width + n] - sums[begin : begin + n]) / width
            own, at, tf = np.unique(s[to[k] : to[k + 1]], return_index=True, return_counts=True)
            yield own, np.maximum(idf[at], 1e-6) * (1.0 + np.log(tf))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; of two empty sets 0."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    rest = a[1].sum() + b[1].sum() - np.minimum(a[1][x], b[1][y]).sum()
    return float(both / rest) if rest > 0 else 0.0


def _in_texts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, index of a text, index of a word) for each word of each text, once a text, in order of texts."""
    h, first = word_hashes(raw, off)
    own, which = _distinct(h)
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    pairs = owner * max(1, len(own)) + which
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return own, pairs // max(1, len(own)), pairs % max(1, len(own))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(word, n): in how many texts each word is, by its hash; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, which = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            return own, np.bincount(which, np.concatenate([n for _, n in found])).astype(np.int64)

        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                own, _, which = _in_texts(*texts(part.column(0)))
                found.append((own, np.bincount(which, minlength=len(own))))
                held += len(own)
                if held > 4 << 20:
                    found = [merged()]
                    if (held := len(found[0][0])) > 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(found[0][0].view(np.int64)), pa.array(found[0][1])], ["word", "n"])
                        found, held = [], 0
        if found:
            own, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["word", "n"])

    return rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


RARE = "array<struct<word:bigint,n:bigint>>"


def rare_words(rows: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """(key_, rare): the (word, n) of each text's words that aren't frequent, for texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, _ = shared.value
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                own, owner, which = _in_texts(*texts(part.column(1)))
                other = ~np.isin(own, word, assume_unique=True)
                owner, which = owner[other[which]], which[other[which]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(own[which].view(np.int64))], ["key", "word"])

    found = rows.select("key", "text").mapInArrow(run, "key string, word long")
    return found.join(counts, "word").groupBy(F.col("key").alias("key_")).agg(F.collect_set(F.struct("word", "n")).alias("rare"))


def sketch(own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights by bin of the shingle's hash, in 1/UNIT, rounded up."""
    return np.ceil(np.bincount((own >> U64(57)).astype(np.intp), w, BINS) * UNIT + 1e-6).astype(np.int32)


def signatures(rows: DataFrame, shared, n_docs: int) -> DataFrame:
    """(key, name, bands, bins, total weight) of (key, name, text, rare); a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, draws = Weigher(*shared.value, n_docs), _draws()
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                keys, bins, total = [], [], []
                for own, w in weigh(*texts(part.column(2)), part.column(3)):
                    keys.append(bands(samples(own, np.log(w).astype(np.float32), draws)) if len(own) else [])
                    bins.append(sketch(own, w))
                    total.append(w.sum())
                cols = [part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int32())), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "name", "bands", "bins", "weight"])

    return rows.select("key", "name", "text", "rare").mapInArrow(run, "key string, name long, bands array<long>, bins array<int>, weight double")


def near_weights(weight_a: Column, weight_b: Column, least: float) -> Column:
    """Whether total weights allow a similarity of ``least``."""
    return F.least(weight_a, weight_b) >= F.greatest(weight_a, weight_b) * (least - 1e-9)


def near_bins(bins_a: Column, bins_b: Column, weight_a: Column, weight_b: Column, least: float) -> Column:
    """Whether weights by bin allow a similarity of ``least``: what two texts share is at most the sum of lesser weights."""
    both = F.aggregate(F.zip_with(bins_a, bins_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    return both >= (weight_a + weight_b) * (UNIT * least / (1 + least) - 1e-6)


def verify(pairs: DataFrame, found: DataFrame, shared, n_docs: int, least: float) -> DataFrame:
    """(a, b, component_a, component_b, linked) of pairs: whether the texts' weighted Jaccard similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(*shared.value, n_docs)
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                if new := {k: i for i, k in enumerate(a + b) if k not in kept}:
                    if len(kept) > 256:
                        kept = {k: kept[k] for k in {*a, *b} & kept.keys()}
                    text, rare = (pa.concat_arrays([part.column(x), part.column(x + 1)]).take(pa.array(new.values(), pa.int64())) for x in (4, 6))
                    kept |= zip(new, weigh(*texts(text), rare), strict=True)
                linked = [similarity(kept[x], kept[y]) >= least for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(linked, pa.bool_())], ["a", "b", "component_a", "component_b", "linked"])

    one = found.select(F.col("key").alias("a"), F.col("text").alias("text_a"), F.col("rare").alias("rare_a"))
    two = found.select(F.col("key").alias("b"), F.col("text").alias("text_b"), F.col("rare").alias("rare_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "component_a", "component_b", "text_a", "text_b", "rare_a", "rare_b")
    return both.mapInArrow(run, "a string, b string, component_a string, component_b string, linked boolean")


def hub_pairs(at: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, component_a, component_b): members of each open bucket with its hubs of round ``k``, once each."""
    rank = F.col("central") * (1.0 + F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 20)) / float(1 << 20) * min(k, 1))
    member = F.struct(rank.alias("rank"), "key", "component", "weight")
    open_ = at.groupBy("band").agg(F.max(F.struct("central", "key", "component", "weight")).alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = open_.where("low <> high").select(F.col("band").alias("band_"), "first")
    at = at.join(open_, F.col("band") == F.col("band_"))
    if k:
        main = F.col("component") == F.col("first.component")
        hubs = at.groupBy("band_").agg(F.max(F.when(main, member)).alias("main"), F.max(F.when(~main, member)).alias("rest"))
        hubs = hubs.select(F.col("band_").alias("of"), F.explode(F.array("main", "rest")).alias("hub"))
        at = at.where(~main).join(hubs, F.col("band_") == F.col("of"))
    else:
        at = at.withColumn("hub", F.col("first"))
    one, two = (F.struct(x("key").alias("key"), x("component").alias("component")) for x in (F.col, lambda c: F.col(f"hub.{c}")))
    pairs = at.where("component <> hub.component").where(near_weights(F.col("weight"), F.col("hub.weight"), least)).select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.component").alias("component_a"), F.col("y.component").alias("component_b")).distinct()


def other_pairs(at: DataFrame, bins: DataFrame, least: float) -> DataFrame:
    """hub_pairs() of all members of a bucket in different components whose bounds allow the similarity."""
    open_ = at.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("band").alias("band_"))
    at = at.join(open_, F.col("band") == F.col("band_")).join(bins, F.col("key") == F.col("key_")).select("band", "key", "component", "weight", "bins")
    one, two = (at.select(*(F.col(c).alias(f"{c}_{x}") for c in at.columns)) for x in "ab")
    may = near_weights(F.col("weight_a"), F.col("weight_b"), least) & near_bins(F.col("bins_a"), F.col("bins_b"), F.col("weight_a"), F.col("weight_b"), least)
    pairs = one.join(two, F.expr("band_a = band_b and key_a < key_b and component_a <> component_b") & may)
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "component_a", "component_b").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, class_id, first): a row for each row of ``docs``.

    Documents are in one class if a chain of copies and verified near copies joins them; class_id is the class's least
    doc_id. ``first`` marks the rows with that id and the text that bears it. Texts without words have no near copies,
    only exact ones. A null text is a class of its own; rows with neither text nor id are one class. Where all copies of
    a text have null ids, it has no near copies, and its class_id is null.
    """
    key = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.concat(F.lit("null:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    n_docs = rows.count()
    counts = settle(document_frequency(rows))
    shared = docs.sparkSession.sparkContext.broadcast(frequent(counts, FREQUENT))
    named = rows.groupBy("key").agg(F.min("doc_id").alias("name"), F.first("text").alias("text"))
    rare = settle(rare_words(named, counts, shared))
    with_rare = lambda x: x.join(rare, F.col("key") == F.col("key_"), "left").withColumn("rare", F.coalesce("rare", F.array().cast(RARE))).drop("key_")
    nodes = settle(signatures(with_rare(named), shared, n_docs))
    spread = nodes.where(F.col("name").isNotNull()).select("key", "weight", F.explode("bands").alias("band"))
    full = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("band_"), "n")
    spread = spread.join(full, F.col("band") == F.col("band_")).select("band", "key", "weight", "n")
    central = spread.groupBy(F.col("key").alias("key_")).agg(F.sum("n").alias("central"))
    members = settle(spread.join(central, F.col("key") == F.col("key_")).select("band", "key", "weight", "central"))
    needed = members.select("key").distinct().join(nodes.select("key", "name"), "key").select(F.col("key").alias("key_"), "name")
    found = rows.join(needed, (F.col("doc_id") == F.col("name")) & (F.col("key") == F.col("key_"))).select("key", "text")
    found = settle(with_rare(found))

    joined = settle(members.select(F.col("key").alias("node"), F.col("key").alias("component")).distinct())
    tested = []
    for k in range(HUB_ROUNDS + 1):
        at = members.join(joined, F.col("key") == F.col("node")).select("band", "key", "weight", "central", "component")
        pairs = hub_pairs(at, k, least) if k < HUB_ROUNDS else other_pairs(at, nodes.select(F.col("key").alias("key_"), "bins"), least)
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionAll, tested).select("a", "b"), ["a", "b"], "left_anti")
        tested.append(settle(verify(pairs, found, shared, n_docs, least)))
        links = tested[-1].where("linked").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
        merged = components(links).select(F.col("node").alias("of"), F.col("component").alias("now"))
        before = joined
        joined = settle(before.join(merged, F.col("component") == F.col("of"), "left").select("node", F.coalesce("now", "component").alias("component")))
        discard(before)
    named = settle(nodes.select("key", "name").join(joined, F.col("key") == F.col("node"), "left").select("key", "name", F.coalesce("component", "key").alias("component")))
    discard(counts, rare, nodes, members, found, joined, *tested)
    shared.destroy()
    least_id = named.groupBy("component").agg(F.min(F.struct("name", "key")).alias("low")).select(F.col("component").alias("of"), "low")
    named = named.join(least_id, F.col("component") == F.col("of")).select(F.col("key").alias("key_"), F.col("low.name").alias("class_id"), F.col("low.key").alias("bears"))
    out = rows.select("doc_id", "key").join(named, F.col("key") == F.col("key_"))
    return out.select("doc_id", "key", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("bears"))).alias("first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each class; of repeated rows with that id and text one by the columns' hash.

    Nulls, empty texts and repeated rows are as in classes(); an empty table stays one.
    """
    stay = classes(docs, id_col, text_col).where("first").groupBy(F.col("key").alias("of_")).agg(F.min("doc_id").alias("id_"))
    key = F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.concat(F.lit("null:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(key.alias("key_"), F.col(id_col).cast("long").alias("own_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    rows = rows.join(stay, F.col("key_") == F.col("of_")).where(F.col("own_").eqNullSafe(F.col("id_")))
    return rows.groupBy("key_").agg(F.min_by("row_", F.xxhash64("row_")).alias("row_")).select("row_.*")

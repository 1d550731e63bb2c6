"""Language-model scores: logistic mixing of hashed-context bit predictors, beside a unigram base score.

A text is its words, A-Z as a-z, with one space between them, and its end: what the base score is of. The model gives
each bit of its UTF-8 bytes, and of a byte 0 that ends it, a probability. Predictors are counts of zeros and ones after
contexts of one, three, four and five bytes and of the word so far (its last WORD bytes; the last three bytes where it is
shorter). Counts are exact and grow with the training texts: a row for each distinct gram, which is the five bytes before
a byte, those before them as far as they are of the same word, and the byte.

Grams are dealt by the last three bytes before the byte, so all contexts but that of one byte (65,536 counts, sent to all
tasks) are counted within a task. A task learns online: it takes gradient steps over STEP grams at a time, each weighted by its
occurrences, with one occurrence left out of the counts. Weights are chosen by gates: how much was seen in the context,
which contexts are known, and the place of the bit in its byte. A table refines the mixture by what followed
such predictions. Tasks' weights are averaged by occurrences. The deal, the order of grams and so the scores depend on the
rows only, not on how they are partitioned.

Each distinct gram's cost is computed once. Those of grams with SHARE of all occurrences or more are sent to all tasks, of
FREQUENT_GRAMS at most; the other grams' occurrences, about the same share at any size, are joined with their costs. So are counts of words, of which FREQUENT are sent, for the base score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._bytes import LOWER, SPACE, U64, mix, pieces, texts, word_hashes, words
from tarnsearch.llm._spark import settle
from tarnsearch.llm.langid import remainder

PREDICTORS = 5  # contexts of 1, 3, 4, 5 bytes, the word so far
LEVELS = 16
PLACES = 3
GATES = 16
BUCKETS = 33
FREQUENT = 1 << 18
FREQUENT_GRAMS = 1 << 21
SHARE = 2.0**-24
PAST = 5
NEAR = 3
WORD = 6  # of 7 at most: a gram has 64 bits
STEP = 1024
_SHAPE = (PLACES, GATES, PREDICTORS, LEVELS)
_RATE = 0.05
_PIECE = 1 << 20
_HELD = 1 << 17
_LEVEL = np.minimum(np.log2(np.arange(1 << LEVELS - 1) + 1).astype(np.int64), LEVELS - 1)
_GRAMS = "gram long, n long, times long"
_SLICE = 1 << 16


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with A-Z as a-z and one space between words."""
    start, _, first = words(raw, off)
    out, keep = LOWER[raw], ~SPACE[raw]
    inner = np.ones(len(start), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    between = start[inner] - 1
    out[between], keep[between] = 0x20, True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def laid_out(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, where each text's begin plus a last entry): see the module; the last byte is the lowest."""
    raw, off = normalised(raw, off)
    n = len(off) - 1
    size = np.diff(off) + PAST + 1
    to = np.concatenate([[0], np.cumsum(size)])
    wide = np.zeros(to[-1], dtype=U64)
    inside = np.ones(to[-1], dtype=bool)
    inside[(to[:-1][:, None] + np.arange(PAST)).ravel()] = False
    place = inside.copy()
    place[to[1:] - 1] = False
    wide[place] = raw
    grams = wide.copy()
    letter = (wide != U64(0)) & (wide != U64(0x20))
    run = letter.copy()  # the last k bytes are of one word
    for k in range(1, WORD + 1):
        if k <= PAST:
            grams[k:] |= wide[:-k] << U64(8 * k)
        elif len(wide) > k:
            grams[k:] |= np.where(run[k - 1 : -1], wide[:-k], U64(0)) << U64(8 * k)
        run[k:] &= letter[:-k]
        run[:k] = False
    return grams[inside], to - PAST * np.arange(n + 1)


def word_so_far(past: np.ndarray) -> np.ndarray:
    """The last bytes of a word of NEAR bytes or more, else the last NEAR bytes, marked."""
    word, open_, size = np.zeros_like(past), np.ones(len(past), dtype=bool), np.zeros(len(past), np.int64)
    for k in range(WORD):
        c = past >> U64(8 * k) & U64(255)
        open_ = open_ & (c != U64(0)) & (c != U64(0x20))
        word |= np.where(open_, c, U64(0)) << U64(8 * k)
        size += open_
    return np.where(size < NEAR, past & U64((1 << 8 * NEAR) - 1) | U64(1 << 63), word)


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(distinct values ascending, sums of their counts)."""
    value, *counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(value)
    value = value[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return (value[start], *(np.add.reduceat(c[order], start) if len(start) else c for c in counts))


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct grams, occurrences in training texts, in all) of rows (text, train), in parts of bounded size."""
    found, held = [], 0
    for batch in batches:
        for part in pieces(batch, "text", _PIECE):
            train = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for which in (True, False):
                chosen = part.column(0).filter(pa.array(train == which))
                if len(chosen):
                    own, n = np.unique(laid_out(*texts(chosen))[0], return_counts=True)
                    found.append((own, n if which else np.zeros_like(n), n))
                    held += len(own)
            if held > 2 << 20:
                found = [_merged(found)]
                if (held := len(found[0][0])) > 3 << 19:
                    yield found[0]
                    found, held = [], 0
    if found:
        yield _merged(found)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, n, times) of the rows (text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for found in occurrences(batches):
            for a in range(0, len(found[0]), _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + _SLICE].astype(np.int64)) for x in found], ["gram", "n", "times"])

    found = rows.select("text", "train").mapInArrow(run, _GRAMS)
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def after_one(counts: DataFrame) -> np.ndarray:
    """Occurrences of a byte (second axis) after a byte in training texts."""
    out = np.zeros((256, 256))
    for pair, n in counts.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n")).collect():
        out[pair >> 8, pair & 255] = n
    return out


def totals(gram: np.ndarray, n: np.ndarray, one: np.ndarray) -> np.ndarray:
    """By predictor, s and gram: occurrences after the context of bytes with the same bits above the last s.

    The grams must be all that follow their last three bytes.
    """
    out = np.empty((PREDICTORS, 9, len(gram)), np.float32)
    byte, past = (gram & U64(255)).astype(np.int64), gram >> U64(8)
    before = (past & U64(255)).astype(np.int64)
    for s in range(9):
        out[0, s] = one.reshape(256, 256 >> s, 1 << s).sum(-1)[before, byte >> s]
    for k, of in enumerate((*(past & U64((1 << 8 * m) - 1) for m in (NEAR, 4, 5)), word_so_far(past)), 1):
        order = np.argsort(of)
        sorted_ = of[order]
        which = np.empty(len(of), np.int64)
        which[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        key = which << 8 | byte
        order = np.argsort(key)
        key = key[order]
        for s in range(9):
            node = key >> s
            run = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
            out[k, s, order] = np.bincount(run, n[order])[run]
    return out


@dataclass
class Mixer:
    """Weights by place, gate, predictor and level; ``refine`` has (ones, all) by node and bucket of the mixed prediction."""

    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def start(cls) -> Mixer:
        return cls(np.full(_SHAPE, 0.3), np.zeros((256, BUCKETS, 2)))

    @staticmethod
    def inputs(sums: np.ndarray, bit: np.ndarray, known: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(predictions in the logistic domain, levels of what was seen, gates); own: occurrences to leave out."""
        all_ = np.maximum(sums[:, 8 - known] - own, 0)
        same = np.maximum(sums[:, 7 - known] - own, 0)
        stretch = np.log((same + np.float32(0.2)) / (all_ - same + np.float32(0.2))) * np.where(bit, np.float32(1), np.float32(-1))
        level = _LEVEL.take(all_.astype(np.int64), mode="clip")
        gate = ((all_[1:] > 0) * (1 << np.arange(PREDICTORS - 1))[:, None]).sum(0)
        return stretch, level, gate

    @staticmethod
    def place(known: int) -> int:
        return 0 if known == 0 else 1 if known < 4 else 2

    @staticmethod
    def bucket(dot: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(dot * 2).astype(np.int64) + BUCKETS // 2, 0, BUCKETS - 1)

    def learn(self, gram: np.ndarray, n: np.ndarray, sums: np.ndarray, step: np.ndarray) -> None:
        """Online steps over STEP grams each, in the given order; step holds the sums of squared gradients."""
        each = np.arange(PREDICTORS)[:, None]
        byte = (gram & U64(255)).astype(np.int64)
        for a in range(0, len(gram), STEP):
            c, b, part = n[a : a + STEP].astype(np.float64), byte[a : a + STEP], sums[:, :, a : a + STEP]
            for known in range(8):
                bit, node, at = b >> 7 - known & 1, 1 << known | b >> 8 - known, self.place(known)
                stretch, level, gate = self.inputs(part, bit, known, 1)
                dot = np.clip((self.weights[at, gate, each, level] * stretch).sum(0), -12, 12)
                p = 1 / (1 + np.exp(-dot))
                cell = node * BUCKETS + self.bucket(dot)
                for j, x in enumerate((c * bit, c)):
                    self.refine[..., j] += np.bincount(cell, x, 256 * BUCKETS).reshape(256, BUCKETS)
                slot = (gate * PREDICTORS + each) * LEVELS + level
                gradient = np.bincount(slot.ravel(), ((bit - p) * c * stretch).ravel(), GATES * PREDICTORS * LEVELS).reshape(_SHAPE[1:])
                step[at] += gradient * gradient
                self.weights[at] += _RATE * gradient / np.sqrt(step[at] + 1e-9)

    def bits(self, gram: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Cost in bits of each gram's last byte."""
        out, each = np.zeros(len(gram)), np.arange(PREDICTORS)[:, None]
        byte = (gram & U64(255)).astype(np.int64)
        for a in range(0, len(gram), 1 << 15):
            b, part = byte[a : a + (1 << 15)], sums[:, :, a : a + (1 << 15)]
            for known in range(8):
                bit, node = b >> 7 - known & 1, 1 << known | b >> 8 - known
                stretch, level, gate = self.inputs(part, bit, known, 0)
                dot = np.clip((self.weights[self.place(known), gate, each, level] * stretch).sum(0), -12, 12)
                p = 1 / (1 + np.exp(-dot))
                seen = self.refine[node, self.bucket(dot)]
                p = np.clip((p + (seen[:, 0] + 4 * p) / (seen[:, 1] + 4)) / 2, 1e-5, 1 - 1e-5)
                out[a : a + len(b)] -= np.log2(np.where(bit == 1, p, 1 - p))
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in the order of ``near``, some _HELD rows a time or more, and never a value's rows apart."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= _HELD:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [x[:cut] for x in whole]
            held = [[x[cut:] for x in whole]]
            size = len(held[0][0]) if cut else size // 2  # of one value: wait for as many again
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _dealt(counts: DataFrame, parts: int) -> DataFrame:
    near = F.shiftright("gram", 8).bitwiseAND((1 << 8 * NEAR) - 1)
    return counts.select(near.alias("near"), *counts.columns).repartition(parts, "near").sortWithinPartitions("near", "gram")


def train_mixer(counts: DataFrame, parts: int, one: np.ndarray) -> Mixer:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, step, seen = Mixer.start(), np.full(_SHAPE, 1e-6), 0
        for _, gram, n, _ in _groups(batches):
            gram = gram.astype(U64)
            sums = totals(gram, n, one)
            order = np.random.default_rng(len(n)).permutation(len(n))
            order = order[n[order] > 0]
            mixer.learn(gram[order], n[order], sums[:, :, order], step)
            seen += int(n.sum())
        if seen:
            values = np.concatenate([(mixer.weights * seen).ravel(), mixer.refine.ravel(), [seen]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([values.astype("<f8").tobytes()], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                own = np.frombuffer(blob, "<f8")
                out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    kind = "part long, sums binary"
    found = _dealt(counts, parts).mapInArrow(run, kind).repartition(1).sortWithinPartitions("part").mapInArrow(add, kind).first()
    if found is None:
        return Mixer.start()
    sums, size = np.frombuffer(bytes(found[1]), "<f8"), int(np.prod(_SHAPE))
    return Mixer((sums[:size] / sums[-1]).reshape(_SHAPE), sums[size:-1].reshape(256, BUCKETS, 2))


def gram_costs(counts: DataFrame, parts: int, mixer: Mixer, one: np.ndarray) -> DataFrame:
    """(word, n, cost): name of each gram, its occurrences in all texts, and its last byte's cost in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, gram, n, times in _groups(batches):
            gram = gram.astype(U64)
            cost = mixer.bits(gram, totals(gram, n, one)).astype(np.float32).astype(np.float64)  # sent or joined, the same
            cols = [pa.array(mix(gram).astype(np.int64)), pa.array(times), pa.array(cost)]
            yield pa.RecordBatch.from_arrays(cols, ["word", "n", "cost"])

    return _dealt(counts, parts).mapInArrow(run, "word long, n long, cost double")


class Lookup:
    """Costs by name in two tables of fixed size; what finds no slot in either isn't in it, and is joined."""

    def __init__(self, name: np.ndarray, n: np.ndarray, cost: np.ndarray, bits: int = 22):
        order = np.argsort(n, kind="stable")  # the most frequent are written last and stay
        name, cost = name[order], cost[order]
        self.tables = []
        for shift, size in ((64 - bits, 1 << bits), (0, 1 << bits - 2)):
            slot = self._slot(name, shift, size)
            at = np.full(size, -1, np.int32)
            at[slot] = np.arange(len(name), dtype=np.int32)
            key, value, used = np.zeros(size, U64), np.full(size, np.nan, np.float32), at >= 0
            key[used], value[used] = name[at[used]], cost[at[used]]
            self.tables.append((shift, size, key, value))
            rest = key[slot] != name
            name, cost = name[rest], cost[rest]

    @staticmethod
    def _slot(name: np.ndarray, shift: int, size: int) -> np.ndarray:
        return (name >> U64(shift) & U64(size - 1)).astype(np.int64)

    def __call__(self, name: np.ndarray) -> np.ndarray:
        """Costs; NaN where a name isn't there."""
        out = None
        for shift, size, key, value in self.tables:
            miss = np.arange(len(name)) if out is None else np.flatnonzero(np.isnan(out))
            slot = self._slot(name[miss], shift, size)
            got = np.where(key[slot] == name[miss], value[slot], np.float32(np.nan))
            if out is None:
                out = got
            else:
                out[miss] = got
        return out


_last: dict = {}


def _kept(name: str, make):
    """What a worker made last under a name."""
    if name not in _last:
        _last.clear()
        _last[name] = make()
    return _last[name]


def _forget() -> None:
    _last.clear()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): counts of the words' hashes, A-Z as a-z; tasks send a sum a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        _forget()

        def out(found: list) -> pa.RecordBatch:
            own, n = _merged(found)
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                h, _ = word_hashes(*texts(part.column(0)))
                found.append(np.unique(h, return_counts=True))
                held += len(found[-1][0])
                if held > 4 << 20:
                    found = [_merged(found)]
                    if (held := len(found[0][0])) > 2 << 20:
                        yield out(found)
                        found, held = [], 0
        if found:
            yield out(found)

    return train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, ...]:
    """(words ascending, counts, other columns) of the words from a count on, ``most`` at most."""
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, None
    for s, n in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = s
    if least is None:
        return (np.zeros(0, U64), *(np.zeros(0) for _ in counts.columns[1:]))
    found = counts.where(step >= least).toArrow()
    word = found["word"].to_numpy().astype(U64)
    order = np.argsort(word)
    return (word[order], *(found[c].to_numpy()[order] for c in counts.columns[1:]))


def scored(docs: DataFrame, is_train=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each row.

    Null is the empty text, which has its end only. Null ids are allowed, and repeated rows are scored each. Without
    training texts the tables are empty and every word is unknown.
    """
    is_train = is_train or (lambda c: remainder(c, 7) != 2)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = rows.where(is_train(F.col("doc_id")))
    counts = settle(word_counts(train))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_train, distinct = sums[0] + ends, sums[1] + (ends > 0)
    known, n_known = frequent(counts, FREQUENT)
    parts = max(1, min(1 << 16, size >> 24))
    grams = settle(gram_counts(rows.select("text", is_train(F.col("doc_id")).alias("train"))))
    one = after_one(grams)
    costs = settle(gram_costs(grams, parts, train_mixer(grams, parts, one), one))
    all_grams = costs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gram, times, cost = frequent(costs.where(F.col("n") >= F.lit(all_grams * SHARE)), FREQUENT_GRAMS)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, gram, times.astype(np.float32), cost.astype(np.float32), known, n_known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, gram, times, cost, word, n = shared.value
        lookup, row = _kept(name, lambda: Lookup(gram, times, cost)), TaskContext.get().partitionId() << 36
        logs = np.log10(n + 1.0)
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                raw, off = texts(part.column(1))
                grams, to = laid_out(raw, off)
                called = mix(grams)
                spent = lookup(called)
                lost = np.isnan(spent)
                bits = np.add.reduceat(np.where(lost, 0.0, spent.astype(np.float64)), to[:-1])
                other = called[lost].astype(np.int64)
                other_at = np.concatenate([[0], np.cumsum(lost)])[to]
                h, first = word_hashes(raw, off)
                at = np.minimum(np.searchsorted(word, h), max(0, len(word) - 1))
                hit = word[at] == h if len(word) else np.zeros(len(h), bool)
                sums = np.concatenate([[0.0], np.cumsum(np.where(hit, logs[at] if len(word) else 0.0, 0.0))])
                seen = np.concatenate([[0], np.cumsum(hit)])
                rest = h[~hit].astype(np.int64)
                ends_at = np.concatenate([[0], np.cumsum(~hit)])[first]
                cols = [
                    pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(np.diff(first) + 1), pa.array(seen[first[1:]] - seen[first[:-1]]),
                    pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(bits), pa.array(np.diff(to)), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(rest)),
                    pa.ListArray.from_arrays(pa.array(other_at, pa.int32()), pa.array(other)),
                ]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_hit", "logs", "bits", "n_bytes", "rest", "other"])

    first = settle(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_hit long, logs double, bits double, n_bytes long, rest array<long>, other array<long>"))
    shared.destroy()
    rare = first.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word").groupBy(F.col("row").alias("row_")).agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    other = first.select("row", F.explode("other").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    other = other.join(costs.select("word", "cost"), "word").groupBy(F.col("row").alias("row__")).agg(F.sum(F.col("times") * F.col("cost")).alias("more_bits"))
    out = first.drop("rest", "other").join(rare, F.col("row") == F.col("row_"), "left").join(other, F.col("row") == F.col("row__"), "left")
    out = out.withColumn("bits", F.col("bits") + F.coalesce("more_bits", F.lit(0.0)))
    space = float(np.log10(max(1.0, n_train + 1.0 * (distinct + 1.0))))
    end = float(np.log10(ends + 1.0))
    return out.select(
        "doc_id",
        (~is_train(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_hit") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2.0)))).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )

"""Removal of repeated byte strings with a distributed, sparse suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus, itself included. Texts are
cut in tokens at places that content defines: after each window of WINDOW bytes whose hash has some bits zero. Suffixes
that begin at cuts, as token hashes that span LENGTH bytes and more, are range-partitioned by their leading tokens with
sampled splitters, sorted in their buckets, and compared with their neighbours in the bucket and across its bounds. That
gives each suffix the most tokens that it shares with any other.

A window of LENGTH bytes is then repeated if it lies within tokens that are shared from one suffix on, and is not if the
tokens within it are not shared. The rest, windows that end inside the tokens where texts part, is decided exactly: the
strings between the first and last cut within such windows are grouped, and where a group has an undecided member, the
hashes of all its windows go through the same sort and comparison of neighbours.

Splitters are keys of a sample of suffixes, so buckets have about BUCKET keys whatever the input's size. A bucket is sorted
by multikey quicksort, all runs of equal leading tokens at once: each round sorts those by their next token. Keys go from
task to bucket in bundles. Equal keys are told apart by their place, so a passage that most texts share is spread over
buckets like any other. Hashes have 64 bits (a suffix's later tokens 32 each).

Copies of a whole text are known beforehand by hash and length: they lose all, and stand in the array once.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._bytes import U64, mix, pieces, powers, prefix, span_hash, texts
from tarnsearch.llm._spark import discard, settle

LENGTH = 400
WINDOW = 24
COARSE, FINE = 63, 7  # a cut is where these bits of the window's hash are 0
TOKENS = 32
BUCKET = 300_000
SAMPLED = 100  # keys a bucket
_REACH = WINDOW + 1  # a cut depends on so many bytes before it
_PIECE = 1 << 20
_ID = np.dtype([("rid", "<i8"), ("n", "<u4"), ("i", "<u4")])


def cuts(sums: np.ndarray, a: int, b: int, bits: int) -> np.ndarray:
    """Places in the text [a, b), counted from a, after whose preceding WINDOW bytes the hash has these bits zero.

    Of a run of equal hashes (a repeated byte) only the first counts.
    """
    if b - a < _REACH:
        return np.zeros(0, np.int64)
    _, down = powers(len(sums))
    begin = np.arange(a, b - WINDOW + 1)
    h = mix((sums[begin + WINDOW] - sums[begin]) * down[begin])
    return np.flatnonzero((h[1:] & U64(bits) == 0) & (h[1:] != h[:-1])) + _REACH


class Text:
    """Cuts and tokens of the text [a, b) of a batch; the text's own bounds are cuts too, for what reaches outwards."""

    def __init__(self, sums: np.ndarray, a: int, b: int, length: int):
        self.sums, self.a, self.n, self.length = sums, a, b - a, length
        self.inner = cuts(sums, a, b, COARSE)
        end = [] if len(self.inner) and self.inner[-1] == self.n else [self.n]
        self.all = np.concatenate([[0], self.inner, end]).astype(np.int64)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, begin + self.a, end + self.a)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each token, tokens that the suffix at each token has)."""
        c = self.all
        tokens = self.hash(c[:-1], c[1:])
        upto = np.minimum(np.searchsorted(c, c[1:] - 1 + self.length), len(c) - 1)
        return tokens, np.minimum(upto - np.arange(len(c) - 1), TOKENS)


class Keys:
    """Keys of suffixes: the first token, the later ones in 32 bits each, and the suffix's place.

    A key's bytes are its tokens and then its place, so keys that share tokens are neighbours in the order of bytes.
    """

    def __init__(self, head: np.ndarray, size: np.ndarray, rest: np.ndarray, ids: np.ndarray):
        self.head, self.size, self.rest, self.ids = head, size, rest, ids
        self.at = np.concatenate([[0], np.cumsum(size.astype(np.int64) - 1)])

    @classmethod
    def of_tokens(cls, tokens: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Keys:
        """Key k has ``size[k]`` tokens from token k on."""
        n = size - 1
        to = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.arange(len(n)) + 1, n)
        return cls(tokens, size.astype(np.uint8), (tokens[to] >> U64(32)).astype(np.uint32), ids)

    def take(self, k: np.ndarray) -> Keys:
        n = self.size[k].astype(np.int64) - 1
        to = np.arange(n.sum()) + np.repeat(self.at[k] - (np.cumsum(n) - n), n)
        return Keys(self.head[k], self.size[k], self.rest[to], self.ids[k])

    def bytes(self, k: int) -> bytes:
        place = self.ids[k]
        return self.head[k : k + 1].astype(">u8").tobytes() + self.rest[self.at[k] : self.at[k + 1]].astype(">u4").tobytes() + np.array([place["rid"]], ">i8").tobytes() + np.array([place["n"], place["i"]], ">u4").tobytes()

    def part(self, split: list[bytes]) -> np.ndarray:
        """Each key's bucket between sorted splitters."""
        heads = np.frombuffer(b"".join(x[:8] for x in split), ">u8").astype(U64)
        out = np.searchsorted(heads, self.head, "right")
        for k in np.flatnonzero(out != np.searchsorted(heads, self.head, "left")).tolist():
            out[k] = bisect_right(split, self.bytes(k))
        return out

    def bundles(self, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, keys): texts' ids come once a bundle."""
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            own = self.take(order[a:b])
            text, which = np.unique(own.ids[["rid", "n"]].copy().astype([("rid", "<i8"), ("n", "<u4")]), return_inverse=True)
            fields = (own.head, own.size, own.rest, which.astype(np.uint32), own.ids["i"], text["rid"], text["n"])
            yield int(part[order[a]]), np.array([b - a, len(own.rest), len(text)], "<u4").tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in fields)

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Keys:
        """The keys of bundles, each place once."""
        parts = []
        for blob in blobs:
            n, m, t = np.frombuffer(blob, "<u4", 3).tolist()
            at, out = 12, []
            for kind, size in (("<u8", n), ("u1", n), ("<u4", m), ("<u4", n), ("<u4", n), ("<i8", t), ("<u4", t)):
                out.append(np.frombuffer(blob, kind, size, at))
                at += out[-1].nbytes
            ids = np.empty(n, _ID)
            ids["rid"], ids["n"], ids["i"] = out[5][out[3]], out[6][out[3]], out[4]
            parts.append((out[0], out[1], out[2], ids))
        all_ = cls(*map(np.concatenate, zip(*parts, strict=True)))
        name = mix(mix(all_.ids["rid"].view(U64)) + all_.ids["n"].astype(U64) * U64(0x9E3779B97F4A7C15) + all_.ids["i"].astype(U64))
        once = np.sort(np.unique(name, return_index=True)[1])
        return all_ if len(once) == len(name) else all_.take(once)

    def shared(self) -> np.ndarray:
        """How many leading tokens each key shares with another, at most.

        Multikey quicksort in rounds: keys in runs that are equal so far are sorted by run and next token, which parts
        the runs; a run of one is done.
        """
        out = np.zeros(len(self.head), dtype=np.int32)
        order = np.argsort(self.head, kind="stable")
        run = np.cumsum(np.diff(self.head[order], prepend=self.head[order[:1]]) != 0)
        depth = 0
        while len(order):
            alike = np.bincount(run)[run] > 1
            order, run = order[alike], run[alike]
            depth += 1
            out[order] = depth
            more = self.size[order] > depth
            order, run = order[more], run[more]
            token = self.rest[self.at[order] + depth - 1]
            by = np.lexsort((token, run))
            order, run, token = order[by], run[by], token[by]
            if len(order):
                run = np.cumsum(np.concatenate([[False], (run[1:] != run[:-1]) | (token[1:] != token[:-1])]))
        return out

    def end(self, last: bool) -> int:
        """The least or the greatest key by its bytes."""
        at = np.flatnonzero(self.head == (self.head.max() if last else self.head.min())).tolist()
        return (max if last else min)(at, key=self.bytes)


def _common(a: bytes, b: bytes) -> int:
    """Tokens that two keys share."""
    x, y = a[:-16], b[:-16]
    if x[:8] != y[:8]:
        return 0
    k = 1
    while 8 + 4 * k <= min(len(x), len(y)) and x[4 + 4 * k : 8 + 4 * k] == y[4 + 4 * k : 8 + 4 * k]:
        k += 1
    return k


_SENT = "dest int, blob binary, part int, first binary, last binary"
_FOUND = "rid long, n long, own binary, part int, first binary, last binary"
_SHARED = np.dtype([("rid", "<i8"), ("n", "<u4"), ("i", "<u4"), ("r", "<u4")])


def _ends(part: int, first: bytes, last: bytes, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """A row that holds a bucket's first and last key only."""
    values = {"dest": 0, "part": part, "first": first, "last": last}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(names, kinds, strict=True)], names)


_SENT_COLUMNS = (["dest", "blob", "part", "first", "last"], [pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()])
_FOUND_COLUMNS = (["rid", "n", "own", "part", "first", "last"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()])


def _filled(columns: dict[str, pa.Array], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, k)) for x, k in zip(names, kinds, strict=True)], names)


def _by_text(found: np.ndarray) -> pa.RecordBatch:
    """A row for each text of the places, with (i, r) of each of its own."""
    found = found[np.lexsort((found["n"], found["rid"]))]
    at = np.flatnonzero(np.concatenate([[True], (found["rid"][1:] != found["rid"][:-1]) | (found["n"][1:] != found["n"][:-1])]))
    own = np.stack([found["i"], found["r"]], 1)
    off = np.concatenate([at, [len(found)]]) * 8
    blob = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])
    return _filled({"rid": pa.array(found["rid"][at]), "n": pa.array(found["n"][at].astype(np.int64)), "own": blob}, *_FOUND_COLUMNS)


def places(owns: list[bytes]) -> np.ndarray:
    """(i, r) of a text's lists."""
    return np.frombuffer(b"".join(owns), "<u4").reshape(-1, 2)


def neighbours(rows: DataFrame, make: Callable[[pa.RecordBatch], Keys], n_keys: int) -> DataFrame:
    """(rid, n, own): (i, r) of each text's keys that share r >= 1 tokens with another.

    ``make`` gives the keys of a batch of ``rows``, which have a column rid. Splitters are of a sample; each bucket's
    first and last key go to the driver, where buckets meet: two keys a bucket.
    """
    spark = rows.sparkSession
    n_parts = max(math.ceil(n_keys / BUCKET), min(spark.sparkContext.defaultParallelism, math.ceil(n_keys / 20_000)), 1)
    share = min(1.0, SAMPLED * min(n_parts, 10_000) / max(1, n_keys))
    of_texts = min(1.0, 20 * share)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                keys = make(part)
                name = mix(keys.ids["rid"].view(U64) + mix(keys.ids["i"].astype(U64)))
                chosen = np.flatnonzero(name >> U64(11) < U64(int(share / of_texts * (1 << 53)))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([keys.bytes(k) for k in chosen], pa.binary())], ["key"])

    split: list[bytes] = []
    if n_parts > 1:
        some = rows.where(F.pmod(F.xxhash64("rid", F.lit(10)), F.lit(1 << 30)) < int(of_texts * (1 << 30)))
        found = sorted(bytes(r[0]) for r in some.mapInArrow(sampled, "key binary").collect())
        split = sorted({found[len(found) * k // n_parts] for k in range(1, n_parts)}) if found else []

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 * _PIECE):
                keys = make(part)
                if len(keys.head):
                    parts, blobs = zip(*keys.bundles(keys.part(split)), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            blobs += batch.column(1).to_pylist()
        if not blobs:
            return
        keys = Keys.unpacked(blobs)
        blobs.clear()
        r = keys.shared()
        at = np.flatnonzero(r > 0)
        if len(at):
            out = np.empty(len(at), _SHARED)
            for name in _ID.names:
                out[name] = keys.ids[name][at]
            out["r"] = r[at]
            dest = (mix(out["rid"].view(U64)) % U64(n_parts)).astype(np.int32) if n_parts > 1 else np.zeros(len(at), np.int32)
            order = np.argsort(dest, kind="stable")
            out, dest = out[order], dest[order]
            to = np.flatnonzero(np.diff(dest, append=-1)) + 1
            blobs = [out[a:b].tobytes() for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
            yield _filled({"dest": pa.array(dest[to - 1]), "blob": pa.array(blobs, pa.binary())}, *_SENT_COLUMNS)
        yield _ends(TaskContext.get().partitionId(), *(keys.bytes(keys.end(last)) for last in (False, True)), *_SENT_COLUMNS)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places by text; what holds ends goes through."""
        blobs: list[bytes] = []
        for batch in batches:
            _, blob, part, first, last = (batch.column(k).to_pylist() for k in range(5))
            blobs += [x for x in blob if x is not None]
            for k, x in enumerate(part):
                if x is not None:
                    yield _ends(x, first[k], last[k], *_FOUND_COLUMNS)
        if blobs:
            yield _by_text(np.frombuffer(b"".join(blobs), _SHARED))

    bundled = rows.mapInArrow(sent, "part int, blob binary").repartitionById(len(split) + 1, F.col("part"))
    found = settle(bundled.mapInArrow(run, _SENT).repartitionById(n_parts, F.col("dest")).mapInArrow(gathered, _FOUND))
    ends = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in found.where("part is not null").select("part", "first", "last").collect())
    met = []
    for (_, _, last), (_, first, _) in zip(ends, ends[1:], strict=False):
        if r := _common(last, first):
            for key in (last, first):
                rid, (n, i) = np.frombuffer(key[-16:-8], ">i8"), np.frombuffer(key[-8:], ">u4").tolist()
                met.append((int(rid[0]), n, np.array([i, r], "<u4").tobytes()))
    out = found.where("own is not null").select("rid", "n", "own")
    return out.unionAll(spark.createDataFrame([(r, n, bytearray(own)) for r, n, own in met], "rid long, n long, own binary")) if met else out


def suffix_keys(length: int) -> Callable[[pa.RecordBatch], Keys]:
    """Keys of all suffixes of (rid, n, text); of copies in a batch one's."""

    def make(part: pa.RecordBatch) -> Keys:
        raw, off = texts(part.column(2))
        sums, rid = prefix(raw), part.column(0).to_numpy(zero_copy_only=False)
        tokens, sizes, ids, seen = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, _ID)], set()
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if b - a >= length and (int(rid[k]), b - a) not in seen:
                seen.add((int(rid[k]), b - a))
                t, s = Text(sums, a, b, length).suffixes()
                own = np.zeros(len(t), _ID)
                own["rid"], own["n"], own["i"] = rid[k], b - a, np.arange(len(t))
                tokens.append(t)
                sizes.append(s)
                ids.append(own)
        return Keys.of_tokens(*map(np.concatenate, (tokens, sizes, ids)))

    return make


def _runs(flags: np.ndarray) -> np.ndarray:
    """Begin and end of each run of true, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))


def judge(text: Text, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """What shared tokens say of each window: (repeated, undecided, and of groups: key, begin, end, whether undecided, hash
    of all their windows' bytes)."""
    length, p = text.length, np.arange(text.n - text.length + 1)
    low, high = np.searchsorted(text.all, p, "right") - 1, np.searchsorted(text.all, p + length)
    repeated = shared[np.minimum(low, len(shared) - 1)] >= high - low
    repeated &= (high < len(text.all)) & (high - low <= TOKENS)
    first, last = np.searchsorted(text.inner, p + _REACH), np.searchsorted(text.inner, p + length, "right") - 1
    within = last - first
    possible = within >= 1
    possible[possible] = shared[first[possible] + 1] >= np.minimum(within[possible], TOKENS)
    free = within < 1
    undecided = ~repeated & (possible | free)
    keys, begin, end, open_, whole = [], [], [], [], []

    def group(of: np.ndarray, marks: tuple[np.ndarray, ...], spans: tuple[np.ndarray, np.ndarray], salt: int) -> None:
        if not len(of):
            return
        new = np.concatenate([[True], (np.diff(of) != 1) | np.any([np.diff(m) != 0 for m in marks], axis=0)])
        at = np.flatnonzero(new)
        keys.append(mix(text.hash(spans[0][at], spans[1][at]) ^ U64(salt)).view(np.int64))
        begin.append(of[at])
        end.append(of[np.concatenate([at[1:], [len(of)]]) - 1] + 1)
        open_.append(np.maximum.reduceat(undecided[of], at))
        whole.append(text.hash(begin[-1], end[-1] - 1 + length).view(np.int64))

    if possible.any():
        of = np.flatnonzero(possible)
        group(of, (first[of], last[of]), (text.inner[first[of]], text.inner[last[of]]), 1)
    if free.any():
        fine, of = cuts(text.sums, text.a, text.a + text.n, FINE), np.flatnonzero(free)
        f, l = np.searchsorted(fine, of + _REACH), np.searchsorted(fine, of + length, "right") - 1  # noqa: E741
        some = l > f
        group(of[some], (f[some], l[some]), (fine[f[some]], fine[l[some]]), 2)
        rest = of[~some]
        group(rest, (rest,), (rest, rest + length), 3)
    none = np.zeros(0, np.int64)
    joined = [np.concatenate(x) if x else none for x in (keys, begin, end, open_, whole)]
    return repeated, undecided, *joined


def outcome(raw: bytes, repeated: np.ndarray, length: int) -> tuple[int, int, str]:
    """(bytes removed, maximal runs of them, SHA-256 of the others) when windows begin where ``repeated`` says."""
    if not repeated.any():
        return 0, 0, hashlib.sha256(raw).hexdigest()
    runs = _runs(repeated).reshape(-1, 2)
    begin, end = runs[:, 0], runs[:, 1] - 1 + length
    gone = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(gone, begin, 1)
    np.add.at(gone, end, -1)
    gone = np.cumsum(gone[:-1]) > 0
    left = np.frombuffer(raw, np.uint8)[~gone]
    return int(gone.sum()), len(_runs(gone)) // 2, hashlib.sha256(left.tobytes()).hexdigest()


_JUDGED = "doc_id long, rid long, n long, n_removed long, n_spans long, kept_sha256 string, repeated array<int>, undecided array<int>, keys array<long>, begins array<int>, ends array<int>, opens array<boolean>, wholes array<long>, text binary"


def judged(named: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """A row for each document: its outcome if it is decided, else what is needed to decide it. lists: (rid_, n_, owns, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _JUDGED.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        before = None  # copies come one after the other
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                raw, off = texts(part.column(3))
                sums, rows = prefix(raw), []
                ids, rids, ns, owns, many = (part.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
                for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    head = (ids[k], rids[k], ns[k])
                    if b - a < length:
                        rows.append((*head, *outcome(raw[a:b].tobytes(), np.zeros(0, bool), length), *[None] * 8))
                        continue
                    whole = (b - a, 1, hashlib.sha256(b"").hexdigest())
                    if many[k] and before == (rids[k], ns[k]):
                        rows.append((*head, *whole, *[None] * 8))
                        continue
                    before, own = (rids[k], ns[k]), raw[a:b].tobytes()
                    text = Text(sums, a, b, length)
                    r = np.zeros(len(text.all), dtype=np.int64)
                    if owns[k]:
                        found = places(owns[k])
                        np.maximum.at(r, found[:, 0].astype(np.int64), found[:, 1])
                    repeated, undecided, keys, begin, end, open_, bytes_ = judge(text, r)
                    if many[k]:
                        undecided, open_ = np.zeros(len(repeated), bool), np.zeros(len(open_), bool)
                    done = (None, None, None) if undecided.any() else whole if many[k] else outcome(own, repeated, length)
                    groups = (keys, begin, end, open_.astype(bool), bytes_) if len(keys) else (None,) * 5
                    rows.append((*head, *done, _runs(repeated) if undecided.any() else None, _runs(undecided) if undecided.any() else None, *groups, own if len(keys) else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    joined = named.join(lists, (F.col("rid") == F.col("rid_")) & (F.col("n") == F.col("n_")), "left")
    return joined.select("doc_id", "rid", "n", "text", "owns", F.coalesce("many", F.lit(False))).mapInArrow(run, _JUDGED)


def window_keys(length: int) -> Callable[[pa.RecordBatch], Keys]:
    """Keys of the windows that begin in the spans of (rid, n, text, spans): one token each."""

    def make(part: pa.RecordBatch) -> Keys:
        raw, off = texts(part.column(2))
        sums, rid = prefix(raw), part.column(0).to_numpy(zero_copy_only=False)
        tokens, ids = [np.zeros(0, U64)], [np.zeros(0, _ID)]
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            wanted = np.zeros(b - a, dtype=bool)
            for s in part.column(3)[k].as_py():
                wanted[s["b"] : s["e"]] = True
            p = np.flatnonzero(wanted)
            own = np.zeros(len(p), _ID)
            own["rid"], own["n"], own["i"] = rid[k], b - a, p
            tokens.append(span_hash(sums, a + p, a + p + length))
            ids.append(own)
        t = np.concatenate(tokens)
        return Keys.of_tokens(t, np.ones(len(t), np.int64), np.concatenate(ids))

    return make


def decided(waiting: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The outcome of documents with undecided windows: the windows found repeated among these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, raw, runs, open_, owns in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                size = n - length + 1
                flags = [np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32)]
                for flag, ends in zip(flags, (runs, open_), strict=True):
                    np.add.at(flag, np.array(ends[::2], np.int64), 1)
                    np.add.at(flag, np.array(ends[1::2], np.int64), -1)
                repeated, undecided = (np.cumsum(f[:-1]) > 0 for f in flags)
                hit = np.zeros(size, dtype=bool)
                hit[places(owns or [])[:, 0].astype(np.int64)] = True
                rows.append((doc_id, n, *outcome(raw, repeated | undecided & hit, length)))
            kinds = [pa.int64()] * 4 + [pa.string()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    lists = found.groupBy(F.col("rid").alias("rid_"), F.col("n").alias("n_")).agg(F.collect_list("own").alias("owns"))
    joined = waiting.join(lists, (F.col("rid") == F.col("rid_")) & (F.col("n") == F.col("n_")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "n", "text", "repeated", "undecided", "owns").mapInArrow(run, schema)


def asked(groups: DataFrame) -> DataFrame:
    """(rid_, n_, spans) of the groups that have an undecided member and another. groups: (rid, n, b, e, key, members, open).

    The groups' keys are written, since Spark splits a key of many rows only if shuffles are all that it joins.
    """
    wanted = settle(groups.groupBy("key").agg(F.sum("members").alias("all"), F.max("open").alias("any")).where("all > 1 and any").select(F.col("key").alias("key_")))
    groups = groups.join(wanted, F.col("key") == F.col("key_"))
    return groups.groupBy(F.col("rid").alias("rid_"), F.col("n").alias("n_")).agg(F.collect_set(F.struct("b", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    Null is the empty text. Texts shorter than ``length`` keep all. Repeated rows are copies of each other, so all of
    them lose all that is long enough; null ids are allowed. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    counts = settle(named.groupBy("rid", "n").agg(F.count("*").alias("rows")))
    n_keys = (counts.where(F.col("n") >= length).agg(F.sum("n")).first()[0] or 0) // (COARSE + 1)
    shared = neighbours(named.select("rid", "n", "text"), suffix_keys(length), n_keys)
    many = counts.where("rows > 1").select("rid", "n", F.lit(None).cast("binary").alias("own"))
    lists = shared.unionAll(many).groupBy(F.col("rid").alias("rid_"), F.col("n").alias("n_")).agg(F.collect_list("own").alias("owns"), F.max(F.col("own").isNull()).alias("many"))
    rows = settle(judged(named, lists, length))
    discard(counts)
    groups = rows.where("keys is not null").select("rid", "n", F.explode(F.arrays_zip("keys", "begins", "ends", "opens", "wholes")).alias("g"))
    groups = groups.select("rid", "n", F.col("g.keys").alias("key"), F.col("g.begins").alias("b"), F.col("g.ends").alias("e"), F.col("g.opens").alias("open"), F.col("g.wholes").alias("whole"))
    # Of decided members with the same bytes one stands for all: undecided ones only ask whether there is another.
    same = groups.where("not open").groupBy("key", "whole").agg(F.min(F.struct("rid", "n", "b", "e")).alias("m"), F.count("*").alias("members"))
    same = same.select("m.*", "key", "members", F.lit(False).alias("open"))
    groups = groups.where("open").select("rid", "n", "b", "e", "key", F.lit(1).cast("long").alias("members"), "open").unionAll(same)
    spans = asked(groups)
    chosen = rows.where("text is not null").join(spans, (F.col("rid") == F.col("rid_")) & (F.col("n") == F.col("n_"))).select("rid", "n", "text", "spans")
    chosen = settle(chosen)
    n_windows = chosen.select(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["e"] - s["b"]))).first()[0] or 0
    found = neighbours(chosen, window_keys(length), n_windows)
    done = rows.where("n_removed is not null").select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
    return done.unionAll(decided(rows.where("n_removed is null"), found, length))

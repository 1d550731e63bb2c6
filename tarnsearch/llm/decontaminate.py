"""Benchmark decontamination with spaced seeds.

Tokens are runs of ASCII letters and digits and non-ASCII characters, A-Z as a-z. A seed is the hash of the tokens under
the ones of a fixed mask; the zeros' tokens may differ. Documents' seeds are joined with the benchmark's, and each hit's
alignment of an item with a document is verified around the hit: of the aligned tokens the best stretch is taken, equal
tokens counting 1 and others -MISMATCH, and it is an overlap if it has MIN_TOKENS equal tokens, or of an item for which
that is less a SHARE of its tokens. From the first equal token to the last it is an overlap too if so many are equal and
they are a SHARE of it.

Items of which a SHARE is at most MIN_TOKENS tokens have seeds of their own: with m tokens that may differ an item is cut
into m + 2 parts, and two of them at least are equal, so the seeds are all pairs of parts and none is missed.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own), so
what is broadcast has a bound whatever the benchmark's size; each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._bytes import LOWER, U64, mix, pieces, powers, prefix, span_hash, texts, words

MASKS = ("111010010111", "110110011011", "101101110101")
MIN_TOKENS = 13
SHARE = 0.8
MISMATCH = 3
BLOCK_BYTES = 8 << 20
_BITS = 22
_PIECE = 1 << 20  # bytes of text at a time

FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, index of each text's first token plus a last entry)."""
    folded = FOLD[raw]
    start, end, first = words(folded, off)
    return span_hash(prefix(folded), start, end), first


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each token: the hash of the tokens under the mask's ones."""
    size = max(0, len(h) - len(mask) + 1)
    up, _ = powers(64)
    out = np.zeros(size, dtype=U64)
    for k, one in enumerate(mask):
        if one == "1":
            out += h[k : k + size] * up[k + 1]
    return mix(out + U64(int(mask, 2)))


def needed(n: int) -> int:
    """How many tokens of an item of n tokens must be equal."""
    return min(MIN_TOKENS, math.ceil(SHARE * n - 1e-9))


def own_masks(n: int) -> list[tuple[int, str]]:
    """(first token, mask) of the seeds of a short item of n tokens."""
    parts = np.array_split(np.arange(n), n - needed(n) + 2)
    out = []
    for two in combinations(parts, 2):
        on = np.concatenate(two)
        if len(on):
            out.append((int(on[0]), "".join("1" if k in on else "0" for k in range(on[0], on[-1] + 1))))
    return out


class Block:
    """The seeds of some benchmark items: of the fixed masks at each token, and of short items by their own masks."""

    def __init__(self, items: list[tuple[int | None, str]]):
        raw, off = texts(pa.array([t for _, t in items], pa.string()))
        h, first = tokens(raw, off)
        self.ids = [i for i, _ in items]
        self.items = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeded: dict[str, list[tuple[np.ndarray, int, np.ndarray]]] = {mask: [] for mask in MASKS}
        for i, x in enumerate(self.items):
            for mask in MASKS:
                s = seeds(x, mask)
                seeded[mask].append((s, i, np.arange(len(s))))
            if 0 < len(x) and SHARE * len(x) <= MIN_TOKENS:
                for at, mask in own_masks(len(x)):
                    seeded.setdefault(mask, []).append((seeds(x[at : at + len(mask)], mask), i, np.array([at])))
        self.found = {}
        for mask, found in seeded.items():
            keys = np.concatenate([s for s, _, _ in found]) if found else np.zeros(0, U64)
            item = np.concatenate([np.full(len(s), i) for s, i, _ in found]) if found else np.zeros(0, np.int64)
            place = np.concatenate([p for _, _, p in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")
            bits = max(8, min(_BITS, len(keys).bit_length() + 6))  # a few in a hundred of the places are taken
            likely = np.zeros(1 << bits, dtype=bool)
            likely[keys >> U64(64 - bits)] = True
            self.found[mask] = keys[order], item[order], place[order], likely, U64(64 - bits)

    def alignments(self, h: np.ndarray) -> np.ndarray:
        """Distinct (item, shift) of all hits in a document's tokens; item token j is at document token j + shift."""
        out = []
        for mask, (keys, item, place, likely, shift) in self.found.items():
            s = seeds(h, mask)
            at = np.flatnonzero(likely[s >> shift])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if len(at):
                to = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                out.append(np.stack([item[to], np.repeat(at, n) - place[to]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first document token, tokens, equal tokens) of the best verified overlap with each item."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for i, shift in self.alignments(h).tolist():
            item = self.items[i]
            a, b = max(0, -shift), min(len(item), len(h) - shift)
            equal = item[a:b] == h[a + shift : b + shift]
            gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
            low = np.minimum.accumulate(gain)
            end = int(np.argmax(gain - low))
            begin = int(np.flatnonzero(gain[: end + 1] == low[end])[-1])
            same, least = int(equal[begin:end].sum()), needed(len(item))
            if same < least <= equal.sum():
                on = np.flatnonzero(equal)
                if len(on) >= SHARE * (on[-1] + 1 - on[0]) - 1e-9:
                    begin, end, same = int(on[0]), int(on[-1]) + 1, len(on)
            if same >= least and (i not in best or same > best[i][3]):
                best[i] = i, a + shift + begin, end - begin, same
        return list(best.values())


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's items in blocks; null and empty texts are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total * 2 // block_bytes) if total > block_bytes // 2 else 1
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n if total else 0):
        held, size = [], 0
        for r in (items.where(key == k) if n > 1 else items).toLocalIterator():
            if held and size + len(r[1]) > block_bytes:
                yield Block(held)
                held, size = [], 0
            held.append((r[0], r[1]))
            size += len(r[1])
        if held:
            yield Block(held)


OVERLAP = "doc_id long, item_id long, doc_token long, n_tokens long, n_equal long"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_token, n_tokens, n_equal): each item that a document's whole text overlaps, at its best place.

    Null and empty texts overlap nothing; repeated rows and items give a row each; null ids stay null.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text", _PIECE):
                    h, first = tokens(*texts(part.column(1)))
                    ids, rows = part.column(0).to_pylist(), []
                    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                        rows += [(ids[k], block.ids[i], at, n, same) for i, at, n, same in block.overlaps(h[a:b])]
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "doc_token", "n_tokens", "n_equal"])

        found = chosen.mapInArrow(run, OVERLAP)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], OVERLAP)


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that overlap no item. Each row is judged alone, so no rows move."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, text_col, _PIECE):
                    h, first = tokens(*texts(part.column(at)))
                    clean = [not block.overlaps(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

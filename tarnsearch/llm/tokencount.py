"""Unigram token counts with dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the mark U+2581 in front. Its best segmentation into a vocabulary's pieces is the one of the
highest sum of log probabilities, of equals the one of fewer tokens. A task inserts the distinct pre-tokens of its texts
in a trie; the forward score of a prefix is computed once for all pre-tokens that share it, and the node of a pre-token's
end keeps its count. A character that no piece covers costs one token for each of its UTF-8 bytes, at a score below all pieces.

Any unigram model's pieces and log probabilities can be given. The vocabulary file read here is of another kind, with
ranks and no probabilities; those follow Zipf's law of ranks. Nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnsearch.llm._bytes import pieces as slices
from tarnsearch.llm._bytes import prefix, span_hash, texts, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 2.0
DEEP = 64
NODES = 1_000_000


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece and log probability; control, unknown and byte pieces are left out. Read by the driver, it has a fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1.0 / k for k in range(1, len(names) + 1)))
    return {name: -math.log(k) - total for k, name in enumerate(names, 1)}


class Trie:
    """A trie of pre-tokens whose nodes hold the forward score and the count of their prefix.

    A prefix of up to DEEP characters is scored once for all pre-tokens that share it, in whatever order they come; what
    a longer pre-token has beyond that is scored for itself, in memory that doesn't grow with it.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.floor = min(scores.values(), default=0.0) - BYTE_PENALTY
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}
        self.longest = max(map(len, scores), default=1)
        self.scored = 0
        self.clear()

    def clear(self) -> None:
        """Back to the root: node 0, the empty prefix."""
        self.child: dict[int, int] = {}
        self.best, self.number = [0.0], [0]

    def step(self, token: str, j: int, best: list[float], number: list[int]) -> None:
        """Append the score and the count of the first ``j`` characters to those of shorter prefixes, the last at the end."""
        c = token[j - 1]
        n_bytes = len(c.encode("utf-8", "replace"))
        top, few = best[-1] + self.floor * n_bytes, number[-1] + n_bytes
        for size in self.lengths.get(c, ()):
            if size > j:
                break
            s = self.scores.get(token[j - size : j])
            if s is not None:
                s += best[-size]
                if s > top or s == top and number[-size] + 1 < few:
                    top, few = s, number[-size] + 1
        best.append(top)
        number.append(few)
        self.scored += 1

    def insert(self, token: str) -> int:
        """The node of a pre-token's end; ``number`` and ``best`` have its count and log probability there."""
        node, best, number = 0, [0.0], [0]
        for j, c in enumerate(token[:DEEP], 1):
            edge = node << 21 | ord(c)
            node = self.child.get(edge, 0)
            if node:
                best.append(self.best[node])
                number.append(self.number[node])
            else:
                self.step(token, j, best, number)
                node = self.child[edge] = self._node(best[-1], number[-1])
        if len(token) <= DEEP:
            return node
        for j in range(DEEP + 1, len(token) + 1):
            self.step(token, j, best, number)
            if len(best) > 4 * self.longest + DEEP:
                del best[: -self.longest], number[: -self.longest]
        return self._node(best[-1], number[-1])

    def _node(self, best: float, number: int) -> int:
        self.best.append(best)
        self.number.append(number)
        return len(self.best) - 1


class Counter:
    """Counts of batches of words. The trie of a task's distinct words grows to about NODES nodes, then begins anew."""

    def __init__(self, scores: dict[str, float]):
        self.trie = Trie(scores)
        self.ends: dict[int, int] = {}  # a word's hash and its node

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, log probability) of each text."""
        start, end, first = words(raw, off)
        if not len(start):
            zero = np.zeros(len(off) - 1, np.int64)
            return zero, zero, zero.astype(float)
        own, at, which = np.unique(span_hash(prefix(raw), start, end), return_index=True, return_inverse=True)
        trie, ends, data = self.trie, self.ends, raw.tobytes()
        if len(trie.best) > NODES:
            trie.clear()
            ends.clear()
        nodes = []
        for k, a, b in zip(own.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
            node = ends.get(k)
            if node is None:
                node = ends[k] = trie.insert(MARK + data[a:b].decode("utf-8", "replace"))
            nodes.append(node)
        n, s = np.array([trie.number[x] for x in nodes], np.int64)[which], np.array([trie.best[x] for x in nodes])[which]
        sums, logs = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(s)])
        return np.diff(first), sums[first[1:]] - sums[first[:-1]], logs[first[1:]] - logs[first[:-1]]


def count_tokens(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob) for each row's whole text, repeated rows and null ids too.

    Null, empty and blank texts have 0 of each; an empty table gives one. Columns other than these two don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(scores)
        for batch in batches:
            for part in slices(batch, "text"):
                cols = counter(*texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], ["doc_id", "n_words", "n_tokens", "log_prob"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")

"""Language identification by compression: the language whose dictionary makes a text smallest.

A language's dictionary is raw content for zstandard: whole sample texts of that language, one after the other; all texts
are taken in lower case. A text is
compressed once with each dictionary; the smallest result names the language, and the lead over the second smallest, in
proportion, is the margin. Where it is under ``min_margin`` the row is rejected.

The sample is bounded: SAMPLE_BYTES of text a language, less where over TOTAL_BYTES / SAMPLE_BYTES languages share
TOTAL_BYTES, in seeded hash order; of a longer text it has SAMPLE_TEXT characters from a seeded place. Every language with
a text that isn't empty has a dictionary.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 100_000
SAMPLE_TEXT = 4_096
TOTAL_BYTES = 64 << 20
LEVEL = 9
MIN_MARGIN = 0.01
BITS_A_STEP = 32.0
LETTER = re.compile(r"[^\W\d_]")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionary content by language. Rows without text or language don't count."""
    order = F.xxhash64(F.col(id_col), F.lit(1))
    named = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), order.alias("at")).where("lang is not null and text <> ''")
    begin = F.pmod(F.xxhash64("at", F.lit(2)), F.length("text") - SAMPLE_TEXT + 1).cast("int") + 1
    fit_for = named.select("lang", F.when(F.length("text") > SAMPLE_TEXT, F.substr("text", begin, F.lit(SAMPLE_TEXT))).otherwise(F.col("text")).alias("text"), "at")
    known = fit_for.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    if not known:
        return {}
    sample_bytes = max(8, min(sample_bytes, TOTAL_BYTES // len(known)))
    # Twice the wanted bytes in expectation; each language's sample ends where its budget does.
    wanted = F.create_map(*(x for r in known for x in (F.lit(r[0]), F.lit(min(1.0, (2.0 * sample_bytes + 32 * SAMPLE_TEXT) / r["n"])))))
    found = defaultdict(list)
    share = F.pmod(F.col("at"), F.lit(1 << 30)) / float(1 << 30)
    for lang, t, o in fit_for.where(share < wanted[F.col("lang")]).select("lang", "text", "at").collect():
        found[lang].append((o, t.lower().encode()))
    out = {}
    for lang, sample in sorted(found.items()):
        content = b"\n".join(t for _, t in sorted(sample))[:sample_bytes]
        out[lang] = content if len(content) >= 8 else (content + b"\n") * 8  # zstandard wants 8 bytes at least
    return out


class Compressors:
    """One compressor a language."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.tools = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float, int]:
        """(language or und, score, margin, compressed bytes)."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0, 0
        raw = text.lower().encode()
        sizes = [len(t.compress(raw)) for t in self.tools]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :]
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        score = 1.0 / (1.0 + sum(2.0 ** (-8.0 * (x - sizes[best]) / BITS_A_STEP) for x in others))
        return self.langs[best], score, margin, sizes[best]


def predict(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for each row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, rejected. Ties go to the language first by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(content)
        for batch in batches:
            rows = [tool(x.as_py()) for x in batch.column(1)]
            lang, score, margin, _ = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x < min_margin for x in margin], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the rows whose remainder modulo 4 isn't 2, predict all."""
    content = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    out = predict(docs, content)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")

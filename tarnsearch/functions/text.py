"""Text as column expressions: normal form, tokens, chunks, small helpers."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words, and the rewritten endings (others can't occur: the apostrophe separates tokens).
STOP_WORDS = (
    "is", "am", "are", "was", "were", "be", "been", "being", "the", "a", "an", "in", "on", "at", "to", "and", "or", "but",
    "if", "then", "else", "when", "up", "down", "out", "for", "of", "by", "with", "about",
)
ENDINGS = (("gonna", "going to"), ("wanna", "want to"))

SPACE = r"[\p{Z}\s\x{0b}\x{1c}-\x{1f}\x{85}]"
SEPARATOR = r"[\p{P}\p{Z}\s\x{0b}\x{1c}-\x{1f}\x{85}]"
CHUNK, LEAST_CUT = 256, 121
CHUNK_PATTERN = rf"(?s).{{{LEAST_CUT - 1},{CHUNK - 1}}}[.!?]|.{{1,{CHUNK}}}"


@dataclass(frozen=True)
class TokenOptions:
    """Which tokens count. Single characters are shorter than min_length, unless that is set to 1."""

    min_length: int = 2
    max_length: int = 50
    remove_numbers: bool = False
    remove_single: bool = True


def tokens(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """The valid tokens of a text in order; a token's position is its index here. Null gives an empty array."""
    found = F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda x: _rewritten(F.lower(x)))

    def valid(x: Column) -> Column:
        ok = F.length(x).between(options.min_length, options.max_length) & ~x.isin(*STOP_WORDS)
        if options.remove_single:
            ok &= F.length(x) > 1
        return ok & ~x.rlike(r"^[\d.-]*\d[\d.-]*$") if options.remove_numbers else ok

    return F.filter(found, valid)


def _rewritten(x: Column) -> Column:
    for old, new in ENDINGS:
        x = F.regexp_replace(x, old + "$", new)
    return x


def tokens_of(text: str, options: TokenOptions = TokenOptions()) -> list[str]:
    """The same for one string on the driver, for queries."""
    spaced = "".join(" " if c.isspace() or unicodedata.category(c)[0] == "P" else c for c in text)
    out = []
    for token in spaced.split():
        token = token.lower()
        for old, new in ENDINGS:
            if token.endswith(old):
                token = token[: -len(old)] + new
        if not options.min_length <= len(token) <= options.max_length or token in STOP_WORDS:
            continue
        if options.remove_single and len(token) == 1 or options.remove_numbers and re.fullmatch(r"[\d.-]*\d[\d.-]*", token):
            continue
        out.append(token)
    return out


def normal_text(text: Column) -> Column:
    """Trimmed, with one space for each run of white space."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def chunks(text: Column) -> Column:
    """Chunks of the normal form, which they add up to: CHUNK characters at most, cut after the last terminator that
    leaves LEAST_CUT or more, if there is one."""
    return F.regexp_extract_all(normal_text(F.coalesce(text, F.lit(""))), F.lit(CHUNK_PATTERN), F.lit(0))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; what isn't becomes the replacement character."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def snippet(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def text_path(text: Column) -> Column:
    """The path under which a literal text is a source."""
    return F.concat(F.lit("text_input/"), F.sha2(text, 256), F.lit(".txt"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(url: Column) -> Column:
    """A file name for a URL: each run of other than word characters, or of underscores, becomes one underscore."""
    return F.regexp_replace(url, r"(?U)[\W_]+", "_")

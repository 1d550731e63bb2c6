"""HTML and URLs as column expressions, and a parser-backed variant for malformed pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a URL must not contain, in lower case, to be followed.
BANNED = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".tar", ".rar", "/calendar", "/gallery", "/galeria", "/img", "/image", "/images",
    "?action=", "?session", "?sid=", "?sort=", "?order=", "?filter=", "&action=", "&session", "&sid=", "&sort=", "&order=", "&filter=",
    "logout", "login", "register", "signup",
)
#: (reference, character) of the standard library's table of names; the ampersand is the last.
ENTITIES = (("&#39;", "'"), ("&apos;", "'"), *((f"&{k};", chr(v)) for k, v in sorted(name2codepoint.items()) if k != "amp"), ("&amp;", "&"))

DROPPED = (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?is)<!doctype[^>]*>")
TAG = r"(?s)</?[a-zA-Z][^>]*>"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*|'[^']*|[^\s"'>]+)"""
PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def html_text(html: Column, separator: str = "") -> Column:
    """Text of a page without scripts and styles. With a separator, the trimmed non-empty pieces are joined by it."""
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, "<i>" if separator else "")  # what is dropped parts the text around it
    if not separator:
        return _decoded(F.regexp_replace(out, TAG, ""))
    pieces = F.transform(F.split(out, TAG), lambda x: F.regexp_replace(_decoded(x), r"^[\p{Z}\s]+|[\p{Z}\s]+$", ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), separator)


def _decoded(x: Column) -> Column:
    """Text with its character references replaced: named ones of the standard's table, decimal and hexadecimal ones."""
    names = {k[1:-1]: v for k, v in ENTITIES}
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, "^([a-zA-Z][a-zA-Z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.element_at(table, name))
        return F.when(i == 0, part).when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(name) + 2)))

    return F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), one), "")).otherwise(x)


def links(html: Column) -> Column:
    """The href of each anchor in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.replace(F.regexp_replace(x, "^[\"']", ""), F.lit("&amp;"), F.lit("&")))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps."""
    step = F.split(path, "/")
    last = F.element_at(step, -1)
    kept = F.aggregate(step, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def absolute(href: Column, base: Column) -> Column:
    """A link as an absolute URL of its page's; ``.`` and ``..`` steps of a relative one are followed."""
    scheme, host, path = (F.regexp_extract(base, PARTS, k) for k in (1, 2, 3))
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.rlike(r"(^|/)\.\.?(/|$|[?#])"), F.concat(origin, without_dots(F.concat(folder, F.regexp_extract(href, "^[^?#]*", 0))), F.regexp_extract(href, "[?#].*$", 0)))
        .otherwise(F.concat(origin, folder, href))
    )


def normal_url(url: Column) -> Column:
    """Without fragment and path parameters, scheme and host in lower case, ``/`` for no path, query parts in order."""
    scheme, host, path, query = (F.regexp_extract(url, PARTS, k) for k in (1, 2, 3, 4))
    path = F.regexp_replace(path, r";[^/]*$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    parts = F.array_join(F.array_sort(F.split(query, "&")), "&")
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(query != "", F.concat(F.lit("?"), parts)).otherwise(F.lit("")))
    return F.when(url.rlike(PARTS), whole).otherwise(url)


def in_scope(url: Column, domains: list[str], prefix: str = "") -> Column:
    """Of an allowed domain (port and user are parts of it), and under the path prefix if there is one."""
    host, path = F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3)
    return host.isin(*domains) & (path.startswith(prefix) if prefix else F.lit(True))


def banned(url: Column) -> Column:
    lower = F.lower(url)
    return F.exists(F.array(*map(F.lit, BANNED)), lambda x: F.contains(lower, x))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)


def parse_html(html: str | None, separator: str = "") -> str | None:
    """html_text() of one page by the standard library's parser."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return separator.join(x for x in map(str.strip, parser.pieces) if x) if separator else "".join(parser.pieces)


@F.pandas_udf(StringType())
def html_text_parsed(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For malformed pages, where patterns and a parser differ."""
    for page in pages:
        yield page.map(parse_html)

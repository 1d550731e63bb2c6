import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnsearch.functions import web
from tarnsearch.operators import manifest as mf
from tarnsearch.sources import crawl, files

URLS = [
    ("HTTP://Ex.Com/a;x?b=2&a=1#f", "http://ex.com/a?a=1&b=2"),
    ("https://ex.com", "https://ex.com/"),
    ("https://ex.com:80/p/q", "https://ex.com:80/p/q"),
]


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u, _ in URLS], "u string").select(web.normal_url(F.col("u")).alias("n")).collect()
    assert [r["n"] for r in rows] == [n for _, n in URLS]
    one = spark.createDataFrame([("https://ex.com/docs/x.PDF",), ("https://ex.com/docs/a",), ("https://other.com/docs/a",)], "u string")
    got = one.select(web.banned(F.col("u")).alias("b"), web.in_scope(F.col("u"), ["ex.com"], "/docs").alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False)]


@pytest.mark.parametrize("html", ["<p>a<script>x()</script>b</p>", "<style>p{}</style>t &lt;b&gt; &amp;", "<!-- c -->x<br>y", "a &quot;q&quot; <b>z</b>", ""])
def test_html_agrees_with_the_parser(spark, html):
    row = spark.createDataFrame([(html,)], "h string").select(web.html_text(F.col("h")).alias("p"), web.html_text(F.col("h"), " ").alias("s")).first()
    assert row["p"] == web.parse_html(html)
    assert row["s"] == web.parse_html(html, " ")


def test_crawl_over_several_steps(spark):
    page = lambda *links: "".join(f'<a href="{x}">t</a>' for x in links) + "text"
    rows = [("http://x.y/", page("/a", "b.pdf", "http://other/z")), ("http://x.y/a", page("c", "/")), ("http://x.y/c", page("/d")), ("http://x.y/d", page())]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = crawl.from_pages(pages, "http://x.y/", ["x.y"], max_pages=3)
    assert [r["url"] for r in got.collect()] == ["http://x.y/", "http://x.y/a", "http://x.y/c"]
    served = dict(rows)
    online = crawl.online(spark, "http://x.y/", ["x.y"], lambda u: served[u].encode() if u in served else None)
    assert {r["url"] for r in online.collect()} == set(served)


def test_files_of_all_handlers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.MD").write_text("# mark")
    (tmp_path / "c.html").write_text("<p>x<script>y</script></p>")
    (tmp_path / "skip.bin").write_text("no")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(doc.getvalue())
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "plain �", "b.MD": "# mark", "c.html": "x", "d.docx": "one\ntwo"}
    assert files.dispatch(str(tmp_path)) == "folder" and files.dispatch("http://a/b", True) == "domain" and files.dispatch("words") == "text"
    with pytest.raises(Exception, match="no handler"):
        spark.createDataFrame([("x.bin",)], "p string").select(files.required_handler(F.col("p"))).collect()


def test_every_row_of_the_decision_table(spark):
    manifest = spark.createDataFrame(
        [("same", "h1", 1, 0.0, 1, "m"), ("edited", "h2", 1, 0.0, 2, "m"), ("remodel", "h3", 1, 0.0, 3, "old"), ("gone", "h4", 1, 0.0, 4, "m"), ("nomodel", "h6", 1, 0.0, 6, None)], mf.SCHEMA
    )
    scan = spark.createDataFrame([("same", "h1", 1, 9.0), ("edited", "hx", 1, 9.0), ("remodel", "h3", 1, 9.0), ("copy of same", "h1", 1, 9.0), ("nomodel", "h6", 1, 9.0)], "path string, sha256 string, size long, mtime double")
    changes = mf.diff(scan, manifest, "m")
    got = {r["path"]: (r["action"], r["doc_id"]) for r in changes.collect()}
    assert got == {"same": ("unchanged", 1), "edited": ("changed", 2), "remodel": ("model_changed", 3), "gone": ("missing", 4), "copy of same": ("new", None), "nomodel": ("model_changed", 6)}
    after = mf.applied(manifest, mf.numbered(changes, mf.next_id(manifest)), "m")
    assert {r["path"]: r["doc_id"] for r in after.collect()} == {"same": 1, "edited": 2, "remodel": 3, "copy of same": 7, "nomodel": 6}
    assert mf.diff(scan, manifest, "m", force=True).where("action = 'unchanged'").count() == 0


def test_only_accepted_links_count(spark):
    """A link in scope after 120 others is followed, and pages more than five steps away are reached."""
    many = "".join(f'<a href="http://other{i}/">t</a>' for i in range(120))
    rows = [("http://x.y/", many + "<a href=/d/p0>t</a>text")] + [(f"http://x.y/d/p{i}", f'<a href="../d/./p{i + 1}">t</a>text') for i in range(8)]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = crawl.from_pages(pages, "http://x.y/", ["x.y"])
    assert [r["url"] for r in got.collect()] == ["http://x.y/", *(f"http://x.y/d/p{i}" for i in range(8))]
    assert crawl.from_pages(pages, "http://x.y/", ["x.y"], depth=2).count() == 3


def test_character_references(spark):
    html = "it&#8217;s caf&eacute; &copy; &#x1F600; &nosuch; &amp;lt; a & b &#xD800;"
    assert spark.createDataFrame([(html,)], "h string").select(web.html_text(F.col("h")).alias("t")).first()["t"] == "it’s café © \U0001f600 &nosuch; &lt; a & b &#xD800;"


def test_a_registered_kind_is_dispatched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ADDED", {})
    monkeypatch.setattr(files, "PARSERS", dict(files.PARSERS))
    files.register("upper", lambda content: content.decode().upper(), r"\.up$")
    (tmp_path / "a.UP").write_text("some words")
    (tmp_path / "b.other").write_text("left out")
    assert [(r["path"].rsplit("/", 1)[1], r["text"]) for r in files.read(spark, str(tmp_path)).collect()] == [("a.UP", "SOME WORDS")]

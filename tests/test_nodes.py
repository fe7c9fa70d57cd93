"""Text of selected elements against a parser with a stack."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.sources import nodes


class Stack(HTMLParser):
    """The text within `path`, outermost elements only, without junk; well-formed pages."""

    def __init__(self, path, junk):
        super().__init__()
        self.path, self.junk, self.open, self.out = path, junk, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in nodes.VOID:
            self.open.append((tag, set(dict(attrs).get("class", "").split()), dict(attrs).get("id"), len(self.out) if self.inside() is None else None))
            if self.inside() is not None and self.inside() == len(self.open):
                self.out.append("")

    def handle_endtag(self, tag):
        if tag not in nodes.VOID:
            while self.open and self.open.pop()[0] != tag:
                pass

    def hit(self, element, selector):
        name, _, css = selector.partition(".")
        return (not name or element[0] == name) and (not css or css in element[1])

    def inside(self):
        """How many elements are open up to the one that completes the path."""
        left = list(self.path)
        for i, e in enumerate(self.open):
            if self.hit(e, left[0]):
                left.pop(0)
                if not left:
                    return i + 1
        return None

    def handle_data(self, data):
        if self.inside() and not any(self.hit(e, s) for e in self.open for s in self.junk) and self.open[-1][0] not in ("script", "style"):
            self.out[-1] += "\n" + data


def lines(text):
    return "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)


PAGES = [
    '<main><p>one <b>bold</b> &amp; &#233;&#x4e2d;&#128512;</p><nav><p>menu</p></nav><div><p class="x ad">advert</p><p>two<br>lines</p></div></main><p>outside</p>',
    '<main><section><main><p>nested</p></main><p>after</p></section></main><!-- <p>no</p> --><main><p>second</p></main>',
    "<div><p>no main</p></div>",
    "<main><script>if (a<b) document.write('<p>x</p>')</script><p>a<aside>side<p>deep</p></aside>tail</p></main>",
    "",
]


def test_nodes_equal_a_parser(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)] + [(99, None)], "page_id bigint, html string")
    for path, junk in (("main p", ("nav", "aside")), ("main", ("nav", ".ad", "b")), ("p.ad", ()), ("div p", ("p.ad",))):
        want = set()
        for i, p in enumerate(PAGES):
            parser = Stack(path.split(), junk)
            parser.feed(p)
            want |= {(i, lines(t)) for t in parser.out if lines(t)}
        got = {(r["page_id"], r["text"]) for r in nodes.node_texts(df, "page_id", "html", path, junk, first_only=False).where("text <> ''").collect()}
        assert got == want, path


def test_unclosed_elements_and_ids(spark):
    page = "<div id=top><p>first<p>second</div><div id='main'>third <i>it</i>"
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    text = lambda path: [r["text"] for r in nodes.node_texts(df, "page_id", "html", path).collect()]
    assert text("#top p") == ["first"] and nodes.node_texts(df, "page_id", "html", "#top p", first_only=False).count() == 2
    assert text("#top") == ["first\nsecond"] and text("div#main") == ["third\nit"] and text("#none") == []


def test_best_of_several_selectors(spark):
    page = "<header>short</header><article>" + "long text. " * 30 + "</article><main>" + "long text. " * 30 + "</main>"
    df = spark.createDataFrame([(1, page), (2, "<header>only this</header>"), (3, "<p>nothing</p>")], "page_id bigint, html string")
    score = T.quality_score(F.col("text"), F.lit("a title"))
    got = {r["page_id"]: r["path"] for r in nodes.best_text(df, "page_id", "html", ["header", "article", "main"], score).collect()}
    assert got == {1: "article", 2: "header"}


def test_items_from_detail_pages(spark):
    import datetime as dt

    from loomwright.plans import pipelines as P

    body = "The office said that it would open a new reading room for pupils of the district. " * 3
    html = f'<html><head><title>Site - List</title><meta property="og:title" content="New reading room opens"></head><body><h1>목록</h1><div class="view"><p>New reading room opens</p><p>{body}</p><div class="file">a.hwp</div></div><em>작성일 2026.08.03</em><script>var d = "2001-01-01"</script></body></html>'
    rows = [("s", "Office", "http://o/1", html, "a list title", "", None, False), ("s", "Office", "http://o/2", "<p>nothing</p>", "A title of the list", "2026-08-05", "HEAD\nA title of the list\n" + "file text " * 13, True), ("s", "Office", "http://o/3", None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "sourceId string, source string, url string, html string, listTitle string, listText string, attachment string, preferred boolean")
    got = {r["url"][-1]: r for r in P.detail_items(pages, ["div.view", "main"], (".file",), F.lit(dt.date(2026, 8, 20)), ("목록",)).collect()}
    assert len(got) == 3 and got["1"]["title"] == "New reading room opens" and str(got["1"]["date"]) == "2026-08-03"
    assert got["1"]["summary"] == " ".join(body.split()) and got["1"]["contentOrigin"] == "html" and got["1"]["contentQuality"] > 0
    assert (got["2"]["title"], str(got["2"]["date"]), got["2"]["contentOrigin"], got["2"]["summary"]) == ("A title of the list", "2026-08-05", "attachment", ("file text " * 13).strip())
    assert (got["3"]["title"], str(got["3"]["date"]), got["3"]["summary"]) == ("제목 없음", "2026-08-20", "")
    assert all(r["id"].startswith("s-") and len(r["id"]) == 18 for r in got.values())

"""Page extraction against Python's own HTML parser."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from dwellspark.functions import text
from dwellspark.sources.pages import parse_pages

PAGES = {
    1: """<!DOCTYPE html><html><head><title>Flat in Oval</title><style>p{margin:0}</style><script>var t = "</p>"; var x = {"latitude": 51.48, "lng": "-0.11"};</script></head>
<body><!-- £1 pcm --><h1>Two rooms &amp; garden</h1><p>£1,950 pcm</p><p>SE11 5HY, 700 sq ft or 720 sq. ft</p><a href="/a?x=1">A</a><a class="b" href="/b">B</a><a href="/a#y">A</a>
<dl><dt>Let <b>type</b></dt><dd>Long term</dd><dt>Furnished</dt><dd><i>No</i></dd><dt>Let type</dt><dd>Short</dd></dl><img src="/1.jpg"><img src="/logo.png"><img src="/1.jpg"></body></html>""",
    2: "<title>Weekly</title><p>£350 pw near NW3</p><p>\"lat\": 12.5</p>",
    3: "no tags at all",
    4: "",
    5: None,
}


BLOCKS = {"p", "div", "li", "h1", "dt", "dd", "td", "th", "tr", "title"}


class Reader(HTMLParser):
    """Text of inline elements runs on, blocks end a line, as a browser shows them."""

    def __init__(self):
        super().__init__()
        self.links, self.images, self.labels, self.values, self.within, self.title, self.text = [], [], [], [], [], "", ""

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "a" and own.get("href"):
            self.links.append(own["href"].split("?")[0].split("#")[0])
        if tag == "img":
            self.images += [own["src"]] if "logo" not in own["src"] else []
            return
        if tag in ("dt", "dd"):
            (self.labels if tag == "dt" else self.values).append("")
        self.within.append(tag)

    def handle_endtag(self, tag):
        self.text += "\n" if tag in BLOCKS else ""
        while self.within and self.within.pop() != tag:
            pass

    def handle_data(self, data):
        if "script" in self.within or "style" in self.within:
            return
        self.text += data
        if "title" in self.within:
            self.title += data
        if "dt" in self.within:
            self.labels[-1] += data
        if "dd" in self.within:
            self.values[-1] += data


def test_pages_as_a_parser_reads_them(spark):
    got = {r["url"]: r for r in parse_pages(spark.createDataFrame(list(PAGES.items()), "url long, html string")).collect()}
    for k, html in PAGES.items():
        if html is None:
            continue
        read = Reader()
        read.feed(html)
        read.close()
        assert got[k]["title"] == read.title
        assert got[k]["links"] == list(dict.fromkeys(read.links))
        assert got[k]["images"] == list(dict.fromkeys(read.images))
        first = {}
        for label, value in zip(read.labels, read.values, strict=True):
            first.setdefault(label.lower(), value)
        assert got[k]["details"] == first
        assert got[k]["body"].split() == read.text.split()
    assert [got[k]["monthly"] for k in PAGES] == [1950, 1517, None, None, None]
    assert [got[k]["postcode_district"] for k in PAGES] == ["SE11", "NW3", "", "", None]
    assert (got[1]["size_sqft"], got[1]["latitude"], got[1]["longitude"], got[2]["latitude"]) == (720, 51.48, -0.11, None)


def test_council_tax(spark):
    df = spark.createDataFrame([(1, "council tax band  c"), (2, "Band J"), (3, ""), (4, None), (5, "Bands A")], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(text.council_tax(F.col("t"))).collect()] == ["Band C", "Band J", None, None, "Bands A"]

"""Walks and sections against a tree that is read and walked in plain Python."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from dwellspark.functions import fixed as X
from dwellspark.session import kept
from dwellspark.sources import elements as E
from dwellspark.sources import portals as P

VOID = {"br", "img", "meta", "hr", "input", "link"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []

    def all(self):
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.all()

    def strings(self):
        for x in self.inside:
            if isinstance(x, Node):
                if x.tag not in ("script", "style"):
                    yield from x.strings()
            elif x.strip():
                yield x.strip()

    def text(self, by=""):
        return by.join(self.strings())

    def find(self, *tags):
        return [x for x in self.all() if x.tag in tags]

    def classes(self):
        return self.attrs.get("class", "").split()

    def next_sibling(self, *tags):
        mates = self.parent.inside
        after = mates[next(i for i, x in enumerate(mates) if x is self) + 1 :]
        return next((x for x in after if isinstance(x, Node) and x.tag in tags), None)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def tree(html):
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


def cell_flag(cell):
    for x in cell.find("svg"):
        if "text-success" in x.classes():
            return True
        if "text-danger" in x.classes():
            return False
    for x in cell.find("i", "span"):
        if set(x.classes()) & set(X.TICK_CLASSES):
            return True
        if set(x.classes()) & set(X.CROSS_CLASSES):
            return False
    for x in cell.find("img"):
        said = [(x.attrs.get("src") or x.attrs.get("data-src", "")).lower(), x.attrs.get("alt", "").lower()]
        if any(k in s for s in said for k in X.TICK_IMAGES):
            return True
        if any(k in s for s in said for k in X.CROSS_IMAGES):
            return False
    text = cell.text()
    if any(c in text for c in X.TICK_CHARS):
        return True
    if any(c in text for c in X.CROSS_CHARS):
        return False
    return True if text.lower() in X.TICK_WORDS else False if text.lower() in X.CROSS_WORDS or not text else None


def label(cell):
    for x in cell.find("span"):
        if any("fw-medium" in c for c in x.classes()):
            return x.text()
    if own := " ".join(x.strip() for x in cell.inside if isinstance(x, str) and x.strip()):
        return own
    for x in cell.inside:
        if isinstance(x, Node) and not set(x.attrs) & set(X.TOOLTIP_ATTRS) and not any(k in x.attrs.get("class", "").lower() for k in X.TOOLTIP_CLASSES) and x.text():
            return x.text()
    return cell.text()


def slug(s):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()


def box_rows(box):
    out = {}

    def put(said, flag, text):
        if said and (flag is not None or text):
            out["_".join(slug(said))] = (flag, None if flag is not None else text)

    for tr in box.find("tr"):
        cells = tr.find("th", "td")
        if len(cells) > 1:
            put(label(cells[0]), cell_flag(cells[1]), cells[1].text())
    for dt in box.find("dt"):
        if dd := dt.next_sibling("dd"):
            put(label(dt), cell_flag(dd), dd.text())
    for div in box.find("div"):
        spans = div.find("span")
        if any("d-flex" in c for c in div.classes()) and spans:
            put(spans[0].text(), cell_flag(div), " ".join(s.text() for s in spans[1:] if s.text()))
    return out


def sections(root):
    out = {}
    for h in root.find("h2", "h3", "h4", "b", "strong"):
        section = next((s for s, names in X.SECTIONS.items() if h.text().lower().strip() in names), None)
        if section and (box := h.next_sibling("table", "dl", "div", "section", "ul")) and (rows := box_rows(box)):
            out.setdefault(section, {}).update(rows)
    if not out:
        for k, v in box_rows(root).items():
            if home := next((s for s, labels in X.SECTION_LABELS.items() if k in labels), None):
                out.setdefault(home, {})[k] = v
    return out


LABELS = ["Deposit", "Bills Included", "Available From", "Pets allowed", "Garden", "Cycle store", "EPC Rating", "DSS / LHA Covers Rent", "Rent PCM"]
VALUES = ['<svg class="text-success or-icon"/>', '<svg class="or-icon text-danger"></svg>', '<i class="fa fa-check"></i>', '<span class="fa fa-times"></span> gone', '<img src="/tick.png">', '<img data-src="/x.svg" alt="Cross">', "✓", "✗ none", "Yes", "not included", "", "£1,200.00", "Band C", "12 <b>months</b>", '<table><tr><td>Inner<td>deep</td></tr></table>']


def random_page(rng):
    def say(x):
        way = rng.randrange(5)
        return [x, f'<span class="fw-medium x">{x}</span> <a data-content="t">?</a>', f'<a data-toggle="tooltip">hint</a><em>{x}</em>', f'<div class="help">why</div><p>{x}</p>', f"{x} <b>more</b>"][way]

    def box():
        rows = [(say(rng.choice(LABELS)), rng.choice(VALUES)) for _ in range(rng.randint(0, 5))]
        kind = rng.randrange(4)
        if kind == 0:
            return "<table>" + "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in rows) + "<tr><td>alone</td></tr></table>"
        if kind == 1:
            return "<dl>" + "".join(f"<dt>{a}</dt>{rng.choice(['', '<hr>'])}<dd>{b}</dd>" for a, b in rows) + "<dt>last</dt></dl>"
        if kind == 2:
            return "<div>" + "".join(f'<div class="x d-flex"><span>{a}</span><span>{b}</span><span>{rng.choice(["", "2 beds"])}</span></div>' for a, b in rows) + "</div>"
        return f"<div>{box()}<section>{box()}</section></div>"

    parts = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.7:
            tag = rng.choice(["h2", "h3", "b", "strong"])
            parts.append(f"<{tag}>{rng.choice(['Price &amp; Bills', 'Availability', ' tenant preferences ', 'Features', 'Other', 'Property Features'])}</{tag}>")
        parts.append(rng.choice(["", "<p>between</p>", "loose text <i>", "</i>", "<!-- x -->", "</div>", "<div>", "<script>var a = '<td>';</script>"]))
        parts.append(box())
    return "<html><body>" + "".join(parts) + rng.choice(["</body></html>", ""])


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = [(i, random_page(rng)) for i in range(150)] + [(900, ""), (901, None), (902, "no tags"), (903, "<p>" * 3000 + "deep"), (904, "<![bad[ x ]]> <b>late</b>")]
    return spark.createDataFrame(rows, "page_id long, html string").repartition(3).cache()


def test_nodes(spark, pages):
    got = {}
    for r in E.elements(pages).orderBy("page_id", "node").collect():
        got.setdefault(r["page_id"], []).append(r)
    for r in pages.filter("page_id < 900").collect():
        want = []

        def walk(x, parent, want=want):
            for y in x.inside:
                at = len(want)
                if isinstance(y, Node):
                    want.append([parent, None, y.tag, y.attrs, None])
                    walk(y, at)
                    want[at][1] = len(want) - 1
                elif y.strip():
                    want.append([parent, at, "#code" if x.tag in ("script", "style") else "#text", None, y.strip()])

        walk(tree(r["html"]), -1)
        assert [[g["parent"], g["last"], g["tag"], g["attrs"], g["text"]] for g in got.get(r["page_id"], [])] == want
    assert len(got[903]) == 3001 and 900 not in got and 901 not in got and [g["text"] for g in got[902]] == ["no tags"]


def test_sections(spark, pages):
    nodes = kept(E.elements(pages), "nodes")
    got = {r["page_id"]: {s: {k: tuple(v) for k, v in m.items()} for s, m in r["sections"].items()} for r in P.page_sections(nodes, "page_id").collect()}
    want = {r["page_id"]: s for r in pages.filter("html is not null and page_id < 903").collect() if (s := sections(tree(r["html"])))}
    assert got == want and len(want) > 60 and any(v == (None, "£1,200.00") for s in want.values() for m in s.values() for v in m.values())


FIRST = """<html><body><div><h1>Flat,&nbsp; Oval</h1><p>Oval Road, SE11</p><span>Reduced, £950 pw</span><p>Tenancy info, here</p></div>
<div class="box"><div><div><div><p>£1,950 pcm</p></div></div></div><h2>Key features</h2><ul><li>Garden <b>big</b></li><li>Garden <b>big</b></li><li></li><li>Lift</li><li>%s</li></ul>
<h2>Full Description</h2><p>Read more</p><p>Two rooms. read more<br>And&nbsp; a hall.</p><div><p>Third</p><p>part</p></div>loose<p>Brochure 1</p><h3>Next</h3><p>not this</p></div>
<div>PROPERTY TYPE<p>Studio </p><p>BATHROOMS</p>2</div>Added on 05/01/2024 · 450 sq ft or 1,450 sq. ft
<p>NEAREST STATIONS</p><ul><li>Oval Station</li><li>0.4 miles</li><li>Vauxhall 0.2 miles</li><li>Type: tube</li><li>0.3 miles</li><li>Kennington</li><li>State School | Ofsted: Good</li><li>0.4 miles</li><li>Oval Station</li><li>0.4 miles</li></ul><p>To check broadband</p><p>Late 0.1 miles</p>
<p>Nearest Schools</p><p>St Anne's 1 mile</p></body></html>""" % ("x" * 201)


def test_first_portal(spark):
    rows = [(1, FIRST), (2, "<h2>B</h2><h1>A</h1><p>no price</p>"), (3, None), (4, "<h2>Description</h2>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    nodes = kept(E.elements(df), "nodes")
    got = {r["page_id"]: r for r in P.first_portal(df, nodes, "page_id").collect()}
    r = got[1]
    assert (r["title"], r["address"], r["key_features"]) == ("Flat, Oval", "Oval Road, SE11", ["Garden big", "Lift"])
    assert r["description"] == "Two rooms. <PARA> And a hall. <PARA> Third <PARA> part <PARA>"
    assert (r["property_type"], r["bedrooms"], r["bathrooms"], r["size_sqft"], r["added_date"]) == ("Studio", 0, 2, 1450, "2024-01-05")
    assert (got[2]["title"], got[2]["address"], got[2]["description"], got[3]["title"], got[4]["description"]) == ("A", None, None, None, None)
    near = {r["page_id"]: r for r in P.nearby_places(nodes, "page_id", {"stations": "nearest stations", "schools": "NEAREST SCHOOLS", "other": "nowhere"}).collect()}
    assert [tuple(x) for x in near[1]["stations"]] == [("Vauxhall", 0.2), ("Oval Station", 0.4), ("Kennington", 0.4)]
    assert [tuple(x) for x in near[1]["schools"]] == [("St Anne's", 1.0)] and near[1]["other"] == [] and near[2]["stations"] == []


SECOND = """<html><head><title>T</title><script type="application/ld+json">{"description": "%s"}</script></head><body><h1>2 Bed Flat, N1</h1><ul><li>2bedrooms</li><li><b>1</b> bathroom</li><li>3 tenants max</li></ul>
<div>Rent PCM: £2,100.00 or <i>£484.62 pw</i></div><h3>Price &amp; Bills</h3><table><tr><td>Deposit</td><td>£2,423.07</td></tr><tr><td>Bills Included</td><td>✗</td></tr></table>
<h3>Availability</h3><dl><dt>Available From</dt><dd>03 April, 2026</dd><dt>Minimum Tenancy</dt><dd>N/A</dd><dt>Online viewings</dt><dd>Yes</dd></dl>
<h3>Features</h3><div><div class="d-flex"><span>Garden</span><svg class="text-success"/></div><div class="d-flex"><span>Furnishing</span><span>unfurnished or PART</span></div><div class="d-flex"><span>EPC Rating</span><span>c (69)</span></div><div class="d-flex"><span>Cycle Store</span><span>shared</span></div></div>
<p class="description-text">Short.</p><b>Property Details</b><ul><li>Lift</li><li>Porter</li></ul><b>Transport</b><ul><li>Angel~4 min. walk</li><li>Old Street | 0.6 miles</li><li>Bus</li></ul><div data-lat="51.531" data-lng="-0.105"></div></body></html>""" % ("A long description of the flat. " * 3)


def test_second_portal(spark):
    rows = [(1, SECOND), (2, "<p>From £950 a month</p>" + "<p>" + "Long enough to be read. " * 5 + "</p>"), (3, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r.asDict(True) for r in P.second_portal(df, kept(E.elements(df), "nodes"), "page_id").collect()}
    r = got[1]
    assert (r["price_pcm"], r["price_pw"], r["price_display"]) == (2100, 484, "£484 pw £2,100 pcm")
    assert (r["deposit"], r["deposit_amount"], r["bills_included"], r["available_text"], r["min_tenancy"], r["online_viewings"]) == ("£2,423.07", 2423, False, "03 April, 2026", "ask agent", True)
    assert (r["bedrooms"], r["bathrooms"], r["property_type"], r["furnish_type"], r["epc_rating"], r["garden"], r["parking"], r["max_tenants"]) == (2, 1, "Flat", "Unfurnished or part", "C", True, None, 3)
    assert (r["latitude"], r["longitude"], r["extras"]) == (51.531, -0.105, {"cycle_store": "shared"})
    assert r["description"] == ("A long description of the flat. " * 3).strip() and r["features"] == ["Lift", "Porter"]
    assert r["stations"] == [{"name": "Angel", "miles": 0.2}, {"name": "Old Street", "miles": 0.6}]
    r = got[2]
    assert (r["price_pcm"], r["price_display"], r["deposit"], r["council_tax"], r["bedrooms"], r["stations"], r["extras"]) == (950, "£950 pcm", "ask agent", "ask agent", None, None, {})
    assert r["description"].startswith("Long enough") and got[3]["price_pcm"] is None


def test_texts_of_fields(spark):
    df = spark.createDataFrame([("£350 per week", "http://x.org/to-let/flat/123/ "), ("ask", "http://x.org/a/b"), ("£1,200", "x")], "p string, u string")
    monthly, weekly, shown = P.price_of(F.col("p"))
    assert [tuple(r) for r in df.select(monthly, weekly, shown).collect()] == [(350, 350, "£350 pw £350 pcm"), (None, None, "ask agent"), (1200, None, "£1,200 pcm")]
    assert [r[0] for r in df.select(P.listing_id(F.trim("u"), "b")).collect()] == ["b:123", "b:b", "b:x"]


def test_plain_pages_are_read_as_the_parser_reads_them():
    """Pages of plain tags take a shorter way, all others the parser's."""
    rng = random.Random(5)
    plain = ["<p>", "</p>", "<div class='a b'>", "</div>", "text", " ", "a &amp; b", "&amp", "&lt;x", "&", "<br>", "<br/>", "<img src='/x.png' alt=\"y\">", "<svg class=\"or\"/>", "<li>", "</li>", "</span>", "<td\n a='1' a='2'>", "<template>", "</template>", "é ", "<p a=''>"]
    odd = ["<!-- c -->", "<b x>", "< ", "<script>", "</script>", "<title>", "</>", "<P>", "<a href=\"/u?x=1&y\">", "<br / >"]
    short = 0
    for _ in range(3000):
        html = "".join(rng.choice(plain if rng.random() < 0.97 else odd) for _ in range(rng.randint(0, 14)))
        reader = E._Reader()
        reader.feed(html)
        reader.close()
        reader._text()
        reader._close(0)
        assert E.read_nodes(html) == reader.rows
        if (found := E.plain_nodes(html)) is not None:
            short += 1
            assert found == reader.rows
    assert 1000 < short < 3000


def test_texts_inside_meet_no_row_each(spark):
    """A page's texts are one row: what stands inside an element is taken from it, and no row is made for each text."""
    pages = spark.createDataFrame([(1, "<div>a<p>b</p><p></p>c</div>d"), (2, "<p></p>")], "page_id long, html string")
    nodes = E.kept_elements(pages)
    chosen = E.tags(nodes, "div", "p").select("page_id", "node", "last")
    said = E.with_texts(chosen.union(chosen), nodes, "page_id")
    assert sorted((r["page_id"], r["node"], r["texts"]) for r in said.collect()) == [(1, 0, ["a", "b", "c"]), (1, 2, ["b"]), (1, 4, []), (2, 0, [])]
    assert "collect_set" not in said._jdf.queryExecution().optimizedPlan().toString()

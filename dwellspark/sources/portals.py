"""Listing fields by walks over the element tables of two portals' pages.

The first portal's pages are read by walks: back from the price to the address, along the
siblings of a heading until the next one, down the list of key features.  The second's
hold named sections of nested rows (tables, definition lists, flex boxes), which become a
map of sections to maps of labels to (flag, text): a cell's tick is true, its cross or
nothing at all is false, other text is no flag.

Everything takes a table of nodes (see ``elements``), written once by the caller
(``session.kept``), and joins it with itself by page and place.  What several parts of a
plan need is kept too, so some functions run jobs while the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text
from .. import session
from . import elements as E

CELL = "struct<flag:boolean,text:string>"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once, and never broadcast: a table of pages' parts that is small on disk holds many rows."""
    return session.kept(df, name).hint("merge")


def joined(column: str, by: str) -> Column:
    return F.array_join(column, by)


def one_line(c: Column) -> Column:
    """Single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, " ", " "), r"\s+", " "))


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def page_texts(nodes: DataFrame, key: str) -> DataFrame:
    """key and the array of a page's texts in order (``texts``)."""
    return E.texts_of(nodes, key).select(key, F.transform("_texts", lambda x: x["text"]).alias("texts"))


# ---- walks


def address(nodes: DataFrame, key: str) -> DataFrame:
    """key, address: going back from the block of the price, the first text of a block that has a comma or looks like a postcode's district."""
    prices = nodes.filter(F.col("tag") == E.TEXT).filter(F.col("text").rlike(r"(?i)\b(?:pcm|pw)\b"))
    order = Window.partitionBy(key).orderBy(F.when(F.col("text").rlike(r"(?i)\bpcm\b"), 0).otherwise(1), "node")
    price = prices.withColumn("r", F.row_number().over(order)).filter("r = 1").select(key, F.col("node").alias("price"))
    # its parent, and four steps up from there, or as far as there are any
    above = price.join(E.tags(nodes).select(key, "node", "last"), key).filter((F.col("node") < F.col("price")) & (F.col("price") <= F.col("last")))
    up = above.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("node")))).filter("step <= 5")
    block = up.groupBy(key).agg(F.min("node").alias("block"))
    before = block.join(E.tags(nodes, "div", "span", "p", "h1", "h2", "h3").select(key, "node", "last"), key).filter(F.col("node") < F.col("block"))
    said = E.with_texts(before, nodes, key).withColumn("address", one_line(joined("texts", " ")))
    fits = F.col("address").contains(",") | F.col("address").rlike(r"\b[A-Z]{1,2}[0-9]{1,2}[A-Z]?\b")
    good = said.filter(fits & ~F.col("address").rlike(r"(?i)£\s*[0-9,]+\s*(pcm|pw)") & ~F.lower("address").contains("tenancy info"))
    return good.groupBy(key).agg(F.max_by("address", "node").alias("address"))


def heading(nodes: DataFrame, key: str, words: str) -> DataFrame:
    """key, parent, node, last of each page's first heading that says so."""
    said = E.with_texts(E.tags(nodes, "h2", "h3", "h4").select(key, "parent", "node", "last"), nodes, key)
    return E.first_of(said.filter(F.lower(joined("texts", " ")).contains(words)), key).drop("texts")


def description(nodes: DataFrame, key: str) -> DataFrame:
    """key, description: the lines of what follows the heading up to the next one, without the words of controls, up to the brochures."""
    parts = E.siblings_until(heading(nodes, key, "description"), nodes, F.col("tag").isin("h2", "h3", "h4"), key)
    said = E.with_texts(parts, nodes, key)
    clean = lambda line: reduce(lambda c, w: F.trim(F.regexp_replace(c, rf"(?i)\b{w}\b", "")), X.DESCRIPTION_NOISE, line)
    lines = F.flatten(F.transform("texts", lambda t: F.split(t, "\n")))
    kept = F.filter(F.transform(F.filter(F.transform(lines, one_line), lambda x: ~F.lower(x).isin(*X.DESCRIPTION_NOISE)), clean), lambda x: x != "")
    each = said.select(key, "node", F.array_join(kept, X.PARAGRAPH).alias("part")).filter("part <> ''")
    whole = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "part"))), lambda x: x["part"]), X.PARAGRAPH).alias("d"))
    cut = F.trim(F.regexp_replace("d", r"(?is)\bBrochures?\b.*$", ""))
    return whole.select(key, F.nullif(cut, F.lit("")).alias("description"))


def key_features(nodes: DataFrame, key: str) -> DataFrame:
    """key, key_features: the distinct items, in order, of the element after the heading, but for very long ones."""
    start = heading(nodes, key, "key features").select(key, F.col("node").alias("start"))
    after = start.join(E.tags(nodes).select(key, "node", "last"), key).filter(F.col("node") > F.col("start"))
    box = E.first_of(after, key).select(key, "node", "last")
    items = E.within(box, E.tags(nodes, "li").select(key, "node", "last"), key).select(key, "inner.*")
    said = E.with_texts(items, nodes, key).withColumn("item", one_line(joined("texts", " "))).filter((F.col("item") != "") & (F.length("item") <= X.LONGEST_FEATURE))
    found = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "item"))).alias("f"))
    return found.select(key, F.array_distinct(F.transform("f", lambda x: x["item"])).alias("key_features"))


def specs(nodes: DataFrame, key: str) -> DataFrame:
    """key, property_type, bedrooms, bathrooms (lines under their headings; a studio has no bedroom unless one is given), size_sqft, added_date (ISO)."""
    said = page_texts(nodes, key).select(key, F.array_join("texts", "\n").alias("lines"), F.array_join("texts", " ").alias("line"))
    under = lambda head, value: F.nullif(F.regexp_extract("lines", rf"(?i){head}\s*\n({value})", 1), F.lit(""))
    kind = one_line(under("PROPERTY TYPE", r"[^\n]+"))
    beds = under("BEDROOMS", r"\d+").try_cast("int")
    added = F.regexp_extract("line", r"Added on\s+(\d{2}/\d{2}/\d{4})", 1)
    return said.select(
        key,
        kind.alias("property_type"),
        F.coalesce(beds, F.when(F.lower(kind) == "studio", 0)).alias("bedrooms"),
        under("BATHROOMS", r"\d+").try_cast("int").alias("bathrooms"),
        text.largest_size(F.col("line"), "sq\\.?\\s*ft").alias("size_sqft"),
        F.when(added != "", F.concat_ws("-", F.substring(added, 7, 4), F.substring(added, 4, 2), F.substring(added, 1, 2))).alias("added_date"),
    )


def first_portal(pages: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """A row for each page: the fields that walks give, null where a page lacks them."""
    titles = E.first_of(E.tags(nodes, "h1", "h2").withColumn("node", F.col("node") + F.when(F.col("tag") == "h2", 1 << 30).otherwise(0)), key)
    title = E.with_texts(titles.select(key, (F.col("node") % (1 << 30)).cast("int").alias("node"), "last"), nodes, key).select(key, one_line(joined("texts", " ")).alias("title"))
    out = pages.select(key)
    for part in (title, address(nodes, key), description(nodes, key), key_features(nodes, key), specs(nodes, key)):
        out = out.join(part.hint("merge"), key, "left")
    return out


# ---- places nearby


def nearby(lines: Column, head: str) -> Column:
    """array<struct<name, miles>> of the places listed after the line that holds ``head``, nearest first and once each.

    A line is a name with miles, or a name whose miles stand in the next line that has nothing
    else.  Kinds and ratings are passed over; the list ends at the notes that follow it.
    """
    row = "struct<name:string,miles:double>"
    low = lambda x: F.lower(x)
    clean = F.filter(F.transform(lines, one_line), lambda x: x != "")
    after = text.let(clean, lambda a: text.let(F.array_position(F.transform(a, lambda x: low(x).contains(head.lower())), True), lambda at: F.when(at > 0, F.slice(a, at + 1, F.greatest(F.size(a), F.lit(1)))).otherwise(F.array().cast("array<string>"))))
    ends = lambda x: low(x).contains("ofsted information displayed") | low(x).contains("show more on map") | low(x).startswith("to check broadband") | low(x).startswith("council tax")
    kinds = lambda x: reduce(lambda a, b: a | b, [low(x).startswith(k) for k in X.NEARBY_KINDS])
    passed = lambda x: kinds(x) | (x.contains(" | ") & (low(x).contains("ofsted") | low(x).contains("state school")))
    name = lambda x: ~low(x).contains(" miles") & ~x.contains(" | ") & ~x.contains(":") & (F.length(x) > 2) & (F.length(x) < 120) & ~low(x).startswith("nearest ")
    start = F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("name"), F.array().cast(f"array<{row}>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        """s: whether the list is over, the name that waits for its miles, what was found."""
        state = lambda over, waits, found: F.struct(over.alias("over"), waits.alias("name"), found.alias("found"))
        whole, miles = r"(?i)^(.+?)\s+(\d+(?:\.\d+)?)\s*miles?$", r"(?i)^(\d+(?:\.\d+)?)\s*miles?$"
        none = F.lit(None).cast("string")
        add = lambda n, m: F.concat(s["found"], F.array(F.struct(one_line(n).alias("name"), m.cast("double").alias("miles"))))
        return (
            F.when(s["over"] | low(x).isin(*X.NEARBY_STOPS), s)
            .when(ends(x), state(F.lit(True), s["name"], s["found"]))
            .when(passed(x), s)
            .when(x.rlike(whole), state(F.lit(False), none, add(F.regexp_extract(x, whole, 1), F.regexp_extract(x, whole, 2))))
            .when(x.rlike(miles) & s["name"].isNotNull(), state(F.lit(False), none, add(s["name"], F.regexp_extract(x, miles, 1))))
            .when(name(x), state(F.lit(False), x, s["found"]))
            .otherwise(s)
        )

    done = F.aggregate(after, start, step, lambda s: s["found"])
    good = F.filter(done, lambda r: (r["name"] != "") & ~kinds(r["name"]) & ~low(r["name"]).isin(*X.NEARBY_STOPS))
    first = F.array_distinct(good)
    # by miles, equal ones as they stand
    placed = F.transform(first, lambda r, i: F.struct(r["miles"].alias("miles"), i.alias("i"), r["name"].alias("name")))
    return F.transform(F.array_sort(placed), lambda r: F.struct(r["name"].alias("name"), r["miles"].alias("miles")))


def nearby_places(nodes: DataFrame, key: str, heads: dict[str, str]) -> DataFrame:
    """key and for each head (column: words) the places listed under it."""
    said = page_texts(nodes, key).withColumn("lines", F.flatten(F.transform("texts", lambda t: F.split(t, "\n"))))
    return said.select(key, *(nearby(F.col("lines"), words).alias(column) for column, words in heads.items()))


# ---- sections


def cell_flags(cells: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, node, flag, text of cells (key, node, last). Icons go by kind (drawings, then marks, then images), then order; then what the text says."""
    own = cells.select(key, "node", "last").distinct()
    icons = E.tags(nodes, "svg", "i", "span", "img").select(key, "node", "tag", "attrs")
    has = lambda names: F.arrays_overlap(E.classes(), F.array(*map(F.lit, names)))
    attr = lambda name: F.lower(F.coalesce(F.nullif(F.col("attrs")[name], F.lit("")), F.lit("")))
    image = F.concat(F.coalesce(F.nullif(attr("src"), F.lit("")), attr("data-src")), F.lit("\n"), attr("alt"))
    verdict = (
        F.when(F.col("tag") == "svg", F.when(has(("text-success",)), True).when(has(("text-danger",)), False))
        .when(F.col("tag").isin("i", "span"), F.when(has(X.TICK_CLASSES), True).when(has(X.CROSS_CLASSES), False))
        .when(any_of(image, X.TICK_IMAGES), True)
        .when(any_of(image, X.CROSS_IMAGES), False)
    )
    rank = F.when(F.col("tag") == "svg", 0).when(F.col("tag") == "img", 2).otherwise(1)
    marked = icons.select(key, "node", rank.alias("rank"), verdict.alias("flag")).filter("flag is not null")
    seen = E.within(own, marked, key).groupBy(key, "node").agg(F.min(F.struct("inner.rank", "inner.node", "inner.flag")).alias("m")).select(key, "node", F.col("m.flag").alias("icon"))
    said = E.with_texts(own, nodes, key).join(seen, [key, "node"], "left").withColumn("text", joined("texts", ""))
    low = F.lower("text")
    words = F.when(any_of(F.col("text"), X.TICK_CHARS), True).when(any_of(F.col("text"), X.CROSS_CHARS), False).when(low.isin(*X.TICK_WORDS), True).when(low.isin(*X.CROSS_WORDS), False).when(low == "", False)
    return said.select(key, "node", F.coalesce("icon", words).alias("flag"), "text")


def label_texts(cells: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, node, label of cells: the span that is set as a label, else the cell's own text, else the first child that is no hint, else all of it."""
    own = cells.select(key, "node", "last").distinct()
    spans = E.tags(nodes, "span").filter(E.has_class("fw-medium")).select(key, "node", "last")
    set_ = E.within(own, spans, key).groupBy(key, "node").agg(F.min(F.struct("inner.node", "inner.last")).alias("s")).select(key, F.col("node").alias("cell"), F.col("s.node").alias("node"), F.col("s.last").alias("last"))
    first = E.with_texts(set_, nodes, key).select(key, F.col("cell").alias("node"), joined("texts", "").alias("set"))
    direct = own.join(nodes.filter(F.col("tag") == E.TEXT).select(key, F.col("parent").alias("node"), F.col("node").alias("at"), "text"), [key, "node"])
    second = direct.groupBy(key, "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("direct"))
    hint = F.exists(F.map_keys("attrs"), lambda k: k.isin(*X.TOOLTIP_ATTRS)) | any_of(F.lower(F.coalesce(F.col("attrs")["class"], F.lit(""))), X.TOOLTIP_CLASSES)
    child = E.tags(nodes).filter(~hint).select(key, F.col("parent").alias("cell"), "node", "last")
    children = child.join(own.select(key, F.col("node").alias("cell")), [key, "cell"])
    third = E.with_texts(children, nodes, key).withColumn("t", joined("texts", "")).filter("t <> ''").groupBy(key, "cell").agg(F.min_by("t", "node").alias("child")).withColumnRenamed("cell", "node")
    all_ = E.with_texts(own, nodes, key).select(key, "node", joined("texts", "").alias("whole"))
    met = all_.join(first, [key, "node"], "left").join(second, [key, "node"], "left").join(third, [key, "node"], "left")
    return met.select(key, "node", F.coalesce("set", "direct", "child", "whole").alias("label"))


def rows_of(boxes: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, box, family, place, slug, flag, text: the rows inside boxes (key, node, last). Families: table rows, definition lists, flex boxes."""
    box = boxes.select(key, F.col("node").alias("box"), "node", "last")
    pick = lambda names, more=(): E.tags(nodes, *names).select(key, "node", "last", "parent", *more)
    inside = lambda df: E.within(box, df, key).select(key, "box", "inner.*")
    lines = inside(pick(("tr",)))
    cells = E.within(lines, pick(("th", "td")), key).groupBy(key, "box", "node").agg(F.array_sort(F.collect_list(F.struct("inner.node", "inner.last"))).alias("c")).filter(F.size("c") >= 2)
    pair = lambda family, place, a, a_last, b, b_last: (F.lit(family).alias("family"), place.alias("place"), a.alias("label_node"), a_last.alias("label_last"), b.alias("node"), b_last.alias("last"))
    c = F.col
    tabled = cells.select(key, "box", *pair(0, c("node"), c("c")[0]["node"], c("c")[0]["last"], c("c")[1]["node"], c("c")[1]["last"]))
    terms = inside(pick(("dt",)))
    listed = terms.join(E.next_sibling(terms, pick(("dd",)), key), [key, "node"]).select(key, "box", *pair(1, c("node"), c("node"), c("last"), c("next"), c("next_last")))
    flex = inside(E.tags(nodes, "div").filter(E.has_class("d-flex")).select(key, "node", "last", "parent"))
    spans = E.within(flex, pick(("span",)), key).groupBy(key, "box", "node", "last").agg(F.min(F.struct("inner.node", "inner.last")).alias("s"))
    boxed = spans.select(key, "box", *pair(2, c("node"), c("s.node"), c("s.last"), c("node"), c("last")))
    pairs = kept(tabled.union(listed).union(boxed).distinct(), "pairs")
    # labels: as cells say them, in flex boxes the whole first span
    plain = pairs.filter("family < 2").select(key, c("label_node").alias("node"), c("label_last").alias("last"))
    said = label_texts(plain, nodes, key).select(key, F.lit(False).alias("flex"), c("node").alias("label_node"), "label")
    whole = E.with_texts(pairs.filter("family = 2").select(key, c("label_node").alias("node"), c("label_last").alias("last")).distinct(), nodes, key)
    labels = said.union(whole.select(key, F.lit(True).alias("flex"), c("node").alias("label_node"), joined("texts", "").alias("label")))
    values = cell_flags(pairs, nodes, key).select(key, "node", "flag", "text")
    # the text of a flex box is that of its other spans
    others = E.within(pairs.filter("family = 2").select(key, "node", "last", "label_node"), pick(("span",)), key).filter(c("inner.node") != c("label_node")).select(key, c("node").alias("flex_node"), "inner.node", "inner.last")
    beside = E.with_texts(others, nodes, key).withColumn("t", joined("texts", "")).filter("t <> ''").groupBy(key, c("flex_node").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "t"))), lambda x: x["t"]), " ").alias("beside"))
    met = pairs.withColumn("flex", c("family") == 2).join(labels, [key, "flex", "label_node"]).join(values, [key, "node"]).join(beside, [key, "node"], "left")
    out = met.withColumn("text", F.when(c("flex"), F.coalesce("beside", F.lit(""))).otherwise(c("text"))).filter((c("label") != "") & (c("flag").isNotNull() | (c("text") != "")))
    return out.select(key, "box", "family", "place", text.slug(c("label")).alias("slug"), "flag", F.when(c("flag").isNull(), c("text")).alias("text"))


def section_rows(nodes: DataFrame, key: str) -> DataFrame:
    """key, section, slug, flag, text: one row for each label of a section; where headings or rows repeat, the last counts.

    A section's rows are in the first box after its heading under the same parent.  Where a
    page gives no such row, the rows of the whole page go to the sections that their labels belong to.
    """
    heads = E.with_texts(E.tags(nodes, "h2", "h3", "h4", "b", "strong").select(key, "parent", "node", "last"), nodes, key)
    said = F.lower(F.trim(joined("texts", "")))
    section = F.coalesce(*(F.when(said.isin(*names), s) for s, names in X.SECTIONS.items()))
    named = kept(heads.select(key, "parent", "node", section.alias("section")).filter("section is not null"), "headings")
    boxes = E.next_sibling(named, E.tags(nodes, "table", "dl", "div", "section", "ul"), key).join(named.select(key, "node", "section"), [key, "node"])
    placed = kept(boxes.select(key, F.col("node").alias("head"), "section", F.col("next").alias("box"), F.col("next_last").alias("last")), "boxes")
    found = rows_of(placed.select(key, F.col("box").alias("node"), "last").distinct(), nodes, key)
    own = kept(placed.join(found, [key, "box"]).select(key, "section", "slug", "flag", "text", F.struct("head", "family", "place").alias("order")), "sections")
    whole = nodes.groupBy(key).agg(F.lit(E.ROOT).alias("node"), F.max("node").alias("last")).join(own.select(key).distinct(), key, "left_anti")
    home = F.coalesce(*(F.when(F.col("slug").isin(*labels), s) for s, labels in X.SECTION_LABELS.items()))
    rest = rows_of(whole, nodes, key).select(key, home.alias("section"), "slug", "flag", "text", F.struct(F.lit(E.ROOT).alias("head"), "family", "place").alias("order")).filter("section is not null")
    last = own.union(rest).groupBy(key, "section", "slug").agg(F.max_by(F.struct("flag", "text"), "order").alias("cell"))
    return last.select(key, "section", "slug", "cell.flag", "cell.text")


def page_sections(nodes: DataFrame, key: str) -> DataFrame:
    """key, sections: map<section, map<slug, struct<flag, text>>>."""
    inner = section_rows(nodes, key).groupBy(key, "section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", F.struct("flag", "text").alias("cell"))))).alias("rows"))
    return inner.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "rows"))).alias("sections"))


# ---- the second portal


def known_or_ask(c: Column) -> Column:
    """The text, or "ask agent" where it says nothing."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin(*X.UNKNOWN_CELL), "ask agent").otherwise(s)


def price_of(c: Column) -> tuple[Column, Column, Column]:
    """Monthly and weekly rent, and how they are shown, of a text such as "£2,100.00 pcm"."""
    s = F.regexp_replace(c, ",", "")
    amount = lambda unit: F.nullif(F.regexp_extract(s, rf"(?i)£([\d.]+)\s*{unit}", 1), F.lit("")).try_cast("double").cast("int")
    monthly, weekly = amount(r"(?:pcm|per\s*month|/\s*month)?"), amount(r"(?:pw|per\s*week|/\s*week)")
    monthly = F.coalesce(monthly, F.bround(weekly * X.WEEKS_PER_YEAR / X.MONTHS_PER_YEAR).cast("int"))
    shown = F.concat_ws(" ", F.when(weekly != 0, F.format_string("£%d pw", weekly)), F.when(monthly != 0, F.format_string("£%,d pcm", monthly)))
    return monthly, weekly, F.coalesce(F.nullif(shown, F.lit("")), F.lit("ask agent"))


def deposit_of(c: Column) -> tuple[Column, Column]:
    """The text ("ask agent" if it says nothing), and its amount in whole pounds."""
    said = known_or_ask(c)
    amount = F.nullif(F.regexp_replace(F.regexp_extract(said, r"£([\d,]+(?:\.\d+)?)", 1), ",", ""), F.lit("")).try_cast("double").cast("int")
    return said, amount


def capital(c: Column) -> Column:
    """The first letter in upper case, the rest in lower."""
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def listing_id(url: Column, source: str) -> Column:
    """The source, and the number at the end of a URL's path, else its last part."""
    path = F.regexp_replace(url, r"/+$", "")
    number = F.regexp_extract(path, r"/(\d+)\s*$", 1)
    return F.concat(F.lit(f"{source}:"), F.when(number != "", number).otherwise(F.element_at(F.split(url, "/"), -1)))


def selected(css: str) -> Column:
    """Whether an element is selected by a class, an id, or an attribute with or without a value."""
    if css.startswith("."):
        return F.array_contains(E.classes(), css[1:])
    if css.startswith("#"):
        return F.col("attrs")["id"] == css[1:]
    name, _, value = css.strip("[]").partition("=")
    return F.col("attrs")[name] == value.strip("'") if value else F.col("attrs")[name].isNotNull()


def longest_description(nodes: DataFrame, key: str) -> DataFrame:
    """key, description: the longest of what structured data, scripts, marked elements and their paragraphs give; else the long paragraphs.

    Equal lengths go to the way named first, then to the element that stands first.
    """
    c = F.col
    candidate = lambda df, way, at, said: df.select(key, F.lit(way).alias("way"), at.alias("at"), said.alias("said"))
    scripts = E.tags(nodes, "script").select(key, "node", F.coalesce(c("attrs")["type"], F.lit("")).alias("type"))
    code = scripts.join(nodes.filter(c("tag") == E.HIDDEN).select(key, c("parent").alias("node"), c("text").alias("code")), [key, "node"])
    data = F.coalesce(F.get_json_object("code", "$.description"), F.get_json_object("code", "$[0].description"))
    found = [candidate(code.filter(c("type") == "application/ld+json").withColumn("said", F.trim(data)).filter(F.length("said") > 50), 0, c("node"), c("said"))]
    for i, pattern in enumerate((r"[\"']description[\"']\s*:\s*[\"']([^\"']{100,})[\"']", r"description\s*=\s*[\"']([^\"']{100,})[\"']", r"\.description\s*=\s*[\"']([^\"']{100,})[\"']")):
        said = F.regexp_extract("code", f"(?is){pattern}", 1)
        found.append(candidate(code.withColumn("said", F.trim(F.replace(said, F.lit("\\n"), F.lit("\n")))).filter(F.length("said") > 50), 1, c("node") * 3 + i, c("said")))
    # the first element of each selector, with its text and what its attribute holds
    marked = E.tags(nodes).filter(F.size("attrs") > 0)  # most elements have no attribute to be selected by
    wanted = marked.select(key, "node", "last", "attrs", F.explode(F.array_compact(F.array(*(F.when(selected(css), F.lit(i)) for i, css in enumerate(X.DESCRIPTION_PLACES))))).alias("i"))
    first = kept(wanted.groupBy(key, "i").agg(F.min_by(F.struct("node", "last", c("attrs")["data-description"].alias("held")), "node").alias("e")).select(key, "i", "e.*"), "marked")
    shown = E.with_texts(first, nodes, key)
    found.append(candidate(shown.withColumn("said", F.trim("held")).filter(F.length("held") > 50), 2, c("i") * 2, c("said")))
    found.append(candidate(shown.withColumn("said", joined("texts", "\n")).filter(F.length("said") > 50), 2, c("i") * 2 + 1, c("said")))
    spans = marked.filter(reduce(lambda a, b: a | b, [F.array_contains(E.classes(), x) for x in X.DESCRIPTION_SPANS])).select(key, "node", "last")
    found.append(candidate(E.with_texts(spans, nodes, key).withColumn("said", joined("texts", "\n")).filter(F.length("said") > 30), 3, c("node"), c("said")))
    areas = first.filter(c("i").isin(*(X.DESCRIPTION_PLACES.index(a) for a in X.DESCRIPTION_AREAS)))
    paragraphs = E.with_texts(E.within(areas, E.tags(nodes, "p").select(key, "node", "last"), key).select(key, "i", "inner.*"), nodes, key).withColumn("p", joined("texts", "")).filter("p <> ''")
    together = lambda df, *by: df.groupBy(key, *by).agg(F.array_sort(F.collect_list(F.struct("node", "p"))).alias("ps"))
    said = lambda n=None: F.array_join(F.transform(F.slice("ps", 1, n) if n else F.col("ps"), lambda x: x["p"]), "\n\n")
    found.append(candidate(together(paragraphs, "i").withColumn("said", said()).filter(F.length("said") > 50), 4, c("i"), c("said")))
    best = kept(reduce(DataFrame.union, found), "descriptions")
    plain = E.with_texts(E.tags(nodes, "p").select(key, "node", "last").join(best.select(key).distinct(), key, "left_anti"), nodes, key).withColumn("p", joined("texts", "")).filter(F.length("p") > 80)
    best = best.union(candidate(together(plain).withColumn("said", said(6)), 5, F.lit(0), c("said")))
    return best.groupBy(key).agg(F.min_by("said", F.struct((-F.length("said")).alias("n"), "way", "at")).alias("description"))


def station_items(nodes: DataFrame, key: str) -> DataFrame:
    """key, features, stations: the items of the list after a heading of details, and the places with a way to walk of one of transport.

    Minutes count as so many miles.  Where several headings list features, the last counts;
    items of transport without a way to walk are features, if there are none at all.
    """
    c = F.col
    heads = E.with_texts(E.tags(nodes, "b", "strong", "h2", "h3", "h4").select(key, "node", "last"), nodes, key).withColumn("head", F.lower(joined("texts", "")))
    details = c("head").contains("property detail") | c("head").contains("key feature")
    transport = c("head").isin("features", "transport", "nearby transport", "nearby stations")
    named = heads.filter(details | transport).select(key, c("node").alias("start"), details.alias("details"))
    lists = named.join(E.tags(nodes, "ul").select(key, "node", "last"), key).filter(c("node") > c("start")).groupBy(key, "start", "details").agg(F.min(F.struct("node", "last")).alias("u")).select(key, "start", "details", "u.*")
    items = E.within(lists, E.tags(nodes, "li").select(key, "node", "last"), key).select(key, "start", "details", "inner.*")
    said = E.with_texts(items, nodes, key).withColumn("item", joined("texts", "")).filter("item <> ''")
    walk = r"(?i)^(.+?)\s*[~|]\s*([\d.]+)\s*(min|mile|km)"
    away = F.regexp_extract("item", walk, 2).try_cast("double")
    miles = F.when(F.lower(F.regexp_extract("item", walk, 3)) == "min", F.round(away * X.MILES_PER_MINUTE, 2)).otherwise(F.round(away, 2))
    each = kept(said.withColumn("station", F.when(~c("details") & c("item").rlike(walk), F.struct(F.trim(F.regexp_extract("item", walk, 1)).alias("name"), miles.alias("miles")))), "items")
    in_order = lambda value, order: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("v"))))), lambda x: x["v"])
    stations = each.filter("station is not null").groupBy(key).agg(in_order(c("station"), ("start", "node")).alias("stations"))
    last = each.filter("details").groupBy(key).agg(F.max("start").alias("latest"))
    listed = each.filter("details").join(last, key).filter(c("start") == c("latest")).groupBy(key).agg(in_order(c("item"), ("node",)).alias("features"))
    odd = each.filter("station is null and not details").groupBy(key).agg(F.min_by("item", F.struct("start", "node")).alias("odd"))
    met = each.select(key).distinct().join(stations, key, "left").join(listed, key, "left").join(odd, key, "left")
    return met.select(key, F.coalesce("features", F.when(c("odd").isNotNull(), F.array("odd"))).alias("features"), F.coalesce("stations", F.array().cast("array<struct<name:string,miles:double>>")).alias("stations"))


def rooms(nodes: DataFrame, key: str) -> DataFrame:
    """key, bedrooms, bathrooms: from the list after the first heading, else from the first text that names a number of them."""
    c = F.col
    top = E.first_of(E.tags(nodes, "h1"), key).select(key, c("node").alias("start"))
    lists = E.first_of(top.join(E.tags(nodes, "ul").select(key, "node", "last"), key).filter(c("node") > c("start")), key)
    items = E.with_texts(E.within(lists.select(key, "node", "last"), E.tags(nodes, "li").select(key, "node", "last"), key).select(key, "inner.*"), nodes, key)
    said = items.select(key, F.lit(0).alias("way"), "node", joined("texts", "").alias("said"))
    named = F.contains(F.lower("text"), F.lit("bedroom")) | F.contains(F.lower("text"), F.lit("bathroom"))  # found faster than the patterns
    texts = nodes.filter(c("tag") == E.TEXT).filter(named).select(key, F.lit(1).alias("way"), "node", c("text").alias("said"))

    def number(word: str) -> Column:
        # the last of the list's items counts, but the first of the page's texts
        count = F.when(c("way") == 0, F.regexp_extract("said", rf"(?i)^(\d+)\s*{word}", 1)).otherwise(F.regexp_extract("said", rf"(?i)(\d+)\s*{word}", 1)).try_cast("int")
        order = F.struct("way", F.when(c("way") == 0, -c("node")).otherwise(c("node")))
        return F.min_by(count, F.when(count.isNotNull(), order)).alias(f"{word}s")

    return said.union(texts).groupBy(key).agg(number("bedroom"), number("bathroom"))


def second_portal(pages: DataFrame, nodes: DataFrame, key: str, *, html: str = "html") -> DataFrame:
    """A row for each page of the second portal: its fields, and the labels that none is read from (``extras``)."""
    c = F.col
    sections = page_sections(nodes, key)
    texts = page_texts(nodes, key).select(key, F.array_join("texts", " ").alias("line"))
    prices = nodes.filter((c("tag") == E.TEXT) & c("text").rlike(r"(?i)Rent\s*PCM"))
    price_box = E.first_of(prices, key).select(key, c("parent").alias("node")).join(E.tags(nodes).select(key, "node", "last"), [key, "node"])
    price = E.with_texts(price_box, nodes, key).select(key, joined("texts", " ").alias("price_text"))
    shown = E.first_of(nodes.filter((c("tag") == E.TEXT) & c("text").rlike(r"£[\d,.]+")), key).select(key, c("text").alias("any_price"))
    out = pages.select(key, c(html).alias("html"))
    for part in (sections, texts, price, shown, rooms(nodes, key), longest_description(nodes, key), station_items(nodes, key)):
        out = out.join(part.hint("merge"), key, "left")
    cell = lambda section, slug: F.get(F.array(c("sections")[section][slug]), F.lit(0))
    flag = lambda section, *slugs: F.coalesce(*(cell(section, s)["flag"] for s in slugs))
    said = lambda section, *slugs: F.coalesce(*(F.coalesce(cell(section, s)["text"], F.when(cell(section, s)["flag"], "True")) for s in slugs), F.lit(""))
    monthly, weekly, display = price_of(c("price_text"))
    fallback = F.regexp_replace(F.regexp_extract("any_price", r"£([\d,.]+)", 1), ",", "").try_cast("double").cast("int")
    deposit, amount = deposit_of(said("price_bills", "deposit"))
    epc = F.coalesce(F.nullif(F.upper(F.regexp_extract(F.trim(said("features", "epc_rating")), r"(?i)^([A-G])\b", 1)), F.lit("")), F.nullif(F.upper(F.regexp_extract("html", r"(?i)EPC\s*Rating\s*[:\-]?\s*([A-G])\b", 1)), F.lit("")))
    furnish = F.coalesce(F.nullif(said("features", "furnishing"), F.lit("")), F.nullif(F.regexp_extract("line", r"(?i)(unfurnished|part.?furnished|furnished)", 1), F.lit("")))
    kind = F.nullif(F.regexp_extract("line", r"(?i)\b(flat|house|studio|apartment|maisonette|bungalow|terraced|detached|semi-detached|room|bedsit)\b", 1), F.lit(""))
    cells = F.flatten(F.transform(F.map_values(F.coalesce("sections", F.create_map().cast(f"map<string,map<string,{CELL}>>"))), lambda m: F.map_entries(m)))
    extras = F.filter(cells, lambda e: ~e["key"].isin(*X.KNOWN_LABELS))
    value = lambda e: F.coalesce(e["value"]["text"], F.when(e["value"]["flag"], "true").otherwise("false"))
    return out.select(
        key,
        F.coalesce(monthly, fallback).alias("price_pcm"),
        weekly.alias("price_pw"),
        F.when(monthly.isNull() & fallback.isNotNull(), F.format_string("£%,d pcm", fallback)).otherwise(display).alias("price_display"),
        deposit.alias("deposit"),
        amount.alias("deposit_amount"),
        said("availability", "available_from", "available").alias("available_text"),
        known_or_ask(said("availability", "minimum_tenancy", "min_tenancy", "min__tenancy")).alias("min_tenancy"),
        known_or_ask(said("features", "council_tax", "council_tax_band")).alias("council_tax"),
        flag("price_bills", "bills_included").alias("bills_included"),
        *(flag("tenant_preference", s).alias(s) for s in ("student_friendly", "families_allowed", "pets_allowed", "smokers_allowed")),
        flag("tenant_preference", "dss_lha_covers_rent", "dss_covers_rent").alias("dss_covers_rent"),
        flag("availability", "online_viewings").alias("online_viewings"),
        *(flag("features", s).alias(s) for s in ("garden", "parking", "fireplace")),
        capital(furnish).alias("furnish_type"),
        epc.alias("epc_rating"),
        capital(kind).alias("property_type"),
        "bedrooms",
        "bathrooms",
        F.nullif(F.regexp_extract("html", r"(?i)(\d+)\s+tenants?\s+max", 1), F.lit("")).try_cast("int").alias("max_tenants"),
        F.regexp_extract("html", r'data-lat="(-?\d{1,3}\.\d+)"', 1).try_cast("double").alias("latitude"),
        F.regexp_extract("html", r'data-lng="(-?\d{1,3}\.\d+)"', 1).try_cast("double").alias("longitude"),
        "description",
        "features",
        "stations",
        F.map_from_entries(text.let(extras, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda e: e["key"])), lambda k: F.struct(k, F.element_at(F.transform(F.filter(all_, lambda e: e["key"] == k), value), -1))))).alias("extras"),
        "sections",
    )

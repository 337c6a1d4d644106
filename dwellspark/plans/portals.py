"""Queries of page trees: raw pages, and pages of both portals that are made from the listing view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text
from ..sources import elements as E
from ..sources import portals as P
from .listing import WITH_LISTING, listings


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw page as a tree: its elements and items, its heading, the texts of its items. A reference that a cut left without its semicolon stays as it is."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    nodes = E.kept_elements(pages, closed=True)
    counts = nodes.groupBy("page_id").agg(F.count_if(~F.col("tag").startswith("#")).alias("n_elements"), F.count_if(F.col("tag") == "li").alias("n_items"))
    heads = E.with_texts(E.first_of(E.tags(nodes, "h1"), "page_id").select("page_id", "node", "last"), nodes, "page_id").select("page_id", F.array_join("texts", "").alias("heading"))
    said = E.with_texts(E.tags(nodes, "li").select("page_id", "node", "last"), nodes, "page_id").select("page_id", "node", F.array_join("texts", "").alias("t"))
    items = said.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "t"))), lambda x: x["t"]), "|").alias("items"))
    out = pages.select("page_id").join(counts, "page_id", "left").join(heads, "page_id", "left").join(items, "page_id", "left")
    return out.select("page_id", "n_elements", "n_items", "heading", F.coalesce("items", F.lit("")).alias("items"))


def _html(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _list(items: Column) -> Column:
    return F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))


def first_pages(df: DataFrame) -> DataFrame:
    """A page of the first portal for each listing."""
    c = F.col
    price = F.when(c("price_pcm").isNotNull(), F.concat(F.lit("<div><div><div><div><p><b>£"), F.format_string("%,d", c("price_pcm").cast("int")), F.lit("</b> pcm</p></div></div></div></div>")))
    html = _html(
        "<html><body><nav><a href='/'>Home</a></nav><div><h1>", c("title"), "</h1><p>", c("address"), ", ", c("postcode"), "</p><span>Tenancy info, below</span></div><main>", price,
        "<h2>Key features</h2>", F.when(c("k") % 2 == 0, "<i>").otherwise("<div>"), _list(F.split(F.coalesce("features", F.lit("")), ", ")), F.when(c("k") % 2 == 0, "</i>").otherwise("</div>"),
        "<section><h3>Full description</h3><p>Read more</p><p>", F.regexp_replace("description", r"\. ", ".<br>"), " show less</p>loose<div>Ends <b>here</b><p>Brochures</p></div><h4>After</h4><p>no</p></section>",
        "<dl><dt>Property type</dt><dd>", c("property_type"), "</dd><dt>Bedrooms</dt><dd>", c("bedrooms"), "</dd></dl><p>Added on 0", c("k") % 9 + 1, "/12/2023</p>",
        "<h3>Nearest stations</h3><p>", F.concat(F.lit("Stop "), c("k") % 7), "</p><p>0.", c("k") % 5, " miles</p><p>Type: bus</p><p>Far 1", c("k") % 3, " miles</p><p>Show more on map</p><p>To check broadband</p><p>None 0.1 miles</p></main></body></html>",
    )
    return df.select("k", html.alias("html"))


def first_portal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = first_pages(listings(spark, sf_dir))
    nodes = E.kept_elements(pages, key="k")
    near = P.nearby_places(nodes, "k", {"stations": "nearest stations"})
    out = P.first_portal(pages, nodes, "k").join(near.hint("merge"), "k", "left")
    shown = F.array_join(F.transform("stations", lambda s: F.concat_ws(" ", s["name"], F.format_string("%.1f", s["miles"]))), "|")
    return out.select("k", "title", "address", F.array_join("key_features", "|").alias("key_features"), "description", "property_type", "bedrooms", "added_date", shown.alias("stations"))


def second_pages(df: DataFrame) -> DataFrame:
    """A page of the second portal for each listing: a table, a definition list and flex boxes, with ticks and hints.

    The list of transport follows two headings that announce it, so its places count twice.
    """
    c = F.col
    tick = lambda v, yes, no: F.when(v, yes).when(~v, no)
    row = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f'<div class="d-flex x"><span class="fw-medium">{name}</span><a data-bs-toggle="tooltip"><i>?</i></a>'), v, F.lit("</div>")))
    word = lambda v: F.concat(F.lit("<span>"), F.coalesce(v.cast("string"), F.lit("")), F.lit("</span>"))
    bills = F.coalesce(tick(c("bills_included"), "<svg class='or-icon text-success'/>", "<i class='fa fa-times'></i>"), F.lit("ask"))
    html = _html(
        "<html><body><h1>", c("title"), "</h1><ul><li>", c("bedrooms"), "bedrooms</li><li>3 tenants max</li></ul><p>Rent PCM: £", F.format_string("%,.2f", "price_pcm"), "</p>",
        "<h3>Price &amp; Bills</h3><div><table><tr><th>Deposit</th><td>", c("deposit"), "</td></tr><tr><td><span class='fw-medium'>Bills Included</span> <a data-content='x'>why</a></td><td>", bills, "</td></tr></table></div>",
        "<b>Availability</b><dl><dt>Available From</dt><dd>", c("available_from"), "</dd><dt>Minimum <small>(least)</small> Tenancy</dt><hr><dd><table><tr><td>", c("min_tenancy"), "</td></tr></table></dd></dl>",
        "<h3>Tenant Preference</h3><table>", F.when(c("pets_allowed").isNotNull(), F.concat(F.lit("<tr><td>Pets Allowed</td><td>"), tick(c("pets_allowed"), "✓", "No"), F.lit("</td></tr>"))), "<tr><td>Families Allowed<td></tr></table>",
        "<h3>Features</h3><div>", row("Garden", tick(c("garden"), "<svg class='text-success'></svg>", "<img src='/cross.png'>")), row("EPC Rating", word(c("epc_rating"))), row("Furnishing", F.when(c("furnish_type").isNotNull(), word(c("furnish_type")))), row("Cycle Store", word(c("postcode_district"))), "</div>",
        "<b>Transport</b><ul><li>", c("title"), "~", c("k") % 9 + 1, " min. walk</li><li>Bus stop</li></ul><div data-lat='x' data-lat=\"", F.format_string("%.4f", "latitude"), "\" data-lng=\"", F.format_string("%.4f", "longitude"), "\"></div></body></html>",
    )
    return df.select("k", html.alias("html"))


def second_portal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = second_pages(listings(spark, sf_dir).withColumn("title", F.concat(F.lit("Near "), "title")))
    got = P.second_portal(pages, E.kept_elements(pages, key="k"), "k")
    walk = F.array_join(F.transform("stations", lambda s: F.concat_ws(" ", s["name"], F.format_string("%.2f", s["miles"]))), "|")
    columns = ("price_pcm", "price_display", "deposit", "deposit_amount", "bills_included", "available_text", "min_tenancy", "pets_allowed", "families_allowed", "garden", "epc_rating", "furnish_type", "max_tenants", "bedrooms", "latitude", "longitude")
    return got.select("k", *columns, walk.alias("stations"), F.array_join("features", "|").alias("features"), F.col("extras")["cycle_store"].alias("cycle_store"), F.size("extras").alias("n_extras"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second portal's pages as a row for each label of a section."""
    pages = second_pages(listings(spark, sf_dir))
    return P.section_rows(E.kept_elements(pages, key="k"), "k")


QUERIES = {f.__name__: f for f in (page_outline, first_portal_fields, second_portal_fields, page_sections)}

_ASK = "'" + "', '".join(X.UNKNOWN_CELL) + "'"
_MONEY = lambda c: f"try_cast(replace(regexp_extract({c}, '£([0-9,]+)', 1), ',', '') as int)"
_BRIEF = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_ROWS = """r as (
    select k, 'price_bills' as section, 'deposit' as slug, case when deposit is null then false end as flag, deposit as text from listing union all
    select k, 'price_bills', 'bills_included', bills_included, case when bills_included is null then 'ask' end from listing union all
    select k, 'availability', 'available_from', case when available_from is null then false end, available_from from listing union all
    select k, 'availability', 'minimum_tenancy', case when min_tenancy is null then false end, min_tenancy from listing union all
    select k, 'tenant_preference', 'pets_allowed', pets_allowed, null from listing where pets_allowed is not null union all
    select k, 'tenant_preference', 'families_allowed', false, null from listing union all
    select k, 'features', 'garden', garden, null from listing where garden is not null union all
    select k, 'features', 'epc_rating', null, nullif(epc_rating, '') from listing where coalesce(epc_rating, '') <> '' union all
    select k, 'features', 'furnishing', null, furnish_type from listing where furnish_type is not null union all
    select k, 'features', 'cycle_store', null, postcode_district from listing)"""
ORACLES = {
    "page_outline": rf"""with t as (select page_id, html, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as items from pages)
        select page_id, len(regexp_extract_all(html, '<[a-z]')) as n_elements, len(regexp_extract_all(html, '<li>')) as n_items,
               {_BRIEF.format("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")} as heading, array_to_string(list_transform(items, lambda x: {_BRIEF.format("trim(x)")}), '|') as items from t""",
    "first_portal_fields": WITH_LISTING
    + r""" select k, title, case when price_pcm is not null then concat(address, ', ', postcode) end as address, replace(features, ', ', '|') as key_features,
        concat(case when description is null then '' else concat(replace(description, '. ', '. <PARA> '), ' <PARA> ') end, 'Ends <PARA> here <PARA>') as description,
        coalesce(property_type, 'Bedrooms') as property_type, coalesce(bedrooms, case when lower(property_type) = 'studio' then 0 end) as bedrooms, concat('2023-12-0', k % 9 + 1) as added_date,
        concat('Stop ', k % 7, ' 0.', k % 5, '|Far ', 10 + k % 3, '.0') as stations from listing""",
    "second_portal_fields": WITH_LISTING
    + f""", p as (select *, coalesce(cast(price_pcm as int), {_MONEY("deposit")}) as paid from listing)
        select k, paid as price_pcm, case when paid is null then 'ask agent' else concat('£', format('{{:,}}', paid), ' pcm') end as price_display,
        case when lower(trim(coalesce(deposit, ''))) in ({_ASK}) then 'ask agent' else trim(deposit) end as deposit, {_MONEY("deposit")} as deposit_amount, bills_included, coalesce(available_from, '') as available_text,
        case when lower(trim(coalesce(min_tenancy, ''))) in ({_ASK}) then 'ask agent' else trim(min_tenancy) end as min_tenancy, pets_allowed, false as families_allowed, garden, nullif(epc_rating, '') as epc_rating,
        upper(furnish_type[1]) || lower(furnish_type[2:]) as furnish_type, 3 as max_tenants, bedrooms, round(latitude, 4) as latitude, round(longitude, 4) as longitude,
        concat('Near ', title, ' ', format('{{:.2f}}', (k % 9 + 1) * 0.05), '|Near ', title, ' ', format('{{:.2f}}', (k % 9 + 1) * 0.05)) as stations, 'Bus stop' as features, postcode_district as cycle_store, 1 as n_extras from p""",
    "page_sections": WITH_LISTING + ", " + _ROWS + " select k, section, slug, flag, text from r",
}

"""Queries of places by name: the titles and links of pages are the names, words of conversations are typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import places
from ..session import kept
from ..sources import pages as P

#: Links of a page count from its number times this.
PER_PAGE = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical, phrase, place: a name from each page's title."""
    title = P.title(F.col("html"))
    return _table(spark, sf_dir, "pages").select(title.alias("canonical"), title.alias("phrase"), F.col("page_id").alias("place"))


def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, name: the texts of all links, in the order of pages."""
    found = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "name")).select((F.col("page_id") * PER_PAGE + F.col("pos")).alias("place"), "name")


def words(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """word: the distinct words of conversations of at least so many letters."""
    all_ = F.explode(F.split("text", r"[ \t\n\x0B\f\r]+"))
    return _table(spark, sf_dir, "conversations").select(all_.alias("word")).filter(F.length("word") >= least).distinct()


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed: the distinct first two words of turns."""
    first = F.regexp_extract("text", r"^[^ \t\n]+[ \t\n]+[^ \t\n]+", 0)
    return _table(spark, sf_dir, "conversations").select(first.alias("typed")).filter("typed <> ''").distinct()


def location_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.alias_index(titles(spark, sf_dir)).select("name", "place", "alias", "slug", "compact")


def location_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.lookups(places.alias_index(titles(spark, sf_dir)))


def location_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link that a word is, holds, or is held by."""
    found = places.region_of(words(spark, sf_dir, 5), link_names(spark, sf_dir).filter(F.length("name") >= 4), keyword="word")
    return found.select("word", "place", "name")


def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best aliases of titles for the openings of turns."""
    found = places.best_aliases(openings(spark, sf_dir), kept(places.alias_index(titles(spark, sf_dir)), "index"))
    return found.select("typed", "rank", "alias", F.round("score", 6).alias("score"))


def destination_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link that a word means as a station."""
    stations = link_names(spark, sf_dir).filter(F.length("name") >= 6)
    return places.destination_station(words(spark, sf_dir, 6), stations, destination="word").select(F.col("word").alias("destination"), "station", "way", "edits")


QUERIES = {f.__name__: f for f in (location_index, location_lookups, location_region, alias_candidates, destination_station)}


def _plain(c: str) -> str:
    known = f"case when lower(trim({c})) in ('nan', 'none', 'ask agent') then '' else trim({c}) end"
    return f"trim(regexp_replace(regexp_replace(lower({known}), '[''’‘`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def osa(a: str, b: str) -> str:
    """Edits with swaps, each part edited once: the last two rows of the table of distances, row by row."""
    cost = f"case when substr({a}, y[1][1], 1) = substr({b}, j, 1) then 0 else 1 end"
    swap = f"case when y[1][1] > 1 and j > 1 and substr({a}, y[1][1], 1) = substr({b}, j - 1, 1) and substr({a}, y[1][1] - 1, 1) = substr({b}, j, 1) then x[1][j - 1] + 1 else 999 end"
    base = f"list_concat([y[1][1]], list_transform(range(1, length({b}) + 1), lambda j: least(x[2][j + 1] + 1, x[2][j] + {cost}, {swap})))"
    row = f"list_transform({base}, lambda v, k: list_min(list_transform(({base})[1:k], lambda w, m: w + k - m)))"
    zero = f"range(0, length({b}) + 1)"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [[i]]), lambda x, y: [x[2], {row}], [{zero}, {zero}])[2][length({b}) + 1]"


_TITLES = f"""t as (select page_id as place, {_plain("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} as name from pages),
f as (select name, min(place) as place from t where name <> '' group by name),
w as (select name, place, string_split(name, ' ') as w from f),
r as (select name, place, unnest(list_distinct(list_concat([name], case when len(w) >= 3 then list_filter(list_concat(
    list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))), lambda x: length(x) >= {X.LEAST_RUN}) else [] end))) as alias from w),
idx as (select name, place, alias, replace(alias, ' ', '_') as slug, replace(alias, ' ', '') as compact from r where length(alias) >= {X.LEAST_ALIAS})"""
_FAMILIES = "select 0 as family, alias as key, * exclude (name) from idx union all select 1, slug, * exclude (name) from idx union all select 2, compact, * exclude (name) from idx"
_LOOKUPS = f"l as (select family, key, min_by(alias, (place, length(alias), alias)) as alias from ({_FAMILIES}) group by 1, 2)"
_LINKS = f"links as (select page_id * {PER_PAGE} + unnest(range(0, len(n))) as place, unnest(n) as name from (select page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) as n from pages))"
_WORDS = r"words as (select distinct word from (select unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) as word from conversations))"
_OPENING = r"openings as (select distinct regexp_extract(text, '^[^ \t\n]+[ \t\n]+[^ \t\n]+') as typed from conversations where regexp_matches(text, '^[^ \t\n]+[ \t\n]+[^ \t\n]+'))"
#: One text against one window of another: only those that unrestricted edits bring near enough are measured.
_SCORES = f"""q as (select typed, {_plain("typed")} as p from openings),
n as (select typed, p as plain, replace(p, ' ', '_') as slug, replace(p, ' ', '') as compact from
  (select typed, case when length(replace(p, ' ', '')) >= {X.LEAST_DIGITS} and not regexp_matches(p, '^[a-z]{{1,2}}[0-9][a-z0-9]? ?[0-9][a-z]{{2}}$') then trim(regexp_replace(p, '[0-9]+$', '')) else p end as p from q) where p <> ''),
x as (select typed, l.alias, min(family) as family from (select typed, 0 as family, plain as key from n union all select typed, 1, slug from n union all select typed, 2, compact from n) join l using (family, key) group by 1, 2),
a as (select distinct compact as c, length(compact) as lc from idx where compact <> ''),
b as (select distinct compact as q, length(compact) as lq from n where typed not in (select typed from x) and compact <> ''),
pair as (select *, greatest(lq, least(lc, lq + 1)) as m from a cross join b),
need as (select *, case when m <= 6 then 1 when m <= 12 then 2 else greatest(2, cast(round_even(m * 0.2, 0) as int)) end as need from pair),
win as (select q, c, lq, lc, need, unnest(case when lc <= lq + 2 then [c] else list_distinct(list_transform(
    list_filter(flatten(list_transform([greatest(3, lq - 1), lq, lq + 1], lambda s: list_transform(list_concat(range(0, least(3, lc - s + 1)), range(greatest(0, lc - s - 2), lc - s + 1)), lambda o: [s, o]))), lambda z: z[1] <= lc), lambda z: substr(c, z[2] + 1, z[1]))) end) as w from need),
near as (select *, greatest(lq, length(w)) as lw from win where abs(lq - length(w)) * lq <= need * greatest(lq, length(w)) and damerau_levenshtein(q, w) * lq <= need * greatest(lq, length(w))),
lik as (select q, c, max(1.0::double - {osa("q", "w")}::double / lw) as sim, any_value(need) as need, any_value(lq) as lq, any_value(lc) as lc from near group by 1, 2),
ed as (select q, c, 0.68::double + 0.20::double * sim + 0.12::double * least(lq, lc)::double / greatest(lq, lc) as s from lik where sim >= 1.0::double - need::double / lq),
co as (select q, c, 0.88::double + 0.10::double * least(lq, lc)::double / greatest(lq, lc) as s from pair where contains(c, q) or contains(q, c)),
ab as (select q, c, length(regexp_extract(c, pattern)) as span, lq, lc, pattern from (select *, array_to_string(string_split(q, ''), '.*?') as pattern from pair where lq between 3 and 8 and c like concat('%', array_to_string(string_split(q, ''), '%'), '%'))),
su as (select q, c, 0.70::double + 0.20::double * lq::double / span + 0.10::double * lq::double / lc as s from ab),
best as (select q, c, max(s) as s from (select * from ed union all select * from co union all select * from su) group by 1, 2 having max(s) >= 0.80),
o as (select typed, alias, 1.0::double as score, family, 0 as n from x union all
  select n.typed, idx.alias, best.s, 0, length(idx.alias) from best join n on n.compact = best.q join (select distinct compact, alias from idx) idx on idx.compact = best.c where n.typed not in (select typed from x))"""
# the engine counts bytes: letters are made one byte each first, which never adds an edit
_BYTES = "translate(strip_accents({}), 'ß', 's')"
_NEAR_KEY = f"""select d, 3 as way, e as edits, place, station from (select *, {osa("d", "key")} as e from (
    select d, key, place, station, greatest(1, least(3, length(d) // 4)) as k from (select d from dest where d not in (select d from parted union all select d from known)) join keys on damerau_levenshtein({_BYTES.format("d")}, {_BYTES.format("key")}) <= greatest(1, least(3, length(d) // 4)))) where e <= k"""
ORACLES = {
    "location_index": f"with {_TITLES} select * from idx",
    "location_lookups": f"with {_TITLES}, {_LOOKUPS} select * from l",
    "location_region": f"""with {_LINKS}, {_WORDS},
        names as (select lower(name) as k, min(place) as place from links where length(name) >= 4 group by 1),
        typed as (select word, lower(trim(word)) as k from words where length(word) >= 5),
        best as (select typed.word, min((typed.k <> names.k, place)) as b from typed join names on contains(typed.k, names.k) or contains(names.k, typed.k) group by 1)
        select word, b[2] as place, name from best join links on links.place = b[2]""",
    "alias_candidates": f"""with {_TITLES}, {_LOOKUPS}, {_OPENING}, {_SCORES}
        select typed, cast(rank as int) as rank, alias, round(score, 6) as score from (select *, row_number() over (partition by typed order by score desc, family, n, alias) as rank from o) where rank <= 8""",
    "destination_station": f"""with {_LINKS}, {_WORDS},
        forms as (select place, name, unnest(case when k like '% station' then [k, k[:-9]] else [k, concat(k, ' station')] end) as key, unnest([0, 1]) as form from (select *, lower(trim(name)) as k from links where length(name) >= 6)),
        keys as (select key, min((place, form)) as place, max_by(name, (place, form)) as station from forms where key <> '' group by key),
        dest as (select distinct lower(trim(word)) as d from words where length(word) >= 6),
        known as (select d, 0 as way, 0 as edits, place, station from dest join keys on d = key),
        parted as (select d, 2 as way, 0 as edits, place, station from dest join keys on contains(d, key) or contains(key, d) where d not in (select d from known)),
        every as (select * from known union all select * from parted union all {_NEAR_KEY}),
        best as (select d, min_by((station, way, edits), (way, edits, place)) as b from every group by d)
        select word as destination, b[1] as station, case b[2] when 0 then 'exact' when 2 then 'part' else 'edits' end as way, cast(b[3] as int) as edits
        from words join best on lower(trim(word)) = d where length(word) >= 6""",
}

"""Places by name: an index of aliases, and joins of typed names to it that never hold every name against every alias.

The index has a row for each alias of a canonical name, and is kept as Parquet.  Typed names
meet it by equality joins: on keys; on a needle's rarest run of up to three letters, where
one text holds the other; on a needle's first letters; on the lengths of blocks of texts and names, which are
compared letter by letter only as far as a text's best names found so far leave room; or on
what is left of a text when up to k letters are dropped.  What meets is verified.  Tables that are
few bytes on disk give many rows once their runs of letters are listed, so joins say that they merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import fixed, fuzzy, near, text
from ..session import kept, ship_package

#: Letters of the runs that texts are found by.
GRAM = 3
#: The most letters of a needle's beginning by which it is looked up.
LONGEST_START = 6
#: Typed texts of a task, and names of a block, about; and numbers that the beginnings of typed texts have.
TEXTS, NAMES, SLOTS = 4096, 8192, 1 << 18


# ---- names, aliases, index


def plain_name(c: Column) -> Column:
    """Lower case, without apostrophes; all but letters and digits as single spaces."""
    s = F.regexp_replace(F.lower(text.safe_text(c)), "['’‘`]", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def aliases_of(plain: Column) -> Column:
    """The aliases of a plain name: itself, and runs of two or three words of longer ones; short ones don't count."""
    runs = lambda tokens: F.when(F.size(tokens) >= 3, F.filter(text.phrases(tokens, (2, 3)), lambda x: F.length(x) >= fixed.LEAST_RUN)).otherwise(F.array().cast("array<string>"))
    all_ = lambda p: F.array_distinct(F.concat(F.array(p), text.let(F.split(p, " "), runs)))
    return F.filter(text.let(plain, all_), lambda x: F.length(x) >= fixed.LEAST_ALIAS)


def alias_index(phrases: DataFrame) -> DataFrame:
    """name (plain), canonical, place, alias, slug, compact: the distinct aliases of each name of ``phrases`` (canonical, phrase, place).

    Phrases of one plain canonical name are one entry, whose spelling and place are those of its first row.
    """
    named = phrases.withColumn("name", plain_name(F.col("canonical"))).filter("name <> ''")
    first = named.groupBy("name").agg(F.min_by("canonical", F.struct("place", "canonical")).alias("canonical"), F.min("place").alias("place"))
    said = named.select("name", F.explode(aliases_of(plain_name(F.col("phrase")))).alias("alias")).distinct()
    return said.join(first.hint("merge"), "name").select("name", "canonical", "place", "alias", text.slug(F.col("alias")).alias("slug"), text.compact(F.col("alias")).alias("compact"))


def lookups(index: DataFrame) -> DataFrame:
    """family (plain, slug, compact), key, alias: the first alias of each key, by entry, then length, then name."""
    families = F.array(*(F.struct(F.lit(i).alias("family"), F.col(c).alias("key")) for i, c in enumerate(("alias", "slug", "compact"))))
    each = index.select(F.explode(families).alias("f"), "alias", F.struct("place", F.length("alias").alias("n"), F.col("alias").alias("a")).alias("order"))
    return each.groupBy(F.col("f.family").alias("family"), F.col("f.key").alias("key")).agg(F.min_by("alias", "order").alias("alias"))


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame]) -> DataFrame:
    """The index kept at ``path``; where there is none, it is built, kept and read again."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    save_index(rebuild(), path)
    return spark.read.parquet(path)


def typed_name(c: Column) -> Column:
    """A typed place as a plain name: abbreviations of the one family spelt out, trailing digits of longer names dropped unless it is a postcode."""

    def cut(spelt: Column) -> Column:
        postcode = spelt.rlike(r"^[a-z]{1,2}[0-9][a-z0-9]?\s?[0-9][a-z]{2}$")
        long = F.length(F.regexp_replace(spelt, " ", "")) >= fixed.LEAST_DIGITS
        return F.when(~postcode & long, F.trim(F.regexp_replace(spelt, "[0-9]+$", ""))).otherwise(spelt)

    spelt = lambda plain: F.coalesce(text.let(text.compact(plain), lambda k: fuzzy.abbreviation(plain, k)), plain)
    return text.let(plain_name(c), lambda plain: text.let(spelt(plain), cut))


# ---- texts that hold other texts


def _grams(c: Column, n: Column) -> Column:
    """The distinct runs of n letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n)))


def holding(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, text: every pair of which the text holds the needle. Both are tables of distinct, non-empty strings.

    A needle's runs of three letters (or itself, if shorter) must all occur in the text, so it
    is looked up by the one that the fewest texts have.
    """
    sized = lambda c: F.least(F.length(c), F.lit(GRAM))
    sizes = F.sequence(F.lit(1), sized("text"))
    runs = texts.select("text", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("text"), n)))).alias("gram"))
    frequent = runs.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = needles.select("needle", F.explode(_grams(F.col("needle"), sized("needle"))).alias("gram"), F.size(_grams(F.col("needle"), sized("needle"))).alias("all"))
    rarest = wanted.join(frequent, "gram").groupBy("needle", "all").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).filter(F.col("found") == F.col("all"))
    return rarest.select("needle", "gram").join(runs, "gram").filter(F.contains("text", "needle")).select("needle", "text")


def either_holds(typed: DataFrame, names: DataFrame) -> DataFrame:
    """typed, name: every pair of which one holds the other."""
    forth = holding(typed.select(F.col("typed").alias("needle")), names.select(F.col("name").alias("text"))).select(F.col("needle").alias("typed"), F.col("text").alias("name"))
    back = holding(names.select(F.col("name").alias("needle")), typed.select(F.col("typed").alias("text"))).select(F.col("text").alias("typed"), F.col("needle").alias("name"))
    return forth.union(back).distinct()


def region_of(keywords: DataFrame, regions: DataFrame, *, keyword: str = "keyword") -> DataFrame:
    """The keywords (distinct) that are a region's name, or hold one, or are held by one, with that region's columns.

    A name in full goes before all others; the first region in ``place`` order wins.  Case and outer spaces don't count.
    """
    typed = keywords.select(keyword, F.lower(F.trim(keyword)).alias("typed")).filter("typed <> ''").distinct()
    first = regions.withColumn("name_key", F.lower("name")).filter("name_key <> ''")
    keys = first.groupBy("name_key").agg(F.min("place").alias("place"))
    met = either_holds(typed.select("typed").distinct(), keys.select(F.col("name_key").alias("name")))
    best = met.join(keys, F.col("name") == F.col("name_key")).groupBy("typed").agg(F.min(F.struct(F.col("typed") != F.col("name"), "place")).alias("best")).select("typed", F.col("best.place").alias("place"))
    return typed.join(best, "typed").join(regions, "place").drop("typed")


# ---- names within few edits of each other


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs are few bytes but much work each, so they aren't left in as few tasks as their size asks for."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _ranked(found: DataFrame, n: int) -> DataFrame:
    """The n best names of each typed text: a name has its best score, ties go to the shorter, then the smaller alias (``first``)."""
    best = found.groupBy("typed", "name").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    order = Window.partitionBy("typed").orderBy(F.desc("score"), "first")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")


def containment_best(typed: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """typed, name, first, score: the n best names that hold a typed text (also as a window at an end), and that it holds.

    ``typed``: (typed); ``names``: (name, first), as in ``_ranked``.  A needle is looked up by its first letters.
    Runs of names whose number no beginning has are left out before they are dealt; there are as many numbers at most as ``SLOTS``.
    """
    begin = lambda c: F.substring(c, 1, LONGEST_START)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    starts = typed.select("typed", begin("typed").alias("gram"))
    runs = names.select("name", "first", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(LONGEST_START))), lambda k: _grams(F.col("name"), k)))).alias("gram"))
    likely = runs.withColumn("slot", slot("gram")).join(F.broadcast(starts.select(slot("gram").alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    forth = starts.join(likely.hint("merge"), "gram").filter(F.contains("name", "typed")).select("typed", "name", "first")
    held = typed.select("typed", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("typed")), lambda k: _grams(F.col("typed"), k)))).alias("name")).join(names.hint("merge"), "name").select("typed", "name", "first")
    less, more = F.least(F.length("typed"), F.length("name")), F.greatest(F.length("typed"), F.length("name"))
    ends = F.array(F.substr("name", F.lit(1), F.length("typed") + 2), F.substr("name", F.length("name") - F.length("typed") - 1))
    window = (F.length("name") > F.length("typed") + 2) & F.exists(ends, lambda e: F.contains(e, F.col("typed")))
    score = F.when(window, F.lit(0.68) + F.lit(0.20) + F.lit(0.12) * less / more).otherwise(F.lit(0.88) + F.lit(0.10) * less / more)
    return _ranked(forth.union(held).withColumn("score", score), n)


def _packed(dealt: DataFrame, column: str, order: Column) -> DataFrame:
    """size, block, texts, floors: a block's texts of one length one after the other, and their ``floor``s."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("order"), F.col(column).alias("text"), "floor")))
    packed = dealt.groupBy(F.length(column).alias("size"), "block").agg(rows.alias("rows"))
    return packed.select("size", "block", F.array_join(F.col("rows.text"), "").alias("texts"), F.col("rows.floor").alias("floors"))


def _blocks(texts: DataFrame, column: str, order: Column, least: int) -> DataFrame:
    """size, block, texts, floors: texts of one length one after the other, ``least`` a block or so, and their ``floor``s."""
    sized = texts.withColumn("size", F.length(column))
    many = sized.groupBy("size").agg(F.ceil(F.count("*") / least).alias("many"))
    return _packed(sized.join(many.hint("merge"), "size").withColumn("block", F.pmod(F.xxhash64(column), F.col("many"))), column, order)


def _of_blocks(ways: Sequence[int], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def table(asked: list[near.Asked]) -> pa.RecordBatch:
        found = [f for texts in asked for f in texts.best()]
        return pa.RecordBatch.from_pydict({"typed": pa.array([f[0] for f in found], pa.string()), "name": pa.array([f[1] for f in found], pa.string()), "score": pa.array([f[2] for f in found], pa.float64())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[near.Asked] = []
        block = None
        for batch in batches:
            for a in range(batch.num_rows):
                r = batch.slice(a, 1).to_pylist()[0]
                if r["block"] != block:
                    yield table(asked)
                    asked, block = [], r["block"]
                if r["floors"] is not None:
                    asked.append(near.Asked(r["texts"], r["size"], np.array(r["floors"]), n))
                    continue
                names = near.Names(r["texts"], r["size"])
                for texts in asked:
                    if able := [w for w in ways if texts.likely(names.length, w)]:
                        texts.meet(names, able)
        yield table(asked)

    return best


def block_best(typed: DataFrame, names: DataFrame, ways: Sequence[int], n: int) -> DataFrame:
    """typed, name, score: by some ways of ``near``, whatever may be among the n best names of a typed text, of what scores its ``floor`` or more.

    ``typed``: (typed, floor); ``names``: blocks of names.  A task has a share of the texts, whose
    floors rise as the blocks of names go by, the shorter names, which score more, before the longer; so names
    are dealt as often as there are shares, not with each block of texts.
    """
    spark = typed.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    shares = max(1, tasks, -(-typed.count() // TEXTS))
    asked = _packed(typed.withColumn("block", F.pmod(F.xxhash64("typed"), F.lit(shares)).cast("int")), "typed", F.col("floor"))
    every = names.select(F.col("length").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("block"), F.col("names").alias("texts"), F.lit(None).cast("array<double>").alias("floors"))
    dealt = asked.unionByName(every).repartitionById(shares, F.col("block")).sortWithinPartitions("block", F.col("floors").isNull(), "size")
    return dealt.mapInArrow(_of_blocks(ways, n), "typed string, name string, score double")


def near_best(typed: DataFrame, names: DataFrame, *, n: int, least: float) -> DataFrame:
    """typed, name, score (compact forms): the n best names of each typed text by ``fuzzy.alias_score``, of ``least`` or more.

    ``typed``: (typed); ``names``: (name, first).  Each way finds its own n best, among which those
    of all ways are.  The n-th score found so far is a floor for what is to come, so that few
    edits are left to look for: first what holds the other, then names of like length, at last
    longer ones, whose windows and letters in order most names have.
    """
    blocks = kept(_blocks(names.withColumn("floor", F.lit(0.0)), "name", F.col("first"), NAMES).select(F.col("size").alias("length"), F.col("block").alias("part"), F.col("texts").alias("names")), "names")
    found = kept(containment_best(typed, names, n), "held")
    known = found.groupBy("typed").agg(F.when(F.count("*") >= n, F.greatest(F.min("score"), F.lit(least))).alias("floor"))
    floors = kept(typed.join(known.hint("merge"), "typed", "left").select("typed", F.coalesce("floor", F.lit(least)).alias("floor")), "floors")
    more = kept(block_best(floors, blocks, (near.WHOLE, near.IN_ORDER, near.WINDOWS), n), "near")
    more = more.join(names.hint("merge"), "name").select("typed", "name", "score", "first")
    return _ranked(found.select(more.columns).union(more), n).filter(F.col("score") >= least).select("typed", "name", "score")


def best_aliases(typed: DataFrame, index: DataFrame, *, limit: int = 8, least: float = 0.80) -> DataFrame:
    """typed, rank, alias, score of each typed text's best aliases.

    An alias that equals the name, its slug or its compact form stands alone (with others that do),
    and has the score 1; else containment, few edits and abbreviation give scores of ``least`` (0.80
    at least) and more.  Ties go to the shorter, then the smaller alias.  What is typed is kept
    in between, as several joins read it.
    """
    if least < 0.80:
        raise ValueError("candidates are whole for scores from 0.80 on")
    ship_package(typed.sparkSession)
    index = index.hint("merge")
    names = typed.select("typed", typed_name(F.col("typed")).alias("plain")).filter("plain <> ''").distinct().withColumns({"slug": text.slug(F.col("plain")), "compact": text.compact(F.col("plain"))})
    keys = names.select("typed", F.explode(F.array(*(F.struct(F.lit(i).alias("family"), F.col(c).alias("key")) for i, c in enumerate(("plain", "slug", "compact"))))).alias("k")).select("typed", "k.*")
    exact = keys.join(lookups(index).hint("merge"), ["family", "key"]).groupBy("typed", "alias").agg(F.min("family").alias("family")).select("typed", "alias", F.lit(1.0).alias("score"), "family")
    exact = kept(exact, "exact")
    left = kept(names.join(exact.select("typed").distinct().hint("merge"), "typed", "left_anti"), "typed")
    words = left.select(F.col("compact").alias("typed")).filter("typed <> ''").distinct()
    words = kept(words, "words")
    compacts = kept(index.filter("compact <> ''").groupBy(F.col("compact").alias("name")).agg(F.min(F.struct(F.length("alias").alias("n"), "alias")).alias("first")), "compacts")
    scored = near_best(words, compacts, n=limit, least=least)
    found = left.select("typed", F.col("compact").alias("word")).join(scored.withColumnsRenamed({"typed": "word", "name": "compact"}).hint("merge"), "word").join(index.select("compact", "alias").distinct().hint("merge"), "compact")
    near = found.select("typed", "alias", "score", F.lit(0).alias("family"))
    order = Window.partitionBy("typed").orderBy(F.desc("score"), "family", F.when(F.col("score") < 1.0, F.length("alias")), "alias")
    return exact.unionByName(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("typed", "rank", "alias", "score")


def _without(c: Column, k: int) -> Column:
    """What is left of a text when up to k letters are dropped."""
    dropped = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    forms = [F.array(c)]
    for _ in range(k):
        forms.append(F.array_distinct(F.flatten(F.transform(forms[-1], dropped))))
    return F.array_distinct(F.concat(*forms))


def edits_allowed(c: Column) -> Column:
    """One edit for each four letters, one at least and three at most."""
    return F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.length(c) / 4))).cast("int")


def _forms(table: DataFrame, column: str, most: Column) -> DataFrame:
    forms = F.when(most == 1, _without(F.col(column), 1)).when(most == 2, _without(F.col(column), 2)).otherwise(_without(F.col(column), 3))
    return table.select(column, F.explode(F.transform(forms, lambda x: F.xxhash64(x))).alias("form"))


@F.pandas_udf(IntegerType())
def _edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series(fuzzy.edits_of_pairs(a.tolist(), b.tolist()).astype("int32"))


def few_edits(typed: DataFrame, names: DataFrame) -> DataFrame:
    """typed, name, edits: every pair within the edits that the typed text allows. Texts of few edits (swaps included) become equal when as many letters are dropped on either side."""
    ship_package(typed.sparkSession)
    # a name may be up to three letters shorter than what is typed
    longest = F.greatest(F.lit(1), F.least(F.lit(3), F.floor((F.length("name") + 3) / 4)))
    met = _forms(typed, "typed", edits_allowed(F.col("typed"))).join(_forms(names, "name", longest), "form").select("typed", "name").distinct()
    close = met.filter(F.abs(F.length("typed") - F.length("name")) <= edits_allowed(F.col("typed")))
    return _spread(close).withColumn("edits", _edits("typed", "name")).filter(F.col("edits") <= edits_allowed(F.col("typed")))


def station_keys(stations: DataFrame) -> DataFrame:
    """key, place, station: each station's name in lower case, and without or with the word "station" at its end.

    ``stations``: (place, name).  A key that two stations give keeps its first place, and means the later one.
    """
    key = F.lower(F.trim("name"))
    bare = F.expr("regexp_replace(key, ' station$', '')")
    forms = F.when(F.col("key").endswith(" station"), F.array("key", bare)).otherwise(F.array(F.col("key"), F.concat("key", F.lit(" station"))))
    each = stations.withColumn("key", key).select("place", "name", F.posexplode(forms).alias("form", "k")).filter("k <> ''")
    return each.groupBy(F.col("k").alias("key")).agg(F.min(F.struct("place", "form")).alias("place"), F.max_by("name", F.struct("place", "form")).alias("station"))


def destination_station(destinations: DataFrame, stations: DataFrame, *, destination: str = "destination", abbreviations: dict[str, str] = fixed.STATION_ABBREVIATIONS) -> DataFrame:
    """destination, station, way (exact, abbreviation, part, edits), edits: of each distinct destination that finds one.

    Ways go in this order; within one, fewer edits and then the first key win.  Only destinations
    that no way has settled go on to the next.
    """
    spark = destinations.sparkSession
    keys = station_keys(stations)
    typed = destinations.select(destination).distinct().withColumn("typed", F.lower(F.trim(destination))).filter("typed <> ''")
    words = typed.select("typed").distinct()
    short = spark.createDataFrame([*abbreviations.items()], "typed string, key string")
    exact = words.join(keys, F.col("typed") == F.col("key")).select("typed", F.lit(0).alias("way"), F.lit(0).alias("edits"), "place", "station")
    spelt = words.join(F.broadcast(short), "typed").join(keys, "key").select("typed", F.lit(1).alias("way"), F.lit(0).alias("edits"), "place", "station")
    known = exact.union(spelt)
    left = words.join(known.select("typed"), "typed", "left_anti")
    parts = either_holds(left, keys.select(F.col("key").alias("name"))).join(keys, F.col("name") == F.col("key")).select("typed", F.lit(2).alias("way"), F.lit(0).alias("edits"), "place", "station")
    rest = left.join(parts.select("typed").distinct(), "typed", "left_anti")
    edited = few_edits(rest, keys.select(F.col("key").alias("name"))).join(keys, F.col("name") == F.col("key")).select("typed", F.lit(3).alias("way"), "edits", "place", "station")
    best = known.union(parts).union(edited).groupBy("typed").agg(F.min_by(F.struct("station", "way", "edits"), F.struct("way", "edits", "place")).alias("best"))
    names = F.element_at(F.array(*map(F.lit, ("exact", "abbreviation", "part", "edits"))), F.col("best.way") + 1)
    return typed.join(best, "typed").select(destination, F.col("best.station").alias("station"), names.alias("way"), F.col("best.edits").alias("edits"))

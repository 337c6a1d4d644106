"""Entity resolution across portals: a grid join instead of a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, signals, text
from ..functions.geo import haversine_m
from ..session import kept

#: Cells of the grid, in degrees: a little over MATCH_METRES to each side anywhere between 60 degrees south and north.
LAT_STEP, LNG_STEP = 0.0001, 0.0002
#: Rows of a cell that a spot is held against at first, and how many times more each round.
TRIES = 16


PLACE = ["lat", "lng", "beds", "price"]


def _side(df: DataFrame, lat: str, lng: str, key: str) -> DataFrame:
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(
        F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"), text.to_float(F.col("bedrooms")).cast("int").alias("beds"), text.to_float(F.col("price_pcm")).alias("price")
    )


def _celled(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a's rows under ``a_`` with their cell (y, x), and b's under ``b_``, each in its cell and the eight around it, so that a join is an equality on cells."""
    named = lambda df, p: df.toDF(*(f"{p}_{c}" for c in df.columns))
    cell = lambda p: (F.floor(F.col(f"{p}_lat") / LAT_STEP), F.floor(F.col(f"{p}_lng") / LNG_STEP))
    left = named(a, "a").withColumns(dict(zip(("y", "x"), cell("a"), strict=True)))
    right = named(b, "b")
    for name, c in zip(("y", "x"), cell("b"), strict=True):
        right = right.withColumn(name, F.explode(F.array(c - 1, c, c + 1)))
    return left, right


def _fits(price_limit: float, metres: float, a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Whether a pair of a cell matches, and its distance; ``a`` and ``b`` are the prefixes of the sides."""
    apart = haversine_m(F.col(f"{a}_lat"), F.col(f"{a}_lng"), F.col(f"{b}_lat"), F.col(f"{b}_lng"))
    beds = F.coalesce(F.col(f"{a}_beds") == F.col(f"{b}_beds"), F.lit(True))
    price = F.coalesce(F.abs(F.col(f"{a}_price") - F.nullif(F.col(f"{b}_price"), F.lit(0.0))) <= price_limit, F.lit(True))
    return beds & price & (apart <= metres), apart


def _near(a: DataFrame, b: DataFrame, price_limit: float, metres: float) -> DataFrame:
    """Rows of a and b (lat, lng, beds, price and others) that match: columns of a under ``a_``, of b under ``b_``, and ``metres``."""
    left, right = _celled(a, b)
    fits, apart = _fits(price_limit, metres)
    return left.join(right, ["y", "x"]).filter(fits).drop("y", "x").withColumn("metres", apart)


def _first_near(a: DataFrame, b: DataFrame, price_limit: float, metres: float, *, turned: bool = False) -> DataFrame:
    """spot, key: for each spot of a (spot, lat, lng, beds, price) the smallest key of the b rows (lat, lng, beds, price, key) that match it.

    The b rows of a cell have ranks by key.  A spot meets the first ``TRIES`` of its cell, and only
    one that has found none meets the next ranks, ``TRIES`` times as many each round: where rows
    stand close most spots soon find one, so pairs grow with the spots and not with all that
    stands around them.  The last round ends with the last rank, so none is left out.  ``turned``:
    a and b change places in what a match is (a price of nought is unknown on one side only).
    """
    left, right = _celled(a, b)
    fits, _ = _fits(price_limit, metres, *("ba" if turned else "ab"))
    open_ = kept(left, "spots")
    ranked = kept(right.withColumn("rank", F.row_number().over(Window.partitionBy("y", "x").orderBy("b_key")) - 1), "ranked")
    most = ranked.agg(F.max("rank")).first()[0]
    found, low, high = [], 0, TRIES
    while most is not None and low <= most:
        near = open_.join(ranked.filter(F.col("rank").between(low, high - 1)), ["y", "x"]).filter(fits)
        found.append(kept(near.groupBy("a_spot").agg(F.min("b_key").alias("key")), "first"))
        low, high = high, high * TRIES
        if low <= most:
            open_ = kept(open_.join(found[-1], "a_spot", "left_anti"), "spots")
    none = a.sparkSession.createDataFrame([], T.StructType([T.StructField("spot", T.StringType()), T.StructField("key", b.schema["key"].dataType)]))
    return reduce(DataFrame.union, [f.select(F.col("a_spot").alias("spot"), "key") for f in found], none)


def spatial_pairs(a: DataFrame, b: DataFrame, *, lat: str = "latitude", lng: str = "longitude", price_limit: float = fixed.MATCH_PRICE, metres: float = fixed.MATCH_METRES, key: str = "listing_id") -> DataFrame:
    """Pairs (a_key, b_key, metres) within ``metres`` whose bedrooms and prices don't disagree; unknown values agree."""
    return _near(_side(a, lat, lng, key), _side(b, lat, lng, key), price_limit, metres).select("a_key", "b_key", "metres")


def _keyed(df: DataFrame) -> DataFrame:
    """Rows under one text of their place, bedrooms and price, nulls included."""
    return df.withColumn("spot", F.to_json(F.struct(*PLACE), {"ignoreNullFields": "false"}))


def first_matches(a: DataFrame, b: DataFrame, *, lat: str = "latitude", lng: str = "longitude", price_limit: float = fixed.MATCH_PRICE, metres: float = fixed.MATCH_METRES, key: str = "listing_id") -> DataFrame:
    """a_key, b_key: each a row's first b row by key, as ``first_match`` of all pairs gives it.

    Rows of one place, number of bedrooms and price match alike, so only such spots are
    paired, each with its smallest b key: a block of many like flats is a row on either side.
    """
    left, right = _keyed(_side(a, lat, lng, key)), _side(b, lat, lng, key).groupBy(*PLACE).agg(F.min("key").alias("key"))
    spots = left.groupBy("spot").agg(*(F.first(c).alias(c) for c in PLACE))
    best = _first_near(spots, right, price_limit, metres).withColumnRenamed("key", "b_key")
    return left.select(F.col("key").alias("a_key"), "spot").join(best, "spot").select("a_key", "b_key")


def unmatched(a: DataFrame, b: DataFrame, *, lat: str = "latitude", lng: str = "longitude", price_limit: float = fixed.MATCH_PRICE, metres: float = fixed.MATCH_METRES, key: str = "listing_id") -> DataFrame:
    """Rows of b that match no a row, by their spots."""
    right = _keyed(_side(b, lat, lng, key))
    spots = right.groupBy("spot").agg(*(F.first(c).alias(c) for c in PLACE))
    others = _side(a, lat, lng, key).groupBy(*PLACE).agg(F.min("key").alias("key"))
    met = _first_near(spots, others, price_limit, metres, turned=True).select("spot")
    return b.join(right.join(met, "spot").select(F.col("key").alias(key)).distinct(), key, "left_anti")


def first_match(pairs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Each a row's first b row: by ``order`` (b_key, ord), else by key.  One b row may match several a rows."""
    if order is None:
        return pairs.groupBy("a_key").agg(F.min("b_key").alias("b_key"))
    return pairs.join(order, "b_key").groupBy("a_key").agg(F.min_by("b_key", F.struct("ord", "b_key")).alias("b_key"))


def without_duplicates(b: DataFrame, pairs: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows of b that match no a row."""
    return b.join(pairs.select(F.col("b_key").alias(key)).distinct(), key, "left_anti")


def _list(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.coalesce(c, F.array().cast("array<string>"))
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def merged_features(a: Column, b_bullets: Column, b_text: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.nullif(F.concat_ws("\n", blank(a), F.coalesce(blank(b_bullets), blank(b_text))), F.lit(""))


def merge_records(a: DataFrame, b: DataFrame, matches: DataFrame, *, key: str = "listing_id", sources: tuple[str, str, str] = ("a+b", "a", "b")) -> DataFrame:
    """All records: matched a rows enriched by their b row, other a rows, and b rows that matched nothing.

    b's extra fields win where known, other fields fill what a lacks, features are put
    together, and lists of images and paths are united in order.
    """
    renamed = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns), signals.feature_bullets(b.columns).alias("b_bullets"))
    joined = a.join(matches.select(F.col("a_key").alias(key), F.col("b_key").alias(f"b_{key}")), key, "left").join(renamed, f"b_{key}", "left")
    matched = F.col(f"b_{key}").isNotNull()
    out: dict[str, Column] = {}
    for name in a.columns:
        c, d = F.col(name), F.col(f"b_{name}") if name in b.columns else None
        if d is None or name == key:
            out[name] = c
        elif name in fixed.EXTRA_FIELDS:
            out[name] = F.when(matched, F.coalesce(d, c)).otherwise(c)
        elif name in ("image_urls", "discovery_paths"):
            kind = dict(a.dtypes)[name]
            both = F.array_distinct(F.concat(_list(c, kind), _list(d, dict(b.dtypes)[name])))
            out[name] = F.when(matched, both if kind.startswith("array") else F.to_json(both)).otherwise(c)
        elif name == "features":
            out[name] = F.when(matched, merged_features(c, F.col("b_bullets"), d)).otherwise(c)
        elif name in fixed.BACKFILL_FIELDS:
            out[name] = F.when(matched & text.is_blank(c) & ~text.is_blank(d), d).otherwise(c)
        else:
            out[name] = c
    enriched = joined.select(*(c.alias(n) for n, c in out.items()), F.when(matched, sources[0]).otherwise(sources[1]).alias("source_site"), F.col(f"b_{key}").alias("other_id"))
    alone = b.join(matches.select(F.col("b_key").alias(key)).distinct(), key, "left_anti").withColumns({"source_site": F.lit(sources[2]), "other_id": F.lit(None).cast("string")})
    return enriched.unionByName(alone, allowMissingColumns=True)


def regions_of_district(listings: DataFrame, regions: DataFrame, *, district: str = "postcode_district", key: str = "listing_id") -> DataFrame:
    """key and the array of regions (in the dimension's order) whose postcodes hold the district; ``regions`` is a small fixed dimension (ord, name, postcodes)."""
    exploded = F.broadcast(regions.select("ord", "name", F.explode("postcodes").alias("pc")))
    hits = listings.select(key, F.upper(district).alias("pc")).join(exploded, "pc")
    return hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda x: x["name"]).alias("regions"))


def nearest_region(listings: DataFrame, regions: list[tuple[str, float, float]], limit_km: float = 2.0) -> DataFrame:
    """The nearest region's name (``region``) and distance (``km``), null beyond ``limit_km``.  Regions are literals of the plan."""
    from ..functions.geo import haversine_km

    near = [F.struct(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(la), F.lit(lo)).alias("km"), F.lit(n).alias("region")) for n, la, lo in regions]
    best = F.array_min(F.array(*near))
    return listings.withColumn("_near", best).withColumns({"region": F.when(F.col("_near.km") <= limit_km, F.col("_near.region")), "km": F.when(F.col("_near.km") <= limit_km, F.col("_near.km"))}).drop("_near")


def regions_within(listings: DataFrame, regions: list[tuple[str, float, float]], radius_km: float, primary_km: float = 2.0) -> DataFrame:
    """The names of all regions within ``radius_km``, nearest first (``near_regions``), and the nearest if within ``primary_km`` (``primary_region``).

    Regions are literals of the plan.  Rows without coordinates have an empty list.
    """
    from ..functions.geo import haversine_km

    all_ = F.array(*(F.struct(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(la), F.lit(lo)).alias("km"), F.lit(n).alias("region")) for n, la, lo in regions))
    near = F.col("_near")
    first = F.get(near, F.lit(0))
    placed = listings.withColumn("_near", F.array_sort(F.filter(all_, lambda x: x["km"] <= max(radius_km, primary_km))))
    names = F.transform(F.filter(near, lambda x: x["km"] <= radius_km), lambda x: x["region"])
    return placed.withColumns({"near_regions": names, "primary_region": F.when(first["km"] <= primary_km, first["region"])}).drop("_near")


def with_commute(listings: DataFrame, times: DataFrame, *, digits: int = 3) -> DataFrame:
    """All listings, with ``commute_minutes`` of the quickest journey from their rounded coordinates, else null.

    ``times`` (latitude, longitude, minutes) may hold several journeys of one place; it is
    reduced to one row a place before the join, so no listing is repeated.
    """
    at = [F.round(c, digits).alias(f"_{c}") for c in ("latitude", "longitude")]
    quickest = times.select(*at, "minutes").groupBy("_latitude", "_longitude").agg(F.min("minutes").alias("commute_minutes"))
    return listings.withColumns({"_latitude": F.round("latitude", digits), "_longitude": F.round("longitude", digits)}).join(quickest, ["_latitude", "_longitude"], "left").drop("_latitude", "_longitude")



def location_tokens(postcode: Column, district: Column, regions: Column, stations: Column) -> dict[str, Column]:
    """Token arrays of the four families; ``stations`` is an array of names."""
    clean = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    codes = clean(F.array(F.lower(F.regexp_replace(F.coalesce(postcode, F.lit("")), " ", "")), F.lower(F.coalesce(district, F.lit("")))))
    areas = clean(F.flatten(F.transform(F.coalesce(regions, F.array().cast("array<string>")), lambda r: F.array(text.slug(r), F.concat(text.slug(r), F.lit("_london"))))))
    stop = clean(
        F.flatten(F.transform(stations, lambda s: F.array(F.lower(s), text.slug(s), F.when((text.slug(s) != "") & ~text.slug(s).endswith("_station"), F.concat(text.slug(s), F.lit("_station"))))))
    )
    return {"postcode_tokens": codes, "station_tokens": stop, "region_tokens": areas, "tokens": F.array_distinct(F.concat(codes, stop, areas))}


def embed_text(columns: list[str]) -> Column:
    """What is embedded of a listing; 'rental listing' if nothing is known."""
    has = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in columns else F.lit(None).cast("string")
    amenities = F.concat_ws(", ", *(F.when(F.col(f), label) for f, label in fixed.AMENITY_LABELS if f in columns))
    parts = [has("title"), has("address"), F.substring(has("description"), 1, 300), F.substring(has("features"), 1, 200), F.when(amenities != "", F.concat(F.lit("Amenities: "), amenities)), F.concat(F.lit("EPC rating "), has("epc_rating"))]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("rental listing"))

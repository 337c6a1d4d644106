"""Normalising and parsing listing texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _whole(values: Sequence[str]) -> str:
    """A pattern for texts that are one of the values, whatever their case."""
    return "(?i)^(?:" + "|".join(values) + ")$"


def safe_text(c: Column) -> Column:
    """Trimmed text; '' for null and for words that mean unknown."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), _whole(X.UNKNOWN_TEXT), "")


def is_blank(c: Column) -> Column:
    """Whether a field counts as absent when records are merged."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*X.BLANK_FIELD)


def to_float(c: Column) -> Column:
    """The number left when all but digits, points and signs is dropped; null if there is none."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def spaced(c: Column) -> Column:
    """Lower case, with underscores and hyphens as spaces and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[_-]", " "), r"\s+", " "))


def category(c: Column) -> Column:
    return spaced(safe_text(c))


def furnishing(c: Column) -> Column:
    """ask agent, flexible, unfurnished, part-furnished, furnished, or the text itself; each step refers to the value once."""
    s = F.regexp_replace(spaced(c), _whole(X.UNKNOWN_CATEGORY), "ask agent")
    s = F.regexp_replace(s, "^(?:.*furnished or unfurnished.*|(?=.*landlord).*flexible.*)$", "flexible")
    s = F.regexp_replace(s, "^.*unfurn.*$", "unfurnished")
    s = F.regexp_replace(s, "^(?!unfurnished$)(?=.*part).*furnish.*$", "part-furnished")
    return F.regexp_replace(s, "^(?!unfurnished$|part-furnished$).*furnish.*$", "furnished")


def property_class(c: Column) -> Column:
    """flat, house, other, or the type itself."""
    s = spaced(c)
    return (
        F.when(s == "", "").when(s.isin(*X.UNKNOWN_CATEGORY), "other").when(s.isin(*X.FLAT_LIKE), "flat").when(s.isin(*X.HOUSE_LIKE), "house").when(s.isin(*X.OTHER_TYPES), "other").otherwise(s)
    )


def months(c: Column) -> Column:
    return first_number(F.lower(safe_text(c)))


def size_sqm(sqm: Column, sqft: Column) -> Column:
    return F.coalesce(to_float(sqm), to_float(sqft) * F.lit(X.SQM_PER_SQFT))


def slug(c: Column, joiner: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def location_keyword(c: Column) -> Column:
    """A place name as typed: no quotes, hyphens as spaces, single spaces, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, "\"'`‘’“”", "")), "-", " "), r"\s+", " "))


def postcode_district(c: Column) -> Column:
    """The outward code of the first postcode in a text ('' if none)."""
    return F.regexp_extract(F.upper(c), r"\b([A-Z]{1,2}[0-9][A-Z0-9]?)(?:\s*[0-9][A-Z]{2})?\b", 1)


def money(c: Column) -> Column:
    """The first pound amount, as int."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"£\s*([0-9][0-9,]*)", 1), ",", ""), F.lit("")).try_cast("int")


def council_tax(c: Column) -> Column:
    """'Band X' where a text names a band from A to H, else the text; null if empty."""
    band = F.regexp_extract(c, r"(?i)\bband\s+([A-H])\b", 1)
    return F.when(band != "", F.concat(F.lit("Band "), F.upper(band))).otherwise(F.nullif(c, F.lit("")))


def price_of_page(c: Column) -> tuple[Column, Column]:
    """Monthly and weekly rents in a page's text."""
    amount = lambda unit: F.nullif(F.regexp_replace(F.regexp_extract(c, rf"(?i)£\s*([0-9][0-9,]*)\s*{unit}\b", 1), ",", ""), F.lit("")).try_cast("int")
    return amount("pcm"), amount("pw")


def monthly_price(pcm: Column, pw: Column) -> Column:
    """pcm, else the weekly rent times 52 / 12, rounded half to even."""
    return F.coalesce(pcm, F.bround(pw * X.WEEKS_PER_YEAR / X.MONTHS_PER_YEAR).cast("int"))


def largest_size(c: Column, unit: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?i)([0-9][0-9,]*)\s*(?:{unit})"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("int")))


def description_chunks(c: Column) -> Column:
    """Sentences and lines of at least eight characters."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\n+|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 8)


def jsonish_items(c: Column) -> Column:
    """Names of a JSON list or object ('name (m miles)'), else parts between bars, else the text itself."""
    s = safe_text(c)
    item = "struct<name:string,miles:string>"
    name = lambda x: F.when(safe_text(x["miles"]) != "", F.concat(safe_text(x["name"]), F.lit(" ("), safe_text(x["miles"]), F.lit(" miles)"))).otherwise(safe_text(x["name"]))
    named = lambda a: F.transform(F.filter(a, lambda x: safe_text(x["name"]) != ""), name)
    plain = lambda a: F.filter(F.transform(a, safe_text), lambda x: x != "")
    objects, strings, single = F.from_json(s, f"array<{item}>"), F.from_json(s, "array<string>"), F.from_json(s, item)
    return (
        F.when(s == "", F.array().cast("array<string>"))
        .when(s.rlike(r"^\[\s*\{") & objects.isNotNull(), named(objects))
        .when(s.startswith("[") & strings.isNotNull(), plain(strings))
        .when(s.startswith("{") & (safe_text(single["name"]) != ""), named(F.array(single)))
        .when(s.contains("|"), plain(F.split(s, r"\|")))
        .otherwise(F.array(s))
    )


def without_note(c: Column) -> Column:
    """A name without a note in brackets at its end."""
    return F.trim(F.regexp_replace(safe_text(c), r"\s*\([^)]*\)\s*$", ""))


def feature_list(c: Column) -> Column:
    """Features of a JSON list, or of lines and parts between semicolons, without list marks and words that say nothing."""
    parts = lambda s: F.coalesce(F.when(s.startswith("["), F.from_json(s, "array<string>")), F.split(s, "[;\n]"))
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), X.LIST_MARK, ""))
    kept = F.filter(F.transform(let(F.trim(F.coalesce(c, F.lit(""))), parts), clean), lambda x: ~F.lower(x).isin(*X.SKIPPED_FEATURES))
    return F.coalesce(kept, F.array().cast("array<string>"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrases(tokens: Column, sizes: Sequence[int]) -> Column:
    """All runs of so many tokens, space-joined."""

    def runs(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
        return F.when(F.size(tokens) >= n, all_).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def uuid5(c: Column, namespace: str = X.UUID_NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

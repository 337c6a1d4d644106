"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Only DataFrame functions are used.  A kind's pattern is applied twice, as separator
(``split``) and as match (``regexp_extract_all``), so that a match's place is the sum
of the lengths before it; sums are taken in blocks, which keeps texts with very many
matches cheap.  Patterns are possessive and anchored at the starts of runs, so their
time is linear in the text and no group recursion can overflow on long texts.

Validators: an IP's parts are at most 255, a card has 14 to 19 digits and passes Luhn,
a phone number has 10 to 15 digits, an IBAN passes mod-97, a social security number's
parts are given out, a secret (key, token) mixes letters and digits.  Failing matches
are dropped.  Each span has a score: its kind's prior, raised if one of the kind's words
stands within ``CONTEXT`` characters before it.  Base kinds (email, ip, card, phone)
stay whatever their score; others stay from ``KEEP`` on: an IBAN always, a social security
number or a secret only where such words make it likely.

Null texts are empty.  Spans are in code points, the end exclusive, ordered by start and
kind.  Other columns pass through; one named ``pii`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
KEEP = 0.5
#: Matches whose lengths are summed together.
BLOCK = 64

#: Patterns that give the matches of the base patterns (see the tests, which compare both).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"
#: Characters of an account number, by country.
IBAN_SIZES = {
    15: ("NO",), 16: ("BE",), 18: ("DK", "FI", "FO", "GL", "NL"), 19: ("MK", "SI"), 20: ("AT", "BA", "EE", "KZ", "LT", "LU", "XK"), 21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS"), 23: ("AE", "GI", "IL", "IQ", "TL"), 24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("PT", "ST"), 26: ("IS", "TR"), 27: ("FR", "GR", "IT", "MC", "MR", "SM"), 28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "PL", "SV"), 29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU"), 31: ("MT", "SC"), 32: ("LC",),
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIZES.items()) + r")(?![A-Za-z0-9])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn check."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits(x)), ""), lambda c, i: F.when(c == "", 0).otherwise(value(F.nullif(c, F.lit("")), i))), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    flat = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def small_parts(x: Column) -> Column:
    part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) <= 3) & (F.coalesce(v.try_cast("int"), F.lit(0)) <= 255))
    return F.forall(F.split(x, r"\."), part)


def mixed(x: Column) -> Column:
    """Whether a run looks drawn at random: letters and digits, and eight different characters at least."""
    return x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x, ""))) >= 8)


def issued(x: Column) -> Column:
    """Whether the parts of a social security number are among those given out."""
    return ~x.rlike("^(000|666|9)|-00-|-0000$")


SECRET_WORDS = r"token|secret|passw|bearer|credential|api.?key|private.?key"

#: kind, pattern, characters a text must have for a match, validator, prior, words nearby, bonus
KINDS = (
    ("email", EMAIL, "@", None, 0.9, r"mail|contact|correo|kontakt", 0.1),
    ("ip", IP, ".", small_parts, 0.6, r"\bip\b|host|server|addr", 0.3),
    ("card", CARD, None, luhn, 0.7, r"card|visa|credit|karte|tarjeta|carte", 0.3),
    ("phone", PHONE, "+", lambda m: F.length(digits(m)).between(10, 15), 0.6, r"phone|tel|call|mobile|fax", 0.3),
    ("iban", IBAN, None, mod97, 0.6, r"iban|account|konto|cuenta|compte|bank", 0.3),
    ("ssn", SSN, "-", issued, 0.4, r"\bssn\b|social|security", 0.5),
    ("secret", SECRET, None, mixed, 0.3, SECRET_WORDS, 0.6),
)
BASE = ("email", "ip", "card", "phone")

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _prefix_sums(sizes: Column) -> Column:
    """For each element, the sum of those before it."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    bases = lambda sums: F.transform(sums, lambda _, b: add(F.slice(sums, F.lit(1), b)))
    at = lambda base: F.transform(sizes, lambda _, i: F.get(base, F.floor(i / BLOCK).cast("int")) + add(F.slice(sizes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))
    return let(blocks, lambda sums: let(bases(sums), at))


def _spans(text: Column, rank: int, kind: str, pattern: str, needs: str | None, valid, prior: float, words: str, bonus: float) -> Column:
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(f: Column) -> Column:
        sizes = F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["hits"])), f["hits"], lambda g, h: F.length(g) + F.length(h))
        starts = let(sizes, lambda s: F.zip_with(_prefix_sums(s), F.slice(f["gaps"], F.lit(1), F.size(s)), lambda b, g: b + F.length(g)))
        return F.zip_with(starts, f["hits"], lambda s, h: F.struct(s.alias("start"), h.alias("hit")))

    near = lambda s: F.lower(F.substr(text, F.greatest(s - CONTEXT, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT)))).rlike(words)
    span = lambda x: F.struct(
        x["start"].cast("int").alias("start"),
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("kind"),
        (x["start"] + F.length(x["hit"])).cast("int").alias("end"),
        (F.lit(prior) + F.when(near(x["start"]), F.lit(bonus)).otherwise(F.lit(0.0))).alias("score"),
    )
    kept = lambda a: F.transform(F.filter(a, lambda x: valid(x["hit"])) if valid else a, span)
    cheap = text.contains(needs) if needs else F.lit(True)
    some = F.when(cheap & text.rlike(pattern), let(found, lambda f: let(placed(f), kept)))
    return F.coalesce(some.cast(SPAN), F.array().cast(SPAN))


def find_pii(docs: DataFrame, *, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with ``pii``: its spans (start, rank, kind, end, score), ordered by start and kind."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    spans = [F.filter(s, lambda x: x["score"] >= keep) if kind[0] not in BASE else s for rank, kind in enumerate(KINDS) for s in [_spans(body, rank, *kind)]]
    return docs.withColumn("pii", F.array_sort(F.concat(*spans)))


def count_of(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_spans() -> Column:
    return F.filter("pii", lambda x: reduce(lambda a, b: a | b, [x["kind"] == k for k in BASE]))

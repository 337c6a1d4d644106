"""Three-valued amenity signals and red flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def coerce_bool(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "yes", "1", "y", "1.0"), True).when(s.isin("false", "no", "0", "n", "0.0"), False)


def searchable(features: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", features, description))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns occurs, as one expression."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def bool_signal(name: str, columns: Sequence[str]) -> Column:
    """The field if it says yes or no, else what the text denies or affirms, else null."""
    field, yes, no = X.BOOL_SIGNALS[name]
    text = searchable(F.col("features") if "features" in columns else F.lit(None), F.col("description") if "description" in columns else F.lit(None))
    said = F.when(any_match(text, no), False).when(any_match(text, yes), True)
    return F.coalesce(coerce_bool(F.col(field)), said) if field in columns else said


def red_flags(columns: Sequence[str]) -> Column:
    """Labels of the flags that a listing raises; a boolean field decides before texts do."""
    text = F.concat_ws(" ", F.col("description"), F.col("features"))
    labels = []
    for label, (field, clears, raises) in X.RED_FLAGS.items():
        said = ~any_match(text, clears) & any_match(text, raises)
        told = F.coalesce(~coerce_bool(F.col(field)), said) if field in columns else said
        labels.append(F.when(told, F.lit(label)))
    return F.array_compact(F.array(*labels))


def synthetic_phrases(columns: Sequence[str]) -> Column:
    nothing = F.array().cast("array<string>")
    return F.flatten(F.array(*(F.when(bool_signal(n, columns), F.array(*map(F.lit, p))).otherwise(nothing) for n, p in X.SYNTHETIC_PHRASES.items())))


def feature_bullets(columns: Sequence[str]) -> Column:
    """Boolean fields as lines, yes and no; null if none is known."""
    lines = [F.when(F.col(f), yes).when(~F.col(f), no) for f, yes, no in X.FEATURE_LABELS if f in columns]
    if "epc_rating" in columns:
        lines.append(F.when(F.coalesce(F.col("epc_rating"), F.lit("")) != "", F.concat(F.lit("EPC Rating: "), "epc_rating")))
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))

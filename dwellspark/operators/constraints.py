"""What a search asks for, and the algebra on it.  Small driver-side values that become literals of a plan."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame

from ..functions.fixed import DAYS_LATER

DEFAULT_K = 5


@dataclass(frozen=True)
class Layout:
    bedrooms: int | None = None
    bathrooms: float | None = None
    property_type: str = ""
    tag: str = ""
    max_rent: float | None = None

    def like(self, other: Layout) -> bool:
        """Whether it has the rooms, type and tag of ``other``, as far as that one says any."""
        return all(wanted in (None, "") or own == wanted for own, wanted in ((self.bedrooms, other.bedrooms), (self.bathrooms, other.bathrooms), (self.property_type, other.property_type), (self.tag, other.tag)))


@dataclass(frozen=True)
class Constraints:
    max_rent: float | None = None
    layouts: tuple[Layout, ...] = ()
    available_from: str | None = None
    furnish_type: str = ""
    let_type: str = ""
    min_tenancy_months: float | None = None
    min_size_sqm: float | None = None
    bool_preferences: Mapping[str, bool] = field(default_factory=dict)
    locations: tuple[str, ...] = ()
    transit_terms: tuple[str, ...] = ()
    school_terms: tuple[str, ...] = ()
    k: int = DEFAULT_K

    def normalised(self) -> Constraints:
        """Clean values, no repeated layouts or places; one layout's budget is the whole search's."""
        layouts = tuple(OrderedDict.fromkeys(self.layouts))
        rent = self.max_rent
        if len(layouts) == 1 and layouts[0].max_rent is not None:
            rent = layouts[0].max_rent
        places = tuple(OrderedDict.fromkeys(p.strip().lower() for p in self.locations if p.strip()))
        return replace(self, layouts=layouts, max_rent=rent, locations=places, furnish_type=self.furnish_type.strip().lower(), let_type=self.let_type.strip().lower(), k=max(1, self.k))

    def merged(self, new: Mapping[str, Any], *, replace_all: bool = False, append_layouts: bool = False, append_locations: bool = False, remove_layouts: tuple[Layout, ...] = ()) -> Constraints:
        """These constraints with ``new`` values; ``replace_all`` starts afresh.

        Layouts that are like one of ``remove_layouts`` in whatever that one says go first.
        """
        old = Constraints() if replace_all else self
        if remove_layouts:
            old = replace(old, layouts=tuple(x for x in old.layouts if not any(x.like(r) for r in remove_layouts)))
        values = {k: v for k, v in new.items() if v not in (None, "", (), [])}
        if "layouts" in values and append_layouts:
            values["layouts"] = (*old.layouts, *values["layouts"])
        if "locations" in values and append_locations:
            values["locations"] = (*old.locations, *values["locations"])
        if "bool_preferences" in values:
            values["bool_preferences"] = {**old.bool_preferences, **values["bool_preferences"]}
        return replace(old, **values).normalised()

    def cleared(self, *names: str) -> Constraints:
        empty = Constraints()
        return replace(self, **{n: getattr(empty, n) for n in names})

    def derived(self, set_values: Mapping[str, Any], clear: tuple[str, ...] = (), reset: bool = False) -> Constraints:
        """Set, then clear (clearing wins); a reset leaves nothing of before."""
        return (Constraints() if reset else self).merged(set_values).cleared(*clear)

    def hash(self) -> str:
        """Equal for constraints that ask for the same rows, whatever their order or page size."""
        value = asdict(self)
        value.pop("k")
        value["layouts"] = sorted(json.dumps(x, sort_keys=True) for x in ({k: float(v) if isinstance(v, int | float) else v for k, v in layout.items()} for layout in value["layouts"]))
        value["locations"] = sorted(value["locations"])
        value = {k: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for k, v in value.items()}
        return hashlib.md5(json.dumps(value, sort_keys=True).encode()).hexdigest()

    def changes(self, other: Constraints) -> dict[str, tuple[Any, Any]]:
        return {f.name: (getattr(self, f.name), getattr(other, f.name)) for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)}

    def cheaper(self, factor: float = 0.85) -> Constraints:
        return self if self.max_rent is None else replace(self, max_rent=self.max_rent * min(max(factor, 0.5), 0.99))

    def relaxed(self, name: str, attempt: int, original: Constraints) -> Constraints:
        """One constraint made weaker: the budget from its original value, other values dropped or widened."""
        if name == "max_rent" and original.max_rent is not None:
            return replace(self, max_rent=original.max_rent * (1.15 if attempt == 0 else 1.25))
        if name == "min_size_sqm" and self.min_size_sqm is not None:
            return replace(self, min_size_sqm=round(self.min_size_sqm * 0.9, 1))
        if name == "available_from" and self.available_from:
            try:  # a date that can't be read is dropped
                return replace(self, available_from=(date.fromisoformat(self.available_from[:10]) + timedelta(days=DAYS_LATER)).isoformat())
            except ValueError:
                pass
        return self.cleared(name)


class ResultCache:
    """The last few searches' results, kept as cached DataFrames."""

    def __init__(self, size: int = 5):
        self.size = size
        self.held: OrderedDict[str, DataFrame] = OrderedDict()

    def get(self, c: Constraints) -> DataFrame | None:
        if (key := c.hash()) in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        return None

    def put(self, c: Constraints, result: DataFrame) -> DataFrame:
        self.held[c.hash()] = result.cache()
        self.held.move_to_end(c.hash())
        while len(self.held) > self.size:
            self.held.popitem(last=False)[1].unpersist()
        return result

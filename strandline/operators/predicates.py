"""Two-valued predicates over entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Log, matches
from .replay import latest_entities


class Predicate:
    """``test(key, attrs)`` is a column that is true or false, never null; ``attrs`` are the
    attributes of the entity's latest observation, null if there is none."""

    def test(self, key: Column, attrs: Column) -> Column:
        raise NotImplementedError

    def filter(self, log: Log, entities: DataFrame) -> DataFrame:
        latest = latest_entities(log).select(F.col("entity").alias("l_entity"), "attrs")
        joined = entities.join(latest, F.col("entity") == F.col("l_entity"), "left")
        return joined.filter(self.test(F.col("entity"), F.col("attrs"))).select("entity")


class Any(Predicate):
    def test(self, key: Column, attrs: Column) -> Column:
        return F.lit(True)


@dataclass
class EntityType(Predicate):
    """tag: ``any``, ``external`` (ns and kind) or ``internal`` (kind)."""

    tag: str
    ns: str | None = None
    kind: str | None = None

    def test(self, key: Column, attrs: Column) -> Column:
        return F.coalesce(matches(key, F.lit(self.tag), F.lit(self.ns), F.lit(self.kind)), F.lit(False))


@dataclass
class PropertyEquals(Predicate):
    """The attribute is there and equals the value in tag and text; a null equals a null that is there."""

    field: str
    tag: str
    text: str | None = None

    def test(self, key: Column, attrs: Column) -> Column:
        v = F.try_element_at(attrs, F.lit(self.field))
        same = (v["tag"] == self.tag) & v["text"].eqNullSafe(F.lit(self.text))
        return F.coalesce(F.map_contains_key(attrs, self.field) & same, F.lit(False))


@dataclass
class And(Predicate):
    """All hold; of none, true."""

    of: list[Predicate]

    def test(self, key: Column, attrs: Column) -> Column:
        out = F.lit(True)
        for p in self.of:
            out = out & p.test(key, attrs)
        return out


@dataclass
class Or(Predicate):
    """One holds; of none, false."""

    of: list[Predicate]

    def test(self, key: Column, attrs: Column) -> Column:
        out = F.lit(False)
        for p in self.of:
            out = out | p.test(key, attrs)
        return out


@dataclass
class Not(Predicate):
    of: Predicate

    def test(self, key: Column, attrs: Column) -> Column:
        return ~F.coalesce(self.of.test(key, attrs), F.lit(False))

"""Adapters: what generic readings of a certain application are called, as a table of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """Named fields of an application, each with a pattern whose first group is the value."""

    name: str
    patterns: dict[str, str]

    def fields(self, text: Column) -> Column:
        """(field, value) of every field that the text shows, in the order of the table."""
        found = [F.struct(F.lit(k).alias("field"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("value")) for k, p in self.patterns.items()]
        return F.filter(F.array(*found), lambda x: x["value"].isNotNull())


def adapted(text: Column, kind: Column, adapters: tuple[Adapter, ...]) -> Column:
    """Fields by the adapter of each row's application; an unknown one has none."""
    none = F.array().cast("array<struct<field:string,value:string>>")
    return F.coalesce(*[F.when(kind == a.name, a.fields(text)) for a in adapters], none)

"""The alias dictionary: built-in entries, additions and removals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import ALIASES


@dataclass
class Dictionary:
    """Aliases in lower case with their canonical names; a removed built-in stays removed."""

    changes: dict[str, tuple[str | None, str]] = field(default_factory=dict)

    def upsert(self, alias: str, canonical: str, description: str = "") -> None:
        key, value = alias.strip().lower(), canonical.strip().lower()
        if not key or not value:
            raise ValueError("alias and canonical name must not be empty")
        self.changes[key] = (value, description)

    def delete(self, alias: str) -> bool:
        """Remove an entry; whether there was one."""
        key = alias.strip().lower()
        there = key in self.entries()
        self.changes[key] = (None, "")
        return there

    def entries(self) -> dict[str, str]:
        """Alias to canonical name, as ``normalize`` takes it."""
        merged = {**ALIASES, **{k: v for k, (v, _) in self.changes.items()}}
        return {k: v for k, v in merged.items() if v is not None}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """alias, canonical, description, deleted: the changes, to be stored."""
        rows = [(k, v or "", d, v is None) for k, (v, d) in sorted(self.changes.items())]
        return spark.createDataFrame(rows, "alias string, canonical string, description string, deleted boolean")

    @classmethod
    def from_frame(cls, rows: DataFrame) -> Dictionary:
        """A dictionary from stored changes, which are maintained by hand and few."""
        return cls({r["alias"]: (None if r["deleted"] else r["canonical"], r["description"]) for r in rows.collect()})


def replace_aliases(tokens: Column, entries: dict[str, str]) -> Column:
    """Tokens with aliases replaced; a canonical name of several words gives several tokens."""
    table = F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))
    return F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(table[F.lower(t)], t), " ")))

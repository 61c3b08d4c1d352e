"""The reference/query pair every operator starts from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshift.storage import materialize

MISSING = -1.0
REFERENCE, QUERY = 0, 1


def schema_differences(reference: DataFrame, query: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Human-readable differences between the two feature lists (empty when they agree)."""
    left = list(features) if features is not None else reference.columns
    right = [c for c in query.columns if c in set(left)] if features is not None else query.columns
    found = []
    if len(left) != len(right):
        found.append(f"reference has {len(left)} features, query has {len(right)}")
    for position, name in enumerate(left):
        other = right[position] if position < len(right) else None
        if name != other:
            found.append(f"position {position}: reference has {name!r}, query has {other!r}")
    for side, df in (("reference", reference), ("query", query)):
        for field in df.schema.fields:
            if field.name in left and not isinstance(field.dataType, (T.NumericType, T.BooleanType)):
                found.append(f"{side} column {field.name!r} is {field.dataType.simpleString()}, not numeric")
    return found


def as_number(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


def fill_missing(df: DataFrame, features: Sequence[str], value: float = MISSING) -> DataFrame:
    """NULL and NaN become ``value`` in the feature columns."""
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(value)) for c in features}
    )


@dataclass(frozen=True)
class ShiftPair:
    """Two tables with the same numeric features and a row key.

    Keys must be unique within each table; they replace row positions.
    """

    reference: DataFrame
    query: DataFrame
    features: tuple[str, ...]
    key: tuple[str, ...]

    @classmethod
    def from_tables(
        cls, reference: DataFrame, query: DataFrame, key: Sequence[str], features: Sequence[str] | None = None
    ) -> ShiftPair:
        """Check both schemas and keep key and feature columns only, features as doubles."""
        key = tuple(key)
        if features is None:
            features = [c for c in reference.columns if c not in key]
            others = [c for c in query.columns if c not in key]
            problems = schema_differences(reference.select(*features), query.select(*others))
        else:
            problems = schema_differences(reference.select(*features), query.select(*features))
        if problems:
            raise ValueError("reference and query do not match: " + "; ".join(problems))
        columns = [F.col(c) for c in key] + [as_number(c) for c in features]
        return cls(reference.select(*columns), query.select(*columns), tuple(features), key)

    @classmethod
    def from_predicate(
        cls, df: DataFrame, is_reference: Column, key: Sequence[str], features: Sequence[str]
    ) -> ShiftPair:
        """Rows where the predicate holds are the reference; all others are the query."""
        holds = F.coalesce(is_reference, F.lit(False))
        return cls.from_tables(df.filter(holds), df.filter(~holds), key, features)

    def with_missing_filled(self, value: float = MISSING) -> ShiftPair:
        return replace(
            self,
            reference=fill_missing(self.reference, self.features, value),
            query=fill_missing(self.query, self.features, value),
        )

    def stored(self) -> ShiftPair:
        """The pair written once to the shared folder, for work that reads it many times."""
        return replace(
            self, reference=materialize(self.reference, "reference"), query=materialize(self.query, "query")
        )

    def select_features(self, features: Sequence[str]) -> ShiftPair:
        columns = [*self.key, *features]
        return ShiftPair(self.reference.select(*columns), self.query.select(*columns), tuple(features), self.key)

    def drop_features(self, features: Sequence[str]) -> ShiftPair:
        gone = set(features)
        return self.select_features([c for c in self.features if c not in gone])

    def labelled(self) -> DataFrame:
        """Both tables in one, with ``label`` 0 for the reference and 1 for the query."""
        return self.reference.withColumn("label", F.lit(REFERENCE)).unionByName(
            self.query.withColumn("label", F.lit(QUERY))
        )

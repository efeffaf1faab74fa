"""Declared schemas: versions and migration, casts, fingerprints, checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ComponentSpec:
    """A named, versioned table schema."""

    name: str
    schema: T.StructType
    version: int = 1
    migrate: Callable[[int, DataFrame], DataFrame] | None = None

    def read(self, df: DataFrame, version: int) -> DataFrame:
        """``df``, written under ``version``, as this version."""
        if version == self.version:
            return df
        if self.migrate is None:
            raise ValueError(f"{self.name}: version {version} can't be read as {self.version}")
        return self.migrate(version, df)

    def field(self, name: str) -> Column:
        if name not in self.schema.names:
            raise KeyError(f"{self.name} has no field {name!r}; it has {self.schema.names}")
        return F.col(name)


def cast_to(df: DataFrame, target: T.StructType, safe: bool = True) -> DataFrame:
    """Projects and reorders to ``target``: a missing column is an error, others are dropped.

    ``safe``: a value that can't be cast is null; otherwise it is an error when it is read.
    """
    missing = [f.name for f in target if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    cast = (lambda c, t: c.try_cast(t)) if safe else (lambda c, t: F.expr(f"cast(`{c}` as {t.simpleString()})"))
    return df.select(*[(cast(F.col(f.name), f.dataType) if safe else cast(f.name, f.dataType)).alias(f.name) for f in target])


def target_schema(schema: T.StructType, overrides: dict[str, T.DataType]) -> T.StructType:
    unknown = set(overrides) - set(schema.names)
    if unknown:
        raise KeyError(f"no such fields: {sorted(unknown)}")
    return T.StructType([T.StructField(f.name, overrides.get(f.name, f.dataType), f.nullable) for f in schema])


def fingerprint(specs: list[ComponentSpec]) -> int:
    """A 32-bit FNV-1a hash of names, versions and field names; types don't count."""
    state = 0x811C9DC5
    for spec in sorted(specs, key=lambda s: s.name):
        for part in (spec.name.encode(), spec.version.to_bytes(4, "little"), *(n.encode() for n in spec.schema.names)):
            for byte in part:
                state = (state ^ byte) * 0x01000193 & 0xFFFFFFFF
    return state


KINDS = {"double": T.DoubleType, "long": T.LongType, "boolean": T.BooleanType, "string": T.StringType}


def require(df: DataFrame, column: str, kind: str) -> Column:
    """The column, if it is of that type and no other; nothing is cast."""
    if not isinstance(df.schema[column].dataType, KINDS[kind]):
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}, not {kind}")
    return F.col(column)


def require_double(df: DataFrame, column: str) -> Column:
    return require(df, column, "double")


def sum_f64(df: DataFrame, column: str) -> Column:
    """The sum of a double column, nulls skipped, 0 if there is none."""
    return F.coalesce(F.sum(require_double(df, column)), F.lit(0.0))

"""Small text helpers for the oracle SQL twins."""

from __future__ import annotations

from collections.abc import Sequence


def melt_sql(src: str, ids: Sequence[str], variables: Sequence[str], *, dtype: str = "DOUBLE",
             drop_nulls: bool = True, value: str = "value") -> str:
    idl = "".join(f"{i}, " for i in ids)
    parts = []
    for v in variables:
        where = f" WHERE {v} IS NOT NULL" if drop_nulls else ""
        parts.append(f"SELECT {idl}'{v}' AS variable, CAST({v} AS {dtype}) AS {value} FROM {src}{where}")
    return "\nUNION ALL\n".join(parts)


def in_list(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)

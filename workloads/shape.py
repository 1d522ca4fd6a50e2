"""One output layout for a query and its SQL twin.

A layout is a list of ``column[:kind]``: a digit rounds to that many decimals,
``i`` is a bigint, ``l`` joins a list with '|', ``d`` is an ISO date text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloads.oracle import CTES
from workloads.views import VIEWS


def _parse(layout: str) -> list[tuple[str, str]]:
    return [(name, kind) for name, _, kind in (token.partition(":") for token in layout.split())]


def _spark(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.isdigit():
        scale = float(10 ** int(kind))
        return (F.rint(c.cast("double") * scale) / scale + F.lit(0.0)).alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "l":
        return F.array_join(c.cast("array<string>"), "|").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    return c


def _duck(plain: str, kind: str) -> str:
    name = f'"{plain}"'
    if kind.isdigit():
        scale = f"1e{kind}"
        return f"round_even(CAST({name} AS DOUBLE) * {scale}, 0) / {scale} + 0e0 AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "l":
        return f"array_to_string({name}, '|') AS {name}"
    if kind == "d":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    return name


def shape(df: DataFrame, layout: str) -> DataFrame:
    return df.select(*[_spark(name, kind) for name, kind in _parse(layout)])


_NAMES = {**{n: re.sub(r"\{(\w+)\}", r"\1", t) for n, t in VIEWS.items()}, **CTES}


def _needed(sql: str, found: dict[str, str]) -> dict[str, str]:
    for name in re.findall(r"\b[vo]_\w+\b", sql):
        if name in _NAMES and name not in found:
            _needed(_NAMES[name], found)
            found[name] = _NAMES[name]
    return found


def twin(source: str, layout: str) -> str:
    """SELECT over a named relation or a parenthesised query, with what it needs."""
    columns = ",\n  ".join(_duck(name, kind) for name, kind in _parse(layout))
    body = f"SELECT {columns}\nFROM {source}"
    ctes = _needed(source, {})
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in ctes.items()) + "\n" + body

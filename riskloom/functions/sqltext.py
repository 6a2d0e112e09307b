"""Spark SQL text for generated expressions.

Wide generated expressions (a linear predictor, a quadratic form) are built as
one SQL string and parsed once with ``F.expr``, instead of thousands of
Column operations, each a round trip to the JVM.
"""

from __future__ import annotations


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return "%.17e" % v          # exponent form parses as DOUBLE
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def number(v: float) -> str:
    return "%.17e" % float(v)

"""Plain-SQL texts for the oracle side of the registered queries (DuckDB dialect).

These only build SQL strings; nothing here runs on Spark.
"""

from __future__ import annotations

import numpy as np

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

RECORDS_CTE = """records AS (
  SELECT concat_ws('|', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                   CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR),
                   CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS VARCHAR),
                   CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR)) AS row_key,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         l.l_returnflag, l.l_linestatus, o.o_orderpriority, o.o_orderstatus, c.c_mktsegment,
         p.p_type, p.p_brand, l.l_quantity, l.l_discount, CAST(p.p_size AS DOUBLE) AS p_size, c.c_acctbal,
         CAST(year(l.l_shipdate) AS BIGINT) AS ship_year, CAST(year(o.o_orderdate) AS BIGINT) AS order_year
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey),
prepared AS (
  SELECT *, CAST(o_orderstatus IN ('O', 'P') AS INTEGER) AS y,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS y_ord,
         CASE WHEN CAST(ship_year - order_year AS DOUBLE) BETWEEN 0 AND 60
              THEN CAST(ship_year - order_year AS DOUBLE) END AS ship_lag
  FROM records)"""

DOCS_CTE = """docs AS (
  SELECT l.doc_id, l.quality AS y, CAST(d.n_chars AS DOUBLE) / (SELECT max(d2.n_chars) FROM labels l2
         JOIN documents d2 ON l2.doc_id = d2.doc_id) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def lit(x) -> str:
    """SQL literal: doubles in exponent form (parsed as DOUBLE, exact), strings quoted."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return "%.17e" % float(x)
    return "'" + str(x).replace("'", "''") + "'"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def num_text(expr: str) -> str:
    """coerce_numeric in SQL."""
    t = f"trim(CAST({expr} AS VARCHAR))"
    return f"(CASE WHEN regexp_matches({t}, '{NUM_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def normalize_sql(expr: str) -> str:
    t = f"trim(CAST({expr} AS VARCHAR))"
    return (f"(CASE WHEN regexp_matches({t}, '{NUM_RE}') "
            f"THEN coalesce(CAST(CAST(trunc(TRY_CAST({t} AS DOUBLE)) AS BIGINT) AS VARCHAR), {t}) ELSE {t} END)")


def term_sql(spec, term: str, overrides: dict | None = None) -> str:
    col, level = spec.source[term]
    x = lit(overrides[col]) if overrides and col in overrides else col
    if level is None:
        return f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN CAST({x} AS VARCHAR) = {lit(level)} THEN 1.0 ELSE 0.0 END)"


def eta_sql(model, overrides: dict | None = None) -> str:
    parts = [lit(float(model.intercept))]
    for t, b in zip(model.terms, model.coef):
        if b != 0.0:
            parts.append(f"{lit(float(b))} * {term_sql(model.spec, t, overrides)}")
    return "(" + " + ".join(parts) + ")"


def qform_sql(model, overrides: dict | None = None) -> str:
    terms = [term_sql(model.spec, t, overrides) for t in model.terms]
    parts = []
    for i in range(len(terms)):
        for j in range(len(terms)):
            parts.append(f"{lit(float(model.cov[i, j]))} * {terms[i]} * {terms[j]}")
    return "(" + " + ".join(parts) + ")"


def sigmoid_sql(e: str) -> str:
    return f"(1.0 / (1.0 + exp(-({e}))))"


def interval_sql(model, overrides: dict | None = None, z: float = 1.96) -> tuple[str, str, str]:
    e = eta_sql(model, overrides)
    se = f"sqrt(greatest({qform_sql(model, overrides)}, 0.0))"
    return sigmoid_sql(e), sigmoid_sql(f"{e} - {lit(z)} * {se}"), sigmoid_sql(f"{e} + {lit(z)} * {se}")


def case_map(key_expr: str, mapping: dict[str, str]) -> str:
    if not mapping:
        return "CAST(NULL AS VARCHAR)"
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {key_expr} {whens} END)"


def value_label_sql(var_expr: str, value_expr: str, value_labels: dict[str, dict[str, str]]) -> str:
    flat = {f"{v}\u0001{c}": lab for v, codes in value_labels.items() for c, lab in codes.items()}
    raw = f"trim(CAST({value_expr} AS VARCHAR))"
    norm = normalize_sql(raw)
    cands = [raw, f"upper({raw})", norm, f"upper({norm})",
             f"(CASE WHEN regexp_matches({norm}, '^\\d+$') THEN lpad({norm}, 2, '0') END)"]
    looks = [case_map(f"({var_expr} || chr(1) || {c})", flat) for c in cands]
    return f"(CASE WHEN {value_expr} IS NOT NULL AND {raw} <> '' THEN coalesce({', '.join(looks)}) END)"


def variable_label_sql(var_expr: str, variable_labels: dict[str, str]) -> str:
    return f"coalesce({case_map(var_expr, variable_labels)}, regexp_replace({var_expr}, '_', ' ', 'g'))"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"

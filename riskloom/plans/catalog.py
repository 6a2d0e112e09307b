"""Registered queries: every operator bound to the test tables, with its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs on Spark over whole tables.
``ORACLE[name]`` is the same result in plain SQL (DuckDB), where SQL can say it.
Doubles are rounded to 6 decimals on both sides (4 or 3 for large sums).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import labels as LB
from riskloom.functions.scalar import (coerce_numeric, downcast, normalize_code, null_out_of_range,
                                       relative_change_percent, round_numeric)
from riskloom.operators import evaluate as EV
from riskloom.operators import hygiene as HY
from riskloom.operators import profile as PR
from riskloom.operators import report as RP
from riskloom.operators import sampling as SA
from riskloom.operators import whatif as WI
from riskloom.operators.design import fit_design, sparse_dummy_drop, term_stats
from riskloom.operators.linalg import gram_matrix, logistic_information
from riskloom.operators.ordinal import class_probabilities, odds_ratios_ordinal, ordered_predict
from riskloom.operators.score import batch_score, interval_columns, score_with_interval
from riskloom.plans import sqlgen as Q
from riskloom.plans.bindings import (FIXED_LOGIT, FIXED_ORDINAL, prepared_records, scored_documents)
from riskloom.presets import (DEFAULT_SPECIAL_LEVELS,
                              PERSON_AGE_GRID, RECORD_BASELINE_DEFAULTS, RECORD_CONTRAST,
                              RECORD_RISK_PROFILES, RECORD_SCENARIO_LABELS, RECORD_SWITCH_SCENARIOS,
                              RECORD_TERM_OVERRIDES, RECORD_VALUE_LABELS, RECORD_VARIABLE_LABELS, RECORDS,
                              RISK_BANDS, VEHICLE_AGE_GRID, Z_COEF_INTERVAL)
from riskloom.sources.tables import (ingest_csv, read_table, records, shape_summary,
                                     write_table, SCHEMAS)
from riskloom.session import scratch_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    return round_numeric(df, digits)


REC = Q.with_ctes(Q.RECORDS_CTE)
DOC = Q.with_ctes(Q.DOCS_CTE)
CATS = RECORDS.categorical
SPECIALS = ", ".join(Q.lit(v) for v in DEFAULT_SPECIAL_LEVELS)

# --------------------------------------------------------------------------- 2.1 sources


@register("scan_parquet", REC + "SELECT * FROM records")
def q_scan_parquet(spark, d):
    return records(spark, d)


@register("ingest_csv", "SELECT * FROM orders")
def q_ingest_csv(spark, d):
    """orders -> CSV with header -> typed Parquet -> frame (round trip keeps types)."""
    base = scratch_dir(spark, "ingest")
    write_table(read_table(spark, d, "orders"), f"{base}/csv", fmt="csv")
    return ingest_csv(spark, f"{base}/csv", SCHEMAS["orders"], f"{base}/parquet")


@register("ingest_csv_rejects", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count_if(o_orderkey % 50 <> 1) AS n_good, count_if(o_orderkey % 50 = 1) AS n_rejected FROM orders GROUP BY 1""")
def q_ingest_csv_rejects(spark, d):
    """Orders as CSV, of which some have a price that is no number: good rows by year, and rejected lines by the year in them."""
    base = scratch_dir(spark, "ingest")
    orders = read_table(spark, d, "orders")
    bad = orders.select(*[F.when(F.col("o_orderkey") % 50 == 1, F.lit("12 EUR")).otherwise(F.col(c).cast("string")).alias(c) if c == "o_totalprice" else F.col(c) for c in orders.columns])
    write_table(bad, f"{base}/csv", fmt="csv")
    good = ingest_csv(spark, f"{base}/csv", SCHEMAS["orders"], f"{base}/parquet", f"{base}/rejects", {"o_year": F.year("o_orderdate")})
    lines = spark.read.parquet(f"{base}/rejects").select(F.regexp_extract("_corrupt_record", r"(\d{4})-\d\d-\d\dT", 1).cast("int").alias("o_year"))
    both = good.select("o_year", F.lit(1).alias("g")).unionByName(lines.withColumn("g", F.lit(0)))
    return both.groupBy("o_year").agg(F.count_if(F.col("g") == 1).alias("n_good"), F.count_if(F.col("g") == 0).alias("n_rejected"))


_N_RECORD_COLS = 18


@register("shape_summary", REC + f"SELECT count(*) AS n_rows, CAST({_N_RECORD_COLS} AS BIGINT) AS n_cols FROM records")
def q_shape_summary(spark, d):
    return shape_summary(records(spark, d))


# --------------------------------------------------------------------------- 2.2 scalar


@register("coerce_numeric", f"""
SELECT event_id, {Q.num_text("json_extract_string(props, '$.k')")} AS k_num,
       {Q.num_text("event_type")} AS type_num, {Q.num_text("value")} AS value_num
FROM events""")
def q_coerce_numeric(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", coerce_numeric(F.get_json_object("props", "$.k")).alias("k_num"),
                     coerce_numeric("event_type").alias("type_num"), coerce_numeric("value").alias("value_num"))


@register("downcast", """
SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey,
       CAST(l_suppkey AS INTEGER) AS l_suppkey, l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity,
       CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_discount AS FLOAT) AS l_discount,
       CAST(l_tax AS FLOAT) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem""")
def q_downcast(spark, d):
    return downcast(read_table(spark, d, "lineitem"))


@register("derive_age", REC + """
SELECT row_key, ship_year, order_year, CAST(ship_year - order_year AS DOUBLE) AS lag_raw, ship_lag
FROM prepared""")
def q_derive_age(spark, d):
    p = prepared_records(spark, d)
    return p.select("row_key", "ship_year", "order_year",
                    (F.col("ship_year") - F.col("order_year")).cast("double").alias("lag_raw"), "ship_lag")


@register("null_out_of_range", REC + """
SELECT row_key, CASE WHEN l_quantity BETWEEN 1 AND 45 THEN l_quantity END AS l_quantity_valid FROM records""")
def q_null_out_of_range(spark, d):
    return records(spark, d).select("row_key", null_out_of_range("l_quantity", 1.0, 45.0).alias("l_quantity_valid"))


@register("filter_valid_class", REC + "SELECT row_key, y_ord FROM prepared WHERE y_ord IN (1, 2)")
def q_filter_valid_class(spark, d):
    return prepared_records(spark, d).filter(F.col("y_ord").isin(1, 2)).select("row_key", "y_ord")


@register("derive_binary_label", REC + """
SELECT row_key, o_orderstatus, y, CAST(o_orderstatus = 'F' AS INTEGER) AS y_filled FROM prepared""")
def q_derive_binary_label(spark, d):
    return prepared_records(spark, d).select("row_key", "o_orderstatus", "y",
                                             (F.col("o_orderstatus") == "F").cast("int").alias("y_filled"))


@register("drop_missing", REC + "SELECT row_key, ship_lag FROM prepared WHERE ship_lag IS NOT NULL")
def q_drop_missing(spark, d):
    return HY.drop_missing(prepared_records(spark, d), ["ship_lag"]).select("row_key", "ship_lag")


_COLLAPSE_SQL = (f"CASE WHEN l_returnflag IN ({SPECIALS}) THEN 'OTHER' ELSE l_returnflag END AS l_returnflag, "
                 f"CASE WHEN l_linestatus IN ({SPECIALS}) THEN 'OTHER' ELSE l_linestatus END AS l_linestatus")


@register("collapse_special_levels", REC + f"SELECT row_key, {_COLLAPSE_SQL} FROM records")
def q_collapse(spark, d):
    r = HY.collapse_special_levels(records(spark, d), ["l_returnflag", "l_linestatus"])
    return r.select("row_key", "l_returnflag", "l_linestatus")


@register("drop_other_rows", REC + f"""
SELECT * FROM (SELECT row_key, {_COLLAPSE_SQL} FROM records) t
WHERE l_returnflag <> 'OTHER' AND l_linestatus <> 'OTHER'""")
def q_drop_other_rows(spark, d):
    r = HY.collapse_special_levels(records(spark, d), ["l_returnflag", "l_linestatus"])
    return HY.drop_other_rows(r, ["l_returnflag", "l_linestatus"]).select("row_key", "l_returnflag", "l_linestatus")


@register("missing_flag", REC + "SELECT row_key, CAST(ship_lag IS NULL AS TINYINT) AS ship_lag_MISSING FROM prepared")
def q_missing_flag(spark, d):
    p = prepared_records(spark, d)
    imp = HY.fit_median_imputer(p, ["ship_lag"])
    return imp.apply(p).select("row_key", *imp.flag_columns)


@register("normalize_code", REC + f"""
SELECT row_key, lpad(CAST(CAST(p_size AS BIGINT) AS VARCHAR), 2, '0') AS size_code,
       {Q.normalize_sql("lpad(CAST(CAST(p_size AS BIGINT) AS VARCHAR), 2, '0')")} AS size_norm,
       {Q.normalize_sql("CAST(l_quantity AS VARCHAR)")} AS qty_norm,
       {Q.normalize_sql("l_returnflag")} AS flag_norm
FROM records""")
def q_normalize_code(spark, d):
    r = records(spark, d)
    code = F.lpad(F.col("p_size").cast("bigint").cast("string"), 2, "0")
    return r.select("row_key", code.alias("size_code"), normalize_code(code).alias("size_norm"),
                    normalize_code(F.col("l_quantity").cast("string")).alias("qty_norm"),
                    normalize_code("l_returnflag").alias("flag_norm"))


def _size_code_sql():
    return "lpad(CAST(CAST(p_size AS BIGINT) AS VARCHAR), 2, '0')"


@register("decode_labels", REC + f"""
SELECT row_key,
  {Q.value_label_sql("'o_orderstatus'", "o_orderstatus", RECORD_VALUE_LABELS)} AS status_label,
  {Q.value_label_sql("'p_size'", _size_code_sql(), RECORD_VALUE_LABELS)} AS size_label,
  {Q.value_label_sql("'o_orderpriority'", "lower(o_orderpriority)", RECORD_VALUE_LABELS)} AS priority_label
FROM records""")
def q_decode_labels(spark, d):
    code = F.lpad(F.col("p_size").cast("bigint").cast("string"), 2, "0")
    wanted = {"status_label": ("o_orderstatus", F.col("o_orderstatus")), "size_label": ("p_size", code), "priority_label": ("o_orderpriority", F.lower("o_orderpriority"))}
    return LB.decode_labels(records(spark, d), wanted, LB.label_table(spark, RECORD_VALUE_LABELS)).select("row_key", *wanted)


def _term_label_sql(term: str) -> str:
    out = f"regexp_replace({term}, '_', ' ', 'g')"
    for var in sorted(RECORD_VARIABLE_LABELS, key=len):
        marker = f"{var}_"
        code = f"substr({term}, {len(marker) + 1})"
        mapped = Q.value_label_sql(Q.lit(var), code, RECORD_VALUE_LABELS)
        lab = f"coalesce({mapped}, {Q.lit(RECORD_VARIABLE_LABELS[var] + ' (')} || {code} || ')')"
        out = f"(CASE WHEN starts_with({term}, {Q.lit(marker)}) THEN {lab} ELSE {out} END)"
    return f"coalesce({Q.case_map(term, RECORD_TERM_OVERRIDES)}, {out})"


_TERMS_SQL = " UNION ".join(
    f"SELECT DISTINCT '{c}_' || CAST({c} AS VARCHAR) AS term FROM records WHERE {c} IS NOT NULL" for c in CATS
) + " UNION SELECT 'const' UNION SELECT 'l_quantity' UNION SELECT 'ship_lag'"


@register("term_labels", REC + f"SELECT term, {_term_label_sql('term')} AS label FROM ({_TERMS_SQL}) t")
def q_term_labels(spark, d):
    counts = HY.level_counts(records(spark, d), CATS).filter(F.col("level").isNotNull())
    terms = counts.select(F.concat(F.col("variable"), F.lit("_"), F.col("level")).alias("term"))
    extra = spark.range(1).select(F.explode(F.array(F.lit("const"), F.lit("l_quantity"), F.lit("ship_lag"))).alias("term"))
    allt = terms.unionByName(extra).distinct()
    variables = spark.createDataFrame(list(RECORD_VARIABLE_LABELS.items()), "variable string, variable_label string")
    overrides = spark.createDataFrame(list(RECORD_TERM_OVERRIDES.items()), "term string, override string")
    return LB.term_labels(allt, variables, LB.label_table(spark, RECORD_VALUE_LABELS), overrides)


@register("round_numeric", REC + """
SELECT p_brand, count(*) AS count, round(avg(CAST(y AS DOUBLE)), 4) AS event_rate
FROM prepared GROUP BY p_brand""")
def q_round_numeric(spark, d):
    return round_numeric(HY.level_outcome_rates(prepared_records(spark, d), "p_brand", "y", None), 4)


# --------------------------------------------------------------------------- fixed-model scoring (S+)

_P, _LO, _HI = Q.interval_sql(FIXED_LOGIT)


@register("batch_score", REC + f"SELECT row_key, {Q.r6(_P)} AS Predicted_Probability FROM prepared")
def q_batch_score(spark, d):
    return r6(batch_score(prepared_records(spark, d), FIXED_LOGIT).select("row_key", "Predicted_Probability"))


@register("sigmoid_exp", REC + f"""
SELECT row_key, {Q.r6(Q.eta_sql(FIXED_LOGIT))} AS eta, {Q.r6(f"exp({Q.eta_sql(FIXED_LOGIT)})")} AS odds,
       {Q.r6(Q.sigmoid_sql(Q.eta_sql(FIXED_LOGIT)))} AS prob,
       {Q.r6(f"sqrt(greatest({Q.eta_sql(FIXED_LOGIT)}, 0.0))")} AS root_pos, {Q.r6(f"abs({Q.eta_sql(FIXED_LOGIT)})")} AS abs_eta
FROM prepared""")
def q_sigmoid_exp(spark, d):
    from riskloom.functions.scalar import sigmoid
    from riskloom.operators.score import linear_predictor
    eta = linear_predictor(FIXED_LOGIT)
    return r6(prepared_records(spark, d).select(
        "row_key", eta.alias("eta"), F.exp(eta).alias("odds"), sigmoid(eta).alias("prob"),
        F.sqrt(F.greatest(eta, F.lit(0.0))).alias("root_pos"), F.abs(eta).alias("abs_eta")))


@register("score_with_interval", REC + f"""
SELECT row_key, {Q.r6(_P)} AS Predicted_Probability, {Q.r6(_LO)} AS CI_Lower_95, {Q.r6(_HI)} AS CI_Upper_95
FROM prepared""")
def q_score_with_interval(spark, d):
    s = score_with_interval(prepared_records(spark, d), FIXED_LOGIT)
    return r6(s.select("row_key", "Predicted_Probability", "CI_Lower_95", "CI_Upper_95"))


@register("attach_predictions", REC + f"""
SELECT row_key, l_quantity, p_type, o_orderpriority, {Q.r6(_P)} AS Predicted_Probability FROM prepared""")
def q_attach_predictions(spark, d):
    s = batch_score(prepared_records(spark, d).select("row_key", "l_quantity", "p_type", "o_orderpriority",
                                                      *FIXED_LOGIT.spec.features), FIXED_LOGIT)
    return r6(s.select("row_key", "l_quantity", "p_type", "o_orderpriority", "Predicted_Probability"))


def _info_sql() -> str:
    terms = [Q.term_sql(FIXED_LOGIT.spec, t) for t in FIXED_LOGIT.terms]
    w = f"({_P} * (1 - {_P}))"
    sums = []
    for i in range(len(terms)):
        for j in range(len(terms)):
            sums.append(f"sum({w} * {terms[i]} * {terms[j]}) AS s_{i}_{j}")
    rows = []
    p = len(terms)
    for i in range(p):
        for j in range(p):
            rows.append(f"SELECT {i} AS i, {j} AS j, round(s_{i}_{j} / sqrt(s_{i}_{i} * s_{j}_{j}), 6) AS scaled, "
                        + (f"round(ln(s_{i}_{i}), 6)" if i == j else "CAST(NULL AS DOUBLE)") + " AS log_diag FROM info")
    return REC.rstrip("\n") + f",\ninfo AS (SELECT {', '.join(sums)} FROM prepared)\n" + " UNION ALL ".join(rows)


@register("fisher_covariance", _info_sql())
def q_fisher(spark, d):
    """Fisher information of the fixed model over all records, scaled to unit diagonal
    (plus log of the diagonal) so that values compare at fixed precision."""
    import math
    info = logistic_information(FIXED_LOGIT.spec.encode(prepared_records(spark, d)), FIXED_LOGIT.terms,
                                FIXED_LOGIT.coef)
    p = len(FIXED_LOGIT.terms)
    rows = [(i, j, float(round(info[i, j] / math.sqrt(info[i, i] * info[j, j]), 6)),
             float(round(math.log(info[i, i]), 6)) if i == j else None) for i in range(p) for j in range(p)]
    return spark.createDataFrame(rows, "i int, j int, scaled double, log_diag double")


# --------------------------------------------------------------------------- hygiene / aggregation


@register("value_counts", REC + """
SELECT p_type, count(*) AS count, round(count(*) / (SELECT count(p_type) FROM records), 6) AS share
FROM records GROUP BY p_type""")
def q_value_counts(spark, d):
    return r6(HY.value_counts(records(spark, d), "p_type"))


_UNPIVOT_CATS = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level FROM src" for c in CATS)


@register("level_counts_all", REC + f""", src AS (SELECT * FROM records)
SELECT variable, level, count(*) AS count FROM ({_UNPIVOT_CATS}) u GROUP BY variable, level""")
def q_level_counts_all(spark, d):
    return HY.level_counts(records(spark, d), CATS)


def _rare_sql(col: str, share: float, keep: list[str], other: str = "OTHER", src: str = "records") -> str:
    keeps = ", ".join(Q.lit(k) for k in keep)
    return f"""(SELECT level FROM (SELECT CAST({col} AS VARCHAR) AS level, count(*) AS n FROM {src} GROUP BY 1) c
      WHERE level IS NOT NULL AND level NOT IN ({keeps})
        AND n < (SELECT count(*) FROM {src}) * {Q.lit(share)})"""


@register("level_lookup", REC + f"""
SELECT row_key, p_brand, CAST(p_brand IN {_rare_sql('p_brand', 0.04, RECORDS.keep_levels['p_brand'])} AS BOOLEAN) AS is_rare,
       CASE WHEN p_brand IN {_rare_sql('p_brand', 0.04, RECORDS.keep_levels['p_brand'])} THEN 'RARE' ELSE p_brand END AS p_brand_grouped
FROM records""")
def q_level_lookup(spark, d):
    r = records(spark, d)
    rule = HY.fit_rare_levels(r, ["p_brand"], shares={"p_brand": 0.04}, keep_levels=RECORDS.keep_levels,
                              other_label="RARE")
    g = rule.apply(r.select("row_key", F.col("p_brand").alias("_orig"), "p_brand"))
    return g.select("row_key", F.col("_orig").alias("p_brand"), (F.col("p_brand") == "RARE").alias("is_rare"),
                    F.col("p_brand").alias("p_brand_grouped"))


@register("group_rare_levels", REC + f"""
SELECT CASE WHEN p_brand IN {_rare_sql('p_brand', 0.04, RECORDS.keep_levels['p_brand'])} THEN 'RARE' ELSE p_brand END AS p_brand,
       count(*) AS count
FROM records GROUP BY 1""")
def q_group_rare_levels(spark, d):
    r = records(spark, d)
    rule = HY.fit_rare_levels(r, ["p_brand"], shares={"p_brand": 0.04}, keep_levels=RECORDS.keep_levels,
                              other_label="RARE")
    return rule.apply(r).groupBy("p_brand").agg(F.count(F.lit(1)).alias("count"))


def _variablewise_sql(include_other: bool = True) -> str:
    sel = ["row_key", "y"]
    for c in CATS:
        collapsed = f"(CASE WHEN {c} IN ({SPECIALS}) THEN 'OTHER' ELSE CAST({c} AS VARCHAR) END)"
        sel.append(f"{collapsed} AS {c}")
    base = f"coll AS (SELECT {', '.join(sel)} FROM prepared)"
    outs = ["row_key", "y"]
    for c in CATS:
        keep = RECORDS.keep_levels.get(c, RECORDS.default_keep)
        if c in RECORDS.rare_shares:
            bound = f"(SELECT count(*) FROM coll) * {Q.lit(RECORDS.rare_shares[c])}"
        else:
            bound = Q.lit(float(RECORDS.rare_thresholds.get(c, RECORDS.default_threshold)))
        keeps = ", ".join(Q.lit(k) for k in keep)
        rare = (f"(SELECT level FROM (SELECT {c} AS level, count(*) AS n FROM coll GROUP BY 1) x "
                f"WHERE level IS NOT NULL AND level NOT IN ({keeps}) AND n < {bound})")
        outs.append(f"CASE WHEN {c} IN {rare} THEN 'OTHER' ELSE {c} END AS {c}")
    where = "" if include_other else " WHERE " + " AND ".join(f"{c} <> 'OTHER'" for c in CATS)
    return REC.rstrip("\n") + f",\n{base},\nproc AS (SELECT {', '.join(outs)} FROM coll)\n", where


_VW, _ = _variablewise_sql(True)


@register("variablewise_preprocess", _VW + f"SELECT row_key, {', '.join(CATS)} FROM proc")
def q_variablewise(spark, d):
    out, _ = HY.variablewise_preprocess(prepared_records(spark, d), RECORDS)
    return out.select("row_key", *CATS)


@register("variablewise_preprocess_drop_other", _VW + f"SELECT row_key, {', '.join(CATS)} FROM proc WHERE "
          + " AND ".join(f"{c} <> 'OTHER'" for c in CATS))
def q_variablewise_drop(spark, d):
    out, _ = HY.variablewise_preprocess(prepared_records(spark, d), RECORDS, include_other_group=False)
    return out.select("row_key", *CATS)


@register("level_outcome_rates", _VW + """
SELECT p_brand, count(y) AS count, round(avg(CAST(y AS DOUBLE)), 6) AS event_rate
FROM proc GROUP BY p_brand""")
def q_level_outcome_rates(spark, d):
    out, _ = HY.variablewise_preprocess(prepared_records(spark, d), RECORDS)
    return r6(HY.level_outcome_rates(out, "p_brand", "y"))


_UNPIVOT_PROC = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS level, y FROM proc" for c in CATS)


@register("grouped_rates_multi", _VW + f"""
SELECT variable, level, count(y) AS count, round(avg(CAST(y AS DOUBLE)), 6) AS event_rate
FROM ({_UNPIVOT_PROC}) u GROUP BY variable, level""")
def q_grouped_rates_multi(spark, d):
    out, _ = HY.variablewise_preprocess(prepared_records(spark, d), RECORDS)
    return r6(HY.grouped_rates_multi(out, CATS, "y"))


@register("impute_median", REC + """
SELECT row_key, coalesce(ship_lag, (SELECT coalesce(median(ship_lag), 0.0) FROM prepared)) AS ship_lag,
       CAST(ship_lag IS NULL AS TINYINT) AS ship_lag_MISSING,
       coalesce(CASE WHEN l_quantity BETWEEN 1 AND 45 THEN l_quantity END,
                (SELECT median(CASE WHEN l_quantity BETWEEN 1 AND 45 THEN l_quantity END) FROM prepared)) AS l_quantity_valid,
       CAST((CASE WHEN l_quantity BETWEEN 1 AND 45 THEN l_quantity END) IS NULL AS TINYINT) AS l_quantity_valid_MISSING
FROM prepared""")
def q_impute_median(spark, d):
    p = prepared_records(spark, d).withColumn("l_quantity_valid", null_out_of_range("l_quantity", 1.0, 45.0))
    out, flags = HY.impute_median(p, ["ship_lag", "l_quantity_valid"])
    return out.select("row_key", "ship_lag", "ship_lag_MISSING", "l_quantity_valid", "l_quantity_valid_MISSING")


_BASE_FEATS = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "p_type",
               "l_quantity", "l_discount", "p_size", "c_acctbal", "ship_lag"]
_BASE_CATS = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "p_type"]


def _baseline_sql() -> str:
    cols = []
    for c in _BASE_FEATS:
        if c in RECORD_BASELINE_DEFAULTS:
            v = RECORD_BASELINE_DEFAULTS[c]
            cols.append(f"{Q.lit(str(v)) if c in _BASE_CATS else Q.lit(float(v))} AS {c}")
        elif c in _BASE_CATS:
            cols.append(f"(SELECT {c} FROM prepared WHERE {c} IS NOT NULL GROUP BY {c} "
                        f"ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}")
        else:
            cols.append(f"(SELECT median(CAST({c} AS DOUBLE)) FROM prepared) AS {c}")
    return "baseline AS (SELECT " + ", ".join(cols) + ")"


BASE_SQL = REC.rstrip("\n") + ",\n" + _baseline_sql() + "\n"


def _baseline_df(spark, d):
    return PR.baseline_profile(prepared_records(spark, d), _BASE_FEATS, _BASE_CATS, RECORD_BASELINE_DEFAULTS)


@register("baseline_profile", BASE_SQL + "SELECT * FROM baseline")
def q_baseline_profile(spark, d):
    return _baseline_df(spark, d)


def _profile_unpivot_sql() -> str:
    rows = []
    for i, c in enumerate(_BASE_FEATS):
        var = Q.lit(c)
        feat = Q.variable_label_sql(var, RECORD_VARIABLE_LABELS)
        if c in _BASE_CATS:
            lab = Q.value_label_sql(var, c, RECORD_VALUE_LABELS)
            val = f"CASE WHEN {c} IS NULL THEN 'Missing' ELSE coalesce({lab}, trim({c})) END"
        else:
            lab = Q.value_label_sql(var, f"CAST({c} AS VARCHAR)", RECORD_VALUE_LABELS)
            num = (f"CASE WHEN {c} = floor({c}) THEN CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR) "
                   f"ELSE printf('%.1f', {c}) END")
            val = f"CASE WHEN {c} IS NULL THEN 'Missing' ELSE coalesce({lab}, {num}) END"
        rows.append(f"SELECT {i} AS \"Order\", {feat} AS Feature, {val} AS Value FROM baseline")
    return BASE_SQL + " UNION ALL ".join(rows)


@register("profile_unpivot", _profile_unpivot_sql())
def q_profile_unpivot(spark, d):
    return RP.profile_unpivot(_baseline_df(spark, d), _BASE_FEATS, _BASE_CATS, RECORD_VARIABLE_LABELS,
                              RECORD_VALUE_LABELS)


def _format_value_sql() -> str:
    number = "CASE WHEN p_size <= 20 THEN l_quantity WHEN p_size <= 40 THEN l_quantity + 0.375 END"
    shown = f"CASE WHEN ({number}) = floor({number}) THEN CAST(CAST(floor({number}) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {number}) END"
    return REC + f"""SELECT row_key, coalesce({Q.value_label_sql("'o_orderstatus'", "o_orderstatus", RECORD_VALUE_LABELS)}, trim(o_orderstatus)) AS status_shown,
  CASE WHEN ({number}) IS NULL THEN 'Missing' ELSE {shown} END AS quantity_shown FROM records"""


@register("format_value", _format_value_sql())
def q_format_value(spark, d):
    """Every record's status as its label, and a number as Missing, whole, or with one decimal."""
    number = F.when(F.col("p_size") <= 20, F.col("l_quantity")).when(F.col("p_size") <= 40, F.col("l_quantity") + 0.375).cast("double")
    none = F.lit(None)
    return records(spark, d).select("row_key", LB.format_value(F.lit("o_orderstatus"), F.col("o_orderstatus"), none.cast("double"), RECORD_VALUE_LABELS).alias("status_shown"),
                                    LB.format_value(F.lit("l_quantity"), none.cast("string"), number, RECORD_VALUE_LABELS).alias("quantity_shown"))


_PROF_COLS = ["l_returnflag", "ship_lag", "p_size", "l_quantity", "o_orderstatus", "y"]


@register("column_profile", REC + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, (min({c}) <> max({c})) OR (count_if({c} IS NULL) > 0 AND count({c}) > 0) AS varies "
    f"FROM prepared" for c in _PROF_COLS))
def q_column_profile(spark, d):
    return PR.column_profile(prepared_records(spark, d), _PROF_COLS)


# --------------------------------------------------------------------------- evaluation (scored documents)

_THRESHOLDS = EV.threshold_grid()


def _metrics_sql(threshold: float, src: str = "docs", y: str = "y", p: str = "p") -> str:
    """One metrics row for a binary scored table (confusion table -> per label -> row)."""
    return f"""(WITH cm AS (SELECT CAST({y} AS BIGINT) AS actual, CAST({p} >= {Q.lit(threshold)} AS BIGINT) AS predicted,
                      count(*) AS n FROM {src} GROUP BY 1, 2),
     lab AS (SELECT label, sum(tp) AS tp, sum(support) AS support, sum(pred) AS pred, sum(abs_err) AS abs_err FROM (
        SELECT actual AS label, n AS support, 0 AS pred, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp,
               n * abs(actual - predicted) AS abs_err FROM cm
        UNION ALL SELECT predicted, 0, n, 0, 0 FROM cm) u GROUP BY label),
     auc_s AS (SELECT CAST({p} AS DOUBLE) AS score, sum(CAST({y} = 1 AS BIGINT)) AS pos,
                      sum(CAST({y} <> 1 AS BIGINT)) AS neg FROM {src} WHERE {p} IS NOT NULL GROUP BY 1),
     auc_c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM auc_s)
  SELECT CAST(sum(tp) AS DOUBLE) / sum(support) AS Accuracy,
         avg(CASE WHEN support > 0 THEN coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) END) AS Balanced_Accuracy,
         avg(coalesce(CAST(tp AS DOUBLE) / nullif(pred, 0), 0.0)) AS Macro_Precision,
         avg(coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0)) AS Macro_Recall,
         avg(coalesce(2.0 * tp / nullif(pred + support, 0), 0.0)) AS Macro_F1,
         (SELECT sum(pos * (nb + 0.5 * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) FROM auc_c) AS ROC_AUC,
         CAST(sum(abs_err) AS DOUBLE) / sum(support) AS MAE
  FROM lab)"""


_MCOLS = ["Accuracy", "Balanced_Accuracy", "Macro_Precision", "Macro_Recall", "Macro_F1", "ROC_AUC", "MAE"]


def _r6_cols(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@register("confusion_matrix", DOC + f"""
SELECT a.v AS actual, b.v AS predicted, (SELECT count(*) FROM docs WHERE y = a.v AND CAST(p >= 2.0 AS BIGINT) = b.v) AS n
FROM (SELECT DISTINCT CAST(y AS BIGINT) AS v FROM docs UNION SELECT DISTINCT CAST(p >= 2.0 AS BIGINT) FROM docs) a,
     (SELECT DISTINCT CAST(y AS BIGINT) AS v FROM docs UNION SELECT DISTINCT CAST(p >= 2.0 AS BIGINT) FROM docs) b""")
def q_confusion_matrix(spark, d):
    """At a threshold that no score reaches: the cells of the label that is never predicted are there with 0."""
    s = scored_documents(spark, d)
    return EV.confusion_matrix(s.withColumn("pred", EV.predict_at("p", 2.0)), "y", "pred")


@register("confusion_matrix_observed", DOC + """
SELECT CAST(y AS BIGINT) AS actual, CAST(p >= 0.1 AS BIGINT) AS predicted, count(*) AS n FROM docs GROUP BY 1, 2""")
def q_confusion_matrix_observed(spark, d):
    s = scored_documents(spark, d)
    return EV.confusion_matrix(s.withColumn("pred", EV.predict_at("p", 0.1)), "y", "pred").where("n > 0")


@register("classification_metrics", DOC + f"SELECT {_r6_cols(_MCOLS)} FROM {_metrics_sql(0.1)} m")
def q_classification_metrics(spark, d):
    m = EV.evaluate_binary(scored_documents(spark, d), "y", "p", 0.1, "docs")
    return r6(m.select(*_MCOLS))


@register("classification_report", DOC + """, cm AS (
  SELECT CAST(y AS BIGINT) AS actual, CAST(p >= 0.1 AS BIGINT) AS predicted, count(*) AS n FROM docs GROUP BY 1, 2),
lab AS (SELECT label, sum(tp) AS tp, sum(support) AS support, sum(pred) AS pred FROM (
        SELECT actual AS label, n AS support, 0 AS pred, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM cm
        UNION ALL SELECT predicted, 0, n, 0 FROM cm) u GROUP BY label)
SELECT label, round(coalesce(CAST(tp AS DOUBLE) / nullif(pred, 0), 0.0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(pred + support, 0), 0.0), 6) AS f1, CAST(support AS BIGINT) AS support
FROM lab""")
def q_classification_report(spark, d):
    s = scored_documents(spark, d)
    cm = EV.confusion_matrix(s.withColumn("pred", EV.predict_at("p", 0.1)), "y", "pred")
    rep = EV.classification_report(cm)
    return r6(rep.select(F.col("label"), "precision", "recall", "f1", F.col("support").cast("bigint").alias("support")))


@register("roc_auc", DOC + f"SELECT round(ROC_AUC, 6) AS ROC_AUC FROM {_metrics_sql(0.5)} m")
def q_roc_auc(spark, d):
    return r6(EV.roc_auc(scored_documents(spark, d), "y", "p"))


def _sweep_sql() -> str:
    rows = []
    for k, t in enumerate(_THRESHOLDS):
        tp = f"count_if(p >= {Q.lit(t)} AND y = 1)"
        fp = f"count_if(p >= {Q.lit(t)} AND y = 0)"
        tpr = f"(CAST({tp} AS DOUBLE) / nullif(count_if(y = 1), 0))"
        tnr = f"(CAST(count_if(y = 0) - {fp} AS DOUBLE) / nullif(count_if(y = 0), 0))"
        bacc = f"CASE WHEN {tpr} IS NULL THEN {tnr} WHEN {tnr} IS NULL THEN {tpr} ELSE ({tpr} + {tnr}) / 2 END"
        rows.append(f"SELECT {k} AS k, {Q.lit(t)} AS t, {bacc} AS bacc FROM docs")
    return DOC + f"""SELECT t AS best_threshold, round(bacc, 6) AS best_balanced_accuracy
FROM ({' UNION ALL '.join(rows)}) s ORDER BY bacc DESC, k ASC LIMIT 1"""


@register("threshold_sweep", _sweep_sql())
def q_threshold_sweep(spark, d):
    return r6(EV.threshold_sweep(scored_documents(spark, d), "y", "p"))


def _eval_rows(spark, d):
    s = scored_documents(spark, d)
    ab = EV.evaluate_at(s, "y", "p", [("length score @0.10", 0.1), ("length score @0.50", 0.5)])
    return ab.unionByName(EV.evaluate_binary(s.withColumn("p2", F.lit(1.0) - F.col("p")), "y", "p2", 0.9, "inverse length @0.90"))


def _eval_rows_sql() -> str:
    cte = Q.DOCS_CTE + ",\ndocs2 AS (SELECT doc_id, y, 1.0 - p AS p FROM docs)"
    def matrix(t: float, src: str = "docs") -> str:
        n = [[f"count_if(y = {a} AND p {'>=' if b else '<'} {t})" for b in (0, 1)] for a in (0, 1)]
        return (f"(SELECT '[[' || {n[0][0]} || ', ' || {n[0][1]} || '], [' || {n[1][0]} || ', ' || {n[1][1]} || ']]' "
                f"FROM {src}) AS Confusion_Matrix")

    parts = [f"SELECT 'length score @0.10' AS Model, 0.1 AS Threshold, m.*, {matrix(0.1)} FROM {_metrics_sql(0.1)} m",
             f"SELECT 'length score @0.50', 0.5, m.*, {matrix(0.5)} FROM {_metrics_sql(0.5)} m",
             f"SELECT 'inverse length @0.90', 0.9, m.*, {matrix(0.9, 'docs2')} FROM {_metrics_sql(0.9, 'docs2')} m"]
    return Q.with_ctes(cte) + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") r"


_EVAL_SQL = _eval_rows_sql()


@register("union_results", _EVAL_SQL.replace("SELECT * FROM (", f"SELECT Model, Threshold, {_r6_cols(_MCOLS)}, Confusion_Matrix FROM (", 1))
def q_union_results(spark, d):
    return r6(_eval_rows(spark, d))


@register("rename_and_pad", _EVAL_SQL.replace(
    "SELECT * FROM (", "SELECT Model, 'Binary Logit' AS Family, "
    + _r6_cols(["Accuracy", "Balanced_Accuracy", "Macro_F1", "ROC_AUC", "MAE"]) + " FROM (", 1))
def q_rename_and_pad(spark, d):
    return r6(EV.standardize_metrics(_eval_rows(spark, d), "Binary Logit"))


@register("comparison_table", _EVAL_SQL.replace("SELECT * FROM (", f"SELECT Model, Threshold, {_r6_cols(_MCOLS)}, Confusion_Matrix, "
          "row_number() OVER (ORDER BY ROC_AUC DESC NULLS LAST, Model) AS Position FROM (", 1))
def q_comparison_table(spark, d):
    return RP.with_position(r6(EV.comparison_table(_eval_rows(spark, d))))


@register("sort_results", _EVAL_SQL.replace(
    "SELECT * FROM (", "SELECT Model, 'Binary Logit' AS Family, "
    + _r6_cols(["Accuracy", "Balanced_Accuracy", "Macro_F1", "ROC_AUC", "MAE"])
    + ", row_number() OVER (ORDER BY ROC_AUC DESC NULLS LAST, Model) AS Position FROM (", 1))
def q_sort_results(spark, d):
    return RP.with_position(r6(EV.sort_results(EV.standardize_metrics(_eval_rows(spark, d), "Binary Logit"))))


@register("metric_ranking", _EVAL_SQL.replace("SELECT * FROM (", "SELECT Model, round(Macro_F1, 6) AS Macro_F1, "
          "row_number() OVER (ORDER BY Macro_F1 DESC, Model) AS Position FROM (", 1) + " WHERE Macro_F1 IS NOT NULL")
def q_metric_ranking(spark, d):
    return RP.with_position(r6(RP.metric_ranking(_eval_rows(spark, d), "Macro_F1").select("Model", "Macro_F1")))


_SUMMARY_SQL = f"""SELECT count(p) AS n_draws, round(avg(p), 6) AS mean_probability, round(median(p), 6) AS median_probability,
       round(stddev_samp(p), 6) AS std_probability, round(min(p), 6) AS min_probability,
       round(quantile_cont(p, 0.05), 6) AS p05_probability, round(quantile_cont(p, 0.25), 6) AS p25_probability,
       round(quantile_cont(p, 0.75), 6) AS p75_probability, round(quantile_cont(p, 0.95), 6) AS p95_probability,
       round(max(p), 6) AS max_probability"""


@register("distribution_summary", DOC + _SUMMARY_SQL + " FROM docs")
def q_distribution_summary(spark, d):
    return r6(PR.distribution_summary(scored_documents(spark, d), "p"))


def _bands_sql(src: str, col: str) -> str:
    parts = []
    for i, (label, lo, hi) in enumerate(RISK_BANDS):
        cond = " AND ".join(([f"{col} >= {Q.lit(lo)}"] if lo is not None else []) +
                            ([f"{col} < {Q.lit(hi)}"] if hi is not None else []))
        parts.append(f"SELECT {i} AS Band_Order, {Q.lit(label)} AS Risk_Band, count_if({cond}) AS Count, "
                     f"round(CAST(count_if({cond}) AS DOUBLE) / nullif(count(*), 0), 6) AS Share FROM {src}")
    return " UNION ALL ".join(parts)


@register("risk_bands", DOC + _bands_sql("docs", "p"))
def q_risk_bands(spark, d):
    return r6(PR.risk_bands(scored_documents(spark, d), "p"))


@register("ordered_category_sort", DOC + f"SELECT *, row_number() OVER (ORDER BY Band_Order) AS Position FROM ({_bands_sql('docs', 'p')}) b")
def q_ordered_category_sort(spark, d):
    bands = r6(PR.risk_bands(scored_documents(spark, d), "p")).orderBy("Count")
    return RP.with_position(RP.ordered_category_sort(bands, "Risk_Band", [b[0] for b in RISK_BANDS]))


@register("histogram", DOC + """, rng AS (SELECT min(p) AS lo, max(p) AS hi FROM docs),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((p - lo) / ((hi - lo) / 40.0)) AS BIGINT) + 1, 40) END AS bin
      FROM docs, rng WHERE p IS NOT NULL)
SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 40.0, 6) AS bin_lower, round(lo + g.bin * (hi - lo) / 40.0, 6) AS bin_upper,
       coalesce(c.n, 0) AS count
FROM (SELECT range AS bin FROM range(1, 41)) g CROSS JOIN rng LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c ON g.bin = c.bin""")
def q_histogram(spark, d):
    return r6(PR.histogram(scored_documents(spark, d), "p", 40))


# --------------------------------------------------------------------------- sampling


@register("sample_n", REC + """
SELECT row_key, l_orderkey, p_type, l_quantity FROM records ORDER BY md5('42:' || row_key), row_key LIMIT 5000""")
def q_sample_n(spark, d):
    return SA.sample_n(records(spark, d), 5000, 42).select("row_key", "l_orderkey", "p_type", "l_quantity")


@register("stratified_split", REC + """
SELECT row_key, y, CAST(rn <= (n * 300000 + 999999) // 1000000 AS INTEGER) AS is_test FROM (
  SELECT row_key, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_key), row_key) AS rn,
         count(*) OVER (PARTITION BY y) AS n FROM prepared) t""")
def q_stratified_split(spark, d):
    return SA.stratified_split(stored(prepared_records(spark, d).select("row_key", "y")), "y", 0.30, 42).select("row_key", "y", "is_test")


_BOOT_SQL = REC + """, idx AS (
  SELECT row_key, row_number() OVER (ORDER BY md5('42:' || row_key), row_key) - 1 AS i FROM records),
draws AS (SELECT range AS draw_id,
  ('0x' || substr(md5('42:draw:' || CAST(range AS VARCHAR)), 1, 15))::BIGINT % (SELECT count(*) FROM records) AS i
  FROM range(0, 5000))
"""


@register("bootstrap_sample", _BOOT_SQL + "SELECT d.draw_id, x.row_key FROM draws d JOIN idx x ON d.i = x.i")
def q_bootstrap_sample(spark, d):
    return SA.bootstrap_sample(spark, records(spark, d), 5000, 42).select("draw_id", "row_key")


_REPLICATES = 20


def _replicates_sql() -> str:
    limits = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in SA.POISSON_LIMITS)
    return REC + f""", u AS (SELECT CAST(range AS INTEGER) AS replicate, l_quantity AS v,
  ('0x' || substr(md5('42:poisson:' || CAST(range // 4 AS VARCHAR) || ':' || row_key), 1 + 8 * (range % 4), 8))::BIGINT AS u FROM records, range(0, {_REPLICATES})),
w AS (SELECT replicate, v, {limits} AS w FROM u)
SELECT replicate, CAST(sum(w) AS BIGINT) AS n_draws, round(sum(w * v) / sum(w), 6) AS mean,
       round(sqrt(greatest((sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)) / (sum(w) - 1), 0.0)), 6) AS std, min(v) AS min, max(v) AS max
FROM w WHERE w > 0 GROUP BY replicate"""


@register("bootstrap_replicates", _replicates_sql())
def q_bootstrap_replicates(spark, d):
    return r6(SA.bootstrap_replicates(records(spark, d), F.col("l_quantity"), _REPLICATES, 42))


# --------------------------------------------------------------------------- encoding and pruning

_ENC_FEATS = ["l_quantity", "p_size", "l_returnflag", "l_linestatus", "o_orderpriority", "p_type"]
_ENC_CATS = ["l_returnflag", "l_linestatus", "o_orderpriority", "p_type"]


def _enc_spec(spark, d):
    return fit_design(records(spark, d), _ENC_FEATS, _ENC_CATS)


@register("dummy_encode", None)
def q_dummy_encode(spark, d):
    spec = _enc_spec(spark, d)
    return spec.encode(records(spark, d), keep=["row_key"])


@register("encode_with_training_levels", None)
def q_encode_training_levels(spark, d):
    r = records(spark, d)
    spec = fit_design(r.filter(F.col("l_returnflag") != "N"), ["l_returnflag", "p_size"], ["l_returnflag"])
    return spec.encode(r, keep=["row_key", "l_returnflag"])


ORACLE["encode_with_training_levels"] = REC + """
SELECT row_key, l_returnflag, CAST(p_size AS DOUBLE) AS p_size,
       CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS l_returnflag_R FROM records"""


_SP_FEATS = ["p_type", "l_returnflag", "o_orderpriority", "c_mktsegment"]


@register("sparse_dummy_prune", None)
def q_sparse_dummy_prune(spark, d):
    p = prepared_records(spark, d)
    spec = fit_design(p, _SP_FEATS, _SP_FEATS)
    enc = spec.encode(p, keep=["y"])
    st = term_stats(enc, spec.terms, "y", spec=spec)[0]
    drop = set(sparse_dummy_drop(st, spec.terms))
    rows = [(t, st.active[t], st.n - st.active[t], st.active_pos[t], st.active[t] - st.active_pos[t], t not in drop)
            for t in spec.terms]
    return spark.createDataFrame(rows, "Term string, Active bigint, Inactive bigint, Active_Pos bigint, "
                                       "Active_Neg bigint, Keep boolean")


def _sparse_sql() -> str:
    parts = []
    for c in _SP_FEATS:
        parts.append(f"""SELECT '{c}_' || level AS Term, a AS Active, n - a AS Inactive, ap AS Active_Pos, a - ap AS Active_Neg,
  (a >= greatest(8, CAST(floor(0.0005 * n) AS BIGINT)) AND n - a > 0 AND ap > 0 AND a - ap > 0
   AND least(ap, a - ap) >= greatest(2, CAST(floor(0.00005 * n) AS BIGINT))) AS Keep
FROM (SELECT {c} AS level, count(*) AS a, sum(y) AS ap, (SELECT count(*) FROM prepared) AS n FROM prepared
      WHERE {c} IS NOT NULL GROUP BY {c}) t
WHERE level > (SELECT min({c}) FROM prepared)""")
    return REC + "SELECT Term, Active, Inactive, CAST(Active_Pos AS BIGINT) AS Active_Pos, CAST(Active_Neg AS BIGINT) AS Active_Neg, Keep FROM (" + " UNION ALL ".join(parts) + ") s"


ORACLE["sparse_dummy_prune"] = _sparse_sql()

_GRAM_TERMS = ["l_quantity", "l_discount", "l_linestatus_O", "p_type_LARGE", "p_type_SMALL"]


def _gram_term_sql(t: str) -> str:
    if t.startswith("l_linestatus_"):
        return f"(CASE WHEN l_linestatus = '{t.split('_', 2)[2]}' THEN 1.0 ELSE 0.0 END)"
    if t.startswith("p_type_"):
        return f"(CASE WHEN p_type = '{t.split('_', 2)[2]}' THEN 1.0 ELSE 0.0 END)"
    return f"CAST({t} AS DOUBLE)"


@register("gram_matrix", REC + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, round(sum({_gram_term_sql(a)} * {_gram_term_sql(b)}), 4) AS value FROM records"
    for i, a in enumerate(_GRAM_TERMS) for j, b in enumerate(_GRAM_TERMS)))
def q_gram_matrix(spark, d):
    from riskloom.operators.design import DesignSpec
    src = {"l_quantity": ("l_quantity", None), "l_discount": ("l_discount", None),
           "l_linestatus_O": ("l_linestatus", "O"), "p_type_LARGE": ("p_type", "LARGE"),
           "p_type_SMALL": ("p_type", "SMALL")}
    spec = DesignSpec([], [], {}, list(_GRAM_TERMS), src)
    g = gram_matrix(spec.encode(records(spark, d)), _GRAM_TERMS)
    rows = [(i, j, float(round(g[i, j], 4))) for i in range(len(_GRAM_TERMS)) for j in range(len(_GRAM_TERMS))]
    return spark.createDataFrame(rows, "i int, j int, value double")


@register("duplicate_columns", None)
def q_duplicate_columns(spark, d):
    """Terms equal to an earlier one; ``almost`` differs from l_linestatus in the rows of one order only and must stay."""
    from riskloom.operators.linalg import column_summary, equal_columns
    r = stored(records(spark, d).select("l_orderkey", "l_returnflag", "l_linestatus", "o_orderpriority"))
    one = F.col("l_orderkey") == r.agg(F.min("l_orderkey")).scalar()
    almost = F.when(one, F.when(F.col("l_linestatus") == "O", F.lit("F")).otherwise(F.lit("O"))).otherwise(F.col("l_linestatus"))
    r = r.withColumn("status_copy", F.col("l_linestatus")).withColumn("almost", almost)
    cats = ["l_returnflag", "l_linestatus", "status_copy", "o_orderpriority", "almost"]
    spec = fit_design(r, cats, cats)
    enc = spec.encode(r)
    _, prints = column_summary(enc, spec.terms)
    equal = equal_columns(enc, spec.terms, prints, [F.lit(True)])[0]
    return spark.createDataFrame([(t, of) for t, of in equal.items() if t != of], "Term string, Duplicate_Of string")


def _duplicate_sql() -> str:
    """Every later column against the first, row by row."""
    almost = "CASE WHEN l_orderkey = (SELECT min(l_orderkey) FROM records) THEN CASE WHEN l_linestatus = 'O' THEN 'F' ELSE 'O' END ELSE l_linestatus END"
    later = [f"SELECT '{n}_O' AS Term, 'l_linestatus_O' AS Duplicate_Of FROM records HAVING bool_and(({x} = 'O') = (l_linestatus = 'O'))"
             for n, x in (("status_copy", "l_linestatus"), ("almost", almost))]
    return REC + " UNION ALL ".join(later)


ORACLE["duplicate_columns"] = _duplicate_sql()


# --------------------------------------------------------------------------- what-if with the fixed model


def _pop_sql() -> str:
    return "pop AS (SELECT * FROM prepared)"


def _switch_sql() -> str:
    pb = Q.sigmoid_sql(Q.eta_sql(FIXED_LOGIT))
    sel = [f"avg({pb}) AS pb"]
    for i, (_, var, v) in enumerate(RECORD_SWITCH_SCENARIOS):
        ov = {} if v is None else {var: v}
        p, lo, hi = Q.interval_sql(FIXED_LOGIT, ov)
        sel += [f"avg({p}) AS p{i}", f"avg({lo}) AS lo{i}", f"avg({hi}) AS hi{i}"]
    for var in sorted({v for _, v, _ in RECORD_SWITCH_SCENARIOS}):
        sel.append(f"CASE WHEN min(CAST({var} AS VARCHAR)) = max(CAST({var} AS VARCHAR)) THEN min(CAST({var} AS VARCHAR)) END AS base_{var}")
    rows = []
    for i, (name, var, v) in enumerate(RECORD_SWITCH_SCENARIOS):
        sv = f"base_{var}" if v is None else Q.lit(str(v))
        rows.append(f"""SELECT {i} AS Scenario_Order, {Q.lit(name)} AS Scenario, {Q.lit(var)} AS Variable,
  base_{var} AS Baseline_Value, {sv} AS Scenario_Value, round(p{i}, 6) AS Predicted_Probability,
  round(lo{i}, 6) AS CI_Lower_95, round(hi{i}, 6) AS CI_Upper_95, round(p{i} - pb, 6) AS Absolute_Change,
  round((p{i} - pb) / nullif(pb, 0) * 100.0, 6) AS Relative_Change_Percent FROM one""")
    return REC.rstrip("\n") + f",\none AS (SELECT {', '.join(sel)} FROM prepared)\n" + " UNION ALL ".join(rows)


_SWITCH_SQL = _switch_sql()


def _switch_df(spark, d):
    return WI.what_if_switch(stored(prepared_records(spark, d).select(*FIXED_LOGIT.spec.features)), FIXED_LOGIT, RECORD_SWITCH_SCENARIOS)


@register("what_if_switch", _SWITCH_SQL)
def q_what_if_switch(spark, d):
    return r6(_switch_df(spark, d))


@register("relative_change", REC + """
SELECT row_key, round((l_quantity - l_discount) / nullif(l_discount, 0) * 100.0, 6) AS change_percent FROM records""")
def q_relative_change(spark, d):
    """Per record: the change from the discount to the quantity; NULL where the base is 0."""
    return r6(records(spark, d).select("row_key", relative_change_percent(F.col("l_quantity"), F.col("l_discount")).alias("change_percent")))


@register("tornado_table", "SELECT Scenario, Variable, Absolute_Change, CAST(sign(Absolute_Change) AS INTEGER) AS Direction FROM ("
          + _SWITCH_SQL + f") s WHERE Scenario <> {Q.lit(RECORD_SWITCH_SCENARIOS[0][0])}")
def q_tornado(spark, d):
    return RP.tornado_table(r6(_switch_df(spark, d)), RECORD_SWITCH_SCENARIOS[0][0])


_SCEN_LABEL_SQL = (
    "SELECT Scenario, Variable, Scenario_Value, "
    + f"""CASE WHEN Scenario = {Q.lit(RECORD_SWITCH_SCENARIOS[0][0])} THEN 'Baseline (urgent priority)'
      WHEN {Q.case_map("(Variable || chr(1) || " + Q.normalize_sql("Scenario_Value") + ")",
                       {f"{v}{chr(1)}{c}": lab for (v, c), lab in RECORD_SCENARIO_LABELS.items()})} IS NOT NULL
        THEN {Q.variable_label_sql("Variable", RECORD_VARIABLE_LABELS)} || ': ' || {Q.case_map("(Variable || chr(1) || " + Q.normalize_sql("Scenario_Value") + ")",
                       {f"{v}{chr(1)}{c}": lab for (v, c), lab in RECORD_SCENARIO_LABELS.items()})}
      WHEN {Q.value_label_sql("Variable", Q.normalize_sql("Scenario_Value"), RECORD_VALUE_LABELS)} IS NOT NULL
        THEN {Q.variable_label_sql("Variable", RECORD_VARIABLE_LABELS)} || ': ' || {Q.value_label_sql("Variable", Q.normalize_sql("Scenario_Value"), RECORD_VALUE_LABELS)}
      ELSE Scenario END AS Scenario_Label FROM (""" + _SWITCH_SQL + ") s")


@register("scenario_labels", _SCEN_LABEL_SQL)
def q_scenario_labels(spark, d):
    sw = _switch_df(spark, d)
    lab = LB.scenario_label(F.col("Scenario"), F.col("Variable"), F.col("Scenario_Value"),
                            variable_labels=RECORD_VARIABLE_LABELS, value_labels=RECORD_VALUE_LABELS,
                            scenario_labels=RECORD_SCENARIO_LABELS, baseline_name=RECORD_SWITCH_SCENARIOS[0][0],
                            baseline_label="Baseline (urgent priority)")
    return sw.select("Scenario", "Variable", "Scenario_Value", lab.alias("Scenario_Label"))


def _curve_sql(var: str, values: list) -> str:
    sel = []
    for i, v in enumerate(values):
        p, lo, hi = Q.interval_sql(FIXED_LOGIT, {var: float(v)})
        sel += [f"avg({p}) AS p{i}", f"avg({lo}) AS lo{i}", f"avg({hi}) AS hi{i}"]
    rows = [f"SELECT {Q.lit(var)} AS Variable, {Q.lit(float(v))} AS Value, round(p{i}, 6) AS Predicted_Probability, "
            f"round(lo{i}, 6) AS CI_Lower_95, round(hi{i}, 6) AS CI_Upper_95 FROM one" for i, v in enumerate(values)]
    return REC.rstrip("\n") + f",\none AS (SELECT {', '.join(sel)} FROM prepared)\n" + " UNION ALL ".join(rows)


@register("what_if_curve", _curve_sql("p_size", VEHICLE_AGE_GRID))
def q_what_if_curve(spark, d):
    return r6(WI.what_if_curve(prepared_records(spark, d), FIXED_LOGIT, "p_size", VEHICLE_AGE_GRID))


@register("what_if_curve_quantity", _curve_sql("l_quantity", PERSON_AGE_GRID))
def q_what_if_curve_q(spark, d):
    return r6(WI.what_if_curve(prepared_records(spark, d), FIXED_LOGIT, "l_quantity", PERSON_AGE_GRID))


@register("error_bar_widths", "SELECT Value, round(Predicted_Probability, 6) AS Predicted_Probability, "
          "round(Predicted_Probability - CI_Lower_95, 6) AS Lower_Error, round(CI_Upper_95 - Predicted_Probability, 6) AS Upper_Error FROM ("
          + _curve_sql("p_size", VEHICLE_AGE_GRID).replace("round(p", "(p").replace("round(lo", "(lo").replace("round(hi", "(hi")
          .replace(", 6) AS Predicted_Probability", ") AS Predicted_Probability").replace(", 6) AS CI_Lower_95", ") AS CI_Lower_95")
          .replace(", 6) AS CI_Upper_95", ") AS CI_Upper_95") + ") c")
def q_error_bars(spark, d):
    c = WI.what_if_curve(prepared_records(spark, d), FIXED_LOGIT, "p_size", VEHICLE_AGE_GRID)
    return r6(RP.error_bar_widths(c, "Value"))


def _profiles_sql() -> str:
    sel = []
    for i, (_, ov) in enumerate(RECORD_RISK_PROFILES):
        p, lo, hi = Q.interval_sql(FIXED_LOGIT, {k: (float(v) if not isinstance(v, str) else v) for k, v in ov.items()})
        sel += [f"avg({p}) AS p{i}", f"avg({lo}) AS lo{i}", f"avg({hi}) AS hi{i}"]
    rows = [f"SELECT {Q.lit(name)} AS Profile, round(p{i}, 6) AS Predicted_Probability, round(lo{i}, 6) AS CI_Lower_95, "
            f"round(hi{i}, 6) AS CI_Upper_95 FROM one" for i, (name, _) in enumerate(RECORD_RISK_PROFILES)]
    return REC.rstrip("\n") + f",\none AS (SELECT {', '.join(sel)} FROM prepared)\n" + " UNION ALL ".join(rows)


@register("risk_profiles", _profiles_sql())
def q_risk_profiles(spark, d):
    profs = [(n, {k: (float(v) if not isinstance(v, str) else v) for k, v in ov.items()}) for n, ov in RECORD_RISK_PROFILES]
    return r6(WI.risk_profiles(prepared_records(spark, d), FIXED_LOGIT, profs))


def _contrast_sql() -> str:
    var, cases = RECORD_CONTRAST
    sel = []
    for i, (_, v) in enumerate(cases):
        p, lo, hi = Q.interval_sql(FIXED_LOGIT, {var: v})
        sel += [f"avg({p}) AS p{i}", f"avg({lo}) AS lo{i}", f"avg({hi}) AS hi{i}"]
    ref = cases[0][1]
    rows = [f"SELECT {Q.lit(name)} AS Scenario, {Q.lit(v)} AS {var}, round(p{i}, 6) AS Predicted_Probability, "
            f"round(lo{i}, 6) AS CI_Lower_95, round(hi{i}, 6) AS CI_Upper_95, round(p{i} - p0, 6) AS Absolute_Change_vs_{ref}, "
            f"round((p{i} - p0) / nullif(p0, 0) * 100.0, 6) AS Relative_Change_Percent_vs_{ref} FROM one"
            for i, (name, v) in enumerate(cases)]
    return REC.rstrip("\n") + f",\none AS (SELECT {', '.join(sel)} FROM prepared)\n" + " UNION ALL ".join(rows)


@register("group_contrast", _contrast_sql())
def q_group_contrast(spark, d):
    return r6(WI.group_contrast(prepared_records(spark, d), FIXED_LOGIT, RECORD_CONTRAST))


def _baseline_scored_sql() -> str:
    p, lo, hi = Q.interval_sql(FIXED_LOGIT)
    return (BASE_SQL.rstrip("\n") + ",\nbscore AS (SELECT *, " + f"{p} AS Predicted_Probability, {lo} AS CI_Lower_95, "
            f"{hi} AS CI_Upper_95 FROM baseline)\n")


def _baseline_scored_df(spark, d):
    return _baseline_df(spark, d).select("*", *interval_columns(FIXED_LOGIT))


@register("score_profiles", _baseline_scored_sql() + "SELECT " + ", ".join(_BASE_FEATS) +
          ", round(Predicted_Probability, 6) AS Predicted_Probability, round(CI_Lower_95, 6) AS CI_Lower_95, "
          "round(CI_Upper_95, 6) AS CI_Upper_95 FROM bscore")
def q_score_profiles(spark, d):
    return r6(_baseline_scored_df(spark, d))


def _bootstrap_scored_sql() -> str:
    pb = Q.sigmoid_sql(Q.eta_sql(FIXED_LOGIT))
    return (_baseline_scored_sql().rstrip("\n") + """,
idx AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key), row_key) - 1 AS i FROM prepared),
draws AS (SELECT range AS draw_id,
  ('0x' || substr(md5('42:draw:' || CAST(range AS VARCHAR)), 1, 15))::BIGINT % (SELECT count(*) FROM prepared) AS i
  FROM range(0, 5000)),
scored AS (SELECT d.draw_id, """ + pb.replace("l_", "x.l_").replace("p_size", "x.p_size").replace("p_type", "x.p_type")
            .replace("o_orderpriority", "x.o_orderpriority").replace("c_mktsegment", "x.c_mktsegment")
            .replace("c_acctbal", "x.c_acctbal") + " AS p FROM draws d JOIN idx x ON d.i = x.i)\n")


def _bootstrap(spark, d):
    """The baseline profile and the bootstrap of the records; the joins run once, and all passes read what is kept of them."""
    pop = stored(prepared_records(spark, d).select("row_key", *_BASE_FEATS))
    base = stored(PR.baseline_profile(pop, _BASE_FEATS, _BASE_CATS, RECORD_BASELINE_DEFAULTS))
    return base, WI.bootstrap_risk(spark, pop, FIXED_LOGIT, base, n_draws=5000, seed=42)


@register("bootstrap_risk", _bootstrap_scored_sql() + _SUMMARY_SQL +
          ", (SELECT round(Predicted_Probability, 6) FROM bscore) AS Baseline_Probability"
          ", (SELECT round(CI_Lower_95, 6) FROM bscore) AS Baseline_CI_Lower_95"
          ", (SELECT round(CI_Upper_95, 6) FROM bscore) AS Baseline_CI_Upper_95 FROM scored")
def q_bootstrap_risk(spark, d):
    return r6(_bootstrap(spark, d)[1]["summary"])


@register("bootstrap_risk_bands", _bootstrap_scored_sql() + _bands_sql("scored", "p"))
def q_bootstrap_bands(spark, d):
    return r6(_bootstrap(spark, d)[1]["bands"])


_DRAW_COLUMNS = [c for c in FIXED_LOGIT.spec.features]


@register("bootstrap_draws", _bootstrap_scored_sql() + f"""SELECT s.draw_id, {', '.join('x.' + c for c in _DRAW_COLUMNS)},
  round(s.p, 6) AS Predicted_Probability, CAST(NULL AS DOUBLE) AS CI_Lower_95, CAST(NULL AS DOUBLE) AS CI_Upper_95, 'Fixed' AS Fit_Type
FROM scored s JOIN draws d ON s.draw_id = d.draw_id JOIN idx x ON d.i = x.i""")
def q_bootstrap_draws(spark, d):
    """The draws themselves: features, probability and kind of fit."""
    return _bootstrap(spark, d)[1]["draws"].withColumn("Predicted_Probability", F.round("Predicted_Probability", 6))


@register("brief_details", None)
def q_brief_details(spark, d):
    base, out = _bootstrap(spark, d)
    scored = base.select("*", *interval_columns(FIXED_LOGIT))
    return WI.brief_details(scored, out["summary"], out["bands"], _BASE_FEATS)


# --------------------------------------------------------------------------- ordinal (fixed model)


def _ord_probs_sql() -> list[str]:
    eta = "(" + " + ".join(f"{Q.lit(float(b))} * {Q.term_sql(FIXED_ORDINAL.spec, t)}"
                           for t, b in zip(FIXED_ORDINAL.terms, FIXED_ORDINAL.beta)) + ")"
    cdf = [f"(1.0 / (1.0 + exp(-({Q.lit(float(c))} - {eta}))))" for c in FIXED_ORDINAL.cuts]
    return [f"({cdf[0]} - 0.0)", f"({cdf[1]} - {cdf[0]})", f"(1.0 - {cdf[1]})"]


_OP = _ord_probs_sql()


@register("ordered_predict", REC + f"""
SELECT row_key, round(p_1, 6) AS p_1, round(p_2, 6) AS p_2, round(p_3, 6) AS p_3,
       CASE WHEN p_1 >= p_2 AND p_1 >= p_3 THEN 1 WHEN p_2 >= p_3 THEN 2 ELSE 3 END AS predicted
FROM (SELECT row_key, {_OP[0]} AS p_1, {_OP[1]} AS p_2, {_OP[2]} AS p_3 FROM prepared) t""")
def q_ordered_predict(spark, d):
    out = ordered_predict(prepared_records(spark, d).select("row_key", *FIXED_LOGIT.spec.features), FIXED_ORDINAL)
    return r6(out.select("row_key", "p_1", "p_2", "p_3", "predicted"))


def _ovr_sql() -> str:
    parts = []
    for k in (1, 2, 3):
        parts.append(f"""SELECT {k} AS cls, score, sum(CAST(y_ord = {k} AS BIGINT)) AS pos, sum(CAST(y_ord <> {k} AS BIGINT)) AS neg
FROM (SELECT y_ord, {_OP[k - 1]} AS score FROM prepared) t GROUP BY score""")
    return REC + f""", s AS ({' UNION ALL '.join(parts)}),
c AS (SELECT cls, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s),
a AS (SELECT cls, sum(pos * (nb + 0.5 * neg)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc FROM c GROUP BY cls)
SELECT round(CASE WHEN count_if(auc IS NULL) = 0 THEN avg(auc) END, 6) AS ROC_AUC FROM a"""


@register("roc_auc_ovr_macro", _ovr_sql())
def q_roc_auc_ovr(spark, d):
    p = prepared_records(spark, d).select("y_ord", *class_probabilities(FIXED_ORDINAL))
    return r6(EV.roc_auc_ovr_macro(p, "y_ord", {1: "p_1", 2: "p_2", 3: "p_3"}))


@register("ordinal_metrics", REC + f"""
, pr AS (SELECT y_ord, CASE WHEN p_1 >= p_2 AND p_1 >= p_3 THEN 1 WHEN p_2 >= p_3 THEN 2 ELSE 3 END AS pred
         FROM (SELECT y_ord, {_OP[0]} AS p_1, {_OP[1]} AS p_2, {_OP[2]} AS p_3 FROM prepared) t),
cm AS (SELECT CAST(y_ord AS BIGINT) AS actual, CAST(pred AS BIGINT) AS predicted, count(*) AS n FROM pr GROUP BY 1, 2),
lab AS (SELECT label, sum(tp) AS tp, sum(support) AS support, sum(pred) AS pred, sum(abs_err) AS abs_err FROM (
        SELECT actual AS label, n AS support, 0 AS pred, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp,
               n * abs(actual - predicted) AS abs_err FROM cm
        UNION ALL SELECT predicted, 0, n, 0, 0 FROM cm) u GROUP BY label)
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS Accuracy,
       round(avg(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support END), 6) AS Balanced_Accuracy,
       round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(pred, 0), 0.0)), 6) AS Macro_Precision,
       round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0)), 6) AS Macro_Recall,
       round(avg(coalesce(2.0 * tp / nullif(pred + support, 0), 0.0)), 6) AS Macro_F1,
       round(CAST(sum(abs_err) AS DOUBLE) / sum(support), 6) AS MAE FROM lab""".replace("\n, pr AS", ",\npr AS", 1))
def q_ordinal_metrics(spark, d):
    pr = ordered_predict(prepared_records(spark, d).select("y_ord", *FIXED_LOGIT.spec.features), FIXED_ORDINAL)
    cm = EV.confusion_matrix(pr, "y_ord", "predicted")
    return r6(EV.classification_metrics(cm))


# --------------------------------------------------------------------------- data-derived term tables


def _level_logodds_df(spark, d) -> DataFrame:
    """Per level: log odds ratio of y vs the rest with Woolf's standard error."""
    p = prepared_records(spark, d)
    g = HY.grouped_rates_multi(p, ["p_type", "o_orderpriority", "c_mktsegment"], "y")
    g = g.withColumn("a", F.round(F.col("count") * F.col("event_rate")).cast("bigint"))
    tot = p.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ny"))
    n = tot.select("n").scalar()
    ny = tot.select("ny").scalar()
    b = F.col("count") - F.col("a")                 # level, y = 0
    c = ny - F.col("a")                              # rest, y = 1
    dd = n - ny - b                                  # rest, y = 0
    return g.select(F.concat(F.col("variable"), F.lit("_"), F.col("level")).alias("Term"),
                    F.col("variable").alias("Variable"), F.col("level").alias("Level"),
                    F.log(F.col("a") * dd / (b * c)).alias("Coefficient"),
                    F.sqrt(1.0 / F.col("a") + 1.0 / b + 1.0 / c + 1.0 / dd).alias("Std_Error"),
                    F.lit(None).cast("double").alias("p_value"))


_LOGODDS_SQL = REC + """, g AS (
  SELECT variable, level, count(*) AS cnt, sum(y) AS a FROM (
    SELECT 'p_type' AS variable, p_type AS level, y FROM prepared UNION ALL
    SELECT 'o_orderpriority', o_orderpriority, y FROM prepared UNION ALL
    SELECT 'c_mktsegment', c_mktsegment, y FROM prepared) u GROUP BY variable, level),
tot AS (SELECT count(*) AS n, sum(y) AS ny FROM prepared),
terms AS (SELECT variable || '_' || level AS Term, variable AS Variable, level AS Level,
       ln(CAST(a AS DOUBLE) * (n - ny - (cnt - a)) / ((cnt - a) * (ny - a))) AS Coefficient,
       sqrt(1.0 / a + 1.0 / (cnt - a) + 1.0 / (ny - a) + 1.0 / (n - ny - (cnt - a))) AS Std_Error,
       CAST(NULL AS DOUBLE) AS p_value FROM g, tot)
"""


@register("odds_ratios", _LOGODDS_SQL + f"""
SELECT Term, round(Coefficient, 6) AS Coefficient, round(exp(Coefficient), 6) AS Odds_Ratio,
       round(exp(Coefficient - {Q.lit(Z_COEF_INTERVAL)} * Std_Error), 6) AS CI_Lower_95,
       round(exp(Coefficient + {Q.lit(Z_COEF_INTERVAL)} * Std_Error), 6) AS CI_Upper_95, p_value FROM terms""")
def q_odds_ratios(spark, d):
    from riskloom.operators.fit import odds_ratios
    return r6(odds_ratios(_level_logodds_df(spark, d)))


@register("dim_lookup", _LOGODDS_SQL + f"""
SELECT Term, round(Coefficient, 6) AS Coefficient, {Q.value_label_sql('Variable', 'Level', RECORD_VALUE_LABELS)} AS Label
FROM terms""")
def q_dim_lookup(spark, d):
    t = _level_logodds_df(spark, d)
    labels = LB.label_table(spark, RECORD_VALUE_LABELS)
    same = (F.col("Variable") == F.col("label_variable")) & (LB.code_key(F.col("Level")) == F.col("label_code"))
    return r6(t.join(labels, same, "left").select("Term", "Coefficient", F.col("label").alias("Label")))


@register("top_bottom_k", _LOGODDS_SQL + """
SELECT * FROM (SELECT Term, round(exp(Coefficient), 6) AS Odds_Ratio, 'top' AS side FROM terms ORDER BY exp(Coefficient) DESC, Term LIMIT 5)
UNION ALL
SELECT * FROM (SELECT Term, round(exp(Coefficient), 6) AS Odds_Ratio, 'bottom' AS side FROM terms ORDER BY exp(Coefficient) ASC, Term LIMIT 5)""")
def q_top_bottom_k(spark, d):
    t = _level_logodds_df(spark, d).select("Term", F.exp("Coefficient").alias("Odds_Ratio"))
    top = RP.top_k(t, "Odds_Ratio", 5, True, "Term").withColumn("side", F.lit("top"))
    bot = RP.top_k(t, "Odds_Ratio", 5, False, "Term").withColumn("side", F.lit("bottom"))
    return r6(top.unionByName(bot))


@register("top_by_abs", _LOGODDS_SQL + """
SELECT Term, round(Coefficient, 6) AS Coefficient FROM terms WHERE Coefficient <> 0
ORDER BY abs(Coefficient) DESC, Term LIMIT 20""".replace("AS Coefficient FROM", "AS Coefficient, row_number() OVER (ORDER BY abs(Coefficient) DESC, Term) AS Position FROM"))
def q_top_by_abs(spark, d):
    return RP.with_position(r6(RP.top_by_abs(_level_logodds_df(spark, d).select("Term", "Coefficient"), "Coefficient", 20)))


@register("nonzero_count", _LOGODDS_SQL + """
SELECT count_if(Coefficient <> 0) AS n_nonzero, count(*) AS n_terms FROM terms""")
def q_nonzero_count(spark, d):
    return RP.nonzero_count(_level_logodds_df(spark, d))


@register("odds_ratios_ordinal", REC + """, sh AS (
  SELECT sum(CAST(y_ord <= 1 AS BIGINT)) / count(*) AS c1, sum(CAST(y_ord <= 2 AS BIGINT)) / count(*) AS c2 FROM prepared),
g AS (SELECT p_type AS level, count(*) AS cnt, avg(CAST(y_ord >= 2 AS DOUBLE)) AS r FROM prepared GROUP BY p_type),
terms AS (SELECT '1/2' AS Term, ln(c1 / (1 - c1)) AS Coefficient FROM sh UNION ALL
          SELECT '2/3', ln(c2 / (1 - c2)) FROM sh UNION ALL
          SELECT 'p_type_' || level, ln(r / (1 - r)) FROM g)
SELECT Term, round(exp(Coefficient), 6) AS Odds_Ratio FROM terms WHERE NOT contains(Term, '/')""")
def q_odds_ratios_ordinal(spark, d):
    p = prepared_records(spark, d)
    sh = p.agg((F.count_if(F.col("y_ord") <= 1) / F.count(F.lit(1))).alias("c1"),
               (F.count_if(F.col("y_ord") <= 2) / F.count(F.lit(1))).alias("c2"))
    cuts = sh.select(F.inline(F.array(
        F.struct(F.lit("1/2").alias("Term"), F.log(F.col("c1") / (1 - F.col("c1"))).alias("Coefficient")),
        F.struct(F.lit("2/3").alias("Term"), F.log(F.col("c2") / (1 - F.col("c2"))).alias("Coefficient")))))
    g = p.groupBy("p_type").agg(F.avg((F.col("y_ord") >= 2).cast("double")).alias("r"))
    feats = g.select(F.concat(F.lit("p_type_"), F.col("p_type")).alias("Term"),
                     F.log(F.col("r") / (1 - F.col("r"))).alias("Coefficient"))
    return r6(odds_ratios_ordinal(cuts.unionByName(feats)))


# --------------------------------------------------------------------------- fitted models

from riskloom.operators.fit import fit_report, logit_l1, logit_l2, logit_mle, term_table  # noqa: E402
from riskloom.operators.ordinal import ordered_fit_report, ordered_logit, ordinal_term_table  # noqa: E402
from riskloom.plans import suites as SU  # noqa: E402
from riskloom.presets import (RECORD_COMBINED_CATEGORICAL, RECORD_COMBINED_FEATURES,  # noqa: E402
                              RECORD_CONTEXT_CATEGORICAL, RECORD_CONTEXT_FEATURES, RECORD_ITEM_CATEGORICAL,
                              RECORD_ITEM_FEATURES, RECORD_ITEM_IMPUTE)

CONTEXT = SU.ModelSpec("Context", RECORD_CONTEXT_FEATURES, RECORD_CONTEXT_CATEGORICAL)
ITEM = SU.ModelSpec("Item", RECORD_ITEM_FEATURES, RECORD_ITEM_CATEGORICAL, RECORD_ITEM_IMPUTE)
COMBINED = SU.ModelSpec("Combined", RECORD_COMBINED_FEATURES, RECORD_COMBINED_CATEGORICAL, RECORD_ITEM_IMPUTE)
ORD_FEATURES_CTX = RECORD_CONTEXT_FEATURES + ["ship_year"]
ORD_CONTEXT = SU.ModelSpec("Context ordinal", ORD_FEATURES_CTX, RECORD_CONTEXT_CATEGORICAL)
ORD_ITEM = SU.ModelSpec("Item ordinal", ["p_type", "p_brand", "p_size", "c_acctbal"], RECORD_ITEM_CATEGORICAL)
ORD_COMBINED = SU.ModelSpec("Combined ordinal", ORD_FEATURES_CTX + ["p_type", "p_brand", "p_size", "c_acctbal"],
                            RECORD_COMBINED_CATEGORICAL)


def _combined_fit(spark, d, fit):
    """Prepare (cached), split and prune the combined design, then fit on the train rows."""
    p = prepared_records(spark, d)
    tbl, spec, cached = SU.prepare_split_design(p, COMBINED, "y", RECORDS, include_other=True)
    try:
        return spec, fit(tbl.filter("is_test = 0"), spec)
    finally:
        SU.release(cached)


# One factor with all its levels as terms and no intercept: every fit has a closed form, which the oracles state.
_ONE_FACTOR = REC + """, g AS (SELECT p_type AS lv, count(*) AS n, CAST(sum(y) AS DOUBLE) AS k FROM prepared WHERE p_type IS NOT NULL GROUP BY 1),
q AS (SELECT *, k / n AS r FROM g)
"""
_L1_ALPHA, _L2_C = 40.0, 0.01


def _one_factor(spark, d, fit):
    p = prepared_records(spark, d)
    return term_table(spark, fit(p, fit_design(p, ["p_type"], ["p_type"], drop_first=False))).drop("p_value")


_RANK_COLUMNS = ["l_quantity", "copy", "p_size", "total", "near", "c_acctbal"]


def _rank_sql() -> str:
    """The same greedy test, as Gram-Schmidt over the rows: what is left of a column beside the kept ones."""
    steps, kept = [f"v0 AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _RANK_COLUMNS)} FROM wide)"], []
    for i, c in enumerate(_RANK_COLUMNS):
        later = ", ".join(f"{x} - {c} * (sum({x} * {c}) OVER () / nullif(sum({c} * {c}) OVER (), 0)) AS {x}" for x in _RANK_COLUMNS[i + 1:])
        if c in ("copy", "total"):
            later = ", ".join(_RANK_COLUMNS[i + 1:])
        steps.append(f"v{i + 1} AS (SELECT {later or '1 AS done'} FROM v{i})")
        kept.append(f"SELECT {i} AS i, '{c}' AS Term, (SELECT sqrt(sum({c} * {c})) FROM v{i}) / (SELECT sqrt(sum(CAST({c} AS DOUBLE) * {c})) FROM wide) > 1e-10 AS keep")
    return REC + ", wide AS (SELECT l_quantity, l_quantity AS copy, p_size, l_quantity + p_size AS total, l_quantity + 5e-5 * l_discount AS near, c_acctbal FROM records),\n" \
        + ",\n".join(steps) + ",\nt AS (" + " UNION ALL ".join(kept) + """)
SELECT CAST(CASE WHEN keep THEN row_number() OVER (PARTITION BY keep ORDER BY i) - 1 ELSE -1 END AS INTEGER) AS Position, Term,
       CASE WHEN keep THEN 'kept' ELSE 'dependent' END AS Status FROM t"""


@register("full_rank_columns", _rank_sql())
def q_full_rank_columns(spark, d):
    """A copied, a summed and an almost copied column (they differ by about 1e-7 of their length) among independent ones, over all records."""
    from riskloom.operators.linalg import column_summary, independent_columns
    r = records(spark, d).withColumn("copy", F.col("l_quantity")).withColumn("total", F.col("l_quantity") + F.col("p_size")) \
        .withColumn("near", F.col("l_quantity") + 5e-5 * F.col("l_discount"))
    kept = independent_columns(column_summary(r, _RANK_COLUMNS)[0][0])
    rows = [(kept.index(i), c, "kept") if i in kept else (-1, c, "dependent") for i, c in enumerate(_RANK_COLUMNS)]
    return spark.createDataFrame(rows, "Position int, Term string, Status string")


@register("full_rank_columns_combined")
def q_full_rank_columns_combined(spark, d):
    """Every candidate term of the combined design, and whether it stays or why it goes."""
    spec, _ = _combined_fit(spark, d, lambda t, s: None)
    rows = [(i, t, "kept") for i, t in enumerate(spec.terms)] + [(-1, t, why) for t, why in spec.dropped.items()]
    return spark.createDataFrame(rows, "Position int, Term string, Status string")


@register("logit_mle", _ONE_FACTOR + """SELECT 'p_type_' || lv AS Term, 'p_type' AS Variable, lv AS Level,
  round(ln(r / (1 - r)), 6) AS Coefficient, round(sqrt(1 / (n * r * (1 - r))), 6) AS Std_Error FROM q""")
def q_logit_mle(spark, d):
    return r6(_one_factor(spark, d, lambda t, s: logit_mle(t, s, "y")))


@register("fit_report", _ONE_FACTOR + """SELECT 'One factor' AS Model, 'MLE' AS Fit_Type, true AS Converged,
  CAST(count(*) AS INTEGER) AS N_Terms, CAST(count_if(k <> n / 2.0) AS INTEGER) AS N_Nonzero FROM q""")
def q_fit_report(spark, d):
    p = prepared_records(spark, d)
    model = logit_mle(p, fit_design(p, ["p_type"], ["p_type"], drop_first=False), "y")
    return fit_report(spark, model, "One factor").drop("Iterations")


@register("logit_l1", _ONE_FACTOR + f"""SELECT 'p_type_' || lv AS Term, 'p_type' AS Variable, lv AS Level,
  round(CASE WHEN abs(k - n / 2.0) <= {_L1_ALPHA} THEN 0.0 ELSE ln(m / (n - m)) END, 4) AS Coefficient, CAST(NULL AS DOUBLE) AS Std_Error
FROM (SELECT *, k - {_L1_ALPHA} * sign(k - n / 2.0) AS m FROM q) s""")
def q_logit_l1(spark, d):
    return r6(_one_factor(spark, d, lambda t, s: logit_l1(t, s, "y", alpha=_L1_ALPHA)), 4)


def _l2_sql() -> str:
    steps = ["b0 AS (SELECT lv, n, k, CAST(0 AS DOUBLE) AS b FROM q)"]
    for i in range(1, 12):
        p = "(1 / (1 + exp(-b)))"
        steps.append(f"b{i} AS (SELECT lv, n, k, b - (n * {p} - k + b / {_L2_C}) / (n * {p} * (1 - {p}) + 1 / {_L2_C}) AS b FROM b{i - 1})")
    return (_ONE_FACTOR.rstrip() + ",\n" + ",\n".join(steps) + """
SELECT 'p_type_' || lv AS Term, 'p_type' AS Variable, lv AS Level, round(b, 4) AS Coefficient, CAST(NULL AS DOUBLE) AS Std_Error FROM b11""")


@register("logit_l2", _l2_sql())
def q_logit_l2(spark, d):
    return r6(_one_factor(spark, d, lambda t, s: logit_l2(t, s, "y", C=_L2_C)), 4)


@register("ordered_logit", REC + """, g AS (SELECT p_type AS lv, count(*) AS n, avg(CAST(y_ord = 1 AS DOUBLE)) AS r
  FROM prepared WHERE y_ord IN (1, 2) GROUP BY 1),
z AS (SELECT lv, ln(r / (1 - r)) AS z, 1 / (n * r * (1 - r)) AS v, row_number() OVER (ORDER BY lv) AS i FROM g),
ref AS (SELECT * FROM z WHERE i = 1)
SELECT '1/2' AS Term, 'cut' AS Kind, round(z, 5) AS Coefficient, round(sqrt(v), 5) AS Std_Error FROM ref
UNION ALL SELECT 'p_type_' || z.lv, 'feature', round(ref.z - z.z, 5), round(sqrt(z.v + ref.v), 5) FROM z, ref WHERE z.i > 1""")
def q_ordered_logit(spark, d):
    p = prepared_records(spark, d).where(F.col("y_ord").isin(1, 2))
    model = ordered_logit(p, fit_design(p, ["p_type"], ["p_type"]), "y_ord", [1, 2])
    return r6(ordinal_term_table(spark, model), 5)


@register("ordered_fit_report", REC + """SELECT 'One factor' AS Model, true AS Converged, CAST(2 AS INTEGER) AS N_Classes,
  CAST(count(DISTINCT p_type) - 1 AS INTEGER) AS N_Terms FROM prepared WHERE y_ord IN (1, 2)""")
def q_ordered_fit_report(spark, d):
    p = prepared_records(spark, d).where(F.col("y_ord").isin(1, 2))
    model = ordered_logit(p, fit_design(p, ["p_type"], ["p_type"]), "y_ord", [1, 2])
    return ordered_fit_report(spark, model, "One factor").drop("Iterations", "Log_Likelihood")


@register("logit_mle_combined")
def q_logit_mle_combined(spark, d):
    _, model = _combined_fit(spark, d, lambda t, s: logit_mle(t, s, "y"))
    return term_table(spark, model)


@register("fit_report_combined")
def q_fit_report_combined(spark, d):
    _, model = _combined_fit(spark, d, lambda t, s: logit_mle(t, s, "y"))
    return fit_report(spark, model, "Combined")


@register("logit_l1_combined")
def q_logit_l1_combined(spark, d):
    _, model = _combined_fit(spark, d, lambda t, s: logit_l1(t, s, "y", alpha=0.1))
    return term_table(spark, model)


@register("logit_l2_combined")
def q_logit_l2_combined(spark, d):
    _, model = _combined_fit(spark, d, lambda t, s: logit_l2(t, s, "y"))
    return term_table(spark, model)


@register("ordered_logit_three_classes")
def q_ordered_logit_three_classes(spark, d):
    """One factor, all three classes (no closed form)."""
    p = prepared_records(spark, d)
    return ordinal_term_table(spark, ordered_logit(p, fit_design(p, ["p_type"], ["p_type"]), "y_ord", [1, 2, 3]))


@register("ordered_logit_combined")
def q_ordered_logit_combined(spark, d):
    return ordinal_term_table(spark, SU.fit_ordinal(spark, prepared_records(spark, d), ORD_COMBINED, "y_ord", RECORDS, include_other=True, evaluate=False).model)


@register("ordered_pipeline")
def q_ordered_pipeline(spark, d):
    p = prepared_records(spark, d)
    return SU.fit_ordinal(spark, p, ORD_CONTEXT, "y_ord", RECORDS, include_other=True).metrics


@register("binary_suite")
def q_binary_suite(spark, d):
    table, _ = SU.binary_suite(spark, prepared_records(spark, d), [CONTEXT, ITEM, COMBINED], "y", RECORDS)
    return table


@register("ordinal_suite")
def q_ordinal_suite(spark, d):
    table, _ = SU.ordinal_suite(spark, prepared_records(spark, d), [ORD_CONTEXT, ORD_ITEM, ORD_COMBINED],
                                "y_ord", RECORDS)
    return table


@register("model_comparison")
def q_model_comparison(spark, d):
    return SU.model_comparison(spark, prepared_records(spark, d), [CONTEXT, ITEM, COMBINED], "y",
                               [ORD_CONTEXT, ORD_ITEM, ORD_COMBINED], "y_ord", RECORDS)


@register("exploratory_fatal")
def q_exploratory(spark, d):
    p = prepared_records(spark, d).withColumn("y_filled", (F.col("o_orderstatus") == "F").cast("int"))
    out = SU.exploratory(spark, p, CONTEXT, "y_filled", alpha=0.1, min_share=0.05)
    return out["metrics"]


def _what_if(spark, d):
    m = SU.ModelSpec("Combined", [c for c in RECORD_COMBINED_FEATURES if c != "ship_lag"] + ["ship_lag"],
                     RECORD_COMBINED_CATEGORICAL)
    return SU.what_if_report(spark, prepared_records(spark, d), m, "y", RECORDS,
                             baseline_defaults=RECORD_BASELINE_DEFAULTS, switch_scenarios=RECORD_SWITCH_SCENARIOS,
                             risk_profile_list=[(n, {k: (float(v) if not isinstance(v, str) else v)
                                                     for k, v in ov.items()}) for n, ov in RECORD_RISK_PROFILES],
                             contrast=RECORD_CONTRAST, curves=[("p_size", VEHICLE_AGE_GRID),
                                                               ("l_quantity", PERSON_AGE_GRID)])


@register("what_if_report")
def q_what_if_report(spark, d):
    return _what_if(spark, d)["category_switch"]


@register("what_if_tables")
def q_what_if_tables(spark, d):
    """All tables of the what-if report from one fit, in long form: table, row, column, value as text."""
    long = None
    for name, table in _what_if(spark, d).items():
        if name == "model":
            continue
        rows = RP.with_position(table)
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in table.columns])
        part = rows.select(F.lit(name).alias("table"), F.col("Position").alias("row"), F.inline(cells))
        long = part if long is None else long.unionByName(part)
    return long


# --------------------------------------------------------------------------- sinks, reuse, alignment


@register("write_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def q_write_table(spark, d):
    """Result table written as Parquet to the shared scratch folder and read back typed."""
    path = write_table(read_table(spark, d, "orders"), scratch_dir(spark, "write") + "/orders")
    return spark.read.schema(SCHEMAS["orders"]).parquet(path)


@register("write_table_csv", ORACLE["union_results"])
def q_write_table_csv(spark, d):
    """A result table written as CSV with a header and read back typed."""
    result = r6(_eval_rows(spark, d))
    path = write_table(result, scratch_dir(spark, "write") + "/metrics", fmt="csv")
    return spark.read.schema(result.schema).option("header", True).csv(path)


@register("load_or_compute", REC + f""", src AS (SELECT * FROM records)
SELECT variable, level, count(*) AS count FROM ({_UNPIVOT_CATS}) u GROUP BY variable, level""")
def q_load_or_compute(spark, d):
    """First call computes and stores two tables as one set; the second finds the set of this input and reads it."""
    from riskloom.sources.tables import input_fingerprint, load_or_compute
    base = scratch_dir(spark, "reuse")
    made = input_fingerprint(spark, *[f"{d}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part")])

    def compute():
        counts = HY.level_counts(records(spark, d), CATS)
        return {"level_counts": counts, "variables": counts.select("variable").distinct()}

    load_or_compute(spark, base, ["level_counts", "variables"], compute, made)
    return load_or_compute(spark, base, ["level_counts", "variables"], compute, made)["level_counts"]


_CROSS_COLS = sorted({v for _, v, _ in RECORD_SWITCH_SCENARIOS})


def _scenario_cross_sql() -> str:
    parts = []
    for name, var, value in RECORD_SWITCH_SCENARIOS:
        cols = ", ".join(f"{Q.lit(value)} AS {c}" if c == var and value is not None else c for c in _CROSS_COLS)
        parts.append(f"SELECT {Q.lit(name)} AS Scenario, {cols}, n FROM g")
    return REC + f", g AS (SELECT {', '.join(_CROSS_COLS)}, count(*) AS n FROM records GROUP BY ALL)\n" \
        + f"SELECT Scenario, {', '.join(_CROSS_COLS)}, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(parts) + ") s GROUP BY ALL"


@register("scenario_cross", _scenario_cross_sql())
def q_scenario_cross(spark, d):
    """Every profile that occurs under every scenario, with the number of rows behind it (expanded in the row, no cross join)."""
    profiles = records(spark, d).groupBy(*_CROSS_COLS).agg(F.count(F.lit(1)).alias("n"))
    return WI.scenario_cross(profiles, RECORD_SWITCH_SCENARIOS).groupBy("Scenario", *_CROSS_COLS).agg(F.sum("n").alias("n"))


ORACLE_ALIGN = REC + """
SELECT row_key, l_returnflag, CAST(p_size AS DOUBLE) AS p_size, 0.0 AS l_returnflag_R
FROM records WHERE l_returnflag = 'N'"""


@register("align_terms", ORACLE_ALIGN)
def q_align_terms(spark, d):
    """Train terms come from rows with flag A (reference) and R; rows with the unseen level N
    align to the train term list with zeros (the reference level)."""
    r = records(spark, d)
    spec = fit_design(r.filter(F.col("l_returnflag") != "N"), ["l_returnflag", "p_size"], ["l_returnflag"])
    return spec.encode(r.filter(F.col("l_returnflag") == "N"), keep=["row_key", "l_returnflag"])


def _dummy_encode_oracle() -> str:
    """Levels of the encoded columns are fixed domains in these tables (sorted, first dropped)."""
    domains = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
               "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
               "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
    cols = ["row_key", "CAST(l_quantity AS DOUBLE) AS l_quantity", "CAST(p_size AS DOUBLE) AS p_size"]
    for c in _ENC_CATS:
        for lv in domains[c][1:]:
            cols.append(f"CASE WHEN {c} = {Q.lit(lv)} THEN 1.0 ELSE 0.0 END AS \"{c}_{lv}\"")
    return REC + "SELECT " + ", ".join(cols) + " FROM records"


ORACLE["dummy_encode"] = _dummy_encode_oracle()


def _brief_sql() -> str:
    prof = " || ', ' || ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in _BASE_FEATS)
    hi = RISK_BANDS[-1][1]
    return (_bootstrap_scored_sql().rstrip("\n") + f""",
summ AS (SELECT median(p) AS med, quantile_cont(p, 0.05) AS p05, quantile_cont(p, 0.95) AS p95,
                CAST(count_if(p >= {Q.lit(hi)}) AS DOUBLE) / count(*) AS high FROM scored)
SELECT 1 AS Line, 'Baseline profile: ' || {prof} AS Text FROM baseline
UNION ALL SELECT 2, printf('Baseline predicted probability: %.4f (95%% CI %.4f to %.4f)',
       Predicted_Probability, CI_Lower_95, CI_Upper_95) FROM bscore
UNION ALL SELECT 3, printf('Monte Carlo central range: 5th percentile %.4f, median %.4f, 95th percentile %.4f',
       p05, med, p95) FROM summ
UNION ALL SELECT 4, printf('High-risk draws (>= 0.75): %.1f%%', high * 100.0) FROM summ""")


ORACLE["brief_details"] = _brief_sql()

"""Code -> label decoding and display labels.

Label tables of any size are joined (``decode_labels``, ``term_labels``). Display
columns of small reports take the fixed presets as literal maps.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import stored
from riskloom.functions.scalar import NUMERIC_PATTERN, format_number_text, normalize_code

_SEP = "\u0001"


def _label_map(value_labels: dict[str, dict[str, str]]) -> Column:
    pairs = [(F.lit(f"{var}{_SEP}{code}"), F.lit(label))
             for var, codes in value_labels.items() for code, label in codes.items()]
    return F.create_map(*chain.from_iterable(pairs)) if pairs else F.create_map()


def lookup_value_label(variable: Column, value: Column, value_labels: dict[str, dict[str, str]]) -> Column:
    """Label for (variable, code): tries the raw code, upper case, the normalised
    code, its upper case and, for digits, the 2-digit zero-padded form."""
    m = _label_map(value_labels)
    raw = F.trim(value.cast("string"))
    norm = normalize_code(raw)
    cands = [raw, F.upper(raw), norm, F.upper(norm),
             F.when(norm.rlike(r"^\d+$"), F.lpad(norm, 2, "0"))]
    found = F.coalesce(*[F.try_element_at(m, F.concat(variable, F.lit(_SEP), c)) for c in cands])
    # a variable without labels is told first: its values would go through all forms to find nothing
    return F.when(variable.isin(list(value_labels)) & value.isNotNull() & (raw != F.lit("")), found)


def code_key(value: Column) -> Column:
    """What codes are compared by: trimmed, without leading zeros or a zero fraction, in upper case; blank is none."""
    raw = F.trim(value.cast("string"))
    return F.when(raw != F.lit(""), F.upper(normalize_code(raw)))


def label_table(spark: SparkSession, value_labels: dict[str, dict[str, str]]) -> DataFrame:
    """(label_variable, label_code, label) of the presets, codes normalised once, for joins."""
    rows = [(var, code, label) for var, codes in value_labels.items() for code, label in codes.items()]
    table = spark.createDataFrame(rows, "label_variable string, label_code string, label string")
    return keyed_labels(table)


def keyed_labels(labels: DataFrame) -> DataFrame:
    """A label table of any size (label_variable, label_code, label) with its codes as keys, one row a key (ties: the least label)."""
    keyed = labels.withColumn("label_code", code_key(F.col("label_code"))).where("label_code is not null") \
        .groupBy("label_variable", "label_code").agg(F.min("label").alias("label"))
    return stored(keyed)  # its true size decides on a broadcast: codes are few, and a shuffle by them is one of few large parts


def decode_labels(df: DataFrame, wanted: dict[str, tuple[str, Column]], labels: DataFrame) -> DataFrame:
    """``df`` with a label column for each (variable, code) of ``wanted``; labels: ``keyed_labels``.

    One equi-join a column, on the code's key; whether the labels are broadcast
    is left to the planner. A code without a label, and a missing one, gets NULL.
    """
    out = df
    for name, (variable, code) in wanted.items():
        side = labels.where(F.col("label_variable") == variable).select(F.col("label_code").alias("_code"), F.col("label").alias(name))
        out = out.withColumn("_key", code_key(code)).join(side, F.col("_key") == F.col("_code"), "left").drop("_key", "_code")
    return out


def term_labels(terms: DataFrame, variables: DataFrame, labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(term, label) of distinct terms ``VARIABLE_LEVEL``, by joins with tables of any size.

    A term is cut at each of its underscores; the cuts meet the table of variables
    (variable, variable_label), and the longest variable wins. Its level meets the
    value labels (``keyed_labels``); a level without a label is shown in brackets.
    ``overrides`` (term, override) come first; what meets nothing is the term with spaces.
    """
    term = F.col("term")
    places = F.filter(F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.when(F.substring(term, i, F.lit(1)) == "_", i)), lambda i: i.isNotNull())
    cuts = terms.select("term", F.explode(F.when(F.length(term) > 0, places)).alias("at")) \
        .select("term", "at", F.substring(term, F.lit(1), F.col("at") - 1).alias("variable"), F.substring(term, F.col("at") + 1, F.length(term)).alias("level"))
    longest = cuts.join(variables, "variable").groupBy("term").agg(F.max(F.struct("at", "variable", "level", "variable_label")).alias("m")).select("term", "m.variable", "m.level", "m.variable_label")
    named = decode_level(longest, labels).select(F.col("term").alias("_t"), F.coalesce("value_label", F.concat("variable_label", F.lit(" ("), "level", F.lit(")"))).alias("found"))
    return terms.join(named, term == F.col("_t"), "left").join(overrides, "term", "left") \
        .select("term", F.coalesce("override", "found", F.regexp_replace("term", "_", " ")).alias("label"))


def decode_level(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """(.., variable, level) with value_label, by variable and key."""
    side = labels.select(F.col("label_variable").alias("_v"), F.col("label_code").alias("_c"), F.col("label").alias("value_label"))
    return levels.join(side, (F.col("variable") == F.col("_v")) & (code_key(F.col("level")) == F.col("_c")), "left").drop("_v", "_c")


def variable_label(variable: Column, variable_labels: dict[str, str]) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in variable_labels.items()))
    return F.coalesce(F.try_element_at(m, variable), F.regexp_replace(variable, "_", " "))


def format_value(variable: Column, text: Column, number: Column,
                 value_labels: dict[str, dict[str, str]]) -> Column:
    """Display value: Missing / label / trimmed text / whole number / one decimal.

    ``text`` holds text values, ``number`` numeric ones (the other is NULL).
    """
    lab_text = lookup_value_label(variable, text, value_labels)
    lab_num = lookup_value_label(variable, number.cast("string"), value_labels)
    return (F.when(text.isNull() & number.isNull(), F.lit("Missing"))
            .when(text.isNotNull(), F.coalesce(lab_text, F.trim(text)))
            .otherwise(F.coalesce(lab_num, format_number_text(number))))


def scenario_label(scenario: Column, variable: Column, scenario_value: Column, *,
                   variable_labels: dict[str, str], value_labels: dict[str, dict[str, str]],
                   scenario_labels: dict[tuple[str, str], str], baseline_name: str,
                   baseline_label: str) -> Column:
    """Scenario display label: fixed baseline label; else (variable, code) override;
    else the value label; else the scenario name."""
    norm = normalize_code(scenario_value)
    sm = F.create_map(*chain.from_iterable((F.lit(f"{v}{_SEP}{c}"), F.lit(lab))
                                           for (v, c), lab in scenario_labels.items()))
    over = F.try_element_at(sm, F.concat(variable, F.lit(_SEP), norm))
    val = lookup_value_label(variable, norm, value_labels)
    prefix = variable_label(variable, variable_labels)
    return (F.when(scenario == F.lit(baseline_name), F.lit(baseline_label))
            .when(over.isNotNull(), F.concat(prefix, F.lit(": "), over))
            .when(val.isNotNull(), F.concat(prefix, F.lit(": "), val))
            .otherwise(scenario))


__all__ = ["lookup_value_label", "variable_label", "decode_labels", "term_labels", "format_value", "scenario_label",
           "NUMERIC_PATTERN"]

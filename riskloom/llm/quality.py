"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one statistic of a document and votes good (+1), bad (-1)
or abstains (0). Expectation-maximisation over the counts of vote patterns (at
most 3^rules rows, however large the corpus) estimates, for each rule, how often
it is right about good and about bad documents, and how common good documents
are; a document's posterior probability of being good replaces the demand that
every rule pass. DataFrame functions only; texts are read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.linking import saved

#: Java pattern of the separators of words.
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: rule: (statistic, good from, good to, bad below, bad above); in between it abstains.
RULES = {
    "words": ("n_words", 50, None, 20, None),
    "word_length": ("word_chars / n_words", 3.0, 10.0, 2.0, 14.0),
    "symbols": ("n_symbols / n_words", None, 0.05, None, 0.2),
    "symbol_share": ("n_symbols / word_chars", None, 0.01, None, 0.04),
    "duplicate_lines": ("n_dup_lines / n_lines", None, 0.1, None, 0.3),
    "repeated_words": ("n_repeat_words / n_words", None, 0.1, None, 0.2),
    "capitals": ("n_capitals / word_chars", None, 0.2, None, 0.5),
    "letters": ("n_letters / word_chars", 0.9, None, 0.75, None),
}
#: Accuracies (on good, on bad documents) and the share of good ones to start from; accuracies stay in the ranges.
START, START_PRIOR = (0.9, 0.5), 0.8
RANGES = ((0.55, 0.999), (0.1, 0.95))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the document statistics; null text: none of everything.

    n_repeat_words counts the words in windows of five words that start twice or
    more in the text. Windows are compared by 64-bit hashes of word hashes,
    sorted together with their places, so a text costs n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", F.array_remove(F.split(text, GAP, -1), "")).withColumn("_lines", lines) \
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")) \
        .withColumn("n_capitals", F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long")) \
        .withColumn("n_letters", F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long")) \
        .withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")) \
        .withColumn("_spelled", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines")
    grams = F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get("_spelled", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_grams", F.when(F.col("n_words") >= WINDOW, grams)).drop("_spelled")
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_grams")

    def again(s: Column, k: Column) -> Column:
        same = (s["h"] == F.get("_sorted", k + 1)["h"]) | ((k > 0) & (s["h"] == F.get("_sorted", k - 1)["h"]))
        return F.when(same, s["i"])

    df = df.withColumn("_places", F.sort_array(F.array_compact(F.transform("_sorted", again)))).drop("_sorted")
    new = F.transform("_places", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - i, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_places")


def votes(rules: dict = RULES) -> list[Column]:
    """A column vote_<rule> of +1, -1 or 0 each; undefined statistics abstain."""
    out = []
    for name, (stat, good_from, good_to, bad_below, bad_above) in rules.items():
        parts = stat.split(" / ")
        x = F.expr(parts[0]).cast("double") if len(parts) == 1 else F.expr(f"try_divide({parts[0]}, {parts[1]})")
        bad, good = F.lit(False), F.lit(True)
        bad = bad | (x < bad_below) if bad_below is not None else bad
        bad = bad | (x > bad_above) if bad_above is not None else bad
        good = good & (x >= good_from) if good_from is not None else good
        good = good & (x <= good_to) if good_to is not None else good
        out.append(F.when(bad, F.lit(-1)).when(good & x.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias(f"vote_{name}"))
    return out


def posterior(accuracy: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability that a document is good, given its votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in accuracy.items():
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote > 0, math.log(good / (1 - bad))).when(vote < 0, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(spark: SparkSession, voted: DataFrame, rounds: int = 50, tolerance: float = 1e-4, rules: dict = RULES) -> tuple[dict[str, tuple[float, float]], float]:
    """(each rule's accuracy on good and on bad documents, share of good documents) by expectation-maximisation.

    Each round is one aggregation over the pattern counts. Accuracies stay in
    their ranges, so that a vote is never taken for its opposite; no rows: the
    starting values.
    """
    accuracy, prior = {n: START for n in rules}, START_PRIOR
    columns = [f"vote_{n}" for n in rules]
    patterns = saved(spark, voted.groupBy(*columns).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    for _ in range(rounds):
        p, n = posterior(accuracy, prior), F.col("n")
        sums = [F.sum(F.when(F.col(c) == sign, n * (p if good else 1 - p)).otherwise(0.0)).alias(f"{c}{sign}{good}") for c in columns for sign in (1, -1) for good in (True, False)]
        r = patterns.agg(F.sum(n).alias("n"), F.sum(n * p).alias("good"), *sums).first()
        if not r["n"]:
            break
        new = {}
        for x in rules:
            counts = [[r[f"vote_{x}{sign}{good}"] for sign in ((1, -1) if good else (-1, 1))] for good in (True, False)]
            new[x] = tuple(min(max(hit / (hit + miss), low), high) if hit + miss else old for (hit, miss), old, (low, high) in zip(counts, accuracy[x], RANGES))
        share = min(max(r["good"] / r["n"], 0.05), 0.95)
        moved = max(abs(share - prior), *(abs(v - w) for x in rules for v, w in zip(new[x], accuracy[x])))
        accuracy, prior = new, share
        if moved < tolerance:
            break
    return accuracy, prior


def judge(spark: SparkSession, docs: DataFrame, rules: dict = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the statistics, the votes, posterior, base_failed, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated
    windows; kept: not base_failed and posterior at least a half. Null, empty
    and wordless texts fail; null ids stay null; repeated rows are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    counted = statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    voted = saved(spark, counted.select("*", *votes(rules)), "votes")
    accuracy, prior = estimate(spark, voted, rules=rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("posterior", posterior(accuracy, prior)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

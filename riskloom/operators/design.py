"""Dummy encoding with a fitted, plain-data ``DesignSpec`` and distributed pruning.

Terms are column expressions: numerics first (feature order), then one 0/1
term per non-reference level (levels sorted, the first dropped).  A missing or
unseen level encodes to all zeros, i.e. joins the reference level.  The matrix
is never materialised wide, neither on the driver nor between Spark and the
tasks' numpy: rows go there packed, and pruning is one pass over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.sqltext import ident, literal
from riskloom.operators.hygiene import level_counts
from riskloom.operators.linalg import Packing, Summary, equal_columns, independent_columns, summaries
from riskloom.session import stored


@dataclass
class DesignSpec:
    features: list[str]
    numeric: list[str]
    levels: dict[str, list[str]]                       # categorical -> sorted observed levels
    terms: list[str] = field(default_factory=list)      # kept terms, in order
    source: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)   # term -> reason

    def term_sql(self, term: str, overrides: dict | None = None) -> str:
        """Spark SQL text of one term (numeric value or 0/1 level indicator)."""
        col, level = self.source[term]
        x = literal(overrides[col]) if overrides and col in overrides else ident(col)
        if level is None:
            return f"CAST({x} AS DOUBLE)"
        return f"(CASE WHEN CAST({x} AS STRING) = {literal(level)} THEN 1.0D ELSE 0.0D END)"

    def term_expr(self, term: str, overrides: dict | None = None) -> Column:
        return F.expr(self.term_sql(term, overrides))

    def encode(self, df: DataFrame, keep: list[str] | None = None, terms: list[str] | None = None) -> DataFrame:
        """Project ``keep`` columns plus one double column per term."""
        ts = self.terms if terms is None else terms
        return df.select(*[F.col(c) for c in (keep or [])], *[self.term_expr(t).alias(t) for t in ts])

    def packed(self, intercept: bool = False) -> tuple[Column, Packing]:
        """The terms of a row as a short array (numeric values, and the number of its level a categorical column), and how to unpack it."""
        numeric = [i for i, t in enumerate(self.terms) if self.source[t][1] is None]
        lists: list[tuple[str, dict[str, int]]] = []
        for i, t in enumerate(self.terms):
            col, level = self.source[t]
            if level is None:
                continue
            own = next((places for c, places in lists if c == col and level not in places), None)
            if own is None:
                own = {}
                lists.append((col, own))
            own[level] = i
        codes = [f"CASE CAST({ident(c)} AS STRING) " + " ".join(f"WHEN {literal(lv)} THEN {n}.0D" for n, lv in enumerate(places, 1)) + " ELSE 0.0D END" for c, places in lists]
        x = F.array(*[self.term_expr(self.terms[i]) for i in numeric], *[F.expr(c) for c in codes]).cast("array<double>")
        width = len(self.terms)
        return x, Packing(width + intercept, tuple(numeric), tuple(tuple(places.values()) for _, places in lists), (width,) if intercept else ())

    def with_terms(self, terms: list[str], reason: str | None = None) -> "DesignSpec":
        dropped = dict(self.dropped)
        if reason:
            for t in self.terms:
                if t not in terms:
                    dropped.setdefault(t, reason)
        return DesignSpec(self.features, self.numeric, self.levels, list(terms), self.source, dropped)

    def variable_of(self, term: str) -> str:
        return self.source[term][0]


def fit_design(df: DataFrame, features: list[str], categorical: list[str],
               drop_first: bool = True, max_levels: int = 10_000) -> DesignSpec:
    """Observe the level lists (one counting pass) and lay out the candidate terms.

    Every level is a term, and a fit needs terms x terms numbers on the driver,
    so a column with more than ``max_levels`` levels is refused: group its rare
    levels first, or raise the limit.
    """
    cats = [c for c in features if c in categorical]
    numeric = [c for c in features if c not in categorical]
    levels: dict[str, list[str]] = {c: [] for c in cats}
    if cats:
        # counted once, for the sizes and for the lists
        counts = stored(level_counts(df, cats).filter(F.col("level").isNotNull()))
        sizes = {r["variable"]: r["n"] for r in counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
        if any(n > max_levels for n in sizes.values()):
            raise ValueError(f"too many levels to dummy-encode: {sizes}")
        for r in counts.select("variable", "level").collect():
            levels[r["variable"]].append(r["level"])
        for c in cats:
            levels[c] = sorted(levels[c])
    terms: list[str] = []
    source: dict[str, tuple[str, str | None]] = {}
    for c in numeric:
        terms.append(c)
        source[c] = (c, None)
    for c in cats:
        for lv in (levels[c][1:] if drop_first else levels[c]):
            t = f"{c}_{lv}"
            terms.append(t)
            source[t] = (c, lv)
    return DesignSpec(list(features), numeric, levels, terms, source)


@dataclass
class TermStats:
    """Per-term statistics for one split (or all rows)."""

    n: int
    varies: dict[str, bool]
    binary: dict[str, bool]
    active: dict[str, int]
    active_pos: dict[str, int]
    n_pos: int


def term_stats(enc: DataFrame, terms: list[str], y_col: str | None, split_col: str | None = None,
               n_groups: int = 1, spec: "DesignSpec | None" = None) -> list[TermStats]:
    """Per-term variation, 0/1-ness, active counts and active positives, per split.

    Level-indicator terms are 0/1 and never NULL by construction, so their
    counts come from one grouped level count; only numeric terms need
    min/max/NULL checks.  Two small aggregations in total.
    """
    y = (F.col(y_col) == 1) if y_col else F.lit(False)
    g = F.col(split_col).cast("int") if split_col else F.lit(0)
    dummies = [t for t in terms if spec is not None and spec.source[t][1] is not None]
    numeric = [t for t in terms if t not in set(dummies)]
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_npos")]
    for i, t in enumerate(numeric):
        x = F.col(t)
        aggs += [
            ((F.min(x) != F.max(x)) | ((F.count_if(x.isNull()) > 0) & (F.count(x) > 0))).alias(f"v{i}"),
            F.coalesce(F.max(x.isNotNull() & ~x.isin(0.0, 1.0)), F.lit(False)).alias(f"nb{i}"),
            F.count(x).alias(f"nn{i}"),
            F.count_if(x > 0.5).alias(f"a{i}"),
            F.count_if((x > 0.5) & y).alias(f"ap{i}"),
        ]
    rows = {r["_g"]: r for r in enc.groupBy(g.alias("_g")).agg(*aggs).collect()}
    level_rows: dict[tuple[int, str], tuple[int, int]] = {}
    if dummies:
        pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("x")) for t in dummies])
        lv = (enc.select(g.alias("_g"), y.alias("_y"), F.inline(pairs)).filter(F.col("x") > 0.5)
              .groupBy("_g", "term").agg(F.count(F.lit(1)).alias("a"), F.count_if("_y").alias("ap")))
        for r in lv.collect():          # at most groups x dummy terms rows
            level_rows[(r["_g"], r["term"])] = (r["a"], r["ap"])
    out = []
    for gid in range(n_groups):
        r = rows.get(gid)
        n = r["_n"] if r is not None else 0
        varies, binary, active, active_pos = {}, {}, {}, {}
        for i, t in enumerate(numeric):
            varies[t] = bool(r[f"v{i}"]) if r is not None else False
            binary[t] = (r is not None) and (not r[f"nb{i}"]) and r[f"nn{i}"] > 0
            active[t] = int(r[f"a{i}"]) if r is not None else 0
            active_pos[t] = int(r[f"ap{i}"]) if r is not None else 0
        for t in dummies:
            a, ap = level_rows.get((gid, t), (0, 0))
            varies[t] = 0 < a < n
            binary[t] = n > 0
            active[t] = a
            active_pos[t] = ap
        out.append(TermStats(n, varies, binary, active, active_pos, int(r["_npos"]) if r is not None else 0))
    return out


def stats_of(found: Summary, terms: list[str], spec: "DesignSpec") -> TermStats:
    """The same statistics from the pass of ``summaries``."""
    varies = [bool(v) for v in found.low != found.high]
    levels = [spec.source[t][1] is not None for t in terms]
    return TermStats(found.n, dict(zip(terms, varies)), {t: found.n > 0 and (lv or o == 0) for t, lv, o in zip(terms, levels, found.other)},
                     {t: int(a) for t, a in zip(terms, found.active)}, {t: int(a) for t, a in zip(terms, found.active_pos)}, found.n_pos)


def combine_stats(parts: list[TermStats], terms: list[str]) -> TermStats:
    """All-row statistics from per-split ones (variation is recomputed conservatively)."""
    return TermStats(
        n=sum(p.n for p in parts),
        varies={t: any(p.varies[t] for p in parts) for t in terms},
        binary={t: all(p.binary[t] or p.n == 0 for p in parts) for t in terms},
        active={t: sum(p.active[t] for p in parts) for t in terms},
        active_pos={t: sum(p.active_pos[t] for p in parts) for t in terms},
        n_pos=sum(p.n_pos for p in parts),
    )


def sparse_dummy_drop(stats: TermStats, terms: list[str]) -> list[str]:
    """0/1 terms with too little support or that separate the outcome."""
    n = stats.n
    min_active = max(8, int(0.0005 * n))
    min_class = max(2, int(0.00005 * n))
    drop = []
    for t in terms:
        if not stats.binary[t]:
            continue
        a = stats.active[t]
        inactive = n - a
        a_pos = stats.active_pos[t]
        a_neg = a - a_pos
        if a < min_active or inactive == 0:
            drop.append(t)
        elif a_pos == 0 or a_neg == 0:
            drop.append(t)
        elif min(a_pos, a_neg) < min_class:
            drop.append(t)
    return drop


def _prune_constant_duplicate(terms: list[str], stats: TermStats, equal: dict[str, str]) -> tuple[list[str], list[str], list[str]]:
    """(kept, constant, duplicate) of the terms; ``equal`` names the first column that a column equals."""
    kept, const, dups, seen = [], [], [], set()
    for t in terms:
        if not stats.varies[t]:
            const.append(t)
        elif equal[t] in seen:
            dups.append(t)
        else:
            seen.add(equal[t])
            kept.append(t)
    return kept, const, dups


def _full_rank(terms: list[str], factor: np.ndarray, index: dict[str, int], tol: float) -> list[str]:
    return [terms[j] for j in independent_columns(factor[:, [index[t] for t in terms]], tol)]


def prune_design(spec: DesignSpec, df: DataFrame, y_col: str | None, *, split_col: str | None = None,
                 sparse: bool = True, rank: bool = True, rank_tol: float = 1e-10) -> DesignSpec:
    """Pruning in the analysis' order, from one pass for statistics, factors and fingerprints.

    ``rank=False`` leaves dependent terms in, for fits that can hold them
    (a penalised fit, or an ordered fit after reference levels are dropped).

    All rows: constant -> duplicate -> full rank.  Then, on the training rows
    (``split_col`` == 0, or all rows without a split): constant -> duplicate ->
    sparse/separating 0/1 terms -> full rank.  Test rows follow the train terms.
    Columns of one fingerprint are compared value by value before one is dropped.
    """
    terms = list(spec.terms)
    cols = [F.col(c) for c in ([y_col] if y_col else []) + ([split_col] if split_col else [])]
    enc = df.select(*cols, *[spec.term_expr(t).alias(t) for t in terms])
    n_groups = 2 if split_col else 1
    x, packing = spec.packed()
    y = F.coalesce(F.col(y_col) == 1, F.lit(False)) if y_col else F.lit(False)
    found = summaries(df.select(x.alias("x"), (F.col(split_col) if split_col else F.lit(0)).alias("g"), y.alias("y")), packing, terms, n_groups)
    parts = [stats_of(s, terms, spec) for s in found]
    factors, prints = [s.factor for s in found], [s.prints.tolist() for s in found]
    index = {t: i for i, t in enumerate(terms)}
    all_stats = combine_stats(parts, terms)
    both = [x ^ y for x, y in zip(*prints)] if split_col else prints[0]
    train_rows = F.col(split_col) == 0 if split_col else F.lit(True)
    # terms that do not vary go anyway, and are not compared
    live = [t for t in terms if all_stats.varies[t]]
    equal, equal_train = equal_columns(enc, live, [[f[index[t]] for t in live] for f in (both, prints[0])], [F.lit(True), train_rows])
    dropped: dict[str, str] = {}

    kept, const, dups = _prune_constant_duplicate(terms, all_stats, equal)
    dropped.update({t: "constant" for t in const})
    dropped.update({t: "duplicate" for t in dups})
    full = _full_rank(kept, np.vstack(factors), index, rank_tol) if rank else kept
    dropped.update({t: "dependent" for t in kept if t not in set(full)})

    train_stats = parts[0]
    kept, const, dups = _prune_constant_duplicate(full, train_stats, equal_train)
    dropped.update({t: "constant (train)" for t in const})
    dropped.update({t: "duplicate (train)" for t in dups})
    if sparse and y_col:
        sp = set(sparse_dummy_drop(train_stats, kept))
        dropped.update({t: "sparse or separating" for t in kept if t in sp})
        kept = [t for t in kept if t not in sp]
    final = _full_rank(kept, factors[0], index, rank_tol) if rank else kept
    dropped.update({t: "dependent (train)" for t in kept if t not in set(final)})
    out = DesignSpec(spec.features, spec.numeric, spec.levels, final, spec.source, dict(spec.dropped))
    out.dropped.update(dropped)
    return out

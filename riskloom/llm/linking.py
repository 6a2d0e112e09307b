"""Distributed union-find, and star-shaped candidate links inside buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_dir


#: Shuffle files go with the query that wrote them, and not when the driver's collector comes upon them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(spark: SparkSession, df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: a lost executor costs no earlier step, and the step's shuffles are given back."""
    path, before = scratch_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(spark: SparkSession, *steps: DataFrame) -> None:
    """Give the space of saved steps back once nothing reads them any more: an empty table overwrites them."""
    for step in steps:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(step.saved_at)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest id reachable.

    Each round hooks every node to its smallest neighbour, flattens the trees
    by pointer jumping and contracts the edges to the roots; every round at
    least halves the nodes that still have an edge. Empty edges give no rows.
    """
    links = saved(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = saved(spark, both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component"), F.lit(True).alias("moved")), "hook")
        while True:
            up = parents.select(F.col("id").alias("component"), F.col("component").alias("top"))
            jumped = saved(spark, parents.drop("moved").join(up, "component").select("id", F.col("top").alias("component"), (F.col("top") < F.col("component")).alias("moved")), "jump")
            discard(spark, parents)
            parents = jumped
            if parents.where("moved").isEmpty():
                break
        if found is None:
            labels = saved(spark, parents.drop("moved"), "labels")
        else:
            up = parents.select(F.col("id").alias("component"), F.col("component").alias("top"))
            labels = saved(spark, found.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")
            discard(spark, found)
        found = labels
        at = [parents.select(F.col("id").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")]
        rest = saved(spark, links.join(at[0], "a").join(at[1], "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
                     .where("a < b").distinct(), "edges")
        discard(spark, links, parents)
        links = rest
    return found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component"))


def contested(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Members (id, key) of buckets with two ids at least; weight: the sum of the sizes of an id's buckets."""
    # dealt by key once, for the counts and for the join: the counts read the ids too, since an exchange of keys alone would be a second one
    dealt = members.repartition("key")
    sizes = dealt.groupBy("key").agg(F.count("id").alias("n")).where("n > 1")
    shared = saved(spark, dealt.join(sizes, "key"), "members")
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    out = saved(spark, shared.drop("n").join(weights, "id"), "members")
    discard(spark, shared)
    return out


#: Star rounds before the rest is compared, most members of a bucket that is compared pair by pair, shingle hashes in a block of a larger one, and 64-bit words of a set's marks.
ROUNDS, FEW_MEMBERS, BLOCK_HASHES, MARK_WORDS = 2, 128, 60_000, 8


Sets = Callable[[Column], Column]


def marks(held_set: Column) -> Column:
    """A set of hashes as a bitmap of 512 bits (array<long>), each hash one bit; two sets differ in at least as many hashes as their bitmaps in bits."""
    def word(k: int) -> Column:
        def put(acc: Column, h: Column) -> Column:
            return acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8).bitwiseAND(F.lit(63)).cast("int")))
        return F.aggregate(F.filter(held_set, lambda h: h.bitwiseAND(F.lit(MARK_WORDS - 1)) == k), F.lit(0).cast("long"), put)
    return F.array(*[word(k) for k in range(MARK_WORDS)])


def marked(sets: DataFrame) -> DataFrame:
    """(id, n, marks) of (id, set) with distinct ids and sets that are not empty: sizes, and ``marks`` put together by an aggregation over the hashes."""
    # the outer form, since a filter for empty sets would be pushed below and make each set again
    hashes = sets.select("id", F.explode_outer("set").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63)).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.col("h").bitwiseAND(F.lit(MARK_WORDS - 1)) == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(MARK_WORDS)]
    return hashes.groupBy("id").agg(F.count("h").alias("n"), *words).select("id", "n", F.array(*[f"w{k}" for k in range(MARK_WORDS)]).alias("marks"))


def _near(n: Column, m: Column, a: Column | None, b: Column | None, percent: int) -> Column:
    """False only if sets of these sizes and marks cannot be close; decides most pairs before a set is looked at."""
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    if a is None or b is None:
        return sizes
    differ = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(MARK_WORDS)), F.lit(0))
    return sizes & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _close(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Of sets a, b with n, m values; 100 * both >= percent * (n + m - both), each set named once so that it is made once."""
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (n + m)


def close_pairs(pairs: DataFrame, known: DataFrame, percent: int, sets: Sets) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union; known: (id, n, held, marks or not), ``sets`` makes the set (array<long>) of what is held."""
    x, y = (known.select(F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in known.columns if k != "id"]) for c in ("a", "b"))
    # what is held moves, which may be much smaller than its set; sizes and marks alone decide most pairs before a set is made
    near = _near(F.col("n_a"), F.col("n_b"), *([F.col("marks_a"), F.col("marks_b")] if "marks" in known.columns else [None, None]), percent)
    close = _close(F.col("n_a"), F.col("n_b"), sets(F.col("held_a")), sets(F.col("held_b")), percent)
    return pairs.join(x, "a").join(y, "b").where(F.when(near, close).otherwise(False)).select("a", "b")


def compared(spark: SparkSession, active: DataFrame, known: DataFrame, percent: int, sets: Sets) -> DataFrame:
    """All close pairs (a, b) of ids of different components that share a bucket; active: (key, id, component).

    Members of a bucket of up to FEW_MEMBERS meet pair by pair by their sizes
    and marks, so that pairs are at most 64 times the members, and sets are made
    for those alone that may be close; larger buckets are compared in blocks,
    whose pairs are not written out.
    """
    sizes = active.groupBy("key").agg(F.count("id").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "members")
    rows = saved(spark, active.join(sizes, "key"), "rest")
    few = rows.where(F.col("members") <= FEW_MEMBERS).join(known.drop("held"), "id")
    x, y = (few.select("key", *[F.col(k).alias(f"{k}_{c}") for k in few.columns if k not in ("key", "members")]) for c in ("a", "b"))
    met = x.join(y, "key").where((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")))
    near = _near(F.col("n_a"), F.col("n_b"), *([F.col("marks_a"), F.col("marks_b")] if "marks" in known.columns else [None, None]), percent)
    pairs = saved(spark, met.where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
    many = rows.where(F.col("members") > FEW_MEMBERS).drop("members")
    links = close_pairs(pairs, known, percent, sets)
    return links if many.isEmpty() else links.unionByName(compared_in_blocks(many, known, percent, sets))


def compared_in_blocks(active: DataFrame, known: DataFrame, percent: int, sets: Sets) -> DataFrame:
    """All close pairs (a, b) of ids of different components that share a bucket; active: (key, id, component).

    A bucket's members are dealt to blocks of a bounded number of shingle
    hashes, and each two blocks meet in one row, inside which their members are
    compared: rows are pairs of blocks, and only close pairs come out. A pair
    is compared in the first bucket that it shares.
    """
    buckets = active.join(known.select("id", "n"), "id").groupBy("key").agg(F.sum("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low < high").select("key", F.ceil(F.col("n") / BLOCK_HASHES).cast("int").alias("blocks"))
    rows = active.join(buckets, "key")
    keys = rows.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    full = rows.join(keys, "id").join(known, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = full.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("component", "keys", *known.columns)).alias("members"))
    other = blocks.select(F.col("key").alias("other_key"), F.col("block").alias("other"), F.col("members").alias("others"))
    met = blocks.join(other, (F.col("key") == F.col("other_key")) & (F.col("block") <= F.col("other")))

    marked = "marks" in known.columns

    def made(members: Column) -> Column:
        return F.transform(members, lambda m: F.struct(*[m[c].alias(c) for c in ("component", "keys", *known.columns) if c != "held"], sets(m["held"]).alias("shingles")))

    def against(x: Column) -> Column:
        def wanted(y: Column) -> Column:
            fresh = (x["component"] != y["component"]) & ((F.col("block") < F.col("other")) | (x["id"] < y["id"]))
            near = _near(x["n"], y["n"], *([x["marks"], y["marks"]] if marked else [None, None]), percent)
            mine = F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")
            close = _close(x["n"], y["n"], x["shingles"], y["shingles"], percent)
            return F.when(fresh & near, F.when(mine, close).otherwise(False)).otherwise(False)
        return F.transform(F.filter("right", wanted), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))

    # the sets are made once a row; both columns are named again and again, so that the planner keeps them columns
    ready = met.select("key", "block", "other", made(F.col("members")).alias("left"), made(F.col("others")).alias("right")).where((F.size("left") > 0) & (F.size("right") > 0))
    return ready.select(F.inline(F.when((F.size("left") > 0) & (F.size("right") > 0), F.flatten(F.transform("left", against))))).distinct()


def _merged(spark: SparkSession, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, component) after more links (a, b)."""
    if labels is None:
        return components(spark, links)
    at = [labels.select(F.col("id").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")]
    roots = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = components(spark, roots)
    up = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = labels.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return saved(spark, old.unionByName(merged.join(labels, "id", "left_anti")), "labels")


def linked(spark: SparkSession, members: DataFrame, known: DataFrame, percent: int, sets: Sets = lambda held: held) -> DataFrame:
    """(id, component) of ids that links connect; members: ``contested``, known: (id, n, held, marks).

    ``sets`` makes an id's set of shingle hashes of what is held for it (by
    itself the set); n is the set's size, ``marks`` (may be left out) its bitmap.

    A star round picks in each bucket the member whose buckets are the largest
    (the likely origin of its copies; ties to the smaller id) and tests it
    against the members of other components, so pairs are fewer than members;
    then components grow and the tested centre leaves its bucket. Stars alone
    would lose links between members that are both unlike the centre, so
    buckets that still hold two components are then compared whole.
    """
    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))

    labels, active, last = None, members, None
    for _ in range(ROUNDS):
        now = labelled(active)
        centres = now.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"), F.col("component").alias("of"))).alias("c"),
                                         F.min("component").alias("low"), F.max("component").alias("high")) \
            .where("low < high").select("key", (-F.col("c.less")).alias("centre"), F.col("c.of").alias("centre_of"))
        # read back, the centres have an exchange of their own, and a bucket with very many members can be split
        rows = saved(spark, now.join(saved(spark, centres, "centres"), "key"), "round")
        pairs = rows.where("component <> centre_of").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        links = saved(spark, close_pairs(pairs, known, percent, sets), "links")
        labels = _merged(spark, labels, links)
        if last:
            discard(spark, last, links)
        active, last = rows.where("id <> centre").select("id", "key", "weight"), rows
    left = saved(spark, labelled(active).select("key", "id", "component"), "rest")
    discard(spark, last)
    rest = saved(spark, compared(spark, left, known, percent, sets), "links")
    return _merged(spark, labels, rest)

"""Spelling variant grouping by finite-state composition.

The vocabulary is the language of an acyclic acceptor. Composed with a transducer
that makes exactly one edit, and with the acceptor again, it accepts the pairs of
near words. The pairs are enumerated by the states that the composed machine is
in after a prefix, which is what partitions them over the cluster:

* Edit still to come, both copies in the state of prefix P: the words that begin
  with P are one block. A task builds the block's minimised acceptor and walks
  the composition; states with equal right languages are one, so a common
  continuation is computed once.
* A block of more than ``limit`` words is split by its next letter. Pairs whose
  edit is that very letter end in two blocks, in different states with the edit
  made; from there both must accept the same rest. These are met by an equi-join
  key: the word without that letter (or whole, where the other word has one letter
  more). Such a key holds at most one word a letter of the alphabet, so neither a
  hot prefix nor a hot key is ever more than a bounded group.
* Words longer than ``LONG`` letters are met at all places by fingerprints of the
  word without one letter, and confirmed by an exact comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm.linking import saved

#: Words of a block at most; letters of a word that goes into an acceptor at most.
BLOCK_WORDS, LONG = 16_384, 64
_ABC, _abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = "word string, n_near long, best struct<less:long,word:string>"
_DELETED = B.Rolling(211)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = 31) -> DataFrame:
    """(word), one row an occurrence: runs of letters (A-Z lowered) of whole texts; one run in ``damage`` loses a letter.

    h is the crc32 of ``<id>:<run>`` (a null id is the empty string); if
    ``damage`` divides h, the run loses the letter at h modulo its length.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _ABC, _abc)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    at = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.length("run").alias("size"))
    k = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.col("size")))
    return at.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))


class Acceptor:
    """Minimal acyclic acceptor of strings given in order."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        self._same: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}
        path, letters = [(False, [])], ""
        for w in words:
            k = 0
            while k < len(letters) and k < len(w) and letters[k] == w[k]:
                k += 1
            self._close(path, letters, k)
            path += [(False, []) for _ in w[k:]]
            path[-1] = (True, path[-1][1])
            letters = w
        self._close(path, letters, 0)
        self.start = self._state(path[0])

    def _close(self, path: list, letters: str, k: int) -> None:
        """States deeper than k have all their edges: equal ones become one."""
        for c in reversed(letters[k:]):
            node = path.pop()
            path[-1][1].append((c, self._state(node)))

    def _state(self, node: tuple[bool, list]) -> int:
        key = (node[0], tuple(node[1]))
        found = self._same.get(key)
        if found is None:
            found = self._same[key] = len(self.final)
            self.final.append(node[0])
            self.edges.append(dict(node[1]))
        return found

    def common(self, p: int, q: int) -> list[str]:
        """The strings accepted from both states: the composition once its edit is made."""
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            there = self.edges[q]
            for c, s in self.edges[p].items():
                if c in there:
                    found += [c + z for z in self.common(s, there[c])]
            self._common[key] = found
        return found

    def near(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted strings one edit apart, each once: the first different letter is the edit."""
        stack = [("", self.start)]
        while stack:
            x, p = stack.pop()
            out = list(self.edges[p].items())
            for i, (c, s) in enumerate(out):
                stack.append((x + c, s))
                for d, t in out[i + 1:]:
                    for z in self.common(s, t):
                        yield x + c + z, x + d + z
                for z in self.common(p, s):
                    if not z.startswith(c):
                        yield x + z, x + c + z


def _block(table: pa.Table) -> pa.Table:
    """Near words inside one block, counted, with the most frequent of each word (ties: smallest)."""
    counts = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
    found: dict[str, list] = {}
    for x, y in Acceptor(sorted(counts)).near():
        for a, b in ((x, y), (y, x)):
            best = (-counts[b], b)
            had = found.get(a)
            if had is None:
                found[a] = [1, best]
            else:
                had[0] += 1
                if best < had[1]:
                    had[1] = best
    rows = [(w, k, {"less": b[0], "word": b[1]}) for w, (k, b) in found.items()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.struct([("less", pa.int64()), ("word", pa.string())])))],
                    names=["word", "n_near", "best"])


def _blocks(spark: SparkSession, words: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(prefix, word, n) of blocks of at most ``limit`` words, and the words of every depth whose block was split."""
    whole, split, rest, depth = [], [], words, 0
    while True:
        keyed = rest.withColumn("prefix", F.substring("word", 1, depth))
        large = saved(spark, keyed.groupBy("prefix").agg(F.count("*").alias("size")).where(F.col("size") > limit).select("prefix"), "large")
        if large.isEmpty():
            whole.append(keyed)
            break
        whole.append(keyed.join(large, "prefix", "left_anti"))
        rest = saved(spark, keyed.join(large, "prefix", "left_semi").select("word", "n"), "rest")
        split.append(rest.withColumn("at", F.lit(depth)))
        depth += 1
    blocks = whole[0].select("prefix", "word", "n", F.lit(0).alias("depth"))
    for k, w in enumerate(whole[1:], 1):
        blocks = blocks.unionByName(w.select("prefix", "word", "n", F.lit(k).alias("depth")))
    return blocks, split


def _met(members: Column, key: Column, at: Column) -> Column:
    """Near words inside one key: members that lack different letters there, or one that is the key itself."""
    def others(x: Column) -> Column:
        def near(y: Column) -> Column:
            # whole words have an empty letter; their own letter at that place must be another, or the edit is a later one
            return (x["letter"] != y["letter"]) & (F.substring(x["word"], at + 1, F.lit(1)) != F.substring(y["word"], at + 1, F.lit(1)))
        return F.transform(F.filter(members, near), lambda y: F.struct((-y["n"]).alias("less"), y["word"].alias("word")))
    return F.transform(members, lambda x: F.struct(x["word"].alias("word"), others(x).alias("near")))


def _across(split: DataFrame) -> DataFrame:
    """Near pairs whose edit is the letter at ``at``; split: (word, n, at)."""
    at = F.col("at")
    letter = F.substring("word", at + 1, F.lit(1))
    without = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    whole = F.struct(F.lit("").alias("letter"), F.col("word").alias("key"))
    both = F.when(F.length("word") > at, F.array(whole, F.struct(letter.alias("letter"), without.alias("key")))).otherwise(F.array(whole))
    keys = split.select("word", "n", "at", F.inline(both)).groupBy("at", "key").agg(F.collect_list(F.struct("letter", "word", "n")).alias("members")).where(F.size("members") > 1)
    found = keys.select(F.inline(_met(F.col("members"), F.col("key"), F.col("at")))).where(F.size("near") > 0)
    return found.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))


def _without_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, key, name) of long words: for each place the fingerprints of the word and of the word without the letter there."""
    for batch in batches:
        for name, word in zip(batch.column("name").to_pylist(), batch.column("word").to_pylist()):
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)
            n = len(letters)
            whole = _DELETED.spans(_DELETED.prefix(letters), np.zeros(1, np.int64), np.array([n]))
            keys = np.concatenate((_DELETED.without_one(letters), np.repeat(whole, n + 1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.arange(n), np.arange(n + 1)))), pa.array(keys), pa.array(np.full(2 * n + 1, name))], ["at", "key", "name"])


def _long(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Near pairs of long words: a key (place, word without that letter) is shared by one word a letter at most; levenshtein confirms."""
    named = saved(spark, words.withColumn("name", F.monotonically_increasing_id()), "long")
    keys = saved(spark, named.select("name", "word").mapInArrow(_without_one, "at long, key long, name long"), "without")
    other = keys.select("at", "key", F.col("name").alias("other"))
    pairs = keys.join(other, ["at", "key"]).where("name <> other").select("name", "other").distinct()
    right = named.select(F.col("name").alias("other"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("best"))
    near = pairs.join(named, "name").join(right, "other").where(F.levenshtein("word", "best.word", 1) == 1)
    return near.select("word", F.lit(1).cast("long").alias("n_near"), "best")


def near_words(spark: SparkSession, words: DataFrame, limit: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best: -n and word of the most frequent near word) of all words that have one; words: (word, n), distinct."""
    blocks, split = _blocks(spark, words.where(F.length("word") <= LONG), limit)
    found = blocks.groupBy("depth", "prefix").applyInArrow(_block, _NEAR)
    for s in split:
        found = found.unionByName(_across(s))
    # a short and a long word can be near at the border
    long = words.where(F.length("word") >= LONG)
    if not long.isEmpty():
        both_short = F.length("word") + F.length("best.word") == 2 * LONG
        found = found.unionByName(_long(spark, long).where(~both_short))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(spark: SparkSession, docs: DataFrame, least_letters: int = 7, least_n: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text",
             damage: int = 31, limit: int = BLOCK_WORDS) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n, root.

    A word's form is its near word (one letter inserted, deleted or replaced) of
    the largest n (ties: the smallest), if that n is ``ratio`` times the word's
    at least, else null; root follows the forms to the last (n grows tenfold
    each time, so a chain is short). Null and empty texts have no words; repeated
    rows count again; an empty table gives no rows; other columns are not read.
    """
    counted = occurrences(docs, id_col, text_col, damage).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    words = saved(spark, counted.where(F.col("n") >= least_n), "words")
    near = near_words(spark, words, limit)
    enough = -F.col("best.less") >= ratio * F.col("n")
    known = saved(spark, words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "known")
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        links = saved(spark, links.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return known.join(links.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return variants(spark, docs).select("word", "form", "root", "n", "n_near", "form_n")

"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars.

Equal shingle sets are one class first, so exact copies (however many) are one
node. Each class's set is cut into bins by its hash's upper bits; the smallest
hash of each bin is its sketch; an empty bin copies a full one that its own
hash sequence chooses, the same for all sets (optimal densification). Bands of
four bins are bucket keys: two sets of similarity 0.85 miss all 32 of them with
probability 6e-11. ``linking.linked`` draws stars inside the buckets, compares
in blocks what stars cannot decide, and confirms every link on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm import ties
from riskloom.llm.linking import contested, linked, saved

#: Bins of a sketch, and bins of a band.
BINS, ROWS = 128, 4
_SPELL, _SHINGLE = B.Rolling(131), B.Rolling(149)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _choices() -> np.ndarray:
    """For each bin the order in which it looks for a full one."""
    rng = np.random.default_rng(171)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_CHOICES = _choices()


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document (words lower-cased in A-Z)."""
    data, ends = B.columns(batch)
    data = _LOWER[data]
    starts, stops, upto = B.words(data, ends)
    spelled = _SPELL.spans(_SPELL.prefix(data), starts, stops)
    first = np.concatenate(([0], upto[:-1])) if len(upto) else upto
    prefix = _SHINGLE.prefix(spelled)
    at = np.arange(max(len(starts) - size + 1, 0))
    grams = _SHINGLE.spans(prefix, at, at + size)
    for a, b in zip(first.tolist(), upto.tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            yield _SHINGLE.spans(prefix, np.array([a]), np.array([b])) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One-permutation sketch of a set that is not empty, densified."""
    h = B.mix(hashes)
    out = np.full(BINS, _EMPTY)
    np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64), h)
    empty = np.flatnonzero(out == _EMPTY)
    if len(empty):
        full = out != _EMPTY
        donor = _CHOICES[empty, np.argmax(full[_CHOICES[empty]], axis=1)]
        out[empty] = out[donor]
    return out


def _bands(s: np.ndarray) -> np.ndarray:
    key = np.arange(1, BINS // ROWS + 1, dtype=np.uint64)
    for column in s.reshape(-1, ROWS).T:
        key = B.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of distinct ``size``-word shingles (fewer words: the whole sequence as
    one). Null, empty and wordless texts have an empty set and no link. A
    component is named by its smallest doc_id, whose row is kept. Rows with one
    doc_id are one document; rows with a null id are linked with nothing, have
    a null component and are kept. An empty table gives no rows; other columns
    are not read.
    """
    rows = ties.document_bytes(docs, id_col, text_col)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in pieces(batch):
                for name, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part, size)):
                    d = s.view(np.int64)
                    out.append((name, len(s), int(B.mix(s).view(np.int64).sum()), int(B.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64).sum()), _bands(sketch(s)) if len(d) else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.list_(pa.int64())))], ["doc_id", "n", "one", "two", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [s.view(np.int64) for s in shingle_sets(part, size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "n", "held"])

    seen = saved(spark, rows.mapInArrow(sketches, "doc_id long, n long, one long, two long, bands array<long>"), "sketches")
    classes = saved(spark, seen.where("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    members = contested(spark, classes.select("id", F.explode("bands").alias("key")).distinct())
    known = saved(spark, rows.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(sets, "id long, n long, held array<long>"), "sets")

    labels = linked(spark, members, known, percent).select(F.col("id").alias("label_id"), "component")
    named = classes.drop("bands").join(labels, F.col("id") == F.col("label_id"), "left").select("n", "one", "two", F.coalesce("component", "id").alias("component"))
    out = seen.drop("bands").join(named, ["n", "one", "two"], "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole documents of about ``limit`` bytes."""
    if batch.num_rows:
        _, ends = B.columns(batch)
        group = np.maximum(ends - 1, 0) // limit
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(ends)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.slice(a, b - a)

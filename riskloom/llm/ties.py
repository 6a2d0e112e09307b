"""Which fingerprints occur more than once in the whole corpus?

Documents are packed into *blocks* of about two megabytes. Every block sends
each of its distinct fingerprints once to the *bucket* that owns it (so a
passage with a million copies costs one entry a block, not a million rows),
buckets are sorted one at a time, and the answer that goes back is one bit an
entry, in the order in which the block sent them. Memory is bounded by one
block or one bucket; both counts grow with the data. Nothing is collected.

An entry is 64 bits (of one fingerprint, three of them mixed with an independent one) and the
bucket number, taken from that other fingerprint, adds log2(buckets) more. With a million entries a bucket, the
expected number of false ties among N entries is N / 2^45 (0.3 for 10^13).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BUCKET_ENTRIES = 1_000_000
MIN_BUCKETS = 128

_BLOCK = pa.schema([("block", pa.int64()), ("payload", pa.large_binary())])
_REQUEST = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("bucket", pa.int64()), ("entries", pa.binary())])


def document_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text binary); a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def n_buckets(entries: float) -> int:
    return max(MIN_BUCKETS, math.ceil(entries / BUCKET_ENTRIES))


def _compressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as r:
        table = r.read_all().combine_chunks()
    return table.to_batches()[0]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each batch into blocks of whole documents (a longer document is a block of its own)."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column("text"))).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], schema=batch.schema)
            yield pa.RecordBatch.from_pylist([{"block": block, "payload": _compressed(part)}], schema=_BLOCK)
            block += 1


def blocks(rows: DataFrame) -> DataFrame:
    """(block, payload), exchanged by block once; all rounds of a plan reuse that exchange.

    ``rows`` should read a stored table: block numbers follow its scan order,
    which a recomputed task then meets again.
    """
    return rows.mapInArrow(_pack, "block long, payload binary").repartition("block")


class Entries:
    """A block's distinct (bucket, key) entries in order, and the way back to its positions."""

    def __init__(self, keys: np.ndarray, spread: np.ndarray, buckets: int):
        """spread: independent 64-bit fingerprints, from which the bucket comes."""
        bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        keys = keys ^ (spread << np.uint64(61))
        if buckets <= 1 << 16:
            # by key, then stable by bucket, which is a radix sort of 16 bits
            order = np.argsort(keys)
            order = order[np.argsort(bucket[order].astype(np.uint16), kind="stable")]
        else:
            order = np.lexsort((keys, bucket))
        k, b = keys[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        at = np.cumsum(new) - 1
        self.index = np.empty(len(k), np.int64)
        self.index[order] = at
        self.keys, self.buckets = k[new], b[new]
        self.repeated = np.bincount(at, minlength=len(self.keys)) > 1
        self.cuts = np.concatenate((np.flatnonzero(np.diff(self.buckets, prepend=-1)), [len(self.keys)])).astype(np.int64)

    def requests(self, block: int, round_: int) -> pa.RecordBatch:
        pieces = [self.keys[a:b].tobytes() for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        n = len(pieces)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([round_] * n, pa.int32()), pa.array(self.buckets[self.cuts[:-1]], pa.int64()), pa.array(pieces, pa.binary())], schema=_REQUEST)

    def answers(self, table: pa.Table, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position the two answer bits of its entry."""
        got = {b: e for r, b, e in zip(*(table.column(c).to_pylist() for c in ("round", "bucket", "entries"))) if r == round_}
        one, two = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            bits = np.unpackbits(np.frombuffer(got[int(self.buckets[a])], np.uint8).reshape(2, -1), axis=1, count=b - a)
            one[a:b], two[a:b] = bits[0], bits[1]
        return one[self.index], two[self.index]


def _answer(decide: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    def bucket(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(e, np.uint64) for e in table.column("entries").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        one, two = np.empty(len(keys), bool), np.empty(len(keys), bool)
        one[order], two[order] = decide(keys[order])
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(np.stack((one[e - len(p):e], two[e - len(p):e])), axis=1).tobytes() for p, e in zip(parts, ends)]
        return pa.table([table.column("block"), table.column("round"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_REQUEST)
    return bucket


def equal_neighbours(k: np.ndarray) -> np.ndarray:
    same = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[1:] = same
    out[:-1] |= same
    return out


def tied(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits: another block has the same key; another entry has the same upper half."""
    return equal_neighbours(k), equal_neighbours(k >> np.uint64(32))


def group_has_mark(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries equal but for the lowest bit form a group; the bit is set for groups with a 1 there."""
    start = np.concatenate(([True], (k[1:] >> np.uint64(1)) != (k[:-1] >> np.uint64(1))))
    group = np.cumsum(start) - 1
    marked = np.bincount(group, weights=(k & np.uint64(1)).astype(float)) > 0
    return marked[group], marked[group]


def resolve(requests: DataFrame, decide=tied) -> DataFrame:
    """Sort one bucket at a time; returns the rows with answer bits in place of entries."""
    return requests.groupBy("bucket").applyInArrow(_answer(decide), requests.schema).repartition("block")


def ask(parts: DataFrame, entries: Callable[[pa.RecordBatch], Entries], round_: int = 1) -> DataFrame:
    """First round: the entries of each block, from its documents alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                yield entries(unpacked(payload)).requests(block, round_)
    return parts.mapInArrow(run, "block long, round int, bucket long, entries binary")


def with_answers(parts: DataFrame, answers: DataFrame, fn: Callable[[int, pa.RecordBatch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(block, documents, answers of all rounds so far) for each block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left.column("block")[0].as_py(), unpacked(left.column("payload")[0].as_py()), right)
    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)

"""Suffix-array dedup of byte strings by blockwise difference-cover construction.

The suffixes of interest are compared on their first ``length`` bytes. A full
suffix array would carry every suffix through a shuffle; the difference cover
avoids that:

* ``v, D`` is a difference cover: for any two positions i, j some d < v puts
  both i + d and j + d on *cover sample* positions (their offset in the document
  modulo v is in D). So two equal strings of ``length`` bytes always hold two
  aligned sample suffixes that agree on ``length - v + 1`` bytes.
* Round 1 ranks the sample suffixes, one suffix bucket sorted at a time, on
  ``length - v + 1`` and on ``length + v - 1`` bytes, with 32 bits of each key. A
  tie on the shorter key marks where a match can be at all; a tie on the longer
  one may decide all v suffixes that begin at the sample position, however long
  the common prefix is.
* A tie on the longer key is confirmed by whole fingerprints of the longer
  prefix, dealt by themselves, since very many texts may share the shorter one.
  Confirmed long ties are resolved by these ranks and their suffixes never enter
  a sort.
* Round 2 tells each tied sample group whether any of its members still has an
  undecided suffix nearby (the ends of repeated passages).
* Round 3 sorts, again one bucket at a time, only the suffixes next to such
  groups, on all ``length`` bytes.

Keys are Rabin-Karp fingerprints, so the order inside a bucket is theirs and
not alphabetical; only equality of prefixes is used. ``ties`` gives the bound
for false ties. A task holds one block of documents or one bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm import ties

_FIRST, _SECOND = B.Wrapping(51), B.Wrapping(67)
_WIDE = B.Rolling(51), B.Rolling(67)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_REQUESTS = "block long, round int, bucket long, entries binary"
#: Number of the confirming round among the requests.
CONFIRM = 4


class _Suffixes:
    """The suffixes of one block and what the rounds so far say about them."""

    def __init__(self, batch: pa.RecordBatch, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.v, residues = B.difference_cover(length)
        self.data, self.ends = B.columns(batch)
        self.n = len(self.data)
        self.firsts = np.concatenate(([0], self.ends[:-1]))
        sizes = self.ends - self.firsts
        short = length - self.v + 1
        # the cover's places in the longest document, of which each document takes those that hold a short key
        most = max(int(sizes.max(initial=0)) - short + 1, 0)
        cover = (np.arange(0, most, self.v)[:, None] + np.sort(residues)).reshape(-1)
        taken = np.searchsorted(cover, sizes - short + 1)
        self.sample = np.concatenate([np.zeros(0, np.int64), *(cover[:k] + a for k, a in zip(taken.tolist(), self.firsts.tolist()) if k)])
        self.first, self.second = (_FIRST, _SECOND) if length + self.v - 1 < B.Wrapping.WINDOW else _WIDE
        self.p, self.q = self.first.prefix(self.data), self.second.prefix(self.data)
        self.rank = self.first.spans(self.p, self.sample, self.sample + short)
        self.spread = self.second.spans(self.q, self.sample, self.sample + short)

    def first_of(self, at: np.ndarray) -> np.ndarray:
        """Where the documents of the places begin."""
        return self.firsts[np.searchsorted(self.ends, at, side="right")]

    def end_of(self, at: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, at, side="right")]

    def ranks(self) -> ties.Entries:
        """Round 1: upper half the short key, lower half the long one (0: the document ends before)."""
        size = self.length + self.v - 1
        self.whole = self.sample + size <= self.end_of(self.sample)
        s = self.sample[self.whole]
        low = np.zeros(len(self.sample), np.uint64)
        low[self.whole] = np.maximum(self.first.spans(self.p, s, s + size) >> np.uint64(32), np.uint64(1))
        return ties.Entries(self.rank >> np.uint64(32) << np.uint64(32) | low, self.spread, self.buckets)

    def near(self, samples: np.ndarray) -> np.ndarray:
        """Starts of the strings of ``length`` bytes that contain one of the samples at an offset below v."""
        low = np.maximum(samples - self.v + 1, self.first_of(samples))
        at = np.flatnonzero(B.cover(self.n, low, samples - low + 1))
        return at[at + self.length <= self.end_of(at)]

    def long_ties(self, answers: pa.Table) -> ties.Entries:
        """Confirmation: whole fingerprints of the long prefixes that seem to be tied."""
        entries = self.ranks()
        equal, tied = entries.answers(answers, 1)
        again = entries.repeated[entries.index]
        self.tied = tied | again
        self.long = self.sample[(equal | again) & self.whole]
        keys, spread = (r.spans(x, self.long, self.long + self.length + self.v - 1) for r, x in ((self.first, self.p), (self.second, self.q)))
        return ties.Entries(keys, spread, self.buckets)

    def decide_long(self, answers: pa.Table) -> None:
        entries = self.long_ties(answers)
        equal, _ = entries.answers(answers, CONFIRM)
        self.gone = B.cover(self.n, self.long[equal | entries.repeated[entries.index]], self.length + self.v - 1)

    def groups(self) -> ties.Entries:
        """Round 2: tied sample ranks, lowest bit set where an undecided suffix is near."""
        left = np.concatenate(([0], np.cumsum(~self.gone)))
        open_ = self.near(self.sample[self.tied])
        open_ = open_[left[open_ + self.length] > left[open_]]
        seen = np.concatenate(([0], np.cumsum(np.bincount(open_, minlength=self.n))))
        s = self.sample[self.tied]
        mark = seen[s + 1] > seen[np.maximum(s - self.v + 1, self.first_of(s))]
        return ties.Entries(self.rank[self.tied] & ~np.uint64(1) | mark.astype(np.uint64), self.spread[self.tied], self.buckets)

    def suffixes(self, answers: pa.Table) -> ties.Entries:
        """Round 3: the suffixes near groups with an undecided member."""
        marked, _ = self.groups().answers(answers, 2)
        self.at = self.near(self.sample[self.tied][marked])
        keys, spread = (r.spans(x, self.at, self.at + self.length) for r, x in ((self.first, self.p), (self.second, self.q)))
        return ties.Entries(keys, spread, self.buckets)

    def decide_rest(self, answers: pa.Table) -> None:
        entries = self.suffixes(answers)
        equal, _ = entries.answers(answers, 3)
        self.gone |= B.cover(self.n, self.at[equal | entries.repeated[entries.index]], self.length)


def _remove(s: _Suffixes, batch: pa.RecordBatch) -> pa.Table:
    text = s.data[~s.gone]
    removed = np.concatenate(([0], np.cumsum(s.gone)))
    kept = np.arange(s.n + 1) - removed
    spans, rest = [], []
    for a, b in zip(s.firsts, s.ends):
        x, y = B.runs(s.gone[a:b])
        spans.append([{"start": i, "end": j} for i, j in zip(x.tolist(), y.tolist())])
        rest.append(text[kept[a]:kept[b]].tobytes())
    return pa.table([batch.column("doc_id"), pa.array(s.ends - s.firsts), pa.array(removed[s.ends] - removed[s.firsts]),
                     pa.array(spans, _OUT.field("removed").type), pa.array(rest, pa.binary())], schema=_OUT)


def remove_repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts twice or more in the corpus.

    Texts are whole UTF-8 byte strings (null: empty); strings never cross
    documents, may overlap each other, and are judged on the input.

    Returns doc_id, n_bytes, n_removed, removed (maximal byte runs, end
    exclusive), kept (remaining bytes), one row per input row. Texts shorter
    than ``length`` keep all; null ids stay null; repeated rows of that length
    lose everything; an empty table gives no rows; other columns are not read.
    """
    v, residues = B.difference_cover(length)
    buckets = ties.n_buckets(ties.total_bytes(docs, text_col) * len(residues) / v)
    parts = ties.blocks(ties.document_bytes(docs, id_col, text_col))

    def load(batch: pa.RecordBatch) -> _Suffixes:
        return _Suffixes(batch, length, buckets)

    def confirm(block: int, batch: pa.RecordBatch, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([load(batch).long_ties(answers).requests(block, CONFIRM)])

    def second(block: int, batch: pa.RecordBatch, answers: pa.Table) -> pa.Table:
        s = load(batch)
        s.decide_long(answers)
        return pa.Table.from_batches([s.groups().requests(block, 2)])

    def third(block: int, batch: pa.RecordBatch, answers: pa.Table) -> pa.Table:
        s = load(batch)
        s.decide_long(answers)
        return pa.Table.from_batches([s.suffixes(answers).requests(block, 3)])

    def last(block: int, batch: pa.RecordBatch, answers: pa.Table) -> pa.Table:
        s = load(batch)
        s.decide_long(answers)
        s.decide_rest(answers)
        return _remove(s, batch)

    known = ties.resolve(ties.ask(parts, lambda batch: load(batch).ranks()))
    known = known.unionByName(ties.resolve(ties.with_answers(parts, known, confirm, _REQUESTS)))
    known = known.unionByName(ties.resolve(ties.with_answers(parts, known, second, _REQUESTS), ties.group_has_mark))
    known = known.unionByName(ties.resolve(ties.with_answers(parts, known, third, _REQUESTS)))
    return ties.with_answers(parts, known, last, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame, length: int = 200) -> DataFrame:
    return remove_repeated_bytes(docs, length).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                                                      ties.sha256_hex(F.col("kept")).alias("kept_sha256"))

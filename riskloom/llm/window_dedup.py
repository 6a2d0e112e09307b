"""Substring dedup: Rabin-Karp hashes of every fixed-length token window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm import ties

_SPELL, _FIRST = B.Rolling(11), B.Rolling(23)
_SPELL_AGAIN, _SECOND = B.Rolling(29), B.Rolling(37)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


class _Windows:
    """All words of a block and the fingerprints of its windows."""

    def __init__(self, batch: pa.RecordBatch, window: int, buckets: int):
        self.data, self.ends = B.columns(batch)
        self.starts, self.stops, self.upto = B.words(self.data, self.ends)
        # the second fingerprint is made from the bytes again, so that a collision of the first spelling is none of both
        first, second = (r.spans(r.prefix(self.data), self.starts, self.stops) for r in (_SPELL, _SPELL_AGAIN))
        until = np.repeat(self.upto, np.diff(self.upto, prepend=0))  # of each word's document
        self.at = np.flatnonzero(np.arange(len(self.starts)) + window <= until)
        keys, spread = (r.spans(r.prefix(v), self.at, self.at + window) for r, v in ((_FIRST, first), (_SECOND, second)))
        self.entries = ties.Entries(keys, spread, buckets)


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins there."""
    size = stops - starts + 1
    at = np.cumsum(size) - size
    out = np.append(data, 0x20)[np.repeat(starts - at, size) + np.arange(size.sum())].astype(np.uint8)
    out[at + size - 1] = 0x20
    return out, at


def _remove(batch: pa.RecordBatch, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    w = _Windows(batch, window, buckets)
    tied, _ = w.entries.answers(answers, 1)
    gone = B.cover(len(w.starts), w.at[tied | w.entries.repeated[w.entries.index]], window)
    first = np.concatenate(([0], w.upto[:-1]))
    text, place = joined(w.data, w.starts[~gone], w.stops[~gone])
    place = np.append(place, len(text))
    kept_upto = np.concatenate(([0], np.cumsum(~gone)))
    removed_upto = np.concatenate(([0], np.cumsum(gone)))
    spans, kept = [], []
    for a, b in zip(first, w.upto):
        s, e = B.runs(gone[a:b])
        spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
        kept.append(text[place[kept_upto[a]]:max(place[kept_upto[b]] - 1, place[kept_upto[a]])].tobytes())
    return pa.table([batch.column("doc_id"), pa.array(w.upto - first), pa.array(removed_upto[w.upto] - removed_upto[first]),
                     pa.array(spans, _OUT.field("removed").type), pa.array(kept, pa.binary())], schema=_OUT)


def remove_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts twice or more in the corpus.

    Words are runs of non-separators (``[^\\x20\\x09-\\x0D]+``) of the whole
    text; windows never cross documents and are judged on the input. Every
    window's Rabin-Karp fingerprint is counted; those found again are merged
    into maximal removal intervals.

    Returns doc_id, n_words, n_removed, removed (word intervals, end
    exclusive), kept (UTF-8, kept words joined by one space); one row per input
    row. Null or empty texts have no words and keep an empty text; null ids
    stay null; repeated rows repeat each other's windows and so lose them; an
    empty table gives no rows; other columns are not read.
    """
    buckets = ties.n_buckets(ties.total_bytes(docs, text_col) / 6)
    parts = ties.blocks(ties.document_bytes(docs, id_col, text_col))
    answers = ties.resolve(ties.ask(parts, lambda batch: _Windows(batch, window, buckets).entries))
    return ties.with_answers(parts, answers, lambda _, batch, got: _remove(batch, got, window, buckets),
                             "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    return remove_repeated_windows(docs, window).select("doc_id", "n_words", "n_removed", ties.sha256_hex(F.col("kept")).alias("kept_sha256"))

"""Shortest-pack-first packing over the length histogram.

Tokenized documents are cut into pieces of at most one sequence (``spans``). The histogram
of piece lengths (one count for each length, so its size does not follow the
corpus) is packed on the driver, longest first, always into the shortest pack
that is open; packs of equal contents are one group with a count. Every step
covers a range of ranks within one length, and pieces find their sequence by
their own rank.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm import ties
from riskloom.llm.tokens import encoder
from riskloom.session import scratch_dir

#: Ranks are counted apart in so many shares of a length at least; one more for every million pieces.
MIN_SHARES, SHARE_PIECES = 64, 1_000_000


#: ASCII characters that are neither letter, digit, white space nor apostrophe.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_MARKS_ASCII = _MARKS.encode()


def letters_and_marks(word: bytes) -> tuple[bytes, ...]:
    """A word of letters and then marks as these two parts, ASCII letters in lower case; any other as it is.

    The tokenizer's pattern takes letters as one pre-token and the marks after
    them as another (contractions begin with an apostrophe), and it lowers
    case itself, so the parts have the word's ids.
    """
    if word.isascii():
        head = word.rstrip(_MARKS_ASCII)
        if not head.isalpha():
            return (word,)
        return (head.lower(), word[len(head):]) if len(head) < len(word) else (head.lower(),)
    text = word.decode("utf-8", "replace")
    head = text.rstrip(_MARKS)
    if not (head.isalpha() and head.lower().isalpha()):
        return (word,)
    tail = text[len(head):].encode()
    return (head.encode(), tail) if tail else (word,)


# The pattern of the tokenizers whose words can be encoded apart.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def require_words(tokenizer) -> None:
    """ValueError unless words may be encoded apart: marks at the ends of words, lower case, white space dropped, the known pattern."""
    made = json.loads(tokenizer.to_str())
    kinds = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
    split = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    known = split.get("type") == "Split" and split["pattern"].get("Regex") == PATTERN and split["behavior"] == "Removed" and split["invert"]
    if not known or kinds != ["NFC", "Replace", "Lowercase"] or made["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("packing takes word-level BPE with marks at the ends of words and the known pattern only")
    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("packing takes no added tokens that depend on white space")


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of n ids is cut: whole sequences, then a half if the rest is longer than that.

    Two halves fill a sequence, and what is left is short, so that documents a
    little longer than half a sequence do not each leave the other half empty.
    """
    cuts = list(range(0, n, capacity))
    if cuts and capacity // 2 < n - cuts[-1] < capacity:
        cuts.append(cuts[-1] + capacity // 2)
    return list(zip(cuts, [*cuts[1:], n]))


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids little-endian uint32, ids_crc32, doc_tokens) of each piece.

    White space parts the texts into chunks that this tokenizer encodes apart
    (its pattern has no white space), each distinct chunk once while a worker
    remembers it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop = encoder(path), np.asarray([end_id], "<u4").tobytes()
        require_words(known.tokenizer)
        for batch in batches:
            data, ends = B.columns(batch)
            raw, names = data.tobytes(), batch.column("doc_id").to_pylist()
            first = [0, *ends[:-1].tolist()]
            group = np.maximum(ends - 1, 0) // (4 << 20)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(ends)])) if len(ends) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                words = [raw[x:y].split() for x, y in zip(first[a:b], ends[a:b].tolist())]
                ids = known.lookup(chain.from_iterable(words), letters_and_marks)
                rows = []
                for name, ws in zip(names[a:b], words):
                    whole = b"".join([ids[w] for w in ws]) + stop
                    n = len(whole) // 4
                    for s, e in spans(n, capacity):
                        part = whole[4 * s:4 * e]
                        rows.append((name, s, e - s, part, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))],
                                                 ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    return ties.document_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Placements (length, first rank, first sequence, offset), sorted by length and rank.

    The piece of that length with rank r (from the first rank up to the next
    placement's) goes to sequence first sequence + (r - first rank).
    """
    open_: list[tuple[int, int, int]] = []  # used, first sequence, number of packs
    placed, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_ and open_[0][0] + length <= capacity:
                used, sequence, n = heapq.heappop(open_)
                take = min(n, left)
                if take < n:
                    heapq.heappush(open_, (used, sequence + take, n - take))
            else:
                used, sequence, take = 0, fresh, -(-left // (capacity // length))  # as many as these fill
                fresh += take
            placed.append((length, rank, sequence, used))
            if used + length < capacity:
                heapq.heappush(open_, (used + length, sequence, take))
            rank += take
            left -= take
    return np.array(sorted(placed), np.int64).reshape(-1, 4)


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents (ids of the whole text, then ``end_id``) into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, start, length, ids (binary, little-endian
    uint32), ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are the one id ``end_id``; null and repeated doc_ids are packed as the rows
    they are (a repeated id's pieces are told apart by their place, not by
    name); an empty table gives no rows; other columns are not read. Pieces are
    written once to the shared folder, so tokens are made once. Tokenizers whose
    words cannot be encoded apart are refused (``require_words``).
    """
    table = scratch_dir(spark, "pieces")
    # the number given to a row when it is written tells apart what is equal
    pieces(docs, path, end_id, capacity, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()).write.parquet(table)
    made = spark.read.parquet(table)
    shares = max(MIN_SHARES, math.ceil(made.count() / SHARE_PIECES))
    made = made.withColumn("share", F.pmod(F.xxhash64("piece"), F.lit(shares)))
    counts = made.groupBy("length", "share").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    placed = shortest_pack_first(histogram, capacity)
    keys = placed[:, 0] << 44 | placed[:, 1]  # length, first rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = placed[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], ["piece", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = made.select("piece", "length", "share", F.row_number().over(Window.partitionBy("length", "share").orderBy("piece")).alias("k")) \
        .join(offsets, ["length", "share"]).select("piece", "length", (F.col("skip") + F.col("k") - 1).alias("rank"))
    seats = ranked.mapInArrow(place, "piece long, sequence_id long, offset long")
    return made.join(seats, "piece").select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def digest(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return pack(spark, docs, path).drop("ids")

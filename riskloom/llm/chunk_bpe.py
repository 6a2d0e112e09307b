"""BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash over the last bytes picks cuts at spaces, so the same passage is
cut alike in every document; a chunk is encoded once by a worker while it is
remembered and reused in all documents after that. Then the joins are repaired. A
join agrees with the encoding of the whole if a pre-token begins there: the space
stands between two characters that are no white space, so no run of white space,
no ``\\s+(?!\\S)`` and no other alternative of the pattern can reach across.
Every other join is encoded again, in a window that is widened on both sides to
the next join that is sure to agree; where its ids differ from those of its
chunks, they replace them. So all joins agree in the end. The proof holds for
byte-level BPE with the GPT-2 pattern alone, and other tokenizers are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import bytesops as B
from riskloom.llm import ties
from riskloom.llm.tokens import Encoder, encoder, token_bytes

_ROLL = B.Rolling(83)
#: Bytes under the rolling hash, and cuts taken of every 256 candidates.
HASHED, CUTS_IN_256 = 4, 224
#: Documents are handled in groups of about so many bytes.
GROUP_BYTES = 1 << 20


def cuts(data: np.ndarray, ends: np.ndarray, taken: int = CUTS_IN_256) -> tuple[np.ndarray, np.ndarray]:
    """Starts of chunks (each document's first byte and the rolling hash's cuts), and whether the join before each is sure to agree."""
    n = len(data)
    at = np.flatnonzero(data == 0x20)
    low = np.maximum(at - HASHED, 0)
    at = at[(_ROLL.spans(_ROLL.prefix(data), low, at) & np.uint64(255)) < taken]
    before, second, third, after = (data[np.clip(at + k, 0, n - 1)] for k in (-1, -2, -3, 1))
    wide_before = (before >= 0x80) & ((second == 0xC2) | np.isin(third, (0xE1, 0xE2, 0xE3)))
    wide_after = np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))
    sure = at[(before > 0x20) & (after > 0x20) & ~wide_before & ~wide_after & (at >= 3) & (at + 1 < n)]
    firsts = np.concatenate(([0], ends[:-1]))
    starts = np.unique(np.concatenate((firsts, at)))
    return starts, np.isin(starts, np.concatenate((firsts, sure)))


def repair(known: Encoder, text: bytes, starts: np.ndarray, sure: np.ndarray, pieces: list[bytes]) -> int:
    """Encode again round every join that is not sure to agree, and put the ids in place where they differ; how many did."""
    begins = np.flatnonzero(sure)
    ends = np.append(begins[1:], len(starts))
    wide = ends - begins > 1
    places = np.append(starts, len(text))
    windows = [(a, b, text[x:y]) for a, b, x, y in zip(begins[wide].tolist(), ends[wide].tolist(), places[begins[wide]].tolist(), places[ends[wide]].tolist())]
    ids = known.lookup(w for _, _, w in windows)
    repaired = 0
    for a, b, w in windows:
        if b"".join(pieces[a:b]) != ids[w]:
            pieces[a:b] = [ids[w], *[b""] * (b - a - 1)]
            repaired += 1
    return repaired


def require_pattern(tokenizer) -> None:
    """ValueError unless the cuts are safe: the GPT-2 pattern without a prefix space, no normalizer, no added token that takes in white space."""
    split = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    if tokenizer.normalizer is not None or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        raise ValueError("chunk_bpe encodes with byte-level BPE and the GPT-2 pattern only")
    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("chunk_bpe takes no added tokens that depend on white space")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(path: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        require_pattern(known.tokenizer)
        for batch in batches:
            data, ends = B.columns(batch)
            first = np.concatenate(([0], ends[:-1]))
            group = (ends - 1) // GROUP_BYTES
            edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(ends)])) if len(ends) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                raw = data[first[a]:ends[b - 1]]
                upto = ends[a:b] - first[a]
                starts, sure = cuts(raw, upto) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, bool))
                text = raw.tobytes()
                chunks = [text[x:y] for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(text)])]
                ids = known.lookup(chunks)
                pieces = [ids[c] for c in chunks]
                repair(known, text, starts, sure, pieces)
                flat = np.frombuffer(b"".join(pieces), "<u4").astype(np.int32)
                so_far = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)))
                offsets = np.concatenate(([0], so_far[np.searchsorted(starts, upto)]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "ids"])
    return run


def _decoding(path: str) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, begin = token_bytes(path)
        for batch in batches:
            col = batch.column("ids")
            ends = np.asarray(col.offsets).astype(np.int64)
            ids = np.asarray(col.values)
            out = []
            for a in range(0, batch.num_rows, 256):
                b = min(a + 256, batch.num_rows)
                part = ids[ends[a]:ends[b]]
                size = begin[part + 1] - begin[part]
                place = np.concatenate(([0], np.cumsum(size)))
                text = joined[np.repeat(begin[part] - place[:-1], size) + np.arange(place[-1])].tobytes()
                edge = place[ends[a:b + 1] - ends[a]].tolist()
                out += [text[x:y].decode("utf-8", "replace") for x, y in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), col, pa.array(out, pa.string())], ["doc_id", "ids", "text"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the tokenizer encodes it without added special tokens.

    Tokenizers other than byte-level BPE with the GPT-2 pattern are refused. A null or empty text has no ids; null ids of documents stay; each input row
    gives one row; an empty table gives none; other columns are not read.
    """
    return ties.document_bytes(docs, id_col, text_col).mapInArrow(_encoding(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``: the bytes of all tokens, special ones included, as UTF-8 (ill-formed parts replaced)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task has one Python worker."""
    there, back = _encoding(path), _decoding(path)
    return ties.document_bytes(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), "doc_id long, ids array<int>, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds the
vectors of its letters, each permuted (rotated) by its place; a text's vector
bundles (sums) those of its n-grams, and a language's prototype bundles those
of its training texts. A text gets the language whose prototype, less the mean
of all prototypes, has the highest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vector size, n-gram size, and code points with a letter vector of their own (those above share 4,096).
DIMENSIONS, GRAM, OWN = 512, 3, 0x600
UNKNOWN = "und"
_SHARED = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Symbol of each code point: 0 if it is no letter (Unicode categories L*)."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c + 1 if c < OWN else OWN + 1 + c % _SHARED
    return out


@lru_cache(maxsize=2)
def _vectors(dimensions: int) -> list[np.ndarray]:
    """Letter vectors, rotated for each place in an n-gram."""
    v = np.random.default_rng(20).integers(0, 2, (OWN + 1 + _SHARED, dimensions), dtype=np.int8) * 2 - 1
    return [np.roll(v, k, axis=1) for k in range(GRAM)]


_SIZE = OWN + 1 + _SHARED


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams of letters and word gaps (one gap between words and at both ends); none without letters."""
    symbols = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    symbols = np.concatenate(([0], symbols, [0]))
    symbols = symbols[(symbols > 0) | np.concatenate(([True], symbols[:-1] > 0))]
    if len(symbols) < GRAM:
        return np.zeros(0, np.int64)
    code = symbols[:len(symbols) - GRAM + 1]
    for k in range(1, GRAM):
        code = code * _SIZE + symbols[k:len(symbols) - GRAM + 1 + k]
    return code


def bundle(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Sum of the vectors of the given n-grams."""
    total = np.zeros(dimensions, np.float64)
    found, n = np.unique(codes, return_counts=True)
    places = _vectors(dimensions)
    for a in range(0, len(found), 8192):
        rest = found[a:a + 8192]
        bound = None
        for k in reversed(range(GRAM)):
            v = places[GRAM - 1 - k][rest % _SIZE]
            bound = v if bound is None else bound * v
            rest = rest // _SIZE
        total += n[a:a + 8192].astype(np.float32) @ bound.astype(np.float32)
    return total


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each non-null language, from all given rows.

    Tasks bundle their rows; Spark sums the bundles. The driver gets one vector
    a language, so the set of languages (not the corpus) bounds it. No training
    rows: no prototypes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                rows = np.flatnonzero(langs == lang)
                for a in range(0, len(rows), 500):
                    codes = [grams(texts[i]) for i in rows[a:a + 500]]
                    sums[lang] = sums.get(lang, 0) + bundle(np.concatenate(codes), dimensions)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.asarray(v, np.float64))], ["lang", "place", "total"])

    rows = _texts(docs.where(F.col(lang_col).isNotNull()), text_col, F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(run, "lang string, place int, total double").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions
        out.setdefault(r.lang, np.zeros(dimensions))[r.place] = r.total
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds lang_pred and score to all columns of ``docs`` but its own of these names.

    ``und`` with score 0 if the text is null, empty or without letters, or if
    there is no prototype. The language is chosen by the cosine with prototypes
    less their mean; the score is the cosine with the chosen prototype as it is,
    at least 0, so another language's may be higher. Equal cosines go to the
    language first in order. Rows keep their number, nulls in other columns
    stay, an empty table stays empty.
    """
    names = sorted(prototypes)
    raw = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]).reshape(-1, dimensions)
    centred = raw - raw.mean(axis=0) if len(names) > 1 else raw
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def best(text: str) -> tuple[str, float]:
        codes = grams(text)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        v = bundle(codes, dimensions)
        k = int(np.argmax(centred @ v))
        return names[k], float(min(max(raw[k] @ v / max(np.linalg.norm(v), 1e-12), 0.0), 1.0))

    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(t or "") for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    text_at = [f.name for f in fields].index(text_col)
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose fold is not 2 (null ids are not learned from) and predict for all rows."""
    slim = docs.select("doc_id", "text", "lang")
    prototypes = fit(slim.where(fold() != 2))
    return predict(slim.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text"), prototypes) \
        .select("doc_id", "held_out", "lang_pred", "score")

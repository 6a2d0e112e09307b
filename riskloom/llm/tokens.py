"""A bounded per-process cache of encoded chunks over a public tokenizer file."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Chunks remembered in each of two generations by a Python worker.
GENERATION = 350_000


def _of_letters(word: bytes) -> bool:
    """Is the word one pre-token of letters, also in lower case?"""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text.lower().isalpha()


class Encoder:
    """Encodes byte chunks to little-endian uint32 ids; each distinct chunk once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._ends: np.ndarray | None = None

    @property
    def ends(self) -> np.ndarray:
        """For each id whether it ends a pre-token (vocabularies with a mark at the end of words)."""
        if self._ends is None:
            suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
            self._ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self._ends[[i for w, i in self.tokenizer.get_vocab(False).items() if w.endswith(suffix)]] = True
        return self._ends

    def lookup(self, chunks: Iterable[bytes], parts: Callable[[bytes], tuple[bytes, ...]] | None = None) -> dict[bytes, bytes]:
        """A mapping that holds the ids of all given chunks.

        ``parts`` cuts a chunk where the tokenizer surely does, so that chunks
        that differ only in such parts share the work.
        """
        young, old = self.young, self.old
        unknown = []
        for c in set(chunks).difference(young):
            if (ids := old.get(c)) is not None:
                young[c] = ids
            else:
                unknown.append(c)
        if parts:
            cut = [(c, p) for c in unknown if len(p := parts(c)) > 1 or p[0] != c]
            whole = set(unknown).difference(c for c, _ in cut)
            left = whole.union(q for _, p in cut for q in p).difference(young)
            letters = [c for c in left if _of_letters(c)]
            self._encode_joined(letters)
            self._encode(list(left.difference(letters)))
            for c, p in cut:
                young[c] = b"".join([young[q] for q in p])
        else:
            self._encode(unknown)
        if len(young) > GENERATION:
            self.young, self.old = {}, young
        return young

    def _encode(self, unknown: list[bytes]) -> None:
        for a in range(0, len(unknown), 1_000):
            part = unknown[a:a + 1_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)):
                self.young[c] = array("I", e.ids).tobytes()

    def _encode_joined(self, words: list[bytes]) -> None:
        """Words of letters, each one pre-token, a thousand at a time as one text; their last ids part them again."""
        parts = [words[a:a + 1_000] for a in range(0, len(words), 1_000)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
            ids = array("I", e.ids)
            last = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1) * 4
            if len(last) != len(part):
                self._encode(part)
                continue
            raw, start = ids.tobytes(), 0
            for c, end in zip(part, last.tolist()):
                self.young[c] = raw[start:end]
                start = end


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process; it outlives a task."""
    return Encoder(path)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all token byte strings joined, where each id's begins; one longer than the ids) of a byte-level vocabulary."""
    t = encoder(path).tokenizer
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    words = [bytes(letter[c] for c in w) if (w := t.id_to_token(i) or "") and all(c in letter for c in w) else w.encode() for i in range(t.get_vocab_size())]
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))

"""Token ids of whole texts by a public tokenizer file, with each distinct piece encoded once per task.

A worker keeps the tokenizer for its later tasks; what a task has encoded goes with it, as idle workers' memory counts too. Pieces are
known by 64-bit hashes. A task remembers at most CACHE_IDS ids, so that it ever takes one piece for another has a probability of about
1e-6.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from tallyforge.llm.text import ALNUM, NOT_SPACE, Words, ragged

#: Token ids that a task remembers at most; beyond that it forgets all and starts again.
CACHE_IDS = 4_000_000

_WORD = ALNUM.copy()
_WORD[39] = True  # an apostrophe binds to what stands beside it
_ASCII_ALNUM = ALNUM.copy()
_ASCII_ALNUM[128:] = False
#: Letters whose lower case and composed form need no table: ASCII and U+00C0 to U+00FF.
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Encodes texts as `Tokenizer.encode(text, add_special_tokens=False)` does.

    Only for word-level BPE files that drop white space, lower-case, and split runs of letters from runs of punctuation: there the
    ids of a text are those of its pieces in turn. Pieces are cut at ASCII white space, and between ASCII punctuation and a plain
    letter or digit; a stretch with a special token's opening (`<|`) is cut at white space only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = _tokenizer(path)
        self.bytes = {b: c for b, c in enumerate(_byte_letters())}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        hard, tokenize, table = [], self.tokenizer.model.tokenize, self.bytes
        for i, piece in enumerate(pieces):
            if _PLAIN.fullmatch(piece):
                piece = piece.lower()
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(table)
                out[i] = [t.id for t in tokenize(piece)]
            else:
                hard.append(i)
        if hard:
            for i, got in zip(hard, self.tokenizer.encode_batch_fast([pieces[i] for i in hard], add_special_tokens=False), strict=True):
                out[i] = got.ids
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        got = self._ids(pieces)
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        slot = np.arange(len(self.begin), len(self.begin) + len(got))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, flat])
        at = np.searchsorted(self.keys, keys)  # keys are sorted and new
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places in self.keys, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's ids in it."""
        if b"<|" in data.tobytes():
            words = Words(data, offs, NOT_SPACE)
        else:
            words = Words(data, offs, NOT_SPACE, lower=True, cut=_safe_cuts(data))
        keys, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.ids) > CACHE_IDS:
            self._forget()
        new = np.flatnonzero(self._find(keys) < 0)
        if len(new):
            spans = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist(), strict=True)
            self._learn(keys[new], [data[s:e].tobytes().decode("utf-8", "replace") for s, e in spans])
        slot = self.slot[self._find(keys)][back] if len(keys) else np.zeros(0, np.int64)
        size = self.size[slot]
        ids = self.ids[ragged(self.begin[slot], size)]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return ids, total[words.first]


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The character that byte-level BPE files write for each byte: itself if it prints, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _safe_cuts(data: np.ndarray) -> np.ndarray:
    """Between bytes i - 1 and i (entries 0 to len - 1): ASCII punctuation on one side, and a letter or digit on the other."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    word = _WORD[data]
    at = np.flatnonzero(word[1:] != word[:-1]) + 1
    right = word[at]  # the word stands to the right
    near = np.where(right, data[at], data[at - 1])
    far = np.where(right, data[np.minimum(at + 1, len(data) - 1)], data[np.maximum(at - 2, 0)])
    lead, trail = np.where(right, near, far), np.where(right, far, near)
    letter = (lead == 0xC3) & (trail >= 0x80) & (trail != 0x97) & (trail != 0xB7) & (trail < 0xC0)
    cut[at[_ASCII_ALNUM[near] | letter]] = True
    return cut

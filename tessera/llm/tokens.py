"""Token ids of whole texts by a public tokenizer file, each distinct stretch between spaces encoded once.

Both vocabularies split a text into pieces before merging, and no piece crosses from a visible character to
the space after it, nor from a letter or digit to a mark. So a text may be cut before a space that starts or ends a run of
white space, and before a full stop or comma after a letter, without changing its ids, and the ids of each stretch can
be kept. Runs of three or more white-space characters may have such a cut inside; texts that hold one are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT

#: Texts that are encoded whole: with a run of three white-space characters or two at the end, a space before a
#: line's end, or a zero.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_ODD = rf"{_SPACE}{{3}}| \n|\x00|{_SPACE}{{2}}$"
#: Texts with a full stop or comma before a space that follows no letter or digit.
_ODD_STOP = r"(?:^|[^\pL\pN])[,.][ \n]"
#: Stretches that a worker keeps; beyond this it forgets all and goes on, which changes no result.
KEEP = 1_500_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) -> ids of all texts in one array, and the number of ids of each."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size < 1 << 16 else np.uint32
        #: White space has no id of its own in a vocabulary that ends words by a mark.
        self.drops_space = self.tokenizer.encode(" ", add_special_tokens=False).ids == []
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.dtype), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, units: list[bytes]) -> None:
        if len(self.index) + len(units) > self.keep:
            self._forget()
        if self.drops_space:
            spaced = [u.decode() for u in units]
        else:
            spaced = [(u[1:] if u[:1] == b"\0" else u if u[:1] == b"\n" else b" " + u).decode() for u in units]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.index), int(lengths.sum())
        self.index.update(zip(units, range(first, first + len(units))))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.dtype, total)
        self.start[first : first + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(units)] = lengths
        self.used += total

    def _stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts one after another, and how many each text has. A full stop or comma after a letter
        or digit and before a space is a stretch of its own. A zero marks stretches that no space stands before."""
        mark = "" if self.drops_space else "\0"
        plain = pc.replace_substring(texts, "\n", " " if self.drops_space else " \n")
        cut = plain
        for stop in (", ", ". "):
            cut = pc.replace_substring(cut, stop, f" {mark}{stop}")
        odd = pc.match_substring_regex(texts, _ODD_STOP)
        if pc.any(odd).as_py():
            cut = pc.if_else(odd, plain, cut)
        if mark:
            cut = pc.binary_join_element_wise(pa.scalar(mark, pa.large_string()), cut, pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(cut, " ")
        return pc.list_flatten(cut), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).fill_null("")
        n_texts, whole = len(texts), {}
        if not n_texts:
            return np.empty(0, self.dtype), np.zeros(0, np.int64)
        if not self.drops_space:
            odd = pc.match_substring_regex(texts, _ODD)
            if pc.any(odd).as_py():
                whole = {k: self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
                texts = pc.if_else(odd, "", texts)
        units, n_units = self._stretches(texts)
        coded = units.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        slots = list(map(self.index.get, words))
        missing = [i for i, s in enumerate(slots) if s is None]
        if missing:
            known = len(self.index)
            self._learn([words[i] for i in missing])
            if len(self.index) == known + len(missing):
                for i, k in zip(missing, range(known, len(self.index))):
                    slots[i] = k
            else:  # it had to forget the others
                keep, self.keep = self.keep, 1 << 62
                self._learn([w for w in words if w not in self.index])
                self.keep = keep
                slots = list(map(self.index.__getitem__, words))
        slot = np.array(slots, np.int64)
        at = coded.indices.to_numpy()
        lengths = self.length[slot][at]
        total = np.cumsum(lengths)
        n = int(total[-1]) if len(total) else 0
        shift = self.start[slot][at] - (total - lengths)
        if self.used + n < 1 << 31:
            shift = shift.astype(np.int32)
        ids = self.flat[np.repeat(shift, lengths) + np.arange(n, dtype=shift.dtype)]
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(n_units)])]
        if whole:
            parts = [np.array(whole[k], self.dtype) if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(n_texts)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(bounds)


def encoder(path: str) -> Encoder:
    """One for each worker process and file, in KEPT under the file's path."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]

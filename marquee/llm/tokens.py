"""Token ids by the tokenizers library, memoised by piece.

A text is cut at places where the tokenizer's own splitter always cuts, each distinct
piece is encoded once by the library, and a text's ids are the pieces' ids joined.
Where such cuts are not certain (runs of white space), larger pieces go to the library.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Pieces that make a generation full. The memo holds two: the last one, and of the one before what hasn't been met since.
MEMO = 300_000
#: Characters of texts that are cut and joined at once; a longer text goes alone.
AT_ONCE = 2_000_000
_STOPS = (".", ",")
#: Letters; without the one whose lower case ends in a combining mark.
_LATIN = frozenset(c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130")
#: All white space but blank and line feed.
_OTHER_SPACES = tuple(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")
_LOADED: dict[str, Memo] = {}
_PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Byte (as a character) to the character that stands for it in byte-level vocabularies.
_BYTES = dict(zip([*_PLAIN, *(b for b in range(256) if b not in _PLAIN)], [*_PLAIN, *range(256, 512)], strict=False))


def _shown(word: str) -> str:
    """A word as byte-level vocabularies spell it."""
    return word.encode().decode("latin-1").translate(_BYTES) if not word.isascii() else word.replace(" ", "\u0120")


class Memo(dict):
    """Piece to its ids as little-endian unsigned integers (``dtype``): 16 bits where the vocabulary fits, else 32."""

    def __init__(self, path: str) -> None:
        self.older: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lib.no_truncation()
        self.width, self.code = (2, "H") if self.lib.get_vocab_size() <= 1 << 16 else (4, "I")
        self.dtype = f"<u{self.width}"
        #: whether white space yields ids, so that a word takes the one space before it along
        self.keeps_space = bool(self.lib.encode(" \n", add_special_tokens=False).ids)
        self.cut = "\0" if self.keeps_space else " "
        #: stands between pieces that are encoded in one call, a piece of its own to the splitter
        self.between = "\n" if self.keeps_space else " 7 "
        self.mark = self.lib.encode(self.between, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the mark between pieces must be one token of the vocabulary")
        self.model = self.lib.model
        #: whether the model alone gives a word's ids, as it does for byte-level vocabularies
        words = ("word", "caf\u00e9", "\u0161\u00f8", *([" word", " \u00c9cole"] if self.keeps_space else []))
        self.direct = sys.byteorder == "little" and isinstance(self.model, BPE) and all([t.id for t in self.model.tokenize(_shown(w))] == self.lib.encode(w, add_special_tokens=False).ids for w in words)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``width`` bytes each."""
        if self.keeps_space and any(self.cut in t for t in texts):  # no place for cuts: one by one, such texts whole
            return [self._whole(t) if self.cut in t else self.texts([t])[0] for t in texts]
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < AT_ONCE:
                size += len(texts[end])
                end += 1
            out += self._joined([self._cut(t) for t in texts[at:end]])
            at = end
        return out

    def _joined(self, cut: list[str]) -> list[bytes]:
        """The ids of texts whose pieces stand between ``self.cut``."""
        coded = pc.split_pattern(pa.array([self.cut.join(cut)], pa.large_string()), self.cut).flatten().dictionary_encode()
        listed = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
        pieces, index = pc.binary_join(listed, pa.scalar(self.cut, pa.large_string()))[0].as_py().split(self.cut), coded.indices.to_numpy()
        if len(self) > MEMO:
            self.older = None  # let go before the copy
            self.older = dict(self)
            self.clear()
        known = list(map(self.get, pieces))
        new, older = [], self.older
        for k in [k for k, data in enumerate(known) if data is None]:
            data = older.pop(pieces[k], None)
            if data is None:
                new.append(k)
            else:
                known[k] = self[pieces[k]] = data
        self._learn([pieces[k] for k in new])
        for k in new:
            known[k] = self[pieces[k]]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        ends = np.cumsum(each)
        ids = np.frombuffer(b"".join(known), self.dtype)[np.repeat(starts[index] - ends + each, each) + np.arange(ends[-1])]
        last = np.cumsum([t.count(self.cut) + 1 for t in cut])
        bounds = [0, *ends[last - 1].tolist()]
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Puts in the ids of pieces: letters by the library's model, others by all its steps."""
        stopped, rest, model = [], set(), self.model
        for p in new:
            word = p
            if p.endswith(_STOPS) and p[-2:-1] in _LATIN:  # the stop is a piece of its own
                stopped.append(p)
                word = p[:-1]
            if word in self:
                continue
            letters = word[1:] if self.keeps_space and word[:1] == " " else word
            if self.direct and len(letters) <= 200 and (letters.isalpha() if letters.isascii() else _LATIN.issuperset(letters)) and (self.keeps_space or letters == letters.lower()):
                self[word] = array(self.code, [t.id for t in model.tokenize(_shown(word))]).tobytes()
            else:
                rest.add(word)
        self._by_library(rest.union(_STOPS).difference(self) if stopped else rest)
        for p in stopped:
            self[p] = self[p[:-1]] + self[p[-1]]

    def _by_library(self, new: set[str]) -> None:
        mark = self.between.strip(" ")
        # white space at an end would run together with the mark
        bare = {p: p[1:] if p[:1] == " " else p for p in new}
        alone = [p for p, b in bare.items() if mark in p or len(p) > 200 or not b or b[0].isspace() or b[-1].isspace()]
        for p in alone:
            self[p] = self._whole(p)
        joined = list(new.difference(alone))
        for at in range(0, len(joined), 500):
            part = joined[at : at + 500]
            ids = np.array(self.lib.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            if len(ends) != len(part):  # a piece holds the mark's id: one by one
                for p in part:
                    self[p] = self._whole(p)
                continue
            data, at, w = ids.tobytes(), 0, self.width
            for p, end in zip(part, ends, strict=True):
                self[p] = data[w * at : w * end]
                at = end + 1

    def _cut(self, text: str) -> str:
        """``text`` with ``self.cut`` between its pieces; it stands in none of them."""
        if not self.keeps_space:  # white space only ends words, and case doesn't count
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        runs = any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or text[:1].isspace() or text[-1:].isspace()
        if runs or any(x in text for x in _OTHER_SPACES):
            # a cut before a space is certain where neither neighbour of that space is white space
            return re.sub(r"(?<=\S)(?= \S)", self.cut, text)
        return text.replace("\n", f"{self.cut}\n{self.cut}").replace(" ", f"{self.cut} ")


def give_back() -> None:
    """Returns free memory of Arrow and the C library to the system; else a worker keeps what its largest part took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def memo(path: str) -> Memo:
    """The worker's memo for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Memo(path)
    return _LOADED[path]

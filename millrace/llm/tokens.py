"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

Texts are first cut where that kind of tokenizer cuts them, all texts of a slice at once; each piece
is encoded by the library's model when a task first meets it and then looked up. Texts with an apostrophe, or
with characters whose class may differ between Unicode versions, go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from millrace.llm.wordbatch import span_hashes, text_bytes

_KNOWN = 0x2E80
#: Unicode white space below _KNOWN
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([_UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], _OTHER) for i in range(_KNOWN)] + [_UNSURE], np.uint8)
    out[_WHITE] = _SPACE
    out[0x27] = _UNSURE
    return out


def _shown() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype(np.uint32)


_SHOWN = _shown()


class PieceTable:
    """Piece hash -> its ids, by open addressing; emptied when half full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.first, self.length, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (key & mask).astype(np.int64)
        at = self.at[slot]
        at = np.where(self.key[slot] == key, at, np.where(at < 0, -1, -2))
        todo = np.flatnonzero(at == -2)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            now = self.at[slot[todo]]
            now = np.where(self.key[slot[todo]] == key[todo], now, np.where(now < 0, -1, -2))
            at[todo] = now
            todo = todo[now == -2]
        return at

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New entries; keys are distinct and not in the table."""
        if self.n + len(keys) > len(self.first):
            more = max(len(self.first), len(keys))
            self.first, self.length = np.append(self.first, np.zeros(more, np.int32)), np.append(self.length, np.zeros(more, np.int32))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + len(ids)] = ids
        entry = np.arange(self.n, self.n + len(keys))
        self.first[entry] = self.used + np.cumsum(lengths) - lengths
        self.length[entry] = lengths
        self.used += len(ids)
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.at[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.at[slot[put]], self.key[slot[put]] = entry[put], keys[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & mask


class TextEncoder:
    """Ids of all texts of a column; one per Python worker and vocabulary file."""

    _made: dict[str, TextEncoder] = {}

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        cut = self.library.pre_tokenizer
        if type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or not cut.use_regex or self.library.normalizer:
            raise ValueError("the vocabulary isn't of the byte-level kind")
        self.kind = _classes()
        self.table = PieceTable()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode(t, add_special_tokens=False).ids for t in texts]

    def _pieces(self, points: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces start: a run of letters, of numbers or of other characters, with one blank
        before it; of white space before such a run, all but its last character, and that by itself
        unless it is that blank; white space at the end of a text as a whole."""
        n = len(points)
        head = np.zeros(n + 1, bool)
        head[at] = True
        new = head[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        white = kind == _SPACE
        blank_before = np.zeros(n, bool)
        blank_before[1:] = (points[:-1] == 32) & ~head[1:-1]
        last = np.zeros(n, bool)
        last[:-1] = white[:-1] & ~white[1:] & ~head[1:-1]
        return np.flatnonzero(np.where(white, new | last, new & ~blank_before))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and where each text's begin; null counts as empty."""
        data, at = text_bytes(column)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        char = np.flatnonzero((data & 0xC0) != 0x80)
        char_at = np.searchsorted(char, at)
        kind = self.kind[np.minimum(points, _KNOWN)]
        start = self._pieces(points, kind, char_at)
        text = np.searchsorted(char_at, start, "right") - 1
        unsure = np.add.reduceat(np.append(kind == _UNSURE, False).astype(np.int64), char_at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
        unsure = (unsure > 0) & (np.diff(char_at) > 0)
        begin = char[start] if len(start) else start
        end = np.append(begin[1:], len(data))
        if unsure.any():
            sure = ~unsure[text]
            begin, end, text = begin[sure], end[sure], text[sure]
        key = span_hashes(data, begin, end)
        entry = self.table.find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one = np.unique(key[missing], return_index=True)
            if self.table.n + len(new) > 1 << (self.table.bits - 1):
                self.table.clear()
                new, one = np.unique(key, return_index=True)
                missing = np.arange(len(key))
            self._learn(raw, new, begin[missing[one]], end[missing[one]])
            entry = self.table.find(key) if len(missing) == len(key) else np.where(entry < 0, -1, entry)
            if len(missing) < len(key):
                entry[missing] = self.table.find(key[missing])
        length = self.table.length[entry].astype(np.int64)
        index = np.arange(int(length.sum())) + np.repeat(self.table.first[entry] - (np.cumsum(length) - length), length)
        ids = self.table.ids[index]
        counts = np.bincount(text, weights=length, minlength=len(at) - 1).astype(np.int64)
        if unsure.any():
            which = np.flatnonzero(unsure)
            whole = self.plain([raw[at[d] : at[d + 1]].decode() for d in which])
            starts = np.append(0, np.cumsum(counts))
            parts = np.split(ids, starts[1:-1])
            for d, found in zip(which, whole, strict=True):
                parts[d], counts[d] = np.array(found, np.uint32), len(found)
            ids = np.concatenate(parts) if parts else ids
        return ids, np.append(0, np.cumsum(counts))

    def _learn(self, raw: bytes, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """The library's model takes one piece at a time, each byte as the character that stands for it."""
        length = end - begin
        at = np.append(0, np.cumsum(length))
        index = np.arange(at[-1]) + np.repeat(begin - at[:-1], length)
        shown = _SHOWN[np.frombuffer(raw, np.uint8)[index]].tobytes().decode("utf-32-le")
        model, ids, counts = self.library.model.tokenize, [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            found = model(shown[a:b])
            counts.append(len(found))
            ids += [x.id for x in found]
        self.table.add(keys, np.array(ids, np.uint32), np.array(counts, np.int64))

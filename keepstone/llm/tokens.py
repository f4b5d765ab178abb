"""Token ids of whole texts by a public tokenizer file.

The vocabulary's split pattern never matches across white space and no normaliser step reaches across it, so the
ids of a text are those of its white-space separated words, one after another; a full stop or comma between a letter
or digit and white space is a unit by itself. Each Python worker keeps the ids of the words that it has met in a table
by 64-bit hash. Words of a batch are cut, hashed and looked up as arrays; new ones go through the library together.
A word of letters is one unit of the split pattern, whose last id alone stands for a word's end, so many such words
are encoded as one string and told apart afterwards. All other words are encoded one by one.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Id appended to every document.
END_ID = 1
END_BYTES = np.asarray([END_ID], "<u4").tobytes()
#: Slots of the table (a power of two); it starts anew when half of them are taken, and a text with more
#: distinct words than that is encoded in parts, which costs time only.
SLOTS = 1 << 21
#: Words beyond this length are encoded each time they are met.
LONGEST = 64
#: Words of letters that are encoded as one string.
JOINED = 256
#: What ends the last id of a unit in the vocabulary.
UNIT_END = "</w>"
#: Letters beyond this are left to the library, whose tables may be of another age.
PLAIN_LETTERS = "Ԁ"


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK = _byte_set(b" \t\n\r\x0b\x0c")
_STOP = _byte_set(b".,")
_PLAIN = _byte_set(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Second bytes of the letters of Latin-1 behind 0xC3 (all but the signs for times and divided by).
_LATIN = _byte_set(bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random word for each place in a word and each byte; sums of them are the hashes.
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, LONGEST * 256, np.uint64)


class WordTable:
    """Open addressing: hash to a run of ids in a pool."""

    def __init__(self, slots: int):
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.full(self.slots, -1, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.filled = 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is new."""
        slot = self._slot(h)
        out = self.entry[slot]
        todo = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self.slots - 1)
            e = self.entry[slot]
            hit = self.keys[slot] == h[todo]
            out[todo] = e
            more = ~hit & (e >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
        """New hashes (distinct) with their ids; returns their entries."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used + len(h) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.filled : self.filled + len(flat)] = flat
        entries = np.arange(self.used, self.used + len(h), dtype=np.int32)
        self.at[entries] = self.filled + np.cumsum(sizes) - sizes
        self.size[entries] = sizes
        self.filled += len(flat)
        self.used += len(h)
        todo, slot = np.arange(len(h)), self._slot(h)
        while len(todo):
            free = self.entry[slot] < 0
            # Several may want one free slot: the last written keeps it, the others go on.
            self.entry[slot[free]] = entries[todo[free]]
            won = self.entry[slot] == entries[todo]
            self.keys[slot[won]] = h[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (self.slots - 1)
        return entries


class WordEncoder:
    """Texts (UTF-8 bytes) to ids."""

    def __init__(self, path: str, slots: int = SLOTS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(UNIT_END)]] = True
        self.table = WordTable(slots)

    def _whole(self, words: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, np.uint32) for e in found]

    def _joined(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that consist of letters."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[np.ndarray] = []
        encoded = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.asarray(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            # One end for each word, unless a letter to us isn't one to the library.
            out += np.split(ids, last[:-1]) if len(last) == len(group) else self._whole(group)
        return out

    @staticmethod
    def _is_letters(word: bytes) -> bool:
        if word.isascii():
            return word.isalpha()
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower()
        return text.isalpha() and max(text) < PLAIN_LETTERS

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        letters = [i for i, w in enumerate(words) if self._is_letters(w)]
        is_letters = set(letters)
        rest = [i for i in range(len(words)) if i not in is_letters]
        out: list[np.ndarray] = [None] * len(words)
        for at, found in ((letters, self._joined([words[i] for i in letters])), (rest, self._whole([words[i] for i in rest]))):
            for i, ids in zip(at, found, strict=True):
                out[i] = ids
        return out

    def encode_flat(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all whole texts one after another, and where each text's ids end; null and blank texts have none."""
        odd = {i: self._whole([t])[0] for i, t in enumerate(texts) if t and b"<|" in t}  # may name special tokens
        texts = [b"" if t is None or i in odd else t for i, t in enumerate(texts)]
        ids, ends = self._words(texts)
        if odd:
            parts = np.split(ids, ends[:-1])
            for i, found in odd.items():
                parts[i] = found
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n" + b"\n".join(texts) + b"\n"
        data = _LOWER[np.frombuffer(raw, np.uint8)]  # the normaliser lowers as well
        blank = _BLANK[data]
        letter = _PLAIN[data]
        letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
        stop = np.zeros(len(data), bool)
        stop[1:-1] = _STOP[data[1:-1]] & blank[2:] & letter[:-2]
        inside = ~blank
        starts = np.flatnonzero(inside[1:-1] & (blank[:-2] | stop[1:-1])) + 1
        stops = np.flatnonzero(inside[1:-1] & (blank[2:] | stop[2:])) + 2
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        word_ends = np.searchsorted(starts, text_ends + 1)
        if not len(starts):
            return np.zeros(0, np.uint32), word_ends
        sizes = (stops - starts).astype(np.int32)
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        place = np.arange(first[-1] + sizes[-1], dtype=np.int32) - np.repeat(first, sizes)
        code = ((place & (LONGEST - 1)) << 8) | data[inside]
        hashes = np.add.reduceat(_RANDOM[code], first) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ids, size = self._ids(raw, starts, stops, sizes, hashes)
        return ids, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[word_ends]

    def _ids(self, raw: bytes, starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each word has."""
        entry = self.table.find(hashes)
        entry[sizes > LONGEST] = -1
        new = np.flatnonzero(entry < 0)
        extra: list[np.ndarray] = []
        if len(new):
            if 2 * (self.table.used + len(new)) > self.table.slots:
                self.table.clear()
                entry[:], new = -1, np.arange(len(entry))
            short = new[sizes[new] <= LONGEST]
            keys, where, back = np.unique(hashes[short], return_index=True, return_inverse=True)
            half = self.table.slots // 2
            if self.table.used + len(keys) > half:  # more than the table holds: in parts that fit an empty one
                cuts = [slice(i, i + half) for i in range(0, len(sizes), half)]
                parts = [self._ids(raw, starts[c], stops[c], sizes[c], hashes[c]) for c in cuts]
                return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            words = [raw[a:b].lower() for a, b in zip(starts[short[where]].tolist(), stops[short[where]].tolist(), strict=True)]
            entry[short] = self.table.add(keys, self._learn(words))[back]
            long = new[sizes[new] > LONGEST]
            extra = self._whole([raw[starts[i] : stops[i]].lower() for i in long])
        at, size = self.table.at[np.maximum(entry, 0)], self.table.size[np.maximum(entry, 0)]
        pool = self.table.pool
        if extra:
            long = np.flatnonzero(sizes > LONGEST)
            count = np.fromiter(map(len, extra), np.int32, len(extra))
            at[long], size[long] = len(pool) + np.cumsum(count) - count, count
            pool = np.concatenate([pool, *extra])
        end = np.cumsum(size, dtype=np.int64)
        return pool[np.repeat(at - (end - size), size) + np.arange(end[-1])], size

    def encode_batch(self, texts: list[bytes | None], dtype: str = "<u4") -> list[bytes]:
        """Ids of each whole text and the end id, as bytes."""
        ids, ends = self.encode_flat(texts)
        data, width = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
        last = np.asarray([END_ID], dtype).tobytes()
        bounds = [0, *(ends * width).tolist()]
        return [data[a:b] + last for a, b in zip(bounds, bounds[1:], strict=False)]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker; it outlives a task. Its table takes some 60 MB at most."""
    return WordEncoder(path)


@functools.cache
def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, the end id counted."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return max(END_ID, *Tokenizer.from_file(path).get_vocab().values()) + 1

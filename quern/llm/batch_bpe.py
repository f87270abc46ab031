"""Byte-level BPE ids of many texts at once, as numpy and Arrow arrays.

Pre-tokens of Latin-1 texts follow from the class of each byte and of its
neighbours, Arrow tells the distinct ones apart by their bytes, and the merges
run over all distinct pre-tokens of a slice together: in every round each of
them merges its pair of lowest rank, leftmost first, which is the order of the
tokenizers library. Nothing is remembered between slices, and nothing here
makes a Python object per pre-token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .bpe import LETTERS, NUMBERS, SPACES, Vocabulary
from .words import PAD, text_bytes

#: Bytes of text that are encoded together; a longer text is a slice of its own.
SLICE = 4 << 20
#: Bytes of a pre-token up to which it is merged here; the library merges longer ones, where rounds would be many.
LONG = 64

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_NONE = np.int64(1 << 62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """The class of each Latin-1 character."""
    classes = [(re.compile(f"[{c}]"), k) for c, k in ((SPACES, _SPACE), (LETTERS, _LETTER), (NUMBERS, _NUMBER))]
    return np.array([next((k for p, k in classes if p.match(chr(c))), _OTHER) for c in range(256)], np.uint8)


_KINDS = _kinds()


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``BYTE_PATTERN`` start in the UTF-8 bytes of Latin-1 texts (padded, as ``text_bytes`` gives them)."""
    n = int(offsets[-1])
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:n] >= 0xC0)
    kind[lead] = kind[lead + 1] = _KINDS[((data[lead] & 3) << 6) | (data[lead + 1] & 63)]
    first = np.zeros(n + PAD, bool)
    first[offsets] = True
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else goes alone, or with it if it is a space.
    space = kind == _SPACE
    after = np.flatnonzero(space[: n - 1] & ~space[1:n] & ~first[1:n]) + 1
    starts[np.where(data[after - 1] < 0x80, after - 1, after - 2)] = True
    starts[after[data[after - 1] == 32]] = False
    # Contractions, where a pre-token starts with the apostrophe.
    at = np.flatnonzero((data[:n] == 39) & starts[:n])
    at = at[~first[at + 1]]
    a, b = data[at + 1], np.where(first[at + 2], 0, data[at + 2])
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    starts[at[one | two] + 1] = False
    starts[at[one] + 2] = starts[at[two] + 3] = True
    return np.flatnonzero(starts[:n])


class Merges:
    """The merges of a byte-level vocabulary as arrays."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        ids = vocab.ids
        self.first = np.array([ids[c] for c in vocab.byte_characters], np.int32)
        pairs = [(rank, ids[a], ids[b], ids[a + b]) for (a, b), rank in vocab.ranks.items()]
        table = np.array(pairs, np.int64).reshape(-1, 4)
        self.made = np.zeros(int(table[:, 0].max(initial=0)) + 1, np.int32)
        self.made[table[:, 0]] = table[:, 3]
        self.shift = np.uint64(64 - max(8, int(4 * len(pairs) + 1).bit_length()))
        self.keys = np.full((1 << (64 - int(self.shift))) + len(pairs) + 1, -1, np.int64)
        self.values = np.zeros(len(self.keys), np.int64)
        keys = table[:, 1] << 32 | table[:, 2]
        for key, slot, rank in zip(keys.tolist(), self._slots(keys).tolist(), table[:, 0].tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot] = key, rank
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self.ranks(self.first[a], self.first[b])

    @staticmethod
    def fits(vocab: Vocabulary) -> bool:
        """Whether the file asks for nothing but plain merges of byte characters."""
        return vocab.plain and all(c in vocab.ids for c in vocab.byte_characters)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 where they do not merge."""
        keys = a.astype(np.int64) << 32 | b
        out = np.full(len(keys), -1, np.int64)
        slots, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            found = self.keys[slots]
            hit = found == keys
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (found >= 0)
            open_, keys, slots = open_[more], keys[more], slots[more] + 1
        return out

    def ids(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens given as bytes one after another and none empty: all ids and how many each has."""
        symbols, kept = self.first[raw], np.ones(len(raw), bool)
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # Rank and place in one number, so that the smallest is the leftmost pair of lowest rank.
        place = np.arange(len(raw), dtype=np.int32)
        keys = np.full(len(raw), _NONE)
        keys[:-1] = np.where(word[1:] == word[:-1], self._key(self.byte_pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]], place[:-1]), _NONE)
        current, left = symbols.copy(), sizes
        while len(left):
            starts = np.cumsum(left) - left
            best = np.minimum.reduceat(keys, starts)
            live = best < _NONE
            all_best = np.repeat(best, left)
            stay = all_best < _NONE
            at = np.flatnonzero((keys == all_best) & stay)
            new = self.made[best[live] >> 32]
            current[at] = symbols[place[at]] = new
            kept[place[at + 1]] = stay[at + 1] = False
            right = at + 2 < (starts + left)[live]
            keys[at] = _NONE
            i = at[right]
            keys[i] = self._key(self.ranks(new[right], current[i + 2]), place[i])
            before = at > starts[live]
            i = at[before] - 1
            keys[i] = self._key(self.ranks(current[i], new[before]), place[i])
            current, keys, place, left = current[stay], keys[stay], place[stay], left[live] - 1
        return symbols[kept], np.bincount(word[kept], minlength=len(sizes))

    @staticmethod
    def _key(ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(ranks >= 0, ranks << 32 | place, _NONE)

    def encoded(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any distinct pre-tokens: bytes (little-endian, 32 bits each) and the offset of each."""
        _, offsets, data = words.buffers()
        at = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
        raw, sizes = np.frombuffer(data, np.uint8)[at[0] : at[-1]], np.diff(at)
        short = sizes <= LONG
        flat, short_counts = self.ids(raw[np.repeat(short, sizes)], sizes[short])
        counts = np.zeros(len(words), np.int64)
        counts[short] = short_counts
        longer = {i: self.vocab.merged_ids(words[i].as_py().decode()) for i in np.flatnonzero(~short).tolist()}
        for i, ids in longer.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), "<u4")
        out[np.repeat(short, counts)] = flat
        for i, ids in longer.items():
            out[ends[i] - counts[i] : ends[i]] = ids
        return out.view(np.uint8), np.concatenate([[0], ends * 4])


class BatchEncoder:
    """Texts -> their ids as bytes, each closed by ``stop``; ``plainly`` encodes the texts that are not Latin-1 or hold special strings."""

    def __init__(self, vocab: Vocabulary, plainly: Callable[[str], bytes], stop: bytes):
        self.plainly, self.stop = plainly, stop
        self.special = [x.encode() for x in vocab.special]
        self.merges = Merges(vocab) if Merges.fits(vocab) else None

    def encode(self, texts: pa.Array) -> Iterator[memoryview | bytes]:
        """The ids of every text in order; null counts as empty."""
        if self.merges is None:
            yield from (self.plainly(x.as_py() or "") + self.stop for x in texts)
            return
        data, offsets = text_bytes(texts)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
            yield from self._slice(data[offsets[row] : offsets[end] + PAD], offsets[row : end + 1] - offsets[row], texts[row:end])
            row = end

    def _slice(self, data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> Iterator[memoryview | bytes]:
        n = int(offsets[-1])
        apart = np.zeros(len(texts), bool)
        apart[np.searchsorted(offsets, np.flatnonzero(data[:n] >= 0xC4), "right") - 1] = True
        whole = data[:n].tobytes()
        for special in self.special:
            at = whole.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                apart[row] = True
                at = whole.find(special, max(int(offsets[row + 1]) - len(special) + 1, at + 1))
        if apart.any():
            bytes_kept = np.repeat(~apart, np.diff(offsets))
            data = np.concatenate([data[:n][bytes_kept], np.zeros(PAD, np.uint8)])
            offsets = np.concatenate([[0], np.cumsum(np.where(apart, 0, np.diff(offsets)))])
        ids, bounds = self._ids(data, offsets)
        for i, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield self.plainly(texts[i].as_py()) + self.stop if apart[i] else ids[start:stop]

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, list[int]]:
        """The ids of Latin-1 texts with their ends, and the offset of each text's."""
        n = int(offsets[-1])
        if not n:
            return memoryview(self.stop * (len(offsets) - 1)), (np.arange(len(offsets)) * len(self.stop)).tolist()
        starts = pretoken_starts(data, offsets)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)])
        distinct = spans.dictionary_encode()
        ids, at = self.merges.encoded(distinct.dictionary)
        ids, at = np.concatenate([ids, np.frombuffer(self.stop, np.uint8)]), np.append(at, len(ids) + len(self.stop))
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(ids)])
        before = np.searchsorted(starts, offsets)
        order = np.insert(distinct.indices.to_numpy(), before[1:], len(at) - 2)
        taken = table.take(pa.array(order))
        _, ends, out = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1, taken.offset * 8)
        return memoryview(out), ends[before + np.arange(len(offsets))].tolist()

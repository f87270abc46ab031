"""Packing by minimum bin slack.

A document's ids are cut into pieces of ``LENGTH`` and a rest. What matters for
packing is only how many pieces there are of each length: at most ``LENGTH``
numbers, whatever the corpus. On these counts each window starts with the
longest length that is left, and a subset-sum dynamic programme over bit sets
finds the multiset of remaining lengths that comes closest to filling it; going
back through the bit sets gives how many pieces of each length it takes. The
same window is repeated while the counts last, so at most one programme runs
per length that runs out. Pieces then take their places by rank within their
length; ranks come from counts per task, never from a sort of all pieces.
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batch_bpe import BatchEncoder
from .bpe import Vocabulary, vocabulary
from .shared import checkpoint, documents

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 800_000
LENGTH = 1024
END = 0

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


class IdEncoder(dict):
    """Pre-token -> its ids as bytes (little-endian, 32 bits each), merged by the tokenizers library and remembered.

    It takes the texts that ``BatchEncoder`` leaves to it.

    Pre-tokens have no bound, so a run of millions of spaces is one of them and
    the library's merges take it as any other; long ones are not remembered.
    """

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, pretoken: str) -> bytes:
        ids = _bytes(self.vocab.merged_ids(pretoken))
        if len(pretoken) <= 64:
            self[pretoken] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as the library gives them, special strings included."""
        out: list[bytes] = []
        for part in self.vocab.parts(text):
            if part in self.vocab.special:
                out.append(_bytes([self.vocab.special[part]]))
            elif part:
                out += map(self.__getitem__, self.vocab.pretokens(part))
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(out)


def _bytes(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


_ENCODERS: dict[tuple[str, int], BatchEncoder] = {}


def _pieces(name: str, length: int, end: int):
    def rows(batches):
        from pyspark import TaskContext

        if (name, end) not in _ENCODERS:
            vocab = vocabulary(name)
            _ENCODERS[name, end] = BatchEncoder(vocab, IdEncoder(vocab).encode, _bytes([end]))
        encode = _ENCODERS[name, end].encode
        task = TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    size = len(piece) // 4
                    for column, value in zip(out, (doc, at // 4, size, zlib.crc32(piece), len(ids) // 4, task, seen[size]), strict=True):
                        column.append(value)
                    seen[size] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return rows


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` closest, not over it.

    Bit ``s`` of a set is on if the lengths so far can sum to ``s``. Counts are
    taken in doubling bundles, so a length costs a few shifts; going back, a
    bundle was used where the sum is out of reach without it.
    """
    reach, full = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for size in sorted((s for s, n in counts.items() if n > 0 and s <= capacity), reverse=True):
        left, bundle = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(bundle, left)
            steps.append((reach, size, take))
            reach |= (reach << (size * take)) & full
            left -= take
            bundle *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            total -= size * take
            used[size] = used.get(size, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Windows as (times, pieces per length) that use up all counts."""
    left = {s: n for s, n in counts.items() if n > 0}
    windows = []
    while left:
        longest = max(left)
        rest = {s: n - (s == longest) for s, n in left.items()}
        used = fill_window(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        windows.append((times, used))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return windows


def _seats(windows: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, in order of rank: first rank, pieces per window, first sequence, offset in the window."""
    seats: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, used in windows:
        offset = 0
        for size in sorted(used, reverse=True):
            seats.setdefault(size, []).append((ranks.get(size, 0), used[size], sequence, offset))
            ranks[size] = ranks.get(size, 0) + times * used[size]
            offset += size * used[size]
        sequence += times
    return seats


def pack_documents(docs: DataFrame, name: str = VOCABULARY, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Null and empty texts have one piece, their end id. A
    repeated or null doc_id row is packed like any other; no rows give no rows.
    Pieces of one length take their places in the order of tasks and rows. The
    ids are the tokenizers library's for ``name`` without added tokens, then
    ``end``. Other columns are ignored. What reaches the driver is one count per
    length (at most ``length`` rows), and the plan made of it has at most
    ``length`` windows of at most 45 different lengths.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpoint(texts.mapInArrow(_pieces(name, length, end), _PIECE))
    per_task = checkpoint(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    seats = _seats(plan(counts, length))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))

    def seat(batches):
        table = {size: np.array(rows, np.int64).T for size, rows in seats.items()}
        for batch in batches:
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                firsts, pers, sequences, offsets = table[size]
                at = np.searchsorted(firsts, ranks[own], "right") - 1
                window, k = np.divmod(ranks[own] - firsts[at], pers[at])
                sequence[own], offset[own] = sequences[at] + window, offsets[at] + k * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return ranked.mapInArrow(seat, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))

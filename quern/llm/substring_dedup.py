"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

The corpus is dealt into blocks of about ``BLOCK_BYTES`` of text. Each block is
a set of documents to factor and, for all others, a piece of the reference:

1. Phrase keys. Every window of ``WINDOW`` words has the smallest of its
   ``GRAM``-word hashes as its key, so equal windows have equal keys. A block
   sends its distinct keys, once each, to the key index and gets back one bit
   per key: does another block hold it too? Most text ends here.
2. Reference index. The windows under shared keys go, once per block with the
   smallest doc_id and the word where they start there, to the slice of the
   index that their hash falls in. The index answers with the block and word at
   which the smallest doc_id of all starts the window.
3. Factors. A document is factored greedily from the left: a factor begins at
   the first window that has a source and grows as long as the source goes on
   the same way. The window that straddles the boundary is looked up for itself
   and begins the next factor, so no window is lost between two of them.
4. Verification. The words of each factor travel to the block of its source and
   are compared there with the source's own; only equal words count. The index
   goes by hash alone, so a factor may prove wrong: windows under its hashes
   are then resolved by grouping their words themselves.

A window or factor travels once per block and place, so the load of an index
slice or of a much copied source follows the number of blocks, never the number
of copies. Messages between blocks are at most one per window key or window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, documents, shuffle_partitions
from .words import find_words, grams, hash_spans, joined, sliding_min, text_bytes

WINDOW = 13
GRAM = 5
#: Bytes of text per block; a longer document is a block's one large document.
BLOCK_BYTES = 8 << 20
#: Blocks per slice of the index; their keys and candidate windows take about as much room as one block's text and words.
SLICE_BLOCKS = 4
_TOP = np.int64(2**63 - 1)

#: A message: for block ``block`` from block ``other``.
_SENT = "block int, other int, kind int, data binary"
_KEYS, _WINDOWS, _FACTORS, _AMBIGUOUS, _EXACT = range(5)


class _Block:
    """The windows of the documents of one block, in the order of (doc_id, text) whatever order they came in."""

    def __init__(self, table: pa.Table, window: int, gram: int, hash_bits: int):
        table = pa.table({"id": pc.fill_null(table["doc_id"], int(_TOP)), "null": pc.is_null(table["doc_id"]), "text": pc.fill_null(table["text"].cast(pa.large_string()), "")})
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("null", "ascending"), ("text", "ascending")]))
        self.ids = table["id"].to_numpy().astype(np.int64)
        self.nulls = table["null"].to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = text_bytes(table["text"])
        starts, ends, self.counts = find_words(data, offsets)
        words = hash_spans(data, starts, ends)
        del table
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        # all words of a text joined by single spaces, and where each begins and ends there
        self.flat, self.offsets = joined(data, offsets, starts, ends, self.counts, np.ones(len(starts), bool))
        sizes = ends - starts
        del data, offsets, starts, ends
        self.ends = sizes + 1
        self.ends[self.first[self.counts > 0]] -= 1
        np.cumsum(self.ends, out=self.ends)
        self.starts = self.ends - sizes
        n = max(len(words) - window + 1, 0)
        self.whole = self.text[:n] == self.text[len(words) - n :] if n else np.zeros(0, bool)
        self.keys = sliding_min(grams(words, gram), window - gram + 1)[:n]
        self.words, self.window, self.shift = words, window, np.uint64(64 - hash_bits)

    def hashes(self, place: np.ndarray) -> np.ndarray:
        return grams(self.words, self.window)[place] >> self.shift

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order; which of them several documents of this block hold."""
        keys, ids = self.keys[self.whole], self.ids[self.text[: len(self.keys)][self.whole]]
        if not len(keys):
            return keys, np.zeros(0, bool)
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[first], ids[first]
        order = np.argsort(keys, kind="stable")  # ids stay in order within a key
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        last = np.concatenate([starts[1:], [len(keys)]]) - 1
        return keys[starts], ids[starts] != ids[last]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of the windows whose key is shared."""
        if not len(shared):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(shared, self.keys), len(shared) - 1)
        return np.flatnonzero(self.whole & (shared[at] == self.keys))

    def phrase(self, place: int, length: int) -> bytes:
        """The bytes of ``length`` words from a place, joined by single spaces; empty if no document has them."""
        if place + length > len(self.text) or self.text[place] != self.text[place + length - 1]:
            return b""
        return self.flat[self.starts[place] : self.ends[place + length - 1]].tobytes()


def _distinct_windows(hashes: np.ndarray):
    """Order of the windows, start of each distinct hash in that order, and the number of each window's own."""
    order = np.argsort(hashes, kind="stable")  # places, and so ids, stay in order
    h = hashes[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group


def _messages(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _SENT.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, pa.binary() if n == "data" else pa.int32()) for n, c in zip(names, columns, strict=True)], names=names)


def _read(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """The messages of a kind as (sender, data)."""
    table = table.filter(pc.equal(table["kind"], kind))
    return list(zip(table["other"].to_pylist(), table["data"].to_pylist(), strict=True))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each behind its length."""
    return b"".join(x for a in arrays for x in (len(a).to_bytes(8, "little"), a.tobytes()))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _slices(values: np.ndarray, count: int, bits: int = 64) -> np.ndarray:
    """The slice of the index for each hash: equal ranges of hashes, so sorted hashes have sorted slices."""
    return (((values << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array with where its run begins and ends."""
    if not len(sorted_):
        return []
    edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])
    return list(zip(sorted_[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64, with_text: bool = True) -> DataFrame:
    """Words of each document that earlier documents already have in a window.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256,
    kept_text (unless ``with_text`` is false), spans ("start:length:source:word" of each factor, in words,
    comma-joined; source is the doc_id that has the words and word where they
    begin there, empty for a window that was resolved by its words alone). A word goes if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller doc_id, all judged on the
    input. Null and empty texts have no words and no spans; a table without rows
    gives none. A null doc_id is larger than every other. Rows that share a
    doc_id are one document for this purpose: their windows are not held against
    each other, and repeated rows get equal results. Other columns are ignored.

    A task holds one block of about ``block_bytes`` of text, or one longer
    document, at a time; how many blocks there are follows from the table's
    bytes. ``hash_bits`` is there for tests: with few bits most windows meet
    others of their hash and their words have to tell them apart.
    """
    n = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-size // block_bytes), 1)
    slices = -(-blocks // SLICE_BLOCKS)
    # tasks grow with the blocks, so none reads more as the table grows; a row's own number deals even repeated rows over all blocks
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(max(n, blocks), "block")

    def load(table: pa.Table) -> _Block:
        return _Block(table, window, gram, hash_bits)

    def send_keys(key, table):
        keys, _ = load(table).distinct_keys()
        return _messages([(b, key[0].as_py(), _KEYS, keys[lo:hi].tobytes()) for b, lo, hi in _runs(_slices(keys, slices))])

    def index_keys(key, table):
        sent = _read(table, _KEYS)
        own = [np.frombuffer(x, np.uint64) for _, x in sent]
        keys, counts = np.unique(np.concatenate(own), return_counts=True)
        shared = keys[counts > 1]
        rows = []
        for (b, _), k in zip(sent, own, strict=True):
            at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
            bits = shared[at] == k if len(shared) else np.zeros(len(k), bool)
            rows.append((b, key[0].as_py(), _KEYS, np.packbits(bits).tobytes()))
        return _messages(rows)

    def shared_keys(own: _Block, answers: pa.Table):
        """Distinct keys, which of them other blocks hold, and the places of windows under keys of several documents."""
        keys, local = own.distinct_keys()
        parts, elsewhere = _slices(keys, slices), np.zeros(len(keys), bool)
        for b, data in _read(answers, _KEYS):
            lo, hi = np.searchsorted(parts, [b, b + 1])
            elsewhere[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo)
        return keys, elsewhere, own.candidates(keys[local | elsewhere])

    def send_windows(key, left, right):
        if left.num_rows == 0:
            return _messages([])
        me, own = key[0].as_py(), load(left)
        keys, elsewhere, place = shared_keys(own, right)
        hashes = own.hashes(place)
        order, first, _ = _distinct_windows(hashes)
        h, at = hashes[order][first], place[order][first]
        ids = own.ids[own.text[at]]
        rows = []
        for b, lo, hi in _runs(_slices(h, slices, hash_bits)):
            names, where = np.unique(ids[lo:hi], return_inverse=True)
            where = where.astype(np.uint16 if len(names) < 2**16 else np.uint32)
            rows.append((b, me, _WINDOWS, _pack(h[lo:hi], at[lo:hi].astype(np.uint32), names, where.view(np.uint8))))
        for b, lo, hi in _runs(_slices(keys, slices)):
            if elsewhere[lo:hi].any():  # the key index's answer goes along, so that the next step has it
                rows.append((b, me, _KEYS, np.packbits(elsewhere[lo:hi]).tobytes()))
        return _messages(rows)

    def search_index(key, table):
        me = key[0].as_py()
        rows = [(b, me, _KEYS, data) for b, data in _read(table, _KEYS)]
        sent = [(b, _unpack(data, np.uint64, np.uint32, np.int64, np.uint8)) for b, data in _read(table, _WINDOWS)]
        if sent:
            h, place = (np.concatenate([x[k] for _, x in sent]) for k in (0, 1))
            ids = np.concatenate([names[where.view(np.uint16 if len(names) < 2**16 else np.uint32)] for _, (_, _, names, where) in sent])
            owner = np.repeat(np.array([b for b, _ in sent], np.int32), [len(x[0]) for _, x in sent])
            order = np.lexsort((ids, h))
            first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            origin = np.empty(len(h), np.int64)
            origin[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
            earlier = ids[origin] < ids
            at = 0
            for b, x in sent:
                own = slice(at, at + len(x[0]))
                found = origin[own][earlier[own]]
                rows.append((b, me, _WINDOWS, _pack(np.packbits(earlier[own]), owner[found], place[found])))
                at = own.stop
        return _messages(rows)

    def factor(key, left, right):
        """Factors of the block's documents, each for the block of its source to verify."""
        if left.num_rows == 0:
            return _messages([])
        me, own = key[0].as_py(), load(left)
        _, _, place = shared_keys(own, right)
        hashes = own.hashes(place)
        order, first, group = _distinct_windows(hashes)
        # of each distinct window: the first place here, or the one that the index knows of
        at, where = place[order][first], np.full(len(first), me, np.int64)
        inner = own.ids[own.text[at]]
        outside = np.zeros(len(first), bool)
        parts = _slices(hashes[order][first], slices, hash_bits)
        for b, data in _read(right, _WINDOWS):
            bits, owner, there = _unpack(data, np.uint8, np.int32, np.uint32)
            lo, hi = np.searchsorted(parts, [b, b + 1])
            hit = lo + np.flatnonzero(np.unpackbits(bits, count=hi - lo))
            outside[hit], where[hit], at[hit] = True, owner, there
        held = outside[group] | (own.ids[own.text[place]] > inner[group])
        place, where, at = place[held], where[group][held], at[group][held]
        grows = (place[1:] == place[:-1] + 1) & (where[1:] == where[:-1]) & (at[1:] == at[:-1] + 1) & (own.text[place[1:]] == own.text[place[:-1]])
        begins = np.flatnonzero(np.concatenate([[True], ~grows])) if len(place) else place
        lengths = np.diff(np.concatenate([begins, [len(place)]])) + window - 1
        sent: dict[int, tuple[dict, list]] = {}
        for start, b, p, size in zip(place[begins].tolist(), where[begins].tolist(), at[begins].tolist(), lengths.tolist(), strict=True):
            phrases, uses = sent.setdefault(b, ({}, []))
            uses.append((start, phrases.setdefault((p, size, own.phrase(start, size)), len(phrases))))
        rows = []
        for b, (phrases, uses) in sent.items():
            places, sizes, texts = zip(*phrases, strict=True)
            starts, which = zip(*uses, strict=True)
            numbers = [np.array(x, np.uint32) for x in (places, sizes, [len(x) for x in texts], starts, which)]
            rows.append((b, me, _FACTORS, _pack(*numbers, np.frombuffer(b"".join(texts), np.uint8))))
        return _messages(rows)

    def verify(key, left, right):
        """Of each factor the words that its source here has too; hashes of windows that prove not to be what they seemed."""
        if left.num_rows == 0 or right.num_rows == 0:
            return _messages([])
        me, own = key[0].as_py(), load(left)
        rows = []
        for b, data in _read(right, _FACTORS):
            places, sizes, bytes_, starts, which, text = _unpack(data, *[np.uint32] * 5, np.uint8)
            text, end, true, wrong = text.tobytes(), 0, sizes.copy(), []
            for k, (place, size, length) in enumerate(zip(places.tolist(), sizes.tolist(), bytes_.tolist(), strict=True)):
                phrase, end = text[end : end + length], end + length
                if own.phrase(place, size) != phrase:
                    words = phrase.split(b" ")
                    equal = 0
                    while equal < size and own.phrase(place + equal, 1) == words[equal]:
                        equal += 1
                    true[k] = equal
                    flat, ends = np.frombuffer(phrase + bytes(16), np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
                    found = grams(hash_spans(flat, np.concatenate([[0], ends[:-1] + 1]), ends), window) >> own.shift
                    wrong.append(found[max(equal - window + 1, 0) :])
            doc = own.text[places]
            rows.append((b, me, _FACTORS, _pack(starts, true[which], own.ids[doc][which], (places - own.first[doc]).astype(np.uint32)[which])))
            if wrong:
                rows.append((b, me, _AMBIGUOUS, np.unique(np.concatenate(wrong)).tobytes()))
        return _messages(rows)

    def spell_hashes(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int64))], names=["hash"])

    def spell_windows(key, table):
        own = load(table)
        place = np.flatnonzero(own.whole)
        phrases = [own.phrase(p, window) for p in place.tolist()]
        return pa.table({"block": pa.array(np.full(len(place), key[0].as_py(), np.int32)), "place": pa.array(place), "id": pa.array(own.ids[own.text[place]]), "hash": pa.array(own.hashes(place).view(np.int64)), "phrase": pa.array(phrases, pa.binary())})

    def exact(ambiguous: DataFrame) -> DataFrame:
        """Messages with the windows under ambiguous hashes that a smaller doc_id starts, told by their words."""
        hashes = checkpoint(ambiguous.mapInArrow(spell_hashes, "hash long").distinct())
        spelt = checkpoint(dealt.groupBy("block").applyInArrow(spell_windows, "block int, place long, id long, hash long, phrase binary").join(hashes, "hash", "left_semi"))
        first = spelt.groupBy("phrase").agg(F.min("id").alias("source"))
        held = spelt.join(first, "phrase").where("id > source").select("block", "place", "source")

        def send(key, table):
            return _messages([(key[0].as_py(), 0, _EXACT, _pack(table["place"].to_numpy().astype(np.uint32), table["source"].to_numpy()))])

        return held.groupBy("block").applyInArrow(send, _SENT)

    def apply(key, left, right):
        if left.num_rows == 0:
            return _results(load(left), left["doc_id"], [], [], [], None)
        own = load(left)
        found: list[tuple] = []
        for _, data in _read(right, _FACTORS):
            found += zip(*(x.tolist() for x in _unpack(data, np.uint32, np.uint32, np.int64, np.uint32)), strict=True)
        for _, data in _read(right, _EXACT):
            found += [(p, window, d, -1) for p, d in zip(*(x.tolist() for x in _unpack(data, np.uint32, np.int64)), strict=True)]
        found = sorted(x for x in found if x[1] >= window)
        change = np.zeros(len(own.words) + 1, np.int64)
        begins, sizes = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        np.add.at(change, begins, 1)
        np.add.at(change, begins + sizes, -1)
        removed = np.cumsum(change)[:-1] > 0
        kept, at = joined(np.concatenate([own.flat, np.zeros(16, np.uint8)]), own.offsets, own.starts, own.ends, own.counts, ~removed)
        bytes_, gone = kept.tobytes(), np.concatenate([[0], np.cumsum(removed)])
        gone = gone[own.first + own.counts] - gone[own.first]
        factors: list[list[str]] = [[] for _ in own.counts]
        for start, size, doc, word in found:
            t = own.text[start]
            factors[t].append(f"{start - own.first[t]}:{size}:{doc}:{word if word >= 0 else ''}")
        wrong = b"".join(data for _, data in _read(right, _AMBIGUOUS)) or None
        return _results(own, pa.array(own.ids, mask=own.nulls), gone, [bytes_[at[i] : at[i + 1]] for i in range(len(own.counts))], factors, wrong)

    def _results(own, ids, removed, texts, factors, wrong) -> pa.Table:
        rows = {
            "doc_id": ids,
            "n_words": pa.array(own.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            "spans": pa.array([",".join(x) for x in factors], pa.string()),
            "wrong": pa.array([wrong][: len(texts)] + [None] * (len(texts) - 1), pa.binary()),
        }
        return pa.table(rows | ({"kept_text": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else {}))

    def answered(sent: DataFrame, step) -> DataFrame:
        """What every block makes of its documents and the messages to it."""
        return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(step, _SENT)

    def results(factors: DataFrame) -> DataFrame:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string, wrong binary" + ", kept_text string" * with_text
        return dealt.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(apply, schema)

    def indexed(sent: DataFrame, step) -> DataFrame:
        """What every slice of the index makes of the messages to it."""
        return sent.repartition(max(n, slices), "block").groupBy("block").applyInArrow(step, _SENT)

    keys = indexed(dealt.groupBy("block").applyInArrow(send_keys, _SENT), index_keys)
    windows = indexed(answered(keys, send_windows), search_index)
    factors = answered(answered(windows, factor), verify)
    # one query up to here, so that the texts are dealt once
    found = checkpoint(results(factors))
    ambiguous = found.where("wrong IS NOT NULL")
    if not ambiguous.isEmpty():
        found = results(factors.where(F.col("kind") == _FACTORS).union(exact(ambiguous.select(F.col("wrong").alias("data")))))
    return found.drop("wrong")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False).drop("spans")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i:i + 12], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM g),
c AS (SELECT doc_id, i, word, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are computed once per document and only distinct ones are
compared. Two fingerprints within ``RADIUS`` bits agree on one of
``RADIUS + 1`` blocks of bits, so each is sent to one group per block. In a
group the fingerprints are sorted by Gray rank; every ``FANOUT`` neighbours
become a node that keeps the bits they share (a masked pattern), those nodes
become nodes in turn, up to one root. A search carries the differences counted
so far and at each node adds those in the bits that are new there: a node with
too many is dropped with all below it, and so is one whose fingerprints are all
in the searcher's component already. A group thus returns links that span its
components, never all pairs. Groups beyond ``max_group`` are dealt again by
blocks of the remaining bits, and then in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, connected_components, documents, join_hot, shuffle_partitions
from .words import find_words, joined, text_bytes

SHINGLE = 3
SEED = 42
RADIUS = 3
FANOUT = 8
#: How often a crowded group is dealt by blocks of bits.
LEVELS = 3

#: Constants of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans; ``data`` has at least eight bytes of padding."""
    with np.errstate(over="ignore"):
        lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        lengths, at = ends - starts, starts.copy()
        s = np.uint64(seed)
        h = np.full(len(starts), s + P5, np.uint64)
        live = np.flatnonzero(lengths >= 32)
        if len(live):
            v = [np.full(len(live), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            here, stripes = np.arange(len(live)), lengths[live] // 32
            while len(here):
                rows = live[here]
                for k in range(4):
                    v[k][here] = _rotl(v[k][here] + lanes[at[rows] + 8 * k] * P2, 31) * P1
                at[rows] += 32
                stripes[here] -= 1
                here = here[stripes[here] > 0]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ (_rotl(v[k] * P2, 31) * P1)) * P1 + P4
            h[live] = x
        h += lengths.astype(np.uint64)
        left = ends - at
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ (_rotl(lanes[at[live]] * P2, 31) * P1), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = _rotl(h[live] ^ ((lanes[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = _rotl(h[live] ^ ((lanes[at[live]] & np.uint64(0xFF)) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint per text."""
    data, offsets = text_bytes(texts)
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    starts, ends, counts = find_words(data, offsets)
    flat, _ = joined(data, offsets, starts, ends, counts, np.ones(len(starts), bool))
    lengths = ends - starts
    last = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    # word k of all begins after the words before it and one space for each that is not its text's first
    firsts = (last - counts)[counts > 0]
    lead = np.ones(len(starts), np.int64)
    lead[firsts] = 0
    end = np.cumsum(lengths + lead)
    start = end - lengths
    flat = np.concatenate([flat, np.zeros(16, np.uint8)])
    k = np.arange(len(starts))
    stop = np.minimum(k + shingle, last[text]) - 1
    use = (k + shingle <= last[text]) | (k == (last - counts)[text])
    h = xxh64(flat, start[use], end[stop[use]])
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(counts), np.uint64)
    for i in np.flatnonzero(n).tolist():
        ones = np.zeros(64, np.int64)
        for a in range(edges[i], edges[i + 1], 1 << 16):
            part = h[a : min(a + (1 << 16), edges[i + 1])]
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n[i], bitorder="little").view("<u8")[0]
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    sizes = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(int(np.searchsorted(sizes, base + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def _fingerprint_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], names=["doc_id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row known of its component) after linking rows a and b."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def link(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, fanout: int = FANOUT, step: int = 4096) -> np.ndarray:
    """For rows in order of (group, Gray rank): a label per row, equal for rows of one group that links connect."""
    n = len(fp)
    labels = np.arange(n)
    for gap in (1, 2):
        near = np.flatnonzero((group[gap:] == group[:-gap]) & (np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= radius))
        labels = _merge(labels, near, near + gap)
    # levels of nodes from the rows up: first row, end row, first child, children, shared bits and their values
    levels = [{"group": group, "lo": np.arange(n), "hi": np.arange(1, n + 1), "both": fp, "any": fp}]
    while True:
        below = levels[-1]
        begins = np.flatnonzero(np.concatenate([[True], below["group"][1:] != below["group"][:-1]]))
        sizes = np.diff(np.concatenate([begins, [len(below["group"])]]))
        if (sizes == 1).all():
            break
        place = np.arange(len(below["group"])) - np.repeat(begins, sizes)
        child = np.flatnonzero(place % fanout == 0)
        end = np.concatenate([child[1:], [len(place)]])
        levels.append({"group": below["group"][child], "lo": below["lo"][child], "hi": below["hi"][end - 1], "both": np.bitwise_and.reduceat(below["both"], child), "any": np.bitwise_or.reduceat(below["any"], child), "child": child, "children": end - child})
    for level in levels:
        level["mask"] = ~(level["both"] ^ level["any"])
    root = levels[-1]
    root_of = np.repeat(np.arange(len(root["lo"])), root["hi"] - root["lo"])
    for begin in range(0, n, step):
        q = np.arange(begin, min(begin + step, n))
        node, seen, acc = root_of[q], np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            fresh = level["mask"][node] & ~seen
            acc = acc + np.bitwise_count((fp[q] ^ level["both"][node]) & fresh)
            low = np.minimum.reduceat(labels, level["lo"])
            high = np.maximum.reduceat(labels, level["lo"])
            done = (low[node] == high[node]) & (low[node] == labels[q])
            go = (acc <= radius) & (level["hi"][node] > q + 1) & ~done
            q, node, acc = q[go], node[go], acc[go]
            if depth == 0 or not len(q):
                break
            seen = level["mask"][node]
            count = level["children"][node]
            first = np.repeat(level["child"][node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            q, acc, seen = np.repeat(q, count), np.repeat(acc, count), np.repeat(seen, count)
            node = first + np.arange(len(q))
        if depth == 0 and len(q):
            labels = _merge(labels, q, node)
    return labels


def _links_of_partition(radius: int, limit: int = 200_000):
    keys = ["g"]

    def whole_groups(batches):
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows >= limit:
                key = np.stack([rest[k].to_numpy() for k in keys])
                change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
                if len(change):
                    yield rest.slice(0, int(change[-1]) + 1)
                    rest = rest.slice(int(change[-1]) + 1)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches):
        for table in whole_groups(batches):
            key = np.stack([table[k].to_numpy() for k in keys])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
            fp = table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(fp), group))
            fp, group = fp[order], group[order]
            labels = link(group, fp, radius)
            tied = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[labels[tied]].view(np.int64))], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, max_group: int = 4096, partitions: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join the same components as all pairs within ``radius`` bits do.

    Fingerprints of a group agree on the bits they were grouped by. Those of a
    group beyond ``max_group`` are grouped again by blocks of the other bits, up
    to ``LEVELS`` times (37 bits by then). What is still beyond it is cut into
    parts, and a task compares two parts, so no task holds more than
    ``2 * max_group`` fingerprints of a group.
    """
    n = partitions or shuffle_partitions(fps.sparkSession)
    open_, ready, width = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("g")), [], 64
    blocks = F.array(*[F.lit(i) for i in range(radius + 1)])
    for level in range(LEVELS):
        bits = width // (radius + 1)
        # the value of block b, and the bits below and above it moved together
        value = F.expr(f"shiftrightunsigned(rest, b * {bits}) & {(1 << bits) - 1}L")
        others = F.expr(f"shiftleft(shiftrightunsigned(shiftrightunsigned(rest, b * {bits}), {bits}), b * {bits}) | (rest & (shiftleft(1L, b * {bits}) - 1L))")
        dealt = open_.select("fp", "rest", "g", F.explode(blocks).alias("b")).select("fp", others.alias("rest"), F.xxhash64("g", F.lit(width), "b", value).alias("g"))
        width -= bits
        crowded = checkpoint(dealt.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group).select("g", F.ceil(F.col("n") / max_group).cast("int").alias("parts")))
        if crowded.isEmpty():
            ready.append(dealt.select("g", "fp"))
            break
        marked = checkpoint(join_hot(dealt, crowded, ["g"], "fp", "left"))
        ready.append(marked.where("parts IS NULL").select("g", "fp"))
        if level == LEVELS - 1:
            part, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
            tiles = F.transform(every, lambda r: F.xxhash64("g", F.least(part, r), F.greatest(part, r)))
            ready.append(marked.where("parts IS NOT NULL").select(F.explode(tiles).alias("g"), "fp"))
            break
        open_ = marked.where("parts IS NOT NULL").select("fp", "rest", "g")
    found = reduce(DataFrame.union, ready)
    return found.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_links_of_partition(radius), "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, max_group: int = 4096) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``radius`` bits.

    Returns one row per input row: doc_id, fingerprint (16 hex digits),
    component_id. Null, empty and blank texts have fingerprint zero and link like
    any other; texts of fewer than three words have one shingle. component_id
    is the smallest non-null doc_id of the component (null if it has none). Rows
    that repeat a doc_id count as documents of their own. Other columns are
    ignored.
    """
    found = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, fp long"))
    fps = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(fingerprint_links(fps, radius, max_group).distinct())
    rooted = checkpoint(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpoint(join_hot(rooted, smallest, ["root"], "fp").select("fp", "component_id"))
    return join_hot(found, named, ["fp"], "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))

"""Embedding near-dedup by cross-polytope hashing.

Equal vectors of a label are one class. A class is hashed in ``TABLES`` tables:
``HASHES`` times, three rounds of random signs and a fast Hadamard transform
rotate the unit vector, and the hash is the coordinate of largest magnitude
with its sign. A class lives in one bucket per table and also probes the
buckets where the runner-up coordinate replaces one hash. Classes that meet are
candidates; their cosine in double precision decides, so every link is true.
Residents and probes of a crowded bucket are cut into parts of about ``TILE``
rows, and a task compares two parts at a time, never a whole bucket.
Of residents a tile returns how many links each has and one link to its local
component, so a group of near copies gives rows in proportion to its size; a pair
met by a probe may be met again elsewhere, so these are listed and made distinct.
Buckets are matched by id alone; a vector travels only to tiles where it can meet
another, in the precision it came in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, connected_components, join_hot, shuffle_partitions
from .simhash import _merge

COSINE = 0.93
TABLES = 6
HASHES = 2
PROBES = 2
SEED = 7
#: Residents or probes of a bucket per part.
TILE = 1024

#: ``near`` is null for a pair of classes, else the weight of the links that class a has in a tile; b is then in its component.
_LINKS = "a long, b long, near long"
_HASHED = "id long, copies long, label string, dim int, home array<long>, probed array<array<long>>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def cross_polytope(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, shape (rows, tables, 1 + probes): the home bucket and then the likeliest others."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 0).bit_length()
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    signs = np.random.default_rng([seed, d]).choice([-1.0, 1.0], (tables, hashes, 3, d))
    rows = np.arange(n)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        best, second, gap = (np.zeros((n, hashes), k) for k in (np.int64, np.int64, float))
        for k in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            size = np.abs(y)
            top = size.argmax(1)
            high = size[rows, top]
            best[:, k] = 2 * top + (y[rows, top] < 0)
            size[rows, top] = -1
            top = size.argmax(1)
            second[:, k] = 2 * top + (y[rows, top] < 0)
            gap[:, k] = (high - size[rows, top]) / high
        base = (2 * d) ** np.arange(hashes)
        out[:, t, 0] = best @ base
        order = gap.argsort(1)
        for p in range(min(probes, hashes)):
            other = best.copy()
            k = order[:, p]
            other[rows, k] = second[rows, k]
            out[:, t, 1 + p] = other @ base
        for p in range(hashes, probes):
            out[:, t, 1 + p] = out[:, t, 0]
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash_rows(tables: int, hashes: int, probes: int, seed: int):
    """Per class the bucket it lives in and the other ones it probes, for each table."""

    def rows(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                for at in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 2048)):
                    part = batch.take(pa.array(at))
                    x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    buckets = cross_polytope(_units(x), tables, hashes, probes, seed)
                    probed = [[[b for b in dict.fromkeys(t[1:]) if b != t[0]] for t in row] for row in buckets.tolist()]
                    home, other = pa.array(list(buckets[:, :, 0]), pa.list_(pa.int64())), pa.array(probed, pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "label", "dim")), home, other, part.column("vector")], names=[*(c.split()[0] for c in _HASHED.split(", ")), "vector"])

    return rows


def _pairs(first: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int):
    """For each row of ``first`` its partners, the rows from begin to end, as (i, j) arrays of about ``limit`` pairs."""
    sizes = np.maximum(end - begin, 0)
    total, at = np.cumsum(sizes), 0
    while at < len(first):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + limit, "right")), at + 1)
        n = sizes[at:to]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(first[at:to], n), np.repeat(begin[at:to], n) + offset
        at = to


def _verify(cosine: float):
    keys = ["label", "dim", "tbl", "bucket", "kind", "left", "right"]

    def whole(batches):
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            changed = _changes(rest, keys)
            if rest.num_rows > 20_000 and len(changed):
                yield rest.slice(0, int(changed[-1]))
                rest = rest.slice(int(changed[-1]))
        if rest is not None and rest.num_rows:
            yield rest

    def rows(batches):
        for table in whole(batches):
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():  # vectors of one length side by side
                yield compare(table.take(pa.array(np.flatnonzero(dims == dim))), dim)

    def compare(table, dim):
        n = table.num_rows
        edges = np.concatenate([[0], _changes(table, keys), [n]])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        ids, copies, side, tbl = (table[c].to_numpy() for c in ("id", "copies", "side", "tbl"))
        probing = table["kind"].to_numpy() == 1
        within = ~probing & (table["left"].to_numpy() == table["right"].to_numpy())
        x = _units(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim))
        home = table["home"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        # rows of a tile stand by side; a row meets all of the other side, or the later rows of its own part
        seconds = np.bincount(group[side == 0], minlength=len(edges) - 1) + edges[:-1]
        first = np.flatnonzero((side == 0) & (edges[1:][group] - edges[:-1][group] > 1))
        begin, end = np.where(within[first], first + 1, seconds[group[first]]), edges[1:][group[first]]
        labels, weight = np.arange(n), np.zeros(n, np.int64)
        a, b = [], []
        for i, j in _pairs(first, begin, end, max((1 << 23) // dim, 1)):
            # residents are compared in the first table in which both live together, a probe with residents it lives with nowhere
            same = home[i] == home[j]
            mine = np.where(probing[i], ~same.any(1), same.argmax(1) == tbl[i])
            i, j = i[mine], j[mine]
            true = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[true], j[true]
            met = probing[i]
            a.append(np.minimum(ids[i[met]], ids[j[met]]))
            b.append(np.maximum(ids[i[met]], ids[j[met]]))
            i, j = i[~met], j[~met]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            labels = _merge(labels, i, j)
        tied = np.flatnonzero(weight)
        a, b = np.concatenate([*a, ids[tied]]), np.concatenate([*b, ids[labels[tied]]])
        near = np.concatenate([np.zeros(len(a) - len(tied), np.int64), weight[tied]])
        # copies are at least one, so a weight of zero stands for a pair
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near, mask=near == 0)], names=["a", "b", "near"])

    return rows


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table[k].combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.dictionary_encode()
            column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices
        values = column.to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    return np.flatnonzero(change) + 1


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``cosine``.

    Returns one row per input row: vec_id, n_links, component_id, kept. A
    vector that is null, empty, zero or has null or non-finite components, or
    whose label or vec_id is null, links with nothing (n_links 0, its own
    component). Vectors of different lengths never link. Rows that repeat a
    vector link with each other; rows that repeat a vec_id count as vectors of
    their own. Other columns are ignored. No pair below ``cosine`` is linked;
    near ones are found by hashing, so a few above it may be missed (the tests
    measure recall against brute force).
    """
    n = shuffle_partitions(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    values = F.col("embedding").cast(kind)
    good = F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(values, lambda v: v != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), values.alias("vector"), good.alias("good"))
    classes = checkpoint(rows.where("good").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    hashed = checkpoint(classes.select("id", "copies", "label", F.size("vector").alias("dim"), "vector").repartition(n).mapInArrow(_hash_rows(tables, hashes, probes, SEED), f"{_HASHED}, vector {kind}"))
    bucket = ["label", "dim", "tbl", "bucket"]
    lives = F.array(F.struct(F.col("z.home").alias("bucket"), F.lit(False).alias("probe")))
    slots = (
        hashed.select("id", "label", "dim", F.posexplode(F.arrays_zip("home", "probed")).alias("tbl", "z"))
        .select("id", "label", "dim", "tbl", F.explode(F.concat(lives, F.transform("z.probed", lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("probe"))))).alias("slot"))
        .select("id", "label", "dim", "tbl", "slot.bucket", "slot.probe")
    )
    # buckets without a resident or with one row hold no pair; there is one part of each side for all but crowded ones
    probes, residents = F.count_if("probe"), F.count_if(~F.col("probe"))
    crowd = slots.groupBy(*bucket).agg(probes.alias("probes"), residents.alias("residents")).where("residents > 0 AND residents + probes > 1")
    crowd = crowd.select(*bucket, F.ceil(F.col("residents") / tile).cast("int").alias("parts"), F.ceil(F.col("probes") / tile).cast("int").alias("probe_parts"))
    placed = join_hot(slots, crowd, bucket, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("probe_parts")).otherwise(F.col("parts"))).cast("int"))

    def tiled(kind: int, side, left, right):
        return F.struct(F.lit(kind).alias("kind"), side.alias("side"), left.alias("left"), right.alias("right"))

    every, every_probe = F.sequence(F.lit(0), F.col("parts") - 1), F.filter(F.sequence(F.lit(0), F.col("probe_parts")), lambda p: p < F.col("probe_parts"))
    # tiles (0, l, r) hold the residents of two parts, tiles (1, p, r) the probes of one part and the residents of another
    tiles = F.when(F.col("probe"), F.transform(every, lambda r: tiled(1, F.lit(0), F.col("part"), r))).otherwise(
        F.concat(
            F.transform(every, lambda r: tiled(0, F.when(F.col("part") <= r, 0).otherwise(1), F.least("part", r), F.greatest("part", r))),
            F.transform(every_probe, lambda p: tiled(1, F.lit(1), p, F.col("part"))),
        )
    )
    dealt = placed.withColumn("tile", F.explode(tiles)).select("id", *bucket, F.col("tile.kind").alias("kind"), F.col("tile.side").alias("side"), F.col("tile.left").alias("left"), F.col("tile.right").alias("right"))
    dealt = dealt.join(hashed.select("id", "copies", "home", "vector"), "id")
    meet = [*bucket, "kind", "left", "right"]
    links = checkpoint(dealt.repartition(n, *meet).sortWithinPartitions(*meet, "side").mapInArrow(_verify(cosine), _LINKS))
    pairs = checkpoint(links.where("near IS NULL").select("a", "b").distinct())
    weighed = links.where("near IS NOT NULL")
    roots = connected_components(pairs.union(weighed.select("a", "b")))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    probed = both.join(classes.select(F.col("id").alias("b"), "copies"), "b").select("a", F.col("copies").alias("near"))
    near = probed.union(weighed.select("a", "near")).groupBy(F.col("a").alias("id")).agg(F.sum("near").alias("near"))
    named = (
        classes.join(near, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "vector", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    named = checkpoint(named)
    linked = join_hot(rows.where("good"), named, ["label", "vector"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Language identification by hierarchical discrimination.

First a linear support vector machine per pair of families says which family a
text belongs to; within the family, one machine per pair of languages separates
the close relatives. Languages of no known family, and families where there are
many, stand in groups of at most ``WIDTH``, so machines grow with the number of
languages and not with its square. Features are hashed character n-grams of the
whole text, read piece by piece.

Machines are fitted in tasks, one per group, on a bounded sample of labelled
rows. Only weights reach the driver: at most ``LABELS`` languages with about
four machines each, 32 KB a machine, so the model that travels with the tasks
has at most some 70 MB whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents

#: Families by language code (fixed values); a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
    "east-asian": "zh ja ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

SIZE = 1 << 13
ORDERS = (1, 2, 3)
#: Labelled rows per language that training may use, and of all languages together.
SAMPLE = 250
ROWS = 8000
#: Languages that are learnt: those with the most labelled rows (ties by code). Rarer ones are never predicted.
LABELS = 512
#: Languages or groups in a group that no family makes.
WIDTH = 8
#: Characters of a text that are held at a time.
PIECE = 1 << 20
UNDECIDED = "und"

_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)])


def _points(text: str, inside: bool = False) -> tuple[np.ndarray, bool]:
    """Lower-case code points, every run of other characters than letters as one space; whether the last one is a letter.

    ``inside`` tells whether a letter stands before the text.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.where(c < 0x10000, _LETTER[np.minimum(c, 0xFFFF)], False)
    for i in np.flatnonzero(c >= 0x10000).tolist():
        letter[i] = unicodedata.category(chr(c[i]))[0] == "L"
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if len(keep) and inside:
        keep[0] = True
    return np.where(letter, c, 32).astype(np.uint64)[keep], bool(letter[-1]) if len(letter) else inside


def features(text: str, size: int = SIZE) -> np.ndarray | None:
    """Damped n-gram counts of length one; None without a letter."""
    out, seen, inside = np.zeros(size, np.float32), False, False
    last = np.array([32], np.uint64)  # what n-grams of the next piece may begin with
    for at in range(0, len(text) + 1, PIECE):
        c, inside = _points(text[at : at + PIECE], inside)
        seen = seen or bool((c != 32).any())
        if at + PIECE > len(text):
            c = np.append(c, np.uint64(32))
        old, c = len(last), np.concatenate([last, c])
        h = c
        for order in ORDERS:
            if order > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + c[order - 1 :]
            # n-grams that end in this piece, and at the very start those of the leading space
            new = h[0 if at == 0 else max(old - order + 1, 0) :]
            x = (new + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((x >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size)
        last = c[-(max(ORDERS) - 1) :]
    if not seen:
        return None
    np.sqrt(out, out)
    return out / np.linalg.norm(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any((_points(text[at : at + PIECE])[0] != 32).any() for at in range(0, len(text), PIECE))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1 / (1 + 2 * cost * 1.1)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * cost * (x.T @ (balance * slack * y)))
        w, v = new, new + k / (k + 3) * (new - w)
    w = w.copy()
    w[-1] *= 0.3
    return w.astype(np.float32)


def hierarchy(langs: list[str]) -> tuple:
    """The languages as nested groups: a language is a string, a group a tuple of languages or groups."""
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        if lang in FAMILY_OF:
            families.setdefault(FAMILY_OF[lang], []).append(lang)
    level: list = [tuple(m) for _, m in sorted(families.items())]
    other = [lang for lang in sorted(langs) if lang not in FAMILY_OF]
    level += [tuple(other[i : i + WIDTH]) for i in range(0, len(other), WIDTH)] if len(other) > WIDTH else other
    while len(level) > 2 * WIDTH:
        level = [tuple(level[i : i + WIDTH]) for i in range(0, len(level), WIDTH)]
    return tuple(x[0] if isinstance(x, tuple) and len(x) == 1 else x for x in level)


def groups(tree: tuple) -> list[tuple]:
    """All groups of a hierarchy, each before its parts."""
    return [tree, *chain.from_iterable(groups(x) for x in tree if isinstance(x, tuple))]


def members(node) -> list[str]:
    return [node] if isinstance(node, str) else [x for part in node for x in members(part)]


class Model:
    """A hierarchy of languages and the machines between the parts of each group: (group, part a, part b) -> weights."""

    def __init__(self, tree: tuple, machines: dict[tuple[int, int, int], np.ndarray]):
        self.tree, self.langs = tree, members(tree)
        self.place = {group: k for k, group in enumerate(groups(tree))}
        self.machines = {}
        for group, k in self.place.items():
            pairs = [p for p in combinations(range(len(group)), 2) if (k, *p) in machines]
            self.machines[group] = pairs, np.array([machines[(k, *p)] for p in pairs], np.float32).reshape(len(pairs), SIZE + 1)

    @staticmethod
    def _choose(f, machines, n: int) -> tuple[int, float]:
        """The part with most won duels, the larger margins on a tie; the chance of its narrowest duel."""
        pairs, weights = machines
        if not pairs:
            return 0, 1.0
        margin = weights[:, :-1] @ f + weights[:, -1]
        votes, sums, worst = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for (a, b), m in zip(pairs, margin.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            for k, s in ((a, m), (b, -m)):
                sums[k] += s
                worst[k] = min(worst[k], s)
        best = max(range(n), key=lambda k: (votes[k], sums[k], -k))
        return best, float(1 / (1 + np.exp(-4 * worst[best])))

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text) if text else None
        if f is None or not self.langs:
            return UNDECIDED, 0.0
        node, score = self.tree, 1.0
        while isinstance(node, tuple):
            best, p = self._choose(f, self.machines[node], len(node))
            node, score = node[best], score * p
        return node, score


def _vector_rows(batches):
    """The features of sampled texts as (place, value) pairs, which have a bound whatever the text's length."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if (f := features(text.as_py())) is not None:
                at = np.flatnonzero(f)
                langs.append(lang)
                out.append(at.astype("<u2").tobytes() + f[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "vector"])


def _fit_group(key, table):
    rows = sorted(zip(table["part"].to_pylist(), table["vector"].to_pylist(), strict=True))  # so that sums do not depend on the order of rows
    x, part = np.zeros((len(rows), SIZE), np.float32), np.array([p for p, _ in rows])
    for row, (_, data) in zip(x, rows, strict=True):
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    out = []
    for a, b in combinations(np.unique(part).tolist(), 2):
        use = (part == a) | (part == b)
        out.append((key[0].as_py(), a, b, fit_machine(x[use], np.where(part[use] == a, 1, -1).astype(np.float32)).tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.binary()], strict=True)], names=["grp", "a", "b", "weights"])


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS, labels: int = LABELS) -> Model:
    """Fit on a bounded sample of the rows with text, lang and doc_id outside the held-out fold.

    The ``labels`` languages with the most such rows are learnt, from at most
    ``sample`` rows each and ``rows`` in all, chosen by a hash of doc_id. Only ids
    and labels are ranked (each task keeps its own first rows per language); the
    texts of the chosen rows follow by a join with that short list and leave
    their task as features.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(fold != 2)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    learnt = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(labels).collect()]
    if not learnt:
        return Model((), {})
    sample = min(sample, max(rows // len(learnt), 2))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    known = usable.where(F.col("lang").isin(learnt))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang")
    # at most ``rows`` ids, so the list is small enough to broadcast; of rows that repeat an id only its first text is used
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    vectors = texts.select("lang", "text").mapInArrow(_vector_rows, "lang string, vector binary")
    tree = hierarchy(learnt)
    paths = [(lang, k, part) for k, group in enumerate(groups(tree)) for part, x in enumerate(group) for lang in members(x)]
    within = docs.sparkSession.createDataFrame(paths, "lang string, grp int, part int")
    fitted = vectors.join(F.broadcast(within), "lang").groupBy("grp").applyInArrow(_fit_group, "grp int, a int, b int, weights binary").collect()
    return Model(tree, {(r["grp"], r["a"], r["b"]): np.frombuffer(r["weights"], np.float32) for r in fitted})


def identify(docs: DataFrame, model: Model, passing: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to doc_id, text and the ``passing`` columns.

    ``und`` with score 0 if the text is null or has no letter.
    """
    passing = passing or []

    def rows(batches):
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            own = [batch.column(c) for c in ("doc_id", *passing)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", *passing, "lang_pred", "score"])

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[c for c in passing if c != "text"])
    kinds = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *passing)) + ", lang_pred string, score double"
    return kept.mapInArrow(rows, schema)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""

    def rows(batches):
        for batch in batches:
            yield batch.filter(pa.array([has_letter(x.as_py()) for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The language of every whole text, learnt from the training folds of the same table.

    Returns one row per input row: doc_id, held_out, lang_pred, score. Rows of
    the held-out fold (crc32 of doc_id as text, modulo 4, is 2) and rows without
    lang or text are never learnt from. With no labelled row every text is
    ``und``. A null doc_id is not held out (held_out is false) and not learnt
    from. Repeated rows get equal results, a table without rows gives none, and
    texts of any length are read whole. Other columns are ignored.
    """
    model = train(docs, sample)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))

"""Secret scan: fixed patterns plus character Markov models, native functions only.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples. A run of key-like
characters is a secret if its mean log-likelihood ratio per step exceeds a
threshold; of any other run the stretch of ``LEAST`` characters or more that
exceeds it by the largest sum is, so an ordinary prefix hides no key. The ratios
are one constant array and a run is scored in one pass over its characters, so
scoring is an expression inside the scan and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Patterns of the base kinds in the order in which ties are listed; assign also needs six characters in group 2.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A match is the whole run, so asking for its length in the pattern drops the same runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Characters that a run or a stretch of it has at least.
LEAST = 20
#: Runs that the models judge.
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Mean log-likelihood ratio per step above which a run counts as random.
THRESHOLD = 0.6
#: Generated random samples of each alphabet.
RANDOM_SAMPLES = 2000


def default_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples (text, is_random).

    Random strings are digests in hexadecimal, upper-case hexadecimal and base
    64. Ordinary identifiers are runs of three words of the benchmark passages
    in snake, kebab and camel case, with small numbers at some ends.
    """
    n = spark.range(RANDOM_SAMPLES).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    digests = n.select(F.explode(F.array(F.col("d"), F.upper("d"), F.base64(F.unhex("d")))).alias("text"), F.lit(True).alias("is_random"))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 1)
    three = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words.alias("w")).where(F.size("w") > 3)
    three = three.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, F.lit(3)))).alias("w"))
    camel = F.array_join(F.transform("w", lambda w: F.initcap(w)), "")
    numbered = F.concat(F.array_join("w", "_"), F.lit("-"), (F.abs(F.xxhash64("w")) % 100).cast("string"))
    return digests.union(three.select(F.explode(F.array(F.array_join("w", "_"), F.array_join("w", "-"), camel, numbered)).alias("text"), F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of random against ordinary for each step between two states, row by row.

    Steps are counted by a combined aggregate; at most ``2 * STATES ** 2`` counts
    reach the driver, however many samples there are. Samples with a null text
    or label are ignored.
    """
    steps = samples.where("text IS NOT NULL AND is_random IS NOT NULL AND char_length(text) > 1").select(
        "is_random", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.substr("text", i, F.lit(2)))).alias("step")
    )
    a, b = F.expr(f"instr('{ALPHABET}', substr(step, 1, 1))"), F.expr(f"instr('{ALPHABET}', substr(step, 2, 1))")
    counted = steps.groupBy("is_random", a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {True: [0.5] * STATES**2, False: [0.5] * STATES**2}
    for r in counted:
        counts[r["is_random"]][r["a"] * STATES + r["b"]] += r["n"]
    ratios = []
    for a in range(STATES):
        rows = {k: c[a * STATES : (a + 1) * STATES] for k, c in counts.items()}
        totals = {k: sum(r) for k, r in rows.items()}
        ratios += [math.log(x / totals[True]) - math.log(y / totals[False]) for x, y in zip(rows[True], rows[False], strict=True)]
    return ratios


def spans(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, match>> in code points, leftmost and not overlapping.

    The pieces between matches and the matches themselves alternate, so an end
    is a sum of lengths. The sums double their reach from round to round, so a
    text of very many matches costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    rounds = F.array(*[F.lit(1 << k) for k in range(31)])

    def placed(x: Column) -> Column:
        """Matches with their place, from the struct (gaps, found)."""
        steps = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: g + F.char_length(m))
        reach = F.filter(rounds, lambda k: k < F.size(x["found"]))
        ends = F.aggregate(reach, steps, lambda sums, k: F.zip_with(sums, F.slice(F.concat(F.array_repeat(F.lit(0), k), sums), F.lit(1), F.size(sums)), lambda a, b: a + b))
        return F.zip_with(ends, x["found"], lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match")))

    all_ = F.transform(F.array(F.struct(gaps.alias("gaps"), found.alias("found"))), placed)[0]
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _listed(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _text(listed: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Secrets in every whole text.

    Returns one row per input row: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans. Spans are kind:start:end in code points, end exclusive,
    by start and then kind (assign, access, hex, markov). A markov span is a
    run of key-like characters that the models call random, or the most random
    stretch of one; base spans stay beside it. Null and empty texts have no
    spans, a table without rows gives none, repeated rows and null ids are rows
    like any other, and time grows with a text's length, however long its runs
    are. Other columns are ignored.
    """
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def random_part(run: Column) -> Column:
        """Start and end of what is random in a run, or null: one pass that sums ratios and keeps the best stretch."""

        def state(prev, place, total, now, since, best, lo, hi) -> Column:
            values = (prev.cast("int"), place.cast("int"), total.cast("double"), now.cast("double"), since.cast("int"), best.cast("double"), lo.cast("int"), hi.cast("int"))
            return F.struct(*[v.alias(n) for v, n in zip(values, ("prev", "place", "total", "now", "since", "best", "lo", "hi"), strict=True)])

        def step(s: Column, c: Column) -> Column:
            begun = s["prev"] > 0
            ratio = F.when(begun, F.element_at(weights, s["prev"] * STATES + c + 1)).otherwise(0.0)
            goes_on = begun & (s["now"] > 0)
            excess = F.when(begun, ratio - threshold).otherwise(0.0)
            return F.transform(
                F.array(F.struct(ratio.alias("ratio"), F.when(goes_on, s["now"] + excess).otherwise(excess).alias("now"), F.when(goes_on, s["since"]).otherwise(F.greatest(s["place"] - 1, F.lit(0))).alias("since"))),
                lambda x: _with_best(s, c, x),
            )[0]

        def _with_best(s: Column, c: Column, x: Column) -> Column:
            better = (x["now"] > s["best"]) & (s["place"] + 1 - x["since"] >= LEAST)
            pick = lambda new, old: F.when(better, new).otherwise(old)
            return state(c, s["place"] + 1, s["total"] + x["ratio"], x["now"], x["since"], pick(x["now"], s["best"]), pick(x["since"], s["lo"]), pick(s["place"] + 1, s["hi"]))

        def judged(s: Column) -> Column:
            whole = F.struct(F.lit(0).alias("lo"), s["place"].alias("hi"))
            return F.when(s["total"] / (s["place"] - 1) > threshold, whole).when(s["best"] > 0, F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

        codes = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
        zero = F.lit(0)
        return F.aggregate(codes, state(*[zero] * 8), step, judged)

    def markov(found: Column) -> Column:
        parts = F.transform(found, lambda s: F.struct(s["start"].alias("start"), random_part(s["match"]).alias("part")))
        parts = F.filter(parts, lambda s: s["part"].isNotNull())
        return F.transform(parts, lambda s: F.struct((s["start"] + s["part"]["lo"]).alias("start"), (s["start"] + s["part"]["hi"]).alias("end")))

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    secret = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = F.transform(
        F.filter(F.zip_with(spans(t, ASSIGN), F.when(t.rlike(ASSIGN), secret).otherwise(F.array().cast("array<string>")), lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.char_length(x["v"]) >= 6),
        lambda x: x["s"],
    )
    found = text.select(
        "doc_id",
        assign.alias("assign"),
        spans(t, ACCESS).alias("access"),
        spans(t, HEX).alias("hex"),
        markov(spans(t, RUN)).alias("markov"),
    )
    base = F.concat(_listed(F.col("assign"), 0, "assign"), _listed(F.col("access"), 1, "access"), _listed(F.col("hex"), 2, "hex"))
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.concat(base, _listed(F.col("markov"), 3, "markov"))).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir), train(default_samples(spark, sf_dir)))

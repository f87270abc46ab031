"""Token counts by the whole-token shortcut.

Before any text is read, the driver collects every vocabulary string that is
provably one token when it stands alone; the tasks get that list, which the
vocabulary bounds. A pre-token among them counts one with a single look-up; the
merges run for the rest only, once per distinct pre-token while a worker
remembers it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary
from .shared import documents

VOCABULARY = "byte_bpe_50k.json"
#: Distinct merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 800_000


class Counter(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, vocab: Vocabulary, proven: Iterable[str]):
        self.vocab = vocab
        self.single = dict.fromkeys(proven, 1)
        super().__init__(self.single)

    def __missing__(self, pretoken: str) -> int:
        n = self.vocab.merged_length(pretoken)
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        total = 0
        for part in self.vocab.parts(text):
            if part in self.vocab.special:
                total += 1
            elif part:
                total += sum(map(self.__getitem__, self.vocab.pretokens(part)))
        if len(self) > len(self.single) + REMEMBERED:
            self.clear()
            self.update(self.single)
        return total


_COUNTERS: dict[str, Counter] = {}


@lru_cache(4)
def proven_tokens(name: str) -> tuple[str, ...]:
    """Pre-tokens that are one token whole, worked out once per driver and vocabulary."""
    return tuple(vocabulary(name).proven_single())


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text, as the tokenizers library counts them without added tokens.

    Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit. Null
    counts as empty: no bytes and no tokens. A special string inside a text is
    one token, as the library has it. Repeated rows and null ids are rows like any
    other, a table without rows gives none, and texts are counted whole, however
    long they or their pre-tokens are. ``name`` is a tokenizer file's name or
    path. Other columns are ignored.
    """
    proven = proven_tokens(name)

    def rows(batches):
        if name not in _COUNTERS:
            _COUNTERS[name] = Counter(vocabulary(name), proven)
        counter = _COUNTERS[name]
        for batch in batches:
            counts = [counter.count(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))

"""Exact dedup by content-defined chunk recipes, native DataFrame code only.

1. White space is deleted and the UTF-8 bytes of the rest are cut into chunks
   where the content says so: a boundary follows three characters of one byte
   length whose last bytes are of fixed classes, at least ``MIN_CHUNK`` and at
   most ``MAX_CHUNK`` bytes after the last one. About one place in 200 qualifies
   in any script, so equal texts give equal chunks, and an edit moves only the
   chunks around it.
2. The chunk dictionary groups all chunks by (hash, content): every chunk's
   bytes move once, combined on the map side, and prove whether a hash stands
   for a single content. Hashes that do not are numbered apart.
3. A document's recipe is the ordered list of its verified chunk ids. Documents
   are compared by recipe only, so long texts never move again. A recipe that
   many documents share is dealt over several tasks when its group's answer
   comes back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, documents, join_hot

MIN_CHUNK = 192
MAX_CHUNK = 4096

#: Classes of the three bytes of a boundary in ASCII: code points by their remainders, the rarest first.
_ASCII = "".join("[" + "".join(chr(c) for c in range(0x30, 0x7B) if c % m == r and chr(c).isalnum()) + "]" for m, r in ((16, 9), (4, 0), (8, 5)))
#: Last bytes that qualify: one in six of those that end a character of several bytes, as characters of Latin-1.
_LAST = "[" + "".join(rf"\x{b:02X}" for b in range(0x80, 0xC0) if b % 6 == 2) + "]"
#: First bytes of characters of two, three and four bytes, with what stands between them and the last byte.
_LEADS = (r"[\xC2-\xDF]", r"[\xE0-\xEF][\x80-\xBF]", r"[\xF0-\xF4][\x80-\xBF]{2}")
BOUNDARY = f"(?:{_ASCII}|{_LAST}(?:{'|'.join(f'{lead}{_LAST}{lead}{_LAST}' for lead in _LEADS)}))"
#: A chunk ends with a boundary, which has at most nine bytes, at the largest size, or with the text.
CHUNK = rf"(?s).{{{MIN_CHUNK - 3},{MAX_CHUNK - 9}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text as binary values; one after another they are its UTF-8 bytes."""
    bytes_ = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character for each byte
    return F.transform(F.regexp_extract_all(bytes_, F.lit(CHUNK), F.lit(0)), lambda c: F.encode(c, "ISO-8859-1"))


def without_space(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunk_hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def exact_dedup(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Classes of documents whose texts are equal without white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. Of equal texts the one with the most code points stays, then
    the smallest doc_id. Null text counts as empty, so all null, empty and blank
    texts form one class. A repeated doc_id row is a row like any other and
    counts in group_size; rows that share the kept doc_id are all ``kept``. A
    null doc_id comes after all others, a table without rows gives none, and
    texts of any length are taken whole. Other columns are ignored.
    ``hash_bits`` is there for tests: with few bits chunk hashes collide and
    the dictionary has to tell the contents apart.
    """
    cut = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), without_space(F.col("text")).alias("norm"))
    cut = cut.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), chunks_of(F.col("norm")).alias("chunks"))

    def hashed(c: Column) -> Column:
        return chunk_hash(c, hash_bits)

    contents = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ambiguous = checkpoint(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    recipes = cut.select("doc_id", "n_points", "text_sha256", F.transform("chunks", hashed).alias("recipe"))
    if ambiguous.isEmpty():
        recipes = recipes.withColumn("numbers", F.lit(""))
    else:
        recipes = recipes.join(_numbers(cut, ambiguous, hashed), "text_sha256", "left").withColumn("numbers", F.coalesce("numbers", F.lit("")))
    recipes = checkpoint(recipes)
    groups = recipes.groupBy("recipe", "numbers").agg(
        F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"))).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return join_hot(recipes, groups, ["recipe", "numbers"], "doc_id").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"),
        "text_sha256",
    )


def _numbers(cut: DataFrame, ambiguous: DataFrame, hashed) -> DataFrame:
    """For texts with chunks whose hash stands for several contents: position and ordinal of each.

    The ordinal of a content is how many contents with its hash sort before it;
    only chunks with ambiguous hashes take part.
    """
    refs = cut.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk"))).join(ambiguous, "h").distinct()
    known = refs.select("h", "chunk").distinct()
    ordinals = known.groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("all")).select("h", F.posexplode("all").alias("ordinal", "chunk"))
    return (
        refs.join(ordinals, ["h", "chunk"])
        .groupBy("text_sha256")
        .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["ordinal"].cast("string")))).alias("numbers"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS p, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY p DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY norm ORDER BY p DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

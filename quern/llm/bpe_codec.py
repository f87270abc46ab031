"""BPE encoding and decoding by traversal of a trie of distinct words.

The distinct words of a batch form a trie over merge symbols. For each node,
that is each prefix, only the last token of its encoding is kept: it is the one
vocabulary string that ends there, encodes to itself and is compatible with the
last token of the prefix it leaves (the two together encode to just these two).
Depth-first, a prefix that many words share is worked out once, when the first
of them needs it; a word's ids follow the last tokens back to the root. The symbol with the end-of-word suffix
is a leaf of its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary
from .shared import documents

VOCABULARY = "word_bpe_49k.json"
#: Distinct words in each of the two generations that a worker remembers.
REMEMBERED = 300_000
#: In place of an id: no token of its own, and one that is not worked out yet.
ABSENT, UNTRIED = -1, -2


#: New symbols of a word beyond which its prefixes are worked out in order and not on demand.
DEEP = 64
#: Last symbols by which tokens are told apart before they are looked for.
ENDING = 4


def _longest(tokens) -> dict[str, int]:
    """The length of the longest token that ends in given symbols, for tokens longer than ``ENDING``."""
    found: dict[str, int] = {}
    for token in tokens:
        if len(token) > ENDING:
            found[token[-ENDING:]] = max(found.get(token[-ENDING:], 0), len(token))
    return found


class TrieEncoder:
    """Ids and token strings of words, remembered per word.

    Words are kept in two generations: when the young one is full it becomes the
    old one, and old words that come again are young again. Frequent words thus
    stay, and at most twice ``REMEMBERED`` words and one batch are held.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.names = {number: token for token, number in vocab.ids.items()}
        self.shift = max(self.names).bit_length()
        self.known: dict[str, tuple[str, str]] = {}
        self._older: dict[str, tuple[str, str]] = {}
        self._pairs: dict[int, bool] = {}
        # inner tokens, and tokens with the suffix (shown without it): id if it encodes to itself, else absent
        suffix = vocab.suffix
        self._inner = dict.fromkeys((t for t in vocab.ids if not suffix or not t.endswith(suffix)), UNTRIED)
        self._final = dict.fromkeys((t.removesuffix(suffix) for t in vocab.ids if suffix and t.endswith(suffix)), UNTRIED)
        self._reach = {"": _longest(self._inner), suffix: _longest(self._final)} if suffix else {"": _longest(self._inner)}
        self._latin = dict(enumerate(vocab.byte_characters))

    def _alone(self, token: str, suffix: str) -> int:
        """The id of a vocabulary string if it encodes to itself, else ``ABSENT``."""
        whole = self.vocab.merge([*token[:-1], token[-1] + suffix]) == [token + suffix]
        number = self.vocab.ids[token + suffix] if whole else ABSENT
        (self._final if suffix else self._inner)[token] = number
        return number

    def _compatible(self, key: int, left: str, right: str, suffix: str) -> bool:
        """Whether two tokens side by side encode to just these two."""
        ok = self.vocab.merge([*left, *right[:-1], right[-1] + suffix]) == [left, right + suffix]
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    def _last(self, word: str, end: int, begin: list[int], last: list[int], suffix: str) -> tuple[int, int]:
        """Where the last token of the first ``end`` symbols begins, and its id; shorter prefixes are worked out when asked for."""
        alone, pairs = (self._final if suffix else self._inner).get, self._pairs.get
        reach = self._reach[suffix].get(word[max(end - ENDING, 0) : end], ENDING)
        for at in range(max(0, end - reach), end):
            token = word[at:end]
            number = alone(token, ABSENT)
            if number == UNTRIED:
                number = self._alone(token, suffix)
            if number == ABSENT:
                continue
            if at == 0:
                return 0, number
            if last[at] == UNTRIED:
                begin[at], last[at] = self._last(word, at, begin, last, "")
            key = last[at] << self.shift | number
            ok = pairs(key)
            if ok is None:
                ok = self._compatible(key, word[begin[at] : at], token, suffix)
            if ok:
                return at, number
        raise ValueError(f"the vocabulary lacks a symbol of {word!r}")

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet, in the trie's depth-first order."""
        suffix, names = self.vocab.suffix, self.names
        coded = sorted([(w.encode().decode("latin-1").translate(self._latin), w) for w in words])
        # begin[i], last[i]: last token of the prefix of i symbols on the current path
        path = ""
        begin, last = [0], [0]
        for symbols, word in coded:
            full = len(symbols)
            stem = full - 1 if suffix else full
            same, most = 0, min(len(path), stem)
            if path[:most] == symbols[:most]:
                same = most
            else:
                while path[same] == symbols[same]:
                    same += 1
            begin[same + 1 :] = last[same + 1 :] = [UNTRIED] * (stem - same)
            if stem - same > DEEP:  # in order, so that no call goes deep
                for end in range(same + 1, stem + 1):
                    begin[end], last[end] = self._last(symbols, end, begin, last, "")
            path = symbols[:stem]
            tokens = []
            end = stem
            if suffix:
                end, number = self._last(symbols, full, begin, last, suffix)
                tokens.append(number)
            while end > 0:
                if last[end] == UNTRIED:
                    begin[end], last[end] = self._last(symbols, end, begin, last, "")
                tokens.append(last[end])
                end = begin[end]
            tokens.reverse()
            self.known[word] = (" ".join(map(str, tokens)), " ".join([names[t] for t in tokens]))

    def _recall(self, fresh: set[str]) -> None:
        """Make all of these words young: from the old ones, or by encoding."""
        if len(self.known) > REMEMBERED:
            self.known, self._older = {}, self.known
        missing = fresh - self.known.keys()
        again = missing & self._older.keys()
        for word in again:
            self.known[word] = self._older[word]
        self.learn(missing - again)

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by a space, and their decoding."""
        split = []
        fresh: set[str] = set()
        for text in texts:
            parts = []
            for part in self.vocab.parts(text or ""):
                if part in self.vocab.special:
                    parts.append(part)
                elif part:
                    found = self.vocab.pretokens(part)
                    fresh.update(found)
                    parts.append(found)
            split.append(parts)
        self._recall(fresh)
        return [self._join(parts) for parts in split]

    def _join(self, parts: list) -> tuple[int, str, str]:
        ids, tokens = [], []
        for part in parts:
            if isinstance(part, str):
                ids.append(str(self.vocab.special[part]))
                tokens.append(part)
            elif part:
                coded, shown = zip(*map(self.known.__getitem__, part), strict=True)
                ids.extend(coded)
                tokens.extend(shown)
        joined = " ".join(ids)
        return joined.count(" ") + 1 if ids else 0, joined, " ".join(tokens)


_ENCODERS: dict[str, TrieEncoder] = {}


def encode_documents(docs: DataFrame, name: str = VOCABULARY, texts: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids, as the tokenizers library does without added tokens.

    Returns one row per input row: doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by a space), decoded_sha256; with ``texts`` also the ids and the
    decoded text. The file's vocabulary has no decoder, so decoding joins token
    strings by a space. Null counts as empty: no tokens, empty decoding. A special
    string inside a text is its own id. Repeated rows and null ids are rows like
    any other, a table without rows gives none, and texts are encoded whole,
    however long they or their words are. Other columns are ignored.
    """

    def rows(batches):
        if name not in _ENCODERS:
            _ENCODERS[name] = TrieEncoder(vocabulary(name))
        encoder = _ENCODERS[name]
        for batch in batches:
            column = batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                coded = encoder.encode(column.slice(at, 1000).to_pylist())
                arrays = [batch.column("doc_id").slice(at, 1000), pa.array([n for n, _, _ in coded], pa.int64())]
                arrays += [pa.array([hashlib.sha256(c[k].encode()).hexdigest() for c in coded]) for k in (1, 2)]
                if texts:
                    arrays += [pa.array([[int(x) for x in ids.split()] for _, ids, _ in coded], pa.list_(pa.int32())), pa.array([d for _, _, d in coded], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if texts else [])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))

"""Byte-pair vocabularies of the tokenizers library: pre-tokens, merges and offline proofs."""

from __future__ import annotations

import heapq
import json
import re

#: Letters, numbers and white space of Latin-1 by Unicode category and property (fixed values).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: The library's two patterns for texts in Latin-1, where the classes above are exact.
BYTE_PATTERN = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_PATTERN = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def tokenizer_path(name: str) -> str:
    """A path as given, or the place of one of the public tokenizer files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: ids, merge ranks, special strings and pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        asked = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        self.plain = spec["model"].get("type") == "BPE" and not any(spec["model"].get(x) for x in asked) and spec.get("normalizer") is None
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte_characters = byte_characters()
        self._shown = dict(enumerate(self.byte_characters))
        self.pattern = WORD_PATTERN if self.suffix else BYTE_PATTERN

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        return self._special.split(text) if any(x in text for x in self.special) else [text]

    def pretokens(self, part: str) -> list[str]:
        """What the merges work on. Latin-1 goes by pattern, other text through the library's own normalizer and splitter."""
        if len(part) == len(part.encode("latin-1", "ignore")):
            return self.pattern.findall(part.lower() if self.suffix else part)
        if self.library.normalizer is not None:
            part = self.library.normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def merged_ids(self, pretoken: str) -> list[int]:
        """The tokens that the library's own merges leave of one pre-token."""
        return [t.id for t in self.library.model.tokenize(pretoken.encode().decode("latin-1").translate(self._shown))]

    def merged_length(self, pretoken: str) -> int:
        return len(self.merged_ids(pretoken))

    def symbols(self, pretoken: str) -> list[str]:
        """A pre-token as the byte characters that merges start from, the last with the end-of-word suffix."""
        out = [self.byte_characters[b] for b in pretoken.encode()]
        if self.suffix:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if len(symbols) > 40:
            return self._merge_long(symbols)
        while len(symbols) > 1:
            best, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap over linked places, for long pre-tokens."""
        s: list[str | None] = list(symbols)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(s) and (r := self.ranks.get(p := (s[i], s[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, p))

        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i] if s[i] is not None else len(s)
            if j >= len(s) or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(s):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in s if x is not None]

    def proven_single(self) -> dict[str, int]:
        """Pre-tokens that are one token whole.

        A vocabulary string counts once it is proven: its bytes are a text, the
        text is one pre-token, and the merges turn that into this one token.
        """
        place = {c: b for b, c in enumerate(self.byte_characters)}
        proven = {}
        for token, number in self.ids.items():
            raw = token.removesuffix(self.suffix) if self.suffix else token
            if self.suffix and not token.endswith(self.suffix):
                continue
            try:
                text = bytes(place[c] for c in raw).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and text not in self.special and self.pretokens(text) == [text] and self.merge(self.symbols(text)) == [token]:
                proven[text] = number
        return proven


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker process."""
    path = tokenizer_path(name)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]

"""Strings by character, with the edge rules of the SQL standard's common dialect."""

from __future__ import annotations

import re
import string
from re import _parser  # the standard library's reader of patterns

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """The characters in the window from ``start``; places before the first are empty, not counted from the end."""
    begin = F.greatest(start.cast("bigint"), F.lit(1).cast("bigint"))
    if length is None:
        return F.substr(s, begin.cast("int"))
    end = F.greatest(start.cast("bigint") + length.cast("bigint"), begin)
    cut = F.substr(s, F.least(begin, F.lit(2**31 - 1)).cast("int"), F.least(end - begin, F.lit(2**31 - 1)).cast("int"))
    return F.when(length < 0, F.raise_error(F.lit("22011: negative substring length not allowed")).cast("string")).otherwise(cut)


def left(s: Column, n: Column) -> Column:
    """First n characters; a negative n drops the last -n."""
    wanted = F.when(n >= 0, n.cast("bigint")).otherwise(F.greatest(F.char_length(s).cast("bigint") + n.cast("bigint"), F.lit(0)))
    return F.substr(s, F.lit(1), wanted.cast("int"))


def right(s: Column, n: Column) -> Column:
    """Last n characters; a negative n drops the first -n."""
    size = F.char_length(s).cast("bigint")
    first = F.when(n >= 0, F.greatest(size - n.cast("bigint"), F.lit(0)) + 1).otherwise(-n.cast("bigint") + 1)
    return F.substr(s, F.least(first, F.lit(2**31 - 1)).cast("int"))


def concat(*parts: Column) -> Column:
    """Join, skipping nulls; never null."""
    return F.concat_ws("", *parts)


def lower_ascii(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def upper_ascii(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def upper_single(s: Column) -> Column:
    """Upper case by single characters: one whose upper case is several stays as it is."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(F.char_length(F.upper(c)) == F.char_length(c), F.upper(c)).otherwise(c)), "")


def lower_single(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when(F.char_length(F.lower(c)) == F.char_length(c), F.lower(c)).otherwise(c)), "")


def char_key(s: Column) -> Column:
    """What a blank-padded char(n) value is compared, grouped and joined by."""
    return F.rtrim(s)


def char_pad(s: Column, n: int) -> Column:
    """The stored form of a char(n) value, which LIKE and octet_length see."""
    return F.rpad(s, n, " ")


class _Shape:
    """Checks that a pattern can match any text in one way only, so that every rule of preference finds the same match.

    Sets of characters are told apart by the characters that the pattern names,
    their neighbours and one that it does not name.
    """

    def __init__(self, pattern: str):
        self.tree = _parser.parse(pattern, re.DOTALL)
        self.samples = {chr(min(max(ord(c) + d, 0), 0x10FFFF)) for c in pattern for d in (-1, 0, 1)} | set("5x_ \n") | {"\U0010fffe"}

    def _refuse(self, what: str):
        raise ValueError(f"a pattern with {what} may match in several ways")

    def _set(self, op, value) -> set[str]:
        name = str(op)
        if name == "LITERAL":
            return {chr(value)}
        if name == "NOT_LITERAL":
            return self.samples - {chr(value)}
        if name == "ANY":
            return self.samples
        found, negated = set(), False
        for kind, part in value:
            if str(kind) == "NEGATE":
                negated = True
            elif str(kind) == "LITERAL":
                found.add(chr(part))
            elif str(kind) == "RANGE":
                found |= {c for c in self.samples if part[0] <= ord(c) <= part[1]}
            else:  # a class by its letter, as in \\d
                kind = str(part).removeprefix("CATEGORY_")
                letter = {"DIGIT": "d", "SPACE": "s", "WORD": "w"}[kind.removeprefix("NOT_")]
                found |= {c for c in self.samples if bool(re.match(f"\\{letter}", c, re.ASCII)) != kind.startswith("NOT_")}
        return self.samples - found if negated else found

    def check(self, items: list, after: set[str]) -> tuple[set[str], bool]:
        """First characters of a sequence and whether it may be empty; ``after`` is what may follow it."""
        first, empty = set(after), True
        for op, value in reversed(items):
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "ANY", "IN"):
                first, empty = self._set(op, value), False
            elif name == "SUBPATTERN" and value[0] is None:
                inner, may = self.check(list(value[3]), first)
                first, empty = inner | first if may else inner, empty and may
            elif name == "MAX_REPEAT":
                low, high, body = value
                begin, _ = self.check(list(body), set())
                inner, may = self.check(list(body), first | (begin if high > 1 else set()))
                if may:
                    self._refuse("a repeated part that may be empty")
                own, _ = self.check(list(body), set())
                if high != low and own & first:
                    self._refuse("a repeated part that begins like what follows it")
                first, empty = (own | first, empty) if low == 0 else (own, False)
            else:
                self._refuse({"BRANCH": "alternatives", "GROUPREF": "back references", "MIN_REPEAT": "reluctant repetition", "SUBPATTERN": "groups inside groups"}.get(name, name.lower()))
        return first, empty

    def segments(self) -> tuple[list[list], bool]:
        """The parts before, in and behind each top-level group, and whether the pattern ends at the text's end."""
        items = list(self.tree)
        if items and str(items[0][0]) == "AT" and str(items[0][1]) == "AT_BEGINNING":
            items = items[1:]
        closed = bool(items) and str(items[-1][0]) == "AT" and str(items[-1][1]) == "AT_END"
        out: list[list] = [[]]
        for op, value in items[:-1] if closed else items:
            if str(op) == "SUBPATTERN" and value[0] is not None:
                out += [list(value[3]), []]
            else:
                out[-1].append((op, value))
        return out, closed


def checked_pattern(pattern: str) -> str:
    """The pattern for Java's engine, if its match and its groups do not depend on the engine's preferences.

    The rule to meet: the leftmost and then longest match, cut at the top-level
    groups so that every part in turn ends as late as possible. Java takes the
    first way that it tries. Both agree if each part between group borders can
    match in one way only and the pattern ends with ``$``, or if the whole can.
    Anything else is refused.
    """
    shape = _Shape(pattern)
    parts, closed = shape.segments()
    if closed:
        for part in parts:
            shape.check(part, set())
        return re.sub(r"\$\Z", lambda m: r"\z", pattern)
    shape.check([item for part in parts for item in part], set())
    return pattern


def regexp_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """Replace the leftmost match; ``\\1``..``\\9`` and ``\\&`` refer to it.

    The pattern is wrapped so that it can match once only: all before the
    first match is kept by a lazy group. Patterns whose match depends on an
    engine's preferences, and back references, are refused.
    """

    def reference(m: re.Match) -> str:
        c = m[1]
        return "$2" if c == "&" else f"${int(c) + 2}" if c.isdigit() else re.escape(c)

    text = re.sub(r"\$", r"\\$", re.sub(r"\\([0-9&\\])", lambda m: f"\0{m[1]}", replacement))
    text = re.sub("\0(.)", reference, text)
    return F.regexp_replace(s, rf"(?s)\A(.*?)({checked_pattern(pattern)})", "$1" + text)


def compare_locale(a: Column, b: Column, collation: str = "UNICODE") -> Column:
    """-1, 0 or 1 by the order of a locale (language, then case and accents), null if either is null."""
    x, y = F.collate(a, collation), F.collate(b, collation)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def min_locale(s: Column, collation: str = "UNICODE") -> Column:
    return F.min(F.collate(s, collation)).cast("string")


def max_locale(s: Column, collation: str = "UNICODE") -> Column:
    return F.max(F.collate(s, collation)).cast("string")

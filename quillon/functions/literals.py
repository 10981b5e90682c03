"""Texts of Python literals and damaged JSON, read by one state machine and written as JSON.

The machine keeps its open brackets on a stack of its own, so nesting costs no
recursion. It knows strings in either quote and in three, their escapes and prefixes,
adjacent strings, numbers of all bases, signs, underscores, tuples, sets, comments and
the names None, True and False; what stands inside a string is never touched.

With repair=True nothing is an error: brackets and strings left open at the end are
closed, a closing bracket closes what was forgotten within, missing commas and quotes
are supplied, JSON's names and bare words are values, and a key without a value goes.

JSON has neither tuples nor sets nor keys that aren't strings: the first two become
arrays (a set's without repeats), keys the text JSON would give them. Bytes, complex
numbers, `...`, infinite numbers and half surrogates have no JSON and give none (a
repair replaces the latter).
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = re.compile(r"[+-]?\s*(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?)")
NAME = re.compile(r"[A-Za-z_]\w*")
BARE = re.compile(r"[^,:\[\]{}()\n\"']+")
ESCAPES = {"\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\n": ""}
CLOSES = {"[": "]", "{": "}", "(": ")"}
NAMES = {"None": None, "True": True, "False": False}
JSON_NAMES = {"null": None, "true": True, "false": False, "NaN": None, "undefined": None}
_NOTHING = object()


class Broken(ValueError):
    """The text is no literal, or has no JSON."""


class _Frame:
    """An open bracket: what it holds so far, and what may come next ('item', 'after', 'value')."""

    __slots__ = ("kind", "items", "keys", "commas", "next", "joins")

    def __init__(self, kind: str):
        self.kind, self.items, self.keys, self.commas, self.next, self.joins = kind, [], [], 0, "item", False

    def put(self, value: object, text: bool, repair: bool) -> None:
        if self.next == "after":
            if text and self.joins and not repair:  # adjacent strings are one
                side = self.items if self.kind != "{" or len(self.items) == len(self.keys) and self.items else self.keys
                side[-1] += value
                return
            if not repair:
                raise Broken("a comma is missing")
            if self.kind == "{" and len(self.keys) > len(self.items) and self.items:
                self.keys.pop()  # a key without a value
        (self.items if self.kind != "{" or self.next == "value" else self.keys).append(value)
        self.next, self.joins = "after", text

    def comma(self, repair: bool) -> None:
        if self.next != "after":
            if repair:
                return
            raise Broken("a comma without an item")
        if self.kind == "{" and self.items and len(self.keys) > len(self.items):
            if not repair:
                raise Broken("a key without a value")
            self.keys.pop()
        self.commas, self.next, self.joins = self.commas + 1, "item", False

    def colon(self, repair: bool) -> None:
        ok = self.kind == "{" and self.next == "after" and len(self.keys) == len(self.items) + 1
        if not ok:
            if repair:
                return
            raise Broken("a colon out of place")
        self.next, self.joins = "value", False

    def close(self, repair: bool) -> object:
        if self.kind != "{":
            if self.kind == "(" and self.commas == 0 and len(self.items) == 1:
                return self.items[0]
            if self.kind == "(" and not self.items and self.commas:
                raise Broken("a comma without an item")
            return self.items
        if self.items or self.next == "value" or (repair and self.keys):
            if len(self.keys) != len(self.items) or self.next == "value":
                if not repair:
                    raise Broken("a key without a value")
                del self.keys[len(self.items) :]
            if any(isinstance(k, (list, dict)) for k in self.keys):
                raise Broken("no key in JSON")
            return {k if isinstance(k, str) else json.dumps(k): v for k, v in dict(zip(self.keys, self.items, strict=True)).items()}
        if not self.keys:
            return {}
        seen: list[object] = []
        for k in self.keys:
            if isinstance(k, (list, dict)) and not isinstance(k, _Tuple):
                raise Broken("a set holds no lists")
            if not any(type(k) is type(x) and k == x or isinstance(k, (int, float)) and isinstance(x, (int, float)) and k == x for x in seen):
                seen.append(k)
        return seen


class _Tuple(list):
    """A tuple's items: an array in JSON, but fit for a set."""


def _string(text: str, i: int, raw: bool, repair: bool) -> tuple[str, int]:
    """The string whose quote stands at i, and the place after it."""
    quote = text[i] * 3 if text.startswith(text[i] * 3, i) and not repair else text[i]
    i += len(quote)
    out = []
    while i < len(text):
        c = text[i]
        if text.startswith(quote, i):
            return _joined(out, repair), i + len(quote)
        if c == "\n" and len(quote) == 1 and not repair:
            raise Broken("a line ends within a string")
        if c != "\\":
            out.append(c)
            i += 1
            continue
        if i + 1 >= len(text):
            break
        e = text[i + 1]
        i += 2
        if raw:
            out.append("\\" + e)
        elif e in ESCAPES:
            out.append(ESCAPES[e])
        elif e == "/" and repair:
            out.append("/")
        elif e in "01234567":
            m = re.compile("[0-7]{1,3}").match(text, i - 1)
            out.append(chr(int(m[0], 8)))
            i = m.end()
        elif e in "xuU":
            size = {"x": 2, "u": 4, "U": 8}[e]
            digits = text[i : i + size]
            if not re.fullmatch(f"[0-9a-fA-F]{{{size}}}", digits) or int(digits, 16) > 0x10FFFF:
                if not repair:
                    raise Broken("a broken escape")
                continue
            out.append(chr(int(digits, 16)))
            i += size
        elif e == "N" and text.startswith("{", i):
            import unicodedata

            end = text.find("}", i)
            try:
                out.append(unicodedata.lookup(text[i + 1 : end]))
            except KeyError as unknown:
                raise Broken("an unknown character name") from unknown
            i = end + 1
        else:
            out.append("\\" + e)
    if repair:
        return _joined(out, repair), i
    raise Broken("a string without an end")


def _joined(out: list[str], pairs: bool) -> str:
    """The characters as one string; JSON writes those beyond 16 bits as pairs of escapes, a half that is left is replaced."""
    text = "".join(out)
    if not pairs or not any("\ud800" <= c <= "\udfff" for c in text):
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _number(token: str) -> int | float:
    sign, digits = (-1, token[1:].strip()) if token[0] == "-" else (1, token[1:].strip()) if token[0] == "+" else (1, token)
    if digits[:2].lower() in ("0x", "0o", "0b"):
        return sign * int(digits, 0)
    if re.fullmatch(r"[\d_]+", digits):
        if digits[0] == "0" and digits.strip("0_"):
            raise Broken("a number with a leading zero")
        return sign * int(digits)
    x = sign * float(digits)
    if math.isinf(x):
        raise Broken("an infinite number")
    return x


def parse(text: str, repair: bool = False) -> object:
    """The value of a text; Broken if it is no literal. Values are those of JSON."""
    stack: list[_Frame] = []
    root = _Frame("[")
    i, n = 0, len(text)

    def top() -> _Frame:
        return stack[-1] if stack else root

    def close() -> None:
        frame = stack.pop()
        value = frame.close(repair)
        if frame.kind == "(" and value is frame.items:
            value = _Tuple(value)
        top().put(value, False, repair)

    if not repair and text[:1] in ("\n", "\f") or not repair and text.lstrip(" \t")[:1] == "\n":
        text = text.lstrip()  # blank lines before; leading blanks are cut before reading, too
        n = len(text)
    while i < n:
        c = text[i]
        if c in " \t\r\n\f":
            if c == "\n" and not stack and root.items and not repair and text[i:].split("#")[0].strip():
                raise Broken("more than one line")
            i += 1
        elif c == "#" and not repair:
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif c == "\\" and text.startswith("\\\n", i) and not repair:
            i += 2
        elif c in CLOSES:
            if top().next == "after" and not repair:
                raise Broken("a comma is missing")
            stack.append(_Frame(c))
            i += 1
        elif c in "]})":
            if repair:
                if not any(CLOSES[f.kind] == c for f in stack):
                    i += 1
                    continue
                while CLOSES[stack[-1].kind] != c:
                    close()
            elif not stack or CLOSES[stack[-1].kind] != c:
                raise Broken("brackets don't match")
            close()
            i += 1
        elif c == ",":
            top().comma(repair)
            i += 1
        elif c == ":":
            top().colon(repair)
            i += 1
        elif c in "'\"":
            value, i = _string(text, i, False, repair)
            top().put(value, True, repair)
        elif (m := NUMBER.match(text, i)) and not (m.end() < n and (text[m.end()].isalnum() or text[m.end()] == "_")) and not (repair and BARE.match(text, m.end()) and BARE.match(text, m.end())[0].strip()):
            top().put(_number(m[0]), False, repair)
            i = m.end()
        elif m := NAME.match(text, i):
            word, end = m[0], m.end()
            if end < n and text[end] in "'\"" and word.lower() in ("r", "u") and not repair:
                value, i = _string(text, end, word.lower() == "r", repair)
                top().put(value, True, repair)
            elif word in NAMES and not (repair and BARE.match(text, end) and BARE.match(text, end)[0].strip()):
                top().put(NAMES[word], False, repair)
                i = end
            elif word == "set" and not repair and re.match(r"\s*\(\s*\)", text[end:]):
                top().put([], False, repair)
                i = end + re.match(r"\s*\(\s*\)", text[end:]).end()
            elif repair:
                word = BARE.match(text, i)[0]
                top().put(JSON_NAMES.get(word.strip(), word.strip()) if word.strip() in JSON_NAMES else word.strip(), False, repair)
                i += len(word)
            else:
                raise Broken(f"an unknown name: {word}")
        elif repair:
            m = BARE.match(text, i)
            if m and m[0].strip():
                top().put(m[0].strip(), False, repair)
            i = max(m.end() if m else 0, i + 1)
        else:
            raise Broken(f"what is {c!r}?")
    while stack:
        if not repair:
            raise Broken("a bracket is open")
        close()
    if root.commas and not repair:  # a tuple without brackets
        return root.items
    if not root.items or (len(root.items) > 1 and not repair):
        raise Broken("no value, or more than one")
    return root.items[0]


def to_json(text: str | None, repair: bool = False) -> str | None:
    """A text's value as JSON: JSON first, then the literal; None if it is neither. With repair=True any text with a bracket has one."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        try:
            value = parse(text if repair else text.lstrip(" \t"), repair)
        except (Broken, OverflowError):
            return None
    try:
        out = json.dumps(value, ensure_ascii=False, allow_nan=False)
        out.encode()
    except (ValueError, RecursionError):
        return None
    return out


def _udf(repair: bool):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: to_json(t, repair))

    return F.pandas_udf(run, "string")


def literal_json(x: Column) -> Column:
    """JSON of a column of literals; null if a text is none. Rows that are null cost nothing."""
    return _udf(False)(x)


def repaired_json(x: Column) -> Column:
    """JSON of a column of damaged JSON."""
    return _udf(True)(x)

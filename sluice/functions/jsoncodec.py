"""JSON values on the driver, for rules and small documents: long or double numbers, order kept, last duplicate wins."""

from __future__ import annotations

import math
import re

_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
_PLAIN = re.compile(r'[^"\\]*')
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_SHOWN = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_LITERALS = {"true": True, "false": False, "null": None}


class JsonError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def fail(self, message: str):
        raise JsonError(message, self.at)

    def value(self):
        c = self.skip()
        if c == "{":
            return self.members()
        if c == "[":
            return self.items()
        if c == '"':
            return self.string()
        for word, meant in _LITERALS.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return meant
        return self.number()

    def listed(self, close: str, one):
        self.at += 1
        if self.skip() == close:
            self.at += 1
            return
        while True:
            one()
            c = self.skip()
            self.at += 1
            if c == close:
                return
            if c != ",":
                self.at -= 1
                self.fail(f"expected , or {close}")

    def members(self) -> dict:
        out: dict = {}

        def one():
            if self.skip() != '"':
                self.fail("expected a string key")
            key = self.string()
            if self.skip() != ":":
                self.fail("expected :")
            self.at += 1
            out[key] = self.value()

        self.listed("}", one)
        return out

    def items(self) -> list:
        out: list = []
        self.listed("]", lambda: out.append(self.value()))
        return out

    def string(self) -> str:
        self.at += 1
        parts: list[str] = []
        while True:
            m = _PLAIN.match(self.text, self.at)
            parts.append(m[0])
            self.at = m.end()
            c = self.text[self.at : self.at + 1]
            if not c:
                self.fail("unterminated string")
            self.at += 1
            if c == '"':
                return "".join(parts)
            e = self.text[self.at : self.at + 1]
            if e == "u":
                digits = self.text[self.at + 1 : self.at + 5]
                if not re.fullmatch("[0-9a-fA-F]{4}", digits):
                    self.fail("bad \\u escape")
                parts.append(chr(int(digits, 16)))
                self.at += 5
            elif e in _ESCAPES and e:
                parts.append(_ESCAPES[e])
                self.at += 1
            else:
                self.fail("bad escape")

    def number(self):
        m = _NUMBER.match(self.text, self.at)
        if not m:
            self.fail("unexpected character" if self.at < len(self.text) else "unexpected end")
        if m[1] or m[2]:
            self.at = m.end()
            return float(m[0])
        n = int(m[0])
        if not -(2**63) <= n < 2**63:
            self.fail("number out of range")
        self.at = m.end()
        return n


def parse(text: str | None):
    """A value from JSON text; raises JsonError with the position."""
    if text is None or not text.strip():
        raise JsonError("empty input", 0)
    reader = _Reader(text)
    out = reader.value()
    if reader.skip():
        reader.fail("trailing content")
    return out


def serialize(value) -> str:
    """Compact JSON; of control characters only those with a short escape are escaped."""
    match value:
        case None:
            return "null"
        case bool():
            return "true" if value else "false"
        case str():
            return '"' + "".join(_SHOWN.get(c, c) for c in value) + '"'
        case int():
            return str(value)
        case float():
            return java_double(value)
        case dict():
            return "{" + ",".join(f"{serialize(str(k))}:{serialize(v)}" for k, v in value.items()) + "}"
        case list() | tuple():
            return "[" + ",".join(map(serialize, value)) + "]"
    raise TypeError(f"can't serialize {type(value).__name__}")


def java_double(x: float) -> str:
    """A double as the JVM prints it: plain from 1e-3 up to 1e7, scientific with a capital E beyond."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        out = repr(x)
        if "e" in out:
            out = f"{x:.20f}".rstrip("0")
        return out if "." in out and not out.endswith(".") else out.rstrip(".") + ".0"
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent:
        digits, _, exponent = f"{x:.17e}".partition("e")
        for n in range(17):
            short = f"{x:.{n}e}"
            if float(short) == x:
                digits, _, exponent = short.partition("e")
                break
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def java_text(value) -> str:
    """A value as the JVM would print it: null as nothing, lists as [a, b], maps as {k=v}."""
    match value:
        case None:
            return ""
        case bool():
            return "true" if value else "false"
        case float():
            return java_double(value)
        case dict():
            return "{" + ", ".join(f"{k}={'null' if v is None else java_text(v)}" for k, v in value.items()) + "}"
        case list() | tuple():
            return "[" + ", ".join("null" if v is None else java_text(v) for v in value) + "]"
    return str(value)

"""Canonical JSON: sorted keys, no white space, printable ASCII, number text kept.

``decode`` keeps numbers as their source text (``Number``), so integers never
pass through a float; ``encode`` fails on anything but objects with printable
ASCII keys, arrays, printable ASCII strings, numbers, integers, booleans and null.
"""

from __future__ import annotations

import hashlib
import json


class CanonError(ValueError):
    """A value without a canonical form."""


class Number(str):
    """A JSON number as it was written."""

    def as_int64(self) -> int | None:
        if not self.lstrip("-").isdigit() or not self.isascii():
            return None
        value = int(self)
        return value if -(1 << 63) <= value < 1 << 63 else None


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def decode(data: bytes | str):
    """The first JSON value of the data; what follows it is ignored. Invalid UTF-8 becomes replacement characters."""
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)  # not kept: it can't travel to executors
    return decoder.raw_decode(text, len(text) - len(text.lstrip(" \t\r\n")))[0]


def _string(x: str, path: str) -> str:
    for c in x:
        if c < " " or c == "\x7f":
            raise CanonError(f"canon: control character {_quoted(c)} in string {_text(x)} at {path or '$'}")
        if c > "~":
            raise CanonError(f"canon: non-ASCII rune {_quoted(c)} in string {_text(x)} at {path or '$'}")
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


#: How control characters print inside quotes: fixed values.
_SHORT = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\\": "\\\\"}


def _plain(c: str, quote: str) -> str:
    if c in _SHORT:
        return _SHORT[c]
    if c == quote:
        return "\\" + c
    if c < " " or c == "\x7f":
        return f"\\x{ord(c):02x}"
    return c if c.isprintable() else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}"


def _quoted(c: str) -> str:
    return "'" + _plain(c, "'") + "'"


def _text(x: str) -> str:
    return '"' + "".join(_plain(c, '"') for c in x) + '"'


def _encode(x, path: str) -> str:
    if x is None:
        return "null"
    if x is True or x is False:
        return "true" if x else "false"
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, str):
        return _string(x, path)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(_string(k, f"{path}.{k} (key)") + ":" + _encode(x[k], f"{path}.{k}") for k in sorted(x)) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_encode(v, f"{path}[{i}]") for i, v in enumerate(x)) + "]"
    raise CanonError(f"canon: unsupported type {type(x).__name__} at {path or '$'}")


def encode(x) -> bytes:
    return _encode(x, "").encode()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def strip_line(line: bytes) -> bytes:
    """Without one final LF, and then one final CR."""
    return line.removesuffix(b"\n").removesuffix(b"\r")

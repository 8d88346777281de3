"""Values written as text: numbers, vectors in brackets, lists and maps."""

from __future__ import annotations

import re

from ..types import DICT, FLOAT, INTEGER, LIST, STRING, VECTOR

_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(?:(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|inf|nan)", re.I)


def number(text: str):
    if _INT.fullmatch(text):
        return int(text)
    return float(text) if _FLOAT.fullmatch(text) else None


def parse(text: str, kind: str):
    """The value of a cell; None where it does not fit."""
    text = text if kind == STRING else text.strip()
    if kind == STRING:
        return text
    if kind == INTEGER:
        return int(text) if _INT.fullmatch(text) and abs(int(text)) < 2**63 else None
    if kind == FLOAT:
        found = number(text)
        return None if found is None else float(found)
    if kind == VECTOR and text[:1] == "[" and text[-1:] == "]":
        inner = text[1:-1].strip()
        parts = inner.split(",") if "," in inner else inner.split(";") if ";" in inner else inner.split()
        found = [number(p.strip()) for p in parts]
        return None if None in found else [float(x) for x in found]
    if kind == LIST and text[:1] == "[" and text[-1:] == "]":
        return [_plain(p) for p in _top(text[1:-1])]
    if kind == DICT and text[:1] == "{" and text[-1:] == "}":
        pairs = [(_plain(k), _plain(v)) for k, _, v in (_colon(p) for p in _top(text[1:-1]))]
        return [(k, v) for k, v in dict(pairs).items() if k is not None]
    return None


def _top(text: str, mark: str = ",") -> list[str]:
    """text cut at marks outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == mark and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]] if text.strip() else []


def _colon(part: str) -> tuple[str, str, str]:
    k, *v = _top(part, ":")
    return k, ":", ":".join(v)


def _plain(part: str) -> str | None:
    part = part.strip()
    if len(part) > 1 and part[0] == part[-1] and part[0] in "\"'":
        return part[1:-1]
    return part or None

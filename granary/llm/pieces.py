"""A piece model of the sentencepiece library: its file, its normaliser and its byte-pair merging."""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

SPACE = "▁"
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values point into a block of replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.block = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at start."""
        units, found = self.units, None
        if not units:
            return None
        shift = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = shift(units[0])
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= shift(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = at + 1 - start, self.block[value : self.block.index(b"\0", value)]
        return found

    def apply(self, text: str) -> tuple[str, list[int]]:
        """The mapped text, and for each of its characters and for its end the byte of the source where it starts."""
        data, out, source, at = text.encode(), [], [], 0
        while at < len(data):
            if hit := self.longest(data, at):
                size, new = hit[0], hit[1].decode()
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + size].decode()
            out.append(new)
            source += [at] * len(new)
            at += size
        return "".join(out), [*source, at]


class PieceModel:
    """Byte-pair piece models with byte fallback; others raise ValueError."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, float] = {}  # the lower, the sooner
        self.ids: dict[str, int] = {}
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.ids[text] = len(self.pieces)
                    self.rank[text] = -struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                self.pieces.append(text)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3) != 2 or USER in self.kinds or UNUSED in self.kinds or trainer.get(24) or not trainer.get(35):
            raise ValueError("only byte-pair models with byte fallback and without user-defined or unused pieces")
        self.charmap = CharMap(rules.get(2, b""))
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.escape = SPACE if rules.get(5, 1) else " "
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes = [bytes_[b] for b in range(256)]
        #: Characters that stand side by side in some piece: between any others no merge can happen.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.apart = not any(p[1] == SPACE != p[0] for p in self.pairs)  # a blank begins a segment of its own
        self.plain = not self.charmap.units and not self.squeeze and self.prefix and self.apart and self.escape == SPACE
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.apart else re.compile(r"[\s\S]+")

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The text that is cut into pieces, and for each character and the end its first byte in the source."""
        mapped, source = self.charmap.apply(text)
        if self.squeeze:
            keep = [i for i, c in enumerate(mapped) if c != " " or (i + 1 < len(mapped) and mapped[i + 1] != " " and i)]
            while keep and mapped[keep[0]] == " ":
                keep.pop(0)
            end = source[keep[-1] + 1] if keep else source[-1]
            mapped, source = "".join(mapped[i] for i in keep), [source[i] for i in keep] + [end]
        if mapped and self.prefix:
            mapped, source = " " + mapped, [source[0], *source]
        return mapped.replace(" ", self.escape), source

    def parts(self, segment: str) -> list[str]:
        """The segment cut where no piece could reach across."""
        pairs = self.pairs
        cuts = [i for i, (a, b) in enumerate(zip(segment, segment[1:]), 1) if a + b not in pairs]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def merge(self, part: str) -> tuple[list[str], int]:
        """Heap and linked list: pops the pair of lowest rank again and again. The symbols left, and the number of merges."""
        rank, n, done = self.rank.get, len(part), 0
        end, begin = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that begins, or ends, at a place; 0 once merged
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, b, c = heappop(heap)
            if end[a] != b or end[b] != c:
                continue  # one of them has been merged since
            end[a], end[b], begin[c] = c, 0, a
            done += 1
            if c < n and (r := rank(part[a : end[c]])) is not None:
                heappush(heap, (r, a, c, end[c]))
            if a and (r := rank(part[begin[a] : c])) is not None:
                heappush(heap, (r, begin[a], a, c))
        return [part[a:b] for a, b in enumerate(end) if b], done

"""Secret scans by assignment-aware lexing.

Three patterns give the base findings. Beside them, lines that hold an assignment are cut into names, literals and
operators (source code, key-value files, YAML, JSON, XML elements); constants are carried from name to name and through
concatenations; a literal that reaches a name is scored by how sensitive the name is and how little the literal looks
like a placeholder, and kept as kind `literal` from a score of 0.5 up.

The time is linear in the text, whatever it assigns: a constant keeps its first VALUE characters and a tree of the places
it was written at, of which each is told once; a quote that is not closed on its line is no quote on the rest of it.

Null texts count as empty and give no finding; texts are read whole, however long; findings of one kind do not overlap;
repeated rows give repeated rows; an empty table gives an empty one; columns besides key and text are not read by
secret_scan and pass unchanged in redact. Positions are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small_batches

# The base patterns, as the query's contract gives them. The lengths asked for hold for whole runs of
# letters and digits in the last two, so they can stand in the patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
# Parts of names and how sensitive each makes a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0,
    "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0,
    "secretkey": 1.0, "authkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "auth": 0.6, "bearer": 0.8,
}
KEY_OWNERS = frozenset("api access private secret auth signing encryption master service account client".split())
MAYBE = re.compile(r"(?i:pass|pwd|secret|token|key|credential|auth|bearer)", re.ASCII)
HINTS = ("pass", "secret", "token", "api")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|your[_-].*|.*example.*|changeme|change[_-]me|placeholder|none|null|true|false|undefined|todo|\$\{.*\}|\$\(.*\)|<.*>|%.*%|\{\{.*\}\})$")
STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*"', "'": r"'(?:[^'\\\n]|\\.)*'", "`": r"`[^`\n]*`"}
PLAIN = (
    r"""(?P<comment>(?:^|(?<=\s))(?:\#|//).*)"""
    r"""|(?P<op>===|==|!=|<=|>=|=>|:=|\+=|[=:+,;(){}\[\]<>])|(?P<word>[A-Za-z_$][\w$.-]*)|(?P<other>[^\s=:+,;(){}\[\]<>"'`]+|["'`])"""
)
#: Characters of a constant that concatenations carry on.
VALUE = 512
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]{6,})</\1>", re.ASCII)
#: A value without quotes: the source up to a blank, comma, semicolon, closing bracket or line end. Calls and indices are none.
BARE = re.compile(r"""[^\s,;(){}\[\]<>"'`]+(?=[\s,;)}\]]|$)""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(maxsize=8)
def tokens_with(quotes: str) -> re.Pattern:
    """Tokens of a line where these marks open strings."""
    strings = "|".join(STRINGS[q] for q in quotes)
    return re.compile((f"(?P<string>{strings})|" if strings else "") + PLAIN, re.ASCII | re.MULTILINE)


def tokens_of(line: str):
    """Matches of the tokens of a line; a mark that opens no string once opens none after that."""
    quotes, at = "\"'`", 0
    while True:
        closed = True
        for m in tokens_with(quotes).finditer(line, at):
            yield m
            if m[0] in quotes and m.lastgroup == "other":
                quotes, at, closed = quotes.replace(m[0], ""), m.end(), False
                break
        if closed:
            return


class Place:
    """Where a constant was written: spans, and the places of the constants it is made of; told is set once all have been found."""

    __slots__ = ("spans", "parts", "told")

    def __init__(self, spans: list[tuple[int, int]], parts: list[Place]):
        self.spans, self.parts, self.told = spans, parts, False


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0) for p in [*parts, *map("".join, zip(parts, parts[1:]))]), default=0)
    return max(best, 0.9 if any(a in KEY_OWNERS and b in ("key", "keys") for a, b in zip(parts, parts[1:])) else 0)


def strength(value: str) -> float:
    """0 for what cannot be a secret, up to 1 for long values of many different characters."""
    if len(value) < 6 or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 3.5) if mixed >= 2 else min(1.0, bits / 3.5) * (0.7 if len(value) >= 12 else 0.5)


def base(text: str) -> list[tuple[str, int, int]]:
    """Findings of the three patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(found), key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


class Lexer:
    """Name-literal pairs of one text; constants known so far by name."""

    def __init__(self):
        self.known: dict[str, tuple[str, Place]] = {}
        self.found: list[tuple[str, int, int]] = []

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        at = 0
        for stop in re.finditer(r"[=:]", text):
            if stop.start() >= at:
                first = text.rfind("\n", 0, stop.start()) + 1
                at = (text.find("\n", stop.start()) + 1) or len(text) + 1
                self.line(text[first : at - 1], first)
        for m in ELEMENT.finditer(text):
            self.pair(m[1], m[2], Place([(m.start(2), m.end(2))], []))
        found, end = [], 0
        for f in sorted(set(self.found), key=lambda f: (f[1], -f[2])):  # one inside another goes
            if f[2] > end:
                found.append(f)
                end = f[2]
        return found

    def line(self, line: str, first: int) -> None:
        tokens = [(m.lastgroup, m[0], first + m.start(), first + m.end()) for m in tokens_of(line) if m.lastgroup != "comment"]
        i = 0
        while i + 2 < len(tokens):
            kind, name, _, _ = tokens[i]
            if kind not in ("word", "string") or tokens[i + 1][1] not in ("=", ":", ":=", "=>", "+="):
                i += 1
                continue
            op, j = tokens[i + 1][1], i + 2
            if op == ":" and j + 2 < len(tokens) and tokens[j][0] == "word" and tokens[j + 1][1] == "=":
                typed = BARE.match(line, tokens[j][2] - first)
                if not typed or first + typed.end() <= tokens[j][3]:
                    j += 2  # a type between name and value
            got = self.value(tokens, j)
            bare = BARE.match(line, tokens[j][2] - first)
            if got and bare and tokens[got[2] - 1][3] < first + bare.end():
                got = None  # a known name that only begins the value
            name = name.strip("\"'`")
            if got:
                value, where, i = got
                if op == "+=" and name in self.known:
                    value, where = self.known[name][0] + value, Place([], [self.known[name][1], where])
                self.known[name] = value[:VALUE], where
                self.pair(name, value, where)
            else:
                i = j
                if bare and any(c.isdigit() for c in bare[0]):  # a bare value of a key-value file
                    end = first + bare.end()
                    after = next((k for k in range(j, len(tokens)) if tokens[k][2] >= end), len(tokens))
                    if after == len(tokens) or tokens[after][1] != "+":
                        before = len(self.found)
                        where = Place([(first + bare.start(), end)], [])
                        self.known[name] = bare[0][:VALUE], where
                        self.pair(name, bare[0], where)
                        i = after if len(self.found) > before else j  # else assignments inside it are read

    def value(self, tokens: list, j: int):
        """What a literal, a known name or a sum of them comes to, where it was written, and the next token."""
        values, where = [], Place([], [])
        while j < len(tokens):
            kind, word, a, b = tokens[j]
            if kind == "string" and len(word) >= 2:
                values.append(word[1:-1])
                where.spans.append((a + 1, b - 1))
            elif kind == "word" and word in self.known:
                value, place = self.known[word]
                values.append(value)
                where.parts.append(place)
            else:
                return None
            if j + 1 >= len(tokens) or tokens[j + 1][1] != "+":
                return "".join(values), where, j + 1
            j += 2
        return None

    def pair(self, name: str, value: str, where: Place) -> None:
        if (sensitive := sensitivity(name)) < 0.5 or sensitive * strength(value) < 0.5:
            return
        todo = [where]
        while todo:
            place = todo.pop()
            if not place.told:
                place.told = True
                self.found += [("literal", a, b) for a, b in place.spans if b > a]
                todo += place.parts


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings and all findings."""
    if not text:
        return [], []
    found = base(text)
    if ("=" in text or ":" in text or "</" in text) and MAYBE.search(text):
        return found, ordered(found + Lexer().scan(text))
    return found, found


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of findings, overlapping ones taken together, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda f: f[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans and n_literal of every whole text."""
    small_batches(session_of(docs))

    def run(batches):
        for batch in batches:
            got = [scan(t) for t in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(f[0] == kind for f in a) for _, a in got], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(count, KINDS[:3]), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([written(a) for _, a in got], pa.string()), count(KINDS[3])],
                [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
            )

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, findings in the text replaced by the mark; null texts stay null."""
    small_batches(session_of(docs))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [redacted(t, scan(t)[1], mark) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

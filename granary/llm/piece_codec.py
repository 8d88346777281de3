"""Offset-preserving encoding into pieces, and decoding.

A text is normalised by longest prefixes of the compiled character map, which records for each character the source
byte it came from; the pieces found in the normalised text are projected through that record to spans of source bytes.
Of the bytes that stand in for an unknown character the last holds its span and those before it hold empty ones.
Where the map is empty, the record is implied by the lengths of the pieces and is kept as one array for each text.

Null texts count as empty (no tokens, empty decoded text); repeated rows give repeated rows; an empty table gives an
empty one; columns besides the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, session_of, small_batches
from .pieces import BYTE, CONTROL, SPACE, UNKNOWN, PieceModel


class Codec:
    """Encoding with spans and decoding for one piece model."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.normal = set(self.model.ids.values())
        self.part = Cache(self._part)
        self.mapped = Cache(self._mapped)
        self.word = Cache(self._word)

    def _part(self, part: str) -> tuple[list[int], list[int]]:
        """Identifiers of a part and the characters that each covers."""
        model, ids, sizes = self.model, [], []
        for s in model.merge(part)[0]:
            known = model.ids.get(s)
            if known is not None:
                ids.append(known)
                sizes.append(len(s))
            else:
                data = s.encode()
                ids += [model.bytes[b] for b in data]
                sizes += [0] * (len(data) - 1) + [len(s)]
        return ids, sizes

    def _segment(self, segment: str) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for a, b in map(self.part.__getitem__, self.model.parts(segment)):
            ids += a
            sizes += b
        return ids, sizes

    def _mapped(self, part: str) -> tuple[str, bytes, str]:
        """Of a part of a word after one blank: identifiers joined by commas, the source bytes of each piece, the decoded text."""
        ids, sizes = self._part(part)
        spans = sizes
        if not part[part[0] == SPACE :].isascii():
            at, spans = 0, []
            for size in sizes:
                spans.append(len(part[at : at + size].encode()) - 2 * (at == 0 < size and part[0] == SPACE))  # the mark for a blank takes three bytes
                at += size
        return ",".join(map(str, ids)), array("I", spans).tobytes(), self.pieces_text(ids)

    def _word(self, word: str) -> tuple[str, bytes, str]:
        """The same of the whole word; no character's bytes reach from one part into the next."""
        found = [self.mapped[part] for part in self.model.parts(SPACE + word)]
        if len(found) == 1:
            return found[0]
        ids, spans, texts = zip(*found)
        return ",".join(ids), b"".join(spans), "".join(texts)

    def pieces_text(self, ids: list[int]) -> str:
        """Text of the pieces, blanks restored, the first one too."""
        model, out, held = self.model, [], bytearray()
        if self.normal.issuperset(ids):
            return "".join(map(model.pieces.__getitem__, ids)).replace(SPACE, " ")
        for i in ids:
            if model.kinds[i] == BYTE:
                held.append(int(model.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_text(bytes(held)))
                held.clear()
            if model.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif model.kinds[i] != CONTROL:
                out.append(model.pieces[i].replace(SPACE, " "))
        if held:
            out.append(_text(bytes(held)))
        return "".join(out)

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Identifiers, and the span of source bytes of each."""
        norm, source = self.model.normalise(text)
        ids, spans, at = [], [], 0
        for segment in self.model.segment.findall(norm):
            new, sizes = self._segment(segment)
            ids += new
            for size in sizes:
                spans.append((source[at], source[at + size]))
                at += size
        return ids, spans

    def decode(self, ids: list[int]) -> str:
        return self._stripped(self.pieces_text(ids))

    def _stripped(self, text: str) -> str:
        return text[1:] if self.model.prefix and text[:1] == " " else text

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of identifiers, hashes of them and of the decoded text, checksum of the spans' ends."""
        model = self.model
        if text and model.plain and text[0] != " " != text[-1] and "  " not in text and SPACE not in text:
            ids, spans, pieces = zip(*map(self.word.__getitem__, text.split(" ")))
            joined = ",".join(ids)
            sizes = np.frombuffer(b"".join(spans), "<u4")
            ends = np.maximum(np.cumsum(sizes, dtype="<i8") - 1, 0)  # the blank put before the text is not in the source
            n, decoded = len(sizes), self._stripped("".join(pieces))
        else:
            found, where = self.encode(text) if text else ([], [])
            joined, n, decoded = ",".join(map(str, found)), len(found), self.decode(found)
            ends = np.array([b for _, b in where], "<i8")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return n, sha(joined), sha(decoded), zlib.crc32(ends.astype("<u4").tobytes())


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for each worker process, so that what it remembers outlives a task."""
    return Codec(path)


def _text(data: bytes) -> str:
    """UTF-8, each byte that is no part of a character as the replacement character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, starts and ends (source bytes) and the decoded text of every whole text."""
    small_batches(session_of(docs))

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            got = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([ids for ids, _ in got], pa.list_(pa.int32())),
                    pa.array([[a for a, _ in spans] for _, spans in got], pa.list_(pa.int64())),
                    pa.array([[b for _, b in spans] for _, spans in got], pa.list_(pa.int64())),
                    pa.array([codec.decode(ids) for ids, _ in got], pa.string()),
                ],
                [key, "ids", "starts", "ends", "decoded"],
            )

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same as digests: key, n_tokens, ids_sha256, decoded_sha256 and ends_crc32 (of the spans' ends as 32-bit numbers)."""
    small_batches(session_of(docs))

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            n, ids, decoded, ends = zip(*[codec.digest(t or "") for t in batch.column(1).to_pylist()]) if batch.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(ends, pa.int64())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"],
            )

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ends_crc32 bigint")

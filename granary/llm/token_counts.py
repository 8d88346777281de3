"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its initial symbols less the merges, plus the bytes that stand in for unknown characters; no
identifiers are made. Texts are cut where no piece of the vocabulary can reach across (before blanks, and between
characters that no piece holds side by side), and the counts of short cuts are remembered in a bounded cache.

Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty table gives an empty one;
columns besides the key and the text are not read. The longest texts are handled whole, in O(n log n).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, session_of, small_batches
from .pieces import SPACE, PieceModel


class Counter:
    """Counts of one piece model."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.part = Cache(self._part)
        self.word = Cache(self._word)

    def _part(self, part: str) -> int:
        symbols, merges = self.model.merge(part)
        known, count = self.model.ids, len(part) - merges
        return count + sum(len(s.encode()) - 1 for s in symbols if s not in known)

    def _segment(self, segment: str) -> int:
        return sum(map(self.part.__getitem__, self.model.parts(segment)))

    def _word(self, word: str) -> int:
        return self._segment(SPACE + word)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.model.plain and text[0] != " " != text[-1] and "  " not in text and SPACE not in text:
            return sum(map(self.word.__getitem__, text.split(" ")))
        return sum(map(self._segment, self.model.segment.findall(self.model.normalise(text)[0])))


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for each worker process, so that what it remembers outlives a task."""
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every whole text."""
    small_batches(session_of(docs))

    def run(batches):
        counter = counter_of(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [counter.count(t) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

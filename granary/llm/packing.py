"""Mixture-controlled packing of documents into sequences.

Documents are tokenised once into a table in the shared folder, which numbers its rows; a shard is a hash of that
number, about `shard_tokens` tokens, whatever keys repeat.
In a shard every source has a queue, and deficit round-robin fills one window after another: each source is credited its
target share of the window and gives as many tokens as its deficit allows, cutting documents freely; what a window still
lacks is dealt among the sources with tokens left. Deficits go from window to window and from shard to shard: what a
source is owed at the start of a shard is its target share of all tokens of the shards before, less what it gave there,
which sums over the counts of (shard, source) give without running the shards in turn. By default the target shares are
those of the corpus, so that all queues end together.

The stream of a shard is cut into sequences of `capacity` tokens; its rest, below capacity, into powers of two, which
need no padding. Null texts count as empty (they hold the end token alone); null sources form one source; repeated rows
are packed each; a text longer than a shard makes its shard longer, as no text is dealt to two; an empty table gives an
empty one; columns besides key, text and source are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, cut, session_of, small_batches

END = 0
# Fixed value: how the byte-level split cuts a text without blanks but the first.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Below it the letters and digits have been the same in all versions of Unicode that libraries use; words beyond go through the library.
SETTLED = "\u0530"
#: Shards in a block of running sums.
BLOCK = 1_024


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Encoder:
    """Identifiers of a byte-level pair tokenizer as arrays; words between single blanks, and their parts, are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.code, self.kind = ("H", "<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = rules.get("pre_tokenizer") or {}
        # The byte-level split starts a token at every blank or line end between visible characters; of others nothing is assumed.
        self.apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer")
        self.bare = Cache(self._bare, most=100_000)
        self.spaced = Cache(self._spaced, most=500_000)
        self.line_end = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Of what the split leaves whole: the model alone gives it."""
        return array(self.code, [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _bare(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < SETTLED):
            return self._part(word)
        if not word.isascii() and max(word) >= SETTLED:
            return self.ids(word)
        parts = SPLIT.findall(word)
        return self._part(word) if len(parts) == 1 else b"".join(map(self.bare.__getitem__, parts))

    def _spaced(self, word: str) -> bytes:
        """Of a word after a blank."""
        if word.isalpha() and (word.isascii() or max(word) < SETTLED):
            return self._part(" " + word)
        if not word.isascii() and max(word) >= SETTLED:
            return self.ids(" " + word)
        first, *parts = SPLIT.findall(" " + word)
        if not parts:
            return self._part(first)
        return (self.spaced[first[1:]] if first[0] == " " else self.bare[first]) + b"".join(map(self.bare.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """A blank or line end between two visible characters always starts a new token, so what stands between them can be encoded alone; any other text goes through the library as it is."""
        if not self.apart or any(m in text for m in self.marks):
            return self.ids(text)
        lines = text.split("\n")
        if not all(x and x[0] != " " != x[-1] and x.isprintable() and "  " not in x for x in lines):
            return self.ids(text)
        out, get = [], self.spaced.__getitem__
        for line in lines:
            first, *rest = line.split(" ")
            out.append(self.bare[first] + b"".join(map(get, rest)))
        return self.line_end.join(out)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return Encoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """k, s, n and ids of every whole text, the end token last; i numbers the rows, repeated ones and those without key too."""
    small_batches(session_of(docs))

    def run(batches):
        encoder, row = encoder_of(tokenizer_path), TaskContext.get().partitionId() << 40
        end, width = np.array([END], encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        for batch in batches:
            ids = [x + end for x in (encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist())]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(range(row, row + n), pa.int64()), pa.array([width] * n, pa.int32()), pa.array(ids, pa.binary())], ["k", "s", "n", "i", "width", "ids"])
            row += n

    picked = docs.select(F.col(key).cast("bigint"), F.col(text), F.coalesce(F.col(source).cast("string"), F.lit("")))
    return picked.mapInArrow(run, "k bigint, s string, n bigint, i bigint, width int, ids binary")


def rounds(queues: dict[str, deque], shares: dict[str, float], owed: dict[str, float], window: int):
    """Deficit round-robin: yields (document, start, length) in the order of the stream. A queue holds [document, start, length] lists."""
    left = {s: sum(d[2] for d in q) for s, q in queues.items()}
    deficit, order = {s: owed.get(s, 0.0) for s in queues}, sorted(queues)
    while any(left.values()):
        room = min(window, sum(left.values()))
        whole = sum(shares[s] for s in order if left[s])
        for s in order:
            deficit[s] += shares[s] * room
        wanted = {s: min(left[s], max(0, round(deficit[s]))) for s in order}
        while over := sum(wanted.values()) - room:
            if over > 0:  # more is owed than the window holds: the rest stays owed
                for s in sorted(order, key=lambda s: -wanted[s]):
                    cut_ = min(wanted[s], over, -(-over * wanted[s] // max(1, sum(wanted.values()))))
                    wanted[s] -= cut_
                    over -= cut_
                    if not over:
                        break
            else:  # sources that have run out leave room to the others
                open_ = [s for s in order if left[s] > wanted[s]]
                whole = sum(shares[s] for s in open_)
                for s in open_:
                    more = min(left[s] - wanted[s], -over, max(1, int(-over * shares[s] / whole)))
                    wanted[s] += more
                    over += more
                    if not over:
                        break
        for s in order:
            need = wanted[s]
            deficit[s] -= need
            left[s] -= need
            while need:
                head = queues[s][0]
                take = min(need, head[2])
                yield head[0], head[1], take
                head[1] += take
                head[2] -= take
                need -= take
                if not head[2]:
                    queues[s].popleft()


def bounds(total: int, capacity: int) -> list[int]:
    """Ends of the sequences of a stream: full ones, then powers of two."""
    ends = list(range(capacity, total + 1, capacity))
    rest, at = total % capacity, total - total % capacity
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def shard_of(shards: int) -> Column:
    """The shard of a row: by its number, so that repeated rows and rows without key are spread as others are."""
    return F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int")


def before(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, shard and sofar: what value sums to over the shards before, within blocks of shards and over whole blocks."""
    block = F.floor(F.col("shard") / BLOCK).alias("block")
    every = counts.groupBy(*keys, block, "shard").agg(F.sum(value).alias("v"))
    whole = every.groupBy(*keys, "block").agg(F.sum("v").alias("v"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "block", F.coalesce(F.sum("v").over(ahead(*keys).orderBy("block")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("v").over(ahead(*keys, "block").orderBy("shard")), F.lit(0))
    return every.select(*keys, "block", "shard", own.alias("own")).join(whole, [*keys, "block"]).select(*keys, "shard", (F.col("own") + F.col("base")).alias("sofar"))


def carried(dealt: DataFrame, total: int, targets: dict[str, float] | None = None) -> DataFrame:
    """shard, s, share and owed: what each source is owed at the start of each shard that holds it. dealt: shard, s, n."""
    counts = dealt.groupBy("shard", "s").agg(F.sum("n").alias("n"))
    by_source = counts.groupBy("s").agg(F.sum("n").alias("all"))
    if targets:
        listed = session_of(dealt).createDataFrame(list(targets.items()), "s string, target double")
        by_source = by_source.join(F.broadcast(listed), "s", "left").select("s", F.coalesce("target", F.lit(0.0)).alias("share"))
    else:
        by_source = by_source.select("s", (F.col("all") / F.lit(total)).alias("share"))
    given = before(counts, ["s"], "n").withColumnRenamed("sofar", "given")
    return given.join(by_source, "s").join(before(counts, [], "n"), "shard").select("shard", "s", "share", (F.col("share") * F.col("sofar") - F.col("given")).alias("owed"))


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 1024, window_sequences: int = 64, shard_tokens: int = 1_000_000, targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece (and ids, if asked for)."""
    tokens = cut(tokenised(docs, tokenizer_path, key, text, source), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    dealt = tokens.withColumn("shard", shard_of(max(1, -(-total // shard_tokens))))

    def run(group, state):
        shares, owed = (dict(zip(state.column("s").to_pylist(), state.column(c).to_pylist())) for c in ("share", "owed"))
        least = 1e-9  # sources without a target come when the others have none left
        shares = {s: max(x, least) for s, x in shares.items()}
        ks, ss, ns = (group.column(c).to_pylist() for c in ("k", "s", "n"))
        data, width = group.column("ids"), group.column("width")[0].as_py() if len(group) else 2
        queues: dict[str, deque] = {}
        order = group.column("i").to_pylist()
        for i in sorted(range(len(ks)), key=lambda i: (ks[i] is None, ks[i] or 0, ns[i], order[i])):
            queues.setdefault(ss[i], deque()).append([i, 0, ns[i]])
        ends = bounds(sum(ns), capacity)
        shard, at, seq, first, opened, rows = group.column("shard")[0].as_py() if len(group) else 0, 0, 0, 0, (None, None), []
        for doc, start, length in rounds(queues, shares, owed, capacity * window_sequences):
            if opened[0] != doc:
                opened = doc, np.frombuffer(data[doc].as_py(), f"<u{width}").astype("<u4")
            while length:
                take = min(length, ends[seq] - at)
                ids = opened[1][start : start + take]
                rows.append((ks[doc], start, take, zlib.crc32(ids.tobytes()), ns[doc], (shard << 32) + seq, at - first, *([ids] if with_ids else [])))
                start, length, at = start + take, length - take, at + take
                if at == ends[seq]:
                    seq, first = seq + 1, at
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    schema = pa.schema([(n, pa.int64()) for n in (key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int64()))] * with_ids)
    kinds = f"`{key}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    owed = carried(dealt, total, targets).toDF("shard", "s", "share", "owed")  # columns of its own, apart from those of dealt
    return dealt.groupBy("shard").cogroup(owed.groupBy("shard")).applyInArrow(run, kinds)

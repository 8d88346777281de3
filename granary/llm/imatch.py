"""I-Match fingerprints with randomised lexicons.

The lexicon keeps the terms whose document frequency lies in a band: at least `least_share` of all documents (and two)
and at most `most_share`. As a document holds some number of distinct terms, at most that number divided by least_share
terms can lie in the band, so its size does not grow with the corpus and it is broadcast. Each of the SLOTS lexicon
subsets keeps every term with its own probability, from 1 down by halves, by a hash of term and slot; a slot of the
fingerprint hashes the sorted distinct terms of the text that its subset keeps. Slots that keep no term stay empty.
The likeness of two fingerprints is the share of slots, of those filled in either, that are equal: slots with full
lexicons tell exact rearrangements, thinned ones follow the overlap of the terms.

A text without any term of the lexicon is hashed from all its terms, or from itself if it has none: one slot, so that
its likeness to another text is 1 or 0. Null texts count as empty. The next document of a row is the row that follows in
descending order of the key (ties by text; null keys last), of the last row the first; a lone row is its own next. Texts
are read whole, however long. Repeated rows give repeated rows; an empty table gives an empty one; columns besides key
and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small_batches

#: What is taken from both ends of a term.
MARKS = string.punctuation + "«»“”„‘’…–—¿¡。、，；：？！"
#: Slots, and how often in turn the share of terms that they keep is halved.
SLOTS = 48
HALVINGS = (0, 2, 4, 5, 6, 7, 7, 8, 8, 9, 9, 9, 10, 10, 10, 10)
EMPTY = "-" * 8
#: Ranges of the order, so that the list of their ends stays small; beyond, ranges hold more rows, which are streamed.
MOST_PARTS = 65_536
#: Rows looked at for each end of a range. Only where ranges end depends on them.
LOOKED_AT = 40
#: Characters of a text that tell where rows of one key are cut into ranges.
START = 64


def terms(text: str) -> set[str]:
    """Distinct lower-case words between blanks, without punctuation at their ends."""
    return {w for x in set(text.lower().split()) if (w := x.strip(MARKS))}


def lexicon(docs: DataFrame, text: str = "text", least_share: float = 0.002, most_share: float = 0.2) -> list[str]:
    """The terms in the band, in order; document frequencies are counted over all rows."""
    small_batches(session_of(docs))

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(terms(t))
            if len(seen) > 1_000_000:
                yield out()
                seen.clear()
        yield out()

    n = docs.count()
    counts = docs.select(F.col(text)).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= max(2, least_share * n)) & (F.col("n") <= max(2, most_share * n)))
    return sorted(row["term"] for row in band.select("term").collect())


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    """Independent uniform 64-bit numbers for each seed."""
    with np.errstate(over="ignore"):
        x = codes + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Fingerprinter:
    def __init__(self, lexicon: list[str]):
        self.index = {t: i for i, t in enumerate(lexicon)}
        self.codes = np.array([xxhash.xxh64_intdigest(t) for t in lexicon], "<u8")
        self.kept = np.empty((len(lexicon), SLOTS), bool)
        for slot in range(SLOTS):
            self.kept[:, slot] = _mixed(self.codes, slot + 1) < 2.0 ** (64 - HALVINGS[slot % len(HALVINGS)])

    def fingerprint(self, text: str) -> str:
        found = terms(text)
        index = sorted(map(self.index.__getitem__, found & self.index.keys()))
        if not index:
            return hashlib.sha1(" ".join(sorted(found)).encode() if found else b"\0" + text.encode()).hexdigest()
        kept = self.kept[index]
        data = self.codes[index][np.nonzero(kept.T)[1]].tobytes()  # the kept codes slot by slot, terms in order
        sizes = kept.sum(0)
        out, at = [], 0
        for size in sizes.tolist():
            end = at + 8 * size
            out.append(f"{xxhash.xxh32_intdigest(data[at:end]):08x}" if size else EMPTY)
            at = end
        return "".join(out)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) != len(b) or len(a) != 8 * SLOTS:
        return 0.0
    x, y = ([s[i : i + 8] for i in range(0, len(s), 8)] for s in (a, b))
    filled = [(p, q) for p, q in zip(x, y) if p != EMPTY or q != EMPTY]
    return sum(p == q for p, q in filled) / len(filled)


def fingerprints(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every whole text."""
    small_batches(session_of(docs))
    held = session_of(docs).sparkContext.broadcast(words)

    def run(batches):
        maker = Fingerprinter(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([maker.fingerprint(t or "") for t in batch.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, key: str, text: str, rows: int) -> tuple[DataFrame, int]:
    """Rows part, guest, the order (z, a, t), h (the start of t) and k, and the number of parts: parts of about `rows` rows, at most MOST_PARTS, by ranges of the order, with the first row of the next non-empty part as a guest at the end."""
    spark = session_of(docs)
    base = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Null keys last, then keys downwards, then texts: rows that share a key are split as others are, by how they start.
    base = base.select(F.col("k").isNull().cast("int").alias("z"), F.coalesce(F.bitwise_not("k"), F.lit(0)).alias("a"), F.substring("t", 1, START).alias("h"), "k", "t")
    n = base.select("k").count()
    wanted = max(1, min(n // rows, MOST_PARTS))
    seen = base.where(F.pmod(F.xxhash64("a", "t"), F.lit(n)) < LOOKED_AT * wanted).select("z", "a", "h").toArrow() if wanted > 1 else None
    cuts: list[tuple] = []
    if seen is not None and len(seen):  # at most about LOOKED_AT * MOST_PARTS rows of two numbers and a start
        seen = seen.sort_by([(c, "ascending") for c in "zah"])
        cuts = sorted(set(zip(*(seen[c].take([i * len(seen) // wanted for i in range(1, wanted)]).to_pylist() for c in "zah"))))
    # The part of a row is the number of cuts that do not follow it: first among every width-th cut, then among those between.
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    shape = "array<array<struct<z:int,a:bigint,h:string>>>"
    held = F.from_json(F.lit(json.dumps([[{"z": z, "a": a, "h": h} for z, a, h in g] for g in groups])), shape)
    row = F.struct("z", "a", "h")
    group = F.size(F.filter(F.transform(held, lambda g: g[0]), lambda c: c <= row))
    inside = F.size(F.filter(F.get(held, group - 1), lambda c: c <= row))
    part = F.when(group == 0, 0).otherwise((group - 1) * width + inside) if cuts else F.lit(0)
    parts = base.withColumn("part", part.cast("int"))
    # The first row of each part: one row for each part.
    first = parts.groupBy("part").agg(F.min(row).alias("f")).collect()
    order = sorted(r["part"] for r in first)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the part whose last row is followed by the first of p
    tops = spark.createDataFrame([(r["part"], *r["f"], before[r["part"]]) for r in first], "p int, fz int, fa bigint, fh string, host int")
    at_top = (F.col("part") == F.col("p")) & (F.col("z") == F.col("fz")) & (F.col("a") == F.col("fa")) & (F.col("h") == F.col("fh"))
    guests = parts.join(F.broadcast(tops), at_top).groupBy("host", "z", "a", "h", "k").agg(F.min("t").alias("t"))
    columns = ["z", "a", "h", "k", "t"]
    return parts.select("part", F.lit(False).alias("guest"), *columns).union(guests.select(F.col("host").alias("part"), F.lit(True), *columns)), len(cuts) + 1


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", part_rows: int = 4_000, least_share: float = 0.002, most_share: float = 0.2) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = session_of(docs)
    small_batches(spark)
    held = spark.sparkContext.broadcast(lexicon(docs, text, least_share, most_share))
    rows, parts = in_order(docs, key, text, part_rows)

    def run(batches):
        maker = Fingerprinter(held.value)

        def report(row, print_, following, its):
            changed = edited(row[1], following)
            other = maker.fingerprint(changed)
            return row[0], len(row[1]), hashlib.sha256(changed.encode()).hexdigest(), print_, other, likeness(print_, other), likeness(print_, its)

        last = None  # part, row and fingerprint of the row before
        for batch in batches:
            out = []
            for part, guest, k, t in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "k", "t"))):
                mine = maker.fingerprint(t)
                if last and last[0] == part:
                    out.append(report(last[1], last[2], t, mine))
                last = None if guest else (part, (k, t), mine)
            yield pa.RecordBatch.from_pydict({f.name: [row[i] for row in out] for i, f in enumerate(schema)}, schema)

    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "z", "a", "t")
    return dealt.mapInArrow(run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Cross-site removal of boilerplate lines.

Every line is known by a 64-bit hash; two different lines out of n share one with a probability of about n² / 2^65, which
is accepted. HyperLogLog sketches of the sites that show a line merge by aggregation; where the estimated spread lies near
the threshold, the distinct sites are counted exactly. A line seen on at least `sites` sites is boilerplate: it stays
once, in the row of the least key that shows it, and goes from all other places.

Lines are what newlines part, without BLANKS around them (other blanks of Unicode are part of a line); lines of blanks
are never boilerplate and stay. Null sites do not count; null texts have no lines and stay null; a row with a null key
shows lines but never holds the one that stays, so all its boilerplate goes; repeated rows of the least key each keep the
line once. Texts are read whole, however long; columns besides key, text and site pass unchanged, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, session_of, small_batches

#: What does not count at the ends of a line.
BLANKS = " \t\r"
#: Up to so many boilerplate lines are broadcast (16 bytes each); beyond, they are joined, with the same result.
BROADCAST_LINES = 200_000


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def hash_of(line: str) -> int:
    return _signed(xxhash.xxh64_intdigest(line.encode(), 42))


def shown(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """h, s, k, n: lines by hash with site, least key: gathered within each batch of rows before anything is shuffled."""
    small_batches(session_of(docs), 2_048)

    def run(batches):
        for batch in batches:
            least: dict[tuple, int | None] = {}
            for k, t, s in zip(*(c.to_pylist() for c in batch.columns)):
                if t:
                    for h in {hash_of(w) for line in t.split("\n") if (w := line.strip(BLANKS))}:
                        old = least.get((h, s))
                        least[h, s] = k if old is None else old if k is None else min(old, k)
            hs, ss = zip(*least) if least else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ss, pa.string()), pa.array(least.values(), pa.int64())], ["h", "s", "k"])

    return docs.select(F.col(key).cast("bigint"), F.col(text), F.col(site).cast("string")).mapInArrow(run, "h bigint, s string, k bigint")


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = 8, margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """h, keeper, spread of the lines seen on at least so many sites; within the margin of it the spread is exact."""
    lines = cut(shown(docs, key, text, site), "lines")
    est = F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("s", F.lit(lg_k))), F.lit(0))
    # Sketches, counts and keepers come from one aggregation, which begins in each task: no row of a common line is dealt.
    seen = lines.groupBy("h").agg(F.count("s").alias("c"), F.min("k").alias("keeper"), est.alias("spread"))
    wide = cut(seen.where((F.col("c") >= sites) & (F.col("spread") >= sites * (1 - margin))).select("h", "keeper", "spread"), "wide")
    sure = wide.where(F.col("spread") > sites * (1 + margin))
    near = wide.where(F.col("spread") <= sites * (1 + margin)).select(F.col("h").alias("nh"), "keeper")
    few = near.count()
    shows = lines.select("h", "s")
    if checked(near, few) is near:
        shows = shows.distinct()  # a line near the threshold then has few rows
    shows = shows.join(checked(near, few), F.col("h") == F.col("nh")).select("h", "keeper", "s").distinct()
    exact = shows.groupBy("h", "keeper").agg(F.count("s").alias("spread")).where(F.col("spread") >= sites)
    return cut(sure.union(exact), "boilerplate", wide.count())


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = 8, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All rows and columns, the text without boilerplate lines except in the rows that keep them."""
    found = boilerplate(docs, key, text, site, sites).select("h", "keeper")
    small_batches(session_of(docs))
    if found.count() <= broadcast_lines:
        return _by_broadcast(docs, found, key, text)
    return _by_join(docs, found, key, text)


def clean_text(text: str, key: int | None, keepers: dict[int, int | None]) -> str:
    """keepers: for each boilerplate hash the key of the row in which it stays."""
    out, held = [], set()
    for line in text.split("\n"):
        if word := line.strip(BLANKS):
            h = hash_of(word)
            if h in keepers:
                if h in held or key is None or keepers[h] != key:
                    continue
                held.add(h)
        out.append(line)
    return "\n".join(out)


def _by_broadcast(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    held = session_of(docs).sparkContext.broadcast(found.toArrow())  # at most broadcast_lines rows

    def run(batches):
        keepers = dict(zip(held.value["h"].to_pylist(), held.value["keeper"].to_pylist()))
        for batch in batches:
            at, k = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(key)).to_pylist()
            new = [clean_text(t, i, keepers) if t else t for i, t in zip(k, batch.column(at).to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _by_join(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The same where the lines are too many to broadcast: the hits of each text are joined to it."""
    name = "_granary_hits"
    texts = docs.withColumn("_granary_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))

    def lines(batches):
        for batch in batches:
            pairs = {(i, hash_of(w)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for line in t.split("\n") if (w := line.strip(BLANKS))}
            ids, hs = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64())], ["i", "h"])

    hits = texts.select("_granary_id", F.col(text)).mapInArrow(lines, "i bigint, h bigint").distinct().join(found, "h")
    hits = hits.groupBy("i").agg(F.collect_list(F.struct("h", "keeper")).alias(name))  # at most the lines of one text
    joined = texts.join(hits, F.col("_granary_id") == F.col("i"), "left").drop("i", "_granary_id")

    def run(batches):
        for batch in batches:
            at, k = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(key)).to_pylist()
            kept = batch.column(batch.schema.get_field_index(name)).to_pylist()
            new = [clean_text(t, i, {x["h"]: x["keeper"] for x in hit}) if t and hit else t for i, t, hit in zip(k, batch.column(at).to_pylist(), kept)]
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield out.select([f for f in out.schema.names if f != name])

    return joined.mapInArrow(run, docs.schema)

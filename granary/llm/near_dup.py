"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its five-word shingles (lower-case runs of letters, digits and underscores; a text of
fewer words is one shingle). Every (shingle, weight interval) pair starts a Poisson process: the intervals (0,1], (1,2],
(2,4], (4,8] ... are the levels of the hierarchy, a point of an interval counts if its position lies below the weight,
and each point falls into one of the slots; a slot keeps the earliest arrival. Two slots are equal with the probability
of the weighted Jaccard similarity. Only arrivals before a time at which all slots are filled with near certainty are
made; where one stays empty, the time is doubled.

Documents with equal texts are one node, made first: copies cost nothing after that, however many there are. Nodes that
share a band meet in a bucket. Each bucket first compares all its members to one hub, so a group of near copies costs as
many comparisons as it has members; the links found connect most of them. Then, of the members of a bucket that are not
yet connected, those outside its largest connected part are compared to all of other parts, block by block, each pair in
the first band it shares. So every pair of a bucket is compared or connected already. Comparisons are exact weighted
Jaccard similarities; links at `similarity` or more connect nodes, and connected nodes form a class. No pairs are written
but links, and no task gets a whole large bucket. Only the texts of nodes that share a band are read a second time.

Null texts count as empty; texts without a word are alike only if equal; repeated rows fall into one class; rows with a
null key get the class of their text, which is null only if all its keys are; long texts are taken whole, and blocks are
bounded by their shingles; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, checked, cut, remove, session_of, small_batches

WORD = re.compile(r"\w+")
SLOTS, ROWS = 120, 5
#: Members of a hub, or of a block of a bucket, that one task holds.
HUB_ROWS, HUB_SHINGLES = 256, 500_000
_codes = Cache(lambda word: xxhash.xxh64_intdigest(word), most=200_000)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles_of(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, hash, and number of occurrences of each distinct shingle, in order of place and hash."""
    words = [WORD.findall(t.lower()) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    n = int(counts.sum())
    codes = np.fromiter((_codes[w] for ws in words for w in ws), np.uint64, n)
    place = np.repeat(np.arange(len(texts)), counts)
    start = np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    length = np.minimum(np.repeat(counts, counts), size)
    padded, out = np.concatenate([codes, np.zeros(size, np.uint64)]), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = np.where(i < length, _mixed(out * np.uint64(31) + padded[i : i + n], 1), out)
    begins = (left >= size) | (np.arange(n) == start)
    place, out = place[begins], out[begins]
    order = np.lexsort((out, place))
    place, out = place[order], out[order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (out[1:] != out[:-1])])) if len(out) else np.zeros(0, int)
    return place[first], out[first], np.diff(np.append(first, len(out)))


def shingles(text: str, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of one text in order, and how often each occurs."""
    return shingles_of([text], size)[1:]


def similarity_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def signatures(place: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Earliest arrivals of each text in each slot, infinite for texts without elements; equal values mean equal points."""
    levels = [(place, elements, np.zeros(len(elements)), np.ones(len(elements)), weights)]
    level, start = 1, 1
    while len(more := np.flatnonzero(weights > start)):
        levels.append((place[more], _mixed(elements[more], 1000 + level), np.full(len(more), float(start)), np.full(len(more), float(2 * start)), weights[more]))
        level, start = level + 1, 2 * start
    place, source, low, high, weight = (np.concatenate(x) for x in zip(*levels))
    total = np.zeros(texts)
    np.add.at(total, levels[0][0], weights)
    out, until = np.full(texts * slots, np.inf), (np.log(slots) + 5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        rate = slots * (high - low)
        expected = rate * until[place]
        size = np.where(todo[place], 1 << np.clip(np.log2(np.maximum(expected, 2)).astype(int), 1, 10), 0)
        for step in np.unique(size[size > 0]):  # rows that expect alike many points make them together, `step` at a time
            at, k = np.flatnonzero(size == step), 0
            units = np.zeros(len(at), np.int64)  # whole units, so that a point is the same however many are made together
            while len(at):
                number = np.arange(k + 1, k + step + 1, dtype=np.uint64) * np.uint64(2)
                draw = _seeded(source[at][:, None], number)
                made = (-np.log((draw >> np.uint64(11)) * 2.0**-53 + 2.0**-54) * 2.0**40).astype(np.int64)
                reached = units[:, None] + np.cumsum(made, axis=1)
                when = reached * 2.0**-40 / rate[at][:, None]
                row, column = np.nonzero(when <= until[place[at]][:, None])
                spot = _seeded(source[at[row]], number[column] + np.uint64(1))
                position = low[at[row]] + (high - low)[at[row]] * ((spot >> np.uint64(32)) * 2.0**-32)
                inside = position < weight[at[row]]
                slot = ((spot & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(int)
                np.minimum.at(out, (place[at[row]] * slots + slot)[inside], when[row, column][inside])
                live = when[:, -1] <= until[place[at]]
                at, units, k = at[live], reached[live, -1], k + int(step)
        todo &= ~np.isfinite(out.reshape(texts, slots)).all(1)
        until = until * 2
    return out.reshape(texts, slots)


def _seeded(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(x + seed * np.uint64(0x9E3779B97F4A7C15), 0)


def signature(elements: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return signatures(np.zeros(len(elements), int), elements, weights, 1, slots)[0]


def bands(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """For each signature a 64-bit number for each band."""
    parts, out = found.view(np.uint64).reshape(len(found), -1, rows), None
    for j in range(rows):
        out = _mixed(parts[..., j] if out is None else out ^ parts[..., j], j + 1)
    return _mixed(out + np.arange(out.shape[1], dtype=np.uint64), 99).view(np.int64)


def _node(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("node")


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, node, bands and m (number of different shingles) of every row."""
    small_batches(session_of(docs))

    def run(batches):
        for batch in batches:
            texts, out, sizes = [t or "" for t in batch.column(2).to_pylist()], [], []
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                place, elements, weights = shingles_of(part)
                found = signatures(place, elements, weights, len(part))
                sizes += np.bincount(place, minlength=len(part)).tolist()
                out += [row if full else [] for row, full in zip(bands(found), np.isfinite(found[:, 0]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["k", "node", "bands", "m"])

    return docs.select(F.col(key).cast("bigint").alias("k"), _node(text), F.col(text)).mapInArrow(run, "k bigint, node binary, bands array<bigint>, m bigint")


def multisets(texts: DataFrame) -> DataFrame:
    """id, h, w, bands: the shingles of each text in order and their numbers, as bytes. texts: id, text, bands."""
    small_batches(session_of(texts))

    def run(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([w.astype(np.uint32).tobytes() for _, w in found], pa.binary()), batch.column(2)], ["id", "h", "w", "bands"])

    return texts.mapInArrow(run, "id bigint, h binary, w binary, bands array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """The pairs (id, hub), at most so many, whose multisets are similar. sets: id, h, w, one row each."""
    small_batches(session_of(pairs), 256)
    large = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_ROWS).select(F.col("hub").alias("lh"), F.ceil(F.col("n") / HUB_ROWS).alias("parts"))
    dealt = pairs.join(checked(large, most // HUB_ROWS), F.col("hub") == F.col("lh"), "left").select("id", "hub", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part"))
    members = dealt.join(sets, "id").select("hub", "part", F.col("id").alias("other"), "h", "w")
    hubs = dealt.select("hub", "part").distinct().join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", "part", F.lit(None).cast("bigint").alias("other"), "h", "w")

    def run(batches):
        hub = own = size = None
        for batch in batches:
            rows = [[], []]
            for to, other, h, w in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                found = np.frombuffer(h, np.uint64), np.frombuffer(w, np.uint32).astype(np.int64)
                if other is None:
                    hub, own, size = to, found, found[1].sum()
                elif to != hub:
                    raise RuntimeError("a hub without its multiset")
                elif min(size, n := found[1].sum()) >= similarity * max(size, n) and similarity_of(own, found) >= similarity:
                    rows[0].append(other)
                    rows[1].append(to)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "hub"])

    together = hubs.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("other"))
    return together.mapInArrow(run, "id bigint, hub bigint")


def overlaps(hub: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one multiset to several, with one search for all."""
    h, w = np.concatenate([x[0] for x in others]), np.concatenate([x[1] for x in others])
    starts = np.cumsum([0] + [len(x[0]) for x in others[:-1]])
    at = np.minimum(np.searchsorted(hub[0], h), len(hub[0]) - 1)
    shared = np.add.reduceat(np.where(hub[0][at] == h, np.minimum(hub[1][at], w), 0), starts)
    return shared / (np.add.reduceat(w, starts) + hub[1].sum() - shared)


def compared(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The similar pairs of each bucket between its members outside the largest part and all of another part.

    open_: b, id, root, rest (outside the largest part), parts and blocks (of all members and of those outside). Both
    sides are dealt in blocks of about HUB_ROWS or HUB_SHINGLES, every block of one to every block of the other; a pair
    that shares several bands is compared in the first."""
    small_batches(session_of(open_), 256)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    hubs = open_.where("rest").withColumn("hb", block("blocks")).select("b", "hb", every("parts").alias("mb"), F.lit(0).alias("role"), "id", "root", "rest")
    members = open_.withColumn("mb", block("parts")).select("b", every("blocks").alias("hb"), "mb", F.lit(1).alias("role"), "id", "root", "rest")
    dealt = hubs.union(members).join(sets, "id").select("b", "hb", "mb", "role", "id", "root", "rest", "h", "w", "bands")
    dealt = dealt.repartition("b", "hb", "mb").sortWithinPartitions("b", "hb", "mb", "role", "id")

    def run(batches):
        unit, hubs, members, held = None, [], [], 0
        joined: set = set()  # parts between which this unit has found a link; more would connect nothing new
        found: list[list] = [[], []]

        def meet():
            if members and hubs:
                ids, roots, rests, multis, sizes, bands = zip(*members)
                ids, roots, rests, sizes, bands = (np.array(x) for x in (ids, roots, rests, sizes, bands))
                for own, root, _, multi, size, band in hubs:
                    where = (bands == band).argmax(1)
                    may = (roots != root) & (bands[np.arange(len(bands)), where] == unit[0]) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size))
                    may &= ~rests | (ids > own)
                    if len(at := np.flatnonzero(may)):
                        for i in at[overlaps(multi, [multis[i] for i in at]) >= similarity].tolist():
                            if (root, roots[i]) not in joined:
                                joined.add((root, roots[i]))
                                found[0].append(int(ids[i]))
                                found[1].append(own)
            members.clear()

        for batch in batches:
            for b, hb, mb, role, own, root, rest, h, w, band in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != (b, hb, mb):
                    meet()
                    hubs.clear()
                    joined.clear()
                    unit, held = (b, hb, mb), 0
                weights = np.frombuffer(w, np.uint32).astype(np.int64)
                row = own, root, rest, (np.frombuffer(h, np.uint64), weights), weights.sum(), np.array(band)
                (members if role else hubs).append(row)
                held += role * len(weights)
                if len(members) == 256 or held > HUB_SHINGLES:
                    meet()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "hub"])
            found = [[], []]
        meet()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "hub"])

    return dealt.mapInArrow(run, "id bigint, hub bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, root for every node of an edge (id, hub): the least node that it is connected to. Labels spread along edges and jump to their own labels until none changes."""
    n = 2 * edges.count()
    both = cut(edges.select("id", "hub").union(edges.select("hub", "id")), "edges", n)
    roots = cut(both.groupBy("id").agg(F.min("hub").alias("m")).select("id", F.least("id", "m").alias("root")), "roots", n)
    while True:
        # A centre with many links, or the root of many, is one key here: few roots are broadcast, else skewed joins are split.
        told = both.join(checked(roots.select(F.col("id").alias("hub"), "root"), n), "hub").groupBy("id").agg(F.min("root").alias("m"))
        near = roots.join(told, "id").select("id", "root", F.least("root", "m").alias("new"))
        jumped = near.join(checked(roots.select(F.col("id").alias("new"), F.col("root").alias("far")), n), "new").select("id", "root", F.least("new", "far").alias("new"))
        done = cut(jumped, "roots", n)
        remove(roots)
        changed = not done.where(F.col("new") != F.col("root")).isEmpty()
        roots = done.select("id", F.col("new").alias("root"))
        roots._granary_path = done._granary_path
        if not changed:
            remove(both)
            return roots


def nodes_of(rows: DataFrame) -> DataFrame:
    """id, node, k (the least), n (rows), bands and m of every different text."""
    every = rows.groupBy("node").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("m").alias("m"))
    return cut(every.select(F.monotonically_increasing_id().alias("id"), "*"), "nodes", rows.count())  # numbers are given once, as it is written


def grouped(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """k and node of every row; the nodes; id and root (of the class) of every node that is linked to another."""
    rows = cut(signed(docs, key, text), "signatures")
    nodes = nodes_of(rows)
    bucketed = nodes.select("id", "m", F.explode("bands").alias("b"))
    sizes = bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = cut(bucketed.join(sizes.select("b", "hub"), "b"), "members")
    wanted = cut(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "node", "bands"), "wanted", members.count() // 2)
    few = wanted.count()
    own = docs.select(_node(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if checked(wanted, few) is wanted:
        own = own.groupBy("node").agg(F.first("text").alias("text"))  # copies meet within each task before they are dealt
    texts = own.join(checked(wanted.select("id", "node"), few), "node").groupBy("id").agg(F.first("text").alias("text")).join(wanted.select("id", "bands"), "id")
    sets = cut(multisets(texts.select("id", "text", "bands")), "multisets")
    stars = cut(verified(members.where(F.col("id") != F.col("hub")).select("id", "hub").distinct(), sets.select("id", "h", "w"), similarity, members.count()), "links")
    roots = components(stars)
    # What is still to be compared: of any two unconnected members of a bucket one is outside its largest part, and
    # the hub has been compared to all.
    placed = members.join(roots, "id", "left").select("b", "id", "m", "hub", F.coalesce("root", "id").alias("root"))
    parts = placed.groupBy("b", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    mixed = parts.groupBy("b").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", "m")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m")).where("roots > 1 and n > 2")
    pieces = lambda n, m: F.greatest(F.ceil(n / HUB_ROWS), F.ceil(m / HUB_SHINGLES), F.lit(1))
    mixed = mixed.select("b", F.col("top.root").alias("top"), pieces(F.col("n"), F.col("m")).alias("parts"), pieces(F.col("n") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("blocks"))
    left = placed.where(F.col("id") != F.col("hub")).join(mixed, "b").select("b", "id", "root", (F.col("root") != F.col("top")).alias("rest"), "parts", "blocks")
    left = cut(left, "open")
    more = cut(compared(left, sets, similarity), "links")
    remove(left, sets, wanted, members)
    # The links found last connect classes found first.
    few = roots.count()
    first, second = (checked(roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), few) for c in ("id", "hub"))
    between = more.join(first, "id", "left").join(second, "hub", "left").select(F.coalesce("id_root", "id").alias("id"), F.coalesce("hub_root", "hub").alias("hub")).where("id <> hub").distinct()
    between = cut(between, "between", more.count())
    if between.isEmpty():
        return rows, nodes, roots
    over = components(between).select(F.col("id").alias("root"), F.col("root").alias("top"))
    alone = over.join(roots.select("id"), F.col("root") == F.col("id"), "left_anti").select(F.col("root").alias("id"), F.col("top").alias("root"))  # classes of one text until now
    return rows, nodes, roots.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root")).union(alone)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """key and class_id, the least key of the class, of every row."""
    rows, nodes, roots = grouped(docs, key, text, similarity)
    linked = nodes.select("id", "k").join(roots, "id")
    least = linked.groupBy("root").agg(F.min("k").alias("class_id"))
    named = linked.join(least, "root").select("id", "class_id", F.lit(True).alias("linked"))
    labels = nodes.select("id", "node", "k").join(named, "id", "left").select("node", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("k")).alias("class_id"))
    return rows.select("k", "node").join(labels, "node").select(F.col("k").alias(key), "class_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each class, all columns unchanged: one of least key (null only if all are), of these one of least hash
    of the text, and of rows that repeat key and text any one, whatever its other columns hold."""
    rows, nodes, roots = grouped(docs, key, text, similarity)
    linked = nodes.select("id", "node", "k").join(roots, "id")
    top = linked.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("missing"), "k", "node")).alias("top"))
    losers = linked.join(top, "root").where(F.col("node") != F.col("top.node")).select("id", F.lit(True).alias("loser"))
    # Rows of other nodes that are alone with their text stay; the rest is small, and told by key and text.
    marked = nodes.select("id", "node", "k", "n").join(losers, "id", "left").where("loser or n > 1").select("node", F.col("k").alias("least"), F.coalesce("loser", F.lit(False)).alias("loser"))
    marked = cut(marked, "marked", nodes.count() // 4)
    keep = (~F.col("loser") & F.col("k").eqNullSafe(F.col("least"))).alias("keep")
    told = rows.select("k", "node").join(checked(marked, marked.count()), "node").groupBy("k", "node", keep).agg(F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    told = cut(told.select(F.col("k").alias("_granary_key"), F.col("node").alias("_granary_node"), "keep"), "told", rows.count() // 4)
    own = docs.withColumn("_granary_text", _node(text))
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_granary_key")) & (F.col("_granary_text") == F.col("_granary_node"))
    rest = own.join(checked(told.drop("keep"), told.count()), same, "left_anti")
    again = told.where("keep")
    if again.isEmpty():
        return rest.select(docs.columns)
    once = own.join(checked(again.drop("keep"), told.count()), same, "left_semi").dropDuplicates(["_granary_text"])
    return rest.union(once).select(docs.columns)

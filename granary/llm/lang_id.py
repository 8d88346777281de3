"""Language identification by script ranges, word scores and Viterbi labelling.

A model holds, for each language learned, counts of letter trigrams inside words and the scripts its words use. The
script of most of a word's letters narrows its candidate languages (others are so far behind that no path through them
can win); each candidate scores the word by smoothed trigram likelihood; Viterbi with a penalty for every switch labels
the words, and runs of one label are the spans of a mixed text. A text for which no stretch gains half the penalty in
another language has one label throughout; this is found with running sums, and only other texts need the recurrence.

The model is fitted on a sample of at most about `sample_rows` labelled rows, dealt evenly to the languages, of at most
`max_langs` languages, and keeps the `max_grams` most frequent trigrams of each and all its scripts: documented bounds of
the model; prediction reads whole texts, however long. Null texts and texts without a letter (other numbers and marks are
none) are `und` with score 0 and no spans. Ties between languages go to the first in order. Repeated rows give repeated
rows; with no labelled row every text is `und`; an empty table gives an empty one; columns besides those named are not
read by predict and pass unchanged in accepted.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of, small_batches

# First and last code points of the scripts told apart.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
)
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: What a word can tell against a language at most, and against one that does not use its script, in switching penalties.
FLOOR, OUTSIDE = -6.0, -4.0
#: Words of more letters are scored but not remembered.
LONG_WORD = 40
MOST_WORDS = 300_000
#: Up to so many languages plain numbers are quicker than arrays of them.
FEW = 24
#: Numbers of the table that new words are weighed with at once.
TOGETHER = 2_000_000
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
_EDGES = sorted((first, last, NAMES.index(name)) for name, first, last in SCRIPTS)


def scripts_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word, its code points from starts on, the place in NAMES of the script of most of them."""
    first, last, name = (np.array(x) for x in zip(*_EDGES))
    at = np.maximum(np.searchsorted(first, codes, "right") - 1, 0)
    each = np.where((codes >= first[at]) & (codes <= last[at]), name[at], len(NAMES) - 1)
    return np.add.reduceat(np.eye(len(NAMES), dtype=np.int32)[each], starts).argmax(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def script_of(word: str) -> str:
    return NAMES[scripts_of(_codes(word), np.zeros(1, int))[0]]


def _key(gram: str) -> int:
    """A number for each run of at most three characters."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@dataclass
class LangModel:
    """Languages in order, trigram counts of each, the scripts of each, the switching penalty."""

    langs: list[str]
    grams: list[dict[str, float]]
    scripts: list[set[str]]
    penalty: float = 12.0

    def scorer(self) -> Scorer:
        """One for each copy of the model, and so for each worker process: what it remembers outlives a task."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_scorer"}


class Scorer:
    def __init__(self, model: LangModel):
        self.model, self.k = model, len(model.langs)
        contexts: list[dict[str, float]] = []
        for grams in model.grams:
            total: dict[str, float] = defaultdict(float)
            for g, n in grams.items():
                total[g[:2]] += n
            contexts.append(total)
        # Log-likelihoods for all languages: a row for each known gram, for grams unknown after a known start, for the rest.
        grams = sorted(set().union(*model.grams), key=_key)
        starts = sorted(set().union(*contexts), key=_key)
        self.gram_keys, self.start_keys = (np.array([*map(_key, x), 1 << 63], np.uint64) for x in (grams, starts))
        self.logs = np.full((len(grams) + len(starts) + 1, max(self.k, 1)), math.log(0.5 / 30))
        for j in range(self.k):
            seen, total = model.grams[j], contexts[j]
            self.logs[: len(grams), j] = [math.log((seen.get(g, 0) + 0.5) / (total.get(g[:2], 0) + 30)) for g in grams]
            self.logs[len(grams) : -1, j] = [math.log(0.5 / (total.get(c, 0) + 30)) for c in starts]
        self.inside = np.array([[name in s for s in model.scripts] for name in NAMES], bool).reshape(len(NAMES), self.k)
        # What a letter drawn evenly from as many letters as each language uses (their perplexity) would score.
        self.chance = np.zeros(max(self.k, 1))
        for j, grams in enumerate(model.grams):
            used: Counter = Counter()
            for g, n in grams.items():
                used[g[2:]] += n
            self.chance[j] = sum(n * math.log(n / used.total()) for n in used.values()) / max(used.total(), 1)
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.taken = 0  # rows of the table, also those of words no longer remembered
        self.table = np.zeros((4096, max(self.k, 1)), np.float32)
        self.letters = np.zeros(4096, np.int32)
        self.likely = np.zeros(4096, bool)

    def scores(self, word: str) -> np.ndarray:
        """At most 0 for each language, 0 for the likeliest; all 0 where the word tells nothing."""
        return self._weigh([word])[0][0]

    def _weigh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word, and whether a learned language of its script makes it likelier than chance does."""
        sizes = np.array([len(w) for w in words])
        codes = _codes("^" + "$^".join(words) + "$")
        starts = np.cumsum(sizes + 2) - sizes - 2
        inner = np.ones(len(codes), bool)
        inner[starts] = inner[starts + sizes + 1] = False
        first = np.cumsum(sizes) - sizes
        script = scripts_of(codes[inner], first)
        # Every letter is the middle of one trigram.
        at = np.flatnonzero(inner)
        pairs = codes[at - 1] << 21 | codes[at]
        rows = self._rows(self.gram_keys, (pairs << 21 | codes[at + 1]).astype(np.uint64))
        unknown = rows < 0
        found = self._rows(self.start_keys, pairs[unknown].astype(np.uint64))
        rows[unknown] = np.where(found < 0, len(self.logs) - 1, found + len(self.gram_keys) - 1)
        total = np.add.reduceat(self.logs[rows], first)
        inside = self.inside[script]
        out = np.where(inside, total, -np.inf)
        top = out.max(1, initial=-np.inf, keepdims=True)
        none = ~inside.any(1)
        top[none] = 0
        scores = np.where(inside, np.maximum(out - top, FLOOR), OUTSIDE * self.model.penalty)
        scores[none] = 0
        return scores.astype(np.float32), (out > sizes[:, None] * self.chance).any(1)

    @staticmethod
    def _rows(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The places of keys among the known, -1 for others."""
        at = np.searchsorted(known, keys)
        return np.where(known[np.minimum(at, len(known) - 1)] == keys, at, -1)

    def _learn(self, words: list[str]) -> None:
        """Takes rows of the table for new words."""
        at, n = 0, self.taken
        while n + len(words) > len(self.table):
            self.table, self.letters, self.likely = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.letters, self.likely))
        while at < len(words):
            end, room = at, TOGETHER // max(self.k, len(NAMES))
            while end < len(words) and (room > 0 or end == at):
                room -= len(words[end])
                end += 1
            self.table[n + at : n + end], self.likely[n + at : n + end] = self._weigh(words[at:end])
            at = end
        self.letters[n : n + len(words)] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words]
        self.ids.update(zip(words, range(n, n + len(words))))
        self.taken += len(words)

    def _look(self, texts: list[list[str]]):
        """For each list of words: scores and letters of each word, and whether a language explains it."""
        if self.taken > MOST_WORDS:
            self._start()
        words = set().union(*texts)
        self._learn(list(words.difference(self.ids)))
        get = self.ids.__getitem__
        for text in texts:
            index = np.fromiter(map(get, text), np.int64, len(text))
            yield self.table[index], self.letters[index], self.likely[index]
        for w in words:
            if len(w) > LONG_WORD:
                del self.ids[w]

    def label(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label, letters and scores of each word."""
        ((scores, letters, _),) = self._look([words])
        return self._viterbi(scores), letters, scores

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        penalty, best = self.model.penalty, int(scores.sum(0).argmax())
        gains = np.cumsum(scores - scores[:, [best]], axis=0, dtype=np.float64)
        lows = np.minimum(np.minimum.accumulate(gains), 0)
        if (gains[1:] - lows[:-1]).max(initial=0) <= penalty / 2 and gains[0].max() <= penalty / 2:
            return np.full(len(scores), best)
        return self._recurrence(scores) if self.k > FEW else self._recurrence_of_few(scores.tolist())

    def _recurrence(self, scores: np.ndarray) -> np.ndarray:
        value, back = scores[0].astype(np.float64), np.zeros(scores.shape, np.int16)
        own, penalty = np.arange(self.k), self.model.penalty
        for t in range(1, len(scores)):
            top = int(value.argmax())
            switch = value < value[top] - penalty
            back[t] = np.where(switch, top, own)
            value = np.where(switch, value[top] - penalty, value) + scores[t]
        labels = np.empty(len(scores), int)
        labels[-1] = value.argmax()
        for t in range(len(scores) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels

    def _recurrence_of_few(self, scores: list[list[float]]) -> np.ndarray:
        """The same without arrays. A label switches only from the best one, so a step is told by that one and by who switches."""
        value, penalty = scores[0], self.model.penalty
        steps: list[tuple[int, float, list[float]]] = []  # the best label before each word, the bar below which others switch to it, and the values
        for row in scores[1:]:
            best = max(value)
            bar = best - penalty
            steps.append((value.index(best), bar, value))
            value = [(v if v >= bar else bar) + s for v, s in zip(value, row)]
        labels = [value.index(max(value))]
        for best, bar, before in reversed(steps):
            labels.append(best if before[labels[-1]] < bar else labels[-1])
        return np.array(labels[::-1])

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language of most letters, its score, number of spans."""
        return self.judge(text)[:3]

    def judge(self, text: str | None) -> tuple[str, float, int, float]:
        """What predict gives, and the share of the letters in words that learned languages explain."""
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        if not self.k:
            return [(UNDETERMINED, 0.0, 0, 0.0)] * len(texts)
        out = []
        for scores, letters, likely in self._look([WORD.findall(t.lower()) if t else [] for t in texts]):
            if not letters.any():
                out.append((UNDETERMINED, 0.0, 0, 0.0))
                continue
            labels = self._viterbi(scores)
            weight = np.bincount(labels, letters, self.k)
            top = int(weight.argmax())
            spans = 1 + int((labels[1:] != labels[:-1]).sum())
            odds = np.exp(scores[labels == top])
            sure = float((odds[:, top] / odds.sum(1)).mean())
            out.append((self.model.langs[top], min(1.0, max(0.0, float(weight[top] / weight.sum()) * sure)), spans, float(letters[likely].sum() / letters.sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start and end (code points) and language of each run of words with one label."""
        found = [m for m in WORD.finditer(text) if any(map(str.isalpha, m[0]))] if text else []
        if not found or not self.k:
            return []
        labels = self.label([m.group().lower() for m in found])[0]
        starts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(found)]
        return [(found[a].start(), found[b - 1].end(), self.model.langs[labels[a]]) for a, b in zip(starts, starts[1:])]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 10_000, max_grams: int = 50_000, max_langs: int = 1_000, penalty: float = 12.0) -> LangModel:
    """A model of the rows that have text and lang: of a sample of about sample_rows of them, evenly of each of the max_langs most frequent languages, chosen by a hash of key and text."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    small_batches(session_of(labelled))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(max_langs).collect()}
    share = max(1, sample_rows // max(1, len(sizes)))
    if sum(sizes.values()) > sample_rows:
        size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
        rows = rows.where(F.pmod(F.xxhash64("k", "t", F.lit("sample")), F.try_element_at(size, F.col("l"))) < share)
    else:
        rows = rows.where(F.col("l").isin(list(sizes)))

    def run(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    seen[name].update(WORD.findall(t.lower()))
        grams: Counter = Counter()
        for name, words in seen.items():
            if not words:
                continue
            sizes = np.array([len(w) for w in words])
            for (word, count), script in zip(words.items(), scripts_of(_codes("".join(words)), np.cumsum(sizes) - sizes).tolist()):
                grams[name, f"\0{NAMES[script]}"] += count
                w = f"^{word}$"
                for i in range(len(w) - 2):
                    grams[name, w[i : i + 3]] += count
        names, keys = zip(*grams) if grams else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string()), pa.array(grams.values(), pa.int64())], ["l", "g", "n"])

    counts = rows.select("t", "l").mapInArrow(run, "l string, g string, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    script = F.col("g").startswith("\0")
    place = F.row_number().over(Window.partitionBy("l", script).orderBy(F.desc("n"), "g"))
    grams: dict[str, dict[str, float]] = defaultdict(dict)
    scripts: dict[str, Counter] = defaultdict(Counter)
    for row in counts.withColumn("place", place).where(script | (F.col("place") <= max_grams)).collect():
        (scripts if row["g"][0] == "\0" else grams)[row["l"]][row["g"].lstrip("\0")] = row["n"]
    langs = sorted(grams)
    used = [{s for s, n in scripts[name].items() if n >= 0.001 * scripts[name].total()} for name in langs]
    return LangModel(langs, [grams[name] for name in langs], used, penalty)


def predict(docs: DataFrame, model: LangModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1) and n_spans of every whole text."""
    small_batches(session_of(docs))
    held = session_of(docs).sparkContext.broadcast(model)  # bounded by max_grams and max_langs

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            langs, scores, spans = zip(*[found[:3] for found in scorer.judge_all(batch.column(1).to_pylist())]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.int64())], [key, "lang_pred", "score", "n_spans"])

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, n_spans bigint")


def label_spans(docs: DataFrame, model: LangModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each span of each text: key, start, end (code points) and lang."""
    small_batches(session_of(docs))
    held = session_of(docs).sparkContext.broadcast(model)

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            rows = [(k, *s) for k, t in zip(batch.column(0), batch.column(1).to_pylist()) for s in scorer.spans(t)]
            keys, starts, ends, langs = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.column(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(langs, pa.string())], [key, "start", "end", "lang"])

    picked = docs.select(F.col(key), F.col(text))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, start bigint, end bigint, lang string")


def accepted(docs: DataFrame, model: LangModel, text: str = "text", min_score: float = 0.15, min_explained: float = 0.4) -> DataFrame:
    """The rows, all columns unchanged, whose text has a determined language with at least min_score, and at least min_explained of its letters in words that learned languages explain.

    min_score is below chance for up to six languages; min_explained does not depend on their number.
    """
    small_batches(session_of(docs))
    held = session_of(docs).sparkContext.broadcast(model)

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = scorer.judge_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != UNDETERMINED and score >= min_score and share >= min_explained for name, score, _, share in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Delimited text with brackets, comments, escapes and types by elimination.

Files are read in splits, and quoted fields may hold line ends. A first pass finds for each split whether it ends inside a
quoted field, if it begins outside or inside of one; from that the driver knows how each split begins, and the second pass
cuts rows. Both passes read the same splits, whatever settings or executors change between them. The few rows that reach
over the end of a split are put together afterwards and come last. The header is the first row of each file, told by its
place; files without rows have none.

Types are tried on the first `infer_rows` rows (None: on all), of as many files as hold them, in the order integer, float, vector, list, dict, string; a
cell that does not fit its column is missing everywhere, or an error everywhere with strict=True; misfits() counts them.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parser import parse
from ..operators.frame import Frame
from ..types import DICT, FLOAT, INTEGER, LIST, SPARK, STRING, VECTOR, dtype

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", '"': '"', "'": "'", "/": "/"}
_CLOSE = {"[": "]", "{": "}"}


#: The types in the order in which they are tried.
TYPES = (INTEGER, FLOAT, VECTOR, LIST, DICT, STRING)


@dataclass
class Options:
    delimiter: str = ","
    header: bool = True
    comment: str = "#"
    escape: str = "\\"
    quote: str = '"'
    double_quote: bool = True
    skip_initial_space: bool = True
    na_values: list[str] = field(default_factory=list)
    line_terminator: str = "\n"
    usecols: list[str] | None = None
    nrows: int | None = None
    skiprows: int = 0  # rows at the start of each file
    types: dict[str, str] = field(default_factory=dict)
    multi_line: bool = True  # quoted fields may hold line ends
    strict: bool = False
    infer_rows: int | None = 100

    def __post_init__(self):
        for name in ("quote", "escape", "comment"):
            if len(v := getattr(self, name)) > 1 or not v.isascii():
                raise ValueError(f"{name} must be one ASCII character or empty")


def unescape(text: str, mark: str) -> str:
    """Escapes of a quoted field; unknown ones stay as they are."""
    if not mark or mark not in text:
        return text
    out, i = [], 0
    while i < len(text):
        if text[i] == mark and i + 1 < len(text):
            c = text[i + 1]
            if c == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(c, mark + c))
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _bracket_end(line: str, start: int) -> int:
    """Where a balanced bracket that opens at start ends; -1 if it does not, or holds no colon in braces."""
    stack, quote, colon, i = [], "", False, start
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in _CLOSE:
            stack.append(_CLOSE[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1 if line[start] == "[" or colon else -1
        elif c == ":" and len(stack) == 1:
            colon = True
        i += 1
    return -1


def split_row(line: str, o: Options) -> list[str] | None:
    """Fields of a row; None for blank and comment lines."""
    fields, i, n = [], 0, len(line)
    blank = o.delimiter.strip() == ""
    while True:
        while o.skip_initial_space and i < n and line[i] in " \t" and not (blank and line.startswith(o.delimiter, i)):
            i += 1
        value, quoted = None, False
        if o.quote and i < n and line[i] == o.quote:
            j, parts = i + 1, []
            while j < n:
                c = line[j]
                if c == o.escape and o.escape and j + 1 < n:
                    parts.append(line[j : j + 2])
                    j += 2
                elif c == o.quote and o.double_quote and line[j + 1 : j + 2] == o.quote:
                    parts.append(c)
                    j += 2
                elif c == o.quote:
                    break
                else:
                    parts.append(c)
                    j += 1
            value, quoted, i = unescape("".join(parts), o.escape), True, min(j + 1, n)
        elif i < n and line[i] in _CLOSE and (end := _bracket_end(line, i)) > 0:
            value, i = line[i:end], end
        stop = i
        while stop < n and not line.startswith(o.delimiter, stop) and not (o.comment and line[stop] == o.comment):
            stop += 1
        ended = stop >= n or not line.startswith(o.delimiter, stop)
        rest = line[i:stop].strip()
        fields.append(value if quoted else (value or "") + rest if value is not None else rest)
        if ended:
            return None if fields == [""] and not quoted else fields
        i = stop + len(o.delimiter)


def infer(cells: list[str], na: set[str]) -> str:
    """The first type that all present cells fit; integer if there is none."""
    found = fits(cells, na)
    return next(k for k in TYPES if found[k])


def fits(cells: list[str], na: set[str]) -> dict[str, bool]:
    """For each type whether all present cells fit it."""
    present = {c for c in cells if c != "" and c not in na}
    return {k: all(parse(c, k) is not None for c in present) for k in TYPES}


def open_after(line: str, inside: bool, o: Options) -> bool:
    """Whether a line ends inside a quoted field that the next line continues."""
    stop = re.compile(f"{re.escape(o.delimiter)}|{re.escape(o.comment)}" if o.comment else re.escape(o.delimiter))
    marks = re.compile(f"[{re.escape(o.quote + o.escape)}]")
    blank, i, n = o.delimiter.strip() == "", 0, len(line)
    while True:
        while not inside and o.skip_initial_space and i < n and line[i] in " \t" and not (blank and line.startswith(o.delimiter, i)):
            i += 1
        if not inside and i < n and line[i] == o.quote:
            inside, i = True, i + 1
        elif not inside and i < n and line[i] in _CLOSE:
            i = max(i, _bracket_end(line, i))
        while inside:
            found = marks.search(line, i)
            if not found:
                return True
            i = found.start()
            if line[i] == o.escape and i + 1 < n or o.double_quote and line[i : i + 2] == o.quote * 2:
                i += 2
            else:
                inside, i = line[i] != o.quote, i + 1
        found = stop.search(line, i)
        if not found or found[0] == o.comment:
            return False
        i = found.end()


def _pinned(df: DataFrame) -> DataFrame:
    """df over the splits of now; a plan is laid out anew each time that it runs, by the settings and cores of that moment."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


class _Lines:
    """Lines of a source with the split that they are of: f (a number of the file), b (where the split begins) and the text."""

    def __init__(self, spark: SparkSession, path: str | list[str], o: Options):
        self.o = o
        self.df = spark.read.text(path, lineSep=o.line_terminator) if o.line_terminator else spark.read.text(path, wholetext=True)
        self.tagged = _pinned(self.df.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value"))
        self.quoted = bool(o.quote and o.multi_line and o.line_terminator)

    @staticmethod
    def pieces(batches):
        """Split and lines, again and again; those of one split come one after the other."""
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = (batch.column(i).to_numpy() for i in (0, 1))
            ends = [*(np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
            for at, end in zip([0, *ends], ends):
                yield (int(files[at]), int(starts[at])), batch.column(2).slice(at, end - at)

    def begins(self) -> tuple[dict[tuple[int, int], tuple[bool, int]], bool]:
        """For each split whether it begins inside a quoted field and the split where that row begins; whether any does."""
        if not self.quoted:
            return {}, False
        o, pieces = self.o, self.pieces

        def run(batches):
            found: dict = {}  # of each split: how it ends if it begins outside, or inside, and whether a row begins in it in the latter case
            for split, lines in pieces(batches):
                ends = found.setdefault(split, [False, True, False])
                odd = pc.match_substring(lines, o.quote)
                for line in lines.filter(odd).to_pylist():
                    ends[:2] = open_after(line, ends[0], o), open_after(line, ends[1], o)
                    ends[2] |= not ends[1]
            splits, ends = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([f for f, _ in splits], [b for _, b in splits], *([e[i] for e in ends] for i in range(3)))], ["f", "b", "outside", "inside", "closes"]) if found else pa.RecordBatch.from_pylist([], schema)

        schema = pa.schema([("f", pa.int64()), ("b", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("closes", pa.bool_())])
        out: dict = {}
        last, inside, row = None, False, 0
        for r in sorted(self.tagged.mapInArrow(run, "f bigint, b bigint, outside boolean, inside boolean, closes boolean").collect()):  # one row a split
            if r["f"] != last:
                last, inside, row = r["f"], False, r["b"]
            out[r["f"], r["b"]] = inside, row
            row = row if inside and not r["closes"] else r["b"]
            inside = r["inside"] if inside else r["outside"]
        return out, any(inside for inside, _ in out.values())

    def rows(self, begins: dict, use, schema: str, header: bool) -> DataFrame:
        """What use(rows) makes of batches of rows (lists of cells), and parts of rows that reach over splits: f, b (of the split where the row begins), n (of the split) and part."""
        o, pieces, quoted = self.o, self.pieces, self.quoted

        def run(batches):
            split, inside, held, skip, row, fresh = None, False, [], 0, 0, True
            parts: list[tuple] = []

            def ended():
                if held:  # the split ends inside a row
                    parts.append((*((split[0], row) if not fresh else (split[0], split[1])), split[1], o.line_terminator.join(held)))
                    held.clear()

            for which, lines in pieces(batches):
                if which != split:
                    ended()
                    split = which
                    inside, row = begins[split] if begins else (False, 0)
                    fresh, skip, first = not inside, o.skiprows if not split[1] else 0, header and not split[1]
                got = []
                for line in lines.to_pylist():
                    line = line if o.line_terminator != "\n" else line.rstrip("\r")
                    if quoted and (inside or o.quote in line):
                        held.append(line)
                        if o.quote in line:
                            inside = open_after(line, inside, o)
                        if inside:
                            continue
                        line = o.line_terminator.join(held)
                        held.clear()
                        if not fresh:  # the end of a row that began in another split
                            parts.append((split[0], row, split[1], line))
                            fresh = True
                            continue
                    if skip:
                        skip -= 1
                    elif (cells := split_row(line, o)) is not None:
                        if first:
                            first = False
                        else:
                            got.append(cells)
                yield from use(got, ())
            ended()
            yield from use([], parts)

        return self.tagged.mapInArrow(run, f"{schema}, _f bigint, _b bigint, _n bigint, _part string")

    def first_rows(self, n: int) -> tuple[list[str] | None, list[list[str]]]:
        """The first header, and up to n rows after headers, from the first splits of as many files as it takes, in their order."""
        o, quoted = self.o, self.quoted

        def run(batches):
            file, inside, held, skip, k = None, False, [], 0, 0
            for batch in batches:
                got = []
                for path, line in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                    if path != file:
                        file, inside, held, skip, k = path, False, [], o.skiprows, 0 if o.header else 1
                    if k > n:
                        continue
                    line = line if o.line_terminator != "\n" else line.rstrip("\r")
                    if quoted and (inside or o.quote in line):
                        held.append(line)
                        if o.quote in line:
                            inside = open_after(line, inside, o)
                        if inside:
                            continue
                        line = o.line_terminator.join(held)
                        held.clear()
                    if skip:
                        skip -= 1
                    elif (cells := split_row(line, o)) is not None:
                        got.append((path, k, cells))
                        k += 1
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.string())))], ["p", "k", "cells"])

        head, rows, at, step = None, [], 0, 1
        files = sorted(name.replace(":///", ":/") for name in self.df.inputFiles())  # as _metadata.file_path writes them
        while at < len(files) and len(rows) < n:
            begin = F.col("_metadata.file_path").isin(files[at : at + step]) & (F.col("_metadata.file_block_start") == 0)
            found = self.df.where(begin).select(F.col("_metadata.file_path").alias("p"), "value").mapInArrow(run, "p string, k bigint, cells array<string>")
            if step == 1:  # one file, whose rows come in order
                got = found.limit(n + 1).collect()
            else:
                got = found.where("k = 0").orderBy("p").limit(1).collect() if head is None and o.header else []
                got += found.where("k > 0").orderBy("p", "k").limit(n - len(rows)).collect()
            head = next((r["cells"] for r in got if not r["k"]), None) if head is None else head
            rows += [r["cells"] for r in got if r["k"]]
            at, step = at + step, min(step * 8, 512)
        return head, rows


def _whole(found: DataFrame, o: Options) -> DataFrame:
    """The rows that reach over splits, put together: one line each."""
    return found.where("_part is not null").groupBy("_f", "_b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), o.line_terminator).alias("line"))


def read(spark: SparkSession, path: str | list[str], **options) -> Frame:
    o = Options(**options)
    lines, na = _Lines(spark, path, o), set(o.na_values)
    n = o.infer_rows or 100

    def raw(rows, parts):
        made = [(r, None, None, None, None) for r in rows] + [(None, *p) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["cells", "_f", "_b", "_n", "_part"])

    begins, over = lines.begins()
    head, sample = lines.first_rows(n)
    if len(sample) < n and (any(b for _, b in begins) or not lines.quoted):  # the first splits hold few rows
        found = lines.rows(begins, raw, "cells array<string>", o.header)
        sample += [r["cells"] for r in found.where("cells is not null").limit(n).collect()]
        sample += [cells for r in _whole(found, o).limit(n).collect() if (cells := split_row(r["line"], o)) is not None]
    if head is None and (o.header or not sample):
        return Frame(spark.createDataFrame([], "X1 bigint"))
    names = head if o.header else [f"X{i + 1}" for i in range(max(map(len, sample)))]
    if o.infer_rows is None:
        kinds = _over_all(lines, begins, names, na)
    else:
        kinds = [infer([r[i] for r in sample if i < len(r)], na) for i in range(len(names))]
    kinds = [dtype(o.types[n]) if n in o.types else k for n, k in zip(names, kinds)]
    schema, strict = ", ".join(f"`{n}` {SPARK[k].simpleString()}" for n, k in zip(names, kinds)), o.strict

    def cell(row, i, kind):
        text = row[i] if i < len(row) else ""
        if text in na or (text == "" and kind != STRING):
            return None
        found = parse(text, kind)
        if found is None and strict:
            raise ValueError(f"{text!r} is no {kind}")
        return found

    arrow = {INTEGER: pa.int64(), FLOAT: pa.float64(), STRING: pa.string(), VECTOR: pa.list_(pa.float64()), LIST: pa.list_(pa.string()), DICT: pa.map_(pa.string(), pa.string())}
    ends = ["_f", "_b", "_n", "_part"]

    def typed(rows, parts):
        columns = [pa.array([cell(r, i, k) for r in rows] + [None] * len(parts), arrow[k]) for i, k in enumerate(kinds)]
        tail = [pa.array([None] * len(rows) + [p[i] for p in parts], pa.string() if i == 3 else pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns + tail, names + ends)

    found = lines.rows(begins, typed, schema, o.header)
    df = found.where("_part is null").drop(*ends)
    if over:
        def late(batches):
            for batch in batches:
                rows = [r for text in batch.column(0).to_pylist() if (r := split_row(text, o)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([cell(r, i, k) for r in rows], arrow[k]) for i, k in enumerate(kinds)], names)

        df = df.unionAll(_whole(found, o).select("line").mapInArrow(late, schema))
    df = df.limit(o.nrows) if o.nrows is not None else df
    return Frame(df.select(*[f"`{c}`" for c in o.usecols]) if o.usecols else df)


def _over_all(lines: _Lines, begins: dict, names: list[str], na: set[str]) -> list[str]:
    """The type of each column by all rows: each task tells which types its cells fit."""
    o = lines.o

    def told(rows, parts):
        rows = [*rows, *[r for p in parts if (r := split_row(p[3], o)) is not None and len(r) == len(names)]]
        fit = [list(fits([r[i] for r in rows if i < len(r)], na).values()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array([fit], pa.list_(pa.list_(pa.bool_()))), *[pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]], ["fit", "_f", "_b", "_n", "_part"])

    found = lines.rows(begins, told, "fit array<array<boolean>>", o.header).select(F.posexplode("fit").alias("i", "fit"))
    all_ = found.groupBy("i").agg(*[F.bool_and(F.col("fit")[j]).alias(k) for j, k in enumerate(TYPES)])
    by = {r["i"]: next(k for k in TYPES if r[k]) for r in all_.collect()}  # one row a column
    return [by.get(i, INTEGER) for i in range(len(names))]


def misfits(spark: SparkSession, path: str, **options) -> dict[str, int]:
    """For each column that read() would make, how many cells do not fit its type."""
    asked = read(spark, path, **options)
    texts = read(spark, path, **options | {"types": dict.fromkeys(asked.column_names, STRING), "strict": False, "usecols": None})
    kinds, na = asked.dtypes, set(options.get("na_values", ()))

    def run(batches):
        for batch in batches:
            counts = [sum(c is not None and c != "" and c not in na and parse(c, kinds[n]) is None for c in batch.column(n).to_pylist()) for n in kinds]
            yield pa.RecordBatch.from_arrays([pa.array([counts], pa.list_(pa.int64()))], ["n"])

    found = texts.df.select(*[f"`{n}`" for n in kinds]).mapInArrow(run, "n array<bigint>").select(F.posexplode("n").alias("i", "n"))
    by = {r["i"]: r["n"] for r in found.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row a column
    return {n: by.get(i, 0) for i, n in enumerate(kinds)}


def _text(value, kind: str) -> str:
    if kind == FLOAT and not math.isfinite(value):
        return str(value)
    return json.dumps(value, ensure_ascii=False)


def write(frame: Frame, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\", line_terminator: str = "\n", na_rep: str = "", header: bool = True, quoting: str = "minimal", single_file: bool = True) -> None:
    """Text lines built from expressions; quoting is minimal, all, nonnumeric or none. single_file writes in one task; at scale set it to False, and each file has the header."""
    if quoting not in ("minimal", "all", "nonnumeric", "none"):
        raise ValueError(quoting)

    def quoted(c):
        inner = F.replace(F.replace(c, F.lit(escape), F.lit(escape * 2)) if escape else c, F.lit(quote), F.lit(quote * 2))
        return F.concat(F.lit(quote), inner, F.lit(quote))

    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        text = F.to_json(c) if kind in (VECTOR, LIST, DICT) else F.unix_seconds(c).cast("string") if kind == "datetime" else c.cast("string")
        numeric = kind in (INTEGER, FLOAT)
        if quoting == "all" or quoting == "nonnumeric" and not numeric:
            text = quoted(text)
        elif quoting == "minimal" and not numeric:
            special = text.contains(delimiter) | text.contains(quote) | text.contains(line_terminator) | text.contains("#") | text.startswith("[") | text.startswith("{") | (text != F.trim(text))
            text = F.when(special, quoted(text)).otherwise(text)
        return F.coalesce(text, F.lit(na_rep))

    spark, df = frame.df.sparkSession, frame.df
    lines = df.select(F.concat_ws(delimiter, *[cell(n, k) for n, k in frame.dtypes.items()]).alias("value"))
    title = delimiter.join([f"{quote}{n}{quote}" if quoting == "all" else n for n in frame.column_names])
    if single_file:
        lines = lines.coalesce(1)
        lines = spark.createDataFrame([(title,)], "value string").coalesce(1).unionAll(lines).coalesce(1) if header else lines
    elif header:  # on the first row of each file, as readers drop the first row of each
        begins = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines = lines.select(F.when(begins, F.concat(F.lit(title + line_terminator), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode("overwrite").option("lineSep", line_terminator).text(path)

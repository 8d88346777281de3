"""Tables and columns: building, assignment, order, missing values, errors, sinks and sources."""

import math

import pytest
from pyspark.sql import functions as F

from granary import plans
from granary.functions import parser
from granary.operators import aggregates as A
from granary.operators.frame import Frame, Series
from granary.session import configure, size
from granary.sources import native, parquet
from granary.streaming import append_to


@pytest.fixture
def small(spark):
    return Frame.from_rows(spark, {"a": [3, None, 1, 2], "b": [1.5, float("nan"), -0.0, None], "s": ["x", "", None, "y"]})


def test_building(spark, small):
    import pandas as pd

    assert small.schema == [("a", "integer"), ("b", "float"), ("s", "string")] and small.num_cols == 3 and small.shape == (4, 3) and small.size == 4
    assert small.column_types == ["integer", "float", "string"]
    assert Frame.from_rows(spark, [{"x": 1}, {"y": [1, 2.5]}]).to_list() == [{"x": 1, "y": None}, {"x": None, "y": [1.0, 2.5]}]
    assert Frame.from_rows(spark, None).shape == (0, 0) and Frame.from_rows(spark, {}).num_columns == 0
    assert Frame.from_rows(spark, pd.DataFrame({"x": [1, 2]})).to_list() == [{"x": 1}, {"x": 2}]
    assert Frame.from_rows(spark, {"d": [{"k": 1, "l": "m"}, None]}).dtypes == {"d": "dict"}
    assert Frame.from_columns({"x": small["a"], "y": small["a"] + 1}).to_list()[0] == {"x": 3, "y": 4}
    other = Series.of(spark, [10, 20, 30, 40])
    assert Frame.from_rows(spark, {"x": small["a"], "y": other}).to_list()[2] == {"x": 1, "y": 30}
    assert Series.range(spark, 5, 3, 2).to_list() == [5, 7, 9] and Series.constant(spark, "c", 2).to_list() == ["c", "c"]
    assert Series.of(spark, [1, 2.5]).dtype == "float" and Series.of(spark, [None, True]).to_list() == [None, 1]
    with pytest.raises(ValueError):
        Frame.from_rows(spark, {"x": [1], "y": [1, 2]})


def test_assignment_leaves_what_was_taken_before(small):
    a, copy = small["a"], small.copy()
    small["a"] = small["a"] * 10
    small["c"] = a + 1
    small["d"] = 7
    del small["s"]
    assert small.column_names == ["a", "b", "c", "d"] and "s" not in small
    assert [r["a"] for r in small.to_list()] == [30, None, 10, 20] and [r["c"] for r in small.to_list()] == [4, None, 2, 3]
    assert a.to_list() == [3, None, 1, 2] and copy.column_names == ["a", "b", "s"]
    with pytest.raises(KeyError):
        del small["nothing"]


def test_columns_of_two_tables(spark, small):
    other = Frame.from_rows(spark, {"z": [1, 2, 3, 4]})
    assert (small["a"] + other["z"]).to_list() == [4, None, 4, 6]
    assert small[other["z"] > 2].to_list() == small.to_list()[2:]
    assert small["a"][other["z"] < 2].to_list() == [3]
    with pytest.raises(ValueError, match="length"):
        small.add_column("n", Series.of(spark, [1, 2]))


def test_ordinals_above_a_shuffle(spark):
    f = Frame(spark.range(20_000).repartition(7)).add_row_number("n")
    rows = f.to_list()
    assert [r["n"] for r in rows] == list(range(20_000)) and {r["id"] for r in rows} == set(range(20_000))
    g = Frame(spark.range(5_000).withColumn("k", F.col("id") % 10)).sort([("k", True), ("id", False)]).add_row_number("n")
    assert [(r["k"], r["id"]) for r in sorted(g.to_list(), key=lambda r: r["n"])] == sorted(((i % 10, i) for i in range(5_000)), key=lambda x: (x[0], -x[1]))


def test_order_and_slices(small):
    assert [r["a"] for r in small.sort("a").to_list()] == [1, 2, 3, None] and [r["a"] for r in small.sort("a", ascending=False).to_list()] == [None, 3, 2, 1]
    assert [r["a"] for r in small[-2:].to_list()] == [1, 2] and [r["a"] for r in small[1:-1].to_list()] == [None, 1] and small[10:].to_list() == []
    assert small[-1]["a"] == 2 and small["a"][1:3].to_list() == [None, 1] and small["a"][0] == 3
    with pytest.raises(ValueError):
        small[::2]
    with pytest.raises(IndexError):
        small[9]
    assert small["a"].sort(ascending=False).to_list() == [None, 3, 2, 1] and small["a"].tail(1).to_list() == [2]


def test_numbers(spark, small):
    assert (small["b"] / 0.0).to_list()[0] == math.inf and (small["a"] / 0).to_list() == [None] * 4
    zero = Series.of(spark, [0.0, -0.0, float("nan")])
    assert (zero == 0.0).to_list() == [1, 1, 0] and (zero == zero).to_list() == [1, 1, 1]
    big = Series.of(spark, [2**62])
    with pytest.raises(Exception, match="OVERFLOW"):
        (big + big + big).to_list()
    assert (Series.of(spark, [7, -7]) // 2).to_list() == [3, -4] and (Series.of(spark, [7.5, -7.5]) // 2).to_list() == [3.0, -4.0]
    assert (2 ** Series.of(spark, [3])).to_list() == [8.0] and (10 // Series.of(spark, [3])).to_list() == [3]
    assert (+small["a"]).to_list() == small["a"].to_list() and abs(Series.of(spark, [-1, None])).to_list() == [1, None]
    assert (Series.of(spark, [[1.0, 2.0], [1.0]]) + Series.of(spark, [[1.0, 1.0], [1.0, 2.0]])).to_list() == [[2.0, 3.0], None]
    with pytest.raises(ValueError):
        bool(small["a"])
    with pytest.raises(TypeError):
        small["s"] * 2


def test_casts(spark):
    text = Series.of(spark, ["1", " 2", "x", "2.9", None])
    assert text.astype(int).to_list() == [1, None, None, 2, None] and text.astype(float).to_list() == [1.0, None, None, 2.9, None]
    assert Series.of(spark, [1e30, -1e30, float("nan"), 2.9]).astype(int).to_list() == [2**63 - 1, -(2**63), 0, 2]
    assert Series.of(spark, [1.0, 1e21, float("inf")]).astype(str).to_list() == ["1", "1000000000000000000000", "inf"]
    assert Series.of(spark, ["[1;2]", "[1 2.5]", "[a]", "no"]).astype("vector").to_list() == [[1.0, 2.0], [1.0, 2.5], None, None]
    assert Series.of(spark, ['{a: 1, "b": [x, y]}', "{}", "{1}"]).astype(dict).to_list()[0] == {"a": "1", "b": "[x, y]"}
    assert Series.of(spark, ["[a, 'b', 3]"]).astype(list).to_list() == [["a", "b", "3"]]
    assert parser.parse("[1,2", "vector") is None and parser.parse("9" * 30, "integer") is None
    assert Series.of(spark, [["1", "x"]], "list").astype("vector").to_list() == [[1.0, None]]
    assert Series.of(spark, [[1.0, 2.5]]).astype(list).to_list() == [["1.0", "2.5"]] and Series.of(spark, [0]).astype("datetime").astype(int).to_list() == [0]


def test_missing(small):
    assert small.dropna().num_rows() == 1 and small.dropna("a").num_rows() == 3 and small.dropna(["a", "s"], how="all").num_rows() == 4
    kept, dropped = small.dropna_split("s")
    assert kept.num_rows() == 3 and dropped.num_rows() == 1
    assert small["a"].fillna(0).to_list() == [3, 0, 1, 2] and small["a"].dropna().to_list() == [3, 1, 2]
    assert None in small["a"] and 3 in small["a"] and 9 not in small["a"]
    assert small["a"].is_in(small["a"]).to_list() == [1, 1, 1, 1] and small["a"].is_in([None, 2]).to_list() == [0, 1, 0, 1]
    with pytest.raises(TypeError):
        small["a"].fillna("x")


def test_aggregates(spark, small):
    got = small.aggregate({"f": A.FREQ_COUNT("s"), "n": A.COUNT(), "m": A.MEDIAN("a"), "c": A.CONCAT("a"), "one": A.SELECT_ONE("a")}).to_list()[0]
    assert got["f"] == {"x": 1, "": 1, "y": 1} and (got["n"], got["m"], got["c"]) == (4, 2.0, [3, None, 1, 2]) and got["one"] in (1, 2, 3)
    vectors = Frame.from_rows(spark, {"v": [[1.0, 2.0], None, [3.0, 5.0]]})
    assert vectors.aggregate({"s": A.VECTOR_SUM("v"), "m": A.VECTOR_AVG("v")}).to_list() == [{"s": [4.0, 7.0], "m": [2.0, 3.5]}]
    assert vectors.aggregate({"s": A.VECTOR_SUM("v")}).num_rows() == 1
    empty = Frame(small.df.where("a > 100"))
    assert empty.aggregate({"n": A.COUNT(), "q": A.QUANTILE("a", 0.5), "t": A.SUM("a")}).to_list() == [{"n": 0, "q": None, "t": None}]
    values = [5, 1, None, 4, 4, 2, 9, 7, 7, 7, 3]
    present = sorted(v for v in values if v is not None)
    for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0):
        assert Series.of(spark, values).quantile(q) == present[math.floor((len(present) - 1) * q + 0.5)]
    assert Series.of(spark, values).median() == 4.0 or Series.of(spark, values).median() == 5.0
    assert Series.of(spark, values).frequent_items(1) == {"7": 3} and abs(Series.of(spark, values).approx_count_distinct() - 7) <= 1
    everything = Series.of(spark, values).reductions()
    assert everything["sum"] == sum(present) and everything["num_missing"] == 1 and everything["any"] and everything["all"]
    longest = A.Reducer(lambda: "", lambda s, x: max(s, x or "", key=len), lambda s, t: max(s, t, key=len), str.upper)
    assert Frame(spark.createDataFrame([("a",), ("abc",), (None,), ("ab",)], "t string").repartition(25))["t"].reduce_with(longest) == "ABC"


def test_row_functions(small):
    out = small.apply_rows(lambda r: (r["a"] + 1, [r["a"], 2]), {"n": int, "v": "vector"})
    assert out.to_list() == [{"n": 4, "v": [3.0, 2.0]}, {"n": None, "v": None}, {"n": 2, "v": [1.0, 2.0]}, {"n": 3, "v": [2.0, 2.0]}]
    assert small["a"].apply(lambda x: 1 / 0).to_list() == [None] * 4 and small.filter("a", lambda x: x > 1).num_rows() == 2


def test_shape_errors(spark, small):
    with pytest.raises(ValueError, match="names"):
        small.append(small.rename({"a": "z"}))
    with pytest.raises(ValueError, match="exists"):
        small.add_column("a", small["b"])
    with pytest.raises(ValueError):
        small.rename({"a": "b"})
    with pytest.raises(KeyError):
        small["zz"]
    wide = Frame(spark.range(1).select(F.map_from_arrays(F.sequence(F.lit(0), F.lit(10_000)).cast("array<string>"), F.sequence(F.lit(0), F.lit(10_000))).alias("m")))
    with pytest.raises(ValueError, match="keys"):
        wide.unpack_column("m")


def test_metadata_and_folders(spark, small, tmp_path):
    tagged = small.with_metadata(origin="here", other="x").without_metadata("other")
    tagged.save(str(tmp_path / "t"))
    assert native.load(spark, str(tmp_path / "t")).metadata == {"origin": "here"} == tagged[1:3].metadata
    names = Frame(spark.range(100).repartition(4)).to_parquet_sharded(str(tmp_path / "shard"))
    assert [n.rpartition("/")[2] for n in names] == [f"shard_{i}_of_4.parquet" for i in range(4)]
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == [*(f"shard_{i}_of_4.parquet" for i in range(4)), "t"]
    every = [r["id"] for r in parquet.read(spark, names).to_list()]
    assert [r["id"] for r in sorted(parquet.read(spark, names, rows=(20, 70)).add_row_number("n").to_list(), key=lambda r: r["n"])] == [r["id"] for f in names for r in spark.read.parquet(f).collect()][20:70]
    assert sorted(every) == list(range(100)) and parquet.read(spark, names, rows=(200, 300)).num_rows() == 0


def test_plans_and_display(small, capsys):
    small.print_rows()
    small["a"].print_rows(2)
    small["a"].explain()
    assert capsys.readouterr().out.count("|") > 10
    joined = small.join(small, "a")
    assert "Join" in plans.text(joined) and plans.dot(joined).count("->") >= 2 and repr(small["a"]) == "Series(name='a', dtype='integer')"


def test_streams(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        append_to(stream.where("id > 4"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()) == [5, 6, 7, 8, 9]


def test_configuration(spark):
    assert [size(x) for x in ("64", "2k", "1.5 MiB", 7)] == [64, 2048, 3 << 19, 7]
    with pytest.raises(ValueError):
        size("3 parsecs")
    before = configure(spark)
    try:
        assert configure(spark, split_bytes="32m", batch_rows=5000)["split_bytes"] == 32 << 20
    finally:
        configure(spark, **{k: before[k] for k in ("split_bytes", "batch_rows")})
    with pytest.raises(ValueError, match="unknown"):
        configure(spark, speed=11)


def test_files_behind_addresses(spark, tmp_path):
    import functools
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    from granary.sources import csv, http

    (tmp_path / "www").mkdir()
    (tmp_path / "www" / "t.csv").write_text("a,b\n1,x\n2,y\n")
    server = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(SimpleHTTPRequestHandler, directory=str(tmp_path / "www")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}"
    try:
        paths = http.fetch(spark, [f"{address}/t.csv", f"{address}/t.csv?again"], str(tmp_path / "in"))
        assert sorted(r["a"] for r in csv.read(spark, paths).to_list()) == [1, 1, 2, 2]
        with pytest.raises(Exception, match="FileNotFound"):
            http.fetch(spark, f"{address}/nothing.csv", str(tmp_path / "in"))
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        http.fetch(spark, "ftp://x/y", str(tmp_path / "in"))


def test_batches(spark):
    assert [len(b) for b in Frame.range(spark, 0, 10).iter_batches(4)] == [4, 4, 2] and list(Frame(spark.range(0)).iter_batches()) == []

"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators.frame import Frame, Series
from .sources import csv, json, native, parquet
from .sources.writer import StreamWriter

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _frame(spark: SparkSession, d: str, name: str) -> Frame:
    return parquet.read(spark, f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; one of our own only where all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="granary-")
    return f"{base.rstrip('/')}/io-{uuid.uuid4().hex}"


# The lineitem columns that most queries use; missing values are made where a query is about them.
def _items(spark: SparkSession, d: str) -> Frame:
    df = _frame(spark, d, "lineitem").df
    return Frame(df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", F.nullif("l_linenumber", F.lit(3).cast("long")).alias("n"), F.nullif("l_quantity", F.lit(1.0)).alias("q")))


_NQ = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_discount, l_returnflag, CAST(nullif(l_linenumber, 3) AS BIGINT) AS n, nullif(l_quantity, 1.0) AS q FROM lineitem"
_KEY = "l_orderkey, l_linenumber"


def _item_column(name: str, f, sql: str) -> None:
    """A query that adds column r to the keys of lineitem."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        items = _items(spark, d)
        return items.add_column("r", f(items)).select(["l_orderkey", "l_linenumber", "r"]).df

    QUERIES[name] = run
    ORACLE[name] = f"WITH t AS ({_NQ}) SELECT {_KEY}, {sql} AS r FROM t"


# Scans and mutation
@_query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_parquet(spark, d):
    return _frame(spark, d, "customer").df


@_query("SELECT o_orderstatus, o_orderkey FROM orders")
def select_columns(spark, d):
    return _frame(spark, d, "orders")[["o_orderstatus", "o_orderkey"]].df


@_query("SELECT c_custkey AS id, c_mktsegment FROM customer")
def rename_columns(spark, d):
    return _frame(spark, d, "customer").rename({"c_custkey": "id"})[["id", "c_mktsegment"]].df


@_query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def swap_columns(spark, d):
    return _frame(spark, d, "region").swap_columns("r_regionkey", "r_name").df


@_query("SELECT c_custkey, c_acctbal, c_acctbal * 2.0 AS twice FROM customer")
def add_column(spark, d):
    f = _frame(spark, d, "customer")[["c_custkey", "c_acctbal"]]
    return f.add_column("twice", f["c_acctbal"] * 2.0).df


@_query("SELECT c_custkey, c_acctbal + 1.0 AS c_acctbal FROM customer")
def replace_column(spark, d):
    f = _frame(spark, d, "customer")[["c_custkey", "c_acctbal"]]
    return f.replace_column("c_acctbal", f["c_acctbal"] + 1.0).df


@_query("SELECT r_name FROM region")
def remove_column(spark, d):
    return _frame(spark, d, "region").remove_column("r_regionkey").df


# Filters
@_query(f"WITH t AS ({_NQ}) SELECT {_KEY} FROM t WHERE l_quantity > 30")
def filter_condition(spark, d):
    return _items(spark, d).where(F.col("l_quantity") > 30)[["l_orderkey", "l_linenumber"]].df


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY} FROM t WHERE n > 2 OR n IS NULL")
def filter_mask(spark, d):
    f = _items(spark, d)
    return f[f["n"] > 2][["l_orderkey", "l_linenumber"]].df


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def filter_by_list(spark, d):
    return _frame(spark, d, "orders").filter_by(["O", "P"], "o_orderstatus")[["o_orderkey", "o_orderstatus"]].df


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def filter_by_exclude_column(spark, d):
    return _frame(spark, d, "customer").filter_by(_frame(spark, d, "orders")["o_custkey"], "c_custkey", exclude=True)[["c_custkey"]].df


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def filter_by_column(spark, d):
    return _frame(spark, d, "customer").filter_by(_frame(spark, d, "orders")["o_custkey"], "c_custkey")[["c_custkey"]].df


@_query("SELECT p_partkey FROM part WHERE p_size % 7 = 3")
def udf_filter(spark, d):
    return _frame(spark, d, "part").filter("p_size", lambda x: x % 7 == 3)[["p_partkey"]].df


# Comparison, logic, arithmetic: missing equals itself and is greatest.
for _name, _f, _sql in [
    ("cmp_eq", lambda f: f["n"] == f["l_linenumber"], "CAST(n IS NOT DISTINCT FROM l_linenumber AS BIGINT)"),
    ("cmp_ne", lambda f: f["n"] != 2, "CAST(n IS DISTINCT FROM 2 AS BIGINT)"),
    ("cmp_lt", lambda f: f["n"] < 4, "CASE WHEN n IS NULL THEN 0 ELSE CAST(n < 4 AS BIGINT) END"),
    ("cmp_le", lambda f: f["n"] <= 4, "CASE WHEN n IS NULL THEN 0 ELSE CAST(n <= 4 AS BIGINT) END"),
    ("cmp_gt", lambda f: f["n"] > 4, "CASE WHEN n IS NULL THEN 1 ELSE CAST(n > 4 AS BIGINT) END"),
    ("cmp_ge", lambda f: f["n"] >= f["l_linenumber"], "CASE WHEN n IS NULL THEN 1 ELSE CAST(n >= l_linenumber AS BIGINT) END"),
    ("logical_and", lambda f: (f["n"] > 1) & f["n"], "CASE WHEN n > 1 AND n <> 0 THEN CAST(1 AS BIGINT) ELSE 0 END"),
    ("logical_or", lambda f: (f["n"] == 1) | (f["l_quantity"] > 40), "CAST((n IS NOT DISTINCT FROM 1) OR l_quantity > 40 AS BIGINT)"),
    ("arith_add", lambda f: f["n"] + f["l_linenumber"], "n + l_linenumber"),
    ("arith_sub", lambda f: 10 - f["n"], "10 - n"),
    ("arith_mul", lambda f: f["q"] * f["l_discount"], "q * l_discount"),
    ("arith_div", lambda f: f["l_linenumber"] / (f["n"] - 2), "CASE WHEN n - 2 <> 0 THEN CAST(l_linenumber AS DOUBLE) / (n - 2) END"),
    ("arith_div_float_zero", lambda f: f["l_quantity"] / (f["l_quantity"] - f["l_quantity"]), "CAST('inf' AS DOUBLE)"),
    ("arith_mod", lambda f: (f["n"] - 4) % 3, "(n - 4) % 3"),
    ("arith_floordiv", lambda f: (f["n"] - 4) // 3, "CAST(floor((n - 4) / 3.0) AS BIGINT)"),
    ("arith_pow", lambda f: f["n"] ** 2, "CAST(n * n AS DOUBLE)"),
    ("arith_neg_abs", lambda f: abs(-f["n"] + 2), "abs(-n + 2)"),
    ("clip", lambda f: f["q"].clip(10.0, 20.0), "CASE WHEN q < 10 THEN 10.0 WHEN q > 20 THEN 20.0 ELSE q END"),
    ("clip_lower", lambda f: f["n"].clip_lower(3), "CASE WHEN n < 3 THEN 3 ELSE n END"),
    ("clip_upper", lambda f: f["n"].clip_upper(3), "CASE WHEN n > 3 THEN 3 ELSE n END"),
    ("fillna", lambda f: f["n"].fillna(-1), "coalesce(n, -1)"),
    ("is_na", lambda f: f["n"].is_na(), "CAST(n IS NULL AS BIGINT)"),
    ("is_in", lambda f: f["n"].is_in([1, None]), "CAST(n IS NULL OR n = 1 AS BIGINT)"),
    ("astype_int", lambda f: (f["q"] / 3.0).astype(int), "CAST(trunc(q / 3.0) AS BIGINT)"),
    ("astype_float", lambda f: f["n"].astype(float), "CAST(n AS DOUBLE)"),
    ("astype_str", lambda f: f["q"].astype(str), "CAST(CAST(q AS BIGINT) AS VARCHAR)"),
    ("astype_int_str", lambda f: f["n"].astype(str), "CAST(n AS VARCHAR)"),
    ("astype_str_int", lambda f: f["n"].astype(str).astype(int), "n"),
    ("astype_str_float", lambda f: f["l_discount"].astype(str).astype(float), "l_discount"),
    ("astype_text_no_number", lambda f: f["l_returnflag"].astype(int).fillna(-1), "CAST(-1 AS BIGINT)"),
    ("reflected", lambda f: 100 / (f["n"] * 2) + 7 % f["n"], "CAST(100 AS DOUBLE) / (n * 2) + 7 % n"),
    ("string_concat", lambda f: "x" + f["l_returnflag"] + f["l_returnflag"], "'x' || l_returnflag || l_returnflag"),
    ("item_length", lambda f: f["l_returnflag"].item_length(), "CAST(octet_length(encode(l_returnflag)) AS BIGINT)"),
    ("udf_apply", lambda f: f["n"].apply(lambda x: x * x + 1), "n * n + 1"),
]:
    _item_column(_name, _f, _sql)


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY}, n, q FROM t WHERE n IS NOT NULL AND q IS NOT NULL")
def dropna_any(spark, d):
    return _items(spark, d).dropna(["n", "q"])[["l_orderkey", "l_linenumber", "n", "q"]].df


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY}, n, q FROM t WHERE n IS NOT NULL OR q IS NOT NULL")
def dropna_all(spark, d):
    return _items(spark, d).dropna(["n", "q"], how="all")[["l_orderkey", "l_linenumber", "n", "q"]].df


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY} FROM t WHERE n IS NULL OR q IS NULL")
def dropna_split(spark, d):
    return _items(spark, d).dropna_split(["n", "q"])[1][["l_orderkey", "l_linenumber"]].df


# Vectors
def _vectors(spark, d) -> Frame:
    return _frame(spark, d, "embeddings")[["vec_id", "embedding"]]


def _flat(f: Frame, name: str) -> DataFrame:
    return f.df.select("vec_id", F.posexplode(name).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _flat_sql(expr: str) -> str:
    return f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT vec_id, {expr} AS v FROM e) SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(v), 6) AS x FROM f"


@_query(_flat_sql("[x + x FOR x IN v]"))
def vec_add(spark, d):
    f = _vectors(spark, d)
    return _flat(f.add_column("r", f["embedding"] + f["embedding"]), "r")


@_query(_flat_sql("[x * 3.0 FOR x IN v]"))
def vec_scale(spark, d):
    f = _vectors(spark, d)
    return _flat(f.add_column("r", f["embedding"] * 3), "r")


@_query(_flat_sql("list_slice(v, 3, 6)"))
def vec_slice(spark, d):
    f = _vectors(spark, d)
    return _flat(f.add_column("r", f["embedding"].vector_slice(2, 6)), "r")


# Aggregates
def _grouped(name: str, agg: A.Agg, sql: str, wrap=lambda c: c) -> None:
    def run(spark, d):
        return _items(spark, d).groupby("l_returnflag", {"r": agg}).df.select("l_returnflag", wrap(F.col("r")).alias("r"))

    QUERIES[name], ORACLE[name] = run, f"WITH t AS ({_NQ}) SELECT l_returnflag, {sql} AS r FROM t GROUP BY l_returnflag"


def _rounded(c):
    return F.round(c, 4)


for _name, _agg, _sql, _wrap in [
    ("agg_count", A.COUNT("n"), "count(n)", None), ("agg_count_rows", A.COUNT(), "count(*)", None),
    ("agg_non_null_count", A.NON_NULL_COUNT("q"), "count(q)", None), ("agg_sum", A.SUM("n"), "CAST(sum(n) AS BIGINT)", None),
    ("agg_mean", A.MEAN("n"), "round(avg(n), 4)", _rounded), ("agg_min", A.MIN("n"), "min(n)", None), ("agg_max", A.MAX("q"), "max(q)", None),
    ("agg_variance", A.VARIANCE("n"), "round(var_samp(n), 4)", _rounded), ("agg_var_pop", A.VAR_POP("n"), "round(var_pop(n), 4)", _rounded),
    ("agg_std", A.STD("n"), "round(stddev_samp(n), 4)", _rounded), ("agg_std_pop", A.STD_POP("n"), "round(stddev_pop(n), 4)", _rounded),
    ("agg_count_distinct", A.COUNT_DISTINCT("n"), "count(DISTINCT n)", None), ("agg_count_na", A.COUNT_NA("n"), "count(*) - count(n)", None),
    ("agg_nnz", A.NNZ("n"), "count(*) FILTER (WHERE n <> 0)", None), ("agg_any", A.ANY("n"), "CAST(coalesce(bool_or(n <> 0), false) AS BIGINT)", None),
    ("agg_all", A.ALL("n"), "CAST(coalesce(bool_and(n <> 0), true) AS BIGINT)", None),
    ("agg_quantile", A.QUANTILE("n", 0.3), "CAST(list_sort(list(n) FILTER (WHERE n IS NOT NULL))[CAST(floor((count(n) - 1) * 0.3 + 0.5) AS BIGINT) + 1] AS DOUBLE)", None),
    ("agg_median", A.MEDIAN("n"), "CAST(list_sort(list(n) FILTER (WHERE n IS NOT NULL))[CAST(floor((count(n) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS DOUBLE)", None),
]:
    _grouped(_name, _agg, _sql, _wrap or (lambda c: c))


# All values of a group in row order, missing ones too.
for _name, _agg, _c in [("agg_concat", A.CONCAT, "n"), ("agg_zip_list", A.ZIP_LIST, "q")]:

    @_query(f"WITH t AS (SELECT l_returnflag, l_linenumber, l_quantity, row_number() OVER () AS o FROM lineitem), u AS (SELECT l_returnflag, o, CAST(nullif(l_linenumber, 3) AS BIGINT) AS n, nullif(l_quantity, 1.0) AS q FROM t) SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY o) - 1 AS i, {_c} AS v FROM u", name=_name)
    def _in_order(spark, d, agg=_agg, c=_c):
        out = _items(spark, d).groupby("l_returnflag", {"r": agg(c)})
        return out.df.select("l_returnflag", F.posexplode("r").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@_query("SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 1 THEN 'customer ' || o_custkey END) AS r FROM orders GROUP BY 1")
def agg_select_one(spark, d):
    f = _frame(spark, d, "orders").df.select("o_custkey", F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("customer "), F.col("o_custkey"))).alias("x"))
    return Frame(f).groupby("o_custkey", {"r": A.SELECT_ONE("x")}).df


@_query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS near FROM lineitem GROUP BY 1")
def agg_approx_distinct(spark, d):
    out = _items(spark, d).groupby("l_returnflag", {"a": A.APPROX_COUNT_DISTINCT("l_orderkey"), "exact": A.COUNT_DISTINCT("l_orderkey")})
    return out.df.select("l_returnflag", "exact", (F.abs(F.col("a") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@_query(f"WITH t AS ({_NQ}) SELECT CAST(n AS VARCHAR) AS v, count(*) AS c FROM t WHERE n IS NOT NULL GROUP BY 1")
def aggregate_frequency_count(spark, d):
    return _items(spark, d).aggregate({"r": A.FREQ_COUNT("n")}).df.select(F.explode("r").alias("v", "c"))


@_query("WITH e AS (SELECT unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT i, round(sum(x), 5) AS s, round(avg(x), 5) AS m FROM e GROUP BY 1")
def aggregate_vector_sum(spark, d):
    out = _vectors(spark, d).aggregate({"s": A.VECTOR_SUM("embedding"), "m": A.VECTOR_AVG("embedding")})
    return out.df.select(F.posexplode(F.arrays_zip("s", "m")).alias("i", "z")).select(F.col("i").cast("long").alias("i"), F.round("z.s", 5).alias("s"), F.round("z.m", 5).alias("m"))


@_query(f"WITH t AS ({_NQ}) SELECT count(*) AS n, CAST(list_sort(list(n) FILTER (WHERE n IS NOT NULL))[CAST(floor((count(n) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS DOUBLE) AS high, CAST(sum(n) AS BIGINT) AS total FROM t")
def aggregate_mixed(spark, d):
    return _items(spark, d).aggregate({"n": A.COUNT(), "high": A.QUANTILE("n", 0.9), "total": A.SUM("n")}).df


@_query(f"WITH t AS ({_NQ}) SELECT CAST(sum(n * n) AS BIGINT) AS squares, count(*) - count(n) AS missing FROM t")
def reduce_with(spark, d):
    squares = A.Reducer(lambda: (0, 0), lambda s, x: (s[0], s[1] + 1) if x is None else (s[0] + x * x, s[1]), lambda s, t: (s[0] + t[0], s[1] + t[1]))
    return spark.createDataFrame([_items(spark, d)["n"].reduce_with(squares)], "squares bigint, missing bigint")


@_query(f"WITH t AS ({_NQ}) SELECT l_orderkey * 10 + l_linenumber AS place, l_returnflag || coalesce(CAST(n AS VARCHAR), '-') AS tag FROM t")
def apply_rows(spark, d):
    return _items(spark, d).apply_rows(lambda r: (r["l_orderkey"] * 10 + r["l_linenumber"], r["l_returnflag"] + ("-" if r["n"] is None else str(r["n"]))), {"place": int, "tag": str}).df


@_query(f"WITH t AS ({_NQ}) SELECT l_returnflag, CAST(n AS VARCHAR) AS v, count(*) AS c FROM t WHERE n IS NOT NULL GROUP BY 1, 2")
def agg_frequency_count(spark, d):
    out = _items(spark, d).groupby("l_returnflag", {"r": A.FREQ_COUNT("n")})
    return out.df.select("l_returnflag", F.explode("r").alias("v", "c"))


def _by_place(agg):
    def run(spark, d):
        f = Frame(_frame(spark, d, "embeddings").df.select("label", "embedding"))
        return f.groupby("label", {"r": agg("embedding")}).df.select("label", F.posexplode("r").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))

    return run


for _name, _agg, _f in [("agg_vector_sum", A.VECTOR_SUM, "sum"), ("agg_vector_avg", A.VECTOR_AVG, "avg")]:
    QUERIES[_name] = _by_place(_agg)
    ORACLE[_name] = f"WITH e AS (SELECT CAST(label AS BIGINT) AS label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, i, round({_f}(x), 5) AS x FROM e GROUP BY 1, 2"


@_query("SELECT event_type AS v, count(*) AS c FROM events GROUP BY 1")
def agg_frequent_items(spark, d):
    out = Frame(_frame(spark, d, "events").df.select(F.lit(1).alias("k"), "event_type")).groupby("k", {"r": A.FREQUENT_ITEMS("event_type", 10)})
    return out.df.select(F.explode("r").alias("v", "c"))


@_query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_rows(spark, d):
    return _frame(spark, d, "lineitem")[["l_returnflag", "l_linestatus"]].unique().df


@_query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def unique_column(spark, d):
    return _frame(spark, d, "customer")["c_mktsegment"].unique().frame.df


@_query(f"WITH t AS ({_NQ}) SELECT CAST(sum(n) AS BIGINT) AS s, round(avg(q), 4) AS m, min(n) AS lo, max(n) AS hi, round(stddev_pop(n), 4) AS sd, round(var_pop(n), 4) AS v, count(*) - count(n) AS na, count(*) FILTER (WHERE n <> 0) AS nz, true AS a, true AS l FROM t")
def column_reductions(spark, d):
    f = _items(spark, d)
    n = f["n"].reductions()
    row = (n["sum"], round(f["q"].mean(), 4), n["min"], n["max"], round(n["std"], 4), round(n["var"], 4), n["num_missing"], n["nnz"], n["any"], n["all"])
    return spark.createDataFrame([row], "s bigint, m double, lo bigint, hi bigint, sd double, v double, na bigint, nz bigint, a boolean, l boolean")


@_query(f"WITH t AS ({_NQ}) SELECT count(*) AS size, count(*) - count(n) AS missing, min(n) AS lo, max(n) AS hi, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n = 1) AS ones, true AS distinct_near, true AS median_near FROM t")
def sketch_summary(spark, d):
    items = _items(spark, d)
    s = items["n"].sketch_summary()
    median = items.aggregate({"m": A.MEDIAN("n")}).df.first()["m"]
    row = (s.size, s.num_undefined, s.min, s.max, s.sum, s.frequency_count(1), abs(s.num_unique - 6) <= 1, abs(s.quantile(0.5) - median) <= 1)
    return spark.createDataFrame([row], "size bigint, missing bigint, lo bigint, hi bigint, total bigint, ones bigint, distinct_near boolean, median_near boolean")


@_query("SELECT count(DISTINCT user_id) AS exact, true AS near FROM events")
def approx_distinct(spark, d):
    f = _frame(spark, d, "events")
    exact, about = f.aggregate({"e": A.COUNT_DISTINCT("user_id")}).df.first()["e"], f["user_id"].approx_count_distinct()
    return spark.createDataFrame([(exact, abs(about - exact) <= 0.05 * exact)], "exact bigint, near boolean")


@_query("SELECT event_type AS v, count(*) AS c FROM events GROUP BY 1")
def column_frequent_items(spark, d):
    return spark.createDataFrame(list(_frame(spark, d, "events")["event_type"].frequent_items(10).items()), "v string, c bigint")


# Joins of whole tables; a third of the customers and a fifth of the orders have keys that the other side does not know.
for _how in ("inner", "left", "right", "full"):

    @_query(f"SELECT coalesce(c.k, o.k) AS k, c.c_name, o.o_orderkey FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name FROM customer) c {_how} JOIN (SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_custkey - 1000000000 ELSE o_custkey END AS k, o_orderkey FROM orders) o ON c.k = o.k", name=f"join_{_how}")
    def _join(spark, d, how=_how):
        c = Frame(_frame(spark, d, "customer").df.select(F.when(F.col("c_custkey") % 3 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("k"), "c_name"))
        o = Frame(_frame(spark, d, "orders").df.select(F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey") - 1000000000).otherwise(F.col("o_custkey")).alias("ok"), "o_orderkey"))
        return c.join(o, {"k": "ok"}, how).df


_NATION = "SELECT CAST(nullif(n_regionkey, 2) AS BIGINT) AS k, n_name, CAST(n_nationkey AS BIGINT) AS id FROM nation"


def _nation(spark, d) -> Frame:
    return Frame(_frame(spark, d, "nation").df.select(F.nullif("n_regionkey", F.lit(2).cast("long")).alias("k"), "n_name", F.col("n_nationkey").alias("id")))


@_query(f'WITH t AS ({_NATION}) SELECT a.k, a.n_name, a.id, b.n_name AS "n_name.1", b.id AS "id.1" FROM t a JOIN t b ON a.k IS NOT DISTINCT FROM b.k')
def join_null_key_and_clash(spark, d):
    return _nation(spark, d).join(_nation(spark, d), "k").df


@_query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey")
def join_multi_key(spark, d):
    f = _frame(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    out = f[[*keys, "l_quantity"]].join(f[[*keys, "l_tax"]], keys)[["l_orderkey", "l_linenumber", "l_quantity", "l_tax"]].df
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


# Order
@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders")
def sort_and_row_number(spark, d):
    f = _frame(spark, d, "orders")[["o_orderkey", "o_orderdate"]]
    return f.sort([("o_orderdate", False), ("o_orderkey", True)]).add_row_number("place")[["o_orderkey", "place"]].df


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def topk(spark, d):
    return _frame(spark, d, "part")[["p_partkey", "p_retailprice"]].sort([("p_retailprice", False), ("p_partkey", True)]).head(10).df


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def topk_reverse(spark, d):
    return _frame(spark, d, "orders")[["o_orderkey"]].topk("o_orderkey", 10, reverse=True).df


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def head(spark, d):
    return _frame(spark, d, "orders")[["o_orderkey"]].sort("o_orderkey").head(7).df


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, d):
    return _frame(spark, d, "orders")[["o_orderkey"]].sort("o_orderkey").tail(7).df


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def slice_rows(spark, d):
    return _frame(spark, d, "orders")[["o_orderkey"]].sort("o_orderkey")[100:120].df


@_query("SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def append(spark, d):
    return _frame(spark, d, "customer")[["c_custkey"]].append(_frame(spark, d, "supplier").rename({"s_suppkey": "c_custkey"})[["c_custkey"]]).df


_DRAW = "CAST(('0x' || substr(md5('42:' || l_orderkey || ':' || l_linenumber), 1, 8)) AS BIGINT) < CAST(floor(0.3 * 4294967296) AS BIGINT)"


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY} FROM t WHERE {_DRAW}")
def sample(spark, d):
    return _items(spark, d).sample(0.3, 42, ["l_orderkey", "l_linenumber"])[["l_orderkey", "l_linenumber"]].df


@_query(f"WITH t AS ({_NQ}) SELECT {_KEY} FROM t WHERE NOT ({_DRAW})")
def random_split(spark, d):
    return _items(spark, d).random_split(0.3, 42, ["l_orderkey", "l_linenumber"])[1][["l_orderkey", "l_linenumber"]].df


@_query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS back FROM orders) WHERE back BETWEEN 4 AND 10")
def slice_from_the_end(spark, d):
    return _frame(spark, d, "orders")[["o_orderkey"]].sort("o_orderkey")[-10:-3].df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) FROM region UNION ALL SELECT s_suppkey FROM supplier")
def append_several(spark, d):
    n, r, s = (_frame(spark, d, t).rename({k: "id"})[["id"]] for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")))
    return n.append(r, s).df


@_query("SELECT o_orderkey, o_custkey, o_custkey + o_orderkey AS total FROM orders")
def column_union(spark, d):
    one, two = _frame(spark, d, "orders")[["o_orderkey"]], _frame(spark, d, "orders")[["o_custkey"]]
    f = one.add_column("o_custkey", two["o_custkey"])  # columns of two tables, zipped by their order
    return f.add_column("total", f["o_custkey"] + f["o_orderkey"]).df


@_query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS i FROM orders) WHERE i BETWEEN 100 AND 1099")
def parquet_row_range(spark, d):
    return parquet.read(spark, f"{d}/orders.parquet", rows=(100, 1100))[["o_orderkey"]].df


@_query("SELECT o_orderkey, o_custkey FROM orders")
def parquet_sharded(spark, d):
    path = _folder(spark)
    Frame(_frame(spark, d, "orders").df.select("o_orderkey", "o_custkey").repartition(3)).to_parquet_sharded(f"{path}/orders")
    return parquet.read(spark, f"{path}/orders_*_of_3.parquet").df


@_query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders) AS BIGINT) AS r FROM customer")
def is_in_column(spark, d):
    f = _frame(spark, d, "customer")[["c_custkey"]]
    found = f["c_custkey"].is_in(_frame(spark, d, "orders")["o_custkey"])
    return found.frame.add_column("r", found)[["c_custkey", "r"]].df


@_query(f"WITH t AS ({_NQ}) SELECT n AS value FROM t WHERE n > 2")
def column_filter(spark, d):
    n = _items(spark, d)["n"]
    return n[n > 2].dropna().frame.df


# Windows
for _f in ("sum", "mean", "min", "max", "count", "var", "std"):
    _sqlf = {"mean": "avg", "var": "var_samp", "std": "stddev_samp"}.get(_f, _f)

    @_query(f"SELECT event_id, CASE WHEN count(x) OVER w >= 3 THEN {f'{_sqlf}(x) OVER w' if _f not in ('var', 'std') else f'round({_sqlf}(x) OVER w, 6)'} END AS r FROM (SELECT event_id, CAST(nullif(event_id % 10, 7) AS BIGINT) AS x FROM events) WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)".replace("sum(x) OVER w END", "CAST(sum(x) OVER w AS BIGINT) END"), name=f"rolling_{_f}")
    def _rolling(spark, d, how=_f):
        f = Frame(_frame(spark, d, "events").df.select("event_id", F.nullif(F.col("event_id") % 10, F.lit(7).cast("long")).alias("x")))
        out = f.add_column("r", f["x"].rolling(how, 2, 1, 3, order_by="event_id"))[["event_id", "r"]].df
        return out.withColumn("r", F.round("r", 6)) if how in ("var", "std") else out


@_query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS r FROM events")
def rolling_by_key(spark, d):
    f = _frame(spark, d, "events")
    return f.add_column("r", f["value"].rolling_sum(2, 0, order_by="event_id", partition_by=["user_id"])).df.select("event_id", F.round("r", 4).alias("r"))


# Text and maps
@_query("SELECT doc_id, CAST(contains(text, 'the') AS BIGINT) AS r FROM documents")
def contains(spark, d):
    f = _frame(spark, d, "documents")[["doc_id", "text"]]
    return f.add_column("r", f["text"].contains("the"))[["doc_id", "r"]].df


def _counts(f: Frame, s: Series) -> DataFrame:
    return f.add_column("r", s).df.select(list(f.df.columns)[0], F.explode("r").alias("k", "c"))


@_query(r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents), t AS (SELECT doc_id, regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS k FROM w) SELECT doc_id, k, count(*) AS c FROM t WHERE k <> '' GROUP BY 1, 2")
def bag_of_words(spark, d):
    f = _frame(spark, d, "documents")[["doc_id", "text"]]
    return _counts(f, f["text"].count_bag_of_words())


@_query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS k FROM w WHERE len(w) > 1) SELECT doc_id, k, count(*) AS c FROM t GROUP BY 1, 2")
def word_ngrams(spark, d):
    f = _frame(spark, d, "documents")[["doc_id", "text"]]
    return _counts(f, f["text"].count_ngrams(2))


@_query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?s).') AS w FROM documents), t AS (SELECT doc_id, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda z: z[1] || z[2] || z[3])) AS k FROM w WHERE len(w) > 2) SELECT doc_id, k, count(*) AS c FROM t GROUP BY 1, 2")
def char_ngrams(spark, d):
    f = _frame(spark, d, "documents")[["doc_id", "text"]]
    return _counts(f, f["text"].count_character_ngrams(3))


def _props(spark, d) -> Frame:
    df = _frame(spark, d, "events").df
    return Frame(df.select("event_id", F.create_map(F.lit("type"), F.length("event_type").cast("long"), F.lit("user"), "user_id").alias("m")))


_MAP = "SELECT event_id, CAST(length(event_type) AS BIGINT) AS type, user_id AS u FROM events"


@_query(f"WITH t AS ({_MAP}) SELECT event_id, unnest(['type', 'user']) AS k, unnest([type, u]) AS v FROM t")
def dict_keys_values(spark, d):
    f = _props(spark, d)
    f = f.add_columns({"k": f["m"].dict_keys(), "v": f["m"].dict_values()})
    return f.df.select("event_id", F.explode(F.arrays_zip("k", "v")).alias("z")).select("event_id", "z.k", "z.v")


@_query(f"WITH t AS ({_MAP}) SELECT event_id, 'user' AS k, u AS v FROM t")
def dict_trim_by_keys(spark, d):
    f = _props(spark, d)
    return f.add_column("r", f["m"].dict_trim_by_keys(["type"])).df.select("event_id", F.explode("r").alias("k", "v"))


@_query(f"WITH t AS ({_MAP}), x AS (SELECT event_id, unnest(['type', 'user']) AS k, unnest([type, u]) AS v FROM t) SELECT * FROM x WHERE v BETWEEN 5 AND 50")
def dict_trim_by_values(spark, d):
    f = _props(spark, d)
    return f.add_column("r", f["m"].dict_trim_by_values(5, 50)).df.select("event_id", F.explode("r").alias("k", "v"))


@_query("SELECT event_id, CAST(event_type IN ('click', 'view') AS BIGINT) AS a, CAST(event_type = 'click' AS BIGINT) AS b FROM events")
def dict_has_keys(spark, d):
    f = Frame(_frame(spark, d, "events").df.select("event_id", F.create_map("event_type", "value", F.lit("user"), F.lit(1.0)).alias("m")))
    return f.add_columns({"a": f["m"].dict_has_any_keys(["click", "view"]), "b": f["m"].dict_has_all_keys(["click", "user"])})[["event_id", "a", "b"]].df


# Shape
@_query("SELECT p_partkey, unnest(['p_brand', 'p_type']) AS k, unnest([p_brand, p_type]) AS v FROM part")
def pack_columns(spark, d):
    f = _frame(spark, d, "part")[["p_partkey", "p_brand", "p_type"]].pack_columns(["p_brand", "p_type"], "m")
    return f.df.select("p_partkey", F.explode("m").alias("k", "v"))


@_query('SELECT event_id, CAST(length(event_type) AS BIGINT) AS "m.type", user_id AS "m.user" FROM events')
def unpack_dict(spark, d):
    return _props(spark, d).unpack_column("m").df


@_query('SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS "e.0", CAST(embedding[2] AS DOUBLE) AS "e.1" FROM embeddings')
def unpack_list(spark, d):
    f = _vectors(spark, d)
    return f.add_column("e", f["embedding"].vector_slice(0, 2)).remove_column("embedding").unpack_column("e").df


# Empty and missing lists and maps give one row with missing.
@_query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 4 < 2 UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 4 >= 2")
def stack_list(spark, d):
    some = F.when(F.col("vec_id") % 4 < 2, F.col("embedding")).when(F.col("vec_id") % 4 == 2, F.array().cast("array<double>"))
    return Frame(_vectors(spark, d).df.withColumn("embedding", some)).stack("embedding", "x").df


@_query(f"WITH t AS ({_MAP}) SELECT event_id, unnest(['type', 'user']) AS k, unnest([type, u]) AS v FROM t WHERE event_id % 4 < 2 UNION ALL SELECT event_id, NULL, NULL FROM t WHERE event_id % 4 >= 2")
def stack_dict(spark, d):
    some = F.when(F.col("event_id") % 4 < 2, F.col("m")).when(F.col("event_id") % 4 == 2, F.map_filter("m", lambda k, v: F.lit(False)))
    return Frame(_props(spark, d).df.withColumn("m", some)).stack("m", ["k", "v"]).df


# Sources and sinks: what is written and read again is the table.
_CUST = "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"


def _customer(spark, d) -> Frame:
    df = _frame(spark, d, "customer").df
    return Frame(df.select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment")))


# Names with quotes, delimiters, line ends, comment marks, brackets and blanks at the ends.
_ODD = [", \"x\"", "\nsecond line", " # no comment", "[1, 2", "  ", ""]


@_query("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN ', \"x\"' WHEN 1 THEN chr(10) || 'second line' WHEN 2 THEN ' # no comment' WHEN 3 THEN '[1, 2' WHEN 4 THEN '  ' ELSE '' END || c_name || CASE c_custkey % 7 WHEN 0 THEN ', \"x\"' WHEN 1 THEN chr(10) || 'second line' WHEN 2 THEN ' # no comment' WHEN 3 THEN '[1, 2' WHEN 4 THEN '  ' ELSE '' END AS c_name, c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path, df = _folder(spark), _customer(spark, d).df
    odd = F.coalesce(F.get(F.array(*map(F.lit, _ODD)), (F.col("c_custkey") % 7).cast("int")), F.lit(""))
    Frame(df.withColumn("c_name", F.concat(odd, "c_name", odd))).to_csv(path, na_rep="NA", single_file=False)
    return csv.read(spark, path, na_values=["NA"]).df


@_query(_CUST)
def json_round_trip(spark, d):
    path = _folder(spark)
    _customer(spark, d).to_json(path)
    return json.read(spark, path).select(["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]).df


@_query(_CUST)
def parquet_round_trip(spark, d):
    path = _folder(spark)
    _customer(spark, d).to_parquet(path, sharded=False)
    return parquet.read(spark, path).df


@_query(_CUST)
def native_round_trip(spark, d):
    path = _folder(spark)
    _customer(spark, d).with_metadata(origin="customer").save(path)
    loaded = native.load(spark, path)
    assert loaded.metadata == {"origin": "customer"}
    return loaded.df


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(nullif(n_regionkey, 2) AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), r_name, NULL FROM region")
def stream_writer(spark, d):
    path = _folder(spark)
    nation, region = (_frame(spark, d, t).to_list() for t in ("nation", "region"))  # two tables of fixed size
    with StreamWriter(spark, path, {"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"}, buffer_rows=7) as w:
        for at in range(0, len(nation), 4):
            part = nation[at : at + 4]
            w.write_batch({"n_name": [r["n_name"] for r in part], "n_nationkey": [r["n_nationkey"] for r in part], "n_regionkey": [None if r["n_regionkey"] == 2 else r["n_regionkey"] for r in part]})
        w.write_batch({"n_nationkey": [r["r_regionkey"] + 100 for r in region], "n_name": [r["r_name"] for r in region], "n_regionkey": [None] * len(region)})
        w.set_metadata("rows", str(len(nation) + len(region)))
    loaded = native.load(spark, path)
    assert loaded.metadata == {"rows": str(loaded.num_rows())}
    return loaded.df


@_query("SELECT CAST(range AS BIGINT) AS id FROM range(5, 105, 5)")
def range_source(spark, d):
    return Frame.range(spark, 5, 20, 5).df


# Pipelines
@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 ORDER BY n DESC LIMIT 10")
def pipeline_flagship(spark, d):
    f = _frame(spark, d, "lineitem").where(F.col("l_quantity") > 10)
    out = f.groupby(["l_returnflag", "l_linestatus"], {"n": A.COUNT(), "qty": A.SUM("l_quantity"), "price": A.MEAN("l_extendedprice")}).sort("n", ascending=False).head(10)
    return out.df.withColumn("price", F.round("price", 4))


@_query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def business_by_group(spark, d):
    out = _frame(spark, d, "customer").where(F.col("c_acctbal") > 0).groupby("c_mktsegment", {"n": A.COUNT(), "balance": A.MEAN("c_acctbal")})
    return out.df.withColumn("balance", F.round("balance", 4))

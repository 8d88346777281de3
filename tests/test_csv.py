"""Lexical rules and type inference of delimited text."""

import pytest

from granary.sources import csv


def test_rows():
    o = csv.Options()
    assert csv.split_row('1, "a,b" ,[1,2,3],{"k": 1, "l": 2}, x # rest', o) == ["1", "a,b", "[1,2,3]", '{"k": 1, "l": 2}', "x"]
    assert csv.split_row('"say ""hi""","line\\n\\u00e9"', o) == ['say "hi"', "line\né"]
    assert csv.split_row("# comment", o) is None and csv.split_row("  ", o) is None
    assert csv.split_row("a::b", csv.Options(delimiter="::")) == ["a", "b"]


def test_inference():
    assert csv.infer(["1", "", "NA"], {"NA"}) == "integer" and csv.infer(["1", "2.5"], set()) == "float"
    assert csv.infer(["[1 2]", "[]"], set()) == "vector" and csv.infer(["[a, 1]"], set()) == "list"
    assert csv.infer(["{a: 1}"], set()) == "dict" and csv.infer(["x"], set()) == "string"


def test_read(spark, tmp_path):
    (tmp_path / "t.csv").write_text('skip me\nid,v,s\n1,[1;2],"a\nb"\n2,,NA\n')
    got = csv.read(spark, str(tmp_path / "t.csv"), skiprows=1, na_values=["NA"])
    assert got.dtypes == {"id": "integer", "v": "vector", "s": "string"}
    assert got.to_list() == [{"id": 1, "v": [1.0, 2.0], "s": "a\nb"}, {"id": 2, "v": None, "s": None}]


def _rows(spark, tmp_path, text, **options):
    (tmp_path / "t.csv").write_text(text)
    return csv.read(spark, str(tmp_path / "t.csv"), **options).to_list()


def test_quotes_over_lines_are_the_default(spark, tmp_path):
    assert _rows(spark, tmp_path, 'a,b\n1,"x\ny"\n2,z\n') == [{"a": 1, "b": "x\ny"}, {"a": 2, "b": "z"}]
    assert _rows(spark, tmp_path, 'a,b\n# 5" pipe\n1,6" pipe\n2,z # don"t\n') == [{"a": 1, "b": '6" pipe'}, {"a": 2, "b": "z"}]
    assert _rows(spark, tmp_path, 'a,b\n1,"x\ny"\n', multi_line=False) == [{"a": "1", "b": "x"}, {"a": 'y"', "b": ""}]


def test_a_row_equal_to_the_header_stays(spark, tmp_path):
    assert _rows(spark, tmp_path, "a,b\n1,2\na,b\n3,4\n", types={"a": "string", "b": "string"}) == [{"a": "1", "b": "2"}, {"a": "a", "b": "b"}, {"a": "3", "b": "4"}]


def test_leading_comments_and_blanks_however_many(spark, tmp_path):
    assert _rows(spark, tmp_path, "# note\n\n" * 400 + "a,b\n" + "# note\n" * 300 + "1,2\n") == [{"a": 1, "b": 2}]
    assert csv.read(spark, str(tmp_path / "t.csv"), infer_rows=None).dtypes == {"a": "integer", "b": "integer"}


def test_types_by_all_rows_and_misfits(spark, tmp_path):
    text = "a,b\n" + "1,2\n" * 150 + "late,oops\n3,4\n"
    assert _rows(spark, tmp_path, text)[150] == {"a": None, "b": None}
    assert csv.misfits(spark, str(tmp_path / "t.csv")) == {"a": 1, "b": 1}
    assert _rows(spark, tmp_path, text, infer_rows=None)[150] == {"a": "late", "b": "oops"}


@pytest.mark.parametrize("split", [64, 200, 1000])
def test_rows_over_splits(spark, tmp_path, split):
    rows = [(i, ("line\n" * (i % 5) + f'say ""{i}""' + ("\n" * 120 if i == 20 else "")) if i % 3 else "plain") for i in range(60)]
    text = "id,t\n" + "".join(f'{i},"{t}"\n' if "\n" in t or '"' in t else f"{i},{t}\n" for i, t in rows) + "# the \"end\n"
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = _rows(spark, tmp_path, text)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["t"]) for r in got) == [(i, t.replace('""', '"')) for i, t in rows]


def test_several_files_with_headers(spark, tmp_path):
    frame = csv.read(spark, str(_written(tmp_path, "in.csv", "a,b\n" + "".join(f"{i},x{i}\n" for i in range(50)))))
    from granary.operators.frame import Frame

    many = Frame(frame.df.repartition(4))
    many.to_csv(str(tmp_path / "out"), single_file=False)
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert sorted(r["a"] for r in csv.read(spark, str(tmp_path / "out")).to_list()) == list(range(50))


def _written(folder, name, text):
    (folder / name).write_text(text)
    return folder / name


def test_files_without_rows_come_first(spark, tmp_path):
    for name, text in {"a": "", "b": "# note\n", "c": "id,t\n", "d": "id,t\n1,\n", "e": "id,t\n2,x\n", "f": 'id,t\n3,"y\nz"\n'}.items():
        _written(tmp_path, f"{name}.csv", text)
    for options in ({}, {"multi_line": False, "infer_rows": 1}, {"infer_rows": None}):
        got = csv.read(spark, str(tmp_path), **options)
        assert got.dtypes == {"id": "integer", "t": "integer" if options.get("infer_rows") == 1 else "string"}
    assert sorted((r["id"], r["t"]) for r in csv.read(spark, str(tmp_path)).to_list()) == [(1, ""), (2, "x"), (3, "y\nz")]
    assert csv.read(spark, str(tmp_path / "[ab].csv")).to_list() == []


def test_a_first_part_without_rows_is_written_and_read(spark, tmp_path):
    from pyspark.sql import functions as F

    from granary.operators.frame import Frame

    df = spark.range(0, 4000, 1, 4).where("id >= 1000").select("id", F.concat(F.lit("a\n#"), "id").alias("t"))
    Frame(df).to_csv(str(tmp_path / "out"), single_file=False)
    first, *rest = sorted((tmp_path / "out").glob("part-*"))
    assert first.stat().st_size == 0 and rest
    assert sorted((r["id"], r["t"]) for r in csv.read(spark, str(tmp_path / "out")).to_list()) == [(i, f"a\n#{i}") for i in range(1000, 4000)]


def test_splits_stay_as_they_were_when_settings_change(spark, tmp_path):
    rows = [(i, f"a\n{'b' * (i % 50)}\n#c") for i in range(400)]
    _written(tmp_path, "t.csv", "n,s\n" + "".join(f'{n},"{s}"\n' for n, s in rows))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
        got = csv.read(spark, str(tmp_path / "t.csv"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        assert sorted((r["n"], r["s"]) for r in got.to_list()) == rows
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_types_where_the_first_split_holds_few_rows(spark, tmp_path):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 16)
        got = _rows(spark, tmp_path, "n,s\n1,\n2,\n3,\n4,\n5,\n" + '6,"x\ny"\n7,z\n')
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted((r["n"], r["s"]) for r in got) == [(1, ""), (2, ""), (3, ""), (4, ""), (5, ""), (6, "x\ny"), (7, "z")]

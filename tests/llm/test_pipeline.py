"""The pipeline as a whole and the SQL of this subpackage."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from granary.llm import lang_id, line_dedup, near_dup, packing, secret_scan
from granary.llm.common import cut
from granary.llm.queries import held_out, oracle_sql, queries, tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries()[name](spark, DATA).toPandas(), con.execute(oracle_sql()[name]).df()
    plain = lambda df: sorted(map(repr, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).values.tolist()))
    norm = lambda df: df.apply(lambda c: c.map(lambda v: float(v) if isinstance(v, (int, float, np.integer)) else v))
    assert plain(norm(got)) == plain(norm(want))


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scorer = lang_id.fit(docs.where(~held_out())).scorer()
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    rows = {k: r for k, r in rows.items() if scorer.predict(r["text"])[0] != "und" and scorer.predict(r["text"])[1] >= 0.15}
    sites, keeper = defaultdict(set), {}
    for k in sorted(rows):
        for line in {x.strip() for x in rows[k]["text"].split("\n")} - {""}:
            sites[line].add(rows[k]["source"])
            keeper.setdefault(line, k)
    held = {line_dedup.hash_of(x): keeper[x] for x, s in sites.items() if len(s) >= 8}
    for k, r in rows.items():
        r["text"] = line_dedup.clean_text(r["text"], k, held)
    sets, kept = {k: near_dup.shingles(r["text"]) for k, r in rows.items()}, {}
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sorted(rows):
        for b in sorted(rows):
            if b < a and (rows[a]["text"] == rows[b]["text"] or near_dup.similarity_of(sets[a], sets[b]) >= 0.8):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = {k: secret_scan.redacted(r["text"], secret_scan.scan(r["text"])[1]) for k, r in rows.items() if root(k) == k}
    encoder = packing.encoder_of(tokenizer("byte_bpe_50k.json"))
    want = {k: len(encoder.ids(t)) // 2 + 1 for k, t in kept.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, node string, k int, b int, cell int, shard int"


def _stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs.schema
        docs = cut(stage(spark, docs, None), name)
        if name != "packing":
            assert docs.schema == before
            yield name, {(r["doc_id"], r["text"]) for r in docs.collect()}, docs
    yield "packing", docs.collect(), docs


def test_pipeline_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    en, de = "the cat and this thing with that whole other of it was".split(), "der hund und die katze nicht schön über ein das ist".split()
    text = lambda words, n=60: " ".join(rng.choice(words, n))
    rows = [(i, text(en if i % 2 else de) + "\nshown everywhere with that", "en" if i % 2 else "de", f"s{i % 10}") for i in range(60)]
    copy = text(en, 200)
    rows += [(100, copy, "en", "s1"), (101, copy + " it", None, None), (100, copy, "en", "s1"), (None, copy, None, "s1")]
    rows += [(None, "api_key = Zx81kkLq99a0 the cat and this thing", "en", None), (200, None, "en", "s2"), (201, "", "de", "s2"), (202, "½ ² 12", None, "s3"), (203, "это русский текст про кошку", None, "s4")]
    docs = spark.createDataFrame([(k, t, l, s, len(t or ""), "x", 1, 2, 3, 4) for k, t, l, s in rows], SCHEMA)
    after = dict((name, found) for name, found, _ in _stages(spark, docs))
    kept = {k for k, _ in after["language_id"]}
    assert kept == {*range(60), 100, 101, None}
    assert [k for k, t in after["line_dedup"] if "everywhere" in t] == [0] and len(after["line_dedup"]) == len(after["language_id"])
    assert {k for k, t in after["near_dup"] if t.startswith(copy)} == {100} and kept - {101} == {k for k, _ in after["near_dup"]}
    assert {t for k, t in after["secret_scan"] if k is None} == {"[SECRET] the cat and this thing"}
    ends = {r["doc_id"] for r in after["packing"] if r["start"] + r["length"] == r["doc_tokens"]}
    assert ends == kept - {101}


def test_pipeline_on_an_empty_table(spark):
    for _, found, _ in _stages(spark, spark.createDataFrame([], SCHEMA)):
        assert not found

"""The ten operators against brute force, libraries and round trips, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import imatch, knn, lang_id, line_dedup, near_dup, packing, piece_codec, secret_scan, token_counts, warc
from granary.llm.pieces import CharMap
from granary.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank int, node string, k int, t int, h int, b int"
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    None, "", " ", "!!!", "a", "Hello world", "Hello  world\n\n x ", "the cat sat on the mat and the dog ran", "token=abc123def", LONG, LONG,
    "日本語 テキスト", "<|endoftext|> x", "ﬁ ▁▁ Ⅷ   y", "one line\nAll rights reserved.\none line", "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 9}", len(t or ""), 0.5, 1, "n", 1, 1, 1, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "a null key", None, None, 10, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


@given(st.text(alphabet=st.sampled_from("abcthe ▁\n\té日😀.,-="), max_size=60))
@settings(max_examples=200, deadline=None)
def test_pieces_follow_the_library(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    codec = piece_codec.codec_of(tokenizer("piece_bpe_32k.model"))
    ids, spans = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)
    assert token_counts.counter_of(tokenizer("piece_bpe_32k.model")).count(text) == len(ids)
    data = text.encode()
    assert b"".join(data[a:b] for a, b in spans) == data
    assert codec.digest(text)[0] == len(ids) and codec.digest(text)[3] == zlib.crc32(np.array([b for _, b in spans], "<u4").tobytes())


def test_character_map_follows_the_library():
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from granary.llm.pieces import _fields

    rules = next(v for n, v in _fields(norm.serialized_model_proto()) if n == 3)
    charmap = CharMap(dict(_fields(rules))[2])
    for text in ["ﬁ Ⅷ x", "ｶﾞ１２３", "plain", "", "é ①"]:
        got, source = charmap.apply(text)
        assert got.replace(" ", "▁") == norm.normalize(text).removeprefix("▁") or got == text
        assert len(source) == len(got) + 1 and source == sorted(source) and source[-1] == len(text.encode())


def test_piece_queries(docs, empty, library):
    got = {r["doc_id"]: r for r in piece_codec.encode_digests(docs, tokenizer("piece_bpe_32k.model")).collect()}
    counts = {r["doc_id"]: r for r in token_counts.token_counts(docs, tokenizer("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len((t or "").encode()), len(ids), len(ids) > 4096)
    full = {r["doc_id"]: r for r in piece_codec.encode(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert all(list(full[i]["ids"]) == library.encode(t or "") for i, t in enumerate(TEXTS))
    assert piece_codec.encode_digests(empty, tokenizer("piece_bpe_32k.model")).count() == token_counts.token_counts(empty, tokenizer("piece_bpe_32k.model")).count() == 0


# Language


def test_language(spark, docs, empty):
    words = {"en": "the cat and this thing with that whole other", "de": "der hund und die katze nicht über schön", "ru": "это русский текст про кошку и собаку"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w.split())), l) for i, (l, w) in enumerate(list(words.items()) * 10)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en", "ru"] and model.scripts[2] == {"cyrillic"}
    scorer = model.scorer()
    assert scorer.predict("кошку собаку")[0] == "ru" and scorer.predict("the whole thing")[0] == "en"
    mixed = words["en"] + " " + words["en"] + ". " + words["de"] + " " + words["de"]
    assert [s[2] for s in scorer.spans(mixed)] == ["en", "de"] and mixed[slice(*scorer.spans(mixed)[0][:2])].endswith("other")
    for text in (mixed, words["en"], words["de"] + " " + words["ru"]):  # the short cut and the recurrence agree with brute force
        w = lang_id.WORD.findall(text)
        labels, _, scores = scorer.label(w)
        value, paths = scores[0].astype(float), [[j] for j in range(3)]
        for t in range(1, len(w)):
            came = [max(range(3), key=lambda i: value[i] - model.penalty * (i != j)) for j in range(3)]
            value, paths = np.array([value[i] - model.penalty * (i != j) for j, i in enumerate(came)]) + scores[t], [paths[i] + [j] for j, i in enumerate(came)]
        total = lambda p: sum(scores[t][j] for t, j in enumerate(p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert total(labels.tolist()) == pytest.approx(total(paths[int(value.argmax())]))
        assert scorer._recurrence(scores).tolist() == scorer._recurrence_of_few(scores.tolist()).tolist()
    got = {r["doc_id"]: r for r in lang_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert lang_id.predict(empty, model).count() == 0 and lang_id.accepted(docs, model).columns == docs.columns
    assert lang_id.predict(docs, lang_id.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert lang_id.label_spans(docs, model).where("doc_id = 7").count() >= 1


def test_long_words_leave_the_memory_of_words_whole():
    grams = [Counter(w[i : i + 3] for w in f"^{text.replace(' ', '$ ^')}$".split() for i in range(len(w) - 2)) for text in ("der hund und die katze nicht", "the cat and this thing with")]
    model = lang_id.LangModel(["de", "en"], grams, [{"latin"}, {"latin"}])
    used = lang_id.Scorer(model)
    used.predict(" ".join(c * 50 for c in "abcdef") + " the cat and hund")
    for text in ("der hund und", "die katze nicht", "with this thing", "the cat", "hund cat die thing", "der hund und"):
        fresh = lang_id.Scorer(model)
        words = text.split()
        assert used.predict(text) == fresh.predict(text)
        for got, want in zip(used.label(words), fresh.label(words)):
            assert (got == want).all()


@pytest.mark.parametrize("n_langs", [2, 4, 6, 8])
def test_texts_that_no_language_explains_are_rejected(spark, n_langs):
    words = ["the cat and this thing with that whole other", "der hund und die katze nicht schön", "el perro que come las cosas", "le chien avec une chose dans", "il gatto della casa sono", "een hond van het huis niet", "den katten som ikke er", "uma coisa para não com"]
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w.split())), f"l{j}") for i, (j, w) in enumerate(list(enumerate(words[:n_langs])) * 10)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = ["the cat and that other thing", "der hund und die katze", "это русский текст про кошку", "这是一个很长的中文文本", "هذا نص عربي طويل", "xqzvk wqjzx kvqpz zzxqj", "это русский текст про кошку the cat"]
    got = lang_id.accepted(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1]


def test_language_held_out_accuracy(spark):
    from granary.llm.queries import op1_language

    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = op1_language(spark, "/root/testdata/sf0.01").where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0


# Nearest vectors


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(300)] + [(400 + i, [0.1] * 8) for i in range(40)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (1004, [0.5, 0.5]), (None, [0.1] * 8), (50, rows[50][1])]
    got = defaultdict(list)
    for r in knn.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), pivots=8, group_queries=3, block_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fit = [(i, np.array([int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i: v for i, v in fit if i % 50 == 0}
    assert set(got) == set(queries)
    for i, q in queries.items():
        want = sorted((-int(q @ v), j) for j, v in fit if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert knn.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


# Secrets


def _base(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [("assign", *m.span()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda f: (f[1], secret_scan.KINDS.index(f[0])))


@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "zz", "AKIA", "ABCD0123" * 3, "0123abcdef" * 3, "\n", "é", "+", "x"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_findings(text):
    found, every = secret_scan.scan(text)
    assert found == _base(text) and set(found) <= set(every)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('x = "sk_live_"\ny = x + "a8Zq91LmPq"\napi_secret = y', ["sk_live_", "a8Zq91LmPq"]),
        ('{"client_secret": "Zx81-kkLq"}', ["Zx81-kkLq"]),
        ("const userPwd: string = 'q1w2e3r4!';", ["q1w2e3r4!"]),
        ("<authToken>abcDEF123456</authToken>", ["abcDEF123456"]),
        ('secret_key = "changeme"\ncolour = "blue-green9"\n# password = "abc123def"', []),
        ("Note: the word", []),
    ],
)
def test_lexing(text, wanted):
    assert [text[a:b] for k, a, b in secret_scan.scan(text)[1] if k == "literal"] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxR4", ["wJalrXUtnFEMI/K7MDENG/bPxR4"]),
        ("DB_PWD=Tr0ub4dor&3\nx: 1", ["Tr0ub4dor&3"]),
        ("private_key: MIIEvQ1B+ADk==", ["MIIEvQ1B+ADk=="]),
        ("{private_key: MIIEvQ1B+ADk=, other: 1}", ["MIIEvQ1B+ADk="]),
        ("export DB_PWD=q1!w2@e3 # note", ["q1!w2@e3"]),
        ("KEY=a1b2c3d4e5\napi_secret = KEY", ["a1b2c3d4e5"]),
        ("KEY=a1b2c3d4e5\nDB_PWD=KEY/x7y8", ["KEY/x7y8"]),
        ("cmd: password=abc12345", ["abc12345"]),
        ("user_pwd = hash(x1)+y2\nauth_key = sha256_digest + x1", []),
    ],
)
def test_bare_values_are_read_whole(text, wanted):
    assert [text[a:b] for k, a, b in secret_scan.scan(text)[1] if k == "literal"] == wanted


def test_secret_table(docs, empty):
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs).collect()}
    assert got[8]["n_assign"] == 1 and got[0]["spans"] == "" and len(got) == len(TEXTS) + 1
    assert secret_scan.redact(docs).where("doc_id = 8").first()["text"] == "[SECRET]"
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.secret_scan(empty).count() == 0


# Packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True, window_sequences=2, shard_tokens=20_000).collect()
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
    for i, t in enumerate(TEXTS):
        if i == 7:
            continue  # a repeated row, packed twice
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in parts for x in p["ids"]] == ids and all(p["doc_tokens"] == len(ids) for p in parts)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_windows_keep_the_mixture():
    from collections import deque

    queues = {"a": deque([0, 0, 100] for _ in range(60)), "b": deque([1, 0, 500] for _ in range(4)), "c": deque([[2, 0, 2000]])}
    taken, window = Counter(), Counter()
    for doc, _, n in packing.rounds(queues, {"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 0.0}, 1000):
        taken[doc] += n
        window[doc] += n
        if sum(window.values()) == 1000:
            assert abs(window[0] - 600) <= 1 and abs(window[1] - 200) <= 1
            window.clear()
    assert taken == {0: 6000, 1: 2000, 2: 2000}


# Near duplicates


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(1), []
    for _ in range(60):
        e = np.sort(rng.integers(0, 2**63, 150).astype(np.uint64))
        a = rng.integers(0, 6, 150)
        b = np.where(rng.random(150) < 0.8, a, rng.integers(0, 6, 150))
        x, y = (e[a > 0], a[a > 0]), (e[b > 0], b[b > 0])
        off.append((near_dup.signature(*x) == near_dup.signature(*y)).mean() - near_dup.similarity_of(x, y))
    assert abs(np.mean(off)) < 0.015


def _words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def copies(spark):
    rng, rows = np.random.default_rng(5), []
    for _ in range(25):
        base = _words(rng, 120)
        rows.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            changed = list(base)
            for i in rng.integers(0, 120, int(rng.integers(1, 4))):
                changed[i] = "other"
            rows.append(" ".join(changed))
    rows += ["!!!", "!!!", "???", "", None, "few words", "few words", rows[0].upper()]
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)] + [(None, rows[0], 1)], "doc_id bigint, text string, node int")


def test_near_duplicates(copies, empty, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in copies.collect()]
    sets = [near_dup.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or near_dup.similarity_of(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    want = Counter((k, min(least[root(i)])) for i, (k, _) in enumerate(rows))
    got = near_dup.classes(copies)
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == want
    kept = near_dup.deduplicated(copies)
    assert kept.columns == copies.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want})
    assert near_dup.classes(empty).count() == 0


def test_one_of_each_group_stays_without_keys(spark):
    base = _words(np.random.default_rng(9), 100)
    near, other = " ".join([*base[:-1], "other"]), " ".join(_words(np.random.default_rng(10), 100))
    rows = [(None, " ".join(base), 1), (None, near, 2), (None, other, 3), (None, other, 4), (7, "one", 5), (7, "two", 6), (7, "two", 7), (None, "two", 8)]
    kept = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string, k int")).collect()
    assert Counter((r["doc_id"], r["text"] in (" ".join(base), near) or r["text"]) for r in kept) == Counter([(None, True), (None, other), (7, "one"), (7, "two")])
    assert near_dup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string, k int")).count() == 0


# Fingerprints


def test_fingerprints(spark, docs, empty):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(_words(rng, 80))) for i in range(200)] + [(200, None), (201, ""), (202, "a"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for part_rows in (10_000, 13):
        got = imatch.edit_report(frame, part_rows=part_rows, least_share=0.005).collect()
        assert len(got) == len(rows)
        order = sorted(((k, t or "") for k, t in rows), key=lambda r: (-r[0], r[1]))
        want = Counter()
        for (k, t), (_, n) in zip(order, order[1:] + order[:1]):
            want[k, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert np.mean([r["near_edited"] for r in got]) > 3 * np.mean([r["near_next"] for r in got])
        assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs, ["the", "lorem"]).collect()}
    assert prints[9] == prints[10] and prints[0] == prints[1] and prints[3] != prints[4]
    assert imatch.edit_report(empty).count() == 0 and imatch.edit_report(docs).count() == docs.count()
    lone = imatch.edit_report(docs.where("doc_id = 5")).first()
    assert lone["near_next"] == 1.0 and lone["edited_sha256"] == hashlib.sha256(b"Hello Hello").hexdigest()


# Archives


@given(st.binary(max_size=300), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_chunked_framing(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data


def test_archives(spark):
    big, other = "é" * 30_000, "line\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "u", big), (2, "u b", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", other), (8, "u", other), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, head int, origin string")
    got = Counter(tuple(r) for r in warc.round_trip(pages, archive=100_000).collect())
    want = Counter()
    for k, _, html in rows:
        data = (html or "").encode()
        top = max(i for i, _, h in rows if h == html and i is not None) if len(data) >= 1000 else k
        again = k != top
        want[k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damage_is_found():
    data = warc.written(1, "u", b"x" * 50_000, hashlib.sha1(b"x" * 50_000).hexdigest(), None, False, 16_384, 2_048, 4_096)
    assert len(list(warc.records(data))) == 4
    with pytest.raises(ValueError):
        list(warc.records(data[:-10]))


# Lines


def test_lines(spark, docs, empty):
    rng = np.random.default_rng(2)
    lines = [f"line {i}" for i in range(30)] + ["", "  "]
    rows = [(int(i) if i else None, None if i == 5 else "\n".join(rng.choice(lines, 6)), f"s{rng.integers(0, 12)}" if i % 11 else None, 7) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, h int")
    sites, keeper = defaultdict(set), {}
    for k, t, s, _ in rows:
        for line in {x.strip() for x in (t or "").split("\n")} - {""}:
            sites[line] |= {s} - {None}
            keeper[line] = min(x for x in (k, keeper.get(line)) if x is not None) if k is not None or keeper.get(line) is not None else None
    want = []
    for k, t, s, h in rows:
        out, held = [], set()
        for line in (t or "").split("\n"):
            w = line.strip()
            if w and len(sites[w]) >= 8:
                if w in held or keeper[w] != k:
                    continue
                held.add(w)
            out.append(line)
        want.append((k, t and "\n".join(out), s, h))
    for most in (1_000_000, 0):  # broadcast, join
        got = line_dedup.cleaned(frame, broadcast_lines=most)
        assert got.columns == frame.columns
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert line_dedup.cleaned(docs).count() == docs.count() and line_dedup.cleaned(empty).count() == 0


# Odd and hostile input


@pytest.fixture(scope="module")
def with_map(tmp_path_factory):
    """The piece model with a character map, blanks squeezed, and the library for it."""
    import sentencepiece

    from granary.llm.pieces import _fields

    def field(number, value):
        size, out = len(value), bytes([number << 3 | 2])
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return out + bytes([size]) + value

    rules = next(v for n, v in _fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == 3)
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        fields = list(_fields(f.read()))
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(b"".join(field(n, rules if n == 3 else v) for n, v in fields))
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path)), fields, field


def test_pieces_through_a_character_map(with_map):
    path, library, _, _ = with_map
    codec, counter = piece_codec.codec_of(path), token_counts.counter_of(path)
    assert not codec.model.plain
    for text in ["ﬁ Ⅷ x", "ｶﾞ１２３ ab", "  two  blanks ", "plain text", "é ①", "", " ", "a\tb\n c"]:
        ids, spans = codec.encode(text)
        assert ids == library.encode(text) and counter.count(text) == len(ids)
        assert all(0 <= a <= b <= len(text.encode()) for a, b in spans) and spans == sorted(spans)
    ids, spans = codec.encode("ﬁ x")
    assert [bytes("ﬁ x", "utf-8")[a:b] for a, b in spans][-1].strip() == b"x"


def test_models_without_byte_fallback_are_refused(with_map, tmp_path):
    from granary.llm.pieces import PieceModel

    _, _, fields, field = with_map
    (tmp_path / "m").write_bytes(b"".join(field(n, b"\x18\x02" if n == 2 else v) for n, v in fields))
    with pytest.raises(ValueError, match="fallback"):
        PieceModel(str(tmp_path / "m"))


@given(st.text(alphabet=st.sampled_from("abcthe12 \n'.,-=_sé日½²ß‘"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_packing_encodes_as_the_library(text):
    encoder = packing.encoder_of(tokenizer("byte_bpe_50k.json"))
    assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_rows_without_key_are_spread(spark):
    rows = spark.range(10_000).selectExpr("cast(null as bigint) doc_id", "'same text' text", "'s' source").union(spark.range(10_000).selectExpr("7L", "'same text'", "'s'")).repartition(8)
    tokens = packing.tokenised(rows, tokenizer("byte_bpe_50k.json"))
    sizes = [r["n"] for r in tokens.groupBy(packing.shard_of(30)).agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 30 and max(sizes) < 1.3 * sum(sizes) / 30


def test_what_sources_are_owed_across_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(int(j), f"s{rng.integers(0, 3)}", int(rng.integers(1, 50))) for j in rng.integers(0, 3000, 4000)]
    total = sum(n for *_, n in rows)
    for targets in (None, {"s0": 0.7, "s1": 0.3}):
        got = {(r["shard"], r["s"]): (r["share"], r["owed"]) for r in packing.carried(spark.createDataFrame(rows, "shard int, s string, n bigint"), total, targets).collect()}
        share = {s: (targets.get(s, 0) if targets else sum(n for _, x, n in rows if x == s) / total) for s in ("s0", "s1", "s2")}
        sofar, given = 0, Counter()
        by = defaultdict(Counter)
        for j, s, n in rows:
            by[j][s] += n
        for j in sorted(by):
            for s in by[j]:
                assert got[j, s] == pytest.approx((share[s], share[s] * sofar - given[s]))
            sofar += by[j].total()
            given.update(by[j])
        assert len(got) == sum(map(len, by.values()))


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and this", "en"), ("der hund und die", "de")] * 9 + [("den katten som ikke er", "da")])]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_grams=14)
    assert model.langs == ["da", "de", "en"]  # a small language keeps its own share of the counts
    scorer = model.scorer()
    assert [scorer.predict(t)[:2] for t in ("½ ² ①", "12 _", "", None)] == [("und", 0.0)] * 4 and scorer.spans("½ ²") == []
    assert scorer.predict("½ the cat")[0] == "en"


def test_scripts_narrow_the_candidates(spark):
    words = {"en": "the cat and this thing with that", "ru": "это русский текст про кошку"}
    rows = [(i, t, l) for i, (l, t) in enumerate(list(words.items()) * 5)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert [s[2] for s in model.scorer().spans("the cat and кошку this thing")] == ["en", "ru", "en"]
    assert lang_id.script_of("aкошку") == "cyrillic" and lang_id.script_of("日本語テ") == "han" and lang_id.script_of("ǂ") == "latin"


def test_word_scores_against_brute_force(spark):
    import math

    texts = {"en": "the cat and this thing with that", "de": "der hund und die katze nicht"}
    model = lang_id.fit(spark.createDataFrame([(1, texts["en"], "en"), (2, texts["de"], "de")], "doc_id bigint, text string, lang string"))
    grams = {l: Counter(f"^{w}$"[i : i + 3] for w in t.split() for i in range(len(w))) for l, t in texts.items()}
    assert [dict(g) for g in model.grams] == [grams["de"], grams["en"]]
    for word in ("the", "hund", "xyz", "thatze", "d"):
        logs = []
        for l in ("de", "en"):
            starts = Counter()
            for g, n in grams[l].items():
                starts[g[:2]] += n
            w = f"^{word}$"
            logs.append(sum(math.log((grams[l][w[i : i + 3]] + 0.5) / (starts[w[i : i + 2]] + 30)) for i in range(len(word))))
        want = [max(x - max(logs), lang_id.FLOOR) for x in logs]
        assert model.scorer().scores(word) == pytest.approx(want, abs=1e-5)


def test_constants_are_followed_in_linear_time():
    import time

    began = time.process_time()
    assert secret_scan.scan("x='ab12cd'\n" + "x = x + x\n" * 5000 + "password = x")[1] == [("literal", 3, 9)]
    text = "password = 'a8c9d0'\n" + "password = password + 'b7x1z9q'\n" * 3000
    assert sum(k == "literal" for k, _, _ in secret_scan.scan(text)[1]) == 3001
    assert secret_scan.scan('password = ' + '\\"' * 100_000 + "'" * 99_999)[1] == []
    assert time.process_time() - began < 20


@given(st.lists(st.sampled_from(["x", "y", "password", " = ", "+", "'a1b2c3'", '"', "'", "\\", "`", "\n", "é", "# ", ": "]), max_size=40).map("".join))
@settings(max_examples=300, deadline=500)
def test_lexing_ends(text):
    found, every = secret_scan.scan(text)
    assert set(found) <= set(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_keepers_beyond_floats(spark):
    rows = [(2**53 + 1 + i, "common line\nown %d" % i, f"s{i}") for i in range(9)] + [(None, "only nulls\ncommon line", f"s{i}") for i in range(9)]
    rows += [(5, "\u00a0common line", "s1"), (2**53 + 1, "common line\nown 0", "s0")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = Counter((k, "\n".join(x for x in t.split("\n") if x not in ("common line", "only nulls") or (x == "common line" and k == 2**53 + 1))) for k, t, _ in rows)
    for most in (1_000_000, 0):
        assert Counter((r["doc_id"], r["text"]) for r in line_dedup.cleaned(frame, broadcast_lines=most).collect()) == want


def test_large_groups_of_copies(spark):
    rng = np.random.default_rng(6)
    base, other = _words(rng, 60), _words(rng, 60)
    near = [" ".join([*base[:-1], f"end{i}"]) for i in range(1500)]
    rows = [(i, t) for i, t in enumerate([" ".join(base)] * 1500 + near + [" ".join(other)] * 10)] + [(None, " ".join(other))] * 1500
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = Counter((r["class_id"]) for r in near_dup.classes(frame).collect())
    assert got == {0: 3000, 3000: 1510}
    assert sorted(r["doc_id"] for r in near_dup.deduplicated(frame).collect()) == [0, 3000]


def test_fingerprints_against_brute_force(spark):
    import xxhash

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(_words(rng, 40)) + " Common, (words)") for i in range(60)] + [(60, None), (61, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    strip = lambda w: w.strip(imatch.MARKS)
    sets = {k: {strip(w) for w in (t or "").lower().split()} - {""} for k, t in rows}
    df = Counter(w for s in sets.values() for w in s)
    words = sorted(w for w, n in df.items() if max(2, 0.01 * len(rows)) <= n <= max(2, 0.5 * len(rows)))
    assert imatch.lexicon(frame, least_share=0.01, most_share=0.5) == words
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(frame, words).collect()}
    code = {w: xxhash.xxh64_intdigest(w) for w in words}
    for k, t in rows:
        found = sorted(sets[k] & code.keys())
        if not found:
            want = hashlib.sha1(" ".join(sorted(sets[k])).encode() if sets[k] else b"\0" + (t or "").encode()).hexdigest()
        else:
            want = ""
            for slot in range(imatch.SLOTS):
                limit = 2.0 ** (64 - imatch.HALVINGS[slot % len(imatch.HALVINGS)])
                kept = [code[w] for w in found if int(imatch._mixed(np.array([code[w]], np.uint64), slot + 1)[0]) < limit]
                want += f"{xxhash.xxh32_intdigest(b''.join(c.to_bytes(8, 'little') for c in kept)):08x}" if kept else imatch.EMPTY
        assert got[k] == want
    report = {r["doc_id"]: r for r in imatch.edit_report(frame, least_share=0.01, most_share=0.5, part_rows=7).collect()}
    assert all(report[k]["fingerprint"] == got[k] for k, _ in rows)
    likeness = lambda a, b: 1.0 if a == b else 0.0 if len(a) != len(b) else (lambda p: sum(x == y for x, y in p) / len(p))([(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8) if (a[i : i + 8], b[i : i + 8]) != (imatch.EMPTY,) * 2])
    assert all(report[k]["near_next"] == likeness(got[k], got[k - 1 if k else 61]) for k, _ in rows)


def test_rows_of_one_key_are_dealt_to_several_ranges(spark):
    frame = spark.range(4000).selectExpr("if(id % 3 = 0, null, 5L) doc_id", "concat('text ', md5(cast(id as string))) text")
    rows, parts = imatch.in_order(frame, "doc_id", "text", 100)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert parts > 30 and max(sizes) < 400
    assert imatch.edit_report(frame, part_rows=100).count() == 4000


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.range(300).selectExpr("id page_id", "'u' url", "repeat(md5(cast(id as string)), 200) html").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "w"), archive=200_000)
    files = list((tmp_path / "w").glob("*.gz"))
    import gzip

    assert len(files) > 8 and all(len(gzip.decompress(f.read_bytes())) < 220_000 for f in files)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert got.count() == 300 and got.where("payload_bytes = 6400 and record_type = 'response'").count() == 300


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from granary.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 4, (24, 16))
    rows = [(i, (centres[i % 24] + rng.normal(0, 0.02, 16)).tolist()) for i in range(4800)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    fit = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    got = defaultdict(list)
    for r in knn.top_k(frame, pivots=64, group_queries=8, block_rows=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for i in range(0, 4800, 50):
        scores = fit @ fit[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert len(got) == 96


def test_bins():
    assert knn.packed({3: 10, 1: 50, 2: 250, 5: 90}, 100) == {1: [0], 2: [1, 2, 3], 3: [4], 5: [4]}

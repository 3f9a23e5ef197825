"""The registered queries on the smallest tables against plain forms of their contracts, and rules that the operators' own tests leave open."""

import functools
import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.llm import bpe, common, language_id, line_dedup, media, mixing, ngram_join, queries, secrets, suffix_dedup, topk
from test_llm import DOCS, brute_repeats, docs_of, odd, pgm, png, words  # noqa: F401

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


# -- registered queries


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    b = [tuple(r[want.columns.index(c)] for c in sorted(got.columns)) for r in want.fetchall()]
    assert sorted(a, key=repr) == sorted(b, key=repr)


@needs_data
def test_op2_query(spark, texts):
    raw = [(r.text or "").encode() for r in texts.values()]
    got = rows_of(queries.op2_suffix_dedup(spark, SF))
    assert len(got) == len(texts)
    for (doc, r), kept in zip(texts.items(), brute_repeats(raw, 400)):
        g = got[doc]
        assert (g.n_bytes, g.n_removed, g.kept_sha256) == (len((r.text or "").encode()), len((r.text or "").encode()) - len(kept), hashlib.sha256(kept).hexdigest())
        assert (g.n_spans > 0) == (g.n_removed > 0)


def plain_base(text):
    """The contract's patterns, one kind after the other."""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.IGNORECASE | re.ASCII):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


@needs_data
def test_op5_query(spark, texts):
    got = rows_of(queries.op5_secret_scan(spark, SF))
    assert len(got) == len(texts)
    for doc, r in texts.items():
        want, g = plain_base(r.text or ""), got[doc]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert g.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and not x.startswith("crf")] == [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]


@needs_data
def test_op7_query(spark, texts):
    got = rows_of(queries.op7_language_id(spark, SF))
    assert len(got) == len(texts)
    right = Counter()
    for doc, r in texts.items():
        g = got[doc]
        assert g.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= g.score <= 1
        assert (g.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if g.held_out and r.lang is not None and g.lang_pred != "und":
            right[g.lang_pred == r.lang] += 1
    assert right[True] >= 0.95 * sum(right.values()) > 0


@needs_data
def test_op9_query(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.WORD_BPE)
    lib.no_truncation()
    lib.no_padding()
    got = rows_of(queries.op9_bpe(spark, SF))
    assert len(got) == len(texts)
    for doc, r in texts.items():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == want


@needs_data
def test_op10_query(spark, texts):
    sets = {}
    for doc, r in texts.items():
        w = (r.text or "").lower().split()
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((root[a], root[b]))
            root = {d: low if x == high else x for d, x in root.items()}
    assert {d: (r.class_id, r.n_links) for d, r in rows_of(queries.op10_ngram_join(spark, SF)).items()} == {d: (root[d], links[d]) for d in sets}


@needs_data
def test_op3_and_op4_queries(spark, texts):
    import tiktoken  # noqa: F401
    from dendroframe.llm import token_counts

    enc = token_counts._encoding(queries.BYTE_PATTERN, open(queries.BYTE_BPE, "rb").read())
    n = Counter(len(enc.encode_ordinary(r.text or "")) for r in texts.values())
    got = {r.n_tokens: r for r in queries.op4_token_counts(spark, SF).collect()}
    assert {k: r.n_docs for k, r in got.items()} == dict(n)
    for k, r in got.items():
        assert r.tokens_at_least == sum(x * c for x, c in n.items() if x >= k) and r.truncated_tokens == sum(min(x, k) * c for x, c in n.items())
    # op3: links of all pairs of images, by the link test alone
    images = sorted(media.render(spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 120"), "vec_id", "embedding").collect())
    points = [media.corners(media.decode(bytes(r.media))[None])[0] for r in images]
    link = np.zeros((len(points), len(points)), bool)
    for i, p in enumerate(points):
        link[i, i + 1 :] = media.consensus(p, points[i + 1 :]) >= media.MIN_INLIERS
        link[i, i + 1 :] |= np.array([a.media == images[i].media for a in images[i + 1 :]], bool)
    link |= link.T
    found = {r.id: r.n_links for r in media.linked_media(media.render(spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 120"), "vec_id", "embedding")).collect()}
    assert found == {r.id: int(n) for r, n in zip(images, link.sum(axis=1))}
    assert queries.op3_media_copies(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


# -- line dedup


def test_lines_of_one_page_are_no_boilerplate_unless_asked_for(spark):
    rows = [("h", i, "\n".join(f"own {i} {k}" for k in range(5))) for i in range(5)]
    df = spark.createDataFrame(rows, "host string, id long, body string")
    counts = lambda least: {r.n_dropped for r in line_dedup.line_dedup(df, F.col("host"), F.split("body", "\n"), 0.1, 5, out="body", least=least).collect()}
    assert counts(2) == {0} and counts(1) == {5}


# -- clashing names, empty tables, long texts

CLASHES = ["_line_dedup", "_line_dedup_bad", "_mix", "_mix_copies", "_join_k1", "_join", "_language_pred", "_language_score", "_language_fit", "_language_text", "_secret_text", "_Mix_E", "host", "key"]


def test_private_names_do_not_clash(spark, odd):  # noqa: F811
    df = odd.drop("host", "key").withColumns({c: F.lit("kept") for c in CLASHES})
    weights = {"domain": {}, "lang": {}, "source": {}}
    model = language_id.fit({"xx": dict.fromkeys("abcdefghij", 5)}, language_id.vocabulary(queries.PIECES))
    import corpus_pipeline

    mixed = corpus_pipeline.mix_sources(spark, df.withColumn("_mixed_copies", F.lit(7)), "")
    assert mixed.columns == [*df.columns, "_mixed_copies"] and all(r[0] == 7 for r in mixed.select("_mixed_copies").collect())
    outs = [line_dedup.dedup_documents(df), ngram_join.keep_one(df), language_id.accepted(df, model), mixing.mix(df, mixing.domain_of(F.col("source")), weights, 1, 1, 1), secrets.scan(df, secrets.fit([])), bpe.bpe_round_trip(df, queries.WORD_BPE)]
    for out in outs:
        assert set(CLASHES) <= set(out.columns)
        rows = out.select(*(f"`{c}`" for c in CLASHES)).collect()
        assert rows and all(v == "kept" for r in rows for v in r)
    assert outs[0].columns == outs[1].columns == outs[2].columns == df.columns


def test_pipeline_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], DOCS)
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(21)
    text = " ".join("".join(rng.choices("abcdeéß12", k=rng.randrange(1, 9))) + rng.choice(["", "\n", "\t", "  "]) for _ in range(900))
    parts = common.segments(text, 50)
    assert "".join(parts) == text and len(parts) > 50 and max(map(len, parts)) < 80
    assert common.segments("x" * 500, 50) == ["x" * 500] and common.segments("", 50) == [""]
    model = language_id.fit({"xx": {"abc": 3, "bd": 2}, "yy": {"déf": 2, "eß": 4}}, language_id.vocabulary(queries.PIECES))
    enc = bpe.Bpe(open(queries.WORD_BPE, encoding="utf-8").read())
    whole = (model.predict([text, "", text]), ngram_join.grams_of([text, "", "a b"]), enc.encode_each([text, "", "a b"]))
    for module in (language_id, ngram_join, bpe):
        monkeypatch.setattr(module, "BATCH_CHARS", 60)
    again = (model.predict([text, "", text]), ngram_join.grams_of([text, "", "a b"]), enc.encode_each([text, "", "a b"]))
    assert again[0][0] == whole[0][0] and np.allclose(again[0][1], whole[0][1]) and np.allclose(again[0][2], whole[0][2])
    assert all(np.array_equal(a, b) for a, b in zip(again[1], whole[1])) and all(np.array_equal(a, b) for a, b in zip(again[2], whole[2]))


def test_suffix_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 900)
    rng = random.Random(22)
    shared = words(rng, 260)
    body = [words(rng, 500) + shared + words(rng, 300), words(rng, 30) + shared[37:] + words(rng, 900), shared[:450], "z" * 3000]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs_of(spark, body), 400).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in body], 400)))


# -- language ID


def test_texts_without_letters_are_und():
    model = language_id.fit({"xx": {"abc": 3, "a": 4, "b": 4}, "yy": {"déf": 2}}, language_id.vocabulary(queries.PIECES))
    names, score, _ = model.predict(["½", "②", "Ⅳ 5", "12 %$ _", "", "½a", "1b2"])
    assert names[:5] == ["und"] * 5 and (score[:5] == 0).all() and names[5:] == ["xx", "xx"]
    assert language_id.letter_runs("½a1bc_d") == ["a", "bc", "d"]


def test_the_vocabulary_is_whole():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = {p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and ((p := sp.id_to_piece(i).lower()) == "▁" or p.removeprefix("▁").isalpha())}
    pieces = language_id.vocabulary(queries.PIECES)
    assert set(pieces) == letters and max(map(len, pieces)) > 8
    assert language_id.fit({"xx": {"abc": 3}}, pieces).segments.pieces == pieces


def all_splits(word, known):
    """Every way to cut a word into pieces; a character that is none counts as unknown."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known or k == 1:
            for rest in all_splits(word[k:], known):
                yield [word[:k], *rest]


def test_forward_sum_of_long_words():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "abababababab"]
    m = language_id.LanguageModel(["x", "y"], language_id.Segments(pieces), np.random.default_rng(0).uniform(0.01, 0.3, (len(pieces), 2)))
    for k in range(2):
        p = dict(zip(m.segments.pieces, m.prob[:, k]))

        @functools.cache
        def total(s, p=tuple(p.items())):
            known = dict(p)
            return 1.0 if not s else sum(known.get(s[:i], language_id.UNKNOWN if i == 1 else 0) * total(s[i:], p) for i in range(1, min(len(s), 13) + 1))

        for w in ("ab" * 20, "abc" * 12, "b" * 33, "a"):
            assert m.word_scores([w])[0, k] == pytest.approx(np.log(total("▁" + w)), rel=1e-9)


def test_expectation_maximisation_by_enumeration(monkeypatch):
    monkeypatch.setattr(language_id, "ROUNDS", 2)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    words_of = {"x": {"ab": 3, "bab": 1}, "y": {"ba": 2, "cab": 1}}
    model = language_id.fit(words_of, pieces)
    for k, lang in enumerate(sorted(words_of)):
        prob = dict.fromkeys(sorted(pieces), 1 / len(pieces))
        for _ in range(2):
            got = dict.fromkeys(prob, 0.0)
            for w, n in words_of[lang].items():
                ways = [(s, np.prod([prob.get(p, language_id.UNKNOWN) for p in s])) for s in all_splits("▁" + w, prob)]
                whole = sum(x for _, x in ways)
                for s, x in ways:
                    for p in s:
                        if p in got:
                            got[p] += n * x / whole
            prob = {p: max(x / sum(got.values()), language_id.LEAST) for p, x in got.items()}
        scale = sum(prob.values())
        assert model.prob[:, k] == pytest.approx([prob[p] / scale for p in sorted(pieces)], rel=1e-9)
    # a prediction is the posterior under equal priors of the product over words
    names, score, fit = model.predict(["ab bab ab"])
    s = np.array([model.word_scores(["ab"])[0] * 2 + model.word_scores(["bab"])[0]])[0]
    assert names == ["x"] and score[0] == pytest.approx(np.exp(s[0]) / np.exp(s).sum()) and fit[0] == pytest.approx(s[0] / 7)


# -- secrets


def test_base_patterns_on_random_texts():
    rng = random.Random(23)
    bits = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", "\"", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "é", "\n", "K", ".", "-", "abc", "AKIAAKIA0000000000", "ſecret"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert [(a, k, b) for a, b, k in secrets.base_spans(text)] == plain_base(text), text


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(24)
    for _ in range(60):
        f = secrets.Field([np.zeros((s, 3)) for s in secrets.SIZES], rng.normal(size=(3, 3)))
        e = rng.normal(size=(rng.integers(1, 7), 3))

        def score(path):
            return e[0][path[0]] + sum(f.moves[a, b] + e[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:]))) + (secrets._NEVER - e[0][2] if path[0] == secrets.I else 0)

        best = max(itertools.product(range(3), repeat=len(e)), key=score)
        assert score(f.decode(e)) == pytest.approx(score(best))


def test_field_on_secrets_of_other_shapes():
    """Held-out precision and recall: the planted values follow formats that the fit's own generator does not make."""
    rng = random.Random(25)
    field = secrets.fit([words(rng, 120) for _ in range(300)])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    alnum = upper + upper.lower() + "0123456789"
    kinds = [
        lambda: "ghp_" + some(alnum, 36),
        lambda: "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24),
        lambda: "eyJ" + some(alnum, 17) + "." + some(alnum, 40) + "." + some(alnum + "-_", 43),
        lambda: "sk_live_" + some(alnum, 24),
        lambda: some(alnum + "+/", 42) + "==",
    ]
    hits = wrong = planted = 0
    for _ in range(200):
        before, value, after = words(rng, 60), rng.choice(kinds)(), words(rng, 40) + f" mail to {words(rng, 1)}@{words(rng, 1)}.org, call +49 30 1234567 on 2024-05-06."
        text = f"{before} {value} {after}"
        a, b = len(before) + 1, len(before) + 1 + len(value)
        spans = [(s, e) for s, e, k in secrets.scan_texts(field, [text])[0] if k == 3]
        planted += 1
        hits += any(s < b and e > a for s, e in spans)
        wrong += sum(e <= a or s >= b for s, e in spans)
    assert hits / planted >= 0.9 and hits / (hits + wrong) >= 0.9


# -- top-k


def test_topk_phases(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 2)
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = np.random.default_rng(26)
    v = rng.normal(size=(1500, 16))
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    p = topk.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), "vec_id", "embedding")
    for slices in (1, 2, 3):
        got = topk.phases(p.filter("id % 50 = 0"), p, 10, slices)
        whole = np.floor(1024 * np.array([r for _, r in rows])).astype(int)
        scores = whole[::50] @ whole.T
        n_q = len(scores)
        cut = {r.qi + 0: r.cut for r in got["cuts"].collect()}
        assert len(cut) <= topk.QUERY_BLOCK and got["cuts"].count() == n_q
        heads, sent = (sum(len(set(zip(r.qi, r.pos))) for r in got[k].collect()) for k in ("heads", "sent"))
        assert heads <= slices * topk.DEPTH * 10 * n_q and sent < 0.2 * n_q * len(rows) * slices  # few of all entries
        want = []
        for q in range(n_q):
            order = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != 50 * q)[:10]
            want += [(50 * q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
        assert sorted(map(tuple, got["result"].collect())) == want


def test_topk_with_one_vector_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    rng = np.random.default_rng(27)
    common_ = [1.0, -2.0, 0.5, 0.25]
    rows = [(i, common_ if i % 3 else [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(900)] + [(7, common_)] * 15
    p = topk.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = topk.phases(p.filter("id % 100 = 0"), p, 10)
    v = [(i, np.floor(1024 * np.array(x)).astype(int)) for i, x in rows]
    for q in range(0, 900, 100):
        own = v[q][1]
        order = sorted((-int(own @ w), i) for i, w in v if i != q)[:10]
        assert sorted((r.rank, r.vec_id, r.score) for r in got["result"].filter(f"query_id = {q}").collect()) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    entries = sum(len(r.qi) for r in got["sent"].collect())
    assert entries < 9 * 2 * (300 + 11 * 11)  # copies of the common vector are not all sent


def test_topk_of_huge_numbers(spark):
    rows = [(0, [3.0e30, -3.0e30]), (1, [2.0e12, 1.0]), (2, [-2.0e12, 5.0]), (3, [1.0e13, 1.0e13]), (4, [0.0, 0.0]), (5, [5.0e5, 5.0e5])]
    p = topk.prepare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    whole = {r.id: list(r.v) for r in p.collect()}
    got = {}
    for r in topk.top_k(p.filter("id in (1, 2, 3, 5)"), p, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (1, 2, 3, 5):
        total = lambda w: min(max(sum(min(max(a * b, -topk._FAR), topk._FAR) for a, b in zip(whole[q], w)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        order = sorted((-total(w), i) for i, w in whole.items() if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]


# -- components


@pytest.mark.parametrize("hub", [2048, 3])
def test_components_brute_force(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(28)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(500, 600 + i) for i in range(60)] + [(900 + i, 901 + i) for i in range(30)] + [(2000, 1000 + i) for i in range(40)] + [(4, 4)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert ngram_join.components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


@pytest.mark.parametrize("hubs", [50_000, 3])
def test_joins_with_hubs_are_joins(spark, monkeypatch, hubs):
    monkeypatch.setattr(common, "HUB", 2)
    monkeypatch.setattr(common, "HUBS", hubs)
    rng = random.Random(32)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i) for i in range(60)]
    n = Counter(k for k, _ in rows if k is not None and k != 5)
    a, b = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(list(n.items()), "k long, c long")
    for how in ("inner", "left"):
        got = sorted((r.k or 0, r.i, r.c or 0) for r in common.spread_join(a, b, "k", "c", len(rows), how).collect())
        assert got == sorted((k or 0, i, n.get(k, 0)) for k, i in rows if how == "left" or k in n)


@pytest.mark.parametrize("hub", [2048, 1])
def test_groups_of_copies_as_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(33)
    base = words(rng, 80).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 40, 70)]
    body = [" ".join(base)] * 9 + near * 2 + [words(rng, 60) for _ in range(4)] + [None, ""]
    got = {r.id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs_of(spark, body)).collect()}
    assert [got[i][0] for i in range(15)] == [0] * 15 and got[0][1] == 14 and all(got[i] == (i, 0) for i in range(15, 21))
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs_of(spark, body), 100).collect()}
    assert kept == dict(enumerate(brute_repeats([(t or "").encode() for t in body], 100)))


def _plain_log(word, known, first):
    """Log of the sum over all segmentations, as whole fractions."""
    f = [Fraction(1)]
    s = "▁" + word
    for j in range(1, len(s) + 1):
        f.append(sum(f[i] * (known.get(s[i:j]) or (first if j - i == 1 else 0)) for i in range(max(0, j - 16), j)))
    return f


def test_language_fit_counts_long_words_in_full():
    pieces = ["▁", "a", "b", "ab", "aba", "▁ab"]
    words = {"x": {"ab" * 250: 3, "a": 1, "c" * 500: 2}, "y": {"ba" * 30 + "d" * 90: 5}}
    model = language_id.fit(words, pieces)
    first = Fraction(language_id.UNKNOWN)
    for k, lang in enumerate(("x", "y")):
        prob = dict.fromkeys(pieces, Fraction(1, len(pieces)))
        for _ in range(language_id.ROUNDS):
            got = dict.fromkeys(pieces, 0.0)
            for w, n in words[lang].items():
                s, f = "▁" + w, _plain_log(w, prob, first)
                back = [Fraction(0)] * len(s) + [Fraction(1)]
                for i in range(len(s) - 1, -1, -1):
                    back[i] = sum(back[j] * (prob.get(s[i:j]) or (first if j - i == 1 else 0)) for j in range(i + 1, min(len(s), i + 16) + 1))
                for i in range(len(s)):
                    for j in range(i + 1, min(len(s), i + 16) + 1):
                        if s[i:j] in prob:
                            got[s[i:j]] += float(n * f[i] * prob[s[i:j]] * back[j] / f[-1])
            prob = {p: max(v / sum(got.values()), language_id.LEAST) for p, v in got.items()}
            prob = {p: Fraction(v).limit_denominator(10**12) for p, v in prob.items()}
        total = float(sum(prob.values()))
        for p, v in zip(model.segments.pieces, model.prob[:, k].tolist()):
            assert abs(v - float(prob[p]) / total) < 1e-6, (lang, p)
    # a word that no language covers still tells them apart, at any length
    for w in ("ab" * 250, "e" * 500, "ba" * 300):
        want = [(lambda f: math.log(f.numerator) - math.log(f.denominator))(_plain_log(w, {p: Fraction(v) for p, v in zip(model.segments.pieces, model.prob[:, k].tolist())}, first)[-1]) for k in (0, 1)]
        assert np.allclose(model.word_scores([w])[0], want, rtol=1e-9)


def test_language_query_against_a_plain_version(spark):
    """All documents: the forward sum of each word, one after the other, in logarithms."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.trained_language_model(docs)
    logs = [{p: math.log(v) for p, v in zip(model.segments.pieces, col.tolist())} for col in model.prob.T]
    least = math.log(language_id.UNKNOWN)

    @lru_cache(None)
    def scores(word):
        s, out = "▁" + word, []
        for known in logs:
            f = [0.0]
            for j in range(1, len(s) + 1):
                ways = [f[i] + known[s[i:j]] for i in range(max(0, j - model.segments.longest), j) if s[i:j] in known]
                if s[j - 1] not in known:
                    ways.append(f[j - 1] + least)
                top = max(ways)
                f.append(top + math.log(sum(math.exp(x - top) for x in ways)))
            out.append(f[-1])
        return out

    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op7_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        words = "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()
        sums = [math.fsum(scores(w)[k] for w in words) for k in range(len(logs))]
        if not words:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        top = max(sums)
        assert got[r.doc_id][0] == model.languages[sums.index(top)]
        assert abs(got[r.doc_id][1] - 1 / sum(math.exp(x - top) for x in sums)) < 1e-6


def test_language_model_too_large_to_broadcast(spark, monkeypatch):
    model = language_id.fit({"xx": {"abc": 3}}, ["▁", "a"])
    monkeypatch.setattr(language_id, "MODEL_BYTES", 8)
    with pytest.raises(ValueError, match="broadcast"):
        language_id.identify(spark.createDataFrame([("a",)], "text string"), model)


# -- media


def test_media_with_broken_headers():
    a = np.random.default_rng(29).integers(0, 256, (24, 24))
    good = png(a)
    assert np.array_equal(media.decode(good), a)
    for kind in range(256):
        raw = bytearray(good)
        raw[25] = kind
        media.decode(bytes(raw))  # never raises
    rng = random.Random(30)
    for source in (good, pgm(a)):
        for _ in range(400):
            raw = bytearray(source)
            for _ in range(rng.randrange(1, 4)):
                raw[rng.randrange(min(60, len(raw)))] = rng.randrange(256)
            media.decode(bytes(raw[: rng.randrange(len(raw) + 1)]))
    assert media.decode(b"P5 99999999 99999999 255\n" + b"x" * 10) is None and media.decode(b"P5") is None


def scene(rng, side=128):
    """A picture with structure at several sizes."""
    out = np.zeros((side, side))
    for cell, weight in ((4, 0.6), (8, 1.0), (16, 1.0), (32, 0.7)):
        out += weight * np.kron(rng.normal(size=(side // cell, side // cell)), np.ones((cell, cell)))
    return np.clip(128 + 45 * out, 0, 255).astype(np.uint8)


EDITS = {
    "crop": lambda a, rng: a[20:116, 12:108],
    "brightness": lambda a, rng: np.clip(a * 0.7 + 25, 0, 255),
    "noise": lambda a, rng: np.clip(a + rng.normal(0, 4, a.shape), 0, 255),
    "half size": lambda a, rng: a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).mean(axis=(1, 3)),
    "quarter turn": lambda a, rng: np.rot90(a),
    "quarter of the area": lambda a, rng: a[40:104, 40:104],
}


def test_media_that_inflates_beyond_its_size():
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    def png(w, h, lines):
        head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")

    flat = b"".join(b"\0" + bytes([k] * 5) for k in range(4))
    assert media.decode(png(5, 4, flat)).tolist() == [[k] * 5 for k in range(4)]
    more, less = png(5, 4, bytes(50_000_000)), png(60_000, 60_000, bytes(1000))  # than the header says
    tracemalloc.start()
    assert media.decode(more) is None and media.decode(less) is None
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_media_corners_of_wide_images_keep_their_places():
    rng = np.random.default_rng(5)
    part = np.kron(rng.integers(0, 255, (6, 8)), np.ones((8, 8))).astype(np.float32)
    wide = np.full((48, 70_000), 128, np.float32)
    wide[:, 69_900:69_964] = part
    (rows,) = media.corners(wide[None])
    full = rows[rows["s"] == 0]
    assert len(full) and full["x"].min() > 69_800 and full["x"].max() < 70_000


def test_media_recall_of_edits(spark):
    """Recall of the whole operator for each kind of edit, and no link between different pictures."""
    rng = np.random.default_rng(31)
    rows, of = [], {}
    for i in range(20):
        a = scene(rng)
        rows.append((1000 * i, pgm(a)))
        for k, edit in enumerate(EDITS.values()):
            rows.append((1000 * i + k + 1, pgm(np.asarray(edit(a, rng)))))
    got = {r.id: (r.class_id, r.n_links) for r in media.linked_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    for k, name in enumerate(EDITS):
        recall = np.mean([got[1000 * i + k + 1][0] == 1000 * i for i in range(20)])
        print(name, recall)
        assert recall >= 0.9, name
    assert all(c // 1000 == i // 1000 for i, (c, _) in got.items())

"""Centroid clusters, phrases and main text: brute force, edges, and layouts that the field's examples do not make."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.llm import centroids, collocations, main_text

# -- centroids


def plain_kmeans(items, k, rounds, seed):
    items = sorted(items, key=lambda t: (hashlib.sha256(f"{seed}:{t[0]}".encode()).hexdigest(), t[1]))
    c = [list(v) for _, v in items[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in items]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(items, own) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in items), c


@pytest.mark.parametrize("n, dims, k, span", [(300, 2, 8, 4), (250, 3, 20, 30), (5, 2, 8, 3), (120, 64, 8, 1000)])
def test_clusters_brute_force(spark, n, dims, k, span):
    """Small spans give many ties and empty clusters."""
    x = np.random.default_rng(n).integers(-span, span, (n, dims))
    rows = [(i % (n - 3), [float(y) / 1024 for y in r]) for i, r in enumerate(x)]  # some ids twice
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding", k, 4, 3, dims).collect()
    want, c = plain_kmeans([(i, [int(y * 1024) for y in v]) for i, v in rows], k, 4, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_exponion_step_is_exact_and_skips():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-40, 40, (200, 3)) + rng.integers(-900, 900, 3) for _ in range(30)])
    c = x[rng.choice(len(x), 60, replace=False)]
    state = centroids.Search(c).all(x)
    for _ in range(5):
        new = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(len(c))])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + 1e-12)
        search, c = centroids.Search(new, moved), new
        state = search.step(x, *state)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] >= np.sqrt(d.min(axis=1))).all() and (state[2] <= np.sqrt(np.partition(d, 1, axis=1)[:, 1])).all()
        assert search.met < d.size / 4


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster string, ID int"
    fine = [0.5] * 64
    rows = [(1, None, "x", 1), (2, fine[:63], "x", 1), (3, [None, *fine[:63]], "x", 1), (4, [float("nan"), *fine[:63]], "x", 1), (5, [float("inf"), *fine[:63]], "x", 1), (6, fine, "x", 1), (None, [1e30, *fine[:63]], "x", 1), (6, fine, "x", 1), (7, [], "x", 1)]
    got = centroids.cluster(spark.createDataFrame(rows, schema), "vec_id", "embedding", rounds=2).collect()
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in got) == [(0, 2, 0), (6, 0, 0), (6, 0, 0)]
    none = centroids.cluster(spark.createDataFrame(rows[:5], schema), "vec_id", "embedding")
    assert none.collect() == [] and none.columns == got[0].__fields__


# -- phrases


def plain_phrases(rows, least=30, top=2000, share=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        best = []
        for p, a in good.items():
            if p in inner and 100 * inner[p] >= share * a:
                continue
            s, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def phrase_docs():
    rng = random.Random(2)
    docs = [(rng.choice(["en", "de", None]), "".join(rng.choice(["the", "The", "of", "Über", "a", "zu", "É", "x1"]) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", " ", " "]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    return [*docs, ("en", None), ("en", ""), ("fr", "... ,"), ("de", "lang " * 3000), ("de", "lang " * 3000), (None, "a b c\x1fd " * 40)]


@pytest.mark.parametrize("buckets, size, top, least", [(1 << 25, 8 << 20, 2000, 30), (1 << 17, 500, 7, 30), (1 << 17, 8 << 20, 2000, 200)])
def test_phrases_brute_force(spark, buckets, size, top, least):
    """Few buckets collide and prune less; small slices cut texts at ends of pieces. Results are the same."""
    df = spark.createDataFrame([(*r, 1) for r in phrase_docs()], "lang string, text string, phrase int").repartition(3)
    got = collocations.collocations(df, F.col("lang"), F.col("text"), collocations.Counting(least=least, buckets=buckets, slice=size), top).collect()
    assert sorted(map(tuple, got)) == plain_phrases(phrase_docs(), least, top)


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df, F.col("lang"), F.col("text")).collect() == []
    df = spark.createDataFrame([("en", None), (None, "one two")], "lang string, text string")
    assert collocations.collocations(df, F.col("lang"), F.col("text")).collect() == []


def test_rare_phrases_are_pruned_before_counting(spark):
    """The second scan gives no phrase whose words are rare, and hardly any whose bucket is."""
    rng = random.Random(3)
    docs = [("en", " ".join(f"w{rng.randrange(100)}" for _ in range(40)) + " " + " ".join(f"rare{i}x{j}" for j in range(20))) for i in range(300)]
    rows = spark.createDataFrame(docs, "lang string, text string")
    how = collocations.Counting()
    one = collocations._scan(rows, 1, how, None, None)
    words = one.filter("part is null and phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter("n >= 30")
    two = collocations._scan(rows, 2, how, collocations._known(words, 1, how), collocations._bitmap(one, how))
    met = {r.phrase for r in two.filter("part is null").collect()}
    true = Counter(f"{a} {b}" for _, t in docs for a, b in zip(t.split(), t.split()[1:]))
    assert {p for p, n in true.items() if n >= 30} <= met
    assert not any("rare" in p for p in met) and len(met) < 0.01 * len(true) + 5


# -- main text


@pytest.fixture(scope="module")
def field():
    return main_text.train(main_text.example_pages())


def test_blocks_of_broken_html():
    text = lambda h: [b.text for b in main_text.blocks(h)]
    assert text("<p>a <b>b<br>c <p>d</i> e</p>f&amp;g &lt;x&gt;&nbsp;<li>h<li>i") == ["a b c", "d e", "f&g <x>", "h", "i"]
    assert text("a<!-- <p>no</p> -->b<script>if (a<b) '</p>'</script><style>p{}</style> c<textarea><p>no</textarea>") == ["ab c"]
    assert text("5 < 6 <a title='x>y'>link</a> </ > <p class=\"q>r\">in</p><!doctype x><p>cut &am") == ["5 < 6 link", "in", "cut &am"]
    assert text("<td>a<td>b<tr><th>c</table>d</div></div><script>never closed") == ["a", "b", "c", "d"]
    assert text("") == [] and text("plain  text\n&#169;") == ["plain text ©"] and text("x <p") == ["x"]
    assert text("<div>" * 50_000 + "deep" + "<b>" * 50_000 + "er") == ["deeper"]


def test_viterbi_is_the_best_labelling(field):
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 8)
        scores, same = [rng.uniform(-2, 2) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]
        value = lambda y: sum(x for x, k in zip(scores, y) if k) + sum(field.moves[int(same[i])][y[i - 1]][y[i]] for i in range(1, n))
        best = max(([j >> i & 1 for i in range(n)] for j in range(2**n)), key=value)
        assert value(field.decode(scores, same)) == pytest.approx(value(best))


def test_held_out_pages(field):
    pages = main_text.example_pages(200, seed=77)
    right = sum(field.text(h) == t for h, t in pages)
    wrong = total = 0
    for h, t in pages:
        found = main_text.blocks(h, field.weights)
        want, got = main_text.label(found, t), field.decode(field.scores(found), main_text._same(found))
        wrong += sum(a != b for a, b in zip(want, got))
        total += len(want)
    assert right >= 0.9 * len(pages) and wrong < 0.01 * total


BODY = ["A quiet morning by the lake", "The fog had not yet lifted when the first boats went out, and nobody on the shore spoke.", "By noon, the market was full; fishermen sold what they had caught.", "A short line.", "What comes next", "Nobody knows whether the boats will return tomorrow, said the harbour master, but they always have."]
ART = f"<h1>{BODY[0]}</h1><p>{BODY[1]}</p><p>{BODY[2]}<p>{BODY[3]}</p><h2>{BODY[4]}</h2><p>{BODY[5]}</p>"
REST = "<p>This site uses small files to remember you. By going on you agree.</p>"
LAYOUTS = {
    "tags": f"<header><a href=/>Lake News</a></header><nav><a href=1>Home</a> <a href=2>Sport</a></nav><main><article>{ART}</article><aside><h3>Also read</h3><p>Ten boats that changed the lake for ever.</p></aside></main><footer><p>All rights reserved, Lake News Ltd.</p></footer>",
    "classes": f"<div id=page><div class=top-menu><ul><li><a href=1>Home</a><li><a href=2>Sport</a></ul></div><div class='cookie-consent'>{REST}</div><div class='post-content'>{ART}</div><div id='comments'><div class=comment><p>Lovely story, I grew up near that lake and miss it, thanks for writing.</p></div></div><div class='site-footer'>Lake News Ltd, 12 Shore Road. Write to us.</div></div>",
    "inside": f"<body><article class=story><h1>{BODY[0]}</h1><p>{BODY[1]}</p><div class=advert>Buy new boats today. They float, they shine, they are cheap.</div><p>{BODY[2]}<p>{BODY[3]}</p><form class=newsletter><label>Mail</label><input><button>Join</button></form><h2>{BODY[4]}</h2><p>{BODY[5]}</p></article><section class=reader-comments><h3>Comments</h3><ol><li><p>First! A fine piece of work, and I read all of it twice.</p></li></ol></section>",
    "table": f"<table><tr><td class=leftcol><a href=1>Home</a><br><a href=2>Sport</a></td><td class=maintext>{ART}</td><td class=sidebar><p><a href=9>Most read</a></p></td></tr></table><div class=footer>&copy; Lake News</div>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_written_by_hand(field, name):
    assert field.text(LAYOUTS[name]) == "\n".join(BODY)


def test_extract_edges(spark, field):
    schema = "page_id long, url string, html string, text string, N_chars int"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", LAYOUTS["tags"], "x", 1), (3, "u", "<nav><a href=1>x</a></nav>", None, None), (3, "u", "<nav><a href=1>x</a></nav>", None, None)]
    got = main_text.extract(spark.createDataFrame(rows, schema), field)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "\n".join(BODY), len("\n".join(BODY))), (3, "u", "", 0), (3, "u", "", 0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert main_text.extract(spark.createDataFrame([], schema), field).collect() == []
    long = f"<article><h1>Long</h1>{'<p>One more sentence, and another one.</p>' * 20_000}</article>"
    assert field.text(long).count("\n") == 20_000

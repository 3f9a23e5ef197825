"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, collocations, language_id, line_dedup, main_text, media, mixing, ngram_join, secrets, suffix_dedup, token_counts, topk
from .common import read_table

#: The public tokenizers' files; each is a parameter of the operator that needs it.
WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
#: GPT-2's splitting pattern, which the byte-level vocabularies were made with (fixed value).
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LINE_RATIO, LINE_MIN_PAGES, LINE_LEAST = 0.1, 5, 2
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
MIX_NUM, MIX_DEN, MIX_EPOCHS, MIX_SEED = 3, 5, 2, 17


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: the lines of its HTML without its host's boilerplate."""
    pages = read_table(spark, sf_dir, "pages")
    out = line_dedup.line_dedup(pages, line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")), LINE_RATIO, LINE_MIN_PAGES, least=LINE_LEAST)
    return out.select("page_id", line_dedup.host_of(F.col("url")).alias("host"), "n_lines", "n_dropped", "text")


OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, html IS NULL AS none,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#:]+)', 2)), '^www\.', ''), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
c AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l GROUP BY host, line),
bad AS (SELECT c.host, c.line FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE t.total >= {LINE_MIN_PAGES} AND c.n >= {LINE_LEAST} AND c.n > CAST({LINE_RATIO} AS DOUBLE) * t.total),
k AS (SELECT l.page_id, l.pos, l.line, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.host IS NOT DISTINCT FROM bad.host AND l.line = bad.line),
g AS (SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text FROM k GROUP BY page_id)
SELECT p.page_id, p.host, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped, CASE WHEN p.none THEN NULL ELSE coalesce(g.text, '') END AS text
FROM p LEFT JOIN g ON p.page_id = g.page_id
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the 400-byte strings that start anywhere else too."""
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of copied images. The tables hold no media, so every vector of embeddings is shown as an image first."""
    images = media.render(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.linked_media(images, "id", "media").withColumnRenamed("id", "vec_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact histogram of token lengths over all documents, with suffix sums."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.length_histogram(token_counts.token_lengths(docs, BYTE_BPE, BYTE_PATTERN))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every whole document: those of the fixed patterns, and the spans that the random field adds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, secrets.train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long")
    return out.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(F.filter("found", lambda x: x.kind != "crf")).cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"), n("crf").alias("n_crf"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, and in how many epochs."""
    docs = read_table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mixing.domain_of(F.col("source")), MIX_WEIGHTS, MIX_NUM, MIX_DEN, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("n_copies"))


def _weights_sql(col: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _fill_sql(name: str, source: str, parent: str, key: str) -> str:
    """One level of the tree: shares a parent's budget among its children."""
    order = f"PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {key}"
    return f"""
{name}_a AS (SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_b,
    sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM {source}),
{name}_b AS (SELECT *, capacity::HUGEINT * rest_w <= rest_b::HUGEINT * weight AS is_full FROM {name}_a),
{name}_c AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS left_b, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_w FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (left_b::HUGEINT * weight) // open_w END AS share FROM {name}_c)"""


def mixing_ctes(table: str) -> str:
    """From `mixing_table` (doc_id, text, lang, source) to mix_out: the rows of `table` with n_copies."""
    return f"""
mix_docs AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS mid, coalesce(lang, 'none') AS ml, coalesce(source, 'none') AS ms,
    coalesce(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})', 1) = '' THEN 'other' ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT) % 4 AS VARCHAR) END, 'none') AS md,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS mn FROM {table}),
mix_leaf AS (SELECT md, ml, ms, sum(mn)::BIGINT AS tokens, sum(mn)::BIGINT * {MIX_EPOCHS} AS capacity FROM mix_docs GROUP BY md, ml, ms),
mix_t0 AS (SELECT md, sum(capacity) AS capacity, {_weights_sql("md", MIX_WEIGHTS["domain"])} AS weight, 0 AS root, least((SELECT sum(tokens) FROM mix_leaf)::HUGEINT * {MIX_NUM} // {MIX_DEN}, (SELECT sum(capacity) FROM mix_leaf)) AS budget FROM mix_leaf GROUP BY md),
{_fill_sql("mix_t1", "mix_t0", "root", "md")},
mix_m0 AS (SELECT l.md, l.ml, sum(l.capacity) AS capacity, {_weights_sql("l.ml", MIX_WEIGHTS["lang"])} AS weight, any_value(t.share) AS budget FROM mix_leaf l JOIN mix_t1 t USING (md) GROUP BY l.md, l.ml),
{_fill_sql("mix_m1", "mix_m0", "md", "ml")},
mix_l0 AS (SELECT l.md, l.ml, l.ms, l.tokens, l.capacity, 1 AS weight, m.share AS budget FROM mix_leaf l JOIN mix_m1 m USING (md, ml)),
{_fill_sql("mix_l1", "mix_l0", "md, ml", "ms")},
mix_plan AS (SELECT md, ml, ms, share // greatest(tokens, 1) AS epochs, share % greatest(tokens, 1) AS rest FROM mix_l1),
mix_keyed AS (SELECT d.*, p.epochs, p.rest, md5('{MIX_SEED}:' || CAST(p.epochs + 1 AS VARCHAR) || ':' || d.mid) AS h FROM mix_docs d JOIN mix_plan p USING (md, ml, ms)),
mix_sums AS (SELECT *, sum(mn) OVER (PARTITION BY md, ml, ms ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM mix_keyed),
mix_out AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM mix_sums WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0)"""


OP6_SQL = f"WITH {mixing_ctes('documents')}\nSELECT doc_id, md AS domain, ml AS lang, ms AS source, CAST(mn AS BIGINT) AS n_tokens, n_copies FROM mix_out"


def trained_language_model(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))), PIECES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole document."""
    docs = read_table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), trained_language_model(docs), keep_text=False)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_fit")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector."""
    rows = topk.prepare(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.filter(topk.is_query(F.col("id"))), rows)


OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.bpe_round_trip(docs, WORD_BPE)
    return out.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates and its number of links."""
    out = ngram_join.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds of exact k-means."""
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _rounds_sql(k: int, rounds: int) -> str:
    """c0 .. c<rounds>: the centroids (j, v) of each round; d<rounds>: the last assignment."""
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = []
    for i in range(rounds + 1):
        out.append(f"d{i} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, j := j)) AS m FROM (SELECT e.rid, c.j, CAST({square} AS BIGINT) AS d FROM e, c{i} c) GROUP BY rid)")
        if i < rounds:
            out.append(
                f"s{i} AS (SELECT j, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT d{i}.m.j AS j, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS pos FROM e JOIN d{i} ON d{i}.rid = e.rid) GROUP BY j, pos),\n"
                f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(g.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{i} GROUP BY j) g ON g.j = c.j)"
            )
    return ",\n".join(out)


OP11_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v FROM (SELECT sha256('{centroids.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT {centroids.K})),
{_rounds_sql(centroids.K, centroids.ROUNDS)}
SELECT e.vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM e JOIN d{centroids.ROUNDS} d ON d.rid = e.rid JOIN c{centroids.ROUNDS} c ON c.j = d.m.j
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases of two to four words, over all whole documents."""
    docs = read_table(spark, sf_dir, "documents")
    return collocations.collocations(docs, F.col("lang"), F.col("text"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, {collocations.LONGEST + 1}) r(k) WHERE len(words) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase HAVING c >= {collocations.LEAST}),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
a AS MATERIALIZED (SELECT lang, k AS size, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
x AS (SELECT a.lang, a.size, a.phrase, a.a, j AS k, l.c AS l, r.c AS r, CAST({collocations.SCALE}::HUGEINT * a.a // (l.c + r.c) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS j FROM a) a JOIN f l ON l.lang = a.lang AND l.phrase = array_to_string(a.ws[1 : j], ' ') JOIN f r ON r.lang = a.lang AND r.phrase = array_to_string(a.ws[j + 1 : ], ' ')),
b AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS m FROM x GROUP BY lang, phrase, a),
h AS (SELECT lang, array_to_string(ws[i : i + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - z + 2)) AS i FROM a, range(2, {collocations.LONGEST}) s(z) WHERE z < size) GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, b.a, b.m, row_number() OVER (PARTITION BY b.lang ORDER BY b.m.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < {collocations.SHARE} * b.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.m.l AS l, o.m.r AS r, t.n, o.m.score AS score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= {collocations.TOP}
"""


@functools.cache
def page_field() -> main_text.Field:
    """The field of op 13, trained once a driver on labelled pages of invented words (the tables hold no labels)."""
    return main_text.train(main_text.example_pages())


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, page_field())


#: What the field must find on these tables, whose pages hold their main text in one article of headings and paragraphs.
OP13_SQL = r"""
WITH p AS (SELECT page_id, url, row_number() OVER () AS rid, regexp_replace(regexp_replace(regexp_extract(html, '<article>((?s:.*?))(</article>|$)', 1), '</?b>', '', 'g'), '<br>', ' ', 'g') AS body FROM pages),
b AS (SELECT rid, unnest(string_split_regex(body, '</?(p|h1)>')) AS block, generate_subscripts(string_split_regex(body, '</?(p|h1)>'), 1) AS pos FROM p),
c AS (SELECT rid, pos, trim(regexp_replace(replace(replace(replace(replace(block, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM b),
t AS (SELECT rid, string_agg(block, chr(10) ORDER BY pos) AS text FROM c WHERE block <> '' GROUP BY rid)
SELECT p.page_id, p.url, coalesce(t.text, '') AS text, length(coalesce(t.text, '')) AS n_chars FROM p LEFT JOIN t ON t.rid = p.rid
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_media_copies": op3_media_copies,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_language_id": op7_language_id,
    "op8_topk_search": op8_topk_search,
    "op9_bpe": op9_bpe,
    "op10_ngram_join": op10_ngram_join,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_html_extraction": op13_html_extraction,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op6_source_mixing": OP6_SQL, "op8_topk_search": OP8_SQL, "op11_centroid_clusters": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_html_extraction": OP13_SQL}

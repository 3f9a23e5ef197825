"""Near-duplicate join on word 5-grams: exact Jaccard similarity of 0.8 or more, with Bayesian pruning of MinHash candidates.

1. Each document becomes the set of its word 5-grams; documents with equal sets form a class, and one of each goes on, under a
   number of its own.
2. MinHash values are cut into bands; documents that share a band meet in its bucket. There, values are compared in steps of
   16, and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold
   is below `tolerance`. The surviving pairs are only followed to join groups; they are never emitted.
3. Inside each group all pairs are compared exactly, block by block; that gives the links and the final classes.

Buckets and groups of any size are dealt out as pairs of blocks, so no task gathers more than two blocks; rows that leave a
task grow with its documents, not with their pairs. No cap: every pair that shares a band is compared.

Defined results: words are what white space separates, in lower case; a text of 1 to 4 words has one gram, the whole; null and
empty texts have no grams, no links and a class of their own; equal rows are documents of their own and links of each other;
class_id is the least id of the class (null if it has none); n_links counts all other documents at the threshold or above; an
empty table gives an empty result. Rows are told apart by 128 bits of id and text. Of a very long text only one part's words
are Python objects at a time; the rest is 8 bytes a word. Columns of any name may come along: only id and text are used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chars, dealt, discard, fresh, materialize, segments, spread_join, text_slices

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
TOLERANCE = 1e-6
STEP = 16
#: Documents of a bucket, and of a group, that meet in one task: two blocks at most.
BUCKET_BLOCK, GROUP_BLOCK = 512, 256
BATCH_CHARS = 500_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def grams_of(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit gram hashes of each text, sorted, one text after the other; and each text's number of them."""
    parts = [(i, p) for i, t in enumerate(texts) for p in segments(t, BATCH_CHARS)]
    n, hashes = np.zeros(len(texts), np.int64), []
    for a, b in by_chars([p for _, p in parts], BATCH_CHARS):
        flat: list[str] = []
        for i, p in parts[a:b]:
            found = p.lower().split()
            flat += found
            n[i] += len(found)
        if flat:
            code, uniq = pd.factorize(np.array(flat, dtype=object))
            hashes.append(np.fromiter((xxhash.xxh64_intdigest(w) for w in uniq), np.uint64, len(uniq))[code])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = np.concatenate(hashes)
    start = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        count = np.where(n >= words, n - words + 1, (n > 0) * 1)
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[doc]
        room = np.minimum(n, words)[doc]
        h = np.zeros(len(at), np.uint64)
        for k in range(words):
            part = np.where(k < room, word[np.minimum(at + k, len(word) - 1)], np.uint64(k + 1))
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(32)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[first], np.bincount(doc[first], minlength=len(n))


def signatures(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The lowest 16 bits of each MinHash value: texts with grams x size."""
    a = np.random.default_rng(11).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    out = np.zeros((int(some.sum()), size), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = grams * a[k]
            x ^= x >> np.uint64(32)
            x *= _MIX
            out[:, k] = (np.minimum.reduceat(x, starts) >> np.uint64(8)).astype(np.uint16)
    return out


def least_matches(size: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For 0..size compared values: the fewest matches with which P(similarity >= threshold) is still at `tolerance` or more. With a uniform prior that is P(Binomial(n + 1, threshold) <= matches)."""
    out = np.zeros(size + 1, np.int64)
    for n in range(1, size + 1):
        p = np.zeros(n + 2)
        p[0] = (1 - threshold) ** (n + 1)
        for i in range(1, n + 2):
            p[i] = p[i - 1] * (n + 2 - i) / i * threshold / (1 - threshold)
        out[n] = int(np.searchsorted(np.cumsum(p), tolerance))
    return out


def candidates(one: np.ndarray, rest: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Numbers of the rows of `rest` that stay candidates of `one` after all incremental comparisons."""
    live = np.arange(len(rest))
    matches = np.zeros(len(rest), np.int64)
    for a in range(0, len(one), STEP):
        b = min(a + STEP, len(one))
        matches = matches + (rest[live, a:b] == one[a:b]).sum(axis=1)
        ok = matches >= least[b]
        live, matches = live[ok], matches[ok]
        if not len(live):
            break
    return live


def bucket_groups(sig: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row of a bucket the number of the first row of its group, following candidate pairs; each row is compared with those not yet reached."""
    root = np.arange(len(sig))
    left = np.arange(len(sig))
    while len(left):
        head, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            hit = candidates(sig[queue.pop()], sig[left], least)
            found = left[hit]
            root[found] = head
            queue += found.tolist()
            left = np.delete(left, hit)
    return root


def exact_links(grams: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of gram sets have a Jaccard similarity of threshold or more (a set with itself: no)."""
    n = len(grams)
    size = np.fromiter(map(len, grams), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    _, code, seen = np.unique(np.concatenate(grams) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    often = seen > 1
    col = np.cumsum(often) - 1
    use = often[code]
    doc, col = doc[use], col[code[use]]
    both = np.zeros((n, n))
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[doc[lo:hi], col[lo:hi] - a] = 1
        both += m @ m.T
    out = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    out &= (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(out, False)
    return out


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v) between whole numbers: columns node, root (the least node). Alternating large and small stars, each round written to the shared folder and the one before deleted. No node's neighbours are ever gathered: only their minimum is taken, by partial aggregation."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialize(e, f"{name}-edges")
    state = None
    for i in range(most_rounds):
        total = 2 * e.count()
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))
        big = spread_join(both.filter("v > u"), least, "u", "c", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours go to the least of these
        low = big.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = spread_join(big, low, "u", "c", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialize(small, f"{name}-round{i}")
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(batches, keys: int):
    """From sorted batches: the rows of one key after the other, as (key, list of rows)."""
    key, rows = None, []
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                if row[:keys] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[:keys], []
                rows.append(row[keys:])
        pa.default_memory_pool().release_unused()
    if rows:
        yield key, rows


def row_keys(id_col: str, text_col: str) -> list:
    """k1, k2: together 128 bits of the id and the text, which tell the rows apart."""
    return [F.xxhash64(F.lit(1), id_col, text_col).alias("k1"), F.xxhash64(F.lit(2), text_col, id_col).alias("k2")]


def gram_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, k1, k2 (the row's key), g (the gram set's 128-bit hash; null if there are no grams), sig."""
    size = BANDS * ROWS
    schema = T.StructType([docs.select(F.col(id_col).alias("id")).schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("g", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 3, BATCH_CHARS):
                grams, n = grams_of(texts)
                ends = np.cumsum(n)
                raw = grams.tobytes()
                sets = [xxhash.xxh3_128_digest(raw[8 * (e - k) : 8 * e]) if k else None for e, k in zip(ends.tolist(), n.tolist())]
                sig = iter(signatures(grams, n, size)) if len(grams) else iter(())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary()), pa.array([next(sig).tobytes() if k else None for k in n.tolist()], pa.binary())], names=["id", "k1", "k2", "g", "sig"])

    return docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def candidate_groups(reps: DataFrame) -> DataFrame:
    """node, root: groups of gram sets that surviving candidate pairs connect. reps: n, sig."""
    size = BANDS * ROWS
    least = least_matches(size)
    width = 2 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))).alias("key"))))
    keys = reps.select("n", band.alias("x")).select("n", "x.key")
    busy = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = keys.join(busy, "key").join(reps.select("n", "sig"), "n")
    spread = dealt(met, "c", "n", BUCKET_BLOCK)

    def run(batches):
        for _, rows in _grouped(batches, 3):
            g = [r[0] for r in rows]
            sig = np.frombuffer(b"".join([r[1] for r in rows]), np.uint16).reshape(-1, size)
            root = bucket_groups(sig, least)
            at = np.flatnonzero(root != np.arange(len(root))).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for i in at], pa.int64()), pa.array([g[root[i]] for i in at], pa.int64())], names=["u", "v"])

    units = spread.select("key", "bi", "bj", "n", "sig").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return components(units.mapInArrow(run, "u long, v long"), "join-candidates")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, k1, k2, class_id, n_links."""
    sets = materialize(gram_sets(docs, id_col, text_col), "join-sets")
    reps = materialize(sets.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2")).alias("at"), F.min("sig").alias("sig")).withColumn("n", F.monotonically_increasing_id()), "join-reps")
    total = sets.count()
    groups = candidate_groups(reps.select("n", "sig"))
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    members = spread_join(groups, sizes, "root", "c", total).join(reps.select(F.col("n").alias("node"), "copies", "at"), "node")
    members = members.select("root", "c", "node", "copies", "at.k1", "at.k2")
    keyed = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))
    spread = dealt(members.join(keyed, ["k1", "k2"]), "c", "node", GROUP_BLOCK)
    units = spread.select("root", "bi", "bj", "node", "copies", "own", (F.col("c") > GROUP_BLOCK).alias("split"), "text").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "node")

    def run(batches):
        for (_, bi, bj), rows in _grouped(batches, 3):
            kept, last = [], None
            for r in rows:  # equal rows of the documents come twice
                if r[0] != last:
                    kept.append(r)
                last = r[0]
            node = [r[0] for r in kept]
            copies, own = np.array([r[1] for r in kept]), np.array([r[2] for r in kept])
            grams = []
            texts = [r[4] or "" for r in kept]
            for a, b in by_chars(texts, BATCH_CHARS):
                h, n = grams_of(texts[a:b])
                grams += np.split(h, np.cumsum(n)[:-1])
            link = exact_links(grams, threshold)
            root = _local_roots(link)
            if bi != bj:  # pairs inside a block are counted where it meets itself
                link &= own[:, None] != own[None, :]
            links = link @ copies
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([node[i] for i in root], pa.int64()), pa.array(links, pa.int64()), pa.array([r[3] for r in kept], pa.bool_())], names=["u", "v", "links", "split"])

    found = materialize(units.mapInArrow(run, "u long, v long, links long, split boolean"), "join-links")
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    whole = found.filter("not split").select(F.col("u").alias("node"), F.col("v").alias("root"))
    parts = found.filter("split and u <> v").select("u", "v")
    if not parts.isEmpty():
        joined = components(parts, "join-parts")
        whole = whole.union(joined)
    roots = links.join(whole.withColumnRenamed("node", "u"), "u", "left").select(F.col("u").alias("n"), F.coalesce("root", "u").alias("root"), "links")
    of_sets = reps.select("g", "n", "copies").join(roots, "n", "left")
    placed = spread_join(sets.select("id", "k1", "k2", "g"), of_sets, "g", "copies", total, "left")
    # texts without grams: each a class of its own
    placed = placed.select("id", "k1", "k2", F.coalesce("root", "n").alias("root"), F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"))
    placed = materialize(placed, "join-placed")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    return spread_join(placed, least, "root", "c", total, "left").select("id", "k1", "k2", "root", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def _local_roots(link: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    root = np.arange(len(link))
    left = np.ones(len(link), bool)
    for i in range(len(link)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            found = np.flatnonzero(link[queue.pop()] & left)
            left[found] = False
            root[found] = i
            queue += found.tolist()
    return root


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each class the row with the least id stays (null last; ties by hash of the text, then one of equal rows). Texts without grams all stay, also null ones. An empty table gives an empty table; the columns stay as they are, whatever their names."""
    found = materialize(near_duplicates(docs, id_col, text_col), "join-classes")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("k2"), F.col("k1"))
    kept = found.filter("root is not null").groupBy("root").agg(F.min(order).alias("x")).select("x.k1", "x.k2")
    rows = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("root").isNull()).alias("bare"))
    rows = rows.join(kept.withColumn("first", F.lit(True)), ["k1", "k2"], "left").filter("bare or first")
    mark = fresh(docs.columns, "_join")
    marks = rows.select(*(F.col(c).alias(f"{mark}_{n}") for c, n in (("k1", "k1"), ("k2", "k2"), ("bare", "bare"))), (F.col("c") > 1).alias(f"{mark}_many"))
    own = row_keys(id_col, text_col)
    joined = docs.withColumns({f"{mark}_a": own[0], f"{mark}_b": own[1]}).join(marks, (F.col(f"{mark}_a") == F.col(f"{mark}_k1")) & (F.col(f"{mark}_b") == F.col(f"{mark}_k2")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    again = F.col(f"{mark}_many") & ~F.col(f"{mark}_bare")
    return joined.filter(~again).select(*cols).unionByName(joined.filter(again).dropDuplicates([f"{mark}_a", f"{mark}_b"]).select(*cols))

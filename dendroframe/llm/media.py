"""Media columns: cropped or edited copies of images, found by local descriptors.

All corners of the whole image are taken, at full size and at every halving of it that is large enough for a patch; each gets an orientation (its patch's intensity centroid) and 256 binary brightness tests
turned by it. Images that share a descriptor come together. So do images of different descriptors that are near: tables keyed by
eleven 24-bit parts bring these together (two that differ in up to 9 bits share a part; a pair of images has many), and those at
most 24 bits apart count as near. Two images meet that hold near descriptors; where a group of near descriptors has more than
EDGES pairs a member, all images of the group meet (else its pairs would grow with the square of its copies). Whether two images are linked is decided by geometry: matches (mutually nearest, 24 bits apart
at most) must agree on one shift, turn and scale, MIN_INLIERS of them at least.

Images with equal pixels form a class of which one goes on, under a number of its own; equal descriptors are keyed once, however
many images hold them. A key is 28 bits, so the keys that occur again fit a bitmap of fixed size (23 MB), which is broadcast; only
descriptors under such keys move. Buckets and groups of any size are dealt out as pairs of blocks; rows that leave a task grow
with its images, not with their pairs.

Defined results: null, empty or undecodable media, and images without corners, have no links except to media of equal bytes
(null: none) and, unless such exist, a class of their own; class_id is the least id of the class; n_links counts all other
rows that are linked, equal ones included; repeated rows are media of their own; an empty table gives an empty result. PNG (8
bits, not interlaced), PGM and PPM are read; anything else, also a broken header or a PNG that does not inflate to exactly the size
its header states, counts as undecodable. Only id and media are used. An image is whole in one task, some 100 bytes a pixel, and
its corners (all of them, at places of up to 32 bits) as well; a PNG is never inflated beyond its stated size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, discard, materialize, spread_join
from .ngram_join import _grouped, _local_roots, components

BITS, PART_BYTES = 256, 3
#: First bytes of the keyed parts: together they hold all bits. Two descriptors with 24 of 256 bits apart, evenly spread, share a part in about 62 % of cases, so six such matches bring their images together in more than 99 %.
STARTS = (0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 29)
MATCH_BITS, MIN_INLIERS, TOLERANCE_PX = 24, 6, 3.0
RADIUS, TURNS = 8, 30
#: Pixels whose corners are sought at once (one image at least), and corners that are described at once.
PIXELS, DESCRIBED = 1_100_000, 20_000
BUCKET_BLOCK, GROUP_BLOCK = 128, 128
#: Rows of a block of descriptors of one bucket. Larger buckets are dealt out as pairs of blocks, under the same rule.
COMPARED = 4096
#: Rows of an Arrow batch that are Python objects at a time, and all keys there are: 24 bits of each part.
KEYED, KEYS = 4096, len(STARTS) << (8 * PART_BYTES)
#: Spark's setting that removes a query's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Times that all images may be on disk at once, as rows of the units where they meet.
HELD = 4
#: Pairs of descriptors that are compared at once.
PAIRS = 1_000_000
#: Near pairs per member of a group of near descriptors up to which each pair is told by itself; images that meet one image in a task.
EDGES, STAR = 64, 256
#: Pairs of corners, or of matches, that are held at once.
CELLS = 1_000_000
#: One corner, packed: x and y in pixels of its own scale, log2 of that scale, angle in 256ths of a turn, descriptor.
_ROW = np.dtype([("x", "<u4"), ("y", "<u4"), ("s", "u1"), ("a", "u1"), ("d", "<u8", (BITS // 64,))])
_HEAD = _ROW.itemsize - BITS // 8


def _numbers(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, log2 scale and angle (radians) as floats."""
    unit = np.exp2(rows["s"].astype(np.float32))
    return (rows["x"] + np.float32(0.5)) * unit, (rows["y"] + np.float32(0.5)) * unit, rows["s"].astype(np.float32), rows["a"] * np.float32(2 * np.pi / 256)


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values (rows x columns, 0 to 255) of a PNG, PGM or PPM; None if it can't be read."""
    try:
        if raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw and raw[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                head.append(int(raw[at:end]))
                at = end
            w, h, top = head
            n = 3 if raw[:2] == b"P6" else 1
            if top > 255 or not w or not h:
                return None
            x = np.frombuffer(raw, np.uint8, w * h * n, at + 1).reshape(h, w, n)
            return x.astype(np.float32).mean(axis=2)
    except (ValueError, IndexError, OverflowError, MemoryError, zlib.error):
        return None
    return None


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.float32).mean(axis=1)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if head is None or head[8] != 8 or head[12]:
        return None
    w, h, color = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[9]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if c is None or not w or not h:
        return None
    size = h * (1 + w * c)
    if size > 1032 * len(data):  # no stream of this length holds so much
        return None
    lines = np.frombuffer(zlib.decompressobj().decompress(data, size + 1), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    before = np.zeros(w * c, np.int32)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            for i in range(w * c):
                left, up, corner = (line[i - c] if i >= c else 0), before[i], (before[i - c] if i >= c else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[i] = (line[i] + guess) & 255
        out[y], before = line, line
    x = out.reshape(h, w, c).astype(np.float32)
    if color == 3:
        return None if palette is None else palette[out.reshape(h, w)]
    return x[..., : 3 if c >= 3 else 1].mean(axis=2)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r+1, edges repeated."""
    for axis in (1, 2):
        p = np.concatenate([x.take([0], axis)] * (r + 1) + [x] + [x.take([-1], axis)] * r, axis)
        c = np.cumsum(p, axis=axis, dtype=np.float64)
        n = x.shape[axis]
        x = ((c.take(range(2 * r + 1, 2 * r + 1 + n), axis) - c.take(range(n), axis)) / (2 * r + 1)).astype(np.float32)
    return x


@lru_cache(maxsize=1)
def _tests() -> np.ndarray:
    """The compared places of each turn: turns x bits x (y1, x1, y2, x2)."""
    rng = np.random.default_rng(17)
    p = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
    out = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])  # (y, x)
        out.append(np.rint(p @ turn.T).astype(int).reshape(BITS, 4))
    return np.stack(out)


def _described(smooth: np.ndarray, img: np.ndarray, ys: np.ndarray, xs: np.ndarray, scale: int) -> np.ndarray:
    """_ROW of corners at the given places of smoothed images."""
    h, w = smooth.shape[1:]
    span = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = (v.ravel() for v in np.meshgrid(span, span, indexing="ij"))
    disc = dy**2 + dx**2 <= RADIUS**2
    dy, dx = dy[disc], dx[disc]
    patch = smooth[img[:, None], np.clip(ys[:, None] + dy, 0, h - 1), np.clip(xs[:, None] + dx, 0, w - 1)]
    angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
    t = _tests()[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
    at = lambda k: smooth[img[:, None], np.clip(ys[:, None] + t[..., k], 0, h - 1), np.clip(xs[:, None] + t[..., k + 1], 0, w - 1)]
    rows = np.zeros(len(img), _ROW)
    rows["x"], rows["y"], rows["s"] = xs, ys, scale
    rows["a"] = np.rint(angle / (2 * np.pi) * 256).astype(int) % 256
    rows["d"] = np.packbits(at(0) < at(2), axis=1).view("<u8")
    return rows


def corners(images: np.ndarray) -> list[np.ndarray]:
    """The corners of images of one size, each as an array of _ROW. A response that is not above a hundredth of the image's largest does not count; ties go to the upper, then the left one."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    level, scale = images, 0
    while min(level.shape[1:]) >= 2 * RADIUS + 8:
        n, h, w = level.shape
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = RADIUS // 2 + 2
        inner = np.full_like(r, -1)
        inner[:, edge:-edge, edge:-edge] = r[:, edge:-edge, edge:-edge]
        top = inner.copy()
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    np.maximum(top, np.roll(inner, (dy, dx), (1, 2)), out=top)
        best = inner.max(axis=(1, 2), keepdims=True)
        peak = (inner == top) & (inner > 0.01 * best) & (inner > 1e-3)
        img, ys, xs = np.nonzero(peak)
        order = np.lexsort((xs, ys, -inner[img, ys, xs], img))
        img, ys, xs = img[order], ys[order], xs[order]
        rows = np.concatenate([_described(smooth, img[a : a + DESCRIBED], ys[a : a + DESCRIBED], xs[a : a + DESCRIBED], scale) for a in range(0, len(img), DESCRIBED)] or [np.zeros(0, _ROW)])
        for i, part in zip(*np.unique(img, return_index=True)):
            found[i].append(rows[part : np.searchsorted(img, i, side="right")])
        h2, w2 = h // 2 * 2, w // 2 * 2
        level, scale = level[:, :h2, :w2].reshape(n, h2 // 2, 2, w2 // 2, 2).mean(axis=(2, 4)), scale + 1
    return [np.concatenate(f) if f else np.zeros(0, _ROW) for f in found]


def _mutual(one: np.ndarray, pad: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each image and each of one's corners the nearest of its corners, and whether that is a match (mutually nearest and near enough)."""
    n, most = len(one), pad.shape[1]
    near, least = np.zeros((len(pad), n), int), np.zeros((len(pad), n), np.int16)
    back, best = np.zeros((len(pad), most), int), np.full((len(pad), most), 9999, np.int16)
    step = max(1, CELLS // (len(pad) * most))
    mine, theirs = np.ascontiguousarray(one["d"].T), np.ascontiguousarray(np.moveaxis(pad["d"], 2, 0))
    for a in range(0, n, step):
        far = np.zeros((len(pad), len(mine[0, a : a + step]), most), np.int16)
        for w, v in zip(mine, theirs):
            far += np.bitwise_count(w[None, a : a + step, None] ^ v[:, None, :])
        far = np.where(real[:, None, :], far, 999)  # images x one's corners x theirs
        near[:, a : a + step], least[:, a : a + step] = far.argmin(axis=2), far.min(axis=2)
        low = far.min(axis=1)
        back = np.where(low < best, far.argmin(axis=1) + a, back)
        best = np.minimum(low, best)
    return near, (least <= MATCH_BITS) & (np.take_along_axis(back, near, 1) == np.arange(n))


def _agreeing(frm: tuple[np.ndarray, ...], to: tuple[np.ndarray, ...], ok: np.ndarray, enough: int | None) -> np.ndarray:
    """The most matches (images x matches) that one of them, taken as the shift, turn and scale, explains; errors are allowed by distances in the first frame. Where one explains `enough`, others need not be tried."""
    (ox, oy, osc, oa), (bx, by, bs, ba) = frm, to
    ds, da = bs - osc, ba - oa
    f = np.exp2(ds)
    c, s = (f * g(da) for g in (np.cos, np.sin))
    out, rows, a = np.zeros(len(ok), int), np.arange(len(ok)), 0
    while a < ok.shape[1] and len(rows):
        step = max(1, CELLS // max(1, ok.size))
        at = slice(a, a + (min(step, 4) if enough and not a else step))
        vx, vy = ox[:, None, :] - ox[:, at, None], oy[:, None, :] - oy[:, at, None]  # from hypothesis l to match k
        px = bx[:, at, None] + c[:, at, None] * vx - s[:, at, None] * vy
        py = by[:, at, None] + s[:, at, None] * vx + c[:, at, None] * vy
        room = TOLERANCE_PX + 0.08 * np.hypot(vx, vy)  # an angle is known to a few degrees only
        turn = np.abs((da[:, at, None] - da[:, None, :] + np.pi) % (2 * np.pi) - np.pi)
        fits = (np.hypot(px - bx[:, None, :], py - by[:, None, :]) <= room) & (turn <= np.pi / 9) & (np.abs(ds[:, at, None] - ds[:, None, :]) < 0.5)
        out[rows] = np.maximum(out[rows], (fits & ok[:, at, None] & ok[:, None, :]).sum(axis=2).max(axis=1, initial=0))
        a = at.stop
        if enough and (done := out[rows] >= enough).any():
            rows = rows[~done]
            ox, oy, bx, by, ds, da, c, s, ok = (x[~done] for x in (ox, oy, bx, by, ds, da, c, s, ok))
    return out


def _enough(one: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """Which of `rest` have MIN_INLIERS corners near to ones of `one`, and the other way round; fewer cannot have so many matches."""
    n, of = len(one), np.repeat(np.arange(len(rest)), [len(r) for r in rest])
    mine, theirs = (np.ascontiguousarray(d.T) for d in (one["d"], np.concatenate([r["d"] for r in rest])))
    step, pairs, found = max(1, CELLS // n), [], []
    for a in range(0, len(of), step):
        far = np.bitwise_count(mine[0][:, None] ^ theirs[0][None, a : a + step])
        i, j = np.nonzero(far <= MATCH_BITS)  # few are left after 64 bits
        far, j = far[i, j], j + a
        for k in range(1, BITS // 64):
            far = far + np.bitwise_count(mine[k][i] ^ theirs[k][j])
            near = far <= MATCH_BITS
            i, j, far = i[near], j[near], far[near]
        pairs.append(of[j] * n + i)
        found.append(np.unique(j))
    count = lambda x: np.bincount(x, minlength=len(rest)) >= MIN_INLIERS
    return np.flatnonzero(count(np.unique(np.concatenate(pairs)) // n) & count(of[np.concatenate(found)])) if pairs else np.zeros(0, int)


def consensus(one: np.ndarray, rest: list[np.ndarray], enough: int | None = None) -> np.ndarray:
    """For each of `rest` the most matches with `one` that agree on a shift, turn and scale, seen from either image: the same for both orders. 0 for images of fewer than MIN_INLIERS matches. With `enough`, numbers from there on may be too low."""
    out = np.zeros(len(rest), int)
    if len(one) and rest and len(rows := _enough(one, rest)):
        out[rows] = _consensus(one, [rest[i] for i in rows], enough)
    return out


def linked(one: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """Which of `rest` are linked to `one`."""
    return consensus(one, rest, MIN_INLIERS) >= MIN_INLIERS


def _consensus(one: np.ndarray, rest: list[np.ndarray], enough: int | None) -> np.ndarray:
    out = np.zeros(len(rest), int)
    most = max(map(len, rest))
    step = max(1, CELLS // (len(one) * most))
    if step < len(rest):
        return np.concatenate([_consensus(one, rest[a : a + step], enough) for a in range(0, len(rest), step)])
    pad = np.zeros((len(rest), most), _ROW)
    real = np.zeros((len(rest), most), bool)
    for i, r in enumerate(rest):
        pad[i, : len(r)] = r
        real[i, : len(r)] = True
    near, ok = _mutual(one, pad, real)
    rows = np.flatnonzero(ok.sum(axis=1) >= MIN_INLIERS)
    if not len(rows):
        return out
    near, ok = near[rows], ok[rows]
    held = np.argsort(~ok, axis=1, kind="stable")[:, : ok.sum(axis=1).max()]  # matches only
    ok = np.take_along_axis(ok, held, 1)
    mine, theirs = _numbers(one[held]), _numbers(np.take_along_axis(pad[rows], np.take_along_axis(near, held, 1), 1))
    out[rows] = found = _agreeing(mine, theirs, ok, enough)
    left = np.flatnonzero(found < enough) if enough else np.arange(len(rows))
    out[rows[left]] = np.maximum(found[left], _agreeing(tuple(x[left] for x in theirs), tuple(x[left] for x in mine), ok[left], enough))
    return out


def describe(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, g (128 bits of the pixels; of the bytes where they can't be read; null for null), points (the corners, packed)."""
    schema = T.StructType([media.select(F.col(id_col).alias("id")).schema["id"], T.StructField("g", T.BinaryType()), T.StructField("points", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                digest, points, shapes, held = [], [b""] * part.num_rows, {}, 0

                def flush():
                    for some in shapes.values():
                        for (i, _), rows in zip(some, corners(np.stack([x for _, x in some]))):
                            points[i] = rows.tobytes()
                    shapes.clear()

                for i, raw in enumerate(part.column(1)):
                    raw = raw.as_py()
                    img = decode(raw)
                    if img is None:
                        digest.append(None if raw is None else b"?" + hashlib.blake2b(raw, digest_size=15).digest())
                        continue
                    digest.append(hashlib.blake2b(f"{img.shape}".encode() + img.tobytes(), digest_size=16).digest())
                    if held + img.size > PIXELS:
                        flush()
                        held = 0
                    shapes.setdefault(img.shape, []).append((i, img))
                    held += img.size
                flush()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(points, pa.binary())], names=["id", "g", "points"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _ROW)


def _words(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint64).reshape(-1, BITS // 64)


def _binary(words: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(BITS // 8), len(words), [None, pa.py_buffer(np.ascontiguousarray(words).tobytes())]).cast(pa.binary())


def _keyed(words: np.ndarray, parts: range = range(len(STARTS))) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the given parts of some descriptors, and which descriptor each belongs to; a key is the part's number and its bits."""
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), BITS // 8).astype(np.int64)
    keys = [(part << 24) | raw[:, s] << 16 | raw[:, s + 1] << 8 | raw[:, s + 2] for part in parts for s in STARTS[part : part + 1]]
    return np.concatenate(keys), np.tile(np.arange(len(words)), len(parts))


def _slices(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, KEYED):
            yield batch.slice(a, KEYED)
        pa.default_memory_pool().release_unused()


def _numbers_of(words: np.ndarray) -> np.ndarray:
    """64 bits of each descriptor, which stand for it. Two that shared them would only be candidates together."""
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _held(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dn, n): the numbers of the descriptors that each image (n) holds; (dn, d, only): each descriptor once, with the image that alone holds it (-1: several do)."""

    def of_images(batches):
        for part in _slices(batches):
            rows = [_numbers_of(np.unique(_unpack(p)["d"], axis=0)) for p in part.column(1).to_pylist()]
            image = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(image)], names=["dn", "n"])

    def of_words(batches):
        for part in _slices(batches):
            points = [_unpack(p)["d"] for p in part.column(1).to_pylist()]
            words, of = np.unique(np.concatenate(points), axis=0, return_inverse=True)
            image = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(p) for p in points])
            lo, hi = np.full(len(words), np.iinfo(np.int64).max), np.full(len(words), -1)
            np.minimum.at(lo, of.ravel(), image)
            np.maximum.at(hi, of.ravel(), image)
            yield pa.RecordBatch.from_arrays([pa.array(_numbers_of(words)), _binary(words), pa.array(lo), pa.array(hi)], names=["dn", "d", "lo", "hi"])

    held = materialize(reps.mapInArrow(of_images, "dn long, n long"), "media-held")
    words = reps.mapInArrow(of_words, "dn long, d binary, lo long, hi long").groupBy("dn").agg(F.first("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return held, materialize(words.select("dn", "d", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(-1)).alias("only")), "media-words")


def _again(words: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Of descriptors (dn, d): a bit for each of all KEYS, whether it occurs more than once (of fixed size, whatever the table's: 23 MB); and those keys (key, c) that occur more than COMPARED times."""

    def run(batches):
        for part in _slices(batches):
            key, n = np.unique(_keyed(_words(part.column(1).to_pylist()))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "c"])

    busy = materialize(words.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter("c > 1"), "media-busy")
    place = F.col("key") + 1  # Spark's buckets begin at 1
    bits = busy.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((KEYS >> 3) + 4096, np.uint8)
    for b, raw in bits.toLocalIterator():  # at most KEYS / 32768 rows of 4 KB
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(raw)] = np.frombuffer(raw, np.uint8)
    # written by itself, so that Spark sees how small it is: else all keys would be shuffled for its join
    large = materialize(busy.filter(F.col("c") > COMPARED), "media-large")
    discard(busy)
    return out, large


def _keys(words: DataFrame, parts: range = range(len(STARTS)), known: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, dn, d, only): descriptors (dn, d, only), once for each of the given parts whose bits occur again; (key, c): the keys of more than COMPARED descriptors. known: what _again() found, its bits broadcast."""
    if known is None:
        again, large = _again(words)
        known = words.sparkSession.sparkContext.broadcast(again), large
    held, large = known

    def run(batches):
        bits = held.value
        for part in _slices(batches):
            own = _words(part.column(1).to_pylist())
            key, of = _keyed(own, parts)
            use = np.flatnonzero((bits[key >> 3] >> (key & 7).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), part.column(0).take(pa.array(of[use])), _binary(own[of[use]]), part.column(2).take(pa.array(of[use]))], names=["key", "dn", "d", "only"])

    return words.mapInArrow(run, "key long, dn long, d binary, only long"), large


def _near_pairs(bits: np.ndarray, key: np.ndarray):
    """Pairs of rows (a, b) of one key, at most MATCH_BITS apart; rows of one key stand together."""
    n = len(key)
    own = np.ascontiguousarray(bits.T)
    more = np.searchsorted(key, key, side="right") - np.arange(n) - 1 if n else key  # each row meets the later ones of its key
    sums = np.cumsum(more)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(sums, (sums[row - 1] if row else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(row, stop), more[row:stop])
        b = np.arange(len(a)) - np.repeat(np.cumsum(more[row:stop]) - more[row:stop], more[row:stop]) + a + 1
        far = np.zeros(len(a), np.uint8)
        for w in own:
            far = far + np.bitwise_count(w[a] ^ w[b])
            near = far <= MATCH_BITS
            a, b, far = a[near], b[near], far[near]
        yield a, b
        row = stop


def near_groups(bits: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor (a row of words; rows of one key stand together) the first row of its group (descriptors of its key at most MATCH_BITS apart, followed transitively) and how many are near to itself."""
    label, degree = np.arange(len(key)), np.zeros(len(key), int)
    for a, b in _near_pairs(bits, key):
        for x in (a, b):
            degree += np.bincount(x, minlength=len(key))
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label = up
    return label, degree


def near_rows(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return near_groups(bits, key)[0]


def near_told(bits: np.ndarray, key: np.ndarray, only: np.ndarray, edges: int = EDGES) -> tuple[np.ndarray, np.ndarray]:
    """Of descriptors and the images that alone hold them (-1: several do), rows of one key together: pairs of images (lesser first) that hold near ones; and lead and number of near descriptors that several images hold, or whose group has more than `edges` pairs a member."""
    dn = _numbers_of(bits)
    label, degree = near_groups(bits, key)
    dense = (np.bincount(label, degree, len(key)) > 2 * edges * np.bincount(label, minlength=len(key)))[label]
    images, groups = [np.zeros((2, 0), np.int64)], [np.stack([dn[label], dn])[:, dense]]
    rows = np.flatnonzero((degree > 0) & ~dense)
    rows = rows[np.argsort(label[rows], kind="stable")]
    for a, b in _near_pairs(bits[rows], label[rows]):
        a, b = rows[a], rows[b]
        alone = (only[a] >= 0) & (only[b] >= 0)
        x, y = only[a[alone]], only[b[alone]]
        images.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y], axis=1))
        a, b = a[~alone], b[~alone]
        groups.append(np.stack([dn[np.where(only[a] < 0, a, b)], dn[np.where(only[a] < 0, b, a)]]))
    groups = np.concatenate(groups, axis=1)
    return np.unique(np.concatenate(images, axis=1), axis=1), np.unique(groups[:, groups[0] != groups[1]], axis=1)


def _near_groups(batches, edges: int):
    """From rows (key, descriptor, only), sorted: what near_told() finds, as lead, dn and whether these are images."""

    def solve(key, bits, only):
        images, groups = near_told(bits, key, only, edges)
        both = np.concatenate([images, groups], axis=1)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in both), pa.array(np.arange(both.shape[1]) < images.shape[1])], names=["lead", "dn", "alone"])

    held = (np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64), np.zeros(0, np.int64))
    for batch in batches:
        new = (batch.column(0).to_numpy(zero_copy_only=False), _words(batch.column(1).to_pylist()), batch.column(2).to_numpy(zero_copy_only=False))
        held = tuple(np.concatenate(x) for x in zip(held, new))
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
        if whole:
            yield solve(*(x[:whole] for x in held))
            held = tuple(x[whole:] for x in held)
    if len(held[0]):
        yield solve(*held)


def _near(words: DataFrame) -> DataFrame:
    """lead, dn, alone: near_told() of all tables: pairs of images (alone), and groups of near descriptors. One table at a time, so that the shuffled descriptors of one table only are on disk."""
    spark = words.sparkSession
    again, large = _again(words)
    known = spark.sparkContext.broadcast(again), large
    tables, edges = [], EDGES
    for part in range(len(STARTS)):
        keys = _keys(words, range(part, part + 1), known)[0]
        met = dealt(keys.join(large, "key", "left").withColumn("c", F.coalesce("c", F.lit(1))), "c", "dn", COMPARED)
        unit = F.when(F.col("c") <= COMPARED, F.col("key")).otherwise(F.xxhash64("key", "bi", "bj")).alias("unit")
        met = met.select(unit, "d", "only").repartition("unit").sortWithinPartitions("unit", "d")
        tables.append(materialize(met.mapInArrow(lambda batches: _near_groups(batches, edges), "lead long, dn long, alone boolean"), f"media-near{part}"))
    near = materialize(reduce(DataFrame.unionByName, tables).distinct(), "media-near")
    for t in (*tables, large):
        discard(t)
    return near


def _met(reps: DataFrame) -> DataFrame:
    """lead, n, star: for each image that leads a group of images with a common or near descriptors (it is the least of them), the group's images, itself included. star: the lead holds a descriptor near to one of each; else any two of the group may."""
    held, words = _held(reps)
    told = _near(words)
    discard(words)
    near = told.filter("not alone").drop("alone")
    # each descriptor stands for its images: the groups of near descriptors become groups of images
    of = held.groupBy("dn").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first"))
    whole = near.unionByName(near.select("lead").distinct().withColumn("dn", F.col("lead"))).join(of, "dn")
    least = whole.groupBy("lead").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("rows"))
    by = spread_join(whole.drop("first"), least, "lead", "rows", near.count()).select("dn", "first", "c")
    by = materialize(by.unionByName(of.filter("c > 1").select("dn", "first", "c")).distinct(), "media-leads")
    found = spread_join(held, by, "dn", "c", held.count())
    pairs = told.filter("alone").select("lead", F.col("dn").alias("n"), F.lit(True).alias("star"))
    pairs = pairs.unionByName(pairs.select("lead", F.col("lead").alias("n"), "star").distinct())
    met = materialize(found.select(F.col("first").alias("lead"), "n", F.lit(False).alias("star")).distinct().unionByName(pairs), "media-met")
    for t in (held, told, by):
        discard(t)
    return met


def _in_slices(units: DataFrame, order: list[str], images: DataFrame, run: Callable, schema: str, name: str) -> DataFrame:
    """run over the rows of units (order, n and more), each with what images (n and more) hold of it; a unit's rows stand together. An image is in many units, so units are gone through in slices, by hash: some HELD times the images are on disk at once, and the shuffle files of one slice are removed before the next."""
    slices = max(1, -(-units.count() // (HELD * max(1, images.count()))))
    tasks, out = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), []  # told, as Spark would join units by bytes, which say little about the work
    for k in range(slices):
        own = units.filter(F.pmod(F.xxhash64(F.lit(5), *order), F.lit(slices)) == k)
        own = own.join(images, "n").select(*units.columns, *images.columns[1:]).repartition(tasks, *order).sortWithinPartitions(*order, "n")
        out.append(materialize(own.mapInArrow(run, schema), f"{name}{k}"))
    return reduce(DataFrame.unionByName, out)


def linked_media(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per row of media: id, class_id, n_links, n_points."""
    conf = media.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")  # all steps but the last join are written: their shuffle files are of no more use
    try:
        return _linked(media, id_col, media_col)
    finally:
        conf.set(_CLEAN, before)


def _linked(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    described = materialize(describe(media, id_col, media_col), "media-points")
    reps = materialize(described.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("copies"), F.min("points").alias("points")).withColumn("n", F.monotonically_increasing_id()), "media-reps")
    all_rows = materialize(described.select("id", "g", F.floor(F.length("points") / _ROW.itemsize).alias("n_points")), "media-rows")
    discard(described)
    # Groups with the same least image are taken as one, so an image goes to few units, not once per descriptor.
    near = _met(reps.filter(F.length("points") > 0).select("n", "points"))
    counted = lambda df: spread_join(df, df.groupBy("lead").agg(F.count(F.lit(1)).alias("c")), "lead", "c", df.count())
    spread = dealt(counted(near.filter("not star")), "c", "n", BUCKET_BLOCK).select("lead", "bi", "bj", "n")
    # a star's images are dealt to parts of some STAR rows, the lead to each; bj -1 tells a star
    parts = F.ceil(F.col("c") / STAR).cast("int")
    of_star = F.when(F.col("n") == F.col("lead"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.lit(7), "n"), parts).cast("int")))
    stars = counted(near.filter("star")).select("lead", F.explode(of_star).alias("bi"), F.lit(-1).alias("bj"), "n")
    met = materialize(spread.unionByName(stars), "media-units")
    discard(near)

    def meet(batches):
        for (lead, _, bj), rows in _grouped(batches, 3):
            g, points = [r[0] for r in rows], [_unpack(r[1]) for r in rows]
            if bj < 0:  # n is sorted and the lead the least
                near = [x for x, k in zip(g[1:], linked(points[0], points[1:])) if k]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), pa.array([lead] * len(near), pa.int64())], names=["u", "v"])
                continue
            left, out = list(range(1, len(rows))), ([], [])
            root, queue = 0, [0]
            while left:
                if not queue:
                    root = left.pop(0)
                    queue = [root]
                    continue
                hit = linked(points[queue.pop()], [points[i] for i in left])
                for i, h in zip(left, hit):
                    if h:
                        out[0].append(g[i])
                        out[1].append(g[root])
                        queue.append(i)
                left = [i for i, h in zip(left, hit) if not h]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])

    edges = _in_slices(met, ["lead", "bi", "bj"], reps.select("n", "points"), meet, "u long, v long", "media-meet")
    discard(met)
    groups = components(edges, "media-candidates")
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    total = all_rows.count()
    spread = dealt(spread_join(groups, sizes, "root", "c", total), "c", "node", GROUP_BLOCK)
    members = materialize(spread.select("root", "bi", "bj", F.col("node").alias("n"), "own", (F.col("c") > GROUP_BLOCK).alias("split")), "media-members")

    def verify(batches):
        for (_, bi, bj), rows in _grouped(batches, 3):
            node, points = [r[0] for r in rows], [_unpack(r[3]) for r in rows]
            own, copies = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
            link = np.zeros((len(points), len(points)), bool)
            for i, p in enumerate(points):
                link[i, i + 1 :] = linked(p, points[i + 1 :])
            link |= link.T
            np.fill_diagonal(link, False)
            root = _local_roots(link)
            if bi != bj:
                link &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([node[i] for i in root], pa.int64()), pa.array(link @ copies, pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["u", "v", "links", "split"])

    found = _in_slices(members, ["root", "bi", "bj"], reps.select("n", "points", "copies"), verify, "u long, v long, links long, split boolean", "media-links")
    discard(members)
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    whole = found.filter("not split").select(F.col("u").alias("node"), F.col("v").alias("root"))
    parts = found.filter("split and u <> v").select("u", "v")
    if not parts.isEmpty():
        whole = whole.union(components(parts, "media-parts"))
    roots = links.join(whole.withColumnRenamed("node", "u"), "u", "left").select(F.col("u").alias("n"), F.coalesce("root", "u").alias("root"), "links")
    of_images = reps.select("g", "n", "copies").join(roots, "n", "left")
    placed = spread_join(all_rows, of_images, "g", "copies", total, "left")
    placed = materialize(placed.select("id", F.coalesce("root", "n").alias("root"), F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), "n_points"), "media-placed")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    return spread_join(placed, least, "root", "c", total, "left").select("id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", "n_points")


def render(vectors: DataFrame, id_col: str, vec_col: str, cell: int = 4, side: int = 16) -> DataFrame:
    """Stands in for a media column where a table has none: id and a PGM image of side x side grey cells, each showing the sum of two of the vector's numbers (null for an empty or null vector or one with a null or non-finite number)."""
    schema = T.StructType([vectors.select(F.col(id_col).alias("id")).schema["id"], T.StructField("media", T.BinaryType())])
    k = np.arange(side * side)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if e is None else e for e in v or []], float)
                if not len(x) or not np.isfinite(x).all():
                    out.append(None)
                    continue
                g = 128 + 300 * (x[k % len(x)] + x[(29 * k + 13 * (k // len(x)) + 7) % len(x)])
                img = np.kron(np.clip(np.rint(g), 0, 255).astype(np.uint8).reshape(side, side), np.ones((cell, cell), np.uint8))
                out.append(f"P5 {img.shape[1]} {img.shape[0]} 255\n".encode() + img.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, schema)

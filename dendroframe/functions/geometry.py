"""Scalar geometry as pure Column expressions; everything stays inside whole-stage code generation.

Nulls in any argument give null. Comparisons at edges are stated per function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def num(x: float) -> Column:
    return F.lit(float(x))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def minus(a, b) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def distance(a, b) -> Column:
    return norm(minus(a, b))


def cylinder_axis(s, e) -> tuple[Column, list[Column]]:
    """Length and unit vector of a cylinder's axis; the zero vector where it is shorter than 1e-8."""
    d = minus(e, s)
    length = norm(d)
    safe = F.when(length < 1e-8, num(1)).otherwise(length)
    return length, [F.when(length < 1e-8, num(0)).otherwise(c / safe) for c in d]


def cylinder_terms(p, s, length: Column, u, r: Column, perp_tol: float = 1e-3) -> dict[str, Column]:
    """Distance of a point to a cylinder's surface, and the offset to its mantle, in closed form. length and u: its cylinder_axis, taken once per cylinder.

    With t the place along the axis, h what t exceeds the axis by, rho the distance from the axis there: the distance is
    |rho - r| where |h| <= perp_tol, else that to the cap or its rim. The offset always leads to the mantle. Cylinders
    shorter than 1e-8 are points with a radius.
    """
    v = minus(p, s)
    t = dot(v, u)
    tc = F.greatest(num(0), F.least(t, length))
    h = t - tc
    w = [v[i] - t * u[i] for i in range(3)]
    rho = norm(w)
    n = [c / F.greatest(rho, num(1e-8)) for c in w]
    over = F.greatest(rho - r, num(0))
    dist = F.when(F.abs(h) <= perp_tol, F.abs(rho - r)).otherwise(F.sqrt(h * h + over * over))
    offset = [s[i] + tc * u[i] + r * n[i] - p[i] for i in range(3)]
    return {"distance": dist, "ox": offset[0], "oy": offset[1], "oz": offset[2]}


def in_box(p, low, high) -> Column:
    """Closed on both ends."""
    out = F.lit(True)
    for c, a, b in zip(p, low, high):
        out = out & c.between(num(a), num(b))
    return out


def cylinder_in_box(s, e, low, high) -> Column:
    """Start or end lies in the closed box."""
    return in_box(s, low, high) | in_box(e, low, high)


def rotate_view(x: Column, y: Column, z: Column, cx: float, cy: float, view: str, degrees: float = 45.0) -> tuple[Column, Column]:
    """'z': (x, y); 'x': (y, z); 'y': turned about the vertical axis through (cx, cy), then (x', z)."""
    if view == "z":
        return x, y
    if view == "x":
        return y, z
    a = F.radians(num(degrees))
    return (x - cx) * F.cos(a) - (y - cy) * F.sin(a) + cx, z


def cylinder_quad(sx: Column, sy: Column, ex: Column, ey: Column, r: Column) -> Column:
    """The four corners of a cylinder's outline in the plane (start left, start right, end right, end left); null without length."""
    dx, dy = ex - sx, ey - sy
    n = F.hypot(dx, dy)
    px, py = -dy / n * r, dx / n * r
    corner = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    return F.when(n > 1e-12, F.array(corner(sx + px, sy + py), corner(sx - px, sy - py), corner(ex - px, ey - py), corner(ex + px, ey + py)))


def display_scale(v: Column) -> Column:
    """Piecewise display scale: 0-0.1 on 0-10, 0.1-1 on 10-20, 1-1.1 on 20-21, all beyond on 21."""
    return F.when(v <= 0.1, v * 100).when(v <= 1.0, 10 + (v - 0.1) / 0.9 * 10).when(v <= 1.1, 20 + (v - 1.0) * 10).otherwise(num(21))


def tick_label(v: Column) -> Column:
    return F.when(v <= 10, F.format_number(v / 100, 2)).when(v <= 20, F.format_number(0.1 + (v - 10) * 0.09, 2)).otherwise("inf")


def color_ramp(v: Column, low: Column, high: Column) -> Column:
    """Blue over green to red; the middle where low = high."""
    t = F.when(high > low, (v - low) / (high - low)).otherwise(num(0.5))
    t = F.greatest(num(0), F.least(num(1), t))
    return F.struct(F.when(t < 0.5, num(0)).otherwise(2 * t - 1).alias("red"), F.when(t < 0.5, 2 * t).otherwise(2 - 2 * t).alias("green"), F.when(t < 0.5, 1 - 2 * t).otherwise(num(0)).alias("blue"))


def cylinder_volume(r: Column, length: Column) -> Column:
    return F.pi() * r * r * length


def connection_distance(c1, c2, r1: Column, r2: Column) -> Column:
    return distance(c1, c2) - (r1 + r2)


def angle_between(u, v) -> Column:
    """Radians; the cosine is held in [-1, 1]. Null where a vector has no length."""
    n = norm(u) * norm(v)
    return F.when(n > 0, F.acos(F.least(num(1), F.greatest(num(-1), dot(u, v) / n))))


def to_world(local, axis) -> list[Column]:
    """A point given beside the z axis, turned so that z becomes the unit vector `axis` (Rodrigues' formula)."""
    ax, ay, az = axis
    x, y, z = local
    k = 1 / (1 + az)
    flip = az < -1 + 1e-12
    return [
        F.when(flip, x).otherwise(x * (1 - ax * ax * k) - y * ax * ay * k + z * ax),
        F.when(flip, -y).otherwise(-x * ax * ay * k + y * (1 - ay * ay * k) + z * ay),
        F.when(flip, -z).otherwise(-x * ax - y * ay + z * az),
    ]


def keep_digits(name: Column) -> Column:
    """Everything but digits and underscores goes."""
    return F.regexp_replace(name, "[^0-9_]", "")


def tree_key(name: Column) -> Column:
    """The first two parts between underscores."""
    return F.substring_index(name, "_", 2)


def morton(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """Z-order code of non-negative cell numbers: bit i of x at 3i+2, of y at 3i+1, of z at 3i."""
    spread = lambda c: _spread3(c.cast("long").bitwiseAND(F.lit((1 << depth) - 1).cast("long")))
    return F.shiftleft(spread(x), 2).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(spread(z))


_MASKS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread3(v: Column) -> Column:
    """Two empty bits after each bit, by the usual halving masks."""
    for shift, mask in _MASKS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _gather3(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_MASKS[-1][1]).cast("long"))
    for (shift, _), mask in zip(reversed(_MASKS), [m for _, m in reversed(_MASKS[:-1])] + [0x1FFFFF]):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton_decode(code: Column) -> tuple[Column, Column, Column]:
    return _gather3(F.shiftrightunsigned(code, 2)), _gather3(F.shiftrightunsigned(code, 1)), _gather3(code)


def with_eigenvalues(df: DataFrame, c: tuple[str, ...] = ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")) -> DataFrame:
    """Adds l0 >= l1 >= l2, the eigenvalues of a symmetric 3 x 3 matrix, by the trigonometric form. Each step is a projection of its own, so no expression is written out more than once."""
    xx, yy, zz, xy, xz, yz = (F.col(k) for k in c)
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    a, b, d = xx - F.col("_q"), yy - F.col("_q"), zz - F.col("_q")
    df = df.withColumn("_p", F.sqrt((a * a + b * b + d * d + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    df = df.withColumn("_h", F.when(F.col("_p") > 0, det / (F.col("_p") * F.col("_p") * F.col("_p")) / 2).otherwise(num(0)))
    df = df.withColumn("_f", F.acos(F.least(num(1), F.greatest(num(-1), F.col("_h")))) / 3)
    df = df.withColumns({"l0": F.col("_q") + 2 * F.col("_p") * F.cos("_f"), "l2": F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_f") + 2 * F.pi() / 3)})
    return df.withColumn("l1", 3 * F.col("_q") - F.col("l0") - F.col("l2")).drop("_q", "_p", "_h", "_f")


def with_smallest_axis(df: DataFrame, c: tuple[str, ...] = ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")) -> DataFrame:
    """Adds nx, ny, nz to with_eigenvalues: the unit eigenvector of l2, as the longest cross product of two rows of (C - l2 I). Its sign is arbitrary; null for multiples of the unit matrix."""
    xx, yy, zz, xy, xz, yz = (F.col(k) for k in c)
    lam = F.col("l2")
    rows = ([xx - lam, xy, xz], [xy, yy - lam, yz], [xz, yz, zz - lam])
    ways = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    df = df.withColumns({f"_w{i}{j}": w[j] for i, w in enumerate(ways) for j in range(3)})
    df = df.withColumns({f"_n{i}": norm([F.col(f"_w{i}{j}") for j in range(3)]) for i in range(3)})
    df = df.withColumn("_k", F.when((F.col("_n0") >= F.col("_n1")) & (F.col("_n0") >= F.col("_n2")), 0).when(F.col("_n1") >= F.col("_n2"), 1).otherwise(2))
    pick = lambda j: F.when(F.col("_k") == 0, F.col(f"_w0{j}") / F.col("_n0")).when(F.col("_k") == 1, F.col(f"_w1{j}") / F.col("_n1")).otherwise(F.col(f"_w2{j}") / F.col("_n2"))
    some = F.greatest("_n0", "_n1", "_n2") > 0
    df = df.withColumns({k: F.when(some, pick(j)) for j, k in enumerate(("nx", "ny", "nz"))})
    return df.drop("_k", *(f"_n{i}" for i in range(3)), *(f"_w{i}{j}" for i in range(3) for j in range(3)))

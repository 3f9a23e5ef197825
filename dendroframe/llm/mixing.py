"""Mixing sources to target weights, in DataFrame functions only.

Sources form a tree: domain, language, source. A token budget goes down the tree by weight. What a child can't supply
(its tokens times the epochs allowed) goes to its siblings by their weights first; only what a whole subtree can't supply
goes to the siblings of its ancestor. Each leaf then takes whole epochs and, of one more, the prefix of its documents in
that epoch's seeded order that fits what is left of its budget.

All amounts are whole numbers; shares are rounded down. Order in an epoch: md5 of 'seed:epoch:doc_id' (documents of one id
stand together: all or none). Defined results: null domain, language or source is the node 'none'; a null doc_id orders as
''; a null or blank text has 0 tokens and comes with any prefix that reaches it; nodes without a given weight weigh 1; weights
are at least 1; an empty table gives an empty result; repeated rows are documents of their own; a text of any length is only
counted. Other columns are kept, whatever their names, except that they give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

TREE = ("domain", "lang", "source")
#: Hexadecimal digits of the order that each refinement of a leaf's cut looks at: 256 ranges of a leaf at once.
DIGITS = 2
REFINEMENTS = 3


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The sources' domain in the synthetic corpus: the number in the source's name modulo 4."""
    digits = F.regexp_extract(source, "([0-9]{1,9})", 1)
    return F.when(digits == "", "other").otherwise(F.concat(F.lit("d"), (digits.cast("long") % 4).cast("string")))


def _weight(path: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        if int(w) != w or w < 1:
            raise ValueError("weights are whole numbers from 1")
        out = F.when(path == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares each parent's budget among its children: columns parent..., name, weight, capacity, budget (the parent's) give column share.

    In order of capacity/weight, a child whose capacity is at most its part of what is left takes its capacity; the others
    take their parts of the rest, rounded down. So a shortage goes to the siblings, by weight.
    """
    big = "decimal(38,0)"
    order = [(F.col("capacity") / F.col("weight")).asc(), F.col(name).asc()]
    w = Window.partitionBy(*parent)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest_b = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rest_w = F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    x = children.withColumns({"rest_b": rest_b.cast("long"), "rest_w": rest_w.cast("long")})
    x = x.withColumn("full", (F.col("capacity").cast(big) * F.col("rest_w") <= F.col("rest_b").cast(big) * F.col("weight")))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(w)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w)
    part = F.expr("cast((cast(left_b as decimal(28,0)) * weight) div open_w as bigint)")
    return x.withColumns({"left_b": left.cast("long"), "open_w": open_w.cast("long")}).withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("rest_b", "rest_w", "full", "left_b", "open_w")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], num: int, den: int, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds share (the leaf's budget), epochs (whole ones) and rest (tokens for the prefix of the next)."""
    d, l, s = TREE
    leaves = leaves.withColumns({"capacity": F.col("tokens") * max_epochs})
    node = lambda keys, by: leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(F.col(keys[-1]), weights.get(by, {})))
    top = node([d], d)
    every = Window.partitionBy()
    total = F.sum("tokens").over(every)
    top = top.withColumn("budget", F.least(F.expr(f"cast((cast(sum(tokens) over () as decimal(28,0)) * {int(num)}) div {int(den)} as bigint)"), total * max_epochs))
    top = fill(top.withColumn("root", F.lit(0)), ["root"], d).select(d, F.col("share").alias("budget"))
    mid = fill(node([d, l], l).join(top, d), [d], l).select(d, l, F.col("share").alias("budget"))
    low = fill(node([d, l, s], s).join(mid, [d, l]), [d, l], s)
    t = F.greatest(F.col("tokens"), F.lit(1))
    return low.select(d, l, s, "tokens", F.col("share"), F.expr("share div greatest(tokens, 1)").alias("epochs"), (F.col("share") % t).alias("rest"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], num: int = 1, den: int = 2, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", prefix: str = "mix_") -> DataFrame:
    """The documents that the mixture takes, with columns mix_tokens, mix_copies (in how many epochs, 1 or more) and mix_domain.

    The budget is num/den of all tokens. A leaf's prefix is found as a cut in its order: tokens are summed up over 256
    ranges of the order, then over 256 ranges of the range that holds the cut, and so on; no task ever sees a whole leaf.
    """
    none = lambda c: F.coalesce(c, F.lit("none"))
    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    mark = fresh(docs.columns, "_mix")
    own = docs.select("*", F.struct(none(domain).alias("domain"), none(F.col("lang")).alias("lang"), none(F.col("source")).alias("source"), count_tokens(F.col("text")).alias("n")).alias(mark))
    meta = materialize(own.select(f"{mark}.*", ids.alias("id")), "mix-meta")
    leaves = materialize(meta.groupBy(*TREE).agg(F.sum("n").alias("tokens")), "mix-leaves")
    plan = materialize(budgets(leaves, weights, num, den, max_epochs), "mix-budgets")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.col("id")))
    asked = plan.filter("rest > 0").select(*TREE, "epochs", F.col("rest").alias("room"), F.lit("").alias("cut"))
    keyed = meta.join(asked.select(*TREE, "epochs"), list(TREE)).select(*TREE, "n", order.alias("h"))
    keyed = materialize(keyed, "mix-order")
    cuts = asked.drop("epochs")
    w = Window.partitionBy(*TREE).orderBy("piece")
    for i in range(REFINEMENTS):
        # the documents of each leaf's open range, by their next digits
        inside = keyed.join(cuts, list(TREE)).filter(F.expr(f"substring(h, 1, {DIGITS * i})") == F.col("cut"))
        sums = inside.groupBy(*TREE, F.substring("h", DIGITS * i + 1, DIGITS).alias("piece")).agg(F.sum("n").alias("n"), F.first("room").alias("room"), F.first("cut").alias("cut"))
        sums = sums.withColumn("upto", F.sum("n").over(w))
        # the first range that doesn't fit whole; if all fit, the range after the last
        step = sums.groupBy(*TREE, "cut", "room").agg(F.min(F.when(F.col("upto") > F.col("room"), F.struct("piece", (F.col("room") - F.col("upto") + F.col("n")).alias("room")))).alias("at"))
        cuts = materialize(step.select(*TREE, F.concat("cut", F.coalesce("at.piece", F.lit("~"))).alias("cut"), F.coalesce("at.room", F.lit(0)).alias("room")), f"mix-cut{i}")
    # the last range, order by order: the documents of one id (they may be a third of all) are one row
    inside = keyed.join(cuts, list(TREE)).filter(F.expr(f"substring(h, 1, {DIGITS * REFINEMENTS})") == F.col("cut")).groupBy(*TREE, "room", "h").agg(F.sum("n").alias("n"))
    peers = Window.partitionBy(*TREE).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("n").over(peers)).filter(F.col("upto") <= F.col("room")).groupBy(*TREE).agg(F.max("h").alias("last"))
    cuts = cuts.join(last, list(TREE), "left").select(*TREE, F.coalesce("last", "cut").alias("cut"))
    plan = materialize(plan.join(cuts, list(TREE), "left").select(*(F.col(c).alias(f"{mark}_{c}") for c in TREE), F.col("epochs").alias(f"{mark}_e"), F.col("cut").alias(f"{mark}_cut"), F.col("rest").alias(f"{mark}_rest")), "mix-plan")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(f"{mark}_e") + 1).cast("string"), ids))
    # a cut that is a range's name stands before all that begins with it; documents without tokens come with the prefix
    more = F.when((F.col(f"{mark}_rest") > 0) & (h <= F.col(f"{mark}_cut")), 1).otherwise(0)
    on = [F.col(f"{mark}.{c}") == F.col(f"{mark}_{c}") for c in TREE]
    out = own.join(plan, on).withColumn(f"{mark}_copies", F.col(f"{mark}_e") + more).filter(F.col(f"{mark}_copies") > 0)
    names = [c for c in docs.columns if c not in (f"{prefix}domain", f"{prefix}tokens", f"{prefix}copies")]
    return out.select(*(F.col(f"`{c}`") for c in names), F.col(f"{mark}.domain").alias(f"{prefix}domain"), F.col(f"{mark}.n").alias(f"{prefix}tokens"), F.col(f"{mark}_copies").cast("long").alias(f"{prefix}copies"))

"""Positional operators between spans of one document: seven predicates, each as a semi join and as an anti join.

Two physical strategies give the same rows:

* sweep: both sides are sorted by position within their document, and one running minimum or maximum per document tells
  whether a partner exists.  Its cost grows with the sizes of the sides, never with their product, so two frequent
  words in a long document do no harm.  It covers all predicates whose partner is found by one coordinate.
* join: a semi or anti join on the document with the predicate as a residual, for the rest (upper bounds of INSIDE, which is
  joined on pages of positions too, bounded overlaps, a shared structure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.plans.parser import INF, POSITIONAL

SPAN = ("id", "document_id", "type", "p1", "p2", "index", "length", "value")


def overlap_count(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1)


def is_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (a1 <= b2) & (b1 <= a2)


def predicate(op: str, args: dict[str, int], a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether [a1, a2] stands to [b1, b2] as op says."""
    if op == "INSIDE":
        ns, ms, ne, me = (args.get(k, d) for k, d in (("ns", 0), ("ms", INF), ("ne", 0), ("me", INF)))
        return (a1 >= b1) & (a2 <= b2) & (a1 - b1).between(ns, ms) & (b2 - a2).between(ne, me)
    n, m = args.get("n", 0), args.get("m", INF)
    before = (a2 < b1) & (b1 - a2 - 1).between(n, m)
    after = (a1 > b2) & (a1 - b2 - 1).between(n, m)
    if op == "BEFORE":
        return before
    if op == "AFTER":
        return after
    if op == "NEAR":
        return before | after
    if op == "OVERLAPS":
        return is_overlap(a1, a2, b1, b2) & overlap_count(a1, a2, b1, b2).between(n, m)
    if op == "LALIGN":
        return (a1 >= b1) & (a1 - b1).between(n, m)
    if op == "RALIGN":
        return (a2 <= b2) & (b2 - a2).between(n, m)
    raise ValueError(f"no positional operator {op}")


def predicate_sql(op: str, args: dict[str, int], a: str = "a", b: str = "b") -> str:
    """The same in SQL, over rows a and b."""
    if op == "INSIDE":
        ns, ms, ne, me = (args.get(k, d) for k, d in (("ns", 0), ("ms", INF), ("ne", 0), ("me", INF)))
        return f"{a}.p1 >= {b}.p1 AND {a}.p2 <= {b}.p2 AND {a}.p1 - {b}.p1 BETWEEN {ns} AND {ms} AND {b}.p2 - {a}.p2 BETWEEN {ne} AND {me}"
    n, m = args.get("n", 0), args.get("m", INF)
    before = f"({a}.p2 < {b}.p1 AND {b}.p1 - {a}.p2 - 1 BETWEEN {n} AND {m})"
    after = f"({a}.p1 > {b}.p2 AND {a}.p1 - {b}.p2 - 1 BETWEEN {n} AND {m})"
    return {
        "BEFORE": before,
        "AFTER": after,
        "NEAR": f"({before} OR {after})",
        "OVERLAPS": f"({a}.p1 <= {b}.p2 AND {b}.p1 <= {a}.p2 AND least({a}.p2, {b}.p2) - greatest({a}.p1, {b}.p1) + 1 BETWEEN {n} AND {m})",
        "LALIGN": f"({a}.p1 >= {b}.p1 AND {a}.p1 - {b}.p1 BETWEEN {n} AND {m})",
        "RALIGN": f"({a}.p2 <= {b}.p2 AND {b}.p2 - {a}.p2 BETWEEN {n} AND {m})",
    }[op]


# Of a sweep: the partner's coordinate that is sorted, the left side's place among them, whether partners are looked for at
# or after that place (else at or before), the partner's coordinate that is kept, and the test on the best one.
def _sweeps(op: str, args: dict[str, int]) -> list[tuple[str, Column, bool, str, Column]] | None:
    p1, p2, best = F.col("p1").cast("bigint"), F.col("p2").cast("bigint"), F.col("__best")
    n, m = args.get("n", 0), args.get("m", INF)
    before = ("p1", p2 + 1 + n, True, "p1", best <= p2 + 1 + m)
    after = ("p2", p1 - 1 - n, False, "p2", best >= p1 - 1 - m)
    if op == "BEFORE":
        return [before]
    if op == "AFTER":
        return [after]
    if op == "NEAR":
        return [before, after]
    if op == "LALIGN":
        return [("p1", p1 - n, False, "p1", best >= p1 - m)]
    if op == "RALIGN":
        return [("p2", p2 + n, True, "p2", best <= p2 + m)]
    if op == "INSIDE" and args.get("ms", INF) == INF and args.get("me", INF) == INF:
        return [("p1", p1 - args.get("ns", 0), False, "p2", best >= p2 + args.get("ne", 0))]
    if op == "OVERLAPS" and n <= 1 and m == INF:
        return [("p1", p2, False, "p2", best >= p1)]
    return None


def _swept(entries: DataFrame, columns: list[str], op: str, args: dict[str, int], negated: bool) -> DataFrame:
    """entries: spans with __mine, once as one that looks for a partner and once as a partner.  All sweeps go over one exchange by
    document; where two are needed (NEAR), it is sorted in two orders."""
    mine = F.col("__mine") == 1
    hit = F.lit(False)
    swept = entries
    for k, (sorted_by, place, later, kept, test) in enumerate(_sweeps(op, args)):
        key = F.when(mine, place).otherwise(F.col(sorted_by).cast("bigint"))
        swept = swept.withColumn(f"__k{k}", key).withColumn(f"__v{k}", F.when(~mine, F.col(kept).cast("bigint")))
        # at equal places partners come first, so that they count
        order = F.col(f"__k{k}").desc() if later else F.col(f"__k{k}").asc()
        w = Window.partitionBy("document_id").orderBy(order, F.col("__mine")).rowsBetween(Window.unboundedPreceding, 0)
        swept = swept.withColumn("__best", (F.min if later else F.max)(f"__v{k}").over(w)).withColumn(f"__hit{k}", F.coalesce(test, F.lit(False)))
        hit = hit | F.col(f"__hit{k}")
    return swept.filter(mine & (~hit if negated else hit)).select(*columns)


def locate_within(spans: DataFrame, left: Column, right: Column, op: str, args: dict[str, int] | None = None, negated: bool = False) -> DataFrame:
    """As `locate` for two conditions on the same spans: they are read once, and both sides come from the rows that meet either."""
    sides = F.array_compact(F.array(F.when(left, 1), F.when(right, 0)))
    entries = spans.filter(left | right).select(*spans.columns, F.explode(sides).alias("__mine"))
    return _swept(entries, spans.columns, op, args or {}, negated)


def sweepable(op: str, args: dict[str, int] | None = None) -> bool:
    return _sweeps(op, args or {}) is not None


def locate(
    left: DataFrame,
    right: DataFrame,
    op: str,
    args: dict[str, int] | None = None,
    negated: bool = False,
    structures: DataFrame | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """The rows of left that have (or, negated, that don't have) a partner in right.

    structures: both must be in the same one of these.  strategy: 'auto', 'sweep' or 'join'."""
    if op not in POSITIONAL:
        raise ValueError(f"no positional operator {op}")
    args = args or {}
    swept = structures is None and _sweeps(op, args) is not None
    if strategy == "sweep" and not swept:
        raise ValueError(f"{op} with these arguments can't be swept")
    if swept and strategy != "join":
        entries = left.withColumn("__mine", F.lit(1)).unionByName(right.select("document_id", "p1", "p2").withColumn("__mine", F.lit(0)), allowMissingColumns=True)
        return _swept(entries, left.columns, op, args, negated)
    a, b = left.alias("a"), right.select("document_id", "p1", "p2").distinct().alias("b")
    a1, a2, b1, b2 = (F.col(x) for x in ("a.p1", "a.p2", "b.p1", "b.p2"))
    if structures is not None:
        # partners carry the bounds of the structures that hold them
        s = structures.select("document_id", "p1", "p2").alias("s")
        inside = (F.col("b.document_id") == F.col("s.document_id")) & (F.col("s.p1") <= b1) & (F.col("s.p2") >= b2)
        b = b.join(s, inside).select("b.*", F.col("s.p1").alias("s1"), F.col("s.p2").alias("s2")).alias("b")
    condition = (F.col("a.document_id") == F.col("b.document_id")) & predicate(op, args, a1, a2, b1, b2)
    if op == "INSIDE" and min(args.get("ms", INF), args.get("me", INF)) < INF:
        # one coordinate of a partner is so near that both meet on a page of positions
        low, high, at = (b1 + args.get("ns", 0), b1 + args.get("ms", INF), a1) if args.get("ms", INF) < INF else (b2 - args.get("me", INF), b2 - args.get("ne", 0), a2)
        page = max(64, abs(args["ms"] - args.get("ns", 0)) if args.get("ms", INF) < INF else abs(args["me"] - args.get("ne", 0)))
        b = b.select("b.*", F.explode(F.sequence(F.floor(low / page), F.floor(high / page))).alias("page")).alias("b")
        condition = condition & (F.floor(at / page) == F.col("b.page"))
    if structures is not None:
        condition = condition & (F.col("b.s1") <= a1) & (F.col("b.s2") >= a2)
    return a.join(b, condition, "left_anti" if negated else "left_semi")


def matching_pairs(left: DataFrame, right: DataFrame, op: str, args: dict[str, int] | None = None) -> DataFrame:
    """All pairs that stand so: columns of left, and the partner's as right_id, right_p1 and right_p2."""
    a, b = left.alias("a"), right.alias("b")
    a1, a2, b1, b2 = (F.col(x) for x in ("a.p1", "a.p2", "b.p1", "b.p2"))
    joined = a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & predicate(op, args or {}, a1, a2, b1, b2))
    return joined.select("a.*", F.col("b.id").alias("right_id"), b1.alias("right_p1"), b2.alias("right_p2"))

"""Changes of optimized plans that Catalyst doesn't make: counts before joins, many-to-many joins dealt evenly, joins moved down to the table they are about.

Every change is one of plan only: the rows, their columns and types stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

#: Keys that are unique in their tables; a join on one multiplies no rows.
UNIQUE = frozenset(["c_custkey", "s_suppkey", "p_partkey", "o_orderkey", "d_datekey", "n_nationkey", "r_regionkey"])
#: Input files and rows, in bytes, of a side that is broadcast.
SMALL, SMALL_ROWS = 16 << 20, 64 << 20
#: Parts of a side that is dealt evenly, input below which it is, and rows of the other side that are met at a time.
PARTS, DEALT, TILE = 96, 1 << 30, 1 << 14


def frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def kind(x) -> str:
    return x.getClass().getSimpleName()


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def conjuncts(e, of: str = "And") -> list:
    return [*conjuncts(e.left(), of), *conjuncts(e.right(), of)] if kind(e) == of else [e]


def column(spark: SparkSession, e) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))


def with_children(spark: SparkSession, node, children: list):
    return node.withNewChildren(spark._jvm.org.apache.spark.api.python.PythonUtils.toSeq(children))


def output(plan) -> list:
    return items(plan.output().toList())


def sides(e, left, right) -> tuple | None:
    """(expression of the left side, of the right one) of an equality between them."""
    if kind(e) != "EqualTo":
        return None
    a, b = e.left(), e.right()
    if a.references().isEmpty() or b.references().isEmpty():
        return None
    if a.references().subsetOf(left) and b.references().subsetOf(right):
        return a, b
    if a.references().subsetOf(right) and b.references().subsetOf(left):
        return b, a
    return None


def leaves(plan) -> list[int]:
    """Bytes of the inputs of a plan."""
    children = items(plan.children().toList())
    return [x for c in children for x in leaves(c)] if children else [int(plan.stats().sizeInBytes())]


def rows_of(spark: SparkSession, plan) -> int:
    """Rows of a plan's largest input."""
    return max(frame(spark, leaf).count() for leaf in items(plan.collectLeaves().toList()))


def small(spark: SparkSession, plan) -> bool:
    """Whether a side's rows, counted in its largest input, take little memory; Spark takes a join of dimensions for the product of both."""
    return sum(leaves(plan)) <= SMALL and sum(8 + a.dataType().defaultSize() for a in output(plan)) * rows_of(spark, plan) <= SMALL_ROWS


def keys(join) -> tuple[list[tuple], list]:
    """Equalities between the sides of a join as (left, right), and its other conditions."""
    left, right = join.left().outputSet(), join.right().outputSet()
    parts = conjuncts(join.condition().get()) if join.condition().isDefined() else []
    found = [(sides(e, left, right), e) for e in parts]
    return [s for s, _ in found if s], [e for s, e in found if not s]


def many_to_many(join) -> bool:
    equal, _ = keys(join)
    return bool(equal) and not any(kind(e) == "AttributeReference" and e.name() in UNIQUE for pair in equal for e in pair)


def _bottom_up(spark: SparkSession, plan, change) -> tuple:
    before = items(plan.children().toList())
    after = [_bottom_up(spark, c, change) for c in before]
    if any(c for _, c in after):
        plan = with_children(spark, plan, [p for p, _ in after])
    new = change(spark, plan)
    return (plan, any(c for _, c in after)) if new is None else (new, True)


def changed(df: DataFrame, change) -> DataFrame:
    """The frame with ``change`` (of session and node, to a node or None) made wherever it applies in its optimized plan, from the leaves up."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Join " not in plan.toString():
        return df
    new, any_change = _bottom_up(df.sparkSession, plan, change)
    return frame(df.sparkSession, new) if any_change else df


def count_before_join(spark: SparkSession, plan):
    """``count(*)`` over a many-to-many equi-join, from the counts of the keys on either side: no pair is made."""
    if kind(plan) != "Aggregate":
        return None
    join = plan.child()
    while kind(join) == "Project" and all(kind(e) == "AttributeReference" for e in items(join.projectList().toList())):
        join = join.child()
    if kind(join) != "Join" or join.joinType().toString() != "Inner" or not many_to_many(join):
        return None
    equal, rest = keys(join)
    groups, outputs = items(plan.groupingExpressions().toList()), items(plan.aggregateExpressions().toList())
    if rest or any(kind(g) != "AttributeReference" for g in groups) or not all(kind(e) == "AttributeReference" or _counts_rows(e) for e in outputs):
        return None
    halves = []
    for side, name, at in ((join.left(), "a", 0), (join.right(), "b", 1)):
        own = [column(spark, g) for g in groups if g.references().subsetOf(side.outputSet())]
        named = [column(spark, pair[at]).alias(f"_{name}{i}") for i, pair in enumerate(equal)]
        halves.append(frame(spark, side).groupBy(*own, *named).agg(F.count(F.lit(1)).alias(f"_{name}")))
    on = [F.col(f"_a{i}") == F.col(f"_b{i}") for i in range(len(equal))]
    pairs = halves[0].join(halves[1], reduce(lambda x, y: x & y, on))
    found = pairs.groupBy(*[column(spark, g) for g in groups]).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0).cast("long")).alias("_n"))
    n = output(found._jdf.queryExecution().analyzed())[-1]
    return found.select(*[column(spark, e if kind(e) == "AttributeReference" else with_children(spark, e, [n])) for e in outputs])._jdf.queryExecution().analyzed()


def _counts_rows(e) -> bool:
    if kind(e) != "Alias" or kind(e.child()) != "AggregateExpression":
        return False
    whole = e.child()
    of = whole.aggregateFunction()
    return kind(of) == "Count" and not whole.isDistinct() and whole.filter().isEmpty() and all(kind(c) == "Literal" and c.value() is not None for c in items(of.children().toList()))


def deal_evenly(spark: SparkSession, plan):
    """A many-to-many join, whose few keys would each make one task: the larger side dealt evenly, the smaller one beside each part of it.

    What an outer join keeps without a partner is added by an anti join with the other side's distinct keys.
    """
    if kind(plan) != "Join" or plan.joinType().toString() not in ("Inner", "LeftOuter", "RightOuter") or not plan.hint().leftHint().isEmpty() or not plan.hint().rightHint().isEmpty() or not many_to_many(plan):
        return None
    equal, rest = keys(plan)
    kept = plan.joinType().toString()
    if kept != "Inner" and rest:
        return None
    left, right = plan.left(), plan.right()
    bytes_left, bytes_right = sum(leaves(left)), sum(leaves(right))
    if max(bytes_left, bytes_right) >= DEALT:
        return None  # it comes in many parts as it is
    one, two = frame(spark, left), frame(spark, right)
    on = reduce(lambda x, y: x & y, [column(spark, e) for e in conjuncts(plan.condition().get())])
    columns = [column(spark, e) for e in output(plan)]
    (big, own), (less, met) = ((one, left), (two, right)) if bytes_left >= bytes_right else ((two, right), (one, left))
    tiles = -(-rows_of(spark, met) // TILE) or 1
    less = less.withColumn("_of", F.pmod(F.xxhash64(*[column(spark, e) for e in output(met)]), F.lit(tiles)))
    if small(spark, met):
        # rows of one key follow each other and meet the same few thousand rows in the same order, which encodes and packs well
        big = big.repartition(PARTS).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        big = big.sortWithinPartitions("_tile", *[column(spark, e) for pair in equal for e in pair if e.references().subsetOf(own.outputSet())])
        big = big.withColumn("_kept", F.explode(F.array(F.lit(0))))  # else the optimizer takes the sort out below a join
        inner = big.join(F.broadcast(less), on & (F.col("_tile") == F.col("_of")))
    else:
        big = big.withColumn("_tile", F.pmod(F.xxhash64(*[column(spark, e) for e in output(own)]), F.lit(PARTS)))
        less = less.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        inner = big.join(less, on & (F.col("_tile") == F.col("_at")))
    inner = inner.select(*columns)
    if kept == "Inner":
        return inner._jdf.queryExecution().analyzed()
    at, other, rows = (0, two, one) if kept == "LeftOuter" else (1, one, two)
    known = other.select(*[column(spark, pair[1 - at]).alias(f"_{i}") for i, pair in enumerate(equal)]).distinct()
    alone = rows.join(known, reduce(lambda x, y: x & y, [column(spark, pair[at]) == F.col(f"_{i}") for i, pair in enumerate(equal)]), "left_anti")
    own = rows._jdf.queryExecution().analyzed().outputSet()
    alone = alone.select(*[column(spark, e) if own.contains(e) else F.lit(None).cast(e.dataType().simpleString()).alias(e.name()) for e in output(plan)])
    return inner.union(alone)._jdf.queryExecution().analyzed()


def move_down(spark: SparkSession, plan):
    """An inner join with a table whose key comes from a smaller table of the left side is made there, before that one meets the largest.

    So ``(lines with orders) with customers`` becomes ``lines with (orders with customers)``: what customers leave out is left out of all
    that follows, and lines move once less.
    """
    if kind(plan) != "Join" or plan.joinType().toString() != "Inner" or plan.condition().isEmpty():
        return None
    equal, _ = keys(plan)
    right = plan.right()
    if not any(kind(b) == "AttributeReference" and b.name() in UNIQUE for _, b in equal):
        return None
    two = frame(spark, right)
    beside = [column(spark, e) for e in output(right)]

    def attach(node, a, b):
        if kind(node) == "RepartitionByExpression":  # what is dealt for the join above is dealt after this one
            return frame(spark, with_children(spark, node, [attach(node.child(), a, b)._jdf.queryExecution().analyzed()]))
        return frame(spark, node).join(F.broadcast(two) if small(spark, right) else two, column(spark, a) == column(spark, b))

    def down(node, a, b, top: bool):
        """The node with the join in it, or None where it had better be made above."""
        if kind(node) == "Project":
            own = next((e for e in items(node.projectList().toList()) if e.exprId().equals(a.exprId())), None)
            inner = own.child() if own is not None and kind(own) == "Alias" else own
            if inner is None or kind(inner) != "AttributeReference":
                return None
            new = down(node.child(), inner, b, top)
            return None if new is None else new.select(*[column(spark, e) for e in items(node.projectList().toList())], *beside)
        if kind(node) == "Filter":
            new = down(node.child(), a, b, top)
            return None if new is None else new.where(column(spark, node.condition()))
        if kind(node) == "RepartitionByExpression":
            new = down(node.child(), a, b, top)
            return None if new is None else frame(spark, with_children(spark, node, [new._jdf.queryExecution().analyzed()]))
        if kind(node) != "Join" or node.joinType().toString() != "Inner":
            return None
        in_left = node.left().outputSet().contains(a)
        side, other = (node.left(), node.right()) if in_left else (node.right(), node.left())
        new = down(side, a, b, False)
        if new is None and max(leaves(side)) < max(leaves(other)):
            new = attach(side, a, b)
        if new is None:
            return None if top else attach(node, a, b)
        inner = new._jdf.queryExecution().analyzed()
        return frame(spark, with_children(spark, node, [inner, other] if in_left else [other, inner]))

    for a, b in equal:
        if kind(a) == "AttributeReference" and kind(b) == "AttributeReference":
            new = down(plan.left(), a, b, True)
            if new is not None:
                rest = [column(spark, e) for e in conjuncts(plan.condition().get())]
                return new.where(reduce(lambda x, y: x & y, rest)).select(*[column(spark, e) for e in output(plan)])._jdf.queryExecution().analyzed()
    return None

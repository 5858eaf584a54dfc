"""Joins that Catalyst would plan badly if written plainly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def or_key_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_key: str) -> DataFrame:
    """Inner join on ``left.k1 = right.key OR left.k2 = right.key ...``: a right row joins a left row once.

    Each key is an equi-join of its own, and branch i leaves out rows whose key equals an earlier one, which would
    meet the same right rows again.  Null keys match nothing.  A plain OR would be a nested loop.
    """
    branches = []
    for i, key in enumerate(left_keys):
        rows = left
        for earlier in left_keys[:i]:
            rows = rows.where(~F.col(key).eqNullSafe(F.col(earlier)))
        branches.append(rows.join(right, F.col(key) == F.col(right_key)))
    return reduce(DataFrame.unionByName, branches)


def split_or_joins(df: DataFrame) -> DataFrame:
    """The same rows, with every inner join whose only keys are an OR of equalities made a union of equi-joins.

    Such a join is looked for in the optimized plan, where conditions lie at their joins; branch i takes the pairs that
    equality i connects and no earlier one does.  A plan without one comes back as it is.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    if " OR " not in plan.toString() or "Join Inner" not in plan.toString():
        return df
    new, changed = _split(spark, plan)
    return _frame(spark, new) if changed else df


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _conjuncts(e, kind: str = "And") -> list:
    return [*_conjuncts(e.left(), kind), *_conjuncts(e.right(), kind)] if e.getClass().getSimpleName() == kind else [e]


def _sides(e, left, right) -> bool:
    """An equality of something of the left side with something of the right one."""
    if e.getClass().getSimpleName() != "EqualTo":
        return False
    a, b = e.left().references(), e.right().references()
    if a.isEmpty() or b.isEmpty():
        return False
    return (a.subsetOf(left) and b.subsetOf(right)) or (a.subsetOf(right) and b.subsetOf(left))


def _split(spark: SparkSession, plan) -> tuple:
    from pyspark.sql.classic.column import Column

    jvm = spark._jvm
    children, it = [], plan.children().iterator()
    while it.hasNext():
        children.append(_split(spark, it.next()))
    changed = any(c for _, c in children)
    if changed:
        plan = plan.withNewChildren(jvm.org.apache.spark.api.python.PythonUtils.toSeq([p for p, _ in children]))
    if plan.getClass().getSimpleName() != "Join" or plan.joinType().toString() != "Inner" or plan.condition().isEmpty():
        return plan, changed
    left, right = plan.left(), plan.right()
    parts = _conjuncts(plan.condition().get())
    if any(_sides(e, left.outputSet(), right.outputSet()) for e in parts):
        return plan, changed  # there is a key already
    keys = next((k for k in parts if k.getClass().getSimpleName() == "Or" and all(_sides(e, left.outputSet(), right.outputSet()) for e in _conjuncts(k, "Or"))), None)
    if keys is None:
        return plan, changed
    column = lambda e: Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))
    rest = [column(e) for e in parts if not e.equals(keys)]
    equal = [column(e) for e in _conjuncts(keys, "Or")]
    one, two = _frame(spark, left), _frame(spark, right)
    branches = []
    for i, e in enumerate(equal):
        met = [~F.coalesce(earlier, F.lit(False)) for earlier in equal[:i]]
        branches.append(one.join(two, reduce(lambda a, b: a & b, [e, *met, *rest])))
    return reduce(DataFrame.union, branches)._jdf.queryExecution().analyzed(), True

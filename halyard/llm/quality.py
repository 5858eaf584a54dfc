"""Quality rules with thresholds learned per language and source from mergeable quantile sketches.

Everything is DataFrame functions.  A sketch is a histogram of integers that keeps the six leading
bits of a value, so it is exact below 64 and within 1/32 above; sketches merge by adding counts, in
any order.  A group's thresholds are blended with those of its language, and these with those of all, by counts: the
fewer documents a group has, the more it leans on the larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, text_or_empty

WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: The larger group counts as so many documents in a blend.
PRIOR = 50
#: A value is out of line beyond the upper (or lower) quartile by this many spreads.
SPREADS = 3
#: metric -> (smallest spread, judged below too)
METRICS = {"symbols": (100, False), "word_length": (40, True), "dup_lines": (200, False), "repeats": (100, False)}


def unused(columns: list[str]) -> str:
    """A prefix that no column begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed.

    Null text counts as no text: no words, and so base_failed.  Columns of the input with these
    names are replaced; all others stay.
    """
    t = text_or_empty()
    own = unused(docs.columns)
    w, h, ls, p, q, f, g = (f"{own}{x}" for x in "whlpqfg")
    trimmed = F.expr(f"trim(BOTH '{GAP_CHARS}' FROM coalesce(text, ''))")
    out = docs.withColumn(w, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)))
    hashed = F.expr(f"if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))")
    lines = F.filter(F.split(t, "\n"), lambda x: F.expr("true") & (F.trim(x, F.lit(GAP_CHARS)) != ""))
    out = out.withColumns({h: hashed, ls: lines})
    out = out.withColumn(p, F.expr(f"if(size(array_distinct({h})) < size({h}), transform({h}, (x, i) -> struct(x as h, i as i)), null)"))
    out = out.withColumn(q, F.sort_array(p))
    out = out.withColumn(f, F.expr(f"filter(transform({q}, (x, i) -> if(x.h <=> get({q}, i - 1).h or x.h <=> get({q}, i + 1).h, x.i, -1)), p -> p >= 0)"))
    out = out.withColumn(g, F.sort_array(f))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": F.expr(f"coalesce(aggregate(transform({g}, (x, i) -> coalesce(least(3, get({g}, i + 1) - x), 3)), 0L, (a, x) -> a + x), 0L)"),
            "n_lines": F.size(ls).cast("long"),
        }
    ).drop(w, h, ls, p, q, f, g)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def metric_values() -> dict[str, Column]:
    """The judged values: parts in 10,000, hundredths of a character, parts in 1,000."""
    return {
        "symbols": F.expr("n_symbols * 10000 div greatest(word_chars, 1)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
    }


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n over the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in metric_values().items()])
    rows = stats.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("m")).select("lang", "source", "m.metric", "m.v")
    shift = F.expr("greatest(length(bin(v)) - 6, 0)")
    rows = rows.withColumn("_s", shift).withColumn("bucket", F.expr("shiftleft(shiftright(v, _s), _s)"))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per language and source: <metric>_low and <metric>_high for every metric."""
    sketch = sketches(stats)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None)).alias("l"), (F.col("source") if k < 1 else F.lit(None)).alias("s")) for k in range(3)])
    merged = sketch.withColumn("g", F.explode(levels)).groupBy("g.level", "g.l", "g.s", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "l", "s", "metric")
    ranked = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    quartile = lambda p: F.min(F.when(F.col("below") * 4 >= F.col("total") * p, F.col("bucket")))
    fences = ranked.groupBy("level", "l", "s", "metric").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("total"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(F.create_map(*[F.lit(x) for k, v in METRICS.items() for x in (k, v[0])]), F.col("metric")))
    fences = fences.select("level", "l", "s", "metric", "total", (F.col("q1") - SPREADS * spread).alias("low"), (F.col("q3") + SPREADS * spread).alias("high"))
    wide = fences.groupBy("level", "l", "s").agg(
        F.max("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("fence"),
    )
    own, tongue, everywhere = (wide.where(F.col("level") == k).drop("level") for k in range(3))
    keys = sketch.select("lang", "source").distinct()
    found = (
        keys.join(own.select(F.col("l").alias("l0"), F.col("s").alias("s0"), F.col("total").alias("t0"), F.col("fence").alias("f0")), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
        .join(tongue.select(F.col("l").alias("l1"), F.col("total").alias("t1"), F.col("fence").alias("f1")), F.col("lang").eqNullSafe(F.col("l1")), "left")
        .join(F.broadcast(everywhere.select(F.col("fence").alias("f2"))), F.lit(True), "left")
    )
    blend = lambda n, own, larger: F.expr(f"({n} * {own} + {PRIOR} * {larger}) div ({n} + {PRIOR})")
    for name in METRICS:
        for end in ("low", "high"):
            found = found.withColumn(f"l_{name}_{end}", blend("t1", f"f1['{name}'].{end}", f"f2['{name}'].{end}"))
            found = found.withColumn(f"{name}_{end}", blend("t0", f"f0['{name}'].{end}", f"l_{name}_{end}"))
    return found.select("lang", "source", *[f"{name}_{end}" for name in METRICS for end in ("low", "high")])


def judge(stats: DataFrame) -> DataFrame:
    """Add ``kept`` to rows of ``with_statistics`` that can be read twice (written beforehand).

    A null language or source is a group of its own.  A group without a document that passes the
    base rules has no thresholds, and nothing left to judge.
    """
    own = unused(stats.columns)
    limits = thresholds(stats)
    limits = materialize(limits.withColumnsRenamed({c: own + c for c in limits.columns}), "quality-thresholds")
    fine = F.lit(True)
    for name, value in metric_values().items():
        fine = fine & (value <= F.col(f"{own}{name}_high"))
        if METRICS[name][1]:
            fine = fine & (value >= F.col(f"{own}{name}_low"))
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col(f"{own}lang")) & F.col("source").eqNullSafe(F.col(f"{own}source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True))).drop(*limits.columns)


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return judge(materialize(stats, "quality")).select("doc_id", *STATISTICS, "base_failed", "kept")


_VALUES = {
    "symbols": "n_symbols * 10000 // greatest(word_chars, 1)",
    "word_length": "word_chars * 100 // greatest(n_words, 1)",
    "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
}

OP8_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
st AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (r)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {x} AS v FROM s WHERE NOT base_failed" for k, x in _VALUES.items())}),
b AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM v),
lv AS (SELECT 0 AS level, lang, source, metric, bucket FROM b UNION ALL SELECT 1, lang, NULL, metric, bucket FROM b UNION ALL SELECT 2, NULL, NULL, metric, bucket FROM b),
h AS (SELECT level, lang, source, metric, bucket, count(*) AS n FROM lv GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM h),
q AS (SELECT level, lang, source, metric, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS q1, min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS q3 FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, metric, total, q1 - {SPREADS} * greatest(q3 - q1, m) AS low, q3 + {SPREADS} * greatest(q3 - q1, m) AS high
  FROM q JOIN (VALUES {", ".join(f"('{k}', {v[0]})" for k, v in METRICS.items())}) AS z(metric, m) USING (metric)),
g AS (SELECT s.*, a.metric, (o.total * o.low + {PRIOR} * ((l.total * l.low + {PRIOR} * a.low) // (l.total + {PRIOR}))) // (o.total + {PRIOR}) AS low,
  (o.total * o.high + {PRIOR} * ((l.total * l.high + {PRIOR} * a.high) // (l.total + {PRIOR}))) // (o.total + {PRIOR}) AS high
  FROM (SELECT *, row_number() OVER () AS rid FROM s) AS s LEFT JOIN f AS a ON a.level = 2
  LEFT JOIN f AS l ON l.level = 1 AND l.metric = a.metric AND l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN f AS o ON o.level = 0 AND o.metric = a.metric AND o.lang IS NOT DISTINCT FROM s.lang AND o.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(bool_and(CASE metric {" ".join(f"WHEN '{k}' THEN {x} <= high" + (f" AND {x} >= low" if METRICS[k][1] else "") for k, x in _VALUES.items())} END), true) AS kept
FROM g GROUP BY rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
"""

"""Order statistics over a whole table without a one-task window.

The table is first aggregated by distinct value, so a value that repeats in a third of all rows becomes one row. That
aggregate is range partitioned and written once to the shared folder, each row with the number of its range: whatever it
came from is computed a single time and cannot be lost with an executor. Range totals give each range its starting
offset, and a window inside (keys, range) adds the rest. There are as many ranges as shuffle partitions. They only
decide how evenly the work spreads; the sums are exact for any ranges, and every size takes the same path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.session import materialise


def ranged(df: DataFrame, columns: Sequence[Column | str], name: str) -> DataFrame:
    """The rows written in range order of the columns, with the number `_b` of their range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *columns).withColumn("_b", F.spark_partition_id()), name)


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges strictly below the value: right-closed ranges, as a balanced chain of comparisons."""
    number = value.cast("double")

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(number <= F.lit(float(edges[mid])), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(edges))


def cumulate(df: DataFrame, value: str, measures: Mapping[str, Column], by: Sequence[str] = (), desc: bool = False) -> DataFrame:
    """One row per (by, value): each measure m, its running sum `cum_m` in value order, its group total `tot_m`.

    `measures` are sum-like aggregates. Null values of `value` are left out; null keys are a group of their own.
    """
    by, names = list(by), list(measures)
    per_value = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[m.alias(n) for n, m in measures.items()])
    per_value = ranged(per_value, [value, *by], "values")
    order = F.col(value).desc() if desc else F.col(value).asc()
    keys = by or [F.lit(0)]
    totals = per_value.groupBy(*by, "_b").agg(*[F.sum(n).alias(n) for n in names])
    # At most one row per range in each group of keys.
    ahead = W.partitionBy(*keys).orderBy(F.col("_b").desc() if desc else F.col("_b").asc())
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_ob"),
        *[(F.sum(n).over(ahead) - F.col(n)).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"tot_{n}") for n in names])
    on = per_value["_b"] == offsets["_ob"]
    for k in by:
        on = on & per_value[k].eqNullSafe(offsets[f"_k_{k}"])
    inside = W.partitionBy(*by, "_b").orderBy(order)
    side = offsets if by else F.broadcast(offsets)  # without keys: one row per range
    joined = per_value.join(side, on, "inner")
    return joined.select(
        *by, value, *names,
        *[(F.sum(n).over(inside) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[f"tot_{n}" for n in names])


def counts(df: DataFrame, value: str, by: Sequence[str] = (), desc: bool = False) -> DataFrame:
    return cumulate(df, value, {"n": F.count(F.lit(1))}, by, desc)


def index_percentiles(df: DataFrame, value: str, ps: Mapping[str, float], by: Sequence[str] = (),
                      rule: str = "floor") -> DataFrame:
    """The value at a fixed index of the sorted values of each group.

    rule "floor": index floor(p*(n-1)); rule "half": index floor(p*(n-1)+0.5). Adds n, min and max.
    """
    shift = {"floor": 0.0, "half": 0.5}[rule]
    c = counts(df, value, by)
    picks = [
        F.min(F.when(F.col("cum_n") > F.floor(F.lit(p) * (F.col("tot_n") - 1) + F.lit(shift)), F.col(value))).alias(name)
        for name, p in ps.items()]
    aggs = [F.sum("n").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), *picks]
    return c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)


def linear_quantiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, one row per (by, q)."""
    c = counts(df, value, by)
    pos = [F.lit(float(p)) * (F.col("tot_n") - 1) for p in ps]
    aggs = []
    for i, h in enumerate(pos):
        low, high = F.floor(h), F.ceil(h)
        number = F.col(value).cast("double")
        aggs += [F.min(F.when(F.col("cum_n") > low, number)).alias(f"_lo{i}"),
                 F.min(F.when(F.col("cum_n") > high, number)).alias(f"_hi{i}"),
                 F.max(h - low).alias(f"_w{i}")]
    one = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    packed = F.array(*[
        F.struct(F.lit(float(p)).alias("q"),
                 (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias("value"))
        for i, p in enumerate(ps)])
    return one.select(*by, F.explode(packed).alias("s")).select(*by, "s.q", "s.value")


def quantile_list(df: DataFrame, value: str, ps: Sequence[float]) -> list[float]:
    """The same quantiles as plain numbers: len(ps) values reach the driver."""
    got = {r.q: r.value for r in linear_quantiles(df, value, ps).collect()}
    return [got[float(p)] for p in ps]


def values_at_ranks(df: DataFrame, value: str, fractions, rule: str) -> list:
    """Distinct values of a column at positions given by fractions of their number.

    rule "round": half-even rounding of n*f; rule "trunc": truncation. Returns [n, first, last, (at, before) ...].
    """
    distinct = df.select(value).distinct()
    c = counts(distinct, value)
    n_col = F.col("tot_n").cast("double")
    cut = {"round": lambda f: F.rint(n_col * F.lit(f)), "trunc": lambda f: F.floor(n_col * F.lit(f))}[rule]
    aggs = [F.max("tot_n").alias("n"), F.min(value).alias("first"), F.max(value).alias("last")]
    for i, f in enumerate(fractions):
        k = cut(f).cast("bigint")
        aggs += [F.max(k).alias(f"k{i}"), F.max(F.when(F.col("cum_n") == k + 1, F.col(value))).alias(f"at{i}"),
                 F.max(F.when(F.col("cum_n") == k, F.col(value))).alias(f"before{i}")]
    return c.agg(*aggs).first()


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, average 1-based rank): ties share the mean of their positions."""
    c = counts(df, value, by)
    return c.select(*by, value, (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias(name))


def number_rows(df: DataFrame, value: str, ties: Sequence[str], name: str, desc: bool = False, start: int = 0) -> DataFrame:
    """Number all rows in order of (value, ties) without a one-task sort: ranges plus offsets.

    Nulls come first, last if `desc`. Rows equal in value and ties are numbered in any order; a row mark beside them
    lets even a third of all rows being equal spread over ranges.
    """
    order = [F.col(value).desc() if desc else F.col(value).asc(), *[F.col(t).asc() for t in ties], F.col("_mark").asc()]
    marked = ranged(df.withColumn("_mark", F.monotonically_increasing_id()), order, "rows")
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col("_b").alias("_ob"), (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_off"))  # one row per range
    out = marked.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
    return (out.join(F.broadcast(offsets), out["_b"] == offsets["_ob"])
            .withColumn(name, (F.col("_off") + F.col("_r") - 1 + F.lit(start)).cast("bigint")).drop("_b", "_ob", "_off", "_r", "_mark"))


def _ahead(x: DataFrame, group: Column, position: Column, row: Column, value: Column) -> DataFrame:
    """(_b, _g, _last, _value) per range of `ranged` rows: for the group that goes on into the range, the row right before it
    and the last value that is not null.

    A range says what it starts and what it ends with; at most two rows per range meet.
    """
    edge = x.groupBy("_b").agg(F.min_by(group, position).alias("_first"), F.max_by(group, position).alias("_g"))
    tail = x.join(F.broadcast(edge.select("_b", "_g")), "_b").where(group.eqNullSafe(F.col("_g")))
    tail = tail.groupBy("_b").agg(F.first("_g").alias("_g"), F.max_by(row, position).alias("_last"), F.max_by(value, F.when(value.isNotNull(), position)).alias("_value"), F.lit(1).alias("_kind"))
    kinds = {f.name: f.dataType for f in tail.schema}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("_last", "_value")]
    both = tail.unionByName(edge.select("_b", F.col("_first").alias("_g"), *none, F.lit(0).alias("_kind")))
    before = W.partitionBy("_g").orderBy("_b", "_kind").rowsBetween(W.unboundedPreceding, -1)
    return both.select(F.col("_b").alias("_hb"), "_g", "_kind", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("_last", "_value")]).where("_kind = 0").drop("_kind")


def _scanned(df: DataFrame, by: Sequence[str], order: str, row: Sequence[str], value: Column) -> tuple[DataFrame, W]:
    """Ranged rows beside what comes before their range, and the window of a group inside a range.

    Borders come from the rows, so ranges hold about equal numbers of them however dense the order is somewhere.
    """
    x = ranged(df, [*by, order], "scan")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    heads = _ahead(x, group, F.struct(*by, order), F.struct(*row), value)
    j = x.withColumn("_xg", group).join(F.broadcast(heads), (F.col("_b") == F.col("_hb")) & F.col("_xg").eqNullSafe(F.col("_g")), "left")
    return j, W.partitionBy(*by, "_b").orderBy(order)


def with_previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row with `prev_<column>` of the row before it in its group, null for the first."""
    j, inside = _scanned(df, list(by), order, columns, F.lit(None).cast("int"))
    j = j.withColumn("_p", F.lag(F.struct(*columns)).over(inside)).withColumn("_i", F.row_number().over(inside))
    prev = F.when(F.col("_i") == 1, F.col("_last")).otherwise(F.col("_p"))
    return j.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def carry_forward(df: DataFrame, order: str, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Last value that is not null at or before each row of its group, in `order`; rows equal in it see each other's."""
    j, inside = _scanned(df, list(by), order, [order], F.col(value))
    here = F.last(value, ignorenulls=True).over(inside.rangeBetween(W.unboundedPreceding, 0))
    return j.withColumn(name, F.coalesce(here, F.col("_value"))).select(*df.columns, name)

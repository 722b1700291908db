"""Joins, deduplication and ordering with the semantics that time-aware tables need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a dimension is broadcast; the size is Spark's estimate, checked at planning.
BROADCAST_BYTES = 32 << 20


def small(dim: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``dim`` with a broadcast hint if Spark's size estimate is within the limit; else as it is."""
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if size <= limit else dim


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, once no key occurs twice; else an error that names one."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key is not unique: {twice[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join that may not multiply rows: keys of the right side (and of the left, if asked) must be unique."""
    if one_to_one:
        require_unique(left, on)
    return left.join(require_unique(right, on), on, how)


def join_roles(facts: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], attributes: list[str]) -> DataFrame:
    """One dimension joined once per role: ``roles`` maps a prefix to the fact's key column."""
    for prefix, column in roles.items():
        side = small(dim.select(F.col(key).alias(f"_{prefix}"), *[F.col(a).alias(f"{prefix}_{a}") for a in attributes]))
        facts = facts.join(side, facts[column].eqNullSafe(side[f"_{prefix}"]), "left").drop(f"_{prefix}")
    return facts


def opposite(flag: Column, if_true: Column, if_false: Column) -> Column:
    """The other side's value: of the second if the flag is set, else of the first."""
    return F.when(flag, if_false).otherwise(if_true)


def both_sides(df: DataFrame, shared: list[str], sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows per row, from the home and the away point of view; ``sides`` maps a name to (home column, away column)."""
    view = lambda i: F.struct(F.lit(i == 0).alias("is_home"), *[F.col(pair[i]).alias(n) for n, pair in sides.items()], *[F.col(pair[1 - i]).alias(f"opponent_{n}") for n, pair in sides.items()])
    return df.select(*shared, F.explode(F.array(view(0), view(1))).alias("v")).select(*shared, "v.*")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def keep_latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key; ties go to the larger ``tie``."""
    return keep_first(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark drops later ranks before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def mark_duplicates(df: DataFrame, keys: list[str], name: str = "duplicated") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def collapse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that agree in all columns collapse; an error if rows of one key differ."""
    distinct = df.distinct()
    require_unique(distinct, keys)
    return distinct


def collected_text(df: DataFrame, keys: list[str], text: Column, order: list[Column], name: str, separator: str = ", ") -> DataFrame:
    """Texts of a group joined in order; for groups of bounded size, as the fixtures of one block."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("t"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), separator).alias(name))


def pruned_union(df: DataFrame, group: str, orders: list[list[Column]], k: int, key: str) -> DataFrame:
    """Rows that are among the first ``k`` of their group by any of the orders; each once."""
    out = df
    for i, order in enumerate(orders):
        out = out.withColumn(f"_r{i}", F.row_number().over(Window.partitionBy(group).orderBy(*order, F.col(key))))
    best = F.least(*[F.col(f"_r{i}") for i in range(len(orders))]) if len(orders) > 1 else F.col("_r0")
    return out.filter(best <= k).drop(*[f"_r{i}" for i in range(len(orders))])


def page(df: DataFrame, order: list[Column], number: int, size: int, total: int | None = None) -> DataFrame:
    """One page, 1-based; numbers beyond the ends mean the first or the last page."""
    total = df.count() if total is None else total
    last = max(1, -(-total // size))
    number = min(max(number, 1), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def join_or_fallback(left: DataFrame, right: DataFrame, on: list[str], fallback: DataFrame, fallback_on: list[str]) -> DataFrame:
    """Rows of ``left`` with what ``right`` has for them; rows without a match take what ``fallback`` has.

    ``right`` and ``fallback`` must have the same columns besides their keys.
    """
    values = [c for c in right.columns if c not in on]
    found = left.join(right, on).select(*left.columns, *values, F.lit(False).alias("is_fallback"))
    rest = left.join(right.select(*on).distinct(), on, "left_anti").join(fallback, fallback_on)
    return found.unionByName(rest.select(*left.columns, *values, F.lit(True).alias("is_fallback")))


def bridged(rows: DataFrame, bridge: DataFrame, on: list[str], uid: str, slug: Column) -> DataFrame:
    """``rows`` with the uid that the bridge has for their key; where it has none, one made from ``slug``."""
    return rows.join(bridge.select(*on, F.col(uid).alias("_uid")), on, "left").withColumn(uid, F.coalesce("_uid", slug)).drop("_uid")


def blank_rows(universe: DataFrame, present: DataFrame, keys: list[str], variants: list[str], zeros: dict[str, float]) -> DataFrame:
    """A row of fixed values for each variant and each key of ``universe`` that ``present`` lacks."""
    missing = universe.join(present.select(*keys).distinct(), keys, "left_anti")
    each = missing.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    return each.withColumns({n: F.lit(v) for n, v in zeros.items()})


def still_the_same(saved: DataFrame, current: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """Saved rows with ``valid``: the key is still there and stands for the same identity."""
    now = current.select(*key, F.struct(*identity).alias("_now"))
    same = F.col("_now").isNotNull() & F.struct(*identity).eqNullSafe(F.col("_now"))
    return saved.join(now, key, "left").withColumn("valid", same).drop("_now")


def unstacked(df: DataFrame, by: list[str], name: str, values: list[str], default: int = 0) -> DataFrame:
    """(by, {value}_rows ...): rows of each value side by side; values that a group lacks get the default."""
    return df.groupBy(*by).agg(*[F.coalesce(F.count_if(F.col(name) == v), F.lit(default)).alias(f"{v}_rows") for v in values])

"""Point-in-time operators: what was known strictly before a cutoff.

Histories and targets meet in one shuffle by key: both are tagged, put in one time line per key and
read by a window frame that ends just before the target's time. No range join is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational

#: Microseconds of a day.
DAY = 86_400_000_000

def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def with_cutoff(df: DataFrame, block: list[str], kickoff: str = "kickoff_time", name: str = "information_cutoff", deadlines: DataFrame | None = None) -> DataFrame:
    """The earliest kickoff of each block as its cutoff; an exact deadline (block, deadline) comes first."""
    # a row per block joined back: a window would sort the blocks, which are few and grow with the rows
    cuts = df.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(block)]).agg(F.min(kickoff).alias("_cut"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(block)])
    out = df.join(F.broadcast(cuts), same, "left").withColumn(name, F.col("_cut")).drop("_cut", *[f"_b{i}" for i in range(len(block))])
    if deadlines is None:
        return out
    return out.join(deadlines.select(*block, F.col("deadline").alias("_d")), block, "left").withColumn(name, F.coalesce("_d", name)).drop("_d")


def rolling_sums(df: DataFrame, keys: list[str], order: list[str], measures: list[str], sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Sums over the last rows up to and including the row, for each size: ``prev{n}_{measure}_sum``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev{n}_{m}_sum": F.sum(F.coalesce(m, F.lit(0))).over(w.rowsBetween(1 - n, 0)) for n in sizes for m in measures})


def running_sums(df: DataFrame, keys: list[str], order: list[str], measures: dict[str, str], exclusive: bool = False) -> DataFrame:
    """Running sums; ``measures`` maps a new name to a column. Exclusive: without the row itself (0 at first)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumns({n: F.coalesce(F.sum(F.coalesce(m, F.lit(0))).over(w), F.lit(0)) for n, m in measures.items()})


def as_of(targets: DataFrame, history: DataFrame, keys: list[str], cutoff: str, time: str, tie: str, values: list[str]) -> DataFrame:
    """``targets`` with ``values`` and ``time`` of the latest history row of the key strictly before the cutoff.

    Of history rows at one time the one with the larger ``tie`` counts. A null value of that row
    stays null (no older value takes its place); targets without history or cutoff get nulls.
    """
    carried = F.struct(F.col(time).alias(time), *[F.col(v) for v in values])
    last = history.filter(F.col(time).isNotNull()).groupBy(*keys, micros(F.col(time)).alias("_t")).agg(F.max_by(carried, F.col(tie)).alias("_h"))
    at = targets.withColumn("_t", micros(F.col(cutoff)))
    rows = at.select(*keys, "_t", F.struct(*[F.col(c) for c in targets.columns]).alias("_row"), F.lit(None).cast(last.schema["_h"].dataType).alias("_h"))
    line = rows.unionByName(last.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    before = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    seen = line.withColumn("_seen", F.last("_h", ignorenulls=True).over(before)).filter("_row is not null")
    found = F.when(F.col("_t").isNotNull(), F.col("_seen"))
    return seen.select("_row.*", *[found[c].alias(c) for c in [time, *values]])


def totals_as_of(targets: DataFrame, history: DataFrame, keys: list[str], cutoff: str, time: str, sums: dict[str, Column], latest: dict[str, Column] | None = None) -> DataFrame:
    """``targets`` with sums over all history rows of the key strictly before the cutoff (null without any).

    ``latest`` maps a name to a struct of an order and, last, a value: the value of the largest
    order before the cutoff. Work grows with rows and targets, not with their product.
    """
    latest = latest or {}
    # rows go on the line as they are: those at one time are left out together by the frame
    at_time = history.filter(F.col(time).isNotNull()).select(*keys, micros(F.col(time)).alias("_t"), *[c.alias(f"_s_{n}") for n, c in sums.items()], *[c.alias(f"_l_{n}") for n, c in latest.items()])
    made = [c for c in at_time.columns if c.startswith(("_s_", "_l_"))]
    rows = targets.select(*keys, micros(F.col(cutoff)).alias("_t"), F.struct(*[F.col(c) for c in targets.columns]).alias("_row"), *[F.lit(None).cast(at_time.schema[n].dataType).alias(n) for n in made])
    line = rows.unionByName(at_time.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    before = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    seen = line.select("_row", "_t", *[(F.sum(n) if n.startswith("_s_") else F.max(n)).over(before).alias(n) for n in made]).filter("_row is not null")
    known = lambda c: F.when(F.col("_t").isNotNull(), c)
    value = lambda n: F.col(f"_l_{n}")[at_time.schema[f"_l_{n}"].dataType.fieldNames()[-1]]
    return seen.select("_row.*", *[known(F.col(f"_s_{n}")).alias(n) for n in sums], *[known(value(n)).alias(n) for n in latest])


def lagged_rates(df: DataFrame, key: str, season: str, cutoff: str, time: str, order: list[str], measures: list[str], sizes: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over the last rows of a key available strictly before each row's cutoff, and same-season sums before it.

    Adds ``lag{n}_{measure}_mean`` (0 without history), ``season_{measure}_before`` and
    ``lag_{time}`` (null without history). Each row is put on its key's time line twice, as history
    and as a target, after the means are made there; so rows are shuffled by key once.
    """
    line, season_line = Window.partitionBy(key).orderBy(time, *order), Window.partitionBy(key, season).orderBy(time, *order)
    means = {f"lag{n}_{m}_mean": F.avg(F.coalesce(m, F.lit(0)).cast("double")).over(line.rowsBetween(1 - n, 0)) for n in sizes for m in measures}
    sums = {f"season_{m}_before": F.sum(F.coalesce(m, F.lit(0)).cast("double")).over(season_line.rowsBetween(Window.unboundedPreceding, 0)) for m in measures}
    # of rows at one time the last in order counts; no time, no history
    last = lambda w: F.col(time).isNotNull() & ~F.lead(time).over(w).eqNullSafe(F.col(time))
    rows = df.withColumns({**{f"_m_{n}": c for n, c in means.items()}, "_last": last(line)}).withColumns({**{f"_m_{n}": c for n, c in sums.items()}, "_last_season": last(season_line)})
    held = F.when(F.col("_last"), F.struct(F.col(time).alias(f"lag_{time}"), *[F.col(f"_m_{n}").alias(n) for n in means]))
    held_season = F.when(F.col("_last_season"), F.struct(*[F.col(f"_m_{n}").alias(n) for n in sums]))
    kinds = [(n, rows.select(c.alias("_x")).schema["_x"].dataType) for n, c in (("_row", F.struct(*df.columns)), ("_h", held), ("_g", held_season))]
    none = {n: F.lit(None).cast(t).alias(n) for n, t in kinds}
    target = F.struct(micros(F.col(cutoff)).alias("_t"), F.struct(*df.columns).alias("_row"), none["_h"], none["_g"])
    past = F.struct(micros(F.col(time)).alias("_t"), none["_row"], held.alias("_h"), held_season.alias("_g"))
    both = rows.select(key, season, F.explode(F.array(target, past)).alias("_e")).select(key, season, "_e.*").filter("_row IS NOT NULL OR _h IS NOT NULL OR _g IS NOT NULL")
    before = lambda *by: Window.partitionBy(*by).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_h", F.last("_h", ignorenulls=True).over(before(key)))
    seen = seen.withColumn("_g", F.last("_g", ignorenulls=True).over(before(key, season))).filter("_row IS NOT NULL")
    known = lambda c: F.when(F.col("_t").isNotNull(), c)
    return seen.select("_row.*", known(F.col("_h")[f"lag_{time}"]).alias(f"lag_{time}"), *[F.coalesce(known(F.col(h)[n]), F.lit(0.0)).alias(n) for h, made in (("_h", means), ("_g", sums)) for n in made])


def season_changes(df: DataFrame, key: str, season: str, attributes: list[str]) -> DataFrame:
    """One row per key and season with ``{attribute}_changed``: it differs from the season before that the key has."""
    one = df.groupBy(key, season).agg(*[F.max(a).alias(a) for a in attributes])
    w = Window.partitionBy(key).orderBy(season)
    flags = {f"{a}_changed": F.coalesce(F.lag(a).over(w) != F.col(a), F.lit(False)) for a in attributes}
    return one.withColumns(flags)


def prior_season(df: DataFrame, key: str, season: str, aggregates: dict[str, Column], calendar: bool = False) -> DataFrame:
    """(key, season, prior_source_season, aggregates): each season's aggregates, moved to the season after.

    Seasons are labels ``2023-24``. The season after is the next one that was loaded, or the next of
    the calendar.
    """
    totals = df.groupBy(key, season).agg(*[c.alias(n) for n, c in aggregates.items()])
    start = F.substring(F.col(season), 1, 4).cast("long")
    if calendar:
        after = F.concat((start + 1).cast("string"), F.lit("-"), F.lpad(((start + 2) % 100).cast("string"), 2, "0"))
        moved = totals.withColumn("_next", after)
    else:
        loaded = df.select(season).distinct()
        following = loaded.withColumn("_next", F.lead(season).over(Window.orderBy(season)))
        moved = totals.join(relational.small(following), season).filter("_next is not null")
    return moved.select(key, F.col("_next").alias(season), F.col(season).alias("prior_source_season"), *aggregates)


def folds(df: DataFrame, season: str, block: str, cutoff: str, test_seasons: list[str] | None = None, first_block_only: bool = False) -> DataFrame:
    """The fold table: one row per (season, block) with its cutoff, number of rows and position in time."""
    rows = df.filter(F.col(season).isNotNull() & F.col(block).isNotNull())
    if test_seasons is not None:
        rows = rows.filter(F.col(season).isin(test_seasons))
    table = rows.groupBy(season, block).agg(F.min(cutoff).alias(cutoff), F.count(F.lit(1)).alias("test_rows"))
    if first_block_only:
        first = F.min(block).over(Window.partitionBy(season))
        table = table.withColumn("_first", first).filter(F.col(block) == F.col("_first")).drop("_first")
    fold_id = F.concat(F.col(season), F.lit("_gw"), F.lpad(F.col(block).cast("string"), 2, "0"))
    return table.withColumn("fold_id", fold_id)


def training_totals(df: DataFrame, fold_table: DataFrame, time: str, cutoff: str, measures: dict[str, Column], keys: list[str] | None = None, season_before: str | None = None) -> DataFrame:
    """Sums of ``measures`` over the rows that each fold may train on, in one pass for all folds.

    A row trains a fold if it was available strictly before the fold's cutoff (with
    ``season_before``: and belongs to an earlier season). Rows fall into the gaps between cutoffs
    and gap sums are added up in order, so work grows with rows plus folds, not with their product.
    """
    keys = keys or []
    cuts = fold_table.select("fold_id", micros(F.col(cutoff)).alias("_t"), *([F.col(season_before).alias("_s")] if season_before else []))
    rows = df.select(*keys, micros(F.col(time)).alias("_t"), *[c.alias(n) for n, c in measures.items()], *([F.col(season_before).alias("_rs")] if season_before else [])).filter("_t is not null")
    at_cut = [*keys, "_t", *(["_rs"] if season_before else [])]
    rows = rows.groupBy(*at_cut).agg(*[F.sum(n).alias(n) for n in measures])
    if season_before:
        # one time line per season, marked by the folds of later seasons; the marks of a fold are then added up
        lines = rows.withColumnRenamed("_rs", "_line")
        marks = cuts.join(relational.small(rows.select(*keys, F.col("_rs").alias("_line")).distinct()), F.col("_line") < F.col("_s")).drop("_s")
        empty = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in measures]
        line = marks.select("fold_id", *keys, "_line", "_t", *empty).unionByName(lines.withColumn("fold_id", F.lit(None).cast("string")).select("fold_id", *keys, "_line", "_t", *measures))
        before = Window.partitionBy(*keys, "_line").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
        sums = line.withColumns({n: F.sum(n).over(before) for n in measures}).filter(F.col("fold_id").isNotNull() & F.coalesce(*[F.col(n) for n in measures]).isNotNull())
        return sums.groupBy("fold_id", *keys).agg(*[F.sum(n).alias(n) for n in measures])
    groups = rows.select(*keys).distinct() if keys else None
    marks = cuts.crossJoin(groups) if groups is not None else cuts  # folds times groups: the result's own size
    day = F.floor(F.col("_t") / F.lit(DAY)).cast("long")
    rows, marks = rows.withColumn("_day", day), marks.withColumn("_day", day)

    def before(marked: DataFrame, counted: DataFrame, by: list[str], order: str) -> DataFrame:
        """Sums of what lies before each mark on a line per ``by``."""
        names = ["fold_id", *dict.fromkeys([*by, order])]
        line = marked.select(*names, *[F.lit(None).cast(counted.schema[n].dataType).alias(n) for n in measures])
        line = line.unionByName(counted.withColumn("fold_id", F.lit(None).cast("string")).select(*names, *measures))
        frame = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        return line.withColumns({n: F.sum(n).over(frame) for n in measures}).filter("fold_id is not null")

    # whole days first, then the times of a cutoff's own day: no line is longer than days or a day's times
    days = before(marks, rows.groupBy(*keys, "_day").agg(*[F.sum(n).alias(n) for n in measures]), keys, "_day")
    own = rows.join(F.broadcast(cuts.select(F.floor(F.col("_t") / F.lit(DAY)).cast("long").alias("_day")).distinct()), "_day", "left_semi")  # days of folds
    part = before(marks, own, [*keys, "_day"], "_t")
    both = days.select("fold_id", *keys, *measures).unionByName(part.select("fold_id", *keys, *measures))
    return both.groupBy("fold_id", *keys).agg(*[F.sum(n).alias(n) for n in measures])


def latest_before(df: DataFrame, fold_table: DataFrame, time: str, cutoff: str, key: str, most: int) -> DataFrame:
    """(fold_id, row of ``df``): for each fold the latest ``most`` rows strictly before its cutoff, larger keys first at one time.

    Rows get their exact place in time from counts per hour and an order within the hour; a fold's
    rows are then a run of places, found by blocks of ``most`` places, of which a run meets two at
    most. Nothing is sorted per fold; the result has folds times ``most`` rows.
    """
    hour = F.floor(micros(F.col(time)) / F.lit(3_600_000_000)).cast("long")
    rows = df.filter(F.col(time).isNotNull()).select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), micros(F.col(time)).alias("_t"), F.col(key).alias("_k"), hour.alias("_hour"))
    hours = rows.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # a row per hour
    starts = hours.select("_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_hour").orderBy("_t", "_k")
    placed = rows.join(relational.small(starts), "_hour").withColumn("_place", F.col("_start") + F.row_number().over(within) - 1)
    known = training_totals(df, fold_table, time, cutoff, {"_known": F.lit(1).cast("long")}).filter("_known > 0")
    low = F.greatest(F.col("_known") - most, F.lit(0).cast("long"))
    blocks = F.sequence(F.floor(low / most).cast("long"), F.floor((F.col("_known") - 1) / most).cast("long"))
    runs = known.select("fold_id", low.alias("_low"), "_known", F.explode(blocks).alias("_block"))
    found = placed.withColumn("_block", F.floor(F.col("_place") / most).cast("long")).join(relational.small(runs), "_block")
    return found.filter((F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_known"))).select("fold_id", "_row.*")


def leakage_audit(df: DataFrame, keys: list[str], cutoff: str, lineage: list[str], registered: set[str], prefixes: tuple[str, ...] = ("prev", "season_to_date", "prior_season"), block: str | None = None, first_block_zero: list[str] | None = None, season: str | None = None, prior_source: str | None = None, forbidden: tuple[str, ...] = ("season_total",)) -> DataFrame:
    """(severity, check, rows): rows that break a rule, one row per rule that has any.

    Rules: keys are unique; features that look like history are registered and none is a
    forbidden total; no lineage time is at or after the cutoff; the first block of a season has no
    same-season history; a prior season lies before the row's.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c.startswith(prefixes) and c not in registered and c != prior_source]
    bad_names = [c for c in df.columns if any(f in c.lower() for f in forbidden)]
    counts = {f"lineage_not_before_cutoff:{c}": F.count_if(F.col(c) >= F.col(cutoff)) for c in lineage}
    if block and first_block_zero:
        # one row per season, joined back: no window holds a season's rows
        by = [F.col(season).alias("_season")] if season else []
        firsts = relational.small(df.groupBy(*by).agg(F.min(block).alias("_block")))
        joined = df.join(firsts, F.col(season).eqNullSafe(F.col("_season")), "left") if season else df.crossJoin(firsts)
        df = joined.withColumn("_first", F.col(block) == F.col("_block")).drop("_season", "_block")
        counts["history_in_first_block"] = F.count_if(F.col("_first") & reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in first_block_zero]))
    if season and prior_source:
        counts["prior_season_not_before"] = F.count_if(F.col(prior_source) >= F.col(season))
    surplus = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit("duplicate_keys").alias("check"), F.col("rows").cast("long"))
    wide = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").cast("long").alias("rows")) for i, n in enumerate(counts)])).alias("p")
    found = surplus.unionByName(wide.select(pairs).select("p.*"))
    static = [(f"unregistered_feature:{n}", 1) for n in names] + [(f"forbidden_feature:{n}", 1) for n in bad_names]
    if static:
        found = found.unionByName(spark.createDataFrame(static, "check string, rows long"))
    return found.filter("rows > 0").select(F.lit("error").alias("severity"), "check", "rows")

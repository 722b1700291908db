"""Exact expected points of line-ups, substitutions included, as expressions: no states are enumerated as rows.

Starters leave gaps position by position (defenders first, then midfielders, then forwards), so
which substitutes come on depends on how many are missing in each position and on which
substitutes play. Chances of the numbers missing are small arrays; which numbers bring a
substitute on is a table of the competition's rules, made once from the rules themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.functions.probability import clip
from pitwise.operators import relational

from .decisions import POSITIONS, RULES, SquadRules

FIELD = POSITIONS[1:]


def formations(rules: SquadRules = RULES) -> list[tuple[int, int, int]]:
    """Numbers of defenders, midfielders and forwards that may start."""
    ranges = [range(rules.least[i], min(rules.most[i], rules.quota[i]) + 1) for i in (1, 2, 3)]
    return [f for f in product(*ranges) if sum(f) == rules.starters - 1]


def comes_on(start: tuple[int, ...], bench: tuple[int, ...], plays: tuple[bool, ...], gone: tuple[int, ...], rules: SquadRules = RULES) -> list[bool]:
    """Which substitutes come on for ``gone`` missing starters of each field position, in order; positions are 0, 1, 2."""
    counts, used = list(start), [False] * len(bench)
    for position in (p for p in range(3) for _ in range(gone[p])):
        for j, other in enumerate(bench):
            trial = list(counts)
            trial[position] -= 1
            trial[other] += 1
            if plays[j] and not used[j] and all(rules.least[i + 1] <= trial[i] <= rules.most[i + 1] for i in range(3)):
                used[j], counts = True, trial
                break
    return used


def substitution_table(spark: SparkSession, rules: SquadRules = RULES) -> DataFrame:
    """(formation, bench, used): for each of the substitutes the cases that bring the player on, under the rules.

    ``bench`` is the order of the substitutes' positions, as digits. A case says who of the bench
    plays and how many starters of each position are missing. Some fifty rows.
    """
    rows = []
    for start in formations(rules):
        left = [p for p in range(3) for _ in range(rules.quota[p + 1] - start[p])]
        for bench in sorted(set(permutations(left))):
            used: list[list[tuple]] = [[] for _ in bench]
            for plays in product((False, True), repeat=len(bench)):
                for gone in product(*(range(n + 1) for n in start)):
                    for j, on in enumerate(comes_on(start, bench, plays, gone, rules)):
                        if on:
                            used[j].append((list(plays), *gone))
            rows.append(("-".join(map(str, start)), "".join(map(str, bench)), used))
    return spark.createDataFrame(rows, "formation string, bench string, used array<array<struct<plays:array<boolean>,d:int,m:int,f:int>>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def missing(chances: Column) -> Column:
    """Chances that 0, 1, 2 ... of the players are missing, from the chances that each plays."""
    at = lambda d, k: F.coalesce(F.get(d, k), F.lit(0.0))
    return F.aggregate(chances, F.array(F.lit(1.0)), lambda d, p: F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: at(d, k) * p + at(d, k - 1) * (1 - p)))


def value_of(places: Column, used: Column) -> Column:
    """Expected points of a line-up: an array of 15 struct(position, p, e, starts, captain, deputy), the bench last and in order.

    ``e`` are expected points, the chance ``p`` to play included; the captain counts twice, the deputy where the captain is missing.
    """
    part = lambda test: F.filter(places, test)
    of = lambda position: missing(F.transform(part(lambda x: x["starts"] & (x["position"] == position)), lambda x: x["p"]))
    total = lambda test, worth: F.aggregate(part(test), F.lit(0.0), lambda a, x: a + worth(x))
    given = lambda x: F.when(x["p"] > 0, x["e"] / x["p"]).otherwise(0.0)
    first = lambda test: F.get(part(test), F.lit(0))

    def scored(gone: Column) -> Column:
        bench, keeper, spare, captain, deputy = gone["bench"], gone["keeper"], gone["spare"], gone["captain"], gone["deputy"]
        chance = lambda n: F.get(gone["d"], n["d"]) * F.get(gone["m"], n["m"]) * F.get(gone["f"], n["f"]) * F.aggregate(F.zip_with(n["plays"], bench, lambda on, x: F.when(on, x["p"]).otherwise(1 - x["p"])), F.lit(1.0), lambda a, v: a * v)
        on = F.aggregate(F.zip_with(used, bench, lambda cases, x: given(x) * F.aggregate(cases, F.lit(0.0), lambda a, n: a + chance(n))), F.lit(0.0), lambda a, v: a + v)
        return gone["starters"] + captain["e"] + (1 - captain["p"]) * deputy["e"] + spare["e"] * (1 - keeper["p"]) + on

    facts = F.struct(
        of("DEF").alias("d"), of("MID").alias("m"), of("FWD").alias("f"),
        part(lambda x: ~x["starts"] & (x["position"] != "GKP")).alias("bench"),
        first(lambda x: x["starts"] & (x["position"] == "GKP")).alias("keeper"), first(lambda x: ~x["starts"] & (x["position"] == "GKP")).alias("spare"),
        first(lambda x: x["captain"]).alias("captain"), first(lambda x: x["deputy"]).alias("deputy"),
        total(lambda x: x["starts"], lambda x: x["e"]).alias("starters"),
    )
    return let(facts, scored)


def nominal_lineups(squads: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """``squads`` with ``formation``, ``starts``, ``place`` (0 to 14), ``captain`` and ``deputy``: the eleven with the most expected points.

    Equal players are taken by id, of equal formations the first. Starters stand by position, then
    by points; then come the second keeper and the other substitutes by points.
    """
    spark = squads.sparkSession
    rank = F.row_number().over(Window.partitionBy(*block, "position").orderBy(F.desc("expected_points"), "player_uid"))
    rows = squads.withColumn("_rank", rank)
    legal = spark.createDataFrame([("-".join(map(str, f)), *f) for f in formations(rules)], "formation string, d int, m int, f int")
    taken = F.when(F.col("position") == "GKP", 1).when(F.col("position") == "DEF", F.col("d")).when(F.col("position") == "MID", F.col("m")).otherwise(F.col("f"))
    tried = rows.join(F.broadcast(legal)).filter(F.col("_rank") <= taken)  # a squad of 15 by eight formations
    sums = tried.groupBy(*block, "formation", "d", "m", "f").agg(F.round(F.sum("expected_points"), 9).alias("_points"))
    best = relational.keep_first(sums, block, [F.desc("_points"), F.col("formation")]).drop("_points")
    out = rows.join(best, block).withColumn("starts", F.col("_rank") <= taken)
    of = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position"))
    line = Window.partitionBy(*block).orderBy(F.desc("starts"), F.when(F.col("starts"), of), F.col("position") != "GKP", F.desc("expected_points"), "player_uid")
    lead = F.row_number().over(Window.partitionBy(*block).orderBy(F.desc("starts"), F.desc("expected_points"), "player_uid"))
    return out.withColumns({"place": F.row_number().over(line) - 1, "captain": lead == 1, "deputy": lead == 2}).drop("_rank", "d", "m", "f")


def line_ups(rows: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """(block, formation, places, used): each line-up as one array, with the cases of its substitutes."""
    plays = clip(F.coalesce("p_appearance", F.lit(0.0)), 0, 1)
    place = F.struct("place", "player_uid", "position", plays.alias("p"), F.when(plays > 0, F.col("expected_points")).otherwise(0.0).alias("e"), "starts", "captain", "deputy")
    held = rows.groupBy(*block, "formation").agg(F.array_sort(F.collect_list(place)).alias("places"))
    digit = lambda x: (F.array_position(F.array(*[F.lit(p) for p in FIELD]), x["position"]) - 1).cast("string")
    bench = F.array_join(F.transform(F.filter("places", lambda x: ~x["starts"] & (x["position"] != "GKP")), digit), "")
    return held.withColumn("bench", bench).join(F.broadcast(substitution_table(rows.sparkSession, rules)), ["formation", "bench"]).drop("bench")


def expected_totals(rows: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """(block, formation, expected_total) of line-ups."""
    return line_ups(rows, block, rules).select(*block, "formation", value_of(F.col("places"), F.col("used")).alias("expected_total"))


def place_values(rows: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """(block, player_uid, expected_total, if_plays, if_not, per_point): what each place is worth to whoever holds it.

    With chance p and expected points e in the place, the line-up is worth p * if_plays +
    (1 - p) * if_not + e * per_point, as long as the position is the same: three valuations a place.
    """
    held = line_ups(rows, block, rules)
    names = ("position", "starts", "captain", "deputy")

    def put(i: Column, p: float, e: float) -> Column:
        return F.transform("places", lambda x: F.struct(*[x[n].alias(n) for n in names], F.when(x["place"] == i, p).otherwise(x["p"]).alias("p"), F.when(x["place"] == i, e).otherwise(x["e"]).alias("e")))

    def valued(x: Column) -> Column:
        worth = lambda p, e: value_of(put(x["place"], p, e), F.col("used"))
        three = F.struct(worth(1.0, 0.0).alias("if_plays"), worth(0.0, 0.0).alias("if_not"), worth(1.0, 1.0).alias("with_one"))
        return F.struct(x["player_uid"].alias("player_uid"), three.alias("v"))

    each = held.select(*block, value_of(F.col("places"), F.col("used")).alias("expected_total"), F.explode(F.transform("places", valued)).alias("x"))
    return each.select(*block, "x.player_uid", "expected_total", "x.v.if_plays", "x.v.if_not", (F.col("x.v.with_one") - F.col("x.v.if_plays")).alias("per_point"))


def swap_gains(rows: DataFrame, pool: DataFrame, block: list[str], bank: int, rules: SquadRules = RULES) -> DataFrame:
    """(block, out_uid, in_uid, left, gain) of every affordable swap that keeps the club rule, valued exactly in the line-up as it stands.

    One join of places and candidates by block and position; a swap costs three multiplications.
    """
    values = place_values(rows, block, rules)
    clubs = rows.groupBy(*block, "club").agg(F.count(F.lit(1)).alias("_n"))
    owned = rows.select(*block, F.col("player_uid"), "position", F.col("price_tenths").alias("_out_price"), F.col("club").alias("_out_club")).join(values, [*block, "player_uid"]).withColumnRenamed("player_uid", "out_uid")
    free = pool.join(rows.select(*block, "player_uid"), [*block, "player_uid"], "left_anti").join(clubs, [*block, "club"], "left")
    free = free.select(*block, "position", F.col("player_uid").alias("in_uid"), F.col("price_tenths").alias("_in_price"), F.col("club").alias("_in_club"), F.coalesce("_n", F.lit(0)).alias("_n"), clip(F.coalesce("p_appearance", F.lit(0.0)), 0, 1).alias("_p"), F.col("expected_points").alias("_e"))
    left = F.lit(bank) + F.col("_out_price") - F.col("_in_price")
    fits = F.col("_n") + F.when(F.col("_in_club") == F.col("_out_club"), 0).otherwise(1) <= rules.per_club
    gain = F.col("_p") * F.col("if_plays") + (1 - F.col("_p")) * F.col("if_not") + F.when(F.col("_p") > 0, F.col("_e")).otherwise(0.0) * F.col("per_point") - F.col("expected_total")
    pairs = owned.join(free, [*block, "position"]).filter((left >= 0) & fits)
    return pairs.select(*block, "out_uid", "in_uid", left.cast("long").alias("left"), gain.alias("gain"))

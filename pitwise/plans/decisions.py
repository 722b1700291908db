"""Squad decisions. Candidate pools are built with joins; each decision is searched within its group."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators import relational

POSITIONS = ("GKP", "DEF", "MID", "FWD")


@dataclass(frozen=True)
class SquadRules:
    """Fixed values of the competition."""

    quota: tuple[int, ...] = (2, 5, 5, 3)
    least: tuple[int, ...] = (1, 3, 2, 1)
    most: tuple[int, ...] = (1, 5, 5, 3)
    starters: int = 11
    per_club: int = 3
    budget: int = 1000
    hit: int = 4
    most_free: int = 5
    fee: float = 0.5


RULES = SquadRules()


def value_baseline(df: DataFrame, block: list[str]) -> DataFrame:
    """``expected_points`` as price above the cheapest of the position, in whole units."""
    floor = F.min("price_tenths").over(Window.partitionBy(*block, "position"))
    return df.withColumn("expected_points", F.greatest(F.col("price_tenths") - floor, F.lit(0)) / 10.0)


def prune(df: DataFrame, k: int) -> DataFrame:
    """Candidates among the first ``k`` of their position by points, value, price or appearance."""
    value = F.col("expected_points") / F.greatest(F.col("price_tenths"), F.lit(1))
    return relational.pruned_union(df, "position", [[F.desc("expected_points")], [value.desc()], [F.col("price_tenths").asc()], [F.desc("p_appearance")]], k, "player_uid")


def undominated(pools: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """``pools`` without candidates that enough cheaper-or-equal and better-or-equal rivals of their club and position make needless.

    Enough rivals there are if the n-th best of those before, by price, is no worse. The n-th
    best runs along as a maximum: what a row adds to it is the lesser of its own points and the
    best so far one place up. So no list of rivals is held.
    """
    w = Window.partitionBy(*block, "position", "club").orderBy(F.col("price_tenths"), F.desc("expected_points"), "player_uid").rowsBetween(Window.unboundedPreceding, -1)
    df, own = pools, F.col("expected_points")
    for n in range(1, rules.per_club + 1):
        df = df.withColumn(f"_best{n}", F.max(own).over(w))
        df = df.withColumn(f"_own{n}", F.when(F.col(f"_best{n}").isNotNull(), F.least(own, F.col(f"_best{n}"))))
        own = F.col(f"_own{n}")
    enough = None
    for p, q in zip(POSITIONS, rules.quota, strict=True):
        test = F.col(f"_best{min(rules.per_club, q)}") >= F.col("expected_points")
        enough = F.when(F.col("position") == p, test) if enough is None else enough.when(F.col("position") == p, test)
    kept = df.filter(~F.coalesce(enough, F.lit(False)))
    return kept.drop(*[f"_{k}{n}" for k in ("best", "own") for n in range(1, rules.per_club + 1)])


#: What breaks ties of points and points per price: appearance, price, name and id.
FINDER_TIES = (F.desc, "p_appearance"), (F.asc, "price_tenths"), (F.asc, "player_name"), (F.asc, "player_uid")


def finder(df: DataFrame, budget: Column, k: int = 5, baseline: Column | None = None, ties=FINDER_TIES) -> DataFrame:
    """The best value within a budget: points, then points per price, then ``ties``; ``delta`` over a baseline."""
    per = F.col("expected_points") / (F.col("price_tenths") / 10.0)
    keys = [F.desc("expected_points"), F.desc("points_per_million"), *[way(name) for way, name in ties]]
    found = df.filter(F.col("price_tenths") <= budget).withColumn("points_per_million", per)
    if baseline is not None:
        found = found.withColumn("delta", F.col("expected_points") - baseline)
    return found.orderBy(*keys).limit(k)


def role_label(role: str = "selected_role", order: str = "bench_order") -> Column:
    """What a squad row is shown as: its place on the bench, else captain, vice captain or starter."""
    place = F.col(order).cast("int")
    bench = F.when(place == 1, "Bench goalkeeper").otherwise(F.concat(F.lit("Bench "), (place - 1).cast("string")))
    return F.when(F.coalesce(place > 0, F.lit(False)), bench).when(F.col(role) == "captain", "Captain").when(F.col(role) == "vice_captain", "Vice captain").otherwise("Starter")


def squad_sheet(df: DataFrame, block: list[str]) -> DataFrame:
    """Squad rows with ``on_bench``, ``shown_at`` (starters first, then the bench in order) and ``label``."""
    bench = F.coalesce(F.col("bench_order") > 0, F.lit(False)) | F.coalesce(F.col("selected_role") == "squad", F.lit(False))
    order = Window.partitionBy(*block).orderBy("on_bench", F.when(F.col("on_bench"), F.col("bench_order")), "player_uid")  # a squad
    return df.withColumn("on_bench", bench).withColumns({"shown_at": F.row_number().over(order), "label": role_label()})


def sorted_projection(df: DataFrame, ascending: bool = False) -> DataFrame:
    """By expected points, either way; ids break ties."""
    points = F.col("expected_points")
    return df.orderBy(points.asc() if ascending else points.desc(), "player_uid")


# ---------------------------------------------------------------- line-ups


@cache
def _elevens(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64)


def _counts(position: np.ndarray, picks: np.ndarray) -> np.ndarray:
    return np.stack([(position[picks] == p).sum(1) for p in range(len(POSITIONS))], 1)


def best_lineup(squad: pd.DataFrame, rules: SquadRules = RULES) -> dict:
    """The legal eleven with the highest points, captain twice, deputy and bench discounted."""
    squad = squad.sort_values("player_uid").reset_index(drop=True)
    position = squad.position.map(POSITIONS.index).to_numpy()
    e, p = squad.expected_points.to_numpy(float), squad.p_appearance.to_numpy(float)
    picks = _elevens(len(squad), rules.starters)
    counts = _counts(position, picks)
    picks = picks[((counts >= rules.least) & (counts <= rules.most)).all(1)]
    if not len(picks):
        raise ValueError("no legal eleven")
    order = np.argsort(-e[picks], 1, kind="stable")
    captain, deputy = np.take_along_axis(picks, order[:, :1], 1)[:, 0], np.take_along_axis(picks, order[:, 1:2], 1)[:, 0]
    off = np.ones((len(picks), len(squad)), bool)
    off[np.arange(len(picks))[:, None], picks] = False
    bench = np.stack([np.flatnonzero(o) for o in off])
    rank = np.where(position[bench] == 0, -np.inf, -e[bench])
    bench = np.take_along_axis(bench, np.argsort(rank, 1, kind="stable"), 1)
    weights = 1 - 0.05 * np.arange(1, bench.shape[1] + 1)
    value = e[picks].sum(1) + e[captain] + e[deputy] * (1 - p[captain]) + 0.05 * (e[bench] * weights).sum(1)
    best = np.flatnonzero(np.isclose(value, value.max(), atol=1e-10))
    i = max(best, key=lambda j: ",".join(sorted(squad.player_uid[picks[j]].astype(str))))
    ids = squad.player_uid.to_numpy()
    return {"lineup": ids[picks[i]].tolist(), "captain": ids[captain[i]], "deputy": ids[deputy[i]], "bench": ids[bench[i]].tolist(), "objective": float(value[i]), "formation": "-".join(str((position[picks[i]] == k).sum()) for k in (1, 2, 3))}


def substitutions(start: np.ndarray, bench: np.ndarray, plays: np.ndarray, rules: SquadRules = RULES) -> tuple[np.ndarray, np.ndarray]:
    """Which bench players come on, and starters who stay unreplaced, for many states at once.

    ``start`` and ``bench`` are positions in order, ``plays`` is states x (starters + bench).
    Absent starters are replaced in order by the first bench player who plays and keeps the eleven
    legal; goalkeepers only by goalkeepers.
    """
    n, s = len(plays), len(start)
    counts = np.tile([(start == p).sum() for p in range(len(POSITIONS))], (n, 1))
    used, missing = np.zeros((n, len(bench)), bool), np.zeros(n, int)
    least, most = np.array(rules.least), np.array(rules.most)
    for i, position in enumerate(start):
        need = ~plays[:, i]
        for j, other in enumerate(bench):
            if (position == 0) != (other == 0):
                continue
            trial = counts.copy()
            trial[:, position] -= 1
            trial[:, other] += 1
            go = need & plays[:, s + j] & ~used[:, j] & ((trial >= least) & (trial <= most)).all(1)
            used[go, j], need = True, need & ~go
            counts[go] = trial[go]
        missing += need
    return used, missing


@cache
def _states(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)


def expected_realised(squad: pd.DataFrame, choice: dict, rules: SquadRules = RULES) -> dict:
    """Exact expected points of a line-up over all states of who plays, substitutes and captaincy included."""
    rows = squad.set_index("player_uid").loc[[*choice["lineup"], *choice["bench"]]]
    position = rows.position.map(POSITIONS.index).to_numpy()
    p, e = rows.p_appearance.clip(0, 1).to_numpy(float), rows.expected_points.to_numpy(float)
    given = np.where(p > 0, e / np.where(p > 0, p, 1), 0.0)
    plays = _states(len(rows))
    weight = np.where(plays, p, 1 - p).prod(1)
    s = len(choice["lineup"])
    used, missing = substitutions(position[:s], position[s:], plays, rules)
    captain, deputy = rows.index.get_loc(choice["captain"]), rows.index.get_loc(choice["deputy"])
    parts = {
        "starters": float(weight @ (plays[:, :s] @ given[:s])),
        "substitutes": float(weight @ (used @ given[s:])),
        "captain": float(weight @ plays[:, captain]) * given[captain],
        "deputy": float(weight @ (~plays[:, captain] & plays[:, deputy])) * given[deputy],
        "p_unreplaced": float(weight @ (missing > 0)),
    }
    parts["total"] = parts["starters"] + parts["substitutes"] + parts["captain"] + parts["deputy"]
    return parts


def slot_values(squad: pd.DataFrame, choice: dict, rules: SquadRules = RULES) -> pd.DataFrame:
    """(player_uid, if_plays, if_not, per_point) of each place of a line-up.

    The expected realised points are linear in each player: with chance p and expected points e in
    the place, the total is p * if_plays + (1 - p) * if_not + e * per_point, whoever holds it, as
    long as the position is the same. So one pass over the states values all replacements.
    """
    rows = squad.set_index("player_uid").loc[[*choice["lineup"], *choice["bench"]]]
    position = rows.position.map(POSITIONS.index).to_numpy()
    p, e = rows.p_appearance.clip(0, 1).to_numpy(float), rows.expected_points.to_numpy(float)
    given = np.where(p > 0, e / np.where(p > 0, p, 1), 0.0)
    plays, s = _states(len(rows)), len(choice["lineup"])
    used, _ = substitutions(position[:s], position[s:], plays, rules)
    counts = np.concatenate([plays[:, :s], used], 1).astype(float)
    captain, deputy = rows.index.get_loc(choice["captain"]), rows.index.get_loc(choice["deputy"])
    counts[:, captain] += plays[:, captain]
    counts[:, deputy] += ~plays[:, captain] & plays[:, deputy]
    total, chance = counts @ given, np.where(plays, p, 1 - p)
    out = []
    for i, uid in enumerate(rows.index):
        rest = np.delete(chance, i, 1).prod(1)
        others, on = total - counts[:, i] * given[i], plays[:, i]
        out.append((uid, float(rest[on] @ others[on]), float(rest[~on] @ others[~on]), float(rest[on] @ counts[on, i])))
    return pd.DataFrame(out, columns=["player_uid", "if_plays", "if_not", "per_point"])


def best_realised_lineup(squad: pd.DataFrame, rules: SquadRules = RULES, shortlist: int = 8) -> dict:
    """The line-up with the most expected realised points among a shortlist, then over all orders of its bench.

    The shortlist holds the legal elevens of highest worth by points, best captain and deputy
    and discounted bench; each is scored exactly. A long enough shortlist holds all elevens.
    """
    squad = squad.sort_values("player_uid").reset_index(drop=True)
    position = squad.position.map(POSITIONS.index).to_numpy()
    e, p, ids = squad.expected_points.to_numpy(float), squad.p_appearance.clip(0, 1).to_numpy(float), squad.player_uid.to_numpy()
    picks = _elevens(len(squad), rules.starters)
    counts = _counts(position, picks)
    picks = picks[((counts >= rules.least) & (counts <= rules.most)).all(1)]
    if not len(picks):
        raise ValueError("no legal eleven")
    pair = e[:, None] + (1 - p)[:, None] * e[None, :]
    np.fill_diagonal(pair, -np.inf)
    worth = e[picks].sum(1) + np.array([pair[np.ix_(k, k)].max() for k in picks]) + 0.1 * (e.sum() - e[picks].sum(1))

    def scored(pick: np.ndarray, order: tuple | None) -> tuple[float, dict]:
        c, d = np.unravel_index(pair[np.ix_(pick, pick)].argmax(), (len(pick), len(pick)))
        off = [j for j in range(len(squad)) if j not in set(pick.tolist())]
        keepers, field = [j for j in off if position[j] == 0], sorted((j for j in off if position[j] != 0), key=lambda j: (-e[j], j))
        choice = {"lineup": ids[pick].tolist(), "bench": ids[[*keepers, *(order or field)]].tolist(), "captain": ids[pick[c]], "deputy": ids[pick[d]], "field": field}
        return expected_realised(squad, choice, rules)["total"], choice

    first = [(*scored(picks[i], None), i) for i in np.argsort(-worth, kind="stable")[:shortlist]]
    value, choice, i = max(first, key=lambda f: (round(f[0], 12), -f[2]))
    for order in permutations(choice["field"]):
        other, made = scored(picks[i], order)
        if other > value + 1e-12:
            value, choice = other, made
    formation = "-".join(str(int((position[picks[i]] == k).sum())) for k in (1, 2, 3))
    return {**{k: v for k, v in choice.items() if k != "field"}, "objective": value, "formation": formation}


def realised(squad: pd.DataFrame, choice: dict, rules: SquadRules = RULES) -> dict:
    """Points that a line-up scored, after substitutions and the captain's or deputy's double."""
    rows = squad.set_index("player_uid").loc[[*choice["lineup"], *choice["bench"]]]
    plays = (rows.actual_minutes > 0).to_numpy()
    s = len(choice["lineup"])
    position = rows.position.map(POSITIONS.index).to_numpy()
    used, missing = substitutions(position[:s], position[s:], plays[None], rules)
    on = np.concatenate([plays[:s], used[0]])
    points = rows.actual_points.to_numpy(float)
    double = next((rows.index.get_loc(c) for c in (choice["captain"], choice["deputy"]) if plays[rows.index.get_loc(c)]), None)
    return {"points": float(points[on].sum() + (points[double] if double is not None else 0.0)), "substitutes": int(used.sum()), "unreplaced": int(missing[0])}


# ------------------------------------------------------------------- squads


def _position_table(e: np.ndarray, price: np.ndarray, quota: int, budget: int):
    """best[captain, starters, bench, budget] for one position, and the choice of each player that led there."""
    best = np.full((2, quota + 1, quota + 1, budget + 1), -np.inf)
    best[0, 0, 0] = 0.0
    picks = np.zeros((len(e), *best.shape), np.int8)
    for i, (x, c) in enumerate(zip(e, price, strict=True)):
        if c > budget:
            continue
        old, head = best.copy(), budget + 1 - c
        for code, (dst, src, gain) in enumerate((((slice(None), slice(None), slice(1, None)), (slice(None), slice(None), slice(0, -1)), 0.0), ((slice(None), slice(1, None), slice(None)), (slice(None), slice(0, -1), slice(None)), x), ((slice(1, 2), slice(1, None), slice(None)), (slice(0, 1), slice(0, -1), slice(None)), 2 * x)), 1):
            new = old[src][..., :head] + gain
            view, mark = best[dst][..., c:], picks[i][dst][..., c:]
            better = new > view
            view[better] = new[better]
            mark[better] = code
    return best, picks


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) of two tables over how the budget is split."""
    out = np.full(len(a), -np.inf)
    for x in np.flatnonzero(np.isfinite(a) & np.concatenate([[True], a[1:] > a[:-1]])):
        np.maximum(out[x:], a[x] + b[: len(b) - x], out=out[x:])
    return out


def _relaxed(pool: pd.DataFrame, rules: SquadRules) -> tuple[float, list[int], list[int], int]:
    """The best squad when clubs don't matter: (value, squad rows, starter rows, captain row)."""
    tables, members = [], []
    for k, position in enumerate(POSITIONS):
        at = np.flatnonzero(pool.position == position)
        members.append(at)
        tables.append(_position_table(pool.expected_points.to_numpy(float)[at], pool.price_tenths.to_numpy(int)[at], rules.quota[k], rules.budget))
    best, plan = -np.inf, None
    for d in range(rules.least[1], rules.most[1] + 1):
        for m in range(rules.least[2], rules.most[2] + 1):
            f = rules.starters - 1 - d - m
            if not rules.least[3] <= f <= rules.most[3]:
                continue
            starts = (1, d, m, f)
            one = [[t[0][c, s, q - s] for c in (0, 1)] for t, s, q in zip(tables, starts, rules.quota, strict=True)]
            for captain in range(4):
                chain = one[0][int(captain == 0)]
                for k in (1, 2, 3):
                    chain = _plus(chain, one[k][int(captain == k)])
                if chain[-1] > best + 1e-12:
                    best, plan = float(chain[-1]), (starts, captain)
    if plan is None:
        return -np.inf, [], [], -1
    starts, captain = plan
    squad, eleven, armband, left = [], [], -1, rules.budget
    # split the budget again, position by position, then read the picks back
    rest = [None] * 5
    rest[4] = np.zeros(rules.budget + 1)
    for k in (3, 2, 1, 0):
        rest[k] = _plus(tables[k][0][int(captain == k), starts[k], rules.quota[k] - starts[k]], rest[k + 1])
    for k in range(4):
        own = tables[k][0][int(captain == k), starts[k], rules.quota[k] - starts[k]]
        spend = next(x for x in range(left + 1) if np.isclose(own[x] + rest[k + 1][left - x], rest[k][left]))
        c, s, b, money = int(captain == k), starts[k], rules.quota[k] - starts[k], spend
        for i in range(len(members[k]) - 1, -1, -1):
            code = tables[k][1][i][c, s, b, money]
            if not code:
                continue
            row = int(members[k][i])
            squad.append(row)
            money -= int(pool.price_tenths.iloc[row])
            if code == 1:
                b -= 1
            else:
                eleven.append(row)
                s -= 1
                if code == 3:
                    armband, c = row, 0
        left -= spend
    return best, squad, eleven, armband


def optimal_squad(pool: pd.DataFrame, rules: SquadRules = RULES, node_limit: int = 200) -> dict:
    """Exact best squad: budget tables without the club rule, and branching where a club has too many.

    Best-first: a node forbids some candidates; its relaxed value bounds all below it. The first
    node that keeps the club rule is optimal. Past ``node_limit`` the best node is mended by
    forbidding the weakest of a crowded club until the rule holds: status ``feasible``, and
    ``bound`` tells how much better an optimum could be at most.
    """
    import heapq

    pool = pool.sort_values("player_uid").reset_index(drop=True)
    heap, seen, nodes = [], set(), 0

    def push(banned: frozenset) -> None:
        if banned in seen:
            return
        seen.add(banned)
        kept = pool[~pool.index.isin(banned)]
        value, squad, eleven, armband = _relaxed(kept.reset_index(drop=True), rules)
        if squad:
            rows = kept.index.to_numpy()
            heapq.heappush(heap, (-value, sorted(banned), banned, rows[squad].tolist(), rows[eleven].tolist(), int(rows[armband])))

    def answer(status: str, value: float, bound: float, squad: list, eleven: list, armband: int) -> dict:
        ids = pool.player_uid
        return {"status": status, "objective": value, "bound": bound, "squad": sorted(ids.iloc[squad]), "lineup": sorted(ids.iloc[eleven]), "captain": ids.iloc[armband], "cost": int(pool.price_tenths.iloc[squad].sum()), "nodes": nodes}

    push(frozenset())
    while heap and nodes < node_limit:
        value, _, banned, squad, eleven, armband = heapq.heappop(heap)
        nodes += 1
        clubs = pool.club.iloc[squad].value_counts()
        crowded = clubs[clubs > rules.per_club]
        if crowded.empty:
            return answer("optimal", -value, -value, squad, eleven, armband)
        for row in [r for r in squad if pool.club.iloc[r] == crowded.index[0]]:
            push(banned | {row})
    if not heap:
        return {"status": "infeasible", "objective": None, "bound": None, "squad": [], "lineup": [], "captain": None, "cost": 0, "nodes": nodes}
    bound, _, banned, squad, eleven, armband = heap[0]
    value = bound
    while True:
        clubs = pool.club.iloc[squad].value_counts()
        crowded = clubs[clubs > rules.per_club]
        if crowded.empty:
            return answer("feasible", -value, -bound, squad, eleven, armband)
        heap, of = [], [r for r in squad if pool.club.iloc[r] == crowded.index[0]]
        for row in sorted(of, key=lambda r: (pool.expected_points.iloc[r], r)):
            seen.clear()
            push(banned | {row})
            if heap:
                break
        if not heap:
            return {"status": "bound_only", "objective": None, "bound": -bound, "squad": [], "lineup": [], "captain": None, "cost": 0, "nodes": nodes}
        value, _, banned, squad, eleven, armband = heapq.heappop(heap)


SQUAD_SCHEMA = "status string, objective double, bound double, squad string, lineup string, captain long, bench string, formation string, cost long, expected_total double, p_unreplaced double"


def decide(pools: DataFrame, block: list[str], rules: SquadRules = RULES) -> DataFrame:
    """One decision per block: exact squad, line-up of it, expected realised points.

    Pools are a block's candidates after safe pruning: of a club and position only those not
    dominated by enough rivals.
    """
    kept = undominated(pools, block, rules)
    kinds = {f.name: f.dataType.simpleString() for f in pools.schema if f.name in block}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = optimal_squad(rows, rules)
        out = dict(zip(block, key, strict=True)) | {"status": found["status"], "objective": found["objective"], "bound": found["bound"], "cost": found["cost"]}
        if found["squad"]:
            squad = rows[rows.player_uid.isin(found["squad"])]
            choice = best_lineup(squad, rules)
            value = expected_realised(squad, choice, rules)
            out |= {"squad": ",".join(map(str, found["squad"])), "lineup": ",".join(map(str, sorted(choice["lineup"]))), "captain": choice["captain"], "bench": ",".join(map(str, choice["bench"])), "formation": choice["formation"], "expected_total": value["total"], "p_unreplaced": value["p_unreplaced"]}
        names = [*block, *[c.split()[0] for c in SQUAD_SCHEMA.split(", ")]]
        return pd.DataFrame([{n: out.get(n) for n in names}])

    return kept.groupBy(*block).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in block) + ", " + SQUAD_SCHEMA)


def swap_options(squad: DataFrame, pool: DataFrame, block: list[str], bank: Column, k: int = 3) -> DataFrame:
    """For each owned player the best ``k`` affordable replacements of the position that the squad lacks.

    What an owned player may spend decides: of each price only the first ``k`` free players count, and
    of all prices up to a limit again ``k``. So no owned player meets the whole pool; work grows with
    the rows, and with limits times prices.
    """
    place = [*block, "position"]
    first = [F.desc("expected_points"), F.col("in_uid")]
    owned = squad.select(*block, F.col("player_uid").alias("out_uid"), "position", F.col("price_tenths").alias("out_price"), F.col("expected_points").alias("out_points"), (F.col("price_tenths") + bank).alias("_limit"))
    free = pool.join(squad.select(*block, "player_uid"), [*block, "player_uid"], "left_anti").select(*block, F.col("player_uid").alias("in_uid"), "position", "price_tenths", "expected_points")
    priced = relational.top_per_group(free, [*place, "price_tenths"], first, k)
    open_ = owned.select(*place, "_limit").distinct().join(priced.drop("rank"), place).filter(F.col("price_tenths") <= F.col("_limit"))
    best = relational.top_per_group(open_, [*place, "_limit"], first, k)
    found = owned.join(best, [*place, "_limit"]).withColumn("gain", F.col("expected_points") - F.col("out_points"))
    return found.select(*place, "out_uid", "out_price", "in_uid", "price_tenths", "gain", "rank")


def plan_transfers(squad: pd.DataFrame, weeks: dict[int, pd.DataFrame], bank: int, free: int, most: int = 1, rules: SquadRules = RULES) -> dict:
    """The best plan over some weeks by full search: transfers, hits and banked moves against line-up values.

    For small horizons and pools, as in one group; every legal plan of up to ``most`` moves a week is tried.
    """
    best: tuple[float, list] = (-np.inf, [])
    order = sorted(weeks)

    def legal(rows: pd.DataFrame) -> bool:
        counts = rows.position.value_counts()
        return all(counts.get(p, 0) == q for p, q in zip(POSITIONS, rules.quota, strict=True)) and rows.club.value_counts().max() <= rules.per_club

    def visit(i: int, paid: dict, money: int, saved: int, total: float, steps: list) -> None:
        nonlocal best
        if i == len(order):
            if total > best[0] + 1e-12:
                best = (total, steps)
            return
        rows = weeks[order[i]].set_index("player_uid", drop=False)
        options = [((), ())]
        if most:
            options += [((o,), (n,)) for o in sorted(paid) for n in sorted(set(rows.index) - set(paid)) if rows.position[n] == rows.position[o]]
        for out, into in options:
            now = {o: int(rows.price_tenths[o]) for o in out}
            back = sum(min(p, paid[o]) if p <= paid[o] else paid[o] + int((p - paid[o]) * (1 - rules.fee)) for o, p in now.items())
            left = money + back - sum(int(rows.price_tenths[n]) for n in into)
            held = {**{k: v for k, v in paid.items() if k not in out}, **{n: int(rows.price_tenths[n]) for n in into}}
            team = rows.loc[sorted(held)]
            if left < 0 or not legal(team):
                continue
            hit = max(0, len(into) - saved) * rules.hit
            value = best_lineup(team.reset_index(drop=True), rules)["objective"] - hit
            visit(i + 1, held, left, min(rules.most_free, max(0, saved - len(into)) + 1), total + value, [*steps, (order[i], out, into, hit)])

    visit(0, dict(zip(squad.player_uid, squad.price_tenths.astype(int), strict=True)), bank, free, 0.0, [])
    return {"objective": best[0], "steps": best[1]}


def audit(choices: DataFrame, rules: SquadRules = RULES) -> DataFrame:
    """Per squad (block columns of the input and rows of its players): which rule, if any, it breaks."""
    count = lambda p: F.count_if(F.col("position") == p)
    quota_ok = None
    for p, q in zip(POSITIONS, rules.quota, strict=True):
        quota_ok = count(p) == q if quota_ok is None else quota_ok & (count(p) == q)
    block = [c for c in choices.columns if c not in ("player_uid", "position", "club", "price_tenths")]
    clubs = choices.groupBy(*block, "club").count().groupBy(*block).agg(F.max("count").alias("most_of_a_club"))
    sums = choices.groupBy(*block).agg(quota_ok.alias("quota_ok"), F.sum("price_tenths").alias("cost"), F.count(F.lit(1)).alias("players"))
    return sums.join(clubs, block).withColumns({"budget_ok": F.col("cost") <= rules.budget, "clubs_ok": F.col("most_of_a_club") <= rules.per_club})


_MEMBER = "player_uid bigint, position string, club string, price_tenths bigint, expected_points double, p_appearance double"
_SLOT = f"{_MEMBER}, if_plays double, if_not double, per_point double"


def local_search(pools: DataFrame, block: list[str], rounds: int = 3, rules: SquadRules = RULES, seeds: DataFrame | None = None) -> DataFrame:
    """(block, squad, expected_total, moves): the exact squad of each block, bettered by single swaps scored by expected realised points.

    Every legal swap with the block's whole pool is scored, as a join of the squad's places with
    the candidates of their position and an expression over ``slot_values``; Python sees a squad of
    fifteen at a time. The best swap of a round is taken if it gains; the line-up is then chosen
    anew, by points within the rounds and by expected realised points at the end.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pools.schema if f.name in block}
    keys = ", ".join(f"{b} {kinds[b]}" for b in block)
    members = [c.split()[0] for c in _MEMBER.split(", ")]

    def seeded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = optimal_squad(rows, rules)
        squad = rows[rows.player_uid.isin(found["squad"])]
        return pd.DataFrame([{**dict(zip(block, key, strict=True)), "squad": squad[members].to_dict("records"), "moves": 0}] if len(squad) else [], columns=[*block, "squad", "moves"])

    def valued(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                squad = pd.DataFrame(list(row["squad"]))
                slots = squad.merge(slot_values(squad, best_lineup(squad, rules), rules), on="player_uid")
                one = slots.iloc[0]
                chance = min(max(one.p_appearance, 0.0), 1.0)
                total = chance * one.if_plays + (1 - chance) * one.if_not + (one.expected_points if chance > 0 else 0.0) * one.per_point
                out.append({**{b: row[b] for b in block}, "slots": slots.to_dict("records"), "total": total, "moves": row["moves"]})
            yield pd.DataFrame(out, columns=[*block, "slots", "total", "moves"])

    def chosen(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                squad = pd.DataFrame(list(row["squad"]))
                nominal = expected_realised(squad, best_lineup(squad, rules), rules)["total"]
                out.append({**{b: row[b] for b in block}, "squad": ",".join(map(str, sorted(squad.player_uid))), "expected_total": max(nominal, best_realised_lineup(squad, rules)["objective"]), "moves": row["moves"]})
            yield pd.DataFrame(out, columns=[*block, "squad", "expected_total", "moves"])

    state = undominated(pools, block, rules).groupBy(*block).applyInPandas(seeded, f"{keys}, squad array<struct<{_as_fields(_MEMBER)}>>, moves bigint") if seeds is None else seeds
    shape = f"{keys}, slots array<struct<{_as_fields(_SLOT)}>>, total double, moves bigint"
    for _ in range(rounds):
        places = state.mapInPandas(valued, shape).withColumn("out", F.explode("slots"))
        rivals = pools.select(*block, F.col("position").alias("_position"), F.struct(*members).alias("into"))
        same = F.col("out.position") == F.col("_position")
        for b in block:
            same = same & (F.col(f"s.{b}") == F.col(f"r.{b}"))
        pairs = places.alias("s").join(rivals.alias("r"), same, "left").select(*[f"s.{b}" for b in block], "slots", "total", "moves", "out", "into")
        spent = F.aggregate("slots", F.lit(0).cast("long"), lambda a, x: a + x["price_tenths"])
        mates = F.size(F.filter("slots", lambda x: (x["club"] == F.col("into.club")) & (x["player_uid"] != F.col("out.player_uid"))))
        held = F.exists("slots", lambda x: x["player_uid"] == F.col("into.player_uid"))
        legal = ~held & (mates < rules.per_club) & (spent - F.col("out.price_tenths") + F.col("into.price_tenths") <= rules.budget)
        p = F.least(F.greatest(F.col("into.p_appearance"), F.lit(0.0)), F.lit(1.0))
        worth = p * F.col("out.if_plays") + (1 - p) * F.col("out.if_not") + F.when(p > 0, F.col("into.expected_points")).otherwise(0.0) * F.col("out.per_point")
        gain = F.when(F.coalesce(legal, F.lit(False)) & (worth > F.col("total") + 1e-9), F.struct(worth.alias("worth"), (-F.col("out.player_uid")).alias("o"), (-F.col("into.player_uid")).alias("i"), "out", "into"))
        best = pairs.groupBy(*block).agg(F.max(gain).alias("best"), F.first("slots").alias("slots"), F.first("moves").alias("moves"))
        stays = F.transform("slots", lambda x: F.struct(*[x[m].alias(m) for m in members]))
        swapped = F.transform(stays, lambda x: F.when(x["player_uid"] == F.col("best.out.player_uid"), F.col("best.into")).otherwise(x))
        state = best.select(*block, F.when(F.col("best").isNull(), stays).otherwise(swapped).alias("squad"), (F.col("moves") + F.col("best").isNotNull().cast("long")).alias("moves"))
    return state.mapInPandas(chosen, f"{keys}, squad string, expected_total double, moves bigint")


def _as_fields(ddl: str) -> str:
    return ", ".join(c.replace(" ", ": ", 1) for c in ddl.split(", "))


def transfer_options(squad: DataFrame, pool: DataFrame, block: list[str], bank: int, per_player: int = 6) -> DataFrame:
    """(block, out_uid, out_price, out_club, in_uid, in_price, in_club, gain): each owned player's best affordable replacements."""
    options = swap_options(squad, pool, block, F.lit(bank), per_player)
    club = lambda df, uid, name: df.select(*block, F.col("player_uid").alias(uid), F.col("club").alias(name))
    options = options.join(club(pool, "in_uid", "in_club"), [*block, "in_uid"]).join(club(squad, "out_uid", "out_club"), [*block, "out_uid"])
    return options.select(*block, "out_uid", "out_price", "out_club", "in_uid", F.col("price_tenths").alias("in_price"), "in_club", "gain")


def legal_transfer_sets(squad: DataFrame, options: DataFrame, block: list[str], bank: int, most: int = 3, rules: SquadRules = RULES) -> DataFrame:
    """(block, gain, bank, moves) of every legal set of up to ``most`` transfers, none included; ``moves`` in the order of who leaves.

    Sets grow by one transfer a step, joined with the options of players who come later, so each set
    is made once. Nothing is cut off on the way: a set that breaks a rule may be mended by a later
    transfer, and rules are asked of whole sets. A block has a squad's options only, 15 times
    the replacements of a player, however large its pool is. A transfer may bring no one twice.
    """
    own = squad.groupBy(*block).agg(F.collect_list("club").alias("_clubs"))
    kinds = {c: options.schema[c].dataType.simpleString() for c in ("out_uid", "in_uid", "out_club")}
    state = {"_last": f"cast(null as {kinds['out_uid']})", "moves": f"cast(array() as array<struct<o:{kinds['out_uid']},i:{kinds['in_uid']}>>)", "_gone": f"cast(array() as array<{kinds['out_club']}>)", "_come": f"cast(array() as array<{kinds['out_club']}>)", "gain": "0D", "bank": f"cast({bank} as bigint)"}
    sets = own.select(*block, "_clubs", *[F.expr(e).alias(n) for n, e in state.items()])
    every, step = sets, sets
    side = options.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(block)], "out_uid", "out_price", "out_club", "in_uid", "in_price", "in_club", F.col("gain").alias("_g"))
    for _ in range(most):
        later = F.col("_last").isNull() | (F.col("out_uid") > F.col("_last"))
        fresh = ~F.exists("moves", lambda m: m["i"] == F.col("in_uid"))
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(block)])
        step = step.join(side, same & later & fresh).select(
            *block, "_clubs", F.col("out_uid").alias("_last"), F.array_append("moves", F.struct(F.col("out_uid").alias("o"), F.col("in_uid").alias("i"))).alias("moves"),
            F.array_append("_gone", F.col("out_club")).alias("_gone"), F.array_append("_come", F.col("in_club")).alias("_come"),
            (F.col("gain") + F.col("_g")).alias("gain"), (F.col("bank") + F.col("out_price") - F.col("in_price")).alias("bank"),
        )
        every = every.unionByName(step)
    number = lambda clubs, c: F.size(F.filter(clubs, lambda x: x == c))
    held = lambda c: number(F.col("_clubs"), c) - number(F.col("_gone"), c) + number(F.col("_come"), c)
    clubs_ok = F.forall(F.array_distinct(F.concat("_clubs", "_come")), lambda c: held(c) <= rules.per_club)
    return every.filter((F.col("bank") >= 0) & clubs_ok).select(*block, "gain", "bank", "moves")


def transfer_sets(squad: DataFrame, pool: DataFrame, block: list[str], bank: int, most: int = 3, per_player: int = 6, keep: int = 5, rules: SquadRules = RULES) -> DataFrame:
    """(block, rank, gain, moves): the best of all legal sets of up to ``most`` transfers of each block.

    Each owned player has the ``per_player`` best affordable replacements to choose from. Equal gains
    are told apart by the ids, in order.
    """
    legal = legal_transfer_sets(squad, transfer_options(squad, pool, block, bank, per_player), block, bank, most, rules)
    best = relational.top_per_group(legal.withColumn("gain", F.round("gain", 9)), block, [F.desc("gain"), F.col("moves")], keep)
    told = F.array_join(F.transform("moves", lambda m: F.concat(m["o"].cast("string"), F.lit(">"), m["i"].cast("string"))), "; ")
    return best.select(*block, "rank", "gain", told.alias("moves"))

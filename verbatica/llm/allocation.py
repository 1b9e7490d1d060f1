"""Splits that keep related records together.

Records of one group (a speaker, a source, any entity) are a component and land in one split. Components of the same
size and label are a bundle; how many rows of each bundle go to each split is a min-cost flow whose costs are the
deviations from the quotas of every label and of the whole; the flow is rounded to whole components, and the members of
a bundle are told apart by the order of their hashes.

Only bundles reach the driver: sizes of one label add up to its rows, so there are at most ``sqrt(2 * rows)`` distinct
ones a label, whatever the number of groups. Rows never do, and a group that holds a third of all rows is one number.

Defined results: a null label is a label of its own; a record without a known group is a component by itself, together
with the records of the same identifier; a record with neither by its own identifier, without that by its content; repeated rows count each; a component
larger than a split's quota goes to the largest split; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key, grouped_prefix_sum, unit_hash
from ..session import cut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def speaker_key(language: Column, speaker: Column) -> Column:
    """``language:number`` of a speaker, however it is written; null where no speaker is named.

    The session (a slash, s and a number) is dropped, the last number counts, leading zeros do not. A value without a
    digit is a filler.
    """
    bare = F.regexp_replace(speaker, r"(?i)\s*/\s*s\s*\d+\s*$", "")
    number = F.regexp_replace(F.regexp_extract(bare, r"(\d+)\D*$", 1), r"^0+(?=\d)", "")
    return F.when(number != "", F.concat_ws(":", F.lower(F.trim(language)), number))


def split_name(split: Column) -> Column:
    """train, validation or test; null for anything else."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s == "train", "train").when(s.isin("validation", "val", "dev", "valid"), "validation").when(s == "test", "test")


def group_leaks(df: DataFrame, id_col: str, group: Column, split: Column) -> DataFrame:
    """(id): rows of an evaluation split whose group also has a row in train.

    One partial aggregate gives each group's number of evaluation rows and whether it is trained on; the row table
    meets only the groups that break the rule, hot ones by broadcast.
    """
    rows = cut(df.select(F.col(f"`{id_col}`").alias("id"), group.alias("grp"), split.alias("split")).filter("grp IS NOT NULL AND split IS NOT NULL"))
    held = rows.filter("split <> 'train'")
    facts = rows.groupBy("grp").agg(F.count_if(F.col("split") != "train").alias("n_eval"), F.count_if(F.col("split") == "train").alias("n_train"))
    broken = facts.filter("n_eval > 0 AND n_train > 0").select("grp", "n_eval")
    return attach_by_key(held, broken, "grp", "n_eval", held.count()).select("id").filter("id IS NOT NULL")


def quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the proportions of ``shares`` that add up to ``total`` (largest remainders)."""
    whole = sum(shares.values())
    exact = {k: total * v / whole for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


class MinCostFlow:
    """Successive shortest paths on a small graph with integer capacities and costs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def push(self, path: list[int], most: int) -> int:
        amount = min([most, *(self.cap[e] for e in path)])
        for e in path:
            self.cap[e] -= amount
            self.cap[e ^ 1] += amount
        return amount

    def shortest(self, a: int, b: int) -> list[int]:
        dist, via, queue, waiting = {a: 0}, {}, deque([a]), {a}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in self.out[x]:
                y = self.to[e]
                if self.cap[e] > 0 and dist[x] + self.cost[e] < dist.get(y, 1 << 60):
                    dist[y], via[y] = dist[x] + self.cost[e], e
                    if y not in waiting:
                        queue.append(y)
                        waiting.add(y)
        path: list[int] = []
        while b != a:
            if b not in via:
                return []
            path.append(via[b])
            b = self.to[via[b] ^ 1]
        return path[::-1]


def allocate(bundles: list[tuple[int, str, int]], shares: dict[str, float], label_cost: int = 1, total_cost: int = 8) -> dict[tuple[int, str], dict[str, int]]:
    """How many components of each bundle (size, label, count) go to each split."""
    if not bundles:
        return {}
    names = list(shares)
    rows_of: dict[str, int] = defaultdict(int)
    for size, label, count in bundles:
        rows_of[label] += size * count
    total = sum(rows_of.values())
    whole, largest = quotas(total, shares), max(names, key=lambda s: shares[s])
    per = {label: quotas(n, shares) for label, n in rows_of.items()}
    flow, ids = MinCostFlow(), {}
    node = lambda key: ids.setdefault(key, len(ids))
    sink = node("sink")
    inner = {}
    for s in names:
        last = [flow.arc(node(s), sink, whole[s], 0), flow.arc(node(s), sink, total, total_cost)]
        for label in per:
            inner[label, s] = (flow.arc(node((label, s)), node(s), per[label][s], 0), last[0])
            flow.arc(node((label, s)), node(s), total, label_cost)
    first: dict[tuple[int, str], dict[str, int]] = {}
    left: dict[tuple[int, str], int] = {}
    order = sorted(bundles, key=lambda b: (-b[0], str(b[1])))
    for size, label, count in order:
        fits = [s for s in names if s == largest or size <= whole[s]]
        first[size, label] = {s: flow.arc(node((size, label, "b")), node((label, s)), size * count, 0) for s in fits}
        left[size, label] = size * count
    for size, label, _ in order:  # free paths first: no cost lies below zero, so each is a shortest one
        for s, e in first[size, label].items():
            if left[size, label]:
                left[size, label] -= flow.push([e, *inner[label, s]], left[size, label])
    for (size, label), rest in left.items():
        while rest:
            path = flow.shortest(node((size, label, "b")), sink)
            rest -= flow.push(path, rest)
    # whole components, the largest first: what rounding keeps from a split or gives it too much is owed to the next,
    # smaller ones
    plan: dict[tuple[int, str], dict[str, int]] = {}
    owed = dict.fromkeys(names, 0)
    for size, label, count in order:
        rows = {s: flow.cap[e ^ 1] for s, e in first[size, label].items()}
        want = {s: (n + owed[s]) / size for s, n in rows.items()}
        got = {s: max(0, int(w)) for s, w in want.items()}
        excess = sum(got.values()) - count
        for s in sorted(got, key=lambda s: (want[s] - got[s], s)):
            if excess > 0:
                got[s], excess = max(0, got[s] - excess), excess - min(got[s], excess)
        for s in sorted(got, key=lambda s: (got[s] - want[s], s)):
            if excess < 0:
                whole_parts = max(1, -excess if len(got) == 1 else 1)
                got[s], excess = got[s] + whole_parts, excess + whole_parts
        if excess < 0:
            got[largest] += -excess
        plan[size, label] = got
        for s in got:
            owed[s] += rows[s] - got[s] * size
    open_whole = {s: whole[s] - sum(k[0] * v.get(s, 0) for k, v in plan.items()) for s in names}
    open_label = {(label, s): per[label][s] for label in per for s in names}
    for (size, label), parts in plan.items():
        for s, n in parts.items():
            open_label[label, s] -= size * n
    labels = sorted(per, key=str)

    def move(here: str, there: str, size: int) -> None:
        """One component of a size, of the label that gains most by it."""
        of = max((k for k in labels if plan.get((size, k), {}).get(here, 0)), key=lambda k: open_label[k, there] - open_label[k, here])
        for s, sign in ((here, -1), (there, 1)):
            plan[size, of][s] = plan[size, of].get(s, 0) + sign
            open_whole[s] -= sign * size
            open_label[of, s] -= sign * size


    # exchanges of one component for one or none of a smaller size, as long as they bring the splits nearer
    held: dict[str, dict[int, int]] = {s: defaultdict(int) for s in names}
    for (size, _), parts in plan.items():
        for s, n in parts.items():
            if n:
                held[s][size] += n
    sizes = {s: sorted(held[s]) for s in names}
    while True:
        best: tuple = (0,)
        for here, there in permutations(names, 2):
            gap = open_whole[there] - open_whole[here]
            if gap > 1:
                best = max(best, _exchange(sizes[here], sizes[there], gap, whole[there] if there != largest else total, here, there))
        if not best[0]:
            return plan
        _, here, there, size, other = best
        for s, t, x in ((here, there, size), (there, here, other)):
            if x:
                move(s, t, x)
                held[s][x] -= 1
                held[t][x] += 1
                for u in (s, t):
                    at = bisect_left(sizes[u], x)
                    stands = at < len(sizes[u]) and sizes[u][at] == x
                    if held[u][x] and not stands:
                        sizes[u].insert(at, x)
                    elif not held[u][x] and stands:
                        del sizes[u][at]


def _exchange(here: list[int], there: list[int], gap: int, most: int, *names: str) -> tuple:
    """(worth, names, size, other): of one size of ``here`` against none or one smaller of ``there`` the exchange whose
    difference comes nearest to half the gap; both lists are sorted and run through once."""
    best: tuple = (0,)
    j, back = 0, [0, *there]
    for size in here:
        if size > most:
            break
        # the smaller the size, the smaller what may come back
        while j + 1 < len(back) and back[j + 1] < size and 2 * (size - back[j + 1]) >= gap:
            j += 1
        for other in back[max(0, j) : j + 2]:
            d = size - other
            if 0 < d < gap:
                best = max(best, (d * (gap - d), *names, size, other))
    return best


def assign_splits(df: DataFrame, id_col: str, group: Column, label: Column, twin: Column, shares: dict[str, float] = SPLITS, seed: int = 17) -> DataFrame:
    """(id, grp, label, new_split): every row with its new split.

    ``group`` is null where no entity is known; ``twin`` then keeps the deliveries of one record together.
    """
    component = F.coalesce(F.concat(F.lit("g:"), group), F.concat(F.lit("r:"), twin.cast("string")), F.concat(F.lit("i:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("?"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")))))
    rows = cut(df.select(F.col(f"`{id_col}`").alias("id"), component.alias("component"), F.coalesce(label.cast("string"), F.lit("?")).alias("label"), group.alias("grp")))
    # a component's label is the one of its first row in the order of labels
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("label"))
    members = cut(sizes.withColumn("bundle", F.concat_ws(":", "size", "label")).withColumn("at", unit_hash(F.col("component"), F.lit(seed))))
    bundles = [(r["size"], r["label"], r["n"]) for r in members.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = allocate(bundles, shares)
    bounds = []
    for (size, lab), parts in plan.items():
        upto = 0
        for s, n in parts.items():
            bounds.append((f"{size}:{lab}", s, upto, upto + n))
            upto += n
    spark = df.sparkSession
    table = spark.createDataFrame(bounds, "bundle string, new_split string, lo bigint, hi bigint")
    ranked = grouped_prefix_sum(members, "bundle", ["at", "component"], F.lit(1), "rank")
    chosen = ranked.join(table, "bundle").filter("rank > lo AND rank <= hi").select("component", "size", "new_split")
    return attach_by_key(rows, chosen, "component", "size", rows.count()).select("id", "grp", "label", "new_split")

"""Filling containers of fixed capacity with items (problem 9).

Sizes are whole numbers up to the capacity, so the whole table is known by its histogram: at most `capacity` rows, which
the driver plans with, whatever the number of items. The planner is bin completion by branch and bound. Best fit is the
incumbent; a plan of as many containers as a lower bound (`bound`) is the best and ends the search at once. Each branch
fills containers around the largest size left. Two undominated fillings are tried: that of the largest items that fit
(no item of it can be exchanged for a larger one), and the one with least waste (`completion`). The branches differ in how
many containers take the first kind before the rest take the second: that saves small items for later containers, at
the price of waste, so a branch is cut as soon as its waste is more than a better plan than the incumbent may have. A
filling is used for as many containers as its sizes last. The last containers of a branch, where counts are small, are
packed by branch and bound over single items.

Finding the best plan is NP-hard, so the search has budgets (NODES, TAIL_NODES, WIDTH, BRANCHES), parameters that bound
the driver's time; where they run out the incumbent stands, which holds every item and is never worse than best fit.

Items find their containers by their rank within their size, which is computed over salted groups, as many as keep a
group near GROUP items, so a size that a third of all items share is spread over many tasks.

Defined results: null and zero sizes take no place; an item over the capacity fills containers of its own and its rest
is an item like others; every other item is in one container, whole; repeated ids are separate items; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.tables import written

CAPACITY = 2048
#: Items of one size that are ranked together, on average.
GROUP = 200_000
#: Budgets of the search: fillings looked at for one container; nodes, items and fillings per node of the last containers;
#: branches.
NODES, TAIL_NODES, TAIL_ITEMS, WIDTH, BRANCHES = 4000, 60_000, 48, 64, 32


def completion(counts: np.ndarray, room: int, nodes: int = NODES) -> dict[int, int]:
    """The filling (size -> number) that leaves least of `room` unused, larger sizes first.

    Fillings are enumerated from the largest size down. A filling to which a left item could be added is dominated by
    the one with it, so only full ones count; a branch is cut when what it leaves can't be under the incumbent's waste.
    """
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0][::-1]
    if not len(sizes):
        return {}
    left = counts.copy()
    # best fit: the incumbent
    best: dict[int, int] = {}
    rest = room
    for s in sizes.tolist():
        if k := min(rest // s, int(left[s])):
            best[s] = k
            rest -= k * s
    waste = rest
    if waste == 0:
        return best
    order, budget = sizes.tolist(), [nodes]
    total = np.cumsum([s * int(counts[s]) for s in order[::-1]])[::-1].tolist() + [0]
    chosen: dict[int, int] = {}
    at_most = np.searchsorted(-sizes, -np.arange(room + 1), side="left").tolist()  # first place of a size <= r

    def search(k: int, r: int) -> bool:
        nonlocal best, waste
        if r < waste:
            best, waste = dict(chosen), r
            if waste == 0:
                return True
        k = max(k, at_most[r])
        while k < len(order) and budget[0] > 0:
            if r - total[k] >= waste:
                return False
            s = order[k]
            budget[0] -= 1
            exact = r % s == 0 and r // s <= left[s]
            for n in [r // s] if exact else range(min(r // s, int(left[s])), 0, -1):
                chosen[s] = n
                if search(k + 1, r - n * s):
                    return True
                del chosen[s]
            # the next useful size: one that fits at all
            k = max(k + 1, at_most[r])
        return False

    # two items that fill the room exactly are found at once
    for s in order:
        if room - s <= s:
            t = room - s
            if t > 0 and counts[t] >= (2 if t == s else 1):
                return {s: 2} if t == s else {s: 1, t: 1}
        else:
            break
    search(0, room)
    return best


def _tail(items: list[int], capacity: int, nodes: int) -> list[list[int]]:
    """Few items: branch and bound over completions of the largest item, best fit decreasing as incumbent."""
    items = sorted(items, reverse=True)
    fit: list[list[int]] = []
    for s in items:
        open_ = [b for b in fit if sum(b) + s <= capacity]
        (max(open_, key=sum).append(s)) if open_ else fit.append([s])
    best, least, budget = fit, ceil(sum(items) / capacity), [nodes]

    def fillings(rest: list[int], room: int) -> list[tuple[int, tuple[int, ...]]]:
        """Maximal fillings of the room, least waste first."""
        found: list[tuple[int, tuple[int, ...]]] = []

        def go(i: int, r: int, own: tuple[int, ...]) -> None:
            if budget[0] <= 0 or len(found) >= WIDTH:
                return
            budget[0] -= 1
            last, more = None, False
            for j in range(i, len(rest)):
                if rest[j] <= r and rest[j] != last:
                    last, more = rest[j], True
                    go(j + 1, r - rest[j], (*own, j))
            if not more:
                found.append((r, own))

        go(0, room, ())
        return sorted(found)

    def search(rest: list[int], done: list[list[int]]) -> bool:
        nonlocal best
        if not rest:
            if len(done) < len(best):
                best = [list(b) for b in done]
            return len(best) <= least
        if budget[0] <= 0 or len(done) + ceil(sum(rest) / capacity) >= len(best):
            return False
        head, others = rest[0], rest[1:]
        for _, own in fillings(others, capacity - head):
            taken = set(own)
            if search([x for j, x in enumerate(others) if j not in taken], [*done, [head, *(others[j] for j in own)]]):
                return True
        return False

    if len(best) > least:
        search(items, [])
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over the histogram: containers that are alike are filled together."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room left -> filling -> containers
    rooms: list[int] = []

    def add(room: int, filling: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = {}
            open_[room][filling] = open_[room].get(filling, 0) + n

    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                add(capacity - each * s, ((s, each),), left // each)
                if rest := left % each:
                    add(capacity - rest * s, ((s, rest),), 1)
                break
            room = rooms[at]
            filling, n = open_[room].popitem()
            if not open_[room]:
                del open_[room], rooms[at]
            # the tightest container takes as many as fit, before the next one gets any
            each = room // s
            full = min(n, left // each)
            add(room - each * s, (*filling, (s, each)), full)
            left -= full * each
            if full < n and left:
                add(room - left * s, (*filling, (s, left)), 1)
                full, left = full + 1, 0
            add(room, filling, n - full)
    return [(n, dict(f)) for fillings in open_.values() for f, n in fillings.items()]


def bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Containers that any plan needs: by the sum of sizes, and by sizes over half the capacity, which never share one."""
    counts = np.zeros(capacity + 1, "int64")
    for s, n in histogram.items():
        counts[s] = n
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half, best = capacity // 2, 0
    for least in range(half + 1):
        # items over capacity - least stand alone, those over half each take a container, the rest from `least` on fill these up
        big, large = number[-1] - number[capacity - least + 1], number[capacity - least + 1] - number[half + 1]
        free = large * capacity - (total[capacity - least + 1] - total[half + 1])
        small = total[half + 1] - total[least]
        best = max(best, int(big + large + max(0, -(-(small - free) // capacity))))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, their filling) for items of sizes 1 to capacity."""
    used = lambda p: sum(t for t, _ in p)
    best, least = best_fit(histogram, capacity), bound(histogram, capacity)
    seen: dict[int, int] = {}

    def branch(lead: int) -> int:
        """Containers of the branch with so many leading ones of the first kind; many if it is cut."""
        nonlocal best
        if lead not in seen and len(seen) < BRANCHES and used(best) > least:
            found = complete(histogram, capacity, lead, used(best))
            seen[lead] = used(found) if found is not None else capacity * used(best)
            if found is not None and used(found) < used(best):
                best = found
        return seen.get(lead, capacity * used(best))

    if histogram and used(best) > least:
        most = used(best)
        step = max(1, most // 16)
        at = min(range(0, most, step), key=branch)
        while step > 1 and used(best) > least and len(seen) < BRANCHES:
            step = max(1, step // 2)
            at = min((max(0, at - step), at, at + step), key=branch)
    return best


def complete(histogram: dict[int, int], capacity: int = CAPACITY, lead: int = 0, most: int | None = None) -> list[tuple[int, dict[int, int]]] | None:
    """A branch: `lead` containers with the largest items that fit, the others with least waste. None if its waste excludes
    fewer than `most` containers."""
    counts = np.zeros(capacity + 1, "int64")
    for s, n in histogram.items():
        counts[s] += n
    allowed = None if most is None else (most - 1) * capacity - int((counts * np.arange(capacity + 1)).sum())
    out: list[tuple[int, dict[int, int]]] = []
    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        if allowed is not None and allowed < 0:
            return None
        if not lead and counts.sum() <= TAIL_ITEMS:
            items = np.repeat(np.arange(capacity + 1), counts).tolist()
            for b in _tail(items, capacity, TAIL_NODES):
                out.append((1, {s: b.count(s) for s in set(b)}))
            return out
        counts[top] -= 1
        filling = _largest(counts, capacity - top) if lead else completion(counts, capacity - top)
        counts[top] += 1
        filling = {**filling, top: filling.get(top, 0) + 1}
        times = min(int(counts[s]) // k for s, k in filling.items())
        if lead:
            times = min(times, lead)
            lead -= times
        for s, k in filling.items():
            counts[s] -= times * k
        if allowed is not None:
            allowed -= times * (capacity - sum(s * k for s, k in filling.items()))
        out.append((times, filling))


def _largest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The filling that takes the largest size that fits, again and again."""
    out: dict[int, int] = {}
    for s in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if s and (k := min(room // s, int(counts[s]))):
            out[s] = k
            room -= k * s
    return out


def _places(packed: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """size -> rows (first rank, first container, items of the size in each), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for times, filling in packed:
        for s, k in filling.items():
            out.setdefault(s, []).append((used.get(s, 0), container, k))
            used[s] = used.get(s, 0) + times * k
        container += times
    return {s: np.array(rows, "int64") for s, rows in out.items()}


def fill(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """container, the id column, part, start, size: the part of an item from `start` on that is in a container."""
    whole = items.select(F.col(id_col), F.col(size_col).cast("long").alias("_n")).filter("_n > 0")
    parts = F.when(F.col("_n") <= capacity, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / capacity).cast("long")))
    cut = whole.select(id_col, "_n", F.explode(parts).alias("part")).select(
        id_col, "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("part") * capacity).cast("int").alias("size")
    )
    cut = written(cut, "parts")
    sizes = cut.groupBy("size").agg(F.count("*").alias("_all"))
    # at most capacity rows
    salts = F.broadcast(sizes.select("size", F.ceil(F.col("_all") / GROUP).alias("_salts")))
    cut = cut.join(salts, "size").withColumn("_salt", F.pmod(F.xxhash64(id_col, "part"), F.col("_salts")).cast("int")).drop("_salts")
    groups = cut.groupBy("size", "_salt").agg(F.count("*").alias("_c"))
    histogram = {r["size"]: r["_all"] for r in sizes.collect()}
    places = _places(plan(histogram, capacity))
    before = Window.partitionBy("size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("size", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("size", "_salt").orderBy(id_col, "part")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["size", "_salt"])
    ranked = ranked.select(id_col, "part", "start", "size", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            container = np.zeros(len(size), "int64")
            for s in np.unique(size):
                at, p = np.flatnonzero(size == s), places[int(s)]
                k = np.searchsorted(p[:, 0], rank[at], side="right") - 1
                container[at] = p[k, 1] + (rank[at] - p[k, 0]) // p[k, 2]
            yield pa.RecordBatch.from_arrays([pa.array(container), *b.columns[:4]], ["container", id_col, "part", "start", "size"])

    kind = ranked.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"container long, `{id_col}` {kind}, part long, start long, size int")

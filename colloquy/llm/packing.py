"""Filling containers of fixed capacity with texts (problem 8) by bin completion.

Rows are spread over blocks of a stated size by a hash of their id, so that every block is packed in a task of its
own and no key can grow hot. Within a block the sizes form a histogram. A first packing fills containers one after
another around the largest open size, each as full as it can be, starting from the best fit. It is the incumbent of a
branch and bound over containers: around the largest open size the undominated fillings are tried, least waste first,
and a branch ends when its waste rules out a packing with fewer containers. Containers filled to the brim are kept;
the search repacks the ``TAIL`` last ones with space left over, up to ``SEARCH`` fillings and the lower bound.
``search=None`` repacks all of a block until the packing is proven least.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Pieces per block on average: some hundred containers, of which one may stay open.
BLOCK_ROWS = 4000
#: Nodes of one enumeration; the incumbent found by then is kept, so this bounds time and never drops a row.
NODES = 2000
#: Tasks the blocks are spread over, at most; beyond it a task packs several blocks one after another.
MOST_TASKS = 10_000
#: Fillings the branch and bound of a block tries; the incumbent found by then is kept.
SEARCH, TAIL = 200, 24


def complete(counts: list[int], sizes: list[int], room: int, nodes: int = NODES) -> list[int]:
    """The filling of ``room`` from the multiset (``sizes`` descending, ``counts`` left of each) with least waste.

    Depth-first from the largest size that fits; a branch is cut when even all remaining items cannot beat the
    incumbent's waste. Fillings that replace several items by one of equal sum are tried first and so dominate.
    """
    # incumbent: best fit, always the largest item that still fits
    best, left = [], room
    for s, c in zip(sizes, counts):
        if s <= left and c:
            n = min(c, left // s)
            best += [s] * n
            left -= s * n
    waste = left
    if waste == 0 or not sizes:
        return best
    smallest = next((s for s, c in zip(reversed(sizes), reversed(counts)) if c), 0)
    # what all items from position i on can fill at most
    fill = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        fill[i] = fill[i + 1] + sizes[i] * counts[i]
    lookup = {s: i for i, s in enumerate(sizes) if counts[i]}
    budget = nodes
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and budget > 0 and waste > 0:
        i, left, chosen = stack.pop()
        budget -= 1
        if left < waste:
            best, waste = list(chosen), left
            if waste == 0:
                break
        if left < smallest or left - fill[i] >= waste:
            continue
        # one item that closes the gap exactly dominates every other completion
        j = lookup.get(left)
        if j is not None and j >= i and counts[j] > (chosen.count(left) if chosen else 0):
            best, waste = [*chosen, left], 0
            break
        while i < len(sizes) and (sizes[i] > left or not counts[i]):
            i += 1
        if i == len(sizes):
            continue
        stack.append((i + 1, left, chosen))
        most = min(counts[i], left // sizes[i])
        for n in range(1, most + 1):
            stack.append((i + 1, left - n * sizes[i], chosen + (sizes[i],) * n))
    return best


def fillings(counts: list[int], sizes: list[int], room: int, least: int, nodes: int | None = None) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` from the multiset (``sizes`` descending) that use at least ``least`` of it.

    A filling is dominated if an item left out could take the place of a smaller one, or be added: the container would
    be fuller and the rest easier to pack.
    """
    reach = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        reach[i] = reach[i + 1] + sizes[i] * counts[i]
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        if nodes is not None:
            if not nodes:
                return
            nodes -= 1
        i, left, taken = stack.pop()
        if room - left + min(left, reach[i]) < least:
            continue
        while i < len(sizes) and (sizes[i] > left or not counts[i]):
            # of sizes that do not fit none is taken
            taken, i = (*taken, 0), i + 1
        if i == len(sizes):
            free = [s for s, c, t in zip(sizes, counts, taken) if t < c]
            used = [s for s, t in zip(sizes, taken) if t]
            if not any(s <= left or any(u < s <= u + left for u in used) for s in free):
                yield [s for s, t in zip(sizes, taken) for _ in range(t)]
            continue
        for n in range(min(counts[i], left // sizes[i]) + 1):
            stack.append((i + 1, left - n * sizes[i], (*taken, n)))


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: of the total, and of items above a threshold with the room that those above half leave."""
    best = -(-sum(sizes) // capacity)
    for k in {s for s in sizes if 2 * s <= capacity}:
        large = sum(s > capacity - k for s in sizes)
        halves = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        small = sum(s for s in sizes if k <= s and 2 * s <= capacity)
        best = max(best, large + len(halves) + max(0, -(-(small - (len(halves) * capacity - sum(halves))) // capacity)))
    return max(best, sum(2 * s > capacity for s in sizes))


def fewer(sizes: list[int], capacity: int, most: int, search: int | None) -> list[list[int]] | None:
    """A packing of ``sizes`` into at most ``most`` containers, or None where none is found (with ``search`` None: where
    there is none). Depth first over containers; fillings of one container in order of waste."""
    histogram = Counter(sizes)
    order = sorted(histogram, reverse=True)
    spare = most * capacity - sum(sizes)
    if spare < 0:
        return None
    tried = 0

    def options(spare: int) -> Iterator[list[int]]:
        top = next(s for s in order if histogram[s])
        histogram[top] -= 1
        room = capacity - top
        open_sizes = [s for s in order if s <= room and histogram[s]]
        counts = [histogram[s] for s in open_sizes]
        histogram[top] += 1
        found = sorted(fillings(counts, open_sizes, room, room - spare, None if search is None else NODES), key=sum, reverse=True)
        return iter([[top, *f] for f in found])

    packed: list[list[int]] = []
    levels = [options(spare)]
    while levels:
        chosen = next(levels[-1], None)
        if chosen is None or (search is not None and tried >= search):
            if search is not None and tried >= search:
                return None
            levels.pop()
            if packed:
                undone = packed.pop()
                histogram.update(undone)
                spare += capacity - sum(undone)
            continue
        tried += 1
        packed.append(chosen)
        histogram.subtract(chosen)
        spare -= capacity - sum(chosen)
        if not any(histogram.values()):
            return packed
        if len(packed) < most and spare >= 0:
            levels.append(options(spare))
        else:
            packed.pop()
            histogram.update(chosen)
            spare += capacity - sum(chosen)
    return None


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, search: int | None = SEARCH) -> np.ndarray:
    """Container number of each item of a block; every size must be between 0 and ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order.tolist():
        waiting.setdefault(int(sizes[i]), []).append(i)
    zero = waiting.pop(0, [])
    distinct = list(waiting)
    left = {s: len(items) for s, items in waiting.items()}
    packed: list[list[int]] = []
    while distinct:
        top = distinct[0]
        left[top] -= 1
        room = capacity - top
        open_sizes = [s for s in distinct if s <= room]
        packed.append([top, *complete([left[s] for s in open_sizes], open_sizes, room, nodes)])
        for s in packed[-1][1:]:
            left[s] -= 1
        distinct = [s for s in distinct if left[s]]
    items = [s for s, held in waiting.items() for _ in held]
    bound = least_containers(items, capacity)
    while len(packed) > bound and search != 0:
        loose = [i for i, p in enumerate(packed) if search is None or sum(p) < capacity]
        loose = loose if search is None else loose[-TAIL:]
        better = fewer([s for i in loose for s in packed[i]], capacity, len(loose) - 1, search)
        if better is None:
            break
        packed = [p for i, p in enumerate(packed) if i not in set(loose)] + better
    bins = np.zeros(len(sizes), np.int64)
    for number, content in enumerate(packed):
        for s in content:
            bins[waiting[s].pop()] = number
    bins[zero] = max(len(packed) - 1, 0)
    return bins


def pack(sized: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, rows: int | None = None, nodes: int = NODES, search: int | None = SEARCH) -> DataFrame:
    """Assignment of items to containers: ``id_col``, ``part_no``, ``start``, ``size``, ``container``.

    An item above ``capacity`` is split into full parts and a rest (``part_no`` from 0, ``start`` its first token);
    no other item is split. Null and negative sizes count as 0 and take no room; repeated rows are packed each.
    The one shuffle moves ids and sizes only. The number of blocks follows the number of rows,
    counted here unless the caller states it. ``nodes`` and ``search`` bound the time spent on one filling and on one
    block's branch and bound, never the rows.
    """
    kind = dict(sized.dtypes)[id_col]
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    parts = F.greatest(F.ceil(size / capacity).cast("int"), F.lit(1))
    blocks = max(1, round((sized.count() if rows is None else rows) / block_rows))
    items = sized.select(F.col(id_col), size.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
    start = F.col("part_no").cast("long") * capacity
    items = items.select(id_col, "part_no", start.alias("start"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("size"))
    block = F.pmod(F.xxhash64(F.col(id_col), "part_no"), F.lit(blocks)).cast("int")
    rest = items.withColumn("_block", block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a canonical order makes the packing independent of how rows arrive
        pdf = pdf.sort_values(["size", id_col, "part_no"], ascending=[False, True, True], kind="stable")
        bins = pack_block(pdf["size"].to_numpy(), capacity, nodes, search)
        name = [f"b{b}-{n}" for b, n in zip(pdf["_block"], bins)]
        return pdf.drop(columns="_block").assign(container=name)

    # blocks are small in bytes but dear in work, so they are spread by number
    return rest.repartition(min(blocks, MOST_TASKS), "_block").groupBy("_block").applyInPandas(run, f"`{id_col}` {kind}, part_no int, start long, size int, container string")

"""Sharding by histogram sort, with DataFrame operations only.

Splitters between shards are found by counting, not by sampling.  Every round
counts the exact bytes of each cell of candidate boundaries (the leading bits
of the key) over all partitions and keeps, for each splitter, the cell in which
its target falls; the next round probes that cell more finely, until the bytes
below the splitter are within ``tolerance`` of the target or the cell is a
single key.  Only the counts (open cells x ``2**bits``, whatever the number of
rows) reach the driver.  Then the rows are exchanged once.

Rows are ordered by the pair (key, tie): the key is a whole number, the tie a
hash of the whole row, so a key that holds a third of all rows is split as
well.  Each shard is made of ``cells`` ranges found in the same way, as many as
the bytes ask for.  A row's slot is its rank in its shard: the rows of earlier
ranges, from the counts, plus its rank within its own.  Ranges are the unit of
work, so a shard may be larger than any task.  The driver holds the splitters
(16 bytes a range); with many of them a round probes fewer cells for each.

Defined results: null keys sort first, null texts count 8 bytes; a very long
text is one row like any other; ties of the key follow the hash of the row, and
rows equal in every column share a cell and stand side by side; an empty table
gives an empty result; a column named like a result column gives way to it,
other columns are carried.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import columns_of, own_prefix, stage

_LOW = -(2**63)
#: Counts that a round brings to the driver, about.
_COUNTS = 1 << 20


def _long_array(values: list[int]) -> Column:
    """A constant array, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _with_rank(df: DataFrame, name: str, k: str, t: str, splitters: list[tuple[int, int]]) -> DataFrame:
    """How many of the ascending splitters are not above (k, t), by binary search: one projection a step."""
    splitters = [s for s in splitters if s[0] < 2**63]  # no key reaches the others
    ks, ts = _long_array([s[0] for s in splitters]), _long_array([s[1] for s in splitters])
    df = df.withColumn(name, F.lit(0))
    for bit in reversed(range(len(splitters).bit_length())):
        at = F.col(name) + F.lit((1 << bit) - 1)
        not_above = (F.get(ks, at) < F.col(k)) | ((F.get(ks, at) == F.col(k)) & (F.get(ts, at) <= F.col(t)))
        df = df.withColumn(name, F.when(not_above, at + 1).otherwise(F.col(name)))
    return df


def _shift_for(low: int, high: int, bits: int) -> int:
    """Bits to drop so that low .. high fall into at most ``2**bits`` cells."""
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << bits:
        shift += 1
    return shift


def _descend(rows: DataFrame, value: str, goals: list[tuple[int, int, float]], base: int, bits: int):
    """Boundaries of ``value`` at which the bytes below reach each goal.

    goals: (number, bytes wanted, slack).  Yields (number, boundary, None), or
    (number, value, bytes below it) where a single value of many rows holds
    the goal.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    shift, before = _shift_for(low, high, bits), None
    live = {g[0]: (*g[1:], None, base) for g in goals}
    while live:
        cell = F.shiftright(F.col(value), shift)
        probe = rows if before is None else rows.where(F.shiftright(F.col(value), before).isin(sorted({g[2] for g in live.values()})))
        counts = defaultdict(list)
        for c, size, n in probe.groupBy(cell.alias("cell")).agg(F.sum("size"), F.count(F.lit(1))).collect():  # open cells x 2**bits at most
            counts[None if before is None else c >> (before - shift)].append((c, size, n))
        for number, (goal, slack, prefix, below) in list(live.items()):
            for c, size, n in sorted(counts[prefix]):
                if below + size >= goal:
                    break
                below += size
            if below + size - goal <= slack or (shift == 0 and n == 1):
                yield number, (c + 1) << shift, None
            elif goal - below <= slack:
                yield number, c << shift, None
            elif shift == 0:
                yield number, c, below
            else:
                live[number] = (goal, slack, c, below)
                continue
            del live[number]
        before, shift = shift, max(0, shift - bits)


def find_splitters(keyed: DataFrame, goals: list[tuple[int, float]], bits: int = 9) -> list[tuple[int, int]]:
    """Ascending (key, tie) splitters of ``keyed`` (columns k, t, size), one per goal (bytes below, slack)."""
    found: dict[int, tuple[int, int]] = {}
    heavy = defaultdict(list)
    for number, at, below in _descend(keyed, "k", [(i, *g) for i, g in enumerate(goals)], 0, bits):
        if below is None:
            found[number] = (at, _LOW)
        else:
            heavy[at, below].append((number, *goals[number]))
    for (key, below), inside in heavy.items():  # at most one round trip per splitter, however many rows the key has
        rows = keyed.where(F.col("k") == key)
        for number, at, same in _descend(rows, "t", inside, below, bits):
            at = at if same is None else at + 1  # rows equal in every column stay together
            found[number] = (key, at) if at < 2**63 else (key + 1, _LOW)
    return sorted(found.values())


def histogram_sort(df: DataFrame, key: str, text: str = "text", shards: int = 24, tolerance: float = 0.0, cells: int | None = None, overhead: int = 8, range_bytes: int = 128 << 20) -> DataFrame:
    """``df`` in ``shards`` contiguous key ranges of near equal bytes.

    A row counts the UTF-8 bytes of its text (null: none) plus ``overhead``.
    Adds size, shard and slot (0, 1, ... within the shard, in key order).  With
    ``tolerance`` 0 shard i holds exactly the rows before which at least
    ``i / shards`` of all bytes lie; inner ranges may miss by a fifth.  By
    default a shard has as many ranges as ``range_bytes`` asks for, 8 at least.
    """
    source = df.drop(*[c for c in ("size", "shard", "slot") if c in df.columns])
    p = own_prefix(source)
    k, t, cell = f"{p}k", f"{p}t", f"{p}cell"
    ready = source.select(
        "*",
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LOW)).alias(k),
        F.xxhash64(*columns_of(source)).alias(t),
    )
    keyed = stage(ready.select(F.col(k).alias("k"), F.col(t).alias("t"), "size"), "histsort")
    total = keyed.agg(F.sum("size")).first()[0]
    if total is None:
        return ready.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).drop(k, t)
    cells = cells or max(8, -(-total // (shards * range_bytes)))
    n = shards * cells
    goals = [(-(-total * i // n), (tolerance if i % cells == 0 else 0.2) * total / n) for i in range(1, n)]
    splitters = find_splitters(keyed, goals, max(1, min(9, (_COUNTS // n).bit_length() - 1)))
    counts = dict(_with_rank(keyed, "cell", "k", "t", splitters).groupBy("cell").count().collect())  # at most shards x cells rows
    first, at = [], 0
    for c in range(n):
        at = 0 if c % cells == 0 else at
        first.append(at)
        at += counts.get(c, 0)
    placed = _with_rank(ready, cell, k, t, splitters)
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(k, t))
    return placed.select(
        *columns_of(source),
        "size",
        F.floor(F.col(cell) / cells).cast("int").alias("shard"),
        (F.get(_long_array(first), F.col(cell)) + rank - 1).alias("slot"),
    )

"""Sharding by size: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that is never split.  Groups are put in the
order of their text's digest and cut into ``shards`` contiguous runs so that the
largest run's bytes are as few as possible: the smallest capacity is found by
binary search, each candidate being checked greedily (fill a shard until the next
group does not fit), and the cuts of that capacity are used.

Groups fall into buckets by the leading bits of their digest, buckets into ranges of
buckets.  The driver starts from the ranges' sums.  For a capacity it follows the
greedy run twice, with every cut as early and as late as what it knows allows; that
may settle the capacity, or else the ranges or buckets in which a cut can lie are
read, a few at a time, in the order of the cuts.  So a huge group costs the bucket
that it is in, and the driver holds the sums of the ranges (one for about 4 million
groups) and what a few hundred such reads return (1,024 sums or some thousand groups
each), however many groups there are.

Rows of a group are numbered in parts (runs of the stored rows), each part with the
count of the parts before it, so a group of copies of any size is numbered by many
tasks, whatever its ids are.

Defined cases: null text counts as empty (size 1, checksum 0) and belongs to the
group of empty texts; repeated rows and null ids are rows like any other; with
fewer groups than shards some shards stay empty; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..plans.scratch import stored

SHARDS = 16
#: Groups in a bucket, about, and buckets in a range (as bits).
BUCKET_GROUPS, RANGE_BITS = 4_096, 10
#: Stored rows of a task that are numbered together, as bits.
PART_BITS = 17
#: Ranges or buckets read at once.
READS = 32


def greedy(sizes: np.ndarray, capacity: int) -> list[int]:
    """Starts of the runs when each is filled until the next size does not fit."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    starts, at = [], 0
    while at < len(sizes):
        starts.append(at)
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
    return starts


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which ``greedy`` needs no more than ``shards`` runs."""
    lo, hi = max(int(sizes.max(initial=0)), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy(sizes, mid)) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


class Known:
    """The bounds of groups known so far: between two of them lies one group or something not read yet."""

    def __init__(self, nodes: list[tuple]):
        self.ends = np.concatenate([[0], np.cumsum([n[1] for n in nodes], dtype=np.int64)])
        self.nodes = np.empty(len(nodes), object)  # what to read, None for a group
        self.nodes[:] = [n[0] for n in nodes]
        self.unread = np.ones(len(nodes), bool)

    def follow(self, capacity: int, shards: int) -> tuple[list[int], list[int], list[int]]:
        """Starts of the greedy runs, and the end of the last, as early and as late as may be; what may hold them, unread."""
        early, late, unread = [0], [0], []
        for _ in range(shards):
            first, last = (int(np.searchsorted(self.ends, x + capacity, side="right")) - 1 for x in (early[-1], late[-1]))
            unread += (np.flatnonzero(self.unread[first : last + 1])[:READS] + first).tolist()
            inside = last < len(self.nodes) and self.unread[last]
            early.append(int(self.ends[first]))
            late.append(late[-1] + capacity if inside else int(self.ends[last]))
        return early, late, unread

    def read(self, fetch, wanted: list[int]) -> None:
        """Put what ``fetch`` gives in the place of the nodes with these numbers."""
        wanted = sorted(set(wanted))
        found = fetch([self.nodes[i] for i in wanted])
        sizes, nodes, unread, at = [], [], [], 0
        old = np.diff(self.ends)
        for i in wanted:
            inner = found[self.nodes[i]]
            deeper = isinstance(inner[0], tuple)
            held = np.empty(len(inner), object)
            if deeper:
                held[:] = [n for n, _ in inner]
            sizes += [old[at:i], np.array([x[1] if deeper else x for x in inner], np.int64)]
            nodes += [self.nodes[at:i], held]
            unread += [self.unread[at:i], np.full(len(inner), deeper)]
            at = i + 1
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, old[at:]]))])
        self.nodes, self.unread = np.concatenate([*nodes, self.nodes[at:]]), np.concatenate([*unread, self.unread[at:]])


def plan_cuts(nodes: list[tuple], fetch, shards: int) -> list[int]:
    """First byte of each shard in the ordered groups.

    ``nodes``: (node, bytes, largest group) in order; ``fetch(list of nodes)`` gives
    what each holds, in order: sizes of groups, or further nodes as (node, bytes).
    """
    if not nodes:
        return [0]
    known = Known(nodes)
    total = int(known.ends[-1])

    def fits(capacity: int) -> bool:
        while True:
            early, late, unread = known.follow(capacity, shards)
            if early[-1] == total or late[-1] < total:
                return early[-1] == total
            known.read(fetch, unread[:READS])

    lo, hi = max(max(n[2] for n in nodes), -(-total // shards)), total
    while lo < hi:
        mid = (lo + hi) // 2
        if fits(mid):
            hi = mid
        else:
            lo = mid + 1
    while True:
        early, late, unread = known.follow(lo, shards)
        if early == late:
            return [0, *(s for s in early[1:-1] if s < total)]
        known.read(fetch, unread[:READS])


def shard_by_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard (null for this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text) + 1).cast("long").alias("size"))
    # Stored together with the rows, so every later reader sees the same parts.
    rows = stored(rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), PART_BITS)), "shard_rows")
    n = rows.count()
    bits = max(1, (n // BUCKET_GROUPS).bit_length())
    bucket = F.shiftrightunsigned("h", 64 - bits)

    key = ["h", "crc", "size"]
    ahead = (Window.unboundedPreceding, -1)

    def before(value: str, within: WindowSpec) -> Column:
        return F.coalesce(F.sum(value).over(within.rowsBetween(*ahead)), F.lit(0))

    parts = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(parts.withColumn("before", before("n", Window.partitionBy(*key).orderBy("part"))), "shard_parts")
    groups = parts.groupBy(*key).agg(F.sum("n").alias("n")).select(bucket.alias("bucket"), *key, "n", (F.col("n") * F.col("size")).alias("bytes"))
    in_order = Window.partitionBy("bucket").orderBy(*key)
    groups = groups.repartitionByRange("bucket").withColumns({"bytes_before": before("bytes", in_order), "rows_before": before("n", in_order)})
    groups = stored(groups, "shard_groups")  # in files of ranges of buckets, so a read of some buckets skips the others

    sums = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.sum("n").alias("n"))
    sums = stored(sums.withColumn("range", F.shiftright("bucket", RANGE_BITS)), "shard_buckets")
    ranges = sums.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), F.sum("n").alias("n"))

    def fetch(wanted: list[tuple]) -> dict[tuple, list]:
        out: dict[tuple, list] = {}
        inner = {kind: [k for name, k in wanted if name == kind] for kind in ("range", "bucket")}
        if inner["range"]:
            for r in sums.filter(F.col("range").isin(inner["range"])).select("range", "bucket", "bytes").collect():
                out.setdefault(("range", r[0]), []).append((("bucket", r[1]), r[2]))
        if inner["bucket"]:
            for r in groups.filter(F.col("bucket").isin(inner["bucket"])).select("bucket", "bytes_before", "bytes").collect():
                out.setdefault(("bucket", r[0]), []).append((r[1], r[2]))
        return {k: sorted(v) if k[0] == "range" else [x for _, x in sorted(v)] for k, v in out.items()}

    top = [(("range", r["range"]), r["bytes"], r["largest"]) for r in ranges.orderBy("range").collect()]
    cuts = plan_cuts(top, fetch, shards)
    # The window over ranges has no key: one row for about 4 million groups.
    whole = Window.orderBy("range")
    ranges = ranges.select("range", before("bytes", whole).alias("byte0"), before("n", whole).alias("row0"))
    inside = Window.partitionBy("range").orderBy("bucket")
    base = sums.select("range", "bucket", before("bytes", inside).alias("byte1"), before("n", inside).alias("row1")).join(ranges, "range")
    base = base.select("bucket", (F.col("byte0") + F.col("byte1")).alias("byte0"), (F.col("row0") + F.col("row1")).alias("row0"))
    placed = groups.join(base, "bucket").select(*key, (F.col("bytes_before") + F.col("byte0")).alias("at"), (F.col("rows_before") + F.col("row0")).alias("first"))
    cut_list = F.array(*[F.lit(c).cast("long") for c in cuts])
    placed = placed.withColumn("shard", (F.size(F.filter(cut_list, lambda c: c <= F.col("at"))) - 1).cast("int"))
    placed = stored(placed, "shard_places")
    starts = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("first").alias("row")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    places = parts.join(placed, key).select(*[F.col(k).alias(f"{k}2") for k in key], F.col("part").alias("part2"), "shard", (F.col("first") + F.col("before") - start).alias("slot0"))
    places = stored(places, "shard_slots")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key, "part").orderBy("id")) - 1)
    on = [F.col(k) == F.col(f"{k}2") for k in (*key, "part")]
    out = numbered.join(places, on)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

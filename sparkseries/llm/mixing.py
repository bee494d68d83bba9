"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of ``block`` rows.  With weight w
(shares of the active sources sum to 1) the i-th block of a source (from 0) is
released at slot floor(i / w) and due at slot ceil((i + 1) / w); in every slot the
released block with the earliest deadline goes next.  On one processor with total
share 1 this meets every deadline, so at any slot t each source has been given
w * t blocks, give or take less than one.  When a source runs out the others go on
with their weights rescaled, in a new phase; there are no more phases than sources,
and no row is dropped or repeated.

Weights are whole numbers or fractions and are never rounded (a float stands for the
simplest fraction that it can be told from by 1 part in 2^48).  Scaled to whole
numbers they sum to a cycle after which the schedule repeats.  One task reads the
table of sources and walks through one cycle a phase, or to the phase's end if that
comes first; it holds a few numbers per source and writes, for each block of the
cycle, its first slot and how often it comes back.  Its time grows with the blocks
walked through and with phases times sources.  All else is arithmetic, spread out.

Rows are numbered within a source without collecting or sorting it in one task:
rows fall into hash buckets (a shuffled order that depends on id and seed only),
bucket counts are summed up in two levels, and rows are numbered within each
(source, bucket) together with the slots of the bucket's blocks.

Defined cases: null sources are a source of their own, apart from empty ones;
sources without a weight get the mean of the given weights (1 where none is given);
weights <= 0 are an error; repeated rows each get a position; null ids are rows like
any other, and a bucket holds as many of them as a source has; an empty table gives
an empty result; further columns are ignored or kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..plans.scratch import ship_package, stored

BLOCK = 64
#: Rows in a numbering bucket, about, and buckets whose counts one task sums up.
BUCKET_ROWS, BUCKET_GROUP = 400, 4_096
SCHEDULE = "key string, block long, slot long, times long, blocks long, slots long, lack long"


def simplest(low: Fraction, high: Fraction) -> Fraction:
    """The fraction of least denominator from ``low`` to ``high``, both above 0."""
    whole = low.numerator // low.denominator
    if whole == low or whole + 1 <= high:
        return Fraction(whole if whole == low else whole + 1)
    return whole + 1 / simplest(1 / (high - whole), 1 / (low - whole))


def whole_weights(weights: dict) -> dict:
    """The least whole numbers in the proportions of ``weights``."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    error = Fraction(1, 2**48)
    exact = {}
    for s, w in weights.items():
        share = Fraction(w) / total
        exact[s] = simplest(share * (1 - error), share * (1 + error)) if isinstance(w, float) else share
    scale = lcm(*(f.denominator for f in exact.values()))
    whole = {s: int(f * scale) for s, f in exact.items()}
    shared = gcd(*whole.values())
    return {s: n // shared for s, n in whole.items()}


def one_cycle(whole: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, its i-th block) for the slots of one cycle: earliest deadline first, then release, then name."""
    cycle = sum(whole.values())
    ready = [(-(-cycle // n), 0, s, 0) for s, n in whole.items()]
    heapq.heapify(ready)
    waiting: list[tuple[int, str, int]] = []  # (release, source, block)
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * cycle // whole[s]), release, s, i))
        _, _, s, i = heapq.heappop(ready)
        yield s, i
        if i + 1 < whole[s]:
            heapq.heappush(waiting, ((i + 1) * cycle // whole[s], s, i + 1))


def phases(rows: dict[str, int], weights: dict[str, int], block: int) -> Iterator[tuple]:
    """Rows of SCHEDULE: the block ``block`` of a source has slot ``slot``; ``times`` times in all the block ``blocks``
    further on has the slot ``slots`` further on.  ``lack``: what the blocks before are short of full ones, in rows."""
    left = {s: -(-n // block) for s, n in rows.items() if n}
    done, start, lack = dict.fromkeys(left, 0), 0, 0
    while left:
        shared = gcd(*(weights[s] for s in left))
        whole = {s: weights[s] // shared for s in left}
        cycle = sum(whole.values())
        # The phase ends behind the slot that takes some source's last block; that may be in the first cycle.
        end = None
        for t, (s, i) in enumerate(one_cycle(whole)):
            if left[s] == i + 1:
                end = t + 1
                break
            if (left[s] - 1) % whole[s] == i:
                last = (left[s] - 1) // whole[s] * cycle + t + 1
                end = last if end is None else min(end, last)
        took = dict.fromkeys(left, 0)
        for t, (s, i) in enumerate(islice(one_cycle(whole), min(end, cycle))):
            times = -(-(end - t) // cycle)
            yield s, done[s] + i, start + t, times, whole[s], cycle, lack
            took[s] += times
        start += end
        for s, n in took.items():
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
                lack += -rows[s] % block


def _plan(block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights = {}, {}
        for batch in batches:
            for s, n, w in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "weight"))):
                rows[s], weights[s] = n, int(w)
        planned = phases(rows, weights, block)
        while part := list(islice(planned, 10_000)):
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["key", "block", "slot", "times", "blocks", "slots", "lack"])

    return run


def source_key(source: Column) -> Column:
    """Text that tells sources apart, null and empty ones too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def hashable(kind: DataType) -> bool:
    """Whether Spark hashes the type: it does not where a map or variant is inside."""
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


def _schedule(docs: DataFrame, source_col: str, weights: dict | None, block: int) -> tuple[DataFrame, int]:
    """(key, block, slot, lack) of all blocks, and the number of rows."""
    spark = docs.sparkSession
    ship_package(spark)
    sizes = stored(docs.groupBy(source_key(F.col(source_col)).alias("key")).agg(F.count(F.lit(1)).alias("n")), "sources")
    given = {"" if s is None else f"={s}": w for s, w in (weights or {}).items()}
    usual = sum(map(Fraction, given.values())) / len(given) if given else Fraction(1)
    whole = whole_weights({**given, None: float(usual) if any(isinstance(w, float) for w in given.values()) else usual})
    table = spark.createDataFrame([(s, str(w)) for s, w in whole.items() if s is not None], "key string, weight string")
    sizes = sizes.join(table, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(str(whole[None]))))
    # The one task reads a row per source, not per document.
    plan = stored(sizes.select("key", "n", "weight").repartition(1).mapInArrow(_plan(block), SCHEDULE), "schedule")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.explode(F.sequence(F.lit(0), F.col("times") - 1))
    blocks = plan.repartition(parts, "key", "block").select("*", k.alias("k"))
    blocks = blocks.select("key", (F.col("block") + F.col("k") * F.col("blocks")).alias("block"), (F.col("slot") + F.col("k") * F.col("slots")).alias("slot"), "lack")
    return blocks, sizes.agg(F.sum("n")).first()[0] or 0


def _mixed(docs: DataFrame, *, id_col: str, source_col: str, weights: dict | None, block: int, seed: int) -> tuple[DataFrame, int]:
    """``docs`` with _block, _slot and _position, and the number of rows."""
    blocks, total = _schedule(docs, source_col, weights, block)
    buckets = max(1, total // BUCKET_ROWS)
    spot = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    # Rows that tie in id and in the digest of all they hold are the same row: a task that runs again numbers alike.
    docs = docs.withColumns({"_key": source_key(F.col(source_col)), "_spot": spot, "_tie": F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)])})
    docs = docs.withColumn("_bucket", F.pmod("_spot", F.lit(buckets)))
    counts = docs.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("_bucket") / BUCKET_GROUP))
    ahead = (Window.unboundedPreceding, -1)
    groups = counts.groupBy("_key", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("_key", "group", F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("group").rowsBetween(*ahead)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_key", "group").orderBy("_bucket").rowsBetween(*ahead)), F.lit(0))
    offsets = counts.withColumn("inside", inside).join(groups, ["_key", "group"]).select("_key", "_bucket", "n", (F.col("base") + F.col("inside")).alias("first"))
    # The slots of the blocks that each bucket's rows belong to, in order.
    held = offsets.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block))))
    held = held.join(blocks.withColumnRenamed("key", "_key"), ["_key", "block"])
    held = held.groupBy("_key", "_bucket").agg(F.first("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "slot", "lack"))).alias("held"))
    within = Window.partitionBy("_key", "_bucket").orderBy("_spot", id_col, "_tie")
    docs = docs.withColumn("_row", F.row_number().over(within) - 1).join(held, ["_key", "_bucket"])
    row = F.col("first") + F.col("_row")
    docs = docs.withColumns({"_block": F.floor(row / block), "_in": row % block})
    at = F.element_at("held", (F.col("_block") - F.col("held")[0]["block"] + 1).cast("int"))
    docs = docs.withColumns({"_slot": at["slot"], "_position": at["slot"] * block - at["lack"] + F.col("_in")})
    return docs.drop("_key", "_bucket", "_spot", "_tie", "_row", "_in", "first", "held"), total


def mix_order(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, source, block, slot and position (gapless from 0)."""
    rows, _ = _mixed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src")), id_col="id", source_col="src", weights=weights, block=block, seed=seed)
    return rows.select(F.col("id").alias(id_col), F.col("src").alias(source_col), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """``docs`` in mixed order: partitions follow each other in position, each sorted by it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row travels as one column, so its own columns may have any names.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), F.col(id_col).alias("id"), F.col(source_col).alias("src"))
    rows, total = _mixed(whole, id_col="id", source_col="src", weights=weights, block=block, seed=seed)
    # Positions are gapless, so equal ranges are equal shares: no sample of them is needed.
    share = F.floor(F.col("_position") * parts / max(1, total)).cast("int")
    return rows.repartitionById(parts, share).sortWithinPartitions("_position").select("_whole.*")

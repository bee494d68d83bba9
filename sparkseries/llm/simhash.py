"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of 4-word shingles are linked at ``radius`` or fewer differing bits;
documents reachable through links form one class.

1. Equal fingerprints collapse to one row, so copies are never compared.
2. *Dealing.*  64 bits fall into ``radius + 1`` fields; two fingerprints within
   ``radius`` bits agree on a whole field, so each fingerprint goes to one bucket
   per field.  A bucket with more than ``CROWD`` fingerprints is dealt again by
   ``radius + 1`` fields of its other bits (the same argument holds), so a common
   field value is no hot task.
3. *Index.*  A bucket is sorted by Gray rank, which puts fingerprints that differ
   in few bits side by side.  Runs of ``FAN`` neighbours form a node that keeps
   the bits on which all of them agree (mask and pattern); nodes form the nodes
   above in the same way, each holding only what its parent does not.  The bucket
   is joined with itself from the root down: a pair of nodes carries the
   differences counted so far, adds those of the newly agreed bits and is pruned
   when the sum exceeds ``radius``.
4. A bucket emits a spanning forest, never its pairs: pairs whose ends are joined
   already are skipped, and two nodes that cannot differ in more than ``radius``
   bits are joined at once.
5. Components of the forests' edges are found over the fingerprints.

Defined cases: a null text counts as empty, with fingerprint 0, linked like any
other; null ids do not count for the least id of a class (null if it has no
other); repeated rows each get a row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.scratch import cut, ship_package, stored
from .rows import row_key

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a bucket beyond which it is dealt again.
CROWD = 20_000
FAN = 16
#: Node pairs looked at in one step; bounds the memory of a join.
STEP = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):  # a very long text takes no more memory than this
        ones += np.unpackbits(h[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(prints.view(np.int64))], [*kept, "fp"])


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the reflected Gray code."""
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, leaves first; a leaf agrees with itself on all bits."""
    mask, pattern = np.full(len(prints), ~np.uint64(0)), prints
    levels = [(mask, pattern)]
    while len(pattern) > 1:
        cuts = np.arange(0, len(pattern), FAN)
        all_and, all_or = np.bitwise_and.reduceat(pattern & mask, cuts), np.bitwise_or.reduceat(pattern & mask, cuts)
        shared = np.bitwise_and.reduceat(mask, cuts) & ~(all_and ^ all_or)
        mask, pattern = shared, all_or & shared
        levels.append((mask, pattern))
    return levels


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; parent holds the least member's index throughout."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        hi, lo = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def link_bucket(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Class index of each of the distinct ``prints`` (links within them only)."""
    order = np.argsort(gray_rank(prints))
    sorted_prints = prints[order]
    levels = _levels(sorted_prints)
    n = len(prints)
    parent = np.arange(n)
    top = len(levels) - 1
    # Each entry: level, left nodes, right nodes (left <= right), differences on the bits their parents agree on.
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b, _ = todo.pop()
        if len(a) > STEP:
            half = len(a) // 2
            todo += [(level, a[half:], b[half:], _[half:]), (level, a[:half], b[:half], _[:half])]
            continue
        mask, pattern = levels[level]
        both = mask[a] & mask[b]
        if level < top:  # add only the bits that the parents did not share
            pm = levels[level + 1][0]
            fresh = both & ~(pm[a // FAN] & pm[b // FAN])
        else:
            fresh = both
        sum_ = _ + np.bitwise_count((pattern[a] ^ pattern[b]) & fresh)
        near = sum_ <= radius
        a, b, both, sum_ = a[near], b[near], both[near], sum_[near]
        if not len(a):
            continue
        if level == 0:
            _merge(parent, a, b)
            continue
        width = FAN**level
        # No two members can differ in more than the bits not shared plus those that do differ.
        sure = sum_ + np.bitwise_count(~both) <= radius
        for x, y in zip(a[sure].tolist(), b[sure].tolist()):
            members = np.r_[x * width : min(n, (x + 1) * width), y * width : min(n, (y + 1) * width)]
            _merge(parent, members[:1].repeat(len(members)), members)
        a, b, sum_ = a[~sure], b[~sure], sum_[~sure]
        # Skip pairs whose members are all joined already.
        cuts = np.arange(0, n, width)
        least, most = np.minimum.reduceat(parent, cuts), np.maximum.reduceat(parent, cuts)
        open_ = (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b, sum_ = a[open_], b[open_], sum_[open_]
        below = len(levels[level - 1][0])
        step = max(1, STEP // (FAN * FAN))
        for k in range(0, len(a), step):
            x, y, s = a[k : k + step], b[k : k + step], sum_[k : k + step]
            kids = np.arange(FAN)
            left = np.repeat((x[:, None] * FAN + kids), FAN, axis=1).ravel()
            right = np.tile(y[:, None] * FAN + kids, (1, FAN)).ravel()
            s = np.repeat(s, FAN * FAN)
            ok = (left < below) & (right < below) & ((left < right) if level == 1 else (left <= right))
            todo.append((level - 1, left[ok], right[ok], s[ok]))
    classes = np.empty(n, np.int64)
    classes[order] = order[parent]
    return classes


def _forest(radius: int):
    """Buckets arrive sorted by key; each gives one edge from every member to its class."""

    def solve(prints: list[int]) -> tuple[np.ndarray, np.ndarray]:
        p = np.unique(np.array(prints, np.int64)).view(np.uint64)
        if len(p) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        classes = link_bucket(p, radius)
        least = np.full(len(p), np.iinfo(np.int64).max)
        signed = p.view(np.int64)
        np.minimum.at(least, classes, signed)
        to = least[classes]
        moved = to != signed
        return signed[moved], to[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, size = None, [], [], 0
        for batch in batches:
            keys = batch.column("bucket").to_numpy()
            prints = batch.column("fp").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for part_keys, part in zip(np.split(keys, cuts), np.split(prints, cuts)):
                if not len(part):
                    continue
                if held and part_keys[0] != key:
                    out.append(solve(np.concatenate(held)))
                    size += len(out[-1][0])
                    held = []
                    if size > 50_000:
                        yield _edges(out)
                        out, size = [], 0
                key = part_keys[0]
                held.append(part)
        if held:
            out.append(solve(np.concatenate(held)))
        if out:
            yield _edges(out)

    return run


def _edges(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in (0, 1)], ["a", "b"])


def _fields(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``parts`` fields that cover ``width`` bits."""
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _field(fp: F.Column, shift: int, bits: int) -> F.Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) over a table of distinct fingerprints ``fp``; unlinked ones may be missing."""
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fp = F.col("fp")
    fields = _fields(64, radius + 1)
    first = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _field(fp, s, b).alias("v")) for i, (s, b) in enumerate(fields)])).alias("k")).select("fp", "k.i", "k.v")
    crowds = cut(first.groupBy("i", "v").count().filter(F.col("count") > CROWD).select(F.col("i").alias("ci"), F.col("v").alias("cv")))
    few = F.xxhash64("i", "v").alias("bucket")
    at = [F.col("i") == F.col("ci"), F.col("v") == F.col("cv")]
    if crowds.isEmpty():
        dealt = first.select(few, "fp")
    else:
        crowds = F.broadcast(crowds)  # no more than (radius + 1) * 2 ** 13 field values exist
        calm = first.join(crowds, at, "left_anti").select(few, "fp")
        # The other bits, rotated so that the shared field comes last and is left out.
        again = []
        for i, (s, b) in enumerate(fields):
            rest = fp if s == 0 else F.shiftleft(fp, 64 - s).bitwiseOR(F.shiftrightunsigned(fp, s))
            rest = F.shiftrightunsigned(rest, b)
            for j, (s2, b2) in enumerate(_fields(64 - b, radius + 1)):
                again.append(F.struct(F.lit(i).alias("i2"), F.lit(j).alias("j"), _field(rest, s2, b2).alias("v2")))
        busy = first.join(crowds, at, "left_semi").select("fp", "i", "v", F.explode(F.array(*again)).alias("k")).filter("k.i2 = i")
        dealt = calm.unionByName(busy.select(F.xxhash64("i", "v", "k.j", "k.v2").alias("bucket"), "fp"))
    edges = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_forest(radius), "a long, b long")
    return connected_components(edges)


def _classes(texts: DataFrame, radius: int) -> DataFrame:
    """The rows of (id, text, ...) without their text, with fp, component_id and ``chosen``, the
    least fingerprint of the class that the id component_id has in it (null if all ids are)."""
    spark = texts.sparkSession
    ship_package(spark)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"]
    rows = stored(texts.mapInArrow(_fingerprints, ", ".join([*kept, "fp long"])), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = link_fingerprints(prints.select("fp"), radius)
    # Most fingerprints have no link and are a class by themselves; the rest meet under their root.
    linked = stored(prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "linked")
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp")))
    least = stored(linked.groupBy("root").agg(first.alias("first")).select("root", F.col("first.least").alias("component_id"), F.col("first.fp").alias("chosen")), "roots")
    alone = prints.join(linked.select("fp"), "fp", "left_anti").select(F.col("fp").alias("fp2"), F.col("least").alias("component_id"), F.col("fp").alias("chosen"))
    of_print = stored(linked.join(least, "root").select(F.col("fp").alias("fp2"), "component_id", "chosen").union(alone), "classes")
    return rows.join(of_print, F.col("fp") == F.col("fp2"))


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id of its class)."""
    out = _classes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), radius)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with the row of least id of each class; of those with that id, the one of least
    fingerprint and text digest.  Rows of one id are judged by their own texts.

    Rows with a null id are kept: nothing says which of a class they are.
    """
    key = row_key(id_col, text_col)
    known = docs.filter(F.col(id_col).isNotNull())
    rows = _classes(docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull(), key).alias("key"), F.col(text_col).alias("text")), radius)
    first = rows.filter((F.col("id") == F.col("component_id")) & (F.col("fp") == F.col("chosen")))
    kept = first.groupBy("component_id", "chosen").agg(F.min("key").alias("_sparkseries_kept")).select("_sparkseries_kept")
    known = known.withColumn("_sparkseries_key", key).join(kept, F.col("_sparkseries_key") == F.col("_sparkseries_kept"), "left_semi")
    return known.dropDuplicates(["_sparkseries_key"]).drop("_sparkseries_key").unionByName(docs.filter(F.col(id_col).isNull()))

"""Exact substring deduplication by threshold-bounded interval expansion on a BWT.

A byte is removed when a ``length``-byte string covers it that also starts at
another place of the corpus (another document or another offset of the same
one).  Strings are judged on the input, overlaps count, matches never cross
documents.

How it is spread over a cluster
-------------------------------
1. Equal texts collapse to one row with its number of copies; the distinct
   texts are stored once, bucketed by their digest, so no later join moves a
   text again.
2. *Anchors.*  Every window of ``length`` bytes selects its smallest
   ``ANCHOR``-byte gram by hash (rightmost on ties).  Equal windows select equal
   anchors, so all windows that can match meet under one anchor key.  The bytes
   of the consecutive windows that select one anchor are its *context*.
3. Anchors are counted with map-side combining; those seen once are done with.
   Contexts that are equal byte for byte are one context with a weight.
4. Contexts under one anchor that agree on one half of a window (a digest of the
   bytes left or right of the anchor) are joined to their bytes, and contexts of one
   anchor form a group.  Groups are concatenated into blocks of bounded size.  For each
   block a Burrows-Wheeler transform is built and intervals are expanded breadth first
   by backward extension: level l marks the rank boundaries whose common prefix is
   exactly l, in increasing order, and the expansion stops at ``length``.  Ranks not
   separated by then share at least ``length`` bytes.
5. A group of more than ``GROUP`` bytes (a very common line) is dealt finer first.  The
   windows of a context that hold the anchor at neighbouring offsets share all but a
   few of their bytes, and equal windows hold it at the same offset: so each context
   is cut into runs of ``WIDTHS[0]`` windows, those of one run of offsets that agree
   on the shared bytes are a group, equal runs are one run with a weight, and groups
   are expanded as above, or dealt finer again where they are still too large.  Runs
   of one window that meet are equal, and only their weights count.  So no task holds
   more than a block and a group, however many documents share a line.

Texts and contexts count as equal when 128-bit digests of their bytes are.

Defined cases: null text counts as empty; texts shorter than ``length`` keep
all bytes; repeated rows are copies of each other; extra columns are ignored;
an empty table gives an empty result.  Null ids are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import bucketed, ship_package, stored

LENGTH = 200
ANCHOR = 32
#: Bytes of a text that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Bytes of contexts in one transform, and of one group at most.
BLOCK, GROUP = 1 << 20, 1 << 15
#: Windows of a run when groups are dealt finer; the last must be 1.
WIDTHS = (24, 4, 1)
#: How tables of digests are written: nothing in them repeats or compresses much.
DIGESTS = {"compression": "snappy", "parquet.enable.dictionary": "false"}

_POS_BITS = np.uint64(22)
_MULT = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _tables:
        n = PIECE * 2 + 4096
        inverse = pow(_MULT, -1, 1 << 64)
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for arr, m in ((up, _MULT), (down, inverse)):
            arr[0] = 1
            filled = 1
            while filled < n:  # doubling: the next stretch is the last one times m ** filled
                more = min(filled, n - filled)
                arr[filled : filled + more] = arr[:more] * np.uint64(pow(m, filled, 1 << 64))
                filled += more
        byte = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        _tables.update(up=up, down=down, byte=byte)
    return _tables["up"], _tables["down"], _tables["byte"]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit rolling hashes of all k-grams of ``data`` (uint8)."""
    up, down, byte = _powers()
    n = len(data)
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(byte[data] * up[:n], out=s[1:])
    h = (s[k:] - s[: n + 1 - k]) * down[: n + 1 - k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, place of the anchor) for each run of windows with one anchor."""
    h = gram_hashes(data, k)
    w = length - k + 1
    n_windows = len(data) - length + 1
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    pad = -len(key) % w
    if pad:
        key = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)])
    rows = key.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[:n_windows], ahead[w - 1 : w - 1 + n_windows])
    at = (low - (best & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n_windows))
    return h[at[first]].view(np.int64), first, count, at[first]


def side_digests(body: bytes, first: int, n: int, place: int, length: int = LENGTH, k: int = ANCHOR) -> int:
    """32-bit digests of the bytes to the left and right of an anchor, packed into one number.

    A window holds at least half of the bytes besides its anchor on one side of it,
    so contexts that share a window agree on that half.  0 where no window of the
    context has that much on a side.
    """
    half = (length - k + 1) // 2
    left = xxhash.xxh32_intdigest(body[place - half : place]) | 1 if place - first >= half else 0
    right = xxhash.xxh32_intdigest(body[place + k : place + k + half]) | 1 if first + n - 1 + length - place - k >= half else 0
    return (left << 32 | right) - (1 << 64 if left >> 31 else 0)


def _pieces(size: int, length: int) -> Iterator[tuple[int, int]]:
    """[start, end) byte ranges whose windows partition those of a text of ``size`` bytes."""
    for start in range(0, size - length + 1, PIECE):
        yield start, min(size, start + PIECE + length - 1)


def _anchor_rows(length: int):
    """One row per anchor of each text: its context's digest and place, the anchor's place in it, and its sides."""
    names = ["anchor", "ctx", "tk", "at", "n", "p", "w", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        out: list[list] = [[] for _ in names]
        held = 0

        def rows() -> pa.RecordBatch:
            join = np.concatenate
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if n in ("ctx", "tk") else pa.array(join(c)) for n, c in zip(names, out)], names)

        for batch in batches:
            for key, body, copies in zip(*(batch.column(c) for c in ("tk", "body", "copies"))):
                key, body, weight = key.as_py(), body.as_py(), min(2, copies.as_py())
                for lo, hi in _pieces(len(body), length):
                    a, first, n, place = anchors(np.frombuffer(body, np.uint8, hi - lo, lo), length)
                    first, place = first + lo, place + lo
                    at, p = first.tolist(), (place - first).tolist()
                    out[0].append(a)
                    out[1] += [digest(body[s:e], x) for s, e, x in zip(at, (first + n + (length - 1)).tolist(), p)]
                    out[2] += [key] * len(a)
                    out[3].append(first.astype(np.int32))
                    out[4].append(n.astype(np.int32))
                    out[5].append((place - first).astype(np.int32))
                    out[6].append(np.full(len(a), weight, np.int8))
                    out[7].append(np.array([side_digests(body, f, c, f + x, length) for f, c, x in zip(at, n.tolist(), p)], np.int64))
                    held += len(a)
                    if held > 100_000:
                        yield rows()
                        out, held = [[] for _ in names], 0
        if held:
            yield rows()

    return run


def truncated_bwt(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, last column) of the suffixes of ``text`` sorted by at least ``depth`` symbols.

    ``text`` holds symbols 1..256 and separators 0.  Intervals of strings of up
    to ``depth`` symbols are contiguous in this order whatever the ties do, which
    is all that backward extension to that depth needs.
    """
    n = len(text)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | wide[j : n + j]
    span = 7
    while True:
        order = np.argsort(key, kind="stable" if n < 64 else None)
        sorted_key = key[order]
        change = np.empty(n, np.int64)
        change[0] = 1
        change[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        if span >= depth or change.all():
            return order, text[order - 1]
        after = np.zeros(n, np.int64)
        if span < n:
            after[: n - span] = rank[span:]
        key = rank * (n + 1) + after
        span *= 2


def boundaries_below(last: np.ndarray, length: int) -> np.ndarray:
    """Rank boundaries whose common prefix is shorter than ``length``.

    Breadth-first backward extension: level l holds the intervals of strings of
    l symbols whose right boundary was not known before; extending them by every
    preceding symbol (through a wavelet matrix) finds the boundaries of value l.
    Returns flags for boundaries 0..n (both ends set).
    """
    n = len(last)
    symbols, dense = np.unique(last, return_inverse=True)
    bits = max(1, int(len(symbols) - 1).bit_length())
    ranks, zeros, cur = [], [], dense.astype(np.int32)
    for b in range(bits - 1, -1, -1):
        bit = (cur >> b) & 1
        r = np.zeros(n + 1, np.int32)
        np.cumsum(1 - bit, out=r[1:])
        ranks.append(r)
        zeros.append(int(r[-1]))
        cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
    counts = np.bincount(dense, minlength=len(symbols))
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])  # start of each symbol's suffixes
    begins = np.zeros(len(symbols), np.int64)  # start of each symbol in the lowest level
    starts = np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]]))
    begins[cur[starts]] = starts
    shift = (base - begins)[cur]  # from a place in the lowest level to a rank

    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        for r, z in zip(ranks, zeros):
            l0, r0 = r[lo], r[hi]
            l1, r1 = lo - l0 + z, hi - r0 + z
            keep0, keep1 = l0 < r0, l1 < r1
            lo = np.concatenate([l0[keep0], l1[keep1]])
            hi = np.concatenate([r0[keep0], r1[keep1]])
        moved = shift[lo]
        lo, hi = (lo + moved).astype(np.int32), (hi + moved).astype(np.int32)
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        if not len(lo):
            break
        known[hi] = True
    return known


def repeated_windows(contexts: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more (weights count)."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(starts[-1]), np.int64)
    for c, s in zip(contexts, starts.tolist()):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8)
        text[s : s + len(c)] += 1
    order, last = truncated_bwt(text, length + 1)
    known = boundaries_below(last, length)
    group = np.cumsum(known[:-1]) - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    weight = np.array(weights)[owner]
    total = np.bincount(group, weights=weight[order])
    twice = np.zeros(len(text), bool)
    twice[order] = total[group] >= 2
    return [twice[s : s + max(0, z - length + 1)] for s, z in zip(starts.tolist(), sizes.tolist())]


def _expand(length: int):
    """Masks of the windows that are repeated; rows of one group arrive together, several groups share a block, none is split."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        masks = repeated_windows([r[2] for r in rows], [r[3] for r in rows], length)
        kept = [(r[1], len(m), np.packbits(m).tobytes()) for r, m in zip(rows, masks) if r[3] == 1 and m.any()]
        return pa.RecordBatch.from_arrays([pa.array([k[j] for k in kept], t) for j, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], ["sub", "n", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "sub", "body", "w")]
            for row in zip(*cols):
                if held >= BLOCK and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield solve(rows)

    return run


def _slices(length: int):
    """Cut the contexts out of their texts."""
    names = ["key", "sub", "body", "p", "w", "big"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for body, items in zip(batch.column("body"), batch.column("items")):
                body = body.as_py()
                for x in items.as_py():
                    piece = body[x["at"] : x["at"] + x["n"] + length - 1]
                    out.append((x["anchor"], x["ctx"], piece, x["p"], x["w"], x["big"]))
                    size += len(piece)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return run


def runs(p: int, n: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """The runs of a context of ``n`` windows whose anchor is at ``p``: number, first window, windows, and the bytes
    (start, end) that all windows have which hold the anchor at an offset of the run, here or elsewhere."""
    for c in range((p - n + 1) // width, p // width + 1):
        most, least = min(p, c * width + width - 1), max(p - n + 1, c * width)
        yield c, p - most, most - least + 1, p - c * width, p - c * width - width + 1 + length


def _deal(width: int, length: int):
    """The runs of contexts: whose, from which window on, their group and their own digest."""
    names = ["owner", "i0", "n", "key", "sub", "body", "p", "w"]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            for owner, body, p, w in zip(*(batch.column(x).to_pylist() for x in ("sub", "body", "p", "w"))):
                for c, i0, n, lo, hi in runs(p, len(body) - length + 1, width, length):
                    piece = body[i0 : i0 + n + length - 1]
                    key = group(body[lo:hi], c)
                    out.append((owner, i0, n, key - (1 << 64 if key >> 63 else 0), digest(piece, p - i0), piece if width > 1 else b"", p - i0, w))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return run


def _repeated(contexts: DataFrame, widths: tuple[int, ...], length: int) -> DataFrame:
    """(sub, i0, n, mask): of the context ``sub`` the windows of ``n`` from ``i0`` on that are repeated, all where mask is null.

    ``contexts``: stored rows (key, sub, body, p, w, big) of different contexts; those of one key are a group.
    """
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = contexts.filter("not big").select("key", "sub", "body", "w").repartition(parts, "key").sortWithinPartitions("key")
    found = groups.mapInArrow(_expand(length), "sub binary, n int, mask binary").select("sub", F.lit(0).alias("i0"), "n", "mask")
    big = contexts.filter("big")
    if big.isEmpty():
        return found
    dealt = stored(big.mapInArrow(_deal(widths[0], length), "owner binary, i0 int, n int, key long, sub binary, body binary, p int, w int"), "runs")
    # Equal runs become one before they are shuffled, however many texts hold them.
    subs = stored(dealt.groupBy("key", "sub").agg(F.sum("w").alias("w"), *[F.first(c).alias(c) for c in ("n", "body", "p")]), "subs")
    inner = subs.filter("w > 1").select("sub", F.lit(0).alias("i0"), "n", F.lit(None).cast("binary").alias("mask"))
    if len(widths) > 1:
        crowds = stored(subs.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") + (length - 1)).alias("size")).filter("k > 1"), "crowds")
        rows = subs.join(crowds, "key").select("key", "sub", "body", "p", F.least("w", F.lit(2)).cast("int").alias("w"), (F.col("size") > GROUP).alias("big"))
        inner = inner.unionByName(_repeated(stored(rows, "cuts"), widths[1:], length))
    inner = inner.select(F.col("sub").alias("s2"), F.col("i0").alias("i2"), F.col("n").alias("n2"), "mask")
    lifted = dealt.join(inner, F.col("sub") == F.col("s2")).select(F.col("owner").alias("sub"), (F.col("i0") + F.col("i2")).alias("i0"), F.col("n2").alias("n"), "mask")
    return found.unionByName(lifted)


def covered(size: int, found: list[dict], length: int) -> np.ndarray:
    """Flags of the bytes that repeated windows cover."""
    edge = np.zeros(size + 1, np.int32)
    for x in found:
        if x["mask"] is None:
            s = np.arange(x["at"], x["at"] + x["n"])
        else:
            s = x["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8))[: x["n"]])
        np.add.at(edge, s, 1)
        np.add.at(edge, s + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _results(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body, copies, items in zip(*(batch.column(c) for c in ("tk", "body", "copies", "items"))):
                body, items = body.as_py(), items.as_py()
                size = len(body)
                if copies.as_py() > 1 and size >= length:
                    gone, spans, kept = size, 1, b""
                elif items:
                    flags = covered(size, items, length)
                    gone = int(flags.sum())
                    spans = int(flags[0]) + int((flags[1:] & ~flags[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~flags].tobytes()
                else:
                    gone, spans, kept = 0, 0, body
                row = [key.as_py(), size, gone, spans, hashlib.sha256(kept).hexdigest()]
                rows.append([*row, kept.decode("utf-8", "ignore")] if with_text else row)
            names = ["tk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in zip(range(len(names)), types)], names)

    return run


def remove_repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    ``kept_text`` drops bytes that are no whole character after a cut.  See the
    module docstring for the method and the defined cases.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(body)).alias("tk"), body.alias("body"))
    texts = bucketed(rows.groupBy("tk").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies")), "texts", "tk")

    occurrences = stored(texts.mapInArrow(_anchor_rows(length), "anchor long, ctx binary, tk binary, at int, n int, p int, w tinyint, sides long"), "anchors", **DIGESTS)
    # Stored, so that both sides of the join come from plain exchanges and Spark can split the rows of a common anchor.
    twice = stored(occurrences.groupBy("anchor").agg(F.sum("w").alias("seen")).filter("seen > 1").select("anchor"), "twice", **DIGESTS)
    occurrences = stored(occurrences.join(twice, "anchor"), "occurrences", **DIGESTS)

    first = F.min(F.struct("tk", "at")).alias("x")
    contexts = occurrences.groupBy("ctx").agg(F.sum("w").cast("int").alias("w"), first, *[F.first(c).alias(c) for c in ("anchor", "n", "p", "sides")])
    contexts = stored(contexts.select("anchor", "ctx", "w", "x.tk", "x.at", "n", "p", "sides"), "contexts")
    # Only contexts that agree with another one on half of a window can share one with it.
    halves = F.array(F.struct(F.lit(0).alias("s"), F.shiftrightunsigned("sides", 32).alias("d")), F.struct(F.lit(1).alias("s"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("d")))
    sides = contexts.select("anchor", "ctx", F.explode(halves).alias("h")).select("anchor", "ctx", "h.s", "h.d").filter("d <> 0")
    met = stored(sides.groupBy("anchor", "s", "d").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor", "s", "d"), "halves")
    alike = stored(sides.join(met, ["anchor", "s", "d"], "left_semi").select("ctx").distinct(), "alike")
    alike = stored(contexts.join(alike, "ctx", "left_semi"), "alike")
    crowds = stored(alike.groupBy("anchor").agg(F.sum(F.col("n") + (length - 1)).alias("size")), "crowds")
    open_ = alike.join(crowds, "anchor").select("anchor", "ctx", F.least("w", F.lit(2)).alias("w"), "tk", "at", "n", "p", (F.col("size") > GROUP).alias("big"))
    wanted = open_.groupBy("tk").agg(F.collect_list(F.struct("anchor", "ctx", "w", "at", "n", "p", "big")).alias("items"))
    cuts = texts.join(wanted, "tk").select("body", "items").mapInArrow(_slices(length), "key long, sub binary, body binary, p int, w int, big boolean")
    cuts = stored(cuts, "cuts")

    masks = _repeated(cuts, WIDTHS, length)
    whole = contexts.filter("w > 1").select(F.col("ctx").alias("sub"), F.lit(0).alias("i0"), "n", F.lit(None).cast("binary").alias("mask"))
    masks = stored(masks.unionByName(whole).withColumnsRenamed({"n": "n2"}), "masks")
    found = occurrences.join(masks, F.col("ctx") == F.col("sub")).select("tk", (F.col("at") + F.col("i0")).alias("at"), F.col("n2").alias("n"), "mask")
    found = found.groupBy("tk").agg(F.collect_list(F.struct("at", "n", "mask")).alias("items"))

    shape = "tk binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    solved = texts.join(found, "tk", "left").mapInArrow(_results(length, with_text), shape)
    return rows.select("id", "tk").join(solved, "tk").drop("tk").withColumnRenamed("id", id_col)


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL for the rows of the operator on documents: every window by its digest (texts as hex digits)."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, {2 * length})) AS k FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM d)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM twice)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + {length} AS hi FROM g GROUP BY doc_id, island),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER p, 0) AS a, lo AS b FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY lo) UNION ALL SELECT s.doc_id, max(hi), any_value(n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
m AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

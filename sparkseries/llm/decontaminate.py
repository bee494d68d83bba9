"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document leaks a benchmark item when it holds at least ``threshold`` of the
item's distinct 5-word shingles (ASCII letters in lower case, words split at
white space; an item of fewer words is one shingle of all its words).

Short items inside long documents have a tiny Jaccard similarity, so containment
is searched instead, in partitions of the items by size:

* Items are partitioned by their number q of distinct shingles.  Each size has its
  own signature: the k smallest shingle hashes (bottom-k MinHash).  Of the q shingles
  a leaking document holds need = ceil(threshold * q), so it misses q - need at most,
  and of any k it holds k - (q - need) at least.  With k = q - need + PROBES that is
  PROBES (need, if that is less): the signature's length follows from size and
  threshold, and no leak is lost.
* Each document's shingles are hashed once in a streaming pass; a Bloom filter of
  bounded size over the items' shingles drops those that occur in no item, so what
  is shuffled are matches, not the corpus' shingles.  A document with fewer shingles
  than the smallest need is not probed.
* Candidates are the (document, item) pairs with PROBES matches in the signature.
* Only for candidates are the item's shingles looked up in the document and counted,
  compared as strings.

Defined cases: null or empty texts hold no shingle and match nothing; repeated
item ids are one item whose shingles are united; null item ids are ignored;
empty tables give empty results; further columns are ignored.  ``find_leaks``
unites document rows of the same id, and those of null ids, which it reports with
a null id; ``drop_leaking`` judges each row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package, stored
from .rows import row_key

SHINGLE, THRESHOLD = 5, 0.8
#: Bits of the Bloom filter at most (8 MB), whatever the number of items.
BLOOM_BITS = 1 << 26
#: Matches in its signature that make an item a candidate.
PROBES = 2


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Distinct ``size``-word shingles of a text; none if it has fewer words."""
    words = (text or "").encode().lower().split()
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def _hashes(text: str | None, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined words and (start, end, hash) of each shingle."""
    words = (text or "").encode().lower().split()
    none = np.empty(0, np.int64)
    if len(words) < size:
        return b"", none, none, np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    ends = ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64)
    return joined, starts, ends, h


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, hs, texts = [], [], [], []
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            n = len((t or "").encode().split())
            size = min(SHINGLE, n)
            if size:
                found = shingles(t, size)
                ids += [i] * len(found)
                sizes += [size] * len(found)
                hs += [xxhash.xxh64_intdigest(s) for s in found]
                texts += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(texts, pa.binary())], ["item_id", "size", "h", "shingle"])


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def bloom_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """Byte array with two bits per hash; its size follows ``count`` up to BLOOM_BITS.

    Filled per partition and merged by positions: what reaches the driver are words
    of 64 bits, at most BLOOM_BITS / 64 of them (12 bytes each).
    """
    bits = min(BLOOM_BITS, max(1 << 13, 1 << (max(1, count) * 16).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column("h").to_numpy().view(np.uint64), bits)))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["at", "bit"])

    words = hashes.select("h").mapInArrow(fill, "at int, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, "<u8")
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _matches(bloom, sizes: list[int], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        bits = len(table) * 8
        for batch in batches:
            ids, ns, hs, texts = [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                t = t.as_py()
                for size in sizes:
                    joined, starts, ends, h = _hashes(t, size)
                    if len(h) < (least if size == SHINGLE else 1):
                        continue
                    x, y = _bits(h, bits)
                    hit = (table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & (table[y >> np.uint64(3)] >> (y & np.uint64(7)).astype(np.uint8)) & 1
                    seen = set()
                    for j in np.flatnonzero(hit).tolist():
                        s = joined[starts[j] : ends[j]]
                        if s not in seen:
                            seen.add(s)
                            ids.append(i)
                            ns.append(size)
                            hs.append(h[j])
                            texts.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(ns, pa.int32()), pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(texts, pa.binary())], ["id", "size", "h", "shingle"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc id, item_id, n_item_shingles, n_found, containment) for every leaking pair."""
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    leaks = _leaks(docs.select(key.alias("id"), F.col(text_col).alias("text")), items, item_id, item_text, threshold)
    return leaks.withColumn("id", F.expr("try_cast(id AS long)")).withColumnRenamed("id", id_col)


def _index(items: DataFrame, item_id: str, item_text: str, threshold: float) -> DataFrame:
    """One row per item and distinct shingle, with q, need, probes and whether it is in the signature; stored."""
    own = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    index = own.mapInArrow(_item_shingles, "item_id long, size int, h long, shingle binary").distinct()
    sizes = index.groupBy("item_id").agg(F.count(F.lit(1)).alias("q"))
    index = index.join(sizes, "item_id").withColumn("need", F.ceil(F.lit(threshold) * F.col("q") - 1e-9).cast("long"))
    index = index.withColumn("probes", F.least(F.lit(PROBES), "need"))
    # Windows per item, none larger than an item.
    index = index.withColumn("place", F.expr("row_number() OVER (PARTITION BY item_id ORDER BY h, shingle)"))
    return stored(index.withColumn("signature", F.col("place") <= F.col("q") - F.col("need") + F.col("probes")), "benchmark")


def _candidates(found: DataFrame, index: DataFrame) -> DataFrame:
    """(id, item_id) of the pairs with enough matches in the item's signature; ``found``: distinct matches of documents."""
    on = ["size", "h", "shingle"]
    hits = found.join(index.filter("signature").select("item_id", "probes", *on), on)
    return hits.groupBy("id", "item_id", "probes").agg(F.count(F.lit(1)).alias("n")).filter("n >= probes").select("id", "item_id")


def _leaks(texts: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float) -> DataFrame:
    """The rows of ``find_leaks`` for documents (id, text); rows of one id are one document."""
    spark = texts.sparkSession
    ship_package(spark)
    index = _index(items, item_id, item_text, threshold)
    facts = index.agg(F.count(F.lit(1)), F.collect_set("size"), F.min(F.when(F.col("size") == SHINGLE, F.col("need")))).first()
    bloom = spark.sparkContext.broadcast(bloom_filter(index, facts[0]))
    found = texts.mapInArrow(_matches(bloom, sorted(facts[1]) or [SHINGLE], facts[2] or 1), "id string, size int, h long, shingle binary")
    found = stored(found, "matches").distinct()
    # An item's shingles are joined to its candidates, then looked up in the document by (id, shingle), which no hot item or shingle fills.
    wanted = _candidates(found, index).join(index.select("item_id", "q", "need", "size", "h", "shingle"), "item_id")
    counted = wanted.join(found, ["id", "size", "h", "shingle"]).groupBy("id", "item_id", "q", "need").agg(F.count(F.lit(1)).alias("n_found"))
    return counted.filter("n_found >= need").select("id", "item_id", F.col("q").alias("n_item_shingles"), "n_found", (F.col("n_found") / F.col("q")).alias("containment"))


def drop_leaking(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that leak an item, each judged by its own text, whatever its id."""
    key = row_key(id_col, text_col)
    leaks = _leaks(docs.select(key.alias("id"), F.col(text_col).alias("text")), items, "item_id", "text", threshold)
    return docs.join(leaks.select(F.col("id").alias("_sparkseries_leak")).distinct(), key == F.col("_sparkseries_leak"), "left_anti")


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of ``find_leaks`` on documents and benchmark."""
    low = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH b AS (SELECT item_id, {low} AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS s FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, greatest(len(w) - 4, least(1, len(w))) + 1)) AS i FROM b)),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id),
d AS (SELECT doc_id, {low} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, n, w[i:i + n - 1] AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs)))
SELECT ds.doc_id, bs.item_id, q.q AS n_item_shingles, count(*) AS n_found, count(*) / q.q AS containment
FROM ds JOIN bs ON ds.n = bs.n AND ds.s = bs.s JOIN q ON q.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id, q.q HAVING count(*) >= {threshold} * q.q - 1e-9
"""



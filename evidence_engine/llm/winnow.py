"""Benchmark decontamination by winnowing.

Both sides are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A k-gram of
words is hashed, and of every w neighbouring k-grams the one with the least hash is kept (the rightmost of
equals). With w + k - 1 = ``window``, two texts that share ``window`` words in a row keep the same k-gram
of them. Fingerprints of both sides are joined, the words beside each hit are compared word by word, and
spans of at least ``window`` words count. Shorter items have one window, all their words: for those
lengths (at most window - 1 of them) every gram is a fingerprint.

What is broadcast: a bitmap of fixed size that says which fingerprints any item has (a full bitmap lets
more rows through to the join, and nothing else), and the item fingerprints only up to
``BROADCAST_ROWS``; beyond that the join shuffles both sides and Spark splits hot fingerprints.

Defined cases: null text has no words; items without words have no window; items with a null id take no
part; a document row is named by its id and text, so rows that repeat both get the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

#: Bits of the bitmap of item fingerprints.
BITMAP_BITS = 1 << 23
#: Item fingerprints (about 200 bytes each) up to which they are sent to all machines.
BROADCAST_ROWS = 100_000

_FP = "length int, hash bigint, pos int, before string, body string, after string"
_FP_ARROW = pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])


def gram_size(length: int, window: int) -> int:
    """k for spans of that many words: about half of the window; all words of a shorter item."""
    return (window + 1) // 2 if length == window else length


def fingerprints(hashes: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words where kept k-grams of spans of ``length`` words begin, and the grams' hashes."""
    k = gram_size(length, window)
    gram, at = S.gram_hashes(hashes, k), S.within_rows(first, length)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    w = length - k + 1
    best, which = gram[at].copy(), np.zeros(len(at), np.int64)
    for j in range(1, w):
        h = gram[at + j]
        better = h <= best
        np.copyto(best, h, where=better)
        which[better] = j
    kept = np.unique(at + which)
    return kept, gram[kept]


def _rows_of(data, start, end, first, row_of, kept, hashes, length, window):
    """Fingerprints with the words beside them that a span of ``length`` words may still need."""
    k = gram_size(length, window)
    reach = length - k
    raw = data.tobytes()
    word = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")
    for i, h in zip(kept.tolist(), S.signed(hashes).tolist()):
        lo, hi = first[row_of[i]], first[row_of[i] + 1]
        yield {
            "length": length, "hash": h, "pos": int(i - lo),
            "before": " ".join(word(j) for j in range(i - 1, max(lo, i - reach) - 1, -1)),
            "body": " ".join(word(j) for j in range(i, i + k)),
            "after": " ".join(word(j) for j in range(i + k, min(hi, i + k + reach))),
        }


def _reader(lengths: list[int], window: int, bitmap):
    """mapInArrow function: (id, rid, text) to (id, rid, n_words, fingerprints that the bitmap lets through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, off = S.flat(batch.column(2))
            counts, found, spread = [], [], []
            for _, _, part, part_off in S.slices(data, off):
                part = S.LOWER[part]
                start, end, first = S.word_bounds(part, part_off, S.IS_ALNUM)
                hashes = S.word_hashes(part, start, end)
                row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                per_row: list[list] = [[] for _ in range(len(first) - 1)]
                for length in lengths:
                    kept, h = fingerprints(hashes, first, length, window)
                    if bits is not None:
                        slot = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                        through = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                        kept, h = kept[through], h[through]
                    for i, row in zip(kept, _rows_of(part, start, end, first, row_of, kept, h, length, window)):
                        per_row[row_of[i]].append(row)
                counts.append(np.diff(first))
                for row in per_row:
                    spread.append(len(row))
                    found += row
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), S.lists(pa.array(found, _FP_ARROW), np.array(spread, np.int64))],
                names=["id", "rid", "n_words", "fps"],
            )

    return run


def common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            keep, lo, hi = [], [], []
            for i, length in enumerate(t["length"]):
                left = common(t["before"][i].split(" ") if t["before"][i] else [], t["item_before"][i].split(" ") if t["item_before"][i] else [])
                right = common(t["after"][i].split(" ") if t["after"][i] else [], t["item_after"][i].split(" ") if t["item_after"][i] else [])
                k = gram_size(length, window)
                if left + k + right >= length:
                    keep.append(i)
                    lo.append(t["pos"][i] - left)
                    hi.append(t["pos"][i] + k + right)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("rid").take(at), batch.column("item_id").take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=["id", "rid", "item_id", "lo", "hi"],
            )

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row per document row, spans): id, rid, n_words, n_hit, items (sorted as strings); and id, rid, item_id, lo, hi.

    lo and hi are word positions; the spans of one document and item may overlap.
    """
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=4)
    named = bench.select(F.col(item_col).cast("string").alias("id"), F.lit(0).cast("bigint").alias("rid"), F.col(item_text).cast("string").alias("text")).where("id is not null")
    size = F.size(F.filter(F.split(S.lower_az(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))
    sized = named.withColumn("n", F.least(size, F.lit(window))).where("n > 0")
    lengths = sorted(r.n for r in sized.select("n").distinct().collect())  # at most ``window`` values
    parts = [sized.where(F.col("n") == n).drop("n").mapInArrow(_reader([n], window, None), f"id string, rid bigint, n_words bigint, fps array<struct<{_FP}>>") for n in lengths]
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]
    if not parts:
        none = spark.createDataFrame([], f"id {kind}, rid bigint, item_id string, lo int, hi int")
        return source.mapInArrow(_reader([], window, None), f"id {kind}, rid bigint, n_words bigint, fps array<struct<{_FP}>>").select("id", "rid", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items")), none
    fps = parts[0]
    for p in parts[1:]:
        fps = fps.unionByName(p)
    items = S.settled(fps.select(F.col("id").alias("item_id"), F.inline("fps")).select("item_id", "length", "hash", "pos", F.col("before").alias("item_before"), "body", F.col("after").alias("item_after")).distinct(), "winnow-items")
    # One bit a slot, so at most BITMAP_BITS small integers come to the driver whatever the items' number.
    slots = np.array([r[0] for r in items.select(F.col("hash").bitwiseAND(BITMAP_BITS - 1).cast("int").alias("slot")).distinct().toLocalIterator()], np.int64)
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    read = S.settled(source.mapInArrow(S.trimmed(_reader(lengths, window, spark.sparkContext.broadcast(bits.tobytes()))), f"id {kind}, rid bigint, n_words bigint, fps array<struct<{_FP}>>"), "winnow-docs")
    small = items.drop("pos").distinct()
    small = F.broadcast(small) if items.count() <= BROADCAST_ROWS else small
    pairs = read.where(F.size("fps") > 0).select("id", "rid", F.inline("fps")).join(small, ["length", "hash", "body"])
    spans = pairs.select("id", "rid", "item_id", "length", "pos", "before", "after", "item_before", "item_after").mapInArrow(_extend(window), f"id {kind}, rid bigint, item_id string, lo int, hi int")
    spans = S.settled(spans.distinct(), "winnow-spans")
    # New words of each span beyond what the spans before it cover.
    by_doc = Window.partitionBy("id", "rid").orderBy("lo", "hi")
    covered = spans.select("id", "rid", "lo", "hi").distinct().withColumn("upto", F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    n_hit = covered.groupBy("id", "rid").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("upto", "lo")))).cast("bigint").alias("n_hit"))
    which = spans.groupBy("id", "rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = n_hit.join(which.withColumnsRenamed({"id": "id2", "rid": "rid2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("rid") == F.col("rid2"))).select("id", "rid", "n_hit", "items")
    h = hits.withColumnsRenamed({"id": "h_id", "rid": "h_rid"})
    out = read.select("id", "rid", "n_words").join(h, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("rid") == F.col("h_rid")), "left")
    return out.select("id", "rid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")), spans


def op4(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, _ = decontaminate(docs, bench)
    return rows.select(
        F.col("id").cast("bigint").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a benchmark window."""
    rows, _ = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = rows.where("n_hit > 0").select(F.col("id").alias("bad_id"), F.col("rid").alias("bad_rid")).distinct()
    key = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")) & (key == F.col("bad_rid")), "left_anti")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM w, sizes, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, i, grams.n FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

"""Exact removal of long repeated byte strings, decided by suffix arrays.

A window is a string of ``length`` bytes inside one text; a window that begins anywhere else too is a repeat, and
every byte under a repeat goes. Suffixes of the whole corpus never stand in one place. Each window is named by
its anchor, the least hash of the ``GRAM``-byte strings in it, so equal windows have equal anchors; windows in a
row with one anchor make a segment, a piece of text of at most 2 length - GRAM bytes. Then

1. equal texts are made one (their bytes shuffle once; the table of texts is bucketed by their digests, so the
   later joins with texts move no text), and their segments are listed as numbers;
2. segments whose anchor stands nowhere else are done: none of their windows is a repeat;
3. segments are counted by content, partially before the shuffle: in one that stands more than once every
   window is a repeat;
4. of anchors with segments of different content, one copy of each is cut out. A window that reaches over its
   anchor on one side by half of what it has besides shares that longer string (a side) with its repeat, so
   segments neither of whose sides stands in another one are done. The rest go to shards by their anchors. A task
   joins a shard's segments by ends that differ from one another and sorts the suffixes by external induced sorting
   (``induced``): windows whose common prefix with a neighbour has ``length`` bytes are repeats. Queues lie in
   files of the task's own folder, which goes with the task;
5. an anchor with more than ``HOT`` different segments (a common line in that many contexts) would fill its shard,
   so its segments' windows meet by a digest of each instead, counted before the shuffle: no cap, same result;
6. the repeats of each text are merged and cut out of it.

Defined cases: null counts as empty; texts shorter than ``length`` have no window and stay whole; texts that
stand in several rows (repeated rows too) lose all bytes if they are as long; an empty table gives no rows; only
key and text are read, so other columns clash with nothing; a null key is kept.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .induced import suffix_array

#: Bytes of a window, and of the strings of which the least one is its anchor.
LENGTH, GRAM = 200, 64
#: Bytes of segments that a shard is meant to hold; a task sorts so much at a time.
SHARD = 3 << 20
#: Different segments of one anchor that a shard still takes.
HOT = 2048

_SEGMENT = "anchor bigint, seg bigint, start int, windows int"
_SEGMENT_ARROW = pa.struct([("anchor", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """At each place the least of the ``width`` values from there on; places near the end see fewer."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step else out[:-step]
        size += step
    return out


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window in the row, windows, anchor, hash of the content) of the segments of some texts."""
    n = len(data)
    width = length - gram + 1
    size = np.diff(off)
    if not n or size.max() < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    up, down = S.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams[: n - gram + 1] = S.mix((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
    # A window lies in its row, and so do its grams: what crosses rows is never asked for.
    window = S.within_rows(off, length)
    least = _sliding_least(grams, width)[window]
    # An anchor is a place: behind it the same hash is another anchor, so that what a periodic text repeats in itself shows as two segments.
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1) | (grams[window[1:] - 1] == least[1:])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    begin, anchor = window[first], least[first]
    end = begin + count + length - 1
    content = S.mix((total[end] - total[begin]) * down[begin] + count.astype(np.uint64))
    row = np.searchsorted(off, begin, side="right") - 1
    return row, begin - off[row], count, anchor, content


def _listed(length: int, gram: int):
    """mapInArrow function: (name, text, copies) to the same with the text's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = S.flat(batch.column(1))
            for a, b, part, part_off in S.slices(data, off, 1 << 20):
                row, start, windows, anchor, content = segments(part, part_off, length, gram)
                found = pa.StructArray.from_arrays([pa.array(S.signed(anchor)), pa.array(S.signed(content)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], fields=list(_SEGMENT_ARROW))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), S.lists(found, np.bincount(row, minlength=b - a))], names=["name", "text", "copies", "segments"])

    return run


def _sides(data: np.ndarray, off: np.ndarray, windows: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> list[pa.Array]:
    """Hashes of each segment's anchor with the half of a window's other bytes before it, and with the half after it; null where the segment has not as many."""
    up, down = S.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashed = lambda s, e: S.mix((total[e] - total[s]) * down[s])
    place = off[:-1] + windows - 1  # the last window's first gram with the anchor's hash is the anchor
    going = np.arange(len(place))
    while len(going):
        going = going[hashed(place[going], place[going] + gram) != anchor[going]]
        place[going] += 1
    half = (length - gram + 1) // 2
    out = []
    for low, high in ((place - half, place + gram), (place, place + gram + half)):
        there = (low >= off[:-1]) & (high <= off[1:])
        h = np.zeros(len(place), np.uint64)
        h[there] = hashed(low[there], high[there])
        out.append(pa.array(S.signed(h), mask=~there))
    return out


def _cut_out(length: int, gram: int):
    """mapInArrow function: (text, wanted segments) to (anchor, seg, windows, left, right, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = S.flat(batch.column(0))
            raw, wanted = data.tobytes(), batch.column(1)
            flat = wanted.flatten()
            count = np.diff(np.asarray(wanted.offsets))
            start, windows = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("windows")).astype(np.int64)
            at = np.repeat(off[:-1], count) + start
            text = [raw[a:b] for a, b in zip(at.tolist(), (at + windows + length - 1).tolist())]
            part = np.frombuffer(b"".join(text), np.uint8)
            part_off = np.concatenate(([0], np.cumsum(windows + length - 1)))
            left, right = _sides(part, part_off, windows, np.asarray(flat.field("anchor")).view(np.uint64), length, gram)
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("seg"), flat.field("windows"), left, right, pa.array(text, pa.binary())], names=["anchor", "seg", "windows", "left", "right", "bytes"])

    return run


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def sorted_repeats(data: np.ndarray, off: np.ndarray, length: int, folder: str) -> np.ndarray:
    """For each byte of some segments: does a window begin there that begins elsewhere in them too?"""
    size, count = np.diff(off), len(off) - 1
    row = np.repeat(np.arange(count), size)
    text = np.empty(len(data) + count, np.int32)
    text[np.arange(len(data)) + row] = data.astype(np.int32) + count
    text[off[1:] + np.arange(count)] = np.append(np.arange(1, count), 0)  # ends of segments: all different, the last the least
    place, lcp = suffix_array(text, count + 256, folder)
    far = lcp >= length
    far |= np.append(far[1:], False)
    hit = np.zeros(len(text), bool)
    hit[place[far]] = True
    return hit[np.arange(len(data)) + row]


def _shard(length: int):
    """mapInArrow function over a whole partition: (anchor, seg, bytes) to (anchor, seg, lo, hi) of the windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows).combine_chunks()
            data, off = S.flat(table.column("bytes"))
            with tempfile.TemporaryDirectory(prefix="queues-") as folder:
                lo, hi = _stretches(sorted_repeats(data, off, length, folder))
            # Windows of two segments never touch: a segment's last length - 1 bytes begin none.
            of = np.searchsorted(off, lo, side="right") - 1
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks().take(at), table.column("seg").combine_chunks().take(at), pa.array((lo - off[of]).astype(np.int32)), pa.array((hi - off[of]).astype(np.int32))], names=["anchor", "seg", "lo", "hi"])

    return run


def _windows(length: int):
    """mapInArrow function: (anchor, seg, windows, bytes) to (anchor, seg, at, digest) of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.asarray(batch.column(2)).astype(np.int64)
            texts = batch.column(3).to_pylist()
            digest = [hashlib.blake2b(t[i : i + length], digest_size=16).digest() for t, m in zip(texts, count.tolist()) for i in range(m)]
            of = pa.array(np.repeat(np.arange(len(count)), count))
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(at.astype(np.int32)), pa.array(digest, pa.binary())], names=["anchor", "seg", "at", "digest"])

    return run


def _removed(length: int):
    """mapInArrow function: (name, text, copies, spans) to (name, n_bytes, n_removed, spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, copies, spans = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
            for text, many, found in zip(texts, copies, spans):
                raw, merged = (text or "").encode(), []
                if many > 1 and len(raw) >= length:
                    found = [{"lo": 0, "hi": len(raw)}]
                for s in sorted(found or (), key=lambda x: x["lo"]):
                    if merged and s["lo"] <= merged[-1]["hi"]:
                        merged[-1]["hi"] = max(merged[-1]["hi"], s["hi"])
                    else:
                        merged.append({"lo": s["lo"], "hi": s["hi"]})
                kept, upto = [], 0
                for s in merged:
                    kept.append(raw[upto : s["lo"]])
                    upto = s["hi"]
                kept.append(raw[upto:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(s["hi"] - s["lo"] for s in merged))
                out["spans"].append(merged)
                out["kept"].append(b"".join(kept))
            span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([names, pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())], names=["name", *out])

    return run


def _name(text) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def _bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """The rows as a written table whose files are dealt by ``by``: joins on it move only the other side."""
    spark, path = df.sparkSession, S.scratch_path(df.sparkSession, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._scratch_path, out._scratch_table = path, table
    S._made.append(path)
    return out


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, used: list[DataFrame] | None = None) -> DataFrame:
    """(name, n_bytes, n_removed, spans (lo, hi), kept) of each distinct text; name is its md5. ``used`` gets the written tables that the result still reads."""
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=4)
    raw = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = raw.groupBy(_name(F.col("text")).alias("name")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = _bucketed(texts.mapInArrow(S.trimmed(_listed(length, gram)), f"name binary, text string, copies bigint, segments array<struct<{_SEGMENT}>>"), "name", "repeat-texts")
    S.discard(spark)
    listed = texts.select("name", F.inline("segments"))
    # Written, so that the join below has nothing but shuffles under it and Spark can split a hot anchor.
    shared = S.settled(listed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-shared")
    listed = S.settled(listed.join(shared, "anchor", "left_semi"), "repeat-segments")
    distinct = S.settled(listed.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("name", "start", "windows")).alias("r")), "repeat-distinct")
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unlike = distinct.join(kinds, "anchor").select(F.col("r.name").alias("name"), F.struct("anchor", "seg", F.col("r.start").alias("start"), F.col("r.windows").alias("windows")).alias("s"))
    wanted = unlike.groupBy("name").agg(F.collect_list("s").alias("wanted"))
    pieces = texts.select("name", "text").join(wanted, "name").select("text", "wanted")
    pieces = S.settled(pieces.mapInArrow(S.trimmed(_cut_out(length, gram)), "anchor bigint, seg bigint, windows int, left bigint, right bigint, bytes binary"), "repeat-pieces")
    side = pieces.select("anchor", "seg", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("left").alias("h")), F.struct(F.lit(1).alias("of"), F.col("right").alias("h")))).alias("s")).where("s.h is not null")
    met = side.groupBy("anchor", "s").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "s")
    cut = pieces
    pieces = S.settled(pieces.select("anchor", "seg", "windows", "bytes").join(side.join(met, ["anchor", "s"], "left_semi").select("anchor", "seg").distinct(), ["anchor", "seg"], "left_semi"), "repeat-met")
    of_hot = pieces.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    volume = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = pieces.join(of_hot, "anchor", "left_anti").repartition(max(1, -(-volume // SHARD)), "anchor")
    found = shards.select("anchor", "seg", "bytes").mapInArrow(S.trimmed(_shard(length)), "anchor bigint, seg bigint, lo int, hi int")
    windows = S.settled(pieces.join(of_hot, "anchor", "left_semi").mapInArrow(S.trimmed(_windows(length)), "anchor bigint, seg bigint, at int, digest binary"), "repeat-windows")
    again = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    found = found.unionByName(windows.join(again, "digest", "left_semi").select("anchor", "seg", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
    # Segments that stand once: their own windows that repeat. Segments that stand more often: all of them, wherever they stand.
    once = found.join(distinct.where("n = 1").select("anchor", "seg", "r"), ["anchor", "seg"]).select("r.name", (F.col("r.start") + F.col("lo")).alias("lo"), (F.col("r.start") + F.col("hi") - 1 + length).alias("hi"))
    often = listed.join(distinct.where("n > 1").select("anchor", "seg"), ["anchor", "seg"], "left_semi").select("name", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1 + length).alias("hi"))
    spans = S.settled(once.unionByName(often).groupBy("name").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeat-spans")
    S.discard(spark, shared, listed, distinct, cut, pieces, windows)
    if used is not None:
        used += [texts, spans]
    both = texts.select("name", "text", "copies").join(spans, "name", "left")
    return both.mapInArrow(S.trimmed(_removed(length)), "name binary, n_bytes bigint, n_removed bigint, spans array<struct<lo int, hi int>>, kept binary")


def deduplicated(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) of each row. gram: bytes of an anchor, fewer than length."""
    named = docs.select(F.col(key).alias("key"), _name(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("name"))
    return named.join(repeated_spans(docs, text, length, gram, hot), "name").drop("name")


def op11(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that begin anywhere else too; null counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used: list[DataFrame] = []
    found = repeated_spans(docs, "text", used=used).select("name", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _name(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("name"))
    found = S.settled(found, "repeat-found")
    S.discard(spark, *used)
    spark.sql(f"DROP TABLE {used[0]._scratch_table}")
    return named.join(found, "name").drop("name")


#: Windows as 400 hexadecimal digits, cut out of stretches of 500 windows; runs of covered bytes; what stays between them.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, s, substr(x, 1000 * s + 1, 1398) AS part FROM d, LATERAL (SELECT unnest(range(0, (length(x) // 2 + 300) // 500)) AS s)),
w AS (SELECT r, 500 * s + o AS i, md5(substr(part, 2 * o + 1, 400)) AS h FROM c, LATERAL (SELECT unnest(range(0, greatest(0, length(part) // 2 - 199))) AS o)),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit),
k AS (SELECT r, i, count(*) FILTER (WHERE p IS NULL OR i > p + 200) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
span AS (SELECT r, run, min(i) AS lo, max(i) + 200 AS hi FROM k GROUP BY r, run),
cut AS (SELECT r, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM span GROUP BY r),
j AS (SELECT doc_id, x, length(x) // 2 AS n, coalesce(los, []) AS los, coalesce(his, []) AS his FROM d LEFT JOIN cut USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(his), 0) - coalesce(list_sum(los), 0) AS BIGINT) AS n_removed, CAST(len(los) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(los) + 1), lambda s: substr(x, 2 * (CASE WHEN s = 0 THEN 0 ELSE his[s] END) + 1, 2 * ((CASE WHEN s = len(los) THEN n ELSE los[s + 1] END) - (CASE WHEN s = 0 THEN 0 ELSE his[s] END)))), ''))) AS kept_sha256 FROM j
"""

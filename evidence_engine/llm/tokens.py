"""Token-ID output: documents as Parquet lists of token ids, and selective reads of them.

Texts are dealt into ranges of ascending ids, encoded, ended by the end id, and written by Spark's Parquet
writer: token ids dictionary-encoded (a vocabulary fits in one dictionary), numbers delta-encoded, row groups
and pages of set size, page indexes for all columns. Files and the rows in them ascend by doc_id, so a read
of some ids skips other files, row groups and pages, and a read of ``n_tokens`` never touches token pages.

Encoding: the tokenizer splits a text by a pattern none of whose matches crosses from non-space to space,
other than by one leading U+0020. So a text is cut there into pieces, each distinct piece is encoded once by
the tokenizers library, and the ids are joined. Texts where that would not be the same (the end token's
string, U+001C to U+001F) are encoded whole.

Defined cases: null text counts as empty and gives the end id alone; null ids come first; rows of equal id
stand by the hash of their texts; an empty table gives an empty file set that reads back as no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared as S

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that a worker remembers at most (about 200 bytes each; beyond that the older half goes), and characters of such a piece.
REMEMBERED, LONGEST = 1_000_000, 40
#: Bytes of text that are encoded together: arrays of a slice stay small beside the remembered pieces.
SLICE = 1 << 20

WRITER = {
    "compression": "zstd",
    "maxRecordsPerFile": 1_000_000,
    "parquet.writer.version": "v2",
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 256 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

#: Texts that are one piece: the end token's string, and spaces of which the tokenizer and this module may think differently.
WHOLE = re.compile("<\\|endoftext\\|>|[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[[0x2C, 0x2E]] = True


#: Bytes that begin what WHOLE finds: "<", U+001C to U+001F, and the first bytes of its code points beyond ASCII.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x3C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def suspects(data: np.ndarray, off: np.ndarray) -> list[int]:
    """Rows in which WHOLE may find something."""
    at = np.flatnonzero(_SUSPECT[data])
    first, second = data[at], data[np.minimum(at + 1, len(data) - 1)] if len(data) else data
    may = (first < 0x20) | ((first == 0x3C) & (second == 0x7C)) | ((first == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))
    return np.unique(np.searchsorted(off, at[may], side="right") - 1).tolist()


def piece_starts(data: np.ndarray, off: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin: a word with the one U+0020 before it, else a run of spaces but its last, and that one.

    A comma or full stop that ends a word after an ASCII letter is a piece of its own, as the tokenizer's pattern has it.
    """
    start, end, first = S.word_bounds(data, off, S.IS_TOKEN)
    flags = np.zeros(len(data) + 1, bool)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    flags[end] = True
    before = start > off[row]
    flags[start[before] - 1] = True
    flags[start[~before | (data[start - 1] != 0x20)]] = True
    flags[end[_POINT[data[end - 1]] & (end - start > 1) & _LETTER[data[np.maximum(end - 2, 0)]]] - 1] = True
    for i in np.flatnonzero(whole):
        flags[off[i] : off[i + 1]] = False
    flags[off[:-1]] = True
    return np.flatnonzero(flags[: len(data)])


class PieceEncoder(dict):
    """Token ids of texts; as a dict, those of the pieces met so far as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def __call__(self, data: np.ndarray, off: np.ndarray, whole: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row's closed by the end id, and the rows' counts."""
        if len(self) > REMEMBERED:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)
        start = piece_starts(data, off, whole)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(off, start, side="right") - 1
        _, at, place = np.unique(S.word_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        known = [self[raw[a:b]] for a, b in zip(start[at].tolist(), end[at].tolist())]
        size = np.array([len(x) for x in known], np.int64) // 4
        flat = np.frombuffer(b"".join(known), "<u4").astype(np.int32)
        source, size = (np.cumsum(size) - size)[place], size[place]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = flat[np.arange(total) + np.repeat(source - (upto - size), size)]
        counts = np.bincount(row, weights=size, minlength=len(off) - 1).astype(np.int64)
        out = np.full(total + len(counts), end_id, np.int32)
        out[np.arange(total) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


_encoders: dict[int, PieceEncoder] = {}


def encoder(model: str) -> PieceEncoder:
    """One encoder a worker process and model."""
    from tokenizers import Tokenizer

    key = hash(model)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(Tokenizer.from_str(model))
    return _encoders[key]


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's file as text; it is a few MB whatever the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, options: dict | None = None) -> None:
    """Writes (doc_id, n_tokens, tokens) in ascending doc_id order."""
    spark = docs.sparkSession
    S.arrow_batches(spark, mb=8)
    model = spark.sparkContext.broadcast(vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model.value)
        for batch in batches:
            text = batch.column(1)
            data, off = S.flat(text)
            whole = np.zeros(len(text), bool)
            for a, _, part, of in S.slices(data, off):
                for i in suspects(part, of):
                    whole[a + i] = WHOLE.search(text[a + i].as_py()) is not None
            for a, b, part, off in S.slices(data, off, SLICE):
                ids, counts = encode(part, off, whole[a:b], end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), S.lists(pa.array(ids), counts)], names=["doc_id", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged.mapInArrow(S.trimmed(run), "doc_id bigint, n_tokens bigint, tokens array<int>").write.options(**(WRITER | (options or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, tokens). Filters on doc_id and reads of single columns reach the files' indexes."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, tokens array<int>").parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        off = tokens.offsets.to_numpy().astype(np.int64)
        raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: running sums within each file after the files' totals."""
    S.arrow_batches(spark, rows=1000)
    stored = read_tokens(spark, path).select("doc_id", "tokens", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = S.settled(stored.mapInArrow(_digest, "doc_id bigint, file string, row bigint, n_tokens bigint, ids_crc32 bigint"), "token-rows")
    # One row a file: files are at most as many as write tasks and million rows.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"), F.min_by("doc_id", "row").alias("first"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("own")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def encoded(spark, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    path = S.scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return positions(spark, path)


def op5(spark, sf_dir: str) -> DataFrame:
    return encoded(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


stage = encoded

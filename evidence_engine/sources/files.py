"""Files in and out: CSV of unsure encoding, JSON lines, one-row JSON documents, Markdown tables, digests."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.contracts import ENCODINGS

JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
RECORD = "instruction string, input string, output string"


def encoding_of(spark: SparkSession, path: str, sample: int = 1 << 20) -> str:
    """The first encoding that decodes the head of the first file strictly; a character cut off at its end does not count."""
    head = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, sample)).first()
    if head is None:
        raise FileNotFoundError(path)
    raw = bytes(head[0])
    for name in ENCODINGS:
        for cut in range(4 if len(raw) == sample else 1):
            try:
                raw[: len(raw) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    raise ValueError(f"none of {', '.join(ENCODINGS)} decodes {path}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str | None = None) -> tuple[DataFrame, str]:
    """All columns as text unless a schema is given; (frame, encoding)."""
    encoding = encoding or encoding_of(spark, path)
    if JAVA[encoding] != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding=JAVA[encoding])
    return (reader.schema(schema) if schema else reader).csv(path), encoding


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def export_csv(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """One local file with a byte-order mark for spreadsheets; only for results of up to ``rows`` rows."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows: use write_csv")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON object of the schema has its text in ``malformed``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", malformed string", {"columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r")).select("r.*")


def append_log(df: DataFrame, path: str, time_col: str) -> None:
    """Append-only JSON lines, a folder a day."""
    df.withColumn("day", F.to_date(time_col)).write.mode("append").partitionBy("day").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row frame as an indented JSON document, put in place by a rename."""
    row = df.first()
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.tmp")
    part.write_text(json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    part.replace(target)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A Markdown table of the first rows; frames are ordered by their caller."""
    found = df.limit(rows).collect()
    if not found:
        return "| 데이터 없음 |\n| --- |"
    cell = lambda v: "" if v is None or v != v else str(v).replace("\n", " ").replace("|", "/")
    table = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in found)]
    return "\n".join(f"| {' | '.join(map(str, r))} |" for r in table)


def described(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size, sha256) of files, digested in the cluster."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def digest(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            h.update(part)
    return h.hexdigest()


def first_existing(candidates: list[str]) -> str:
    for c in candidates:
        if Path(c).exists():
            return c
    raise FileNotFoundError(", ".join(candidates))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)

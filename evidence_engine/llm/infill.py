"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, which change places.

A unit grammar says what a unit of text is by the pairs of neighbouring classes between which one unit ends
and the next begins. ``boundary`` writes such pairs as a zero-width regular expression (a look-behind and a
look-ahead a pair), so that Spark's ``split`` cuts there and every code point stays in a piece. Two hash
values of a row's key choose the two cuts, a third whether the text is changed at all, a fourth the form.

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is <S>suffix<P>prefix<M>middle.
A text that holds a marker stays plain. A marker begins with "<", which stands nowhere else in a marker, so no
marker can begin in one part and end in the next, and ``restored`` finds the parts by the first markers.

Defined cases: null and empty texts have no unit (``split`` would give one empty piece, so they are asked for
by themselves) and are plain; a null key hashes as an empty text; repeated rows get equal results; an empty
table gives no rows; no other column than key and text is read, so extra columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY = r"[\s\S]"
#: Unit grammars: pairs of (class of the last code point of a unit, class of the first of the next one).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "code_point": [(_ANY, _ANY)],
    "word": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],
    "word_or_space": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"), (r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],
    "line": [(r"\n", _ANY)],
    "paragraph": [(r"\n\n", r"[^\n]")],
    "sentence": [(r"[.!?。！？]\s", r"\S"), ("[。！？]", r"\S")],
}
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts as many stay plain, and of 100 changed ones as many take the form spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def boundary(grammar: str | list[tuple[str, str]]) -> str:
    """The zero-width expression that matches between the neighbouring classes of a grammar."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def units(text: Column, grammar: str | list[tuple[str, str]] = "code_point") -> Column:
    """The units of a text in order; joined without anything between them they are the text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(text, boundary(grammar), -1))


def draws(key: Column, salt: str = "1") -> Column:
    """Four unsigned 32-bit numbers from the sha256 of salt:key."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def transformed(docs: DataFrame, key: str, text: str, grammar: str | list[tuple[str, str]] = "code_point", salt: str = "1") -> DataFrame:
    """(key, n, form, prefix, middle, suffix, output, prefix_units, middle_units) of each row; the parts are null where plain."""
    raw = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), draws(F.col(key), salt).alias("h"))
    cut = raw.withColumn("unit", units(F.col("text"), grammar)).withColumn("n", F.size("unit").cast("bigint"))
    a, b = (F.get("h", F.lit(i)) % (F.col("n") + 1) for i in (0, 1))
    held = F.lit(False)
    for m in MARKERS:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | held | (F.get("h", F.lit(2)) % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    put = cut.withColumns({"form": form, "lo": F.least(a, b).cast("int"), "hi": F.greatest(a, b).cast("int")})
    part = lambda begin, count: F.when(F.col("form") != "plain", F.array_join(F.slice("unit", begin + 1, count), ""))
    parts = put.select(
        "key", "text", "n", "form", part(F.lit(0), F.col("lo")).alias("prefix"), part(F.col("lo"), F.col("hi") - F.col("lo")).alias("middle"),
        part(F.col("hi"), F.col("n").cast("int") - F.col("hi")).alias("suffix"), F.when(F.col("form") != "plain", F.col("lo").cast("bigint")).alias("prefix_units"),
        F.when(F.col("form") != "plain", (F.col("hi") - F.col("lo")).cast("bigint")).alias("middle_units"),
    )
    p, s, m = (F.lit(x) for x in MARKERS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return parts.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)).drop("text")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from, by its form and its markers alone."""
    after = lambda x, marker: F.substring_index(x, marker, -1)
    before = lambda x, marker: F.substring_index(x, marker, 1)
    p, s, m = MARKERS
    from_psm = F.concat(after(before(output, s), p), after(output, m), after(before(output, m), s))
    from_spm = F.concat(after(before(output, m), p), after(output, m), after(before(output, p), s))
    return F.when(form == "plain", output).when(form == "psm", from_psm).otherwise(from_spm)


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents in code points; digests of the outputs and of the texts rebuilt from them. Null text counts as empty, extra columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return transformed(docs, "doc_id", "text").select(
        F.col("key").cast("bigint").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

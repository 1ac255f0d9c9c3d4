"""Exact top-k retrieval from an impact-ordered index, with documents that cannot win left unread.

A document scores one for each token that it shares with a question, and a boost's weight where the question
contains the document's value of the boost's column. The index is two written tables:

* ``forward``: a row a document with its tokens, their number and its boost values;
* ``blocks``: a token's postings in blocks of documents of like size, largest first. A document of n tokens
  cannot share more than n, so ``top``, the size of a block's largest document, bounds what any of the block
  can score; ``first`` is its smallest id.

A search scores the largest documents, those of the smallest ids and those of the rarest tokens first; the k-th
best of them is a question's threshold. By MaxScore, a document above it must have one of the question's rarest tokens, as many as the bound
of all the others and the boosts together leave short of the threshold. Only their blocks are read, of those
only the ones whose bound reaches the threshold, and documents are scored in full only if the rare tokens that
they have make up for what may be missing. Frequent tokens are never looked up. Boosts are bounds in all this;
documents that can win by boosts alone are the k smallest ids of each combination of boost values.

Defined cases: null and empty contents have no tokens and take no part, except for filling up; ties go to the
smaller id; rows of one id count as documents of their own, of which the best counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import tokens
from ..sources.scratch import Scratch
from .dictionary import contained

#: Postings of a block, and documents of either kind that are scored first for a search of k.
BLOCK = 1024
HEADS = 16
#: Rarest tokens of a question whose documents raise its threshold.
PROBE = 3


@dataclass
class Index:
    forward: DataFrame
    boosts: dict[str, float]
    scratch: Scratch

    @property
    def most(self) -> float:
        return float(sum(self.boosts.values()))


def build(docs: DataFrame, doc: str, content: str, boosts: dict[str, float] | None = None, scratch: Scratch | None = None) -> Index:
    """The forward table: one pass over the texts. A table of fewer pieces than there are cores is dealt out first."""
    scratch = scratch or Scratch(docs.sparkSession, "impact")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    held = docs.select(F.col(doc).alias("doc"), tokens(F.col(content)).alias("tokens"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"boost_{i}") for i, c in enumerate(boosts or {})))
    held = held.withColumn("size", F.coalesce(F.size("tokens"), F.lit(0))).where("size > 0")
    return Index(scratch.settled(held), dict(boosts or {}), scratch)


def blocks(index: Index, wanted: DataFrame) -> DataFrame:
    """(token, df, top, first, docs of (doc, size)): the postings of the wanted (token, df), in blocks of at most about BLOCK."""
    entry = index.forward.select("doc", "size", F.explode("tokens").alias("token")).join(wanted, "token")
    level = F.floor(F.log2(F.col("size").cast("double")) * 2).cast("int")  # sizes of a block differ by less than the root of two
    part = F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), F.ceil(F.col("df") / BLOCK)).cast("bigint"))
    grouped = entry.groupBy("token", level.alias("level"), part.alias("part")).agg(F.max("df").alias("df"), F.max("size").alias("top"), F.min("doc").alias("first"), F.collect_list(F.struct("doc", "size")).alias("docs"))
    return index.scratch.settled(grouped.drop("level", "part"))


def _boosted(index: Index) -> Column:
    """What boosts add to a pair, from the question's text and the document's values."""
    out = F.lit(0.0)
    for i, weight in enumerate(index.boosts.values()):
        value = F.col(f"boost_{i}")
        out = out + F.when((value != "") & F.col("asked").contains(value), weight).otherwise(0.0)
    return out


def _values(index: Index) -> list[str]:
    return [f"boost_{i}" for i in range(len(index.boosts))]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of each question; Spark cuts the groups before they are shuffled."""
    one = pairs.groupBy("qid", "doc").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def _by_tokens(questions: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """(qid, doc, score) of the questions and some documents that share a token."""
    entry = docs.select("doc", F.monotonically_increasing_id().alias("row"), "tokens", *_values(index)).select("doc", "row", F.explode("tokens").alias("token"), *_values(index))
    asked = questions.select("qid", F.explode("terms").alias("token"))
    shared = asked.join(entry, "token").groupBy("qid", "row").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), *(F.first(v).alias(v) for v in _values(index)))
    return shared.join(questions.select("qid", "asked"), "qid").select("qid", "doc", (F.col("n") + _boosted(index)).alias("score"))


def _scored(index: Index, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, doc, score) of pairs. The questions' few tokens go to the documents, so that the long lists move once and are cut to a number where they are met."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: little data, but each row is work
    wanted = pairs.join(asked.select("qid", "asked", "terms"), "qid").repartition(parts, "doc")
    return index.forward.join(wanted, "doc").select("qid", "doc", (F.size(F.array_intersect("tokens", "terms")) + _boosted(index)).alias("score"))


def _bounded(asked: DataFrame, best: DataFrame, k: int, most: float) -> DataFrame:
    """Adds each question's threshold (least, last_doc) and how many of its rarest tokens lead to any document above it, and to an equal one of a smaller id."""
    m = F.size("terms")
    last = best.groupBy("qid").agg(F.max_by(F.struct("score", "doc"), "rank").alias("last"), F.count("*").alias("found"))
    held = asked.join(last, "qid", "left").withColumns({"least": F.when(F.col("found") >= k, F.col("last.score")).otherwise(0.0), "last_doc": F.when(F.col("found") >= k, F.col("last.doc"))})
    short = m + most - F.col("least")
    held = held.withColumns({"above": F.least(m, F.greatest(F.lit(0), F.ceil(short).cast("int"))), "level": F.least(m, F.greatest(F.lit(0), (F.floor(short) + 1).cast("int")))})
    return held.select("qid", "asked", "terms", "least", "last_doc", "above", "level")


def _essential(held: DataFrame) -> DataFrame:
    return held.select("qid", "least", "last_doc", "above", F.posexplode("terms").alias("place", "token"), "level").where("place < level")


def search(index: Index, questions: DataFrame, k: int, *, qid: str, question: str, heads: int | None = None, block_report: list | None = None) -> DataFrame:
    """(qid, rank, doc, score) of the k best documents with a score above zero, as a written table. ``block_report`` gets the number of pairs that were scored."""
    scratch, most = index.scratch, index.most
    asked = questions.select(F.col(qid).alias("qid"), F.coalesce(F.col(question).cast("string"), F.lit("")).alias("asked"), F.coalesce(tokens(F.col(question)), F.array().cast("array<string>")).alias("terms")).where(F.size("terms") > 0)
    vocabulary = asked.select(F.explode("terms").alias("token")).distinct()
    frequency = scratch.settled(index.forward.select(F.explode("tokens").alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df")))
    # Tokens that some document has, the rarest first.
    known = asked.select("qid", F.explode("terms").alias("token")).join(frequency, "token")
    known = known.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
    asked = scratch.settled(asked.join(known, "qid", "left").withColumn("terms", F.coalesce(F.col("known.token"), F.array().cast("array<string>"))).drop("known"))
    n = heads or HEADS * k
    # Chosen by numbers alone, so that no task gathers the largest documents of all others; 2 n ids at most.
    narrow = index.forward.select("doc", "size")
    ids = narrow.orderBy(F.desc("size"), "doc").limit(n).unionByName(narrow.orderBy("doc").limit(n)).select("doc").distinct()
    head = scratch.settled(index.forward.join(F.broadcast(ids), "doc", "left_semi"))
    first = scratch.settled(_best(_by_tokens(asked, head, index), k))
    held = scratch.settled(_bounded(asked, first, k, most))
    posting = blocks(index, frequency.join(_essential(held).select("token").distinct(), "token", "left_semi"))
    # The documents of a question's rarest tokens are the likeliest to be better: they raise the threshold before the rest is looked up.
    probe = _essential(held).where((F.col("place") < PROBE) & (F.col("place") < F.col("above"))).join(posting.where(F.col("df") <= BLOCK), "token").select("qid", F.inline("docs")).select("qid", "doc").distinct()
    second = _scored(index, probe, asked)
    best = scratch.settled(_best(first.select("qid", "doc", "score").unionByName(second), k))
    held = scratch.settled(_bounded(asked, best, k, most))
    # Tokens below ``above`` lead to any better document; the ones up to ``level`` also to equal ones of smaller ids.
    least = F.col("least")
    leads = lambda doc: (F.col("place") < F.col("above")) | (F.col(doc) < F.col("last_doc"))
    open_block = _essential(held).join(posting, "token").where((F.col("top") + most >= least) & leads("first"))
    pair = open_block.select("qid", "least", "place", "above", "last_doc", F.inline("docs")).where((F.col("size") + most >= least) & leads("doc"))
    seen = pair.groupBy("qid", "doc").agg(F.count("*").alias("n"))
    # What a document may have besides the rare tokens that were counted: the frequent ones and the boosts.
    may = scratch.settled(seen.join(held.select("qid", "least", F.size("terms").alias("m"), "level"), "qid").where(F.col("n") + F.col("m") - F.col("level") + most >= least).select("qid", "doc"))
    if block_report is not None:
        block_report.append(may.count() + probe.count() + first.count())
    found = scratch.settled(_best(best.select("qid", "doc", "score").unionByName(_scored(index, may, asked)), k))
    if index.boosts:
        found = scratch.settled(_best(found.select("qid", "doc", "score").unionByName(_by_boosts(index, held, found, k)), k))
    return found.select("qid", "rank", "doc", "score")


def _by_boosts(index: Index, held: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score) of documents that may be among the k best by boosts alone, for the questions whose k-th best scores no more."""
    kth = found.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    short = held.select("qid", "asked", "terms").join(kth, "qid", "left").where(F.coalesce((F.col("n") < k) | (F.col("least") <= index.most), F.lit(True))).select("qid", "asked", "terms")
    values = _values(index)
    small = index.forward.withColumn("n", F.row_number().over(Window.partitionBy(*values).orderBy("doc"))).where(F.col("n") <= k)
    entries = small.select(F.inline(F.array(*(F.struct(F.lit(v).alias("kind"), F.col(v).alias("entry")) for v in values))))
    hit = contained(short, entries, "qid", "asked")
    parts = None
    for v in values:
        own = hit.where(F.col("kind") == v).select(F.col("key").alias("qid"), F.col("entry").alias(v)).join(small, v).select("qid", "doc", "tokens", *values)
        parts = own if parts is None else parts.unionByName(own)
    return parts.join(short, "qid").select("qid", "doc", (F.size(F.array_intersect("tokens", "terms")) + _boosted(index)).alias("score"))

"""Dictionary entries contained in texts: one automaton a shard of the dictionary, one pass over each text.

Entries of any number of dictionaries (kinds) are dealt into shards by hash; texts are dealt into splits. A task
has one shard and one split: it builds the shard's Aho-Corasick automaton, whose output links give every entry
that ends at a place, and runs its texts through it. So no text meets an entry that it does not contain, no
side is sent whole to all tasks, and nothing is counted while the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the dictionaries, and of the texts; each pair of parts is a task.
SHARDS, SPLITS = 4, 8


def _matcher(longest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, automaton, ready = None, None, False
        for batch in batches:
            keys, kinds, found = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for shard, split, turn, key, kind, text in zip(*columns):
                if (shard, split) != at:
                    at, automaton, ready = (shard, split), ahocorasick.Automaton(), False
                if not turn:
                    held = automaton.get(text, None)
                    automaton.add_word(text, (text, (kind,) if held is None else (*held[1], kind)))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if not len(automaton):
                    continue
                best: dict = {}
                for _, (entry, of) in automaton.iter(text):
                    for k in of:
                        if not longest:
                            best[(k, entry)] = entry
                        elif k not in best or (-len(entry), entry) < (-len(best[k]), best[k]):
                            best[k] = entry
                for k, entry in best.items():
                    keys.append(key)
                    kinds.append(k if longest else k[0])
                    found.append(entry)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(3).type), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["key", "kind", "entry"])

    return run


def contained(texts: DataFrame, entries: DataFrame, key: str, text: str, *, longest: bool = False, shards: int = SHARDS, splits: int = SPLITS) -> DataFrame:
    """(key, kind, entry): every entry of each kind that a text contains, or of each shard the longest of each kind.

    entries: (kind, entry); null and empty ones are left out, and a null text contains nothing.
    """
    one = entries.select("kind", F.col("entry").cast("string").alias("entry")).where(F.length("entry") > 0).distinct()
    kind_of = dict(texts.dtypes)[key]
    none = lambda t: F.lit(None).cast(t)
    of_split = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    left = one.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), of_split.alias("split"), F.lit(0).alias("turn"), none(kind_of).alias("key"), "kind", F.col("entry").alias("text"))
    of_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = texts.where(F.col(text).isNotNull()).select(F.pmod(F.xxhash64(key, text), F.lit(splits)).cast("int").alias("split"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    right = asked.select(of_shard.alias("shard"), "split", F.lit(1).alias("turn"), "key", none("string").alias("kind"), "text")
    both = left.unionByName(right).repartition(shards * splits, "shard", "split").sortWithinPartitions("shard", "split", "turn")
    return both.mapInArrow(_matcher(longest), f"key {kind_of}, kind string, entry string")


def longest_entries(texts: DataFrame, entries: DataFrame, key: str, text: str, kinds: list[str], **parts: int) -> DataFrame:
    """(key, a column a kind): the longest entry of each kind that a text contains, ties to the first by text; texts without any drop out."""
    found = contained(texts, entries, key, text, longest=True, **parts)
    order = F.struct((-F.length("entry")).alias("n"), F.col("entry").alias("e"))
    return found.groupBy(F.col("key").alias(key)).agg(*(F.min(F.when(F.col("kind") == k, order))["e"].alias(k) for k in kinds))

"""How filters interact: what every order of a set of filters keeps, removes and repeats.

A document that fails the filters F survives a subset S of them if S and F share none. Its survival
in all 32 subsets of five filters is one 32-bit word, with bit S set where it survives S. Adding up
the words bit by bit gives the survivors of every subset, and all figures of all orders are
differences of those: what a step keeps is the survivors of the filters so far, and so on.

The words of a part and label are added with carry-save adders: three words become a sum and a carry
word of twice the weight with five logical operations, 32 counts at a time, and bits are only counted
in the few words left. A task sends 32 counts per part and label, whatever its number of documents.

Filters: A under 50 words; B fewer than 65 % distinct words; C more than 5 % of code points in A-Z;
D holds one of ``#$%&*|``; E equal to the text of a smaller doc_id anywhere in the table.

Equal texts are found by SHA-256 digest. The smallest id of each digest is an aggregate, combined
before its shuffle; digests of one document leave before they meet the documents, and a digest with
very many documents is dealt into slices for that join.

Nulls: a null text is empty, a null source is the part '' (which it shares with empty sources). A
null doc_id has no label, fails E for no other and is failed by none. Repeated ids are separate rows;
rows of one id with one text do not fail E through each other. A document with several label rows is
good or toxic if one of them says so. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from bistrolytics.functions.sizing import broadcast_if_fits, written

from .texts import per_document

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Words of one addition; a part's words wait until so many are there.
LANES = 2048
#: Parts and labels of which a task holds counts; beyond it they are sent on.
HELD = 20_000
#: Documents of one text in one slice of the join with first ids.
SLICE = 1_000_000

_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in b"#$%&*|")
_FOLLOWING = bytes(range(128, 192))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, _FOLLOWING))
    fails = int(len(words) < 50)
    fails |= (100 * len(set(words)) < 65 * len(words)) << 1
    fails |= (100 * len(text.translate(None, _NOT_UPPER)) > 5 * points) << 2
    return fails | bool(text.translate(None, _NOT_SYMBOLS)) << 3


#: The survival word of each set of failed filters.
SURVIVAL = np.asarray([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


class PositionalCounts:
    """Counts of each bit over many 32-bit words by carry-save addition."""

    def __init__(self):
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.levels: list[list[np.ndarray]] = []

    def add(self, words: np.ndarray) -> None:
        self.waiting.append(words)
        self.size += len(words)
        if self.size >= LANES:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // LANES * LANES
            for row in joined[:whole].reshape(-1, LANES):
                self._carry(row)
            self.waiting, self.size = [joined[whole:]], len(joined) - whole

    def _carry(self, row: np.ndarray) -> None:
        """A level holds up to two rows of its weight; a third makes one sum and a carry."""
        for k in range(len(self.levels) + 1):
            if k == len(self.levels):
                self.levels.append([])
            rows = self.levels[k]
            rows.append(row)
            if len(rows) < 3:
                return
            a, b, c = rows
            half = a ^ b
            self.levels[k] = [half ^ c]
            row = (a & b) | (half & c)

    def counts(self) -> np.ndarray:
        total = np.zeros(SUBSETS, np.int64)
        for weight, rows in [(0, self.waiting), *enumerate(self.levels)]:
            for row in rows:
                bits = np.unpackbits(np.ascontiguousarray(row, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                total += bits.sum(axis=0, dtype=np.int64) << weight
        return total


def _facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, fails, digest): a few bytes per document, from whole texts."""

    def make():
        def derive(texts):
            whole = [text or b"" for text in texts]
            return {"fails": [failures(t) for t in whole], "digest": [hashlib.sha256(t).digest() for t in whole]}

        return derive

    needed = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("text")
    )
    return written(per_document(needed, make, [("fails", IntegerType()), ("digest", BinaryType())], keep=("part",)), "filter-facts")


def _with_copies(facts: DataFrame) -> DataFrame:
    """Sets bit 4 (filter E) for texts that a smaller doc_id has."""
    several = written(
        facts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("doc_id").alias("n")).where("n > 1"),
        "repeated-texts",
    ).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    heavy = several.where("slices > 1").select(F.col("digest").alias("heavy"), "slices")
    first = several.select(
        F.col("digest").alias("d"), "first_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("s")
    )
    dealt = facts.join(broadcast_if_fits(heavy, heavy.count(), 48), F.col("digest") == F.col("heavy"), "left").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1))).cast("int")
    )
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return dealt.join(
        broadcast_if_fits(first, first.count(), 64), (F.col("digest") == F.col("d")) & (F.col("slice") == F.col("s")), "left"
    ).select("doc_id", "part", (F.col("fails") + F.when(copied, 16).otherwise(0)).alias("fails"))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic. Rows without id have no label and need not meet the labels."""
    said = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("l")).agg(
        F.coalesce(F.max(labels["quality"] == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(labels["toxic"] == 1), F.lit(False)).alias("toxic"),
    )
    said = written(said.where("good or toxic"), "filter-labels")
    named = rows.where("doc_id is not null").join(broadcast_if_fits(said, said.count(), 32), F.col("doc_id") == F.col("l"), "left")
    both = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    nameless = rows.where("doc_id is null").select("part", "fails", *[F.lit(False).alias(c) for c in ("good", "toxic")])
    return named.select("part", "fails", *both).unionByName(nameless)


def subset_survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, good, toxic, survivors): for each part and label, how many documents survive each subset of the filters.

    ``survivors`` has 32 counts; its place S counts the documents that pass every filter in S (A is
    bit 0). Place 0 counts all documents.
    """
    schema = StructType(
        [
            StructField("part", StringType()), StructField("good", BooleanType()), StructField("toxic", BooleanType()),
            StructField("survivors", ArrayType(LongType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def counted(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"part": p, "good": g, "toxic": t, "survivors": c.counts().tolist()} for (p, g, t), c in held.items()], arrow
        )

    def run(batches):
        held: dict[tuple, PositionalCounts] = {}
        for batch in batches:
            words = SURVIVAL[batch.column("fails").to_numpy()]
            parts = batch.column("part").dictionary_encode()
            labelled = 2 * batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
            labelled += batch.column("toxic").to_numpy(zero_copy_only=False)
            keys = 4 * parts.indices.to_numpy().astype(np.int64) + labelled
            order = np.argsort(keys, kind="stable")
            keys, words = keys[order], words[order]
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    key = int(keys[a])
                    name = (parts.dictionary[key // 4].as_py(), bool(key & 2), bool(key & 1))
                    held.setdefault(name, PositionalCounts()).add(words[a:b])
            if len(held) > HELD:
                yield counted(held)
                held = {}
        if held:
            yield counted(held)

    rows = _with_labels(_with_copies(_facts(docs, id_col, text_col, part_col)), labels)
    sent = rows.mapInArrow(run, schema)
    total = F.array(*[F.sum(F.col("survivors")[k]) for k in range(SUBSETS)]).alias("survivors")
    return sent.groupBy("part", "good", "toxic").agg(total)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order (all 120) and step (1 to 5); every column is a difference of survivor counts.

    kept, removed: documents after this step and taken by it; redundant: those that fail its filter and
    left earlier; unique_fails: those that fail no other filter; good_lost, toxic_lost: taken by it with
    that label; shapley: what its filter takes, summed over all orders.
    """
    found = subset_survivors(docs, labels, id_col, text_col, part_col)

    def survivors(chosen):
        return F.array(*[F.sum(F.when(chosen, F.col("survivors")[k]).otherwise(0)) for k in range(SUBSETS)])

    parts = found.groupBy("part").agg(
        survivors(F.lit(True)).alias("of_all"), survivors(F.col("good")).alias("of_good"), survivors(F.col("toxic")).alias("of_toxic")
    )
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    bits = "aggregate(sequence(1, {n}), 0, (m, i) -> m | shiftleft(1, ascii(substring(filter_order, i, 1)) - 65))"
    steps = (
        parts.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("now", F.expr(bits.format(n="step")))
        .withColumn("before", F.when(F.col("step") == 1, 0).otherwise(F.expr(bits.format(n="greatest(step - 1, 1)"))))
        .withColumn("own", F.col("now") - F.col("before"))
    )

    def of(kind, subset):
        return F.element_at(F.col(kind), subset + 1)

    everything = F.lit(SUBSETS - 1)
    removed = of("of_all", F.col("before")) - of("of_all", F.col("now"))
    rows = steps.select(
        "part", "filter_order", "step", "own",
        of("of_all", F.col("now")).alias("kept"),
        removed.alias("removed"),
        (of("of_all", F.lit(0)) - of("of_all", F.col("own")) - removed).alias("redundant"),
        (of("of_all", everything - F.col("own")) - of("of_all", everything)).alias("unique_fails"),
        (of("of_good", F.col("before")) - of("of_good", F.col("now"))).alias("good_lost"),
        (of("of_toxic", F.col("before")) - of("of_toxic", F.col("now"))).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "own")  # 120 rows, one per order
    return rows.withColumn("shapley", F.sum("removed").over(own)).drop("own")

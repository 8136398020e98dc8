import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) pairs, with columns whose names clash with inner ones."""

    def make(pairs, partitions=3):
        rows = [(i, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
        clash = {"doc": "x", "tokens": "x", "at": "x", "n": "x", "c0": "x", "m0": "x", "words": "x", "spans": "x", "_text": "x", "kept": "x"}
        for name, value in clash.items():
            df = df.withColumn(name, __import__("pyspark").sql.functions.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, hot lines, white space of all kinds and a long one."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["über", "naïve", "Ünï", "don't", "x"]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage, line = prose(60), prose(12)
    pairs = []
    base = prose(150)
    for k in range(25):
        mutated = base.split(" ")
        for _ in range(r.choice([0, 1, 2, 6, 20])):
            mutated[r.randrange(len(mutated))] = r.choice(words)
        pairs.append(" ".join(mutated))
    for k in range(30):
        pairs.append(prose(r.choice([5, 30, 80])) + ("\n" + line if k % 2 else "") + ("\t" + passage + " " if k % 3 == 0 else "") + prose(20))
    pairs += [base] * 6 + [passage, passage, "x " * 90, "x", "", None, "  \n\t", " a\x1cb \x0bc", prose(6000), prose(3), prose(19), prose(20), "a b c d", "A B C D"]
    pairs += [pairs[30].upper(), line + "\n" + line + "\n" + line]
    return [(k * 3 % 101, t) for k, t in enumerate(pairs)]

"""Quality rules: plain counts of each text, and compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. Its ratio (compressed bytes to
bytes) must lie in a band: below it the text repeats itself, above it the text is like noise. A text
passes if the whole lies in its band and no more than ``bad_share`` of its chunks lie outside theirs.

Short texts compress less, and characters of several bytes differently. So bands go by class: length
in steps of the square root of 2, and whether a quarter of the bytes continue a character. Limits are
taken from the table itself, from all documents that pass the base rules, as wholes and in chunks: the
lower quartile less ``below`` and the upper quartile plus ``above`` times the distance of the two
(``least_gap`` at least). Quartiles come from counts per class and thousandth of the ratio, so they
are exact on that grid and do not depend on the order of rows. Quartiles stay put while less than a
quarter of a class lies off on one side. Classes of fewer than ``least_pieces`` use fixed ``limits``
close to prose.

Compression does not tell everything: words of random letters in up to about 1 KB have ratios that
prose of such length has as well, as do a few words in any order in less than 200 bytes.

Nulls: a null text has no words, fails the base rules and passes no band; a null id stays. Repeated
rows are judged one by one. An empty table gives no rows. Other columns are ignored. Counts are left
in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType

from bistrolytics.functions.sizing import written

from .texts import Words, per_document, places, plain_words, windows

SYMBOLS = b"#*$%&|<>"


#: Classes of length: k holds texts of up to SHORTEST * 2 ** (k / 2) bytes, the last all longer ones.
SHORTEST, N_CLASSES = 64, 29
GRID = 1000


@dataclass(frozen=True)
class Bands:
    """Margins around the quartiles, and fixed limits (bytes up to, lowest, highest ratio), ascending."""

    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 2.0),
        (128, 0.50, 1.02),
        (256, 0.52, 0.94),
        (512, 0.40, 0.80),
        (1024, 0.36, 0.72),
        (2048, 0.33, 0.595),
        (4096, 0.30, 0.57),
        (16384, 0.27, 0.55),
        (float("inf"), 0.22, 0.54),
    )
    wide_above: float = 0.05
    chunk: int = 2048
    bad_share: float = 0.5
    level: int = 3
    below: float = 2.0
    above: float = 2.5
    least_gap: float = 0.012
    least_pieces: int = 100

    def fixed(self, key: int) -> tuple[float, float]:
        """The fixed limits of a class."""
        size = SHORTEST * 2 ** (key // 2 / 2) if key // 2 < N_CLASSES - 1 else float("inf")
        low, high = next((low, high) for most, low, high in self.limits if size <= most)
        return low, high + self.wide_above * (key % 2)

    def learned(self, counts: list[tuple[int, int, int]]) -> list[tuple[float, float]]:
        """Limits of every class from (class, ratio on the grid, pieces)."""
        by_class = defaultdict(list)
        for key, bin_, n in sorted(counts):
            by_class[key].append((bin_, n))
        out = []
        for key in range(2 * N_CLASSES):
            bins, sizes = np.asarray(by_class.get(key, [(0, 0)])).T
            total = np.cumsum(sizes)
            if key < 2 or total[-1] < self.least_pieces:
                out.append(self.fixed(key))
                continue
            first, third = (bins[np.searchsorted(total, share * total[-1])] / GRID for share in (0.25, 0.75))
            gap = max(third - first, self.least_gap)
            out.append((float(first - self.below * gap), float(third + self.above * gap)))
        return out


def _class(size: Column, wide: Column) -> Column:
    step = F.ceil(2 * F.log2(F.greatest(size, F.lit(1)) / SHORTEST))
    return (2 * F.least(F.greatest(step, F.lit(0)), F.lit(N_CLASSES - 1)) + wide.cast("int")).cast("int")


def repeated_words(hashes: np.ndarray, length: int = 8) -> int:
    """Words that lie in a window of ``length`` words found twice or more in the text."""
    found = windows(hashes, length)
    if len(found) < 2:
        return 0
    order = np.argsort(found)
    same = found[order][1:] == found[order][:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    turn = np.zeros(len(hashes) + 1, np.int64)
    turn[: len(found)] += twice
    turn[length:] -= twice
    return int((np.cumsum(turn[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _counted(docs: DataFrame, bands: Bands, id_col: str, text_col: str) -> DataFrame:
    """Base counts of every document, and the compressed sizes of the whole and of its chunks."""

    def make():
        words, packer = Words(), zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        most = bands.chunk

        def derive(texts):
            split = [plain_words(text) for text in texts]
            edges = places([len(w) for w in split])
            hashes = words.of([w for doc in split for w in doc])
            out = {name: [] for name, _ in _COUNTS}
            for k, (text, doc) in enumerate(zip(texts, split)):
                text = text or b""
                solid = b"".join(doc)
                repeats = repeated_words(hashes[edges[k] : edges[k + 1]])
                failed = len(doc) < 20 or 100 * repeats > 30 * len(doc)
                packed = len(packer.compress(text)) if text else 0
                chunks = [len(packer.compress(text[a : a + most])) for a in range(0, len(text), most)] if len(text) > most else [packed] * bool(text)
                for name, value in zip(
                    out,
                    (
                        len(doc), len(solid) - _continuations(solid), len(text) - len(text.translate(None, SYMBOLS)),
                        duplicate_lines(text), repeats, failed, len(text), packed, chunks, 4 * _continuations(text) >= max(1, len(text)),
                    ),
                ):
                    out[name].append(value)
            return out

        return derive

    return per_document(docs, make, _COUNTS, id_col, text_col)


def score(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, whole_ratio, bad_chunks, n_chunks and kept of every document."""
    counted = written(_counted(docs, bands, id_col, text_col), "ratios")
    last = F.size("_chunks") - 1
    chunks = F.transform(
        "_chunks",
        lambda packed, k: F.struct(
            packed.alias("packed"), F.when(k < last, F.lit(bands.chunk)).otherwise(F.col("_bytes") - last * bands.chunk).cast("long").alias("size")
        ),
    )
    whole = F.struct(F.col("_packed").cast("int").alias("packed"), F.col("_bytes").alias("size"))
    # the chunk of a short text is the text
    pieces = counted.where("not base_failed").select(
        "_wide", F.explode(F.when(last > 0, F.concat(F.array(whole), chunks)).otherwise(F.array(whole))).alias("p")
    )
    # rows per class and thousandth are few at any size
    counts = pieces.groupBy(
        _class(F.col("p.size"), F.col("_wide")).alias("key"), F.floor(GRID * F.col("p.packed") / F.col("p.size")).alias("bin")
    ).count()
    limits = bands.learned([tuple(r) for r in counts.collect()])
    lows, highs = (F.array(*[F.lit(x[side]) for x in limits]) for side in (0, 1))

    def holds(piece):
        key = _class(piece["size"], F.col("_wide")) + 1
        return (piece["packed"] >= F.element_at(lows, key) * piece["size"]) & (piece["packed"] <= F.element_at(highs, key) * piece["size"])

    bad = F.size(F.filter(chunks, lambda c: ~holds(c))).cast("long")
    good = (F.col("_bytes") > 0) & holds(whole) & (F.col("bad_chunks") <= bands.bad_share * F.col("n_chunks"))
    return (
        counted.withColumn("whole_ratio", F.when(F.col("_bytes") > 0, F.col("_packed") / F.col("_bytes")).otherwise(0.0))
        .withColumn("bad_chunks", bad)
        .withColumn("n_chunks", F.size("_chunks").cast("long"))
        .withColumn("kept", ~F.col("base_failed") & good)
        .select(counted.columns[0], *[name for name, _ in FIELDS])
    )


FIELDS = [
    ("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()),
    ("n_repeat_words", LongType()), ("base_failed", BooleanType()), ("kept", BooleanType()),
    ("whole_ratio", DoubleType()), ("bad_chunks", LongType()), ("n_chunks", LongType()),
]
_COUNTS = FIELDS[:6] + [
    ("_bytes", LongType()), ("_packed", LongType()), ("_chunks", ArrayType(IntegerType(), False)), ("_wide", BooleanType()),
]

_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(data: bytes) -> int:
    """Bytes of UTF-8 that begin no character."""
    return len(data) - len(data.translate(None, _CONTINUATION))

"""Quality classifier by co-training.

Two logistic models look at a document from different sides: its text (shape of words, lines and
characters, compressibility) and its metadata (source, language, stated length). Over a few rounds
each is fitted on labelled rows and on all unlabelled documents for which the *other* model is
confident. Both are then calibrated on labelled rows that neither was fitted on, combined by a third
logistic model on the calibrated views, and applied to every document.

Features of all documents are worked out once and written. Labelled rows used for fitting are bounded
by ``max_labelled`` (those with the smallest hash of their id) and lie on the driver. The unlabelled
ones, however many, stay where they are: each step of Newton's method is one pass over their features
in which every task adds up its part of the matrix and gradient of both models, and only these sums
(some thousand numbers) are added up and sent on. Features are scaled by the labelled rows. A document
is kept if its score reaches a limit that keeps ``keep_good`` of the good calibration rows, 0.5 at
most; scores are rounded to nine decimals, so equal ones fall on one side of it.

Nulls: a null label or id teaches nothing; a null text has score 0 and is not kept, as is a text
without words; null metadata is a value of its own. Several labels of one id all count. Where labels
of one of the two kinds are missing there is nothing to learn: all documents with words have score 1
and are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, StructField, StructType

from bistrolytics.functions.sizing import written

from .texts import per_document, plain_words, trimmed

_KINDS = (
    bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b"!", b"?.", b",;:", b"()[]{}'\"/\\=+-_@^~`", b"\n",
    bytes(range(128, 256)),
)
_META_CELLS = 48


def text_features(text: bytes | None, packer) -> list[float]:
    """Shape of a whole text; each entry is a share or a logarithm."""
    text = text or b""
    words = plain_words(text)
    n, m = max(1, len(text)), max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    solid = sum(map(len, words))
    shares = [(len(text) - len(text.translate(None, kind))) / n for kind in _KINDS]
    return shares + [
        np.log1p(len(words)), np.log1p(len(lines)), solid / m, len(set(words)) / m,
        1 - len(set(lines)) / max(1, len(lines)), max(map(len, words), default=0) ** 0.5,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m, sum(w.isalpha() for w in words) / m,
        len(packer.compress(text)) / n,
    ]


def meta_features(source, lang, n_chars) -> list[float]:
    """Source and language in hashed cells, stated length."""
    cells = [0.0] * _META_CELLS
    cells[zlib.crc32(f"s{source}".encode()) % (_META_CELLS - 8)] = 1.0
    cells[_META_CELLS - 8 + zlib.crc32(f"l{lang}".encode()) % 8] = 1.0
    return cells + [np.log1p(max(0, n_chars)) if n_chars is not None else 0.0, float(n_chars is None)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray) -> "Logistic":
        return cls(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matrix and gradient of a step of Newton's method, which add up over rows."""
        z = self.design(x)
        p = sigmoid(z @ self.weights)
        return (z * (p * (1 - p) + 1e-6)[:, None]).T @ z, z.T @ (y - p)

    def moved(self, matrix: np.ndarray, gradient: np.ndarray, ridge: float = 1.0) -> tuple["Logistic", float]:
        """The model after the step, and its largest change of a weight."""
        penalty = ridge * np.eye(len(gradient))
        penalty[-1, -1] = 1e-6
        move = np.linalg.solve(matrix + penalty, gradient - penalty @ self.weights)
        return Logistic(self.mean, self.scale, self.weights + move), float(np.abs(move).max())

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 25) -> "Logistic":
        model = cls.start(x)
        for _ in range(steps):
            model, move = model.moved(*model.sums(x, y))
            if move < 1e-6:
                break
        return model

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic
    limit: float

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale.logit(self.text.logit(text)[:, None])
        b = self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return sigmoid(a), sigmoid(b), np.round(sigmoid(self.both.logit(np.stack([a, b], 1))), 9)


@dataclass
class Teacher:
    """A view's model and its calibration: what it tells the other view about unlabelled rows."""

    model: Logistic
    scale: Logistic

    def told(self, x: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows it is sure of, their labels)."""
        p = sigmoid(self.scale.logit(self.model.logit(x)[:, None]))
        rows = np.flatnonzero((p >= sure) | (p <= 1 - sure))
        return rows, (p[rows] >= 0.5).astype(float)


#: Adds up the parts of both models' steps over the unlabelled rows: (text, meta, teachers of each) to sums.
PoolSums = Callable[[Logistic, Logistic, Teacher, Teacher, float], tuple]


def pool_sums(text: np.ndarray, meta: np.ndarray, a: Logistic, b: Logistic, by_meta: Teacher, by_text: Teacher, sure: float) -> tuple:
    """(matrix and gradient of the text model, the same of the metadata model) over some unlabelled rows."""
    rows, told = by_meta.told(meta, sure)
    first = a.sums(text[rows], told)
    rows, told = by_text.told(text, sure)
    return (*first, *b.sums(meta[rows], told))


def cotrain(
    text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: PoolSums,
    rounds: int = 3, sure: float = 0.97, keep_good: float = 0.998, steps: int = 8,
) -> CoTrained | None:
    """The models; every third labelled row is kept for calibration. None without two kinds of labels."""
    held = np.arange(len(label)) % 3 == 2
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        return None
    x, m, y = text[~held], meta[~held], label[~held]

    def calibrated(model: Logistic, source: np.ndarray) -> Teacher:
        return Teacher(model, Logistic.fit(model.logit(source[held])[:, None], label[held]))

    a, b = Logistic.fit(x, y), Logistic.fit(m, y)
    for _ in range(rounds):
        by_text, by_meta = calibrated(a, text), calibrated(b, meta)
        for _ in range(steps):
            found = pool(a, b, by_meta, by_text, sure)
            own = (*a.sums(x, y), *b.sums(m, y))
            (h, g, k, d) = (p + q for p, q in zip(own, found))
            (a, one), (b, two) = a.moved(h, g), b.moved(k, d)
            if max(one, two) < 1e-3:
                break
    by_text, by_meta = calibrated(a, text), calibrated(b, meta)
    views = np.stack([by_text.scale.logit(a.logit(text[held])[:, None]), by_meta.scale.logit(b.logit(meta[held])[:, None])], 1)
    both = Logistic.fit(views, label[held])
    good = np.sort(np.round(sigmoid(both.logit(views)), 9)[label[held] == 1])
    return CoTrained(a, b, by_text.scale, by_meta.scale, both, float(min(0.5, good[int((1 - keep_good) * len(good))])))


def _features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    def make():
        packer = zstandard.ZstdCompressor(level=1, write_content_size=False)
        return lambda texts: {"_shape": [text_features(t, packer) for t in texts]}

    plain = docs.select(
        docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[source_col].alias("_source"),
        docs[lang_col].alias("_lang"), docs[chars_col].cast("long").alias("_chars"),
    )
    return per_document(plain, make, [("_shape", ArrayType(DoubleType()))], "_id", "_text", ("_source", "_lang", "_chars"))


def _matrices(text: pa.Array, meta: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    return (
        text.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1),
        meta.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1),
    )


def _pool(rows: DataFrame) -> PoolSums:
    """Sums over rows(text, meta), one pass per call; a task sends its sums, which Spark adds up."""

    def sums(a: Logistic, b: Logistic, by_meta: Teacher, by_text: Teacher, sure: float) -> tuple:
        sizes = len(a.weights), len(b.weights)
        shapes = [(sizes[0], sizes[0]), (sizes[0],), (sizes[1], sizes[1]), (sizes[1],)]
        cells = sum(int(np.prod(s)) for s in shapes)

        def run(batches):
            total = np.zeros(cells)
            for batch in batches:
                if batch.num_rows:
                    found = pool_sums(*_matrices(batch.column(0), batch.column(1)), a, b, by_meta, by_text, sure)
                    total += np.concatenate([part.ravel() for part in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "part"])

        added = rows.mapInArrow(trimmed(run), "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part"))
        whole = np.zeros(cells)
        for row in added.collect():
            whole[row["cell"]] = row["part"]
        edges = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        return tuple(whole[p:q].reshape(s) for p, q, s in zip(edges, edges[1:], shapes))

    return sums


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", max_labelled: int = 15_000, **options,
) -> CoTrained | None:
    names = (id_col, text_col, source_col, lang_col, chars_col)
    inner = docs.select(*[docs[c].alias(f"_{k}") for k, c in enumerate(names)]).where("_0 is not null")

    def meta(batches):
        for batch in batches:
            cells = [meta_features(*row) for row in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(cells, pa.list_(pa.float32()))], names=["id", "text", "meta"]
            )

    shaped = _features(inner, "_0", "_1", "_2", "_3", "_4").select("_id", "_shape", "_source", "_lang", "_chars")
    schema = StructType([StructField("id", shaped.schema["_id"].dataType), *[StructField(c, ArrayType(FloatType())) for c in ("text", "meta")]])
    features = written(shaped.mapInArrow(trimmed(meta), schema), "quality-features")
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(
        labels[id_col].alias("_known"), (labels[label_col] > 0).cast("double").alias("_y")
    )
    known = written(known.join(features.select(F.col("id").alias("_known")).distinct(), "_known", "left_semi"), "quality-labels")
    taught = known.orderBy(F.xxhash64("_known"), "_known", "_y").limit(max_labelled)
    made = (
        features.join(F.broadcast(taught), features["id"] == F.col("_known"))  # its rows are bounded
        .select(F.col("id").cast("string").alias("id"), "_y", "text", "meta").toArrow()
    )
    if not made.num_rows:
        return None
    # the same order on every run: by a checksum of the id, then by all that is known of the row
    ids, y = made.column("id").to_pylist(), made.column("_y").to_numpy().astype(float)
    text, cells = _matrices(made.column("text").combine_chunks(), made.column("meta").combine_chunks())
    order = np.lexsort([*text.T, y, np.asarray(ids, dtype="U"), [zlib.crc32(i.encode()) for i in ids]])
    rest = features.join(known.select("_known").distinct(), features["id"] == F.col("_known"), "left_anti").select("text", "meta")
    return cotrain(text[order], cells[order], y[order], _pool(written(rest, "quality-pool")), **options)


def score(
    docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", chars_col: str = "n_chars", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., p_text, p_meta, score, kept) of every document."""
    inner = docs.select(
        docs[id_col], *[docs[c] for c in keep if c != id_col], docs[text_col].cast("string").alias("_text"),
        docs[source_col].cast("string").alias("_source"), docs[lang_col].cast("string").alias("_lang"),
        docs[chars_col].cast("long").alias("_chars"),
    )
    fields = [("p_text", DoubleType()), ("p_meta", DoubleType()), ("score", DoubleType()), ("kept", BooleanType())]

    def make():
        packer = zstandard.ZstdCompressor(level=1, write_content_size=False)

        def derive(texts, sources, langs, chars):
            empty = np.asarray([not (t and t.split()) for t in texts])
            if model is None:
                a = b = c = np.ones(len(texts))
                limit = 0.0
            else:
                shape = np.asarray([text_features(t, packer) for t in texts])
                meta = np.asarray([meta_features(*x) for x in zip(sources, langs, chars)])
                # as precise as the rows that the models were fitted on
                shape, meta = (x.astype(np.float32).astype(np.float64) for x in (shape, meta))
                (a, b, c), limit = model.views(shape, meta), model.limit
            c = np.where(empty, 0.0, c)
            return {"p_text": a, "p_meta": b, "score": c, "kept": (c >= limit) & ~empty}

        return derive

    return per_document(inner, make, fields, id_col, "_text", tuple(c for c in keep if c != id_col), extra=("_source", "_lang", "_chars"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", chars_col: str = "n_chars", **options,
) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    inner = [f"d{k}" for k in range(len(docs.columns))]
    named = dict(zip(docs.columns, inner))
    columns = [named[c] for c in (id_col, text_col, source_col, lang_col, chars_col)]
    plain, taught = docs.toDF(*inner), labels.withColumnRenamed(id_col, columns[0])
    model = train(plain, taught, *columns, **options)
    scored = score(plain, model, *columns, keep=tuple(c for c in inner if c != columns[0]))
    return scored.where("kept").select(*inner).toDF(*docs.columns)

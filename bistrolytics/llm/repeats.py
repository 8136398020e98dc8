"""Removal of repeated passages: every word in a window that also starts earlier in the corpus.

Level-wise doubling. The first level looks at windows of half the length. Not all of them: in each
full window the half-length window with the smallest hash is its *anchor*, so equal full windows
have equal anchors at the same place, and about one window in six is looked at. Only where an
anchor is repeated are its full windows formed and compared; nothing else survives to the second
level. Longer levels could only find windows whose words the full windows cover already, so the
doubling ends at the asked length.

Full windows that follow one another and share an anchor form one *stretch*. Equal stretches hold
equal windows, so all but the first are repeats as a whole. Only where an anchor has different
stretches (near the edges of a copied passage) do single windows have to be compared.

Shuffles: one row per stretch (a repeat inside one slice of a task is decided there and leaves no
row, which flattens hot passages), the single windows at edges, spans per document, and the text
twice. Groups are read as sorted streams, never gathered.

"Earlier" means a smaller id, or the same document and an earlier start. Rows that share an id but
not the text are ordered by a checksum of the text; equal rows are one document and get the same
result. Null ids come first. A null or empty text has no words. Texts shorter than the window lose
nothing. An empty table gives no rows. Other columns are kept by ``remove`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, LongType, StringType, StructField, StructType

from bistrolytics.functions.sizing import written

from .texts import Words, bounded_batches, cut, places, plain_words, trimmed, windows

_NO_ID = -(1 << 63)
#: A place is the checksum of the text above the word's number, which orders rows with one id.
_PLACE_BITS = 36
_STRETCH, _GONE = 0, 1
_ROWS = StructType(
    [
        StructField("kind", ByteType()), StructField("anchor", LongType()), StructField("body", LongType()),
        StructField("doc", LongType()), StructField("at", LongType()), StructField("n", LongType()),
    ]
)


def _tag(text: bytes) -> int:
    return (zlib.crc32(text) & 0x7FFFFFF) << _PLACE_BITS


def _tag_of(text: Column) -> Column:
    """The checksum part of ``_tag``."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFF)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("doc"), docs[text_col].cast("string").alias("_text")
    )


def _slice(batch: pa.RecordBatch, words: Words):
    """Slices of a batch with their texts, the hashes of all words, and where each text's words begin."""
    batch = batch.set_column(1, "_text", batch.column(1).cast(pa.binary()))
    for part in cut(batch, "_text"):
        texts = [t or b"" for t in part.column(1).to_pylist()]
        split = [plain_words(t) for t in texts]
        edges, hashes = places([len(w) for w in split]), words.of([w for doc in split for w in doc])
        del split  # the words themselves take several times the text
        yield part, texts, hashes, edges


def _whole(edges: np.ndarray, window: int, n: int) -> np.ndarray:
    """Places from which a window lies within its document."""
    ends = np.repeat(edges[1:], np.diff(edges))[:n]
    return np.arange(n) + window <= ends


def _leftmost_low(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value among ``width`` from each place on."""
    best, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        n = len(best) - step
        best = np.where(values[best[step:]] < values[best[:n]], best[step:], best[:n])
        done += step
    return best


def _rows(kind, anchor, body, doc, at, n) -> pa.RecordBatch:
    size = len(doc)
    data = [
        np.full(size, kind, np.int8), np.broadcast_to(anchor, size).astype(np.int64, copy=False),
        np.broadcast_to(body, size).astype(np.int64, copy=False), doc, at, n,
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=_ROWS.names)


def _first_of(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key, document and place; which of them are the first of their key."""
    order = np.lexsort([at, doc, *keys])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """First level: one row per stretch of windows with one anchor, or per stretch known as a repeat."""
    half = (window + 1) // 2

    def run(batches):
        words = Words()
        for batch in batches:
            for part, texts, hashes, edges in _slice(batch, words):
                full = windows(hashes, window)
                if not len(full):
                    continue
                anchors = windows(hashes, half)
                where = _leftmost_low(anchors, window - half + 1)[: len(full)]
                starts = np.flatnonzero(_whole(edges, window, len(full)))
                if not len(starts):
                    continue
                new = np.ones(len(starts), bool)
                new[1:] = (starts[1:] != starts[:-1] + 1) | (where[starts[1:]] != where[starts[:-1]])
                first = starts[new]
                last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
                count = last - first + 1
                # the first and the last window overlap, so they say all words of the stretch
                body = (full[first] * np.uint64(0x9E3779B97F4A7C15)) ^ full[last] ^ count.astype(np.uint64)
                owner = np.searchsorted(edges, first, "right") - 1
                doc = part.column(0).to_numpy()[owner]
                tags = np.asarray([_tag(t) for t in texts], np.int64)
                at = tags[owner] + first - edges[owner]
                anchor, body = anchors[where[first]].view(np.int64), body.view(np.int64)
                order, lead = _first_of([body, anchor], doc, at)
                # equal rows of the table are one document, not a repeat of it
                d, a = doc[order], at[order]
                head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
                gone = ~lead & ((d != d[head]) | (a != a[head]))
                keep, gone = order[lead], order[gone]
                yield _rows(_STRETCH, anchor[keep], body[keep], doc[keep], at[keep], count[keep])
                # dealt out by document: these rows only pass through
                yield _rows(_GONE, doc[gone], at[gone], doc[gone], at[gone], count[gone] + window - 1)

    return docs.mapInArrow(trimmed(run), _ROWS)


class _Group:
    """Carries the current anchor and the first row of the current body from batch to batch."""

    def __init__(self):
        self.anchor = self.body = self.doc = self.at = self.n = None
        self.mixed = False


def _repeats_in(sorted_rows: DataFrame, window: int) -> DataFrame:
    """Second level over rows sorted by anchor, body, document and place.

    A row whose body came before is gone. Where an anchor has several bodies, the first row of each
    is passed on as a stretch to be looked at window by window.
    """

    def run(batches):
        past = _Group()
        for batch in batches:
            kind, anchor, body, doc, at, n = (c.to_numpy() for c in batch.columns)
            done = kind == _GONE
            if done.any():
                yield batch.filter(pa.array(done))
                rest = ~done
                anchor, body, doc, at, n = (x[rest] for x in (anchor, body, doc, at, n))
            if not len(anchor):
                continue
            new_anchor, new_body = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_body[1:] = new_anchor[1:] | (body[1:] != body[:-1])
            if past.anchor is not None:
                new_anchor[0] = anchor[0] != past.anchor
                new_body[0] = new_anchor[0] or body[0] != past.body
            # first row of each body, which may lie in an earlier batch
            at_head = np.maximum.accumulate(np.where(new_body, np.arange(len(body)), -1))
            head_doc = np.where(at_head >= 0, doc[at_head], past.doc if past.doc is not None else 0)
            head_at = np.where(at_head >= 0, at[at_head], past.at if past.at is not None else 0)
            gone = ~new_body & ((doc != head_doc) | (at != head_at))
            if gone.any():
                yield _rows(_GONE, 0, 0, doc[gone], at[gone], n[gone] + window - 1)
            # anchors with more than one body
            group = np.cumsum(new_anchor)
            bodies = np.bincount(group, weights=new_body).astype(np.int64)
            if past.anchor is not None and not new_anchor[0]:
                bodies[0] += 2 if past.mixed else 1
            mixed = bodies[group] > 1
            if past.anchor is not None and not new_anchor[0] and not past.mixed and bodies[0] > 1:
                yield _rows(_STRETCH, past.anchor, past.body, *(np.asarray([x], np.int64) for x in (past.doc, past.at, past.n)))
            out = mixed & new_body
            if out.any():
                yield _rows(_STRETCH, anchor[out], body[out], doc[out], at[out], n[out])
            past.mixed = bool(mixed[-1])
            past.anchor, past.body = anchor[-1], body[-1]
            if at_head[-1] >= 0:
                past.doc, past.at, past.n = doc[at_head[-1]], at[at_head[-1]], n[at_head[-1]]

    return sorted_rows.mapInArrow(trimmed(run), _ROWS)


def _single_windows(docs: DataFrame, stretches: DataFrame, window: int) -> DataFrame:
    """Every window of the given stretches, with its hash as anchor and body."""
    # by id and text, so rows that share an id or have none bring each other nothing
    wanted = stretches.groupBy("doc", F.shiftright("at", _PLACE_BITS).alias("_tag")).agg(F.collect_list(F.struct("at", "n")).alias("_parts"))
    joined = docs.withColumn("_tag", _tag_of(F.col("_text"))).join(wanted, ["doc", "_tag"]).select("doc", "_text", "_parts")

    def run(batches):
        words = Words()
        for batch in batches:
            lists = batch.column(2)
            cells = lists.flatten()
            cell_at, cell_n = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            batch = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()),
                 lists.value_lengths()], names=["doc", "_text", "_from", "_n"],
            )
            for part, texts, hashes, edges in _slice(batch, words):
                full = windows(hashes, window)
                ids, begin, size = part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(3).to_numpy()
                starts, doc, tag = [], [], []
                for k, text in enumerate(texts):
                    own = _tag(text)
                    a, n = cell_at[begin[k] : begin[k] + size[k]] - own, cell_n[begin[k] : begin[k] + size[k]]
                    mine = (a >= 0) & (a < edges[k + 1] - edges[k])  # else of another row with this id
                    a, n = a[mine], n[mine]
                    each = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    starts.append(each + edges[k])
                    doc.append(np.full(len(each), ids[k]))
                    tag.append(np.full(len(each), own - edges[k]))
                starts, doc, tag = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, doc, tag))
                if not len(starts):
                    continue
                value, at = full[starts].view(np.int64), starts + tag
                order, lead = _first_of([value], doc, at)
                head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
                gone = ~lead & ((doc[order] != doc[order][head]) | (at[order] != at[order][head]))
                keep, gone = order[lead], order[gone]
                one = np.ones(len(starts), np.int64)
                yield _rows(_STRETCH, value[keep], 0, doc[keep], at[keep], one[keep])
                yield _rows(_GONE, doc[gone], 0, doc[gone], at[gone], one[gone] + window - 1)

    return joined.mapInArrow(trimmed(run), _ROWS)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions("anchor", "body", "doc", "at")


def gone_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, at, n): stretches of words to remove; ``doc`` is the id (least long for null)."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    first = written(_repeats_in(_sorted(_stretches(keyed, window)), window), "repeats")
    edges = first.where(F.col("kind") == _STRETCH)
    second = _repeats_in(_sorted(_single_windows(keyed, edges, window)), window)
    return (
        first.where(F.col("kind") == _GONE)
        .unionByName(second.where(F.col("kind") == _GONE))
        .select("doc", "at", "n")
    )


def _kept(words: list[bytes], own: int, at: np.ndarray, n: np.ndarray) -> tuple[list[bytes], int]:
    a = at - own
    mine = (a >= 0) & (a < len(words))
    if not mine.any():
        return words, 0
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, a[mine], 1)
    np.add.at(turn, a[mine] + n[mine], -1)
    gone = np.cumsum(turn[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def remove(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """All rows and columns of ``docs``, with n_words, n_removed, kept_sha256 and kept_text.

    kept_text is the text as it was where nothing is removed, else the kept words joined by one
    space; without ``with_text`` it is left out. A column of ``docs`` that has one of these names
    is kept and the new one left out.
    """
    spans = gone_words(docs, window, id_col, text_col).groupBy("doc", F.shiftright("at", _PLACE_BITS).alias("tag")).agg(
        F.collect_list("at").alias("_at"), F.collect_list("n").alias("_n")
    )
    made = [("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType()), ("kept_text", StringType())]
    made = made if with_text else made[:3]
    inner = [f"c{k}" for k in range(len(docs.columns))]
    text = docs.columns.index(text_col)
    source = docs.toDF(*inner).withColumn("doc", F.coalesce(F.col(inner[docs.columns.index(id_col)]).cast("long"), F.lit(_NO_ID)))
    joined = source.withColumn("tag", _tag_of(F.col(inner[text]))).join(spans, ["doc", "tag"], "left").select(*inner, "_at", "_n")
    schema = StructType([joined.schema[c] for c in inner] + [StructField(f"m_{c}", kind) for c, kind in made])

    def run(batches):
        for batch in batches:
            for part in cut(batch, inner[text]):
                texts = part.column(text).cast(pa.binary()).to_pylist()
                at, n = part.column(len(inner)), part.column(len(inner) + 1)
                out = [[], [], [], []]
                for k, data in enumerate(texts):
                    words, gone = plain_words(data), 0
                    n_words = len(words)
                    if at[k].is_valid:
                        words, gone = _kept(words, _tag(data or b""), at[k].values.to_numpy(), n[k].values.to_numpy())
                    kept = b" ".join(words)
                    out[0].append(n_words)
                    out[1].append(gone)
                    out[2].append(hashlib.sha256(kept).hexdigest())
                    out[3].append(kept if gone else data)
                new = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                if with_text:
                    new.append(pa.array(out[3], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(inner)], *new], names=schema.names)

    taken = {c.lower() for c in docs.columns}
    new = [F.col(f"m_{c}").alias(c) for c, _ in made if c not in taken]
    return joined.mapInArrow(trimmed(run), schema).select(*[F.col(a).alias(c) for a, c in zip(inner, docs.columns)], *new)


def digest(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return remove(plain, window, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")

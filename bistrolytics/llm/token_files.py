"""Token ids in ORC files.

Documents are range-partitioned by id, sorted, encoded where they lie and written by Spark's ORC
writer: the ids are one integer column (run-length encoded by the format), every stripe carries a
row index, and ``doc_id`` has a Bloom filter in each row group. A reader takes stripes in parallel
and skips files, stripes and row groups by minimum, maximum and Bloom filter.

File columns: doc_id; ``block`` (the range partition, ascending like the ids); ``at`` (ids of the
block before this document); ``n_ids``; ``ids``.

Nulls: a null text is an empty one, a null doc_id is sorted first. Repeated ids stay separate rows,
ordered by text. An empty table gives a file without rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .texts import SLICE_BYTES, bounded_batches, cut

#: Bytes of words and ids that a Python worker remembers, from task to task; a full memory keeps the last slice's.
CACHED_BYTES = 160 << 20
#: What a remembered word takes besides its letters and ids.
_WORD_BYTES = 200
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never span white space.

    The tokenizer lower-cases, so ASCII letters are lower-cased first, which makes more words equal.
    The text is cut at ASCII white space, and each distinct word is encoded once by the library,
    without the ASCII punctuation at its end (a boundary of the tokenizer's pattern after a letter
    or digit). A text that may hold a special token's string is encoded as a whole.
    """

    _LETTERS = regex.compile(r"\p{L}+")
    _PLAIN = re.compile("[a-z]+")
    _PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
    _PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0
        size = self.tokenizer.get_vocab_size()
        #: pieces that end a word: between them lie the words of a joined text
        self.ends = np.asarray([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _each(self, texts: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(code.ids, "<u4").tobytes() for code in codes]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, joined into one text per thousand."""
        out = []
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part):
                data, edges = ids.tobytes(), [0, *(4 * last).tolist()]
                out.extend(data[x:y] for x, y in zip(edges, edges[1:]))
            else:
                out.extend(self._each(part))
        return out

    def _learn(self, fresh: set[bytes]) -> None:
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for word in fresh:
            head = word.rstrip(self._PUNCTUATION)
            if len(head) < len(word) and head and (head.isalpha() or head[-1:].isalnum()):
                parts[word] = head, word[len(head) :]
        wanted = [w for w in fresh if w not in parts]
        wanted.extend({x for pair in parts.values() for x in pair if x not in self.known and x not in fresh})
        # lower-case ASCII letters are one piece that the normaliser leaves alone: the model alone encodes them
        merge, pack, plain = self.tokenizer.model.tokenize, self._PACK, self._PLAIN.fullmatch
        letters, other = [], []
        for word in wanted:
            text = word.decode("utf-8", "replace")
            if plain(text):
                ids = [token.id for token in merge(text)]
                self.known[word] = pack[len(ids)](*ids) if len(ids) < len(pack) else np.asarray(ids, "<u4").tobytes()
            else:
                (letters if self._LETTERS.fullmatch(text) else other).append(word)
        self.known.update(zip(letters, self._letters([w.decode() for w in letters])))
        for a in range(0, len(other), 5000):
            self.known.update(zip(other[a : a + 5000], self._each([w.decode("utf-8", "replace") for w in other[a : a + 5000]])))
        for word in sorted(parts, key=len):  # a head may itself be a word with parts
            head, tail = parts[word]
            self.known[word] = self.known[head] + self.known[tail]
        self.known.setdefault(b"", b"")  # at the ends of a text that white space surrounds

    def _looked_up(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of the distinct words of a slice."""
        known = self.known
        fresh = {w for w in distinct if w not in known}
        if self.known_bytes > CACHED_BYTES:
            self.known = known = {w: known[w] for w in distinct if w in known}
            self.known_bytes = sum(len(w) + len(v) + _WORD_BYTES for w, v in known.items())
        before = len(known)
        self._learn(fresh)
        self.known_bytes += (len(known) - before) * _WORD_BYTES + sum(len(w) + len(known[w]) for w in fresh)
        return [known[w] for w in distinct]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids in a row) of a slice of strings, nulls being empty.

        The words of a slice become codes of its distinct words in one pass of Arrow, and their ids
        are gathered by numpy, so Python sees distinct words only.
        """
        texts = pc.fill_null(texts, "")
        whole = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        split = texts
        if len(whole):
            special = np.zeros(len(texts), bool)
            special[whole] = True
            split = pc.if_else(pa.array(special), "", texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(split))
        words = lists.flatten().dictionary_encode()
        table = self._looked_up(words.dictionary.cast(pa.binary()).to_pylist())
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, starts = np.frombuffer(b"".join(table), "<i4"), np.cumsum(lengths) - lengths
        codes = words.indices.to_numpy()
        n = lengths[codes]
        edges = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(edges[-1]) + np.repeat(starts[codes] - edges[:-1], n)]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        sizes = np.diff(edges[bounds])
        if len(whole):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k, code in zip(whole.tolist(), self._each(texts.take(pa.array(whole)).to_pylist())):
                parts[k] = np.frombuffer(code, "<i4")
            sizes, ids = np.asarray([len(x) for x in parts]), np.concatenate(parts)
        return sizes, ids


def worker_encoder(path: str) -> WordEncoder:
    """The Python worker's own encoder; a worker runs many tasks, and their words repeat."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
    row_group: int = 1_000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode every text, append ``end_id``, write ORC in ascending id order."""
    schema = StructType(
        [
            StructField("doc_id", docs.schema[id_col].dataType),
            StructField("block", IntegerType()),
            StructField("at", LongType()),
            StructField("n_ids", LongType()),
            StructField("ids", ArrayType(IntegerType(), False)),
        ]
    )
    def run(batches):
        encoder, block, at = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in cut(batch, "_text", SLICE_BYTES):
                sizes, codes = encoder.ids(part.column(1))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                ids = np.full(int(ends[-1]), end_id, np.int32)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = codes
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.full(len(sizes), block), pa.int32()),
                        pa.array(at + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        lists,
                    ],
                    names=schema.names,
                )
                at += int(ends[-1])

    bounded_batches(docs.sparkSession)
    placed = (
        docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("_text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "_text")
    )
    (
        placed.mapInArrow(run, schema)
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_group))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; ``doc_ids`` prunes stripes and row groups by index and Bloom filter."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` is the place in the block plus the ids of all blocks before. The blocks' totals come
    from two narrow columns; there is one row per written partition, so they may be broadcast.
    """
    bounded_batches(spark)
    rows = read_ids(spark, path)
    totals = rows.groupBy("block").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    schema = StructType(
        [
            rows.schema["doc_id"],
            rows.schema["block"],
            rows.schema["at"],
            StructField("n_tokens", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            edges = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(np.diff(edges).astype(np.int64)),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])], pa.int64()),
                ],
                names=schema.names,
            )

    digests = rows.select("doc_id", "block", "at", "ids").mapInArrow(digest, schema)
    return digests.join(F.broadcast(offsets), "block").select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )

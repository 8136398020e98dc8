"""Byte-level BPE by Spark higher-order functions.

Texts are cut into pieces by the tokenizer's pattern. Each distinct piece that a task meets and that
is not a token as a whole is encoded once, by folding the merges over its bytes: a word is a string with one character per token (token id + 2), a literal map gives the
merged token of a pair of neighbours, and each step of the fold merges the leftmost pair of lowest
rank. Decoding concatenates the tokens' bytes.

Nothing is shuffled and only the rank table, of fixed size, is sent to tasks. A task works in chunks
of about ``CHUNK_BYTES`` of text (a longer document is a chunk of its own) and remembers the first
``KNOWN_WORDS`` pieces from chunk to chunk; others are encoded once per chunk. The more text a task reads, the more often a piece is
met again, so input splits are joined to about ``TASK_BYTES`` of text, while there are enough of
them for all cores. A piece of over ``FOLD_LIMIT`` bytes (its fold would take
time with the square of its length) is merged by the library, with the same ranks.

Nulls: a null text is an empty one, without tokens; a null id stays. Repeated rows are encoded one
by one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .texts import bounded_batches, cut, trimmed

CHUNK_BYTES = 1 << 20
KNOWN_WORDS = 400_000
TASK_BYTES = 128 << 20
FOLD_LIMIT = 256
_BUCKETS = 1 << 15
#: White space as the library's pattern means it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _written_out(pattern: str, space: str, letters: str, digits: str) -> str:
    wide = pattern.replace(r"[^\s", "[^" + space).replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"\s+", f"[{space}]+")
    return wide.replace(r"[^" + space + r"\p{L}\p{N}]", f"[^{space}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into the pattern's pieces.

    The classes are written out: white space as the library means it, and for texts within Latin-1
    also letters and digits, which the plain engine matches faster.
    """
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(256)}
    latin = ["".join(f"\\x{c:02x}" for c in range(256) if kinds[c] == kind) for kind in "LN"]
    narrow = re.compile(_written_out(pattern, "\\t-\\r \\x85\\xa0", *latin)).findall
    wide = regex.compile(
        _written_out(pattern, _SPACE, r"\p{L}", r"\p{N}").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    ).findall

    def pieces(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return narrow(text)

    return pieces


def _char(token: int) -> str:
    return chr(token + 2)


def pair_map(ranks: dict[bytes, int]) -> Column:
    """Literal: for each hash bucket a map from a pair of tokens to the merged one."""
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                pair = _char(left) + _char(right)
                entry = json.dumps(pair, ensure_ascii=False) + ":" + json.dumps(_char(rank), ensure_ascii=False)
                buckets[zlib.crc32(pair.encode()) % _BUCKETS].append(entry)
    text = "[" + ",".join("{" + ",".join(entries) + "}" for entries in buckets) + "]"
    return F.from_json(F.lit(text), "array<map<string,string>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(word: Column, merged: Column) -> Column:
    """All merges of a word given as one character per byte's token; null stays null."""

    def of_pair(pair: Column) -> Column:
        bucket = (F.crc32(pair.cast("binary")) % _BUCKETS).cast("int")
        return F.element_at(F.get(merged, bucket), pair)

    def step(state: Column, _: Column) -> Column:
        # a finished word carries a mark at its end, so that the remaining steps are free
        pairs = F.transform(F.sequence(F.lit(1), F.length(state) - 1), lambda i: of_pair(F.substr(state, i, F.lit(2))))

        def merge(found: Column) -> Column:
            # characters order like ranks
            return _let(F.array_min(found), lambda low: F.when(low.isNull(), F.concat(state, F.lit("\x01"))).otherwise(
                F.overlay(state, low, F.array_position(found, low).cast("int"), F.lit(2))
            ))

        finished = F.endswith(state, F.lit("\x01")) | (F.length(state) < 2)
        return F.when(finished, state).otherwise(_let(pairs, merge))

    steps = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.rtrim(F.aggregate(steps, word, step), F.lit("\x01"))


class _Places(dict):
    """Place of each piece met: -1 - rank for a token, else its place among the distinct words.

    A piece that is new is added by the look-up itself, so the pieces of a text are gone through once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.before, self.words = ranks, 0, []

    def __missing__(self, piece: str) -> int:
        rank = self.ranks.get(piece.encode())
        if rank is None:
            place = self.before + len(self.words)
            self.words.append(piece)
        else:
            place = -1 - rank
        self[piece] = place
        return place

    def next_chunk(self) -> int:
        """Forgets what is beyond the known words; gives how many of the chunk's words stay."""
        stay = max(0, min(len(self.words), KNOWN_WORDS - self.before))
        for word in self.words[stay:]:
            del self[word]
        self.before, self.words = self.before + stay, []
        return stay


_CHUNK = StructType(
    [
        StructField("docs", BinaryType()), StructField("known", BinaryType()), StructField("sizes", BinaryType()),
        StructField("index", BinaryType()), StructField("kept", IntegerType()), StructField("words", ArrayType(StringType())), StructField("long", ArrayType(BinaryType())),
    ]
)


def _chunks(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per chunk: ids, pieces per document, pieces as places in the list of distinct words.

    A row has the words that are new in it; the first ``kept`` of them stay known, with their places,
    for the rows that follow.
    """

    def run(batches):
        find, ranks = splitter(pattern), load_ranks(ranks_path)
        start = {i: _char(ranks[bytes([i])]) for i in range(256)}
        def row(ids, nulls, sizes, index, kept, words):
            plain = [w.encode().decode("latin-1").translate(start) for w in words]
            big = [w.encode() if len(p) > FOLD_LIMIT else None for w, p in zip(words, plain)]
            out = [
                np.asarray(ids, np.int64).tobytes(), np.asarray(nulls, bool).tobytes(), np.asarray(sizes, "<i4").tobytes(),
                b"".join(index), kept, [p if b is None else None for p, b in zip(plain, big)], [b for b in big if b is not None],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(out, (pa.binary(),) * 4 + (pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary())))],
                names=_CHUNK.names,
            )

        ids, nulls, sizes, index, size = [], [], [], [], 0
        places = _Places(ranks)
        for batch in batches:
            batch = batch.set_column(1, "text", batch.column(1).cast(pa.binary()))
            for part in cut(batch, "text"):
                known = part.column(0).is_null().to_numpy(zero_copy_only=False)
                for doc, null, text in zip(part.column(0).fill_null(0).to_pylist(), known, part.column(1).to_pylist()):
                    text = text or b""
                    pieces = find(text.decode("utf-8", "replace"))
                    ids.append(doc)
                    nulls.append(null)
                    sizes.append(len(pieces))
                    index.append(np.fromiter(map(places.__getitem__, pieces), "<i4", len(pieces)).tobytes())
                    size += len(text)
                    if size >= CHUNK_BYTES:
                        words = places.words
                        yield row(ids, nulls, sizes, index, places.next_chunk(), words)
                        ids, nulls, sizes, index, size = [], [], [], [], 0
        if ids:
            yield row(ids, nulls, sizes, index, 0, places.words)

    return docs.withColumnRenamed("_text", "text").mapInArrow(trimmed(run), _CHUNK)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    derive: Callable[[np.ndarray], tuple] | None = None,
    fields: list[tuple] = (),
) -> DataFrame:
    """(doc_id, ids) of every document; with ``derive``, its ``fields`` of the ids instead of ids."""
    bounded_batches(docs.sparkSession)
    ranks = load_ranks(ranks_path)
    if max(ranks.values()) + 2 >= 0xD800:
        raise ValueError("ranks must stay below 55,294: a token is one character of the basic plane")
    keyed = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    merged = pair_map(ranks)
    folded = _chunks(keyed.coalesce(int(tasks)), ranks_path, pattern).select(
        "docs", "known", "sizes", "index", "kept", F.transform("words", lambda w: fold(w, merged)).alias("words"), "long"
    )
    made = [(name, kind) for name, kind in fields] if derive else [("ids", ArrayType(IntegerType(), False))]
    schema = StructType([StructField("doc_id", LongType())] + [StructField(n, k) for n, k in made])

    def run(batches):
        library = None
        codes, first = np.zeros(0, "<u2"), np.zeros(1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = {name: batch.column(name)[k].as_py() for name in _CHUNK.names}
                known = len(first) + chunk["kept"]
                words = chunk["words"]
                if chunk["long"]:
                    if library is None:
                        import tiktoken

                        library = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(ranks_path), special_tokens={})
                    rest = iter(chunk["long"])
                    words = ["".join(map(_char, library.encode_ordinary(next(rest).decode()))) if w is None else w for w in words]
                codes = np.concatenate([codes, np.frombuffer("".join(words).encode("utf-16-le"), "<u2") - np.uint16(2)])
                first = np.concatenate([first, first[-1] + np.cumsum([len(w) for w in words], dtype=np.int64)])
                index = np.frombuffer(chunk["index"], "<i4")
                ids = np.frombuffer(chunk["docs"], np.int64)
                nulls = np.frombuffer(chunk["known"], bool)
                ends = np.cumsum(np.frombuffer(chunk["sizes"], "<i4"))
                a = 0
                rows: list[tuple] = []
                for doc, null, b in zip(ids.tolist(), nulls.tolist(), ends.tolist()):
                    rows.append((None if null else doc, _gather(index[a:b], first, codes)))
                    a = b
                    if len(rows) >= 1000:
                        yield finish(rows)
                        rows = []
                if rows:
                    yield finish(rows)
                first = first[:known].copy()
                codes = codes[: first[-1]].copy()

    def finish(rows):
        head = pa.array([doc for doc, _ in rows], pa.int64())
        if derive is None:
            edges = np.concatenate([[0], np.cumsum([len(ids) for _, ids in rows])])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([ids for _, ids in rows]), pa.int32()))
            return pa.RecordBatch.from_arrays([head, lists], names=schema.names)
        columns = zip(*[derive(ids) for _, ids in rows])
        return pa.RecordBatch.from_arrays([head, *[pa.array(list(c)) for c in columns]], names=schema.names)

    return folded.mapInArrow(trimmed(run), schema)


def _gather(index: np.ndarray, first: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tokens of the pieces of one document: a negative place is a token, others lie in ``codes``."""
    if not len(index):
        return np.zeros(0, "<u4")
    word = np.maximum(index, 0)
    count = np.where(index < 0, 1, first[word + 1] - first[word]) if len(first) > 1 else np.ones(len(index), np.int64)
    at = np.repeat(np.where(index < 0, 0, first[word]) - (np.cumsum(count) - count), count) + np.arange(count.sum())
    owner = np.repeat(index, count)
    if not len(codes):
        return (-1 - owner).astype("<u4")
    return np.where(owner < 0, -1 - owner, codes[at * (owner >= 0)]).astype("<u4")


def decoder(ranks: dict[bytes, int]) -> Callable[[np.ndarray], bytes]:
    """Bytes of a list of ids."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    get = pieces.__getitem__
    return lambda ids: b"".join(map(get, ids.tolist()))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text) of encoded documents; text is binary, since ids may end within a character."""
    bounded_batches(encoded.sparkSession)
    ranks = load_ranks(ranks_path)

    def run(batches):
        text_of = decoder(ranks)
        for batch in batches:
            lists = batch.column(1)
            edges, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [text_of(ids[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text binary")


class _Digest:
    """n_tokens, and checksums of the ids and of the decoded bytes, of one document's ids."""

    def __init__(self, ranks_path: str, with_ids: bool):
        self.ranks_path, self.with_ids, self.text_of = ranks_path, with_ids, None
        self.fields = [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())]
        if with_ids:
            self.fields.append(("ids", ArrayType(IntegerType(), False)))

    def __call__(self, ids: np.ndarray) -> tuple:
        if self.text_of is None:  # once per task
            self.text_of = decoder(load_ranks(self.ranks_path))
        found = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(self.text_of(ids)).hexdigest()
        return (*found, ids.astype("<i4")) if self.with_ids else found


def digest(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids if asked): every text encoded and decoded again."""
    derive = _Digest(ranks_path, with_ids)
    return encode(docs, ranks_path, pattern, id_col, text_col, derive, derive.fields)

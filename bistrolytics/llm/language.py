"""Language of a text by compression.

Each language has a zstandard raw-content dictionary made of its own texts. A text is lower-cased,
everything but letters becomes a space (else punctuation and layout would decide), and it is cut
into chunks that are compressed with each dictionary; the language with the smallest total is
chosen. Where the second is hardly larger the choice is marked as not accepted.

Learning reads ``sample_docs`` texts per language (those with the smallest hash of their id, so the
choice does not depend on the order of rows), each whole. Pieces spread over the whole of a text stand
for it, equal texts once; the dictionary takes a piece of every text, then a second one of each, until
``dictionary_bytes`` are full. That bounds the dictionaries, which are sent to every task. Prediction
reads the whole of every text.

Nulls: a null text, and one without a letter, is ``und`` with score 0; rows without language or text
teach nothing; a null id stays. Without any language to learn all texts are ``und``. Equal totals, as
very short texts have them, choose the language with more texts to learn from, with score 0. Other
columns are ignored.
"""

from __future__ import annotations

import itertools

import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, StringType

from .texts import per_document

UNKNOWN = "und"


_SPACES = bytes(c if chr(c).isalpha() else 32 for c in range(256))
_NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """Lower-case words of letters, one space between them."""
    low = text.lower()
    try:
        plain = low.encode("latin-1").translate(_SPACES)
    except UnicodeEncodeError:
        return _NO_LETTERS.sub(" ", low).strip().encode()
    return b" ".join(plain.split()).decode("latin-1").encode()


PIECE = 128
PIECES = 16


def pieces_of(data: bytes) -> list[bytes]:
    """At most PIECES pieces: all of a short text in order, else places spread evenly, far ones first."""
    if len(data) <= PIECE * PIECES:
        return [data[a : a + PIECE] for a in range(0, len(data), PIECE)]
    order = sorted(range(PIECES), key=lambda k: int(f"{k:04b}"[::-1], 2))
    starts = [k * (len(data) - PIECE) // (PIECES - 1) for k in order]
    return [data[a : a + PIECE] for a in starts]


def learn(
    labelled: DataFrame,
    sample_docs: int = 200,
    dictionary_bytes: int = 48 << 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, bytes]:
    """Raw dictionary content per language, the language with most texts first."""
    rows = labelled.where(labelled[lang_col].isNotNull() & labelled[text_col].isNotNull()).select(
        labelled[id_col].alias("_id"), labelled[lang_col].cast("string").alias("_lang"), labelled[text_col].cast("string").alias("_text")
    )
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = rows.select("_lang", "_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_docs)
    # at most sample_docs rows per language, so the ids may be broadcast
    wanted = F.broadcast(chosen.select("_id", "_lang").distinct())
    same = rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_lang"] == wanted["_lang"])
    texts = rows.join(wanted, same, "left_semi")

    def make():
        return lambda texts: {"_pieces": [pieces_of(letters(t.decode("utf-8", "replace"))) if t else [] for t in texts]}

    found = per_document(texts, make, [("_pieces", ArrayType(BinaryType()))], "_id", "_text", ("_lang",))
    by_lang: dict[str, set] = {}
    for row in found.select("_lang", "_pieces").distinct().collect():  # some pieces of a bounded sample
        by_lang.setdefault(row["_lang"], set()).add(tuple(map(bytes, row["_pieces"])))
    made: dict[str, bytes] = {}
    for lang, texts_of in by_lang.items():
        turns = [piece for turn in itertools.zip_longest(*sorted(texts_of)) for piece in turn if piece]
        made[lang] = b"\n".join(turns)[:dictionary_bytes]
    often = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    return {lang: made[lang] for lang in sorted(made, key=lambda x: (-often.get(x, 0), x))}


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    min_margin: float = 0.02,
    chunk: int = 4096,
    level: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """lang_pred, score (how much larger the second is, 0 to 1) and accepted of every document."""
    names = list(dictionaries)

    def make():
        packers = []
        for name in names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            packers.append(
                zstandard.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

        def one(text: bytes | None):
            data = letters(text.decode("utf-8", "replace")) if text else b""
            if not packers or not data:
                return UNKNOWN, 0.0, False
            chunks = [data[a : a + chunk] for a in range(0, len(data), chunk)]
            sizes = sorted((sum(len(p.compress(c)) for c in chunks), k) for k, p in enumerate(packers))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            return names[sizes[0][1]], margin, margin >= min_margin

        def derive(texts):
            langs, scores, accepted = zip(*map(one, texts))
            return {"lang_pred": langs, "score": scores, "accepted": accepted}

        return derive

    fields = [("lang_pred", StringType()), ("score", DoubleType()), ("accepted", BooleanType())]
    return per_document(docs, make, fields, id_col, text_col, keep)

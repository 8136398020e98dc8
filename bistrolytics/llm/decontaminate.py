"""Benchmark passages in training documents, by suffix arrays of the training text.

A shard is a slice of training documents inside a task. Its suffixes are sorted by their first
``window`` words; every suffix of every test item is then found by binary search, which gives all
its verbatim occurrences as one range of the array. No training text is shuffled.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. An item with
fewer than ``window`` words is one window; an item without words has none. Training suffixes that
cannot hold the shortest window made of test words are left out of the array.

The test side is sent to every task. It is cut into passes of at most ``pass_words`` words, which
bounds what a task holds; several passes are united per document.

Nulls: a null text has no words; null ids stay. Repeated documents or items are judged separately
(equal item ids are named once). Empty tables give no rows, or no hits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .texts import alnum_words, per_document, places

_SPAN = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class TestSuffixes:
    """Windows of the test items as rows of word ids, with all places in the tests that hold each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window, self.words, seen, at = window, {}, {}, 0
        names = sorted({name for name, _ in items})
        code = {name: k for k, name in enumerate(names)}
        for name, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in alnum_words(text)]
            for a in range(max(1, len(words) - window + 1) if words else 0):
                seen.setdefault(tuple(words[a : a + window]), []).append((at + a, code[name]))
            at += len(words) + 2
        self.names = names
        self.sizes = np.asarray([len(w) for w in seen], np.int64)
        found = [pair for pairs in seen.values() for pair in pairs]
        #: places of window k: rows first[k] to first[k + 1] of ``at`` (word in all tests) and ``item``
        self.first = places([len(pairs) for pairs in seen.values()])
        self.at = np.asarray([x for x, _ in found], np.int64)
        self.item = np.asarray([x for _, x in found], np.int64)
        rows = np.zeros((len(seen), window), np.int64)
        for k, words in enumerate(seen):
            rows[k, : len(words)] = words
        last = np.where(np.arange(window)[None, :] < self.sizes[:, None], rows, len(self.words) + 1)
        self.bits = max(1, int(len(self.words) + 2).bit_length())
        self.low, self.high = self.packed(rows), self.packed(last)

    def packed(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of word ids as a few integers each, most significant first."""
        step = 62 // self.bits
        out = []
        for a in range(0, self.window, step):
            key = np.zeros(len(rows), np.int64)
            for c in range(a, min(a + step, self.window)):
                key = (key << self.bits) | rows[:, c]
            out.append(key)
        return out


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """First place whose key is not below (``after``: is above) the wanted one; all searches at once."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, want in zip(keys, wanted):
            here = key[mid]
            less |= same & (here < want)
            same &= here == want
        go = less | same if after else less
        low = np.where(open_ & go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


def _expand(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    first = np.repeat(low - (np.cumsum(count) - count), count)
    return first + np.arange(count.sum())


def shard_matches(words: np.ndarray, ends: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of a test window in a shard.

    ``words`` are word ids (0: no test item has the word), ``ends`` the document's end per place.
    """
    none = np.zeros(0, np.int64)
    if not len(tests.sizes) or not len(words):
        return none, none
    stop = np.where(words == 0, np.arange(len(words)), len(words))
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends)
    suffixes = np.flatnonzero(stop - np.arange(len(words)) >= tests.sizes.min())
    if not len(suffixes):
        return none, none
    reach = suffixes[:, None] + np.arange(tests.window)[None, :]
    inside = reach < ends[suffixes][:, None]
    keys = tests.packed(np.where(inside, words[np.minimum(reach, len(words) - 1)], 0))
    order = np.lexsort(keys[::-1])
    suffixes, keys = suffixes[order], [key[order] for key in keys]
    low, high = _bound(keys, tests.low, False), _bound(keys, tests.high, True)
    count = np.maximum(high - low, 0)
    return suffixes[_expand(low, count)], np.repeat(np.arange(len(count)), count)


def _finder(tests: TestSuffixes):
    def make():
        known = tests.words

        def derive(texts):
            split = [alnum_words(text) for text in texts]
            edges = places([len(w) for w in split])
            words = np.fromiter((known.get(w, 0) for doc in split for w in doc), np.int64, edges[-1])
            place, which = shard_matches(words, np.repeat(edges[1:], np.diff(edges)), tests)
            doc = np.searchsorted(edges, place, "right") - 1

            turn = np.zeros(edges[-1] + 1, np.int64)
            np.add.at(turn, place, 1)
            np.add.at(turn, place + tests.sizes[which], -1)
            hit = np.cumsum(turn[:-1]) > 0
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1]
            closes[:-1] &= ~hit[1:]
            if len(hit):  # a run ends with its document
                first, last = edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0] - 1
                opens[first] |= hit[first]
                closes[last] |= hit[last]
            spans: list[list] = [[] for _ in texts]
            starts = np.flatnonzero(opens)
            for d, a, b in zip(np.searchsorted(edges, starts, "right") - 1, starts, np.flatnonzero(closes)):
                spans[d].append({"start": int(a - edges[d]), "end": int(b + 1 - edges[d])})

            count = np.diff(tests.first)[which]
            source = _expand(tests.first[which], count)
            doc, place, size = (np.repeat(x, count) for x in (doc, place, tests.sizes[which]))
            items: list[list] = [[] for _ in texts]
            for d, k in np.unique(np.stack([doc, tests.item[source]], 1), axis=0).tolist():
                items[d].append(tests.names[k])
            # windows that follow one another in a test and in a document are one verbatim match
            line = place - tests.at[source]
            order = np.lexsort([place, line])
            line, place, doc, size = line[order], place[order], doc[order], size[order]
            new = np.ones(len(line), bool)
            new[1:] = (line[1:] != line[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
            longest = np.zeros(len(texts), np.int64)
            np.maximum.at(longest, doc, _run(place, new) + size)
            return {"n_words": np.diff(edges), "spans": spans, "items": items, "longest": longest}

        return derive

    return make


def _run(place: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Steps from the first place of each run."""
    if not len(place):
        return place
    return place - place[np.flatnonzero(new)][np.cumsum(new) - 1]


def matches(
    docs: DataFrame,
    tests: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_words: int = 1 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., n_words, spans of hit words, items, longest) for every document.

    The test table is read in passes: items are dealt by a hash of their id so that each pass holds
    about ``pass_words`` words or one item.
    """
    items = tests.select(
        F.coalesce(tests[item_col].cast("string"), F.lit("")).alias("name"), tests[item_text_col].cast("binary").alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // (6 * pass_words)))
    fields = [
        ("n_words", LongType()), ("spans", _SPAN), ("items", ArrayType(StringType())), ("longest", LongType()),
    ]
    if passes == 1:
        return _one_pass(docs, items, window, id_col, text_col, fields, keep)
    # a row key carries a document through the passes; equal ids stay apart by their position
    keyed = docs.withColumn("_row", F.monotonically_increasing_id())
    parts = [
        _one_pass(keyed, items.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k), window, id_col, text_col, fields, ("_row", *keep))
        for k in range(passes)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    merged = found.groupBy("_row").agg(
        F.first(id_col).alias(id_col),
        *[F.first(c).alias(c) for c in keep],
        F.first("n_words").alias("n_words"),
        united(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("longest").alias("longest"),
    )
    return merged.drop("_row")


def united(spans):
    """Sorted spans with those that overlap or touch made one."""
    empty = F.array().cast(_SPAN)

    def step(done, span):
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (span["start"] <= last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, empty, step)


def _one_pass(docs, items, window, id_col, text_col, fields, keep):
    rows = [(r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in items.collect()]
    return per_document(docs, _finder(TestSuffixes(rows, window)), fields, id_col, text_col, keep)


def clean(
    docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents that hold no window of a test item, with all their columns."""
    inner = [f"d{k}" for k in range(len(docs.columns))]
    named = dict(zip(docs.columns, inner))
    own_id = named[id_col]
    found = matches(
        docs.toDF(*inner), tests, window, own_id, named[text_col], item_col, item_text_col,
        keep=tuple(c for c in inner if c != own_id),
    )
    return found.where(F.size("spans") == 0).select(*inner).toDF(*docs.columns)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of each row of ``matches``."""
    names = F.array_sort("items")
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )

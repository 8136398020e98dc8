"""N-gram Jaccard join: documents whose sets of five-word shingles are similar, as components.

1. *Shared shingles.* A task packs the shingles of a block of documents by hash bucket; a bucket
   counts in how many documents each shingle occurs and tells the blocks which of theirs are shared.
   A document can only link when at least the asked share of its shingles is shared, so most
   documents end here. Shingles that a block alone holds more than ``COMMON`` times are known to be
   common and leave one row per block, which flattens frequent lines.
2. *Global order.* Shingles are ordered by document count (all above ``COMMON`` alike), then hash. A
   linked pair shares one of the first n - ceil(share * n) + 1 shingles of both; these rows are the
   postings. Equal sets are one class with one posting list.
3. *Prefix tree.* Candidate sets of a probing document reach a task sorted like the paths of a
   trie. The traversal keeps the partial overlap of the current path, starts each set where it
   leaves the path before, and drops what the remaining lengths cannot bring to the asked overlap.
4. *Components.* The first candidates are, within each posting list, neighbours by size and the
   member with the fewest shingles of its own, its hub (linear in the postings). Later rounds look
   only at lists that still hold several components: first at members outside the largest one with
   that one's hub, then at all pairs of different components that sizes and positions allow, with
   one side outside the largest. So no link between components is lost, while a group of thousands
   of near copies is never paired out.

No list, group or set of links is gathered; sizes of blocks and buckets are bounded.

Nulls: a null text and one without words have an empty set and are their own component. A null id
stays null, and so does its component where no other id is in it. Classes are keyed by the digest of
their set, links and components by row, so rows with one id and different sets are judged apart. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, MapType, StructField, StructType, VariantType,
)

from bistrolytics.functions.sizing import written

from .texts import Words, bounded_batches, cut, folded_words, places, trimmed, windows

COMMON = 64
BUCKET_BYTES = 16 << 20
#: Stands for a null id, after all others, so that a component is named by a real id where it has one.
_NO_ID = (1 << 63) - 1
_PACK = StructType(
    [
        StructField("to", LongType()), StructField("block", LongType()), StructField("bucket", IntegerType()),
        StructField("ids", BinaryType()), StructField("sizes", BinaryType()), StructField("data", BinaryType()),
    ]
)
_HEAD, _COMMON = -1, -2
_PROFILE = StructType(
    [
        StructField("doc", LongType()), StructField("mark", LongType()), StructField("row", LongType()), StructField("n", LongType()),
        StructField("hi", LongType()),
        StructField("lo", LongType()), StructField("tokens", ArrayType(LongType(), False)),
    ]
)


def shingles(texts: list[bytes | None], words: Words, length: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; a shorter text is one shingle."""
    split = [folded_words(t) for t in texts]
    edges = places([len(w) for w in split])
    hashes = words.of([w for doc in split for w in doc])
    full = windows(hashes, length)
    out = []
    for a, b in zip(edges, edges[1:]):
        if b - a >= length:
            out.append(np.unique(full[a : b - length + 1]))
        elif b > a:
            out.append(np.asarray([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _pack_rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_PACK.names)


def _row_keys(block: int, n: int) -> np.ndarray:
    """Unique keys of the rows of a block: 20 bits for the task, 22 for its slice, 21 for the row."""
    task, seq = block >> 32, block & 0xFFFFFFFF
    if task >= 1 << 20 or seq >= 1 << 22 or n > 1 << 21:
        raise ValueError("too many tasks, slices or rows for row keys")
    return ((task << 43) | (seq << 21)) + np.arange(n, dtype=np.int64)


def _six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Per block of documents: one head row (ids, set sizes, set keys) and one row per hash bucket."""

    def run(batches):
        words, seq, task = Words(), 0, TaskContext.get().partitionId()
        for batch in batches:
            batch = batch.set_column(1, "_text", batch.column(1).cast(pa.binary()))
            for part in cut(batch, "_text"):
                block, seq = (task << 32) | seq, seq + 1
                sets = shingles(part.column(1).to_pylist(), words, length)
                ids = part.column(0).to_numpy()
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                first: dict[bytes, int] = {}
                for k in np.argsort(ids, kind="stable").tolist():
                    if len(sets[k]):
                        first.setdefault(keys[k], k)
                lead = np.zeros(len(sets), bool)
                lead[list(first.values())] = True
                head = (block, block, _HEAD, ids.tobytes() + part.column(2).to_numpy().tobytes(), np.asarray([len(s) for s in sets], "<i8").tobytes(), b"".join(keys))
                rows = [head]
                own = np.repeat(np.arange(len(sets)), [len(s) if x else 0 for s, x in zip(sets, lead)])
                tokens = np.concatenate([s for s, x in zip(sets, lead) if x] or [np.zeros(0, np.uint64)])
                order = np.argsort(tokens, kind="stable")
                tokens, own = tokens[order], own[order]
                start = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
                count = np.diff(np.append(start, len(tokens)))
                common = np.repeat(count > COMMON, count)
                if common.any():
                    rows.append((block, block, _COMMON, own[common].astype("<i4").tobytes(), b"", tokens[common].tobytes()))
                marks = tokens[start[count > COMMON]]
                tokens, own = tokens[~common], own[~common]
                shift = np.uint64(64 - bits)
                for kind, values, owners in ((0, tokens, own), (1, marks, None)):
                    bucket = (values >> shift).astype(np.int64)
                    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                    for a, b in zip(edges, [*edges[1:], len(bucket)]):
                        data = _six_bytes((values[a:b] << np.uint64(bits)) >> np.uint64(16))
                        who = b"" if owners is None else owners[a:b].astype("<u2" if len(sets) < 65536 else "<u4").tobytes()
                        rows.append((int(bucket[a]), block, int(bucket[a]), who, b"", data))
                yield _pack_rows(rows)

    return docs.mapInArrow(trimmed(run), _PACK)


def _labelled(packed: DataFrame) -> DataFrame:
    """Per bucket: shared shingles and their label (document count up to COMMON + 1), back to the blocks."""

    def answer(bucket, blocks, whos, datas):
        tokens = np.concatenate([_from_six(d) for d in datas])
        sizes = np.asarray([len(d) // 6 for d in datas])
        mark = np.repeat(np.asarray([len(w) == 0 for w in whos]), sizes)
        values, inverse = np.unique(tokens, return_inverse=True)
        count = np.bincount(inverse, weights=np.where(mark, COMMON + 1, 1))
        label = np.minimum(count, COMMON + 1).astype(np.uint8)[inverse]
        rows, a = [], 0
        for block, who, size in zip(blocks, whos, sizes):
            if who:
                keep = label[a : a + size] > 1
                if keep.any():
                    owner = np.frombuffer(who, "<u2" if len(who) == 2 * size else "<u4")[keep].astype("<u4")
                    rows.append((block, block, bucket, owner.tobytes(), label[a : a + size][keep].tobytes(), _six_bytes(tokens[a : a + size][keep])))
            a += size
        return _pack_rows(rows) if rows else None

    def run(batches):
        now, blocks, whos, datas = None, [], [], []
        for batch in batches:
            passing = pa.compute.less(batch.column(2), 0)
            if passing.true_count:
                yield batch.filter(passing)
            for row in batch.filter(pa.compute.invert(passing)).to_pylist():
                if row["bucket"] != now:
                    if now is not None and (made := answer(now, blocks, whos, datas)) is not None:
                        yield made
                    now, blocks, whos, datas = row["bucket"], [], [], []
                blocks.append(row["block"])
                whos.append(row["ids"])
                datas.append(row["data"])
        if now is not None and (made := answer(now, blocks, whos, datas)) is not None:
            yield made

    return packed.repartition("to").sortWithinPartitions("bucket").mapInArrow(trimmed(run), _PACK)


def _profiles(labelled: DataFrame, bits: int, percent: int) -> DataFrame:
    """Per document: row key, set size, set key, and its shared shingles in global order if they are enough."""

    def finish(head, parts):
        ids, marks = np.split(np.frombuffer(head["ids"], np.int64), 2)
        n = np.frombuffer(head["sizes"], "<i8")
        keys = np.frombuffer(head["data"], "<i8").reshape(-1, 2)
        own, label, token = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for part in parts:
            if part["bucket"] == _COMMON:
                own.append(np.frombuffer(part["ids"], "<i4").astype(np.int64))
                token.append((np.frombuffer(part["data"], np.uint64) >> np.uint64(16 - bits)) if bits < 16 else np.frombuffer(part["data"], np.uint64))
                label.append(np.full(len(own[-1]), COMMON + 1))
            else:
                own.append(np.frombuffer(part["ids"], "<u4").astype(np.int64))
                token.append((np.uint64(part["bucket"]) << np.uint64(48)) | _from_six(part["data"]))
                label.append(np.frombuffer(part["sizes"], np.uint8).astype(np.int64))
        own, label, token = np.concatenate(own), np.concatenate(label), np.concatenate(token)
        order = np.lexsort([token, label, own])
        own, label, token = own[order], label[order], token[order]
        shared = np.bincount(own, minlength=len(ids))
        enough = (100 * shared >= percent * n) & (shared > 0)
        keep = enough[own]
        # the label is kept in the token: its high byte orders first
        value = ((label.astype(np.uint64) << np.uint64(56)) | (token & np.uint64((1 << 56) - 1)))[keep].view(np.int64)
        edges = np.concatenate([[0], np.cumsum(np.where(enough, shared, 0))])
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(value), mask=pa.array(~enough))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(marks), pa.array(_row_keys(head["block"], len(ids))), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], names=_PROFILE.names
        )

    def run(batches):
        now, head, parts = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    if now is not None:
                        yield finish(head, parts)
                    now, head, parts = row["block"], None, []
                if row["bucket"] == _HEAD:
                    head = row
                else:
                    parts.append(row)
        if now is not None:
            yield finish(head, parts)

    return labelled.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(run), _PROFILE)


def _doc_and_mark(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The id, with a stand-in for null, and a checksum of the text: what names a row of documents."""
    return F.coalesce(doc_id.cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text.cast("string")).alias("mark")


def profiles(docs: DataFrame, length: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    keyed = docs.select(
        _doc_and_mark(docs[id_col], docs[text_col])[0], docs[text_col].cast("string").alias("_text"),
        _doc_and_mark(docs[id_col], docs[text_col])[1],
    )
    size = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # about one shingle of six packed bytes for six bytes of text; 8 bits at least spread small input
    bits = min(16, max(8, int(size // BUCKET_BYTES).bit_length()))
    return written(_profiles(_labelled(_packed(keyed, length, bits)), bits, percent), "profiles")


_LINK = StructType([StructField("a", LongType()), StructField("b", LongType())])


def links(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) that link: candidates of each a traversed as a prefix tree."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_c"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.floor(F.col("_c") / 256) + 1).alias("part"))
    cand = dealt.join(sets.select(F.col("doc").alias("b"), "n", "tokens"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "n", "tokens")
    probe = (
        dealt.select("a", "part").distinct().join(sets.select(F.col("doc").alias("a"), "n", "tokens"), "a")
        .select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "n", "tokens")
    )

    def run(batches):
        probe = probe_n = path = overlap = None
        known = 0
        for batch in batches:
            a, kind, b, n = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
            lists = batch.column(5)
            edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            for k in range(len(a)):
                tokens = values[edges[k] : edges[k + 1]]
                if kind[k] == 0:
                    probe, probe_n, path, known = np.sort(tokens), n[k], None, 0
                    continue
                need = -(-percent * (probe_n + n[k]) // (100 + percent))
                start = 0
                if path is not None:
                    m = min(known, len(tokens))
                    differs = np.flatnonzero(path[:m] != tokens[:m])
                    start = int(differs[0]) if len(differs) else m
                so_far = int(overlap[start]) if start else 0
                path, known = tokens, start
                if start == 0:
                    overlap = np.zeros(1, np.int64)
                if so_far + min(len(tokens) - start, len(probe) - so_far) < need:
                    continue  # the subtree below this point is too short
                rest = tokens[start:]
                at = np.minimum(np.searchsorted(probe, rest), len(probe) - 1)
                overlap = np.concatenate([overlap[: start + 1], so_far + np.cumsum(probe[at] == rest)])
                known = len(tokens)
                if overlap[-1] >= need:
                    found.append(k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    rows = cand.unionByName(probe).repartition("a", "part").sortWithinPartitions("a", "part", "kind", "tokens")
    return rows.mapInArrow(trimmed(run), _LINK)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that can be reached, for every node of ``edges`` (a, b)."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("_near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "_near").alias("_low"), "comp")
        up = labels.select(F.col("node").alias("_low"), F.col("comp").alias("_up"))
        # _low is a node of this graph: take its label as well, which halves long paths
        after = written(
            low.join(up, "_low").select("node", F.least("_low", "_up").alias("comp"), (F.least("_low", "_up") != F.col("comp")).alias("_moved")),
            "labels",
        )
        labels = after.select("node", "comp")
        if after.where("_moved").limit(1).count() == 0:
            return labels


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """Components of the documents after more links (a, b) between components."""
    a = comps.select(F.col("doc").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("doc").alias("b"), F.col("comp").alias("cb"))
    edges = found.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("_root"))
    return written(comps.join(roots, "comp", "left").select("doc", F.coalesce("_root", "comp").alias("comp")), "comps")


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, doc, n, u, i): prefixes in global order.

    u counts the set's shingles that no other set has, i is the place among all its shingles.
    """
    unshared = F.col("n") - F.size("tokens")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = sets.select(
        "doc", "n", unshared.alias("_u"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix - unshared).cast("int")))
    ).select(F.col("col").alias("token"), "doc", "n", F.col("_u").alias("u"), (F.col("pos") + F.col("_u")).alias("i"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("token")
    return written(rows.join(shared, "token"), "postings")


def _fits(percent: int):
    """Whether sizes n, m and places i, j of a common shingle leave room for the asked overlap."""
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return (room >= need) & (F.least("n", "m") >= need)


def _hub():
    """Orders members of a list: fewest shingles of their own first."""
    return F.struct("u", "doc", "n", "i")


def _with_hub(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of posting lists with the hub of their list, where sizes and places allow a link."""
    hub = hubs.select("token", F.col("hub.doc").alias("a"), F.col("hub.n").alias("n"), F.col("hub.i").alias("i"))
    other = members.select("token", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    return other.join(hub, "token").where((F.col("a") != F.col("b")) & _fits(percent)).select("a", "b").distinct()


def _mixed(posts: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of lists with several components: members outside the largest, all members, the largest's hub."""
    placed = posts.join(comps, "doc")
    in_list = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_c"), F.min(_hub()).alias("hub"))
    largest = (
        in_list.groupBy("token").agg(F.max(F.struct("_c", "comp", "hub")).alias("_m"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("token", F.col("_m.comp").alias("main"), F.col("_m.hub").alias("hub"))
    )
    inside = placed.join(largest.select("token", "main"), "token")
    return inside.where("comp <> main"), inside, largest.select("token", "hub")


def _joined_up(docs: DataFrame, length: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes of equal sets, components of linked classes by their carrier's row)."""
    profile = profiles(docs, length, percent, id_col, text_col)
    # a class is named by a row that carries its shingles; ids of documents only name what is found
    carrier = F.min(F.when(F.col("tokens").isNotNull(), F.col("row")))
    classes = written(profile.where("n > 0").groupBy("hi", "lo").agg(carrier.alias("rep"), F.min("doc").alias("least")), "classes")
    sets = written(
        profile.select("row", "n", "tokens").join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("doc"), "n", "tokens"),
        "sets",
    )
    posts = postings(sets, percent)
    comps = written(posts.select("doc").distinct().withColumn("comp", F.col("doc")), "comps")

    by_size = Window.partitionBy("token").orderBy("n", "doc")
    near = posts.select(
        F.col("doc").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.lag("doc").over(by_size).alias("a"),
        F.lag("n").over(by_size).alias("n"), F.lag("i").over(by_size).alias("i"),
    ).where(F.col("a").isNotNull() & _fits(percent))
    hubs = posts.groupBy("token").agg(F.min(_hub()).alias("hub"))
    comps = _merged(comps, links(near.select("a", "b").union(_with_hub(posts, hubs, percent)).distinct(), sets, percent))

    outside, inside, hubs = _mixed(posts, comps)
    comps = _merged(comps, links(_with_hub(outside, hubs, percent), sets, percent))

    outside, inside, _ = _mixed(posts, comps)
    pairs = (
        outside.select("token", F.col("doc").alias("a"), "n", "i", F.col("comp").alias("ca"))
        .join(inside.select("token", F.col("doc").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("cb"), "main"), "token")
        .where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & _fits(percent))
    )
    return profile, classes, _merged(comps, links(pairs.select("a", "b").distinct(), sets, percent))


def similar(
    docs: DataFrame, length: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    profile, classes, comps = _joined_up(docs, length, percent, id_col, text_col)
    linked = comps.select(F.col("doc").alias("rep"), "comp").join(classes.select("rep", "least"), "rep")
    names = linked.groupBy("comp").agg(F.min("least").alias("_name"))
    named = linked.join(names, "comp").select("rep", "_name")
    by_class = classes.join(named, "rep", "left").select("hi", "lo", F.coalesce("_name", "least").alias("_name"))
    whole = profile.select("doc", "n", "hi", "lo").join(by_class, ["hi", "lo"], "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("_name"))
    real = lambda c: F.when(c != _NO_ID, c)
    return whole.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"))


def one_of_each(
    docs: DataFrame, length: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Of every component one row of ``docs``, with all its columns: the one with the least id, null last.

    Rows without words are their own components, so all of them stay. Of rows with one id the text
    with the least checksum stays, and of equal texts the row that is least by all its columns (any one
    where a column has no order).
    """
    profile, classes, comps = _joined_up(docs, length, percent, id_col, text_col)
    by_class = classes.join(comps.select(F.col("doc").alias("rep"), "comp"), "rep", "left")
    group = F.when(F.col("comp").isNull(), F.struct("hi", "lo"))
    rows = profile.select("doc", "mark", "n", "hi", "lo")
    first = (
        rows.join(by_class.select("hi", "lo", "comp"), ["hi", "lo"])
        .groupBy("comp", group.alias("own")).agg(F.min(F.struct("doc", "mark")).alias("_first"))
        .select("_first.doc", "_first.mark")
    )
    counts = rows.where("n > 0").groupBy("doc", "mark").agg((F.count(F.lit(1)) > 1).alias("several"))
    empty = rows.where("n = 0").select("doc", "mark").distinct().withColumn("several", F.lit(False))
    kept = written(first.join(counts, ["doc", "mark"]).select("doc", "mark", "several").unionByName(empty), "kept-rows")

    inner = {name: f"d{k}" for k, name in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    named = plain.select("*", *_doc_and_mark(plain[inner[id_col]], plain[inner[text_col]])).join(kept, ["doc", "mark"])
    columns = list(inner.values())
    once = named.where(~F.col("several")).select(*columns)
    if not kept.where("several").isEmpty():
        row = F.struct(*columns)
        unordered = any(isinstance(f.dataType, (MapType, VariantType)) for f in docs.schema)
        least = (F.first(row) if unordered else F.min(row)).alias("_row")
        again = named.where("several").groupBy("doc", "mark").agg(least)
        once = once.unionByName(again.select(*[F.col("_row")[c].alias(c) for c in columns]))
    return once.toDF(*docs.columns)

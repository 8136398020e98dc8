"""The pipeline against plain answers stage by stage, each on what the stage before kept."""

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bistrolytics.llm import quality
from bistrolytics.llm.token_counts import rank_encoding

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    home, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"file://{home}/{name}")
        out.append(spark.read.parquet(f"file://{home}/{name}"))
    return out


def test_columns_stay(staged):
    assert all(df.columns == staged[0].columns for df in staged[:-1])
    assert 0 < staged[-1].count() < staged[0].count()


def test_quality_stage(spark, staged):
    docs, kept, labels = staged[0], staged[1], spark.read.parquet(f"{SF}/labels.parquet")
    wanted = quality.score(docs, quality.train(docs, labels)).where("kept").join(docs, "doc_id").select(docs.columns)
    assert plain(kept) == plain(wanted)
    good = labels.where("quality = 1").select("doc_id").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_near_duplicate_stage(staged):
    rows = {r["doc_id"]: tuple(r) for r in staged[1].collect()}
    first = {c for _, _, c in brute.components([(r[0], r[1]) for r in rows.values()])}
    assert plain(staged[2]) == sorted((rows[i] for i in first), key=str)


def test_substring_stage(staged):
    before = {r["doc_id"]: r for r in staged[2].collect()}
    after = {r["doc_id"]: r for r in staged[3].collect()}
    assert set(before) == set(after)
    for doc_id, n_words, gone, digest in brute.repeats([(i, r["text"]) for i, r in before.items()]):
        text = after[doc_id]["text"]
        assert brute.sha(" ".join(brute.WORD.findall(text))) == digest
        assert text == before[doc_id]["text"] or gone
        assert after[doc_id]["n_chars"] == (len(text) if gone else before[doc_id]["n_chars"])


def test_decontamination_stage(spark, staged):
    rows = {r["doc_id"]: tuple(r) for r in staged[3].collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [w[0] for w in brute.leaks([(i, r[1]) for i, r in rows.items()], items) if not w[5]]
    assert plain(staged[4]) == sorted((rows[i] for i in clean), key=str)


def test_token_stage(staged):
    encoding = rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [(r["doc_id"], r["text"]) for r in staged[4].collect()]
    assert plain(staged[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(brute.bpe_rows(texts, encoding), key=str)
    assert {r["doc_id"]: r["ids"] for r in staged[5].collect()} == {i: encoding.encode_ordinary(t) for i, t in texts}


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_with_odd_rows(spark, tmp_path):
    good = "the of and to in that is was for with on as by at this " * 3
    rows = [(None, good, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (2, good, "en", "s", 5), (2, good, "en", "s", 5), (3, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for at, df in enumerate((docs, docs.where("false"))):
            out = f"file://{tmp_path}/{name}-{at}"
            stage(spark, df, SF).write.parquet(out)
            made = spark.read.parquet(out)
            assert k == 4 or made.columns == docs.columns
            assert made.count() == 0 if at else made.count() <= len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    # of four copies of one text the row with an id stays, once; rows without words stay
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]


def test_near_duplicates_of_rows_that_share_an_id_or_have_none(spark):
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    near = text + " end"
    rows = [(None, text, "b"), (None, text, "a"), (2, text, "d"), (2, text, "c"), (7, near, "e"), (7, other, "f"), (None, other, "g"), (8, None, "h"), (8, None, "i"), (None, "lone words", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("mark", F.lit("x")).withColumn("several", F.lit(True))
    for parts in (1, 4):
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SF)
        assert kept.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["doc"]) for r in kept.collect()) == [("2", "c"), ("7", "f"), ("8", "h"), ("8", "i"), ("None", "k")]
    tagged = docs.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))  # a column without an order
    assert corpus_pipeline.near_duplicates(spark, tagged, SF).count() == 5


def test_stages_carry_columns_with_clashing_names(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage, "en", "s", 5), (2, "x " + passage, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept_text", "n_removed", "n_words", "_y", "_id", "_join", "_0", "score", "d0", "n_hit")
    clash = docs.select("*", *[F.lit("FOREIGN").alias(c) for c in names])
    made = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, clash, SF).collect()}
    assert made[1]["text"] == passage and made[2]["text"] == "x" and made[2]["n_chars"] == 1
    assert {made[2][c] for c in names} == {"FOREIGN"}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns
    assert corpus_pipeline.byte_level_bpe(spark, clash, SF).count() == 2


def test_workers_give_memory_back_between_batches(monkeypatch):
    """A worker of substring_dedup kept the arrays of all slices, on top of what the stages before it had left."""
    import pyarrow as pa

    from bistrolytics.llm import repeats, texts

    class Task:
        def mapInArrow(self, run, schema):
            return run

    given = []
    monkeypatch.setattr(texts, "BATCH_BYTES", 1000)
    monkeypatch.setattr(texts, "_give_back", lambda: given.append(1))
    text = " ".join(f"w{k}" for k in range(300))
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([text])], names=["doc", "_text"]) for k in range(5)]
    found = list(repeats._stretches(Task(), 20)(iter(batches)))
    assert sum(b.num_rows for b in found) > 0 and len(given) >= 5


def test_batches_of_texts_are_small(spark):
    """Two Python steps of byte_level_bpe per task held batches of 8 MB on both their sides."""
    import pyarrow as pa

    from bistrolytics.llm import texts

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        texts.bounded_batches(spark)
        docs = spark.range(24, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 100_000).alias("text"))

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])

        found = docs.mapInArrow(sizes, "rows long, size long").collect()
    finally:
        spark.conf.set(key, old)
    assert sum(r["rows"] for r in found) == 24 and max(r["size"] for r in found) < 3 << 20

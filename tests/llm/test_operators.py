"""The ten operators against plain answers, on texts with every odd case."""

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
import brute
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bistrolytics.llm import (
    byte_bpe, decontaminate, language, licenses, quality, quality_rules, repeats, similar, token_counts, token_files,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def expected(found):
    return sorted((tuple(r) for r in found), key=str)


def scratch(tmp_path, name="ids"):
    return f"file://{tmp_path}/{name}"


def test_repeats(documents, corpus):
    found = repeats.digest(documents(corpus))
    assert rows(found) == expected(brute.repeats(corpus))


@pytest.mark.parametrize("window", [4, 7])
def test_repeats_of_other_lengths(documents, corpus, window):
    found = repeats.remove(documents(corpus), window, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(found) == expected(brute.repeats(corpus, window))


def test_repeats_keep_columns_and_rows(documents, corpus):
    docs = documents([*corpus, corpus[0], corpus[0], (None, corpus[0][1]), (None, None)])
    made = repeats.remove(docs)
    assert made.columns[: len(docs.columns)] == docs.columns
    by_id = [r for r in made.collect() if r["doc_id"] == corpus[0][0]]
    # the row without id comes first, so its text is the one that stays; equal rows get one result
    assert len(by_id) == 3 and len({r["n_removed"] for r in by_id}) == 1
    assert by_id[0]["n_removed"] == by_id[0]["n_words"] == 150
    assert [r["n_removed"] for r in made.where("doc_id is null and text is not null").collect()] == [0]
    assert made.where("text is null").first()["kept_text"] is None


def test_repeats_of_many_rows_without_id(spark, documents):
    """Rows without id are told apart by their texts, so none of them carries the spans of the others."""
    passage = " ".join(f"p{k}" for k in range(25))
    pairs = [(None, f"own{k} " * 3 + passage + f" tail{k}") for k in range(5000)] + [(None, pairs_text) for pairs_text in ("", None)]
    docs = documents(pairs)
    spans = repeats.gone_words(docs)
    per_key = spans.groupBy("doc", F.shiftright("at", 36)).count().agg(F.max("count")).first()[0]
    assert per_key <= 20
    made = repeats.remove(docs).select("n_words", "n_removed").collect()
    assert len(made) == 5002 and sorted(r["n_removed"] for r in made) == [0, 0, 0] + [25] * 4999


def test_similar(documents, corpus):
    found = similar.similar(documents(corpus))
    assert rows(found) == expected(brute.components(corpus))


def test_similar_with_hot_shingles_and_chains(documents):
    import random

    r = random.Random(3)
    line = " ".join(f"hot{k}" for k in range(20))
    pairs = []
    for k in range(160):  # one line in all, beyond the bound for common shingles
        pairs.append((k, line + " " + " ".join(f"v{k}_{j}" for j in range(r.choice([2, 3, 30])))))
    chain = [f"c{j}" for j in range(60)]
    for k in range(12):  # each links with the next only
        pairs.append((200 + k, " ".join(chain)))
        chain = chain[6:] + [f"d{k}_{j}" for j in range(6)]
    assert rows(similar.similar(documents(pairs))) == expected(brute.components(pairs))


def test_similar_with_nulls_and_repeated_rows(documents, corpus):
    found = rows(similar.similar(documents([corpus[0], corpus[0], (None, "a b c"), (7, None)])))
    assert found == expected([(corpus[0][0], 146, corpus[0][0])] * 2 + [(None, 1, None), (7, 0, 7)])


def test_similar_with_one_id_for_different_texts(documents):
    """Repeated and missing keys take no link from each other; a component has its least real id."""
    def near(name):
        words = [f"{name}{k}" for k in range(60)]
        return " ".join(words), " ".join([*words[:-1], "other"])

    (a, a2), (b, b2), (c, c2), (d, d2) = near("a"), near("b"), near("c"), near("d")
    pairs = [(7, a), (7, b), (3, a2), (9, b2), (None, c), (None, d), (5, c2), (None, d2), (None, "  ")]
    found = rows(similar.similar(documents(pairs)))
    n = 56
    assert found == expected([(7, n, 3), (7, n, 7), (3, n, 3), (9, n, 7), (None, n, 5), (None, n, None), (5, n, 5), (None, n, None), (None, 0, None)])


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, ""), (4, "!!! ..."), (10, "x"), (11, "x x x x x x x x x x x")]


def test_decontaminate(spark, documents, corpus):
    passage = next(t for _, t in corpus if t and len(t.split()) == 60)
    items = [*ITEMS, (5, passage), (5, passage.upper()), (6, passage.replace(" ", ", ")), (None, "über naïve")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.matches(documents(corpus), tests))
    want = brute.leaks(corpus, [("" if i is None else i, t) for i, t in items])
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(found, *names) == expected(want)
    # several passes over the test side give the same hits
    passes = decontaminate.digest(decontaminate.matches(documents(corpus), tests, pass_words=5))
    assert rows(passes, *names) == expected(want)
    kept = decontaminate.clean(documents(corpus), tests)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(w[0] for w in want if not w[5])


def test_longest_match(spark, documents):
    text = " ".join(f"t{k}" for k in range(40))
    tests = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = documents([(1, "a b " + " ".join(text.split()[5:32]) + " z"), (2, text + " " + text), (3, "t0 t1")])
    found = {r["doc_id"]: (r["longest"], [tuple(s) for s in r["spans"]]) for r in decontaminate.matches(docs, tests).collect()}
    assert found == {1: (27, [(2, 29)]), 2: (40, [(0, 80)]), 3: (0, [])}


def test_quality_rules(documents, corpus):
    found = quality_rules.score(documents(corpus))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(found, *names) == expected(brute.base_rules(corpus))


def test_compression_bands(documents):
    import random

    r = random.Random(1)
    noise = "".join(chr(r.randrange(0x4E00, 0x9FFF)) + (" " if k % 9 == 0 else "") for k in range(3000))
    prose = " ".join("".join(r.choice("aeiou" if j % 2 else "bcdfglmnprst") for j in range(r.choice([2, 4, 6]))) for _ in range(600))
    same = " ".join(f"{k % 3}abc{k % 2}" for k in range(900))
    found = {r["doc_id"]: r for r in quality_rules.score(documents([(1, noise), (2, prose), (3, same), (4, None)])).collect()}
    assert [found[k]["kept"] for k in (1, 2, 3, 4)] == [False, True, False, False]
    assert found[3]["whole_ratio"] < 0.1 < found[2]["whole_ratio"] < found[1]["whole_ratio"]


@pytest.mark.parametrize("n_prose", [0, 150])
@pytest.mark.parametrize("size", [160, 400, 900, 1500, 3000, 7000, 12000, 30000])
def test_compression_bands_of_every_length(documents, size, n_prose):
    """With fixed limits (few texts) and with limits of the table."""
    import random

    r = random.Random(size)
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["er", "th", "and", "in", "ing", "ent", "on", "re", "at", "is", "ly", "tion", "ha", "or", "ed", "nd", "the", "sh", "ble", "of"]

    def text(word):
        out = ""
        while len(out) < size:
            out += word() + " "
        return out[:size]

    prose = lambda: text(lambda: "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 3]))))
    drawn = lambda letters: text(lambda: "".join(r.choice(letters) for _ in range(r.randint(3, 7))))
    again = text(lambda: r.choice(["one", "two", "six", "ten", "red", "dog"][: 3 if size < 1000 else 6]))  # few words in any order: eight hardly come twice
    pairs = [(k, prose()) for k in range(2, 2 + n_prose)] + [(0, drawn(alnum)), (1, again)] + [(-1, drawn(low))] * (size >= 3000)
    judged = [x for x in quality_rules.score(documents(pairs)).collect() if not x["base_failed"]]
    found = {x["doc_id"]: x["kept"] for x in judged}
    assert not found.pop(0) and not found.pop(1) and not found.pop(-1, False)
    # ratios of very short texts scatter
    assert len(found) >= 0.7 * n_prose and sum(found.values()) >= (0.95 if size < 256 else 0.98) * len(found)


def test_bands_follow_the_table(documents):
    """Texts that repeat more than the others of their length are out, though no fixed limit would say so."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    pairs = [(k, " ".join(r.choice(words) for _ in range(900))) for k in range(150)]
    pairs += [(900, " ".join(r.choice(words[:120]) for _ in range(900)))]
    found = {x["doc_id"]: x for x in quality_rules.score(documents(pairs)).collect()}
    assert not found[900]["kept"] and not found[900]["base_failed"] and found[900]["whole_ratio"] > 0.15
    assert sum(x["kept"] for x in found.values()) >= 147


def test_token_counts(documents, corpus):
    counted = token_counts.lengths(documents([*corpus, corpus[0]]), RANKS, PATTERN)
    hist = token_counts.histogram(counted)
    encoding = token_counts.rank_encoding(RANKS, PATTERN)
    sizes = sorted(len(encoding.encode_ordinary(t or "")) for _, t in [*corpus, corpus[0]])

    def answers(limits):
        out = []
        for n in sorted(limits):
            up = [s for s in sizes if s <= n]
            out.append((n, sizes.count(n), len(up), len(sizes) - len(up), sum(up), sum(min(s, n) for s in sizes), sum(sizes), len(up) / len(sizes)))
        return expected(out)

    assert rows(token_counts.context_table(hist, block=16)) == answers(set(sizes))
    limits = (0, 1, 3, 100, 512, sizes[-1], 10**6)
    table = token_counts.context_table(hist, 16, limits)
    assert rows(table) == answers(set(sizes) | set(limits))
    for share in (0.0, 0.5, 1.0):
        assert token_counts.quantile(table, share).first()[0] == sizes[max(0, -(-int(share * 1000 * len(sizes)) // 1000) - 1)]
    asked = hist.sparkSession.createDataFrame([(n,) for n in (*limits, 100, None)], "n_tokens int")
    assert rows(token_counts.at_limits(hist, asked, 16)) == answers(set(limits))
    nothing = hist.where("false")
    assert token_counts.context_table(nothing, 16, limits).count() == 0 == token_counts.at_limits(nothing, asked).count()


def test_byte_bpe(documents, corpus):
    encoding = token_counts.rank_encoding(RANKS, PATTERN)
    odd = [(500, "\x85 \x1c　 é́ 'Ll 12345 " + "ab" * 400), (501, "日本語 🙂🙂  \n\n x"), (502, "aaaaaaaaaaaa ababababab")]
    pairs = [*corpus, *odd, (None, "hello  world"), (None, None)]
    want = brute.bpe_rows([("" if i is None else i, t) for i, t in sorted(pairs, key=str)] and [(i, t) for i, t in pairs if i is not None], encoding)
    docs = documents(pairs)
    found = byte_bpe.digest(docs, RANKS, PATTERN)
    assert rows(found.where("doc_id is not null")) == expected(want)
    encoded = byte_bpe.encode(docs, RANKS, PATTERN)
    texts = {(r["doc_id"], bytes(r["text"])) for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert texts == {(i, (t or "").encode()) for i, t in pairs}


def test_token_files(spark, documents, corpus, tmp_path):
    path = scratch(tmp_path)
    token_files.write_ids(documents(corpus), path, WORDS)
    found = token_files.positions(spark, path)
    assert rows(found) == expected(brute.token_rows(corpus, Tokenizer.from_file(WORDS)))
    one = token_files.read_ids(spark, path, [corpus[3][0]])
    assert [r["doc_id"] for r in one.collect()] == [corpus[3][0]]
    assert "EqualTo" in one._jdf.queryExecution().toString() or "In(doc_id" in one._jdf.queryExecution().toString()
    files = [pyarrow.orc.ORCFile(f.replace("file://", "")) for f in found.sparkSession.read.orc(path).inputFiles()]
    assert sum(f.nrows for f in files) == len(corpus) and all(f.nstripes >= 1 for f in files)


def test_token_files_with_null_ids(spark, documents, tmp_path):
    token_files.write_ids(documents([(2, "b"), (None, "a a"), (2, "a"), (1, None)]), scratch(tmp_path), WORDS)
    found = token_files.positions(spark, scratch(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in found] == [(None, 0, 3), (1, 3, 1), (2, 4, 2), (2, 6, 2)]


def test_encoder_equals_the_library(monkeypatch):
    import random

    r, parts = random.Random(5), ["a", "B", "é", "É", "é", "'s", "'S", "'", "...", ",", "…", "3", " ", "\n", " ", "Σ", "İ", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "\x01", "\x1c", "K", "-"]
    encoder, library = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    for text in texts:
        sizes, ids = encoder.ids(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)], repr(text)
    # the same in slices, with nulls and a memory that is full all the time
    for held in (0, token_files.CACHED_BYTES):
        monkeypatch.setattr(token_files, "CACHED_BYTES", held)
        for a in range(0, 1500, 100):
            some = [None, *texts[a : a + 100], None]
            sizes, ids = token_files.WordEncoder(WORDS).ids(pa.array(some)) if a % 500 else encoder.ids(pa.array(some))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_licenses(documents):
    mit = dict(licenses.RULES)["MIT"]
    full = [t for name, t in licenses.RULES if name == "MIT"][2]
    head, tail = full.split("conditions:")
    pairs = [
        (1, "Some words here.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "RELEASED under   the MIT licence. Released under the MIT License!"),
        (3, full.replace(" ", "  ").replace("  ", " ")),
        (4, tail + " " + head + "conditions:"),  # the right sentences in the wrong order
        (5, head + "conditions: One. Two. Three. " + tail),  # too far apart
        (6, head + "conditions: One. " + tail + " Licensed under CC BY-NC 4.0."),
        (7, None), (8, ""), (9, "... !! \n\n"), (None, "Released under the MIT License."),
    ]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents([*pairs, pairs[0]])).collect()}
    assert mit and found == {
        1: ["Apache-2.0"], 2: ["MIT"], 3: ["MIT"], 4: [], 5: [], 6: ["CC-BY-NC-4.0", "MIT"], 7: [], 8: [], 9: [], None: ["MIT"],
    }


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
ISC_TEXT = """Copyright 2020 Somebody
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


@pytest.mark.parametrize("start", ["", "# ", "// ", " * ", "; ", "-- ", "dnl ", "%% ", "> "])
def test_wrapped_licenses(documents, start):
    texts = [MIT_TEXT, ISC_TEXT, BSD_TEXT, APACHE_TEXT, GPL_TEXT]
    marked = ["\n".join((start + line).rstrip() for line in t.split("\n")) for t in texts]
    marked += [t.replace("\n", "\r\n") for t in marked]
    # no blank line before, one notice per line, and what must stay apart
    marked += ["Notes on this file\n" + t for t in marked[:5]]
    marked += ["a list\nReleased under the MIT License\nof things\nLicensed under CC BY 4.0\nend", "Licensed under\n\nCC BY 4.0."]
    marked += [MIT_TEXT.replace("The above", "One more sentence\nthat is wrapped\ntwice.\nThe above")]
    found = {x["doc_id"]: x["licenses"] for x in licenses.scan(documents(list(enumerate(marked)))).collect()}
    wanted = [["MIT"], ["ISC"], ["BSD-2-Clause", "BSD-3-Clause"], ["Apache-2.0"], ["GPL-3.0"]]
    assert [found[k] for k in range(len(marked))] == [*wanted, *wanted, *wanted, ["CC-BY-4.0", "MIT"], [], ["MIT"]]


def brute_licenses(text, gap=1):
    import re

    table = licenses.sentence_table()
    cut = [re.sub(licenses.NOISE, " ", s.lower()).strip() for s in re.split(licenses.SENTENCE_END, text or "")]
    seen = [(k, table[s]) for k, s in enumerate(s for s in cut if s) if s in table]
    out = set()
    for name, rule in licenses.RULES:
        want = [table[s] for s in licenses.sentences(rule)]
        for a in range(len(seen) - len(want) + 1):
            part = seen[a : a + len(want)]
            if [i for _, i in part] == want and all(y - x <= gap + 1 for (x, _), (y, _) in zip(part, part[1:])):
                out.add(name)
    return sorted(out)


def test_licenses_of_mixed_sentences(documents):
    import random

    r = random.Random(2)
    pool = [s.strip() + "." for _, rule in licenses.RULES for s in __import__("re").split(licenses.SENTENCE_END, rule) if s.strip()]
    pairs = [(k, " ".join(r.choice([*pool[:14], "Filler words.", "And more!"]) for _ in range(r.randint(0, 12)))) for k in range(200)]
    pairs += [(300 + k, " ".join(rule.replace(". ", r.choice([".\n", ". Word. "])) for _, rule in r.sample(licenses.RULES, 3))) for k in range(60)]
    found = {x["doc_id"]: x["licenses"] for x in licenses.scan(documents(pairs)).collect()}
    assert found == {k: brute_licenses(t) for k, t in pairs}


LANGS = {
    "en": "the of and to in that is was for with on as by at this".split(),
    "fr": "le la les de des et un une que qui dans pour sur par avec".split(),
    "de": "der die das und ist nicht ein eine mit von zu auf für den".split(),
}


def spoken(r, lang, n):
    return " ".join(r.choice(LANGS[lang]) for _ in range(n))


def test_language(spark):
    import random

    r = random.Random(4)
    data = [(k, spoken(r, lang := r.choice(list(LANGS)), r.choice([15, 80, 400])), lang) for k in range(240)]
    data += [(900, None, "en"), (901, "", None), (902, "123 !!", "fr"), (None, spoken(r, "de", 60), None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learned = language.learn(docs.where("doc_id % 4 <> 0"))
    found = {x["doc_id"]: x for x in language.predict(docs, learned).collect()}
    held = [(k, lang) for k, _, lang in data[:240] if k % 4 == 0]
    assert sum(found[k]["lang_pred"] == lang for k, lang in held) >= 0.95 * len(held)
    assert {found[k]["lang_pred"] for k in (900, 901, 902)} == {"und"} and found[None]["lang_pred"] == "de"
    assert all(0 <= x["score"] <= 1 for x in found.values())
    # nothing to learn from
    assert {x["lang_pred"] for x in language.predict(docs, language.learn(docs.where("false"))).collect()} == {"und"}


def test_quality(spark):
    import random

    r = random.Random(8)
    data, labels = [], []
    for k in range(600):
        good = k % 3 != 0
        text = spoken(r, "en", 80)
        text = text if good else " ".join(w.upper() + "!!" for w in text.split())
        data.append((k, text, "en", "blog" if good == (r.random() < 0.8) else "spam", len(text)))
        if k % 2:
            labels.append((k, int(good), 0))
    data += [(900, None, None, None, None), (901, " ", "en", "blog", 1), (None, data[1][1], None, "blog", None)]
    labels += [(3000, 1, 0), (None, 0, 0), (2, None, 0), labels[0]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, known)
    found = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    assert all(found[k]["kept"] == (k % 3 != 0) for k in range(600))
    assert not found[900]["kept"] and not found[901]["kept"] and found[None]["kept"]
    blog = {k for k in range(600) if data[k][3] == "blog"}
    assert sum(found[k]["p_meta"] for k in blog) / len(blog) > 0.7  # the other view learned, too
    assert quality.train(docs, known.where("quality = 1")) is None
    assert quality.keep_good(docs, known.where("false")).count() == 601


def test_empty_tables(spark, documents, tmp_path):
    docs = documents([])
    tests = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        repeats.digest(docs), similar.similar(docs), decontaminate.digest(decontaminate.matches(docs, tests)),
        quality_rules.score(docs), token_counts.context_table(token_counts.histogram(token_counts.lengths(docs, RANKS, PATTERN))),
        byte_bpe.digest(docs, RANKS, PATTERN), licenses.scan(docs), language.predict(docs, {}), quality.keep_good(docs, labels),
    ):
        assert df.count() == 0
    token_files.write_ids(docs, scratch(tmp_path), WORDS)
    assert token_files.positions(spark, scratch(tmp_path)).count() == 0
    some = documents([(1, "a b")])
    assert [r["contaminated"] for r in decontaminate.digest(decontaminate.matches(some, tests)).collect()] == [False]


def plain_rounds(text, meta, label, pool_text, pool_meta, rounds=3, sure=0.97, steps=8):
    """Weights of both views, with the unlabelled rows that each is taught stacked under its labelled ones."""
    held = np.arange(len(label)) % 3 == 2
    sides, pools, y = [text, meta], [pool_text, pool_meta], label[~held]
    models = [quality.Logistic.fit(side[~held], y) for side in sides]
    for _ in range(rounds):
        told = []
        for model, side, pool in zip(models, sides, pools):
            p = 1 / (1 + np.exp(-quality.Logistic.fit(model.logit(side[held])[:, None], label[held]).logit(model.logit(pool)[:, None])))
            told.append(((p >= sure) | (p <= 1 - sure), (p >= 0.5).astype(float)))
        stacked = []
        for k in (0, 1):
            rows, labels = told[1 - k]
            stacked.append((np.vstack([sides[k][~held], pools[k][rows]]), np.concatenate([y, labels[rows]])))
        for _ in range(steps):
            moves = []
            for k, (x, target) in enumerate(stacked):
                z = np.hstack([np.clip((x - models[k].mean) / models[k].scale, -6, 6), np.ones((len(x), 1))])
                p = 1 / (1 + np.exp(-np.clip(z @ models[k].weights, -40, 40)))
                penalty = np.diag([*[1.0] * (z.shape[1] - 1), 1e-6])
                move = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + penalty, z.T @ (target - p) - penalty @ models[k].weights)
                models[k] = quality.Logistic(models[k].mean, models[k].scale, models[k].weights + move)
                moves.append(np.abs(move).max())
            if max(moves) < 1e-3:
                break
    return [model.weights for model in models], [rows.sum() for rows, _ in told]


def test_cotraining_over_parts_equals_stacked_rows(spark):
    """Sums of steps, added up by Spark over parts, give the models of all rows in one place."""
    r = np.random.default_rng(4)
    label = (r.random(300) < 0.5).astype(float)
    unknown = (r.random(900) < 0.5).astype(float)

    def side(y, width, signal):
        return (r.normal(size=(len(y), width)) + signal * np.outer(2 * y - 1, np.ones(width))).astype(np.float32).astype(float)

    text, meta, pool_text, pool_meta = side(label, 6, 0.9), side(label, 4, 0.7), side(unknown, 6, 0.9), side(unknown, 4, 0.7)
    rows = spark.createDataFrame([(t, m) for t, m in zip(pool_text.tolist(), pool_meta.tolist())], "text array<float>, meta array<float>")
    model = quality.cotrain(text, meta, label, quality._pool(rows.repartition(5)))
    weights, taught = plain_rounds(text, meta, label, pool_text, pool_meta)
    assert min(taught) > 200
    assert np.allclose(model.text.weights, weights[0], atol=1e-8) and np.allclose(model.meta.weights, weights[1], atol=1e-8)
    alone = quality.cotrain(text, meta, label, quality._pool(rows.where("false")))
    assert not np.allclose(alone.text.weights, weights[0], atol=1e-3)


def test_quality_with_clashing_columns_and_repeated_ids(spark):
    rows = [(k, f"good words number {k} " * 30 if k % 2 else "zz 9 ## " * 30, "en", "s", 500) for k in range(60)]
    rows += [rows[3], rows[4], (None, rows[5][1], None, None, None), (5, None, "en", "s", None), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (None, 1), (999, 0), (4, None)], "doc_id long, quality int")
    plain = {(r["doc_id"], r["score"]) for r in quality.score(docs, quality.train(docs, labels)).collect()}
    for name in ("_y", "_id", "_known", "id", "meta", "_shape", "_0", "_text", "p_text", "kept"):
        docs, labels = docs.withColumn(name, F.lit("x")), labels.withColumn(name, F.lit("x"))
    model = quality.train(docs, labels)
    assert {(r["doc_id"], r["score"]) for r in quality.score(docs, model).select("doc_id", "score").collect()} == plain
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_dictionaries_hold_pieces_of_every_sampled_text(spark):
    """Not only openings: each text is there with places from all of it, and equal texts count once."""
    rows = [(k, f"opening words {'abcdefghij'[k]}start " + "filler " * 900 + f" {'abcdefghij'[k]}ending", "en") for k in range(10)]
    rows += [(50 + k, rows[0][1], "en") for k in range(30)] + [(99, "zz yy", "xx"), (None, "null id text", "en"), (98, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language.learn(docs)
    assert list(made) == ["en", "xx"] and made["xx"] == b"zz yy"
    assert all(f"{c}start".encode() in made["en"] and f"{c}ending".encode() in made["en"] for c in "abcdefghij")
    assert made["en"].count(b"astart") == 1 and b"null id text" in made["en"]
    assert language.learn(docs.repartition(5)) == made
    assert len(language.learn(docs, dictionary_bytes=300)["en"]) == 300


def test_language_against_the_compressor(spark, documents, corpus):
    """Predictions are the smallest totals of whole texts over the dictionaries."""
    import zstandard

    dictionaries = {"aa": b"the cat sat on the mat and the dog ran " * 9, "bb": b"der hund und die katze sind im haus " * 9}
    pairs = [*corpus, (900, "The dog, and the cat!" * 700), (901, "Die Katze und der Hund " * 40), (902, "12 34"), (None, "the mat")]
    found = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.predict(documents(pairs), dictionaries).collect()}
    want = set()
    for doc_id, text in pairs:
        data = b" ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).encode().split(b" ")).split()
        data = b" ".join(data)
        totals = []
        for k, (name, raw) in enumerate(dictionaries.items()):
            kept = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=6)
            packer = zstandard.ZstdCompressor(dict_data=kept, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
            totals.append((sum(len(packer.compress(data[a : a + 4096])) for a in range(0, len(data), 4096)), k, name))
        low, high = sorted(totals)
        want.add((doc_id, low[2] if data else "und", round((high[0] - low[0]) / high[0], 9) if data else 0.0))
    assert found == want

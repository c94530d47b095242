"""Corpus operators against brute force, round trips and held-out accuracy; edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import SF_DIR, assert_same, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from desense.llm import ann, bpe, components, jaccard_join, language_id, licence_scan, packing, quality, queries, simple8b, token_files, token_rollup, url_filter
from desense.llm.common import written
from desense.llm.hilbert import hilbert_keys

DOCS = "doc_id long, text string, lang string, source string, score double"
ODD = [
    (1, None, "en", "s", 1.0), (2, "", None, "s", 1.0), (3, " \n\t ", "en", None, 1.0), (4, "!?", "en", "s", 1.0),
    (5, "one two three four five", "en", "s", 1.0), (5, "one two three four five", "en", "s", 1.0), (6, "Word " * 30000, "en", "s", 1.0), (7, "ONE two three four five", None, None, 1.0),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLE[name])


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


# --- language ID -----------------------------------------------------------------------


def test_language_accuracy_held_out(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.rejected.mean() < 0.02


def test_language_query_brute_force(spark):
    """The same sizes by plain zstandard calls."""
    import zstandard

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_id.fit_language_model(docs.where(~language_id.in_holdout(F.col("doc_id"))).select("text", "lang"))
    rows = docs.toPandas()
    known = {lang: sorted({t for t, d, x in zip(rows.text, rows.doc_id, rows.lang, strict=True) if x == lang and t is not None and zlib.crc32(str(d).encode()) % 5}) for lang in model.dictionaries}
    assert all(len(known[lang]) <= 64 and len(model.dictionaries[lang]) == len(" ".join(map(language_id.letters_only, known[lang])).encode()) for lang in known if len(known[lang]) <= 64)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        raw, sizes = language_id.letters_only(text or "").encode(), {}
        if not raw.strip():
            assert got[doc_id].lang_pred == "und"
            continue
        for lang, content in model.dictionaries.items():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048))
        first, second = sorted(sizes.values())[:2]
        assert sizes[got[doc_id].lang_pred] == first and got[doc_id].score == pytest.approx(1 - first / second)


def test_kept_columns_may_not_clash_with_results(spark):
    model = language_id.fit_language_model(none(spark))
    for refused in (lambda: language_id.predict_language(odd(spark), model, ["score"]), lambda: quality.quality_rules(none(spark), ("doc_id", "n_words")), lambda: bpe.encode_decode(none(spark), "", ["n_tokens"])):
        with pytest.raises(ValueError, match="names of results"):
            refused()


def test_language_odd_rows(spark):
    model = language_id.fit_language_model(spark.createDataFrame([("abc def", "x"), ("uvw xyz", "y")], "text string, lang string"))
    got = {r.doc_id: r for r in language_id.predict_language(odd(spark), model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[6].lang_pred in "xy"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit_language_model(none(spark))
    assert {r.lang_pred for r in language_id.predict_language(odd(spark), empty, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict_language(none(spark), model, ["doc_id", "score"], accepted_only=True).columns == ["doc_id", "score"]


# --- URL filter ------------------------------------------------------------------------


def test_bloom_false_positives_are_removed(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.org/a/{i}") for i in range(400)] + [(900, None), (901, "no url"), (902, "HTTP://H1.ORG?x")], "page_id long, url string")
    listed = pages.where("page_id % 7 = 0").select("url")
    got = url_filter.url_filter(pages, listed, [], bits_per_key=1).toPandas().set_index("page_id")
    assert all(got.listed[i] == (i % 7 == 0) for i in range(400))
    assert got.host[900] == "" and got.path[901] == "" and got.host[902] == "h1.org" and got.verdict[900] == "allow"
    none_listed = url_filter.url_filter(pages, listed.limit(0), queries.URL_RULES)
    assert none_listed.where("verdict = 'block'").count() == 0


# --- quality ---------------------------------------------------------------------------


def test_repeated_words_brute_force(spark):
    texts = ["a b c d e f g h a b c d e f g h", "x " * 40, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1", "a b c"]
    got = quality.text_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for r in got:
        w = texts[r.doc_id].split()
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert r.n_repeat_words == len(hit)


def test_quality_odd_rows(spark):
    got = quality.quality_rules(odd(spark)).toPandas()
    assert len(got) == len(ODD) and not got[got.doc_id < 5].kept.any()
    assert quality.quality_rules(none(spark)).count() == 0
    assert quality.passing(odd(spark)).columns == odd(spark).columns


def test_outliers_go_and_the_rest_stays(spark):
    rnd = np.random.default_rng(1)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), rnd.integers(3, 8)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s", 1.0) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###$$$" for _ in range(60)), "en", "s", 1.0) for i in range(20)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS)).toPandas()
    assert got[got.doc_id < 1000].kept.mean() > 0.99 and not got[got.doc_id >= 1000].kept.any()


@pytest.mark.parametrize("rows", [5, 50, 500])
def test_groups_of_any_size_are_judged_by_their_own_estimate(spark, rows):
    """A source with many symbols in every text: its own texts stay, a like one elsewhere
    goes, and its outliers go too; a group of few rows leans on its language."""
    rnd = np.random.default_rng(rows)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), rnd.integers(3, 8)))
    text = lambda tail, n=60: " ".join(word() + (tail if i % 2 else "") for i in range(n))
    docs = [(i, text(""), "en", "plain", 1.0) for i in range(300)]
    docs += [(1000 + i, text("$"), "en", "marked", 1.0) for i in range(rows)]
    docs += [(5000, text("$"), "en", "plain", 1.0), (5001, text("#$%&" * 4), "en", "marked", 1.0), (5002, text("#$%&" * 4), "xx", None, 1.0)]
    got = quality.quality_rules(spark.createDataFrame(docs, DOCS)).toPandas().set_index("doc_id")
    assert got.d2.notna().all() and not got.kept[5001]
    own, other = got.d2.loc[1000 : 1000 + rows - 1].median(), got.d2[5000]
    assert own < other
    if rows == 500:
        assert got.kept.loc[1000:1499].mean() > 0.99 and other > 3 * own


def test_least_determinant_wins(spark):
    """A fifth of the rows lies in a tight cloud far off: some start would keep it."""
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 300, (400, 4)), rnd.normal(4000, 20, (100, 4))]).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, x0 long, x1 long, x2 long, x3 long")
    best = quality.mcd_estimates(rows).first()
    assert all(abs(best[f"m{i}"]) < 200 for i in range(4))
    ends = quality._starts(rows)
    for _ in range(quality.STEPS):
        ends = quality._concentrated(rows, ends)
    dets = [r.l00 * r.l11 * r.l22 * r.l33 for r in ends.collect()]
    chosen = quality._factored(spark.createDataFrame([best])).first()
    assert len(dets) == 3 and chosen.l00 * chosen.l11 * chosen.l22 * chosen.l33 == pytest.approx(min(dets))


# --- packing ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_best_fit_brute_force(sizes):
    sizes, lengths = sorted(sizes, reverse=True), (20, 50, 100)
    bins, room, left, want = [], [], sum(sizes), []
    for s in sizes:
        fits = [(room[b], b) for b in range(len(bins)) if room[b] >= s]
        if fits:
            least = min(fits)[0]
            b = [b for r, b in fits if r == least][-1]
        else:
            n = min((n for n in lengths if n >= s), key=lambda n: (packing.sequence_cost(n) / min(n, left), n))
            b = len(bins)
            bins.append(0)
            room.append(n)
        bins[b] += s
        room[b] -= s
        left -= s
        want.append(room[b])
    got, capacity, held = packing.best_fit(sizes, lengths)
    assert sum(held) == sum(sizes) and len(held) == len(bins) and sorted(held) == sorted(bins)
    assert all(h <= c and (c == 20 or h > lengths[lengths.index(c) - 1]) for h, c in zip(held, capacity, strict=True))
    assert all(sum(s for s, b in zip(sizes, got, strict=True) if b == i) == h for i, h in enumerate(held))
    # bins are opened with the same lengths, and each piece leaves the same room
    full, after = {}, []
    for b, s, r in zip(got, sizes, want, strict=True):
        full.setdefault(b, r + s)
        full[b] -= s
        after.append(full[b])
    assert after == want


def test_pack_whole(spark):
    runs = spark.createDataFrame([(1, 20000), (2, 5), (2, 5), (3, None), (4, 0), (None, 7)] + [(i, 300) for i in range(10, 60)], "doc_id long, n_tokens long")
    got = packing.pack(runs, shard_pieces=20).toPandas()
    assert got[got.bin.notna()].piece_tokens.sum() == 20010 + 50 * 300
    held = got[got.bin.notna()].groupby(["shard", "bin"]).agg(t=("piece_tokens", "sum"), n=("bin_tokens", "first"), c=("bin_length", "first"))
    assert (held.t == held.n).all() and (held.t <= held.c).all() and got[got.bin.isna()].shape[0] == 3
    assert packing.pack(runs.limit(0)).count() == 0


def test_pack_rows_of_one_id(spark):
    runs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(100).cast("long").alias("n_tokens"), F.lit("x").alias("bin"))
    shards = packing.pack(runs, shard_pieces=500).groupBy("shard").count().toPandas()
    assert len(shards) == 10 and shards["count"].max() < 1000


def test_pack_query_brute_force(spark):
    """The whole query: counts are those of the texts, and every step is a best fit."""
    got = queries.op4_best_fit_packing(spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    check_packing(got, token_sizes(zip(docs.doc_id, docs.text, strict=True)))


# --- BPE -------------------------------------------------------------------------------

TEXTS = [None, "", "Hello <|endoftext|>x<|startoftext|>", "it's I'VE  ok 123 é İstanbul ΣΑΣ ﬁ 漢字かな 😀 \x85 z", "don't DON'T we'LL", "a\x00b\x1fc", "word " * 3000]


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.encode_decode(docs, open(path).read(), ["doc_id"]).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_bpe_any_text(texts):
    codec = bpe._codec(open(public_tokenizers.path("word_bpe_49k.json")).read())
    want = [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert [[int(i) for i in ids.split()] for _, ids, _ in codec.batch(texts)] == want


# --- nearest neighbours ----------------------------------------------------------------


def test_hilbert_steps():
    grid = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(4)])
    path = grid[np.argsort(hilbert_keys(grid, 2))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_nearest_neighbours(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids, hits = np.array([list(v) for v in rows.embedding]), rows.vec_id.to_numpy(), []
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(part.vec_id)) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# --- licences --------------------------------------------------------------------------


def test_licence_places(spark):
    texts = [None, "", "Released under the MIT License.", "x under the mit license under the MIT license", "This work is licensed under the GNU General Public License, version 3.", "the gnu and the license", "All rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan.scan_licences(docs).collect()}
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].n_words) == (2, 1, 5, 9)
    assert [got[i].labels for i in range(7)] == ["", "", "mit", "mit", "gpl-3", "", "all-rights-reserved"]
    assert got[0].n_words == 0 and got[2].base_labels == "mit" and all(0 <= r.score <= 1 for r in got.values())


MIT_TEXT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."


def licence_labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(licence_scan.scan_licences(docs).collect())]


def test_licences_of_one_file_do_not_crowd_out_each_other(spark):
    notices = {label: text for label, text, _ in licence_scan.TEMPLATES}
    others = [n for n in notices if n != "mit"]
    got = licence_labels(spark, [f"{MIT_TEXT} {filler} {notices[n]}" for n in others for filler in ("", "word " * 40)] + [" word word word ".join(notices.values())] + ["nothing"] * 400)[:-400]
    assert got[:-1] == [",".join(sorted(["mit", n])) for n in others for _ in range(2)]
    assert got[-1] == ",".join(sorted(notices))


def test_whole_licences_and_their_like(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    whole = {label: text for label, text, _ in licence_scan.TEMPLATES if len(text) > 200}
    texts = [gpl.format(3), gpl.format(2), gpl.format(7), "Permission is hereby granted, free of charge, to the public to enter the park.", *whole.values()]
    got = licence_labels(spark, texts)
    assert got[:3] == ["gpl-3", "gpl-2", ""] and got[4:] == list(whole)


def licence_scores(spark, *texts):
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, "nothing here") for i in range(100))], "doc_id long, text string")
    return {r.doc_id: (r.labels, r.score) for r in licence_scan.scan_licences(docs).collect() if r.doc_id < 1000}


def test_a_few_words_of_a_licence_are_none(spark):
    got = licence_scores(
        spark, "he wrote: subject to mozilla public license discussions are boring",
        "Redistribution and use in source and binary forms is forbidden to everyone, whoever they are",
        "permission is hereby granted free of charge", "the gnu affero general public license", "alter it and redistribute it freely",
    )
    assert {labels for labels, _ in got.values()} == {""} and {score for _, score in got.values()} == {0.0}


def test_partial_reordered_and_interleaved_licences(spark):
    whole = {(label, len(text)): text for label, text, _ in licence_scan.TEMPLATES}
    mit, free, bsd = (max((t for (n, _), t in whole.items() if n == label), key=len).split() for label in ("mit", "unlicense", "bsd"))
    numbered = " ".join(f"{w} {i}" if i % 8 == 7 else w for i, w in enumerate(mit))
    lines = lambda ws: [" ".join(ws[i : i + 9]) for i in range(0, len(ws), 9)]
    both = " ".join(x for pair in zip(lines(free), lines(bsd), strict=False) for x in pair)
    at = int(len(free) * 0.7)
    got = licence_scores(spark, " ".join(mit), numbered, " ".join(free[:at]), " ".join(free[len(free) // 2 :] + free[: len(free) // 2]), both, " ".join(mit + ["word"] * 40 + bsd))
    assert got[0][0] == "mit" and got[0][1] > 0.999
    assert "mit" in got[1][0] and got[1][1] > 0.9
    assert 0.6 < got[2][1] < 0.85 and got[2][0] == "unlicense"
    assert got[3][1] < 0.6  # neither half is enough
    assert "unlicense" in got[4][0] and got[5][0] == "bsd,mit"
    # the less of a template a file holds, the lower its score
    scores = licence_scores(spark, *(" ".join(free[: int(len(free) * k / 10)]) for k in range(1, 11)))
    assert [scores[k][1] for k in range(10)] == sorted(scores[k][1] for k in range(10)) and scores[2][1] == 0 and scores[9][1] > 0.999


def test_licence_base_columns_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    got = {r.doc_id: r for r in queries.op7_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places, labels = [], set()
        for phrase, label in licence_scan.PHRASES.items():
            p = phrase.split()
            own = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""}


@pytest.mark.parametrize("name", ["op5_bpe", "op7_licence_scan", "op2_url_filters", "op10_token_files"])
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = [(None, "under the MIT license", "x"), (None, "under the MIT license", "x"), (3, "a b", "x"), (3, "a c", "x"), (3, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumn("start", F.lit("y"))
    got = licence_scan.scan_licences(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in got) == [(0, 4, "mit")] * 2 + [(3, 2, "")] * 3
    vocabulary = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    token_files.write_token_files(docs, vocabulary, str(tmp_path / "t"))
    files = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, None, 3, 3, 3] and files[-1].start == sum(r.n_tokens for r in files[:-1])
    assert bpe.encode_decode(docs, open(public_tokenizers.path("word_bpe_49k.json")).read(), ["doc_id", "start"]).count() == 5


@pytest.mark.parametrize("notice", ["All rights reserved.", "Licensed under CC BY SA 4.0.", licence_scan.TEMPLATES[9][1]])
def test_licence_of_a_hot_source_keeps_its_label(spark, notice):
    alone = licence_labels(spark, [notice])
    assert alone[0] and licence_labels(spark, [notice] * 60 + ["nothing"] * 90)[:60] == alone * 60


# --- near duplicates -------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in ids):
            break
    return {d: (len(sets[d]), root[d]) for d in ids}


def near_copies():
    rnd = np.random.default_rng(3)
    rows = []
    for g in range(6):
        base = [f"w{rnd.integers(0, 40)}" for _ in range(int(rnd.integers(2, 120)))]
        for _ in range(12):
            w = list(base)
            for _ in range(int(rnd.integers(0, 3))):
                w[int(rnd.integers(0, len(w)))] = f"z{rnd.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(500, None), (501, " "), (502, "one"), (503, "ONE"), (504, "a b c"), (505, "a b")]


def test_components_brute_force(spark):
    rows = near_copies()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)
    assert jaccard_join.jaccard_components(none(spark)).count() == 0
    assert sorted(r.component_id for r in jaccard_join.jaccard_components(odd(spark)).collect()) == [1, 2, 3, 4, 5, 5, 5, 6]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 1))
def test_a_pair_at_the_threshold_shares_a_signature(n, seed, share):
    rnd = np.random.default_rng(seed)
    pool = np.unique(rnd.integers(0, 2**64, 2 * n + 2, dtype=np.uint64))
    gone = int(share * n * 15 / 100)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: n - gone], pool[n : n + int((1 - share) * n * 15 / 100)]]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 85 * (len(a) + len(b) - both):
        assert set(jaccard_join.signatures(a)) & set(jaccard_join.signatures(b))


@pytest.mark.parametrize("at_once", [1, 50, 10**6])
@pytest.mark.parametrize("batch", [7, 10**6])
def test_possible_links_connect_what_is_linked(at_once, batch, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", at_once)
    sets, rnd = jaccard_join.shingle_sets(pa.array([t for _, t in near_copies()[:72]])), np.random.default_rng(2)
    rows = []
    for sig in range(5):
        two = sig % 2
        for k in rnd.permutation(72)[: int(rnd.integers(2, 60))].tolist():
            rows.append((sig, 0, two, int(rnd.integers(0, 2)) if two else 0, int(rnd.integers(0, 4)), k))
    rows.sort()
    cols = {c: pa.array(v, pa.int64()) for c, v in zip(("sig", "i", "j", "own", "root", "set_id"), zip(*rows, strict=True), strict=True)}
    cols |= {"n": pa.array([len(sets[r[-1]]) for r in rows], pa.int32()), "sketch": pa.array([jaccard_join.sketch(sets[r[-1]]) for r in rows])}
    edges = []
    for part in jaccard_join.whole_groups(pa.table(cols).to_batches(batch)):
        a, b = jaccard_join.possible_forest(part, 85, 100)
        edges += zip(a.tolist(), b.tolist(), strict=True)
    family = list(range(72))
    for a, b in edges * 72:
        family[a] = family[b] = min(family[a], family[b])
    together = 0
    for x in rows:
        for y in rows:
            if x[:3] == y[:3] and x[4] != y[4] and (x[1] == x[2] or x[3] != y[3]) and x[5] < y[5]:
                both = len(np.intersect1d(sets[x[5]], sets[y[5]]))
                if 100 * both >= 85 * (len(sets[x[5]]) + len(sets[y[5]]) - both):
                    together += 1
                    assert family[x[5]] == family[y[5]]
    assert together and len(edges) < len(rows)


@pytest.mark.parametrize("common", [1, 10**9])
def test_forest_connects_what_is_linked(common, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON_HOLDERS", common)
    sets = jaccard_join.shingle_sets(pa.array([t for _, t in near_copies()[:72]]))
    flat, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])
    a, b = jaccard_join.linked_forest(flat, ends, np.zeros(72, int), np.arange(72))
    root = list(range(72))
    for i, j in [*zip(a, b, strict=True)] * 72:
        root[i] = root[j] = min(root[i], root[j])
    want = brute_components(near_copies()[:72])
    assert root == [want[i][1] for i in range(72)]
    assert not len(jaccard_join.linked_forest(flat, ends, np.zeros(72, int), np.zeros(72, int))[0])


def test_components_of_a_large_family(spark, monkeypatch):
    """One family of many near copies in chains, with blocks made small."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard_join, "BUCKET_SETS", 16)
    rnd = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(int(rnd.integers(0, 9))):
            w[int(rnd.integers(0, 150))] = f"z{rnd.integers(0, 6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[60:110] + [f"o{i}x{j}" for j in range(100)])) for i in range(60)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_components_of_a_path_with_two_roots(spark):
    ids = [0, 2, 3, 5, 4, 1]
    got = components.connected_components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == dict.fromkeys(range(6), 0)


@pytest.mark.parametrize("path", [True, False])
def test_components_of_random_paths_and_trees(spark, path):
    rnd = np.random.default_rng(5)
    for _ in range(8):
        n = int(rnd.integers(6, 9))
        ids = rnd.permutation(n).tolist()
        edges = [(ids[i], ids[i - 1 if path else int(rnd.integers(0, i))]) for i in range(1, n)]
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in got.collect()} == dict.fromkeys(range(n), 0), edges


# --- token counts, token files ---------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.integers(0, 1), max_size=150), max_size=5))
def test_simple8b_round_trip(runs):
    runs = [np.array(r, dtype=np.uint64) for r in runs]
    words, offsets = simple8b.encode(np.concatenate([np.zeros(0, np.uint64), *runs]), np.array([len(r) for r in runs], dtype=np.int64))
    got = simple8b.decode(words, offsets, np.array([len(r) for r in runs], dtype=np.int64))
    assert np.array_equal(got, np.concatenate([np.zeros(0, np.uint64), *runs]))


WORD_PARTS = ["a", "s", "t", "re", "ll", "d", "'", " ", "\n", "\t", "\r", "1", "é", "ß", "Ü", "!", "-", "S", " '", "×", "÷", "²", "“", "\x85", "\x00", "漢", "<|", "x" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORD_PARTS), max_size=14).map("".join), max_size=5), st.booleans())
def test_byte_encoder_equals_library(texts, small):
    encoder = token_files._encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    if small:
        encoder._forget()
    ids, sizes = encoder.batch(pa.array(texts, pa.string()))
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == want


def test_token_files_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op10_token_files(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for doc_id, e in zip(docs.doc_id, library.encode_batch([t or "" for t in docs.text], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], dtype="<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    token_files.write_token_files(docs, open(path).read(), str(tmp_path / "t"), block_tokens=16)
    got, at = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}, 0
    for doc_id, text in sorted((9 - i, t) for i, t in enumerate(TEXTS)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_token_files(docs.limit(0), open(path).read(), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


# --- pipeline --------------------------------------------------------------------------


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_pipeline_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = written(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, sf_dir))
        assert kept.columns == docs.columns and kept.exceptAll(before).isEmpty(), name
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            kept_ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
            firsts = lambda words, over: sorted({c for _, c in brute.components(texts, words, over, 100).values()})
            assert kept_ids == firsts(5, 80)
            if sf_dir != SF_DIR:  # enough documents to tell the stage's parameters from others
                assert kept_ids != firsts(4, 85) and kept_ids != firsts(5, 85) and kept_ids != firsts(5, 75)
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    check_packing(got, token_sizes((r.doc_id, r.text) for r in kept.collect()))


def token_sizes(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in docs}


def check_packing(got, sizes):
    """Of a packing, by what best fit means: every piece goes to the open bin it leaves least
    room in, and a bin is opened only where no open one has the room."""
    assert got.groupby("doc_id").piece_tokens.sum().to_dict() == sizes
    for _, shard in got[got.bin.notna()].groupby("shard"):
        shard = shard.sort_values(["piece_tokens", "doc_id", "piece"], ascending=[False, True, True])
        held = shard.groupby("bin").piece_tokens.sum()
        final = shard.groupby("bin").bin_length.first()
        assert (shard.groupby("bin").bin_tokens.first() == held).all()
        assert (final == [min(n for n in packing.LENGTHS if n >= h) for h in held]).all()
        left, room = int(shard.piece_tokens.sum()), {}
        for size, where, place in zip(shard.piece_tokens.tolist(), shard.bin.tolist(), shard.place.tolist(), strict=True):
            fitting = [r for r in room.values() if r >= size]
            if where in room:
                assert fitting and room[where] == min(fitting)
            else:
                assert not fitting and place == 0
                costs = {n: packing.sequence_cost(n) / min(n, left) for n in packing.LENGTHS if n >= size}
                room[where] = min(costs, key=lambda n: (costs[n], n))
            room[where] -= size
            left -= size


def test_near_duplicates_of_five_words_and_four_fifths(spark):
    whole = lambda k: " ".join(f"{k}{i}" for i in range(104))
    # 100 shingles of 5 words; an appended passage leaves 100 of 125, or 100 of 126
    texts = [whole("a"), whole("a") + " " + " ".join(f"b{i}" for i in range(25)), whole("c"), whole("c") + " " + " ".join(f"d{i}" for i in range(26))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2, 3]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 1))
def test_a_pair_at_four_fifths_shares_a_signature(n, seed, share):
    rnd = np.random.default_rng(seed)
    pool = np.unique(rnd.integers(0, 2**64, 2 * n + 2, dtype=np.uint64))
    gone = int(share * n * 20 / 100)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: n - gone], pool[n : n + int((1 - share) * n * 20 / 100)]]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 80 * (len(a) + len(b) - both):
        assert set(jaccard_join.signatures(a, 80, 100)) & set(jaccard_join.signatures(b, 80, 100))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    whole = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, whole("a")), (2, whole("a", 59)), (2, whole("b")), (2, whole("b")), (3, whole("c")), (3, whole("d")), (4, whole("e")), (4, whole("e", 59)), (None, whole("f")), (None, whole("f", 59))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == {(1, "a"): 1, (2, "b"): 1, (3, "c"): 1, (3, "d"): 1, (4, "e"): 1, (None, "f"): 2}


def test_components_of_sets_without_an_id(spark):
    text = [" ".join(f"w{i}" for i in range(lo, lo + 100)) for lo in (0, 5, 10)]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[2])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(97, 7)] * 4


def test_pipeline_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd(spark), "").columns == odd(spark).columns
        assert stage(spark, none(spark), "").count() == 0

"""Token alignment against whole-text brute force with the libraries; runs and merges."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from desense.llm import queries, token_alignment

SF = "/root/testdata/sf0.01"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", " \n a", "a \n b\n\n  c  ", "x▁y", "日本 語   z", "don't  stop<|endoftext|> <s> ok <0x41>", "a\x1c b\x85 c", "　全角 ", "=====  ====\t\t x",
    "word " * 3000 + "q" * 5000, "é \U0001f600\U0001f601x", "a\x00b ", "-" * 3000 + "=" * 999, "same text", "same text",
]


def brute(texts):
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte_of = token_alignment.byte_of_char()
    rows, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        e, ids = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        left = [bytes(byte_of[c] for c in t) for t in e.tokens]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if not text or b"".join(left) != raw or b"".join(right) != raw:
            rows.append(None)
            continue
        ends = [list(accumulate(map(len, side))) for side in (left, right)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((e.ids[i:x], ids[j:y]))
            i, j = x, y
        links = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    links[p, q] += n * m
        counts.update(links.keys())
        rows.append((len(left), len(right), groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(m for k, m in links.items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in links.items()), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


def align(docs):
    return token_alignment.align_tokens(docs, open(BYTES).read(), open(PIECES, "rb").read())


def rows_of(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def test_whole_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((d, *row) for (d, _), row in zip(docs, brute([t for _, t in docs]), strict=True))
    assert rows_of(queries.op13_token_alignment(spark, SF)) == want


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_odd_texts(spark, monkeypatch, size):
    """Small blocks, merges of two runs and small frames, or one block for each task."""
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", size)
    if size == 1:
        for name, value in (("SLICE_BYTES", 10), ("FAN_IN", 2), ("FRAME", 3), ("RUNS_A_TABLE", 2), ("MOST_PIECES", 5), ("MOST_LINKS", 2)):
            monkeypatch.setattr(token_alignment, name, value)
    docs = spark.createDataFrame([(None if i == 4 else i % 9, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("block", F.lit(1))
    assert rows_of(align(docs.repartition(3))) == Counter((None if i == 4 else i % 9, *row) for i, row in enumerate(brute(ODD)))
    assert align(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ▁\n\té日=.'s", max_size=30), min_size=1, max_size=4))
def test_pieces_equal_whole_texts(texts):
    aligner = token_alignment._aligner(open(BYTES).read(), open(PIECES, "rb").read())
    sums, digests, _ = aligner.batch(texts)
    assert [(*s, d) for s, d in zip(sums.tolist(), digests, strict=True)] == [(*r[:4], r[6]) for r in brute(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 9), max_size=30), max_size=8))
def test_merge_sums_runs(runs):
    frame, token_alignment.FRAME = token_alignment.FRAME, 4
    try:
        packed = [token_alignment.packed(np.array(sorted(r), np.int64), np.array([r[k] for k in sorted(r)], np.int64)) for r in runs if r]
        got = {int(k): int(n) for keys, counts in token_alignment.merged(packed) for k, n in zip(keys, counts, strict=True)}
    finally:
        token_alignment.FRAME = frame
    assert got == dict(sum(map(Counter, runs), Counter()))

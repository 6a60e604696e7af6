"""The corpus pipeline on the smallest tables, each stage against what it promises."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from broadloom.llm import byte_bpe, decontamination, ngram_join, quality, secret_tags
from broadloom.llm.common import table
from broadloom.session import stage
from test_operators import brute_components

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, []
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, FOLDER), "pipeline-test")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert len(kept) == 5 or docs.columns == columns
    first = table(spark, FOLDER, "documents")
    good = {r["doc_id"] for r in quality.verdicts(first, table(spark, FOLDER, "labels")).where("kept").collect()}
    assert set(kept[0]) == good
    groups = brute_components({i: r["text"] for i, r in kept[0].items()})
    assert set(kept[1]) == {c for _, c in groups.values()}
    bench = table(spark, FOLDER, "benchmark").collect()
    for i, r in kept[1].items():
        words = decontamination.words_of(r["text"])
        hit = set()
        for b in bench:
            w = decontamination.words_of(b["text"])
            k = min(13, len(w))
            windows = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
            hit |= {p for a in range(len(words) - k + 1) if tuple(words[a : a + k]) in windows for p in range(a, a + k)}
        assert (i in kept[2]) == (not hit or 20 * len(hit) < len(words))
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == kept[2][i]["text"] or secret_tags.base_spans(kept[2][i]["text"])
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = byte_bpe.text_encoder(ranks, public_tokenizers.PATTERN)
    for i, r in kept[4].items():
        assert bytes(r["ids"]) == encoder.encode(kept[3][i]["text"]) and r["round_trip"]
        assert r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))


def test_no_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, FOLDER), "pipeline-test")
        assert docs.count() == 0


def test_join_reads_every_row(spark):
    docs = table(spark, FOLDER, "documents")
    assert ngram_join.near_duplicates(docs).count() == docs.count()

"""The n-gram join on a dense group of near copies and texts that share most shingles with it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from broadloom.llm import ngram_join


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components_by_hand(texts):
    """The smallest key that each text reaches over links, by all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    low = {k: k for k in texts}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low, len(links)


def changed(words, n, draw, fresh):
    out = list(words)
    for at in draw.sample(range(len(out)), n):
        out[at] = fresh()
    return " ".join(out)


@pytest.mark.parametrize("tokens, rounds", [(ngram_join.TILE_TOKENS, 5), (400, 1)])
def test_group_with_a_fringe_is_brute_force(spark, monkeypatch, tokens, rounds):
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    monkeypatch.setattr(ngram_join, "TILE_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    draw, n = random.Random(6), iter(range(10**6))
    fresh = lambda: f"n{next(n)}"
    base = [f"w{i}" for i in range(130)]
    texts = [changed(base, draw.randint(0, 3), draw, fresh) for _ in range(70)]  # mostly linked with one another
    texts += [changed(base, draw.randint(4, 9), draw, fresh) for _ in range(60)]  # few links or none
    texts += [changed(base[:110] + [fresh() for _ in range(draw.randint(0, 20))], 1, draw, fresh) for _ in range(20)]
    other = [f"v{i}" for i in range(60)]
    texts += [changed(other, draw.randint(0, 3), draw, fresh) for _ in range(30)] + [" ".join(fresh() for _ in range(40)) for _ in range(5)]
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    want, links = components_by_hand(texts)
    assert links > 1000 and len(set(want.values())) > 40
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == want


def test_tiles_give_the_links_between_components():
    draw = random.Random(1)
    for _ in range(20):
        rows = []
        for hub in range(3):
            base = [draw.getrandbits(64) for _ in range(60)]
            for _ in range(40):
                tokens = sorted({*draw.sample(base, draw.randint(20, 60)), *(draw.getrandbits(64) for _ in range(draw.randint(0, 6)))})
                rows.append((hub, 0, 1, draw.randint(0, 1), draw.randint(0, 8), np.array(tokens, np.uint64)))
        draw.shuffle(rows)
        names = ("hub", "p", "q", "side", "c")
        table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)} | {"tokens": pa.array([r[5].tobytes() for r in rows], pa.binary())})
        want = set()
        for x in rows:
            for y in rows:
                a, b = set(x[5].tolist()), set(y[5].tolist())
                if x[0] == y[0] and x[3] < y[3] and x[4] != y[4] and 100 * len(a & b) >= 80 * len(a | b):
                    want.add((min(x[4], y[4]), max(x[4], y[4])))
        assert {tuple(r.values()) for r in ngram_join.tile_links(table).to_pylist()} == want

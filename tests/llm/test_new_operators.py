"""Merkle manifest, SimHash and centroid clustering against brute force and on hard tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from broadloom.llm import centroids, merkle, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos int, tree string, print int, k int"


def prose(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=n))


def document(i, text, source="s"):
    return (i, text, "en" if text else None, source, len(text or ""), "x", 1, "y", 2, 3)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_by_hand(rows):
    """Every row's leaf, subroot, root, proof and folded root, by plain recursion over lists."""

    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """Each node's steps ``(run, place)`` to the top, and the top."""
        if len(nodes) == 1:
            return [[]], nodes[0]
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        above, top = climb([sha(*r) for r in runs])
        return [[(runs[i // 3], i % 3), *above[i // 3]] for i in range(len(nodes))], top

    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: climb([leaf(r, r[1]) for r in trees[s]]) for s in order}
    outer, root = climb([inner[s][1] for s in order])
    out = []
    for s, top_steps in zip(order, outer):
        for r, steps in zip(trees[s], inner[s][0]):
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if tampered else r[1])
            proof = ""
            for run, place in steps + top_steps:
                proof += "".join(run[:place] + run[place + 1 :])
                h = sha(*run[:place], h, *run[place + 1 :])
            out.append((r[0], leaf(r, r[1]), inner[s][1], root, sha(proof), h, h == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_proofs_are_those_by_hand(spark):
    rows = [document(i, f"line {i}\nend", "hot") for i in range(120)] + [document(500 + i, prose(i, 9), f"s{i % 7}") for i in range(40)]
    rows += [document(None, "no key\n", "hot"), document(3, "line 3\nend", "hot"), document(3, "line 3\nend", "hot"), document(7, None, None)]
    rows += [document(8, "", ""), document(9, "é\n" * 2_500_000, "-"), document(2**60 + 1, "\n", "+")]
    docs = spark.createDataFrame(rows, DOCS)
    assert ordered(merkle.document_proofs(docs).collect()) == ordered(proofs_by_hand(rows))
    for block in (3, 9, 27):  # several levels of superblocks, of sources too
        got = merkle.manifest(docs, merkle.LEAF, block=block).collect()
        want = {(r[0], r[1]): r for r in proofs_by_hand(rows)}
        for r in got:
            _, _, subroot, root, proof, _, _ = want[r["doc_id"], r["leaf"]]
            assert (r["subroot"], r["root"], r["folded_root"]) == (subroot, root, root)
            assert merkle.fold(r["leaf"], r["path"]) == root
            if r["doc_id"] != 3:  # the two copies of a row may change places
                assert sha(r["path"].replace("|", "").replace(";", "")) == proof


def test_small_manifests(spark):
    assert merkle.document_proofs(spark.createDataFrame([], DOCS)).count() == 0
    one = [document(1, "a\nb", None)]
    got = merkle.document_proofs(spark.createDataFrame(one, DOCS)).collect()
    assert ordered(got) == ordered(proofs_by_hand(one))
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"] and got[0]["proof_sha256"] == sha("")


def print_by_hand(text):
    words, buffer = [], bytearray()
    for byte in (text or "").encode() + b" ":
        if byte in b" \t\n\x0b\x0c\r":
            words += [bytes(buffer)] if buffer else []
            buffer = bytearray()
        else:
            buffer.append(byte + 32 if 65 <= byte <= 90 else byte)
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints: dict):
    """The smallest key of each print's component, by all pairs."""
    values = sorted(set(prints.values()))
    of = {v: v for v in values}

    def root(v):
        while of[v] != v:
            v = of[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                of[root(a)] = root(b)
    low = {}
    for key, v in prints.items():
        low[root(v)] = min(low.get(root(v), key), key)
    return {key: low[root(v)] for key, v in prints.items()}


def test_simhash_is_brute_force(spark):
    texts = [None, "", " \t\n", "One", "one", "a b c", "A B C d", "a b c d", "é É", prose(1, 4000)]
    for seed in range(25):
        base = prose(seed, 40 + seed * 8).split()
        for copy in range(6):
            words = list(base)
            for _ in range(copy):
                words[random.Random(f"{seed}{copy}").randrange(len(words))] = f"new{copy}"
            texts.append(" ".join(words))
    rows = [document(i, t) for i, t in enumerate(texts)]
    long = "long text of five megabytes " * 180_000
    docs = spark.createDataFrame([*rows, document(1000, long), document(1001, long + "end"), rows[5]], DOCS)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: print_by_hand(t) for i, t in enumerate(texts)}
    assert {i: v[0] for i, v in got.items() if i < 1000} == prints
    assert classes_by_hand({i: v[0] for i, v in got.items()}) == {i: v[1] for i, v in got.items()}
    assert got[1000][1] == got[1001][1] == 1000 and got[1][1] == 0  # null and empty texts share print zero
    kept = simhash.keep_first(docs.union(spark.createDataFrame([document(None, "nobody's")], DOCS)))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {v[1] for v in got.values()} | {None}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 5])
def test_dense_prints_lose_no_link(spark, monkeypatch, tile):
    """Groups of prints within a few bits of one another, a fringe around them, and unrelated ones; hot keys in tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        base = draw.getrandbits(64)
        for n in [2] * 30 + [5] * 40 + [8] * 40:
            values.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, n))))
    for _ in range(4):  # prints that share their first two segments
        head = draw.getrandbits(25)
        values |= {head | draw.getrandbits(39) << 25 for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.print_components(spark.createDataFrame([(v,) for v in signed], "print bigint")).collect()
    unsigned = lambda v: v % (1 << 64)
    groups = {unsigned(r["node"]): r["component"] for r in found}
    want = classes_by_hand({v: v for v in values})
    partition = lambda of: {frozenset(v for v in values if of(v) == c) for c in {of(v) for v in values}}
    assert partition(lambda v: unsigned(groups.get(v, v))) == partition(want.get)


def test_tiles_in_small_steps_are_the_same(monkeypatch):
    draw = np.random.default_rng(1)
    n = 400
    table = pa.table(
        {
            "k": draw.integers(0, 5, n) + 8 * draw.integers(0, 3, n), "p": np.zeros(n, int), "q": np.ones(n, int),
            "print": draw.integers(0, 1 << 9, n), "own": draw.random(n) < 0.5, "c": draw.integers(0, 9, n), "side": draw.integers(0, 2, n),
        }
    )
    whole = simhash.tile_links(table)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    assert simhash.tile_links(table).equals(whole) and whole.num_rows


def clusters_by_hand(rows, k, rounds):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(256 * np.float64(np.float32(x)))) for x in vector]))
    order = sorted(kept, key=lambda r: (sha(f"2:{'null' if r[0] is None else r[0]}"), r[1]))
    now = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min((distance(v, c), i) for i, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for i in range(len(now)):
                mine = [v for (_, v), (_, at) in zip(kept, near) if at == i]
                if mine:
                    now[i] = [sum(x) // len(mine) for x in zip(*mine)]
    total = {}
    for d, i in near:
        total[i] = total.get(i, 0) + d
    return [(key, i, d, total[i], sum(total.values()), sha(",".join(map(str, now[i])))) for (key, _), (d, i) in zip(kept, near)]


VECTORS = "vec_id bigint, embedding array<float>, label int, v int, cluster string, own int"


def vectors(seed, n, spread=0.05):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, 64))
    return [(i, (middles[i % 6] + spread * draw.normal(size=64)).astype("float32").tolist()) for i in range(n)]


def test_clusters_are_those_by_hand(spark):
    rows = vectors(1, 150) + [(500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [float("nan")] + [0.0] * 63)]
    rows += [(504, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (7, vectors(1, 8)[7][1]), (505, []), (506, [0.25] * 64), (507, [-0.25] * 64), (508, [600.0] * 64)]
    table = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], VECTORS)
    assert ordered(centroids.embedding_clusters(table).collect()) == ordered(clusters_by_hand(rows, 40, 5))
    few = [(i, [float(i // 2)] * 64) for i in range(10)]  # equal vectors, ties, fewer vectors than clusters
    table = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in few], VECTORS)
    assert ordered(centroids.embedding_clusters(table).collect()) == ordered(clusters_by_hand(few, 40, 5))
    assert centroids.embedding_clusters(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="a component beyond"):
        centroids.embedding_clusters(spark.createDataFrame([(1, [1e9] * 64, 1, 2, "x", 3)], VECTORS))


def test_geometry_bounds_less_than_drift_and_never_too_little(spark):
    draw = np.random.default_rng(2)
    for _ in range(40):
        old = draw.normal(size=(7, 5)) * 100
        new = old + draw.normal(size=old.shape) * draw.choice([1, 30])
        radius = np.abs(draw.normal(size=7)) * draw.choice([5, 60, 300])
        lost = centroids.loosening(old, new, radius)
        assert (lost <= centroids.full_drift(old, new, radius) + 1e-9).all()
        for i in range(7):
            x = draw.normal(size=(300, 5))
            x = old[i] + radius[i] * draw.random((300, 1)) ** 0.2 * x / np.linalg.norm(x, axis=1)[:, None]
            for j in set(range(7)) - {i}:
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= lost[i] + 1e-9
    table = centroids.integer_vectors(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in vectors(3, 600, 0.3)], VECTORS), "vec_id", "embedding", 64, 256)
    start = centroids.first_centroids(table, 12, "2:")
    by_geometry, by_drift = (centroids.clustered(table, start, 5, loosen) for loosen in (centroids.loosening, centroids.full_drift))
    assert by_geometry.centroids == by_drift.centroids
    assert sum(by_geometry.scanned[1:]) < sum(by_drift.scanned[1:]) and by_geometry.scanned[0] == 600


def test_simhash_joins_are_never_broadcast(spark, tmp_path):
    """an explode counts as large as its input, so keys of prints of 10 MB, 70 a print, once went through the driver."""
    spark.range(2000).selectExpr("id AS doc", "xxhash64(id) AS print").write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    labels = prints.selectExpr("print AS node", "print AS component")
    members = simhash.open_keys(prints.select("print"))
    documents = prints.selectExpr("doc AS doc_id", "string(print) AS text")
    for df in (members, simhash._tiled(members, labels), simhash.near_duplicates(documents)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

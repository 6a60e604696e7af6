"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. A window is 13
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The windows go to the
executors as a bit table over a rolling hash plus the exact windows; each document is scanned once, every bit that
answers is verified against the exact words, and the covered words are counted.

The hash set is bounded: a benchmark of more than ``BLOCK_CHARS`` characters is scanned for in blocks, one pass
over the documents for each, and the passes add up their spans. Documents are never exchanged.

Null and empty texts have no words, hence no hits. A null item id counts as the item ``''``; repeated items count
once. Extra columns of ``documents`` pass through the operators that keep documents; the one working column gets a name
that none of them has.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import columns_of, free_name, kinds_of, map_batches, merged

WINDOW_WORDS = 13
#: Normalised characters of the benchmark in one broadcast, and words in one chunk of a long item.
BLOCK_CHARS = 2_000_000
CHUNK_WORDS = 4096
#: A document is contaminated when one word in so many, or more, lies in a hit.
WORDS_PER_HIT = 20

_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _KEPT else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_BITS = 22
SPAN_TYPE = "struct<spans:array<struct<start:int,end:int>>,items:array<string>,n_words:bigint,n_hit:bigint>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_chunks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, words``: the normalised words of each item, long items in chunks that overlap by a window less one."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, chunks = [], []
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(value)
            for at in range(0, max(len(words) - WINDOW_WORDS, 0) + 1, CHUNK_WORDS) if words else ():
                items.append(name)
                chunks.append(b" ".join(words[at : at + CHUNK_WORDS + WINDOW_WORDS - 1]))
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(chunks, pa.binary())], ["item", "words"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return map_batches(named, chunk, "item string, words binary")


class WindowSet:
    """The windows of a block: per window length a bit table, and the exact windows with their items."""

    def __init__(self, chunks: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[bytes, list[str]] = {}
        lengths: dict[int, list[bytes]] = {}
        for item, joined in chunks:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in joined.split()], np.int32)
            k = min(WINDOW_WORDS, len(ids))
            for at in range(len(ids) - k + 1):
                found = self.windows.setdefault(window := ids[at : at + k].tobytes(), [])
                if item not in found:
                    found.append(item)
                lengths.setdefault(k, []).append(window)
        self.tables = {}
        for k, windows in lengths.items():
            ids = np.frombuffer(b"".join(windows), np.int32).reshape(-1, k)
            table = np.zeros(1 << _BITS, bool)
            table[self.hashes(ids.ravel(), k)[::k] >> np.uint64(64 - _BITS)] = True
            self.tables[k] = table

    @staticmethod
    def hashes(ids: np.ndarray, k: int) -> np.ndarray:
        """A hash of each run of ``k`` ids."""
        wide = ids.astype(np.uint64)
        out = np.zeros(len(ids) - k + 1, np.uint64)
        for j in range(k):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += wide[j : len(ids) - k + 1 + j]
        return out * np.uint64(0xD6E8FEB86659FD93)

    def scan(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, list[str]]]]:
        """Per text the verified windows: first word, end word and items."""
        get = self.vocabulary.get
        bounds = np.cumsum([0, *(len(words) + 1 for words in texts)])
        ids = np.zeros(bounds[-1], np.int32)
        for words, at in zip(texts, bounds):
            ids[at : at + len(words)] = [get(w, 0) for w in words]
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found: list[list] = [[] for _ in texts]
        for k, table in self.tables.items():
            if len(ids) < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if len(starts):
                starts = starts[table[self.hashes(ids, k)[starts] >> np.uint64(64 - _BITS)]]
            for at, doc in zip(starts.tolist(), (np.searchsorted(bounds, starts, "right") - 1).tolist()):
                if items := self.windows.get(ids[at : at + k].tobytes()):
                    first = at - int(bounds[doc])
                    found[doc].append((first, first + k, items))
        return found


@lru_cache(maxsize=2)
def _window_set(chunks: tuple) -> WindowSet:
    return WindowSet(list(chunks))


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[tuple[tuple[str, bytes], ...]]:
    """The benchmark in blocks of bounded size, each collected on its own."""
    chunks = item_chunks(benchmark, item, text)
    size = chunks.select(F.sum(F.length("words"))).first()[0] or 0
    n = math.ceil(size / BLOCK_CHARS)
    part = F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1)))
    return [tuple((r["item"], bytes(r["words"])) for r in chunks.where(part == b).collect()) for b in range(n)]


def with_hits(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "hits") -> DataFrame:
    """All columns of ``documents`` and a struct ``name``: merged hit spans in words, items, ``n_words``, ``n_hit``."""
    if name in documents.columns:
        raise ValueError(f"documents have a column {name} already; choose another name")
    spark, names = documents.sparkSession, documents.columns
    out = documents.withColumn(name, F.lit(None).cast(SPAN_TYPE))
    kinds = kinds_of(out)
    at = names.index(text)
    for block in _blocks(benchmark, item, item_text) or [()]:
        sent = spark.sparkContext.broadcast(block)

        def scan(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            texts = [words_of(t) for t in batch.column(at).to_pylist()]
            rows = []
            for words, found, before in zip(texts, _window_set(sent.value).scan(texts), batch.column(len(names)).to_pylist()):
                spans = [(s, e) for s, e, _ in found] + [(s["start"], s["end"]) for s in (before or {}).get("spans", ())]
                items = {i for _, _, of in found for i in of}.union((before or {}).get("items", ()))
                spans = merged(spans)
                rows.append({"spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items), "n_words": len(words), "n_hit": sum(e - s for s, e in spans)})
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, batch.schema.field(len(names)).type)], batch.schema.names)

        out = map_batches(out, scan, kinds)
    return out


def contaminated(name: str = "hits"):
    """The contract's rule over the struct of :func:`with_hits`."""
    hits = F.col(name)
    return (hits["n_hit"] > 0) & (hits["n_hit"] * WORDS_PER_HIT >= hits["n_words"])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the contaminated ones, with the columns they had."""
    name = free_name(documents, "_hits")
    found = with_hits(documents, benchmark, text=text, name=name)
    return found.where(~contaminated(name)).select(*columns_of(documents))


def cut_hits(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents with the hit spans, first to last word of each, cut out of their texts."""
    name = free_name(documents, "_hits")
    at = documents.columns.index(text)
    kinds = kinds_of(documents)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value, hits in zip(batch.column(at).to_pylist(), batch.column(len(documents_columns)).to_pylist()):
            if hits["spans"]:
                places = [m.span() for m in _WORD.finditer(value)]
                for span in reversed(hits["spans"]):
                    value = value[: places[span["start"]][0]] + value[places[span["end"] - 1][1] :]
            out.append(value)
        columns = batch.columns[: len(documents_columns)]
        columns[at] = pa.array(out, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(documents_columns)])

    documents_columns = list(documents.columns)
    return map_batches(with_hits(documents, benchmark, text=text, name=name), cut, kinds)


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of query ``op9_decontamination``."""
    found = with_hits(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM (SELECT item, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

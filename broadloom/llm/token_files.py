"""Token ids in Arrow files of equal-length sequences.

The ids of all documents, in ascending key order and each closed by an end id, form one stream per part file, cut
into sequences of ``length`` ids. A file holds record batches of a fixed number of rows with two fixed-size-list
columns, ``ids`` and the bit mask ``mask`` (true: an id, false: padding behind the last one), so sequence ``i`` is
row ``i % rows`` of batch ``i // rows`` and is read from the memory map without a copy. Ids are 16 bits wide when
the vocabulary allows it, else 32. Beside it lies an index file: key, offset in the part and number of ids of each
document. A manifest table lists the parts with the number of ids before each.

Each task of the range-sorted input streams its rows into files whose names no other attempt uses; only files
named in the rows that Spark committed enter the manifest, so lost and repeated tasks leave no trace in it.

Null and empty texts hold the end id alone. Null keys come first, repeated keys in the order of their texts; a
repeated row is a document of its own. Extra columns are not read. An empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.llm.common import SLICE_BYTES
from broadloom.llm.files import attempt_name, join, opened

SEQUENCE_LENGTH = 1024
ROWS_PER_BATCH = 256
END_ID = 1
#: Words a worker remembers; bounds memory only.
REMEMBERED_WORDS = 1 << 19

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\n\t\r" else b for b in range(256))
#: Texts on which a tokenizer must agree with its own pieces before it is trusted to be cut into words.
_PROBES = (
    "Ab cD. eF, 12 34. g", "x\ty\nz  w\r\n.", "it's THE end.", "a.b, c", "\u00c9t\u00e9 e\u0301 \u0130 \u03a3\u03a3 \u00df.", "...,. a,",
    "ab*** 7%%% \u00fc)., dogs' it's'. (x) e\u0301. \u2026. _a_ a\u00b2! q" + string.punctuation,
)
#: Letters and digits that stay such at the end of a piece: composing and folding leave no mark of theirs behind.
_STEM_ENDS = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and c.lower().isalnum())
#: Words that are one piece as they are: small letters, already composed.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_LETTERS = "".join(filter(_PLAIN.fullmatch, map(chr, range(256))))
_PLAIN_PROBES = (*_LETTERS, *map("".join, zip(_LETTERS, _LETTERS[1:])), "the", "something", _LETTERS, _LETTERS[::-1], 40 * _LETTERS)
#: Plain words that are encoded as one text.
WORDS_AT_ONCE = 64


class WordTokenizer:
    """A tokenizer file whose pieces never cross white space and ignore case, with a memory for words.

    Text is folded (A-Z to a-z, line breaks and tabs to blanks) and cut at blanks, and a word before the ASCII marks at its
    end if a Latin letter or a digit stands there: places where the tokenizer's own pattern cuts too. The library encodes each
    distinct word, without its marks, once. A text with ``<|``, which may be an added token's text, goes to the library
    whole, and so does every text where the tokenizer gives other ids for one of a few probes than for their words.

    Words of small Latin letters need neither normalizer nor pattern: many of them go to the same model as one text,
    whose ids are parted behind the tokens that end a word. If they do not part into as many words, or the probes of
    such words give other ids, the whole tokenizer encodes them one by one.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(tokenizer_json)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.library.get_vocab(with_added_tokens=False), json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        if not self.ends_word.any() or self._encode_plain(list(_PLAIN_PROBES)) != self._encode(list(_PLAIN_PROBES)):
            self.plain = None
        self.by_words = True
        self.by_words = all(self.encode([p]) == self._encode([p]) for p in _PROBES)
        self.words.clear()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of each plain word."""
        if self.plain is None or not words:
            return self._encode(words)
        texts = [" ".join(words[at : at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)])
        ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.kind.itemsize).tolist()
        if len(ends) != len(words):
            return self._encode(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: set[bytes]) -> None:
        """Remember the ids of new words."""
        words = [w.decode() for w in new]
        stems = [w.rstrip(string.punctuation) for w in words]
        parted = [(w, w[: len(s)], w[len(s) :]) if len(s) < len(w) and s[-1:] in _STEM_ENDS else (w, w, "") for w, s in zip(words, stems)]
        open_ = {p for _, stem, marks in parted for p in ((stem, marks) if marks else (stem,)) if p.encode() not in self.words}
        plain, others = [], []
        for p in open_:
            (plain if _PLAIN.fullmatch(p) else others).append(p)
        self.words.update(zip(map(str.encode, plain), self._encode_plain(plain)))
        self.words.update(zip(map(str.encode, others), self._encode(others)))
        get = self.words.__getitem__
        self.words.update((w.encode(), get(stem.encode()) + get(marks.encode())) for w, stem, marks in parted if marks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        cut = [t.encode().translate(_FOLD).split(b" ") if self.by_words and "<|" not in t else None for t in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        self._learn(set().union(*(words for words in cut if words is not None)).difference(self.words))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) if words is not None else self._encode([t])[0] for words, t in zip(cut, texts)]


@lru_cache(maxsize=2)
def word_tokenizer(tokenizer_json: str) -> WordTokenizer:
    return WordTokenizer(tokenizer_json)


class SequenceWriter:
    """Streams ids into a part file."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length, self.size = kind, length, length * ROWS_PER_BATCH
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def write(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.held += len(ids) // self.kind.itemsize
        self.total += len(ids) // self.kind.itemsize
        if self.held >= self.size:
            self._flush(self.held // self.size * self.size)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.kind)
        for at in range(0, n, self.size):
            self._batch(ids[at : min(at + self.size, n)])
        self.waiting, self.held = [ids[n:].tobytes()], self.held - n

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.kind)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=self.schema.field(i).type) for i, v in enumerate((padded, mask))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        self.out.close()


class TokenFile:
    """A part file: sequence ``i`` with its mask, as views of the mapped file."""

    def __init__(self, path: str):
        system, at = opened(path)
        self.source = pa.memory_map(at) if system.type_name == "local" else system.open_input_file(at)
        self.reader = pa.ipc.open_file(self.source)
        full = self.reader.num_record_batches
        self.rows = (full - 1) * ROWS_PER_BATCH + self.reader.get_batch(full - 1).num_rows if full else 0
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.rows:
            raise IndexError(i)
        batch, at = self.reader.get_batch(i // ROWS_PER_BATCH), i % ROWS_PER_BATCH * self.length
        ids = batch.column(0).values.slice(at, self.length).to_numpy()
        mask = batch.column(1).values.slice(at, self.length).to_numpy(zero_copy_only=False)
        return ids, mask

    def stream(self, lengths: list[int]) -> Iterator[np.ndarray]:
        """The ids of consecutive documents of the given lengths."""
        batches = (self.reader.get_batch(i).column(0).values.to_numpy() for i in range(self.reader.num_record_batches))
        held, at = np.zeros(0, "<u2"), 0
        for n in lengths:
            parts = []
            while n > len(held) - at:
                parts.append(held[at:])
                n -= len(held) - at
                held, at = next(batches), 0
            parts.append(held[at : at + n])
            at += n
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Write the files below ``path`` (a folder all executors share) and return the manifest, one row per part.

    Rows are dealt by ranges of the key (the sample for the ranges reads the key column only) into as many parts
    as the session has shuffle partitions; encoding and writing happen in the sorted tasks.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    opened(path)[0].create_dir(opened(path)[1], recursive=True)
    kind = documents.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = word_tokenizer(sent.value), TaskContext.get().partitionId()
        system, folder = opened(path)
        names = [attempt_name("part", part, ".arrow"), attempt_name("docs", part, ".arrow")]
        writer = index = None
        end = np.array([end_id], tokenizer.kind).tobytes()
        docs = 0
        for whole in batches:
            rows = max(1, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1))
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                if writer is None:
                    sinks = [system.open_output_stream(join(folder, n)) for n in names]
                    writer = SequenceWriter(sinks[0], tokenizer.kind, length)
                    shape = pa.schema([(key, batch.schema.field(0).type), ("at", pa.int64()), ("n", pa.int64())])
                    index = pa.ipc.new_file(sinks[1], shape)
                ats, ns = [], []
                for ids in tokenizer.encode([t or "" for t in batch.column(1).to_pylist()]):
                    ats.append(writer.total)
                    writer.write(ids + end)
                    ns.append(writer.total - ats[-1])
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(ats, pa.int64()), pa.array(ns, pa.int64())], schema=shape))
                docs += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            row = {"part": [part], "file": names[:1], "docs_file": names[1:], "n_docs": [docs], "n_ids": [writer.total]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = documents.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    parts = ordered.mapInArrow(write, "part int, file string, docs_file string, n_docs bigint, n_ids bigint")
    parts.write.parquet(join(path, "_parts"))
    # one row for each task that wrote: the plan's number of partitions bounds what comes to the driver
    found = sorted(spark.read.parquet(join(path, "_parts")).collect(), key=lambda r: r["part"])
    starts = np.cumsum([0, *(r["n_ids"] for r in found)]).tolist()
    rows = [(i, r["file"], r["docs_file"], r["n_docs"], r["n_ids"], s) for i, (r, s) in enumerate(zip(found, starts))]
    schema = "part int, file string, docs_file string, n_docs bigint, n_ids bigint, start bigint"
    spark.createDataFrame(rows, schema).write.option("key", key).parquet(join(path, "_manifest"))
    return spark.read.schema(schema).parquet(join(path, "_manifest")).withMetadata("part", {"key": key, "kind": kind})


def _read(spark: SparkSession, path: str, key: str, kind: str, columns: dict[str, tuple[str, pa.DataType]], value) -> DataFrame:
    manifest = spark.read.parquet(join(path, "_manifest"))
    parts = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, folder = opened(path)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(join(path, row["file"]))
                system, _ = opened(path)
                with system.open_input_file(join(folder, row["docs_file"])) as source, pa.ipc.open_file(source) as index:
                    lengths = [n for i in range(index.num_record_batches) for n in index.get_batch(i).column(2).to_pylist()]
                    stream = tokens.stream(lengths)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        values = [value(next(stream)) for _ in range(docs.num_rows)]
                        start = pa.array(np.array(docs.column(1)) + row["start"], pa.int64())
                        made = [pa.array([v[k] for v in values], t[1]) for k, t in enumerate(columns.values())]
                        yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), *made], [key, "start", "n_tokens", *columns])

    more = "".join(f", {n} {t[0]}" for n, t in columns.items())
    return manifest.repartition(max(parts, 1), "part").mapInArrow(read, f"`{key}` {kind}, start bigint, n_tokens bigint{more}")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """``key, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit) of every document in the files."""
    return _read(spark, path, key, kind, {"ids": ("binary", pa.binary())}, lambda ids: (ids.astype("<u4").tobytes(),))


def document_checksums(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """As :func:`read_documents`, with ``ids_crc32`` in place of the ids, which then stay in the tasks."""
    return _read(spark, path, key, kind, {"ids_crc32": ("bigint", pa.int64())}, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))

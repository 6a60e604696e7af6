"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text the encoder stores the last token of that prefix's encoding. The token is
unique: it is the only vocabulary entry ``t`` ending there for which ``(last token before t, t)`` is a *valid
pair*, that is, two tokens which the merge rules leave apart when their bytes stand alone. So one array of last
tokens describes the encodings of all prefixes at once; appending bytes only extends the array, and an edit is
re-encoded from its start until the array agrees with the old one over the length of the longest token.

Nulls and empty texts have no tokens. Repeated rows give repeated results. Extra columns pass through, but for the
names of the result's own columns, which raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import Remembered, columns_of, kinds_of, map_batches

#: Pieces a worker remembers in each of two generations, and pairs of tokens whose validity it remembers. These
#: bound memory only; results do not depend on them.
REMEMBERED_PIECES = 1 << 16
REMEMBERED_PAIRS = 1 << 20


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (one ``base64 rank`` line per token)."""
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """Encodes bytes with ranked tokens; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks = ranks
        self.token_bytes: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: The tokens read backwards as a tree: each node has its children and the tokens on its path, longest first.
        self._tree: list = [{}, ()]
        for token in sorted(ranks, key=len):
            node = self._tree
            for byte in reversed(token):
                if byte not in node[0]:
                    node[0][byte] = [{}, node[1]]
                node = node[0][byte]
            node[1] = ((ranks[token], len(token)), *node[1])
        self._valid: list[dict[int, bool]] = [{} for _ in range(max(self.token_bytes) + 2)]
        self._pairs = 0

    def merge(self, data: bytes) -> list[int]:
        """The merge rules applied to a few bytes: lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        joined = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(joined):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1])
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at])

    def valid(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: the start of a piece)."""
        known = self._valid[before].get(token)
        if known is None:
            if before < 0:
                known = self.merge(self.token_bytes[token]) == [token]
            else:
                known = self.merge(self.token_bytes[before] + self.token_bytes[token]) == [before, token]
            self._pairs += 1
            if self._pairs > REMEMBERED_PAIRS:
                self._pairs = 0
                for pairs in self._valid:
                    pairs.clear()
            self._valid[before][token] = known
        return known

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Last tokens of all prefixes of ``data``, given those of its first ``len(last)`` bytes (changed in place)."""
        tree, known, valid = self._tree, self._valid, self.valid
        for i in range(len(last), len(data)):
            node, j = tree, i
            while j >= 0 and (deeper := node[0].get(data[j])) is not None:
                node, j = deeper, j - 1
            for token, length in node[1]:
                before = last[i - length] if i >= length else -1
                good = known[before].get(token)
                if good or good is None and valid(before, token):
                    last.append(token)
                    break
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that an array of last tokens describes."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.token_bytes[last[i - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is itself in the vocabulary is one token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend([], piece))

    def splice(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replace ``data[start:end]``: the new bytes, their last tokens and how many of those were computed.

        Behind the edit an entry depends on the entries of the longest token's length before it, so once that
        many entries agree with the old ones the rest is the old rest.
        """
        changed = data[:start] + new + data[end:]
        shift = len(new) - (end - start)
        out, at, agree = list(last[:start]), start, 0
        while at < len(changed) and agree < self.longest:
            stop = min(len(changed), max(at + 1, start + len(new)))
            self.extend(out, changed[:stop])
            same = stop - 1 - shift >= end and out[stop - 1] == last[stop - 1 - shift]
            agree, at = (agree + 1 if same else 0), stop
        computed = at - start
        return changed, out + last[at - shift :], computed


def rank_table(rank_file: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in rank_file.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class TextEncoder:
    """Splits text by a pattern and encodes each match separately."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.pieces = PrefixEncoder(rank_table(rank_file))
        self.pattern = regex.compile(pattern)
        self.remembered = Remembered(self._ids, REMEMBERED_PIECES)

    def _ids(self, piece: str) -> bytes:
        return np.array(self.pieces.encode(piece.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.remembered.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes | None:
        return decoded(ids, self.pieces.token_bytes)


def decoded(ids: bytes, token_bytes: dict[int, bytes]) -> bytes | None:
    """The bytes of the ids; ``None`` where an id is not in the vocabulary."""
    try:
        return b"".join(map(token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    except KeyError:
        return None


class Decoder:
    """Ids back to bytes, without the encoder's tables."""

    def __init__(self, rank_file: bytes):
        self.token_bytes = {rank: token for token, rank in rank_table(rank_file).items()}

    def decode(self, ids: bytes) -> bytes | None:
        return decoded(ids, self.token_bytes)


class EditableText:
    """A text with its encoding that follows appends and edits without encoding everything again.

    A match starting at ``p`` and ending at ``e`` was decided by the characters up to ``max(e + 1, p + REACH)``;
    matches decided by unchanged characters stay, and behind an edit the old matches hold again from the first
    place where a new match starts at the start of an old one.
    """

    #: Characters that a match decision may read behind its start, besides the one behind its end.
    REACH = 3

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text, self.encoded = encoder, "", 0
        self.starts: list[int] = []
        self.ids: list[bytes] = []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``; ``encoded`` counts the pieces that had to be encoded."""
        old_starts, old_ids, shift = self.starts, self.ids, len(new) - (end - start)
        ends = [*old_starts[1:], len(self.text)]
        keep = next((k for k, (p, e) in enumerate(zip(old_starts, ends)) if max(e + 1, p + self.REACH) > start), len(old_starts))
        self.text = self.text[:start] + new + self.text[end:]
        at = old_starts[keep] if keep < len(old_starts) else (ends[-1] if old_starts else 0)
        self.starts, self.ids, self.encoded = old_starts[:keep], old_ids[:keep], 0
        behind = {p + shift: k for k, p in enumerate(old_starts) if p >= end}
        for match in self.encoder.pattern.finditer(self.text, at):
            if (k := behind.get(match.start())) is not None:
                self.starts += [p + shift for p in old_starts[k:]]
                self.ids += old_ids[k:]
                return
            self.starts.append(match.start())
            self.ids.append(self.encoder.remembered[match.group()])
            self.encoded += 1

    def tokens(self) -> bytes:
        return b"".join(self.ids)


@lru_cache(maxsize=4)
def text_encoder(rank_file: bytes, pattern: str) -> TextEncoder:
    return TextEncoder(rank_file, pattern)


@lru_cache(maxsize=4)
def decoder(rank_file: bytes) -> Decoder:
    return Decoder(rank_file)


def _per_row(column: pa.Array, fn) -> list:
    return [None if v is None else fn(v) for v in column.to_pylist()]


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", check: bool = False) -> DataFrame:
    """The columns of ``df`` but the text, with ``ids binary`` (little-endian unsigned 32-bit) and ``n_tokens``.

    A null text encodes as empty. With ``check`` the ids are decoded at once and ``round_trip`` tells whether that
    gives the text. The rank file (a fixed vocabulary) is read once by the driver and sent to the executors; texts
    stay where they are: no exchange. Columns with the names of the new ones must not be there.
    """
    if clash := {"ids", "n_tokens", "decoded", "round_trip"} & set(df.columns):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rest = df.drop(text)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = text_encoder(ranks.value, pattern)
        texts = [t or "" for t in batch.columns[-1].to_pylist()]
        ids = [encoder.encode(t) for t in texts]
        made = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
        if check:
            made.append(pa.array([encoder.decode(i) == t.encode() for i, t in zip(ids, texts)], pa.bool_()))
        names = ["ids", "n_tokens", "round_trip"][: len(made)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names])

    schema = f"{kinds_of(rest)}, ids binary, n_tokens bigint" + ", round_trip boolean" * check
    return map_batches(df.select(*columns_of(rest), F.col(text)), encode, schema.removeprefix(", "))


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded binary`` to all columns of ``df``; null where ``ids`` is null or holds an unknown id."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    at = df.columns.index(ids)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.array(_per_row(batch.column(at), decoder(ranks.value).decode), pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return map_batches(df, decode, f"{kinds_of(df)}, decoded binary")


def coded_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, digest, decode and digest again: the columns of query ``op1_byte_bpe``.

    A batch is encoded and its ids decoded in one visit of a worker, and only the digests return.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = text_encoder(ranks.value, pattern)
        sizes, of_ids, of_bytes = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encoder.encode(text or "")
            sizes.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents.select("doc_id", "text"), digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_rows(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but the text, ``ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to it."""
    return encode_texts(documents, ranks_path, pattern, text, check=True)

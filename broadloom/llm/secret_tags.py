"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they miss.

The field tags tokens (runs of letters and digits, or single other signs) as begin, inside or outside of a secret
from the token's shape, the shapes of its neighbours, credential words up to four tokens before it and two file
features (credential words present, many tokens with digits). It is trained by exact gradients (forward-backward)
on windows around base matches and on plain windows of a bounded sample of documents, and decoded by Viterbi.

Decoding is exact but looks closely at few tokens: where the score of *outside* leads by more than any change of
transitions can give, every best path is outside there, so only the runs between such tokens are decoded.

Spans are in code points, end exclusive. Spans of the field that overlap a base span are dropped, base spans always
stay. Null and empty texts have no spans; repeated rows repeat their spans; extra columns pass through
:func:`redact` and are left out of :func:`with_spans`. Without documents there is nothing to train on: the field
then adds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import Remembered, kinds_of, map_batches, merged

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "crf")
#: Shortest span that the field may add.
LEAST_ADDED = 12
#: The bounded training sample: documents with credential signs, documents without, windows of each document.
TRAIN_DOCUMENTS, TRAIN_WINDOWS, WINDOW_TOKENS = 150, 4, 24
TRAIN_STEPS, STEP_SIZE, SHRINK = 80, 0.4, 2e-5
REMEMBERED_WORDS = 1 << 16

_TOKEN = re.compile(r"[^\W_]+|\S")
_KEYWORDS = {"password": 1, "passwd": 1, "pwd": 1, "secret": 1, "token": 1, "apikey": 1, "api": 1, "key": 1, "auth": 1, "bearer": 1, "credential": 1}
_HEX_RUN = bytes(49 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, kind, start of the value`` of the base matches, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"1" * LEAST_HEX in text.encode().translate(_HEX_RUN):
        out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> tuple[int, int, int, int]:
    """Credential word, length class, character class and changes between letters and digits of a token."""
    n = len(token)
    length = 0 if n < 2 else 1 if n < 4 else 2 if n < 8 else 3 if n < 12 else 4 if n < 16 else 5 if n < 20 else 6 if n < 32 else 7 if n < 64 else 8
    if token.isalpha():
        kind = 0 if not token.isascii() else 1 if token.islower() else 2 if token.isupper() else 3 if token[1:].islower() else 4
        return (_KEYWORDS.get(token.lower(), 0) if n < 12 else 0), length, kind, 0
    if token.isdigit():
        return 0, length, 5, 0
    if token.isalnum():
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        kind = 6 if set(token) <= set("0123456789abcdef") else 7 if token.islower() else 8 if token.isupper() else 9
        return 0, length, kind, 1 + min(2, changes // 3)
    return 0, length, {"=": 10, ":": 11, '"': 12, "'": 12, "/": 13, "+": 13, "-": 14, "_": 14, ".": 15}.get(token, 16), 0


PAD = (0, 9, 17, 0)
_KEY, _LEN, _CHR, _SWI, _BOTH = 2, 10, 18, 4, 180
#: Atomic features: of the token, of the token before, of the token behind, credential word near, file features.
_OWN = (_KEY, _LEN, _CHR, _SWI, _BOTH)
_NEXT_TO = (_KEY, _LEN, _CHR)
_SIZES = [*_OWN, *_NEXT_TO, *_NEXT_TO, 2, 2, 2]
_AT = np.cumsum([0, *_SIZES]).tolist()
FEATURES = _AT[-1]


def _atoms(s: tuple[int, int, int, int]) -> tuple[list[int], list[int], list[int]]:
    """Feature numbers that a shape gives to its own token, to the token behind it and to the token before it."""
    key, length, kind, changes = s
    own = [key, length, kind, changes, kind * _LEN + length]
    side = [key, length, kind]
    return [_AT[i] + v for i, v in enumerate(own)], [_AT[5 + i] + v for i, v in enumerate(side)], [_AT[8 + i] + v for i, v in enumerate(side)]


def _near(credential: np.ndarray) -> np.ndarray:
    """Whether one of the four tokens before is a credential word."""
    out = np.zeros(len(credential), bool)
    for d in range(1, 5):
        out[d:] |= credential[:-d] if len(credential) > d else False
    return out


@dataclass
class Field:
    """A trained field: feature weights per state and transition weights."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    @property
    def slack(self) -> float:
        """The most that two transitions around a token can gain by another state than outside."""
        m = self.moves
        return max(m[a, s] + m[s, b] - m[a, O] - m[O, b] for a in range(3) for s in (B, I) for b in range(3))


def features(tokens: list[str]) -> np.ndarray:
    """Feature numbers of each token of a text."""
    shapes = [shape(t) for t in tokens]
    atoms = [_atoms(s) for s in [PAD, *shapes, PAD]]
    credential = np.array([s[0] > 0 for s in shapes], bool)
    digits = np.array([5 <= s[2] <= 9 for s in shapes], bool)
    files = [_AT[12] + int(credential.any()), _AT[13] + int(bool(len(tokens)) and digits.mean() > 0.02)]
    near = _near(credential)
    rows = [[*atoms[i + 1][0], *atoms[i][1], *atoms[i + 2][2], _AT[11] + int(near[i]), *files] for i in range(len(tokens))]
    return np.array(rows, np.int32).reshape(len(tokens), len(_SIZES))


def tags_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of a text, their base tags and, per token, its features."""
    found = list(_TOKEN.finditer(text))
    tags = np.zeros(len(found), np.int8)
    starts = np.array([m.start() for m in found] or [0])
    end_before = -1
    for _, end, _, value in base_spans(text):
        if value < end_before:
            continue
        a, b = np.searchsorted(starts, [value, end])
        tags[a:b] = I
        tags[a : a + 1] = B
        end_before = end
    tokens = [m.group() for m in found]
    return tokens, tags, features(tokens)


def train(windows: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Maximum likelihood with shrinkage, by adaptive gradient steps over all windows at once."""
    model = Field()
    if not any((tags == B).any() for _, tags in windows):
        return model
    n, t = len(windows), max(len(tags) for _, tags in windows)
    x = np.zeros((n, t, len(_SIZES)), np.int32)
    y = np.zeros((n, t), np.int64)
    live = np.zeros((n, t), bool)
    for i, (f, tags) in enumerate(windows):
        x[i, : len(tags)], y[i, : len(tags)], live[i, : len(tags)] = f, tags, True
    cells = x[live].ravel()
    pairs = live[:, 1:] & live[:, :-1]
    gold_w = np.zeros((FEATURES, 3))
    np.add.at(gold_w, (cells, np.repeat(y[live], len(_SIZES))), 1)
    gold_m = np.zeros((3, 3))
    np.add.at(gold_m, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    sum_w, sum_m = np.full((FEATURES, 3), 1e-8), np.full((3, 3), 1e-8)

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis)
        return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))

    for _ in range(TRAIN_STEPS):
        e = model.weights[x].sum(2) * live[:, :, None]
        fwd, bwd = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        fwd[:, 0] = e[:, 0]
        for i in range(1, t):
            fwd[:, i] = np.where(live[:, i, None], e[:, i] + log_sum(fwd[:, i - 1, :, None] + model.moves, 1), fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(live[:, i + 1, None], log_sum(model.moves + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), bwd[:, i + 1])
        total = log_sum(fwd[:, -1], 1)
        single = np.exp(fwd + bwd - total[:, None, None])[live]
        double = np.exp(fwd[:, :-1, :, None] + model.moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])[pairs].sum(0)
        spread = np.repeat(single, len(_SIZES), 0)
        hoped = np.stack([np.bincount(cells, spread[:, s], FEATURES) for s in range(3)], 1)
        for value, step, seen in ((model.weights, gold_w - hoped - SHRINK * n * model.weights, sum_w), (model.moves, gold_m - double - SHRINK * n * model.moves, sum_m)):
            seen += step**2
            value += STEP_SIZE * step / np.sqrt(seen)
    return model


class Tagger:
    """Decodes texts with a field; words become classes once, and scores are looked up by class."""

    def __init__(self, model: Field):
        self.moves = model.moves.tolist()
        self.slack = model.slack
        self.weights = model.weights
        self.trained = bool(np.any(model.weights))
        self.classes: dict[tuple, int] = {}
        self.own = np.zeros((1 << 16, 3), np.float32)
        self.behind, self.before = self.own.copy(), self.own.copy()
        self.credential, self.digits = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.pad = self._class(PAD)
        self.near = self.weights[_AT[11] : _AT[11] + 2].astype(np.float32)
        self.files = [self.weights[_AT[k] : _AT[k] + 2].astype(np.float32) for k in (12, 13)]
        self.words = Remembered(self._classes_of, REMEMBERED_WORDS)

    def _class(self, s: tuple[int, int, int, int]) -> int:
        n = self.classes.get(s)
        if n is None:
            n = self.classes[s] = len(self.classes)
            own, behind, before = _atoms(s)
            self.own[n], self.behind[n], self.before[n] = (self.weights[a].sum(0) for a in (own, behind, before))
            self.credential[n], self.digits[n] = s[0] > 0, 5 <= s[2] <= 9
        return n

    def _classes_of(self, word: str) -> bytes:
        # most words are letters, with or without a stop; only the others need the pattern
        tokens = [word] if word.isalpha() else [word[:-1], word[-1]] if word[:-1].isalpha() and word[-1] in ",." else _TOKEN.findall(word)
        return b"".join([self._class(shape(t)).to_bytes(2, "little") for t in tokens])

    def scores(self, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Scores of the three states for class ids; four pads part the texts, so no feature reaches over."""
        credential = self.credential[ids]
        near = _near(credential)
        counts = np.maximum(np.bincount(doc, ids != self.pad, docs), 1)
        many = np.bincount(doc, self.digits[ids], docs) / counts > 0.02
        some = np.bincount(doc, credential, docs) > 0
        out = self.own[ids] + self.near[near.astype(np.int8)]
        out[1:] += self.behind[ids[:-1]]
        out[:-1] += self.before[ids[1:]]
        out += self.files[0][some.astype(np.int8)][doc] + self.files[1][many.astype(np.int8)][doc]
        return out

    def viterbi(self, scores: list[list[float]]) -> list[int]:
        """Best states of a run between two tokens that are outside."""
        moves = self.moves
        best, back = [moves[O][s] + scores[0][s] for s in range(3)], []
        for e in scores[1:]:
            step = [max(range(3), key=lambda a, s=s: best[a] + moves[a][s]) for s in range(3)]
            best = [best[step[s]] + moves[step[s]][s] + e[s] for s in range(3)]
            back.append(step)
        state = max(range(3), key=lambda s: best[s] + moves[s][O])
        out = [state]
        for step in reversed(back):
            out.append(state := step[state])
        return out[::-1]

    def tag(self, texts: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For texts with secrets: token ranges."""
        if not self.trained:
            return {}
        pad = self.pad.to_bytes(2, "little")
        get = self.words.__getitem__
        parts = [pad * 4 + b"".join(map(get, t.split())) for t in texts]
        ids = np.frombuffer(b"".join(parts) + pad * 4, np.uint16)
        bounds = np.cumsum([0, *(len(p) // 2 for p in parts)])
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        doc = np.concatenate([doc, np.full(4, max(len(texts) - 1, 0))])
        e = self.scores(ids, doc, len(texts))
        unsure = (e[:, O] - e[:, 1:].max(1) <= self.slack + 1e-3) & (ids != self.pad)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], unsure.view(np.int8), [0]])))
        out: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            states = self.viterbi(e[a:b].tolist())
            if not any(states):
                continue
            d = int(doc[a])
            first = a - int(bounds[d]) - 4
            spans = out.setdefault(d, [])
            for i, s in enumerate(states):
                if s == I and i and states[i - 1] != O:
                    spans[-1] = (spans[-1][0], first + i + 1)
                elif s != O:
                    spans.append((first + i, first + i + 1))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, int]]]:
        """All spans of each text: the base ones and those that the field adds."""
        tagged = self.tag(texts)
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            added = []
            if i in tagged:
                places = [m.span() for m in _TOKEN.finditer(text)]
                for a, b in tagged[i]:
                    start, end = places[a][0], places[b - 1][1]
                    if end - start >= LEAST_ADDED and not any(start < e and s < end for s, e, _, _ in base):
                        added.append((start, end, "crf", start))
            out.append(sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))))
        return out


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """Train on at most ``TRAIN_DOCUMENTS`` documents with credential signs and as many without.

    The documents with the smallest hashes of their keys are taken, keys first; windows are cut on the executors.
    """
    plain = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    signs = F.lit(False)
    for w in ("assw", "AKIA", "oken", "ecret", "api"):
        signs = signs | F.col("t").contains(w)
    order = F.xxhash64(F.col(key).cast("string"))
    picked = [plain.where(c).select(order.alias("h")).orderBy("h").limit(TRAIN_DOCUMENTS).collect() for c in (signs, ~signs)]
    chosen = [r["h"] for rows in picked for r in rows]
    if not chosen:
        return Field()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, tags = [], []
        for value in batch.column(0).to_pylist():
            _, y, x = tags_of(value)
            firsts = np.flatnonzero(y == B)[:TRAIN_WINDOWS]
            # windows around secrets, and as many spread evenly over the text
            starts = [max(0, int(f) - WINDOW_TOKENS // 2) for f in firsts] + [len(y) * k // TRAIN_WINDOWS for k in range(TRAIN_WINDOWS)]
            for s in starts:
                if len(y[s : s + WINDOW_TOKENS]):
                    rows.append(x[s : s + WINDOW_TOKENS].tobytes())
                    tags.append(y[s : s + WINDOW_TOKENS].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(tags, pa.binary())], ["x", "y"])

    sample = plain.where(order.isin(chosen)).select("t")
    # bounded: documents x windows x tokens; a key that many rows share is read no further than the same bound
    got = map_batches(sample, cut, "x binary, y binary").orderBy("x", "y").limit(4 * TRAIN_DOCUMENTS * TRAIN_WINDOWS).collect()
    return train([(np.frombuffer(r["x"], np.int32).reshape(-1, len(_SIZES)), np.frombuffer(r["y"], np.int8)) for r in got])


_TAGGERS: dict[int, Tagger] = {}


def _tagger(model: Field) -> Tagger:
    tagger = _TAGGERS.get(key := hash((model.weights.tobytes(), model.moves.tobytes())))
    if tagger is None:
        _TAGGERS.clear()
        tagger = _TAGGERS[key] = Tagger(model)
    return tagger


def with_spans(documents: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: array of ``start, end, kind`` of all spans of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _tagger(sent.value).spans([t or "" for t in batch.column(1).to_pylist()])
        rows = [[{"start": s, "end": e, "kind": k} for s, e, k, _ in spans] for spans in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], [key, "spans"])

    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>"
    return map_batches(documents.select(key, text), scan, schema)


def redact(documents: DataFrame, model: Field, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """All documents with the secrets replaced by ``mark``; of an assignment only its value is replaced."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(at).to_pylist()
        for i, spans in enumerate(_tagger(sent.value).spans([v or "" for v in values])):
            for start, end in reversed(merged([(value, end) for _, end, _, value in spans])):
                values[i] = values[i][:start] + mark + values[i][end:]
        columns = batch.columns
        columns[at] = pa.array(values, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(documents, scan, kinds_of(documents))


def joined(spans: str, keep: str = "true") -> str:
    return f"array_join(transform(filter({spans}, s -> {keep}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def secret_report(documents: DataFrame) -> DataFrame:
    """The columns of query ``op3_secret_tags``, and ``n_crf``."""
    found = with_spans(documents, fit(documents))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(F.expr(joined("spans", "s.kind != 'crf'")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, F.expr(joined("spans")).alias("spans"), counts[3])


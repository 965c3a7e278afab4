"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Word vectors.  A token (a run of word characters, or of other visible ones) belongs to one of
``SLOTS`` slots: its shape (lower case, capitals, digits, signs, ...) and a hash.  Every slot has a
seeded index vector with a few entries of +-1; a slot's context sum adds up the index
vectors of the tokens within ``WINDOW`` places, over the whole corpus.  Its vector is the
mean context less the corpus's mean, at unit length.  The table has ``SLOTS`` x ``DIM``
numbers (4 MB as broadcast) however large the corpus is; sums are whole numbers, so they do not
depend on the order of rows.

Documents.  A text is pooled to the mean and the deviation of its tokens' vectors and
the mean cosine of neighbours.  A network (one hidden layer, numpy, Adam, seeded) is
fitted on at most ``SAMPLE`` labelled documents, chosen by the md5 of their id; a fifth of them is
held back to fit the temperature, so that scores are probabilities.

Where the work runs: tokens are counted and pooled in Arrow batches, each task sends on one row per
slot it met, and sums per slot are combined before and after one shuffle.

Defined results: a null text counts as empty; an empty text has the score of the zero features;
a null ``doc_id`` is held out, as is every id whose crc32 is divisible by five; labels of such
ids, null ids and null qualities are not used; of several labels of one id the least counts; with labels of
one kind only, or none, every score is (ones + 1) / (labels + 2).  Equal texts get equal
scores; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SHAPES, PER_SHAPE = 8, 4096
SLOTS = SHAPES * PER_SHAPE
DIM, NONZERO, WINDOW = 32, 2, 2
N_FEATURES = 2 * DIM + 1
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH = 32, 40, 256
THRESHOLD = 0.3
SEED = 11
FOLDS = 5
# A text is read in pieces of about this many characters, cut at white space.
PIECE = 1 << 20
# Tokens that are gathered before their counts or vectors are summed.
CHUNK = 1 << 18
# Entries a task keeps in its table of tokens.
TABLE_ENTRIES = 400_000

TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape_of(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 0
    if token.isdigit():
        return 1
    if token.islower():
        return 2
    if len(token) > 1 and token.isupper():
        return 3
    if token.istitle():
        return 4
    return 5 if token.isalpha() and token.lower() != token.upper() else 6 if token.isalpha() else 7


class Slots(dict):
    """Token -> slot, remembered up to ``TABLE_ENTRIES`` tokens."""

    def __missing__(self, token: str) -> int:
        slot = shape_of(token) * PER_SHAPE + crc32(token.encode()) % PER_SHAPE
        if len(token) <= 64:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[token] = slot
        return slot

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The slots of the text's tokens, piece by piece."""
        start = 0
        while start < len(text):
            end = start + PIECE
            if end < len(text):
                cut = re.compile(r"\s").search(text, end)
                end = cut.start() if cut else len(text)
            yield list(map(self.__getitem__, TOKEN.findall(text, start, end)))
            start = max(end, start + 1)


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of each slot's entries; the extra last slot, between texts, has sign 0."""
    rng = np.random.default_rng(seed)
    dims = rng.integers(0, DIM, (SLOTS + 1, NONZERO))
    signs = rng.choice([-1, 1], (SLOTS + 1, NONZERO))
    signs[SLOTS] = 0
    return dims, signs


class ContextSums:
    """Context sums and counts per slot over the texts a task reads."""

    def __init__(self):
        self.dims, self.signs = index_vectors()
        self.sums = np.zeros((SLOTS + 1) * DIM, dtype=np.int64)
        self.counts = np.zeros(SLOTS + 1, dtype=np.int64)
        self.held: list[int] = []

    def text(self, pieces: Iterator[list[int]]) -> None:
        for piece in pieces:
            self.held += piece
            while len(self.held) > CHUNK:
                self._flush(CHUNK)
        self.held += [SLOTS] * WINDOW

    def _flush(self, n: int) -> None:
        """Add up the first ``n`` held tokens as centres, and keep ``WINDOW`` before the rest as context."""
        slots = np.array(self.held[:n + WINDOW], dtype=np.int64)
        self.counts += np.bincount(slots[:n], minlength=SLOTS + 1)
        for d in range(1, WINDOW + 1):
            left, right = slots[:-d][:n], slots[d:][:n]
            for centre, context in ((left, right), (right, left)):
                for j in range(NONZERO):
                    at = centre * DIM + self.dims[context, j]
                    self.sums += np.bincount(at, weights=self.signs[context, j], minlength=self.sums.size).astype(np.int64)
        self.held = self.held[n:]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, count, context sum) of the slots met."""
        self._flush(len(self.held))
        met = np.flatnonzero(self.counts[:SLOTS])
        return met, self.counts[met], self.sums.reshape(-1, DIM)[met]


def context_sums(docs: DataFrame) -> DataFrame:
    """(slot, n, vec): occurrences and context sum of every slot, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sums = Slots(), ContextSums()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    sums.text(slots.pieces(t))
        slot, n, vec = sums.rows()
        for i in range(0, len(slot), 4096):
            part = vec[i:i + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[i:i + 4096], pa.int32()), pa.array(n[i:i + 4096], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, DIM), pa.int32()), pa.array(part.ravel(), pa.int64()))],
                names=["slot", "n", "vec"])

    parts = docs.select("text").mapInArrow(run, "slot int, n bigint, vec array<bigint>")
    total = parts.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("vec")[d]).alias(f"d{d}") for d in range(DIM)])
    return total.select("slot", "n", F.array(*[f"d{d}" for d in range(DIM)]).alias("vec"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of slot vectors, at most ``SLOTS`` rows read by the driver; zero where no token was met."""
    sums = stored(context_sums(docs), "context-sums").toArrow()
    slot = sums.column("slot").to_numpy()
    n = sums.column("n").to_numpy().astype(np.float64)
    vec = np.array(sums.column("vec").to_pylist(), dtype=np.float64).reshape(-1, DIM)
    order = np.argsort(slot)
    slot, n, vec = slot[order], n[order], vec[order]
    table = np.zeros((SLOTS, DIM), dtype=np.float32)
    if len(slot):
        own = vec / n[:, None] - vec.sum(0) / n.sum()
        length = np.sqrt((own * own).sum(1, keepdims=True))
        table[slot] = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    return table


class Pool:
    """Pooled features of texts over a table of slot vectors."""

    def __init__(self, table: np.ndarray):
        self.table, self.slots = table, Slots()

    def text(self, text: str | None) -> np.ndarray:
        total, squares, n, near, last = np.zeros(DIM), np.zeros(DIM), 0, 0.0, None
        for piece in self.slots.pieces(text or ""):
            for i in range(0, len(piece), CHUNK):
                x = self.table[piece[i:i + CHUNK]]
                total += x.sum(0, dtype=np.float64)
                squares += np.einsum("ij,ij->j", x, x, dtype=np.float64)
                near += float(np.einsum("ij,ij->", x[:-1], x[1:], dtype=np.float64))
                if last is not None:
                    near += float(last @ x[0])
                last, n = x[-1], n + len(x)
        if not n:
            return np.zeros(N_FEATURES)
        mean = total / n
        return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), [near / max(n - 1, 1)]])

    def texts(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.text(t) for t in texts]).reshape(-1, N_FEATURES)


# --- the network ----------------------------------------------------------------------------

@dataclass
class Network:
    """Two layers over standardised features, with a temperature on the logit."""
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Gradient of the mean cross-entropy plus ``decay / 2`` times the squared weights, by back-propagation."""
    w1, b1, w2, b2 = params
    h = np.tanh(x @ w1 + b1)
    err = (_sigmoid(h @ w2 + b2[0]) - y) / len(y)
    back = np.outer(err, w2) * (1 - h * h)
    return [x.T @ back + decay * w1, back.sum(0), h.T @ err + decay * w2, np.array([err.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS, rate: float = 0.003, decay: float = 1e-3) -> Network:
    """Mini-batch Adam from a seeded start."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([np.log(base / (1 - base))])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = order[i:i + BATCH]
            step += 1
            for k, g in enumerate(gradients(params, z[rows], y[rows], decay)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    w1, b1, w2, b2 = params
    return Network(centre, scale, w1, b1, w2, float(b2[0]))


def fit_temperature(logits: np.ndarray, y: np.ndarray, low: float = 0.25, high: float = 8.0) -> float:
    """The temperature of least cross-entropy, by golden sections on its logarithm (where the loss has one valley)."""
    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))
    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


# --- over tables ------------------------------------------------------------------------------

def fold(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, held back for the temperature?) of at most ``sample`` labelled documents."""
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = (labels.filter("doc_id is not null and quality in (0, 1)").filter(fold("doc_id") != 0)
              .groupBy("doc_id").agg(F.min("quality").alias("_y")).orderBy(order, "doc_id").limit(sample)
              .select(F.col("doc_id").alias("_id"), "_y", F.md5(F.col("doc_id").cast("string")).alias("_h")))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(shared.value)
        for b in batches:
            x = pool.texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "y", "x"])

    # At most ``sample`` ids, a few hundred KB; a repeated id may still bring more rows, so they are limited as well.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_h", F.col("_y").cast("int"), "text")
    found = rows.mapInArrow(run, "h string, y int, x array<double>").orderBy("h", "x").limit(sample).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(-1, N_FEATURES)
    back = np.array([int(h[:8], 16) % 5 == 0 for h in found.column("h").to_pylist()], dtype=bool)
    return x, found.column("y").to_numpy().astype(np.float64), back


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int = SAMPLE) -> Network | float:
    """The fitted network, or one score for all where labels do not hold both kinds."""
    x, y, back = training_rows(docs, labels, table, sample)
    fit, held = ~back, back
    if len(set(y[fit])) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    net = fit_network(x[fit], y[fit])
    if len(set(y[held])) == 2:
        net.temperature = fit_temperature(net.logits(x[held]), y[held])
    return net


def score_documents(docs: DataFrame, table: np.ndarray, net: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        pool = Pool(vectors)
        for b in batches:
            x = pool.texts(b.column(2).to_pylist())
            score = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Word vectors from all texts, the network from the labelled sample, then a score for every document."""
    table = word_vectors(docs)
    return score_documents(docs, table, train(docs, labels, table, sample), threshold)

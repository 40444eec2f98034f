"""Quality classifier: a byte-level convolutional network in numpy.

A document is read as bytes in overlapping chunks that cover all of it.  In every chunk learned filters (over
learned byte vectors) slide along the bytes and are max-pooled to one number each; a document's chunks are
combined by their mean and maximum, and one logistic unit turns that into the probability of label 1.

Fitted on the driver by Adam from a bounded sample: ``PER_CLASS`` labelled documents of each class, at most
``MOST_CHARS`` characters and ``CHUNKS`` chunks of each.  Scoring reads every chunk of every text, in blocks of
bounded size.

Defined results: null and empty texts are scored as a chunk of padding; without labels of both classes every
score is the share of label 1 (0.5 if there are no labels); null or repeated ids and ties are scored row by
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm import labelled
from loglens.llm.common import prepare

PER_CLASS, MOST_CHARS, CHUNKS = 1500, 8_000, 6
CUTOFF = 0.5
#: bytes in a chunk and from one chunk to the next; bytes under a filter and from one place to the next
CHUNK, HOP, WIDTH, STRIDE = 256, 224, 12, 4
VECTOR, FILTERS = 8, 24
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: chunks that are scored at a time
BLOCK = 256
PAD = 0x20


@dataclass
class Model:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    constant: float


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of n bytes; the last chunk ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - CHUNK, HOP), n - CHUNK)


def chunks_of(data: bytes) -> np.ndarray:
    if len(data) < CHUNK:
        data = data.ljust(CHUNK, bytes([PAD]))
    flat = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[chunk_starts(len(data))]


def _places(chunks: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(chunk, place, WIDTH * VECTOR): what lies under the filters at every place."""
    x = np.ascontiguousarray(vectors[chunks]).reshape(len(chunks), CHUNK * VECTOR)
    wide = np.lib.stride_tricks.sliding_window_view(x, WIDTH * VECTOR, axis=1)[:, ::STRIDE * VECTOR]
    return wide


def pooled(model: Model, chunks: np.ndarray) -> np.ndarray:
    """(chunk, filter): each filter's maximum over the chunk, not below 0."""
    out = np.empty((len(chunks), FILTERS), dtype=np.float32)
    for i in range(0, len(chunks), BLOCK):
        wide = _places(chunks[i:i + BLOCK], model.vectors)
        z = wide.reshape(-1, WIDTH * VECTOR) @ model.filters
        out[i:i + BLOCK] = np.maximum(z.reshape(wide.shape[0], wide.shape[1], FILTERS).max(axis=1) + model.bias, 0)
    return out


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    parts = [chunks_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    if not parts:
        return np.zeros(0)
    m = pooled(model, np.concatenate(parts))
    mean = np.add.reduceat(m, starts, axis=0) / np.array([len(p) for p in parts])[:, None]
    z = mean @ model.mean_weight + np.maximum.reduceat(m, starts, axis=0) @ model.max_weight + model.constant
    return labelled.sigmoid(z.astype(np.float64))


def fit(rows: list[tuple[str, int]], sizes: dict[int, int], epochs: int = EPOCHS, seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    model = Model(small(256, VECTOR) * 0.5, small(WIDTH * VECTOR, FILTERS) / np.sqrt(WIDTH * VECTOR).astype(np.float32), np.zeros(FILTERS, np.float32),
                  small(FILTERS) * 0.1, small(FILTERS) * 0.1, 0.0)
    shown = {k: sum(y == k for _, y in rows) for k in (0, 1)}
    if not all(shown.values()):
        known = sum(sizes.values())
        share = sizes.get(1, 0) / known if known else 0.5
        model.mean_weight[:] = model.max_weight[:] = 0
        model.constant = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return model
    taken = []
    for text, _ in rows:
        c = chunks_of(text.encode())
        taken.append(c[np.sort(rng.permutation(len(c))[:CHUNKS])] if len(c) >= CHUNKS else c[np.arange(CHUNKS) % len(c)])
    x, y = np.stack(taken), np.array([k for _, k in rows], dtype=np.float32)
    even = np.where(y == 1, len(y) / (2 * shown[1]), len(y) / (2 * shown[0])).astype(np.float32)
    params = [model.vectors, model.filters, model.bias, model.mean_weight, model.max_weight, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i:i + BATCH]
            step += 1
            for p, g, a, b in zip(params, _gradients(params, x[at], y[at], even[at]), first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    model.constant = float(params[5][0]) + labelled.prior_shift(sizes, {0: 1, 1: 1})
    return model


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted logistic loss of documents (document, chunk, byte)."""
    vectors, filters, bias, v_mean, v_max, constant = params
    docs, per = x.shape[:2]
    chunks = x.reshape(docs * per, CHUNK)
    wide = _places(chunks, vectors)
    z = (wide.reshape(-1, WIDTH * VECTOR) @ filters).reshape(len(chunks), wide.shape[1], FILTERS)
    place = z.argmax(axis=1)  # (chunk, filter)
    rows = np.arange(len(chunks))[:, None]
    top = z[rows, place, np.arange(FILTERS)] + bias
    m = np.maximum(top, 0).reshape(docs, per, FILTERS)
    mean, best = m.mean(axis=1), m.argmax(axis=1)
    highest = m.max(axis=1)
    logit = mean @ v_mean + highest @ v_max + constant[0]
    d = ((labelled.sigmoid(logit) - y) * weight / docs).astype(np.float32)
    dm = np.repeat((d[:, None] * v_mean / per)[:, None, :], per, axis=1)
    dm[np.arange(docs)[:, None], best, np.arange(FILTERS)] += d[:, None] * v_max
    dm = dm.reshape(len(chunks), FILTERS) * (top > 0)
    under = wide[rows, place]  # (chunk, filter, WIDTH * VECTOR)
    d_filters = np.einsum("cf,cfk->kf", dm, under)
    d_under = (dm[:, :, None] * filters.T[None]).reshape(-1, VECTOR)
    byte = chunks[rows[:, :, None], place[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
    d_vectors = np.stack([np.bincount(byte, d_under[:, k], minlength=256) for k in range(VECTOR)], axis=1).astype(np.float32)
    return [d_vectors, d_filters, dm.sum(axis=0), mean.T @ d, highest.T @ d, np.array([d.sum()], np.float32)]


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = PER_CLASS) -> Model:
    prepare(docs)
    return fit(*labelled.sample(docs, labels, label_col, learnable, (per_class, per_class), MOST_CHARS, id_col, text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(id_col, score, predicted) of every whole text."""
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                texts = [(t or "").encode() for t in b["body"][i:i + 200].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["id"][i:i + 200], pa.array(probabilities(shared.value, texts))], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))

"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are maximal runs of at least ``LEAST`` characters that credentials are written in.  The network reads each
one whole, with ``CONTEXT`` characters on either side: learned filters over learned character vectors, max-pooled over
what lies before, inside and after the candidate, and averaged inside.  One logistic head per kind gives the
probability of that kind.  Labelled findings train it: by default the candidates of all documents,
labelled with the kinds of the pattern matches they overlap, or a table of findings that the user gives.

Part of the findings is kept back: on it every head is calibrated (Platt), and its threshold is the highest at which
the recall of the kept-back findings of that kind stays at ``RECALL`` or more; a head of whose kept-back hits less than
``PRECISION`` are right there adds nothing.  Candidates that overlap no pattern
match and reach a threshold are added as further spans of kind ``net_<kind>``; pattern matches always stay.

Fitting reads every document and learns from every finding, cropped to ``CROP`` characters.  Findings are dealt to
shards of about ``SHARD``; each round all shards train from the same weights, and the weights are averaged by the shards'
sizes.  Calibration and thresholds come from sums and ranks over all kept-back findings (one in ``KEPT_BACK`` by a hash).

Defined results: null and empty texts have no spans; positions count code points, ends are exclusive; null or repeated
ids and repeated rows are scanned row by row; a head without kept-back findings adds nothing, without any findings the
spans are those of the patterns; equal probabilities go to the kind listed first; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm import labelled
from loglens.llm.common import body, prepare

# The kinds with their patterns, the group whose length counts, and the least length.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
KINDS = ("assign", "access", "hex")

LEAST, CONTEXT, CROP = 16, 24, 64
#: findings of one shard
SHARD = 20_000
RECALL, PRECISION, KEPT_BACK = 0.99, 0.5, 4
#: characters with a vector of their own (the last one stands for all others, the one before it for padding)
CHARS, PAD, OTHER = 130, 128, 129
VECTOR, FILTERS, WIDTH = 8, 16, 5
FEATURES = 4 * FILTERS + 1
#: passes over the findings, and training steps at least
EPOCHS, STEPS, BATCH, RATE = 6, 200, 64, 0.01
#: characters that go through the filters at a time
BLOCK = 1 << 16


# ------------------------------------------------------------ spans
def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start, then kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):  # long enough matches of the other kinds lie inside such runs
        a, z = run.span()
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, z) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, z)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def kinds_of(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Per run the kinds of the spans that overlap it, as bits.  Spans of one kind don't overlap each other."""
    out = np.zeros(len(runs), dtype=np.int64)
    a, z = np.array(runs, dtype=np.int64).reshape(-1, 2).T
    for kind in {k for _, k, _ in spans}:
        start, end = np.array([(s, e) for s, k, e in spans if k == kind]).T
        at = np.searchsorted(end, a, side="right")  # the first span that ends behind the run's start
        out |= (np.append(start, np.iinfo(np.int64).max)[at] < z).astype(np.int64) << kind
    return out


# ------------------------------------------------------------ network
@dataclass
class Model:
    vectors: np.ndarray  # CHARS x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    heads: np.ndarray  # FEATURES + 1 x kinds, the constant last
    scale: np.ndarray = field(default_factory=lambda: np.tile([1.0, 0.0], (len(KINDS), 1)))  # calibration: slope, constant
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), np.inf))


def _codes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(code < 128, code, OTHER).astype(np.int64)


def window(text: str, a: int, z: int, context: int = CONTEXT) -> tuple[str, str, str]:
    return text[max(0, a - context):a], text[a:z], text[z:z + context]


def _sequence(w: tuple[str, str, str], most: int | None = None) -> tuple[np.ndarray, int]:
    """Codes of a window, either side padded to CONTEXT, and the length of its middle (cropped in its centre to ``most``)."""
    before, inside, after = map(_codes, w)
    if most is not None and len(inside) > most:
        inside = np.concatenate([inside[:most // 2], inside[len(inside) - most + most // 2:]])
    pad = lambda n: np.full(n, PAD, dtype=np.int64)
    return np.concatenate([pad(CONTEXT - len(before)), before, inside, after, pad(CONTEXT - len(after))]), len(inside)


def features(model: Model, windows: list[tuple[str, str, str]]) -> np.ndarray:
    """(candidate, FEATURES): filters max-pooled before, inside and after, averaged inside, and the log of the length.

    All positions of all candidates are read, in blocks of bounded size: maxima and sums of blocks combine."""
    n, reach = len(windows), WIDTH // 2
    high = np.zeros((n, 3, FILTERS), dtype=np.float32)
    total, sizes = np.zeros((n, FILTERS)), np.zeros(n)
    table = (model.vectors @ model.filters.reshape(WIDTH, VECTOR, FILTERS)).astype(np.float32)  # place, character, filter
    codes, part, row, filled = [], [], [], 0

    def flush() -> None:
        nonlocal codes, part, row, filled
        if not codes:
            return
        x, p, r = np.concatenate(codes), np.concatenate(part), np.concatenate(row)
        z = np.zeros((len(x) - 2 * reach, FILTERS), dtype=np.float32)
        for j in range(WIDTH):
            z += table[j][x[j:j + len(z)]]
        z = np.maximum(z + model.bias, 0)
        p, r = p[reach:reach + len(z)], r[reach:reach + len(z)]
        own = p >= 0  # the padding between candidates is no place
        z, p, r = z[own], p[own], r[own]
        if len(z):
            start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
            top, summed = np.maximum.reduceat(z, start, axis=0), np.add.reduceat(z, start, axis=0, dtype=np.float64)
            np.maximum.at(high, (r[start], p[start]), top)
            mid = p[start] == 1
            np.add.at(total, r[start][mid], summed[mid])
        codes, part, row, filled = [], [], [], 0

    between = np.full(reach, PAD, dtype=np.int64)
    for i, w in enumerate(windows):
        x, inside = _sequence(w)
        sizes[i] = inside
        where = np.repeat([0, 1, 2], [CONTEXT, inside, CONTEXT])
        for lo in range(0, len(x), BLOCK):  # a very long candidate goes in pieces that share their edges
            hi = min(len(x), lo + BLOCK)
            left, right = x[max(0, lo - reach):lo], x[hi:hi + reach]
            piece = np.concatenate([between[:reach - len(left)], left, x[lo:hi], right, between[:reach - len(right)]])
            codes.append(piece)
            part.append(np.r_[np.full(reach, -1), where[lo:hi], np.full(reach, -1)])
            row.append(np.full(len(piece), i))
            filled += len(piece)
            if filled >= BLOCK:
                flush()
    flush()
    mean = total / np.maximum(sizes, 1)[:, None]
    return np.hstack([high.reshape(n, 3 * FILTERS), mean, np.log1p(sizes)[:, None] / 4])


def logits(model: Model, windows: list[tuple[str, str, str]]) -> np.ndarray:
    f = features(model, windows)
    return f @ model.heads[:-1] + model.heads[-1]


def probabilities(model: Model, windows: list[tuple[str, str, str]]) -> np.ndarray:
    """(candidate, kind): calibrated."""
    return labelled.sigmoid(logits(model, windows) * model.scale[:, 0] + model.scale[:, 1])


@dataclass
class Training:
    """Weights, their running moments, and the steps made."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float = 0.0

    def packed(self) -> np.ndarray:
        return np.concatenate([*(x.ravel().astype(np.float64) for x in (*self.params, *self.first, *self.second)), [self.step]])

    def unpacked(self, values: np.ndarray) -> Training:
        sizes = [p.size for p in self.params] * 3
        parts = np.split(values[:-1].astype(np.float32), np.cumsum(sizes)[:-1])
        like = [x.reshape(p.shape) for x, p in zip(parts, self.params * 3)]
        n = len(self.params)
        return Training(like[:n], like[n:2 * n], like[2 * n:], float(values[-1]))


def started(seed: int = 13) -> Training:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    params = [small(CHARS, VECTOR) * np.float32(0.5), small(WIDTH * VECTOR, FILTERS) / np.sqrt(WIDTH * VECTOR).astype(np.float32), np.zeros(FILTERS, np.float32),
              np.vstack([small(FEATURES, len(KINDS)) * np.float32(0.1), np.zeros((1, len(KINDS)), np.float32)])]
    return Training(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])


def train(state: Training, rows: list[tuple[tuple[str, str, str], int]], epochs: range, of: int, seed: int = 13) -> Training:
    """Some of ``of`` passes over the rows (windows with the bits of their kinds)."""
    rng = np.random.default_rng(seed)
    y = np.array([[bits >> k & 1 for k in range(len(KINDS))] for _, bits in rows], dtype=np.float32).reshape(len(rows), len(KINDS))
    codes, middle = zip(*(_sequence(w, CROP) for w, _ in rows))
    state = state.unpacked(state.packed())
    for epoch in epochs:
        rate, shuffled = RATE * (1 - epoch / of), rng.permutation(len(rows))
        for i in range(0, len(rows), BATCH):
            at = shuffled[i:i + BATCH]
            state.step += 1
            for p, g, a, b in zip(state.params, gradients(state.params, [codes[j] for j in at], [middle[j] for j in at], y[at]), state.first, state.second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**state.step)) / (np.sqrt(b / (1 - 0.99**state.step)) + 1e-6)
    return state


def gradients(params: list[np.ndarray], codes: list[np.ndarray], middle: list[int], y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss over all heads."""
    vectors, filters, bias, heads = params
    n, reach, longest = len(codes), WIDTH // 2, max(map(len, codes))
    x = np.full((n, longest + 2 * reach), PAD, dtype=np.int64)
    part = np.full((n, longest), -1)
    for i, (c, m) in enumerate(zip(codes, middle)):
        x[i, reach:reach + len(c)] = c
        part[i, :len(c)] = np.repeat([0, 1, 2], [CONTEXT, m, CONTEXT])
    size = np.array(middle, dtype=np.float32)
    wide = np.lib.stride_tricks.sliding_window_view(vectors[x].reshape(n, -1), WIDTH * VECTOR, axis=1)[:, ::VECTOR]
    z = (wide.reshape(-1, WIDTH * VECTOR) @ filters).reshape(n, longest, FILTERS) + bias
    act = np.maximum(z, 0)
    masks = [part == k for k in range(3)]
    places = [np.where(m[:, :, None], act, -1).argmax(axis=1) for m in masks]
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)
    tops = [act[rows, p, cols] for p in places]
    mean = (act * masks[1][:, :, None]).sum(axis=1) / size[:, None]
    f = np.hstack([*tops, mean, np.log1p(size)[:, None] / 4])
    d = ((labelled.sigmoid(f @ heads[:-1] + heads[-1]) - y) / n).astype(np.float32)
    df = d @ heads[:-1].T
    dz = np.where(masks[1][:, :, None], (df[:, 3 * FILTERS:4 * FILTERS] / size[:, None])[:, None, :], 0).astype(np.float32)
    for k, p in enumerate(places):
        np.add.at(dz, (rows, p, cols), df[:, k * FILTERS:(k + 1) * FILTERS])
    dz *= z > 0
    flat = dz.reshape(-1, FILTERS)
    d_filters = wide.reshape(-1, WIDTH * VECTOR).T @ flat
    d_wide = (flat @ filters.T).reshape(n, longest, WIDTH, VECTOR)
    byte = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
    d_vectors = np.stack([np.bincount(byte.reshape(-1), d_wide[..., k].reshape(-1), minlength=CHARS) for k in range(VECTOR)], axis=1).astype(np.float32)
    d_heads = np.vstack([f.T @ d, d.sum(axis=0)]).astype(np.float32)
    return [d_vectors, d_filters, flat.sum(axis=0), d_heads]


# ------------------------------------------------------------ frames
FOUND = "before string, inside string, after string, kinds int"


def _labelled_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (body, spans) -> windows of all candidates with the kinds of the findings they overlap, cropped."""
    for b in batches:
        out: list[tuple[str, str, str, int]] = []
        known = b["spans"].to_pylist() if "spans" in b.schema.names else None
        for i, text in enumerate(b["body"].to_pylist()):
            runs = candidates(text)
            if not runs:
                continue
            spans = pattern_spans(text) if known is None else sorted((s["start"], KINDS.index(s["kind"]), s["end"]) for s in known[i] or [])
            for (a, z), bits in zip(runs, kinds_of(runs, spans).tolist()):
                before, inside, after = window(text, a, z)
                if len(inside) > 2 * CROP:  # what _sequence crops to anyway
                    inside = inside[:CROP] + inside[-CROP:]
                out.append((before, inside, after, bits))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["before", "inside", "after", "kinds"])


def _windows(b: pa.RecordBatch) -> list[tuple[str, str, str]]:
    return list(zip(*(b[c].to_pylist() for c in ("before", "inside", "after"))))


def _trained(used: DataFrame) -> Training:
    """The network after all passes over all findings."""
    n, sc, state = used.count(), used.sparkSession.sparkContext, started()
    shards = max(1, -(-n // SHARD))
    dealt = used.repartition(shards).checkpoint()
    epochs = max(EPOCHS, -(-STEPS * BATCH // (n // shards)))
    for some in [range(epochs)] if shards == 1 else [range(e, e + 1) for e in range(epochs)]:
        shared = sc.broadcast(state)  # a few thousand numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared, some=some) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = sorted((w, bits) for b in batches for w, bits in zip(_windows(b), b["kinds"].to_pylist()))
            if rows:
                values = train(shared.value, rows, some, epochs, 1000 * TaskContext.get().partitionId() + some[0]).packed()
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["n", "weights"])

        made = dealt.mapInArrow(run, "n long, weights binary").rdd
        total, size = made.map(lambda r: (np.frombuffer(bytes(r[1])) * r[0], r[0])).treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
        state = state.unpacked(total / size)
    return state


def _calibrated(model: Model, kept: DataFrame) -> Model:
    """Slopes, constants and thresholds from all kept-back findings."""
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                z = np.asarray(logits(shared.value, _windows(some)), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([some["kinds"], *(pa.array(z[:, k]) for k in range(len(KINDS)))], names=["kinds", *(f"z{k}" for k in range(len(KINDS)))])

    scored = kept.mapInArrow(run, "kinds int, " + ", ".join(f"z{k} double" for k in range(len(KINDS)))).checkpoint()
    right = [F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0 for k in range(len(KINDS))]
    counts = scored.agg(F.count(F.lit(1)), *[F.count_if(r) for r in right]).first()
    n, hits = counts[0], counts[1:]
    weights = {k: np.zeros(2) for k in range(len(KINDS)) if 0 < hits[k] < n}
    moving = dict(weights)
    for _ in range(60):  # Newton steps of ``labelled.fit_logistic``, one pass for all heads
        if not moving:
            break
        sums = []
        for k, w in moving.items():
            z = F.col(f"z{k}")
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(w[0]) + float(w[1])))))
            d, h = p - right[k].cast("double"), p * (1 - p)
            sums += [F.sum(x) for x in (d * z, d, h * z * z, h * z, h)]
        values = np.array(scored.agg(*sums).first(), dtype=np.float64).reshape(-1, 5)
        penalty = np.array([1e-3 * n, 1e-9])
        for (k, w), (gz, g, hzz, hz, h) in zip(list(moving.items()), values):
            step = np.linalg.solve(np.array([[hzz, hz], [hz, h]]) + np.diag(penalty + 1e-9), np.array([gz, g]) + penalty * w)
            weights[k] = moving[k] = w - step
            if np.abs(step).max() < 1e-8:
                del moving[k]
    for k in range(len(KINDS)):
        if not hits[k]:
            continue
        if k in weights:
            model.scale[k] = [max(weights[k][0], 1e-3), weights[k][1]]
        z = F.col(f"z{k}")
        low = scored.where(right[k]).orderBy(z).offset(int(np.floor(hits[k] * (1 - RECALL)))).select(z).first()[0]  # the lowest hundredth
        over = scored.where(z >= low).agg(F.avg(right[k].cast("double"))).first()[0]
        if over >= PRECISION:
            model.thresholds[k] = labelled.sigmoid(np.array([low]) * model.scale[k, 0] + model.scale[k, 1])[0]
    return model


def learn(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the network.  ``findings`` (id_col, kind, start, end) are labelled findings, kinds as in ``KINDS``; without
    them the patterns label the candidates."""
    prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))
    if findings is not None:
        given = findings.select(F.col(id_col).alias("k"), F.struct("kind", "start", "end").alias("s")).filter("k IS NOT NULL")
        rows = rows.join(given.groupBy("k").agg(F.collect_list("s").alias("spans")), F.col("id") == F.col("k"), "left").drop("k")
    found = rows.drop("id").mapInArrow(_labelled_candidates, FOUND).checkpoint()  # all candidates, cropped
    kept = F.pmod(F.xxhash64("before", "inside", "after", F.lit(31)), F.lit(KEPT_BACK)) == 0
    used = found.where(~kept)
    if used.where("kinds > 0").isEmpty():
        return Model(*started().params)
    return _calibrated(Model(*_trained(used).params), found.where(kept))


SPANS = "array<struct<kind:string,start:long,end:long,probability:double>>"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): all spans of every text by start, then kind (patterns first, in their order).  ``probability`` is
    the network's for the kind where the span overlaps a candidate, else null."""
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = [t or "" for t in b["body"][i:i + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["id"][i:i + 256], pa.array(scan_texts(m, texts), pa.list_(item))], names=["id", "spans"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, f"id {kind}, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def scan_texts(model: Model, texts: list[str]) -> list[list[dict]]:
    found, windows, result = [], [], []
    for text in texts:
        runs = candidates(text)
        found.append((pattern_spans(text), runs, len(windows)))
        windows += [window(text, a, z) for a, z in runs]
    p = probabilities(model, windows) if windows else np.zeros((0, len(KINDS)))
    for spans, runs, at in found:
        out = []
        covered = kinds_of(runs, spans)
        starts, ends = [a for a, _ in runs], [z for _, z in runs]
        for s, kind, e in spans:
            own = p[at + bisect_right(ends, s):at + bisect_left(starts, e), kind]  # the runs that overlap the span
            out.append(((s, kind), {"kind": KINDS[kind], "start": s, "end": e, "probability": float(own.max()) if len(own) else None}))
        for j, (a, z) in enumerate(runs):
            over = p[at + j] >= model.thresholds
            if not covered[j] and over.any():
                kind = int(np.argmax(np.where(over, p[at + j], -1)))
                out.append(((a, len(KINDS) + kind), {"kind": f"net_{KINDS[kind]}", "start": a, "end": z, "probability": float(p[at + j, kind])}))
        result.append([x for _, x in sorted(out, key=lambda o: o[0])])
    return result

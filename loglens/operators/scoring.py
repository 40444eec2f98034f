"""Hybrid category scoring: similarity kernels, weighted scores, arg-max, score maps.

Plan shape.  The prototypes (taxonomy definitions, keywords and phrases, or a
table of any size) are written by tasks as blocks of bounded rows and bytes in
the shared folder (``operators/blocks.py``); only their categories and the list
of files reach the driver.  Sessions are never joined with them row by row:
per Arrow batch, a task goes through the blocks one after the other; one matrix
product per block gives every cosine, and a maximum per (category, kind) is
folded into three arrays per session (``phrase``, ``keyword``,
``definition``).  The weighting, prior boost, arg-max and score maps are then
JVM higher-order functions on those arrays, so scoring adds no shuffle and
keeps the session's other columns on the same row.

The work is sessions x prototypes, as the scores ask for; a task holds one
block and one Arrow batch, whatever the sizes of both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.operators.blocks import write_blocks

KINDS = ("phrase", "keyword", "definition")
# Cells of one (rows x prototypes) similarity block held in a Python worker.
MAX_BLOCK_CELLS = 16_000_000
AXES = ("domain", "intent")
# Prototypes of one block, by rows and by the bytes of the stored vectors.
BLOCK_PROTOS = 200_000
BLOCK_BYTES = 64 * 1024 * 1024


def round4(c: Column) -> Column:
    """Round to 4 places, half-up on the scaled value (same IEEE steps in any engine)."""
    return F.floor(c * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


@dataclass(frozen=True)
class Categories:
    """Category list of one axis, in taxonomy order."""

    axis: str
    codes: tuple[str, ...]
    ords: tuple[int, ...]


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that must stay small, in one job: at most ``max_rows``
    rows reach the driver, otherwise an error names the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows, the supported bound")
    return rows


def categories_of(rows):
    """Category lists per axis from collected prototype rows (validated)."""
    by_axis: dict[str, dict[str, tuple[int, set]]] = {a: {} for a in AXES}
    for r in rows:
        ent = by_axis[r["category_type"]].setdefault(r["code"], (r["ord"], set()))
        ent[1].add(r["kind"])
    cats = {}
    for axis, d in by_axis.items():
        items = sorted(d.items(), key=lambda kv: (kv[1][0], kv[0]))
        for code, (_, kinds) in items:
            missing = set(KINDS) - kinds
            if missing:
                raise ValueError(f"category {code} has no {sorted(missing)} prototypes")
        cats[axis] = Categories(axis, tuple(c for c, _ in items), tuple(o for _, (o, _) in items))
    return rows, cats


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0  # a zero vector stays zero, so its cosine with anything is 0
    return m / norms


def kernel_layout(rows, cats: dict[str, Categories]):
    """Prototype rows ordered by (axis, kind, category) and, per (axis, kind),
    the column span of every category (empty span: no prototype here)."""
    ordered, plan = [], []
    for axis in AXES:
        for kind in KINDS:
            spans = []
            for code in cats[axis].codes:
                lo = len(ordered)
                ordered.extend(
                    r for r in rows if r["category_type"] == axis and r["kind"] == kind and r["code"] == code
                )
                spans.append((lo, len(ordered)))
            plan.append((axis, kind, spans))
    return ordered, plan


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The unit rows of a list column of equal lengths."""
    lists = vectors.combine_chunks()
    sizes = pa.compute.unique(pa.compute.list_value_length(lists)).to_pylist()
    if len(sizes) != 1 or sizes[0] is None:
        raise ValueError(f"prototype vectors of different lengths: {sizes}")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(lists), sizes[0]))


def segment_max(sims: np.ndarray, spans) -> np.ndarray:
    out = np.full((sims.shape[0], len(spans)), -np.inf)
    nonempty = [i for i, (lo, hi) in enumerate(spans) if hi > lo]
    if nonempty:
        starts = np.asarray([spans[i][0] for i in nonempty], dtype=np.int64)
        # reduceat over consecutive non-empty spans: each runs to the next start
        ends = [spans[i][1] for i in nonempty]
        block = sims[:, starts[0]: ends[-1]]
        red = np.maximum.reduceat(block, starts - starts[0], axis=1)
        out[:, nonempty] = red
    return out


def sims_field(axis: str, kind: str) -> str:
    return f"{axis}_{kind}_sim"


def dense_similarities(
    df: DataFrame,
    protos: DataFrame,
    vec_col: str = "vec",
    proto_vec_col: str = "vec",
    max_broadcast_protos: int = BLOCK_PROTOS,
) -> tuple[DataFrame, dict[str, Categories]]:
    """Append ``{axis}_{kind}_sim`` arrays (max cosine per category) to ``df``.

    ``protos``: (category_type 'domain'|'intent', ord, code, kind, vec), of any
    number.  They are written in blocks of at most ``max_broadcast_protos``
    rows and ``BLOCK_BYTES``; each task folds the maxima of one block after the
    other into the arrays of its sessions.  The categories, one array element
    each, are known to the driver.
    """
    keys = ("category_type", "ord", "code", "kind")
    stored, found = write_blocks(protos.select(*keys, F.col(proto_vec_col).alias("vec")), max_broadcast_protos, BLOCK_BYTES, keys)
    _, cats = categories_of(sorted(found.collect(), key=lambda r: (r["ord"], r["code"])))
    groups = [(axis, kind, code) for axis in AXES for kind in KINDS for code in cats[axis].codes]
    group_no = {g: i for i, g in enumerate(groups)}
    spans, at = [], 0
    for axis in AXES:
        for kind in KINDS:
            spans.append((sims_field(axis, kind), at, at + len(cats[axis].codes)))
            at = spans[-1][2]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.ArrayType(T.DoubleType())) for n, _, _ in spans])

    def by_group(t: pa.Table):
        names = zip(*(t[c].to_pylist() for c in ("category_type", "kind", "code")))
        number = np.array([group_no.get(g, -1) for g in names], dtype=np.int64)
        order = np.argsort(number, kind="stable")
        order = order[number[order] >= 0]
        present, first = np.unique(number[order], return_index=True)
        return _matrix(t["vec"])[order], present, first

    def score(batches):
        blocks = stored.reader(by_group)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            v = _unit_rows(np.vstack([np.asarray(x, dtype=np.float64) for x in pdf[vec_col]]))
            best = np.full((len(v), len(groups)), -np.inf)
            for m, present, first in blocks():
                step = max(1, MAX_BLOCK_CELLS // max(1, m.shape[0]))
                for lo in range(0, len(v) if len(m) else 0, step):  # bounded (rows x prototypes) block
                    top = np.maximum.reduceat(v[lo: lo + step] @ m.T, first, axis=1)
                    best[lo: lo + step, present] = np.maximum(best[lo: lo + step, present], top)
            yield pdf.assign(**{name: list(best[:, lo:hi]) for name, lo, hi in spans})

    return df.mapInPandas(score, schema), cats


def hybrid_columns(
    cats: dict[str, Categories],
    prior_col: str | None = "domain_prior",
    weights: tuple[float, float, float] = (defaults.WEIGHT_PHRASE, defaults.WEIGHT_KEYWORD, defaults.WEIGHT_DEFINITION),
    boost: float = defaults.METADATA_BOOST,
) -> dict[str, Column]:
    """Unrounded hybrid score arrays per axis (``domain_scores``, ``intent_scores``).

    score = w_p * max phrase cos + w_k * max keyword cos + w_d * definition cos;
    a domain whose code equals the session's prior is multiplied by ``boost``
    and capped at 1.0 (intents get no prior).
    """
    wp, wk, wd = weights
    out = {}
    for axis in AXES:
        p, k, d = (F.col(sims_field(axis, kind)) for kind in KINDS)
        raw = F.zip_with(
            F.zip_with(p, k, lambda a, b: a * F.lit(wp) + b * F.lit(wk)), d, lambda ab, c: ab + c * F.lit(wd)
        )
        if axis == "domain" and prior_col is not None:
            codes = F.array(*[F.lit(c) for c in cats[axis].codes])
            prior = F.col(prior_col)
            raw = F.transform(
                raw,
                lambda s, i: F.when(prior.isNotNull() & (prior == F.element_at(codes, i + 1)),
                                    F.least(s * F.lit(boost), F.lit(1.0))).otherwise(s),
            )
        out[f"{axis}_scores"] = raw
    return out


def with_hybrid_scores(df: DataFrame, cats: dict[str, Categories], prior_col: str | None = "domain_prior", **kw) -> DataFrame:
    for name, c in hybrid_columns(cats, prior_col, **kw).items():
        df = df.withColumn(name, c)
    return df


def with_best_category(df: DataFrame, cats: dict[str, Categories]) -> DataFrame:
    """Arg-max per axis (first category in taxonomy order on ties), rounded
    confidences, combined confidence from the unrounded scores, score maps."""
    for axis in AXES:
        codes = F.array(*[F.lit(c) for c in cats[axis].codes])
        scores = F.col(f"{axis}_scores")
        best = F.array_max(scores)
        pos = F.array_position(scores, best)
        df = (
            df.withColumn(f"_{axis}_best", best)
            .withColumn(f"predicted_{axis}", F.element_at(codes, pos.cast("int")))
            .withColumn(f"all_{axis}_scores", F.map_from_arrays(codes, F.transform(scores, round4)))
        )
    return (
        df.withColumn("combined_confidence", round4((F.col("_domain_best") + F.col("_intent_best")) / 2))
        .withColumn("domain_confidence", round4(F.col("_domain_best")))
        .withColumn("intent_confidence", round4(F.col("_intent_best")))
        .drop("_domain_best", "_intent_best")
    )


def score_long(df: DataFrame, cats: dict[str, Categories], id_col: str = "session_id") -> DataFrame:
    """(id, category_type, code, score) rows from the score arrays (rounded),
    both axes in one ``explode`` (the row is read once)."""
    def tagged(axis):
        codes = F.array(*[F.lit(c) for c in cats[axis].codes])
        return F.transform(
            F.arrays_zip(codes.alias("code"), F.col(f"{axis}_scores").alias("score")),
            lambda z: F.struct(F.lit(axis).alias("category_type"), z["code"].alias("code"), z["score"].alias("score")),
        )

    parts = [tagged(axis) for axis in AXES]
    z = F.explode(F.concat(*parts)).alias("z")
    return df.select(id_col, z).select(id_col, "z.category_type", "z.code", round4(F.col("z.score")).alias("score"))


# ------------------------------------------------------------------ top-k
def _first_of_block(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values per row, the smaller column first where they are equal."""
    if k > 16:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    out, rows, left = np.empty((len(sims), k), dtype=np.int64), np.arange(len(sims)), sims.copy()
    for i in range(k):
        out[:, i] = left.argmax(axis=1)
        left[rows, out[:, i]] = -np.inf
    return out


def cosine_topk(
    df: DataFrame, protos: DataFrame, k: int, id_col: str = "session_id", vec_col: str = "vec",
    proto_id_col: str = "proto_id", max_broadcast_protos: int = BLOCK_PROTOS,
) -> DataFrame:
    """The ``k`` most similar prototypes per row: (id, rank, proto_id, cos).

    Ties on the cosine go to the smaller prototype id; a cosine that is no
    number comes last.  Prototypes of any number are written in blocks; each
    Arrow batch meets one block after the other and keeps its best ``k`` so
    far, so no pair rows are materialised.
    """
    stored, _ = write_blocks(protos.select(F.col(proto_id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), max_broadcast_protos, BLOCK_BYTES)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("rank", T.LongType()),
        T.StructField(proto_id_col, T.LongType()), T.StructField("cos", T.DoubleType()),
    ])

    def by_id(t: pa.Table):
        if t["id"].null_count:
            raise ValueError("a prototype has no id")
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], _matrix(t["vec"])[order]

    def top(batches):
        blocks = stored.reader(by_id)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            v = _unit_rows(np.vstack([np.asarray(x, dtype=np.float64) for x in pdf[vec_col]]))
            cos, pid = np.empty((len(v), 0)), np.empty((len(v), 0), dtype=np.int64)
            for ids, m in blocks():
                kk = min(k, len(ids))
                some_cos, some_pid = np.empty((len(v), kk)), np.empty((len(v), kk), dtype=np.int64)
                step = max(1, MAX_BLOCK_CELLS // max(1, m.shape[0]))
                for lo in range(0, len(v), step):  # bounded (rows x prototypes) block
                    sims = v[lo: lo + step] @ m.T
                    sims[np.isnan(sims)] = -2.0  # below every cosine
                    at = _first_of_block(sims, kk)
                    some_cos[lo: lo + step] = np.take_along_axis(sims, at, axis=1)
                    some_pid[lo: lo + step] = ids[at]
                cos, pid = np.hstack([cos, some_cos]), np.hstack([pid, some_pid])
                order = np.lexsort((pid, -cos), axis=-1)[:, :k]
                cos, pid = np.take_along_axis(cos, order, axis=1), np.take_along_axis(pid, order, axis=1)
            kk = cos.shape[1]
            yield pd.DataFrame({
                id_col: np.repeat(pdf[id_col].to_numpy(), kk),
                "rank": np.tile(np.arange(1, kk + 1, dtype=np.int64), len(v)),
                proto_id_col: pid.reshape(-1),
                "cos": np.where(cos == -2.0, np.nan, cos).reshape(-1),
            })

    return df.select(id_col, vec_col).mapInPandas(top, schema)

"""Replay evaluation of recorded model runs.

Column roles are detected from the column names (a driver-side decision, no
job): candidates in priority order, case-insensitive, and the input column
also serves as the retrieval query.  A metric applies when all its roles are
mapped.  The replay returns the
recorded output.  Per-record applicability (roles whose value is present in
that record) and a built-in token-overlap scorer are provided so that an
evaluation set can be built and checked without a remote judge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens import defaults

INPUT, QUERY, OUTPUT, TRUTH, CONTEXTS = (
    defaults.ROLE_INPUT, defaults.ROLE_QUERY, defaults.ROLE_OUTPUT, defaults.ROLE_TRUTH, defaults.ROLE_CONTEXTS,
)
ROLE_ALIASES = {INPUT: "input", QUERY: "query_text", OUTPUT: "output", TRUTH: "ground_truth", CONTEXTS: "contexts"}


# candidate column names, and the roles that the first one present serves
ROLE_SOURCES = (
    (defaults.INPUT_NAMES, (INPUT, QUERY)),
    (defaults.OUTPUT_NAMES, (OUTPUT,)),
    (defaults.GROUND_TRUTH_NAMES, (TRUTH,)),
    (defaults.CONTEXT_NAMES, (CONTEXTS,)),
)


def detect_columns(columns: Sequence[str]) -> dict[str, str]:
    """Role -> column name.  On names differing only in case, the last wins."""
    named = {c.lower(): c for c in columns}
    return {role: named[present[0]]
            for names, roles in ROLE_SOURCES if (present := [n for n in names if n in named])
            for role in roles}


def pick_metrics(mapping: dict[str, str]) -> list[str]:
    """The metrics all of whose roles have a column."""
    return [metric for metric, needs in defaults.METRIC_ROLES if mapping.keys() >= set(needs)]


def require_output(mapping: dict[str, str]) -> str:
    if OUTPUT not in mapping:
        raise ValueError(f"no column holds the recorded output; name it one of {', '.join(defaults.OUTPUT_NAMES)}")
    return mapping[OUTPUT]


def replay_frame(df: DataFrame, mapping: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Role columns under plain names; ``output`` is the replayed recorded
    output (missing -> '')."""
    mapping = mapping or detect_columns(df.columns)
    out_col = require_output(mapping)
    cols = [F.col(c) for c in keep]
    for role, alias in ROLE_ALIASES.items():
        if role == OUTPUT:
            cols.append(F.coalesce(F.col(f"`{out_col}`").cast("string"), F.lit("")).alias(alias))
        elif role in mapping:
            cols.append(F.col(f"`{mapping[role]}`").cast("string").alias(alias))
        else:
            cols.append(F.lit(None).cast("string").alias(alias))
    return df.select(*cols)


def record_metrics(df: DataFrame, mapping: dict[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., metric) for every metric whose roles all have a value in the
    record (coherence: the output has one)."""
    mapping = mapping or detect_columns(df.columns)

    def present(role):
        return F.col(f"`{mapping[role]}`").isNotNull() if role in mapping else F.lit(False)

    tags = []
    for metric, req in defaults.METRIC_ROLES:
        cond = None
        for r in req:
            cond = present(r) if cond is None else cond & present(r)
        tags.append(F.when(cond, F.lit(metric)))
    return df.select(*keep, F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("metric"))


# ------------------------------------------------------- built-in scorer
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def overlap_scores(replayed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Token-overlap scores in [0, 1] (ours, not a judge model):
    correctness = |out ∩ truth| / |truth|; answer_relevance = |out ∩ in| / |in|;
    context_relevance = |ctx ∩ query| / |query|; groundedness = |out ∩ ctx| / |out|;
    coherence = distinct / total output tokens.  Metrics not in ``metrics`` are NULL."""
    from loglens.operators.scoring import round4

    t = {a: token_set(F.col(a)) for a in ("input", "query_text", "output", "ground_truth", "contexts")}
    all_out = F.size(F.regexp_extract_all(F.lower(F.col("output")), F.lit(TOKEN_PATTERN), 0))
    exprs = {
        "correctness": _ratio(F.size(F.array_intersect(t["output"], t["ground_truth"])), F.size(t["ground_truth"])),
        "answer_relevance": _ratio(F.size(F.array_intersect(t["output"], t["input"])), F.size(t["input"])),
        "context_relevance": _ratio(F.size(F.array_intersect(t["contexts"], t["query_text"])), F.size(t["query_text"])),
        "groundedness": _ratio(F.size(F.array_intersect(t["output"], t["contexts"])), F.size(t["output"])),
        "coherence": _ratio(F.size(t["output"]), all_out),
    }
    cols = [round4(exprs[m]).alias(m) if m in metrics else F.lit(None).cast("double").alias(m) for m, _ in defaults.METRIC_ROLES]
    return replayed.select("*", *cols)

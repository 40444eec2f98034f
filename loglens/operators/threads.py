"""E-mail thread review: findings gathered per thread, and the ordered fold.

* Batch with known model outputs (one JSON text per e-mail): the findings of
  a thread are the concatenation, in e-mail order, of each list, and the
  running summary is ``'' + '\\n' + summary_update`` per e-mail.  No state is
  needed, so this is a plain group-by (``collect_list`` combines map-side).
  An output that is not a JSON object of the expected shape (including empty
  text) is rejected as a whole and reported; the thread's state is untouched.
* Live fold (a completion function in the loop): each prompt contains the
  state left by the previous e-mail, so one thread is processed in order.
  Rows are hash-partitioned by thread and sorted inside partitions; one
  streaming pass carries the state, holding one thread's state at a time (not
  its e-mails).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.operators.completion import fill
from loglens.operators.gather import PIECE_ROWS, gathered, ordered_pieces

LIST_KEYS = [k for k, _ in defaults.FINDING_LIST_KEYS]
LIST_NAMES = [n for _, n in defaults.FINDING_LIST_KEYS]
FINDING_SCHEMA = T.StructType(
    [T.StructField(k, T.ArrayType(T.StringType())) for k in LIST_KEYS] + [T.StructField(defaults.FINDING_SUMMARY_KEY, T.StringType())]
)


def read_finding(text: str | None) -> dict:
    """A model output as a finding: the one meaning shared by the batch job, the
    live fold and the stream.  It must be a JSON object and nothing else, its lists
    lists (or null, or absent) and its summary text; else ``ValueError``.  Items
    that are not text are kept as their JSON text."""
    found = json.loads(text or "")
    if not isinstance(found, dict):
        raise ValueError("output is not a JSON object")
    out = {}
    for key in LIST_KEYS:
        items = found.get(key)
        if not isinstance(items, (list, type(None))):
            raise ValueError(f"{key} is not a list")
        out[key] = [x if x is None or isinstance(x, str) else json.dumps(x) for x in items or []]
    update = found.get(defaults.FINDING_SUMMARY_KEY)
    if not isinstance(update, (str, type(None))):
        raise ValueError(f"{defaults.FINDING_SUMMARY_KEY} is not text")
    out[defaults.FINDING_SUMMARY_KEY] = update or ""
    return out


def _finding_or_none(text: str | None) -> dict | None:
    try:
        return read_finding(text)
    except (ValueError, RecursionError):  # no JSON, another shape, or nested too deep to be read
        return None


def parse_findings(df: DataFrame, out_col: str = "out") -> DataFrame:
    """Adds ``finding`` (struct, NULL where the output is unusable) and ``parsed_ok``."""
    kind = pa.struct([(k, pa.list_(pa.string())) for k in LIST_KEYS] + [(defaults.FINDING_SUMMARY_KEY, pa.string())])

    @F.arrow_udf(FINDING_SCHEMA)
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([_finding_or_none(x) for x in texts.to_pylist()], kind)

    return df.withColumn("finding", parsed(F.col(out_col))).withColumn("parsed_ok", F.col("finding").isNotNull())


def thread_findings(outputs: DataFrame, id_col: str = "thread_id", order_col: str = "email_no", out_col: str = "out") -> DataFrame:
    """(thread, commitments, monetary_mentions, deadlines, legal_triggers,
    escalation_flags, summary) from per-e-mail model outputs."""
    p = parse_findings(outputs, out_col)
    ok = F.when(F.col("parsed_ok"), F.struct(F.col(order_col).alias("k"), F.col("finding").alias("f")))
    g = p.groupBy(id_col).agg(F.array_sort(F.collect_list(ok)).alias("_ok"))
    def gathered(key):
        return F.flatten(F.transform("_ok", lambda x: F.coalesce(x["f"][key], F.array().cast("array<string>"))))

    cols = [gathered(k).alias(name) for k, name in defaults.FINDING_LIST_KEYS]
    summary = F.array_join(F.transform("_ok", lambda x: F.concat(F.lit("\n"), F.coalesce(x["f"][defaults.FINDING_SUMMARY_KEY], F.lit("")))), "")
    return g.select(id_col, *cols, summary.alias("summary"))


def finding_pieces(found: DataFrame, id_col: str = "thread_id", order_col: str = "email_no", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(thread, piece, of, <the five lists>, summary) from per-e-mail findings (the five lists, and the summary update,
    null where the output was rejected): a long thread's findings are gathered by several tasks, in numbered pieces."""
    update = defaults.FINDING_SUMMARY_KEY
    pieces = ordered_pieces(found, id_col, [order_col], F.struct(*LIST_NAMES, update), piece_rows)

    def flat(name):
        return F.flatten(F.transform("items", lambda x: F.coalesce(x[name], F.array().cast("array<string>")))).alias(name)

    lists = [flat(n) for n in LIST_NAMES]
    known = F.filter(F.transform("items", lambda x: x[update]), lambda u: u.isNotNull())
    return pieces.select(id_col, "piece", "of", *lists, F.array_join(F.transform(known, lambda u: F.concat(F.lit("\n"), u)), "").alias("summary"))


def joined_findings(pieces: DataFrame, id_col: str = "thread_id") -> DataFrame:
    """The pieces of every thread as one row, as ``thread_findings`` returns it."""
    return gathered(pieces, id_col, {**dict.fromkeys(LIST_NAMES, "list"), "summary": "text"})


def thread_finding_pieces(outputs: DataFrame, id_col: str = "thread_id", order_col: str = "email_no", out_col: str = "out",
                          piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``finding_pieces`` of per-e-mail model outputs."""
    f = F.col("finding")
    update = F.when(F.col("parsed_ok"), F.coalesce(f[defaults.FINDING_SUMMARY_KEY], F.lit("")))
    found = parse_findings(outputs, out_col).select(id_col, order_col, *[f[k].alias(n) for k, n in defaults.FINDING_LIST_KEYS], update.alias(defaults.FINDING_SUMMARY_KEY))
    return finding_pieces(found, id_col, order_col, piece_rows)


def finding_rejects(outputs: DataFrame, out_col: str = "out") -> DataFrame:
    """E-mails whose output could not be used (reported, never dropped silently)."""
    return parse_findings(outputs, out_col).where(~F.col("parsed_ok")).drop("finding", "parsed_ok")


def _json_string_list(arr: Column, indent: str) -> Column:
    """JSON list of strings laid out like ``json.dumps(..., indent=2)``."""
    quoted = F.transform(arr, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"^\[(.*)\]$", 1))
    body = F.array_join(F.transform(quoted, lambda q: F.concat(F.lit(indent + "  "), q)), ",\n")
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), body, F.lit("\n" + indent + "]")))


def findings_json(names=LIST_NAMES) -> Column:
    """The gathered lists as an indented JSON object (2 spaces)."""
    fields = [F.concat(F.lit(f'  "{n}": '), _json_string_list(F.col(n), "  ")) for n in names]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))


def frame(system: str, user: Column) -> Column:
    return fill(defaults.CHAT_FRAME, system=F.lit(system), user=user)


def report_prompt(findings: DataFrame) -> DataFrame:
    """Final-conclusion prompt per thread from its summary and findings."""
    user = fill(defaults.FINDINGS_REPORT_MESSAGE, summary=F.col("summary"), findings=findings_json())
    return findings.withColumn("report_prompt", frame(defaults.FINDINGS_SYSTEM_MESSAGE, user))


def thread_reports(findings: DataFrame, fn=None, completion_factory=None) -> DataFrame:
    """Final conclusion per thread: the report prompt and its completion."""
    from loglens.operators.completion import complete

    return complete(report_prompt(findings), "report_prompt", "conclusion", fn, completion_factory, catch_errors=False)


# ----------------------------------------------------------------- live fold
def _frame_py(system: str, user: str) -> str:
    return defaults.CHAT_FRAME.format(system=system, user=user)


def fold_threads(
    emails: DataFrame,
    fn: Callable[[str], str] | None = None,
    completion_factory: Callable[[], Callable[[str], str]] | None = None,
    flavour: str = "summary",
    id_col: str = "thread_id",
    order_col: str = "email_no",
    text_col: str = "body",
) -> DataFrame:
    """Ordered per-thread fold with a completion function in the loop.

    ``flavour='summary'``: the state is the running summary, replaced by the
    (stripped) completion of each e-mail's prompt, starting from the initial
    text.  ``flavour='findings'``: the completion must be a JSON object; its
    lists are appended to the thread's lists and its ``summary_update`` to the
    running summary; an unusable output leaves the state as it was and is
    reported in ``error``.  Without a function, ``default_step`` answers.

    Output per e-mail: (thread, email, prompt, output, ok, error, summary,
    findings_json) where summary/findings are the state after the e-mail.
    """
    if flavour not in ("summary", "findings"):
        raise ValueError("flavour must be 'summary' or 'findings'")
    id_type = emails.schema[id_col].dataType
    order_type = emails.schema[order_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField(order_col, order_type),
        T.StructField("prompt", T.StringType()), T.StructField("output", T.StringType()),
        T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()),
        T.StructField("summary", T.StringType()), T.StructField("findings_json", T.StringType()),
    ])
    rows = emails.select(id_col, order_col, text_col).repartition(id_col).sortWithinPartitions(id_col, order_col)

    def run(batches):
        call = completion_factory() if completion_factory is not None else fn or default_step(flavour)
        current, summary, lists = object(), None, None
        for pdf in batches:
            out = {k: [] for k in schema.fieldNames()}
            for tid, no, body in zip(pdf[id_col], pdf[order_col], pdf[text_col]):
                if tid != current:
                    current = tid
                    summary = defaults.SUMMARY_INITIAL_STATE if flavour == "summary" else ""
                    lists = {n: [] for n in LIST_NAMES}
                if flavour == "summary":
                    prompt = _frame_py(defaults.SUMMARY_SYSTEM_MESSAGE, defaults.SUMMARY_USER_MESSAGE.format(summary=summary, email=body))
                else:
                    prompt = _frame_py(defaults.FINDINGS_SYSTEM_MESSAGE, defaults.FINDINGS_USER_MESSAGE.format(summary=summary, email=body))
                text = call(prompt)
                text = text.strip() if isinstance(text, str) else ""
                ok, err = True, None
                if flavour == "summary":
                    summary = text
                else:
                    try:
                        found = read_finding(text)
                    except (ValueError, RecursionError) as e:  # reported per e-mail, the state stays
                        ok, err = False, f"{type(e).__name__}: {e}"
                    else:
                        for key, name in defaults.FINDING_LIST_KEYS:
                            lists[name] += found[key]
                        summary += "\n" + found[defaults.FINDING_SUMMARY_KEY]
                out[id_col].append(tid)
                out[order_col].append(no)
                out["prompt"].append(prompt)
                out["output"].append(text)
                out["ok"].append(ok)
                out["error"].append(err)
                out["summary"].append(summary)
                out["findings_json"].append(json.dumps(lists, indent=2) if flavour == "findings" else None)
            if out[id_col]:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def prompt_length_completion(prompt: str) -> str:
    """Deterministic stand-in for a model in the fold: depends on the whole
    prompt, and hence on the previous state."""
    return f"summary of {len(prompt)} chars"


def prompt_length_finding(prompt: str) -> str:
    """The findings counterpart: a usable output that depends on the whole prompt,
    and an unusable one for every prompt whose length is a multiple of seven."""
    if len(prompt) % 7 == 0:
        return f"nothing usable in {len(prompt)} chars"
    return json.dumps({"deadlines": [f"d{len(prompt)}"], "new_commitments": [str(len(prompt) % 10)] if len(prompt) % 2 else None,
                       defaults.FINDING_SUMMARY_KEY: f"read {len(prompt)} chars"})


def default_step(flavour: str) -> Callable[[str], str]:
    """What stands in for the model where the fold is given none."""
    return {"summary": prompt_length_completion, "findings": prompt_length_finding}[flavour]


def fold_reports(steps: DataFrame, fn=None, completion_factory=None, id_col: str = "thread_id", order_col: str = "email_no") -> DataFrame:
    """(thread, summary, findings_json, report_prompt, conclusion): the closing report
    of every thread from the state after its last e-mail (findings flavour)."""
    from loglens.operators.completion import complete

    last = steps.groupBy(id_col).agg(F.max_by(F.struct("summary", "findings_json"), order_col).alias("s")).select(id_col, "s.*")
    user = fill(defaults.FINDINGS_REPORT_MESSAGE, summary=F.col("summary"), findings=F.col("findings_json"))
    return complete(last.withColumn("report_prompt", frame(defaults.FINDINGS_SYSTEM_MESSAGE, user)), "report_prompt", "conclusion", fn, completion_factory, catch_errors=False)

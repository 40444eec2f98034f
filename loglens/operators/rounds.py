"""The ordered fold of e-mail threads in rounds: a frontier over all threads instead of a task per thread.

A thread's prompts depend on each other, so its e-mails are answered in order; different threads don't.  The e-mails
are written once as segments of at most ``per_round`` e-mails, by round; round r takes the r-th segment of every
thread that has one, joins the thread's state from the table that round r - 1 wrote, and writes the answers with the
new state.  So

* the model is called for many threads at once: a segment's first e-mails of all threads in an Arrow batch form one
  call, then their second ones, and so on (a client with a batch interface gets the whole list);
* a task holds a batch of segments, however long a thread is, and a lost executor repeats tasks of one round;
* a run that was killed goes on where it stopped: rounds whose folder is complete are not computed again;
* a long thread holds up nobody: it only has more rounds, and the later rounds read only what is left.

The table of answers grows linearly with the e-mails: each holds what its e-mail added, not the state so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens import defaults
from loglens.config import ship_package
from loglens.operators import threads
from loglens.operators.gather import PIECE_ROWS, ordered_pieces

PER_ROUND = 16
#: threads whose segments are answered together
TOGETHER = 64
STEP = "output:string,ok:boolean,error:string,update:string," + ",".join(f"{n}:array<string>" for n in threads.LIST_NAMES)


def complete_folder(spark: SparkSession, folder: str) -> bool:
    """Whether a write to this folder was finished."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_segments(emails: DataFrame, folder: str, id_col: str = "thread_id", order_col: str = "email_no", text_col: str = "body",
                   per_round: int = PER_ROUND, piece_rows: int = PIECE_ROWS) -> None:
    """The e-mails as (thread, mails) below ``folder/round=r``, the r-th at most ``per_round`` e-mails of every thread.
    Threads longer than ``piece_rows`` are put in order by several tasks."""
    rows = emails.select(F.col(id_col).alias("thread"), F.col(order_col).alias("email"), F.col(text_col).alias("body"))
    pieces = ordered_pieces(rows, "thread", ["email"], F.struct("email", "body"), piece_rows)
    pieces = pieces.withColumn("n", F.ceil(F.size("items") / F.lit(per_round)).cast("long"))
    # pieces of a large thread differ in length; each starts at the round after its predecessor's last one
    before = Window.partitionBy("thread").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    split = pieces.where("of > 1")
    first = split.select(F.col("thread").alias("ft"), F.col("piece").alias("fp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    split = split.join(first, F.col("thread").eqNullSafe(F.col("ft")) & (F.col("piece") == F.col("fp"))).select("thread", "items", "n", "first")
    both = pieces.where("of = 1").select("thread", "items", "n", F.lit(0).cast("long").alias("first")).unionByName(split)
    cut = both.select("thread", "items", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    cut = cut.select("thread", F.slice("items", (F.col("k") * per_round + 1).cast("int"), per_round).alias("mails"), (F.col("first") + F.col("k")).alias("round"))
    cut.write.mode("overwrite").partitionBy("round").parquet(folder)


def _answer(flavour: str, call_all: Callable[[list[str]], list[str]], mails: list[list[dict]], states: list[str]) -> tuple[list[list[dict]], list[str]]:
    """The steps of segments that are answered side by side, and the states after them."""
    steps: list[list[dict]] = [[] for _ in mails]
    for k in range(max(map(len, mails), default=0)):
        live = [i for i, m in enumerate(mails) if len(m) > k]
        system, user = ((defaults.SUMMARY_SYSTEM_MESSAGE, defaults.SUMMARY_USER_MESSAGE) if flavour == "summary"
                        else (defaults.FINDINGS_SYSTEM_MESSAGE, defaults.FINDINGS_USER_MESSAGE))
        prompts = [threads._frame_py(system, user.format(summary=states[i], email=mails[i][k]["body"])) for i in live]
        said = call_all(prompts)
        if len(said) != len(prompts):
            raise ValueError(f"{len(said)} completions for {len(prompts)} prompts")
        for i, text in zip(live, said):
            text = text.strip() if isinstance(text, str) else ""
            step = {"email": mails[i][k]["email"], "output": text, "ok": True, "error": None, "update": text, **{n: [] for n in threads.LIST_NAMES}}
            if flavour == "summary":
                states[i] = text
            else:
                try:
                    found = threads.read_finding(text)
                except (ValueError, RecursionError) as e:  # reported per e-mail, the state stays
                    step |= {"ok": False, "error": f"{type(e).__name__}: {e}", "update": None}
                else:
                    step |= {name: found[key] for key, name in defaults.FINDING_LIST_KEYS} | {"update": found[defaults.FINDING_SUMMARY_KEY]}
                    states[i] += "\n" + step["update"]
            steps[i].append(step)
    return steps, states


def fold_in_rounds(
    emails: DataFrame,
    folder: str,
    fn: Callable[[str], str] | None = None,
    completion_factory: Callable[[], Callable[[str], str]] | None = None,
    batch_factory: Callable[[], Callable[[list[str]], list[str]]] | None = None,
    flavour: str = "summary",
    id_col: str = "thread_id",
    order_col: str = "email_no",
    text_col: str = "body",
    per_round: int = PER_ROUND,
    piece_rows: int = PIECE_ROWS,
    together: int = TOGETHER,
) -> DataFrame:
    """Ordered per-thread fold with a completion function in the loop; prompts, state and rejection of unusable
    outputs as in ``threads.fold_threads``.

    ``folder`` (shared by all executors) keeps the run; calling again with the same e-mails and settings after a
    failure resumes it.  One of ``fn``, ``completion_factory`` (made once per task) and ``batch_factory`` (made once
    per task, answers a list of prompts) is the model; without one, the fold's default step answers.

    Output per e-mail: (thread, email, output, ok, error, update, <the five lists>): what the e-mail added.  With
    ``flavour='summary'`` ``update`` is the summary after the e-mail, with ``'findings'`` the line that it adds (null
    where the output was rejected).  Rows with a null e-mail text are answered like an empty text; a null thread is
    a thread like any other; e-mails that share a number come by a hash of their text.
    """
    if flavour not in ("summary", "findings"):
        raise ValueError("flavour must be 'summary' or 'findings'")
    spark = emails.sparkSession
    ship_package(spark)
    folder = folder.rstrip("/")
    kind, number = (emails.schema[c].dataType.simpleString() for c in (id_col, order_col))
    if not complete_folder(spark, f"{folder}/segments"):
        write_segments(emails.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), f"{folder}/segments", id_col, order_col, text_col, per_round, piece_rows)
    initial = defaults.SUMMARY_INITIAL_STATE if flavour == "summary" else ""
    schema = f"thread {kind}, steps array<struct<email:{number},{STEP}>>, state string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batch_factory is not None:
            call_all = batch_factory()
        else:
            call = completion_factory() if completion_factory is not None else fn or threads.default_step(flavour)
            call_all = lambda prompts: [call(p) for p in prompts]
        for b in batches:
            for i in range(0, b.num_rows, together):
                part = b.slice(i, together)
                email = part["mails"].type.value_type.field("email").type
                steps, states = _answer(flavour, call_all, part["mails"].to_pylist(), part["state"].to_pylist())
                fields = [("email", email), ("output", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("update", pa.string())]
                item = pa.struct(fields + [(n, pa.list_(pa.string())) for n in threads.LIST_NAMES])
                yield pa.RecordBatch.from_arrays([part["thread"], pa.array(steps, pa.list_(item)), pa.array(states, pa.string())], names=["thread", "steps", "state"])

    segments = spark.read.schema(f"thread {kind}, mails array<struct<email:{number},body:string>>, round long").parquet(f"{folder}/segments")
    last = segments.agg(F.max("round")).first()[0]
    for r in range(0 if last is None else last + 1):
        done = f"{folder}/rounds/round={r}"
        if complete_folder(spark, done):
            continue
        mails = segments.where(F.col("round") == r).select("thread", "mails")  # reads this round's folder only
        if r:
            state = spark.read.parquet(f"{folder}/rounds/round={r - 1}").select(F.col("thread").alias("t"), "state")
            mails = mails.join(state, F.col("thread").eqNullSafe(F.col("t")), "left").select("thread", "mails", "state")
        else:
            mails = mails.withColumn("state", F.lit(initial))
        mails.mapInArrow(run, schema).write.mode("overwrite").parquet(done)
    rounds = spark.read.schema(f"{schema}, round long").parquet(f"{folder}/rounds") if last is not None else spark.createDataFrame([], schema)
    steps = rounds.select(F.col("thread").alias(id_col), F.explode("steps").alias("s"))
    return steps.select(id_col, F.col("s.email").alias(order_col), *[F.col(f"s.{n}") for n in ("output", "ok", "error", "update", *threads.LIST_NAMES)])


def final_states(spark: SparkSession, folder: str, id_col: str = "thread_id") -> DataFrame:
    """(thread, summary) after the last e-mail of every thread, from a finished run's folder."""
    rounds = spark.read.parquet(f"{folder.rstrip('/')}/rounds")
    return rounds.groupBy(F.col("thread").alias(id_col)).agg(F.max_by("state", "round").alias("summary"))


def fold_reports(spark: SparkSession, folder: str, steps: DataFrame, fn=None, completion_factory=None, id_col: str = "thread_id",
                 order_col: str = "email_no", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(thread, summary, <lists>, report_prompt, conclusion): the closing report of every thread (findings flavour)."""
    from loglens.operators.completion import complete

    found = threads.finding_pieces(steps.withColumnRenamed("update", defaults.FINDING_SUMMARY_KEY), id_col, order_col, piece_rows)
    lists = threads.joined_findings(found, id_col).drop("summary")
    summaries = final_states(spark, folder, id_col).withColumnRenamed(id_col, "t")
    both = lists.join(summaries, F.col(id_col).eqNullSafe(F.col("t"))).drop("t")
    return complete(threads.report_prompt(both), "report_prompt", "conclusion", fn, completion_factory, catch_errors=False)


def digest_finding(prompt: str) -> str:
    """Deterministic stand-in for a model: a usable output that depends on every character of the prompt, and an
    unusable one for about an eighth of the prompts."""
    import hashlib
    import json

    h = hashlib.md5(prompt.encode()).hexdigest()
    if h[0] in "01":
        return f"nothing usable: {h}"
    return json.dumps({"deadlines": [f"d{h[1:5]}"], "new_commitments": [h[5:8], h[8:10]] if h[10] < "8" else None,
                       defaults.FINDING_SUMMARY_KEY: f"read {h[:8]}"})

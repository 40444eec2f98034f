"""Streaming thread findings: model outputs folded per thread as they arrive.

Outputs are read like in the batch job.  The state of a thread is the number of
its last folded e-mail; what a micro-batch adds to a thread leaves as one
``delta`` row (the items and summary text of its usable outputs, in e-mail
order), so the output is linear in the input, and ``gathered`` puts the deltas of
a thread together when they are read.  A mail whose number is not after the last
one folded for its thread (numbers may be any integers) arrives late and cannot
be folded retroactively: it is reported with kind ``late``; unusable outputs are
reported with kind ``rejected``.  Default API: ``applyInPandasWithState``
(``ttl_ms`` is a processing-time timeout of every thread); ``transformWithStateInPandas``
with RocksDB value state (``ttl_ms`` as state TTL) gives the same rows.

A call of the framework's grouped step costs milliseconds, so the default API
groups threads by ``buckets`` hashes of their ids and keeps the last numbers of a
bucket in one state (two or three arrays of integers); the null thread has a
bucket of its own.  Findings go to the step as JSON text: lists in a slice of an
Arrow batch are converted with the whole batch for every group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loglens import defaults
from loglens.config import ensure_checkpoint_dir
from loglens.operators import threads

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTS = threads.LIST_NAMES
#: hashes of thread ids, fixed for the life of a stream
BUCKETS = 4096
#: the threads of a bucket in order, their last numbers and when they were last seen (int64 arrays)
STATE_SCHEMA = T.StructType([T.StructField(c, T.BinaryType()) for c in ("threads", "last_emails", "seen_ms")])
LAST_SCHEMA = T.StructType([T.StructField("last_email", T.LongType())])
OUTPUT_SCHEMA = T.StructType(
    [T.StructField("thread_id", T.LongType()), T.StructField("kind", T.StringType()),
     T.StructField("email_no", T.LongType()), T.StructField("summary", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS]
)
OUTPUT_COLUMNS = [f.name for f in OUTPUT_SCHEMA.fields]


def _folder(list_keys, list_names, summary_key, out_cols):
    """(null thread?, threads, their last numbers, rows) -> (threads of the rows, their
    last numbers now, output frame).  Built from plain values only, so that it is
    shipped by value: the streaming runner that calls it does not import this package."""

    def fold(null, known, lasts, batch):
        import json

        import numpy as np
        import pandas as pd

        if batch["email_no"].isna().any():
            raise ValueError("an e-mail without a number")
        thread, number = batch["thread_id"].to_numpy(dtype=np.int64), batch["email_no"].to_numpy(dtype=np.int64)
        order = np.lexsort((number, thread))  # stable
        thread, number, findings = thread[order], number[order], batch["finding"].to_numpy()[order]
        first = np.r_[True, thread[1:] != thread[:-1]]
        starts = np.flatnonzero(first)
        ends, of = np.r_[starts[1:], len(thread)], np.cumsum(first) - 1
        threads = thread[starts]
        at = np.searchsorted(known, threads)
        old = at < len(known)
        old[old] = known[at[old]] == threads[old]
        last = number[ends - 1].copy()
        before = last.copy()
        before[old] = lasts[at[old]]
        last[old] = np.maximum(last[old], before[old])
        late = old[of] & (number <= before[of])
        late[1:] |= ~first[1:] & (number[1:] == number[:-1])
        blank, out = (None,) * len(list_names), []
        for g, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())):
            thread_id = None if null else int(threads[g])
            added, texts = [[] for _ in list_names], []
            for j in range(a, z):
                if late[j]:
                    out.append((thread_id, "late", int(number[j]), None, *blank))
                elif not isinstance(findings[j], str):
                    out.append((thread_id, "rejected", int(number[j]), None, *blank))
                else:
                    found = json.loads(findings[j])
                    for items, key in zip(added, list_keys):
                        items.extend(found.get(key) or ())
                    texts.append("\n" + (found.get(summary_key) or ""))
            # a thread is known by its first row even if nothing in it was usable
            out.append((thread_id, "delta", int(last[g]), "".join(texts), *added))
        return threads, last, pd.DataFrame(out, columns=out_cols)

    return fold


def _fold():
    return _folder([k for k, _ in defaults.FINDING_LIST_KEYS], list(LISTS), defaults.FINDING_SUMMARY_KEY, list(OUTPUT_COLUMNS))


def make_processor(ttl_ms: int | None = None) -> StatefulProcessor:
    """The stateful step for ``transformWithStateInPandas``, a thread at a time."""
    fold, state_schema = _fold(), LAST_SCHEMA

    class ThreadFindingsProcessor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("findings", state_schema, ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            batch = pd.concat(list(rows), ignore_index=True)
            last = [int(self.state.get()[0])] if self.state.exists() else []
            known = batch["thread_id"].to_numpy(dtype=np.int64)[:len(last)]
            _, last, out = fold(key[0] is None, known, np.array(last, dtype=np.int64), batch)
            self.state.update((int(last[0]),))
            yield out

        def close(self) -> None:
            pass

    return ThreadFindingsProcessor()


def _fold_bucket(fold, ttl_ms):
    """Per-bucket step for ``applyInPandasWithState``.  A thread's time is up as if it had a state of its own: in the
    first micro-batch after it in which the thread has no mail."""

    def step(key, pdfs, state):
        import numpy as np
        import pandas as pd

        empty = np.zeros(0, dtype=np.int64)
        known, lasts, seen = [np.frombuffer(bytes(x), dtype=np.int64) for x in state.get] if state.exists else (empty, empty, empty)
        now = state.getCurrentProcessingTimeMs() if ttl_ms else 0
        threads = last = empty
        if not state.hasTimedOut:
            frames = list(pdfs)
            threads, last, out = fold(key[0] < 0, known, lasts, frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True))
            yield out
        stays = ~np.isin(known, threads)
        if ttl_ms:
            stays &= seen + ttl_ms > now
        known, lasts = np.r_[known[stays], threads], np.r_[lasts[stays], last]
        seen = np.r_[seen[stays], np.full(len(threads), now, dtype=np.int64)]
        if not len(known):
            state.remove()
            return
        order = known.argsort()
        state.update(tuple(x[order].tobytes() for x in (known, lasts, seen)))
        if ttl_ms:
            state.setTimeoutDuration(max(1, int(seen.min()) + ttl_ms - now))

    return step


def gathered(rows: DataFrame) -> DataFrame:
    """(thread_id, the lists, summary) from the stream's output rows: the deltas of
    each thread in e-mail order."""
    delta = F.struct(F.col("email_no").alias("k"), *[F.col(n) for n in LISTS], "summary")
    parts = rows.where("kind = 'delta'").groupBy("thread_id").agg(F.array_sort(F.collect_list(delta)).alias("d"))
    lists = [F.flatten(F.col("d").getField(n)).alias(n) for n in LISTS]  # a field of an array of structs: its values
    return parts.select("thread_id", *lists, F.array_join(F.col("d").getField("summary"), "").alias("summary"))


def _parsed_rows(outputs: DataFrame, id_col: str) -> DataFrame:
    """(thread, thread_id, email_no, finding): the finding as JSON text, null where the output is unusable; the number
    of the null thread is 0, ``thread`` tells it."""
    p = threads.parse_findings(outputs)
    thread = p[id_col].cast("long")
    return p.select(thread.alias("thread"), F.coalesce(thread, F.lit(0)).alias("thread_id"), p["email_no"].cast("long").alias("email_no"),
                    F.to_json("finding").alias("finding"))


def thread_findings_stream(outputs: DataFrame, ttl_ms: int | None = None, id_col: str = "thread_id",
                           api: str = "applyInPandasWithState", buckets: int = BUCKETS) -> DataFrame:
    """Streaming (thread_id, email_no, out) -> OUTPUT_SCHEMA rows (append).

    ``api='applyInPandasWithState'`` (default) passes the state of ``buckets``
    groups of threads with their Arrow groups; ``'transformWithStateInPandas'`` uses the
    newer processor API with RocksDB value state per thread.  Both give the same rows."""
    rows = _parsed_rows(outputs, id_col)
    if api == "transformWithStateInPandas":
        spark = outputs.sparkSession
        if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        return rows.groupBy("thread").transformWithStateInPandas(make_processor(ttl_ms), OUTPUT_SCHEMA, "Append", "None")
    timeout = "ProcessingTimeTimeout" if ttl_ms else "NoTimeout"
    bucket = F.when(F.col("thread").isNull(), -1).otherwise(F.pmod(F.xxhash64("thread"), F.lit(buckets))).cast("long")
    rows = rows.select(bucket.alias("bucket"), "thread_id", "email_no", "finding")
    return rows.groupBy("bucket").applyInPandasWithState(_fold_bucket(_fold(), ttl_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def start_thread_stream(spark: SparkSession, source_dir: str, out_dir: str, ttl_ms: int | None = None,
                        max_files_per_trigger: int = 50, name: str = "thread_findings",
                        api: str = "applyInPandasWithState") -> StreamingQuery:
    schema = "thread_id long, email_no int, out string"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    # stable per stream name, so a restarted stream resumes where it stopped
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return (thread_findings_stream(src, ttl_ms, api=api).writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).queryName(name).start())

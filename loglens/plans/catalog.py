"""The query catalogue: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole driver tables (through the fixture views of
:mod:`loglens.plans.fixtures`) and returns flat, aliased columns whose names
match the oracle SQL of :mod:`loglens.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens import defaults
from loglens.functions.text import explode_positions
from loglens.operators import chunking, completion, email, encoders, html_text, imports, lexical, long_documents, pruned_topk, replay, rounds, routing, scoring, sessions, threads
from loglens.plans import classify
from loglens.plans import fixtures as fx
from loglens.sources import documents, taxonomy
from loglens.sources import logs as log_source
from loglens.sources.tables import table
from loglens.streaming import thread_state
from loglens.streaming import alerts as stream_alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------- sessions (F1)
def _normalised(spark, sf_dir):
    return sessions.normalise_logs(fx.logs(spark, sf_dir))


def _sessions(spark, sf_dir):
    return sessions.build_sessions(_normalised(spark, sf_dir))


@query
def log_normalise(spark, sf_dir):
    return _normalised(spark, sf_dir).select(
        "session_id", "seq", "username", "prompt", "co", "user_type", "division",
        "query_timestamp", "prompt_token_count", "is_short_prompt",
    )


@query
def log_files(spark, sf_dir):
    """F1 written as CSV and as JSON lines and read back by the checked reader, with what it rejected (nothing)."""
    folder, out = _run_folder(spark, "log_files"), None
    src = fx.logs(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string")).withColumn("seq", F.col("seq").cast("long"))
    for fmt in ("csv", "json"):
        log_source.write_logs(src, f"{folder}/{fmt}", fmt)
        got = log_source.read_logs_checked(spark, f"{folder}/{fmt}", fmt)
        rows = got.rows.select(F.lit(fmt).alias("fmt"), *log_source.LOG_SCHEMA.names)
        bad = got.rejects.select(F.lit(f"{fmt} rejected").alias("fmt"), *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "prompt" else F.col("raw").alias("prompt") for f in log_source.LOG_SCHEMA.fields])
        rows = rows.unionByName(bad)
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def merge_short_turns(spark, sf_dir):
    kept = sessions.merge_short_turns(_normalised(spark, sf_dir))
    return kept.select("session_id", F.col("rn").cast("bigint").alias("rn"), "merged_prompt")


@query
def session_prompt(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session_id", "combined_prompt")


@query
def session_rollup(spark, sf_dir):
    return _sessions(spark, sf_dir).select(
        "session_id", "username", "co", "user_type", "division", "turn_count", "first_timestamp", "last_timestamp"
    )


@query
def session_split(spark, sf_dir):
    """All session columns through the skew-aware builder; with a 3-turn
    threshold nearly every session takes the split (hot) path."""
    from loglens.operators.hot_sessions import build_sessions_skew_aware

    return build_sessions_skew_aware(_normalised(spark, sf_dir), hot_session_rows=3)


@query
def domain_prior(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session_id", "division", "domain_prior")


@query
def watchlist_hit(spark, sf_dir):
    s = routing.with_watchlist(_sessions(spark, sf_dir), words=fx.FIXTURE_WATCHLIST)
    return s.select("session_id", "watchlist_hit", "watchlist_reason")


# ------------------------------------------------------------ scoring (F2)


def _scored(spark, sf_dir):
    sims, cats = scoring.dense_similarities(fx.session_vecs(spark, sf_dir), fx.proto_vecs(spark, sf_dir))
    best = scoring.with_best_category(scoring.with_hybrid_scores(sims, cats), cats)
    return best, cats


@query
def cosine_topk(spark, sf_dir):
    top = scoring.cosine_topk(fx.session_vecs(spark, sf_dir), fx.proto_vecs(spark, sf_dir), k=3)
    return top.withColumn("cos", scoring.round4(F.col("cos")))


@query
def cosine_topk_pruned(spark, sf_dir):
    """The same top 3 over ordered blocks of prototypes, most of which need not be read."""
    top = pruned_topk.cosine_topk(fx.session_vecs(spark, sf_dir), fx.proto_vecs(spark, sf_dir), k=3, block_rows=64, pivots=16)
    return top.withColumn("cos", scoring.round4(F.col("cos")))


@query
def encoded_scores(spark, sf_dir):
    """Text to vector to score: user turns encoded by JVM feature hashing, passages by the same encoder as a Python
    callable, and the best cosine of every turn."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "user")
    turns = conv.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), encoders.hashed_vector(F.col("text")).alias("vec"))
    passages = encoders.encode_column(table(spark, sf_dir, "benchmark", "item_id", "text"), "text", "vec", encoders.signed_hashing_encoder())
    best = scoring.cosine_topk(turns, passages, k=1, id_col="turn_id", proto_id_col="item_id")
    return best.select("turn_id", scoring.round4(F.col("cos")).alias("cos"))


@query
def hybrid_scores(spark, sf_dir):
    best, cats = _scored(spark, sf_dir)
    return scoring.score_long(best, cats)


@query
def best_category(spark, sf_dir):
    best, _ = _scored(spark, sf_dir)
    return best.select(
        "session_id", "predicted_domain", "domain_confidence", "predicted_intent", "intent_confidence", "combined_confidence"
    )


@query
def score_map(spark, sf_dir):
    best, _ = _scored(spark, sf_dir)
    both = F.map_concat("all_domain_scores", "all_intent_scores")  # codes are distinct across axes
    return best.select("session_id", F.explode(both).alias("code", "score"))


def _routed(spark, sf_dir):
    best, _ = _scored(spark, sf_dir)
    return routing.route_confidence(best, high=fx.FIXTURE_HIGH, low=fx.FIXTURE_LOW)


@query
def confidence_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("session_id", "combined_confidence", "label_source")


@query
def label_distribution(spark, sf_dir):
    return routing.label_distribution(_routed(spark, sf_dir))


# ---------------------------------------------- taxonomy, governance, flagship


def _prototypes(spark, sf_dir):
    return taxonomy.flatten_categories(fx.benchmark_categories(spark, sf_dir))


def _matrix(spark):
    e = fx.matrix_entries(spark)
    return taxonomy.latest_per_pair(e, F.struct("list_no", "i"))


@query
def taxonomy_flatten(spark, sf_dir):
    return _prototypes(spark, sf_dir)


@query
def taxonomy_json(spark, sf_dir):
    """The taxonomy as one JSON document, read back through the JSON schema and flattened."""
    cats = fx.benchmark_categories(spark, sf_dir)
    item = F.struct("ord", F.struct("code", "name", "definition", "keywords", "phrases").alias("c"))
    def listed(axis):  # one element per category
        mine = F.array_sort(F.collect_list(F.when(F.col("category_type") == axis, item)))
        return F.transform(mine, lambda x: x["c"])

    doc = cats.agg(F.to_json(F.struct(listed("domain").alias("domains"), listed("intent").alias("intents"))).alias("json"))
    return taxonomy.flatten_taxonomy(taxonomy.parse_taxonomy(doc))


@query
def governance_matrix(spark, sf_dir):
    e = fx.order_flag_entries(spark, sf_dir)
    return taxonomy.latest_per_pair(e, F.struct("list_no", "i"))


@query
def lexical_scores(spark, sf_dir):
    """Best benchmark passage per document by lexical cosine (ties: smaller item_id)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    best = lexical.lexical_best(docs, "doc_id", "text", table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text")
    return best.select("doc_id", "item_id", scoring.round4(F.col("cos")).alias("cos"))


def _classified(spark, sf_dir):
    return classify.classify_logs(
        fx.logs(spark, sf_dir), fx.benchmark_prototypes(spark, sf_dir), _matrix(spark),
        watchlist=fx.FIXTURE_WATCHLIST, high=fx.FLAGSHIP_HIGH, low=fx.FLAGSHIP_LOW,
    )


def flagship(spark, sf_dir):
    return _classified(spark, sf_dir).select(*defaults.OUTPUT_COLUMNS)


@query
def classify_logs(spark, sf_dir):
    return flagship(spark, sf_dir)


@query
def governance_flags(spark, sf_dir):
    return _classified(spark, sf_dir).select(
        "session_id", "predicted_domain", "predicted_intent", "label_source", "governance_flag", "governance_reason"
    )


@query
def llm_queue(spark, sf_dir):
    return routing.fallback_queue(_classified(spark, sf_dir)).select("session_id", "combined_confidence", "prompt_excerpt")


@query
def route_outputs(spark, sf_dir):
    return routing.route_outputs(_classified(spark, sf_dir)).select("sink", "session_id")


@query
def sink_files(spark, sf_dir):
    """The five outputs as they stand in the written files, all 18 columns; the run is written twice and read by its
    partition, another run beside it."""
    folder, done = _run_folder(spark, "sink_files"), flagship(spark, sf_dir).checkpoint()
    routing.write_outputs(done.limit(0), folder, "20240101_000000")
    for _ in range(2):
        routing.write_outputs(done, folder, "20240102_000000")
    return routing.read_outputs(spark, folder, done.schema, run_ts="20240102_000000").drop("run_ts")


@query
def run_summary(spark, sf_dir):
    turns = sessions.normalise_logs(fx.logs(spark, sf_dir))
    return routing.run_summary(_classified(spark, sf_dir), turns)


# ------------------------------------------------------- documents (F5)


def _doc_texts(spark, sf_dir):
    return documents.assemble_pages(fx.doc_pages(spark, sf_dir))


@query
def pages_assemble(spark, sf_dir):
    return _doc_texts(spark, sf_dir)


@query
def doc_metadata(spark, sf_dir):
    return documents.document_metadata(fx.doc_pages(spark, sf_dir), fx.doc_info(spark, sf_dir))


@query
def section_boundaries(spark, sf_dir):
    t = fx.order_texts(spark, sf_dir)
    b = explode_positions(chunking.with_boundaries(t), ["doc_id"], F.col("boundaries"), "_i", "boundary")
    return b.select("doc_id", F.col("boundary").cast("bigint").alias("boundary"))


@query
def chunk_sections(spark, sf_dir):
    t = chunking.with_sections(fx.order_texts(spark, sf_dir))
    return explode_positions(t, ["doc_id"], F.col("sections"), "section_idx", "section").select(
        "doc_id", F.col("section_idx").cast("bigint").alias("section_idx"), "section")


@query
def section_chunks(spark, sf_dir):
    c = chunking.chunk_documents(fx.order_texts(spark, sf_dir))
    return c.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk")


@query
def chunk_documents(spark, sf_dir):
    c = chunking.chunk_documents(_doc_texts(spark, sf_dir))
    return c.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "chunk")


@query
def chunk_documents_split(spark, sf_dir):
    """The same chunks without any document as one value: pieces of two pages are searched, cut and packed apart."""
    return long_documents.chunk_pages(fx.doc_pages(spark, sf_dir), piece_pages=2)


# ------------------------------------------------------- summariser, chat


def _doc_chunks(spark, sf_dir):
    docs = documents.assemble_documents(fx.doc_pages(spark, sf_dir), fx.doc_info(spark, sf_dir))
    b = chunking.with_chunks(docs)
    return explode_positions(b, ["doc_id", *completion.META], F.col("chunks"), "chunk_idx", "chunk")


@query
def chunk_prompts(spark, sf_dir):
    p = completion.map_chunks(_doc_chunks(spark, sf_dir))
    return p.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "prompt")


def _picky(prompt: str) -> str:
    """A user completion function that fails for some prompts."""
    if len(prompt) % 5 == 0:
        raise ValueError(f"cannot read {len(prompt)} characters")
    return f"{len(prompt)} characters read"


@query
def chunk_completions(spark, sf_dir):
    """A user function over every chunk prompt; failures become error texts."""
    p = completion.map_chunks(_doc_chunks(spark, sf_dir), fn=_picky)
    return p.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "summary")


@query
def summary_reduce(spark, sf_dir):
    r = completion.reduce_summaries(completion.map_chunks(_doc_chunks(spark, sf_dir)))
    return r.select("doc_id", "chunk_count", "final_prompt")


@query
def summarise_documents(spark, sf_dir):
    s = completion.summarise(_doc_chunks(spark, sf_dir))
    return s.select(
        "doc_id", F.col("metadata.title").alias("title"), F.col("metadata.page_count").alias("page_count"), "chunk_count",
        F.array_join("section_summaries", " || ").alias("section_summaries"), "final_summary",
    )


@query
def chat_assemble(spark, sf_dir):
    t = completion.chat_transcript(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return t.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    completion.render_chat(F.col("messages")).alias("prompt"))


@query
def chat_assemble_split(spark, sf_dir):
    """The transcripts through the ordered gathering in pieces; with a threshold of three turns nearly every
    conversation is split over tasks."""
    t = completion.joined_chat(completion.chat_pieces(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), piece_rows=3))
    return t.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), "prompt")


# ------------------------------------------------------------ e-mail threads


@query
def email_headers(spark, sf_dir):
    h = email.extract_headers(fx.emails(spark, sf_dir))
    return h.select(
        "thread_id", "email_no", F.col("block_no").cast("bigint").alias("block_no"),
        F.col("from").alias("from_addr"), "sent",
        F.array_join("to", "|").alias("to_addrs"), F.size("to").cast("bigint").alias("n_to"),
        F.array_join("cc", "|").alias("cc_addrs"), F.size("cc").cast("bigint").alias("n_cc"), "subject",
    )


def _findings(spark, sf_dir):
    return threads.thread_findings(fx.thread_outputs(spark, sf_dir))


@query
def thread_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    cols = []
    for name in threads.LIST_NAMES:
        cols += [F.array_join(name, "|").alias(name), F.size(name).cast("bigint").alias(f"n_{name}")]
    return f.select("thread_id", *cols, "summary")


@query
def thread_findings_split(spark, sf_dir):
    """Thread findings through the ordered gathering in pieces, with a threshold of four e-mails."""
    f = threads.joined_findings(threads.thread_finding_pieces(fx.thread_outputs(spark, sf_dir), piece_rows=4))
    cols = []
    for name in threads.LIST_NAMES:
        cols += [F.array_join(name, "|").alias(name), F.size(name).cast("bigint").alias(f"n_{name}")]
    return f.select("thread_id", *cols, "summary")


@query
def finding_rejects(spark, sf_dir):
    return threads.finding_rejects(fx.thread_outputs(spark, sf_dir)).select("thread_id", "email_no", "out")


@query
def thread_report_prompt(spark, sf_dir):
    return threads.report_prompt(_findings(spark, sf_dir)).select("thread_id", "report_prompt")


@query
def thread_fold(spark, sf_dir):
    f = threads.fold_threads(fx.emails(spark, sf_dir), fn=threads.prompt_length_completion, flavour="summary")
    return f.select("thread_id", "email_no", "summary")


@query
def thread_fold_findings(spark, sf_dir):
    """The findings flavour of the fold with its default step."""
    f = threads.fold_threads(fx.emails(spark, sf_dir), flavour="findings")
    lists = F.from_json("findings_json", "deadlines array<string>, commitments array<string>")
    return f.select("thread_id", "email_no", "ok", "summary", F.array_join(lists["deadlines"], "|").alias("deadlines"),
                    F.array_join(lists["commitments"], "|").alias("commitments"))


@query
def thread_fold_rounds(spark, sf_dir):
    """The summary flavour folded in rounds over all threads."""
    folder = _run_folder(spark, "thread_fold_rounds")
    f = rounds.fold_in_rounds(fx.emails(spark, sf_dir), folder, fn=threads.prompt_length_completion, flavour="summary", per_round=8)
    return f.select("thread_id", "email_no", F.col("update").alias("summary"))


@query
def thread_fold_rounds_findings(spark, sf_dir):
    """The findings flavour in rounds, with answers that depend on every character of the prompt; long threads are
    put in order by several tasks."""
    folder = _run_folder(spark, "thread_fold_rounds_findings")
    f = rounds.fold_in_rounds(fx.emails(spark, sf_dir), folder, fn=rounds.digest_finding, flavour="findings", per_round=8, piece_rows=12)
    return f.select("thread_id", "email_no", "ok", "update", F.array_join("deadlines", "|").alias("deadlines"), F.array_join("commitments", "|").alias("commitments"))


# ------------------------------------------------------------------ HTML


@query
def html_lists(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    items = explode_positions(p, ["page_id"], html_text.list_items(F.col("html")), "item_no", "item")
    return items.select("page_id", F.col("item_no").cast("bigint").alias("item_no"), email.html_unescape(F.col("item")).alias("item"))


def _table_rows(spark, sf_dir):
    return html_text.html_table_rows(fx.html_pages(spark, sf_dir))


@query
def html_tables(spark, sf_dir):
    r = _table_rows(spark, sf_dir)
    cells = r.select("page_id", "table_no", "row_no", F.posexplode(F.arrays_zip("headers", "values")).alias("col_no", "c"))
    return cells.select(
        "page_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"),
        F.col("col_no").cast("bigint").alias("col_no"), F.col("c.headers").alias("header"), F.col("c.values").alias("value"),
    )


@query
def stopword_filter(spark, sf_dir):
    r = _table_rows(spark, sf_dir)
    return r.select(
        "page_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"),
        html_text.row_text(F.col("headers"), F.col("values")).alias("row_text"),
    )


@query
def html_text_pages(spark, sf_dir):
    return html_text.html_to_text(fx.html_pages(spark, sf_dir))


@query
def page_body_json(spark, sf_dir):
    j = fx.page_json(spark, sf_dir)
    return j.select("page_id", html_text.page_body(F.col("json")).alias("html"))


# ------------------------------------------------------------ import graph


@query
def module_nodes(spark, sf_dir):
    return imports.module_nodes(fx.source_files(spark, sf_dir)).select("module", "path")


@query
def import_edges(spark, sf_dir):
    return imports.import_edges(fx.source_files(spark, sf_dir))


# -------------------------------------------------------------- replay eval


@query
def replay_map(spark, sf_dir):
    log = fx.replay_log(spark, sf_dir)
    return replay.replay_frame(log, replay.detect_columns(log.columns), keep=["record_id"])


@query
def metric_applicability(spark, sf_dir):
    log = fx.replay_log(spark, sf_dir)
    return replay.record_metrics(log, replay.detect_columns(log.columns), keep=["record_id"])


@query
def eval_scores(spark, sf_dir):
    log = fx.replay_log(spark, sf_dir)
    mapping = replay.detect_columns(log.columns)
    scored = replay.overlap_scores(replay.replay_frame(log, mapping, keep=["record_id"]), replay.pick_metrics(mapping))
    return scored.select("record_id", *[m for m, _ in replay.defaults.METRIC_ROLES])


# ----------------------------------------------------------------- streaming


def _run_folder(spark, name):
    import uuid

    from loglens.config import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/queries/{name}/{uuid.uuid4().hex}"


def _stream_dirs(spark, name):
    import uuid

    base = _run_folder(spark, name)
    return f"{base}/in", f"{base}/out", f"{name}_{uuid.uuid4().hex[:12]}"


def _written(df, folder):
    """The rows from files: what is read several times is derived once."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query
def stream_turn_alerts(spark, sf_dir):
    """The alert stream over the F1 turns, arriving as several files (one
    micro-batch each); the result read back from the parquet sink."""
    src, out, name = _stream_dirs(spark, "stream_turn_alerts")
    turns = fx.logs(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    turns.repartition(files, "session_id").write.parquet(src)
    q = stream_alerts.start_alert_stream(spark, src, out, words=fx.FIXTURE_WATCHLIST, schema=turns.schema, max_files_per_trigger=max(1, files // 2), name=name)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out).select(*stream_alerts.ALERT_COLUMNS)


@query
def stream_thread_findings(spark, sf_dir):
    """Thread findings folded by the stream, fed in bands of e-mail numbers; the
    deltas of each thread gathered like ``thread_findings``."""
    src, out, name = _stream_dirs(spark, "stream_thread_findings")
    outs = _written(fx.thread_outputs(spark, sf_dir), f"{src}-mails")
    # Arrival in e-mail order: each band is appended by its own job (the file
    # source takes files by modification time) as as many files as tasks run at
    # once; inside a band one thread's mails are in one file.
    bands, files = 4, spark.sparkContext.defaultParallelism
    low, high = outs.agg(F.min("email_no"), F.max("email_no")).first()
    width = -(-((high or 0) - (low or 0) + 1) // bands)
    for b in range(bands):
        at = F.floor((F.col("email_no") - F.lit(low or 0)) / width)
        outs.where(at == b).repartition(files, "thread_id").write.mode("append").parquet(src)
    q = thread_state.start_thread_stream(spark, src, out, max_files_per_trigger=files, name=name)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    found = thread_state.gathered(spark.read.parquet(out))
    cols = []
    for n in threads.LIST_NAMES:
        cols += [F.array_join(n, "|").alias(n), F.size(n).cast("bigint").alias(f"n_{n}")]
    return found.select("thread_id", *cols, "summary")


@query
def stream_thread_late(spark, sf_dir):
    """The late and the rejected mails of the stream: every fifth mail arrives after the others, in a second run of the
    same stream, which goes on from its checkpoint."""
    src, out, name = _stream_dirs(spark, "stream_thread_late")
    outs, files = _written(fx.thread_outputs(spark, sf_dir), f"{src}-mails"), spark.sparkContext.defaultParallelism
    for after in (False, True):
        part = outs.where(((F.col("thread_id") + F.col("email_no")) % 5 == 0) == F.lit(after))
        part.repartition(files, "thread_id").write.mode("append").parquet(src)
        q = thread_state.start_thread_stream(spark, src, out, max_files_per_trigger=10_000, name=name)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return spark.read.parquet(out).where("kind IN ('late', 'rejected')").select("thread_id", "email_no", "kind")

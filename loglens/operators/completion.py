"""Completion functions and the map/reduce document summariser.

A completion function is a plain ``str -> str`` callable (a model client);
``None`` selects the built-in stand-in, which is a JVM expression.  User
functions run in Arrow batches (``mapInPandas``); the factory form
(``completion_factory()``, called once per Python worker) lets a client or
model be loaded once per worker instead of once per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens import defaults
from loglens.operators.gather import PIECE_ROWS, gathered, ordered_pieces

_FIELD = re.compile(r"\{(\w+)\}")


def fill(template: str, **values: Column) -> Column:
    """``template.format(**values)`` as a column; values are cast to string."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos: m.start()].replace("{{", "{").replace("}}", "}")))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:].replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def stub_completion(prompt: Column) -> Column:
    """The built-in stand-in completion: fixed prefix + first 50 characters + '...'."""
    return F.concat(
        F.lit(defaults.STUB_COMPLETION_PREFIX),
        F.substring(prompt, 1, defaults.STUB_COMPLETION_CHARS),
        F.lit(defaults.STUB_COMPLETION_SUFFIX),
    )


def digest_completion(prompt: Column) -> Column:
    """The default stand-in completion: the length and the MD5 of the whole prompt,
    so every character of it shows in the output."""
    return F.concat(F.lit(defaults.DIGEST_COMPLETION_PREFIX), F.length(prompt).cast("string"), F.lit(" characters, "), F.md5(prompt))


def complete(
    df: DataFrame,
    prompt_col: str,
    out_col: str,
    fn: Callable[[str], str] | None = None,
    completion_factory: Callable[[], Callable[[str], str]] | None = None,
    catch_errors: bool = True,
    error_template: str = defaults.CHUNK_ERROR_TEXT,
    built_in: Callable[[Column], Column] = digest_completion,
) -> DataFrame:
    """Add ``out_col`` = completion(prompt), by ``built_in`` (a column expression)
    when no function is given.  With ``catch_errors`` a failing
    call yields ``error_template`` with the exception text instead of failing
    the task."""
    if fn is None and completion_factory is None:
        return df.withColumn(out_col, built_in(F.col(prompt_col)))
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        call = completion_factory() if completion_factory is not None else fn
        for pdf in batches:
            out = []
            for p in pdf[prompt_col]:
                if catch_errors:
                    try:
                        out.append(call(p))
                    except Exception as e:  # per-item isolation, as a map-phase failure
                        out.append(error_template.format(error=e))
                else:
                    out.append(call(p))
            yield pdf.assign(**{out_col: pd.Series(out, dtype=object)})

    return df.mapInPandas(run, schema)


# ----------------------------------------------------------------- summariser
def chunk_prompt(chunk: Column, title: Column, is_financial: bool = True) -> Column:
    tpl = defaults.CHUNK_PROMPT_FINANCIAL if is_financial else defaults.CHUNK_PROMPT_GENERAL
    return fill(tpl, title=title, chunk=chunk)


def section_list(summaries_sorted: Column) -> Column:
    """``"Section i Summary:\\n<s>"`` for i = 1.., joined by a blank line."""
    return F.array_join(
        F.transform(summaries_sorted, lambda s, i: fill(defaults.SECTION_SUMMARY_HEADER, i=i + 1, summary=s)),
        defaults.SECTION_SUMMARY_SEP,
    )


def final_prompt(all_summaries: Column, title: Column, author: Column, keywords: Column, page_count: Column,
                 is_financial: bool = True) -> Column:
    tpl = defaults.FINAL_PROMPT_FINANCIAL if is_financial else defaults.FINAL_PROMPT_GENERAL
    return fill(tpl, title=title, author=author, keywords=keywords, page_count=page_count, all_summaries=all_summaries)


META = ["title", "author", "subject", "keywords", "creation_date", "modification_date", "page_count"]


def map_chunks(chunks: DataFrame, fn=None, completion_factory=None, is_financial: bool = True,
               map_partitions: int | None = None) -> DataFrame:
    """Map phase: one prompt and one completion per chunk.

    ``chunks``: (doc_id, chunk_idx, chunk, <metadata columns>).  Chunk rows are
    spread by (doc_id, chunk_idx) before user completions run, so a document
    with many chunks is summarised by many tasks.
    """
    p = chunks.withColumn("prompt", chunk_prompt(F.col("chunk"), F.col("title"), is_financial))
    if fn is not None or completion_factory is not None:
        p = p.repartition(map_partitions, "doc_id", "chunk_idx") if map_partitions else p.repartition("doc_id", "chunk_idx")
    return complete(p, "prompt", "summary", fn, completion_factory, catch_errors=True)


def reduce_summaries(mapped: DataFrame, is_financial: bool = True) -> DataFrame:
    """Reduce phase input: per document, the chunk summaries in chunk order and
    the final prompt.  ``collect_list`` combines map-side."""
    g = mapped.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "summary"))).alias("_s"),
        F.count(F.lit(1)).cast("int").alias("chunk_count"),
        *[F.first(c, ignorenulls=True).alias(c) for c in META],
    )
    summaries = F.transform(F.col("_s"), lambda x: x["summary"])
    return (
        g.withColumn("section_summaries", summaries)
        .withColumn("final_prompt", final_prompt(section_list(F.col("section_summaries")), F.col("title"), F.col("author"),
                                                 F.col("keywords"), F.col("page_count"), is_financial))
        .drop("_s")
    )


def summarise(chunks: DataFrame, fn=None, completion_factory=None, is_financial: bool = True,
              checkpoint_map: bool = True) -> DataFrame:
    """(doc_id, metadata struct, chunk_count, section_summaries, final_summary).

    Errors of the final (reduce) call are not caught, as in a single
    document run: they fail the job.  With a user completion function the
    chunk summaries are checkpointed to the shared checkpoint folder before
    the reduce (``checkpoint_map``): model calls are expensive and need not
    be repeatable, so a lost executor must not make the reduce see
    re-generated summaries.
    """
    mapped = map_chunks(chunks, fn, completion_factory, is_financial)
    if checkpoint_map and (fn is not None or completion_factory is not None):
        from loglens.config import ensure_checkpoint_dir

        ensure_checkpoint_dir(mapped.sparkSession)
        mapped = mapped.checkpoint(eager=True)
    red = reduce_summaries(mapped, is_financial)
    done = complete(red, "final_prompt", "final_summary", fn, completion_factory, catch_errors=False)
    return done.select(
        "doc_id", F.struct(*META).alias("metadata"), "chunk_count", "section_summaries", "final_summary"
    )


# ------------------------------------------------------------------- chat
def chat_transcript(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, messages array<struct<role, content>>) in turn order."""
    msgs = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"), F.col(role_col).alias("role"),
                                                  F.col(text_col).alias("content"))))
    return turns.groupBy(id_col).agg(msgs.alias("_m")).select(
        id_col, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def chat_pieces(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text",
                piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(id, piece, of, messages, body): the transcript in numbered pieces; a conversation of any length is put in order
    by several tasks.  ``body`` is the rendered part without the closing assistant mark."""
    item = F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    pieces = ordered_pieces(turns, id_col, [order_col], item, piece_rows).withColumnRenamed("items", "messages")
    return pieces.withColumn("body", render_messages(F.col("messages")))


def joined_chat(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, messages, prompt): the pieces of every conversation as one row."""
    whole = gathered(pieces, id_col, {"messages": "list", "body": "text"})
    return whole.select(id_col, "messages", F.concat("body", F.lit(CHAT_END)).alias("prompt"))


CHAT_END = "<|assistant|>"


def render_messages(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("<|end|>"))), "")


def render_chat(messages: Column) -> Column:
    """``<|role|>content<|end|>`` per message, then ``<|assistant|>`` (the
    frame used by the thread prompts)."""
    return F.concat(render_messages(messages), F.lit(CHAT_END))


def chat_complete(transcripts: DataFrame, fn=None, completion_factory=None, messages_col: str = "messages") -> DataFrame:
    """Rendered chat prompt and one completion per transcript."""
    p = transcripts.withColumn("prompt", render_chat(F.col(messages_col)))
    return complete(p, "prompt", "completion", fn, completion_factory, catch_errors=False)


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per document (doc_id, metadata, chunk_count,
    section_summaries, final_summary) per line."""
    summaries.write.mode(mode).json(path)

"""Section-aware chunking of documents of any length, from their pages.

``documents.assemble_pages`` and ``chunking.chunk_documents`` hold a document's text as one value.  Here it never is
one, and its pages move twice only: to their piece, where they are cut, and from there to their chunks.  What decides on
the cuts are numbers (where a page may be cut, where its lines end), which are folded in the order of the pages:

* boundaries: every page but the first stands behind a separator and starts with ``[``, which no pattern's matches reach
  over, so each page is searched where it stands.  The one exception is the capitals-and-parenthesis pattern, whose
  parenthesis may run over any number of pages to the very end of the text; pages report a parenthesis that stays open,
  and the document decides;
* paragraphs: separators are found from the left, so a page that ends in an odd number of line ends leaves one of them to
  the first paragraph of the next page;
* packing: the open chunk's length goes from page to page; a section's pages are held, as numbers, until it ends or is
  longer than what stays whole.

The result equals ``chunk_documents`` over ``assemble_pages``, pages that share a number excepted (they come by a hash
of their text, which with the number tells a document's pages apart).  The patterns are the default ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens import defaults
from loglens.config import ensure_checkpoint_dir, ship_package
from loglens.operators.gather import gathered

#: page numbers in one piece, whose pages are cut by one task
PIECE_PAGES = 256
#: cuts that leave a task at a time
OUT_ROWS = 10_000
SEP = defaults.PARAGRAPH_SEP
#: the pattern that ends with the text, and what it looks like where its parenthesis is still open
AT_END = defaults.SECTION_PATTERNS[3]
OPEN = re.compile(r"\n\s*[A-Z][A-Z\s]{2,}\s*\([^)]*\Z")
CLOSED_AT_END = re.compile(r"[^)]*\)\s*\Z")
LINE_ENDS = re.compile(r"\n\n+")
#: what the folds know of a page: its length, line ends at its end, match starts where a page follows and where none does (null:
#: the same), those of the pattern at the text's end, an open parenthesis, closed ones, and other runs of line ends (start, length)
PAGE = ["n", "tail", "at", "at_last", "final", "open_at", "closes", "closes_at_end", "runs"]
PAGE_TYPES = "n int, tail int, at array<int>, at_last array<int>, final array<int>, open_at int, closes boolean, closes_at_end boolean, runs array<int>"


def _page_marks(text: str, inner: list[re.Pattern], end: re.Pattern) -> tuple:
    """``PAGE`` of one page."""
    n, closes = len(text), ")" in text
    at, at_last, final, opened, runs, tail = set(), None, None, None, None, 0
    if "\n" in text:  # every pattern starts with one
        found = [(m.start(), m.end()) for p in inner for m in p.finditer(text + SEP + "[")]  # what stands behind
        at = {a for a, _ in found}
        if any(z > n for _, z in found):  # a match that takes more than the page
            at_last = sorted({m.start() for p in inner for m in p.finditer(text)})
        final = [m.start() for m in end.finditer(text)] or None
        opened = OPEN.search(text)
        tail = n - len(text.rstrip("\n"))
        runs = [x for m in LINE_ENDS.finditer(text, 0, n - tail) for x in (m.start(), m.end() - m.start())] or None
    return n, tail, sorted(at) or None, at_last, final, opened and opened.start(), closes, closes and bool(CLOSED_AT_END.match(text)), runs


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> (doc, no, h) and ``PAGE``."""
    inner, end = [re.compile(p) for p in defaults.SECTION_PATTERNS if p != AT_END], re.compile(AT_END)
    ints = pa.list_(pa.int32())
    kinds = (pa.int32(), pa.int32(), ints, ints, ints, pa.int32(), pa.bool_(), pa.bool_(), ints)
    for b in batches:
        cols = list(zip(*(_page_marks(t.as_py(), inner, end) for t in b["text"]))) or [()] * len(PAGE)
        yield pa.RecordBatch.from_arrays([b["doc"], b["no"], b["h"], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc", "no", "h", *PAGE])


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], types: dict) -> Iterator[tuple[tuple, bool]]:
    """Rows that start with their document, and whether they are its last; ``types`` gets the columns' types."""
    held = None
    for b in batches:
        types.update(zip(b.schema.names, b.schema.types))
        for row in zip(*(b[c].to_pylist() for c in names)):
            if held is not None:
                yield held, row[0] != held[0]
            held = row
    if held is not None:
        yield held, True


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)


def _cuts(at, at_last, final, last: bool, opened: int | None, ends_open: bool) -> list[int]:
    """The boundaries of a page; ``opened``: where a parenthesis opens here that the document's end closes, ``ends_open``:
    one opens on a page before."""
    if last:
        at = (at if at_last is None else at_last) or []
        return sorted({*at, *(() if ends_open else final or ())})
    return sorted({*(at or ()), *(() if opened is None else (opened,))})


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order -> (doc, total, open_page, open_from): the number of boundaries, and the page and place of the
    parenthesis that runs to the end."""
    types, out, first, names = {}, [], True, ["doc", "total", "open_page", "open_from"]
    kinds = lambda: [types["doc"], pa.int64(), pa.int64(), pa.int32()]
    for (doc, at, at_last, final, open_at, closes, ends), last in _rows(batches, ["doc", "at", "at_last", "final", "open_at", "closes", "closes_at_end"], types):
        if first:
            page, total, opened = 0, 1, None
        if not last:
            if closes:
                opened = None
            if opened is None and open_at is not None:
                opened = page, open_at, open_at not in (at or ())
        elif not ends:
            opened = None
        total += len(_cuts(at, at_last, final, last, None, opened is not None))
        page, first = page + 1, last
        if last:
            out.append((doc, total + (opened is not None and opened[2]), *(opened[:2] if opened else (None, None))))
        if len(out) >= OUT_ROWS:
            yield _batch(out, names, kinds())
            out = []
    if out:
        yield _batch(out, names, kinds())


class _Unit:
    """A section, or a document without sections, as its fragments come: fragments -> cuts (doc, no, h, piece, chunk, a,
    z, lead, packed).  ``mode``: "keep" and "split" pack paragraphs, None waits for more than ``most`` characters."""

    def __init__(self, chunk: int, mode: str | None, chunk_size: int, most: float):
        self.chunk, self.mode, self.chunk_size, self.most = chunk, mode, chunk_size, most
        self.size, self.held, self.current, self.carried, self.fresh = 0, [], 0, 0, True

    def add(self, out: list, *fragment) -> None:
        if self.mode is not None:
            return self._pack(out, *fragment)
        self.held.append(fragment)
        self.size += fragment[2] - fragment[1]
        if self.size > self.most:
            self.mode, held, self.held = "split", self.held, []
            for x in held:
                self._pack(out, *x)

    def close(self, out: list) -> int:
        """The number of the next chunk."""
        out += [(*page, self.chunk, a, z, 0, False) for page, a, z, *_ in self.held]
        return self.chunk + 1

    def _pack(self, out: list, page: tuple, a: int, z: int, runs: list[tuple[int, int]], goes_on: bool) -> None:
        found, start = [], a
        for s, n in runs:
            s, e = max(s, a), min(s + n, z)
            for at in range(s, e - 1, 2):
                found.append((start, at))
                start = at + 2
        if not goes_on:
            found.append((start, z))
        part = None
        for i, (s, e) in enumerate(found):
            n = e - s + (0 if i else self.carried)
            if self.current + n >= self.chunk_size:
                if self.mode == "keep" and self.fresh:  # the empty chunk before a first paragraph that is too long
                    out.append((*page, self.chunk, 0, 0, 0, False))
                self.chunk += self.mode == "keep" or self.current > 0
                self.current = 0
            if part is None or part[0] != self.chunk:
                if part:
                    out.append((*page, *part, True))
                part = [self.chunk, s, e, 0 if i else self.carried]
            part[2] = e
            self.current += n + len(SEP)
            self.fresh = False
        if part:
            out.append((*page, *part, True))
        self.carried = (z - start if goes_on else 0) + (0 if found else self.carried)


CUT = ["doc", "no", "h", "piece", "chunk", "a", "z", "lead", "packed"]


def _packed(chunk_size: int, most: float, max_boundaries: int):
    """Each document's facts, then its pages in order -> the cuts of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out = {}, []
        kinds = lambda: [types["doc"], types["no"], pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for row, last in _rows(batches, ["doc", "kind", "total", "open_page", "open_from", "no", "h", *PAGE], types):
            if row[1] == 0:
                total, open_page, open_from = row[2:5]
                sections = 1 < total < max_boundaries
                mode = None if sections else "keep"
                piece, unit = 0, _Unit(0, mode, chunk_size, most)
                continue
            doc, no, h, n, tail, at, at_last, final, _, _, _, runs = row[0], *row[5:]
            cuts = _cuts(at, at_last, final, last, open_from if open_page == piece else None, open_page is not None) if sections else []
            full = n + (0 if last else len(SEP))
            runs = [*zip(runs[::2], runs[1::2]), (n - tail, tail + len(SEP))] if runs else [(n - tail, tail + len(SEP))]
            for a, z in zip([0, *cuts], [*cuts, full]):
                goes_on = z == full and not last
                unit.add(out, (doc, no, h, piece), a, z, runs, goes_on)
                if not goes_on:
                    unit = _Unit(unit.close(out), mode, chunk_size, most)
            piece += 1
            if len(out) >= OUT_ROWS:
                yield _batch(out, CUT, kinds())
                out = []
        if out:
            yield _batch(out, CUT, kinds())

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's cuts, then the page -> (doc, chunk, piece, part).  Pages that agree in number and text stand together:
    the first is cut for all of them."""
    now, todo = None, []
    for b in batches:
        texts, out = b["text"], []
        for i, (doc, no, h, piece, chunk, a, z, lead, packed) in enumerate(zip(*(b[c].to_pylist() for c in CUT))):
            if (doc, no, h) != now:
                now, todo = (doc, no, h), []
            if piece is not None:
                todo.append((piece, chunk, a, z, lead, packed))
            elif todo:
                text = texts[i].as_py() + SEP
                out += [(doc, chunk, piece, "\n" * lead + text[a:z] + (SEP if packed else "")) for piece, chunk, a, z, lead, packed in todo]
                todo = []
        if out:
            yield _batch(out, ["doc", "chunk", "piece", "part"], [b.schema.field("doc").type, pa.int64(), pa.int64(), pa.string()])


def chunk_pages(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text", chunk_size: int = defaults.CHUNK_SIZE,
                max_boundaries: int = defaults.MAX_SECTION_BOUNDARIES, resplit_factor: float = defaults.RESPLIT_FACTOR, piece_pages: int = PIECE_PAGES) -> DataFrame:
    """(id, chunk_idx, chunk) for pages (id, number, text): pages of ``piece_pages`` numbers of a document are cut together."""
    spark = pages.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(F.col(id_col).alias("doc"), F.col(page_col).alias("no")).schema}
    key = f"doc {kinds['doc']}, no {kinds['no']}, h long"
    filled = F.col(page_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S")
    text = F.concat(F.lit("[Page "), F.col(page_col).cast("string"), F.lit("] "), F.col(text_col))
    rows = pages.where(filled).select(F.col(id_col).alias("doc"), F.col(page_col).alias("no"), text.alias("text"))
    rows = rows.select("doc", "no", F.xxhash64("text").alias("h"), "text")

    # numbers of each page, written once
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/long_documents-{uuid.uuid4().hex}"
    rows.mapInArrow(_marks, f"{key}, {PAGE_TYPES}").write.option("compression", "zstd").parquet(folder)
    marks = spark.read.schema(f"{key}, {PAGE_TYPES}").parquet(folder)
    facts = marks.drop("n", "tail", "runs").repartition(tasks, "doc").sortWithinPartitions("doc", "no", "h")
    facts = facts.mapInArrow(_facts, f"doc {kinds['doc']}, total long, open_page long, open_from int")

    # boundaries and packing: numbers only, each document in order behind what is known of it
    both = facts.withColumn("kind", F.lit(0)).unionByName(marks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(tasks, "doc").sortWithinPartitions("doc", "kind", "no", "h")
    cuts = both.mapInArrow(_packed(chunk_size, chunk_size * resplit_factor, max_boundaries), f"{key}, piece long, chunk long, a int, z int, lead int, packed boolean")

    # texts: each piece's cuts before its pages
    met = cuts.unionByName(rows, allowMissingColumns=True).repartition(tasks, "doc", F.floor(F.col("no").try_cast("double") / piece_pages))
    met = met.sortWithinPartitions("doc", "no", "h", F.col("piece").asc_nulls_last(), "chunk", "a")
    parts = met.mapInArrow(_parts, f"doc {kinds['doc']}, chunk long, piece long, part string")
    chunks = gathered(parts.withColumn("at", F.struct("doc", "chunk")), "at", {"part": "text"})
    out = chunks.select(F.col("at.doc").alias(id_col), F.col("at.chunk").alias("chunk_idx"), F.col("part").alias("chunk"))
    blank = pages.groupBy(F.col(id_col)).agg(F.bool_or(F.coalesce(filled, F.lit(False))).alias("some")).where("NOT some")
    return out.unionByName(blank.select(id_col, F.lit(0).cast("long").alias("chunk_idx"), F.lit(SEP).alias("chunk")))

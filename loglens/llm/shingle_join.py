"""N-gram Jaccard join by chosen paths: all documents whose sets of word 5-grams have a Jaccard of 0.8 or more.

Every run samples shared tokens: a shingle ``s`` is chosen by a set of size ``n`` when a hash of the run falls
below ``RATE / n``, the same hash for all sets, so similar sets choose shared shingles together.  Sets that chose
the same shingle form a bucket.  Small buckets are compared outright; larger ones are first compared with a few
pivots (which settles buckets of one dense group) and else split again on the shingles that their members choose
on the next level.  Buckets that are still large on the last level are compared in blocks of bounded size.
A low ``RATE`` costs more rows on the first level (``runs * RATE`` for each set) and spares rows where groups of similar
sets are split again: there every level multiplies them by ``RATE``.  ``runs_for`` gives the number of runs: a pair at the threshold shares no bucket after all levels with at most
``1 - RECALL`` probability (more similar pairs, and pairs in small buckets, are missed far less often).

In buckets a 64-byte minwise sketch filters pairs, with a bound five standard deviations below the threshold;
what passes forms candidate classes.  The texts of a class's members are then fetched once, and every pair in
the class is decided exactly on its shingles.  Equal sets are one node with a count: copies are never paired up.

Words are runs of other characters than ASCII white space.  A text of one to four words has one shingle, the
whole text.  Defined results: null text counts as empty; texts without words link with nothing, and each is its
own class; rows with a null id link with nothing (class null, kept); rows with the same id and text count as
copies and are flagged alike (``kept_rows`` returns any one of them), rows with the same id and other texts are
distinct documents that share the id: the kept one of a class is the least by id, then by a hash of the text; an empty
table gives an empty result; further columns are ignored (and returned by ``kept_rows`` and ``one_of_each``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm import linkage
from loglens.llm.common import body, prepare
from loglens.operators.sizes import broadcast_if_small

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: shingles that a set chooses on each level, on average; levels of splitting
RATE, LEVELS = 2.0, 3
#: members of a bucket that are compared outright, of a class block that are compared exactly; pivots of a bucket
BUCKET, BLOCK, PIVOTS = 2048, 100, 4
#: hashes in a sketch, and how many standard deviations below the threshold its bound lies
SKETCH, DEVIATIONS = 64, 5.0
#: shingles handled at a time when sketching
SLICE = 1 << 15


def survival(levels: int, rate: float = RATE, threshold: float = THRESHOLD) -> float:
    """Probability that a pair at the threshold shares a bucket through all levels of one run.  On each level it
    chooses Poisson(threshold * rate) shingles in common."""
    s = 1.0
    for _ in range(levels):
        s = 1 - math.exp(-threshold * rate * s)
    return s


def runs_for(recall: float = RECALL, levels: int = LEVELS, rate: float = RATE, threshold: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels, rate, threshold)))


def sketch_bound(threshold: float = THRESHOLD) -> int:
    return math.floor(SKETCH * threshold - DEVIATIONS * math.sqrt(SKETCH * threshold * (1 - threshold)))


# ------------------------------------------------------------ shingles (inside tasks)
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    codes = words.indices.to_numpy(zero_copy_only=False)
    blank = np.asarray(pc.equal(pc.binary_length(words.dictionary), 0))[codes] if len(codes) else np.zeros(0, bool)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(size)), size)[~blank]  # white space at either end leaves an empty word
    word = hashes[codes[~blank]]
    n = np.bincount(doc, minlength=len(size))
    ends = np.cumsum(n)
    rolled = np.zeros(len(word), dtype=np.uint64)
    for i in range(gram):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15)
        rolled[:len(word) - i] += word[i:]
    rolled = _mix(rolled)
    out = []
    for k, e in zip(n.tolist(), ends.tolist()):
        if k >= gram:
            out.append(np.unique(rolled[e - k:e - gram + 1]))
        elif k:
            short = word[e - k:e]
            out.append(np.array([xxhash.xxh3_64_intdigest(short.tobytes(), seed=k)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_hash(text_col: str) -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(body(text_col))


def _describe(gram: int, runs: int, levels: int, rate: float, seed: int):
    """Documents -> (id, text hash, set hash, sketch, chosen shingles of every run by level)."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, SKETCH + runs * levels, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def one(s: np.ndarray) -> tuple[bytes, list[list[list[int]]]]:
        low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
        chosen: list[list[np.ndarray]] = [[] for _ in range(runs * levels)]
        bound = np.uint64(min(2.0**64 - 2048, rate / len(s) * 2.0**64))
        for i in range(0, len(s), SLICE):
            part = s[i:i + SLICE]
            h = part[None, :] * odd[:, None]
            h[:] = h ^ (h >> np.uint64(31))
            h *= np.uint64(0x9E3779B97F4A7C15)
            np.minimum(low, h[:SKETCH].min(axis=1), out=low)
            row, col = np.nonzero(h[SKETCH:] <= bound)
            for r, c in zip(row.tolist(), part[col]):
                chosen[r].append(c)
        sketch = (low >> np.uint64(11)).astype(np.uint8).tobytes()
        flat = [np.array(c, dtype=np.uint64).view(np.int64).tolist() for c in chosen]
        return sketch, [flat[k * runs:(k + 1) * runs] for k in range(levels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                sets = shingle_sets(b["body"][i:i + 500], gram)
                filled = [s if len(s) else None for s in sets]
                said = [one(s) if s is not None else (None, [None] * levels) for s in filled]
                kind = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b["id"][i:i + 500], b["th"][i:i + 500], pa.array([None if s is None else set_hash(s) for s in filled], pa.binary()), pa.array([x[0] for x in said], pa.binary()),
                     *[pa.array([x[1][k] for x in said], kind) for k in range(levels)]],
                    names=["id", "th", "sh", "sketch", *[f"l{k + 1}" for k in range(levels)]])

    return run


# ------------------------------------------------------------ buckets (inside tasks)
def _sketch_stars(bound: int):
    """Stars of the members of each bucket whose sketches agree in ``bound`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in linkage.grouped(batches, ["key", "bi", "bj"]):
            node, own = t["node"].to_numpy(), t["own"].to_numpy()
            cross = t["bi"].to_numpy() != t["bj"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            sizes = np.diff([*starts, t.num_rows])
            two = starts[sizes == 2]
            same = (sketch[two] == sketch[two + 1]).sum(axis=1) >= bound
            same &= ~cross[two] | (own[two] != own[two + 1])
            out_a, out_b = [node[two[same]]], [node[two[same] + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                x, a, b = sketch[s:s + n], [], []
                for i in range(n - 1):
                    j = np.flatnonzero((x[i + 1:] == x[i]).sum(axis=1) >= bound) + i + 1
                    if cross[s]:
                        j = j[own[s + j] != own[s + i]]
                    a.append(np.full(len(j), i))
                    b.append(j)
                root = linkage.star_roots(n, np.concatenate(a), np.concatenate(b))
                moved = np.flatnonzero(root != np.arange(n))
                out_a.append(node[s + moved])
                out_b.append(node[s + root[moved]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _to_pivots(bound: int):
    """Members of large buckets -> (key, node, the first pivot that its sketch is near to, which pivots these are as
    bits of a number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            own = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            bits, pivot = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            for p in reversed(range(PIVOTS)):
                theirs = np.frombuffer(b"".join(t[f"s{p}"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
                near = (own == theirs).sum(axis=1) >= bound
                bits[near] |= 1 << p
                pivot[near] = t[f"p{p}"].to_numpy()[near]
            yield pa.RecordBatch.from_arrays([t["key"], t["run"], t["node"], pa.array(pivot), pa.array(bits)], names=["key", "run", "node", "pivot", "bits"])

    return run


def _some_near_both(p: int, q: int) -> Column:
    two = (1 << p) | (1 << q)
    return F.exists("seen", lambda x: x.bitwiseAND(F.lit(two)) == two)


def _reached(seen: Column) -> Column:
    """The pivots (as bits) that members connect to the first one, from the sets of pivots that members are near to."""
    reached = F.lit(1).cast("long")
    for _ in range(PIVOTS):
        reached = F.aggregate(seen, reached, lambda a, x: F.when(a.bitwiseAND(x) != 0, a.bitwiseOR(x)).otherwise(a))
    return reached


def _jaccard_links(gram: int, threshold: float):
    def links(g: pa.Table) -> np.ndarray | None:
        want = g["sh"].to_pylist()
        sets = [s if set_hash(s) == w else s[:0] for s, w in zip(shingle_sets(g["body"].combine_chunks(), gram), want)]
        n = np.array([len(s) for s in sets])
        m = len(sets)
        if m <= 8:
            inter = np.zeros((m, m), dtype=np.int64)
            for i in range(m):
                for j in range(i + 1, m):
                    inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:  # members x shared shingles, some columns at a time
            token, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, shared = np.repeat(np.arange(m), n), (times > 1)[inverse]
            column = np.cumsum(times > 1)[inverse[shared]] - 1
            row, order = row[shared], np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            inter = np.zeros((m, m), dtype=np.int64)
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
                a, z = np.searchsorted(column, [first, first + 8192])
                hot = np.zeros((m, 8192), dtype=np.float32)
                hot[row[a:z], column[a:z] - first] = 1
                inter += (hot @ hot.T).astype(np.int64)
        union = n[:, None] + n[None, :] - inter
        return (inter >= threshold * union - 1e-9) & (inter > 0)

    return links


# ------------------------------------------------------------ the join
def _candidates(nodes: DataFrame, levels: int, bound: int) -> DataFrame:
    """Candidate edges (a, b): chosen paths over (node, sketch, l1, ...)."""
    rows = (nodes.select("node", "sketch", F.posexplode("l1").alias("run", "tokens"))
            .select("node", "sketch", "run", F.explode("tokens").alias("token"))
            .select(F.xxhash64("run", "token").alias("key"), "run", "node", "sketch"))
    found = None
    for level in range(1, levels + 1):
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = None
        if level == levels:
            small = linkage.bucket_rows(rows, "key", "node", BUCKET, counts)
        else:
            large = counts.filter(F.col("n") > BUCKET).select(F.col("key").alias("k")).checkpoint()
            large = None if large.isEmpty() else broadcast_if_small(large)
            small = linkage.whole_buckets(rows if large is None else rows.join(large, F.col("key") == F.col("k"), "left_anti"))
        edges = linkage.by_group(small.drop("run"), ["key", "bi", "bj"]).mapInArrow(_sketch_stars(bound), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            break
        rows = rows.join(large, F.col("key") == F.col("k"), "left_semi").checkpoint()  # read for the pivots and against them
        picks = [F.min_by(F.struct("node", "sketch"), F.xxhash64("node", F.lit(p))).alias(f"q{p}") for p in range(PIVOTS)]
        pivots = rows.groupBy("key").agg(*picks).select(F.col("key").alias("k"), *[F.col(f"q{p}.node").alias(f"p{p}") for p in range(PIVOTS)], *[F.col(f"q{p}.sketch").alias(f"s{p}") for p in range(PIVOTS)])
        pivots = pivots.checkpoint()
        near = (rows.join(broadcast_if_small(pivots), F.col("key") == F.col("k")).drop("k")
                .mapInArrow(_to_pivots(bound), "key long, run int, node long, pivot long, bits long").checkpoint())
        found = found.unionByName(near.filter("bits <> 0 AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        # at most 2 ** PIVOTS sets of pivots in a bucket: members connect pivots, and a bucket whose members are all
        # near to pivots that hang together is one class already; the others are split
        sets = near.groupBy("key").agg(F.collect_set("bits").alias("seen")).withColumn("reached", _reached(F.col("seen"))).checkpoint()
        both = [F.when(_some_near_both(p, q), F.struct(F.col(f"p{p}").alias("a"), F.col(f"p{q}").alias("b")))
                for p in range(PIVOTS) for q in range(p)]
        tied = sets.join(broadcast_if_small(pivots), F.col("key") == F.col("k")).select(F.explode(F.array(*both)).alias("e")).filter("e IS NOT NULL")
        found = found.unionByName(tied.select("e.a", "e.b"))
        mixed = sets.filter(F.exists("seen", lambda x: x.bitwiseAND(F.col("reached")) == 0)).select(F.col("key").alias("k")).checkpoint()
        left = near.join(broadcast_if_small(mixed), F.col("key") == F.col("k"), "left_semi").select("key", "run", F.col("node").alias("at"))
        chosen = nodes.select("node", "sketch", F.col(f"l{level + 1}").alias("tokens"))
        rows = (left.join(chosen, F.col("at") == F.col("node"))
                .select("key", "run", "node", "sketch", F.explode(F.col("tokens")[F.col("run")]).alias("token"))
                .select(F.xxhash64("key", "token").alias("key"), "run", "node", "sketch").checkpoint())
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, gram: int, threshold: float, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, sh), and (sh, class_id, links, class_size) of the sets that are linked or copied.

    Ids may be shared by different texts, so a text is fetched by its id and its hash ``th``."""
    runs, bound = runs_for(recall, LEVELS, RATE, threshold), sketch_bound(threshold)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_hash(text_col).alias("th"), body(text_col).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()
    levels = [f"l{k}" for k in range(1, LEVELS + 1)]
    described = rows.mapInArrow(_describe(gram, runs, LEVELS, RATE, seed),
                                f"id {kind}, th long, sh binary, sketch binary, " + ", ".join(f"{x} array<array<long>>" for x in levels)).checkpoint()
    nodes = (described.filter("sh IS NOT NULL").groupBy("sh")
             .agg(F.min(F.struct("id", "th")).alias("one"), F.count(F.lit(1)).alias("weight"), F.first("sketch").alias("sketch"), *[F.first(x).alias(x) for x in levels])
             .withColumns({"least": F.col("one.id"), "least_th": F.col("one.th")}).drop("one")
             .withColumn("node", F.monotonically_increasing_id()).checkpoint())  # the numbers hold from here on
    edges = _candidates(nodes.select("node", "sketch", *levels), LEVELS, bound)
    slim = nodes.select("node", "sh", "least", "least_th", "weight")
    members = linkage.components(edges).join(nodes.select("node", "sh", "least", "least_th", "weight"), "node").checkpoint()
    texts = rows.withColumnRenamed("id", "text_id")
    members = texts.join(broadcast_if_small(members), (F.col("least") == F.col("text_id")) & (F.col("least_th") == F.col("th"))).drop("text_id", "th")
    found = linkage.class_links(members, ["sh", "body"], _jaccard_links(gram, threshold), BLOCK)
    found = found.select("node", "links", F.col("root").alias("part"))
    slim = slim.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    whole = slim.groupBy("part").agg(F.min(F.struct("least", "least_th")).alias("one"), F.sum("weight").alias("class_size"))
    sets = slim.join(whole, "part").select(F.col("sh").alias("set_sh"), F.col("one.least").alias("class_id"), F.col("one.least_th").alias("class_th"), "class_size",
                                           (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return described.select("id", "th", "sh"), sets


def _decided(docs: DataFrame, id_col: str, text_col: str, gram: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(id, th, class_id, class_size, n_links, kept), one row per row that has an id."""
    rows, sets = _classes(docs, id_col, text_col, gram, threshold, recall, seed)
    out = rows.join(sets, F.col("sh") == F.col("set_sh"), "left")
    return out.select("id", "th", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce((F.col("class_id") == F.col("id")) & (F.col("class_th") == F.col("th")), F.lit(True)).alias("kept"))


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
                   recall: float = RECALL, seed: int = 8) -> DataFrame:
    """(id_col, class_id, class_size, n_links, kept), one row per row of ``docs``.

    Links are pairs with Jaccard >= threshold, copies included in the count; classes are the connected
    components, named by their smallest id, whose document is the kept one."""
    prepare(docs)
    done = _decided(docs, id_col, text_col, gram, threshold, recall, seed).drop("th").withColumnRenamed("id", id_col)
    nameless = docs.filter(F.col(id_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return done.unionByName(nameless)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
              recall: float = RECALL, seed: int = 8) -> DataFrame:
    """The kept document of every class, all columns as they were, once.  Each row is judged by its own text: a document
    stays if another one that shares its id goes."""
    prepare(docs)
    decided = _decided(docs, id_col, text_col, gram, threshold, recall, seed)
    told = decided.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 OR NOT kept")
    told = told.select(F.col("id").alias("told_id"), F.col("th").alias("told_th"), "kept").checkpoint()
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    same = (F.col(at[id_col]) == F.col("told_id")) & (text_hash(at[text_col]) == F.col("told_th"))
    rows = docs.toDF(*at.values())
    once = rows.join(broadcast_if_small(told), same, "left_anti")
    repeated = told.filter("kept")  # rows repeated in full
    if not repeated.isEmpty():
        several = rows.join(broadcast_if_small(repeated), same).dropDuplicates(["told_id", "told_th"])
        once = once.unionByName(several.select(*at.values()))
    return once.toDF(*names)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD,
                recall: float = RECALL, seed: int = 8) -> DataFrame:
    """The kept document of every class, all columns as they were.  Rows that share their id are kept or dropped together:
    all go if one of them does (``kept_rows`` judges each row)."""
    prepare(docs)
    dropped = near_documents(docs, id_col, text_col, gram, threshold, recall, seed).filter("NOT kept").select(F.col(id_col).alias("dropped_id")).distinct().checkpoint()
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.toDF(*at.values()).join(broadcast_if_small(dropped), F.col(at[id_col]) == F.col("dropped_id"), "left_anti")
    return rows.toDF(*names)

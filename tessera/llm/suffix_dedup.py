"""Removal of long repeated byte strings, by bucket-pointer refinement of suffixes.

A suffix's bucket is told by its first bytes. The initial buckets are those of all q-grams
(``Q`` bytes), with a 64-bit identifier that every task computes alike, so no rank has to be passed around.
The bucket of twice the depth is that of the pair (own bucket, bucket of the suffix that starts ``depth`` bytes later), and refined
buckets are used in the same way for the next depth (``bucket``). A string of any length is told by the deepest buckets at its
begin and at the offset where they end with it (``deeper``). A bucket with one suffix is finished:
no longer string in it can repeat. Since identifiers are hashes, suffixes of a bucket meet by grouping on identifiers, and their
order among each other is never needed.

What makes it fit a cluster is which suffixes are sorted at all. Of each window of ``length`` bytes the
q-gram with the least hash is its anchor; equal windows have equal anchors at equal offsets.
So it is enough to sort the suffixes at anchors (about one in 80), and a run of
windows with one anchor stays one row until its bucket is told apart:

* level 0 takes the anchors whose q-gram bucket holds several suffixes, and compares whole runs;
* a run that equals another is settled as repeated. Runs that differ but share the bucket of their
  common core are split into blocks of windows, and one run of each kind goes on to the next level;
* a block whose core is alone in its bucket is settled as unique; the last level has single windows.

Equal texts are one text with a number of copies before any of this, and each grouping is
pre-aggregated, so a string held by a third of all documents is one row per task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, discard, scratch_dir, setting, shuffles_dropped, slices, spool

Q = 40
#: Sizes of the blocks of windows at each level after the first.
BLOCKS = (32, 4, 1)
CHUNK = 1 << 20
SEED = 5
#: So many bytes of text, or as many as the session's number of shuffle partitions gives, share a bucket of the table of texts.
BUCKET_BYTES = 256 << 20
#: Fixed value: the most buckets that Spark allows by default.
MOST_BUCKETS = 100_000
#: A step's tables have a file for so many bytes of text or more, but four files for each core. A file costs the same whatever is
#: in it; in a local folder Spark begins processes for each (``chmod``), of which each shares all memory of the executor at first.
FILE_BYTES = 8 << 20


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.uint64, np.uint64]:
    m = 0x2545F4914F6CDD1D
    return np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64), np.uint64(m), np.uint64(pow(m, -1, 2**64))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    _, m, inverse = _constants()
    size = CHUNK + 2 * Q
    up, down = np.full(size, m), np.full(size, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_ids(b: np.ndarray) -> np.ndarray:
    """The identifier of the q-gram bucket at each position: a rolling polynomial hash, mixed."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    table, _, _ = _constants()
    up, down = _powers()
    out = np.empty(n, np.uint64)
    for k in range(0, n, CHUNK):
        part = b[k : k + CHUNK + Q - 1]
        s = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=s[1:])
        m = len(part) - Q + 1
        out[k : k + m] = _mix((s[Q : Q + m] - s[:m]) * down[:m])
    return out


def bucket(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the buckets of ``depth`` bytes (Q times a power of two) of the suffixes at ``at``, refined from those of half the depth."""
    if depth == Q:
        return ids[at]
    half = depth // 2
    return _mix(bucket(ids, at, half) * np.uint64(0x9E3779B97F4A7C15) + bucket(ids, at + half, half))


def deeper(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identifiers of the strings [start, end), of Q bytes at least: the deepest buckets that fit, at the begin and up to the end."""
    out, size, depth = np.zeros(len(start), np.uint64), end - start, Q
    while len(size) and depth <= size.max():
        here = np.flatnonzero((size >= depth) & (size < 2 * depth))
        first, last = bucket(ids, start[here], depth), bucket(ids, end[here] - depth, depth)
        out[here] = _mix(_mix(first * np.uint64(0x9E3779B97F4A7C15) + last) + size[here].astype(np.uint64))
        depth *= 2
    return out


def runs(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, last window, anchor, and the q-gram identifiers."""
    ids = bucket_ids(b)
    n, span = len(b) - length + 1, length - Q + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (ids,)
    firsts, lasts, anchors = [], [], []
    for k in range(0, n, CHUNK):
        m = min(CHUNK, n - k)
        # the upper 40 bits of the hash, then the place: the leftmost of equal ones, in any copy of the window
        x = (_mix(ids[k : k + m + span - 1]) & ~np.uint64(0xFFFFFF)) | np.arange(m + span - 1, dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            x = np.minimum(x[: len(x) - w], x[w:])
            w *= 2
        x = np.minimum(x[:m], x[span - w : span - w + m])
        a = (x & np.uint64(0xFFFFFF)).astype(np.int64) + k
        cut = np.flatnonzero(np.diff(a)) + 1
        f = np.concatenate(([0], cut))
        firsts.append(f + k)
        lasts.append(np.concatenate((cut - 1, [m - 1])) + k)
        anchors.append(a[f])
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors), ids


def _lists(columns: list[tuple[list[np.ndarray], pa.DataType]], doc: pa.Array, names: list[str]) -> pa.RecordBatch:
    """A row per document, with a list in each column."""
    cuts = pa.array(np.cumsum([0, *map(len, columns[0][0])]), pa.int32())
    flat = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(c) if c else np.zeros(0), kind)) for c, kind in columns]
    return pa.RecordBatch.from_arrays([doc, *flat], names)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _exploded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("doc", F.inline(F.arrays_zip(*names)))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    names = ["h", "a", "hi", "lo", "u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for raw in b.column(1).to_pylist():
                p0, p1, a, ids = runs(np.frombuffer(raw, np.uint8), length)
                for c, x in zip(cols, (_long(ids[a]), a, a - p0, a - p1, _long(deeper(ids, p0, p1 + length))), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield _lists(list(zip(cols, kinds, strict=True)), b.column(0), ["doc", *names])

    out = texts.mapInArrow(run, "doc binary, h array<long>, a array<int>, hi array<int>, lo array<int>, u array<long>")
    return _exploded(out, names)


def _nodes(texts: DataFrame, asked: DataFrame, length: int, block: int) -> DataFrame:
    """Blocks of windows of the runs asked for: bucket of the whole block's string and of its core."""
    names = ["h", "k", "hi", "lo", "u", "c", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for raw, todo in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = bucket_ids(np.frombuffer(raw, np.uint8))
                a, hi, lo = (np.array([t[n] for t in todo], np.int64) for n in ("a", "hi", "lo"))
                n = hi // block - lo // block + 1
                k = np.repeat(lo // block - (np.cumsum(n) - n), n) + np.arange(n.sum())
                a, hi, lo = np.repeat(a, n), np.minimum(np.repeat(hi, n), k * block + block - 1), np.maximum(np.repeat(lo, n), k * block)
                top = np.minimum(k * block + block - 1, length - Q)
                u = deeper(ids, a - hi, a - lo + length)
                c = deeper(ids, a - k * block, a - top + length)
                for col, x in zip(cols, (_long(ids[a]), k, hi, lo, _long(u), _long(c), a), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield _lists(list(zip(cols, kinds, strict=True)), b.column(0), ["doc", *names])

    todo = asked.groupBy("doc").agg(F.collect_list(F.struct("a", "hi", "lo")).alias("todo"))  # as many as the text has runs
    out = texts.join(todo, "doc").select("doc", "text", "todo").mapInArrow(run, "doc binary, h array<long>, k array<int>, hi array<int>, lo array<int>, u array<long>, c array<long>, a array<int>")
    return _exploded(out, names)


def _refine(nodes: DataFrame, core: list[str], files: int) -> tuple[DataFrame, ...]:
    """Settled windows (doc, first, last), and one row of each kind whose core several kinds share; then the tables these read."""
    kinds = spool(nodes.groupBy(*core, "hi", "lo", "u").agg(F.count("*").alias("n"), F.min(F.struct("doc", "a")).alias("one")), "suffix_kinds", files)
    twice = spool(kinds.where("n > 1").select(*core, "hi", "lo", "u"), "suffix_twice", files)
    repeated = nodes.join(twice, [*core, "hi", "lo", "u"]).select("doc", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))
    mixed = kinds.groupBy(*core).agg(F.count("*").alias("m")).where("m > 1").select(*core)
    again = kinds.join(mixed, core).select("one.doc", "one.a", "hi", "lo")
    return repeated, again, kinds, twice


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, the bytes left).

    Every byte that is covered by a string of ``length`` bytes that starts at another place too, in
    this or another document, is removed. Overlapping occurrences count; matches end with the document.

    A null text is empty. Texts shorter than ``length`` lose nothing. Ids only label the rows: null and repeated ids are
    documents of their own, and repeated rows are copies of each other. Texts may be of any length. An empty table gives an empty
    result. Other columns don't matter. ``length`` is at least 2 Q.
    """
    if length < 2 * Q:
        raise ValueError(f"length must be at least {2 * Q}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("text")).withColumn("doc", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    name = f"tessera_{uuid.uuid4().hex}"
    # texts move once; bucketed, later joins find them in place. The more bytes, the more buckets
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    with setting(spark, "spark.sql.shuffle.partitions", lambda now: str(max(int(now), min(-(-size // BUCKET_BYTES), MOST_BUCKETS)))) as parts, shuffles_dropped(spark):
        distinct = keyed.groupBy("doc").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        distinct.write.bucketBy(int(parts), "doc").sortBy("doc").option("path", f"{scratch_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    try:
        files = max(4 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
        return _without(keyed, spark.table(name), length, with_text, files)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, f"{scratch_dir(spark)}/{name}")


def _without(keyed: DataFrame, texts: DataFrame, length: int, with_text: bool, files: int) -> DataFrame:
    """``remove_repeats`` of the rows ``keyed``, whose distinct texts are the table ``texts``, with ``files`` files a step at most."""
    found = spool(_anchors(texts.select("doc", "text").where(F.length("text") >= length), length), "suffix_anchors", files)
    # a table of its own, so that the join below can split the rows of a hot bucket
    shared = spool(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix_shared", files)
    nodes = spool(found.join(shared, "h"), "suffix_level0", files)
    discard(found, shared)
    repeated, again, *made = _refine(nodes, ["h"], files)
    settled = [repeated]
    made.append(nodes)
    for i, block in enumerate(BLOCKS):
        nodes = spool(_nodes(texts, again, length, block), f"suffix_level{i + 1}", files)
        repeated, again, *more = _refine(nodes, ["h", "k", "c"], files)
        settled.append(repeated)
        made += [nodes, *more]
    spans = settled[0]
    for s in settled[1:]:
        spans = spans.union(s)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # as many as the text has runs and blocks

    schema = "doc binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for raw, copies, found in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                edge = np.zeros(len(raw) + 1, np.int32)
                if copies > 1 and len(raw) >= length:
                    edge[0] += 1
                    edge[-1] -= 1
                elif found:
                    np.add.at(edge, [s["first"] for s in found], 1)
                    np.add.at(edge, [s["last"] + length for s in found], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], [f.split()[0] for f in schema.split(", ")])

    done = texts.join(spans, "doc", "left").select("doc", "text", "copies", "spans").mapInArrow(run, schema)
    done = spool(done, "suffix_done", files)
    discard(*made)
    return keyed.select("doc_id", "doc").join(done, "doc").drop("doc").coalesce(files)

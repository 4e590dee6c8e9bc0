"""MinHash document fingerprints, compared with the next document's and with an edited text's.

A fingerprint is the minimum of each of many universal hash functions over a text's word
shingles, cut to 16 bits a function; the share of equal lanes estimates the Jaccard likeness.

Texts are dealt out by ranges of the id and each range is streamed in order, so a document
meets its successor in the stream and texts move once. Only the last document of a
range looks for its successor elsewhere: one join of a row per range.

``linked`` and ``classes`` find near copies: bands of lanes are joined, and pairs that meet in a band are verified by the Jaccard
likeness of their texts' sets of shingles; ``alike`` does so for given pairs. Shingles count as equal if the first 32 bits of their hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import NULL_ID, components, discard, slices, spool

LANES, WIDTH, SEED = 64, 5, 7
#: Bands of fingerprints: two texts alike by 0.8 share one of 16 bands of 4 lanes with a probability of 0.9998.
BANDS = 16
BLOCK = 512
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_hash long, set_hash long"


@lru_cache(4)
def _hashes(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**64, lanes, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, lanes, dtype=np.uint64)


@lru_cache(4)
def _powers(width: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).integers(0, 2**64, width, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles (A-Z lower-cased); of the whole sequence if there are fewer words; none without a word."""
    w = np.array(list(map(crc32, text.encode().lower().split())), np.uint64)
    if not len(w):
        return w
    width = min(width, len(w))
    x = np.zeros(len(w) - width + 1, np.uint64)
    for k, p in enumerate(_powers(width)):
        x += p * (w[k : len(w) - width + 1 + k] + np.uint64(k + 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def signature(x: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """16 bits a lane; all ones if there is nothing to hash."""
    a, b = _hashes(lanes)
    low = np.full(lanes, 2**64 - 1, np.uint64)
    for k in range(0, len(x), BLOCK):
        h = np.multiply.outer(a, x[k : k + BLOCK])
        h += b[:, None]
        np.minimum(low, h.min(1), out=low)
    # the lowest value in high bits is small: mix before cutting
    low *= np.uint64(0xD6E8FEB86659FD93)
    return (low >> np.uint64(48)).astype("<u2") if len(x) else np.full(lanes, 0xFFFF, "<u2")


def likeness(s: np.ndarray, t: np.ndarray) -> float:
    """The share of equal lanes, less what 16 bits agree by chance."""
    chance = 2.0**-16
    return float(max(0.0, ((s == t).mean() - chance) / (1 - chance)))


def edit(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by as many of ``following``'s first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def distinct_shingles(text: str, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingles(text, width))


def set_hash(x: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles, given in order."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(x.tobytes())
    return h - (1 << 64) if h >> 63 else h


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """The text as compressed bytes, for the way through a shuffle; the other columns as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches):
            packed = pa.array([pack(t.encode()) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, ", ".join(f"{c} {'binary' if c == text else t}" for c, t in df.dtypes))


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(n).type) for k, n in enumerate(names)], names)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def fingerprint_pairs(docs: DataFrame, *, lanes: int = LANES, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the columns of ``ROW``; the next document is that of the next id, the first after the last.

    Null texts are empty. Null ids come first; rows of one id follow each other by their texts' hash, equal rows
    in any order. A table of one document has itself as next; an empty one gives an empty result. Texts
    without a word have one fingerprint of their own. Other columns don't matter. ``set_hash`` tells apart the texts' sets of shingles.
    """
    edge = "pid int, head string, tail string"
    names = [f.split()[0] for f in f"{ROW}, {edge}".split(", ")]
    schema = _arrow(f"{ROW}, {edge}")
    n_row = len(ROW.split(", "))

    def against(text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
        edited = edit(text, following)
        e = signature(distinct_shingles(edited, width), lanes)
        return hashlib.sha256(edited.encode()).hexdigest(), sig.tobytes(), e.tobytes(), likeness(sig, e), likeness(sig, next_sig)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = head = None
        unpack = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            out = []
            for doc_id, packed, t, pid in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = unpack(packed).decode()
                x = distinct_shingles(text, width)
                now = doc_id, text, signature(x, lanes), t, set_hash(x), pid
                if held:
                    out.append((held[0], len(held[1]), *against(held[1], held[2], text, now[2]), *held[3:], head, None))
                    head = None
                else:
                    head = text
                held = now
            yield _batch(out, names, schema)
        if held:
            yield _batch([(held[0], len(held[1]), None, held[2].tobytes(), None, None, None, *held[3:], head, held[1])], names, schema)

    order = [F.asc_nulls_first("doc_id"), F.asc("t")]
    text = F.coalesce(docs[text_col], F.lit(""))
    packed = squeezed(docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t")))
    dealt = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = spool(dealt.select("doc_id", "text", "t", F.spark_partition_id().alias("pid")).mapInArrow(stream, f"{ROW}, {edge}"), "minhash")

    heads = rows.where("head is not null").select("pid", F.col("head").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    after = Window.orderBy("pid")  # a row per range
    follow = rows.where("tail is not null").select("pid", F.coalesce(F.lead("pid").over(after), F.min("pid").over(Window.partitionBy(F.lit(0)))).alias("next_pid"))
    ends = rows.where("tail is not null").join(follow, "pid").join(heads.withColumnRenamed("pid", "next_pid"), "next_pid")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, text, sig, following, next_sig, *keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((doc_id, n, *against(text, np.frombuffer(sig, "<u2"), following, np.frombuffer(next_sig, "<u2")), *keys))
            yield _batch(out, names[:n_row], schema)

    closed = ends.select("doc_id", "n_chars", "tail", "fingerprint", "next_text", "next_fingerprint", "text_hash", "set_hash").mapInArrow(close, ROW)
    return rows.where("tail is null").select(*names[:n_row]).union(closed)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))


def nodes(docs: DataFrame, *, lanes: int = LANES, width: int = WIDTH, also: Callable[[str], int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id ``i`` (``NULL_ID`` for null), hashes of its text ``t`` and of its set of shingles ``node``, ``fingerprint``, and ``also`` of the text as ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for text in b.column(2).to_pylist():
                x = distinct_shingles(text, width)
                found.append((set_hash(x), signature(x, lanes).tobytes(), also(text) if also else 0))
            node, prints, fps = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(prints, pa.binary()), pa.array(fps, pa.int64())], ["i", "t", "node", "fingerprint", "fp"])

    return spool(_keyed(docs, id_col, text_col).mapInArrow(run, "i long, t long, node long, fingerprint binary, fp long"), "near_nodes")


def text_sets(docs: DataFrame, entries: DataFrame, width: int = WIDTH, *, id_col: str = "doc_id", text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """What gives the ``set`` of shingles of each ``node`` asked for; ``entries`` (``distinct_nodes``) says which text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            own = [np.unique((shingles(unpack(p).decode(), width) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], ["node", "set"])

    def sets(asked: DataFrame) -> DataFrame:
        of = spool(entries.join(asked, "node", "left_semi").select("node", "i", "t"), "near_asked")
        found = squeezed(_keyed(docs, id_col, text_col)).join(of.hint("merge"), ["i", "t"]).select("node", "text").mapInArrow(run, "node long, set array<int>")
        out = spool(found.dropDuplicates(["node"]), "near_sets")  # rows equal in id and text have one node
        discard(of)
        return out

    return sets


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """``i``, ``t``, ``node``, ``fingerprint`` of all rows -> one for each node, with the smallest ``i``, ``t`` that has it."""
    return spool(rows.groupBy("node").agg(F.min(F.struct("i", "t")).alias("x"), F.min("fingerprint").alias("fingerprint")).select("node", "x.i", "x.t", "fingerprint"), "near_entries")


def band_posts(entries: DataFrame, lanes: int = LANES, bands: int = BANDS) -> DataFrame:
    """``node``, ``fingerprint`` -> a posting for each band: ``node``, ``fixed``, ``value``."""
    size = 2 * lanes // bands
    posts = [F.struct(F.lit(i).cast("long").alias("fixed"), F.xxhash64(F.substring("fingerprint", size * i + 1, size)).alias("value")) for i in range(bands)]
    return entries.select("node", F.inline(F.array(*posts)))


def _within(least: float) -> Callable[[pa.Table], pa.Table]:
    """Links between the ``asks`` rows of a block and the others (``node``, ``c``, ``set``, ``asks``) that join different ``c``."""

    def run(block: pa.Table) -> pa.Table:
        node, c, asks = (block[k].to_numpy() for k in ("node", "c", "asks"))
        sets = [np.array(x, np.int32) for x in block["set"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        parent = {x: x for x in c.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for k in np.flatnonzero(asks):
            lo, hi = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
            n = hi - lo
            common = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            for m in np.flatnonzero(common >= least * (sizes + sizes[k] - common)):
                x, y = root(int(c[k])), root(int(c[m]))
                if x != y:
                    parent[x] = y
                    out.append((int(node[k]), int(node[m])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _plausible(pairs: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose share of equal lanes is not over four standard deviations below ``least``, as it is with 1 in 30,000 pairs alike by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, -1) for k in (2, 3))
                n = x.shape[1]
                keep = (x == y).mean(1) >= least - 4 * (least * (1 - least) / n) ** 0.5
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    x, y = (entries.select(F.col("node").alias(i), F.col("fingerprint").alias(f)) for i, f in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(entries: DataFrame, posts: DataFrame, sets: Callable[[DataFrame], DataFrame], *, least: float, known: DataFrame | None = None, pair_up: int = 32, tag: str = "near") -> DataFrame:
    """``node``, ``component``: the components of all pairs of nodes that share a posting and whose sets have a Jaccard likeness of ``least``.

    ``entries`` has a row with the MinHash ``fingerprint`` of each ``node``, ``posts`` the nodes' postings (``fixed``, ``value``), ``sets`` gives the ``set``
    of the nodes asked for; ``known`` are components found before. Pairs within a component need no check, and pairs whose
    lanes differ too much for ``least`` (``_plausible``) get none. Each node is first compared with the least of its postings. Where a
    posting still holds several components after that, all its pairs of different components are verified: one by one, or if it
    has over ``pair_up`` nodes, those outside the component that has the smallest node against all, in blocks of four times as many, a task each,
    that give a link per two components and no more.
    """
    key = ["fixed", "value"]

    def marked(rows: DataFrame, found: DataFrame | None) -> DataFrame:
        return rows.withColumn("c", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    def several(rows: DataFrame, more_than: int, name: str) -> DataFrame:
        """Postings with more nodes than that, of several components; their first node with its component, and the smallest component."""
        of = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("node", "c")).alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        of = spool(of.where((F.col("n") > more_than) & (F.col("lo") != F.col("hi"))).drop("hi"), f"{tag}_sizes{name}")
        out = spool(rows.join(of, key), f"{tag}_posts{name}")
        discard(of)
        return out

    def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
        x, y = (own.select(F.col("node").alias(i), F.col("set").alias(s)) for i, s in (("a", "s"), ("b", "t")))
        common = F.size(F.array_intersect("s", "t"))
        return pairs.join(x, "a").join(y, "b").where(common >= least * (F.size("s") + F.size("t") - common)).select("a", "b")

    none = entries.select("node", F.col("node").alias("component")).limit(0)
    post = several(marked(posts, known), 1, "")
    if post.isEmpty():
        return none if known is None else known
    own = sets(post.select("node"))
    ends = post.where(F.col("first.c") != F.col("c")).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    tried = spool(_plausible(ends, entries, least), f"{tag}_tried")
    found = none if known is None else known
    if not tried.isEmpty():
        links = spool(verified(tried, own), f"{tag}_links")
        found = components(links.union(found.select(F.col("component").alias("a"), F.col("node").alias("b"))), tag=f"{tag}_cc")

    rest = several(marked(post.select("node", *key), found), 2, "_rest")
    discard(post)
    if rest.isEmpty():
        discard(own)
        return found
    few, many = rest.where(F.col("n") <= pair_up), rest.where(F.col("n") > pair_up)
    x, y = (few.select(*key, F.col("node").alias(i), F.col("c").alias(c)) for i, c in (("a", "c"), ("b", "d")))
    pairs = x.join(y, key).where("a < b and c <> d").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = spool(_plausible(pairs, entries, least), f"{tag}_pairs")
    outside = F.sum((F.col("c") != F.col("lo")).cast("long"))
    sizes = spool(many.groupBy(*key).agg(F.ceil(F.count("*") / (4 * pair_up)).cast("long").alias("blocks"), F.ceil(outside / (4 * pair_up)).cast("long").alias("asking")), f"{tag}_blocks")
    dealt = many.join(sizes, key).withColumn("own", F.xxhash64("node"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = dealt.where(F.col("c") != F.col("lo")).select(*key, F.pmod("own", "asking").alias("x"), upto("blocks").alias("y"), "node", "c", F.lit(True).alias("asks"))
    answers = dealt.select(*key, upto("asking").alias("x"), F.pmod("own", "blocks").alias("y"), "node", "c", F.lit(False).alias("asks"))
    in_blocks = asks.union(answers).join(own, "node").groupBy(*key, "x", "y").applyInArrow(_within(least), "a long, b long")
    more = spool(verified(pairs, own).union(in_blocks), f"{tag}_more")
    discard(rest, own, pairs, sizes)
    if more.isEmpty():
        return found
    return components(more.union(found.select(F.col("component").alias("a"), F.col("node").alias("b"))), tag=f"{tag}_all")


def classes(rows: DataFrame, docs: DataFrame, *, least: float = 0.8, lanes: int = LANES, bands: int = BANDS, width: int = WIDTH, pair_up: int = 32) -> DataFrame:
    """``rows`` of ``fingerprint_pairs(docs)`` with ``class_id``: the smallest id reached by links between texts that share a band and are alike by ``least``.

    Links are verified by the Jaccard likeness of the sets of shingles of the texts in ``docs``. Equal sets are one entry. Each row has a class by its own
    text, whatever others have its id. A null id is smaller than all others. An empty table gives an empty result.
    """
    of = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("i"), F.col("text_hash").alias("t"), F.col("set_hash").alias("node"), "fingerprint")
    entries = distinct_nodes(of)
    found = linked(entries, band_posts(entries, lanes, bands), text_sets(docs, entries, width), least=least, pair_up=pair_up, tag="minhash")
    own = spool(entries.join(found, "node", "left").select("node", "i", F.coalesce("component", "node").alias("c")), "minhash_own")
    lead = spool(own.groupBy("c").agg(F.min("i").alias("__c")), "minhash_leads")
    known = spool(own.join(lead, "c").select(F.col("node").alias("set_hash"), "__c"), "minhash_known")
    return rows.join(known, "set_hash").select(*rows.columns, F.when(F.col("__c") != NULL_ID, F.col("__c")).alias("class_id"))


def alike(docs: DataFrame, pairs: DataFrame, least: float = 0.8, width: int = WIDTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``a``, ``b`` of ids whose texts' sets of word shingles have a Jaccard likeness of ``least`` or more, with it as ``jaccard``.

    Only texts of the ids asked for are shingled. Ids must be unique in ``docs``; pairs with unknown ids are left out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [distinct_shingles(t or "", width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["i", "s"])

    asked = spool(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "alike_asked")
    texts = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).join(asked, "i")
    texts = spool(texts.mapInArrow(sets, "i long, s array<long>"), "alike_sets")
    both = pairs.join(texts.select(F.col("i").alias("a"), F.col("s").alias("x")), "a").join(texts.select(F.col("i").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    jaccard = common / F.nullif(F.size("x") + F.size("y") - common, F.lit(0))
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)

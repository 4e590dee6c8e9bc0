"""SimHash near-dedup by an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most k bits differ in at most k of their 8 bytes, so
they are guaranteed to match in 8 - k byte positions. The index posts fingerprints under (position, byte). Two that
share a posting get a tally of all their positional bytes in common; pairs whose tally reaches the guaranteed minimum are
retained and verified bit by bit.

A posting of a single byte holds 1/256 of all fingerprints, so its pairs would grow with the square of the
documents. Postings with more entries than ``pair_up`` are therefore not paired off but extended by each later position in turn, and so
on as far as the guaranteed minimum. A pair is met where the posting's positions are its first matching ones: that is
one place, so no pair is met twice, and none with enough matches is missed. An index of many fingerprints starts with several
positions at once. A posting that is still large when the minimum is reached is probed: each entry looks up the values at most k bits away in
the k free bytes, so the work stays in proportion to the entries.

Equal fingerprints are one entry of the index, so copies never form pairs. Where texts are compared by the Jaccard likeness of
their shingles, see ``linked``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, components, discard, slices, spool
from tessera.llm.minhash import band_posts, distinct_nodes, linked, nodes, text_sets

SEED = 42


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text in lower case (A-Z) with one space between words, and where each word begins and ends."""
    b = np.frombuffer(text.encode().lower(), np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    line = np.where(gap, np.uint8(32), b)[~gap | np.append(~gap[1:], False)].tobytes().lstrip(b" ")
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    return line, np.append(0, ends[:-1] + 1), ends


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of one text, words lower-cased in A-Z."""
    from xxhash import xxh64_intdigest

    line, starts, ends = _words(text or "")
    if not line:
        return 0
    width = min(width, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 15):
        spans = zip(starts[k : k + (1 << 15)].tolist(), ends[k : k + (1 << 15)].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(line[a:z], SEED) for a, z in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte(p: Column) -> Column:
    """A mask of the byte at position ``p``."""
    return F.call_function("shiftleft", F.lit(255).cast("long"), (8 * p).cast("int"))


def _index(entries: DataFrame, depth: int, k: int) -> DataFrame:
    """``fp`` under each choice of ``depth`` positions that can be a pair's first matching ones: ``fixed`` is their mask, ``value`` the bytes there."""
    masks = [_signed(sum(255 << 8 * p for p in positions)) for positions in combinations(range(k + depth), depth)]
    return entries.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("fixed")).withColumn("value", F.col("fp").bitwiseAND(F.col("fixed")))


def _extended(postings: DataFrame, depth: int, k: int) -> DataFrame:
    """Postings of ``depth`` positions under one more, behind those they have."""
    later = [F.lit(p) for p in range(depth, k + depth + 1)]
    free = F.filter(F.array(*later), lambda p: _behind(F.col("fixed"), p))
    asked = postings.select("fp", "fixed", F.explode(free).alias("p"))
    return asked.select("fp", F.col("fixed").bitwiseOR(_byte(F.col("p"))).alias("fixed")).withColumn("value", F.col("fp").bitwiseAND(F.col("fixed")))


def _behind(fixed: Column, p: Column) -> Column:
    """Whether position ``p`` comes after all of ``fixed``."""
    return F.call_function("shiftrightunsigned", fixed, (8 * p).cast("int")) == 0


def _matches(differ: Column) -> Column:
    """A mask of the bytes in which two fingerprints match."""
    masks = [F.lit(_signed(255 << 8 * p)).cast("long") for p in range(8)]
    return reduce(Column.bitwiseOR, [F.when(differ.bitwiseAND(m) == 0, m).otherwise(F.lit(0).cast("long")) for m in masks])


def _tally(differ: Column) -> Column:
    return sum((differ.bitwiseAND(F.lit(_signed(255 << 8 * p))) == 0).cast("int") for p in range(8))


def _met_here(fixed: Column, differ: Column) -> Column:
    """Whether the posting's positions are the pair's first matching ones."""
    others = _matches(differ).bitwiseAND(F.bitwise_not(fixed))
    return (others == 0) | ((fixed >= 0) & (others.bitwiseAND(-others) > fixed))  # the lowest of the others lies above the posting's last


def _probe(many: DataFrame, k: int) -> DataFrame:
    """Pairs of one posting that differ in at most ``k`` bits of its ``k`` free bytes, by looking up every such value."""
    near = [sum(1 << b for b in bits) for n in range(1, k + 1) for bits in combinations(range(8 * k), n)]
    free = F.filter(F.array(*map(F.lit, range(0, 64, 8))), lambda u: F.call_function("shiftright", F.col("fixed"), u).bitwiseAND(F.lit(1)) == 0)
    asked = many.select("fp", "fixed", free.alias("free")).select("fp", "fixed", "free", F.explode(F.array(*map(F.lit, near))).alias("m"))
    byte = lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.col("m"), F.lit(8 * i)).bitwiseAND(F.lit(255)).cast("long"), F.get("free", F.lit(i)))
    flips = reduce(Column.bitwiseOR, [byte(i) for i in range(k)])
    asked = asked.select("fixed", F.col("fp").alias("f"), F.col("fp").bitwiseXOR(flips).alias("g")).where("f < g")
    return asked.join(many.select("fixed", F.col("fp").alias("g")), ["fixed", "g"]).where(_met_here(F.col("fixed"), F.col("f").bitwiseXOR(F.col("g")))).select("f", "g")


def candidates(entries: DataFrame, *, max_bits: int = 2, pair_up: int = 128) -> DataFrame:
    """Distinct ``fp`` -> pairs ``f`` < ``g`` within ``max_bits``, each once, with the tally of ``equal_bytes``. No pair is missing."""
    if not 1 <= max_bits < 8:
        raise ValueError("max_bits must be 1 to 7")
    k, least, key = max_bits, 8 - max_bits, ["fixed", "value"]
    differ = F.col("f").bitwiseXOR(F.col("g"))
    depth = min(least, max(1, ceil(log(max(1, entries.count()) / 64, 256))))  # an average posting has 64 entries at most
    postings, met = _index(entries, depth, k), []
    while True:
        sizes = spool(postings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "simhash_sizes")
        here = spool(postings.join(sizes, key), f"simhash_postings_{depth}")
        few, many = here.where(F.col("n") <= pair_up), here.where(F.col("n") > pair_up)
        x, y = few.select(*key, F.col("fp").alias("f")), few.select(*key, F.col("fp").alias("g"))
        pairs = x.join(y, key).where((F.col("f") < F.col("g")) & (_tally(differ) >= least) & _met_here(F.col("fixed"), differ))
        met.append(spool(pairs.where(F.bit_count(differ) <= max_bits).select("f", "g"), "simhash_met"))
        discard(sizes)
        if many.isEmpty():
            break
        if depth == least:
            met.append(spool(_probe(many, k), "simhash_probed"))
            break
        postings, depth = _extended(many, depth, k), depth + 1
    return reduce(DataFrame.union, met).withColumn("equal_bytes", _tally(differ))


def near_duplicates(
    docs: DataFrame, *, width: int = 3, max_bits: int = 2, alike: float | None = None, alike_width: int = 5, pair_up: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    Fingerprints of shingles of ``width`` words link at ``max_bits`` or fewer differing bits, and equal ones always. Null and blank
    texts have fingerprint 0 and link like any others. A null id is smaller than all
    others. Repeated ids are one node, so the components of their texts are joined. Texts are read whole. An empty
    table gives an empty result. Other columns don't matter.

    With ``alike``, texts link if their sets of ``alike_width``-word shingles have at least that Jaccard likeness, whatever their
    fingerprints. Candidates are the pairs of the index, equal fingerprints, and pairs that share a band of
    MinHash lanes of these sets, since texts alike by 0.8 differ in 8 bits or so (``linked``). Rows are then told apart by id and text, and there are two more
    columns: ``text_hash``, and ``leads``, which is true of the row with the smallest id (and hash) of each component, and of rows equal to it.
    """
    if alike is not None:
        return _near_texts(docs, width, max_bits, alike, alike_width, pair_up, id_col, text_col)
    fps = spool(fingerprints(docs, width, id_col=id_col, text_col=text_col), "simhash")
    node = F.coalesce("doc_id", F.lit(NULL_ID))
    entries = spool(fps.groupBy("fp").agg(F.min(node).alias("lead")), "simhash_entries")
    pairs = candidates(entries.select("fp"), max_bits=max_bits, pair_up=pair_up)
    x, y = (entries.select(F.col("fp").alias(f), F.col("lead").alias(a)) for f, a in (("f", "a"), ("g", "b")))
    pairs = spool(pairs.select("f", "g").join(x, "f").join(y, "g"), "simhash_pairs")
    repeated = fps.select(node.alias("b"), "fp").distinct().join(entries, "fp").select(F.col("lead").alias("a"), "b")
    several = repeated.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")  # ids that carry several fingerprints
    found = components(pairs.select("a", "b").union(repeated.join(several, "b").select("a", "b")), tag="simhash_cc")
    classes = spool(entries.join(found, F.col("lead") == F.col("node"), "left").select("fp", F.coalesce("component", "lead").alias("c")), "simhash_classes")
    return fps.join(classes, "fp").select("doc_id", _hex("fp").alias("fingerprint"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"))


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _near_texts(docs: DataFrame, width: int, max_bits: int, alike: float, alike_width: int, pair_up: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with a likeness: nodes are sets of shingles, and only equal sets link unchecked."""
    rows = nodes(docs, width=alike_width, also=partial(fingerprint, width=width), id_col=id_col, text_col=text_col)
    entries = distinct_nodes(rows)
    sets = text_sets(docs, entries, alike_width, id_col=id_col, text_col=text_col)
    found = linked(entries, band_posts(entries), sets, least=alike, pair_up=max(1, pair_up // 4), tag="near_bands")
    by_print = spool(rows.select("node", "fp").distinct(), "near_prints")
    pairs = candidates(by_print.select("fp").distinct(), max_bits=max_bits, pair_up=pair_up)
    pair = [F.col("f").alias("fixed"), F.col("g").alias("value")]
    posts = by_print.select("node", F.col("fp").alias("fixed"), F.col("fp").alias("value"))
    for end in "fg":
        posts = posts.union(pairs.join(by_print, F.col(end) == F.col("fp")).select("node", *pair))
    found = linked(entries, spool(posts, "near_print_posts"), sets, least=alike, known=found, pair_up=max(1, pair_up // 4), tag="near_prints")
    own = spool(rows.join(found, "node", "left").select("i", "t", "fp", F.coalesce("component", "node").alias("c")), "near_own")
    lead = spool(own.groupBy("c").agg(F.min(F.struct("i", "t")).alias("lead")).select("c", F.col("lead.i").alias("lead"), F.col("lead.t").alias("lead_t")), "near_leads")
    discard(rows, entries, by_print)
    null_low = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return own.join(lead, "c").select(
        null_low("i").alias("doc_id"), _hex("fp").alias("fingerprint"), null_low("lead").alias("component_id"), F.col("t").alias("text_hash"), ((F.col("i") == F.col("lead")) & (F.col("t") == F.col("lead_t"))).alias("leads")
    )

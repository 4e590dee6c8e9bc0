"""Line dedup over a whole corpus, as bitmaps of the lines each document keeps.

Hashes of the lines are dealt out by range with (document, position) as secondary
sort, so that one line held by a third of all documents is spread over as many
ranges as it needs. Each range is streamed in order: a row that opens a new
(line, document) run counts a document, the first document of a line's run keeps it.
Only hashes, ids and positions are shuffled; texts move once, in ``kept_text``.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import NULL_ID, discard, fresh, named, range_spool, spool

#: The white space that a key is stripped of.
SPACE = "\t\n\x0b\x0c\r "
#: Names of the columns that ``line_dedup`` adds; underscores are put behind them while the input has one of the names.
ADDED = ("__n_lines", "__n_dropped")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z and leave every other letter.

    ``lower`` does the same, and much faster than ``translate``, where no other upper-case letter occurs.
    """
    plain = (F.octet_length(s) == F.char_length(s)) | ~s.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by id and text; equal rows share one bitmap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__d"), text.alias("__text")
    ).withColumn("__t", F.xxhash64("__text"))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__d``, ``__t``, ``keep_bitmap`` (64 lines' bits by word number), ``n_dropped``.

    A document that keeps all its lines has no row, and a word of 64 lines that are
    all kept has no entry: that is the compression. A line is dropped if its key has
    at least ``min_chars`` code points, is held by at least ``min_docs`` documents,
    and the document is not the one of largest id that holds it.
    """
    line = F.col("line")
    lines = (
        _keyed(docs, id_col, text_col)
        .select("__d", "__t", F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
        .where(F.octet_length(line) >= min_chars)
        .select("__d", "__t", "pos", line_key(line).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"), "__d", "__t", "pos")
    )
    lines = spool(lines, "line_hashes")
    order = [F.asc("h"), F.desc("__d"), F.asc("pos"), F.asc("__t")]
    runs = range_spool(lines, order, "line_ranges")
    discard(lines)

    stream = Window.partitionBy("__pid").orderBy(*order)
    opens = (F.lag("h").over(stream) != F.col("h")) | (F.lag("__d").over(stream) != F.col("__d"))
    held = (
        runs.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("long"))
        .groupBy("h", "__pid")
        .agg(F.sum("opens").alias("docs"), F.max("__d").alias("first"), F.min("__d").alias("last"))
    )
    # a document cut by a range boundary was counted on both sides
    cut = (F.lag("last").over(Window.partitionBy("h").orderBy("__pid")) == F.col("first")).cast("long")
    common = (
        held.withColumn("docs", F.col("docs") - F.coalesce(cut, F.lit(0)))
        .groupBy("h")
        .agg(F.sum("docs").alias("docs"), F.max("first").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h", "keeper")
    )
    common = spool(common, "common_lines")  # a table of known size: small ones are broadcast, else a hot line's rows can be split
    words = (
        runs.join(common, "h")
        .where(F.col("__d") < F.col("keeper"))
        .groupBy("__d", "__t", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    )
    return words.groupBy("__d", "__t").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("keep_bitmap"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
    )


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that ``bitmap`` keeps, joined by newlines; a null bitmap keeps all."""
    kept = F.filter(
        F.split(text, "\n"),
        lambda _, i: F.coalesce(F.getbit(F.try_element_at(bitmap, (i / 64).cast("int")), i % 64) == 1, F.lit(True)),
    )
    return F.when(bitmap.isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text after dropping lines, and two more for the lines there were and those dropped, named ``fresh(docs.columns, *ADDED)``.

    Null text counts as one empty line and stays null. A null id is a document of its own that is
    below all others. Rows of one id are one document; equal rows get equal results. An empty table
    gives an empty result. Other columns are carried along whatever they are called.
    """
    bits = keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs, id_col=id_col, text_col=text_col)
    d, t, keep, n = fresh(docs.columns, "__d", "__t", "__bits", "__n")
    n_lines, n_dropped = fresh(docs.columns, *ADDED)
    text = F.coalesce(named(text_col), F.lit(""))
    keyed = docs.withColumns({d: F.coalesce(named(id_col).cast("long"), F.lit(NULL_ID)), t: F.xxhash64(text)})
    joined = keyed.join(bits.toDF(d, t, keep, n), [d, t], "left")
    out = [F.when(named(text_col).isNotNull(), kept_text(text, F.col(keep))).alias(text_col) if c == text_col else named(c) for c in docs.columns]
    return joined.select(*out, F.size(F.split(text, "\n")).cast("long").alias(n_lines), F.coalesce(n, F.lit(0)).cast("long").alias(n_dropped))

"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash covers a line and the one before it. A chunk ends after a line whose rolling hash is a local minimum, so
chunks have two lines or more (but for a text's last), and an insertion moves only the boundaries next to it. Of chunks of
two or more lines that occur more than once, all but the first, by doc_id and place, are removed. Hashes find the
candidates; the chunks' bytes, as grouping and join keys, decide.

Edge cases: a null text stays null; an empty text is one empty line; a text may end up empty and its row stays. Rows with a
null doc_id are left as they are. Rows with equal doc_id and text are one document, whose chunks are the same place; of rows
with equal doc_id and different texts the order is that of a hash of the text. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.scratch import own, split_join, stored, unused

PRIME, NOW, BEFORE = 2**31 - 1, 1_000_003, 654_435_761


def bind(value: Column, use) -> Column:
    """use(value) with value computed once a row, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def line_hash(line: Column) -> Column:
    """28 bits that other engines have too."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunk_ends(lines: Column) -> Column:
    """Indices of the last lines of the chunks."""

    def ends(roll: Column) -> Column:
        n = F.size(roll)
        is_low = lambda i: (i >= 1) & (F.get(roll, i) < F.get(roll, i - 1)) & (F.get(roll, i) <= F.get(roll, i + 1))
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | F.coalesce(is_low(i), F.lit(False)))

    rolled = lambda h: F.zip_with(h, F.concat(F.array(F.lit(0).cast("long")), F.slice(h, 1, F.size(h) - 1)), lambda now, before: F.pmod(now * NOW + before * BEFORE, F.lit(PRIME)))
    return bind(F.transform(lines, line_hash), lambda h: bind(rolled(h), ends))


def chunks(text: Column) -> Column:
    """array of (k, lines, text) of a text; null for null."""

    def cut(lines: Column) -> Column:
        def parts(ends: Column) -> Column:
            begin = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return F.transform(ends, lambda e, k: F.struct(k.alias("k"), (e - begin(k) + 1).alias("lines"), F.array_join(F.slice(lines, begin(k) + 1, e - begin(k) + 1), "\n").alias("text")))

        return bind(chunk_ends(lines), parts)

    return F.when(text.isNotNull(), bind(F.split(text, "\n", -1), cut))


def text_key(text: Column) -> Column:
    """Tells rows with equal doc_id and different texts apart."""
    return F.xxhash64(text)


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key (text_key), gone: the k of its chunks that occur earlier."""
    each = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("key"), F.explode(F.filter(chunks(F.col("text")), lambda c: c.lines >= 2)).alias("c"))
    each = each.select("doc_id", "key", F.col("c.k").alias("k"), F.col("c.text").alias("chunk")).withColumn("h", F.xxhash64("chunk"))
    place = F.struct("doc_id", "key", "k")
    often = each.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("h")
    # merged at every size: a chunk that very many documents share is split, and no table of chunks is broadcast
    candidates = stored(split_join(each, often.hint("merge"), "h", "left_semi"), "lines-candidates")
    # grouping and joining by the bytes themselves is the comparison
    first = candidates.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h", "chunk", "first")
    later = split_join(candidates, first.hint("merge"), ["h", "chunk"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("k")).alias("gone"))  # one document's chunks


def without(parts: Column, gone: Column) -> Column:
    """parts but for the places in gone, which ascend: the stretches between them, so that no part looks through gone."""
    after = lambda i: F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))
    between = F.transform(gone, lambda k, i: F.slice(parts, after(i) + 1, k - after(i)))
    return F.concat(F.flatten(between), F.slice(parts, after(F.size(gone)) + 1, F.size(parts)))


def dedup(docs: DataFrame, counts: tuple[str, str] = ("chunks_removed", "lines_removed")) -> DataFrame:
    """docs with the repeated chunks cut from text, and behind its columns the numbers of chunks and lines removed, named as
    counts says; a number stands behind a name that docs has already."""
    ident, key, gone, new = unused(docs.columns, "lines_id", "lines_key", "lines_gone", "lines_new")
    chunk_count, line_count = unused(docs.columns, *counts)
    found = repeated(docs.select("doc_id", "text")).select(F.col("doc_id").alias(ident), F.col("key").alias(key), F.col("gone").alias(gone))
    both = docs.join(found, (F.col("doc_id") == F.col(ident)) & (text_key(F.col("text")) == F.col(key)), "left")
    split = F.when(F.col(gone).isNotNull(), bind(chunks(F.col("text")), lambda all_: F.struct(
        F.array_join(F.transform(without(all_, F.col(gone)), lambda c: c.text), "\n").alias("text"),
        F.aggregate(F.col(gone), F.lit(0), lambda n, k: n + F.get(all_, k).lines).alias("lines"),
    )))
    both = both.withColumn(new, split)
    left = [F.when(F.col(gone).isNotNull(), F.col(new).text).otherwise(F.col("text")).alias("text") if name == "text" else c for name, c in zip(docs.columns, own(docs))]
    return both.select(*left, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(chunk_count), F.coalesce(F.col(new).lines, F.lit(0)).cast("long").alias(line_count))

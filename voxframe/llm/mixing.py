"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words. Within a source longer documents are taken somewhat more often: a document of n words
is of length class c = floor(log2 n), and the expected copies of class c are in proportion to LEAN + c, at most CAP each,
so that the expected words of a source are its target. The whole part of a document's expected copies is certain; the
fraction p, which differs from class to class, is its inclusion probability. The documents of a source are ranked by
odds(u) / odds(p), u a uniform number from a hash of doc_id, and the longest prefix whose words stay within what the certain
copies leave is taken: a sample of fixed size in words with unequal probabilities. Each document's chance of a further copy
is p but for the end of the prefix, which a longer document misses more often: about one document's share of a source, less
as sources grow. One more document a source, the one that brings the total nearest to the target, is added.

The cut is found by counts, not by sorting: words per (source, range of rank), with BUCKETS ranges, then again within the
range of the cut, LEVELS times; only the last such range is sorted. So no task holds a source, however hot, and what each
document gets follows from its own row and one row of its source: texts are not shuffled.

Edge cases: null text has size 0, which is never taken beyond the certain copies; a null source is a source of its own,
ranked last; a row without doc_id draws u from its text. Rows alike in source, rank, doc_id and size are taken alike, all or
none; an empty table gives an empty result; all targets are 0 if all sizes are 0. Other columns keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.llm.scratch import own, stored, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, LEAN, BUCKETS, LEVELS, SEED = (5, 2, 1), 3, 16, 1024, 2, "mix1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a hash that other engines have too."""
    ident = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def length_class(size: Column) -> Column:
    """floor(log2(size)); 0 for 0."""
    return F.length(F.bin(size)) - 1


def _filled(sizes: DataFrame, group: list[str], place: list[Column], weight: Column, cap: int) -> DataFrame:
    """Of sizes(group, size, total) the shares of a group's total by weight as column share, none over cap times its size, the
    excess shared anew."""
    ranked = sizes.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*place))).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("size").cast("double"))
    order = W.partitionBy(*group).orderBy(F.col("most") / F.col("weight"), "place")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("level") > F.col("most") / F.col("weight")).withColumn("step", F.row_number().over(order))
    common = F.min_by("level", F.when(~F.col("full"), F.col("step"))).over(everything)
    return leveled.withColumn("share", F.when(F.col("full"), F.col("most")).otherwise(F.least(common * F.col("weight"), F.col("most"))))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) -> and target: shares of all words by weight, none over cap times its source's size, the
    excess shared anew. One row per source goes through single windows: sources, unlike documents, are few."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    given = sizes.select("source", F.col("source_size").alias("size")).withColumn("total", F.sum("size").over(W.partitionBy()).cast("double"))
    return _filled(given, [], [F.col("source").asc_nulls_last()], weight, cap).select("source", F.col("size").alias("source_size"), F.col("share").alias("target"))


def allotted(base: DataFrame, weights=WEIGHTS, cap: int = CAP, lean: int = LEAN) -> DataFrame:
    """base(source, class, size) -> per source and class: source_size, target, sure (certain copies), p (inclusion
    probability of one more) and gap (words that the certain copies of the source leave). Sums are partial before any
    shuffle, so a hot source costs at most 64 rows a task."""
    by_class = stored(base.groupBy("source", "class").agg(F.sum("size").alias("size")), "mix-classes")
    shares = targets(by_class.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    given = by_class.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("total", F.col("target"))
    weight = F.greatest(F.col("size"), F.lit(1)).cast("double") * (F.lit(float(lean)) + F.col("class"))
    each = F.when(F.col("size") > 0, F.col("share") / F.col("size")).otherwise(F.lit(0.0))
    full = _filled(given, ["source"], [F.col("class")], weight, cap).withColumn("each", each).withColumn("sure", F.floor("each")).withColumn("p", F.col("each") - F.col("sure"))
    certain = F.sum(F.col("sure") * F.col("size")).over(W.partitionBy("source"))
    return stored(full.withColumn("gap", F.col("target") - certain).select("source", "class", "source_size", "target", "sure", "p", "gap"), "mix-allotted")


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _same_source(right: str) -> Column:
    return F.col("source").eqNullSafe(F.col(right))


def decisions(base: DataFrame, weights=WEIGHTS, cap: int = CAP, lean: int = LEAN, buckets: int = BUCKETS, levels: int = LEVELS) -> DataFrame:
    """base(doc_id, source, size, u, class), stored -> allotted(), and cut, the (rank, doc_id, size) up to which open rows
    are taken, and pick, the one that is taken besides; stored."""
    shares = allotted(base, weights, cap, lean)
    open_rows = ranked(base, shares).where("open")
    # the range of the cut, narrowed level by level; start: words in the ranges before it
    within, finest = None, buckets**levels
    for level in range(1, levels + 1):
        rows = open_rows.withColumn("range", F.least(F.floor(F.col("rank") * buckets**level), F.lit(buckets**level - 1)))
        if within is not None:
            rows = rows.join(within, _same_source("of") & (F.floor(F.col("range") / buckets) == F.col("b"))).drop("of", "b")
        else:
            rows = rows.withColumn("start", F.lit(0).cast("long"))
        sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("gap").alias("room"), F.first("start").alias("start"))
        upto = F.col("start") + F.sum("words").over(W.partitionBy("source").orderBy("range"))
        cut = sums.withColumn("upto", upto).where("upto > room").groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("start"))).alias("c"))
        within = stored(cut.select(F.col("source").alias("of"), F.col("c.range").alias("b"), F.col("c.start").alias("start")), "mix-range")
    last = open_rows.withColumn("range", F.least(F.floor(F.col("rank") * finest), F.lit(finest - 1))).join(within, _same_source("of") & (F.col("range") == F.col("b")))
    alike = W.partitionBy("source").orderBy("rank", "doc_id", "size").rangeBetween(W.unboundedPreceding, W.currentRow)
    fits = last.withColumn("upto", F.col("start") + F.sum("size").over(alike)).withColumn("key", F.struct("rank", "doc_id", "size"))
    # a source without such a range is taken whole; where nothing of the range fits, the cut is before it
    cut = fits.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("key"))).alias("fit"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("upto"), F.first("start").alias("start"), F.first("b").alias("b"))
    edge = F.struct((F.col("b") / finest).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("size"))
    cuts = stored(cut.select(F.col("source").alias("of"), F.coalesce("fit", edge).alias("cut"), F.coalesce("upto", "start").alias("spent")), "mix-cuts")
    rest = open_rows.join(cuts, _same_source("of")).where(F.struct("rank", "doc_id", "size") > F.col("cut")).withColumn("left", F.col("gap") - F.col("spent"))
    off = F.abs(F.col("size") - F.col("left"))
    picks = rest.where(off < F.col("left")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size")).alias("p")).select(F.col("source").alias("for"), F.struct("p.rank", "p.doc_id", "p.size").alias("pick"))
    return stored(shares.join(cuts.drop("spent"), _same_source("of"), "left").join(picks, _same_source("for"), "left").drop("of", "for"), "mix-decisions")


def ranked(base: DataFrame, shares: DataFrame) -> DataFrame:
    """base with its row of shares, rank in (0, 1), which orders as odds(u) / odds(p), and open: may have one more copy."""
    rows = base.join(shares.withColumnsRenamed({"source": "of", "class": "in"}), _same_source("of") & (F.col("class") == F.col("in"))).drop("of", "in")
    ratio = _odds(F.col("u")) / _odds(F.col("p"))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, ratio / (ratio + 1.0)).otherwise(F.lit(1.0)))
    return rows.withColumn("open", (F.col("p") > 0) & (F.col("size") > 0))


def copies(rows: DataFrame) -> Column:
    """How often each row of ranked(base, decisions) is taken."""
    key = F.struct("rank", "doc_id", "size")
    more = F.col("open") & (F.col("cut").isNull() | (key <= F.col("cut")) | F.coalesce(key.eqNullSafe(F.col("pick")), F.lit(False)))
    return F.col("sure") + F.when(more, F.lit(1)).otherwise(F.lit(0))


def prepared(sized: DataFrame) -> DataFrame:
    return sized.withColumn("class", length_class(F.col("size")))


def mix(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS, lean: int = LEAN, levels: int = LEVELS) -> DataFrame:
    """sized(doc_id, source, size, and text where doc_id may be null) -> doc_id, source, size, source_size, target, copies (how
    often each row is taken)."""
    text = F.col("text") if "text" in sized.columns else F.lit(None).cast("string")
    base = stored(prepared(sized.select("doc_id", "source", "size", uniform(F.col("doc_id"), text, seed).alias("u"))), "mix-sizes")
    rows = ranked(base, decisions(base, weights, cap, lean, buckets, levels))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies(rows).alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), F.col("text").cast("string").alias("text"))


def apply(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. docs is read twice, for the decisions
    and for the rows, whose size and rank are computed again where they lie; only a table of (source, class) meets them."""
    name = unused(["doc_id", "source", "size", "u", "class"], "mixed")[0]
    small = sized(docs).select("doc_id", "source", "size", uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    decided = decisions(stored(prepared(small), "mix-sizes"), weights, cap)
    beside = docs.select(F.struct(*own(docs)).alias(name), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), uniform(F.col("doc_id").cast("long"), F.col("text").cast("string"), seed).alias("u"))
    rows = ranked(prepared(beside), decided)
    taken = rows.select(name, copies(rows).cast("int").alias("copies")).where("copies > 0").select(name, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(name).getField(c).alias(c) for c in docs.columns))

"""TextGrid documents from segments and back, as DataFrame projections: one text per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.segments import fill_gaps

TIERS = ("SpeakerA", "SpeakerB", "Overlap", "Leak")
TIER_OF = {"A": "SpeakerA", "B": "SpeakerB", "OVL": "Overlap", "LEAK": "Leak"}


def number(value: Column) -> Column:
    """Six decimals, without zeros and a point at the end."""
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def render(segments: DataFrame, tiers: tuple[str, ...] | DataFrame = TIERS, silence: str = "#", clip: bool = False) -> DataFrame:
    """segments(rec, tier, start_time, end_time, label) -> rec, document. Gaps of every tier up to the recording's end hold
    ``silence``. tiers are names, in order, or a table (rec, tier, place) where recordings differ. A document is one row, so a
    recording's segments are gathered per recording."""
    live = segments.where("end_time > start_time") if clip else segments
    ends = live.groupBy("rec").agg(F.max("end_time").alias("xmax"))
    if isinstance(tiers, DataFrame):
        places = tiers.join(ends, "rec").select("rec", "tier", "place", "xmax")
    else:
        places = ends.select("rec", "xmax", F.posexplode(F.array(*map(F.lit, tiers))).alias("place", "tier")).select("rec", "tier", (F.col("place") + 1).alias("place"), "xmax")
    filled = fill_gaps(live.select("rec", "tier", "start_time", "end_time", "label"), places.select("rec", "tier", "xmax"), silence, ("rec", "tier"), clip)
    rows = F.array_sort(F.collect_list(F.struct("start_time", "end_time", "label")))
    block = lambda x, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n            xmin = "), number(x.start_time), F.lit("\n            xmax = "), number(x.end_time), F.lit('\n            text = "'), x.label, F.lit('"'))
    per = filled.groupBy("rec", "tier").agg(rows.alias("rows")).join(places, ["rec", "tier"])
    head = F.concat(F.lit("    item ["), F.col("place").cast("string"), F.lit(']:\n        class = "IntervalTier"\n        name = "'), F.col("tier"), F.lit('"\n        xmin = 0\n        xmax = '), number(F.col("xmax")), F.lit("\n        intervals: size = "), F.size("rows").cast("string"))
    text = F.concat_ws("\n", head, F.array_join(F.transform("rows", block), "\n"))
    docs = per.select("rec", "xmax", F.struct(F.col("place"), text.alias("text")).alias("item")).groupBy("rec", "xmax").agg(F.array_sort(F.collect_list("item")).alias("items"))
    top = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), number(F.col("xmax")), F.lit("\ntiers? <exists>\nsize = "), F.size("items").cast("string"), F.lit("\nitem []:\n"))
    return docs.select("rec", F.concat(top, F.array_join(F.transform("items", lambda x: x.text), "\n")).alias("document"))


def transcript_document(segments: DataFrame, words: DataFrame) -> DataFrame:
    """segments(rec, speaker, start_time, end_time, text) and words(rec, speaker, start_time, end_time, word) -> rec,
    document with the tiers segments_X and words_X of each speaker X, or segments and words where a recording names none.
    Overlaps are cut at the end of what came before; what has no length goes."""
    kinds = (("segments", segments, "text"), ("words", words, "word"))
    rows = None
    for k, (kind, table, label) in enumerate(kinds):
        part = table.select("rec", "speaker", F.lit(kind).alias("kind"), F.lit(k).alias("k"), "start_time", "end_time", F.coalesce(F.col(label), F.lit("")).alias("label"))
        rows = part if rows is None else rows.unionByName(part)
    named = segments.groupBy("rec").agg((F.count("speaker") > 0).alias("named"))
    rows = rows.join(named, "rec").where("speaker is not null or not named")
    tier = F.when(F.col("named"), F.concat_ws("_", "kind", "speaker")).otherwise(F.col("kind"))
    rows = rows.withColumn("tier", tier)
    owners = segments.join(named, "rec").where("speaker is not null or not named").select("rec", "named", F.when(F.col("named"), F.col("speaker")).alias("speaker")).distinct()
    tiers = owners.select("rec", "named", "speaker", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, _, _) in enumerate(kinds)])).alias("x")).select("rec", "named", "speaker", "x.k", "x.kind")
    places = tiers.withColumn("tier", tier).withColumn("place", F.row_number().over(W.partitionBy("rec").orderBy("speaker", "k"))).select("rec", "tier", "place")
    return render(rows.select("rec", "tier", "start_time", "end_time", "label"), places, "", True)


#: fixed value: the tiers of an annotation's document, in order
ANNOTATION_TIERS = ("words", "phonemes", "ipus", "states")


def annotation_document(**tables: DataFrame) -> DataFrame:
    """words, phonemes, ipus and states, each (rec, start_time, end_time, label) where given -> rec, document with a tier of
    each name; gaps are empty, and overlaps stay as they are."""
    if unknown := set(tables) - set(ANNOTATION_TIERS):
        raise ValueError(f"no tier is named {', '.join(sorted(unknown))}")
    rows = None
    for name, table in tables.items():
        part = table.select("rec", F.lit(name).alias("tier"), "start_time", "end_time", "label")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("a document needs a tier")
    return render(rows, ANNOTATION_TIERS, "")


def parse(documents: DataFrame, tiers: tuple[str, ...] = TIERS, silence: str = "#") -> DataFrame:
    """documents(rec, document) -> rec, tier, start_time, end_time, label: intervals with a label other than silence. Lines
    are numbered, and tier and times carried to the label they belong to by the last value before it."""
    lines = documents.select("rec", F.posexplode(F.split("document", r"\r?\n")).alias("i", "raw")).select("rec", "i", F.trim("raw").alias("line"))
    quoted = F.regexp_replace(F.trim(F.regexp_replace("line", r"^[^=]*=", "")), r'^"+|"+$', "")
    order = W.partitionBy("rec").orderBy("i")
    carried = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(order)
    figure = F.regexp_extract("line", r"=\s*(\S+)", 1).try_cast("double")
    seen = lines.select("rec", "i", "line", carried(F.col("line").startswith("name ="), quoted).alias("tier"), carried(F.col("line").startswith("xmin"), figure).alias("start_time"), carried(F.col("line").startswith("xmax"), figure).alias("end_time"), quoted.alias("label"))
    return seen.where(F.col("line").startswith("text") & F.col("tier").isin(*tiers) & (F.col("label") != "") & (F.col("label") != silence)).select("rec", "tier", "start_time", "end_time", "label")

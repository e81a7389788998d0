"""Near duplicates by MinHash: universal hash minima, banding, signature and exact verification, connected components.

1. Each text becomes a set of word shingles. Texts with equal sets form a class, of which only the least doc_id goes on.
2. HASHES minima, in bands of ROWS, put a class into BANDS buckets; 0.8 alike means a common bucket but for 1e-7.
3. Every member of a bucket is compared with the bucket's least member: by signature, then on the full sets. Links give
   components by alternating stars. A hot group costs a number of pairs linear in its size.
4. Buckets whose other members still are in several components are searched exactly, one of those that have the same
   members: blocks of members are compared through an inverted list of their shingles, and only links between different
   components leave the task. Such links are confirmed on the full sets, and components are taken over all links. So no
   link between different components is lost. This costs blocks in proportion to the square of the members of a bucket
   that are near, but not linked to, each other; blocks are bounded in members and in bytes.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words than a shingle is
one shingle; rows without doc_id are linked with nothing and kept; rows with equal doc_id are one node; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.arrow import slices
from voxframe.llm.components import components
from voxframe.llm.scratch import split_join, stored, unused
from voxframe.llm.words import WIDE, U, Words, mix, spans_hash

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: A pair of similarity 0.8 has at least this share of equal minima but for 1e-6.
SIGNATURE_SHARE = 0.66
#: A block of a bucket that is searched has about so many members, and bytes of shingles, at most.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_rng = np.random.default_rng(20240229)
FACTOR = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | U(1)).astype(np.uint32)
SHIFT = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and where each begins."""
    w = Words(texts, lower=True)
    n = w.counts()
    h, at = w.windows(size)
    first = np.searchsorted(at, w.first)
    sets = []
    for k in range(len(texts)):
        if n[k] >= size:
            sets.append(np.unique(h[first[k] : first[k + 1]]))
        elif n[k]:
            a, b = w.first[k : k + 1], w.first[k + 1 : k + 2]
            sets.append(mix(spans_hash(w.hash[: b[0]], a, b, WIDE) ^ U(int(n[k]))))
        else:
            sets.append(np.zeros(0, np.uint64))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=begin[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), begin


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minima of HASHES universal hash functions over each set; sets must not be empty."""
    x = (values >> U(32)).astype(np.uint32)
    out = np.empty((len(begin) - 1, HASHES), dtype=np.uint32)
    step = max(1, len(out) * 65536 // max(len(x), 1))  # sets at a time: the working arrays stay in cache
    for s in range(0, len(out), step):
        e = min(len(out), s + step)
        part, at = x[begin[s] : begin[e]], begin[s:e] - begin[s]
        work = np.empty_like(part)
        for j in range(HASHES):
            np.multiply(part, FACTOR[j], out=work)
            np.add(work, SHIFT[j], out=work)
            out[s:e, j] = np.minimum.reduceat(work, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * WIDE + signature[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, key_a, key_b (equal for equal sets), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            values, begin = shingle_sets(texts, size)
            n = np.diff(begin)
            full = np.flatnonzero(n > 0)
            keys = np.zeros((2, len(texts)), dtype=np.uint64)
            bands = np.zeros((0, BANDS), dtype=np.int64)
            if len(full):
                at = begin[full]
                for k, salt in enumerate((U(0x1234567), U(0xABCDEF01))):
                    keys[k, full] = np.add.reduceat(mix(values + salt), at)
                bands = band_keys(signatures(values, np.append(at, begin[-1])))
            ends = np.zeros(len(texts) + 1, dtype=np.int32)
            np.cumsum((n > 0) * BANDS, out=ends[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def contents(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) -> doc, n (shingles), signature (a byte of each minimum), shingles, and the distinct upper halves
    of these, as bytes; texts without shingles are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            values, begin = shingle_sets(texts, size)
            full = np.flatnonzero(np.diff(begin) > 0)
            if len(full):
                found = signatures(values, np.append(begin[full], begin[-1])).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(full)),
                        pa.array(np.diff(begin)[full], pa.int64()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                        pa.array([values[begin[k] : begin[k + 1]].tobytes() for k in full], pa.binary()),
                        pa.array([np.unique((values[begin[k] : begin[k + 1]] >> U(32)).astype(np.uint32)).tobytes() for k in full], pa.binary()),
                    ],
                    ["doc", "n", "signature", "shingles", "halves"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc long, n long, signature binary, shingles binary, halves binary")


def alike(shared, a, b, percent: int):
    """Of two sets' sizes and that of their intersection, as numbers or arrays."""
    return 100 * shared >= percent * (a + b - shared)


def _tested(pairs: DataFrame, held: DataFrame, column: str, kind, test) -> DataFrame:
    """Those of pairs(a, b) whose values of a binary column of held, as arrays of kind, pass the test. Values are looked at
    where they lie in the batch, a pair at a time."""
    left, right = (held.select(F.col("doc").alias(c), F.col(column).alias(f"x{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xa, xb = (batch.column(batch.schema.get_field_index(c)) for c in ("xa", "xb"))
            keep = [bool(test(np.frombuffer(xa[k].as_buffer(), kind), np.frombuffer(xb[k].as_buffer(), kind))) for k in range(len(xa))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those that are alike by signature and then, exactly, by their full sets, as u, v. A byte of each minimum
    is compared, 200 bytes a text, so that sets travel only for pairs that pass; bytes agree where minima do."""
    near = _tested(pairs, held, "signature", np.uint8, lambda x, y: (x == y).sum() >= SIGNATURE_SHARE * HASHES)
    exact = _tested(near, held, "shingles", np.uint64, lambda x, y: alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
    return exact.select(F.col("a").alias("u"), F.col("b").alias("v"))


def links_in_block(docs: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], full: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components. side: members of equal side are left out, but where side is 0.
    Finds them through lists of the members that hold a shingle. sets hold the distinct upper 32 bits of full shingles each.
    Shingles of one text that agree there hide each other, so a pair may share as many more as the lesser of the two lost;
    shingles of two texts may agree by chance, so links are to be confirmed, and those that lie within the chance
    agreements to expect (many, for very long texts) of the threshold do not join components here."""
    size = np.array([len(s) for s in sets])
    lost = full - size
    codes, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    holders, start = owner[order], np.searchsorted(code[order], np.arange(len(codes) + 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    _, group, count = np.unique(comp, return_inverse=True, return_counts=True)
    out = []
    for x in np.flatnonzero(group != count.argmax()):
        own = code[begin[x] : begin[x + 1]]
        shared = np.bincount(np.concatenate([holders[start[c] : start[c + 1]] for c in own]), minlength=len(sets))
        most = shared + np.minimum(lost[x], lost)
        chance = float(full[x]) * full / 2.0**32
        least = shared - 2 - chance - 8 * np.sqrt(chance)
        able = (group != group[x]) & alike(most, full[x], full, percent) & ((side == 0) | (side != side[x]))
        for y in np.flatnonzero(able):
            if group[y] != group[x]:
                out.append((int(min(docs[x], docs[y])), int(max(docs[x], docs[y]))))
                if alike(least[y], full[x], full[y], percent):
                    group[group == group[y]] = group[x]
    return out


def across(members: DataFrame, held: DataFrame, percent: int, block: int = BLOCK, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """members(bucket, doc, n, comp) of buckets with several components -> candidate links a, b between components. Blocks
    have about block members and block_bytes of shingles at most; of buckets with equal members one is searched."""
    sums = members.groupBy("bucket").agg(
        F.count("*").alias("count"), F.sum("n").alias("words"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    ).where("low != high")
    sizes = sums.groupBy("x", "y", "count").agg(F.min(F.struct("bucket", "words")).alias("one")).select("one.bucket", F.greatest(F.ceil(F.col("count") / block), F.ceil(4 * F.col("one.words") / block_bytes)).cast("int").alias("blocks"))
    dealt = split_join(members, sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "doc", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    dealt = dealt.join(held.select("doc", "n", "halves"), "doc")

    def run(part: pa.Table) -> pa.Table:
        own, i, j = (part.column(c).to_numpy() for c in ("own", "i", "j"))
        halves = [np.frombuffer(s.as_buffer(), np.uint32) for s in part.column("halves")]
        side = np.zeros(len(own), dtype=int) if i[0] == j[0] else own + 1
        found = links_in_block(part.column("doc").to_numpy(), part.column("comp").to_numpy(), side, halves, part.column("n").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, class_id (least doc_id with the same set), component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(sketch(docs, shingle), "near-sketch")
    classes = seen.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    one = seen.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = one.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("head"), F.max("doc").alias("high")).where("head.doc != high").select("bucket", F.col("head.doc").alias("lead"), F.col("head.n").alias("lead_n"))
    members = stored(split_join(banded, heads, "bucket"), "near-members")
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    held = stored(contents(docs.join(wanted, "doc_id", "left_semi"), shingle), "near-contents")
    behind = members.where(F.col("doc") != F.col("lead"))
    pairs = behind.where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    early = components(verified(pairs, held, percent))
    # what the first round left apart; the least member of a bucket has been compared with all others
    placed = behind.select("bucket", "doc", "n").join(early.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    more = verified(across(stored(placed, "near-placed"), held, percent), held, percent)
    final = components(early.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    out = split_join(seen.select("doc_id", "n_shingles", "key_a", "key_b"), classes, ["key_a", "key_b", "n_shingles"], "left").join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, that are the least doc_id of their component."""
    ident = unused(docs.columns, "near_id")[0]
    gone = near_duplicates(docs.select("doc_id", "text"), shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(ident), "left_anti")

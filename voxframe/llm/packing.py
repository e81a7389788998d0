"""Best-fit packing of token sequences by exact-complement hashing.

Documents are cut into pieces of at most LIMIT tokens. Packing needs only how many pieces have each length, so the plan is
made on the driver from at most LIMIT counts, whatever the corpus. It opens a sequence with the longest piece left, looks
up the gap among the sums of one, two and three available lengths, and consumes a combination that fills it exactly;
where there is none it adds the best-fitting piece and looks up the rest. A pattern is used as often as the counts allow.
Pieces find their place by their rank among pieces of equal length, from counts per (length, block) and a rank inside the
block; a length that a third of all pieces share is many blocks.

Edge cases: a null or empty text is the end token alone. Repeated rows are packed as often as they occur. Nothing is
dropped or truncated. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.llm.arrow import slices
from voxframe.llm.scratch import partitions

LIMIT, END_ID, BLOCKS = 2048, 0, 512
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 is itself, the rest follow from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def encoder(path: str):
    """text -> ids, as the tokenizers library gives for the vocabulary file at path without special tokens added.

    A byte-pair vocabulary whose ids are its merge ranks can be run by tiktoken, three times as fast and with equal ids;
    texts that hold a special token's string go to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level splitter
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = functools.cache(lambda: Tokenizer.from_file(path))  # tens of MB that few workers need

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return ids


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all have limit tokens but the first, which may have fewer."""
    head = n % limit or limit
    return [(0, head)] + [(k, limit) for k in range(head, n, limit)]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): place in its document, length, checksum of its ids, and the ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch, texts in slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.append(encode(text.decode("utf-8", "surrogatepass")), np.uint32(END_ID)).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), limit)):
                    own = ids[at : at + n]
                    rows.append((doc, k, at, n, zlib.crc32(own.tobytes()), *([own.tolist()] if with_ids else [])))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


class Sums:
    """Which totals one, two or three available lengths can make: bit sets, rebuilt when a length runs out."""

    def __init__(self, left: np.ndarray):
        self.left, self.limit = left, len(left) - 1
        self.index()

    def index(self) -> None:
        keep = (1 << (self.limit + 1)) - 1
        self.lengths = np.flatnonzero(self.left)[::-1].tolist()
        self.one = sum(1 << n for n in self.lengths)
        self.two = self.three = 0
        for n in self.lengths:
            self.two |= self.one << n
        self.two &= keep
        for n in self.lengths:
            self.three |= self.two << n
        self.three &= keep

    def spare(self, n: int, used: dict[int, int]) -> int:
        return int(self.left[n]) - used.get(n, 0)

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        for a in self.lengths:
            b = gap - a
            if b > a or b < 1:
                if b > a:
                    return None
                continue
            if self.one >> b & 1 and self.spare(a, used) > (a == b) and self.spare(b, used) > 0:
                return a, b
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        if self.one >> gap & 1 and self.spare(gap, used) > 0:
            return (gap,)
        if self.two >> gap & 1 and (found := self.pair(gap, used)):
            return found
        if self.three >> gap & 1:
            for a in self.lengths:
                if a < gap and self.two >> (gap - a) & 1 and self.spare(a, used) > 0:
                    with_a = {**used, a: used.get(a, 0) + 1}
                    if found := self.pair(gap - a, with_a):
                        return a, *found
        return None

    def best(self, gap: int, used: dict[int, int]) -> int | None:
        return next((n for n in self.lengths if n <= gap and self.spare(n, used) > 0), None)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths and how many of each in one sequence, how many such sequences)]; uses up the counts exactly."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    out = [([(limit, 1)], int(left[limit]))] if left[limit] else []
    left[limit] = 0
    sums = Sums(left)
    while sums.lengths:
        used = {sums.lengths[0]: 1}
        gap = limit - sums.lengths[0]
        while gap:
            take = sums.exact(gap, used)
            if take is None:
                n = sums.best(gap, used)
                if n is None:
                    break
                take = (n,)
            for n in take:
                used[n] = used.get(n, 0) + 1
                gap -= n
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        out.append((sorted(used.items(), reverse=True), times))
        sums.index()
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n, k in lengths:
            out.setdefault(n, []).append((ranks.get(n, 0), sequence, k, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(cut: DataFrame, limit: int = LIMIT, blocks: int | None = None) -> DataFrame:
    """cut: pieces(), stored; adds sequence_id and offset. A length is ranked in blocks, BLOCKS or as many as there are shuffle
    partitions, whichever is more, so that the commonest length is spread over all tasks."""
    blocks = blocks or max(BLOCKS, partitions(cut.sparkSession))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    tally = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    where = places(plan(counts, limit))
    before = tally.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ranked = cut.join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "block").orderBy("doc_id", "piece", "start")) - 1)
    names = [c for c in cut.columns if c != "block"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                table = where[int(length[own[0]])]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * length[own]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "block")
    return ranked.select(*names, "rank").mapInArrow(seat, f"{kinds}, sequence_id long, offset long")

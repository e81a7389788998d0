"""Substring dedup by level-wise doubling of repeated word windows.

Windows of ``size`` words of all documents are compared by hash. Windows that another document has too, and only those,
are extended to twice their length (two repeated windows side by side), compared again, and so on until none survives.
The first level decides removal: each word covered by a window that also starts in a document with a smaller doc_id goes.
The higher levels tell how long the repeated passages are, in documents that the first level removes wholly as in others.

Documents are dealt into parts, ranges of doc_id of about equal bytes. A part sends each bucket of hash values one message, its distinct hashes
in order as differences; the bucket answers with two bits for each: another part has it, a part before has it. Messages
are as many as parts times buckets, whatever the text; a passage that millions share is one entry of each part. Hashes have
64 bits and are not compared again: of n windows about n / 2**64 are taken for repeated by chance.

Edge cases: null and empty texts have no words and give the hash of nothing; rows with equal doc_id do not remove each
other; rows without doc_id are compared with nothing; texts shorter than a window stay; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.arrow import slices
from voxframe.llm.scratch import stored
from voxframe.llm.words import WIDE, U, Words, chunks, mix, powers, spans_hash

SIZE, CELLS, FINE = 13, 4096, 64
RAW_PLANES = 6
WORD_BYTES, PART_WORDS, BUCKET_WORDS, MESSAGE_WORDS = 6, 700_000, 400_000, 64
MESSAGE = "bucket int, part long, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long, part long, state binary"


def encoded(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences in byte planes; the high planes, almost all zero, are deflated."""
    step = np.diff(hashes, prepend=U(0))
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:RAW_PLANES].tobytes() + zlib.compress(planes[RAW_PLANES:].tobytes(), 1)


def decoded(payload: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(payload[: RAW_PLANES * n] + zlib.decompress(payload[RAW_PLANES * n :]), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def edges(buckets: int) -> np.ndarray:
    """First hash of each bucket; buckets are equal ranges of hashes."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)


def messages(part: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """hashes: sorted, distinct. One row per bucket that gets any: the count, then the hashes."""
    cut = np.concatenate([[0], np.searchsorted(hashes, edges(buckets)), [len(hashes)]])
    rows = [(k, part, int(b - a).to_bytes(8, "little") + encoded(hashes[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def answers(table: pa.Table) -> pa.Table:
    """All messages to one bucket -> per part the bits of its hashes: first those that a part before has, then those that
    any other part has."""
    table = table.sort_by("part")
    arrays = []
    for payload in table.column("payload").to_pylist():
        n = int.from_bytes(payload[:8], "little")
        arrays.append(decoded(payload[8:], n))
    every = np.concatenate(arrays)
    order = np.argsort(every, kind="stable")  # parts ascend, so equal hashes stay in the order of parts
    same = every[order[1:]] == every[order[:-1]]
    later, shared = np.zeros(len(every), bool), np.zeros(len(every), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    out, at = [], 0
    for a in arrays:
        bits = np.concatenate([later[at : at + len(a)], shared[at : at + len(a)]])
        out.append(len(a).to_bytes(8, "little") + zlib.compress(np.packbits(bits).tobytes(), 1))
        at += len(a)
    return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "payload": pa.array(out, pa.binary())})


def answered(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each of a part's n hashes, in their order."""
    later, shared = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for payload in table.sort_by("bucket").column("payload").to_pylist():
        k = int.from_bytes(payload[:8], "little")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(payload[8:]), np.uint8), count=2 * k).astype(bool)
        later.append(bits[:k])
        shared.append(bits[k:])
    both = np.concatenate(later), np.concatenate(shared)
    if len(both[0]) != n:
        raise ValueError(f"{len(both[0])} answers for {n} windows: the rows of a part changed between two reads")
    return both


@dataclass
class Windows:
    """Windows of some documents: hash (before mix), index of the document, index of the first word in the document."""

    hash: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct mixed hashes, for each window its index there, and the index of each one's first window; windows
        are in the order of documents, so the first is of the first document."""
        values, first, inverse = np.unique(mix(self.hash), return_index=True, return_inverse=True)
        return values, inverse, first


def sorted_texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table.column("doc_id").to_pylist(), [v or b"" for v in table.column("text").cast(pa.large_binary()).to_pylist()]


def windows(texts: list[bytes], size: int) -> tuple[Windows, list[Words]]:
    held: tuple[list, list, list] = ([], [], [])
    words, doc = [], 0
    for some in chunks(texts):
        w = Words(some)
        words.append(w)
        n = w.counts()
        fits = np.maximum(n - size + 1, 0)
        of = np.repeat(np.arange(len(some)), fits)
        at = np.arange(len(of)) - np.repeat(np.cumsum(fits) - fits, fits)
        first = w.first[:-1][of] + at
        held[0].append(spans_hash(w.hash, first, first + size, WIDE) if len(first) else np.zeros(0, np.uint64))
        held[1].append(of + doc)
        held[2].append(at)
        doc += len(some)
    cat = lambda k, t: np.concatenate([*held[k], np.zeros(0, t)]).astype(t)
    return Windows(cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64)), words


def kept_hashes(w: Words, gone: np.ndarray) -> list[str]:
    """SHA-256 of each text's words that are not gone, joined by one space."""
    raw = w.raw.copy()
    start, end = w.start[~gone], w.end[~gone]
    raw[end] = 32  # the byte after a word is white space
    turn = np.zeros(len(raw) + 1, dtype=np.int8)
    turn[start] += 1
    np.subtract.at(turn, end + 1, 1)
    inside = np.cumsum(turn[:-1], dtype=np.int8) > 0
    total = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(inside, out=total[1:])
    out, at = raw[inside].tobytes(), total[w.offset]
    return [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:])]


# ---- state of a part between levels: the repeated windows of its documents -------------------------------------------


def packed_state(ids: list[int], w: Windows, keep: np.ndarray) -> bytes | None:
    if not keep.any():
        return None
    doc, at, h = w.doc[keep], w.at[keep], w.hash[keep]
    used, doc = np.unique(doc, return_inverse=True)
    head = np.array([len(used), len(doc)], dtype="<i8").tobytes()
    body = np.array(ids, dtype="<i8")[used].tobytes() + np.diff(doc, prepend=0).astype("<i4").tobytes() + np.diff(at, prepend=0).astype("<i4").tobytes()
    return head + len(z := zlib.compress(body, 1)).to_bytes(8, "little") + z + h.astype("<u8").tobytes()


def state_of(payload: bytes) -> tuple[list[int], Windows]:
    docs, n = np.frombuffer(payload[:16], "<i8").tolist()
    size = int.from_bytes(payload[16:24], "little")
    body, rest = zlib.decompress(payload[24 : 24 + size]), payload[24 + size :]
    ids = np.frombuffer(body[: 8 * docs], "<i8").tolist()
    doc, at = (np.cumsum(np.frombuffer(body[8 * docs + 4 * n * k : 8 * docs + 4 * n * (k + 1)], "<i4").astype(np.int64)) for k in (0, 1))
    return ids, Windows(np.frombuffer(rest, "<u8").astype(np.uint64), doc, at)


def doubled(w: Windows, size: int) -> Windows:
    """Windows of twice the size, where both halves are among the windows of size."""
    if not len(w.doc):
        return w
    wide = int(w.at.max()) + size + 2
    key = w.doc * wide + w.at
    order = np.argsort(key)
    key = key[order]
    place = np.searchsorted(key, key + size)
    ok = (place < len(key)) & (key[np.minimum(place, len(key) - 1)] == key + size)
    a, b = order[ok], order[place[ok]]
    up = powers(WIDE, size + 1)[0][size]
    return Windows(w.hash[a] * up + w.hash[b], w.doc[a], w.at[a])


def in_several(w: Windows, inverse: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which windows' hashes two documents of this part have."""
    several = np.zeros(len(first), dtype=bool)
    several[inverse[w.doc != w.doc[first][inverse]]] = True
    return several[inverse]


# ---- Spark -----------------------------------------------------------------------------------------------------------


@dataclass
class Layout:
    """split: CELLS + 1 quantiles of doc_id, or none; cells: for each range between them its first part and how many parts it
    is; buckets of hashes."""

    split: list[int]
    cells: list[tuple[int, int]]
    buckets: int


def _cell(split: list[int]) -> Column:
    """Which range of doc_id a row is in: found among every FINE-th quantile, then among those between two of them."""
    listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)  # noqa: E731  one literal, not thousands
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("doc_id")))
    coarse = below(listed(split[FINE:CELLS:FINE], "array<bigint>"))
    inner = listed([split[k + 1 : k + FINE] for k in range(0, CELLS, FINE)], "array<array<bigint>>")
    return coarse * FINE + below(F.get(inner, coarse))


def layout(docs: DataFrame) -> Layout:
    """Parts of about equal bytes, and the number of buckets, from the size of the texts alone. Parts and buckets grow as the
    root of the corpus once that is large, so a message keeps MESSAGE_WORDS hashes or more. Ranges of doc_id with little text
    share a part; one with more than a part's text is several, by equal steps of doc_id. CELLS sums come to the driver."""
    row = docs.agg(F.percentile_approx("doc_id", [k / CELLS for k in range(CELLS + 1)], 100_000).alias("q"), F.sum(F.octet_length("text")).alias("b")).first()
    words = (row.b or 0) / WORD_BYTES
    root = (MESSAGE_WORDS * words) ** 0.5
    most = max(PART_WORDS, root) * WORD_BYTES
    split, cells = list(row.q or []), []
    if split:
        held = dict(docs.groupBy(_cell(split).alias("cell")).agg(F.sum(F.octet_length("text")).alias("b")).collect())
        part, size = 0, 0
        for k in range(CELLS):
            here = held.get(k) or 0
            if size and size + here > most:
                part, size = part + 1, 0
            cells.append((part, max(1, math.ceil(here / most))))
            part, size = (part + cells[k][1], 0) if cells[k][1] > 1 else (part, size + here)
    return Layout(split, cells, max(8, math.ceil(words / max(BUCKET_WORDS, root))))


def dealt(docs: DataFrame, plan: Layout) -> DataFrame:
    """docs(doc_id, text) with part, which never falls as doc_id grows."""
    if not plan.split:
        return docs.withColumn("part", F.lit(0).cast("long"))
    rows = [(k, first, n, float(plan.split[k]), float(max(plan.split[k + 1] - plan.split[k], 1))) for k, (first, n) in enumerate(plan.cells)]
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "cell int, first long, parts long, low double, wide double"))  # CELLS rows
    placed = docs.select("doc_id", "text", _cell(plan.split).cast("int").alias("cell")).join(table, "cell")
    inside = F.floor((F.col("doc_id").cast("double") - F.col("low")) / F.col("wide") * F.col("parts"))
    return placed.select("doc_id", "text", (F.col("first") + F.greatest(F.lit(0), F.least(inside, F.col("parts") - 1))).cast("long").alias("part"))


def _first_level(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    def send(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        w, _ = windows(sorted_texts(table)[1], size)
        return messages(part, w.distinct()[0], buckets)

    def decide(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = sorted_texts(table)
        w, words = windows(texts, size)
        values, inverse, first = w.distinct()
        later, shared = answered(replies, len(values))
        doc_id = np.array(ids, dtype=np.int64)
        mine = doc_id[w.doc]
        gone_window = later[inverse] | (doc_id[w.doc[first]][inverse] < mine) if len(mine) else np.zeros(0, bool)
        # the same id twice is one document
        repeated = shared[inverse] | gone_window | in_several(Windows(w.hash, mine, w.at), inverse, first) if len(mine) else np.zeros(0, bool)
        n_words = np.concatenate([x.counts() for x in words]) if words else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(n_words)])
        turn = np.zeros(begin[-1] + 1, dtype=np.int32)
        start = begin[w.doc[gone_window]] + w.at[gone_window]
        np.add.at(turn, start, 1)
        np.subtract.at(turn, start + size, 1)
        gone = np.cumsum(turn[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[begin[1:]] - total[begin[:-1]]
        shas, at = [], 0
        for x in words:
            shas += kept_hashes(x, gone[at : at + len(x.start)])
            at += len(x.start)
        longest = np.zeros(len(ids), dtype=np.int64)
        longest[w.doc[repeated]] = size
        state = packed_state(ids, w, repeated) if len(mine) else None
        part = table.column("part")[0].as_py()
        n = len(ids)
        rows = pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string()), "longest": pa.array(longest), "part": pa.nulls(n, pa.int64()), "state": pa.nulls(n, pa.binary())})
        return pa.concat_tables([rows, _state_row(part, state)]) if state else rows

    sent = docs.groupBy("part").applyInArrow(send, MESSAGE)
    replies = sent.groupBy("bucket").applyInArrow(answers, MESSAGE)
    return docs.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(decide, RESULT)


def _state_row(part: int, state: bytes) -> pa.Table:
    null = lambda t: pa.nulls(1, t)
    return pa.table({"doc_id": null(pa.int64()), "n_words": null(pa.int64()), "n_removed": null(pa.int64()), "kept_sha256": null(pa.string()), "longest": null(pa.int64()), "part": pa.array([part], pa.int64()), "state": pa.array([state], pa.binary())})


def _next_level(states: DataFrame, size: int, buckets: int) -> DataFrame:
    """states(part, state) of windows of size -> the rows of RESULT for windows of twice the size."""

    def send(table: pa.Table) -> pa.Table:
        _, w = state_of(table.column("state")[0].as_py())
        return messages(table.column("part")[0].as_py(), doubled(w, size).distinct()[0], buckets)

    def decide(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, w = state_of(table.column("state")[0].as_py())
        w = doubled(w, size)
        values, inverse, first = w.distinct()
        _, shared = answered(replies, len(values))
        keep = shared[inverse] | in_several(Windows(w.hash, np.array(ids, dtype=np.int64)[w.doc], w.at), inverse, first) if len(w.doc) else np.zeros(0, bool)
        state = packed_state(ids, w, keep)
        if state is None:
            return _state_row(0, b"").slice(0, 0)
        docs = sorted({ids[k] for k in np.unique(w.doc[keep])})
        n = len(docs)
        rows = pa.table({"doc_id": pa.array(docs, pa.int64()), "n_words": pa.nulls(n, pa.int64()), "n_removed": pa.nulls(n, pa.int64()), "kept_sha256": pa.nulls(n, pa.string()), "longest": pa.array([2 * size] * n, pa.int64()), "part": pa.nulls(n, pa.int64()), "state": pa.nulls(n, pa.binary())})
        return pa.concat_tables([rows, _state_row(table.column("part")[0].as_py(), state)])

    replies = states.groupBy("part").applyInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(answers, MESSAGE)
    return states.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(decide, RESULT)


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and longest_repeat, the greatest length of size times a
    power of two at which a window of the document is in another one too (0: none)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            w = Words(texts)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts()), pa.array(np.zeros(n, np.int64)), pa.array(kept_hashes(w, np.zeros(len(w.start), bool)), pa.string()), pa.array(np.zeros(n, np.int64))], ["doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat"])

    known = docs.where("doc_id is not null")
    plan = layout(known)
    level = stored(_first_level(dealt(known, plan), size, plan.buckets), "substrings")
    rows = level.where("state is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")
    longer = None
    while not level.where("state is not null").isEmpty():
        level = stored(_next_level(level.where("state is not null").select("part", "state"), size, plan.buckets), "substrings")
        size *= 2
        found = level.where("state is null").select("doc_id", "longest")
        longer = found if longer is None else longer.unionByName(found)
    if longer is not None:
        longer = longer.groupBy("doc_id").agg(F.max("longest").alias("more"))
        rows = rows.join(longer, "doc_id", "left").withColumn("longest", F.greatest("longest", "more")).drop("more")
    return rows.withColumnRenamed("longest", "longest_repeat").unionByName(docs.where("doc_id is null").mapInArrow(alone, "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_repeat long"))

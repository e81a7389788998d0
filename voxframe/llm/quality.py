"""Quality rules: a linear-chain CRF labels every line content or boilerplate; the share of content decides retention.

Edge cases: a null or empty text has no words, fails the base rule and is not kept. Repeated rows are judged alike, each
on its own. Two features stop growing: word length at 30 and line number at 20. Other columns pass through untouched and may have any name: results are computed beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import crf
from voxframe.llm.arrow import slices
from voxframe.llm.words import BASE, BYTE, Words, mix, spans_hash

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT_SHARE = 50, 50, 0.5
#: The classifier sees at most so many labelled documents, and so many lines of each.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 1200, 40


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "point": ~((np.arange(256) & 0xC0) == 0x80),  # bytes that begin a code point
    "symbol": _class(SYMBOLS),
    "upper": _class(bytes(range(65, 91))),
    "lower": _class(bytes(range(97, 123))),
    "digit": _class(bytes(range(48, 58))),
    "shout": _class(b"!?"),
    "stop": _class(b".,;:"),
    "other": np.arange(256) >= 0x80,
}


@dataclass
class Measured:
    """Per text: words, word_chars, symbols, dup_lines, repeat_words. Per line with a word: its features, words, text."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    line_text: np.ndarray
    line_no: np.ndarray


def measure(texts: list[bytes]) -> Measured:
    w = Words(texts)
    n = len(texts)
    sums = {}
    for name, table in CLASSES.items():
        sums[name] = np.zeros(len(w.raw) + 1, dtype=np.int32)  # a text has under 2**31 bytes
        np.cumsum(table[w.raw], out=sums[name][1:], dtype=np.int32)
    in_word = np.zeros(len(w.raw) + 1, dtype=np.int32)
    flag = np.zeros(len(w.raw) + 1, dtype=np.int8)
    flag[w.start] += 1
    flag[w.end] -= 1
    np.cumsum(np.cumsum(flag[:-1], dtype=np.int8) * CLASSES["point"][w.raw], out=in_word[1:], dtype=np.int32)
    # words in repeated 3-word windows
    text_of = np.repeat(np.arange(n), np.diff(w.first))
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    triple, at = w.windows(3)
    covered = np.zeros(len(w.hash) + 1, dtype=np.int64)
    if len(at):
        _, inverse, times = np.unique(triple ^ salt[text_of[at]], return_inverse=True, return_counts=True)
        hit = at[times[inverse] > 1]
        mark = np.zeros(len(w.hash), dtype=bool)
        for k in range(3):
            mark[hit + k] = True
        np.cumsum(mark, out=covered[1:])
    # lines: the white-space byte that parts the texts ends the last line of each
    stop = np.flatnonzero(w.raw == 10)
    begin = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
    line_text = np.searchsorted(w.offset, begin, side="right") - 1
    line_no = np.arange(len(begin)) - np.searchsorted(begin, w.offset[:-1])[line_text]
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    has = b > a
    begin, stop, line_text, line_no, a, b = (v[has] for v in (begin, stop, line_text, line_no, a, b))
    key = mix(spans_hash(BYTE[w.raw], begin, stop, BASE)) ^ salt[line_text] if len(begin) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    size = np.maximum(sums["point"][stop] - sums["point"][begin], 1)
    count = b - a
    share = {k: (v[stop] - v[begin]) / size for k, v in sums.items()}
    last = w.raw[np.maximum(stop - 1, 0)]
    features = np.column_stack(
        [
            np.log1p(count),
            np.minimum(size / count, 30),
            *(share[k] for k in ("symbol", "upper", "digit", "shout", "stop", "lower", "other")),
            (covered[b] - covered[a]) / count,
            again,
            CLASSES["stop"][last] | CLASSES["shout"][last],
            np.minimum(line_no, 20),
            share["symbol"] > 0.08,
            share["upper"] > 0.5,
            share["shout"] > 0.1,
        ]
    ).astype(float) if len(begin) else np.zeros((0, 16))
    f, o = w.first, w.offset
    return Measured(
        np.diff(f), (in_word[o[1:]] - in_word[o[:-1]]).astype(np.int64), (sums["symbol"][o[1:]] - sums["symbol"][o[:-1]]).astype(np.int64),
        np.bincount(line_text[again], minlength=n), covered[f[1:]] - covered[f[:-1]], features, count, line_text, line_no,
    )


def _line(rng: np.random.Generator, word, boilerplate: bool) -> str:
    ws = [word() for _ in range(int(rng.integers(2, 60)))]
    kind = int(rng.integers(6)) if boilerplate else 6 + int(rng.integers(4))
    if kind == 0:
        ws = [x.upper() + "!!" for x in ws]
    elif kind == 1:
        ws = [x + str(rng.choice(["###", "$$$", "***", "%%%", "&&&"])) for x in ws]
    elif kind == 2:
        return " | ".join(ws)
    elif kind == 3:
        ws = [x for x in ws[:4] for _ in range(7)]
    elif kind == 4:
        return " > ".join(x.capitalize() for x in ws[:6])
    elif kind == 5:
        return " ".join(ws[:3]).upper() + " >>"
    elif kind == 6:
        return " ".join(ws[:8]).capitalize() + "."
    return " ".join(x.capitalize() + "." if rng.random() < 0.08 else x for x in ws).capitalize() + str(rng.choice([".", ".", ".", "?"]))


def built_in_sample(documents: int = 400) -> tuple[list[bytes], list[list[int]]]:
    """Texts made by rule with a label for each line. Most hold both kinds: runs of boilerplate (menus, shouting, symbols,
    stuttering) between runs of content, so that changes of label are seen as often as they are to be found."""
    rng = np.random.default_rng(5)
    parts = ["re", "an", "ti", "on", "er", "the", "in", "ou", "é", "ch", "un", "la", "keit", "ción", "o", "s", "ß", "ñ"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    texts, labels = [], []
    for k in range(documents):
        content = k % 3 != 0
        turn = 0.0 if k % 10 == 0 else 0.2
        lines, marks = [], []
        for _ in range(int(rng.integers(1, 16))):
            lines.append(_line(rng, word, not content))
            marks.append(int(content))
            content = content != (rng.random() < turn)
        texts.append("\n".join(lines).encode())
        labels.append(marks)
    return texts, labels


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None, documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> crf.Chain:
    """Fit on the built-in sample and on at most ``documents`` labelled documents (lowest hash of doc_id), each with at most
    ``lines`` lines. Documents have a label, lines need one: a chain fitted on the built-in sample alone labels the lines;
    where its verdict is the document's, they stand; elsewhere all lines of the document get the document's label."""
    texts, marks = built_in_sample()
    m = measure(texts)
    rows = [(m.features, np.concatenate([np.array(x) for x in marks]), np.bincount(m.line_text, minlength=len(texts)))]
    fitted = lambda steps: crf.fit(np.vstack([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), steps=steps)
    if labels is not None:
        chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(documents)
        pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"))), "doc_id")
        # one row of each doc_id, so that the sample stays as small as documents says where rows repeat
        pairs = pairs.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("one")).select("doc_id", "one.text", "one.quality")

        def shown(batches):
            for batch, part in slices(batches, "text"):
                m = measure(part)
                quality, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
                for k in np.unique(m.line_text):
                    at = np.flatnonzero(m.line_text == k)[:lines]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k]]), pa.array([m.features[at].ravel().tolist()], pa.list_(pa.float64())), pa.array([m.line_words[at].tolist()], pa.list_(pa.int64())), pa.array([quality[k]], pa.int64())], ["doc_id", "x", "words", "quality"])

        first = fitted(100)
        for row in sorted(pairs.mapInArrow(shown, "doc_id long, x array<double>, words array<long>, quality long").collect()):
            x, words = np.array(row.x).reshape(len(row.words), -1), np.array(row.words)
            y = first.decode(x, np.array([len(x)])).astype(int)
            if (words @ y >= MIN_CONTENT_SHARE * words.sum()) != row.quality:
                y[:] = row.quality
            rows.append((x, y, np.array([len(y)])))
    return fitted(150)


def verdicts(texts: list[bytes], model: crf.Chain) -> dict[str, np.ndarray]:
    m = measure(texts)
    label = model.decode(m.features, np.bincount(m.line_text, minlength=len(texts)))
    content = np.bincount(m.line_text, weights=m.line_words * label, minlength=len(texts)).astype(np.int64)
    failed = (m.words < MIN_WORDS) | (100 * m.repeat_words > MAX_REPEAT_PERCENT * m.words)
    share = content / np.maximum(m.words, 1)
    return {
        "n_words": m.words, "word_chars": m.word_chars, "n_symbols": m.symbols, "n_dup_lines": m.dup_lines, "n_repeat_words": m.repeat_words,
        "base_failed": failed, "kept": ~failed & (share >= MIN_CONTENT_SHARE), "n_content_words": content, "content_share": share,
    }


VERDICT_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_content_words long, content_share double"


def judge(docs: DataFrame, model: crf.Chain) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, base rule, content share and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            v = verdicts(texts, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in v.values())], ["doc_id", *v])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VERDICT_SCHEMA)


def keep(docs: DataFrame, model: crf.Chain) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array(verdicts(texts, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def label_lines(docs: DataFrame, model: crf.Chain) -> DataFrame:
    """doc_id, line_no (from 0, in the text split at line feeds) and is_content of every line that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            m = measure(texts)
            label = model.decode(m.features, np.bincount(m.line_text, minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(m.line_text)), pa.array(m.line_no), pa.array(label == 1)], ["doc_id", "line_no", "is_content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line_no long, is_content boolean")

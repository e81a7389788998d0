"""Secret scans: fixed patterns, and runs of characters that a Markov model of random strings explains better than one of
ordinary identifiers.

Two character Markov models of one order are trained from labelled samples (label 1: random secrets, 0: ordinary
identifiers and words); a candidate run is reported if its mean log-likelihood ratio per character exceeds a threshold found
on the samples held out, one for runs under LONG characters and one for the others. Every run from SHORT characters is a
candidate, and of a run that fixed patterns match in part, each piece left of it. A random string may stand in a path or
behind a name, whose ordinary words outweigh it in the mean of the whole run: of a candidate that is not over the threshold,
each piece between slashes and equals signs that is long enough is one. Spans count code points, ends exclusive. Edge cases:
null and empty texts have no spans; texts of any length are scanned whole; repeated rows give repeated results.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.arrow import slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORT, LONG = 16, 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}", re.ASCII)
PIECE = re.compile(rf"[^/=]{{{SHORT},}}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
PROSE = """
international responsibility extraordinary characteristics government knowledge business through thought strength rhythm psychology
question quickly required maximum exactly example object subject majority judgement jazz frequency mechanism environment development
wonderful however always following between without another something everyone yesterday tomorrow background workspace framework
awkward equipment unfortunately misunderstanding straightforward acknowledgement configuration keyboard interrupt exception buffer
heureux nouveaux beaucoup oiseaux travaux generaux aujourdhui quelque toujours lieux yeux mieux ceux jeux eaux eux aux chevaux bureaux
ailleurs feuille oeuvre ouvrage choix voix croix paix deux faux rieuse joyeux auxiliaire queue taux veux peux anciennement
gesellschaft wirtschaft freundschaft geschwindigkeit donau dampf schifffahrt kapfen pferd pfanne pfeffer apfel kopf zuber zweck
herzlich kurz platz schutz gesetz satz setzung zeitschrift entwicklung verantwortung wissenschaft rechtschreibung zusammenfassung
einfach zukunft zwischen schwarz deutsch tschechisch jahrhundert vorwort kraftfahrzeug haftpflicht versicherung ubung achtzehn
desarrollo queso izquierda conocimiento responsabilidad trabajo juego ejemplo hacia mayo llave guerra carretera ferrocarril
pequeno mejor dijo rojo viejo hijo abajo voz luz paz vez diez feliz lapiz quizas excelente proximo texto fuerza
"""


def labelled_samples(n: int = 4000, seed: int = 17) -> list[tuple[str, int]]:
    """Random strings of the usual alphabets, and identifiers, words and rules as people and programs write them."""
    rng = random.Random(seed)
    words = "get set user name list file path node value index count total page link view test data base time date year size type code line text word next last first open close read write send load save item order price buyer place part seller change record table column question join group filter window frame track state segment the and for with from this that are was of to in on is as by be it or an at un une des les que est pour par avec der die das und mit von sich nicht el la los del con para".split()
    prose = PROSE.split()
    out, more = [], []
    for k in range(n):
        size = rng.randint(16, 64)
        chars = rng.choice(["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62] + "-_"])
        out.append(("".join(rng.choice(chars) for _ in range(size)), 1))
        parts = [rng.choice(words) for _ in range(rng.randint(3, 8))]
        style = rng.randrange(6)
        if style == 0:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:]) + str(rng.randint(0, 99))
        elif style == 1:
            text = "_".join(parts) + f"_{rng.randint(0, 2024)}"
        elif style == 2:
            text = "-".join(parts) + f"-{rng.randint(0, 9)}"
        elif style == 3:
            text = "/".join(parts) + f"/{rng.randint(2000, 2030)}/{rng.randint(1, 12):02d}/{rng.randint(1, 28):02d}"
        elif style == 4:
            text = "".join(parts) + str(rng.randint(1900, 2030))
        else:
            text = "_".join(parts).upper() + f"_{rng.randint(0, 99)}"
        out.append((text, 0))
        # what has no digits: words of several languages run together, identifiers, and rules
        parts = [rng.choice(prose) for _ in range(rng.randint(2, 5))]
        text = [lambda: "".join(parts), lambda: "".join(parts).capitalize(), lambda: "".join(p.capitalize() for p in parts), lambda: "-".join(parts), lambda: "_".join(parts), lambda: "/" + "/".join(parts), lambda: "".join(parts).upper(), lambda: "_".join(parts).upper(), lambda: rng.choice(ALPHABET) * rng.randint(SHORT, 64), lambda: (rng.choice("-=+_/") + rng.choice("-=+_/")) * rng.randint(SHORT // 2, 32)][k % 10]()
        more.append((text, 0))
    return out + more


@dataclass(frozen=True)
class Models:
    """ratio[a, b]: log P(b after a | random) - log P(b after a | ordinary); row len(ALPHABET) begins a string."""

    ratio: np.ndarray
    threshold: float
    short: float = 0.25

    def secret(self, run: str) -> bool:
        return self.score(run) > (self.threshold if len(run) >= LONG else self.short)

    def within(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The candidate text[start:end] if it is a secret, or else those of its pieces that are."""
        run = text[start:end]
        if self.secret(run):
            return [("markov", start, end)]
        return [("markov", start + m.start(), start + m.end()) for m in PIECE.finditer(run) if len(m[0]) < len(run) and self.secret(m[0])]

    def score(self, run: str) -> float:
        code = CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
        return float(self.ratio[np.concatenate([[len(ALPHABET)], code[:-1]]), code].mean())


def train(samples: Iterable[tuple[str, int]] | None = None, smooth: float = 0.5) -> Models:
    """Counts of pairs with additive smoothing; every fifth sample is held out for the threshold, the least score at which
    no held-out ordinary string passes, or else the midpoint of the two classes' nearest scores. Runs under LONG have their own."""
    samples = list(labelled_samples() if samples is None else samples)
    counts = np.full((2, len(ALPHABET) + 1, len(ALPHABET) + 1), smooth)
    for k, (text, label) in enumerate(samples):
        if k // 2 % 5:
            code = CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]
            np.add.at(counts[label], (np.concatenate([[len(ALPHABET)], code[:-1]]), code), 1)
    logp = np.log(counts / counts.sum(2, keepdims=True))
    models = Models(logp[1] - logp[0], 0.0)
    held = [(models.score(t), label, len(t)) for k, (t, label) in enumerate(samples) if k // 2 % 5 == 0 and t]

    def least(low: int, high: float) -> float:
        ordinary, random_ = ([x for x, label, n in held if label == y and low <= n < high] for y in (0, 1))
        return max(0.25, (max(ordinary) + min(random_)) / 2 if ordinary and random_ else 0.25)

    return Models(models.ratio, least(LONG, float("inf")), least(SHORT, LONG))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def model_spans(text: str, models: Models, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the candidate runs that no span in taken overlaps those over the threshold, or their pieces: the furthest end of
    the spans that begin before a run ends decides, and is carried on from run to run."""
    out, ahead, k, reach = [], sorted((s, e) for _, s, e in taken), 0, 0
    for m in RUN.finditer(text):
        while k < len(ahead) and ahead[k][0] < m.end():
            reach = max(reach, ahead[k][1])
            k += 1
        if reach <= m.start():
            out += models.within(text, *m.span())
    return out


def rest_spans(text: str, models: Models, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the runs that spans in taken overlap, what lies outside them, long enough and over the threshold, or its pieces."""
    joined: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    out, k = [], 0
    for m in RUN.finditer(text) if joined else ():
        while k < len(joined) and joined[k][1] <= m.start():
            k += 1
        at, j = m.start(), k
        while j < len(joined) and joined[j][0] < m.end():
            out.append((at, joined[j][0]))
            at, j = joined[j][1], j + 1
        if j > k:
            out.append((at, m.end()))
    return [span for a, b in out if b - a >= SHORT for span in models.within(text, a, b)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and added: spans as arrays of (kind, start, end), each by start, then kind."""
    models = models or train()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            both: tuple[list, list] = ([], [])
            for raw in texts:
                text = raw.decode("utf-8", "surrogatepass")
                base = base_spans(text)
                for out, found in zip(both, (base, model_spans(text, models, base) + rest_spans(text, models, base))):
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, span) for x in both)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, added {kind}")

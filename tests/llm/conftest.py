import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Names that operators use inside; documents may have them too.
CLASHES = "kept, n_words, part, bucket, size, length, piece, block, copies, h, u, v, turn, gone, comp, rank, component_id, chunk, first, state, label"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def nasty_rows():
    rng = random.Random(1)
    base = [sentence(rng, rng.randint(60, 120)) for _ in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0", None), (21, base[1] + " tail", None, None, 7), (22, None, "en", "s1", 0), (23, "", "en", "s1", 0), (24, " \n\t ", None, None, None)]
    rows += [(None, base[2], "en", "s0", 1), (None, None, None, None, None), (25, "one", "en", "s2", 3), (25, "one", "en", "s2", 3), (3, base[3], "en", "s0", 1)]
    rows += [(26, sentence(rng, 30_000, 5000) + "\n" + "\n".join(sentence(rng, 9) for _ in range(1500)), "en", "s0", 1), (27, "é ß \U0001f600 " * 50, "fr", "s1", 1), (28, "\n".join(base), "en", "s1", 2), (29, "x\n" + "\n".join(base), "en", "s1", 2)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    rows = nasty_rows()
    names = [c.strip() for c in CLASHES.split(",")]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}

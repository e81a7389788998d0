import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxframe.llm import quoting
from voxframe.llm.q_quoting import op5_quoting, sql

from oracle import compare, rows

MESSAGES = [
    (1, 0, "user", "Hello there.\nSecond line of it"),
    (1, 1, "assistant", "Sure, here is more"),
    (1, 2, "user", "Bob wrote:\n> hello   THERE.\n> second line of it\n\nI agree"),
    (1, 3, "assistant", "> > Hello there.\n> I agree\nme too"),
    (1, 4, "user", "> unknown stuff\n\n\n\nwhat"),
    (1, 5, "user", ">Sure, here is more\r\nfine"),
    (1, 6, "user", "> what\n> me too\nok"),
    (1, 6, "user", "> what\n> me too\nok"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, None, "> "),
    (None, 1, "user", "> x"),
    (3, None, "user", "abc"),
    (4, 0, "user", "a"),
    (4, 1, "user", "a"),
    (4, 2, "user", "> a\nb"),
    (5, 0, "x", "> self\nself"),
    (8, 0, "user", "First part\nof a letter\n\nA paragraph that is\nwrapped here\n \t\nand an end"),
    (8, 1, "user", "other words"),
    (8, 2, "user", "> A paragraph\n> that is wrapped\n> here\nquite so"),
    (8, 3, "user", "> other\n> words\n>\n> unknown\nboth"),
    (8, 4, "user", "> First part of\n> a letter\n>\n>   \n> A paragraph that\n> is wrapped here\ntwo of them"),
    *[(6, k, "user", f"message {k}" if k == 0 else f"> message {k - 1}\nmessage {k}") for k in range(20)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def linked(spark):
    return quoting.linked(spark.createDataFrame(MESSAGES, SCHEMA)).toPandas()


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, op5_quoting, sql())


def test_fixture_matches_sql(linked):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(MESSAGES, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows(linked) == rows(con.execute(sql()).df())


def one(linked, conv, turn):
    return linked[(linked.conv_id == conv) & (linked.turn == turn)].iloc[0]


def test_links_and_threads(linked):
    r = one(linked, 1, 2)
    assert (r.reply_to, r.text, r.n_quotes, r.n_linked) == (0, "I agree", 1, 1)
    r = one(linked, 1, 3)
    assert (r.reply_to, r.thread, r.depth, r.text) == (2, 0, 2, "me too")
    assert pd.isna(one(linked, 1, 4).reply_to) and one(linked, 1, 4).text == "what"
    assert one(linked, 1, 5).reply_to == 1 and one(linked, 4, 2).reply_to == 0 and pd.isna(one(linked, 5, 0).reply_to)
    deep = one(linked, 6, 19)
    assert (deep.thread, deep.depth, deep.reply_to) == (0, 19, 18)


def test_reply_order(linked):
    keys = linked[["conv_id", "thread", "turn"]].dropna().values.tolist()
    assert keys == sorted(keys)
    known = linked.dropna(subset=["reply_to"])
    assert (known.reply_to < known.turn).all()


def test_edge_cases(spark):
    df = spark.createDataFrame([(*m, "x", 1) for m in MESSAGES] + [(7, 0, "user", "word " * 100_000, "x", 1)], SCHEMA + ", thread string, own int")
    assert quoting.linked(df).count() == len(MESSAGES) + 1
    assert quoting.linked(df.where("1 = 0")).count() == 0


def test_paragraphs_link_however_they_are_wrapped(linked):
    assert [one(linked, 8, k).reply_to for k in (2, 3, 4)] == [0, 1, 0]
    assert [one(linked, 8, k).text for k in (2, 3, 4)] == ["quite so", "both", "two of them"]


def plain_own(text):
    """The own text by patterns that repeat groups, which Python can at this length."""
    lines = []
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        marks = re.match(r"[\x20\t]*>(?:[\x20\t]*>)*[\x20\t]?", line)
        lines.append((bool(marks), line[marks.end() :] if marks else line))
    cited = [quoted or (lines[k + 1][0] if k + 1 < len(lines) else False) and bool(re.search(quoting.ATTRIBUTION.removesuffix("$") + r"\Z", body)) for k, (quoted, body) in enumerate(lines)]
    own = re.sub(r"\n(?:[\x20\t]*\n){2,}", "\n\n", "\n".join(body for (_, body), gone in zip(lines, cited) if not gone))
    return re.sub(r"\A(?:[\x20\t]*\n)+|(?:\n[\x20\t]*)+\Z", "", own)


def test_own_text_against_patterns(spark):
    rng = random.Random(1)
    parts = ["\n", "\n", "\n\n", " ", "\t", "a", "b", "x", "> ", ">", "wrote:", "\r\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)] + [" ", "\n", "wrote: \n> q", "A ÉCRIT :\n> q", "x wrote: \n> q"]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", quoting.own_text(quoting.lines(F.col("text"))).alias("own")).collect()
    assert [(texts[r.k], r.own) for r in got if r.own != plain_own(texts[r.k])] == []


def test_long_runs_of_blank_lines_and_marks(spark):
    n = 20_000  # repeated groups of a pattern would exhaust the stack of the JVM, which ends with it
    texts = ["a line", "a\n" + " \t\n" * n + "b" + "\n " * n, ">" * n + " a line\ny", "> " * n + "a line\ny", "> a line\n\nz\n" * n]
    got = {r.turn: r for r in quoting.linked(spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[k].text for k in range(4)] == ["a line", "a\n\nb", "y", "y"] and got[4].text == "\n\n".join(["z"] * n)
    assert [got[k].reply_to for k in range(5)] == [None, None, 0, 0, 0] and got[4].n_quotes == got[4].n_linked == n

"""Texts made to exhaust a pattern or to lead numbers together."""

import pytest
from pyspark.sql import functions as F

from kinloom.llm import chat, private
from kinloom.llm.common import Scratch

N = 100_000
PIECES = (">", " >", "> ", "a.", "a@a.", "a@", ".", "-", "+", "1", "1-", "1.", "12/", "(", "A1 ", "DE89 ", "AKIA", "token=", "token ", "=", "00", "+1 ", "é", "\n", "\t", "On ", "wrote:", "jan ", "31 de ", "#", "x" * 50)


@pytest.mark.parametrize("start", ["", "a@"])
def test_no_text_ends_a_session(spark, start):
    rows = [(i, start + p * N) for i, p in enumerate(PIECES)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = private.pseudonymised(d, "k").select("row.doc_id", F.length("text").alias("n")).collect()
    assert len(got) == len(rows)
    turns = d.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    assert chat.linked(turns, Scratch(spark, "hostile")).count() == len(rows)
    assert spark.range(3).count() == 3


def test_long_addresses_are_found(spark):
    """As many labels as a domain can have; beyond that the text is left alone or permuted, but nothing fails."""
    texts = ["me@" + "ab." * n + "org" for n in (1, 20, 126, 5_000)]
    got = {r.row.doc_id: r for r in private.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert all(got[i].text != texts[i] and len(got[i].text) == len(texts[i]) for i in range(3)) and len(got[3].text) == len(texts[3])


def test_no_two_phones_meet(spark):
    """Usual and unusual areas and exchanges: images differ, keep to their set, and do not depend on separators or the country's code."""
    ids = spark.range(12_000)
    number = F.format_string("%03d%03d%04d", (F.col("id") * 37) % 1000, (F.col("id") * 611) % 1000, F.col("id") % 10_000)
    d = ids.select(number.alias("d")).distinct().select("d", F.regexp_replace("d", "(...)(...)(....)", "$1-$2-$3").alias("text"))
    got = private.pseudonymised(d, "k").filter(F.size("found") == 1).select("row.d", "text").toPandas()
    assert len(got) > 9_000 and got.text.nunique() == len(got)
    kind = lambda x: (x[0] >= "2", x[0] >= "2" and x[-7 if "-" not in x else 4] >= "2")
    assert all(kind(a) == kind(b) for a, b in zip(got.d, got.text, strict=True))
    other = private.pseudonymised(d.select("d", F.concat(F.lit("+1 "), "text").alias("text")), "k").select("row.d", "text").toPandas()
    assert dict(zip(other.d, (x[3:] for x in other.text), strict=True)).items() >= dict(zip(got.d, got.text, strict=True)).items()


def test_french_phones_are_permuted(spark):
    d = spark.range(5_000).select(F.format_string("0%d%08d", F.col("id") % 9 + 1, F.col("id") * 9_973).alias("text"))
    got = [r.text for r in private.pseudonymised(d, "k").select("text").distinct().collect()]
    assert len(got) == 5_000 and all(x[0] == "0" and x[1] != "0" for x in got)


def test_one_pass_or_two(spark):
    """A text that holds the mark itself gets the same pseudonyms."""
    text = "call 212-555-0100 or a.b@example.org on 2020-02-29"
    a, b = (r.text for r in private.pseudonymised(spark.createDataFrame([(1, text), (2, "\x01" + text)], "doc_id long, text string"), "k").orderBy("row.doc_id").collect())
    assert b == "\x01" + a and "555-0100" not in a

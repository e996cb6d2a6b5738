import pytest
from pyspark.sql import functions as F

from quorate.functions import parsers


def run(spark, parse, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text


def test_verdict(spark):
    run(spark, parsers.parse_verdict, [
        ("VERDICT: **Supported**", 0), ("**VERDICT: HALLUCINATED**", 1), ("VERDICT: SUPPORTED\nno, VERDICT: HALLUCINATED", 1), ("verdict - not sure", None), ("Verdict: unsure", None),
        ("VERDICT: UNSUPPORTED", 0), ("VERDICT: <HALLUCINATED or SUPPORTED>", 1), ("I think it is well supported.", 0), ("hallucination " + "x" * 300, None), ("nothing", None), ("", None), (None, None),
        ("VERDICT: ABSTAIN", None), ("VERDICT: ABSTAIN as no support was found", 0),
    ])


def test_result(spark):
    run(spark, parsers.parse_result, [("good [RESULT] 4", 4.0), ("[RESULT] 2 then [RESULT] **5**", 5.0), ("it is 4/5", 4.0), ("3 out of 5, or 2 / 5", 2.0), ("[RESULT] 9", None), ("", None), (None, None)])


def test_rating(spark):
    run(spark, parsers.parse_rating, [("[[3]] and [[ 8 ]]", 8.0), ("[[7.5]]", 7.5), ("[[11]]", None), ("[[2]] [[11]]", None), ("[2]", None), (None, None)])


def test_score(spark):
    run(spark, parsers.parse_score, [
        ("10", 10.0), ("45", None), ("\n\n 7\nbecause", 7.0), ("4/10 since", 4.0), ("Score: 8", 8.0), ("It is fine.\nScore: 7", 7.0), ("Scores: 3. Score: 12", 3.0), ("1. The answer is right", 1.0),
        ("I would rate it a 6 overall", 6.0), ("a score of 3, but 9/10 in the end", 9.0), ("it gets 9 out of 10, a score of 3", 3.0), ("30-day trial", None), ("rated 45", None), ("", None), (None, None),
    ])


@pytest.mark.parametrize(("judge", "score", "label"), [("prometheus2", 3.0, 0), ("prometheus2", 2.0, 1), ("judgelm", 5.5, 0), ("autoj", 5.0, 1), ("autoj", None, None)])
def test_graded_label(spark, judge, score, label):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(parsers.graded_label(F.col("s"), parsers.THRESHOLDS[judge])).first()[0] == label


def test_other_labels(spark):
    r = spark.createDataFrame([(1, 0, None)], "a int, b int, c int").select(parsers.choice_label(F.col("a")), parsers.specialist_label(F.col("b")), parsers.choice_label(F.col("c"))).first()
    assert tuple(r) == (0, 1, None)

"""Labels from what judges write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.text import BLANK, strip

#: Fixed value: how a verdict line names its verdict.
VERDICT = r"(?i)verdict\s*[:\-]?\s*\**\s*(hallucinat\w*|support\w*|not\s*sure|unsure)"
#: Fixed value: characters at the end of a text in which a verdict is looked for when no verdict line is there.
TAIL = 200

#: How each graded judge writes its score.
RESULT_1_5 = r"\[RESULT\]\s*\**\s*([1-5])"
FALLBACK_1_5 = r"\b([1-5])\s*(?:/\s*5|out of 5)"
RATING = r"\[\[\s*(\d+(?:\.\d+)?)\s*\]\]"
_1_10 = r"(10(?:\.0+)?|[1-9](?:\.\d+)?)"
LEADING_1_10 = r"(?i)^(?:score\s*[:=]?\s*)?" + _1_10 + r"(?:$|[^\d.]|\.\D|\.$)"
FINAL_1_10 = r"(?i)\bscores?\s*[:=]\s*(\d+(?:\.\d+)?)"
CONTEXTS_1_10 = (r"\bscores?\s+(?:of|is|was|would\s+be|:|=)\s*", r"\brat(?:e|ed|ing)\s+(?:it\s+)?(?:a\s+|as\s+|of\s+)?")
OUT_OF_10 = r"\s*(?:/|out\s+of)\s*10\b"

#: Score from which each graded judge counts a text as supported.
THRESHOLDS = {"prometheus2": 3.0, "judgelm": 5.5, "autoj": 5.5}


def _wide(pattern: str) -> str:
    """A pattern whose blanks are those of Unicode."""
    return pattern.replace(r"\s", BLANK)


def _last(text: Column, pattern: str) -> Column:
    pattern = _wide(pattern)
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def parse_verdict(text: Column) -> Column:
    """1 hallucinated, 0 supported, null undecided or unreadable.

    The last verdict line counts.  Without one, the end of the text is searched for the two stems, the first named
    before the other.  Empty and null texts are null.
    """
    said = F.lower(_last(text, VERDICT))
    tail = F.lower(F.right(text, F.lit(TAIL)))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(said.startswith("hallucinat"), 1)
        .when(said.startswith("support"), 0)
        .when(said.isNotNull(), None)
        .when(tail.contains("hallucinat"), 1)
        .when(tail.contains("support"), 0)
    )


def parse_result(text: Column) -> Column:
    """Score 1..5 of the rubric judge: its last result mark, else the last score out of 5."""
    return F.coalesce(_last(text, RESULT_1_5), _last(text, FALLBACK_1_5)).cast("double")


def parse_rating(text: Column) -> Column:
    """Score 1..10 of the rating judge: its last double-bracketed number if that lies in the range."""
    value = _last(text, RATING).cast("double")
    return F.when(value.between(1, 10), value)


def parse_score(text: Column) -> Column:
    """Score 1..10 of the score-first judge.

    The first line that is not blank may begin with it; else the last valid ``score: n``; else, of a score, a rating
    and a number out of 10 named in the text, the one that ends last.  A list marker reads as a score.
    """
    first = F.regexp_extract(F.regexp_replace(text, _wide(r"^\s+"), ""), r"^([^\n\r]*)", 1)
    lead = F.regexp_extract(strip(first), _wide(LEADING_1_10), 1)
    finals = F.filter(F.regexp_extract_all(text, F.lit(_wide(FINAL_1_10)), F.lit(1)), lambda v: v.cast("double").between(1, 10))
    valid = r"(?:[^\d.]|\.\D|\.$|$)"
    # Each pattern is matched once, as far as its number or its 10; the number is then read off the end of the match.
    named = []
    for before, after in [*((c, None) for c in CONTEXTS_1_10), (r"(?:^|[^\d.])", OUT_OF_10)]:
        pattern = r"(?is)^(.*" + before + _1_10 + (after or "") + ")" + (valid if after is None else "")
        seen = F.regexp_extract(text, _wide(pattern), 1)
        named.append((F.length(seen), F.regexp_extract(seen, _wide("(?i)" + _1_10 + (after or "") + "$"), 1)))
    best = F.array_max(F.filter(F.array(*[F.struct(end.alias("end"), v.cast("double").alias("value")) for end, v in [(e, F.nullif(v, F.lit(""))) for e, v in named]]), lambda s: s["value"].isNotNull()))["value"]
    return F.coalesce(F.nullif(lead, F.lit("")).cast("double"), F.try_element_at(finals, F.lit(-1)).cast("double"), best)


def graded_label(score: Column, threshold: Column | float) -> Column:
    """0 where the score reaches the threshold, else 1; null without a score."""
    return F.when(score.isNull(), None).when(score >= threshold, 0).otherwise(1)


def specialist_label(supported: Column) -> Column:
    """Label of a specialist that says 1 for supported."""
    return 1 - supported


def choice_label(choice: Column) -> Column:
    """Label of a forced choice: Yes (1) is supported."""
    return 1 - choice


#: How each graded judge writes a score: the highest for a supported text, the lowest for a hallucinated one, none for an undecided one.
_MOCKS = {
    "prometheus2": ("Feedback: it follows from the source. [RESULT] 5", "Feedback: it is made up. [RESULT] 1", "Feedback: it is hard to say."),
    "judgelm": ("Score: 10\nIt follows from the source.", "Score: 1\nIt is made up.", "It is hard to say."),
    "autoj": ("It follows from the source. Rating: [[10]]", "It is made up. Rating: [[1]]", "It is hard to say."),
}
SCORES = {"prometheus2": parse_result, "judgelm": parse_score, "autoj": parse_rating}


def native_mock(judge: str, pred: Column) -> Column:
    """What a graded judge would write for a label, in its own form."""
    good, bad, none = _MOCKS[judge]
    return F.when(pred == 0, good).when(pred == 1, bad).otherwise(none)


def native_label(judge: str, text: Column) -> Column:
    """Label of a graded judge's text: its score against its threshold."""
    if judge not in SCORES:
        raise ValueError(f"unknown graded judge {judge!r}")
    return graded_label(SCORES[judge](text), THRESHOLDS[judge])

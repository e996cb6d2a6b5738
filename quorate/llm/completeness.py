"""Texts that stop before their end.

A stack automaton reads the structure of every text: quotes, brackets, fences, bold marks and markup that open and
close.  What is open at the end, marks that a cut leaves, broken escapes and byte sequences, abbreviations and verdicts
that are not whole tell cut texts from whole ones.  An end without terminator counts as a cut where the source of the
text usually ends its texts with one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import cut, spread

#: States of a text.
EMPTY, WHOLE, CUT, OPEN = 0, 1, 2, 3

#: The words of a whole verdict, headings that may stand with nothing behind them, abbreviations that something follows, and markup that must be closed.
VERDICTS = ("hallucinated", "supported", "not sure", "unsure", "abstain", "n/a", "not supported", "unsupported")
HEADINGS = ("a", "q", "answer", "question", "evidence", "context", "document", "claim", "candidate", "candidate answer", "antwort", "frage", "réponse", "question", "respuesta", "pregunta")
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "st", "e.g", "i.e", "cf", "vs", "viz", "fig", "approx", "bzw", "z.b", "d.h", "vgl", "nr", "abs", "u.a", "p.ex", "sr", "sra", "dra", "p.ej", "pág")
PAIRED = ("a", "b", "i", "u", "em", "strong", "code", "pre", "span", "div", "sub", "sup", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "mark", "small", "cite")

_BLANK = " \t\r\n\f\v\u00a0\u2007\u202f\u2009\u200b\u200c\u200d\u2060\ufeff\u00ad\u3000"
_LETTER = re.compile(r"[^\W_]")
_CLOSERS = "\"'”’»«“)]}*_`"
_STOPS = ".!?。！？؟…"
#: What a cut leaves: dots, a note in brackets, a replacement character, part of an escape, of an encoded byte or of a multibyte character read byte by byte, a hyphen.
_MARK = re.compile(
    r"(?:\[\s*(?:\.{2,}|…|truncated|cut|cut off)\s*\]|\(\s*(?:\.{2,}|…|truncated)\s*\)|<\s*(?:truncated|cut)\s*>|…|\.{3,}|�+"
    r"|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)|(?:(?<![\d\s])|(?<=%[0-9a-fA-F]{2}))%[0-9a-fA-F]?|[ÃÂ]|â[€‚„]|ðŸ.?|ï[¿»]|-)$",
    re.IGNORECASE,
)
#: What every mark has near the end; a cheap test before the marks themselves.
_MARKED = re.compile(r"[\\&%ÃÂâðï]|[^\w]$")
_ENTITY = re.compile(r"&(#x?[0-9a-fA-F]{0,6}|[a-z]{2,8}|)$")
_VERDICT = re.compile(r"\s*[:\-–—]?\s*(\**)\s*(?:" + "|".join(VERDICTS) + r")\s*(\**)\s*\.?\s*(\**)", re.IGNORECASE)
_VERDICT_BEGUN = re.compile(r"\s*[:\-–—]?\s*\**\s*([\w/]*(?:\s+\w*)?)\**\.?", re.IGNORECASE)
_LABEL = re.compile(r"^(?:[#>*\-\s]*)(?:" + "|".join(HEADINGS) + r")\**\s*:?\**$", re.IGNORECASE)
_NUMBERED = re.compile(r"(?:^|\n)\s*\(?\d{1,3}[.)]$")
_ABBREVIATED = re.compile(r"(?:^|[\s(\[\"“„«])(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")\.$", re.IGNORECASE)
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "»": "«", "«": "»"}
_STRUCTURE = re.compile(r"```|(?<!\s)\*\*|\*\*(?!\s)|(?<![:;])(?<![:;]-)\(|[)\[\]{}“”„«»\"`]|<(/?)(" + "|".join(PAIRED) + r")\b[^<>\n]*>", re.IGNORECASE)
#: What every structure has; a text without it leaves the automaton's stack empty.
_SIGNS = re.compile("[]()[{}“”„«»\"`<*]")
#: Structures that a whole sentence may leave open: a quotation can go on.
_QUOTES = frozenset("\"“„«»")


def opened(text: str) -> list[str]:
    """The quotes, brackets, fences, bold marks and markup that are open at the end of a text, in order.

    What stands in code counts for nothing until the code is closed.  A closer takes everything opened inside with it;
    one that closes nothing is ignored, as is an inch sign behind a digit.
    """
    stack: list[str] = []
    held: dict[str, int] = {}  # how often each sign is on the stack

    def close(sign: str) -> None:
        while True:
            top = stack.pop()
            held[top] -= 1
            if top == sign:
                return

    def open_(sign: str) -> None:
        stack.append(sign)
        held[sign] = held.get(sign, 0) + 1

    code = ""
    for m in _STRUCTURE.finditer(text):
        s = m.group()
        if code:
            if s == code:
                close(s)
                code = ""
        elif s in ("```", "`"):
            open_(s)
            code = s
        elif m.group(2):
            s = "<" + m.group(2).lower()
            if not m.group(1):
                open_(s)
            elif held.get(s):
                close(s)
        elif s in ("**", '"'):
            if held.get(s):
                close(s)
            elif s != '"' or not text[m.start() - 1 : m.start()].isdigit():
                open_(s)
        else:
            closed = [c for c in _CLOSES.get(s, "") if held.get(c)]
            if closed:
                close(closed[0])
            elif s not in ")]}”":
                open_(s)
    return stack


def _unmarked(text: str) -> str:
    """A text without the marks that a cut leaves at its end."""
    while text and _MARKED.search(text[-12:]):
        m = _MARK.search(text)
        if not m:
            m = _ENTITY.search(text)
            name = m.group(1) if m else None
            if name is None or (name and name[0] != "#" and not any(n.startswith(name) for n in name2codepoint)):
                break
        text = text[: m.start()].rstrip(_BLANK)
    return text


def _verdict_end(text: str) -> int | None:
    """State of a text that ends with a verdict or part of one; None for any other."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    at = low.rfind("verdict")
    if at >= 0:
        rest, before = text[at + 7 :], text[:at].rstrip()
        stars = [len(before) - len(before.rstrip("*"))]
        if m := _VERDICT.fullmatch(rest):
            stars += [len(g) for g in m.groups()]
            return WHOLE if sum(n // 2 for n in stars) % 2 == 0 and 1 not in stars else CUT
        m = _VERDICT_BEGUN.fullmatch(rest)
        if m and any(v.startswith(m.group(1).lower().strip()) for v in VERDICTS):
            return CUT
    tail = low[-9:].rsplit("*", 1)[-1]
    return CUT if at < 0 and "*" in low[-9:] and len(tail) >= 3 and "verdict".startswith(tail) else None


def _end(text: str) -> int:
    """State of a text without cut marks."""
    while True:
        line = text[text.rfind("\n") + 1 :]
        if not _LABEL.match(line.strip()):
            break
        # A heading with nothing behind it: what stands before it decides.
        text = text[: len(text) - len(line)].rstrip(_BLANK)
        if not text:
            return OPEN
    told = _verdict_end(text)
    if told is not None:
        return told
    left = opened(text) if _SIGNS.search(text) else []
    if _NUMBERED.search(text) or _ABBREVIATED.search(text[-12:]):
        return CUT
    bare = text.rstrip(_CLOSERS + _BLANK)
    if bare and bare[-1] in _STOPS:
        return CUT if set(left) - _QUOTES else WHOLE
    return CUT if left else OPEN


def state(text: str | None) -> int:
    """EMPTY without letter or digit, WHOLE, CUT, or OPEN where only the terminator is missing."""
    if text is None:
        return EMPTY
    text = text.rstrip(_BLANK)
    if not _LETTER.search(text):
        return EMPTY
    if text[-1] == "." and text[-2:-1].isalpha() and not _SIGNS.search(text) and not _ABBREVIATED.search(text[-12:]) and "verdict" not in text[-40:].lower():
        # The stack stays empty, and the end is a plain sentence's.
        return WHOLE
    rest = _unmarked(text)
    end = _end(rest) if rest else CUT
    return CUT if end == OPEN and rest != text else end


def states(records: DataFrame, key: str = "rec_id", source: str = "model", text: str = "raw") -> DataFrame:
    """``key``, ``source`` and the ``state`` of each text; tasks read whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([state(t) for t in batch.column(2).to_pylist()], pa.int32())], ["key", "source", "state"])

    kinds = {c: records.schema[c].dataType.simpleString() for c in (key, source)}
    return spread(records.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))).mapInArrow(run, f"key {kinds[key]}, source {kinds[source]}, state int").select(F.col("key").alias(key), F.col("source").alias(source), "state")


def baselines(stated: DataFrame, source: str = "model") -> DataFrame:
    """Per ``source``: whether its whole-looking texts usually end with a terminator (``terminates``)."""
    return stated.groupBy(source).agg((F.count_if(F.col("state") == WHOLE) >= F.count_if(F.col("state") == OPEN)).alias("terminates"))


def judged(records: DataFrame, key: str = "rec_id", source: str = "model", text: str = "raw") -> DataFrame:
    """``key``, ``source``, ``state`` and ``is_cut`` of each text.

    Null and empty texts are not cut; repeated rows are judged alike; a null source is a source of its own.  Texts are
    read once: their states are written, so that the baselines of the sources come from them.
    """
    return with_baseline(cut(states(records, key, source, text)), source)


def with_baseline(stated: DataFrame, source: str = "model") -> DataFrame:
    """``stated`` (read several times) with ``is_cut``, which an OPEN text is where its source usually terminates.

    Only OPEN texts, which are few, meet the baselines; no other row is moved.
    """
    base = baselines(stated, source).withColumnRenamed(source, "_of")
    told = stated.where(F.col("state") != OPEN).withColumn("is_cut", F.col("state") == CUT)
    unsure = stated.where(F.col("state") == OPEN).join(base, F.col(source).eqNullSafe(F.col("_of")), "left")
    return told.unionByName(unsure.withColumn("is_cut", F.coalesce("terminates", F.lit(False))).drop("_of", "terminates"))


def truncated(records: DataFrame) -> DataFrame:
    """rec_id of the records whose raw text was cut."""
    return judged(records).where("is_cut").select("rec_id")


def truncation_rates(records: DataFrame) -> DataFrame:
    """model, n_texts (not empty), n_cut and share_cut (null without texts)."""
    per = judged(records).groupBy("model").agg(F.count_if(F.col("state") != EMPTY).alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    return per.withColumn("share_cut", F.try_divide("n_cut", "n_texts"))

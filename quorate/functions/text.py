"""Text functions shared by prompts, parsers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every white-space character of Unicode, as a class that Java and RE2 read alike.
BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: Column) -> Column:
    """``x`` without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def filled(entries: Column) -> Column:
    """Stripped entries of a list that are not blank; the empty list for null."""
    return F.filter(F.transform(F.coalesce(entries, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def point(*parts: Column | str) -> Column:
    """A stable number in [0, 2^32) from the text of the parts: the draw behind every seeded choice."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def content_key(question: Column, context: Column, candidate: Column) -> Column:
    """Digest of an item's content: question, each context entry and candidate, divided by a zero byte.

    Null parts count as empty.
    """
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    body = F.aggregate(F.coalesce(context, F.array().cast("array<string>")), F.lit(""), lambda acc, x: F.concat(acc, F.coalesce(x, F.lit("")), zero))
    return F.sha1(F.encode(F.concat(F.coalesce(question, F.lit("")), zero, body, zero, F.coalesce(candidate, F.lit(""))), "UTF-8"))

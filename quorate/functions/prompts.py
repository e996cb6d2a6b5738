"""Prompts as column expressions.  The wording is our own; the structure is data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.text import filled, strip

#: Characters of context shown for an exemplar and for the judged item.
EXEMPLAR_CHARS, QUERY_CHARS = 600, 2400
NO_DOCUMENT = "(no document provided)"
OPTIONS = "HALLUCINATED or SUPPORTED"
REASON = "Reason in one or two sentences, then end with one line:"
DEFINITION = "An answer is HALLUCINATED if any part of it contradicts the evidence or has no basis in it; otherwise it is SUPPORTED."
ASK = "Is the candidate answer free of hallucination?"
CLAIM_INTRO = "Say whether the document fully supports the claim. Every part of a SUPPORTED claim is stated in the document or follows from it; any part that it does not support makes the claim HALLUCINATED."
FEWSHOT_HEAD = "Say for each claim whether the given information fully supports it. Answer Yes or No."
#: Parts of the graded judges' prompts. Their marks ([INST], ###, [RESULT], Score:, [[rating]]) are those the judges were trained on.
PROMETHEUS_SYSTEM = "You are a fair judge who gives clear and objective feedback by fixed criteria."
PROMETHEUS_TASK = (
    "You see an instruction (perhaps with an input), a response to it, a reference answer that gets a score of 5, and a rubric.\n1. Write detailed feedback by the rubric alone.\n2. Then give a score that is a whole number from 1 to 5.\n"
    '3. Write "Feedback: (your feedback) [RESULT] (a whole number from 1 to 5)".\n4. Write nothing before or after it.'
)
PROMETHEUS_RUBRIC = (
    "contradicts the SOURCE or is made up as a whole.", "makes a clear statement that the SOURCE does not support.", "keeps to the subject but adds something that the SOURCE does not support.",
    "is supported by the SOURCE but for a negligible detail.", "is supported by the SOURCE in every part.",
)
JUDGELM_SYSTEM = "You are a helpful and precise assistant who checks the quality of an answer."
JUDGELM_ASK = "Please say how well {source} supports the {thing} above, on a scale of 1 to 10: 10 if every part of it is supported, 1 if it is unsupported or made up.\nOn the first line write only 'Score: N', N being a whole number from 1 to 10; explain it briefly on the lines below."
AUTOJ_HEAD, AUTOJ_ASK = "Write critiques for a submitted response on a given user's query, and grade the response:", 'Write critiques for this response. Then give a final rating from 1 to 10 in exactly this form: "[[rating]]", for example "Rating: [[5]]".'
#: Data sets whose question belongs to the document of a specialist.
QUESTION_IN_DOCUMENT = ("medhallu", "ragtruth")
#: Tokens kept free in a judge's window besides the answer, and what stands where a prompt was shortened.
MARGIN, CUT_NOTE = 128, " [shortened to fit] "


def frame(dataset: Column) -> Column:
    """``claimcheck`` for the claim sets, else ``qa``."""
    return F.when(dataset.startswith("aggrefact_"), "claimcheck").otherwise("qa")


def condition(dataset: Column) -> Column:
    """Condition under which a data set is measured."""
    return F.when(dataset.startswith("aggrefact_"), "claimcheck").otherwise("def_on")


def context_block(context: Column, has_context: Column, label: Column) -> Column:
    """Context entries as bullets under their label; empty for an ungrounded set or without entries in the list."""
    body = F.array_join(F.transform(filled(context), lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.when(has_context & (F.size(F.coalesce(context, F.array().cast("array<string>"))) > 0), F.concat(F.lit("\n# "), label, F.lit("\n"), body, F.lit("\n"))).otherwise("")


def qa_prompt(question: Column, context: Column, candidate: Column, subject: Column, has_context: Column, label: Column) -> Column:
    """Prompt that shows question, evidence and candidate answer."""
    head = F.concat(F.lit("You assess a candidate answer to "), subject, F.lit(". You see the question"), F.when(has_context, ", the evidence").otherwise(""), F.lit(" and one candidate answer."))
    return F.concat(
        head, F.lit(f"\n\nDefinition. {DEFINITION}\n\n{ASK}\n\n{REASON}\nVERDICT: <{OPTIONS}>\n\n# Question\n"), strip(question), F.lit("\n"),
        context_block(context, has_context, label), F.lit("\n# Candidate answer\n"), strip(candidate), F.lit("\n"),
    )


def document(question: Column, context: Column, candidate: Column, has_context: Column) -> Column:
    """Document of the claim frame: a question that is no copy of the claim, then the context entries, else a note."""
    q = strip(question)
    asked = F.when((q != "") & (q != strip(candidate)), F.array(F.concat(F.lit("Question under discussion: "), q))).otherwise(F.array().cast("array<string>"))
    shown = F.when(has_context, filled(context)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(asked, shown)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(NO_DOCUMENT)


def claim_prompt(question: Column, context: Column, candidate: Column, has_context: Column) -> Column:
    """Prompt of the claim frame."""
    return F.concat(F.lit(f"{CLAIM_INTRO}\n\n{REASON}\nVERDICT: <{OPTIONS}>\n\n# Document\n"), document(question, context, candidate, has_context), F.lit("\n\n# Claim\n"), strip(candidate), F.lit("\n"))


#: Conditions, formats and paraphrases that a prompt can be asked for.
CONDITIONS, FORMATS, PARAPHRASES = ("def_on", "claimcheck"), ("brief_reason",), ("p0",)


def prompt(condition: str, question: Column, context: Column, candidate: Column, subject: Column, has_context: Column, label: Column, fmt: str = "brief_reason", paraphrase: str = "p0") -> Column:
    """Prompt under a condition; an unknown condition, format or paraphrase is an error."""
    for value, known in ((condition, CONDITIONS), (fmt, FORMATS), (paraphrase, PARAPHRASES)):
        if value not in known:
            raise ValueError(f"{value!r} is not among {known}")
    if condition == "claimcheck":
        return claim_prompt(question, context, candidate, has_context)
    return qa_prompt(question, context, candidate, subject, has_context, label)


def fewshot_block(question: Column, context: Column, candidate: Column, has_context: Column, label: Column, is_claim: Column, cap: int, answer: Column | None = None) -> Column:
    """Completion block of one item, ended by ``answer`` or left open.

    The context is cut to ``cap`` characters; a claim's own copy as question is not shown.
    """
    body = F.array_join(filled(context), "\n")
    short = F.when(F.length(body) > cap, F.concat(F.left(body, F.lit(cap)), F.lit(" ..."))).otherwise(body)
    lines = F.concat_ws(
        "\n",
        F.when(has_context & (F.size(F.coalesce(context, F.array().cast("array<string>"))) > 0), F.concat(label, F.lit(": "), short)),
        F.when((question != "") & ~(is_claim & (strip(question) == strip(candidate))), F.concat(F.lit("Question: "), question)),
        F.concat(F.lit("Claim: "), candidate),
    )
    return F.concat(lines, F.lit("\nAnswer:") if answer is None else F.concat(F.lit("\nAnswer: "), answer))


def fewshot_prompt(shots: Column, query: Column) -> Column:
    """Head, the exemplars' blocks and the open block of the judged item; ends in a blank, behind which the answer stands."""
    return F.concat(F.array_join(F.concat(F.array(F.lit(FEWSHOT_HEAD)), F.coalesce(shots, F.array().cast("array<string>")), F.array(query)), "\n\n"), F.lit(" "))


def evidence(context: Column, has_context: Column) -> Column:
    """Context entries as one block; empty for an ungrounded set."""
    return F.when(has_context, F.array_join(filled(context), "\n")).otherwise("")


def prometheus_prompt(question: Column, context: Column, candidate: Column, has_context: Column, claim: bool) -> Column:
    """Absolute grading from 1 to 5 against a rubric; the answer ends in ``[RESULT]`` and the score."""
    ctx = evidence(context, has_context)
    thing, source = ("claim", "document") if claim else ("response", "reference evidence")
    if claim:
        task = F.concat(F.lit("Say whether the document fully supports the claim.\n\n(Input: the document)\n"), document(question, context, candidate, has_context))
    else:
        task = F.concat(strip(question), F.when(ctx != "", F.concat(F.lit("\n\n(Input: the reference evidence)\n"), ctx)).otherwise("\n\n(No reference evidence is given; judge by established facts.)"))
    rubric = "\n".join(f"Score {i}: The {thing} {x}" for i, x in enumerate(PROMETHEUS_RUBRIC, 1)).replace("SOURCE", source)
    return F.concat(
        F.lit(f"[INST] {PROMETHEUS_SYSTEM}\n\n###Task Description:\n{PROMETHEUS_TASK}\n\n###The instruction to evaluate:\n"), task, F.lit("\n\n###Response to evaluate:\n"), strip(candidate),
        F.lit(f"\n\n###Reference Answer (Score 5):\nA {thing} every part of which the {source} states or implies.\n\n###Score Rubrics:\n[Does the {source} fully support the {thing}?]\n{rubric}\n\n###Feedback: [/INST]"),
    )


def judgelm_prompt(question: Column, context: Column, candidate: Column, has_context: Column, claim: bool) -> Column:
    """Grading from 1 to 10 with the reference as a closed block behind the answer; ends in ``Score:``, behind which the score stands."""
    ctx = evidence(context, has_context)
    closed = lambda x: F.concat(F.lit("[The Start of Reference Answer]\n"), x, F.lit("\n[The End of Reference Answer]\n\n"))
    ask = lambda source: F.lit(JUDGELM_ASK.format(thing="claim" if claim else "answer", source=source))
    asked = F.lit("Does the reference document fully support the following claim?") if claim else strip(question)
    if claim:
        rest = F.concat(closed(document(question, context, candidate, has_context)), F.lit("[System]\n"), ask("the reference document"))
    else:
        rest = F.when(ctx != "", F.concat(closed(ctx), F.lit("[System]\n"), ask("the reference"))).otherwise(F.concat(F.lit("[System]\n"), ask("established facts")))
    return F.concat(F.lit(f"{JUDGELM_SYSTEM}\n\n[Question]\n"), asked, F.lit("\n\n[The Start of Assistant's Answer]\n"), strip(candidate), F.lit("\n[The End of Assistant's Answer]\n\n"), rest, F.lit("\n\nScore:"))


def autoj_prompt(question: Column, context: Column, candidate: Column, has_context: Column, claim: bool) -> Column:
    """Critique and a rating from 1 to 10 in double brackets; a claim stands as the response, its document in the query."""
    ctx = evidence(context, has_context)
    scale = "and rate that (10 = every part is supported, 1 = unsupported or made up)"
    if claim:
        query = F.concat(F.lit(f"Say whether the following document fully supports the response, read as a claim by itself, {scale}:\n"), document(question, context, candidate, has_context))
    else:
        query = F.concat(strip(question), F.when(ctx != "", F.concat(F.lit(f"\n\nSay whether the following reference evidence fully supports the response, {scale}:\n"), ctx)).otherwise("\n\nSay whether the response is correct by established facts, and rate that (10 = entirely correct, 1 = false or made up)."))
    return F.concat(F.lit(f"[INST] {AUTOJ_HEAD}\n\n[BEGIN DATA]\n***\n[Query]: "), query, F.lit("\n***\n[Response]: "), strip(candidate), F.lit(f"\n***\n[END DATA]\n\n{AUTOJ_ASK} [/INST]"))


#: Native prompts of the graded judges.
NATIVE = {"prometheus2": prometheus_prompt, "judgelm": judgelm_prompt, "autoj": autoj_prompt}


def specialist_document(dataset: Column, question: Column, context: Column) -> Column:
    """Document for a specialist: the context entries, behind the question for the question sets."""
    body = F.array_join(filled(context), "\n")
    return F.when(dataset.isin(*QUESTION_IN_DOCUMENT), F.concat(strip(question), F.lit("\n\n"), body)).otherwise(body)


def words(prompt: Column) -> Column:
    """Words of a prompt, which stand in for its tokens."""
    return F.split(strip(prompt), r"\s+")


def fit(prompt: Column, words: Column, window: Column, reserve: int) -> Column:
    """``prompt`` without its middle where it has more ``words`` than the window leaves, both ends kept alike.

    Runs of white space become one blank where words are cut.
    """
    budget = window - reserve - MARGIN
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")
    kept = F.concat(F.array_join(F.slice(words, F.lit(1), head), " "), F.lit(CUT_NOTE), F.array_join(F.slice(words, -tail, tail), " "))
    return F.when((budget > 0) & (F.size(words) > budget), kept).otherwise(prompt)

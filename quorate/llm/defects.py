"""Prompt and response pairs that are broken: one defect type per response.

The response is aligned with its prompt: shingle containment and the longest common subsequence of words tell what it
gives back and what it adds.  Its sentences are aligned with templates of refusals, sequences of concepts whatever
their words; function words and scripts tell its language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm import completeness
from quorate.plans.lineage import cut, spread

#: Words per shingle, the share of a text's shingles that a copy contains, and the share of a text's words that a copy has in their order.
SHINGLE, CONTAINED, ALIGNED = 5, 0.8, 0.9
#: Words of a heading at most, such as stand before a colon.
HEADING = 4
#: What a word between two aligned concepts costs, and how well a sentence must fit a template.
GAP, SIMILAR = 0.05, 0.75

#: Function words of each language; one that several languages have stands in each.
FUNCTION_WORDS = {
    "en": "a the of and to that it was for with is by an not this which did had when who from were are its but there then at on in than what how only any other do does cannot be as if or he she they we you his her their our your has have been will would can could should about into over after before between such no so some these those my me him them up out all also because while where i am just most more very one".split(),
    "de": "der die das den dem des und ist nicht mit für von zu ein eine einer eines einem einen im in wurde war was dass auf bei als auch nach zur zum sich keine keinen kein laut wie ich wir sie er es habe hat haben kann welcher welche welches welchen aber nur jede jeder jedes sei warum obwohl über oder wenn wo am an aus um so noch schon sind werden worden durch gegen ohne vor unter bis mein meine ihr ihre seine diese dieser dieses wird wer niemand kaum ja nein man also".split(),
    "fr": "le la les des du de un une et est dans pour que qui ne pas au aux sur avec il elle ils elles ce cette ces sont était été je nous vous se sa son ses leur mais ou où donc plus comme lors après avant quelle quel quels selon aucun aucune nulle chaque par sans sous entre dont ai a à en y on être avoir fait si peu très bien tout tous rien personne pourquoi alors là enfin autre autres même me l d c qu n s".split(),
    "es": "el la los las de del y una un en para con por que no se su sus al como pero más muy cada otro otra otros nada según era fue fueron sobre hay tras antes ninguna ningún ninguno lo he ha han es son está están ser si sin entre porque cuando donde quien qué cuál ya también yo nos me le les este esta estos estas ese esa nadie apenas allí o a igual aquí da dan".split(),
    "it": "il lo la gli le un una di del della dei delle dello e è che non per con in sul sulla nel nella nei nelle al alla ai alle da dal dalla questo questa sono era stato stata come più ma anche se si suo sua loro ho ha hanno nessuna nessun niente ogni quale quali quando dove perché cui tra fra solo molto poi così a o l i no".split(),
    "pt": "o a os as um uma de do da dos das e é que não para por com em no na nos nas ao à aos às foi era são ser está este esta esse essa isso como mais mas também se seu sua ou quando onde porque nenhum nenhuma nada cada qual quais há já sem sobre entre pelo pela eu ele ela eles só muito me".split(),
    "nl": "de het een en van is dat die niet in op te met voor zijn was er aan ook als bij door naar uit om of maar dan nog wel geen over hij zij ik we wij je hun dit deze wordt werd worden heeft had hebben kan zou wat wie waar hoe waarom toen tot tegen onder na al zo".split(),
}
#: Letters and endings of words that are typical of a language.
_SIGNS = {"de": "ßäöü", "fr": "çœèêàùîôâûëé", "es": "ñóíúáé", "it": "òìùèà", "pt": "ãõâêç", "nl": "ëï"}
_ENDINGS = {
    "en": "ing ed ght ly ck th sh ous ess", "de": "ung keit heit cht tz ich lich tät ern eln", "fr": "eau eux oir aux ez aient ette ique ment ère euse ée ées", "es": "ción dad ado ada ados adas aron ieron amos mente",
    "it": "zione zioni tto tta tti mente ità gno glia", "pt": "ção ções dade inho inha mente aram eram", "nl": "heid ij ijk aar sch tje",
}
_SCRIPTS = {"ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff", "ko": "\uac00-\ud7af\u1100-\u11ff", "ru": "\u0400-\u04ff", "el": "\u0370-\u03ff", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f"}
#: What a typical letter or ending counts, a function word being 1 divided by the languages that have it.
SIGN = 0.4
#: By how much a language must outdo the question's.
CLEAR = 1.25

#: How each language says the concepts that refusals are made of (S the speaker, C cannot or may not, Z the same behind a German verb,
#: D declines, J judging, H helping, R rules, O outside, M a German modal verb, N a German negation, F finding, P a part only).
_CONCEPTS = {
    "C": r"inappropriate|impossible|can(?:'t|not| not)|could(?:n't| not)|won't|will not|would not|wouldn't|unable|unwilling|(?:not|n't) (?:be )?(?:able|allowed|permitted|authori[sz]ed|in a position|possible|appropriate|comfortable|qualified|equipped|willing|supposed|going|prepared|something i)|may not|must not|shall not|rather not|(?:prefer|choose|ask(?:ed)?) not|do(?:es)?(?: not|n't) (?:allow|permit|let)|forbids?"
    r"|ne (?:peux|puis|saurais|veux|souhaite|dois|vais)|ne (?:suis|me sens|serai) (?:pas|point) (?:\w+ )?(?:autorisée?|permise?|capable|mesure|habilitée?|disposée?|droit)|(?:suis|me sens) dans l'impossibilité|n'ai pas le droit|ne m'est pas (?:permis|possible)|(?:pas|point) permis|préfère ne|préférerais ne"
    r"|no (?:puedo|podré|podría|voy a|debo|quiero|deseo|estoy (?:autorizad\w*|en condiciones|capacitad\w*|facultad\w*|dispuest\w*)|me (?:está|es|resulta) (?:permitid|posible)\w*|me corresponde|soy capaz)|prefiero no|preferiría no",
    "Z": r"nicht (?:zulässig|möglich|gestattet|erlaubt|befugt|berechtigt|imstande|in der lage)|unzulässig|außerstande|untersagt",
    "D": r"declin\w*|refus\w*|abstain\w*|recus\w*|refrain\w*|pass on|opt out|abstenir|m'abstiens|m'abstenir|décline\w*|negarme|me niego|me negaré|rehús\w*|rehus\w*|abstener\w*|me abstengo|rechaz\w*|lehne|ablehn\w*|abzulehnen|verweiger\w*|weigere|enthalte|verzichte",
    "J": r"judg\w*|assess\w*|evalu\w*|rat(?:e|ing|ings)|grad(?:e|ing)|scor(?:e|ing)|review\w*|verdicts?|opin(?:e|ion|ions)|comment\w*|weigh(?:ing)? in|apprais\w*|pronounce|rule on|take a (?:position|stance|side)|opinions?"
    r"|évalu\w*|jug\w*|not(?:er|e|ation)|commenter|commentaires?|prononcer|avis|apprécier|appréciation|trancher"
    r"|beurteil\w*|bewert\w*|urteil\w*|kommentier\w*|äußern|einschätz\w*|einzuschätzen|stellung|rat\b|bewertung\w*|meinung"
    r"|juzg\w*|calific\w*|opin\w*|coment\w*|valor(?:ar|ación|arlo|arla)|juicios?|dictamen|pronunci\w*|puntu\w*|enjuiciar",
    "H": r"help|assist|answer|questions?|requests?|respond|engage|comply|continue with|aider|répondre|traiter|helfen|antworten|beantworten|weiterhelfen|ayudar\w*|responder\w*|contestar\w*|atender",
    "R": r"guidelines?|polic(?:y|ies)|rules|règles|regeln|richtlinien|normas|reglas|política",
    "O": r"outside|beyond (?:what|my)|hors de|en dehors|außerhalb|fuera de|exceeds",
    "M": r"kann|darf|möchte|werde|will|könnte|mag|sehe",
    "N": r"nicht|keine?|keinen|keiner|keinerlei",
    "F": r"find\w*|see|seeing|locate|trace|tell|say|date|detect|spot|identify|match|confirm|trouver|voir|relever|déceler|dire|finden|sehen|erkennen|sagen|feststellen|encontrar|hallar|ver|decir|detectar|hallo|encuentro",
    "S": r"i|i'm|i'd|i'll|i've|we|me|my|us|our|assistant|je|j'ai|j'|me|mon|mes|ma|m'est|moi|ich|mir|mich|mein|meine|meiner|meines|yo|mi|mis",
    "P": r"only|nur|solo|sólo|solamente|seulement|merely|fully|completely|entirely|though|although",
}
_CONCEPT = re.compile(r"\b(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _CONCEPTS.items()) + r")(?!\w)", re.IGNORECASE)
#: Refusals as sequences of concepts; a Spanish or French C names the speaker itself.
TEMPLATES = ("SCJ", "SCH", "CSJ", "CSH", "SDJ", "SDH", "SD.", "JSR", "SRCJ", "OSJ", "SMNJ", "MSNJ", "MNSJ", "SMNH", "MSNH", "MNSH", "SMJD", "SZJ", "SJZ", "ZSJ")
_SPEAKS = re.compile(r"\b(?:ne (?:peux|puis|saurais|veux|suis|dois|vais)|no (?:puedo|podré|podría|voy|debo|quiero|estoy|me|soy)|prefiero|preferiría|me niego|negarme|me abstengo|debo|tengo|lehne|weigere)\b", re.IGNORECASE)
#: What a refusal needs, a cheap test before the alignment: beginnings of words, or pieces of a text.
_HINT_STEMS = ("cannot", "unab", "unwill", "inapp", "imposs", "declin", "refus", "abst", "recus", "refrain", "guideline", "polic", "rule", "outside", "beyond", "forbid", "exceed", "décl", "nie", "neg", "reh", "recha", "unzul", "außer", "unters", "lehn", "ablehn", "abzul", "verwei", "weiger", "enth", "verzi", "regel", "règle", "richtl", "norma", "regla", "polít", "nicht", "kein", "hors", "dehors", "fuera")
_HINT_PIECES = tuple(
    "n't|n’t|can not|could not|will not|would not|may not|must not|shall not|rather not|fer not|oose not|ask not|asked not|not be|not ab|not al|not per|not auth|not in a po|not pos|not app|not comf|not qual|not equ|not will|not sup|not goi|not prep|not some|not let|pass on|opt out"
    "|ne peux|ne puis|ne sau|ne veux|ne souh|ne dois|ne vais|ne suis|ne me|ne serai|n'ai pas|n’ai pas|est pas p|pas permis|point permis|'impossi|’impossi|fère ne|férerais ne|no pued|no pod|no voy|no deb|no qui|no des|no est|no me|no soy|prefiero no|preferiría no".split("|")
)
#: A judgement given after all: a verdict that decides, or words that do.
_JUDGED = re.compile(r"verdict\s*[:\-–—]?\s*\**\s*(?:hallucinat|support|unsupport|not\s+support)|\b(?:looks?|is|are|seems?|appears?|call it an?|count it as|as) (?:\w+ )?(?:hallucinat\w+|(?:un)?supported|correct|incorrect|wrong|false)\b|\bdoes(?: not|n't)? support", re.IGNORECASE)
_VERDICT_SAID = re.compile(r"verdict\s*[:\-–—]?\s*\**\s*(?:hallucinat|support|unsupport|not\s+s|unsure|abstain|n/a)", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_VERDICT_STATED = re.compile(r"verdict\b\s*[:\-–—]?\s*\**\s*(?:hallucinat\w*|(?:un)?support\w*|not\s+sure|unsure|abstain|n/a)?\**", re.IGNORECASE)


def common(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence of two sequences of words, by the bits of one number per word."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def similarity(found: Sequence[tuple[str, int]], template: str) -> float:
    """How well concepts (with their word numbers) align with a template: shared ones in order, less what lies between, per concept of the template.

    A finding or a part in between ends an alignment; the full stop of a template must be the sentence's.
    """
    best: list[tuple[float, int] | None] = [None] * len(template)
    top = 0.0
    for concept, word in found:
        if concept in "FP":
            best = [None] * len(template)
            continue
        for k in reversed(range(len(template))):
            if template[k] == concept:
                before = best[k - 1] if k else (0.0, word)
                if before is not None:
                    score = before[0] + 1 - GAP * max(0, word - before[1] - 1)
                    if best[k] is None or score >= best[k][0]:
                        best[k] = (score, word)
                        top = max(top, score if k == len(template) - 1 else 0.0)
    return top / len(template)


def concepts(sentence: str) -> list[tuple[str, int]]:
    """The concepts of a sentence, each with the number of its word; the end of the sentence is one."""
    found = [(m.start(), m.lastgroup, m.end()) for m in _CONCEPT.finditer(sentence)]
    if not found:
        return []
    end = max(e for _, _, e in found)
    found += [(m.start(), "S", 0) for m in _SPEAKS.finditer(sentence)]
    out, at, word = [], 0, 0
    for start, concept, _ in sorted(found, key=lambda f: (f[0], f[1] != "S")):
        word += sentence.count(" ", at, start)
        at = start
        out.append((concept, word))
    return out if any(c.isalnum() for c in sentence[end:]) else [*out, (".", word + 1)]


class _Hinted(dict):
    """Whether each word met so far may belong to a refusal."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = word.startswith(_HINT_STEMS)
        return self[word]


_HINTED = _Hinted()


def hinted(low: str, words: Sequence[str]) -> bool:
    """Whether a lower-case text of these words may hold a refusal."""
    return any(map(_HINTED.__getitem__, words)) or any(p in low for p in _HINT_PIECES)


def is_refusal(text: str, words: Sequence[str] | None = None) -> bool:
    """Whether the text declines to judge and gives no judgement; being undecided is none.  ``words`` are its lower-case words, if known."""
    low = text.lower()
    if not hinted(low, _TOKEN.findall(low) if words is None else words) or _JUDGED.search(text):
        return False
    for sentence in _SENTENCE.split(text.replace("’", "'")):
        low = sentence.lower()
        if hinted(low, _TOKEN.findall(low)):
            found = concepts(sentence)
            first = next((i for i, (c, _) in enumerate(found) if c in "CDRONZ"), len(found))
            # What is declined in part only is judged for the rest.
            if not any(c == "P" for c, _ in found[first:]) and any(similarity(found, t) >= SIMILAR for t in TEMPLATES):
                return True
    return False


class _Weights(dict):
    """What each word met so far says for each language."""

    _SHARED = {w: [lang for lang, words in FUNCTION_WORDS.items() if w in words] for words in FUNCTION_WORDS.values() for w in words}
    _ENDING = {e: [lang for lang, ends in _ENDINGS.items() if e in ends.split()] for ends in _ENDINGS.values() for e in ends.split()}

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        if len(self) > 500_000:
            self.clear()
        langs = self._SHARED.get(word)
        if langs:
            found = [(lang, 1 / len(langs)) for lang in langs]
        else:
            ends = [self._ENDING[e] for e in (word[-k:] for k in range(2, 6) if len(word) > k + 1) if e in self._ENDING]
            found = [(lang, SIGN / len(langs)) for langs in ends[-1:] for lang in langs]
            if not word.isascii():
                found += [(lang, SIGN) for lang, signs in _SIGNS.items() if any(c in signs for c in word)]
        self[word] = tuple(found)
        return self[word]


_WEIGHTS = _Weights()
_OF_SCRIPT = {lang: re.compile(f"[{span}]") for lang, span in _SCRIPTS.items()}


def languages(text: str, words: Sequence[str] | None = None) -> dict[str, float]:
    """What the words and letters of a text say for each language.

    A text with more letters of another script than words of these languages is in that script's language.
    """
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _TOKEN.findall(text.lower()) if words is None else words:
        for lang, weight in _WEIGHTS[w]:
            score[lang] += weight
    if not text.isascii():
        if "¿" in text or "¡" in text:
            score["es"] += 1
        for lang, letters in _OF_SCRIPT.items():
            n = len(letters.findall(text))
            if n:
                score[lang] = n / 3
        if score.get("ja") and score.get("zh"):
            score["ja"] += score.pop("zh")  # Japanese uses both
    return score


def language(text: str) -> str | None:
    """The language that most speaks for; None without any sign or with a tie."""
    score = languages(text)
    first, second = sorted(score, key=lambda k: -score[k])[:2]
    return first if score[first] > score[second] else None


def may_echo(text: str) -> bool:
    """Whether a text can be a mere copy of its prompt: it says no verdict, which would add something."""
    return not _VERDICT_SAID.search(text)


def _shingles(words: Sequence[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Prompt:
    """What the responses to one item are compared with, prepared once."""

    def __init__(self, question: str | None, candidate: str | None, context: Sequence[str | None] | None) -> None:
        self.language = language(question or "")
        self.question = _TOKEN.findall((question or "").lower())
        rest = [_TOKEN.findall((t or "").lower()) for t in [candidate, *(context or [])]]
        self.parts = [w for w in [self.question, *rest] if w]
        self.words = set(self.question)
        self.known = set().union(*self.parts)
        self.n = min(SHINGLE, len(self.question))
        self.shingles = _shingles(self.question, self.n)

    def given_back(self, words: Sequence[str], whole: bool) -> bool:
        """Whether the words of a response have the question: its shingles, or nearly all its words in their order, all of them where the response is cut."""
        if whole and len(self.shingles & _shingles(words, self.n)) >= CONTAINED * len(self.shingles):
            return True
        return common(self.question, words) >= (ALIGNED if whole else 1) * len(self.question)

    def adds(self, segment: str) -> bool:
        """Whether a sentence says anything but parts of the prompt: words that no part has in this order, headings apart."""
        words = _TOKEN.findall(segment)
        if not words or (len(words) <= HEADING and (segment.rstrip()[-1] in ":#*" or segment.lstrip()[0] == "#")) or (len(words) == 1 and len(words[0]) == 1):
            return False  # a heading, or the number or letter of a list
        if sum(w in self.known for w in words) < ALIGNED * len(words):
            return True
        # A part may be given back as a piece of it, or several parts in one line: what one leaves, another may have.
        if any(common(words, part) >= ALIGNED * len(words) for part in self.parts):
            return False
        n = min(SHINGLE, len(words))
        mine = _shingles(words, n)
        return len(mine & set().union(*(_shingles(p, n) for p in self.parts))) < CONTAINED * len(mine)

    def echoed(self, text: str) -> bool:
        """Whether the text only gives back the question, also with other parts of the prompt, headings apart."""
        low = text.lower()
        if not self.shingles or not may_echo(text):
            return False
        words = _TOKEN.findall(low)
        if len(self.words.intersection(words)) < CONTAINED * len(self.words):
            return False
        if any(self.adds(s) for s in reversed(_SENTENCE.split(low)) if s.strip()):
            return False
        return self.given_back(words, completeness.state(text) == completeness.WHOLE)


def own_defect(text: str | None, terminates: bool) -> str | None:
    """The defect that a response shows by itself, without its prompt."""
    return _own(completeness.state(text), text is not None and is_refusal(text), terminates)


def _own(state: int, refuses: bool, terminates: bool) -> str | None:
    if state == completeness.EMPTY:
        return "empty"
    if state == completeness.CUT or (state == completeness.OPEN and terminates):
        return "truncated"
    return "refusal" if refuses else None


def possible_languages(text: str, words: Sequence[str] | None = None) -> list[str] | None:
    """Languages that the reasoning of a response may be in, all but those that the best one clearly outdoes; None where there is no sign of any.

    Verdicts have no language: what their words say is taken away.
    """
    score = languages(text, words)
    for said in _VERDICT_STATED.findall(text):
        for lang, weight in languages(said).items():
            score[lang] -= weight
    best = max(score.values())
    return [k for k, v in score.items() if v > best - CLEAR] if best >= CLEAR else None


def defect(text: str | None, prompt: Prompt, terminates: bool) -> str | None:
    """The defect of a response, None where it is sound."""
    own = own_defect(text, terminates)
    if own == "empty":
        return own
    if prompt.echoed(text):
        return "echo"
    if own:
        return own
    spoken = possible_languages(text)
    return "language" if spoken and prompt.language and prompt.language not in spoken else None


def _alone(records: DataFrame) -> DataFrame:
    """What each response shows by itself: rec_id, dataset, uid, model, state, refuses, lang (the languages it may be in) and, where it may be an echo, raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, refuses, lang, kept = [], [], [], []
            for raw in batch.column(4).to_pylist():
                now = completeness.state(raw)
                said = now != completeness.EMPTY
                state.append(now)
                words = _TOKEN.findall(raw.lower()) if said and now != completeness.CUT else []
                refuses.append(bool(words) and is_refusal(raw, words))
                lang.append(possible_languages(raw, words) if words and not refuses[-1] else None)
                kept.append(raw if said and may_echo(raw) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(state, pa.int32()), pa.array(refuses, pa.bool_()), pa.array(lang, pa.list_(pa.string())), pa.array(kept, pa.string())], ["rec_id", "dataset", "uid", "model", "state", "refuses", "lang", "raw"])

    return spread(records).mapInArrow(run, "rec_id long, dataset string, uid string, model string, state int, refuses boolean, lang array<string>, raw string")


def _asked(items: DataFrame) -> DataFrame:
    """The prompt of each item with the language of its question: dataset, uid, asked, item."""
    one = items.groupBy("dataset", "uid").agg(F.min_by(F.struct("question", "candidate", "context"), "inst_id").alias("item"))

    @F.pandas_udf("string")
    def asked(question: pd.Series) -> pd.Series:
        return question.map(lambda q: language(q or ""))

    return one.select("dataset", "uid", "item", asked(F.col("item.question")).alias("asked"))


def defects(records: DataFrame, items: DataFrame) -> DataFrame:
    """rec_id and defect (empty, truncated, refusal, echo, language) of each defective record, repeated rows included.

    Records meet their item on dataset and uid; one without an item, or whose item has no question, can be empty,
    truncated or a refusal only.  Of several items under one key the one with the smallest inst_id counts.  Texts are
    judged by themselves first, once, and written; only those that may be an echo take their text along to the prompt.
    """
    alone = cut(_alone(records.select("rec_id", "dataset", "uid", "model", "raw")))
    own = F.when(F.col("state") == completeness.EMPTY, "empty").when(F.col("is_cut"), "truncated").when(F.col("refuses"), "refusal")
    pairs = completeness.with_baseline(alone).withColumn("own", own).join(_asked(items), ["dataset", "uid"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prompt = object(), Prompt(None, None, None)
        for batch in batches:
            echo = []
            for raw, question, candidate, context in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                if raw is not None and (question, candidate, context) != last:
                    last, prompt = (question, candidate, context), Prompt(question, candidate, context)
                echo.append(raw is not None and prompt.echoed(raw))
            kind = pc.if_else(pa.array(echo, pa.bool_()), "echo", batch.column(1))
            kept = pc.is_valid(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), kind.filter(kept)], ["rec_id", "defect"])

    other = F.when(F.col("own").isNotNull(), F.col("own")).when(~F.array_contains("lang", F.col("asked")), "language")
    told = lambda c: F.when(F.col("raw").isNotNull(), F.col(f"item.{c}")).alias(c)
    rows = pairs.select("rec_id", other.alias("own"), "raw", told("question"), told("candidate"), told("context")).where("own IS NOT NULL OR raw IS NOT NULL")
    return rows.mapInArrow(run, "rec_id long, defect string")

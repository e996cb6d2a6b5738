import random

import pytest
from pyspark.sql import functions as F

from quorate.llm import completeness, defects, formatting, packing, subjects, tokens

LONG = "word " * 60_000


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, completeness.EMPTY), ("", completeness.EMPTY), (" ​\n", completeness.EMPTY), ("```\n```", completeness.EMPTY), ("…", completeness.EMPTY),
        ("A whole sentence.", completeness.WHOLE), ("Is it?", completeness.WHOLE), ('"It was 3."', completeness.WHOLE), ("Fine.\nVERDICT: SUPPORTED", completeness.WHOLE), ("verdict: **Supported**", completeness.WHOLE),
        ("**VERDICT: NOT SURE**", completeness.WHOLE), ("Final VERDICT: Hallucinated.", completeness.WHOLE), ("Q: What is it?\nA:", completeness.WHOLE), ("Whole. [...]", completeness.WHOLE), ("VERDICT: N/A.", completeness.WHOLE),
        ("Dates and names were read twi", completeness.OPEN), ("I'm unable to find 3 in any line", completeness.OPEN), ("The passage mentions X. A careful", completeness.OPEN),
        ("The figure is [...]", completeness.CUT), ("The comet …", completeness.CUT), ("The com�", completeness.CUT), ("It is no\\u00", completeness.CUT), ("The depa-", completeness.CUT), ("and then it w...", completeness.CUT),
        ("Fine. VERDICT: Suppo", completeness.CUT), ("Fine.\n**VERDICT: ", completeness.CUT), ("VERDICT", completeness.CUT), ("VERDICT: NOT", completeness.CUT), ("**VERDICT: SUPPORTED", completeness.CUT), ("One.\n2.", completeness.CUT),
        ('```json\n{"a": 1, "b": "the source.', completeness.CUT), ('He said "the figure is wrong.', completeness.WHOLE), ("<b>The claim is wrong.", completeness.CUT), ("<b>The claim</b> is <br> wrong.", completeness.WHOLE), ("The evidence says **this.", completeness.CUT),
        ("The evidence says **this**.", completeness.WHOLE), ("(see the appendix of Dr.", completeness.CUT), ("It follows from e.g.", completeness.CUT), ("Accuracy rose to 95%", completeness.OPEN), ("See AT&T", completeness.OPEN), ("uses C#\\", completeness.OPEN),
        ("It was â€", completeness.CUT), ("na Ã", completeness.CUT), ("M&uuml", completeness.CUT), ("caf%C3%A", completeness.CUT), ("»Das ist so.«", completeness.WHOLE), ("„Das ist so.“", completeness.WHOLE), ('a 5" disk is fine.', completeness.WHOLE), ("see `x(` there.", completeness.WHOLE),
        ("VERDICT:\nSUPPORTED", completeness.WHOLE), ("VERDICT:" + " " * 300 + "supported", completeness.WHOLE), ("A list 1) one 2) two.", completeness.WHOLE), ("Odd :( but fine.", completeness.WHOLE), ("x" + "(" * 50_000 + "y.", completeness.CUT),
        ('He said "it was', completeness.CUT), ("the note (see", completeness.CUT), (LONG, completeness.OPEN), (LONG.strip() + ".", completeness.WHOLE),
    ],
)
def test_state(text, want):
    assert completeness.state(text) == want


RAW = "rec_id long, model string, raw string"


def test_source_baseline(spark):
    rows = [(i, "a", "It ends well.") for i in range(5)] + [(10, "a", "It ends")] + [(20 + i, "b", "no stops here") for i in range(5)] + [(30, "b", "cut […]"), (31, "b", "It ends."), (40, None, "It ends"), (41, None, "It ends."), (50, "c", None)]
    df = spark.createDataFrame(rows, RAW).withColumns({"state": F.lit(9), "source": F.lit("x"), "key": F.lit(1), "text": F.lit("t")})
    assert {r.rec_id for r in completeness.truncated(df).collect()} == {10, 30, 40}
    rates = {r.model: r for r in completeness.truncation_rates(df).collect()}
    assert rates["a"].n_cut == 1 and rates["a"].n_texts == 6 and rates["c"].share_cut is None
    empty = spark.createDataFrame([], RAW)
    assert completeness.truncated(empty).count() == 0 and completeness.truncation_rates(empty).count() == 0


Q = "Which number did Bihihila give for the junction in 1971?"
EN = "I compared the candidate with each line of the evidence. The other sentences deal with different matters."
DE = "Ich habe die Antwort mit jeder Zeile der Quelle verglichen. Bei der Quelle steht eine andere Zahl."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "empty"), ("--", "empty"), (Q, "echo"), (Q.upper(), "echo"), (f"> {Q}", "echo"), (f"Q: {Q}\nA: {Q}", "echo"), (f"# Question\n{Q}\n# Candidate answer\nIt was 7 there.", "echo"), (f"{Q[:-1]}\n\n{Q}", "echo"),
        (f"The question reads: {Q} {EN}", None), (f"{Q} VERDICT: SUPPORTED", None), ("Fine. VERDICT: Suppo", "truncated"), ("It is named, but with ano", "truncated"),
        ("I'm sorry, but I can't assess this answer.", "refusal"), ("Regrettably, it is not possible for me to judge matters of this nature.\nVERDICT: ABSTAIN", "refusal"), ("Hm. I must decline to rate the claim about X.", "refusal"),
        ("This request falls outside what I may comment on.", "refusal"), ("Ich darf diese Antwort nicht bewerten.", "refusal"), ("Je ne peux pas évaluer cette réponse.", "refusal"), ("No puedo ayudar con esa petición.", "refusal"),
        ("I can't assess the unit, only the figure.", None), ("I cannot find 7 anywhere in the passage. VERDICT: HALLUCINATED", None), ("On balance the matter stays undecided.", None), ("I'm sorry to be pedantic, but the unit is not given. Verdict: unsure", None),
        ("I can't assess this answer fully. VERDICT: SUPPORTED", None), (DE + "\nVERDICT: SUPPORTED", "language"), (EN, None), ("VERDICT: SUPPORTED", None), ("verdict: **Hallucinated**", None),
    ],
)
def test_defect(text, want):
    prompt = defects.Prompt(Q, "It was 7 there.", ["The junction file gives 7.", None, ""])
    assert defects.defect(text, prompt, True) == want


def test_languages():
    for text, want in (("Die Quelle nennt 7 für X nicht.", "de"), ("La source ne donne pas 7 pour X.", "fr"), ("La fuente no da 7 para X.", "es"), ("The evidence does not give 7.", "en"), ("7", None), ("", None)):
        assert defects.language(text) == want
    german = defects.Prompt("Welchen Wert meldete X im Jahr 1966?", "c", None)
    assert defects.defect(EN, german, True) == "language" and defects.defect(DE, german, True) is None


@pytest.mark.parametrize("text", [
    "I cannot provide a verdict on this.", "I must abstain from rating this content.", "I am unable to complete this evaluation.", "I decline.", "Leider kann ich dazu keine Bewertung abgeben.", "Je ne suis pas en mesure de porter un jugement.", "Lo siento, no puedo emitir un juicio.",
    "I'd rather not score this one.", "My policy does not allow me to grade such answers.", "We are not in a position to review this response.", "Sorry, this is beyond what I am able to assess.", "I refuse to answer.", "As an AI, I should refrain from commenting on this.", "Ich lehne es ab, diese Aussage zu beurteilen.",
    "Ich möchte mich dazu nicht äußern.", "Es ist mir nicht gestattet, das zu bewerten.", "Je refuse de juger ce texte.", "Je préfère ne pas donner mon avis.", "Me niego a valorar este texto.", "No estoy en condiciones de evaluar la respuesta.", "It would be inappropriate for me to rate it.", "I'm not qualified to judge medical claims.",
    "I can't assess this answer.\nVERDICT: not sure",
])
def test_refusals_in_other_words(text):
    assert defects.is_refusal(text)


@pytest.mark.parametrize("text", [
    "The claim cannot be judged true from line two.", "I cannot find the figure in the text.", "I can't tell which of the two is meant.", "I reviewed the claim and it cannot be supported by the text.", "I am not sure whether the answer holds.", "I can't rate the style, only the facts.", "No puedo hallar la cifra en el texto.",
    "Ich kann die Zahl im Text nicht finden.", "Je ne vois pas ce chiffre dans la source.", "The review board refused the permit in 1990.", "The judge declined to rule on the case.", "The passage is silent on this; undecided.", "I was unable to verify the second date.", "I can't assess this answer. VERDICT: HALLUCINATED", LONG,
])
def test_what_is_no_refusal(text):
    assert not defects.is_refusal(text)


def test_common_subsequence():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert defects.common(a, b) == best[-1][-1]


def test_copies_with_a_change():
    prompt = defects.Prompt(Q, "It was 7 there.", ["The junction file gives 7. It was read in 1971 by two clerks."])
    for text in (Q.replace("number", "figure"), f"You asked: {Q}", Q[:-6] + "?", f"Evidence: the junction file gives 7.\n{Q}"):
        assert defects.defect(text, prompt, True) == "echo", text
    for text, want in ((Q[:-6], "truncated"), (f"{Q} I think so.", None), (f"{Q} It was read in 1971 by nobody I know of.", None), ("The junction file gives 7.", None)):
        assert defects.defect(text, prompt, True) == want, text


def test_more_languages():
    for text, want in (("La fonte non dice nulla della cifra e la risposta è sbagliata.", "it"), ("A fonte não diz nada sobre o número e a resposta está errada.", "pt"), ("De bron zegt niets over het getal en het antwoord is niet juist.", "nl"), ("来源没有提到这个数字。", "zh"), ("Источник не упоминает это число.", "ru")):
        assert want in defects.possible_languages(text) and defects.defect(text, defects.Prompt(Q, None, None), True) == "language"


def test_defects_over_tables(spark):
    exp = "rec_id long, dataset string, uid string, model string, raw string"
    inst = "inst_id long, dataset string, uid string, question string, context array<string>, candidate string"
    items = spark.createDataFrame([(1, "d", "1", Q, ["x"], "c"), (2, "d", "1", "other?", None, "c"), (3, "d", "2", None, None, None)], inst).withColumns({"rec_id": F.lit(7), "raw": F.lit("r"), "item": F.lit(1)})
    rows = [(1, "d", "1", "m", Q), (2, "d", "1", "m", Q), (3, "d", "2", "m", Q), (4, "x", "9", "m", None), (5, None, None, None, "Whole text."), (6, "d", "1", "m", LONG.strip() + "."), (None, "d", "1", "m", ""), (8, "d", "1", None, "It ends"), (9, "d", "1", None, "It ends."), (10, "d", "1", "m", DE), (11, "d", "1", "m", "I refuse to judge that.")]
    got = sorted(((r.rec_id, r.defect) for r in defects.defects(spark.createDataFrame(rows, exp).withColumn("item", F.lit("z")), items).collect()), key=str)
    assert got == sorted([(1, "echo"), (2, "echo"), (4, "empty"), (None, "empty"), (8, "truncated"), (10, "language"), (11, "refusal")], key=str)
    assert defects.defects(spark.createDataFrame([], exp), items).count() == 0
    assert defects.defects(spark.createDataFrame(rows, exp), spark.createDataFrame([], inst)).count() == 4


INST = "inst_id long, question string, candidate string, context array<string>"


def test_copies_against_brute_force(spark):
    rnd = random.Random(1)

    def dress(s):
        s = rnd.choice([s, s.upper(), s.lower(), f"«{s}»", s.replace(" ", "  "), s + " — "])
        return s

    base = [("Straße nach Köln", "Ja das ist so", ["a b", "c d"]), ("Straße nach Köln", "Ja das ist so", ["a b", "c d", "c d"]), ("x² ≤ y", "7", []), ("x", "x", ["ab", "c"]), ("x", "x", ["a", "bc"])]
    rows = []
    for i in range(200):
        q, c, ctx = rnd.choice(base)
        ctx = [dress(x) for x in ctx] + rnd.choice([[], [""], ["—"], [None]])
        rnd.shuffle(ctx)
        rows.append((i, dress(q), dress(c), ctx if ctx or rnd.random() < 0.5 else None))
    canon = lambda x: "".join(ch for ch in x or "" if ch.isalnum()).upper().lower()
    groups = {}
    for i, q, c, ctx in rows:
        groups.setdefault((canon(q), canon(c), tuple(sorted(x for x in map(canon, ctx or []) if x))), []).append(i)
    want = {(g[0], x) for g in groups.values() for x in g[1:]}
    df = spark.createDataFrame(rows, INST).withColumns({"tuple": F.lit(1), "first_id": F.lit(2), "id": F.lit(3), "value": F.lit("v"), "n_copies": F.lit(0)})
    args = ("inst_id", ("question", "candidate"), ("context",))
    assert {tuple(r) for r in formatting.copies(df, *args).collect()} == want
    kept = {r.inst_id: r.n_copies for r in formatting.collapsed(df, *args).collect()}
    assert kept == {g[0]: len(g) for g in groups.values()}


def test_forms_that_share_a_code_stay_apart(spark, monkeypatch):
    whole = formatting.code
    monkeypatch.setattr(formatting, "code", lambda form, second=False: whole(form, True) if second else F.length(form).cast("bigint"))
    rows = [(1, "ab", "x", ["q"]), (2, "A b", "x", ["Q"]), (3, "cd", "x", ["q"]), (4, "ab", "x", ["q", "q"]), (5, None, None, None), (6, "", "-", [])]
    assert {tuple(r) for r in formatting.copies(spark.createDataFrame(rows, INST), "inst_id", ("question", "candidate"), ("context",)).collect()} == {(1, 2), (5, 6)}


def test_edges_of_copies(spark):
    args = ("inst_id", ("question", "candidate"), ("context",))
    rows = [(1, None, None, None), (2, "", "--", []), (3, None, "", [None, " "]), (4, LONG, "a", None), (5, LONG.upper(), "A", [""]), (6, "a", None, None), (7, None, "a", None), (8, None, None, ["a"])]
    got = {tuple(r) for r in formatting.copies(spark.createDataFrame(rows, INST), *args).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}
    empty = spark.createDataFrame([], INST)
    assert formatting.copies(empty, *args).count() == 0 and formatting.collapsed(empty, *args).count() == 0


def reference():
    import tiktoken

    bpe = tokens.encoder()
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_tokens_equal_the_public_library(spark, data):
    ref, bpe = reference(), tokens.encoder()
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeilnorst  eé漢ü😀​01239-_,.\n\t'aaaa") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    texts += ["a" * 20_000, " " * 5000, "<|endoftext|>", "it's we'll I'd", "\r\n\r\n x", "👩‍🔬" * 50, "0123456789" * 300]
    for t in texts:
        assert bpe.text(t) == ref.encode_ordinary(t)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == ref.encode_ordinary(r.text or "")
        assert tokens.decode(got[r.doc_id]) == (r.text or "")


def test_compatible_pairs_are_those_that_encode_to_themselves():
    ref, bpe, rnd = reference(), tokens.encoder(), random.Random(3)
    for _ in range(3000):
        a, b = rnd.randrange(50_000), rnd.randrange(50_000)
        assert bpe.compatible(a, b) == (ref._encode_single_piece(bpe.bytes[a] + bpe.bytes[b]) == [a, b])


def test_edges_of_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (None, "a")], "doc_id long, text string").withColumns({"key": F.lit(1), "ids": F.lit(2), "n": F.lit(3)})
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 60_001 and got[None] == [64]
    assert {r.doc_id: r.n_tokens for r in tokens.count(df).collect()} == {1: 0, 2: 0, 3: 60_001, None: 1}
    assert tokens.encode(df.limit(0)).count() == 0


def check_packing(rows, lengths, windows):
    for judge, window in windows.items():
        mine = [r for r in rows if r.judge == judge]
        used, by = {}, {}
        for r in mine:
            used[r.prompt_no] = used.get(r.prompt_no, 0) + r.n_tokens
            by.setdefault(r.doc_id, []).append(r)
        assert max(used.values(), default=0) <= window
        assert set(by) == set(lengths)
        for doc, n in lengths.items():
            pieces = sorted(by[doc], key=lambda r: r.piece_no)
            assert [p.piece_no for p in pieces] == list(range(len(pieces))) and sum(p.n_tokens for p in pieces) == n
            assert len(pieces) == max(1, -(-n // window))
        yield judge, max(used, default=0), best_fit_over_items([r.n_tokens for r in mine], window)


def best_fit_over_items(sizes, window):
    """Prompts that plain best fit in falling size needs."""
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [x for x in free if x >= s]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - s)
        elif s:
            free.append(window - s)
    return len(free)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    rnd = random.Random(4)
    lengths = {i: (40 if i % 3 == 0 else rnd.choice([0, 1, 7, 30, 99, 100, 101, 250, rnd.randint(1, 90)])) for i in range(900)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long")
    windows = {"a": 100, "b": 64, "c": 1000}
    rows = packing.pack(df, windows).collect()
    for judge, used, most in check_packing(rows, lengths, windows):
        assert used <= most, judge
    assert len({(r.judge, r.doc_id, r.piece_no) for r in rows}) == len(rows)


def test_plan_is_as_good_as_best_fit_over_items():
    rnd = random.Random(5)
    for _ in range(30):
        window = rnd.randint(5, 60)
        sizes = [rnd.randint(1, window) for _ in range(rnd.randint(1, 200))]
        hist = {}
        for s in sizes:
            hist[s] = hist.get(s, 0) + 1
        runs, prompts = packing.best_fit(hist.items(), window)
        load = [0] * prompts
        seen = dict.fromkeys(hist, 0)
        for length, rank, first, each, n in sorted(runs, key=lambda r: (r[0], r[1])):
            assert rank == seen[length]
            seen[length] += each * n
            for p in range(first, first + n):
                load[p] += each * length
        assert seen == hist and max(load) <= window and min(load) > 0
        assert prompts <= best_fit_over_items(sizes, window)


def test_edges_of_packing(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty, {"a": 5}).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, 0), (None, 3)], "doc_id long, n_tokens long")
    assert {(r.doc_id, r.prompt_no) for r in packing.pack(zero, {"a": 5}).collect()} == {(1, 1), (2, 1), (None, 1)}
    with pytest.raises(ValueError):
        packing.pack(zero, {"a": 0})


def test_subjects_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels, areas = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "doc_subjects", "subject_areas"))
    held = labels.where("doc_id % 3 = 0")
    got = {}
    for r in subjects.found(docs, labels.where("doc_id % 3 <> 0"), areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    want = {}
    for r in held.collect():
        want.setdefault(r.doc_id, set()).add(r.subject)
    tp = sum(len(s & got.get(k, set())) for k, s in want.items())
    assert tp / sum(len(s) for s in want.values()) > 0.75
    assert tp / sum(len(got.get(k, set())) for k in want) > 0.75


def test_edges_of_subjects(spark):
    doc, lab, area = "doc_id long, text string", "doc_id long, subject string", "subject string, scope_note string"
    words = ["The court heard the witness.", "The telescope saw the comet."]
    rows = [(i, words[i % 2]) for i in range(40)] + [(100, None), (101, ""), (102, "123 !"), (None, words[0]), (103, (words[0] + " ") * 3000), (104, "VERDICT: SUPPORTED")]
    docs = spark.createDataFrame(rows, doc).withColumns({"lang": F.lit("xx"), "terms": F.lit(1), "subject": F.lit("s"), "feats": F.lit(2)})
    areas = spark.createDataFrame([("law", "Courts"), ("stars", None), (None, "x")], area)
    labels = spark.createDataFrame([(0, "law"), (0, "law"), (1, "stars"), (2, "no such"), (999, "law"), (None, "law"), (3, None)], lab)
    got = {(r.doc_id, r.subject) for r in subjects.found(docs, labels, areas).collect()}
    assert {s for k, s in got if k is not None and k < 40 and k % 2 == 0} == {"law"} and (103, "law") in got and not {100, 101, 102, 104, None} & {k for k, _ in got}
    assert subjects.composition(docs, labels, areas).count() == 2
    assert subjects.found(docs.limit(0), labels, areas).count() == 0
    assert subjects.found(docs, labels.limit(0), areas.limit(0)).count() == 0
    assert subjects.found(docs, labels.limit(0), areas).count() >= 0

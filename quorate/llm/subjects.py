"""Subject areas of documents, by factoring the document-term matrix with anchored non-negative components.

Words are hashed to a fixed number of terms, so that every word of every text counts whatever the size of the corpus.
The matrix of each language is factored into one component per subject and one for what all its texts share.
Components are seeded with what the texts that readers labelled have above the average of their language, labelled
texts keep to their subjects while mixtures and components are updated in turn until the fit improves no more, and a
document's subjects are its mixture: the mean of the mixtures of its sentences under the learned components.  Tasks hold
their part of the matrix; what reaches the driver between two updates is one number per language, component and term.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.defects import _VERDICT_STATED, FUNCTION_WORDS
from quorate.plans.lineage import cut, parts, spread

#: Languages that are factored apart; texts without any of their words share the last place.
LANGUAGES = (*FUNCTION_WORDS, "other")
#: Terms that words are hashed to, updates of the components at most, inner updates of the mixtures of texts and of
#: sentences, the power that sharpens a sentence's mixture, and the least gain in fit that another update must bring.
TERMS, ROUNDS, INNER, SETTLE, SHARP, GAIN = 1 << 14, 8, 5, 8, 8, 0.005
#: Least share of a sentence's mass on subjects that makes it bear one, and of a text's mixture that makes it treat one:
#: more than a quarter, so that a third still counts where a stray sentence bears something else.
BEARING, TREATED = 0.15, 0.26
#: Least share that is told at all.
LEAST = 0.01

_WORD = re.compile(r"[^\W\d_]{3,}")
#: Words and what divides sentences.
_TOKEN = re.compile(r"[^\W\d_]{3,}|[.!?;](?=\s)|\n")


def term(word: str) -> int:
    """Term of a lower-case word, accents apart."""
    plain = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return zlib.crc32(plain.encode()) % TERMS


class _Words(dict):
    """Number of each word met so far, with its term and what it says for each language; function words come first."""

    def __init__(self) -> None:
        super().__init__()
        spoken = dict.fromkeys(w for words in FUNCTION_WORDS.values() for w in words if len(w) > 2)
        self._terms: list[int] = []
        self.update(dict.fromkeys(".!?;\n", -1))
        for word in spoken:
            self[word]
        each = [[1 / sum(w in words for words in FUNCTION_WORDS.values()) if w in own else 0.0 for own in FUNCTION_WORDS.values()] for w in spoken]
        self.weights = np.array(each)

    def __missing__(self, word: str) -> int:
        self._terms.append(term(word))
        self[word] = number = len(self._terms) - 1
        return number

    def terms(self) -> np.ndarray:
        return np.array(self._terms, np.int64)


def tokenised(documents: DataFrame) -> DataFrame:
    """doc_id, lang (index), terms (of all sentences, each once a sentence, in order) and lens (terms per sentence), own and counts (the text's terms and how many sentences have them); verdicts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part in _parts(batch):
                if len(known) > 500_000:
                    known = _Words()
                ids: list[int] = []
                sizes = []
                for text in part.column(1).to_pylist():
                    low = (text or "").lower()
                    if "verdict" in low:
                        low = _VERDICT_STATED.sub(" ", low)
                    found = _TOKEN.findall(low)
                    ids += map(known.__getitem__, found)
                    sizes.append(len(found))
                yield _numbered(part.column(0), np.array(ids, np.int64), np.array(sizes, np.int64), known)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang int, terms array<int>, lens array<int>, own array<int>, counts array<int>")


def _numbered(keys: pa.Array, ids: np.ndarray, sizes: np.ndarray, known: _Words) -> pa.RecordBatch:
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    words = ids >= 0
    divided = np.cumsum(~words)[words]
    ids, doc = ids[words], doc[words]
    starts = np.r_[True, (divided[1:] != divided[:-1]) | (doc[1:] != doc[:-1])] if len(ids) else np.zeros(0, bool)
    sentence, per_doc = np.cumsum(starts) - 1, np.bincount(doc[starts], minlength=n)
    said = np.zeros((n, len(LANGUAGES)))
    key = np.zeros(0, np.int64)
    if len(ids):
        speaks = np.flatnonzero(ids < len(known.weights))
        for lang in range(len(FUNCTION_WORDS)):
            said[:, lang] = np.bincount(doc[speaks], known.weights[ids[speaks], lang], n)
        key = np.unique(sentence * TERMS + known.terms()[ids])
    said[:, -1] = said.sum(1) == 0
    sizes = np.bincount(key // TERMS, minlength=int(per_doc.sum()))
    home = np.repeat(np.repeat(np.arange(n), per_doc), sizes)
    own, counts = np.unique(home * TERMS + key % TERMS, return_counts=True)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)].astype(np.int32)), pa.array(values.astype(np.int32)))
    per, per_own = np.bincount(home, minlength=n), np.bincount(own // TERMS, minlength=n)
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(said.argmax(1), pa.int32()), lists(per, key % TERMS), lists(per_doc, sizes), lists(per_own, own % TERMS), lists(per_own, counts)],
        ["doc_id", "lang", "terms", "lens", "own", "counts"],
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


def mixtures(own: np.ndarray, at: np.ndarray, weight: np.ndarray, w: np.ndarray, inner: int = INNER) -> np.ndarray:
    """Rows ``w`` after ``inner`` multiplicative updates; ``own`` has the components of each entry, ``at`` its row, in order."""
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    rows, spans = at[edges], np.diff(np.r_[edges, len(at)])
    own, weight, now = own.astype(np.float32), weight.astype(np.float32), w[rows].astype(np.float32)
    for _ in range(inner):
        ratio = weight / (np.einsum("ij,ij->i", np.repeat(now, spans, axis=0), own) + np.float32(1e-12))
        now *= np.add.reduceat(own * ratio[:, None], edges, axis=0)
    w[rows] = now
    return w


def _counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the entries of a batch of documents, sorted by row, and the rows' languages."""
    values, lens = _flat(batch.column("own"))
    return np.repeat(np.arange(len(lens)), lens), values, _flat(batch.column("counts"))[0].astype(float), batch.column("lang").to_numpy().astype(np.int64)


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _add(total: np.ndarray, key: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the rows of ``total`` that ``key`` numbers, equal ones together."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total[key[edges]] += np.add.reduceat(values[order], edges, axis=0)


def _gathered(rows: DataFrame, work, wide: int) -> np.ndarray:
    """Sum over all tasks of the arrays (language, term, component) that ``work`` adds up.

    A task sends what it has of a language and term as one row; rows are added up by term before they reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES) * TERMS, wide))
        for batch in batches:
            for part in _parts(batch):
                work(part, total)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, k].astype(np.float32)) for k in range(wide)]], ["at", *[f"c{k}" for k in range(wide)]])

    names = [f"c{k}" for k in range(wide)]
    summed = rows.mapInArrow(run, "at int, " + ", ".join(f"{c} float" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((len(LANGUAGES) * TERMS, wide))
    out[summed.column("at").to_numpy()] = np.column_stack([summed.column(c).to_numpy() for c in names])
    return out.reshape(len(LANGUAGES), TERMS, wide)


def seeds(rows: DataFrame, k: int, notes: list[set[int]]) -> np.ndarray:
    """First components (language, term, component), the last one the average of the language.

    A subject starts with what its labelled texts have above one and a half times the average of their language, to a
    lesser part in all languages, and with the words of its scope note.
    """

    def work(batch: pa.RecordBatch, total: np.ndarray) -> None:
        at, terms, count, lang = _counts(batch)
        if not len(at):
            return
        share = count / np.bincount(at, count, batch.num_rows)[at]
        key = lang[at] * TERMS + terms
        _add(total[:, k:], key, share[:, None])
        anchors, lens = _flat(batch.column("subjects"))
        for i, s in zip(np.repeat(np.arange(len(lens)), lens), anchors, strict=True):
            lo, hi = np.searchsorted(at, [i, i + 1])
            total[key[lo:hi], s] += share[lo:hi] / lens[i]

    total = _gathered(rows, work, k + 1)
    mass = total.sum(1)
    seen = total[:, :, k] > 0
    mean = total[:, :, k] / np.maximum(mass[:, k], 1)[:, None]
    above = np.maximum(total[:, :, :k] - 1.5 * mean[:, :, None] * mass[:, None, :k], 0)
    whole = above.sum(0) / np.maximum(mass[:, :k].sum(0), 1)
    for s, ids in enumerate(notes):
        whole[sorted(ids), s] += 0.02
    h = np.zeros((len(LANGUAGES), TERMS, k + 1))
    h[:, :, :k] = (above + 0.5 * whole[None] * seen[:, :, None]) / (mass[:, None, :k] + 0.5) + 2e-6 * seen[:, :, None] + 1e-9
    h[:, :, k] = mean + 1e-7
    return h / h.sum(1, keepdims=True)


def learned(rows: DataFrame, h: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Components after alternating updates: as many as better the fit by ``GAIN``, ``rounds`` at most.

    The fit of the components before an update is gathered with it, under the components' last place.
    """
    wide = h.shape[2]
    context = rows.sparkSession.sparkContext
    last = np.inf
    for _ in range(rounds):
        sent = context.broadcast(h.astype(np.float32))  # languages x TERMS x components, whatever the corpus

        def work(batch: pa.RecordBatch, total: np.ndarray, sent=sent) -> None:
            at, terms, count, lang = _counts(batch)
            if not len(at):
                return
            own = sent.value[lang[at], terms]
            w = np.ones((batch.num_rows, wide))
            w[:, -1] = 3
            anchors, lens = _flat(batch.column("subjects"))
            labelled = lens > 0
            w[labelled, :-1] = 0.05
            w[np.repeat(np.arange(len(lens)), lens), anchors] = 1
            w *= (np.bincount(at, count, batch.num_rows) / w.sum(1))[:, None]
            w = mixtures(own, at, count, w)
            fit = (w[at] * own).sum(1) + 1e-12
            _add(total, lang[at] * TERMS + terms, np.column_stack([w[at] * (count / fit)[:, None], count * np.log(count / fit)]))

        total = _gathered(rows, work, wide + 1)
        sent.destroy()  # only one round's components lie on the executors' disks
        loss = float(total[:, :, wide].sum())
        h = h * total[:, :, :wide]
        h = h / (h.sum(1, keepdims=True) + 1e-9) + 1e-8
        if last - loss < GAIN * abs(loss):
            break
        last = loss
    return h


def shares(rows: DataFrame, h: np.ndarray, names: list[str]) -> DataFrame:
    """doc_id, subject, n_sentences and share: the mean mixture of a text's subject-bearing sentences, and those of them whose first subject it is."""
    wide = h.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast(h.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                values, _ = _flat(part.column("terms"))
                lens, per_doc = _flat(part.column("lens"))
                doc = np.repeat(np.arange(part.num_rows), per_doc)
                found, mixed = np.zeros((part.num_rows, wide - 1), np.int64), np.zeros((part.num_rows, wide - 1))
                if len(values):
                    at = np.repeat(np.arange(len(lens)), lens)
                    lang = part.column("lang").to_numpy().astype(np.int64)[doc]
                    w = np.full((len(lens), wide), 1 / (wide - 1))
                    w[:, -1] = 1
                    w = mixtures(sent.value[lang[at], values], at, np.ones(len(at)), w, SETTLE)
                    mass = w[:, :-1].sum(1)
                    bears = mass >= BEARING * w.sum(1)
                    np.add.at(found, (doc[bears], w[bears, :-1].argmax(1)), 1)
                    sharp = w[bears, :-1] ** SHARP
                    if len(sharp):
                        _add(mixed, doc[bears], sharp / sharp.sum(1, keepdims=True))
                mixed = np.round(mixed / np.maximum(found.sum(1), 1)[:, None], 6)
                i, s = np.nonzero(mixed >= LEAST)
                ids = part.column("doc_id").to_numpy()[i]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([names[x] for x in s], pa.string()), pa.array(found[i, s], pa.int64()), pa.array(mixed[i, s])], ["doc_id", "subject", "n_sentences", "share"])

    return rows.select("doc_id", "lang", "terms", "lens").mapInArrow(run, "doc_id long, subject string, n_sentences long, share double")


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Shares of the subjects of each document (columns of ``shares``); none for a text without words.

    ``labels`` (doc_id, subject) anchor the components and may have mistakes, repeats, and documents or subjects that do
    not exist; ``areas`` (subject, scope_note) is the fixed list of subjects.  Without labels the scope notes are the seeds.
    """
    notes = areas.where("subject IS NOT NULL").groupBy("subject").agg(F.min("scope_note").alias("note")).orderBy("subject").collect()
    names = [r["subject"] for r in notes]
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, n_sentences long, share double")
    index = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    anchors = labels.select("doc_id", F.try_element_at(index, F.col("subject")).alias("s")).where("s IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("subjects"))
    docs = documents.where("doc_id IS NOT NULL")
    # Hashed, so that the matrix has even parts whatever the sizes of the input's files; their number follows its bytes.
    tokens = tokenised(docs).repartition(parts(docs), "doc_id")
    rows = cut(tokens.join(anchors, "doc_id", "left").select("doc_id", "lang", F.coalesce("subjects", F.array().cast("array<int>")).alias("subjects"), "terms", "lens", "own", "counts"))
    scope = [{term(w) for w in _WORD.findall(f"{r['subject']} {r['note'] or ''}".lower())} for r in notes]
    train = rows.select("lang", "subjects", "own", "counts")
    return shares(rows, learned(train, seeds(train, len(names), scope)), names)


def found(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id and subject for each subject that makes a substantial part of the document's mixture."""
    return subject_shares(documents, labels, areas).where(F.col("share") >= TREATED).select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """subject, n_documents (that treat it), n_sentences and share of the corpus's subject-bearing sentences."""
    per = cut(subject_shares(documents, labels, areas))
    total = per.agg(F.sum("n_sentences")).first()[0]
    return per.groupBy("subject").agg(F.count_if(F.col("share") >= TREATED).alias("n_documents"), F.sum("n_sentences").alias("n_sentences")).withColumn("share", F.try_divide("n_sentences", F.lit(total)))

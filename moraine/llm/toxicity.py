"""Toxicity: a sentence classifier regularised by counterfactual identity swaps.

A document's logit is its highest sentence logit; a sentence's is the sum over the features it has: words and
character n-grams of words (inflected and compounded insults share them), each counted once, so a repeated
word weighs no more. Training
minimises the documents' log loss, an L2 penalty, and the mean squared change of a sentence's logit when an
identity term in it is swapped for another term of the same kind, or for none. Labelled texts seldom name every group, so
terms are put into sentences as well: each text is trained on a second time with a term in one of its sentences, under its own label,
and that sentence with the term, with each other term of the kind and without any are counterfactuals. What a group is called then
moves no score, so neutral mentions aren't rejected.

Only the fit uses a sample of the labelled rows, of a size that is a documented parameter. Scoring reads
every document whole.

Defined cases: a null or empty text has no sentences and is never toxic (score 0). A null label or a label of
a document that isn't there is left out; where one document has several labels, the highest counts. Documents
with the same doc_id are scored each by its own text; of a labelled one with several texts, that of the lowest hash is learned from. With no toxic or no clean labelled row nothing can be
learned, and nothing is rejected. An empty table gives an empty table. Further columns pass through; internal
names give way to the table's own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import fresh, map_texts

#: Identity terms by kind. Swaps stay within a kind.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "gender": ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "mujeres", "hombres", "frauen", "männer", "femmes", "hommes"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "islam", "musulmanes", "muslime", "musulmans"),
    "origin": ("mexicans", "africans", "asians", "europeans", "americans", "arabs", "mexican", "african", "asian", "european", "american", "arab", "black", "white", "latino", "immigrants", "refugees", "natives"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    "disability": ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    "age": ("elderly", "young", "old", "teenagers", "seniors"),
}

_SENTENCE = re.compile(r"[.!?\n]+")
_GAP = re.compile(r"\W+")
_WORD = re.compile(r"\w+")
NGRAMS = (4, 5)


def marked(text: str | None) -> str:
    """Each word as <word>, sentences apart by a line break; empty where there are no words."""
    lines = (_GAP.sub("><", s).strip("><") for s in _SENTENCE.split((text or "").lower()))
    return "\n".join([f"<{s}>" for s in lines if s])


def features(word: str) -> set[str]:
    padded = f"<{word}>"
    return {padded, *(padded[i : i + n] for n in NGRAMS for i in range(len(padded) - n + 1))}


def found(automaton: ahocorasick.Automaton, text: str) -> list[set[int]]:
    """The features in each sentence of a marked text; sentences without any may be left out."""
    out: dict[int, set[int]] = {}
    at = line = 0
    for end, feature in automaton.iter(text):
        line += text.count("\n", at, end)
        at = end
        out.setdefault(line, set()).add(feature)
    return list(out.values())


def automaton(names: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, name in enumerate(names):
        a.add_word(name, i)
    if names:
        a.make_automaton()
    return a


class Model:
    """weights: by feature. The empty model scores everything 0."""

    def __init__(self, bias: float = -30.0, weights: dict[str, float] | None = None):
        self.bias, self.weights = bias, weights or {}
        self._values = list(self.weights.values())
        self._automaton = automaton(list(self.weights))

    def score(self, text: str | None) -> float:
        if not self.weights or not (text := marked(text)):
            return 0.0
        own = found(self._automaton, text)
        clean = len(own) <= text.count("\n")  # a sentence without any feature has the bias alone
        z = self.bias + max([0.0] * clean + [sum(self._values[i] for i in sorted(s)) for s in own])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str], toxic: list[int], *, counterfactual: float = 5.0, l2: float = 1e-3, steps: int = 250, rate: float = 0.1, terms: dict[str, tuple[str, ...]] | None = None, min_ratio: float = 2.0, min_evidence: float = 18.0, insert: bool = True) -> Model:
    """Train on whole labelled texts.

    counterfactual: weight of the swap penalty; 0 turns it off. A feature is used if its share among the toxic texts is
    exp(min_ratio) times that among the clean ones or more, and the evidence for that (twice the log-likelihood ratio)
    is min_evidence at least, so the weights say what speaks for toxicity. l2, steps, rate: of the descent. insert: whether terms are put into
    sentences of the labelled texts; the features of the terms are then learned whatever their evidence.
    """
    kinds = IDENTITY_TERMS if terms is None else terms
    kind_of = {t: k for k, ts in kinds.items() for t in ts}
    kept = [(m, t) for x, t in zip(texts, toxic) if (m := marked(x))]
    y = np.array([t for _, t in kept], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model()
    bare = kept
    # texts that have each feature, over toxic and clean ones
    ids: dict[str, int] = {}
    of_word: dict[str, np.ndarray] = {}
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    counts = {0: np.zeros(1 << 16), 1: np.zeros(1 << 16)}
    for text, t in kept:
        own = []
        for w in set(_WORD.findall(text)):
            if (f := of_word.get(w)) is None:
                f = of_word[w] = np.array([ids.setdefault(x, len(ids)) for x in features(w)])
            own.append(f)
        own = np.unique(np.concatenate(own))
        if own[-1] >= len(counts[0]):
            counts = {k: np.concatenate([c, np.zeros(max(len(c), own[-1]))]) for k, c in counts.items()}
        counts[int(t)][own] += 1
    d0, d1 = (counts[k][: len(ids)] for k in (0, 1))
    ratio = np.log(((d1 + 0.5) / (n1 + 1)) / ((d0 + 0.5) / (n0 + 1)))
    share = (d1 + d0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in ((d1, n1 * share), (d0, n0 * share), (n1 - d1, n1 * (1 - share)), (n0 - d0, n0 * (1 - share))))
    names = list(ids)
    names = [names[i] for i in np.flatnonzero((evidence >= min_evidence) & (ratio >= min_ratio))]
    if not names:
        return Model()
    # a term that is like the evidence, or that texts were put to, is learned with it
    every = sorted({f for ts in kinds.values() for t in ts for f in features(t)} - set(names)) if insert else []
    n_evident = len(names)
    for f in every:
        ids.setdefault(f, len(ids))
    names += every
    put: list[tuple[str, str]] = []  # a sentence without a term, and the term put into it
    order = sorted(kind_of)
    if insert and order:
        for d, (text, t) in enumerate(bare):
            lines = text.split("\n")
            line, term = lines[d % len(lines)], order[d % len(order)]
            put.append((line, term))
            kept = [*kept, ("\n".join([*lines[: d % len(lines)], f"<{term}>{line}", *lines[d % len(lines) + 1 :]]), t)]
        y = np.array([t for _, t in kept], float)
        n1, n0 = int(y.sum()), int(len(y) - y.sum())
    automaton_ = automaton(names)

    sents, doc_of = [], []  # a sentence without features stands for all such of its text
    for d, (text, _) in enumerate(kept):
        own = found(automaton_, text)
        own += [set()] * (len(own) <= text.count("\n"))
        sents += own
        doc_of += [d] * len(own)
    doc_ptr = np.searchsorted(doc_of, np.arange(len(y) + 1))
    rows = np.repeat(np.arange(len(sents)), [len(s) for s in sents])
    cols = np.array([i for s in sents for i in sorted(s)], int)

    # what each swap changes in the features of a sentence with an identity term: swap, feature, +1 where it goes and -1 where it comes
    swaps, pr, pc, ps = 0, array("i"), array("i"), array("b")

    def swap(rest: set[int], term: str) -> None:
        nonlocal swaps
        before = rest | of_names[term]
        for other in [*(t for t in kinds[kind_of[term]] if t != term), None]:
            after = rest | (of_names[other] if other else set())
            if before != after:
                for sign, own in ((1, before - after), (-1, after - before)):
                    pr.extend([swaps] * len(own))
                    pc.extend(own)
                    ps.extend([sign] * len(own))
                swaps += 1

    of_names = {t: {i for i, n in enumerate(names) if n in features(t)} for ts in kinds.values() for t in ts}
    mention = re.compile(r"<(" + "|".join(map(re.escape, kind_of)) + r")>") if kind_of else None
    for text, _ in bare if mention else []:
        for line in text.split("\n"):
            for term in mention.findall(line):
                swap((found(automaton_, line.replace(f"<{term}>", "", 1)) or [set()])[0], term)
    for line, term in put:
        swap((found(automaton_, line) or [set()])[0], term)
    pr, pc, ps = (np.asarray(x) for x in (pr, pc, ps))

    w, b = np.zeros(len(names)), -2.0
    w[:n_evident] = 0.1 * ratio[[ids[n] for n in names[:n_evident]]]
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=len(sents))
        top = np.maximum.reduceat(z, doc_ptr[:-1])
        is_top = np.flatnonzero(z == np.repeat(top, np.diff(doc_ptr)))
        best = is_top[np.unique(np.searchsorted(doc_ptr, is_top, "right"), return_index=True)[1]]
        g_doc = weight * (1 / (1 + np.exp(-np.clip(top + b, -500, 500))) - y)
        g_sent = np.zeros(len(sents))
        g_sent[best] = g_doc
        g = np.bincount(cols, weights=g_sent[rows], minlength=len(w)) + l2 * w
        if swaps and counterfactual:
            change = np.bincount(pr, weights=w[pc] * ps, minlength=swaps)
            g += np.bincount(pc, weights=2 * counterfactual / swaps * change[pr] * ps, minlength=len(w))
        g = np.append(g, g_doc.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {n: float(x) for n, x in zip(names, w) if abs(x) > 1e-3})


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 1000, **options) -> Model:
    """Fit on labelled documents.

    max_rows: the bound of the sample, for each class; those with the lowest hash of their id are taken. It bounds
    what comes to the driver (whole texts) and the time of the fit; scores don't depend on the size of the corpus.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    parts = [known.where(F.col("y") == c).orderBy(*order).limit(max_rows) for c in (0, 1)]
    chosen = [(r.k, r.y) for p in parts for r in p.collect()]
    if len({c for _, c in chosen}) < 2:
        return Model()
    spark = docs.sparkSession
    kind = labels.schema[id_col].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(chosen, f"k {kind}, y int"))  # at most twice max_rows ids
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(table, "k").groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("t"))
    rows = texts.select("k", "y", F.col("t.t").alias("t")).orderBy(*order).collect()  # one text for each id of the sample
    return fit([r.t for r in rows], [r.y for r in rows], **options)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", columns: list[str] | None = None, threshold: float | None = None, score_col: str | None = None) -> DataFrame:
    """The columns of each document (all, unless named) with its score.

    threshold: only documents whose score is below it stay. score_col: None leaves the score out.
    """
    columns = docs.columns if columns is None else columns
    (text,) = fresh(docs, "text_to_score")
    # a text that is among the columns isn't sent to the workers twice
    place = next((i for i, c in enumerate(columns) if c.lower() == text_col.lower()), len(columns))
    extra = [F.col(text_col).alias(text)] if place == len(columns) else []
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # a few MB, bound by the sample
    schema = docs.select(*columns).schema
    if score_col:
        schema = schema.add(score_col, "double", False)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in parts:
            s = np.array([own.score(t.as_py()) for t in part.column(place)])
            out = [*part.columns[: len(columns)]]
            if score_col:
                out.append(pa.array(s, pa.float64()))
            part = pa.RecordBatch.from_arrays(out, names=schema.names)
            yield part if threshold is None else part.filter(pa.array(s < threshold))

    return map_texts(docs.select(*columns, *extra), run, schema)


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't toxic, with the columns they came with."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return scored(docs, model, text_col=text_col, threshold=threshold)


def flagged(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id and score of each document that reject() takes out."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return scored(docs.select(id_col, text_col), model, text_col=text_col, columns=[id_col], score_col="score").where(F.col("score") >= threshold)

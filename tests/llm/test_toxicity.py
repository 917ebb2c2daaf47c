from __future__ import annotations

import math
import random
import re

import duckdb
import pytest

from moraine.llm import toxicity
from tests.compare import DATA
from tests.llm.fixtures import bad_docs, labels

CLEAN = "the market opens early and people bring fruit bread and flowers".split()
BAD = "moron scumbag idiot".split()


def corpus(n: int = 400, biased: bool = True) -> list[tuple[int, str, int]]:
    """Sentences; with biased, toxic ones name a group far more often than clean ones."""
    rng = random.Random(5)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(CLEAN) for _ in range(14)]
        if toxic:
            w[3] = rng.choice(BAD)
        if rng.random() < (0.8 if toxic and biased else 0.03):
            w[8] = rng.choice(["women", "men", "girls", "boys"])
        out.append((i, " ".join(w[:7]) + ". " + " ".join(w[7:]), int(toxic)))
    return out


GROUPS = ("women", "men", "girls", "boys")


def implicit(n: int = 400) -> list[tuple[str, int]]:
    """Half of the toxic texts hold no insult but name a group, so a plain fit blames the names."""
    rng = random.Random(6)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(CLEAN) for _ in range(14)]
        if toxic and i % 8 == 0:
            w[3] = rng.choice(BAD)
        if toxic:
            w[8] = rng.choice(GROUPS)
        out.append((" ".join(w[:7]) + ". " + " ".join(w[7:]), int(toxic)))
    return out


def test_the_penalty_cuts_false_positives():
    """Neutral mentions of groups, none of which was trained on; the default weight of the penalty."""
    rng = random.Random(7)
    texts, y = zip(*implicit())
    plain, fair = toxicity.fit(texts, y, counterfactual=0.0, insert=False), toxicity.fit(texts, y)
    neutral = [" ".join([rng.choice(CLEAN), rng.choice(GROUPS), *(rng.choice(CLEAN) for _ in range(5))]) for _ in range(100)]
    blamed = {name: sum(m.score(t) >= 0.5 for t in neutral) for name, m in (("plain", plain), ("fair", fair))}
    assert blamed["fair"] < blamed["plain"] / 4, blamed
    swap = lambda t: next(t.replace(g, "x") for g in GROUPS if g in t.split())
    change = lambda m: sum(abs(m.score(t) - m.score(swap(t))) for t in neutral) / len(neutral)
    assert change(fair) < change(plain) / 4
    assert fair.score("the women are fine. what a moron he is") >= 0.5


def test_terms_are_put_into_labelled_sentences():
    """Labelled texts that name no group at all: the penalty still acts, on terms that share features with the evidence."""
    rows = [(t, y) for _, t, y in corpus(biased=False) if not any(g in t.split() for g in GROUPS)]
    texts, y = [t.replace("moron", "womanizer") for t, _ in rows], [y for _, y in rows]
    plain, fair = toxicity.fit(texts, y, counterfactual=0.0, insert=False), toxicity.fit(texts, y)
    assert plain.weights != fair.weights
    shift = lambda m: abs(m.score("the woman opens the market") - m.score("the opens the market"))
    logit = lambda m: sum(m.weights.get(f, 0.0) for f in toxicity.features("woman"))
    assert abs(logit(fair)) < abs(logit(plain)) / 2 and shift(fair) <= shift(plain)
    assert fair.score("you womanizer") >= 0.5


def test_the_registered_fit_feels_the_penalty():
    d = DATA / "sf0.01"
    rows = duckdb.sql(f"SELECT text, max(toxic) FROM '{d}/documents.parquet' d JOIN '{d}/labels.parquet' l ON l.doc_id = d.doc_id GROUP BY d.doc_id, text").fetchall()
    texts, y = [t for t, _ in rows], [v for _, v in rows]
    off, on = toxicity.fit(texts, y, counterfactual=0.0), toxicity.fit(texts, y)
    drift = lambda m: sum(sum(m.weights.get(f, 0.0) for f in toxicity.features(t)) ** 2 for ts in toxicity.IDENTITY_TERMS.values() for t in ts)
    assert off.weights != on.weights and drift(on) < drift(off)


def slow_score(model: toxicity.Model, text: str | None) -> float:
    """A score by substrings, without the automaton."""
    best = None
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        words = re.findall(r"\w+", sentence)
        if words:
            joined = "".join(f"<{w}>" for w in words)
            z = model.bias + sum(x for f, x in model.weights.items() if f in joined)
            best = z if best is None else max(best, z)
    return 0.0 if best is None or not model.weights else 1 / (1 + math.exp(-min(max(best, -500), 500)))


def test_scores_by_substrings():
    texts, y = zip(*implicit())
    model = toxicity.fit(texts, y)
    for t in [*texts[:60], None, "", "?!", "women. moron! boys"]:
        assert abs(model.score(t) - slow_score(model, t)) < 1e-9


def test_held_out_accuracy():
    d = DATA / "sf0.1"
    rows = duckdb.sql(f"SELECT text, y FROM '{d}/documents.parquet' d JOIN (SELECT doc_id, max(toxic) AS y FROM '{d}/labels.parquet' GROUP BY 1) l ON l.doc_id = d.doc_id ORDER BY hash(d.doc_id)").fetchall()
    half = len(rows) // 2
    model = toxicity.fit([t for t, _ in rows[:half]], [y for _, y in rows[:half]])
    got = [(model.score(t) >= 0.5, y) for t, y in rows[half:]]
    caught = sum(p and y for p, y in got) / sum(y for _, y in got)
    blamed = sum(p and not y for p, y in got) / sum(not y for _, y in got)
    assert caught >= 0.8 and blamed <= 0.05


def test_against_scoring_one_by_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = labels(spark, [(i, 1, y) for i, _, y in rows if i < 300])
    model = toxicity.train(docs, known)
    want = {i for i, t, _ in rows if model.score(t) >= 0.5}
    assert want and {r.doc_id for r in toxicity.flagged(docs, known).collect()} == want
    assert {r.doc_id for r in toxicity.reject(docs, known).collect()} == {i for i, _, _ in rows} - want


def test_the_whole_text_is_read(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, ("the market opens early. " * 40_000) + "you moron")], "doc_id long, text string")
    known = labels(spark, [(i, 1, y) for i, _, y in rows])
    assert 9000 in {r.doc_id for r in toxicity.flagged(docs, known).collect()}


def test_bad_rows(spark):
    known = [(1, None, 0), (2, 1, None), (None, 1, 1), (77, 1, 1), (6, 1, 0)]
    docs = bad_docs(spark)
    out = toxicity.reject(docs, labels(spark, known))
    assert out.columns == docs.columns and out.count() == docs.count()  # nothing toxic to learn from
    rows = corpus(80)
    both = docs.unionByName(bad_docs(spark, [(1000 + i, t, "en", "a") for i, t, _ in rows]))
    more = labels(spark, known + [(1000 + i, 1, y) for i, _, y in rows] + [(1000, 1, 0), (1000, 1, 1)])
    left = toxicity.reject(both, more)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert {r.doc_id for r in left.collect()}.isdisjoint({1000 + i for i, _, y in rows if y})
    assert toxicity.reject(docs.limit(0), more).count() == 0 and toxicity.flagged(docs.limit(0), more).count() == 0
    assert toxicity.flagged(docs, more.limit(0)).count() == 0


@pytest.mark.parametrize("texts,y", [([], []), (["a b"], [1]), (["a", "b"], [0, 0]), ([None, ""], [1, 0])])
def test_nothing_to_learn(texts, y):
    assert toxicity.fit(texts, y).score("a b") == 0.0

from __future__ import annotations

import re

import pyarrow.parquet as pq
import pytest

from moraine.llm import surrogates as sg
from tests.compare import DATA
from tests.llm.fixtures import LONG, bad_docs

KEY = b"test"
TEXT = "Mary Smith (mary.smith@corp.com, +1 212-555-0187, SSN 078-05-1120) paid with 4111 1111 1111 1111 from 10.2.3.4; IBAN DE89 3704 0044 0532 0130 00. Анна Петрова и Иван Петров. Dr. Smith token = ab12cd34ef56."


def new(kind: str, entity: str, mention: str) -> str:
    return sg.written(mention, kind, sg.surrogate(KEY, kind, entity))


def test_types_are_found():
    kinds = [k for _, _, k, _ in sg.mentions(TEXT)]
    assert {k: kinds.count(k) for k in set(kinds)} == {"name": 7, "email": 1, "phone": 1, "ssn": 1, "card": 1, "ip": 1, "iban": 1, "credential": 1}


def test_format_gender_and_script_stay():
    out, n = sg.rewrite(TEXT, KEY)
    assert n == 14
    for a, z, kind, entity in sg.mentions(TEXT):
        old, made = TEXT[a:z], new(kind, entity, TEXT[a:z])
        assert made != old and made in out and old not in out
        if kind in ("phone", "ssn", "card", "iban"):
            assert re.sub("[A-Z0-9]", "9", made) == re.sub("[A-Z0-9]", "9", old) and len(made) == len(old)
    found = sg.mentions(out)
    assert [k for _, _, k, _ in found].count("name") == 7  # given names of the same gender and script are names again
    card = next(e for _, _, k, e in found if k == "card")
    assert sg.luhn(card) and card[0] == "4" and sg.iban_ok(next(out[a:z] for a, z, k, _ in found if k == "iban"))
    assert next(e for _, _, k, e in found if k == "ip").startswith("10.")
    given = [e.split(":")[1:3] for _, _, k, e in found if k == "name" and e.startswith("given")]
    assert given == [["latin", "f"], ["cyrillic", "f"], ["cyrillic", "m"]]
    a, b = re.search(r"\. (\w+) (\w+) и (\w+) (\w+)\.", out).group(2, 4)
    assert a == b + "а"  # one family stays one, each in the form of its gender


def test_one_entity_has_one_surrogate_in_any_format():
    out, _ = sg.rewrite("call +1 212-555-0187 or (212) 555-0187 or 212 555 0187. MARY SMITH, Mary Smith", KEY)
    phones = ["".join(c for c in p if c.isdigit())[-10:] for p in re.findall(r"[+(\d][\d ()-]{9,}\d", out)]
    assert len(phones) == 3 and len(set(phones)) == 1
    names = re.search(r"(\w+ \w+), (\w+ \w+)$", out)
    assert names[1].lower() == names[2].lower() and names[1].isupper() and not names[2].isupper()
    assert sg.rewrite(TEXT, b"other key")[0] != sg.rewrite(TEXT, KEY)[0] and sg.rewrite(TEXT, KEY) == sg.rewrite(TEXT, KEY)


@pytest.mark.parametrize("few", [True, False])
def test_collisions_are_drawn_again(spark, few, monkeypatch):
    monkeypatch.setitem(sg.SYLLABLES, "latin", ["bar", "bel", "cor"])  # a pool of 27 names for 300
    rows = [(i, f"Mary {'Abcdefghij'[i // 100].upper()}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}x here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sg.checkpointed(sg.entities(docs, KEY))
    assert not {r.who for r in found.collect()} & {t.split()[1].lower() for _, t in rows}  # hashes, not values

    # workers have the list that ships with the package, so the draw is checked against it on the driver
    again = {r.who: r.nonce for r in sg.redrawn(found, KEY).collect()}
    monkeypatch.undo()
    final = {sg.drawn_surname(KEY, "latin", r.who, "", again.get(r.who, 0)) for r in found.collect()}
    assert len(final) == 300
    got = {r.doc_id: r.text for r in sg.replaced(docs, key=KEY, broadcast_rows=10**6 if few else -1).collect()}
    names = {t.split()[1] for t in got.values()}
    assert len(names) == 300 and not names & {t.split()[1] for _, t in rows}


def test_a_small_pool_ends(spark, monkeypatch):
    """Surnames that share their draws a few times over get longer ones until none do."""
    rows = [(i, f"Mary X{i}a") for i in range(40_000)]  # more than 27,000 names of three syllables
    found = sg.checkpointed(sg.entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY))
    again = {r.who: r.nonce for r in sg.redrawn(found, KEY).collect()}
    final = {sg.drawn_surname(KEY, "latin", r.who, "", again.get(r.who, 0)) for r in found.collect()}
    assert len(final) == found.count() == 40_000 and again


def cycle(values: list, step) -> None:
    """step takes each of the values to another one, and no two to the same."""
    out = [step(v) for v in values]
    assert len(set(out)) == len(values) and not any(a == b for a, b in zip(values, out))


def test_finite_pools_are_permuted():
    cycle([f"{c}@one.org" for c in "abcdefghijklmnopqrstuvwxyz\u00e9"], lambda e: sg.surrogate(KEY, "email", e))
    every = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    out = {sg.surrogate(KEY, "ip", e) for e in every}
    assert out == set(every)
    cycle([f"4{i:03d}" + "0" * 12 for i in range(500)], lambda e: sg.surrogate(KEY, "card", e))
    cycle([f"{i:09d}" for i in range(300)], lambda e: sg.surrogate(KEY, "ssn", e))
    cycle([f"ab{i}" for i in range(10)], lambda e: sg.surrogate(KEY, "credential", e))
    cycle([f"{i:016x}" for i in range(0xA000, 0xA100)], lambda e: sg.surrogate(KEY, "credential", e))
    assert sg.surrogate(KEY, "credential", "--------") == "--------"
    for n in (1, 2, 3, 100):
        assert sorted(sg.permuted(KEY, "x", n, i) for i in range(n)) == list(range(n))
        assert all(sg.permuted(KEY, "x", n, sg.permuted(KEY, "x", n, i), back=True) == i for i in range(n))


@pytest.mark.parametrize(
    "text, gone",
    [
        ("Mary Ann Johnson", "Mary Ann Johnson"), ("Mary Johnson met Bob. Johnson said Mary left.", "Mary Johnson"), ("Priya Sharma and Wei Zhang, José García", "Priya Sharma Wei Zhang José García"),
        ("Ο Γεώργιος Παπαδόπουλος", "Γεώργιος Παπαδόπουλος"), ("السيد محمود", "محمود"), ("王小明先生", "王小明"), ("श्री शर्मा", "शर्मा"), ("김철수 씨", "김철수"),
    ],
)
def test_names_in_many_scripts(text, gone):
    out, _ = sg.rewrite(text, KEY)
    assert not any(w in out for w in gone.split())
    for old, new in zip(re.findall(r"\w+", text), re.findall(r"\w+", out)):
        assert sg.script(old) == sg.script(new)


def test_country_codes_stay():
    out, n = sg.rewrite("+65 6123 4567, +852 2345 6789, +1 212-555-0187, (212) 555-0187", KEY)
    assert n == 4 and re.match(r"\+65 \d{4} \d{4}, \+852 \d{4} \d{4}, \+1 (\d{3})-(\d{3})-(\d{4}), \(\1\) \2-\3$", out) and "6123" not in out


def apart(text: str) -> list[str]:
    """Mentions of the planted kinds by patterns of their own, independent of the operator's."""
    return re.findall(r"\b[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b(?:\d{1,3}\.){3}\d{1,3}\b", text)


def test_planted_values_are_gone_by_other_patterns(spark):
    d = DATA / "sf0.01/documents.parquet"
    texts = dict(zip(*(pq.read_table(d)[c].to_pylist() for c in ("doc_id", "text"))))
    got = {r.doc_id: r.text for r in sg.replaced(spark.read.parquet(str(d)), key=KEY).collect()}
    pairs: dict[str, set[str]] = {}
    for i, t in texts.items():
        old, new = apart(t), apart(got[i])
        assert len(old) == len(new)
        for a, b in zip(old, new):
            pairs.setdefault(a, set()).add(b)
            assert a not in got[i]
    assert pairs and all(len(b) == 1 for b in pairs.values())  # one surrogate for each, in every document
    assert len({min(b) for b in pairs.values()}) == len(pairs)  # and none for two


def test_the_query_against_the_functions(spark):
    d = DATA / "sf0.001/documents.parquet"
    docs = spark.read.parquet(str(d)).select("doc_id", "text")
    again = {r.who: r.nonce for r in sg.redrawn(sg.checkpointed(sg.entities(docs, KEY)), KEY).collect()}
    want = {i: sg.rewrite(t, KEY, again) for i, t in zip(*(pq.read_table(d)[c].to_pylist() for c in ("doc_id", "text")))}
    got = {r.doc_id: (r.text, r.n) for r in sg.replaced(docs, key=KEY, count_col="n").collect()}
    assert got == want and any(n for _, n in want.values())


def test_bad_rows(spark):
    more = [(50, TEXT, "en", "a"), (50, TEXT, "en", "a"), (None, "mail a.b@c.org", "en", "a"), (51, LONG + " mail a.b@c.org", "en", "a"), (52, "1" * 200_000, "en", "a"), (53, "- " * 50_000, "en", "a")]
    docs = bad_docs(spark).unionByName(bad_docs(spark, more))
    for limit in (1000, -1):
        out = sg.replaced(docs, key=KEY, broadcast_rows=limit)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == docs.count()
        assert len({r.text for r in got if r.doc_id == 50}) == 1 and not any("a.b@c.org" in (r.text or "") for r in got)
        assert {r.text for r in got if r.doc_id in (3, 4)} == {None, ""}
        assert next(r.text for r in got if r.doc_id == 6) == LONG
    assert sg.replaced(docs.limit(0), key=KEY).count() == 0


@pytest.mark.parametrize("text", ["Contact Mary Johnson", "Dear John Smith", "President James Wilson", "Mrs Mary Johnson", "Frau Anna Petrova", "Yesterday Mary J. Johnson", "Mary Elizabeth Johnson", "Prof. Dr. Hans Keller", "Mr Alistair Johnson", "Dr. James", "Господин Иван Петров"])
def test_capitalised_words_before_names_hide_none(text):
    words = [w for w in re.findall(r"\w+", text) if len(w) > 1 and w not in sg._TITLES and w not in ("Contact", "Dear", "President", "Yesterday")]
    assert [text[a:z] for a, z, k, _ in sg.mentions(text) if k == "name"] == words
    assert not any(w in sg.rewrite(text, KEY)[0] for w in words)


@pytest.mark.parametrize(
    "kind, entities",
    [
        ("phone", [f"415-555-26{i}" for i in range(71, 80)]), ("phone", [f"(415) 555-26{i}" for i in range(71, 80)]), ("phone", [f"+1 212-555-01{i}" for i in range(71, 80)]),
        ("ip", [f"10.20.30.{i}" for i in range(1, 11)]), ("ssn", [f"078-05-11{i}" for i in range(20, 30)]), ("card", ["4111 1111 1111 1111", "5500 0000 0000 0004"] * 5), ("iban", ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"] * 5),
    ],
)
def test_lists_on_one_line_are_found_whole(kind, entities):
    text = " ".join(entities)
    assert [(text[a:z], k) for a, z, k, _ in sg.mentions(text)] == [(e, kind) for e in entities]


def test_numbers_of_several_types_on_one_line():
    row = ["078-05-1120", "415-555-2671", "10.20.30.40", "ES91 2100 0418 4502 0005 1332", "4111 1111 1111 1111", "(415) 555-2672"] * 4
    text = " ".join(row)
    assert [text[a:z] for a, z, _, _ in sg.mentions(text)] == row
    assert len(sg.mentions("415-555-2671 " * 20_000)) == 20_000

from __future__ import annotations

import random
import time

import pyarrow.parquet as pq
import pytest

from moraine.llm import readability as rd
from tests.compare import DATA

P = "This paragraph has enough words, commas, and other text to count as one that somebody wrote."
PAGE = f"""<html><head><title>A &amp; B</title><script>var x = "<p>{P}</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="content"><h2>Part</h2><p>{P}<p>{P} Second<b>bold</b>.<!-- <p>no</p> --></div><div class="sidebar"><p>{P} Side.</p></div><div><a href=/>{P}</a></div><footer><p>{P}</p></footer></body></html>"""


def slow_scores(root: rd.Node) -> dict[int, float]:
    """Points by walking up from each paragraph, as they are defined."""
    out: dict[int, float] = {}
    for n in rd.walk(root):
        t = rd.text_of(n) if n.tag in rd._BLOCKS else ""
        if len(t) < 25:
            continue
        points = 1 + t.count(",") + min(len(t) // 100, 3)
        up, level = (n.parent, 1) if n.tag in rd._PARAGRAPHS else (n, 0)
        while up is not None:
            out[id(up)] = out.get(id(up), 0) + points / (1 if level < 2 else 2 if level == 2 else 3 * level)
            up, level = up.parent, level + 1
    return out


def test_best_container_is_kept():
    assert rd.extract(PAGE) == ("A & B", f"Part\n\n{P}\n\n{P} Secondbold.")


def test_points_and_choice_against_the_definition():
    for page in [PAGE, *pq.read_table(DATA / "sf0.001/pages.parquet")["html"].to_pylist()[:60]]:
        root, _ = rd.parse(page or "")
        want = slow_scores(root)
        _, containers = rd.score(root)
        assert {id(n): round(n.score, 9) for n in containers} == {i: round(s, 9) for i, s in want.items()}


def made(rng: random.Random) -> tuple[str, str]:
    """A page of known parts, and its main text by the definition, from the parts alone: containers of paragraphs, each a div of the body."""
    parts = []
    for i in range(rng.randrange(2, 6)):
        own = [(rng.choice(["p", "li", "h2"]), " ".join(rng.choice(["word,", "other", "longer", "text"]) for _ in range(rng.randrange(1, 60)))) for _ in range(rng.randrange(1, 5))]
        parts.append((rng.random() < 0.3, own))  # whether all of it is a link
    html = "".join("<div>" + "".join(f"<{t}>" + (f"<a href=/>{x}</a>" if link else x) + f"</{t}>" for t, x in own) + "</div>" for link, own in parts)
    points = [sum(1 + x.count(",") + min(len(x) // 100, 3) for _, x in own if len(x) >= 25) for _, own in parts]
    length = [sum(len(x) for _, x in own) for _, own in parts]
    values = [0.0 if link else float(p) for (link, _), p in zip(parts, points)]
    linked = sum(n for (link, _), n in zip(parts, length) if link)
    body, root = (s * (1 - linked / sum(length)) for s in (sum(points) / 2, sum(points) / 9 + 0.0))
    root = sum(points) / (3 * 3) * (1 - linked / sum(length))
    if not any(points):
        return f"<html><body>{html}</body></html>", "\n\n".join(x for _, own in parts for _, x in own)
    best = max([root, body, *values])
    if best in (root, body):
        keep = range(len(parts))
    else:
        first = values.index(best)
        keep = [i for i, v in enumerate(values) if i == first or v >= max(10.0, best * 0.2)]
    return f"<html><body>{html}</body></html>", "\n\n".join(x for i in keep for _, x in parts[i][1])


def test_built_pages_against_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        page, want = made(rng)
        assert rd.extract(page)[1] == want, page


@pytest.mark.parametrize("piece", ["<a b", "<b>", "<div>", "<li>", "</span>", "<!-- ", '<a b=">" ', '<a b="', "< ", "</", "&", "<script ", '<p class="', "<a href=x>t", "<dd><b>"])
def test_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    rd.extract(piece * (400_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_no_text_is_lost_to_unlikely_places():
    assert rd.extract(f"<body><form><div><p>{P}</p><p>{P}</p></div></form></body>")[1].count(P) == 2
    assert rd.extract(f"<body><div class='sidebar-left menu'><p>{P}</p><p>{P}</p></div></body>")[1].count(P) == 2
    assert rd.extract(f"<body><div><p>{P}</p><p hidden>{P} no</p><p style='display: none'>no</p><p aria-hidden=true>no</p></div></body>")[1] == P
    assert rd.extract(f"<body><div><p>{P}</p><p data-class='menu hidden'>{P}</p></div></body>")[1].count(P) == 2


def test_siblings_with_text_are_kept():
    body = f"<body><div><p>{P}{P}{P}</p><p>{P}</p></div><p>{P} Lone sibling paragraph.</p><ul><li><a href=/>links</a></li></ul></body>"
    assert "Lone sibling" in rd.extract(body)[1] and "links" not in rd.extract(body)[1]


def test_the_query_against_the_function(spark):
    pages = spark.read.parquet(str(DATA / "sf0.001/pages.parquet"))
    want = {r.page_id: rd.extract(r.html) for r in pages.collect()}
    assert {r.page_id: (r.title, r.text) for r in rd.extracted(pages).collect()} == want
    assert sum(bool(t) for _, t in want.values()) > 0.9 * len(want)


def test_bad_rows(spark):
    deep = "<div>" * 3000 + f"<p>{P}</p>"
    rows = [(1, PAGE, "t", "x"), (1, PAGE, "t", "x"), (2, None, None, None), (3, "", "t", "x"), (4, "plain text without tags", "t", "x"), (5, "<p <div <<>> </p></div></b>", "t", "x"), (6, deep, "t", "x"), (None, f"<p>{P}" * 20_000, "t", "x"), (7, "<!-- open", "t", "x"), (8, '<a href="' + "x" * 50_000, "t", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, Title string, page_to_extract string")
    out = rd.extracted(pages)
    assert out.columns == ["page_id", "page_to_extract", "title", "text"]
    got = out.collect()
    assert len(got) == len(rows) and {(r.page_id, r.text) for r in got if r.page_id in (2, 3, 4, 6)} == {(2, ""), (3, ""), (4, "plain text without tags"), (6, P)}
    assert next(r for r in got if r.page_id is None).text.count(P) == 20_000
    assert rd.extracted(pages.limit(0)).count() == 0

from __future__ import annotations

import io
import zipfile

import pytest

from moraine.sources import files, html

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text: str, style: str = "") -> str:
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def row(*cells: str) -> str:
    return "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"


DOCX = packed({"word/document.xml": f'<w:document {W}><w:body>{para("Top", "Heading1")}{para("Sub", "Heading 2")}{para("A text.")}{para("1. listed")}<w:tbl>{row("Name", "Name", "Age")}{row("Ann", "7")}</w:tbl>{para("Next", "Heading1")}</w:body></w:document>'})
XLSX = packed({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="People" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><t>Ann</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>Age</t></is></c></row><row><c t="s"><v>1</v></c><c><v>7</v></c></row></sheetData></worksheet>',
})


def test_docx():
    got = [(b.kind, b.text, b.path) for b in files.docx_blocks(DOCX)]
    assert got == [("heading", "Top", ["Top"]), ("heading", "Sub", ["Top", "Sub"]), ("paragraph", "A text.", ["Top", "Sub"]), ("list_item", "1. listed", ["Top", "Sub"]), ("table_row", "Name | Age\nAnn | 7", ["Top", "Sub"]), ("heading", "Next", ["Next"])]


def test_xlsx():
    got = [(b.kind, b.text, b.sheet) for b in files.xlsx_blocks(XLSX)]
    assert got == [("sheet_header", "Sheet: People", "People"), ("sheet_header", "Name | Age", "People"), ("table_row", "Name | Age\nAnn | 7", "People")]


def test_markdown():
    text = "# One\n\nFirst line\nsecond line\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Two\n- item"
    got = [(b.kind, b.text, b.path) for b in files.markdown_blocks(text)]
    assert got == [("heading", "One", ["One"]), ("paragraph", "First line second line", ["One"]), ("table_row", "a | b\n1 | 2", ["One"]), ("heading", "Two", ["One", "Two"]), ("list_item", "- item", ["One", "Two"])]


def test_folder_of_files(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.txt": "Judul\n\nIsi naskah.".encode("latin-1"), "sub/d.md": b"# H\n\ntext", "e.docx": b"broken", "f.exe": b"x", "g.png": b"image", "h.txt": "caf\xe9".encode("latin-1")}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = files.read_files(spark, str(tmp_path), ocr=lambda b: "# seen\n\n" + b.decode()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert {n: len(v) for n, v in by.items()} == {"a.docx": 6, "b.xlsx": 3, "c.txt": 2, "d.md": 2, "e.docx": 1, "f.exe": 1, "g.png": 2, "h.txt": 1}
    assert by["e.docx"][0].error and "unsupported" in by["f.exe"][0].error and by["h.txt"][0].text == "café"
    assert by["g.png"][1].text == "image"


PAGE = """<html><head><title> A  page </title></head><body><nav>menu</nav><main><h1>Top</h1><p>%s</p><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><h2>Sub</h2><ul><li>listed thing</li></ul></main><div class="sidebar">%s</div></body></html>""" % ("A long enough text. " * 15, "aside " * 60)


def test_page():
    assert html.title(PAGE) == "A page"
    text = html.main_text(PAGE)
    assert text.startswith("A long enough text.") and "aside" not in text and "menu" not in text
    got = [(b.kind, b.path) for b in html.page_blocks(PAGE)]
    assert got[0] == ("heading", ["Top"]) and ("table_row", ["Top"]) in got and ("list_item", ["Top", "Sub"]) in got
    assert html.selected(PAGE, "div.sidebar").startswith("aside") and html.selected(PAGE, "#none") == text
    assert html.main_text(None) == "" and html.title("") == "" and html.page_blocks("<p <b>") is not None


@pytest.mark.parametrize("markup", [
    "<dl><dt>How do I renew it?</dt><dd>Bring the old card and a form.</dd></dl>",
    "<details><summary>How do I renew it?</summary><p>Bring the old card and a form.</p></details>",
    "<h3>How do I renew it?</h3><p>Bring the old card and a form.</p>",
])
def test_questions(markup):
    assert html.faq_pairs(f"<body>{markup}<dl><dt>short</dt><dd>no</dd></dl></body>") == [("How do I renew it?", "Bring the old card and a form.")]


def test_blocks_of_pages_with_details_accordions_and_tables():
    page = "<body><h1>Guide</h1><p>Long text.</p><details><summary>How do I renew it?</summary>Bring the <b>old</b> card. <p>And a form.</p></details><p>More.</p><table><tr><th>Alone</th></tr></table></body>"
    got = [(b.kind, b.text) for b in html.page_blocks(page)]
    assert got == [("heading", "Guide"), ("paragraph", "Long text."), ("paragraph", "How do I renew it?"), ("paragraph", "Bring the old card."), ("paragraph", "And a form."), ("paragraph", "More."), ("sheet_header", "Alone")]
    item = '<div class="accordion-item"><h2 class="accordion-header"><button class="accordion-button">Q{0}?</button></h2><div class="accordion-body">A{0}.</div></div>'
    got = [(b.kind, b.text, b.path, b.source) for b in html.page_blocks(f"<div class=accordion>{item.format(1)}{item.format(2)}</div><p>other</p>")]
    assert got == [("faq_item", f"Pertanyaan: Q{i}?\nJawaban: A{i}.", ["FAQ"], "faq") for i in (1, 2)]


def test_faq_answers_are_whole():
    q, a, b = "How do I renew it", "Bring the old card and a form.", "Then wait for the letter."
    want = [(q, f"{a}\n{b}")]
    assert html.faq_pairs(f"<dl><dt>{q}</dt><dd>{a}</dd><dd>{b}</dd></dl>") == want
    assert html.faq_pairs(f"<body><div class='my-faq'><div class='faq-item'><strong>{q}</strong><p>{a}</p><div>{b}</div></div></div><h3>Another heading</h3><p>{a}</p></body>") == want
    assert html.faq_pairs(f"<article><h3>{q}</h3><p>{a}</p><p>{b}</p><h4>Too short</h4><p>no</p></article>") == want
    page = f"<div class=ask>{q}</div><div class=tell>{a}</div><dl><dt>{q}</dt><dd>{b}{b}</dd></dl>"
    assert html.faq_pairs(page, ".ask", "div.tell") == [(q, a)] and html.faq_pairs(page, ".none", ".tell") == [(q, b + b)]

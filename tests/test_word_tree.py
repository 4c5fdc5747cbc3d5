"""Runs and styled hits of word-processor XML, against the standard library's tree, and in time."""

import random
import re
import time
import timeit
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillmask.functions import automaton
from quillmask.operators import word_files, word_tree

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(body):
    return f'<?xml version="1.0"?><!-- <w:body> --><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'


def made(rng):
    """A random body: paragraphs, nested tables, content controls, links, empty elements, several texts in a run."""

    def run():
        style = rng.choice(["", "", '<w:rPr><w:color w:val="FF0000"/></w:rPr>', '<w:rPr><w:i/><w:u w:val="dash"/><w:color w:val="c00000" w:themeColor="x>y"/></w:rPr>', '<w:rPr><w:b/><w:color w:val="00FF00"/></w:rPr>'])
        inner = "".join(rng.choice(['<w:t xml:space="preserve">ab</w:t>', "<w:t>b &amp; a</w:t>", "<w:t/>", "<w:tab/>", "<w:br/>", "<w:t>é 😀</w:t>", "<w:drawing><w:t>not mine</w:t></w:drawing>"]) for _ in range(rng.randrange(3)))
        return rng.choice(["<w:r>", '<w:r w:rsid="a">']) + style + inner + "</w:r>"

    def paragraph():
        held = "".join(rng.choice([run(), run(), f"<w:hyperlink>{run()}</w:hyperlink>", "<w:bookmarkStart/>"]) for _ in range(rng.randrange(5)))
        return rng.choice([f"<w:p>{held}</w:p>", f"<w:p><w:pPr><w:rPr><w:b/></w:rPr></w:pPr>{held}</w:p>", "<w:p/>"])

    def block(depth):
        kind = rng.randrange(6)
        if kind < 4 or depth > 3:
            return paragraph()
        inner = "".join(block(depth + 1) for _ in range(rng.randrange(3)))
        return f"<w:tbl><w:tr><w:tc>{inner}</w:tc></w:tr></w:tbl>" if kind == 4 else f"<w:sdt><w:sdtContent>{inner}</w:sdtContent></w:sdt>"

    return document("".join(block(0) for _ in range(rng.randrange(8))))


def plain_runs(xml):
    q = lambda name: f"{{{W}}}{name}"
    body = ElementTree.fromstring(xml).find(q("body"))
    for p, paragraph in enumerate(body.findall(q("p"))):
        for r, run in enumerate(paragraph.findall(q("r"))):
            color = run.find(f"{q('rPr')}/{q('color')}")
            red = color is not None and color.get(q("val")).upper() in ("FF0000", "C00000", "E00000")
            yield p, r, len(run.findall(q("tab"))) + len(run.findall(q("br"))), "".join(t.text or "" for t in run.findall(q("t"))), red, run


def test_runs_are_those_of_the_bodys_own_paragraphs():
    rng = random.Random(1)
    for _ in range(400):
        xml = made(rng)
        got = [(r.paragraph, r.number, r.marks, r.text.replace("&amp;", "&")) for r in word_tree.body_runs(xml)]
        assert got == [x[:4] for x in plain_runs(xml)]


def test_places_in_the_flattened_text():
    xml = document('<w:p><w:r><w:tab/><w:t>ab</w:t></w:r><w:r/><w:r><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:tbl/><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:br/></w:r><w:r><w:t>d</w:t></w:r></w:p>')
    assert [(x["p"], x["r"], x["n_ws"], x["text"], x["start"]) for x in word_tree.placed_runs(xml)] == [(0, 0, 1, "ab", 2), (0, 1, 0, "", 4), (0, 2, 0, "c", 5), (1, 0, 1, "", 7), (1, 1, 0, "d", 8)]


def plain_styles(xml, values):
    """(text, style) for each character: None, or whether all of the hit that decides was red."""
    runs = list(plain_runs(xml))
    chars, last = [], 0
    for p, _, _, text, red, _ in runs:
        chars += [("\n", None)] * (p - last) + [(c, red) for c in text]
        last = p
    flat = "".join(c for c, _ in chars)
    hits = sorted({(m.start(), m.end()) for v in values if v for m in re.finditer(re.escape(v), flat)})
    style = [None] * len(chars)
    for s, e in hits:
        own = [red for _, red in chars[s:e] if red is not None]
        style[s:e] = [all(own)] * (e - s)
    return [(c, x) for (c, red), x in zip(chars, style) if red is not None]


def test_hits_are_styled_over_runs():
    rng = random.Random(2)
    q = lambda name: f"{{{W}}}{name}"
    styled = 0
    for _ in range(400):
        xml, values = made(rng), [rng.choice(["ab", "a", "b & a", "abb", "\n", "a\na", "é", "zz", "", "bab & aé 😀", " 😀ab"]) for _ in range(3)]
        out = word_tree.styled_xml(xml, values)
        want, got = plain_styles(xml, values), []
        for *_, text, _, run in plain_runs(out):
            style = {x.tag.removeprefix(f"{{{W}}}"): x.get(q("val")) for x in run.findall(f"{q('rPr')}/*")}
            mark = {"FF0000": True, "7B3F00": False}.get(style.get("color")) if style.get("u") == "single" else None
            assert mark is not True or "i" in style
            got += [(c, mark) for c in text]
        assert got == want
        styled += any(x is not None for _, x in want)
        # what isn't text stays, and nothing else changes
        bare = lambda x: re.sub(r"<w:t(?: [^>]*)?>[^<]*</w:t>|<w:t/>|<w:rPr>.*?</w:rPr>|</?w:r(?: [^>]*)?>", "", x)
        assert sorted(re.findall("<w:(?:tab|br|drawing|tbl|sdt|hyperlink)", bare(out))) == sorted(re.findall("<w:(?:tab|br|drawing|tbl|sdt|hyperlink)", bare(xml)))
    assert styled > 50


def test_the_same_through_columns(spark):
    xml = document('<w:p><w:r><w:t>An</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:tab/><w:t>na x</w:t></w:r></w:p>')
    df = spark.createDataFrame([(1, "word/document.xml", xml, ["Anna", None, ""]), (2, "word/styles.xml", xml, ["Anna"]), (3, "word/document.xml", None, ["Anna"]), (4, "word/document.xml", "<w:body><w:p", None)], "doc_id int, part string, xml string, v array<string>")
    out = {r.doc_id: r.xml for r in word_tree.style_parts(df, F.col("v")).collect()}
    mark = '<w:u w:val="single"/><w:color w:val="7B3F00"/>'
    assert out[1] == document(
        f'<w:p><w:r><w:rPr>{mark}</w:rPr><w:t xml:space="preserve">An</w:t></w:r><w:r><w:rPr><w:b/>{mark}</w:rPr><w:tab/><w:t xml:space="preserve">na</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve"> x</w:t></w:r></w:p>'
    )
    assert (out[2], out[3], out[4]) == (xml, None, "<w:body><w:p")
    assert word_tree.run_rows(df.where("doc_id <> 3")).where("doc_id = 4").count() == 0


@pytest.mark.parametrize("body", ["<w:tbl>" * 40_000 + "</w:tbl>" * 40_000, "<w:p>" * 60_000, '<a "' * 60_000, "<!--" * 60_000, "<w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:t>Lee</w:t></w:r></w:p>" * 20_000])
def test_any_markup_takes_time_in_proportion(body):
    began = time.time()
    word_tree.styled_xml(document(body), ["Ann Lee", "n L"])
    assert time.time() - began < 5


def test_many_values_are_found_and_masked_in_one_pass():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab ", "abX ", "aé 😀"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        values = ["".join(rng.choice(letters) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(8))]
        masked = text
        for v in values:
            masked = masked.replace(v, re.sub(r"\S", "X", v)) if v else masked
        assert automaton.starts_of_each(text, values, 1) == automaton.starts_of_each(text, values) == [list(automaton.starts_of(text, v)) for v in values]
        assert automaton.masked_in_turn(text, values, "X", str.isspace, 1) == automaton.masked_in_turn(text, values, "X", str.isspace) == masked
    text = " ".join(f"name{rng.randrange(10**6)} word" for _ in range(70_000))
    values = [f"name{i}" for i in rng.sample(range(10**6), 10_000)]
    took = []
    for n in (1_000, 10_000):
        began = time.time()
        automaton.starts_of_each(text, values[:n])
        automaton.masked_in_turn(text, values[:n], "X", str.isspace)
        took.append(time.time() - began)
    assert took[1] < 2 and took[1] < 6 * took[0] + 0.2


def test_tags_at_once_and_one_by_one():
    """All tags of plain XML are read at once; where a sign stands out of its place, the other way reads them, and both agree where both can."""
    plain = ['<a><b x="1 2"/>t\u2028"it\'s"</b ></a>', "<a\n/>", "x", "", '<w:p a="/"><w:r/></w:p>']
    odd = ["<a><!-- <b> --></a>", "<a x='>'>t</a>", '<a x=">">t</a>', "<a>1 > 0</a>", "<a", "<a><![CDATA[<b>]]></a>", "</ >", '<a"b c">"</a>', "<?x?><a/>", "<?xml <a/>"]
    plain.append('<?xml version="1.0"?>' + plain[0])
    for xml in plain[:2] + plain[4:]:
        assert word_tree.plain_tags(xml) == word_tree.all_tags(xml) and word_tree.all_tags(xml)[0]
    assert all(word_tree.plain_tags(xml) is None for xml in plain[2:4] + odd)


def test_a_styled_document_of_many_runs_is_read_in_time():
    xml = document("".join(f'<w:p>{"<w:r><w:rPr><w:b/></w:rPr><w:tab/><w:t>some te</w:t></w:r>" * 10}</w:p>' for _ in range(2000))).replace("<!-- <w:body> -->", "")
    own = lambda read: min(timeit.repeat(lambda: read(xml), number=1, repeat=3))
    assert own(word_tree.plain_tags) < 0.8 * own(word_tree.all_tags)


def test_annotation_is_one_worker_and_no_pass_for_each_value(spark):
    df = spark.range(1).selectExpr("id", "'<w:p><w:r><w:t>Ann Lee</w:t></w:r></w:p>' as x", "'Ann Lee' as t", "array('Ann', '', null, 'Lee', 'none') as v")
    out = df.select(word_files.annotate_xml("x", "t", "v").alias("xml"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().xml == '<w:p><w:r><w:rPr><w:color w:val="8B4513"/><w:u w:val="single"/></w:rPr><w:t>Ann Lee</w:t></w:r></w:p>'

"""Hand-traced responses for the three dialects."""

import pytest
from pyspark.sql import functions as F

from foliospark.schemas import CATEGORIES
from foliospark.operators.dialects import (REGISTRY, Dialect, block_rows, chandra, deepseek, dots,
                                           page_markdown, parse_responses, register)


def flat(blocks):
    return [(None if b.bbox is None else list(b.bbox), b.category, b.text) for b in blocks]


DOTS = {
    "fenced": ('```json\n[{"bbox": [10, 20, 300, 40], "category": "Title", "text": "Hello"}, '
               '{"bbox": [10, 50, 300, 90], "category": "Page-header", "text": "HDR"}]\n```',
               [([10, 20, 300, 40], "Title", "Hello"), ([10, 50, 300, 90], "Text", "HDR")]),
    "cut off": ('[{"bbox": [1, 2, 3, 4], "category": "Picture"}{"bbox": [5, 6, 7], "category": "Text", '
                '"text": "cut off he',
                [([1, 2, 3, 4], "Picture", ""), ([5, 6, 7], "Text", "cut off he")]),
    "decimals": (r'[{"bbox": [12.5, 2, 3, 4], "category": "Text", "text": "say \"hi\"\nline2"}]',
                 [([12, 5, 2, 3], "Text", 'say "hi"\\nline2')]),
    "key order": ('[{"category":"Title","bbox":[1,2,3,4],"text":"A"},'
                  '{"category":"Table","bbox":[5,6,7,8],"text":"B"}]',
                  [([1, 2, 3, 4], "Table", "A"), ([5, 6, 7, 8], "Text", "B")]),
    "minus": ('[{"bbox": [-5, 2, 3, 4], "category": "formula", "text": ""}]',
              [([5, 2, 3, 4], "Formula", "")]),
    "bare words": ('[{"bbox": [1,2,3,4], bare words here, "category":"Text"}]',
                   [([1, 2, 3, 4], "Text", "bare words here")]),
    "no numbers": ('[{"bbox": [], "category":"Text","text":"nobox"}]', [(None, "Text", "nobox")]),
    "end quote": (r'[{"bbox": [1,2,3,4], "text": "a \"b\""}]', [([1, 2, 3, 4], "Text", 'a "b\\')]),
}


@pytest.mark.parametrize("name", DOTS)
def test_dots_recovery(evaluate, name):
    raw, expected = DOTS[name]
    got = evaluate(lambda c: dots.recovered_blocks(dots.unfenced(c)), [raw])[0]
    assert flat(got) == expected


def test_dots_cleaned(evaluate):
    raw = ["  ", None, "plain prose", DOTS["cut off"][0], '{"text":"t"}', "[]"]
    got = evaluate(dots.cleaned, raw)
    assert [(r.ok, len(r.blocks)) for r in got] == [
        (True, 0), (True, 0), (False, 0), (True, 2), (True, 1), (True, 0)]
    assert got[3].blocks[1].bbox is None
    assert evaluate(dots.parses, raw) == [r.ok for r in got]


def test_dots_hyphen_mode(evaluate):
    names = ["Page-header", "PageHeader", " title ", "nope", "Section-header"]
    assert evaluate(dots.category_of, names) == ["Text", "Page-header", "Title", "Text", "Text"]
    assert evaluate(lambda c: dots.category_of(c, "intended"), names) == [
        "Page-header", "Page-header", "Title", "Text", "Section-header"]


STRICT = [
    ('[{"category":"page-HEADER","text":"t","bbox":[1,2.5,3,4],"extra":{}}]', True),
    ('[{"category":"Nope","text":"t"}]', False),
    ('{"text":"t"}', False),
    ('[{"text":5}]', False),
    ('[{"text":"a","bbox":"1,2"}]', False),
    ('[{"text":"a","bbox":[1,"2"]}]', False),
    ('[{"text":null,"category":null,"bbox":null}]', True),
    ("[1]", False),
    ('[{"text":"a"}] junk', False),
    ('[{"text":"a"},]', False),
    ('[{"text":"a"}] [{"text":"b"}]', False),
    ('[{"text":"a"}],[{"text":"b"}]', False),
    ('[{"text":"a"}]],[[{"text":"b"}]', False),
    ('[{"text":"a"}]} [{"text":"b"}]', False),
    ('[{"text":"a"}],"v":[{"text":"b"}]', False),
    (' [{"text":"] x"}] ', True),
    ('[{"text":1,"category":"Nope","text":"t","category":7}]', True),
    ('[{"text":"t","text":1}]', False),
    ('[{"category":1.5}]', False),
    ('[{"category":99999999999}]', False),
    ('[{"category":true}]', False),
]


def test_strict_json_numbers_and_repeats(evaluate):
    got = evaluate(dots.strict_json, ['[{"text":1,"text":"t","category":0},{"category":18},{"category":99},{"category":-1},'
                                      '{"bbox":[1],"bbox":[1,2,3,4.5],"category":"TABLE"}]'])[0]
    assert [b.category for b in got.blocks] == [CATEGORIES[0], CATEGORIES[18], "99", "-1", "Table"]
    assert got.blocks[0].text == "t" and got.blocks[4].bbox == [1, 2, 3, 4.5]


@pytest.mark.parametrize("raw,ok", STRICT)
def test_strict_json(evaluate, raw, ok):
    got = evaluate(dots.strict_json, [raw])[0]
    assert got.ok is ok
    if ok and "HEADER" in raw:
        assert flat(got.blocks) == [([1, 2.5, 3, 4], "Page-header", "t")]


TAGS = {
    "merged": ("pre<|ref|>title<|/ref|><|det|>[[100,100,200,150],[50,120,300,160]]<|/det|>Hello"
               "<|ref|>table<|/ref|><|det|>oops<|/det|>lost"
               "<|ref|>text<|/ref|><|det|>[[0,0,999,999]]<|/det|>Body",
               [([50, 100, 300, 160], "Title", "Hello"), ([0, 0, 999, 999], "Text", "Body")]),
    "none": ("no tags at all", []),
    "empty list": ("<|ref|>text<|/ref|><|det|>[]<|/det|>x", []),
    "short box": ("<|ref|>text<|/ref|><|det|>[[1,2,3]]<|/det|>x", []),
    "trailing junk": ("<|ref|>text<|/ref|><|det|>[[1,2,3,4]] x<|/det|>x", []),
    "null number": ("<|ref|>text<|/ref|><|det|>[[1,2,3,null]]<|/det|>x", []),
}


@pytest.mark.parametrize("name", TAGS)
def test_deepseek_tags(evaluate, name):
    raw, expected = TAGS[name]
    assert flat(evaluate(deepseek.tagged_blocks, [raw])[0]) == expected


def test_deepseek_parse(evaluate):
    parse = lambda c: deepseek.parse(c, F.lit(1000), F.lit(2000))
    got = [flat(b) for b in evaluate(parse, [TAGS["merged"][0], "no tags at all<｜end▁of▁sentence｜>",
                                             TAGS["empty list"][0], ""])]
    assert got[0][0][1:] == ("Title", "### Hello")
    assert got[0][1] == ([0, 0, 1000, 2000], "Text", "Body")
    assert got[1] == [(None, "Text", "no tags at all")]
    assert got[2] == [(None, "Text", TAGS["empty list"][0])]
    assert got[3] == []


def test_chandra_parse(evaluate):
    parse = lambda c: chandra.parse(c, F.lit(2048), F.lit(1024))
    raw = ['<div data-bbox="[0,512,1024,1024]" data-label="Section-Header"><h1>A</h1></div>',
           '<div data-bbox="bad"><p>x</p></div>',
           '```html\n<div data-bbox="[0,0,1,1]">a<div data-bbox=\'[1,1,2,2]\' data-label=Table>in</div>b'
           '</div><div>skip</div><div data-bbox="[0,0,10,10]">open<div>q</div>\n```',
           '<div class="x">a</div>', '<div data-bbox="[0,0,4,4]" data-label="Text">cut',
           '<div><div data-bbox="[1,1,1,1]">x</div><div data-bbox="[2,2,2,2]">y</div></div>']
    got = [flat(b) for b in evaluate(parse, raw)]
    assert got[0] == [([0, 512, 2048, 1024], "Section-header", "<h1>A</h1>")]
    assert got[1] == [(None, "Text", "<p>x</p>")]
    assert [(c, t) for _, c, t in got[2]] == [
        ("Text", "a<div data-bbox='[1,1,2,2]' data-label=Table>in</div>b"), ("Table", "in"),
        ("Text", "open<div>q</div>")]
    assert got[3] == []
    assert got[4] == [([0, 0, 8, 4], "Text", "cut")]
    assert [t for _, _, t in got[5]] == ["x", "y"]


def test_chandra_scanner(evaluate):
    """Comments, quoted angle brackets, deep nesting, stray and missing ends."""
    parse = lambda c: chandra.parse(c, F.lit(1024), F.lit(1024))
    deep = "".join(f'<div data-bbox="[{k},0,9,9]">{k}' for k in range(300)) + "</div>" * 300
    raw = ['<div data-bbox="[1,2,3,4]" title="a>b" DATA-LABEL=\'Table\'>q<!-- <div data-bbox="[9,9,9,9]">no</div> --><div>i</div></div>',
           "</div><div data-bbox=[1,2,3,4]>a</div></div><script><div data-bbox='[1,1,1,1]'></script>",
           "<div data-bbox='[1,2,3,4]' data-bbox='[5,6,7,8]'><div>in</div>rest", '<div data-bbox="[1,&#50;,3,4]">e</div>', deep, None]
    got = [flat(b) for b in evaluate(parse, raw)]
    assert got[0] == [([1, 2, 3, 4], "Table", 'q<!-- <div data-bbox="[9,9,9,9]">no</div> --><div>i</div>')]
    assert got[1] == [([1, 2, 3, 4], "Text", "a")]
    assert got[2] == [([1, 2, 3, 4], "Text", "<div>in</div>rest")]
    assert got[3] == [([1, 2, 3, 4], "Text", "e")]
    assert [b[0] for b in got[4]] == [[k, 0, 9, 9] for k in range(300)] and got[4][299][2] == "299"
    assert got[5] == []


def test_mixed_table_and_plugged_dialect(spark):
    register("Upper".lower(), Dialect(
        clean=lambda c: c, markdown=lambda b, keep, mode: F.concat_ws("|", F.transform(b, lambda x: x["text"])),
        parse=lambda c, w, h, m="reference": F.array(F.struct(
            F.lit(None).cast("array<float>").alias("bbox"), F.lit("Text").alias("category"),
            F.upper(c).alias("text")))))
    try:
        rows = spark.createDataFrame([
            ("t", 0, "dots", DOTS["fenced"][0], 10, 10), ("t", 1, "DeepSeekOcr", "free", 10, 10),
            ("t", 2, "upper", "abc", 10, 10)],
            "task_id string, page_index int, model_id string, content string, width int, height int")
        parsed = parse_responses(rows)
        blocks = block_rows(parsed, "page_index").orderBy("page_index", "block_no").collect()
        assert [(b.page_index, b.block_no, b.text) for b in blocks] == [
            (0, 0, "Hello"), (0, 1, "HDR"), (1, 0, "free"), (2, 0, "ABC")]
        pages = page_markdown(parsed).orderBy("page_index").collect()
        assert [p.markdown for p in pages] == ["Hello\n\nHDR", "free", "ABC"]
    finally:
        REGISTRY.pop("upper")

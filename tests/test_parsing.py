import decimal
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import name_from_uri
from lodestone.operators.parsing import parse_documents

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def parse(spark, mime, content):
    content = content.encode() if isinstance(content, str) else content
    df = spark.createDataFrame([(bytearray(content), mime)], "content binary, mime_type string")
    row = parse_documents(df).first()
    return [(u.kind, u.text, u.metadata) for u in row.units], row.title, row.error


def texts(spark, mime, content):
    return [t for _, t, _ in parse(spark, mime, content)[0]]


def archive(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return buf.getvalue()


@pytest.mark.parametrize(
    "content,expected",
    [
        ("one line", ["one line"]),
        ("a\nb\n\nc\n\n\n\nd", ["a\nb", "c", "d"]),
        ("", []),
        ("  \n\t\n", []),
        ("  x  \r\n\r\n y\r\n", ["x", "y"]),
        ("a\n \nb", ["a\n \nb"]),
    ],
)
def test_text(spark, content, expected):
    assert texts(spark, "text/plain", content) == expected


def test_text_title(spark):
    assert parse(spark, "text/plain", "\n\nFirst\nsecond")[1] == "First"


def test_markdown_breadcrumbs(spark):
    md = "intro\n# A\ntext a\n## B\ntext b\n### C\ntext c\n## D\n\n# E\n####no space\ntext e\n####### seven"
    units, title, _ = parse(spark, "text/markdown", md)
    assert title == "A"
    assert [(t, m["heading"]) for _, t, m in units] == [
        ("intro", ""),
        ("text a", "# A"),
        ("text b", "# A\n## B"),
        ("text c", "# A\n## B\n### C"),
        ("####no space\ntext e\n####### seven", "# E"),
    ]


def test_markdown_pops_deeper_levels(spark):
    units, _, _ = parse(spark, "text/markdown", "### x\n1\n# y\n2\n### z\n3\n## w\n4\n#\n# \n5")
    assert [m["heading"] for _, _, m in units] == ["### x", "# y", "# y\n### z", "# y\n## w", "# "]


def test_html(spark):
    page = (
        "<html><head><title> T &amp; x </title><style>p{}</style></head><body><nav>menu<div>deep</div></nav>"
        "<h1>Head <b>bold</b></h1><script>var a='</p>'</script><p>one <a href='#'>link</a></p>"
        "<ul><li>i1<ul><li>i2</li></ul></li></ul><pre>x  y\n z</pre><img alt='pic'><p>use <code>f()</code></p>"
        "<table><tr><td>a</td><td>b</td></tr></table><footer>no</footer></body></html>"
    )
    units, title, error = parse(spark, "text/html", page)
    assert (title, error) == ("T & x", None)
    assert units[0][2] == {"heading": "# Head **bold **"}
    body = units[0][1]
    for part in ("one link", "- i1", "  - i2", "```\nx  y\n z\n```", "pic", "use `f()`", "a  | b  |"):
        assert part in body, body
    assert "menu" not in body and "no" not in body.split() and "var a" not in body
    assert parse(spark, "text/html", "<html><body></body></html>")[0] == []


def test_html_nested_skip(spark):
    page = "<body><aside>a<aside>b</aside>c</aside><p>kept</p><header><p>x<p>y</header>tail</body>"
    assert texts(spark, "text/html", page) == ["kept \n\ntail"]


def test_html_formatting_survives_block_boundaries(spark):
    page = "<body><p><b>one<br><p>two</p><p>three</b> four</p><p>five</body>"
    assert texts(spark, "text/html", page) == ["**one \n**\n\n**two **\n\n**three **four \n\nfive"]
    assert texts(spark, "text/html", "<div><em>a</div>b") == ["*a *\n\n*b *"]
    assert texts(spark, "text/html", "<table><tr><td>a<td>b<tr><td>c</table>") == ["a  | b  |\n c  |"]


def test_csv(spark):
    units, _, error = parse(spark, "text/csv", 'a,b\n1, "x, ""y"""\n\n , \n2,z\r\n')
    assert error is None
    assert [t for _, t, _ in units] == ['1\tx, "y"', "2\tz"]
    assert units[0][2] == {"headers": "a\tb", "sheet": "csv"}
    assert parse(spark, "text/csv", "")[0] == [] and parse(spark, "text/csv", "a,b\n")[0] == []
    assert "wrong number" in parse(spark, "text/csv", "a,b\n1\n")[2]
    assert "quoting" in parse(spark, "text/csv", 'a,b\n1,x"y\n')[2]


def test_json(spark):
    doc = '[{"b":{"y":[1,2.50,1e21],"x":true},"a":"s","n":null,"e":""},"v",[],{"k":0.000001}]'
    assert texts(spark, "application/json", doc) == [
        "a: s\nb.x: true\nb.y.0: 1\nb.y.1: 2.5\nb.y.2: 1000000000000000000000",
        ": v",
        "k: 0.000001",
    ]
    assert texts(spark, "application/json", '{"z":1,"a":{"b":false}}') == ["a.b: false\nz: 1"]
    assert parse(spark, "application/json", "{bad")[2].startswith("JSONDecodeError")


def test_xml(spark):
    doc = "<r><rec id='1'>own<a>1</a><b><c>x</c>mixed<c>y</c></b></rec><rec/><o><p> q </p></o></r>"
    units, _, _ = parse(spark, "application/xml", doc)
    assert [(t, m["element"]) for _, t, m in units] == [("a: 1\nb.c: x\nb.c: y", "rec"), ("p: q", "o")]
    assert "ExpatError" in parse(spark, "text/xml", "<r><a></r>")[2]


def test_office(spark):
    w = "<w:document xmlns:w='w'><w:p><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>"
    units, title, _ = parse(spark, DOCX, archive(word__document_xml=w))
    assert [u[:2] for u in units] == [("paragraph", "Ti tle"), ("paragraph", "two")] and title == "Ti tle"

    def slide(*ps):
        return "<s xmlns:a='a'>" + "".join(f"<a:p><a:t>{p}</a:t></a:p>" for p in ps) + "</s>"

    deck = archive(
        ppt__slides__slide1_xml=slide("one", "more"),
        ppt__slides__slide10_xml=slide(""),
        ppt__slides__slide2_xml=slide("two"),
    )
    units, title, _ = parse(spark, PPTX, deck)
    assert [(t, m["slide"]) for _, t, m in units] == [("one\nmore", "1"), ("two", "3")] and title == "one"

    book = archive(
        xl__sharedStrings_xml="<sst><si><t>h1</t></si><si><r><t>h</t></r><r><t>2</t></r></si></sst>",
        xl__worksheets__sheet1_xml="<w><row><c t='s'><v>0</v></c><c t='s'><v>1</v></c></row><row><c><v>5</v></c><c t='inlineStr'><is><t>in</t></is></c></row></w>",
        xl__worksheets__sheet2_xml="<broken",
    )
    units, _, _ = parse(spark, XLSX, book)
    assert units == [("row", "5\tin", {"headers": "h1\th2", "sheet": "sheet1"})]
    assert parse(spark, XLSX, b"not a zip")[2].startswith("BadZipFile")


def test_pdf_markup(spark):
    src = "<b>A</b> one<br/>\ntwo<br/>&#160;<br/>&#160;<br/>B &amp; c<br/>&#160;<br/>"
    assert texts(spark, "application/pdf", src) == ["A one two", "B & c"]


def test_unsupported(spark):
    assert parse(spark, "image/png", b"x")[2] == "unsupported mime type image/png"


def test_name_from_uri(spark):
    cases = {
        "upload://my-file.pdf": "my-file",
        "https://example.com/path/to/doc.pdf": "doc",
        "upload://no-extension": "no-extension",
        "upload://": "",
        "": "",
        "upload://file.tar.gz": "file.tar",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", name_from_uri(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == cases


JSON_FILES = [
    '{"z": 1, "a": {"b": false, "": {"c": "x"}}, "n": null, "e": ""}', "[]", "{}", "3", '"text"', "[1, 2.50, -0.0, 1e3, 1.5E-7, 12345678901234567890, 0.1]",
    '[[["deep", ["er"]], {"k": [[]]}], {"b": 2, "a": [{"x": 1}, {"x": 10}, 3]}]', '{"q\\"uo]te": "br{ack}et [", "é": "ü\\n two"}',
    '{"a": 1, "a": 2}', "{\"list\": [" + ",".join(map(str, range(30))) + "]}", "  [true]  ", '{"x": 123456789.125, "y": 1e22, "w": 100, "v": 1.0}',
]


def flat_json(path, value):
    """The rule, plainly: members by key, elements by place, scalars that are not empty."""
    if isinstance(value, dict):
        return [line for k, v in sorted(value.items()) for line in flat_json(f"{path}.{k}" if path else k, v)]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in flat_json(f"{path}.{i}" if path else str(i), v)]
    if isinstance(value, bool):
        shown = str(value).lower()
    elif isinstance(value, (int, float)):
        shown = format(decimal.Decimal(repr(float(value))).normalize(), "f") if value else "0"
    else:
        shown = value or ""
    return [f"{path}: {shown}"] if shown else []


@pytest.mark.parametrize("text", JSON_FILES)
def test_json_is_unfolded_level_by_level(spark, text):
    root = json.loads(text)
    elements = root if isinstance(root, list) else [root]
    wanted = [t for t in ("\n".join(flat_json("", e)).strip() for e in elements) if t]
    assert texts(spark, "application/json", text) == wanted


def test_json_needs_no_python(spark):
    files = spark.createDataFrame([("application/json", bytearray(b"[1]"))], "mime_type string, content binary")
    rows = parse_documents(files.where("mime_type = 'application/json'")).select("units")
    assert [r.units[0].text for r in rows.collect()] == [": 1"]
    for broken in ("{bad", "", "[1", "nul"):
        assert parse(spark, "application/json", broken)[2].startswith("JSONDecodeError")


def test_grouped_files_are_not_built_twice(spark, sf):
    """Counting the splits of grouped rows would run their shuffles before the query does."""
    from queries import upkeep

    for build, tables in ((upkeep.nested_orders, 2), (upkeep.order_files, 1), (upkeep.talk_files, 1)):
        spark.sparkContext.setJobGroup(build.__name__, "")
        build(spark, sf)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(build.__name__)) <= tables  # a footer each
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_json_looks_for_containers_without_schemas(spark):
    """A schema of a container is made from all that it holds; only scalars are asked for theirs."""
    from lodestone.functions import json_text

    nested = "[" * 3 + '{"a": [{"b": 100.50}, "\\"[[[", -0.0, 12, 1e3]}]' + "]" * 2
    assert texts(spark, "application/json", nested) == ['0.0.a.0.b: 100.5\n0.0.a.1: "[[[\n0.0.a.2: 0\n0.0.a.3: 12\n0.0.a.4: 1000']
    assert str(json_text.json_texts(F.col("t"), F.col("v"))).count("schema_of_variant") == 1

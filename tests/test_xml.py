import pytest
from pyspark.sql import functions as F

from xylem import errors as X
from xylem import validation as V
from xylem.entities import EntityRegistry
from xylem.operators import build as B
from xylem.operators.xpath import extract, xpath
from xylem.plans.ast import parse
from xylem.sources.shred import shred, shred_xml
from xylem.streaming.sax import BlockHandler, drive

LIBRARY = """<library><book id="1" price="7.25"><title lang="en">A &amp; B</title><author>X</author></book><!--c--><book id="2" price="40.5"><title>C<i>D</i></title></book>
<book id="3" price="3.75"><title>E</title><author>Y</author><author>Z</author></book><?go on?></library>"""


@pytest.fixture(scope="module")
def nodes(spark):
    n = shred(spark.createDataFrame([(1, LIBRARY)], "doc_id long, xml string"))
    return n.cache()


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("count(//book)", 3.0), ("count(//book[@price < 8])", 2.0), ("round(sum(//book/@price) * 100)", 5150.0), ("string(//title)", "A & B"), ("string(//book[2]/title)", "CD"),
        ("count(//book[author])", 2.0), ("count(//book[not(author)])", 1.0), ("count(//author | //title | //i)", 7.0), ("string(//book[last()]/@id)", "3"), ("string(//author[last()])", "X"),
        ("string((//author)[last()])", "Z"), ("7 mod -3", 1.0), ("-7 mod 3", -1.0), ("string(1 div 0)", "Infinity"), ("string(0 div 0)", "NaN"), ("substring('12345', 0, 3)", "12"),
        ("substring('12345', 1.5, 2.6)", "234"), ("substring-before('a-b', '-')", "a"), ("substring-after('a-b', '-')", "b"), ("substring-after('ab', '')", "ab"), ("translate('bar','abc','AB')", "BAr"),
        ("normalize-space('  a \t b ')", "a b"), ("string-length('a😀b')", 3.0), ("round(-3.5)", -3.0), ("concat('a', 1, true())", "a1true"), ("string(0.5)", "0.5"), ("string(-0.00001)", "-0.00001"),
        ("//book/@id = 2", True), ("//book/@id != 2", True), ("//none = 1", False), ("//none != 1", False), ("boolean(//none)", False), ("'a' = 'b' or 1 < 2", True), ("count(//title/text())", 3.0),
        ("count(//comment())", 1.0), ("count(//processing-instruction('go'))", 1.0), ("count(//i/ancestor::*)", 3.0), ("count(//book[1]/following-sibling::book)", 2.0), ("count(//book[3]/preceding::title)", 2.0),
        ("name(//book[1]/@*[2])", "price"), ("string(//book[@id = '3']/author[2])", "Z"), ("count(//book[position() mod 2 = 1])", 2.0), ("count(id('1 3'))", 2.0),
    ],
)
def test_xpath_values(nodes, expression, expected):
    assert [r["value"] for r in xpath(nodes, expression).collect()] == [expected]


def test_compat_differs_where_it_should(nodes):
    value = lambda e: xpath(nodes, e, semantics="compat").first()["value"]
    assert value("-7 mod 3") == 2.0 and value("round(-3.5)") == -4.0 and value("count(//BOOK)") == 3.0 and value("translate('abc','ab','ba')") == "aac"


def test_namespaces_and_lang(spark):
    n = shred(spark.createDataFrame([(1, '<a xmlns="u" xmlns:p="v" xml:lang="en-GB"><p:b/><b/></a>')], "doc_id long, xml string"))
    assert xpath(n, "count(//x:b)", namespaces={"x": "v"}).first()["value"] == 1.0
    assert xpath(n, "count(//b)").first()["value"] == 0.0
    assert extract(n, "//*[local-name() = 'b']", {"l": "lang('en')"}).filter("l").count() == 2
    with pytest.raises(X.XPathContextError):
        xpath(n, "//q:b")


@pytest.mark.parametrize("bad", ["", "//", "a[", "foo(1)", "count()", "a b", "$"])
def test_syntax_errors(bad):
    with pytest.raises(X.XPathError):
        parse(bad)


def test_bad_documents_keep_their_row(spark):
    n = shred(spark.createDataFrame([(1, "<a>"), (2, None), (3, "<a x:y='1'/>"), (4, "<a/>")], "doc_id long, xml string"))
    got = {r["doc_id"]: r["error"] for r in n.filter("kind = 'document'").collect()}
    assert got[4] is None and all(got[k] for k in (1, 2, 3))
    assert {r["doc_id"]: r["value"] for r in xpath(n, "count(//a)").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    assert shred(spark.createDataFrame([], "doc_id long, xml string")).count() == 0


def test_round_trip(spark):
    xml = '<a k="1&quot;&lt;"><b></b>x &amp; y<![CDATA[<z>]]><!--c--><?p d?>&unknown;</a>'
    once = shred(spark.createDataFrame([(1, xml)], "doc_id long, xml string"))
    out = B.serialize(once).first()["xml"]
    assert out == xml
    assert B.serialize(once, expand_empty=False, declaration=True).first()["xml"].startswith('<?xml version="1.0" encoding="UTF-8"?><a k="1&quot;&lt;"><b/>')


def test_html(spark):
    n = shred(spark.createDataFrame([(1, "<!DOCTYPE html><p>a<p>b<br><ul><li>1<li>2</ul>")], "doc_id long, xml string"), backend="html")
    assert xpath(n, "count(//p)").first()["value"] == 2.0 and xpath(n, "count(//ul/li)").first()["value"] == 2.0


def test_rules_and_entities():
    for f, bad in ((V.check_element_name, "1a"), (V.check_comment, "a--b"), (V.check_pi_target, "xml"), (V.check_entity_name, "a b")):
        with pytest.raises(X.ValidationError):
            f(bad)
    with pytest.raises(X.NamespaceError):
        V.check_uri("", "p")
    with pytest.raises(X.ValidationError):
        V.check_declaration("2.0")
    r = EntityRegistry()
    assert r.code_point("eacute") == 233 and r.primary_name(233) == "eacute" and r.should_restore(233) and not r.should_restore(38)


def test_handlers():
    seen = []
    drive("<a><b/>x</a>", BlockHandler(start_element=lambda n, a, s: seen.append(n), characters=seen.append))
    assert seen == ["a", "b", "x"]
    with pytest.raises(Exception, match="mismatched"):
        drive("<a></b>", BlockHandler())


def test_builder_escapes(spark):
    df = spark.createDataFrame([("a<b", 'q"', None)], "t string, u string, v string")
    got = df.select(B.document(B.el("x", {"u": F.col("u"), "v": F.col("v")}, F.col("t"), B.cdata("]]>"))).alias("x")).first()["x"]
    assert got == '<x u="q&quot;">a&lt;b<![CDATA[]]]]><![CDATA[>]]></x>'
    with pytest.raises(X.DocumentStructureError):
        B.document(B.el("a"), B.el("b"))


def test_declarations_after_a_long_prolog(spark):
    from xylem.sources.shred import declarations

    long = '<?xml version="1.0" encoding="utf-8"?>\n<!-- ' + "licence <!DOCTYPE no> " * 400 + "-->\n" + "<?pi a > b?>\n" * 3000
    rows = [(1, long + '<!DOCTYPE r PUBLIC "-//x" "y.dtd"><r/>'), (2, long + "<r><![CDATA[<!DOCTYPE no>]]></r>"), (3, "<!DOCTYPE " + "n" * 5000 + ' SYSTEM "s.dtd"><r/>'), (4, "<r/>"), (5, None)]
    got = {r["doc_id"]: r for r in declarations(spark.createDataFrame(rows, "doc_id long, xml string")).collect()}
    assert [got[1][k] for k in ("version", "doctype_name", "external_id", "system_id")] == ["1.0", "r", "-//x", "y.dtd"]
    assert got[2]["doctype_name"] is None and got[3]["doctype_name"] == "n" * 5000 and got[3]["system_id"] == "s.dtd" and got[4]["doctype_name"] is None


def test_declared_encodings():
    from xylem.errors import ParseError
    from xylem.sources.shred import decode

    text = '<?xml version="1.0" encoding="{}"?><a>é</a>'
    for name in ("UTF-8", "ISO-8859-1", "windows-1252"):
        assert decode(text.format(name).encode(name)) == text.format(name)
    assert decode("<a>é</a>".encode("utf-16")) == decode("<a>é</a>".encode("utf-16-le")) == "<a>é</a>"
    assert decode("<a>é</a>".encode("latin-1"), "latin-1") == "<a>é</a>"
    with pytest.raises(ParseError):
        decode(text.format("UTF-8").encode("latin-1"))
    assert [r[8] for r in shred_xml(text.format("ISO-8859-1")) if r[4] == "text"] == ["é"]  # a decoded text stays what it is
    assert [r[8] for r in shred_xml(text.format("UTF-16")) if r[4] == "text"] == ["é"]


def test_recovery_keeps_what_was_read():
    rows = shred_xml("<a><b>x</b><c>y</a>", strict=False)
    assert [r[6] for r in rows if r[4] == "element"] == ["a", "b", "c"] and [r[8] for r in rows if r[4] == "text"] == ["x", "y"]


def test_names_that_an_expression_needs():
    from xylem.plans.ast import names_of

    assert names_of("count(/order/line[@q > 30])", "string(@n)") == {"order", "line", "q", "n"}
    assert names_of("a/b[position() = last()] | //c//d") == {"a", "b", "c", "d"}
    for e in ("a/*", "//a[1]", "..", "string()", "id('x')", "namespace::p", "a/text()", "string(/)", "a[lang('en')]"):
        assert names_of(e) is None


def test_scan_keeps_all_text_of_named_elements(spark):
    from xylem.operators.xpath import scan, xpath

    df = spark.createDataFrame([(1, "<r><a>x<b>y<c>z</c></b></a><d>no</d><e k='1'/></r>")], "doc_id long, xml string")
    for e, want in (("string(/r/a)", "xyz"), ("string(//e/@k)", "1"), ("count(/r/d) + count(/r/e)", 2.0)):
        assert xpath(scan(df, e), e).first()["value"] == want

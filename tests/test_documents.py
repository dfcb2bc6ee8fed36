"""Documents against node tables and SQL: the same rows, in one pass, in batches of bounded size."""

import duckdb
import pyarrow as pa
import pytest
import test_xml
from pyspark.sql import functions as F

from xylem import errors as X
from xylem import queries as Q
from xylem.operators import build as B
from xylem.operators import documents as D
from xylem.operators import mutate as M
from xylem.operators.documents import Documents
from xylem.operators.xpath import extract, xpath
from xylem.plans.ast import parse
from xylem.plans.local import Local
from xylem.schema import NODE_COLUMNS
from xylem.sources import shred as S

SF, LIBRARY = "/root/testdata/sf0.001", test_xml.LIBRARY


class Caught:
    """Stands for a DataFrame and keeps the function that mapInArrow is given."""

    dtypes = [("doc_id", "bigint"), ("xml", "string")]

    def __getitem__(self, name):
        return self

    def cast(self, kind):
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, run, ddl):  # noqa: N802
        self.run = run
        return self


def batches(of, texts):
    """What of(df) yields on a worker that is given all texts in one batch."""
    caught = of(Caught())
    return list(caught.run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "xml"])])))


@pytest.fixture(scope="module")
def library(spark):
    df = spark.createDataFrame([(1, LIBRARY), (2, "<library/>"), (3, None), (4, "<a>")], "doc_id long, xml string").cache()
    return Documents(df), S.shred(df).cache()


@pytest.mark.parametrize(("expression", "expected"), test_xml.test_xpath_values.pytestmark[0].args[1])
def test_values_of_a_tree(expression, expected):
    v, _ = Local().value(parse(expression))
    got = v(S.scan_xml(LIBRARY), 0, 0, 0)
    assert got == expected and type(got) is type(expected)


@pytest.mark.parametrize("expression", ["//book[2]/preceding-sibling::node()", "//i/ancestor-or-self::*", "//title/following::*", "//author/preceding::*[1]", "//book/@*", "(//author | //title)[last()]", "//*[@lang]/.."])
def test_node_sets_like_the_node_table(library, expression):
    docs, nodes = library
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(docs.xpath(expression)) == rows(xpath(nodes, expression)) != []


def test_records_like_the_node_table(library):
    docs, nodes = library
    columns = {"id": "@id", "none": "@none", "author": "author", "n": "count(following-sibling::book[1]/author) + 1", "more": "@price > preceding-sibling::book/@price", "name": "name(*[last()])", "last": "boolean(following::book)"}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(docs.extract("//book", columns)) == rows(extract(nodes, "//book", columns))


def test_changes_like_the_node_table(spark, library):
    docs, nodes = library
    new = S.shred(spark.createDataFrame([(0, "<new k='1'>t<m/></new>")], "doc_id long, xml string")).drop("doc_id", "error")
    markup, books = "<new k='1'>t<m/></new>", xpath(nodes, "//book")
    same = [(docs.insert("//book", markup, w), M.insert(nodes, books, new, w)) for w in ("first", "last", "before", "after")]
    same += [(docs.remove("//book[author]"), M.remove(nodes, xpath(nodes, "//book[author]"))), (docs.replace("//title", markup), M.replace(nodes, xpath(nodes, "//title"), new))]
    same += [(docs.set_attribute("//book", k, "<v>"), M.set_attribute(nodes, books, k, "<v>")) for k in ("id", "more")]
    rows = lambda df: sorted((r["doc_id"], r["xml"]) for r in df.collect())
    for changed, table in same:
        assert rows(changed.serialize()) == rows(B.serialize(table))


def test_nested_targets():
    t = S.scan_xml("<a><b><b>x</b></b></a>")
    at, new = Local().nodes(parse("//b"))(t, 0), S.scan_xml("<n/>")
    from xylem.sources.tree import inserted, markup, replaced

    assert markup(inserted(t, at, new, "last")) == "<a><b><b>x<n></n></b><n></n></b></a>"
    assert markup(inserted(t, at, new, "after")) == "<a><b><b>x</b><n></n></b><n></n></a>"
    assert markup(replaced(t, at, new)) == "<a><n></n></a>" and markup(replaced(t, at, None), expand_empty=False) == "<a/>"
    assert replaced(t, at, new).rows() == S.scan_xml("<a><n/></a>").rows()


def test_markup_as_it_was():
    xml = '<?xml version="1.0"?><!DOCTYPE a SYSTEM "s"><a xmlns="u" xmlns:p="v" k="1&quot;&lt;"><p:b p:k="2"></p:b>x &amp; y<![CDATA[<z>]]><!--c--><?p d?>&unknown;</a>'
    from xylem.sources.tree import markup

    assert markup(S.scan_xml(xml)) == xml


def test_bad_expressions_fail_on_the_driver(library):
    docs, _ = library
    for e in ("//q:b", "count(1)", "position()", "$v", "translate('a', @b, 'c')"):
        with pytest.raises(X.XPathError):
            docs.xpath(e)


ONE_PASS = ["mutate_set_attribute", "mutate_insert", "mutate_remove", "mutate_replace", "order_axes", "order_position_first", "order_position_last", "order_position_range", "order_position_chained", "order_position_filtered", "order_filter_expression", "order_nested_predicate", "order_line_of_parent", "order_count", "order_count_descendants", "order_predicate_number", "order_predicate_boolean", "order_sum_quantity", "order_average_quantity", "order_exists", "order_not_exists", "order_union_count", "order_arithmetic", "order_division_by_zero", "order_variable", "order_compare_sets", "order_compat_mod", "order_descendant_or_self", "serialize_same", "roundtrip", "attribute_maps", "recovered_documents", "declared_encoding", "fn_string", "fn_number", "fn_boolean_and_node", "fn_lang", "fn_id", "talk_turns", "ns_query"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_one_pass(spark, name):
    """Documents are built with one exchange at most; asking, changing and writing them adds no join, exchange or kept table."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1 and "Join" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("name", [n for n in ONE_PASS if n in Q.ORACLE_SQL and n not in ("fn_id", "talk_turns", "fn_lang")])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(str).itertuples(index=False)))
    assert rows(df.toPandas()) == rows(con.sql(Q.ORACLE_SQL[name]).df())


LONG = "<r>" + "<e k='1'>t</e>" * 60_000 + "</r>"


def test_batches_are_bounded():
    for texts in ([LONG], ["<r>" + "<e k='1'>t</e>" * 20 + "</r>"] * 3_000):
        rows = batches(S.shred, texts)
        assert max(b.num_rows for b in rows) < 2 * S.STEP and sum(b.num_rows for b in rows) == sum(2 + 3 * x.count("<e ") for x in texts)
        found = batches(lambda df: Documents(df).extract("//e", {"k": "@k"}), texts)
        assert max(b.num_rows for b in found) <= D.ROWS and sum(b.num_rows for b in found) == sum(x.count("<e ") for x in texts)


def test_few_files_are_spread_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("fn_boolean_and_node", "recovered_documents"):
        assert Q.QUERIES[name](spark, SF).rdd.getNumPartitions() >= cores
    many = spark.range(100, numPartitions=2 * cores)
    assert Q.spread(many) is many


def test_a_node_table_is_changed_in_one_pass(spark, library):
    """One exchange numbers it anew: no window, no join, and one copy kept."""
    from unittest import mock

    _, nodes = library
    kept = []
    with mock.patch.object(M, "settle", lambda df: kept.append(df) or df):
        M.renumber(nodes.withColumn("_key", F.array(F.col("pre").cast("long"))))
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan
    rows = lambda df: sorted(map(str, df.select("doc_id", *NODE_COLUMNS).collect()))
    assert rows(kept[0]) == rows(nodes)

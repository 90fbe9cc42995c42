"""Small cases with given answers: rules that tables of the driver don't reach. Each has SQL that says what comes out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import paths
from larkspur.functions import predicates as P
from larkspur.functions.formula.compiler import Definition
from larkspur.operators import clustering as C
from larkspur.operators import collection, derived
from larkspur.operators import schema as S
from larkspur.sources import markdown
from larkspur.streaming import watch
from tests.test_oracle import plain

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (sql, f)
        return f

    return add


_NOTE = "---\ntitle: Hi\nprice: 12.50\ntags: [a, '1']\nclient: \"[[clients/acme|Acme]]\"\ndraft: true\nwhen: 2024-01-02\nnone: ~\n---\nintro [[x|X]] here\n\n# One\n\ntext [l](sub/y.md#h) and [e](http://z) ![i](i.md)\n\n```\n# no\n[c](c.md) [[w]]\n```\n\n## Two\nmore\n\nThree\n=====\nend [p](p.pdf)\n"


def _note(spark):
    rows = [("d/n.md", _NOTE, 5), ("plain.md", "no front matter\n", 6), ("bad.md", "---\na: [1\n---\nbody\n", 7), ("open.md", "---\na: 1\n", 8), ("empty.md", "", 9)]
    return markdown.parse(spark.createDataFrame(rows, "path string, text string, modified_at long").select("path", F.col("text").cast("binary").alias("content"), "modified_at"))


def _computed(spark, rows, definitions):
    files = spark.createDataFrame(rows, "path string, metadata string")
    return derived.formulas(files, definitions).select("path", "field", "value", "code")


_ERRORS = {
    "null_access": "a.b.c", "invalid_number": "Number('x')", "type_mismatch": "a < 1", "undefined_result": "[].find(x => x)", "result_type": "'text'", "math_domain": "Math.log(0)", "range_error": "'a'.repeat(-1)",
    "empty_reduce": "[].reduce((p, q) => p + q)", "unknown_identifier": "nothing", "loose_equality": "1 == 1", "forbidden_identifier": "eval", "invalid_json": "JSON.parse('{')", "invalid_uri": "decodeURIComponent('%')",
    "invalid_date": "Date.parse('2024-01-01T00:00')", "unsupported_call": "'a'.matchAll('b')", "invalid_regex": "/a(?=b)/.test('ab')", "evaluation_limit": "('x'.repeat(9000)).split('').map(x => 'y'.repeat(9).split('').map(z => z))", "number_overflow": "10 ** 28 * 10",
    "dependency_failed": "null_access + 1", "dependency_cycle": "dependency_cycle + 1", "division_by_zero": "1 % 0", "forbidden_property": "a.constructor", "unsupported_callback": "[1].map(1)", "syntax_error": "1 +", "unsupported_syntax": "new Date()",
}


def _client_rows():
    return [
        ("clients/acme.md", '{"domain":"acme.example","tier":2}'), ("clients/beta.md", '{"tier":3}'), ("contacts/alice.md", '{"client":"[[clients/acme]]"}'), ("contacts/bob.md", '{"client":["[[clients/beta]]","clients/acme.md","[[clients/acme]]"]}'),
        ("contacts/carl.md", '{"client":"[[clients/none]]"}'), ("contacts/dora.md", '{"client":"plain words"}'), ("contacts/eve.md", '{"name":"e"}'), ("invoices/one.md", '{"client":"[[clients/acme]]","subtotal":10.1,"tax":0.2}'), ("invoices/two.md", '{"client":"[[clients/acme]]","subtotal":20.2,"tax":0.3}'),
    ]


def _derive(spark, definitions, formulas=()):
    files = spark.createDataFrame(_client_rows(), "path string, metadata string")
    related = collection.relations(files)
    first = derived.formulas(files, list(formulas)) if formulas else None
    return derived.derive(files, related, definitions, first).select("path", "field", "value", "code")


@query("SELECT name, field_type, occurrences::BIGINT AS occurrences FROM (VALUES ('a', 'Mixed', 2), ('b', 'Boolean', 1), ('d', 'Date', 2), ('e', 'List', 2), ('f', 'File', 1), ('j', 'Json', 2), ('m', 'Mixed', 1), ('r', 'Relation', 3), ('s', 'String', 1)) t(name, field_type, occurrences)")
def schema_infer_kinds(spark, d):
    rows = [
        ("x/1.md", '{"a":1,"b":true,"d":"2024-99-99","e":[],"f":"[[pic.png]]","j":{"k":1},"r":"[[n]]","s":"t","z":null}'),
        ("x/2.md", '{"a":"1","d":"2024-01-01T00:00:00Z","e":["q",1],"j":[[1]],"m":["[[a]]","[b](c.pdf)"],"r":["[[a|b]]","x/y.md"]}'), ("y.md", '{"r":"[t](u.md#h)"}'), ("z.md", None), ("w.md", "[1]"),
    ]
    return S.infer(spark.createDataFrame(rows, "path string, metadata string")).select("name", "field_type", "occurrences")


@query("SELECT path, title, title_source FROM (VALUES ('a/b.md', 'T', 'title'), ('a/c.d.md', 'c.d', 'stem'), ('e.md', 'e', 'stem'), ('f.md', 'f', 'stem')) t(path, title, title_source)")
def title_derivation(spark, d):
    rows = [("a/b.md", '{"title":"T"}'), ("a/c.d.md", '{"title":"  "}'), ("e.md", None), ("f.md", "{}")]
    q = collection.Query(recursive=True)
    return collection.rows(spark.createDataFrame(rows, "path string, metadata string"), q).select("path", "title", "title_source")


@query("SELECT path, pos FROM (VALUES ('c.md', 1), ('b.md', 2), ('a.md', 3), ('d.md', 4), ('f.md', 5), ('e.md', 6), ('g.md', 7)) t(path, pos)")
def sort_exact_decimals(spark, d):
    rows = [("a.md", '{"v":10}'), ("b.md", '{"v":9.5}'), ("c.md", '{"v":-0.1}'), ("d.md", '{"v":12345678901234567890.5}'), ("e.md", '{"v":"b"}'), ("f.md", '{"v":"a"}'), ("g.md", '{"v":null}')]
    q = collection.Query(sort="v", recursive=True)
    got = collection.page(collection.rows(spark.createDataFrame(rows, "path string, metadata string"), q), q)
    return spark.createDataFrame([(r.path, i + 1) for i, r in enumerate(got.select("path").collect())], "path string, pos int")


@query("SELECT * FROM (VALUES ('d/n.md#0', '', 1, 2), ('d/n.md#1', 'One', 3, 11), ('d/n.md#2', 'One > Two', 12, 14), ('d/n.md#3', 'Three', 15, 17), ('plain.md#0', '', 1, 1), ('bad.md#0', '', 1, 1), ('open.md#0', '', 1, 2)) t(chunk_id, trail, start_line, end_line)")
def heading_sections(spark, d):
    return markdown.chunks(_note(spark)).select("chunk_id", F.array_join("trail", " > ").alias("trail"), "start_line", "end_line")


@query("SELECT * FROM (VALUES ('x', 'X', 1), ('w', 'w', 9)) t(target, text, line)")
def wikilinks(spark, d):
    return markdown.links(_note(spark)).where("is_wikilink AND field IS NULL").select("target", "text", "line")


@query("SELECT * FROM (VALUES ('sub/y.md#h', 'l', 5)) t(target, text, line)")
def md_links(spark, d):
    return markdown.links(_note(spark)).where("NOT is_wikilink AND field IS NULL").select("target", "text", "line")


@query("SELECT 'd/n.md' AS source, 'client' AS field, 'clients/acme' AS target, 'Acme' AS text")
def front_matter_links(spark, d):
    return markdown.links(_note(spark)).where("field IS NOT NULL").select("source", "field", "target", "text")


@query("""SELECT * FROM (VALUES ('d/n.md', '{"title":"Hi","price":12.50,"tags":["a","1"],"client":"[[clients/acme|Acme]]","draft":true,"when":"2024-01-02","none":null}'), ('plain.md', NULL), ('bad.md', NULL), ('open.md', NULL), ('empty.md', NULL)) t(path, metadata)""")
def front_matter_split(spark, d):
    return _note(spark).select("path", "metadata")


@query("SELECT * FROM (VALUES ('a.md', 'v2', 'created'), ('b.md', NULL, 'deleted'), ('c.md', 'moved', 'created'), ('old.md', NULL, 'deleted'), ('r.md', 'back', 'created')) t(path, content, kind)")
def debounced_events(spark, d):
    rows = [("a.md", "created", 1, "v1", None), ("a.md", "created", 2, "v2", None), ("b.md", "modified", 1, "x", None), ("b.md", "deleted", 3, None, None), ("old.md", "renamed", 4, "moved", "c.md"), ("r.md", "deleted", 5, None, None), ("r.md", "created", 5, "back", None), ("node_modules/x.md", "created", 1, "n", None), ("t.txt", "created", 1, "n", None)]
    ev = spark.createDataFrame(rows, "path string, kind string, s long, content string, new_path string").select("path", "kind", F.timestamp_seconds("s").alias("ts"), "content", "new_path")
    return watch.debounced(watch.classify(ev)).select("path", "content", "kind")


@query("SELECT scope, inside FROM (VALUES ('docs', 'docs/guide.md,docs/x/y.md'), ('docs/', 'docs/guide.md,docs/x/y.md'), ('./docs/x', 'docs/x/y.md'), ('.', 'a.md,docs-old/z.md,docs/guide.md,docs/x/y.md')) t(scope, inside)")
def scope_segments(spark, d):
    df = spark.createDataFrame([(p,) for p in ("docs/guide.md", "docs-old/z.md", "docs/x/y.md", "a.md")], "path string")
    out = None
    for s in ("docs", "docs/", "./docs/x", "."):
        one = df.where(paths.in_scope(F.col("path"), s)).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("inside")).select(F.lit(s).alias("scope"), "inside")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES ('invoices/a.md', 'exact_sum', '0.3', NULL), ('invoices/b.md', 'exact_sum', '0.4', NULL), ('invoices/a.md', 'doubled', '0.6', NULL), ('invoices/b.md', 'doubled', '1.2', NULL),
('invoices/a.md', 'unit_total', '0.3', NULL), ('invoices/b.md', 'unit_total', '0.15', NULL), ('invoices/a.md', 'broken', NULL, 'division_by_zero'), ('invoices/b.md', 'broken', '0.2', NULL)) t(path, field, value, code)""")
def formula_exact_decimals(spark, d):
    rows = [("invoices/a.md", '{"price":0.1,"fee":0.2,"quantity":2,"divisor":0,"Unit Price":0.15}'), ("invoices/b.md", '{"price":0.2,"fee":0.2,"quantity":3,"divisor":1,"Unit Price":0.05}')]
    return _computed(spark, rows, [Definition("exact_sum", "price + fee", "number"), Definition("doubled", "exact_sum * quantity", "number"), Definition("unit_total", 'fields["Unit Price"] * quantity', "number"), Definition("broken", "price / divisor", "number")])


@query("SELECT field, field AS code FROM (VALUES " + ", ".join(f"('{k}')" for k in _ERRORS) + ") t(field)")
def formula_errors(spark, d):
    """Every definition fails with the code it is named for, in data, not as an exception."""
    definitions = [Definition(k, s, "number" if k == "result_type" else "json") for k, s in _ERRORS.items()]
    return _computed(spark, [("x.md", '{"a":null}')], definitions).select("field", "code")


@query("""SELECT * FROM (VALUES ('contacts/alice.md', '2', NULL), ('contacts/bob.md', '[3,2,2]', NULL), ('contacts/carl.md', NULL, 'relation_unresolved'), ('contacts/dora.md', NULL, 'relation_field_type'), ('contacts/eve.md', 'null', NULL)) t(path, value, code)""")
def lookup_list(spark, d):
    return _derive(spark, [derived.Lookup("tiers", "client", "tier", "contacts")]).select("path", "value", "code")


@query("""SELECT * FROM (VALUES ('contacts/alice.md', '"acme.example"', NULL), ('contacts/bob.md', NULL, 'target_field_missing'), ('contacts/carl.md', NULL, 'relation_unresolved'), ('contacts/dora.md', NULL, 'relation_field_type'), ('contacts/eve.md', 'null', NULL)) t(path, value, code)""")
def lookup_missing(spark, d):
    return _derive(spark, [derived.Lookup("client_domain", "client", "domain", "contacts")]).select("path", "value", "code")


@query("""SELECT * FROM (VALUES ('contacts/alice.md', '2', NULL), ('contacts/bob.md', '7', NULL), ('contacts/carl.md', NULL, 'relation_unresolved'), ('contacts/dora.md', NULL, 'relation_field_type'), ('contacts/eve.md', '0', NULL)) t(path, value, code)""")
def rollup_outgoing(spark, d):
    return _derive(spark, [derived.Rollup("tiers", "client", "tier", scope="contacts")]).select("path", "value", "code")


@query("""SELECT * FROM (VALUES ('clients/acme.md', 'invoice_total', '30.8', NULL), ('clients/beta.md', 'invoice_total', '0', NULL), ('clients/acme.md', 'most', '20.5', NULL), ('clients/beta.md', 'most', NULL, 'type_mismatch'),
('clients/acme.md', 'people', NULL, 'relation_unresolved'), ('clients/beta.md', 'people', NULL, 'relation_unresolved')) t(path, field, value, code)""")
def rollup_incoming(spark, d):
    total = Definition("total", "subtotal + tax", "number")
    rolls = [derived.Rollup("invoice_total", "client", "total", "incoming", scope="clients", relation_scope="invoices"), derived.Rollup("most", "client", "total", "incoming", "Math.max(values[0], values[1])", "clients", "invoices", "number"), derived.Rollup("people", "client", "name", "incoming", "values.length", "clients", "contacts")]
    return _derive(spark, rolls, [total])


@query("SELECT * FROM (VALUES ('a', 'dependency_cycle'), ('b', 'dependency_cycle')) t(field, code)")
def derived_cycle(spark, d):
    return _derive(spark, [derived.Lookup("a", "client", "b", "contacts"), derived.Lookup("b", "client", "a", "contacts")]).select("field", "code").distinct()


@query("SELECT * FROM (VALUES ('t/a.md', '\"root\"', NULL), ('t/b.md', '\"root\"', NULL), ('t/c.md', '\"root\"', NULL), ('t/x.md', NULL, 'dependency_cycle'), ('t/y.md', NULL, 'dependency_cycle'), ('t/z.md', NULL, 'relation_unresolved')) t(path, value, code)")
def lookup_recursive(spark, d):
    rows = [("r.md", '{"top":"root"}'), ("t/a.md", '{"up":"[[../r]]"}'), ("t/b.md", '{"up":"[[t/a]]"}'), ("t/c.md", '{"up":"t/b.md"}'), ("t/x.md", '{"up":"t/y.md"}'), ("t/y.md", '{"up":"[[t/x]]"}'), ("t/z.md", '{"up":"t/none.md"}')]
    files = spark.createDataFrame(rows, "path string, metadata string")
    return derived.derive(files, collection.relations(files), [derived.Lookup("top", "up", "top", "t")]).select("path", "value", "code")


@query("SELECT * FROM (VALUES ('a/b/c.md', '../x', 'a/x.md'), ('a/b/c.md', './y.md#frag', 'a/b/y.md'), ('c.md', 'd/../../e', 'e.md'), ('a/c.md', 'n\\z', 'a/n/z.md'), ('a/c.md', '#top', '')) t(source, target, resolved)")
def resolve_links_relative(spark, d):
    df = spark.createDataFrame([("a/b/c.md", "../x"), ("a/b/c.md", "./y.md#frag"), ("c.md", "d/../../e"), ("a/c.md", "n\\z"), ("a/c.md", "#top")], "source string, target string")
    return df.select("source", "target", paths.resolve_link(F.col("source"), F.col("target")).alias("resolved"))


@query("SELECT k, e, i FROM (VALUES ('1', true, false), ('2', false, true), ('3', true, true), ('4', false, false), ('5', false, false), ('6', false, false)) t(k, e, i)")
def filter_relation_aware(spark, d):
    rows = [("1", '{"client":"[[clients/acme|Acme]]"}'), ("2", '{"client":["[x](clients/b.md)"]}'), ("3", '{"client":["clients/acme.md","[[clients/b]]"]}'), ("4", '{"client":null}'), ("5", "{}"), ("6", None)]
    df = spark.createDataFrame(rows, "k string, m string")
    return df.select("k", P.conjunction(F.col("m"), [P.Equals("client", "clients/acme")]).alias("e"), P.conjunction(F.col("m"), [P.In("client", ("[[clients/b]]", "zzz"))]).alias("i"))


@query("SELECT * FROM (VALUES (1, 'rust programming / tools'), (2, 'a / b / c'), (3, 'x y / z')) t(cluster_id, label)")
def cluster_label_rule(spark, d):
    rows = [(1, 1, "rust programming"), (1, 2, "rust"), (1, 3, "tools"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (2, 4, "d"), (3, 1, "x y"), (3, 2, "y"), (3, 3, "z"), (3, 4, "x")]
    return C.labels(spark.createDataFrame(rows, "cluster_id int, rank int, term string"))


@pytest.mark.parametrize("name", [*CASES])
def test_case(spark, name):
    sql, f = CASES[name]
    df = f(spark, "")
    cols = sorted(df.columns)
    cur = duckdb.connect().execute(sql)
    names = [c[0] for c in cur.description]
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(names) == cols and sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == sorted(want, key=str)

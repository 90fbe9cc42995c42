"""Formulas, lookups and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.formula.columns import column
from larkspur.functions.formula.compiler import Definition
from larkspur.operators import collection, derived
from larkspur.operators import schema as S
from larkspur.plans import tables as T
from larkspur.plans.graph_queries import star_files
from larkspur.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, l_quantity >= 25 AS bulk, greatest(l_discount, l_tax) AS most FROM lineitem")
def formula_arith(spark, d):
    li = T.table(spark, d, "lineitem")
    names = {c: F.col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax")}
    f = {k: column(s, names) for k, s in {"net": "extendedprice * (1 - discount)", "gross": "extendedprice * (1 - discount) * (1 + tax)", "bulk": "quantity >= 25", "most": "Math.max(discount, tax)"}.items()}
    return li.select("l_orderkey", "l_linenumber", F.round(f["net"], 4).alias("net"), F.round(f["gross"], 6).alias("gross"), f["bulk"].alias("bulk"), f["most"].alias("most"))


@query("SELECT p_partkey, upper(trim(p_name)) || '/' || p_brand AS tag, CASE WHEN length(p_name) < 30 THEN lpad(p_name, 30, '.') ELSE p_name END AS padded, right(p_brand, 2) AS tail, strpos(p_type, 'E')::INT - 1 AS at, starts_with(p_brand, 'Brand#1') AS ones, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare FROM part")
def formula_string(spark, d):
    names = {c: F.col(f"p_{c}") for c in ("name", "brand", "type")}
    f = {
        "tag": 'name.trim().toUpperCase() + "/" + brand', "padded": 'name.padStart(30, ".")', "tail": "brand.slice(-2)", "at": 'type.indexOf("E")',
        "ones": 'brand.startsWith("Brand#1")', "bare": "name.replace(/[aeiou]/g, '')",
    }
    return T.table(spark, d, "part").select("p_partkey", *(column(s, names).alias(k) for k, s in f.items()))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100), lambda x: x[1:5]), '|') AS heads, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'token'))) > 0 AS hit FROM documents")
def formula_array(spark, d):
    names = {"text": F.col("text"), "lines": F.split("text", "\n", -1)}
    lists = frozenset({"lines"})
    return T.table(spark, d, "documents").select(
        "doc_id", column("lines.length", names, lists).alias("n"), column("lines.filter(x => x.length > 100).map(x => x.slice(0, 5)).join('|')", names, lists).alias("heads"),
        column("lines.some(x => x.includes('token'))", names, lists).alias("hit"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 AND c_mktsegment != 'BUILDING' THEN 'rich' ELSE 'plain' END AS class, NOT (c_acctbal < 0) OR c_mktsegment = 'MACHINERY' AS ok FROM customer")
def formula_logic(spark, d):
    names = {"bal": F.col("c_acctbal"), "seg": F.col("c_mktsegment")}
    return T.table(spark, d, "customer").select("c_custkey", column("bal < 0 ? 'debt' : bal > 5000 && seg !== 'BUILDING' ? 'rich' : 'plain'", names).alias("class"), column("!(bal < 0) || seg === 'MACHINERY'", names).alias("ok"))


@query("SELECT p_partkey, abs(p_size - 25)::INT AS away, floor(p_retailprice)::BIGINT AS low, ceil(p_retailprice)::BIGINT AS high, floor(p_retailprice + 0.5)::BIGINT AS near FROM part")
def formula_math(spark, d):
    names = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    f = {"away": "Math.abs(size - 25)", "low": "Math.floor(price)", "high": "Math.ceil(price)"}
    near = column("Math.floor(price + 0.5)", names | {"price": F.col("p_retailprice")})
    return T.table(spark, d, "part").select("p_partkey", *(column(s, names).alias(k) for k, s in f.items()), near.cast("long").alias("near"))


@query("SELECT doc_id, (sqrt(n_chars::DOUBLE))::DECIMAL(18, 6)::DOUBLE AS root, (n_chars / 3.0)::DECIMAL(18, 6)::DOUBLE AS third FROM documents")
def formula_udf_math(spark, d):
    files = T.files(spark, d)
    got = derived.formulas(files, [Definition("root", "Number(Math.sqrt(n_chars).toFixed(6))", "number"), Definition("third", "Number((n_chars / 3).toFixed(6))", "number")])
    wide = got.groupBy("path").pivot("field", ["root", "third"]).agg(F.first("value").cast("double"))
    return files.select("path", "doc_id").join(wide, "path").select("doc_id", "root", "third")


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS ms, strftime(ts, '%Y-%m') AS month FROM events")
def formula_date(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ev = T.table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.to_json(F.struct(iso.alias("at"))).alias("metadata"))
    got = derived.formulas(ev, [Definition("ms", "Date.parse(at)", "number"), Definition("month", "at.slice(0, 7)", "string")])
    wide = got.groupBy("path").pivot("field", ["ms", "month"]).agg(F.first("value"))
    return wide.select(F.col("path").cast("long").alias("event_id"), F.col("ms").cast("long").alias("ms"), F.get_json_object(F.concat(F.lit("["), "month", F.lit("]")), "$[0]").alias("month"))


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)^[a-m]') AS early, coalesce(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), ''), '?') AS number FROM part")
def formula_regex(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct("p_name", "p_brand")).alias("metadata"))
    got = derived.formulas(rows, [Definition("early", "/^[a-m]/i.test(p_name)", "boolean"), Definition("number", "p_brand.match(/#([0-9]+)/)?.[1] ?? '?'", "string")])
    wide = got.groupBy("path").pivot("field", ["early", "number"]).agg(F.first("value"))
    return wide.select(F.col("path").cast("long").alias("p_partkey"), (F.col("early") == "true").alias("early"), F.regexp_replace("number", '"', "").alias("number"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT + 1 AS k1 FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def formula_json(spark, d):
    rows = T.spread(T.table(spark, d, "events")).select(F.col("event_id").cast("string").alias("path"), F.to_json(F.struct("props")).alias("metadata"))
    got = derived.formulas(rows, [Definition("k1", "JSON.parse(props)?.k + 1", "number")]).where("code IS NULL AND value != 'null'")
    return got.select(F.col("path").cast("long").alias("event_id"), F.col("value").cast("long").alias("k1"))


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_scalar(spark, d):
    files = star_files(spark, d)
    got = derived.derive(files, collection.relations(files), [derived.Lookup("segment", "client", "segment", "orders")])
    return got.where("code IS NULL").select("path", F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]").alias("segment"))


@query("SELECT 'customer/' || c_custkey || '.md' AS path, count(o_orderkey)::VARCHAR AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rollup_incoming_counts(spark, d):
    files = star_files(spark, d)
    got = derived.derive(files, collection.relations(files), [derived.Rollup("orders", "client", "status", "incoming", "values.length", "customer", "orders")])
    return got.select("path", F.col("value").alias("orders"))


@query("SELECT 'clients/acme.md' AS path, '{\"tier\":2,\"x\":5}' AS metadata UNION ALL SELECT 'clients/beta.md', '{}' UNION ALL SELECT 'c.md', '{\"k\":1}'")
def effective_metadata(spark, d):
    files = spark.createDataFrame([("clients/acme.md", '{"tier":2,"x":1}'), ("clients/beta.md", '{"x":1}'), ("c.md", '{"k":1}')], "path string, metadata string")
    computed = spark.createDataFrame([("clients/acme.md", "x", "5", None), ("clients/beta.md", "x", None, "type_mismatch")], "path string, field string, value string, code string")
    return collection.effective(files, computed).select("path", "metadata")


@query("SELECT 'documents' AS kind, count(*) FILTER (doc_id % 4 = 0) AS stale FROM documents")
def fingerprint_stale(spark, d):
    files = T.files(spark, d)
    now = derived.fingerprints(files, [Definition("x", "n_chars + 1", "number")])
    old = now.join(files.select("path", "doc_id"), "path").where("doc_id % 4 != 0").drop("doc_id")
    return derived.stale(now, old).agg(F.count("*").alias("stale")).select(F.lit("documents").alias("kind"), "stale")


def _priced(spark, d):
    """Parts with a price of two places, a fee and their size."""
    meta = F.to_json(F.struct(F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.lit(0.2).cast("decimal(2,1)").alias("fee"), F.col("p_size").alias("quantity"), (F.col("p_size") - 25).alias("from mean")))
    return T.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), meta.alias("metadata"))


_DECIMAL = "regexp_replace(regexp_replace({}::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(f"""WITH p AS (SELECT p_partkey::VARCHAR AS path, p_retailprice::DECIMAL(12, 2) AS price, p_size AS n FROM part)
SELECT path, 'total' AS field, {_DECIMAL.format('(price + 0.2)')} AS value, NULL AS code FROM p UNION ALL SELECT path, 'all', {_DECIMAL.format('((price + 0.2) * n)')}, NULL FROM p
UNION ALL SELECT path, 'rest', CASE WHEN n != 25 THEN (n % (n - 25))::VARCHAR END, CASE WHEN n = 25 THEN 'division_by_zero' END FROM p""")
def formula_exact_decimals(spark, d):
    """Sums and products of decimals are exact; a formula may read another one; a division by zero is a code."""
    definitions = [Definition("total", "price + fee", "number"), Definition("all", "total * quantity", "number"), Definition("rest", 'quantity % fields["from mean"]', "number")]
    return derived.formulas(_priced(spark, d), definitions).select("path", "field", "value", "code")


@query(f"""WITH {T.FILES} SELECT path, 'better' AS field, CASE WHEN quality IS NOT NULL THEN (quality + 1)::VARCHAR END AS value, CASE WHEN quality IS NULL THEN 'unknown_identifier' END AS code FROM files
UNION ALL SELECT path, 'twice', CASE WHEN quality IS NOT NULL THEN (2 * (quality + 1))::VARCHAR END, CASE WHEN quality IS NULL THEN 'dependency_failed' END FROM files UNION ALL SELECT path, 'none', NULL, 'division_by_zero' FROM files
UNION ALL SELECT path, 'number', NULL, 'invalid_number' FROM files UNION ALL SELECT path, 'round', NULL, 'dependency_cycle' FROM files UNION ALL SELECT path, 'text', NULL, 'result_type' FROM files""")
def formula_errors(spark, d):
    definitions = [Definition("better", "quality + 1", "number"), Definition("twice", "2 * better", "number"), Definition("none", "n_chars % 0", "number"), Definition("number", "Number(source)", "number"), Definition("round", "round + 1", "number"), Definition("text", "lang", "number")]
    return derived.formulas(T.files(spark, d), definitions).select("path", "field", "value", "code")


def _accounts(spark, d):
    """Customers that list their orders in a field, and orders with price and customer."""
    link = lambda to, key: F.concat(F.lit(f"[[{to}/"), F.col(key).cast("string"), F.lit("]]"))
    at = lambda of, key: F.concat(F.lit(f"{of}/"), F.col(key).cast("string"), F.lit(".md"))
    o = T.table(spark, d, "orders")
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    c = T.dealt(T.table(spark, d, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left"), "c_custkey")
    o = T.dealt(o, "o_orderkey")
    orders = F.transform(F.coalesce("keys", F.array().cast("array<bigint>")), lambda k: F.concat(F.lit("[[orders/"), k.cast("string"), F.lit("]]")))
    customers = c.select(at("customer", "c_custkey").alias("path"), F.to_json(F.struct(orders.alias("orders"))).alias("metadata"))
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return customers.unionByName(o.select(at("orders", "o_orderkey").alias("path"), F.to_json(F.struct(link("customer", "o_custkey").alias("client"), F.col("o_orderstatus").alias("status"), price.alias("price"))).alias("metadata")))


def _derived(files, *definitions):
    return derived.derive(files, collection.relations(files), list(definitions)).select("path", "field", "value", "code")


_BOTH = "c AS (SELECT 'customer/' || c_custkey || '.md' AS path, c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k, o_orderkey AS n, o_orderstatus AS status, o_totalprice::DECIMAL(14, 2) AS price FROM orders)"


@query(f"""WITH {_BOTH} SELECT path, '[' || coalesce(string_agg('"' || status || '"', ',' ORDER BY n), '') || ']' AS value, NULL AS code FROM c LEFT JOIN o USING (k) GROUP BY path""")
def lookup_list(spark, d):
    return _derived(_accounts(spark, d), derived.Lookup("states", "orders", "status", "customer")).select("path", "value", "code")


@query(f"WITH {_BOTH}, s AS (SELECT path, coalesce(sum(price), 0) AS total FROM c LEFT JOIN o USING (k) GROUP BY path) SELECT path, {_DECIMAL.format('total')} AS value, NULL AS code FROM s")
def rollup_outgoing(spark, d):
    return _derived(_accounts(spark, d), derived.Rollup("spent", "orders", "price", scope="customer")).select("path", "value", "code")


@query(f"""WITH {_BOTH}, s AS (SELECT path, coalesce(sum(price), 0) AS total, count(price) AS n, max(price) AS most FROM c LEFT JOIN o USING (k) GROUP BY path)
SELECT path, 'spent' AS field, {_DECIMAL.format('total')} AS value, NULL AS code FROM s UNION ALL SELECT path, 'orders_in', n::VARCHAR, NULL FROM s UNION ALL SELECT path, 'most', CASE WHEN n > 0 THEN {_DECIMAL.format('most')} ELSE '0' END, NULL FROM s""")
def rollup_incoming(spark, d):
    """Sum and count as aggregates, another formula in the formula language."""
    one = lambda field, formula: derived.Rollup(field, "client", "price", "incoming", formula, "customer", "orders", "number")
    return _derived(_accounts(spark, d), one("spent", derived.SUM), one("orders_in", derived.LENGTH), one("most", "values.reduce((m, v) => Math.max(m, v), 0)"))


_CHAIN = "n AS (SELECT doc_id AS k, max(doc_id) OVER () AS last, doc_id || '.md' AS path FROM documents)"


def _chained(spark, d):
    """Documents that name the next one; each with a label carries its quality."""
    docs = T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels"), "doc_id", "left")
    follow = F.concat(F.lit("[["), (F.col("doc_id") + 1).cast("string"), F.lit("]]"))
    up = F.when(F.col("doc_id") > 0, F.concat(F.lit("[["), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("]]")))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.to_json(F.struct(follow.alias("follow"), up.alias("up"), "quality", F.when(F.col("doc_id") == 0, "root").alias("top"))).alias("metadata"))


@query(f"""WITH {_CHAIN} SELECT path, CASE WHEN n.k = last THEN NULL ELSE l.quality::VARCHAR END AS value, CASE WHEN n.k = last THEN 'relation_unresolved' WHEN l.quality IS NULL THEN 'target_field_missing' END AS code FROM n LEFT JOIN labels l ON l.doc_id = n.k + 1""")
def lookup_missing(spark, d):
    return _derived(_chained(spark, d), derived.Lookup("next_quality", "follow", "quality")).select("path", "value", "code")


@query(f"""WITH {_CHAIN} SELECT path, '"root"' AS value, NULL AS code FROM n WHERE k > 0""")
def lookup_recursive(spark, d):
    """A field that reads itself along a tree; the root's value reaches every document."""
    files = _chained(spark, d)
    tree = files.withColumn("path", F.when(F.col("path") == "0.md", "0.md").otherwise(F.concat(F.lit("t/"), "path"))).withColumn("metadata", F.regexp_replace("metadata", r'"up":"\[\[([1-9]\d*)\]\]"', r'"up":"[[t/$1]]"'))
    tree = tree.withColumn("metadata", F.replace("metadata", F.lit('"up":"[[0]]"'), F.lit('"up":"[[../0]]"')))
    return _derived(tree, derived.Lookup("top", "up", "top", "t")).select(F.regexp_replace("path", "^t/", "").alias("path"), "value", "code")


@query(f"WITH {_CHAIN} SELECT path, unnest(['a', 'b']) AS field, 'dependency_cycle' AS code FROM n")
def derived_cycle(spark, d):
    return _derived(_chained(spark, d), derived.Lookup("a", "follow", "b"), derived.Lookup("b", "follow", "a")).select("path", "field", "code")


@query(f"""WITH {_BOTH}, s AS (SELECT path, k % 2 = 0 AS even, coalesce(sum(price), 0) AS total, count(price) AS n FROM c LEFT JOIN o USING (k) GROUP BY ALL)
SELECT path, 'worth' AS field, CASE WHEN even THEN {_DECIMAL.format('total')} ELSE n::VARCHAR END AS value FROM s UNION ALL SELECT path, 'kind', CASE WHEN even THEN '"even"' ELSE '"any"' END FROM s""")
def scoped_definitions(spark, d):
    """Formulas and rollups declared for all and, for the even customers, anew under their own scope."""
    even = F.regexp_extract("path", r"^customer/(\d+)\.md$", 1)
    moved = F.when((even != "") & (even.try_cast("long") % 2 == 0), F.concat(F.lit("customer/even/"), even, F.lit(".md"))).otherwise(F.col("path"))
    files = _accounts(spark, d).select(moved.alias("path"), F.regexp_replace("metadata", r"\[\[customer/(\d*[02468])\]\]", "[[customer/even/$1]]").alias("metadata"))
    roll = lambda scope, formula: S.Field("worth", scope, "Rollup", relation_field="client", target_field="price", direction="incoming", relation_scope="orders", formula=formula, result_type="number")
    fields = [roll("customer", derived.LENGTH), roll("customer/even", derived.SUM), S.Field("kind", "customer", "Formula", formula="'any'"), S.Field("kind", "customer/even", "Formula", formula="'even'")]
    formulas, moves = derived.definitions_for(fields)
    got = derived.run(files, collection.relations(files), formulas, moves)
    return got.select(F.replace("path", F.lit("even/"), F.lit("")).alias("path"), "field", "value")

import random

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from larkspur.llm import lines
from larkspur.llm import queries as Q
from tests.llm import reference as R

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_near, r.removed) for r in df.collect()), key=str)


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_reference_one_edit(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert R.one_edit(a, b) == (d[-1][-1] <= 1)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, n_near, removed FROM ({Q.ORACLES['op1_line_dedup']})").fetchall(), key=str)
    assert sum(r[2] for r in want)
    assert got(Q.op1_line_dedup(spark, sf)) == want


def mutated(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + rng.choice("aéz ") + line[i:], line[:i] + line[i + 1 :], line[:i] + rng.choice("aéz") + line[i + 1 :], line])


def corpus():
    rng = random.Random(5)
    seeds = ["".join(rng.choice("abé ") for _ in range(rng.randint(3, 60))) for _ in range(25)]
    rows = [(i, "\n".join(mutated(rng, mutated(rng, rng.choice(seeds))) for _ in range(rng.randint(0, 5)))) for i in range(80)]
    # a dense group: one replaced character, everywhere; and very long, empty, repeated and nameless rows
    rows += [(100 + i, f"the same template line with {chr(97 + i % 26)}{chr(97 + i // 26)} inside it") for i in range(60)]
    long = "q" * 5000 + "r" * 5000
    return [*rows, (300, long), (301, long[:7000] + "X" + long[7000:]), (302, long[:-1]), (1, None), (2, ""), (3, "\n\n"), (None, seeds[0] * 3), (None, seeds[0] * 3), (400, "x y " * 20_000)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "'k' AS lines", "'x' AS line", "5 AS of")
    for low in (1, 20):
        assert got(lines.assess(df, low)) == R.op1(rows, low)
    assert lines.assess(df.limit(0)).count() == 0
    kept = lines.remove(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    want = {}
    gone = {(d, n): r for d, n, _, _, r in R.op1(rows)}
    for d, t in rows:
        cut = {int(x) for x in gone[d, len((t or "").split("\n")) if t is not None else 0].split(",") if x}
        want.setdefault(d, []).append(t if not cut else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut))
    found = {}
    for r in kept.collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert {k: sorted(map(str, v)) for k, v in found.items()} == {k: sorted(map(str, v)) for k, v in want.items()}


def test_plan_is_native(spark, sf):
    plan = lines.assess(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

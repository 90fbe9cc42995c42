"""Operators that judge each document in one pass: quality rules and decontamination."""

from larkspur.llm import decontam, quality
from larkspur.llm import queries as Q
from tests.llm import reference as R

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t \x0b"), (4, "é à b\x1cc d"), (None, "one two three"), (5, "Same line here now.\n" * 40), (5, "Same line here now.\n" * 40), (6, "x" * 300_000 + " y"), (7, "A. b? " * 30_000)]


def rows(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_quality_matches_brute_force(spark, sf):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(Q.op10_quality_rules(spark, sf), *cols)
    assert got == R.op10([(r.doc_id, r.text) for r in docs.collect()])
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert rows(quality.assess(odd), *cols) == R.op10(ODD)
    assert quality.assess(odd).count() == len(ODD)
    assert quality.assess(odd.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    sentence = "The quick brown{0} fox jumps over lazy{0} dogs near a quiet{0} river bank.\n"
    clean = "".join(sentence.format(i) for i in range(12))
    menu = clean[:160] + " | ".join(f"item{i}" for i in range(200))
    shout = " ".join(f"BUY{i} NOW{i}!!" for i in range(60))
    symbols = " ".join(f"w{i}###" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, clean), (2, menu), (3, shout), (4, symbols), (5, clean + "Licensed under CC BY-NC 4.0.\n")], SCHEMA)
    assert rows(quality.assess(docs), "kept") == {1: (True,), 2: (False,), 3: (False,), 4: (False,), 5: (True,)}
    wide = docs.selectExpr("doc_id", "text", "1 AS kept", "'z' AS n_words")
    kept = {r.doc_id: r for r in quality.filter_documents(wide).collect()}
    assert kept.keys() == {1, 5} and kept[1].n_words == "z" and kept[5].text == clean


def test_quality_judges_lines_of_any_length_and_script():
    rules = quality.Rules()
    fails = lambda line: quality.line_fails(line.encode(), len(line.split()), rules)
    for n in (30, 199, 200, 5000):
        words = " ".join(f"word{i}" for i in range(n))
        assert fails(words) and not fails(words + ".") and not fails(words.replace("word7 ", "word7! "))
    for end in (".", "!", "?", "…", "。", "！", "？", "؟", "۔", "।", "॥", "։", "။", "።", "។", ".”", "?)", "!»", ".')"):
        assert not fails(f"a line that ends well{end}") and not fails(f"it ends{end} and goes on")
    for end in ("", ",", "ü", "é", "”", "»", "à", "…x", "·"):
        assert fails(f"a line that does not end{end}")
    assert not quality.line_fails("no mark in this script".encode(), 5, quality.Rules(needs_sentence=False))
    # letters whose bytes are those of separators or marks don't count as such
    assert not fails("él único último país según número público útil música júbilo.") and fails("uno · dos · tres · cuatro · cinco · seis.")


def test_decontamination_matches_brute_force(spark, sf):
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = R.op4([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sum(x[4] for x in want.values())
    assert rows(Q.op4_decontamination(spark, sf), *cols) == want
    assert rows(decontam.flag(docs, bench, max_broadcast=3), *cols) == want


def test_decontamination_odd_rows(spark):
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    ten = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    bench = [(1, ten + " k11"), (2, "é à"), (3, None), (4, ""), (10, ten.upper()), (None, "x y z"), (2, "é à"), (5, "solo")]
    docs = [*ODD, (8, f"pre {ten} post é-à solo! solo"), (9, ten.replace("e5", "zz")), (10, " ".join([ten] * 3))]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'q' AS fp")
    want = R.op4(docs, [x for x in bench if x[0] is not None])
    for bound in (1000, 0):
        got = decontam.flag(d, b, max_broadcast=bound)
        assert rows(got, *cols) == want and got.count() == len(docs)
    assert decontam.flag(d, b.limit(0)).where("contaminated").count() == 0
    assert decontam.flag(d.limit(0), b).count() == 0

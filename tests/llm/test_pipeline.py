"""The pipeline's stages, each against brute force on its own input."""

import random

import public_tokenizers

import corpus_pipeline as P
from larkspur.llm import decontam, quality, shared
from tests.llm import reference as R
from tests.llm.test_tokens import check_packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = shared.saved(stage(spark, docs, sf), name)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert out.columns == columns and out.schema["n_chars"].dataType.simpleString() == "bigint"
            after = {r.doc_id: r.text for r in out.collect()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
            assert after.keys() == kept and 0 < len(kept) < len(before)
            base = {x[0]: x[1][5] for x in R.op10(before).items()}
            assert not any(base[d] for d in kept)
            for d, t in before:
                if d in after:
                    assert after[d] == "\n".join(x for x in t.split("\n") if not x.split() or not quality.line_fails(x.encode(), len(R.SPACED.findall(x)), quality.Rules()))
        elif name == "line_dedup":
            gone = {d: {int(i) for i in r.split(",") if i} for d, _, _, _, r in R.op1(before)}
            assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before}
        elif name == "near_dedup":
            assert after.keys() == {x[2] for x in R.op6(before)} and all(after[d] == t for d, t in before if d in after)
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {d for d, x in R.op4(before, bench).items() if not x[4]}
            assert after.keys() == clean < {d for d, _ in before}
            large = decontam.clean(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), max_broadcast=1)
            assert {r.doc_id for r in large.collect()} == clean
        else:
            check_packing(out.collect(), before)
        docs = out
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in P.run(spark, sf).collect())
    assert public_tokenizers.path(P.TOKENIZER)


def test_stages_over_odd_rows(spark, sf):
    """Null ids and texts, blank, very long and repeated texts, clashing names, and no rows at all: stage by stage."""
    rng = random.Random(6)
    lines = lambda n: "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) + "." for _ in range(n))
    good = lines(12)
    rows = [(1, good), (1, good), (2, good), (None, good + "\nend."), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "x" * 200_000), (7, lines(4000)), (8, "Menu | Home | News\n" * 30)]
    names = ["'en' AS lang", "'s' AS source", "length(text) AS n_chars", *(f"{i} AS {c}" for i, c in enumerate("of of_text lines h slot task kept text_0 _first block class key root".split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *names)
    for odd in (docs, docs.limit(0)):
        now = shared.saved(odd, "odd")
        for name, stage in P.STAGES:
            out = shared.saved(stage(spark, now, sf), name)
            if name != "packing":
                assert out.columns == odd.columns
                now = out
            kept = sorted((r.doc_id for r in out.collect()), key=str)
            if odd is not docs:
                assert kept == []
            elif name in ("quality_rules", "line_dedup"):
                assert kept == [1, 1, 2, 7, None]
            elif name == "packing":
                assert set(kept) <= {1, 7, None} and 7 in kept
            else:  # what line dedup left of the copies is empty, so one of them stays
                assert 7 in kept and len(kept) == 3 and None in kept

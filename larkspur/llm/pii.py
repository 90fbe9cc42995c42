"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four patterns (e-mail, IP address, card, phone) with their
checks. The patterns are written so that a text of any length is scanned once:
runs are taken possessively and a match starts only where a run starts or where
the match before it ended, which gives the same leftmost matches.

The method adds spans of two more kinds: `secret` (tokens such as keys) and
`number` (account-like digit groups that are no base span). Labelers vote on each
candidate, or abstain: a pattern (its shape), a gazetteer (issuer and key
prefixes, and known non-numbers) and the context before it (cue words). Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler
is and how likely each pattern is personal data; those probabilities are the
labels from which a naive Bayes classifier of span features is trained. Candidates
it finds likely are added. Counts are over all documents; what reaches the driver is
one row per vote pattern and feature value, a few hundred however large the input.

Null text is empty and has no spans. Repeated rows are judged one by one. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared

#: Patterns of the base kinds, in the order in which ties are listed.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = ("secret", "number")
#: A character that a text must hold before its pattern is tried.
_NEEDS = {"email": "@", "phone": "+"}
_SECRET = r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{20,}+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
CONTEXT = 32
_CUES = {
    "secret": r"(?i)(?:token|secret|password|passwd|api.?key|apikey|access.?key|credential|auth|bearer|private)[\s\"'=:>-]*$",
    "number": r"(?i)(?:card|account|acct|iban|ssn|passport|licen[cs]e|phone|tel|mobile|customer|member|social)\W{0,12}(?:no|number|nr)?\W{0,4}$",
}
_COUNTER_CUES = r"(?i)(?:isbn|issn|doi|commit|sha|md5|hash|version|page|\bv|[$€£#])\W{0,4}$"
_PREFIXES = {"secret": r"^(?:ghp_|gho_|sk-|sk_|pk_|AKIA|AIza|xox[bpas]-|eyJ)", "number": r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"}
_STRANGERS = {"secret": r"^[=_+/-]+$|^[A-Za-z_/=+-]+$|https?", "number": r"^(?:([0-9])\1+|0*[1-9]0*|97[89][0-9]{10})$"}
_SHAPES = {"secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9_+/=-]{24,})$", "number": r"^(?:[0-9]{16}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"}
_SPAN = "array<struct<start:int,end:int,m:string>>"
LABELERS = ("shape", "gazetteer", "context")
FEATURES = ("size", "digits", "mixed", "cue")


def _spans(match: str, gap: str) -> Column:
    """Places of matches, from the texts of the matches and of the gaps between them."""
    pairs = F.zip_with(F.slice(gap, 1, F.size(match)), F.col(match), lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(F.size(match) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check-sum."""
    n = F.length(d)

    def add(acc, i):
        x = F.ascii(F.substr(d, n - i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(_IP_OK)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _checked(kind: str) -> Column:
    return F.filter(f"s_{kind}", lambda s: _valid(kind, s["m"]))


def _tagged(spans: Column, kind: str) -> Column:
    rank = [*KINDS, *ADDED].index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _votes(kind: str, s: Column) -> Column:
    """A candidate with its labelers' votes (1, -1 or 0) and its features. It sees CONTEXT characters before the span."""
    before = F.substring("text", F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    m = s["m"]
    bare = _digits(m) if kind == "number" else m
    n = F.length(bare)
    digits = F.length(_digits(m)) / F.length(m)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    odd_size = ~n.isin(9, 10, 15, 16) if kind == "number" else digits < 0.1
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        vote(m.rlike(_SHAPES[kind]), odd_size).alias("shape"),
        vote(bare.rlike(_PREFIXES[kind]), bare.rlike(_STRANGERS[kind])).alias("gazetteer"),
        vote(before.rlike(_CUES[kind]), before.rlike(_COUNTER_CUES)).alias("context"),
        F.least(n, F.lit(48)).alias("size"), F.floor(digits * 4).cast("int").alias("digits"),
        (m.rlike("[a-z]") & m.rlike("[A-Z]")).cast("int").alias("mixed"), before.rlike(r"[=:#]\W*$").cast("int").alias("cue"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base spans of each kind, and the candidates of the added kinds with votes and features."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    patterns = KINDS | {"secret": _SECRET}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        src = src.withColumn(f"m_{kind}", F.when(F.instr("text", _NEEDS[kind]) > 0, found).otherwise(none) if kind in _NEEDS else found)
    src = src.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in patterns.items()))
    src = src.select("doc_id", "text", *(_spans(f"m_{k}", f"g_{k}").alias(f"s_{k}") for k in patterns))
    src = src.select("*", F.col("s_email").alias("email"), *(_checked(k).alias(k) for k in KINDS if k != "email"))
    base = F.concat(*(_tagged(F.col(k), k) for k in KINDS))
    src = src.select("*", base.alias("base"))

    def free(s):
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    numbers = F.filter("s_card", lambda s: F.length(_digits(s["m"])).between(9, 19) & free(s))
    inside = lambda s: ~F.exists("s_secret", lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]) & ~t["m"].rlike("^[0-9-]+$"))
    secrets = F.filter("s_secret", lambda s: free(s) & s["m"].rlike("[0-9]") & ~s["m"].rlike("^[0-9-]+$"))
    found = F.concat(F.transform(secrets, lambda s: _votes("secret", s)), F.transform(F.filter(numbers, inside), lambda s: _votes("number", s)))
    return src.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base", found.alias("found"))


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 100) -> tuple[float, list[float], dict[tuple, float]]:
    """Prior, each labeler's reliability, and the probability of each vote pattern, of binary labels from votes that abstain at 0."""
    prior, rates = 0.5, [0.8] * len(LABELERS)
    sure: dict[tuple, float] = {}
    for _ in range(rounds):
        for votes in counts:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, rates, strict=True))
            sure[votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        total = sum(counts.values())
        prior = min(0.95, max(0.05, (1 + sum(n * sure[v] for v, n in counts.items())) / (2 + total)))
        for j in range(len(rates)):
            right = sum(n * (sure[v] if v[j] > 0 else 1 - sure[v]) for v, n in counts.items() if v[j])
            heard = sum(n for v, n in counts.items() if v[j])
            rates[j] = min(0.98, max(0.55, (right + 4) / (heard + 5)))
    return prior, rates, sure


def train(rows: list[tuple[str, tuple, tuple, int]]) -> dict[str, tuple[float, dict[str, dict[int, float]]]]:
    """By kind: a bias and the weight of each value of each feature and vote. rows: (kind, votes, feature values, count)."""
    model = {}
    for kind in ADDED:
        mine = [r for r in rows if r[0] == kind]
        counts: dict[tuple, int] = defaultdict(int)
        for _, votes, _, n in mine:
            counts[votes] += n
        if not counts:
            continue
        _, _, sure = expectation_maximisation(counts)
        yes = sum(n * sure[v] for _, v, _, n in mine)
        no = sum(n for *_, n in mine) - yes
        weights: dict[str, dict[int, float]] = {}
        for j, name in enumerate((*LABELERS, *FEATURES)):
            tally: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for _, votes, values, n in mine:
                cell = tally[(*votes, *values)[j]]
                cell[0] += n * sure[votes]
                cell[1] += n * (1 - sure[votes])
            size = len(tally)
            # features that say the same are many; each counts half
            weights[name] = {x: 0.5 * math.log(((a + 1) / (yes + size)) / ((b + 1) / (no + size))) for x, (a, b) in tally.items()}
        model[kind] = (math.log((yes + 1) / (no + 1)), weights)
    return model


def _likely(model: dict, s: Column) -> Column:
    out = F.lit(False)
    for kind, (bias, weights) in model.items():
        score = F.lit(bias)
        for name, by_value in weights.items():
            table = F.create_map(*(F.lit(x) for pair in sorted(by_value.items()) for x in pair))
            score = score + F.coalesce(F.try_element_at(table, s[name].cast("int")), F.lit(0.0))
        out = F.when(s["kind"] == kind, score > 0).otherwise(out)
    return out


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, *ADDED)))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of base spans, digest of the base spans, and all spans as kind:start:end."""
    found = shared.saved(candidates(docs, id_col, text_col), "spans")
    each = found.select(F.explode("found").alias("s")).groupBy("s.kind", *(f"s.{x}" for x in (*LABELERS, *FEATURES))).agg(F.count("*").alias("n"))
    model = train([(r.kind, tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r.n) for r in each.collect()])
    added = F.filter("found", lambda s: _likely(model, s))
    added = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.when(s["kind"] == "secret", 4).otherwise(5).alias("rank"), s["end"].alias("end")))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", added)).alias("spans"))

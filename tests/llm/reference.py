"""Plain, slow versions of the operators' contracts, for tests."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op4(docs, bench):
    wins = []
    for item, text in bench:
        w = ALNUM.findall(lower(text))
        n = min(10, len(w))
        wins += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = {}
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        grams = {}
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), []).append(i)
        for item, g in wins:
            for i in grams.get(g, []):
                hit |= set(range(i, i + len(g)))
                items.add(item)
        out[doc] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    return out


def op10(docs):
    out = {}
    for doc, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        again = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
        out[doc] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
    return out


def ids_of(texts, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def op2(docs, size=13):
    first = {}
    key = {id(r): (-(2**63) if r[0] is None else r[0]) for r in docs}
    for r in docs:
        w = SPACED.findall(r[1] or "")
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, 2**63), key[id(r)])
    out = []
    for r in docs:
        w = SPACED.findall(r[1] or "")
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < key[id(r)] for j in range(i, i + size)}
        out.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def op5(docs, mass=200.0, order=3):
    import math
    import zlib
    from collections import Counter

    rows = []
    for doc, text in docs:
        out = zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1
        rows.append((doc, out, [*SPACED.findall(lower(text)), None]))
    counts = Counter()
    for _, out, toks in rows:
        if not out:
            full = [None, *toks]
            counts.update((t,) for t in toks)
            for k in range(2, order + 1):
                counts.update(tuple(full[i : i + k]) for i in range(len(full) - k + 1))
    total = sum(v for g, v in counts.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in counts)

    def p(context, t):
        if not context:
            return (counts[(t,)] + 0.5) / (total + 0.5 * (kinds + 1))
        return (counts[(*context, t)] + mass * p(context[1:], t)) / (counts[context] + mass)

    result = []
    for doc, out, toks in rows:
        full = [None, *toks]
        score = sum(math.log10(p(tuple(full[max(0, i - order + 1) : i]), full[i])) for i in range(1, len(full)))
        result.append((doc, out, len(toks), sum(counts[(t,)] > 0 for t in toks), total, sum(math.log10(p((), t)) for t in toks), score))
    return result


def op6(docs):
    import xxhash

    prints = []
    for _, text in docs:
        w = [x.encode() for x in SPACED.findall(lower(text))]
        grams = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
        h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(docs)]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def op1(docs, min_chars=20):
    first = {}
    rows = [(-(2**63) if d is None else d, d, (t.split("\n") if t is not None else [])) for d, t in docs]
    for key, _, lines in rows:
        for no, line in enumerate(lines):
            if len(line) >= min_chars or SPACED.search(line):
                first[line] = min(first.get(line, (key, no)), (key, no))
    best = {}
    every = sorted(first, key=first.get)
    for i, line in enumerate(every):
        best[line] = next((first[x] for x in every[: i + 1] if x == line or min(len(x), len(line)) >= min_chars and one_edit(x, line)), None)
    out = []
    for key, d, lines in rows:
        gone = [(no, first[x] == (key, no)) for no, x in enumerate(lines) if x in best and best[x] < (key, no)]
        out.append((d, len(lines), len(gone), sum(n for _, n in gone), ",".join(str(no) for no, _ in gone)))
    return sorted(out, key=str)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op3(docs):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for doc, text in docs:
        spans, n = [], []
        for rank, (kind, pattern) in enumerate(kinds.items()):
            found = []
            for m in re.finditer(pattern, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
                if ok:
                    found.append((m.start(), rank, m.end(), kind))
            n.append(len(found))
            spans += found
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        out.append((doc, *n, sha(base), base))
    return out


def op8_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def op8(pages, rules, damping=0.85, threshold=0.5, rounds=200):
    """pages: (id, url, [linked hosts])"""
    rows, tally = [], {}
    for page, url, links in pages:
        host, path = op8_parts(url)
        best = None
        for rule, verdict in rules:
            domain, _, start = rule.partition("/")
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        rows.append((page, host, path, *(best or (None, None))))
        t = tally.setdefault(host, [0, 0, 0])
        t[0] += 1
        t[1] += bool(best) and best[1] == "allow"
        t[2] += bool(best) and best[1] == "block"
    weight = {}
    for page, url, links in pages:
        host, _ = op8_parts(url)
        for to in set(links):
            if host and to and host != to:
                weight[host, to] = weight.get((host, to), 0) + 1

    def flow(edges, seeds):
        total = {}
        for (a, _), w in edges.items():
            total[a] = total.get(a, 0) + w
        score, moving = dict(seeds), dict(seeds)
        for _ in range(rounds):
            sent = {}
            for (a, b), w in edges.items():
                sent[b] = sent.get(b, 0) + moving.get(a, 0) * w / total[a] * damping
            moving = sent
            for k, v in sent.items():
                score[k] = score.get(k, 0) + v
        return score

    trust = flow(weight, {h: t[1] / t[0] for h, t in tally.items() if t[1]})
    distrust = flow({(b, a): w for (a, b), w in weight.items()}, {h: t[2] / t[0] for h, t in tally.items() if t[2]})
    out = []
    for page, host, path, rule, verdict in rows:
        bad = bool(host) and distrust.get(host, 0) >= threshold and distrust.get(host, 0) > trust.get(host, 0)
        out.append((page, host, path, rule, verdict or ("block" if bad else "allow")))
    return out

"""Language-model scores from a weighted backoff automaton.

The states are the contexts of up to `order` - 1 tokens that stand in training texts, the
empty one included. A state has an arc for each token that followed it there, to the
state of the longest context that the token leaves, and a failure arc to the state of
its shorter context. Smoothing is hierarchical Dirichlet: with c the count of an n-gram
and t that of its context, p(token | context) = (c + mass * p(token | shorter)) /
(t + mass), so an arc weighs log10 of that, the failure arc log10 of mass / (t + mass),
and all tokens of a state share one. The empty context has an arc for every token, with
the add-half unigram estimate. One left-to-right traversal of a text, starting in the
state of an end token, carries the state and adds up weights: where the state has no arc
for the token, it follows the failure arc and tries again.

Counts are of all training documents: those whose crc32 of the id as text leaves
another remainder than `fold` modulo `folds` (a null id counts as ''). Blocks of
documents send their distinct n-grams with counts to reducers, which own ranges of
the hash space, add up, and answer each block with the totals of its own n-grams
(see blocks.py); from these each block builds the part of the automaton that its texts
can reach. No n-gram is cut off and no table of them is broadcast. The size of the
vocabulary and the number of tokens come from an aggregate of their own.

Null text is empty: its only token is the end. A very long text is a block of its own,
traversed in pieces, each of which starts by reading the tokens of its context. Other
columns, whatever their names, are ignored. An empty table gives no rows; with no
training document, counts are 0. Equal rows are scored row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks as B
from larkspur.llm import textkit as T

ORDER, FOLDS, FOLD = 3, 5, 1
#: Text of a block: a worker holds its n-grams of all lengths, some 30 times as many bytes.
BLOCK_BYTES = 16 << 20
#: How many tokens a shorter context counts for; `choose_mass` finds it on training documents (figures in the README).
MASS = 200.0
#: Tokens that one lane of the traversal reads; texts are cut into so many.
LANE = 256
#: Distinct tokens that a task of the vocabulary's count holds before it hands them on.
VOCABULARY = 2_000_000
_END = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids], bool)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, for each text an end, its words and an end, and where texts start (one more at the end)."""
    parts, sizes = [], []
    for _, some in B.pieces(texts):
        w = T.words(some, lower=True)
        out = np.full(len(w.starts) + 2 * len(some), _END, np.uint64)
        out[np.arange(len(w.starts)) + 2 * w.doc + 1] = w.hashes
        parts.append(out)
        sizes.append(w.per_doc + 2)
    size = np.concatenate([*sizes, np.zeros(0, np.int64)])
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])


class Grams:
    """The n-grams of a block by length: hash, token, prefix and suffix of each, and which one ends at each place."""

    def __init__(self, token: np.ndarray, first: np.ndarray, order: int):
        self.first = first
        unique, _, self.token = B.numbered(token)
        self.hash, self.prefix, self.suffix, self.last = [unique], [None], [None], [None]
        whole = np.ones(len(token), bool)
        whole[first[:-1]] = False  # an end that stands before a text isn't counted
        self.at, self.of = [np.flatnonzero(whole).astype(np.int32)], [self.token]
        kinds = np.uint64(max(1, len(unique)))
        for k in range(2, order + 1):
            if k > 2:
                inside = first[:-1] + k - 2
                whole[inside[inside < first[1:]]] = False
            at = np.flatnonzero(whole).astype(np.int32)
            before = self.of[-1]
            pair = before[at - 1].astype(np.uint64)
            pair *= kinds
            pair += self.token[at].astype(np.uint64)
            _, sample, number = B.numbered(pair)
            del pair
            sample = at[sample]
            prefix, last = before[sample - 1], self.token[sample]
            self.hash.append(T.mix((self.hash[-1][prefix] + np.uint64(k)) * _MIX ^ unique[last]))
            self.prefix.append(prefix)
            self.suffix.append(before[sample])
            self.last.append(last)
            self.at.append(at)
            of = np.full(len(token), -1, np.int32)
            of[at] = number
            self.of.append(of)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of all lengths in ascending order, and the order that sorts them."""
        every = np.concatenate(self.hash)
        order = np.argsort(every)
        return every[order], order.astype(np.int32)

    def by_length(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum([len(h) for h in self.hash])[:-1])

    def forget(self) -> None:
        """Drop what only counting needs."""
        del self.hash, self.at, self.of


class Arcs:
    """A table from (state, token) to an arc, in buckets of the hash space."""

    def __init__(self, state: np.ndarray, token: np.ndarray):
        key = self._key(state, token)
        self.order = np.argsort(key).astype(np.int32)
        self.key = key[self.order]
        bits = max(4, int(len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((self.key >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    @staticmethod
    def _key(state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return T.mix(state.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64))

    def find(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The arc for each state and token, or -1."""
        key = self._key(state, token)
        bucket = (key >> self.shift).astype(np.int64)
        at, to = self.start[bucket], self.start[bucket + 1]
        out, left = np.full(len(key), -1, np.int64), np.flatnonzero(at < to)
        while len(left):
            hit = self.key[at[left]] == key[left]
            out[left[hit]] = self.order[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < to[left]]
        return out


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach. counts: of its n-grams, by length."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, kinds: int, mass: float):
        order = len(counts)
        self.depth = order
        #: The empty context: an arc for every token.
        p = (counts[0] + 0.5) / (total + 0.5 * (kinds + 1))
        self.root_weight = np.log10(p)
        # states: 0 is the empty context; then, by length, the contexts that were seen
        state_of, n = [], 1
        for k in range(order - 1):
            number = np.zeros(len(counts[k]), np.int32)
            seen = counts[k] > 0
            number[seen] = n + np.arange(int(seen.sum()))
            state_of.append(number)
            n += int(seen.sum())
        self.fail_to, self.fail_weight = np.zeros(n, np.int64), np.zeros(n)
        for k in range(order - 1):
            seen = np.flatnonzero(counts[k])
            s = state_of[k][seen]
            self.fail_weight[s] = np.log10(mass / (counts[k][seen] + mass))
            if k:
                self.fail_to[s] = state_of[k - 1][grams.suffix[k][seen]]
        self.root_to = state_of[0] if order > 1 else np.zeros(len(p), np.int32)
        source, token, weight, target = [], [], [], []
        lower = p
        for k in range(1, order):
            c, context = counts[k], counts[k - 1][grams.prefix[k]]
            here = (c + mass * lower[grams.suffix[k]]) / (context + mass)
            seen = np.flatnonzero(c)
            source.append(state_of[k - 1][grams.prefix[k][seen]])
            token.append(grams.last[k][seen])
            weight.append(np.log10(here[seen]))
            target.append(state_of[k][seen] if k < order - 1 else state_of[k - 1][grams.suffix[k][seen]])
            lower = here
        join = lambda xs, t: np.concatenate([*xs, np.zeros(0, t)])
        self.weight, self.target = join(weight, float), join(target, np.int32)
        self.arcs = Arcs(join(source, np.int32), join(token, np.int32))

    def traverse(self, token: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The weight of each token but the ends that stand before texts (0 there); lanes of `LANE` tokens are read side by side."""
        out = np.zeros(len(token))
        size = np.diff(first) - 1
        lanes = -(-size // LANE)
        begin = np.repeat(first[:-1] + 1, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(begin + LANE, np.repeat(first[1:], lanes))
        # a lane first reads its context, up to order - 1 tokens, from the empty state
        at = np.maximum(begin - (self.depth - 1), np.repeat(first[:-1], lanes))
        rank = np.argsort(at - stop, kind="stable")
        at, begin, stop = at[rank], begin[rank], stop[rank]
        length, state = stop - at, np.zeros(len(at), np.int64)
        for step in range(int(length.max()) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))
            now = at[:live] + step
            weight, state[:live] = self._read(state[:live], token[now])
            told = now >= begin[:live]
            out[now[told]] = weight[told]
        return out

    def _read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the token and the state after it, for each lane."""
        weight, to = np.zeros(len(state)), np.empty(len(state), np.int64)
        state, left = state.copy(), np.arange(len(state))
        while len(left):
            root = state[left] == 0
            done = left[root]
            weight[done] += self.root_weight[token[done]]
            to[done] = self.root_to[token[done]]
            left = left[~root]
            arc = self.arcs.find(state[left], token[left])
            hit = arc >= 0
            done, arc = left[hit], arc[hit]
            weight[done] += self.weight[arc]
            to[done] = self.target[arc]
            left = left[~hit]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail_to[state[left]]
        return weight, to


def totals(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Training tokens and distinct ones among them, ends included."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    _, count = B.sizes(src)

    def run(batches):
        from pyspark import TaskContext

        task, held = TaskContext.get().partitionId(), []
        for part, texts in T.chunks(batches):
            train = ~held_out(part.column("doc_id").to_pylist(), folds, fold)
            w = T.words([x for x, t in zip(texts, train.tolist(), strict=True) if t], lower=True)
            keys = np.concatenate([w.hashes, np.full(int(train.sum()), _END)])
            held.append(_summed([(keys, np.ones(len(keys), "<u8"))]))
            if sum(len(k) for k, _ in held) > VOCABULARY:
                held = [_summed(held)]
            if len(held[0][0]) > VOCABULARY // 2:
                yield from B.outbox(task, count, *held.pop()).to_batches()
        if held:
            yield from B.outbox(task, count, *_summed(held)).to_batches()

    def add_up(table):
        key, n, _ = B.inbox(table, "<u8")
        return pa.table({"tokens": pa.array([int(n.sum())]), "kinds": pa.array([len(np.unique(key))])})

    each = B.spread(src.mapInArrow(T.tidied(run), B.letters(1)), count, "reducer").groupBy("slot", "reducer").applyInArrow(B.tidy(add_up), "tokens long, kinds long")
    row = each.agg(F.sum("tokens"), F.sum("kinds")).head()
    return row[0] or 0, row[1] or 0


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, first, unique = B.sorted_unique(key)
    return unique, np.add.reduceat(n[order], first) if len(first) else n


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS, folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document, training and held out."""
    train_tokens, kinds = totals(docs, folds, fold, id_col, text_col)
    block_bytes, count = B.sizes(docs.select(id_col, text_col), block_bytes)
    blocks = B.packed(docs.withColumn(id_col, F.col(id_col).cast("long")), count, id_col, text_col, block_bytes)

    def ask(table):
        block, names, texts = B.unpacked(table)
        token, first = tokens(texts)
        grams = Grams(token, first, order)
        key, by = grams.keys()
        train = np.repeat(~held_out(names.to_pylist(), folds, fold), np.diff(first))
        counts = np.concatenate([np.bincount(of[at[train[at]]], minlength=len(h)) for at, of, h in zip(grams.at, grams.of, grams.hash, strict=True)])
        return B.outbox(block, count, key, counts[by].astype("<u8"))

    def add_up(table):
        key, n, bounds = B.inbox(table, "<u8")
        order_, at, _ = B.sorted_unique(key)
        total = np.empty(len(key), "<u8")
        total[order_] = np.repeat(np.add.reduceat(n[order_], at), np.diff(np.append(at, len(key)))) if len(at) else 0
        told = [B.squeeze(total[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.table([table.column("block"), table.column("reducer"), pa.array(told, pa.binary())], names=["block", "reducer", "counts"])

    def traverse(table, mail):
        _, names, texts = B.unpacked(table)
        token, first = tokens(texts)
        grams = Grams(token, first, order)
        key, by = grams.keys()
        counts = np.empty(len(key), np.int64)
        counts[by] = B.answered(mail, "counts", "<u8", len(key)).astype(np.int64)
        counts = grams.by_length(counts)
        grams.forget()
        del key, by, token
        automaton = Automaton(grams, counts, train_tokens, kinds, mass)
        weight = automaton.traverse(grams.token, first)
        base, known = automaton.root_weight[grams.token], counts[0][grams.token] > 0
        base[first[:-1]], known[first[:-1]] = 0, False
        n = len(names)
        cols = [names, pa.array(held_out(names.to_pylist(), folds, fold)), pa.array(np.diff(first) - 1), pa.array(T.sums(known, first)), pa.array(np.full(n, train_tokens)), *(pa.array(np.add.reduceat(x, first[:-1])) for x in (base, weight))]
        return pa.table(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    asked = blocks.groupBy("slot", "block").applyInArrow(B.tidy(ask), B.letters(1))
    answers = B.spread(asked, count, "reducer").groupBy("slot", "reducer").applyInArrow(B.tidy(add_up), "block long, reducer int, counts binary")
    mail = B.spread(answers, count, "block")
    return blocks.groupBy("slot", "block").cogroup(mail.groupBy("slot", "block")).applyInArrow(B.tidy(traverse), SCHEMA)


def choose_mass(docs: DataFrame, order: int = ORDER, candidates: tuple[float, ...] = (50.0, 200.0, 800.0, 3200.0), folds: int = FOLDS, fold: int = FOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, dict[float, float]]:
    """The mass with the best mean log10 probability of a token in one fold of the training documents, scored by the others; the held-out fold is not looked at."""
    key = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rest = docs.where(key != fold)
    other = (fold + 1) % folds
    found = {}
    for mass in candidates:
        row = score(rest, order, mass, folds, other, id_col, text_col).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).head()
        found[mass] = row[0] / row[1] if row[1] else float("-inf")
    return max(found, key=found.get), found

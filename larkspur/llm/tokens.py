"""Token ids of whole texts with the tokenizers library.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges the
bytes of each by itself, so the ids of a pre-token are the same wherever it
stands. Here numpy cuts thousands of texts at once, and the library encodes each
distinct pre-token once; a Python worker keeps the ids of those it has met, up to
a fixed number. Tokenizers of other kinds are asked to encode whole texts, and so
are those texts that hold characters on which two Unicode versions may disagree,
or the string of an added token, which the library makes one id.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import regex

from larkspur.llm import textkit as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of long-settled blocks; a text with others goes to the library whole. So do the separators U+001C to U+001F.
_SETTLED = [(0x00, 0x1B), (0x20, 0x24F), (0x386, 0x3FF), (0x400, 0x481), (0x5D0, 0x5EA), (0x2010, 0x2027), (0x20AC, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: The English endings that byte-level BPE splits from a word.
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_OTHER, _LETTER, _NUMBER, _WHITE, _UNSETTLED = range(5)
#: Bytes of text that are encoded at once.
CHUNK = 2 << 20
#: Pre-tokens that a worker keeps.
CACHE = 1_000_000


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _UNSETTLED, np.uint8)
    for low, high in _SETTLED:
        text = "".join(map(chr, range(low, high + 1)))
        out[low : high + 1] = _OTHER
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"\s")):
            out[[low + m.start() for m in regex.finditer(pattern, text)]] = kind
    return out


def cut(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: runs of letters, of numbers and of others, each with one space before it; of white space, all but its last character apart if more text follows; the English endings."""
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    edge[bounds] = True
    runs = np.flatnonzero(edge[:n])
    after = np.append(runs[1:], n)
    start = edge[:n].copy()
    white = kinds[runs] == _WHITE
    doc_end = np.zeros(n + 1, bool)
    doc_end[bounds] = True
    ends = after[white & ~doc_end[after]]
    blank = points[ends - 1] == 0x20
    start[ends[blank]] = False
    start[ends - 1] = True
    quote = runs[(points[runs] == 0x27) & ~white]
    quote = quote[start[quote]]
    for ending in _ENDINGS:
        size = len(ending)
        at = quote[quote + size <= n]
        for k, ch in enumerate(ending[1:], 1):
            at = at[(points[at + k] == ord(ch)) & ~doc_end[at + k]]
        at = at[at + size < n]
        start[at + 1] = False
        start[at + size] = True
        last = quote[quote + size == n]
        if size == 2 and len(last) and points[n - 1] == ord(ending[1]) and not doc_end[n - 1]:
            start[n - 1] = False
        if size == 3 and len(last) and points[n - 2] == ord(ending[1]) and points[n - 1] == ord(ending[2]) and not doc_end[n - 2 : n].any():
            start[n - 2] = False
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = spec.get("added_tokens") or []
        self.added = [x["content"] for x in added]
        pre = spec.get("pre_tokenizer") or {}
        self.by_pretoken = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(x["special"] for x in added)
        self._forget()
        if self.by_pretoken:
            # byte-level vocabularies write each byte as one character
            self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes_of[i] = len(token)

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, tokens: list[str]) -> list:
        """Encodings of pre-tokens, none of which is an added token."""
        self.tokenizer.encode_special_tokens = True
        found = self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)
        self.tokenizer.encode_special_tokens = False
        return found

    def _ids_of(self, tokens: list[str], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens end to end, and how many each has. Those of a space and letters are told apart inside a longer text."""
        alone, run = np.flatnonzero(~spaced).tolist(), np.flatnonzero(spaced).tolist()
        groups = [run[i : i + 1000] for i in range(0, len(run), 1000)]
        found = self._plain(["".join([tokens[i] for i in g]) for g in groups])
        count = np.zeros(len(tokens), np.int64)
        parts = []
        for g, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(tokens[i].encode()) for i in g])
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            count[g] = np.diff(at, prepend=0)
            parts.append(ids)
        for i, e in zip(alone, self._plain([tokens[i] for i in alone]), strict=True):
            count[i] = len(e.ids)
            parts.append(np.array(e.ids, "<u4"))
        flat = np.concatenate([*parts, np.zeros(0, "<u4")])
        order = np.array(run + alone, np.int64)
        first = np.zeros(len(tokens), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return flat, np.stack([first, count])

    def _learn(self, keys: np.ndarray, tokens: list[str], spaced: np.ndarray) -> None:
        flat, (first, count) = self._ids_of(tokens, spaced)
        first += len(self.flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.first, first), (self.count, count)))
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_pretoken:
            return self._whole(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        if not len(points):
            return [b""] * len(texts)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        kinds = classes()[points]
        strange = T.sums(kinds == _UNSETTLED, bounds) > 0
        starts = cut(points, kinds, bounds)
        ends = np.append(starts[1:], len(points))
        hashes = T.hash_spans(points, starts, ends)
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self._forget()
        new = np.flatnonzero(T.lookup(self.keys, keys) < 0)
        of = sample[new]
        text = "".join(texts)
        spaced = (points[starts[of]] == 0x20) & (kinds[ends[of] - 1] == _LETTER)
        self._learn(keys[new], [text[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)], spaced)
        place = T.lookup(self.keys, keys)
        first, count = self.first[place][inverse], self.count[place][inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        raw = self.flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])].tobytes()
        span = (total[np.searchsorted(starts, bounds)] * 4).tolist()
        out = [raw[a:b] for a, b in zip(span, span[1:], strict=False)]
        if any(x in text for x in self.added):
            strange |= [any(x in t for x in self.added) for t in texts]
        for i in np.flatnonzero(strange):
            out[i] = self._whole([texts[i]])[0]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)

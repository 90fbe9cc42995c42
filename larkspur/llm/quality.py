"""Quality rules, line first.

Every line is judged on its own by three rules; failing lines are removed and a
document that loses too much of its text with them is rejected:

* punctuation: no word of the line ends a sentence, however long the line is, or
  symbols crowd the words;
* navigation: separators stand between the words, as in menus and tag lists, or
  most words are shouted, in capitals or with two exclamation marks;
* boilerplate: a short line that carries a stock phrase (licences, cookies ...).

Sentences end with the marks of Latin, Greek, Armenian, Arabic, Urdu, Devanagari,
Burmese, Ethiopic, Khmer, Tibetan and East Asian scripts. Scripts that write no such mark
(Thai, Lao) fail the punctuation rule; `Rules.needs_sentence` turns it off for them.

A document also fails on two base figures: fewer than `min_words` words, or more
than `max_repeat_pct` percent of its words in 8-word windows that occur twice or
more in it. One pass over the texts, no shuffle; each document is judged whole.

Null text has no words, so it fails as too short. An empty table gives an empty
result. Repeated rows are judged one by one. A very long text is judged whole; a task
holds one such text at a time. Other columns, whatever their names, are passed through
by `filter_documents` and ignored by `assess`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textkit as T

WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#*$%&|<>"]] = True
_LINE_SYMBOLS = re.compile(rb"[#*$%&<>{}\\^~=@_]")
#: Marks of several bytes as alternatives: in a class of bytes each of their bytes would count.
_SEPARATORS = re.compile("[|]|»|›|•|·|‹|«|->|::".encode())
_MARKS = "|".join("…。！？｡؟۔।॥։။።។།")
_SENTENCE_END = re.compile(f"(?:[.!?]|{_MARKS})(?:[\"')\\]]|”|’|»)*(?=\\s|$)".encode())
_STOCK = re.compile(rb"all rights reserved|copyright \(c\)|licensed under|under the [a-z ]{0,40}licen[cs]e|cookie policy|privacy policy|terms of (?:use|service)|subscribe to our|click here|enable javascript|sign up for", re.IGNORECASE)

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_pct: int = 30
    #: Whether a line must hold the end of a sentence.
    needs_sentence: bool = True
    max_symbols_per_word: float = 0.25
    max_separators_per_word: float = 0.2
    max_shouted: float = 0.5
    boilerplate_words: int = 30
    #: The largest share of a document's words that its failing lines may hold.
    max_lost: float = 0.5


def line_fails(line: bytes, n: int, rules: Rules) -> bool:
    """Whether a line of `n` words fails one of the rules."""
    if rules.needs_sentence and not _SENTENCE_END.search(line):
        return True
    if len(_LINE_SYMBOLS.findall(line)) > rules.max_symbols_per_word * n + 1:
        return True
    if len(_SEPARATORS.findall(line)) > rules.max_separators_per_word * n + 1:
        return True
    if n >= 5 and line.count(b"!!") > rules.max_shouted * n:
        return True
    if n >= 5 and not line.islower() and sum(map(_is_shouted, line.split())) > rules.max_shouted * n:
        return True
    return n <= rules.boilerplate_words and _STOCK.search(line) is not None


def _is_shouted(word: bytes) -> bool:
    return len(word) > 3 and word.isupper()


def _judge(text: bytes, rules: Rules) -> tuple[int, int, int, int, list[bytes]]:
    """Repeated lines, lines with words, failed ones, words in those, and the lines that stay."""
    seen: set[bytes] = set()
    dup = lines = failed = lost = 0
    stay = []
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            stay.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line, n, rules):
            failed += 1
            lost += n
        else:
            stay.append(line)
    return dup, lines, failed, lost, stay


def repeat_words(w: T.Words, size: int = WINDOW) -> np.ndarray:
    """Per document, the words in windows whose words occur twice or more in it."""
    h, within = T.windows(w, size)
    at = np.flatnonzero(within)
    if not len(at):
        return np.zeros(len(w.first) - 1, np.int64)
    key = T.mix(h[at] ^ T.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return T.sums(T.cover(len(w.starts), at[order[twice]], size), w.first)


def _assess(texts: list[bytes], rules: Rules) -> tuple[dict[str, np.ndarray], list[list[bytes]]]:
    w = T.words(texts)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    inside = T.SPACED[w.buf] & ((w.buf & 0xC0) != 0x80)
    judged = [_judge(x, rules) for x in texts]
    dup, lines, failed, lost = (np.array(x, np.int64) for x in zip(*(j[:4] for j in judged), strict=True))
    n, again = w.per_doc, repeat_words(w)
    base = (n < rules.min_words) | (100 * again > rules.max_repeat_pct * n)
    out = {
        "n_words": n, "word_chars": T.sums(inside, bounds), "n_symbols": T.sums(_SYMBOLS[w.buf], bounds), "n_dup_lines": dup, "n_repeat_words": again,
        "n_lines": lines, "n_failed_lines": failed, "n_lost_words": lost, "base_failed": base, "kept": ~base & (lost <= rules.max_lost * n),
    }
    return out, [j[4] for j in judged]


def assess(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, the figures, base_failed and kept."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in T.chunks(batches):
            out, _ = _assess(texts, rules)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])

    return src.mapInArrow(T.tidied(run), f"doc_id {kind}, {SCHEMA}")


def filter_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; all columns stay."""
    names = docs.columns
    src = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches):
        for part, texts in T.chunks(batches, text_col):
            out, lines = _assess(texts, rules)
            kept = np.flatnonzero(out["kept"])
            clean = pa.array([b"\n".join(lines[i]).decode() for i in kept], pa.string())
            rows = part.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([clean if c == text_col else rows.column(c) for c in names], names=names)

    return src.mapInArrow(T.tidied(run), src.schema)

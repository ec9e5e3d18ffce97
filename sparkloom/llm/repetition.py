"""Quality rules on repetition within a text, by suffix array and longest-common-prefix intervals.

The symbols are words. Texts are sorted some megabytes at a time: each suffix ends at its own text's end and only suffixes
of one text are compared. Prefix doubling sorts them; the ranks of all rounds give the longest common prefixes. An
interval of the LCP array of value l is a substring of l words that occurs at each of its suffixes; it is maximal if these are not
all preceded by the same word. The spans of the maximal repeats of `min_words` or more words are united.

A text is rejected if it fails the base rules, if more than `max_covered_pct` percent of its words stand in such
spans, or if its longest repeat has more than `max_longest` words.

Defined cases: a null, empty or blank text has no words and fails the base rules (fewer than 10 words). A very long text
makes a step of its own. Rows are judged one by one, so that ties, repeated rows and null ids don't matter. An empty
table gives an empty result. Other columns, whatever their names, are passed through by filter_repetition().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, map_texts, per_text, raw, small_batches, steps, strings, texts, word_spans

MIN_WORDS_OF_TEXT = 10
WINDOW = 5
MAX_WINDOW_PCT = 20
#: Limits of the method: the share that repeated runs of 8 words may take follows public rules for web text (12 % of
#: 8-grams); the longest repeat, exact-substring dedup (50 symbols). The base rules' 20 % of 5-word windows let both pass.
MIN_WORDS = 8
MAX_COVERED_PCT = 12
MAX_LONGEST = 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Order:
    """Suffixes in order, and the LCP of each with the one before it (0 where that is under `least`)."""

    suffix: np.ndarray
    lcp: np.ndarray


def suffix_order(keys: np.ndarray, end: np.ndarray, least: int) -> Order:
    """keys: a number for each text and word, equal only for equal words of one text; end: where each word's text ends."""
    n = len(keys)
    suffix = np.argsort(keys, kind="stable")
    sorted_ = keys[suffix]
    slots = np.arange(n)
    head = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))[:n]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[suffix] = np.maximum.accumulate(np.where(head, slots, 0))
    ranks, size = [rank], 1
    while True:
        equal = np.zeros(n + 1, dtype=bool)
        equal[1:n] = ~head[1:]
        open_ = np.flatnonzero(equal[:n] | equal[1:])
        if not len(open_):
            break
        at = suffix[open_]
        then = at + size
        inside = then < end[at]
        second = np.where(inside, rank[np.where(inside, then, 0)].astype(np.int64) + 1, 0)
        both = rank[at].astype(np.int64) * (n + 1) + second
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        suffix[open_] = at
        first = np.concatenate(([True], both[1:] != both[:-1]))
        head = head.copy()
        head[open_] = first
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(first, open_, 0))
        ranks.append(rank)
        size *= 2
    lcp = np.zeros(n, np.int64)
    level = max(0, least.bit_length() - 1)
    if level < len(ranks) and n > 1:
        of = ranks[level]
        some = np.flatnonzero(of[suffix[1:]] == of[suffix[:-1]]) + 1
        a, b = suffix[some - 1], suffix[some]
        length = np.zeros(len(some), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < end[a]) & (y < end[b])
            same = inside & (ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)])
            length += same << k
        lcp[some] = np.where(length >= least, length, 0)
    return Order(suffix, lcp)


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (length, first, last): slots first..last of the suffix array share exactly `length` >= least leading words."""
    out: list[tuple[int, int, int]] = []
    slots = np.flatnonzero(lcp >= least)
    stack: list[tuple[int, int]] = []  # (length, first slot)
    before = -2
    for p, length in zip(slots.tolist(), lcp[slots].tolist(), strict=True):
        if p != before + 1:
            while stack:
                size, first = stack.pop()
                out.append((size, first, before))
        first = p - 1
        while stack and stack[-1][0] > length:
            size, first = stack.pop()
            out.append((size, first, p - 1))
        if not stack or stack[-1][0] < length:
            stack.append((length, first))
        before = p
    while stack:
        size, first = stack.pop()
        out.append((size, first, before))
    return np.array(out, np.int64).reshape(-1, 3)


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in the union of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


def measure(buf: np.ndarray, off: np.ndarray, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The counts of each text buf[off[i]:off[i + 1]]."""
    n = len(off) - 1
    at, end, doc, inside = word_spans(buf, off)
    n_words = np.bincount(doc, minlength=n)
    out = {
        "n_words": n_words,
        "word_chars": per_text(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_text(_SYMBOLS[buf], off),
        "n_dup_lines": _repeated_lines(buf, off, at),
    }
    ids = strings(buf[inside], end - at).dictionary_encode().indices.to_numpy().astype(np.int64) if len(at) else np.zeros(0, np.int64)
    last = np.cumsum(n_words)[doc]  # the word after the text's last
    order = suffix_order(doc * (len(ids) + 1) + ids, last, min(WINDOW, min_words))
    suffix, lcp = order.suffix, order.lcp
    deepest = np.maximum(lcp, np.concatenate((lcp[1:], [0]))[: len(lcp)])  # of each slot, its longest match
    some = np.flatnonzero(deepest >= WINDOW)
    out["n_repeat_words"] = np.bincount(doc[_covered(suffix[some], np.full(len(some), WINDOW), len(ids))], minlength=n)
    found = lcp_intervals(lcp, min_words)
    # maximal: a suffix of the interval begins its text, or two are preceded by different words
    before = np.where((suffix > 0) & (doc[suffix - 1] == doc[suffix]), ids[suffix - 1], -1 - suffix) if len(ids) else ids
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if len(ids) else ids
    maximal = changes[found[:, 2]] > changes[found[:, 1]] if len(found) else np.zeros(0, bool)
    found = found[maximal]
    of = doc[suffix[found[:, 1]]]
    out["n_repeats"] = np.bincount(of, minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of, found[:, 0])
    out["longest_repeat"] = longest
    # a suffix's longest span stands in its deepest interval; where that is not maximal, a longer span that begins a word earlier covers it
    some = np.flatnonzero(deepest >= min_words)
    out["n_covered_words"] = np.bincount(doc[_covered(suffix[some], deepest[some], len(ids))], minlength=n)
    return out


def _repeated_lines(buf: np.ndarray, off: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of their text; words: where each word begins."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate((off[:-1], breaks + 1))
    doc = np.concatenate((np.arange(n), np.searchsorted(off, breaks, side="right") - 1))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    if not len(starts):
        return np.zeros(n, np.int64)
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    ends = np.where(last, off[doc + 1], np.concatenate((starts[1:] - 1, [0])))
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    ids = strings(buf[buf != 10], ends - starts).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc, ids = doc[full], ids[full]
    distinct = np.unique(doc * (len(starts) + 1) + ids) // (len(starts) + 1)
    return np.bincount(doc, minlength=n) - np.bincount(distinct, minlength=n)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered_words", "longest_repeat"]


def verdicts(column: pa.StringArray, min_words: int = MIN_WORDS, max_covered_pct: int = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    buf, off = raw(column)
    parts = [measure(buf[off[a] : off[b]], off[a : b + 1] - off[a], min_words) for a, b in steps(off)]
    out = {c: np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS}
    out["base_failed"] = (out["n_words"] < MIN_WORDS_OF_TEXT) | (100 * out["n_repeat_words"] > MAX_WINDOW_PCT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered_words"] <= max_covered_pct * out["n_words"]) & (out["longest_repeat"] <= max_longest)
    return out


def judge_repetition(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """doc_id and the counts and verdicts of every row."""

    def run(column: pa.StringArray) -> Iterator[pa.Array]:
        found = verdicts(column, **limits)
        return (pa.array(found[c]) for c in [*COUNTS, "base_failed", "kept"])

    fields = [*(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept"))]
    return map_texts(df, run, fields, text, [doc_id])


def filter_repetition(df: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """df without the rows that are rejected; only the text goes to Python, only the verdict comes back."""
    small_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def kept(column: pa.Array) -> pa.Array:
        return pa.array(verdicts(texts(column), **limits)["kept"])

    return df.where(kept(F.col(f"`{text}`").cast("string")))


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_repetition(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", (F.col("longest_repeat") > MAX_LONGEST).alias("too_long"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines FROM d),
w AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM base, (VALUES ({WINDOW}), ({MIN_WORDS}), ({MAX_LONGEST + 1})) AS s(k) WHERE len(ws) >= k)),
r AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, w) AS n FROM w) WHERE n > 1),
covered AS (SELECT doc_id, k, count(DISTINCT i + j) AS n FROM r, range(0, {MIN_WORDS}) AS o(j) WHERE j < k AND k <= {MIN_WORDS} GROUP BY doc_id, k),
long AS (SELECT DISTINCT doc_id FROM r WHERE k = {MAX_LONGEST + 1}),
a AS (SELECT b.*, coalesce(f.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS n_covered_words, long.doc_id IS NOT NULL AS too_long
      FROM base b LEFT JOIN covered f ON f.doc_id = b.doc_id AND f.k = {WINDOW} LEFT JOIN covered m ON m.doc_id = b.doc_id AND m.k = {MIN_WORDS} LEFT JOIN long ON long.doc_id = b.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS_OF_TEXT} OR 100 * n_repeat_words > {MAX_WINDOW_PCT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_covered_words <= {MAX_COVERED_PCT} * n_words AND NOT too_long AS kept, n_covered_words, too_long FROM v
"""

"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest vocabulary piece that begins the rest of a word.
The vocabulary stands in a trie, whose nodes have failure links: where no edge matches the next character, the link of
a node leads to the node that stands for what is left after the greedy pieces are taken off its string, and with it
stands how many pieces that takes. So each character is read once and only counts are added; pieces are not built.

Words are those of ASCII white space. A vocabulary has pieces that begin a word and pieces that continue one. A word
that can't be covered is one unknown token.

Defined cases: a null, empty or blank text has 0 words and tokens. Very long words and texts are read whole. Rows are
counted one by one, so ties, repeated rows and null ids don't matter. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import documents, map_texts, raw, steps, strings, word_spans

#: The vocabulary file: a sentencepiece model, whose pieces that begin a word have a leading U+2581.
VOCABULARY = os.environ.get("WORDPIECE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Words whose counts a Python worker keeps.
CACHE_WORDS = 200_000


class Automaton:
    """Counts the greedy pieces of a word."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # 0: at the beginning of a word, 1: within one
        piece: list[bool] = [False, False]
        chars: list[str] = ["", ""]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                node = root
                for c in p:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        chars.append(c)
                    node = self.next[node][c]
                if p:
                    piece[node] = True
        n = len(self.next)
        #: Where to go on, or -1; and the pieces that are taken off on the way.
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([(0, -1), (1, -1)])
        while queue:
            node, parent = queue.popleft()
            if parent >= 0:
                if piece[node]:
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    c, at, taken = chars[node], self.fail[parent], self.pops[parent]
                    while at >= 0 and c not in self.next[at]:
                        taken += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.next[at][c], taken
            queue.extend((child, node) for child in self.next[node].values())

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if it can't be covered."""
        nxt, fail, pops = self.next, self.fail, self.pops
        at = taken = 0
        for c in word:
            to = nxt[at].get(c)
            while to is None:
                taken += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = nxt[at].get(c)
            at = to
        while at > 1:  # what is left is taken off
            taken += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return taken


@cache
def automaton(path: str) -> Automaton:
    """The automaton of a sentencepiece model's pieces; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Automaton([p[1:] for p in plain if p.startswith(MARK) and len(p) > 1], [p for p in plain if MARK not in p])


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """df's columns `keep` with n_words, n_tokens and n_unknown (words that can't be covered, one token each)."""

    def run(column: pa.StringArray) -> Iterator[pa.Array]:
        machine = automaton(vocabulary)
        known = _known(vocabulary)
        buf, off = raw(column)
        out = []
        for first, last in steps(off):
            part, own = buf[off[first] : off[last]], off[first : last + 1] - off[first]
            at, end, doc, inside = word_spans(part, own)
            words = strings(part[inside], end - at).dictionary_encode()
            counts = np.empty(len(words.dictionary), np.int64)
            for i, w in enumerate(words.dictionary.to_pylist()):
                n = known.get(w)
                if n is None:
                    n = machine.count(w)
                    if len(known) < CACHE_WORDS and len(w) < 64:
                        known[w] = n
                counts[i] = n
            each = counts[words.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
            n = last - first
            total = lambda weights=None, doc=doc, n=n: np.bincount(doc, weights, n).astype(np.int64)
            out.append((total(), total(np.maximum(each, 1)), total(each < 0)))
        return (pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)) for k in range(3))

    return map_texts(df, run, [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")], text, list(keep))


@cache
def _known(vocabulary: str) -> dict[str, int]:
    return {}


def op6_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))

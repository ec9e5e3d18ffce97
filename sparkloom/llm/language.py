"""Language identification with a string kernel.

The kernel of two texts is the number of distinct character n-grams (n = 1 to 3, a blended spectrum of presence) that
both hold, over the square root of the product of the numbers that each holds. Landmarks from a bounded sample give the
Nyström feature map K(x, L) K(L, L)^(-1/2); on it, one-versus-rest kernel ridge regression learns a score for each
language. A batch of texts is scored by two matrix products: presence by landmarks, then landmarks by languages.

N-grams are those of lower-cased letters in runs, with one blank between runs; digits and signs count as blanks. Every
letter of every script keeps its identity: the code points of an n-gram are hashed to one of 2 ** 17 columns, of which a
text of some thousand different n-grams fills one in a hundred, so that few meet.

The sample is at most `per_lang` different labelled texts a language, by the order of their hashes, of each at most
`chars` characters at a place that the hash gives. Texts to be predicted are read whole.

Defined cases: `und` with score 0 for a null, empty or letterless text, or when no row is labelled. With one language in
the sample all texts with a letter get it. Rows with null lang are not learned from. Ties go to the language first in
alphabetical order. Repeated rows get the same prediction. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, map_texts, raw, steps

PER_LANG = 400
SIEVE = 8
SAMPLE_CHARS = 2000
LANDMARKS = 256
RIDGE = 1e-3
#: Landmarks of a language at least, if the languages are so many that LANDMARKS don't go round.
LANDMARKS_OF_EACH = 4
#: Columns of the presence matrix, as a power of 2, and the texts of one step.
WIDTH_BITS = 17
STEP_TEXTS = 64
UNKNOWN = "und"
FOLDS = 5


def _symbols(text: str) -> str:
    return text.lower()


@dataclass
class Model:
    langs: list[str]
    columns: np.ndarray  # the n-grams that a landmark holds
    packed: np.ndarray  # presence of these, by landmark, eight in a byte
    sizes: np.ndarray  # square roots of the landmarks' numbers of n-grams
    weights: np.ndarray  # landmarks by languages

    @cached_property
    def presence(self) -> np.ndarray:
        return np.unpackbits(self.packed, axis=1, count=len(self.columns)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "presence"}  # tasks unpack their own


#: Characters that one step works on.
BLOCK = 1 << 20
#: Odd numbers that the places of an n-gram are multiplied by.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTER = np.zeros(0x110000, dtype=bool)


def _letter_table() -> np.ndarray:
    if not _LETTER[ord("a")]:
        for c in range(0x110000):
            if chr(c).isalpha():
                _LETTER[c] = True
    return _LETTER


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, those of letters only (others 0), and offsets."""
    low = [_symbols(t) for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letter_table()[points], points, 0).astype(np.uint32), off


def _column(code: np.ndarray) -> np.ndarray:
    """The column of hashed n-grams: the upper bits of a product are mixed best."""
    code = (code ^ (code >> np.uint64(29))) * _MIX[1]
    return (code >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams (1, 2 and 3 symbols) each text holds, as a matrix of bool; and whether it has a letter."""
    symbol, off = _points(texts)
    out = np.zeros((len(texts), 1 << WIDTH_BITS), dtype=bool)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
    # one blank between runs of letters
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    keep[off[:-1][np.diff(off) > 0]] = True
    symbol, doc = symbol[keep], doc[keep]
    # flat places in the matrix: a scatter for each length of n-gram, over blocks that overlap by two symbols
    flat = out.ravel()
    for k in range(0, len(symbol), BLOCK):
        s, d = symbol[k : k + BLOCK + 2].astype(np.uint64) + np.uint64(1), doc[k : k + BLOCK + 2]
        row = d.astype(np.int64) << WIDTH_BITS
        one = s * _MIX[0]
        flat[row + _column(one)] = True
        two = (one[:-1] ^ s[1:]) * _MIX[2]
        flat[(row[:-1] + _column(two))[d[:-1] == d[1:]]] = True
        three = (two[:-1] ^ s[2:]) * _MIX[0]
        flat[(row[:-2] + _column(three))[d[:-2] == d[2:]]] = True
    some = np.zeros(len(texts), dtype=bool)
    some[doc[symbol > 0]] = True
    return out, some


def _kernel(held: np.ndarray, columns: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.maximum(1, held.sum(axis=1)))
    return (held[:, columns].astype(np.float32) @ marks.T) / (norms[:, None] * sizes[None, :])


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of (text, lang) pairs; beside these it holds the landmarks' n-grams and a row of kernel values a pair."""
    sample = [(t, g) for t, g in sample if any(c.isalpha() for c in t)]
    if not sample:
        return None
    langs = sorted({g for _, g in sample})
    # landmarks: in turn from each language, in the sample's order
    of: dict[str, list[int]] = {g: [] for g in langs}
    for i, (_, g) in enumerate(sample):
        of[g].append(i)
    chosen = sorted((k, g, i) for g in langs for k, i in enumerate(of[g]))[: max(landmarks, LANDMARKS_OF_EACH * len(langs))]
    marks = np.array([i for _, _, i in chosen])
    blocks = [presence([sample[i][0] for i in marks[k : k + STEP_TEXTS]])[0] for k in range(0, len(marks), STEP_TEXTS)]
    columns = np.flatnonzero(np.any([b.any(axis=0) for b in blocks], axis=0))
    sizes = np.sqrt(np.concatenate([b.sum(axis=1) for b in blocks]))
    packed = np.concatenate([np.packbits(b[:, columns], axis=1) for b in blocks])
    model = Model(langs, columns, packed, sizes, np.zeros((len(marks), len(langs)), np.float32))
    kernel = np.concatenate([_kernel(presence([t for t, _ in sample[k : k + STEP_TEXTS]])[0], columns, model.presence, sizes) for k in range(0, len(sample), STEP_TEXTS)])
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K(L, L)^(-1/2) up to a rotation
    features = kernel @ root
    targets = np.array([[1.0 if g == lang else -1.0 for lang in langs] for _, g in sample])
    # each language counts alike, whatever its rows
    share = np.array([1.0 / len(of[g]) for _, g in sample])[:, None]
    solved = np.linalg.solve(features.T @ (share * features) + ridge * np.eye(features.shape[1]), features.T @ (share * targets))
    model.weights = (root @ solved).astype(np.float32)
    return model


def predict(texts: list[str], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """The language and score of each text."""
    lang = np.full(len(texts), UNKNOWN, dtype=object)
    score = np.zeros(len(texts))
    if model is None or not texts:
        return lang, score
    held, some = presence(texts)
    scores = _kernel(held, model.columns, model.presence, model.sizes) @ model.weights
    best = scores.argmax(axis=1)
    lang[some] = np.array(model.langs, dtype=object)[best[some]]
    score[some] = np.clip((scores[np.arange(len(texts)), best][some] + 1) / 2, 0, 1)
    return lang, score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is a multiple of 5; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def sample(df: DataFrame, text: str, lang: str, doc_id: str, per_lang: int = PER_LANG, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """The bounded labelled sample: per_lang different texts a language, chars characters of each.

    A first sieve lets through the smallest hashes, of some SIEVE times per_lang different texts a language, so that what
    is shuffled to be ranked doesn't grow with the input; copies of a text are one row before the shuffle. The ranking is
    by the same order, so that the sieve takes away nothing that would be chosen.
    """
    value = F.col(f"`{text}`")
    usable = df.where(F.col(f"`{lang}`").isNotNull() & value.isNotNull() & ~held_out(F.col(f"`{doc_id}`"))).select(F.col(f"`{lang}`").cast("string").alias("g"), value.alias("t"), F.xxhash64(value).alias("h"))
    counts = usable.groupBy("g").agg(F.approx_count_distinct("h").alias("n"))  # a row a language, each of which the model holds as well
    sieved = usable.join(F.broadcast(counts), "g").where((F.col("h") / F.lit(float(1 << 64)) + F.lit(0.5)) * F.col("n") < F.lit(float(SIEVE * per_lang)))
    window = F.substring("t", (1 + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - chars))).cast("int"), F.lit(chars))
    different = sieved.groupBy("g", "h").agg(F.min(window).alias("t"))
    ranked = different.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("i") <= per_lang)
    return [(r["t"], r["g"]) for r in ranked.orderBy("g", "i").collect()]  # per_lang rows a language


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df's columns `keep` with lang_pred and score."""

    def run(column: pa.StringArray) -> Iterator[pa.Array]:
        _, off = raw(column)
        values, langs, scores = column.to_pylist(), [], []
        for first, last in steps(off, 1 << 20):
            for a in range(first, last, STEP_TEXTS):
                lang, score = predict(values[a : min(a + STEP_TEXTS, last)], model)
                langs += lang.tolist()
                scores += score.tolist()
        return iter((pa.array(langs, pa.string()), pa.array(scores, pa.float64())))

    return map_texts(df, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text, list(keep))


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(sample(docs, "text", "lang", "doc_id"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

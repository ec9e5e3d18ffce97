"""Benchmark decontamination by template canonicalisation.

Words are turned into template tokens: numbers, names (capitalised words; several in a row are one) and units become
typed placeholders, other words are lower-cased, and outer punctuation goes. Windows of 13 template tokens of the
benchmark are hash-joined with those of the documents. A pair of windows counts if their slots are consistent: equal
values in one stand at equal values in the other and different ones at different ones, so that a question with other
names and numbers is found, but not two texts that merely share a frame. That is so if the slots' values recur in the same
pattern; the pattern stands in the window's key beside its tokens, so that the check is part of the join and equal
windows of many items meet a document's window once. Both sides are also read with their names as plain
words, for other capitals, as at the beginning of a sentence. A benchmark item of fewer tokens than a window
is looked up whole. Windows in which less than half of the tokens are plain words, and items of fewer than 6 tokens, say
too little as templates: they are looked up by their exact words (whatever the capitals and outer punctuation), so that
every item's verbatim copies are found. A match counts once for each word of the document at which one begins.

The documents' windows are first tried against a bitmap of the benchmark's hashes, of at most MOST_BITS bits however
large the benchmark is; what passes it is joined by shuffle. The bitmap only saves shuffling: a full one lets more pass.

Defined cases: a null text is empty. Null benchmark texts and items without a word are not looked up. Repeated rows and
repeated items are judged alike. A null doc_id is judged like any other. Very long texts are read whole. With an empty
benchmark nothing is contaminated; an empty table gives an empty result. Other columns are passed through by
drop_contaminated(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, documents, like, raw, salted, small_batches, steps, strings, texts, word_spans

WINDOW = 13
SHORTEST = 6
#: Bits of the bitmap for a window of the benchmark, and at least and at most in all, as powers of 2 (8 MB).
BITS_A_WINDOW = 512
LEAST_BITS, MOST_BITS = 16, 26
#: Matches up to which they are broadcast to the documents (some 60 bytes each).
SENT_MATCHES = 100_000
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Fixed values.
_NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years km/h mph m/s % percent $ € £ dollar dollars cent cents euro euros".split())
_SPECIAL, _PLAIN = _NUMBERS | _UNITS, (False,) * 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def canonical(word: str, names: bool = True) -> tuple[str, str, bool]:
    """(token, value, whether the word ends a phrase) of a word with its punctuation; token "" for none. Without `names`, capitals don't matter."""
    ends = word[-1] in ".!?:;,"
    core = word.strip("\"'`.,;:!?()[]{}<>#*&|-–—…«»„“”‘’¿¡/\\~^_=+")
    if not core:
        core = word if word in _UNITS else ""
        return (UNIT, word, ends) if core else ("", "", ends)
    low = core.lower()
    plain = core.isalpha()
    if not plain and any(c.isdigit() for c in core):
        return NUMBER, low, ends
    if low in _NUMBERS:
        return NUMBER, low, ends
    if low in _UNITS:
        return UNIT, low, ends
    letters = len(core) if plain else sum(c.isalpha() for c in core)
    if not letters:
        core = core.strip("%$€£")
        return (UNIT, low, ends) if not core else (low, low, ends)
    if names and letters > 1 and core[0].isupper() and not core.isupper():
        return NAME, low, ends
    return low, low, ends


def _token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


@dataclass
class Tokens:
    """Template tokens of some texts, one after another; texts have numbers, ascending."""

    doc: np.ndarray
    hashes: np.ndarray
    slot: np.ndarray  # whether it is a placeholder
    ids: np.ndarray  # of the words
    starts: np.ndarray  # first word of the token, and the word after its last
    stops: np.ndarray
    words: list[tuple[str, str, bool]] = field(default_factory=list)
    exact: np.ndarray | None = None  # hashes of the words themselves, if no names are joined

    def token(self, i: int) -> str:
        return self.words[self.ids[self.starts[i]]][0]

    def value(self, i: int) -> str:
        return " ".join(self.words[k][1] for k in self.ids[self.starts[i] : self.stops[i]])


class _Lexicon:
    """The words seen, each with both of its canonical forms."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.words: tuple[list, list] = ([], [])  # with names as plain words, and with names
        self.hashes = np.zeros((3, 1 << 12), np.uint64)  # of these tokens, and of the word itself
        self.flags = np.zeros((5, 1 << 12), bool)  # slots of either form, names, ends of phrases, words without a token

    def look_up(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new, hashes, flags = np.flatnonzero(ids < 0), [], []
        first = len(self.at)
        for k, word in enumerate((words[k] for k in new.tolist()), first):
            self.at[word] = k
            self.chars += len(word)
            if word.islower() and word.isalpha() and word not in _SPECIAL:  # most words: they are their own token
                h, own = _token_hash(word), (word, word, False)
                self.words[0].append(own)
                self.words[1].append(own)
                hashes.append((h, h, h))
                flags.append(_PLAIN)
                continue
            token, value, ends = named = canonical(word)
            name = token == NAME
            slot = name or token == NUMBER or token == UNIT
            h = _token_hash(value)
            of = _token_hash(token) if slot else h
            self.words[0].append((value, value, ends) if name else named)
            self.words[1].append(named)
            hashes.append((h if name else of, of, h))
            flags.append((slot and not name, slot, name, ends, not token))
        if hashes:
            last = first + len(hashes)
            while last > self.hashes.shape[1]:
                self.hashes, self.flags = (np.concatenate((x, np.zeros_like(x)), axis=1) for x in (self.hashes, self.flags))
            self.hashes[:, first:last] = np.array(hashes, np.uint64).T
            self.flags[:, first:last] = np.array(flags, bool).T
            ids[new] = np.arange(first, last)
        return ids


_lexicon = _Lexicon()


def tokenise(buf: np.ndarray, off: np.ndarray) -> tuple[Tokens, Tokens]:
    """The tokens with names as placeholders, and with names as plain words: there each word is a token."""
    global _lexicon
    at, end, doc, inside = word_spans(buf, off)
    if not len(at):
        none = np.zeros(0, np.int64)
        empty = Tokens(none, none.astype(np.uint64), none.astype(bool), none, none, none, exact=none.astype(np.uint64))
        return empty, empty
    spelt = strings(buf[inside], end - at).dictionary_encode()
    if len(_lexicon.at) > 400_000 or _lexicon.chars > 8_000_000:
        _lexicon = _Lexicon()
    ids = _lexicon.look_up(spelt.dictionary.to_pylist())[spelt.indices.to_numpy()]
    real = ~_lexicon.flags[4][ids]  # words that are punctuation only are left out
    ids, doc = ids[real], doc[real]
    return _tokens(_lexicon, ids, doc, True), _tokens(_lexicon, ids, doc, False)


def _tokens(of: _Lexicon, ids: np.ndarray, doc: np.ndarray, named: bool) -> Tokens:
    starts = np.arange(len(ids))
    if named:
        name = of.flags[2][ids]
        joined = np.zeros(len(ids), dtype=bool)  # a name that goes on
        joined[1:] = name[1:] & name[:-1] & ~of.flags[3][ids[:-1]] & (doc[1:] == doc[:-1])
        starts = np.flatnonzero(~joined)
    stops = np.concatenate((starts[1:], [len(ids)])) if len(starts) else starts
    first = ids[starts]
    return Tokens(doc[starts], of.hashes[int(named)][first], of.flags[int(named)][first], ids, starts, stops, of.words[named], None if named else of.hashes[2][first])


def window_hashes(tokens: Tokens, size: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of each window of `size` tokens within one text; of -size: those that say too little as templates, by their exact words."""
    exact, size = size < 0, abs(size)
    n = len(tokens.doc) - size + 1
    if n <= 0 or exact and tokens.exact is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = tokens.doc[:n] == tokens.doc[size - 1 :]
    plain = np.concatenate(([0], np.cumsum(~tokens.slot)))
    telling = (2 * (plain[size:] - plain[:-size]) >= size) & (size >= min(SHORTEST, window))
    first = np.flatnonzero(good & ~telling if exact else good & telling)
    of = tokens.exact if exact else tokens.hashes
    few = 4 * len(first) < n  # else slices of all are faster
    h = np.full(len(first) if few else n, size, np.uint64)
    for k in range(size):
        h = (h * _PRIME) ^ (of[first + k] if few else of[k : k + n])
        h ^= h >> np.uint64(29)
    return first, h if few else h[first]


def pattern(values: list[str]) -> list[int]:
    """Of each value, where it stood first. Two lists correspond one to one if they have one pattern."""
    first: dict[str, int] = {}
    return [first.setdefault(v, len(first)) for v in values]


def _key(tokens: Tokens, i: int, size: int) -> str:
    """What windows have to agree in: tokens and the pattern of the slots' values, each with its kind; of -size: the words. No token holds a blank."""
    if size < 0:
        return "=" + " ".join(tokens.value(i + k) for k in range(-size))
    kinds = [tokens.token(i + k) for k in range(size)]
    slots = pattern([f"{kinds[k]}{tokens.value(i + k)}" for k in range(size) if tokens.slot[i + k]])
    return f"~{' '.join(kinds)}\n{' '.join(map(str, slots))}"


#: Of windows: the text's number, the word at which it begins, its hash and its key.
Windows = tuple[list[int], list[int], list[int], list[str]]


def windows(column: pa.StringArray, sizes: list[int] | None, window: int = WINDOW, bits: np.ndarray | None = None) -> Windows:
    """The windows of these sizes whose hash stands in the bitmap; with sizes None (benchmark items): all of each text's own size."""
    doc, at, hashes, keys = out = [], [], [], []
    buf, off = raw(column)
    # a benchmark item's size is its own, so it makes a step
    for a, b in steps(off) if sizes is not None else ((k, k + 1) for k in range(len(column))):
        for tokens in tokenise(buf[off[a] : off[b]], off[a : b + 1] - off[a]):
            own = min(window, len(tokens.doc))
            for size in sizes if sizes is not None else (own, -own) if own else ():
                first, h = window_hashes(tokens, size, window)
                if bits is not None:
                    place = h & np.uint64(8 * len(bits) - 1)
                    some = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    first, h = first[some], h[some]
                for i, x in zip(first.tolist(), h.view(np.int64).tolist(), strict=True):
                    doc.append(a + int(tokens.doc[i]))
                    at.append(int(tokens.starts[i]))
                    hashes.append(x)
                    keys.append(_key(tokens, i, size))
    return out


def _window_rows(df: DataFrame, text: str, keep: str, sizes: list[int] | None, window: int, bits: np.ndarray | None = None) -> DataFrame:
    """df's column `keep` with a row for each window: at, hash, key."""
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[keep], T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, at, hashes, keys = windows(texts(batch.column(1)), sizes, window, bits)
                if doc:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(at, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.string())], names=schema.names)

    return df.select(F.col(f"`{keep}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def _bitmap(theirs: DataFrame) -> np.ndarray:
    """Bytes in which the bits that the hashes name are set."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * theirs.count()).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    found = theirs.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63L as int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return words.view(np.uint8)


def _row_key(doc_id: str, text: str) -> Column:
    """Rows of one key have the same text, hence the same matches."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))


def _found(df: DataFrame, bench: DataFrame, text: str, doc_id: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The documents' windows (row, at, key) that pass the bitmap, and the benchmark's (item, key), each once."""
    theirs = cut(_window_rows(bench.where("text is not null"), "text", "item_id", None, window).select(F.col("item_id").alias("item"), "hash", "key").distinct())
    sizes = [r[0] for r in theirs.select(F.when(F.col("key").startswith("="), -F.size(F.split("key", " "))).otherwise(F.size(F.split(F.substring_index("key", "\n", 1), " ")))).distinct().collect()]  # twice WINDOW at most
    rows = df.select(_row_key(doc_id, text).alias("row"), F.col(f"`{text}`").alias("text"))
    ours = _window_rows(rows, "text", "row", sorted(sizes), window, _bitmap(theirs))
    return ours.select("row", "at", "key"), theirs.select("item", "key")


def _sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SENT_MATCHES else df


def find_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) and n_windows (words at which a match begins, by item) of every row."""
    ours, theirs = _found(df, bench, text, doc_id, window)
    # a passage that many documents hold is dealt to several tasks
    hits = cut(salted(ours, theirs, "key", "row").select("row", "at", "item").distinct().groupBy("row", "item").agg(F.count(F.lit(1)).alias("n")))
    by = hits.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("item_ids"), F.sum("n").alias("n_windows"))
    rows = df.select(F.col(f"`{doc_id}`").alias(doc_id), _row_key(doc_id, text).alias("row"))
    out = rows.join(F.broadcast(by) if hits.count() <= SENT_MATCHES else by, "row", "left")
    none = F.array().cast(T.ArrayType(hits.schema["item"].dataType))
    return out.select(F.col(f"`{doc_id}`"), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def drop_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """df without the contaminated rows."""
    ours, theirs = _found(df, bench, text, doc_id, window)
    bad = cut(salted(ours, theirs.select("key").distinct(), "key", "row").select(F.col("row").alias("__bad")).distinct())
    row = like("__row", df)
    return df.withColumn(row, _row_key(doc_id, text)).join(_sent(bad.withColumnRenamed("__bad", row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op9_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

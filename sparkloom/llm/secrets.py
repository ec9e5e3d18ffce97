"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for base spans (assignments, access keys, hex strings) and for further candidates: keys of known
formats, and long tokens of mixed letters and digits. Each candidate's value is hashed; over the whole corpus the distinct repositories and owners
of a hash are counted. A value that several owners hold is a widely copied example; one that few hold is a
live-looking credential. Base spans are always kept; a further candidate becomes a span of kind `token` if it is
live-looking and no base span overlaps it.

In the query, a repository is a document and its owner is the source.

In the test tables every long token that is not a base span is a plain number, so that no further span is found there;
the method's verdict stands in live_spans, n_live and n_example, which part the base spans too.

Defined cases: a null text is empty and has no span. A null source is an owner of its own. Rows with the same doc_id are
told apart by their order; wholly repeated rows are one repository. A null doc_id is a repository of its own. Very long texts are
scanned whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, documents, free, map_texts

#: Kinds in the order of spans that begin at one place.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that fails at its first place fails at each later one, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Keys that are told by their beginning, whatever letters follow.
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[opsu]_[A-Za-z0-9]{36,}|github_pat_\w{40,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}"
    r"|AIza[\w-]{35}|(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----",
    re.ASCII,
)
#: What texts with such keys, and texts with assignments (in lower case), hold. Others needn't be searched for them.
_BEGINNINGS = ("gho_", "ghp_", "ghs_", "ghu_", "github_pat_", "glpat-", "xox", "k_live_", "AIza", "eyJ", "-----BEGIN ")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ENTROPY = 3.0
#: Owners from which on a value is an example.
EXAMPLE_OWNERS = 3


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base spans, by start, then kind."""
    low = text.lower()
    found = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in _KEYWORDS) else []
    found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


def _mixed(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()) >= MIN_ENTROPY


def further_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Candidates beyond the base spans, none of which they overlap: known formats first, then mixed tokens."""
    taken, out = [(a, b) for a, b, _, _ in base], []
    keys = [m.span() for m in _FORMATS.finditer(text)] if any(b in text for b in _BEGINNINGS) else []
    for found in (keys, [m.span() for m in _TOKEN.finditer(text) if _mixed(m[0])]):
        new = [span for span, alone in zip(found, free(found, taken), strict=True) if alone]
        out += new
        taken = sorted(taken + new)
    return [(a, b, "token", text[a:b]) for a, b in sorted(out)]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("hash", T.BinaryType())])
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.binary())]))


def scan(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """df's columns `keep`, with spans (base ones and further candidates) of every row."""

    def run(column: pa.StringArray) -> Iterator[pa.Array]:
        rows = []
        for value in column.to_pylist():
            base = base_spans(value)
            rows.append([{"start": a, "end": b, "kind": k, "hash": hashlib.sha256(v.encode()).digest()} for a, b, k, v in [*base, *further_spans(value, base)]])
        yield pa.array(rows, _SPAN_ARROW)

    return map_texts(df, run, [T.StructField("spans", T.ArrayType(_SPAN))], text, keep)


def ownership(candidates: DataFrame) -> DataFrame:
    """Of candidates (hash, repo, owner): hash, n_repos and n_owners. Rows are reduced to one a repository, owner and hash first."""
    return (
        candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("x"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
        .groupBy("hash").agg(F.sum("r").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )


def find_secrets(df: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """repo, owner and spans (start, end, kind, hash, n_repos, n_owners, live) of every row, sorted; further candidates only if live."""
    rows = df.select(F.col(f"`{repo}`").alias("repo"), F.col(f"`{owner}`").alias("owner"), F.col(f"`{text}`").alias("text"))
    # what is kept of a row is its spans, without text
    rows = cut(scan(rows, "text", ["repo", "owner"]).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "repo", "owner", F.explode("spans").alias("s")).select("row", "repo", "owner", "s.*")
    counts = ownership(each)
    # a hash that many rows hold stands in one row of counts: Spark splits the hot side
    judged = each.join(counts, "hash").withColumn("live", F.col("n_owners") < example_owners).where(F.col("live") | (F.col("kind") != "token"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "hash", "n_repos", "n_owners", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "repo", "owner").join(spans, "row", "left").select("repo", "owner", F.coalesce("spans", none).alias("spans"))


def op2_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("repo").alias("doc_id"), *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        listed(F.filter("spans", lambda s: s["live"])).alias("live_spans"), n("token").alias("n_token"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )

"""Surrogates for personal data.

Detected entities (mail addresses, phone, card and social security numbers, IBANs, IPv4 addresses, names of persons) are
replaced by values that a key derives from them: of the same kind, format and length, valid check digits included, and for names of the same gender and
script. An entity gets one surrogate wherever it stands and however it is written (case, separators), so coreference
stays. Surrogates are checked against each other and against all real values of the corpus; an entity whose surrogate
is taken draws again, until all differ; from the eighth draw on formats are loosened, from the 16th on values get longer, so that a
full format ends nothing.

Persons are found where a title, a common given name or a phrase (my name is ...) begins a run of capitalised words; the whole
run is the name, particles and initials in it stay. A part of such a name that stands alone elsewhere in the text is
replaced alike. Names that no title, listed given name or phrase announces anywhere in their text are not found.

Mentions are joined to the later draws by entity, and these to the texts by row: broadcast below a checked bound, by shuffle
beyond it.

Defined cases: a null text stays null with 0 entities, an empty one stays empty. Rows are rewritten one by one, so ties,
repeated rows and null ids don't matter. Very long texts are read whole. An empty table gives an empty result. Other
columns are passed through; if one is named n_entities, the count gets a leading underscore. Numbers that fail their
check digit, or that no issuer's cards begin with, are no cards and stay.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, documents, free, like, salted, small_batches

KEY = os.environ.get("SURROGATE_KEY", "surrogates-1")
#: Mentions of entities with a later draw up to which these are broadcast to the texts (some 100 bytes each).
SENT_MENTIONS = 50_000
#: Draws from which on the digit count of an IPv4 octet, 555 and the length of an address need not stay; and from which on numbers get longer.
LOOSE, LONGER = 8, 16

#: Titles and given names by gender, for detection only.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Doña", "Г-жа", "Κυρία"), "n": ("Dr", "Prof", "Doktor")}
GIVEN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Emily Emma Olivia Sophia Charlotte Amelia Alice Grace Hannah Rachel Rebecca Laura Julia Anna Maria Sophie Marie Claire Camille Chloe Isabelle Nathalie Lucia Carmen Isabel Sofia Elena Ana Pilar Ingrid Ursula Petra Sabine Katharina Monika Heike Priya Fatima Aisha Yuki Анна Мария Елена Ольга Наталья Татьяна Ирина Ελένη Μαρία Κατερίνα",
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kevin Brian George Edward Peter Henry Jack Oliver Hans Klaus Jürgen Wolfgang Stefan Matthias Andreas Pierre Jean Jacques Luc Antoine François Nicolas José Juan Carlos Luis Miguel Pedro Javier Diego Giovanni Marco Mohammed Ahmed Ali Raj Hiroshi Иван Дмитрий Сергей Алексей Николай Андрей Михаил Γιώργος Νίκος Δημήτρης",
}
PHRASES = ("my name is", "My name is", "Name:", "name:", "Signed,", "signed by", "Sincerely,", "Author:", "Contact:", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε")
PARTICLES = frozenset("von van de del della da di du la le der den ter bin al".split())
_GENDER = {name: g for g, names in GIVEN.items() for name in names.split()}
_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_BEGINS = frozenset(_GENDER) | frozenset(_TITLE)

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.-])(?:[2-6]\d{12,18}|[2-6]\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{4,5})(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1\D)\d{1,3}[ -]?(?:\(\d{1,4}\)|\d{1,4})(?:[ -]?\d{2,4}){2,3}(?!\.\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d )[2-9]\d{2} [2-9]\d{2} \d{4}(?! \d))(?![\w-])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)")
_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-ŽΆΈΉΊΌΎΏΑ-ΩЁА-Я]"
_NAME = rf"{_CAPITAL}[^\W\d_]*(?:['’-][^\W\d_]+)*"
#: Runs of capitalised words, with particles among them; a dot may follow a word.
_RUN = re.compile(rf"(?<!\w){_NAME}(?:\.?\x20+(?:(?:{'|'.join(sorted(PARTICLES))})\x20+)*{_NAME})*(?!\w)")
_PART = re.compile(rf"({_NAME})(\.?)|[^\W\d_]+")
_PHRASE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, PHRASES))})\s+(?={_CAPITAL})")
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for a valid number."""
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))


def issued(digits: str) -> bool:
    """Whether a card number of this beginning and length is issued."""
    n, two, three, four = len(digits), int(digits[:2]), int(digits[:3]), int(digits[:4])
    if digits[0] == "4":
        return n in (13, 16, 19)
    if two in (34, 37):
        return n == 15
    if two in (36, 38) or 300 <= three <= 305:
        return n == 14
    return n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or 3528 <= four <= 3589 or four == 6011 or 644 <= three <= 649 or two in (62, 65))


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ώ" or c in "άέήί" else "latin"


def _persons(text: str) -> list[tuple[int, int, str, str]]:
    """The names of persons, a span a word, in order; then their parts that stand alone."""
    announced = {m.end() for m in _PHRASE.finditer(text)} if any(p in text for p in PHRASES) else set()
    found: list[tuple[int, int, str, str]] = []
    spans = [m.span() for m in _RUN.finditer(text)]

    def words_of(a: int, b: int) -> list[tuple[int, str, bool]]:
        return [(p.start(1), p[1], bool(p[2])) for p in _PART.finditer(text, a, b) if p[1]]

    for a, b in spans:
        # a run of one word needs a phrase before it, a longer one a phrase, title or given name
        if a not in announced and not (" " in (run := text[a:b]) and any(w.rstrip(".") in _BEGINS for w in run.split(" "))):
            continue
        words = words_of(a, b)
        k = 0
        while k < len(words):
            at, word, dotted = words[k]
            title = _TITLE.get(word)
            first = k + 1 if title else k
            # a title, a phrase before, or a given name that another word follows
            if not (title or at in announced or word in _GENDER and not dotted) or first == len(words):
                k += 1
                continue
            last = first
            while last + 1 < len(words) and (not words[last][2] or len(words[last][1]) == 1):
                last += 1
            name = [w for w in words[first : last + 1] if len(w[1]) > 1]
            k = last + 1
            if not name or len(name) == 1 and not title and at not in announced:
                continue
            gender = next((_GENDER[w] for _, w, _ in name if w in _GENDER), title or "n")
            for i, (a, w, _) in enumerate(name):
                family = i == len(name) - 1 and (len(name) > 1 or title is not None)
                found.append((a, a + len(w), f"family:{script(w)}" if family else f"given:{gender}:{script(w)}", w.lower()))
    known = {value: kind for _, _, kind, value in reversed(found)}
    if known:
        seen = {a for a, _, _, _ in found}
        found += [(a, a + len(w), known[w.lower()], w.lower()) for span in spans for a, w, _ in words_of(*span) if a not in seen and w.lower() in known]
    return sorted(found)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities, in order and without overlaps; earlier kinds go first."""
    kinds: list[list[tuple[int, int, str, str]]] = []
    if "@" in text:
        kinds.append([(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)])
    if _DIGIT.search(text):
        kinds.append([(m.start(), m.end(), "iban", plain) for m in _IBAN.finditer(text) if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and _iban_rest(plain) == 1])
        kinds.append([(m.start(), m.end(), "card", plain) for m in _CARD.finditer(text) if luhn(plain := re.sub(r"\D", "", m[0])) % 10 == 0 and issued(plain)])
        phones = []
        for m in _PHONE.finditer(text):
            if 7 <= len(plain := re.sub(r"\D", "", m[0])) <= 15:
                country = re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d)", m[0])
                phones.append((m.start(), m.end(), f"phone{len(country[1] or country[2]) if country else 0}", plain))
        kinds.append(phones)
        kinds.append([(m.start(), m.end(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)])
        kinds.append([(m.start(), m.end(), "ipv4", m[0]) for m in _IP.finditer(text)])
    kinds.append(_persons(text))
    out: list[tuple[int, int, str, str]] = []
    for found in kinds:
        if found:
            out = sorted(out + [x for x, alone in zip(found, free([x[:2] for x in found], [x[:2] for x in out]), strict=True) if alone])
    return out


class _Draws:
    """Numbers that a key and a message give."""

    def __init__(self, key: str, *message: str) -> None:
        self.key, self.message, self.n, self.held = key.encode(), "\x1f".join(message).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.message + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % n

    def like(self, value: str) -> str:
        """Digits for digits, letters for letters; all else as it is."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if c.isascii() and c.isalpha() else c for c in value)


#: Syllables of made-up names, and their endings by gender.
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no pa pe ra re ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ла ле ло ма ме ми на не но па пе ра ре ро са се со та те то ва ве ви".split(),
    "greek": "βα βε βο δα δε δο γα γο κα κε λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
_ENDINGS = {
    "latin": {"f": ("lia", "na", "ra", "sia"), "m": ("n", "rd", "k", "rt"), "n": ("ris", "lin", "rin"), "family": ("ner", "son", "rell", "mont", "dal", "vic")},
    "cyrillic": {"f": ("на", "лия", "ра"), "m": ("н", "р", "слав"), "n": ("ша", "ня"), "family": ("ченко", "ко", "ман", "рих")},
    "greek": {"f": ("να", "ρα", "λία"), "m": ("ρος", "νος", "λης"), "n": ("νι", "ρι"), "family": ("ίδης", "άκης", "όπουλος")},
}


def surrogate(key: str, kind: str, value: str, draw: int) -> str:
    """The canonical surrogate of a canonical value, at its draw-th draw."""
    draws = _Draws(key, kind, value, str(draw))
    loose, more = draw >= LOOSE, max(0, (draw - LONGER) // 4 + 1)  # further digits
    if kind == "email":
        local, domain = value.split("@")
        labels = domain.split(".")
        # one surrogate for a domain, whoever's address it is
        return f"{draws.like(local)}@{'.'.join([*(_Draws(key, 'domain', label).like(label) for label in labels[:-1]), labels[-1]])}" if not loose else f"{draws.like(local + 'a' * ((draw - LOOSE) // 4 + 1))}@{'.'.join([*(draws.like(label) for label in labels[:-1]), labels[-1]])}"
    if kind.startswith("phone"):
        country = int(kind[5:])
        rest = [str(draws.below(10)) for _ in range(len(value) - country + more)]
        rest[0] = str(2 + draws.below(8))
        if value[country + 3 : country + 6] == "555" and not loose:
            rest[3:6] = "555"
        return value[:country] + "".join(rest)
    if kind == "card":
        issuer = value[:1] if value[0] == "4" else value[:4]
        body = issuer + "".join(str(draws.below(10)) for _ in range(len(value) - len(issuer) - 1 + more))
        return body + str(-luhn(body + "0") % 10)
    if kind == "iban":
        body = "".join(str(draws.below(10)) if c.isdigit() else chr(65 + draws.below(26)) for c in value[4:] + "0" * more)
        return f"{value[:2]}{98 - _iban_rest(f'{value[:2]}00{body}'):02d}{body}"
    if kind == "ssn":
        return f"{1 + draws.below(665):03d}{1 + draws.below(99):02d}{1 + draws.below(9999):04d}{draws.like('0' * more)}"
    if kind == "ipv4":
        return ".".join(str(1 + draws.below(999 if more else 254) if loose else {1: 1 + draws.below(9), 2: 10 + draws.below(90), 3: 100 + draws.below(155)}[len(octet)]) for octet in value.split("."))
    part, *of = kind.split(":")
    syllables, endings = _SYLLABLES[of[-1]], _ENDINGS[of[-1]]["family" if part == "family" else of[0]]
    return "".join(syllables[draws.below(len(syllables))] for _ in range(2 + draws.below(2) + draw // 4)) + endings[draws.below(len(endings))]


def render(kind: str, value: str, mention: str) -> str:
    """The canonical surrogate, written as the mention is: its separators and capitals."""
    if kind.startswith(("phone", "card", "ssn", "iban")):
        symbols = iter(value)
        return "".join([*(next(symbols, "") if c.isalnum() else c for c in mention), *symbols])
    if kind == "email":
        return "".join(c.upper() if i < len(mention) and mention[i].isupper() else c for i, c in enumerate(value)) if not mention.isupper() else value.upper()
    if kind == "ipv4":
        return value
    return value.upper() if mention.isupper() and len(mention) > 1 else value[0].upper() + value[1:] if mention[0].isupper() else value


def rewrite(text: str, key: str, later: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions; later: the draw of entities whose first one is taken."""
    out, at, found = [], 0, detect(text)
    for start, end, kind, value in found:
        out += [text[at:start], render(kind, surrogate(key, kind, value, later.get((kind, value), 0)), text[start:end])]
        at = end
    return "".join([*out, text[at:]]), len(found)


def mentions(df: DataFrame, row: str, text: str = "text") -> DataFrame:
    """(row, kind, value): the entities of each text, each once a batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(r, kind, value) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for _, _, kind, value in detect(t)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["row", "kind", "value"])

    return df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "row string, kind string, value string")


def _drawn(df: DataFrame, key: str) -> DataFrame:
    """df (kind, value, draw) with the surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, draws = (batch.column(k) for k in range(3))
            made = [surrogate(key, *x) for x in zip(kinds.to_pylist(), values.to_pylist(), draws.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([kinds, values, draws, pa.array(made, pa.string())], names=["kind", "value", "draw", "surrogate"])

    return df.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, surrogate string")


def distinct_surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, draw, surrogate) of each entity (kind, value): no two of a kind alike, and none a real value.

    Of those that draw one value in a round, the least gets it, unless it is real or was given away in an earlier round.
    """
    # kinds of one format share their values: all phones, all family names of a script
    family = F.regexp_replace("kind", r"^phone\d", "phone").alias("f")
    taken = cut(found.select(family, F.col("value").alias("surrogate")).distinct())
    drawn, out = cut(_drawn(found.select("kind", "value").distinct().withColumn("draw", F.lit(0)), key)), None
    while True:
        first = drawn.select(family, "surrogate", F.struct("value", "kind").alias("claim")).groupBy("f", "surrogate").agg(F.min("claim").alias("claim"))
        free_ = first.join(taken, ["f", "surrogate"], "left_anti").select("claim.kind", "claim.value")
        won = cut(drawn.join(free_, ["kind", "value"], "left_semi"))
        out = won if out is None else out.unionByName(won)
        lost = drawn.join(won.select("kind", "value"), ["kind", "value"], "left_anti")
        drawn = cut(_drawn(lost.withColumn("draw", F.col("draw") + 1), key))
        if drawn.isEmpty():
            return out
        taken = taken.union(won.select(family, "surrogate"))


def replace_entities(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """df with surrogates in its text column, and n_entities, the number of mentions."""
    row, draws_of = like("__row", df), like("__later", df)
    # equal texts have the same entities
    of_text = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))
    held = cut(mentions(df.withColumn(row, of_text), row, text).distinct())
    later = distinct_surrogates(held.select("kind", "value").distinct(), key).where("draw > 0")
    entity = F.concat_ws("\x1f", "kind", "value")
    again = salted(held.select("row", "kind", "value", entity.alias("entity")), later.select(entity.alias("entity"), "draw"), "entity", "row")
    by = cut(again.groupBy("row").agg(F.collect_list(F.struct("kind", "value", "draw")).alias("draws"))).select(F.col("row").alias(row), F.col("draws").alias(draws_of))
    few = by.agg(F.coalesce(F.sum(F.size(draws_of)), F.lit(0))).first()[0] <= SENT_MENTIONS
    joined = df.withColumn(row, of_text).join(F.broadcast(by) if few else by, row, "left").select(*[F.col(f"`{c}`") for c in df.columns], draws_of)
    schema, at = T.StructType([*df.schema, T.StructField(like("n_entities", df), T.LongType())]), df.columns.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = ({(x["kind"], x["value"]): x["draw"] for x in found or ()} for found in batch.column(len(schema) - 1).to_pylist())
                made = [(None, 0) if t is None else rewrite(t, key, k) for t, k in zip(batch.column(at).to_pylist(), known, strict=True)]
                columns = [pa.array([m for m, _ in made], pa.string()) if i == at else batch.column(i) for i in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in made], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir).select("doc_id", "text"))

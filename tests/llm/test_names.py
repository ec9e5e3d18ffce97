"""Names of persons, full formats, and texts with many entities."""

import random
import time

import pytest

from sparkloom.llm import surrogates


@pytest.mark.parametrize(
    ("text", "names", "stay"),
    [
        ("Anna Smith called. Smith was late, and Anna left.", ["Anna", "Smith"], ["called", "late"]),
        ("Maria Garcia Lopez; Priya Patel.", ["Maria", "Garcia", "Lopez", "Priya", "Patel"], []),
        ("Emily Johnson called 917 555 7713 today.", ["Emily", "Johnson", "917 555 7713"], ["called", "today"]),
        ("Then Dr Anna Maria von Schmidt and Mr. J. K. Miller met Herr Klaus Meyer. MILLER left.", ["Anna", "Maria", "Schmidt", "Miller", "MILLER", "Klaus", "Meyer"], ["Then Dr", "von", "Mr. J. K.", "Herr"]),
        ("my name is Zofia Nowak and Nowak is short", ["Zofia", "Nowak"], ["my name is", "short"]),
        ("Г-н Иванов и Мария Петрова; Иванов ушёл. Ich heiße Uwe.", ["Иванов", "Мария", "Петрова", "Uwe"], ["ушёл", "Ich heiße"]),
        ("The White House and New York. Of Mice And Men. Grace is a virtue. Mark. My Own", [], ["The White House and New York. Of Mice And Men. Grace is a virtue. Mark. My Own"]),
    ],
)
def test_names(text, names, stay):
    made, _ = surrogates.rewrite(text, "key", {})
    assert not [n for n in names if n in made] and not [x for x in stay if x not in made]


def test_a_name_has_one_surrogate_in_a_text():
    made, n = surrogates.rewrite("Mrs. Smith met Anna Smith. SMITH said so, then Smith", "key", {})
    words = made.replace(".", "").replace(",", "").split()
    assert n == 5 and words[1] == words[4] == words[5].capitalize() == words[9]


def test_full_formats(spark):
    """All 676 addresses of one-letter parts, and all numbers of four free digits: longer surrogates, no error."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = [("email", f"{a}@{b}.com") for a in letters for b in letters] + [("ssn", f"{a:03d}{b:02d}0001") for a in range(1, 30) for b in range(1, 20)]
    out = surrogates.distinct_surrogates(spark.createDataFrame(found, "kind string, value string")).collect()
    made = [(r["kind"], r["surrogate"]) for r in out]
    assert len(made) == len(set(made)) == len(found) and not set(made) & set(found)


def test_longer_values_of_every_kind():
    for kind, value in [("email", "a@b.com"), ("phone1", "12125550123"), ("card", "4845168114407329"), ("iban", "DE89370400440532013000"), ("ssn", "123456789"), ("ipv4", "10.0.0.1"), ("family:latin", "smith")]:
        made = [surrogates.surrogate("key", kind, value, draw) for draw in (0, surrogates.LOOSE, surrogates.LONGER, 40)]
        assert len(set(made)) == 4 and (kind == "ipv4" or len(made[-1]) > len(value) or kind.startswith("family"))
        assert all(surrogates.render(kind, m, value) for m in made)
    card = surrogates.surrogate("key", "card", "4845168114407329", 40)
    assert surrogates.luhn(card) % 10 == 0 and surrogates.render("card", card, "4845 1681 1440 7329").replace(" ", "") == card


def test_detection_by_comparing_all():
    """Kinds in order, each span only where no earlier one stands."""
    rnd = random.Random(8)
    parts = ["a.b@mail.example.com", "4845168114407329", "10.1.2.3", "+1 (212) 555-0123", "123-45-6789", "DE89 3704 0044 0532 0130 00", "Anna Smith", "Smith", "Mr. Jones", " ", " ", ", ", "x"]
    for _ in range(200):
        found = surrogates.detect("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_many_entities_take_linear_time():
    def took(n):
        text = " ".join(f"10.{i % 250}.{i // 250 % 250}.{i % 7} Mr Smith" for i in range(n))
        began = time.perf_counter()
        assert len(surrogates.detect(text)) == 2 * n
        return time.perf_counter() - began

    took(500)
    assert took(40_000) < 25 * took(4_000)


def test_clean_prose_stays(spark, sf_dir):
    """No name is found in the tables' prose, which holds none."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    assert not [k for r in rows if r["text"] for _, _, k, _ in surrogates.detect(r["text"]) if k.startswith(("given", "family"))]

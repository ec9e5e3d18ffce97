"""The results that the docstrings state for nulls, empty and blank texts, ties and repeated rows."""

import hashlib

import pytest
from conftest_llm import PROSE

from sparkloom.llm.queries import QUERIES

ROWS = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t ", "en", "s"), (4, PROSE, "en", "s"), (5, PROSE, "en", "t"), (6, "1234 !!", "en", "t"), (7, "x\n\nz\nx\n\nz", "en", "t"),
    (8, "one\ntwo\nthree\nfour", "en", "s"), (9, "zero\none\ntwo\nthree\nfour\nfive", "en", "s"), (10, "Word " * 9, "en", "s"),
]


@pytest.fixture(scope="module")
def result(spark, make, tmp_path_factory):
    path = make(tmp_path_factory.mktemp("defined"), ROWS, [(1, PROSE)])
    held = {}

    def of(name):
        if name not in held:
            held[name] = {r["doc_id"]: r for r in QUERIES[next(q for q in QUERIES if q.startswith(f"{name}_"))](spark, path).collect()}
        return held[name]

    return of


def test_op1(result):
    r = result("op1")
    for i in (1, 2, 3):
        assert (r[i]["n_words"], r[i]["word_chars"], r[i]["base_failed"], r[i]["kept"]) == (0, 0, True, False)
    assert r[4]["kept"] and r[4][1:] == r[5][1:]
    assert (r[7]["n_dup_lines"], r[10]["n_repeat_words"], r[10]["kept"]) == (2, 9, False)


def test_op2(result):
    r = result("op2")
    assert {r[i]["base_sha256"] for i in range(1, 11)} == {hashlib.sha256(b"").hexdigest()}
    assert {r[i]["spans"] for i in range(1, 11)} == {""}


def test_op3(result):
    r = result("op3")
    for i in (1, 2, 3, 6):
        assert (r[i]["lang_pred"], r[i]["score"]) == ("und", 0.0)
    assert r[4]["lang_pred"] == "en" and r[4]["score"] == r[5]["score"]


def test_op4(result):
    r = result("op4")
    assert (r[1]["text"], r[1]["n_lines"], r[2]["text"], r[2]["n_lines"]) == (None, 0, "", 1)
    assert r[7]["text"] == "x\n\nz" and r[7]["n_removed"] == 3  # the second half repeats the first
    assert r[8]["text"] == ROWS[7][1]  # the first occurrence stays
    assert r[9]["text"] == "zero\nfive" and r[9]["n_removed"] == 4  # two windows that overlap


def test_op5(result):
    r = result("op5")
    assert (r[1]["size"], r[1]["text_crc32"], r[2]["size"], r[2]["text_crc32"]) == (8, 0, 8, 0)
    assert r[4]["shard"] == r[5]["shard"] and {x["law"] for x in r.values()} == {"bytes"} and {x["grown_shard"] for x in r.values()} == {None}


def test_op6(result):
    r = result("op6")
    for i in (1, 2, 3):
        assert (r[i]["n_words"], r[i]["n_tokens"], r[i]["n_unknown"]) == (0, 0, 0)
    assert r[4][1:] == r[5][1:]


def test_op7(result):
    assert 1 not in result("op7")  # the null source has no bytes, so its rate is 0


def test_op8(result):
    r = result("op8")
    assert (r[1]["text"], r[1]["n_entities"], r[2]["text"], r[4]["text"]) == (None, 0, "", PROSE)


def test_op9(result):
    r = result("op9")
    assert {i for i in r if r[i]["contaminated"]} == {4, 5} and r[4]["item_ids"] == [1] and r[1]["item_ids"] == []


def test_op10(result):
    r = result("op10")
    for i in (1, 2, 3):
        assert (r[i]["fingerprint"], r[i]["component_id"]) == ("0" * 16, 1)
    assert r[5]["component_id"] == 4 and r[4]["fingerprint"] == r[5]["fingerprint"]


def test_op8_changes_nothing_but_entities(spark, make, tmp_path):
    from sparkloom.llm import surrogates

    rows = [(i, f"word{i} at user{i % 7}@mail.example.com, +1 (212) 555-01{i % 9}0 and 10.{i % 5}.0.1 end", "en", "s") for i in range(60)]
    found = {r["doc_id"]: r for r in QUERIES["op8_surrogates"](spark, make(tmp_path, rows)).collect()}
    pairs = {}
    for i, text, _, _ in rows:
        made, a, b = found[i]["text"], 0, 0
        old, new = surrogates.detect(text), surrogates.detect(made)
        assert [x[2] for x in old] == [x[2] for x in new] and found[i]["n_entities"] == len(old) == 3
        for x, y in zip(old, new, strict=True):
            assert text[a : x[0]] == made[b : y[0]]
            a, b = x[1], y[1]
            assert pairs.setdefault(x[2:], y[3]) == y[3]
        assert text[a:] == made[b:]
    assert len(set(pairs.values())) == len(pairs) and not set(pairs.values()) & {v for _, v in pairs}

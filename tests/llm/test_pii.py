"""Surrogates: every kind of entity goes, keeps its format and stays one and the same; held against a slow reading of the texts."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from platewise.llm import pii

ROWS = [
    (1, "Mr. John Smith met Mrs Jane Smith. John Smith's dog; Dr. SMITH"),
    (2, "Mr. McDonald, Mr. O'Brien and Ms. Jean-Marie Dupont; Mr. Juan Carlos Perez Garcia. Dupont said Brienne"),
    (3, "+49 30 12345678; +14155550123; +33 1 42 68 53 00; 030 1234567; 555-0134; +1 (017) 555-7713; 3782 822463 10005; 4111 1111 1111 1111"),
    (4, "Mrs Ελένη Παππά and Г-н Иван Петров, Анна Петрова; 2001:db8::ff00:42:8329 FE80:0:0:0:0:0:0:1 at 12:30:45 std::vector"),
    (5, "DE89 3704 0044 0532 0130 00 A@B.com a@b.COM 10.1.2.3 date 2024-01-15 n 12345678"),
    (6, None), (7, ""), (8, "nothing here"), (8, "nothing here"), (None, "call 555-0134"), (9, "x " * 150_000 + "Mr. Adam Last"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "doc_id long, text string, pattern string, found int")
    found = collections.defaultdict(list)
    for r in pii.replace_entities(docs).collect():
        found[r.doc_id].append(r.text)
    return found


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_nothing_stays_in_clear(replaced):
    lost = ["John", "Smith", "SMITH", "Jane", "Donald", "Brien ", "Jean", "Marie", "Dupont", "Juan", "Carlos", "Perez", "Garcia", "12345678;", "4155550123", "42 68", "1234567;", "0134", "7713", "822463"]
    lost += ["1111", "Ελένη", "Παππά", "Иван", "Петров", "Анна", "db8", "ff00", "FE80", "3704", "A@B", "a@b", "10.1.2.3", "Adam", "Last"]
    for texts in replaced.values():
        for word in lost:
            assert not any(word in (t or "") for t in texts), word
    assert replaced[6] == [None] and replaced[7] == [""] and replaced[8] == ["nothing here"] * 2
    assert "12:30:45 std::vector" in replaced[4][0] and "2024-01-15 n 12345678" in replaced[5][0] and "Brienne" in replaced[2][0]
    assert replaced[9][0].startswith("x x x")


def test_coreference_script_case_and_gender(replaced):
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. (\w+) (\w+)'s dog; Dr\. (\w+)", replaced[1][0])
    first, last, other, *rest = m.groups()
    assert rest == [last, first, last, last.upper()] and first != other
    assert any(first.endswith(e) for e in pii.ENDINGS["latin"]["m"]) and any(other.endswith(e) for e in pii.ENDINGS["latin"]["f"])
    m = re.fullmatch(r"Mr\. Mc([A-Z]\w+), Mr\. O'([A-Z]\w+) and Ms\. (\w+)-(\w+) (\w+); Mr\. (\w+) (\w+) (\w+) (\w+)\. (\w+) said Brienne", replaced[2][0])
    assert m[5] == m[10]
    m = re.fullmatch(r"Mrs ([Α-Ωα-ω]+) ([Α-Ωα-ω]+) and Г-н ([А-Яа-я]+) ([А-Яа-я]+), ([А-Яа-я]+) ([А-Яа-я]+); (\S+) (\S+) at .*", replaced[4][0])
    assert re.search("(ов|ин)$", m[4]) and re.search("(ова|ина)$", m[6])
    assert re.fullmatch("[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}", m[7]) and re.fullmatch("[0-9A-F]{4}(:[0-9A-F]){7}", m[8])


def test_formats_and_check_digits(replaced):
    parts = replaced[3][0].split("; ")
    assert [re.sub(r"\d", "9", p) for p in parts] == [re.sub(r"\d", "9", p) for p in ROWS[2][1].split("; ")]
    assert luhn(parts[6]) and luhn(parts[7])
    iban = replaced[5][0][:27].replace(" ", "")
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    upper, lower = re.findall(r"(\S)@(\S)\.(?:com|COM)", replaced[5][0])
    assert [x.lower() for x in upper] == list(lower) and upper[0].isupper() and lower[0].islower()
    assert re.sub(r"\d", "9", replaced[None][0]) == "call 999-9999" and replaced[None][0][5:] == parts[4]


def test_a_full_format_is_masked_and_stays_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 3)

    def few(e, kind, attempt, key):
        if isinstance(kind, str):
            return e
        return F.when(attempt == pii.MASKED, F.concat(F.lit("[masked-"), F.md5(e), F.lit("]"))).otherwise(F.concat(F.pmod(F.xxhash64(e, attempt), F.lit(2)).cast("string"), F.lit("@x.yz")))

    docs = spark.createDataFrame([(i, f"w{i}@m.com") for i in range(9)], "doc_id long, text string")
    got = [r.text for r in pii.replace_entities(docs, draw=few).collect()]
    assert len(set(got)) == 9 and sum("masked" in t for t in got) >= 7


def test_no_documents(spark):
    assert pii.replace_entities(spark.createDataFrame([], "doc_id long, text string")).count() == 0

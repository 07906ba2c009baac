"""Surrogates of very long texts, phone forms, names under several titles, many names, and clashing columns."""

import re

import pytest

from lumenark.llm import surrogates

LONG = {
    "email labels": "mail a@b" + ".b" * 50_000 + ".com end",
    "email user": "x." * 50_000 + "y@site.org",
    "email host": "a@" + "b" * 100_000 + ".com",
    "ip": "1.1.1.1." * 12_000,
    "iban": "AB12 1234 " * 10_000,
    "ssn": "123-45-6789-" * 9_000,
    "phone": "+1 234 567 8901 " * 6_000,
    "digits": "1 " * 50_000 + "2" * 50_000,
    "titles": "Dr " * 33_000 + "Klein",
    "initials": "Mr " + "A. " * 3_000 + "Klein",
    "hyphens": "Mr O" + "'Neil" * 20_000,
    "particles": "Mr " + "van " * 25_000 + "Dyck",
    "blanks": "Mr" + " " * 100_000 + "Klein",
    "letters": "é" * 100_000 + " Mr " + "A" + "b" * 100_000,
}


def replaced(spark, *texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in sorted(surrogates.pseudonymise(docs, key).collect(), key=lambda r: r["doc_id"])]


def test_long_texts_of_one_repeating_part(spark):
    out = dict(zip(LONG, replaced(spark, *LONG.values())))
    assert all(isinstance(x, str) for x in out.values())
    assert out["email labels"] == LONG["email labels"]  # no host has so many labels
    assert "site.org" not in out["email user"] and "Klein" not in out["titles"] + out["initials"] + out["blanks"] and "Dyck" not in out["particles"] and "Neil" not in out["hyphens"]
    assert "234 567 8901" not in out["phone"] and "b" * 100 not in out["letters"]


def test_phone_forms_of_one_number(spark):
    a, b, c, d, e = replaced(spark, "+49 30 123 4567 and 030 123 4567", "(555) 123-4567, 5551234567, +1 555-123-4567", "call 5551234567", "order 8765432109", "from +44 20 7946 0958")
    x, y = re.fullmatch(r"\+49 (\d\d \d{3} \d{4}) and 0(\d\d \d{3} \d{4})", a).groups()
    assert x == y != "30 123 4567"
    forms = [re.sub(r"\D", "", f)[-10:] for f in b.split(", ")]
    assert len(set(forms)) == 1 and forms[0] != "5551234567" and b.startswith("(") and ", +1 " in b
    assert c == f"call {forms[0]}" and d == "order 8765432109"
    assert e.startswith("from +44 ") and "7946" not in e


def test_one_surrogate_whatever_the_title(spark):
    a, b, c, d = replaced(spark, "Mr Smith", "Dr Smith", "Mrs Anna Smith", "Prof Anna Smith")
    assert len({t.split()[-1] for t in (a, b, c, d)}) == 1 and a != "Mr Smith" and c.split()[1] == d.split()[1] != "Anna"


@pytest.mark.parametrize("title, alphabet", [("Herr", "a-z"), ("Госпожа", "а-яё"), ("κύριος", "α-ωά-ώ")])
def test_many_names_are_names_of_the_script(spark, title, alphabet):
    first, rest = (chr(ord(alphabet[0]) + i) for i in range(2)), alphabet[0]
    letters = [chr(ord(rest) + i) for i in range(12)]
    names = sorted({(a + b + c).capitalize() for a in letters[:6] for b in letters[3:9] for c in letters[:5]})
    out = [t.split()[1] for t in replaced(spark, *[f"{title} {n}" for n in names])]
    assert len({n.lower() for n in out}) == len(names) and not {n.lower() for n in out} & {n.lower() for n in names}
    vowels = "aeiouyаеиоуёыэюяαεηιουωάέήίόύώ"
    assert all(re.fullmatch(f"[{alphabet.upper()}ΆΈΉΊΌΎΏ][{alphabet}ς]+", n) and any(v in vowels for v in n.lower()) and not re.search(f"[^{vowels}]{{5}}", n.lower()) for n in out)


def test_clashing_names_pass_through(spark):
    schema = "doc_id bigint, text string, __map string, __names string, __pattern string, __t1 int, mention string, t1 int, __map1 int"
    rows = [(1, "Mr Smith met Mr Jones. Smith left.", "a", "b", "c", 1, "d", 2, 3), (2, None, "e", "f", "g", 4, "h", 5, 6)]
    got = sorted(map(tuple, surrogates.pseudonymise(spark.createDataFrame(rows, schema), "k").collect()))
    assert [r[2:] for r in got] == [r[2:] for r in rows] and got[1][1] is None and "Smith" not in got[0][1]


def test_stages_let_clashing_names_pass(spark):
    from lumenark.llm import chosenpath, decontam

    schema = "doc_id bigint, text string, __bad1 bigint, __keep_id bigint, __text_th bigint, __keep_th string"
    rows = [(1, "one two three four five six seven", 1, 2, 3, "x"), (2, "one two three four five six seven", 4, 5, 6, "y"), (3, None, 7, 8, 9, "z")]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([("i", "something else entirely")], "item_id string, text string")
    assert sorted(map(tuple, decontam.decontaminate(docs, items).collect())) == rows
    assert sorted(map(tuple, chosenpath.first_of_class(docs).collect())) == [rows[0], rows[2]]

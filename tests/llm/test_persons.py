"""Persons with initials, particles, titles without gender and untitled later mentions."""

import re

from lumenark.llm import surrogates


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [(r["text"], r["n"]) for r in sorted(surrogates.pseudonymise(docs, "k", count_col="n").collect(), key=lambda r: r["doc_id"])]


def test_persons(spark):
    out = replaced(spark, "Mr John Smith came. John Smith left. Smith paid. SMITH's bill, Smithson's not.", "Mr. J. Smith and Mr J.R.R. Smith", "Frau von Stein, Frau Anna von Stein; Stein.",
                   "Mrs Jane Q. Doe, then Jane Doe and Jane Q. Doe", "Herr Anna  Mueller und Frau\nAnna\nMueller", "Dr. Klein, Herr Prof. Dr. Klein, Klein", "Prof Ada Lovelace wrote; Lovelace wrote.",
                   "Mr Smith\n\nMonday and Mr Smith's dog; mail Ann Smith@x.org or Smith@x.org", "Smith was named without a title", "Mr " + "Long Name " * 300, "Mrs Mary Ann O'Neil Mr Bo Ek")
    text = [t for t, _ in out]
    given, family, g2, f2, f3, f4 = re.fullmatch(r"Mr (\S+) (\S+) came\. (\S+) (\S+) left\. (\S+) paid\. (\S+)'s bill, Smithson's not\.", text[0]).groups()
    assert (given, family) == (g2, f2) and family == f3 and f4 == family.upper() and given != "John" and family != "Smith"
    assert out[0][1] == 4
    assert re.fullmatch(rf"Mr\. [A-Z]\. {family} and Mr [A-Z]\.[A-Z]\.[A-Z]\. {family}", text[1])
    a, b, c, d = re.fullmatch(r"Frau von (\S+), Frau (\S+) von (\S+); (\S+)\.", text[2]).groups()
    assert a == c == d != "Stein" and b != "Anna"
    j, i, d1, j2, d2, j3, i3, d3 = re.fullmatch(r"Mrs (\S+) ([A-Z])\. (\S+), then (\S+) (\S+) and (\S+) ([A-Z])\. (\S+)", text[3]).groups()
    assert j == j2 == j3 != "Jane" and d1 == d2 == d3 != "Doe" and i == i3
    assert re.fullmatch(r"Herr (\S+)  (\S+) und Frau\n(\S+)\n(\S+)", text[4]) and "Mueller" not in text[4] and "Anna" not in text[4]
    k1, k2, k3 = re.fullmatch(r"Dr\. (\S+), Herr Prof\. Dr\. (\S+), (\S+)", text[5]).groups()
    assert k1 == k2 == k3 != "Klein"
    assert re.fullmatch(r"Prof \S+ (\S+) wrote; \1 wrote\.", text[6]) and "Lovelace" not in text[6]
    assert text[7].startswith(f"Mr {family}\n\nMonday and Mr {family}'s dog") and "Smith" not in text[7] and "@x.org" not in text[7]
    assert out[8] == ("Smith was named without a title", 0)
    assert "Long" not in text[9] and "Name" not in text[9]
    assert not re.search("Mary|Ann|Neil|Bo|Ek", text[10]) and re.fullmatch(r"Mrs \S+ \S+ \S+ Mr \S+ \S+", text[10]) and out[10][1] == 2

"""Text columns: hygiene, tokens, n-grams, predicates.  All JVM-side expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without retrieval signal, used only to relax a query.
STOPWORDS = tuple("""
a an the is are was were be been being of in on at to for with by from as and or but if
then than that this these those it its he she they them his her their i me my we us our
you your show find get search video videos clip clips moment moments where when what who
which someone something anyone anything some any all one ones
""".split())

# Passage limits.
MAX_CHARS = 900

# Fixed pattern: 24+ base64url characters carrying a digit and a capital.
OPAQUE = (r"(?<![A-Za-z0-9])(?=[A-Za-z0-9_-]{24,})(?=[A-Za-z0-9_-]*[0-9])"
          r"(?=[A-Za-z0-9_-]*[A-Z])[A-Za-z0-9_-]{24,}")

# Fixed pattern: a cell that only reports that nothing was found.
ABSENCE = (r"(?is)^\W*(?:(?:no|none|nothing|not|zero)\b[\w\s,'-]{0,60}?"
           r"\b(?:detect|found|present|visible|identif|salient|available|recognis|recogniz|applicable)\w*"
           r"|(?:none|n/?a|null|nil|unknown|undefined|empty|unavailable))\s*[.!]?\s*$")

# Fixed patterns: query tokens, words with combining marks, hashtags and mentions.
QUERY_TOKEN = r"[A-Za-z0-9_']+"
WORD = r"\p{L}[\p{L}\p{M}]*"
HASHTAG_GRAPH = r"#([A-Za-z0-9_À-ɏ]{2,40})"
HASHTAG_CAPTION = r"(?<!\w)#([^\s#@.,!?;:()\[\]{}'\"]+)"
MENTION_CAPTION = r"(?<!\w)@([A-Za-z0-9._]{2,30})"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_opaque(c: Column) -> Column:
    """Machine handles become a space; the commas they leave behind are folded."""
    gone = F.regexp_replace(c, OPAQUE, " ")
    folded = F.regexp_replace(F.regexp_replace(gone, r"\s*,\s*,+", ", "), r"^[ ,]+|[ ,]+$", "")
    return F.when(c.rlike(OPAQUE), folded).otherwise(c)


def clean_text(c: Column) -> Column:
    """One cell normalised for indexing, at its whole length; NULL when nothing worth indexing remains."""
    s = squeeze(strip_opaque(F.trim(c)))
    return F.when((F.length(s) >= 2) & ~s.rlike(r"^\d+$"), s)


def passages_of(c: Column, limit: int = MAX_CHARS) -> Column:
    """A squeezed text as successive passages of at most ``limit`` characters, cut between words.

    A word longer than a passage is cut where the passage ends. Nothing is left out but the
    blanks at the cuts.
    """
    pattern = rf"\S(?:.{{0,{limit - 2}}}\S)?(?:\s|$)|\S{{{limit}}}"
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda p: F.trim(p))


def is_absence(c: Column) -> Column:
    s = F.trim(c)
    return F.coalesce((F.length(s) > 0) & (F.length(s) <= 120) & s.rlike(ABSENCE), F.lit(False))


def text_hash(c: Column) -> Column:
    return F.substring(F.sha1(F.lower(c).cast("binary")), 1, 16)


def search_tokens(c: Column) -> Column:
    """Lower-cased word tokens of a passage: runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


#: Latin letters with marks and the letters without them, from the character database.
_MARKED = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1]


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def words(c: Column) -> Column:
    """Lower-cased words; combining marks stay with their letter, digits are no words."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def query_tokens(query: str) -> list[str]:
    """Query text to tokens: single characters count only when they are digits."""
    return [t for t in re.findall(QUERY_TOKEN, query or "") if len(t) > 1 or t.isdigit()]


def query_terms(query: str, mode: str = "and") -> tuple[list[str], str | None]:
    """``(exact terms, prefix)`` for one of the query shapes and / or / prefix."""
    toks = [t.lower() for t in query_tokens(query)]
    if not toks:
        return [], None
    if mode == "prefix":
        return list(dict.fromkeys(toks[:-1])), toks[-1]
    if mode == "or":
        toks = [t for t in toks if t not in STOPWORDS] or toks
    return list(dict.fromkeys(toks)), None


def phrase_bonus(text: Column, query: str) -> Column:
    """+.30 for the whole query verbatim, else .07 per adjacent pair up to .20."""
    q = (query or "").strip().lower()
    if len(q) < 4:
        return F.lit(0.0)
    t = F.lower(text)
    toks = [w for w in re.findall(QUERY_TOKEN, q) if w not in STOPWORDS]
    pairs = [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    near = F.lit(0.0)
    for p in pairs:
        near = near + F.when(t.contains(p), F.lit(0.07)).otherwise(F.lit(0.0))
    return F.when(t.contains(q), F.lit(0.30)).otherwise(F.least(F.lit(0.20), near))


def hashtags(c: Column) -> Column:
    """Distinct hashtags in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(HASHTAG_CAPTION), F.lit(1)))


def mentions(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(MENTION_CAPTION), F.lit(1)))


def fix_mojibake(c: Column) -> Column:
    """UTF-8 bytes that were read as Latin-1, turned back; other text is left alone."""
    suspicious = c.rlike("[Â-ô][\u0080-¿]") & ~c.rlike("[^\u0000-ÿ]")
    redone = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(suspicious & ~redone.contains("�"), redone).otherwise(c)


def redact(c: Column, secrets: dict[str, str] | None = None, patterns: dict[str, str] | None = None) -> Column:
    """Known secret values become their names (longest first), then token shapes go."""
    for value, name in sorted((secrets or {}).items(), key=lambda kv: (-len(kv[0]), kv[0])):
        if value:
            c = F.replace(c, F.lit(value), F.lit(f"<{name}>"))
    for pattern, name in (patterns or {}).items():
        c = F.regexp_replace(c, pattern, f"<{name}>")
    return c

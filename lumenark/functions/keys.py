"""Entity keys: permalinks, canonical shapes, spelling rules.  All column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: permalinks and key shapes.
PERMALINK = (r"(?i)(?:https?://)?(?:www\.)?instagram\.com/(?:[A-Za-z0-9_.]+/)?"
             r"(reel|reels|p|tv)/([A-Za-z0-9_-]{5,})")
UPLOAD_KEY = r"^up_(\d+)$"
LOCAL_KEY = r"^file_[0-9a-f]{16}$"
SHORTCODE = r"^[A-Za-z0-9_-]{5,32}$"
PREFIXED_NUMBER = r"(?i)^(?:tg|msg|id|up|video|frames)[_:-]?(\d+)$"
MESSAGE_SPELLING = r"(?i)^(?:tg|msg|id|up|video|vid|frames|reel)?[_:\-]?(\d{1,12})$"

# The spellings one message id is known by.
SPELLINGS = ("{n}", "tg{n}", "msg{n}", "msg_{n}", "tg_{n}", "id{n}", "up_{n}", "video_{n}", "frames_{n}")


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def key_from_url(url: Column, pattern: str = PERMALINK, group: int = 2) -> Column:
    return _some(F.regexp_extract(url, pattern, group))


def canonical(url: Column, pattern: str = PERMALINK, base: str = "https://www.instagram.com") -> Column:
    """struct(key, url, kind) of a permalink, or NULL: every spelling of a post collides on one key.

    The text is searched once; the parts are read from what was found, so ``pattern`` must not look around itself.
    """
    def parts(link: Column) -> Column:
        kind, key = F.lower(F.regexp_extract(link, pattern, 1)), F.regexp_extract(link, pattern, 2)
        kind = F.when(kind == "reels", "reel").otherwise(kind)
        return F.when(key != "", F.struct(key.alias("key"), F.concat(F.lit(f"{base}/"), kind, F.lit("/"), key, F.lit("/")).alias("url"),
                                          kind.alias("kind")))
    return F.get(F.transform(F.array(F.regexp_extract(url, pattern, 0)), parts), F.lit(0))


def is_upload(key: Column) -> Column:
    return F.coalesce(key.rlike(UPLOAD_KEY), F.lit(False))


def is_local(key: Column) -> Column:
    return F.coalesce(key.rlike(LOCAL_KEY), F.lit(False))


def canonical_url(key: Column, base: str = "https://www.instagram.com") -> Column:
    """The permalink of a shortcode; empty for uploads, loose files and bare numbers."""
    return F.when(is_upload(key) | is_local(key) | key.rlike(r"^\d+$") | (F.coalesce(key, F.lit("")) == ""), F.lit("")) \
        .otherwise(F.concat(F.lit(f"{base}/reel/"), key, F.lit("/")))


def looks_canonical(key: Column) -> Column:
    """Shaped like a key: a shortcode, an upload or a loose file; never a bare or prefixed number."""
    s = F.trim(F.coalesce(key.cast("string"), F.lit("")))
    return is_upload(s) | is_local(s) | (~s.rlike(r"^\d+$") & ~s.rlike(PREFIXED_NUMBER) & s.rlike(SHORTCODE))


def message_id_in(value: Column) -> Column:
    """Message id a spelling names, or 0."""
    got = F.regexp_extract(F.trim(value.cast("string")), MESSAGE_SPELLING, 1)
    return F.coalesce(F.try_to_number(_some(got), F.lit("999999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def string_rules(value: Column, namespaces: Sequence[str] = ()) -> Column:
    """Fallback reading of an unknown spelling: strip a namespace, unwrap a prefixed number."""
    s = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    if namespaces:
        s = F.trim(F.regexp_replace(s, "(?i)^(?:" + "|".join(re.escape(n) for n in namespaces) + ")[:=]", ""))
    num = F.regexp_extract(s, PREFIXED_NUMBER, 1)
    return F.when(s.rlike(r"^\d+$") | is_upload(s) | (num == ""), s).otherwise(num)


def spellings(message: Column) -> Column:
    """Array of every spelling of a positive message id."""
    n = message.cast("bigint").cast("string")
    forms = [F.concat(F.lit(f.split("{n}")[0]), n, F.lit(f.split("{n}")[1])) for f in SPELLINGS]
    return F.when(message.cast("bigint") > 0, F.array(*forms)).otherwise(F.array().cast("array<string>"))


def local_key(digest: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.lower(digest), 1, 16))


def content_digest(size: Column, head: Column, tail: Column) -> Column:
    """Content hash from a file's size, first and last bytes."""
    return F.sha2(F.concat(size.cast("string").cast("binary"), head, tail), 256)

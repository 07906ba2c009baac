"""Text sources: link lists, HTML pages, export trees, captions and tool logs."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T

# Fixed patterns: which export members matter, which only look as if, and container names.
INTERESTING = r"(?i)(saved|collection|bookmark|liked)"
BORING = r"(?i)(comment|music|audio|hashtag)"
GENERIC = r"(?i)^(saved_?posts?|saved_?saved_?media|saved|bookmarks?|your_?saved|posts?)$"
HEADER = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"

# Record groups that describe entities, and fields that name a collection.
ENTITY_GROUPS = ("owner", "brand partner", "brand partners", "hashtags", "co-author", "co-authors", "coauthor", "tagged",
                 "collaborators", "participants", "sharer")
COLLECTION_FIELDS = ("name", "collection", "collection name", "collection_name", "saved collection", "folder")
NAME_FIELDS = ("title", "name", "collection_name", "saved_collection_name", "string_map_data", "media_owner", "value")
LINK_FIELDS = ("url", "link", "permalink", "media url")


def clean_label(c: Column, limit: int = 120) -> Column:
    s = F.regexp_replace(T.squeeze(c), r"^[#*_\-–—:· ]+|[#*_\-–—:· ]+$", "")
    return F.substring(T.fix_mojibake(s), 1, limit)


def markdown_links(docs: DataFrame, doc: str = "doc", text: str = "text", default: str = "uncategorised",
                   link: str = K.PERMALINK) -> DataFrame:
    """(doc, pos, url, label): links with the nearest header above them.

    Lines stay an array inside their document; headers and links are found per line and the
    running header is the last one at or before the line.
    """
    lines = docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line"))
    head = F.nullif(clean_label(F.regexp_extract("line", HEADER, 1)), F.lit(""))
    rows = lines.filter(F.col("line").rlike(HEADER) | F.col("line").rlike(link)).withColumn("head", head)
    from ..operators.sequences import Carry, with_carry
    running = with_carry(rows.withColumn("line_no", F.col("line_no").cast("bigint")), [doc], ["line_no"],
                         [Carry("label", "last", F.col("head"))], F.floor(F.col("line_no") / 10_000).cast("bigint"))
    found = running.filter(~F.col("line").rlike(HEADER)).select(
        doc, "line_no", F.coalesce("label", F.lit(default)).alias("label"), F.posexplode(F.regexp_extract_all("line", F.lit(link), F.lit(0))).alias("i", "url"))
    return found.select(doc, (F.col("line_no") * (1 << 31) + F.col("i")).alias("pos"), "url", "label")


def html_to_markdown(html: Column) -> Column:
    """Anchors become their targets, headings become headers, other tags go."""
    s = F.regexp_replace(html, r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>", " $1 ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<h[1-6][^>]*>", "\n## "), r"(?i)</h[1-6]>", "\n")
    return F.regexp_replace(s, r"<[^>]+>", " ")


def html_links(pages: DataFrame, doc: str, html: str, default: str = "uncategorised", link: str = K.PERMALINK) -> DataFrame:
    return markdown_links(pages.select(doc, html_to_markdown(F.col(html)).alias("text")), doc, "text", default, link)


def page_anchors(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """(doc, href) of every anchor of a page."""
    return pages.select(doc, F.explode(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("href"))


def export_members(files: DataFrame, path: str = "path") -> DataFrame:
    """Export files worth reading; all of them when no name looks interesting."""
    name = F.element_at(F.split(path, "/"), -1)
    hit = F.col(path).rlike(INTERESTING) & ~name.rlike(BORING)
    some = files.agg(F.count_if(hit)).scalar()
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    label = F.when(base.rlike(GENERIC), F.lit("")).otherwise(clean_label(F.replace(base, F.lit("_"), F.lit(" "))))
    return files.filter(hit | (some == 0)).withColumn("base_label", label)


def _first_text(values: dict, fields) -> str:
    """The first plain text that a wanted field holds, itself or as its ``value``; a link is no text."""
    for name, value in values.items():
        if name.strip().lower() in fields:
            inner = value.get("value") if isinstance(value, dict) else value
            if isinstance(inner, str) and inner.strip() and not inner.startswith("http"):
                return " ".join(inner.split())[:120]
    return ""


class ExportTree:
    """An export document flattened to texts by path, and to labels by the path they hold for.

    ``texts`` lists (path, string) of everything that may carry a link. ``labels`` maps the path of
    an object to the label it states; it holds for all below it. ``rows`` maps the path of a list to
    the positions of labelled members: such a label also holds for the members after it.
    """

    def __init__(self, tree, has_link):
        self.texts, self.labels, self.rows = [], {}, {}
        pending = [((), tree)]
        while pending:
            path, node = pending.pop()
            if isinstance(node, str):
                self.texts.append((path, node))
                continue
            below = list(node.items()) if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else []
            if isinstance(node, dict):
                entries = next((node[k] for k in ("label_values", "dict") if isinstance(node.get(k), list)), None)
                if entries is not None:
                    below = self._entries(path, [e for e in entries if isinstance(e, dict)])
                else:
                    self._state(path, self._name(node, has_link))
            pending.extend(((*path, key), value) for key, value in below)
        for labelled in self.rows.values():
            labelled.sort()

    def _state(self, path: tuple, label: str) -> None:
        if label:
            self.labels[path] = label
            if path and isinstance(path[-1], int):
                self.rows.setdefault(path[:-1], []).append(path[-1])

    @staticmethod
    def _name(node: dict, has_link) -> str:
        """A collection field names an object; so does a name field, unless the object is a link's own record."""
        mapped = node.get("string_map_data")
        mapped = mapped if isinstance(mapped, dict) else {}
        near = [v for v in node.values() if isinstance(v, str)] + [x for m in mapped.values() if isinstance(m, dict) for x in m.values() if isinstance(x, str)]
        return _first_text(mapped, COLLECTION_FIELDS) or ("" if any(map(has_link, near)) else _first_text(node, NAME_FIELDS))

    def _entries(self, path: tuple, entries: list[dict]) -> list:
        """A record kept as labelled entries: its link, else its label; and the groups of members in it."""
        said: dict = {}
        for e in entries:
            if "dict" not in e and isinstance(e.get("value"), str):
                said.setdefault(str(e.get("label") or "").strip().lower(), e["value"])
        link = next((said[f] for f in LINK_FIELDS if said.get(f)), "")
        if link:
            self.texts.append(((*path, "link"), link))
        else:
            self._state(path, next((" ".join(said[f].split())[:120] for f in (*COLLECTION_FIELDS, "title") if said.get(f)), ""))
        groups = [e["dict"] for e in entries if isinstance(e.get("dict"), list) and str(e.get("title") or "").strip().lower() not in ENTITY_GROUPS]
        return [(f"group {n}", group) for n, group in enumerate(groups)]

    def label_of(self, path: tuple, default: str) -> str:
        """The label stated nearest above a path."""
        for depth in range(len(path), -1, -1):
            here = path[:depth]
            if here in self.labels:
                return self.labels[here]
            if depth and here[:-1] in self.rows:
                labelled = self.rows[here[:-1]]
                before = bisect_left(labelled, here[-1])
                if before:
                    return self.labels[(*here[:-1], labelled[before - 1])]
        return default


def tree_links(docs: DataFrame, doc: str = "doc", text: str = "text", default: str = "uncategorised", link: str = K.PERMALINK) -> DataFrame:
    """(doc, url, label) of every link in export JSON, under the nearest label stated above it."""
    import re
    pattern = re.compile(link)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, s in zip(pdf[doc], pdf[text]):
                try:
                    tree = ExportTree(json.loads(s), pattern.search)
                except (ValueError, TypeError, RecursionError):
                    continue
                rows.extend((d, m.group(0), tree.label_of(path, default)) for path, found in tree.texts for m in pattern.finditer(found))
            yield pd.DataFrame(rows, columns=[doc, "url", "label"])

    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, url string, label string")


def dedupe_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct (key, url, label), tally per label); a link keeps every label it was filed under."""
    c = links.withColumn("c", K.canonical(F.col("url"))).filter(F.col("c").isNotNull())
    d = c.select("c.key", "c.url", "label").distinct()
    return d, d.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label")


def slices_per_key(records: DataFrame) -> DataFrame:
    """records(url, collection, owner, taken_at, caption, seq) to one slice per permalink key."""
    r = records.withColumn("c", K.canonical(F.col("url"))).filter(F.col("c").isNotNull())
    first = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f)
    return r.groupBy(F.col("c.key").alias("key")).agg(
        F.array_sort(F.collect_set(F.nullif(clean_label(F.col("collection"), 60), F.lit("")))).alias("collections"), first("owner"), first("taken_at"), first("caption"))


def digits(c: Column) -> Column:
    return F.when(c != "", F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint"), F.lit(0)))


def parse_captions(messages: DataFrame, text: str = "text", tag: str = "key") -> DataFrame:
    """Key, link, collections, uploader and counters of every message with a permalink."""
    t = F.col(text)
    grab = lambda p: F.regexp_extract(t, p, 1)
    tagged = grab(rf"{tag}:([A-Za-z0-9_-]{{5,}})")
    # A generated column is computed once a row; as a projection it would be read anew, text and all, wherever it is used.
    m = messages.withColumn("c", F.explode(F.filter(F.array(K.canonical(t)), lambda c: c.isNotNull())))
    cats = F.filter(F.transform(F.split(grab(r"(?i)(?:Category|Collection)\s*:\s*([^\n|]{1,120})"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return m.select(*messages.columns, F.coalesce(F.nullif(tagged, F.lit("")), "c.key").alias("key"), F.col("c.url").alias("url"), F.col("c.kind").alias("kind"),
                    cats.alias("collections"), F.trim(grab(r"(?i)(?:Creator|Author|Uploader)\s*:\s*([^\n|]{1,80})")).alias("uploader"),
                    digits(grab(r"(?i)Views\s*:\s*([\d,\.]+)")).alias("views"), digits(grab(r"(?i)Likes\s*:\s*([\d,\.]+)")).alias("likes"),
                    digits(grab(r"(?i)Comments\s*:\s*([\d,\.]+)")).alias("comment_count"))


def build_caption(url: Column, key: Column, collections: Column, uploader: Column, views: Column, likes: Column, comments: Column,
                  description: Column, limit: int = 1024, tag: str = "key") -> Column:
    """Metadata first, description trimmed on a word where that keeps 60 % of the room."""
    num = lambda c: F.coalesce(F.format_number(c, 0), F.lit("?"))
    cols = F.array_join(F.array_sort(F.array_distinct(F.filter(collections, lambda x: x != ""))), ", ")
    head = F.concat(F.lit("Category: "), F.substring(F.when(cols == "", F.lit("uncategorised")).otherwise(cols), 1, 300),
                    F.lit("\nCreator: "), F.substring(F.coalesce(F.nullif(uploader, F.lit("")), F.lit("unknown")), 1, 120),
                    F.lit("\nViews: "), num(views), F.lit(" | Likes: "), num(likes), F.lit(" | Comments: "), num(comments), F.lit("\n"))
    tail = F.concat(F.lit("\nLink: "), url, F.lit(f"\n{tag}:"), key)
    raw = F.replace(F.trim(F.coalesce(description, F.lit(""))), F.lit("\n"), F.lit(" "))

    def whole(p: Column) -> Column:
        head, tail, raw = p["head"], p["tail"], p["raw"]
        room = F.lit(limit - 64) - F.length(head) - F.length(tail)
        cut = F.substring(raw, F.lit(1), room - 1)
        word = F.regexp_replace(cut, r" [^ ]*$", "")
        short = F.when(F.length(raw) <= room, raw).otherwise(F.concat(F.when(F.length(word) > room * 0.6, word).otherwise(cut), F.lit("…")))
        return F.concat(head, F.when((room > 40) & (raw != ""), F.concat(F.lit("Caption: "), short, F.lit("\n"))).otherwise(F.lit("")), tail)

    # The parts are used several times; bound in an array of one they are made once.
    return F.get(F.transform(F.array(F.struct(head.alias("head"), tail.alias("tail"), raw.alias("raw"))), whole), F.lit(0))


# ---- tool logs -----------------------------------------------------------------------

def cut_times(logs: DataFrame, key: str = "entity_key", text: str = "text") -> DataFrame:
    """(key, t, score) of every scene change a log reports."""
    hit = F.explode(F.regexp_extract_all(text, F.lit(r"scd\.score:\s*[\d.]+,\s*(?:lavfi\.)?scd\.time:\s*[\d.]+"), F.lit(0)))
    return logs.select(key, hit.alias("h")).select(key, F.regexp_extract("h", r"time:\s*([\d.]+)", 1).cast("double").alias("t"),
                                                   F.regexp_extract("h", r"score:\s*([\d.]+)", 1).cast("double").alias("score"))


def frame_metrics(lines: DataFrame, key: str = "entity_key", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(key, idx, t, metric, value) from frame header lines followed by their readings."""
    from ..operators.sequences import Carry, with_carry
    idx = F.regexp_extract(line, r"frame:\s*(\d+)", 1)
    at = F.regexp_extract(line, r"pts_time:\s*(\S+)", 1)
    head = F.when(F.col(line).rlike(r"^\s*frame:\s*\d+.*pts_time:"), F.struct(idx.cast("bigint").alias("idx"), F.coalesce(at.try_cast("double"), F.lit(0.0)).alias("t")))
    rows = with_carry(lines.withColumn("head", head).withColumn(line_no, F.col(line_no).cast("bigint")), [key], [line_no], [Carry("cur", "last", F.col("head"))],
                      F.floor(F.col(line_no) / 100_000).cast("bigint"))
    kv = rows.filter(F.col("head").isNull() & F.col("cur").isNotNull() & F.col(line).rlike(r"^\s*[\w.]+=")).select(
        key, "cur.idx", "cur.t", F.trim(F.split_part(line, F.lit("="), F.lit(1))).alias("metric"), F.regexp_extract(line, r"=(.*)$", 1).try_cast("double").alias("value"))
    return kv


def silences(lines: DataFrame, key: str = "entity_key", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(key, t0, t1): paired starts and ends; a start nothing closes has no end; starts clamp at 0."""
    from ..operators.sequences import Carry, with_carry
    start = F.nullif(F.regexp_extract(line, r"silence_start:\s*(-?[\d.]+)", 1), F.lit("")).cast("double")
    end = F.nullif(F.regexp_extract(line, r"silence_end:\s*(-?[\d.]+)", 1), F.lit("")).cast("double")
    ev = lines.select(key, F.col(line_no).cast("bigint").alias("n"), start.alias("s"), end.alias("e")).filter(F.col("s").isNotNull() | F.col("e").isNotNull())
    nxt = with_carry(ev, [key], ["n"], [Carry("ahead", "lead", F.struct("s", "e"))], F.floor(F.col("n") / 100_000).cast("bigint"))
    keep = nxt.filter(F.col("s").isNotNull() & (F.col("ahead").isNull() | F.col("ahead.s").isNull()))
    return keep.select(key, F.greatest(F.lit(0.0), F.col("s")).alias("t0"), F.col("ahead.e").alias("t1"))


def loudness_summary(lines: DataFrame, key: str = "entity_key", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row per key: first match of each summary field; minus infinity is no number."""
    fields = {"lufs": r"^\s*I:\s*(-?[\d.]+|-inf)\s*LUFS", "lra": r"^\s*LRA:\s*(-?[\d.]+)\s*LU", "true_peak": r"^\s*Peak:\s*(-?[\d.]+|-inf)\s*dBFS"}
    def first(p):
        v = F.regexp_extract(line, p, 1)
        return F.min_by(F.when(v != "-inf", v.try_cast("double")), F.when(F.col(line).rlike(p), F.col(line_no)))
    return lines.groupBy(key).agg(*[first(p).alias(n) for n, p in fields.items()])


def loudness_curve(metrics: DataFrame, floor: float = -70.0, metric: str = "lavfi.r128.M") -> DataFrame:
    """Momentary readings above the floor, from ``frame_metrics`` rows."""
    return (metrics.filter((F.col("metric") == metric) & (F.col("value") > floor))
            .select("entity_key", F.round("t", 3).alias("t"), F.round("value", 2).alias("m")))


def media_facts(messages: DataFrame) -> DataFrame:
    """First present of video, document, animation and photo structs, flattened."""
    have = [F.col(c) for c in ("video", "document", "animation", "photo") if c in messages.columns]
    return messages.withColumn("media", F.coalesce(*have))


def bare_upload(mime: Column, name: Column, reply_to: Column, caption: Column, own_prefixes=(), own_suffixes=(), tag: str = "key") -> Column:
    """A video someone put there: not a reply, not tagged, not one of our own artefacts."""
    low = F.lower(F.coalesce(name, F.lit("")))
    video = F.coalesce(mime.startswith("video/"), F.lit(False)) | low.rlike(r"\.(mp4|mov|mkv|webm|m4v)$")
    own = F.lit(False)
    for p in own_prefixes:
        own = own | low.startswith(p)
    for s in own_suffixes:
        own = own | low.contains(s)
    return video & reply_to.isNull() & ~F.coalesce(caption, F.lit("")).rlike(rf"{tag}:[A-Za-z0-9_-]{{5,}}") & ~own

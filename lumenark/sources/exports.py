"""Export files of mixed form: archives, JSON trees, pages and link lists, told apart by name and first bytes.

Files come as (path, content), the columns of Spark's ``binaryFile`` source. A task opens the archives of
its own files member by member; of a page or list only lines with a header or a link are kept, so what is
written between the passes is small. An archive gives the members whose names look like saved links; only
one in which these hold no link at all is opened again for the others.

Defined results. A NULL or empty file has no links; a scan of a folder does not list empty files. A damaged archive, an archive member that cannot be
read and a member whose JSON cannot be parsed are rows of kind ``damaged`` and give no links. A loose file
that looks like JSON but is not is read as a link list. Bytes that are no UTF-8 become U+FFFD. A link under
no label has its member's name as label, or ``uncategorised`` if that is a container's name; loose files
have no such name.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..session import cut_lineage
from . import texts as X

MEMBER = "path string, member string, kind string, stem string, text string, links array<struct<url:string,label:string>>"
UNSORTED = "uncategorised"
#: Bytes of text a task holds before it hands rows on.
BATCH_BYTES = 4 << 20
#: What a link (a dict of two strings) takes there.
LINK_BYTES = 512


@dataclass
class Exports:
    """``links`` (path, member, url, label) and ``members`` (path, member, kind)."""

    links: DataFrame
    members: DataFrame

    def summary(self) -> DataFrame:
        """(path, format, n_members, n_damaged, n_links): the format of each file and what was found in it."""
        per = self.links.groupBy("path").agg(F.count("*").alias("n_links"))
        kinds = self.members.groupBy("path").agg(F.max(F.col("kind") == "archive").alias("packed"), F.max(F.col("kind") == "json").alias("tree"),
                                                 F.count_if((F.col("kind") != "archive") & F.col("member").isNotNull()).alias("n_members"),
                                                 F.count_if(F.col("kind") == "damaged").alias("n_damaged"))
        n = F.coalesce("n_links", F.lit(0))
        form = F.when(F.col("packed"), "archive").when(F.col("tree"), "json").when(n > 0, "markdown").otherwise("text")
        return kinds.join(per, "path", "left").select("path", form.alias("format"), "n_members", "n_damaged", n.alias("n_links"))


def kind_of(name: str, content: bytes) -> str:
    """``archive``, ``json``, ``page`` or ``list``: by extension, else by the first bytes."""
    low, start = name.lower(), content[:64].removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
    if low.endswith(".zip") or content[:2] == b"PK":
        return "archive"
    if low.endswith(".json"):
        return "json"
    if low.endswith((".html", ".htm")):
        return "page"
    return {b"{": "json", b"[": "json", b"<": "page"}.get(start, "list")


def _tree(text: str, link: re.Pattern) -> list[dict] | None:
    """Links of a JSON text with the label above each (empty: none); None if it is no JSON."""
    try:
        tree = X.ExportTree(json.loads(text), link.search)
    except (ValueError, RecursionError):
        return None
    return [{"url": m.group(0), "label": tree.label_of(path, "")} for path, found in tree.texts for m in link.finditer(found)]


def _loose(path: str, content: bytes, kind: str, link: re.Pattern) -> tuple:
    text = content.decode("utf-8-sig", "replace")
    if kind == "json":
        found = _tree(text, link)
        if found is not None:
            return (path, None, "json", "", None, found)
    return (path, None, "page" if kind == "page" else "list", "", text, None)


def _members(path: str, content: bytes, likely: bool, link: re.Pattern) -> Iterator[tuple]:
    """Of an archive: its own row, then a row for each JSON or page member that is wanted."""
    yield (path, None, "archive", "", None, None)
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        yield (path, None, "damaged", "", None, None)
        return
    with archive:
        for info in archive.infolist():
            name = info.filename
            wanted = bool(re.search(X.INTERESTING, name)) and not re.search(X.BORING, name)
            if info.is_dir() or wanted != likely or not name.lower().endswith((".json", ".html", ".htm")):
                continue
            stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            try:
                text = archive.read(info).decode("utf-8-sig", "replace")
            except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError):
                yield (path, name, "damaged", stem, None, None)
                continue
            if name.lower().endswith(".json"):
                found = _tree(text, link)
                yield (path, name, "damaged" if found is None else "json", stem, None, found)
            else:
                yield (path, name, "page", stem, text, None)


def unpack(files: DataFrame, likely: bool = True, link: str = K.PERMALINK) -> DataFrame:
    """(path, member, kind, stem, text, links): loose files and the wanted members of archives; without ``likely`` the others of archives only."""
    pattern = re.compile(link)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for path, content in zip(*batch.columns):  # one file at a time becomes a Python object
            path, data = path.as_py(), content.as_py() or b""
            kind = kind_of(path or "", data)
            if kind == "archive":
                yield from _members(path, data, likely, pattern)
            elif likely:
                yield _loose(path, data, kind, pattern)

    link_type = pa.list_(pa.struct([("url", pa.string()), ("label", pa.string())]))
    schema = pa.schema([(f.split()[0], link_type if f.startswith("links ") else pa.string()) for f in MEMBER.split(", ")])

    def table(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in rows(batch):
                held.append(row)
                size += len(row[4] or "") + LINK_BYTES * len(row[5] or ()) + 64
                if size > BATCH_BYTES:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    marked = F.col("text").isNotNull()
    plain = F.when(F.col("kind") == "page", X.html_to_markdown(F.col("text"))).otherwise(F.col("text"))
    lines = F.filter(F.split(plain, r"\r\n|\r|\n"), lambda line: line.rlike(X.HEADER) | line.rlike(link))
    return files.select("path", "content").mapInArrow(run, MEMBER).withColumn("text", F.when(marked, F.array_join(lines, "\n")))


def _links(members: DataFrame, link: str) -> DataFrame:
    """(path, member, url, label) of unpacked members."""
    named = F.when(F.col("stem").rlike(X.GENERIC), F.lit("")).otherwise(X.clean_label(F.replace("stem", F.lit("_"), F.lit(" "))))
    own = F.when((named == "") | F.col("stem").isNull(), F.lit(UNSORTED)).otherwise(named)
    rows = members.withColumn("doc", F.struct("path", "member", own.alias("own")))
    trees = rows.select("doc", F.explode("links").alias("l")).select("doc", "l.url", "l.label")
    lists = X.markdown_links(rows.where(F.col("text") != "").select("doc", "text"), default="", link=link).select("doc", "url", "label")
    label = F.when(F.col("label") == "", F.col("doc.own")).otherwise(F.col("label"))
    return trees.unionByName(lists).select("doc.path", "doc.member", "url", label.alias("label"))


def read_exports(files: DataFrame, link: str = K.PERMALINK) -> Exports:
    """Links of files(path, content), and what every file was read as."""
    first = cut_lineage(unpack(files, True, link))
    found = _links(first, link)
    packed = first.where(F.col("kind") == "archive").select("path").distinct()
    barren = cut_lineage(packed.join(found.select("path").distinct(), "path", "left_anti"))
    kinds = first.select("path", "member", "kind")
    if barren.isEmpty():
        return Exports(found, kinds)
    others = cut_lineage(unpack(files.join(barren, "path", "left_semi"), False, link).where((F.col("kind") != "archive") & F.col("member").isNotNull()))
    return Exports(found.unionByName(_links(others, link)), kinds.unionByName(others.select("path", "member", "kind")))


def scan_exports(spark: SparkSession, folder: str, link: str = K.PERMALINK) -> Exports:
    """The same of all files below a folder; a file may hold up to 2 GB, the bound of ``binaryFile``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read_exports(files.select("path", "content"), link)

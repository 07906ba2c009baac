"""Mixed export files: real files on disk, odd and damaged ones among them."""

import io
import json
import zipfile

from lumenark.sources import exports as E
from lumenark.sources import texts as X

AT = "https://instagram.com/reel/"


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def saved(*codes, name=None):
    return json.dumps({"saved": [{"string_map_data": {**({"Name": {"value": name}} if name else {}), "Post": {"href": AT + c}}} for c in codes]})


FILES = {
    "full.zip": packed({"saved/saved_posts.json": saved("AAAAA1", name="trips"), "saved/my_boards.json": saved("AAAAA2"), "saved/saved_comments.json": saved("XXXXX1"),
                        "other/profile.json": saved("XXXXX2"), "saved/broken.json": "{", "saved/notes.txt": AT + "XXXXX3"}),
    "renamed.zip": packed({"saved/saved.json": "[]", "media/old_things.json": saved("BBBBB1"), "media/page.html": f"<h2>Food</h2><a class='x' href='{AT}BBBBB2'>b</a>"}),
    "nameless": packed({"saved/collections.html": f"<a href=\"{AT}CCCCC1\">c</a>"}),
    "tree.json": saved("DDDDD1", name="art").encode(),
    "bad.json": f"## Pets\n{AT}EEEEE1 and {AT}EEEEE2".encode(),
    "sniffed.dat": b"\xef\xbb\xbf \n" + saved("FFFFF1").encode(),
    "bracket.md": f"[one]({AT}GGGGG1)\n# Later #\n- {AT}GGGGG2\r\n{AT}GGGGG1/".encode(),
    "page.htm": f"<p>x</p><h3>Home</h3><a href=\"{AT}HHHHH1\">h</a>".encode(),
    "words.txt": b"no link here \xff\xfe",
    "empty.txt": b"",
    "cut.zip": packed({"saved/a.json": saved("XXXXX4")})[:40],
    "long.txt": (("word " * 40 + "\n") * 20_000 + AT + "IIIII1\n").encode(),
}
WANT = {("full.zip", "AAAAA1", "trips"), ("full.zip", "AAAAA2", "my boards"), ("renamed.zip", "BBBBB1", "old things"), ("renamed.zip", "BBBBB2", "Food"),
        ("nameless", "CCCCC1", "collections"), ("tree.json", "DDDDD1", "art"), ("bad.json", "EEEEE1", "Pets"), ("bad.json", "EEEEE2", "Pets"),
        ("sniffed.dat", "FFFFF1", "uncategorised"), ("bracket.md", "GGGGG1", "uncategorised"), ("bracket.md", "GGGGG2", "Later"),
        ("bracket.md", "GGGGG1", "Later"), ("page.htm", "HHHHH1", "Home"), ("long.txt", "IIIII1", "uncategorised")}


def test_files_of_every_form(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    got = E.scan_exports(spark, str(tmp_path))
    links = [(r["path"].rsplit("/", 1)[1], r["url"].rsplit("/", 1)[1], r["label"]) for r in got.links.collect()]
    assert len(links) == len(set(links)) and set(links) == WANT
    s = {r["path"].rsplit("/", 1)[1]: r for r in got.summary().collect()}
    assert set(s) == set(FILES) - {"empty.txt"}  # the scan lists no empty files
    assert {n: r["format"] for n, r in s.items()} == {
        "full.zip": "archive", "renamed.zip": "archive", "nameless": "archive", "cut.zip": "archive", "tree.json": "json", "sniffed.dat": "json",
        "bad.json": "markdown", "bracket.md": "markdown", "page.htm": "markdown", "long.txt": "markdown", "words.txt": "text"}
    assert (s["full.zip"]["n_members"], s["full.zip"]["n_damaged"], s["full.zip"]["n_links"]) == (3, 1, 2)
    assert s["cut.zip"]["n_damaged"] == 1 and s["renamed.zip"]["n_members"] == 3
    distinct, tally = X.dedupe_links(got.links)
    assert distinct.count() == 14 and tally.first()["label"] == "uncategorised" and tally.first()["n"] == 3


def test_no_files_and_null_content(spark):
    none = E.read_exports(spark.createDataFrame([], "path string, content binary"))
    assert none.links.count() == 0 and none.summary().count() == 0
    null = E.read_exports(spark.createDataFrame([("a.zip", None), ("b", None), ("c", b""), (None, b"x")], "path string, content binary"))
    assert null.links.count() == 0 and {r["path"]: r["n_damaged"] for r in null.summary().collect()} == {"a.zip": 1, "b": 0, "c": 0, None: 0}


def test_labels_of_a_long_list_carry_forward():
    tree = X.ExportTree([{"title": "one"}, *[{"href": f"{AT}ABCDE{i}"} for i in range(50_000)], {"title": "two"}, {"href": AT + "ZZZZZ"}], lambda s: "http" in s)
    labels = [tree.label_of(path, "") for path, found in sorted(tree.texts) if "http" in found]
    assert labels == ["one"] * 50_000 + ["two"]

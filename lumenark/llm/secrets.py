"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Three base kinds are found in every whole text: assignments to secret-like names, access key ids and
long hex runs. Further kinds (key blocks, signed tokens, prefixed tokens) are candidates. Values are
hashed and their owners, repositories and distinct texts counted over the corpus: a value that several
owners carry in different texts, or that very many texts carry, is a copied example, one that stays
with its owner looks live. Copies of one text count as one, so a live value is not cleared by them.
``judged`` has every span with its verdict; ``scan`` leaves out the further kinds' copied examples.

Places come from the pieces between matches: a text split at a pattern and the matches themselves
alternate, so places are running sums of lengths, in code points.

Defined results. NULL and empty texts have no spans. Repeated rows each get the same spans and count
once as a repository. A NULL owner is an owner of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import row_key, table

_KEY = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Base kinds in the order of their listing (fixed by the contract): name, pattern, group of the value, least length of the value.
BASE = [
    ("assign", _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs, shorter ones left out at once
]
#: Kinds that the ownership counts decide on.
FURTHER = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("prefixed", r"(?<![A-Za-z0-9_])(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|rk_live|hf|npm)[_-][A-Za-z0-9_-]{20,}", 0, 24),
]
KINDS = BASE + FURTHER
ORDER = {k[0]: i for i, k in enumerate(KINDS)}


def spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Every kept match: (k1, k2, owner, repo, hash of the text t, kind, start, end, value hash v1 and v2).

    ``docs`` has doc_id and text; the key is ``row_key(doc_id, text)``.
    """
    text = F.col("text")
    any_kind = F.lit(False)
    for _, pattern, _, _ in KINDS:
        any_kind = any_kind | text.rlike(pattern)
    few = docs.where(any_kind).select(*row_key("doc_id", "text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repo"), F.xxhash64(F.lit(43), "text").alias("t"), "text").distinct()
    kinds = [F.struct(F.lit(name).alias("kind"), F.lit(least).alias("least"),
                      F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
                      F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                      F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values")) for name, pattern, group, least in KINDS]
    rows = few.select("k1", "k2", "owner", "repo", "t", F.explode(F.array(*kinds)).alias("m"))
    rows = rows.where("size(m.found) > 0").select("k1", "k2", "owner", "repo", "t", F.col("m.kind").alias("kind"), F.col("m.least").alias("least"),
                                                   F.posexplode(F.arrays_zip(F.slice("m.gaps", F.lit(1), F.size("m.found")).alias("gap"), F.col("m.found").alias("found"),
                                                                             F.col("m.values").alias("value"))).alias("i", "x"))
    length = F.length("x.found")
    passed = F.sum(F.col("x.gap") + length).over(Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("end", passed).withColumn("start", passed - length).where(F.length("x.value") >= F.col("least"))
    return placed.select("k1", "k2", "owner", "repo", "t", "kind", "start", "end", F.xxhash64("x.value").alias("v1"), F.hash(F.lit(3), "x.value").alias("v2"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners, repositories and texts of each value: (v1, v2, n_owners, n_repos, n_texts), reduced before each shuffle."""
    pairs = found.select("v1", "v2", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("o"), F.coalesce(F.concat(F.lit("="), "repo"), F.lit("")).alias("r"), "t").distinct()
    owners = pairs.select("v1", "v2", "o").distinct().groupBy("v1", "v2").agg(F.count("*").alias("n_owners"))
    repos = pairs.select("v1", "v2", "r").distinct().groupBy("v1", "v2").agg(F.count("*").alias("n_repos"))
    texts = pairs.select("v1", "v2", "t").distinct().groupBy("v1", "v2").agg(F.count("*").alias("n_texts"))
    return owners.join(repos, ["v1", "v2"]).join(texts, ["v1", "v2"])


def judged(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text",
           example_owners: int = 2, example_texts: int = 20) -> DataFrame:
    """All spans with their verdict: (k1, k2, kind, start, end, n_owners, n_repos, n_texts, live).

    A value is a copied example, not live, if ``example_owners`` carry it in two different texts or
    more, or if ``example_texts`` different texts carry it, whoever owns them.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(owner_col).alias("owner_"), F.col(repository_col).alias("repo_"))
    found = spans(rows, F.col("owner_"), F.col("repo_"))
    copied = ((F.col("n_owners") >= example_owners) & (F.col("n_texts") > 1)) | (F.col("n_texts") >= example_texts)
    return found.join(ownership(found), ["v1", "v2"]).select("k1", "k2", "kind", "start", "end", "n_owners", "n_repos", "n_texts", (~copied).alias("live")).distinct()


def scan(docs: DataFrame, **options) -> DataFrame:
    """The spans of ``judged`` without copied examples of the further kinds."""
    return judged(docs, **options).where(F.col("kind").isin([k[0] for k in BASE]) | F.col("live"))


def listed(kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of a group's spans by start, then by kind as listed, comma-joined; of ``kinds`` only, if given."""
    rank = F.element_at(F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    entry = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("text"))
    if kinds is not None:
        entry = F.when(F.col("kind").isin(kinds), entry)
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = judged(docs)
    base = [k[0] for k in BASE]

    def tally(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"n_{kind}")

    by_text = found.groupBy("k1", "k2").agg(*[tally(k) for k in base], listed(base).alias("base"), listed().alias("spans"),
                                             F.sum(F.col("live").cast("bigint")).alias("n_live"))
    rows = docs.select("doc_id", *row_key("doc_id", "text"))
    none = F.lit(0).cast("bigint")
    return rows.join(by_text, ["k1", "k2"], "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", none).alias("n_live"))

"""N-gram Jaccard join along chosen paths.

A text is the set of its word shingles, and equal sets are one *class of copies* from the start.
Each set has a MinHash signature of ``t`` coordinates. A run splits the sets recursively: a node of
the recursion picks each coordinate with probability ``1 / (threshold * t)``, by a hash of its path,
and a set falls into a child for every coordinate picked, named by its value there. So two sets of
similarity ``threshold`` meet in one child on average, dissimilar ones part. A node of at most
``bucket`` sets is compared by brute force. So is, in blocks of that size, a larger one whose sets
are mostly alike, which splitting would not part, or which stays large to the last level: no pair is
given up. Runs are repeated until a pair at the threshold is
missed with a probability of at most ``1 - recall``. Every block of a node is compared for itself
first; across blocks only what is not joined by then is compared.

Pairs are never written out. Brute force on signatures joins sets into candidate components; within
a component all pairs are then verified on the exact sets, block against block, which yields each
set's number of links and a spanning forest. Classes are the components of the exact links.

Defined results. A text without words (NULL, empty, punctuation) has no partner and is a class of
its own. Repeated rows are copies. ``class_id`` is the least non-NULL id of the class. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import Scratch, arrow_map, spare_names, table
from lumenark.llm.shingles import mix, shingle_sets

T = 64
_RNG = np.random.default_rng(77)
_A, _B = _RNG.integers(0, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, T, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of ``T`` hash functions over a set, as 32 bits each."""
    low = np.full(T, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[k: k + 4096, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a node of the last level with probability ``recall``.

    The number of children that keep such a pair is Poisson with mean 1, so its survival follows
    ``q -> 1 - exp(-q)``; a run has ``1 / threshold`` first children on average.
    """
    q = 1.0
    for _ in range(depth - 1):
        q = 1.0 - math.exp(-q)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - q * threshold) * threshold))


def _picks(paths: np.ndarray, threshold: float) -> np.ndarray:
    """For each path the coordinates it splits on, as a boolean matrix."""
    coordinate = mix(np.arange(1, T + 1, dtype=np.uint64))
    return mix(paths[:, None] ^ coordinate[None, :]) < np.uint64(int(2**64 / (threshold * T)))


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path * np.uint64(0x9E3779B97F4A7C15) + mix(coordinate.astype(np.uint64) * np.uint64(2**32) + value.astype(np.uint64)))


def _split(nodes: DataFrame, threshold: float) -> DataFrame:
    """Children (node, id) of rows (node, id, sig)."""
    import pyarrow as pa

    def split(batch):
        path = batch.column("node").to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4").reshape(-1, T)
        row, coordinate = np.nonzero(_picks(path, threshold))
        child = _child(path[row], coordinate, sig[row, coordinate])
        return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("id").take(pa.array(row))], ["node", "id"])

    return arrow_map(nodes.select("node", "id", "sig"), split, "node bigint, id binary", rows=10_000)


def _first_level(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    """All runs start at one root each, so a set's first children are the coordinates that the roots pick."""
    import pyarrow as pa

    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    run, coordinate = np.nonzero(_picks(roots, threshold))

    def split(batch):
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u4").reshape(-1, T)
        child = _child(roots[run][None, :], coordinate[None, :], sig[:, coordinate])
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(sig)), len(run))))
        return pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), ids], ["node", "id"])

    return arrow_map(sets.select("id", "sig"), split, "node bigint, id binary", rows=10_000)


def _dense(large: DataFrame) -> DataFrame:
    """Nodes whose sets are mostly alike: over some coordinates they have few distinct values for their size."""
    few = [F.approx_count_distinct(F.substring("sig", 4 * c + 1, 4)) for c in range(0, T, T // 8)]
    return large.groupBy("node").agg((sum(few, F.lit(0)) / (F.lit(len(few)) * F.max("size"))).alias("share")).where("share <= 0.5").select("node")


def leaves(sets: DataFrame, scratch: Scratch, threshold: float, recall: float, bucket: int, depth: int) -> DataFrame:
    """Rows (node, size, id) of every node to compare by brute force."""
    found = None
    level = _first_level(sets, runs_for(recall, threshold, depth), threshold)
    for k in range(depth):
        level = scratch.keep(level, f"level{k}")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = scratch.keep(level.join(sizes, "node"), f"sized{k}")
        ready = sized if k == depth - 1 else sized.where(F.col("size") <= bucket)
        found = ready if found is None else found.unionByName(ready)
        large = sized.where(F.col("size") > bucket)
        if k == depth - 1 or large.isEmpty():
            break
        large = scratch.keep(large.join(sets.select("id", "sig"), "id"), f"large{k}")
        dense = scratch.keep(_dense(large), f"dense{k}")
        found = found.unionByName(large.join(dense, "node", "left_semi").select("node", "size", "id"))
        level = _split(large.join(dense, "node", "left_anti"), threshold)
    return found.select("node", "size", "id")


def _blocks(rows: DataFrame, key: str, block: int, per_group: int, total: int) -> DataFrame:
    """Deals each node's rows over pairs of blocks (lo <= hi) and the pairs over groups of about ``per_group`` rows."""
    n = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.hash("id", F.lit(5)), n)
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    unit = F.xxhash64(key, "lo", "hi")
    return dealt.withColumn("unit", unit).withColumn("g", F.pmod(unit, F.lit(max(1, -(-total // per_group)))))


def _by_id(ids, unit: np.ndarray) -> np.ndarray:
    """Order by unit, then by id."""
    key = np.frombuffer(b"".join(ids.to_pylist()), dtype=">u8").reshape(-1, 2)
    return np.lexsort((key[:, 1], key[:, 0], unit))


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, T)


def _binary(values) -> object:
    import pyarrow as pa

    return pa.array(list(values), type=pa.binary())


def _within(least: int):
    """A forest (id, root), one row a set at most, of the sets of each unit whose signatures agree in ``least`` coordinates."""
    import pyarrow as pa

    def forest(t):
        unit = t.column("unit").to_numpy()
        order = _by_id(t.column("id"), unit)  # so that a forest hangs on least ids, and forests of one group on few
        unit = unit[order]
        ids = np.array(t.column("id").to_pylist(), dtype=object)[order]
        sig = _signatures(t.column("short"))[order]
        a, b, step = [], [], 1
        live = np.arange(len(unit))
        while len(live):
            live = live[live + step < len(unit)]
            live = live[unit[live] == unit[live + step]]
            for k in range(0, len(live), 20_000):
                i = live[k: k + 20_000]
                i = i[(sig[i] == sig[i + step]).sum(axis=1) >= least]
                a.append(i)
                b.append(i + step)
            step += 1
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
        label = _components(a, b, len(unit))
        moved = np.flatnonzero(label != np.arange(len(unit)))
        return pa.table({"id": _binary(ids[moved]), "root": _binary(ids[label[moved]])})

    return forest


def _across(least: int, bucket: int):
    """A forest (id, root) of the components that sets of a block and visitors from elsewhere join, one row a component at most."""
    import pyarrow as pa

    def forest(t):
        unit, guest = t.column("unit").to_numpy(), t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        names, comp = np.unique(np.array(t.column("comp").to_pylist(), dtype=object), return_inverse=True)
        comp = comp.ravel()
        sig = _signatures(t.column("short"))
        order = np.argsort(unit, kind="stable")
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            home, guests = rows[~guest[rows]], rows[guest[rows]]
            for i in range(0, len(home), 64):
                for j in range(0, len(guests), bucket):
                    x, y = home[i: i + 64], guests[j: j + bucket]
                    u, v = np.nonzero(((sig[x][:, None, :] == sig[y][None, :, :]).sum(axis=2) >= least) & (comp[x][:, None] != comp[y][None, :]))
                    a.append(comp[x[u]])
                    b.append(comp[y[v]])
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
        label = _components(a, b, len(names))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"id": _binary(names[moved]), "root": _binary(names[label[moved]])})

    return forest


def candidates(found: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float, bucket: int) -> DataFrame:
    """Component (id, root) of every set that shares a node with one whose signature agrees often enough.

    The blocks of a node are compared for themselves first, which costs a row a set. What that joined
    needs no comparing any more, so across the blocks only sets outside the node's largest component
    travel: a node of one group of near copies, dealt otherwise in every run, is done by then.
    """
    least = int(T * threshold - 4.5 * math.sqrt(T * threshold * (1 - threshold)))
    short = sets.select("id", "short")
    blocks = F.ceil(F.col("size") / bucket).cast("int")
    rows = scratch.keep(found.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int")), "nodes")

    def in_groups(dealt: DataFrame, unit, total: int) -> DataFrame:
        return dealt.withColumn("unit", unit).withColumn("g", F.pmod("unit", F.lit(max(1, -(-total // 4000)))))

    inner = in_groups(rows.join(short, "id"), F.xxhash64("node", "block"), max(1, rows.count()))
    edges = scratch.keep(inner.groupBy("g").applyInArrow(_within(least), "id binary, root binary").distinct(), "inner_edges")
    comps = connect(edges, scratch, "inner")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return comps
    named = scratch.keep(large.join(comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"), "named")
    sizes = named.groupBy("node", "comp").agg(F.count("*").alias("n"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).where("all > top.n") \
        .select("node", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / bucket).cast("int").alias("chunks"))
    open_ = named.join(nodes, "node").join(short, "id")
    host = open_.select("node", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "comp", "short", F.lit(False).alias("guest"))
    guest = open_.where("comp <> main").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", "id"), F.col("chunks")).cast("int").alias("chunk"),
        "comp", "short", F.lit(True).alias("guest"))
    dealt = scratch.keep(host.unionByName(guest), "visits")
    outer = in_groups(dealt, F.xxhash64("node", "block", "chunk"), max(1, dealt.count()))
    more = scratch.keep(outer.groupBy("g").applyInArrow(_across(least, bucket), "id binary, root binary").distinct(), "outer_edges")
    return connect(comps.where("id <> root").unionByName(more), scratch, "candidate")


def connect(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Component (id, root) of every node of an edge table (id, root), by alternating stars until nothing moves.

    Each round rewrites the edges in the shared folder, which cuts lineage; rounds grow with the
    logarithm of the longest path.
    """
    k, before = 0, None
    edges = edges.select(F.greatest("id", "root").alias("v"), F.least("id", "root").alias("u"))
    # A node and all its roots belong to the least of these: one edge a node and a few between roots are left.
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    edges = scratch.keep(edges.join(least, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v != u").distinct(), f"{name}_first")
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = edges.join(low.withColumnRenamed("v", "u"), "u").select("v", F.col("m").alias("u")) \
            .union(low.select("v", F.col("m").alias("u"))).where("v != u").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        edges = scratch.keep(small.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), f"{name}{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.countDistinct("v")).first()
        if now == before and now[0] == now[2]:
            break
        before, k = now, k + 1
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())


def _exact(members: DataFrame, threshold: float, total: int) -> DataFrame:
    """Rows (id, root, links) of every block pair: linked documents seen from a set, and a forest of the exact links."""
    import pyarrow as pa

    rows = _blocks(members, "comp", 512, 1000, total)

    def verify(t):
        cols = {c: t.column(c).to_numpy() for c in ("unit", "mine", "lo", "hi", "copies")}
        ids, raw = t.column("id").to_pylist(), t.column("shingles").to_pylist()
        order = _by_id(t.column("id"), cols["unit"])
        cuts = np.flatnonzero(np.diff(cols["unit"][order])) + 1
        out_id, out_root, out_links = [], [], []
        for unit in np.split(order, cuts):
            seen = {}
            for i in unit.tolist():
                seen.setdefault((cols["mine"][i], ids[i]), i)  # a repeated row is one set
            unit = np.array(list(seen.values()))
            cross = cols["lo"][unit[0]] != cols["hi"][unit[0]]
            side = cols["mine"][unit] == cols["hi"][unit]
            left = np.flatnonzero(~side) if cross else np.arange(len(unit))
            right = np.flatnonzero(side) if cross else left
            hit = _linked([np.frombuffer(raw[i], dtype="<u8") for i in unit], left, right, threshold)
            if not cross:
                np.fill_diagonal(hit, False)
            weight = cols["copies"][unit]
            links = np.zeros(len(unit), dtype=np.int64)
            links[left] += hit @ weight[right]
            if cross:
                links[right] += hit.T @ weight[left]
            i, j = np.nonzero(hit)
            label = _components(left[i], right[j], len(unit))
            for k in np.flatnonzero(links).tolist():
                out_id.append(ids[unit[k]])
                out_root.append(ids[unit[label[k]]])
                out_links.append(int(links[k]))
        return pa.table({"id": pa.array(out_id, type=pa.binary()), "root": pa.array(out_root, type=pa.binary()), "links": pa.array(out_links, type=pa.int64())})

    return rows.groupBy("g").applyInArrow(verify, "id binary, root binary, links bigint")


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, width: int = 8192) -> np.ndarray:
    """Whether left and right sets reach the threshold: exact intersections by incidence over shared shingles."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.ravel()
    shared = np.bincount(code, minlength=len(tokens)) > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [start, start + width])
        incidence = np.zeros((len(sets), width), dtype=np.float32)
        incidence[owner[a:b], code[a:b] - start] = 1
        both += incidence[left] @ incidence[right].T
    union = size[left][:, None] + size[right][None, :] - both
    return both >= threshold * union - 1e-9


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """Every row's class of copies: (doc_id, th, id, n, sig, short); ``id`` is NULL where a text has no words."""
    import pyarrow as pa

    def sign(batch):
        sets = shingle_sets(batch.column("text"), width)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sigs = [signature(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(keys, type=pa.binary()),
             pa.array([None if s is None else s.tobytes() for s in sigs], type=pa.binary())], ["doc_id", "th", "id", "sig"])

    return arrow_map(docs, sign, "doc_id bigint, th bigint, id binary, sig binary")


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.99, bucket: int = 256, depth: int = 6,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th (hash of its text), class_id, class_th, n_links and n_copies.

    ``(class_id, class_th)`` names the class's first row; ``n_links`` counts the other documents whose
    sets reach the threshold, copies among them.
    """
    import pyarrow as pa

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "chosen-path")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    signed = scratch.keep(shingled(rows, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    sets = scratch.keep(
        signed.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("copies"), first.alias("first"), F.first("sig").alias("sig"))
        .withColumn("short", _low_bytes(F.col("sig"))), "sets")
    found = leaves(sets, scratch, threshold, recall, bucket, depth)
    comps = scratch.keep(candidates(found, sets, scratch, threshold, bucket).join(sets.select("id", "copies", "first"), "id"), "comps")
    sizes = comps.groupBy("root").agg(F.count("*").alias("size"))
    wanted = comps.join(sizes, "root").select(F.col("id").alias("want"), F.col("root").alias("comp"), "size", "copies",
                                              F.col("first.doc_id").alias("d"), F.col("first.th").alias("h"))

    def reshingle(batch):
        sets_ = shingle_sets(batch.column("text"), width)
        raw = pa.array([s.tobytes() for s in sets_], type=pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "comp", "size", "copies")] + [raw], ["id", "comp", "size", "copies", "shingles"])

    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))) \
        .select(F.col("want").alias("id"), "comp", "size", "copies", "text")
    members = arrow_map(texts, reshingle, "id binary, comp binary, size bigint, copies bigint, shingles binary", rows=256)
    exact = scratch.keep(_exact(members, threshold, max(1, comps.count())).groupBy("id", "root").agg(F.sum("links").alias("links")), "exact")
    linked = connect(exact.where("id != root").select("id", "root"), scratch, "linked")
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    named = linked.join(sets.select("id", "first"), "id").groupBy("root").agg(F.min("first").alias("top"))
    in_class = linked.join(named, "root").select("id", "top")
    known = sets.select("id", "copies", "first").join(links, "id", "left").join(in_class, "id", "left") \
        .select("id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "first").alias("top")) \
        .where("copies > 1 OR links > 0")
    known = scratch.keep(known, "known")
    return signed.select("doc_id", "th", "id").join(known, "id", "left").select(
        "doc_id", "th",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.when(F.col("top").isNull(), F.col("th")).otherwise(F.col("top.th")).alias("class_th"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"))


def _low_bytes(sig):
    """The lowest byte of each coordinate: enough to count agreements, a quarter of the size."""
    return F.unhex(F.regexp_replace(F.hex(sig), "(..)......", "$1"))


def first_of_class(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row kept of each class: its least id, and one of repeated rows."""
    id_, th, own = spare_names(docs, "keep_id", "keep_th", "text_th")
    keep = classes(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("th").eqNullSafe(F.col("class_th"))) \
        .select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(th)))
    return kept.dropDuplicates([id_, th]).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_links", "n_copies")

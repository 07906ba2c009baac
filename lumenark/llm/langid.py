"""Language identification by a byte convolutional network, trained in numpy.

The network reads windows of 256 bytes of lower-cased UTF-8, two bytes a step: byte embeddings,
filters over 2, 4 and 6 bytes, the maximum of each filter over the window, a softmax layer. A
filter is linear in the embeddings, so its response is a sum of one table row for each byte pair
under it; prediction looks these rows up instead of multiplying. Every byte of every text is read; a
document's probabilities are the byte-weighted mean over its windows.

Training takes at most ``docs_per_lang`` labelled documents of each language (those of least hash)
and ``windows_per_doc`` windows of each, evenly spread; this bound is all that reaches the driver.

Defined results. A text that is NULL or has no letter is ``und`` with score 0; so is every text if
there is nothing to learn from. A NULL id counts as the empty text in the held-out rule. Repeated
rows are predicted alike; equal probabilities go to the language first in the alphabet. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenark.llm.common import arrow_map, table, text_bytes

SIZE = 256
WIDTHS = (1, 2, 3)  # in byte pairs
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows(column) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a batch of texts, zero-padded, and each text's offset in them."""
    import pyarrow.compute as pc

    raw, offsets = text_bytes(pc.utf8_lower(column))
    counts = -(-np.diff(offsets) // SIZE)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((int(at[-1]), SIZE), dtype=np.uint8)
    flat = out.ravel()
    for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), at[:-1].tolist()):
        flat[w * SIZE: w * SIZE + b - a] = raw[a:b]
    return out, at


class ByteNetwork:
    """The network's weights, its training step and its prediction."""

    def __init__(self, languages: list[str], filters: int = 16, dim: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.filters, self.dim = languages, filters, dim
        self.p = {"embed": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 * w * dim) ** -0.5, (2 * w * dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, dtype=np.float32)
        self.p["out"] = np.zeros((len(WIDTHS) * filters, len(languages)), dtype=np.float32)
        self.p["bias"] = np.zeros(len(languages), dtype=np.float32)
        self._tables = None

    def tables(self) -> np.ndarray:
        """For each byte pair its share of every filter, by the filter's width and the pair's place in it."""
        if self._tables is None:
            two = 2 * self.dim
            parts = [self.p[f"w{w}"][k * two: (k + 1) * two] for w in WIDTHS for k in range(w)]
            weights = np.concatenate(parts, axis=1)
            low, high = self.p["embed"] @ weights[: self.dim], self.p["embed"] @ weights[self.dim:]
            self._tables = (low[:, None, :] + high[None, :, :]).reshape(65536, -1)
        return self._tables

    def pooled(self, pairs: np.ndarray, where: bool = False):
        """Maximum of each filter over each window of byte pairs, and its place if asked for."""
        rows, n, places, out, start = self.tables()[pairs], self.filters, [], [], 0
        for w in WIDTHS:
            last = pairs.shape[1] - w + 1
            total = rows[:, :last, start: start + n]
            for k in range(1, w):
                total = total + rows[:, k: last + k, start + k * n: start + (k + 1) * n]
            start += w * n
            if where:
                place = total.argmax(axis=1)
                places.append(place)
                out.append(np.take_along_axis(total, place[:, None, :], axis=1)[:, 0, :] + self.p[f"b{w}"])
            else:
                out.append(total.max(axis=1) + self.p[f"b{w}"])
        return np.concatenate(out, axis=1), places

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = np.maximum(hidden, 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, found: np.ndarray, chunk: int = 32) -> np.ndarray:
        """Probabilities of each window (rows of ``SIZE`` bytes)."""
        pairs = _pairs(found)
        out = np.empty((len(found), len(self.languages)), dtype=np.float32)
        for k in range(0, len(found), chunk):
            out[k: k + chunk] = self._softmax(self.pooled(pairs[k: k + chunk])[0])
        return out

    def gradients(self, found: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        hidden, places = self.pooled(_pairs(found), where=True)
        active = np.maximum(hidden, 0)
        error = (self._softmax(hidden) - np.eye(len(self.languages), dtype=np.float32)[target]) / len(found)
        g = {"out": active.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (error @ self.p["out"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            mine = back[:, i * self.filters: (i + 1) * self.filters]
            at = 2 * places[i][:, :, None] + np.arange(2 * w)
            seen = found[np.arange(len(found))[:, None, None], at]
            g[f"b{w}"] = mine.sum(axis=0)
            g[f"w{w}"] = np.einsum("bfk,bf->kf", self.p["embed"][seen].reshape(len(found), self.filters, -1), mine, optimize=True)
            share = np.einsum("bf,kf->bfk", mine, self.p[f"w{w}"]).reshape(*seen.shape, self.dim)
            for d in range(self.dim):
                g["embed"][:, d] += np.bincount(seen.ravel(), weights=share[..., d].ravel(), minlength=256)
        return g

    def fit(self, found: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 4e-3, seed: int = 2) -> ByteNetwork:
        """Adam over random batches, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(found), batch)
            for name, g in self.gradients(found[pick], target[pick]).items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                self.p[name] -= rate * (1 - step / (steps + 1)) * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
            self._tables = None
        return self

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}


def _pairs(found: np.ndarray) -> np.ndarray:
    return found[:, 0::2].astype(np.int32) * 256 + found[:, 1::2]


def sample_windows(docs: DataFrame, docs_per_lang: int, windows_per_doc: int) -> DataFrame:
    """Training windows (lang, window) of a bounded number of labelled documents of each language."""
    import pyarrow as pa

    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, window binary")
    # A first cut by hash leaves about 1.3 times what is wanted, so the exact cut ranks few rows.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * docs_per_lang / n + 100 / n)))])[F.col("lang")]
    draw = F.xxhash64(F.lit(3), "doc_id", F.length("text"))
    few = labelled.withColumn("draw", draw).where(F.pmod("draw", F.lit(1_000_003)) < share * 1_000_003)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).where(F.col("r") <= docs_per_lang)

    def cut(batch):
        found, at = windows(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        rows = [(langs[i], found[k].tobytes()) for i in range(len(langs)) if at[i + 1] > at[i]
                for k in sorted(set(np.linspace(at[i], at[i + 1] - 1, windows_per_doc).astype(int).tolist()))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.binary())], ["lang", "window"])

    return arrow_map(few.select("lang", "text"), cut, "lang string, window binary")


def train(docs: DataFrame, docs_per_lang: int = 1200, windows_per_doc: int = 5, steps: int = 600) -> ByteNetwork | None:
    """A network fitted on a bounded sample of ``docs`` (doc_id, text, lang); None where nothing is labelled."""
    rows = sample_windows(docs, docs_per_lang, windows_per_doc).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["window"]))
    languages = sorted({r["lang"] for r in rows})
    found = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), dtype=np.uint8).reshape(-1, SIZE)
    target = np.array([languages.index(r["lang"]) for r in rows])
    return ByteNetwork(languages).fit(found, target, steps)


def _named(model: ByteNetwork, text, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    found, at = windows(text)
    weight = (found != 0).sum(axis=1).astype(np.float64)
    run = np.zeros((len(found) + 1, len(model.languages)))
    np.cumsum(model.predict(found) * weight[:, None], axis=0, out=run[1:])
    mean = run[at[1:]] - run[at[:-1]]
    mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-12)
    best = mean.argmax(axis=1)
    score = np.clip(mean[np.arange(len(best)), best], 0.0, 1.0)
    return [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist())], np.where(letters, score, 0.0)


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """Predictions for ``docs`` (doc_id, text): (doc_id, held_out, lang_pred, score)."""
    import pyarrow as pa

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _letters(F.col("text")).alias("letters"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten kilobytes of weights

    def name(batch):
        langs, score = _named(shared.value, batch.column("text"), batch.column("letters").to_numpy(zero_copy_only=False).astype(bool))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, type=pa.string()), pa.array(score)],
                                          ["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(rows, name, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: ByteNetwork | None, min_score: float) -> DataFrame:
    """``docs`` without those that are ``und`` or whose best language has a lower probability than ``min_score``; all columns stay."""
    import pyarrow as pa

    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    rows = docs.select(*[F.col(c) for c in columns], _letters(F.col("text").cast("string")).alias("__letters"), F.col("text").cast("string").alias("__text"))

    def cut(batch):
        letters = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
        langs, score = _named(shared.value, batch.column(len(columns) + 1), letters)
        good = pa.array((score >= min_score) & letters)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], columns).filter(good)

    return arrow_map(rows, cut, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learns from the labelled documents that are not held out and predicts all."""
    rows = training_rows(docs)
    return predict(rows, train(rows, **options))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

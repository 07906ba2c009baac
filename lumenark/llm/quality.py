"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. The corpus is reduced to counts
of vote patterns (a power of three, whatever the corpus); expectation-maximisation over these counts
estimates how often each heuristic votes which way on good and on bad documents, and so each
pattern's posterior. A bounded sample, half of it from the likelier bad documents, then trains a
linear scorer on hashed features, byte 4-grams of the raw text and binned measures, against these
posteriors; the scorer reads every whole document and also judges those on which the heuristics are
silent. Its bias is then moved from the sample's share of bad documents to the corpus's.

The sample is bounded by ``sample`` documents, drawn by hash; vote counts cover all documents.

Defined results. A text that is NULL or holds no word scores 0 and is not kept. Repeated rows score
alike, NULL ids stay NULL. In an empty table, or one without votes on both sides, every text that has
words keeps its posterior as score. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import arrow_map, table, text_bytes
from lumenark.llm.shingles import word_hashes

BITS = 16
SCALE = 8.0
BINS = 24
GOOD, BAD, SILENT = 2, 0, 1

_CLASS = np.zeros((256, 5), dtype=np.int64)  # symbols, capitals, letters, digits, exclamation marks
for _b in range(33, 127):
    if not chr(_b).isalnum() and chr(_b) not in ".,;:'\"()?-":
        _CLASS[_b, 0] = 1
_CLASS[ord("A"): ord("Z") + 1, 1] = 1
_CLASS[ord("A"): ord("Z") + 1, 2] = _CLASS[ord("a"): ord("z") + 1, 2] = 1
_CLASS[ord("0"): ord("9") + 1, 3] = 1
_CLASS[ord("!"), 4] = 1

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that plain words do not hold: capitals (but the first letter), digits and all signs but sentence marks.
_ODD = np.zeros(256, dtype=bool)
_ODD[[b for b in range(33, 127) if not (chr(b).islower() or chr(b) in ".,;:?'-")]] = True

#: Heuristics: name, the measure at or below which it votes, that vote, the measure at or above which it votes, that vote.
#: Detectors of one fault stay silent where they find nothing.
RULES = [
    ("symbols", -1.0, SILENT, 0.03, BAD),
    ("capitals", -1.0, SILENT, 0.40, BAD),
    ("digits", -1.0, SILENT, 0.30, BAD),
    ("exclamations", -1.0, SILENT, 0.03, BAD),
    ("distinct_words", 0.40, BAD, 0.60, GOOD),
    ("repeated_runs", 0.05, GOOD, 0.30, BAD),
    ("plain_words", 0.70, BAD, 0.90, GOOD),
    ("words", 3, BAD, 20, GOOD),
]


def measures(column) -> np.ndarray:
    """A row for each text, a column for each rule; NaN where a rule has nothing to judge."""
    raw, offsets = text_bytes(column)
    at = np.stack([np.concatenate([[0], np.cumsum(_CLASS[raw, k])]) for k in range(5)], axis=1)
    symbols, capitals, letters, digits, marks = (at[offsets[1:]] - at[offsets[:-1]]).T.astype(np.float64)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    head = np.zeros(len(raw) + 1, dtype=bool)
    head[offsets] = True
    dark = ~_BLANK[raw]
    first = dark & (head[:-1] | np.concatenate([[True], ~dark[:-1]]))
    chunk = np.cumsum(first)
    odd = _ODD[raw] & ~(first & (_CLASS[raw, 1] == 1))
    spoilt = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 1, dtype=np.int64)
    spoilt[chunk[odd]] = 1
    ends = np.concatenate([[0], chunk])
    chunks, bad = ends[offsets[1:]] - ends[offsets[:-1]], np.cumsum(spoilt)
    bad = bad[ends[offsets[1:]]] - bad[ends[offsets[:-1]]]
    hashes, words_at = word_hashes(column)
    runs = hashes.copy()
    for k in (1, 2, 3, 4):
        runs[: max(len(runs) - k, 0)] += hashes[k:] * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)
    n = np.diff(words_at).astype(np.float64)
    distinct, repeated = np.full(len(n), np.nan), np.full(len(n), np.nan)
    for i, (a, b) in enumerate(zip(words_at[:-1].tolist(), words_at[1:].tolist())):
        if b - a >= 30:
            # Over stretches of 200 words, for long texts repeat words as a matter of course.
            stretch = [len(np.unique(hashes[j: j + 200])) / len(hashes[j: min(j + 200, b)]) for j in range(a, b, 200) if min(j + 200, b) - j >= 30]
            distinct[i] = sum(stretch) / len(stretch)
            repeated[i] = 1 - len(np.unique(runs[a: b - 4])) / (b - 4 - a)
    with np.errstate(invalid="ignore", divide="ignore"):
        upper = np.where(letters >= 10, capitals / letters, np.nan)
        plain = 1 - bad / chunks
    out = np.stack([symbols / size, upper, digits / size, marks / size, distinct, repeated, plain, n], axis=1)
    out[n == 0, :-1] = np.nan
    return out


def votes(measured: np.ndarray) -> np.ndarray:
    out = np.full(measured.shape, SILENT, dtype=np.int64)
    for k, (_, low, below, high, above) in enumerate(RULES):
        with np.errstate(invalid="ignore"):
            out[measured[:, k] <= low, k] = below
            out[measured[:, k] >= high, k] = above
    return out


def pattern_of(measured: np.ndarray) -> np.ndarray:
    """Votes on each text as one number in base 3."""
    return votes(measured) @ 3 ** np.arange(len(RULES))


def patterns() -> np.ndarray:
    """All vote patterns as rows of votes."""
    return np.arange(3 ** len(RULES))[:, None] // 3 ** np.arange(len(RULES)) % 3


class LabelModel:
    """Heuristics that vote independently given the class; ``chance[c, k, v]`` is the probability of vote v by rule k on class c."""

    def __init__(self, counts: np.ndarray, rounds: int = 200):
        seen = np.flatnonzero(counts)
        vote, weight = patterns()[seen], counts[seen].astype(np.float64)
        onehot = (vote[:, :, None] == np.arange(3)).astype(np.float64)
        lead = (vote == GOOD).sum(axis=1) - 2.0 * (vote == BAD).sum(axis=1)
        good = np.where(lead > 0, 0.95, 0.1)
        for _ in range(rounds):
            both = np.stack([(1 - good) * weight, good * weight])
            self.prior = (both.sum(axis=1) + 1.0) / (both.sum() + 2.0)
            tally = np.einsum("cp,pkv->ckv", both, onehot) + 0.5
            self.chance = tally / tally.sum(axis=2, keepdims=True)
            new = self.posterior(vote)
            done = np.abs(new - good).max(initial=0.0) < 1e-9
            good = new
            if done:
                break

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability that a document is good. A silent rule says nothing."""
        logs = np.log(self.chance)
        logs[:, :, SILENT] = 0.0
        total = np.log(self.prior)[:, None] + logs[:, np.arange(vote.shape[1]), vote].sum(axis=2)
        return 1.0 / (1.0 + np.exp(np.clip(total[0] - total[1], -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """How often each rule, where it votes, votes with the class."""
        right = self.prior[0] * self.chance[0, :, BAD] + self.prior[1] * self.chance[1, :, GOOD]
        cast = right + self.prior[0] * self.chance[0, :, GOOD] + self.prior[1] * self.chance[1, :, BAD]
        return {rule[0]: float(a) for rule, a in zip(RULES, right / cast)}


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashed 4-gram at each byte; the last three of a text's grams reach beyond it and are not used."""
    x = np.concatenate([raw, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _bins(measured: np.ndarray) -> np.ndarray:
    """Feature number of each measure's bin: shares by twentieths, the word count by powers of two."""
    scaled = measured * 20.0
    scaled[:, -1] = np.log2(measured[:, -1] + 1)
    place = np.where(np.isnan(scaled), BINS - 1, np.clip(np.nan_to_num(scaled), 0, BINS - 2)).astype(np.int64)
    return (1 << BITS) + place + BINS * np.arange(measured.shape[1])


class Scorer:
    """Logistic regression on a text's mean over its hashed 4-grams and on the bins of its measures."""

    def __init__(self):
        self.w, self.bias = np.zeros((1 << BITS) + BINS * len(RULES), dtype=np.float64), 0.0

    def fit(self, features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
        """Adam on soft targets; a feature list holds (gram, share of the text) arrays."""
        row = np.repeat(np.arange(len(features)), [len(g) for g, _ in features])
        gram = np.concatenate([g for g, _ in features]).astype(np.int64)
        share = np.concatenate([s for _, s in features]) * SCALE
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for step in range(1, rounds + 1):
            z = np.bincount(row, weights=self.w[gram] * share, minlength=len(features)) + self.bias
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / len(features)
            g = np.append(np.bincount(gram, weights=error[row] * share, minlength=len(self.w)) + decay * self.w / len(self.w), error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (1 - (step - 1) / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            self.w -= move[:-1]
            self.bias -= move[-1]
        return self

    def score(self, column, measured: np.ndarray) -> np.ndarray:
        raw, offsets = text_bytes(column)
        sums = np.concatenate([[0.0], np.cumsum(self.w[_grams(raw)])])
        end = np.maximum(offsets[1:] - 3, offsets[:-1])
        z = SCALE * (sums[end] - sums[offsets[:-1]]) / np.maximum(end - offsets[:-1], 1) + self.w[_bins(measured)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def judged(docs: DataFrame, text_col: str) -> DataFrame:
    """(pattern): the votes on every document."""
    import pyarrow as pa

    def vote(batch):
        return pa.RecordBatch.from_arrays([pa.array(pattern_of(measures(batch.column("text"))).astype(np.int32))], ["pattern"])

    return arrow_map(docs.select(F.col(text_col).cast("string").alias("text")), vote, "pattern int")


def classify(docs: DataFrame, sample: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of its vote pattern), score (of the scorer, 0 to 1) and keep."""
    import pyarrow as pa

    spark = docs.sparkSession
    counts = np.zeros(3 ** len(RULES), dtype=np.int64)
    for r in judged(docs, text_col).groupBy("pattern").agg(F.count("*").alias("n")).collect():  # at most one row a pattern
        counts[r["pattern"]] = r["n"]
    posterior = LabelModel(counts).posterior(patterns())
    bad = [int(p) for p in np.flatnonzero((posterior < 0.5) & (counts > 0))]
    n_bad = int(counts[bad].sum())
    shares = [min(1.0, 0.5 * sample / max(n, 1)) for n in (n_bad, int(counts.sum()) - n_bad)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def features(batch):
        raw, offsets = text_bytes(batch.column("text"))
        measured, gram = measures(batch.column("text")), _grams(raw)
        found, bins = pattern_of(measured), _bins(measured)
        draws = batch.column("draw").to_numpy()
        out = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b - 3 > a and draws[i] < shares[int(found[i]) not in bad_set] * 1_000_003:
                which, times = np.unique(gram[a: b - 3], return_counts=True)
                share = np.concatenate([times / (b - 3 - a), np.full(len(RULES), 1 / SCALE)])
                out.append((int(found[i]), np.concatenate([which, bins[i]]).astype("<u4").tobytes(), share.astype("<f4").tobytes()))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int32()), pa.array(cols[1], type=pa.binary()), pa.array(cols[2], type=pa.binary())], ["pattern", "gram", "share"])

    bad_set = set(bad)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(5), "doc_id", F.length("text")), F.lit(1_000_003))).where(F.col("draw") < max(shares) * 1_000_003)
    taken = arrow_map(drawn.select("draw", "text"), features, "pattern int, gram binary, share binary").collect()
    taken.sort(key=lambda r: (r["pattern"], r["gram"]))
    scorer = None
    if len({r["pattern"] in bad_set for r in taken}) == 2:
        scorer = Scorer().fit([(np.frombuffer(r["gram"], dtype="<u4"), np.frombuffer(r["share"], dtype="<f4")) for r in taken], np.array([posterior[r["pattern"]] for r in taken]))
        drawn_bad = sum(r["pattern"] in bad_set for r in taken)
        scorer.bias += np.log((counts.sum() - n_bad) / n_bad) - np.log((len(taken) - drawn_bad) / drawn_bad)
    shared = spark.sparkContext.broadcast((scorer, posterior))  # half a megabyte of weights

    def score(batch):
        model, table_ = shared.value
        text = batch.column("text")
        measured = measures(text)
        believed = table_[pattern_of(measured)]
        mark = model.score(text, measured) if model is not None else believed
        words = np.diff(word_hashes(text)[1]) > 0
        mark = np.where(words, mark, 0.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(believed), pa.array(mark), pa.array(mark >= threshold)], ["doc_id", "posterior", "score", "keep"])

    return arrow_map(rows, score, "doc_id bigint, posterior double, score double, keep boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))

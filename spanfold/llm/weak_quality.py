"""Operator 2, quality classifier from weak labels.

Overlapping heuristic labellers vote good or bad on a text, or abstain. Their accuracies are not known:
expectation-maximisation over the counts of vote patterns of the whole corpus (2^labellers patterns at most, so
they fit the driver) estimates each labeller's accuracy and the share of good documents. The posterior of
a document's pattern is its soft label. A linear scorer over hashed byte trigrams and repeated words (relative frequencies,
BUCKETS weights) learns from the posteriors of a bounded sample, about SAMPLE documents taken by the hash of id and text, each once; it then
scores all texts. The threshold comes from all documents: it keeps KEEP_CONFIDENT of those whose posterior is at
least CONFIDENT, as far as 1/2 at most.

Defined cases: a null or empty text has no feature and scores by the bias alone; null ids and repeated rows are kept;
equal texts get equal values; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, lean, read_table, shared_dir, small_batches, stored, texts_of
from .quality_rules import FEATURES, text_stats

BUCKETS, SAMPLE, EM_STEPS, TRAIN_STEPS, RATE, SCALE = 1 << 16, 4000, 60, 80, 0.3, 20.0
CONFIDENT, KEEP_CONFIDENT = 0.9, 0.998
WINDOW = 1000
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(b"the of and to a in is that for it with as was on are by this be at from der die und das zu den mit von ist ein eine nicht auf le la les de des et un une du en est que pour dans el los las y del se por con para".split())
#: Votes bad where the value exceeds the bound, else abstains. Each kind of junk meets two labellers or more.
BAD = {"symbol_rate": 0.15, "symbol_words": 0.3, "bar_rate": 0.15, "letterless_words": 0.25, "upper_rate": 0.5, "exclaim_rate": 0.3, "repeat_rate": 0.35, "stutter_rate": 0.2, "copies_of_words": 0.65}
#: Votes good where the value reaches the bound, else abstains.
GOOD = {"function_words": 0.08, "plain_words": 0.8, "length": 50}
LABELLERS = (*BAD, *GOOD)
PATTERNS = 2 ** len(LABELLERS)
PLACES = {f: 5 + i for i, f in enumerate(FEATURES)}
SYMBOL_WORD, LETTER_WORD = re.compile(rb"[#*$%&<>]\S*"), re.compile(rb"[A-Za-z\x80-\xff]\S*")
PLAIN_WORD = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff]+[.,;:?]?(?!\S)")


def copies_of_words(words: list[bytes]) -> float:
    """Share of words that repeat an earlier one of their window; windows of WINDOW words cover the whole text, so its length does not count."""
    return 1 - sum(len(set(words[at : at + WINDOW])) for at in range(0, len(words), WINDOW)) / len(words)


def votes(text: str | None) -> int:
    """Which labellers vote, as bits in the order of LABELLERS; a text without words gets no votes."""
    stats = text_stats(text)
    n = stats[0]
    if not n:
        return 0
    raw = (text or "").encode()
    words = raw.lower().split()
    values = {f: stats[PLACES[f]] for f in BAD if f in PLACES}
    values["symbol_words"] = len(SYMBOL_WORD.findall(raw)) / n
    values["letterless_words"] = 1 - len(LETTER_WORD.findall(raw)) / n
    values["copies_of_words"] = copies_of_words(words)
    values["function_words"] = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    values["plain_words"] = len(PLAIN_WORD.findall(raw)) / n
    values["length"] = n
    cast = [values[f] > bound for f, bound in BAD.items()] + [values[f] >= bound for f, bound in GOOD.items()]
    return sum(1 << i for i, v in enumerate(cast) if v)


def voted(docs: DataFrame) -> DataFrame:
    ddl = "doc_id long, pattern int"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(t) for t in texts_of(batch)], pa.int32())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ddl)


#: +1 for labellers that vote good, -1 for those that vote bad.
SIDE = np.array([-1] * len(BAD) + [1] * len(GOOD))


def cast_votes(patterns: np.ndarray) -> np.ndarray:
    """Whether each labeller votes (patterns x labellers)."""
    return (np.asarray(patterns, np.int64)[:, None] >> np.arange(len(LABELLERS)) & 1).astype(bool)


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, vote rates [class, labeller], accuracy of each labeller's votes, prior of good).

    A labeller votes at one rate over bad documents and at another over good ones; its accuracy is the share of its
    votes that are right under the posterior.
    """
    rates, prior = np.where(SIDE > 0, [[0.3], [0.7]], [[0.3], [0.05]]), 0.5
    accuracy = np.full(len(LABELLERS), 0.5)
    if len(patterns):
        seen, weight = cast_votes(patterns), counts.astype(float)
        good = 1 / (1 + np.exp(-(seen * np.where(SIDE > 0, 1, -3)).sum(1)))  # start: the balance, bad votes thrice
        for _ in range(steps):
            rates = np.array([((weight * q) @ seen + 0.5) / ((weight * q).sum() + 1) for q in (1 - good, good)])
            prior = float(np.clip((weight * good).sum() / weight.sum(), 0.05, 0.95))
            good = posterior(seen, rates, prior)
        right = np.where(SIDE > 0, good[:, None], 1 - good[:, None])
        accuracy = ((weight[:, None] * seen * right).sum(0) + 0.5) / ((weight[:, None] * seen).sum(0) + 1)
    return posterior(cast_votes(np.arange(PATTERNS)), rates, prior), rates, accuracy, prior


def posterior(seen: np.ndarray, rates: np.ndarray, prior: float) -> np.ndarray:
    own = np.log(rates[1] / rates[0]) * seen + np.log((1 - rates[1]) / (1 - rates[0])) * ~seen
    return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + own.sum(1), -60, 60)))


def feature_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's byte trigrams; every byte of a word equal to the word before it counts in bucket 0."""
    raw = (text or "").encode()
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int32)
    words = raw.split()
    again = sum(len(w) for w, before in zip(words[1:], words) if w == before)
    grams = (((a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    return np.concatenate([grams, np.zeros(again, np.int32)])


def hashed(docs: DataFrame) -> DataFrame:
    """h, votes (pattern), buckets and shares (relative frequencies) of each row of docs."""
    ddl = "h long, pattern int, buckets array<int>, shares array<float>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in small_batches(batches, "text"):
            texts = texts_of(batch)
            found = [np.unique(feature_buckets(t), return_counts=True) for t in texts]
            columns = [batch.column(0), [votes(t) for t in texts], [b.tolist() for b, _ in found], [(n / max(1, n.sum())).tolist() for _, n in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("h", "text").mapInArrow(lean(run), ddl)


def train(rows) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer, by Adam on the soft labels."""
    w, b = np.zeros(BUCKETS), 0.0
    if not len(rows):
        return w, b
    sizes = rows["buckets"].map(len).to_numpy()
    at, share = np.concatenate([np.asarray(x, np.int64) for x in rows["buckets"]]), np.concatenate([np.asarray(x, float) for x in rows["shares"]]) * SCALE
    owner, y = np.repeat(np.arange(len(rows)), sizes), rows["posterior"].to_numpy(float)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, TRAIN_STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, share * w[at], len(rows)) + b, -60, 60)))
        d = weight * (p - y)
        g = np.append(np.bincount(at, share * d[owner], BUCKETS) + 1e-7 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def scored(docs: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    """doc_id, pattern and score of every row of docs."""
    ddl = "doc_id long, pattern int, score double"
    schema = arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast((w * SCALE).astype(np.float32))  # BUCKETS numbers

    def run(batches):
        weights = shared.value
        for batch in small_batches(batches, "text"):
            texts = texts_of(batch)
            logit = [float(weights[h].mean()) + b if len(h := feature_buckets(t)) else b for t in texts]
            columns = [batch.column(0), [votes(t) for t in texts], 1 / (1 + np.exp(-np.clip(logit, -60, 60)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ddl)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior, score, threshold and kept of every row of docs."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "weak")
    found = stored(voted(docs), folder, "votes")
    counts = found.groupBy("pattern").count().orderBy("pattern").toPandas()  # PATTERNS rows at most
    by_pattern, *_ = label_model(counts["pattern"].to_numpy(), counts["count"].to_numpy())
    table = spark.createDataFrame([(i, float(p)) for i, p in enumerate(by_pattern)], "pattern int, posterior double")
    total = int(counts["count"].sum())
    bound = int(min(1.0, SAMPLE / max(1, total)) * (1 << 31))
    text = F.col("text").cast("string")
    own = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), text.alias("text")).filter(F.pmod("h", F.lit(1 << 31)) < bound).dropDuplicates(["h"])
    rows = hashed(own).toPandas().sort_values("h")
    rows["posterior"] = by_pattern[rows["pattern"].to_numpy(np.int64)]
    w, b = train(rows)
    judged = stored(scored(docs, w, b).join(F.broadcast(table), "pattern"), folder, "scored")  # the table has PATTERNS rows
    bins = judged.filter(F.col("posterior") >= CONFIDENT).groupBy(F.floor(F.col("score") * 1000).alias("bin")).count().orderBy("bin").collect()
    left, threshold = (1 - KEEP_CONFIDENT) * sum(r["count"] for r in bins), 0.0
    for r in bins:
        left -= r["count"]
        if left < 0:
            threshold = min(0.5, r["bin"] / 1000)
            break
    return judged.select("doc_id", "posterior", "score", F.lit(threshold).alias("threshold"), (F.col("score") >= threshold).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"))

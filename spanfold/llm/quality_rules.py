"""Operator 10, quality rules: an isolation forest over rule statistics finds anomalous documents.

One pass over the texts computes the statistics (they are stored, 100 bytes a document); everything
after that reads only the statistics. The forest is fitted on a bounded sample, TREES x SUBSAMPLE rows
with the smallest hash of their id; its threshold comes from all labelled rows.

Defined cases: a null or empty text has no words and fails the base rules; null ids are kept as rows;
equal texts get equal statistics and the same verdict; an empty table gives an empty result; without
labelled rows the threshold is DEFAULT_THRESHOLD; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, lean, read_table, shared_dir, small_batches, stored, texts_of

TREES, SUBSAMPLE, SEED = 100, 256, 10
DEFAULT_THRESHOLD = 0.62
#: A good labelled document rejected weighs as much as this many bad ones let through.
CLEAN_WEIGHT = 8.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
#: Up to these values a feature counts as zero: ordinary prose of any length stays below them.
ORDINARY = np.array([0.02, 0.02, 0.15, 0.15, 0.05, 0.05])
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("symbol_rate", "bar_rate", "repeat_rate", "upper_rate", "exclaim_rate", "stutter_rate")
STATS = f"doc_id long, {COUNTS}, " + ", ".join(f"{f} float" for f in FEATURES)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a 3-word window that occurs twice or more; ids number the words by first occurrence."""
    if len(ids) < 4:
        return 0
    k = int(ids.max()) + 1
    pair = ids[:-1] * k + ids[1:]
    if k > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    keys = pair[:-1] * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple:
    """The five counts and the features of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0) + (0.0,) * len(FEATURES)
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    chars = len(text) - spaces
    counts = {c: text.count(c) for c in SYMBOLS}
    symbols = sum(counts.values())
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    upper = len(raw) - len(raw.translate(None, UPPER))
    stutter = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    return (n, chars, symbols, dup, repeats, (symbols - counts["|"]) / n, counts["|"] / n, repeats / n, upper / max(chars, 1), text.count("!") / n, stutter)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of every whole text."""
    schema = arrow_schema(STATS)

    def run(batches):
        for batch in small_batches(batches, "text"):
            rows = list(zip(*map(text_stats, texts_of(batch))))
            columns = [batch.column(0), *rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), STATS)


def base_failed():
    """The fixed rules: too few words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: feature (-1 at a leaf), cut, left child (the right one follows), depth at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.psi = max(2, min(subsample, len(rows)))
        self.limit = int(np.ceil(np.log2(self.psi)))
        self.trees = [self.grow(rows[rng.permutation(len(rows))[: self.psi]], rng) for _ in range(trees)] if len(rows) > 1 else []

    def grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            varying = np.flatnonzero(high > low)
            if level >= self.limit or len(part) < 2 or not len(varying):
                depth[at] = level + float(mean_path(len(part)))
                continue
            f = int(rng.choice(varying))
            c = float(rng.uniform(low[f], high[f]))
            go = part[:, f] <= c
            feature[at], cut[at], left[at] = f, c, len(feature)
            for side in (go, ~go):
                feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
            todo += [(left[at], part[go], level + 1), (left[at] + 1, part[~go], level + 1)]
            if not go.any() or go.all():
                todo = [(i, p, lv) if len(p) else (i, part[:1], self.limit) for i, p, lv in todo]
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the minus mean path over its expectation."""
        if not self.trees:
            return np.zeros(len(rows))
        total, index = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.limit):
                f = feature[at]
                inner = f >= 0
                step = left[at] + (rows[index, np.maximum(f, 0)] > cut[at])
                at = np.where(inner, step, at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(float(mean_path(self.psi)), 1e-9))


def beyond_ordinary(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.asarray(rows, float) - ORDINARY, 0.0)


def features_of(batch: pa.RecordBatch) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES]
    return beyond_ordinary(np.column_stack(cols)) if batch.num_rows else np.zeros((0, len(FEATURES)))


def fit_forest(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Fits on trees x subsample rows at most, taken by the hash of id and statistics; documents that fail the base rules take no part.
    Rows equal in all of these count once, so rows without an id, or with the same one, do not fill the sample.

    The hash bound comes from an estimate of how many such rows there are, so that tasks together send the driver little more than the sample.
    """
    passed, most = stats.filter(~base_failed()), trees * subsample
    h = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", *FEATURES), F.lit(1 << 31))
    share = min(1.0, 1.25 * most / max(1, passed.select(F.approx_count_distinct(h)).first()[0]))
    hashed = passed.select(h.alias("h"), "doc_id", *FEATURES).filter(F.col("h") < int(share * (1 << 31))).distinct()
    rows = hashed.orderBy("h", "doc_id").limit(most).toPandas()
    rows = rows.sort_values(["h", "doc_id", *FEATURES])
    return Forest(beyond_ordinary(rows[list(FEATURES)].to_numpy(float)), trees, subsample)


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    keep = [f for f in stats.columns]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double"
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # trees x 511 nodes at most

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(features_of(batch)), pa.float64())], names=[*keep, "anomaly"])

    return stats.mapInArrow(lean(run), ddl)


def calibrate(scored: DataFrame, labels: DataFrame | None, default: float = DEFAULT_THRESHOLD) -> float:
    """The cut (in thousandths) that rejects the most bad labelled documents, good ones weighed CLEAN_WEIGHT-fold, by rate."""
    if labels is None:
        return default
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = scored.filter(~base_failed()).select("doc_id", F.floor(F.col("anomaly") * 1000).alias("bin")).join(marks, "doc_id").groupBy("bin", "quality").count().collect()
    good, bad = np.zeros(1002), np.zeros(1002)
    for r in found:
        (good if r["quality"] else bad)[int(r["bin"])] += r["count"]
    if not good.sum() or not bad.sum():
        return default
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    return float(np.argmax(caught - CLEAN_WEIGHT * lost) / 1000)


def fitted(docs: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, Forest, float]:
    """(scored statistics, forest, threshold)."""
    stats = stored(rule_statistics(docs), shared_dir(docs.sparkSession, "rules"), "stats")
    forest = fit_forest(stats)
    scored = with_scores(stats, forest)
    return scored, forest, calibrate(scored, labels)


def accepted(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of docs that are kept, with their own columns; a second pass judges the texts, so that none is shuffled."""
    _, forest, threshold = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((forest, threshold))

    def run(batches):
        model, bound = shared.value
        for batch in small_batches(batches, "text"):
            stats = np.array([text_stats(t) for t in texts_of(batch)], float).reshape(-1, 5 + len(FEATURES))
            failed = (stats[:, 0] < MIN_WORDS) | (stats[:, 4] * 100 > stats[:, 0] * REPEAT_PERCENT)
            keep = ~failed & (model.score(beyond_ordinary(stats[:, 5:].astype(np.float32))) < bound)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def judge(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly, threshold and kept for every row of docs."""
    scored, _, threshold = fitted(docs, labels)
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return scored.select("doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") < threshold)).alias("kept"), "anomaly", F.lit(threshold).alias("threshold"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

"""Operator 7, language identification by multilingual mixture inference.

Learning counts hashed byte trigrams of every training text by language (one pass, per-task totals, one
small shuffle). A prediction treats a document's words as drawn from a mixture of languages: each word
has a likelihood under each language (the product over its trigrams), expectation-maximisation estimates
the proportions, and the language set grows while the likelihood gains more than the penalty
PENALTY x ln(words) for each language added.

The model holds BUCKETS floats a language, so its size is bound by the number of distinct languages and
not by the corpus; that is why it may be broadcast.

Defined cases: `und` with score 0 for a null text, one without a letter, or when nothing was learned;
ties go to the language first in code point order; null lang or null text teach nothing; a null id
counts as the empty text when rows are held out; equal texts get equal answers; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, held_out, lean, read_table, ship, small_batches, texts_of

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 2.0
EM_STEPS = 12
#: A stage keeps a document if one language holds at least this share of its words.
MIN_SHARE = 0.4
#: ASCII upper case to lower case; every other ASCII character that is no letter becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def has_letter(text: str) -> bool:
    """Whether any character is a letter (of Unicode's categories L; numerals and fractions are none)."""
    return any(map(str.isalpha, text))


def words_of(text: str) -> bytes:
    """Lower-case letters (and all bytes above ASCII) with one space around each word."""
    return b" " + b" ".join(text.lower().encode().translate(FOLD).split()) + b" "


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram."""
    a = raw.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def count_trigrams(training: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""
    ddl = "lang string, bucket int, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        totals: dict = {}
        for batch in small_batches(batches, "text"):
            by: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                by.setdefault(lang, []).append(words_of(text))
            for lang, parts in by.items():
                raw = np.frombuffer(b"".join(parts), np.uint8)
                if len(raw) > 2:
                    found = np.bincount(trigrams(raw), minlength=BUCKETS)
                    totals[lang] = totals[lang] + found if lang in totals else found
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], schema=schema)

    return training.select("lang", "text").mapInArrow(lean(run), ddl).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p  # log_p: buckets x languages, float32

    @classmethod
    def learn(cls, training: DataFrame) -> Model:
        """From rows of (lang, text), both non-null."""
        found = count_trigrams(training).toPandas()  # BUCKETS rows a language at most
        languages = sorted(found["lang"].unique().tolist(), key=lambda x: x.encode())
        counts = np.zeros((BUCKETS, len(languages)))
        for k, lang in enumerate(languages):
            part = found[found["lang"] == lang]
            counts[part["bucket"].to_numpy(), k] = part["n"].to_numpy()
        total = counts.sum(0, keepdims=True)
        return cls(languages, np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32))

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language with the largest proportion and that proportion, for each text."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        if not some:
            return names, scores
        raws = [words_of(texts[i]) for i in some]
        likely, starts = self.word_likelihoods(raws)
        shares = mixture(likely, starts)
        sizes = np.diff(np.append(starts, len(likely)))
        best = shares.argmax(1)
        share = (shares[np.arange(len(some)), best] * sizes + 1 / len(self.languages)) / (sizes + 1)
        for i, b, s in zip(some, best, share):
            names[i], scores[i] = self.languages[b], min(1.0, float(s))
        return names, scores

    def word_likelihoods(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ln p(word | language) for all words of all texts, and where each text's words start."""
        joined = np.frombuffer(b"".join(raws), np.uint8)
        lengths = np.array([len(r) for r in raws])
        ends = lengths.cumsum()
        if len(joined) < 3:
            joined = np.concatenate([joined, np.full(3, 32, np.uint8)])
        grams = self.log_p[trigrams(joined)]
        space = joined == 32
        # A word's trigrams begin at its leading space and end before its last letter's successor.
        heads = np.flatnonzero(space[:-1] & ~space[1:])
        if not len(heads):
            return np.zeros((len(raws), len(self.languages)), np.float32), np.arange(len(raws))
        tails = np.flatnonzero(~space[:-1] & space[1:])  # last letter of each word
        bounds = np.empty(2 * len(heads), np.int64)
        bounds[0::2], bounds[1::2] = heads, np.minimum(tails, len(grams) - 1)
        sums = np.add.reduceat(grams, bounds, axis=0)[0::2]
        counts = np.diff(np.append(np.searchsorted(heads, np.append(0, ends[:-1])), len(heads)))
        if (counts == 0).any():  # letters outside the folded alphabet: one neutral word stands for the text
            at = np.append(0, counts.cumsum()[:-1])
            sums = np.insert(sums, at[counts == 0], 0.0, axis=0)
            counts = np.maximum(counts, 1)
        return sums, np.append(0, counts.cumsum()[:-1])


def mixture(likely: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages); only the languages of each text's chosen set are above zero."""
    n, width = len(starts), likely.shape[1]
    sizes = np.diff(np.append(starts, len(likely)))
    single = np.add.reduceat(likely.astype(np.float64), starts, axis=0)
    first = single.argmax(1)
    chosen = np.zeros((n, width), bool)
    chosen[np.arange(n), first] = True
    shares, best = chosen.astype(np.float64), single[np.arange(n), first]
    top = likely.max(1, keepdims=True)
    p = np.exp(likely - top)
    base = np.add.reduceat(top[:, 0].astype(np.float64), starts)
    active = np.arange(n) if width > 1 else np.zeros(0, int)
    while len(active):
        # Candidate to add: the language that explains the most words better than the present set does.
        rows = np.isin(np.repeat(np.arange(n), sizes), active) if len(active) < n else np.ones(len(likely), bool)
        local = p[rows]
        size = sizes[active]
        at = np.append(0, size.cumsum()[:-1])
        inside = np.repeat(chosen[active], size, axis=0)
        now = np.where(inside, local, 0).max(1, keepdims=True)
        gain = np.add.reduceat(np.maximum(np.log(np.maximum(local, 1e-30)) - np.log(np.maximum(now, 1e-30)), 0), at, axis=0)
        gain[chosen[active]] = -1
        add = gain.argmax(1)
        worth = gain[np.arange(len(active)), add] > PENALTY * np.log(size + 1)  # an upper bound on what the set can gain
        if not worth.any():
            break
        keep = np.repeat(worth, size)
        active, add, size, local = active[worth], add[worth], size[worth], local[keep]
        at = np.append(0, size.cumsum()[:-1])
        wider = chosen[active].copy()
        wider[np.arange(len(active)), add] = True
        share = wider / wider.sum(1, keepdims=True)
        for _ in range(EM_STEPS):
            post = local * np.repeat(share, size, axis=0)
            whole = np.maximum(post.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(post / whole, at, axis=0) / size[:, None]
        whole = np.maximum((local * np.repeat(share, size, axis=0)).sum(1), 1e-300)
        found = np.add.reduceat(np.log(whole), at) + base[active]
        better = found > best[active] + PENALTY * np.log(size + 1)
        active, wider, share, found = active[better], wider[better], share[better], found[better]
        chosen[active], shares[active], best[active] = wider, share, found
        active = active[wider.sum(1) < width]
    return shares


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: not held out, with text and lang."""
    return docs.filter(~held_out(F.col("doc_id"), 4) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is an input of the prediction."""
    schema = arrow_schema(RESULT)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches):
        own = Model(*shared.value)
        for batch in small_batches(batches, "text", 2 << 20):
            names, scores = own.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 4).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), RESULT)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, of which one language holds MIN_SHARE of the words at least.

    Where no row names a language nothing can be learned, and a text needs a letter only.
    """
    ship(docs.sparkSession)
    model = Model.learn(training_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches):
        own = Model(*shared.value)
        for batch in small_batches(batches, "text", 2 << 20):
            texts = texts_of(batch)
            names, scores = own.predict(texts)
            if own.languages:
                keep = [n != "und" and s >= MIN_SHARE for n, s in zip(names, scores)]
            else:
                keep = [bool(t and has_letter(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return predict(docs, Model.learn(training_rows(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))

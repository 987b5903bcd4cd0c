"""Operator 13, license scan: an exact set-similarity join of text blocks with templates of license notices.

Words are runs of digits, letters (A-Z in lower case) and characters beyond ASCII. A text block is SPAN consecutive words, one
beginning every STEP words of the whole text (the last may be shorter), so a notice of up to SPAN - STEP + 1 words stands whole
in a block. A block meets a template if it holds at least THRESHOLD of the template's distinct words. Words that no template
has cannot count, so a block is the set of its template words.

The words are ordered by how often they occur in all documents, the rarest first. With `least` the number of words that a
template asks for, two sets that share so many share one among the first (size - least + 1) words of each: the prefix filter.
Blocks that hold no word of any template's prefix are dropped where they are cut. The others are joined with the templates on
the words of both prefixes; the join keeps what has words enough (length filter) and can still reach `least` with the words
from the shared one on (positional filter). What is left is counted out, exactly.

Templates are a table with a proven bound: more than MOST_TEMPLATES of them, or one that is longer than a block shows whole,
are refused. So their words and prefixes are small, whatever the documents are.

Base labels come from PHRASES, wherever their words stand one after the other; the join adds its own. The score is 1 with a base
label, else the largest share of a template's words that one block holds, if the template is met, else 0.

Defined cases: a null text counts as empty; a text without words has no labels and score 0; null ids and repeated rows are
kept; a long text is cut in pieces between words and its blocks run across them; without documents the result is empty; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, lean, read_table, shared_dir, small_batches, stored

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
SPAN, STEP, THRESHOLD = 32, 16, 0.85
MOST_TEMPLATES, PIECE_BYTES = 10_000, 1 << 20
#: Phrases of base labels, fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences that licenses and notices are told by; longer texts are cut into clauses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "The software is provided as is without warranty of any kind express or implied"),
    ("apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published"),
    ("agpl", "under the terms of the GNU Affero General Public License as published"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY SA 4.0"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Rows of documents (block -1) and of blocks, whose words are numbers in the order of their frequency.
SCANNED = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, block long, words array<int>"


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().lower())


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES that end where a word ends."""
    lo = 0
    while lo < len(raw):
        end = NO_WORD.search(raw, lo + PIECE_BYTES)
        hi = end.start() if end else len(raw)
        yield raw[lo:hi]
        lo = hi


class Templates:
    """Templates as sets of numbers of words; number 0 is the rarest word."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int] | None = None, threshold: float = THRESHOLD):
        if len(templates) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        texts = [words_of(text) for _, text in templates]
        if any(not 0 < len(t) <= SPAN - STEP + 1 for t in texts):
            raise ValueError(f"a template needs 1 to {SPAN - STEP + 1} words")
        counts = counts or {}
        phrase_words = {w for p in PHRASES for w in words_of(p)}
        order = sorted({w for t in texts for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.numbers = {w: k for k, w in enumerate(order)}
        self.known = len(order)  # words of phrases that no template has come after these
        self.numbers |= {w: self.known + k for k, w in enumerate(sorted(phrase_words - set(order)))}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.numbers[w] for w in t}) for t in texts]
        self.least = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefixes = [s[: len(s) - n + 1] for s, n in zip(self.sets, self.least)]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each template and word of its prefix: word, place of the word, template, label, least, words of the template."""
        rows = [(w, i, k, self.labels[k], self.least[k], self.sets[k]) for k, p in enumerate(self.prefixes) for i, w in enumerate(p)]
        return spark.createDataFrame(rows, "word int, place int, template int, label string, least int, own array<int>")


def frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How often each word of a template occurs in all documents; as many entries as the templates have words."""
    known, ddl = set(Templates(templates).numbers), "word binary, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        found: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text in batch.column(0).to_pylist():
                for piece in pieces(text.encode().lower()):
                    found.update(filter(known.__contains__, WORDS.findall(piece)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lean(run), ddl)
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def places_of(numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    n = len(numbers) - len(phrase) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    return np.flatnonzero(reduce(np.logical_and, [numbers[k : n + k] == w for k, w in enumerate(phrase)]))


def blocks_of(numbers: np.ndarray, known: int, telling: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(number, distinct template words in order) of the blocks that hold a telling word, those of a prefix."""
    at = np.flatnonzero((numbers >= 0) & telling[numbers])
    back = SPAN // STEP
    last = max(0, -(-(len(numbers) - SPAN) // STEP))  # the block that reaches the text's end
    for block in sorted({int(b) for k in range(back) for b in np.unique(at // STEP - k) if 0 <= b <= last}):
        own = numbers[block * STEP : block * STEP + SPAN]
        yield block, np.unique(own[(own >= 0) & (own < known)]).tolist()


def scanned(docs: DataFrame, templates: Templates) -> DataFrame:
    """SCANNED: a row for every document, and one for each of its blocks that can meet a template."""
    schema, numbers, known = arrow_schema(SCANNED), templates.numbers, templates.known
    phrases = [(label, [numbers[w] for w in words_of(p)]) for p, label in PHRASES.items()]
    telling = np.zeros(len(numbers) + 1, bool)  # the last stands for -1
    telling[[w for p in templates.prefixes for w in p]] = True

    def scan(text: str) -> tuple[tuple, list]:
        parts = [np.fromiter((numbers.get(w, -1) for w in WORDS.findall(p)), np.int32) for p in pieces(text.encode().lower())]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        places = [(label, places_of(at, phrase)) for label, phrase in phrases]
        every = np.concatenate([p for _, p in places])
        first, last = (int(every.min()), int(every.max())) if len(every) else (None, None)
        return (len(at), len(every), first, last, sorted({label for label, p in places if len(p)})), list(blocks_of(at, known, telling))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(2)]):
                row, n = task << 33 | n, n + 1
                told, blocks = scan(text)
                rows.append((row, doc_id, *told, -1, None))
                rows += [(row, None, None, None, None, None, None, block, words) for block, words in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(lean(run), SCANNED)


def met(blocks: DataFrame, templates: Templates) -> DataFrame:
    """row, block, template, label, share: every template that a block meets; blocks: row, block, words."""
    table, least = templates.table(blocks.sparkSession), min(templates.least)
    size = F.size("words")
    fits = blocks.filter(size >= least)
    begin = lambda words, asked: F.slice(words, F.lit(1), F.greatest(F.size(words) - asked + 1, F.lit(0)))
    prefix = fits.select("row", "block", "words", F.posexplode(begin("words", F.lit(least))).alias("i", "word"))
    reach = F.least(size - F.col("i"), F.size("own") - F.col("place"))  # the shared word and what follows it on both sides
    within = F.col("i") <= size - F.col("least")  # the template's own prefix of the block, the join's is the longest
    pairs = prefix.join(F.broadcast(table), "word").filter((size >= F.col("least")) & within & (reach >= F.col("least")))
    # Of the words that both prefixes share the first one stands for the pair, so a pair comes once.
    shared = F.array_intersect(begin("words", F.col("least")), begin("own", F.col("least")))
    pairs = pairs.filter(F.get(shared, F.lit(0)) == F.col("word"))
    overlap = F.size(F.array_intersect("words", "own"))
    return pairs.withColumn("overlap", overlap).filter("overlap >= least").select("row", "block", "template", "label", (F.col("overlap") / F.size("own")).alias("share"))


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(a row of every document, met blocks with their first word): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    folder = shared_dir(docs.sparkSession, "licenses")
    ordered = Templates(templates, frequencies(docs, templates))
    rows = stored(scanned(docs, ordered), folder, "scanned")
    found = stored(met(rows.filter("block >= 0").select("row", "block", "words"), ordered), folder, "met")
    told = found.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    whole = rows.filter("block < 0").join(told, "row", "left")
    labels = F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>")))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    out = whole.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))
    names = rows.filter("block < 0").select("row", "doc_id")
    return out, found.join(names, "row").select("doc_id", (F.col("block") * STEP).alias("word"), "template", "label", "share")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))[0]

"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words; a document is
toxic if any of its sentences is, so its score is their noisy-or, 1 - product(1 - p). The word
weights are learned from document labels alone, through the noisy-or, and so tell which sentences of
a document give offence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordbatch import LOWER, slices, span_hashes, text_bytes

#: about how many labelled documents the weights are fitted on
SAMPLE_DOCS = 8_000
#: words in fewer different sentences of the fitted documents have no weight
LEAST_SENTENCES = 3
#: nor have those whose share of toxic documents' sentences isn't this clearly higher (G statistic)
LEAST_G = 25.0
HOLD_OUT = 5
#: lengths in bytes of the word beginnings that are features beside whole words
HEADS = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


class Sentences:
    """Words (runs of letters and digits, A-Z as a-z) and their beginnings, by sentence of each text."""

    def __init__(self, column):
        data, self.at = text_bytes(column)
        self.data = data
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        inside = _LETTER[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        # features: each word, and the first bytes of longer ones, since insults take many endings
        low, heads = LOWER[data], [(start, end, np.arange(len(start)))]
        for k in HEADS:
            longer = np.flatnonzero(end - start > k)
            heads.append((start[longer], start[longer] + k, longer))
        self.word = np.concatenate([span_hashes(low, a, b) + np.uint64(i) for i, (a, b, _) in enumerate(heads)])
        owner = np.concatenate([h[2] for h in heads])
        # a sentence ends after . ! ? or a line feed, and at the end of a text
        cut = edge[:-1].copy()
        cut[1:] |= _STOP[data[:-1]]
        self.begin = np.flatnonzero(cut)
        place = np.searchsorted(self.begin, start, "right") - 1
        used, of_word = np.unique(place, return_inverse=True)
        self.of_word = of_word[owner]
        self.end = np.append(self.begin[1:], n)[used]
        self.begin = self.begin[used]
        self.doc = np.searchsorted(self.at, self.begin, "right") - 1
        self.n_docs = len(self.at) - 1


def fit(word: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.08, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights of words 0 .. max and the bias, by Adam on the log loss of the noisy-or.

    word and sentence: one entry per word; doc_of: the document of each sentence; label: of each document.
    """
    n_words, n_sentences, n_docs = int(word.max()) + 1 if len(word) else 0, len(doc_of), len(label)
    w, bias = np.zeros(n_words), -4.0
    moment, square = np.zeros(n_words + 1), np.zeros(n_words + 1)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)) ** 0.5
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sentence, w[word], n_sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs))
        some = np.maximum(1 - none, 1e-9)
        g = (weight * np.where(label == 1, -none / some, 1.0))[doc_of] * p / max(n_docs, 1)
        slope = np.append(np.bincount(word, g[sentence], n_words) + ridge * w / max(n_docs, 1), g.sum())
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def telling_words(index: np.ndarray, n_words: int, word: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words stand in toxic documents' sentences clearly more often than chance has it.

    A sentence that follows the same one in several documents counts once, so a passage that is
    copied is no evidence for all of its words.
    """
    content = np.zeros(len(toxic), np.uint64)
    np.add.at(content, sentence, word * np.uint64(0x9E3779B97F4A7C15))
    before = np.zeros(len(toxic), np.uint64)
    before[1:] = np.where(doc_of[1:] == doc_of[:-1], content[:-1], 0)
    _, once = np.unique(np.stack([content, before, toxic.astype(np.uint64)]), axis=1, return_index=True)
    first = np.zeros(len(toxic), bool)
    first[once] = True
    pair = np.unique(index[first[sentence]].astype(np.int64) * len(toxic) + sentence[first[sentence]])
    own, bad = pair // len(toxic), toxic[pair % len(toxic)]
    n, k = np.bincount(own, minlength=n_words), np.bincount(own, bad, n_words)
    share = max(toxic[first].mean(), 1e-9)

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))

    g = 2 * (part(k, n * share) + part(n - k, n * (1 - share)))
    return (n >= LEAST_SENTENCES) & (k > n * share) & (g >= LEAST_G)


class Scorer:
    """The learned words (sorted hashes), their weights, and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def sentences(self, s: Sentences) -> np.ndarray:
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, s.word), len(self.words) - 1)
            w = np.where(self.words[k] == s.word, self.weights[k], 0.0)
        else:
            w = np.zeros(len(s.word))
        z = np.clip(self.bias + np.bincount(s.of_word, w, len(s.begin)), -30, 30)
        return 1 / (1 + np.exp(-z))

    def documents(self, s: Sentences, p: np.ndarray) -> np.ndarray:
        return 1 - np.exp(np.bincount(s.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), s.n_docs))


def held_out(doc_id) -> object:
    """Whether a row is kept from learning: crc32 of doc_id as text divides by HOLD_OUT."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0


def fit_scorer(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Learn from about sample_docs labelled documents that are not held out.

    The rows are chosen by a hash of doc_id, so they are the same on every run; the bound holds at
    any size of the tables, and only these texts meet in the one task that fits. doc_ids that are
    labelled more than once are toxic if any label says so. Without both labels no word has a weight.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    share = min(1.0, sample_docs / max(n, 1))
    known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * (1 << 53)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, sentence, doc_of, label, at, docs_before = [], [], [], [], 0, 0
        for part in slices(batches):
            s = Sentences(part.column("text"))
            word.append(s.word)
            sentence.append(s.of_word + at)
            doc_of.append(s.doc + docs_before)
            label.append(part.column("toxic").to_numpy(zero_copy_only=False))
            at += len(s.begin)
            docs_before += s.n_docs
        names = ["word", "weight"]
        if not word or len(np.unique(y := np.concatenate(label))) < 2:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-4.0])], names)
            return
        word, sentence, doc_of = np.concatenate(word), np.concatenate(sentence), np.concatenate(doc_of)
        hashes, index = np.unique(word, return_inverse=True)
        often = telling_words(index, len(hashes), word, sentence, doc_of, y[doc_of] == 1)
        keep = often[index]
        index = (np.cumsum(often) - 1)[index[keep]]
        w, bias = fit(index, sentence[keep], doc_of, y.astype(int))
        hashes = hashes[often]
        used = w != 0 if len(w) == len(hashes) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array([*hashes[used].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(w[used], bias))], names)

    rows = texts.repartition(1).mapInArrow(run, "word bigint, weight double").collect()
    bias = next((r["weight"] for r in rows if r["word"] is None), -4.0)
    found = sorted((r["word"] & (1 << 64) - 1, r["weight"]) for r in rows if r["word"] is not None)
    return Scorer(np.array([h for h, _ in found], np.uint64), np.array([w for _, w in found], float), bias)


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every row of docs, with no shuffle.

    score is the noisy-or of the sentences' scores (0 for a text without words, also a null one);
    offending lists start and end (code points) and score of each sentence of 0.5 or more. Only the
    text is read for a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = "doc_id bigint, held_out boolean, score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = Sentences(part.column("text"))
            p = sent.value.sentences(s)
            score = np.clip(sent.value.documents(s, p), 0.0, 1.0)
            bad = np.flatnonzero(p >= 0.5)
            chars = np.append(0, np.cumsum((s.data & 0xC0) != 0x80))
            base = chars[s.at[s.doc[bad]]]
            spans = pa.StructArray.from_arrays([pa.array(chars[s.begin[bad]] - base), pa.array(chars[s.end[bad]] - base), pa.array(p[bad])], ["start", "end", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s.doc[bad], np.arange(s.n_docs + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), lists], ["doc_id", "held_out", "score", "predicted", "offending"])

    ids = F.col("doc_id").cast("bigint")
    return docs.select(ids.alias("doc_id"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)

"""Toxicity by multiple-instance learning.

Only documents are labelled, yet single sentences offend. A sentence's probability is logistic in its features; a
document's is the noisy-or of its sentences' and of a leak, the rate at which documents without any feature are
labelled. Training fits the weights to document labels through the noisy-or; the sentences' probabilities then say
where a document offends. Texts are lower-cased as a whole before they are cut in sentences.

Features are words and their character n-grams with word bounds. Those kept occur in several toxic documents and
several times as often there as elsewhere. Counts, leak and weights are of all labelled documents that are not held out.
They are staged once; one pass over the toxic ones counts features, one over the others those still open, and a third
keeps, of each document, only the numbers of its sentences' features. Documents equal in these become one with a count,
and each epoch of the fit is one sum over them, in tasks. Sums are of integers, so their order changes nothing. Scoring is
a narrow pass over whole texts.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, mapped

THRESHOLD = 0.3
LENGTHS = (3, 4, 5, 6, 7)
LEAST_DOCS, LEAST_SHARE, LEAST_LIFT, LEAST_Z = 3, 0.01, 3.0, 5.0
EPOCHS, RATE, DECAY = 150, 0.05, 1e-2
MOST_CACHED = 150_000
#: What a task holds while it counts: words with all of their features, and features before their counts go out.
MOST_WORDS, MOST_COUNTED = 10_000, 200_000
#: Entries of features in sentences that a task of the fit takes at least, and bits after the point of a slope at most.
ENTRIES, MOST_BITS = 500_000, 40

WORD = re.compile(r"[^\W\d_]+")
BETWEEN = re.compile(r"[.!?\n]+")


def sentences(text: str) -> list[str]:
    """The stretches between full stops, exclamation and question marks and line feeds that are not blank."""
    return [s for s in BETWEEN.split(text) if not s.isspace() and s]


def words(sentence: str) -> set[str]:
    """The distinct words of a sentence in lower case."""
    return set(WORD.findall(sentence))


def features(word: str) -> set[str]:
    """The n-grams of a bounded word, and the word itself between two bounds."""
    x = f"^{word}$"
    return {x} | {x[i : i + n] for n in LENGTHS for i in range(len(x) - n + 1)}


@dataclass
class Model:
    """Weights by feature, the bias of a sentence that has a feature, and the leak of a document."""

    weights: dict[str, float]
    bias: float
    leak: float
    #: Scores of words met, the words among them that have none, and what finds features in words.
    scores: dict = field(default_factory=dict, repr=False, compare=False)
    plain: set = field(default_factory=set, repr=False, compare=False)
    finder: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        """What goes to workers: the model without what it has met."""
        return {"weights": self.weights, "bias": self.bias, "leak": self.leak, "scores": {}, "plain": set(), "finder": None}

    def word_score(self, word: str) -> float | None:
        """The sum of a word's weights, or None if no feature of it is known."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return math.fsum(found) if found else None

    def meet(self, new: list[str]) -> None:
        """Sorts words in those with a score and the others; one pass of an automaton over all of them finds the former."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for f in self.weights:
                self.finder.add_word(f, len(f))
            self.finder.make_automaton()
        if len(self.plain) > MOST_CACHED:
            self.plain.clear()
        if len(self.scores) > MOST_CACHED:
            self.scores.clear()
        ends = [end for end, _ in self.finder.iter(f"^{'$^'.join(new)}$")] if self.weights else []
        starts = np.cumsum([0] + [len(w) + 2 for w in new])
        marked = {new[k] for k in np.unique(np.searchsorted(starts, ends, side="right") - 1)}
        scored_ = {w: s for w in marked if (s := self.word_score(w)) is not None}
        self.scores |= scored_
        self.plain.update(set(new).difference(scored_))

    def known(self, own: set[str]) -> list[float]:
        """The scores of the words that have one; each new word is looked up once."""
        open_ = own.difference(self.plain)
        if new := [w for w in open_ if w not in self.scores]:
            self.meet(new)
            open_ = [w for w in open_ if w in self.scores]
        return [self.scores[w] for w in open_]

    def sentence_probability(self, sentence: str) -> float:
        """The probability of a sentence in lower case."""
        own = self.known(words(sentence))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(own))))) if own else 0.0

    def score(self, text: str | None) -> float:
        """The noisy-or of the leak and of the sentences, of which only those with a known word count."""
        low, clean = (text or "").lower(), 1 - self.leak
        if self.known(words(low)):
            for s in BETWEEN.split(low):
                if p := self.sentence_probability(s):
                    clean *= 1 - p
        return 1 - clean

    def offending(self, text: str | None, least: float = THRESHOLD) -> list[tuple[int, float, str]]:
        """(number, probability, sentence) of the sentences whose own probability is at least `least`."""
        text = text or ""
        if least > 0 and not self.known(words(text.lower())):  # as in score(): none of its sentences has a known word
            return []
        each = ((i, self.sentence_probability(low), s.strip()) for i, (s, low) in enumerate(zip(sentences(text), sentences(text.lower()))))
        return [x for x in each if x[1] >= least]


class Numbers:
    """The numbers of the features of words; an automaton looks all words of a text up that were not met yet."""

    def __init__(self, number: dict[str, int]):
        self.finder, self.n = ahocorasick.Automaton(), len(number)
        for f, i in number.items():
            self.finder.add_word(f, i)
        self.finder.make_automaton()
        self.own: dict[str, np.ndarray | None] = {}

    def meet(self, new: list[str]) -> None:
        if len(self.own) > MOST_CACHED:
            self.own.clear()
        self.own.update(dict.fromkeys(new))
        found = np.fromiter(chain.from_iterable(self.finder.iter(f"^{'$^'.join(new)}$")), np.int64).reshape(-1, 2)
        starts = np.cumsum([0] + [len(w) + 2 for w in new])
        key = np.sort((np.searchsorted(starts, found[:, 0], side="right") - 1) * self.n + found[:, 1])
        key = key[np.diff(key, prepend=-1) > 0]
        number, a = (key % self.n).astype(np.int32), 0
        for w, b in zip(new, np.searchsorted(key, np.arange(1, len(new) + 1) * self.n).tolist()):
            if a < b:
                self.own[w] = number[a:b]
            a = b

    def of(self, met: set[str]) -> list[np.ndarray]:
        """The numbers of each word that has any; a word has each of its features once."""
        if new := met.difference(self.own):
            self.meet(list(new if len(self.own) <= MOST_CACHED else met))
        return [x for w in met if (x := self.own[w]) is not None]


def counted(toxic: DataFrame) -> DataFrame:
    """feature, n: in how many of the texts each feature occurs."""

    def counts(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"feature": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = lru_cache(MOST_WORDS)(features), Counter()
        for batch in batches:
            for t in batch.column("text"):
                seen.update(set().union(*map(own, words((t.as_py() or "").lower()))))
                if len(seen) > MOST_COUNTED:
                    yield counts(seen)
                    seen.clear()
        yield counts(seen)

    return mapped(toxic.select("text"), task, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def counted_of(texts: DataFrame, candidates: dict[str, int]) -> np.ndarray:
    """In how many of the texts each candidate occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Numbers(candidates), np.zeros(len(candidates), np.int64)
        last = np.zeros(len(candidates), np.int32)
        for batch in batches:
            for t in batch.column("text"):
                if found := own.of(words((t.as_py() or "").lower())):
                    each = np.concatenate(found)
                    place = np.arange(len(each), dtype=np.int32)
                    last[each] = place
                    n[each[last[each] == place]] += 1  # each feature where it stands last
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"number": some, "n": n[some]})

    out = np.zeros(len(candidates), np.int64)
    for r in mapped(texts.select("text"), task, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.number] = r.n
    return out


def select_features(rows: DataFrame, n1: int, n0: int) -> dict[str, int]:
    """Numbers for the features that mark toxic documents, by the n1 toxic and n0 other documents that have them.

    A candidate is in a hundredth of the toxic documents or more, so there are at most a hundred times as many as
    features of a toxic document; these alone come to the driver.
    """
    if not n1 or not n0:
        return {}
    own = counted(rows.where(F.col("toxic") != 0))
    toxic = {r.feature: r.n for r in own.where(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n1)).toLocalIterator()}
    candidates = {f: i for i, f in enumerate(sorted(toxic))}
    clean = counted_of(rows.where(F.col("toxic") == 0), candidates).tolist() if candidates else []
    out = {}
    for f, i in candidates.items():
        a, c = toxic[f], clean[i]
        lift = (a + 0.1) / (n1 + 0.2) * (n0 + 0.2) / (c + 0.1)
        z = (a / n1 - c / n0) / math.sqrt((a + c + 1) / (n1 + n0) / n1)
        if lift > LEAST_LIFT and z > LEAST_Z:
            out[f] = len(out)
    return out


def patterns(rows: DataFrame, number: dict[str, int]) -> DataFrame:
    """toxic, sizes, features, times: the documents by the features of their sentences.

    `features` has those of one sentence after the other, `sizes` how many each has, and `times` is the number of such
    documents. Sentences without a kept feature have probability 0 and drop out, and so do documents without others.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Numbers(number)
        for batch in batches:
            toxic, sizes, found = [], [], []
            for t, y in zip(batch.column("text"), batch.column("toxic")):
                low = (t.as_py() or "").lower()
                if own.of(words(low)):
                    each = sorted(np.sort(np.concatenate(x)).tolist() for s in BETWEEN.split(low) if (x := own.of(words(s))))
                    toxic.append(int(y.as_py() != 0))
                    sizes.append([len(x) for x in each])
                    found.append([i for x in each for i in x])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "sizes": pa.array(sizes, ints), "features": pa.array(found, ints)})

    return mapped(rows.select("text", "toxic"), task, "toxic int, sizes array<int>, features array<int>").groupBy("toxic", "sizes", "features").agg(F.count("*").alias("times"))


@dataclass
class Block:
    """Some patterns: `toxic` and `times` of each, the `doc` of each sentence, `sentence` and `feature` of each entry."""

    toxic: np.ndarray
    times: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray
    #: The sentences of all entries by feature, the features there are, and where each one begins.
    by_feature: np.ndarray
    present: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        sizes, feature = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("sizes", "features"))
        doc = np.repeat(np.arange(len(batch), dtype=np.int32), batch.column("sizes").value_lengths().to_numpy(zero_copy_only=False))
        sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(feature, kind="stable")
        present, starts = np.unique(feature[order], return_index=True)
        toxic, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "times"))
        return cls(toxic == 1, times.copy(), doc, sentence, feature.copy(), sentence[order], present, starts)

    def slopes(self, theta: np.ndarray, leak: float, bits: int) -> np.ndarray:
        """The slopes of the negative log-likelihood along each weight and the bias, as sums of integers of 1 / 2**bits."""
        z = np.clip(theta[-1] + np.bincount(self.sentence, theta[self.feature], minlength=len(self.doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = (1 - leak) * np.exp(np.bincount(self.doc, -np.logaddexp(0, z), minlength=len(self.toxic)))
        dirty = np.maximum(1 - clean, 1e-9)
        slope = np.where(self.toxic[self.doc], -(clean / dirty)[self.doc] * p, p)
        whole = np.rint(slope * 2.0**bits).astype(np.int64) * self.times[self.doc]
        out = np.zeros(len(theta), np.int64)
        out[self.present] = np.add.reduceat(whole[self.by_feature], self.starts)
        out[-1] = whole.sum()
        return out


def descend(slopes: Callable[[np.ndarray], np.ndarray], n_features: int, n_docs: int, bits: int) -> np.ndarray:
    """Weights and bias of least mean negative log-likelihood, with a small decay of the weights."""
    theta = np.append(np.zeros(n_features), -3.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        grad = slopes(theta) / 2.0**bits / n_docs + DECAY / n_docs * np.append(theta[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def fit(rows: DataFrame, work: Workspace) -> Model:
    """The model of doc_id, text and toxic. Only counts, candidates and sums of slopes come to the driver.

    Patterns of few entries are one task's, through all epochs; others are kept by the executors from epoch to epoch.
    """
    n, n1 = rows.agg(F.count("*"), F.count_if(F.col("toxic") != 0)).first()
    number = select_features(rows, n1, n - n1)
    own = work.stage(patterns(rows, number), "patterns") if number else None
    size = F.size("features")
    entries, weighted, with_any, toxic_any = own.agg(F.sum(size), F.sum(size * F.col("times")), F.sum("times"), F.sum(F.col("toxic") * F.col("times"))).first() if number else (0, 0, 0, 0)
    leak = min(0.25, (n1 - toxic_any + 0.5) / (n - with_any + 1)) if n else 0.0
    if not number:
        return Model({}, 0.0, leak)
    bits, n_features = min(MOST_BITS, 62 - weighted.bit_length()), len(number)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(Block.of(batch))], pa.binary())})

    def total(blocks: Iterable[Block], theta: np.ndarray) -> np.ndarray:
        return sum((b.slopes(theta, leak, bits) for b in blocks), np.zeros(n_features + 1, np.int64))

    def alone(packed: Iterator[bytes]) -> Iterator[np.ndarray]:
        blocks = [pickle.loads(b) for b in packed]
        yield descend(lambda theta: total(blocks, theta), n_features, n, bits)

    blocks = mapped(own, pack, "block binary").rdd.map(lambda r: bytes(r.block)).coalesce(1 + entries // ENTRIES)
    if entries < ENTRIES:
        theta = blocks.mapPartitions(alone).first()
    else:
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        theta = descend(lambda theta: blocks.mapPartitions(lambda packed: [total(map(pickle.loads, packed), theta)]).reduce(np.add), n_features, n, bits)
        blocks.unpersist()
    return Model({f: float(theta[i]) for f, i in number.items()}, float(theta[-1]), float(leak))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id counts as such."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, work: Workspace, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, toxic of all labelled documents that are not held out, staged.

    Of rows with one doc_id one is taken, the one whose text has the least hash. A caller may ask for a sample of about
    `most` documents, or of about `most_bytes` of text, drawn by a hash of doc_id; no query does.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if most is not None and (n := own.count()) > most:
        own = own.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(own, "doc_id")
    rows = work.stage(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")), "training", compression="zstd")
    if most_bytes is None:
        return rows
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return rows if size <= most_bytes else rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("bytes")), F.lit(1_000_000)) < int(1_000_000 * most_bytes / size))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled documents that are not held out."""
    work = Workspace(documents.sparkSession, "toxicity")
    model = fit(training_rows(documents, labels, work), work)
    work.clear()
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score; whole texts in a narrow pass."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t.as_py()) for t in batch.column("text")]
            yield batch.set_column(batch.num_columns - 1, "__score", pa.array(got, pa.float64()))

    given = documents.withColumn("__score", F.lit(0.0).cast("double"))
    return mapped(given, score, given.schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents.

    Null and empty texts score the leak; repeated rows score alike; without labels, or with labels of one kind, no
    feature is kept and every document scores the leak; an empty table gives no rows; further columns are ignored.
    """
    model = train(documents, labels)
    rows = scored(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, in all their columns, that are not predicted toxic.

    Null and empty texts, repeated rows, missing labels and empty tables are as in toxicity(): clean texts stay.
    """
    rows = scored(documents, train(documents, labels))
    return rows.where(F.col("__score") < threshold).drop("__score")


def offending_sentences(documents: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """doc_id, number, probability, sentence of every sentence that offends by itself.

    Null and empty texts have none; repeated rows, and rows without doc_id, give their sentences each; a very long text
    is read whole; an empty table gives no rows; further columns are ignored.
    """
    kind = "doc_id long, number int, probability double, sentence string"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("doc_id", pa.int64()), ("number", pa.int32()), ("probability", pa.float64()), ("sentence", pa.string())])
        for batch in batches:
            rows = [(d.as_py(), *x) for d, t in zip(batch.column("doc_id"), batch.column("text")) for x in model.offending(t.as_py(), least)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((), (), (), ()), fields)], schema=fields)

    return mapped(documents.select("doc_id", "text"), locate, kind)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5b_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents offend: each sentence that is toxic by itself."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return offending_sentences(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_toxicity": op5_toxicity, "op5b_sentences": op5b_sentences}
ORACLE_SQL: dict[str, str] = {}

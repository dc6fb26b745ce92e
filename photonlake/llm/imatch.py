"""I-Match fingerprints over randomised lexicon subsets, held against an edited text and against the next document.

The lexicon are the terms in a band of inverse document frequency. Its rare end is where a term has a millionth of all
postings (pairs of a document and a term of it): at most a million terms can lie above that, whatever the corpus, so the
lexicon is broadcast as at most 8 MB of hashes. Its frequent end is a share of documents.

A fingerprint hashes a document's sorted distinct terms of SUBSETS random lexicon subsets at two rates. The rates follow
the number of terms, so that a subset has about one or half a term of the document: such a hash survives an edit with
about the share of terms that the edit leaves. Two fingerprints are compared by the share of equal hashes. Documents of
which little is in the lexicon (of common or repeated words, or of very many copies) are compared by all their words: a
second fingerprint hashes these with their number, the third "so" of a text being another term than its first, and in
short texts the pairs of neighbouring characters too.

Documents have to stand in order to know the next one. They are dealt into pieces between sampled documents; the first
document of a piece also goes to the end of the piece before, so one shuffle of the texts is enough.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, Workspace, ascii_lower, mapped

#: The most terms that a lexicon can have, and the largest share of documents that hold one of them.
LEXICON, MOST_SHARE = 1_000_000, 0.02
#: Where a text's terms in the lexicon are fewer than this share of its words, texts are compared by all their words.
LEAST_SHARE = 0.2
#: Texts of fewer code points have their pairs of characters among their words.
SHORT = 64
SUBSETS = 24
#: Text bytes of a piece, the most pieces, and sampled documents a piece, whose keys come to the driver.
PIECE_BYTES, MOST_PIECES, SAMPLED = 8 << 20, 50_000, 10
NOT_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Odd multipliers of the hashes of terms.
SEEDS = np.random.default_rng(12).integers(1 << 62, 1 << 63, SUBSETS, dtype=np.uint64) | np.uint64(1)
#: What tells the occurrences of a term apart, an odd number.
REPEAT = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 16
LIKENESS = np.linspace(0.0, 1.0, 41)


def terms_of(text: Column) -> Column:
    """64-bit hashes of a text's terms, repeats included: lower-cased runs of letters, digits and non-ASCII."""
    words = F.array_remove(F.split(ascii_lower(text), NOT_TERMS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def hashed(text: Column) -> Column:
    """The sorted hashes of a text's terms, repeats included, and in short texts of its pairs of characters."""
    n, lower = F.char_length(text), ascii_lower(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.xxhash64(F.lit("pair"), F.substr(lower, k, F.lit(2))))
    return F.sort_array(F.when((n > 1) & (n < SHORT), F.concat(terms_of(text), pairs)).otherwise(terms_of(text)))


def lexicon(documents: DataFrame, most: int = LEXICON, share: float = MOST_SHARE) -> np.ndarray:
    """The sorted hashes of the terms that at least two documents, a most-th of the postings and at most share of the
    documents have. No more than most terms can have a most-th of the postings each."""
    work = Workspace(documents.sparkSession, "lexicon")
    terms = F.array_distinct(terms_of(F.coalesce(documents["text"], F.lit(""))))
    counted = work.stage(documents.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    postings, n = counted.agg(F.sum("n")).first()[0] or 0, documents.count()
    chosen = counted.where((F.col("n") >= max(2, -(-postings // most))) & (F.col("n") <= share * n)).select("term")
    hashes = np.sort(chosen.toArrow().column(0).to_numpy())
    work.clear()
    return hashes


class Fingerprints:
    """Fingerprints of a batch of documents: the number of terms, the rate's power of two, and hashes, 0 for no term."""

    def __init__(self, sizes: np.ndarray, powers: np.ndarray, hashes: np.ndarray):
        self.sizes, self.powers, self.hashes = sizes, powers, hashes

    @classmethod
    def of(cls, terms: np.ndarray, owners: np.ndarray, n: int) -> Fingerprints:
        """terms: the distinct terms of n documents after each other; owners: whose they are."""
        terms, sizes = terms.view(np.uint64), np.bincount(owners, minlength=n)
        powers = np.rint(np.log2(sizes.clip(1))).astype(np.int64)
        low = (np.uint64(1) << powers.astype(np.uint64)) - np.uint64(1)
        sums = np.zeros((2, SUBSETS, n), np.uint64)
        met = np.zeros((2, SUBSETS, n), bool)
        for start in range(0, len(terms), CHUNK):
            own, at = terms[start : start + CHUNK], owners[start : start + CHUNK]
            mask = low[at]
            wider = mask * np.uint64(2) + np.uint64(1)
            for k, seed in enumerate(SEEDS):
                mixed = (own ^ seed) * seed
                mixed ^= mixed >> np.uint64(29)
                chosen = np.flatnonzero((mixed & mask) == 0)
                some, whose = mixed[chosen], at[chosen]
                add = (some ^ (some >> np.uint64(32))) * SEEDS[0]
                for scale, inside in ((0, slice(None)), (1, (some & wider[chosen]) == 0)):
                    np.add.at(sums[scale, k], whose[inside], add[inside])
                    met[scale, k, whose[inside]] = True
        hashes = np.where(met, (sums >> np.uint64(40)) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)
        return cls(sizes, powers, np.moveaxis(hashes, 2, 0).copy())

    def __getitem__(self, rows) -> Fingerprints:
        return Fingerprints(self.sizes[rows], self.powers[rows], self.hashes[rows])

    def joined(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(*(np.concatenate([a, b]) for a, b in ((self.sizes, other.sizes), (self.powers, other.powers), (self.hashes, other.hashes))))

    def texts(self) -> list[str]:
        """The number of terms, the power and the hashes, in hexadecimal."""
        data = self.hashes.astype(">u2").reshape(len(self.sizes), -1)
        return [f"{n:x}-{p:x}-{h.tobytes().hex()}" for n, p, h in zip(self.sizes.tolist(), self.powers.tolist(), data, strict=True)]

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """For each pair of rows the share of terms in common, 2 * |both| / (|one| + |other|), as the hashes tell it.

        At rate r a subset has the same terms, and some, with probability (1 - r) ** |only one| * (1 - (1 - r) ** |both|),
        so the share of equal hashes among those that either has grows with the terms in common; that relation is
        inverted. Fingerprints without a rate in common are of sizes too different to be alike. Equal ones have 1.
        """
        n = len(self.sizes)
        equal, either, expected, possible = np.zeros(n), np.zeros(n), np.zeros((n, len(LIKENESS))), np.zeros((n, len(LIKENESS)))
        total = (self.sizes + other.sizes)[:, None]
        both = LIKENESS * total / 2
        for mine in (0, 1):
            for its in (0, 1):
                same = self.powers + mine == other.powers + its
                a, b = self.hashes[:, mine], other.hashes[:, its]
                equal += same * ((a == b) & (a != 0)).sum(axis=1)
                either += same * ((a != 0) | (b != 0)).sum(axis=1)
                miss = (1 - 0.5 ** (self.powers + mine))[:, None]
                expected += same[:, None] * miss ** (total - 2 * both) * (1 - miss**both)
                possible += same[:, None] * (1 - miss ** (total - both))
        whole = (self.hashes == other.hashes).all(axis=(1, 2)) & (self.sizes == other.sizes)
        out = np.array([np.interp(e / max(n, 1), c / p.clip(1e-12), LIKENESS) for e, n, c, p in zip(equal, either, expected, possible, strict=True)])
        return np.where(whole, 1.0, np.where(equal > 0, out, 0.0))


class Pairs:
    """Each text's fingerprint of its terms in the lexicon, and that of all its words for where few are in it."""

    def __init__(self, known: Fingerprints, whole: Fingerprints):
        self.known, self.whole = known, whole

    @classmethod
    def of(cls, column: pa.ListArray, words: np.ndarray) -> Pairs:
        """column: the sorted terms of each text, repeats included; words: the sorted lexicon."""
        terms, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
        owners = np.repeat(np.arange(len(lengths)), lengths)
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (owners[1:] != owners[:-1])
        starts = np.flatnonzero(first)
        repeat = (np.arange(len(terms)) - np.repeat(starts, np.diff(starts, append=len(terms)))).astype(np.uint64)
        known = starts[words[np.searchsorted(words, terms[starts]).clip(max=len(words) - 1)] == terms[starts]] if len(words) else starts[:0]
        numbered = terms.view(np.uint64) + repeat * REPEAT
        return cls(Fingerprints.of(terms[known], owners[known], len(lengths)), Fingerprints.of(numbered, owners, len(lengths)))

    def __getitem__(self, rows) -> Pairs:
        return Pairs(self.known[rows], self.whole[rows])

    def joined(self, other: Pairs) -> Pairs:
        return Pairs(self.known.joined(other.known), self.whole.joined(other.whole))

    def texts(self) -> list[str]:
        return [f"{a}.{b}" for a, b in zip(self.known.texts(), self.whole.texts(), strict=True)]

    def likeness(self, other: Pairs) -> np.ndarray:
        enough = [p.known.sizes >= np.maximum(LEAST_SHARE * p.whole.sizes, 1) for p in (self, other)]
        equal = self.whole.likeness(other.whole)
        rated = abs(self.known.powers - other.known.powers) <= 1
        return np.where(enough[0] & enough[1] & rated & (equal < 1), self.known.likeness(other.known), equal)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, a hash of the text and the place of the row: a total order, null doc_ids first."""
    return documents.select(documents["doc_id"], F.coalesce(documents["text"], F.lit("")).alias("text"), F.xxhash64(documents["text"]).alias("mark"), F.monotonically_increasing_id().alias("row"))


def _key(doc_id, mark, row) -> tuple:
    return (doc_id is not None, 0 if doc_id is None else doc_id, mark, row)


def with_next(documents: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, text, next_text, piece, last, mark and row; each document once, beside the text that follows it.

    Rows stand in order of doc_id (null first), a hash of the text and their place; after the last comes the first. Each
    piece of that order is in one partition, in order, and ends with a row whose last is true: the next piece's first
    document, for those who need more of it than its text.
    """
    spark, rows = documents.sparkSession, _keyed(documents)
    n, size, first = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long")), F.min(F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast(dict(rows.dtypes)["doc_id"])), "mark", "row"))).first()
    pieces = min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // piece_bytes)), MOST_PIECES)
    sampled = rows.where(F.pmod(F.xxhash64("doc_id", "mark", "row"), F.lit(max(1, n // (SAMPLED * pieces)))) == 0).select("doc_id", "mark", "row") if n else rows.limit(0).select("doc_id", "mark", "row")
    keys = sorted(_key(*r) for r in sampled.collect())
    splits = sorted({keys[len(keys) * k // pieces] for k in range(1, pieces)} - {tuple(first)}) if keys else []
    starts = spark.sparkContext.broadcast((splits, tuple(first) if n else None))

    def placed(batches: Batches) -> Batches:
        splits, first = starts.value
        begins = {s: k for k, s in enumerate(splits)} | {first: len(splits)}  # the piece before
        for batch in batches:
            own = [_key(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "row")), strict=True)]
            again = [k for k, x in enumerate(own) if x in begins]
            pieces = [bisect_right(splits, x) for x in own] + [begins[own[k]] for k in again]
            batch = batch.take(pa.array([*range(len(own)), *again], pa.int64()))
            yield batch.append_column("piece", pa.array(pieces, pa.int32())).append_column("last", pa.array([False] * len(own) + [True] * len(again)))

    kinds = dict(rows.dtypes)
    dealt = mapped(rows, placed, f"doc_id {kinds['doc_id']}, text string, mark long, row long, piece int, last boolean").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "piece")
    order = Window.partitionBy("piece").orderBy("last", F.col("doc_id").asc_nulls_first(), "mark", "row")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """The text with its last quarter of code points replaced by as many of the next text's first, or all."""
    quarter = f"CAST(char_length({text}) DIV 4 AS INT)"
    return F.expr(f"concat(left({text}, char_length({text}) - {quarter}), left({next_text}, {quarter}))")


def fingerprints(documents: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    Null text is empty; texts without terms have one fingerprint, and are alike; a very long text is fingerprinted
    whole; equal texts have equal fingerprints. Of rows with one doc_id the next is told by a hash of the text, and
    equal rows follow each other. Null doc_ids come first; a lone document is its own next one; an empty table gives no
    rows; further columns are ignored.
    """
    spark = documents.sparkSession
    words = spark.sparkContext.broadcast(lexicon(documents))
    rows = with_next(documents, piece_bytes).withColumn("edited", edited())
    rows = rows.select("doc_id", "piece", "last", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), hashed(F.col("text")).alias("terms"), hashed(F.coalesce("edited", F.lit(""))).alias("edited_terms"))

    def compared(batches: Batches) -> Batches:
        held: tuple[pa.RecordBatch, Pairs, Pairs] | None = None
        for batch in batches:
            if not len(batch):
                continue
            mine, its = (Pairs.of(c, words.value) for c in (batch.column("terms"), batch.column("edited_terms")))
            batch = batch.select(["doc_id", "last", "n_chars", "edited_sha256"])
            if held:
                batch = pa.concat_batches([held[0], batch])
                mine, its = held[1].joined(mine), held[2].joined(its)
            held = (batch.slice(len(batch) - 1), mine[-1:], its[-1:])
            yield from _rows(batch, mine, its)  # the last row waits for its next; that of a task ends a piece

    kinds = dict(documents.dtypes)
    return mapped(rows, compared, f"doc_id {kinds['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(batch: pa.RecordBatch, mine: Pairs, its: Pairs) -> Iterator[pa.RecordBatch]:
    own = np.flatnonzero(~np.array(batch.column("last").to_pylist()[:-1], bool))
    if not len(own):
        return
    taken = batch.take(pa.array(own))
    yield pa.RecordBatch.from_arrays(
        [taken.column("doc_id"), taken.column("n_chars"), taken.column("edited_sha256"), pa.array(mine[own].texts()), pa.array(its[own].texts()), pa.array(mine[own].likeness(its[own])), pa.array(mine[own].likeness(mine[own + 1]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_imatch": op12_imatch}
ORACLE_SQL: dict[str, str] = {}

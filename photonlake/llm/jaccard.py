"""N-gram Jaccard join with a size-aware split into light and heavy sets.

A document's set holds the hashes of its distinct 5-word shingles. Two sets link when 100 times their overlap is at
least 80 times their union. The join is exact up to 64-bit hashes of shingles, and it works in these steps.

1. One pass counts how often shingles occur, in a sketch of fixed width, and gives each document its set's size and a
   128-bit hash of the set. Documents with equal sets become one, the smallest doc_id.
2. Shingles are ordered rarest first by the sketch. Two sets of sizes m <= n that link share at least k of the first
   n - ceil(0.8 n) + k shingles of either. Light sets, those of up to `boundary` shingles, enumerate the pairs (k = 2)
   of these as keys; heavy sets give each of them (k = 1) to its inverted list. Light sets within reach of a heavy one
   are in the lists too. The boundary is the one with the lowest cost by the histogram of sizes.
   A posting has the shingle's position in its set. Sets whose first common shingle (or second, for pairs) stands at
   i and j share at most what is left from there, so they are compared under that key only if this can suffice.
3. In a list, every document is compared with the list's first one and with the one before it, in order of position:
   first come those with the fewest rare shingles, which are nearest to what the list's documents have in common. A
   list of near copies thus takes as many comparisons as it has documents, and they fall in few components. Lists that
   the sketch says are long are dealt in parts, and the parts' first documents are compared in the same way.
4. What step 3 leaves open are documents of one list that are in different components. Lists whose documents are all
   in one component are done; from the others, the pairs across components are compared too. A posting meets only the
   classes of sizes that its own size and position leave possible.
5. Components come from the links by star contractions. Texts of one doc_id are linked too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, Workspace, lean, mapped
from .components import components

WORDS = 5
#: Two sets link when PART * overlap >= WHOLE * union; other thresholds are given as such a pair.
PART, WHOLE = 100, 80
SKETCH_BITS = 22
SEGMENTS = 64
BITMAP_BITS = 26
#: The postings of a part of a list, and the ratio of the sizes in a class.
PART_ROWS = 1 << 15
CLASS_RATIO = 1.05
MOST_LIGHT = 64
MOST_CACHED = 120_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()
CACHES["words"] = _HASHES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; the whole text is one where it has fewer words.

    bytes.lower() changes A-Z alone, bytes.split() cuts at ASCII white space alone, as the contract has it.
    """
    words = (text or b"").lower().split()
    n = len(words)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    if n >= WORDS:
        m = n - WORDS + 1
        x = h[:m] * _M[0]
        for k in range(1, WORDS):
            x += h[k : k + m] * _M[k]
        return np.unique(_mixed(x))
    if not n:
        return h
    x = np.array([n], np.uint64)
    for y in h:
        x = _mixed(x * _M[0] + y)
    return x


def links(overlap, m, n, part: int = PART, whole: int = WHOLE):
    return part * overlap >= whole * (m + n - overlap)


def least_overlap(n, part: int = PART, whole: int = WHOLE):
    """The smallest overlap that a set of n can have with any set that it links with."""
    return -(-n * whole // part)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        yield d, shingles(t.as_py())


_SETS = "doc_id long, n long, h1 long, h2 long, segment int, counts binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and, at the end of a task, the task's sketch in segments (compressed)."""
    import zlib

    sketch, shift = np.zeros(1 << SKETCH_BITS, np.uint32), np.uint64(64 - SKETCH_BITS)
    for batch in batches:
        ids, sizes, one, two, cells = [], [], [], [], []
        for d, s in _texts(batch):
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            ids.append(d)
            sizes.append(len(s))
            one.append((h >> 64) - (1 << 63))
            two.append((h & (1 << 64) - 1) - (1 << 63))
            cells.append((s >> shift).astype(np.uint32))
        at, counts = np.unique(np.concatenate(cells), return_counts=True)
        sketch[at] += counts.astype(np.uint32)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SETS_ARROW)
    if sketch.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(SEGMENTS, -1)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(SEGMENTS, pa.int64())] * 4, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], schema=_SETS_ARROW)


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketches of one segment as one, in eighths of the binary logarithm, a byte a cell."""
    import zlib

    total, segment = None, None
    for batch in rows:
        segment = batch.column("segment")[0].as_py()
        for x in batch.column("counts"):
            own = np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.uint64)
            total = own if total is None else total + own
    level = np.minimum(255, np.round(8 * np.log2(1.0 + total))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["segment", "level"])


def rarity(measured: DataFrame) -> np.ndarray:
    """The sketch of the corpus: 2 ** SKETCH_BITS bytes, whatever its size."""
    rows = measured.where("segment IS NOT NULL").select("segment", "counts").groupBy("segment").applyInArrow(lean(_summed), "segment int, level binary").collect()
    out = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.uint8)
    for r in rows:
        out[r.segment] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def bitmap_of(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** BITMAP_BITS bits with a bit for each hashed ID; it may let others pass, never drops one."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS)) + 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS - 15, 4096), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def fullness(bitmap: np.ndarray) -> float:
    return float(np.bitwise_count(bitmap).sum()) / (8 * len(bitmap))


def those(documents: DataFrame, ids: DataFrame, column: str, most_full: float = 0.5) -> tuple[DataFrame, np.ndarray]:
    """The documents that ids (distinct) may name, as rows and a bitmap that leaves out most others without a shuffle.

    A bitmap that is fuller than `most_full` would let most documents pass; a semi-join on doc_id does its work then.
    """
    bitmap = bitmap_of(ids, column)
    if fullness(bitmap) > most_full:
        documents = documents.join(ids.select(F.col(column).alias("doc_id")), "doc_id", "left_semi")
    return with_bit(documents), bitmap


def with_bit(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS)).alias("at"))


def passing(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    at = batch.column("at").to_numpy()
    return batch.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))


def choose_boundary(sizes: dict[int, int], rows_a_list: float) -> int:
    """The largest size whose sets enumerate pairs, at the lowest cost.

    A light set costs its pairs; a heavy one, and a light one within reach of a heavy one, costs its postings, each
    with the rows that it meets in its list.
    """
    best = (float("inf"), 0)
    for b in range(MOST_LIGHT + 1):
        cost = 0.0
        for n, docs in sizes.items():
            p = n - least_overlap(n) + 1
            if n <= b:
                cost += docs * (p + 1) * p / 2
            if n > b or n * PART >= b * WHOLE:
                cost += docs * p * (1 + rows_a_list)
        best = min(best, (cost, b))
    return best[1]


def keys_of(s: np.ndarray, level: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys under which a set is listed, how many of its shingles are rarer than what a key stands for, and the
    level of the rarest shingle in it.

    For a pair that is the number before its second shingle, less one: at most size - position shingles can then be
    common to two sets, for pairs as for single shingles.
    """
    n = len(s)
    p = n - least_overlap(n) + 1
    order = (level[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    q = min(n, p + 1)
    first = np.argpartition(order, q - 1)[:q] if q < n else np.arange(n)
    first = s[first[np.argsort(order[first], kind="stable")]]
    own = level[first >> np.uint64(64 - SKETCH_BITS)]
    keys, places, rarest = [], [], []
    if n <= boundary:
        if n == 1:
            keys.append(_mixed(s + _M[2]))
            places.append(np.zeros(1, np.int64))
            rarest.append(own)
        else:
            i, j = np.triu_indices(len(first), 1)
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            keys.append(_mixed(low * _M[0] + high * _M[1]))
            places.append(j - 1)
            rarest.append(own[i])
    if n > boundary or n * PART >= boundary * WHOLE:
        keys.append(first[:p])
        places.append(np.arange(p))
        rarest.append(own[:p])
    return np.concatenate(keys), np.concatenate(places), np.concatenate(rarest)


def postings(documents: DataFrame, shared: Broadcast, boundary: int, part_rows: int = PART_ROWS) -> DataFrame:
    """key, part, parts, doc and at of every representative; at is position * 2 ** 32 + size, so that it sorts by position.

    shared: the bitmap of the representatives and the sketch's levels. A list has as many parts as its shingle's count in
    the sketch, which is no less than the list's length, has part_rows; a document's hash decides its part.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, levels = shared.value
        n_parts = np.maximum(1, np.ceil(np.exp2(np.arange(256) / 8.0) / part_rows)).astype(np.int64)
        for batch in batches:
            rows, ids, seen = [], [], 0
            for d, s in _texts(passing(batch, bitmap)):
                if len(s):
                    keys, places, rarest = keys_of(s, levels, boundary)
                    parts = n_parts[rarest]
                    rows.append((keys, _mixed(np.array([d], np.int64).view(np.uint64))[0] % parts.astype(np.uint64), parts, (places.astype(np.int64) << 32) + len(s)))
                    ids.append(d)
                    seen += len(keys)
                if seen > 200_000:
                    yield _posted(rows, ids)
                    rows, ids, seen = [], [], 0
            if seen:
                yield _posted(rows, ids)

    return mapped(documents, post, "key long, part long, parts long, doc long, at long")


def _posted(rows: list[tuple[np.ndarray, ...]], ids: list[int]) -> pa.RecordBatch:
    docs = np.repeat(np.array(ids, np.int64), [len(r[0]) for r in rows])
    keys, part, parts, at = (np.concatenate(c) for c in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part.astype(np.int64)), pa.array(parts), pa.array(docs), pa.array(at)], names=["key", "part", "parts", "doc", "at"])


def may_link(a: Column, b: Column) -> Column:
    """Whether two postings of one key allow a link: by the sizes, and by what is left from the positions on."""
    m, n = a.bitwiseAND(0xFFFFFFFF), b.bitwiseAND(0xFFFFFFFF)
    left = F.least(m - F.shiftright(a, 32), n - F.shiftright(b, 32))
    return (PART * m >= WHOLE * n) & (PART * n >= WHOLE * m) & ((PART + WHOLE) * left >= WHOLE * (m + n))


def size_class(n: Column) -> Column:
    """The class of a size; classes are CLASS_RATIO wide."""
    return F.floor(F.log(n.cast("double")) / float(np.log(CLASS_RATIO))).cast("int")


def classes_within_reach(at: Column) -> Column:
    """The classes of the sizes that a posting's own size m and position allow its partners.

    A partner has 0.8 m at least; and with what is left from the position on, (PART + WHOLE) * left >= WHOLE * (m + n).
    """
    m = at.bitwiseAND(0xFFFFFFFF)
    least, most = F.ceil(m * WHOLE / PART), F.floor((m - F.shiftright(at, 32)) * (PART + WHOLE) / WHOLE) - m
    return F.when(least <= most, F.sequence(size_class(least), size_class(most))).otherwise(F.array().cast("array<int>"))


def verified(documents: DataFrame, pairs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link; only documents in a pair, and few others, send their sets."""
    wanted, bitmap = those(documents, pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "d")
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, seen = [], [], 0
            for d, s in _texts(passing(batch, shared.value)):
                ids.append(d)
                data.append(s.tobytes())
                seen += len(data[-1])
                if seen > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["d", "s"])
                    ids, data, seen = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["d", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                keep.append(bool(links(int(np.count_nonzero(t[at] == s)), len(s), len(t))))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    own = work.stage(mapped(wanted, sets, "d long, s binary"), f"{name}-sets")
    both = pairs.join(own.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    shared.unpersist()
    out = work.stage(mapped(both, compare, "a long, b long"), f"{name}-links")
    work.drop(f"{name}-sets")
    return out


def neighbours(lists: DataFrame, keys: list[str]) -> DataFrame:
    """lists (doc, at and keys) with first, prev and rows: the list's first posting, the one before, and their number."""
    in_order, row = Window.partitionBy(*keys).orderBy("at", "doc"), F.struct("doc", "at")
    return lists.withColumns({"first": F.first(row).over(in_order), "prev": F.lag(row).over(in_order), "rows": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def pairs_of(listed: DataFrame) -> DataFrame:
    """The pairs of a posting and its neighbours that may link."""
    each = listed.where("prev IS NOT NULL").select("doc", "at", F.explode(F.array_distinct(F.array("first", "prev"))).alias("other"))
    return each.where((F.col("doc") != F.col("other.doc")) & may_link(F.col("at"), F.col("other.at"))).select(F.least("doc", "other.doc").alias("a"), F.greatest("doc", "other.doc").alias("b"))


def texts_of_one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of doc_ids that have several texts."""
    own = ["n", "h1", "h2"]
    bounds = sets.groupBy("doc_id").agg(*[f(c).alias(f"{k}_{c}") for c in own for k, f in (("low", F.min), ("high", F.max))])
    several = bounds.where(" OR ".join(f"low_{c} < high_{c}" for c in own)).select("doc_id")
    reps = sets.join(several, "doc_id", "left_semi").join(classes, own).select("doc_id", "rep")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(documents: DataFrame, part_rows: int = PART_ROWS, most_full: float = 0.5) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents.

    Null texts and texts without words have an empty set and a component of their own, and so have rows with a null
    doc_id, whose component_id is null. Rows with one doc_id are one document with the links of each of its texts that
    have words. A very long text is one set, however long. An empty table gives no rows; further columns are ignored.
    """
    spark, work = documents.sparkSession, Workspace(documents.sparkSession, "jaccard")
    documents = documents.select("doc_id", "text")
    measured = work.stage(mapped(documents.select("doc_id", F.col("text").cast("binary").alias("text")), _measure, _SETS), "measured")
    sets = measured.where("segment IS NULL").drop("segment", "counts")
    level = rarity(measured)
    own = ["n", "h1", "h2"]
    numbered = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = work.stage(numbered.groupBy(*own).agg(F.min("doc_id").alias("rep")), "classes")
    sizes = {r.n: r.docs for r in classes.groupBy(F.least("n", F.lit(2 * MOST_LIGHT)).alias("n")).agg(F.count(F.lit(1)).alias("docs")).collect()}
    boundary = choose_boundary(sizes, float(np.median(np.exp2(level[level > 0] / 8.0))) if level.any() else 0.0)

    rows, bitmap = those(documents, classes.select("rep").distinct(), "rep", most_full)
    shared = spark.sparkContext.broadcast((bitmap, level))
    listed = neighbours(postings(rows, shared, boundary, part_rows), ["key", "part"]).where("rows > 1 OR parts > 1")
    listed = work.stage(listed, "lists")
    shared.unpersist()
    heads = listed.where("parts > 1 AND prev IS NULL").select("key", "doc", "at")
    pairs = work.stage(pairs_of(listed).union(pairs_of(neighbours(heads, ["key"]))).distinct(), "pairs")
    found = work.stage(verified(documents, pairs, work, "first").union(texts_of_one_id(numbered, classes)), "found")
    joined = work.stage(components(found, work, "first"), "joined")

    # lists with documents of several components
    labelled = listed.where("rows > 2 OR parts > 1").select("key", "doc", "at").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "at", F.coalesce("component", "doc").alias("comp"))
    labelled = work.stage(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_ = work.stage(labelled.join(mixed, "key").withColumn("class", size_class(F.col("at").bitwiseAND(0xFFFFFFFF))), "open")
    a = open_.select("key", F.explode(classes_within_reach(F.col("at"))).alias("class"), F.col("doc").alias("a"), F.col("at").alias("at_a"), F.col("comp").alias("comp_a"))
    b = open_.select("key", "class", F.col("doc").alias("b"), F.col("at").alias("at_b"), F.col("comp").alias("comp_b"))
    across = (F.col("comp_a") < F.col("comp_b")) & may_link(F.col("at_a"), F.col("at_b"))
    rest = a.join(b, ["key", "class"]).where(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = work.stage(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    more = verified(documents, rest, work, "second")
    final = work.stage(components(found.union(more), work, "final"), "components")
    work.drop("lists", "pairs", "found", "joined", "labelled", "open", "rest", "first-links", "second-links")

    labels = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*own, F.coalesce("component", "rep").alias("component_id"))
    none = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return numbered.join(labels, own).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents, in all their columns, without those that have a near duplicate with a smaller doc_id.

    Of rows with one doc_id one stays, the one whose hash of all columns is the least; rows with a null doc_id stay, and
    so do documents without words. An empty table gives no rows.
    """
    work = Workspace(documents.sparkSession, "deduplicated")
    result = near_duplicates(documents)
    keep = work.stage(result.where("doc_id = component_id").select("doc_id").distinct(), "keep")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    one = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return one.join(keep, "doc_id", "left_semi").select("__row.*").unionByName(documents.where("doc_id IS NULL"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL: dict[str, str] = {}

"""Product quantisation: four codebooks fitted by rounds of exact nearest search in kd-trees and integer means.

Each round broadcasts one kd-tree a codebook. A task searches its vectors by branch and bound, adds up the parts that
each entry got as integers, and sends one row an entry; the sums of all tasks replace the entries. The trees hold
PARTS * ENTRIES parts of vectors, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Workspace, mapped
from .vectors import extent, matrix, quantised

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 8
#: Rows of a label's sum, so that a label with very many vectors isn't one key of a join.
SALTS = 64


@dataclass
class Leaf:
    numbers: np.ndarray  # of the entries, ascending
    points: np.ndarray
    norms: np.ndarray


@dataclass
class Fork:
    axis: int
    below: int  # the largest coordinate on the left
    above: int  # the smallest on the right
    left: Fork | Leaf
    right: Fork | Leaf


def kd_tree(points: np.ndarray) -> Fork | Leaf:
    """A tree over the rows of a matrix of integers. Of equal rows only the first is in it: the others win no tie."""
    return _grown(points, np.sort(np.unique(points, axis=0, return_index=True)[1]) if points.shape[1] else np.arange(1))


def _grown(points: np.ndarray, numbers: np.ndarray) -> Fork | Leaf:
    own = points[numbers]
    if len(numbers) <= LEAF:
        return Leaf(numbers, own, (own * own).sum(axis=1))
    axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
    values = np.unique(own[:, axis])
    middle = np.searchsorted(values, np.median(own[:, axis]))
    middle = min(max(int(middle), 1), len(values) - 1)
    left = own[:, axis] < values[middle]
    return Fork(axis, values[middle - 1], values[middle], _grown(points, numbers[left]), _grown(points, numbers[~left]))


def nearest(tree: Fork | Leaf, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest point and the squared distance; of equally near points the lowest.

    All rows go through the tree together: first each to the leaf on its side of every fork, then each to every node
    whose bound isn't over the distance that it has. A node at just that distance is visited, as it may hold an equally
    near point of a lower number.
    """
    most = np.iinfo(queries.dtype).max if queries.dtype.kind == "i" else np.inf
    best, found = np.full(len(queries), most, queries.dtype), np.zeros(len(queries), np.int64)
    norms = (queries * queries).sum(axis=1)

    def compare(leaf: Leaf, rows: np.ndarray) -> None:
        distances = norms[rows, None] - 2 * (queries[rows] @ leaf.points.T) + leaf.norms
        first = distances.argmin(axis=1)
        distance, number = distances[np.arange(len(rows)), first], leaf.numbers[first]
        better = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
        best[rows[better]], found[rows[better]] = distance[better], number[better]

    def descend(node: Fork | Leaf, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, Leaf):
            return compare(node, rows)
        x = queries[rows, node.axis]
        left = x - node.below <= node.above - x
        descend(node.left, rows[left])
        descend(node.right, rows[~left])

    def visit(node: Fork | Leaf, rows: np.ndarray, bound: np.ndarray, gaps: dict[int, np.ndarray]) -> None:
        near = bound <= best[rows]
        if not near.any():
            return
        rows, bound, gaps = rows[near], bound[near], {a: g[near] for a, g in gaps.items()}
        if isinstance(node, Leaf):
            return compare(node, rows)
        x, before = queries[rows, node.axis], gaps.get(node.axis, 0)
        for child, gap in ((node.left, x - node.below), (node.right, node.above - x)):
            gap = np.maximum(gap, before).clip(0)
            visit(child, rows, bound - before * before + gap * gap, gaps | {node.axis: gap})

    every = np.arange(len(queries))
    descend(tree, every)
    visit(tree, every, np.zeros(len(queries), queries.dtype), {})
    return found, best


def _searched(batches: Batches, trees: list, width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each batch and, for each part, the parts as integers, the numbers of their entries and the distances."""
    kind = _points_of(trees[0]).dtype
    for batch in batches:
        x = matrix(batch.column("x"), PARTS * width)
        parts = [x[:, p * width : (p + 1) * width] for p in range(PARTS)]
        yield batch, [(part, *nearest(tree, part.astype(kind))) for part, tree in zip(parts, trees, strict=True)]


def _points_of(node: Fork | Leaf) -> np.ndarray:
    return node.points if isinstance(node, Leaf) else _points_of(node.left)


def first_entries(points: DataFrame, n: int = ENTRIES) -> np.ndarray:
    """The vectors of the n smallest vec_ids; of several vectors with one vec_id the smallest. Null has no place."""
    ids = [r[0] for r in points.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(n).collect()]
    if not ids:
        raise ValueError("no vector has a vec_id to start a codebook with")
    chosen = points.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    return np.array([r.x for r in chosen], np.int64)


def fit(points: DataFrame, rounds: int = ROUNDS, n: int = ENTRIES, largest: int | None = None) -> list[np.ndarray]:
    """The codebook of each part: a matrix of integers with a row an entry."""
    start = first_entries(points, n)
    width = start.shape[1] // PARTS
    books = [start[:, p * width : (p + 1) * width] for p in range(PARTS)]
    for _ in range(rounds):
        trees = points.sparkSession.sparkContext.broadcast(_trees(books, largest))

        def sums(batches: Batches, trees=trees) -> Batches:
            totals, counts = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
            for _, found in _searched(batches, trees.value, width):
                for p, (part, number, _) in enumerate(found):
                    np.add.at(totals[p], number, part)
                    counts[p] += np.bincount(number, minlength=n)
            part, entry = np.nonzero(counts)
            if len(part):
                yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": counts[part, entry], "sums": list(totals[part, entry])})

        rows = mapped(points.select("x"), sums, "part long, entry long, n long, sums array<long>")
        total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():  # a row an entry
            books[r.part][r.entry] = [s // r.n for s in r.sums]
        trees.destroy()
    return books


def _trees(books: list[np.ndarray], largest: int | None) -> list[Fork | Leaf]:
    """In doubles where every squared distance is a whole number below 2 ** 53, else in longs, which are slower."""
    most = books[0].shape[1] * (2 * (largest if largest is not None else 1 << 31)) ** 2
    if most >= 1 << 62:
        raise ValueError("components are too large for squared distances in longs")
    return [kd_tree(b.astype(np.float64 if most < 1 << 53 else np.int64)) for b in books]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(points: DataFrame, books: list[np.ndarray], largest: int | None = None) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    trees, width = points.sparkSession.sparkContext.broadcast(_trees(books, largest)), books[0].shape[1]

    def codes(batches: Batches) -> Batches:
        for batch, found in _searched(batches, trees.value, width):
            numbers = np.stack([number for _, number, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(distance.astype(np.int64) for _, _, distance in found)
            code = [numbers[i : i + 2 * PARTS] for i in range(0, len(numbers), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(points.dtypes)
    return mapped(points, codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of each usable vector.

    Vectors that are null or hold null or non-finite components go. Repeated rows count as often as they are there and
    have a row each; rows with a null vec_id are coded but start no codebook; of rows with one vec_id and different
    vectors the smallest vector starts. Fewer than 256 vec_ids give codebooks of that many entries; an entry that
    gets no parts stays; equal entries keep their numbers, and the lowest wins. A null label is a label. Where all vec_ids
    are null there are no codebooks: code and errors are null, and the digest is that of no entries. An empty table
    gives no rows; further columns are ignored. Vectors of different lengths, or of a length that 4 doesn't divide,
    raise.
    """
    work = Workspace(embeddings.sparkSession, "codebooks")
    points = work.stage(quantised(embeddings, SCALE, "vec_id", "label"), "points")
    _, length, largest = extent(points)
    if points.where("vec_id IS NOT NULL").isEmpty():
        none = ("CAST(NULL AS STRING) AS code", "CAST(NULL AS LONG) AS error", "CAST(NULL AS LONG) AS label_error")
        return points.selectExpr("vec_id", *none, f"'{digest([])}' AS codebooks_sha256", "label")
    if length % PARTS:
        raise ValueError(f"vectors of {length} components have no {PARTS} equal parts")
    books = fit(points, rounds, largest=largest)
    rows = work.stage(encoded(points, books, largest), "codes")
    work.drop("points")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", salt)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(labels, salted["label"].eqNullSafe(labels["of"]) & (salted["salt"] == labels["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after the other; books has a list of components for each part and entry."""
    finite = "list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))"
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    found = f"SELECT p.vec_id, p.part, arg_min(b.entry, [{distance}, b.entry]) AS entry, min({distance}) AS d, any_value(p.v) AS v FROM parts p JOIN %s b ON p.part = b.part GROUP BY p.vec_id, p.part"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND coalesce({finite}, true))",
        f"parts AS MATERIALIZED (SELECT vec_id, part, list_slice(x, CAST(part * len(x) // {PARTS} + 1 AS BIGINT), CAST((part + 1) * len(x) // {PARTS} AS BIGINT)) AS v FROM kept, range({PARTS}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS):
        steps += [
            f"f{r} AS MATERIALIZED ({found % f'b{r}'})",
            f"s{r} AS (SELECT part, entry, k, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM f{r}) GROUP BY ALL)",
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, entry, list(c ORDER BY k) AS v FROM s{r} GROUP BY part, entry) m USING (part, entry))",
        ]
    steps += [
        f"f AS MATERIALIZED ({found % f'b{ROUNDS}'})",
        "c AS (SELECT vec_id, string_agg(lower(format('{:02x}', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id)",
        "l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN kept USING (vec_id) GROUP BY label)",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256, kept.label FROM c JOIN kept USING (vec_id) JOIN l ON kept.label IS NOT DISTINCT FROM l.label CROSS JOIN h"


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {"op11_vector_codes": _sql()}

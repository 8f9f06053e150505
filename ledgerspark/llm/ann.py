"""Nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a vector; its digit is the nearest signed axis. A table's code is made of
digits with rotations of their own, the last one over fewer axes, so that it has
about log2(rows / 2) bits: buckets stay small however many rows there are. Every
vector lies in one bucket per table; a query looks into the buckets whose axes it
leans to most, over all digits. All candidates met are ranked by the exact inner
product. Where norms differ, one more coordinate makes the largest inner product
the smallest angle.

The number of probes is the least that finds ``aim`` of the true neighbours of
sample queries within a sample of at most ``sample`` rows (the only use of that
sample; every row is indexed), whatever the table's size. Where more than
``most`` probes would be needed, the code is made shorter.

Buckets lie in groups by the leading bits of their code. A group with more than
``block`` rows is cut into blocks by hash and its queries are sent to each block,
so no bucket meets in one task and none is cut short.

Defined cases: vectors that are null, zero, of another length than the commonest
(the longer one at a tie), or hold null or non-finite components take no part;
rows with the same id and vector count once, and an id with several vectors takes
one place, by its best; ties go to the smaller id; a null id takes no part; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import drawn, map_arrow, materialize, table


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row."""
    n, width, h = len(x), x.shape[1], 1
    x = x.copy()
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


class Codes:
    """The codes of all tables, for vectors of `size` components and at most `norm` long."""

    def __init__(self, size: int, norm: float, extend: bool, tables: int, bits: int, seed: int = 11):
        self.size, self.norm, self.extend, self.tables, self.bits = size, norm, extend, tables, bits
        self.width = 1 << (size + extend - 1).bit_length()
        full = self.width.bit_length()
        #: Of each digit the number of axes, each of two signs; the last digit has the bits that are left.
        self.axes = [1 << (min(full, bits - at) - 1) for at in range(0, bits, full)]
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, max(1, len(self.axes)), 3, self.width))

    def turned(self, v: np.ndarray, t: int, digit: int, query: bool) -> np.ndarray:
        x = np.zeros((len(v), self.width))
        length = np.linalg.norm(v, axis=1, keepdims=True)
        x[:, : self.size] = v / length if query else v / self.norm
        if self.extend and not query:
            x[:, self.size] = np.sqrt(np.maximum(0, 1 - (length[:, 0] / self.norm) ** 2))
        for signs in self.signs[t, digit]:
            x = hadamard(x * signs)
        return x[:, : self.axes[digit]]

    def of(self, v: np.ndarray) -> np.ndarray:
        """The code of each row in each table: per digit the nearest axis, or axes + axis if its sign is negative."""
        out = np.zeros((len(v), self.tables), np.int64)
        for t in range(self.tables):
            for digit, axes in enumerate(self.axes):
                x = self.turned(v, t, digit, False)
                axis = np.abs(x).argmax(1)
                out[:, t] = out[:, t] * (2 * axes) + axis + axes * (x[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, v: np.ndarray, t: int, count: int) -> np.ndarray:
        """The `count` codes of table t that each query leans to most (all, if there are fewer), best first.

        The lean to a code is the sum over its digits of the coordinate on the
        axis, times the length that the largest of so many coordinates has.
        """
        score, code = np.zeros((len(v), 1)), np.zeros((len(v), 1), np.int64)
        for digit, axes in enumerate(self.axes):
            x = self.turned(v, t, digit, True) * np.sqrt(2 * np.log(2 * axes))
            score = (score[:, :, None] + np.hstack([x, -x])[:, None, :]).reshape(len(v), -1)
            code = (code[:, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(len(v), -1)
            if score.shape[1] > count:  # sums of digits: the best codes begin with the best beginnings
                best = np.argpartition(-score, count - 1, axis=1)[:, :count]
                score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
        order = np.lexsort((code, -score))
        return np.take_along_axis(code, order, 1)


def calibrate(codes: Codes, sample: np.ndarray, k: int, aim: float, most: int, queries: int = 200) -> int | None:
    """The least number of probes per table, up to `most`, that finds `aim` of the k nearest of sample queries."""
    if len(sample) < 2:
        return 1
    picked = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
    score = sample[picked] @ sample.T
    score[np.arange(len(picked)), picked] = -np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    own = codes.of(sample)
    needed = np.full(best.shape, most + 1)
    for t in range(codes.tables):
        probes = codes.probes(sample[picked], t, most)
        for row, (codes_tried, codes_wanted) in enumerate(zip(probes, own[best, t])):
            order = np.argsort(codes_tried)
            at = np.minimum(np.searchsorted(codes_tried[order], codes_wanted), len(order) - 1)
            place = order[at]
            needed[row] = np.minimum(needed[row], np.where(codes_tried[place] == codes_wanted, place + 1, most + 1))
    found = int(np.quantile(needed, aim, method="higher"))
    return found if found <= most else None


def fitted(size: int, norm: float, extend: bool, tables: int, rows: int, sample: np.ndarray, k: int, aim: float, most: int) -> tuple[Codes, int]:
    """The longest code of at most log2(rows / 2) bits that reaches the aim, and its number of probes."""
    bits = max(1, (rows // 2).bit_length() - 1)
    while True:
        codes = Codes(size, norm, extend, tables, bits)
        count = calibrate(codes, sample, k, aim, most)
        if count is not None:
            return codes, count
        bits -= 1


def nearest(
    vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 8, sample: int = 20_000, aim: float = 0.94, block: int = 8192, most: int = 2048
) -> DataFrame:
    """The k nearest rows found for each row that is_query (a condition): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType
    packed = np.dtype("f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "f8")
    good = v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.max(norm).alias("most"), F.min(norm).alias("least"), F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, longest, shortest, _ = sizes[0]
    rows = rows.where(F.size("v") == size).groupBy("vec_id", "v").agg(F.max("q").alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(r.values, packed).tobytes() for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["vec_id", "v", "q"])

    def unpack(blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs.to_pylist()), packed).reshape(-1, size).astype(float)

    stored = materialize(map_arrow(rows, pack, "vec_id long, v binary, q boolean", rows=4000), "vectors")
    total = stored.count()
    some = np.array([np.frombuffer(r["v"], packed) for r in drawn(stored, total, sample, "vec_id", "v").select("v").collect()], float)
    codes, count = fitted(size, longest, shortest < longest * (1 - 1e-6), tables, total, some, k, aim, most)
    # bits of a code behind its group's: groups of about `block` rows, but at least eight a table, to share the work
    rest = codes.bits - min(codes.bits, max(3, (total // block).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = codes.of(unpack(batch.column(1)))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(own[:, t] >> rest), pa.array(own[:, t]), batch.column(0), batch.column(1)], ["t", "lead", "code", "vec_id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column(1))
            for t in range(tables):
                probes = np.sort(codes.probes(x, t, count), axis=1)
                row, lead, lists = [], [], []
                for i, codes_tried in enumerate(probes):
                    at = np.flatnonzero(np.concatenate([[True], np.diff(codes_tried >> rest) != 0]))
                    row += [i] * len(at)
                    lead += (codes_tried[at] >> rest).tolist()
                    lists += np.split(codes_tried, at[1:])
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t), pa.int32()), pa.array(lead, pa.int64()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(lists, pa.list_(pa.int64()))], ["t", "lead", "query_id", "v", "codes"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best candidates of this block for each query that looks into it."""
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            own = np.array(right["code"])
            order = np.argsort(own, kind="stable")
            own, ids, c = own[order], np.array(right["vec_id"])[order], unpack(right["v"])[order]
            asked, q = np.array(left["query_id"]), unpack(left["v"])
            lists = left["codes"].combine_chunks()
            tried = np.asarray(lists.flatten())
            of = np.repeat(np.arange(len(asked)), np.asarray(lists.value_lengths()))
            low, high = np.searchsorted(own, tried, "left"), np.searchsorted(own, tried, "right")
            found, at = [out], 0
            bounds = np.flatnonzero(np.diff(of, append=-1)) + 1  # a query's candidates stay together
            ends = np.cumsum(high - low)[bounds - 1]
            for cut in [*(np.flatnonzero(np.diff(ends // 50_000)) + 1).tolist(), len(bounds)]:
                part = slice(at, bounds[cut - 1] if cut else 0)
                at = part.stop
                n = (high - low)[part]
                if n.sum():
                    which = np.repeat(of[part], n)
                    pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
                    found.append(best_of(asked[which], ids[pick], (c[pick] * q[which]).sum(1), k))
            out = tuple(np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    keys = ["t", "lead", "part"]
    indexed = map_arrow(stored.select("vec_id", "v"), place, "t int, lead long, code long, vec_id long, v binary", rows=4000)
    large = indexed.groupBy("t", "lead").agg(F.count("*").alias("c")).select("t", "lead", F.ceil(F.col("c") / block).cast("int").alias("parts")).where("parts > 1")
    large = materialize(large, "large")
    parts = F.coalesce("parts", F.lit(1))
    indexed = indexed.join(large, ["t", "lead"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int")).select(*keys, "code", "vec_id", "v")
    queries = map_arrow(stored.where("q").select("vec_id", "v"), ask, "t int, lead long, query_id long, v binary, codes array<long>", rows=500)
    queries = queries.join(large, ["t", "lead"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*keys, "query_id", "v", "codes")
    found = queries.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    flat = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best other ids, each with its best score."""
    other = query != ids
    query, ids, score = query[other], ids[other], score[other]
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    one = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, bool)
    query, ids, score = query[one], ids[one], score[one]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    best = np.arange(len(query)) - first < k
    return query[best], ids[best], score[best]


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)

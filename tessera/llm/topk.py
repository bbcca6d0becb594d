"""Exact top-k by inner product with pivot-table elimination.

Vectors are packed into blocks (one row of binary columns each) together with their distances to
``PIVOTS`` pivots.  By the triangle inequality the largest difference of two vectors' distances to a pivot
is a lower bound of their own distance, hence an upper bound of their inner product.  A query's candidates
are evaluated in the order of that bound, a step at a time, and the query stops as soon as its k-th score
exceeds the next bound; scores it has from earlier blocks count.  All is integer arithmetic but the bounds,
which are widened by more than their rounding.

A stated query set meets all rows, block by block: each candidate block is sent once, to one of the candidate
groups, and every query block passes through every group.  What is sent is the input once and the queries
once a group of ``BLOCKS_PER_GROUP * BLOCK_ROWS`` vectors.

Defined results for odd input: vectors that are null or hold null or non-finite components take no part; a
vector of another length is compared as if the shorter one ended in zeros; ties go to the smaller id;
rows that share a query's id are its own and are no candidates; of rows that repeat a query's id the one
with the smallest vector asks; rows with a null id take no part; an empty table gives an empty table.
Blocks with components beyond +-2**20 after scaling are compared in whole numbers without bounds; scores
beyond 64 bits are cut to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, written

K = 20
QUERY_EVERY = 20
SCALE = 64.0
PIVOTS = 16
BLOCK_ROWS = 2048
#: Candidate blocks that one task holds; all query blocks pass through it.
BLOCKS_PER_GROUP = 32
#: Candidates a query evaluates before it looks at its bound again.
STEP = 128
LARGEST = 1 << 20
#: Bytes of candidate vectors that are gathered at once.
GATHER_BYTES = 32 << 20
UNUSED = 1 - (1 << 63)

BLOCK_SCHEMA = "block long, n int, dim int, wide boolean, ids binary, vectors binary, norms binary, pivots binary"


def scaled_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``id, v`` (array of long) of the vectors that take part."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return df.where(F.col(f"`{key}`").isNotNull() & x.isNotNull()).where(finite).select(F.col(f"`{key}`").cast("long").alias("id"), scaled.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pad(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))


def pack_blocks(vectors: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``block_rows`` vectors with their pivot table; block numbers are unique."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            wide = _largest(m) > LARGEST  # such blocks are compared without bounds
            dim = max(m.shape[1], pivots.shape[1])
            p, x = _pad(pivots, dim), _pad(np.zeros_like(m) if wide else m, dim).astype(np.float64)
            norms = (x * x).sum(1)
            far = np.sqrt(np.maximum(norms[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)).astype(np.float32)
            vectors = (m if wide else m.astype(np.int32)).tobytes()
            columns = [[number], [len(ids)], [m.shape[1]], [wide], [ids.astype(np.int64).tobytes()], [vectors], [norms.tobytes()], [far.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            dim = max(m.shape[1] for _, m in held)
            return block(np.concatenate([i for i, _ in held]), np.vstack([_pad(m, dim) for _, m in held]))

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                if count and count + part.num_rows > block_rows:
                    yield flush()
                    number, count = number + 1, 0
                    held.clear()
                held.append((part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))))
                count += part.num_rows
        if count:
            yield flush()

    return vectors.select("id", "v").mapInArrow(run, BLOCK_SCHEMA)


class _Block:
    def __init__(self, row: dict):
        n, dim, self.wide = row["n"], row["dim"], row["wide"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64 if self.wide else np.int32).reshape(n, dim)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.pivots = np.frombuffer(row["pivots"], np.float32).reshape(n, -1)


def _no_best(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), UNUSED), np.full((n, k), np.iinfo(np.int64).max)


def _merge(scores: np.ndarray, ids: np.ndarray, got: np.ndarray, other: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of what a query has and of new (score, id) pairs other than its own; ties go to the smaller id."""
    k = scores.shape[1]
    all_scores, all_ids = np.hstack([scores, np.where(other == own[:, None], UNUSED, got)]), np.hstack([ids, other])
    keep = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    return np.take_along_axis(all_scores, keep, 1), np.take_along_axis(all_ids, keep, 1)


def _search_wide(q: _Block, c: _Block, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All products of two blocks of which one has components beyond ``LARGEST``, in whole numbers; sums beyond 64 bits are cut to them."""
    scores, ids = best
    dim = max(q.vectors.shape[1], c.vectors.shape[1])
    qv, cv = _pad(q.vectors, dim).astype(np.int64), _pad(c.vectors, dim).astype(np.int64)
    fits = dim * _largest(qv) * _largest(cv) < 1 << 62
    if not fits:
        qv, cv = qv.astype(object), cv.astype(object)
    for at in range(0, len(qv), 64):
        part = slice(at, at + 64)
        got = qv[part] @ cv.T
        if not fits:
            got = np.clip(got, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)
        scores[part], ids[part] = _merge(scores[part], ids[part], got, np.broadcast_to(c.ids, got.shape), q.ids[part])
    return scores, ids


def search_block(q: _Block, c: _Block, k: int, best: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query of ``q`` among those in ``best`` and the rows of ``c``.

    Unused places have the score ``UNUSED``.
    """
    nq, nc = len(q.ids), len(c.ids)
    scores, ids = _no_best(nq, k) if best is None else (best[0].copy(), best[1].copy())
    if q.wide or c.wide:
        return _search_wide(q, c, (scores, ids))
    dim = max(q.vectors.shape[1], c.vectors.shape[1])
    exact32 = dim * _largest(q.vectors) * _largest(c.vectors) < 1 << 24  # sums of integers are exact
    kind = np.float32 if exact32 else np.float64
    qv, cv = _pad(q.vectors, dim).astype(kind), _pad(c.vectors, dim).astype(kind)
    # The largest lower bound of the distance over all pivots, as an upper bound of the inner product.
    low = np.zeros((nq, nc), np.float32)
    for p in range(q.pivots.shape[1]):
        np.maximum(low, np.abs(q.pivots[:, p : p + 1] - c.pivots[None, :, p]), out=low)
    low *= np.float32(1 - 1e-5)
    low -= np.float32(1e-3)
    np.maximum(low, 0, out=low)
    bound = (q.norms[:, None] + c.norms[None, :] - low.astype(np.float64) ** 2) / 2 + 0.5
    order = np.argsort(-bound.astype(np.float32), axis=1)
    active = np.arange(nq)
    # Vectors of the candidates of so many queries are gathered at once.
    width = max(1, GATHER_BYTES // (STEP * max(dim, 1) * qv.itemsize))
    for at in range(0, nc, STEP):
        chosen = order[active, at : at + STEP]
        # Exact stopping: a later candidate can enter only with a score of at least the k-th.
        going = np.take_along_axis(bound[active], chosen[:, :1], 1)[:, 0] + 1.0 + 1e-6 * np.abs(bound[active, chosen[:, 0]]) >= scores[active, k - 1]
        active, chosen = active[going], chosen[going]
        if not len(active):
            break
        for part in range(0, len(active), width):
            own, some = active[part : part + width], chosen[part : part + width]
            got = np.matmul(cv[some], qv[own][:, :, None])[:, :, 0].astype(np.int64)
            scores[own], ids[own] = _merge(scores[own], ids[own], got, c.ids[some], q.ids[own])
    return scores, ids


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, n_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the queries (id, v) against all rows (id, v)."""
    spark = rows.sparkSession
    with Scratch(spark) as s:
        rows = s.written(rows, "vectors")
        # One query an id: of rows that repeat it, the one with the smallest vector.
        queries = s.written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
        # A bounded sample: n_pivots rows by hash order.
        sample = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()]
        dim = max([len(v) for v in sample], default=0)
        pivots = np.array([[*v, *[0] * (dim - len(v))] for v in sample], dtype=np.float64).reshape(len(sample), dim)
        pivots[np.abs(pivots) > LARGEST] = 0
        right = s.written(pack_blocks(rows, pivots), "candidate-blocks")
        left = s.written(pack_blocks(queries, pivots), "query-blocks")
        groups = int(max(-(-right.count() // BLOCKS_PER_GROUP), spark.sparkContext.defaultParallelism))
        # Candidate blocks go to one group each and stay there; query blocks go to every group.
        grp = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
        there = right.withColumn("grp", grp).withColumn("asks", F.lit(False))
        met = there.unionByName(left.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(True)))
        dealt = met.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "asks", "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held = None, []
            for batch in batches:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    row = {name: batch.column(j)[i].as_py() for j, name in enumerate(names)}
                    if row["grp"] != group:
                        group, held = row["grp"], []
                    block = _Block(row)
                    if not row["asks"]:
                        held.append(block)
                        continue
                    best = None
                    for c in held:
                        best = search_block(block, c, k, best)
                    if best is not None:
                        used = best[0] != UNUSED
                        at = np.nonzero(used)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(block.ids[at]), pa.array(best[1][used]), pa.array(best[0][used])], ["query_id", "vec_id", "score"])

        found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")


def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.where(F.col("id") % QUERY_EVERY == 0), vectors)

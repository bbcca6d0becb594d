"""Neighbours and density clusters of embedding vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Vectors of a block, of which two meet in a task, and of a tile, of which two are multiplied at once.
BLOCK, TILE = 8192, 1024
#: Vectors of a block of the spanning tree; all distances of two such blocks are in memory at once.
TREE_BLOCK = 2048
#: Blocks along each side of the square whose edges one task thins out to a forest.
FAN = 8
#: Squared distances below this share of the squared lengths are taken from differences, as rounding blurs them: copies are at 0.
CLOSE = 1e-9
#: Smallest distance that tree levels (its inverse) tell from 0.
LEAST = 1e-12


def _blocks(vectors: DataFrame, block: int, n: int) -> DataFrame:
    """(blk, ids, data, core): ``n`` blocks of vectors as packed numbers, so that a block is one row of binaries; ``core`` may be absent."""
    more = [c for c in ("core",) if c in vectors.columns]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, data = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_list()).astype(np.float64)
        packed = {"blk": pdf["blk"].iloc[:1].to_numpy(), "ids": [ids.tobytes()], "data": [data.tobytes()]}
        return pd.DataFrame(packed | {c: [pdf[c].to_numpy(np.float64).tobytes()] for c in more})

    keyed = vectors.select("vec_id", "embedding", *more, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("blk"))
    return keyed.groupBy("blk").applyInPandas(pack, ", ".join(["blk int", *(f"{c} binary" for c in ("ids", "data", *more))]))


def _block_pairs(blocks: DataFrame, n: int) -> DataFrame:
    """Every two blocks once, a block with itself too: the columns of one, ``other`` and the columns of that one with ``_2``."""
    columns = [c for c in blocks.columns if c != "blk"]
    listed = blocks.withColumn("other", F.explode(F.sequence(F.col("blk"), F.lit(n - 1))))
    others = blocks.select(F.col("blk").alias("other"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return listed.join(others, "other").repartition(n * (n + 1) // 2, "blk", "other").select("blk", "other", *columns, *[f"{c}_2" for c in columns])


def _n_blocks(vectors: DataFrame, total: int, block: int, least: int) -> int:
    """Blocks of at most about ``block`` vectors; small tables get smaller ones of ``least`` or more, for as many pairs as there are cores."""
    n = max(1, -(-total // block))
    if total > least:
        while n * (n + 1) // 2 < vectors.sparkSession.sparkContext.defaultParallelism and n * least < 2 * total:
            n += 1
    return n


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    d = a @ b.T
    d *= -2
    d += lengths
    lengths *= CLOSE
    close = np.flatnonzero(d < lengths)
    for at in range(0, len(close), 1 << 16):
        some = close[at : at + (1 << 16)]
        i, j = np.divmod(some, len(b))
        d.flat[some] = ((a[i] - b[j]) ** 2).sum(1)
    return d


def _nearest(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``a`` its up to ``k`` smallest distances to rows of ``b`` with other ids, tile by tile."""
    out = []
    for at in range(0, len(a), TILE):
        x, ix = a[at : at + TILE], ia[at : at + TILE]
        near, where = np.empty((len(x), 0)), np.empty((len(x), 0), int)
        for to in range(0, len(b), TILE):
            d = _squares(x, b[to : to + TILE])
            d[ix[:, None] == ib[None, to : to + TILE]] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            near, where = np.hstack([near, np.take_along_axis(d, best, 1)]), np.hstack([where, best + to])
            if near.shape[1] > k:
                best = np.argpartition(near, k - 1, axis=1)[:, :k]
                near, where = np.take_along_axis(near, best, 1), np.take_along_axis(where, best, 1)
        # From differences, so that a distance is the same number wherever the two vectors meet.
        for j in range(near.shape[1]):
            near[:, j] = np.where(np.isfinite(near[:, j]), ((x - b[where[:, j]]) ** 2).sum(1), np.inf)
        out.append(near)
    return np.sqrt(np.vstack(out))


def core_distances(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(vec_id, core): distance to the k-th nearest other vector (null if there are fewer); exact.

    Every two blocks meet once and serve both sides: the blocks moved are half the square of their number,
    ``block`` vectors each, and a pair of blocks returns ``k`` numbers a vector.  Small tables get smaller blocks, for
    as many pairs as there are cores.  Ids have to be unique; null vectors take no part.
    """
    vectors = vectors.where(F.col("embedding").isNotNull())
    n = _n_blocks(vectors, vectors.count(), block, TILE)
    pairs = _block_pairs(written(_blocks(vectors, block, n), "vector-blocks"), n)

    def run(batches):
        for pdf in batches:
            for blk, other, *packed in zip(pdf["blk"], pdf["other"], pdf["ids"], pdf["data"], pdf["ids_2"], pdf["data_2"]):
                ia, ib = (np.frombuffer(packed[i], np.int64) for i in (0, 2))
                a, b = (np.frombuffer(packed[i]).reshape(len(ids), -1) for i, ids in ((1, ia), (3, ib)))
                for x, ix, y, iy in ((a, ia, b, ib), (b, ib, a, ia))[: 1 if blk == other else 2]:
                    near = _nearest(x, ix, y, iy, k)
                    yield pd.DataFrame({"vec_id": np.repeat(ix, near.shape[1]), "d": near.ravel()})

    found = pairs.mapInPandas(run, "vec_id long, d double").where("d < double('Infinity')")
    return found.groupBy("vec_id").agg(F.sort_array(F.collect_list("d")).alias("ds")).select("vec_id", F.get("ds", F.lit(k - 1)).alias("core"))


def _tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of a least spanning tree of the complete graph with distances ``d``, by Prim's algorithm."""
    n = len(d)
    far, parent, outside = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    far[0], outside[0] = np.inf, False
    added = np.empty(max(n - 1, 0), int)
    for step in range(n - 1):
        at = int(far.argmin())
        added[step], outside[at], far[at] = at, False, np.inf
        better = (d[at] < far) & outside
        np.copyto(far, d[at], where=better)
        np.copyto(parent, at, where=better)
    return parent[added], added


def _tree_between(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of a least spanning tree of the graph that has only the edges from rows to columns of ``d``."""
    rows, columns = d.shape
    n, back = rows + columns, np.ascontiguousarray(d.T)
    far, parent, outside = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    added = np.empty(n - 1, int)
    for step in range(-1, n - 1):
        at = int(far.argmin()) if step >= 0 else 0
        if step >= 0:
            added[step] = at
        outside[at], far[at] = False, np.inf
        side, now = (slice(rows, n), d[at]) if at < rows else (slice(0, rows), back[at - rows])
        better = (now < far[side]) & outside[side]
        np.copyto(far[side], now, where=better)
        np.copyto(parent[side], at, where=better)
    ends = parent[added], added
    return np.minimum(*ends), np.maximum(*ends) - rows


class _Roots:
    """Sets of numbers that grow together; ``join`` tells whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def __call__(self, u: int) -> int:
        up = self.up
        while up[u] != u:
            up[u] = up[up[u]]
            u = up[u]
        return u

    def join(self, u: int, v: int) -> bool:
        a, b = self(u), self(v)
        self.up[max(a, b)] = min(a, b)
        return a != b


_EDGES = "i int, k int, u binary, v binary, d binary"


def _edges(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("u", np.int64), ("v", np.int64), ("d", np.float64)))


def _packed(i: int, k: int, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": [i], "k": [k], "u": [u.tobytes()], "v": [v.tobytes()], "d": [d.tobytes()]})


def _thinned(pdf: pd.DataFrame) -> pd.DataFrame:
    """A least spanning forest of the packed edges, sorted by distance, as one row (Kruskal's algorithm)."""
    u, v, d = _edges(pdf)
    order = np.lexsort((v, u, d))
    u, v, d = u[order], v[order], d[order]
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    roots = _Roots(len(ids))
    kept = np.fromiter((roots.join(a, b) for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist())), bool, len(u))
    return _packed(int(pdf["i"].iloc[0]), int(pdf["k"].iloc[0]), u[kept], v[kept], d[kept])


def spanning_tree(vectors: DataFrame, block: int = TREE_BLOCK) -> DataFrame:
    """One row of packed edges (u, v, d), sorted by d: a least spanning tree of (vec_id, embedding, core) by mutual reachability.

    An edge that a least spanning tree of all vectors needs is in one of the edges between two blocks (or inside one), so every
    two blocks meet once and yield a tree of their own.  Squares of ``FAN`` x ``FAN`` trees are thinned out to
    forests until one is left; the last task gets fewer than ``FAN`` + 1 edges a vector.
    """
    n = _n_blocks(vectors, vectors.count(), block, max(1, block // 8))
    pairs = _block_pairs(written(_blocks(vectors, block, n), "tree-blocks"), n)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = [np.frombuffer(x, np.int64) for x in (row.ids, row.ids_2)]
                data = [np.frombuffer(x).reshape(len(i), -1) for x, i in zip((row.data, row.data_2), ids)]
                core = [np.frombuffer(x) for x in (row.core, row.core_2)]
                d = np.sqrt(np.maximum(_squares(*data), 0))
                d = np.maximum(np.maximum(d, core[0][:, None], out=d), core[1][None], out=d)
                x, y = (_tree if row.blk == row.other else _tree_between)(d)
                exact = np.sqrt(((data[0][x] - data[1][y]) ** 2).sum(1))
                u, v = ids[0][x], ids[1][y]
                yield _packed(row.blk, row.other, np.minimum(u, v), np.maximum(u, v), np.maximum(exact, np.maximum(core[0][x], core[1][y])))

    edges = pairs.mapInPandas(run, _EDGES)
    while n > 1:
        n = -(-n // FAN)
        squares = edges.select((F.col("i") / FAN).cast("int").alias("i"), (F.col("k") / FAN).cast("int").alias("k"), "u", "v", "d")
        edges = written(squares.groupBy("i", "k").applyInPandas(_thinned, _EDGES), "tree-edges")
    return edges.groupBy("i", "k").applyInPandas(_thinned, _EDGES).select("u", "v", "d")


def _labels(u: np.ndarray, v: np.ndarray, distance: np.ndarray, min_size: int) -> np.ndarray:
    """Clusters of highest excess of mass in the condensed tree of the spanning tree's edges, which come sorted; -1 is noise.

    Parts that join at one distance join at once, so the result does not depend on the tree or on the order of its edges.
    Clusters are numbered by their first member.
    """
    n = len(u) + 1
    out = np.full(n, -1)
    if n < 2 * min_size:
        return out
    # Single linkage: node n + j joins two subtrees or more at ``at[j]``.
    roots, top, size, parts, at = _Roots(n), list(range(n)), [1] * n, [], []
    for a, b, d in zip(u.tolist(), v.tolist(), distance.tolist()):
        a, b = roots(a), roots(b)
        x, y = sorted((top[a], top[b]), key=lambda z: (z >= n and at[z - n] == d, size[z]), reverse=True)
        if x >= n and at[x - n] == d:
            parts[x - n] += parts[y - n] if y >= n and at[y - n] == d else [y]
            size[x] += size[y]
        else:
            parts.append([x, y])
            at.append(d)
            size.append(size[x] + size[y])
            x = n + len(parts) - 1
        roots.join(a, b)
        top[min(a, b)] = x

    def leaves(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            else:
                todo += parts[x - n]
        return found

    # Condense from the top: a split is real if two parts or more are large enough, else the small ones' points fall out.
    birth, stability, children, points = [0.0], [0.0], [[]], [[]]
    stack = [(top[0], 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            points[cluster].append(node)
            continue
        level = 1 / max(at[node - n], LEAST)
        large = [x for x in parts[node - n] if size[x] >= min_size]
        fall = [x for x in parts[node - n] if size[x] < min_size]
        for x in fall:
            points[cluster] += leaves(x)
        if len(large) == 1:
            stability[cluster] += sum(size[x] for x in fall) * (level - birth[cluster])
            stack.append((large[0], cluster))
            continue
        stability[cluster] += size[node] * (level - birth[cluster])
        for x in large:
            children[cluster].append(len(birth))
            stack.append((x, len(birth)))
            birth.append(level)
            stability.append(0.0)
            children.append([])
            points.append([])
    best, chosen = list(stability), [False] * len(birth)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(best[k] for k in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        best[c] = max(stability[c], below)
    groups, todo = [], list(children[0])
    while todo:
        c = todo.pop()
        if not chosen[c]:
            todo += children[c]
            continue
        members, deep = [], [c]
        while deep:
            k = deep.pop()
            members += points[k]
            deep += children[k]
        groups.append(members)
    for number, members in enumerate(sorted(groups, key=min)):
        out[members] = number
    return out


def hdbscan(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int = 2, block: int = TREE_BLOCK) -> DataFrame:
    """(vec_id, label) of every vector that has a core distance, for any number of vectors.

    Distances and the spanning tree are distributed; one task gets the tree's edges, 24 bytes a vector, and labels them.
    """
    cores = core_distances(vectors, min_samples).where("core IS NOT NULL")
    with_core = written(vectors.join(cores, "vec_id").select("vec_id", "embedding", "core"), "vectors-with-cores")

    def run(batches):
        for pdf in batches:
            for row in range(len(pdf)):
                u, v, d = _edges(pdf.iloc[row : row + 1])
                ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
                yield pd.DataFrame({"vec_id": ids, "label": _labels(ends[: len(u)], ends[len(u) :], d, min_cluster_size).astype(np.int32)})

    found = spanning_tree(with_core, block).mapInPandas(run, "vec_id long, label int")
    lone = F.coalesce("label", F.lit(-1)).alias("label")
    return with_core.select("vec_id").join(written(found, "labels"), "vec_id", "left").select("vec_id", lone)

"""Near-duplicate documents by Order MinHash and banded alignment.

A k-mer is five consecutive words (in lower case) with its occurrence number in the text.  For each of
``SKETCHES`` hash orders the two smallest k-mers are taken and kept in the order in which the text has them,
so a sketch agrees for texts that are similar under edits, not for those that merely share parts.  Equal
texts are one node.  Nodes that share a sketch (a bucket) are candidates; they are linked if a banded
bit-parallel alignment of their words leaves at most a fifth of the longer text's words different
(similarity 0.8 or more).  Classes are the connected components.

Every pair of candidates is connected or was found dissimilar, in two passes:

1. Every node of a bucket is aligned with the bucket's smallest node (its hub); components follow.
2. In buckets whose nodes are not connected by then, the nodes outside the bucket's largest component meet each
   other, and they meet that component (its nodes are sent once for all buckets).  Both are cut into cells of two blocks
   of about as many nodes.  Buckets that have much the same nodes (those of a passage that many texts share) are one.  Lengths and bags of words (128 counters: an edit changes
   at most two by one) rule out nearly all pairs; what is left is aligned in the cell's task, likeliest first,
   and pairs that became connected meanwhile are left out.  A pair that shares several buckets is aligned
   in one of them.  Tasks return links only, fewer than a cell has components: no list of pairs exists.

Defined results for odd input: null texts and texts without a word are classes of their own; texts of fewer
than five words have one k-mer, all their words; equal texts are one class whatever their ids; repeated rows
share the class; a null id joins its text's class but never names it; an empty table gives an empty table.
Equality of texts is judged by 128 bits; words are compared by 32-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, table, unused, with_row_key, written

K_WORDS = 5
SIMILARITY = 0.8
SKETCHES = 128
SEED = 20_240_517
#: Sketches whose buckets are formed at once; it bounds what is on disk.
SKETCHES_AT_ONCE = 32
#: Counters of the bag of words that rules pairs out before words are fetched.
BAG = 128
#: Nodes of one block: a task looks at two blocks at a time, first at their bags of words, then (of those that are left) at their words.
BAG_BLOCK, WORD_BLOCK = 4096, 256
#: Times that open buckets are joined to those that have much the same nodes.
JOINS = 3
#: Edges of one hub that a task takes before its words are sent to another one too.
EDGES_PER_HUB = 512

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


class WordHashes:
    """64-bit hashes of a text's words, by prefix sums of a polynomial in the bytes."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[_U(1), np.full(n, self.BASE, _U)])
            self.down = np.cumprod(np.r_[_U(1), np.full(n, self.INVERSE, _U)])

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        n = len(data)
        if n >= len(self.up):
            self._grow(2 * n + 1024)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.r_[_U(0), np.cumsum(data.astype(_U) * self.up[:n], dtype=_U)]
            return _mix((total[end] - total[start]) * self.down[start])


def k_mers(words: np.ndarray, k: int = K_WORDS) -> np.ndarray:
    """Hashes of all runs of k words (all words, if fewer), each with its occurrence number."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        width = min(k, n)
        x = np.zeros(n - width + 1, _U)
        for i in range(width):
            x = (x + words[i : n - width + 1 + i]) * _U(0xD6E8FEB86659FD93)
        x = _mix(x)
        order = np.argsort(x, kind="stable")
        s = x[order]
        same = np.r_[False, s[1:] == s[:-1]]
        if same.any():
            at = np.arange(len(s))
            number = np.empty(len(s), _U)
            number[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(_U)
            x = _mix(x + number * _U(0xA0761D6478BD642F))
    return x


def order_min_hash(x: np.ndarray, sketches: int = SKETCHES, seed: int = SEED) -> np.ndarray:
    """One value for each hash order: its two smallest k-mers, hashed in text order."""
    random = np.random.default_rng(seed)
    flip = random.integers(0, 1 << 63, sketches, dtype=np.uint64)
    times = random.integers(0, 1 << 63, sketches, dtype=np.uint64) | _U(1)
    with np.errstate(over="ignore"):
        rank = (x[None, :] ^ flip[:, None]) * times[:, None]
        rank ^= rank >> _U(29)
        rows = np.arange(sketches)
        one = rank.argmin(1)
        if len(x) > 1:
            rank[rows, one] = ~_U(0)
            two = rank.argmin(1)
        else:
            two = one
        first, second = np.minimum(one, two), np.maximum(one, two)
        return _mix(_mix(x[first]) * _U(3) + x[second]).view(np.int64)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    Bit-parallel over the band of diagonals within ``most`` of the main one: bit w of a vector is row
    ``j - most + w`` of column j, so the band moves down one row a column.
    """
    lo, hi = 0, 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n or not most:
        return m if m <= most else most + 1
    most_here = min(most, m)
    width = 2 * most_here + 1
    full = (1 << width) - 1
    places: dict = defaultdict(int)
    for i, x in enumerate(a):  # row i is bit i + most_here
        places[x] |= 1 << (i + most_here)
    vp, vn, score = (full << most_here) & full, 0, most_here
    top, bottom = 1 << (width - 1), 1 << (width - 2)
    limit = most + n - (m - most_here)  # the score can fall by one a column in the last row
    for j, y in enumerate(b):
        hit = (places.get(y, 0) >> j) & full
        d0 = ((((hit & vp) + vp) ^ vp) | hit | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < m - most_here:
            score += not d0 & top
        else:
            score += bool(hp & bottom) - bool(hn & bottom)
            bottom >>= 1
        if score > limit:
            return most + 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return score if score <= most else most + 1


def most_edits(longest: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * longest + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = most_edits(longest, similarity)
    # An edit leaves all but two pairs of neighbours as they are: with too few in common there is nothing to align.
    needed = longest - 1 - 2 * most
    if abs(len(a) - len(b)) > most or (needed > 0 and len(np.intersect1d(k_mers(a.astype(_U), 2), k_mers(b.astype(_U), 2), assume_unique=True)) < needed):
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def bag_of(words: np.ndarray) -> np.ndarray:
    """Counts of words by hash, none above 255: two texts' bags differ by at most two for an edit."""
    return np.minimum(np.bincount(words % np.uint32(BAG), minlength=BAG), 255).astype(np.uint8)


def _length_near(x: str, y: str, similarity: float) -> F.Column:
    return F.abs(F.col(x) - F.col(y)) <= F.floor((1 - similarity) * F.greatest(x, y) + 1e-9)


SKETCH_SCHEMA = "row_id long, doc_id long, h1 long, h2 long, n_words int, words binary, bag binary, sketch array<long>"


def sketch_table(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """A row of ``SKETCH_SCHEMA`` for every row (doc_id, text); row ids (task and place) hold once it is written."""
    names = [f.split()[0] for f in SKETCH_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            words, bags, counts, values = [], [], [], []
            for v in batch.column(3):
                full = hashes(v.as_py() or "")
                short = (full >> _U(32)).astype(np.uint32)
                counts.append(len(full))
                words.append(short.tobytes())
                bags.append(bag_of(short).tobytes())
                values.append(order_min_hash(k_mers(full), sketches) if len(full) else np.empty(0, np.int64))
            offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))
            ids = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[:3], pa.array(counts, pa.int32()), pa.array(words, pa.binary()), pa.array(bags, pa.binary()), arrays], names)

    slim = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return slim.mapInArrow(run, SKETCH_SCHEMA)


def _buckets(s: Scratch, nodes: DataFrame, sketches: int) -> DataFrame:
    """``key, node, hub`` of all buckets of two nodes or more; the hub is the smallest node."""
    parts = []
    for at in range(0, sketches, SKETCHES_AT_ONCE):
        some = F.slice("sketch", at + 1, SKETCHES_AT_ONCE)
        spread = nodes.select("node", F.posexplode(some).alias("i", "v")).select("node", F.xxhash64(F.col("i") + at, "v").alias("key"))
        several = spread.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
        parts.append(s.written(spread.join(several.hint("merge"), "key").select("key", "node", "hub"), "buckets"))
        s.drop()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _hub_links(s: Scratch, edges: DataFrame, details: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, hub) that are similar.  A hub's words go once to every task that has up to ``EDGES_PER_HUB`` of its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            a, b = [], []
            for own, node, words in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), batch.column("words")):
                data = np.frombuffer(words.as_buffer(), np.uint32)
                if node == own:
                    hub, held = own, data.copy()
                elif own != hub:
                    raise ValueError("an edge came without its hub")
                elif similar(data, held, similarity):
                    a.append(node)
                    b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    size = details.select("node", "n_words")
    sized = edges.join(size.withColumnRenamed("n_words", "n"), "node").join(size.select(F.col("node").alias("hub"), F.col("n_words").alias("hub_n")), "hub")
    near = s.written(sized.where(_length_near("n", "hub_n", similarity)).select("node", "hub"), "near-edges")
    many = near.groupBy("hub").agg(F.ceil(F.count("*") / EDGES_PER_HUB).alias("parts"))
    dealt = s.written(near.join(many, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part")), "dealt-edges")
    sides = dealt.withColumn("side", F.lit(1)).union(dealt.select(F.col("hub").alias("node"), "hub", "part").distinct().withColumn("side", F.lit(0)))
    with_words = sides.join(details.select("node", "words").hint("merge"), "node")
    return s.written(with_words.repartition("hub", "part").sortWithinPartitions("hub", "part", "side").select("hub", "node", "words").mapInArrow(run, "a long, b long"), "hub-links")


def _joined(s: Scratch, groups: DataFrame, at: int) -> DataFrame:
    """``key, node, label, mark`` of fewer groups: those with the same smallest hashed mark are one.

    Two groups have the same smallest mark with the probability of their overlap (nodes of both to nodes of either).  Each group is kept
    whole, so all pairs still meet; groups stay apart where one would have more pairs to compare than they have together.
    """
    least = groups.groupBy("key").agg(F.min(F.xxhash64(F.lit(at), "mark")).alias("to"), F.count("*").alias("n"))
    moved = s.written(groups.join(least, "key"), "moved-groups")
    apart = least.groupBy("to").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    both = moved.groupBy("to").agg(F.count_distinct("node").cast("double").alias("n")).select("to", (F.col("n") * F.col("n")).alias("both"))
    fewer = apart.join(both, "to").where("both <= apart").select(F.col("to").alias("joint"))
    key = F.coalesce("joint", "key").alias("key")
    return s.written(moved.join(fewer, F.col("to") == F.col("joint"), "left").select(key, "node", "label", "mark").distinct(), "joined-groups")


def _open_groups(s: Scratch, members: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """What is to meet: ``kind, key, node, label`` with the group's ``others`` and ``most``, and ``own``.

    A bucket is open if its nodes are not all connected; its others are those outside its largest component (all, if that
    is a lone node).
    Kind 0: the others of a bucket, or of several that `_joined` made one (``key``), meet each other.  Kind 1: all others that some bucket has beside a
    component (``key``) meet the nodes of that component (not ``own``), each sent once and not once a bucket.
    """
    known = s.written(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("lone")), "labelled")
    counts = known.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("lone").alias("lone"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label", "lone")).alias("top"))
    sizes = sizes.where(F.col("total") > F.col("top.n")).select(F.col("key").alias("bucket"), F.when(~F.col("top.lone"), F.col("top.label")).alias("main"))
    others = known.join(sizes, (F.col("key") == F.col("bucket")) & (F.col("main").isNull() | (F.col("label") != F.col("main"))))
    others = s.written(others.select("key", "node", "label", "main"), "others")
    beside = s.written(others.where("main IS NOT NULL").select("main", "node", "label").distinct(), "beside")
    several = others.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    first = others.select("key", "node", "label").join(several, "key").join(marks, "node").select("key", "node", "label", "mark")
    for at in range(JOINS):
        first = _joined(s, first, at)
    none = F.lit(0).cast("long")
    sized = first.groupBy("key").agg(F.count("*").alias("others"))
    first = first.join(sized, "key").select(F.lit(0).alias("kind"), "key", "node", "label", "others", none.alias("most"), F.lit(True).alias("own"))
    mains = beside.groupBy("main").agg(F.count("*").alias("others"))
    held = mains.join(labels.select("node", "label"), F.col("main") == F.col("label"), "left").select("main", F.coalesce("node", "main").alias("node"), "others")
    held = s.written(held, "main-nodes")
    sized = s.written(held.groupBy("main").agg(F.count("*").alias("most"), F.max("others").alias("others")), "main-sizes")
    columns = [F.lit(1).alias("kind"), F.col("main").alias("key"), "node", "label", "others", "most", "own"]
    second = beside.withColumn("own", F.lit(True)).unionByName(held.select("main", "node", F.col("main").alias("label"), F.lit(False).alias("own")))
    return s.written(first.union(second.join(sized, "main").select(*columns)), "open-groups")


def _cells(groups: DataFrame, block_nodes: int) -> DataFrame:
    """Adds ``i, k, block``: the cells a node goes to and its own block.

    Blocks 0 to ``others / block_nodes`` hold the others, the rest the component of a group of kind 1.  Cells are all
    pairs of blocks to be compared; a small group of kind 1 is one cell of two blocks.
    """
    blocks = lambda n: F.ceil(F.col(n) / block_nodes).cast("int")
    out = groups.withColumn("no", blocks("others")).withColumn("nb", blocks("most"))
    hashed = F.xxhash64("node")
    out = out.withColumn("block", F.when(F.col("own"), F.pmod(hashed, "no")).otherwise(F.col("no") + F.pmod(hashed, F.greatest("nb", F.lit(1)))).cast("int"))
    cells = F.expr(
        "CASE WHEN kind = 1 AND own THEN transform(sequence(no, no + nb - 1), x -> named_struct('i', block, 'k', x)) "
        "WHEN kind = 1 THEN transform(sequence(0, no - 1), x -> named_struct('i', x, 'k', block)) "
        "ELSE transform(sequence(0, no - 1), x -> named_struct('i', least(x, block), 'k', greatest(x, block))) END"
    )
    return out.withColumn("cell", F.explode(cells)).select("kind", "key", "cell.i", "cell.k", "block", "node", "label")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``n_keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            now = tuple(keys[:, x])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _possible(cell: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (x, y) of a cell, in different components, that length and bag do not rule out, and how far their bags are off."""
    label, n, block = (cell.column(c).to_numpy() for c in ("label", "n_words", "block"))
    bags = np.frombuffer(b"".join(cell.column("bag").to_pylist()), np.uint8).reshape(len(n), BAG).astype(np.int16)
    i = cell.column("i")[0].as_py()
    alone = i == cell.column("k")[0].as_py()
    out = []
    for x in np.flatnonzero(block == i):
        y = np.arange(x + 1, len(n)) if alone else np.flatnonzero(block != i)
        most = np.floor((1 - similarity) * np.maximum(n[x], n[y]) + 1e-9)
        near = (label[y] != label[x]) & (np.abs(n[y] - n[x]) <= most)
        y, most = y[near], most[near]
        if len(y):
            off = np.abs(bags[y] - bags[x]).sum(1)
            fits = off <= 2 * most
            out.append((np.full(fits.sum(), x), y[fits], off[fits] / np.maximum(2 * most[fits], 1)))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _align_cell(cell: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links of a cell that connect what is similar; others that share a smaller bucket too are left to it."""
    x, y, off = _possible(cell, similarity)
    if not len(x):
        return []
    flat = np.empty(0, np.int64)
    if cell.column("kind")[0].as_py() == 0:
        own = cell.column("key")[0].as_py()
        lists = cell.column("keys").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        row, flat = row[flat < own], flat[flat < own]
    if len(flat):
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        row, at = row[shared], at[shared]
        _, at = np.unique(at, return_inverse=True)
        if len(at):
            holds = np.zeros((len(sizes), at.max() + 1), np.float32)
            holds[row, at] = 1
            fresh = (holds @ holds.T)[x, y] == 0
            x, y, off = x[fresh], y[fresh], off[fresh]
    node, label = cell.column("node").to_numpy(), cell.column("label").to_pylist()
    words = [np.frombuffer(w.as_buffer(), np.uint32) for w in cell.column("words")]
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while (up := parent.get(a, a)) != a:
            a = up
        return a

    links = []
    for at in np.argsort(off, kind="stable").tolist():
        p, q = int(x[at]), int(y[at])
        a, b = root(label[p]), root(label[q])
        if a != b and similar(words[p], words[q], similarity):
            parent[max(a, b)] = min(a, b)
            links.append((int(node[p]), int(node[q])))
    return links


def _cell_links(s: Scratch, groups: DataFrame, details: DataFrame, similarity: float) -> DataFrame:
    """Links that connect all that is similar among the groups of `_open_groups`."""
    cell_keys = ["kind", "key", "i", "k"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, len(cell_keys)):
            x, y, _ = _possible(cell, similarity)
            at = np.unique(np.concatenate([x, y]))
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(cell.column(c)[0], len(at)) for c in ("kind", "key")), pa.array(cell.column("node").to_numpy()[at])], ["kind", "key", "node"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, len(cell_keys)):
            if links := _align_cell(cell, similarity):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    def dealt(cells: DataFrame) -> DataFrame:
        return cells.repartition(*cell_keys).sortWithinPartitions(*cell_keys)

    slim = details.select("node", "n_words", "bag").hint("merge")
    first = _cells(groups, BAG_BLOCK).join(slim, "node").select(*cell_keys, "block", "node", "label", "n_words", "bag")
    # A node that is possible in several cells of a group is listed once for the group.
    possible = s.written(dealt(first).mapInArrow(find, "kind int, key long, node long").distinct(), "possible")
    s.drop()
    again = s.written(groups.drop("others", "most").join(possible, ["kind", "key", "node"]), "possible-members")
    sizes = again.groupBy("kind", "key").agg(F.count_if("own").alias("others"), F.count_if(~F.col("own")).alias("most"))
    again = again.join(sizes, ["kind", "key"])
    keys = possible.where("kind = 0").groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most one a sketch
    wanted = possible.select("node").distinct().join(keys, "node", "left")
    full = s.written(details.join(wanted, "node").withColumn("keys", F.coalesce("keys", F.expr("CAST(array() AS array<bigint>)"))), "possible-details")
    second = _cells(again, WORD_BLOCK).join(full.hint("merge"), "node").select(*cell_keys, "block", "node", "label", "n_words", "bag", "words", "keys")
    return s.written(dealt(second).mapInArrow(align, "a long, b long"), "cell-links")


def near_duplicate_links(s: Scratch, nodes: DataFrame, full: DataFrame, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """Links (a, b) between nodes (node, sketch): each pair that shares a sketch is connected by them or dissimilar.

    ``full`` has ``node, n_words, words, bag`` of all nodes.
    """
    members = _buckets(s, nodes, sketches)
    edges = s.written(members.where("node <> hub").select("node", "hub").distinct(), "hub-edges")
    involved = edges.select("node").union(edges.select(F.col("hub").alias("node"))).distinct()
    s.drop(nodes)
    details = s.written(full.join(involved.hint("merge"), "node").withColumn("mark", F.xxhash64("words")), "details")
    s.drop()
    links = _hub_links(s, edges, details, similarity)
    s.drop(edges)
    open_groups = _open_groups(s, members.select("key", "node"), components(links), details.select("node", "mark"))
    s.drop(*[t for t, path in s.held if "/buckets-" in path])
    return links.union(_cell_links(s, open_groups, details, similarity))


def near_duplicate_classes(df: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """``doc, class_id`` of every row: the smallest id of the documents it is connected to."""
    docs = df.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    with Scratch(df.sparkSession) as s:
        sketched = s.written(sketch_table(docs, sketches), "sketches")
        rows = s.written(sketched.select("row_id", "doc_id", "h1", "h2", "n_words"), "ids")
        wordy = rows.where("n_words > 0")
        # One row a text: the first; ``rep`` is the smallest id of its copies.
        groups = s.written(wordy.groupBy("h1", "h2").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("rep")), "texts")
        first = groups.select(F.col("node").alias("row_id")).hint("merge")
        nodes = s.written(sketched.select("row_id", "sketch").join(first, "row_id").select(F.col("row_id").alias("node"), "sketch"), "nodes")
        s.drop()
        full = sketched.select(F.col("row_id").alias("node"), "n_words", "words", "bag")
        links = s.written(near_duplicate_links(s, nodes, full, similarity, sketches), "near-links")
        s.drop(sketched)
        labels = components(links)
        names = labels.join(groups.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"))
        linked = labels.join(names, "label").select("node", "class_id")
        by_text = s.written(groups.join(linked, "node", "left").select("h1", "h2", F.coalesce("class_id", "rep").alias("class_id")), "text-classes")
        joined = rows.select("doc_id", "h1", "h2", "n_words").join(by_text, ["h1", "h2"], "left")
        out = joined.select(F.col("doc_id").alias(doc), F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
        return written(out, "near-classes")


def without_near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class: the one with the smallest id (null last), then the first; rows are told apart by a row key."""
    names = df.columns
    (row_key,) = unused(df, "row_key")
    keyed = with_row_key(df, row_key)
    classes = near_duplicate_classes(keyed, row_key, text, similarity).select(F.col(f"`{row_key}`").alias("key"), "class_id")
    several = classes.where("key <> class_id").select("class_id").distinct()
    members = classes.join(several, "class_id").join(keyed.select(F.col(f"`{row_key}`").alias("key"), F.col(f"`{doc}`").alias("doc")), "key")
    members = written(members, "class-members")
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key"))["key"].alias("kept"))
    gone = written(members.join(first, "class_id").where("key <> kept").select(F.col("key").alias(row_key)), "near-copies")
    return keyed.join(gone, row_key, "left_anti").select(*[F.col(f"`{c}`") for c in names])


def op3_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Equal vectors are one node that counts its copies. Each tree splits at the median of a random projection, and vectors
within MARGIN of a split go down both sides; the trees are fitted on a bounded sample (about SAMPLE vectors, by the hash
of their id) and every vector is sent down all of them. A leaf that holds too many vectors is split on, by planes of its
own and medians that Spark aggregates, until it is small or a split no longer helps, as in a dense ball. Vectors are
compared within leaves, in blocks where a leaf is still large, so a block's rows are bounded. A pair counts in the first
leaf that its two vectors share, so numbers of links are exact without keeping pairs; a leaf gives its vectors' counts
and one edge each to its local component.

Cosines are of doubles; vectors are scaled by their largest component first, so neither tiny nor huge ones lose theirs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do
rows without a vec_id (component null, kept false); only vectors of one dimension are compared; rows that repeat link
with each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.llm.components import components

#: Least cosine of a link; trees; vectors that they are fitted on, about; vectors of a leaf aimed at; sample vectors of a leaf at least.
COSINE, TREES, SAMPLE, LEAF, FEWEST = 0.95, 10, 20_000, 384, 8
#: Numbers of the sample at most, so that long vectors give fewer; 1,000 of them at least.
NUMBERS = 1 << 23
#: Projections (of deviation 1 about) this close to a split go down both sides; a split helps if its sides hold at most this share.
MARGIN, HELPS = 0.12, 0.8
#: Vectors of a block; leaves that may be broadcast.
BLOCK, SENDABLE = 1500, 500_000


class Tree:
    """Splits in arrays: a node's plane, its median, its children; a leaf's child is -1 less its number."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.planes, self.middles, self.kids, self.leaves = [], [], [], 0
        self.root = self._grow(sample, leaf, rng)
        self.planes = np.array(self.planes, np.float32).reshape(-1, sample.shape[1])

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(x) > leaf:
            plane = rng.standard_normal(x.shape[1]).astype(np.float32)
            p = x @ plane
            middle = float(np.median(p))
            left, right = p <= middle + MARGIN, p >= middle - MARGIN
            if max(left.sum(), right.sum()) <= HELPS * len(x):
                at = len(self.planes)
                self.planes.append(plane)
                self.middles.append(middle)
                self.kids.append(None)
                self.kids[at] = (self._grow(x[left], leaf, rng), self._grow(x[right], leaf, rng))
                return at
        self.leaves += 1
        return -self.leaves

    def send(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that they reach; a row may reach several."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -1 - node))
                continue
            p = x[at] @ self.planes[node]
            todo += [(self.kids[node][0], at[p <= self.middles[node] + MARGIN]), (self.kids[node][1], at[p >= self.middles[node] - MARGIN])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, int), np.empty(0, int))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in doubles."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(sample: np.ndarray, total: int, trees: int = TREES, seed: int = 11) -> list[Tree]:
    """Trees whose leaves hold about LEAF of all vectors, as far as the sample can tell."""
    x = unit(sample).astype(np.float32)
    leaf = max(FEWEST, int(LEAF * len(x) / max(1, total)))
    return [Tree(x, leaf, np.random.default_rng([seed, t])) for t in range(trees)]


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """Nodes: rep (smallest vec_id), m (rows), dim, vector (packed) of each distinct usable vector."""
    nodes = vectors.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, kind).tobytes() for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([len(r) // np.dtype(kind).itemsize for r in raw], pa.int32()), pa.array(raw, pa.binary()), b.column(3), b.column(4)], names=["rep", "m", "dim", "vector", "k1", "k2"])

    keyed = nodes.select("embedding", "rep", "m", *_keys())
    return keyed.mapInArrow(pack, f"rep {vectors.schema['vec_id'].dataType.simpleString()}, m long, dim int, vector binary, k1 long, k2 long")


def _keys() -> list:
    return [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2")]


def _comparer(kind: str):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one block pair of a leaf: for each vector the copies it links with here, and a vector of its local component."""
        leaf = int(pdf["leaf"].iloc[0])
        x = unit(_matrix(pdf["vector"].tolist(), kind))
        rep, m, side, leaves = pdf["rep"].to_numpy(), pdf["m"].to_numpy(), pdf["side"].to_numpy(), pdf["leaves"].to_numpy()
        links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
        cross = (side != side[0]).any()
        bits: np.ndarray | None = None

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(x), 256):
            i, j = np.nonzero(x[at : at + 256] @ x[at:].T >= COSINE)
            i, j = i + at, j + at
            ok = (i < j) & ((side[i] != side[j]) if cross else True)
            i, j = i[ok], j[ok]
            if len(i) and bits is None:
                # Earlier leaves of each vector, a bit for each leaf that occurs: two share one where their bits meet.
                row = np.repeat(np.arange(len(x)), [len(v) for v in leaves])
                of = np.concatenate(leaves)
                row, of = row[of < leaf], of[of < leaf]
                number = np.unique(of, return_inverse=True)[1]
                bits = np.zeros((len(x), int(number.max(initial=0)) // 64 + 1), np.uint64)
                np.bitwise_or.at(bits, (row, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                new = ~(bits[a] & bits[b]).any(1)
                a, b = a[new], b[new]
                np.add.at(links, a, m[b])
                np.add.at(links, b, m[a])
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        some = np.nonzero(links)[0]
        return pd.DataFrame({"rep": rep[some], "links": links[some], "to": rep[[root(i) for i in some.tolist()]] if len(some) else rep[some]})

    return compare


def _split_on(sent: DataFrame, kind: str) -> DataFrame:
    """sent (rep, m, vector, leaves) with leaves of over BLOCK vectors split on, level by level, while that helps.

    A leaf's plane is drawn from its number, its median and the sizes of its sides are aggregates: nothing comes to the driver but counts.
    """
    rows = sent.select("rep", F.explode("leaves").alias("leaf"))
    vectors, done, final, level = sent.select("rep", "vector"), [], None, 0
    while True:
        large = rows.groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf")
        large = written(large if final is None else large.join(final, "leaf", "left_anti"), "forest-large")
        n = large.count()
        if not n:
            break
        few = F.broadcast(large) if n <= SENDABLE else large

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, p = unit(_matrix(b.column(2).to_pylist(), kind)) if b.num_rows else None, np.zeros(b.num_rows)
                leaves = b.column(1).to_numpy()
                for leaf in np.unique(leaves):
                    at = leaves == leaf
                    p[at] = x[at] @ np.random.default_rng([17, int(leaf)]).standard_normal(x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["rep", "leaf", "p"])

        inside = rows.join(few, "leaf").join(vectors, "rep").select("rep", "leaf", "vector")
        inside = written(inside.mapInArrow(project, f"rep {rows.schema['rep'].dataType.simpleString()}, leaf long, p double"), "forest-inside")
        cut = inside.groupBy("leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("middle"))
        left, right = F.col("p") <= F.col("middle") + MARGIN, F.col("p") >= F.col("middle") - MARGIN
        placed = inside.join(F.broadcast(cut) if n <= SENDABLE else cut, "leaf")
        size = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count(F.when(left, 1)).alias("a"), F.count(F.when(right, 1)).alias("b"))
        size = written(size.select("leaf", (F.greatest("a", "b") <= HELPS * F.col("n")).alias("helps")), "forest-sizes")
        helped, stuck = size.where("helps").select("leaf"), size.where("not helps").select("leaf")
        final = stuck if final is None else final.unionByName(stuck)
        # Children get numbers of their own, far from those of the trees.
        child = lambda side: F.shiftrightunsigned(F.xxhash64("leaf", F.lit(side), F.lit(level)), 2).bitwiseOR(F.lit(1 << 62))
        kids = placed.join(F.broadcast(helped) if n <= SENDABLE else helped, "leaf").select("rep", F.explode(F.array_compact(F.array(F.when(left, child(0)), F.when(right, child(1))))).alias("leaf"))
        rows = written(rows.join(F.broadcast(helped) if n <= SENDABLE else helped, "leaf", "left_anti").unionByName(kids), "forest-rows")
        level += 1
    if not level:
        return sent
    leaves = rows.groupBy("rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return written(sent.drop("leaves").join(leaves, "rep").select("rep", "m", "vector", "leaves"), "forest-leaves")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings."""
    spark = embeddings.sparkSession
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    narrow = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if narrow else "<f8"
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = written(_packed(vectors, kind), "forest-nodes")
    totals = {r.dim: r["count"] for r in nodes.groupBy("dim").count().orderBy("dim").collect()}
    seen: DataFrame | None = None
    for dim, total in totals.items():
        own = nodes.where(F.col("dim") == dim)
        drawn = F.shiftrightunsigned(F.xxhash64("rep", F.lit(23)), 33) * F.lit(float(total)) < F.lit(float(min(SAMPLE, max(1000, NUMBERS // dim)) << 31))
        sample = _matrix([r.vector for r in own.where(drawn).select("rep", "vector").orderBy("rep").select("vector").collect()], kind)
        forest = spark.sparkContext.broadcast(fitted(sample.reshape(-1, dim), total))

        def send(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(_matrix(b.column(2).to_pylist(), kind)).astype(np.float32)
                found = [(r, leaf + (t << 32)) for t, tree in enumerate(forest.value) for r, leaf in [tree.send(x)]]
                row, leaf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(leaf, pa.int64()))], names=["rep", "m", "vector", "leaves"])

        sent = written(own.select("rep", "m", "vector").mapInArrow(send, f"rep {id_type}, m long, vector binary, leaves array<long>"), "forest-leaves")
        sent = _split_on(sent, kind)
        placed = sent.select("rep", "m", "vector", "leaves", F.explode("leaves").alias("leaf"))
        # What is still large is a dense ball; its blocks meet each other.
        blocks = written(placed.groupBy("leaf").count().where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "forest-blocks")
        placed = placed.join(F.broadcast(blocks) if blocks.count() <= SENDABLE else blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other"))
        # Two blocks meet once; a block meets itself once.
        met = placed.groupBy("leaf", "p", "q").applyInPandas(_comparer(kind), f"rep {id_type}, links long, to {id_type}")
        seen = met if seen is None else seen.unionByName(met)
    plain = vectors.select("vec_id", "usable", *_keys())
    if seen is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    seen = written(seen, "forest-links")
    label = components(seen, "rep", "to")
    links = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    of = nodes.select("rep", "m", "k1", "k2").join(links, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    of = of.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = plain.where("usable").join(of, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = plain.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

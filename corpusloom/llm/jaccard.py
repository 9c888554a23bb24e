"""N-gram Jaccard join by a grouped prefix join, exact.

Documents with one set of shingles are one class. A class can link only if at least 0.8 of its shingles are in other
classes too, so those of which more than a fifth occur nowhere else are set aside first: each task packs the shingles
of a fixed part of the hash space, 4 bytes and an owner's number each, and what occurs once is counted back to its owner.

Shingles of the classes that are left have one total order, rare ones first: by the count of their cell in a table of
fixed size, then by their number. Two sets of at least the threshold share a shingle among the first fifth of each.
Classes with the same prefix and size make one group; groups that share a prefix shingle are paired where sizes and
places allow the threshold; group pairs are expanded to their distinct sets and verified. Shingles that the same
groups hold in their prefixes are one list.

What is asked for are components, so a pair within one component needs no look: of the groups of a list, one pivot is
paired with all others, and what is still apart is taken up again with other pivots, until the lists are empty or, after
PIVOTS rounds, as all pairs of what little is left. No link between different components is lost, and large groups of
near copies cost about their size.

Defined cases: texts without words, or null, have empty sets and are alone; fewer than five words are one shingle;
rows that share a doc_id and a text are one document, rows that share a doc_id only have a class each; rows without a
doc_id are alone, their component null; extra columns are ignored. Sets are told apart by 128 bits of hashes,
by 64 of them where links are sought.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import dropped, parts_for, small_batches, written
from corpusloom.llm.components import forest, with_roots
from corpusloom.llm.shingles import mixed, overlap, shingle_set

#: Cells of the table of counts, a power of two, and the pieces that it is summed in.
CELL_BITS, PIECES = 22, 64
#: Shingles from this hash on, two fifths of all, tell whether a class is apart; how many, and how many classes, a task packs at once.
PROBE, CHUNK, OWNERS = int(0.6 * 2**64), 1 << 20, 60_000
#: Rounds with pivots; ids that may be broadcast; longs of a set's parity bits.
PIVOTS, SENDABLE, PARITY = 4, 500_000, 4
BITS = [f"b{i}" for i in range(PARITY)]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many documents hold the shingles of each cell. The table has 2**CELL_BITS cells whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            cells = _cell(np.concatenate(sets)) if sets else np.empty(0, np.int64)
            np.add.at(total, cells, 1)
        if total.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                totals[piece] = totals[piece] + part if piece in totals else part
        if totals:
            kept = {k: np.minimum(v, 2**32 - 1).astype(np.uint32) for k, v in totals.items()}
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in kept.values()], pa.binary())], names=["piece", "counts"])

    shape = "piece int, counts binary"
    partial = docs.select(F.col("text").cast("string")).mapInArrow(count, shape)
    table = np.zeros((PIECES, (1 << CELL_BITS) // PIECES), np.uint32)
    for r in partial.repartition(PIECES, "piece").mapInArrow(add, shape).collect():
        table[r.piece] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return table.reshape(-1)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(mixed(s, 1).sum(dtype=np.uint64)), int(mixed(s, 2).sum(dtype=np.uint64))


def _long(x: list | np.ndarray) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def packed_sets(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of three kinds: of a document (doc_id, n, c1, c2); of a chunk of a task's classes (chunk, owners: their c1 and n);
    of a chunk's shingles in a part of the hash space (part, chunk, tokens: 32 bits each, owners: 16 bits each).

    A chunk is named by a hash of its classes, so one that is made anew from other rows can only count too few.
    """
    id_type = docs.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("n", "c1", "c2")), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("owners", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        owners: dict[int, int] = {}
        sizes: list[int] = []
        probes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            names = np.fromiter(owners, np.uint64, len(owners))
            chunk = np.array([mixed(names + mixed(np.arange(len(names), dtype=np.uint64), 5), 6).sum(dtype=np.uint64)]).view(np.int64)[0]
            h = np.concatenate(probes)
            of = np.repeat(np.arange(len(probes), dtype=np.uint16), [len(p) for p in probes])
            part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            low, of, ends = h[order].astype(np.uint32), of[order], np.cumsum(np.bincount(part, minlength=parts))
            some = np.nonzero(np.diff(ends, prepend=0))[0]
            cut = lambda x: [x[0 if p == 0 else ends[p - 1] : ends[p]].tobytes() for p in some]
            n = len(some) + 1
            lone = [np.concatenate([names, np.array(sizes, np.uint64)]).tobytes()]
            owners.clear(), sizes.clear(), probes.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(n, kinds), *[pa.nulls(n, pa.int64())] * 3, pa.array([None, *some.tolist()], pa.int32()), pa.array(np.full(n, chunk)), pa.array([None, *cut(low)], pa.binary()), pa.array(lone + cut(of), pa.binary())], names=shape.fieldNames())

        for batch in batches:
            kinds = batch.column(0).type
            n, c1, c2 = [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(t)
                a, b = _sums(s)
                n.append(len(s))
                c1.append(a)
                c2.append(b)
                if doc is not None and len(s) and a not in owners:
                    owners[a] = len(owners)
                    sizes.append(len(s))
                    probes.append(s[np.searchsorted(s, np.uint64(PROBE)) :])
                    held += len(probes[-1])
                    if held >= CHUNK or len(owners) >= OWNERS:
                        yield flush()
                        held = 0
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _long(c1), _long(c2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=shape.fieldNames())
        if owners:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, shape)


def not_apart(packed: DataFrame) -> DataFrame:
    """c1, n of the classes of which at most a fifth of the shingles are known to be in no other chunk's or task's class."""

    def lone(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
        t, ends = np.concatenate(tokens), np.cumsum([len(x) for x in tokens])
        order = np.argsort(t, kind="stable")
        t = t[order]
        differs = np.concatenate([[True], t[1:] != t[:-1], [True]])
        single = np.zeros(len(t), bool)
        single[order] = differs[1:] & differs[:-1]
        out, at = [], 0
        for end, o in zip(ends.tolist(), table.column("owners").to_pylist(), strict=True):
            counts = np.bincount(np.frombuffer(o, np.uint16)[single[at:end]])
            out.append(zlib.compress(np.minimum(counts, 65535).astype(np.uint16).tobytes(), 1))
            at = end
        return pa.table([table.column("chunk"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=["chunk", "counts", "owners"])

    def left(table: pa.Table) -> pa.Table:
        heads = [o for o in table.column("owners").to_pylist() if o is not None]
        if not heads:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["c1", "n"])
        names, sizes = np.frombuffer(heads[0], np.uint64).reshape(2, -1)
        total = np.zeros(len(names), np.int64)
        for c in table.column("counts").to_pylist():
            if c is not None:
                part = np.frombuffer(zlib.decompress(c), np.uint16)
                total[: len(part)] += part
        keep = 5 * total <= sizes.astype(np.int64)
        return pa.table([_long(names[keep]), _long(sizes[keep])], names=["c1", "n"])

    counted = packed.where("part is not null").select("part", "chunk", "tokens", "owners").groupBy("part").applyInArrow(lone, "chunk long, counts binary, owners binary")
    heads = packed.where("chunk is not null and part is null").select("chunk", F.lit(None).cast("binary").alias("counts"), "owners").dropDuplicates(["chunk"])
    return counted.unionByName(heads).groupBy("chunk").applyInArrow(left, "c1 long, n long").distinct()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """key (of the set), text: a task gives each set once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            keys, keep = [], []
            for t in batch.column(0).to_pylist():
                key = _sums(shingle_set(t))[0]
                keys.append(key)
                keep.append(key not in given)
                given.add(key)
            yield pa.RecordBatch.from_arrays([_long(keys), batch.column(0)], names=["key", "text"]).filter(pa.array(keep, pa.bool_()))

    return docs.select(F.col("text").cast("string")).mapInArrow(rows, "key long, text string").dropDuplicates(["key"])


def prefixes(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """key, n (set size), b0 .. (the set's parity bits), g (of prefix and size), prefix: empty where the task has given that of the group before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, given = shared.value, set()
        for batch in batches:
            n, g, lengths, values, bits = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                odd = np.bincount((mixed(s, 4) >> np.uint64(56)).astype(np.int64), minlength=64 * PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
                take = s[np.lexsort((s, table[_cell(s)]))[: len(s) // 5 + 1]] if len(s) else s
                key = int(mixed(mixed(take, 3) + np.arange(len(take), dtype=np.uint64), len(s)).sum(dtype=np.uint64))
                g.append(key)
                if key in given:
                    take = take[:0]
                given.add(key)
                lengths.append(len(take))
                values.append(take)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            flat = pa.array(np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64))
            b = np.array(bits, np.uint64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[_long(b[:, i]) for i in range(PARITY)], _long(g), pa.ListArray.from_arrays(offsets, flat)], names=["key", "n", *BITS, "g", "prefix"])

    return texts.select("key", "text").mapInArrow(rows, "key long, n long, " + "".join(f"{b} long, " for b in BITS) + "g long, prefix array<long>")


def _may_link(x: str, y: str) -> Column:
    """Units in columns x, y with sizes n and places pos of a common shingle: can 100 * common reach 80 * union?"""
    n, m, i, j = (F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


def _bits_allow(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs p, q of units whose parity bits do not differ in too many places; units of several sets have none."""
    one, two = (units.select(F.col("u").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(b).alias(f"{b}_{k}") for b in BITS]) for k in "pq")
    differ = sum((F.bit_count(F.col(f"{b}_p").bitwiseXOR(F.col(f"{b}_q"))) for b in BITS), F.lit(0))
    return pairs.join(one, "p").join(two, "q").where(F.coalesce(9 * differ, F.lit(0)) <= F.col("n_p") + F.col("n_q")).select("p", "q")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts' sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 256:
                    known.clear()
                known[key] = shingle_set(text)
            return known[key]

        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            sets = [(of(p, s), of(q, t)) for p, q, s, t in zip(a, b, x, y, strict=True)]
            keep = [180 * overlap(s, t) >= 80 * (len(s) + len(t)) for s, t in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    first = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(check, pairs.schema)


def _sendable(ids: DataFrame) -> DataFrame:
    """ids, written before, to be broadcast only if they are few."""
    return F.broadcast(ids) if ids.count() <= SENDABLE else ids


def _linked(texts: DataFrame) -> DataFrame | None:
    """id, component for the keys of texts (written) that link with another one."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))
    found = written(prefixes(texts, counts), "jaccard-prefixes")
    counts.destroy()
    groups = found.groupBy("g", "n").agg(F.count("*").alias("k"), *[F.min(b).alias(b) for b in BITS])
    groups = written(groups.select("g", "n", "k", *[F.when(F.col("k") == 1, F.col(b)).alias(b) for b in BITS]), "jaccard-groups")

    # Lists of units: the groups with a shingle in their prefix, and the sets of a group of several. Shingles with the
    # same groups are one list; each group stands in it at its first place. Were two lists taken for one, pairs would only be added.
    token = "partition by token"
    posted = found.where("size(prefix) > 0").select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    posted = posted.selectExpr("g", "n", "pos", f"min(g) over ({token}) as low", f"max(g) over ({token}) as high", f"count(*) over ({token}) as c", f"bit_xor(xxhash64(g)) over ({token}) as x").where("low <> high")
    lists = posted.groupBy(F.xxhash64("low", "high", "c", "x").alias("token"), F.col("g").alias("u"), "n").agg(F.min("pos").alias("pos"))
    many = found.select("key", "n", "g", *BITS).join(groups.where("k > 1").select("g"), "g", "left_semi")
    own = F.xxhash64("key", F.lit("set")).alias("u")
    lists = written(lists.unionByName(many.select(F.col("g").alias("token"), own, "n", F.lit(0).alias("pos"))), "jaccard-lists")
    listed = lists.select("u").distinct()
    units = groups.select(F.col("g").alias("u"), "n", *BITS).join(listed, "u", "left_semi").unionByName(many.select(own, "n", *BITS))
    member = found.select(F.col("g").alias("u"), "key").join(listed, "u", "left_semi").unionByName(many.select(own, "key"))
    units, member = written(units, "jaccard-units"), written(member, "jaccard-members")
    dropped(found, groups)

    label: DataFrame | None = None  # the components so far, as stars u, v
    left, right = member.select(F.col("u").alias("p"), F.col("key").alias("a")), member.select(F.col("u").alias("q"), F.col("key").alias("b"))
    for i in range(PIVOTS + 1):
        if not lists.take(1):
            break
        spans = member.select("u", F.col("key").alias("lo"), F.col("key").alias("hi"))
        if label is not None:  # a list is done when all in it is one component
            spans = member.join(label.select(F.col("u").alias("id"), F.col("v").alias("component")), F.col("key") == F.col("id"), "left").select("u", F.coalesce("component", "key").alias("lo"), F.coalesce("component", "key").alias("hi"))
        spans = spans.groupBy("u").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # Of near copies the least edited one is in most lists; as a pivot it links most others at once.
        spans = spans.join(lists.groupBy("u").agg(F.count("*").alias("listed")), "u")
        x = F.struct("u", "n", "pos", "lo", "hi").alias("x")
        at = lists.join(spans, "u").selectExpr("token", "u", "n", "pos", "lo", "hi", "listed", f"min(lo) over ({token}) as low", f"max(hi) over ({token}) as high").where("low <> high")
        apart = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
        before = lists
        if i < PIVOTS:
            key = F.struct((-F.col("listed")).alias("often"), F.xxhash64("u", F.lit(i)).alias("h"), x).alias("key")
            at = at.select("token", key).selectExpr("token", "key.x as x", f"(min(key) over ({token})).x as y").where("x.u <> y.u")
            at = written(at, "jaccard-round")
            if not at.take(1):  # all lists are done
                dropped(before, at)
                break
            pairs, lists = at.where(apart & _may_link("x", "y")), at.select("token", "x.u", "x.n", "x.pos")
        else:
            at = written(at.select("token", x), "jaccard-round")
            pairs = at.join(at.select("token", F.col("x").alias("y")), "token").where((F.col("x.u") < F.col("y.u")) & apart & _may_link("x", "y"))
        pairs = pairs.select(F.least("x.u", "y.u").alias("p"), F.greatest("x.u", "y.u").alias("q")).distinct()
        pairs = _bits_allow(pairs, units).join(left, "p").join(right, "q").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        linked = written(_verified(pairs, texts), "jaccard-links")
        if i < PIVOTS:
            lists = written(lists, "jaccard-lists")
        dropped(before, at)
        if linked.take(1):
            known, label = label, forest(linked if label is None else linked.unionByName(label.select(F.col("u").alias("a"), F.col("v").alias("b"))), "a", "b")
            dropped(linked, *[known] * (known is not None))
    return label if label is None else with_roots(label)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; links: 100 * common >= 80 * union."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts_for(spark, 16)
    packed = written(packed_sets(docs, parts), "jaccard-packed")
    found = written(packed.where("chunk is null").select("doc_id", "n", "c1", "c2"), "jaccard-sets")
    classes = found.where("n > 0 and doc_id is not null").groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes.join(not_apart(packed).withColumn("near", F.lit(True)), ["n", "c1"], "left"), "jaccard-classes")
    dropped(packed)
    wanted = written(classes.where("near").select(F.col("rep").alias("doc_id")).distinct(), "jaccard-wanted")
    texts = written(keyed_texts(docs.select("doc_id", "text").join(_sendable(wanted), "doc_id", "left_semi")), "jaccard-texts")
    label = _linked(texts)
    dropped(texts)
    of = classes.select("n", "c1", "c2", F.col("rep").alias("component_id"))
    if label is not None:
        # The least doc_id of each component, for the classes that are in one.
        linked = written(classes.join(label, F.col("c1") == F.col("id")).select("n", "c1", "c2", "component", "rep"), "jaccard-linked")
        least = linked.groupBy("component").agg(F.min("rep").alias("least"))
        linked = linked.join(least, "component").select("n", "c1", "c2", "least")
        of = of.join(linked, ["n", "c1", "c2"], "left").select("n", "c1", "c2", F.coalesce("least", "component_id").alias("component_id"))
    alone = found.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.where("n > 0 and doc_id is not null").join(of, ["n", "c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each component only the document with the smallest id; of rows that share an id one."""
    found = written(jaccard_components(docs), "jaccard-components")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-repeated")
    dropped(found)
    kept = docs.join(_sendable(gone), "doc_id", "left_anti").select(*docs.columns)
    if not again.take(1):
        return kept
    again = _sendable(again)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))

"""Packing of tokenized documents into as few fixed-length sequences as can be, by bin completion.

Only lengths matter for what fits with what, so the search works on a histogram: how many pieces have each of the at
most 2048 lengths, a table whose size does not follow the input. Around the largest length that is left, undominated
fillings are enumerated, those that waste more than an improvement allows are pruned, and a filling is used as often as
its lengths last; the incumbent is the best-fit solution, then each better one. Spark makes the pieces, counts their
lengths, numbers the pieces of each length and looks up the place of each number.

Defined cases: a null or empty text is its end alone, one piece of length 1; rows that repeat are packed each on their
own; a null id is one like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import blocks, parts_for, small_batches, written

MODEL, LENGTH, END = "/opt/tokenizers/word_bpe_49k.json", 2048, 0
#: Nodes that the search may visit, fillings looked at in one node, and those that are tried: bounds of effort, not of what is packed.
NODES, STEPS, WIDTH = 1_000, 200, 6
#: Distinct chunks of text whose ids a worker remembers; it starts anew beyond that.
REMEMBERED = 700_000
#: Bytes of text that are encoded at a time. Marks of which a run behind a word is a token group of its own.
BLOCK, MARKS = 1 << 22, ".,;:!?#$%&*"

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, descending; how many sequences are filled so


class Coder:
    """Ids of texts. White space of ASCII parts texts into chunks that the tokenizer encodes apart; each distinct chunk is encoded once, and so is each lower-cased word in them."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_str(spec)
        self.word = self.whole.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.letters = {ord(c): byte_level.pre_tokenize_str(c.lower())[0][0] for c in letters}
        self.words: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 1}
        self.pool = np.empty(1 << 20, np.uint32)
        self.pool[0] = END
        self.used = 1
        self.first, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.count[0] = 1  # code 0 is a document's end, 1 what white space at a text's ends leaves

    def _word(self, word: str) -> bytes:
        """Ids of a normalised word or of its marks, as 32-bit numbers."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            found = self.words[word] = array("I", [t.id for t in self.word.tokenize(word)]).tobytes()
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Words of Latin letters, with or without marks behind them, need no normalising but lower case and no splitting."""
        ids, ends, word = bytearray(), [], self._word
        for c in chunks:
            core = c.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "Ā"):
                ids += word(core.lower() if core.isascii() else core.translate(self.letters))
                if len(core) < len(c):
                    ids += word(c[len(core) :])
            else:
                ids += array("I", self.whole.encode(c, add_special_tokens=False).ids).tobytes()
            ends.append(len(ids) // 4)
        at, n = len(self.known) + 1, len(chunks)
        while self.used + ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while at + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.pool[self.used : self.used + ends[-1]] = np.frombuffer(ids, np.uint32)
        self.first[at : at + n] = self.used + np.array([0, *ends[:-1]])
        self.count[at : at + n] = np.diff(ends, prepend=0)
        self.known.update(zip(chunks, range(at, at + n), strict=True))
        self.used += ends[-1]

    def _ids(self, texts: pa.Array, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, an end behind each that is over; where these ends are, each exclusive."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        chunks = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.known.get, chunks))
        if None in codes:
            self._learn([c for c, code in zip(chunks, codes, strict=True) if code is None])
            codes = list(map(self.known.get, chunks))
        behind = split.offsets.to_numpy()[1:][over]
        codes = np.insert(np.array(codes, np.int64)[flat.indices.to_numpy()], behind, 0)
        n = self.count[codes]
        until = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[codes] - until + n, n) + np.arange(n.sum())]
        return ids, until[behind + np.arange(len(behind))]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, each with its end; where each is over. About BLOCK bytes are taken at a time."""
        texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        found, ends, at, done = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0, 0
        while at < len(texts):
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + BLOCK, "right")))
            if upto[to - 1] - before > BLOCK:
                cut = [b.decode() for b in blocks(texts[at].as_py().encode(), BLOCK)]
                parts = [(pa.array([b]), np.array([i == len(cut) - 1])) for i, b in enumerate(cut)]
            else:
                parts = [(texts[at:to], np.ones(to - at, bool))]
            for part, over in parts:
                ids, over_at = self._ids(part, over)
                found.append(ids)
                ends.append(done + over_at)
                done += len(ids)
            at = to
        return np.concatenate(found), np.concatenate(ends)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, without an end."""
        return self.encode_all(pa.array([text], pa.string()))[0][:-1]


#: One coder for a worker, whatever tasks it runs.
_coders: dict[str, Coder] = {}


def _coder(spec: str) -> Coder:
    if spec not in _coders:
        _coders.clear()
        _coders[spec] = Coder(spec)
    return _coders[spec]


def pieces(docs: DataFrame, path: str = MODEL, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and row (a number of its own) for each piece of at most `length` ids; the ids, too, as little-endian 32-bit numbers, where asked for."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "row"))]
    shape = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _coder(spec.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            found, ends = coder.encode_all(batch.column(1))
            first = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
            each = -(-(ends - first) // length)
            owner = np.repeat(np.arange(len(ends)), each)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            at = first[owner] + piece * length
            until = np.minimum(at + length, ends[owner])
            data = found.astype("<u4", copy=False).view(np.uint8).data
            raw = [data[4 * i : 4 * j] for i, j in zip(at.tolist(), until.tolist(), strict=True)]
            arrays = [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (piece * length, until - at, list(map(zlib.crc32, raw)), row + np.arange(len(owner))))]
            row += len(owner)
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(map(bytes, raw), pa.binary())] * ids, names=shape.fieldNames())

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, shape)


def least_sequences(counts: dict[int, int], length: int) -> int:
    """No packing has fewer: of all thresholds, pieces above length - k are alone, those above half have one each, and what else is k or longer needs the room that is left."""
    n, size = np.zeros(length + 1, object), np.arange(length + 1)
    for s, c in counts.items():
        n[s] = c
    number, mass = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(mass[-1]) // length)
    for k in range(1, length // 2 + 1):
        alone, half = number[-1] - number[length - k], number[length - k] - number[length // 2]
        room = half * length - (mass[length - k] - mass[length // 2])
        best = max(best, int(alone + half + max(0, -(-(mass[length // 2] - mass[k - 1] - room) // length))))
    return best


def best_fit(counts: dict[int, int], length: int) -> list[Pattern]:
    """Best-fit decreasing, many equal pieces and equal sequences at a time."""
    open_: dict[int, list[Pattern]] = {}
    free = 0  # bit r: some sequence has room r left

    def put(pattern: tuple[int, ...], room: int, many: int) -> None:
        nonlocal free
        open_.setdefault(room, []).append((pattern, many))
        free |= 1 << room

    for s in sorted(counts, reverse=True):
        m = counts[s]
        while m:
            fits = free >> s
            if fits:
                room = s + (fits & -fits).bit_length() - 1
                pattern, many = open_[room].pop()
                if not open_[room]:
                    free &= ~(1 << room)
                each = min(room // s, m) if many == 1 else room // s
                used = min(many, m // each) if m >= each else 0
                if not used:  # the last pieces go into one sequence
                    used, each = 1, m
                if many > used:
                    put(pattern, room, many - used)
                put(pattern + (s,) * each, room - s * each, used)
                m -= used * each
            else:
                each = length // s
                if m >= each:
                    put((s,) * each, length - s * each, m // each)
                    m %= each
                else:
                    put((s,) * m, length - s * m, 1)
                    m = 0
    return [x for xs in open_.values() for x in xs]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """The items of b fit into those of a, several into one where they may: then a is never the worse filling."""
    if sum(b) > sum(a):
        return False
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] -= b[i]
                if place(i + 1):
                    return True
                room[j] += b[i]
        return False

    return place(0)


def _pairs(n: np.ndarray, room: int, most: int) -> list[tuple[int, int]]:
    """Two lengths of at most `most` that fill the room exactly, the longest first."""
    high = np.arange(min(room - 1, most), (room - 1) // 2, -1)
    high = high[(n[high] > 0) & (n[room - high] > (high * 2 == room))]
    return [(a, room - a) for a in high.tolist()]


def fillings(n: np.ndarray, room: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated sets of lengths that leave at most `waste` of the room, the least waste first. n: pieces left of each length."""
    if not room:
        return [()]
    if n[room]:
        return [(room,)]  # dominates all others
    pairs = _pairs(n, room, room)
    if pairs:
        return pairs[:WIDTH]
    sizes = np.nonzero(n[: room + 1])[0][::-1].tolist()
    if not sizes:
        return [()] if room <= waste else []
    found: list[tuple[int, ...]] = []
    steps, exact = 0, 0

    def go(i: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps, exact
        steps += 1
        if chosen:
            n[chosen[-1]] -= 1
            ends = [(left,)] if left and left <= chosen[-1] and n[left] else _pairs(n, left, chosen[-1])[:1]
            if not left or ends:  # exact, and it dominates the other ways to go on
                found.append(chosen + (ends[0] if ends else ()))
                exact += 1
                n[chosen[-1]] += 1
                return
        if left <= waste and sizes[-1] > left:
            found.append(chosen)
        for j in range(i, len(sizes)):
            if steps > STEPS or exact == WIDTH:
                break
            if sizes[j] <= left and n[sizes[j]]:
                go(j, left - sizes[j], (*chosen, sizes[j]))
        else:
            if left <= waste and not n[: left + 1].any():
                found.append(chosen)
        if chosen:
            n[chosen[-1]] += 1

    go(0, room, ())
    if not found:  # short lengths may need more of them than there are steps: the longest that fits, each time
        filled, left = [], room
        for s in sizes:
            k = min(int(n[s]), left // s)
            filled += [s] * k
            left -= s * k
        return [tuple(filled)] if left <= waste else []
    found = sorted(set(found), key=lambda f: (room - sum(f), tuple(-s for s in f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if len(kept) == WIDTH:
            break
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def _often(n: np.ndarray, pattern: tuple[int, ...]) -> int:
    """How often a filling is used at once: half of what its lengths allow, so that no length is gone while others are many."""
    return (min(int(n[s]) // c for s, c in Counter(pattern).items()) + 1) // 2


def _descent(n: np.ndarray, length: int) -> list[Pattern]:
    """The fillings of least waste, without turning back: the second incumbent."""
    out: list[Pattern] = []
    top = length
    while True:
        while top and not n[top]:
            top -= 1
        if not top:
            return out
        n[top] -= 1
        pattern = (top, *fillings(n, length - top, length)[0])
        n[top] += 1
        k = _often(n, pattern)
        for s in pattern:
            n[s] -= k
        out.append((pattern, k))


@dataclass
class _Node:
    """A state of the search: what was used to come here, and the fillings still to be tried."""

    largest: int
    waste: int
    to_try: list[tuple[int, ...]]
    used: list[Pattern] = field(default_factory=list)


def completed(counts: dict[int, int], length: int = LENGTH, nodes: int = NODES) -> list[Pattern]:
    """The patterns of as few sequences as the search finds; the same for the same counts."""
    counts = {int(s): int(c) for s, c in counts.items() if c}
    if any(s < 1 or s > length for s in counts):
        raise ValueError("a piece is longer than a sequence")
    least = least_sequences(counts, length) if counts else 0
    n, total = np.zeros(length + 1, np.int64), sum(s * c for s, c in counts.items())
    for s, c in counts.items():
        n[s] = c
    best = min(best_fit(counts, length), _descent(n.copy(), length), key=lambda x: sum(m for _, m in x))
    many = sum(m for _, m in best)

    def node(waste: int) -> _Node:
        left = np.nonzero(n)[0]
        top = int(left[-1])
        n[top] -= 1
        tries = fillings(n, length - top, waste)
        n[top] += 1
        return _Node(top, waste, tries[::-1])

    stack: list[_Node] = []
    spare = (many - 1) * length - total  # what an improvement may waste
    if many > least and spare >= 0:
        stack.append(node(spare))
    while stack and nodes > 0:
        at = stack[-1]
        for pattern, k in at.used:  # back to the state before
            for s in pattern:
                n[s] += k
        at.used = []
        if not at.to_try or at.waste > spare:
            stack.pop()
            continue
        nodes -= 1
        pattern = (at.largest, *at.to_try.pop())
        lost = length - sum(pattern)
        k = _often(n, pattern)
        waste = spare - sum((length - sum(p)) * m for x in stack for p, m in x.used)
        if lost:
            k = min(k, waste // lost)
        if k < 1:
            continue
        for s in pattern:
            n[s] -= k
        at.used = [(pattern, k)]
        if n.any():
            stack.append(node(waste - lost * k))
            continue
        best = [x for y in stack for x in y.used]
        many = sum(m for _, m in best)
        spare = (many - 1) * length - total
        if many <= least or spare < 0:
            break
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """length, low, high, sequence, each, at: pieces of a length with numbers from low to below high lie `each` in a sequence, from `at` on, in the sequences from `sequence` on."""
    out, taken, sequence = [], Counter(), 0
    for pattern, many in sorted(patterns, reverse=True):
        at = 0
        for s, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((s, taken[s], taken[s] + each * many, sequence, each, at))
            taken[s] += each * many
            at += each * s
        sequence += many
    return out


def packed(docs: DataFrame, path: str = MODEL, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """The pieces of all documents, each with its sequence_id and its offset there; with their ids where asked for."""
    spark = docs.sparkSession
    found = written(pieces(docs, path, length, ids), "pieces")
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, 2048 at most
    table = spark.createDataFrame(places(completed(histogram, length)), "length long, low long, high long, sequence long, each long, at long")
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(parts_for(spark, 8))))
    before = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = before.select("length", "deal", (F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1).alias("before"))
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("length", "deal").orderBy("row"))).join(before, ["length", "deal"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    at = numbered.alias("p").join(F.broadcast(table.alias("t")), F.expr("p.length = t.length AND p.number >= t.low AND p.number < t.high"))
    rank = F.expr("p.number - t.low")
    return at.select("doc_id", "piece", "start", "p.length", "ids_crc32", F.expr("t.sequence + (p.number - t.low) div t.each").alias("sequence_id"), (F.col("t.at") + rank % F.col("t.each") * F.col("p.length")).alias("offset"), *["ids"] * ids)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian 32-bit numbers, in order) of rows of packed(..., ids=True); a sequence has no more pieces than its length."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("inside")
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside).select("sequence_id", "length", F.expr("aggregate(inside, X'', (a, x) -> concat(a, x.ids))").alias("ids"))

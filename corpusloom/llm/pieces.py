"""SentencePiece encoding with seeded merge dropout, and decoding without loss.

Merges work through an agenda, best score first, leftmost among equals. A candidate merge is skipped if a keyed hash
of the seed, the document, the word's place in it, the merge's place in the word and the merged piece falls under the
dropout rate, so each seed, document and occurrence of a word gets a segmentation of its own and every run repeats it.
Rate 0 is the tokenizer's plain encoding.

No piece goes on past a word with the space of the next, so words are encoded apart; what is long without a space is
cut where no piece of the vocabulary holds the two characters side by side, as around line ends. Short words are encoded
all at once in arrays. Long ones are, too: a candidate that is best among all within the length of the longest piece on
both sides can be overtaken by nothing, so all such merges are made at once; where that is slow, as in a run of one
letter, a heap goes on. Characters outside the vocabulary become bytes; so does U+2581, the mark that
stands for a space, which the plain tokenizer would give back as a space.

Defined cases: null counts as empty, and an empty text has no pieces; rows with equal ids and texts get equal pieces,
however rows are laid out, unless a column with the copy's number tells them apart; a null id is one like any other;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import small_batches
from corpusloom.llm.shingles import mixed

MODEL, RATE, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 20240607
SPACE = "▁"
#: A text's own U+2581, while it is encoded: no valid text holds this.
OWN_MARK = "\udfff"
#: Longer words are cut where no piece can lie, and merged in the long arrays; a heap takes over after so many rounds, or where a round makes less than one in SLOW merges.
LONG, ROUNDS, SLOW = 48, 400, 2000
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.int32(2**31 - 1)


MASK = (1 << 64) - 1


def _mixed_one(h: int, salt: int) -> int:
    """mixed() of one number."""
    h = (h + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def _least_around(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each place and the w places on both sides of it."""
    n, size, k = len(a), 2 * w + 1, 1
    edge = np.full(w, np.iinfo(a.dtype).max, a.dtype)
    m = np.concatenate([edge, a, edge])
    while 2 * k <= size:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:n], m[size - k : size - k + n])


def read_model(path: str = MODEL) -> dict:
    """pieces (text, score; None for other than normal ones) and byte ids, read on the driver; a few hundred KB."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    pieces = [None if special[i] else (sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    return {"pieces": pieces, "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]}


@dataclass
class Coder:
    """Tables for encoding and decoding with one vocabulary."""

    model: dict

    def __post_init__(self) -> None:
        pieces = self.model["pieces"]
        self.id_of = {p[0]: i for i, p in enumerate(pieces) if p}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("a piece reaches into the next word")
        # Characters that occur in longer pieces only have numbers above the vocabulary.
        letters = sorted({c for p in self.id_of for c in p} - self.id_of.keys())
        self.letter = {c: self.id_of.get(c, len(pieces) + i) for i, c in enumerate(letters)} | {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.width = len(pieces) + len(letters) + 1
        symbol = self.id_of | {c: len(pieces) + i for i, c in enumerate(letters)}
        order = {s: r for r, s in enumerate(sorted({p[1] for p in pieces if p}, reverse=True))}
        self.rank = np.full(len(pieces), NONE, np.int32)
        for i, p in enumerate(pieces):
            if p:
                self.rank[i] = order[p[1]]
        self.merge: dict[int, int] = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    self.merge[a * self.width + b] = i
        byte = self.model["bytes"]
        self.letter = {chr(c): byte[c] for c in range(128)} | self.letter  # these are their own bytes; no merge takes them
        self.table = np.full(0x110000, -1, np.int32)
        for c, i in self.letter.items():
            self.table[ord(c)] = i
        self.longest = max(map(len, self.id_of))
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.keys = np.array(sorted(self.merge), np.int64)
        self.merged = np.array([self.merge[int(k)] for k in self.keys], np.int32)
        self.raw: list[bytes] = [b"" if p is None else p[0].replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.model["bytes"]):
            self.raw[i] = bytes([b])

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 for none; a or b below 0: none."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.width + b)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], np.int32(-1))

    @staticmethod
    def _drops(key: np.ndarray, left: np.ndarray, end: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
        place = (left.astype(np.uint64) << np.uint64(42)) ^ (end.astype(np.uint64) << np.uint64(20)) ^ piece.astype(np.int64).astype(np.uint64)
        return (mixed(key ^ mixed(place, 7), 8) >> np.uint64(11)) < np.uint64(limit)

    def short(self, units: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode many short words at once; each round makes the best merge of every word.

        All ids in one array, and where those of each word start and how many there are.
        """
        limit = int(rate * (1 << 53))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        symbols = self.table[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        pools, first, count, size = [np.empty(0, np.int32)], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        for low, high in ((0, 3), (3, 5), (5, 7), (7, 9), (9, 12), (12, 16), (16, 22), (22, 32), (32, LONG)):
            rows = np.nonzero((lengths > low) & (lengths <= high))[0]
            if not len(rows):
                continue
            at = (ends - lengths)[rows, None] + np.arange(high + 1)[None, :]
            sym = np.where(np.arange(high + 1)[None, :] < lengths[rows, None], symbols[np.minimum(at, len(symbols) - 1)], np.int32(-2))
            sym = self._together(sym, keys[rows], limit)
            ok = (sym >= 0) & (sym < len(self.raw))
            flat, n = sym[ok], ok.sum(1)
            pools.append(flat)
            first[rows], count[rows] = size + np.cumsum(n) - n, n
            size += len(flat)
            for i in np.nonzero(((sym == -1) | (sym >= len(self.raw))).any(1))[0].tolist():  # characters that become several bytes
                ids = self._ids(units[rows[i]], sym[i].tolist())
                pools.append(np.array(ids, np.int32))
                first[rows[i]], count[rows[i]] = size, len(ids)
                size += len(ids)
        return np.concatenate(pools), first, count

    def _together(self, sym: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Merge in each row of symbols (-1: not in the vocabulary, -2: past the end) until no candidate is left; merged ones are at their first place, -3 at the others."""
        n, width = sym.shape[0], sym.shape[1] - 1
        nxt = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        prv = nxt - 2
        # Candidates of neighbours: rank to choose by, piece that they make.
        made = np.full((n, width + 1), -1, np.int32)
        made[:, :-1] = self._lookup(sym[:, :-1], sym[:, 1:])
        rank = np.full((n, width + 1), NONE, np.int32)
        r, c = np.nonzero(made >= 0)
        keep = ~self._drops(keys[r], c, c + 2, made[r, c], limit)
        r, c = r[keep], c[keep]
        rank[r, c] = self.rank[made[r, c]]
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(1)
            some = rank[live, j] < NONE
            live, j = live[some], j[some]
            if not len(live):
                break
            right = nxt[live, j]
            sym[live, j] = made[live, j]
            after = nxt[live, right]
            nxt[live, j] = after
            prv[live, np.minimum(after, width)] = j
            sym[live, right] = -3
            rank[live, right] = NONE
            for left in (j, prv[live, j]):
                ok = left >= 0
                w, a = live[ok], left[ok]
                b = np.minimum(nxt[w, a], width)
                piece = np.where(nxt[w, a] <= width, self._lookup(sym[w, a], sym[w, b]), -1).astype(np.int32)
                good = piece >= 0
                good[good] = ~self._drops(keys[w[good]], a[good], nxt[w, b][good], piece[good], limit)
                made[w, a] = piece
                rank[w, a] = np.where(good, self.rank[piece], NONE)
        return sym

    def _ids(self, unit: str | list[str], sym: list[int]) -> list[int]:
        ids = []
        for c, s in zip(unit, sym, strict=False):
            if s == -1 or s >= len(self.raw):
                ids += self._bytes(c)
            elif s >= 0:
                ids.append(s)
        return ids

    def _bytes(self, c: str) -> list[int]:
        return [self.model["bytes"][b] for b in (SPACE if c == OWN_MARK else c).encode("utf-8", "surrogatepass")]

    def _units(self, text: str | None) -> list[str]:
        """The words of a text, each with the space before it; long ones in parts that no piece joins."""
        if not text:
            return []
        out = []
        for unit in UNIT.findall(SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)):
            if len(unit) <= LONG:
                out.append(unit)
                continue
            c = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pair = c[:-1] << 21 | c[1:]
            at = np.searchsorted(self.beside, pair)
            at[at == len(self.beside)] = 0
            cuts = [0, *(np.nonzero(self.beside[at] != pair)[0] + 1).tolist(), len(unit)]
            out += [unit[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def long(self, units: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As short(), for words of any length: all in one row of symbols, words parted by -2."""
        limit = int(rate * (1 << 53))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), lengths + 1)
        starts = np.cumsum(lengths + 1) - lengths - 1
        left = np.arange(len(owner)) - starts[owner]
        inner = left < lengths[owner]
        sym = np.full(len(owner), -2, np.int32)
        sym[inner] = self.table[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        end, made, rank = left + 1, np.full(len(owner), -1, np.int32), np.full(len(owner), NONE, np.int32)

        def offer(i: np.ndarray) -> None:
            """Candidates of the symbols at i and behind them."""
            piece = self._lookup(sym[i], sym[i + 1]).astype(np.int32)
            good = piece >= 0
            j = i[good]
            good[good] = ~self._drops(keys[owner[j]], left[j], end[j + 1], piece[good], limit)
            made[i], rank[i] = piece, np.where(good, self.rank[piece], NONE)

        offer(np.arange(len(sym) - 1))
        for _ in range(ROUNDS):
            live = rank < NONE
            if not live.any():
                break
            order = rank.astype(np.int64) << 32 | np.arange(len(rank))
            i = np.nonzero(live & (order == _least_around(order, self.longest)))[0]
            if len(i) * SLOW < live.sum():
                break
            sym[i], end[i] = made[i], end[i + 1]
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, left, end, owner, made, rank = (x[stay] for x in (sym, left, end, owner, made, rank))
            i -= np.arange(len(i))
            i = np.unique(np.concatenate([i, i[i > 0] - 1]))
            offer(i[i < len(sym) - 1])
        where = np.searchsorted(owner, np.arange(len(units) + 1))
        for w in np.unique(owner[rank < NONE]).tolist():
            a, b = where[w], where[w + 1] - 1
            sym[a:b] = self._heap(sym[a:b].tolist(), left[a:b].tolist(), int(end[b - 1]), int(keys[w]), limit)
        pools, first, count, size = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        for w, unit in enumerate(units):
            s = sym[where[w] : where[w + 1] - 1]
            odd = (s == -1) | (s >= len(self.raw))
            ids = np.array(self._ids([unit[k] for k in left[where[w] : where[w + 1] - 1].tolist()], s.tolist()), np.int32) if odd.any() else s[s >= 0]
            pools.append(ids)
            first[w], count[w] = size, len(ids)
            size += len(ids)
        return np.concatenate(pools), first, count

    def _heap(self, sym: list[int], left: list[int], size: int, key: int, limit: int) -> list[int]:
        """Merge the symbols of one word, which start at `left`, through an agenda; -3 where one is merged into another."""
        n = len(sym)
        left = [*left, size]
        nxt, prv, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int) -> None:
            b = nxt[a] if a >= 0 else n
            if b < n and sym[a] >= 0 and sym[b] >= 0:
                p = self.merge.get(sym[a] * self.width + sym[b])
                if p is not None:
                    place = (left[a] << 42 ^ left[nxt[b]] << 20 ^ p) & MASK
                    if not limit or _mixed_one(key ^ _mixed_one(place, 7), 8) >> 11 >= limit:
                        heapq.heappush(heap, (int(self.rank[p]), a, nxt[b], p, sym[a], sym[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, end, p, x, y = heapq.heappop(heap)
            b = nxt[a]
            if sym[a] != x or b >= n or sym[b] != y or nxt[b] != end:
                continue
            sym[a], sym[b], nxt[a] = p, -3, nxt[b]
            if nxt[b] < n:
                prv[nxt[b]] = a
            offer(a)
            offer(prv[a])
        return sym

    def encode(self, texts: list[str | None], keys: list[int], rate: float = RATE) -> list[np.ndarray]:
        """The ids of each text's pieces; keys: a 64-bit number for each text."""
        units, owner, plans = [], [], []
        for text, key in zip(texts, keys, strict=True):
            own_units = self._units(text)
            own = mixed(np.arange(len(own_units), dtype=np.uint64) + np.uint64(key), 9)
            if not rate:  # all occurrences of a word are alike
                seen = {u: i for i, u in reversed([*enumerate(own_units)])}
                first = sorted(seen.values())
                number = {own_units[i]: k for k, i in enumerate(first)}
                plans.append(len(units) + np.array([number[u] for u in own_units], np.int64))
                own_units, own = [own_units[i] for i in first], own[first]
            else:
                plans.append(np.arange(len(units), len(units) + len(own_units)))
            units += own_units
            owner.append(own)
        own = np.concatenate(owner) if owner else np.empty(0, np.uint64)
        is_long = np.fromiter((len(u) > LONG for u in units), bool, len(units))
        pool, first, count, size = [np.empty(0, np.int32)], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
        for some, encode in ((~is_long, self.short), (is_long, self.long)):
            at = np.nonzero(some)[0]
            if len(at):
                ids, start, n = encode([units[i] for i in at.tolist()] if is_long.any() else units, own[at], rate)
                pool.append(ids)
                first[at], count[at] = start + size, n
                size += len(ids)
        pool = np.concatenate(pool)
        out = []
        for plan in plans:
            k = count[plan]
            at = np.repeat(first[plan] - np.cumsum(k) + k, k) + np.arange(k.sum())
            out.append(pool[at])
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of the pieces, whatever the segmentation."""
        raw = self.raw
        text = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def key_of(doc_id: object, seed: int, copy: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{copy}:{doc_id}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _coded(docs: DataFrame, shape: T.StructType, path: str, rate: float, seed: int, digest: bool, copy: str | None = None) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = [key_of(d, seed, c) for d, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            ids = coder.encode(texts, keys, rate)
            arrays = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
            if digest:
                back = [coder.decode(x) for x in ids]
                arrays.append(pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]))
                arrays.append(pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)]))
            else:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=shape.fieldNames())

    number = F.coalesce(F.col(copy).cast("long"), F.lit(0)) if copy else F.lit(0).cast("long")
    return docs.select("doc_id", F.col("text").cast("string"), number).mapInArrow(rows, shape)


def encoded(docs: DataFrame, path: str = MODEL, rate: float = RATE, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces (ids) for each row of docs; copy: a column of numbers, each of which gives segmentations of its own."""
    small_batches(docs.sparkSession, 128)
    shape = T.StructType([docs.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return _coded(docs, shape, path, rate, seed, digest=False, copy=copy)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and pieces."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(path))
    shape = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(texts, shape)


def round_trips(docs: DataFrame, path: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), lossless (decoding gives the text) for each row."""
    small_batches(docs.sparkSession, 128)
    shape = T.StructType([docs.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())])
    return _coded(docs, shape, path, rate, seed, digest=True)

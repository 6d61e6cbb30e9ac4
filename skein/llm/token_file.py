"""Token ids in files, compressed by a context-mixing range coder.

A file is a Parquet file of chapters.  A chapter holds whole documents in
ascending id order; its ids are cut into blocks of at most BLOCK ids.  A section
is up to SECTION blocks and the counts that foretell their ids: how often every
id comes (order 0), what follows an id (order 1) and what follows a pair (order 2),
so far as an entry saves more bits than it takes.  From these counts and its own
bytes every block is coded on its own: mixers and coder start afresh, and the
block's crc32 is checked when it is read.  The blocks of a section are coded in
step, as the lanes of arrays.

The longest context that the section knows is asked first.  Whether it lists the
id is one decision, whose probability mixes how often that context was right,
how often the shorter one was, and how often the block's contexts were of late
(their logits are summed with weights that are learnt as the block goes).  If
not, the shorter context is asked likewise, and last all ids of the section.  The
id is then one choice by its count there.  All this drives a range coder with 64
bits of state, in whole numbers, so every machine decodes alike.

Chapter layout (little-endian): magic "SKT3", u32 documents, u64 ids, u64 ids
of the same part before it, u32 block size, then per document i64 id and u64
length (ids equal to NULL_ID stand for a null), then the sections: u32 bytes and u32 crc32 of the
counts, the counts, per block u32 coded bytes and u32 crc32 of its ids
as unsigned 32-bit numbers, then the coded blocks.

Defined results: a null or empty text is the end id alone; rows that repeat an
id follow one another in no fixed order; ids may have 32 bits; a document of any
length lies in one chapter; an empty table gives no chapters and an
empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import offsets, pieces, small_batches
from skein.llm.tokens import worker_encoder

BLOCK = 4096
SECTION = 1536
CHAPTER = 6 << 20
MAGIC = b"SKT3"
NULL_ID = -(1 << 63)
_TOP = np.uint64((1 << 64) - 1)
#: Before a choice, and before the first decision, every interval is at least this wide.
_NARROW = np.uint64(1 << 32)
_WORD, _SHARE, _ONE = np.uint64(32), np.uint64(16), np.uint64(1)


class Lanes:
    """Range coder of many blocks in step.  With ``coded`` it decodes, else it encodes."""

    def __init__(self, lanes: int, room: int, coded: list[bytes] | None = None):
        self.decoding = coded is not None
        width = max(map(len, coded)) // 4 + 2 if self.decoding else room
        self.words = np.zeros((lanes, width), dtype="<u4")
        self.flat, self.width = self.words.reshape(-1), width
        self.start = np.arange(lanes) * width
        self.at = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, _TOP)
        #: The interval's lower end; when decoding, how far the code lies above it.
        self.low = np.zeros(lanes, dtype=np.uint64)
        #: The lower end when it was last shifted; it has passed 64 bits, once at most, where it lies below that.
        self.base = np.zeros(lanes, dtype=np.uint64)
        if self.decoding:
            for k, c in enumerate(coded):
                self.words[k, : len(c) // 4] = np.frombuffer(c, dtype="<u4", count=len(c) // 4)
            self.low = self.words[:, 0].astype(np.uint64) << _WORD | self.words[:, 1]
            self.at += 2

    def _carry(self, k: np.ndarray) -> None:
        place = self.start[k] + self.at[k] - 1
        while len(place):
            self.flat[place] += np.uint32(1)
            place = place[self.flat[place] == 0] - 1

    def _move(self, rows, add: np.ndarray, width: np.ndarray) -> None:
        """Go to the part of the interval that begins ``add`` above its lower end."""
        if self.decoding:
            self.low[rows] -= add
        else:
            self.low[rows] += add
        self.range[rows] = width

    def _settle(self, rows: slice) -> None:
        """Shift out a word where the interval is narrow."""
        k = (self.range[rows] < _NARROW).nonzero()[0]
        place = self.start[k] + self.at[k]
        if self.decoding:
            place = np.minimum(place, self.start[k] + self.width - 1)
            self.low[k] = self.low[k] << _WORD | self.flat[place]
        else:
            low = self.low[k]
            self._carry(k[low < self.base[k]])
            self.flat[place] = low >> _WORD
            self.low[k] = self.base[k] = low << _WORD
        self.range[k] <<= _WORD
        self.at[k] += 1

    def decide(self, rows, share: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Code one yes or no per lane of ``rows``, yes with a probability of share / 65536; twice at most between choices."""
        width = self.range[rows]
        part = (width >> _SHARE) * share.astype(np.uint64)
        yes = self.low[rows] < part if self.decoding else bit
        no = (~yes).astype(np.uint64)
        self._move(rows, part * no, part + (width - part - part) * no)
        return yes

    def choose(self, rows: slice, model: Model, node: np.ndarray, entry: np.ndarray | None) -> np.ndarray:
        """Code one entry of each lane's ``node``."""
        self._settle(rows)
        unit = self.range[rows] >> np.uint64(model.bits)
        if self.decoding:
            at = np.minimum(self.low[rows] // unit, np.uint64((1 << model.bits) - 1)).astype(np.int64)
            entry = model.find(node, at)
        self._move(rows, unit * model.below.take(entry, mode="clip"), unit * model.share.take(entry, mode="clip"))
        self._settle(rows)
        return entry

    def finish(self) -> list[bytes]:
        """The coded bytes of every lane; what a reader finds beyond them counts as zeros."""
        last = self.low + (_NARROW - _ONE)
        self._carry(np.flatnonzero(last < self.base))
        self.flat[self.start + self.at] = last >> _WORD
        return [self.words[k, : n + 1].tobytes() for k, n in enumerate(self.at)]


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) of 12-bit probabilities in steps of 1/256, and its inverse from -2047 on, of 65536."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    squash = np.clip(np.rint(65_536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65_504).astype(np.int32)
    return stretch, squash


_STRETCH, _SQUASH = _logistic()


#: How slowly the mixers' weights move, as a power of two.
RATE = 14


class Mixer:
    """Whether a context lists the next id, told by that context, by the shorter one and by the block so far.

    Their logits are summed with weights that every block learns; at first the context itself is believed.
    """

    def __init__(self, lanes: int):
        self.weights = np.repeat(np.array([[1 << 16], [0], [0]], dtype=np.int32), lanes, axis=1)
        self.late = np.full(lanes, 1 << 15, dtype=np.int32)

    def code(self, coder: Lanes, rows, model: Model, node: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        late, weights = self.late[rows], self.weights[:, rows]
        logits = np.empty_like(weights)
        model.own.take(node, out=logits[0], mode="clip")
        model.shorter.take(node, out=logits[1], mode="clip")
        _STRETCH.take(late >> 4, out=logits[2], mode="clip")
        mixed = weights * logits
        mixed = (mixed[0] + mixed[1] + mixed[2]) >> 16
        p = _SQUASH.take(mixed + 2047, mode="clip")
        np.putmask(p, node == 0, 1 << 16)  # all ids are listed there
        yes = coder.decide(rows, p, bit)
        right = yes.astype(np.int32) << 16
        logits *= right - p
        logits >>= RATE
        logits += weights
        np.minimum(logits, 200_000, out=logits)
        self.weights[:, rows] = np.maximum(logits, -200_000, out=logits)
        self.late[rows] = late + ((right - (right >> 16) - late) >> 5)
        return yes


#: An entry of the counts must save so many bits (it takes some 17 and a place in a table); so many are lost by an id that its context does not list.
_ENTRY_BITS = 30.0
SLACK = 0.5
#: Counts are kept to an eighth of a power of two: 0, then 2 ** (k / 8).
_COUNT = np.concatenate([[0], np.rint(2.0 ** (np.arange(255) / 8))]).astype(np.int64)


def _rounded(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.rint(8 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``keys`` (which are used up), ascending, how often each comes, and the places of the keys in that order."""
    if not len(keys):
        return keys, keys, keys
    bits = len(keys).bit_length()
    if int(keys.max()) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    else:  # key and place in one number sort faster
        keys <<= bits
        for a in range(0, len(keys), 1 << 16):
            part = keys[a : a + (1 << 16)]
            part |= np.arange(a, a + len(part))
        keys.sort()
        order = np.empty(len(keys), dtype=np.int32)
        np.bitwise_and(keys, (1 << bits) - 1, out=order, casting="unsafe")
        keys >>= bits
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))), order


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each of ``keys`` lies among ``sorted_keys``, -1 if it does not."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int32)
    at = np.searchsorted(sorted_keys, keys).astype(np.int32)
    at[sorted_keys.take(at, mode="clip") != keys] = -1
    return at


class Model:
    """The counts of a section as a table of contexts (nodes) and the ids that they list (entries).

    Node 0 lists all ids; then come the ids that list followers, then the pairs that do.  A pair is an
    entry of the second kind.  ``then`` is the longest context known after an entry.
    """

    def __init__(self, ids, codes, pairs, pair_codes, pair_misses, triples, triple_codes, triple_misses):
        self.ids, n, m = ids, len(ids), len(pairs)
        self.pairs, self.triples = pairs, triples
        self.parts = (ids, codes, pairs, pair_codes, pair_misses, triples, triple_codes, triple_misses)
        one, two = np.unique(pairs // n), np.unique(triples // n)
        after_one, after_two = np.zeros(n, dtype=np.int64), np.zeros(m, dtype=np.int64)
        after_one[one] = 1 + np.arange(len(one))
        after_two[two] = 1 + len(one) + np.arange(len(two))
        node = np.concatenate([np.zeros(n, dtype=np.int64), after_one[pairs // n], after_two[triples // n]])
        symbol = np.concatenate([np.arange(n), pairs % n, triples % n])
        last = pairs[triples // n] % n if m else triples
        pair = np.concatenate([np.full(n, -1), np.arange(m), _places(pairs, last * n + triples % n)])
        self.node, self.symbol = node, symbol
        self.then = after_one[symbol]
        if m:
            longer = np.where(pair >= 0, after_two[pair], 0)
            self.then = np.where(longer > 0, longer, self.then)
        # The ids' shares of 1 << bits within their nodes.
        self.bits = max(24, n.bit_length() + 2)
        counts = _COUNT[np.concatenate([codes, pair_codes, triple_codes])]
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        sums, sizes = np.add.reduceat(counts, begin), np.diff(np.append(begin, len(node)))
        whole = 1 << self.bits
        share = 1 + counts * (whole - sizes[node]) // sums[node]
        share[np.append(begin[1:], len(node)) - 1] += whole - np.add.reduceat(share, begin)
        below = np.cumsum(share) - share
        below -= below[begin][node]
        self.keys = (node << self.bits) + below
        self.below, self.share = below.astype(np.uint64), share.astype(np.uint64)
        # Where a search begins: each node is cut into equal parts, four an entry or more.
        cuts = np.ceil(np.log2(4 * sizes)).astype(np.int64)
        self.shift, self.first = self.bits - cuts, offsets(1 << cuts)[:-1]
        place = np.repeat(np.arange(len(sizes)), 1 << cuts)
        place = (place << self.bits) + ((np.arange(len(place)) - self.first[place]) << self.shift[place])
        self.begin = np.searchsorted(self.keys, place, side="right") - 1
        self.above = np.append(self.keys[1:], np.int64(len(sizes) << self.bits))
        # How often a context is right, as a logit, and the same of the shorter one.
        misses = _COUNT[np.concatenate([[0], pair_misses, triple_misses]).astype(np.int64)]
        self.own = _STRETCH[np.minimum(4095, sums * 4096 // (sums + misses))]
        self.less = np.concatenate([np.zeros(1 + len(one), dtype=np.int64), after_one[pairs[two] % n] if m else two])
        self.shorter = np.where(self.less > 0, self.own[self.less], 0).astype(np.int32)

    def find(self, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The entry of each node that holds the place ``at`` of its 1 << bits."""
        entry = self.begin.take(self.first.take(node, mode="clip") + (at >> self.shift.take(node, mode="clip")), mode="clip")
        at += node << self.bits
        more = (self.above.take(entry, mode="clip") <= at).nonzero()[0]
        if len(more):
            entry[more] = np.searchsorted(self.keys, at[more], side="right") - 1
        return entry

    def to_bytes(self) -> bytes:
        ids, codes, pairs, pair_codes, pair_misses, triples, triple_codes, triple_misses = self.parts
        n = len(ids)
        columns = [_planes(np.diff(ids.astype(np.int64), prepend=0)), codes.tobytes()]
        for keys, contexts, counted, missed in ((pairs, n, pair_codes, pair_misses), (triples, len(pairs), triple_codes, triple_misses)):
            columns += [_planes(np.bincount(keys // n, minlength=contexts)), _planes(keys % n), counted.tobytes(), missed.tobytes()]
        return struct.pack("<5I", n, len(pairs), len(triples), len(pair_misses), len(triple_misses)) + zlib.compress(b"".join(columns), 4)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        n, m, k, ones, twos = struct.unpack_from("<5I", raw)
        data, at = np.frombuffer(zlib.decompress(raw[20:]), dtype=np.uint8), 0

        def small(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return data[at - size : at]

        def large(size: int) -> np.ndarray:
            return np.ascontiguousarray(small(4 * size).reshape(4, size).T).view("<u4").reshape(-1).astype(np.int64)

        parts = [np.cumsum(large(n)).astype(np.uint32), small(n)]
        for contexts, size, missed in ((n, m, ones), (m, k, twos)):
            parts += [np.repeat(np.arange(contexts), large(contexts)) * n + large(size), small(size), small(missed)]
        return cls(*parts)


def _kept(keys: np.ndarray, counts: np.ndarray, seen: np.ndarray, n: int, lower: np.ndarray):
    """Which entries save more bits than they take, of contexts that come as often as ``seen``; how often these list nothing."""
    context = keys // n
    keep = counts * (np.log2(counts / seen[context]) - np.log2(lower) + SLACK) > _ENTRY_BITS
    return keep, seen - np.bincount(context[keep], weights=counts[keep], minlength=len(seen)).astype(np.int64)


def _numbered(keep: np.ndarray, counts: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each place, the number of its group among those kept, or -1."""
    out = np.full(size, -1, dtype=np.int32)
    out[order[np.repeat(keep, counts)]] = np.repeat(np.arange(keep.sum(), dtype=np.int32), counts[keep])
    return out


def _learn(ids: np.ndarray, block: int) -> tuple[Model, np.ndarray]:
    """The counts of these ids, and the entry by which each id is coded."""
    top = int(ids.max())
    if top < 1 << 22:
        often = np.bincount(ids)
        known = np.flatnonzero(often)
        rank = np.zeros(top + 1, dtype=np.int32)
        rank[known] = np.arange(len(known))
        often, rank = often[known], rank[ids]
    else:
        known, rank, often = np.unique(ids, return_inverse=True, return_counts=True)
    n = len(known)
    # Order 1: what follows an id; a block's first id follows nothing, here number n.
    keys = np.empty(len(ids), dtype=np.int64)
    np.multiply(rank[:-1], n, out=keys[1:], dtype=np.int64)
    keys[::block] = n * n
    keys += rank
    seen = often - np.bincount(rank[block - 1 :: block], minlength=n)
    seen[rank[-1]] -= len(ids) % block > 0
    pairs, pair_counts, order = _grouped(keys)
    del keys
    share, keep = often / len(ids), pair_counts > 1
    keep[pairs >= n * n] = False
    keep[keep], missed = _kept(pairs[keep], pair_counts[keep], seen, n, share[pairs[keep] % n])
    place = _numbered(keep, pair_counts, order, len(ids))
    pairs, pair_counts = pairs[keep], pair_counts[keep]
    m = len(pairs)
    # Order 2: what follows a pair that is listed.
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[::block] = -1
    at = np.flatnonzero(before >= 0)
    before = before[at]
    pair_seen = np.bincount(before, minlength=m)
    keys = before.astype(np.int64)
    keys *= n
    keys += rank[at]
    triples, triple_counts, order = _grouped(keys)
    del keys
    keep = triple_counts > 1
    some = triples[keep]
    last = pairs[some // n] % n
    pair = _places(pairs, last * n + some % n)
    lower = np.maximum(missed[last], 0.5) / np.maximum(seen[last], 1) * share[some % n]
    if m:
        lower = np.where(pair >= 0, pair_counts[pair] / np.maximum(seen[last], 1), lower)
    keep[keep], lost = _kept(some, triple_counts[keep], pair_seen, n, lower)
    entry = np.where(place >= 0, place + n, rank)
    entry[at[order[np.repeat(keep, triple_counts)]]] = np.repeat(np.arange(n + m, n + m + keep.sum(), dtype=np.int32), triple_counts[keep])
    triples, triple_counts = triples[keep], triple_counts[keep]
    model = Model(
        known, _rounded(often),
        pairs, _rounded(pair_counts), _rounded(missed[np.unique(pairs // n)]),
        triples, _rounded(triple_counts), _rounded(lost[np.unique(triples // n)]),
    )
    return model, entry


def _transform(model: Model, sizes: np.ndarray, coder: Lanes, entries: np.ndarray | None) -> np.ndarray:
    """Code the entries (block after block) or decode them; sizes must not differ but for a smaller last."""
    lanes, longest = len(sizes), int(sizes[0])
    steps = np.zeros((longest, lanes), dtype=np.int32)
    if entries is not None:
        full = entries[: len(entries) // longest * longest].reshape(-1, longest)
        steps[:, : len(full)] = full.T
        steps[: len(entries) - full.size, len(full) :] = entries[full.size :, None]
    first, second = Mixer(lanes), Mixer(lanes)
    node = np.zeros(lanes, dtype=np.int64)
    for t in range(longest):
        n = lanes if t < sizes[-1] else lanes - 1
        node, rows = node[:n], slice(0, n)
        entry = None if entries is None else steps[t, :n].astype(np.int64)
        where = None if entry is None else model.node.take(entry, mode="clip")
        yes = first.code(coder, rows, model, node, None if where is None else where == node)
        no = (~yes).nonzero()[0]
        if len(no):
            node[no] = less = model.less.take(node[no])
            ask = less.nonzero()[0]
            no, less = no[ask], less[ask]
            if len(no):
                yes = second.code(coder, no, model, less, None if where is None else where[no] == less)
                node[no[~yes]] = 0
        entry = coder.choose(rows, model, node, entry)
        if entries is None:
            steps[t, :n] = entry
        node = model.then.take(entry, mode="clip")
    if entries is not None:
        return entries
    return np.concatenate([steps[:, :-1].T.reshape(-1), steps[: sizes[-1], -1]])


def _block_sizes(total: int, block: int) -> np.ndarray:
    return np.array([block] * (total // block) + ([total % block] if total % block else []), dtype=np.int64)


def _section(ids: np.ndarray, block: int) -> list[bytes]:
    model, entries = _learn(ids, block)
    sizes = _block_sizes(len(ids), block)
    coder = Lanes(len(sizes), 2 * int(sizes[0]) + 4)
    _transform(model, sizes, coder, entries)
    coded, counts, ends = coder.finish(), model.to_bytes(), offsets(sizes)
    table = b"".join(
        struct.pack("<II", len(c), zlib.crc32(ids[a:b].tobytes())) for c, a, b in zip(coded, ends, ends[1:], strict=False)
    )
    return [struct.pack("<II", len(counts), zlib.crc32(counts)), counts, table, *coded]


def write_chapter(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], before: int, block: int = BLOCK) -> bytes:
    ids = ids.astype("<u4")
    docs = np.empty(len(lengths), dtype=[("id", "<i8"), ("n", "<u8")])
    docs["id"] = [NULL_ID if d is None else d for d in doc_ids]
    docs["n"] = lengths
    out = [MAGIC, struct.pack("<IQQI", len(lengths), len(ids), before, block), docs.tobytes()]
    for a in range(0, len(ids), SECTION * block):
        out += _section(ids[a : a + SECTION * block], block)
    return b"".join(out)


def read_chapter(raw: bytes) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """(document ids, their lengths, ids of the part before the chapter, all ids)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a chapter of token ids")
    n, total, before, block = struct.unpack_from("<IQQI", raw, 4)
    at = 4 + struct.calcsize("<IQQI")
    docs = np.frombuffer(raw, dtype=[("id", "<i8"), ("n", "<u8")], count=n, offset=at)
    at += docs.nbytes
    ids = np.zeros(total, dtype="<u4")
    for start in range(0, total, SECTION * block):
        size, crc = struct.unpack_from("<II", raw, at)
        counts = raw[at + 8 : at + 8 + size]
        at += 8 + size
        if zlib.crc32(counts) != crc:
            raise ValueError(f"the counts before block {start // block} are damaged")
        model = Model.from_bytes(counts)
        sizes = _block_sizes(min(total - start, SECTION * block), block)
        table = np.frombuffer(raw, dtype="<u4", count=2 * len(sizes), offset=at).reshape(-1, 2)
        begin = at + table.nbytes + offsets(table[:, 0])
        at = int(begin[-1])
        entries = _transform(model, sizes, Lanes(len(sizes), 0, [raw[a:b] for a, b in zip(begin, begin[1:], strict=False)]), None)
        ends = start + offsets(sizes)
        ids[start : ends[-1]] = model.ids[model.symbol[entries]]
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False), start // block):
            if zlib.crc32(ids[a:b].tobytes()) != table[k - start // block, 1]:
                raise ValueError(f"block {k} is damaged")
    return [None if d == NULL_ID else int(d) for d in docs["id"]], docs["n"].astype(np.int64), before, ids


def _chapters(path: str | None, end_id: int, block: int, chapter: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        before = waiting = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, waiting, number
            ids = np.concatenate(parts)
            raw = write_chapter(ids, names, [len(p) for p in parts], before, block)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())],
                names=["part", "chapter", "n_tokens", "content"],
            )
            before += len(ids)
            waiting, number = 0, number + 1
            names.clear()
            parts.clear()
            return row

        part = 0
        for batch in pieces(batches):
            part = batch.column("part")[0].as_py()
            for name, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                names.append(name)
                parts.append(np.append(tokens, np.uint32(end_id)))
                waiting += len(tokens) + 1
                if waiting >= chapter:
                    yield flush()
        if parts:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    chapter: int = CHAPTER,
) -> None:
    """Token files under ``path``: parts in ascending id order, chapters of each part likewise."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ordered.mapInArrow(
        _chapters(tokenizer, end_id, block, chapter), "part int, chapter int, n_tokens long, content binary"
    ).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row per part
    sizes = sorted((r["part"], r["n"]) for r in totals)
    base = dict(zip([p for p, _ in sizes], offsets([n for _, n in sizes]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                names, lengths, before, ids = read_chapter(raw.as_py())
                ends = offsets(lengths)
                little = ids.astype("<u4")
                columns = {
                    "doc_id": pa.array(names, pa.int64()),
                    "start": pa.array(ends[:-1] + before + base[part]),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(little[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    small_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.select("part", "content").mapInArrow(run, schema)


"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word n-grams (as 64-bit digests).  Two
documents link when their sets' Jaccard similarity reaches ``num / den``.

1. Equal sets are one class, by a 128-bit digest of the whole set.
2. Blocking, exact by the pigeonhole principle: linked sets of sizes a and b
   differ in at most H = (a + b)(den - num)/(den + num) n-grams.  The n-grams
   are dealt by hash over H + 1 + spare parts, so linked sets agree on over
   ``spare`` parts.  A part's digest is a signature.  A set withholds its empty
   parts if they are at most spare + 1 - AGREED; so linked sets meet in AGREED
   signatures at least, and pairs that meet in fewer are dropped.  Sizes fall in classes
   so chosen that linked sets lie in one class or in neighbours; each set
   signs for both.  Repeated signatures are merged within each task first, and
   travel as packed arrays, dealt by ranges of their values; signatures and the
   names of sets are cut to NAME bytes there, so a chance equality may add a
   candidate but never hides one.
   N-grams that very many sets have (by counts over all documents in a fixed
   table of cells) would make signatures of passages, not of documents; so the
   parts are first formed without them.  A set with more empty parts than it may
   withhold signs again with more parts, at last with all its n-grams, and if
   there are still as many, with the empty ones too.  Which n-grams count as common changes how
   many candidates there are, never which links are found.
3. Where up to PAIRED sets share a signature, each pair of them is a candidate,
   and is dropped if counts of the sets' n-grams by hash (SKETCH numbers per
   set) already differ by more than H in sum.  Where more share one, each is
   linked to its neighbour without that test.
4. Sets that candidates connect form a block.  The n-grams that most sets of a
   block have are its trunk; a set is kept as its deviations from it, rare ones
   first in one global order, in a trie.  Sets so near the trunk that they must
   be linked with the nearest one are.  Each other set walks the trie, sharing
   the overlap with every common prefix; a subtree is left where the overlap so
   far and what can still follow miss the overlap that a link requires
   (``Metric``).  Sets that are already connected are not compared again.
5. A large block is dealt.  Its trunk is that of one chunk of it (any trunk gives
   the same links).  A set outside must share a deviation of its prefix with
   whatever it is linked with, so each such deviation that several sets have, and in which
   what they require can still be met, makes a smaller block, in which all this is
   done again.  Deviations that the very same sets share count once.  So no pair is left out but those known to be
   connected or too far apart, and no set goes to more blocks than its prefix has n-grams.

Defined results: null and empty texts have an empty set and link with nothing;
rows with equal texts, or with one id, are in one component unless empty; a null id is
never a component's name unless all its ids are null; an empty table gives an
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import MOST_SENT, Interned, cut, join_ids, offsets, pieces, resident, small_batches
from skein.llm.components import components

WORDS, NUM, DEN = 3, 90, 100
#: Signatures in which linked sets meet at least.
AGREED = 3
#: Sets and bytes of n-grams that are compared in one task; larger blocks are dealt, up to LEVELS times.
CHUNK, CHUNK_BYTES = 256, 32 << 20
LEVELS = 6
SALTS = 4
#: Signatures that a task merges at once.
MERGED = 1 << 20
NAME = 5
#: Bits of a set's name; the one above them marks rows that stand for merged ones.
NAME_BITS = 8 * NAME - 1
PAIRED = 48
SKETCH = 64
#: Ways to sign, each for the sets that must withhold too many empty parts in those before: with all n-grams or without the
#: common ones, and how many spare parts there are for each in which sets may differ.
SCHEMES = ((False, 0.1), (False, 0.6), (False, 1.5), (True, 0.1))
#: Cells of the table of n-gram counts, by the leading bits of the digests, and the slices it is summed in.
CELL_BITS, SLICES = 22, 64
#: Ranges of signature values for each shuffle partition.
RANGES = 8


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct n-gram digests."""

    def __init__(self, words: int = WORDS, split: Callable[[str | None], list[bytes]] = split_words):
        self.words, self.split = words, split
        self.digest = resident(("digests",), lambda: Interned(xxhash.xxh3_64_intdigest))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        self.digest.trim()
        parts = [self.split(t) for t in texts]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        flat = np.fromiter(map(self.digest.__getitem__, chain.from_iterable(parts)), dtype=np.uint64, count=int(counts.sum()))
        ends = offsets(counts)
        k = self.words
        rolled = np.zeros(max(0, len(flat) - k + 1), dtype=np.uint64)
        for j in range(k):
            rolled = mix(rolled + flat[j : len(flat) - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15))
        out = []
        for d, n in enumerate(counts):
            a = ends[d]
            if n >= k:
                out.append(np.unique(rolled[a : a + n - k + 1]))
            elif n:
                short = np.array([n], dtype=np.uint64)
                for j in range(n):
                    short = mix(short + flat[a + j : a + j + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


class SizeClasses:
    """Numbers size classes; any two sizes of linked sets lie in one class or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows = num, den, np.array([1], dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        lows = list(self.lows)
        while lows[-1] <= (int(sizes.max()) if len(sizes) else 0) * self.den // self.num * 2 + 2:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * self.den // self.num)))
        self.lows = np.array(lows, dtype=np.int64)
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def most_different(self, label: np.ndarray) -> np.ndarray:
        """The most n-grams in which two linked sets of classes label - 1 and label differ."""
        top = self.lows[label + 1] - 1
        return 2 * top * (self.den - self.num) // (self.den + self.num)


def signatures(sets: list[np.ndarray], nodes: np.ndarray, classes: SizeClasses, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) arrays for a list of non-empty sets; ``common`` tells for each cell whether its n-grams are."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    per_gram = np.repeat(np.arange(len(sets)), sizes)
    rare = np.ones(len(flat), dtype=bool) if common is None else ~common[(flat >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    own = classes.of(sizes)
    found, owner = [], []
    for label in (own, own + 1):
        differ = classes.most_different(label)
        bare = np.ones(len(sets), dtype=bool)
        for number_of, (whole, share) in enumerate(SCHEMES):
            spare = (differ * share).astype(np.int64) + AGREED + 3
            most_held = spare + 1 - AGREED
            # Where sets may not differ at all, equal sets are one class already.
            some = np.where(bare & (differ > 0), differ + 1 + spare, 0)
            use = (some[per_gram] > 0) & (rare | whole)
            base = offsets(some)
            gram, row = flat[use], per_gram[use]
            salted = mix(gram + mix(label.astype(np.uint64))[row])
            part = ((salted >> np.uint64(32)) * some[row].astype(np.uint64)) >> np.uint64(32)
            at = base[row] + part.astype(np.int64)
            sums = np.zeros(base[-1], dtype=np.uint64)
            np.add.at(sums, at, salted)
            filled = np.zeros(base[-1], dtype=bool)
            filled[at] = True
            where = np.repeat(np.arange(len(sets)), some)
            number = np.arange(base[-1]) - base[where]
            many = np.bincount(where[~filled], minlength=len(sets)) > most_held
            offered = filled | (whole & many[where])
            bare = bare & many
            name = mix(number.astype(np.uint64) + (label[where].astype(np.uint64) << np.uint64(32)) + (np.uint64(number_of) << np.uint64(56)))
            found.append(mix(sums + name)[offered])
            owner.append(nodes[where[offered]])
    return np.concatenate(found), np.concatenate(owner)


def merge_signatures(sig: np.ndarray, node: np.ndarray, paired: int = PAIRED) -> tuple[np.ndarray, np.ndarray]:
    """Repeated rows once; of over ``paired`` nodes with one signature the first stays, and each other is linked to it.

    All rows that come from such merging are marked in their node, so whoever meets them takes the link for sure.
    """
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = sig[1:] != sig[:-1]
    run = np.cumsum(first) - 1
    crowd = np.bincount(run, minlength=0)[run] > paired if len(sig) else first
    mark = np.int64(1 << NAME_BITS)
    leader = node[first][run]
    other = crowd & ~first
    pairs = np.unique(np.stack([leader[other], node[other]], axis=1), axis=0)
    name = mix(mix(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64))
    kept = np.where(crowd, node | mark, node)[~other]
    return np.concatenate([sig[~other], name, name]), np.concatenate([kept, pairs[:, 0] | mark, pairs[:, 1] | mark])


def _meta(words: int, split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, split)
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in pieces(batches):
            sets = shingler.sets(batch.column("text").to_pylist())
            np.add.at(cells, (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("same"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                    pa.array(_nodes(sets), pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                names=["doc_id", "same", "n", "key", "node", "sketch"],
            )
        # The task's counts, as rows with a negative n.
        parts = [zlib.compress(c.tobytes(), 1) for c in cells.reshape(SLICES, -1)]
        none = pa.nulls(SLICES, pa.int64())
        slices = pa.array([-1 - k for k in range(SLICES)], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, pa.nulls(SLICES, pa.string()), slices, pa.array(parts, pa.binary()), none, pa.nulls(SLICES, pa.binary())],
            names=["doc_id", "same", "n", "key", "node", "sketch"],
        )

    return run


def _common(rows: pa.Table) -> pa.Table:
    """For one slice of cells, a bit per cell: whether its count stands out from what chance deals to a cell."""
    cells = np.zeros((1 << CELL_BITS) // SLICES, dtype=np.int64)
    for raw in rows.column("key"):
        cells += np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32)
    usual = float(np.median(cells))
    bits = np.packbits(cells > usual + 6.0 * np.sqrt(usual) + PAIRED / 3)
    return pa.table({"n": rows.column("n").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def common_cells(counts: DataFrame) -> np.ndarray:
    """Whether each cell's n-grams are common: half a megabyte of bits, whatever the input."""
    found = counts.select("n", "key").groupBy("n").applyInArrow(_common, "n long, bits binary").collect()
    out = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), dtype=bool)
    for r in found:
        out[-1 - r["n"]] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)).astype(bool)
    return np.packbits(out.ravel())


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams fall in each of SKETCH hash classes (255 stands for more)."""
    counts = np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A name of NAME_BITS bits for each set."""
    names = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], dtype=np.uint64)
    return (names & np.uint64((1 << NAME_BITS) - 1)).view(np.int64)


def _pack(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME]


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :NAME] = raw
    return out.view("<u8").ravel()


def block_ranges(spark: SparkSession) -> int:
    """How many ranges signatures are dealt by; it grows with the shuffle partitions of the cluster."""
    return max(64, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack_ranges(sig: np.ndarray, node: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row per range of signatures, with the signatures and nodes in it."""
    at = ((sig >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
    order = np.argsort(at, kind="stable")
    packed = np.hstack([_pack(sig[order]), _pack(node[order])])
    ends = np.searchsorted(at[order], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int64()), pa.array([packed[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())],
        names=["range", "signed"],
    )


def _signed(words: int, split, num: int, den: int, ranges: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, classes = Shingler(words, split), SizeClasses(num, den)
        common = np.unpackbits(bits).astype(bool)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            sig, node = merge_signatures(*map(np.concatenate, zip(*waiting, strict=True)))
            waiting.clear()
            return pack_ranges(sig, node, ranges)

        for batch in pieces(batches):
            sets = [s for s in shingler.sets(batch.column(0).to_pylist()) if len(s)]
            if sets:
                waiting.append(signatures(sets, _nodes(sets), classes, common))
            if sum(len(s) for s, _ in waiting) >= MERGED:
                yield flush()
        if waiting:
            yield flush()

    return run


def unpack_range(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, nodes and marks of a range, in order of the first two."""
    raw = np.frombuffer(b"".join(rows.column("signed").to_pylist()), dtype=np.uint8).reshape(-1, 2 * NAME)
    sig, node = _unpack(raw[:, :NAME]), _unpack(raw[:, NAME:]).view(np.int64)
    marked = node >> NAME_BITS
    node = node & ((1 << NAME_BITS) - 1)
    order = np.lexsort((node, sig))
    return sig[order], node[order], marked[order].astype(bool)


def colliding(sig: np.ndarray, node: np.ndarray, marked: np.ndarray, paired: int = PAIRED) -> np.ndarray:
    """Rows (a, b, sure, times): pairs that share signatures, and how many.

    Where over ``paired`` nodes share one, or one is marked, neighbours only, as sure.
    """
    if not len(sig):
        return np.zeros((0, 4), dtype=np.int64)
    again = np.zeros(len(sig), dtype=bool)
    again[1:] = (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])
    first = np.ones(len(sig), dtype=bool)
    first[1:] = sig[1:] != sig[:-1]
    run = np.cumsum(first) - 1
    crowd = (np.bincount(run[~again], minlength=run[-1] + 1) > paired) | (np.bincount(run, weights=marked, minlength=run[-1] + 1) > 0)
    node, run = node[~again], run[~again]
    found = [np.zeros((0, 3), dtype=np.int64)]
    for step in range(1, paired):
        at = np.flatnonzero((run[step:] == run[:-step]) & (~crowd[run[step:]] | (step == 1)))
        if not len(at):
            break
        found.append(np.stack([node[at + step], node[at], crowd[run[at]].astype(np.int64)], axis=1))
    pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return np.column_stack([pairs, times])


def collisions(rows: pa.Table) -> pa.Table:
    pairs = colliding(*unpack_range(rows))
    return pa.table(
        {"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "sure": pa.array(pairs[:, 2].astype(bool)), "times": pa.array(pairs[:, 3])}
    )


def _plausible(num: int, den: int):
    """Pairs but those whose sizes or sketches rule out the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int64) for c in ("sa", "sb"))
            near = np.abs(a - b).sum(axis=1) * (den + num) <= (na + nb) * (den - num)
            near &= np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            yield batch.filter(pa.array(near)).select(["a", "b"])

    return run


class Trie:
    """Sets of numbers, each ascending in one global order, by common prefixes; sets are numbered in lexicographic order.

    ``needs`` is what a set adds to the overlap that a link requires (see ``Metric``).
    """

    def __init__(self, sets: list[np.ndarray], needs: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.needs = needs[self.order]
        shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        #: (from depth, to depth, first set, past last set, least need, largest size, children)
        self.nodes: list[tuple[int, int, int, int, int, int, list[int]]] = []
        todo = [(0, len(sets), 0, -1)] if sets else []
        while todo:
            lo, hi, depth, parent = todo.pop()
            most = max(len(s) for s in self.sets[lo:hi])
            to = len(self.sets[lo]) if hi - lo == 1 else min(shared[lo + 1 : hi])
            self.nodes.append((depth, to, lo, hi, int(self.needs[lo:hi].min()), most, []))
            if parent >= 0:
                self.nodes[parent][6].append(len(self.nodes) - 1)
            if hi - lo > 1:
                starts = [lo] + [k for k in range(lo + 1, hi) if shared[k] == to] + [hi]
                # Equal sets end at one node; each of them is a leaf below it.
                todo += [(a, b, to, len(self.nodes) - 1) for a, b in zip(starts, starts[1:], strict=False)]

    def walk(self, y: np.ndarray, need: int, unit: int, known: Callable[[int], bool]) -> Iterator[int]:
        """Numbers of the sets linked with ``y`` (those whose overlap, times ``unit``, covers both needs), but those ``known``."""
        todo = [(0, 0, 0)] if self.nodes else []
        n = len(y)
        while todo:
            at, overlap, passed = todo.pop()
            depth, to, lo, hi, least, most, children = self.nodes[at]
            if to > depth and n:
                edge = self.sets[lo][depth:to]
                place = np.searchsorted(y, edge)
                overlap += int(np.count_nonzero(y[np.minimum(place, n - 1)] == edge))
                passed = int(np.searchsorted(y, edge[-1], side="right"))
            if (overlap + min(most - to, n - passed)) * unit < least + need:
                continue
            if hi - lo == 1:
                if not known(lo):
                    yield lo
            else:
                todo += [(c, overlap, passed) for c in children]


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Metric:
    """When sets link, told by how they deviate from any third set, the trunk.

    Sets A and B of a and b n-grams reach num / den when they differ in D n-grams with
    D (den + num) <= (a + b)(den - num).  If they deviate from the trunk by the sets
    X and Y, then D = |X| + |Y| - 2 |X & Y|; so they link when 2 (den + num) |X & Y|
    covers need(A) + need(B), where need(A) = |X|(den + num) - a (den - num).
    """

    def __init__(self, num: int, den: int):
        self.far, self.near, self.unit = den + num, den - num, 2 * (den + num)

    def need(self, deviations, size):
        return deviations * self.far - size * self.near


def trunk(sets: list[np.ndarray]) -> np.ndarray:
    """The n-grams that more than half of the sets have."""
    grams, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    return grams[2 * counts > len(sets)]


def block_links(sets: list[np.ndarray], sizes: np.ndarray, metric: Metric) -> list[tuple[int, int]]:
    """Pairs of linked sets, enough to connect all that links connect.

    ``sets`` may be deviations from one trunk already; ``sizes`` are those of the sets themselves.
    Whoever is so near the trunk that it must be linked with the nearest set is; the others walk the trie.
    """
    if len(sets) < 2:
        return []
    base = trunk(sets)
    away = [np.setxor1d(s, base, assume_unique=True) for s in sets]
    counts = np.array([len(x) for x in away], dtype=np.int64)
    needs = metric.need(counts, sizes)
    nearest = int(needs.argmin())
    union, links = Union(len(sets)), []

    def link(a: int, b: int) -> None:
        if union.join(a, b):
            links.append((a, b))

    for k in np.flatnonzero(needs + needs[nearest] <= 0).tolist():
        link(k, nearest)
    outside = np.flatnonzero(needs + needs[nearest] > 0)
    if not len(outside):
        return links
    # Rare first, so that a set which shares little is left early.
    _, number, often = np.unique(np.concatenate(away), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ends = offsets(counts)
    ranked = [np.sort(rank[number[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
    several = offsets(often[number] > 1)[ends]
    trie = None
    for y in outside.tolist():
        if int(several[y + 1] - several[y]) * metric.unit < needs[y] + needs[nearest]:
            continue
        trie = trie or Trie(ranked, needs)
        for x in trie.walk(ranked[y], int(needs[y]), metric.unit, lambda x, y=y: union.find(trie.order[x]) == union.find(y)):
            link(trie.order[x], y)
    return links


def _as_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column.to_pylist()]


_LINKS = "a long, b long"
_STATE = "comp long, rep long, n long, grams binary"


def _grams(words: int, split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, split)
        for batch in pieces(batches):
            sets = shingler.sets(batch.column("text").to_pylist())
            kept = batch.select(["comp", "rep"]).append_column("n", pa.array([len(s) for s in sets], pa.int64()))
            yield kept.append_column("grams", pa.array([s.tobytes() for s in sets], pa.binary()))

    return run


#: Finds the links of one block: sets (or what they have beside a trunk), sizes of the sets, metric.
Finder = Callable[[list[np.ndarray], np.ndarray, Metric], list[tuple[int, int]]]


def _links(num: int, den: int, finder: Finder):
    """Links of all blocks that lie in a task, one block after another as they come."""
    metric = Metric(num, den)

    def of(blocks: pa.Table) -> pa.RecordBatch:
        comps, reps, sizes = (blocks.column(c).to_numpy() for c in ("comp", "rep", "n"))
        sets, pairs = _as_sets(blocks.column("grams")), []
        starts = np.flatnonzero(np.concatenate([[True], comps[1:] != comps[:-1]])).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(comps)], strict=True):
            if hi - lo > 1:
                pairs += [(lo + a, lo + b) for a, b in finder(sets[lo:hi], sizes[lo:hi], metric)]
        a, b = (np.array([pair[k] for pair in pairs], dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            comp = batch.column("comp").to_numpy()
            # The last block may go on in the next batch.
            last = int(np.searchsorted(comp, comp[-1]))
            if last or (waiting and waiting[-1].column("comp")[0].as_py() != comp[0]):
                yield of(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield of(pa.Table.from_batches(waiting))

    return run


def _linked(state: DataFrame, num: int, den: int, finder: Finder) -> DataFrame:
    """Links (a, b) inside the blocks of ``state``, which come to a task as a whole, in order."""
    return state.select("comp", "rep", "n", "grams").repartition("comp").sortWithinPartitions("comp").mapInArrow(_links(num, den, finder), _LINKS)


def _trunk(rows: pa.Table) -> pa.Table:
    return pa.table({"comp": rows.column("comp").slice(0, 1), "base": pa.array([trunk(_as_sets(rows.column("grams"))).tobytes()], pa.binary())})


def _deviate(num: int, den: int):
    """Sets as deviations from their block's trunk: the n-grams they add, then those they lack."""
    metric = Metric(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away, added = [], []
            for own, base in zip(_as_sets(batch.column("grams")), _as_sets(batch.column("base")), strict=True):
                more, less = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
                added.append(len(more))
                # In the order of signed numbers, as Spark has it.
                away.append(np.concatenate([np.sort(more.view(np.int64)), np.sort(less.view(np.int64))]).view(np.uint64))
            counts = np.array([len(x) for x in away], dtype=np.int64)
            out = batch.select(["comp", "rep", "n"])
            out = out.append_column("need", pa.array(metric.need(counts, batch.column("n").to_numpy())))
            out = out.append_column("added", pa.array(added, pa.int64()))
            yield out.append_column("grams", pa.array([x.tobytes() for x in away], pa.binary()))

    return run


#: What sets say of one deviation, summed up; and a set that has it.
_TOLD = np.dtype(
    [("comp", "<i8"), ("gram", "<i8"), ("lacked", "u1"), ("least", "<i8"), ("best", "<i8"), ("some", "u1"), ("k", "<i8"), ("sum", "<u8"), ("xor", "<u8")]
)
_HAS = np.dtype([("comp", "<i8"), ("gram", "<i8"), ("rep", "<i8"), ("most", "<i8")])
_LIVE = "range long, comp long, gram long, lacked boolean, least long, k long, sum long, xor long"


def _prefixes(batch: pa.RecordBatch, unit: int) -> tuple[np.ndarray, ...]:
    """The deviations of which a link of a set needs one at least: comp, gram, whether it is lacked, rep, need, the most that a partner may need there, outside."""
    sets = _as_sets(batch.column("grams"))
    comp, rep, need, low, added = (batch.column(c).to_numpy() for c in ("comp", "rep", "need", "low", "added"))
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    outside = need + low > 0
    # A set outside shares so many deviations with any set; one inside, with those outside.
    share = np.maximum(1, -(-np.where(outside, need + low, need - low + 1) // unit))
    kept = np.maximum(0, counts - share + 1)
    row = np.repeat(np.arange(len(sets)), kept)
    place = np.arange(len(row)) - offsets(kept)[row]
    gram = np.concatenate([s[:k] for s, k in zip(sets, kept, strict=True)] or [np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return comp[row], gram, place >= added[row], rep[row], need[row], unit * (counts[row] - place) - need[row], outside[row]


def _dealt(rows: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row per range of deviations, with what is said of those in it."""
    at = (mix(mix(rows["comp"].view(np.uint64)) + rows["gram"].view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(ends))
    rows = rows[order]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary())], names=["range", "told"])


def _summed(rows: np.ndarray) -> np.ndarray:
    """One row for each deviation of each block."""
    rows = rows[np.lexsort((rows["gram"], rows["comp"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["comp"][1:] != rows["comp"][:-1]) | (rows["gram"][1:] != rows["gram"][:-1])
    at = np.flatnonzero(new)
    out = rows[at]
    if len(at):
        out["least"], out["best"], out["some"] = np.minimum.reduceat(rows["least"], at), np.maximum.reduceat(rows["best"], at), np.maximum.reduceat(rows["some"], at)
        out["k"], out["sum"], out["xor"] = np.add.reduceat(rows["k"], at), np.add.reduceat(rows["sum"], at), np.bitwise_xor.reduceat(rows["xor"], at)
    return out


def _telling(num: int, den: int, ranges: int):
    """What a task's sets say of each deviation, summed up in the task."""
    unit = Metric(num, den).unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            comp, gram, lacked, rep, need, most, outside = _prefixes(batch, unit)
            rows = np.empty(len(comp), dtype=_TOLD)
            rows["comp"], rows["gram"], rows["lacked"], rows["least"], rows["best"], rows["some"], rows["k"] = comp, gram, lacked, need, most, outside, 1
            rows["sum"] = mix(rep.view(np.uint64) + np.uint64(1))
            rows["xor"] = mix(rows["sum"])
            waiting.append(_summed(rows))
            if sum(map(len, waiting)) >= MERGED:
                yield _dealt(_summed(np.concatenate(waiting)), ranges)
                waiting.clear()
        if waiting:
            yield _dealt(_summed(np.concatenate(waiting)), ranges)

    return run


def _live(rows: pa.Table) -> pa.Table:
    """The deviations that several sets have, one of them outside, and where what they need can be met."""
    told = _summed(np.frombuffer(b"".join(rows.column("told").to_pylist()), dtype=_TOLD))
    told = told[(told["k"] > 1) & (told["some"] > 0) & (told["best"] >= told["least"])]
    plain = {c: pa.array(told[c].view(np.int64) if told[c].dtype == np.uint64 else told[c]) for c in ("comp", "gram", "least", "k", "sum", "xor")}
    return pa.table(
        {
            "range": pa.array(np.full(len(told), rows.column("range")[0].as_py())),
            "comp": plain["comp"],
            "gram": plain["gram"],
            "lacked": pa.array(told["lacked"].astype(bool)),
            **{c: plain[c] for c in ("least", "k", "sum", "xor")},
        }
    )


def _having(num: int, den: int, ranges: int):
    unit = Metric(num, den).unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comp, gram, _, rep, _, most, _ = _prefixes(batch, unit)
            rows = np.empty(len(comp), dtype=_HAS)
            rows["comp"], rows["gram"], rows["rep"], rows["most"] = comp, gram, rep, most
            dealt = _dealt(rows, ranges)
            yield dealt.append_column("salt", pa.array(np.full(dealt.num_rows, int(rep[0]) % SALTS if len(rep) else 0)))

    return run


def _held(has: pa.Table, live: pa.Table) -> pa.Table:
    """The sets that have live deviations and can meet what is needed there: comp, rep, gram."""
    rows = np.frombuffer(b"".join(has.column("told").to_pylist()), dtype=_HAS)
    comp, gram, least = (live.column(c).to_numpy() for c in ("comp", "gram", "least"))
    number = {k: i for i, k in enumerate(zip(comp.tolist(), gram.tolist(), strict=True))}
    at = np.fromiter((number.get(k, -1) for k in zip(rows["comp"].tolist(), rows["gram"].tolist(), strict=True)), dtype=np.int64, count=len(rows))
    kept = at >= 0
    kept[kept] = rows["most"][kept] >= least[at[kept]]
    rows = rows[kept]
    return pa.table({"comp": pa.array(rows["comp"].copy()), "rep": pa.array(rows["rep"].copy()), "gram": pa.array(rows["gram"].copy())})


def _sent(table: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """``table`` (written down), marked for broadcast if its n-grams are measured to be few."""
    size = table.agg(F.sum(F.length("base") + 16)).first()[0] or 0
    return F.broadcast(table) if size <= most_bytes else table


def connect(sets: DataFrame, num: int, den: int, chunk: int = CHUNK, levels: int = LEVELS, finder: Finder = block_links) -> DataFrame:
    """rep and root (the least rep that links reach) of ``sets`` (comp, rep, n, grams: sorted digests) that links connect in their blocks.

    ``finder`` finds the links of one block; the trie does if none is named.
    """
    spark = sets.sparkSession
    links = []
    state = cut(sets)
    for level in range(levels + 1):
        chunks = F.ceil(F.greatest(F.col("k") / chunk, F.col("bytes") / CHUNK_BYTES)).alias("chunks")
        large = state.groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("grams")).alias("bytes"))
        large = cut(large.select("comp", "k", chunks).where("k > 2 and chunks > 1").drop("k"))
        some = large.count()
        if not some:
            links.append(_linked(state, num, den, finder))
            break
        few = F.broadcast(large) if some <= MOST_SENT else large
        links.append(_linked(state.join(few, "comp", "left_anti"), num, den, finder))
        wide = state.join(few, "comp").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
        if level == levels:
            # What shares one deviation after another without linking: every chunk meets every other.
            pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
            met = wide.withColumn("other", pair).withColumn("comp", F.xxhash64("comp", F.least("chunk", "other"), F.greatest("chunk", "other")))
            links.append(_linked(met, num, den, finder))
            break
        bases = cut(wide.where("chunk = 0").select("comp", "grams").groupBy("comp").applyInArrow(_trunk, "comp long, base binary"))
        based = wide.join(_sent(bases), "comp", "left").select("comp", "rep", "n", "grams", F.coalesce("base", F.lit(b"")).alias("base"))
        away = cut(based.mapInArrow(_deviate(num, den), "comp long, rep long, n long, need long, added long, grams binary"))
        low = cut(away.groupBy("comp").agg(F.min(F.struct("need", "rep")).alias("low")))
        away = away.join(F.broadcast(low) if some <= MOST_SENT else low, "comp")
        links.append(away.where(F.col("need") + F.col("low.need") <= 0).select(F.col("rep").alias("a"), F.col("low.rep").alias("b")))
        first = away.select("comp", "rep", "need", "added", "grams", F.col("low.need").alias("low"))
        ranges = block_ranges(spark)
        told = first.mapInArrow(_telling(num, den, ranges), "range long, told binary")
        live = told.groupBy("range").applyInArrow(_live, _LIVE)
        # Deviations that the same sets share: the first in order stands for all of them.
        live = live.groupBy("comp", "k", "sum", "xor").agg(F.min(F.struct("lacked", "gram", "least", "range")).alias("g"))
        live = cut(live.select("comp", F.col("g.gram").alias("gram"), F.col("g.least").alias("least"), F.col("g.range").alias("range")))
        # A deviation that very many sets have is looked up in several tasks.
        asked = live.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        has = first.mapInArrow(_having(num, den, ranges), "range long, told binary, salt long")
        held = has.groupBy("range", "salt").cogroup(asked.groupBy("range", "salt")).applyInArrow(_held, "comp long, rep long, gram long")
        held = held.select("comp", "rep", F.xxhash64("comp", "gram").alias("next")).distinct()
        state = away.select("comp", "rep", "n", "grams").join(held, ["comp", "rep"]).select(F.col("next").alias("comp"), "rep", "n", "grams")
        state = cut(state)
    edges = reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], _LINKS)
    return components(cut(edges)).select(F.col("node").alias("rep"), F.col("component").alias("root"))


def _components(docs: DataFrame, words: int, num: int, den: int, split, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """As ``jaccard_components``, with ``same``: the text's digest where the id is null, which tells such rows apart."""
    small_batches(docs.sparkSession)
    name, text = F.col(id_col).cast("long"), F.col(text_col)
    texts = docs.select(name.alias("doc_id"), text.alias("text"), F.when(name.isNull(), F.sha2(F.coalesce(text, F.lit("")), 256)).alias("same"))
    counted = cut(texts.mapInArrow(_meta(words, split), "doc_id long, same string, n long, key binary, node long, sketch binary"))
    meta = counted.where("n >= 0")
    bits = common_cells(counted.where("n < 0"))
    ranges = block_ranges(docs.sparkSession)
    signed = texts.select("text").mapInArrow(_signed(words, split, num, den, ranges, bits), "range long, signed binary")
    pairs = signed.groupBy("range").applyInArrow(collisions, "a long, b long, sure boolean, times long")
    pairs = pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"), F.sum("times").alias("times"))
    pairs = cut(pairs.where(F.col("sure") | (F.col("times") >= AGREED)).drop("times"))
    # A name that two different sets share (they are cut short) vouches for nothing.
    lone = F.min("key") == F.max("key")
    known = meta.where("n > 0").groupBy("node").agg(F.when(lone, F.first("n")).alias("n"), F.when(lone, F.first("sketch")).alias("s"))
    told = (
        pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        .join(known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    )
    sure = F.col("sure") | F.col("na").isNull() | F.col("nb").isNull()
    tested = told.where(~sure).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_plausible(num, den), "a long, b long")
    blocks = components(cut(told.where(sure).select("a", "b").unionByName(tested)))

    keys = cut(meta.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("node").alias("node")))
    classes = keys.where("rep is not null").join(blocks, "node").select("key", "rep", F.col("component").alias("comp"))
    sizes = classes.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    chosen = cut(classes.join(sizes, "comp").select("comp", "rep", "key"))
    wanted = join_ids(texts, chosen.select(F.col("rep").alias("doc_id"), "comp"), ["doc_id"]).select("comp", F.col("doc_id").alias("rep"), "text")
    roots = connect(wanted.mapInArrow(_grams(words, split), _STATE), num, den, chunk)
    named = keys.join(chosen.join(roots, "rep").select("key", "root"), "key", "left").where("rows > 1 or root is not null")
    final = cut(named.select("key", F.coalesce("root", "rep").alias("component_id")))
    return join_ids(meta.select("doc_id", "same", F.col("n").alias("n_shingles"), "key"), final, ["key"], "left").select(
        "doc_id", "same", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    num: int = NUM,
    den: int = DEN,
    split: Callable[[str | None], list[bytes]] = split_words,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Per row: doc_id (a whole number), n_shingles, component_id (the least doc_id that links reach)."""
    return _components(docs, words, num, den, split, id_col, text_col, chunk).drop("same")


def drop_near_copies(
    docs: DataFrame,
    words: int = WORDS,
    num: int = NUM,
    den: int = DEN,
    split: Callable[[str | None], list[bytes]] = split_words,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those whose id does not name their component (one document of each group stays).

    Rows without an id go by their text.
    """
    found = _components(docs, words, num, den, split, id_col, text_col, chunk)
    gone = cut(found.where("not (doc_id <=> component_id)").select("doc_id", "same").distinct())
    named = gone.where("doc_id is not null").select(F.col("doc_id").alias("gone_id"))
    few = named.count() <= MOST_SENT
    kept = docs.join(F.broadcast(named) if few else named, docs[id_col].cast("long") == named["gone_id"], "left_anti")
    bare = gone.where("doc_id is null").select(F.col("same").alias("gone_text"))
    if bare.isEmpty():
        return kept
    return kept.join(bare, docs[id_col].isNull() & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == bare["gone_text"]), "left_anti")

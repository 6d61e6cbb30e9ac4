"""Substring deduplication by paragraphs: MinHash banding, exact verification, components.

A repeated passage may be a paragraph of its own, or lie anywhere in a line.  So
there are two kinds of paragraphs, and a text shorter than LEAST words has none:

* Lines of LEAST words or more.  Their word 5-grams get BANDS * ROWS MinHash
  values; different lines that agree on all rows of a band collide (at a
  similarity of 0.8 with probability 0.995).  Colliding lines form blocks, in
  which exact Jaccard similarity (num / den at least) links them: of few lines all
  overlaps at once, of more by the trie of the n-gram join.  Linked lines are one class (components).
* Windows of WIDTH words, cut by content: of every SPREAD consecutive word
  n-grams the one with the least digest is an anchor; the WIDTH words from an
  anchor on are a window, and the WIDTH words that end CORE words after it are
  another.  Any run of LEAST words that two texts share holds the same anchor in
  both and at least one of its windows.  Equal windows are one class.

Each place of a window is held against the first one (of the least doc_id).
Windows are merged, where they overlap, into the runs that a text shares with
that one; a run's words are compared as a whole, and it is grown to the left and
right, word by word, as far as the words agree.  Where that does not come to
LEAST words, another text may still share more than the first: then all places
of the window are compared again by every stretch of LEAST words around it.  Runs of the same two texts with
up to GAP words between them are one passage (an edit lies between); passages
shorter than LEAST words are left alone.

A place in the text with the least doc_id stays, those in others are marked for
removal.  A text that only repeats itself is left alone.

A window that very many texts have is resolved task by task: each task that
meets it often points its places at its own least one, and only that goes on.
So a common passage never gathers in one task.  Equal lines count once.

Defined results: null, empty and short texts have no paragraphs; rows that
repeat an id are one document; rows without an id are left alone; an empty table
gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import MOST_SENT, Interned, cut, join_ids, offsets, pieces, resident, small_batches
from skein.llm.components import components
from skein.llm.ngram_join import Metric, Union, block_links, block_ranges, connect, mix, split_words

GRAM = 5
LEAST = 50
CORE, WIDTH = 16, 33
SPREAD = LEAST - CORE + 1
GAP = 2
BANDS, ROWS = 8, 3
NUM, DEN = 80, 100
#: Windows that a task packs at once, and how often one must come there to be resolved in the task.
MERGED, OFTEN = 1 << 20, 64
#: The n-grams that cover a window.
_COVER = [*range(0, WIDTH - GRAM, GRAM), WIDTH - GRAM]


def grams(digests: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Digest of every n-gram of the word digests."""
    rolled = np.zeros(max(0, len(digests) - gram + 1), dtype=np.uint64)
    for j in range(gram if len(rolled) else 0):
        rolled = mix(rolled + digests[j : len(digests) - gram + 1 + j] + np.uint64(0x9E3779B97F4A7C15))
    return rolled


def least_of(values: np.ndarray, spread: int) -> np.ndarray:
    """Where the (first) least of each ``spread`` consecutive values lies."""
    at, size = np.arange(len(values)), 1
    while size < spread:
        step = min(size, spread - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


#: ASCII white space; a number for each byte; words whose bytes are summed up at once.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_AT_ONCE = 1 << 14


def _summed(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digest of each word: its bytes' numbers, each times one for its place in the word, summed up."""
    places = mix(np.arange(1, int(sizes.max(initial=0)) + 1, dtype=np.uint64) << np.uint64(9)) | np.uint64(1)
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), _AT_ONCE):
        some, size = starts[k : k + _AT_ONCE], sizes[k : k + _AT_ONCE]
        first = offsets(size)
        place = np.arange(int(first[-1])) - np.repeat(first[:-1], size)
        values = _BYTES[raw[np.repeat(some, size) + place]] * places[place]
        out[k : k + _AT_ONCE] = mix(np.add.reduceat(values, first[:-1]))
    return out


def digested(texts: list[str | None], digest: Interned, split: Callable[[str | None], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of all words of all texts, the number of words of each line (a text without any may count as lines, too), and of each text."""
    if split is not split_words:
        lines = [[split(line) for line in t.split("\n")] if t else [] for t in texts]
        per_line = np.fromiter((len(w) for text in lines for w in text), dtype=np.int64)
        per_text = np.fromiter((sum(map(len, text)) for text in lines), dtype=np.int64, count=len(texts))
        words = chain.from_iterable(chain.from_iterable(lines))
        return np.fromiter(map(digest.__getitem__, words), dtype=np.uint64, count=int(per_text.sum())), per_line, per_text
    # The words of ``split_words`` are found and digested in the bytes of all texts at once.
    parts = [t.encode() if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts).lower(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    newlines = np.flatnonzero(raw == ord("\n"))
    per_line = np.diff(np.searchsorted(starts, np.concatenate([[0], newlines, [len(raw)]])))
    begins = offsets([len(p) + 1 for p in parts])
    per_text = np.diff(np.searchsorted(starts, begins))
    return _summed(raw, starts, ends - starts), per_line, per_text


def word_digests(texts: list[str | None], digest: Interned, split: Callable[[str | None], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of all texts, and where each text's begin."""
    flat, _, per_text = digested(texts, digest, split)
    return flat, offsets(per_text)


def _marked(at: np.ndarray, total: int) -> np.ndarray:
    """The different numbers, below ``total``, in order."""
    marks = np.zeros(total, dtype=bool)
    marks[at] = True
    return np.flatnonzero(marks)


class Paragraphs:
    """The paragraphs of a batch of texts."""

    def __init__(self, texts: list[str | None], digest: Interned, split: Callable[[str | None], list[bytes]]):
        self.words, per_line, per_text = digested(texts, digest, split)
        total = len(self.words)
        self.ends = offsets(per_text)
        self.rolled = grams(self.words)
        row = np.repeat(np.arange(len(texts)), per_text)
        place = np.arange(total) - self.ends[row]
        if total >= LEAST:
            spread = least_of(self.rolled[: total - CORE + 1], SPREAD)
            whole = place[: len(spread)] + LEAST <= per_text[row[: len(spread)]]
            anchor = _marked(spread[whole], total)
        else:
            anchor = np.zeros(0, dtype=np.int64)
        at = anchor[place[anchor] + WIDTH <= per_text[row[anchor]]]
        before = anchor[place[anchor] >= WIDTH - CORE] - (WIDTH - CORE)
        at = _marked(np.concatenate([at, before]), total)
        #: Row, start word and name of each window.
        self.window_row, self.window_start = row[at], place[at]
        self.window_name = np.full(len(at), 1, dtype=np.uint64)
        for j in _COVER:
            self.window_name = mix(self.window_name + self.rolled[at + j])
        first = offsets(per_line)[:-1]
        long = per_line >= LEAST
        #: Row, start word and number of words of each line, and where its n-grams lie.
        self.line_at, self.line_size = first[long], per_line[long]
        self.line_row = row[self.line_at]
        self.line_start = place[self.line_at]
        self.line_name = np.array([xxhash.xxh3_64_intdigest(self.line_grams(k).tobytes()) for k in range(len(self.line_at))], dtype=np.uint64)

    def line_grams(self, k: int) -> np.ndarray:
        return self.rolled[self.line_at[k] : self.line_at[k] + self.line_size[k] - GRAM + 1]

    def bands(self) -> list[np.ndarray]:
        """For each band, the signature of every line."""
        n = len(self.line_at)
        if not n:
            return [np.zeros(0, dtype=np.uint64)] * BANDS
        flat = np.concatenate([self.line_grams(k) for k in range(n)])
        starts = offsets(self.line_size - GRAM + 1)[:-1]
        out = []
        for band in range(BANDS):
            agreed = np.full(n, band + 1, dtype=np.uint64)
            for number in range(ROWS):
                seed = mix(np.array([band * ROWS + number + 1], dtype=np.uint64))
                agreed = mix(agreed + np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), starts))
            out.append(agreed)
        return out


_WINDOW = np.dtype([("name", "<u8"), ("doc", "<i8"), ("start", "<i4")])
_HELD = np.dtype([("name", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("other", "<i8"), ("other_start", "<i4")])
_LINE = np.dtype([("sig", "<u8"), ("name", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
_FOUND = "name long, lead long, doc long, start int, end int, other long, other_start int"


def _first_of(runs: np.ndarray) -> np.ndarray:
    """Whether each row's key differs from that of the row before."""
    first = np.ones(len(runs), dtype=bool)
    first[1:] = runs[1:] != runs[:-1]
    return first


def _atoms(rows: np.ndarray) -> np.ndarray:
    """Windows in order of name and place, each pointed at the first of its name, but those in the first's own text."""
    first = _first_of(rows["name"])
    lead = rows[first][np.cumsum(first) - 1]
    held = np.empty(len(rows), dtype=_HELD)
    for c in _WINDOW.names:
        held[c] = rows[c]
    held["other"], held["other_start"] = lead["doc"], lead["start"]
    return held[held["doc"] != held["other"]]


def _signed(split, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = resident(("digests",), lambda: Interned(xxhash.xxh3_64_intdigest))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def deal(rows: np.ndarray, key: str) -> list[bytes]:
            at = ((rows[key] >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
            rows = rows[np.argsort(at, kind="stable")]
            ends = np.searchsorted(np.sort(at), np.arange(ranges + 1))
            return [rows[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

        def flush() -> pa.RecordBatch:
            windows, lines = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            windows = windows[np.lexsort((windows["start"], windows["doc"], windows["name"]))]
            first = _first_of(windows["name"])
            often = (np.bincount(np.cumsum(first) - 1) > OFTEN)[np.cumsum(first) - 1] if len(windows) else first
            held = _atoms(windows[often])
            windows = windows[~often | first]
            lines = lines[np.lexsort((lines["start"], lines["doc"], lines["name"], lines["sig"]))]
            lines = lines[_first_of(lines[["sig", "name"]])]
            # What is resolved already goes anywhere.
            scattered = held[np.argsort(held["doc"], kind="stable")]
            cuts = np.linspace(0, len(scattered), ranges + 1).astype(np.int64)
            columns = [deal(windows, "name"), deal(lines, "sig"), [scattered[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]]
            full = [k for k in range(ranges) if any(c[k] for c in columns)]
            arrays = [pa.array([c[k] for k in full], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *arrays], names=["range", "windows", "lines", "held"])

        for batch in pieces(batches):
            digest.trim()
            found = Paragraphs(batch.column("text").to_pylist(), digest, split)
            doc = batch.column("doc_id").to_numpy()
            windows = np.empty(len(found.window_row), dtype=_WINDOW)
            windows["name"], windows["doc"], windows["start"] = found.window_name, doc[found.window_row], found.window_start
            lines = np.empty((BANDS, len(found.line_row)), dtype=_LINE)
            for band, sig in enumerate(found.bands()):
                lines[band]["sig"] = sig
            lines["name"], lines["doc"], lines["start"] = found.line_name, doc[found.line_row], found.line_start
            lines["end"] = found.line_start + found.line_size
            waiting.append((windows, lines.ravel()))
            if sum(len(w) + len(n) for w, n in waiting) >= MERGED:
                yield flush()
        if waiting:
            yield flush()

    return run


def _collide(rows: pa.Table) -> pa.Table:
    """Windows pointed at the first of their name; lines that share a signature with a different one, each with the bucket's first."""

    def read(column: str, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=kind)

    windows, lines = read("windows", _WINDOW), read("lines", _LINE)
    held = np.concatenate([_atoms(windows[np.lexsort((windows["start"], windows["doc"], windows["name"]))]), read("held", _HELD)])
    lines = lines[np.lexsort((lines["start"], lines["doc"], lines["name"], lines["sig"]))]
    lines = lines[_first_of(lines[["sig", "name"]])]
    first = _first_of(lines["sig"])
    bucket = np.cumsum(first) - 1
    lead = lines["name"][first][bucket]
    several = np.bincount(bucket)[bucket] > 1 if len(lines) else first
    lines, lead = lines[several], lead[several]
    a, b = len(held), len(lines)
    return pa.table(
        {
            "name": pa.array(np.concatenate([held["name"], lines["name"]]).view(np.int64)),
            "lead": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(lead.view(np.int64))]),
            "doc": pa.array(np.concatenate([held["doc"], lines["doc"]])),
            "start": pa.array(np.concatenate([held["start"], lines["start"]])),
            "end": pa.array(np.concatenate([held["start"] + WIDTH, lines["end"]]).astype(np.int32)),
            "other": pa.concat_arrays([pa.array(held["other"]), pa.nulls(b, pa.int64())]),
            "other_start": pa.concat_arrays([pa.array(held["other_start"]), pa.nulls(b, pa.int32())]),
        }
    )


def _signed_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _merged(width: int):
    """Overlapping windows that a text has in common with another, at one distance, as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, other, windows in zip(batch.column("doc").to_pylist(), batch.column("other").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                last = None
                for w in sorted(windows, key=lambda w: (w["other_start"] - w["start"], w["start"])):
                    shift, start = w["other_start"] - w["start"], w["start"]
                    if last and last[4] == shift and start <= last[3]:
                        last[3], last[5] = start + width, min(last[5], w["name"])
                    else:
                        last = [doc, other, start, start + width, shift, w["name"]]
                        out.append(last)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "other", "low", "high", "shift", "name"])

    return run


_RUNS = "doc long, other long, low int, high int, shift int, name long"


def _merge(atoms: DataFrame, width: int) -> DataFrame:
    windows = atoms.groupBy("doc", "other").agg(F.collect_set(F.struct("start", "other_start", "name")).alias("windows"))
    return windows.mapInArrow(_merged(width), _RUNS)


#: Cells of the table of lines by n-grams in which the overlaps of a block are counted; a larger block goes to the trie.
TABLE = 1 << 22


def line_links(sets: list[np.ndarray], sizes: np.ndarray, metric: Metric) -> list[tuple[int, int]]:
    """Pairs of linked lines, enough to connect all that links connect, by the overlaps of all lines of a block."""
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    needs = metric.need(counts, sizes)
    if len(sets) == 2:
        overlap = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if overlap * metric.unit >= needs.sum() else []
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often > 1
    if len(sets) * int(several.sum()) > TABLE:
        return block_links(sets, sizes, metric)
    column, kept = np.cumsum(several) - 1, several[number]
    table = np.zeros((len(sets), int(several.sum())), dtype=np.float32)
    table[np.repeat(np.arange(len(sets)), counts)[kept], column[number[kept]]] = 1
    overlaps = (table @ table.T).astype(np.int64)
    union = Union(len(sets))
    linked = np.argwhere(np.triu(overlaps * metric.unit >= needs[:, None] + needs, 1)).tolist()
    return [(a, b) for a, b in linked if union.join(a, b)]


def _stretches(split):
    """Every stretch of LEAST words around the windows that are asked for: its name, doc and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = resident(("digests",), lambda: Interned(xxhash.xxh3_64_intdigest))
        for batch in pieces(batches):
            digest.trim()
            flat, ends = word_digests(batch.column("text").to_pylist(), digest, split)
            names, docs, starts = [], [], []
            for k, (doc, asked) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                words = flat[ends[k] : ends[k + 1]]
                around = {at for start in asked for at in range(max(0, start - LEAST + WIDTH), min(start, len(words) - LEAST) + 1)}
                for at in around:
                    names.append(_signed_long(xxhash.xxh3_64_intdigest(words[at : at + LEAST].tobytes())))
                    docs.append(doc)
                    starts.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32())], names=["name", "doc", "start"])

    return run


def _shared_with_others(texts: DataFrame, atoms: DataFrame, passages: DataFrame, split) -> DataFrame:
    """Runs that texts share with others than the first of a window, for the windows that no passage with the first covers."""
    done = passages.select(F.col("doc_id").alias("doc"), "start_word", "end_word")
    within = (F.col("start_word") <= F.col("start")) & (F.col("start") + WIDTH <= F.col("end_word"))
    covered = atoms.join(done, "doc", "left").groupBy("name", "doc", "start").agg(F.max(F.coalesce(within, F.lit(False))).alias("in"))
    short = cut(covered.where("not in").select("name").distinct())
    few = F.broadcast(short) if short.count() <= MOST_SENT else short
    members = atoms.join(few, "name", "left_semi")
    members = members.select("doc", "start").unionByName(members.select(F.col("other").alias("doc"), F.col("other_start").alias("start")))
    asked = cut(members.groupBy("doc").agg(F.collect_set("start").alias("asked")))
    near = join_ids(texts, asked.select("doc"), ["doc"], "left_semi").join(asked, "doc")
    named = cut(near.mapInArrow(_stretches(split), "name long, doc long, start int"), short)
    firsts = named.groupBy("name").agg(F.min(F.struct("doc", "start")).alias("p"), F.max("doc").alias("last")).where("p.doc <> last")
    again = named.join(firsts, "name").where("doc <> p.doc").select("name", "doc", "start", F.col("p.doc").alias("other"), F.col("p.start").alias("other_start"))
    return cut(_merge(again, LEAST), named, asked)


#: Words beside a run that are compared: the next anchor on either side would lie in them.
_BESIDE = SPREAD


def _fetched(split):
    """What is asked of texts: for each stretch its digest, the words beside it, and if ``whole`` its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = resident(("digests",), lambda: Interned(xxhash.xxh3_64_intdigest))
        for batch in pieces(batches):
            digest.trim()
            flat, ends = word_digests(batch.column("text").to_pylist(), digest, split)
            out: list[list] = [[] for _ in range(8)]
            for k, (doc, asked) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                words = flat[ends[k] : ends[k + 1]]
                for q in asked:
                    low, high = q["low"], q["high"]
                    if high > len(words):
                        continue
                    body = words[low:high]
                    rolled = grams(body) if q["whole"] else None
                    row = (
                        doc, low, high, q["whole"],
                        _signed_long(xxhash.xxh3_64_intdigest((rolled if q["whole"] else body).tobytes())),
                        words[max(0, low - _BESIDE) : low].tobytes(),
                        words[high : high + _BESIDE].tobytes(),
                        np.unique(rolled).tobytes() if q["whole"] else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            names = ["doc", "low", "high", "whole", "body", "left", "right", "grams"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _agree(a: bytes, b: bytes, back: bool) -> int:
    """How many words agree, from the run outwards."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if back:
        x, y = x[::-1], y[::-1]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [_agree(a, b, True) for a, b in zip(batch.column("left").to_pylist(), batch.column("other_left").to_pylist(), strict=True)]
        right = [_agree(a, b, False) for a, b in zip(batch.column("right").to_pylist(), batch.column("other_right").to_pylist(), strict=True)]
        low = batch.column("low").to_numpy() - np.array(left, dtype=np.int32)
        high = batch.column("high").to_numpy() + np.array(right, dtype=np.int32)
        ends = [pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("other"), *ends, batch.column("shift"), batch.column("name")], names=["doc", "other", "low", "high", "shift", "name"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the same two texts that follow one another in both, as passages; those of LEAST words or more, and their counterparts."""
    for batch in batches:
        out = []
        for doc, other, runs in zip(batch.column("doc").to_pylist(), batch.column("other").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            kept: list[list[int]] = []
            for r in sorted(runs, key=lambda r: (r["low"], r["high"], r["shift"])):
                low, high, there = r["low"], r["high"], r["low"] + r["shift"]
                for p in kept[-4:]:
                    if low - p[1] <= GAP and abs(there - p[3]) <= GAP + max(0, p[1] - low):
                        p[1], p[3], p[4] = max(p[1], high), max(p[3], high + r["shift"]), min(p[4], r["name"])
                        break
                else:
                    kept.append([low, high, there, high + r["shift"], r["name"]])
            for low, high, there, end, name in kept:
                if high - low >= LEAST:
                    out += [(doc, low, high, name, other, False), (other, there, end, name, other, True)]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_PASSAGE)


def _join(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc", "other").agg(F.collect_set(F.struct("low", "high", "shift", "name")).alias("runs")).mapInArrow(_joined, _PASSAGES)


_PASSAGE = ["doc_id", "start_word", "end_word", "class_id", "first_doc_id", "kept"]
_PASSAGES = "doc_id long, start_word int, end_word int, class_id long, first_doc_id long, kept boolean"


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    num: int = NUM,
    den: int = DEN,
    split: Callable[[str | None], list[bytes]] = split_words,
) -> DataFrame:
    """A row per repeated passage and text: doc_id (a whole number), start_word, end_word, class_id, first_doc_id, kept.

    Words are numbered from 0 and lie between ASCII white space; end_word is
    exclusive.  first_doc_id is the document, of a lesser id, that the passage
    was found in again; the place there has a row of its own, with kept = true,
    unless it goes because of a third document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    signed = texts.mapInArrow(_signed(split, block_ranges(spark)), "range long, windows binary, lines binary, held binary")
    found = cut(signed.groupBy("range").applyInArrow(_collide, _FOUND))

    atoms = found.where("lead is null").select("name", "doc", "start", "other", "other_start")
    runs = cut(_merge(atoms, WIDTH))
    # Equal lines are found by their windows, so each different line needs one place.
    place = F.struct("doc", "start", "end")
    lines = found.where("lead is not null")
    edges = cut(lines.where("name <> lead").select(F.col("name").alias("a"), F.col("lead").alias("b")).distinct())
    blocks = components(edges).select(F.col("node").alias("name"), F.col("component").alias("comp"))
    lines = cut(lines.groupBy("name").agg(F.min(place).alias("p")).join(blocks, "name").select("name", "comp", "p.*"))

    asked = runs.select("doc", "low", "high", F.lit(False).alias("whole"))
    asked = asked.unionByName(runs.select(F.col("other").alias("doc"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"), F.lit(False).alias("whole")))
    asked = asked.unionByName(lines.select("doc", F.col("start").alias("low"), F.col("end").alias("high"), F.lit(True).alias("whole")))
    asked = cut(asked.distinct().groupBy("doc").agg(F.collect_list(F.struct("low", "high", "whole")).alias("asked")))
    texts = texts.withColumnRenamed("doc_id", "doc")
    near = join_ids(texts, asked.select("doc"), ["doc"], "left_semi").join(asked, "doc")
    beside = cut(near.mapInArrow(_fetched(split), "doc long, low int, high int, whole boolean, body long, left binary, right binary, grams binary"))

    # Rows may repeat an id: only texts that hold the same run are compared.
    own = beside.where("not whole").select("doc", "low", "high", "body", "left", "right").distinct()
    there = own.select(F.col("doc").alias("other"), F.col("low").alias("other_low"), F.col("body").alias("other_body"), F.col("high").alias("other_high"), F.col("left").alias("other_left"), F.col("right").alias("other_right"))
    both = runs.join(own, ["doc", "low", "high"]).withColumns({"other_low": F.col("low") + F.col("shift"), "other_high": F.col("high") + F.col("shift")})
    both = both.join(there, ["other", "other_low", "other_high"]).where("body = other_body")
    grown = cut(both.select("doc", "other", "low", "high", "shift", "name", "left", "right", "other_left", "other_right").mapInArrow(_grown, _RUNS))
    further = _shared_with_others(texts, atoms, _join(grown), split)
    passages = _join(grown.unionByName(further))

    named = lines.join(beside.where("whole").select("doc", F.col("low").alias("start"), F.col("high").alias("end"), "body", "grams"), ["doc", "start", "end"])
    # A name is the digest of the line's n-grams.
    sets = named.where("body = name").groupBy("name").agg(F.first("comp").alias("comp"), F.first("grams").alias("grams"))
    sets = sets.select("comp", F.col("name").alias("rep"), (F.length("grams") / 8).cast("long").alias("n"), "grams")
    classes = connect(sets, num, den, finder=line_links).select(F.col("rep").alias("name"), F.col("root").alias("class_id"))
    classed = cut(lines.select("name", "doc", "start", "end").join(classes, "name"))
    firsts = classed.groupBy("class_id").agg(F.min(place).alias("p"), F.max("doc").alias("last")).where("p.doc <> last")
    shared = classed.join(firsts, "class_id").where((F.col("doc") != F.col("p.doc")) | (F.col("start") == F.col("p.start")))
    similar = shared.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "class_id", F.col("p.doc").alias("first_doc_id"), (F.col("doc") == F.col("p.doc")).alias("kept")
    )
    every = cut(passages.unionByName(similar).distinct(), found, runs, lines, edges, asked, beside, grown, further, classed)
    # What goes itself because of a third text stays nowhere.
    gone = every.where("not kept").select("doc_id", F.col("start_word").alias("low"), F.col("end_word").alias("high"))
    stays = every.where("kept").join(gone, "doc_id", "left").groupBy(*_PASSAGE).agg(F.max((F.col("low") < F.col("end_word")) & (F.col("start_word") < F.col("high"))).alias("met"))
    return every.where("not kept").unionByName(stays.where("met is null or not met").select(*_PASSAGE))


def removal_spans(passages: DataFrame) -> DataFrame:
    """doc_id and spans (array of start_word, end_word, disjoint and sorted) of the places that do not stay."""
    gone = passages.where("not kept").select("doc_id", F.struct("start_word", "end_word").alias("span")).distinct()
    spans = gone.groupBy("doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))

    def join_last(done, span):
        last = F.element_at(done, -1)
        widened = F.struct(last["start_word"].alias("start_word"), F.greatest(last["end_word"], span["end_word"]).alias("end_word"))
        kept = F.slice(done, 1, F.size(done) - 1)
        touches = (F.size(done) > 0) & (span["start_word"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end_word"], F.lit(-1)))
        return F.when(touches, F.concat(kept, F.array(widened))).otherwise(F.concat(done, F.array(span)))

    empty = F.array().cast("array<struct<start_word: int, end_word: int>>")
    return spans.select("doc_id", F.aggregate("spans", empty, join_last).alias("spans"))

"""Document quality by a linear-chain conditional random field over lines.

Every line is good (1) or bad (0).  Its features describe itself and the lines
on either side; neighbouring labels are tied by learned transition weights.
Forward-backward gives each line's marginal probability of being good, and a
document's score is their mean, each line weighted by its length.

The field is fitted to a bounded sample of labelled documents (about
``docs_per_label`` of each label, chosen by a hash of the id); every line of
such a document has the document's label.

Defined results: a null text counts as empty, an empty text is one empty line,
so both get a score; without labelled rows every score is 0.5; rows that repeat
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import offsets, pieces, small_batches

DOCS_PER_LABEL = 600
CHARS_PER_DOC = 50_000
STEPS = 80
#: A text of so many line ends is scored by itself, in stretches of so many lines.
LONG_LINES, STRETCH = 2_000, 1 << 15
RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_ALPHA = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_PLAIN = _ALPHA + _DIGITS + b" \t\r.,;:'\"()-"
OWN = 12
#: Own features, those of the line before and after, and whether there is such a line.
WIDTH = 3 * OWN + 2


def line_features(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    """Features of one line of a document whose earlier lines are ``seen`` (and which then has this one too)."""
    n = len(line)
    if not n:
        return (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    words = line.split()
    count = max(1, len(words))
    letters = n - len(line.translate(None, _ALPHA))
    again = float(line in seen)
    seen.add(line)
    return (
        1.0,
        (n - len(line.translate(None, _UPPER))) / max(1, letters),
        len(line.translate(None, _PLAIN)) / n,
        (n - len(line.translate(None, _DIGITS))) / n,
        n / count / 10.0,
        np.log1p(count) / 5.0,
        1.0 - len(set(words)) / count,
        sum(map(eq, words, words[1:])) / count,
        again,
        float(line[-1:] in (b".", b"?", b"!", b":")),
        sum(map((4).__gt__, map(len, words))) / count,
        0.0,
    )


class Lines:
    """The lines of a batch of texts: features, weights, and where each text's lines lie."""

    def __init__(self, texts: list[str | None]):
        rows, sizes, counts = [], [], []
        for text in texts:
            lines = (text or "").encode().split(b"\n")
            seen: set[bytes] = set()
            rows += [line_features(line, seen) for line in lines]
            sizes += [len(line) + 1 for line in lines]
            counts.append(len(lines))
        own = np.array(rows, dtype=np.float64).reshape(-1, OWN)
        self.counts = np.array(counts, dtype=np.int64)
        self.starts = offsets(counts)
        self.sizes = np.array(sizes, dtype=np.float64)
        n = len(own)
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        first[self.starts[:-1]] = True
        last[self.starts[1:] - 1] = True
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first], after[last] = 0.0, 0.0
        self.x = np.hstack([own, before, after, ~first[:, None], ~last[:, None]])


class LineField:
    def __init__(self, weights: np.ndarray | None = None, ties: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.ties = np.zeros((2, 2)) if ties is None else ties

    def _lattice(self, lines: Lines):
        """Marginals of label 1, transition expectations and the log partition sum, all texts in step."""
        good = np.clip(lines.x @ self.weights, -30, 30)
        emit = np.stack([np.exp(-good / 2), np.exp(good / 2)], axis=1)
        tie = np.exp(self.ties)
        order = np.argsort(-lines.counts, kind="stable")
        start, counts = lines.starts[:-1][order], lines.counts[order]
        longest = int(counts[0]) if len(counts) else 0
        active = [int(np.searchsorted(-counts, -t, side="left")) for t in range(longest + 1)]  # texts with over t lines
        ahead = np.zeros((len(emit), 2))
        scale = np.ones(len(emit))
        for t in range(longest):
            k = active[t]
            at = start[:k] + t
            a = emit[at] if t == 0 else (ahead[at - 1] @ tie) * emit[at]
            scale[at] = a.sum(axis=1)
            ahead[at] = a / scale[at, None]
        back = np.ones((len(emit), 2))
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            at = start[:k] + t
            follow = emit[at + 1] * back[at + 1] / scale[at + 1, None]
            back[at] = follow @ tie.T
            pairs += (ahead[at].T @ follow) * tie
        both = ahead * back
        return both[:, 1] / both.sum(axis=1), pairs, np.log(scale).sum()

    def fit(self, texts: list[str], labels: list[int], steps: int = STEPS, ridge: float = RIDGE, rate: float = 0.1) -> LineField:
        """Maximise the conditional likelihood of the labels by Adam over all sampled texts."""
        lines = Lines(texts)
        y = np.repeat(np.array(labels, dtype=np.float64), lines.counts)
        inner = np.ones(len(y), dtype=bool)
        inner[lines.starts[:-1]] = False
        seen = np.zeros((2, 2))
        now = np.flatnonzero(inner)
        np.add.at(seen, (y[now - 1].astype(int), y[now].astype(int)), 1.0)
        size = WIDTH + 4
        at, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for step in range(1, steps + 1):
            self.weights, self.ties = at[:WIDTH], at[WIDTH:].reshape(2, 2)
            p, pairs, _ = self._lattice(lines)
            slope = np.concatenate([lines.x.T @ (y - p), (seen - pairs).ravel()]) / max(1, len(y)) - ridge * at
            m = 0.9 * m + 0.1 * slope
            v = 0.999 * v + 0.001 * slope**2
            at = at + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.ties = at[:WIDTH].copy(), at[WIDTH:].reshape(2, 2).copy()
        return self

    def line_marginals(self, lines: Lines) -> np.ndarray:
        return self._lattice(lines)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        long = np.array([text is not None and text.count("\n") >= LONG_LINES for text in texts], dtype=bool)
        for k in np.flatnonzero(long):
            out[k] = self._score_long(texts[k].encode())
        if short := [texts[k] for k in np.flatnonzero(~long)]:
            lines = Lines(short)
            weighted = np.add.reduceat(self.line_marginals(lines) * lines.sizes, lines.starts[:-1])
            out[~long] = weighted / np.add.reduceat(lines.sizes, lines.starts[:-1])
        return np.clip(out, 0.0, 1.0)

    def _score_long(self, data: bytes) -> float:
        """The score of one text of many lines: features by stretches of lines, of which one number a line is kept."""
        ends = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), len(data))
        n, seen = len(ends), set()
        good = np.zeros(n)
        good[1:] += self.weights[3 * OWN]
        good[:-1] += self.weights[3 * OWN + 1]
        here, before, after = (self.weights[k * OWN : (k + 1) * OWN] for k in range(3))
        for at in range(0, n, STRETCH):
            stop = ends[at : at + STRETCH].tolist()
            start = [int(ends[at - 1]) + 1 if at else 0, *(e + 1 for e in stop[:-1])]
            own = np.array([line_features(data[a:b], seen) for a, b in zip(start, stop, strict=True)])
            to = at + len(own)
            good[at:to] += own @ here
            good[at + 1 : to + 1] += (own @ before)[: n - 1 - at]
            good[max(0, at - 1) : to - 1] += (own @ after)[0 if at else 1 :]
        sizes = np.diff(ends, prepend=-1)
        return float((_chain_marginals(good, np.exp(self.ties)) * sizes).sum() / sizes.sum())


def _chain_marginals(good: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Marginals of label 1 along one chain of lines, whose logits are ``good``.

    The chain is cut into about as many blocks as a block has lines.  The blocks'
    products of 2 x 2 steps are formed side by side, carried over from block to
    block, and then all blocks run forward and backward side by side: two times the
    square root of the number of lines in steps, not the number itself.
    """
    n = len(good)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    # The emissions of label 1, label 0 having those of 1 / x; lines beyond the end pass on what they get.
    up = np.ones(blocks * length)
    np.exp(np.clip(good, -30, 30) / 2, out=up[:n])
    up, past = up.reshape(blocks, length), np.arange(blocks * length).reshape(blocks, length) >= n

    def step(t: int) -> np.ndarray:
        m = tie * np.stack([1 / up[:, t], up[:, t]], axis=1)[:, None, :]
        m[past[:, t]] = np.eye(2)
        if t == 0:  # the first line of all has no line before it
            m[0] = np.array([1 / up[0, 0], up[0, 0]])
        return m

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.reshape(len(x), -1).sum(axis=1).reshape(-1, *[1] * (x.ndim - 1))

    whole = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(length):
        whole = scaled(whole @ step(t))
    left, right = np.full((blocks, 2), 0.5), np.full((blocks, 2), 0.5)
    for b in range(1, blocks):
        left[b] = left[b - 1] @ whole[b - 1]
        left[b] /= left[b].sum()
    for b in range(blocks - 2, -1, -1):
        right[b] = whole[b + 1] @ right[b + 1]
        right[b] /= right[b].sum()
    ahead = np.empty((blocks, length))  # the share of label 1; that of label 0 is the rest
    for t in range(length):
        left = scaled((left[:, None, :] @ step(t))[:, 0])
        ahead[:, t] = left[:, 1]
    for t in range(length - 1, -1, -1):
        one = ahead[:, t] * right[:, 1]
        nought = (1 - ahead[:, t]) * right[:, 0]
        right = scaled((step(t) @ right[:, :, None])[:, :, 0])
        ahead[:, t] = one / (one + nought)
    return ahead.reshape(-1)[:n]


def learn(
    docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL, chars_per_doc: int = CHARS_PER_DOC, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> LineField:
    """A field fitted to the labelled rows (0 or 1; others teach nothing) of ``docs``.

    Two counts come to the driver, then about ``docs_per_label`` texts of each
    label, of which the first ``chars_per_doc`` characters teach.
    """
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not counts:
        return LineField()
    place = F.shiftrightunsigned(F.xxhash64(F.col("i").cast("string")), 11).cast("double") / float(1 << 53)
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, docs_per_label / n).otherwise(share)
    chosen = marked.withColumn("place", place).where(F.col("place") < share).distinct().collect()
    # The chosen ids, about docs_per_label of each label, are what the documents meet: no text is shuffled.
    ids = docs.sparkSession.createDataFrame(chosen, f"i {dict(marked.dtypes)['i']}, y int, place double")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where("text is not null")
    rows = sorted(texts.join(F.broadcast(ids), "i").select("place", "y", F.substring("text", 1, chars_per_doc).alias("text")).collect(), key=tuple)
    return LineField().fit([r["text"] for r in rows], [r["y"] for r in rows]) if rows else LineField()


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row, from its text alone."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = field.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, score double, predicted int")

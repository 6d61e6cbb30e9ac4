"""Fill-in-the-middle: a text is cut in three, and its middle is moved behind the rest.

The cuts of all rows of an Arrow batch are found together in its UTF-8 buffer:

* a table gives every byte its class, and a table of class pairs says whether a
  unit (line, word or character) begins between two adjacent bytes;
* cumulative sums of these marks, taken relative to each document's first one,
  number the units of every document;
* a search in the sums finds the byte at which the unit of a given number begins.

The buffer is gone through in blocks, so a text of any length needs memory for
itself and one block.  What is cut is put together by Arrow: prefix, middle and
suffix of all rows are one string array over the same bytes.

Where a text is cut, and in which form it is written, follows from the SHA-256
of a seed and the document's id.  Two uniform numbers pick the cuts.

Defined results: a null text counts as empty; empty texts, texts that hold a
marker, and those beyond ``rate`` of 100 stay plain, with null lengths; rows that
repeat an id have the same numbers; a row without an id hashes as the seed
alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import pieces, small_batches

SEED = 7
RATE = 100
SPM_RATE = 50
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 4 << 20

_OTHER, _SPACE, _NEWLINE, _INNER = range(4)
#: The class of a byte: line feed, other ASCII white space, the later bytes of a character, all else.
CLASSES = np.full(256, _OTHER, dtype=np.uint8)
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
CLASSES[0x0A] = _NEWLINE
CLASSES[0x80:0xC0] = _INNER


def _pairs(begins: Callable[[int, int], bool]) -> np.ndarray:
    return np.array([[begins(a, b) for b in range(4)] for a in range(4)])


#: Whether a unit begins between a byte of one class and the next byte, of another.  A word has the white space after it.
BOUNDARIES = {
    "line": _pairs(lambda a, b: a == _NEWLINE),
    "word": _pairs(lambda a, b: a in (_SPACE, _NEWLINE) and b not in (_SPACE, _NEWLINE)),
    "char": _pairs(lambda a, b: b != _INNER),
}


class Marks:
    """Where units begin in the documents that lie end to end in ``data``; ``edges`` are their ends, n + 1 values."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, unit: str, block: int = BLOCK):
        self.data, self.block = data, block
        self.starts = np.unique(edges[:-1][edges[:-1] < edges[1:]])
        # One flat table: class before * 4 + class.
        self.begins = BOUNDARIES[unit].ravel()
        self.last: tuple[int, np.ndarray] | None = None

    def sums(self, at: int) -> np.ndarray:
        """How many units begin in the block at byte ``at``, up to and with each of its bytes."""
        if self.last is None or self.last[0] != at:
            kinds = CLASSES[self.data[max(0, at - 1) : at + self.block]]
            if at == 0:
                kinds = np.concatenate([kinds[:1], kinds])
            mark = self.begins[kinds[:-1] * 4 + kinds[1:]]
            a, b = np.searchsorted(self.starts, (at, at + self.block))
            mark[self.starts[a:b] - at] = True
            self.last = at, np.cumsum(mark, dtype=np.int32)
        return self.last[1]

    def before(self, at: np.ndarray) -> np.ndarray:
        """The number of units that begin before each of the bytes ``at`` (up to the end of the data)."""
        out, total = np.zeros(len(at), dtype=np.int64), 0
        for begin in range(0, len(self.data), self.block):
            sums = self.sums(begin)
            here = (at > begin) & (at <= begin + len(sums))
            out[here] = total + sums[at[here] - begin - 1]
            total += int(sums[-1])
        return out

    def place(self, number: np.ndarray) -> np.ndarray:
        """The byte at which the unit of each ``number`` (from 0, over all documents) begins; the data's end if there is none."""
        out, total = np.full(len(number), len(self.data), dtype=np.int64), 0
        for begin in range(0, len(self.data), self.block):
            sums = self.sums(begin)
            here = (number >= total) & (number < total + sums[-1])
            out[here] = begin + np.searchsorted(sums, number[here] - total + 1)
            total += int(sums[-1])
        return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the n + 1 ends of its values in them."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "line", block: int = BLOCK):
    """Of every text: its number of units n, and the byte (in the array's bytes) and character at which its prefix and its middle end.

    The prefix has the smaller of ``first`` and ``second`` modulo n + 1 units, prefix and middle the larger.
    Returns n, ends (4 bytes a row: start, two cuts, end), chars (the same in characters from the text's start).
    """
    data, edges = bytes_of(texts)
    marks = Marks(data, edges, unit, block)
    base = marks.before(edges)
    n = np.diff(base)
    a, b = first % (n + 1), second % (n + 1)
    number = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    # The unit after a document's last one begins with the next document that has any.
    inner = np.minimum(marks.place((base[:-1, None] + number).ravel()).reshape(-1, 2), edges[1:, None])
    ends = np.concatenate([edges[:-1, None], inner, edges[1:, None]], axis=1)
    chars = Marks(data, edges, "char", block).before(ends.ravel()).reshape(-1, 4)
    return n, ends, chars - chars[:, :1]


def transform(texts: pa.Array, first: np.ndarray, second: np.ndarray, moved: np.ndarray, spm: np.ndarray, unit: str = "line") -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of every text; ``moved`` and ``spm`` say which are moved, and in which form."""
    n, ends, chars = cuts(texts, first, second, unit)
    data, _ = bytes_of(texts)
    held = pc.match_substring(texts, PREFIX)
    for marker in (SUFFIX, MIDDLE):
        held = pc.or_(held, pc.match_substring(texts, marker))
    plain = ~moved | (n == 0) | held.to_numpy(zero_copy_only=False)
    # Prefix, middle and suffix of every row, one after another over the same bytes.
    edges = np.append(ends[:, :3].ravel(), len(data))
    parts = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    at = np.flatnonzero(~plain)
    prefix, middle, suffix = (parts.take(pa.array(3 * at + k)) for k in range(3))
    way = pa.array(spm[at])
    wide = pa.large_string()
    head, then = pc.if_else(way, SUFFIX, PREFIX).cast(wide), pc.if_else(way, PREFIX, SUFFIX).cast(wide)
    one, two = pc.if_else(way, suffix, prefix), pc.if_else(way, prefix, suffix)
    joined = pc.binary_join_element_wise(head, one, then, two, pa.scalar(MIDDLE, wide), middle, pa.scalar("", wide))
    mask = pa.array(~plain)
    output = pc.replace_with_mask(texts.cast(wide), mask, joined)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return {
        "n": pa.array(n),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(chars[:, 1], mask=plain),
        "middle_chars": pa.array(chars[:, 2] - chars[:, 1], mask=plain),
        "output": output.cast(pa.string()),
    }


def numbers(id_col: str = "doc_id", seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle; each behind its marker.
    ``rate`` of 100 texts are moved, ``spm_rate`` of 100 of these as spm.
    """
    if unit not in BOUNDARIES:
        raise ValueError(f"unit: one of {', '.join(BOUNDARIES)}")
    small_batches(docs.sparkSession)
    h1, h2, h3, h4 = numbers(id_col, seed)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        h1.alias("h1"),
        h2.alias("h2"),
        (h3 % 100 < rate).alias("moved"),
        (h4 % 100 < spm_rate).alias("spm"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts, *rest = batch.columns
            made = transform(texts, *(c.to_numpy(zero_copy_only=False) for c in rest), unit=unit)
            yield pa.RecordBatch.from_arrays([ids, *made.values()], names=["doc_id", *made])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which an output of the given form was made."""
    parts = F.split(F.col(output), f"(?:{'|'.join(MARKERS)})", -1)
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    moved = F.when(F.col(form) == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(moved)


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS digest FROM documents),
lined AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         CAST(concat('0x', substr(digest, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(digest, 9, 8)) AS BIGINT) AS h2,
         CAST(concat('0x', substr(digest, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(digest, 25, 8)) AS BIGINT) AS h4
  FROM hashed),
cut AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b
  FROM lined),
parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(lines[1:a], ''), '') AS p, coalesce(array_to_string(lines[a + 1:b], ''), '') AS m, coalesce(array_to_string(lines[b + 1:], ''), '') AS s
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

"""Fill-in-middle documents, cut at places that a wavelet matrix over character classes locates.

A text's units are words with the white space before them, and white space at its end. Every byte has a symbol: its class
(white space, ASCII, first byte of a longer character, later byte) and whether it closes a unit. A wavelet matrix holds the
symbols of about a megabyte of documents, one bit vector with block counts per bit of the symbol. Ranks of the
closing symbols add up to the number of units before any byte, ranks of the others to the number of characters; a cut
behind k units is found by bisection on these ranks, for all documents at once.

The choices follow from sha256 of ``seed:doc_id``: two cuts, whether a document is cut at all, and the order of its parts
(prefix, suffix, middle or suffix, prefix, middle), each part behind its mark. Nothing is shuffled, and a task holds a block
of documents or one long document.

Defined cases: null and empty texts, and texts that hold a mark, stay plain; a null doc_id counts as empty text in the seed; a
text of white space alone is one unit; repeated rows give the same result each; an empty table gives no rows; only doc_id
and text are read, so other columns cannot clash; long texts are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

SPACE, ASCII, FIRST, LATER = range(4)
CLOSES = 4  # added to the class of a unit's last byte
BITS = 3
_CLASS = np.array([SPACE if b in b" \t\n\v\f\r" else ASCII if b < 128 else LATER if b < 192 else FIRST for b in range(256)], np.uint8)


class Wavelet:
    """Rank queries over a sequence of small symbols."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels = []
        for b in reversed(range(bits)):
            ones = (symbols >> b) & 1
            words = np.zeros((len(symbols) >> 6) + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each of the positions."""
        start, end = np.zeros(1, np.int64), at
        for i, level in enumerate(self.levels):
            one = symbol >> (len(self.levels) - 1 - i) & 1
            start, end = (level[2] + self._ones(level, x) if one else x - self._ones(level, x) for x in (start, end))
        return end - start

    def ranks(self, symbols, at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


class Units:
    """Unit and character counts of documents laid end to end."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        symbols = _CLASS[data]
        space = symbols == SPACE
        closes = np.zeros(len(data), bool)
        closes[:-1] = ~space[:-1] & space[1:]
        closes[(off[1:] - 1)[np.diff(off) > 0]] = True
        self.wave, self.off = Wavelet(symbols + closes * np.uint8(CLOSES)), off

    def before(self, at: np.ndarray) -> np.ndarray:
        """Units closed before each position."""
        return self.wave.ranks((CLOSES + SPACE, CLOSES + ASCII, CLOSES + FIRST, CLOSES + LATER), at)

    def characters(self, at: np.ndarray) -> np.ndarray:
        return at - self.wave.ranks((LATER, CLOSES + LATER), at)

    def counts(self) -> np.ndarray:
        return np.diff(self.before(self.off))

    def cuts(self, k: np.ndarray) -> np.ndarray:
        """For each document the position behind its first k units."""
        low, high = self.off[:-1].copy(), self.off[1:].copy()
        wanted = self.before(low) + k
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.before(mid) >= wanted
            low, high = np.where(enough | (low >= high), low, mid + 1), np.where(enough, mid, high)
        return high


@dataclass(frozen=True)
class Setting:
    seed: int = 42
    cut: int = 50  # of a hundred documents, those that are cut
    spm: int = 80  # of a hundred cut documents, those with the suffix first


def _drawn(doc_id: int | None, s: Setting) -> tuple[int, ...]:
    h = hashlib.sha256(f"{s.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def _infilled(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[pa.RecordBatch]:
    p, f, m = (x.encode() for x in MARKS)
    for batch in batches:
        data, off = common.utf8(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in common.chunks(off):
            at = off[i : j + 1] - off[i]
            part = data[off[i] : off[j]]
            units = Units(part, at)
            n = units.counts()
            drawn = [_drawn(d, s) for d in ids[i:j]]
            one, two = (np.array([d[k] for d in drawn], np.int64) % (n + 1) for k in (0, 1))
            first, second = units.cuts(np.minimum(one, two)), units.cuts(np.maximum(one, two))
            edges = [units.characters(x) for x in (at[:-1], first, second)]
            body = part.tobytes()
            form, before, middle, out = [], [], [], []
            for k, (_, _, h3, h4) in enumerate(drawn):
                text = body[at[k] : at[k + 1]]
                if not text or h3 % 100 >= s.cut or any(x in text for x in (p, f, m)):
                    row = ("plain", None, None, text)
                else:
                    a, b = first[k] - at[k], second[k] - at[k]
                    psm = p + text[:a] + f + text[b:] + m + text[a:b]
                    spm = f + text[b:] + p + text[:a] + m + text[a:b]
                    row = (*(("spm", "psm")[h4 % 100 >= s.spm],), int(edges[1][k] - edges[0][k]), int(edges[2][k] - edges[1][k]), spm if h4 % 100 < s.spm else psm)
                for column, value in zip((form, before, middle, out), row, strict=True):
                    column.append(value)
            columns = [pa.array(ids[i:j], pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def infilled(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    """One row per document: its number of units, its form, the characters of its first and middle part, and the new text."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return docs.mapInArrow(lambda b: _infilled(b, s), SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from what ``infilled`` made of it."""
    two = f"CASE {form} WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END"
    second = f"instr({output}, {two})"
    third = f"locate('{MIDDLE}', {output}, {second} + 3)"
    a, b, c = f"substring({output}, 4, {second} - 4)", f"substring({output}, {second} + 3, {third} - {second} - 3)", f"substring({output}, {third} + 3)"
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN concat({a}, {c}, {b}) ELSE concat({b}, {c}, {a}) END")


def digests(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    out = infilled(docs, s)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS r FROM d
), c AS (
  SELECT *, len(units) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 AS plain,
    least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN r[4] % 100 < 80 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

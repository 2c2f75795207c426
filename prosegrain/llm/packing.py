"""Packing documents into training sequences of balanced attention cost.

A document's tokens are its ids and one closing id. Documents may be cut. Whole sequences are cut off the front
of long documents; the rest are dealt, longest first, to the cheapest sequence with room for them, where a piece
of n tokens costs ``linear * n + n * n``. When no sequence has room, the document fills the emptiest ones in turn.

Each task packs its own rows, about ``block`` tokens at a time: nothing is shuffled and memory stays bounded by the
block and one document. The last tokens of a block go to sequences of 1024, 512, ... tokens, which need no padding.

Defined cases: null or empty text is the closing id alone; repeated rows are packed as often as they occur; an empty
table gives no rows; a null doc_id is kept; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from prosegrain.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLAIN = re.compile(r"[\x00-ɏ‐-‟]*")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile("  | \n|\n |[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_PLAIN.fullmatch(text))
    return True


class _Words(dict):
    """Ids of text between two cuts, as packed 32-bit integers; emptied when it holds ``most`` entries."""

    def __init__(self, encode, lead: str, most: int = 400_000):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = array("I", self.encode(self.lead + word)).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(json_file: str, ranks_file: str):
    """A function from a text to packed ids.

    A space between two other characters always starts a new piece of the byte-level pattern, so the text between
    such spaces is encoded once per distinct string. Text with characters outside the Latin blocks, where Unicode
    versions could differ, and text with the special token is encoded whole by the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_file)
    whole.no_truncation(), whole.no_padding()
    special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
    first, later = _Words(fast.encode_ordinary, ""), _Words(fast.encode_ordinary, " ")

    def encode(text: str) -> bytes:
        if not _latin(text) or special.search(text):
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _CUT.split(text) if _ODD.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")
        return first[parts[0]] + b"".join(map(later.__getitem__, parts[1:]))

    return encode


def balanced(lengths: list[int], capacity: int, linear: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once, sequences numbered from 0.

    All sequences are full, so their number is least; those after the last whole one have lengths that are powers of two.
    """
    out, n = [], 0
    rest = []
    for d, size in enumerate(lengths):
        whole = size // capacity
        out.extend((d, k * capacity, capacity, n + k, 0) for k in range(whole))
        n += whole
        if size % capacity:
            rest.append((size % capacity, d, whole * capacity))
    total = sum(size for size, _, _ in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if (total % capacity) >> b & 1][::-1]
    filled = [0] * len(sizes)
    spread: dict[int, list[tuple[int, int]]] = {}  # cheapest first, by the room that is left
    for s, size in enumerate(sizes):
        heapq.heappush(spread.setdefault(size, []), (0, s))
    rooms = sorted(spread)

    def place(d: int, start: int, take: int, s: int, cost: int) -> None:
        out.append((d, start, take, n + s, filled[s]))
        filled[s] += take
        left = sizes[s] - filled[s]
        if left:
            if left not in spread:
                bisect.insort(rooms, left)
            heapq.heappush(spread.setdefault(left, []), (cost + linear * take + take * take, s))

    def pop(room: int) -> tuple[int, int]:
        cost, s = heapq.heappop(spread[room])
        if not spread[room]:
            del spread[room]
            rooms.remove(room)
        return cost, s

    for size, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = [r for r in rooms if r >= size]
        if fits:
            room = min(fits, key=lambda r: (spread[r][0], r))
            cost, s = pop(room)
            place(d, start, size, s, cost)
            continue
        while size:
            cost, s = pop(rooms[-1])
            take = min(size, sizes[s] - filled[s])
            place(d, start, take, s, cost)
            start, size = start + take, size - take
    return out


def _packed(batches: Iterator[pa.RecordBatch], files: tuple[str, str], closing: int, capacity: int, linear: int, block: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(*files)
    end = np.asarray([closing], "<u4").tobytes()
    base = TaskContext.get().partitionId() << 40
    held: list[tuple[int, bytes]] = []
    tokens = 0

    def flush() -> pa.RecordBatch:
        nonlocal base, tokens
        pieces = balanced([len(x) // 4 for _, x in held], capacity, linear)
        rows = [(held[d][0], start, n, zlib.crc32(held[d][1][4 * start : 4 * (start + n)]), len(held[d][1]) // 4, base + s, at) for d, start, n, s, at in pieces]
        base += 1 + max((p[3] for p in pieces), default=-1)
        held.clear()
        tokens = 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            held.append((doc.as_py(), ids))
            tokens += len(ids) // 4
            if tokens >= block:
                yield flush()
    if held:
        yield flush()


def pack(docs: DataFrame, json_file: str, ranks_file: str, closing: int = 1, capacity: int = 2048, linear: int = 4096, block: int = 1 << 19) -> DataFrame:
    """One row per piece of a document: SCHEMA. ``capacity`` is a power of two; files hold one vocabulary as JSON and as ranks.

    ``linear`` is the cost of a token apart from attention in units of one query-key product; sequence ids are unique over
    all tasks and, as the input's partitions are read again alike, the same when a task is repeated.
    """
    files = (json_file, ranks_file)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(lambda b: _packed(b, files, closing, capacity, linear, block), SCHEMA)


def op7_cost_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

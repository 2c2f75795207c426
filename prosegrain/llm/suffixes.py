"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte that a string of ``size`` bytes covers which also starts elsewhere is to go. All such strings are found through
anchors: of the hashed 32-byte grams in a string the least, the first of equals, is its anchor, so equal strings have equal
anchors in equal places. Only anchors whose gram occurs more than once in the corpus can matter.

The places with one gram form a group. Their contexts to the right are sorted by a mergesort whose comparisons find the
common extension of two suffixes by binary search over prefix polynomial hashes; so are the contexts to the left. Neighbours'
extensions, checked byte by byte together with the order, certify the result; hashes that collided are
drawn anew. Descending the tree of common right extensions, each place takes its best common left extension within the node;
left and right together of ``size`` bytes or more are repeated strings. Strings that are not of this place's anchor
are left to the anchor they belong to.

Whole copies are settled first: texts are told apart by their MD5, a text that occurs twice goes whole, and one of its rows
stands for it. So are places with one gram whose strings are all alike, by a 64-bit hash beside that of the gram: they repeat whole,
and one stands for them. A gram with more than ``block`` places is dealt over several groups; what repeats only across them shows
in two 64-bit hashes of each string, of which each group sends every one once, packed in binary rows.

Anchors travel once, packed in binary rows by ranges of hashes of the grams' hashes; what occurs once ends there. A task sends at most ``often`` kinds
of places with one gram to its range, one place for each kind: that the others repeat is known by then, so they are dealt over all
ranges. Strings of bytes and of words share the pass over the texts, the join that brings the texts to their anchors, and the one that
brings the results to the texts; texts are shuffled in these two joins only.

Defined cases: null text is empty; texts shorter than ``size`` never lose bytes, whatever their copies; repeated
rows are copies; a null doc_id is kept; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common
from prosegrain.llm.common import U64, mix

GRAM = 32
PIECE = 1 << 20
#: Short texts are read in runs of about so many bytes.
RUN = 1 << 15
_PLACE = U64((1 << 26) - 1)
WINDOW = [("a", "<u8"), ("b", "<u8"), ("tid", "V16"), ("p", "<i4")]
ANCHOR = np.dtype([("key", "<i8"), ("sig", "<i8"), ("t1", "<u8"), ("t2", "<u8"), ("o", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("known", "<i4")])
#: What is known of an anchor in its task: that its strings repeat whole, that it stands for its kind of place.
ALIKE, MEETS = 1, 2
KEPT = "words boolean, key long, tid binary, o int, lo int, hi int, kinds int, alike boolean, meets boolean"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of the anchors of all strings of ``size`` bytes in data: gram hashes, hashes of all bytes of their strings, places, and
    the first and last string of each."""
    return run_anchors(data, np.array([0, len(data)]), size)[1:]


def run_anchors(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of each of the texts that stand end to end in data, with the number of its text before them."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(3)))
    if len(data) < size:
        return none
    h, factor = data.astype(U64) + U64(1), U64(0x9E3779B97F4A7C15)
    for step in (1, 2, 4, 8, 16):
        h = h[:-step] * factor + h[step:]
        factor = U64(int(factor) ** 2 % (1 << 64))
    key = mix(h)
    del h
    value = (key & ~_PLACE) | np.arange(len(key), dtype=U64)
    w = size - GRAM + 1
    n = len(key) - w + 1
    value = np.append(value, np.full(-len(value) % w, ~U64(0), U64)).reshape(-1, w)
    ahead = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(ahead, np.minimum.accumulate(value, axis=1).ravel()[w - 1 : w - 1 + n])
    inside = np.ones(n, bool)  # strings that end in their text
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        inside[max(a, b - size + 1) : b] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    at = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    at, first, last = at[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    text = np.searchsorted(off, first, "right") - 1
    return text, key[at].view(np.int64), _alike(data, at, first, last, size), *((x - off[text]).astype(np.int32) for x in (at, first, last))


def _alike(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """A hash of all bytes of each anchor's strings and of where they stand about it."""
    return mix(Hashes(data, 0x3C6EF372FE94F82B).of(first, last - first + size) ^ mix(((at - first) * 4096 + last - first).astype(U64))).view(np.int64)


def text_anchors(data: np.ndarray, size: int, piece: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of a text of any length, read in pieces of ``piece`` strings; an anchor over borders is one."""
    found = []
    for start in range(0, len(data) - size + 1, piece):
        key, sig, *places = anchors(data[start : start + piece + size - 1], size)
        found.append((key, sig, *(p + np.int32(start) for p in places)))
    key, sig, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    ends = np.append(starts[1:], len(at)) - 1
    last = last[ends]
    sig = sig[starts]
    for i in np.flatnonzero(ends > starts):
        a, b = int(first[starts[i]]), int(last[i])
        sig[i] = _alike(data[a : b + size], at[starts[i : i + 1]].astype(np.int64) - a, np.array([0]), np.array([b - a]), size)[0]
    return key[starts], sig, at[starts], first[starts], last


def word_bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes of hash for each word of a run of documents, end to end, and the offsets of each document's: as many words
    repeat in texts as eight times as many bytes of these."""
    parts, at = [], np.zeros(len(off), np.int64)
    for i, j in common.chunks(off):
        starts, ends = word_places(data[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append(common.run_hashes(data[off[i] : off[j]], starts, ends))
        at[i + 1 : j + 1] = at[i] + np.searchsorted(starts, off[i + 1 : j + 1] - off[i])
    return np.concatenate([np.zeros(0, U64), *parts]).view(np.uint8), at * 8


def word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return common.runs(common._WORD[data], off)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that work arrays stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _read(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are compared, and their offsets."""
    data, off = common.utf8(column)
    return word_bytes(data, off) if words else (data, off)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of the sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lens(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ANCHOR rows by gram, kind and place, each place once; the number of each one's kind; and where kinds start. Places whose kind
    has several are ALIKE."""
    rows = rows[np.lexsort((rows["o"], rows["t2"], rows["t1"], rows["sig"], rows["key"]))]
    at = _starts(*(rows[c] for c in ("key", "t1", "t2", "o")))
    known = np.maximum.reduceat(rows["known"], at)
    rows = rows[at]
    kinds = _starts(rows["key"], rows["sig"])
    lens = _lens(kinds, len(rows))
    alike = (lens > 1) | (np.maximum.reduceat(known, kinds) & ALIKE > 0)
    number = np.repeat(np.arange(len(kinds)), lens)
    rows["known"] = np.where(alike, ALIKE, 0)[number]
    return rows, number, kinds


def _packed(rows: np.ndarray, words: bool, bits: int, often: int) -> pa.RecordBatch:
    """ANCHOR rows of a task packed by bucket: ranges of gram hashes for those that others decide on, as many again for those that
    are settled, and the same for words."""
    rows, _, kinds = _places(rows)
    first = np.zeros(len(rows), bool)
    first[kinds] = True
    keys = rows["key"][kinds]
    starts = _starts(keys)
    turn = np.arange(len(kinds)) - np.repeat(starts, _lens(starts, len(kinds)))
    rows["known"][kinds[turn >= often]] |= MEETS
    settled = ~first
    settled[kinds[turn >= often]] = True
    bucket = (mix(rows["key"].astype(U64)) >> U64(64 - bits)).astype(np.int64)  # mixed again: the least of many hashes is small
    spread = (mix(rows["t1"] ^ mix(rows["o"].astype(U64))) >> U64(64 - bits)).astype(np.int64)
    bucket = np.where(settled, spread + (1 << bits), bucket) + (int(words) << (bits + 1))
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = _starts(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())], names=["bucket", "packed"])


def _anchored(batches: Iterator[pa.RecordBatch], sizes: list[int], piece: int, bits: int, often: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(text, tid) -> ``_packed`` anchors of strings of bytes and, with a second size, of words; copies that a task has met lately are
    not repeated."""
    seen: set[bytes] = set()
    held: list[list[np.ndarray]] = [[] for _ in sizes]
    for batch in _sliced(batches):
        tids = batch.column(1).to_pylist()
        fresh = []
        for i, tid in enumerate(tids):
            if tid not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(tid)
                fresh.append(i)
        if not fresh:
            continue
        batch = batch.take(pa.array(fresh))
        ids = np.frombuffer(b"".join(tids[i] for i in fresh), "<u8").reshape(-1, 2)
        for words, size in enumerate(sizes):
            data, off = _read(batch.column(0), bool(words))
            for i, j in common.chunks(off, min(RUN, piece)):
                if off[j] - off[i] < size:
                    continue
                if j - i == 1:
                    columns = (0, *text_anchors(data[off[i] : off[j]], size, piece))
                else:
                    columns = run_anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                rows = np.zeros(len(columns[1]), ANCHOR)
                for name, values in zip(("key", "sig", "o", "lo", "hi"), columns[1:], strict=True):
                    rows[name] = values
                rows["t1"], rows["t2"] = ids[i + columns[0]].T
                held[words].append(rows)
            if sum(map(len, held[words])) > most:
                yield _packed(np.concatenate(held[words]), bool(words), bits, often)
                held[words] = []
    for words, rows in enumerate(held):
        if sum(map(len, rows)):
            yield _packed(np.concatenate(rows), bool(words), bits, often)


def _kept(t: pa.Table, bits: int) -> pa.Table:
    """KEPT: the places of a bucket whose gram has others."""
    bucket = t["bucket"][0].as_py()
    rows = np.frombuffer(b"".join(t["packed"].to_pylist()), ANCHOR)
    if bucket >> bits & 1:
        kinds, alike, meets = np.full(len(rows), -1, np.int32), rows["known"] & ALIKE > 0, rows["known"] & MEETS > 0
    else:
        rows, number, first = _places(rows)
        starts = _starts(rows["key"][first])
        kinds = np.repeat(_lens(starts, len(first)), _lens(starts, len(first))).astype(np.int32)[number]
        alike, meets = rows["known"] > 0, np.zeros(len(rows), bool)
        meets[first] = kinds[first] > 1
        keep = alike | meets
        rows, kinds, alike, meets = rows[keep], kinds[keep], alike[keep], meets[keep]
    tids = pa.array([x.tobytes() for x in np.stack([rows["t1"], rows["t2"]], 1)], pa.binary())
    columns = [pa.array(np.full(len(rows), bool(bucket >> bits + 1))), pa.array(rows["key"]), tids, *(pa.array(rows[c]) for c in ("o", "lo", "hi")), pa.array(kinds), pa.array(alike), pa.array(meets)]
    return pa.table(columns, names=[c.split()[0] for c in KEPT.split(", ")])


class Hashes:
    """Prefix polynomial hashes of one byte array, and common extensions of its suffixes."""

    def __init__(self, data: np.ndarray, base: int):
        base |= 1
        self.data = data
        power = np.full(len(data) + 1, base, U64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(len(data) + 1, pow(base, -1, 1 << 64), U64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.append(U64(0), np.cumsum((data.astype(U64) + U64(1)) * power[:-1], dtype=U64))

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the suffixes at a and b agree, at most ``most`` bytes, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go] + 1) >> 1
            same = self.of(a[go], mid) == self.of(b[go], mid)
            low[go] = np.where(same, mid, low[go])
            high[go] = np.where(same, high[go], mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether suffix a (of na bytes) is before suffix b, whether they are equal, and their common extension."""
        most = np.minimum(na, nb)
        n = self.common(a, b, most)
        end = n == most
        last = len(self.data) - 1
        less = np.where(end, na < nb, self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)])
        return less, end & (na == nb), n


def suffix_sort(h: Hashes, at: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes (at, of n bytes) within each group; ``group`` must be sorted. A bottom-up mergesort of all groups at
    once: each element finds its rank in the run beside its own by binary search."""
    order = np.arange(len(at))
    new = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))[np.cumsum(new) - 1]
    local = order - start
    width = 1
    while width < size.max():
        run = local // width
        beside = run ^ 1
        low = np.minimum(beside * width, size)
        high = np.minimum(low + width, size)
        base = low.copy()
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go]) >> 1
            x, y = order[go], order[start[go] + mid]
            less, equal, _ = h.before(at[y], at[x], n[y], n[x])
            past = less | (equal & (beside[go] < run[go]))
            low[go] = np.where(past, mid + 1, low[go])
            high[go] = np.where(past, high[go], mid)
        to = start + np.minimum(run, beside) * width + (local - run * width) + (low - base)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    return order


class Collision(Exception):
    pass


def _neighbours(h: Hashes, order: np.ndarray, at: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common extensions of each suffix in order with the next of its group, -1 at the end of one; checked by their bytes."""
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    a, b = a[same], b[same]
    most = np.minimum(n[a], n[b])
    ext = h.common(at[a], at[b], most)
    for s in range(0, len(a), 1 << 14):
        x, y, e = at[a[s : s + (1 << 14)]], at[b[s : s + (1 << 14)]], ext[s : s + (1 << 14)]
        base = np.cumsum(e) - e
        step = np.arange(e.sum()) - np.repeat(base, e)
        if not np.array_equal(h.data[np.repeat(x, e) + step], h.data[np.repeat(y, e) + step]):
            raise Collision
    inner = np.flatnonzero(ext < most)
    if (h.data[at[a[inner]] + ext[inner]] >= h.data[at[b[inner]] + ext[inner]]).any() or (n[a] > n[b])[ext == most].any():
        raise Collision
    out = np.full(len(order), -1)
    out[np.flatnonzero(same)] = ext
    return out


def repeats(group: np.ndarray, contexts: list[bytes], o: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, and first and last start, of repeated strings among those from lo to hi of each member; group is sorted.

    A member's context is the bytes from lo to hi + size, its gram stands at o.
    """
    rng = np.random.default_rng(0)
    while True:
        try:
            return _repeats(group, contexts, o, lo, hi, size, int(rng.integers(1 << 62)))
        except Collision:
            continue


def _repeats(group, contexts, o, lo, hi, size, base):
    lens = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.cumsum(lens) - lens + (o - lo)
    right, left = Hashes(data, base), Hashes(data[::-1].copy(), base)
    nr, nl = (hi + size - o).astype(np.int64), (o - lo).astype(np.int64)
    nr = np.minimum(nr, size)
    order = suffix_sort(right, at, nr, group)
    depth = _neighbours(right, order, at, nr, group)
    back = len(data) - at
    lefts = suffix_sort(left, back, nl, group)
    _neighbours(left, lefts, back, nl, group)
    rank = np.empty(len(at), np.int64)
    rank[lefts] = np.arange(len(at))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    node, member, ext = group[order], order, depth  # ext: with the next member of the node
    names = len(at) + 1
    _, node = np.unique(node, return_inverse=True)
    while len(member):
        new = np.append(True, node[1:] != node[:-1])
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        size_of = np.diff(np.append(starts, len(node)))
        last = np.append(starts[1:], len(node)) - 1
        ext = ext.copy()
        ext[last] = 1 << 40
        common_right = np.minimum.reduceat(ext, starts)
        many = size_of > 1
        by_left = np.lexsort((rank[member], number))
        m = member[by_left]
        same = number[by_left][1:] == number[by_left][:-1]
        best = np.full(len(m), -1)
        if same.any():
            a, b = m[:-1][same], m[1:][same]
            e = left.common(back[a], back[b], np.minimum(nl[a], nl[b]))
            spots = np.flatnonzero(same)
            np.maximum.at(best, spots, e)
            np.maximum.at(best, spots + 1, e)
        d = common_right[number[by_left]]
        first, final = np.maximum(lo[m], o[m] - best), np.minimum(hi[m], o[m] + d - size)
        hit = (best >= 0) & many[number[by_left]] & (first <= final)
        found.append((m[hit], first[hit], final[hit]))
        split = np.append(False, (ext[:-1] == common_right[number[:-1]]) & ~new[1:]) | new
        stay = many[number] & (common_right[number] < size)
        names = np.cumsum(split)
        counts = np.bincount(names)
        stay &= counts[names] > 1
        node, member, ext = names[stay], member[stay], ext[stay]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _grouped(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A group's rows, each place once, by key; and the keys."""
    key, o = t["key"].to_numpy(), t["o"].to_numpy()
    tid = np.array(t["tid"].to_pylist(), "S16")
    order = np.lexsort((o, tid, key))
    key, o, tid = key[order], o[order], tid[order]
    new = np.append(True, (key[1:] != key[:-1]) | (o[1:] != o[:-1]) | (tid[1:] != tid[:-1]))
    return t.take(pa.array(order[new])), key[new]


def _repeated(t: pa.Table, sizes: list[int]) -> pa.Table:
    words = t["words"][0].as_py()
    t, key = _grouped(t)
    o, lo, hi = (t[c].to_numpy().astype(np.int64) for c in ("o", "lo", "hi"))
    member, first, last = repeats(key, t["context"].to_pylist(), o, lo, hi, sizes[words])
    return pa.table({"words": pa.array(np.full(len(member), words)), "tid": t["tid"].take(pa.array(member)), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})


def _strings(t: pa.Table, sizes: list[int], bits: int) -> pa.Table:
    """Of a group that shares its gram with others: each of its strings once, by two hashes, packed by bucket."""
    words = t["words"][0].as_py()
    size = sizes[words]
    t, _ = _grouped(t)
    lo = t["lo"].to_numpy().astype(np.int64)
    tids = np.array([np.void(x) for x in t["tid"].to_pylist()])
    parts = []
    for i, c in enumerate(t["context"].to_pylist()):
        data, p = np.frombuffer(c, np.uint8), np.arange(len(c) - size + 1)
        one = np.empty(len(p), WINDOW)
        one["a"], one["b"] = (mix(Hashes(data, base).of(p, np.full(len(p), size))) for base in (0x51ED270B5, 0x2545F4914F6CDD1D))
        one["tid"], one["p"] = tids[i], p + lo[i]
        parts.append(one)
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    rows = rows[np.append(True, (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]))]
    bucket = (rows["a"] >> U64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return pa.table({"words": pa.array(np.full(len(starts), words)), "bucket": pa.array(bucket[starts]), "packed": pa.array([x.tobytes() for x in np.split(rows, starts[1:])], pa.binary())})


def _across(t: pa.Table) -> pa.Table:
    rows = np.frombuffer(b"".join(t["packed"].to_pylist()), WINDOW)
    order = np.lexsort((rows["b"], rows["a"]))
    rows = rows[order]
    same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
    hit = rows[np.append(same, False) | np.append(False, same)]
    words = pa.array(np.full(len(hit), t["words"][0].as_py()))
    return pa.table({"words": words, "tid": pa.array([bytes(x) for x in hit["tid"]], pa.binary()), "first": pa.array(hit["p"].astype(np.int32)), "last": pa.array(hit["p"].astype(np.int32))})


def _contexts(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(text, tid, anchors) -> one row per anchor with the bytes of its strings."""
    for batch in _sliced(batches):
        read = [_read(batch.column(0), bool(words)) for words in range(len(sizes))]
        tids, lists = batch.column(1), batch.column(2)
        start = np.frombuffer(lists.offsets.cast(pa.int64()).to_numpy()).view(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(start))
        for s in range(0, len(row), 8192):
            part = lists.values.slice(start[0] + s, min(8192, len(row) - s))
            columns = {f.name: part.field(k) for k, f in enumerate(part.type)}
            lo, hi, words = (columns[c].to_numpy(zero_copy_only=False) for c in ("lo", "hi", "words"))
            own = row[s : s + 8192]
            contexts = []
            for r, a, b, w in zip(own.tolist(), lo.tolist(), hi.tolist(), words.astype(int).tolist(), strict=True):
                data, off = read[w]
                contexts.append(data[off[r] + a : off[r] + b + sizes[w]].tobytes())
            yield pa.RecordBatch.from_arrays([columns["words"], columns["grp"], columns["shared"], columns["key"], tids.take(pa.array(own)), columns["o"], columns["lo"], columns["hi"], pa.array(contexts, pa.binary())], names=["words", "grp", "shared", "key", "tid", "o", "lo", "hi", "context"])


def spans(docs: DataFrame, size: int = 400, words: int = 0, block: int = 4096, group: int = 2048, piece: int = PIECE, often: int = 16) -> tuple[Column, DataFrame]:
    """An expression for a text's id, and for the ids that lose bytes: the runs of starts of their repeated strings, of ``size`` bytes and,
    in bytes of ``word_bytes``, of so many words; whether the text has copies, and how many rows have it.

    A text that is marked as whole may have less than ``size`` bytes or less than ``words`` words.
    """
    sizes = [size, 8 * words] if words else [size]
    text = F.coalesce("text", F.lit(""))
    tid = F.unhex(F.md5(text.cast("binary")))
    named = docs.select("doc_id", text.alias("text"), tid.alias("tid"))
    n_bytes = F.octet_length("text")
    copies = common.stored(named.groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max(n_bytes).cast("long").alias("bytes")))
    bits = max(4, ((copies.agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0) >> 22).bit_length())
    found = named.select("text", "tid").mapInArrow(lambda b: _anchored(b, sizes, piece, bits, often), "bucket long, packed binary")
    kept = common.stored(found.groupBy("bucket").applyInArrow(lambda t: _kept(t, bits), KEPT))
    direct = kept.where("alike").select("words", "tid", F.col("lo").alias("first"), F.col("hi").alias("last"))
    meets = kept.where("meets").drop("alike", "meets")
    n = meets.count()
    buckets = max(1, n // group)
    # Only grams that filled their share in a task, or have that many kinds, may have more than a block of places.
    heavy = common.stored(meets.where((F.col("kinds") < 0) | (F.col("kinds") >= min(often, block))).groupBy("words", "key").agg(F.count("*").alias("all"), F.count("*").alias("rows")).where(F.col("all") > block))
    some = bool(heavy.head(1))
    meets = common.named(meets, heavy, ["words", "key"], "rows") if some else meets.withColumn("all", F.lit(1))
    blocks = F.coalesce(F.ceil(F.col("all") / block), F.lit(1))
    dealt = F.when(blocks > 1, F.xxhash64("key", F.pmod(F.xxhash64("tid", "o"), blocks))).otherwise(F.pmod("key", F.lit(buckets)))
    meets = meets.select("words", dealt.alias("grp"), (blocks > 1).alias("shared"), "key", "tid", "o", "lo", "hi")
    per_text = meets.groupBy("tid").agg(F.collect_set(F.struct(*meets.columns)).alias("anchors"))
    # one row stands for a text; its id leads to the text, so that copies' texts are not gathered
    chosen = per_text.join(copies.select("tid", "doc_id"), "tid")
    chosen = chosen.withColumnsRenamed({"doc_id": "rep", "tid": "of"})
    texts = named.join(chosen.hint("merge"), (named["tid"] == chosen["of"]) & named["doc_id"].eqNullSafe(chosen["rep"])).select("text", "tid", "anchors")
    made = texts.mapInArrow(lambda b: _contexts(b, sizes), "words boolean, grp long, shared boolean, key long, tid binary, o int, lo int, hi int, context binary")
    shape = "words boolean, tid binary, first int, last int"
    hits = made.groupBy("words", "grp").applyInArrow(lambda t: _repeated(t, sizes), shape).union(direct)
    if some:
        wide = max(4, (n // 1000).bit_length())
        over = made.where("shared").groupBy("words", "grp").applyInArrow(lambda t: _strings(t, sizes, wide), "words boolean, bucket long, packed binary")
        hits = hits.union(over.groupBy("words", "bucket").applyInArrow(_across, shape))
    run = F.struct("first", "last")
    runs = hits.groupBy("tid").agg(F.collect_set(F.when(~F.col("words"), run)).alias("runs"), F.collect_set(F.when(F.col("words"), run)).alias("word_runs"))
    whole = copies.where((F.col("n") > 1) & (F.col("bytes") >= min(size, 2 * words - 1 if words else size))).select("tid", F.lit(True).alias("whole"), F.col("n").alias("rows"))
    lost = runs.join(whole, "tid", "full").select("tid", "runs", "word_runs", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("rows", F.lit(1)).alias("rows"))
    lost = common.stored(lost)
    for done in (copies, kept, heavy):
        common.release(done)
    return tid, lost


def removed(length: int, runs: np.ndarray, size: int) -> np.ndarray:
    """Disjoint byte ranges that strings starting in the runs cover."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 1] + size)
    new = np.append(True, runs[1:, 0] > end[:-1])
    starts = np.flatnonzero(new)
    return np.stack([runs[starts, 0], end[np.append(starts[1:], len(runs)) - 1]], 1)


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Disjoint byte ranges of the same bytes."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    starts = np.flatnonzero(np.append(True, ranges[1:, 0] > end[:-1]))
    return np.stack([ranges[starts, 0], end[np.append(starts[1:], len(ranges)) - 1]], 1)


def _word_ranges(text: np.ndarray, runs: np.ndarray, whole: bool, words: int) -> np.ndarray:
    """Byte ranges of the repeated strings of ``words`` words; runs are in bytes of ``word_bytes``."""
    starts, ends = word_places(text, np.array([0, len(text)]))
    if whole and len(starts) >= words:
        return np.array([[0, len(text)]])
    first, last = (runs[:, 0] + 7) // 8, runs[:, 1] // 8
    first, last = first[first <= last], last[first <= last]
    return np.stack([starts[first], ends[last + words - 1]], 1)


def _cut(batches: Iterator[pa.RecordBatch], at: int, size: int, words: int = 0):
    """For each row of batches that end in (runs, word_runs, whole): the batch, and each text's bytes, the ranges removed by bytes,
    and all removed ranges."""
    for batch in batches:
        data, off = common.utf8(batch.column(at))
        whole = batch.column(batch.num_columns - 1).to_pylist()
        marks = [batch.column(batch.num_columns - 3 + by_word) for by_word in range(2 if words else 1)]
        out = []
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]]
            ranges = by_bytes = np.zeros((0, 2), np.int64)
            for by_word, runs in enumerate(marks):
                own = np.zeros((0, 2), np.int64)
                if runs[i].is_valid:
                    v = runs[i].values
                    own = np.stack([v.field(0).to_numpy(), v.field(1).to_numpy()], 1).astype(np.int64)
                if by_word:
                    own = _word_ranges(text, own, whole[i], words) if len(own) or whole[i] else own
                elif whole[i] and len(text) >= size:
                    own = np.array([[0, len(text)]])
                elif len(own):
                    own = removed(len(text), own, size)
                ranges = _joined(np.concatenate([ranges, own])) if by_word and len(own) else ranges if by_word else own
                by_bytes = by_bytes if by_word else own
            out.append((text, by_bytes, ranges))
        yield batch, out


def kept_bytes(text: np.ndarray, ranges: np.ndarray) -> bytes:
    if not len(ranges):
        return text.tobytes()
    keep = np.ones(len(text), bool)
    for a, b in ranges:
        keep[a:b] = False
    return text[keep].tobytes()


def _digests(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch, texts in _cut(batches, 1, size, words):
        n, gone, count, sha = [], [], [], []
        for text, ranges, _ in texts:
            n.append(len(text))
            gone.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
            count.append(len(ranges))
            sha.append(hashlib.sha256(kept_bytes(text, ranges)).hexdigest())
        rest = pa.array([kept_bytes(t, r).decode("utf-8", "ignore") for t, _, r in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sha, pa.string()), rest], names=names)


def _marked(docs: DataFrame, size: int, words: int = 0, **bounds) -> DataFrame:
    """docs with three more columns at the end: the repeated runs by bytes and by words, and whether all of the text goes."""
    names = docs.columns
    tid, lost = spans(docs, size, words, **bounds)
    t = "tid_" + hashlib.md5("".join(names).encode()).hexdigest()  # a name that docs doesn't have
    lost = lost.withColumnsRenamed({"tid": t, "runs": f"runs_{t}", "word_runs": f"words_{t}", "whole": f"whole_{t}", "rows": f"rows_{t}"})
    joined = common.named(docs.select(*(docs[c] for c in names), tid.alias(t)), lost, t, f"rows_{t}", merge=True)
    return joined.select(*names, f"runs_{t}", f"words_{t}", F.coalesce(f"whole_{t}", F.lit(False)).alias(f"whole_{t}"))


def digests(docs: DataFrame, size: int = 400, words: int = 51, **bounds) -> DataFrame:
    """SCHEMA for every row: what is removed by bytes and a digest of what stays; the last column is the text without repeated strings
    of ``size`` bytes and, unless ``words`` is 0, without repeated passages of so many words (see ``cleaned``)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return _marked(docs, size, words, **bounds).mapInArrow(lambda b: _digests(b, size, words), SCHEMA)


def cleaned(docs: DataFrame, size: int = 400, words: int = 0, **bounds) -> DataFrame:
    """docs with the repeated bytes taken out of each text; what is left of a cut character goes too.

    With ``words``, strings of so many words that also start elsewhere go as well, however few bytes they have; what stands
    between words makes no difference to these.
    """
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch, texts in _cut(batches, at, size, words):
            kept = [kept_bytes(t, r).decode("utf-8", "ignore") if len(r) else None for t, _, r in texts]
            old = batch.column(at).to_pylist()
            text = pa.array([a if b is None else b for a, b in zip(old, kept, strict=True)], pa.string())
            columns = list(batch.columns[:-3])
            columns[at] = text
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _marked(docs, size, words, **bounds).mapInArrow(run, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))

"""All links between documents whose sets of word n-grams are similar, as connected components.

1. Equal sets are one set from the first step on, by a 64-bit signature; the shingles themselves are 64-bit hashes. A second
   64-bit signature shows where different sets share the first; these few get another.
2. Sets meet in size bands. In a band of largest size u two similar sets differ in at most ``d`` shingles, so of
   ``d + 1 + e`` parts of the hash range at least ``e + 1`` hold the same shingles in both. Each set files the signature of
   each non-empty part, in its own band and, if it can be similar to larger sets, in the next; the pairs that share one
   include all links. A set with more than ``e`` empty parts files under the next hash function too, until one leaves
   fewer, so no pair depends on empty parts. Common shingles gather nobody: a key is a whole part of a set. Keys travel packed in
   binary rows; sets that meet under several keys meet once.
3. Each set has a bitmap of hashed shingles. Where sets meet, bit counts bound a pair's overlap from above; the pairs
   that may reach the threshold connect sets to clusters, and only sets in clusters are loaded. Large meetings are dealt over
   blocks, which meet a pivot block first and each other only where that leaves several components.
4. A cluster's sets are split into tiles of bounded size within size bands. In a tile the pairs that the bitmaps allow
   are intersected as sorted arrays. Pairs already connected are skipped. Clusters of several tiles are first tied
   together by a pivot tile for each band; only those that stay in pieces meet tile by tile, as larger bitmaps first, and
   their sets are loaded only where these allow a pair of different pieces.

Defined cases: null text, empty text and text without words have an empty set and stand alone; fewer words than the
n-gram are one shingle; repeated rows are linked as equal sets; a null doc_id is kept, links like any other, and never names a
component unless it is all there is; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.llm import common
from prosegrain.llm.common import U64, mix

RATIO = 1.6


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band its largest size, its number of parts (0 if only equal sets can be similar) and the empty parts it allows."""
    tops, parts, spare = [1], [0], [0]
    while tops[-1] < most:
        last = tops[-1]
        top = max(last + 1, int(last * RATIO))
        differ = (den - num) * 2 * top // (den + num)
        least = max(1, num * (last + 1) // den)
        e = 0
        if differ:
            while True:  # so many that most sets of the band leave no more parts empty
                k = differ + 1 + e
                empty = k * math.exp(-least / k)
                need = 0 if empty <= 0.5 else math.ceil(empty + math.sqrt(empty) * (1 if empty > 4 else 0.3))
                if need <= e:
                    break
                e = need
                if differ + 1 + e >= least:  # small sets: few parts, of which none may be empty
                    e = 0
                    break
        tops.append(top)
        parts.append(differ + 1 + e if differ else 0)
        spare.append(e)
    return np.array(tops), np.array(parts), np.array(spare)


def sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each document, end to end, and their offsets."""
    h, doc = common.shingles(*common.words(data, off), words)
    by = np.argsort(doc, kind="stable")
    h, doc = h[by], doc[by]
    at = np.searchsorted(doc, np.arange(len(off)))
    for i in np.flatnonzero(np.diff(at) > 1):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(off)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of each document's values, modulo 2**64."""
    total = np.append(U64(0), np.cumsum(values, dtype=U64))
    return total[at[1:]] - total[at[:-1]]


def checks(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second signature of each set, independent of the first."""
    return mix(_sums(mix(h * U64(0xD6E8FEB86659FD93) ^ U64(0x27D4EB2F165667C5)), at) ^ np.diff(at).astype(U64)).view(np.int64)


def signatures(h: np.ndarray, at: np.ndarray, shared: frozenset[int] = frozenset()) -> np.ndarray:
    """A 64-bit signature of each set; sets whose signature is one of ``shared`` have one by ``checks`` instead."""
    s = mix(_sums(mix(h ^ U64(0x5BD1E995)), at) + np.diff(at).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
    if shared:
        again = np.isin(s, np.fromiter(shared, np.int64))
        s[again] = mix(checks(h, at)[again].view(U64)).view(np.int64)
    return s


def part_keys(h: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty parts of each set in each band it files in, and the index of the set."""
    tops, parts, spare = bands(num, den)
    n = np.diff(at)
    keys, owners = [], []

    def file(band: np.ndarray, who: np.ndarray, values: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
        """Files sets ``who``; returns which of them have too many empty parts."""
        k = parts[band]
        lens = np.diff(bounds)
        row = np.repeat(np.arange(len(who)), lens)
        part = ((values >> U64(32)) * np.repeat(k.astype(U64), lens)) >> U64(32)
        first = np.ones(len(values), bool)
        first[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(first)
        if len(starts):
            body = np.add.reduceat(mix(values + U64(turn)), starts)
            place = mix(part[starts] + (band[row[starts]].astype(U64) << U64(40)) + U64(turn << 32))
            keys.append(mix(body ^ place))
            owners.append(who[row[starts]])
        return np.bincount(row[starts], minlength=len(who)) < k - spare[band]

    own = np.searchsorted(tops, n)
    for band, among in ((own, n > 0), (own + 1, (n > 0) & (n * den >= num * (tops[own] + 1)))):
        who = np.flatnonzero(among & (parts[np.minimum(band, len(parts) - 1)] > 0))
        if not len(who):
            continue
        lens = n[who]
        bounds = np.append(0, np.cumsum(lens))
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lens) + np.repeat(at[who], lens)
        short = file(band[who], who, h[place], bounds, 0)
        for i in who[short]:
            turn = 1
            while True:
                again = np.sort(mix(h[at[i] : at[i + 1]] ^ mix(np.array([turn], U64))))
                if not file(band[i : i + 1], np.array([i]), again, np.array([0, len(again)]), turn)[0]:
                    break
                turn += 1
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _described(batches: Iterator[pa.RecordBatch], words: int, shared: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = common.utf8(batch.column(2))
        n, s, c = (np.zeros(len(off) - 1, np.int64) for _ in range(3))
        maps = []
        for i, j in common.chunks(off):
            h, at = sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
            n[i:j], s[i:j], c[i:j] = np.diff(at), signatures(h, at, shared), checks(h, at)
            maps.extend(bitmap(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
        columns = [batch.column(0), batch.column(1), *map(pa.array, (n, s, c)), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "n", "s", "c", "bits"])


def bitmap(h: np.ndarray, sharper: int = 0) -> bytes:
    """A set's hashed bitmap: the least power of two of bits that is no smaller than the set, doubled ``sharper`` times, between 64 and 65,536."""
    bits = 1 << min(16, max(6, (len(h) - 1).bit_length() + sharper))
    flags = np.zeros(bits, bool)
    flags[(h >> U64(24)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def bitmaps(blobs: list[bytes]) -> np.ndarray:
    """Bitmaps of different lengths as rows of one length, the shortest: longer ones are folded."""
    least = min(map(len, blobs))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, U64).reshape(-1, least // 8), axis=0) for b in blobs])


def may_overlap(maps: np.ndarray, n: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Most shingles that set i can share with sets js: each bit that only one of them has is a shingle that only it has."""
    only_i = np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64)
    only_j = np.bitwise_count(maps[js] & ~maps[i]).sum(1, dtype=np.int64)
    return np.minimum(n[i] - only_i, n[js] - only_j)


def _filed(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, bits: int, shared: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Signatures and keys by bucket, the first ``bits`` bits of the key; the next 32 travel. Sets that meet by chance are told apart later."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[int] = set()  # sets that this task has filed lately: copies need not be filed again

    def flush():
        keys, s = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(keys)
        keys, s = keys[order], s[order]
        bucket = (keys >> U64(64 - bits)).astype(np.int64)
        keys = ((keys << U64(bits)) >> U64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else []
        blobs = [b.tobytes() + a.tobytes() for a, b in zip(np.split(keys, starts[1:]), np.split(s, starts[1:]), strict=True)] if len(keys) else []
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts] if len(keys) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    for batch in batches:
        data, off = common.utf8(batch.column(0))
        for i, j in common.chunks(off):
            h, at = sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
            s = signatures(h, at, shared)
            if len(seen) > 100_000:
                seen.clear()
            fresh = np.zeros(len(s), bool)
            for k, x in enumerate(s.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[k] = True
            keys, owner = part_keys(h, at, num, den)
            mine = fresh[owner]
            held.append((keys[mine], s[owner[mine]]))
            if sum(len(a) for a, _ in held) > 1 << 19:
                yield flush()
    if held:
        yield flush()


def _met(t: pa.Table) -> pa.Table:
    """(meeting, s) of the sets of a bucket that share a key with others; the same sets under several keys are one meeting."""
    blobs = [(x, len(x) // 12) for x in t["packed"].to_pylist()]
    s, keys = (np.concatenate([np.frombuffer(x, kind, n, at * n) for x, n in blobs]) for kind, at in ((np.int64, 0), (np.uint32, 8)))
    order = np.lexsort((s, keys))
    keys, s = keys[order], s[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (s[1:] != s[:-1]))
    keys, s = keys[once], s[once]
    new = np.append(True, keys[1:] != keys[:-1])
    starts, number = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(starts, len(s)))
    name = mix(np.add.reduceat(mix(s.view(U64)), starts) + size.astype(U64)).view(np.int64)
    rows = np.stack([name[number], s], 1)[size[number] > 1]
    rows = np.unique(rows, axis=0) if len(rows) else rows
    return pa.table({"meeting": pa.array(rows[:, 0], pa.int64()), "s": pa.array(rows[:, 1], pa.int64())})


class Groups:
    """Groups of the rows of a block; ``of`` has the group of each. Of two that meet the smaller is relabelled."""

    def __init__(self, of: np.ndarray):
        _, self.of = np.unique(of, return_inverse=True)
        self.rows = {int(g): x.tolist() for g, x in enumerate(np.split(np.argsort(self.of, kind="stable"), np.cumsum(np.bincount(self.of))[:-1]))}

    def join(self, i: int, j: int) -> bool:
        """Joins the groups of rows i and j; whether they were two."""
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return False
        if len(self.rows[a]) < len(self.rows[b]):
            a, b = b, a
        self.of[self.rows[b]] = a
        self.rows[a] += self.rows.pop(b)
        return True


def _may_link(t: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs (u, v) of each meeting that the bitmaps allow, as few as connect what they connect; sets of one root, where there is
    that column, are connected already."""
    meeting, s, n = (t[c].to_numpy() for c in ("meeting", "s", "n"))
    root = t["root"].to_numpy() if "root" in t.column_names else s
    blobs = t["bits"].to_pylist()
    order = np.lexsort((n, meeting))
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(meeting[order])) + 1):
        groups = Groups(root[rows])
        if len(groups.rows) == 1:
            continue
        maps, size, group = bitmaps([blobs[r] for r in rows]), n[rows], groups.of
        ends = np.searchsorted(size, size * den // num, "right")
        for i in range(len(rows) - 1):
            js = np.arange(i + 1, ends[i])
            js = js[group[js] != group[i]]
            if len(js):
                js = js[may_overlap(maps, size, i, js) * (den + num) >= num * (size[i] + size[js])]
                out.extend((s[rows[i]], s[rows[j]]) for j in js if groups.join(i, j))
                if len(groups.rows) == 1:
                    break
    return pa.table({"u": pa.array([int(a) for a, _ in out], pa.int64()), "v": pa.array([int(b) for _, b in out], pa.int64())})


def link(s: np.ndarray, members: list[np.ndarray], group: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different groups until the groups they join are connected."""
    order = np.argsort([len(x) for x in members], kind="stable")
    members, s, groups = [members[i] for i in order], s[order], Groups(group[order])
    group = groups.of
    n = np.array([len(x) for x in members])
    maps = bitmaps([bitmap(x) for x in members])
    ends = np.searchsorted(n, n * den // num, "right")
    out = []
    for i in range(len(n)):
        js = np.arange(i + 1, ends[i])
        js = js[group[js] != group[i]]
        if not len(js):
            continue
        most = may_overlap(maps, n, i, js)
        js = js[most * (den + num) >= num * (n[i] + n[js])]
        if not len(js):
            continue
        values = np.concatenate([members[j] for j in js])
        spot = np.minimum(np.searchsorted(members[i], values), n[i] - 1)
        both = np.add.reduceat((members[i][spot] == values).astype(np.int64), np.cumsum(n[js]) - n[js])
        for j in js[both * (den + num) >= num * (n[i] + n[js])]:
            out.append((int(s[i]), int(s[j])))
            groups.join(i, j)
    return out


def _linked(t: pa.Table, num: int, den: int) -> pa.Table:
    _, group = np.unique(t["root"].to_numpy(), return_inverse=True)
    pairs = link(t["s"].to_numpy(), [np.frombuffer(x, U64) for x in t["shingles"].to_pylist()], group, num, den) if len(t) > 1 else []
    return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})


def _loaded(batches: Iterator[pa.RecordBatch], words: int, shared: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """doc text, s, ... -> the same with the shingles in place of the text, for rows whose text has that signature."""
    for batch in batches:
        data, off = common.utf8(batch.column(0))
        want, keep, blobs = batch.column(1).to_numpy(), [], []
        for i, j in common.chunks(off):
            h, at = sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
            for k in np.flatnonzero(signatures(h, at, shared) == want[i:j]):
                keep.append(i + k)
                blobs.append(h[at[k] : at[k + 1]].tobytes())
        rest = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *rest.columns[1:]], names=["shingles", *batch.schema.names[1:]])


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingles, ... -> n and a bitmap of four times the usual size in place of the shingles."""
    for batch in batches:
        sets = [np.frombuffer(x, U64) for x in batch.column(0).to_pylist()]
        columns = [pa.array(list(map(len, sets)), pa.int64()), pa.array([bitmap(x, 2) for x in sets], pa.binary()), *batch.columns[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=["n", "bits", *batch.schema.names[1:]])


def _near(t: pa.Table, num: int, den: int) -> pa.Table:
    """The sets of a tile that the bitmaps allow to be similar to one of another root there."""
    order = np.argsort(t["n"].to_numpy(), kind="stable")
    n, (_, root) = t["n"].to_numpy()[order], np.unique(t["root"].to_numpy()[order], return_inverse=True)
    near = np.zeros(len(n), bool)
    if len(np.unique(root)) > 1:
        blobs = t["bits"].to_pylist()
        maps, ends = bitmaps([blobs[i] for i in order]), np.searchsorted(n, n * den // num, "right")
        for i in range(len(n) - 1):
            js = np.arange(i + 1, ends[i])
            js = js[root[js] != root[i]]
            js = js[may_overlap(maps, n, i, js) * (den + num) >= num * (n[i] + n[js])]
            near[js] = True
            near[i] |= len(js) > 0
    return t.select(["cluster", "tile", "s"]).take(pa.array(order[near]))


def _tiled(members: DataFrame, num: int, den: int) -> DataFrame:
    return members.groupBy("cluster", "tile").applyInArrow(lambda t: _linked(t, num, den), "u long, v long")


def _name(*x) -> Column:
    return F.concat_ws(":", *x)


def _pivots() -> Column:
    """Tiles in which a row meets the pivot tile, that of salt 0, of its band and of the next one."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.col("tiles") - 1, F.lit(0))), lambda i: _name("band", i))
    return F.when(F.col("salt") == 0, F.concat(every, F.array(_name(F.col("band") - 1, F.lit(0))))).otherwise(F.array(_name("band", "salt")))


def _paired(rows: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Each row in all pairs of tiles of its band and of the bands beside it; ``tiles`` has (key, band, tiles)."""
    up = tiles.select(key, (F.col("band") - 1).alias("band"), F.col("tiles").alias("up"))
    down = tiles.select(key, (F.col("band") + 1).alias("band"), F.col("tiles").alias("down"))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    pairs = F.concat(
        F.transform(upto("tiles"), lambda i: _name("band", F.least(i, F.col("salt")), "band", F.greatest(i, F.col("salt")))),
        F.transform(upto("up"), lambda i: _name("band", "salt", F.col("band") + 1, i)),
        F.transform(upto("down"), lambda i: _name(F.col("band") - 1, i, "band", "salt")),
    )
    return rows.join(up, [key, "band"], "left").join(down, [key, "band"], "left").withColumn("tile", F.explode(pairs))


def blocks(met: DataFrame, reps: DataFrame, large: DataFrame, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the large meetings by size band and salt, about ``block`` in each, and the number of salts of each band."""
    rows = met.join(large.select("meeting"), "meeting").join(reps.select("s", "n", "bits"), "s")
    rows = common.stored(rows.withColumn("band", F.floor(F.log("n") / _step(num, den))))
    tiles = common.stored(rows.groupBy("meeting", "band").agg(F.ceil(F.count("*") / block).alias("tiles")))
    return rows.join(tiles, ["meeting", "band"]).withColumn("salt", F.pmod(F.xxhash64("s"), "tiles")), tiles


def _step(num: int, den: int) -> float:
    """Bands of this width in log n: similar sets are in one band or in neighbouring ones."""
    return math.log(den / num) * (1 + 1e-9)


def _candidates(met: DataFrame, reps: DataFrame, num: int, den: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (u, v) of sets that meet and that the bitmaps allow, as many as connect what they connect; and the stored tables they read.

    A meeting of more than ``block`` sets is dealt over blocks: each meets a pivot block first, and only blocks that are not in one
    component then meet in pairs.
    """
    pairs = lambda rows, *by: rows.groupBy(*by).applyInArrow(lambda t: _may_link(t, num, den), "u long, v long")
    groups = max(1, met.count() >> 13)
    large = common.stored(met.groupBy("meeting").count().where(F.col("count") > block))
    some = bool(large.head(1))
    small = met.join(large, "meeting", "left_anti") if some else met
    may = pairs(small.join(reps.select("s", "n", "bits"), "s").withColumn("grp", F.pmod("meeting", F.lit(groups))), "grp")
    if not some:
        return may, [large]
    rows, tiles = blocks(met, reps, large, num, den, block)
    may = common.stored(may.union(pairs(rows.withColumn("tile", F.explode(_pivots())), "meeting", "tile")))
    roots = common.stored(common.components(may))
    rows = rows.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    split = rows.groupBy("meeting").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("meeting")
    split = common.stored(split)
    rest = rows.join(split, "meeting", "left_semi")
    return may.union(pairs(_paired(rest, tiles, "meeting"), "meeting", "tile")), [large, tiles, may, roots, split]


#: Tiles that meet as bitmaps hold the sets of so many tiles that meet as shingles.
WIDER = 8


def _apart(large: DataFrame, tiles: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of clusters that are still in pieces, in the pairs of tiles where they may be similar to a set of another root.

    Tiles meet in pairs as bitmaps, which are much smaller; shingles travel only to where a bitmap allows it.
    """
    wide = lambda t: t.where("tiles > 0").withColumn("tiles", F.ceil(F.col("tiles") / WIDER))
    maps = large.select("shingles", "s", "cluster", "band", "tiles", "root").mapInArrow(_mapped, "n long, bits binary, s long, cluster long, band long, tiles long, root long")
    rows = common.stored(wide(maps).withColumn("salt", F.pmod(F.xxhash64("s"), "tiles")))
    pairs = _paired(rows, wide(tiles), "cluster").select("cluster", "tile", "s", "n", "root", "bits")
    near = common.stored(pairs.groupBy("cluster", "tile").applyInArrow(lambda t: _near(t, num, den), "cluster long, tile string, s long"))
    return near.join(large.select("s", "shingles", "root"), "s")


def _links(docs: DataFrame, reps: DataFrame, words: int, num: int, den: int, capacity: int, block: int, shared: frozenset[int]) -> DataFrame:
    """Verified links (u, v) between signatures that leave no similar pair unconnected."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (size >> 22).bit_length())
    filed = docs.select("text").mapInArrow(lambda b: _filed(b, words, num, den, bits, shared), "bucket long, packed binary")
    met = common.stored(filed.groupBy("bucket").applyInArrow(_met, "meeting long, s long").distinct())
    may, read = _candidates(met, reps, num, den, block)
    clusters = common.stored(common.components(may).withColumnsRenamed({"node": "s", "root": "cluster"}))
    for done in (met, *read):
        common.release(done)
    members = reps.select("s", "row", "n").join(clusters, "s").withColumn("band", F.floor(F.log("n") / _step(num, den)))
    by_band = members.groupBy("cluster", "band").agg(F.sum("n").alias("weight"))
    whole = by_band.groupBy("cluster").agg(F.sum("weight").alias("total"))
    tiles = common.stored(by_band.join(whole, "cluster").select("cluster", "band", F.when(F.col("total") <= capacity, 0).otherwise(F.ceil(F.col("weight") / capacity)).alias("tiles")))
    placed = members.join(tiles, ["cluster", "band"]).withColumn("salt", F.when(F.col("tiles") > 0, F.pmod(F.xxhash64("s"), "tiles")).otherwise(0))
    # one row stands for a set, by its id, which may be null, and its text's digest; rows that are equal in both are one
    wanted = placed.select(F.col("row.doc_id").alias("doc"), F.col("row.tid").alias("tid"), "s", "cluster", "band", "tiles", "salt")
    loaded = docs.join(wanted.hint("merge"), (docs["doc_id"].eqNullSafe(wanted["doc"])) & (docs["tid"] == wanted["tid"])).drop(docs["tid"])
    loaded = loaded.dropDuplicates(["doc", "tid", "s"]).select("text", "s", "cluster", "band", "tiles", "salt")
    loaded = common.stored(loaded.mapInArrow(lambda b: _loaded(b, words, shared), "shingles binary, s long, cluster long, band long, tiles long, salt long"))
    first = loaded.withColumn("root", F.col("s")).withColumn("tile", F.explode(F.when(F.col("tiles") == 0, F.array(F.lit(""))).otherwise(_pivots())))
    links = common.stored(_tiled(first, num, den))
    roots = common.stored(common.components(links))
    large = loaded.where("tiles > 0").join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    split = common.stored(large.groupBy("cluster").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("cluster"))
    read = [clusters, tiles, loaded, roots, split]
    all_links = links
    if split.head(1):
        all_links = common.stored(links.union(_tiled(_apart(large.join(split, "cluster", "left_semi"), tiles, num, den), num, den)))
        read.append(links)
    for done in read:
        common.release(done)
    return all_links


def _sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Each row with its set's size and signature; one row per set; and the signatures that different sets shared."""
    shared: frozenset[int] = frozenset()
    while True:
        each = common.stored(docs.mapInArrow(lambda b, x=shared: _described(b, words, x), "doc_id long, tid binary, n long, s long, c long, bits binary"))
        sums = [F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "tid")).alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("best")]
        sums += [F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("rows"), F.min("c").alias("c"), F.max("c").alias("d")]
        reps = common.stored(each.where("n > 0").groupBy("s").agg(*sums))
        more = [r.s for r in reps.where("c <> d").select("s").collect()]  # about n * n / 2**65 of n sets
        if not more:
            return each, reps, shared
        common.release(each)
        common.release(reps)
        shared |= frozenset(more)


def _resolved(docs: DataFrame, words: int, num: int, den: int, capacity: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``_sets`` of docs, with the root of each set's component."""
    if 10 * num < 7 * den:
        raise ValueError("the similarity must be 0.7 or more")
    text = F.coalesce(docs["text"], F.lit(""))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tid"), text.alias("text"))
    each, reps, shared = _sets(docs, words)
    links = _links(docs, reps, words, num, den, capacity, block, shared)
    roots = common.components(links).withColumnRenamed("node", "s")
    found = common.stored(reps.join(roots, "s", "left").select("s", "n", "rows", "doc_id", "best", F.coalesce("root", "s").alias("root")))
    for done in (reps, links):
        common.release(done)
    return each, found


def similar(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, capacity: int = 1 << 18, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when den * intersection >= num * union of their sets.

    ``capacity`` bounds the shingles in a tile, ``block`` the sets that are compared by bitmaps at once. Below a similarity of 0.7 sets would need more parts than they have shingles.
    """
    each, found = _resolved(docs, words, num, den, capacity, block)
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = common.stored(found.join(least, "root").select("s", "rows", "component_id"))
    full = common.named(each.where("n > 0").select("doc_id", "n", "s"), named, "s", "rows")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(each.where("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, capacity: int = 1 << 18, block: int = 4096) -> DataFrame:
    """docs with one row of each component: that with the smallest id, of equal ids that with the least digest of its text; rows of no id
    come last. Rows equal in id and text are one. Rows without words stay."""
    each, found = _resolved(docs, words, num, den, capacity, block)
    best = found.groupBy("root").agg(F.min("best").alias("one"), F.sum("rows").alias("of"))
    chosen = common.stored(found.join(best.where("of > 1"), "root").select("s", "rows", F.col("one.doc_id").alias("kept_id"), F.col("one.tid").alias("kept_tid")))
    rows = common.named(each.where("n > 0").select("doc_id", "tid", "s"), chosen, "s", "rows", how="inner")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tid") == F.col("kept_tid"))
    marks = common.stored(rows.groupBy("doc_id", "tid").agg(F.max(F.when(stays, F.lit(1)).otherwise(0)).alias("stays"), F.count("*").alias("times")).where("stays = 0 or times > 1"))
    for done in (each, found, chosen):
        common.release(done)
    names = docs.columns
    key, once = (f"_{x}_of_{'_'.join(names)}" for x in ("key", "once"))  # names that docs doesn't have
    tid = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    keyed = docs.select(F.struct(*(docs[c].alias(c) for c in names)).alias(once), F.struct(docs["doc_id"].cast("long").alias("doc_id"), tid.alias("tid")).alias(key))
    marked = marks.select(F.struct("doc_id", "tid").alias(key), "stays")
    plain = keyed.join(marked.hint("merge"), key, "left_anti").select(f"{once}.*")
    if not marks.where("stays = 1").head(1):  # no row is repeated in both
        return plain
    again = keyed.join(marked.where("stays = 1"), key, "left_semi").dropDuplicates([key]).select(f"{once}.*")
    return plain.union(again)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents", "doc_id", "text"), words=4, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""

"""Minwise hashes of character shingles in banded buckets.

A shingle is a few neighbouring characters together with the cell of the text they stand in, counted from its front or
from its back, so that texts in one language, which share most of their shingles somewhere, seldom share one. The least
hash of a text under a random function agrees with that of another text with the probability of their Jaccard
similarity; a band joins several such minima into one key, and texts with one key are candidates.

There are two families of bands: pairs of characters in narrow cells find texts with many scattered changes, triples in
wide cells texts whose parts have moved. Cells are a part of the length, so keys are made per bucket of lengths; a text
of the asking side is looked up in every bucket in which a partner may be. Two bits of every minimum of the first family
make a sketch of the text, which tells, where a key is shared, about how similar two texts are.

Keys are packed into sorted binary columns, one row for a range of keys and some thousand texts, so the shuffle moves
bytes and not rows. A key with a large number of texts leaves its range in slices, which meet in blocks of their own.
The more ranges there are, the more of them the sketch of a text goes to: their number follows from the bytes of a range.
A task takes several ranges, one after the other, where there are many, for what the driver keeps grows with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import even_slots, fewer_tasks
from ..session import cut

#: Characters of a shingle, size of a cell as a part of the length, minima and bands of each view, minima of a band.
FAMILIES = ((2, 0.16, 32, 16, 4), (3, 0.3, 16, 4, 4))
#: A view counts cells from one of these places, from the front or from the back of a text.
OFFSETS = 2
BANDS = 2 * OFFSETS * sum(f[3] for f in FAMILIES)
#: Bits of a minimum in a sketch, 64-bit numbers of each bit, and how many minima agree at least; of a similarity J
#: 0.25 + 0.75 J of them do.
SKETCH_BITS, SKETCH_WORDS = 2, 2 * OFFSETS * FAMILIES[0][2] // 64
AGREE = 58
#: Steps of the largest ratio of two lengths that make a bucket.
STEPS = 4
#: Texts packed together (they are numbered by 22 bits), bits of a key, keys of one range at most.
PACKED, KEY_BITS, RANGE_KEYS = 1 << 15, 48, 1 << 22
#: Bytes of one range at most as they are held for matching, those of a key and of a text in it; bytes that are sent at a time.
RANGE_BYTES, KEY_BYTES, TEXT_BYTES, SENT = 150_000_000, 17, 10 + 8 * SKETCH_BITS * SKETCH_WORDS, 1 << 25
#: Texts of a key from which it is cut into slices, and those of a slice; pairs that are made at a time.
HOT, SLICE, PAIRS = 1 << 14, 1 << 10, 1 << 20
_TILE = 1 << 16
ENTRIES = ["slot", "part", "keys", "at", "cids", "sizes", "sketches"]


def _step(share: float) -> float:
    return max(0.2, -STEPS * math.log(1 - share))


def ranges_of(n_texts: int) -> int:
    """How many ranges of keys there are, so that none has too many keys or bytes; texts are asked or asking 1.5 times."""
    n = max(1, -(-n_texts * BANDS * 3 // 2 // RANGE_KEYS))
    while n_texts * 1.5 * (BANDS / n * KEY_BYTES - math.expm1(-BANDS / n) * TEXT_BYTES) > RANGE_BYTES:
        n += 1 + n // 16
    return n


def bucket_of(sizes: np.ndarray, share: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / _step(share) + 1e-9).astype(np.int64)


def asked_buckets(sizes: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of the sizes that may have a partner in it)."""
    step, log = _step(share), np.log(np.maximum(sizes, 1))
    own, reach = bucket_of(sizes, share), -math.log(1 - share) + 1e-6
    for b in range(int(own.min()) - 1, int(own.max()) + 2) if len(sizes) else ():
        at = np.flatnonzero((log + reach >= b * step) & (log - reach <= (b + 1) * step))
        if len(at):
            yield b, at


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


@lru_cache(maxsize=1)
def _functions() -> list[list[tuple[np.ndarray, list[tuple[int, ...]]]]]:
    """For every family and view the factors of its hash functions and the minima that each band joins."""
    rng = np.random.default_rng(20240229)
    out = []
    for _, _, minima, bands, rows in FAMILIES:
        views = []
        for _ in range(2 * OFFSETS):
            factors = rng.integers(1 << 31, 1 << 32, minima, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
            # neighbouring bands have as few minima in common as chance allows
            order = np.concatenate([rng.permutation(minima) for _ in range(-(-bands * rows // (minima - minima % rows)))])
            cut_up = [order[i : i + rows] for k in range(0, len(order), minima) for i in range(k, k + minima - rows + 1, rows)]
            views.append((factors, [tuple(sorted(x.tolist())) for x in cut_up[:bands]]))
        out.append(views)
    return out


def band_keys(texts: list[str], bucket: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys, a row for every text and a column for every band, and the sketches of the texts."""
    length = math.exp((bucket + 0.5) * _step(share))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    out, sketches = np.empty((len(texts), BANDS), dtype=np.uint64), np.zeros((len(texts), SKETCH_BITS * SKETCH_WORDS), dtype=np.uint64)
    widest = max(f[0] for f in FAMILIES)
    i = 0
    while i < len(order):
        # texts of about one length, as many as keep the tables in the processor's cache
        n = int(np.clip(_TILE // max(1, sizes[order[i]]), 8, 1024))
        at = order[i : i + n]
        i += n
        codes = np.frombuffer("".join(texts[k] + "\0" * (widest - 1) for k in at).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[at] + widest - 1)[:-1]])
        band = bit = 0
        for f, (q, part, minima, _, _) in enumerate(FAMILIES):
            width = max(2, round(part * length))
            grams = np.zeros(max(0, len(codes) - q + 1), dtype=np.uint32)
            for k in range(q):
                grams = grams * np.uint32(0x01000193) + codes[k : k + len(grams)]
            last = np.maximum(sizes[at] - q, 0).astype(np.uint32)
            # behind the end of a text its last shingle stands again: that changes no minimum
            place = np.minimum(np.arange(int(last.max()) + 1, dtype=np.uint32)[:, None], last[None, :])
            gram = _mixed(grams)[place + starts[None, :]]
            buffer, least = np.empty_like(gram), np.empty((minima, len(at)), dtype=np.uint32)
            for view, (factors, bands) in enumerate(_functions()[f]):
                p = last[None, :] - place if view % 2 else place
                cell = (p + np.uint32(view // 2 * width // OFFSETS)) // np.uint32(width)
                cell *= np.uint32(0x9E3779B1)
                x = _mixed(gram ^ (cell + np.uint32(view % 2)))
                for k, a in enumerate(factors):
                    np.multiply(x, a, out=buffer)
                    np.minimum.reduce(buffer, axis=0, out=least[k])
                    if not f:
                        some = (least[k] * np.uint32(0x9E3779B1)).astype(np.uint64)
                        for j in range(SKETCH_BITS):
                            sketches[at, j * SKETCH_WORDS + bit // 64] |= (some >> np.uint64(31 - j) & np.uint64(1)) << np.uint64(bit % 64)
                        bit += 1
                for rows in bands:
                    key = np.full(len(at), (band + 1) * 0x9E3779B97F4A7C15 + (bucket + 64) * 0xD6E8FEB86659FD93 & (1 << 64) - 1, dtype=np.uint64)
                    for k in rows:
                        key = (key ^ least[k]) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(29)
                    out[at, band] = key >> np.uint64(64 - KEY_BITS)
                    band += 1
    return out, sketches


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of two sketches agree in their bits."""
    other = (a ^ b).reshape(len(a), SKETCH_BITS, SKETCH_WORDS)
    return np.bitwise_count(~np.bitwise_or.reduce(other, axis=1)).sum(axis=1, dtype=np.int64)


def _planes(x: np.ndarray, n_bytes: int) -> bytes:
    """The bytes of numbers plane by plane: sorted numbers have planes that hardly change."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize)[:, :n_bytes].T).tobytes()


def _from_planes(data: bytes, n_bytes: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(n_bytes, -1)
    out = np.zeros(planes.shape[1], dtype=np.uint64)
    for k in range(n_bytes):
        out |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _packed_rows(cids: np.ndarray, texts: list[str], sides: np.ndarray, share: float, width: int, slots: list[int] | None) -> Iterator[tuple]:
    """The keys of some texts, a row for every range of keys; a key says with two bits on which sides its text stands."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    keys, at, owner, sketches, n = [], [], [], [], 0
    for b, asking in asked_buckets(sizes, share):
        own = bucket_of(sizes[asking], share) == b
        side = np.where(own, sides[asking], sides[asking] & 2).astype(np.uint64)
        asking, side = asking[side > 0], side[side > 0]
        if len(asking):
            k, s = band_keys([texts[i] for i in asking], b, share)
            keys.append(k.ravel())
            at.append(np.repeat(np.arange(n, n + len(asking), dtype=np.uint64) | side << np.uint64(22), BANDS))
            owner.append(asking)
            sketches.append(s)
            n += len(asking)
    if not keys:
        return
    k, a, owner, sketches = (np.concatenate(x) for x in (keys, at, owner, sketches))
    del keys, at
    order = np.argsort(k)
    k, a = k[order], a[order]
    parts = (k // np.uint64(width)).astype(np.int64)
    ends = np.flatnonzero(np.concatenate([parts[1:] != parts[:-1], [True]])) + 1
    begin, place = 0, np.empty(n, dtype=np.uint64)
    for end in ends:
        number = (a[begin:end] & np.uint64((1 << 22) - 1)).astype(np.int64)
        there = np.zeros(n, dtype=bool)
        there[number] = True
        used = np.flatnonzero(there)
        place[used] = np.arange(len(used))
        local = place[number] | a[begin:end] >> np.uint64(22) << np.uint64(22)
        short = np.minimum(sizes[owner[used]], 65535).astype(np.uint16)
        part = int(parts[begin])
        yield slots[part] if slots else part, part, _planes(k[begin:end], KEY_BITS // 8), _planes(local, 3), cids[owner[used]].tobytes(), short.tobytes(), sketches[used].tobytes()
        begin = end


def _packed(cids: np.ndarray, texts: list[str], sides: np.ndarray, share: float, width: int, slots: list[int] | None = None) -> pd.DataFrame:
    return pd.DataFrame(_packed_rows(cids, texts, sides, share, width, slots), columns=ENTRIES)


def _entries(batches: Iterator[pd.DataFrame], share: float, width: int, slots: list[int]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = characters = 0

    def done() -> Iterator[pd.DataFrame]:
        b = pd.concat(held)
        held.clear()
        some, size = [], 0
        for row in _packed_rows(b["cid"].to_numpy(np.int64), b["letters"].tolist(), b["side"].to_numpy(np.int64), share, width, slots):
            some.append(row)
            size += sum(map(len, row[2:]))
            if size > SENT:
                yield pd.DataFrame(some, columns=ENTRIES)
                some, size = [], 0
        yield pd.DataFrame(some, columns=ENTRIES)

    for b in batches:
        for i in range(0, len(b), PACKED // 8):
            piece = b.iloc[i : i + PACKED // 8]
            if held and (rows + len(piece) > PACKED or characters > 1 << 23):
                yield from done()
                rows = characters = 0
            held.append(piece)
            rows += len(piece)
            characters += int(piece["letters"].str.len().sum())
    if held:
        yield from done()


def within(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether two lengths allow the share; lengths from 65,535 are written as that and allow all."""
    return (np.abs(a - b) <= np.floor(share * np.maximum(a, b) + 1e-9)) | (np.maximum(a, b) >= 65535)


class _Texts:
    """Numbers, lengths and sketches of texts, by their place."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.cids, self.sizes, self.sketches = (np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def read(cids: bytes, sizes: bytes, sketches: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(cids, np.int64), np.frombuffer(sizes, np.uint16), np.frombuffer(sketches, np.uint64).reshape(-1, SKETCH_BITS * SKETCH_WORDS)

    def packed(self, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return self.cids[at].tobytes(), self.sizes[at].tobytes(), self.sketches[at].tobytes()

    def near(self, t: np.ndarray, other: _Texts, h: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of those pairs whose lengths and sketches allow the share."""
        ok = within(self.sizes[t].astype(np.int64), other.sizes[h].astype(np.int64), share) & (self.cids[t] != other.cids[h])
        t, h = t[ok], h[ok]
        ok = agreeing(self.sketches[t], other.sketches[h]) >= AGREE
        return self.cids[t[ok]], other.cids[h[ok]]


class _Range:
    """The entries of one range of keys, as they arrive."""

    def __init__(self, share: float) -> None:
        self.share = share
        self.texts: list[tuple] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_texts = self.waiting = 0
        self.least = 4 * RANGE_KEYS
        self.slices: dict[tuple[int, int], int] = {}

    def add(self, row) -> Iterator[tuple]:
        keys, at = _from_planes(row.keys, KEY_BITS // 8), _from_planes(row.at, 3)
        self.texts.append(_Texts.read(row.cids, row.sizes, row.sketches))
        self.entries.append((keys, (at & np.uint64((1 << 22) - 1)).astype(np.int64) + self.n_texts, (at >> np.uint64(22)).astype(np.uint8)))
        self.n_texts += len(self.texts[-1][0])
        self.waiting += len(keys)
        if self.waiting > self.least:
            yield from self.without_hot()
            self.least = max(4 * RANGE_KEYS, 2 * self.waiting)

    def _gather(self) -> tuple:
        k, a, s = (np.concatenate(x) for x in zip(*self.entries)) if self.entries else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8))
        order = np.argsort(k, kind="stable")
        k, a, s = k[order], a[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        return k, a, s, starts, np.diff(np.concatenate([starts, [len(k)]]))

    def without_hot(self) -> Iterator[tuple]:
        """Slices of the keys that have many texts; these are no longer kept, nor are the texts of no other key."""
        k, a, s, starts, runs = self._gather()
        texts = _Texts(self.texts)
        hot = (runs > HOT) | np.isin(k[starts], np.array(sorted({key for key, _ in self.slices}), dtype=np.uint64))
        for i in np.flatnonzero(hot):
            here, key = slice(starts[i], starts[i] + runs[i]), int(k[starts[i]])
            for side in (1, 2):
                at = a[here][(s[here] & side) > 0]
                for j in range(0, len(at), SLICE):
                    number = self.slices[key, side] = self.slices.get((key, side), -1) + 1
                    yield key, side, number, *texts.packed(at[j : j + SLICE])
        kept = np.repeat(~hot, runs)
        used, local = np.unique(a[kept], return_inverse=True)
        self.texts = [(texts.cids[used], texts.sizes[used], texts.sketches[used])]
        self.entries = [(k[kept], local, s[kept])]
        self.n_texts, self.waiting = len(used), int(kept.sum())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        k, a, s, starts, runs = self._gather()
        if not len(k):
            return
        texts = _Texts(self.texts)
        group = np.repeat(np.arange(len(starts)), runs)
        asked, asking = np.flatnonzero(s & 1), np.flatnonzero(s & 2)
        many = np.bincount(group[asked], minlength=len(starts))
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        # every asking entry with all asked ones of its key, in steps
        times = many[group[asking]]
        asking, times = asking[times > 0], times[times > 0]
        upto = np.cumsum(times)
        lo = 0
        while lo < len(asking):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            h, n = np.repeat(asking[lo:hi], times[lo:hi]), np.repeat(upto[lo:hi] - times[lo:hi], times[lo:hi])
            t = asked[first[group[h]] + np.arange(len(h)) + upto[lo] - times[lo] - n]
            yield texts.near(a[t], texts, a[h], self.share)
            lo = hi


MATCHED = ["t", "h", "key", "side", "slice", "cids", "sizes", "sketches"]


def _matched(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """Candidate pairs of every range of keys, and slices of its hot keys."""

    def slices(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for x in found:
            yield pd.DataFrame([(0, 0, *x)], columns=MATCHED)

    def finished(r: _Range) -> Iterator[pd.DataFrame]:
        if r.slices or r.waiting > HOT:
            yield from slices(r.without_hot())
        for t, h in r.pairs():
            both = np.unique(np.stack([t, h], axis=1), axis=0)
            yield pd.DataFrame({"t": both[:, 0], "h": both[:, 1]}).assign(key=0, side=0, slice=0, cids=b"", sizes=b"", sketches=b"")

    part, current = None, _Range(share)
    for b in batches:
        for row in b.itertuples(index=False):
            if row.part != part:
                yield from finished(current)
                part, current = row.part, _Range(share)
            yield from slices(current.add(row))
    yield from finished(current)


def _crossed(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        for row in b.itertuples(index=False):
            x, y = _Texts([_Texts.read(row.cids, row.sizes, row.sketches)]), _Texts([_Texts.read(row.cids_h, row.sizes_h, row.sketches_h)])
            t, h = (v.ravel() for v in np.indices((len(x.cids), len(y.cids))))
            yield pd.DataFrame(dict(zip("th", x.near(t, y, h, share))))


def candidates(classes: DataFrame, share: float, salts: int = 64) -> DataFrame:
    """(t, h): distinct pairs of an asked and an asking text that share a band and whose lengths and sketches allow it.

    ``classes`` has ``cid`` (distinct), ``letters`` and ``side`` (1 asked, 2 asking, 3 both).
    """
    spark = classes.sparkSession
    n_ranges = ranges_of(classes.count())
    each = -(-n_ranges // fewer_tasks(spark, n_ranges))
    n_tasks = -(-n_ranges // each)
    width, of_tasks = -(-(1 << KEY_BITS) // n_ranges), even_slots(spark, n_tasks)
    slots = [of_tasks[part // each] for part in range(n_ranges)]
    packed = "slot bigint, part bigint, keys binary, at binary, cids binary, sizes binary, sketches binary"
    entries = classes.select("cid", "letters", "side").mapInPandas(lambda it: _entries(it, share, width, slots), packed)
    ranged = entries.repartition(n_tasks, "slot").sortWithinPartitions("part")
    schema = "t bigint, h bigint, key bigint, side int, slice bigint, cids binary, sizes binary, sketches binary"
    matched = cut(ranged.mapInPandas(lambda it: _matched(it, share), schema))
    pairs = matched.filter("side = 0").select("t", "h")
    sliced = matched.filter("side > 0").drop("t", "h")
    if not sliced.isEmpty():
        blocks = ["cids", "sizes", "sketches"]
        salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
        asked = sliced.filter("side = 1").select("key", F.pmod("slice", F.lit(salts)).alias("salt"), *blocks)
        asking = sliced.filter("side = 2").select("key", salt, *[F.col(c).alias(f"{c}_h") for c in blocks])
        crossed = asked.join(asking, ["key", "salt"]).select(*blocks, *[f"{c}_h" for c in blocks])
        pairs = pairs.unionByName(crossed.mapInPandas(lambda it: _crossed(it, share), "t bigint, h bigint"))
    return pairs.distinct()

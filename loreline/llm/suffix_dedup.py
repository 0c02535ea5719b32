"""Exact substring dedup on bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

What counts is every ``length``-byte string that also starts in a text with a smaller id. A text is cut into segments: runs of string
starts whose strings share the place of their smallest ``anchor``-byte hash. Equal strings have equal anchors, so they meet in the
bucket of their anchor, and strings are never compared over the whole corpus.

   A side of a segment is its anchor with half of the bytes before or behind it. Every string has one or the other whole, so segments
   with no side in common share no string. Anchors alone meet by chance, more often the larger the corpus; sides seldom do.

1. Groups of texts (about GROUP_BYTES) send MARK bits of the sides of each different segment, in order, and a bucket answers which
   stand there more than once. Only segments with such a side go on: groups send one entry for each of them: anchor, segment hash,
   sides, smallest id. A bucket answers "whole" where an equal segment stands in a text with a smaller id, and "open" where different
   segments have anchor and a side in common and come from several ids. Where over ``hot`` segments of one anchor are open, they are
   marked "split".
2. Groups send the bytes of open segments once. Split segments are cut into pieces of up to PIECE string starts, by how far the
   anchor lies behind the start; the bytes that all strings of a piece's range share (all but PIECE - 1) choose its bucket, and equal pieces of a
   group travel once, so no phrase gathers more than the groups in one bucket. A bucket builds the suffix order and the Burrows-Wheeler transform of its segments and
   expands all intervals of equal prefixes breadth first: at depth d + 1 the interval of c.w is the backward step by c from that
   of w, and a boundary is set where it is first seen, that is, common prefix lengths come out by increasing value, up to
   ``length``, where the expansion stops. Suffixes left in one interval share ``length`` bytes; the smallest id of an interval keeps
   its string, and every string start of the others is answered with one bit.
3. Groups mark what was answered, merge it into maximal spans and cut those.

Copies of a segment in other texts are told by its hash (40 bits, the anchor's 48 and the bucket), open segments byte by byte.

Defined cases: null text is empty; null id sorts after every id; equal ids never remove from each other; repeated rows each get a
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm import _text as X
from loreline.llm._frames import col, text_bytes

GROUP_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
BLOCK = 8192  # places hashed at a time
LENGTH, ANCHOR = 50, 20
U = X.U
_B = U(0x9E3779B97F4A7C15)
_BYTE = X.mix(np.arange(1, 257, dtype=U))
HOT = 512  # different segments of one anchor from which they travel in pieces
PIECE = 4  # string starts in a piece
_KEY, _HASH, _SIDE = 6, 5, 2  # bytes of anchor, segment hash and each side that travel
MARK = 26  # bits of a side by which it is told whether it stands more than once


class _Runs:
    """Polynomial hashes of any runs of bytes, from running sums: sum of byte j * B ** j from the start, over B ** start."""

    up, down = np.ones(1, U), np.ones(1, U)  # powers of B and of its inverse, as far as a task needed them

    def __init__(self, data: np.ndarray):
        if len(_Runs.up) < len(data):
            _Runs.up, _Runs.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(len(data) + len(data) // 8, b)]), dtype=U) for b in (_B, U(pow(int(_B), -1, 1 << 64))))
        self.sums = np.zeros(len(data) + 1, U)
        for lo in range(0, len(data), BLOCK):
            part = slice(lo, min(lo + BLOCK, len(data)))
            np.multiply(_BYTE[data[part]], _Runs.up[part], out=self.sums[part.start + 1:part.stop + 1])
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * _Runs.down[start]

    def anchors(self, n: int, length: int, anchor: int) -> np.ndarray:
        """For each of the first ``n`` places: where in its string the ``anchor``-byte run of the smallest hash starts."""
        place = np.empty(n, np.uint32)
        for lo in range(0, n, BLOCK):  # blocks that stay in the cache
            m = min(BLOCK, n - lo) + length - anchor
            grams = X.mix((self.sums[lo + anchor:lo + anchor + m] - self.sums[lo:lo + m]) * _Runs.down[lo:lo + m])
            grams &= U(0xFFFFFFFF00000000)
            grams |= np.arange(lo, lo + m, dtype=U)
            place[lo:lo + BLOCK] = _slide_min(grams, length - anchor + 1)
        return place


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


class _Segments:
    """The segments of one group, sorted by id; one entry for each different segment."""

    def __init__(self, table: pa.Table, length: int, anchor: int, buckets: int):
        ids = X.ids_of(table["id"])
        order = np.lexsort((table["tie"].to_numpy(), ids))
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = X.bytes_of(self.table["text"])
        size = np.diff(self.offsets)
        self.text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        n = len(self.data) - length + 1
        whole = self.text[:max(n, 0)] == self.text[length - 1:]
        if n <= 0 or not whole.any():
            z = np.zeros(0, np.int64)
            self.start, self.count, self.entry = z, z, z
            self.owner, self.key, self.hash, self.first = z, np.zeros(0, U), np.zeros(0, U), z
            self.sides, self.bucket = np.zeros((2, 0), U), z
            self.order, self.cut, self.local, self.at = z, np.zeros(buckets + 1, np.int64), np.zeros(0, bool), z
            return
        self.runs = runs = _Runs(self.data)
        place = runs.anchors(n, length, anchor)
        head = whole.copy()
        head[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
        self.start = np.flatnonzero(head)
        last = np.flatnonzero(whole & np.concatenate([head[1:] | ~whole[1:], [True]]))
        self.count = last - self.start + 1  # string starts in the segment
        self.at = at = place[self.start].astype(np.int64)
        with np.errstate(over="ignore"):
            value = X.mix(runs.of(self.start, self.count + (length - 1)) + (at - self.start).astype(U) * U(0xC2B2AE3D27D4EB4F) + self.count.astype(U) * U(0x9FB21C651E98DF25))
        key = X.mix(runs.of(at, anchor))
        id_at = self.ids[self.text[self.start]]
        by = np.argsort(value)
        ranked = value[by]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(new)
        self.entry = np.empty(len(value), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.owner = np.minimum.reduceat(id_at[by], begin)
        self.local = id_at > self.owner[self.entry]
        self.key, self.hash, self.first = key[by[begin]], ranked[begin], by[begin]
        self.sides = self._sides(length, anchor)
        self.bucket = bucket = (X.mix(self.key) % U(buckets)).astype(np.int64)
        self.order = np.lexsort((self.owner, bucket))
        self.cut = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def asked(self, bucket: int, raw) -> np.ndarray:
        """The entries that were sent to a bucket, in the order in which they were."""
        e = self.order[self.cut[bucket]:self.cut[bucket + 1]]
        return e[_unpack(raw, len(e))]

    def _sides(self, length: int, anchor: int) -> np.ndarray:
        """For each entry a hash of its anchor with the bytes before it and one with those behind it; 0 where no string has them all."""
        half = (length - anchor + 1) // 2
        at, start = self.at[self.first], self.start[self.first]
        last = start + self.count[self.first] - 1
        out = np.zeros((2, len(at)), U)
        # strings whose anchor lies at least half behind their start, and all others
        for k, (has, before, size) in enumerate(((at - start >= half, half, anchor + half), (at - last < half, 0, length - half + 1))):
            out[k, has] = X.mix(self.runs.of(at[has] - before, size) + U(k)) | U(1)
        return out

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry and mark of every side, by bucket and mark, and where each bucket begins."""
        side, entry = np.nonzero(self.sides)
        mark = (self.bucket[entry].astype(U) << U(MARK)) | (self.sides[side, entry] >> U(64 - MARK))
        by = np.argsort(mark)
        mark = mark[by]
        return entry[by], mark & U((1 << MARK) - 1), np.searchsorted(mark >> U(MARK), np.arange(len(self.cut), dtype=U))


class _Pieces:
    """The pieces of some entries of a group, in bucket order; one for each different piece."""

    def __init__(self, s: _Segments, entries: np.ndarray, length: int, anchor: int, buckets: int):
        entries = np.sort(entries)
        seg = s.first[entries]
        at, start = s.at[seg], s.start[seg]
        near, far = at - (start + s.count[seg] - 1), at - start  # how far the anchor lies behind the last and the first start
        width = min(PIECE, length)
        found = []
        for lo in range(0, length - anchor + 1, width):
            a, b = np.maximum(near, lo), np.minimum(far, lo + width - 1)
            has = np.flatnonzero(a <= b)
            found.append((entries[has], (at - b)[has], (b - a + 1)[has], X.mix(s.runs.of(at[has] - lo, length - width + 1) + U(lo)), (at - b - start)[has], b[has]))
        self.entry, begin, count, key, self.shift, far = (np.concatenate(x) for x in zip(*found))
        with np.errstate(over="ignore"):
            value = X.mix(X.mix(s.runs.of(begin, count + (length - 1)) + key) + (far * 64 + count).astype(U))
        by = np.lexsort((value, (key % U(buckets)).astype(np.int64)))
        ranked = value[by]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        head = by[np.flatnonzero(new)]
        self.kind = np.empty(len(value), np.int64)
        self.kind[by] = np.cumsum(new) - 1
        self.owner = np.minimum.reduceat(s.owner[self.entry][by], np.flatnonzero(new)) if len(by) else s.owner[:0]
        self.begin, self.count, self.each = begin[head], count[head], count
        self.cut = np.searchsorted((key[head] % U(buckets)).astype(np.int64), np.arange(buckets + 1))

    def masks(self, s: _Segments, answered: np.ndarray, into: np.ndarray) -> None:
        """Add to the masks of entries what was answered for their pieces; a piece that a smaller id of the group has goes whole."""
        whole = (np.uint32(1) << self.each.astype(np.uint32)) - np.uint32(1)
        bits = np.where(s.owner[self.entry] > self.owner[self.kind], whole, answered[self.kind])
        np.bitwise_or.at(into, self.entry, bits << self.shift.astype(np.uint32))


def _bytes_at(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    begin = np.cumsum(size) - size
    return data[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(begin, size)].tobytes()


def _tell(length: int, anchor: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        s = _Segments(table, length, anchor, buckets)
        _, mark, cut = s.marks()
        rows = [(b, X.planes(np.diff(mark[cut[b]:cut[b + 1]].astype(np.uint32), prepend=np.uint32(0)))) for b in np.flatnonzero(np.diff(cut)).tolist()]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([table["grp"][0].as_py()] * len(rows), pa.int64()), "marks": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _again(table: pa.Table) -> pa.Table:
    """Which marks of a bucket stand there more than once."""
    marks = [np.cumsum(X.unplanes(x, len(x) // 4, 4, np.uint32), dtype=np.uint32) for x in table["marks"].to_pylist()]
    every = np.concatenate(marks)
    by = np.argsort(every)
    same = every[by[1:]] == every[by[:-1]]
    found = np.zeros(len(every), bool)
    found[by] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    edge = np.cumsum([0, *map(len, marks)])
    out = pa.table({"grp": table["grp"], "bucket": table["bucket"], "again": pa.array([_pack(found[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())})
    return out.filter(out["again"].is_valid())


def _ask(length: int, anchor: int, buckets: int):
    def run(table: pa.Table, again: pa.Table | None = None) -> pa.Table:
        rows = []
        if table.num_rows:
            s = _Segments(table, length, anchor, buckets)
            asked = np.full(len(s.key), again is None)
            if again is not None:
                entry, _, cut = s.marks()
                for b, raw in zip(again["bucket"].to_pylist(), again["again"].to_pylist()):
                    at = entry[cut[b]:cut[b + 1]]
                    asked[at[_unpack(raw, len(at))]] = True
            for b, (lo, hi) in enumerate(zip(s.cut[:-1], s.cut[1:])):
                e = s.order[lo:hi][asked[s.order[lo:hi]]]
                if len(e):
                    sides = [X.planes(np.where(x > 0, x % U((1 << 8 * _SIDE) - 1) + U(1), U(0)), _SIDE) for x in s.sides[:, e]]
                    rows.append((b, table["grp"][0].as_py(), _pack(asked[s.order[lo:hi]]), X.planes(np.diff(s.owner[e], prepend=np.int64(0))), b"".join([X.planes(s.key[e], _KEY), X.planes(s.hash[e], _HASH), *sides])))
        kinds = (("bucket", pa.int32()), ("grp", pa.int64()), ("asked", pa.binary()), ("owners", pa.binary()), ("entries", pa.binary()))
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(kinds)})

    return run


def _pack(mask: np.ndarray):
    return np.packbits(mask).tobytes() if mask.any() else None


def _unpack(raw, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if raw is not None else np.zeros(n, bool)


def _meet(anchor: np.ndarray, sides: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which different segments have anchor and a side in common with one of another id."""
    found = np.zeros(len(anchor), bool)
    for side in sides:
        at = np.flatnonzero(side)
        value = (anchor[at] << 8 * _SIDE) | side[at]
        by = np.argsort(value)
        at, value = at[by], value[by]
        if len(at):
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            several = np.minimum.reduceat(owner[at], head) < np.maximum.reduceat(owner[at], head)
            found[at] |= np.repeat(several, np.diff(head, append=len(at)))
    return found


def _answer(hot: int):
    def run(table: pa.Table) -> pa.Table:
        key, value, sides, owner, counts = [], [], [], [], []
        for o, e in zip(table["owners"].to_pylist(), table["entries"].to_pylist()):
            n = len(o) // 8
            counts.append(n)
            owner.append(np.cumsum(X.unplanes(o, n, 8, np.int64)))
            key.append(X.unplanes(e[:n * _KEY], n, _KEY))
            value.append(X.unplanes(e[n * _KEY:], n, _HASH))
            sides.append([X.unplanes(e[n * (_KEY + _HASH + k * _SIDE):], n, _SIDE, np.uint16) for k in range(2)])
        key, value, owner, sides = np.concatenate(key), np.concatenate(value), np.concatenate(owner), np.concatenate(sides, axis=1)
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        many = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # an anchor that stands once needs no answer
        order = many[np.lexsort((owner[many], value[many], key[many]))]
        k, v, o = key[order], value[order], owner[order]
        new_k = np.ones(len(k), bool)
        new_k[1:] = k[1:] != k[:-1]
        new_v = new_k.copy()
        new_v[1:] |= v[1:] != v[:-1]
        by_k, by_v = np.cumsum(new_k) - 1, np.cumsum(new_v) - 1
        kind = np.flatnonzero(new_v)
        least = o[kind]
        near = _meet(by_k[kind], sides[:, order[kind]], least)
        among = np.bincount(by_k[kind], weights=near, minlength=int(new_k.sum()))  # open segments of each anchor
        whole, opened, split = (np.zeros(len(key), bool) for _ in range(3))
        whole[order] = o > least[by_v]
        opened[order] = (o == least[by_v]) & near[by_v]
        split[order] = opened[order] & (among > hot)[by_k]
        edge = np.concatenate([[0], np.cumsum(counts)])
        spans = list(zip(edge[:-1], edge[1:]))
        out = pa.table({"grp": table["grp"], "bucket": table["bucket"], "asked": table["asked"], "whole": pa.array([_pack(whole[a:b]) for a, b in spans], pa.binary()), "opened": pa.array([_pack(opened[a:b]) for a, b in spans], pa.binary()), "split": pa.array([_pack(split[a:b]) for a, b in spans], pa.binary())})
        return out.filter(pa.compute.or_(out["whole"].is_valid(), out["opened"].is_valid()))

    return run


def _open_bytes(length: int, anchor: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, parted = [], []
        if table.num_rows:
            s, grp = _Segments(table, length, anchor, buckets), table["grp"][0].as_py()
            for b, asked, raw, cut in zip(*[answers[c].to_pylist() for c in ("bucket", "asked", "opened", "split")]):
                mine = s.asked(b, asked)
                apart = _unpack(cut, len(mine))
                parted.append(mine[apart])
                e = mine[_unpack(raw, len(mine)) & ~apart]
                if len(e):
                    size = s.count[s.first[e]] + length - 1
                    rows.append((b, grp, False, s.owner[e].tobytes(), size.astype(np.uint16).tobytes(), _bytes_at(s.data, s.start[s.first[e]], size)))
            if sum(map(len, parted)):
                p = _Pieces(s, np.concatenate(parted), length, anchor, buckets)
                for b in np.flatnonzero(np.diff(p.cut)).tolist():
                    k = slice(p.cut[b], p.cut[b + 1])
                    size = p.count[k] + length - 1
                    rows.append((b, grp, True, p.owner[k].tobytes(), size.astype(np.uint16).tobytes(), _bytes_at(s.data, p.begin[k], size)))
        kinds = (("bucket", pa.int32()), ("grp", pa.int64()), ("parts", pa.bool_()), ("owners", pa.binary()), ("sizes", pa.binary()), ("content", pa.binary()))
        return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(kinds)})

    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first ``depth`` symbols or more (prefix doubling; equal prefixes stay in any order).

    With them, which places of the order differ from the one before in the first symbols, and in how many of these.
    """
    n = len(text)
    bits = max(1, (n - 1).bit_length())  # of a place; they travel below the key, so that values are sorted and not their places
    used = np.zeros(1 << 16, bool)
    used[text] = True
    used[0] = True
    wide = max(1, int(used.sum() - 1).bit_length())
    code = (np.cumsum(used) - 1).astype(U)[text]
    have = min(depth, (64 - bits) // wide)
    key = np.zeros(n, U)
    for j in range(have):
        key <<= U(wide)
        key[:max(n - j, 0)] |= code[j:]
    low = U((1 << bits) - 1)
    key = np.sort((key << U(bits)) | np.arange(n, dtype=U))
    order = (key & low).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (key[1:] >> U(bits)) != (key[:-1] >> U(bits))
    seed, seeded = new, have
    dense, new = np.zeros(n + 1, np.uint32), new.copy()
    while have < depth and not new.all():
        dense[order] = np.cumsum(new, dtype=np.uint32)  # 0: past the end
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)  # only suffixes that are not told apart yet are sorted again, within their groups
        mine = order[at]
        group, after = np.cumsum(new[at], dtype=U), dense[np.minimum(mine + have, n)].astype(U)
        bits, wide = len(at).bit_length(), int(dense.max()).bit_length()
        value = (group << U(wide)) | after
        if int(group[-1]).bit_length() + wide + bits <= 64:
            value = np.sort((value << U(bits)) | np.arange(len(at), dtype=U))
            order[at] = mine[(value & U((1 << bits) - 1)).astype(np.int64)]
            value >>= U(bits)
        else:
            by = np.argsort(value)
            order[at], value = mine[by], value[by]
        new[at[1:]] = value[1:] != value[:-1]
        have *= 2
    return order, seed, seeded


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text``, and the interval each place of it falls in after expansion to depth ``length``.

    ``text`` holds symbols 2.. and separators 0 (never extended over). Places of one interval have suffixes with equal first
    ``length`` symbols. next_of follows the Burrows-Wheeler transform: place p comes from place next_of[p] by a backward step with
    symbol first[p], so the interval of c.w at depth d + 1 ends between neighbours p - 1, p unless they step from one interval w.
    """
    n = len(text)
    order, edge, depth = suffix_order(text, length)
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n)
    place[n] = 0
    # intervals of the first symbols, as they were sorted; a suffix with a separator there is an interval of its own, as nothing is extended over it
    gap = np.full(n + 1, n, np.int32)
    zero = np.flatnonzero(text == 0)
    gap[zero] = zero
    gap = np.minimum.accumulate(gap[::-1])[::-1]
    short = (gap[:n] - np.arange(n) < depth)[order]
    edge = edge | short
    edge[1:] |= short[:-1]
    inner = np.flatnonzero(~edge)
    left, right = place[order[inner - 1] + 1], place[order[inner] + 1]
    for _ in range(depth, length):
        if not len(inner):
            break
        interval = np.cumsum(edge, dtype=np.int32)
        split = np.take(interval, left) != np.take(interval, right)
        edge[inner[split]] = True
        if 8 * np.count_nonzero(split) > len(inner):
            stay = ~split
            inner, left, right = inner[stay], left[stay], right[stay]
    return order, np.cumsum(edge) - 1


def _expand(length: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in table["sizes"].to_pylist()]
        counts = [len(x) for x in sizes]
        size = np.concatenate(sizes)
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()])
        raw = np.frombuffer(b"".join(table["content"].to_pylist()), np.uint8)
        # segments one after another, each closed by a separator
        begin = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.uint16)
        inside = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(begin, size) + inside] = raw.astype(np.uint16) + 2
        order, interval = equal_prefixes(text, length)
        seg_of = np.repeat(np.arange(len(size)), size + 1)
        offset = np.arange(len(text)) - begin[seg_of]
        starts = offset + length <= size[seg_of]  # places where a whole string starts
        use = starts[order]
        at, group = order[use], interval[use]
        ids = owner[seg_of[at]]
        masks = np.zeros(len(size), np.uint32)
        if len(at):
            new = np.ones(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = at[ids > least]
            np.bitwise_or.at(masks, seg_of[hit], np.uint32(1) << offset[hit].astype(np.uint32))
        edge = np.concatenate([[0], np.cumsum(counts)])
        return pa.table({"grp": table["grp"], "bucket": table["bucket"], "parts": table["parts"], "masks": pa.array([X.planes(masks[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return run


def _cut(length: int, anchor: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        s = _Segments(table, length, anchor, buckets)
        whole, mask = np.zeros(len(s.key), bool), np.zeros(len(s.key), np.uint32)
        opened: dict[int, np.ndarray] = {}
        parted: list[np.ndarray] = []
        masks: dict[tuple[int, bool], bytes] = {}
        for b, asked, w, o, c, parts, m in zip(*[answers[x].to_pylist() for x in ("bucket", "asked", "whole", "opened", "split", "parts", "masks")]):
            if m is not None:
                masks[b, parts] = m
                continue
            mine = s.asked(b, asked)
            apart = _unpack(c, len(mine))
            whole[mine] = _unpack(w, len(mine))
            opened[b] = mine[_unpack(o, len(mine)) & ~apart]
            parted.append(mine[apart])
        pieces = _Pieces(s, np.concatenate(parted), length, anchor, buckets) if sum(map(len, parted)) else None
        told = np.zeros(len(pieces.owner) if pieces else 0, np.uint32)
        for (b, parts), m in masks.items():
            if parts:
                lo, hi = pieces.cut[b], pieces.cut[b + 1]
                told[lo:hi] = X.unplanes(m, hi - lo, 4, np.uint32)
            else:
                mask[opened[b]] = X.unplanes(m, len(opened[b]), 4, np.uint32)
        if pieces:
            pieces.masks(s, told, mask)
        n = len(s.data)
        delta = np.zeros(n + 1, np.int32)
        if len(s.start):
            all_of = s.local | whole[s.entry]
            bits = mask[s.entry]
            some = np.flatnonzero(~all_of & (bits > 0))
            seg, inside = np.nonzero((bits[some, None] >> np.arange(length - anchor + 1, dtype=np.uint32)) & 1)
            at = np.concatenate([s.start[all_of], s.start[some[seg]] + inside])
            end = np.concatenate([(s.start + s.count - 1)[all_of], s.start[some[seg]] + inside]) + length
            delta += np.bincount(at, minlength=n + 1).astype(np.int32) - np.bincount(end, minlength=n + 1).astype(np.int32)
        gone = np.cumsum(delta[:n]) > 0
        rows = s.table.num_rows
        head = gone.copy()
        head[1:] &= ~gone[:-1] | (s.text[1:] != s.text[:-1])
        removed = np.bincount(s.text[gone], minlength=rows).astype(np.int64)
        size = np.diff(s.offsets)
        kept = s.data[~gone]
        offsets = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int64)
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
        return pa.table({"id": s.table["id"], "n_bytes": pa.array(size.astype(np.int64)), "n_removed": pa.array(removed), "n_spans": pa.array(np.bincount(s.text[head], minlength=rows).astype(np.int64)), "kept": out.cast(pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a text with a smaller id.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the remaining bytes).
    """
    if not 1 <= length - anchor < 32:
        raise ValueError("length - anchor must lie in 1 .. 31")
    _, size = text_bytes(docs, "`" + text_col + "`")
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))
    tie = F.xxhash64(col(id_col), col(text_col))
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"), tie.alias("tie"), F.pmod(tie, F.lit(groups)).alias("grp"))
    by_group = texts.groupBy("grp")
    again = by_group.applyInArrow(_tell(length, anchor, buckets), "bucket int, grp long, marks binary").groupBy("bucket").applyInArrow(_again, "grp long, bucket int, again binary")
    asked = by_group.cogroup(again.groupBy("grp")).applyInArrow(_ask(length, anchor, buckets), "bucket int, grp long, asked binary, owners binary, entries binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(hot), "grp long, bucket int, asked binary, whole binary, opened binary, split binary")
    opened = by_group.cogroup(answers.groupBy("grp")).applyInArrow(_open_bytes(length, anchor, buckets), "bucket int, grp long, parts boolean, owners binary, sizes binary, content binary")
    masks = opened.groupBy("bucket").applyInArrow(_expand(length), "grp long, bucket int, parts boolean, masks binary")
    every = answers.unionByName(masks, allowMissingColumns=True)
    cut = by_group.cogroup(every.groupBy("grp")).applyInArrow(_cut(length, anchor, buckets), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("id", id_col)

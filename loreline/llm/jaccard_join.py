"""N-gram Jaccard self-join and near-duplicate classes by PartEnum signatures.

A text's set holds its different ``width``-word shingles. Sets are put into bands of nearly equal size; within two
neighbouring bands Jaccard >= t means a Hamming distance of at most k. PartEnum deals the shingle domain to n1 parts of n2
sub-parts; two sets within k agree, in some part, on all but one sub-part, so the signatures "part without one sub-part" have one in
common. For k <= 1 every shingle is a sub-part of its own: the signatures are the set, and the set without each one shingle.

A signature that covers no shingle says nothing, and all short texts would meet in it, so it is not sent. A set with more parts that give
such a signature than its distance leaves to spare takes part in a second dealing of the domain, by another hash, and so on: if the only common
signature of two linked sets is an empty one, both have such parts and both take part. After ``LEVELS`` dealings (a share of the
sets that falls at least tenfold each time is left) empty signatures are sent too, so no linked pair is lost.

1. One map over the texts gives (id, size, set hash, parity sketch); equal sets meet in one representative (map-side aggregated).
2. One map over the texts sends signatures to buckets, one copy of a set a task; a bucket keeps the groups that share one. It reads its
   signatures as a stream: a signature of more than ``PAGE`` sets leaves in pages that share their first set.
3. Sizes and parity sketches (a lower bound of the Hamming distance) rule out most pairs of a group or page. Each set is verified
   exactly against one leader, the nearest by sketch of those that it may link with; components of these links.
4. Groups that still hold several components: pairs across components that are not ruled out (by finer sketches) are verified exactly; a paged group is
   split into tiles of PAGE by PAGE sets for that. Pairs inside a component need no look: a further link would change nothing.
5. Components of all links and equal sets.

Verification of leaders sends each text to its leader's key (a hot leader is salted and its text repeated for each salt); that of step 4
deals a component's texts to tiles of bounded size. Texts are sent only for candidates, told by a Bloom filter of fixed size, which
affects cost alone. A set goes by the hash of its id and text, never by its id, so an id's several texts are several sets.

Defined cases: ASCII case folded; fewer words than ``width`` make one shingle of all words; no words or null text: an empty set, linked with
nothing; null ids: linked with nothing, component null; repeated ids are one node with several sets; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm import _text as X
from loreline.llm._components import components
from loreline.llm._frames import checkpoint, col, discard, text_bytes

WIDTH, PERCENT = 5, 80
SUBPARTS, LEVELS = 3, 6
BUCKET_BYTES = 6 << 20
SIGNATURE, NAME = 4, 5  # bytes of a signature and of a set's name that travel; a chance agreement is only a candidate more
SKETCH_BITS, FINE_BITS = (512, 1 << 16), (1024, 1 << 17)  # least and most
SMALL_GROUP = 64  # members up to which all pairs of a group are looked at in one vector step
PAGE = 1024  # sets of a signature that are looked at together
CHUNK = 1 << 20  # signatures of a bucket that are sorted at once, besides those that wait for others
TILE = 64  # sets of one cell of a tile
SALT_AT = 256  # sets verified against one copy of a partner's set
VERIFY = 256  # texts verified in one call
BLOOM_BITS = 1 << 21
U = X.U


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of every text."""
    words = X.split_words(data, offsets)
    hashes = X.hash_words(data, words, X.LOWER)
    rolled = X.mix(X.roll(hashes, width))
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            out.append(X.mix(X.roll(hashes[a:b], b - a)) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def bands(size: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(band, largest Hamming distance) of the two instances a set of this size takes part in."""
    low, band = 1, 0
    while True:
        high = 100 * low // percent
        if size <= high:
            nxt = 100 * (high + 1) // percent
            # sizes up to r on both sides: distance <= (1 - t) / (1 + t) * 2 r
            reach = lambda r: 2 * r * (100 - percent) // (100 + percent)
            return (band, reach(high)), (band + 1, reach(nxt))
        low, band = high + 1, band + 1


def _parts(k: np.ndarray) -> np.ndarray:
    """Parts for distance k: k // 2 + 1 are needed, some are spare."""
    return k // 2 + 1 + np.where(k >= 8, 2 + k // 100, np.where(k >= 4, 1, 0))


def _deal(values: np.ndarray, size: np.ndarray, band: np.ndarray, k: np.ndarray, reach: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One dealing for sets of ``size`` shingles each (k of 2 or more): signatures, their sets, and the sets that need another dealing.

    ``reach`` bounds a set's own distance from what it links with, so at most reach // 2 of its parts hold two differences or more; a
    set whose other parts could all give empty signatures needs another dealing.
    """
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    parts = _parts(k)
    first = np.cumsum(parts) - parts
    code = X.mix(values ^ (U(0xA0761D6478BD642F) + band.astype(U) + U(level << 32))[owner])
    part = first[owner] + ((code >> U(8)) % parts.astype(U)[owner]).astype(np.int64)
    cell = part * SUBPARTS + (code & U(0xFF)).astype(np.int64) % SUBPARTS
    rows = int(parts.sum())
    with np.errstate(over="ignore"):
        total = np.zeros(rows * SUBPARTS, U)
        np.add.at(total, cell, X.mix(code))
        total = total.reshape(rows, SUBPARTS)
        count = np.bincount(cell, minlength=rows * SUBPARTS).reshape(rows, SUBPARTS)
        rest = total.sum(axis=1, dtype=U)[:, None] - total
        left = count.sum(axis=1)[:, None] - count
        of = np.repeat(np.arange(n), parts)
        name = (np.arange(rows) - first[of]) * SUBPARTS + band[of] * 1_000_003 + level * 500_009
        value = X.mix(rest + X.mix((name[:, None] + np.arange(SUBPARTS)).astype(U)))
    again = np.bincount(of, ((count > 0).sum(axis=1) <= 1), n) >= parts - reach // 2
    send = (left > 0) | (again[of][:, None] & (level == LEVELS - 1))
    return value[send], np.broadcast_to(of[:, None], send.shape)[send], np.flatnonzero(again)


def signatures_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets that are not empty, for both instances of each one's size: (signature, index of its set)."""
    size = np.array([len(x) for x in sets], np.int64)
    values = np.concatenate(sets)
    first = np.cumsum(size) - size
    known = {int(n): bands(int(n), percent) for n in np.unique(size)}
    own = (size + 100 * size // percent) * (100 - percent) // (100 + percent)  # a partner has at most 100 / percent times the size
    out, who = [], []
    for instance in (0, 1):
        band, k = (np.array([known[int(n)][instance][j] for n in size], np.int64) for j in (0, 1))
        few = np.flatnonzero(k <= 1)
        if len(few):
            at = np.repeat(first[few], size[few]) + np.arange(int(size[few].sum())) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
            owner = np.repeat(few, size[few])
            with np.errstate(over="ignore"):
                each = X.mix(values[at] ^ (U(0xA0761D6478BD642F) + band[owner].astype(U)))
                whole = np.add.reduceat(each, np.cumsum(size[few]) - size[few])
                name = X.mix((band * 1_000_003 + 999_983).astype(U))
                out.append(X.mix(whole + name[few]))
                who.append(few)
                one = np.repeat(k[few] == 1, size[few])
                out.append(X.mix(np.repeat(whole, size[few]) - each + name[owner])[one])
                who.append(owner[one])
        mine = np.flatnonzero(k > 1)
        for level in range(LEVELS):
            if not len(mine):
                break
            at = np.repeat(first[mine], size[mine]) + np.arange(int(size[mine].sum())) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
            value, owner, again = _deal(values[at], size[mine], band[mine], k[mine], np.minimum(k, own)[mine], level)
            out.append(value)
            who.append(mine[owner])
            mine = mine[again]
    return np.concatenate(out), np.concatenate(who)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    return signatures_of([shingles], percent)[0]


def sketch(shingles: np.ndarray, fine: bool) -> bytes:
    """Parity of the number of shingles in each cell: two sets differ in at least as many shingles as their sketches in bits.

    The number of cells is a power of two of at least half the size (enough to tell unlike sets), or twice it (to tell near ones).
    """
    low, high = FINE_BITS if fine else SKETCH_BITS
    want = 2 * len(shingles) if fine else len(shingles) // 2
    bits = min(max(low, 1 << max(want - 1, 1).bit_length()), high)
    return np.packbits(np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches folded to ``width`` bytes: parts of a parity sketch add up to the sketch of fewer cells."""
    if all(len(x) == width for x in sketches):
        return np.frombuffer(b"".join(sketches), U).reshape(-1, width // 8)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, width // 8), axis=0) for x in sketches])


def _set_key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = X.mix(np.array([s.sum(dtype=U) + U(len(s))]))[0]
        b = X.mix(s).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _describe(width: int):
    def run(batches):
        for b in X.slices(batches, "text"):
            sets = shingle_sets(*X.bytes_of(b.column("text")), width)
            keys = [_set_key(s) for s in sets]
            yield pa.record_batch({"doc": b.column("doc"), "id": b.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array([k[0] for k in keys], pa.int64()), "h2": pa.array([k[1] for k in keys], pa.int64()), "sketch": pa.array([sketch(s, False) if len(s) else None for s in sets], pa.binary()), "fine": pa.array([sketch(s, True) if len(s) else None for s in sets], pa.binary())})

    return run


def _send(width: int, percent: int, buckets: int):
    def run(batches):
        sent: set[tuple[int, int]] = set()  # the sets of this task: copies send once
        for b in X.slices(batches, "text"):
            keys, sets = [], []
            for i, s in zip(b.column("id").to_pylist(), shingle_sets(*X.bytes_of(b.column("text")), width)):
                if len(s) and i is not None and (key := _set_key(s)) not in sent:
                    sent.add(key)
                    keys.append(key[0])
                    sets.append(s)
            if not sets:
                continue
            value, owner = signatures_of(sets, percent)
            # buckets by the high half of a signature, of which the low half travels; in order of signatures, so that an entry costs
            # the same bytes at any number of buckets
            order = np.argsort(value)
            value, name = value[order], np.array(keys, np.int64).astype(U)[owner[order]]
            cut = np.searchsorted(((value >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))
            some = np.flatnonzero(np.diff(cut))
            yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "entries": pa.array([X.planes(value[cut[k]:cut[k + 1]], SIGNATURE) + X.planes(name[cut[k]:cut[k + 1]], NAME) for k in some], pa.binary())})

    return run


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(value)))


def _meet(page: int, chunk: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of sets that share a signature in one bucket, equal groups once; those of more than ``page`` sets in pages with ``sig``."""
        bucket = key[0].as_py()
        value, name = np.zeros(0, U), np.zeros(0, np.int64)  # what waits for others
        heads: dict[int, int] = {}  # signatures that are paged, with the set that all pages share
        fresh: list[bytes] = []
        pages: list[tuple[int, np.ndarray]] = []

        def absorb():
            nonlocal value, name, fresh
            n = [len(x) // (SIGNATURE + NAME) for x in fresh]
            value = np.concatenate([value, *[X.unplanes(x[:m * SIGNATURE], m, SIGNATURE) for x, m in zip(fresh, n)]])
            name = np.concatenate([name, *[X.unplanes(x[m * SIGNATURE:], m, NAME, np.int64) for x, m in zip(fresh, n)]])
            fresh = []
            order = np.lexsort((name, value))
            value, name = value[order], name[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (name[1:] != name[:-1])
            value, name = value[new], name[new]
            begin, size = _runs(value)
            hot = (size > page) | np.isin(value[begin], np.fromiter(heads, U, len(heads)))
            for a, m in zip(begin[hot], size[hot]):
                head = heads.setdefault(int(value[a]), int(name[a]))
                rest = name[a:a + m][name[a:a + m] != head]
                rest = rest[np.argsort(X.mix(rest.astype(U) ^ value[a]))]  # sets that share several signatures meet on a page of some
                pages.extend((int(value[a]), np.append(head, rest[j:j + page])) for j in range(0, len(rest), page))
            wait = ~np.repeat(hot, size)
            value, name = value[wait], name[wait]

        def out(rows):
            return pa.record_batch({"sig": pa.array([None if v is None else int(X.mix(np.array([v ^ bucket << 40], U)).view(np.int64)[0]) for v, _ in rows], pa.int64()), "members": pa.array([m for _, m in rows], pa.list_(pa.int64()))})

        have = 0
        for b in batches:
            for x in b.column("entries").to_pylist():
                fresh.append(x)
                have += len(x) // (SIGNATURE + NAME)
                if have >= chunk:
                    absorb()
                    have = 0
                    if pages:
                        yield out(pages)
                        pages.clear()
        absorb()
        begin, size = _runs(value)
        groups = {name[a:a + m].tobytes() for a, m in zip(begin[size > 1], size[size > 1])}
        yield out(pages + [(None, np.frombuffer(g, np.int64)) for g in groups])

    return run


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the texts whose id stands in ``wanted``, and of a few more.

    Ids are told by a Bloom filter of fixed size (at most BLOOM_BITS cell numbers reach the driver), so that other texts are not
    shuffled; a full filter costs time, never a text.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOOM_BITS)).cast("int")
    cells = wanted.select(cell("id").alias("c")).distinct().toArrow()["c"].to_numpy()
    bits = np.zeros(BLOOM_BITS, bool)
    bits[cells] = True
    shared = wanted.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        done = np.zeros(0, np.int64)  # ids that this task has sent: exactly repeated rows go once
        for b in batches:
            c = b.column("cell").to_numpy()
            told = np.flatnonzero((shared.value[c >> 3] >> (7 - (c & 7))) & 1 > 0)
            ids, first = np.unique(b.column("id").to_numpy(zero_copy_only=False)[told], return_index=True)
            fresh = ~np.isin(ids, done)
            done = np.union1d(done, ids[fresh])
            yield b.select(["id", "text"]).take(pa.array(np.sort(told[first[fresh]])))

    return texts.select("id", "text", cell("id").alias("cell")).mapInArrow(run, "id long, text string")


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify_heads(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs (a, b) that link: each asked text (role 1) against the head (role 0) of its key and salt."""
        ids, role, out = table["id"].to_numpy(), table["role"].to_numpy(), []
        order = np.lexsort((role, table["salt"].to_numpy(), table["key"].to_numpy()))
        head, of = None, None
        for b in X.slices(table.take(pa.array(order)).select(["key", "salt", "role", "id", "text"]).combine_chunks().to_batches(), "text"):
            at = list(zip(b.column("key").to_pylist(), b.column("salt").to_pylist()))
            for k, r, i, s in zip(at, b.column("role").to_pylist(), b.column("id").to_pylist(), shingle_sets(*X.bytes_of(b.column("text")), width)):
                if r == 0:
                    head, of = s, k
                elif k == of and _link(head, s, percent):
                    out.append((k[0], i))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _verify(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets link. ``texts`` has a row for each id that stands in pairs; rows of one id are equal."""
    count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_AT)).cast("int").alias("salts"))
    asked = pairs.join(count, "a").select(F.col("b").alias("id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = count.select(F.col("a").alias("id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = checkpoint(asked.unionByName(heads))
    calls = max(1, wanted.count() // VERIFY)
    sent = _texts_of(texts, wanted).join(wanted, "id").select(F.pmod(F.xxhash64("key", "salt"), F.lit(calls)).alias("call"), "key", "salt", "role", "id", "text")
    found = checkpoint(sent.groupBy("call").applyInArrow(_verify_heads(width, percent), "a long, b long").distinct())
    discard(wanted)
    return found


class _Members:
    """Groups of sets (grp, id, n, sketch) in one bucket, sorted by group and id."""

    def __init__(self, table: pa.Table, percent: int):
        grp, ids = table["grp"].to_numpy(), table["id"].to_numpy()
        order = np.lexsort((ids, grp))
        self.grp, self.ids, self.n = grp[order], ids[order], table["n"].to_numpy()[order]
        self.sketch = table["sketch"].take(pa.array(order)).to_pylist()
        self.order = order
        base = min(map(len, self.sketch), default=8)
        self.bits = fold(self.sketch, base)
        self.long = np.array([len(x) for x in self.sketch]) > base
        self.component = table["component"].to_numpy()[order] if "component" in table.column_names else None
        self.percent = percent
        begin = np.flatnonzero(np.concatenate([[True], self.grp[1:] != self.grp[:-1]]))
        size = np.diff(np.append(begin, len(self.grp)))
        self.large = [(b, b + m) for b, m in zip(begin[size > SMALL_GROUP], size[size > SMALL_GROUP])]
        self.size = np.repeat(size, size)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of pairs that sizes and sketches allow to link, and how many cells their sketches differ in (at their widest)."""
        p, n = self.percent, self.n
        ok = 100 * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j])
        differ = np.zeros(len(ok), np.int64)
        at = np.flatnonzero(ok)
        differ[at] = np.bitwise_count(self.bits[i[at]] ^ self.bits[j[at]]).sum(axis=1, dtype=np.int64)
        ok[at] = (100 + p) * differ[at] <= (100 - p) * (n[i[at]] + n[j[at]])
        for k in np.flatnonzero(ok & self.long[i] & self.long[j]):  # long sets have finer sketches
            x, y = self.sketch[i[k]], self.sketch[j[k]]
            width = min(len(x), len(y))
            differ[k] = int(np.bitwise_count(fold([x], width) ^ fold([y], width)).sum())
            ok[k] = (100 + p) * differ[k] <= (100 - p) * (n[i[k]] + n[j[k]])
        return ok, differ

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.near(i, j)[0]

    def small_pairs(self):
        """(i, j, differing cells) for the possible pairs of small groups, one step between their places at a time."""
        for d in range(1, SMALL_GROUP):
            i = np.flatnonzero((self.grp[:-d] == self.grp[d:]) & (self.size[:-d] <= SMALL_GROUP)) if d < len(self.grp) else []
            if not len(i):
                return
            if self.component is not None:
                i = i[self.component[i] != self.component[i + d]]
            ok, differ = self.near(i, i + d)
            yield i[ok], i[ok] + d, differ[ok]


def _leaders(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """For each set of a group the nearest one before it that it may link with; and the groups that hold further possible pairs."""
        g = _Members(table, percent)
        best = np.full(len(g.ids), np.iinfo(np.int64).max)
        first = np.full(len(g.ids), -1)
        times = np.zeros(len(g.ids), np.int64)

        def offer(i, j, differ):
            times[j] += 1
            nearer = differ < best[j]
            j = j[nearer]
            best[j], first[j] = differ[nearer], (i[nearer] if isinstance(i, np.ndarray) else i)

        for i, j, differ in g.small_pairs():
            offer(i, j, differ)
        for lo, hi in g.large:
            for i in range(lo, hi - 1):
                js = np.arange(i + 1, hi)
                ok, differ = g.near(np.full(len(js), i), js)
                offer(i, js[ok], differ[ok])
        more = set(g.grp[times > 1].tolist())
        j = np.flatnonzero(first >= 0)
        pairs = {(int(a), int(b)): int(d) for a, b, d in zip(g.ids[first[j]], g.ids[j], best[j])}
        rows = [(a, b, d, None) for (a, b), d in pairs.items()] + [(None, None, None, x) for x in more]
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "differ", "grp"))})

    return run


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a group in different components that may link. Sets of a large group's largest component need no turn of their own."""
        g = _Members(table, percent)
        pairs: set[tuple[int, int]] = set()
        for i, j, _ in g.small_pairs():
            pairs.update(zip(g.ids[i].tolist(), g.ids[j].tolist()))
        for lo, hi in g.large:
            _, comp, size = np.unique(g.component[lo:hi], return_inverse=True, return_counts=True)
            place = np.argsort(np.argsort(size, kind="stable"))[comp]  # components by size; a pair is the smaller one's
            for i in np.flatnonzero(place < place.max()):
                js = lo + np.flatnonzero(place > place[i])
                js = js[g.possible(np.full(len(js), lo + i), js)]
                pairs.update((min(x, y), max(x, y)) for x, y in zip([int(g.ids[lo + i])] * len(js), g.ids[js].tolist()))
        return pa.table({c: pa.array([r[k] for r in pairs], pa.int64()) for k, c in enumerate(("a", "b"))})

    return run


def _across_tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Like ``_across`` for one tile of a paged group: sets outside its largest component (role 0) against a page of all its sets."""
        g = _Members(table, percent)
        role, minor = table["role"].to_numpy()[g.order], table["minor"].to_numpy(zero_copy_only=False)[g.order]
        all_of = np.flatnonzero(role == 1)
        pairs: set[tuple[int, int]] = set()
        for i in np.flatnonzero(role == 0):
            js = all_of[(g.component[all_of] != g.component[i]) & (~minor[all_of] | (g.ids[all_of] > g.ids[i]))]
            js = js[g.possible(np.full(len(js), i), js)]
            pairs.update((min(x, y), max(x, y)) for x, y in zip([int(g.ids[i])] * len(js), g.ids[js].tolist()))
        return pa.table({c: pa.array([r[k] for r in pairs], pa.int64()) for k, c in enumerate(("a", "b"))})

    return run


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Possible pairs across components of paged groups: rows (grp, id, n, component, sketch)."""
    per = rows.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("m"))
    cells = lambda m: F.greatest(F.lit(1), F.ceil(m / F.lit(PAGE))).cast("long")
    stats = per.groupBy("grp").agg(F.max_by("component", F.struct("m", "component")).alias("top"), cells(F.sum("m")).alias("b"), cells(F.sum("m") - F.max("m")).alias("a"))
    sized = rows.join(stats, "grp").withColumn("minor", F.col("component") != F.col("top"))
    own = ("id", "n", "component", "sketch", "minor")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized.filter("minor").select("grp", F.pmod(F.xxhash64("id"), "a").alias("ca"), span("b").alias("cb"), F.lit(0).alias("role"), *own)
    right = sized.select("grp", span("a").alias("ca"), F.pmod(F.xxhash64("id", F.lit(7)), "b").alias("cb"), F.lit(1).alias("role"), *own)
    return left.unionByName(right).groupBy("grp", "ca", "cb").applyInArrow(_across_tile(percent), "a long, b long")


def _verify_tile(width: int, percent: int):
    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and pairs.num_rows:
            sets = dict(zip(texts["id"].to_pylist(), shingle_sets(*X.bytes_of(texts["text"]), width)))
            out = [(p["a"], p["b"]) for row in pairs["pairs"].to_pylist() for p in row if p["a"] in sets and p["b"] in sets and _link(sets[p["a"]], sets[p["b"]], percent)]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _verify_many(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Like ``_verify`` for pairs that are dense among few sets: each text goes once to every tile of its pair component that has
    pairs of it, where a component of m sets has cells of about TILE sets and a tile is a pair of cells."""
    comp = components(pairs)
    size = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("long").alias("cells"))
    cell = comp.join(size, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("cells")).alias("cell"))
    key = ("component", "lo", "hi")
    tiled = (pairs.join(cell.select(F.col("id").alias("a"), "component", F.col("cell").alias("ca")), "a").join(cell.select(F.col("id").alias("b"), F.col("cell").alias("cb")), "b")
             .select("component", F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"), "a", "b"))
    tiled = checkpoint(tiled.groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("pairs")))  # TILE * TILE pairs at most
    ends = tiled.select(*key, F.explode("pairs").alias("p")).select(*key, F.explode(F.array("p.a", "p.b")).alias("id"))
    wanted = checkpoint(ends.distinct())
    sent = _texts_of(texts, wanted).distinct().join(wanted, "id").select(*key, "id", "text")
    found = checkpoint(sent.groupBy(*key).cogroup(tiled.groupBy(*key)).applyInArrow(_verify_tile(width, percent), "a long, b long").distinct())
    discard(tiled, wanted, comp)
    return found


def describe_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts by doc and id, each one's size and sketches, one row for each different set, links between documents of equal sets)."""
    doc = col(id_col).cast("long")
    rows = docs.select(doc.alias("doc"), F.when(doc.isNotNull(), F.xxhash64(doc, col(text_col))).alias("id"), col(text_col).alias("text"))
    told = checkpoint(rows.mapInArrow(_describe(width), "doc long, id long, n long, h1 long, h2 long, sketch binary, fine binary"))
    full = told.filter("n > 0 and id is not null")
    name = F.col("h1").bitwiseAND(F.lit((1 << 8 * NAME) - 1)).alias("name")  # sets of one name are all members of its groups
    sets = checkpoint(full.groupBy("h1", "h2").agg(F.min(F.struct("id", "doc", "n", "sketch", "fine")).alias("r"), F.min("doc").alias("doc")).select(name, "h1", "h2", F.col("r.id").alias("rep"), "doc", "r.n", "r.sketch", "r.fine"))
    equal = full.join(sets.select("h1", "h2", F.col("doc").alias("least")), ["h1", "h2"]).filter("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b")).distinct()
    return rows, told, sets, equal


def distinct_groups(met: DataFrame) -> DataFrame:
    """Groups of names (sig null), or pages of a group (sig), each one once."""
    return checkpoint(met.groupBy(F.xxhash64("members").alias("unit"), F.col("sig")).agg(F.first("members").alias("members")).select("unit", F.coalesce("sig", "unit").alias("grp"), F.col("sig").isNotNull().alias("paged"), "members"))


def linked_classes(rows: DataFrame, told: DataFrame, sets: DataFrame, equal: DataFrame, groups: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """Steps 3 to 5: (doc, n, component) from groups of sets, within which every link is found by exact verification."""
    # each set against the nearest one of its groups that it may link with
    bucket = lambda c: F.pmod(c, F.lit(buckets)).alias("bucket")
    member = groups.select("unit", "grp", "paged", F.explode("members").alias("name"))
    named = member.join(sets, "name").select(bucket("unit"), F.col("unit").alias("grp"), F.col("rep").alias("id"), "n", "sketch")
    told_pairs = checkpoint(named.groupBy("bucket").applyInArrow(_leaders(percent), "a long, b long, differ long, grp long"))
    pairs = checkpoint(told_pairs.filter("a is not null").groupBy("a", "b").agg(F.min("differ").alias("differ")))
    first = pairs.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("r")).select("r.a", "b")
    one = rows.filter("id is not null").select("id", "text")  # has the text of every id that stands for a set
    linked = _verify(one, first, width, percent)
    found = components(linked)
    # what that leaves open: paged groups, and groups with further possible pairs, that hold several components
    open_units = told_pairs.filter("grp is not null").select(F.col("grp").alias("unit")).distinct()
    left_open = member.filter("not paged").join(open_units, "unit", "left_semi").unionByName(member.filter("paged").dropDuplicates(["grp", "name"]))
    # (ids alone are joined here; sketches come to the few groups that are left)
    placed = (left_open.join(sets.select("name", F.col("rep").alias("id")), "name").select("grp", "paged", "id")
              .join(found, "id", "left").select("grp", "paged", "id", F.coalesce("component", "id").alias("component")))
    mixed = placed.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("grp")
    rows_left = checkpoint(placed.join(mixed, "grp", "left_semi").join(sets.select(F.col("rep").alias("id"), "n", F.col("fine").alias("sketch")), "id"))
    own = ("grp", "id", "n", "component", "sketch")
    small = rows_left.filter("not paged").select(bucket("grp"), *own).groupBy("bucket").applyInArrow(_across(percent), "a long, b long")
    second = small.unionByName(_tiles(rows_left.filter("paged").select(*own), percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # and the other pairs of step 3, where they still stand between two components
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    asked = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = checkpoint(second.union(rest).distinct().join(asked, ["a", "b"], "left_anti"))
    discard(groups, told_pairs, pairs, rows_left, found)
    links = [linked] if second.isEmpty() else [linked, _verify_many(one, second, width, percent)]
    # from sets to the ids that hold them: here an id's sets become one node
    ids = lambda c: sets.select(F.col("rep").alias(c), F.col("doc").alias(f"d{c}"))
    named_links = [x.join(ids("a"), "a").join(ids("b"), "b").select(F.col("da").alias("a"), F.col("db").alias("b")) for x in links]
    edges = named_links[0] if len(links) == 1 else named_links[0].unionByName(named_links[1])
    every = components(edges.unionByName(equal))
    discard(second, sets, *links)
    return told.join(every.withColumnRenamed("id", "doc"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per text: id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included)."""
    _, size = text_bytes(docs, "`" + text_col + "`")
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows, told, sets, equal = describe_sets(docs, id_col, text_col, width)
    met = rows.select("id", "text").mapInArrow(_send(width, percent, buckets), "bucket int, entries binary").groupBy("bucket").applyInArrow(_meet(PAGE, CHUNK), "sig long, members array<long>")
    out = linked_classes(rows, told, sets, equal, distinct_groups(met), buckets, width, percent)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One text of each class of near duplicates: the one with the smallest id. Rows with a null id stay."""
    classes = near_duplicates(docs, id_col, **options)
    gone = classes.filter(F.col("component_id") < col(id_col)).select(col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[col(c) for c in docs.columns])

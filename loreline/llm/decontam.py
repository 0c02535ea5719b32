"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity.

Benchmark items become bags of weighted shingles and 64-bit SimHash fingerprints. Every run of words of a text that is as long as some item
is a window, at every start. Windows in which the shingles of items of that length hold less than ``similarity`` of the weight cannot
reach it with any of them; running sums over the text tell them, and they are not fingerprinted. Of every other window the multi-index gives
the items of its length whose fingerprint lies within ``RADIUS`` bits: the fingerprint is cut into ``PARTS`` blocks, a pair within the
radius differs by at most RADIUS // PARTS bits in some block, and each block is probed with all values so near, so none within the
radius is missed. Candidates are verified exactly: weighted Jaccard of shingle bags (weight: rarity among the items) of at least
``similarity``. At a similarity of 0.8 two fingerprints differ by 9.7 bits in the mean with a deviation of 2.9, so the radius holds
99.9 % of the pairs at the threshold, and more above it.

The index is broadcast in blocks of at most about ``BLOCK_ITEMS`` items (about 1 kB each); texts are mapped once for each, without a shuffle.
Weights are the same however items are dealt to blocks: a shingle of one item weighs as much as one of none, and those that several items have
(a small share: phrases of templates) go with every block.

Defined cases: words are runs of letters and digits, ASCII case folded; items or texts with fewer words than a shingle count as one
shingle of all their words; a text shorter than an item is one window for it; null or empty items and texts match nothing; null ids pass
through as null; repeated rows and items each give their matches; ties between windows go to the first, then the shortest; memory
follows the longest text and twice the longest item, not their product; other columns are ignored, or kept by ``drop_contaminated``
whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm import _text as X
from loreline.llm._frames import col

SHINGLE, SIMILARITY = 5, 0.8
BITS, PARTS, RADIUS = 64, 5, 19
BLOCK_ITEMS = 50_000
PROBED = 4096  # windows probed at once
WINDOWS = 1 << 16  # windows that are looked at together
VOTE_ROWS = 1 << 15  # shingles whose running votes are held at a time
PAIR_ROWS = 1 << 20  # shingles of pairs that are compared at a time
MANY = 1 << 16  # shingles in all windows of an item from which on those that cannot be the best are told first
_SALT = X.U(0x94D049BB133111EB)


def _shingles(data, words: X.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hash at every word position, and whether it stays inside its text. A short text has one shingle, of all its words."""
    hashes = X.hash_words(data, words, X.LOWER)
    out = np.zeros(len(hashes), X.U)
    ok = np.zeros(len(hashes), bool)
    rolled = X.mix(X.roll(hashes, width))
    if len(rolled):
        inside = words.text[:len(rolled)] == words.text[width - 1:]
        out[:len(rolled)], ok[:len(rolled)] = rolled, inside
    count = np.diff(words.first)
    for t in np.flatnonzero((count > 0) & (count < width)):
        a, b = words.first[t], words.first[t + 1]
        out[a] = X.mix(X.roll(hashes[a:b], b - a))[0] ^ X.U(b - a)
        ok[a] = True
    return out, ok


def fingerprints(shingles: np.ndarray, votes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weighted SimHash of each run shingles[first[i]:first[i] + count[i]] (none empty; begins and ends do not fall).

    The votes of a run are a difference of running sums, 64 of them whatever its length. Votes are whole numbers, so sums are exact; at most about
    ``VOTE_ROWS`` of them, or twice the longest run, are held at a time.
    """
    out = np.empty((len(first), 8), np.uint8)
    end = first + count
    room = max(VOTE_ROWS, 2 * int(count.max(initial=0)))
    at = 0
    while at < len(first):
        lo = first[at]
        stop = max(at + 1, int(np.searchsorted(end, lo + room, "right")))
        hi = end[stop - 1]
        bits = np.unpackbits(X.mix(shingles[lo:hi] ^ _SALT).view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((hi - lo + 1, BITS), np.int64)
        np.cumsum(np.where(bits, votes[lo:hi, None], -votes[lo:hi, None]), axis=0, out=sums[1:])
        out[at:stop] = np.packbits(sums[end[at:stop] - lo] > sums[first[at:stop] - lo], axis=1)
        at = stop
    return out.view(X.U).ravel()


class Shingles:
    """Known shingles with their weights: 1 + log(items / items that hold it). One that stands in a single item weighs as much as an unknown one."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, items: int):
        order = np.argsort(hashes)
        self.known, self.df, self.items = hashes[order], df[order], items
        self.idf = 1 + np.log(items / self.df)
        self.rare = 1 + np.log(max(items, 1))
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.known >> X.U(44)).astype(np.int64)] = True

    def find(self, shingles: np.ndarray) -> np.ndarray:
        """Place among the known shingles, -1 for others."""
        out = np.full(len(shingles), -1)
        at = np.flatnonzero(self.gate[(shingles >> X.U(44)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            out[at] = np.where(self.known[k] == shingles[at], k, -1)
        return out

    def weight(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.idf[place], self.rare) if len(self.idf) else np.full(len(place), self.rare)

    def votes(self, place: np.ndarray) -> np.ndarray:
        return np.round(self.weight(place) * (1 << 16)).astype(np.int64)

    def joined(self, hashes: np.ndarray) -> Shingles:
        """These and other shingles, of which each stands in one item."""
        more = np.setdiff1d(hashes, self.known)
        return Shingles(np.concatenate([self.known, more]), np.concatenate([self.df, np.ones(len(more), self.df.dtype)]), self.items)


def hashes_of(texts: list[str] | pa.Array, width: int) -> tuple[np.ndarray, X.Words, np.ndarray]:
    """Shingle hashes of texts, their words, and which hashes count."""
    data, offsets = X.bytes_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    words = X.split_words(data, offsets, X.NOT_ALNUM)
    hashes, ok = _shingles(data, words, width)
    return hashes, words, ok


def shingles_of(texts: list[str], width: int) -> Shingles:
    hashes, words, ok = hashes_of(texts, width)
    pair = np.unique(np.stack([words.text[ok].astype(X.U), hashes[ok]]), axis=1)
    known, df = np.unique(pair[1], return_counts=True)
    return Shingles(known, df, len(np.unique(words.text[ok])))


class Index:
    """Items of one block and the multi-index over their fingerprints.

    ``shared`` holds the shingles that several of all items have (default: all of these items'); ``every`` is that and the block's own.
    """

    def __init__(self, item_ids: list, texts: list[str], shingle: int = SHINGLE, parts: int = PARTS, radius: int = RADIUS, shared: Shingles | None = None):
        hashes, words, ok = hashes_of(texts, shingle)
        text = words.text[ok]
        keep = np.unique(text)
        self.ids = [item_ids[i] for i in keep]
        self.shingle, self.radius = shingle, radius
        self.begin = np.searchsorted(np.searchsorted(keep, text), np.arange(len(keep) + 1))
        self.bag = hashes[ok]
        self.length = np.diff(words.first)[keep]
        self.sizes = np.unique(self.length)
        if not len(keep):
            return
        self.every = every = shared.joined(self.bag) if shared is not None else shingles_of(texts, shingle)
        self.place = every.find(self.bag)
        size_of = np.repeat(self.length, np.diff(self.begin))
        self.of_size = [np.unique(self.place[size_of == n]) for n in self.sizes]  # the shingles of items of each length
        self.print = fingerprints(self.bag, every.votes(self.place), self.begin[:-1], np.diff(self.begin))
        # items by block and value; blocks are runs of bits of nearly equal width
        edge = np.linspace(0, BITS, parts + 1).astype(int)
        self.blocks = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            width = int(hi - lo)
            value = self._value(self.print, lo, width)
            order = np.argsort(value, kind="stable")
            flips = np.array([sum(1 << b for b in c) for r in range(radius // parts + 1) for c in itertools.combinations(range(width), r)], np.int64)
            self.blocks.append((lo, width, np.searchsorted(value[order], np.arange((1 << width) + 1)), order, flips))

    @staticmethod
    def _value(prints: np.ndarray, lo: int, width: int) -> np.ndarray:
        return ((prints >> X.U(lo)) & X.U((1 << width) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius; with ``length`` only items of a window's length."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(prints), PROBED):
            own = prints[at:at + PROBED]
            for lo, width, begin, order, flips in self.blocks:
                value = self._value(own, lo, width)[:, None] ^ flips[None, :]
                count = begin[value + 1] - begin[value]
                row, flip = np.nonzero(count)
                n, first = count[row, flip], begin[value[row, flip]]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                window, item = np.repeat(row, n), order[np.repeat(first, n) + inside]
                near = np.bitwise_count(own[window] ^ self.print[item]) <= self.radius
                if length is not None:
                    near &= self.length[item] == length[at + window]
                found.append((at + window[near]) * len(self.ids) + item[near])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)


def _bags(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (pair, place) codes with their counts, sorted."""
    return np.unique((pair << 33) | (place + 1), return_counts=True)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of runs that begin at ``first``."""
    return np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def similarities(index: Index, place: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard of the bags of windows (runs of ``place``) and items, pair by pair, ``PAIR_ROWS`` shingles at a time."""
    its = np.diff(index.begin)[item]
    done = np.cumsum(size + its)
    out, at = [np.zeros(0)], 0
    while at < len(item):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIR_ROWS, "right")))
        n, mine, own = stop - at, size[at:stop], its[at:stop]
        a, b = place[_spread(start[at:stop], mine)], index.place[_spread(index.begin[:-1][item[at:stop]], own)]
        of_a, of_b = np.repeat(np.arange(n), mine), np.repeat(np.arange(n), own)
        total = np.bincount(of_a, index.every.weight(a), n) + np.bincount(of_b, index.every.weight(b), n)
        (ka, na), (kb, nb) = _bags(of_a[a >= 0], a[a >= 0]), _bags(of_b, b)  # unknown shingles are in no item
        both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        low = np.bincount(both >> 33, np.minimum(na[ia], nb[ib]) * index.every.weight((both & ((1 << 33) - 1)) - 1), n)
        out.append(low / np.maximum(total - low, 1e-12))
        at = stop
    return np.concatenate(out)


def sliding(index: Index, place: np.ndarray, start: np.ndarray, size: int, item: int) -> np.ndarray:
    """Weighted Jaccard of one item and many windows of ``size`` shingles (ascending starts), in time linear in the words they span.

    A shingle that the item has c times counts at a position unless c others of its kind stand before it in the window: it counts for the windows
    that begin after the c-th one before it, which is one interval of starts.
    """
    own, times = np.unique(index.place[index.begin[item]:index.begin[item + 1]], return_counts=True)
    lo, hi = int(start[0]), int(start[-1])
    span = place[lo:hi + size]
    weight = index.every.weight(span)
    at = np.minimum(np.searchsorted(own, span), len(own) - 1)
    pos = np.flatnonzero(own[at] == span)
    kind = at[pos]
    order = np.argsort(kind, kind="stable")
    pos, kind = pos[order], kind[order]
    back = np.arange(len(pos)) - times[kind]
    earlier = np.maximum(back, 0)
    same = (back >= 0) & (kind[earlier] == kind)
    left = np.maximum(np.where(same, pos[earlier] + 1, 0), pos - size + 1)
    right = np.minimum(pos, hi - lo)
    ok = left <= right
    change = np.bincount(left[ok], weight[pos[ok]], hi - lo + 2) - np.bincount(right[ok] + 1, weight[pos[ok]], hi - lo + 2)
    low = np.cumsum(change)[start - lo]
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    total = sums[start - lo + size] - sums[start - lo] + float((index.every.weight(own) * times).sum())
    return low / np.maximum(total - low, 1e-12)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the intervals low .. high, once; both ascend."""
    if not len(low):
        return np.zeros(0, np.int64)
    fresh = np.concatenate([[True], low[1:] > high[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(low)) - 1
    return _spread(low[first], high[last] - low[first] + 1)


def windows_of(index: Index, words: X.Words, place: np.ndarray, ok: np.ndarray, similarity: float):
    """For each length of items (words), the starts of windows in which shingles of items of that length have enough of the weight."""
    known = np.flatnonzero(place >= 0)
    if not len(known):
        return
    weight = np.where(ok, index.every.weight(place), 0.0)
    total = np.concatenate([[0.0], np.cumsum(weight)])
    count = np.diff(words.first)
    for size, own in zip(index.sizes, index.of_size):
        mine = known[np.isin(place[known], own)]
        if not len(mine):
            continue
        told = np.concatenate([[0.0], np.cumsum(weight[mine])])
        # starts from which the window reaches such a shingle, kept inside the text
        text = words.text[mine]
        low, high = words.first[text], np.maximum(words.first[text + 1] - size, words.first[text])
        start = _ranges(np.clip(mine - size + 1, low, high), np.clip(mine, low, high))
        stop = start + np.maximum(np.minimum(size, count[words.text[start]]) - index.shingle + 1, 1)
        inside = told[np.searchsorted(mine, stop)] - told[np.searchsorted(mine, start)]
        good = (inside > 0) & (inside >= (similarity - 1e-9) * (total[stop] - total[start]))
        if good.any():
            yield int(size), start[good]


def _best(found: list[np.ndarray]) -> list[np.ndarray]:
    """The best window of each text and item: rows (text, item, similarity, start, words, distance)."""
    text, item, same, start, size, _ = found
    order = np.lexsort((size, start, -same.round(12), item, text))
    first = np.ones(len(order), bool)
    first[1:] = (text[order][1:] != text[order][:-1]) | (item[order][1:] != item[order][:-1])
    return [x[order[first]] for x in found]


def matches_in(index: Index, data, offsets, similarity: float) -> list[tuple]:
    """(text, item, similarity, first word, words, Hamming distance) of the best window of each pair in a batch."""
    words = X.split_words(data, offsets, X.NOT_ALNUM)
    hashes, ok = _shingles(data, words, index.shingle)
    place = np.where(ok, index.every.find(hashes), -1)
    votes = index.every.votes(place)
    count = np.diff(words.first)
    best = [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64, np.int64)]
    for length, starts in windows_of(index, words, place, ok, similarity):
        for at in range(0, len(starts), WINDOWS):
            start = starts[at:at + WINDOWS]
            size = np.minimum(length, count[words.text[start]])
            n = np.maximum(size - index.shingle + 1, 1)
            prints = fingerprints(hashes, votes, start, n)
            window, item = index.candidates(prints, np.full(len(start), length))
            keep = _promising(index, place, words.text, start, n, window, item, similarity)
            window, item = window[keep], item[keep]
            same = similarities(index, place, start[window], n[window], item)
            good = same >= similarity
            window, item, same = window[good], item[good], same[good]
            rows = [words.text[start[window]], item, same, start[window], size[window], np.bitwise_count(prints[window] ^ index.print[item]).astype(np.int64)]
            best = _best([np.concatenate(x) for x in zip(best, rows)])
    text, item, same, start, size, distance = best
    return list(zip(text.tolist(), item.tolist(), same.tolist(), (start - words.first[text]).tolist(), size.tolist(), distance.tolist()))


def _promising(index: Index, place, text, start, n, window, item, similarity: float) -> np.ndarray:
    """Pairs worth an exact look: all but those of an item with very many windows that another window of their text beats, or that miss the similarity."""
    keep = np.ones(len(window), bool)
    order = np.lexsort((window, item))
    begin = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(begin, np.append(begin[1:], len(order))):
        of = order[a:b]
        own = start[window[of]]
        if int(n[window[of]].sum()) < MANY:
            continue
        for size in np.unique(n[window[of]]):
            mine = of[n[window[of]] == size]
            own = start[window[mine]]
            cut = np.flatnonzero(np.diff(own) > size) + 1  # stretches that share no word
            same = np.concatenate([sliding(index, place, part, int(size), int(item[mine[0]])) for part in np.split(own, cut)])
            _, whose = np.unique(text[own], return_inverse=True)
            top = np.zeros(whose.max() + 1)
            np.maximum.at(top, whose, same)
            keep[mine] = same >= np.maximum(top[whose], similarity) - 1e-6
    return keep


def _shared_shingles(rows: DataFrame, shingle: int) -> Shingles:
    """The shingles that several items have, with the number of items that hold each, counted in Spark."""

    def run(batches):
        for b in X.slices(batches, "text"):
            hashes, words, ok = hashes_of(b.column("text"), shingle)
            pair = np.unique(np.stack([words.text[ok].astype(X.U), hashes[ok]]), axis=1)
            yield pa.record_batch({"hash": pa.array(pair[1].view(np.int64)), "first": pa.array(np.concatenate([[True], pair[0][1:] != pair[0][:-1]])[:pair.shape[1]])})

    told = rows.select("text").mapInArrow(run, "hash long, first boolean")
    items = told.agg(F.count_if("first")).first()[0]
    several = told.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").toArrow()
    return Shingles(several["hash"].to_numpy().view(X.U), several["df"].to_numpy(), int(items))


def _indexes(items: DataFrame, item_id_col: str, item_text_col: str, shingle: int, radius: int):
    """Broadcast indexes over blocks of at most about BLOCK_ITEMS items, with their own shingles and those that several items have."""
    spark = items.sparkSession
    rows = items.select(col(item_id_col).cast("long").alias("item"), col(item_text_col).alias("text")).filter("text is not null")
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    shared = _shared_shingles(rows, shingle)
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        index = Index(part["item"].to_pylist(), part["text"].to_pylist(), shingle, PARTS, radius, shared)
        if index.ids:
            yield spark.sparkContext.broadcast(index)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Pairs of a text and a benchmark item it holds: id, item id, similarity, start_word, n_words, distance (bits)."""
    named = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    schema = "id long, item long, similarity double, start_word long, n_words long, distance int"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _indexes(items, item_id_col, item_text_col, shingle, radius):

        def run(batches, shared=shared):
            index = shared.value
            for b in X.slices(batches, "text"):
                found = matches_in(index, *X.bytes_of(b.column("text")), similarity)
                ids = b.column("id")
                yield pa.record_batch({"id": ids.take(pa.array([f[0] for f in found], pa.int64())), "item": pa.array([index.ids[f[1]] for f in found], pa.int64()), "similarity": pa.array([f[2] for f in found], pa.float64()), "start_word": pa.array([f[3] for f in found], pa.int64()), "n_words": pa.array([f[4] for f in found], pa.int64()), "distance": pa.array([f[5] for f in found], pa.int32())})

        out = out.unionByName(named.mapInArrow(run, schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "similarity", "start_word", "n_words", "distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns: one map, no join back."""
    out = docs
    for shared in _indexes(items, item_id_col, item_text_col, shingle, radius):

        def run(batches, shared=shared):
            for b in X.slices(batches, text_col):
                hit = np.zeros(b.num_rows, bool)
                hit[[f[0] for f in matches_in(shared.value, *X.bytes_of(b.column(text_col)), similarity)]] = True
                yield b.filter(pa.array(~hit))

        out = out.mapInArrow(run, out.schema)
    return out

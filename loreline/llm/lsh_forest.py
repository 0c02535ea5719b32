"""Near duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

A text's set holds its different ``width``-word shingles. Each of ``TREES`` trees orders all sets by a signature of its own, a string of ``MOST``
MinHashes. Sets that are neighbours in that order share a long prefix, and two sets of Jaccard J share d MinHashes with chance J^d.

1. One map over the texts describes the sets; equal sets meet in one representative (map-side aggregated).
2. One map sends an entry of a set for each tree to the bucket of its first ``LEAST`` MinHashes: the rest of the signature, and one bit of
   each of 32 MinHashes of other trees. Copies of a set within a task send once.
3. A bucket sorts its entries by signature. A region is a run of entries with a common prefix; it starts at depth ``LEAST`` and is
   extended by one MinHash, up to ``MOST``, as long as it holds more than ``REGION`` sets: dense regions are told apart deeper than sparse ones.
   Neighbours of a region are candidates if at most ``DIFFER`` of their 32 bits differ. A region of more than ``PAGE`` sets at full depth is
   not looked at pair by pair but leaves, as it arrives, in pages that share their first set.
4. What region by region may link is verified exactly, as in the similarity join: each set against its nearest candidate, then pairs that
   still stand in different components (pages in tiles), without a bound on partners.

A pair at J = 0.8 shares a region of depth d in a tree with chance 0.8^d, and passes the bits with 0.987; by all 40 trees it is missed with
chance below 2e-7 where regions end at depth 5 or before and 7e-6 where all regions around it are dense down to depth 6.

Defined cases: those of ``jaccard_join``: ASCII case folded; fewer words than ``width`` make one shingle of all words; no words or null text: an
empty set, linked with nothing; null ids: linked with nothing, component null, kept; repeated ids are one node with several
sets, exactly repeated rows one set; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm import _text as X
from loreline.llm._frames import text_bytes
from loreline.llm.jaccard_join import CHUNK, PAGE, _set_key, describe_sets, distinct_groups, linked_classes, shingle_sets

WIDTH, PERCENT = 2, 80
TREES, LEAST, MOST = 40, 2, 6
REGION = 64  # sets up to which a region is not extended
DIFFER = 7  # of 32 bits, at J = 0.8: 3.2 on average
KEY, BITS, NAME = 4, 4, 5  # bytes of the first MinHashes, of the bits and of a set's name that travel
ENTRY = KEY + (MOST - LEAST) + BITS + NAME
BUCKET_BYTES = 6 << 20  # text of a bucket up to LARGE of it; beyond, buckets grow with the square root
LARGE = 32 << 30
BLOCK = 1 << 16  # shingles that are hashed at once
U = X.U
_SEEDS = X.mix(np.arange(1, 2 * TREES * MOST + 1, dtype=U)).astype(np.uint32)
_FLIP, _ODD = _SEEDS[::2], _SEEDS[1::2] | np.uint32(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(TREES * MOST, sets): the least value of each hash function over each set; no set is empty."""
    out = np.empty((TREES * MOST, len(sets)), np.uint32)
    size = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BLOCK, "right")) + at)
        x = (np.concatenate(sets[at:stop]) >> U(32)).astype(np.uint32)
        begin = np.cumsum(size[at:stop]) - size[at:stop]
        for k in range(TREES * MOST):
            out[k, at:stop] = np.minimum.reduceat((x ^ _FLIP[k]) * _ODD[k], begin)
        at = stop
    return out


def signatures(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tree and set: key of the first MinHashes, a byte of each further one (as one number, first one highest), 32 bits."""
    n = hashes.shape[1]
    mixed = X.mix(hashes.astype(U) ^ (np.arange(TREES * MOST, dtype=U) << U(32))[:, None])
    parts = mixed.reshape(TREES, MOST, n)
    key = np.zeros((TREES, n), U)
    for j in range(LEAST):
        key = X.mix(key ^ parts[:, j])
    tail = np.zeros((TREES, n), U)
    for j in range(LEAST, MOST):
        tail = tail << U(8) | parts[:, j] >> U(56)
    one = (mixed >> U(20)).astype(np.uint32) & np.uint32(1)
    bits = np.zeros((TREES, n), np.uint32)
    for j in range(32):  # of the trees after this one
        bits |= np.roll(one, -(MOST + j), axis=0)[::MOST] << np.uint32(j)
    return key, tail, bits


def _send(width: int, buckets: int):
    def run(batches):
        sent: set[tuple[int, int]] = set()  # the sets of this task: copies send once
        for b in X.slices(batches, "text"):
            names, sets = [], []
            for i, s in zip(b.column("id").to_pylist(), shingle_sets(*X.bytes_of(b.column("text")), width)):
                if len(s) and i is not None and (key := _set_key(s)) not in sent:
                    sent.add(key)
                    names.append(key[0])
                    sets.append(s)
            if not sets:
                continue
            key, tail, bits = (x.reshape(-1) for x in signatures(minhashes(sets)))
            order = np.argsort(key)
            key, tail, bits, name = key[order], tail[order], bits[order], np.tile(np.array(names, np.int64).astype(U), TREES)[order]
            cut = np.searchsorted(((key >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))
            some = np.flatnonzero(np.diff(cut))
            pack = lambda a, z: X.planes(key[a:z], KEY) + X.planes(tail[a:z], MOST - LEAST) + X.planes(bits[a:z], BITS) + X.planes(name[a:z], NAME)
            yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "entries": pa.array([pack(cut[k], cut[k + 1]) for k in some], pa.binary())})

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature: key and further MinHashes as one number, bits, name)."""
    n = len(raw) // ENTRY
    out, at = [], 0
    for width in (KEY, MOST - LEAST, BITS, NAME):
        out.append(X.unplanes(raw[at:at + n * width], n, width))
        at += n * width
    return out[0] << U(8 * (MOST - LEAST)) | out[1], out[2].astype(np.uint32), out[3].astype(np.int64)


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(value)))


def regions(signature: np.ndarray, most: int) -> np.ndarray:
    """(begin, end) rows of the regions of sorted signatures, of adaptive depth, that hold two sets or more."""
    found, open_ = [], np.ones(len(signature), bool)
    for depth in range(LEAST, MOST + 1):
        begin, size = _runs(signature >> U(8 * (MOST - depth)))  # regions nest: an open one is cut again a level deeper
        done = open_[begin] & ((size <= most) | (depth == MOST))
        found.append(np.stack([begin[done], (begin + size)[done]], axis=1))
        open_ &= ~np.repeat(done, size)
    out = np.concatenate(found)
    return out[out[:, 1] - out[:, 0] > 1]


def candidates(bits: np.ndarray, spans: np.ndarray, differ: int = DIFFER) -> np.ndarray:
    """Mask of the entries that have a candidate in their own region."""
    hit = np.zeros(len(bits), bool)
    until = np.arange(len(bits))  # the end of each entry's region
    for lo, hi in spans:
        until[lo:hi] = hi
    at = np.flatnonzero(until > np.arange(len(bits)) + 1)
    d = 1
    while len(at):
        close = np.bitwise_count(bits[at] ^ bits[at + d]) <= differ
        hit[at[close]] = True
        hit[at[close] + d] = True
        d += 1
        at = at[at + d < until[at]]
    return hit


def _meet(page: int, chunk: int, region: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of every region of one bucket, equal groups once; regions of more than ``page`` sets at full depth in pages with ``sig``."""
        bucket = key[0].as_py()
        value, bits, name = np.zeros(0, U), np.zeros(0, np.uint32), np.zeros(0, np.int64)  # what waits for others
        heads: dict[int, int] = {}  # signatures that are paged, with the set that all pages share
        fresh: list[bytes] = []
        pages: list[tuple[int, np.ndarray]] = []

        def absorb():
            nonlocal value, bits, name, fresh
            parts = [_unpack(x) for x in fresh]
            fresh = []
            value, bits, name = (np.concatenate([old, *[p[k] for p in parts]]) for k, old in enumerate((value, bits, name)))
            order = np.lexsort((name, value))
            value, bits, name = value[order], bits[order], name[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (name[1:] != name[:-1])
            value, bits, name = value[new], bits[new], name[new]
            begin, size = _runs(value)
            hot = (size > page) | np.isin(value[begin], np.fromiter(heads, U, len(heads)))
            for a, m in zip(begin[hot], size[hot]):
                head = heads.setdefault(int(value[a]), int(name[a]))
                rest = name[a:a + m][name[a:a + m] != head]
                rest = rest[np.argsort(X.mix(rest.astype(U) ^ value[a]))]  # sets that share several regions meet on a page of some
                pages.extend((int(value[a]), np.append(head, rest[j:j + page])) for j in range(0, len(rest), page))
            wait = ~np.repeat(hot, size)
            value, bits, name = value[wait], bits[wait], name[wait]

        def out(rows):
            return pa.record_batch({"sig": pa.array([None if v is None else int(X.mix(np.array([v, bucket], U)).sum(dtype=U).view(np.int64)) for v, _ in rows], pa.int64()), "members": pa.array([m for _, m in rows], pa.list_(pa.int64()))})

        have = 0
        for b in batches:
            for x in b.column("entries").to_pylist():
                fresh.append(x)
                have += len(x) // ENTRY
                if have >= chunk:
                    absorb()
                    have = 0
                    if pages:
                        yield out(pages)
                        pages.clear()
        absorb()
        # pages have left: what remains of a prefix may hold a paged signature's neighbours, told by the other trees
        spans = regions(value, region)
        hit = candidates(bits, spans)
        groups = {g.tobytes() for lo, hi in spans if len(g := np.sort(name[lo:hi][hit[lo:hi]]))}
        yield out(pages + [(None, np.frombuffer(g, np.int64)) for g in groups])

    return run


def forest_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per text: id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included), kept (it is that one)."""
    _, size = text_bytes(docs, "`" + text_col + "`")
    room = BUCKET_BYTES if size <= LARGE else BUCKET_BYTES * isqrt(size // LARGE)
    buckets = max(1, -(-size // room))
    rows, told, sets, equal = describe_sets(docs, id_col, text_col, width)
    met = rows.select("id", "text").mapInArrow(_send(width, buckets), "bucket int, entries binary").groupBy("bucket").applyInArrow(_meet(PAGE, CHUNK, REGION), "sig long, members array<long>")
    out = linked_classes(rows, told, sets, equal, distinct_groups(met), buckets, width, percent)
    kept = F.coalesce(F.col("component") == F.col("doc"), F.lit(True))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))

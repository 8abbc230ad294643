"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring tokens: positions with 1 are hashed, those
with 0 are ignored, so a seed still hits where a token under a 0 was replaced. All
windows of the benchmark are hashed under each mask, all windows of the documents are
joined to them by hash, and around each hit both texts are laid on one another.
A document is contaminated by an item if on that diagonal it has a stretch of at least
``MIN_OVERLAP`` tokens from an equal one to an equal one, or the whole item (of any length,
substitutions at its ends count like others), of which at least ``MIN_IDENTITY`` are equal.
The overlap is the best run (a match gains 1, a substitution costs 2) if it is such a stretch,
or else the whole item, or else the stretch with most matches, the first on ties.

The benchmark is taken in blocks of bounded size. Each is broadcast, and one pass over the documents
meets all of them: a task holds some documents' tokens and one block at a time. So there is
no shuffle, no limit on either side, and one scan whatever the benchmark's size.

Edge cases: tokens are lower-cased runs of letters, digits and underscores; a null text
has none. Items of fewer tokens than ``SHORTEST``, which no seed fits into, cannot be told from chance inside
a text: they match a document whose tokens are the item's and no others. An item without tokens or
with a null text matches nothing. Repeated items and repeated documents
each give their rows. With several runs between a document and an item the one with most
matches counts, the first on ties. An empty table on either side gives no matches.
Extra columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.text_features import Hashes

MASKS = ("111111", "11011011", "1010110101", "1100110011")
#: Tokens that the shortest seed spans.
SHORTEST = 6
MIN_OVERLAP = 13
MIN_IDENTITY = 0.8
BLOCK_TOKENS = 1_000_000
#: Characters of text that a task holds while it goes through the blocks, if there are several.
HELD = 32 << 20
TABLE_BITS = 22
WORDS = re.compile(r"\w+")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
MIX = np.uint64(0xFF51AFD7ED558CCD)

FOUND = "doc_id long, item_id long, overlap int, matches int, doc_start int, item_start int"


def tokens(text: str | None, hashes: Hashes) -> np.ndarray:
    return hashes.of(WORDS.findall(text.lower())) if text else np.zeros(0, np.uint64)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of all windows under a mask."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(len(mask)))
    if n > 0:
        for odd, j in zip(ODD, (j for j, c in enumerate(mask) if c == "1"), strict=True):
            out += h[j : j + n] * odd
        out = (out ^ (out >> np.uint64(31))) * MIX
    return out


class Block:
    """Seeds of some benchmark items, sorted by hash, with a bit table before them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.short: dict[bytes, list[int]] = {}
        for k, (_, h) in enumerate(items):
            if len(h) < SHORTEST:
                self.short.setdefault(h.tobytes(), []).append(k)
        self.masks = []
        for mask in MASKS:
            found = [seeds(h, mask) for _, h in items]
            hashed = np.concatenate(found) if found else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in found])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found]) if found else np.zeros(0, np.int32)
            order = np.argsort(hashed, kind="stable")
            bits = np.zeros(1 << TABLE_BITS, bool)
            bits[(hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.masks.append((hashed[order], item[order], at[order], bits))

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item number, overlap, matches, start in the text, start in the item) of a text, one for each item."""
        if len(h) < SHORTEST:
            return [(k, len(h), len(h), 0, 0) for k in self.short.get(h.tobytes(), [])]
        diagonals = set()
        for mask, (hashed, item, at, bits) in zip(MASKS, self.masks, strict=True):
            own = seeds(h, mask)
            near = np.flatnonzero(bits[(own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            if not len(near):
                continue
            first = np.searchsorted(hashed, own[near], "left")
            n = np.searchsorted(hashed, own[near], "right") - first
            # a passage that repeats in the text, or in many items, gives each diagonal once
            hit = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            diagonals.update(np.unique((item[hit].astype(np.int64) << 32) + np.repeat(near, n) - at[hit] + (1 << 31)).tolist())
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for k, shift in ((x >> 32, (x & 0xFFFFFFFF) - (1 << 31)) for x in sorted(diagonals)):
            run = best_run(h, self.items[k][1], shift)
            if run and (k not in best or run[1] > best[k][2]):
                best[k] = (k, *run)
        return list(best.values())


def best_run(h: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(overlap, matches, start in the text, start in the item) where text position - item position = shift."""
    low, high = max(0, -shift), min(len(item), len(h) - shift)
    same = h[low + shift : high + shift] == item[low:high]
    if len(item) < SHORTEST or same.sum() < MIN_IDENTITY * min(MIN_OVERLAP, len(item)):
        return None
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    least = np.minimum.accumulate(gain)
    stop = int(np.argmax(gain - least))
    start = int(np.flatnonzero(gain[: stop + 1] == least[stop])[-1]) if stop else 0
    if stop - start < min(MIN_OVERLAP, len(item)) or same[start:stop].sum() < MIN_IDENTITY * (stop - start):
        whole = len(same) == len(item) and same.sum() >= MIN_IDENTITY * len(item)
        found = (0, len(item)) if whole else longest_stretch(same)
        if not found:
            return None
        start, stop = found
    return stop - start, int(same[start:stop].sum()), low + start + shift, low + start


def longest_stretch(same: np.ndarray) -> tuple[int, int] | None:
    """(start, stop) with most matches of the stretches of ``MIN_OVERLAP`` or more between matches that reach ``MIN_IDENTITY``.

    Over a qualifying stretch the surplus of matches does not fall. For each end, the
    first start with a surplus as low is found by halving in the running minimum.
    """
    matches = np.concatenate([[0], np.cumsum(same)])
    surplus = 100 * matches - round(100 * MIN_IDENTITY) * np.arange(len(matches))
    stops = np.flatnonzero(same) + 1
    stops = stops[stops >= MIN_OVERLAP]
    if not len(stops):
        return None
    least = np.minimum.accumulate(np.where(same, surplus[:-1], np.iinfo(np.int64).max))
    starts = np.searchsorted(-least, -surplus[stops], "left")
    fits = stops - starts >= MIN_OVERLAP
    if not fits.any():
        return None
    stops, starts = stops[fits], starts[fits]
    k = int(np.argmax(matches[stops] - matches[starts]))
    return int(starts[k]), int(stops[k])


def blocks(benchmark: DataFrame, most: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark in blocks of about ``most`` tokens, in the order of item_id."""
    hashes, held, n = Hashes(), [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        h = tokens(r["text"], hashes)
        if len(h):
            held.append((r["item_id"], h))
            n += len(h)
        if n >= most:
            yield Block(held)
            held, n = [], 0
    if held:
        yield Block(held)


def shared_blocks(spark: SparkSession, benchmark: DataFrame, most: int) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(block) for block in blocks(benchmark, most)]


def overlaps_of(batches: Iterator[pa.RecordBatch], shared: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Batches with the overlaps of each row: item_id, overlap, matches, starts. Several blocks are read in turn for some batches at a time."""
    hashes, held, size = Hashes(), [], 0

    def met():
        texts = [[tokens(t, hashes) for t in batch.column("text").to_pylist()] for batch in held]
        found = [[[] for _ in x] for x in texts]
        for x in shared:
            block = x.value if len(shared) == 1 else x.load_from_path(x._path)  # not kept, unlike ``value``
            for own, out in zip(texts, found, strict=True):
                for h, rows in zip(own, out, strict=True):
                    rows += [(block.items[r[0]][0], *r[1:]) for r in block.overlaps(h)]
        yield from zip(held, found, strict=True)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(shared) == 1 or size >= HELD:
            yield from met()
            held, size = [], 0
    if held:
        yield from met()


def find(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item that overlap, with the overlap."""
    shared = shared_blocks(docs.sparkSession, benchmark, most)

    def run(batches):
        for batch, found in overlaps_of(batches, shared):
            rows = [(doc_id, *x) for doc_id, xs in zip(batch.column("doc_id").to_pylist(), found, strict=True) for x in xs]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "overlap", "matches", "doc_start", "item_start"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """The documents that no item overlaps, with all their columns."""
    shared = shared_blocks(docs.sparkSession, benchmark, most)

    def run(batches):
        for batch, found in overlaps_of(batches, shared):
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

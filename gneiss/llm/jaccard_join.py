"""N-gram Jaccard join: exact, by universe partition and the pigeonhole principle.

Sets are the distinct five-word shingles of a text, as 64-bit hashes. Two sets link
when intersection / union >= 3/4, so their symmetric difference is at most a seventh
of the sum of their sizes.

Sizes fall into bands. A band has a partition of the universe: each token belongs
to one of its segments by hash. The signature of a segment is a hash of the tokens
that the set has in it. If a set has more non-empty segments than a partner can
differ in, at least one segment is equal in both, and in fact as many as it has more. A set
is indexed in its own band (at home) and as a guest in each higher band that may
hold larger partners.

Bands of small sets may list segments together with their one-deletion neighbourhoods: a
segment then catches one difference, so fewer, larger segments suffice.
``allocation`` chooses the number of segments and between the two ways by their cost.

Tokens in more than ``FREQUENT`` texts (passages that many texts share) cost most,
as all those texts share their signatures. So signatures are made of the other tokens
alone wherever a set has enough of them to satisfy the pigeonhole; such a set probes. Sets
with too few, such as members of large groups of near copies, are found by those that
probe, and among themselves by signatures of all their tokens. Which tokens count as
frequent is decided by a sketch over all texts and only matters for cost.

Sets that share a signature are candidates. Those that share fewer signatures
with all others than a partner must share are left out, and of the others' groups only the
least crowded are needed (the prefix principle). Each set is first compared exactly with
hubs of its groups. Sets around one hub that are then in different components are compared in
cells, by matrix products that count common tokens; pairs in a small group that share no hub
are compared one by one. So no large group of near copies is ever expanded into all its pairs,
and no link between different components is lost. A set for which even all its tokens fill
too few segments (the allocation makes that very rare) is compared by single tokens with all
rows, in blocks.

No task holds all of a group without bound. Signatures whose tokens are all in more than
``HOT`` texts do not meet in a reducer: their entries are dealt by class, and the
signature names the group. Joins on groups and hubs spread large ones over several tasks by a salt
of the class. All sets of a group of more than ``CROWD`` classes that is still split
between components count as around that group's hub, so pairs are only listed in groups
of at most ``CROWD`` classes.

Identical sets are one class from the start: signatures name the class, and a task lists a
class once. Links join classes; components are found by alternating large-star
and small-star steps.

Edge cases: a null or empty text or one without words has an empty set, links with nothing
and is its own component. A text with one to four words has one shingle. A row with a null
doc_id has no name to give: it takes part in no link and its component is null.
Rows that repeat a doc_id are one node. An empty table gives an empty result.
Extra columns are ignored. Hashes have 64 bits; classes are told apart by theirs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.common import discard, materialize, salted_join

SHINGLE = 5
#: Similarity as a ratio of integers.
NUM, DEN = 3, 4
#: Top of a band over its bottom.
BAND_RATIO = 1.5
#: Entries in a reducer's group.
GROUP_ENTRIES = 1_500_000
#: Signatures of a token, roughly; sizes the number of groups.
ENTRIES_PER_TOKEN = 1.0
#: Chance of a set with too few segments, without and with its frequent tokens.
THIN, RARE = 1e-3, 1e-7
#: What a signature of a single token costs beyond others.
SINGLE_COST = 4.0
#: Share of tokens that are still there for signatures when the frequent ones are gone, for sizing.
RARE_TOKENS = 0.7
#: A token is frequent in more texts than this, and than a few times a bucket's mean load; buckets of the sketch that tells.
FREQUENT = 64
LOADS = 4
SKETCH_BITS = 22
#: Hubs with which a set is compared in a round, and rounds.
HUBS = 4
ROUNDS = 2
#: Sets a side of a cell, from and to, and tokens; and the sides into which a hub's sets are cut between these bounds.
CLUSTER_BLOCKS = 100, 1_000
CLUSTER_TOKENS = 500_000
SIDES = 64
#: Texts from which on the entries of a signature are dealt by class, and the crowd that such a group counts as.
HOT = 1 << 20
HOT_CROWD = 1 << 20
#: Classes of a group a task, where a join spreads it; and those from which on a split group's hub stands for it.
SALT_ROWS = 2_000
CROWD = 64
#: Classes that a task remembers, and rows and bytes of text that it holds at a time.
MEMORY = 300_000
ROWS = 1_000
BYTES = 2 << 20
#: Bytes of a word up to which it is hashed together with all others.
LONG = 256
#: Parts in which sketches are summed.
PARTS = 64
#: Links a task in the rounds that find components, where a shuffle has more partitions than they need.
LINKS = 10_000

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
MIX = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
#: The two low bits of ``sig`` are the role: 1 for guests, 2 for those that only are indexed. ``least``: signatures shared with a partner.
ENTRY = np.dtype([("sig", "<u4"), ("least", "<u2"), ("key", "<i8")])
HOT_ENTRY = np.dtype([("g", "<i8"), ("role", "<i4"), ("least", "<i4"), ("key", "<i8")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


# --- sets ------------------------------------------------------------------


WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
KEEP = np.asarray([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some bytes, A-Z as a-z, and where the words begin, counted from 1.

    All words at once, eight bytes of each in a round.
    """
    data = b"\n" + data.lower() + b"\n" * (17 - len(data) % 8)
    inside = WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    cells = np.frombuffer(data, "<u8", len(data) // 8)
    out = length.astype(np.uint64) * ODD[3]
    which, at, left = np.arange(len(start)), start, length
    while len(which):
        cell, low = at >> 3, ((at & 7) << 3).astype(np.uint64)
        part = (cells[cell] >> low) | (cells[cell + 1] << (np.uint64(64) - low))
        h = (out[which] ^ (part & KEEP[np.minimum(left, 8)])) * ODD[1]
        out[which] = h ^ (h >> np.uint64(32))
        more = (left > 8) & (length[which] <= LONG)
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + length[k]], digest_size=8).digest(), "little")
    return out, start


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts in UTF-8, laid end to end, and where each text's begin and end."""
    texts = [t or b"" for t in texts]
    h, start = word_hashes(b"\n".join(texts))
    words = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]) + 1), prepend=0)
    first = np.cumsum(words) - words
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, words > 0)
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(first - at[:-1], n) + np.arange(at[-1])
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    total = np.full(len(h), SHINGLE, np.uint64)
    for j in range(SHINGLE):
        total += padded[j : j + len(h)] * ODD[j]
    out = total[place]
    for d in np.flatnonzero((words > 0) & (words < SHINGLE)).tolist():
        own = h[first[d] : first[d] + words[d]]
        out[at[d]] = np.uint64(len(own)) + np.add.reduce(own * np.asarray(ODD[: len(own)]))
    out = mixed(out)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][n > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def set_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; of an empty set, 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat ^ ODD[0]))])
    size = np.diff(at)
    return np.where(size > 0, mixed(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).astype(np.int64), 0)


def part_of(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets, laid end to end."""
    size = np.diff(at)[which]
    begin = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(at[:-1][which] - begin[:-1], size) + np.arange(begin[-1])], begin


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * DEN >= (len(a) + len(b) - both) * NUM


# --- partition -------------------------------------------------------------


def differences(a: int, b: int) -> int:
    """Most tokens that linked sets of sizes a and b can differ in."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def need(size: int) -> int:
    """Differences that a set's segments must catch, plus one, whatever the partner's size."""
    return differences(size, size * DEN // NUM) + 1


@cache
def bands() -> list[tuple[int, int]]:
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * BAND_RATIO))
        out.append((low, high))
        low = high + 1
    return out


@cache
def band_of(size: int) -> int:
    return next(i for i, (_, high) in enumerate(bands()) if size <= high)


@cache
def shortfall(size: int, segments: int, deletions: bool, need: int) -> float:
    """Probability that a set's listed segments catch fewer than ``need`` differences, plus one each.

    Exact for small sets, tokens falling into segments one by one; normal beyond.
    """
    if size > 100:
        load = size / segments
        p0, p1 = np.exp(-load), load * np.exp(-load)
        mean, square = (p1 + 2 * (1 - p0 - p1), p1 + 4 * (1 - p0 - p1)) if deletions else (1 - p0, 1 - p0)
        z = (segments * mean - need + 0.5) / np.sqrt(max(segments * (square - mean * mean), 1e-9))
        return 0.5 * math.erfc(z / math.sqrt(2))
    # chance of (segments with one token, segments with more)
    state = np.zeros((size + 2, size // 2 + 2))
    state[0, 0] = 1.0
    one, more = np.indices(state.shape)
    for _ in range(size):
        new = state * more / segments
        new[1:] += (state * np.maximum(segments - one - more, 0) / segments)[:-1]
        new[:-1, 1:] += (state * one / segments)[1:, :-1]
        state = new
    capacity = one + (2 if deletions else 1) * more
    return float(state[capacity < need].sum())


@cache
def allocation(band: int) -> tuple[int, bool]:
    """Number of segments of a band and whether they list one-deletion neighbourhoods.

    Of both ways that make a shortfall rare, the one with the lower cost: signatures
    listed, those of a single token counting more as they draw more candidates.
    """
    low, high = bands()[band]
    sizes = sorted({max(1, -(-low * NUM // DEN)), low, (low + high) // 2, high})
    best = None
    for deletions in (False, True):
        m = 1
        while m < 16 * high and any(shortfall(x, m, deletions, need(x)) > RARE or (x > 20 and shortfall(int(x * RARE_TOKENS), m, deletions, need(x)) > THIN) for x in sizes):
            m += max(1, m // 25)
        load = high / m
        singles = m * load * np.exp(-load) + (m * load * load * np.exp(-load) if deletions else 0)
        listed = m * (1 - np.exp(-load)) + (high - m * load * np.exp(-load) if deletions else 0)
        cost = listed + SINGLE_COST * singles
        if best is None or cost < best[0]:
            best = (cost, m, deletions)
    return best[1], best[2]


def segments_of(tokens: np.ndarray, m: int) -> np.ndarray:
    """The segment of each token, by its high bits; sorted tokens have sorted segments."""
    return (((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def signatures(flat: np.ndarray, at: np.ndarray, band: int, salt: int, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets in a band, with the set's number and the least level of its tokens;
    and the differences that each set's segments can catch, plus one.
    """
    n, size = len(at) - 1, np.diff(at)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(n, np.int64)
    m, deletions = allocation(band)
    segment, owner = segments_of(flat, m), np.repeat(np.arange(n), size)
    new = np.ones(len(flat), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    count = np.append(starts[1:], len(flat)) - starts
    value = mixed(flat + ODD[1])
    total = np.add.reduceat(value, starts)
    place = mixed(segment[starts].astype(np.uint64) + np.uint64((band << 32) + (salt << 48)))
    out, of = mixed(total * ODD[2] + place), owner[starts]
    low = np.zeros(len(starts), np.int64) if level is None else np.minimum.reduceat(level, starts).astype(np.int64)
    capacity = np.bincount(of, minlength=n)
    if not deletions:
        return out, of, low, capacity
    which = np.repeat(np.arange(len(starts)), count)
    more = count[which] > 1
    which = which[more]
    out = np.concatenate([out, mixed((total[which] - value[more]) * ODD[2] + place[which])])
    return out, np.concatenate([of, of[which]]), np.concatenate([low, low[which]]), capacity + np.bincount(of[count > 1], minlength=n)


def guest_bands(size: int) -> list[int]:
    own, top = band_of(size), size * DEN // NUM
    out, b = [], own + 1
    while bands()[b][0] <= top:
        out.append(b)
        b += 1
    return out


GUEST, INDEXED = 1, 2


def entries(flat: np.ndarray, at: np.ndarray, levels: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray]:
    """Per band (signatures, sets' numbers, roles, least shared with a partner, levels), and which sets fall short.

    A set goes without its frequent tokens if enough others fill its segments in each band; else
    it is indexed by those others and listed by all its tokens. No set is empty.
    """
    size = np.diff(at)
    sizes = np.unique(size)
    home = np.asarray([band_of(int(x)) for x in sizes])[np.searchsorted(sizes, size)]
    last = np.asarray([max([band_of(int(x)), *guest_bands(int(x))]) for x in sizes])[np.searchsorted(sizes, size)]
    needs = np.asarray([need(int(x)) for x in sizes])[np.searchsorted(sizes, size)]
    level = None if levels is None else levels[(flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    if level is None:
        rest, rest_at, rest_level = flat, at, None
    else:
        rare = level == 0
        rest, rest_at, rest_level = flat[rare], np.concatenate([[0], np.cumsum(rare)])[at], None

    def listed_by(tokens, begin, level, sets, salt):
        out, short = [], np.zeros(len(size), bool)
        for band in range(int(home[sets].min(initial=1 << 30)), int(last[sets].max(initial=-1)) + 1):
            own = sets[(home[sets] <= band) & (band <= last[sets])]
            if not len(own):
                continue
            own_level = None if level is None else part_of(level, begin, own)[0]
            found, of, low, capacity = signatures(*part_of(tokens, begin, own), band, salt, own_level)
            short[own] |= capacity < needs[own]
            # a segment with deletions spans several signatures, so only one is certain
            least = np.ones(len(own), np.int64) if allocation(band)[1] else np.clip(capacity - needs[own] + 1, 1, 65535)
            out.append((found, own[of], np.where(home[own] < band, GUEST, 0)[of], least[of], low))
        return out, short

    out, thin = listed_by(rest, rest_at, rest_level, np.arange(len(size)), 0)
    if level is None:
        return out, thin
    few = np.flatnonzero(thin)
    full, short = listed_by(flat, at, level, few, 1)
    some = [(f, of, np.where(thin[of], role | INDEXED, role), np.where(thin[of], 1, least), low) for f, of, role, least, low in out]
    return some + full, short


def entries_of(tokens: np.ndarray, frequent: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, int, int]], bool]:
    """(signatures, role, least shared with a partner) of one set in each band, and whether they fall short."""
    found, short = entries(tokens, np.asarray([0, len(tokens)]), None if frequent is None else frequent.astype(np.uint8))
    return [(f, int(role[0]), int(least[0])) for f, _, role, least, _ in found if len(f)], bool(short[0])


# --- passes over the texts -------------------------------------------------


def _small(batches, rows: int = ROWS, most: int = BYTES):
    """Batches of at most ``rows`` rows and about ``most`` bytes of text, one row at least."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        total, i = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
        while i < batch.num_rows:
            j = min(max(int(np.searchsorted(total, total[i] + most, "right")) - 1, i + 1), i + rows, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and key of every row; and parts of each task's sketch, with n_shingles below 0.

    A sketch counts a task's tokens by bucket. Part p of it has n_shingles -1 - p.
    """

    def run(batches):
        names, counts = ["doc_id", "n_shingles", "key", "sketch"], np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in _small(batches):
            flat, begin = shingle_sets(batch.column("text").to_pylist())
            at, n = np.unique((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
            counts[at] += n.astype(np.int32)
            size = np.diff(begin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(set_keys(flat, begin), pa.int64(), mask=size == 0), pa.nulls(len(size), pa.binary())], names=names)
        small = np.minimum(counts, 65535).astype("<u2").reshape(PARTS, -1)
        for part in range(PARTS):
            packed = zlib.compress(small[part].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1 - part], pa.int64()), pa.array([None], pa.int64()), pa.array([packed], pa.binary())], names=names)

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, key long, sketch binary")


def frequent_buckets(rows: DataFrame, total: int, hot: int = HOT) -> np.ndarray:
    """The level of each bucket of the sketch; ``total`` tokens are in all sets.

    0: rare. 1: many texts meet it. 2: over ``hot`` texts. By the load that it needs, at
    most a share of all buckets is not rare, whatever the number of texts.
    """
    least = max(FREQUENT, LOADS * total >> SKETCH_BITS)

    def run(table: pa.Table) -> pa.Table:
        part, counts = -1 - table.column("n_shingles")[0].as_py(), np.zeros((1 << SKETCH_BITS) // PARTS, np.int64)
        for x in table.column("sketch"):
            counts += np.frombuffer(zlib.decompress(x.as_py()), "<u2")
        level = (counts > min(least, hot)).astype(np.uint8) + (counts > hot)
        return pa.table({"part": pa.array([part], pa.int32()), "levels": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    found = rows.where("n_shingles < 0").select("n_shingles", "sketch").groupBy("n_shingles").applyInArrow(run, "part int, levels binary")
    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint8)
    for r in found.collect():  # ``PARTS`` rows
        out[r["part"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out.reshape(-1)


def listed(docs: DataFrame, groups: int, levels: np.ndarray | None) -> DataFrame:
    """Rows (group, entries): signatures with their class, packed, one row for each group and batch.

    Group -1 has the classes for which the signatures fall short, groups below have the entries of hot signatures.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def packed(group: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
        return group[starts].tolist(), [rows[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]

    def run(batches):
        seen, levels = set(), shared.value
        for batch in _small(batches):
            flat, at = shingle_sets(batch.column("text").to_pylist())
            keys, chosen = set_keys(flat, at), []
            for k, (doc_id, key, n) in enumerate(zip(batch.column("doc_id").to_pylist(), keys.tolist(), np.diff(at).tolist(), strict=True)):
                if doc_id is None or n == 0 or key in seen:
                    continue
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(key)
                chosen.append(k)
            if not chosen:
                continue
            keys = keys[chosen]
            found, short = entries(*part_of(flat, at, np.asarray(chosen)), levels)
            sig, of, role, least, level = (np.concatenate(x) for x in zip(*found, strict=True))
            numbers, blobs = [], []
            if short.any():
                lone = np.zeros(int(short.sum()), ENTRY)
                lone["key"] = keys[short]
                numbers, blobs = [-1], [lone.tobytes()]
            hot = level > 1
            if hot.any():
                rows = np.empty(int(hot.sum()), HOT_ENTRY)
                rows["g"], rows["role"], rows["least"], rows["key"] = sig[hot].view(np.int64), role[hot], least[hot], keys[of[hot]]
                more = packed(-2 - (mixed(rows["key"].view(np.uint64)) % np.uint64(groups)).astype(np.int32), rows)
                numbers, blobs = numbers + more[0], blobs + more[1]
                sig, of, role, least = sig[~hot], of[~hot], role[~hot], least[~hot]
            if len(sig):
                rows = np.empty(len(sig), ENTRY)
                rows["sig"] = (sig.astype(np.uint32) & np.uint32(0xFFFFFFFC)) | role.astype(np.uint32)
                rows["least"], rows["key"] = least, keys[of]
                more = packed(((sig >> np.uint64(32)) % np.uint64(groups)).astype(np.int32), rows)
                numbers, blobs = numbers + more[0], blobs + more[1]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["group", "entries"])

    return _texts(docs).mapInArrow(run, "group int, entries binary")


CROWDS = "g long, key long, role int, least int, shared int, k int"


def crowds(packed: DataFrame) -> DataFrame:
    """The members of groups: different classes under one signature, with role and what each must share with a partner.

    Not all of them are guests and not all are only indexed. ``g`` names a group by its members, so equal groups
    have one name; within a reducer's part they are listed once, with the number of signatures as
    ``shared``. ``k`` is the number of members. A class for which the signatures fall short is listed alone, with k = 1.
    Hot signatures are groups of their own, named by the signature; they may have one member.
    """

    def rows(g, key, role, least, shared, k) -> pa.Table:
        return pa.table([pa.array(g, pa.int64()), pa.array(key, pa.int64()), *(pa.array(x, pa.int32()) for x in (role, least, shared, k))], names=["g", "key", "role", "least", "shared", "k"])

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        data = np.concatenate([np.frombuffer(x, HOT_ENTRY if group < -1 else ENTRY) for x in table.column("entries").to_pylist()])
        one = np.ones(len(data), np.int32)
        if group < -1:
            return rows(data["g"], data["key"], data["role"], data["least"], one, one * HOT_CROWD)
        if group == -1:
            key = np.unique(data["key"])
            return rows(key, key, *([x] * len(key) for x in (0, 1, 1, 1)))
        data = data[np.argsort((data["sig"].astype(np.uint64) >> np.uint64(2) << np.uint64(34)) | (data["key"].view(np.uint64) >> np.uint64(30)), kind="stable")]
        sig, key, role = data["sig"] >> np.uint32(2), data["key"], (data["sig"] & 3).astype(np.uint64)
        new = np.ones(len(data), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, role, least = sig[new], key[new], role[new], data["least"][new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.append(starts[1:], len(sig)) - starts
        some = (size > 1) & (np.bitwise_and.reduceat(role, starts) == 0)
        member = mixed(mixed(key.view(np.uint64) + ODD[0]) + role * ODD[1])
        name = mixed(np.add.reduceat(member, starts) + size.astype(np.uint64))[some]
        _, first, n = np.unique(name, return_index=True, return_counts=True)
        starts, size = starts[some][first], size[some][first]
        begin = np.cumsum(size) - size
        at = np.repeat(starts - begin, size) + np.arange(size.sum())
        return rows(np.repeat(name[first].view(np.int64), size), key[at], role[at].astype(np.int32), least[at], np.repeat(n, size), np.repeat(size, size))

    return packed.groupBy("group").applyInArrow(run, CROWDS)


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the wanted classes; ``wanted`` has key and the doc_id that stands for it."""
    rows = _texts(docs).join(wanted, "doc_id").select("key", "text")

    def run(batches):
        for batch in _small(batches):
            flat, at = shingle_sets(batch.column("text").to_pylist())
            keys, same = batch.column("key").to_pylist(), set_keys(flat, at).tolist()
            own = [k for k in range(len(keys)) if at[k] < at[k + 1] and keys[k] == same[k]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in own], pa.int64()), pa.array([flat[at[k] : at[k + 1]].tobytes() for k in own], pa.binary())], names=["key", "tokens"])

    # rows that repeat a doc_id and text would give a class twice
    return rows.mapInArrow(run, "key long, tokens binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets. ``b`` may be hot."""
    first = pairs.select("a", "b").join(known.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    both = first.join(known.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def short_pairs(docs: DataFrame, short: DataFrame, block: int = 2_000_000) -> list[DataFrame]:
    """Candidates of classes for which the pigeonhole falls short: whoever shares one of their tokens.

    ``short`` has key and tokens; it is taken in blocks of ``block`` tokens against all rows.
    """
    out, held, n = [], {}, 0

    def scan(index: dict):
        shared = docs.sparkSession.sparkContext.broadcast((np.asarray(sorted(index), np.uint64), [index[t] for t in sorted(index)]))

        def run(batches):
            at, who = shared.value
            for batch in _small(batches):
                flat, begin = shingle_sets(batch.column("text").to_pylist())
                keys, owner = set_keys(flat, begin).tolist(), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                pos = np.minimum(np.searchsorted(at, flat), len(at) - 1)
                hit = np.flatnonzero(at[pos] == flat)
                pairs = {(keys[d], other) for d, p in zip(owner[hit].tolist(), pos[hit].tolist(), strict=True) for other in who[p] if other != keys[d]}
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        out.append(_texts(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, "a long, b long").distinct())

    for r in short.toLocalIterator():
        for t in np.frombuffer(r["tokens"], np.uint64).tolist():
            held.setdefault(t, []).append(r["key"])
            n += 1
        if n >= block:
            scan(held)
            held, n = {}, 0
    if held:
        scan(held)
    return out


# --- components ------------------------------------------------------------


def few(links: DataFrame, n: int) -> DataFrame:
    """A table of about ``n`` links in no more tasks than they need, however many partitions a shuffle has; never in more."""
    return links.coalesce(-(-max(n, 1) // LINKS))


def shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of distinct links (u, v), and whether they are stars: no u has two v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, inner = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()
    return n, inner == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of links (a, b): the smallest node that links reach.

    Stars around their smallest nodes are what the rounds end at, so once links are stars no round follows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    while True:
        n, done = shape(edges)
        if done:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(few(edges.select("v", F.col("v").alias("root")).distinct(), n))
            out = materialize(out, "roots")
            discard(edges)
            return out
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        before = edges
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(near.groupBy("u").agg(F.min("v").alias("m")), 2 * n).select("u", F.least("u", "m").alias("m"))
        edges = few(near.join(least, "u"), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = few(edges.distinct(), 2 * n)
        # small star: u and its smaller neighbours go to the smallest of them
        least = few(edges.groupBy("u").agg(F.min("v").alias("m")), n)
        moved = few(edges.join(least, "u"), 2 * n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(few(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), n), "links")
        discard(before)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``roots`` and of links (a, b) between them or others, after these links.

    Only components that the links touch take part in the rounds.
    """
    at = lambda c, to: links_at(c, to, roots)
    between = materialize(at(at(links.select("a", "b"), "a"), "b").where("a <> b"), "links")
    found = components(between)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    out = materialize(moved.unionByName(found.join(roots.select("node"), "node", "left_anti")), "roots")
    discard(between, found, roots)
    return out


def links_at(links: DataFrame, end: str, roots: DataFrame) -> DataFrame:
    """Links with one end moved to its root."""
    to = roots.select(F.col("node").alias(end), F.col("root").alias("_to"))
    return links.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).select("a", "b")


# --- join ------------------------------------------------------------------


def join(docs: DataFrame, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scanned = materialize(sets(docs), "sets")
    rows = scanned.where("n_shingles >= 0").drop("sketch")
    classes = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(2 * parts, int(total * ENTRIES_PER_TOKEN / GROUP_ENTRIES) + 1)
    found = materialize(crowds(listed(docs, groups, frequent_buckets(scanned, total, hot))), "crowds")
    named = materialize(members(found), "members")
    lone = materialize(found.where("k = 1").select("key").distinct(), "lone")
    discard(found)
    wanted = named.select("key").union(lone).distinct()
    known = materialize(class_sets(docs, classes.join(wanted, "key").select("key", F.col("rep").alias("doc_id"))), "tokens")

    # the few sets that need another way, then each set against hubs of its groups, then what is left
    nothing = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    done, near, used, extras = nothing, nothing, [], []
    for extra in short_pairs(docs, known.join(lone, "key", "left_semi")):
        extra = materialize(_of_like_size(extra, classes), "pairs")
        extras.append(materialize(verified(extra, known_of(docs, extra, classes)), "verified"))
    roots = nothing.toDF("node", "root")
    if extras:
        roots = merged(roots, reduce(DataFrame.unionByName, extras))
    for _ in range(ROUNDS):
        placed = materialize(with_roots(named, roots), "members")
        star = materialize(hub_pairs(placed), "pairs")
        near = near.unionByName(star)
        like = materialize(_of_like_size(star, classes), "pairs")
        done = done.unionByName(like)
        linked_now = materialize(verified(like, known), "verified")
        roots = merged(roots, linked_now)
        discard(placed, linked_now)
        used += [star, like]
    placed = materialize(with_roots(named, roots), "members")
    split = materialize(split_groups(placed), "split")
    shared = with_salt(placed, "k", "key").join(unsalted(split.where(F.col("size") > crowd), "k"), ["g", "salt"]).select("key", "hub")
    around = near.select(F.col("a").alias("key"), F.col("b").alias("hub")).union(shared)
    around = around.union(around.select("hub", "hub")).distinct()
    around = materialize(with_roots(around, roots).join(classes.select("key", "n"), "key"), "around")
    inside = materialize(within_clusters(around, known), "verified")
    rest = materialize(_residual(placed, split.where(F.col("size") <= crowd), classes, around, done), "pairs")
    last = materialize(verified(rest, known), "verified")
    roots = merged(roots, inside.unionByName(last))
    discard(*used, known, around, inside, rest, last, placed, split)
    # the smallest doc_id of a component's classes
    named_roots = materialize(with_roots(classes.select("key", "rep"), roots), "classes")
    least = named_roots.where("key <> root").groupBy("root").agg(F.min("rep").alias("low")).join(classes.select(F.col("key").alias("root"), "rep"), "root")
    least = least.select("root", F.least("low", "rep").alias("component_id"))
    named_roots = materialize(salted_join(named_roots, least, "root", "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")), "components")
    discard(classes, named, lone)
    # empty sets have no key to meet under
    out = rows.where("key IS NOT NULL").join(named_roots, "key", "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("key IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def members(crowd: DataFrame) -> DataFrame:
    """(g, key, role, shared, k, c) of the groups that are needed.

    ``least`` bounds from below what a set shares with each partner. With fewer
    signatures in all groups together it has no partner. Otherwise, in one common order of the
    groups by crowd, it needs no more than the groups before its last ``least - 1``
    signatures: what two partners share first cannot come later. ``c`` tells how central a
    set is: how crowded its groups are, as those of an original among its edited copies.
    """
    named = crowd.where("k > 1").groupBy("g", "key", "role").agg(F.sum("shared").alias("shared"), F.max("k").alias("k"), F.min("least").alias("least"))
    whole = Window.partitionBy("key", "role")
    before = whole.orderBy("k", "g").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("all", F.sum("shared").over(whole)).withColumn("before", F.coalesce(F.sum("shared").over(before), F.lit(0)))
    named = named.where("before <= all - least").select("g", "key", "role", "shared", "k")
    return named.withColumn("c", F.sum(F.col("k").cast("long") * F.col("shared")).over(Window.partitionBy("key")))


def with_roots(named: DataFrame, found: DataFrame) -> DataFrame:
    return named.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _salts(k: str):
    return F.ceil(F.col(k) / SALT_ROWS).cast("int")


def with_salt(rows: DataFrame, k: str, by: str) -> DataFrame:
    """Rows of a group of ``k`` members with a salt, so that a join on the group deals large ones over several tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), _salts(k)).cast("int"))


def unsalted(groups: DataFrame, k: str) -> DataFrame:
    """One row of each group for each salt that its members may have."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(k) - 1))).drop(k)


def hub_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): each set and the hubs of other components with which it shares most, and those of its largest groups.

    A group's hub is its most central set at home.
    """
    own = placed.where(F.col("role").bitwiseAND(GUEST) == 0)
    hubs = own.groupBy("g").agg(F.max(F.struct("c", "key", "root")).alias("x"), F.first("k").alias("k")).select("g", "k", F.col("x.key").alias("hub"), F.col("x.root").alias("to"))
    pairs = with_salt(placed, "k", "key").join(unsalted(hubs, "k"), ["g", "salt"]).where("root <> to")
    pairs = pairs.groupBy("key", "hub").agg(F.sum("shared").alias("n"), F.max("k").alias("wide"))
    rank = lambda c: F.row_number().over(Window.partitionBy("key").orderBy(F.desc(c), "hub"))
    pairs = pairs.withColumn("_n", rank("n")).withColumn("_w", rank("wide")).where((F.col("_n") <= HUBS) | (F.col("_w") <= HUBS))
    return pairs.select(F.col("key").alias("a"), F.col("hub").alias("b"))


def split_groups(placed: DataFrame) -> DataFrame:
    """(g, k, hub, size) of the groups whose members are in different components."""
    found = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("k").alias("k"), F.max(F.struct("c", "key")).alias("x"), F.count(F.lit(1)).alias("size"))
    return found.where("lo <> hi").select("g", "k", F.col("x.key").alias("hub"), "size")


def known_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of all classes in pairs."""
    member = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "key")
    return class_sets(docs, classes.join(member, "key", "left_semi").select("key", F.col("rep").alias("doc_id")))


def _of_like_size(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link."""
    n = classes.select("key", "n")
    sized = pairs.join(n.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return sized.where((F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)).select("a", "b")


def within_clusters(around: DataFrame, known: DataFrame, blocks: tuple[int, int] = CLUSTER_BLOCKS, most: int = CLUSTER_TOKENS) -> DataFrame:
    """Links (a, b) between sets around one hub that are in different components.

    ``around`` has key, hub, root and n. Each set outside the hub's component meets each set around the hub, in cells of
    as many sets a side as give ``SIDES`` sides, within ``blocks``, and about ``most`` tokens. A cell counts common tokens by a
    matrix product and gives one link for each outside set and component, so nothing is expanded into pairs.
    """
    parts = lambda block: F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / most)).cast("int")
    block = F.least(F.greatest(F.count(F.lit(1)) / SIDES, F.lit(blocks[0])), F.lit(blocks[1]))
    whole = around.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("key") == F.col("hub"), F.col("root"))).alias("home"), block.alias("block"), parts(block).alias("all_parts"))
    rows = salted_join(around, whole.where("lo <> hi").drop("lo", "hi"), "hub", "key").withColumn("outside", F.col("root") != F.col("home"))
    rows = materialize(rows, "around")
    out = rows.where("outside").groupBy("hub").agg(parts(F.first("block")).alias("out_parts"))
    rows = salted_join(rows, out, "hub", "key")
    own = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = rows.select("hub", "key", "root", F.lit(False).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("out_parts") - 1)).alias("row"), own("all_parts").alias("col"))
    probes = rows.where("outside").select("hub", "key", "root", F.lit(True).alias("probe"), own("out_parts").alias("row"), F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("col"))
    cells = every.unionByName(probes).join(known, "key")
    return cells.groupBy("hub", "row", "col").applyInArrow(_cell_links, "a long, b long").distinct()


def _cell_links(table: pa.Table) -> pa.Table:
    key, root = table.column("key").to_numpy(), table.column("root").to_numpy()
    probe = table.column("probe").to_numpy(zero_copy_only=False)
    tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    size = np.asarray([len(x) for x in tokens])
    which = np.repeat(np.arange(len(tokens)), size)
    _, ids, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    common = n[ids] > 1  # a token of one set alone is in no intersection
    columns = np.cumsum(n > 1) - 1
    ids, which = columns[ids[common]], which[common]
    place = np.where(probe, np.cumsum(probe) - 1, np.cumsum(~probe) - 1)
    left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, which = ids[order], which[order]
    for first in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
        a, b = np.searchsorted(ids, [first, first + 4096])
        i, w = ids[a:b] - first, which[a:b]
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        x[place[w[probe[w]]], i[probe[w]]] = 1
        y[place[w[~probe[w]]], i[~probe[w]]] = 1
        both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((both * DEN >= union * NUM) & (both > 0) & (root[left][:, None] != root[right][None, :]))
    _, one = np.unique(np.stack([i, root[right[j]]], 1), axis=0, return_index=True)
    return pa.table({"a": pa.array(key[left[i[one]]], pa.int64()), "b": pa.array(key[right[j[one]]], pa.int64())})


def _residual(placed: DataFrame, split: DataFrame, classes: DataFrame, around: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of different components in a split, small group that share no hub, not compared yet."""
    hubs = around.groupBy("key").agg(F.collect_set("hub").alias("hubs"))
    named = placed.join(split.select("g"), "g", "left_semi").join(classes.select("key", "n"), "key").join(hubs, "key", "left")
    like = F.least("x.n", "y.n") * DEN >= F.greatest("x.n", "y.n") * NUM
    roles = F.col("x.role").bitwiseAND(F.col("y.role")) == 0  # not both guests, not both only indexed
    apart = ~F.coalesce(F.arrays_overlap("x.hubs", "y.hubs"), F.lit(False))
    pairs = named.alias("x").join(named.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.key") > F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & like & roles & apart)
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    return pairs.join(done.union(done.select("b", "a")), ["a", "b"], "left_anti")

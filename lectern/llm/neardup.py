"""Similarity self-join of texts on word runs by partition-and-enumerate signatures.

The similarity of two records is the Jaccard similarity of their sets of runs of
``words`` consecutive words. All pairs at or above ``threshold`` are found:

*Partition.* The domain of runs is split into ``cells`` by hash. Were every cell
in which either set has a run below the threshold, so would be the whole; so a
similar pair is similar, at the same threshold, in at least one cell where the
sets are not both empty. There the two local sets have a common subset of at
least ``threshold`` times their union. The second level of the partition is the
single run: local sets are small, and this is the level at which no projection
is empty (two records never meet because both have nothing somewhere).

*Bands and subsets.* Two local sets of m <= M runs agree in ceil(threshold * M)
of them. That number is the band of the pair, and a local set takes part in each
band it can share: M from m to m / threshold. In a band its signatures are all
subsets of that many runs. Local sets larger than ``most`` are split again by the
next digit of the hash, to any depth, by the same argument; sizes from which a
partner could exceed ``most`` are entered on both levels. So texts of any length
are covered and nothing is capped.

*Transport.* Signatures are not shipped. The least run of a subset, in the order
of the hashes, is its anchor; a local set travels once for each of its runs that
can be an anchor (m - band + 1 at most) to the unit of work the anchor's hash
names, with the runs after it. Subsets are enumerated where
they meet, anchor by anchor; an anchor nobody shares is dropped unread. The
number of units follows from the volume of the runs, so that a unit holds
``UNIT_BYTES`` or so at any size of the data, and is the only thing that does.

*Check.* Records that share a signature are compared by size and by a parity
sketch of the whole set (each differing run flips one bit, so sketches can't
differ in more bits than the sets do in runs). A bucket of more than ``BLOCK``
different sets is sorted by size and leaves its unit in blocks, of which those
that can hold pairs of like size are compared two by two in tasks of their own;
no bucket is capped. What remains is compared by the exact sets.

Equal sets are one record of the join, known by the hash of the set, and spread
over their members at the end; a text that a third of the rows share costs no
more than a single one from each batch.

Defined results: records with a null or blank abstract or with fewer than
``least_words`` words take no part; repeated rows of one id count once; an id
whose rows differ takes part with each of its texts, never paired with itself;
texts with fewer words than one run have no run and match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

_WORD = re.compile(r"[^\W_]+")
#: Bytes of a run.
WIDTH = 5
#: Cells of the partition; a text of a hundred runs has about three in each, where fewest entries are needed.
CELLS = 32
MOST = 10
BRANCH = 3
#: Volume of a unit of work as shipped.
UNIT_BYTES = 32 << 20
#: Bits of the sketch of the whole set that an entry carries.
SKETCH = 192
#: Different sets under one signature up to which they are compared where they meet, and from which in blocks of as many.
BLOCK = 1024


# --- features -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_runs(text: str, words: int, least_words: int) -> np.ndarray | None:
    """The sorted distinct 40-bit hashes of the runs of a text; None if it takes no part."""
    found = _WORD.findall(text.lower())
    if len(found) < max(least_words, words):
        return None
    h = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    run = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        run = _mix(run) + h[k : len(h) - words + 1 + k]
    return np.unique(_mix(run) >> np.uint64(24))


def to_bytes(values: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Integers as rows of ``width`` bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def from_bytes(raw: bytes | memoryview, width: int = WIDTH) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel().astype(np.uint64)


def raw_column(column: pa.ChunkedArray | pa.BinaryArray) -> tuple[memoryview, np.ndarray]:
    """(the bytes of a binary column in one piece, the length of each row), without a Python object a row."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    offset = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (memoryview(data)[offset[0] : offset[-1]] if data is not None else memoryview(b"")), np.diff(offset)


def _run_sets(words: int, least_words: int):
    """(id, title, abstract) to (id, key, runs) of the records that take part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets = [], [], []
            for i, title, abstract in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = word_runs((title or "") + " " + abstract, words, least_words) if abstract.strip() else None
                if runs is not None:
                    raw = to_bytes(runs).tobytes()
                    ids.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    sets.append(raw)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["id", "key", "runs"])

    return of


# --- local sets and their signatures ----------------------------------------------------------------------------


@lru_cache(maxsize=256)
def bands(m: int, threshold: float, most: int) -> tuple[tuple[int, ...], bool]:
    """(the subset sizes with which a local set of m runs is entered at this level, whether it also goes a level deeper)."""
    largest = int(m / threshold + 1e-9)
    sizes = tuple(sorted({ceil(threshold * big - 1e-9) for big in range(m, min(most, largest) + 1)})) if m <= most else ()
    return tuple(k for k in sizes if k <= m), largest > most


def local_sets(owner: np.ndarray, runs: np.ndarray, cells: int, threshold: float, most: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(owners, m, matrix of m ascending 40-bit hashes a row) of the local sets to be entered, level by level.

    owner: index of the record of each run. The hashes mix in the level and the block, so runs of different blocks never meet.
    """
    block, rest, level = (runs % np.uint64(cells)).astype(np.int64), runs // np.uint64(cells), 0
    while len(runs):
        tag = _mix(block.astype(np.uint64) * np.uint64(2654435761) + np.uint64(level))
        mark = _mix((runs + np.uint64(0x9E3779B97F4A7C15)) ^ tag) >> np.uint64(24)
        order = np.lexsort((mark, block, owner))
        owner, runs, block, rest, mark = owner[order], runs[order], block[order], rest[order], mark[order]
        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(start, len(runs)))
        deeper = np.zeros(len(start), dtype=bool)
        for m in np.unique(size):
            here = size == m
            entered, deeper[here] = bands(int(m), threshold, most)
            if entered:
                yield owner[start[here]], int(m), mark[start[here][:, None] + np.arange(m)]
        keep = np.repeat(deeper, size)
        owner, runs, block, rest = owner[keep], runs[keep], block[keep], rest[keep]
        block = block * BRANCH + (rest % np.uint64(BRANCH)).astype(np.int64)
        rest = rest // np.uint64(BRANCH)
        level += 1
        if level > 30:  # the hash has no digits left: runs that still share a block are equal
            rest = _mix(runs + np.uint64(level))


def parity_sketch(owner: np.ndarray, runs: np.ndarray, n: int, bits: int = SKETCH) -> np.ndarray:
    """(n, bits / 64) words: for each record the parity of its runs per bit."""
    bit = (_mix(runs ^ np.uint64(0xA5A5A5A5)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(owner * bits + bit, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.uint64)


# --- transport ------------------------------------------------------------------------------------------------

#: One row for each batch and unit. head: for each entry the key (8 bytes), a parity sketch of the whole set (24), its size
#: (2, saturated) and the shape (the size of the local set and how many of its runs follow, 4 bits each);
#: body: the anchor (5 bytes) and the runs after it (3 each, enough to tell subsets of one anchor apart).
ENTRY = pa.schema([("unit", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
_ENTRY_DDL = "unit int, head binary, body binary"
_HEAD = np.dtype([("key", "<i8"), ("sketch", "<u8", SKETCH // 64), ("size", "<u2"), ("shape", "u1")])
_NEXT = 3


def _entries(cells: int, units: int, threshold: float, most: int, rows: int = 4000):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                keys, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
                raw, length = raw_column(batch.column(1).take(pa.array(first)))  # copies in one batch travel once
                runs, size = from_bytes(raw), length // WIDTH
                if len(runs):
                    yield _packed(keys, size, runs, cells, units, threshold, most)

    return of


def _packed(keys: np.ndarray, size: np.ndarray, runs: np.ndarray, cells: int, units: int, threshold: float, most: int) -> pa.RecordBatch:
    every = np.repeat(np.arange(len(keys)), size)
    sketch = parity_sketch(every, runs, len(keys))
    heads, bodies, homes, lengths = [], [], [], []
    for owner, m, marks in local_sets(every, runs, cells, threshold, most):
        least = bands(m, threshold, most)[0][0]
        for p in range(m - least + 1):  # the runs that can be the least of a subset
            head = np.empty(len(owner), dtype=_HEAD)
            head["key"], head["sketch"], head["size"], head["shape"] = keys[owner], sketch[owner], np.minimum(size[owner], 65535), m << 4 | m - p
            heads.append(head)
            after = to_bytes(marks[:, p + 1 :].ravel(), _NEXT).reshape(len(owner), -1)
            bodies.append(np.concatenate([to_bytes(marks[:, p]), after], axis=1).ravel())
            homes.append((marks[:, p] % np.uint64(units)).astype(np.int32))
            lengths.append(np.full(len(owner), WIDTH + (m - p - 1) * _NEXT))
    head, body, home, length = map(np.concatenate, (heads, bodies, homes, lengths))
    order = np.lexsort((head["key"], home))
    head, home = head[order], home[order]
    body, edge = _moved(body, length, order)
    new = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
    cut = np.append(new, len(head))
    return pa.record_batch([pa.array(home[new]), _binary(head.view(np.uint8), cut * _HEAD.itemsize), _binary(body, edge[cut])], schema=ENTRY)


def _moved(body: np.ndarray, length: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of ``length`` bytes in another order, their edges)."""
    moved = length[order]
    edge = np.append(0, np.cumsum(moved))
    return body[np.repeat((np.cumsum(length) - length)[order] - edge[:-1], moved) + np.arange(len(body))], edge


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


# --- meeting --------------------------------------------------------------------------------------------------

#: A candidate (a, b), or two blocks of a large bucket that are to be compared: the heads of their entries.
FOUND = pa.schema([("route", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
_FOUND_DDL = "route bigint, a bigint, b bigint, left binary, right binary"


class Unit:
    """The entries of a unit of work that share their anchor with another record, in the order of the anchors."""

    def __init__(self, heads: list[bytes], bodies: list[bytes]):
        head = np.frombuffer(b"".join(heads), dtype=_HEAD)
        body = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        tail = (head["shape"] & 15).astype(np.int64)
        length = WIDTH + (tail - 1) * _NEXT
        begin = np.cumsum(length) - length
        anchor = from_bytes(body[begin[:, None] + np.arange(WIDTH)].tobytes())
        order = np.lexsort((head["key"], anchor))
        a, k = anchor[order], head["key"][order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]))  # a set of many copies comes once from each batch
        order, a = order[fresh], a[fresh]
        alone = np.append(True, a[1:] != a[:-1]) & np.append(a[1:] != a[:-1], True)
        order, self.anchor = order[~alone], a[~alone]
        self.head, self.body, self.begin = head[order], body, begin[order]
        self.shape = self.head["shape"]

    def signatures(self, lo: int, hi: int, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, signature) for every subset of the entries lo .. hi - 1."""
        rows, sigs = [], []
        shape = self.shape[lo:hi]
        for both in np.unique(shape):
            here = lo + np.flatnonzero(shape == both)
            local, tail = int(both) >> 4, int(both) & 15
            at = self.begin[here][:, None]
            first = from_bytes(self.body[at + np.arange(WIDTH)].tobytes())[:, None]
            after = from_bytes(self.body[at + WIDTH + np.arange((tail - 1) * _NEXT)].tobytes(), _NEXT).reshape(len(here), tail - 1)
            grid = _mix(np.concatenate([first << np.uint64(24), after], axis=1) + np.uint64(1))
            for k in bands(local, threshold, most)[0]:
                if k <= tail:
                    index = _subsets(tail, k)
                    acc = np.repeat(grid[:, :1], len(index), axis=1)
                    for j in range(k - 1):
                        acc += grid[:, index[:, j]]
                    sigs.append((_mix(acc) + np.uint64(k)).ravel())
                    rows.append(np.repeat(here, len(index)))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(rows), np.concatenate(sigs)

    def counts(self, threshold: float, most: int) -> np.ndarray:
        """The number of signatures of each entry."""
        each = np.zeros(256, dtype=np.int64)
        for both in np.unique(self.shape):
            local, tail = int(both) >> 4, int(both) & 15
            each[both] = sum(len(_subsets(tail, x)) for x in bands(local, threshold, most)[0] if x <= tail)
        return each[self.shape]


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets of two arrays of heads can be similar, by size and sketch: no two sketches differ in more bits than the sets in runs."""
    sx, sy = x["size"].astype(np.int64), y["size"].astype(np.int64)
    ok = (np.minimum(sx, sy) >= threshold * np.maximum(sx, sy) - 1e-9) & (x["key"] != y["key"])
    told = np.flatnonzero(ok & (np.maximum(sx, sy) < 65535))
    apart = np.bitwise_count(x["sketch"][told] ^ y["sketch"][told]).sum(axis=1, dtype=np.int64)
    ok[told] = apart <= (sx + sy)[told] * ((1 - threshold) / (1 + threshold)) + 1e-9
    return ok


def _meet(threshold: float, most: int, held: int = 1 << 20, block: int = BLOCK):
    """The entries of one unit to candidates and, for buckets of more than ``block`` sets, pairs of blocks.

    Anchors are taken in ascending order, as many at a time as have about ``held`` signatures.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        for b in batches:
            if b.num_rows:
                heads.append(bytes(raw_column(b.column(1))[0]))
                bodies.append(bytes(raw_column(b.column(2))[0]))
        if not heads:
            return
        unit = Unit(heads, bodies)
        del heads, bodies
        if not len(unit.head):
            return
        before = np.append(0, np.cumsum(unit.counts(threshold, most)))
        edges = np.append(np.flatnonzero(np.append(True, unit.anchor[1:] != unit.anchor[:-1])), len(unit.head))
        out = _Out()
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(before[edges], before[edges[at]] + held, side="right")) - 1)
            lo, hi = int(edges[at]), int(edges[to])
            yield from _bucketed(unit, lo, hi, int(before[hi] - before[lo]), threshold, most, held, block, out)
            at = to
        yield from out.flush()

    return of


@lru_cache(maxsize=256)
def _subsets(tail: int, k: int) -> np.ndarray:
    """The columns, besides the anchor, of every subset of k runs that has it as the least."""
    rows = list(combinations(range(1, tail), k - 1))
    return np.array(rows, dtype=np.int64).reshape(len(rows), k - 1)


class _Out:
    """Candidates, made distinct and passed on in bounded batches."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.n = most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            self.n += len(a)
        if self.n > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            rows = np.concatenate(self.parts)
            rows = rows[np.lexsort(rows.T)]
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]
            none = pa.nulls(len(rows), pa.binary())
            yield pa.record_batch([pa.array(rows[:, 0] ^ rows[:, 1]), pa.array(rows[:, 0]), pa.array(rows[:, 1]), none, none], schema=FOUND)
        self.parts, self.n = [], 0


def _bucketed(unit: Unit, low: int, high: int, total: int, threshold: float, most: int, held: int, block: int, out: _Out) -> Iterator[pa.RecordBatch]:
    rounds = -(-total // (4 * held))  # a very common anchor is enumerated several times, a share of its signatures each
    for turn in range(rounds):
        got = []
        step = max(1, (high - low) // rounds)
        for lo in range(low, high, step):
            r, s = unit.signatures(lo, min(high, lo + step), threshold, most)
            if rounds > 1:
                mine = (s >> np.uint64(20)) % np.uint64(rounds) == turn
                r, s = r[mine], s[mine]
            got.append((r, s))
        row, sig = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(sig)
        row, sig = row[order], sig[order]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(sig)))
        many = count > block
        few = (count > 1) & ~many
        starts, counts = start[few], count[few]
        edge = np.append(0, np.cumsum(counts * (counts - 1) // 2))
        at = 0
        while at < len(starts):  # about a quarter of a million pairs at a time
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + (1 << 18), side="right")) - 1)
            s, n = starts[at:to], counts[at:to]
            entry = np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            follow = np.repeat(s + n, n) - entry - 1
            left = np.repeat(entry, follow)
            right = left + 1 + (np.arange(follow.sum()) - np.repeat(np.cumsum(follow) - follow, follow))
            x, y = unit.head[row[left]], unit.head[row[right]]
            ok = near(x, y, threshold)
            yield from out.add(x["key"][ok], y["key"][ok])
            at = to
        for s, n in zip(start[many], count[many], strict=True):
            yield from _blocks(unit.head[row[s : s + n]], int(sig[s]), threshold, block)


def _blocks(head: np.ndarray, sig: int, threshold: float, block: int) -> Iterator[pa.RecordBatch]:
    """A large bucket, in order of size, as pairs of blocks that can hold a pair of like size."""
    head = head[np.argsort(head["size"], kind="stable")]
    parts = [head[lo : lo + block] for lo in range(0, len(head), block)]
    for i, x in enumerate(parts):
        for j in range(i, len(parts)):
            if x["size"][-1] < threshold * parts[j]["size"][0] - 1e-9:
                break
            route = int(_mix(np.array([sig ^ (i << 32) ^ j], dtype=np.uint64)).view(np.int64)[0])
            none = pa.nulls(1, pa.int64())
            yield pa.record_batch([pa.array([route]), none, none, pa.array([x.tobytes()]), pa.array([parts[j].tobytes()])], schema=FOUND)


def _compare(threshold: float):
    """Candidates pass; blocks become the candidates among them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(3).is_null()
            ready = batch.filter(whole)
            yield pa.record_batch([ready.column(1), ready.column(2)], names=["a", "b"])
            for row in batch.filter(pc.invert(whole)).select(["left", "right"]).to_pylist():
                left, right = (np.frombuffer(row[s], dtype=_HEAD) for s in ("left", "right"))
                out = _Out()
                for x in left:
                    ok = near(np.full(len(right), x), right, threshold)
                    for b in out.add(np.full(int(ok.sum()), x["key"]), right["key"][ok]):
                        yield b.select(["a", "b"])
                for b in out.flush():
                    yield b.select(["a", "b"])

    return of


# --- operator -------------------------------------------------------------------------------------------------


def similar_pairs(
    records: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    least_words: int = 30,
    cells: int = CELLS,
    most: int = MOST,
    unit_bytes: int = UNIT_BYTES,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of records (id, title, abstract).

    pairs: (a, b, common, either), a < b, keys of different run sets whose
    similarity common / either is at least the threshold. members: (id, key) for every
    record that takes part; records of one key have equal run sets.

    ``unit_bytes`` and ``block`` set how the work is cut, never what is found.
    """
    spark = records.sparkSession
    source = records.select(F.col("id").cast("bigint"), "title", "abstract").where("id is not null and abstract is not null")
    sets = source.mapInArrow(_run_sets(words, least_words), "id bigint, key bigint, runs binary")
    members = materialize(sets.select("id", "key", F.octet_length("runs").alias("bytes")))
    volume = members.agg(F.sum("bytes")).first()[0] or 0
    # entries take about six times the volume of the runs; small data still fill the cores
    units = max(1, -(-6 * volume // unit_bytes), min(2 * spark.sparkContext.defaultParallelism, volume >> 20))
    # one shuffle of the sets, from which the entries come and against which the candidates are checked
    one = sets.where("key is not null").groupBy("key").agg(F.first("runs").alias("runs"))
    candidates = (
        one.mapInArrow(_entries(cells, units, threshold, most), _ENTRY_DDL)
        .repartitionById(units, F.col("unit"))
        .mapInArrow(_meet(threshold, most, block=block), _FOUND_DDL)
        .repartition(F.col("route"))
        .mapInArrow(_compare(threshold), "a bigint, b bigint")
        .distinct()
    )
    return check_pairs(candidates, one, threshold), members.select("id", "key").distinct()


def _overlap(threshold: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = from_bytes(x), from_bytes(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                    rows.append((a, b, common, len(x) + len(y) - common))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "common", "either"])

    return of


def check_pairs(pairs: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold; ``one`` has the runs of each key."""
    both = pairs.join(one.select(F.col("key").alias("a"), F.col("runs").alias("ra")), "a").join(
        one.select(F.col("key").alias("b"), F.col("runs").alias("rb")), "b"
    )
    return both.select("a", "b", "ra", "rb").mapInArrow(_overlap(threshold), "a bigint, b bigint, common bigint, either bigint")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records, from pairs of keys and from equal run sets."""
    x = members.select(F.col("key").alias("a"), F.col("id").alias("ia"))
    y = members.select(F.col("key").alias("b"), F.col("id").alias("ib"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("ia", "ib")
    same = x.join(y.withColumnRenamed("b", "a"), "a").where("ia < ib").select("ia", "ib")
    every = across.unionByName(same).where("ia != ib")
    return every.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): one row a record: the least id of all records it is linked to over any number of links,
    and to how many other texts it is linked itself."""
    from lectern.llm.names import connected

    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    first = members.groupBy("key").agg(F.min("id").alias("first"))
    edges = pairs.select("a", "b").join(first.select(F.col("key").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("key").alias("b"), F.col("first").alias("fb")), "b")
    linked = edges.select(F.explode(F.array("fa", "fb")).alias("node")).distinct()
    label = connected(linked, edges.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    named = first.join(label, first["first"] == label["node"], "left").select("key", F.coalesce("label", "first").alias("class_id"))
    return members.join(named, "key").join(ends, "key", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))

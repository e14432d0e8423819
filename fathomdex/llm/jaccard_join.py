"""Exact Jaccard self-join over word shingles by metric-space partitioning.

Jaccard distance is a metric, so pivots, Voronoi regions and triangle-inequality windows
apply. Unrelated documents are all at distance one from each other, which no choice of
document pivots can tell apart, so a first level narrows them down by the same metric seen
in slices: the shingle universe is dealt by hash over more slices than two linked sets can
have differing shingles, so in some slice they are at distance zero. Sets whose slices are
equal, that is, whose nearest point in the slice is the same, share a cell; sets of sizes
that lie across the bound of two size classes are copied to the cells of both.

Cells, second level. Counts of shingles by hash, one for each few shingles, differ by no
more than the sets do, so their L1 distance is a metric that bounds the other from below. Pairs of
small cells stay if that bound lets them link. In a larger cell sets are tied to each pivot
within one and a half times the bound (the window of a pivot's region). Sets within half the
bound of a pivot are done, since by the triangle inequality all that can link with them is
tied to it too. In a cell of CHUNK sets or less every other set becomes a pivot itself. In
cells beyond, about PIVOTS sets, drawn by hash, are pivots, and every set is compared with
these only, a chunk of the cell to a task; the sets that are left, unless their ties hold
them together as it is, are dealt over slices anew, within their cell, and joined
recursively, so no task grows with the square of a cell. The components of all ties are the
candidate regions, which hold every link inside. A set takes its counts to each of its larger
cells. As more cells become larger ones the more sets there are, these rows grow faster than
the sets, so they are dealt in waves of whole cells, one after the other, each of a size in
proportion to the counts of all sets, and a wave's shuffle files go before the next. So are
small cells' pairs, and the cells that sets are dealt over anew: a set takes as many rows to
these as it has slices, for each larger cell that it is left in, so all of them together
outgrow the rows of the first cells. Their waves are of the larger cells within which they are
dealt, and each has about three quarters as many rows as the first cells have.

Regions, third level. Exact Jaccard distances to the region's pivots (one for each PART of
shingles) put each document in its Voronoi cell and in every cell whose window of twice the
radius it lies in. Documents within the radius of their pivot are linked with it, and a
cell that holds no others is done. The rest is joined recursively in one task: those within
the radius of a pivot are linked with it; of the rest, those within twice the radius are
also compared with them; those farther away can't link with them. Cells too large for a
task are joined part by part, every pair of parts in a task of its own.

Documents of equal sets are one set to all levels. Links that connect the same components
as all links are given; no link between different components is lost. Sets are equal if
their size and two independent 64-bit sums are.

Defined results: null or blank text has an empty set and links with nothing; a null id
passes through with a null component. Ids are taken as unique; repeated rows have equal sets
and so the same component. An empty table gives no rows. Only the id and text columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.llm.common import components, drop_since, drop_tables, free_shuffles, give_back, in_batches, lookup, made_so_far, materialize
from fathomdex.llm.shingles import mix, shingle_sets

WIDTH = 4
NUM, DEN = 85, 100
#: Shingles that a task holds at once, from each of two parts.
PART = 2_000_000
#: About so many pivots for a cell that is split, and so many at most for a region.
PIVOTS = 32
#: Sets of one cell that are compared in one task.
CHUNK = 4_096
#: Shingles of a region in one chunk, and the fewest documents.
CHUNK_SHINGLES, CHUNK_DOCS = 8_192, 64
SMALL_CELL = 16
HELD_ROWS = 100_000
#: Bytes that the larger cells of a wave take, in times the bytes of all counts, and of a row besides its counts.
WAVE, ROW_BYTES = 8, 32
#: Shingles dealt anew in a wave, in times the shingles of all sets, and what a set counts for besides its own.
AGAIN, SET_ROWS = 0.75, 10
#: Shingles for each count of the second metric.
PER_COUNT = 8
_NO_LABEL = np.iinfo(np.int64).min


class Rule(NamedTuple):
    """Which documents are similar: words of a shingle, and the least Jaccard similarity as a fraction."""

    width: int = WIDTH
    num: int = NUM
    den: int = DEN
    #: Shingles for each count; the lower the bound, the fewer it takes to tell unrelated sets apart.
    per_count: int = PER_COUNT

    @property
    def least(self) -> int:
        """Two different sets can be linked only if the smaller has so many shingles. Size
        classes begin here, each at one and a half times the one before."""
        return -(-self.num // (self.den - self.num))


RULE = Rule()


def linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """Whether sets of sizes a and b that share `both` are similar enough."""
    return rule.den * both >= rule.num * (a + b - both)


def _digest(s: np.ndarray) -> bytes:
    one, two = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(s ^ np.uint64(0x14057B7EF767814F)).sum()
    return np.array([one, two, np.uint64(len(s))], dtype="<u8").tobytes()


def _key(s: np.ndarray) -> int:
    """A number for the set. Different sets of one number would share candidates, no more."""
    return int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def _describe(batches: Iterator[pd.DataFrame], rule: Rule = RULE) -> Iterator[pd.DataFrame]:
    """Size, digest, key and counts of each document's set."""
    for batch in batches:
        out = []
        for i, s in zip(batch["doc_id"], shingle_sets(list(batch["text"]), rule.width), strict=True):
            tops = classes_of(len(s), rule)
            digest = _digest(s)
            key = int(np.frombuffer(digest, dtype="<i8", count=1)[0])
            out.append((i, len(s), digest, key, *(counts_of(s, tops[k], rule) if k < len(tops) else None for k in (0, 1))))
        yield pd.DataFrame(out, columns=["doc_id", "n", "digest", "key", "counts_own", "counts_next"])


class _CellRows:
    """Gathers rows of cells and hands them on in frames of a bounded size."""

    def __init__(self) -> None:
        self.cells: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.held = 0

    def add(self, cells: np.ndarray, key: int, own: bool) -> None:
        self.cells.append(cells)
        self.keys.append(np.full(len(cells), key, dtype=np.int64))
        self.own.append(np.full(len(cells), own))
        self.held += len(cells)

    def frames(self, least: int = HELD_ROWS) -> Iterator[pd.DataFrame]:
        if self.held > least:
            yield pd.DataFrame({"cell": np.concatenate(self.cells).view(np.int64), "key": np.concatenate(self.keys), "own": np.concatenate(self.own)})
            self.__init__()


def _cell_rows(batches: Iterator[pd.DataFrame], rule: Rule = RULE) -> Iterator[pd.DataFrame]:
    """A row for each cell that a set is in; own is false in the cells of the next class."""
    rows = _CellRows()
    for batch in batches:
        for s in shingle_sets(list(batch["text"]), rule.width):
            tops = classes_of(len(s), rule)
            key = _key(s) if tops else 0
            for k, top in enumerate(tops):
                rows.add(cells_of(s, top, rule), key, k == 0)
            yield from rows.frames()
    yield from rows.frames(0)


def _again_rows(batches: Iterator[pd.DataFrame], rule: Rule, turn: int) -> Iterator[pd.DataFrame]:
    """The cells, within each cell of places, of a set dealt over slices by another hash."""
    rows = _CellRows()
    for batch in batches:
        for places, s in zip(batch["places"], shingle_sets(list(batch["text"]), rule.width), strict=True):
            tops = classes_of(len(s), rule)
            key, dealt = _key(s), {}
            for place in places:
                own = bool(place["own"])
                if own not in dealt:
                    dealt[own] = cells_of(s, tops[0 if own else 1], rule, turn)
                rows.add(mix(dealt[own] ^ mix(np.array([place["cell"]], dtype=np.int64).view(np.uint64))), key, own)
                yield from rows.frames()
    yield from rows.frames(0)


def class_bounds(n: int, rule: Rule = RULE) -> tuple[int, int]:
    """The size class [low, high) of a set of n shingles, n from rule.least on."""
    low = rule.least
    while (high := low + low // 2) <= n:
        low = high
    return low, high


def slices(high: int, rule: Rule = RULE) -> tuple[int, int]:
    """How many slices a size class is dealt over, and how many of them may be empty in both sets.

    Linked sets below high differ in at most so many shingles; one slice more, besides the
    empty ones, is equal in both.
    """
    differ = (rule.den - rule.num) * 2 * (high - 1) // (rule.den + rule.num)
    spare = 3 + differ * 3 // 100
    return differ + 1 + spare, spare


def classes_of(n: int, rule: Rule = RULE) -> list[int]:
    """Upper bounds of the size classes that a set of n shingles goes to."""
    if n < rule.least:
        return []
    _, high = class_bounds(n, rule)
    # A linked set can lie in the next class if this one is near its bound.
    return [high, high + high // 2] if rule.den * n >= rule.num * high else [high]


def cells_of(s: np.ndarray, top: int, rule: Rule = RULE, turn: int = 0) -> np.ndarray:
    """The cells of a set in a class: one number for each slice that isn't empty.

    A set with more empty slices than its class spares also goes to the cells of those. turn
    chooses the hash that deals shingles over slices.
    """
    by = np.uint64((0x2545F4914F6CDD1D + turn * 0x9E3779B97F4A7C15) % (1 << 64))
    spread, value = mix(s ^ by), mix(s ^ np.uint64(0x9FB21C651E98DF25))
    count, spare = slices(top, rule)
    place = (spread % np.uint64(count)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(np.r_[-1, place[order]]))
    used = place[order][first]
    sums = np.add.reduceat(value[order], first)
    if count - len(used) > spare:
        empty = np.setdiff1d(np.arange(count), used)
        used, sums = np.concatenate((used, empty)), np.concatenate((sums, np.zeros(len(empty), dtype=np.uint64)))
    return mix(sums + mix(used.astype(np.uint64) + (np.uint64(top) << np.uint64(32))))


def counts_of(s: np.ndarray, top: int, rule: Rule = RULE) -> bytes:
    """How many shingles fall in each of the class's counts, as bytes (255 stands for more)."""
    many = top // rule.per_count + 1
    at = (mix(s ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(many)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=many), 255).astype(np.uint8).tobytes()


def most_apart(a, b, rule: Rule = RULE):
    """Most differing shingles of linked sets of these sizes."""
    return (rule.den - rule.num) * (a + b) // (rule.den + rule.num)


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches cut anew so that rows in a row of equal `by` stay in one frame."""
    held: pd.DataFrame | None = None
    for batch in batches:
        now = batch if held is None else pd.concat((held, batch), ignore_index=True)
        if not len(now):
            continue
        last = np.ones(len(now), dtype=bool)
        for c in by:
            last &= (now[c] == now[c].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        if cut:
            yield now.iloc[:cut]
        held = now.iloc[cut:]
    if held is not None and len(held):
        yield held


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of small cells, and the rows (cell in a, set in b) of large ones.

    Rows come sorted by cell and key, a cell in one task; cells of one set give nothing.
    """
    held: pd.DataFrame | None = None
    for batch in batches:
        now = batch if held is None else pd.concat((held, batch), ignore_index=True)
        cell, key = now["cell"].to_numpy(), now["key"].to_numpy()
        if not len(cell):
            continue
        new = np.r_[True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])]
        if not new.all():  # documents of equal sets
            now, cell = now[new], cell[new]
        cut = int(np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])[-1])
        if cut:
            yield from _met(now.iloc[:cut])
        held = now.iloc[cut:]
        if len(held) > HELD_ROWS:  # of a large cell only enough is kept to know it as one
            yield from _met(held)
            held = held.iloc[-SMALL_CELL - 1 :]
    if held is not None and len(held):
        yield from _met(held)


def _met(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    cell, key, own = (rows[c].to_numpy() for c in ("cell", "key", "own"))
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    count = np.diff(np.r_[first, len(cell)])
    members = np.repeat(count, count)
    large = members > SMALL_CELL
    if large.any():
        yield pd.DataFrame({"a": cell[large], "b": key[large], "own_a": own[large], "own_b": own[large], "large": True})
    small = np.flatnonzero((members > 1) & ~large)
    ends = np.repeat(np.r_[first[1:], len(cell)], count)
    out = []
    for k in range(1, SMALL_CELL):
        at = small[small + k < ends[small]]
        if not len(at):
            break
        at = at[own[at] | own[at + k]]  # two of the class before meet in their own cells
        out.append(pd.DataFrame({"a": key[at], "b": key[at + k], "own_a": own[at], "own_b": own[at + k], "large": False}))
    if out:
        yield pd.concat(out).drop_duplicates()


def _close(batches: Iterator[pd.DataFrame], rule: Rule = RULE) -> Iterator[pd.DataFrame]:
    """Pairs that the counts let link."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(batch["n_a"], batch["n_b"], batch["counts_a"], batch["counts_b"], strict=True):
            apart = np.abs(np.frombuffer(x, dtype=np.uint8).astype(np.int16) - np.frombuffer(y, dtype=np.uint8)).sum()
            keep.append(rule.den * min(m, n) >= rule.num * max(m, n) and apart <= most_apart(m, n, rule))
        yield batch.loc[keep, ["a", "b"]]


class _Joined:
    """Which of some numbered things are tied already."""

    def __init__(self, many: int = 0) -> None:
        self.up = list(range(many))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def tie(self, x: int, y: int) -> bool:
        """Ties two; false if they were."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _tied(batches: Iterator[pd.DataFrame], rule: Rule = RULE) -> Iterator[pd.DataFrame]:
    """Ties (a, b) of the sets of large cells to pivots, and rows (cell in a, set in b, again)
    of sets that lie in no pivot's inner half. Rows come sorted by cell and chunk, pivots
    first; a chunk is in one task and of a bounded size."""
    for rows in _grouped(batches, ["cell", "chunk"]):
        cells, chunks = rows["cell"].to_numpy(), rows["chunk"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (chunks[1:] != chunks[:-1])])
        split = rows["split"].to_numpy()
        keys, pivot, own, counts = rows["key"].to_numpy(), rows["pivot"].to_numpy(), rows["own"].to_numpy(), rows["counts"].to_numpy()
        ties, again = [], []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            many = int(pivot[i:j].sum())
            all_counts = np.frombuffer(b"".join(counts[i:j]), dtype=np.uint8).reshape(j - i, -1).astype(np.int16)
            members = keys[i + many : j]
            if not split[i]:
                most = all_counts.shape[1] * rule.per_count
                ties += _led(all_counts, keys[i:j], most_apart(most, most, rule))
                continue
            # every size of the class lies below its upper bound
            most = all_counts.shape[1] * rule.per_count
            bound = most_apart(most, most, rule)
            near, core = _windows(all_counts[many:], all_counts[:many], bound)
            p = keys[i : i + many]
            group = _Joined(many)
            between = _windows(all_counts[:many], all_counts[:many], bound)[0]
            for x, y in zip(*np.nonzero(np.triu(between, 1)), strict=True):
                group.tie(int(x), int(y))
            root = np.array([group.find(x) for x in range(many)], dtype=np.int64)
            label = p[root] if many else p
            joined = _Joined(many)
            some = near.any(axis=1)
            first = near.argmax(axis=1) if many else np.zeros(len(members), dtype=np.int64)
            ties.append(np.stack((p[first[some]], members[some])))
            shared = np.triu(near.T.astype(np.float32) @ near.astype(np.float32) > 0, 1)
            more = [(p[x], p[y]) for x, y in zip(*np.nonzero(shared), strict=True) if joined.tie(int(x), int(y))]
            if more:
                ties.append(np.array(more, dtype=np.int64).T)
            left = np.flatnonzero(~core)
            if len(left):
                mine = np.where(some[left], label[first[left]], _NO_LABEL) if many else np.full(len(left), _NO_LABEL)
                again.append((np.full(len(left), cells[i]), members[left], own[i + many : j][left], mine))
        if not ties:
            continue
        a, b = np.concatenate(ties, axis=1)
        out = pd.DataFrame({"a": a, "b": b})
        yield out[out["a"] != out["b"]].drop_duplicates().assign(own=False, label=_NO_LABEL, again=False)
        if again:
            a, b, o, mine = (np.concatenate(x) for x in zip(*again, strict=True))
            yield pd.DataFrame({"a": a, "b": b, "own": o, "label": mine, "again": True})


def _led(x: np.ndarray, keys: np.ndarray, bound: int) -> list[np.ndarray]:
    """Ties of all sets of a cell: each is tied to a pivot that it lies in the window of, and
    pivots that share a set are tied. A set in no pivot's inner half is the next pivot."""
    out, pivots, used = [], np.zeros((16, x.shape[1]), dtype=x.dtype), 0
    of, root = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for k in range(0, len(x), 64):
        block = x[k : k + 64]
        apart = _apart(block, pivots[:used])
        left = np.flatnonzero(~(2 * apart <= bound).any(axis=1))
        between = _apart(block[left], block[left])
        done, fresh = np.zeros(len(left), dtype=bool), []
        for r in range(len(left)):
            if not done[r]:
                fresh.append(r)
                done |= 2 * between[r] <= bound
        if fresh:
            fresh = left[fresh]
            apart = np.concatenate((apart, _apart(block, block[fresh])), axis=1)
            while used + len(fresh) > len(pivots):
                pivots = np.concatenate((pivots, np.zeros_like(pivots)))
            pivots[used : used + len(fresh)] = block[fresh]
            of, root = np.r_[of, k + fresh], np.r_[root, np.arange(used, used + len(fresh))]
            used += len(fresh)
        near = 2 * apart <= 3 * bound
        first = near.argmax(axis=1)  # every row has one, its own if it is a pivot
        out.append(np.stack((keys[of[first]], keys[k : k + 64])))
        row, other = np.nonzero(near)
        while len(apart := np.flatnonzero(root[first[row]] != root[other])):
            a, b = first[row[apart[0]]], other[apart[0]]
            out.append(np.array([[keys[of[a]]], [keys[of[b]]]]))
            root[root == root[b]] = root[a]
            row, other = row[apart], other[apart]
    return out


def _windows(x: np.ndarray, pivots: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, which pivots lie within one and a half times the bound, and whether any lies within half of it."""
    apart = _apart(x, pivots)
    return 2 * apart <= 3 * bound, (2 * apart <= bound).any(axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L1 distances of each row of x to each of y, in memory of a few megabytes besides the result."""
    out = np.zeros((len(x), len(y)), dtype=np.int32)
    step = max(1, 500_000 // max(1, y.size))
    for k in range(0, len(x) if len(y) else 0, step):
        differ = x[k : k + step, None, :] - y[None]
        np.abs(differ, out=differ)
        out[k : k + step] = differ.sum(axis=2, dtype=np.int32)
    return out


def _copies(home: Column, parts: Column, pivot: Column) -> Column:
    """Where a row goes: a member to its own part, a pivot also to every part as a pivot."""
    member = F.array(F.struct(home.cast("int").alias("chunk"), F.lit(False).alias("pivot")))
    every = F.transform(F.sequence(F.lit(0), parts.cast("int") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("pivot")))
    return F.explode(F.when(pivot, F.concat(member, every)).otherwise(member))


def _draw(*cols) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(1 << 30)


def _waves(large: DataFrame, known: DataFrame) -> int:
    """In how many waves the rows (cell, key, own) of larger cells are dealt with their counts."""
    row = F.octet_length("counts") + ROW_BYTES
    here = large.groupBy("key", "own").agg(F.count(F.lit(1)).alias("here"))
    rows = here.join(known.select("key", "own", row.alias("row")).hint("merge"), ["key", "own"]).agg(F.sum(F.col("here") * F.col("row"))).first()[0] or 0
    return max(1, -(-rows // (WAVE * known.agg(F.sum(row)).first()[0])))


def _pair_waves(pairs: int, known: DataFrame) -> int:
    """In how many waves so many pairs of small cells are looked up with the counts of both."""
    total, many = known.agg(F.sum(F.octet_length("counts") + ROW_BYTES), F.count(F.lit(1))).first()
    return max(1, -(-2 * pairs // (WAVE * many))) if total else 1


def _in_wave(cell: Column, salt: str, wave: int, waves: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), cell), F.lit(waves)) == wave


def _meeting(cells: DataFrame, known: DataFrame, rule: Rule, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """Ties among sets that share cells (cell, key, own), and the rows that are to be dealt anew."""
    name, mark = f"met-{turn}", made_so_far(known.sparkSession)
    met = in_batches(cells.repartition("cell").sortWithinPartitions("cell", "key"), _meet, "a long, b long, own_a boolean, own_b boolean, large boolean")
    met = materialize(met.distinct(), name)
    free_shuffles(met.sparkSession)

    def side(s: str) -> DataFrame:
        return known.select(F.col("key").alias(s), F.col("own").alias(f"own_{s}"), F.col("n").alias(f"n_{s}"), F.col("counts").alias(f"counts_{s}")).hint("merge")

    spark, some = met.sparkSession, met.filter("NOT large")
    waves = _pair_waves(some.count(), known)
    pairs, kept = None, []
    for wave in range(waves):
        mine = some.filter(_in_wave(F.col("a"), "pairs", wave, waves))
        close = in_batches(mine.join(side("a"), ["a", "own_a"]).join(side("b"), ["b", "own_b"]), partial(_close, rule=rule), "a long, b long")
        kept.append(materialize(close, f"{name}-close"))
        free_shuffles(spark)
        pairs = kept[-1] if pairs is None else pairs.unionByName(kept[-1])
    large = met.filter("large").select(F.col("a").alias("cell"), F.col("b").alias("key"), F.col("own_b").alias("own"))
    sizes = materialize(large.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), f"{name}-sizes")
    total, keys = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not keys:
        drop_since(spark, mark, *kept)
        return pairs, None
    waves = _waves(large, known)
    tied = None
    for wave in range(waves):
        mine = _in_wave(F.col("cell"), "wave", wave, waves)
        rows = lookup(large.filter(mine), sizes.filter(mine), "cell", "size", total, keys).join(known.hint("merge"), ["key", "own"])
        chunks = F.ceil(F.col("size") / CHUNK)
        split = F.col("size") > CHUNK
        to = _copies(F.pmod(F.xxhash64("key"), chunks), chunks, split & (_draw(F.lit(turn), "key") * F.col("size") < PIVOTS))
        rows = rows.select("cell", "key", "own", "counts", split.alias("split"), to.alias("to")).select("cell", "to.chunk", "to.pivot", "key", "own", "counts", "split")
        rows = rows.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", F.desc("pivot"), "key")
        some = materialize(in_batches(rows, partial(_tied, rule=rule), "a long, b long, own boolean, label long, again boolean"), f"{name}-tied")
        kept.append(some)
        free_shuffles(spark)
        tied = some if tied is None else tied.unionByName(some)
    again = tied.filter("again").select(F.col("a").alias("cell"), F.col("b").alias("key"), "own", "label")
    # Sets of a cell that ties to the same group of pivots hold together need no more.
    apart = again.groupBy("cell").agg(F.count(F.lit(1)).alias("left"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = materialize(apart.filter((F.col("left") > 1) & ((F.col("low") < F.col("high")) | (F.col("low") == _NO_LABEL))).select("cell", "left"), f"{name}-apart")
    drop_since(spark, mark, apart, *kept)
    total, keys = apart.agg(F.sum("left"), F.count(F.lit(1))).first()
    again = lookup(again, apart, "cell", "left", total, keys).select("cell", "key", "own") if keys else None
    return pairs.unionByName(tied.filter("NOT again").select("a", "b")), again


def candidate_ties(docs: DataFrame, described: DataFrame, sets: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Ties (a, b) between the keys of sets, whose components hold all linked sets together."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("counts_own").alias("counts")), F.struct(F.lit(False).alias("own"), F.col("counts_next").alias("counts"))))
    known = described.filter("doc_id IS NOT NULL").select("key", "n", both.alias("x")).select("key", "n", "x.own", "x.counts").filter("counts IS NOT NULL")
    known = materialize(known.dropDuplicates(["key", "own"]), "counts")
    cells = in_batches(docs.filter("doc_id IS NOT NULL").select("text"), partial(_cell_rows, rule=rule), "cell long, key long, own boolean")
    spark = docs.sparkSession
    ties, again = _meeting(cells, known, rule, 0)
    shingles = known.agg(F.coalesce(F.sum(F.col("n") + SET_ROWS), F.lit(0))).first()[0]
    turn = 0
    while again is not None:
        turn += 1
        places = again.groupBy("key").agg(F.collect_set(F.struct("cell", "own")).alias("places"))  # no more than a set has slices
        places = places.join(sets.select("key", F.col("node").alias("doc_id"), "n").hint("merge"), "key").select("doc_id", "places", "n")
        places = materialize(places, "places")
        dealt = places.agg(F.sum(F.size("places") * (F.col("n") + SET_ROWS))).first()[0] or 0
        waves = max(1, -int(-dealt // (AGAIN * shingles)))
        # Texts are moved to their places once, and every wave reads them there.
        texts = materialize(docs.join(places.hint("merge"), "doc_id").select("text", "places"), "placed-texts")
        free_shuffles(spark)
        again = None
        for wave in range(waves):
            mine = F.filter("places", lambda p: _in_wave(p["cell"], "again", wave, waves))  # noqa: B023
            here = texts.select("text", mine.alias("places")).filter(F.size("places") > 0)
            cells = in_batches(here, partial(_again_rows, rule=rule, turn=turn), "cell long, key long, own boolean")
            more, left = _meeting(cells, known, rule, turn)
            ties = ties.unionByName(more)
            if left is not None:
                again = left if again is None else again.unionByName(left)
        drop_tables(spark, places, texts)
    return ties


class _Region:
    """Sets with an index of their shingles, the rarest first for each."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        by = np.argsort(flat, kind="stable")
        ordered = flat[by]
        self.first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        self.many = np.diff(np.r_[self.first, len(flat)])
        self.postings = of[by]
        self.number = np.empty(len(flat), dtype=np.int32)
        self.number[by] = np.repeat(np.arange(len(self.first), dtype=np.int32), self.many)
        self.rarest = self.number[np.lexsort((self.many[self.number], of))]
        self.mark = np.zeros(len(self.first), dtype=bool)

    def meeting(self, x: int, least: int) -> np.ndarray:
        """Sets that may share `least` shingles with x: all that do are in it."""
        rare = self.rarest[self.starts[x] : self.starts[x] + self.sizes[x] - least + 1]
        many = self.many[rare]
        at = np.repeat(self.first[rare] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.unique(self.postings[at])

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles of x each of these has."""
        mine = self.number[self.starts[x] : self.starts[x] + self.sizes[x]]
        self.mark[mine] = True
        many = self.sizes[others]
        begin = np.cumsum(many) - many
        at = np.repeat(self.starts[others] - begin, many) + np.arange(many.sum())
        both = np.add.reduceat(self.mark[self.number[at]].astype(np.int64), begin)
        self.mark[mine] = False
        return both


def star_links(ids: np.ndarray, sets: list[np.ndarray], rule: Rule = RULE) -> list[tuple[int, int]]:
    """Links among these documents, enough to connect what all links connect.

    Each document that is left is a pivot in turn, the largest first. Distances to it are
    counted for those that an index of the rarest shingles lets lie within twice the radius.
    """
    order = sorted(range(len(sets)), key=lambda i: (-len(sets[i]), ids[i]))
    ids, region = ids[order], _Region([sets[i] for i in order])
    sizes = region.sizes
    out: list[tuple[int, int]] = []
    joined, left, is_core = _Joined(len(ids)), np.ones(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
    wide = 2 * rule.num - rule.den
    for p in range(len(ids)):
        if not left[p]:
            continue
        left[p] = False
        others = region.meeting(p, -(-wide * int(sizes[p]) // rule.den))
        others = others[left[others]]
        if not len(others):
            continue
        both = region.shared(p, others)
        near = linked(both, sizes[others], sizes[p], rule)
        ring = others[~near & (rule.den * both >= wide * (sizes[others] + sizes[p] - both))]
        core = others[near]
        left[core] = False
        out += [(int(ids[p]), int(ids[x])) for x in core.tolist() if joined.tie(p, x)]
        if not len(core):
            continue
        is_core[core] = True
        for y in ring.tolist():
            if joined.find(y) == joined.find(p):
                continue
            close = region.meeting(y, -(-rule.num * int(sizes[y]) // rule.den))
            close = close[is_core[close]]
            if len(close):
                hit = linked(region.shared(y, close), sizes[close], sizes[y], rule)
                if hit.any():
                    joined.tie(p, y)
                    out.append((int(ids[y]), int(ids[close[np.argmax(hit)]])))
        is_core[core] = False
    return out


def _join_part(group: pd.DataFrame, rule: Rule = RULE) -> pd.DataFrame:
    group = group.drop_duplicates("doc_id")
    links = star_links(group["doc_id"].to_numpy(), list(shingle_sets(list(group["text"]), rule.width)), rule)
    if len(group) > CHUNK_DOCS:
        give_back()
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _voronoi(batches: Iterator[pd.DataFrame], rule: Rule = RULE) -> Iterator[pd.DataFrame]:
    """Rows of each document for its cell and for every cell whose window it lies in. Rows
    come sorted by region and chunk, pivots first."""
    names = ["region", "cell", "pivot_id", "doc_id", "n", "inside"]
    at, pivots = None, []
    for batch in batches:
        out = []
        sets = shingle_sets(list(batch["text"]), rule.width)
        for region, chunk, pivot, i, n, s in zip(*(batch[c] for c in ("region", "chunk", "pivot", "doc_id", "n")), sets, strict=True):
            if (region, chunk) != at:
                at, pivots = (region, chunk), []
            if pivot:
                pivots.append((i, s.copy()))
                continue
            sizes = np.array([len(p) for _, p in pivots])
            both = np.array([(p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum() for _, p in pivots])
            far = 1.0 - both / (sizes + len(s) - both)
            for k in np.flatnonzero(far <= far.min() + 2.0 * (1.0 - rule.num / rule.den) + 1e-9).tolist():
                out.append((region, k, pivots[k][0], i, n, bool(linked(both[k], sizes[k], len(s), rule))))
        yield pd.DataFrame(out, columns=names)


def similar_links(docs: DataFrame, described: DataFrame, sets: DataFrame, part: int = PART, rule: Rule = RULE) -> DataFrame:
    """Links (a, b) between documents (doc_id, text) of different sets; sets: one row
    (key, node, n) for each distinct set, node its smallest id."""
    spark = docs.sparkSession
    mark = made_so_far(spark)
    groups = components(candidate_ties(docs, described, sets, rule), "candidates")
    drop_since(spark, mark, groups)
    regions = groups.withColumnsRenamed({"node": "key", "root": "region"})
    members = materialize(regions.join(sets.select("key", F.col("node").alias("doc_id"), "n").hint("merge"), "key").drop("key"), "members")
    drop_since(spark, mark, members)
    free_shuffles(spark)
    return region_links(docs, members, part, rule)


def region_links(docs: DataFrame, members: DataFrame, part: int = PART, rule: Rule = RULE) -> DataFrame:
    """Links (a, b) that connect the same documents (doc_id, text) of a region as all links
    within it do. members: doc_id, n (size of its set) and region."""
    weights = members.groupBy("region").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))
    weights = materialize(weights.filter("docs > 1"), "weights")
    total, keys = weights.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count(F.lit(1))).first()
    parts = F.ceil(F.col("weight") / part)
    more = F.least(parts - 1, F.lit(PIVOTS - 1))  # besides the first document
    pivot = (F.col("doc_id") == F.col("first")) | (_draw(F.lit("pivot"), "doc_id") * F.col("docs") < more)
    placed = lookup(members, weights, "region", "docs", total, keys)
    # A region's documents are dealt over tasks; each chunk of a region gets its pivots.
    chunks = F.greatest(F.lit(1), F.least(F.ceil(F.col("weight") / CHUNK_SHINGLES), F.floor(F.col("docs") / CHUNK_DOCS)))
    placed = placed.select("region", "doc_id", "n", chunks.alias("chunks"), pivot.alias("pivot"))
    placed = docs.select("doc_id", "text").join(placed.hint("merge"), "doc_id")
    to = _copies(F.pmod(F.xxhash64("doc_id"), "chunks"), F.col("chunks"), F.col("pivot"))
    placed = placed.select("region", "doc_id", "n", "text", to.alias("to")).select("region", "to.chunk", "to.pivot", "doc_id", "n", "text")
    placed = placed.repartition("region", "chunk").sortWithinPartitions("region", "chunk", F.desc("pivot"), "doc_id")
    placed = in_batches(placed, partial(_voronoi, rule=rule), "region long, cell int, pivot_id long, doc_id long, n long, inside boolean")
    placed = materialize(placed, "voronoi")
    free_shuffles(docs.sparkSession)
    spokes = placed.filter("inside AND doc_id != pivot_id").select(F.col("pivot_id").alias("a"), F.col("doc_id").alias("b"))

    # A cell with nothing outside its radius is done. Where a cell is too large for a task,
    # every pair of parts of which one at least lies outside is a task.
    placed = placed.select(F.struct("region", "cell").alias("place"), "doc_id", "n", "inside")
    plan = placed.groupBy("place").agg(F.count(F.lit(1)).alias("here"), *(F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(n) for n, x in (("out_n", ~F.col("inside")), ("in_n", F.col("inside")))))
    whole = F.col("out_n") + F.col("in_n") <= part
    plan = plan.filter("here > 1 AND out_n > 0").select("place", "here", F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("out_n") / part)).cast("int").alias("outs"), F.when(whole, F.lit(0)).otherwise(F.ceil(F.col("in_n") / part)).cast("int").alias("ins"))
    plan = materialize(plan, "plan")
    rows = lookup(placed, plan, "place", "here", *plan.agg(F.coalesce(F.sum("here"), F.lit(0)), F.count(F.lit(1))).first())
    within = F.col("inside") & (F.col("ins") > 0)
    mine = F.when(within, F.col("outs") + F.pmod(F.xxhash64("doc_id"), F.greatest("ins", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("outs"))).cast("int")
    others = F.when(within, F.sequence(F.lit(0), F.col("outs") - 1)).otherwise(F.sequence(F.lit(0), F.col("outs") + F.col("ins") - 1))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    rows = rows.select(F.concat_ws("/", "place.region", "place.cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "doc_id")
    rest = docs.select("doc_id", "text").join(rows.hint("merge"), "doc_id").groupBy("task").applyInPandas(lambda group: _join_part(group, rule), "a long, b long")
    return spokes.unionByName(rest)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(in_batches(rows, partial(_describe, rule=rule), "doc_id long, n long, digest binary, key long, counts_own binary, counts_next binary"), "described")
    meta = described.select("doc_id", "n", "digest", "key")
    sets = meta.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    sets = materialize(sets, "sets")
    mark = made_so_far(docs.sparkSession)
    links = materialize(similar_links(rows, described, sets.filter("node IS NOT NULL"), part, rule), "links")
    drop_since(docs.sparkSession, mark, links)
    free_shuffles(docs.sparkSession)
    root = components(links, "links")
    table = materialize(sets.join(root.hint("merge"), "node", "left").select("digest", "weight", F.coalesce("root", "node").alias("root")), "roots")
    drop_since(docs.sparkSession, mark, table)
    total = table.agg(F.sum("weight")).first()[0] or 0
    found = lookup(meta.filter("n > 0"), table, "digest", "weight", total)
    component = F.when(F.col("doc_id").isNotNull(), F.col("root"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.unionByName(meta.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """docs without the documents that a component's smallest id stands for."""
    groups = similar_groups(docs, id_col, text_col, rule=rule)
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Explain one record as a cover by windows of the others: each round claims the window that explains most of what is left, within the copies that it has.

Rounds depend on each other, but only through how much each window still explains: the cluster adds that up, for guessed rounds too, and those that were guessed right come out of one pass.
"""

from __future__ import annotations

import math
from base64 import b64decode, b64encode
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.operators import packed
from kmerloom.operators.kmers import cut, near
from kmerloom.plans.tables import release, stored

#: Tile budgets, slices of the record, rounds, and the least share of the mass that a round must explain.
TILES, LEAST_TILES, LEAST_BP, FORCED_BP, FORCED_TILES, SLICES, ROUNDS, SHARE = 192, 16, 1024, 256, 8192, 96, 2048, 0.001
#: Rounds that a pass tries beforehand, numbers that it tells the driver, and rounds after which what they have left is written anew.
BATCH, MOST, AGAIN = 5, 200_000, 32
#: Bytes of blocks that a task holds at least and at most where tasks take rounds together, and rounds that they try at a time.
ALONE, HELD, TRIED = 24 << 20, 256 << 20, 3
#: Bases that are dealt out together, entries of a block, pairs that are painted at a time, and multipliers of the hash of a kind.
NEAR, BLOCK, PAINT = 1 << 21, 1 << 18, 1 << 19
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A block of kinds: how many, entries (a window that holds the kind) and places (a slice that has copies of it); the windows; of each kind its copies in the record, k-mers, whether several records hold it, and how many entries and places it has; of entries the number of the window in `ids` and copies; of places slice and copies.
STATE = "kinds int, entries int, ids binary, total binary, copies binary, several binary, size binary, w binary, n binary"
KINDS = STATE + ", places int, cells binary, slice binary, many binary, cut array<struct<slice: long, n: long>>"


def tile_width(other_bp: int, tile_bp: int | None = None, tiles: int = TILES, least_bp: int = LEAST_BP) -> int:
    if tile_bp and tile_bp > 0:
        return max(FORCED_BP, int(tile_bp), math.ceil(other_bp / FORCED_TILES))
    return max(least_bp, math.ceil(other_bp / max(LEAST_TILES, tiles)))


def slice_width(length: int, slices: int = SLICES) -> tuple[int, int]:
    """Bases of a slice of the record and how many slices that makes."""
    width = math.ceil(max(1, length) / max(1, min(slices, length)))
    return width, math.ceil(length / width) if length else 0


def species(kmers: DataFrame, axis: DataFrame, rec: int, tile_bp: int, slice_bp: int, stride: int, slices: int, k: int | None = None) -> DataFrame:
    """Kinds of the record's k-mers that windows of other records hold, in blocks (KINDS): those alike in copies and windows are one. cut has copies of all the record's k-mers by slice, those that no window holds too.

    kmers: pieces, of which canonical k-mers of k bases are taken, or a table with a row for each. A kind may be in several blocks.
    """
    sizes = axis.agg(F.max("rec").alias("rec"), F.sum("len").alias("bases")).first()
    groups, bases = slices + (sizes["rec"] + 1) * stride, sizes["bases"]
    placed = kmers.join(axis.select("rec", F.col("start").alias("base")), "rec")

    def number(rec_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rec_ == rec, at // slice_bp, slices + rec_ * stride + at // tile_bp)

    if "seq" in kmers.columns:
        lay = packed.layout(k, groups, bases)
        # Neighbours go to one task, where copies in a window are added up.
        rows = packed.packed(near(placed if "binary" in dict(kmers.dtypes)["seq"] else cut(placed, ("base",)), NEAR, ("rec",)), ["rec", "base"], lambda batch, row, place: number(batch.column("rec").to_numpy()[row], place - batch.column("base").to_numpy()[row]), lay, least=True, apart=NEAR)
    else:
        k = k or max(1, (int(kmers.agg(F.max("kv")).first()[0] or 0).bit_length() + 1) // 2)
        lay = packed.layout(k, groups, bases)
        rows = packed.packed_table(placed, lambda batch: number(batch.column("rec").to_numpy(), batch.column("pos").to_numpy() - batch.column("base").to_numpy()), lay)
    return stored(packed.dealt(rows).mapInArrow(_kinds(lay, slices, stride), KINDS), "cover-kinds")


def _alike(total: np.ndarray, first: np.ndarray, size: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each k-mer the number of its kind, and of each kind a k-mer. A hash finds kinds; where it is that of another kind, a k-mer is a kind of its own."""
    mixed = (w.astype(np.uint64) * MIX[0] ^ n.astype(np.uint64) * MIX[1]) * MIX[2]
    mixed = (mixed ^ mixed >> np.uint64(29)) * MIX[1]
    _, one, kind = np.unique(np.add.reduceat(mixed, first) + total.astype(np.uint64) * MIX[0], return_index=True, return_inverse=True)
    rep = one[kind]
    same = (total == total[rep]) & (size == size[rep])
    there = np.repeat(np.where(same, first[rep], first) - first, size) + np.arange(len(w))
    same &= np.logical_and.reduceat((w == w[there]) & (n == n[there]), first)
    other = np.flatnonzero(~same)
    kind[other] = len(one) + np.arange(len(other))
    return kind, np.append(one, other)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0, each in 1, 2, 4 or 8 bytes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(data: bytes, m: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // m}") if m else np.zeros(0, np.uint8)


class Block(NamedTuple):
    """Kinds with what windows hold of them: entries stand in the order of kinds."""

    ids: np.ndarray
    total: np.ndarray
    copies: np.ndarray
    several: np.ndarray
    size: np.ndarray
    w: np.ndarray
    n: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if r["kinds"]:
                own = [_wide(r[c], r["kinds"]).astype(np.int64) for c in ("total", "copies", "several", "size")]
                yield Block(np.frombuffer(r["ids"], np.int64), own[0], own[1], own[2].astype(bool), own[3], _wide(r["w"], r["entries"]), _wide(r["n"], r["entries"])), r


def _state_rows(total: np.ndarray, copies: np.ndarray, several: np.ndarray, size: np.ndarray, w: np.ndarray, n: np.ndarray, more=None) -> pa.RecordBatch:
    """Blocks of some BLOCK entries of kinds; w are the windows themselves. more: further columns of the kinds lo to hi."""
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]) if len(ends) else 0, BLOCK)), [0, len(size)]))
    rows = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = int(ends[lo] - size[lo]), int(ends[hi - 1])
        ids, at = np.unique(w[a:b], return_inverse=True)
        rows.append([hi - lo, b - a, ids.astype(np.int64).tobytes(), *[_narrow(x[lo:hi]) for x in (total, copies, several, size)], _narrow(at), _narrow(n[a:b]), *(more(lo, hi) if more else [])])
    names = [c.split()[0] for c in (KINDS if more else STATE).split(", ", 12)]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.int32(), *[pa.binary()] * 3][: 13 if more else 9]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names[: len(kinds)])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first one, as many as size says."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _kinds(lay: packed.Layout, slices: int, stride: int):
    cell = pa.list_(pa.struct([("slice", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kv, g, n in packed.buckets(batches, lay):
            begin = packed._starts(kv)
            which, own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(kv)))), g < slices
            total = np.bincount(which, np.where(own, n, 0), minlength=len(begin)).astype(np.int64)
            there = ~own & (total[which] > 0)
            w, m = g[there] - slices, n[there]
            first = packed._starts(which[there])
            hit, size = which[there][first], np.diff(np.append(first, len(w)))
            kind, rep = _alike(total[hit], first, size, w, m) if len(hit) else (hit, hit)
            of = np.full(len(begin), -1)
            of[hit] = kind
            inside = own & (of[which] >= 0)
            at, back = np.unique(of[which[inside]] * slices + g[inside], return_inverse=True)
            cells, many = np.bincount(at // slices, minlength=len(rep)), np.bincount(back, n[inside], minlength=len(at)).astype(np.int64)
            ends = np.append(0, np.cumsum(cells))
            part = lambda lo, hi: [int(ends[hi] - ends[lo]), _narrow(cells[lo:hi]), *[_narrow(x[ends[lo] : ends[hi]]) for x in (at % slices, many)]]  # noqa: E731, B023
            held = _spans(first[rep], size[rep])
            out = _state_rows(total[hit][rep], np.bincount(kind, minlength=len(rep)), w[first[rep]] // stride != w[(first + size - 1)[rep]] // stride, size[rep], w[held], m[held], part)
            sums = np.bincount(g[own], n[own], minlength=0).astype(np.int64)
            cut_ = [{"slice": int(i), "n": int(sums[i])} for i in np.flatnonzero(sums)]
            if not out.num_rows:
                out = pa.RecordBatch.from_arrays([pa.array([0 if pa.types.is_integer(f.type) else b""], f.type) for f in out.schema], names=out.schema.names)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([cut_, *[[]] * (out.num_rows - 1)], cell)], names=[*out.schema.names, "cut"])

    return run


def _again(order: np.ndarray):
    """Blocks of what claims have left. Windows that take nothing from each other, as a kind has copies enough for all, stand apart: what only they hold is one kind for each.

    A claim takes as much as the window has or is left, so what is left does not depend on the order of claims.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches):
            row, n, rows = block.row, block.n.astype(np.int64), len(block.total)
            gone = np.isin(block.ids, order)[block.w]
            left = np.maximum(block.total - np.bincount(row[gone], n[gone], minlength=rows).astype(np.int64), 0)
            room = np.where(gone, 0, np.minimum(n, left[row]))
            free = (np.bincount(row, room, minlength=rows) <= left)[row]
            alone = np.bincount(block.w[free].astype(np.int64) * 2 + block.several[row[free]], (room * block.copies[row])[free], minlength=2 * len(block.ids)).astype(np.int64)
            keep, hit, one = ~free & (room > 0), np.flatnonzero(alone), np.ones(np.count_nonzero(alone), np.int64)
            size = np.bincount(row[keep], minlength=rows)
            held = size > 0
            parts = [(left[held], one), (block.copies[held], alone[hit]), (block.several[held], hit % 2 > 0), (size[held], one), (block.ids[block.w[keep]], block.ids[hit // 2]), (room[keep], one)]
            yield _state_rows(*[np.concatenate(x) for x in parts])

    return run


def _trial(order: np.ndarray, guess: np.ndarray, whole: bool):
    """w, contested, g0 and g1, g2, ...: what windows that aren't claimed explain of what is left (only if `whole`), and how much less they do after each of the claims `guess`; of a guessed window, how much of its claim records contest. Only kinds that guessed windows hold are looked at if not `whole`."""
    names = ["w", "contested", *(f"g{i}" for i in range(len(guess) + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = np.zeros(0, np.int64), np.zeros((len(names) - 1, 0), np.int64)
        for block, _ in _blocks(batches):
            many, ends = len(block.ids), np.cumsum(block.size)
            first, open_ = ends - block.size, ~np.isin(block.ids, order)
            told = np.zeros((len(names) - 1, many), np.int64)
            # 0: of no interest now, 1: claimed, from 2 on: guessed.
            mark = np.zeros(many, np.min_scalar_type(len(guess) + 2))
            mark[~open_] = 1
            for turn, pick in enumerate(guess):
                mark[block.ids == pick] = turn + 2
            marked = mark[block.w]
            at = np.flatnonzero(marked)
            of, row = marked[at], np.searchsorted(ends, at, "right")
            gone = of == 1
            left = np.maximum(block.total - np.bincount(row[gone], block.n[at[gone]], minlength=len(ends)).astype(np.int64), 0)
            if whole:
                every = block.row
                told[1] = np.where(open_, np.bincount(block.w, np.minimum(block.n, left[every]) * block.copies[every], minlength=many), 0)
            fell = np.zeros(many, np.int64)
            for turn in range(len(guess)):
                own = of == turn + 2
                rows, n = row[own], block.n[at[own]].astype(np.int64)
                take = np.minimum(n, left[rows])
                rows, take = rows[take > 0], take[take > 0]
                if len(rows):
                    i = int(block.w[at[own][0]])
                    told[0, i] = int((take * block.copies[rows])[block.several[rows]].sum())
                    size = block.size[rows]
                    held = _spans(first[rows], size)
                    w, n, old = block.w[held], block.n[held].astype(np.int64), np.repeat(left[rows], size)
                    less = (np.minimum(n, old) - np.minimum(n, old - np.repeat(take, size))) * np.repeat(block.copies[rows], size)
                    open_[i] = False
                    fell = fell + np.where(open_, np.bincount(w, less, minlength=many).astype(np.int64), 0)
                    left[rows] -= take
                told[turn + 2] = fell
            if len(new := np.setdiff1d(block.ids, known)):
                every = np.union1d(known, new)
                wider = np.zeros((len(names) - 1, len(every)), np.int64)
                wider[:, np.searchsorted(every, known)] = sums
                known, sums = every, wider
            sums[:, np.searchsorted(known, block.ids)] += told
        keep = sums.any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (known[keep], *sums[:, keep])], names=names)

    return run


def _together(ids: np.ndarray, rounds: int, least: float, batch: int):
    """turn, w, mass, contested of rounds: all tasks run at once, each with a part of the blocks in memory, and tell each other what they have of the next `batch` claims, which are guessed as in _rounds(), and what other windows lose by each. ids: all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        task = BarrierTaskContext.get()

        def added(own: np.ndarray) -> np.ndarray:
            return sum(np.frombuffer(b64decode(x), np.int64) for x in task.allGather(b64encode(own.tobytes()).decode())).reshape(own.shape)

        def claim(best: int, told: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Adds up what is contested, and what each window loses; returns what was left before."""
            before = []
            for at, left, block in held:
                i = int(np.searchsorted(at, best))
                here = np.flatnonzero(block.w == i) if i < len(at) and at[i] == best else at[:0]
                if not len(here):
                    continue
                ends = np.cumsum(block.size, dtype=np.int64)
                row = np.searchsorted(ends, here, "right")
                take = np.minimum(block.n[here], left[row]).astype(np.int64)
                row, take = row[take > 0], take[take > 0]
                copies, size, old = block.copies[row].astype(np.int64), block.size[row].astype(np.int64), left[row].astype(np.int64)
                told[0] += int((take * copies)[block.several[row]].sum())
                other = _spans(ends[row] - size, size)
                n, most = block.n[other].astype(np.int64), np.repeat(old, size)
                less = (np.minimum(n, most) - np.minimum(n, most - np.repeat(take, size))) * np.repeat(copies, size)
                told[1 + at] += np.bincount(block.w[other], less, minlength=len(at)).astype(np.int64)
                left[row] = old - take
                before.append((left, row, old))
            return before

        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        held, gains = [], np.zeros(len(ids), np.int64)
        for block, _ in _blocks(batches):
            at, row = np.searchsorted(ids, block.ids), block.row
            gains[at] += np.bincount(block.w, np.minimum(block.n, block.total[row]) * block.copies[row], minlength=len(at)).astype(np.int64)
            held.append((at, small(block.total), Block(at, block.total[:0], small(block.copies), block.several, small(block.size), block.w.copy(), block.n.copy())))
        gains, claims, fell = added(gains), [], {}
        while len(claims) < rounds:
            guess = _guessed(np.arange(len(ids)), gains, least, fell, min(batch, rounds - len(claims)))
            if not guess:
                break
            told = np.zeros((len(guess), 1 + len(ids)), np.int64)
            before = [claim(best, told[turn]) for turn, best in enumerate(guess)]
            told = added(told)
            fell |= {best: told[turn, 1:] for turn, best in enumerate(guess)}
            sure = 0
            while sure < len(guess) and gains.max() >= least and int(gains.argmax()) == guess[sure]:
                best = guess[sure]
                claims.append((int(ids[best]), int(gains[best]), int(told[sure, 0])))
                gains = np.where(gains < 0, -1, gains - told[sure, 1:])
                gains[best] = -1
                sure += 1
            for turn in range(len(guess) - 1, sure - 1, -1):
                for left, row, old in before[turn]:
                    left[row] = old
        claims = claims if task.partitionId() == 0 else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (range(len(claims)), *([c[i] for c in claims] for i in range(3)))], names=["turn", "w", "mass", "contested"])

    return run


def _slots(spark: SparkSession) -> int:
    """Tasks that run at once, 0 where that changes by itself."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _shares(order: np.ndarray, stride: int):
    """rec, place, mass: what a record's claims have taken of the kinds, by slices of the record that is explained."""
    ranked = np.argsort(order, kind="stable")
    place_of = lambda ids: ranked[np.minimum(np.searchsorted(order[ranked], ids), len(order) - 1)] if len(order) else np.zeros(len(ids), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, r in _blocks(batches):
            done = np.isin(block.ids, order)[block.w]
            row, n, rank = block.row[done], block.n[done].astype(np.int64), place_of(block.ids)[block.w[done]]
            turn = np.argsort(row * len(order) + rank)
            row, n, rec = row[turn], n[turn], (order // stride)[rank[turn]]
            run_up = np.cumsum(n) - n
            opens = np.append(True, row[1:] != row[:-1])[: len(row)]
            before = run_up - np.maximum.accumulate(np.where(opens, run_up, 0)) if len(row) else run_up
            take = np.clip(block.total[row] - before, 0, n)
            row, rec, take = row[take > 0], rec[take > 0], take[take > 0]
            share = take / block.total[row]
            recs, rec = np.unique(rec, return_inverse=True)
            cells, slices, many = (_wide(r[c], r[m]).astype(np.int64) for c, m in (("cells", "kinds"), ("slice", "places"), ("many", "places")))
            first, size = np.cumsum(cells) - cells, cells[row]
            ends = np.cumsum(size)
            width = int(slices.max(initial=0)) + 1
            mass = np.zeros(len(recs) * width)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PAINT, int(ends[-1]) if len(ends) else 0, PAINT)), [0, len(row)])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = _spans(first[row[lo:hi]], size[lo:hi])
                mass += np.bincount(np.repeat(rec[lo:hi], size[lo:hi]) * width + slices[at], np.repeat(share[lo:hi], size[lo:hi]) * many[at], minlength=len(mass))
            hit = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(recs[hit // width]), pa.array(hit % width), pa.array(mass[hit])], names=["rec", "place", "mass"])

    return run


def _guessed(ids: np.ndarray, gains: np.ndarray, least: float, fell: dict[int, np.ndarray], n: int) -> list[int]:
    """The windows that are likely to be claimed next. fell: what windows took from the others when they were tried last; of those that weren't, nothing."""
    gains, out = gains.copy(), []
    while len(out) < n and len(gains) and gains.max() >= least:
        i = int(gains.argmax())
        out.append(int(ids[i]))
        gains -= fell.get(out[-1], 0)
        gains[i] = -1
    return out


def _rounds(kinds: DataFrame, mass: int, rounds: int, share: float, batch: int, most: int) -> list[tuple[int, int, int]]:
    """window, mass, contested of each round. A pass adds up how the gains of all windows fall with each of up to `batch` claims that are guessed. A guessed claim counts if its window is the best one of all at its turn, of equal ones the first; what comes after the first wrong guess is left out.

    The driver is told `most` numbers at most. Where there are more windows, those of the largest gains are told; gains only fall, so what the next window had at first bounds all others, and no claim counts that they may beat.

    Once all windows are known and what is left fits into the memory of as many tasks as run at once, HELD bytes in each, these take the remaining rounds together, without passes. Telling each other takes them a second, so less than ALONE bytes in each are left to passes.
    """
    claims: list[tuple[int, int, int]] = []
    slots = _slots(kinds.sparkSession)
    least, columns = max(1.0, share * mass), [c.split()[0] for c in STATE.split(", ")]
    state = stored(kinds.select(*columns).mapInArrow(_again(np.zeros(0, np.int64)), STATE), "cover-state")
    guess, written, ids, gains, fell = [], 0, None, None, {}
    while len(claims) < rounds:
        if len(claims) - written >= AGAIN:
            old, order = state, np.array([c[0] for c in claims[written:]], np.int64)
            state, written = stored(old.mapInArrow(_again(order), STATE), "cover-state"), len(claims)
            release(old)
        if gains is not None and len(claims) == written and len(ids) * slots * (batch + 1) <= most:
            size = state.agg(F.sum(sum([F.length(c) for c in columns[2:]], 4 * F.col("kinds")))).first()[0]
            if ALONE * slots <= size <= HELD * slots:
                rows = state.repartition(slots).mapInArrow(_together(ids, rounds - len(claims), least, min(batch, TRIED)), "turn long, w long, mass long, contested long", barrier=True).collect()
                claims += [(r["w"], r["mass"], r["contested"]) for r in sorted(rows, key=lambda r: r["turn"])]
                break
        order, told = np.array([c[0] for c in claims[written:]], np.int64), [f"g{i}" for i in range(len(guess) + 1)]
        sums = state.mapInArrow(_trial(order, np.array(guess, np.int64), gains is None), "w long, contested long, " + ", ".join(f"{g} long" for g in told)).groupBy("w").agg(*[F.sum(c).alias(c) for c in ("contested", *told)])
        beyond = None
        if gains is None:
            shown = max(1, most // (batch + 3), len(guess))
            rows = sums.filter("g0 > 0").orderBy(F.desc("g0"), "w").limit(shown + 1).collect()
            if len(rows) > shown:
                beyond = (-rows[shown]["g0"], rows[shown]["w"])
            rows = sorted(rows[:shown], key=lambda r: r["w"])
            ids, gains = np.array([r["w"] for r in rows], np.int64), np.array([r["g0"] for r in rows], np.int64)
        else:
            rows = sums.collect()
        less, contested = np.zeros((len(told), len(ids)), np.int64), {r["w"]: r["contested"] for r in rows}
        for r in rows:
            less[1:, np.searchsorted(ids, r["w"])] = [r[g] for g in told[1:]]
        start, sure = gains, len(gains) > 0
        for turn in range(len(told)):
            gains = np.where(gains < 0, -1, start - less[turn])
            best = int(gains.argmax()) if sure else 0
            sure = sure and gains[best] >= least and (beyond is None or (-gains[best], ids[best]) < beyond)
            if not sure or turn == len(guess) or ids[best] != guess[turn]:
                break
            claims.append((guess[turn], int(gains[best]), contested.get(guess[turn], 0)))
            gains[best] = -1
            if beyond is None:
                fell[guess[turn]] = less[turn + 1] - less[turn]
        for i in range(turn, len(guess)):
            fell[guess[i]] = less[i + 1] - less[i]
        if not sure and (beyond is None or -beyond[0] < least or turn == 0):
            break
        guess = _guessed(ids, gains, least, fell if beyond is None else {}, min(batch, rounds - len(claims))) if sure else []
        if beyond is not None:
            gains, fell = None, {}
    release(state)
    return claims


def gather(kmers: DataFrame, axis: DataFrame, rec: int, tile_bp: int | None = None, rounds: int = ROUNDS, share: float = SHARE, slices: int = SLICES, batch: int = BATCH, most: int = MOST, k: int | None = None) -> tuple[DataFrame, int, int]:
    """Rows of kind `claim` (record, window start, mass, contested), `paint` (record, slice, mass), `slice` (-1, slice, its mass) and `total` (truncated, mass); window and slice widths. kmers: pieces, of which canonical k-mers of k bases are taken, or a table with a row for each.

    No task holds the record: all k-mers are dealt out packed, once, and the record's stay a stored table of blocks, those alike in copies and windows as one kind. A pass over what claims have left of it tries `batch` rounds (_rounds()). The result is that of one round at a time.
    """
    sizes = axis.agg(F.sum("len").alias("all"), F.max(F.when(F.col("rec") == rec, F.col("len"))).alias("own"), F.max("len").alias("longest")).first()
    width = tile_width(max(1, sizes["all"] - sizes["own"]), tile_bp)
    slice_bp, n_slices = slice_width(sizes["own"], slices)
    stride = sizes["longest"] // width + 1
    kinds = species(kmers, axis, rec, width, slice_bp, stride, max(1, n_slices), k)
    cut_ = kinds.select(F.inline("cut")).groupBy("slice").agg(F.sum("n").alias("n")).collect()
    mass = sum(r["n"] for r in cut_)
    held = kinds.filter("kinds > 0")
    claims = _rounds(held, mass, rounds, share, batch, most)
    order = np.array([c[0] for c in claims], np.int64)
    painted = held.select(*[c.split()[0] for c in STATE.split(", ")], "places", "cells", "slice", "many").mapInArrow(_shares(order, stride), "rec long, place long, mass double")
    paint = stored(painted.groupBy("rec", "place").agg(F.sum("mass").alias("mass")), "cover-paint")
    release(kinds)
    told = [("claim", w // stride, w % stride * width, float(m), float(c)) for w, m, c in claims] + [("slice", -1, r["slice"], float(r["n"]), 0.0) for r in cut_] + [("total", -1, int(len(claims) == rounds), float(mass), 0.0)]
    rows = axis.sparkSession.createDataFrame(told, "kind string, rec long, place long, mass double, contested double")
    return rows.unionByName(paint.select(F.lit("paint").alias("kind"), "rec", "place", "mass", F.lit(0.0).alias("contested"))), width, slice_bp


def components(claims: DataFrame, axis: DataFrame, tile_bp: int) -> DataFrame:
    """rec, lo, hi, mass, contested of runs of neighbouring claimed windows of one record, to be read by mass downwards."""
    order = Window.partitionBy("rec").orderBy("place")
    rows = claims.filter("kind = 'claim'").withColumn("run", F.floor(F.col("place") / tile_bp) - F.row_number().over(order))
    runs = rows.groupBy("rec", "run").agg(F.min("place").alias("lo"), F.max("place").alias("last"), F.sum("mass").alias("mass"), F.sum("contested").alias("contested"))
    return runs.join(axis.select("rec", "len"), "rec").select("rec", "lo", F.least(F.col("last") + tile_bp, F.col("len")).alias("hi"), "mass", "contested")


def summary(components_: DataFrame, total: float, top: int = 8) -> DataFrame:
    """The heaviest components, the others as one row, and what is left unexplained, as shares of the mass."""
    named = components_.orderBy(F.desc("mass"), "rec", "lo").limit(top)
    named = named.select(F.row_number().over(Window.orderBy(F.desc("mass"), "rec", "lo")).alias("place"), "mass")
    both = components_.agg(F.sum("mass").alias("all"), F.count(F.lit(1)).alias("n")).join(named.agg(F.sum("mass").alias("top"), F.count(F.lit(1)).alias("m")))
    others = both.filter("n > m").select(F.lit(top + 1).alias("place"), (F.col("all") - F.col("top")).alias("mass"))
    rest = both.select(F.lit(top + 2).alias("place"), (F.lit(total) - F.coalesce("all", F.lit(0.0))).alias("mass"))
    named = named.unionByName(others)
    return named.unionByName(rest).withColumn("share", F.col("mass") / max(total, 1.0))


def strip(rows: DataFrame, totals: DataFrame, least: float = 0.02) -> DataFrame:
    """For each slice the record that explains most of it, and the share of the slice that is explained; shares up to `least` are not drawn. totals: slice, total (copies in it)."""
    paint = rows.filter("kind = 'paint'").groupBy("place").agg(F.max_by("rec", F.struct("mass", -F.col("rec"))).alias("rec"), F.sum("mass").alias("mass"))
    explained = F.least(F.lit(1.0), F.col("mass") / F.col("total"))
    return paint.join(totals, paint["place"] == totals["slice"]).select("slice", "rec", explained.alias("explained")).filter(F.col("explained") > least)

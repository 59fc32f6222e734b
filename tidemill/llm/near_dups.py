"""Near-duplicate documents by bottom-k sketches, inverted lists and exact Jaccard.

1. A document's set of word shingles is hashed by one function; its sketch is
   the K least hashes. Documents of equal sets form a class, one of which goes
   on.
2. Retained values form inverted lists. Sets of n and m shingles with Jaccard 0.8 or more share
   so many values of their sketches, T (exactly so where the sets are at most K;
   else the greater of a sure bound and one that fails with odds of 6e-5 at most for a pair that
   is just at 0.8), that they share one of the size - T + 1 that are rarest in the
   corpus. Only those are listed, for each band of sizes that a partner may have, so that
   T is close; a value that one class holds makes no list.
3. Rounds of stars: each list names a pivot, and each class is compared with PIVOTS pivots of its lists at most (the most
   central ones, then those of its shortest lists). Links are joined into components; only
   lists whose members are in different ones go on.
4. After the rounds, the members of each list left are compared across components inside tasks: by overlap counts
   of their sketches against T and by the sketch of the union against the threshold. Long lists are cut into
   chunks, each pair of chunks being one group. Only survivors leave a task, each from the first list that it shares.
5. The exact figure on the full sets decides on every pair that passes. No pair that passes goes unproved.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, exact, fresh, give_back, map_rows, parts_for, staged
from tidemill.llm.graph import components

WORDS, PERCENT, K, ROUNDS, PIVOTS = 5, 80, 160, 2, 4
#: Members of a list that meet in one task at most (twice as many where two chunks meet).
CHUNK = 2048
#: Standard deviations that shared sketch values may lie under their mean, ratio of a size band's ends, and how far under the threshold an estimate may lie.
SIGMAS, BAND, MARGIN = 4.3, 1.05, 0.15

SKETCHES = "rid long, doc_id long, n_shingles long, sig binary, sketch array<long>"


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        found = {b" ".join(w)}
    elif words == 2:
        found = {a + b" " + b for a, b in zip(w, w[1:])}
    else:
        found = set(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def _sketch(words: int, k: int, whole: bool):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        for rid, doc_id, text in docs:
            h = shingle_hashes(text, words)
            sig = xxhash.xxh3_128_digest(h.tobytes())
            signed = h.view(np.int64)
            yield (sig, signed.tolist()) if whole else (rid, doc_id, len(h), sig, signed[:k].tolist())

    return rows


def needed(n: int, m: int, percent: int, k: int) -> int:
    """Sketch values that linked sets of n and m shingles share at least."""
    common, most = -(-percent * (n + m) // (100 + percent)), max(n, m)
    if most <= k:
        return common
    part = common / most
    spread = math.sqrt(k * part * (1 - part) * (1 - k / most))
    return max(1, common - (most - k), int(k * part - SIGMAS * spread))


def band(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


@lru_cache(100_000)
def partner_bands(n: int, percent: int, k: int) -> tuple[tuple[int, int], ...]:
    """(band, values to list) for each band of sizes that a partner of a set of n may have."""
    least, most = -(-percent * n // 100), 100 * n // percent
    first, last = band(least), band(most)
    out = []
    for b in range(first, last + 1):
        lo = max(least, math.ceil(BAND**b - 1e-9) - 1)
        hi = min(most, math.floor(BAND ** (b + 1)) + 1)  # a little more than the band, whose ends are rounded
        if lo <= hi:
            out.append((b, min(n, k) - min(needed(n, m, percent, k) for m in {lo, hi, min(max(n, lo), hi)}) + 1))
    return tuple(out)


def _mixed(values: np.ndarray, low: int, high: int) -> np.ndarray:
    """Numbers of the lists of values for a pair of size bands."""
    x = values.view(np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(f"{low}:{high}"))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


class _Block:
    """Documents of a block that stand for their class, and the distinct values of their sketches by part and value."""

    def __init__(self, docs: pa.Table, cids: np.ndarray, k: int, parts: int):
        docs = docs.select(["rid", "n_shingles", "sketch"]).filter(np.isin(_numbers(docs.column("rid")), cids))
        self.cids, self.sizes = _numbers(docs.column("rid")), _numbers(docs.column("n_shingles"))
        self.lengths = np.minimum(self.sizes, k)
        sketches = docs.column("sketch").combine_chunks()
        self.values, self.at, self.counts = np.unique(sketches.flatten().to_numpy(), return_inverse=True, return_counts=True)
        self.part = (self.values.view(np.uint64) % np.uint64(parts)).astype(np.int64)  # the high bits of a sketch's values are small
        self.by_part = np.argsort(self.part, kind="stable")


def _ask(k: int, parts: int):
    """A block's distinct values and how many of its classes hold each, one row for each part of all values."""

    def rows(key: tuple, docs: pa.Table, classes: pa.Table) -> pa.Table:
        block = _Block(docs, _numbers(classes.column("cid")), k, parts)
        values, counts, part = (x[block.by_part] for x in (block.values, block.counts.astype(np.uint32), block.part))
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        out = ([part[a] for a, _ in spans], [key[0].as_py()] * len(spans), [values[a:b].tobytes() for a, b in spans], [counts[a:b].tobytes() for a, b in spans])
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "held", "counts"])

    return rows


def _tell(key: tuple, asked: pa.Table) -> pa.Table:
    """The classes of the corpus that hold each value, for each block that asked and in its order."""
    held = [np.frombuffer(x, np.int64) for x in asked.column("held").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in asked.column("counts").to_pylist()])
    _, at = np.unique(np.concatenate(held), return_inverse=True)
    dfs = np.minimum(np.bincount(at, counts), 0xFFFFFFFF).astype(np.uint32)[at]
    ends = np.cumsum([len(x) for x in held]).tolist()
    told = [dfs[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    return pa.table([asked.column("block"), asked.column("part"), pa.array(told, pa.binary()), pa.nulls(len(told), pa.int64())], ["block", "part", "dfs", "cid"])


def _listed(percent: int, k: int, parts: int):
    """The lists that a block's classes are in, from the classes (rows with a cid) and frequencies (the others) that it was told."""

    def rows(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(docs, _numbers(told.column("cid").drop_null()), k, parts)
        answers = told.filter(told.column("part").is_valid()).sort_by("part").column("dfs").to_pylist()
        df = np.zeros(len(block.values), np.int64)
        df[block.by_part] = np.frombuffer(b"".join(answers), np.uint32)
        owner = np.repeat(np.arange(len(block.cids)), block.lengths)
        df_of = df[block.at]
        shared = np.flatnonzero(df_of > 1)
        shared = shared[np.lexsort((block.at[shared], df_of[shared], owner[shared]))]  # each class's in order of their frequency
        values, dfs, kept = block.values[block.at[shared]], df_of[shared], np.bincount(owner[shared], minlength=len(block.cids))
        ends = np.concatenate([[0], np.cumsum(kept)])
        sums = np.concatenate([[0], np.cumsum(dfs)])
        central = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(block.lengths, 1)
        keys: list[np.ndarray] = []
        of: list[tuple[int, int, int]] = []  # row, side, entries
        for i, (n, a, b, lone) in enumerate(zip(block.sizes.tolist(), ends.tolist(), ends[1:].tolist(), (block.lengths - kept).tolist())):
            mine = band(n)
            for other, most in partner_bands(n, percent, k) if a < b else ():
                if most > lone:
                    keys.append(_mixed(values[a : min(a + most - lone, b)], min(mine, other), max(mine, other)))
                    of.append((i, 0 if other == mine else 1 if mine < other else 2, len(keys[-1])))
        row, side, entries = np.array(of, np.int64).reshape(-1, 3).T
        at = np.repeat(row, entries)
        out = (block.cids[at], np.concatenate([*keys, np.zeros(0, np.int64)]), np.repeat(side, entries).astype(np.int32), central[at])
        return pa.table([pa.array(c) for c in out], ["cid", "value", "side", "central"])

    return rows


def listed(docs: DataFrame, classes: DataFrame, parts: int, percent: int, k: int) -> DataFrame:
    """(cid, value, side, central): the lists (a value and a pair of size bands) that each class is in, and how common its values are.

    docs are bucketed by block and stay where they are: a block sends each of its values once, however many
    classes hold it, and is told their frequencies.
    """
    blocks = docs.groupBy("block")
    cids = classes.select(_block("cid", parts), "cid")
    asked = blocks.cogroup(cids.groupBy("block")).applyInArrow(_ask(k, parts), "part long, block long, held binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_tell, "block long, part long, dfs binary, cid long")
    told = told.unionByName(cids, allowMissingColumns=True)
    return blocks.cogroup(told.groupBy("block")).applyInArrow(_listed(percent, k, parts), "cid long, value long, side int, central double")


def _block(rid: str, parts: int) -> Column:
    """Twice as many blocks as buckets, as several may share one."""
    return F.pmod(F.xxhash64(rid), F.lit(2 * parts)).alias("block")


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of classes that link, as a staged table."""
    side = lambda df, x: df.select(*(F.col(c).alias(x if c == "cid" else f"{c}_{x}") for c in df.columns))
    near = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b")
    union = F.slice(F.array_sort(F.transform(F.array_union("sketch_a", "sketch_b"), lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))), 1, k)
    both = F.transform(F.array_intersect("sketch_a", "sketch_b"), lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    estimate = F.size(F.array_intersect(union, both)) >= F.size(union) * (percent / 100 - MARGIN)
    n, total = F.size(F.array_intersect("sketch_a", "sketch_b")), F.col("n_shingles_a") + F.col("n_shingles_b")
    whole = F.greatest("n_shingles_a", "n_shingles_b") <= k  # such sketches are the sets
    near = staged(near.select("a", "b", whole.alias("whole"), F.when(whole, n * 100 >= (total - n) * percent).otherwise(estimate).alias("ok")).where("ok").select("a", "b", "whole"), "near")
    full = near.where("not whole").join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    full = full.select("a", "b", common.alias("n"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    full = full.where(F.col("n") * 100 >= (F.col("sum") - F.col("n")) * percent).select("a", "b")
    links = staged(near.where("whole").select("a", "b").unionByName(full), "links")
    discard(near)
    return links


class _Holders:
    """Members by the values that they hold; those of member i are ranks[ends[i]:ends[i + 1]]."""

    def __init__(self, ends: np.ndarray, ranks: np.ndarray):
        self.ends, self.ranks = ends, ranks
        self.holders = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[np.argsort(ranks, kind="stable")]
        self.held = np.bincount(ranks)
        self.first = np.cumsum(self.held) - self.held

    def shared(self, i: int) -> np.ndarray:
        """How many of i's values each member holds; reads those who hold one, not all."""
        mine = self.ranks[self.ends[i] : self.ends[i + 1]]
        mine = mine[self.held[mine] > 1]
        n = self.held[mine]
        at = np.arange(n.sum()) + np.repeat(self.first[mine] - (np.cumsum(n) - n), n)
        return np.bincount(self.holders[at], minlength=len(self.ends) - 1)


class _Part:
    """Members of a list, or of two chunks of one: pairs across components that may link, as (part, a, b)."""

    def __init__(self, rows: pa.RecordBatch, percent: int, k: int):
        number = lambda c: rows.column(c).to_numpy()
        arrays = lambda c: (rows.column(c).offsets.to_numpy().astype(np.int64), rows.column(c).values.to_numpy())
        self.part, self.value, self.cid, self.root, self.side, self.chunk, self.size = map(number, ("part", "value", "cid", "root", "side", "chunk", "n_shingles"))
        (self.ends, values), (list_ends, lists) = arrays("sketch"), arrays("lists")
        _, self.ranks = np.unique(values[self.ends[0] : self.ends[-1]].view(np.uint64), return_inverse=True)  # ranks keep the order of values
        self.ends = self.ends - self.ends[0]
        self.sketches = _Holders(self.ends, self.ranks)
        # lists before this one in which members meet too: a pair leaves once, from its first. Two of a size band share lists for other bands too, which don't count
        lists, here = lists[list_ends[0] : list_ends[-1]], np.repeat(self.value, np.diff(list_ends))
        before = (lists < here) & ((lists & 1) == (here & 1))
        ends = np.concatenate([[0], np.cumsum(before)])[list_ends - list_ends[0]]
        self.before = _Holders(ends, np.unique(lists[before], return_inverse=True)[1])
        self.percent, self.k = percent, k

    def enough(self, i: int, others: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Which overlaps of sketches are at least needed()."""
        n = self.size[i] + self.size[others]
        most = np.maximum(self.size[i], self.size[others])
        least = -(-self.percent * n // (100 + self.percent))
        part = least / most
        spread = np.sqrt(self.k * part * (1 - part) * np.maximum(0, 1 - self.k / most))
        beyond = np.maximum(np.maximum(1, least - (most - self.k)), np.floor(self.k * part - SIGMAS * spread))
        return common >= np.where(most <= self.k, least, beyond)

    def near(self, i: int, j: int) -> bool:
        """By the sketch of the union, where sketches aren't whole sets."""
        if max(self.size[i], self.size[j]) <= self.k:
            return True
        a, b = (self.ranks[self.ends[x] : self.ends[x + 1]] for x in (i, j))
        union = np.sort(np.concatenate([a, b]), kind="stable")
        twice = np.flatnonzero(union[1:] == union[:-1])  # values of both
        distinct = len(union) - len(twice)
        size = min(self.k, distinct)
        # of the values of both, those among the union's least `size`: the t-th of them has place twice[t] - t
        return np.count_nonzero(twice - np.arange(len(twice)) < size) >= size * (self.percent / 100 - MARGIN)

    def pairs(self) -> Iterator[tuple[int, int, int]]:
        root, size = self.root.copy(), self.size
        _, of, members = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((self.cid, root, members[of]))  # the largest component last: its members are only partners
        for at, i in enumerate(order.tolist()):
            others = order[at + 1 :]
            others = others[(root[others] != root[i]) & ((self.side[others] != self.side[i]) | (self.side[i] == 0))]
            if self.chunk[i]:
                others = others[self.chunk[others] != self.chunk[i]]
            others = others[(100 * size[others] >= self.percent * size[i]) & (100 * size[i] >= self.percent * size[others])]
            if not len(others):
                continue
            others = others[self.enough(i, others, self.sketches.shared(i)[others])]
            if not len(others):
                continue
            for j in others[self.before.shared(i)[others] == 0].tolist():
                if root[i] != root[j] and self.near(i, j):
                    yield int(self.part[i]), int(self.cid[i]), int(self.cid[j])
                    if max(size[i], size[j]) <= self.k:  # whole sets: they do link
                        root[root == root[j]] = root[i]


class _Sets:
    """Members of a part with their whole sets: the pairs (part, cid, partner) of it that link."""

    def __init__(self, rows: pa.RecordBatch, percent: int, k: int):
        self.part, self.cid = rows.column("part")[0].as_py(), rows.column("cid").to_numpy()
        sets, self.partners = rows.column("set"), rows.column("partners").to_pylist()
        self.ends, self.values, self.percent = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64), percent

    def pairs(self) -> Iterator[tuple[int, int, int]]:
        place = {c: i for i, c in enumerate(self.cid.tolist())}
        of = lambda i: self.values[self.ends[i] : self.ends[i + 1]]
        for i, others in enumerate(self.partners):
            for other in others or ():
                a, b = of(i), of(place[other])
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common = np.count_nonzero(both[1:] == both[:-1])
                if 100 * common >= self.percent * (len(both) - common):
                    yield self.part, int(self.cid[i]), other


def _by_part(of: type[_Part] | type[_Sets], percent: int, k: int):
    """Batches sorted by part to the pairs that `of` makes of each part."""

    def done(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        part = rows.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        found = [p for a, b in zip(cuts, cuts[1:]) for p in of(rows.slice(a, b - a), percent, k).pairs()]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(3)], ["part", "a", "b"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            if kept and kept[-1].column("part")[-1].as_py() != part[0].item():
                yield done(kept)
                kept = []
            before = np.flatnonzero(part != part[-1])
            cut = int(before[-1]) + 1 if len(before) else 0  # rows from here on may go on in the next batch
            if cut:
                yield done([*kept, batch.slice(0, cut)])
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield done(kept)
        kept = []
        give_back()

    return parts


class _Search:
    """Links found so far, as roots: (id, root) of classes that link with others."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, percent: int, k: int):
        self.sketches, self.sets, self.percent, self.k = sketches, sets, percent, k
        self.roots: DataFrame | None = None

    def unsettled(self, lists: DataFrame) -> DataFrame:
        """Of (value, cid, side, central): the lists with members in different components, with root and the list's size m."""
        now = lists.select("value", "cid", "side", "central")
        if self.roots is None:
            now = now.withColumn("root", F.col("cid"))
        else:
            now = now.join(self.roots, now["cid"] == self.roots["id"], "left").withColumn("root", F.coalesce("root", "cid")).drop("id")
        sizes = now.groupBy("value").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("side").alias("s0"), F.max("side").alias("s1"))
        return now.join(sizes.where("r0 < r1 and (s1 = 0 or s0 <> s1)").select("value", "m"), "value")

    def rounds(self, lists: DataFrame) -> DataFrame | None:
        """Rounds of stars; the lists that are still unsettled, None if there are none. lists is discarded."""
        for step in range(ROUNDS + 1):
            now = staged(self.unsettled(lists), "unsettled")
            discard(lists)
            if now.isEmpty():
                discard(now)
                return None
            if step == ROUNDS:
                return now
            self.star(now, step)
            lists = now

    def star(self, now: DataFrame, step: int) -> None:
        """Compare each class with a few pivots of other components: the most central ones at step 0, else those of its shortest lists."""
        place = F.struct((-F.col("central")).alias("o"), "cid") if step == 0 else F.struct(F.xxhash64("cid", F.lit(step)).cast("double").alias("o"), "cid")
        pivots = now.groupBy("value").agg(F.min(F.struct(place.alias("place"), F.struct("root", "side").alias("of"))).alias("p"))
        pivots = pivots.select("value", F.col("p.place.o").alias("o"), F.col("p.place.cid").alias("pivot"), F.col("p.of.root").alias("pivot_root"), F.col("p.of.side").alias("pivot_side"))
        met = now.join(pivots, "value").where("root <> pivot_root and (side = 0 or side <> pivot_side)")
        met = met.groupBy("cid", "pivot").agg(F.min("o").alias("o"), F.min("m").alias("m"))
        best = F.struct("o", "pivot") if step == 0 else F.struct("m", "o", "pivot")
        met = met.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(best)), 1, PIVOTS).alias("best")).select("cid", F.explode("best.pivot").alias("pivot"))
        self.link(met.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct())

    def rest(self, now: DataFrame) -> None:
        """Compare all members of each list across components."""
        now = now.withColumn("value", F.when(F.col("side") == 0, F.col("value").bitwiseAND(F.lit(-2))).otherwise(F.col("value").bitwiseOR(F.lit(1))))  # odd: for two bands
        lists = now.groupBy("cid").agg(F.array_sort(F.collect_set("value")).alias("lists"))  # K times the size bands at most
        sizes = now.join(self.sketches.select("cid", "n_shingles"), "cid").groupBy("value").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("all"))
        chunks = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("all") / (CHUNK * 1024))).cast("int")
        rows = now.drop("m").join(sizes.select("value", chunks.alias("chunks")), "value").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(self.sketches.join(lists, "cid"), "cid")
        chunk = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        rows = rows.select(F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "value", "cid", "root", "side", chunk.alias("chunk"), "n_shingles", "sketch", "lists")
        sorted_parts = lambda df: df.repartition("part").sortWithinPartitions("part", "cid")
        pairs = staged(sorted_parts(rows).mapInArrow(_by_part(_Part, self.percent, self.k), "part long, a long, b long"), "pairs")
        # each set goes once to a part, however many of the part's pairs it is in
        ends = pairs.groupBy("part", F.col("a").alias("cid")).agg(F.collect_list("b").alias("partners"))  # a part's members at most
        others = pairs.select("part", F.col("b").alias("cid")).distinct()
        members = ends.join(others, ["part", "cid"], "full_outer").join(self.sets, "cid").select("part", "cid", "set", "partners")
        links = staged(sorted_parts(members).mapInArrow(_by_part(_Sets, self.percent, self.k), "part long, a long, b long").select("a", "b"), "links")
        discard(pairs)
        self.merge(links)

    def link(self, pairs: DataFrame) -> None:
        """Test pairs (a, b) and join the components of those that link."""
        pairs = staged(pairs, "pairs")
        links = _verified(pairs, self.sketches, self.sets, self.percent, self.k)
        discard(pairs)
        self.merge(links)

    def merge(self, links: DataFrame) -> None:
        """Join the components of staged links (a, b), and remove their table."""
        if not links.isEmpty():
            old = self.roots
            if old is None:
                self.roots = components(links)
            else:
                of = lambda x: old.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
                between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
                new = components(between)
                merged = new.select(F.col("id").alias("old"), F.col("root").alias("new"))
                moved = old.join(merged, old["root"] == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
                added = merged.join(old, merged["old"] == old["id"], "left_anti").select(F.col("old").alias("id"), F.col("new").alias("root"))
                self.roots = staged(moved.unionByName(added), "roots")
                discard(old)
                discard(new)
        discard(links)


def classes_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K, rid: str | None = None) -> DataFrame:
    """rid, doc_id, n_shingles and component (the least rid that links reach; null for an empty set) of every row, as a staged table.

    rid names a column of unique longs; without it rows are numbered.
    """
    docs = exact(docs)
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    rows = docs.select(number.cast("long").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = min(parts_for(docs), 100_000)  # Spark has no more buckets
    sketched = map_rows(rows, _sketch, SKETCHES, words, k, False)
    everything = staged(sketched.select("*", _block("rid", parts)), "sketches", by="block", parts=parts)
    classes = staged(everything.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("cid")), "classes")
    s = staged(everything.select("rid", "doc_id", "n_shingles", "sig"), "rows")
    drawn = staged(listed(everything, classes, parts, percent, k), "lists")
    meeting = drawn.groupBy("value").agg(F.count("*").alias("m"), F.min("side").alias("s0"), F.max("side").alias("s1")).where("m > 1 and (s1 = 0 or s0 <> s1)").select("value")
    lists = staged(drawn.join(meeting, "value", "left_semi"), "lists")
    discard(drawn)

    in_lists = lists.select(_block("cid", parts), "cid").distinct()
    reps = everything.withColumnRenamed("rid", "cid").join(in_lists, ["block", "cid"], "left_semi")
    involved = staged(reps.select("cid", "doc_id", "n_shingles", "sig", "sketch"), "involved")
    discard(everything)
    wanted = involved.select(F.col("doc_id").alias("wanted")).distinct()
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    hashed = map_rows(texts, _sketch, "sig binary, set array<long>", words, k, True)
    sets = staged(hashed.join(involved.select("sig", "cid"), "sig").groupBy("sig").agg(F.first("cid").alias("cid"), F.first("set").alias("set")).select("cid", "set"), "sets")

    search = _Search(involved.select("cid", "n_shingles", "sketch"), sets, percent, k)
    lists = search.rounds(lists)
    if lists is not None:
        search.rest(lists)
        discard(lists)
    discard(involved)
    discard(sets)
    by_sig = classes if search.roots is None else classes.join(search.roots, classes["cid"] == search.roots["id"], "left").select("sig", F.coalesce("root", "cid").alias("cid"))
    found = staged(s.join(by_sig, "sig", "left").select("rid", "doc_id", "n_shingles", F.col("cid").alias("component")), "components")
    for table in (s, classes, search.roots):
        if table is not None:
            discard(table)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included) and kept (whether that is its own).

    Texts are lower-cased (A-Z) and cut at ASCII white space. A null or empty text has an empty set and links
    with nothing. Repeated rows link with each other (unless empty); as kept compares ids, rows that repeat a kept id are
    all kept. A null doc_id counts as larger than any: alone it has a null component_id and is kept. A very long text is one set in one task.
    An empty table gives no rows. Other columns are left behind.
    """
    rows = classes_of(docs, words, percent, k)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low"))
    out = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the one of the least doc_id (null last), of equals the first as stored.

    Documents without words are in no group and stay. An empty table gives no rows. Column names of docs may be any, also those used here; of names that differ only in case the lower-case one counts.
    """
    names, docs = docs.columns, exact(docs)
    rid = fresh(docs, "near_rid")
    kept = staged(docs.withColumn(rid, F.monotonically_increasing_id()), "near-docs")
    rows = classes_of(kept, words, percent, k, rid)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")
    stay = rows.groupBy(F.coalesce("component", F.col("rid")).alias("group")).agg(F.min(rank).alias("r")).select(F.col("r.rid").alias("stay"))
    return kept.join(stay, kept[rid] == F.col("stay"), "left_semi").drop(rid).toDF(*names)

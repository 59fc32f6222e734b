"""Mixing sources to target weights, by fixed-length blocks and pseudorandom permutations.

Each source's words lie on one line in doc_id order, cut into blocks of BLOCK words. The mix is made of output shards
of SHARD_SLOTS slots, a block each. Every shard draws from a multinomial how many of its slots each source fills; the odds are
those that give each source its target on average, so a source's words differ from its target by the draw's error, about the root of
BLOCK * target words. A source's n-th slot, counted over shards, is mapped through its permutation of pass n div blocks to a block (a
Feistel network with cycle walking, keyed by seed, source and pass: nothing is stored), so a pass takes every block once before the
next begins; slots beyond `most` passes stay empty. Slots are joined with the documents' blocks by index.

Shards draw in tasks, each from a seed of its own. Only sums by source are on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import SPACES, WORD_RE, discard, exact, fresh, give_back, map_rows, parts_for, staged

WEIGHTS, TOTAL, MOST, BLOCK, SHARD_SLOTS, SEED = (5, 2, 1), 1.5, 2, 32, 4096, 17
#: Shards whose draws are summed before the sums of such groups are.
GROUP = 1024
#: Words of a block where the mix is made of documents again.
DOCUMENT_BLOCK = 256


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Words for each source: shares of total * sum(sizes) by weight; above most * size a target stops and the excess is shared anew."""
    out, left, active = [0.0] * len(sizes), total * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while active:
        unit = left / sum(weights[i] for i in active)
        above = [i for i in active if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(above)]
    return out


def permuted(at: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The pseudorandom permutation of 0..n-1 that key names, at the given places; back: its inverse, the places of given blocks."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    at = at.astype(np.uint64)
    keys = [np.uint64((key * 2654435761 + r * 0x9E3779B97F4A7C15) & (1 << 63) - 1 | 1) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in reversed(keys) if back else keys:
            known = left if back else right
            mixed = (known + k) * np.uint64(0xFF51AFD7ED558CCD)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
            bits = (mixed >> np.uint64(32)) & mask
            left, right = (right ^ bits, left) if back else (right, left ^ bits)
        return left << np.uint64(half) | right

    at = once(at)
    while len(out := np.flatnonzero(at >= n)):
        at[out] = once(at[out])
    return at.astype(np.int64)


def pass_key(seed: int, source: str, epoch: int) -> int:
    return zlib.crc32(f"{seed}:{epoch}:{source}".encode())


@dataclass
class Odds:
    """A source's blocks (the last has tail words) and the slots that give its target on average."""

    source: str
    n_blocks: int
    tail: int
    slots: float


def odds(source: str, size: int, target: float, block: int) -> Odds:
    n = -(-size // block)
    return Odds(source, n, size - (n - 1) * block if n else 0, target * n / size if size else 0.0)


def _draws(expected: list[float], keys: list[str], shard_slots: int, seed: int):
    """Each shard's draw: how many of its slots each source fills."""
    total = round(sum(expected))
    share = np.array(expected) / max(sum(expected), 1e-300)

    def rows(shards: Iterable[tuple]) -> Iterator[tuple]:
        for (shard,) in shards:
            drawn = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, total - shard * shard_slots), share)
            for s in np.flatnonzero(drawn).tolist():
                yield shard, keys[s], int(drawn[s])

    return rows


def _running():
    def rows(sorted_rows: Iterable[tuple]) -> Iterator[tuple]:
        part, last, before = TaskContext.get().partitionId(), None, 0
        for rid, key, size in sorted_rows:
            if key != last:
                last, before = key, 0
            yield rid, key, size, part, before
            before += size

    return rows


def _slots(block: int, seed: int):
    def rows(shards: Iterable[tuple]) -> Iterator[tuple]:
        for shard, key, first, count, n, tail in shards:
            at = np.arange(first, first + count)
            epochs, places = at // n, at % n
            for epoch in np.unique(epochs):
                mine = epochs == epoch
                blocks = permuted(places[mine], n, pass_key(seed, key, int(epoch)))
                words = np.where(blocks == n - 1, tail, block)
                for s, b, w in zip(at[mine].tolist(), blocks.tolist(), words.tolist()):
                    yield shard, s, key, b, int(epoch), w

    return rows


@dataclass
class Mix:
    """slots: shard, slot, source_key, block, epoch, words. spans: rid, shard, epoch, from_word, to_word drawn. sources: source_key, source_size, target. lines: rid, source_key, size, start. running: the staged table behind spans and lines."""

    slots: DataFrame
    spans: DataFrame
    sources: DataFrame
    lines: DataFrame
    running: DataFrame


def source_key(source: str = "source"):
    """Sources as keys that sort by code point with null last."""
    s = F.col(source).cast("string")
    return F.coalesce(F.concat(F.lit("0"), s), F.lit("1"))


def n_words(text: str = "text"):
    """White-space words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long")


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> Mix:
    """Draw a mix of rows (rid long and unique, source_key string, doc_id long, size long).

    Words of a source lie in doc_id order (ties by rid). Sources of no words give nothing. No row is
    drawn more than `most` times in full.
    """
    spark = rows.sparkSession
    order = [F.col("source_key"), F.col("doc_id"), F.col("rid")]
    dealt = rows.repartitionByRange(parts_for(rows), *order).sortWithinPartitions(*order)
    running = staged(map_rows(dealt.select("rid", "source_key", "size"), _running, "rid long, source_key string, size long, part int, before long"), "mix-lines")
    by_part = running.groupBy("part", "source_key").agg(F.sum("size").alias("words"))
    found = sorted((r["source_key"], int(r["words"])) for r in by_part.groupBy("source_key").agg(F.sum("words").alias("words")).collect())
    keys, sizes = [k for k, _ in found], [n for _, n in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(keys))], total, most)
    each = [odds(k, n, t, block) for k, n, t in zip(keys, sizes, wanted)]
    sources = spark.createDataFrame([(k, n, t, o.n_blocks, o.tail) for k, n, t, o in zip(keys, sizes, wanted, each)], "source_key string, source_size long, target double, n_blocks long, tail long")
    shards = -(-round(sum(o.slots for o in each)) // shard_slots)
    drawn = map_rows(spark.range(shards), _draws, "shard long, source_key string, n long", [o.slots for o in each], keys, shard_slots, seed)
    drawn = staged(drawn.withColumn("group", F.floor(F.col("shard") / GROUP)), "mix-shards")
    by_group = drawn.groupBy("source_key", "group").agg(F.sum("n").alias("all"))
    before = by_group.select("source_key", "group", (F.sum("all").over(Window.partitionBy("source_key").orderBy("group")) - F.col("all")).alias("base"))
    own = Window.partitionBy("source_key", "group").orderBy("shard")
    placed = drawn.withColumn("within", F.sum("n").over(own) - F.col("n")).join(before, ["source_key", "group"]).join(sources, "source_key")
    placed = placed.withColumn("first", F.col("base") + F.col("within")).withColumn("n", F.least("n", most * F.col("n_blocks") - F.col("first"))).where("n > 0")
    placed = placed.select("shard", "source_key", "first", "n", "n_blocks", "tail").repartition(max(1, min(shards, parts_for(rows))), "shard", "source_key")
    slots = map_rows(placed, _slots, "shard long, slot long, source_key string, block long, epoch int, words long", block, seed)
    bases = by_part.withColumn("base", F.sum("words").over(Window.partitionBy("source_key").orderBy("part")) - F.col("words")).drop("words")
    lines = running.join(bases, ["part", "source_key"]).select("rid", "source_key", "size", (F.col("before") + F.col("base")).alias("start"))
    end = F.col("start") + F.col("size")
    cells = lines.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * block), F.least(end, F.col("block") * block + F.col("words"))
    spans = cells.join(slots.select("source_key", "block", "shard", "epoch", "words").hint("merge"), ["source_key", "block"]).where(hi > lo).select("rid", "shard", "epoch", (lo - F.col("start")).alias("from_word"), (hi - F.col("start")).alias("to_word"))
    return Mix(slots, spans, sources.select("source_key", "source_size", "target"), lines, running)


def mixed_counts(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken, the words that the mix takes of it, and the first and last shard that hold some (null: none).

    A null text has no words and gives none; documents of a null source are a
    source of their own, last. Repeated rows are documents of their own. An
    empty table gives no rows. Runs over the same rows agree. A very long text lies on many blocks. Other columns are left behind.
    """
    docs = exact(docs)
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source_key"), n_words().alias("size"), F.monotonically_increasing_id().alias("rid")), "mix-sizes")
    m = mix(sized, **how)
    taken = m.spans.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = sized.join(taken, "rid", "left").join(m.sources, "source_key")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans with the white space between them; spans apart are joined by a line end."""
    ends, at, inside = [], 0, False
    starts: list[int] = []
    for at, c in enumerate(text):
        if (c in SPACES) == inside:
            (ends if inside else starts).append(at)
            inside = not inside
    if inside:
        ends.append(len(text))
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] >= a:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    if merged and merged[0][0] == 0 and merged[0][1] >= len(starts):
        return text
    return "\n".join(text[starts[a] : ends[b - 1]] for a, b in merged)


def mixed_documents(docs: DataFrame, block: int = DOCUMENT_BLOCK, **how) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each document and pass that drew words of it, whatever shards they went to.

    Its text is what was drawn (the whole text where all was); a column n_chars follows the text. Blocks are longer here, so that texts are
    cut in fewer places. Null and empty texts go; documents of a null source are a source of their own; repeated rows are documents of
    their own; an empty table gives no rows. Of names that differ only in case the lower-case one counts.
    """
    names = docs.columns
    docs = exact(docs)
    rid, spans = fresh(docs, "mix_rid"), fresh(docs, "mix_spans")
    kept = staged(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    m = mix(kept.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source_key"), n_words().alias("size"), F.col(rid).alias("rid")), block=block, **how)
    drawn = m.spans.groupBy("rid", "epoch").agg(F.collect_list(F.struct("from_word", "to_word")).alias(spans)).select(F.col("rid").alias(rid), spans)
    drawn = staged(drawn, "mix-spans")
    discard(m.running)

    @F.pandas_udf("string")
    def cut(texts, wanted):
        made = texts.combine(wanted, lambda t, w: cut_words(t, [(x["from_word"], x["to_word"]) for x in w]))
        give_back()
        return made

    out = kept.join(drawn, rid).withColumn("text", cut("text", spans)).drop(rid, spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).toDF(*names)

"""First-fit decreasing over a tournament tree, in randomised groups of documents.

Token ids of a document are cut into pieces of the sequence length and one
shorter rest. Full pieces are sequences already. Rests are dealt into random
groups of about ``group_size``, each small enough for one task however large
the corpus is; in a group they are placed in order of falling length into the
first sequence with room, which a tournament tree of capacities finds in
O(log n). What stays free at the end is at most about a sequence a group.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, staged, texts_of
from tidemill.llm.tokens import encoder

LENGTH, GROUP_SIZE = 2048, 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lone long, draw long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_LONE = 1 << 62


class FirstFit:
    """Sequences of one capacity; place(size) gives (sequence, offset) in the first one with room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.capacity = capacity
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        room, at = self.room, 1
        if not 0 < size <= room[1]:
            raise ValueError(f"no sequence has room for {size}")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found, offset


def _cut(path: str, end_id: int, length: int, with_ids: bool):
    encode, end = encoder(path).ids, struct.pack("<I", end_id)

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        task, n = TaskContext.get().partitionId(), 0
        for doc_id, text in docs:
            ids = encode(text or "") + end
            total = len(ids) // 4
            for start in range(0, total, length):
                part = ids[4 * start : 4 * (start + length)]
                n += 1
                draw = zlib.crc32(struct.pack("<qq", task, n)) << 31 | zlib.crc32(struct.pack("<qqq", n, doc_id or 0, start)) >> 1
                yield doc_id, start, len(part) // 4, zlib.crc32(part), total, task << 36 | n if len(part) == 4 * length else None, draw, part if with_ids else None

    return rows


def pack_group(rests: pd.DataFrame, length: int) -> pd.DataFrame:
    """One group's rests with the sequence (0, 1, ...) and offset of each."""
    rests = rests.sort_values(["length", "doc_id", "start", "draw"], ascending=[False, True, True, True], kind="stable")
    tree = FirstFit(len(rests), length)
    placed = [tree.place(int(n)) for n in rests["length"]]
    return rests.assign(bin=[p[0] for p in placed], offset=[p[1] for p in placed])


def _pack(length: int):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def packed(key: tuple, rests: pd.DataFrame) -> pd.DataFrame:
        out = pack_group(rests, length)
        out["sequence_id"] = (key[0] << 24) + out["bin"]
        return out[names]

    return packed


def sequences(packed: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """The sequences of packed pieces with ids: sequence_id, filled, n_pieces and ids, pieces in order of their offsets, padded.

    A sequence is padded with pad_id to the length, except where what fills it is a power of two of tokens: such
    lengths stay. A sequence has as many pieces as tokens at most, so a group is small. An empty table gives no rows.
    """
    made = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("filled"))
    joined = F.reduce("p", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["ids"]))
    full = F.expr(f"rpad(ids, {4 * length}, X'{struct.pack('<I', pad_id).hex()}')")
    out = made.select("sequence_id", "filled", F.size("p").cast("long").alias("n_pieces"), joined.alias("ids"))
    return out.withColumn("ids", F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("ids")).otherwise(full))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, group_size: int = GROUP_SIZE, with_ids: bool = True) -> DataFrame:
    """One row per piece: whose it is, where it starts there, its sequence and offset, and its ids (little-endian uint32).

    A null or empty text is its end id alone; a very long one becomes many pieces. Repeated rows are documents of
    their own. An empty table gives no rows. Other columns of docs are left behind. Pieces are staged first, so
    sequences are the same however often the result is read; their draw depends on the partition that a document is
    read in, so another split of the input packs otherwise (equal lengths go by doc_id, start and draw).
    """
    pieces = staged(map_rows(texts_of(docs), _cut, PIECES, tokenizer, end_id, length, with_ids), "pieces")
    rests = pieces.where(F.col("lone").isNull())
    groups = max(1, -(-rests.count() // group_size))
    in_groups = rests.withColumn("group", F.pmod(F.col("draw"), F.lit(groups)))
    packed = in_groups.groupBy("group").applyInPandas(_pack(length), PACKED)
    full = pieces.where(F.col("lone").isNotNull()).select(*[c.split()[0] for c in PACKED.split(", ")[:5]], (F.col("lone") + F.lit(_LONE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return packed.unionByName(full)

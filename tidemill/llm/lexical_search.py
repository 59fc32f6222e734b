"""Ranked lexical search by Fagin's threshold algorithm.

Documents are turned once into a forward index (doc_id, n, the terms of the query set that it holds, how often), a
staged table. Each task takes shards of it, sorts a list a term by impact and runs the algorithm for every item: rows of
all of the item's lists are taken round by round, each newly met document is scored in full from the forward index, and
the item is done once what an unmet document could still score, the sum of the lists' last impacts, is strictly below
the kth score. The best k of all shards hold the best k of all.

A sixteenth of the index goes first. Its kth scores are lower bounds for the rest, so that later shards stop
earlier and send few rows; documents that only equal a bound are kept. Rounds double in depth, so a shard needs few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tidemill.llm.common import discard, exact, map_rows, staged
from tidemill.llm.terms import ITEM_BYTES, item_blocks, word_pieces, words_of

K, FIRST_ROUND, WAVES = 50, 64, 16
#: Entries of the forward index that a shard holds, or one batch.
SHARD = 1 << 20

FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"


def _forward(shared):
    """A document's number of terms, and those of the vocabulary with their counts."""

    def run(rows):
        get = shared.value.get
        for doc_id, text in rows:
            n, found = 0, {}
            for piece in word_pieces(text):
                n += len(piece)
                for t in map(get, piece):
                    if t is not None:
                        found[t] = found.get(t, 0) + 1
            terms = sorted(found)
            yield doc_id, n, terms, [found[t] for t in terms]

    return run


class Query:
    """Items of a block by their terms, with the weights that whole documents give."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.terms = [sorted({self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)}) for _, text in items]

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        self.floor = np.zeros(len(self.ids), np.int64)


class Shard:
    """Part of the forward index with its impact-sorted lists."""

    def __init__(self, query: Query, ids: np.ndarray, blank: np.ndarray, n: np.ndarray, first: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.ids, self.blank, self.first, self.terms = ids, blank, first, terms
        of = np.repeat(np.arange(len(ids)), np.diff(first))
        top = int(n.max(initial=0))
        grown = 50 * n * query.n_docs if 50 * top * query.n_docs < 1 << 62 else 50 * n.astype(object) * query.n_docs
        m = (50 + grown // max(1, query.n_terms)).astype(np.int64)
        tf = counts.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[of])
        order = np.lexsort((-self.impact, terms))
        self.docs, self.falling = of[order], self.impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(query.vocabulary) + 1))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores by random access: the documents' own rows of the forward index."""
        count = self.first[docs + 1] - self.first[docs]
        begin = np.cumsum(count) - count
        at = np.arange(int(count.sum())) + np.repeat(self.first[docs] - begin, count)
        return np.add.reduceat(weight[self.terms[at]] * self.impact[at], begin)

    def best(self, terms: np.ndarray, weight: np.ndarray, top: tuple, k: int, floor: int, first_round: int = FIRST_ROUND) -> tuple:
        """The best k of `top` and this shard: (score, blank, id) arrays in order; none below floor."""
        terms = terms[(self.lists[terms + 1] > self.lists[terms]) & (weight[terms] > 0)]
        lo, hi, w = self.lists[terms], self.lists[terms + 1], weight[terms]
        met, depth, step = np.zeros(len(self.ids), bool), 0, first_round
        while len(terms):
            count = np.clip(hi - lo - depth, 0, step)
            rows = np.arange(int(count.sum())) + np.repeat(lo + depth - (np.cumsum(count) - count), count)
            docs = self.docs[rows]
            docs = np.unique(docs[~met[docs]])
            met[docs] = True
            if len(docs):
                score = self.scores(docs, weight)
                docs, score = docs[score >= max(floor, 1)], score[score >= max(floor, 1)]
                if len(top[0]) == k:
                    docs, score = docs[score >= top[0][-1]], score[score >= top[0][-1]]
                score, blank, ids = (np.concatenate(x) for x in zip(top, (score, self.blank[docs], self.ids[docs])))
                order = np.lexsort((ids, blank, -score))[:k]
                top = (score[order], blank[order], ids[order])
            depth, step = depth + step, step * 2
            still = hi - lo > depth
            if not still.any():
                break
            unmet = int((w[still] * self.falling[lo[still] + depth - 1]).sum())
            if unmet < floor or len(top[0]) == k and unmet < top[0][-1]:
                break
        return top


_NONE = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def _shards(batches: Iterator[pa.RecordBatch], query: Query) -> Iterator[Shard]:
    held, size = [], 0
    for b in batches:
        terms = b.column("terms")
        held.append(b)
        size += len(terms.flatten())
        if size >= SHARD:
            yield _shard(held, query)
            held, size = [], 0
    if held:
        yield _shard(held, query)


def _shard(batches: list[pa.RecordBatch], query: Query) -> Shard:
    t = pa.Table.from_batches(batches).combine_chunks()
    col = lambda c: t.column(c).combine_chunks()
    length = np.asarray(col("terms").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    first = np.concatenate([[0], np.cumsum(length)])
    ids = col("doc_id")
    return Shard(query, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), col("n").to_numpy(zero_copy_only=False), first, col("terms").flatten().to_numpy(), col("counts").flatten().to_numpy())


def _best(index: DataFrame, shared, k: int, schema: StructType) -> DataFrame:
    """The best k of each task and item."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: Query = shared.value
        tops = [_NONE] * len(query.ids)
        weight = np.zeros(len(query.vocabulary), np.int64)
        for shard in _shards(batches, query):
            for i, terms in enumerate(query.terms):
                own = np.array(terms, np.int64)
                weight[own] = query.weight[own]
                tops[i] = shard.best(own, weight, tops[i], k, int(query.floor[i]))
                weight[own] = 0
        for i, (score, blank, ids) in enumerate(tops):
            if len(score):
                cols = [pa.array([i] * len(score), pa.int32()), pa.array([query.ids[i]] * len(score), arrow.field("item_id").type), pa.array(ids, pa.int64(), mask=blank), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return index.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, waves: int = WAVES, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score above 0 for each item (item_id, text), exactly.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that have a term and L
    terms in all, a document of n terms has m = 50 + (50 n N) div L; a term that df documents hold weighs w =
    floor(1000 ln((2N + 2) / (2 df + 1))) and adds w ((10^9 tf) div (1000 tf + 20 m)), once however often the item has it.

    Equal scores go by ascending doc_id, null ids last. Null and empty texts have no terms: such documents are never found, such items find
    nothing. Repeated document rows are documents of their own; repeated item rows are one, rows of one id with other texts are ranked apart.
    Empty tables give no rows. Other columns are left behind; of names that differ only in case the lower-case one counts. A long text is read in pieces.

    Items come in blocks of a checked size (terms.item_blocks), each with its own pass over documents.
    """
    docs, items = exact(docs), exact(items)
    spark = docs.sparkSession
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType), StructField("doc_id", LongType()), StructField("score", LongType())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, block_bytes):
        ranked = _ranked(rows, Query(block), k, waves, schema, spark)
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], schema).selectExpr("item_id", "item as rank", "doc_id", "score") if out is None else out


def _ranked(rows: DataFrame, query: Query, k: int, waves: int, schema: StructType, spark) -> DataFrame:
    index = staged(map_rows(rows, _forward, FORWARD, spark.sparkContext.broadcast(query.vocabulary)), "forward-index")
    n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a number a term of the block
    query.weigh(n_docs, n_terms, {r[0]: r[1] for r in df})
    wave = F.pmod(F.xxhash64("doc_id", "n"), F.lit(waves))
    first = staged(_best(index.where(wave == 0), spark.sparkContext.broadcast(query), k, schema), "first-wave")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for item, score in first.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("item", "score").collect():  # one number an item
        query.floor[item] = score
    rest = staged(_best(index.where(wave != 0), spark.sparkContext.broadcast(query), k, schema), "other-waves")
    discard(index)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

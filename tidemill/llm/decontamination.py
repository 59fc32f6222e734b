"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A record is a window of consecutive words of a benchmark item (an item with fewer words is one record), a set of
word shingles. All documents are counted first, which orders each record's shingles by rarity. A record of s
shingles that shares at least `need` of them with some text must share one of its s - need + 1 rarest: only this
prefix is looked up in documents. What is met is held to length and place (the record's window has to lie within the
document around the shingle, and the rank of the shingle in the prefix has to leave `need` to share), and the words
themselves decide.

Items are broadcast in blocks of a checked size (terms.item_blocks); documents are read twice a block and only counts
are shuffled. A task holds CHUNK words of documents, or one document.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import exact, fresh, map_rows, staged
from tidemill.llm.terms import ITEM_BYTES, item_blocks, word_pieces, words_of

WINDOW, WIDTH = 10, 3
#: Words of documents that are searched at once.
CHUNK = 1 << 20
#: Candidate windows that are verified at once.
AT_ONCE = 1 << 18

FOUND = "row_id long, n_words long, spans array<struct<start: long, length: long>>, item_ids array<string>"


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit mark of each run of `width` ids along the last axis; 0 where a run holds id 0."""
    n = ids.shape[-1] - width + 1
    if n <= 0:
        return np.zeros((*ids.shape[:-1], 0), np.uint64)
    mark, whole = np.zeros((*ids.shape[:-1], n), np.uint64), np.ones((*ids.shape[:-1], n), bool)
    for i in range(width):
        part = ids[..., i : i + n]
        mark = (mark ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
        whole &= part > 0
    return np.where(whole, mark | np.uint64(1), np.uint64(0))


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each element is of, and the elements first, first + 1, ... of all ranges."""
    of = np.repeat(np.arange(len(first)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


class Records:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple], window: int, width: int, share: float):
        self.share, self.vocabulary = share, {}
        texts: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            long = min(window, len(ids))
            for i in range(len(ids) - long + 1 if long else 0):
                texts.setdefault(tuple(ids[i : i + long]), set()).add("" if item_id is None else str(item_id))
        self.words = np.zeros((len(texts), window), np.int64)
        for r, ids in enumerate(texts):
            self.words[r, : len(ids)] = ids
        self.length = np.array([len(t) for t in texts], np.int64)
        self.width = np.minimum(self.length, width)
        self.names = sorted({x for ids in texts.values() for x in ids})
        place = {x: i for i, x in enumerate(self.names)}
        self.item_count = np.array([len(x) for x in texts.values()], np.int64)
        self.item_first = np.cumsum(self.item_count) - self.item_count
        self.item = np.array([place[x] for ids in texts.values() for x in sorted(ids)], np.int64)
        self.widths = sorted(set(self.width.tolist()))
        self.sets = [np.unique(_shingles(self.words[r, :n], w)) for r, (n, w) in enumerate(zip(self.length.tolist(), self.width.tolist()))]
        self.need = np.array([max(1, math.ceil(share * len(s) - 1e-9)) for s in self.sets], np.int64)
        #: All shingles by width, sorted; a shingle's number is its place in `known` after those of smaller widths.
        self.known = {w: np.unique(np.concatenate([s for s, v in zip(self.sets, self.width) if v == w])) for w in self.widths}

    def ids(self, text: bytes | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in piece), np.int64, len(piece)) for piece in word_pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Lists the prefix of every record by shingle: (record, the shingle's first place in it)."""
        lists: dict[int, list[tuple]] = {w: [] for w in self.widths}
        for r, (s, w) in enumerate(zip(self.sets, self.width.tolist())):
            of = [counts.get((w, i), 0) for i in np.searchsorted(self.known[w], s).tolist()]
            marks = _shingles(self.words[r, : self.length[r]], w)
            ranked = sorted(zip(of, s.tolist()))
            for _, mark in ranked[: len(s) - int(self.need[r]) + 1]:
                lists[w].append((mark, r, int(np.flatnonzero(marks == np.uint64(mark))[0])))
        self.prefix = {}
        for w, entries in lists.items():
            entries.sort()
            marks, first, count = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True, return_counts=True)
            self.prefix[w] = (marks, first, count, np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64))


def _at(known: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that are known, and which of the known they are."""
    here = np.flatnonzero(marks)
    at = np.minimum(np.searchsorted(known, marks[here]), len(known) - 1)
    good = known[at] == marks[here]
    return here[good], at[good]


def _chunks(rows: Iterable[tuple], records: Records) -> Iterator[tuple]:
    """(keys, ids of all words with a 0 after each document, first places, lengths) of about CHUNK words."""
    keys, parts, size = [], [], 0
    for key, text in rows:
        ids = records.ids(text)
        keys.append(key)
        parts.append(ids)
        size += len(ids) + 1
        if size >= CHUNK:
            yield keys, *_joined(parts)
            keys, parts, size = [], [], 0
    if keys:
        yield keys, *_joined(parts)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(length + 1) - length - 1
    ids = np.zeros(int(length.sum()) + len(parts), np.int64)
    for p, at in zip(parts, first):
        ids[at : at + len(p)] = p
    return ids, first, length


def _count(shared):
    """(width, shingle, n): occurrences in this task's documents of the shingles that records have."""

    def run(rows):
        records: Records = shared.value
        total = {w: np.zeros(len(k), np.int64) for w, k in records.known.items()}
        for _, ids, _, _ in _chunks(rows, records):
            for w, known in records.known.items():
                total[w] += np.bincount(_at(known, _shingles(ids, w))[1], minlength=len(known))
        for w, n in total.items():
            for i in np.flatnonzero(n).tolist():
                yield w, i, int(n[i])

    return run


def _verified(records: Records, ids: np.ndarray, r: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the window of ids at start holds record r: its words in order, or (share below 1) enough of its shingles."""
    if records.share >= 1:
        at = start[:, None] + np.arange(records.words.shape[1])
        same = ids[np.minimum(at, len(ids) - 1)] == records.words[r]
        return (same | (np.arange(records.words.shape[1]) >= records.length[r][:, None])).all(1)
    return np.array([len(np.intersect1d(records.sets[x], _shingles(ids[s : s + records.length[x]], int(records.width[x])))) >= records.need[x] for x, s in zip(r.tolist(), start.tolist())], bool)


def _occurrences(records: Records, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[tuple]:
    """(document, record, start) of every occurrence; an occurrence that several shingles lead to comes more than once."""
    for w, (marks, at, count, of_record, offset) in records.prefix.items():
        place, which = _at(marks, _shingles(ids, w))
        slots = count[which] if records.share >= 1 else count[which] * int(records.words.shape[1])
        for lo, hi in _slices(slots):
            p, e = _ranges(at[which[lo:hi]], count[which[lo:hi]])
            r, p = of_record[e], place[lo:hi][p]
            if records.share >= 1:
                start = p - offset[e]
            else:  # any window of the record's length around the shingle
                each, back = _ranges(np.zeros(len(r), np.int64), records.length[r] - w + 1)
                r, start = r[each], p[each] - back
                p = p[each]
            d = np.searchsorted(first, p, side="right") - 1
            fits = (length[d] >= records.length[r]) & (start >= first[d]) & (start + records.length[r] <= first[d] + length[d])
            r, start, d = r[fits], start[fits], d[fits]
            good = _verified(records, ids, r, start) if len(r) else np.zeros(0, bool)
            yield d[good], r[good], start[good]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs whose sizes sum to about AT_ONCE."""
    if len(sizes):
        run = np.cumsum(sizes) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
        yield from itertools.pairwise(cuts)


def _search(shared):
    def run(rows):
        records: Records = shared.value
        for keys, ids, first, length in _chunks(rows, records):
            rise, pairs = np.zeros(len(ids) + 1, np.int64), np.zeros(0, np.int64)
            for d, r, start in _occurrences(records, ids, first, length):
                rise += np.bincount(start, minlength=len(rise))
                rise -= np.bincount(start + records.length[r], minlength=len(rise))
                pairs = np.union1d(pairs, d * len(records.length) + r)
            d, r = np.divmod(pairs, max(1, len(records.length)))
            which, entry = _ranges(records.item_first[r], records.item_count[r])
            named = np.unique(d[which] * len(records.names) + records.item[entry])
            names_of: dict[int, list[str]] = {}
            for x in named.tolist():
                names_of.setdefault(x // len(records.names), []).append(records.names[x % len(records.names)])
            edge = np.diff(np.concatenate([[0], (np.cumsum(rise) > 0).astype(np.int8)]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans_of: dict[int, list[tuple[int, int]]] = {}
            for k, b, e in zip((np.searchsorted(first, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist()):
                spans_of.setdefault(k, []).append((b - int(first[k]), e - b))
            for k, key in enumerate(keys):
                yield key, int(length[k]), spans_of.get(k, []), names_of.get(k, [])

    return run


def _union(rows):
    """What several blocks found in one document, as one."""
    for key, n, lists, names in rows:
        spans: list[tuple[int, int]] = []
        for s in sorted((x["start"], x["length"]) for found in lists for x in found):
            if spans and s[0] <= spans[-1][0] + spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], s[0] + s[1] - spans[-1][0]))
            else:
                spans.append(s)
        yield key, n, spans, sorted({x for found in names for x in found})


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, width: int = WIDTH, share: float = 1.0, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """Every row of docs (doc_id, text) with n_words, spans and item_ids.

    spans: runs (start, length) of words that lie in an occurrence of a window of `window` consecutive words of items
    (item_id, text), in order and not touching; item_ids: the items whose windows occur, sorted as strings. With share 1
    a window occurs where its words stand in order; with less, where as many words of the document hold that share of
    the window's distinct shingles of `width` words.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A null or empty text has no words and
    no spans; an item without words matches nothing, items of one id count as one, an item with a null id is the item "".
    Repeated rows, equal texts and null doc_ids stay rows of their own. Empty tables: no rows, or no spans. Other columns of either table
    are left behind; of names that differ only in case the lower-case one counts. A very long text is one chunk, at 8 bytes a word.
    """
    docs, items = exact(docs), exact(items)
    spark, key = docs.sparkSession, fresh(docs, "row_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = item_blocks(items, block_bytes)
    block = next(blocks, [])
    more = next(blocks, None)
    if more is None:  # one block: the row itself is carried
        found = _found(rows.select(F.col("doc_id").alias("row_id"), "text"), Records(block, window, width, share), spark)
        return found.withColumnRenamed("row_id", "doc_id")
    kept = staged(rows.select(F.monotonically_increasing_id().alias(key), "*"), "texts")
    source, parts = kept.select(F.col(key).alias("row_id"), "text"), None
    for block in itertools.chain([block, more], blocks):
        part = _found(source, Records(block, window, width, share), spark)
        parts = part if parts is None else parts.unionByName(part)
    # a row a block and document with anything found; what a document has at most is one list a block
    some = parts.where("size(item_ids) > 0").groupBy("row_id").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("item_ids"))
    merged = map_rows(some, lambda: _union, FOUND).select("row_id", "spans", "item_ids")
    empty = _found(source, Records([], window, width, share), spark).select("row_id", "n_words")
    out = empty.join(merged, "row_id", "left").join(kept.select(F.col(key).alias("row_id"), "doc_id"), "row_id")
    blank = {c: F.from_json(F.lit("[]"), t) for c, t in (("spans", "array<struct<start: long, length: long>>"), ("item_ids", "array<string>"))}
    return out.select("doc_id", "n_words", *(F.coalesce(c, x).alias(c) for c, x in blank.items()))


def _found(rows: DataFrame, records: Records, spark) -> DataFrame:
    counted = map_rows(rows, _count, "width int, shingle long, n long", spark.sparkContext.broadcast(records)) if len(records.length) else None
    if counted is not None:
        total = counted.groupBy("width", "shingle").agg(F.sum("n").alias("n")).collect()  # a number a shingle of the block at most
        records.order({(r[0], r[1]): r[2] for r in total})
    else:
        records.prefix = {}
    return map_rows(rows, _search, FOUND, spark.sparkContext.broadcast(records))


def without_contaminated(docs: DataFrame, items: DataFrame, most: int = 0, **how) -> DataFrame:
    """Documents with at most `most` words inside occurring windows; the columns of docs, its nulls and repeats kept.

    Decided once a distinct (doc_id, text), as equal texts have equal spans; how: see contamination().
    """
    hit = contamination(docs, items, **how).withColumn("_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]))
    bad = hit.where(F.col("_hit") > most).select(F.col("doc_id").alias("_bad")).distinct()
    plain = exact(docs)
    return plain.join(bad, plain["doc_id"].cast("long").eqNullSafe(F.col("_bad")), "left_anti").toDF(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """The figures of contamination(): words hit, items, a digest of their ids, the verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)

"""Katz back-off language model: counts, Good-Turing discounts, normalised weights, scores.

Tokens are 64-bit hashes, n-grams hashes of hashes. Texts become blocks of about
``BLOCK`` tokens, staged once. All that a corpus-wide step needs is a block's distinct
n-grams, so a step is one exchange: every block sends its sorted distinct keys
with a payload to the keys' buckets (ranges of the hash), a bucket adds up, stores
its part of the model, and answers each block in the order of the block's own
keys. A frequent n-gram is thus one entry a block, and no key makes a large
bucket. Blocks are stored by their number, so that answers come to them and they aren't shuffled.

For each order n an exchange counts n-grams (held-out texts send zeros, and
ask, and learn the places of their n-grams among the bucket's). Counts up to ``CUTOFF`` are discounted by Good-Turing estimates from the counts of
counts; all n-grams are kept (``min_counts`` of a caller may
leave rare ones out, which leaves their mass to the back-off). The highest order is counted in ``PASSES`` ranges of buckets, one after the other. A second exchange, by context, adds up the discounted mass and
the lower-order probability of the words seen after each context, once for each n-gram (by the
first block that holds it, which sends whole numbers: its count, the count of the n-gram without its first word, and
how often the context without its first word was seen, which divides all of a context's lower counts), and gives the weight. It meets the
places of contexts where the first exchange left them, as both have the same buckets:

    alpha(context) = (1 - sum of discounted shares) / (1 - sum of lower-order probabilities)

so that the probabilities after every context sum to one over the vocabulary and one unknown token. A context without discounted
mass (all its counts are large) gives up one count in its total. Scores go
down recursively: the n-gram's share if it is kept, else alpha(context) times the score of the shorter one; order 1 backs off to the unknown token.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, parts_for, staged, texts_of

ORDER, MIN_COUNTS, CUTOFF, BLOCK, BUCKET = 3, (1, 1, 1), 5, 1 << 20, 2 << 20
#: Ranges of buckets in which the highest order, which has the most n-grams, is counted: each sends its share of the keys.
PASSES = 2
#: How a block is told a context's scale: 0 is 1, LARGE is total / (total + 1), OTHER is sent.
LARGE, OTHER = 1, 2
START, END = np.uint64(xxhash.xxh3_64_intdigest(b" ")), np.uint64(xxhash.xxh3_64_intdigest(b""))

BLOCKS = "block long, n_tokens long, doc_ids binary, no_id binary, held binary, sizes binary, vocabulary binary, tokens binary"
SENT = "bucket int, block long, keys binary, a binary"
ASKED = "bucket int, block long, followers binary, counts binary, lower binary, totals binary, scales binary, wanted binary"
ANSWERS = "model boolean, block long, step int, bucket int, keys binary, a binary, b binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed; of booleans, bits after their number."""
    if x.dtype == bool:
        return len(x).to_bytes(4, "little") + np.packbits(x).tobytes()
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    if kind is np.bool_:
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=int.from_bytes(data[:4], "little")).astype(bool)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def rounded(x: np.ndarray) -> np.ndarray:
    """Doubles to 36 binary digits after the first, whose other bytes are zero and take no room."""
    return (x.view(np.uint64) + np.uint64(1 << 15) & ~np.uint64(0xFFFF)).view(np.float64)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ word >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def token_hashes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


@dataclass
class Level:
    """Distinct n-grams of a block: sorted keys, which one ends at each place (-1: none), and a place of each."""

    keys: np.ndarray
    at: np.ndarray
    place: np.ndarray


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each lies, and which one each is; np.unique's stable sort takes twice as long."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], which


class Block:
    """A block's texts as one run of tokens, each text with START before it and END after it."""

    def __init__(self, row: dict, order: int):
        self.doc_ids = [None if n else int(d) for d, n in zip(unpack(row["doc_ids"], np.int64), unpack(row["no_id"], np.uint8))]
        self.held = unpack(row["held"], np.uint8).astype(bool)
        self.sizes = unpack(row["sizes"], np.int64)
        vocabulary = unpack_keys(row["vocabulary"])
        words = vocabulary[unpack(row["tokens"], np.uint32)]
        begin = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.begin = begin
        n = int((self.sizes + 1).sum())
        starts = np.zeros(n, bool)
        starts[begin] = True
        run = np.empty(n, np.uint64)
        run[starts], run[~starts] = START, words
        self.place = np.arange(n) - np.repeat(begin, self.sizes + 1)
        self.learn = np.repeat(~self.held, self.sizes + 1)
        self.starts = starts
        self.run = self.grams = run
        self.order = 1
        self.levels: list[Level] = []
        for k in range(1, order + 1):
            valid, grams = self.long(k)
            keys, one, which = distinct(grams)
            at = np.full(n, -1, np.int32)
            at[valid] = which
            self.levels.append(Level(keys, at, valid[one]))

    def long(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where an n-gram of this order ends, and its key; orders must not fall from call to call."""
        while self.order < order:
            longer = np.zeros(len(self.run), np.uint64)
            longer[1:] = joined(self.grams[:-1], self.run[1:])
            self.grams, self.order = longer, self.order + 1
        valid = np.flatnonzero(self.place >= order - 1)
        return valid, self.grams[valid]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys by bucket."""
    own = bucket_of(keys, buckets)
    ends = np.searchsorted(own, np.arange(buckets + 1))
    for b in np.unique(own).tolist():
        yield b, slice(int(ends[b]), int(ends[b + 1]))


@dataclass
class Stats:
    """What the driver keeps of an order: counts of counts (1 to CUTOFF + 1), and for order 1 tokens and types."""

    order: int
    of_counts: list[int]
    tokens: int = 0
    types: int = 0
    discounts: np.ndarray = field(default_factory=lambda: np.ones(CUTOFF + 1))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = counts.astype(np.float64)
        return c * self.discounts[np.minimum(counts, CUTOFF + 1).astype(np.int64)]

    def mass(self, which: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Sums of discounted counts by which (0 to n - 1), the same in any order: added as whole numbers, of n-grams for each small count."""
        out = np.zeros(n)
        for r in range(1, CUTOFF + 1):
            out += np.bincount(which[counts == r], minlength=n) * (r * self.discounts[r])
        large = counts > CUTOFF
        return out + np.bincount(which[large], counts[large], n)


def smoothed(of_counts: list[int]) -> tuple[float, float] | None:
    """Intercept and slope of the line through the logarithms of counts of counts over those of counts, each weighed by its count of counts.

    None unless at least two counts occur and the line falls faster than 1 / count, without which no count would be discounted.
    """
    known = [(math.log(r), math.log(n), n) for r, n in enumerate(of_counts, 1) if n > 0]
    total = sum(w for *_, w in known)
    if len(known) < 2:
        return None
    mx, my = sum(x * w for x, _, w in known) / total, sum(y * w for _, y, w in known) / total
    slope = sum(w * (x - mx) * (y - my) for x, y, w in known) / sum(w * (x - mx) ** 2 for x, _, w in known)
    return (my - slope * mx, slope) if slope < -1.02 else None


def good_turing(of_counts: list[int], least: int = 1) -> np.ndarray:
    """Discounts of the counts 0 to CUTOFF and, last, of all above (1).

    Katz's renormalised Good-Turing ratios over log-linearly smoothed counts of counts, by which discounted counts rise with counts; copies of
    whole texts make the raw ones rise and fall. Where no falling line fits (very small corpora) half a count is taken off every count, with a warning. Counts under least count as unseen.
    """
    d = np.ones(CUTOFF + 2)
    line = smoothed(of_counts)
    if line is None and any(of_counts):
        warnings.warn("counts of counts don't fall: half a count is taken off each", stacklevel=2)
    for r in range(1, CUTOFF + 1):
        if line is None:
            d[r] = (r - 0.5) / r
        else:
            rest = (CUTOFF + 1) ** (line[1] + 1)
            d[r] = ((1 + 1 / r) ** (line[1] + 1) - rest) / (1 - rest)
    d[:least] = 0
    return d


def order_one(stats: Stats) -> tuple[float, float]:
    """Scale of the discounted shares at order 1, and the unknown token's probability."""
    if not stats.tokens:
        return 1.0, 1.0
    mass = sum(r * n * stats.discounts[r] for r, n in enumerate(stats.of_counts[:CUTOFF], 1)) + stats.tokens - sum(r * n for r, n in enumerate(stats.of_counts[:CUTOFF], 1))
    left = 1 - mass / stats.tokens
    if left > 1e-9:
        return 1.0, left
    return stats.tokens / (stats.tokens + 1), 1 / (stats.tokens + 1)


class Known:
    """Answers to a block, by step: counts of order n at step 2n - 1, alpha and scale of contexts of order n + 1 at step 2n."""

    def __init__(self, block: Block, answers: list[dict], stats: list[Stats]):
        self.block, self.stats = block, stats
        self.counts: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        self.alpha: dict[int, np.ndarray] = {}
        self.scale: dict[int, np.ndarray] = {}
        by_step: dict[int, list[dict]] = {}
        for a in answers:
            by_step.setdefault(a["step"], []).append(a)
        answered = lambda step, c, kind: np.concatenate([unpack(r[c], kind) for r in sorted(by_step.get(step, []), key=lambda r: r["bucket"])] or [np.zeros(0, kind)])  # noqa: E731  a block of empty texts has no long n-grams
        for n in range(1, len(block.levels) + 1):
            self.counts[n] = answered(2 * n - 1, "a", np.int64)
            if all(r["b"] for r in by_step.get(2 * n - 1, [])):
                self.own[n] = answered(2 * n - 1, "b", np.bool_)
        for n in range(1, len(block.levels)):
            if 2 * n not in by_step:
                continue
            how, total = answered(2 * n, "b", np.uint8), self.counts[n]
            self.scale[n] = np.where(how == LARGE, total / (total + 1.0), 1.0)
            self.scale[n][how == OTHER] = answered(2 * n, "keys", np.float64)
            self.alpha[n] = np.zeros(len(self.scale[n]))
            if all(r["a"] for r in by_step[2 * n]):
                self.alpha[n][self.wanted(n + 1)] = answered(2 * n, "a", np.float64)

    def context_of(self, n: int) -> np.ndarray:
        """For each distinct n-gram, its context among the distinct (n - 1)-grams."""
        level = self.block.levels[n - 1]
        return self.block.levels[n - 2].at[level.place - 1]

    def wanted(self, n: int) -> np.ndarray:
        """Which contexts have an n-gram here that isn't kept: only their alphas are sent."""
        out = np.zeros(len(self.block.levels[n - 2].keys), bool)
        out[self.context_of(n)[self.counts[n] == 0]] = True
        return out

    def shares(self, n: int) -> np.ndarray:
        """Discounted share of each n-gram after its context; 0 where it isn't kept."""
        c = self.counts[n]
        total = self.counts[n - 1][self.context_of(n)]
        return np.where(c > 0, self.stats[n - 1].share(c) / np.maximum(total, 1), 0.0)

    def probabilities(self, n: int) -> np.ndarray:
        """Of the last word of each distinct n-gram after the words before it."""
        if n == 1:
            scale, unknown = order_one(self.stats[0])
            c = self.counts[1]
            return np.where(c > 0, self.stats[0].share(c) / max(1, self.stats[0].tokens) * scale, unknown)
        lower = self.probabilities(n - 1)[self.block.levels[n - 2].at[self.block.levels[n - 1].place]]
        context = self.context_of(n)
        return np.where(self.counts[n] > 0, self.shares(n) * self.scale[n - 1][context], self.alpha[n - 1][context] * lower)


def _blocks(size: int):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        sizes: list = []
        numbers: dict[bytes, int] = {}
        tokens: list[np.ndarray] = []
        n = 0

        def block() -> tuple:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
            run = np.concatenate(tokens)
            # small numbers for frequent words; words about as frequent are in the order of their hashes, whose differences are short
            often = np.lexsort((hashes, -np.log2(np.bincount(run, minlength=len(hashes))).astype(np.int64)))
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            return (
                part << 32 | made, n, pack(np.array([d or 0 for d in ids], np.int64)), pack(np.array([d is None for d in ids], np.uint8)), pack(np.array(held, np.uint8)),
                pack(np.array(sizes, np.int64)), pack_keys(hashes[often]), pack(rank[run]),
            )

        for doc_id, is_held, text in docs:
            words = token_hashes(text)
            words.append(b"")
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            ids.append(doc_id)
            held.append(is_held)
            sizes.append(len(words))
            n += len(words)
            if n >= size:
                yield block()
                made, n, numbers = made + 1, 0, {}
                ids, held, sizes, tokens = [], [], [], []
        if ids:
            yield block()

    return rows


def _ask_counts(n: int, buckets: int, first: int, end: int):
    """Counts in texts to learn from, for the buckets from first to before end."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def rows(blocks: Iterable[tuple]) -> Iterator[tuple]:
        for row in blocks:
            row = dict(zip(names, row))
            block = Block(row, 0)
            valid, grams = block.long(n)
            if end - first < buckets:
                own = bucket_of(grams, buckets)
                here = (own >= first) & (own < end)
                valid, grams = valid[here], grams[here]
            keys, _, which = distinct(grams)
            counts = np.bincount(which[block.learn[valid]], minlength=len(keys)).astype(np.uint32)
            for b, s in bucket_slices(keys, buckets):
                yield b, row["block"], pack_keys(keys[s]), pack(counts[s])

    return rows


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def _merged(sent: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, list[slice]]:
    """Rows by block, the distinct keys, which one each sent key is, and where each row's lie."""
    rows = sorted(sent.to_pylist(), key=lambda r: r["block"])
    keys = [unpack_keys(r["keys"]) for r in rows]
    merged, _, inverse = distinct(np.concatenate(keys))
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return rows, merged, inverse, [slice(e - len(k), e) for e, k in zip(ends, keys)]


def _count(step: int, least: int, last: bool):
    def reduce(sent: pa.Table) -> pa.Table:
        rows, keys, inverse, slices = _merged(sent)
        counts = np.concatenate([unpack(r["a"], np.uint32) for r in rows]).astype(np.int64)
        totals = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        there = np.flatnonzero(counts)[::-1]
        first = np.full(len(keys), -1)
        first[inverse[there]] = there  # the last one put stays, which is the first block's
        own = np.zeros(len(counts), bool)
        own[first[first >= 0]] = True
        rare = np.bincount(np.minimum(totals, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        start = int(totals[keys == START].sum()) if step == 1 else 0
        if 0 < start <= CUTOFF + 1:
            rare[start - 1] -= 1
        total = [*rare.tolist(), int(totals.sum()) - start, int((totals > 0).sum()) - (start > 0)]
        kept = np.where(totals >= least, totals, 0)
        bucket = rows[0]["bucket"]
        some = kept > 0
        out = [(True, None, step, bucket, pack_keys(keys[some]), pack(kept[some]), np.array(total, np.int64).tobytes())]
        for r, s in zip(rows, slices):
            k = kept[inverse[s]]
            places = None if last else pack_keys(inverse[s].astype(np.uint64))
            out.append((False, r["block"], step, bucket, places, pack(k), None if step == 1 else pack(own[s] & (k > 0))))
        return _table(out, ANSWERS)

    return reduce


def _ask_weights(n: int, buckets: int, stats: list[Stats]):
    def rows(block_row: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block_row.to_pylist():
            block = Block(row, n)
            known = Known(block, answers.to_pylist(), stats)
            own = np.flatnonzero(known.own[n])
            context = known.context_of(n)[own]
            order = np.argsort(context)
            own = own[order]
            contexts = block.levels[n - 2]
            followers = np.bincount(context, minlength=len(contexts.keys))
            end = np.cumsum(followers)
            # an n-gram that is kept is kept without its first word too, so its lower-order probability is a share
            counts, lower = known.counts[n][own], known.counts[n - 1][contexts.at[block.levels[n - 1].place[own]]]
            wanted = known.wanted(n)
            for b, s in bucket_slices(contexts.keys, buckets):
                totals = scales = None
                if n > 2:
                    shorter = block.levels[n - 3].at[contexts.place[s][followers[s] > 0]]
                    totals, scales = pack(known.counts[n - 2][shorter]), pack(known.scale[n - 2][shorter])
                mine = slice(end[s.start] - followers[s.start], end[s.stop - 1])
                out.append((b, row["block"], pack(followers[s]), pack(counts[mine]), pack(lower[mine]), totals, scales, pack(wanted[s])))
        return _table(out, ASKED)

    return rows


def _weigh(step: int, stats: Stats, lower: Stats):
    def reduce(sent: pa.Table, known: pa.Table) -> pa.Table:
        rows = sorted(sent.to_pylist(), key=lambda r: r["block"])
        there = sorted(known.to_pylist(), key=lambda r: r["block"])
        if [r["block"] for r in rows] != [r["block"] for r in there]:
            raise ValueError("a block's contexts differ from those it counted")
        places = [unpack_keys(r["keys"]).astype(np.int64) for r in there]
        ends = np.cumsum([len(x) for x in places]).tolist()
        slices = [slice(e - len(x), e) for e, x in zip(ends, places)]
        inverse = np.concatenate(places)
        n = int(inverse.max()) + 1
        put = lambda c, kind: np.concatenate([unpack(r[c], kind) for r in rows])
        wanted, followers = put("wanted", np.bool_), put("followers", np.int64)
        total = np.zeros(n, np.int64)
        total[inverse] = np.concatenate([unpack(r["a"], np.int64) for r in there])
        which = np.repeat(inverse, followers)
        mass = stats.mass(which, put("counts", np.int64), n) / np.maximum(total, 1)
        low = lower.mass(which, put("lower", np.int64), n)
        if lower.order == 1:
            low *= order_one(lower)[0] / max(1, lower.tokens)
        else:
            share = np.zeros(n)
            share[inverse[followers > 0]] = put("scales", np.float64) / put("totals", np.int64)
            low *= share
        full = mass > 1 - 1e-9
        scale = np.where(full, total / (total + 1.0), 1.0)
        left = np.where(full, 1 / (total + 1.0), 1 - mass)
        all_seen = 1 - low <= 1e-12
        alpha = np.where(all_seen, 0.0, left / np.where(all_seen, 1.0, 1 - low))
        scale = np.where(all_seen, 1 / np.where(all_seen, mass, 1.0), scale)
        bucket, kept = rows[0]["bucket"], total > 0
        alpha = rounded(alpha)
        how = np.where(all_seen, OTHER, np.where(full, LARGE, 0)).astype(np.uint8)
        out = [(True, None, step, bucket, None, pack(alpha[kept]), pack(scale[kept]))]
        for r, s in zip(rows, slices):
            at = inverse[s]
            out.append((False, r["block"], step, bucket, pack(scale[at[how[at] == OTHER]]), pack(alpha[at[wanted[s]]]), pack(how[at])))
        return _table(out, ANSWERS)

    return reduce


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, stats: list[Stats]):
    def rows(block_row: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        tokens, types = stats[0].tokens, stats[0].types
        for row in block_row.to_pylist():
            block = Block(row, order)
            known = Known(block, answers.to_pylist(), stats)
            logs = np.zeros(len(block.place))
            for n in range(1, order + 1):
                at = block.levels[n - 1].at
                here = (at >= 0) & ~block.starts & ((block.place >= n - 1) if n == order else (block.place == n - 1))
                if here.any():
                    logs[here] = np.log10(known.probabilities(n))[at[here]]
            c = known.counts[1][block.levels[0].at]
            base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
            base[block.starts] = 0
            seen = (c > 0) & ~block.starts
            add = lambda x: np.add.reduceat(x, block.begin)
            out += zip(block.doc_ids, block.held.tolist(), block.sizes.tolist(), add(seen.astype(np.int64)).tolist(), [tokens] * len(block.doc_ids), add(base).tolist(), add(logs).tolist())
        return _table(out, SCORES)

    return rows


@dataclass
class Katz:
    """The model's tables and scores.

    Rows with model = true: step 2n - 1 holds keys and counts of order n by bucket, step 2n alpha (to 36 binary digits, as scores use it) and scale of the same n-grams as
    contexts, in the order of step 2n - 1's keys of that bucket (both 1 if nothing follows).
    """

    tables: list[DataFrame]
    stats: list[Stats]
    scores: DataFrame


def katz(docs: DataFrame, held_out: Column, order: int = ORDER, min_counts: tuple[int, ...] = MIN_COUNTS, block: int = BLOCK, bucket: int = BUCKET) -> Katz:
    """Learn from the documents that aren't held out, and score all.

    A null or empty text is its end alone. Repeated rows are counted and scored each. A null held_out counts as false. An
    empty table gives no rows. A text longer than a block makes one block, whatever its size. Other columns are left behind. With nothing to learn from, all tokens are the unknown one, with probability 1.
    The driver holds counts of counts only. min_counts must not fall from an order to the next, so that kept n-grams have kept contexts.
    """
    if any(a > b for a, b in zip(min_counts, min_counts[1:])):
        raise ValueError("min_counts must not fall from an order to the next")
    rows = texts_of(docs, F.coalesce(held_out, F.lit(False)).alias("held_out")).select("doc_id", "held_out", "text")
    blocks = staged(map_rows(rows, _blocks, BLOCKS, block), "katz-blocks", "none", by="block", parts=min(parts_for(rows), 100_000))  # Spark has no more buckets
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket))
    stats: list[Stats] = []
    tables: list[DataFrame] = []

    def answers(owned: int = 0) -> DataFrame:
        """To all blocks: what scores need, or what order owned needs for its weights: which n-grams are a block's own, and no alphas."""
        known = tables[0]
        for t in tables[1:]:
            known = known.unionByName(t)
        alphas = F.when((F.col("step") % 2 == 1) | F.lit(owned == 0), F.col("a")).alias("a")
        own = F.when((F.col("step") % 2 == 0) | (F.col("step") == 2 * owned - 1), F.col("b")).alias("b")
        scales = F.when(F.col("step") % 2 == 0, F.col("keys")).alias("keys")
        return known.where("not model").select("block", "step", "bucket", scales, alphas, own).groupBy("block")

    placed = min(max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    for n in range(1, order + 1):
        least = min_counts[min(n, len(min_counts)) - 1]
        passes = min(PASSES, buckets) if n == order else 1
        made = []
        for i in range(passes):
            sent = map_rows(blocks, _ask_counts, SENT, n, buckets, buckets * i // passes, buckets * (i + 1) // passes)
            made.append(staged(sent.groupBy("bucket").applyInArrow(_count(2 * n - 1, least, n == order), ANSWERS), f"katz-counts-{n}", "none", by="bucket", parts=placed, moved=False))
        tables += made
        parts = [np.frombuffer(r["b"], np.int64) for t in made for r in t.where("model").select("b").toLocalIterator()]
        sums = np.sum(parts, axis=0).tolist() if parts else [0] * (CUTOFF + 3)
        stats.append(Stats(n, sums[: CUTOFF + 1], sums[-2], sums[-1], good_turing(sums[: CUTOFF + 1], least)))
        if n > 1:
            asked = blocks.groupBy("block").cogroup(answers(n)).applyInArrow(_ask_weights(n, buckets, list(stats)), ASKED)
            contexts = below.where("not model").select("bucket", "block", "keys", "a").groupBy("bucket")
            weights = asked.groupBy("bucket").cogroup(contexts).applyInArrow(_weigh(2 * n - 2, stats[-1], stats[-2]), ANSWERS)
            tables.append(staged(weights, f"katz-weights-{n}", "none"))
        below = made[0]  # of all orders but the highest there is one
    return Katz(tables, stats, blocks.groupBy("block").cogroup(answers()).applyInArrow(_score(order, list(stats)), SCORES))


def katz_scores(docs: DataFrame, folds: int = 5, fold: int = 1, **how) -> DataFrame:
    """SCORES for every document; those whose crc32(doc_id as text) modulo folds is fold are held out. A null doc_id isn't."""
    return katz(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, **how).scores

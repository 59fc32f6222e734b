"""Token-id files: adaptive context mixing drives a range coder in independent blocks.

A file is a run of blocks. A block holds up to ``BLOCK_IDS`` ids and stands
alone: its header has the vocabulary bound, the ids' code lengths, its lanes' sizes and a
CRC-32 of the ids; its model starts anew. Ids of a block lie in lanes (equal runs that are
coded side by side), so that one numpy call works on all lanes; the lanes share the
block's model, which learns after each step.

An id is a path down the block's prefix tree of 15 branches a node (Huffman's, so that
frequent ids have short paths), and each step codes one branch of every lane. Three
predictions of the branch are mixed, and as every node has them, all ids have a
probability after every context:

* order 0: adaptive counts of the node's branches;
* order 1: counts of the node's branches after the last id (hashed), added to the order-0 prediction;
* order 2: counts after the last two ids (hashed), added to the order-1 prediction.

The weights of the mixture are adaptive: for each pair of confidences (how often the
two contexts were seen at the node) they follow each prediction's share in the
probabilities of the branches taken. Sums, products and quotients of floats are the same on
all machines, so encoder and decoder agree. A 64-bit carry-less range coder writes the branches.

File layout (little endian): "TMC2"; u32 documents; u32 blocks; document ids
(i64, with the lowest value for null) and lengths (u64); then per block a header
(u32 ids, u32 lanes, u32 bound, u32 crc32 of the ids, u32 bytes of the deflated code lengths, u32 payload
words), code lengths, u32 words of each lane, payload of u16 words; at the end u32 crc32 of all before it.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_rows, parts_for, staged, texts_of
from tidemill.llm.tokens import encoder

BLOCK_IDS, LANE_IDS, MAX_LANES, FILE_IDS = 1 << 20, 256, 4096, 1 << 20
NULL_ID = -(1 << 63)
_MAGIC = b"TMC2"
_U = np.uint64
_TOP, _BOT, _FULL = _U(1 << 48), _U(1 << 32), _U((1 << 64) - 1)
#: Branches of a node (1 to 15; place 0 of its row of counts stays 0), and parts that a branch's probabilities are scaled to.
_WAYS, _ROW, _PARTS = 15, 16, np.float32(1 << 16)
#: Weight of the shorter context's prediction in counts, and the limit at which mixture counts are halved.
_PRIOR, _MIX_LIMIT = np.float32(2.0), 1 << 15
#: Products with these add up rows, and all branches up to each. They are exact: whole numbers under 2**24, in any order.
_ALL, _UP_TO, _ONE_EACH = np.ones(_ROW, np.float32), np.triu(np.ones((_ROW, _ROW), np.float32)), np.arange(_ROW, dtype=np.float32)
_UP_TO[0] = 0
_ODD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
_CONFIDENCE = np.array([min(7, n.bit_length()) for n in range(256)], np.int64)


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of Huffman's code with 15 branches a node; 0 for ids that don't occur, 1 for an id alone."""
    heap = [(int(counts[i]), int(i)) for i in np.flatnonzero(counts)]
    lengths = np.zeros(len(counts), np.uint8)
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
        return lengths
    heapq.heapify(heap)
    made, parent = len(counts), {}
    take = (len(heap) - 2) % (_WAYS - 1) + 2
    while len(heap) > 1:
        low = [heapq.heappop(heap) for _ in range(take)]
        parent.update((node, made) for _, node in low)
        heapq.heappush(heap, (sum(c for c, _ in low), made))
        made, take = made + 1, _WAYS
    depth = {made - 1: 0}
    for node in sorted(parent, reverse=True):
        depth[node] = depth[parent[node]] + 1
        if node < len(counts):
            lengths[node] = depth[node]
    return lengths


def _tree(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of inner node n from place 16 n + 1 on (0 is the root; -1 - id for a leaf), and each id's path, 4 bits a branch, first branch lowest."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")].tolist()
    children: list[int] = []
    paths = np.zeros(len(lengths), np.int64)
    inner: dict[tuple[int, int], int] = {}

    def node_of(depth: int, code: int) -> int:
        if (depth, code) not in inner:
            inner[depth, code] = len(inner)
            children.extend([-1 - order[0]] * _ROW)
            if depth:
                children[node_of(depth - 1, code // _WAYS) * _ROW + 1 + code % _WAYS] = inner[depth, code]
        return inner[depth, code]

    node_of(0, 0)
    code, last = 0, 0
    for i in order:
        n = int(lengths[i])
        code *= _WAYS ** (n - last)
        last = n
        children[node_of(n - 1, code // _WAYS) * _ROW + 1 + code % _WAYS] = -1 - i
        for d in range(n):
            paths[i] |= (1 + code // _WAYS ** (n - 1 - d) % _WAYS) << 4 * d
        code += 1
    return np.array(children, np.int64), paths


class _Model:
    """State that encoder and decoder move in step: counts of visits and branches for each order's contexts."""

    def __init__(self, nodes: int, n: int):
        bits = min(20, max(8, n.bit_length() + 1))
        self.shift = _U(64 - bits)
        self.counts = [np.zeros((rows, _ROW), np.float32) for rows in (nodes, 1 << bits, 1 << bits)]
        self.room = np.empty((3, min(MAX_LANES, n), _ROW), np.float32)
        self.mix = [np.full(64, w) for w in (1.0, 2.0, 4.0)]

    def predict(self, node: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Ends of the branches' intervals, after a zero. c1, c2: hashes of the last id and of the last two."""
        step = node.view(_U) * _ODD[1]
        self.at = [node, *(((c + step) * _ODD[0] >> self.shift).view(np.int64) for c in (c1, c2))]
        rows = [c.take(at, axis=0, out=room[: len(node)], mode="clip") for c, at, room in zip(self.counts, self.at, self.room)]
        n0, n1, n2 = (row @ _ALL for row in rows)
        self.set = _CONFIDENCE.take(n1.astype(np.int64), mode="clip") * 8 + _CONFIDENCE.take(n2.astype(np.int64), mode="clip")
        total = self.mix[0] + self.mix[1] + self.mix[2]
        w0, w1, w2 = ((m / total).astype(np.float32).take(self.set) for m in self.mix)
        # each order's prediction is its counts and the shorter one's, so the mixture is one sum of counts
        d1, d2 = 1 / (n1 + _PRIOR), 1 / (n2 + _PRIOR)
        self.weights, self.dividers = (w0, w1, w2), (1 / (n0 + np.float32(_WAYS * 0.25)), d1, d2)
        u1 = w1 + w2 * _PRIOR * d2
        u0 = w0 + u1 * _PRIOR * d1
        sums = rows[0]
        sums += np.float32(0.25)
        sums *= (u0 * self.dividers[0] * _PARTS)[:, None]
        for row, factor in ((rows[1], u1 * d1), (rows[2], w2 * d2)):
            row *= (factor * _PARTS)[:, None]
            sums += row
        ends = np.floor(sums, out=sums) @ _UP_TO
        ends += _ONE_EACH
        return ends

    def learn(self, branch: np.ndarray) -> None:
        places = [at * _ROW + branch for at in self.at]
        taken = [c.reshape(-1).take(place) for c, place in zip(self.counts, places)]
        p = (taken[0] + np.float32(0.25)) * self.dividers[0]
        shares = [self.weights[0] * p]
        for k in (1, 2):
            p = (taken[k] + _PRIOR * p) * self.dividers[k]
            shares.append(self.weights[k] * p)
        whole = shares[0] + shares[1] + shares[2]
        for mix, share in zip(self.mix, shares):
            mix += np.bincount(self.set, share / whole, 64)
        if (big := self.mix[0] + self.mix[1] + self.mix[2] > _MIX_LIMIT).any():
            for mix in self.mix:
                mix[big] *= 0.5
        for counts, place in zip(self.counts, places):
            np.add.at(counts.reshape(-1), place, np.float32(1))


class _Encoder:
    """Range coders of all lanes; `take` codes a branch of each live lane."""

    def __init__(self, lanes: int, room: int):
        self.low, self.rng = np.zeros(lanes, _U), np.full(lanes, _FULL, _U)
        self.out, self.at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)

    def take(self, lane: np.ndarray, ends: np.ndarray, branch: np.ndarray | None) -> np.ndarray:
        lo, ra = self.low[lane], self.rng[lane]
        ra = ra // ends[:, -1].astype(_U)
        branch = self.choose(lane, lo, ra, ends, branch)
        place = np.arange(len(lane)) * _ROW + branch
        flat = ends.reshape(-1)
        start = flat.take(place - 1)
        size = (flat.take(place) - start).astype(_U)
        lo, ra = lo + ra * start.astype(_U), ra * size
        self.low[lane], self.rng[lane] = lo, ra
        while True:
            same = (lo ^ (lo + ra)) < _TOP
            if not len(go := np.flatnonzero(same | (ra < _BOT))):
                return branch
            lane, lo, ra, same = lane[go], lo[go], ra[go], same[go]
            ra = np.where(same, ra, (_U(0) - lo) & (_BOT - _U(1)))
            self.shift(lane, lo)
            lo, ra = lo << _U(16), ra << _U(16)
            self.low[lane], self.rng[lane] = lo, ra

    def choose(self, lane, lo, ra, ends, branch: np.ndarray) -> np.ndarray:
        return branch

    def shift(self, lane: np.ndarray, lo: np.ndarray) -> None:
        """The upper 16 bits are settled."""
        if self.at[lane].max() >= self.out.shape[1] - 2:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lane, self.at[lane]] = (lo >> _U(48)).astype(np.uint16)
        self.at[lane] += 1

    def finish(self) -> tuple[np.ndarray, bytes]:
        """Words of each lane, and all words: the last two lie inside the last interval whatever follows."""
        rows = np.arange(len(self.at))
        last = (self.low + (_BOT - _U(1))) >> _U(32)
        self.out[rows, self.at], self.out[rows, self.at + 1] = (last >> _U(16)).astype(np.uint16), (last & _U(65535)).astype(np.uint16)
        self.at += 2
        return self.at, self.out[np.arange(self.out.shape[1]) < self.at[:, None]].astype("<u2").tobytes()


class _Decoder(_Encoder):
    """The same moves; the branch is found from the lane's words."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        super().__init__(len(sizes), 0)
        self.words = np.concatenate([words, np.zeros(4, "<u2")])
        self.end = np.cumsum(sizes)
        self.read, self.code = self.end - sizes, np.zeros(len(sizes), _U)
        for _ in range(4):
            self.shift(np.arange(len(sizes)), self.low)

    def choose(self, lane, lo, ra, ends, branch: None) -> np.ndarray:
        v = np.minimum((self.code[lane] - lo) // ra, (ends[:, -1] - 1).astype(_U)).astype(np.float32)
        return (ends > v[:, None]).argmax(axis=1)

    def shift(self, lane: np.ndarray, lo: np.ndarray) -> None:
        at = self.read[lane]
        self.read[lane] += 1
        fed = np.where(at < self.end[lane], self.words[np.minimum(at, len(self.words) - 1)], 0)
        self.code[lane] = self.code[lane] << _U(16) | fed.astype(_U)


def _walk(coder: _Encoder, lengths: np.ndarray, n: int, lanes: int, ids: np.ndarray | None) -> np.ndarray:
    """Code all branches of the lanes' ids (given, or found): a lane goes on to its next id at once, and leaves after its last."""
    children, paths = _tree(lengths)
    model = _Model(len(children) // _ROW, n)
    steps = -(-n // lanes)
    grid = np.zeros(n, np.int64) if ids is None else ids
    lane = np.arange(lanes)
    at, end = lane * steps, np.minimum(lane * steps + steps, n)
    lane, at, end = lane[at < end], at[at < end], end[at < end]
    node, last = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    c1, c2 = np.zeros(len(lane), _U), np.zeros(len(lane), _U)
    path = paths[grid[at]] if ids is not None else None
    while len(lane):
        branch = coder.take(lane, model.predict(node, c1, c2), None if path is None else path & 15)
        model.learn(branch)
        node = children.take(node * _ROW + branch)
        if path is not None:
            path = path >> 4
        done = np.flatnonzero(node < 0)
        if len(done):
            x = -1 - node[done]
            grid[at[done]] = x
            at[done] += 1
            node[done] = 0
            c2[done] = (last[done] + 1).view(_U) * _ODD[2] + (x + 1).view(_U) * _ODD[0]
            c1[done] = (x + 1).view(_U) * _ODD[2]
            last[done] = x
            if path is not None:
                path[done] = paths[grid[np.minimum(at[done], end[done] - 1)]]
            stay = at < end
            if not stay.all():
                lane, at, end, node, last, c1, c2 = (v[stay] for v in (lane, at, end, node, last, c1, c2))
                path = None if path is None else path[stay]
    return grid


def encode_block(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes = min(MAX_LANES, max(1, n // LANE_IDS))
    lengths = _code_lengths(np.bincount(ids))
    coder = _Encoder(lanes, -(-n // lanes) + 8)
    _walk(coder, lengths, n, lanes, ids.astype(np.int64))
    sizes, payload = coder.finish()
    crc, tree = zlib.crc32(ids.astype("<u4").tobytes()), zlib.compress(lengths.tobytes(), 9)
    return struct.pack("<6I", n, lanes, len(lengths), crc, len(tree), len(payload) // 2) + tree + sizes.astype("<u4").tobytes() + payload


def decode_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The block's ids and the place after it; raises ValueError if the checksum or the code lengths are wrong."""
    n, lanes, bound, crc, tree, words = struct.unpack_from("<6I", data, at)
    at += 24
    lengths = np.frombuffer(zlib.decompress(data[at : at + tree]), np.uint8)
    if len(lengths) != bound:
        raise ValueError("a block's code lengths differ from its bound")
    at += tree
    sizes = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    ids = _walk(_Decoder(np.frombuffer(data, "<u2", words, at), sizes), lengths, n, lanes, None).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids, at + 2 * words


def write_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """docs: document ids, and token ids as little-endian uint32."""
    ids = np.frombuffer(b"".join(d[1] for d in docs), "<u4")
    blocks = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    head = _MAGIC + struct.pack("<2I", len(docs), len(blocks))
    head += np.array([NULL_ID if d[0] is None else d[0] for d in docs], "<i8").tobytes() + np.array([len(d[1]) // 4 for d in docs], "<u8").tobytes()
    body = head + b"".join(blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents in the order written. Raises ValueError where a checksum or the form is wrong."""
    if data[:4] != _MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token file, or damaged")
    n_docs, n_blocks = struct.unpack_from("<2I", data, 4)
    doc_ids = np.frombuffer(data, "<i8", n_docs, 12)
    lengths = np.frombuffer(data, "<u8", n_docs, 12 + 8 * n_docs).astype(np.int64)
    at, parts = 12 + 16 * n_docs, []
    for _ in range(n_blocks):
        ids, at = decode_block(data, at)
        parts.append(ids)
    ids, end = np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.cumsum(lengths)
    for d, e, n in zip(doc_ids.tolist(), end.tolist(), lengths.tolist()):
        yield None if d == NULL_ID else d, ids[e - n : e]


def _write(path: str, end_id: int, file_ids: int):
    encode, end = encoder(path).ids, struct.pack("<I", end_id)

    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        part, before, kept, size = TaskContext.get().partitionId(), 0, [], 0
        for doc_id, text in docs:
            ids = encode(text or "") + end
            kept.append((doc_id, ids))
            size += len(ids) // 4
            if size >= file_ids:
                yield part, before, size, write_file(kept)
                before, kept, size = before + size, [], 0
        if kept:
            yield part, before, size, write_file(kept)

    return rows


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Files of all texts' ids in ascending doc_id order, staged in the shared folder.

    Columns: part (range of doc_id), before (ids of the part before this
    file), n_ids, data. Each document ends with end_id. Null doc_ids come
    first; rows with equal doc_ids follow each other by text; a null text is empty. Texts are
    dealt by range with their text's hash and their row's place as tie-breaks, so neither a
    repeated doc_id nor a repeated row makes a large part.
    """
    rows = texts_of(docs)
    place = F.monotonically_increasing_id()
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), place.alias("place"))
    dealt = rows.repartitionByRange(parts_for(docs, 16 << 20), "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    return staged(map_rows(dealt.select("doc_id", "text"), _write, "part int, before long, n_ids long, data binary", tokenizer, end_id, file_ids), "token-files", "none")


def _read(starts: dict[int, int], with_ids: bool):
    def rows(files: Iterable[tuple]) -> Iterator[tuple]:
        for part, before, data in files:
            at = starts[part] + before
            for doc_id, ids in read_file(data):
                yield doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes() if with_ids else None
                at += len(ids)

    return rows


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids.

    Where a part starts is summed on the driver: one number for each part,
    and parts are as many as the write's partitions (200,000 at most).
    """
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = {}, 0
    for part, n in sizes:
        starts[part] = at
        at += n
    out = map_rows(files.select("part", "before", "data"), _read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", starts, with_ids)
    return out if with_ids else out.drop("ids")

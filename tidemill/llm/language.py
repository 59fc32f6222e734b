"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to 3 bytes, counted over a
bounded sample of labelled texts and then frozen. A byte costs -log2 of its
share after the longest context (method C: a context of n bytes and d distinct
ones gives count / (n + d), and d / (n + d) to the escape to the next
shorter context; below order 0 all 256 bytes are alike; no exclusions). A text's code length under a language
is the exact sum over all its bytes, and the language of the shortest code is
predicted; the score is its posterior under equal priors.

For scoring, the trees are one sorted table an order: (context, byte) to the
cost in every language, with escapes already followed; what no language has seen
goes on to the next shorter table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import discard, exact, fresh, map_rows, staged, texts_of

ORDER, UNKNOWN = 3, "und"
#: Bytes of labelled text to learn from, over all languages; each gets an equal share of it, or all it has.
SAMPLE_BYTES = 8 << 20
#: Most characters of a piece of a text that is learnt from in part.
PIECE = 4096
#: A text is in a learnt language if its code is at most MOST_RATE times as long as is typical of the language, and SLACK bits; all documents held out say what is typical.
MOST_RATE, SLACK = 1.5, 64
#: Cells of a bit in which rates are counted first, to find their median.
CELLS = 1 << 14
_SEPARATOR = b"\n" * ORDER


@dataclass
class Trees:
    """Frozen statistics: for order d, keys[d] are sorted (context, byte) numbers with costs[d] bits by language; contexts[d] likewise with the escapes' bits."""

    languages: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def bits(self, windows: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each window's last byte after the bytes before it, by language."""
        if order < 0:
            return np.full((len(windows), len(self.languages)), 8.0, np.float32)
        own = windows & np.uint64((1 << 8 * (order + 1)) - 1)
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, own.astype(np.uint32)), len(keys) - 1)
        out = self.costs[order][at]
        if len(new := np.flatnonzero(keys[at] != own)):
            out[new] = self.bits(windows[new], order - 1)
            context = (own[new] >> np.uint64(8)).astype(np.uint32)
            place = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            seen = self.contexts[order][place] == context
            out[new[seen]] += self.escapes[order][place[seen]]
        return out


def windows_of(data: bytes) -> np.ndarray:
    """For every byte from the ORDER-th on, it and the ORDER bytes before it as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - ORDER
    out = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= b[ORDER - k : ORDER - k + n] << np.uint64(8 * k)
    return out


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def frozen(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Trees from each language's windows and how often each was seen."""
    languages = sorted(counts)
    trees = Trees(languages, [], [], [], [])
    for order in range(ORDER + 1):
        mask = np.uint64((1 << 8 * (order + 1)) - 1)
        own = {}
        for lang in languages:
            w, c = counts[lang]
            keys, at = np.unique(w & mask, return_inverse=True)
            own[lang] = keys, np.bincount(at, c)
        keys = np.unique(np.concatenate([k for k, _ in own.values()]))
        context_of = keys >> np.uint64(8)
        contexts, context_at = np.unique(context_of, return_inverse=True)
        costs, escapes = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        shorter = trees.bits(keys, order - 1)
        for j, lang in enumerate(languages):
            k, c = own[lang]
            at = np.searchsorted(keys, k)
            full = np.zeros(len(keys))
            full[at] = c
            n, d = np.bincount(context_at, full, len(contexts)), np.bincount(context_at, full > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2((n + d) / d), 0.0)
                seen = np.log2((n + d)[context_at] / full)
            escapes[:, j] = escape
            costs[:, j] = np.where(full > 0, seen, escape[context_at] + shorter[:, j])
        trees.keys.append(keys.astype(np.uint32))
        trees.costs.append(costs)
        trees.contexts.append(contexts.astype(np.uint32))
        trees.escapes.append(escapes)
    return trees


def _count():
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        kept: dict[str, list[bytes]] = {}
        size = 0

        def counted() -> Iterator[tuple]:
            for lang, parts in kept.items():
                w, c = np.unique(windows_of(_SEPARATOR + _SEPARATOR.join(parts)), return_counts=True)
                yield from zip((lang,) * len(w), w.tolist(), c.tolist())

        for lang, text in docs:
            data = normal(text)
            kept.setdefault(lang, []).append(data)
            size += len(data)
            if size > 4 << 20:
                yield from counted()
                kept, size = {}, 0
        yield from counted()

    return rows


def remainder(n: int = 5):
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def learn(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Trees from rows with text and lang; None if there are none.

    A language with less than its share of sample_bytes is learnt from whole. Of the others' texts pieces are taken by a hash of
    doc_id and piece number, in the hash's order until they make up the share, so long documents take part as short ones do.
    Twice the share is drawn first, in at least 128 expected pieces, so that it is there to be cut. Counts, not texts,
    go to the driver: as many as the sample has distinct windows.
    """
    rows = texts_of(labelled, "lang").where("text is not null and lang is not null and doc_id is not null")
    sizes = {r["lang"]: int(r["n"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r["n"]}
    if not sizes:
        return None
    share = sample_bytes // len(sizes)
    piece = max(64, min(PIECE, share // 64))
    most, limit = 1 << 32, F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(most if n <= share else min(most, int(most * 2 * share / n)))).otherwise(limit)
    small = [lang for lang, n in sizes.items() if n <= share]
    whole = rows.where(F.col("lang").isin(small)).select("lang", "text")
    drawn = lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit("ppm")), F.lit(most))
    pieces = rows.where(~F.col("lang").isin(small)).withColumn("limit", limit)
    pieces = pieces.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.floor((F.length("text") + (piece - 1)) / piece).cast("int") - 1), lambda i: drawn(i) < F.col("limit"))))
    pieces = pieces.where("length(text) > 0").select("lang", drawn(F.col("i")).alias("at"), F.col("text").substr(F.col("i") * piece + 1, F.lit(piece)).alias("text"))
    before = Window.partitionBy("lang").orderBy("at", "text").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < share)
    chosen = whole if len(small) == len(sizes) else pieces.select("lang", "text").unionByName(whole)
    counts = map_rows(chosen, _count, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    if not len(found):
        return None
    return frozen({lang: (g["window"].to_numpy(np.uint64), g["n"].to_numpy(np.float64)) for lang, g in found.groupby("lang")})


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    data = b"".join(_SEPARATOR + t for t in texts)
    windows = windows_of(data)
    out = np.zeros((len(texts), len(trees.languages)))
    ends = np.cumsum([len(t) + ORDER for t in texts]) - ORDER
    bits = np.concatenate([trees.bits(windows[i : i + (1 << 18)]) for i in range(0, len(windows), 1 << 18)]) if len(windows) else np.zeros((0, len(trees.languages)), np.float32)
    for i, (end, t) in enumerate(zip(ends.tolist(), texts)):
        out[i] = bits[end - len(t) : end].sum(0, dtype=np.float64)
    return out


def coded(trees: Trees | None, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
    """Language and score of each text, its bits under that language and its bytes; UNKNOWN and zeros where it is null or has no letter."""
    out: list[tuple[str, float, float, int]] = [(UNKNOWN, 0.0, 0.0, 0)] * len(texts)
    use = [i for i, t in enumerate(texts) if t and trees and any(map(str.isalpha, t))]
    if use:
        data = [normal(texts[i]) for i in use]
        bits = code_lengths(trees, data)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
        for i, d, b, s, n in zip(use, data, best.tolist(), share.tolist(), bits.min(1).tolist()):
            out[i] = trees.languages[b], s, n, len(d)
    return out


def predicted(trees: Trees | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; UNKNOWN and 0 where it is null or has no letter."""
    return [c[:2] for c in coded(trees, texts)]


def _rates(model):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        trees = model.value
        for lang, text in docs:
            if data := normal(text):
                yield lang, float(code_lengths(trees, [data])[0, trees.languages.index(lang)]) / len(data)

    return rows


def medians(rates: DataFrame) -> dict[str, float]:
    """The exact median of each lang's rate. Rates are counted by cells of 1 / CELLS, then by value in the cells that hold the middle; only counts go to the driver."""
    cell = F.floor(F.col("rate") * CELLS).cast("long")
    cells: dict[str, dict[int, int]] = {}
    for r in rates.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n")).collect():
        cells.setdefault(r["lang"], {})[r["cell"]] = r["n"]

    def at(counts: dict, rank: int) -> tuple:
        for x in sorted(counts):
            if rank < counts[x]:
                return x, rank
            rank -= counts[x]

    middle = {lang: [at(c, (sum(c.values()) - 1) // 2), at(c, sum(c.values()) // 2)] for lang, c in cells.items()}
    near = F.lit(False)
    for lang, found in middle.items():
        near = near | ((F.col("lang") == lang) & cell.isin([c for c, _ in found]))
    values: dict[tuple, dict[float, int]] = {}
    for r in rates.where(near).groupBy("lang", "rate", cell.alias("cell")).agg(F.count("*").alias("n")).collect():
        values.setdefault((r["lang"], r["cell"]), {})[r["rate"]] = r["n"]
    return {lang: sum(at(values[lang, c], rank)[0] for c, rank in found) / 2 for lang, found in middle.items()}


def typical_rates(unseen: DataFrame, trees: Trees, model) -> dict[str, float]:
    """Median bits a byte of each learnt language's labelled documents that weren't learnt from, over all of them and their whole texts.

    A language without such a document gets the highest rate of the others; without any at all none has a rate.
    """
    rows = texts_of(unseen, "lang").where(F.col("lang").isin(trees.languages) & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    rates = staged(map_rows(rows, _rates, "lang string, rate double", model), "rates")
    out = medians(rates)
    discard(rates)
    return {lang: out.get(lang, max(out.values())) for lang in trees.languages} if out else {}


def _predict(model):
    def rows(docs: Iterable[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        size = 0
        for d in docs:
            kept.append(d)
            size += len(d[1] or "")
            if size > 1 << 19:
                yield from ((k[0], k[2], *p) for k, p in zip(kept, predicted(model.value, [k[1] for k in kept])))
                kept, size = [], 0
        yield from ((k[0], k[2], *p) for k, p in zip(kept, predicted(model.value, [k[1] for k in kept])))

    return rows


def identify(docs: DataFrame, labelled: DataFrame | None = None, folds: int = 5, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Trees are learnt from labelled (docs itself if None), but for documents whose crc32(doc_id as text) modulo
    folds is 0. A null doc_id is never learnt from and not held out. Null texts and texts without letters are
    UNKNOWN with score 0, as all are if nothing could be learnt. Repeated rows are scored each; of equal code lengths the first language by name counts; a very long
    text is coded whole in one task; an empty table gives no rows; other columns are left behind, and of names that differ only in case the lower-case one counts. No shuffle but the sample's counts.
    """
    docs, labelled = exact(docs), labelled if labelled is None else exact(labelled)
    trees = learn((docs if labelled is None else labelled).where(remainder(folds) != 0), sample_bytes)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    rows = texts_of(docs, F.coalesce(remainder(folds) == 0, F.lit(False)).alias("held_out"))
    return map_rows(rows, _predict, "doc_id long, held_out boolean, lang_pred string, score double", model)


def keep_known(docs: DataFrame, least_score: float = 0.5, most_rate: float = MOST_RATE, **how) -> DataFrame:
    """The documents whose language is recognised, all columns as they came.

    The language's score is at least least_score, and the text's code at most most_rate times as long as is typical of that
    language (and SLACK bits for short texts), so a text in a language that wasn't learnt goes. If no language could be learnt all documents stay, with a warning.
    Null and empty texts go; repeated rows are judged each; a very long text is coded whole; an empty table stays empty. Of names that differ only in case the lower-case one counts.
    """
    names, docs = docs.columns, exact(docs)
    held = remainder(how.get("folds", 5)) == 0
    trees = learn(docs.where(~held), how.get("sample_bytes", SAMPLE_BYTES))
    if trees is None:
        warnings.warn("no language could be learnt: all documents are kept", stacklevel=2)
        return docs.toDF(*names)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    rates = typical_rates(docs.where(held), trees, model)
    verdict = fresh(docs, "language_known")

    @F.pandas_udf("boolean")
    def known(text):
        import pandas as pd

        texts, out = [t if isinstance(t, str) else None for t in text], []
        for i in range(0, len(texts), 100):
            for lang, score, bits, n in coded(model.value, texts[i : i + 100]):
                out.append(lang != UNKNOWN and score >= least_score and (lang not in rates or bits <= most_rate * rates[lang] * n + SLACK))
        return pd.Series(out, dtype=bool)

    return docs.withColumn(verdict, known.asNondeterministic()(F.col("text").cast("string"))).where(F.col(verdict)).drop(verdict).toDF(*names)

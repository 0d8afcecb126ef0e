"""Benchmark decontamination through an embedding of edit distance into Hamming distance.

Texts and items become words (lower case; anything in ASCII but letters and digits cuts). A document is
contaminated by an item when some stretch of it lies within an edit distance (in words) of
``1 - similarity`` times the item's length.

1. *Windows.* An item of n words within e edits of a stretch shares a run of
   g = min(3, ceil((n - e) / (e + 1))) unbroken words with it (pigeonhole). Wherever a document
   has such a run, the item-sized window is taken that puts it at its place in the item. No other window
   can match, so nothing is lost.
2. *Embedding.* The CGK random walk reads a word sequence and writes 3n symbols: at each step the
   current word is written, and a random bit of (step, word) decides whether the walk moves on. Sequences
   a few edits apart fall into step again soon, so their outputs agree in most places.
3. *Bit sampling.* In each repetition, a few sampled output places form a signature; windows look theirs
   up in the buckets of the items of their size. The number of repetitions follows, for each class of
   sizes (half an octave), from the target recall and the hit rate that copies of such items with all
   allowed edits show (simulated, with a fixed seed). Where the target needs more than
   ``MOST_REPETITIONS``, the windows skip the lookup: each goes with the item whose run it holds
   straight to verification, which is exact.
4. *Verification.* Each (window, item) found is checked by exact edit distance of the item against the
   best stretch around the window.

Items travel to the tasks in slices of bounded size, each slice passing over the documents once; there
is one slice unless the benchmark exceeds ``SLICE_CHARS``. A null or wordless text or item matches
nothing; repeated rows match alike; items of one wording are all reported.
An empty table, or an empty benchmark, gives no matches. A very long text is read whole in its task.
Columns other than id and text are not read by the search, so any may clash.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import ROWS_PER_BATCH, keep_rows, mix64

SIMILARITY = 0.8
RECALL = 0.99
SAMPLED = 3  # places of the embedding in one signature
LEAST_REPETITIONS = 16
MOST_REPETITIONS = 256
#: Items per class of sizes, copies of each and walks of each copy that the hit rate is measured on.
CALIBRATION = (20, 4, 96)
SLICE_CHARS = 16_000_000
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def allowed_edits(n: int, similarity: float = SIMILARITY) -> int:
    return int(math.floor((1 - similarity) * n + 1e-9))


def run_length(n: int, e: int) -> int:
    return max(1, min(3, -(-(n - e) // (e + 1))))


def walk(ids: np.ndarray, seeds: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Symbols that the CGK walks write at sampled steps.

    ``ids``: rows of n word numbers; ``seeds``: one per repetition; ``sampled``: steps, one row
    per repetition. Returns rows x repetitions x sampled. Steps beyond the last word write -1.
    """
    rows, n = ids.shape
    padded = np.c_[ids, np.full(rows, -1, dtype=ids.dtype)].astype(np.int64)
    at = np.zeros((rows, len(seeds)), dtype=np.int64)
    out = np.empty((rows, *sampled.shape), dtype=np.int64)
    row = np.arange(rows)[:, None]
    where = defaultdict(list)
    for r, steps in enumerate(sampled):
        for k, step in enumerate(steps):
            where[int(step)].append((r, k))
    for step in range(int(sampled.max()) + 1 if sampled.size else 0):
        symbol = padded[row, at]
        for r, k in where.get(step, ()):
            out[:, r, k] = symbol[:, r]
        bits = mix64(symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (seeds + np.uint64(step))[None, :])
        at = np.minimum(at + (bits & np.uint64(1)).astype(np.int64), n)
    return out


def distance(item: np.ndarray, around: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``around``, and that stretch's end."""
    m = len(around)
    ramp = np.arange(m + 1)
    row = np.zeros(m + 1, dtype=np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty(m + 1, dtype=np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (around != w))
        row = np.minimum.accumulate(new - ramp) + ramp  # words left out of the stretch
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Items of one slice: vocabulary, seeds (runs of words) and signature buckets by item size."""

    def __init__(
        self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL,
        most: int = MOST_REPETITIONS,
    ):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[object, np.ndarray, int]] = []
        for key, text in sorted(items, key=lambda x: (str(x[0]), x[1] or "")):
            words = words_of(text)
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
                self.items.append((key, ids, allowed_edits(len(ids), similarity)))
        self.base = len(self.vocabulary) + 1
        by_size = defaultdict(list)
        for i, (_, ids, _) in enumerate(self.items):
            by_size[len(ids)].append(i)
        self.repetitions = self._repetitions(recall)  # by size; None: too many, verify at once
        self.repetitions = {n: r if r <= most else None for n, r in self.repetitions.items()}
        seeds: dict[int, dict[int, set]] = {1: defaultdict(set), 2: defaultdict(set), 3: defaultdict(set)}
        for i, (_, ids, e) in enumerate(self.items):
            g = run_length(len(ids), e)
            own = i if self.repetitions[len(ids)] is None else -1
            for at, code in enumerate(self.codes(ids, g).tolist()):
                seeds[g][code].add((len(ids), at, own))
        self.seeds = {g: {c: sorted(v) for c, v in s.items()} for g, s in seeds.items()}
        self.filters = {}
        for g, s in self.seeds.items():
            bits = np.zeros(1 << 16, dtype=bool)
            bits[self.slot(np.array(list(s), dtype=np.int64))] = True
            self.filters[g] = bits
        rng = np.random.default_rng(20_240_601)
        self.walk_seeds = mix64(rng.integers(0, 2**62, max(LEAST_REPETITIONS, most)).astype(np.uint64))
        self.sampled: dict[int, np.ndarray] = {}
        self.buckets: dict[int, dict[tuple, list[int]]] = {}
        for n, own in by_size.items():
            times = self.repetitions[n]
            if times is None:
                continue
            steps = np.sort(np.random.default_rng(n).integers(0, self._reach(n), (times, SAMPLED)), axis=1)
            self.sampled[n] = steps
            table = defaultdict(list)
            for i, sig in zip(own, walk(np.stack([self.items[i][1] for i in own]), self.walk_seeds[:times], steps)):
                for r, s in enumerate(sig):
                    table[(r, *s.tolist())].append(i)
            self.buckets[n] = dict(table)

    @staticmethod
    def _reach(n: int) -> int:
        return max(1, 2 * n)  # the walk has read about every word by then; later steps write the end mark

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (mix64(codes) >> np.uint64(48)).astype(np.int64)

    def codes(self, ids: np.ndarray, g: int) -> np.ndarray:
        """Runs of g known words as one number each; 0 where a word is unknown."""
        if len(ids) < g:
            return np.zeros(0, dtype=np.int64)
        out = ids[: len(ids) - g + 1].copy()
        known = out > 0
        for k in range(1, g):
            nxt = ids[k : len(ids) - g + 1 + k]
            out = out * self.base + nxt
            known &= nxt > 0
        return np.where(known, out, 0)

    def _repetitions(self, recall: float) -> dict[int, float]:
        """Repetitions by item size, from the hit rate of one on copies of items with all allowed edits."""
        rng = random.Random(7)
        items, copies, walks = CALIBRATION
        classes = defaultdict(list)
        for i, (_, ids, _) in enumerate(self.items):
            classes[int(2 * math.log2(len(ids)))].append(i)
        seeds = mix64(np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(7919))
        out = {}
        for members in classes.values():
            rates = []
            for i in members[:: -(-len(members) // items)]:
                _, ids, e = self.items[i]
                if e == 0:
                    continue
                steps = np.sort(np.random.default_rng(len(ids)).integers(0, self._reach(len(ids)), (walks, SAMPLED)), axis=1)
                own = walk(ids[None, :], seeds, steps)
                for _ in range(copies):
                    copy = ids.tolist()
                    for _ in range(e):
                        at, kind = rng.randrange(len(copy)), rng.randrange(3)
                        copy[at : at + (kind != 2)] = [] if kind == 0 else [0]
                    copy = (copy + [0] * len(ids))[: len(ids)]
                    rates.append(float((walk(np.array([copy]), seeds, steps) == own).all(axis=2).mean()))
            need = LEAST_REPETITIONS  # without edits every repetition hits
            if rates:
                rate = min(0.9, sorted(rates)[len(rates) // 20])  # the worst twentieth
                need = max(need, math.ceil(math.log(1 - recall) / math.log(1 - rate))) if rate else math.inf
            out.update((len(self.items[i][1]), need) for i in members)
        return out

    def windows(self, ids: np.ndarray) -> set[tuple[int, int, int]]:
        """``(size, start, item)`` of every item-sized window with a seed at its place; the item is -1
        where signatures tell it."""
        found = set()
        for g, seeds in self.seeds.items():
            if not seeds:
                continue
            codes = self.codes(ids, g)
            for p in np.flatnonzero(self.filters[g][self.slot(codes)] & (codes > 0)).tolist():
                found.update((n, p - at, i) for n, at, i in seeds.get(int(codes[p]), ()))
        return found

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, int, int]]:
        """``(text number, item, edits, item words, start, end)``: the best match per text and item."""
        get = self.vocabulary.get
        docs: dict[int, np.ndarray] = {}
        windows = defaultdict(list)
        for d, text in enumerate(texts):
            words = words_of(text)
            ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
            own = self.windows(ids)
            if own:
                docs[d] = ids
                for n, start, i in own:
                    windows[n].append((d, start, i))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, own in sorted(windows.items()):
            for at in range(0, len(own), 2000):
                self._verify(n, sorted(own[at : at + 2000]), docs, best)
        for (d, i), (edits, start, end) in sorted(best.items()):
            yield d, self.items[i][0], edits, len(self.items[i][1]), start, end

    def _verify(self, n: int, own: list, docs: dict, best: dict) -> None:
        if self.repetitions[n] is None:
            near = [(i,) for _, _, i in own]
        else:
            cut = np.zeros((len(own), n), dtype=np.int64)
            for k, (d, start, _) in enumerate(own):
                a, b = max(0, start), min(len(docs[d]), start + n)
                cut[k, a - start : b - start] = docs[d][a:b]
            buckets, steps = self.buckets[n], self.sampled[n]
            found = walk(cut, self.walk_seeds[: len(steps)], steps)
            near = [sorted({i for r, s in enumerate(sig.tolist()) for i in buckets.get((r, *s), ())}) for sig in found]
        for (d, start, _), items in zip(own, near):
            for i in items:
                _, ids, e = self.items[i]
                if best.get((d, i), (1,))[0] == 0:
                    continue
                lo = max(0, start - e)
                edits, end = distance(ids, docs[d][lo : start + n + e])
                if edits <= e:
                    end += lo
                    best[(d, i)] = min(best.get((d, i), (edits, end - n, end)), (edits, max(0, end - n), end))


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_chars: int) -> Iterator[list[tuple]]:
    """The items in slices of about ``slice_chars`` characters, one at a time on the driver."""
    own = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chars = own.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    parts = -(-chars // slice_chars) if chars else 0
    for k in range(parts):
        mine = own.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        yield [(r["id"], r["text"]) for r in mine.collect()]


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    similarity: float = SIMILARITY, recall: float = RECALL, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """One row ``(id_col, item_col, edits, similarity, start, end)`` per document row and item that
    match; start and end are word positions of the best stretch (the start is end minus the item's
    length). Documents are read once per slice of items; nothing of them is shuffled."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    item_kind = benchmark.select(F.col(item_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, edits int, similarity double, start bigint, end bigint"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, rows = batch.column(0), list(index.find(batch.column(1).to_pylist()))
                if rows:
                    d, item, edits, n, start, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(d)), pa.array(item), pa.array(edits, pa.int32()),
                            pa.array([round(1 - x / k, 6) for x, k in zip(edits, n)]),
                            pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                        ],
                        names=["id", "item", "edits", "similarity", "start", "end"],
                    )

        return run

    found = None
    for items in _slices(benchmark, item_col, text_col, slice_chars):
        part = texts.mapInArrow(finder(Index(items, similarity, recall)), schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    similarity: float = SIMILARITY, recall: float = RECALL, slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """The rows whose text no item contaminates, with all their columns; no shuffle and no join."""

    def clean(index: Index):
        def keep(texts: list) -> np.ndarray:
            mask = np.ones(len(texts), dtype=bool)
            mask[[r[0] for r in index.find(texts)]] = False
            return mask

        return keep

    for items in _slices(benchmark, item_col, text_col, slice_chars):
        docs = keep_rows(docs, text_col, clean(Index(items, similarity, recall)))
    return docs

"""Passages that repeat across documents, by sparse suffix arrays.

Words are cut at ASCII white space, A-Z lower-cased. Only suffixes at content-selected positions are
retained: the minimisers, i.e. positions whose hash of ``GRAM`` words is the least among ``WINDOW``
consecutive ones. Two documents that share ``min_words`` words therefore retain the same suffix within
the first ``WINDOW`` words of the passage.

1. *Sort.* Retained suffixes are range-sorted by the hash of their first ``min_words - WINDOW`` words
   (the head), then by document; a head is of use if a neighbour of another document has the same.
2. *Compare.* Suffixes with such heads are range-sorted by head, the words after it, the words before it
   (backwards) and document. Each is compared with the nearest neighbours of another document.
3. *Extend.* Equal words to the right of the head and to the left of the suffix extend the match. Among
   the suffixes that agree in t words after the head, the neighbours in the order of the words before it
   have the longest extension to the left; t runs over all lengths that can make up ``min_words``. The
   matches of a document are merged into spans, so that a long passage is covered from its first to its
   last word by overlapping matches.

A very frequent passage is sorted like any other: the sort keys hold the document, so its suffixes are
cut over many ranges, and each is compared with two neighbours only. The rows at the range borders are
compared in a sort of their own by their nearest neighbours only: there a span may
end some words early, and a document whose only repeat is about ``min_words`` long can be missed (seen: 1 of
67,721 documents between two runs with different borders). Contexts are compared by 24-bit word codes.

Only documents with a span are returned. Null, empty and short texts have none; a passage that repeats
within one document, or in rows of the same id, does not count.
Rows without an id are left out, on either side of a match. A very long text is one array of hashes in its
task and has a row per retained suffix. An empty table gives no rows; columns other than id and text are not
read, so any may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import map_rows, mix64, words_of
from opsweave.session import cut_lineage

MIN_WORDS = 50
GRAM = 4
WINDOW = 16
CODE = 3  # bytes of a word code
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHED = 400_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        base = np.full(2 * n, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        base[0] = 1
        _POWERS[kind] = np.cumprod(base, dtype=np.uint64)
    return _POWERS[kind][:n]


def hashes(text: str | None) -> np.ndarray:
    return np.array([_HASHES[w] for w in words_of(text)], dtype=np.uint64)


def stretch_hashes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` words from each position: differences of running sums, shifted back."""
    sums = np.r_[np.uint64(0), np.cumsum(h * _powers("up", len(h)), dtype=np.uint64)]
    return mix64((sums[at + length] - sums[at]) * _powers("down", len(h) + 1)[at])


def minimisers(h: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Positions whose gram hash is the least of a window; of equal ones the first."""
    n = len(h) - gram + 1
    if n < window:
        return np.zeros(0, dtype=np.int64)
    g = stretch_hashes(h, np.arange(n), gram)
    least = np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + np.arange(n - window + 1)
    return np.unique(least)


def retained(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of retained suffixes that have a whole head, and the hashes of their heads."""
    head = min_words - WINDOW
    if len(h) < min_words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = minimisers(h)
    at = at[at + head <= len(h)]
    return at, stretch_hashes(h, at, head).view(np.int64)


def contexts(h: np.ndarray, at: np.ndarray, head: int) -> tuple[list[bytes], list[bytes]]:
    """Word codes after the head and before the suffix (backwards), ``WINDOW`` each; 0 past the text."""
    codes = np.zeros((len(h) + 2 * WINDOW, CODE), dtype=np.uint8)
    value = (h >> np.uint64(40)) % np.uint64((1 << 24) - 1) + np.uint64(1)
    for k in range(CODE):
        codes[WINDOW : WINDOW + len(h), k] = (value >> np.uint64(8 * (CODE - 1 - k))).astype(np.uint8)
    steps = np.arange(WINDOW)
    right = codes[WINDOW + at[:, None] + head + steps].reshape(len(at), -1)
    left = codes[WINDOW + at[:, None] - 1 - steps].reshape(len(at), -1)
    return [r.tobytes() for r in right], [r.tobytes() for r in left]


def _runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a sorted partition the nearest rows before and after it of another document or
    another head (-1 or the number of rows if there are none)."""
    n = len(start)
    begins = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    ends = np.r_[begins[1:], n]
    return begins[run] - 1, ends[run]


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words at the beginning of word-code rows."""
    equal = (a == b).all(axis=2) & (a != 0).any(axis=2)
    return np.minimum.accumulate(equal, axis=1).sum(axis=1)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    n, out = table.num_rows, np.zeros(table.num_rows, dtype=bool)
    out[:1] = True
    for c in names:
        col = table.column(c).chunk(0)
        out[1:] |= ~np.asarray(pc.equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False), dtype=bool)
    return out


def _shared_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose neighbour has the same head; also the first and last row, as border rows."""
    table = _whole(batches)
    if table is None:
        return
    new = _changes(table, ["key"])
    hit = ~new
    hit[:-1] |= ~new[1:]
    border = np.zeros(len(new), dtype=bool)
    border[[0, -1]] = True
    for mask, flag in ((hit, False), (border, True)):
        part = table.filter(pa.array(mask))
        for b in part.append_column("border", pa.array(np.full(part.num_rows, flag))).to_batches(50_000):
            yield b


def _matches(head: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        n, docs = table.num_rows, table.column("id").chunk(0)
        code = {
            c: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint8).reshape(n, WINDOW, CODE)
            for c in ("right", "left")
        }
        at = table.column("pos").to_numpy()
        start, end, other = at + head, at.copy(), np.full(n, -1)
        doc = docs.dictionary_encode().indices.to_numpy()
        reversed_left = code["left"].reshape(n, -1).copy().view(f"S{WINDOW * CODE}")[:, 0]
        by_left = np.unique(reversed_left, return_inverse=True)[1]
        group = np.cumsum(_changes(table, ["key"]))
        for t in range(WINDOW + 1):  # suffixes whose first t words after the head agree, by what is before
            order, size = np.arange(n), np.bincount(group)
            order = order[size[group] > 1]
            if t:
                order = order[(code["right"][order, t - 1] != 0).any(axis=1)]
            order = order[np.lexsort((doc[order], by_left[order], group[order]))]
            own = group[order]
            new = np.r_[True, (own[1:] != own[:-1]) | (doc[order][1:] != doc[order][:-1])][: len(own)]
            for near in _runs(new):
                has = np.flatnonzero((near >= 0) & (near < len(order)))
                has = has[own[near[has]] == own[has]]
                for lo in range(0, len(has), 50_000):
                    i, j = order[has[lo : lo + 50_000]], order[near[has[lo : lo + 50_000]]]
                    left = _same(code["left"][i], code["left"][j])
                    good = head + t + left >= min_words
                    i, j, left = i[good], j[good], left[good]
                    start[i] = np.minimum(start[i], at[i] - left)
                    end[i] = np.maximum(end[i], at[i] + head + t)
                    other[i] = j
            if t < WINDOW:
                differs = np.zeros(n, dtype=bool)
                differs[1:] = (code["right"][1:, t] != code["right"][:-1, t]).any(axis=1)
                group = np.cumsum(differs | np.r_[True, group[1:] != group[:-1]])
        before, after = _runs(_changes(table, ["key", "id"]))
        found = np.flatnonzero(other >= 0)
        edge = np.flatnonzero((before < 0) | (after >= n))  # the first and the last run
        for rows, border in ((found, False), (edge, True)):
            part = table.take(pa.array(rows))
            cols = {
                "key": part.column("key"), "id": part.column("id"), "pos": part.column("pos"),
                "right": part.column("right") if border else pa.nulls(len(rows), pa.binary()),
                "left": part.column("left") if border else pa.nulls(len(rows), pa.binary()),
                "start": pa.array(start[rows], pa.int64()), "end": pa.array(end[rows], pa.int64()),
                "other": docs.take(pa.array(np.maximum(other[rows], 0))), "border": pa.array(np.full(len(rows), border)),
            }
            yield from pa.table(cols).to_batches(50_000)

    return run


def _compare(rows: DataFrame, order: list[str], fn, schema: str) -> DataFrame:
    """Range-sort, compare neighbours within each range, then do the same with the border rows (two
    runs per range) in one task. Returns what was found; cut, as it is read twice."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = cut_lineage(spread.mapInArrow(fn, schema))
    border = found.where("border").select(*rows.columns).repartition(1).sortWithinPartitions(*order)
    return found.where("not border").union(border.mapInArrow(fn, schema).where("not border")).drop("border")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row ``(id_col, spans, partners)`` per document with a repeated passage: spans of word
    positions (end exclusive), in order, and the ids of compared neighbours that share one."""
    if min_words < 2 * WINDOW + GRAM:
        raise ValueError(f"passages of at least {2 * WINDOW + GRAM} words")
    head = min_words - WINDOW
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    kind = own.schema["id"].dataType.simpleString()

    def heads(row) -> Iterator[tuple]:
        keys = np.unique(retained(hashes(row[1]), min_words)[1])
        if len(keys):
            yield row[0], keys.tolist()

    # written once, as the range sort reads its input twice
    suffixes = cut_lineage(map_rows(own, heads, f"id {kind}, keys array<bigint>")).select("id", F.explode("keys").alias("key"))
    shared = _compare(
        suffixes.select("key", "id"), ["key", "id"], _shared_heads, f"key bigint, id {kind}, border boolean"
    )
    wanted = shared.groupBy(F.col("id").alias("_w")).agg(F.collect_set("key").alias("keys"))
    texts = own.join(wanted, own["id"] == wanted["_w"]).select("id", "text", "keys")

    def suffix_rows(row) -> Iterator[tuple]:
        h = hashes(row[1])
        at, keys = retained(h, min_words)
        of_use = np.isin(keys, np.array(row[2], dtype=np.int64))
        at, keys = at[of_use], keys[of_use]
        if len(at):
            right, left = contexts(h, at, head)
            for k, p, r, lt in zip(keys.tolist(), at.tolist(), right, left):
                yield k, row[0], p, r, lt

    rows = map_rows(texts, suffix_rows, f"key bigint, id {kind}, pos bigint, right binary, left binary")
    found = _compare(
        rows, ["key", "right", "left", "id", "pos"], _matches(head, min_words),
        f"key bigint, id {kind}, pos bigint, right binary, left binary, start bigint, end bigint, "
        f"other {kind}, border boolean",
    )
    per = found.groupBy("id").agg(
        F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("other")).alias("partners")
    )

    def merged(row) -> Iterator[tuple]:
        spans: list[list[int]] = []
        for a, b in sorted((x["start"], x["end"]) for x in row[1]):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        yield row[0], [tuple(x) for x in spans], row[2]

    out = map_rows(per, merged, f"id {kind}, spans array<struct<start:bigint,end:bigint>>, partners array<{kind}>")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(id_col, F.size("spans").cast("long").alias("n_spans"), words.alias("n_words"), text.alias("spans"), "partners")

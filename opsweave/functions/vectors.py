"""Vectors: n-gram hashing, cosine and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k, with_row_index

# Size of the n-gram vector, FNV-1a (32 bit) start and prime.
DIM = 128
FNV_START = np.uint32(2166136261)
FNV_PRIME = np.uint32(16777619)


#: Characters whose grams are hashed at once.
BLOCK_CHARS = 1 << 17


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, int]]:
    """``(text number, code points, grams' starts)``: long texts in pieces that overlap by a gram."""
    for at, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for lo in range(0, max(len(points) - 2, 0), BLOCK_CHARS):
            yield at, points[lo : lo + BLOCK_CHARS + 5], min(BLOCK_CHARS, len(points) - lo)


def _add_grams(out: np.ndarray, pieces: list[tuple[int, np.ndarray, int]]) -> None:
    points = np.concatenate([p for _, p, _ in pieces])
    sizes = np.array([len(p) for _, p, _ in pieces])
    begins = np.cumsum(sizes) - sizes
    offset = np.arange(len(points)) - np.repeat(begins, sizes)
    left = np.repeat(sizes, sizes) - offset
    owner = np.repeat([at for at, _, _ in pieces], sizes)
    one, two, three = points < 0x80, points < 0x800, points < 0x10000
    last = 0x80 | (points & 0x3F)
    second, third = 0x80 | (points >> 6 & 0x3F), 0x80 | (points >> 12 & 0x3F)
    octets = (
        np.where(one, points, np.where(two, 0xC0 | points >> 6, np.where(three, 0xE0 | points >> 12, 0xF0 | points >> 18))),
        np.where(two, last, np.where(three, second, third)),
        np.where(three, last, second),
        last,
    )
    width = 4 - one.astype(int) - two - three
    starts = np.flatnonzero(offset < np.repeat([n for _, _, n in pieces], sizes))
    state = np.full(len(starts), FNV_START, dtype=np.uint32)
    for step in range(6):
        fits = left[starts] > step
        starts, state = starts[fits], state[fits]
        at = starts + step
        for j in range(4):
            here = np.flatnonzero(width[at] > j)
            state[here] = (state[here] ^ octets[j][at[here]].astype(np.uint32)) * FNV_PRIME
        if step >= 2:
            sign = np.where(state >> np.uint32(31) == 0, 1.0, -1.0)
            cells = owner[starts] * DIM + state % DIM
            out += np.bincount(cells, weights=sign, minlength=out.size).reshape(out.shape)


def _ngram_vectors(texts: Sequence[str | None]) -> np.ndarray:
    """Signed counts of the hashed 3- to 6-character grams per text, length 1; a block of characters at a time."""
    out = np.zeros((len(texts), DIM))
    block: list[tuple[int, np.ndarray, int]] = []
    chars = 0

    def flush() -> None:
        first = block[0][0]
        _add_grams(out[first : block[-1][0] + 1], [(at - first, p, n) for at, p, n in block])

    for piece in _pieces(texts):
        if block and chars + len(piece[1]) > BLOCK_CHARS:
            flush()
            block, chars = [], 0
        block.append(piece)
        chars += len(piece[1])
    if block:
        flush()
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def ngram_vector(text: Column) -> Column:
    """The n-gram vector of a text column, computed per Arrow batch."""

    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_ngram_vectors(texts.tolist())), index=texts.index, dtype=object)

    return F.pandas_udf(vectors, "array<double>")(text)


def spaced_name(name: Column) -> Column:
    """``handlePayment``, ``get_user`` -> lower-case words."""
    cut = F.regexp_replace(name, r"(?U)(\p{Lu})", "_$1")
    return F.array_join(F.filter(F.transform(F.split(cut, "[_-]+"), F.lower), lambda w: w != ""), " ")


def embed_text(name: Column, file: Column, params: Column, body: Column) -> Column:
    """Name three times, file stem twice, path words, parameters, 100 characters of body."""
    stem = F.element_at(F.split(file, "/"), -1)
    for end in (".ts", ".js", ".py", ".rs"):
        stem = F.replace(stem, F.lit(end), F.lit(""))
    n, f = spaced_name(name), spaced_name(stem)
    path = F.translate(file, "/.", "  ")
    return F.concat_ws(" ", n, n, n, f, f, path, F.array_join(params, " "), F.substring(body, 1, 100))


def cosine(a: Column, b: Column) -> Column:
    """0 when the lengths differ or one vector is zero."""

    def total(x: Column, y: Column) -> Column:
        parts = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), total(a, b) / size).otherwise(F.lit(0.0))


SLICE = 2048


def _best_cells(sims: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest values per row (ties: smallest id) that reach ``least``, which is raised
    to a row's k-th value. Only those values are sorted."""
    ranks = np.empty(len(ids), dtype=np.int64)
    ranks[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    asked = np.where(np.isnan(sims), -np.inf, sims)
    if len(ids) > k:
        np.maximum(least, np.partition(asked, len(ids) - k, axis=1)[:, len(ids) - k], out=least)
    rows, cols = np.nonzero(asked >= least[:, None])
    order = np.lexsort((ranks[cols], -asked[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, slice_rows: int = SLICE) -> DataFrame:
    """Exact top ``k`` by cosine: ``vectors(id, vector)``, ``queries(qid, vector)``.

    Queries travel to the tasks in slices of bounded size, one pass per slice; a
    task scores its batches by matrix product and keeps k rows per query.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    n = queries.count()
    indexed = with_row_index(queries, ["qid"]) if n > slice_rows else queries.withColumn("row_index", F.lit(0))
    out = None
    for lo in range(0, max(n, 1), slice_rows):
        part = indexed.where(F.col("row_index").between(lo, lo + slice_rows - 1)) if n > slice_rows else indexed
        rows = part.select("qid", "vector").collect()
        qids = np.array([r.qid for r in rows], dtype=object)
        matrix = np.array([r.vector for r in rows], dtype=float)
        if len(rows):
            sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
            matrix = np.divide(matrix, sizes, out=np.zeros_like(matrix), where=sizes > 0)

        def score(frames: Iterator[pd.DataFrame], qids=qids, matrix=matrix) -> Iterator[pd.DataFrame]:
            least = np.full(len(qids), -np.inf)  # the k-th best of a batch so far, per query
            for pdf in frames:
                if pdf.empty or not len(qids):
                    continue
                fits = pdf["vector"].map(len).to_numpy() == matrix.shape[1]
                block = np.zeros((len(pdf), matrix.shape[1]))
                if fits.any():
                    block[fits] = np.stack(pdf["vector"][fits].to_numpy())
                size = np.linalg.norm(block, axis=1, keepdims=True)
                block = np.divide(block, size, out=np.zeros_like(block), where=size > 0)
                sims = matrix @ block.T
                ids = pdf["id"].to_numpy()
                rows, cols = _best_cells(sims, ids, k, least)
                yield pd.DataFrame({"qid": qids[rows], "id": ids[cols], "similarity": sims[rows, cols]})

        hit = vectors.select("id", "vector").mapInPandas(
            score, f"qid {qkind}, id {kind}, similarity double"
        )
        out = hit if out is None else out.unionByName(hit)
    return top_k(out, ["qid"], [F.desc("similarity"), F.col("id")], k)

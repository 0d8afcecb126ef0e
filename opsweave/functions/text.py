"""Text helpers: masks, severities, name parts and an exact substring join.

Patterns carry ``(?U)``: ``\\b``, ``\\d`` and ``\\w`` mean Unicode classes, as log
text is multilingual. Where a pattern begins with ``\\b``, the characters that may follow are asked for first, case
variants outside ASCII included: that changes no match, and testing a Unicode word boundary at every character of a
line is what takes the time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from opsweave.functions.sizes import shuffled
from opsweave.session import cut_lineage

# Mask patterns in their order.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
POD_MASKS = (
    (UUID, "<UUID>"),
    (r"(?U)(?=\d)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "<IP>"),
    (r"(?U)(?=0x)\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"(?U)(?=\d)\b\d+\b", "<N>"),
)
HOST_MASKS = (
    (UUID, "<UUID>"),
    (r"(?U)(?=\d)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"(?U)(?=[0-9a-fA-F])(?:\b0x[0-9a-fA-F]{8,}\b|\b[0-9a-fA-F]{9,}\b)", "<HEX>"),
    (r"(?U)(?=\d)\b\d{4,}\b", "<NUM>"),
)
# Severity patterns in their order.
DROP = r"(?=[dDtThHrRlL/])(?iU)\b(DEBUG|TRACE|healthz|readyz|livez|/metrics\s)"
FATAL = r"(?=[FPp])(?U)\b(FATAL|PANIC|panic:)\b"
ERROR = r"(?=[eEtT])(?iU)\b(ERROR|ERR|Exception|Traceback|error:)\b"
WARN = r"(?=[wW])(?iU)\b(WARN|WARNING)\b"
HIGH_SIGNAL = (
    r"(?=[oOcCiI\u0130\u0131dDpPeEtTsS\u017f5kK\u212avVrRnN])"
    r"(?iU)\b(OOMKilled|CrashLoopBackOff|ImagePullBackOff|connection\s+refused|dial\s+tcp|"
    r"permission\s+denied|ENOENT|EACCES|timeout|timed\s+out|segmentation\s+fault|segfault|"
    r"5\d\d\s|KeyError|ValueError|RuntimeError|NullPointerException|no\s+such\s+file)"
)
MAX_LINE_BYTES = 8192


def masked(line: Column, masks: Sequence[tuple[str, str]]) -> Column:
    """Variable parts replaced; lines with no digit and no hex run are left as they are."""
    out = line
    for pattern, token in masks:
        out = F.regexp_replace(out, pattern, token)
    return F.when(line.rlike(r"(?U)\d|[0-9a-fA-F]{8}"), out).otherwise(line)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def line_severity(line: Column) -> Column:
    """FATAL, ERROR or WARN; null for lines that carry no signal."""
    size = F.octet_length(line)
    return (
        F.when(line.isNull() | (size == 0) | (size > MAX_LINE_BYTES) | line.rlike(DROP), None)
        .when(line.rlike(FATAL), "FATAL")
        .when(line.rlike(ERROR), "ERROR")
        .when(line.rlike(WARN) | line.rlike(HIGH_SIGNAL), "WARN")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "FATAL", 3).when(severity == "ERROR", 2).when(
        severity.isin("WARN", "WARNING"), 1
    ).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "FATAL").when(rank == 2, "ERROR").when(rank == 1, "WARN").otherwise("INFO")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of the words.

    One pattern of quoted literals: the text (often an expression) is evaluated once,
    not once per word, and most positions are rejected by their first character.
    """
    firsts = "".join(sorted({"\\" + w[0] if not w[0].isalnum() else w[0] for w in words}))
    return text.rlike(f"(?=[{firsts}])(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")


#: Filed needles (with their row overhead) that may be broadcast.
BROADCAST_BYTES = 16_000_000
#: Needles are filed under runs of so many bytes: of the first of these lengths that they have.
GRAM_BYTES = (8, 4, 3, 2, 1)
#: Sizes of the table of bits that tells texts which grams are in use: at most 16 MB.
SLOTS = (32_749, 1_048_573, 16_777_213, 134_217_689)
#: Bytes whose grams are made at once.
CHUNK_BYTES = 1 << 21


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value begins; the last number is the end."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), ends


def _grams(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(value number, gram)`` of every run of ``size`` bytes within a value, as a whole number each."""
    for lo in range(ends[0], ends[-1], CHUNK_BYTES):
        hi = min(lo + CHUNK_BYTES, ends[-1] - size + 1)
        if hi <= lo:
            return
        gram = np.zeros(hi - lo, dtype=np.uint64)
        for i in range(size):
            gram |= data[lo + i : hi + i].astype(np.uint64) << np.uint64(8 * i)
        first, last = np.searchsorted(ends, (lo, hi - 1), "right") - 1
        rows = np.repeat(np.arange(first, last + 1), np.diff(np.clip(ends[first : last + 2], lo, hi)))
        inside = np.arange(lo + size, hi + size) <= ends[rows + 1]
        yield rows[inside], gram[inside].view(np.int64)


def _once(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each gram of a value once."""
    rows, grams = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _needle_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(needle, size, gram)`` for rows ``(needle, its bytes)``: all grams of the first length that the needle has."""
    for batch in batches:
        data, ends = _bytes_of(batch.column(1))
        long = np.diff(ends)
        sizes = np.select([long >= n for n in GRAM_BYTES], GRAM_BYTES, 0)
        found = []
        for size in set(sizes.tolist()) - {0}:
            found += [(rows[sizes[rows] == size], grams[sizes[rows] == size]) for rows, grams in _grams(data, ends, size)]
        rows, grams = _once(found)
        kept = batch.column(0).take(pa.array(rows))
        yield pa.record_batch([kept, pa.array(sizes[rows], pa.int32()), pa.array(grams)], names=["_needle", "_size", "_gram"])


def _text_grams(sizes: Sequence[int], slots: int, used) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows ``(..., bytes)`` one row per gram that may be in use, with the gram instead of the bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = used.value
        for batch in batches:
            *kept, text = batch.columns
            data, ends = _bytes_of(text)
            found = []
            for size in sizes:
                for rows, grams in _grams(data, ends, size):
                    at = np.remainder(grams, slots)
                    there = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    found.append((rows[there], grams[there]))
            rows, grams = _once(found)
            at = pa.array(rows)
            yield pa.record_batch([*(c.take(at) for c in kept), pa.array(grams)], names=[*batch.schema.names[:-1], "_gram"])

    return made


def _bits(filed: DataFrame, slots: int) -> np.ndarray:
    """The table of bits of the filed grams."""
    at = F.pmod("_gram", F.lit(slots))
    parts = filed.groupBy(F.shiftright(at, 15).alias("_part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("_bits"))
    out = np.zeros(((slots >> 15) + 1, 4096), dtype=np.uint8)
    for part, bits in parts.collect():
        out[part] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def contains_join(
    texts: DataFrame,
    text: str,
    needles: DataFrame,
    needle: str,
    on: Sequence[str] = (),
    min_length: int = 4,
) -> DataFrame:
    """Exact substring join: rows of ``texts`` whose ``text`` contains ``needle``.

    Every needle is filed once under its rarest run of 8 bytes, or of 4 if it is shorter, or under itself if it has less. A text
    sends out only its own hash with those of its grams that a table of bits of fixed size shows to be in use; the (text hash,
    needle) pairs found there meet the text once and are verified. Work follows the text length and the real candidates, not
    the product of the two sides, and no text is copied per gram. Needles under ``min_length`` characters, at most four, never
    match. ``on`` columns must be equal on both sides. The filed needles are
    broadcast after a check of their size; beyond it both sides are sorted, which splits hot grams.
    """
    on = list(on)
    columns = [c for c in needles.columns if c not in on]
    asked = needles.where(F.length(needle) >= max(min(min_length, 4), 1)).select(*on, needle).distinct()
    words = asked.select(F.col(needle).alias("_needle")).distinct()
    each = words.select("_needle", F.col("_needle").cast("binary").alias("_bytes")).mapInArrow(
        _needle_grams, "_needle string, _size int, _gram long"
    )
    spread = each.groupBy("_gram").agg(F.count("*").alias("_n"))
    anchor = F.min(F.struct("_n", "_size", "_gram")).alias("_a")
    filed = cut_lineage(
        each.join(shuffled(spread), "_gram").groupBy("_needle").agg(anchor).select(F.col("_needle").alias(needle), "_a._size", "_a._gram")
    )
    lengths, n = filed.agg(F.collect_set("_size"), F.approx_count_distinct("_gram")).collect()[0]
    slots = next((s for s in SLOTS if s >= 32 * n), SLOTS[-1])
    used = texts.sparkSession.sparkContext.broadcast(_bits(filed, slots))
    filed = filed.drop("_size")
    if on:
        filed = asked.join(shuffled(filed), needle).select(*on, needle, "_gram")
    size = filed.agg(F.sum(F.length(needle) + 32)).first()[0] or 0
    own = F.xxhash64(*on, text)
    sent = texts.select(*on, own.alias("_hash"), F.col(text).cast("binary").alias("_gram"))
    shape = StructType([*sent.schema.fields[:-1], StructField("_gram", LongType())])
    looked = sent.mapInArrow(_text_grams(sorted(lengths), slots, used), shape)
    small = F.broadcast(filed) if size <= BROADCAST_BYTES else shuffled(filed)
    pairs = looked.join(small, [*on, "_gram"]).select(*on, "_hash", needle).distinct()
    hit = texts.withColumn("_hash", own).join(pairs.hint("merge"), [*on, "_hash"])
    hit = hit.where(F.col(text).contains(F.col(needle))).drop("_hash")
    if columns == [needle]:
        return hit
    return hit.join(needles if size <= BROADCAST_BYTES else shuffled(needles), [*on, needle])

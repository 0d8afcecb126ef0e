"""Periodic runs of words: maximal stretches that repeat with a period, over tiles of every scale.

A run is a stretch of consecutive words with smallest period q and at least ``max(min_words, min_repeats * q)``
words, which no neighbouring word extends. Words are compared exactly.

1. *Tiles.* Periods are dealt with by octave, those of [d/2, d) together (the first octave also has all smaller
   ones). The octave's boundaries stand ``d`` words apart; a run is longer than its period by d words at least,
   so for some boundary c it covers [c, c + q). The tile of c is [c - d, c + 2d): tiles overlap, and each is solved alone.
2. *Solve.* Words c and on must equal words c + q and on, or those before c those before c + q, for half a tile step:
   hashes of d/2 words name the periods in question. The Z-function of the words after the boundary, and that of the
   words before it read backwards, give how far the equality reaches, up to the tile's edge. A period whose
   first q words are themselves a repetition is left to its smallest period. What is found is an interval of
   matches (word i equals word i + q), clipped at the tile.
3. *Stitch.* Fragments of one document and period are shuffled together; touching intervals become one.
   Intervals of two runs of one period never touch, so the union is exact. Fragments that a task holds
   of one document are joined before the shuffle.

Texts of more than ``PIECE`` words are exploded: rows of tiles, each octave in pieces of its own, are dealt to
other tasks, so a very long document is no single task's work. Shorter ones are solved where they are read,
a batch of documents in one array. No period is left out at any length.

A null, empty or wordless text has no words and no run. Every row is a document of its own: ids may be null or
repeat, and equal rows have equal results. Columns other than id and text are not read. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.llm.common import ROWS_PER_BATCH, _arrow_schema, mix64
from opsweave.session import cut_lineage

MIN_WORDS = 24
MIN_REPEATS = 3
FIRST = 16  # tile step of the first octave: below, MIN_WORDS - q + 1 places hold a boundary
PIECE = 1 << 17
BATCH_WORDS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def least_words(q, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS):
    return np.maximum(min_words, min_repeats * q)


def first_step(min_words: int, min_repeats: int) -> int:
    """The largest power of two that is a tile step for all periods below it."""
    if min_words < 4 or min_repeats < 3:
        raise ValueError("runs of at least 4 words and 3 repeats")
    d = 2
    while all(max(min_words, min_repeats * q) - q >= 2 * d for q in range(1, 2 * d)):
        d *= 2
    return d


def octaves(longest: int, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> Iterator[tuple[int, int, int]]:
    """``(first period, last + 1, tile step)`` of every octave that a text of ``longest`` words can hold."""
    d = first_step(min_words, min_repeats)
    low = 1
    while max(min_words, min_repeats * low) <= longest:
        yield low, d, d
        low, d = d, 2 * d


def z_function(v: list) -> list[int]:
    """Common words of v and each of its suffixes; the whole length at 0."""
    n = len(v)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and v[k] == v[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _largest_divisors(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + ([q // rest] if rest > 1 else [])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def solve(
    codes: np.ndarray, octave: tuple[int, int, int], first: int = 0, last: int | None = None,
    min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, powers: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[tuple[int, int, int]]:
    """Fragments ``(q, lo, hi)`` of one octave: word i equals word i + q for i in [lo, hi), smallest periods only.

    Boundaries are the multiples of the tile step in [first, last); touching fragments of a period are one.
    """
    q0, q1, d = octave
    half, n = d // 2, len(codes)
    last = n if last is None else last
    tiles = -(-last // d) - first // d
    if tiles <= 0 or n <= q0:
        return []
    up, down = powers or _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(codes) * up[:n], dtype=np.uint64, out=sums[1:])
    # hashes of the half words from each place; a place with fewer of them hashes to itself and matches none
    wide = np.arange(n + 2 * d + half, dtype=np.uint64)
    if n >= half:
        wide[half : n + 1] = mix64((sums[half:] - sums[: n - half + 1]) * down[: n - half + 1])
    base = first // d * d

    def hits(shift: int) -> np.ndarray:  # places c and c + q, half words from c - shift on
        at = base + half - shift
        part = wide[at : at + tiles * d]
        if len(part) < tiles * d:
            part = np.r_[part, np.arange(tiles * d - len(part), dtype=np.uint64) | np.uint64(1 << 63)]
        part = part.reshape(tiles, d)
        return part[:, q0:q1] == part[:, :1]

    tile, period = np.nonzero(hits(0) | hits(half))
    out: dict[int, list[list[int]]] = {}
    at = 0
    while at < len(tile):
        end = int(np.searchsorted(tile, tile[at], side="right"))
        c = base + int(tile[at]) * d
        ahead = codes[c : c + 2 * d].tolist()
        z = z_function(ahead)
        before = codes[max(0, c - d) : c][::-1].tolist()
        back = z_function(before + [-1] + codes[max(0, c - d) : c + d][::-1].tolist())
        reach = min(d, n - c) - 1 + len(before) + 1  # index of word c + q - 1, read backwards, plus q
        for q in (period[at:end] + q0).tolist():
            if q >= len(ahead):
                continue
            forward, backward = min(z[q], d), back[reach - q + 1] if q <= min(d, n - c) else 0
            clipped = forward == d or backward == d
            if not clipped and forward + backward + q < max(min_words, min_repeats * q):
                continue
            if any(z[p] >= q - p for p in _largest_divisors(q)):
                continue
            lo, hi = c - backward, c + forward
            kept = out.setdefault(q, [])
            if kept and lo <= kept[-1][1]:
                kept[-1][1] = max(kept[-1][1], hi)
            else:
                kept.append([lo, hi])
        at = end
    return [(q, lo, hi) for q, own in out.items() for lo, hi in own]


def _fragments(texts: list[np.ndarray], min_words: int, min_repeats: int) -> list[list[tuple[int, int, int]]]:
    """Of each text the fragments, all texts in one array per octave; a word between two is like no other."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    powers = _powers(int(lengths.sum()) + len(texts))
    for octave in octaves(int(lengths.max(initial=0)), min_words, min_repeats):
        able = np.flatnonzero(lengths >= max(min_words, min_repeats * octave[0]))
        codes = np.concatenate([x for k in able for x in (texts[k], np.array([(1 << 40) + k]))])
        begin = np.r_[0, np.cumsum(lengths[able] + 1)]
        for q, lo, hi in solve(codes, octave, 0, None, min_words, min_repeats, powers):
            k = int(np.searchsorted(begin, lo, side="right")) - 1
            if hi - lo + q >= max(min_words, min_repeats * q):
                out[able[k]].append((q, lo - int(begin[k]), hi - int(begin[k])))
    return out


def pieces(codes: np.ndarray, piece: int, min_words: int, min_repeats: int) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """``(q0, q1, d, at, first, last, words)``: tiles of the boundaries [first, last), with the words from ``at`` on."""
    n = len(codes)
    for q0, q1, d in octaves(n, min_words, min_repeats):
        step = max(d, piece // d * d)
        for first in range(0, n, step):
            at, last = max(0, first - d), min(n, first + step)
            yield q0, q1, d, at, first, last, codes[at : last + 2 * d].astype("<i4").tobytes()


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    min_repeats: int = MIN_REPEATS, piece: int = PIECE,
) -> DataFrame:
    """One row ``(id_col, n_words, runs, words_sha256, text)`` per row: runs by start, then period, as
    ``(start, length, period)`` in words; the hash is of the words joined by one space; ``text`` is null without runs."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"key bigint, id {kind}, n bigint, sha string, text string, q bigint, lo bigint, hi bigint, "
        "q0 bigint, q1 bigint, d bigint, at bigint, first bigint, last bigint, codes binary"
    )
    fields = _arrow_schema(spark, schema)

    def batch_of(out: list[tuple]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    def cut(batches) -> Iterator:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            at = 0
            while at < batch.num_rows:
                known: dict[bytes, int] = {}
                own, total = [], 0
                while at < batch.num_rows and total < BATCH_WORDS:
                    words = words_of(columns[2][at])
                    sha = hashlib.sha256(b" ".join(words)).hexdigest()
                    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
                    own.append((columns[0][at], columns[1][at], sha, columns[2][at], codes))
                    total, at = total + len(words), at + 1
                short = [k for k, x in enumerate(own) if len(x[4]) <= piece]
                found = dict(zip(short, _fragments([own[k][4] for k in short], min_words, min_repeats)))
                out = []
                for k, (key, i, sha, text, codes) in enumerate(own):
                    several = len(codes) > piece
                    out.append((key, i, len(codes), sha, text if several or found[k] else None, *[None] * 10))
                    out += [(key, None, None, None, None, *x, *[None] * 7) for x in found.get(k, ())]
                    if several:
                        yield batch_of(out)
                        out = []
                        for x in pieces(codes, piece, min_words, min_repeats):
                            yield batch_of([(key, *[None] * 7, *x)])
                for lo in range(0, len(out), 50_000):
                    yield batch_of(out[lo : lo + 50_000])

    made = cut_lineage(rows.mapInArrow(cut, schema))  # texts with runs only, and the pieces of long texts

    def solved(batches) -> Iterator:
        for batch in batches:
            for x in batch.to_pylist():
                codes = np.frombuffer(x["codes"], dtype="<i4").astype(np.int64)
                at, octave = x["at"], (x["q0"], x["q1"], x["d"])
                out = solve(codes, octave, x["first"] - at, x["last"] - at, min_words, min_repeats)
                none = [None] * 7
                if out:
                    yield batch_of([(x["key"], *[None] * 4, q, lo + at, hi + at, *none) for q, lo, hi in out])

    dealt = made.where("codes is not null").repartition("key", "d", "first").mapInArrow(solved, schema)
    fragments = made.where("q is not null").union(dealt).select("key", "q", "lo", "hi")
    by = Window.partitionBy("key", "q").orderBy("lo", "hi")
    reached = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reached, 0).otherwise(1)
    joined = fragments.withColumn("new", new).withColumn("nr", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("key", "q", "nr").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") + F.col("q") - F.col("start")
    whole = whole.withColumn("length", length).where(length >= F.greatest(F.lit(min_words), F.col("q") * min_repeats))
    one = F.struct("start", F.col("q").alias("period"), "length")
    runs = whole.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    runs = runs.select("key", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(f"array<{RUN}>").alias("runs"))
    out = made.where("sha is not null").select("key", "id", "n", "sha", "text").join(runs, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"),
        F.col("sha").alias("words_sha256"), F.when(F.col("runs").isNotNull(), F.col("text")).alias("text"),
    )


def collapsed(text: str, runs: list) -> bytes:
    """The words joined by one space, without those that any run repeats after its first period."""
    words = words_of(text)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, x in zip(words, np.cumsum(drop).tolist()) if not x)


def collapse(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_words, runs, collapsed, collapsed_sha256)``; ``collapsed`` is null where nothing goes."""
    kind = found.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, runs array<{RUN}>, collapsed string, collapsed_sha256 string"

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, shas = [], []
            for runs, sha, text in zip(*(batch.column(c).to_pylist() for c in ("runs", "words_sha256", "text"))):
                if runs:
                    kept = collapsed(text, [(r["start"], r["length"], r["period"]) for r in runs])
                    text, sha = kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()
                texts.append(text)
                shas.append(sha)
            columns = [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed", "collapsed_sha256"])

    return found.select(id_col, "n_words", "runs", "words_sha256", "text").mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for one id in ten by CRC-32, the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        place = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (place(i) + 1).cast("int"))), " ")

    has = (h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    # the words are bound once, by a transform over the one array of them
    return F.when(has, F.element_at(F.transform(F.array(words), rewritten), 1)).otherwise(text)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the planted texts: their number, the strongest one, and the hashes of all runs and of what is left."""
    own = docs.select(F.col(id_col), planted(F.col(id_col), F.col(text_col)).alias(text_col))
    found = collapse(find(own, id_col, text_col), id_col)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))

    def better(a: Column, b: Column) -> Column:  # exact: products of whole numbers
        x, y = a["length"].cast("decimal(19,0)") * b["period"], b["length"].cast("decimal(19,0)") * a["period"]
        earlier = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when((y > x) | ((y == x) & earlier), b).otherwise(a)

    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.element_at("runs", 1), better))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )

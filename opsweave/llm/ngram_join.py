"""Similarity join on word n-grams: Jaccard >= ``percent`` / 100, by token-combination prefixes.

A document is the set of its distinct shingles of ``size`` words (tokens here). The query takes three words
and 90 %; ``percent`` has to be above 50. Equal sets become one node. Two nodes x, y can only be linked if x
lacks at most ``edits = |x| - ceil(percent / 100 * |x|)`` of its tokens in y. So among any ``edits + 1`` of its
tokens, one is shared, and of the tokens in a common order the first ones must meet. The index holds these prefixes:

* *Bands.* Linked sets have sizes within a factor of ``percent`` / 100. Sets are indexed in the band of their size
  (powers of two), and also in the band below if they reach into it. Within a band only tokens whose
  hash is below the band's share are used; the argument holds in any sub-universe of tokens that leaves
  every set enough of them, and shares are as large as the set asks that needs most.
* *Order.* Tokens are ordered by their frequency in the band, rarest first, over all documents. Tokens
  of one set alone count for the prefix but need no index.
* *Combinations.* Tokens held by more than ``FREQUENT`` sets are indexed in pairs. They fall into c classes by
  their hash, as many as a band's ``classes``, and only pairs within a class are indexed: m of them in a
  prefix count as m - c, since of c + 1 shared ones two are in one class. A prefix is extended until it counts
  ``edits + 1``. As c grows with the edits, a class holds about four tokens and the entries of a set grow in proportion to its
  edits, whatever its size.

Sets that share an index entry are candidates. Their clusters are cut into blocks of bounded size, and
every pair of blocks of a cluster is verified exactly with incidence matrices; only a spanning forest of
the links found leaves the task. Blocks are bounded in tokens and in sets, as the matrices have a row per set.
The components of the links are the result; no two documents are ever written out as a pair of copies.

Very small sets (at 90 %, up to 8 tokens: 9 of 10 is the smallest unequal pair) can only be linked to equal
ones. A null,
empty or wordless text has an empty set and is linked with nothing; an empty table gives no rows. A very long
text is a set of any size and takes the same path. Columns other than id and text are not read, so any may clash. Repeated rows and equal texts are
one node and are all reported; rows of one id with different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import fresh, map_columns, map_rows, mix64, words_of, written
from opsweave.llm.components import components
from opsweave.session import cut_lineage, freed_shuffles, shared_code, shared_folder

SHINGLE = 3
PERCENT = 90  # linked: 100 * intersection >= percent * union
FREQUENT = 64
BLOCK_TOKENS = 300_000  # tokens of one block of a cluster, on average
BLOCK_SETS = 3000  # sets of one block, on average: two blocks take a float matrix of their counts squared
STRIP = 1024
BATCH_TOKENS = 2_000_000
SLICES = 4  # of the token universe: only one slice of all tokens is shuffled at a time
FILTER_BITS = 1 << 23


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle as a whole."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]  # np.unique takes several times as long


def edits(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n may lack in a linked one: n - ceil(percent / 100 * n)."""
    return n - -(-percent * n // 100)


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The band of a set of n tokens, and the one below if linked sets may lie there."""
    if 100 * n // percent == n:  # no larger set can be linked, and none that lacks a token
        return []
    own = n.bit_length() - 1
    return [own, own - 1] if -(-percent * n // 100) < 1 << own else [own]


def classes(band: int, percent: int = PERCENT) -> int:
    """Classes of frequent tokens in a band, the same for all its sets: a third of the edits."""
    return max(1, edits(3 << max(0, band - 1), percent) // 3)


def first_share(band: int, percent: int = PERCENT) -> float:
    return min(1.0, 1.6 * (100 - percent) / 100 + 12 / 2**band)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _kept_below(share: float) -> int:
    """The hash below which a token belongs to a band's share."""
    return int(share * (1 << 64))


def _set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col)), kind


def _rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``(id, t, n, v, short)``: per row the hash of its text, its set's size and hash, and the bands whose first
    share leaves it too few tokens, with half the hash of the last token it needs there."""

    def one(row) -> Iterator[tuple]:
        tokens = shingles(row[1], size)
        n = len(tokens)
        if not n:
            yield row[0], row[2], 0, None, []
            return
        short = []
        for b in bands(n, percent):
            last = int(tokens[min(n, edits(n, percent) + classes(b, percent) + 1) - 1])
            if last >= _kept_below(first_share(b, percent)):
                short.append((b, last >> 1))
        yield row[0], row[2], n, _set_hash(tokens), short

    texts, kind = _texts(docs, id_col, text_col)
    return map_rows(texts, one, f"id {kind}, t bigint, n bigint, v bigint, short array<struct<band:int,half:bigint>>")


def _parts(docs: DataFrame, id_col: str, text_col: str, below: dict[int, int], size: int, percent: int) -> DataFrame:
    """``(v, n, band, m, keys)``: per row and band of its set the tokens used, those whose hash is below the band's.

    Arrow columns are made of whole batches; no token becomes a Python object."""

    def run(columns: list[pa.Array]) -> Iterator[list]:
        found, keys = [], []
        for text in columns[1].to_pylist():
            tokens = shingles(text, size)
            if own := bands(len(tokens), percent) if len(tokens) else []:
                v = _set_hash(tokens)
            for b in own:
                end = below.get(b) or _kept_below(first_share(b, percent))
                used = tokens if end >= 1 << 64 else tokens[: np.searchsorted(tokens, np.uint64(end))]
                keys.append(mix64(used ^ np.uint64(b * 0x9E3779B97F4A7C15 % (1 << 64))))
                found.append((v, len(tokens), b, len(used)))
        if found:
            v, n, band, m = zip(*found)
            ends = np.r_[0, np.cumsum(m)].astype(np.int32)
            yield [v, n, band, m, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))]

    return map_columns(_texts(docs, id_col, text_col)[0], run, "v bigint, n bigint, band int, m bigint, keys array<bigint>")


def pairs_within_classes(keys: list[int], c: int) -> list[int]:
    """Hashes of the pairs of keys that fall into the same of c classes."""
    a = np.sort(np.array(keys, dtype=np.int64)).view(np.uint64)
    own = mix64(a ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(c)
    order = np.argsort(own, kind="stable")
    a, own = a[order], own[order]
    out: list[int] = []
    for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)]), [*cuts[1:], len(own)]):
        i, j = np.triu_indices(hi - lo, 1)
        part = a[lo:hi]
        out += mix64(mix64(part[i]) * np.uint64(3) + part[j]).view(np.int64).tolist()
    return out


def _shared_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """The tokens ``(key, v, band, df)`` that several sets hold, as a table in ``folder``.

    Slice by slice of the keys, so that the shuffle files of all tokens never lie on disk together.
    """
    for part in range(SLICES):
        keys = F.filter("keys", lambda k: F.pmod(k, F.lit(SLICES)) == part)
        tokens = parts.select("v", "band", F.explode(keys).alias("key"))
        shared = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        # a third of all sets may share a key, which adaptive joins split
        tokens.join(shared, "key").write.mode("append").parquet(folder)
    return parts.sparkSession.read.parquet(folder)


def _signatures(parts: DataFrame, percent: int, folder: str) -> DataFrame:
    """Index entries ``(entry, v)`` of ``parts`` ``(v, n, band, m, keys)``; ``folder`` holds what is made on the way."""
    held = _shared_tokens(parts.select("v", "band", "keys"), folder)
    held = held.groupBy("v", "band").agg(F.collect_list(F.struct("df", "key")).alias("held"))
    held = held.join(parts.select("v", "band", "n", "m"), ["v", "band"])
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    held = held.withColumn("need", need.cast("long")).where(F.col("m") - F.size("held") < F.col("need"))

    def one(row) -> Iterator[tuple]:
        v, band, m, lacking, own = row
        c, covered, last = classes(band, percent), m - len(own), []
        for df, key in sorted((r["df"], r["key"]) for r in own):
            if covered >= lacking:
                break
            if df > FREQUENT:
                last.append(key)
                covered += len(last) > c
            else:
                yield key, v
                covered += 1
        for key in pairs_within_classes(last, c):
            yield key, v

    return map_rows(held.select("v", "band", "m", "need", "held"), one, "entry bigint, v bigint")


def linked(
    sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT
) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sorted token arrays (between the two sides if given)."""
    c = len(sets)
    n = np.array([len(s) for s in sets])
    if c == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (n.sum() - both):
            yield 0, 1
        return
    row = np.repeat(np.arange(c), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[token] > 1
    column = np.cumsum(count > 1) - 1
    row, token = row[several], column[token[several]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    common = np.zeros((c, c), dtype=np.float32)
    width = 4096
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (lo, lo + width))
        part = np.zeros((c, width), dtype=np.float32)
        part[row[a:b], token[a:b] - lo] = 1
        for at in range(0, c, STRIP):  # a product of the whole would be a second matrix
            common[at : at + STRIP] += part[at : at + STRIP] @ part.T
    left = np.ones(c, dtype=bool)
    for start in range(c):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            i = todo.pop()
            both = common[i].astype(np.int64)
            near = left & (100 * both >= percent * (n[i] + n - both))
            if side is not None:
                near &= side != side[i]
            new = np.flatnonzero(near)
            left[new] = False
            for j in new.tolist():
                yield i, j
                todo.append(j)


def id_filter(rows: DataFrame, id_col: str) -> bytes:
    """A bitmap of ``FILTER_BITS`` places with the places of all ids set: 1 MB, however many ids.

    A row whose place is not set has none of the ids. With very many ids most places are set, and
    rows are sorted out by the join alone.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS)) + 1  # bitmaps count from 1
    bit, bucket = F.bitmap_bit_position(place), F.bitmap_bucket_number(place)
    parts = rows.groupBy(bucket.alias("k")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    out, size = bytearray(FILTER_BITS // 8), 4096
    for r in parts:
        out[(r["k"] - 1) * size : r["k"] * size] = r["bits"]
    return bytes(out)


def _links(
    docs: DataFrame, id_col: str, text_col: str, clusters: DataFrame, reps: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links ``(a, b)`` within clusters ``(node, component)``; reps: ``(v, id, n)``."""
    own = cut_lineage(clusters.join(reps, clusters["node"] == reps["v"]).select("component", "v", "id", "n"))
    sizes = own.groupBy("component").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    blocks = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("sets") / BLOCK_SETS)).cast("int")
    sizes = sizes.select("component", "tokens", blocks.alias("blocks"))
    own = own.join(sizes, "component")
    batches = max(1, -(-(sizes.where("blocks = 1").agg(F.sum("tokens")).collect()[0][0] or 0) // BATCH_TOKENS))
    block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    own = cut_lineage(own.select(F.col("id").alias("_id"), "v", "component", "blocks", block.alias("block")))
    wanted = id_filter(own, "_id")

    def sets(row) -> Iterator[tuple]:
        if wanted[row[2] >> 3] >> (row[2] & 7) & 1:
            tokens = shingles(row[1], size)
            if len(tokens):
                yield row[0], _set_hash(tokens), tokens.tobytes()

    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))
    texts = docs.select(F.col(id_col).alias("_t"), F.col(text_col).cast("string").alias("text"), place.alias("place"))
    kind = texts.schema["_t"].dataType.simpleString()
    made = map_rows(texts, sets, f"_t {kind}, _v bigint, tokens binary")
    made = made.join(own, made["_t"].eqNullSafe(own["_id"]) & (made["_v"] == own["v"]))
    made = made.select("v", "component", "blocks", "block", "tokens").dropDuplicates(["v", "block"])
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    made = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one-block clusters share groups; each pair of blocks of a larger one is a group of its own
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(batches))).otherwise(
        F.xxhash64("component", lo, hi)
    )
    made = made.select("v", "component", "block", lo.alias("lo"), hi.alias("hi"), "tokens", group.alias("g"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), own in pdf.groupby(["component", "lo", "hi"], sort=False):
            v = own["v"].to_numpy()
            if len(v) > 1:
                side = own["block"].to_numpy() if lo != hi else None
                found = linked([np.frombuffer(t, dtype=np.uint64) for t in own["tokens"]], side, percent)
                out += [(int(v[i]), int(v[j])) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return made.groupBy("g").applyInPandas(verify, "a bigint, b bigint")


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(id, t, n, v)``, and the component ``(v, id, c)`` of each set with its least id."""
    with freed_shuffles(docs.sparkSession), shared_code(docs.sparkSession):
        return _found_components(docs, id_col, text_col, size, percent)


def _found_components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(_rows(docs, id_col, text_col, size, percent))
    few = rows.select(F.explode("short").alias("s")).groupBy("s.band").agg(F.max("s.half").alias("half")).collect()  # bands
    below = {r["band"]: (r["half"] + 1) << 1 for r in few}  # as far as the set that needs it most
    rows = rows.drop("short")
    reps = cut_lineage(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    # rows of one set hold the same
    parts = _parts(docs, id_col, text_col, below, size, percent).dropDuplicates(["v", "band"])
    with written(parts) as parts, shared_folder(docs.sparkSession, "tokens") as folder:
        entries = cut_lineage(_signatures(parts, percent, folder).distinct())  # tokens are shuffled from here, each set's once
    pivots = entries.groupBy("entry").agg(F.min("v").alias("a"), F.count("*").alias("c")).where("c > 1")
    pairs = entries.join(pivots, "entry").where("v != a").select("a", F.col("v").alias("b")).distinct()
    clusters = cut_lineage(components(cut_lineage(pairs)))
    links = cut_lineage(_links(docs, id_col, text_col, clusters, reps, size, percent))
    found = components(links).withColumnRenamed("node", "v")
    named = reps.join(found, "v", "left").select("v", "id", F.coalesce("component", "v").alias("c"))
    return rows, cut_lineage(named)


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row ``(id_col, n_shingles, component_id)`` per row: the smallest id reachable by links."""
    rows, named = _components(docs, id_col, text_col, size, percent)
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    named = named.join(least, "c").select("v", "component_id")
    out = rows.select("id", "n", "v").join(named, "v", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, the one with the smallest id; all columns stay.

    Rows of one id, or without an id, are documents of their own if their texts differ: each is judged by
    its own text. Rows without an id come last in their component; among rows of one id, the least hash
    of the text decides, and of rows with equal id and text any one stays. Wordless texts all stay.
    """
    rows, named = _components(docs, id_col, text_col, size, percent)
    least = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("t"))).alias("least")
    own = rows.where("v is not null").groupBy("v").agg(least)  # one row per set, so that no join is on hot keys
    own = own.join(named.select("v", "c"), "v").groupBy("c").agg(F.min("least").alias("least")).select("least.*")
    z, i, t = (fresh(docs, c) for c in ("_z", "_i", "_t"))  # none is null, so that one exchange serves all
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kept = own.select(F.col("z").alias(z), name("id").alias(i), F.col("t").alias(t))
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    all_rows = docs.withColumns({z: F.col(id_col).isNull(), i: name(id_col), t: _text_hash(text_col)})
    one = all_rows.where(worded).dropDuplicates([z, i, t]).join(kept, [z, i, t], "left_semi")
    return one.select(*docs.columns).union(docs.where(~worded))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as t from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 90 * (x.n + y.n - c)),
u as (select a, b from l union all select b, a from l),
cc(id, component) using key (id) as (select doc_id, doc_id from documents
  union (select u.b as id, min(cc.component) as component from cc join u on u.a = cc.id
         join recurring.cc as old on old.id = u.b group by u.b having min(cc.component) < min(old.component)))
select doc_id, coalesce(n, 0) as n_shingles, component as component_id from documents join cc on id = doc_id left join n using (doc_id)
"""

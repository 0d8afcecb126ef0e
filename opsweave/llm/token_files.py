"""Token ids in files of fixed-width bit-packed blocks.

``write`` range-sorts the documents by id, encodes every whole text with a public tokenizer, appends the end id,
and stores each id in the least number of bits that holds every id of the vocabulary. A file is

====================  ==========================================================================
``b"IDBITS01"``       magic
header                ``<IIQQQQ``: bits an id, ids a block, range, number within the range, ids, bytes of the index
block offsets         ``blocks + 1`` unsigned 64-bit integers: bytes from the first block
index                 Arrow stream of ``(id, start, n)`` a document: first id in this file and number of ids
blocks                ids of ``bits`` bits, lowest bit first; each block is padded to whole bytes
``b"\\n"``             added by Spark's writer
====================  ==========================================================================

(integers are little-endian). A document never spans two files: a file ends with the document that brings it to
``FILE_IDS`` ids. Spark's own committer writes the files, one record each, so they go to any store that Spark
writes to and a lost executor leaves no half file. ``PackedIds`` reads ids of any place of a file: it touches the blocks
in question only and unpacks them with numpy. ``read_back`` gives every document's place in the whole sequence; files
are numbered by range and number within it, and only their totals are added up.

A null or empty text is the end id alone. Rows without an id come first; rows of one id are ordered by the hash
of their text, and rows with equal id and text are interchangeable, so a key that many rows share is cut over ranges.
Only id and text are read; other columns may have any name. An empty table gives no rows.
A very long text is one row of Spark, as in its table, and is encoded and stored whole.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsweave.llm.common import ROWS_PER_BATCH
from opsweave.session import cut_lineage, ensure_checkpoint_dir

MAGIC = b"IDBITS01"
HEADER = "<IIQQQQ"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
END_ID = 0
CACHED = 400_000  # pieces of text kept in a worker
#: Unicode white space, which the tokenizers' patterns mean by \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
MARK = "\x01"
BATCH_BYTES = 4 << 20


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary of this size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits one after another, lowest bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of a block: gathers the bytes of each id, shifts and masks."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", offset=first * bits // 8, count=count).astype(np.uint32)
    lo, hi = first * bits // 8, -(-(first + count) * bits // 8)
    raw = np.zeros(hi - lo + 8, dtype=np.uint8)
    raw[: hi - lo] = np.frombuffer(data, dtype=np.uint8, offset=lo, count=hi - lo)
    at = np.arange(first, first + count, dtype=np.int64) * bits - 8 * lo
    word, byte = np.zeros(count, dtype=np.uint64), at >> 3
    for k in range(-(-(bits + 7) // 8)):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_bytes(part: int, number: int, index: pa.RecordBatch, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_batch(index)
    table = sink.getvalue().to_pybytes()
    head = struct.pack(HEADER, bits, block, part, number, len(ids), len(table))
    return b"".join([MAGIC, head, offsets.tobytes(), table, *blocks])


class PackedIds:
    """Random access to the ids of one file's bytes."""

    def __init__(self, data: bytes):
        self._data = memoryview(data)
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("no file of packed ids")
        at = len(MAGIC) + struct.calcsize(HEADER)
        self.bits, self.block, self.part, self.number, self.n, index = struct.unpack(HEADER, self._data[len(MAGIC) : at])
        blocks = -(-self.n // self.block)
        self._offsets = np.frombuffer(data, dtype="<u8", offset=at, count=blocks + 1).astype(np.int64)
        at += 8 * (blocks + 1)
        self._index, self._first = self._data[at : at + index], at + index

    def documents(self) -> pa.Table:
        """``(id, start, n)`` of the documents, in order."""
        return pa.ipc.open_stream(pa.py_buffer(self._index)).read_all()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the places ``start`` to ``stop``; reads the blocks that hold them only."""
        out = [np.zeros(0, dtype=np.uint32)]
        for b in range(start // self.block, -(-stop // self.block) if stop > start else 0):
            lo, hi = max(start, b * self.block), min(stop, (b + 1) * self.block)
            data = self._data[self._first + self._offsets[b] : self._first + self._offsets[b + 1]]
            out.append(unpack(data, self.bits, lo - b * self.block, hi - lo))
        return np.concatenate(out)


class Encoder:
    """Ids of whole texts, by a file of the tokenizers library.

    A byte-level tokenizer without normalizer cuts a text by a pattern of which no match runs on from
    another character into white space. So a text may be cut before white space that follows another
    character, and its ids are those of the pieces. A batch is cut by Arrow, its distinct pieces are looked up
    in a cache of bounded size, and ids are put together by numpy. New pieces are encoded together, and
    their ids told apart by the bytes that each id stands for. Any other tokenizer encodes each text as it is.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.vocabulary = max(self._library.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = [a for a in parts.get("added_tokens", ()) if a["lstrip"] or a["rstrip"] or set(a["content"]) & set(SPACES)]
        self._in_pieces = level and not parts.get("normalizer") and not added
        self._bytes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self._library.get_vocab(with_added_tokens=False).items():
            self._bytes[i] = len(token)  # a character of the byte-level alphabet is a byte
        for i, token in self._library.get_added_tokens_decoder().items():
            self._bytes[i] = len(token.content.encode())
        self._piece = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self._slots: dict[str, int] = {}
        self._start = self._count = self._used = np.zeros(0, dtype=np.int64)
        self._pool = np.zeros(0, dtype=np.uint32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that begin with white space can stand one after another if the one before ends otherwise."""
        alone = [p for p in pieces if p[:1] not in (" ", "\n") or p[-1] in SPACES]
        joined = [p for p in pieces if p[:1] in (" ", "\n") and p[-1] not in SPACES]
        groups = [joined[at : at + 200] for at in range(0, len(joined), 200)]
        ids, counts = self._plain(alone), []
        counts += [len(x) for x in ids]
        for some, found in zip(groups, self._plain(["".join(g) for g in groups])):
            ends = np.cumsum([len(p.encode("utf-8")) for p in some])
            cuts = np.searchsorted(np.cumsum(self._bytes[found]), ends) + 1
            ids.append(found)
            counts += np.diff(cuts, prepend=0).tolist()
        counts = np.array(counts, dtype=np.int64)
        self._slots.update(zip(alone + joined, range(len(self._count), len(self._count) + len(counts))))
        self._start = np.r_[self._start, len(self._pool) + np.cumsum(counts) - counts]
        self._count = np.r_[self._count, counts]
        self._used = np.r_[self._used, np.zeros(len(counts), dtype=np.int64)]
        self._pool = np.concatenate([self._pool, *ids])

    def _forget(self) -> None:
        """Keep the pieces seen often, at most half of what may be kept."""
        order = np.argsort(-self._used, kind="stable")[: CACHED // 2]
        order = np.sort(order[self._used[order] > 2])
        names = list(self._slots)  # in the order of the slots
        self._pool = self._pool[self._places(order)]
        self._slots = {names[k]: new for new, k in enumerate(order.tolist())}
        self._count, self._used = self._count[order], self._used[order]
        self._start = np.cumsum(self._count) - self._count

    def _places(self, slots: np.ndarray) -> np.ndarray:
        """Where the ids of these pieces stand in the pool, one after another."""
        counts = self._count[slots]
        total = np.cumsum(counts)
        return np.repeat(self._start[slots] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)

    def _gather(self, distinct: list[str], which: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts and their counts: text t is the pieces ``which[cuts[t]:cuts[t + 1]]`` of ``distinct``."""
        if len(self._slots) > CACHED:
            self._forget()
        self._learn([p for p in distinct if p not in self._slots])
        slots = np.fromiter(map(self._slots.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self._used[slots] += np.bincount(which, minlength=len(distinct))
        slots = slots[which]
        ends = np.r_[0, np.cumsum(self._count[slots])]
        return self._pool[self._places(slots)], ends[cuts[1:]] - ends[cuts[:-1]]

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without a null and without white space side by side; a mark stands before each."""
        mark, nothing = pa.scalar(MARK, texts.type), pa.scalar("", texts.type)
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n"), nothing)
        lists = pc.split_pattern(marked, " ")
        found = lists.flatten().dictionary_encode()
        names = [p[1:] if p[:1] == MARK else p if p[:1] == "\n" else " " + p for p in found.dictionary.to_pylist()]
        distinct = dict.fromkeys(names)
        if len(distinct) == len(names):
            which = found.indices.to_numpy()
        else:  # a text's first piece may equal another one
            number = {p: k for k, p in enumerate(distinct)}
            which = np.array([number[p] for p in names], dtype=np.int64)[found.indices.to_numpy()]
        cuts = lists.offsets.to_numpy()
        return self._gather(list(distinct), which, cuts - cuts[0])

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self._in_pieces:
            found = self._plain(texts)
            return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)
        pieces = [self._piece.findall(t) for t in texts]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for p in pieces for w in p], dtype=np.int64)
        return self._gather(list(number), which, np.cumsum([0] + [len(p) for p in pieces]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of ids of each; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        odd = pc.match_substring_regex(texts, f"[{SPACES}][{SPACES}]|{MARK}").to_numpy(zero_copy_only=False)
        if not self._in_pieces:
            odd[:] = True
        if not odd.any():
            return self._regular(texts)
        others, counts = self._others(texts.filter(pa.array(odd)).to_pylist())
        if odd.all():
            return others, counts
        ids, n = self._regular(texts.filter(pa.array(~odd)))
        both = np.zeros(len(texts), dtype=np.int64)
        both[odd], both[~odd] = counts, n
        out = np.zeros(int(both.sum()), dtype=np.uint32)
        of_odd = np.repeat(odd, both)
        out[of_odd], out[~of_odd] = others, ids
        return out, both


def encoder(path: str) -> Encoder:
    """One of each file in a Python worker: this package's own globals travel with every task, so the
    encoders are kept in a module of their own, where the next task of the worker finds them."""
    kept = sys.modules.setdefault("_opsweave_encoders", types.ModuleType("_opsweave_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _by_bytes(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some bytes, and cut where they hold more; a row is never cut."""
    held, size = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS,
) -> None:
    """Write the files of all documents to the new folder ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits = bits_for(max(tool.vocabulary, end_id + 1))
        own, ids, counts, n = [], [], [], 0

        def done() -> pa.RecordBatch:
            sizes = np.concatenate(counts)
            index = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(own), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)], names=["id", "start", "n"]
            )
            data = file_bytes(part, number, index, np.concatenate(ids), bits, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in _by_bytes(batches):
            found, sizes = tool.encode(batch.column(1))
            found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):  # up to the document that fills the file
                before = ends[at - 1] if at else 0
                stop = min(len(sizes), int(np.searchsorted(ends, before + file_ids - n)) + 1)
                own.append(batch.column(0).slice(at, stop - at))
                ids.append(found[before : ends[stop - 1]])
                counts.append(sizes[at:stop])
                n, at = n + int(ends[stop - 1] - before), stop
                if n >= file_ids:
                    yield done()
                    own, ids, counts, n, number = [], [], [], 0, number + 1
        if own:
            yield done()

    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("content")


def read_back(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row ``(id, start, n_tokens, ids_crc32)`` per document, from the files: ``start`` counts all ids before it,
    ``ids_crc32`` is taken over its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = PackedIds(data.as_py())
                index = file.documents()
                crcs = []
                for start, n in zip(index.column("start").to_pylist(), index.column("n").to_pylist()):
                    crcs.append(zlib.crc32(file.ids(start, start + n).astype("<u4").tobytes()))
                table = index.append_column("crc", pa.array(crcs, pa.int64()))
                for name in ("number", "part"):
                    table = table.add_column(0, name, pa.array(np.full(len(crcs), getattr(file, name), dtype=np.int64)))
                yield from table.combine_chunks().to_batches(50_000)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # one file in a batch
    rows = cut_lineage(_files(spark, folder).mapInArrow(run, f"part bigint, number bigint, id {id_type}, start bigint, n bigint, crc bigint"))
    totals = rows.groupBy("part", "number").agg(F.sum("n").alias("ids"))
    ranges = totals.groupBy("part").agg(F.sum("ids").alias("ids"))

    def before(window) -> F.Column:
        return F.coalesce(F.sum("ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    # one row a range, then one a file
    ranges = ranges.select("part", before(Window.orderBy("part")).alias("of_range"))
    totals = totals.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("of_file"))
    place = totals.join(ranges, "part").select("part", "number", (F.col("of_range") + F.col("of_file")).alias("first"))
    return rows.join(place, ["part", "number"]).select(
        "id", (F.col("first") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def read_ids(spark: SparkSession, folder: str, wanted: list, id_type: str = "bigint") -> DataFrame:
    """``(id, ids)`` of the documents of these ids: each file's index is read, then the blocks of those documents."""
    some = pa.array(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                file = PackedIds(data.as_py())
                index = file.documents()
                index = index.filter(pa.compute.is_in(index.column("id"), value_set=some.cast(index.schema.field("id").type)))
                ids = [file.ids(s, s + n) for s, n in zip(index.column("start").to_pylist(), index.column("n").to_pylist())]
                cols = [index.column("id").combine_chunks(), pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return _files(spark, folder).mapInArrow(run, f"id {id_type}, ids array<bigint>")


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/token-ids-{uuid.uuid4().hex}"


def digest(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Writes all documents and reads the files: ``(id_col, start, n_tokens, ids_crc32)``."""
    spark, folder = docs.sparkSession, folder or shared_folder(docs.sparkSession)
    write(docs, folder, tokenizer, id_col, text_col)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return read_back(spark, folder, kind).withColumnRenamed("id", id_col)

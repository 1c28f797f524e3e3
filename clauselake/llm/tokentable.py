"""Token identifiers of documents as Parquet list columns that can be read by document and by column.

Files hold documents in ascending id: ``doc_id``, ``start`` and ``n_tokens`` in delta encoding, ``ids`` as a
list column in dictionary encoding. Row groups and pages are kept small enough, and Parquet's page indexes say
which pages a range of ids needs; metadata is read without the list column.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.common import durable, keep_small, remove, shared_folder, whole_text

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Row groups of 32 MB, pages of at most 256 documents or 256 KB.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 256
#: Pieces of text that a Python worker remembers, how many of them one text for the library holds, and the bytes of
#: text that are cut up and looked up at once.
MOST, GROUP, GULP_BYTES = 800_000, 500, 4 << 20
#: What a row counts beside its text, so that many empty texts do not gather without end.
ROW_BYTES = 64

# A piece that is one run without white space, or one space and such a run.
_ONE = re.compile(r" ?\S+")

# Kinds of bytes. Every byte that may belong to a character of unknown kind is OTHER, and no text is cut beside it.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, WHITE = range(7)
SOLID = (LETTER, DIGIT, MARK, APOSTROPHE)


def _kinds() -> bytes:
    out = bytearray(256)
    for i in range(0x21, 0x7F):
        c = chr(i)
        out[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else MARK
    out[0x09:0x0E] = bytes([WHITE]) * 5
    out[0x20] = SPACE
    return bytes(out)


#: What a byte and the next one (8 * kind + kind) say: a border lies between them; a space stands before a solid
#: character; other white space stands before one; other white space stands behind one.
BORDER, SPACED, LED, ENDED = 1, 2, 4, 8


def _pairs() -> bytes:
    out = bytearray(256)
    for p in range(7):
        for k in range(7):
            same = MARK if k == APOSTROPHE else k
            # Letters, digits and marks are word pieces of their own; the letters behind an apostrophe may belong to it.
            border = p in SOLID and (k in (SPACE, WHITE) or k in SOLID and p not in (same, APOSTROPHE))
            out[8 * p + k] = (BORDER * border | SPACED * (p == SPACE and k in SOLID) | LED * (p == WHITE and k in SOLID)
                              | ENDED * (p in SOLID and k == WHITE))
    return bytes(out)


KINDS, PAIRS = _kinds(), _pairs()


def cut(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places in the UTF-8 bytes ``data`` of several texts where pieces begin that the library encodes as in the whole text.

    ``edges`` are the places of the texts, from 0 to the size of ``data``. No word piece reaches over a border between
    ASCII (or Latin-1) letters, digits, marks and white space, but for a space before a word and letters behind an
    apostrophe. The last of several white characters before a word stands alone, or with the word if it is a space.
    """
    n = len(data)
    begins = np.zeros(n, bool)
    if n > 1:
        kind = np.frombuffer(bytearray(data.tobytes().translate(KINDS)), np.uint8)
        latin = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
        latin = latin[(data[latin + 1] | 0x20) != 0xB7]
        kind[latin] = kind[latin + 1] = LETTER
        pair = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(PAIRS), np.uint8)
        spaced = (pair & SPACED).astype(bool)
        last = edges[1:-1][edges[1:-1] > 0] - 1  # the next byte is of another text
        spaced[last[last < n - 1]] = False
        begins[1:] = pair & BORDER
        begins[:-1] |= spaced
        begins[2:] |= (pair[1:] & LED).astype(bool) & (pair[:-1] & ENDED).astype(bool)
    begins[edges[:-1][edges[:-1] < n]] = True
    return np.flatnonzero(begins)


class Ragged:
    """Lists of whole numbers that only grow, gathered by place."""

    def __init__(self):
        self.flat, self.start, self.size = array("i"), array("q"), array("q")

    def __len__(self) -> int:
        return len(self.size)

    def extend(self, flat: np.ndarray, size: np.ndarray) -> None:
        """Add lists that lie one behind the other in ``flat``."""
        ends = len(self.flat) + np.cumsum(size)
        self.start.frombytes((ends - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.int32).tobytes())

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at ``at`` one behind the other, and their sizes."""
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        start, size = np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.size, np.int64)[at]
        ends = np.cumsum(size)
        place = np.repeat(start - (ends - size), size)
        place += np.arange(len(place))
        return np.frombuffer(self.flat, np.int32)[place] if len(place) else np.zeros(0, np.int32), size


class Numbers(dict):
    """A number per key, in order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Identifiers of whole texts by the tokenizers library; equal pieces are encoded once while they are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = self.library.pre_tokenizer
        #: The rules of ``cut`` are those of byte-level vocabularies; by any other, texts are encoded whole.
        self.cuts = (isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space
                     and self.library.normalizer is None and self.library.truncation is None and self.library.padding is None
                     and all(t.special for t in self.library.get_added_tokens_decoder().values()) and len(self.plain(["\n"])[0]) == 1)
        self.forget()

    def forget(self) -> None:
        self.pieces, self.of_piece = Numbers(), Ragged()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @functools.cached_property
    def newline(self) -> int:
        return self.plain(["\n"])[0][0]

    def _learn(self) -> None:
        new = [p.decode() for p in itertools.islice(self.pieces, len(self.of_piece), None)]
        # A newline parts two pieces and is a token of its own, so that one text for the library holds many pieces.
        # Pieces with white space inside or at the end go alone.
        one = np.fromiter(map(bool, map(_ONE.fullmatch, new)), bool, len(new))
        words, rest = list(itertools.compress(new, one)), list(itertools.compress(new, ~one))
        groups = (self.plain(["\n".join([*words[i:i + GROUP], ""])])[0] for i in range(0, len(words), GROUP))  # one is held at a time
        flat = np.fromiter(chain.from_iterable(groups), np.int32)
        border = np.flatnonzero(flat == self.newline)
        if len(border) == len(words):
            size, flat = np.diff(border, prepend=-1) - 1, np.delete(flat, border)
        else:
            one[:] = False
            rest, flat, size = new, flat[:0], border[:0]
        others = self.plain(rest)
        mixed = Ragged()
        mixed.extend(flat, size)
        mixed.extend(np.array(list(chain.from_iterable(others)), np.int32), np.array(list(map(len, others)), np.int64))
        self.of_piece.extend(*mixed.take(np.where(one, np.cumsum(one) - 1, len(size) + np.cumsum(~one) - 1)))

    def encode(self, texts: pa.Array | list[str], end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers of the texts, each text ended by ``end``, and the size of each."""
        if len(self.pieces) > MOST:
            self.forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.cuts:
            whole = [[*ids, end] for ids in self.plain(texts.to_pylist())]
            return np.fromiter(chain.from_iterable(whole), np.int32), np.fromiter(map(len, whole), np.int64)
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]]
        edges = places - places[0]
        starts = cut(data, edges)
        bounds = np.append(starts, len(data))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]) \
            .dictionary_encode()
        _, at, held = found.dictionary.buffers()
        at, held = np.frombuffer(at, np.int64)[:len(found.dictionary) + 1].tolist(), (held or pa.py_buffer(b"")).to_pybytes()
        numbers = np.fromiter(map(self.pieces.__getitem__, map(held.__getitem__, map(slice, at, at[1:]))), np.int64, len(found.dictionary))
        self._learn()
        ids, size = self.of_piece.take(numbers)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pa.array(ids)).take(found.indices)
        ends = lists.offsets.to_numpy()[np.searchsorted(starts, edges)]
        ids, size = np.insert(lists.values.to_numpy(), ends[1:], end), np.diff(ends) + 1
        del found, lists
        pa.default_memory_pool().release_unused()  # kept for the next texts it would add to what is remembered
        return ids, size


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that later tasks go on with what it remembers."""
    return Encoder(path)


def gulps(batches: Iterable[pa.RecordBatch], size: int = GULP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text (column 1): small ones together, large ones in parts.

    The larger the batch, the more of its pieces are equal and looked up once; the size bounds the memory it takes.
    """
    held, full = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) + ROW_BYTES, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size - full, "right")))
            held.append(batch.slice(at, to - at))
            full += int(ends[to - 1]) - before
            at = to
            if full >= size or at < len(ends):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, full = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _path(vocabulary: str) -> str:
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def write_token_table(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, group_bytes: int = GROUP_BYTES,
                      page_rows: int = PAGE_ROWS) -> None:
    """Write ``docs (doc_id, text)`` as ``(doc_id, start, n_tokens, ids)`` in ascending id, null ids first.

    ``start`` counts the identifiers that the same task has written before; ``token_table`` adds those of
    the tasks before. The text is ranged by id before it is encoded, so that every text is encoded once.
    Rows of one id stand by length and hash of their text, and a hot id may lie in several files.
    ``vocabulary`` is an absolute path, or the name of a public vocabulary, that every executor has.
    """
    keep_small(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, start = encoder(_path(vocabulary)).encode, 0
        for batch in gulps(batches):
            ids, sizes = encode(batch.column(1), end)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(start + ends - sizes), pa.array(sizes), lists], ["doc_id", "start", "n_tokens", "ids"])
            start += int(ends[-1]) if len(ends) else 0

    order = ["doc_id", "length", "hash", "row"]
    text = whole_text()
    docs.select("doc_id", text.alias("text"), F.length(text).alias("length"), F.xxhash64(text).alias("hash"),
                F.monotonically_increasing_id().alias("row")) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text") \
        .mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids array<int>") \
        .write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0") \
        .option("parquet.block.size", group_bytes).option("parquet.page.size", PAGE_BYTES) \
        .option("parquet.page.row.count.limit", page_rows).option("parquet.enable.dictionary", "false") \
        .option("parquet.enable.dictionary#ids.list.element", "true").parquet(folder)


def _part() -> Column:
    """The task that wrote the row; a task may have written several files."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")


def token_table(spark: SparkSession, folder: str, tokens: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the files, ``start`` over all of them; without ``tokens`` no list is read.

    Filters on ``doc_id`` reach the files, where statistics of row groups and page indexes skip the rest.
    """
    rows = spark.read.parquet(folder).withColumn("part", _part())
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per task that wrote.
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", *["ids"] * tokens)


def documents_between(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """Rows of the ids from ``low`` to ``high``, read from the pages that can hold them."""
    return token_table(spark, folder).where(F.col("doc_id").between(low, high))


def with_digest(rows: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: sizes and CRC-32 of the lists as little-endian four-byte numbers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            digest = [zlib.crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int64)),
                                              pa.array(digest, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per row of ``docs (doc_id, text)``, read back from token files.

    Null and empty texts hold the end identifier alone. Repeated rows are rows of their own, one behind the other;
    null ids come first; other columns are ignored; an empty table gives an empty one. The files lie in
    the shared folder until they have been read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-table-{uuid.uuid4().hex}"
    write_token_table(docs, folder, vocabulary, end)
    out = durable(with_digest(token_table(spark, folder)))
    remove(spark, folder)
    return out

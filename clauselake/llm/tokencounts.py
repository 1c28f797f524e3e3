"""Token counts of documents in flat token files, by a scan for end-of-document identifiers."""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.common import durable, keep_small, remove, shared_folder, whole_text

#: Word pieces of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Identifiers are two bytes, high byte first. The end of a document is 57279, beyond the vocabulary;
#: its two bytes are the UTF-8 form of one character, so that Spark's text writer can end rows with it.
KIND, END, END_TEXT = np.dtype(">u2"), 0xDFBF, b"\xdf\xbf".decode()
BLOCK = 1 << 20


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) >= END:
        raise ValueError("the vocabulary reaches the end-of-document identifier")
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> None:
    """One flat file of token identifiers per task, each document ended by ``END``, nothing else.

    A session's limit of records per file does not hold here: documents are found by their place in the task.

    ``vocabulary`` is a file of ranks that every executor has. Null and empty texts give no tokens.
    """
    keep_small(docs.sparkSession)

    def run(batches):
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            found = [np.array(encode(t), KIND).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["tokens"])

    docs.select(whole_text().alias("text")).mapInArrow(run, "tokens binary") \
        .select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", END_TEXT) \
        .option("maxRecordsPerFile", 0).text(folder)


def scanned(spark: SparkSession, folder: str, block: int = BLOCK, end: int = END) -> DataFrame:
    """``(file, block, size, first, last, inner)`` per block of the flat files in ``folder``.

    ``first`` and ``last`` are the places just behind the first and last end in the block (null without
    one), ``inner`` the token counts between the ends. A file must fit a task; files without tokens or
    ends are fine. A file of odd length ends in half an identifier, which raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), KIND)
                rows = []
                for n, start in enumerate(range(0, len(ids), block)):
                    part = ids[start:start + block]
                    at = np.flatnonzero(part == end)
                    rows.append((path, n, len(part), int(at[0]) + 1 if len(at) else None,
                                 int(at[-1]) + 1 if len(at) else None, (np.diff(at) - 1).tolist()))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["file", "block", "size", "first", "last", "inner"])

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, min(int(spark.conf.get(conf)), 512))
    return files.mapInArrow(run, "file string, block long, size long, first long, last long, inner array<long>")


def stitched(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, tokens, ended)`` per document, from the blocks of ``scanned``.

    A prefix scan over the blocks of a file carries what is open at the end of a block into the next
    ones. Tokens behind the last end of a file are a document that is not ``ended``.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ends = F.when(F.col("first").isNotNull(), F.size("inner") + 1).otherwise(0)
    placed = blocks.withColumn("start", zero(F.sum("size").over(before))).withColumn("ends", ends)
    carried = placed.withColumn("open", F.col("start") - zero(F.max(F.col("start") + F.col("last")).over(before))) \
        .withColumn("ordinal", zero(F.sum("ends").over(before)))
    closed = carried.where("first is not null").select(
        "file", "ordinal", F.posexplode(F.concat(F.array(F.col("open") + F.col("first") - 1), "inner")).alias("i", "tokens")) \
        .select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "tokens", F.lit(True).alias("ended"))
    rest = placed.groupBy("file").agg(
        (F.sum("size") - zero(F.max(F.col("start") + F.col("last")))).alias("tokens"), F.sum("ends").alias("ordinal")) \
        .where("tokens > 0").select("file", "ordinal", "tokens", F.lit(False).alias("ended"))
    return closed.union(rest)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``(doc_id, tokens)`` per row of ``docs (doc_id, text)``, counted in flat token files.

    The files are written to the shared folder by the tasks that scan ``docs``; their documents have no
    index, so they meet their ids by task and place in it, and the two counts must agree for every
    task. ``docs`` must be a scan (or a written table), which gives the same rows in every pass. Null
    and empty texts have 0 tokens; repeated rows and null ids stay; other columns are ignored; an empty
    table gives an empty one. The files are removed once they are counted.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("part")
    counts = durable(stitched(scanned(spark, folder, block)).select(part, "ordinal", "tokens"))
    remove(spark, folder)
    # Splits of a scan go by file sizes, not by columns, so the ids come in the same tasks as the texts did.
    row = F.monotonically_increasing_id()
    ids = durable(docs.select(F.spark_partition_id().cast("long").alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"),
                              "doc_id"))
    wrong = ids.groupBy("part").agg(F.count("*").alias("n")).join(
        counts.groupBy("part").agg(F.count("*").alias("m")), "part", "full").where("not (n <=> m)")
    if not wrong.isEmpty():
        raise RuntimeError("the token files do not hold one document per row")
    return ids.join(counts, ["part", "ordinal"]).select("doc_id", "tokens")

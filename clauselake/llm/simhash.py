"""Near duplicates by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, keep_small, texts, whole_text
from clauselake.llm.components import components

SEED = 42
STEP = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """64 majority bits over the XXH64 of all shingles of ``words`` words, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    many = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words \
        else iter([b" ".join(found)])
    hashes = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED))
    votes = np.zeros(64, np.int64)
    for start in range(0, many, STEP):
        part = np.fromiter(itertools.islice(hashes, STEP), np.dtype("<u8"), min(STEP, many - start))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > many, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` per document of ``docs (doc_id, text)``; one scan, no shuffle."""
    keep_small(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in texts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(t, words) for t in found], pa.int64())],
                ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def _keys(fp: Column, distance: int, blocks: int) -> Column:
    """One key per choice of blocks that may be equal: any close pair agrees in ``blocks - distance``."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    out = []
    for n, chosen in enumerate(itertools.combinations(masks, blocks - distance)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64
        out.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask))))
    return F.array(*out)


def _forest(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Edges that connect all fingerprints of both arrays that links between them connect.

    ``left is right`` for links inside one array. Each fingerprint is compared with those not yet
    reached only, so the edges are fewer than the fingerprints.
    """
    same = left is right
    every = left if same else np.concatenate([left, right])
    side = np.zeros(len(every), bool)
    side[len(left):] = True
    open_, out = np.ones(len(every), bool), []
    for seed in range(len(every)):
        if not open_[seed]:
            continue
        open_[seed] = False
        stack = [seed]
        while stack:
            at = stack.pop()
            rest = np.flatnonzero(open_ if same else open_ & (side != side[at]))
            # Of signed integers numpy counts the bits of the absolute value.
            near = rest[np.bitwise_count((every[rest] ^ every[at]).view(np.uint64)) <= distance]
            open_[near] = False
            stack.extend(near.tolist())
            if len(near):
                out.append(np.column_stack([np.full(len(near), every[at]), every[near]]))
    return np.concatenate(out) if out else np.empty((0, 2), every.dtype)


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, chunk: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` that connect what all links between the distinct ``fp`` of ``fps`` connect.

    Fingerprints that differ in at most ``distance`` bits agree in one choice of ``blocks - distance``
    of the blocks and so share a key. Buckets of two are compared as they are; larger ones are cut
    into chunks of about ``chunk`` and each pair of chunks is one small group, which gives a spanning
    forest of its links instead of all pairs. Work within a bucket is exact at every size.
    """
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), distance, blocks)).alias("key"))
    sizes = durable(keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) \
        .select("a", "b")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("parts")).cast("int")
    rows = keyed.join(sizes.where("n > 2").select("key", parts.alias("parts")), "key") \
        .withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("fp", "mine", F.xxhash64(
            "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"),
            (F.col("mine") == F.col("other")).alias("alone"))
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "mine")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(part: pd.DataFrame) -> list[np.ndarray]:
            if part.empty:
                return []
            grp, mine, fp = part.grp.to_numpy(), part.mine.to_numpy(), part.fp.to_numpy()
            cuts = np.flatnonzero(np.diff(grp)) + 1
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(grp)], strict=True):
                mid = s + int(np.searchsorted(mine[s:e], mine[s], "right"))
                if mid == e:
                    one = fp[s:e]
                    found.append(_forest(one, one, distance))
                else:
                    found.append(_forest(fp[s:mid], fp[mid:e], distance))
            return found

        rest = None
        for frame in itertools.chain(frames, [None]):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
                last = rest.grp.iloc[-1] if len(rest) else None
                whole = rest[rest.grp != last]
                rest = rest[rest.grp == last]
            else:
                whole = rest if rest is not None else pd.DataFrame({"grp": [], "mine": [], "fp": []})
            found = [x for x in solve(whole) if len(x)]
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return pairs.union(dealt.mapInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per document of ``docs (doc_id, text)``.

    Equal fingerprints are joined to one representative before any comparison. Null text counts as
    empty; documents without words have fingerprint zero and are linked like any other. A null
    ``doc_id`` keeps its row and is no component's name while the component has another. Repeated
    rows stay. Other columns are ignored; an empty table gives an empty one.
    """
    prints = durable(fingerprints(docs, words))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, distance, blocks))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

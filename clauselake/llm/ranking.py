"""Ranked lexical search: bundles of items pass through the owners of their terms, stage by stage.

Documents lie in blocks, and the postings of a block are parted among term owners, rare terms first. A bundle
carries the sparse sums of a block's documents from owner to owner; each stage is a cogroup of bundles and
postings that adds whole numbers. What can no longer come among the best of its block is left behind.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.common import durable, keep_small, whole_text

#: Bytes to term characters: A-Z become a-z, digits, letters and all of a character beyond ASCII stay, the rest parts terms.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BLOCK_ROWS, BLOCK_TERMS = 16_384, 1 << 21
#: Whole numbers of one contribution: weight x (SCALE x tf) div (1000 x tf + 20 x m).
SCALE = 1_000_000_000

BLOCKS = "block long, doc_ids array<long>, sizes array<long>, terms array<int>, places array<int>, times array<int>"
STATE = "block long, bundle int, doc_ids array<long>, sizes array<long>, items array<int>, places array<int>, scores array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM).split()


def _counted(words: list[bytes], vocabulary: dict[bytes, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Known terms of one text with their occurrences, ``most`` words at a time."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(words), most):
        part = words[at:at + most]
        ids = np.fromiter((vocabulary.get(w, -1) for w in part), np.int64, len(part))
        term, n = np.unique(ids[ids >= 0], return_counts=True)
        both, back = np.unique(np.append(total[0], term), return_inverse=True)
        total = both, np.bincount(back, np.append(total[1], n), len(both)).astype(np.int64)
    return total


def posting_blocks(docs: DataFrame, vocabulary: dict[bytes, int], rows: int = BLOCK_ROWS, words: int = BLOCK_TERMS) -> DataFrame:
    """Blocks of documents with the postings of the known terms, sorted by term; written once.

    A block ends at ``rows`` documents or ``words`` words, whichever comes first. ``sizes`` counts all terms
    of a document, known or not. Every scan task makes its own blocks: nothing is shuffled.
    """
    keep_small(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, task = shared.value, TaskContext.get().partitionId() << 32
        ids, sizes, parts, held, number = [], [], [], 0, 0

        def block():
            place = np.repeat(np.arange(len(ids)), [len(t) for t, _ in parts])
            term = np.concatenate([t for t, _ in parts]) if parts else np.zeros(0, np.int64)
            times = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(term, kind="stable")
            values = [[task + number], [ids], [sizes], [term[order]], [place[order]], [times[order]]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                                              ["block", "doc_ids", "sizes", "terms", "places", "times"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = terms_of(text)
                ids.append(doc)
                sizes.append(len(found))
                parts.append(_counted(found, known, words))
                held += len(found)
                if len(ids) == rows or held >= words:
                    yield block()
                    ids, sizes, parts, held, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, BLOCKS))


def term_weights(blocks: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, the number of documents with a term, and the number of all terms."""
    def run(batches):
        many = np.zeros(terms, np.int64)
        for batch in batches:
            for row in batch.column(0):
                many += np.bincount(row.values.to_numpy(), minlength=terms)
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(many[at])], ["term", "n"])

    documents, all_terms = blocks.select(
        F.sum(F.size(F.filter("sizes", lambda n: n > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    weights = np.zeros(terms, np.int64)
    # One row per term of the asked items.
    for r in blocks.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        weights[r.term] = math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * r.n + 1)))
    return weights, documents or 0, all_terms or 0


def owners_of(weights: np.ndarray, owners: int) -> np.ndarray:
    """The stage of each term: equal shares of the summed weight, the heaviest (rarest) terms first."""
    order = np.lexsort((np.arange(len(weights)), -weights))
    share = np.cumsum(weights[order]) / max(1, int(weights.sum()))
    out = np.empty(len(weights), np.int64)
    out[order] = np.minimum((share * owners).astype(np.int64), owners - 1)
    return out


def length_norm(sizes: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """``100 - 50 + (50 * n * N) div L``."""
    if not all_terms:
        return np.full(len(sizes), 50, np.int64)
    if 50 * int(sizes.max(initial=0)) * documents >= 1 << 63:
        return np.array([50 + 50 * int(n) * documents // all_terms for n in sizes], np.int64)
    return 50 + 50 * sizes * documents // all_terms


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest positive scores, ties to smaller ids."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Stage:
    """What one owner does to a bundle in a block; it is sent to the tasks."""

    def __init__(self, bundles: dict[int, list[np.ndarray]], weights: np.ndarray, owner_of: np.ndarray, documents: int, all_terms: int, k: int):
        self.bundles, self.weights, self.owner_of, self.documents, self.all_terms, self.k = bundles, weights, owner_of, documents, all_terms, k

    def add(self, owner: int, last: bool, state: dict, postings: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        """New ``(items, places, scores)`` of the state after this owner's terms."""
        items = self.bundles[state["bundle"]]
        ids, sizes = state["doc_ids"], state["sizes"]
        scores = np.zeros((len(items), len(ids)), np.int64)
        scores[state["items"], state["places"]] = state["scores"]
        if postings is not None:
            term, place, times = postings
            norm = length_norm(sizes, self.documents, self.all_terms)
            gain = self.weights[term] * (SCALE * times // (1000 * times + 20 * norm[place]))
            edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
            at = dict(zip(term[edges[:-1]].tolist(), zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), strict=True))
            for row, terms in zip(scores, items, strict=True):
                for t in terms[self.owner_of[terms] == owner].tolist():
                    if t in at:
                        low, high = at[t]
                        # A document stands once in the postings of a term.
                        row[place[low:high]] += gain[low:high]
        usable = ids != NO_ID
        scores[:, ~usable] = 0
        found = []
        for row, terms in zip(scores, items, strict=True):
            if last:
                found.append(best_places(row, ids, self.k))
                continue
            at = np.flatnonzero(row)
            if len(at) > self.k:
                # A term adds less than its weight times 10^6: who can't reach the k-th of today is out for good.
                rest = int(self.weights[terms[self.owner_of[terms] > owner]].sum()) * (SCALE // 1000)
                at = at[row[at] + rest >= np.partition(row[at], len(at) - self.k)[len(at) - self.k]]
            found.append(at)
        owner_item = np.repeat(np.arange(len(items)), [len(f) for f in found])
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        return owner_item, places, scores[owner_item, places]


#: Stands for a null id, whose row counts in the statistics and is never returned.
NO_ID = -(1 << 63)


def _row(table: pa.Table, i: int) -> dict:
    out = {}
    for name in table.column_names:
        value = table.column(name)[i]
        if pa.types.is_list(value.type):
            flat = value.values
            flat = flat.fill_null(NO_ID) if flat.null_count else flat
            out[name] = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            out[name] = value.as_py()
    return out


def through_owners(blocks: DataFrame, stage: Stage, owners: int) -> DataFrame:
    """Bundles with a state per block, after all owners; the last one keeps the best of the block only."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(stage)
    wanted = {b: np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.int64) for b, terms in stage.bundles.items()}
    terms_of_bundle = spark.sparkContext.broadcast(wanted)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    # One row per bundle and block.
    state = blocks.select("block", F.explode(F.array(*map(F.lit, stage.bundles))).alias("bundle"), "doc_ids", "sizes",
                          none("int").alias("items"), none("int").alias("places"), none("long").alias("scores"))

    def owned(owner):
        def run(batches):
            owner_of = shared.value.owner_of
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for i in range(len(table)):
                    row = _row(table, i)
                    for bundle, terms in terms_of_bundle.value.items():
                        mine = np.isin(row["terms"], terms[owner_of[terms] == owner])
                        if mine.any():
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row["block"]]), pa.array([bundle], pa.int32()),
                                 *[pa.array([row[c][mine]], pa.list_(pa.int32())) for c in ("terms", "places", "times")]],
                                ["block", "bundle", "terms", "places", "times"])

        return blocks.select("block", "terms", "places", "times").mapInArrow(
            run, "block long, bundle int, terms array<int>, places array<int>, times array<int>")

    def step_of(owner):
        def step(states: pa.Table, postings: pa.Table) -> pa.Table:
            row, mine = _row(states, 0), None
            if len(postings):
                p = _row(postings, 0)
                mine = p["terms"], p["places"], p["times"]
            items, places, scores = shared.value.add(owner, owner == owners - 1, row, mine)
            for name, value in (("items", items), ("places", places), ("scores", scores)):
                at = states.schema.get_field_index(name)
                states = states.set_column(at, name, pa.array([value], pa.list_(pa.int64() if name == "scores" else pa.int32())))
            return states

        return step

    for owner in range(owners):
        state = state.groupBy("block", "bundle").cogroup(owned(owner).groupBy("block", "bundle")).applyInArrow(step_of(owner), STATE)
    return state


def _item_sets(items: DataFrame, at_once: int, bytes_at_once: int) -> list[DataFrame]:
    asked = durable(items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id"))
                    .agg(F.concat_ws(" ", F.collect_list(whole_text())).alias("text")))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sets = max(-(-n // at_once), -(-size // bytes_at_once)) if n else 0
    return [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == turn).orderBy("item_id") for turn in range(sets)]


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, owners: int = 4, bundle: int = 128, items_at_once: int = 4096,
                     bytes_at_once: int = 8 << 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``docs (doc_id, text)`` per row of ``items (item_id, text)``.

    All documents are scored for all items in whole numbers; only documents with a score above 0 are
    returned, ties go to the smaller id. Null and empty texts have no terms. A null ``doc_id`` counts in the
    statistics and is never returned; rows that repeat an id are documents of their own. Null item ids
    are not asked; repeated ones are asked once, with the terms of all their texts. Other columns are ignored;
    empty tables give an empty one.

    Items are asked in sets of about ``items_at_once`` and ``bytes_at_once`` (the terms of a set are all that is
    broadcast), each with one pass over the documents; a set is dealt into bundles of ``bundle`` items. The
    sums of a bundle in a block take ``bundle x block_rows`` whole numbers in a task.
    """
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, score long"
    found = None
    for asked in _item_sets(items, items_at_once, bytes_at_once):
        rows = [(r.item_id, sorted(set(terms_of(r.text.encode())))) for r in asked.collect()]
        vocabulary = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(t for _, t in rows))))}
        blocks = posting_blocks(docs, vocabulary, block_rows)
        weights, documents, all_terms = term_weights(blocks, len(vocabulary))
        bundles = {b: [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in rows[at:at + bundle]]
                   for b, at in enumerate(range(0, len(rows), bundle))}
        stage = Stage(bundles, weights, owners_of(weights, owners), documents, all_terms, k)
        ids = {b: np.array([i for i, _ in rows[at:at + bundle]], np.int64) for b, at in enumerate(range(0, len(rows), bundle))}
        part = _answers(through_owners(blocks, stage, owners), ids, schema)
        part = durable(part) if found is not None else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answers(states: DataFrame, ids: dict[int, np.ndarray], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(len(table)):
                r = _row(table, i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r["bundle"]][r["items"]]), pa.array(r["doc_ids"][r["places"]]), pa.array(r["scores"])],
                    ["item_id", "doc_id", "score"])

    return states.mapInArrow(run, schema)

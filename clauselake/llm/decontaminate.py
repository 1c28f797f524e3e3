"""Benchmark passages in training texts: BM25 retrieval with block bounds, then an overlap check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import durable, keep_small, whole_text

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
K1, B = 1.2, 0.75
#: Block bounds that are summed at a time.
BOUNDS = 1 << 21


def normal(text: str) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def parted(text: str, words: list[bytes]) -> int:
    """Where the answer starts: the last sentence, or the last third of a single sentence."""
    ends = [i for i in range(len(text) - 1) if text[i] in ".!?" and text[i + 1].isspace()]
    at = len(normal(text[:ends[-1] + 1])) if ends else 0
    return at if 0 < at < len(words) else len(words) - max(1, len(words) // 3)


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = max(1, min(n, len(words)))
    return set(zip(*(words[k:] for k in range(n)), strict=False))


@dataclass(frozen=True)
class Index:
    """BM25 weights of items, each as a share of the item's score against itself.

    ``exact`` is terms by items, ``bound`` the largest weight per term and block of ``block`` items.
    """

    ids: list
    vocabulary: dict[bytes, int]
    exact: np.ndarray
    bound: np.ndarray
    block: int
    length: int
    checks: list[list[tuple[set, int]]]

    @staticmethod
    def built(items: list[tuple], df: dict[bytes, int], total: int, mean_length: float, block: int, gram: int) -> Index:
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, _ in items for w in words}))}
        blocks = -(-len(items) // block)
        exact = np.zeros((len(vocabulary), blocks * block), np.float32)
        for k, (_, words, _) in enumerate(items):
            found, tf = np.unique([vocabulary[w] for w in words], return_counts=True)
            exact[found, k] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
        n = np.array([df[w] for w in vocabulary], np.float64)
        exact *= np.log1p((total - n + 0.5) / (n + 0.5))[:, None]
        exact /= np.maximum(exact.sum(0), 1e-9)
        bound = exact.reshape(len(vocabulary), blocks, block).max(2)
        # Short parts are compared by shorter sequences, so that one changed word does not hide them.
        checks = [[(grams(part, n), n) for part in (words[:at], words[at:]) for n in [max(1, min(gram, len(part) // 4))]]
                  for _, words, at in items]
        return Index([i for i, _, _ in items], vocabulary, exact, bound, block,
                     max(len(w) for _, w, _ in items), checks)

    def _open_blocks(self, term: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Passages and blocks whose summed bounds reach ``least``; no other block holds an item that does.

        Passages are taken a few at a time, so that a very long text needs no more memory than they do.
        """
        at = 0
        while at < len(starts):
            most = starts[at] + max(1, BOUNDS // self.bound.shape[1])
            after = max(at + 1, int(np.searchsorted(ends, most, "right")))
            sums = np.add.reduceat(self.bound[term[starts[at]:ends[after - 1]]], starts[at:after] - starts[at])
            for k, b in zip(*np.nonzero(sums >= least), strict=True):
                yield at + int(k), int(b)
            at = after

    def search(self, words: list[bytes], least: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Per item the best verified passage: score, overlap of the question, overlap of the answer."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        # Passages are two steps long and a step apart, so every item lies whole in one of them.
        step, last = self.length, max(0, (len(words) - 1) // self.length - 1)
        seg, term, size = at // step, ids[at], len(self.vocabulary)
        keys = np.unique(np.concatenate([np.minimum(seg, last) * size + term, np.maximum(seg - 1, 0) * size + term]))
        passage, term = keys // size, keys % size
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(keys))
        out: dict[int, tuple[float, float, float]] = {}
        for k, b in self._open_blocks(term, starts, ends, least):
            scores = self.exact[term[starts[k]:ends[k]], b * self.block:(b + 1) * self.block].sum(0)
            for j in np.flatnonzero(scores >= least):
                item, score = b * self.block + int(j), float(scores[j])
                lo = int(passage[starts[k]]) * step
                here = words[lo:lo + 2 * step]
                question, answer = (len(want & grams(here, n)) / max(1, len(want)) if want else 1.0
                                    for want, n in self.checks[item])
                if min(question, answer) >= overlap and score > out.get(item, (0,))[0]:
                    out[item] = (score, question, answer)
        return out


def _items(benchmark: DataFrame, answer: str | None, least_words: int) -> DataFrame:
    """``(item_id, words, at)`` of the items with at least ``least_words`` words; repeated rows count once."""
    kind = benchmark.schema["item_id"].dataType
    arrow = {"int": "int", "bigint": "long"}.get(kind.simpleString(), "string")
    chosen = benchmark.select(F.col("item_id").cast(arrow).alias("item_id"), whole_text().alias("text"),
                              (whole_text(answer) if answer else F.lit("")).alias("answer")).distinct()

    def run(batches):
        for batch in batches:
            words, at = [], []
            for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, tail = normal(t), normal(a)
                words.append(found + tail)
                at.append(len(found) if tail else parted(t, found) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.binary())), pa.array(at, pa.int32())],
                ["item_id", "words", "at"])

    return durable(chosen.mapInArrow(run, f"item_id {arrow}, words array<binary>, at int")
                   .where(F.size("words") >= least_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None, least: float = 0.5,
                 overlap: float = 0.5, gram: int = 3, least_words: int = 5, block: int = 16,
                 items_at_once: int = 5_000) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)``: items found in ``docs``.

    Every document is cut into passages that overlap by the longest item, and each is a query to the
    index of items. An item is retrieved when the BM25 weight of its terms in the passage is at least
    ``least`` of its whole weight, and kept when at least ``overlap`` of the word sequences of its question
    and of its answer stand in the passage (of ``gram`` words, fewer in parts of under four times that). ``answer`` names the column of answers; without
    it the last sentence of an item is its answer. One row per document and item, the best passage.

    Items are broadcast ``items_at_once`` at a time and the documents are read once for each such set,
    so what is broadcast is bounded. Documents are never shuffled. Null and empty texts and items of
    fewer than ``least_words`` words match nothing; repeated rows give repeated rows; a null ``doc_id``
    stays null; other columns are ignored; an empty benchmark gives an empty table.
    """
    spark = docs.sparkSession
    keep_small(spark)
    items = _items(benchmark, answer, least_words)
    total, length = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    frequency = items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    arrow = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {arrow}, score double, question_overlap double, answer_overlap double"
    kind = {"int": pa.int32(), "bigint": pa.int64()}.get(arrow, pa.string())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = spark.createDataFrame([], schema)
    sets = -(-total // items_at_once)
    for turn in range(sets):
        mine = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(sets)) == turn)
        rows = [(r.item_id, [bytes(w) for w in r.words], r.at) for r in mine.orderBy("item_id", "words").collect()]
        if not rows:
            continue
        terms = frequency.join(mine.select(F.explode("words").alias("w")).distinct(), "w", "left_semi")
        shared = spark.sparkContext.broadcast(
            Index.built(rows, {bytes(r.w): r.n for r in terms.collect()}, total, length, block, gram))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                out = [(d, index.ids[k], *v) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                       for k, v in index.search(normal(t), least, overlap).items()]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.int64(), kind, *[pa.float64()] * 3), strict=True)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.union(source.mapInArrow(run, schema))
    return found

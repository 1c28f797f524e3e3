"""Toxicity of whole texts after a noisy channel of leetspeak, spacing and repetition is undone."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import held_out, keep_small, whole_text
from clauselake.llm.statistics import bounded_labels, labelled_texts, telling_words
from clauselake.session import durable

#: Letters that a character may stand for inside a word; the first is the most usual one.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou", "_": "aeiou",
}
LETTERS = 28
_CODE = np.zeros(256, np.int32)
_CODE[128:] = 27
for _i in range(26):
    _CODE[97 + _i] = _CODE[65 + _i] = _i + 1
_EDGE = "\"'()[]{}<>.,;:?!*#%&~^=/\\|-_+…“”‘’«»¿¡"
_OPEN = "\"'([{<.,;:?~^=/\\-_…“”‘’«»¿"
_RUN = re.compile(r"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
_SPLIT = re.compile(r"(?:[^\W_][.\-_*·]){2,}[^\W_]")
CACHE = 200_000


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of three-letter sequences over all texts, 28 by 28 by 28 (0: no letter, 27: other letters)."""
    def run(batches):
        total = np.zeros(LETTERS ** 3, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                for start in range(0, len(t), 1 << 20):
                    c = _CODE[np.frombuffer(t, np.uint8)[max(0, start - 2):start + (1 << 20)]]
                    total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(LETTERS ** 3)
    for r in docs.select(whole_text().alias("text")).mapInArrow(run, "at long, n long") \
            .groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r.at] = r.n
    return counts.reshape(LETTERS, LETTERS, LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third letter after two, smoothed by the one-letter history."""
    two = counts.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5))


def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
    """Per position the strings it may stand for, with a channel cost."""
    for c, run in itertools.groupby(word):
        n = len(list(run))
        letters = c if c.isalpha() else LEET.get(c, "")
        if not letters:
            continue
        options = [(x, -0.7 * k - (0 if c.isalpha() else np.log(len(letters)))) for k, x in enumerate(letters)]
        if c.isalpha() or n > 2:
            twice = [(x + x, p - (0.0 if n == 2 else 1.0)) for x, p in options]
            once = [(x, p - (2.0 if n == 2 else 0.0)) for x, p in options]
            yield once + twice if n > 1 else options
        else:
            yield from [options] * n


def decode(word: str, model: np.ndarray, known: Callable[[str], bool] = lambda w: False, keep: int = 4) -> str:
    """The likeliest plain word behind ``word``: Viterbi over its lattice, ``keep`` paths per two-letter state.

    Among the finished paths one that is a ``known`` word wins, as if it were e^6 times likelier.
    """
    code = lambda c: int(_CODE[ord(c)]) if ord(c) < 128 else 27
    paths: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for options in lattice(word):
        new: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), kept in paths.items():
            for piece, cost in options:
                x, y, p = a, b, cost
                for c in piece:
                    z = code(c)
                    p += model[x, y, z]
                    x, y = y, z
                new.setdefault((x, y), []).extend((s + p, t + piece) for s, t in kept)
        paths = {k: sorted(v, reverse=True)[:keep] for k, v in new.items()}
    ended = [(s + model[a, b, 0] + 6 * known(t), t) for (a, b), kept in paths.items() for s, t in kept]
    return max(ended)[1]


class Restorer:
    """Restored words of texts; equal tokens are decoded once while they fit the memory of a task."""

    def __init__(self, model: np.ndarray, known: frozenset[str] = frozenset()):
        self.model, self.known, self.memory = model, known, {}
        self.starts = {w[:k] for w in known if len(w) > 3 for k in range(1, len(w))}
        self.prefixes = {w[:k] for w in known for k in range(len(w) + 1)}

    def token(self, w: str) -> str:
        found = self.memory.get(w)
        if found is None:
            if len(self.memory) >= CACHE:
                self.memory.clear()
            found = self.memory[w] = self._token(w)
        return found

    def _token(self, w: str) -> str:
        whole = w.lstrip(_OPEN).rstrip(_EDGE)
        core = re.sub(r"^([^\w\s])\1+|([^\w\s])\2+$", "", whole)
        if core != whole and (found := self._known(whole)):
            return found
        if core.isalpha() and not _RUN.search(core):
            return _TWICE.search(core) and self._known(core) or core
        if not any(c.isalpha() for c in core) or "@" in core and "." in core:
            return self._known(core[::2] if _SPLIT.fullmatch(core) else core) or core.strip(_EDGE)
        if _SPLIT.fullmatch(core):
            core = core[::2]
        return decode(core, self.model, self.known.__contains__)

    def _known(self, core: str) -> str | None:
        """The known word behind what may as well be a plain word or a number."""
        if core in self.known:
            return core
        if not self.known or not all(c.isalpha() or c in LEET for c in core) or not self._reaches(core):
            return None
        found = decode(core, self.model, self.known.__contains__)
        return found if found in self.known else None

    def _reaches(self, core: str) -> bool:
        """True if a path through the lattice spells a known word; the walk ends where no known word goes on."""
        at = {""}
        for options in lattice(core):
            at = {s + x for s in at for x, _ in options} & self.prefixes
            if not at:
                return False
        return not self.known.isdisjoint(at)

    def joined(self, text: str) -> list[str]:
        """Known words of four letters or more that stand in pieces, one of two characters at least."""
        tokens = text.lower().split()
        cores = [t.lstrip(_OPEN).rstrip(_EDGE) for t in tokens]
        out = []
        for i, piece in enumerate(cores):
            if piece in self.starts:
                whole, longest = piece, len(piece)
                for k in range(i + 1, len(cores)):
                    after = cores[k]
                    whole, longest = whole + after, max(longest, len(after))
                    if longest > 1 and after and whole in self.known:
                        out.append(whole)
                    if whole not in self.starts:
                        break
            if i and self.known and len(piece) < 5 and len(cores[i - 1]) < 5 and piece and cores[i - 1]:
                whole = cores[i - 1] + piece
                if len(whole) > 3 and not whole.isalpha() and any(c.isalpha() for c in whole) \
                        and self.token(whole) in self.known:
                    out.append(self.token(whole))
        return out

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Restored words, and the strings that single spaced characters make up."""
        tokens = text.lower().split()
        lengths = bytes(map(min, map(len, tokens), itertools.repeat(255)))
        spaced = []
        for m in re.finditer(rb"\x01{3,}", lengths):
            joined = "".join(tokens[m.start():m.end()])
            rest = tokens[m.end()] if m.end() < len(tokens) and lengths[m.end()] == 2 else ""
            spaced.append(self.token(joined + rest[:1] * (not rest[-1:].isalnum())))
        return list(map(self.token, tokens)), spaced

    def hits(self, text: str, told: dict[str, int]) -> tuple[set[int], int, int]:
        """Places of the ``told`` words in the restored text, their number, and the number of words."""
        words, spaced = self.words(text)
        found = told.keys() & set(words)
        many = sum(w in found for w in words) if found else 0
        for joined in spaced:
            inside = {w for w in told if len(w) > 3 and w in joined}
            found, many = found | inside, many + len(inside)
        pieces = [w for w in self.joined(text) if w in told]
        found, many = found | set(pieces), many + len(pieces)
        return {told[w] for w in found}, many, len(words)


@dataclass(frozen=True)
class Model:
    language: np.ndarray
    told: dict[str, int]
    weights: np.ndarray

    def design(self, restorer: Restorer, text: str) -> np.ndarray:
        at, many, words = restorer.hits(text, self.told)
        x = np.zeros(len(self.told) + 4)
        x[list(at)] = 1
        x[-4:] = len(at), np.log1p(many), 10 * many / max(words, 1), 1
        return x

    def restorer(self) -> Restorer:
        return Restorer(self.language, frozenset(self.told))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weigh = penalty * np.eye(len(w))
    weigh[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + weigh, x.T @ (y - p) - weigh @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", skip=None, words: int = 128, rows: int = 20_000) -> Model:
    """Language model of all texts, then telling restored words and their weights from labelled documents.

    At most ``rows`` labelled documents, chosen by hash, are used for the words and weights.
    """
    keep_small(docs.sparkSession)
    language = language_model(trigrams(docs))
    chosen = durable(bounded_labels(labels, label, rows, skip))

    def normal(text: bytes) -> list[bytes]:
        restorer = normal.__dict__.setdefault("own", Restorer(language))
        return [w.encode() for w in restorer.words(text.decode("utf-8", "replace"))[0] if len(w) > 2]

    told = {w.decode(): i for i, w in enumerate(telling_words(docs, chosen, 2, words, normal))}
    blank = Model(language, told, np.zeros(len(told) + 4))

    def run(batches):
        restorer = blank.restorer()
        for batch in batches:
            x = [blank.design(restorer, t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    sample = labelled_texts(docs, chosen).mapInArrow(run, "doc_id long, y int, x array<float>").toArrow()
    if not len(sample):
        return blank
    y = sample.column("y").to_numpy().astype(float)
    x = sample.column("x").combine_chunks().values.to_numpy().reshape(len(y), -1).astype(float)
    order = np.lexsort((y, *x.T[-4:], sample.column("doc_id").to_numpy()))
    return Model(language, told, _logistic(x[order], y[order]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ids with CRC-32 remainder ``rest`` of ``parts`` teach nothing.

    The score reads the whole text and nothing else. Null and empty texts score like texts without a
    telling word. Repeated rows score alike; other columns are ignored; without labelled documents every
    score is 0.5; an empty table gives an empty one.
    """
    model = fit(docs, labels, skip=held_out(F.col("doc_id"), parts, rest))

    def run(batches):
        restorer = model.restorer()
        for batch in batches:
            x = np.array([model.design(restorer, t) for t in batch.column(1).to_pylist()]).reshape(-1, len(model.weights))
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id"), parts, rest).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

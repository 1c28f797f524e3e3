"""Matching a column against term lists and pattern lists.

Terms are substring tests on lower-cased text. They go through array functions over one literal
array, so a list of hundreds of terms stays one small expression. Patterns are separate ``rlike``
tests: one large alternation was several times slower over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions.matching import TermMatcher

# The characters that count as white space, as a set and as a pattern class.
RARE_SPACES = "\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACES = "\t\n\x0b\x0c\r " + RARE_SPACES
SPACE_SET = r"\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def literal_array(values: Iterable[str]) -> Column:
    """Literal string array, also for an empty list.

    It is built from one joined literal, which the optimizer folds to the array: a long list then
    costs one expression instead of one per word.
    """
    words = list(values)
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(words)), "\x1f", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    The body of an array function repeats whatever it mentions for every element: lower-casing a
    text inside a test over 100 words does it 100 times. A bound value is a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def terms_found(text: Column, terms: Sequence[str]) -> Column:
    """The listed terms that occur in ``text``; a term listed twice is returned twice."""
    return let(text, lambda x: _found(x, terms))


def _found(bound: Column, terms: Sequence[str]) -> Column:
    if len(terms) >= INDEX_FROM:
        return _found_indexed(bound, terms)
    return F.filter(literal_array(terms), lambda t: F.contains(bound, t))


# Terms from which on a text is looked up in an index of its letters instead of being searched once per term: at sf 0.1
# 127 terms take 1.7 s by search and 3.7 s by index, 500 take 5.5 s both ways, 2000 take 21 and 14 s.
INDEX_FROM = 800


def gram_index(terms: Sequence[str]) -> dict[str, list[int]]:
    """Places of the terms by a run of three characters that every match holds (fewer in shorter terms).

    The run lies inside one word of the term. Of its runs a term takes the one that fewest terms share; a
    term without any character but white space has none and stands under the empty run.
    """
    runs = []
    for t in terms:
        words = re.split(f"[{re.escape(SPACES)}]+", t)
        found = {w[i:i + 3] for w in words if len(w) >= 3 for i in range(len(w) - 2)}
        runs.append(found or {max(words, key=len)[:2]})
    shared = Counter(r for found in runs for r in found)
    index: dict[str, list[int]] = {}
    for place, found in enumerate(runs):
        index.setdefault(min(found, key=lambda r: (shared[r], r)), []).append(place)
    return index


def _grams(word: Column, size: int) -> Column:
    places = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - (size - 1)))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(word, i, F.lit(size)))


def _found_indexed(bound: Column, terms: Sequence[str]) -> Column:
    """The terms that occur, in the order of the list: the distinct runs of the text are met with the runs of the
    terms as hash sets, and only terms whose run is there are searched for."""
    index = gram_index(terms)
    words = F.array_distinct(F.split(F.coalesce(bound, F.lit("")), f"[{SPACE_SET}]+"))
    sizes = sorted({len(r) for r in index} - {0})
    grams = F.flatten(F.transform(words, lambda w: F.concat(*[_grams(w, n) for n in sizes])))
    keys = literal_array(index)
    places = F.split(F.lit("\x1f".join(",".join(map(str, p)) for p in index.values())), "\x1f", -1)
    hits = F.array_intersect(keys, grams)
    if "" in index:
        hits = F.array_union(hits, F.array(F.lit("")))

    def candidates(found: Column) -> Column:
        lists = F.transform(found, lambda g: F.split(F.element_at(places, F.array_position(keys, g).cast("int")), ","))
        return F.array_sort(F.transform(F.flatten(lists), lambda p: p.cast("int")))

    words_of = literal_array(terms)
    tried = F.transform(let(hits, candidates), lambda p: F.get(words_of, p))
    return F.filter(tried, lambda t: F.contains(bound, t))


def terms_found_count(text: Column, terms: Sequence[str]) -> Column:
    return F.size(terms_found(text, terms))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True when at least one term occurs; stops at the first hit."""
    return let(text, lambda x: F.exists(literal_array(terms), lambda t: F.contains(x, t)))


def _times(bound: Column, term: Column, whole_word: bool = False) -> Column:
    edge = r"\b" if whole_word else ""
    return F.regexp_count(bound, F.concat(F.lit(edge + r"\Q"), term, F.lit(r"\E" + edge)))


def occurrence_map(text: Column, terms: Sequence[str]) -> Column:
    """Map from each distinct term that occurs to its number of non-overlapping occurrences.

    A list of ``INDEX_FROM`` terms or more is counted in batches of texts; ``text`` must then not be a variable of an
    array function.
    """
    distinct = list(dict.fromkeys(terms))
    if len(distinct) >= INDEX_FROM and all(distinct):
        return _counted_map(distinct)(text)
    return let(
        text,
        lambda x: F.map_from_entries(
            F.transform(_found(x, distinct), lambda t: F.struct(t, _times(x, t)))
        ),
    )


def _counted_map(terms: Sequence[str]):
    matcher, words = TermMatcher(terms), pa.array(terms, pa.string())

    @F.arrow_udf("map<string,int>")
    def counted(texts: pa.Array) -> pa.Array:
        row, term, count = matcher.matches(texts)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(term)), pa.array(count, pa.int32()))

    return counted


def word_counts(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of each term as whole words, in the order of the list, as ``word_hits`` counts them; all terms in one
    pass over a batch of texts. Null texts hold nothing. ``text`` must not be a variable of an array function."""
    if not terms or not all(terms):
        return let(F.coalesce(text, F.lit("")), lambda x: F.transform(literal_array(terms), lambda t: _times(x, t, True)))
    distinct = list(dict.fromkeys(terms))
    matcher, places = TermMatcher(distinct), np.array([distinct.index(t) for t in terms])

    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), len(distinct)), dtype=np.int32)
        row, term, count = matcher.matches(texts, whole_words=True)
        found[row, term] = count
        ends = np.arange(len(texts) + 1, dtype=np.int32) * len(places)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found[:, places].ravel()))

    return counted(text)


def hits_of(counts: Column, step: float, extra: int) -> Column:
    """Sum over the counts above 0 of ``1 + step * min(count - 1, extra)``."""
    return F.aggregate(
        F.filter(counts, lambda n: n > 0),
        F.lit(0.0),
        lambda total, n: total + F.lit(1.0) + F.least(n - 1, F.lit(extra)) * F.lit(step),
    )


def occurrences_in(counts: Column, terms: Sequence[str]) -> Column:
    """Sum of the map's counts over a term list; a term listed twice counts twice."""
    return let(
        counts,
        lambda m: F.aggregate(
            literal_array(terms),
            F.lit(0),
            lambda total, t: total + F.coalesce(F.try_element_at(m, t), F.lit(0)),
        ),
    )


def term_occurrences(text: Column, terms: Sequence[str]) -> Column:
    """Total non-overlapping occurrences; only terms that occur are counted."""
    return let(
        text,
        lambda x: F.aggregate(_found(x, terms), F.lit(0), lambda total, t: total + _times(x, t)),
    )


def word_hits(text: Column, terms: Sequence[str], step: float, extra: int) -> Column:
    """Sum over whole-word terms of ``1 + step * min(occurrences - 1, extra)``.

    ``text`` must hold ASCII word characters only (see ``plain_words``), so that the word
    boundaries agree between regex engines.
    """

    def counts(x: Column) -> Column:
        return F.transform(_found(x, terms), lambda t: _times(x, t, True))

    return hits_of(let(text, counts), step, extra)


def required_literal(pattern: str) -> str | None:
    """A lower-cased run of letters that every match of ``pattern`` must hold, if one is plain.

    Only characters outside groups, sets and optional parts are looked at; a pattern with a
    top-level choice has none.
    """
    p = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    p = re.sub(r"\\[a-zA-Z]", "\0", p)
    p = re.sub(r"\\(.)", lambda m: m.group(1) if m.group(1).isalnum() or m.group(1) in "/-" else "\0",
               p)
    p = re.sub(r"\[[^\]]*\]", "\0", p)
    while re.search(r"\([^()]*\)", p):
        p = re.sub(r"\([^()]*\)", "\0", p)
    if "|" in p:
        return None
    p = re.sub(r".(?:[?*]|\{[^}]*\})", "\0", p)
    p = re.sub(r"[.^$+()]", "\0", p)
    runs = sorted(p.split("\0"), key=len)
    best = runs[-1].lower() if runs else ""
    return best if len(best) >= 3 and best.isascii() else None


def _groups(pattern: str) -> list[tuple[list[str], str]]:
    """The choices of each outermost group, and what follows it; lookarounds are left out."""
    found, depth, i, start, cuts = [], 0, 0, 0, []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*").match(pattern, i).end()
        elif c == "(":
            depth += 1
            if depth == 1:
                start, cuts = i + (3 if pattern.startswith("(?:", i) else 1), []
        elif c == "|" and depth == 1:
            cuts.append(i)
        elif c == ")":
            depth -= 1
            if depth == 0 and pattern[start] != "?":
                edges = [start - 1, *cuts, i]
                found.append(([pattern[a + 1:b] for a, b in zip(edges, edges[1:])], pattern[i + 1:i + 2]))
        i += 1
    return found


def required_choices(pattern: str) -> tuple[str, ...]:
    """Lower-cased runs of letters of which every match of ``pattern`` holds at least one; empty if none are plain.

    Either the one of ``required_literal``, or one for each choice of a group that must match.
    """
    literal = required_literal(pattern)
    if literal is not None:
        return (literal,)
    p, best = re.sub(r"^\(\?[a-z]+\)", "", pattern), ()
    groups = _groups(p)
    if len(_groups(f"(?:{p})")[0][0]) > 1:
        return ()
    for choices, behind in groups:
        if behind in ("?", "*", "{"):
            continue
        each = [required_choices(c) for c in choices]
        runs = tuple(dict.fromkeys(r for e in each for r in e))
        if all(each) and (not best or min(map(len, runs)) > min(map(len, best))):
            best = runs
    return best


def pattern_found(text: Column, pattern: str, low: Column | None = None) -> Column:
    """``rlike``, behind plain substring tests where the pattern allows them.

    A substring test is many times cheaper than the pattern, and they settle most texts. ``low`` is
    the lower-cased text when the caller has it at hand.
    """
    choices = required_choices(pattern)
    found = F.rlike(text, F.lit(pattern))
    if not choices or low is None:
        return found
    return reduce(or_, [F.contains(low, F.lit(c)) for c in choices]) & found


def patterns_matched(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """Number of patterns that match somewhere."""
    if not patterns:
        return F.lit(0)
    return reduce(add, [pattern_found(text, p, low).cast("int") for p in patterns])


def any_pattern(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    if not patterns:
        return F.lit(False)
    return reduce(or_, [pattern_found(text, p, low) for p in patterns])


def has_rare_space(text: Column) -> Column:
    """Holds white space outside ASCII. A cheap test that lets most texts take plain ``\\s``, which
    the regex engine matches many times faster than the full set."""
    return any_term(text, RARE_SPACES)


def flag(condition: Column) -> Column:
    """1 or 0, with null counted as 0."""
    return F.when(condition, 1).otherwise(0)


def round_half_up(value: Column) -> Column:
    """Halves go up, also below zero; Spark's ``round`` sends them away from zero."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))

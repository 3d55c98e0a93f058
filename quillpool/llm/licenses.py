"""Licence scans: templates with optional and replaceable regions, compiled into one automaton over words.

A template accepts a run of words whose mandatory wording is there word for word, with the regions between as its markup
allows (see notices.py). All templates run at once: the automaton's sets of states are made as texts lead to them, kept up
to a bound and made anew beyond it, so a text takes one table look-up a word however many templates there are. Where a
template ends, the same automaton read backwards finds where it began.

A document's score is m / (m + 4) for the most mandatory words, m, of any place in it: 0 without a place, 0.33 for a phrase
of two words, 0.98 for a whole licence.

Defined results: a null, empty or wordless text has no words and no places, null first_word and last_word, empty label lists
and score 0. Words are runs of digits, letters a to z (A to Z count as these) and code points from 128 on. Repeated rows are
judged each; null ids stay; an empty table gives an empty table; further columns are ignored. Texts are read whole, in
pieces of `at_once` bytes cut between words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .notices import NOTICES, PHRASES

#: Bytes as words see them: small letters, digits and all of longer code points as they are, everything else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# --- markup


@dataclass(frozen=True)
class Any:
    """A replaceable region: `least` to `most` words of any kind."""

    least: int
    most: int


@dataclass(frozen=True)
class Choice:
    """A replaceable region: one of these wordings."""

    wordings: tuple[tuple[bytes, ...], ...]


@dataclass(frozen=True)
class Optional:
    inner: tuple


def parse(markup: str) -> tuple:
    """Words (bytes), Any, Choice and Optional in order; raises ValueError for markup that does not balance."""
    open_: list[list] = [[]]
    for m in re.finditer(r"(\[\[)|(\]\])|\{\{(.*?)\}\}|(.+?)(?=\[\[|\]\]|\{\{|$)", markup, re.S):
        if m[1]:
            open_.append([])
        elif m[2]:
            if len(open_) == 1:
                raise ValueError("a region ends that did not begin")
            inner = tuple(open_.pop())
            open_[-1].append(Optional(inner))
        elif m[3] is not None:
            if span := re.fullmatch(r"\s*(\d+)-(\d+)\s*", m[3]):
                least, most = int(span[1]), int(span[2])
                if not least <= most or not most:
                    raise ValueError(f"{{{{{m[3]}}}}} stands for no words")
                open_[-1].append(Any(least, most))
            else:
                wordings = tuple(tuple(words_of(w.encode())) for w in m[3].split("|"))
                if not all(wordings):
                    raise ValueError(f"{{{{{m[3]}}}}} lists a wording without words")
                open_[-1].append(Choice(wordings))
        else:
            open_[-1] += words_of(m[4].encode())
    if len(open_) > 1:
        raise ValueError("a region does not end")
    return tuple(open_[0])


def mandatory(tree: tuple) -> int:
    """Words that stand outside of every region."""
    return sum(isinstance(x, bytes) for x in tree)


def as_regex(tree: tuple) -> str:
    """The same as a regular expression over words that are each followed by a space."""
    out = []
    for x in tree:
        if isinstance(x, bytes):
            out.append(x.decode() + " ")
        elif isinstance(x, Any):
            out.append(f"(?:[^ ]+ ){{{x.least},{x.most}}}")
        elif isinstance(x, Choice):
            out.append("(?:" + "|".join(b" ".join(w).decode() + " " for w in x.wordings) + ")")
        else:
            out.append(f"(?:{as_regex(x.inner)})?")
    return "".join(out)


# --- automaton


@dataclass
class Net:
    """States with steps by word (-1: any word) and without one."""

    steps: list[list[tuple[int, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree: tuple, at: int, number) -> int:
        """Adds what tree accepts from state `at` on; returns the state after it."""
        for x in tree:
            if isinstance(x, bytes):
                at = self._step(at, number(x))
            elif isinstance(x, Any):
                skips = []
                for k in range(x.most):
                    if k >= x.least:
                        skips.append(at)
                    at = self._step(at, -1)
                for s in skips:
                    self.free[s].append(at)
            elif isinstance(x, Choice):
                end = self.state()
                for wording in x.wordings:
                    last = at
                    for w in wording:
                        last = self._step(last, number(w))
                    self.free[last].append(end)
                at = end
            else:
                end = self.add(x.inner, at, number)
                out = self.state()
                self.free[end].append(out)
                self.free[at].append(out)
                at = out
        return at

    def _step(self, at: int, word: int) -> int:
        to = self.state()
        self.steps[at].append((word, to))
        return to

    def closure(self, states: Iterable[int], free: list[list[int]]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class Automaton:
    """All templates at once. templates: (label, markup) in order; places name them by that order."""

    def __init__(self, templates: list[tuple[str, str]], most_sets: int = 20_000):
        self.labels, self.trees = [t[0] for t in templates], [parse(t[1]) for t in templates]
        self.mandatory = [mandatory(t) for t in self.trees]
        if not all(self.mandatory):
            raise ValueError("a template without mandatory words accepts anything")
        self.words: dict[bytes, int] = {}
        number = lambda w: self.words.setdefault(w, len(self.words))
        self.net, self.begins, self.goals = Net(), [], []
        for tree in self.trees:
            self.begins.append(self.net.state())
            self.goals.append(self.net.add(tree, self.begins[-1], number))
        self.ends = {s: t for t, s in enumerate(self.goals)}
        n = len(self.net.steps)
        self.back_steps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.back_free: list[list[int]] = [[] for _ in range(n)]
        for a in range(n):
            for w, b in self.net.steps[a]:
                self.back_steps[b].append((w, a))
            for b in self.net.free[a]:
                self.back_free[b].append(a)
        self.most_sets = most_sets
        self.fresh = self.net.closure(self.begins, self.net.free)
        # words by which something begins; where a region of any words may begin a template, every word does
        first = {w for s in self.fresh for w, _ in self.net.steps[s]}
        self.first = np.zeros(len(self.words) + 1, bool)  # the last is any other word
        self.first[list(first - {-1})] = True
        if -1 in first:
            self.first[:] = True
        self._forget()

    def _forget(self) -> None:
        self.sets, self.number, self.rows, self.found = [], {}, [], []
        self._set(self.fresh)

    def _set(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.rows.append({})
            self.found.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.number[states]

    def _next(self, at: int, word: int) -> int:
        after = [b for s in self.sets[at] for w, b in self.net.steps[s] if w == word or w == -1]
        states = self.net.closure(after, self.net.free) | self.fresh
        if len(self.sets) >= self.most_sets:
            self._forget()
            return self._set(states)
        self.rows[at][word] = to = self._set(states)
        return to

    def ids(self, words: list[bytes]) -> np.ndarray:
        known, other = self.words, len(self.words)
        return np.fromiter((known.get(w, other) for w in words), np.int32, len(words))

    def accepted(self, ids: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(words read, templates that end there), where some do."""
        words, begins = memoryview(ids), memoryview(np.flatnonzero(self.first[ids]))
        at, i, n = 0, 0, len(ids)
        while i < n:
            if at == 0:  # nothing has begun: on to the next word by which something can
                k = bisect_left(begins, i)
                if k == len(begins):
                    return
                i = begins[k]
            word = words[i]
            to = self.rows[at].get(word)
            at = self._next(at, word) if to is None else to
            i += 1
            if self.found[at]:
                yield i, self.found[at]

    def start(self, ids: np.ndarray, end: int, template: int) -> int:
        """The first word of the longest run that ends before `end` and that the template accepts."""
        states, i, found = self.net.closure([self.goals[template]], self.back_free), end, end
        while states and i > 0:
            i -= 1
            word = int(ids[i])
            states = self.net.closure({a for s in states for w, a in self.back_steps[s] if w == word or w == -1}, self.back_free)
            if self.begins[template] in states:
                found = i
        return found

    def places(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, template) of each end of each template, with its first start."""
        return [(self.start(ids, end, t), end, t) for end, templates in self.accepted(ids) for t in templates]


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping places of one template the leftmost, and of these the longest; by start."""
    out, last = [], {}
    for a, z, t in sorted(places, key=lambda p: (p[0], -p[1], p[2])):
        if a >= last.get(t, 0):
            out.append((a, z, t))
            last[t] = z
    return out


# --- tables


def _ids(automaton: Automaton, text: bytes, at_once: int) -> np.ndarray:
    """A text's words as the automaton numbers them; a piece of the text at a time."""
    parts, at = [], 0
    while at < len(text):
        piece = text[at : at + at_once].translate(FOLD)
        if at + at_once < len(text):  # up to the end of a word; a longer word is taken whole
            cut = piece.rfind(b" ") + 1
            while not cut and len(piece) < len(text) - at:
                piece = text[at : at + 2 * len(piece)].translate(FOLD)
                cut = len(piece) if at + len(piece) >= len(text) else piece.rfind(b" ") + 1
            piece = piece[: cut or len(piece)]
        parts.append(automaton.ids(piece.split()))
        at += len(piece)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES, at_once: int = 1 << 20) -> DataFrame:
    """The licences of each row of (doc_id, text).

    doc_id, n_words; n_base, first_word, last_word and base_labels, of the phrases' places; labels, of phrases and
    templates; score; places: (label, start, end) of the templates, in words, ends exclusive. phrases: (label, words).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # phrases are templates without regions
        automaton, base = Automaton([*phrases, *notices]), len(phrases)
        for b in batches:
            out = []
            for text in b.column(1).cast(pa.large_binary()):
                ids = _ids(automaton, text.as_py() or b"", at_once)
                places = automaton.places(ids)
                mine = [p for p in places if p[2] < base]
                names = lambda some: ",".join(sorted({automaton.labels[p[2]] for p in some}))
                most = max((automaton.mandatory[p[2]] for p in places), default=0)
                starts = [p[0] for p in mine]
                wider = [{"label": automaton.labels[t], "start": a, "end": z} for a, z, t in apart([p for p in places if p[2] >= base])]
                out.append((len(ids), len(mine), min(starts, default=None), max(starts, default=None), names(mine), names(places), most / (most + 4), wider))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,end:long>>")

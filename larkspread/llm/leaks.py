"""Passages of held-out evaluation items inside training texts.

The items' normalised words form one generalised suffix automaton. A text's
words stream through it; at each word the automaton knows the longest stretch
ending there that occurs in some item. From the matched state the suffix links lead
down to the state of the last ``seed`` words, whose subtree of the link tree holds
every place in every item where these words end - also in items that share only a
part of what was matched. Hits that go on word by word are one seed. The seeds of one
item are chained in order (small shifts where words were changed, added or left out,
one interruption of the text of any length), a chain is extended word by word at its
ends and between its seeds, and the span of item words it accounts for is held
against the length and coverage limits. Every chain counts, from any seed to any later
one: poor matches before or after a passage do not hide it. What a passage used up is
taken out and the rest is searched again, so all disjoint passages come out, and an
item is found in a text whether or not others are looked for together with it.

Normalisation: letter case, punctuation, spacing, quote marks, line breaks,
tags in angle or square brackets, character entities, apostrophes and invisible
characters play no part; a word is a run of letters or digits.

Scale: texts are read once, in a narrow pass without any shuffle. Items are put into
groups of about ``group_chars`` characters; each group's automaton is built by one
task, packed into flat arrays whose size is linear in the group's words, and
broadcast; a worker unpacks it once. Texts meet the groups chunk by chunk, so several
groups cost no second reading. The driver handles one group's arrays at a time.

Defined cases
-------------
* Null, empty and blank texts, and texts of markup only: no finding.
* Items with a null or fewer words than the limit: never found.
* Repeated items (same words, other id): each is reported. Repeated texts: each.
* Items that share text: each is reported that reaches the limits by itself.
* An item that comes several times in a text: a row for every disjoint passage.
* Texts of any length are streamed whole. A group is never smaller than its longest item.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow, ship_package


@dataclass(frozen=True)
class LeakLimits:
    """Parameters; the defaults are the production ones."""

    words: int = 20  # consecutive item words that make a leak
    slack: int = 2  # of them, words at the ends that may be changed
    coverage: float = 0.8  # share of the span's words that must be there
    edited: float = 0.125  # share of the least number of words that may be changed or left out
    seed: int = 3  # least length of a seed
    trigger: int = 4  # least length of a chain's longest seed
    shift: int = 4  # words changed, added or left out between two seeds
    group_chars: int = 4_000_000

    @property
    def seeded(self) -> float:
        """Least number of words in a leak's seeds: outside of them fewer than ``seed``
        words agree in a row, so at the least coverage they are half of those in common."""
        return self.words * (1 - self.edited) * 0.5


_MARK = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|\[/?[a-zA-Z]+(?:=[^\[\]]*)?\]|&(?:[a-zA-Z]+|#\d+);")
_WORD = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")
_DROP = dict.fromkeys(map(ord, "'’ʼ"))
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _masked(text: str) -> str:
    return _MARK.sub(_blank, text) if "<" in text or "[" in text or "&" in text else text


def words_of(text: str) -> list[str]:
    """Normalised words: those of ``placed_words``, all at once."""
    masked = _masked(text)
    words = _WORD.findall(masked if masked.isascii() else _INVISIBLE.sub("", masked))
    if not words:
        return []
    joined = "\n".join(words).casefold()
    if joined.isascii():
        return (joined.replace("'", "") if "'" in joined else joined).split("\n")
    return [w if w.isascii() else unicodedata.normalize("NFKC", w) for w in joined.translate(_DROP).split("\n")]


def _norm(word: str) -> str:
    w = word.casefold().translate(_DROP)
    return w if w.isascii() else unicodedata.normalize("NFKC", w)


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their places in the text."""
    masked = _masked(text)
    if not _INVISIBLE.search(masked):
        return [(_norm(m.group()), m.start(), m.end()) for m in _WORD.finditer(masked)]
    kept = [i for i, c in enumerate(masked) if not _INVISIBLE.match(c)]
    seen = "".join(masked[i] for i in kept)
    return [(_norm(m.group()), kept[m.start()], kept[m.end() - 1] + 1) for m in _WORD.finditer(seen)]


class _Ends:
    """End places of every state as views: a state's places are those of its subtree."""

    def __init__(self, low: np.ndarray, high: np.ndarray, item: np.ndarray, at: np.ndarray):
        self.low, self.high, self.item, self.at = low, high, item, at

    def __getitem__(self, state: int) -> list[tuple[int, int]]:
        part = slice(self.low[state], self.high[state])
        return sorted(zip(self.item[part].tolist(), self.at[part].tolist()))


class _Growing:
    """The automaton while items are added: a dictionary a state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, state: int, length: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = new
        return new

    def extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            new = self._clone(known, self.length[last] + 1)
            p = last
            while p >= 0 and self.next[p].get(word) == known:
                self.next[p][word] = new
                p = self.link[p]
            return new
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._clone(q, self.length[p] + 1)
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = twin
                    p = self.link[p]
                self.link[new] = twin
        return new


class ItemAutomaton:
    """Generalised suffix automaton over the word sequences of all items, in flat
    arrays: most states have one way on, the few that branch keep a dictionary."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.number: dict[str, int] = {}
        number = self.number
        self.items = [(key, array("i", [number.setdefault(w, len(number)) for w in words])) for key, words in items]
        made = _Growing()
        state_of, item_of, at_of = array("i"), array("i"), array("i")
        for k, (_, words) in enumerate(self.items):
            last = 0
            for at, w in enumerate(words, 1):
                last = made.extend(last, w)
                state_of.append(last)
                item_of.append(k)
                at_of.append(at)
        n = len(made.link)
        self.link, self.length = array("i", made.link), array("i", made.length)
        self.word, self.to = array("i", [-1]) * n, array("i", [-1]) * n
        self.more: dict[int, dict[int, int]] = {}
        for s, ways in enumerate(made.next):
            if len(ways) == 1:
                self.word[s], self.to[s] = next(iter(ways.items()))
            elif ways:
                self.more[s] = ways
        self.ends = self._tour(np.asarray(state_of), np.asarray(item_of), np.asarray(at_of))

    def _tour(self, state_of: np.ndarray, item_of: np.ndarray, at_of: np.ndarray) -> _Ends:
        """Numbers the places along the link tree, so that a subtree's are adjacent."""
        link = np.asarray(self.link)
        n = len(link)
        by_length = np.argsort(np.asarray(self.length), kind="stable")
        own = np.bincount(state_of, minlength=n) if len(state_of) else np.zeros(n, np.int64)
        size = own.copy()
        for s in by_length[:0:-1].tolist():
            size[link[s]] += size[s]
        low, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
        free[0] = own[0]
        for s in by_length[1:].tolist():
            p = link[s]
            low[s] = free[p]
            free[p] += size[s]
            free[s] = low[s] + own[s]
        order = np.argsort(low[state_of], kind="stable") if len(state_of) else np.zeros(0, np.int64)
        return _Ends(low, low + size, item_of[order].astype(np.int32), at_of[order].astype(np.int32))

    def ids(self, words: Sequence[str]) -> list[int]:
        """Numbers of a text's words; -1 for one that no item has."""
        get = self.number.get
        return [get(w, -1) for w in words]

    def walk(self, ids: Sequence[int], least: int) -> list[tuple[int, int, int]]:
        """(end in the text, length, state) of the longest stretch that ends at each
        word, where it has at least ``least`` words."""
        out = []
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        state = n = 0
        for i, w in enumerate(ids, 1):
            if w < 0:
                state = n = 0
                continue
            while True:
                if word[state] == w:
                    state, n = to[state], n + 1
                    break
                ways = more.get(state)
                if ways is not None and w in ways:
                    state, n = ways[w], n + 1
                    break
                state = link[state]  # every known word leads on from the root
                n = length[state]
            if n >= least:
                out.append((i, n, state))
        return out

    def seeds(self, words: Sequence[str], least: int) -> list[tuple[int, int, int]]:
        """(end in the text, length, state) of every stretch of at least ``least``
        words that the next word does not lengthen."""
        steps = self.walk(self.ids(words), least)
        after = [*steps[1:], (0, 0, 0)]
        return [s for s, t in zip(steps, after) if t[0] != s[0] + 1 or t[1] <= s[1]]

    def hits(self, steps: list[tuple[int, int, int]], limits: LeakLimits) -> dict[int, list[tuple[int, int, int]]]:
        """Seeds (start in the text, start in the item, length) of every item that may
        reach the limits, in order; ``steps`` are those of ``walk``."""
        base = []
        length, link = self.length, self.link
        for _, _, s in steps:
            while length[link[s]] >= limits.seed:
                s = link[s]
            base.append(s)
        low, high = self.ends.low[base], self.ends.high[base]
        count = high - low
        end = np.repeat(np.array([i for i, _, _ in steps]), count)
        place = np.arange(count.sum()) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
        item, at = self.ends.item[place].astype(np.int64), self.ends.at[place].astype(np.int64)
        often = np.bincount(item, minlength=1)
        kept = np.flatnonzero(often[item] >= 3)
        item, at, end = item[kept], at[kept], end[kept]
        order = np.lexsort((end, at - end, item))
        item, at, end = item[order], at[order], end[order]
        if not len(item):
            return {}
        new = np.r_[True, (item[1:] != item[:-1]) | (at[1:] - end[1:] != at[:-1] - end[:-1]) | (end[1:] != end[:-1] + 1)]
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(item)]) + limits.seed - 1
        of, t, i = item[first], end[first] - limits.seed, at[first] - limits.seed
        words, most = np.bincount(of, weights=n), np.zeros(of.max() + 1)
        np.maximum.at(most, of, n)
        good = np.flatnonzero((words[of] >= limits.seeded) & (most[of] >= limits.trigger))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for x in good[np.lexsort((n[good], t[good], of[good]))].tolist():
            out.setdefault(int(of[x]), []).append((int(t[x]), int(i[x]), int(n[x])))
        return out


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def _reach(item: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """How far a chain reaches on into item and text, both starting at its end:
    (item words, text words, words in common) at its end and after every further
    word that agrees, stopping where words stop agreeing."""
    i = j = 0
    out = [(0, 0, 0)]
    common = misses = 0
    while i < len(item) and j < len(text) and misses <= 3:
        if item[i] == text[j]:
            i, j, common = i + 1, j + 1, common + 1
            out.append((i, j, common))
            misses = max(0, misses - 0.5)
            continue
        misses += 1
        step = min(
            ((di + dj, di, dj) for di in range(3) for dj in range(3) if di + dj and i + di + 1 < len(item) and j + dj + 1 < len(text) and item[i + di] == text[j + dj] and item[i + di + 1] == text[j + dj + 1]),
            default=None,
        )
        if step is None:
            break
        i, j = i + step[1], j + step[2]
    return out


@dataclass(frozen=True)
class Passage:
    """An item's span found in a text: item words, text words, words in common and
    the text words of the interruption (none: -1)."""

    item: int
    item_from: int
    item_to: int
    text_from: int
    text_to: int
    common: int
    cut_from: int = -1
    cut_to: int = -1

    def pieces(self) -> list[tuple[int, int]]:
        """Text words of the passage without its interruption."""
        if self.cut_to - self.cut_from <= _NEAR:
            return [(self.text_from, self.text_to)]
        return [(self.text_from, self.cut_from), (self.cut_to, self.text_to)]


#: Words between two seeds up to which all are compared, and at each end beyond.
_NEAR, _EDGE = 24, 8
_GONE = -2  # a text word that a passage has used up


def _between(item: Sequence[int], words: list[int], i_end: int, i: int, t_end: int, t: int) -> int:
    """Words in common between two seeds. At most ``shift`` item words lie in a long
    interruption, so those in common stand near its two ends."""
    if i <= i_end or t <= t_end:
        return 0
    return _common(item[i_end:i], words[t_end:t] if t - t_end <= _NEAR else words[t_end : t_end + _EDGE] + words[t - _EDGE : t])


def _sweep(k: int, item: Sequence[int], words: list[int], found: list[tuple[int, int, int]], limits: LeakLimits) -> list[Passage]:
    """For every last seed the best chain without and the best with an interruption,
    among all chains of the item's seeds from any seed to any later one: one that is
    a leak if there is any, of these one with most words in common.

    A chain's span is given by the item words it starts and ends at, so the most words
    in common for every (start, last seed, interruption used) settle every chain.
    Chains more than ``_NEAR`` words back can only be met over the interruption. Of
    these the best for every (end, words agreeing after it, last seed, start) in the
    item are kept, so a long text costs no pairs of distant seeds.
    """
    out = []
    # start in the item -> (words in common, start in the text, interruption), with the interruption unused (0) and used (1)
    Kept = dict[int, tuple[int, int, int, int]]
    chains: list[tuple[Kept, Kept]] = []
    near_t = max(_NEAR, 4 * limits.shift)
    # (end in the item, words compared after it) -> (start of the last seed, start) -> (words in common, start in the text, interruption's start)
    distant: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int, int]]] = {}
    passed = 0
    for x, (t, i, n) in enumerate(found):
        while passed < x and found[passed][0] + found[passed][2] < t - near_t:
            t2, i2, n2 = found[passed]
            t_end, i_end = t2 + n2, i2 + n2
            for k_after in range(limits.shift + 1):
                agree = _common(item[i_end : i_end + k_after], words[t_end : t_end + _EDGE])
                into = distant.setdefault((i_end, k_after), {})
                for start, (common, t_from, _, _) in chains[passed][0].items():
                    into[i2, start] = max(into.get((i2, start), (-1, -1, -1)), (common + agree, t_from, t_end + k_after))
            passed += 1
        mine: tuple[Kept, Kept] = ({}, {})
        for di, dt, dc in _reach(item[:i][::-1], words[max(0, t - len(item)) : t][::-1]):
            mine[0][i - di] = (n + dc, t - dt, -1, -1)
        for y in range(x - 1, passed - 1, -1):
            t2, i2, n2 = found[y]
            gap_i = max(0, i - i2 - n2)
            over = max(0, t2 + n2 - t, i2 + n2 - i)
            if over >= n or t2 >= t or i2 >= i:
                continue
            near = abs((t - i) - (t2 - i2)) <= limits.shift and gap_i <= 3 * limits.shift
            jump = not near and gap_i <= limits.shift
            if not near and not jump:
                continue
            more = n - over + _between(item, words, i2 + n2, i, t2 + n2, t)
            for used in (0, 1) if near else (0,):
                into = mine[used if near else 1]
                for start, (common, t_from, cut_from, cut_to) in chains[y][used].items():
                    kept = (common + more, t_from, *((cut_from, cut_to) if near else (t2 + n2, t)))
                    if start not in into or kept[:2] > into[start][:2]:
                        into[start] = kept
        for i_end in range(i - limits.shift, i + n):
            for k_after in range(max(0, i - i_end) + 1):
                if not (kept := distant.get((i_end, k_after))):
                    continue
                more = n - max(0, i_end - i) + _common(item[i_end + k_after : i], words[t - _EDGE : t])
                for (i2, start), (common, t_from, cut_from) in kept.items():
                    if i2 < i:
                        mine[1][start] = max(mine[1].get(start, (-1, -1, -1, -1)), (common + more, t_from, cut_from, t - max(0, i - i_end - k_after)))
        chains.append(mine)
        ahead = _reach(item[i + n :], words[t + n : t + n + len(item)])
        for starts in mine:
            top = None
            for start, (common, t_from, cut_from, cut_to) in starts.items():
                for di, dt, dc in ahead:
                    rank = (_leaks(i + n + di - start, common + dc, limits), common + dc, t_from - dt)
                    if top is None or rank > top[0]:
                        top = rank, (k, start, i + n + di, t_from, t + n + dt, common + dc, cut_from, cut_to)
            if top:
                out.append(Passage(*top[1]))
    return out


def _most_seeded(found: list[tuple[int, int, int]], limits: LeakLimits) -> int:
    """The most words that the seeds of any chain have, by the rules of ``_sweep``."""
    near_t = max(_NEAR, 4 * limits.shift)
    whole: list[int] = []  # without, with an interruption
    broken: list[int] = []
    before: dict[int, int] = {}  # end in the item -> most words of a distant chain
    passed = most = 0
    for x, (t, i, n) in enumerate(found):
        while found[passed][0] + found[passed][2] < t - near_t:
            t2, i2, n2 = found[passed]
            before[i2 + n2] = max(before.get(i2 + n2, 0), whole[passed])
            passed += 1
        a, b = n, 0
        for y in range(passed, x):
            t2, i2, n2 = found[y]
            over = max(0, t2 + n2 - t, i2 + n2 - i)
            if over >= n or t2 >= t or i2 >= i:
                continue
            if abs((t - i) - (t2 - i2)) <= limits.shift and i - i2 - n2 <= 3 * limits.shift:
                a, b = max(a, whole[y] + n - over), max(b, broken[y] + n - over if broken[y] else 0)
            elif i - i2 - n2 <= limits.shift:
                b = max(b, whole[y] + n - over)
        if before:
            for end in range(i - limits.shift, i + n):
                if end in before:
                    b = max(b, before[end] + n - max(0, end - i))
        whole.append(a)
        broken.append(b)
        most = max(most, a, b)
    return most


def _rank(p: Passage, limits: LeakLimits) -> tuple:
    """Leaks first, then more words in common, no interruption, less text."""
    return is_leak(p, limits), p.common, p.cut_from < 0, p.text_from - p.text_to


def _passages_of(k: int, item: Sequence[int], words: list[int], found: list[tuple[int, int, int]], limits: LeakLimits) -> list[Passage]:
    """All disjoint passages of one item that are leaks, or else its best one."""
    out: list[Passage] = []
    while found and _most_seeded(found, limits) >= limits.seeded:
        options = sorted(_sweep(k, item, words, found, limits), key=lambda p: _rank(p, limits), reverse=True)
        if not is_leak(options[0], limits):
            return out or options[:1]
        used: list[tuple[int, int]] = []
        for p in options:
            if not is_leak(p, limits):
                break
            parts = p.pieces()
            at = [bisect_left(used, (b, -1)) for _, b in parts]
            if all(x == 0 or used[x - 1][1] <= a for x, (a, _) in zip(at, parts)):
                out.append(p)
                for part in parts:
                    insort(used, part)
        words = list(words)
        for a, b in used:
            words[a:b] = [_GONE] * (b - a)
        rest = []
        for t, i, n in found:
            j = 0
            while j < n:
                m = j
                while m < n and words[t + m] != _GONE:
                    m += 1
                if m - j >= limits.seed:
                    rest.append((t + j, i + j, m - j))
                j = m + 1
        found = sorted(rest)
    return out


def passages(automaton: ItemAutomaton, words: Sequence[str], limits: LeakLimits) -> list[Passage]:
    """The passages of every item that the text's seeds point at: all that are leaks,
    or else the best one."""
    ids = automaton.ids(words)
    steps = automaton.walk(ids, limits.seed)
    if not steps or max(n for _, n, _ in steps) < limits.trigger:
        return []
    return [p for k, found in automaton.hits(steps, limits).items() for p in _passages_of(k, automaton.items[k][1], ids, found, limits)]


def _leaks(span: int, common: int, limits: LeakLimits) -> bool:
    return span >= limits.words - limits.slack and common >= limits.coverage * span and common >= limits.words * (1 - limits.edited)


def is_leak(p: Passage, limits: LeakLimits) -> bool:
    return _leaks(p.item_to - p.item_from, p.common, limits)


def _packed_groups(items: DataFrame, key: str, text: str, limits: LeakLimits) -> Iterator[bytes]:
    """The automaton of every group of items; a null text is no item."""
    spark = items.sparkSession
    kept = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    kept = materialize(kept, "items")
    n = (kept.agg(F.sum(F.length("t"))).first()[0] or 0) // limits.group_chars + 1
    ship_package(spark)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("k").to_pylist(), table.column("t").to_pylist()))
        made = pickle.dumps(ItemAutomaton([(k, words_of(t)) for k, t in rows]), 5)
        return pa.table({"g": table.column("g").slice(0, 1), "made": pa.array([made], pa.binary())})

    grouped = kept.withColumn("g", F.pmod(F.xxhash64("k", "t"), F.lit(n)).cast("bigint"))
    built = materialize(grouped.groupBy("g").applyInArrow(build, "g bigint, made binary"), "automata")
    for row in built.select("made").toLocalIterator():
        yield bytes(row[0])


_loaded: dict[str, ItemAutomaton] = {}
_CHUNK_CHARS = 4_000_000  # characters of text that are read between two changes of the group


def _automaton(name: str, packed) -> ItemAutomaton:
    """A group's automaton, unpacked once a worker; the worker holds one at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pickle.loads(packed.value)
    return _loaded[name]


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "question", limits: LeakLimits = LeakLimits()
) -> DataFrame:
    """(key, item_key, passage, piece, item_words, common_words, char_from, char_to):
    every passage of every item in every text. An item's passages in a text are
    numbered from 0; an interrupted one has two pieces, 0 and 1, with a row each."""
    schema = T.StructType(
        [T.StructField(key, documents.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("passage", "piece", "item_words", "common_words", "char_from", "char_to")]
    )
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).where("__text IS NOT NULL")
    context = documents.sparkSession.sparkContext
    groups = [(uuid.uuid4().hex, context.broadcast(made)) for made in _packed_groups(items, item_key, item_text, limits)]

    def rows_of(automaton: ItemAutomaton, k: object, t: str, words: list[str]) -> list[tuple]:
        out, placed, seen = [], None, {}
        for p in passages(automaton, words, limits):
            if not is_leak(p, limits):
                continue
            placed = placed or placed_words(t)
            number = seen[p.item] = seen.get(p.item, -1) + 1
            for piece, (a, b) in enumerate(p.pieces()):
                out.append((k, automaton.items[p.item][0], number, piece, p.item_to - p.item_from, p.common, placed[a][1], placed[b - 1][2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)

        def found(held: list[tuple[object, str, list[str]]]) -> pa.RecordBatch:
            out = []
            for name, packed in groups:
                automaton = _automaton(name, packed)
                for k, t, words in held:
                    out += rows_of(automaton, k, t, words)
            columns = list(zip(*out)) if out else [[]] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

        held, size = [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((k, t, words_of(t)))
                size += len(t)
                if size >= _CHUNK_CHARS or len(groups) == 1 and size >= 100_000:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)

    return map_arrow(rows, run, schema) if groups else documents.sparkSession.createDataFrame([], schema)


def strip_leaks(documents: DataFrame, leaks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the leaked pieces cut out, all of them; texts without any stay
    as they are. A text's pieces are no more than its words, so they fit a row."""
    spans = leaks.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("char_from", "char_to"))).alias("__spans"))
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).join(spans, key, "left")
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["kept"], F.substr("__text", a["at"] + 1, F.greatest(s["char_from"] - a["at"], F.lit(0)))).alias("kept"),
            F.greatest(a["at"], s["char_to"]).alias("at"),
        ),
    )
    return rows.select(key, F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(F.concat(cut["kept"], F.substr("__text", cut["at"] + 1))).alias("text"))

"""Compact tries over sorted words, and their words at distance one from a given word."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np


class Trie(NamedTuple):
    """Nodes in depth-first order; unary paths are one edge, whose text is a piece of ``text``.

    The path to node ``k`` is ``text[start[k] : start[k] + depth[k]]``. Its first child is ``k + 1``, each further one stands
    where the subtree before it ends, at ``skip``, and the last subtree ends at ``skip[k]``. ``n`` is 0 where no word ends.
    ``kids`` has the children of the nodes that searches have come to, by their first character.
    """

    text: str
    start: Sequence[int]
    depth: Sequence[int]
    skip: Sequence[int]
    n: Sequence[int]
    kids: dict[int, dict[str, int]]


def build(words: list[str], counts: list[int]) -> Trie:
    """The trie of distinct ``words`` in ascending order, none empty, with counts above 0."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1].tolist() if words else []
    start, depth, n, parent = [], [], [], []
    stack = [(0, len(words), -1)] if words else []
    while stack:
        low, high, above = stack.pop()
        first, last = words[low], words[high - 1]
        d = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        k = len(start)
        ends = len(first) == d
        start.append(starts[low])
        depth.append(d)
        n.append(counts[low] if ends else 0)
        parent.append(above)
        below = [[i for i, _ in g] for _, g in groupby(enumerate(words[low + ends : high], low + ends), lambda x: x[1][d])]
        stack.extend((g[0], g[-1] + 1, k) for g in reversed(below))
    size = [1] * len(start)
    for k in range(len(start) - 1, 0, -1):
        size[parent[k]] += size[k]
    return Trie("".join(words), start, depth, [k + s for k, s in enumerate(size)], n, {})


def word_at(trie: Trie, k: int) -> str:
    return trie.text[trie.start[k] : trie.start[k] + trie.depth[k]]


def _children(trie: Trie, k: int) -> dict[str, int]:
    found, child, low = {}, k + 1, trie.depth[k]
    while child < trie.skip[k]:
        found[trie.text[trie.start[child] + low]] = child
        child = trie.skip[child]
    trie.kids[k] = found
    return found


def _exact(trie: Trie, k: int, above: int, word: str) -> int:
    """The node where ``word`` ends, on the way that the edge to ``k`` begins at depth ``above``; else -1. What ``word`` has before
    ``above`` is not looked at."""
    text, start, depth, _, n, kids = trie
    end = len(word)
    while True:
        low = depth[k]
        if low > end or not word.startswith(text[start[k] + above : start[k] + low], above):
            return -1
        if low == end:
            return k if n[k] else -1
        below = kids.get(k)
        if below is None:
            below = _children(trie, k)
        k, above = below.get(word[low], -1), low
        if k < 0:
            return -1


def neighbours(trie: Trie, word: str, half: bool = False) -> list[int]:
    """The nodes of all words that differ from ``word`` by exactly one inserted, deleted or replaced character, each once.

    With ``half``, only those with a character deleted, or replaced by a larger one: of two words at distance one, exactly one
    finds the other so.

    This is the Levenshtein automaton of distance one, run depth-first. Its state without an error follows ``word`` down
    the trie. Where a path first leaves the word the error has been made: in its place a character was replaced, inserted
    or deleted, and each of these three states has one way to go on, which is to match the rest exactly.
    """
    found: list[int] = []
    if not len(trie.start):
        return found
    text, start, depth, _, n, kids = trie
    end = len(word)

    def rest(k: int, at: int, goal: str) -> None:
        """The word below or on the edge to ``k`` that goes on as ``goal`` does from ``at``, of which the edge has a part before."""
        low = depth[k]
        if low > at:
            if at == len(goal) or text[start[k] + at] != goal[at]:
                return
        elif at == len(goal):
            if n[k]:
                found.append(k)
            return
        else:
            below = kids.get(k)
            if below is None:
                below = _children(trie, k)
            k = below.get(goal[at], -1)
            if k < 0:
                return
        if (x := _exact(trie, k, at, goal)) >= 0:
            found.append(x)

    def off(others: Iterable[tuple[str, int]], at: int) -> None:
        """Words that agree with ``word`` up to ``at``, where the edges to ``others`` have another character."""
        on, then = word[at : at + 1], word[at + 1 : at + 2]
        longer = "" if half else f"{word[:at]} {word[at:]}"
        for c, k in others:
            if c == on:
                continue
            if on and (c > on or not half):
                rest(k, at + 1, word)  # replaced
            if not half:
                rest(k, at + 1, longer)  # inserted
            if c == then and (x := _exact(trie, k, at, word[:at] + word[at + 1 :])) >= 0:
                found.append(x)  # deleted

    k, above = 0, 0
    while True:
        low = depth[k]
        edge = text[start[k] + above : start[k] + low]
        if not word.startswith(edge, above):
            at = next((i for i, (a, b) in enumerate(zip(edge, word[above:])) if a != b), min(len(edge), end - above))
            off([(edge[at], k)], above + at)
            return found
        if low == end - 1 and n[k]:
            found.append(k)  # the last character deleted
        below = kids.get(k)
        if below is None:
            below = _children(trie, k)
        off(below.items(), low)
        above, k = low, below.get(word[low : low + 1], -1)
        if k < 0:
            return found

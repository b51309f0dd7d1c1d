"""Regular expressions to one minimal deterministic automaton over bytes.

A small subset is compiled: literals, escapes, classes, groups, ``|`` and the
greedy quantifiers.  A searching automaton accepts at every byte where a match
of a rule ends, and its accepting states carry a bit for each rule.  Compiled
backwards and run over the reversed text it accepts where matches start.  An
anchored one gives the longest match at a place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

RESET = 10  # a byte that no rule may read: it separates texts in a buffer
Tree = tuple


def _parse(pattern: str, fold: bool) -> Tree:
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escape() -> int:
        nonlocal at
        c = take()
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(c)

    def folded(chars: set[int]) -> frozenset[int]:
        if fold:
            chars |= {c ^ 32 for c in chars if chr(c).isalpha() and c < 128}
        return frozenset(chars)

    def charset() -> Tree:
        nonlocal at
        chars: set[int] = set()
        while peek() != "]":
            c = take()
            low = escape() if c == "\\" else ord(c)
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                c = take()
                chars |= set(range(low, (escape() if c == "\\" else ord(c)) + 1))
            else:
                chars.add(low)
        at += 1
        return ("set", folded(chars))

    def atom() -> Tree:
        nonlocal at
        c = take()
        if c == "(":
            if pattern.startswith("?:", at):
                at += 2
            inner = choice()
            at += 1
            return inner
        if c == "[":
            return charset()
        return ("set", folded({escape() if c == "\\" else ord(c)}))

    def counted(inner: Tree) -> Tree:
        nonlocal at
        c = peek()
        if c and c in "?*+":
            at += 1
            return ("repeat", inner, 1 if c == "+" else 0, 1 if c == "?" else None)
        if c == "{":
            end = pattern.index("}", at)
            low, comma, high = pattern[at + 1 : end].partition(",")
            at = end + 1
            return ("repeat", inner, int(low), (int(high) if high else None) if comma else int(low))
        return inner

    def sequence() -> Tree:
        items = []
        while peek() and peek() not in "|)":
            items.append(counted(atom()))
        return ("all", items)

    def choice() -> Tree:
        options = [sequence()]
        while peek() == "|":
            take()
            options.append(sequence())
        return ("any", options)

    return choice()


def _mirrored(tree: Tree) -> Tree:
    """The tree of what ``tree`` matches, read from the end."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "repeat":
        return (kind, _mirrored(tree[1]), *tree[2:])
    return (kind, [_mirrored(t) for t in (reversed(tree[1]) if kind == "all" else tree[1])])


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.reads: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.reads.append(None)
        return len(self.empty) - 1

    def add(self, tree: Tree, start: int) -> int:
        """States for ``tree`` from ``start``; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.empty[start].append(middle)
            self.reads[middle] = (tree[1], end)
            return end
        if kind == "all":
            for item in tree[1]:
                start = self.add(item, start)
            return start
        end = self.state()
        if kind == "any":
            for option in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(option, first)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """``step[state * classes + class_of[byte]]`` is the next state times
    ``classes``; ``accepts`` is indexed by such a product."""

    classes: int
    class_of: bytes
    step: np.ndarray
    accepts: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step) // self.classes

    def scan(self, text: bytes, lanes: int = 4096, segment: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ends of matches (index of their last byte) and the bits of their rules."""
        parts = list(self.segments(text, lanes, segment))
        ends, bits = zip(*parts) if parts else ((np.zeros(0, np.int64),), (np.zeros(0, np.uint32),))
        return np.concatenate(ends), np.concatenate(bits)

    def segments(self, text: bytes, lanes: int = 4096, segment: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``scan`` a segment at a time: the state is carried from one to the next, and memory
        beyond the text is some 80 bytes for each byte of a segment at most."""
        state = 0
        for at in range(0, len(text), segment):
            e, b, state = self._segment(text[at : at + segment], lanes, state)
            yield e + at, b

    def _segment(self, text: bytes, lanes: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The text is cut into lanes that step together; a lane that began in
        another state than the one before it ended in is walked again until
        it falls into step, so the result is that of one pass."""
        width = max(64, -(-len(text) // lanes))
        lanes = -(-len(text) // width)
        read = np.frombuffer(text.ljust(width * lanes, bytes([RESET])).translate(self.class_of), np.uint8)
        read = np.ascontiguousarray(read.reshape(lanes, width).T)
        path = np.empty((width, lanes), np.int32)
        began = np.zeros(lanes, np.int32)
        began[0] = first
        state = began
        for t in range(width):
            np.take(self.step, state + read[t], out=path[t])
            state = path[t]
        while True:
            wanted = np.concatenate([[first], path[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(wanted != began)
            if not len(wrong):
                break
            began[wrong] = state = wanted[wrong]
            for t in range(width):
                state = self.step[state + read[t, wrong]]
                off = state != path[t, wrong]
                if not off.any():
                    break
                wrong, state = wrong[off], state[off]
                path[t, wrong] = state
        bits = self.accepts[path]
        t, lane = np.nonzero(bits)
        ends = lane * width + t
        order = np.argsort(ends, kind="stable")
        last = len(text) - 1
        return ends[order], bits[t, lane][order], int(path[last % width, last // width])

    def longest(self, text: bytes, at: int) -> int:
        """Of an anchored automaton: the end of the longest match that starts
        at ``at``, or -1."""
        step, accepts, class_of = self._lists
        state, end = 0, -1
        for i in range(at, len(text)):
            state = step[state + class_of[text[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                end = i + 1
        return end

    @cached_property
    def _lists(self) -> tuple[list[int], list[int], bytes]:
        return self.step.tolist(), self.accepts.tolist(), self.class_of

    @cached_property
    def dead(self) -> int:
        """The state that nothing leads out of and that accepts nothing, or -1."""
        table = self.step.reshape(-1, self.classes)
        own = np.arange(len(table)) * self.classes
        stuck = np.flatnonzero((table == own[:, None]).all(axis=1) & (self.accepts[own] == 0))
        return int(own[stuck[0]]) if len(stuck) else -1


def compile_rules(rules: list[tuple[str, bool]], backwards: bool = False, anchored: bool = False) -> Automaton:
    """One automaton for ``(pattern, ignore ASCII case)`` rules, bit i for rule i."""
    nfa = _Nfa()
    root = nfa.state()
    final = {}
    for i, (pattern, fold) in enumerate(rules):
        tree = _parse(pattern, fold)
        final[nfa.add(_mirrored(tree) if backwards else tree, root)] = 1 << i
    if any(r and RESET in r[0] for r in nfa.reads):
        raise ValueError("no rule may read a line feed")
    # Bytes that no set tells apart share a class.
    kinds: dict[tuple, int] = {}
    sets = list(dict.fromkeys(r[0] for r in nfa.reads if r))
    class_of = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [class_of.index(k) for k in range(len(kinds))]

    def closed(state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for n in nfa.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(s for s in seen if nfa.reads[s] or s in final)

    # What a state leads to, by the class that it reads.
    leads = [{k: closed(r[1]) for k, b in enumerate(sample) if b in r[0]} if r else {} for r in nfa.reads]
    start = closed(root)
    number, queue, table, bits = {start: 0}, [start], [], []
    for subset in queue:  # grows while it is walked
        bits.append(sum({final[s] for s in subset if s in final}))
        targets = [set() if anchored else set(start) for _ in sample]
        for s in subset:
            for k, more in leads[s].items():
                targets[k] |= more
        row = []
        for target in map(frozenset, targets):
            if target not in number:
                number[target] = len(queue)
                queue.append(target)
            row.append(number[target])
        table.append(row)
    step, marks = np.array(table), np.array(bits, np.uint32)
    # Minimise: split classes of states until successors agree.
    _, group = np.unique(marks, return_inverse=True)
    while True:
        _, first, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == len(np.unique(group)):
            break
        group = finer
    _, first = np.unique(group, return_index=True)
    rename = np.empty(len(first), np.int64)
    order = np.argsort(first)  # the start state stays number 0
    rename[order] = np.arange(len(first))
    small = rename[group[step[first[order]]]]
    width = len(sample)
    accepts = np.zeros(len(first) * width, np.uint32)
    accepts[::width] = marks[first[order]]
    return Automaton(width, class_of, (small * width).astype(np.int32).ravel(), accepts)

"""A minimal acyclic transducer: words in, id sequences out, in one file that workers map into memory.

States with the same ending are one state, so words share suffixes as well as prefixes. Each arc carries a number:
how many words of its state come before those through the arc. The numbers along a word's path add up to the
word's place in sorted order, which is where its ids are found.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

_FIELDS = (("keys", "<i8"), ("targets", "<i4"), ("numbers", "<i4"), ("final", "<i4"), ("offsets", "<i4"), ("ids", "<i4"))


def _automaton(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """The states of the minimal automaton of sorted distinct words; the last one is the start."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}
    open_arcs: list[list[tuple[int, int]]] = [[]]  # of the states along the last word that may still grow
    open_final = [False]
    last = b""

    def close(down_to: int) -> None:
        while len(open_arcs) > down_to + 1:
            state = (open_final.pop(), tuple(open_arcs.pop()))
            if (number := known.get(state)) is None:
                number = known[state] = len(states)
                states.append(state)
            open_arcs[-1].append((last[len(open_arcs) - 1], number))

    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        close(same)
        for _ in range(len(word) - same):
            open_arcs.append([])
            open_final.append(False)
        open_final[-1] = True
        last = word
    close(0)
    states.append((open_final[0], tuple(open_arcs[0])))
    return states


def compile_lexicon(entries: dict[bytes, list[int]], path: str | Path) -> None:
    words = sorted(entries)
    states = _automaton(words)
    below = np.zeros(len(states), np.int64)  # words from a state on; arcs only go to earlier states
    keys, targets, numbers = [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, target in arcs:
            keys.append(s << 8 | byte)
            targets.append(target)
            numbers.append(n)
            n += int(below[target])
        below[s] = n
    ids = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    found = {"keys": keys, "targets": targets, "numbers": numbers, "final": [f for f, _ in states], "offsets": offsets, "ids": [i for x in ids for i in x]}
    arrays = [np.asarray(found[name], kind) for name, kind in _FIELDS]
    with Path(path).open("wb") as out:
        np.array([len(a) for a in arrays], "<i8").tofile(out)
        for a in arrays:
            a.tofile(out)


class Lexicon:
    """A compiled file, mapped into memory: pages are read when they are needed and shared by the workers of a machine."""

    def __init__(self, path: str | Path) -> None:
        raw = np.memmap(path, np.uint8, "r")
        at = 8 * len(_FIELDS)
        for (name, kind), size in zip(_FIELDS, np.frombuffer(raw[:at], "<i8").tolist(), strict=True):
            width = size * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + width].view(kind))
            at += width
        self.start = len(self.final) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1: all words take a step through the automaton at a time."""
        places = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return places
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.arange(len(words))
        state, total = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                hit = ended & (self.final[state] != 0)
                places[live[hit]] = total[hit]
                live, state, total = live[~ended], state[~ended], total[~ended]
                if not len(live):
                    break
            key = state << 8 | text[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[arc] == key
            live, arc = live[goes], arc[goes]
            state, total = self.targets[arc].astype(np.int64), total[goes] + self.numbers[arc]
            step += 1
        return places

    def output(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place] : self.offsets[place + 1]]

"""Finite automata run over many chunks of bytes at once.

A chunk is described by what it does to every start state: the state it ends in and how
often it emits on the way. Such functions compose, and composition is associative, so
chunks (and blocks inside a chunk) are scanned without knowing where they begin; the state
they are entered in is resolved afterwards, and the place of any emission is found from the counts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Events of a block; a scan takes as many steps, each over all blocks of a slice.
BLOCK = 64


class Automaton(NamedTuple):
    """Symbols of bytes, next state and emissions by (state, symbol).

    Symbol 0 has to be idempotent and to emit nothing when it comes again: runs of it are one event.
    The last symbol stands for nothing at all.
    """

    symbols: np.ndarray
    table: np.ndarray
    emits: np.ndarray


class Functions(NamedTuple):
    """End state and emissions of some chunks for every start state."""

    ends: np.ndarray
    counts: np.ndarray

    def then(self, other: Functions) -> Functions:
        """These chunks, each followed by the other one."""
        rows = np.arange(len(self.ends))[:, None]
        return Functions(other.ends[rows, self.ends], self.counts + other.counts[rows, self.ends])


class Scan(NamedTuple):
    """Events of some chunks, in blocks, and the function from a chunk's begin to each block's end."""

    automaton: Automaton
    positions: np.ndarray
    starts: np.ndarray
    first_event: np.ndarray
    first_block: np.ndarray
    block_event: np.ndarray
    symbols: np.ndarray
    upto: Functions


def scan(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> Scan:
    """All chunks ``data[offsets[i]:offsets[i+1]]``."""
    codes = automaton.symbols[data]
    event = codes != 0
    if len(codes):
        event[1:] |= codes[:-1] != 0
        event[offsets[:-1][offsets[:-1] < len(codes)]] = True
    positions = np.flatnonzero(event)
    first_event = np.searchsorted(positions, offsets)
    blocks = -(-np.diff(first_event) // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    nth = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    block_event = np.repeat(first_event[:-1], blocks) + nth * BLOCK
    nothing = automaton.table.shape[1] - 1
    at = block_event[:, None] + np.arange(BLOCK)
    inside = at < np.repeat(first_event[1:], blocks)[:, None]
    of_event = np.append(codes[positions], nothing)
    symbols = np.where(inside, of_event[np.minimum(at, len(positions))], nothing)

    states = automaton.table.shape[0]
    ends = np.broadcast_to(np.arange(states), (len(nth), states)).copy()
    counts = np.zeros_like(ends)
    for step in range(BLOCK):
        now = symbols[:, step, None]
        counts += automaton.emits[ends, now]
        ends = automaton.table[ends, now]
    upto = Functions(ends, counts)
    span = 1
    while span <= nth.max(initial=0):
        late = np.flatnonzero(nth >= span)
        before = Functions(upto.ends[late - span], upto.counts[late - span])
        both = before.then(Functions(upto.ends[late], upto.counts[late]))
        upto = Functions(upto.ends.copy(), upto.counts.copy())
        upto.ends[late], upto.counts[late] = both
        span *= 2
    return Scan(automaton, positions, offsets[:-1], first_event, first_block, block_event, symbols, upto)


def functions(s: Scan) -> Functions:
    """The function of each chunk; a chunk of nothing changes nothing."""
    states = s.automaton.table.shape[0]
    n = len(s.first_block) - 1
    ends, counts = np.broadcast_to(np.arange(states), (n, states)).copy(), np.zeros((n, states), np.int64)
    some = np.flatnonzero(np.diff(s.first_block))
    last = s.first_block[some + 1] - 1
    ends[some], counts[some] = s.upto.ends[last], s.upto.counts[last]
    return Functions(ends, counts)


def compose(parts: Functions, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """State each of a row of chunks is entered in and emissions before it; one more of both for the end."""
    states, before = [entry], [0]
    for ends, counts in zip(parts.ends, parts.counts):
        before.append(before[-1] + int(counts[states[-1]]))
        states.append(int(ends[states[-1]]))
    return np.array(states), np.array(before)


def select(s: Scan, chunk: np.ndarray, entry: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Byte of a chunk at which it emits for the kth time (from 1) when entered in a state."""
    lo, hi = s.first_block[chunk], s.first_block[chunk + 1] - 1
    while (lo < hi).any():
        middle = (lo + hi) // 2
        enough = s.upto.counts[middle, entry] >= kth
        lo, hi = np.where(enough, lo, np.minimum(middle + 1, hi)), np.where(enough, middle, hi)
    inner = lo > s.first_block[chunk]
    before = np.maximum(lo - 1, 0)
    state = np.where(inner, s.upto.ends[before, entry], entry)
    left = kth - np.where(inner, s.upto.counts[before, entry], 0)
    found = np.zeros(len(chunk), np.int64)
    for step in range(BLOCK):
        now = s.symbols[lo, step]
        left = left - s.automaton.emits[state, now]
        found = np.where((left <= 0) & (found == 0), step + 1, found)
        state = s.automaton.table[state, now]
    return s.positions[s.block_event[lo] + found - 1] - s.starts[chunk]

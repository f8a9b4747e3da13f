"""Runs of consecutive windows that share a minimiser, over any symbols.

A window of ``size`` symbols has as minimiser the smallest hash among its runs of ``gram``
symbols, which depends on the window alone: equal windows have equal minimisers wherever
they are. Consecutive windows of one minimiser form a super-k-mer of ``count`` windows that
spans ``count + size - 1`` symbols; longer runs than a minimiser can stay in sight are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliospark.llm.common import inside, mixed, rolling, sliding_min

_BASE = 0xD6E8FEB86659FD93


@dataclass
class SuperKmers:
    """Arrays of one entry for each super-k-mer; ``doc`` counts from 0, ``start`` in the document."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    minimiser: np.ndarray
    content: np.ndarray


def _span_hashes(symbols: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of symbols[first:last] for each pair, from prefix sums (wraps around)."""
    n = len(symbols)
    one = np.ones(1, np.uint64)
    powers = np.cumprod(np.concatenate((one, np.full(n, base, np.uint64))))
    inverse = np.cumprod(np.concatenate((one, np.full(n, pow(base, -1, 1 << 64), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers[:-1], dtype=np.uint64)))
    return mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def super_kmers(symbols: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> SuperKmers:
    """Of documents that lie one after the other in ``symbols`` (uint64)."""
    starts = np.cumsum(lengths) - lengths
    low = sliding_min(rolling(symbols, gram), size - gram + 1)
    at = np.flatnonzero(inside(starts, lengths, size, len(symbols))[: len(low)]) if len(low) else np.empty(0, np.int64)
    if not len(at):
        none, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
        return SuperKmers(none, none, none, hashes, hashes)
    fresh = np.concatenate(([True], (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]])))
    begun = np.flatnonzero(fresh)
    fresh |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % (size - gram + 1) == 0  # a repetitive text's runs are cut
    first = at[fresh]
    count = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    doc = np.searchsorted(starts, first, side="right") - 1
    # documents without symbols share a start with the one behind them; the last one counts
    last = first + count + size - 1
    return SuperKmers(doc, first - starts[doc], count, low[first], _span_hashes(mixed(symbols), first, last, _BASE))

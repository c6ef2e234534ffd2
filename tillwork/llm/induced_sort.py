"""Suffix sorting by induction with disk-backed queues that carry common-prefix lengths.

The sorted S* suffixes (an S suffix after an L suffix) seed two scans. The first goes up through the
alphabet and induces the L suffixes, the second goes down and induces the S suffixes. Both draw from a
monotone priority queue: one first-in-first-out run for each symbol, kept on disk beyond a given
amount of memory. Its entries are (suffix, common prefix with the entry before), and the
common prefix of two induced suffixes is one more than the least one between their sources.

S* suffixes are sorted by naming S* substrings and sorting the string of names: by
recursion, or by doubling in memory where that string is short enough.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that one step takes from a queue.
STEP = 1 << 16
LONG = np.iinfo(np.int16).max


class SymbolQueue:
    """First-in-first-out runs by symbol; runs go to disk when they exceed ``memory`` bytes in all."""

    def __init__(self, folder: str, memory: int):
        self.folder = tempfile.mkdtemp(dir=folder)
        self.memory, self.held, self.spilled = memory, 0, 0
        self.runs: dict[int, list] = {}

    def push(self, symbol: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.runs.setdefault(symbol, []).append((suffixes, prefixes))
        self.held += suffixes.nbytes + prefixes.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for symbol, run in self.runs.items():
            kept = [x for x in run if not isinstance(x[0], np.ndarray)]
            new = [x for x in run if isinstance(x[0], np.ndarray)]
            if not new:
                continue
            with open(os.path.join(self.folder, str(symbol)), "ab") as file:
                for suffixes, prefixes in new:
                    kept.append((file.tell(), len(suffixes)))
                    file.write(suffixes.tobytes() + prefixes.tobytes())
            self.runs[symbol] = kept
            self.spilled += len(new)
        self.held = 0

    def _load(self, symbol: int, entry: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(entry[0], np.ndarray):
            self.held -= entry[0].nbytes + entry[1].nbytes
            return entry
        with open(os.path.join(self.folder, str(symbol)), "rb") as file:
            file.seek(entry[0])
            return np.fromfile(file, np.int32, entry[1]), np.fromfile(file, np.int16, entry[1])

    def pop(self, symbol: int, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take runs from the front (or the end), also those pushed meanwhile; short ones are joined."""
        while run := self.runs.get(symbol):
            if last:
                yield self._load(symbol, run.pop())
                continue
            taken = [self._load(symbol, run.pop(0))]
            while run and len(taken) < 256 and isinstance(run[0][0], np.ndarray) and len(run[0][0]) < STEP // 256:
                taken.append(self._load(symbol, run.pop(0)))
            yield tuple(np.concatenate(x) for x in zip(*taken, strict=True)) if len(taken) > 1 else taken[0]

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S: smaller than the next one. The last one is."""
    rising = text[:-1] < text[1:]
    decided = np.flatnonzero(text[:-1] != text[1:])
    at = np.searchsorted(decided, np.arange(len(text) - 1))
    out = np.ones(len(text), bool)
    inside = at < len(decided)
    out[:-1][inside] = rising[decided[at[inside]]]
    return out


def _ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of ``key`` and how many there are."""
    order = np.argsort(key)
    ordered = key[order]
    names = np.zeros(len(order), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=names[1:])
    out = np.empty(len(order), np.int64)
    out[order] = names
    return out, int(names[-1]) + 1 if len(names) else 0


def _refined(names: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks by ``names``, which are dense ranks already, and then by ``key``."""
    minor, count = _ranks(key)
    return _ranks(names * count + minor)


def _names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Dense ranks of the S* substrings, compared by symbol and type, four symbols at a time."""
    stops = np.append(stars[1:], stars[-1])
    names, count = np.zeros(len(stars), np.int64), 1
    wide = text.dtype.itemsize > 2
    for start in range(0, min(depth, int((stops - stars).max()) + 1), 1 if wide else 4):
        longer = stops - stars >= start if start else np.ones(len(stars), bool)
        key = np.zeros(len(stars), np.int64)
        for k in range(1 if wide else 4):
            at = stars + start + k
            inside = at <= stops
            at = np.minimum(at, len(text) - 1)
            symbol = (text[at].astype(np.int64) << 1) | is_s[at]
            key = (key << (0 if wide else 15)) | np.where(inside, symbol + 1, 0)
        if longer.all():
            names, count = _refined(names, key)
        else:
            names, count = _refined(names, np.where(longer, key, 0))
        if count == len(stars):
            break
    return names, count


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the string of names in order, by doubling; ties beyond ``depth`` symbols stay."""
    ranks, step, count = names, 1, 0
    while step <= depth:
        after = np.zeros(len(ranks), np.int64)
        after[:-step] = ranks[step:] + 1 if step < len(ranks) else 0
        ranks, count = _ranks(ranks * (len(ranks) + 1) + after)
        if count == len(ranks):
            break
        step *= 2
    return np.argsort(ranks, kind="stable")


def _prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes at ``a`` and ``b``, up to ``most``."""
    out, live = np.zeros(len(a), np.int16), np.arange(len(a))
    if text.dtype.itemsize == 2:  # four symbols at a time, as long as all of them agree
        wide = np.zeros(len(text), np.uint64)
        for k in range(min(4, len(text))):
            wide[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(16 * k)
        for k in range(0, most - 3, 4):
            i, j = a[live] + k, b[live] + k
            live = live[np.maximum(i, j) + 4 <= len(text)]
            live = live[wide[a[live] + k] == wide[b[live] + k]]
            if not len(live):
                break
            out[live] = k + 4
        live = np.flatnonzero(out < most)
    done = out.astype(np.int64)
    for _ in range(most):
        i, j = a[live] + done[live], b[live] + done[live]
        inside = (i < len(text)) & (j < len(text))
        live, i, j = live[inside], i[inside], j[inside]
        live = live[text[i] == text[j]]
        done[live] += 1
        live = live[done[live] < most]
        if not len(live):
            break
    return done.astype(np.int16)


def _runs_min(least: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``least[first..last]`` for each pair, by a table of powers of two."""
    width = last - first + 1
    level = np.frexp(width)[1] - 1
    out = np.empty(len(width), least.dtype)
    row = least
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        if 2 << k > len(least):
            break
        row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class _Scan:
    """Entries in scanning order; hands what they induce to a queue, with common prefixes."""

    def __init__(self, queue: SymbolQueue, symbols: int, most: int):
        self.queue, self.most = queue, most
        self.seen = np.zeros(symbols, bool)
        self.running = np.full(symbols, LONG, np.int16)

    def step(self, suffixes: np.ndarray, prefixes: np.ndarray, induced: np.ndarray, symbol: np.ndarray) -> None:
        """``induced`` says which entries induce one; ``symbol`` has the symbols before all of them."""
        at = np.flatnonzero(induced)
        if len(at):
            into = symbol[at]
            order = np.argsort(into, kind="stable")
            at, into = at[order], into[order]
            heads = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            first = np.append(0, at[:-1] + 1)
            first[heads] = 0
            common = _runs_min(prefixes, first, at)
            groups = into[heads]
            common[heads] = np.minimum(common[heads], self.running[groups])
            common = np.minimum(common + 1, self.most).astype(np.int16)
            common[heads[~self.seen[groups]]] = 0
            ends = np.append(heads[1:], len(at))
            new = (suffixes[at] - 1).astype(np.int32)
            for g, lo, hi in zip(groups.tolist(), heads.tolist(), ends.tolist(), strict=True):
                self.queue.push(g, new[lo:hi], common[lo:hi])
            tail = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], LONG)
            self.running = np.minimum(self.running, prefixes.min())
            self.running[groups] = tail[at[ends - 1] + 1]
            self.seen[groups] = True
        else:
            self.running = np.minimum(self.running, prefixes.min())


def _repeats(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at ``at`` stands there in a row."""
    window = text[at : at + most]
    other = np.flatnonzero(window != window[0])
    return int(other[0]) if len(other) else len(window)


def _starred(text: np.ndarray, is_s: np.ndarray, depth: int, in_memory: int, folder: str, memory: int) -> np.ndarray:
    """The S* suffixes in order; those that agree for ``depth`` symbols in any order."""
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(stars) < 2:
        return stars
    names, count = _names(text, is_s, stars, depth)
    if count == len(stars):
        return stars[np.argsort(names)]
    if len(stars) <= in_memory:
        return stars[_double(names, depth)]
    order = np.concatenate(
        [x for x, _ in sorted_suffixes((names + 1).astype(np.int32), depth, in_memory, folder, memory)]
    )
    return stars[order[::-1][order[::-1] < len(stars)]]


def sorted_suffixes(
    text: np.ndarray, depth: int, in_memory: int = 1 << 23, folder: str | None = None, memory: int = 64 << 20
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``(suffixes, common)`` in descending order; ``text`` holds symbols above 0.

    ``common`` is the common prefix with the suffix before (the next larger one), ``depth`` at most.
    Suffixes that agree for ``depth`` symbols may come in any order. The suffix at ``len(text)``, the
    empty one, is included. ``text`` may be a memory map; ``memory`` bounds what the queues hold
    in memory and ``in_memory`` the names that are sorted without recursion.
    """
    depth = min(depth, LONG - 1)
    text = np.append(text, text.dtype.type(0))
    scratch = tempfile.mkdtemp(prefix="suffixes-", dir=folder)
    try:
        yield from _scans(text, depth, in_memory, scratch, memory)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def _scans(text: np.ndarray, depth: int, in_memory: int, scratch: str, memory: int):
    is_s = types(text)
    stars = _starred(text, is_s, depth, in_memory, scratch, memory)
    del is_s
    alphabet = np.unique(text)
    codes = int(alphabet[-1]) + 1
    heads = text[stars]
    star_prefix = np.zeros(len(stars), np.int16)
    star_prefix[1:] = _prefix(text, stars[:-1], stars[1:], depth)

    up, sorted_l = SymbolQueue(scratch, memory), SymbolQueue(scratch, memory)
    scan = _Scan(up, codes, depth)
    for c in alphabet.tolist():
        tail = -1
        for suffixes, prefixes in up.pop(c):
            sorted_l.push(c, suffixes, prefixes)
            tail = int(suffixes[-1])
            before = text[suffixes - 1]
            scan.step(suffixes, prefixes, (suffixes > 0) & (before >= c), before)
        lo, hi = np.searchsorted(heads, [c, c + 1])
        for start in range(lo, hi, STEP):
            stop = min(hi, start + STEP)
            suffixes, prefixes = stars[start:stop], star_prefix[start:stop].copy()
            if start == lo and tail >= 0:  # an L and an S suffix agree while the symbol repeats
                prefixes[0] = min(_repeats(text, tail, depth), _repeats(text, int(suffixes[0]), depth))
            before = text[suffixes - 1]
            scan.step(suffixes, prefixes, (suffixes > 0) & (before >= c), before)
    up.close()

    down = SymbolQueue(scratch, memory)
    scan = _Scan(down, codes, depth)
    last = len(text) - 1
    for c in alphabet.tolist()[::-1]:
        tail = -1
        if c:
            for suffixes, prefixes in down.pop(c):
                yield suffixes, prefixes
                tail = int(suffixes[-1])
                before = text[suffixes - 1]
                scan.step(suffixes, prefixes, (suffixes > 0) & (before <= c), before)
        else:
            yield np.array([last], np.int32), np.zeros(1, np.int16)
        carry = -1
        for suffixes, prefixes in sorted_l.pop(c, last=True):
            if carry < 0:
                carry = min(_repeats(text, tail, depth), _repeats(text, int(suffixes[-1]), depth)) if tail >= 0 else 0
            suffixes, common = suffixes[::-1], np.append(np.int16(carry), prefixes[:0:-1]).astype(np.int16)
            carry = int(prefixes[0])
            yield suffixes, common
            before = text[suffixes - 1]
            scan.step(suffixes, common, (suffixes > 0) & (before < c), before)
    down.close()
    sorted_l.close()

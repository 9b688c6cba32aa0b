"""Runs of repeated words in every text, by Crochemore's partition refinement.

Positions are classed by the factor of a length that starts there, and the classes are refined from length to length: of the
parts a class falls into, all but the largest split the classes of the positions before them. Two neighbours of a class at a
distance equal to the length are a square, and its root is primitive, as a root that is a power occurs in between. Squares of
one length at consecutive positions are a run. A batch of texts is refined at once, each text with an end mark of its own, so
the arrays are long and the steps few; every position moves O(log n) times."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import pieces

FIELDS = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each start .. start + size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Gaps:
    """Positions by the distance to the next one of their class. Those beyond the block of lengths at hand, up to twice its
    first, wait unsorted."""

    def __init__(self) -> None:
        self.block, self.now, self.later = 0, {}, {}

    def _deal(self, gap: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(gap, kind="stable")
        gap, at = gap[order], at[order]
        cuts = np.flatnonzero(np.diff(gap)) + 1
        for g, part in zip(gap[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            self.now.setdefault(g, []).append(part)

    def add(self, gap: np.ndarray, at: np.ndarray) -> None:
        bits = np.frexp(gap.astype(float))[1]
        for b in np.unique(bits).tolist():
            own = bits == b
            if b > self.block:
                self.later.setdefault(b, []).append((gap[own], at[own]))
            elif b == self.block:
                self._deal(gap[own], at[own])

    def take(self, length: int) -> np.ndarray | None:
        if length.bit_length() != self.block:
            self.block, self.now = length.bit_length(), {}
            if waiting := self.later.pop(self.block, None):
                self._deal(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        found = self.now.pop(length, None)
        return None if found is None else np.unique(np.concatenate(found))


class Classes:
    """A partition of positions: members of a class lie together in `order`, and are linked by position."""

    def __init__(self, symbols: np.ndarray, reach: np.ndarray) -> None:
        """One class for each symbol, cut where two members are further apart than reach, so far that no run has them both."""
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        s = symbols[self.order]
        new = np.ones(n, bool)
        new[1:] = (s[1:] != s[:-1]) | (np.diff(self.order) > reach[self.order[1:]])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n))
        self.count = len(self.start)
        self.of, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.place[self.order] = np.arange(n)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        a, b = self.order[:-1][~new[1:]], self.order[1:][~new[1:]]
        self.next[a], self.before[b] = b, a
        self.start, self.size = (np.append(x, np.zeros(n, np.int64)) for x in (self.start, self.size))

    def unlink(self, moved: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Takes moved, of the classes old, out of the lists of these. Returns the positions that have another next one."""
        moved = moved[np.lexsort((moved, old))]
        chain = np.append(True, self.next[moved[:-1]] != moved[1:])
        left, right = self.before[moved[chain]], self.next[moved[np.append(chain[1:], True)]]
        changed = left[left >= 0]
        self.next[changed] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        return changed

    def refine(self, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes by the next greater length, given the positions (ascending) of all but the largest part of each class that
        the last step split. Returns the same for this step, and the positions with another next one."""
        none = np.empty(0, np.int64)
        at = splitters[splitters > 0] - 1
        at = at[self.size[self.of[at]] > 1]
        if not len(at):
            return none, none
        old, by = self.of[at], self.of[at + 1]
        key = old * (self.count + 1) + by
        order = np.argsort(key, kind="stable")
        at, old, key = at[order], old[order], key[order]
        first = np.append(True, key[1:] != key[:-1])
        g = np.flatnonzero(first)  # parts, by their first row
        parts = np.diff(np.append(g, len(at)))
        of_class = np.append(True, old[g][1:] != old[g][:-1])
        c = np.flatnonzero(of_class)  # classes, by their first part
        owner = np.cumsum(of_class) - 1
        split = old[g][c]
        rest = self.size[split] - np.add.reduceat(parts, c)
        largest = np.maximum.reduceat(parts, c)
        # where nothing is left, the first of the largest parts stays and keeps the class's number
        is_largest = parts == largest[owner]
        which = np.minimum.reduceat(np.where(is_largest, np.arange(len(g)), len(g)), c)
        stays = np.zeros(len(g), bool)
        stays[which[rest == 0]] = True
        go = np.repeat(~stays, parts)
        if not go.any():
            return none, none
        rest = np.where(rest == 0, largest, rest)
        at, old, first = at[go], old[go], first[go]
        parts, owner = parts[~stays], owner[~stays]
        has = np.bincount(owner, minlength=len(c)) > 0
        split, rest = split[has], rest[has]
        owner = (np.cumsum(has) - 1)[owner]
        c = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out = np.add.reduceat(parts, c)
        # the places at each class's end go to what leaves it; what stood there takes the places left
        begin = self.start[split] + rest
        tail = ranges(begin, out)
        leaves = np.zeros(len(tail), bool)
        inside = self.place[at] >= np.repeat(begin, out)
        leaves[np.repeat(np.cumsum(out) - out, out)[inside] + (self.place[at] - np.repeat(begin, out))[inside]] = True
        stay, holes = self.order[tail][~leaves], self.place[at][~inside]
        self.order[holes], self.place[stay] = stay, holes
        self.order[tail], self.place[at] = at, tail
        changed = self.unlink(at, old)
        numbers = self.count + np.arange(len(parts))
        self.count += len(parts)
        self.of[at] = np.repeat(numbers, parts)
        self.start[numbers] = begin[owner] + np.cumsum(parts) - parts - (np.cumsum(out) - out)[owner]
        self.size[numbers], self.size[split] = parts, rest
        self.before[at], self.next[at] = np.where(first, -1, np.append(-1, at[:-1])), np.append(np.where(first[1:], -1, at[1:]), -1)
        # of the parts of each class, rest included, all but the largest split on
        largest = np.maximum.reduceat(parts, c)
        which = np.minimum.reduceat(np.where(parts == largest[owner], np.arange(len(parts)), len(parts)), c)
        over = largest > rest
        small = np.ones(len(parts), bool)
        small[which[over]] = False
        small = np.concatenate([at[np.repeat(small, parts)], self.order[ranges(self.start[split[over]], rest[over])]])
        return np.sort(small), np.concatenate([changed, at])


def find_runs(texts: list[np.ndarray], least: int = 6, power: int = 4) -> list[np.ndarray]:
    """Of each text, given as numbers that stand for words, the runs (start, length, period) by start, then period: stretches
    with smallest period q and length of at least max(least, power * q) that cannot be extended; power is 2 or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum()) + len(texts)
    ends = np.cumsum(sizes + 1)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    symbols, top = np.empty(total, np.int64), 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        symbols[end - 1 - len(t) : end - 1] = t + top if len(t) else t
        symbols[end - 1] = -end
        top += int(t.max()) + 1 if len(t) else 0
    reach = (sizes // power)[text]
    found = []
    if top:
        classes, gaps = Classes(symbols, reach), Gaps()
        changed, splitters = np.arange(total), np.arange(total)
        last = int(reach.max())
        for length in range(1, last + 1):
            if length > 1:
                splitters, changed = classes.refine(splitters)
            changed = changed[classes.next[changed] >= 0]
            gap = classes.next[changed] - changed
            near = (gap >= length) & (gap <= reach[changed])
            if near.any():
                gaps.add(gap[near], changed[near])
            at = gaps.take(length)
            if at is not None and len(at := at[classes.next[at] - at == length]):
                cuts = np.flatnonzero(np.diff(at) > 1)
                begin, end = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
                size = end - begin + 2 * length
                long = size >= max(least, power * length)
                if long.any():
                    found.append(np.column_stack([begin[long], size[long], np.full(int(long.sum()), length)]))
            if not len(splitters) and not gaps.now and not gaps.later:
                break
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], ends)
    first = ends - sizes - 1
    return [runs[a:b] - [f, 0, 0] for a, b, f in zip(np.append(0, cuts[:-1]) if len(cuts) else [], cuts, first, strict=True)]


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Every tenth document by crc32 of its id is made periodic from some word on; one without an id stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return words[at]


def numbered(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """A text's words as numbers, and what they stand for."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), list(numbers)


def digest(doc_id: int | None, words: np.ndarray, names: list[bytes], runs: np.ndarray) -> dict:
    n = len(words)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    kept = words[np.cumsum(inside[:n]) == 0]
    best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist() if len(runs) else [None] * 3
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in runs.tolist())
    return {
        "id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join([names[w] for w in kept.tolist()])).hexdigest(),
    }


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4, plant: bool = True) -> DataFrame:
    """A row for each row of docs: id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; all null without a run), runs_sha256 of all runs and collapsed_sha256 of the words that stay when
    every run keeps its first period only. With plant, documents are first made periodic as planted() says.

    Null, empty and blank texts have no words and no runs; rows that share an id, or have none, are each judged by
    themselves; an empty table gives an empty table; other columns are not read. Whole texts are refined, several megabytes
    of them at once or one longer text by itself; nothing is shuffled, so a lost executor costs its tasks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4000, 8_000_000):
            ids = b.column(0).to_pylist()
            read = [numbered(t) for t in b.column(1).to_pylist()]
            words = [planted(w, i) if plant else w for (w, _), i in zip(read, ids, strict=True)]
            rows = [digest(i, w, names, r) for i, w, (_, names), r in zip(ids, words, read, find_runs(words, least, power), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, FIELDS)

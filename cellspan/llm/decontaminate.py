"""Benchmark decontamination by the q-gram lemma: shared q-grams in diagonal bands, then a banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import matching, materialize, pieces, text_hash

WORD = re.compile(r"[^\W_]+")
#: Between texts that are laid end to end; no normalised text holds it.
GAP = "\x00"


#: ASCII letters in lower case and digits as they are, all else to a space.
PLAIN = bytes(c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()) + bytes([32] * 128)


def normalise(text: str | None) -> str:
    """Lower case, letters and digits alone, one space between words."""
    if text and text.isascii():
        return b" ".join(text.encode().translate(PLAIN).split()).decode()
    return " ".join(WORD.findall((text or "").lower()))


def _codes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for the q characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code, width, mult = chars.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    out, done, at = np.zeros(n, np.uint64), 0, 0
    while True:
        if q >> done & 1:  # q in binary: pieces of 1, 2, 4, ... characters
            out = (out ^ (out >> np.uint64(29))) * mult + code[at : at + n]
            at += width
        done += 1
        if not q >> done:
            return (out ^ (out >> np.uint64(32))) * mult
        code = (code[:-width] * np.uint64(0xD6E8FEB86659FD93)) ^ (code[width:] + (code[:-width] >> np.uint64(31)))
        width *= 2


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def align(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item with a part of region, None above budget edits. The
    band runs along the diagonals of region, whose part may begin and end anywhere; ties: the first end, then the last start."""
    m, n, width = len(item), len(region), len(region) - len(item) + 2 * budget + 1
    if width <= 0:
        return None
    far, one = 1 << 40, 1 << 21
    # cell b of row i is region[:i + b - budget]; edits * one + n - start travel as one number
    pos = np.arange(width, dtype=np.int64) - budget
    lift = np.arange(width, dtype=np.int64) * one
    row = np.where((pos >= 0) & (pos <= n), n - pos, far)
    padded = np.concatenate([np.full(budget + 1, -1, np.int64), region.astype(np.int64), np.full(width + m, -1, np.int64)])
    for i in range(1, m + 1):
        chars = padded[i : i + width]
        step = row + one * (chars != item[i - 1])
        np.minimum(step[:-1], row[1:] + one, out=step[:-1])
        low, high = budget - i, n - i + budget + 1
        if low >= 0:
            step[:low] = far
            if low < width:
                step[low] = n + i * one
        if high < width:
            step[max(high, 0) :] = far
        row = np.minimum.accumulate(step - lift) + lift
        if high < width:
            row[max(high, 0) :] = far
        if not i % 8 and row.min() >= (budget + 1) * one:
            return None
    b = int(np.argmin(row // one))
    edits = int(row[b] // one)
    return (edits, n - int(row[b] % one), m + b - budget) if edits <= budget else None


@dataclass
class GramIndex:
    """The q-grams of some benchmark items, for many documents."""

    ids: list
    items: list[np.ndarray]
    q: int
    edits: float

    def __post_init__(self) -> None:
        self.texts = [x.tobytes().decode("utf-32-le", "surrogatepass") for x in self.items]
        self.brief: dict[int, dict[tuple, list[int]]] = {}
        for i, t in enumerate(self.texts):
            if len(t) < self.q:
                w = tuple(t.split(" "))
                self.brief.setdefault(len(w), {}).setdefault(w, []).append(i)
        m = np.array([len(x) for x in self.items])
        self.budget = np.floor(m * self.edits + 1e-9).astype(np.int64)
        self.need = np.maximum(1, m - self.q + 1 - self.q * self.budget)
        grams = [_codes(x, self.q) for x in self.items]
        codes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.item, self.at = item[order], at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.codes >> np.uint64(42)).astype(np.int64)] = True

    def short(self, text: str) -> dict[int, int]:
        """Where in a normalised text the items below q characters begin that stand there as whole words."""
        if not self.brief:
            return {}
        found: dict[int, int] = {}
        words = text.split(" ")
        for n, items in self.brief.items():
            at = 0
            for k in range(len(words) - n + 1):
                for i in items.get(tuple(words[k : k + n]), ()):
                    found.setdefault(i, at)
                at += len(words[k]) + 1
        return found

    def candidates(self, chars: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, least and largest diagonal) of bands that share enough q-grams; starts: where documents begin."""
        codes = _codes(chars, self.q)
        place = np.flatnonzero(self.bits[(codes >> np.uint64(42)).astype(np.int64)])
        found = np.searchsorted(self.codes, codes[place])
        found[found == len(self.codes)] = 0
        real = self.codes[found] == codes[place] if len(self.codes) else np.zeros(len(place), bool)
        place, found = place[real], found[real]
        if not len(place):
            return
        times = self.count[found]
        post = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, place = self.item[post], np.repeat(place, times)
        doc = np.searchsorted(starts, place, "right") - 1
        pair = doc * len(self.items) + item
        # enough in the whole document first: that drops nearly all; counts of the pairs that occur take no more room than these
        seen, back, n = np.unique(pair, return_inverse=True, return_counts=True)
        keep = (n >= self.need[seen % len(self.items)])[back]
        pair, item, place, post = pair[keep], item[keep], place[keep], post[keep]
        diagonal = place - starts[pair // len(self.items)] - self.at[post] + len(chars)
        width = self.budget[item] + 1
        # bands of twice the width, one starting at each width: any alignment's diagonals lie in one of them
        band = diagonal // width
        key = np.concatenate([pair * (4 * len(chars)) + band, pair * (4 * len(chars)) + band - 1])
        at = np.concatenate([self.at[post]] * 2)
        for _ in range(2):  # all shared q-grams first, then, of what is left, those of different places in the item
            kept, back, n = np.unique(key, return_inverse=True, return_counts=True)
            full = (n >= self.need[kept // (4 * len(chars)) % len(self.items)])[back]
            both = np.unique(np.stack([key[full], at[full]]), axis=1)
            key, at = both[0], both[1]
        kept, n = np.unique(key, return_counts=True)
        pair, band = kept // (4 * len(chars)), kept % (4 * len(chars))
        item = pair % len(self.items)
        done: tuple = ()
        for k in np.flatnonzero(n >= self.need[item]):
            w = int(self.budget[item[k]]) + 1
            low = int(band[k]) * w - len(chars)
            if done and done[:2] == (pair[k], band[k] - 1):  # overlapping bands are aligned as one
                done = (pair[k], band[k], done[2], low + 2 * w - 1)
                continue
            if done:
                yield int(done[0] // len(self.items)), int(done[0] % len(self.items)), done[2], done[3]
            done = (pair[k], band[k], low, low + 2 * w - 1)
        if done:
            yield int(done[0] // len(self.items)), int(done[0] % len(self.items)), done[2], done[3]

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): (edits, start, end) of the item's best place in the normalised text."""
        laid = GAP + GAP.join(texts) + GAP
        chars = _chars(laid)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.concatenate([[1], ends[:-1] + 1]) if texts else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, low, high in self.candidates(chars, starts):
            text, item = chars[starts[d] : starts[d] + len(texts[d])], self.items[i]
            budget = int(self.budget[i])
            a, b = max(0, low - budget), min(len(text), high + len(item) + budget)
            exact = texts[d].find(self.texts[i], a, b)
            got = (0, exact - a, exact - a + len(item)) if exact >= 0 else align(item, text[a:b], budget)
            if got and (d, i) not in best or got and (got[0], got[1] + a) < best[d, i][:2]:
                best[d, i] = (got[0], got[1] + a, got[2] + a)
        if self.brief:
            for d, text in enumerate(texts):
                best.update({(d, i): (0, at, at + len(self.items[i])) for i, at in self.short(text).items()})
        return best


def gram_size(chars: int, q: int, edits: float) -> int:
    """The largest q, up to the one asked for, with which the lemma asks for a shared q-gram whatever an item's edits are."""
    return max(1, min(q, chars // (int(chars * edits + 1e-9) + 1))) if chars >= q else q


class Indexes:
    """The q-grams of some benchmark items, by the q that fits their length: few for short items."""

    def __init__(self, ids: list, texts: list[str], q: int, edits: float) -> None:
        self.ids, self.sizes = ids, [len(t) for t in texts]
        sizes: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            sizes.setdefault(gram_size(len(t), q, edits), []).append(k)
        self.parts = [(of, GramIndex([ids[k] for k in of], [_chars(texts[k]) for k in of], size, edits)) for size, of in sorted(sizes.items())]

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        return {(d, of[i]): best for of, index in self.parts for (d, i), best in index.search(texts).items()}


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """The place in text of a place in its normalised form (start and end are drawn to the words they touch)."""
    at, first, last = 0, None, None
    for w in WORD.finditer(text.lower()):
        n = w.end() - w.start()
        if at + n > start and first is None:
            first = w.start()
        if at < end:
            last = w.end()
        at += n + 1
    return first or 0, last or 0


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    q: int = 8, edits: float = 0.1, block_chars: int = 2_000_000,
) -> DataFrame:
    """A row for each document row and benchmark item that it holds: id_col, th (the text's hash), item_col, edits, start,
    end (characters of the lower-cased text, which is longer than the text where a capital has two small letters),
    item_chars.

    Held: some part of the normalised text is within edits * (the item's normalised length) edits of the whole item. The
    lemma: a part within k edits of an item of m characters shares m - q + 1 - k * q q-grams with it, on diagonals at most
    k apart; items so short that it would ask for none have a smaller q. Items with fewer than q normalised characters are held where their words stand in a row, unchanged (an item
    without any is held nowhere). Null or empty texts hold nothing; null items
    are skipped; repeated rows give repeated results; repeated items each count. Columns beyond those named are not read.

    Benchmark items go to the executors in blocks of about block_chars characters, each held against all documents before
    the next is read; so what the driver holds and sends is bounded however large the benchmark is. Documents are not
    shuffled, and are read once a block; the rows found are kept in the shared folder."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField(item_col, benchmark.schema[item_col].dataType),
        T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item_chars", T.IntegerType()),
    ])
    arrow = {f.name: f for f in spark.createDataFrame([], schema).toArrow().schema}
    rows = docs.select(F.col(id_col), text_hash(F.col(text_col)).alias("th"), F.col(text_col))
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        texts = [(r["i"], normalise(r["t"])) for r in own]
        texts = sorted(((i, t) for i, t in texts if t), key=lambda x: (x[0] is None, x[0], x[1]))
        args = ([i for i, _ in texts], [t for _, t in texts], q, edits)

        def run(batches: Iterator[pa.RecordBatch], args: tuple = args) -> Iterator[pa.RecordBatch]:
            index = Indexes(*args)
            for batch in pieces(batches):
                raw = batch.column(2).to_pylist()
                got = index.search([normalise(t) for t in raw]) if index.ids else {}
                hits = [(d, i, *best, *_original(raw[d], *best[1:]), index.sizes[i]) for (d, i), best in sorted(got.items())]
                take = pa.array([h[0] for h in hits], pa.int64())
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array([index.ids[h[1]] for h in hits], arrow[item_col].type)]
                cols += [pa.array([h[k] for h in hits], pa.int32()) for k in (2, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        part = materialize(rows.mapInArrow(run, schema))
        found = part if found is None else found.union(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    held = leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("id"), "th").distinct()
    return matching(docs, held, "left_anti", id_col, text_col)

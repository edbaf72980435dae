"""Repeated word sequences, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, slices, stored, whole_ids
from plume.llm.hashing import hashes, mixed

WINDOW = 20
PAIR_ROUNDS = 3

BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = 0xFFFFFFFF
UPPER = np.uint64(0xFFFFFFFF00000000)


@dataclass
class Symbols:
    """A sequence of named symbols over word places.

    A symbol stands for the words from ``start`` to ``end``. Nothing outside
    of the words from ``low`` to ``high`` had a part in its making: where
    these words occur again, so does the symbol.
    """

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wall: np.ndarray  # places between documents, which nothing joins

    def runs(self) -> Symbols:
        """Maximal runs of equal neighbours become one symbol, named by what is repeated and how often."""
        first = np.ones(len(self.name), dtype=bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | self.wall[1:] | self.wall[:-1]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        times = (last - at + 1).astype(np.uint64)
        name = np.where(times > 1, mixed(self.name[at] * BASE + times), self.name[at])
        low, high = self.low[np.maximum(at - 1, 0)], self.high[np.minimum(last + 1, len(first) - 1)]
        return Symbols(name, self.start[at], self.end[last], low, high, self.wall[at])

    def pairs(self, round_: int) -> Symbols:
        """Neighbours of a left and a right name become one symbol; a coin per name and round says which it is."""
        side = mixed(self.name + np.uint64(2 * round_ + 1)) >> np.uint64(63)
        left, right = (side == 0) & ~self.wall, (side == 1) & ~self.wall
        joined = np.append(left[:-1] & right[1:], False)
        taken = np.append(False, joined[:-1])
        at = np.flatnonzero(~taken)
        both, after, before = joined[at], np.minimum(at + 1, len(side) - 1), np.maximum(at - 1, 0)
        name = np.where(both, mixed(self.name[at] * BASE + mixed(self.name[after]) + np.uint64(round_)), self.name[at])
        low = np.where(both, np.minimum(self.low[at], self.low[after]), np.where(right[at], np.minimum(self.low[at], self.low[before]), self.low[at]))
        high = np.where(both | left[at], np.maximum(self.high[at], self.high[after]), self.high[at])
        return Symbols(name, self.start[at], np.where(both, self.end[after], self.end[at]), low, high, self.wall[at])


class Prints:
    """Hashes of word sequences at any place of ``h``: 64 and 32 independent bits each."""

    BASES = ((BASE | np.uint64(1), np.uint64(0)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A5A5A5A5A5)))

    def __init__(self, h: np.ndarray) -> None:
        self.sums, self.inverse = [], []
        for base, scramble in self.BASES:
            powers = np.full(len(h), base, dtype=np.uint64)
            powers[:1] = 1
            np.multiply.accumulate(powers, out=powers)
            self.sums.append(np.append(np.uint64(0), np.add.accumulate(mixed(h ^ scramble) * powers)))
            inverse = np.full(len(h), np.uint64(pow(int(base), -1, 1 << 64)), dtype=np.uint64)
            inverse[:1] = 1
            np.multiply.accumulate(inverse, out=inverse)
            self.inverse.append(inverse)

    def long(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[0][first + size] - self.sums[0][first]) * self.inverse[0][first])

    def short(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The 32 bits, in the upper half of a number."""
        both = (self.sums[1][first + size] - self.sums[1][first]) * self.inverse[1][first]
        return mixed(both + np.asarray(size, dtype=np.uint64)) & UPPER


def whole_windows(wall: np.ndarray, size: int) -> np.ndarray:
    """Where a window starts that no wall cuts."""
    n = len(wall)
    whole = np.zeros(n, dtype=bool)
    if n >= size:
        walls = np.cumsum(wall)
        whole[: n - size + 1] = (walls[size - 1 :] == walls[: n - size + 1]) & ~wall[: n - size + 1]
    return whole


def named(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of the words of all texts, a wall after each; the walls' mask; the numbers of words."""
    counts = [len(w) for w in split]
    h = np.zeros(sum(counts) + len(counts), dtype=np.uint64)
    wall = np.ones(len(h), dtype=bool)
    at = 0
    for words, n in zip(split, counts):
        h[at : at + n] = hashes(words)
        wall[at : at + n] = False
        at += n + 1
    return h, wall, counts


def word_names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    return named([(t or "").encode().split() for t in texts])


def anchors(h: np.ndarray, wall: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows for which one symbol stands: name, first window, number, prints (32 and 64 bits) of all their words.

    Of all symbols that were made inside of a window alone, the one of the
    most words stands for it, of equal ones that of the least name. Equal
    windows are made of equal symbols, so they have the same one. A window
    that holds none (inside of a long run) is named by its own hash.
    """
    n = len(h)
    place = np.arange(n)
    whole = whole_windows(wall, size)
    if not whole.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    depth = size.bit_length() - 1
    best = np.full((depth + 1, n + size), NONE, dtype=np.uint64)
    symbols = Symbols(h, place, place, place, place, wall).runs()
    for round_ in range(PAIR_ROUNDS):
        symbols = symbols.pairs(round_)
        words = symbols.end - symbols.start + 1
        first, last = np.maximum(symbols.high - size + 1, 0), symbols.low
        use = (last >= first) & ~symbols.wall
        first, last = first[use], last[use]
        key = (np.uint64(63) - words[use].astype(np.uint64)) << np.uint64(58) | symbols.name[use] >> np.uint64(6)
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        flat = best.reshape(-1)
        width = n + size
        np.minimum.at(flat, level * width + first, key)
        np.minimum.at(flat, level * width + last - (1 << level) + 1, key)
    for level in range(depth, 0, -1):
        half = 1 << (level - 1)
        np.minimum(best[level - 1], best[level], out=best[level - 1])
        np.minimum(best[level - 1][half:], best[level][:-half], out=best[level - 1][half:])
    key, prints = best[0][:n], Prints(h)
    bare = np.flatnonzero((key == NONE) & whole)
    key[bare] = prints.long(bare, size) | np.uint64(1 << 63)

    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    run = np.cumsum(new)
    number = np.bincount(run[whole], minlength=run[-1] + 1)[run[at]]
    words = number + size - 1
    return key[at], at, number, prints.short(at, words), prints.long(at, words)


def starts_of(runs: np.ndarray | None) -> np.ndarray:
    """The windows of packed runs (first window, number of windows), each once."""
    if runs is None or not len(runs):
        return np.zeros(0, np.int64)
    first, number = runs >> 32, runs & LOWER
    start = np.repeat(first - np.cumsum(number) + number, number)
    return np.unique(start + np.arange(len(start)))


def own_repeats(h: np.ndarray, wall: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (first window, number) of the windows whose words also start earlier in the same document."""
    at, prints, owner = np.flatnonzero(whole_windows(wall, size)), Prints(h), np.cumsum(wall)
    long = prints.long(at, size)
    order = np.argsort(long, kind="stable")  # places of one document stay in order and, for equal hashes, side by side
    equal = np.flatnonzero(long[order[:-1]] == long[order[1:]])
    before, after = at[order[equal]], at[order[equal + 1]]
    again = np.sort(after[(owner[before] == owner[after]) & (prints.short(before, size) == prints.short(after, size))])
    first = np.flatnonzero((np.diff(again, prepend=-2) != 1) | (np.diff(owner[again], prepend=-1) != 0))
    return again[first], np.diff(np.append(first, len(again)))


def texts_by_id(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", (F.hash("text").cast("long").bitwiseAND(F.lit(LOWER))).alias("check"))


def repeated_runs(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """of, of_check, runs: the runs of windows that also start earlier, in a document of a smaller doc_id or the same one.

    ``docs`` has doc_id, text, check. Names are hashes of what they name, so
    that they are the same in all tasks. First round: symbols of token runs
    and pairs, one for each run of windows that has it inside; Spark counts
    them, and those of one document alone are dropped (what a document repeats of itself is known at once, rows without a name). Second round: all
    words of such a run of windows are one symbol of a higher level. Where
    it occurs again, the whole run is a repeat; its first document stands for all.
    Third round: where one low symbol has several high ones, the
    windows of the first document of each are compared one by one.

    A high symbol has 96 bits: so many surroundings of one popular phrase
    are told apart that texts without repeats keep their words.

    Columns are packed, since they are most of what is shuffled: a tag has
    32 bits of a hash of words and the check of the text, a run its first
    window and its number of windows.
    """

    def reveal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            h, wall, counts = word_names(frame["text"].tolist())
            name, at, number, print_, whole = anchors(h, wall, size)
            offsets = np.cumsum([0, *(c + 1 for c in counts)])
            row = np.searchsorted(offsets, at, side="right") - 1
            # a document says each high symbol once
            key = mixed(name + mixed(whole + mixed(print_ | row.astype(np.uint64))))
            once = np.sort(np.unique(key, return_index=True)[1])
            name, at, number, print_, whole, row = name[once], at[once], number[once], print_[once], whole[once], row[once]
            checks, ids = frame["check"].to_numpy(dtype=np.uint64), frame["doc_id"].to_numpy()
            run = (at - offsets[row]) << 32 | number
            yield pd.DataFrame({"name": pd.array(name.view(np.int64), dtype="Int64"), "high": pd.array(whole.view(np.int64), dtype="Int64"), "doc_id": ids[row], "tag": (print_ | checks[row]).view(np.int64), "run": run})
            at, number = own_repeats(h, wall, size)
            row = np.searchsorted(offsets, at, side="right") - 1
            yield pd.DataFrame({"name": pd.array([None] * len(at), dtype="Int64"), "high": pd.array([None] * len(at), dtype="Int64"), "doc_id": ids[row], "tag": checks[row].view(np.int64), "run": (at - offsets[row]) << 32 | number})

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            h, _, counts = word_names(frame["text"].tolist())
            prints = Prints(h)
            offsets = np.cumsum([0, *(c + 1 for c in counts)])
            own = [starts_of(r) for r in frame["runs"]]
            row = np.repeat(np.arange(len(own)), [len(s) for s in own])
            start = np.concatenate(own)
            at = start + offsets[row]
            long, short = prints.long(at, size), prints.short(at, size)
            once = np.sort(np.unique(mixed(long + mixed(short | row.astype(np.uint64))), return_index=True)[1])
            row, start, long, short = row[once], start[once], long[once], short[once]
            check = frame["check"].to_numpy(dtype=np.uint64)[row]
            yield pd.DataFrame({"print": long.view(np.int64), "doc_id": frame["doc_id"].to_numpy()[row], "tag": (short | check).view(np.int64), "start": start.astype(np.int32)})

    known = docs.filter("doc_id is not null")
    upper, check = F.shiftright("tag", 32).cast("int"), F.col("tag").bitwiseAND(F.lit(LOWER))
    symbols = stored(known.mapInPandas(reveal, "name long, high long, doc_id long, tag long, run long"), "symbols")
    # low symbols of several documents
    high = symbols.filter("name is not null").select("name", "doc_id", "high")
    low = high.groupBy(F.col("name").alias("of")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("high").alias("h0"), F.max("high").alias("h1"))
    low = low.filter("least < most").select("of", (F.col("h0") < F.col("h1")).alias("several"))
    shared = stored(symbols.join(low, F.col("name") == F.col("of")).drop("of"), "shared")
    # high symbols: all but the first document repeat the whole run
    first = shared.groupBy(F.col("name").alias("of"), F.col("high").alias("of_high"), upper.alias("of_upper")).agg(F.min("doc_id").alias("least"))
    runs = shared.withColumn("upper", upper).join(first, (F.col("name") == F.col("of")) & (F.col("high") == F.col("of_high")) & (F.col("upper") == F.col("of_upper")))
    later = F.col("doc_id") > F.col("least")
    runs = runs.filter(later | F.col("several")).select("doc_id", "tag", "run", later.alias("sure"))
    runs = runs.union(symbols.filter("name is null").select("doc_id", "tag", "run", F.lit(True))).groupBy(F.col("doc_id").alias("of"), check.alias("of_check"))
    runs = stored(runs.agg(F.collect_list(F.when(F.col("sure"), F.col("run"))).alias("sure"), F.collect_list(F.when(~F.col("sure"), F.col("run"))).alias("runs")), "runs")
    discard(symbols, shared)
    # windows at the ends of repeats
    open_ = runs.filter(F.size("runs") > 0).select("of", "of_check", "runs")
    open_ = known.join(open_, (F.col("doc_id") == F.col("of")) & (F.col("check") == F.col("of_check"))).select("doc_id", "text", "check", "runs")
    windows = stored(open_.mapInPandas(verify, "print long, doc_id long, tag long, start int"), "windows")
    split = windows.withColumn("short", upper)
    first = split.groupBy(F.col("print").alias("p"), F.col("short").alias("s")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    again = split.join(first, (F.col("print") == F.col("p")) & (F.col("short") == F.col("s"))).filter(F.col("doc_id") > F.col("least"))
    again = again.groupBy(F.col("doc_id").alias("of"), check.alias("of_check")).agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + 1).alias("sure"))
    both = runs.select("of", "of_check", "sure").filter(F.size("sure") > 0).unionByName(again)
    out = stored(both.groupBy("of", "of_check").agg(F.flatten(F.collect_list("sure")).alias("runs")), "repeats")
    discard(runs, windows)
    return out


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``size`` consecutive words of its document
    covers it whose word sequence also starts earlier: in a document of a
    smaller doc_id, or earlier in the same one. Windows are those of the
    texts as given. kept_sha256 is of the words left, joined by one space.

    A null or empty text has no words. Rows of one doc_id and text are one
    document and get equal results; rows of one doc_id and different texts
    don't make each other's windows repeats. A row without a doc_id is compared with
    itself alone. Texts shorter than a window keep all words; an empty table gives
    an empty result. Texts are held in memory for a bounded number of
    characters at a time, or one by one if longer.
    """
    docs = texts_by_id(docs)
    repeats = repeated_runs(docs, size)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = []
            for doc_id, text, runs in zip(frame["doc_id"], frame["text"], frame["runs"]):
                words = kept = (text or "").encode().split()
                if doc_id is None:
                    h, wall, _ = named([words])
                    first, number = own_repeats(h, wall, size)
                    runs = first << 32 | number
                if runs is not None and len(runs):
                    starts = starts_of(runs)
                    change = np.bincount(starts, minlength=len(words) + size) - np.bincount(starts + size, minlength=len(words) + size)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[: len(words)] == 0)]
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"n_words": "int64", "n_removed": "int64"})

    none = F.lit(None).cast("array<bigint>")
    same = (F.col("doc_id") == F.col("of")) & (F.col("check") == F.col("of_check"))
    rows = docs.filter("doc_id is not null").join(repeats, same, "left").select("doc_id", "text", "runs")
    rows = rows.union(docs.filter("doc_id is null").select("doc_id", "text", none))
    out = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "runs").mapInPandas(finish, "doc_id string, n_words long, n_removed long, kept_sha256 string")
    out = stored(whole_ids(out), "without-repeats")
    discard(repeats)
    return out

"""Alignment of two tokenizers over a corpus, with document counts of linked ids by external spill counting."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plume.llm.common import discard, for_python, remembered, slices, stored, whole_ids

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
#: Records (pair and document) and documents of a run, at least one document.
RUN_RECORDS = 500_000
RUN_DOCS = 1 << 14
#: Runs are parted by the low bits of the A id.
RADIX_BITS = 5
RADIXES = 1 << RADIX_BITS
#: Pairs of a frame of merged counts; a merge holds one frame of each run.
FRAME_PAIRS = 65_536
#: Runs merged at once, and runs of a radix whose contributions a task makes.
FAN_IN = 64
#: Bits of a pair of ids, and of a document's place in its run.
PAIR_BITS, PLACE_BITS = 40, 14
#: Rows that are aligned at once, and their characters (a longer text is alone).
PART_ROWS = 4096
PART_CHARS = 1_000_000
#: Different pieces of text that a worker remembers, and bytes of their forms.
MEMORY_PIECES = 150_000
MEMORY_BYTES = 25_000_000
#: Ends of a piece of text behind which it isn't cut: white space to one of the libraries or another.
UNSAFE_ENDS = "᠎​﻿"


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(text: str) -> list[str]:
    """``text`` cut before each space that follows another character than white space; each space at a cut is left out.

    No token of either kind lies across such a place, so each piece, with a
    space before it, is encoded as it is within the whole text.
    """
    parts, out, start = text.split(" "), [], 0
    for i, part in enumerate(parts):
        if part and not part[-1].isspace() and part[-1] not in UNSAFE_ENDS:
            out.append(part if start == i else " ".join(parts[start : i + 1]))
            start = i + 1
    if start < len(parts):
        out.append(" ".join(parts[start:]))
    return out


#: Pieces that both libraries for the byte-level tokenizer cut alike: no white space, no letters that came late to Unicode.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]{1,200}")


def ranks_of(path: str) -> dict[bytes, int] | None:
    """The merge ranks of a byte-level vocabulary, if its ids are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, letters = model["vocab"], byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = {bytes([b]): vocab.get(c, made[0]) for c, b in letters.items()}
    if made != sorted(set(made)) or max(single.values()) >= made[0]:
        return None
    names = {i: t for t, i in vocab.items()}
    return single | {bytes(letters[c] for c in names[i]): i for i in made}


class Aligner:
    """Both tokenizers, and what they make of pieces of text: groups, links and their text form."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ranks = ranks_of(a_path)
        self.merge = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        letters = byte_letters()
        self.a_bytes = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.width = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.width))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.a_bytes, self.b_bytes))
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), self.width))]
        self.places_of_digits = len(digits[-1])
        self.digits = np.frombuffer(b"".join(d.ljust(self.places_of_digits + 1) for d in digits), dtype=np.uint8).reshape(len(digits), -1)
        self.n_digits = np.array([len(d) for d in digits])
        self.blank = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.weight = 0
        self.forms: list[bytes] = []
        self.links = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Remembers pieces not known yet; those whose bytes don't come back have no tokens."""
        plain = [bool(self.merge and PLAIN.fullmatch(p)) for p in pieces]
        others = iter(self.a.encode_batch([" " + p for p, own in zip(pieces, plain) if not own], add_special_tokens=False))
        a = [self.merge(" " + p) if own else next(others).ids for p, own in zip(pieces, plain)]
        b = [x if p else [self.blank] for p, x in zip(pieces, self.b.encode(pieces, num_threads=1))]
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        whole = b"".join([b" " + p.encode() for p in pieces])
        right = [True] * len(pieces)
        if b"".join(map(self.a_bytes.__getitem__, flat_a)) != whole or b"".join(map(self.b_bytes.__getitem__, flat_b)) != whole:
            join = lambda own, ids: b"".join([own[i] for i in ids])
            right = [join(self.a_bytes, x) == b" " + p.encode() == join(self.b_bytes, y) for p, x, y in zip(pieces, a, b)]
            a, b = ([x for x, own in zip(ids, right) if own] for ids in (a, b))
            flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        forms, links, sizes = self.aligned(np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64), np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64))
        right = np.array(right, dtype=bool)
        every = np.zeros((len(pieces), 5), np.int64)
        every[right] = sizes
        each = iter(forms)
        self.known.update(zip(pieces, range(len(self.forms), len(self.forms) + len(pieces))))
        self.forms.extend(next(each) if own else b"" for own in right)
        self.weight += sum(map(len, forms))
        self.links = np.concatenate([self.links, links])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(every[:, 3])])
        self.sizes = np.concatenate([self.sizes, every[:, [0, 1, 2, 4]]])

    def aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Forms, links and sizes (A tokens, B tokens, groups, links, 1) of pieces that follow each other: ``n_a`` and ``n_b`` tokens each."""
        if not len(a):
            return [], np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        last = ends_a[np.cumsum(n_a) - 1]
        # between neighbouring ends of either side lies one link
        edges = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
        links = a[at_a] * self.width + b[at_b]
        cuts = edges[(ends_a[at_a] == edges) & (ends_b[at_b] == edges)]
        per_piece = lambda ends: np.diff(np.searchsorted(ends, last, side="right"), prepend=0)
        sizes = np.stack([n_a, n_b, per_piece(cuts), per_piece(edges), np.ones(len(n_a), np.int64)], axis=1)
        # tokens of A, then those of B, group by group
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a] = np.where(np.append(group_a[1:] == group_a[:-1], False), ord(","), ord("|"))
        mark[place_b] = np.where(np.append(group_b[1:] == group_b[:-1], False), ord(","), ord(";"))
        size = self.n_digits[ids]
        letters = self.digits[ids]
        letters[np.arange(len(ids)), size] = mark
        text = letters[np.arange(self.places_of_digits + 1) <= size[:, None]].tobytes()
        ends = np.cumsum(size + 1)[np.cumsum(n_a + n_b) - 1].tolist()
        return [text[i : j - 1] for i, j in zip([0, *ends[:-1]], ends)], links, sizes

    def places(self, texts: list[str]) -> list[list[int]]:
        """The remembered pieces of each text, in order; all are forgotten when they are too many, at the next call."""
        if len(self.known) > MEMORY_PIECES or self.weight > MEMORY_BYTES:
            self.forget()
        cut = [pieces_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for c in cut for p in c if p not in self.known))
        if new:
            self.learn(new)
        return [[self.known[p] for p in c] for c in cut]


def aligner(a_path: str, b_path: str) -> Aligner:
    return remembered(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def aligned_rows(texts: list[str | None], tool: Aligner) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups_sha256) of each text, and all its links: place of the text, pair."""
    places = tool.places([t or "" for t in texts])
    own = np.repeat(np.arange(len(places)), [len(p) for p in places])
    flat = np.fromiter((i for p in places for i in p), dtype=np.int64, count=len(own))
    count = lambda weights: np.bincount(own, weights, minlength=len(places)).astype(np.int64)
    sizes = tool.sizes[flat]
    wrong = count(1 - sizes[:, 3]) > 0
    n_links = (tool.starts[1:] - tool.starts[:-1])[flat]
    totals = np.stack([count(sizes[:, 0]), count(sizes[:, 1]), count(sizes[:, 2]), count(n_links)], axis=1)
    totals[wrong] = 0
    rows = []
    for p, t in zip(places, totals.tolist()):
        form = b";".join([tool.forms[i] for i in p]) if t[0] else b""
        rows.append((*t, hashlib.sha256(form).hexdigest() if t[0] else ""))
    right = ~wrong[own]
    flat, own, n_links = flat[right], own[right], n_links[right]
    at = np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links) - n_links, n_links)
    return rows, np.repeat(own, n_links), tool.links[np.repeat(tool.starts[flat], n_links) + at]


ROW_FIELDS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
RUN_SCHEMA = "run long, place int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, n_docs int, pairs binary, counts binary, docs binary, times binary"


class Spill:
    """Records of a task (pair, document, times) until they make a run, parted by radix and sorted by pair and document."""

    def __init__(self, width: int, most: int) -> None:
        self.width, self.most, self.rows, self.keys, self.held = width, most, [], [], 0
        self.next = TaskContext.get().partitionId() << 32

    def add(self, rows: list[tuple], own: np.ndarray, pairs: np.ndarray) -> None:
        radix = pairs // self.width % RADIXES
        key, times = np.unique((radix << PAIR_BITS | pairs) << PLACE_BITS | (own + len(self.rows)), return_counts=True)
        self.rows.extend(rows)
        self.keys.append((key, times))
        self.held += len(key)

    def full(self) -> bool:
        return self.held >= self.most or len(self.rows) > RUN_DOCS - PART_ROWS

    def runs(self) -> Iterator[pd.DataFrame]:
        """One row for each document, and one for each radix; the run begins anew."""
        if not self.rows:
            return
        yield pd.DataFrame(self.rows, columns=["doc_id", *ROW_FIELDS], dtype=object).assign(run=self.next, place=np.arange(len(self.rows)), radix=None, n_docs=None, pairs=None, counts=None, docs=None, times=None)
        key, times = (np.concatenate(x) for x in zip(*self.keys))
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        pair, docs = key >> PLACE_BITS, (key & (1 << PLACE_BITS) - 1).astype(np.uint16)
        edges = np.searchsorted(pair >> PAIR_BITS, np.arange(RADIXES + 1))
        for radix, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
            if high > low:
                pairs, counts = np.unique(pair[low:high] & (1 << PAIR_BITS) - 1, return_counts=True)
                parts = {"pairs": packed(np.diff(pairs, prepend=0)), "counts": packed(counts.astype(np.uint16)), "docs": packed(docs[low:high]), "times": packed(times[low:high].astype(np.uint32))}
                yield pd.DataFrame([dict.fromkeys(COLUMNS) | {"run": self.next, "radix": radix, "n_docs": len(self.rows)} | parts], dtype=object)
        self.rows, self.keys, self.held, self.next = [], [], 0, self.next + 1


COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]


def spilled(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents and zstd runs of their records, in one table."""
    most = RUN_RECORDS

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_path, b_path)
        spill = Spill(tool.width, most)
        for frame in slices(frames, PART_CHARS):
            for at in range(0, len(frame), PART_ROWS):
                part = frame.iloc[at : at + PART_ROWS]
                rows, own, pairs = aligned_rows(part["text"].tolist(), tool)
                spill.add([(i, *r) for i, r in zip(part["doc_id"], rows)], own, pairs)
                if spill.full():
                    yield from (x[COLUMNS] for x in spill.runs())
        yield from (x[COLUMNS] for x in spill.runs())

    return for_python(docs).mapInPandas(read, RUN_SCHEMA)


FRAME_SCHEMA = "radix int, run long, frame int, pairs binary, counts binary"


def frames_of(pairs: list[bytes], counts: list[bytes], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames of a run, one after another."""
    for p, c in zip(pairs, counts):
        yield np.cumsum(unpacked(p, np.int64)), unpacked(c, kind).astype(np.int64)


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with the sum of their counts in all runs, by a k-way heap merge.

    The heap holds the runs by the last pair of their frame at hand; up to
    the least of these all pairs are there, are cut off every frame that has
    any, and are summed.
    """
    heap, at_hand = [], {}

    def take(run: int) -> None:
        for pairs, counts in runs[run]:
            if len(pairs):
                at_hand[run] = (pairs, counts)
                heapq.heappush(heap, (int(pairs[-1]), run))
                return
        at_hand.pop(run, None)

    for run in range(len(runs)):
        take(run)
    while heap:
        last = heap[0][0]
        parts = []
        for run, (pairs, counts) in at_hand.items():
            n = int(np.searchsorted(pairs, last, side="right"))
            parts.append((pairs[:n], counts[:n]))
            at_hand[run] = (pairs[n:], counts[n:])
        pairs, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, back, np.concatenate([c for _, c in parts]))
        yield pairs, sums
        while heap and heap[0][0] <= last:
            take(heapq.heappop(heap)[1])


def framed(stream: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stream in frames of about ``FRAME_PAIRS`` pairs."""
    held, n = [], 0
    for part in stream:
        held.append(part)
        n += len(part[0])
        while n >= FRAME_PAIRS:
            pairs, counts = (np.concatenate(x) for x in zip(*held))
            yield pairs[:FRAME_PAIRS], counts[:FRAME_PAIRS]
            held, n = [(pairs[FRAME_PAIRS:], counts[FRAME_PAIRS:])], n - FRAME_PAIRS
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def by_side(stream: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The stream with the greatest count of each pair's A id; pairs are A-major, so only the last id's are held back."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in stream:
        pairs, counts = np.concatenate([held[0], part[0]]), np.concatenate([held[1], part[1]])
        cut = int(np.searchsorted(pairs, pairs[-1] // width * width))
        yield from with_best(pairs[:cut], counts[:cut], width)
        held = pairs[cut:], counts[cut:]
    yield from with_best(*held, width)


def with_best(pairs: np.ndarray, counts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if len(pairs):
        starts = np.flatnonzero(np.diff(pairs // width, prepend=-1))
        yield pairs, counts, np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(pairs)))


def merge_runs(runs: DataFrame, width: int) -> DataFrame:
    """radix, frame, pairs, counts, best: all pairs with their counts and the greatest of their A id.

    Runs are merged by up to about ``FAN_IN`` at a time, round after round,
    so that no task has more than that, whatever the corpus; the frames of
    the last round hold each pair once.
    """
    now = runs.select("radix", "run", F.lit(0).alias("frame"), "pairs", F.lit(16).alias("bits"), "counts")

    def streams(group: pd.DataFrame) -> list[Iterator[tuple[np.ndarray, np.ndarray]]]:
        kinds = {16: np.uint16, 64: np.int64}
        return [frames_of(r["pairs"], r["counts"], kinds[r["bits"].iloc[0]]) for _, r in group.sort_values(["run", "frame"]).groupby("run")]

    def some(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(group["radix"].iloc[0]), int(group["lot"].iloc[0]), k, packed(np.diff(p, prepend=0)), 64, packed(c)) for k, (p, c) in enumerate(framed(merged(streams(group))))]
        return pd.DataFrame(rows, columns=["radix", "run", "frame", "pairs", "bits", "counts"])

    def all_(group: pd.DataFrame) -> pd.DataFrame:
        frames = framed_by_side(by_side(merged(streams(group)), width))
        rows = [(int(group["radix"].iloc[0]), k, packed(np.diff(p, prepend=0)), packed(c), packed(c == best)) for k, (p, c, best) in enumerate(frames)]
        return pd.DataFrame(rows, columns=["radix", "frame", "pairs", "counts", "best"])

    made = []
    while (n := now.select("run").distinct().count()) > FAN_IN:
        lot = F.pmod(F.xxhash64("run"), F.lit(-(-n // FAN_IN * 2)))
        now = stored(now.withColumn("lot", lot).groupBy("radix", "lot").applyInPandas(some, "radix int, run long, frame int, pairs binary, bits int, counts binary"), "merged")
        made.append(now)
    out = stored(now.groupBy("radix").applyInPandas(all_, "radix int, frame int, pairs binary, counts binary, best binary"), "pair-counts")
    discard(*made)
    return out


def framed_by_side(stream: Iterator[tuple]) -> Iterator[tuple]:
    """The stream with its greatest counts in frames of ``FRAME_PAIRS`` pairs or a few more."""
    held, n = [], 0
    for part in stream:
        held.append(part)
        n += len(part[0])
        if n >= FRAME_PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def shares(runs: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
    """What the counts of one radix add to the documents of each run: links with the A id's greatest count, sum of counts."""
    frames = frames.sort_values("frame")
    pairs = np.concatenate([np.cumsum(unpacked(p, np.int64)) for p in frames["pairs"]])
    counts = np.concatenate([unpacked(c, np.int64) for c in frames["counts"]])
    best = np.concatenate([unpacked(b, np.bool_) for b in frames["best"]])
    out = []
    for r in runs.itertuples(index=False):
        at = np.repeat(np.searchsorted(pairs, np.cumsum(unpacked(r.pairs, np.int64))), unpacked(r.counts, np.uint16))
        docs, times = unpacked(r.docs, np.uint16), unpacked(r.times, np.uint32).astype(np.int64)
        n_best, count_sum = np.zeros(r.n_docs, np.int64), np.zeros(r.n_docs, np.int64)
        np.add.at(n_best, docs, times * best[at])
        np.add.at(count_sum, docs, times * counts[at])
        out.append((r.run, packed(n_best), packed(count_sum)))
    return pd.DataFrame(out, columns=["of", "n_best", "count_sum"])


def summed(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """The documents of a run with the sums of what all radixes add."""
    place, zero = rows["place"].to_numpy(), np.zeros(len(rows), np.int64)
    sums = {c: sum((unpacked(x, np.int64) for x in parts[c]), zero)[place] if len(rows) else zero for c in ("n_best", "count_sum")}
    return rows[["doc_id", *ROW_FIELDS]].assign(**sums)


def align_tokenizers(docs: DataFrame, a_path: str = BYTE_TOKENIZER, b_path: str = PIECE_TOKENIZER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    A space and the text are encoded by a byte-level tokenizer (A), the text
    by a piece tokenizer (B, which adds the space). Byte offsets at which
    tokens of both end cut them into groups; tokens of A and B whose bytes
    overlap are linked. The count of a pair of ids is the number of
    documents of the corpus that hold it linked.

    External spill counting: a task gathers records (pair, document, times)
    until they make a run, parts them by the low bits of the A id, sorts them
    and writes them as zstd frames to the shared folder. The counts of the
    runs, one entry for each pair and run, are merged by heaps, up to
    ``FAN_IN`` runs at a time, until each radix has each pair once; as pairs
    are in A-major order, the greatest count of an A id is known when its
    last pair has passed. The runs are then read once more, in parts of a
    radix, and what the counts add to each document streams back by run. So
    a pair that all documents hold is one entry of each run, and memory is
    bounded by a run, ``FAN_IN`` frames or the pairs of one radix.

    Texts that are null or empty, or whose tokens' bytes differ from the
    text (a literal U+2581), have zeros and ''. Repeated rows and rows of one
    doc_id are documents of their own; a null doc_id stays null. An empty
    table gives an empty result. Other columns aren't looked at.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    table = stored(spilled(docs, a_path, b_path), "runs")
    runs = table.filter(F.col("radix").isNotNull()).select("run", "radix", "n_docs", "pairs", "counts", "docs", "times")
    counts = merge_runs(runs, width)
    lots = F.lit(max(1, -(-runs.select("run").distinct().count() // FAN_IN)))
    dealt = runs.withColumn("lot", F.pmod(F.xxhash64("run"), lots))
    copies = counts.select(F.col("radix").alias("of_radix"), "frame", "pairs", "counts", "best", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("of_lot"))
    parts = dealt.groupBy("radix", "lot").cogroup(copies.groupBy("of_radix", "of_lot")).applyInPandas(lambda a, b: shares(a, b) if len(a) else pd.DataFrame({"of": [], "n_best": [], "count_sum": []}), "of long, n_best binary, count_sum binary")
    rows = table.filter(F.col("radix").isNull()).select("run", "place", "doc_id", *ROW_FIELDS)
    parts = stored(parts, "shares")
    out = rows.groupBy("run").cogroup(parts.groupBy("of")).applyInPandas(summed, "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    out = stored(whole_ids(out).select("doc_id", *ROW_FIELDS[:4], "n_best", "count_sum", "groups_sha256"), "aligned")
    discard(table, counts, parts)
    return out


def linked_ids(docs: DataFrame, a_path: str = BYTE_TOKENIZER, b_path: str = PIECE_TOKENIZER) -> DataFrame:
    """a_id, b_id, n_docs, best: every linked pair of ids of the corpus, in how many documents it is, and whether no B id has more with that A id.

    This is the table by which ids (or rows of embeddings) of one vocabulary
    are carried over to the other. Rows of ``docs`` are read as by
    :func:`align_tokenizers`; an empty table gives an empty result.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    table = stored(spilled(docs, a_path, b_path), "runs")
    counts = merge_runs(table.filter(F.col("radix").isNotNull()), width)
    discard(table)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                pairs = np.cumsum(unpacked(r.pairs, np.int64))
                yield pd.DataFrame({"a_id": pairs // width, "b_id": pairs % width, "n_docs": unpacked(r.counts, np.int64), "best": unpacked(r.best, np.bool_)})

    return counts.select("pairs", "counts", "best").mapInPandas(read, "a_id long, b_id long, n_docs long, best boolean")

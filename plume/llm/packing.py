"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm.common import discard, for_python, remembered, slices, stored, whole_ids

CAPACITY = 4096
END = 1
#: Pieces that are packed together in one task.
CHUNK_PIECES = 1 << 15
#: Text parts whose ids a worker remembers; then it starts anew.
REMEMBERED_WORDS = 400_000

#: Parts of printable ASCII and Latin letters, which no normal form changes.
PLAIN = re.compile(r"[!-~\u00a1-\u024f]+")
#: Texts of such parts between spaces and line ends.
PLAIN_TEXT = re.compile(r"[!-~\u00a1-\u024f \n]*")
#: The pieces that this tokenizer's file asks for, fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same in plain texts in lower case, of which a few letters are beyond U+024F: letters, numbers and other signs by name.
LETTERS, NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u2c65\u2c66", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PLAIN_PIECES = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PartIds:
    """Ids of text parts without spaces as bytes, remembered within a worker.

    A piece's merges depend on their ranks alone, so plain parts are merged
    by ``tiktoken`` under the same ranks (a NUL stands for the end of a
    word), all new pieces at once; other parts go to ``tokenizers``. A plain
    text is cut into pieces at once, so that only these are remembered, each
    without its capitals and the signs beside it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        codes = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if not token.startswith("<|"):
                core = token.removesuffix("</w>")
                ranks[bytes(codes[c] for c in core) + b"\0" * (core != token)] = rank
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.last[[r for b, r in ranks.items() if len(b) > 1 and b.endswith(b"\0")]] = True
        self.parts: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def learn_pieces(self, new: list[str]) -> None:
        if new:
            ids = np.array(self.merger.encode_ordinary("\0".join(new) + "\0"), dtype="<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            flat = ids.tobytes()
            self.pieces.update(zip(new, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if PLAIN.fullmatch(p) and "<|" not in p]
        cut = {p: PIECES.findall(p.lower()) for p in plain}
        self.learn_pieces(list({x for found in cut.values() for x in found if x not in self.pieces}))
        for part, found in cut.items():
            self.parts[part] = b"".join([self.pieces[x] for x in found])
        if odd := [p for p in parts if p not in cut]:
            for part, code in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
                self.parts[part] = np.array(code.ids, dtype="<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) + len(self.pieces) > REMEMBERED_WORDS:
            self.parts, self.pieces = {"": b""}, {}
        plain = [PLAIN_TEXT.fullmatch(t) is not None and "<|" not in t for t in texts]
        split = [PLAIN_PIECES.findall(t.lower()) if p else t.replace("\n", " ").split(" ") for t, p in zip(texts, plain)]
        self.learn_pieces(list(set().union(*[x for x, p in zip(split, plain) if p]).difference(self.pieces)))
        if new := set().union(*[x for x, p in zip(split, plain) if not p]).difference(self.parts):
            self.learn(list(new))
        return [b"".join(map((self.pieces if p else self.parts).__getitem__, x)) for x, p in zip(split, plain)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    This tokenizer drops white space and never joins across it, so a text's
    ids are those of its parts between spaces and line ends, one after
    another.
    """
    return remembered(f"parts of {path}", lambda: PartIds(path)).of(texts)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then ``end``; a null or empty text is
    ``end`` alone. Only documents over ``capacity`` are cut.
    """
    path, last = tokenizer or default_tokenizer(), np.array([end], dtype="<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = []
            for doc_id, ids in zip(frame["doc_id"], token_bytes([t or "" for t in frame["text"]], path)):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    return whole_ids(for_python(docs).mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long"))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given.

    With N(g) open bins of gap g, a length s goes to a bin of gap g, or to a
    new one, so that the sum of N(g)^2 over the gaps between 0 and the
    capacity becomes smallest; of equals, to the smallest gap, and to a new
    bin last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for k, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            change = 2 * (count[: capacity - s + 1] - count[s:]) + 2  # from gap g = s + index to gap g - s
            change[0] -= 1  # a bin that becomes full isn't open
            change[:-1][count[s:capacity] == 0] = np.iinfo(np.int64).max
            change[-1] = 2 * count[capacity - s] + 1
            gap = int(change.argmin()) + s
        if gap == capacity:
            at, opened = opened, opened + 1
        else:
            at = stacks[gap].pop()
            count[gap] -= 1
        if gap > s:
            stacks[gap - s].append(at)
            count[gap - s] += 1
        bins[k], offsets[k] = at, capacity - gap
    return bins, offsets


def pack(pieces: DataFrame, chunks: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces are dealt to ``chunks`` groups by a hash of their values and of a
    running number (equal rows go to all groups alike), so that no task
    holds more than about its share, and each group is packed by the
    sum-of-squares rule twice: in an order that is random (by hash), which
    suits many pieces, and from long to short, which suits few. The packing
    with fewer sequences stays.
    """
    keys = F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("shuffle", keys).withColumn("chunk", F.pmod("shuffle", F.lit(chunks)))
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    columns = [*pieces.columns, "sequence_id", "offset"]
    schema = f"{', '.join(f'`{n}` {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long".replace("`doc_id` bigint", "`doc_id` string")

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["shuffle", "doc_id", "piece"], kind="stable")
        lengths = frame["length"].to_numpy()
        down = np.argsort(-lengths, kind="stable")
        best = None
        for order in (np.arange(len(lengths)), down):
            bins, offsets = sum_of_squares(lengths[order], capacity)
            if best is None or bins.max() < best[1].max():
                best = order, bins, offsets
        order, bins, offsets = best
        out = frame.iloc[order]
        return out.assign(sequence_id=(int(out["chunk"].iloc[0]) << 32) + bins, offset=offsets)[columns]

    return stored(whole_ids(dealt.groupBy("chunk").applyInPandas(place, schema)).select(columns), "sequences")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Offsets within a sequence are gapless from 0.

    The groups are as many as the pieces ask for, not the documents: a few
    very long ones are many groups. A null or empty text is one piece of one
    token. Repeated rows are packed each for itself. An empty table gives an empty result; columns besides
    doc_id and text aren't read.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end), "pieces")
    out = pack(pieces, max(1, -(-pieces.count() // CHUNK_PIECES)), capacity)
    discard(pieces)
    return out

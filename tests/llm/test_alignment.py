"""Cross-tokenizer alignment against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from fixture import documents, empty, texts
from oracle import SF
from tokenizers import Tokenizer

from plume.llm import alignment, queries


def tokens(text):
    """A and B tokens of a whole text as (id, bytes), or nothing."""
    if not text:
        return [], []
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


A = Tokenizer.from_file(alignment.BYTE_TOKENIZER)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_TOKENIZER)


def brute_force(rows):
    """The result's rows by doc_id and text, and the counts of pairs."""
    each, holding = [], Counter()
    for text in rows:
        a, b = tokens(text)
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
        links = [(i, j) for (i, x), e in zip(a, ends_a) for (j, y), f in zip(b, ends_b) if min(e, f) > max(e - len(x), f - len(y))] if len(a) * len(b) < 4e6 else None
        if links is None:  # long texts: the same by segments
            edges = np.union1d(ends_a, ends_b)
            links = list(zip((a[k][0] for k in np.searchsorted(ends_a, edges)), (b[k][0] for k in np.searchsorted(ends_b, edges))))
        groups, low = [], (0, 0)
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            high = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            groups.append("|".join(",".join(str(i) for i, _ in side[m:n]) for side, m, n in zip((a, b), low, high)))
            low = high
        holding.update(set(links))
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (i, _), n in holding.items():
        most[i] = max(most[i], n)
    out = [(na, nb, ng, len(ls), sum(holding[x] == most[x[0]] for x in ls), sum(holding[x] for x in ls), sha) for na, nb, ng, ls, sha in each]
    return out, holding, most


FIELDS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def assert_right(spark_rows, ids_and_texts):
    got = sorted((str(r.doc_id), *[r[f] for f in FIELDS]) for r in spark_rows)
    want, _, _ = brute_force([t for _, t in ids_and_texts])
    assert got == sorted((str(i), *w) for (i, _), w in zip(ids_and_texts, want))


def odd_texts(seed, n):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r\n", " \n ", " ", "　", "᠎", "\x1c", "\x85", "the", "The", "don't", "'s", "naïve", "été", "123", "4567.89", "日本語", "🙂", "<|endoftext|>", "<s>", "<unk>", "x" * 40, "....", "--", "_", "é", "​", "ﬁ", "Ⅷ", "\x00", "▁"]
    return ["".join(r.choice(parts[: len(parts) - (k % 3 > 0)]) for _ in range(r.randrange(1, 40))) for k in range(n)]


def test_given_documents_against_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert_right(queries.op12_alignment(spark, SF).collect(), docs)


def test_odd_texts_against_whole_texts(spark):
    rows = [(k, t, "s") for k, t in enumerate(odd_texts(1, 600))]
    assert_right(alignment.align_tokenizers(documents(spark, rows)).collect(), [(k, t) for k, t, _ in rows])


def test_awkward_rows_and_texts_without_breaks(spark):
    rows = texts() + [(101, "a" * 60_000, "s"), (102, " " * 60_000, "s"), (103, "ab " * 30_000, "s"), (104, "x" + " \n" * 20_000, "s"), (105, "a ▁ b", "s")]
    got = alignment.align_tokenizers(documents(spark, rows)).collect()
    assert_right(got, [(i, t) for i, t, _ in rows])
    assert {r.n_a for r in got if r.doc_id in (6, 7, 105)} == {0}
    assert alignment.align_tokenizers(empty(spark)).count() == 0


def test_many_runs_and_rounds_of_merges(spark, monkeypatch):
    for name, value in (("RUN_RECORDS", 300), ("FAN_IN", 3)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(k, t, "s") for k, t in enumerate(odd_texts(2, 60))] + [(1000 + k, "the same words of all", "s") for k in range(300)]
    assert_right(alignment.align_tokenizers(documents(spark, rows).repartition(9)).collect(), [(k, t) for k, t, _ in rows])


def test_linked_ids(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    _, holding, most = brute_force([t for _, t in docs])
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.linked_ids(documents(spark, [(i, t, "s") for i, t in docs])).collect()}
    assert got == {x: (n, n == most[x[0]]) for x, n in holding.items()}


def test_heap_merge_of_frames():
    r = np.random.default_rng(3)
    runs = [sorted({int(x) for x in r.integers(0, 500, 80)}) for _ in range(7)]
    want = Counter(x for run in runs for x in run)
    streams = [iter([(np.array(run[k : k + 9]), np.ones(len(run[k : k + 9]), np.int64)) for k in range(0, len(run), 9)]) for run in runs]
    got = [(int(p), int(c)) for pairs, counts in alignment.merged(streams) for p, c in zip(pairs, counts)]
    assert got == sorted(want.items())
    best = [(int(p), int(b)) for pairs, _, most in alignment.by_side(iter([(np.array([p]), np.array([c])) for p, c in got]), 10) for p, b in zip(pairs, most)]
    assert best == [(p, max(c for q, c in got if q // 10 == p // 10)) for p, _ in got]

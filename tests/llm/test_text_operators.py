import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from fixture import documents, empty, texts
from oracle import SF, assert_same
from pyspark.sql import functions as F

from plume.llm import common, components, mixing, near_duplicates, oracles, packing, personal, quality_rules, queries, secrets, substrings

BLANK = b" \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.queries()[name], oracles.ORACLE[name])


def test_repeats_against_brute_force(spark):
    rows = [r for r in texts() if r[0] is not None]
    seen, want = {}, {}
    for doc_id, text, _ in sorted(set(rows), key=lambda r: r[0]):
        w = split(text)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (doc_id, s)) != (doc_id, s):
                gone[s : s + 20] = True
        kept = [x for x, g in zip(w, gone) if not g]
        want[doc_id] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    got = substrings.remove_repeats(documents(spark)).collect()
    assert len(got) == len(texts())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0
    assert want[2][1] == 120 and want[5][1] >= 60
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_batches_are_bounded_by_characters():
    import pandas as pd

    frame = pd.DataFrame({"text": ["a" * 10, None, "b" * 25, "c" * 4, "d" * 4, ""], "k": range(6)})
    parts = [p["k"].tolist() for p in common.slices(iter([frame]), 12)]
    assert parts == [[0, 1], [2], [3, 4, 5]]
    assert list(common.slices(iter([frame.iloc[:0]]))) == []


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    substrings.remove_repeats(empty(spark)).count()
    assert spark.conf.get(key) == before


def test_equal_windows_have_equal_anchors():
    random = np.random.default_rng(0)
    for trial in range(30):
        h = random.integers(0, 6 if trial % 2 else 1 << 60, 200).astype(np.uint64)
        h[120:150] = h[20:50]
        name, at, number, *_ = substrings.anchors(h, np.zeros(200, bool))
        of = np.repeat(name, number)
        assert len(of) == 181
        assert (of[20:31] == of[120:131]).all()


def test_surroundings_of_a_popular_phrase_stay(spark):
    """Two texts with one phrase whose surroundings' prints once met in 32 bits."""
    first = "a921674 a693978 a706213 a42771 a852523 all of the rights in this text are reserved b504181 b331350 b176770 b203641 b876166 b661359"
    second = "a285268 a373495 a249392 a685464 a829541 all of the rights in this text are reserved b597816 b631399 b559278 b433988 b242998 b10224"
    got = substrings.remove_repeats(documents(spark, [(1, first, "s"), (2, second, "s"), (3, first, "s")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 20}


def test_high_symbols_of_many_texts_differ():
    """300,000 texts of 20 words with one phrase of nine in common: no two have the same symbols."""
    r = np.random.default_rng(4)
    n, phrase = 300_000, r.integers(0, 1 << 62, 9).astype(np.uint64)
    h = np.zeros((n, 21), np.uint64)
    h[:, :20] = r.integers(0, 1 << 62, (n, 20))
    h[:, 5:14] = phrase
    wall = np.zeros((n, 21), bool)
    wall[:, 20] = True
    name, _, _, short, long = substrings.anchors(h.ravel(), wall.ravel())
    symbols = np.stack([name, short, long], axis=1)
    assert len(symbols) == n == len(np.unique(symbols, axis=0))


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = [(i, shingles(t, n)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (doc_id, _) in enumerate(sets):
        members.setdefault(find(i), []).append(doc_id)
    return {d: min(m) for m in members.values() for d in m}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rows = [r for r in texts() if r[0] is not None]
    want = brute_components(rows, n)
    got = near_duplicates.near_duplicates(documents(spark), n=n).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_rows_without_doc_id_are_linked(spark):
    """Null ids, equal rows and two texts of one id: one row of each group stays."""
    base = " ".join(f"v{k}" for k in range(80))
    near = base.replace("v40", "x")
    other = " ".join(f"z{k}" for k in range(80))
    rows = [(None, base, "s"), (None, near, "s"), (None, other, "t"), (5, other, "s"), (5, base, "s"), (5, base, "s"), (7, "", "s"), (7, "", "s")]
    out = near_duplicates.one_of_each_group(documents(spark, rows), n=2).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(5, base), (5, other), (7, ""), (7, "")])
    got = near_duplicates.near_duplicates(documents(spark, [r for r in rows if r[0] is None]), n=2).collect()
    assert all(r.component_id is None for r in got) and len(got) == 3
    nameless = near_duplicates.one_of_each_group(documents(spark, [r for r in rows if r[0] is None]), n=2)
    assert nameless.count() == 2 and nameless.columns == documents(spark).columns
    assert near_duplicates.one_of_each_group(empty(spark)).count() == 0


def test_components_of_a_chain_a_hub_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000 + i, 1000) for i in range(1, 500)] + [(7, 7), (9, 8)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(1000, 1500), 1000), 8: 8, 9: 8}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Over a list's length, with edits that part some members from most others."""
    random = np.random.default_rng(1)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in random.integers(0, 150, int(random.integers(0, 16))):
            w[k] = f"x{random.integers(1000)}"
        rows.append((i, " ".join(w), "s"))
    got = near_duplicates.near_duplicates(documents(spark, rows), n=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 2)


def test_a_star_around_a_common_text(spark):
    """Copies with long tails of their own are linked with the common text alone, over values that all share."""
    common = [f"c{k}" for k in range(501)]
    rows = [(i, " ".join(common + [f"t{i}x{k}" for k in range(124 if i else 0)]), "s") for i in range(2000)]
    # every text holds the 500 shingles of the common one, and those beyond them are its own
    assert 100 * 500 >= 80 * (500 + 124) and 100 * 500 < 80 * (500 + 2 * 124)
    assert len(set().union(*(shingles(t, 2) for _, t, _ in rows[1:]))) == 500 + 1999 * 124
    got = near_duplicates.near_duplicates(documents(spark, rows), n=2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict.fromkeys(range(2000), 0)
    assert brute_components(rows[:150], 2) == dict.fromkeys(range(150), 0)


@pytest.mark.parametrize("own", [[0] * 9, [0, 1, 0, 1, 1, 0, 1, 0, 1]])
def test_links_of_blocks(own):
    """All within one block; of two, those across only."""
    random = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(40), random.integers(0, 60, 6)])).astype(np.uint64) for _ in own]
    own, sizes = np.array(own), np.array([len(s) for s in sets])
    wide = {(i, j) for i in range(9) for j in range(9) if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j])) and (own.max() == 0 or own[i] != own[j])}
    root = list(range(9))
    for _ in range(9):
        for i, j in wide:
            root[i] = root[j] = min(root[i], root[j])
    got = near_duplicates.group_links(np.arange(9), sizes, sets, 90, own)
    assert {**dict(zip(range(9), range(9))), **dict(got)} == dict(enumerate(root)) and len(got) == len(dict(got))


def test_lists_of_a_template_are_dealt_by_number(spark):
    """Many classes with shared values and no links: no task gets more than two blocks of classes."""
    common = " ".join(f"c{k}" for k in range(70))
    rows = [(i, common + "".join(f" t{i}x{k}" for k in range(30)), "s") for i in range(3000)]
    seen = spark.sparkContext.accumulator(0)
    most = near_duplicates.group_links

    def watched(keys, sizes, sets, percent, own):
        seen.add(1)
        assert max(np.bincount(own - own.min())) <= 1.2 * near_duplicates.BLOCK_CLASSES
        return most(keys, sizes, sets, percent, own)

    near_duplicates.group_links = watched
    try:
        got = near_duplicates.near_duplicates(documents(spark, rows), n=2).collect()
    finally:
        near_duplicates.group_links = most
    assert all(r.component_id == r.doc_id for r in got) and seen.value > 1


def test_long_lists_of_unlike_texts_move_no_sets(spark):
    """Many texts share values, but too few for a link: no full set is compared in blocks, and near copies are still found."""
    random = np.random.default_rng(5)
    rows = []
    for i in range(600):
        own = [f"t{i}x{k} u{i}x{k}" for k in range(10)] + [f"c{k} d{k}" for k in random.choice(160, 100, replace=False)]
        random.shuffle(own)
        rows.append((i, " ".join(own), "s"))
    rows += [(600 + i, rows[i][1].replace(f"t{i}x3 ", "y "), "s") for i in range(5)]
    seen = spark.sparkContext.accumulator(0)
    most = near_duplicates.group_links

    def watched(*of):
        seen.add(1)
        return most(*of)

    near_duplicates.group_links = watched
    try:
        got = near_duplicates.near_duplicates(documents(spark, rows), n=2).collect()
    finally:
        near_duplicates.group_links = most
    assert {r.doc_id: r.component_id for r in got} == {i: i % 600 if i < 605 else i for i in range(605)} == brute_components(rows, 2)
    assert seen.value == 0


def test_marks_of_linked_sets_differ_little():
    random = np.random.default_rng(6)
    fresh = lambda n: np.unique(random.integers(0, 1 << 64, n, dtype=np.uint64))
    for m in (49, 80, 300, 3000):
        limit = near_duplicates.most_apart(min(m * 100 // 80, near_duplicates.MARKS), 0.8)
        columns = {"value": 1, "low": 0, "high": 0, "own": 0, "m": m}
        for _ in range(100):
            union = fresh(m * 10 // 8)
            part = np.sort(random.permutation(union)[: -(-8 * len(union) // 10)])
            marks = [near_duplicates.set_marks(x) for x in (union, part, fresh(m))]
            apart = [np.unpackbits((marks[0] ^ x).view(np.uint8)).sum() for x in marks[1:]]
            assert apart[0] <= limit < near_duplicates.MARKS // 2
            assert m < 300 or apart[1] > limit
            frame = pd.DataFrame({**columns, "class": [1, 2, 3], **{f"marks{k}": [x[k] for x in marks] for k in range(4)}})
            (got,) = near_duplicates.marked_pairs(80)(iter([frame]))
            pairs = set(zip(got["a"], got["b"]))
            assert (1, 2) in pairs and (m < 300 or pairs == {(1, 2)}) and not got["crowded"].any()
    assert near_duplicates.most_apart(256, 1.0) == 0


def test_short_near_copies_meet_one_of_their_list(spark):
    """Nothing is left for the blocks once all are linked with one class of the list."""
    common = " ".join(f"c{k}" for k in range(9))
    rows = [(i, f"{common} t{i}", "s") for i in range(5000)]
    got = near_duplicates.near_duplicates(documents(spark, rows), n=2).collect()
    assert {r.component_id for r in got} == {0}


def test_masses_of_tiny_texts(spark):
    """A shingle that most texts share, in sets too small for any link but equality."""
    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common start t"), F.col("id") - F.col("id") % 2).alias("text"))
    got = near_duplicates.near_duplicates(docs, n=2)
    assert got.filter("component_id <> doc_id - doc_id % 2 or n_shingles <> 2").count() == 0


def test_quality_rules(spark):
    filler = "the cat and the dog of a house in it was on "
    more = [(200 + k, filler * 6 + " ".join(f"u{k}{j}" for j in range(60)) + tail, "s") for k, tail in enumerate(("", " wow!" * 60, " | x" * 60, " ###" * 70, "\nsame line" * 80))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts() + more)).collect()}
    for doc_id, text, _ in texts() + more:
        w = [x.decode() for x in split(text)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), doc_id
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.n_symbols == sum(c in quality_rules.SYMBOLS for c in text or "")
        n = max(len(w), 1)
        ratios = {
            "n_words": len(w), "mean_word": sum(map(len, w)) / n, "symbol_ratio": r.n_symbols / n, "mark_ratio": sum(x.endswith("!") or x == "|" for x in w) / n,
            "stop_ratio": sum(x.lower() in quality_rules.STOP_WORDS for x in w) / n, "dup_line_ratio": r.n_dup_lines / max(len(lines), 1),
        }
        within = all((low is None or ratios[m] >= low) and (high is None or ratios[m] <= high) for _, m, low, high in quality_rules.RULES)
        assert r.kept == (within and not r.base_failed)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def test_secrets_against_python(spark):
    assign = re.compile(secrets.ASSIGN, re.ASCII)
    got = secrets.secrets(documents(spark)).collect()
    want = {}
    for doc_id, text, _ in texts():
        t = text or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want[doc_id] = digest(s, secrets.KINDS)
    assert {r.doc_id: r.base_sha256 for r in got} == want
    assert secrets.secrets(empty(spark)).count() == 0


def test_the_battery_adds_random_strings_only(spark):
    random = np.random.default_rng(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(letters[i] for i in random.integers(0, 62, 40)) for _ in range(20)]
    plain = ["internationalization-and-more", "anotherverylongnaturalwordhere", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Some-Hyphenated-Headline-Of-Words"]
    rows = [(i, f"see {k} there", "s") for i, k in enumerate(keys)] + [(100 + i, f"see {plain[i % 4]} there", "s") for i in range(400)]
    got = {r.doc_id: r.spans for r in secrets.secrets(documents(spark, rows)).collect()}
    found = sum(got[i] == "random:4:44" for i in range(20))
    assert found >= 18
    assert not any(got[100 + i] for i in range(400))


def battery(token):
    """The three tests in plain Python."""
    t = token.rstrip("=")
    n = len(t)
    digits, capitals, small, others = next(own for _, pattern, own in secrets.ENCODINGS if re.search(pattern, t))
    size = digits + capitals + small + others
    two = lambda z: math.erfc(min(abs(z), 30) / math.sqrt(2))
    chi = sum(c * c for c in Counter(t).values()) * size / n - n
    df = size - 1
    uniform = two((max(chi, 0) / df) ** (1 / 3) / math.sqrt(2 / (9 * df)) - (1 - 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    change = 1 - sum((c / size) ** 2 for c in (digits, capitals, small, others))
    runs = two((len(re.findall(secrets.CLASS_RUNS, t)) - 1 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change)))
    codes = np.array([ord(c) for c in t], dtype=float)
    codes -= codes.mean()
    var = (codes**2).sum()
    serial = two((codes[1:] * codes[:-1]).sum() / var * math.sqrt(n)) if var > 0 else 0.0
    return min(1.0, 3 * min(uniform, runs, serial))


ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "small base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def test_battery_against_python(spark):
    random = np.random.default_rng(8)
    tokens = ["".join(random.choice(list(a), n)) for a in ALPHABETS.values() for n in (20, 31, 64)] + ["a" * 30, "internationalization-and-more", "0123456789abcdefghijklmnopqrstuv", "QUJDREVGRw0123456789xyz=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(battery(r.t), rel=1e-3, abs=1e-6), r.t


def test_random_strings_of_every_encoding_are_found(spark):
    random = np.random.default_rng(6)
    lengths = {"hex": 28, "HEX": 30}
    keys = [(name, "".join(random.choice(list(a), lengths.get(name, 44)))) for name, a in ALPHABETS.items() for _ in range(12)]
    keys = [(name, k + ("==" if name == "base64" else "")) for name, k in keys]
    plain = ["internationalization-and-more", "anotherverylongnaturalwordhere", "THISISALONGHEADLINEOFWORDS", "Some-Hyphenated-Headline-Of-Words", "abcabcabcabcabcabcabcabc", "00000000000000000000001", "AbAbAbAbAbAbAbAbAbAbAbAb"]
    rows = [(i, f"see {k} there", "s") for i, (_, k) in enumerate(keys)] + [(1000 + i, f"see {plain[i % 7]} there", "s") for i in range(700)]
    got = {r.doc_id: r.spans for r in secrets.secrets(documents(spark, rows)).collect()}
    found = Counter(name for i, (name, k) in enumerate(keys) if got[i] == f"random:4:{4 + len(k)}")
    assert all(found[name] >= 9 for name in ALPHABETS), found
    assert not any(got[1000 + i] for i in range(700))


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


#: The forms as they are asked for.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
MENTION = (
    r"(?<![^\x20\x09-\x0D])(?:(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]+\)[\x20.-]?[0-9][0-9.-]*[^\x20\x09-\x0D]*"
    r"|\+?[0-9]{1,4}(?:\x20[0-9]{2,4}){2,}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)"
)


def test_forms_match_as_asked_for_on_random_strings(spark):
    """The possessive patterns against the plain ones."""
    r = np.random.default_rng(11)
    for pattern, plain, letters in ((personal.EMAIL, EMAIL, "ab1.@-_% "), (personal.IP, IP, "12..  x"), (personal.MENTION, MENTION, "1234()+.- a@")):
        rows = [(k, "".join(r.choice(list(letters), r.integers(1, 40)))) for k in range(6000)]
        got = spark.createDataFrame(rows, "k int, t string").select("k", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m")).collect()
        assert {x.k: x.m for x in got} == {k: [m[0] for m in re.finditer(plain, t)] for k, t in rows}


HARD = {
    "labels": "a@b" + ".c" * 500_000, "letters": "a" * 1_000_000 + "@", "digits": "1" * 1_000_000 + " 1.1", "groups": "1" + " 22" * 350_000, "dots": "1." * 500_000,
    "marks": "x1" + "!" * 1_000_000 + "a", "at": "a@" * 500_000, "base64": "Ab1/" * 250_000, "brackets": "(1" * 500_000, "plus": "+1" * 500_000, "spaces": "1" + " " * 1_000_000 + "2", "hex": "0a" * 500_000, "tokens": "token=" * 160_000,
}


def test_megabytes_of_one_kind_take_seconds(spark):
    """Fixed forms, contexts, secrets and masks take time that grows with the text, and no stack."""
    docs = documents(spark, [*[(k, HARD[name], "s") for k, name in enumerate(sorted(HARD))], (99, "mail x.y@z.org now", "s")])
    began = time.monotonic()
    got = {r.doc_id: r for r in personal.personal(docs).collect()}
    assert {name: got[k].n_email for k, name in enumerate(sorted(HARD))} == {name: int(name == "labels") for name in HARD}
    assert got[99].n_email == 1
    assert len(secrets.secrets(docs).collect()) == len(HARD) + 1
    assert {r.doc_id: r.text for r in personal.redact(docs).collect()}[99] == "mail <email> now"
    assert time.monotonic() - began < 150


def test_personal_against_python(spark):
    only = lambda m: re.sub("[^0-9]", "", m)
    want = {}
    for doc_id, text, _ in texts():
        t = text or ""
        s = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, t)]
        s += [(m.start(), 1, m.end()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
        s += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
        s += [(m.start(), 3, m.end()) for m in re.finditer(personal.PHONE, t) if 10 <= len(only(m[0])) <= 15]
        want[doc_id] = digest(s, personal.KINDS)
    assert {r.doc_id: r.base_sha256 for r in personal.personal(documents(spark)).collect()} == want
    assert personal.personal(empty(spark)).count() == 0


def test_contexts_find_identifiers(spark):
    rows = [(i, f"call phone +1 (706) 555-31{i:02d} now", "s") for i in range(10, 60)]
    rows += [(100, "call phone 706-555-3199 now", "s"), (101, "room 555-3111 is free", "s")]
    rows += [(200 + i, f"id member {100000 + i} plain", "s") for i in range(30)]
    seeds = [(300 + i, f"card owner 41111111111111{n:02d} x", "s") for i, n in enumerate(range(100)) if luhn(f"41111111111111{n:02d}")]
    got = {r.doc_id: r.spans for r in personal.personal(documents(spark, rows + seeds)).collect()}
    assert got[10].startswith("phone:") and got[100] == "context:11:23" and got[101] == "" and got[200] == ""


def test_contexts_find_unseen_shapes(spark):
    """Identifiers of other forms, and one next to another, where base forms stand; none where other numbers do."""
    rows = [(i, f"call phone +1 (706) 555-31{i:02d} now", "s") for i in range(10, 60)]
    rows += [(100 + i, f"call phone {x} now", "s") for i, x in enumerate(["706-555-3199", "ab12cd34", "@someone", "12345", "987-65-4321"])]
    rows += [(110, "phone 123-45-6789 987-65-4322 now", "s")]
    rows += [(200 + i, f"room {5550000 + i} is free", "s") for i in range(30)] + [(300, "call phone 7 now", "s")]
    got = {r.doc_id: r.spans for r in personal.personal(documents(spark, rows)).collect()}
    assert [got[100 + i] for i in range(5)] == ["context:11:23", "context:11:19", "context:11:19", "context:11:16", "context:11:22"]
    assert got[110] == "context:6:17,context:18:29"
    assert got[300] == "" and not any(got[200 + i] for i in range(30))


def test_unseen_forms_are_found_by_their_contexts(spark):
    """Recall and precision on planted forms that no fixed form has, in contexts of several words on both sides."""
    r = np.random.default_rng(9)
    fill = lambda: " ".join(f"w{'abcdefghij'[k]}" for k in r.integers(0, 10, 6))
    contexts = ["please reach me under {} any time", "my account is {} thanks", "write to {} soon"]
    seeds = [lambda: f"+1 ({r.integers(100, 999)}) 555-{r.integers(1000, 9999)}", lambda: f"user{r.integers(9999)}@mail.example.com", lambda: f"10.{r.integers(255)}.{r.integers(255)}.{r.integers(1, 255)}"]
    fresh = [lambda: f"{r.integers(100, 999)}-{r.integers(10, 99)}-{r.integers(1000, 9999)}", lambda: f"DE{r.integers(10**17, 10**18)}", lambda: f"{r.integers(10**15, 10**16)}", lambda: f"@handle_{'xyz'[r.integers(3)]}{r.integers(10, 99)}", lambda: f"ab{r.integers(10, 99)}-cd{r.integers(10, 99)}"]
    rows, planted = [], {}
    for i in range(300):
        rows.append((i, f"{fill()} {contexts[i % 3].format(seeds[i // 3 % 3]())} {fill()}", "s"))
    for i in range(300, 360):
        value = fresh[i % 5]()
        text = f"{fill()} {contexts[i // 5 % 3].format(value)} {fill()}"
        rows.append((i, text, "s"))
        if not personal_base(text):
            planted[i] = f"context:{text.index(value)}:{text.index(value) + len(value)}"
    for i in range(400, 600):
        rows.append((i, f"{fill()} order number {r.integers(10**5, 10**9)} shipped {fill()} version {r.integers(1, 9)}.{r.integers(10, 99)} {fill()}", "s"))
    got = {x.doc_id: x.spans for x in personal.personal(documents(spark, rows)).collect()}
    recall = np.mean([got[i] == want for i, want in planted.items()])
    flagged = [i for i in got if "context" in got[i]]
    precision = np.mean([i in planted for i in flagged])
    assert len(planted) >= 50 and recall >= 0.95 and precision >= 0.95, (recall, precision)


def personal_base(text):
    only = re.sub("[^0-9]", "", text)
    return any(len(m) >= 14 and luhn(m) for m in re.findall("[0-9]{14,19}", text)) or "@mail" in text or only == ""


def test_texts_with_very_many_matches(spark):
    """The work grows with the number of matches, not with its square."""
    numbers = " ".join(str(k * 7919 % 100000) for k in range(100_000))
    mails = " ".join(f"u{k}@x{k % 7}.org" for k in range(20_000))
    keys = " ".join(f"token=abcdefgh{k}" for k in range(20_000))
    rows = [(1, numbers, "s"), (2, mails, "s"), (3, keys, "s")]
    began = time.monotonic()
    got = {x.doc_id: x for x in personal.personal(documents(spark, rows)).collect()}
    assert got[2].n_email == 20_000 and got[1].n_email == 0
    found = {x.doc_id: x for x in secrets.secrets(documents(spark, rows)).collect()}
    assert found[3].n_assign == 20_000
    out = {x.doc_id: x.text for x in personal.redact(documents(spark, rows)).collect()}
    assert out[2] == " ".join(["<email>"] * 20_000)
    assert time.monotonic() - began < 120


def test_redacted_texts(spark):
    docs = documents(spark)
    out = {r.doc_id: r for r in personal.redact(docs).collect()}
    assert personal.redact(docs).columns == docs.columns
    assert out[14].text == "mail <email> or <phone> at 10.0.0.256 and <ip>\ncard <card> é"
    assert out[4].text == dict((i, t) for i, t, _ in texts())[4] and out[6].text is None
    assert sorted(r[0] or 0 for r in personal.redact(docs).select("doc_id").collect()) == sorted(r[0] or 0 for r in texts())


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    total = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((total.target - total.taken).abs() <= total.most).all()
    assert got.target.groupby(got.source).first().sum() == pytest.approx(1.5 * got["size"].sum())
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    assert mixing.mix_sources(documents(spark)).count() == len(texts())
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_inclusion_follows_the_size(spark):
    """Twenty sources alike are twenty draws: documents are taken as often as their expected copies say."""
    sizes = [9, 16, 25, 36, 49, 64, 81, 100, 121, 144] * 40
    rows = [(s * 1000 + k, " ".join(["w"] * n), f"s{s:03d}") for s in range(20) for k, n in enumerate(sizes)]
    got = mixing.mix_sources(documents(spark, rows), weights=(1,), share=0.6).toPandas()
    copies = got.groupby("size").copies.mean()
    level = 0.6 * sum(sizes) / sum(n * np.sqrt(n) for n in sizes)
    want = np.minimum(level * np.sqrt(copies.index.to_numpy()), 2)
    assert want[0] < 0.25 and want[-1] > 0.7
    assert np.abs(copies.to_numpy() - want).max() < 0.08, (copies, want)
    taken = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((taken.taken - taken.target).abs() <= 5).all()


def test_mix_of_awkward_rows(spark):
    got = mixing.mix_sources(documents(spark)).toPandas()
    assert len(got) == len(texts()) and (got.taken == got.copies * got["size"]).all() and got.copies.between(0, 2).all()
    assert got["size"].sum() == sum(len(split(t)) for _, t, _ in texts())
    per = got.fillna({"source": "none"}).groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"), longest=("size", "max"))
    assert (per.target <= 2 * per["size"] + 1e-9).all() and ((per.taken - per.target).abs() <= per.longest).all()


def slow_sum_of_squares(lengths, capacity):
    """The rule as it is said: try every gap, take the least sum of squares."""
    open_, where = [], []
    for s in lengths:
        best = None
        for gap in sorted({g for g in open_ if g >= s}) + [capacity]:
            left = [*open_]
            if gap != capacity or capacity in left:
                if gap in left:
                    left.remove(gap)
            if 0 < gap - s < capacity:
                left.append(gap - s)
            cost = sum(c * c for c in Counter(left).values())
            if best is None or cost < best[0]:
                best = cost, gap, left
        where.append(capacity - best[1])
        open_ = best[2]
    return where


def test_sum_of_squares_against_the_rule():
    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(1, 31, 60)
        _, offsets = packing.sum_of_squares(lengths, 30)
        assert offsets.tolist() == slow_sum_of_squares(lengths.tolist(), 30)


def test_plain_texts_are_cut_into_the_same_pieces():
    """A plain text is cut at once, as its parts are, and none of its parts is kept."""
    signs = [chr(c) for c in (*range(33, 127), *range(0xA1, 0x250))]
    random = np.random.default_rng(8)
    texts = ["".join(random.choice([*signs, *[" ", "\n", "'s", " 'LL", "'re", "..."] * 20], 60)) for _ in range(5000)]
    texts = [t.replace("<|", "< |") for t in ["", " \n", *signs, *["a" + c + "b" for c in signs], *texts]]
    for t in texts:
        assert packing.PLAIN_TEXT.fullmatch(t)
        assert packing.PLAIN_PIECES.findall(t.lower()) == [x for part in t.replace("\n", " ").split(" ") for x in packing.PIECES.findall(part.lower())]
    ids = packing.PartIds(packing.default_tokenizer())
    mixed = [*texts[:3000], "<|ENDOFTEXT|> <|endoftext|> It's", "\u03a3\u03a3 it's\tso", "a\u00a0b\r\n\u1e9e"]
    whole = [np.array(code.ids, dtype="<u4").tobytes() for code in ids.tokenizer.encode_batch(mixed, add_special_tokens=False)]
    assert ids.of(mixed) == whole
    kept = packing.PartIds(packing.default_tokenizer())
    kept.of(["Word, word. WORD!"])
    assert set(kept.pieces) == {"word", ",", ".", "!"} and set(kept.parts) == {""}


def test_packing_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_PIECES", 100)
    rows = [(i, words_of(i), "s") for i in range(450)]
    got = packing.pack_documents(documents(spark, rows)).toPandas()
    assert got.sequence_id.map(lambda s: s >> 32).nunique() == 5 and sorted(got.doc_id) == list(range(450))
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def words_of(i):
    return " ".join(f"w{(i * 7 + k) % 50}" for k in range(20 + i % 90))


def test_packing_is_exact_and_gapless(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = [(50, "x<|endoftext|>y a  b\tc ΣΑΣ don't ½² 日本 \x00 z\u0085q", "s"), (51, "İstanbul ẞ é ́", "s")]
    rows = [r for r in texts() if r[0] is not None][:-1] + odd
    got = packing.pack_documents(documents(spark, rows)).toPandas()
    for doc_id, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = got[got.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids)
        for piece, start, length, crc in zip(own.piece, own.start, own.length, own.ids_crc32):
            assert start == 4096 * piece and crc == zlib.crc32(ids[start : start + length].tobytes())
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert (sequence.offset.to_numpy() == np.cumsum([0, *sequence.length[:-1]])).all()
        assert sequence.length.sum() <= 4096
    assert packing.pack_documents(empty(spark)).count() == 0


def test_sum_of_squares_fills_its_bins():
    lengths = np.random.default_rng(2).integers(1, 1500, 20_000)
    bins, offsets = packing.sum_of_squares(lengths, 4096)
    assert (np.bincount(bins, weights=lengths) <= 4096).all()
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 4096


def test_equal_rows_and_long_documents_fill_many_groups(spark, monkeypatch):
    """Null texts without ids go to all groups alike, and pieces are counted, not documents."""
    monkeypatch.setattr(packing, "CHUNK_PIECES", 500)
    rows = [(None, None, None)] * 6000 + [(1, "word " * 9000, "s")]
    got = packing.pack_documents(documents(spark, rows), capacity=8).toPandas()
    assert len(got) == 6000 + -(-9001 // 8)
    groups = got.groupby(got.sequence_id // (1 << 32))
    assert groups.ngroups == -(-len(got) // 500) and groups.size().max() < 800
    assert (got.groupby("sequence_id").length.sum() <= 8).all()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]


def test_discovery_limits_against_benjamini_and_hochberg(spark):
    """Evidence is counted in tenths, so the plain procedure on p values rounded up to them gives the same limits."""
    r = np.random.default_rng(10)
    rows = [(size, float(e)) for size in (20, 40) for e in np.concatenate([r.exponential(0.43, 3000), r.uniform(3, 70 if size == 20 else 8, 60)])] + [(64, 0.2)] * 50
    got = secrets.discovery_limits(spark.createDataFrame(rows, "size int, evidence double"), "evidence", 0.01)
    want = {}
    for size in (20, 40, 64):
        tenths = sorted((min(math.floor(e * 10), 600) for s, e in rows if s == size), reverse=True)
        passed = [k for k, t in enumerate(tenths, 1) if 10 ** (-t / 10) <= 0.01 * k / len(tenths)]
        if passed:
            want[size] = tenths[passed[-1] - 1] / 10
    assert got == want and set(want) == {20, 40}


def test_strings_of_one_class_are_left_alone(spark):
    """Without a change of character class nothing tells a random string from a word, so it is never added."""
    r = np.random.default_rng(3)
    keys = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 40)) for _ in range(30)]
    rows = [(i, f"see {k} there", "s") for i, k in enumerate(keys)]
    assert {x.spans for x in secrets.secrets(documents(spark, rows)).collect()} == {""}

"""Near-duplicate documents by bottom-k sketches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import KEYS, by_keys, discard, for_python, scratch, slices, stored, whole_ids, with_keys
from plume.llm.components import connected_components
from plume.llm.hashing import hashes, mixed, sequences

#: Retained values of a sketch.
SKETCH = 48
#: Sets of up to so many shingles are retained whole.
WHOLE = 60
#: A longer inverted list of small sets gives no pairs; one of sketches none where marks give more pairs than such a list can.
LONG_LIST = 48
#: Bits of a set's marks.
MARKS = 256
#: Shingles and, about, classes of a block of such a list.
BLOCK_SHINGLES = 1_000_000
BLOCK_CLASSES = 4000
#: Rows of lists that a worker compares at once, or one list's.
PAIR_ROWS = 10_000


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, A-Z in lower case.

    Fewer than n words are one shingle; no words, none.
    """
    words = (text or "").encode().lower().split()
    h = hashes(words)
    if 0 < len(h) < n:
        return mixed(sequences(h, len(h)) + np.uint64(len(h)))
    return np.unique(sequences(h, n))


def class_key(shingles: np.ndarray) -> int:
    """A hash of a whole set."""
    both = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles), len(shingles)], dtype=np.uint64)
    return int(sequences(mixed(both), 3).view(np.int64)[0])


def sketch_size(n: int, percent: int) -> int:
    """Retained values of a set of n shingles.

    Two sets of the asked similarity share one of their first n - ceil(s n)
    + 1 values in any common order; beyond ``SKETCH`` values the chance that
    they share none is negligible.
    """
    return min(n - (percent * n + 99) // 100 + 1, SKETCH)


def set_marks(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of ``MARKS`` parts of the shingles' hash, of the least shingle there; none for an empty part."""
    part, first = np.unique(shingles & np.uint64(MARKS - 1), return_index=True)
    bits = np.zeros(MARKS, dtype=np.uint8)
    bits[part.astype(np.intp)] = (shingles[first] >> np.uint64(8)) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def most_apart(parts: int, share: float) -> int:
    """Bits in which the marks of a linked pair differ at most, but for a chance of 2e-9 (Chernoff's bound).

    In each of the ``parts`` that hold a shingle of either, the least one is
    common with a chance of ``share``, or else the bits differ every other time.
    """
    q = (1 - share) / 2
    for x in range(math.ceil(q * parts), parts):
        p = (x + 1) / parts
        if q == 0 or parts * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)) > 20:
            return x
    return parts


def least_hits(k: int, share: float) -> int:
    """Shared values among the first k of the union that a linked pair has, but for six deviations."""
    return max(1, math.floor(k * share - 6 * math.sqrt(k * share * (1 - share))))


def least_shared(percent: int) -> Column:
    """Sketch values that a class of m shingles shares with any class linked to it, as :func:`least_hits` has them."""
    limits = F.array(*[F.lit(least_hits(k, percent / 100)) for k in range(1, SKETCH + 1)])
    smallest = F.floor((F.col("m") * percent + 99) / 100)
    size = F.least(smallest - F.floor((smallest * percent + 99) / 100) + 1, F.col("k"))
    return F.element_at(limits, size.cast("int"))


def least_retained(percent: int) -> Column:
    """:func:`sketch_size` of column m."""
    return F.least(F.col("m") - F.floor((F.col("m") * percent + 99) / 100).cast("int") + 1, F.lit(SKETCH))


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, keys, n_shingles, class, sketch and marks of every row; the smallest values of one hash, or all of a small set."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            out = []
            for text in frame["text"]:
                s = shingle_set(text, n)
                kept = s[: len(s) if len(s) <= WHOLE else sketch_size(len(s), percent)].view(np.int64)
                out.append((len(s), class_key(s), kept, set_marks(s)) if len(s) else (0, None, None, None))
            size, key, sketch, marks = zip(*out)
            yield frame.drop(columns="text").assign(n_shingles=np.array(size, dtype=np.int64), sketch=list(sketch), marks=list(marks), **{"class": pd.array(key, dtype="Int64")})

    return whole_ids(for_python(with_keys(docs), *KEYS).mapInPandas(read, "doc_id string, id_key long, text_key long, n_shingles long, class long, sketch array<long>, marks array<long>"))


def wanted_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class, n_shingles and whole set of the documents with the keys in ``wanted``, one of each class."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            sets = [shingle_set(t, n) for t in frame["text"]]
            yield pd.DataFrame({"class": np.array([class_key(s) for s in sets], dtype=np.int64), "n_shingles": np.array([len(s) for s in sets], dtype=np.int64), "shingles": [s.view(np.int64) for s in sets]})

    texts = by_keys(with_keys(docs.select("doc_id", "text")), wanted, "left_semi").select("text")
    sets = texts.mapInPandas(read, "class long, n_shingles long, shingles array<long>")
    return sets.groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("shingles").alias("shingles"))


def intersections(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``first`` with sets ``second``, by products of incidence blocks."""
    flat, n = np.concatenate(sets), len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(first), len(second)), dtype=np.float32)
    width, strip = 1024, 256
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[low:high], column[low:high] - at] = 1
        across = block[second].T
        for k in range(0, len(first), strip):
            common[k : k + strip] += block[first[k : k + strip]] @ across
    return common


def two_sides(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks of a group, or of its only one twice."""
    return np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())


def group_links(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int, own: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the linked classes of a block, or of two blocks across, at most one per class.

    ``own`` is the block of each class.
    """
    n, (first, second) = len(sets), two_sides(own)
    common = intersections(sets, first, second)
    linked = np.zeros((n, n), dtype=bool)
    for k in range(0, len(first), 256):
        rows, both = first[k : k + 256], common[k : k + 256].astype(np.int64)
        near = 100 * both >= percent * (sizes[rows][:, None] + sizes[second][None] - both)
        linked[np.ix_(rows, second)] |= near
        linked[np.ix_(second, rows)] |= near.T
    free, edges = np.ones(n, dtype=bool), []
    for root in range(n):
        if free[root]:
            free[root], reached = False, [root]
            while reached:
                found = np.flatnonzero(linked[reached.pop()] & free)
                free[found] = False
                edges.extend((int(keys[i]), int(keys[root])) for i in found)
                reached.extend(found)
    return edges


def shared_hits(a: Column, b: Column) -> Column:
    """Values that two sketches share among the first k of their union, k as many as the smaller has."""
    unsigned = [F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(1 << 63)))) for x in (a, b)]
    last = F.element_at(F.array_sort(F.array_union(*unsigned)), F.least(F.size(a), F.size(b)))
    return F.size(F.filter(F.array_intersect(*unsigned), lambda v: v <= last))


def marked_pairs(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For rows sorted by value, low and high: pairs of classes of a list (or across two of its blocks) whose sizes and marks allow a link.

    A list gives as many as one of ``LONG_LIST`` classes can for each of its
    classes; where there are more, it gives one row, crowded.
    """
    limits = np.array([most_apart(k, percent / 100) for k in range(MARKS + 1)])
    words = [f"marks{k}" for k in range(MARKS // 64)]

    def near(m: np.ndarray, marks: list[np.ndarray], i, j) -> np.ndarray:
        low, high = np.minimum(m[i], m[j]), np.maximum(m[i], m[j])
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in marks)
        return (100 * low >= percent * high) & (apart <= limits[np.minimum(100 * low // percent, MARKS)])

    def pairs(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        keys, value, m = frame["class"].to_numpy(), frame["value"].to_numpy(), frame["m"].to_numpy()
        marks = [frame[w].to_numpy().view(np.uint64) for w in words]
        sizes = np.diff(starts)
        of = np.repeat(np.arange(len(sizes)), sizes)
        short = sizes <= LONG_LIST
        out = []
        at = np.flatnonzero(short[of])
        for step in range(1, int(sizes[short].max()) if short.any() else 0):
            at = at[at + step < len(of)]
            at = at[of[at] == of[at + step]]
            found = at[near(m, marks, at, at + step)]
            out.append((value[found], keys[found], keys[found + step]))
        crowded = []
        for k in np.flatnonzero(~short):
            own = frame["own"].to_numpy()[starts[k] : starts[k + 1]]
            first, second = (starts[k] + side for side in two_sides(own))
            one, most, held = own.min() == own.max(), LONG_LIST // 2 * sizes[k], 0
            part, strip = [], max(1, 1_000_000 // len(second))
            for x in range(0, len(first), strip):
                i, j = np.nonzero(near(m, marks, first[x : x + strip, None], second[None]))
                i, j = first[x + i], second[j]
                i, j = (i[i < j], j[i < j]) if one else (i, j)
                part.append((value[i], keys[i], keys[j]))
                held += len(i)
                if held > most:
                    part = []
                    crowded.append(value[starts[k]])
                    break
            out += part
        value, a, b = (np.concatenate(x) for x in zip(*out)) if out else np.zeros((3, 0), dtype=np.int64)
        crowded = np.array(crowded, dtype=np.int64)
        none = np.zeros(len(crowded), dtype=np.int64)
        return pd.DataFrame({"value": np.append(value, crowded), "a": np.append(np.minimum(a, b), none), "b": np.append(np.maximum(a, b), none), "crowded": np.arange(len(value) + len(crowded)) >= len(value)})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= PAIR_ROWS:
                held = [pd.concat(held, ignore_index=True)]
                starts = list_starts(held[0])
                if len(starts) > 2:  # the last list may go on
                    yield pairs(held[0].iloc[: starts[-2]], starts[:-1])
                    held = [held[0].iloc[starts[-2] :]]
                n = len(held[0])
        if n:
            whole = pd.concat(held, ignore_index=True)
            yield pairs(whole, list_starts(whole))

    return read


def list_starts(frame: pd.DataFrame) -> np.ndarray:
    """Places where value, low or high change, and the end."""
    keys = frame[["value", "low", "high"]].to_numpy()
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])


def list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """p (structs a and b): pairs of entries (value and others, with class and m) in one list whose sizes allow a link."""
    columns = [c for c in entries.columns if c != "value"]
    lists = entries.groupBy("value").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"))
    near = lambda x, y: (100 * x["m"] >= percent * y["m"]) & (100 * y["m"] >= percent * x["m"])
    each = F.transform("all", lambda x, i: F.transform(F.filter(F.slice(F.col("all"), i + 2, F.size("all")), lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return lists.select(F.explode(F.flatten(each)).alias("p"))


def rare_prefixes(kinds: DataFrame, percent: int) -> DataFrame:
    """class, m, value, n: of each small set, retained whole, its rarest values, n of them in lists of the small sets.

    Two sets of the asked similarity share one of their first m - ceil(s m)
    + 1 values in any common order, here from rare to frequent.
    """
    small = kinds.filter(F.col("m") <= WHOLE).select("class", "m", F.explode("sketch").alias("value"))
    counts = small.groupBy(F.col("value").alias("of")).agg(F.count("*").alias("n"))
    ranked = small.join(counts, F.col("value") == F.col("of")).groupBy("class").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"))
    prefix = F.col("m") - F.floor((F.col("m") * percent + 99) / 100).cast("int") + 1
    return ranked.select("class", "m", F.explode(F.slice("values", F.lit(1), prefix)).alias("v")).select("class", "m", "v.value", "v.n").filter("n > 1")


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, keys, n_shingles, class and root of every row of ``docs``: see :func:`near_duplicates`.

    root is the least class of the component; rows without words have neither.
    """
    share = percent / 100
    rows = stored(sketches(docs, n, percent), "sketches")
    one = F.min(F.struct(*KEYS)).alias("rep")
    kinds = rows.filter("class is not null").groupBy("class").agg(one, F.first("n_shingles").cast("int").alias("m"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    kinds = stored(kinds, "classes")
    sketched, rows = rows, stored(rows.drop("sketch", "marks"), "classes-of-rows")
    discard(sketched)
    # a set so small that only an equal one is similar has no links with other classes
    open_ = kinds.filter(F.floor(100 * F.col("m") / percent) > F.col("m"))

    # small sets, by their rarest values
    rare = stored(rare_prefixes(open_, percent), "rare")
    rare_pairs = list_pairs(rare.filter(F.col("n") <= LONG_LIST).drop("n"), percent).select("p.a.class", "p.b.class").toDF("a", "b")

    # inverted lists of retained values
    large = open_.filter(F.col("m") > WHOLE * share).withColumn("sketch", F.slice("sketch", F.lit(1), least_retained(percent)))
    entries = large.select("class", "m", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    lists = stored(entries.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("value", "of"), "counts")
    entries = stored(entries.join(lists, F.col("value") == F.col("of")).drop("of"), "lists")
    discard(lists)

    # linked classes share at least so many values, so of those of any list their first
    # l - least + 1 in one order (rare ones first) have one in common
    ranked = entries.groupBy("class").agg(F.first("m").alias("m"), F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"))
    ranked = ranked.withColumn("prefix", F.size("values") - least_shared(percent) + 1).filter("prefix > 0")
    listed = ranked.select("class", "m", F.slice("values", F.lit(1), F.col("prefix")).alias("values"))
    listed = listed.join(large.select(F.col("class").alias("of"), *[F.col("marks")[k].alias(f"marks{k}") for k in range(MARKS // 64)]), F.col("class") == F.col("of"))
    listed = stored(listed.drop("of"), "prefixes")
    discard(entries)
    inverted = listed.select(F.explode("values").alias("v"), *[c for c in listed.columns if c != "values"]).select("v.*", *[c for c in listed.columns if c != "values"])

    # their pairs, by marks; long lists block against block
    many = inverted.filter(F.col("n") > BLOCK_CLASSES).groupBy(F.col("value").alias("of")).agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("blocks"))
    parted = inverted.filter(F.col("n") > BLOCK_CLASSES).join(many, F.col("value") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    whole = inverted.filter(F.col("n") <= BLOCK_CLASSES).select("*", *[F.lit(0).alias(c) for c in ("own", "low", "high")])
    blocks = whole.union(parted.select(whole.columns)).drop("n").repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")
    found = stored(blocks.mapInPandas(marked_pairs(percent), "value long, a long, b long, crowded boolean"), "found")

    # overlaps of sketches, among the first of the union
    pairs = found.filter("not crowded").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(large.select(F.col("class").alias(f"of_{side}"), F.col("sketch").alias(f"sketch_{side}")), F.col(side) == F.col(f"of_{side}"))
    limits = F.array(*[F.lit(least_hits(k, share)) for k in range(1, SKETCH + 1)])
    least = F.element_at(limits, F.least(F.size("sketch_a"), F.size("sketch_b")))
    pairs = pairs.filter(shared_hits(F.col("sketch_a"), F.col("sketch_b")) >= least).select("a", "b")
    pairs = stored(pairs.union(rare_pairs).distinct(), "pairs")

    # lists with too many pairs are compared on full sets
    crowded = found.filter("crowded").select(F.col("value").alias("of")).distinct()
    searched = inverted.select("class", "m", "value").join(crowded, F.col("value") == F.col("of")).drop("of")
    searched = stored(searched.union(rare.filter(F.col("n") > LONG_LIST).select("class", "m", "value")), "searched")
    discard(listed, found, rare)

    # full sets of what is to be verified
    used = pairs.select("a").union(pairs.select("b")).union(searched.select("class")).distinct().toDF("class")
    wanted = stored(kinds.join(used, "class", "left_semi").select("rep.*"), "wanted")
    discard(kinds)
    sets = stored(wanted_sets(docs, wanted, n), "sets")
    full = pairs.join(sets.toDF("a", "size_a", "set_a"), "a").join(sets.toDF("b", "size_b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    full = full.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common")))
    links = stored(full.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    discard(pairs)

    # these lists, block against block; those of one least class have much in common and are one, if that is less to compare
    sizes = searched.groupBy("value").agg(F.min("class").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    listed = stored(searched.join(sizes.withColumnRenamed("value", "of"), F.col("value") == F.col("of")).select("leader", "value", "class", "m", "n"), "listed")
    apart = listed.groupBy("leader").agg(F.sum("n").alias("apart"))
    merged = listed.select("leader", "class").distinct().groupBy(F.col("leader").alias("of")).agg(F.count("*").alias("union"))
    merged = apart.join(merged, F.col("leader") == F.col("of")).filter(F.col("union") * F.col("union") <= F.col("apart")).select("of", F.lit(True).alias("one"))
    listed_as = F.when(F.col("one"), F.col("leader")).otherwise(F.col("value"))
    members = listed.join(merged, F.col("leader") == F.col("of"), "left").select(F.coalesce("one", F.lit(False)).alias("one"), listed_as.alias("list"), "class", "m").distinct()
    members = stored(members, "members")
    discard(listed)
    totals = members.groupBy(F.col("one").alias("of_one"), F.col("list").alias("of")).agg(F.greatest(F.ceil(F.sum("m") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    dealt = members.join(totals, (F.col("list") == F.col("of")) & (F.col("one") == F.col("of_one"))).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("class", "one", "list", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(sets, "class")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class")
        found = group_links(frame["class"].to_numpy(), frame["n_shingles"].to_numpy(), frame["shingles"].tolist(), percent, frame["own"].to_numpy())
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    across = stored(dealt.groupBy("one", "list", "low", "high").applyInPandas(compare, "u long, v long"), "across")
    discard(searched, sets, members)
    with scratch() as made:
        components = stored(connected_components(links.union(across)), "components")
    discard(links, across, *[t for t in made if t.stored_path != components.stored_path])
    roots = components.withColumnRenamed("node", "of")
    out = rows.join(roots, F.col("class") == F.col("of"), "left").withColumn("root", F.coalesce("root", "class")).drop("of")
    out = stored(out, "groups")
    discard(rows, wanted, components)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if their sets of n-word shingles (A-Z in lower
    case) have a Jaccard similarity of ``percent`` / 100 or more.
    component_id is the smallest doc_id reachable over links; kept marks it.

    Documents of equal sets are one class, and one of them stands for it. A
    sketch keeps the smallest values of one hash. Linked classes share at
    least t of them, with a margin of six standard deviations, so each class
    with l >= t values that others have, too, is in the inverted lists of its
    first l - t + 1 in one order, rare ones first: two linked classes have
    one of these in common. Pairs of a list are left whose marks (a bit for
    each part of the hash, of the least value there) differ in no more bits
    than those of linked classes; of these, pairs with too few shared values
    among the smallest of their sketches' union are dropped, and the rest
    verified on full sets. Sets of up to ``WHOLE`` shingles are retained
    whole and meet in the lists of their rarest values, without a margin.

    Lists of over ``BLOCK_CLASSES`` classes are compared by marks in blocks. Where a list
    of over ``LONG_LIST`` has more pairs left than such a short one for each
    class, or is one of small sets, its classes are compared on their full sets, in
    blocks of bounded shingles and classes, which gives no more than one
    edge per class and block. Lists that share their least class are one
    list, so that a set travels once for all of them, unless their union has
    more pairs than they have apart. So no task or table holds all pairs of a
    group, and a group of copies of one text costs no more than one of them.

    Null texts and texts without words have the empty set and are linked
    with nothing. Rows that repeat a doc_id or a text are members of one
    class or linked through it; a null doc_id is never a component_id unless
    its component has no other. An empty table gives an empty result.
    """
    groups = near_groups(docs, n, percent)
    least = groups.filter("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id"))
    out = groups.join(least, F.col("root") == F.col("of"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = stored(out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")), "near-duplicates")
    discard(groups)
    return out


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (any columns) with one row of each group of near-duplicates, that of the least doc_id.

    Rows are told apart by doc_id and text: of several texts with one doc_id
    each is judged for itself, and of equal rows of a group that stays one is
    left. Rows without a doc_id stay if their group has no other. Texts without words are
    linked with nothing, so all of them stay. An empty table stays empty.
    """
    groups = near_groups(docs, n, percent).filter("root is not null")
    first = groups.groupBy(F.col("root").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *KEYS)).alias("stays"))
    rows = groups.groupBy("root", *KEYS).agg(F.count("*").alias("n")).join(first, F.col("root") == F.col("of"))
    stays = (F.col("id_key") == F.col("stays.id_key")) & (F.col("text_key") == F.col("stays.text_key"))
    marks = stored(rows.filter(~stays | (F.col("n") > 1)).select(*KEYS, (F.when(stays, 1).otherwise(0)).alias("stays")), "gone")
    keyed = with_keys(docs)
    out = by_keys(keyed, marks.drop("stays"), "left_anti")
    repeated = by_keys(keyed, marks.filter("stays = 1").drop("stays"), "left_semi").dropDuplicates(KEYS)
    return out.unionByName(repeated).select(docs.columns)

"""Near duplicates by weighted minimum hashes of thrown darts, banded."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, durable, map_texts, texts_of, with_values

_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The lowest rank cell is [0, 2**-LOWEST); each further one doubles.
LOWEST = 10
#: Words of 64 parity bits of a set, and elements of sets that are compared exactly at once; more are parted.
MARKS, ELEMENTS = 16, 1 << 21


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _ONE
        x = (x ^ (x >> np.uint64(27))) * _TWO
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(64)
def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson count."""
    out, term, total, k = [], np.exp(-mean), 0.0, 0
    while total < 1 - 1e-15 and k < mean + 40 * np.sqrt(mean) + 40:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return np.array(out)


def sketch(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, n: int, k: int) -> np.ndarray:
    """``n`` x ``k`` hashes: at each place two sets agree with the probability of their weighted Jaccard similarity.

    ``owner`` (ascending, below ``n``) has each element's set; an element stands once in a set. Darts fall on
    the plane of weight and rank of every element at unit density, the same for every set: cells one wide in
    weight and doubling in rank hold Poisson counts of them, all drawn from hashes of element, cell and number.
    A set keeps those under its element's weight and under a rank that leaves about k ln k + 2k of them; each
    dart has a place, and the place keeps its dart of least rank. Sets with a place left empty throw again
    up to twice the rank. A set without weight has zeros.
    """
    out = np.zeros((n, k), dtype=np.uint64)
    if weights is None:
        weights = np.ones(len(elements))
        cells = elements
    else:
        times = np.ceil(weights).astype(np.int64)
        first = np.repeat(np.cumsum(times) - times, times)
        number = np.arange(len(first)) - first
        owner, elements, weights = (np.repeat(x, times) for x in (owner, elements, weights))
        cells = elements + mix(number.astype(np.uint64), 3) * (number > 0).astype(np.uint64)
        weights = np.minimum(weights - number, 1.0)  # what is left of it in the cell
    norm = np.bincount(owner, weights, minlength=n)
    reach = np.where(norm > 0, (k * np.log(k) + 2 * k) / np.maximum(norm, 1e-300), 0.0)
    todo = norm > 0
    while todo.any():
        keys, ranks, darts = [], [], []
        level = 0
        while True:
            low = 2.0 ** (level - 1 - LOWEST) if level else 0.0
            high = 2.0 ** (level - LOWEST)
            far = todo & (reach > low)
            if not far.any():
                break
            at = np.flatnonzero(far[owner])
            seed = mix(cells[at], 16 + level)
            counts = np.searchsorted(_poisson(high - low), _unit(seed), side="right")
            hit = np.flatnonzero(counts)
            counts = counts[hit]
            at, seed = np.repeat(at[hit], counts), np.repeat(seed[hit], counts)
            number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                dart = mix(seed + number.astype(np.uint64), 5)
            rank = low + (high - low) * _unit(mix(dart, 6))
            kept = rank < reach[owner[at]]
            kept &= (weights[at] >= 1) | (_unit(mix(dart, 7)) < weights[at])
            at, dart, rank = at[kept], dart[kept], rank[kept]
            keys.append(owner[at] * k + (mix(dart, 8) % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
            level += 1
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        out.reshape(-1)[key[first]] = dart[first]
        filled = np.bincount(key[first] // k, minlength=n)
        todo &= filled < k
        reach[todo] *= 2
    return out


class Shingles:
    """Hashes of runs of words, lower-cased and parted by white space; a text of fewer words is one run."""

    def __init__(self, size: int = 5, most: int = 300_000):
        self.size, self.most, self.table = size, most, {}

    def words(self, text: str) -> np.ndarray:
        table = self.table
        if len(table) > self.most:
            table.clear()
        words = text.lower().split()
        for w in set(words).difference(table):
            table[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, words: np.ndarray) -> np.ndarray:
        size = min(self.size, len(words))
        if not size:
            return words
        out = np.zeros(len(words) - size + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = mix(out + words[i : len(words) - size + 1 + i], i)
        return out


def sketch_documents(docs: DataFrame, bands: int, rows: int, size: int, weighted: bool) -> DataFrame:
    """(doc_id, digest, bands): digest of the words, and a key for each band of the signature; no band where there is no word.

    A shingle weighs as often as it stands in the text if ``weighted``, else 1. A null id stays null; repeated rows
    are sketched each; an empty table gives an empty one.
    """

    def make():
        shingles = Shingles(size)

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            words = [shingles.words(t) for t in texts]
            digests = [blake2b(w.tobytes(), digest_size=16).digest() for w in words]
            sets = [np.unique(shingles.of(w), return_counts=True) for w in words]
            sizes = np.array([len(s) for s, _ in sets], dtype=np.int64)
            owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate([s for s, _ in sets])
            weights = np.concatenate([c for _, c in sets]).astype(np.float64) if weighted else None
            hashes = sketch(owner, flat, weights, len(sets), bands * rows).reshape(len(sets), bands, rows)
            keys = np.zeros((len(sets), bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i in range(rows):
                    keys = mix(keys + hashes[:, :, i], i)
                keys = mix(keys + np.arange(bands, dtype=np.uint64), 9)
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            offsets[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "bands"])

        return work

    return map_texts(docs, make, "doc_id long, digest binary, bands array<long>")


def parity(owner: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    """``n`` x MARKS words of bits: whether the elements that hash to a bit are odd in number.

    Two sets differ in at least as many elements as bits, so the bits show that two are unlike but never hide that
    they are alike.
    """
    out = np.zeros((n, MARKS), dtype=np.uint64)
    bit = mix(elements, 12) % np.uint64(64 * MARKS)
    np.bitwise_xor.at(out.reshape(-1), owner * MARKS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def unfolded(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set that has one element for each time: the weighted similarity of two is that of these sets."""
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(np.repeat(elements, counts) + mix(number.astype(np.uint64), 3) * (number > 0).astype(np.uint64))


def shingle_sets(docs: DataFrame, size: int, weighted: bool) -> DataFrame:
    """(doc_id, shingles, marks): the shingles of each text, ascending, each as often as it stands there if ``weighted``.

    See ``unfolded``; ``marks`` is their parity. A text without a word has none. A null id stays null; repeated rows
    have a set each; an empty table gives an empty one.
    """

    def make():
        shingles = Shingles(size)

        def own(text: str) -> np.ndarray:
            distinct, counts = np.unique(shingles.of(shingles.words(text)), return_counts=True)
            return unfolded(distinct, counts) if weighted and len(distinct) and counts.max() > 1 else distinct

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            sets = list(map(own, texts))
            sizes = [len(s) for s in sets]
            offsets, flat = pa.array(np.cumsum([0, *sizes]).astype(np.int32)), np.concatenate(sets)
            marks = parity(np.repeat(np.arange(len(sets)), sizes), flat, len(sets))
            columns = [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))), pa.array([m.tobytes() for m in marks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "shingles", "marks"])

        return work

    return map_texts(docs, make, "doc_id long, shingles array<long>, marks binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (x, y) whose ``sets`` are at least ``threshold`` alike."""
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("x", "y"))
    common = F.size(F.array_intersect("x_set", "y_set"))
    alike = common >= F.lit(threshold) * (F.size("x_set") + F.size("y_set") - common)
    return pairs.join(x, "x").join(y, "y").where(alike).select("x", "y").distinct()


def _pairs(members: DataFrame, centre_only: bool = False) -> DataFrame:
    """(x, y) for (key, doc, class, centre): each member with four of its bucket, never all with all nor within a class.

    These are the member whose buckets hold the most, the least and the greatest id, and one by a hash that
    differs from bucket to bucket; or the first alone.
    """
    drawn, own = F.xxhash64("doc", "key"), F.struct("doc", "class")
    heads = members.groupBy("key").agg(
        F.max_by(own, "centre").alias("a"), F.min_by(own, "doc").alias("b"), F.max_by(own, "doc").alias("c"), F.min_by(own, drawn).alias("d"), F.count("*").alias("rows")
    )
    with_ = ["a"] if centre_only else ["a", "b", "c", "d"]
    met = with_values(members, durable(heads), "key").where("b.doc <> c.doc")
    each = met.select("doc", "class", F.explode(F.array_distinct(F.array(*with_))).alias("head")).where("class <> head.class")
    return each.select(F.least("doc", "head.doc").alias("x"), F.greatest("doc", "head.doc").alias("y")).distinct()


def _of_several(members: DataFrame) -> DataFrame:
    """Those rows whose ``key`` has rows of more than one ``class``."""
    several = members.groupBy("key").agg(F.min("class").alias("p"), F.max("class").alias("q"), F.count("*").alias("rows")).where("p <> q")
    return with_values(members, durable(several.select("key", "rows")), "key")


class _Marked:
    """Rows (doc, class, total, marks) of a group; ``total`` is the size of a row's set."""

    def __init__(self, group: pa.Table, threshold: float):
        self.ids, self.totals = group.column("doc").to_numpy(), group.column("total").to_numpy()
        self.marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint64).reshape(len(self.ids), MARKS)
        self.label = np.unique(group.column("class").to_numpy(), return_inverse=True)[1]
        self.ratio = (1 - threshold) / (1 + threshold)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows ``a`` (down) and ``b`` (across) are of two classes and differ in no more elements than sets that link."""
        apart = sum(np.bitwise_count(self.marks[a, None, k] ^ self.marks[None, b, k]).astype(np.int16) for k in range(MARKS))
        x, y = self.totals[a][:, None], self.totals[b][None]
        return (np.maximum(apart, np.abs(x - y)) <= self.ratio * (x + y) + 1e-6) & (self.label[a][:, None] != self.label[b][None])


def _possible_links(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Of a bucket: each row that may link with one of another class, with the least of those that such pairs reach."""
    from .lattice import _least_labels, _sides

    def work(group: pa.Table) -> pa.RecordBatch | None:
        rows = _Marked(group, threshold)
        n = len(rows.ids)
        left, right, alone = _sides(group)
        large = rows.label == np.bincount(rows.label).argmax()  # of the largest class, not to be compared with itself
        turns = [(left[~large[left]], right)]
        if not alone:
            turns.append((left[large[left]], right[~large[right]]))
        order = np.argsort(rows.ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(n)
        reach, linked = np.arange(n), np.zeros(n, dtype=bool)
        for some, others in turns:
            for i in range(0, len(some), 512):
                own = some[i : i + 512]
                a, b = np.nonzero(rows.may_link(own, others))
                a, b = own[a], others[b]
                linked[a] = linked[b] = True
                reach = _least_labels(n, np.concatenate([place[a], np.arange(n)]), np.concatenate([place[b], reach]))
        at = np.flatnonzero(linked)
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(rows.ids[at]), pa.array(rows.ids[order][reach[place[at]]])], ["x", "y"])

    return work


def _exact_links(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Of a group: links by exact similarity, enough of them to join all classes that any pair of it joins."""
    from .lattice import _sides

    def work(group: pa.Table) -> pa.RecordBatch | None:
        rows = _Marked(group, threshold)
        left, right, alone = _sides(group)
        lists = group.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        element = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        held = np.zeros(int(element.max()) + 1, dtype=np.int64)
        x, y = [], []
        for i in left.tolist():
            others = right[right > i] if alone else right
            others = others[rows.label[others] != rows.label[i]]
            others = others[rows.may_link(np.array([i]), others)[0]]
            if not len(others):
                continue
            own = slice(starts[i], starts[i] + sizes[i])
            held[element[own]] = 1
            first = np.cumsum(sizes[others]) - sizes[others]
            at = np.arange(int(sizes[others].sum())) + np.repeat(starts[others] - first, sizes[others])
            common = np.add.reduceat(held[element[at]], first)
            held[element[own]] = 0
            hit = others[common >= threshold * (rows.totals[i] + rows.totals[others] - common)]
            found, one = np.unique(rows.label[hit], return_index=True)
            x += [rows.ids[i]] * len(found)
            y += rows.ids[hit[one]].tolist()
            rows.label[np.isin(rows.label, found)] = rows.label[i]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"]) if x else None

    return work


def _between_classes(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y) that join all classes of which two members (key, doc, class) share a bucket and are ``threshold`` alike.

    Every member is compared with those of all other classes in its bucket, in parts of one class where it is large, first by parity marks, which
    lose no pair; those that may link make groups, within which each pair of two classes is compared exactly.
    """
    from .lattice import _grouped, _in_parts, _in_parts_of_classes

    own = sets.select(F.col("doc_id").alias("doc"), F.size("shingles").cast("long").alias("total"), "marks", "shingles").where("total > 0")
    rows = durable(_of_several(members))  # marks and sets come to rows that are dealt already, so that they move once
    dealt = _in_parts_of_classes(rows, "key", "doc").join(own.select("doc", "total", "marks"), "doc")
    possible = durable(_grouped(dealt, "key", _possible_links(threshold), "x long, y long").where("x <> y").distinct())
    if possible.isEmpty():
        return possible
    groups = durable(components(possible, "x", "y").select(F.col("node").alias("doc"), F.col("component").alias("group")))
    sizes = own.groupBy("doc").agg(F.sum("total").alias("elements"))
    near = groups.join(rows.select("doc", "class").distinct(), "doc").join(sizes, "doc")
    dealt = _in_parts(near, "group", "doc", "elements", ELEMENTS).drop("elements").join(own, "doc")
    return durable(_grouped(dealt, "group", _exact_links(threshold), "x long, y long"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 30, rows: int = 5, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, kept), a row for each row of ``docs``.

    Texts link at a weighted Jaccard similarity of ``threshold`` or more of their ``size``-word shingles, lower-cased and
    parted by white space, each weighing as often as it stands in its text (or 1 each, if not ``weighted``);
    ``component_id`` is the least id that links reach, ``kept`` tells the row that stays of each class. Texts with the
    same words are one from the start. Of the rest, those that share a band are compared with the leading member of
    its bucket, exactly, from their shingles; then two of each class found in a bucket with four leading ones, until
    a round finds no link; then each with those of all other classes in its bucket, so that no two that share a band
    and link stay parted.

    Texts without a word, null ones among them, have the same words, so they are one class. A text of any length is
    read whole. Rows with a null id link with nothing and stay, with a null component. Rows that share an id are one
    document with several texts, of which the first by text stays; other columns are ignored; an empty table gives
    an empty one.
    """
    texts = texts_of(docs, id_col, text_col)
    sketched = durable(sketch_documents(texts, bands, rows, size, weighted))
    told = sketched.where("doc_id is not null")
    same = durable(told.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    alone = durable(sketched.join(same.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select("doc_id", "bands"))
    keyed = alone.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key", "rows")
    live = durable(with_values(keyed, durable(met.withColumn("n", F.col("rows"))), "key"))
    centre = live.groupBy("doc").agg(F.sum("n").alias("centre"))
    members = durable(live.join(centre, "doc").select("key", "doc", "centre"))
    sets = durable(shingle_sets(texts.join(centre.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), size, weighted))
    tried = durable(_pairs(members.withColumn("class", F.col("doc")), centre_only=True))
    links = durable(_verified(tried, sets, threshold))
    turn = 0
    while True:
        turn += 1
        classes = durable(components(links, "x", "y"))
        held = members.join(classes, members["doc"] == classes["node"], "left")
        drawn = F.xxhash64("doc", "key", F.lit(turn))
        two = held.groupBy("key", F.coalesce("component", "doc").alias("class")).agg(F.array_distinct(F.array(F.max_by("doc", "centre"), F.min_by("doc", drawn))).alias("docs"), F.max("centre").alias("centre"))
        spoken = _of_several(durable(two)).select("key", "class", "centre", F.explode("docs").alias("doc"))
        pairs = durable(_pairs(spoken).join(tried, ["x", "y"], "left_anti"))
        found = durable(_verified(pairs, sets, threshold))
        if found.isEmpty():
            break
        tried, links = durable(tried.union(pairs)), durable(links.union(found))
    rest = _between_classes(held.select("key", "doc", F.coalesce("component", "doc").alias("class")), sets, threshold)
    if not rest.isEmpty():
        links = durable(links.union(rest))
        classes = durable(components(links, "x", "y"))
    # rows with the same words, rows with the same id, and links all join classes
    several = told.groupBy("doc_id").agg(F.min("digest").alias("p"), F.max("digest").alias("q"), F.count("*").alias("rows")).where("rows > 1")
    repeated = durable(several.select("doc_id", (F.col("p") != F.col("q")).alias("differ")))
    if not repeated.where("differ").isEmpty():
        copies = with_values(told.select("digest", "doc_id"), same, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y")).distinct()
        member = durable(components(links.union(copies), "x", "y"))
        out = told.join(member, told["doc_id"] == member["node"], "left").select("doc_id", "digest", F.coalesce("component", "doc_id").alias("component_id"))
    else:  # a copy has one text, and its class is that of the text
        of_text = same.join(classes, same["rep"] == classes["node"], "left").select("digest", "rows", F.coalesce("component", "rep").alias("component_id"))
        out = with_values(told.select("doc_id", "digest"), durable(of_text), "digest").select("doc_id", "digest", "component_id")
    kept = F.col("doc_id") == F.col("component_id")
    if not repeated.isEmpty():
        kept = kept & (F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) == 1)
    nameless = sketched.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "component_id", kept.alias("kept")).union(nameless)

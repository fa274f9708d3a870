"""Exact Jaccard join on word n-grams in a metric space.

Texts become sets of n-gram hashes. Sets carry the symmetric-difference metric
``|x ^ y|``, in which Jaccard similarity t is a ball: ``J(x, y) >= t`` holds when
``|x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)``, below called the reach of a pair.

1. *Top regions.* Texts that share nothing lie at the same distance from every
   document, so documents as pivots cannot part them and every window would
   replicate every text. The top level therefore measures distance in k
   projections of the set (hash ranges), where the metric is additive: with k a
   spare above the reach, two linked sets coincide in at least as many projections
   as are spare. Each projection value is a pivot whose Voronoi cell holds the sets
   at distance 0; sets near the border of a size class are replicated into the next
   one. A set leaves its most crowded cells, one fewer than are spare: of the cells
   that two linked sets share, the least crowded one is among those that both keep.
2. *Document pivots.* In a cell of several sets the one that shares most cells
   becomes the pivot; cells of one pivot form its region. Before whole sets travel
   to a region, its sets are compared in a contraction of the metric: the parities
   of a set's elements in a power of two of buckets, whose Hamming distance never
   exceeds ``|x ^ y|``. Sets beyond reach of all others there leave the region; the
   others fall into groups, and groups with a set in common are one region, so that
   each whole set travels to one region only. Distances to the pivot are exact;
   whoever lies within reach of it is linked to it.
3. *Windows.* In a region the metric does not change when the pivot is taken as
   the origin: ``|x ^ y| = |dx ^ dy|`` with ``dx = x ^ pivot``. Sets are put into
   rings by distance from the pivot; by the triangle inequality only rings within
   reach can hold links, and the two distances fix the least overlap of the two
   differences. Elements of no second set in the region cannot overlap; if too few
   are left no link exists, else the rarest ones name the subregions that the
   set enters, as many as the least overlap demands.
4. *Recursion.* Subregions up to ``leaf`` sets are joined directly, larger ones take
   a pivot of their own and recurse. A pivot has met its whole region, so regions
   shrink; nothing is capped and no pair within reach is lost.

Sets that are equal are one class from the start and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .storage import discard, materialize

#: Sets of a region that are still joined directly.
LEAF = 256
#: Sets of a region whose sketches one task compares; larger regions fall back to their cells, larger cells to the recursion.
SKETCHED = 2048
#: Elements that the sets of such a region may have in all; a sketch takes half a byte an element at most.
SKETCHED_ITEMS = 1 << 26
#: Ids, alone or with that of their region, whose list may be broadcast (16 bytes each at most); beyond it the join shuffles.
BROADCAST_IDS = 1 << 20
#: Parts that large classes of equal sets are dealt into where their names are not broadcast.
SALTS = 16
#: Members of a region that one task compares with its pivot at a time, and their elements (8 bytes each); also the elements of a leaf.
CHUNK, CHUNK_ITEMS = 512, 1 << 22
#: Spare projections: so many at least, and one for so many of the reach.
SPARE, SPARE_SHARE = 3, 4
#: Bits of a cell's name that hold its size class.
CLASS_BITS = 6
#: Fingerprints that a task remembers, so that copies of a text it has met emit no cells again.
REMEMBERED = 1 << 17


class Reach:
    """Threshold arithmetic in whole numbers; ``t = num / den``."""

    def __init__(self, threshold: float):
        t = Fraction(threshold).limit_denominator(10_000)
        self.num, self.den = t.numerator, t.denominator

    def of(self, total):
        """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest_partner(self, n):
        return n * self.den // self.num

    def smallest_partner(self, n):
        return -(-n * self.num // self.den)


def shingle_sets(s: K.Slice, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text; a shorter text is one n-gram."""
    w = K.words(s)
    at, h = K.ngrams(w, n)
    cut = np.searchsorted(w.doc[at], np.arange(s.n + 1))
    held = w.bounds(s.n)
    out = []
    for i in range(s.n):
        if cut[i] < cut[i + 1]:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif held[i] < held[i + 1]:
            out.append(K.combine([w.hash[j : j + 1] for j in range(held[i], held[i + 1])], salt=n))
        else:
            out.append(h[:0])
    return out


def size_classes(reach: Reach, n: int, ratio: float = 1.6) -> list[tuple[int, int]]:
    """Size classes that a set of size ``n`` enters: (class, reach in the class)."""
    out, low, k = [], 1, 0
    least = reach.smallest_partner(n)
    while low <= n:
        high = max(low, int(low * ratio))
        if high >= least:
            out.append((k, int(reach.of(high + reach.largest_partner(high)))))
        low, k = high + 1, k + 1
    return out


def cells(x: np.ndarray, reach: Reach) -> tuple[np.ndarray, list[int]]:
    """Names of the top-level cells that the sorted set ``x`` lies in, and how many crowded ones it may leave by size class.

    The class is in the lowest bits of a name; the last class is the set's own. Two linked sets coincide in ``spare``
    projections at least. Those that are empty make no cells where others are certain to
    be left, and count as left; where none is certain, all make cells and none is left.
    """
    named, leave = [], []
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(x + np.uint64(0x51ED270B)))])
    for k, far in size_classes(reach, len(x)):
        if not far:  # linked sets of this class are equal
            leave.append(0)
            continue
        spare = SPARE + far // SPARE_SHARE
        parts = far + spare
        of = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        count = np.bincount(of.astype(np.int64), minlength=parts)
        end = np.cumsum(count)
        value = mixed[end] - mixed[end - count]
        name = K.combine([np.full(parts, k, np.uint64), np.arange(parts, dtype=np.uint64), count.astype(np.uint64), value])
        name = (name << np.uint64(CLASS_BITS)) | np.uint64(k)
        empty = int((count == 0).sum())
        named.append(name[count > 0] if empty < spare else name)
        leave.append(max(0, spare - empty - 1))
    return np.concatenate(named) if named else x[:0], leave


def sketch(x: np.ndarray) -> bytes:
    """Parities of a set's elements in a power of two of buckets, two of them an element at least."""
    buckets = max(64, 1 << (2 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes' buckets: buckets that fall together add their parities."""
    parts = np.frombuffer(b, np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(parts, axis=0).view(np.uint64)


def within_reach(sizes: np.ndarray, sketches: list[bytes], reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """For sets in order of size: the group of each by sketch distances within reach, and how many it reaches."""
    k = len(sizes)
    width = np.array([len(b) for b in sketches])
    group, degree = np.arange(k), np.zeros(k, np.int64)
    last = np.searchsorted(sizes, reach.largest_partner(sizes), side="right")
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        first, end = mine[0], int(last[mine].max())
        folded = np.stack([fold(b, int(w)) for b in sketches[first:end]])
        for i in mine:
            near = np.arange(i + 1, last[i])
            far = np.bitwise_count(folded[near - first] ^ folded[i - first]).sum(axis=1, dtype=np.int64)
            near = near[far <= reach.of(sizes[i] + sizes[near])]
            if len(near):
                degree[near] += 1
                degree[i] += len(near)
                joined = np.unique(group[np.append(near, i)])
                if len(joined) > 1:
                    group[np.isin(group, joined)] = joined[0]
    return group, degree


def _prune(reach: Reach):
    """Groups of a region's sets by sketch distance, each as its most central set and the others."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table.column("x").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort([ids, sizes])
        ids, sizes = ids[order], sizes[order]
        held = table.column("sketch")
        group, degree = within_reach(sizes, [held[int(i)].as_py() for i in order], reach)
        count = np.bincount(group, minlength=len(group))
        u, v = [], []
        for g in np.flatnonzero(count > 1):
            at = np.flatnonzero(group == g)
            top = int(ids[at[np.argmax(degree[at])]])
            u += [top] * (len(at) - 1)
            v += [y for y in ids[at].tolist() if y != top]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _describe(n: int, reach: Reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for s in K.slices(batch.column(1)):
                sizes, f1, f2, flat, own, leave, sketches = [], [], [], [], [], [], []
                for x in shingle_sets(s, n):
                    mark = int(np.bitwise_xor.reduce(K.mix(x))) if len(x) else 0, int(np.add.reduce(K.mix(x ^ np.uint64(0xA5A5A5A5)))) if len(x) else 0
                    sizes.append(len(x))
                    f1.append(mark[0])
                    f2.append(mark[1])
                    named, left = cells(x, reach) if mark not in met else (x[:0], [])
                    flat.append(named)
                    own.append(size_classes(reach, len(x))[-1][0] if len(left) else 0)
                    leave.append(left)
                    sketches.append(sketch(x) if len(x) else None)
                    if len(met) < REMEMBERED:
                        met.add(mark)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.n),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.array(f1, np.uint64).view(np.int64)),
                        pa.array(np.array(f2, np.uint64).view(np.int64)),
                        K.list_array(pa.array(np.concatenate(flat).view(np.int64)), bounds),
                        pa.array(own, pa.int32()),
                        pa.array(leave, pa.list_(pa.int32())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["id", "n", "f1", "f2", "cells", "own", "leave", "sketch"],
                )

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                sets = shingle_sets(s, n)
                columns = [batch.column(0).slice(s.first, s.n), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "items"])

    return run


def _as_set(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.uint64)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _linked(both: int, n: int, m: int, reach: Reach) -> bool:
    return reach.den * both >= reach.num * (n + m - both)


def _leaf(reach: Reach):
    """Every pair of a region of at most LEAF sets, but those already in one component."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("x").to_pylist()
        sets = [_as_set(b) for b in table.column("items").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        u, v = [], []
        for a, i in enumerate(order):
            for j in order[a + 1 :]:
                if len(sets[j]) > reach.largest_partner(len(sets[i])):
                    break
                if find(i) != find(j) and _linked(common(sets[i], sets[j]), len(sets[i]), len(sets[j]), reach):
                    root[find(i)] = find(j)
                    u.append(ids[i])
                    v.append(ids[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _from_pivot(reach: Reach):
    """Distances of a chunk of a region's sets to its pivot, and what lies between them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("region", pa.int64()), ("p", pa.int64()), ("x", pa.int64()), ("np", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("ball", pa.bool_()), ("between", pa.list_(pa.int64())))})
        p = _as_set(right.column("items")[0].as_py())
        rows = {k: [] for k in ("n", "a", "ball", "between")}
        for b in left.column("items").to_pylist():
            x = _as_set(b)
            between = np.setxor1d(x, p, assume_unique=True)
            both = (len(x) + len(p) - len(between)) // 2
            rows["n"].append(len(x))
            rows["a"].append(len(between))
            rows["ball"].append(_linked(both, len(x), len(p), reach))
            rows["between"].append(between.view(np.int64))
        size = len(rows["n"])
        flat = np.concatenate(rows["between"])
        bounds = np.concatenate([[0], np.cumsum(rows["a"])])
        return pa.table(
            {
                "region": left.column("region"),
                "p": pa.array([right.column("id")[0].as_py()] * size, pa.int64()),
                "x": left.column("x"),
                "np": pa.array([len(p)] * size, pa.int64()),
                "n": pa.array(rows["n"], pa.int64()),
                "a": pa.array(rows["a"], pa.int64()),
                "ball": pa.array(rows["ball"], pa.bool_()),
                "between": K.list_array(pa.array(flat), bounds),
            }
        )

    return run


def subregions(reach: Reach, n_p: int, n: int, a: int, ball: bool, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """Subregions of one set in a region, as (element, lower ring, upper ring).

    ``shared``: what lies between the set and the pivot and also between another
    set and the pivot, rarest first. Two sets of the ball are in one component
    already, so a set of the ball only seeks sets outside it.
    """
    width = max(1, n_p // 38)
    own = a // width
    far = int(reach.of(n + reach.largest_partner(n)))
    out = []
    for ring in range(max(0, a - far) // width, (a + far) // width + 1):
        if ball and (ring + 1) * width - 1 <= reach.of(reach.smallest_partner(n) + n_p):
            continue
        overlap = max(1, -((far - a - ring * width) // 2))
        for element in shared[: max(0, len(shared) - overlap + 1)].tolist():
            out.append((element, min(own, ring), max(own, ring)))
    return out


def _enter(reach: Reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("region", "x", "np", "n", "a", "ball", "shared")}
            region, name, ring, x = [], [], [], []
            for i in range(batch.num_rows):
                own = cols["a"][i] // max(1, cols["np"][i] // 38)
                for e, lo, hi in subregions(reach, cols["np"][i], cols["n"][i], cols["a"][i], cols["ball"][i], np.array([s["e"] for s in cols["shared"][i]], np.int64)):
                    region.append(cols["region"][i])
                    name.append((e, lo, hi))
                    ring.append(own)
                    x.append(cols["x"][i])
            parts = [np.array(region, np.int64).view(np.uint64), *(np.array([t[k] for t in name], np.int64).view(np.uint64) for k in range(3))]
            cell = K.combine(parts).view(np.int64) if region else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ring, pa.int64()), pa.array([a != b for _, a, b in name], pa.bool_()), pa.array(x, pa.int64())], names=["cell", "ring", "cross", "x"])

    return run


class NgramJaccardJoin:
    """Classes, links and components of texts under an exact Jaccard threshold.

    ``documents`` needs ``id_col`` (unique long) and ``text_col``; other columns are
    ignored whatever their names. A null, empty or blank text has the empty set:
    size 0, linked with nothing, its own component. Equal texts fall into one class.
    """

    def __init__(self, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF):
        self.n, self.reach, self.id_col, self.text_col, self.leaf = n, Reach(threshold), id_col, text_col, leaf

    def _texts(self, documents: DataFrame) -> DataFrame:
        return documents.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).alias("text"))

    def components(self, documents: DataFrame) -> DataFrame:
        """``(doc_id, n_shingles, class_id, component_id)`` for each document."""
        return self._joined(*self._components(documents))

    def _joined(self, members: DataFrame, found: DataFrame) -> DataFrame:
        return members.join(found, members.rep == found.node, "left").select(
            F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")
        )

    def _components(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Written tables of documents with the representatives of their classes, and of linked representatives with their components."""
        texts = self._texts(documents)
        described = materialize(texts.mapInArrow(K.released(_describe(self.n, self.reach)), "id long, n long, f1 long, f2 long, cells array<long>, own int, leave array<int>, sketch binary"), "described")
        keys = described.select("id", "n", "f1", "f2", "own", "leave")
        classes = keys.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        classes = materialize(classes.filter("copies > 1").drop("copies"), "classes")
        named = self._with_class(keys, classes)
        members = materialize(named.select("id", "n", F.coalesce("rep", "id").alias("rep"), "own", "leave"), "members")
        discard(classes)
        links = self._links(texts, described, members)
        found = connected_components(links)
        discard(links)
        return members, found

    def representatives(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` with one document of each component, the one of the smallest id.

        Rows without an id and texts without words stay; rows that share an id are one document.
        """
        members, found = self._components(documents)
        dropped = self._joined(members, found).filter(F.col(self.id_col) != F.col("component_id"))
        dropped = materialize(dropped.select(self.id_col).distinct(), "dropped")
        discard(members, found)
        listed = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
        return documents.join(listed, self.id_col, "left_anti").select(documents.columns)

    def _links(self, texts: DataFrame, described: DataFrame, members: DataFrame) -> DataFrame:
        """Links between class representatives that make up the components, as a written table."""
        met = self._met(described, members)
        regions = self._pruned(self._by_pivot(met), described)
        discard(met, described)
        ids = regions.select(F.col("x").alias("id")).distinct()
        count = ids.count()
        if not count:
            none = materialize(ids.select(F.col("id").alias("u"), F.col("id").alias("v")), "links")
            discard(regions)
            return none
        wanted = F.broadcast(ids) if count <= BROADCAST_IDS else ids
        sets = materialize(texts.join(wanted, "id", "left_semi").mapInArrow(K.released(_set_rows(self.n)), "id long, n long, items binary"), "sets")
        parts = []
        while True:
            weighed = regions.join(sets.select(F.col("id").alias("x"), "n"), "x")
            crowd = weighed.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("elements")).filter("size > 1")
            sized = regions.join(crowd, "region")
            direct = (F.col("size") <= self.leaf) & (F.col("elements") <= CHUNK_ITEMS)
            found = self._with_items(sized.filter(direct).select("region", "x"), sets)
            parts.append(materialize(found.groupBy("region").applyInArrow(K.released_after(_leaf(self.reach)), "u long, v long").distinct(), "links"))
            large = materialize(sized.filter(~direct), "large")
            discard(regions)
            if large.isEmpty():
                discard(large)
                break
            around = materialize(self._around(large, sets), "around")
            parts.append(materialize(around.filter("ball and x <> p").select(F.col("p").alias("u"), F.col("x").alias("v")), "links"))
            regions = materialize(self._deeper(around), "regions")
            discard(around, large)
            if regions.isEmpty():
                discard(regions)
                break
        links = materialize(reduce(DataFrame.unionByName, parts).distinct(), "links")
        discard(sets, *parts)
        return links

    @staticmethod
    def _with_class(keys: DataFrame, classes: DataFrame) -> DataFrame:
        """``keys`` with the representative of their class of equal sets, if there is one; a large class is dealt out."""
        on = ["f1", "f2", "n"]
        if classes.count() <= BROADCAST_IDS // 2:
            return keys.join(F.broadcast(classes), on, "left")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(classes.withColumn("salt", salts), [*on, "salt"], "left")

    @staticmethod
    def _met(described: DataFrame, members: DataFrame) -> DataFrame:
        """``(cell, x, n, size, widest)``: the cells that class representatives stay in, with their number of sets and largest set."""
        whole = described.select(F.explode("cells").alias("cell"), "id")
        several = F.expr("min(id) over (partition by cell) <> max(id) over (partition by cell)")
        met = whole.withColumn("several", several).filter("several").select("cell", "id")
        back = F.col("own") - F.col("cell").bitwiseAND((1 << CLASS_BITS) - 1).cast("int")
        leave = F.try_element_at("leave", -1 - back)
        met = met.join(members.select("id", "rep", "n", "own", "leave"), "id").select("cell", F.col("rep").alias("x"), "n", leave.alias("leave"))
        met = materialize(met.distinct(), "cells")
        crowd = met.groupBy("cell").agg(F.count("*").alias("size"), F.max("n").alias("widest")).filter("size > 1")
        of_class = F.col("cell").bitwiseAND((1 << CLASS_BITS) - 1)
        order = Window.partitionBy("x", of_class).orderBy(F.desc("size"), "cell")
        kept = met.join(crowd, "cell").repartition("x").withColumn("rank", F.row_number().over(order)).filter("rank > leave")
        central = kept.withColumn("central", F.sum("size").over(Window.partitionBy("x")))
        out = materialize(central.select("cell", "x", "n", "size", "widest", "central"), "kept")
        discard(met)
        return out

    @staticmethod
    def _with_items(members: DataFrame, sets: DataFrame) -> DataFrame:
        """``(region, x, items)``: short member lists travel to the sets, long ones meet them in a shuffle."""
        known = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
        return sets.join(known, F.col("x") == sets.id).select("region", "x", "items")

    @staticmethod
    def _by_pivot(met: DataFrame) -> DataFrame:
        """Each cell's most central set becomes its pivot; cells of one pivot are one region, if its sketches fit one task."""
        pivots = met.groupBy("cell").agg(F.max(F.struct("central", (-F.col("x")).alias("first"))).alias("top"))
        pivots = pivots.select("cell", (-F.col("top.first")).alias("p"))
        placed = met.join(pivots, "cell").groupBy("p", "x", "n").agg(F.collect_set(F.struct("cell", "size", "widest")).alias("cells"))
        wide = placed.groupBy("p").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
        placed = placed.join(wide, "p")
        fits = (F.col("members") <= SKETCHED) & (F.col("elements") <= SKETCHED_ITEMS)
        whole = placed.filter(fits).select(F.col("p").alias("region"), "p", "x", "n")
        parts = placed.filter(~fits).select("p", "x", "n", F.inline("cells"))
        cell_fits = (F.col("size") <= SKETCHED) & (F.col("size") * F.col("widest") <= SKETCHED_ITEMS)
        region = F.when(cell_fits, F.col("cell")).otherwise(F.col("p"))
        return materialize(whole.unionByName(parts.select(region.alias("region"), "p", "x", "n").distinct()), "regions")

    def _pruned(self, regions: DataFrame, described: DataFrame) -> DataFrame:
        """Regions whose sketches fit one task by groups that may hold links; larger ones as they are."""
        crowd = regions.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("elements")).filter("size > 1")
        sized = regions.join(crowd, "region")
        fits = (F.col("size") <= SKETCHED) & (F.col("elements") <= SKETCHED_ITEMS)
        tight = sized.filter(fits).select("region", "x")
        known = F.broadcast(tight) if regions.count() <= BROADCAST_IDS else tight
        near = described.join(known, F.col("x") == F.col("id")).select("region", "x", "n", "sketch")
        stars = materialize(near.groupBy("region").applyInArrow(K.released_after(_prune(self.reach)), "u long, v long").groupBy("u", "v").agg(F.count("*").alias("times")), "stars")
        central = stars.groupBy("u").agg(F.sum("times").alias("central"))
        grouped = connected_components(stars.select("u", "v"))
        group = grouped.join(central, F.col("node") == F.col("u"), "left")
        first = F.struct(F.coalesce("central", F.lit(0)), (-F.col("node")).alias("first"))
        pivots = group.groupBy("component").agg(F.max(first).alias("top")).select("component", (-F.col("top.first")).alias("p"))
        groups = group.join(pivots, "component").select(F.xxhash64(F.lit("group"), "component").alias("region"), "p", F.col("node").alias("x"))
        out = materialize(groups.unionByName(sized.filter(~fits).select("region", "p", "x")), "groups")
        discard(stars, grouped, regions)
        return out

    def _around(self, large: DataFrame, sets: DataFrame) -> DataFrame:
        """Exact distances from the pivot of each large region, in chunks of its members."""
        chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("elements") / CHUNK_ITEMS))
        dealt = large.withColumn("chunk", F.pmod(F.xxhash64("x"), chunks))
        pivots = dealt.select("region", "chunk", "p").distinct().join(sets, F.col("p") == sets.id)
        pivots = pivots.select("region", "chunk", "id", "items").toDF("region", "chunk", "id", "items")  # columns of their own for the cogroup
        dealt = dealt.join(sets, F.col("x") == sets.id).select("region", "chunk", "x", "items").toDF("region", "chunk", "x", "items")
        schema = "region long, p long, x long, np long, n long, a long, ball boolean, between array<long>"
        return dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInArrow(_from_pivot(self.reach), schema)

    def _deeper(self, around: DataFrame) -> DataFrame:
        """Subregions that may still hold links between sets of different components."""
        unsettled = around.groupBy("region").agg(F.min("ball").alias("settled")).filter("not settled").select("region")
        rest = around.filter("x <> p").join(unsettled, "region")
        rows = rest.select("region", "x", F.explode("between").alias("e"))
        often = rows.groupBy("region", "e").agg(F.count("*").alias("freq")).filter("freq > 1")
        shared = rows.join(often, ["region", "e"]).groupBy("region", "x").agg(F.array_sort(F.collect_list(F.struct("freq", "e"))).alias("shared"))
        entered = rest.select("region", "x", "np", "n", "a", "ball").join(shared, ["region", "x"]).mapInArrow(K.released(_enter(self.reach)), "cell long, ring long, cross boolean, x long")
        crowd = entered.groupBy("cell").agg(F.count("*").alias("size"), (F.min("ring") < F.max("ring")).alias("apart"), F.max("cross").alias("cross"))
        crowd = crowd.filter("size > 1 and (apart or not cross)").select("cell", "size")
        met = entered.join(crowd, "cell").select("cell", "size", "x").distinct()
        central = met.groupBy("x").agg(F.sum("size").alias("central"))
        pivots = met.join(central, "x").groupBy("cell").agg(F.max(F.struct("central", (-F.col("x")).alias("first"))).alias("top"))
        pivots = pivots.select("cell", (-F.col("top.first")).alias("p"))
        return met.join(pivots, "cell").select(F.col("cell").alias("region"), "p", "x")

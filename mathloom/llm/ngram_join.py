"""Exact Jaccard self-join of documents on word n-grams, by pigeonhole over a partitioned universe.

The universe of n-grams is cut into segments by a hash; how many depends on a band of set sizes.
Two sets of sizes s and l with Jaccard at least t differ in at most H = (1-t)/(1+t) (s+l) elements,
so any choice of segments worth H+1 points holds one in which they agree: a segment compared
exactly is worth one point, one compared up to a single element (by one-deletion neighbourhoods)
two. The larger set of a pair chooses, by cost: segments with few elements are shared by chance
by many sets and come last, and neighbourhoods make up for them. The smaller set is indexed in all
its segments. What agrees is a candidate and is verified on the whole sets.

Sets are named by a 64-bit digest, so equal texts are one node from the start. Within a group of
equal signatures, members first meet one hub and not each other, and the links found merge them.
Only groups that still hold several components go on, with pairs across components: made by a join
where few sets are outside the largest one, else by comparing blocks of sketches. A sketch has a bit
for the parity of the elements that fall on it; two sets differ in at least as many elements as
their sketches in bits, so a pair whose sketches differ too much is dropped before whole sets are
fetched. Where a block has many pairs left, blocks of whole sets are compared, which gives links but
no pairs. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import broadcast_if_small
from ..session import cut_lineage
from .graph import components

BAND_RATIO = 1.5
SPARE = 0.04  # share of segments that also have one-deletion neighbourhoods
FEW = 32  # sets outside the largest component up to which a group forms pairs
CROWD = 2  # pairs a row up to which a block of sketches gives its pairs
BLOCK = 500  # sets of a block
TILE = 2_000  # sketches of a block
LISTED = 1_000_000  # keys up to which a list is broadcast, so that texts stay where they are
INDEXED, PROBED = 1, 2
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def ngram_set(text: bytes | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, one without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix((out + h[i : len(h) - k + 1 + i]) * _M1)
    return np.unique(out)


def digest(grams: np.ndarray) -> int:
    """Names a set: sums of two mixes of its elements, and its size."""
    if not len(grams):
        return 0
    a, b = mix(grams + _M1).sum(dtype=np.uint64), mix(grams ^ _M2).sum(dtype=np.uint64)
    return int(mix(np.array([a], np.uint64) ^ mix(np.array([b], np.uint64) + np.uint64(len(grams)))).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the elements that fall on each of at least twice as many bits as there are elements."""
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    fallen = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((fallen & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ, their words along the last axis; the wider ones are folded first."""
    while x.shape[-1] != y.shape[-1]:
        if x.shape[-1] < y.shape[-1]:
            x, y = y, x
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _by_width(sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sketches of one width, and their words."""
    widths = np.array([len(x) for x in sketches], np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), -1)


class Bands:
    """Size bands and the number of segments of each, for Jaccard at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, s: int, l: int) -> int:
        return (self.den - self.num) * (s + l) // (self.den + self.num)

    @lru_cache(None)
    def band(self, b: int) -> tuple[int, int, int, int]:
        """Smallest and largest size, plain segments and segments with neighbourhoods."""
        low = 1 if b == 0 else self.band(b - 1)[1] + 1
        high = max(low, int(low * BAND_RATIO) - 1)
        points = self.differ(high, high * self.den // self.num) + 1
        return low, high, points, max(1, int(SPARE * points))

    def of(self, n: int) -> int:
        b = 0
        while self.band(b)[1] < n:
            b += 1
        return b

    def probed(self, n: int) -> list[int]:
        """Bands that hold a size from ``num/den`` of n up to n."""
        least, b, out = -(-self.num * n // self.den), self.of(n), []
        while b >= 0 and self.band(b)[1] >= least:
            out.append(b)
            b -= 1
        return out


def allocate(counts: np.ndarray, plain: int, points: int) -> np.ndarray:
    """0, 1 or 2 points for each segment, ``points`` in all, cheapest first.

    The cost of a signature is how many sets share it by chance: one with two elements or more is
    nearly unique, one with a single element is shared by all that hold it, an empty one by a
    share of all sets.
    """
    shared = np.where(counts >= 2, 1.0, np.where(counts == 1, 1e3, 1e6))
    without_one = np.where(counts >= 3, 1.0, np.where(counts == 2, 1e3, 1e6))
    spare = np.arange(plain, len(counts))
    costs = np.concatenate([shared, counts[spare] * without_one[spare] + 1])
    segments = np.concatenate([np.arange(len(counts)), spare])
    # a second point needs the first: it never costs less than the first
    costs[len(counts) :] = np.maximum(costs[len(counts) :], shared[spare] + 1e-6)
    chosen = np.argsort(costs, kind="stable")[:points]
    return np.bincount(segments[chosen], minlength=len(counts))


def signatures(grams: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signature keys of a set and the roles it has in each."""
    n, keys, roles = len(grams), [], []
    home = bands.of(n)
    value = mix(grams + _M3)
    for b in bands.probed(n):
        _, high, plain, spare = bands.band(b)
        if plain == 1:
            continue  # sets that may not differ at all are one node already
        points = bands.differ(n, min(n, high)) + 1
        m = plain + spare
        segment = (mix(grams ^ np.uint64(b + 1)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        sums = np.zeros(m, np.uint64)
        full = np.flatnonzero(counts)
        sums[full] = np.add.reduceat(value[order], (np.cumsum(counts) - counts)[full])
        given = allocate(counts, plain, points)
        base = mix(np.arange(1, m + 1, dtype=np.uint64) * _M1 + np.uint64(b))
        role = np.where(given > 0, PROBED, 0) + (INDEXED if b == home else 0)
        use = role > 0
        keys.append(mix(base[use] ^ sums[use]))
        roles.append(role[use])
        near = np.flatnonzero(segment >= plain)
        role = np.where(given[segment[near]] > 1, PROBED, 0) + (INDEXED if b == home else 0)
        near, role = near[role > 0], role[role > 0]
        keys.append(mix(base[segment[near]] ^ (sums[segment[near]] - value[near])))
        roles.append(role)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(roles)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature (probes first) those of groups with a probe and two sets or more."""
    held: list[np.ndarray] = []  # rows of the group at the end of the last batch
    open_key = None  # a group already known to qualify, whose rows pass at once

    def emit(rows: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(rows[i]) for i in range(3)], names=["sig", "cls", "meta"])

    def qualified(rows: np.ndarray) -> np.ndarray:
        if not rows.shape[1]:
            return rows
        start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        several = np.minimum.reduceat(rows[1], start) != np.maximum.reduceat(rows[1], start)
        good = several & ((rows[2, start] & PROBED) > 0)
        return rows[:, np.repeat(good, np.diff(np.r_[start, rows.shape[1]]))]

    for batch in batches:
        rows = np.vstack([batch.column(i).to_numpy() for i in range(3)])
        if open_key is not None:
            same = rows[0] == open_key
            if same.any():
                yield emit(rows[:, same])
                rows = rows[:, ~same]
            if rows.shape[1]:
                open_key = None
            else:
                continue
        rows = np.hstack([*held, rows])
        if not rows.shape[1]:
            continue
        last = rows[0] == rows[0, -1]
        done, held = rows[:, ~last], [rows[:, last]]
        yield emit(qualified(done))
        if held[0].shape[1] > 200_000 and qualified(held[0]).shape[1]:
            yield emit(held[0])
            open_key, held = int(held[0][0, 0]), []
    if held:
        yield emit(qualified(held[0]))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) per row.

    Rows link when their n-gram sets are not empty and intersection / union is at least
    ``num / den``. A null or empty text has no n-grams and links with nothing; repeated rows are
    one document. Rows whose key is null link like others but never name a component unless all
    keys of it are null. Other columns are not read.
    """
    bands = Bands(num, den)
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    key_type = docs.schema[key].dataType

    def sets(batches: Iterator[pa.RecordBatch], hashes: dict):
        for batch in batches:
            for i, value in enumerate(batch.column(1).cast(pa.binary())):
                yield batch, i, ngram_set(value.as_py(), size, hashes)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            found = [g for _, _, g in sets([batch], hashes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(g) for g in found], pa.int64()), pa.array([len(g) for g in found], pa.int64())],
                names=["key", "cls", "n"],
            )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done, out, rows = _WordHashes(), set(), [], 0
        for _, _, grams in sets(batches, hashes):
            name = digest(grams)
            if not len(grams) or name in done:
                continue
            if len(done) > 1_000_000:
                done.clear()
            done.add(name)
            keys, roles = signatures(grams, bands)
            out.append((keys.view(np.int64), np.full(len(keys), name, np.int64), len(grams) * 4 + roles))
            rows += len(keys)
            if rows > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["sig", "cls", "meta"])
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["sig", "cls", "meta"])

    member = cut_lineage(
        source.mapInArrow(classes, T.StructType([T.StructField("key", key_type), *_LONGS("cls", "n")]))
    )
    grouped = cut_lineage(
        source.mapInArrow(signed, T.StructType(_LONGS("sig", "cls", "meta")))
        .repartition("sig")
        .sortWithinPartitions("sig", F.expr(f"(meta & {PROBED}) = 0"))
        .mapInArrow(_groups, T.StructType(_LONGS("sig", "cls", "meta")))
        .distinct()
    )

    wanted = member.join(grouped.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("key").alias("key"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            found = [g for _, _, g in sets([batch], hashes)]
            ours = [i for i, g in enumerate(found) if digest(g) == batch.column(2)[i].as_py()]
            columns = [[len(found[i]) for i in ours], [sketch(found[i]) for i in ours], [found[i].tobytes() for i in ours]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(ours, pa.int64())), *map(pa.array, columns, (pa.int64(), pa.binary(), pa.binary()))],
                names=["cls", "n", "sketch", "grams"],
            )

    wanted = broadcast_if_small(wanted, LISTED)
    chosen = source.join(wanted, source["key"].eqNullSafe(wanted["key"])).select(source["key"], "text", "cls")
    stored = cut_lineage(chosen.mapInArrow(arrays, "cls long, n long, sketch binary, grams binary").dropDuplicates(["cls"]))

    rows = grouped.select("sig", "cls", F.expr("meta >> 2").alias("n"), F.expr("meta & 3").alias("role"))
    # first, every set meets the hub that it shares most groups with
    hub = rows.groupBy("sig").agg(F.min_by(F.struct("cls", "n"), F.xxhash64("cls")).alias("hub"))
    met = rows.join(hub, "sig").filter(F.col("cls") != F.col("hub.cls")).filter(_sizes_fit("hub.n", "n", num, den))
    best = (
        met.groupBy(F.col("cls").alias("b"), F.col("hub.cls").alias("a"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("b")
        .agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    )
    links = cut_lineage(_verified(_allowed(best, stored, num, den), stored, num, den))
    named = components(links).select(F.col("node").alias("_c"), "component")
    rows = rows.join(named, rows["cls"] == F.col("_c"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("_c", "component")
    # of each group, all that is not of its largest component has yet to meet the others
    sizes = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("_k"))
    most = sizes.groupBy("sig").agg(
        F.max_by("comp", F.struct("_k", "comp")).alias("_most"), (F.sum("_k") - F.max("_k")).alias("_few"), F.sum("_k").alias("_all")
    )
    rows = cut_lineage(rows.join(most.filter("_few > 0"), "sig"))
    large = rows.filter(F.col("_few") > FEW)
    near = cut_lineage(_in_tiles(large, stored, num, den))
    pairs = _allowed(_in_pairs(rows.filter(F.col("_few") <= FEW), num, den), stored, num, den)
    pairs = pairs.unionByName(near.filter("a is not null").select("a", "b")).distinct()
    links = links.unionByName(_verified(pairs, stored, num, den))
    crowded = near.filter("a is null").select("sig").distinct()
    if not crowded.isEmpty():
        links = links.unionByName(_in_blocks(large.join(crowded, "sig"), stored, num, den))
    component = components(cut_lineage(links))

    named = member.select("cls", "key", "n")
    named = named.join(component.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("cls", F.coalesce("component", "cls"))
    # nothing links texts without n-grams; a set with n-grams is known by its class or component
    filled = named.filter("n > 0")
    least = filled.groupBy("cls").agg(F.min("key").alias("component_id"))
    out = filled.join(least, "cls").select("key", "n", "component_id")
    empty = named.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return out.unionByName(empty).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _LONGS(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


def _sizes_fit(a: str, b: str, num: int, den: int):
    return F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b)


def _in_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components in groups with few sets outside the largest one: at most FEW pairs a row."""
    few = rows.filter(F.col("comp") != F.col("_most"))
    few = few.select("sig", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("role").alias("rx"))
    met = few.join(rows, "sig").filter(
        "cx <> comp and ((rx & 2) > 0 and (role & 1) > 0 or (role & 2) > 0 and (rx & 1) > 0)"
    )
    met = met.filter(_sizes_fit("nx", "n", num, den))
    return met.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()


def _in_tiles(rows: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components in the other groups whose sketches allow a link, with their group.

    All that is not of a group's largest component meets the group, in blocks of about TILE
    sketches. A block with more than CROWD such pairs a row gives its group without a pair.
    """
    held = rows.join(stored.select("cls", "sketch"), "cls").withColumn("far", F.col("comp") != F.col("_most"))
    tiles = {name: F.ceil(F.col(size) / TILE).cast("int") for name, size in (("xs", "_few"), ("ys", "_all"))}
    held = held.withColumns(tiles).select("sig", "cls", "n", "role", "comp", "sketch", "far", "xs", "ys")
    own = lambda of: F.pmod(F.xxhash64("cls"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = held.filter("far").withColumns({"left": F.lit(True), "x": own("xs")}).withColumn("y", each("ys"))
    right = held.withColumns({"left": F.lit(False), "y": own("ys")}).withColumn("x", each("xs"))

    def near(part: pa.Table) -> pa.Table:
        left = part["left"].to_numpy()
        sides = [part.filter(pa.array(flag)) for flag in (left, ~left)]
        (cx, nx, rx, kx), (cy, ny, ry, ky) = [[t[c].to_numpy() for c in ("cls", "n", "role", "comp")] for t in sides]
        far = sides[1]["far"].to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        words = [list(_by_width(t["sketch"].to_pylist())) for t in sides]
        for ix, x in words[0]:
            for iy, y in words[1]:
                step = max(1, 1_000_000 // (len(iy) * min(x.shape[1], y.shape[1])))
                for a in range(0, len(ix), step):
                    i, j = ix[a : a + step, None], iy[None]
                    # two sets outside the largest component meet twice, and count once
                    fits = (kx[i] != ky[j]) & (~far[j] | (cx[i] < cy[j]))
                    fits &= den * np.minimum(nx[i], ny[j]) >= num * np.maximum(nx[i], ny[j])
                    fits &= ((rx[i] & PROBED > 0) & (ry[j] & INDEXED > 0)) | ((ry[j] & PROBED > 0) & (rx[i] & INDEXED > 0))
                    if fits.any():
                        differ = apart(x[a : a + step, None], y[None])
                        p, q = np.nonzero(fits & ((den + num) * differ <= (den - num) * (nx[i] + ny[j])))
                        found.append(np.vstack([cx[i[p, 0]], cy[j[0, q]]]))
                    if sum(f.shape[1] for f in found) > CROWD * part.num_rows:
                        return pa.table({"sig": part["sig"][:1], "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})
        a, b = np.hstack(found)
        return pa.table({"sig": pa.array(np.full(len(a), part["sig"][0].as_py(), np.int64)), "a": np.minimum(a, b), "b": np.maximum(a, b)})

    return left.unionByName(right).groupBy("sig", "x", "y").applyInArrow(near, "sig long, a long, b long")


def _in_blocks(rows: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """Links across components in groups with many pairs to test, without rows for pairs.

    Sets that such groups connect are cut into blocks of about BLOCK; each pair of blocks is one
    task that multiplies their incidence matrices and returns links that span what it finds.
    """
    hub = rows.groupBy("sig").agg(F.min("cls").alias("hub"))
    cluster = components(rows.join(hub, "sig").select("cls", "hub").distinct(), "cls", "hub")
    one = rows.groupBy("cls").agg(F.first("comp").alias("comp"))
    placed = cluster.withColumnRenamed("node", "cls").withColumnRenamed("component", "cluster").join(one, "cls")
    blocks = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.join(stored, "cls").select("cluster", "cls", "comp", "grams", "block", other)
    dealt = dealt.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "cls", "comp", "grams")

    def compare(part: pa.Table) -> pa.Table:
        names, comps = part["cls"].to_pylist(), part["comp"].to_pylist()
        sets = [np.frombuffer(g, np.uint64) for g in part["grams"].to_pylist()]
        sizes = np.array([len(g) for g in sets], np.int64)
        grams, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # n-grams of one set alone are in no intersection
        shared = np.flatnonzero(np.bincount(place, minlength=len(grams)) > 1)
        column = np.full(len(grams), -1)
        column[shared] = np.arange(len(shared))
        column = column[place]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, len(shared), 4096):
            i, j = np.searchsorted(column, [a, a + 4096])
            held = np.zeros((len(sets), min(4096, len(shared) - a)), np.float32)
            held[owner[i:j], column[i:j] - a] = 1
            common += held @ held.T
        x, y = np.nonzero(den * common >= num * (sizes[:, None] + sizes[None, :] - common))
        parent: dict = {}

        def root(c):
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, j in zip(x.tolist(), y.tolist()):
            if i < j:
                p, q = root(comps[i]), root(comps[j])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((names[i], names[j]))
        columns = list(zip(*out)) if out else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return dealt.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long")


def _allowed(pairs: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches allow a link, as a table; those of unlike sets end here."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, good = batch.column(2).to_numpy() + batch.column(3).to_numpy(), np.zeros(batch.num_rows, bool)
            xs, ys = [batch.column(c).to_pylist() for c in (4, 5)]
            for i, x in _by_width(xs):
                for k, y in _by_width([ys[p] for p in i]):
                    good[i[k]] = (den + num) * apart(x[k], y) <= (den - num) * sizes[i[k]]
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    drawn = lambda c: stored.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    met = pairs.join(drawn("b"), "b").join(drawn("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    return cut_lineage(met.mapInArrow(near, "a long, b long"))


def _verified(pairs: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets pass the test. The far ends fetch their sets first, then the hubs."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * common >= num * (len(x) + len(y) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    far = stored.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    hub = stored.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    met = pairs.join(far, "b").join(hub, "a").select("a", "b", "x", "y")
    return met.mapInArrow(exact, "a long, b long")

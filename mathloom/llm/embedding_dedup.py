"""Exact cosine range self-join of embeddings, cut into independent cells by pivots.

Vectors are scaled to length one, where cosine c is the Euclidean distance sqrt(2 - 2c), a metric.
Within a label, a vector's home is the cell of its nearest pivot. If y has home q and x, with home
p, lies within r of it, then d(x, q) <= r + d(y, q) <= r + d(y, p) <= 2 r + d(x, p) (triangle
inequality, twice); so x is copied to the cells of all pivots that are at most 2 r farther than
its nearest, and no pair is lost. A cell then joins without any other: blocks of its home vectors
against blocks of its members, so a task holds two blocks, however dense the cell is.

Pivots of a label lie apart from each other. Those inside one dense cluster would each be near all
of it, and every vector would be copied to each of them; kept apart, only few can be near a vector.

Equal vectors of a label are one node from the start. Of two blocks only counts and a spanning
forest of the links are kept, so they give no more rows than they have vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import broadcast_if_small
from ..session import cut_lineage
from .graph import components

PER_CELL = 2_000  # vectors a cell should hold on average
MOST_PIVOTS = 4_096  # of all labels: bounds what is broadcast to a few MB, not what is joined
HOME_BLOCK = 8_192  # home vectors, and members, of a cell that one task compares


def _link_cells(least: float):
    """Of a block of home vectors and one of members: how many links each home vector has, and links
    that span them. A row may be on both sides."""

    def run(cell: pa.Table) -> pa.Table:
        node, weight = cell["node"].to_numpy(), cell["weight"].to_numpy()
        home, other_side = (cell[c].to_numpy(zero_copy_only=False) for c in ("home", "member"))
        unit = np.array(cell["unit"].combine_chunks().flatten()).reshape(len(node), -1)
        ours, theirs, links = np.flatnonzero(home), np.flatnonzero(other_side), np.zeros(len(node), np.int64)
        parent = np.arange(len(node))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a in range(0, len(ours), 512):
            rows = ours[a : a + 512]
            for b in range(0, len(theirs), 8192):
                columns = theirs[b : b + 8192]
                near = unit[rows] @ unit[columns].T >= least
                x, y = np.nonzero(near)
                x, y = rows[x], columns[y]
                other = x != y
                links += np.bincount(x[other], weight[y[other]], len(node)).astype(np.int64)
                # links between members that already share a root say nothing new
                root = np.fromiter(map(find, range(len(node))), np.int64, len(node)) if other.any() else parent
                new = other & (root[x] != root[y])
                for i, j in set(zip(root[x[new]].tolist(), root[y[new]].tolist())):
                    i, j = find(i), find(j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
        roots = np.array([find(i) for i in range(len(node))])
        out = pa.table([pa.array(node[ours]), pa.array(links[ours]), pa.nulls(len(ours), pa.int64())], names=["node", "links", "to"])
        joined = np.flatnonzero(roots != np.arange(len(node)))
        edges = pa.table(
            [pa.array(node[joined]), pa.array(np.zeros(len(joined), np.int64)), pa.array(node[roots[joined]])],
            names=["node", "links", "to"],
        )
        return pa.concat_tables([out, edges])

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98
) -> DataFrame:
    """``key, n_links, component_id, kept`` per row, linking rows of one label with cosine >= ``least``.

    Null labels, null or zero vectors and vectors with null or non-finite components link with
    nothing: they are their own component. Repeated rows are linked with each other like any equal
    vectors. An empty table gives no rows; other columns are not read. ``kept`` marks the rows
    whose key is the smallest of its component.
    """
    spark = vectors.sparkSession
    source = vectors.select(
        vectors[key].alias("key"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("v")
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sound = source.filter(F.col("label").isNotNull() & (F.size("v") > 0)).withColumn("norm", F.sqrt(squares))
    # a null component makes the norm null, one that is not finite makes it NaN or infinite
    sound = sound.filter("norm > 0 and norm < double('Infinity')")
    hashes = [F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit("again"), "v", "label").alias("g")]
    named = sound.select("key", "label", "v", "norm", *hashes)
    single = named.groupBy("h", "g", "label", "v").agg(F.count(F.lit(1)).alias("weight"), F.first("norm").alias("norm"))
    unit = F.transform("v", lambda x: x / F.col("norm"))
    # numbered as they are stored: unlike a hash, a number names one vector however many there are
    single = cut_lineage(
        single.select("h", "g", F.monotonically_increasing_id().alias("node"), "label", "weight", F.size("v").alias("dim"), unit.alias("unit"))
    )
    member = cut_lineage(named.select("key", "h", "g").join(single.select("h", "g", "node"), ["h", "g"]).select("key", "node"))
    single = single.drop("g")

    counts = single.groupBy("label", "dim").count().orderBy(F.col("count").desc(), "label", "dim").limit(MOST_PIVOTS)
    sizes = {(r["label"], r["dim"]): r["count"] for r in counts.collect()}
    total = sum(sizes.values())
    share = max(PER_CELL, -(-total // MOST_PIVOTS))
    # pivots: the vectors of a label with the smallest hashes that lie apart
    asked = {k: max(1, n // share) for k, n in sizes.items()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) * 2 + 1e-9
    kinds = T.StructType([*(single.schema[c] for c in ("label", "dim")), T.StructField("below", T.LongType())])
    limits = [(*k, int((1 << 30) * min(1.0, 4 * asked[k] / n + 16 / n))) for k, n in sizes.items()]
    listed = F.broadcast(spark.createDataFrame(limits, kinds))  # MOST_PIVOTS rows at most
    drawn = single.join(listed, ["label", "dim"]).filter(F.pmod("h", F.lit(1 << 30)) < F.col("below"))
    pivots: dict = {}
    for r in drawn.select("label", "dim", "unit").orderBy("h", "unit").collect():
        own, point = pivots.setdefault((r["label"], r["dim"]), []), np.array(r["unit"])
        if len(own) < asked[(r["label"], r["dim"])] and (not own or ((np.array(own) - point) ** 2).sum(1).min() >= reach**2):
            own.append(point)
    shared = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})
    cells = T.StructType(
        [
            T.StructField("label", vectors.schema[label].dataType),
            T.StructField("cell", T.IntegerType()),
            T.StructField("home", T.BooleanType()),
            *single.select("node", "weight", "unit", "dim").schema,
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            row, cell, home = [], [], []
            for k in dict.fromkeys(zip(labels, dims)):
                own = np.array([i for i, x in enumerate(zip(labels, dims)) if x == k])
                points = np.array(batch.column(4).take(pa.array(own)).flatten()).reshape(len(own), -1)
                centres = shared.value.get(k, np.zeros((1, k[1])))
                far = np.sqrt(np.maximum(0, 1 + (centres**2).sum(1) - 2 * points @ centres.T))
                nearest = far.argmin(1)
                i, c = np.nonzero(far <= far.min(1, keepdims=True) + reach)
                row.append(own[i])
                cell.append(c)
                home.append(c == nearest[i])
            if not row:
                continue
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(take),
                    pa.array(np.concatenate(cell), pa.int32()),
                    pa.array(np.concatenate(home)),
                    *(batch.column(j).take(take) for j in (0, 2, 4, 3)),
                ],
                names=cells.names,
            )

    placed = cut_lineage(single.select("node", "label", "weight", "dim", "unit").mapInArrow(place, cells))
    # a large cell is worked on in blocks of both sides: a row goes to the members' block of its hash for
    # every block of home vectors and, at home, to its block there for every block of members
    cell = ["label", "dim", "cell"]
    count = lambda rows: F.ceil(F.count(rows) / HOME_BLOCK).cast("int")
    blocks = placed.groupBy(*cell).agg(count(F.when(F.col("home"), 1)).alias("homes"), count(F.lit(1)).alias("members"))
    met = placed.join(broadcast_if_small(blocks.filter("homes > 0")), cell)
    deal = F.xxhash64("node")
    at_home, at_member = F.pmod(deal, F.col("homes")), F.pmod(deal, F.col("members"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct(i.cast("long").alias("i"), at_member.alias("j")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("members") - 1), lambda j: F.struct(at_home.alias("i"), j.cast("long").alias("j")))
    pairs = F.when(F.col("home"), F.array_union(as_member, as_home)).otherwise(as_member)
    dealt = met.withColumn("_b", F.explode(pairs)).withColumns(
        {"i": F.col("_b.i"), "j": F.col("_b.j"), "member": F.col("_b.j") == at_member, "home": F.col("home") & (F.col("_b.i") == at_home)}
    )
    found = cut_lineage(
        dealt.select(*cell, "i", "j", "home", "member", "node", "weight", "unit")
        .groupBy(*cell, "i", "j")
        .applyInArrow(_link_cells(least), "node long, links long, to long")
    )
    count = found.filter("to is null").groupBy("node").agg(F.sum("links").alias("links"))
    component = components(found.filter("to is not null").select("node", "to"), "node", "to")
    named = single.select("node", "weight").join(count, "node", "left").join(component, "node", "left")
    named = named.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("comp"))
    every = member.join(named, "node").select("key", "n_links", "comp")
    least_key = every.groupBy("comp").agg(F.min("key").alias("component_id"))
    linked = every.join(least_key, "comp").select("key", "n_links", "component_id")
    rest = source.filter(F.col("label").isNull() | F.col("v").isNull() | (F.size("v") <= 0) | ~F.coalesce((F.sqrt(squares) > 0) & (F.sqrt(squares) < float("inf")), F.lit(False)))
    rest = rest.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))

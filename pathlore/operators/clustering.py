"""Density clustering on distances, k-means, PCA, relabelling and cluster descriptions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.operators import core, wide_pca
from pathlore.operators.normalize import EPS
from pathlore.operators.similarity import sparse_links

NOISE = -1
EDGES_AT_ONCE = 1 << 20  # edges of a task that are reduced together
MAX_CENTROIDS = 10_000  # centroids a task may hold
WIDE = 1024  # numbers in a vector up to which a covariance matrix is formed (8 MB)


def min_label_components(nodes: DataFrame, edges: DataFrame, ident: str = "id", a: str = "i", b: str = "j") -> DataFrame:
    """Connected components (id, component = smallest id), by alternating star contractions.

    Every round is two aggregations and two joins on single nodes; a node of any degree is only ever reduced
    to its smallest neighbour. The edge set shrinks to stars in about log(n) rounds; each round is
    checkpointed.
    """

    def relabel(edge: DataFrame, own: str, other: str) -> DataFrame:
        least = edge.groupBy(own).agg(F.min(other).alias("m"))
        return edge.join(least, own)

    def fingerprint(edge: DataFrame):
        return tuple(edge.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = core.cut_lineage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = fingerprint(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = relabel(both, "u", "v").withColumn("m", F.least("m", "u"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = relabel(large, "u", "v")
        small = (
            down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = core.cut_lineage(small)
        after = fingerprint(e)
        if after == state:
            break
        state = after
    roots = e.select(F.col("u").alias(ident), F.col("v").alias("component"))
    return nodes.select(ident).distinct().join(roots, ident, "left").withColumn("component", F.coalesce("component", F.col(ident)))


def reduced_edges(edges: DataFrame, least: int) -> DataFrame:
    """(i, j, n) with the same cores and components as ``edges`` (i, j): links, counted for both ends, and rows with j NULL that
    count n for i alone. A task sends on a few rows an item of each ``EDGES_AT_ONCE`` edges, however many lie between them."""

    def reduce(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        open_, loop = pdf["i"].isna() | pdf["j"].isna(), pdf["i"] == pdf["j"]
        alone = pd.concat([pdf["i"][open_ | loop], pdf["j"][open_ | loop]]).dropna().value_counts()  # both ends of a loop count
        plain = pdf[~open_ & ~loop]
        u, v = sparse_links(plain["i"].to_numpy(), plain["j"].to_numpy(), least)
        marked = u == v
        count = pd.DataFrame({"i": np.concatenate([u[marked], alone.index]), "j": None, "n": np.concatenate([np.full(marked.sum(), least), alone.to_numpy()])})
        return pd.concat([pd.DataFrame({"i": u[~marked], "j": v[~marked], "n": 1}), count[count["n"] > 0]], ignore_index=True).astype({"i": object, "j": object})

    def work(batches):
        parts, rows = [], 0
        for pdf in batches:
            parts.append(pdf)
            rows += len(pdf)
            if rows >= EDGES_AT_ONCE:
                yield reduce(parts)
                parts, rows = [], 0
        if rows:
            yield reduce(parts)

    kinds = {c: edges.schema[c].dataType.simpleString() for c in "ij"}
    return edges.select("i", "j").mapInPandas(work, f"i {kinds['i']}, j {kinds['j']}, n long")


def density_clusters(nodes: DataFrame, edges: DataFrame, min_neighbours: int, min_size: int, ident: str = "id") -> DataFrame:
    """One horizontal cut of density clustering: (id, label), -1 = noise.

    ``edges`` (i, j) are all pairs within the cut distance. A node whose ``min_neighbours``-th neighbour lies
    within it is a core; mutual reachability within the cut connects cores; smaller components are noise.
    """
    links = core.cut_lineage(reduced_edges(edges, min_neighbours))  # read three times below
    between = links.where("j is not null")
    ends = links.select(F.col("i").alias(ident), "n").unionByName(between.select(F.col("j").alias(ident), "n"))
    cores = ends.groupBy(ident).agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_neighbours).select(ident)
    kept = between.join(cores.withColumnRenamed(ident, "i"), "i", "left_semi").join(
        cores.withColumnRenamed(ident, "j"), "j", "left_semi"
    )
    found = min_label_components(cores, kept.select("i", "j"), ident)
    big = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size).select("component")
    members = found.join(big, "component", "left_semi")
    return nodes.select(ident).join(members, ident, "left").select(ident, F.coalesce("component", F.lit(NOISE).cast("long")).alias("label"))


def linked_clusters(nodes: DataFrame, links: DataFrame, min_neighbours: int, min_size: int, ident: str = "id") -> DataFrame:
    """``density_clusters`` of groups of equal items: ``nodes`` (id, n) stand for n items each, ``links`` are the
    ``similarity.density_links`` between them with ``min_neighbours``."""
    links = core.cut_lineage(links.select("i", "j").distinct())
    between = links.where("i <> j")
    ends = between.select(F.col("i").alias(ident), F.col("j").alias("_other")).unionByName(between.select(F.col("j").alias(ident), F.col("i").alias("_other")))
    others = nodes.select(F.col(ident).alias("_other"), F.col("n").alias("_n"))
    counted = ends.join(others, "_other").groupBy(ident).agg(F.sum("_n").alias("_n"))
    marked = links.where("i = j").select(F.col("i").alias(ident), F.lit(True).alias("_marked"))
    near = F.col("n") - 1 + F.coalesce("_n", F.lit(0))
    known = nodes.join(counted, ident, "left").join(marked, ident, "left")
    cores = core.cut_lineage(known.where(F.col("_marked").isNotNull() | (near >= min_neighbours)).select(ident, "n"))
    kept = between.join(cores.select(F.col(ident).alias("i")), "i", "left_semi").join(cores.select(F.col(ident).alias("j")), "j", "left_semi")
    found = min_label_components(cores, kept, ident).join(cores, ident)
    big = found.groupBy("component").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_size).select("component")
    members = found.join(big, "component", "left_semi").select(ident, "component")
    return nodes.select(ident).join(members, ident, "left").select(ident, F.coalesce("component", F.lit(NOISE).cast("long")).alias("label"))


def relabel_by_size(labels: DataFrame, ident: str = "id", label: str = "label") -> DataFrame:
    """Largest cluster 0, next 1, ...; ties keep the old order; noise stays -1."""
    sizes = labels.where(F.col(label) != NOISE).groupBy(label).agg((-F.count(F.lit(1))).alias("_down"))
    ranked = core.order_log(sizes.withColumn("_one", F.lit(0)), ["_one"], ["_down", label], step="_new").df.select(label, "_new")
    return labels.join(ranked, label, "left").withColumn(label, F.coalesce("_new", F.lit(NOISE)).cast("long")).drop("_new")


def kmeans(df: DataFrame, column: str, k: int, seed: int = 0, max_iter: int = 20):
    """(labelled frame, fitted model) of seeded k-means on an array<double> column."""
    data = df.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="label").fit(data)
    return model.transform(data).withColumn("label", F.col("label").cast("long")).drop("_v"), model


def assign_nearest(df: DataFrame, column: str, centroids: DataFrame, centre: str = "centre", label: str = "label") -> DataFrame:
    """Label of the nearest centroid (Euclidean, ties to the smaller label). Centroids travel in blocks of one row,
    ``MAX_CENTROIDS`` each; a further block replaces the best so far where it is nearer."""
    n = centroids.count()
    blocks = max(1, -(-n // MAX_CENTROIDS))
    numbered = centroids.withColumn("_block", F.pmod(F.xxhash64(label), F.lit(blocks)))

    def squared(c):
        diff = F.zip_with(F.col(column), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d)

    near = F.array_min(F.transform("_c", lambda s: F.struct(squared(s["c"]).alias("d"), s["l"].alias("l"))))
    out = df
    for i in range(blocks):
        mine = numbered.where(F.col("_block") == i)
        packed = mine.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col(centre).alias("c"))).alias("_c"))
        best = near if i == 0 else F.least("_n", near)  # least skips NULL, so an empty block changes nothing
        out = out.crossJoin(F.broadcast(packed)).withColumn("_n", best).drop("_c")  # one row
    return out.withColumn(label, F.col("_n.l")).drop("_n")


def reduce_dimensions(df: DataFrame, column: str, n: int = 2, out: str = "reduced", wide: int = WIDE):
    """(frame, fitted PCA or None): centred scores of the first n components; inputs of <= 2 dimensions pass through.

    Vectors of more than ``wide`` numbers are reduced in passes over the rows (``wide_pca``), others by their covariance.
    """
    width = df.agg(F.max(F.size(column))).first()[0]  # NULL for an empty frame
    if width is None or width <= 2:
        return df.withColumn(out, F.transform(column, lambda x: x.cast("double"))), None
    if width > wide:
        data = core.cut_lineage(core.spread(df.withColumn("_v", F.transform(column, lambda x: x.cast("double")))))  # read by every pass, in Python
        found = wide_pca.fit(data, "_v", width, n)
        return wide_pca.transform(data, "_v", found, out).drop("_v"), found
    data = df.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data)
    centred = centre.transform(data)
    model = PCA(k=n, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p"), model


def standardize_encodings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column-wise (x - mean) / population deviation; a constant column is only centred."""
    stats = {}
    for c in columns:
        stats |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_pop(c)}
    joined = core.attach_totals(df, [], stats)
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > EPS, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns
    }
    return joined.withColumns(scaled).drop(*stats)


def path_centroid(points: Column | str) -> dict[str, Column]:
    """Mean x and y of a packed path."""
    total = lambda a: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[a])
    return {"cx": total("x") / F.size(points), "cy": total("y") / F.size(points)}


def cluster_centroids(labelled: DataFrame, label: str = "label", columns: Sequence[str] = ("cx", "cy")) -> DataFrame:
    """Mean of the members' centroids and the member count per cluster, noise left out."""
    return labelled.where(F.col(label) != NOISE).groupBy(label).agg(
        *[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("size")
    )


def cluster_members(labels: DataFrame, label: int, items: DataFrame, ident: str = "id") -> DataFrame:
    """Items (with their metadata) of one cluster."""
    return items.join(labels.where(F.col("label") == label).select(ident), ident, "left_semi")


def cluster_summary(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row per label with its size and share, -1 for noise."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return core.attach_totals(sizes, [], {
        "n_samples": F.sum("size"),
        "n_clusters": F.count(F.when(F.col(label) != NOISE, 1)),
        "n_noise": F.coalesce(F.sum(F.when(F.col(label) == NOISE, F.col("size"))), F.lit(0)),
    })


def join_labels(labels: DataFrame, *tables: DataFrame, ident: str = "id") -> DataFrame:
    """Labels with metadata and validation columns."""
    out = labels
    for t in tables:
        out = out.join(t, ident, "left")
    return out

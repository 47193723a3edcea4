"""Voxel counts, their neighbourhoods and connected regions; the CloudLasso."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..selection.pixels import PixelGrid
from ..session import materialise
from .ordered import lookup

BLOCK = 32  # voxels per side of a block: at most 32 768 in a task's group
KEYS = ("i", "j", "k")


def voxel_counts(df: DataFrame, x: str, y: str, z: str, grids: Sequence[PixelGrid]) -> DataFrame:
    keyed = df.select(*[g.cell(F.col(c)).alias(k) for k, c, g in zip(KEYS, (x, y, z), grids)])
    return keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, structure: float) -> DataFrame:
    """Voxels with at least a share of the densest one's count."""
    top = counts.agg(F.max("n")).scalar()
    return counts.where(F.col("n") >= F.lit(float(structure)) * top)


def adjacency(voxels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of voxels that share a face, an edge or a corner, each pair once:
    the lesser voxel's keys and the other's with the suffix 2. Every voxel asks
    for its 13 greater neighbours by their index, so the join is on equal keys
    and a voxel meets at most 13 others."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    asked = voxels.select(*keys, F.explode(F.array(*[
        F.struct(*[(F.col(k) + d).alias(f"{k}2") for k, d in zip(keys, step)]) for step in steps])).alias("_q"))
    asked = asked.select(*keys, "_q.*")
    there = voxels.select(*[F.col(k).alias(f"{k}2") for k in keys])
    return asked.join(there, [f"{k}2" for k in keys], "left_semi")


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components inside one block: every voxel takes the least number among
    itself and its neighbours until nothing changes. Rows are sorted first, so
    the result does not depend on the order a shuffle delivers them in."""
    pdf = pdf.sort_values(list(KEYS), ignore_index=True)
    at = pdf[list(KEYS)].to_numpy()
    at = at - at.min(axis=0) + 1
    none = np.iinfo(np.int64).max
    grid = np.full(at.max(axis=0) + 2, none)
    where = tuple(at.T)
    grid[where] = np.arange(len(at))
    filled = grid != none
    while True:
        best = grid.copy()
        for axis in range(3):  # a cube's least value, one axis after another
            lo, hi = np.roll(best, 1, axis), np.roll(best, -1, axis)
            best = np.minimum(best, np.minimum(lo, hi))
        best = np.where(filled, best, none)
        if np.array_equal(best, grid):
            break
        grid = best
    number = grid[where]
    first = pdf.iloc[number]
    out = pdf[list(KEYS)].copy()
    for k in KEYS:
        out[f"{k}0"] = first[k].to_numpy()
    return out


def regions(voxels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds to each voxel (i, j, k) its region: the least voxel of its block's
    component, merged across blocks over their borders. Returns i, j, k and
    `region`.

    Inside a block of bounded size components are found by arrays. What is left
    is a graph of block components that touch across a border. Every round
    offers each component its neighbours' grandparents; the least goes to the
    component itself and to its parent, so whole trees are hooked at once, and
    chains are shortened. Rounds grow with the logarithm of a region's length in
    blocks. Each round's table is written once, which cuts the lineage."""
    voxels = voxels.select(*KEYS)
    b = lambda k: F.floor(F.col(k) / F.lit(block)).cast("long")
    blocked = voxels.withColumn("_bi", b("i")).withColumn("_bj", b("j")).withColumn("_bk", b("k"))
    parts = blocked.groupBy("_bi", "_bj", "_bk").applyInPandas(
        _label_block, "i long, j long, k long, i0 long, j0 long, k0 long")
    parts = materialise(parts.select(*KEYS, F.struct("i0", "j0", "k0").alias("part")), "parts")

    edge = lambda k: F.pmod(F.col(k), F.lit(block)).isin(0, block - 1)
    border = parts.where(edge("i") | edge("j") | edge("k"))
    pairs = adjacency(border)
    ends = border.select(*[F.col(k).alias(f"{k}2") for k in KEYS], F.col("part").alias("b"))
    links = pairs.join(border.select(*KEYS, F.col("part").alias("a")), list(KEYS)) \
        .join(ends, [f"{k}2" for k in KEYS]).where("a != b").select("a", "b").distinct()
    links = materialise(links.select("a", "b").union(links.select("b", "a")), "links")
    if links.isEmpty():
        return parts.withColumnRenamed("part", "region")

    label = links.select(F.col("a").alias("part")).distinct().withColumn("region", F.col("part")).withColumn("grand", F.col("part"))
    while True:
        here = label.select(F.col("part").alias("b"), F.col("grand").alias("_g"))
        offered = links.join(here, "b").groupBy(F.col("a").alias("part")).agg(F.min("_g").alias("_best"))
        own = label.join(offered, "part")
        root = own.groupBy(F.col("region").alias("part")).agg(F.min("_best").alias("_root"))
        moved = materialise(own.join(root, "part", "left").select(
            "part", F.col("region").alias("_was"), F.col("grand").alias("_old"), F.least("region", "grand", "_best", "_root").alias("region")), "hooked")
        of = moved.select(F.col("part").alias("region"), F.col("region").alias("grand"))
        step = materialise(lookup(moved, of, "region", how="inner").select("part", "region", "grand", "_was", "_old"), "labels")
        label = step.select("part", "region", "grand")
        if step.where((F.col("region") != F.col("_was")) | (F.col("grand") != F.col("_old"))).isEmpty():
            break
    merged = lookup(parts, label, "part")
    return merged.select(*KEYS, F.coalesce("region", "part").alias("region"))


def largest_region(counts: DataFrame, structure: float) -> DataFrame:
    """The voxels of the dense region with the most points (of equal ones, the
    one with the least first voxel), with the number of dense regions."""
    thick = materialise(dense(counts, structure), "dense")
    labelled = materialise(thick.join(regions(thick), list(KEYS)), "regions")
    sums = labelled.groupBy("region").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("voxels"))
    top = sums.agg(F.min(F.struct((-F.col("points")).alias("p"), F.col("region").alias("region"))).alias("m"),
                   F.count(F.lit(1)).alias("regions"))
    best = top.select("m.region").scalar()
    many = top.select("regions").scalar()
    return labelled.where(F.col("region") == best).select(*KEYS, "n", many.alias("regions"))


def cloud_lasso(df: DataFrame, x: str, y: str, z: str, inside: Column, grids: Sequence[PixelGrid],
                structure: float | None = 0.3) -> DataFrame:
    """Points in the lasso and in the largest dense region of its voxels; only
    in the lasso, without `structure`."""
    drawn = df.where(inside)
    if structure is None:
        return drawn
    counts = materialise(voxel_counts(drawn, x, y, z, grids).where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL"), "voxels")
    kept = largest_region(counts, structure).select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    keyed = drawn
    for k, c, g in zip(KEYS, (x, y, z), grids):
        keyed = keyed.withColumn(f"_{k}", g.cell(F.col(c)))
    return keyed.join(kept, [f"_{k}" for k in KEYS], "left_semi").drop(*[f"_{k}" for k in KEYS])


@dataclass(frozen=True)
class CloudStates:
    """A CloudLasso whose lasso holds still: counts per voxel and chart group, from which any `structure` is answered. The points
    are read once; a moved threshold labels the stored voxels anew, of which there are at most as many as the grids have."""

    states: DataFrame  # i, j, k, the groups, n
    groups: tuple[str, ...]

    def voxels(self, structure: float | None) -> DataFrame:
        """The voxels kept: those of the largest dense region, or all of them without `structure`."""
        counts = self.states.groupBy(*KEYS).agg(F.sum("n").alias("n"))
        return counts.select(*KEYS) if structure is None else largest_region(counts, structure).select(*KEYS)

    def rollup(self, structure: float | None) -> DataFrame:
        """The chart: points kept per group."""
        return self.states.join(self.voxels(structure), list(KEYS), "left_semi").groupBy(*self.groups).agg(F.sum("n").alias("n"))


def cloud_states(df: DataFrame, x: str, y: str, z: str, inside: Column, grids: Sequence[PixelGrid], groups: Mapping[str, Column]) -> CloudStates:
    """Warm-up: the points in the lasso, counted per voxel and group and written. Points off the grids are in no voxel."""
    keyed = df.where(inside).select(*[g.cell(F.col(c)).alias(k) for k, c, g in zip(KEYS, (x, y, z), grids)], *[c.alias(n) for n, c in groups.items()])
    counts = keyed.dropna(subset=list(KEYS)).groupBy(*KEYS, *groups).agg(F.count(F.lit(1)).alias("n"))
    return CloudStates(materialise(counts, "cloud"), tuple(groups))

"""Metadata filters as one conjunction that reaches the scan where it can."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.functions import text as T


def clean_extensions(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({x.strip().lstrip(".").lower() for x in names} - {""}))


@dataclass(frozen=True)
class FilterConfig:
    """minimum size, then globs, system, hidden, excluded and included extensions; nothing included means all."""

    include: tuple[str, ...] = ("pdf", "epub", "mobi")
    exclude: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    minimum: int = 0
    skip_hidden: bool = True
    skip_system: bool = True

    def run(self, all_files: bool = False, minimum: int | None = None) -> FilterConfig:
        """For one run: every extension, or another minimum."""
        return replace(self, include=() if all_files else self.include, minimum=self.minimum if minimum is None else minimum)

    def condition(self, path: Column, size: Column, system: Column | None = None, hidden: Column | None = None) -> Column:
        test = size >= self.minimum
        for g in self.globs:
            test &= ~path.rlike(T.glob_regex(g))
        if self.skip_system and system is not None:
            test &= ~F.coalesce(system, F.lit(False))
        if self.skip_hidden:
            own = T.leaf(path).startswith(".")
            test &= ~(own if hidden is None else own | F.coalesce(hidden, F.lit(False)))
        ext = T.extension(path)
        if clean_extensions(self.exclude):
            test &= ~F.coalesce(ext.isin(*clean_extensions(self.exclude)), F.lit(False))
        if clean_extensions(self.include):
            test &= F.coalesce(ext.isin(*clean_extensions(self.include)), F.lit(False))
        return test


def apply(inventory: DataFrame, config: FilterConfig) -> DataFrame:
    """The files that pass; columns system and hidden (attributes of some file systems) count where there are any."""
    has = lambda c: F.col(c) if c in inventory.columns else None
    return inventory.where(config.condition(F.col("path"), F.col("size_bytes"), has("system"), has("hidden")))


def overlapping_roots(roots: DataFrame, root: str = "root") -> DataFrame:
    """(outer, inner) of every two roots of which one contains the other, a root with itself aside."""
    a, b = roots.select(F.col(root).alias("outer")).distinct(), roots.select(F.col(root).alias("inner")).distinct()
    return a.join(b, T.contains(F.col("outer"), F.col("inner")) & (F.col("outer") != F.col("inner")))


def validate_roots(roots: DataFrame, root: str = "root", order: str = "ordinal") -> DataFrame:
    """roots with status and covered_by: forbidden (in quarantine), duplicate (met before), covered (below a valid
    root, the first one by length and text) or valid."""
    r = roots.withColumn("__k", F.row_number().over(Window.partitionBy(root).orderBy(order))).withColumn("__bad", T.in_quarantine(F.col(root)))
    tops = r.where(~F.col("__bad") & (F.col("__k") == 1)).select(F.col(root).alias("__top")).distinct()
    above = r.join(F.broadcast(tops), T.contains(F.col("__top"), F.col(root)) & (F.col("__top") != F.col(root)), "left")
    least = F.min(F.struct(F.length("__top").alias("n"), F.col("__top").alias("t")))["t"]
    found = above.groupBy(*roots.columns, "__k", "__bad").agg(least.alias("covered_by"))
    status = F.when(F.col("__bad"), "forbidden").when(F.col("__k") > 1, "duplicate").when(F.col("covered_by").isNotNull(), "covered").otherwise("valid")
    return found.select(*roots.columns, status.alias("status"), F.when(status == "covered", F.col("covered_by")).alias("covered_by"))


def owning_root(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """files with the longest root that contains each: a probe by equality for every ancestor of a path, so that it hashes."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = roots.select(F.regexp_replace(root, "/+$", "").alias("__root")).distinct()
    probes = files.select(path).distinct().withColumn("__root", F.explode(ancestors)).where("__root <> ''").join(known, "__root")
    best = probes.groupBy(path).agg(F.max_by("__root", F.length("__root")).alias("root"))
    return files.join(best, path, "left")

"""Where artifacts come from: sources inherited through references, and artifacts of a source path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .catalog import ancestors

MAPPING = ["source_path", "source_sheet_name", "source_table_name"]


class CatalogError(ValueError):
    """A catalog that contradicts itself."""


def direct_sources(artifacts: DataFrame, contents: DataFrame, sources: DataFrame) -> DataFrame:
    """``name`` and the distinct mappings of ``artifacts(name, kind)`` that hold content themselves.

    A typed view has those of its raw table.  ``contents`` has ``table_name,
    fingerprint``, ``sources`` has ``fingerprint`` and a mapping; a mapping
    without a path doesn't count.  Content that has none is an error.
    """
    base = F.when(F.col("kind") == "typed_content_view", F.regexp_replace("name", "_typed$", "")).otherwise(F.col("name"))
    held = artifacts.select("name", base.alias("table_name")).join(contents.select("table_name", "fingerprint").distinct(), "table_name")
    told = sources.select("fingerprint", F.trim("source_path").alias("source_path"), *(F.coalesce(c, F.lit("")).alias(c) for c in MAPPING[1:])).where("source_path != ''").distinct()
    bare = held.join(told, "fingerprint", "left_anti").agg(F.min("table_name")).first()[0]
    if bare is not None:
        raise CatalogError(f"no source is recorded for the content of {bare}")
    return held.join(told, "fingerprint").select("name", *MAPPING).distinct()


def source_mappings(artifacts: DataFrame, contents: DataFrame, sources: DataFrame, references: DataFrame) -> DataFrame:
    """``name``, a mapping and ``inherited``, of every artifact that has sources or comes to some by ``references(child, parent)``.

    An artifact with sources of its own keeps to those.  One without takes those
    of the artifacts it refers to, and so on, but no further than to the first
    ones that have sources: references of artifacts with sources are cut before
    reachability is worked out, and what is reached is linked to the sourced
    artifacts it refers to.  Paths may meet or run in circles.  References to
    what isn't in the catalog lead nowhere.
    """
    own = checkpointed(direct_sources(artifacts, contents, sources))
    sourced = own.select("name").distinct()
    bare = artifacts.select("name").distinct().join(sourced, "name", "left_anti")
    edges = checkpointed(references.select("child", "parent").distinct().join(bare.withColumnRenamed("name", "child"), "child", "left_semi"))
    between = ancestors(edges.join(bare.withColumnRenamed("name", "parent"), "parent", "left_semi"))
    reached = between.unionByName(bare.select("name", F.col("name").alias("ancestor")))
    last = edges.join(sourced.withColumnRenamed("name", "parent"), "parent", "left_semi")
    ends = reached.join(last, F.col("ancestor") == F.col("child")).select("name", F.col("parent").alias("_end")).distinct()
    inherited = ends.join(own.withColumnRenamed("name", "_end"), "_end").select("name", *MAPPING).distinct()
    return own.withColumn("inherited", F.lit(False)).unionByName(inherited.withColumn("inherited", F.lit(True)))


def _plain(path: Column) -> Column:
    return F.replace(F.trim(path), F.lit("\\"), F.lit("/"))


def _name(path: Column) -> Column:
    """The last part of a path, slashes at its end left out."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def matching_paths(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """``source_path, asked_path, reason`` of all pairs of ``stored(source_path)`` and ``asked(asked_path)`` that match.

    Reasons, the first that holds: ``exact``; ``suffix``, where one path ends in
    the other at any character; ``filename``, where the last parts are equal.
    Paths that match share the last part, so they meet by that, unless one is a
    single part that the other's last part ends in; those meet by an index of
    the ends of last parts.  So no path meets all others.  Blank paths match
    nothing; files aren't looked up, so links aren't resolved.
    """
    a = stored.select("source_path").distinct().withColumn("a", _plain(F.col("source_path"))).where("a != ''").withColumn("_name", _name(F.col("a")))
    b = asked.select("asked_path").distinct().withColumn("b", _plain(F.col("asked_path"))).where("b != ''").withColumn("_name", _name(F.col("b")))
    inner = F.explode(F.transform(F.sequence(F.lit(2), F.length("_name")), lambda i: F.substr("_name", i)))

    def ends(paths: DataFrame) -> DataFrame:
        return paths.where(F.length("_name") > 1).withColumn("_name", inner)

    def single(paths: DataFrame, column: str) -> DataFrame:
        return paths.where(F.regexp_replace(column, "/+$", "") == F.col("_name"))

    met = [(a.join(b, "_name"), True), (ends(a).join(single(b, "b"), "_name"), False), (single(a, "a").join(ends(b), "_name"), False)]
    pairs = None
    for found, named in met:
        part = found.select("source_path", "asked_path", "a", "b", F.lit(named).alias("named"))
        pairs = part if pairs is None else pairs.unionByName(part)
    exact = F.trim("source_path") == F.trim("asked_path")
    reason = F.when(exact, "exact").when(F.endswith("a", F.col("b")) | F.endswith("b", F.col("a")), "suffix").when(F.col("named"), "filename")
    return pairs.withColumn("reason", reason).where("reason is not null").select("source_path", "asked_path", "reason").distinct()


def artifacts_of(mappings: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked_path, name, source_path, reason``: the artifacts whose sources, own or inherited, match a path; the best reason of each."""
    strength = F.when(F.col("reason") == "exact", 0).when(F.col("reason") == "suffix", 1).otherwise(2)
    found = mappings.select("name", "source_path").distinct().join(matching_paths(mappings, asked), "source_path")
    return found.groupBy("asked_path", "name").agg(F.min_by(F.struct("source_path", "reason"), F.struct(strength, "source_path")).alias("m")).select("asked_path", "name", "m.*")

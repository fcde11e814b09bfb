"""Catalog and lineage tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import search_tokens
from ..session import checkpointed

# Words of a question that don't count, points of a token by where it is found, and of a kind.
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "how", "in", "is", "me", "of", "on", "show", "the", "to", "what", "which", "with")
IN_NAME, IN_COLUMN, IN_SOURCE, IN_CONTEXT, WHOLE_NAME = 5, 3, 2, 1, 2
SUGGEST_BIAS = {"typed_content_view": 3, "view_or_table": 1, "raw_content_table": -2, "internal_catalog": -5}


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: of all rows with a key, the last one in order; partially aggregated, so a hot key isn't gathered."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def value_hints(table: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` distinct values, in order, of each column, blanks left out."""
    from pyspark.sql import Window as W

    cells = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*").where("trim(value) != ''").distinct()
    return cells.withColumn("rank", F.row_number().over(W.partitionBy("column_name").orderBy("value"))).where(F.col("rank") <= n)


def ancestors(edges: DataFrame) -> DataFrame:
    """``name, ancestor`` over ``edges(child, parent)``: all that can be reached, cycles included.

    Each round joins the pairs that the last one found to all pairs and keeps
    those that are new, until there are none.  So paths aren't counted, and the
    rounds are as many as the logarithm of the longest path.
    """
    found = fresh = checkpointed(edges.select(F.col("child").alias("name"), F.col("parent").alias("ancestor")).where("name is not null and ancestor is not null").distinct())
    while not fresh.isEmpty():
        further = found.select(F.col("name").alias("_name"), F.col("ancestor").alias("_ancestor"))
        reached = fresh.join(further, F.col("ancestor") == F.col("_name")).select("name", F.col("_ancestor").alias("ancestor")).distinct()
        fresh = checkpointed(reached.join(found, ["name", "ancestor"], "left_anti"))
        found = checkpointed(found.unionByName(fresh))
    return found


def unlinked(files: DataFrame, linked: DataFrame, on: str) -> DataFrame:
    return files.join(linked, on, "left_anti")


def classified(artifacts: DataFrame, contents: DataFrame, internal: tuple[str, ...] = ()) -> DataFrame:
    """``artifacts(name, ...)`` with their ``kind``, by name and by the content tables ``contents(table_name)``."""
    base = F.regexp_replace("name", "_typed$", "")
    own = contents.select(F.col("table_name").alias("_base")).distinct()
    joined = artifacts.withColumn("_base", base).join(own.withColumn("_held", F.lit(True)), "_base", "left")
    typed = F.col("name") != F.col("_base")
    raw = artifacts.join(own, F.col("name") == F.col("_base"), "left_semi").select(F.col("name").alias("_raw")).distinct()
    joined = joined.join(raw, F.col("name") == F.col("_raw"), "left")
    kind = F.when(F.col("name").isin(*internal), "internal_catalog").when(F.col("_raw").isNotNull(), "raw_content_table").when(typed & F.col("_held"), "typed_content_view").otherwise("view_or_table")
    return joined.withColumn("kind", kind).drop("_base", "_held", "_raw")


def listed(artifacts: DataFrame, *, internal: bool = False, most: int | None = None) -> DataFrame:
    """Artifacts by type and name, internal ones only on request."""
    rows = artifacts if internal else artifacts.where("kind != 'internal_catalog'")
    rows = rows.orderBy("type", "name")
    return rows if most is None else rows.limit(most)


def search_text(*parts: Column) -> Column:
    """Everything about an artifact that a question may mention, in lower case; arrays are joined."""
    return F.lower(F.concat_ws(" ", *parts))


def suggested(artifacts: DataFrame, question: str, n: int = 10) -> DataFrame:
    """``name, score`` of the ``n`` artifacts that a question's tokens point to best.

    ``artifacts`` has ``name, kind, columns, sources`` (arrays) and ``context``.
    A token counts where it is found first: in the name, a column, a source or
    the context; all in the name count extra.  The kind's bias comes on top.
    """
    tokens = search_tokens(F.lit(question), STOP_WORDS)
    name, context = F.lower("name"), F.coalesce("context", F.lit(""))

    def within(column: str, token: Column) -> Column:
        return F.exists(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), token))

    def points(token: Column) -> Column:
        return F.when(F.contains(name, token), IN_NAME).when(within("columns", token), IN_COLUMN).when(within("sources", token), IN_SOURCE).when(F.contains(context, token), IN_CONTEXT).otherwise(0)

    found = F.aggregate(F.transform(tokens, points), F.lit(0), lambda a, x: a + x) + F.when((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(name, t)), WHOLE_NAME).otherwise(0)
    bias = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in SUGGEST_BIAS.items()), F.lit(0))
    scored = artifacts.withColumn("_found", found).where("_found > 0")
    return scored.select("name", "kind", (F.col("_found") + bias).cast("bigint").alias("score")).orderBy(F.desc("score"), "name").limit(n)


def path_match(stored: Column, asked: Column) -> Column:
    """Why a stored source path is the one asked for: ``exact``, ``suffix``, ``filename``, or null."""
    a, b = F.replace(F.trim(stored), F.lit("\\"), F.lit("/")), F.replace(F.trim(asked), F.lit("\\"), F.lit("/"))
    return (
        F.when((a == "") | (b == ""), None)
        .when(F.trim(stored) == F.trim(asked), "exact")
        .when(F.endswith(a, b) | F.endswith(b, a), "suffix")
        .when(F.substring_index(F.rtrim(a, F.lit("/")), "/", -1) == F.substring_index(F.rtrim(b, F.lit("/")), "/", -1), "filename")
    )


def load_contents(incoming: DataFrame, contents: DataFrame) -> DataFrame:
    """What loading does with each incoming table: ``source_path, fingerprint, table_name, status``.

    A fingerprint that ``contents(fingerprint, table_name)`` holds is reused; of
    several incoming tables with a new one, the first by path is loaded under its
    own name, and the others reuse that.
    """
    first = incoming.groupBy("fingerprint").agg(F.min(F.struct("source_path", "table_name")).alias("first"))
    kept = contents.groupBy("fingerprint").agg(F.min("table_name").alias("held"))
    rows = incoming.join(first, "fingerprint").join(kept, "fingerprint", "left")
    loaded = F.col("held").isNull() & (F.struct("source_path", "table_name") == F.col("first"))
    return rows.select("source_path", "fingerprint", F.coalesce("held", "first.table_name").alias("table_name"), F.when(loaded, "loaded").otherwise("reused").alias("status"))


def source_edges(sources: DataFrame) -> DataFrame:
    """Edges ``from_kind, from_id, relation, to_kind, to_id`` of ``sources(source_path, fingerprint, table_name)`` and their typed views."""
    view = F.concat("table_name", F.lit("_typed"))
    edges = [("file", F.col("source_path"), "produced", "content", F.col("fingerprint")), ("content", F.col("fingerprint"), "stored_as", "artifact", F.col("table_name")), ("artifact", F.col("table_name"), "typed_as", "artifact", view), ("artifact", view, "typed_from", "artifact", F.col("table_name"))]
    made = F.array(*(F.struct(F.lit(a).alias("from_kind"), b.alias("from_id"), F.lit(c).alias("relation"), F.lit(d).alias("to_kind"), e.alias("to_id")) for a, b, c, d, e in edges))
    return sources.select(F.explode(made).alias("e")).select("e.*").distinct()


def replaced_edges(edges: DataFrame, name: str, dependencies: DataFrame) -> DataFrame:
    """Edges with those of the saved view ``name`` replaced by one to each of ``dependencies(name)``."""
    rest = edges.where(~((F.col("from_kind") == "artifact") & (F.col("from_id") == name) & (F.col("relation") == "depends_on")))
    fresh = dependencies.select(F.lit("artifact").alias("from_kind"), F.lit(name).alias("from_id"), F.lit("depends_on").alias("relation"), F.lit("artifact").alias("to_kind"), F.col("name").alias("to_id")).distinct()
    return rest.unionByName(fresh)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that start or end at one of ``ids(kind, id)``, once each."""
    starts = edges.join(ids.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id")), ["from_kind", "from_id"], "left_semi")
    ends = edges.join(ids.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id")), ["to_kind", "to_id"], "left_semi")
    return starts.unionByName(ends).distinct()


def without(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ``ids(kind, id)``."""
    gone = ids.select("kind", "id").distinct()
    return edges.join(gone, (F.col("from_kind") == F.col("kind")) & (F.col("from_id") == F.col("id")), "left_anti").join(gone, (F.col("to_kind") == F.col("kind")) & (F.col("to_id") == F.col("id")), "left_anti")


def unreferenced(contents: DataFrame, sources: DataFrame) -> DataFrame:
    """Content tables whose fingerprint no source has any more."""
    return contents.join(sources, "fingerprint", "left_anti")


def targets_by_source(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``source, targets``: the distinct targets of each source in order, joined by commas."""
    return pairs.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct().groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))


def same_stem(items: DataFrame, key: str, stem: str) -> DataFrame:
    """``key, stem, results``: how many other items have an item's stem.  A common stem is counted, not paired."""
    sizes = items.groupBy(stem).agg(F.count("*").alias("_n"))
    return items.join(sizes, stem).select(key, stem, (F.col("_n") - 1).alias("results"))


def preferred(artifacts: DataFrame) -> DataFrame:
    """``artifacts(name, kind, ...)`` without raw tables that have a typed view."""
    typed = artifacts.where("kind = 'typed_content_view'").select(F.regexp_replace("name", "_typed$", "").alias("_raw"))
    return artifacts.join(typed, (F.col("kind") == "raw_content_table") & (F.col("name") == F.col("_raw")), "left_anti")


def artifact_map(artifacts: DataFrame, sources: DataFrame, references: DataFrame, results: DataFrame) -> DataFrame:
    """``input_file, table_name, sql_files, results``: what was made of each input file.

    From ``artifacts(name, kind)``, ``sources(source_path, table_name)`` of raw
    tables, ``references(sql_path, table_name)`` and ``results(sql_path,
    result_path)``.  A typed view stands for its raw table, with the SQL files of both.
    """
    kept = preferred(artifacts).select("name", F.when(F.col("kind") == "typed_content_view", F.regexp_replace("name", "_typed$", "")).otherwise(F.col("name")).alias("_base"))
    inputs = sources.where("trim(source_path) != ''").select(F.trim("source_path").alias("input_file"), F.col("table_name").alias("_base")).distinct().join(kept, "_base")
    named = kept.select("name", F.explode(F.array_distinct(F.array("name", "_base"))).alias("table_name"))
    used = named.join(references, "table_name").select("name", "sql_path").distinct().join(results, "sql_path", "left")
    files = used.groupBy("name").agg(F.array_sort(F.collect_set("sql_path")).alias("sql_files"), F.array_sort(F.collect_set("result_path")).alias("results"))
    none = F.array().cast("array<string>")
    return inputs.join(files, "name", "left").select("input_file", F.col("name").alias("table_name"), F.coalesce("sql_files", none).alias("sql_files"), F.coalesce("results", none).alias("results"))

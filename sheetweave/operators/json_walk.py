"""JSON texts as rows: their parts, level by level, by Spark's variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _described(level: DataFrame, key: list[str]) -> DataFrame:
    """Each part with its kind, and the text of what isn't an object or array."""
    schema = F.schema_of_variant("_v")
    kind = (
        F.when(F.is_variant_null("_v"), "null").when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "array")
        .when(schema == "BOOLEAN", F.variant_get("_v", "$", "string")).when(schema == "BIGINT", "integer").when(schema == "STRING", "text").otherwise("real")
    )
    atom = F.when(~kind.isin("object", "array", "null"), F.variant_get("_v", "$", "string"))
    return level.select(*key, "fullkey", "key", "parent", "depth", kind.alias("type"), atom.alias("atom"), "_v")


def json_tree(rows: DataFrame, key: list[str], json: str, most_levels: int | None = None) -> DataFrame:
    """``key, fullkey, key, parent, depth, type, atom`` of every part of the JSON text of each row, itself first.

    ``fullkey`` leads from ``$`` to the part, as ``$.a[0]``, with quotes about
    names that aren't letters, digits and underscores; ``parent`` is that of what
    holds it.  Types are null, true, false, integer, real, text, array and
    object; ``atom`` is the text of those with a value.  All parts of a level are
    found at once, so the rounds are the depth of the deepest text.  Null texts
    and texts that aren't JSON give no rows.
    """
    first = rows.select(*key, F.try_parse_json(json).alias("_v")).where("_v is not null").select(*key, F.lit("$").alias("fullkey"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "_v")
    level = checkpointed(_described(first, key))
    found, depth = level.drop("_v"), 0
    while most_levels is None or depth < most_levels:
        holders = level.where("type in ('object', 'array')")
        if holders.isEmpty():
            break
        depth += 1
        inner = holders.select(*key, F.col("fullkey").alias("parent"), F.col("type").alias("_of"), F.col("_v").alias("_held"))
        parts = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_held").outer()))
        plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        step = F.when(F.col("_of") == "array", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), "key", F.lit('"')))
        name = F.when(F.col("_of") == "array", F.col("pos").cast("string")).otherwise(F.col("key"))
        level = checkpointed(_described(parts.select(*key, F.concat("parent", step).alias("fullkey"), name.alias("key"), "parent", F.lit(depth).alias("depth"), F.col("value").alias("_v")), key))
        found = found.unionByName(level.drop("_v"))
    return found


def json_each(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """The parts of the outermost object or array of each row's JSON text; of one that is neither, itself."""
    tree = json_tree(rows, key, json, 1)
    return tree.where("depth = 1 or (depth = 0 and type not in ('object', 'array'))")

"""Registered queries of the table operators, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells
from .operators import catalog, documents, inspection, layout, reshape, search, segment, typing
from .registry import ORACLES, QUERIES, query, table, views
from .sources import grid

def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw content table: every cell text."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber,
  regexp_full_match(replace(trim(q), ',', ''), '[+-]?[0-9]{1,18}') as quantity_is_integer,
  regexp_full_match(replace(trim(p), ',', ''), '[+-]?[0-9]+\\.[0-9]+') as price_is_real
  from (select *, l_quantity::bigint::varchar as q, l_extendedprice::decimal(18,2)::varchar as p from lineitem)""")
def numeric_text_predicates(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), cells.is_integer(F.col("l_quantity").cast("bigint").cast("string")).alias("quantity_is_integer"), cells.is_real(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price_is_real"))


@query("""select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as column_name,
  unnest([case when bool_and(regexp_full_match(o_orderkey::varchar, '[+-]?[0-9]+')) then 'INTEGER' else 'TEXT' end,
          case when bool_and(regexp_full_match(o_custkey::varchar, '[+-]?[0-9]+')) then 'INTEGER' else 'TEXT' end,
          case when bool_and(regexp_full_match(o_orderstatus, '[+-]?[0-9]+')) then 'INTEGER' else 'TEXT' end,
          case when bool_and(regexp_full_match(o_totalprice::decimal(18,2)::varchar, '[+-]?[0-9]+(\\.[0-9]+)?')) then 'REAL' else 'TEXT' end,
          case when bool_and(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') is not null) then 'DATE' else 'TEXT' end,
          case when bool_and(regexp_full_match(o_orderpriority, '[+-]?[0-9]+')) then 'INTEGER' else 'TEXT' end]) as column_type
  from orders""")
def infer_column_types(spark, sf_dir):
    return typing.infer_types(orders_text(spark, sf_dir))


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice::decimal(18,2)::double as o_totalprice, o_orderdate::date as o_orderdate, o_orderpriority from orders""")
def typed_projection(spark, sf_dir):
    return typing.typed_view(orders_text(spark, sf_dir))


@query("""select n_nationkey, sha256(n_nationkey::varchar || chr(31) || n_name || chr(31) || n_regionkey::varchar) as fingerprint from nation""")
def row_fingerprint(spark, sf_dir):
    return typing.row_fingerprint(table(spark, sf_dir, "nation"), ["n_nationkey"])


@query("""select sha256('r_regionkey' || chr(31) || 'r_name' || chr(30) || string_agg(r_regionkey::varchar || chr(31) || r_name, chr(30) order by r_regionkey)) as fingerprint, count(*) as row_count from region""")
def table_fingerprint(spark, sf_dir):
    return typing.table_fingerprint(table(spark, sf_dir, "region"), ["r_regionkey"])


@query("""select sha256(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by text""")
def dedupe_by_fingerprint(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return typing.first_of_each(t, ["fingerprint"], "doc_id").select("fingerprint", "doc_id", "copies")


@query("""select count(*) as row_count, 1::bigint as column_count, count(*) filter (where trim(l) = '') as blank_rows,
  quantile_cont((trim(l) != '')::int, 0.5)::double as median_filled from (select unnest(string_split(text, chr(10))) as l from documents)""")
def grid_profile(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source_id"), F.explode(F.split("text", "\n")).alias("l")).select("source_id", F.array("l").alias("cells"))
    return layout.profile(g).drop("source_id")


@query("""select p_partkey as row_id, p_name as first_cell, p_brand as last_cell from part where p_partkey between 11 and 30""")
def grid_window(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    g = grid.as_grid(p, "p_partkey", "part")
    return grid.window(g, 12, 20, 2, 3).select("row_id", F.col("cells")[0].alias("first_cell"), F.col("cells")[1].alias("last_cell"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a messy sheet: title, blank row, header, body, totals."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3).cast("bigint").alias("row_id"), F.array("n_name", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("cells"))
    extra = spark.createDataFrame([(0, ["Report", "", ""]), (1, ["", "", ""]), (2, ["name", "region", "key"]), (1000, ["", "Total", "300"]), (1001, ["", "Rounding error", "0"])], "row_id bigint, cells array<string>")
    return n.unionByName(extra).withColumn("source_id", F.lit("sheet")).select("source_id", "row_id", "cells")


_SHEET = """(select n_nationkey::bigint + 3 as row_id, n_name as a, n_regionkey::varchar as b, n_nationkey::varchar as c from nation
  union all values (0, 'Report', '', ''), (1, '', '', ''), (2, 'name', 'region', 'key'), (1000, '', 'Total', '300'), (1001, '', 'Rounding error', '0'))"""


@query(f"""select row_id, n >= 2 and letters >= greatest(2, n - 1) and numbers <= 1 as is_header from (
  select row_id, (trim(a) != '')::int + (trim(b) != '')::int + (trim(c) != '')::int as n,
    regexp_matches(a, '[A-Za-z]')::int + regexp_matches(b, '[A-Za-z]')::int + regexp_matches(c, '[A-Za-z]')::int as letters,
    regexp_full_match(a, '[0-9]+')::int + regexp_full_match(b, '[0-9]+')::int + regexp_full_match(c, '[0-9]+')::int as numbers from {_SHEET})""")
def header_predicate(spark, sf_dir):
    return _sheet(spark, sf_dir).select("row_id", layout.header_like(F.col("cells")).alias("is_header"))


@query(f"""select row_id from {_SHEET} where lower(trim(a)) in ('total', 'grand total', 'rounding error') or lower(trim(b)) in ('total', 'grand total', 'rounding error') or lower(trim(c)) in ('total', 'grand total', 'rounding error')""")
def footer_hints(spark, sf_dir):
    return layout.footers(_sheet(spark, sf_dir)).select("row_id")


@query()
def region_boxes(spark, sf_dir):
    return layout.regions(_sheet(spark, sf_dir))


@query("""select c_custkey, 'c_name' as column_name, c_name as value from customer where contains(lower(c_name), '00012')
  union all select c_custkey, 'c_mktsegment', c_mktsegment from customer where contains(lower(c_mktsegment), '00012')""")
def search_rows_literal(spark, sf_dir):
    return search.search_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], "00012")


@query("""select c_custkey, 'c_name' as column_name, c_name as value from customer where regexp_matches(c_name, '(?i)0[1-3]{3}$')""")
def search_rows_regex(spark, sf_dir):
    return search.search_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_name"], "0[1-3]{3}$", regex=True)


@query("""select doc_id, line_no, line from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents) where contains(lower(line), 'licensed under')""")
def search_lines(spark, sf_dir):
    return search.search_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "licensed under")


@query("""select column_name, value, rank from (select *, row_number() over (partition by column_name order by value) as rank from (
  select distinct 'p_brand' as column_name, p_brand as value from part union all select distinct 'p_type', p_type from part)) where rank <= 5""")
def distinct_value_hints(spark, sf_dir):
    return catalog.value_hints(table(spark, sf_dir, "part"), ["p_brand", "p_type"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("""with recursive e(child, parent) as (select n_nationkey, n_nationkey // 2 from nation where n_nationkey > 0),
  up(name, ancestor) as (select child, parent from e union select up.name, e.parent from up join e on e.child = up.ancestor)
  select name::bigint as name, ancestor::bigint as ancestor from up""")
def lineage_transitive(spark, sf_dir):
    e = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("bigint").alias("child"), F.expr("cast(n_nationkey div 2 as bigint)").alias("parent"))
    return catalog.ancestors(e)


@query("""select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_wins_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return catalog.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def unlinked_files(spark, sf_dir):
    linked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.unlinked(table(spark, sf_dir, "customer").select("c_custkey"), linked, "c_custkey")


@query("""select conv_id, min(turn) as turn, count(*) as n_rows, string_agg(text, ' ' order by turn) as text from (
  select *, sum((role = 'user')::int) over (partition by conv_id order by turn, text rows unbounded preceding) as island from conversations) group by conv_id, island""")
def continuation_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("role")).otherwise(F.lit("")))
    return reshape.merge_continuations(c, ["conv_id"], "turn", "head", "text").select("conv_id", "turn", "n_rows", "text")


@query("""select conv_id, turn, last_value(case when role = 'user' then length(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as context from conversations""")
def context_forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return reshape.carry_context(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.length("text").cast("bigint")), "context").select("conv_id", "turn", "context")


@query("""select event_id, user_id, (coalesce(sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as part from events""")
def split_by_boundary(spark, sf_dir):
    return reshape.split_parts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "part")


@query("""select user_id, min(value) filter (where event_type = 'click') as click, min(value) filter (where event_type = 'view') as view, min(value) filter (where event_type = 'purchase') as purchase from events group by user_id""")
def transpose_labels(spark, sf_dir):
    return reshape.transpose_labels(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["click", "view", "purchase"])


@query("""select b.name, count(*) as n, sum(l_quantity::bigint)::bigint as quantity from lineitem join (values ('low', 0, 10), ('mid', 10, 30), ('high', 30, 100)) as b(name, low, high) on l_quantity >= low and l_quantity < high group by b.name""")
def coordinate_bands(spark, sf_dir):
    bands = spark.createDataFrame([("low", 0, 10), ("mid", 10, 30), ("high", 30, 100)], "name string, low int, high int")
    placed = reshape.place_in_bands(table(spark, sf_dir, "lineitem").select("l_quantity"), bands, "l_quantity")
    return placed.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("""select user_id, table_no, count(*) as n_chunks, min(event_id) as first_id from (
  select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as table_no from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as b from events)) group by all""")
def chunk_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    breaks = reshape.breaks_after("ts", "6 hours", ["user_id"], ["ts", "event_id"])
    merged = reshape.merge_chunks(e, ["user_id"], ["ts", "event_id"], breaks)
    return merged.groupBy("user_id", "table_no").agg(F.count("*").alias("n_chunks"), F.min("event_id").alias("first_id"))


@query("""select doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\\v]+', ' ', 'g'))) as cleaned from documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cells.clean_text(F.col("text"))).alias("cleaned"))


@query("""select left_id, right_id, count(*) as overlap from (select distinct doc_id as left_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from documents where doc_id % 100 = 0)
  join (select distinct item_id as right_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from benchmark) using (t) where length(t) >= 2 group by all""")
def token_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), cells.search_tokens(F.col("text")).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), cells.search_tokens(F.col("text")).alias("tokens"))
    return search.token_overlap(d, b, "tokens")


@query("""select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from (
  select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score
  from embeddings q join embeddings e on q.vec_id % 100 = 0 and e.vec_id != q.vec_id)) where r <= 10""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.nearest(e, e.where("id % 100 = 0"), 10)


@query("""select conv_id, field_no, list_extract(t, 1) as field, array_to_string(t[2:], chr(10)) as value from (
  select conv_id, field_no, list(text order by turn, text) as t from (
    select *, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as field_no from conversations) where field_no > 0 group by all)""")
def field_value(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return documents.field_values(c, ["conv_id"], "turn", F.col("role") == "user", "text")


@query("""with recursive l as (select conv_id, text, regexp_matches(text, '^[A-M]') as v, row_number() over (partition by conv_id order by turn) as k from conversations),
  step(conv_id, k, pair) as (select conv_id, 1, null::bigint from l where k = 1
    union all select s.conv_id, case when n.v then s.k + 2 else s.k + 1 end, case when n.v then s.k end from step s join l n on n.conv_id = s.conv_id and n.k = s.k + 1)
  select a.conv_id, a.text as label, b.text as value from step join l a on a.conv_id = step.conv_id and a.k = pair join l b on b.conv_id = a.conv_id and b.k = a.k + 1""")
def label_value_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return documents.label_value_pairs(c, ["conv_id"], "turn", "text", "^[A-M]").select("conv_id", "label", "value")


@query("""with s as (select doc_id, (case when n_chars <= 500 then 'short' when n_chars <= 3000 then 'medium' else 'long' end) || '|' || (case when len(string_split(text, chr(10))) <= 2 then 'few' when len(string_split(text, chr(10))) <= 10 then 'some' else 'many' end) as signature from documents),
  r as (select *, row_number() over (partition by signature order by doc_id) as k from s)
  select signature, count(*) as pages, string_agg(doc_id::varchar, ',' order by doc_id) filter (where k <= 5) as samples from r group by signature""")
def layout_signature(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = [documents.bucket(F.col("n_chars"), [500, 3000], ["short", "medium", "long"]), documents.bucket(F.size(F.split("text", "\n")), [2, 10], ["few", "some", "many"])]
    return documents.signatures(d, "doc_id", parts)


@query(r"""select page_id, replace(replace(replace(replace(replace(replace(replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '(?s)<!--.*?-->|<[!/?a-zA-Z][^>]*>', chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')), lambda x: x != ''), chr(10)), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') as text from pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.html_text(F.col("html")).alias("text"))


@query("""select o_orderpriority as source, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as targets from orders group by 1""")
def source_to_targets(spark, sf_dir):
    return catalog.targets_by_source(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("""select page_id, stem, count(*) over (partition by stem) - 1 as results from (select page_id, regexp_extract(url, '([^/.]+)[^/]*$', 1) as stem from pages)""")
def stem_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/.]+)[^/]*$", 1).alias("stem"))
    return catalog.same_stem(p, "page_id", "stem")


@query("""select conv_id, quantile_cont(length(text), 0.5)::double as median from conversations where trim(text) != '' group by conv_id""")
def median_non_blank(spark, sf_dir):
    return layout.median_of(table(spark, sf_dir, "conversations").where("trim(text) != ''"), ["conv_id"], F.length("text"), "median")


@query()
def stronger_header_ahead(spark, sf_dir):
    return segment.described(_sheet(spark, sf_dir)).select("row_id", "starts")


@query()
def segment_grid(spark, sf_dir):
    return segment.segment(_sheet(spark, sf_dir))


# A catalog of artifacts made of parts: every fourth is a typed view, every fourth a raw table, and so on.
_KINDS = ("typed_content_view", "view_or_table", "raw_content_table", "internal_catalog")


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.format_string("%s %d", "p_name", "p_partkey").alias("name"), kind.alias("kind"), F.when(kind.contains("view"), "view").otherwise("table").alias("type"), F.array("p_brand", "p_type").alias("columns"), F.array(F.concat(F.lower("p_type"), F.lit(".csv"))).alias("sources"))
    return p.withColumn("context", catalog.search_text(F.col("name"), F.col("type"), F.col("kind"), F.col("columns"), F.col("sources")))


_ARTIFACTS = """(select *, lower(concat_ws(' ', name, type, kind, brand, ptype, source)) as context from (select *, case when kind like '%view%' then 'view' else 'table' end as type, lower(ptype) || '.csv' as source from (
  select p_name || ' ' || p_partkey as name, (['typed_content_view', 'view_or_table', 'raw_content_table', 'internal_catalog'])[p_partkey % 4 + 1] as kind, p_brand as brand, p_type as ptype from part)))"""


def _points(token: str) -> str:
    return f"case when contains(lower(name), '{token}') then 5 when contains(lower(brand), '{token}') or contains(lower(ptype), '{token}') then 3 when contains(source, '{token}') then 2 when contains(context, '{token}') then 1 else 0 end"


@query(f"""select name, kind, (found + case kind when 'typed_content_view' then 3 when 'view_or_table' then 1 when 'raw_content_table' then -2 else -5 end)::bigint as score from (
  select *, {_points("small")} + {_points("ring")} + {_points("economy")} + {_points("csv")} as found from {_ARTIFACTS}) where found > 0 order by score desc, name limit 25""")
def suggest_tables(spark, sf_dir):
    return catalog.suggested(_artifacts(spark, sf_dir), "Show me the small ring by ECONOMY in csv", 25)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [("name", F.col("name")), ("type", F.col("type")), ("kind", F.col("kind")), ("column", F.col("columns")[0]), ("column", F.col("columns")[1]), ("source_path", F.col("sources")[0])]
    made = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f).alias("field"), v.alias("value")) for i, (f, v) in enumerate(each)))
    return _artifacts(spark, sf_dir).select(F.col("name").alias("id"), "type", "kind", F.explode(made).alias("f")).select("id", "type", "kind", "f.*")


_BEST = f"""(select name as id, 'sqlite_' || type as type, f.field as field, f.value as value, (f.w + case kind when 'typed_content_view' then 5 when 'view_or_table' then 3 when 'raw_content_table' then -2 else -6 end)::bigint as rank from (
  select *, row_number() over (partition by name order by f.w desc, f.p) as r from (select name, type, kind, unnest([struct_pack(p := 0, field := 'name', value := name, w := 80), struct_pack(p := 1, field := 'type', value := type, w := 20), struct_pack(p := 2, field := 'kind', value := kind, w := 20),
    struct_pack(p := 3, field := 'column', value := brand, w := 70), struct_pack(p := 4, field := 'column', value := ptype, w := 70), struct_pack(p := 5, field := 'source_path', value := source, w := 75)]) as f from {_ARTIFACTS})
  where contains(lower(f.value), 'ec')) where r = 1)"""


@query(f"select * from {_BEST}")
def metadata_search(spark, sf_dir):
    return search.metadata_matches(_fields(spark, sf_dir).withColumn("type", F.concat(F.lit("sqlite_"), "type")), "ec")


@query(f"""select id, type, line, rank from (select id, type, null::bigint as line, rank from {_BEST} union all
  select doc_id::varchar, 'output_file', line_no, 35 from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents) where contains(lower(line), 'licensed under'))
  order by rank desc, case type when 'sqlite_view' then 0 when 'sqlite_table' then 1 else 3 end, id, coalesce(line, 0) limit 1200""")
def search_rank_topk(spark, sf_dir):
    """Two scopes in one order: metadata and lines of files."""
    tables_ = metadata_search(spark, sf_dir).select("id", "type", F.lit(None).cast("bigint").alias("line"), "rank")
    lines = search_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.lit("output_file").alias("type"), F.col("line_no").alias("line"), F.lit(35).cast("bigint").alias("rank"))
    return search.ranked(tables_.unionByName(lines), 1200)


@query(f"""select name, type, kind from {_ARTIFACTS} where kind != 'internal_catalog' order by type, name limit 100""")
def list_artifacts(spark, sf_dir):
    return catalog.listed(_artifacts(spark, sf_dir), most=100).select("name", "type", "kind")


@query("""with a as (select n_name as name, n_nationkey % 2 = 0 as held from nation union all select n_name || '_typed', false from nation)
  select name, case when name = 'NATION_1' then 'internal_catalog' when name in (select n_name from nation where n_nationkey % 2 = 0) then 'raw_content_table' when ends_with(name, '_typed') and replace(name, '_typed', '') in (select n_name from nation where n_nationkey % 2 = 0) then 'typed_content_view' else 'view_or_table' end as kind from a""")
def classify_artifacts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = n.select(F.col("n_name").alias("name")).unionByName(n.select(F.concat("n_name", F.lit("_typed")).alias("name")))
    return catalog.classified(names, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("table_name")), ("NATION_1",))


@query("""with held as (select md5(text) as fingerprint, min('old_' || doc_id) as table_name from documents where source = 'src0' group by 1),
  i as (select 'in/' || doc_id || '.csv' as source_path, md5(text) as fingerprint, 'table_' || doc_id as table_name from documents)
  select i.source_path, i.fingerprint, coalesce(held.table_name, first_value(i.table_name) over w) as table_name, case when held.table_name is null and row_number() over w = 1 then 'loaded' else 'reused' end as status
  from i left join held using (fingerprint) window w as (partition by i.fingerprint order by i.source_path, i.table_name)""")
def load_contents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("fingerprint"))
    held = d.where("source = 'src0'").select("fingerprint", F.format_string("old_%d", "doc_id").alias("table_name"))
    return catalog.load_contents(d.select(F.format_string("in/%d.csv", "doc_id").alias("source_path"), "fingerprint", F.format_string("table_%d", "doc_id").alias("table_name")), held)


def _nation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.format_string("in/%s.csv", "n_name").alias("source_path"), F.format_string("f%d", F.col("n_nationkey") % 7).alias("fingerprint"), F.format_string("t%d", F.col("n_nationkey") % 7).alias("table_name"))


_EDGES = """(select distinct e.from_kind, e.from_id, e.relation, e.to_kind, e.to_id from (select unnest([struct_pack(from_kind := 'file', from_id := 'in/' || n_name || '.csv', relation := 'produced', to_kind := 'content', to_id := 'f' || k), struct_pack(from_kind := 'content', from_id := 'f' || k, relation := 'stored_as', to_kind := 'artifact', to_id := 't' || k),
  struct_pack(from_kind := 'artifact', from_id := 't' || k, relation := 'typed_as', to_kind := 'artifact', to_id := 't' || k || '_typed'), struct_pack(from_kind := 'artifact', from_id := 't' || k || '_typed', relation := 'typed_from', to_kind := 'artifact', to_id := 't' || k)]) as e from (select *, n_nationkey % 7 as k from nation)))"""


@query(f"select * from {_EDGES}")
def source_lineage(spark, sf_dir):
    return catalog.source_edges(_nation_sources(spark, sf_dir))


@query(f"""select * from {_EDGES} where not (from_kind = 'artifact' and from_id = 'v' and relation = 'depends_on') union all values ('artifact', 'v', 'depends_on', 'artifact', 't2_typed')""")
def view_lineage(spark, sf_dir):
    """A saved view that is replaced: its dependencies come from its SQL."""
    from .plans.guard import referenced_names

    e = source_lineage(spark, sf_dir)
    old = catalog.replaced_edges(e, "v", spark.createDataFrame([("t1",), ("t5",)], "name string"))
    names = referenced_names(spark, "with t1 as (select 1 as x) select x from t2_typed, (select 't5' as x)", [f"t{i}{x}" for i in range(7) for x in ("", "_typed")])
    return catalog.replaced_edges(old, "v", spark.createDataFrame([(n,) for n in names], "name string"))


@query(f"""select * from {_EDGES} where (from_kind = 'artifact' and from_id = 't3') or (to_kind = 'artifact' and to_id = 't3')""")
def relationship_metadata(spark, sf_dir):
    return catalog.touching(source_lineage(spark, sf_dir), spark.createDataFrame([("artifact", "t3")], "kind string, id string"))


@query(f"""select * from {_EDGES} where not (from_kind = 'content' and from_id in ('f1', 'f2')) and not (to_kind = 'content' and to_id in ('f1', 'f2'))""")
def stale_lineage_deleted(spark, sf_dir):
    return catalog.without(source_lineage(spark, sf_dir), spark.createDataFrame([("content", "f1"), ("content", "f2")], "kind string, id string"))


@query("""select distinct md5(text) as fingerprint from documents where md5(text) not in (select md5(text) from documents where source in ('src0', 'src1'))""")
def unreferenced_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("fingerprint"))
    return catalog.unreferenced(d.select("fingerprint").distinct(), d.where("source in ('src0', 'src1')").select("fingerprint"))


@query("""select page_id, case when trim(url) = 'http://ththre.example.com/fr/825?page=2&ref=x' then 'exact' when ends_with(url, 'fr/825?page=2&ref=x') then 'suffix' when split_part(rtrim(url, '/'), '/', -1) = '825?page=2&ref=x' then 'filename' end as reason
  from pages""")
def path_match_reason(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    exact = catalog.path_match(F.col("url"), F.lit("http://ththre.example.com/fr/825?page=2&ref=x"))
    part = catalog.path_match(F.col("url"), F.lit("fr/825?page=2&ref=x"))
    return p.select("page_id", F.when(exact == "exact", exact).otherwise(part).alias("reason"))


@query("""with q as (select item_id as query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 2)) as q from benchmark),
  d as (select doc_id as id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 2)) as d from documents)
  select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from (select query_id, id, len(list_intersect(q, d))::double / len(q) as score from q, d where len(q) > 0) where score >= 0.8 - 1e-12) where r <= 5""")
def skill_search_lexical(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), cells.search_tokens(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cells.search_tokens(F.col("text")).alias("tokens"))
    return search.lexical_matches(q, d, 0.8, 5)


@query("""with c as (select conv_id, turn, case when role = 'assistant' then [text, '', ''] when turn % 3 = 0 then ['', role, text, 'more', ''] else [role, text] end as cells from conversations),
  f as (select conv_id, turn, case when len(cells) > 3 then [cells[1], cells[2], cells[3] || ' more'] when len(cells) < 3 then [cells[1], cells[2], ''] else cells end as cells from c),
  m as (select *, len(list_filter(cells, lambda x: x != '')) as n, row_number() over (partition by conv_id order by turn) as k from f where len(list_filter(cells, lambda x: x != '')) > 0),
  g as (select *, sum((not (n = 1 and cells[1] != '') or k = 1)::int) over (partition by conv_id order by turn rows unbounded preceding) as island from m)
  select conv_id, min(turn) as turn, string_agg(cells[1], ' ' order by turn) as a, arg_min(cells[2], turn) as b, arg_min(cells[3], turn) as c from g group by conv_id, island""")
def forced_records(spark, sf_dir):
    """Assistants' turns are rows with a first cell only, every third other turn has too many cells, and the others too few."""
    c = table(spark, sf_dir, "conversations")
    made = F.when(F.col("role") == "assistant", F.array("text", F.lit(""), F.lit(""))).when(F.col("turn") % 3 == 0, F.array(F.lit(""), F.col("role"), F.col("text"), F.lit("more"), F.lit(""))).otherwise(F.array("role", "text"))
    got = reshape.forced_records(c.withColumn("cells", made), ["conv_id"], "turn", "cells", ["kind", "who", "what"])
    return got.select("conv_id", "turn", *(F.col("cells")[i].alias(x) for i, x in enumerate("abc")))


@query("""with a as (select conv_id, turn, turn - 1.0 as low, coalesce(lead(turn) over (partition by conv_id order by turn) - 1.0, 'infinity'::double) as high from conversations where role = 'user')
  select a.conv_id, a.turn, md5(string_agg(c.text, ' ' order by c.turn)) as text_md5 from a join conversations c on c.conv_id = a.conv_id and c.turn >= low and c.turn < high where c.text != '' group by all""")
def anchored_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("double").alias("turn"), F.when(F.col("role") == "user", "user").alias("anchor"), "text")
    return reshape.anchored_rows(c, ["conv_id"], "turn", ["anchor"], "text", 1.0).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.md5("text").alias("text_md5"))


@query("""select conv_id, turn from conversations where not (role in ('system') or text in ('system') or starts_with(role, 'assis') or starts_with(text, 'assis'))""")
def skip_filters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(~reshape.skipped(F.array("role", "text"), ["system"], ["assis"])).select("conv_id", "turn")


_ITEMS = """(select l_orderkey as page, case l_linenumber % 4 when 0 then 're' when 1 then 'c' else 'l' end as kind, l_quantity * 10 as x0, l_quantity * 10 + (l_linenumber % 2) * 50 as x1, (l_suppkey % 700)::double as y0, (l_suppkey % 700 + l_partkey % 3)::double as y1 from lineitem)"""


@query(f"""select page, sum(case when kind = 're' then 2 when h then 1 else 0 end)::bigint as horizontal, sum(case when kind = 're' then 2 when v then 1 else 0 end)::bigint as vertical, count(*) filter (where kind != 're' and not h and not v) as other,
    coalesce(nullif(array_to_string(list_transform(list_sort(list_distinct(flatten(list(case when h then [least(2, trunc((y0 + y1) / 2 / 800 * 3))] when kind = 're' then [least(2, trunc(y0 / 800 * 3)), least(2, trunc(y1 / 800 * 3))] else [] end)))), lambda i: 'tmb'[i::int + 1]), ''), ''), 'none') as y_bands,
    coalesce(nullif(array_to_string(list_transform(list_sort(list_distinct(flatten(list(case when v then [least(2, trunc((x0 + x1) / 2 / 600 * 3))] when kind = 're' then [least(2, trunc(x0 / 600 * 3)), least(2, trunc(x1 / 600 * 3))] else [] end)))), lambda i: 'lcr'[i::int + 1]), ''), ''), 'none') as x_bands
  from (select *, kind = 'l' and abs(y0 - y1) <= 1.5 and abs(x0 - x1) > 1.5 as h, kind = 'l' and abs(x0 - x1) <= 1.5 and abs(y0 - y1) > 1.5 as v from {_ITEMS}) group by page""")
def rule_profile(spark, sf_dir):
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 700
    kind = F.when(n % 4 == 0, "re").when(n % 4 == 1, "c").otherwise("l")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), kind.alias("kind"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + n % 2 * 50).alias("x1"), s.cast("double").alias("y0"), (s + F.col("l_partkey") % 3).cast("double").alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return inspection.rule_profile(items, ["page"])


@query("""with m as (select l_suppkey as page, list_sort(list(l_quantity)) as s from lineitem group by 1)
  select page, len(s) as spans, s[-1] as max_size, s[len(s) // 2 + 1] as median_size, len(list_filter(s, lambda x: x >= s[len(s) // 2 + 1] * 1.6 and x >= 16)) as large_spans from m""")
def font_profile(spark, sf_dir):
    return inspection.font_profile(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), "l_quantity"), ["page"], "l_quantity")


@query("""select event_id, array_to_string(list_filter([case when event_id % 5 = 0 then 'no_extractable_text' end, case when user_id % 7 >= 3 and event_id % 6 >= 3 then 'visible_rule_grid' end, case when value > 80 then 'large_text_regions' end], lambda x: x is not null), ',') as hints from events""")
def page_hints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(inspection.page_hints(F.col("event_id") % 5, F.col("user_id") % 7, F.col("event_id") % 6, F.when(F.col("value") > 80, 1).otherwise(0)), ",").alias("hints"))


# Conversations as detected tables: a turn is a row of one to four cells, some blank, that its words are dealt out to; the header is one of three.
_DETECTED = """(select conv_id, turn, case when conv_id % 5 = 0 then [role, text] else list_transform(range(1, len(string_split(text, ' ')) % 4 + 2), lambda i: case when (i + turn) % 3 = 0 then '' else array_to_string(list_filter(list_transform(range(1, len(string_split(text, ' ')) + 1), lambda k: case when k % (len(string_split(text, ' ')) % 4 + 1) = i - 1 then string_split(text, ' ')[k] end), lambda x: x is not null), ' ') end) end as c,
  case conv_id % 3 when 0 then []::varchar[] when 1 then ['Name', 'Amount'] else ['ab', 'Id', '', 'xy'] end as h from conversations)"""


@query(f"""with r as (select *, row_number() over (partition by conv_id order by turn) = 1 as first from {_DETECTED}),
  d as (select *, not (first and len(h) > 0 and c[:len(h)] = h) as data from r),
  g as (select conv_id, count(*) as n, max(len(c)) as w, sum(len(list_filter(c, lambda x: x != ''))) as filled, max(len(list_filter(c, lambda x: x != ''))) filter (where first) as ff, any_value(h) filter (where first) as h,
    any_value(case when len(h) > 0 then h else c end) filter (where first) as heads, coalesce(bool_and(len(c) >= 2) filter (where data), true) as pairs, count(*) filter (where data and len(c) >= 2 and c[1] != '' and c[2] != '') as fields from d group by conv_id),
  s as (select *, len(list_filter(heads, lambda x: x != '' and length(x) <= 3 and lower(x) not in ('id', 'ip', 'no', 'qty', 'key'))) as short from g),
  p as (select *, n >= 2 and w >= 2 and ff >= 2 and short < greatest(2, len(heads) // 2) as plausible from s)
  select conv_id, case when plausible then 'plausible' else 'suspicious' end as quality, array_to_string(list_filter([case when n < 2 then 'too_few_rows' end, case when w < 2 then 'too_few_columns' end, case when short > 0 then 'short_header_fragments' end, case when filled < n * greatest(w, 1) * 0.25 then 'sparse_cells' end], lambda x: x is not null), ',') as warnings,
    case when filled = 0 or w <= 1 then 'false_positive' when len(h) > 0 and not list_contains(h, '') and plausible then 'grid_table' when w = 2 and pairs and fields > 0 then 'field_value_table' else 'uncertain' end as kind from p""")
def judged_tables(spark, sf_dir):
    parts = F.split("text", " ")
    width = F.size(parts) % 4 + 1
    words = F.transform(F.sequence(F.lit(1), width), lambda i: F.when((i + F.col("turn")) % 3 == 0, "").otherwise(F.array_join(F.filter(parts, lambda w, k: (k + 1) % width == i - 1), " ")))
    c = table(spark, sf_dir, "conversations").withColumn("c", F.when(F.col("conv_id") % 5 == 0, F.array("role", "text")).otherwise(words))
    heads = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 1, F.array(F.lit("Name"), F.lit("Amount"))).otherwise(F.array(*(F.lit(x) for x in ("ab", "Id", "", "xy"))))
    return inspection.judged_tables(c.withColumn("h", heads), ["conv_id"], "turn", "c", "h").withColumn("warnings", F.array_join("warnings", ","))


@query("""with g as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) + (o_orderkey % 11 = 0)::int as page, o_orderstatus as columns, (o_orderkey % 40)::double as y0, (50 + o_orderkey % 50)::double as y1, 100.0::double as height from orders)
  select o_custkey, o_orderkey, sum(case when columns = lag_c and page = lag_p + 1 and lag_y >= 75 and y0 <= 25 then 0 else 1 end) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint as group_no from (
    select *, lag(columns) over w as lag_c, lag(page) over w as lag_p, lag(y1) over w as lag_y from g window w as (partition by o_custkey order by o_orderkey))""")
def grids_across_pages(spark, sf_dir):
    from pyspark.sql import Window as W

    k = F.col("o_orderkey")
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) + (k % 11 == 0).cast("int")
    grids = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", page.alias("page"), F.col("o_orderstatus").alias("columns"), (k % 40).cast("double").alias("y0"), (50 + k % 50).cast("double").alias("y1"), F.lit(100.0).alias("height"))
    return inspection.across_pages(grids, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "group_no")


@query("""with w as (select doc_id, string_split(text, ' ') as w from documents), c as (select doc_id, list_transform(range(1, 6), lambda i: case when (doc_id + i) % 3 = 0 or doc_id % 50 = 0 then '' else 'h' || i end) as h, w as c from w),
  n as (select *, list_filter(range(1, 6), lambda i: h[i] != '') as named from c)
  select doc_id, case when len(named) = 0 then array_to_string(c, '|') else array_to_string(list_transform(range(1, len(named) + 1), lambda t: array_to_string(list_filter(list_transform(range(1, 6), lambda i: case when greatest(len(list_filter(named, lambda x: x <= i)), 1) = t then c[i] end), lambda x: x != ''), ' ')), '|') end as folded from n""")
def fold_unnamed(spark, sf_dir):
    words, d = F.split("text", " "), F.col("doc_id")
    heads = F.array(*(F.when(((d + i) % 3 == 0) | (d % 50 == 0), "").otherwise(f"h{i}") for i in range(1, 6)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(inspection.fold_unnamed(words, heads), "|").alias("folded"))


@query(r"""with t as (select item_id, replace(text, ' ', ' _ ') as k, case when item_id % 2 = 0 then '/' else '' end || replace(text, ',', ' /') as v from benchmark)
  select item_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(trim(k), '\s+'), lambda x: x not in ('', '_')), lambda x: trim(x, '_')), lambda x: x != ''), '_') as name,
    case when contains(v, '/') or contains(v, '$') then array_to_string(list_transform(string_split(v, '/'), lambda p: array_to_string(list_filter(regexp_split_to_array(trim(p), '\s+'), lambda x: x not in ('', '_')), '_')), '/') else v end as path from t""")
def repaired_codes(spark, sf_dir):
    start = F.col("text")
    path = F.concat(F.when(F.col("item_id") % 2 == 0, "/").otherwise(""), F.replace(start, F.lit(","), F.lit(" /")))
    return table(spark, sf_dir, "benchmark").select("item_id", inspection.repaired_name(F.replace(start, F.lit(" "), F.lit(" _ "))).alias("name"), inspection.repaired_path(path).alias("path"))


@query("""with t as (select o_custkey as k, o_orderkey as position, o_orderstatus = 'F' as detected, o_orderkey % 13 = 0 as generic, case when o_orderkey % 9 = 0 then 'sparse_cells' when o_orderkey % 17 = 0 then 'too_few_rows' end as warning from orders),
  g as (select k, bool_or(detected and generic) as generic, list_distinct(list(warning) filter (where detected and warning is not null)) as told from t group by k)
  select c_custkey, case when k is null then 'empty' when generic or len(told) > 0 then 'low_confidence' else 'ok' end as status, case when k is null then 'no_tables_extracted' when generic or len(told) > 0 then array_to_string(list_sort(list_concat(['low_confidence_detected_tables'], case when generic then ['generic_detected_columns'] else [] end, coalesce(told, []))), ',') else '' end as warnings
  from customer left join g on k = c_custkey""")
def extraction_status(spark, sf_dir):
    k = F.col("o_orderkey")
    made = F.when(k % 9 == 0, F.array(F.lit("sparse_cells"))).when(k % 17 == 0, F.array(F.lit("too_few_rows"))).otherwise(F.array().cast("array<string>"))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), k.alias("position"), (F.col("o_orderstatus") == "F").alias("detected"), F.array(F.when(k % 13 == 0, "column_1").otherwise("total"), F.lit("column_2")).alias("columns"), made.alias("warnings"))
    return inspection.extraction_status(table(spark, sf_dir, "customer"), t, "c_custkey").withColumn("warnings", F.array_join(F.array_sort("warnings"), ","))


@query("""with r as (select user_id, event_id, event_type || '_' || event_id % 4 as label, event_id % 9 = 0 as e, event_id % 5 = 1 and user_id % 2 = 0 as p from events),
  s as (select *, coalesce(sum(e::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as seg from r),
  m as (select *, sum((not e and p)::int) over u as no, sum((not e and p)::int) over (partition by user_id, seg) as total, bool_or(e) over (partition by user_id, seg) as closed, sum((not e)::int) over u as nth from s window u as (partition by user_id, seg order by event_id rows unbounded preceding))
  select user_id, label, min(event_id) as first from m where not e and case when total > 0 then no > 0 and not p and (closed or no < total) else closed and nth > 1 end group by user_id, label""")
def key_labels(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("label", F.concat_ws("_", "event_type", (k % 4).cast("string")))
    return inspection.key_labels(e, ["user_id"], "event_id", "label", k % 9 == 0, (k % 5 == 1) & (F.col("user_id") % 2 == 0))


@query("""with f as (select l_suppkey as sheet, l_orderkey % 3000 + 1 as "row", l_linenumber as "column" from lineitem),
  t as (select s_suppkey as sheet, unnest([struct_pack(name := 'a', r0 := 1 + s_suppkey % 7, r1 := 1500, c0 := 1, c1 := 3), struct_pack(name := 'b', r0 := 1400, r1 := 2600, c0 := 2, c1 := 6)], recursive := true) from supplier)
  select f.*, name, case when "row" = r0 then 'header' else 'data' end as role, ("row" - r0)::bigint as table_row, ("column" - c0 + 1)::int as table_column, coalesce((['Name', 'Qty', 'Price'])["column" - c0 + 1], '') as column_name, coalesce((['name', 'qty'])["column" - c0 + 1], '') as db_column from f join t on f.sheet = t.sheet and "row" between r0 and r1 and "column" between c0 and c1""")
def formula_overlay(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") % 3000 + 1).alias("row"), F.col("l_linenumber").alias("column"))
    names, stored_names = F.array(*(F.lit(x) for x in ("Name", "Qty", "Price"))), F.array(F.lit("name"), F.lit("qty"))
    parts = F.array(F.struct(F.lit("a").alias("name"), (1 + F.col("s_suppkey") % 7).alias("row_start"), F.lit(1500).alias("row_end"), F.lit(1).alias("column_start"), F.lit(3).alias("column_end")), F.struct(F.lit("b").alias("name"), F.lit(1400).cast("bigint").alias("row_start"), F.lit(2600).alias("row_end"), F.lit(2).alias("column_start"), F.lit(6).alias("column_end")))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sheet"), F.explode(parts).alias("t")).select("sheet", "t.*", F.col("t.row_start").alias("header_row"), names.alias("columns"), stored_names.alias("db_columns"))
    return inspection.formula_overlay(f, t)


@query("""select conv_id, header_row, header_row + 1 as data_row, candidates from (select conv_id, first(turn order by (turn % 3 = 0)::int, length(text) % 7 desc, turn) as header_row, count(*) as candidates from conversations group by conv_id)""")
def structure_hints(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("row"), (F.length("text") % 7).alias("non_empty"), (F.col("turn") % 3 == 0).alias("stronger"))
    return inspection.structure_hints(c, ["conv_id"])



@query("""select conv_id, turn, s as start, s + 2 as "end", substr(text, s + 1, 2) as match from (select conv_id, turn, text, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x)))::bigint + (k - 1) * 2)) as s from (select *, string_split(lower(text), 'an') as p from conversations))""")
def submatches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.explode(search.submatches(F.col("text"), "an")).alias("m")).select("conv_id", "turn", "m.*")


@query("""select item_id from benchmark where contains(item_id::varchar, '7') or contains(text, '7') or string_split(text, ' ')[1] = '7'""")
def artifact_filter(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").cast("string").alias("id"), "text", F.slice(F.split("text", " "), 1, 1).alias("refs"))
    return search.about(b, "7").select("item_id")


@query("""with a as (select distinct 't' || n_nationkey % 7 as name from nation), k as (select name, name as base from a where name > 't3' union all select name || '_typed', name from a where name <= 't3'),
  src as (select 'in/' || n_name || '.csv' as input_file, 't' || n_nationkey % 7 as base from nation),
  sql as (select 's' || s_suppkey as sql_path, 't' || s_suppkey % 9 || case when s_suppkey % 2 = 0 then '_typed' else '' end as t from supplier),
  res as (select 's' || c_custkey % 40 as sql_path, 'r' || c_custkey as result from customer)
  select input_file, k.name as table_name, coalesce(string_agg(distinct sql.sql_path, ',' order by sql.sql_path), '') as sql_files, coalesce(string_agg(distinct result, ',' order by result), '') as results
  from src join k using (base) left join sql on sql.t = k.name or sql.t = k.base left join res on res.sql_path = sql.sql_path group by all""")
def artifact_map(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.format_string("in/%s.csv", "n_name").alias("source_path"), F.format_string("t%d", F.col("n_nationkey") % 7).alias("table_name"))
    raw = n.select(F.col("table_name").alias("name"), F.lit("raw_content_table").alias("kind")).distinct()
    typed = raw.where("name <= 't3'").select(F.concat("name", F.lit("_typed")).alias("name"), F.lit("typed_content_view").alias("kind"))
    refs = table(spark, sf_dir, "supplier").select(F.format_string("s%d", "s_suppkey").alias("sql_path"), F.concat(F.format_string("t%d", F.col("s_suppkey") % 9), F.when(F.col("s_suppkey") % 2 == 0, "_typed").otherwise("")).alias("table_name"))
    made = table(spark, sf_dir, "customer").select(F.format_string("s%d", F.col("c_custkey") % 40).alias("sql_path"), F.format_string("r%d", "c_custkey").alias("result_path"))
    found = catalog.artifact_map(raw.unionByName(typed), n, refs, made)
    return found.withColumn("sql_files", F.array_join("sql_files", ",")).withColumn("results", F.array_join("results", ","))



def _sql(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text


_sql("sql_join_agg", "select c_mktsegment, count(*) as orders, sum(cast(o_totalprice as decimal(18,2))) as revenue from customer join orders on c_custkey = o_custkey group by c_mktsegment", "customer orders")
_sql("sql_window_rank", "select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as r from orders) where r <= 3", "orders")
_sql("sql_set_ops", "(select n_regionkey as k from nation union select c_nationkey from customer) except select s_nationkey from supplier where s_acctbal < 0", "nation customer supplier")
_sql("sql_semi_anti", "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49) and s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)", "supplier lineitem nation")
_sql("sql_correlated", "select p_partkey from part p where p_retailprice > (select avg(q.p_retailprice) from part q where q.p_brand = p.p_brand)", "part")
_sql("sql_distinct_agg", "select o_orderstatus, count(distinct o_custkey) as customers, count(distinct o_orderpriority) as priorities from orders group by o_orderstatus", "orders")
_sql("sql_filter_agg", "select l_returnflag, count(*) filter (where l_quantity > 25) as large, count(*) as n from lineitem group by l_returnflag", "lineitem")
_sql("sql_json", "select event_id, cast(get_json_object(props, '$.k') as bigint) as k from events", "events", "select event_id, (props->>'$.k')::bigint as k from events")
_sql("sql_dates", "select cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, count(*) as n from orders group by 1, 2", "orders")
_sql("sql_strings", "select n_nationkey, upper(substr(n_name, 1, 3)) || '-' || cast(length(n_name) as string) as code, replace(lower(n_name), 'a', '_') as masked from nation", "nation", "select n_nationkey, upper(substr(n_name, 1, 3)) || '-' || length(n_name)::varchar as code, replace(lower(n_name), 'a', '_') as masked from nation")
_sql("sql_recursive", "with recursive up(root, k, depth) as (select n_nationkey, cast(n_nationkey as bigint), 0 from nation union all select root, k div 2, depth + 1 from up where k > 0) select root, max(depth) as depth, cast(sum(k) as bigint) as path_sum from up group by root", "nation", "with recursive up(root, k, depth) as (select n_nationkey, n_nationkey, 0 from nation union all select root, k // 2, depth + 1 from up where k > 0) select root, max(depth) as depth, sum(k)::bigint as path_sum from up group by root")


_sql("sql_using", "select n_name, r_name from nation join (select r_regionkey as n_regionkey, r_name from region) r using (n_regionkey)", "nation region")
_sql("sql_natural", "select n_name, r_name from nation natural join (select r_regionkey as n_regionkey, r_name from region) r", "nation region")
_sql("sql_outer", "select coalesce(c_custkey, -1) as c, coalesce(s_suppkey, -1) as s from (select * from customer where c_custkey < 40) full outer join (select * from supplier where s_suppkey between 20 and 60) on c_custkey = s_suppkey", "customer supplier")
_sql("sql_total", "select n_regionkey, coalesce(sum(cast(case when n_nationkey > 20 then n_nationkey end as double)), 0.0) as total from nation group by n_regionkey", "nation")
_sql("sql_group_concat", "select n_regionkey, listagg(n_name, ', ') within group (order by n_name) as names from nation group by n_regionkey", "nation", "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey")
_sql("sql_values", "select v.k, v.label, n_name from (values (1, 'one'), (2, 'two')) as v(k, label) join nation on n_nationkey = v.k", "nation")
_sql("sql_order_nulls", "select user_id, v from (select user_id, nullif(max(case when event_type = 'error' then value end), 0) as v from events group by user_id) order by v desc nulls last, user_id limit 20 offset 5", "events")
_sql("sql_math", "select event_id, abs(value - 50) as a, floor(value) as f, ceil(value) as c, sqrt(value) as s, cast(event_id % 7 as bigint) as m, sign(value - 50) as g, cast(power(event_id % 10, 2) as bigint) as p, cast(event_id div 3 as bigint) as d from events", "events", "select event_id, abs(value - 50) as a, floor(value) as f, ceil(value) as c, sqrt(value) as s, event_id % 7 as m, sign(value - 50)::double as g, power(event_id % 10, 2)::bigint as p, event_id // 3 as d from events")
_sql("sql_window_functions", "select o_orderkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, percent_rank() over w as p, cume_dist() over w as c, cast(ntile(4) over w2 as bigint) as q, first_value(o_orderkey) over w2 as f, nth_value(o_orderkey, 2) over w2 as n, lead(o_orderkey, 1, -1) over w2 as l from orders window w as (partition by o_custkey order by o_orderpriority), w2 as (partition by o_custkey order by o_orderkey)", "orders")
_sql("sql_frames", "select user_id, event_id, count(*) over (partition by user_id order by event_id range between 500 preceding and 100 following) as near, sum(event_id) over (partition by user_id order by event_id rows between 2 preceding and current row) as s from events", "events")
_sql("sql_frame_groups", "select event_id, sum(n) over (partition by event_type order by g range between 1 preceding and current row) as s from (select event_id, event_type, dense_rank() over (partition by event_type order by user_id) as g, 1 as n from events)", "events", "select event_id, count(*) over (partition by event_type order by user_id groups between 1 preceding and current row) as s from events")
_sql("sql_set_ops_all", "select n_nationkey as k from nation intersect select n_regionkey from nation union all select r_regionkey from region", "nation region")
_sql("sql_strings_more", "select n_nationkey, ltrim('N', n_name) as l, lpad(n_name, 12, '*') as p, instr(n_name, 'ION') as i, reverse(n_name) as r, repeat('ab', n_regionkey) as t, concat_ws('-', n_name, cast(n_regionkey as string)) as c, hex(n_name) as h, n_name like 'NATION\\\\_1%' as k from nation", "nation", "select n_nationkey, ltrim(n_name, 'N') as l, lpad(n_name, 12, '*') as p, instr(n_name, 'ION')::int as i, reverse(n_name) as r, repeat('ab', n_regionkey) as t, concat_ws('-', n_name, n_regionkey::varchar) as c, hex(n_name) as h, n_name like 'NATION\\_1%' escape '\\' as k from nation")
_sql("sql_dates_more", "select event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') as t, date_format(date_trunc('month', ts), 'yyyy-MM-dd') as m, unix_timestamp(ts) as u, date_format(ts + interval 36 hours, 'yyyy-MM-dd') as later, datediff(date '2025-01-01', cast(ts as date)) as days from events", "events", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as t, strftime(date_trunc('month', ts), '%Y-%m-%d') as m, floor(epoch(ts))::bigint as u, strftime(ts + interval 36 hour, '%Y-%m-%d') as later, datediff('day', ts::date, date '2025-01-01')::int as days from events")
_sql("sql_json_more", "select event_id, to_json(named_struct('k', get_json_object(props, '$.k'), 'e', event_type)) as j, json_array_length(concat('[', get_json_object(props, '$.k'), ',1]')) as n from events", "events", "select event_id, '{\"k\":\"' || (props->>'$.k') || '\",\"e\":\"' || event_type || '\"}' as j, json_array_length('[' || (props->>'$.k') || ',1]')::int as n from events")
_sql("sql_case", "select p_partkey, case when p_size < 10 then 's' when p_size < 30 then 'm' else 'l' end as size, nullif(p_brand, 'Brand#1') as brand, if(p_retailprice > 1000, 1, 0) as dear, cast(p_retailprice as int) as price from part where p_retailprice = floor(p_retailprice)", "part", "select p_partkey, case when p_size < 10 then 's' when p_size < 30 then 'm' else 'l' end as size, nullif(p_brand, 'Brand#1') as brand, if(p_retailprice > 1000, 1, 0) as dear, p_retailprice::int as price from part where p_retailprice = floor(p_retailprice)")


@query("""select c_mktsegment, count(*) as orders, sum(o_totalprice::decimal(18,2)::double) as revenue from orders join customer on o_custkey = c_custkey group by c_mktsegment""")
def typed_revenue(spark, sf_dir):
    """The flagship: text tables, inferred types, typed views, then guarded SQL over them."""
    from .plans.guard import check_read_only

    typing.typed_view(orders_text(spark, sf_dir)).createOrReplaceTempView("orders_typed")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_mktsegment")
    typing.typed_view(c).createOrReplaceTempView("customer_typed")
    return spark.sql(check_read_only(spark, "select c_mktsegment, count(*) as orders, round(sum(o_totalprice), 2) as revenue from orders_typed join customer_typed on o_custkey = c_custkey group by c_mktsegment"))


ORACLES["typed_revenue"] = ORACLES["typed_revenue"].replace("sum(o_totalprice::decimal(18,2)::double)", "round(sum(o_totalprice::decimal(18,2)::double), 2)")


from . import more_queries  # noqa: E402, F401  registers its own

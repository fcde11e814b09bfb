"""Registered queries of lineage, path matching, wrapped rows, indented labels and word geometry, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import cells
from .operators import catalog, describe, extract, frames, inspection, json_walk, labels, layout, lineage, lines, loading, repair, segment
from .plans.store import Store
from .plans.views import Views
from .registry import query, table, views
from .session import shared_folder

# A catalog made of parts: three of five have sources of their own, some are typed views; each refers to two others, so that paths meet and circle.
_SOURCED = """own as (select distinct 'v' || p_partkey as name, 'in/' || p_partkey % 97 || '.csv' as source_path, p_brand as source_sheet_name, '' as source_table_name from part where p_partkey % 5 < 3
  union select 'v' || p_partkey || '_typed', 'in/' || p_partkey % 97 || '.csv', p_brand, '' from part where p_partkey % 5 < 3 and p_partkey % 7 = 0),
  names as (select 'v' || p_partkey as name from part union select 'v' || p_partkey || '_typed' from part where p_partkey % 5 < 3 and p_partkey % 7 = 0),
  refs as (select 'v' || p_partkey as child, unnest(['v' || p_partkey * 13 % 1999, 'v' || (p_partkey + 1), 'gone' || p_partkey]) as parent from part)"""


def catalog_tables(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string"))
    raw, base = p.select(F.concat(F.lit("v"), "k").alias("name"), "p_partkey", "p_brand"), F.col("p_partkey")
    held = raw.where(base % 5 < 3)
    kind = F.when(base % 5 < 3, "raw_content_table").otherwise("view_or_table")
    views = held.where(base % 7 == 0).select(F.concat("name", F.lit("_typed")).alias("name"), F.lit("typed_content_view").alias("kind"))
    artifacts = raw.select("name", kind.alias("kind")).unionByName(views)
    contents = held.select(F.concat(F.lit("f"), "name").alias("fingerprint"), F.col("name").alias("table_name"))
    sources = held.select(F.concat(F.lit("f"), "name").alias("fingerprint"), F.format_string(" in/%d.csv", base % 97).alias("source_path"), F.col("p_brand").alias("source_sheet_name"), F.lit(None).cast("string").alias("source_table_name"))
    sources = sources.unionByName(sources).unionByName(sources.withColumn("source_path", F.lit(" ")))
    to = F.explode(F.array(F.concat(F.lit("v"), (base * 13 % 1999).cast("string")), F.concat(F.lit("v"), (base + 1).cast("string")), F.concat(F.lit("gone"), base.cast("string"))))
    return artifacts, contents, sources, raw.select(F.col("name").alias("child"), to.alias("parent"))


@query(f"""with recursive {_SOURCED},
  walk as (select n.name, n.name as at from names n where n.name not in (select name from own)
    union select w.name, r.parent from walk w join refs r on r.child = w.at join names k on k.name = r.parent where w.at not in (select name from own)),
  got as (select name, source_path, source_sheet_name, source_table_name, false as inherited from own union select w.name, o.source_path, o.source_sheet_name, o.source_table_name, true from walk w join own o on o.name = w.at)
  select * from got""")
def source_mappings(spark, sf_dir):
    return lineage.source_mappings(*catalog_tables(spark, sf_dir))


# Paths of all pages as stored ones; asked are the ends of other pages' paths, from different characters on.
_PATHS = r"""stored as (select distinct replace(url, 'http://', case when page_id % 3 = 0 then '' else '/srv/' end) as source_path from pages),
  asked as (select distinct case page_id % 4 when 0 then replace(url, 'http://', '') when 1 then regexp_extract(url, '([^/]+/[^/]*)$', 1) when 2 then substr(regexp_extract(url, '([^/]*)$', 1), 2) else 'other/' || regexp_extract(url, '([^/]*)$', 1) end as asked_path from pages where page_id % 100 = 0)"""


@query(rf"""with {_PATHS}
  select source_path, asked_path, case when source_path = asked_path then 'exact' when ends_with(source_path, asked_path) or ends_with(asked_path, source_path) then 'suffix' else 'filename' end as reason from stored, asked
  where trim(asked_path) != '' and trim(source_path) != '' and (ends_with(source_path, asked_path) or ends_with(asked_path, source_path)
    or regexp_extract(regexp_replace(source_path, '/+$', ''), '([^/]*)$', 1) = regexp_extract(regexp_replace(asked_path, '/+$', ''), '([^/]*)$', 1))""")
def path_join(spark, sf_dir):
    """The pages asked for are those of which the id is divisible by 100."""
    p, url = table(spark, sf_dir, "pages"), F.col("url")
    n, tail = F.col("page_id"), F.regexp_extract("url", "([^/]*)$", 1)
    stored = p.select(F.replace(url, F.lit("http://"), F.when(n % 3 == 0, "").otherwise("/srv/")).alias("source_path"))
    asked = F.when(n % 4 == 0, F.replace(url, F.lit("http://"), F.lit(""))).when(n % 4 == 1, F.regexp_extract("url", "([^/]+/[^/]*)$", 1)).when(n % 4 == 2, F.substr(tail, F.lit(2))).otherwise(F.concat(F.lit("other/"), tail))
    return lineage.matching_paths(stored, p.where(n % 100 == 0).select(asked.alias("asked_path")))


_BARE = r"regexp_replace(lower({}), '[^\pL\pN]', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '([\pL\pN_])-\s+([\pL\pN_])', '\1-\2', 'g'), '([\pL\pN_])-\s+([\pL\pN_])', '\1-\2', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\s+([,.;:])', '\1', 'g')"


@query(rf"""with c as (select conv_id, turn, [case when turn % 3 = 0 then role else '' end, case when turn % 2 = 0 then text else role || ' ( x ) -' end, {_CLEAN.format("text")}, case when turn % 4 = 1 then '' else left(role, 1 + turn % 5) end] as c from conversations),
  d as (select conv_id, turn, list_transform(c, lambda x: {_CLEAN.format("x")}) as c from c),
  e as (select *, sum((c[1] != '')::int) over (partition by conv_id order by turn rows unbounded preceding) as r from d where len(list_filter(c, lambda x: x != '')) > 0),
  g as (select conv_id, min(turn) as turn, list(c order by turn) as p, count(*) - 1 as merged from e group by conv_id, r),
  f as (select conv_id, turn, merged, list_transform(range(1, 5), lambda i: list_reduce(list_concat([struct_pack(t := '', b := '')], list_transform(p, lambda x: struct_pack(t := x[i], b := {_BARE.format("x[i]")}))), lambda s, x:
    case when x.t = '' or (s.t != '' and x.b != '' and (contains(s.b, x.b) or contains(x.b, s.b))) then s when s.t = '' then x
      else struct_pack(t := case when ends_with(s.t, '-') then s.t || ltrim(x.t) else s.t || ' ' || x.t end, b := s.b || x.b) end).t) as cells from g)
  select conv_id, turn, merged::int as merged, md5(array_to_string(cells, '|')) as cells from f""")
def wrapped_rows(spark, sf_dir):
    """A turn is a row: two of three have no first cell, and their texts go into the row before unless they stand there."""
    t, role, text = F.col("turn"), F.col("role"), F.col("text")
    made = F.array(F.when(t % 3 == 0, role).otherwise(""), F.when(t % 2 == 0, text).otherwise(F.concat(role, F.lit(" ( x ) -"))), text, F.when(t % 4 == 1, "").otherwise(F.left(role, 1 + t % 5)))
    got = inspection.merged_rows(table(spark, sf_dir, "conversations").withColumn("c", made), ["conv_id"], "turn", "c")
    return got.select("conv_id", "turn", "merged", F.md5(F.array_join("cells", "|")).alias("cells"))


@query("""with recursive r as materialized (select user_id, event_id, event_type || '_' || event_id % 4 as label, round(value, 1) as x, row_number() over (partition by user_id order by event_id) as n from events where event_type != 'error'),
  s as (select user_id, n, event_id, label, x as p, 'parent' as role from r where n = 1
    union all select r.user_id, r.n, r.event_id, r.label, case when x < p - 3 then null when p is null or x <= p + 3 then x else p end, case when x < p - 3 then 'footer' when p is null or x <= p + 3 then 'parent' when x >= p + 4 then 'child' else '' end from s join r on r.user_id = s.user_id and r.n = s.n + 1)
  select user_id, label, min(event_id) as first from s where role = 'child' group by all""")
def indent_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("_", "event_type", (F.col("event_id") % 4).cast("string")).alias("label"), F.when(F.col("event_type") != "error", F.round("value", 1)).alias("x"))
    return labels.indent_labels(e, ["user_id"], "event_id", "label", "x")


# Line items as words on pages: a supplier is a page, places follow from the other columns.
_WORDS = """w as (select l_suppkey as page, l_orderkey * 10 + l_linenumber as word, (l_partkey % 61 * 9)::double as x0, l_partkey % 61 * 9 + 5.25 as x1, l_orderkey % 977 * 0.75 as y0, l_orderkey % 977 * 0.75 + 2 as y1, l_returnflag || l_linenumber as text from lineitem)"""


def words(spark, sf_dir):
    y, x = F.col("l_orderkey") % 977 * 0.75, F.col("l_partkey") % 61 * 9
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("word"), x.cast("double").alias("x0"), (x + 5.25).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + 2).cast("double").alias("y1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))


@query(f"""with recursive {_WORDS}, o as materialized (select *, row_number() over (partition by page order by round_even(y0 / 3.5, 0), x0, word) as n from w),
  s as (select page, n, y0 as y, 1 as r from o where n = 1 union all select o.page, o.n, case when abs(o.y0 - y) > 3.5 then o.y0 else y end, case when abs(o.y0 - y) > 3.5 then r + 1 else r end from s join o on o.page = s.page and o.n = s.n + 1),
  k as (select o.*, s.r, s.y, row_number() over (partition by o.page, s.r order by o.n) as i from s join o using (page, n))
  select page, r::int as row_id, round_even(any_value(y), 1) as y, round_even(min(x0), 1) as bbox_x0, round_even(min(y0), 1) as bbox_y0, round_even(max(x1), 1) as bbox_x1, round_even(max(y1), 1) as bbox_y1,
    string_agg(text, ' ' order by round_even(x0, 1), i) filter (where i <= 36) as text, count(*) > 36 as truncated_words, (select max(z.r) from k z where z.page = k.page)::bigint as row_count, (select max(z.r) from k z where z.page = k.page) > 90 as truncated
  from k where r <= 90 group by page, r""")
def visual_rows(spark, sf_dir):
    return lines.visual_rows(words(spark, sf_dir), ["page"])


@query(f"""with {_WORDS}, l as (select page, word // 70 as block, word % 7 as line, string_agg(text, ' ' order by x0, word) as text, min(x0) as x0, min(y0) as y0, min(word) as f from w group by all),
  m as (select *, min(row(y0, x0, f)) filter (where starts_with(text, 'R7')) over (partition by page) as e from l where text != page::varchar)
  select page, text, x0, y0, row_number() over (partition by page order by y0, x0, f)::int as line_no from m where (e is null or row(y0, x0, f) < e) and text not in ('A1', 'N2') and not starts_with(text, 'N3')""")
def line_records(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("block", F.expr("word div 70")).withColumn("line", F.col("word") % 7)
    return lines.line_records(w, [], "page", skip_lines=("A1", "N2"), skip_prefixes=("N3",), stop_prefixes=("R7",))


@query(r"""with recursive n as (select distinct n_name as name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') as bare from nation),
  p as (select name, 'nation12' as a, bare as b, 0 as got from n where bare not in ('', 'nation12')
    union all select name, x.a, x.b, s from (select name, s, unnest([struct_pack(a := left(a, i - 1), b := left(b, j - 1)), struct_pack(a := substr(a, i + s), b := substr(b, j + s))]) as x
      from (select *, instr(b, substr(a, i, s)) as j from (select name, a, b, -f.n as s, f.i as i from (select *, list_sort(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), lambda s: struct_pack(n := case when contains(b, substr(a, i, s)) then -s else 0 end, i := i)))))[1] as f from p where len(a) > 0 and len(b) > 0)) where s > 0))),
  m as (select name, sum(got) / 2 as same from p group by name)
  select name, score from (select n.name, case when bare = 'nation12' then 100.0 else 20.0 * (2.0 * same / (8 + length(bare))) + case when contains('nation12', bare) or contains(bare, 'nation12') then 40.0 else 0.0 end
    + 20.0 * len(list_intersect(['nation', '12'], regexp_extract_all(lower(n.name), '[a-z0-9]+'))) end as score from n left join m using (name)) order by score desc, name limit 5""")
def repair_candidates(spark, sf_dir):
    return repair.best(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "name", "Nation_12", 5)


def fresh_store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


# Each nation's customers are a table of a file named by the region; even nations' come twice.
@query("""with t as (select n_nationkey as k, 'd' || n_nationkey || '/Data ' || n_regionkey || '.CSV' as source_path, n_name as source_table_name, 'data_' || n_regionkey as base from nation
    union all select n_nationkey, 'a' || n_nationkey || '/Data ' || n_regionkey || '.CSV', n_name || ' copy', 'data_' || n_regionkey from nation where n_nationkey % 2 = 0),
  f as (select *, row_number() over (partition by k order by source_path, source_table_name) = 1 as first from t),
  r as (select *, row_number() over (partition by base, first order by source_path, source_table_name) as r from f),
  n as (select k, base, case base when 'data_0' then r + 1 when 'data_1' then r + (r >= 3)::int else r end as i from r where first)
  select source_path, source_table_name, n.base || case when i = 1 then '' else '_' || i end as table_name, (select count(*) from customer where c_nationkey = k) as row_count, case when first then 'loaded' else 'reused' end as load_status from r join n using (k)""")
def loaded_tables(spark, sf_dir):
    """Two of the names and one typed view's name are taken before."""
    n = table(spark, sf_dir, "nation")
    path = F.format_string("%s%d/Data %d.CSV", F.lit("d"), "n_nationkey", "n_regionkey")
    once = n.select("n_nationkey", path.alias("source_path"), F.col("n_name").alias("source_table_name"))
    again = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.regexp_replace(path, "^d", "a").alias("source_path"), F.concat("n_name", F.lit(" copy")).alias("source_table_name"))
    told = once.unionByName(again)
    tables = told.select("source_path", F.lit("").alias("source_sheet_name"), "source_table_name", F.lit("csv").alias("source_format"), F.array(F.lit("name"), F.lit("segment"), F.col("n_nationkey").cast("string")).alias("columns"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").cast("long").alias("row_id"), F.array("c_name", "c_mktsegment", F.lit("")).alias("cells"))
    rows = told.join(c, "n_nationkey").select("source_path", F.lit("").alias("source_sheet_name"), "source_table_name", "row_id", "cells")
    taken = spark.createDataFrame([("data_0",), ("data_1_3_typed",)], "name string")
    return loading.load_tables(fresh_store(spark), tables, rows, taken=taken).select("source_path", "source_table_name", "table_name", "row_count", "load_status")


# Customers as source rows of documents, one a nation; some are told by their path, some by their metadata only.
_SOURCES = """s as (select distinct case when c_custkey % 3 = 0 then 'other/' else 'docs/' || c_nationkey || '/tables/' end || c_custkey % 40 || '.csv' as source_path, 'f' || c_custkey % 300 as fingerprint, case when c_custkey % 6 = 0 then 'docs/' || c_nationkey || '.pdf' when c_custkey % 6 = 3 then 'none' end as pdf, case when c_custkey % 7 = 0 then 'docs/' || c_nationkey || '/manifest.json' end as manifest from customer),
  m as (select *, starts_with(source_path, 'docs/3/tables/') or coalesce(pdf = 'docs/3.pdf', false) or coalesce(manifest = 'docs/3/manifest.json', false) as stale from s),
  swept as (select distinct fingerprint, 't' || fingerprint as t from m where stale and fingerprint not in (select fingerprint from m where not stale)),
  gone as (select 'content' as kind, fingerprint as id from m where stale union select 'artifact', t from swept union select 'artifact', t || '_typed' from swept union select 'file', source_path from m where stale union select 'file', 'docs/3.pdf'),
  e as (select distinct 'file' as a, source_path as b, 'produced' as r, 'content' as c, fingerprint as d from m union select 'content', fingerprint, 'stored_as', 'artifact', 't' || fingerprint from m union select 'artifact', 't' || fingerprint, 'typed_as', 'artifact', 't' || fingerprint || '_typed' from m union select 'artifact', 't' || fingerprint || '_typed', 'typed_from', 'artifact', 't' || fingerprint from m)"""


@query(f"""with {_SOURCES}
  select 'source' as kind, source_path || '|' || fingerprint as id, count(*) as n from m where not stale group by all
  union all select 'content', fingerprint, 1 from (select distinct fingerprint from m) where fingerprint not in (select fingerprint from swept)
  union all select 'edge', b || '|' || r || '|' || d, 1 from e where not exists (select 1 from gone where kind = a and id = b) and not exists (select 1 from gone where kind = c and id = d)
  union all select 'file', source_path, 1 from (select distinct source_path from m) where source_path not in (select id from gone where kind = 'file')""")
def replaced_document(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    path = F.concat(F.when(k % 3 == 0, "other/").otherwise(F.concat(F.lit("docs/"), F.col("c_nationkey").cast("string"), F.lit("/tables/"))), (k % 40).cast("string"), F.lit(".csv"))
    nation = F.col("c_nationkey").cast("string")
    told = F.to_json(F.struct(F.when(k % 6 == 0, F.concat(F.lit("docs/"), nation, F.lit(".pdf"))).when(k % 6 == 3, "none").alias("pdf_source_path"), F.when(k % 7 == 0, F.concat(F.lit("docs/"), nation, F.lit("/manifest.json"))).alias("tables_manifest_path")))
    sources = c.select(path.alias("source_path"), F.concat(F.lit("f"), (k % 300).cast("string")).alias("fingerprint"), told.alias("source_metadata_json")).distinct()
    contents = sources.select("fingerprint", F.concat(F.lit("t"), "fingerprint").alias("table_name")).distinct()
    files = sources.select(F.col("source_path").alias("path")).distinct()
    edges = catalog.source_edges(sources.join(contents, "fingerprint"))
    stale = loading.belongs(F.col("source_path"), F.col("source_metadata_json"), "docs/3.pdf", "docs/3/tables", "docs/3/manifest.json")
    left = loading.replaced(sources, contents, edges, files, stale, "docs/3.pdf")
    parts = [
        left["sources"].groupBy(F.lit("source").alias("kind"), F.concat_ws("|", "source_path", "fingerprint").alias("id")).agg(F.count("*").alias("n")),
        left["contents"].select(F.lit("content").alias("kind"), F.col("fingerprint").alias("id"), F.lit(1).cast("long").alias("n")),
        left["edges"].select(F.lit("edge").alias("kind"), F.concat_ws("|", "from_id", "relation", "to_id").alias("id"), F.lit(1).cast("long").alias("n")),
        left["files"].select(F.lit("file").alias("kind"), F.col("path").alias("id"), F.lit(1).cast("long").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""with l(name, ancestor) as (values ('dear-orders', 'orders'), ('by-nation', 'customer'), ('by-nation', 'dear-orders'), ('by-nation', 'orders'), ('top-nations', 'by-nation'), ('top-nations', 'customer'), ('top-nations', 'dear-orders'), ('top-nations', 'orders')),
  d as (select * from orders where o_totalprice > 200000), b as (select c_nationkey, count(*) as n from d join customer on o_custkey = c_custkey group by 1),
  s as (select 'dear-orders' as name, count(*) as n from d union all select 'by-nation', count(*) from b union all select 'top-nations', count(*) from b where n > 5)
  select name, ancestor, n as row_count from l join s using (name)""")
def saved_views(spark, sf_dir):
    """Views over views are saved, and replaced; then all that each reads, and how many rows it has."""
    views(spark, sf_dir, "customer", "orders")
    saved = Views(fresh_store(spark), ["customer", "orders"])
    for name, sql in (("dear-orders", "select * from orders where o_totalprice > 1"), ("by-nation", "select c_nationkey, count(*) as n from `dear-orders` join customer on o_custkey = c_custkey group by 1"), ("top-nations", "select * from `by-nation` where n > 5"), ("dear-orders", "select * from orders where o_totalprice > 200000")):
        told = saved.save(sql, name, replace=True)
        if told["status"] != "ok":
            raise ValueError(told["message"])
    sizes = None
    for name in saved.register():
        own = spark.table(f"`{name}`").agg(F.count("*").alias("row_count")).withColumn("name", F.lit(name))
        sizes = own if sizes is None else sizes.unionByName(own)
    return catalog.ancestors(saved.edges()).join(sizes, "name")


# Each customer's orders as a JSON text with objects, arrays, numbers, a name that needs quotes and a null.
_JSON = """j as (select c_custkey, '{"name":"' || c_name || '","a b":null,"ok":' || (c_custkey % 2 = 0)::varchar || ',"orders":[' || coalesce(string_agg('{"k":' || o_orderkey || ',"tags":["' || o_orderstatus || '",' || o_orderkey % 7 || '.5]}', ',' order by o_orderkey), '') || ']}' as t from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name)"""


def json_texts(spark, sf_dir):
    one = F.format_string('{"k":%d,"tags":["%s",%d.5]}', "o_orderkey", "o_orderstatus", F.col("o_orderkey") % 7)
    told = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("t")))), lambda x: x["t"]), ",").alias("o"))
    c = table(spark, sf_dir, "customer").join(told, "c_custkey", "left")
    return c.select("c_custkey", F.format_string('{"name":"%s","a b":null,"ok":%s,"orders":[%s]}', "c_name", (F.col("c_custkey") % 2 == 0).cast("string"), F.coalesce("o", F.lit(""))).alias("t"))


@query(f"""with recursive {_JSON},
  w as (select c_custkey, '$' as fullkey, null::varchar as key, 0 as depth, t::json as v from j
    union all select c_custkey, x.f, x.k, depth + 1, x.v from (select c_custkey, depth, unnest(case json_type(v) when 'ARRAY' then list_transform(range(0, json_array_length(v)::bigint), lambda i: struct_pack(f := fullkey || '[' || i || ']', k := i::varchar, v := json_extract(v, '$[' || i || ']')))
      when 'OBJECT' then list_transform(json_keys(v), lambda n: struct_pack(f := fullkey || case when regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*') then '.' || n else '."' || n || '"' end, k := n, v := json_extract(v, '$."' || n || '"'))) else [] end) as x from w))
  select c_custkey, fullkey, key, depth, case json_type(v) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'VARCHAR' then 'text' when 'DOUBLE' then 'real' when 'BOOLEAN' then v::varchar else 'integer' end as type, case when json_type(v) not in ('OBJECT', 'ARRAY', 'NULL') then v->>'$' end as atom from w""")
def json_tree(spark, sf_dir):
    return json_walk.json_tree(json_texts(spark, sf_dir), ["c_custkey"], "t").drop("parent")


@query("""select event_id, sum(event_id) over (partition by event_type order by user_id range between 3 preceding and 2 following exclude current row)::bigint as no_row, sum(event_id) over (partition by event_type order by user_id range between 3 preceding and 2 following exclude group)::bigint as no_group,
  sum(event_id) over (partition by event_type order by user_id range between 3 preceding and 2 following exclude ties)::bigint as no_ties, count(*) over (partition by event_type order by user_id range between 3 preceding and 2 following exclude group) as n from events""")
def frames_exclude(spark, sf_dir):
    by = W.partitionBy("event_type")
    frame, peers = by.orderBy("user_id").rangeBetween(-3, 2), W.partitionBy("event_type", "user_id")
    made = {name: frames.sum_and_count(F.col("event_id"), frame, peers, what) for name, what in (("no_row", "current row"), ("no_group", "group"), ("no_ties", "ties"))}
    return table(spark, sf_dir, "events").select("event_id", *(v[0].alias(k) for k, v in made.items()), made["no_group"][1].alias("n"))


@query("""select page_id, url glob '*.example.com/[a-f]?/*[02468][?]page=[!1]*' as even, url glob 'http://?h*' as short from pages""")
def glob_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cells.glob(F.col("url"), "*.example.com/[a-f]?/*[02468][?]page=[^1]*").alias("even"), cells.glob(F.col("url"), "http://?h*").alias("short"))


def sheets(spark, sf_dir):
    """Conversations as sheets: a turn is a row of its role and the words of its text."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), "turn", F.concat(F.array("role"), F.split("text", " ")).alias("cells"))
    return c.withColumn("row_id", F.row_number().over(W.partitionBy("source_id").orderBy("turn")).cast("long") - 1).select("source_id", "row_id", "cells")


@query()
def sheet_headers(spark, sf_dir):
    """Regions have no SQL; held against a plain version in the tests."""
    g = sheets(spark, sf_dir)
    return segment.header_candidates(segment.described(g, ("anchor", "ahead", "stronger")), layout.regions(g))


@query("""select conv_id::varchar as source_id, count(*) as row_count, max(n) as column_count, count(*) filter (where f > 0) as non_empty_rows, count(*) filter (where f = 0) as blank_rows, max(f)::int as max_non_empty, median(f) filter (where f > 0) as median_non_empty,
    md5(string_agg(array_to_string(c[2:4], ' '), '|' order by turn) filter (where r between 2 and 4)) as cells, (1 + least(3, greatest(0, count(*) - 1)))::int as end_row, (1 + max(greatest(0, least(n, 4) - 1)) filter (where r between 2 and 4))::int as end_column
  from (select *, len(c) as n, len(list_filter(c, lambda x: trim(x) != '')) as f, row_number() over (partition by conv_id order by turn) as r from (select conv_id, turn, list_concat([role], string_split(text, ' ')) as c from conversations)) group by conv_id having count(*) > 1""")
def inspected_sheets(spark, sf_dir):
    got = segment.inspected(sheets(spark, sf_dir), start_row=2, limit=3, start_column=2, end_column=4).where("row_count > 1")
    text = F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|"))
    return got.select("source_id", "row_count", "column_count", "non_empty_rows", "blank_rows", "max_non_empty", "median_non_empty", text.alias("cells"), "end_row", F.col("end_column").alias("end_column"))


@query(r"""with r as (select n_nationkey as k, c_custkey as i, sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_acctbal::decimal(12,2)::varchar || chr(31)) as h from nation join customer on c_nationkey = n_nationkey),
  s as (select k, i // 4096 as s, sha256(string_agg(h, chr(30) order by i)) as h, count(*) as n from r group by all),
  t as (select k, string_agg(h, chr(30) order by s) as h, sum(n)::bigint as n from s group by k)
  select n_name as source_table_name, sha256('name' || chr(31) || 'segment' || chr(31) || n_name || chr(31) || chr(26) || coalesce(h, '')) as fingerprint, coalesce(n, 0) as row_count from nation left join t on k = n_nationkey""")
def content_fingerprints(spark, sf_dir):
    """Each nation's customers are a table."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("in").alias("source_path"), F.lit("").alias("source_sheet_name"), F.col("n_name").alias("source_table_name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").cast("long").alias("row_id"), F.array("c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("cells"))
    tables = n.withColumn("columns", F.array(F.lit("name"), F.lit("segment"), "source_table_name"))
    return loading.content_fingerprints(tables, n.join(c, "n_nationkey").drop("n_nationkey")).select("source_table_name", "fingerprint", "row_count")


@query("""with r as (select r_regionkey as k, 'r' || r_regionkey as id, 'in/r' || r_regionkey || '.csv' as path from region where exists (select 1 from customer join nation on n_nationkey = c_nationkey where n_regionkey = r_regionkey)),
  m as (select 'sqlite_table' as type, id, null::bigint as line, 'column' as field, 'build note' as value, 68::bigint as rank from r union all select 'sqlite_view', id || '_typed', null, 'column', 'build note', 75 from r),
  c as (select 'sqlite_table', 'r' || n_regionkey, row_number() over (partition by n_regionkey order by c_custkey), 'segment', c_mktsegment, 43 from customer join nation on n_nationkey = c_nationkey),
  f as (select 'output_file', 'out/' || doc_id || '.txt', n, 'line', line, 35 from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, unnest(string_split(text, chr(10))) as line from documents))
  select type, id, line, field, case when length(value) > 300 then left(value, 297) || '...' else value end as value, rank from (select * from m union all select * from c where c_mktsegment ilike '%build%' union all select * from f where line ilike '%build%')
  order by rank desc, case type when 'sqlite_view' then 0 when 'sqlite_table' then 1 else 3 end, id, coalesce(line, 0) limit 400""")
def store_search(spark, sf_dir):
    """Customers by region are loaded, and then metadata, cells and lines of files are searched at once."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    path = F.format_string("in/r%d.csv", "n_regionkey")
    rows = c.select(path.alias("source_path"), F.lit("").alias("source_sheet_name"), F.lit("all").alias("source_table_name"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("c_custkey")).cast("long") - 1).alias("row_id"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_mktsegment").alias("cells"))
    tables = rows.select("source_path", "source_sheet_name", "source_table_name").distinct().select("*", F.lit("csv").alias("source_format"), F.array(F.lit("name"), F.lit("segment"), F.lit("build note")).alias("columns"))
    store = fresh_store(spark)
    loading.load_tables(store, tables, rows)
    files = table(spark, sf_dir, "documents").select(F.format_string("out/%d.txt", "doc_id").alias("path"), F.lit("output_file").alias("type"), F.array().cast("array<string>").alias("refs"), "text")
    return describe.found(store, "build", files=files, most=400)


# Each nation's customers are a sheet with a title, a header and a total; every third nation's is a document's reviewed table.
@query("""with c as (select n_nationkey as k, n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by all),
  p as (select *, case when k % 3 = 0 then 'doc' || k || '/work/tables/t.csv' else 'in/nation ' || k || '.csv' end as source_path, case when k % 3 = 0 then 1 else 3 end as top from c),
  t as (select *, case when k % 3 = 0 then 't' || case row_number() over (partition by k % 3 = 0 order by source_path) when 1 then '' else '_' || row_number() over (partition by k % 3 = 0 order by source_path) end else 'nation_' || k end as table_name from p where k % 3 = 0 or n > 1)
  select 'sheet' as kind, source_path, case when k % 3 = 0 or n > 1 then 'loaded' else 'empty' end as name, (case when k % 3 = 0 then n + 1 else n + 5 end)::bigint as first, (case when k % 3 = 0 or n > 1 then 1 else 0 end)::bigint as last, null as told from p
  union all select 'table', source_path, table_name, top, top + n, case when k % 3 = 0 then 'one of 2 after ' || n_name || ' before' else 'reread' end from t
  union all select 'excluded', source_path, 'Total', n + 5, n + 5, null from t where k % 3 > 0""")
def extracted_sheets(spark, sf_dir):
    """``told`` is what provenance tells of a reviewed table; the rows of the others are counted again from the store."""
    n, k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), F.col("k")
    path = F.when(k % 3 == 0, F.format_string("doc%d/work/tables/t.csv", k)).otherwise(F.format_string("in/nation %d.csv", k))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("i"), F.array("c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("cells"))
    size = n.join(c.groupBy("k").agg(F.count("*").alias("n")), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = F.array(F.lit("customer name"), F.lit("market segment"), F.lit("balance in total"))
    blank = F.array(F.lit(""), F.lit(""), F.lit(""))
    above = [F.struct(F.lit(0).alias("i"), F.array("n_name", F.lit(""), F.lit("")).alias("cells")), F.struct(F.lit(1).alias("i"), blank.alias("cells")), F.struct(F.lit(2).alias("i"), head.alias("cells"))]
    below = [F.struct((F.col("n") + 3).cast("int").alias("i"), blank.alias("cells")), F.struct((F.col("n") + 4).cast("int").alias("i"), F.array(F.lit(""), F.lit("Total"), F.col("n").cast("string")).alias("cells"))]
    plain = size.where(k % 3 > 0).select("k", F.inline(F.array(*above, *below))).unionByName(c.where(k % 3 > 0).select("k", F.col("i") + 3, "cells").toDF("k", "i", "cells"))
    ready = size.where(k % 3 == 0).select("k", F.lit(0).alias("i"), head.alias("cells")).unionByName(c.where(k % 3 == 0).select("k", (F.col("i") + 1).alias("i"), F.slice("cells", 1, 2 + F.col("i") % 2).alias("cells")))
    grids = plain.unionByName(ready).select(path.alias("source_path"), F.lit("").alias("source_sheet_name"), F.col("i").cast("long").alias("row_id"), "cells")
    manifest = F.format_string("doc%d/work/tables_manifest.json", k)
    each = [F.to_json(F.struct(F.concat("n_name", F.lit(" before")).alias("name"), F.lit("tables/s.csv").alias("path"))), F.to_json(F.struct(F.lit("own").alias("name"), F.lit("elsewhere/t.csv").alias("path")))]
    entries = n.where(k % 3 == 0).select(manifest.alias("manifest_path"), F.format_string("doc%d.pdf", k).alias("document"), F.posexplode(F.array(*each)).alias("position", "entry"))
    store = fresh_store(spark)
    done = extract.extract(store, grids, entries=entries)
    told = F.get_json_object("source_metadata_json", "$.pdf_table_count")
    reread = store.spark.read.schema("fingerprint string").parquet(f"{store.path}/contents/*").groupBy("fingerprint").agg(F.count("*").alias("_rows"))
    tables = done.tables.join(reread, "fingerprint", "left").withColumn("told", F.when(told.isNotNull(), F.concat(F.lit("one of "), told, F.lit(" after "), F.get_json_object("source_metadata_json", "$.previous_pdf_table_name"))).when(F.col("_rows") == F.col("row_end") - F.col("row_start"), "reread"))
    none = F.lit(None).cast("string").alias("told")
    parts = [
        done.sheets.select(F.lit("sheet").alias("kind"), "source_path", F.col("status").alias("name"), F.col("row_count").alias("first"), F.col("recovered_table_count").alias("last"), none),
        tables.select(F.lit("table").alias("kind"), "source_path", F.col("table_name").alias("name"), F.col("row_start").alias("first"), F.col("row_end").alias("last"), "told"),
        done.excluded.select(F.lit("excluded").alias("kind"), "source_path", F.get("values", F.lit(1)).alias("name"), F.col("row").alias("first"), F.col("row").alias("last"), none),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

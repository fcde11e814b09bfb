"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .mixing import DIMENSIONS, KEEP, PASSES, TEMPER, TOLERANCE, TOPIC
from .quality_rules import ERROR, RISK, RULES

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def line_runs(min_words: int = MIN_WORDS) -> str:
    return rf"""
with parts as (select doc_id, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from parts),
spoken as (select *, len({_WORDS.format("line")}) as n, row_number() over (partition by doc_id order by pos) as seq from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
ahead as (select doc_id, seq, list(line) over w as next_lines, list(n) over w as next_n from spoken window w as (partition by doc_id order by seq rows between current row and {min_words - 1} following)),
sized as (select *, list_min(list_filter(range(1, len(next_n) + 1), lambda k: list_sum(next_n[1:k]) >= {min_words})) as need from ahead),
ranked as (select doc_id, seq, need, row_number() over (partition by next_lines[1:need] order by doc_id, seq) as r from sized where need is not null),
gone as (select distinct doc_id, unnest(range(seq, seq + need)) as seq from ranked where r > 1),
marked as (select lines.doc_id, lines.pos, lines.line, spoken.seq, gone.seq as lost from lines left join spoken using (doc_id, pos) left join gone on gone.doc_id = spoken.doc_id and gone.seq = spoken.seq),
starts as (select doc_id, count(*) as n from gone g where not exists (select 1 from gone h where h.doc_id = g.doc_id and h.seq = g.seq - 1) group by doc_id)
select m.doc_id, count(seq) as n_lines, count(lost) as n_removed, coalesce(any_value(s.n), 0) as n_runs, md5(coalesce(string_agg(line, chr(10) order by pos) filter (where lost is null), '')) as kept_md5
from marked m left join starts s using (doc_id) group by m.doc_id"""


def raked_mixture() -> str:
    cats = ", ".join(f"coalesce({d}, 'unknown') as {d}" for d in DIMENSIONS[:2])
    dims = ", ".join(DIMENSIONS)
    before = "(order by tokens / share, category rows between unbounded preceding and 1 preceding)"
    steps = [f"""base as materialized (select doc_id, {cats}, {TOPIC} as topic, len({_WORDS.format("coalesce(text, '')")}) as tokens from documents),
cells as materialized (select {dims}, sum(tokens)::double as tokens from base group by all),
w0 as materialized (select *, {KEEP}::double as p from cells where tokens > 0),
whole as materialized (select sum(tokens) * {KEEP}::double as goal from w0),
a0 as materialized (select true as active)"""]
    for d in DIMENSIONS:
        steps.append(f"""o_{d} as materialized (select {d} as category, sum(tokens) as tokens, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) over () as share from w0 group by {d}),
r_{d} as materialized (select *, (goal - coalesce(sum(tokens) over {before}, 0)) / (1 - coalesce(sum(share) over {before}, 0)) as rate from o_{d}, whole),
t_{d} as materialized (select category as {d}, least(tokens, share * (select max(rate) from r_{d})) as wanted from r_{d})""")
    n = 0
    for k in range(PASSES):
        for d in DIMENSIONS:
            steps.append(f"w{n + 1} as materialized (select w.* replace (case when active then least(1.0, p * coalesce(wanted / nullif(now, 0), 0)) else p end as p) from w{n} w join (select {d}, sum(p * tokens) as now from w{n} group by {d}) using ({d}) join t_{d} using ({d}), a{k})")
            n += 1
        misses = " union all ".join(f"select abs(sum(p * tokens) - any_value(wanted)) as miss from w{n} join t_{d} using ({d}) group by {d}" for d in DIMENSIONS)
        steps.append(f"a{k + 1} as materialized (select any_value(active) and max(miss) > {TOLERANCE} * any_value(goal) as active from ({misses}), whole, a{k})")
    return "with " + ",\n".join(steps) + f"""
select doc_id, b.source, b.lang, b.topic, b.tokens, round(coalesce(p, 0) / {KEEP}, 6) as weight, round(coalesce(p, 0), 6) as probability, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint / 4294967296.0 < coalesce(p, 0) as kept
from base b left join w{n} using ({dims})"""


def quality_rules() -> str:
    share = RISK / len(RULES)
    rungs = [(name, feature, cutoff) for name, feature, ladder in RULES for cutoff in ladder]
    tested = "\nunion all ".join(f"select stratum, '{name}' as rule, {cutoff}::double as cutoff, count(*) as n, count(*) filter (where ({feature}) > {cutoff}) as k from good group by stratum" for name, feature, cutoff in rungs)
    limits = ", ".join(f"min(cutoff) filter (where rule = '{name}') as cut_{name}" for name, _, _ in RULES)
    over = " or ".join(f"coalesce(({feature}) > cut_{name}, false)" for name, feature, _ in RULES)
    return rf"""
with texts as materialized (select doc_id, coalesce(lang, 'unknown') as stratum, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from texts where len(w) >= 5),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w[i:i + 4]) as c from windows) where c > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id),
lines as (select doc_id, count(*) as n, count(*) - count(distinct l) as d from (select doc_id, unnest(string_split(text, chr(10))) as l from texts) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
counted as materialized (select t.doc_id, stratum, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
    coalesce(l.d, 0) as n_dup_lines, coalesce(l.n, 0) as n_lines, coalesce(c.n, 0) as n_repeat_words from texts t left join lines l using (doc_id) left join covered c using (doc_id)),
judged as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted),
good as materialized (select judged.* from judged join (select doc_id from labels where quality = 1 group by doc_id) using (doc_id) where not base_failed),
tested as materialized ({tested}),
strata as (select count(distinct stratum) as s from good),
passed as (select stratum, rule, cutoff from tested, strata where k <= {share} * n and k < n
    and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - (case when i > 0 then lgamma(i + 1) else 0 end) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) <= {ERROR / len(rungs)} / s),
limits as (select stratum, {limits} from passed group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept, stratum from judged left join limits using (stratum)"""



def centroids(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    far = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::bigint".format(n=dims)
    steps = [f"""kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {dims}),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, q from kept order by 1 limit {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, any_value(q) as q, arg_min(c, (d, c)) as c, min(d) as d from (select v.vec_id, v.q, c.c, {far} as d from kept v, c{r} c) group by vec_id)")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select c.c, coalesce(m.q, c.q) as q from c{r} c left join (select c, list(((s - (s % n + n) % n) // n)::bigint order by i) as q from (select c, i, sum(x) as s, count(*) as n from (select c, unnest(range(1, {dims} + 1)) as i, unnest(q) as x from a{r}) group by c, i) group by c) m using (c))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(f.q, ',')) as centroid_sha256 from a{rounds} a join c{rounds} f using (c)"""


def archived() -> str:
    digits = " + ".join(f"{1 << (4 - j)} * substr(bits, 5 * i + {j + 1}, 1)::int" for j in range(5))
    return f"""
with p as (select page_id, coalesce(html, '') as body, from_hex(sha1(coalesce(html, '')))::bit::varchar as bits from pages),
m as (select *, min(page_id) over (partition by body) as first from p)
select page_id, strlen(body) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {digits}, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, nullif(first, page_id) as refers_to from m"""


def ranked(k: int = 20) -> str:
    term = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
with words as (select doc_id, {term} as term from documents),
tfs as materialized (select doc_id, term, count(*) as tf from words group by all),
lens as materialized (select doc_id, sum(tf)::bigint as n from tfs group by doc_id),
whole as (select count(*) as docs, sum(n)::bigint as words from lens),
weights as materialized (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, whole group by term, docs),
asked as (select item_id, {term} as term from benchmark),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint as score from asked join weights using (term) join tfs using (term) join lens using (doc_id), whole group by all)
select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from scores where score > 0) where rank <= {k}"""



ORACLES = {"op4_raked_mixture": raked_mixture(), "op5_line_runs": line_runs(), "op10_quality_rules": quality_rules(), "op11_kd_centroids": centroids(), "op12_warc": archived(), "op13_maxscore": ranked()}

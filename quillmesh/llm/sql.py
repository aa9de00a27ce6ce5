"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

_MATCH = "select left_id as a, right_id as b from question_matches where left_id is not null and right_id is not null and left_id <> right_id"


def _groups(edges: str) -> str:
    """Common tables whose last, ``grouped(group_id, id)``, has the components of edges (a, b)."""
    return f"ed as ({edges}), un as (select a, b from ed union select b, a from ed), rc as (select a as x, a as y from un union select rc.x, un.b from rc join un on rc.y = un.a), grouped as (select min(y) as group_id, x as id from rc group by x)"


_CLEAN = r"lower(regexp_replace(feature,'^[\s\p{Z}]+|[\s\p{Z}]+$','','g'))"
_ROWS = f"select distinct question_id as q, token_offset as o, {_CLEAN} as f from features where question_id is not null and {_CLEAN} <> ''"
_TERMS = f"r as ({_ROWS}), qf as (select q, f, count(*) as n from r group by all), tf as (select f, sum(n)::bigint as n_rows, count(*) as n_questions from qf group by 1), tq as (select q, sum(n)::bigint as total from qf group by 1), nn as (select count(*) as big_n, sum(total) as rows_all from tq)"
_WORDS = r"""wd as (select distinct question_id as q, unnest(list_transform(regexp_extract_all(regexp_replace(body,'[fF]or 10 points','FTP','g'),'[\p{L}\p{N}]+'), lambda x: lower(x))) as w from questions where body is not null),
 wn as (select q, count(*) as n from wd group by 1 having count(*) >= 10),
 near as (select a.q as a, b.q as b from wd a join wd b on a.w = b.w and a.q < b.q join wn x on x.q = a.q join wn y on y.q = b.q where x.n * 10 >= y.n * 7 and y.n * 10 >= x.n * 7 group by a.q, b.q, x.n, y.n having count(*) * 10 >= 7 * (x.n + y.n - count(*)))"""
_KIND = """select distinct question_id as q, case when k is null or k in ('', 'unknown', 'non selected') then 'unknown' else k end as kind from (select question_id,
 trim(case when position('--' in c) > 0 then case when trim(split_part(c,'--',1)) = 'science' then split_part(c,'--',2) else split_part(c,'--',1) end else c end) as k from (select question_id, lower(category) as c from questions))"""
_FEATURES = f"""st as (select distinct q, f from ({_ROWS}) where f not in (select {_CLEAN} from vocab where censored = 1 and feature is not null)), sn as (select q, count(*) as n from st group by 1 having count(*) >= 10),
 kd as ({_KIND}), sk as (select q, f, kind from st join kd using(q) where q in (select q from sn)),
 alike as (select a.q as a, b.q as b from sk a join sk b on a.f = b.f and a.kind = b.kind and a.q < b.q join sn x on x.q = a.q join sn y on y.q = b.q group by a.q, b.q, a.kind, x.n, y.n having count(*) * 10 >= 3 * (x.n + y.n - count(*)))"""


def _grams(table: str, key: str, text: str) -> str:
    words = rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
    return f"select {key}, i, g from (select {key}, i, string_agg(w, ' ') over win as g, count(*) over win as k from (select {key}, unnest({words}) as w, generate_subscripts({words}, 1) as i from {table} where {text} is not null) window win as (partition by {key} order by i rows between current row and 11 following)) where k = 12"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"with recursive {_groups(_MATCH)} select group_id, id as question_id from grouped",
        "p2_group_sizes": f"with recursive {_groups(_MATCH)} select size, count(*) as groups from (select group_id, count(*) as size from grouped group by 1) group by 1",
        "p3_found": f"with recursive {_FEATURES}, {_groups('select a, b from alike')} select group_id as cluster_id, id as question_id from grouped where group_id in (select group_id from grouped group by 1 having count(*) >= 3)",
        "p4_found": f"with {_TERMS} select f as feature, case when n_questions < 3 then 'rare' else 'common' end as mark from tf, nn where n_questions < 3 or n_questions > 0.2 * big_n",
        "p4_terms": f"with {_TERMS} select f as feature, n_rows, n_questions, case when n_questions < 3 then 'rare' when n_questions > 0.2 * big_n then 'common' end as mark from tf, nn",
        "p5_found": f"with {_WORDS}, sp as (select question_id as q, bool_or(coalesce(train,false)) as t, bool_or(coalesce(dev,false) or coalesce(test,false)) as h from question_split group by 1) select a as question_id_a, b as question_id_b from near join sp x on x.q = a join sp y on y.q = b where x.t and y.h or x.h and y.t",
        "p5_counts": f"""with {_WORDS}, sp as (select question_id as q, bool_or(coalesce(train,false)) as t, bool_or(coalesce(dev,false)) as d, bool_or(coalesce(test,false)) as e from question_split group by 1),
 pr as (select a as tr, b as he from near union all select b, a from near), ov as (select tr, he, y.d, y.e from pr join sp x on x.q = tr and x.t join (select q, d, e from sp where d or e) y on y.q = he),
 fl as (select tr, he, 'dev' as split from ov where d union all select tr, he, 'test' from ov where e), tn as (select question_id as he, min(tournament) as tournament from questions group by 1)
select split, tournament, count(*) as pairs, count(distinct he) as held_questions from fl left join tn using(he) group by all""",
        "p6_found": f"with {_TERMS}, sc as (select q, f, n::double / total * ln(big_n::double / n_questions) as s from qf join tf using(f) join tq using(q), nn where n_questions > 1), rk as (select q, f, s, row_number() over (partition by q order by s desc, f) as k, lead(s) over (partition by q order by s desc, f) as s2 from sc) select q as question_id, f as feature from rk where k = 1 and s2 is not null and s > 0 and s >= 1.45 * s2",
        "p6_scores": f"""with {_TERMS}, al as (select q, f, n, total, n_questions, big_n, n_rows, rows_all, 500.0::double * n_rows / rows_all as al from qf join tf using(f) join tq using(q), nn),
 z as (select *, n + al as own, n_rows - n + al as rest, total + 500.0::double - (n + al) as own_not, rows_all - total + 500.0::double - (n_rows - n + al) as rest_not from al)
select q as question_id, f as feature, n, round(case when own_not > 0 and rest_not > 0 then (ln(own / own_not) - ln(rest / rest_not)) / sqrt(1.0::double / own + 1.0::double / rest) end, 6) as z, round(n::double / total * ln(big_n::double / n_questions), 6) as tfidf from z""",
        "p7_found": f"with recursive {_WORDS}, {_groups('select a, b from near')} select group_id, id as question_id from grouped",
        "p8_found": f"select distinct doc_id, item_id from ({_grams('documents', 'doc_id', 'text')}) join ({_grams('test_items', 'item_id', 'item_text')}) using(g)",
        "p8_leaks": f"""with hit as (select distinct d.doc_id, t.item_id, d.i as p from ({_grams('documents', 'doc_id', 'text')}) d join ({_grams('test_items', 'item_id', 'item_text')}) t using(g)),
 st as (select *, p - lag(p) over (partition by doc_id, item_id order by p) as step from hit)
select doc_id, item_id, cast(1 + count(*) filter (step > 12) as int) as spans, cast(sum(least(12, coalesce(step, 12))) as bigint) as words from st group by 1, 2""",
    }

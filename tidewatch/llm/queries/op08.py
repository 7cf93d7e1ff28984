"""op8: near-duplicate classes of all documents."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.near_dedup import near_duplicates

#: exact Jaccard classes: words, five-word shingles, shared counts, links, and the smallest id that can be reached
SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
sh as (
  select doc_id, unnest(list_distinct(case when len(words) < 5 then case when len(words) = 0 then [] else [array_to_string(words, ' ')] end
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end)) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
cls as (select doc_id, min(doc_id) over (partition by k) as rep from (select doc_id, md5(string_agg(s, '|' order by s)) as k from sh group by doc_id)),
r as (select sh.* from sh join cls using (doc_id) where rep = doc_id),
both_ as (select a.doc_id as u, b.doc_id as v, count(*) as c from r a join r b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select u, v from both_ join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)
  union all select rep, doc_id from cls where rep <> doc_id),
e as (select u, v from link union select v, u from link),
reach as (select doc_id as a, doc_id as b from n union select reach.a, e.v from reach join e on e.u = reach.b),
root as (select a as doc_id, min(b) as root from reach group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(root.root, d.doc_id) as component_id,
  coalesce(root.root, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join root using (doc_id)
"""


def op8_minhash_near_dedup(spark, sf_dir):
    session(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), 75)


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLES = {"op8_minhash_near_dedup": SQL}

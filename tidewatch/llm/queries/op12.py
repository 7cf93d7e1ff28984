"""op12: the prefix trie of all conversations, their beginnings shared by a fixed rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.common import session, table
from tidewatch.llm.prefix_trie import paths, regrafted, trie

#: every prefix of every conversation, grouped; parents and subtrees by comparing prefixes
SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
own as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, role, text) as turns,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ord(c) as bigint))),
      lambda c, b: xor(c >> 8, any_value(t)[(xor(c, b) & 255) + 1])), 4294967295) % 9 as h
  from conversations, crc where conv_id is not null group by conv_id),
built as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns from own c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
prefix as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from built),
member as (select conv_id, depth, len(turns) = depth as ends, case when depth > 0 then strlen(turns[depth].t) else 0 end as bytes,
  sha256(cast(turns[1:depth] as varchar)) as k, case when depth > 0 then sha256(cast(turns[1:depth - 1] as varchar)) end as up from prefix),
node as (select k, depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n, any_value(bytes) as bytes,
  sha256(coalesce(string_agg(case when ends then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256 from member group by k, depth),
kids as (select up as k, depth - 1 as depth, count(*) as c from node where up is not null group by all),
full_ as (select node.*, coalesce(c, 0) as c from node left join kids using (k, depth)),
lift as (
  select k, up, depth, k as from_k, depth as from_depth from full_
  union all
  select p.k, p.up, p.depth, l.from_k, l.from_depth from lift l join full_ p on p.k = l.up and p.depth = l.depth - 1),
below as (select l.k, l.depth, sum((f.c = 0)::int) as leaves, sum((f.n - 1) * f.bytes) as saved from lift l join full_ f on f.k = l.from_k and f.depth = l.from_depth group by l.k, l.depth)
select f.conv_id, cast(f.depth as bigint) as depth, p.conv_id as parent_conv_id, f.n as n_convs, f.c as n_children, cast(b.leaves as bigint) as n_leaves,
  cast(b.saved as bigint) as saved_tokens, f.ends_sha256
from full_ f join below b using (k, depth) left join full_ p on p.k = f.up and p.depth = f.depth - 1
"""


def op12_conversation_prefix_trie(spark, sf_dir):
    session(spark)
    conv = F.col("conv_id")
    own = paths(table(spark, sf_dir, "conversations"))
    return trie(regrafted(own, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


QUERIES = {"op12_conversation_prefix_trie": op12_conversation_prefix_trie}
ORACLES = {"op12_conversation_prefix_trie": SQL}

"""op11: a manifest of all documents, a tree per language, checked against rows of which some were tampered with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.common import session, table
from tidewatch.llm.merkle import manifest, verified

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

#: levels by recursion over whole levels; a proof by climbing from the leaf
SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
doc as (
  select row_number() over () as row, doc_id, lang, concat(
      coalesce(concat(strlen(cast(doc_id as varchar)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-')) as head,
    n_chars, coalesce(concat(strlen(text), ':', text), '-') as body,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 as tampered
  from documents, crc),
hashed as (
  select *, sha256(concat(head, coalesce(concat(strlen(cast(n_chars as varchar)), ':', n_chars), '-'), body)) as leaf,
    sha256(concat(head, coalesce(concat(strlen(cast(n_chars + 1 as varchar)), ':', n_chars + 1), '-'), body)) as other from doc),
nodes as (
  select lang, 0 as level, row_number() over (partition by lang order by doc_id nulls first, leaf, row) - 1 as place, leaf as node, count(*) over (partition by lang) as n from hashed
  union all
  select lang, level + 1, place // 2, sha256(string_agg(node, '' order by place)), (n + 1) // 2 from nodes where n > 1 group by lang, level, place // 2, n),
leaves as (select row, lang, row_number() over (partition by lang order by doc_id nulls first, leaf, row) - 1 as place from hashed),
roots as (select lang, node, level as height from nodes where n = 1),
tops as (
  select 0 as level, row_number() over (order by lang nulls first) - 1 as place, node, count(*) over () as n from roots
  union all
  select level + 1, place // 2, sha256(string_agg(node, '' order by place)), (n + 1) // 2 from tops where n > 1 group by level, place // 2, n),
named as (select lang, node as subroot, height, row_number() over (order by lang nulls first) - 1 as place from roots),
steps as (
  select l.row, n.level, l.place >> n.level as own, s.node as sibling, n.n
  from leaves l join nodes n on l.lang is not distinct from n.lang and l.place >> n.level = n.place and n.n > 1
    left join nodes s on s.lang is not distinct from n.lang and s.level = n.level and s.place = xor(n.place, 1)
  union all
  select l.row, r.height + t.level, r.place >> t.level, s.node, t.n
  from leaves l join named r on l.lang is not distinct from r.lang join tops t on t.place = r.place >> t.level and t.n > 1
    left join tops s on s.level = t.level and s.place = xor(t.place, 1)),
climb as (
  select row, 0 as level, case when tampered then other else leaf end as hash from hashed
  union all
  select c.row, c.level + 1, sha256(case when s.sibling is null then c.hash when s.own % 2 = 0 then concat(c.hash, s.sibling) else concat(s.sibling, c.hash) end)
  from climb c join steps s on s.row = c.row and s.level = c.level),
folded as (select row, arg_max(hash, level) as folded_root from climb group by row),
proofs as (select row, sha256(coalesce(string_agg(sibling, '' order by level), '')) as proof from steps group by row)
select h.doc_id, h.leaf, r.subroot, (select node from tops where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256, f.folded_root,
  f.folded_root = (select node from tops where n = 1) as verified
from hashed h join named r on h.lang is not distinct from r.lang join folded f using (row) left join proofs p using (row)
"""


def op11_merkle_manifest(spark, sf_dir):
    session(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    proofs = verified(manifest(table(spark, sf_dir, "documents"), COLUMNS, "lang", "doc_id", changed))
    text = lambda c: F.lower(F.hex(c))
    return proofs.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                         F.sha2(text("siblings"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"),
                         (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": SQL}

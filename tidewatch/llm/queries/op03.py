"""op3: verdict of the url rules, else of trust and distrust over the host graph, for every page."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.link_graph import FOLLOW, KIN, LINK, ROUNDS, UNIT, judged

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_link_graph_url_filter(spark, sf_dir):
    session(spark)
    return judged(table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "case when {0} like '%://%' then substring({0}, strpos({0}, '://') + 3) else '' end"
    host = low.format(r"regexp_extract(rest, '^([^/?#]*)', 1)")
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    ctes = [
        f"raw as (select page_id, coalesce(html, '') as html, {rest.format('url')} as rest from pages)",
        rf"pg as (select page_id, html, coalesce({host}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from raw)",
        f"rules(h, p, v) as (values {values})",
        "hp as (select distinct host, path from pg)",
        """fit as (select host, path, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as ruled
          from hp join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)""",
        "pr as (select page_id, html, host, path, rule, ruled from pg left join fit using (host, path))",
        """seeds as (select host, count(*) filter (where ruled = 'allow') as good, count(*) filter (where ruled = 'block') as bad from pr where host <> '' group by host)""",
        r"""urls as (select host as src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?((?:https?:)?//[^\s"''<>]+)', 1)) as url from pr where host <> '')""",
        f"""rests as (select src, {rest.format("case when starts_with(url, '//') then 'http:' || url else url end")} as rest from urls)""",
        f"links as (select src, {host} as dst, count(*) * {LINK} as weight from rests group by all having src <> {host})",
        """cuts as (select host, unnest(generate_series(1, len(string_split(host, '.')))) as cut from seeds)""",
        """shorter as (select host, cut, array_to_string(string_split(host, '.')[cut + 1:], '.') as parent from cuts)""",
        """kin as (select host, min_by(parent, cut) as parent from shorter where parent in (select host from seeds) group by host)""",
        f"""edges as materialized (select src, dst, sum(weight) as weight from (select src, dst, weight from links where dst in (select host from seeds)
          union all select host, parent, {KIN} from kin union all select parent, host, {KIN} from kin) group by all)""",
        "good_out as (select src, sum(weight) as a from edges group by src)",
        "bad_out as (select dst, sum(weight) as a from edges group by dst)",
    ]
    for name, end, other, column in (("good", "src", "dst", "good"), ("bad", "dst", "src", "bad")):
        ctes.append(f"{name}0 as materialized (select host, cast(cast({column} as hugeint) * {UNIT} // (select sum({column}) from seeds) as bigint) as seed, "
                    f"cast(cast({column} as hugeint) * {UNIT} // (select sum({column}) from seeds) as bigint) as mass from seeds where {column} > 0)")
        for i in range(ROUNDS):
            ctes.append(f"""{name}{i + 1} as materialized (select host, cast(sum(mass) as bigint) as mass from (
              select e.{other} as host, cast(m.mass as hugeint) * {FOLLOW} * e.weight // (100 * o.a) as mass
              from edges e join {name}_out o using ({end}) join {name}{i} m on m.host = e.{end}
              union all select host, seed * {100 - FOLLOW} // 100 from {name}0) group by host)""")
    ctes.append(f"""st as (select s.host, coalesce(cast(cast(g.mass as hugeint) * (select sum(good) from seeds) // 1000 as bigint), 0) as trust,
      coalesce(cast(cast(b.mass as hugeint) * (select sum(bad) from seeds) // 1000 as bigint), 0) as distrust
      from seeds s left join good{ROUNDS} g on g.host = s.host left join bad{ROUNDS} b on b.host = s.host)""")
    return ("with " + ",\n".join(ctes) + """
    select page_id, pr.host, path, rule, coalesce(ruled, case when coalesce(distrust > trust, false) then 'block' else 'allow' end) as verdict,
      coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust from pr left join st on st.host = pr.host""")


QUERIES = {"op3_link_graph_url_filter": op3_link_graph_url_filter}
ORACLES = {"op3_link_graph_url_filter": _sql()}

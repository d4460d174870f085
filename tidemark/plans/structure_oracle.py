"""SQL that the queries of :mod:`tidemark.plans.structure` must agree with, written independently of them."""

from __future__ import annotations

from tidemark.plans.oracle import _EV, _SS

_BAND = f"""WITH {_SS}, sets AS (SELECT person_id, session_no, list(DISTINCT category) AS items FROM ss GROUP BY 1, 2 HAVING count(DISTINCT category) >= 2),
item AS (SELECT person_id, session_no, unnest(items) AS item FROM sets), w AS (SELECT person_id, item, count(*) AS weight FROM item GROUP BY 1, 2),
u AS (SELECT s.person_id, s.session_no, run, item, weight, len(items) AS wanted, (('0x' || md5(concat_ws('|', 20260901, run, s.person_id, s.session_no, item))[1:13])::BIGINT + 0.5) / 4503599627370496::DOUBLE AS u
    FROM sets s JOIN w USING (person_id), (SELECT unnest(range(1, 51)) AS run)),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY person_id, session_no, run ORDER BY -ln(u) / weight, item) <= wanted),
al AS (SELECT person_id, 0 AS run, session_no, item FROM item UNION ALL SELECT person_id, run, session_no, item FROM d),
tot AS (SELECT person_id, run, count(DISTINCT session_no) AS t FROM al GROUP BY 1, 2), it AS (SELECT person_id, run, item, count(*) AS n FROM al GROUP BY 1, 2, 3),
pp AS (SELECT x.person_id, x.run, x.item AS a, y.item AS b, count(*) AS s FROM al x JOIN al y USING (person_id, run, session_no) WHERE x.item <> y.item GROUP BY ALL HAVING count(*) >= 5),
c AS (SELECT pp.person_id, pp.run, count(*) AS n FROM pp JOIN it i ON i.person_id = pp.person_id AND i.run = pp.run AND i.item = a
    JOIN it j ON j.person_id = pp.person_id AND j.run = pp.run AND j.item = b JOIN tot ON tot.person_id = pp.person_id AND tot.run = pp.run
    WHERE s / i.n >= 0.3 AND s / i.n * t / j.n >= 1.0 GROUP BY 1, 2),
f AS (SELECT p.person_id, r.run, coalesce(c.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT person_id FROM sets) p CROSS JOIN (SELECT unnest(range(0, 51)) AS run) r
    LEFT JOIN c ON c.person_id = p.person_id AND c.run = r.run)
SELECT person_id, CAST(max(n) FILTER (WHERE run = 0) AS BIGINT) AS rules, quantile_cont(n, 0.5) FILTER (WHERE run > 0) AS median,
    CAST(floor(round(quantile_cont(n, 0.025) FILTER (WHERE run > 0), 9)) AS BIGINT) AS low, CAST(ceil(round(quantile_cont(n, 0.975) FILTER (WHERE run > 0), 9)) AS BIGINT) AS high
FROM f GROUP BY 1"""


def _clusters(source: str, prefix: str) -> str:
    """CTEs ``{prefix}cl`` (who, domain, cluster) over a relation (who, us, event_id, domain): sessions, links, components."""
    p = prefix
    return f"""{p}g AS (SELECT *, us - lag(us) OVER (PARTITION BY who ORDER BY us, event_id) AS gap FROM {source}),
{p}s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY us, event_id) AS sn FROM {p}g),
{p}m AS (SELECT DISTINCT who, sn, domain FROM {p}s WHERE domain IS NOT NULL), {p}n AS (SELECT who, domain, count(*) AS n FROM {p}m GROUP BY 1, 2 HAVING count(*) >= 2),
{p}k AS (SELECT * FROM {p}m JOIN {p}n USING (who, domain)),
{p}j AS (SELECT x.who, x.domain AS a, y.domain AS b FROM {p}k x JOIN {p}k y ON x.who = y.who AND x.sn = y.sn AND x.domain <> y.domain
    GROUP BY 1, 2, 3 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.4),
{p}r AS (SELECT who, a AS domain, a AS cluster FROM {p}j UNION SELECT r.who, j.b, r.cluster FROM {p}r r JOIN {p}j j ON j.who = r.who AND j.a = r.domain),
{p}cl AS (SELECT who, domain, min(cluster) AS cluster FROM {p}r GROUP BY 1, 2)"""


# Halves are persons of their own: twice the person's number, plus the half.
_HALF = f"""{_EV}, hv AS (SELECT CASE WHEN row_number() OVER (PARTITION BY person_id ORDER BY us, event_id) <= count(*) OVER (PARTITION BY person_id) // 2
    THEN 2 * person_id ELSE 2 * person_id + 1 END AS who, us, event_id, domain FROM ev), {_clusters('hv', 'h')},
sh AS (SELECT a.who // 2 AS person_id, a.domain, a.cluster AS one, b.cluster AS two FROM hcl a JOIN hcl b ON b.who = a.who + 1 AND a.domain = b.domain WHERE a.who % 2 = 0),
pr AS (SELECT x.person_id, count(*) FILTER (WHERE x.domain < y.domain) AS pairs, count(*) FILTER (WHERE x.domain < y.domain AND (x.one = y.one) = (x.two = y.two)) AS same,
    count(DISTINCT x.domain) AS items FROM sh x JOIN sh y ON x.person_id = y.person_id GROUP BY 1)"""

ORACLES = {
    "rule_null_band": _BAND,
    "half_agreement": f"WITH RECURSIVE {_HALF} SELECT person_id, items, round(same / nullif(pairs, 0), 6) + 0.0 AS agreement FROM pr",
    "cluster_stats": f"""WITH RECURSIVE {_HALF}, wh AS (SELECT person_id AS who, us, event_id, domain FROM ev), {_clusters('wh', 'w')},
        d AS (SELECT who, domain, count(*) AS n, count(DISTINCT sn) AS k FROM ws WHERE domain IS NOT NULL GROUP BY 1, 2), e AS (SELECT d.*, cluster FROM d LEFT JOIN wcl USING (who, domain)),
        z AS (SELECT who, cluster, count(*) AS size FROM e WHERE cluster IS NOT NULL GROUP BY 1, 2), big AS (SELECT who, count(*) AS clusters, max(size) AS largest FROM z GROUP BY 1)
        SELECT e.who AS person_id, count(*) AS domains, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (WHERE k >= 2) AS clusterable_domains, coalesce(any_value(clusters), 0) AS clusters,
            count(cluster) AS clustered_domains, round(coalesce(sum(n) FILTER (WHERE cluster IS NOT NULL), 0) / sum(n), 6) + 0.0 AS events_covered, coalesce(any_value(largest), 0) AS largest_cluster,
            round(any_value(same / nullif(pairs, 0)), 6) + 0.0 AS half_agreement
        FROM e LEFT JOIN big ON big.who = e.who LEFT JOIN pr ON pr.person_id = e.who GROUP BY 1""",
}

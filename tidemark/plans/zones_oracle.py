"""SQL that the queries of :mod:`tidemark.plans.zones` must agree with, written independently of them."""

from __future__ import annotations

from tidemark.plans.oracle import _LB, _PRED, _URL

_LOCAL = """le AS (SELECT user_id AS person_id, epoch_us(ts) AS us, event_type AS category, json_extract_string(props, '$.k') AS domain, ['UTC', 'America/New_York', 'Asia/Kolkata', 'Europe/Berlin'][user_id % 4 + 1] AS zone,
    timezone(['UTC', 'America/New_York', 'Asia/Kolkata', 'Europe/Berlin'][user_id % 4 + 1], timezone('UTC', ts::TIMESTAMP)) AS wall FROM events),
ld AS (SELECT *, date_diff('day', DATE '1970-01-01', wall::DATE) AS d, isodow(wall) AS wd FROM le),
lb3 AS (SELECT *, 'day' AS kind, d AS day, 1 AS step FROM ld UNION ALL SELECT *, 'weekday', d - wd + 1, 7 FROM ld WHERE wd <= 5 UNION ALL SELECT *, 'weekend', d - wd + 6, 7 FROM ld WHERE wd >= 6)"""
_CELLS = _LOCAL + """, cn AS (SELECT person_id, kind, any_value(step) AS step, day, category, count(*) AS n FROM lb3 GROUP BY person_id, kind, day, category),
sp AS (SELECT person_id, kind, any_value(step) AS step, min(day) AS lo, max(day) AS hi FROM cn GROUP BY 1, 2), ca AS (SELECT DISTINCT person_id, kind, category FROM cn),
se AS (SELECT person_id, kind, step, lo, unnest(generate_series(lo + step, hi - step, step)) AS day FROM sp WHERE hi - lo >= 2 * step),
gr AS (SELECT se.person_id, se.kind, se.day, (se.day - lo) // se.step AS rn, ca.category, coalesce(cn.n, 0) AS n FROM se JOIN ca ON ca.person_id = se.person_id AND ca.kind = se.kind
    LEFT JOIN cn ON cn.person_id = se.person_id AND cn.kind = se.kind AND cn.day = se.day AND cn.category = ca.category)"""
_JUDGED = _CELLS + """, tt AS (SELECT person_id, kind, day, sum(n) AS total FROM gr GROUP BY 1, 2, 3),
be AS (SELECT gr.*, total FROM gr JOIN tt USING (person_id, kind, day) WHERE day >= (SELECT min(q.day) FROM gr q WHERE q.person_id = gr.person_id AND q.kind = gr.kind AND q.category = gr.category AND q.n > 0)),
wi AS (SELECT *, row_number() OVER w AS k, array_agg(n) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win, array_agg(total) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS tow FROM be WINDOW w AS (PARTITION BY person_id, kind, category ORDER BY rn)),
ju AS (SELECT *, list_median(win) AS med, len([x for x in win if x > 0]) AS act FROM wi WHERE k > CASE kind WHEN 'day' THEN 6 ELSE 1 END),
fi AS (SELECT *, 2 * act >= len(win) AS fits FROM ju)"""

_GATE = _LB + """, gs AS (SELECT person_id, count(*) AS visits, count(DISTINCT session_no) AS sessions FROM ss GROUP BY 1), gl AS (SELECT person_id, count(*) AS labels FROM lb GROUP BY 1),
ga AS (SELECT gs.*, coalesce(labels, 0) AS labels, CASE WHEN visits < 60 THEN 'visits' WHEN sessions < 20 THEN 'sessions' WHEN coalesce(labels, 0) < 45 THEN 'labels' END AS reason FROM gs LEFT JOIN gl USING (person_id))"""

ORACLES = {
    "resolved_layers": f"""WITH {_URL}, mp AS (SELECT domain FROM cd WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
        y AS (SELECT CASE WHEN cd.domain IS NOT NULL AND page_id % 18 = 0 THEN 'override' WHEN mp.domain IS NOT NULL THEN 'map' WHEN rule IS NOT NULL THEN 'rule' ELSE 'unknown' END AS layer, rule FROM cd LEFT JOIN mp ON mp.domain = cd.domain)
        SELECT CASE layer WHEN 'override' THEN 'own' WHEN 'map' THEN 'shared' WHEN 'rule' THEN rule ELSE 'unknown' END AS category, layer, count(*) AS n FROM y GROUP BY 1, 2""",
    "zoned_grid": f"WITH {_CELLS} SELECT person_id, kind, day, rn, category, n FROM gr",
    "zoned_block_volume": f"""WITH {_JUDGED} SELECT person_id, kind, category, day, n > med AS outcome, round(win[-1] / (med + 1.0::DOUBLE), 6) + 0.0 AS "lastRatio", round(med::DOUBLE / (med + 5.0::DOUBLE), 6) + 0.0 AS "medianLevel",
        round(act / len(win), 6) + 0.0 AS "activeRate10", round(coalesce(list_sum(win) / nullif(list_sum(tow), 0), 0), 6) + 0.0 AS "topicShare10" FROM fi WHERE fits""",
    "zoned_volume_stats": f"""WITH {_JUDGED} SELECT person_id, kind, count(*) FILTER (WHERE fits) AS labels, count(*) FILTER (WHERE fits AND n > med) AS strict, count(*) FILTER (WHERE fits AND n >= med) AS inclusive, count(*) FILTER (WHERE fits AND n = med) AS ties,
        count(*) FILTER (WHERE fits AND med = 0) AS zero_medians, count(DISTINCT category) FILTER (WHERE fits) AS topics,
        count(DISTINCT category) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fi q WHERE q.person_id = fi.person_id AND q.kind = fi.kind AND q.category = fi.category AND q.fits)) AS rejected_topics FROM fi GROUP BY 1, 2""",
    "zoned_dormancy": f"""WITH {_CELLS}, q AS (SELECT *, CASE kind WHEN 'day' THEN sum(n) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) ELSE sum(n) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS quiet,
        sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM gr WINDOW w AS (PARTITION BY person_id, kind, category ORDER BY rn))
        SELECT person_id, kind, count(*) AS n_dormant, count(*) FILTER (WHERE n > 0) AS n_returned FROM q WHERE quiet = 0 AND ever > 0 GROUP BY 1, 2""",
    "zoned_novelty": f"""WITH {_LOCAL}, bl AS (SELECT person_id, kind, day, min(us) AS fa FROM lb3 WHERE domain IS NOT NULL GROUP BY 1, 2, 3),
        jb AS (SELECT * FROM bl WHERE EXISTS (SELECT 1 FROM le x WHERE x.person_id = bl.person_id AND x.domain IS NOT NULL AND x.us < fa AND x.us >= fa - 604800000000)),
        dm AS (SELECT DISTINCT person_id, kind, day, domain FROM lb3 WHERE domain IS NOT NULL)
        SELECT jb.person_id, jb.kind, jb.day, count(*) AS n_domains, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM le x WHERE x.person_id = jb.person_id AND x.domain = dm.domain AND x.us < fa AND x.us >= fa - 604800000000)) AS n_new
        FROM jb JOIN dm USING (person_id, kind, day) GROUP BY 1, 2, 3""",
    "local_day_visits": f"WITH {_LOCAL} SELECT person_id, d AS day, count(*) AS n, 24.0::DOUBLE AS hours FROM ld GROUP BY 1, 2",
    "eligibility": f"WITH {_GATE} SELECT person_id, visits, sessions, labels, reason FROM ga",
    "panel_measurement": f"""WITH {_PRED}, gs AS (SELECT person_id, count(*) AS visits, count(DISTINCT session_no) AS sessions FROM ss GROUP BY 1), gl AS (SELECT person_id, count(*) AS labels FROM lb GROUP BY 1),
        m AS (SELECT person_id, count(*) FILTER (WHERE model = 'base_rate') AS test_rows, avg(y) AS base_rate, avg((p - y) * (p - y)) FILTER (WHERE model = 'base_rate') - avg((p - y) * (p - y)) FILTER (WHERE model = 'category_rate') AS gain FROM pr GROUP BY 1)
        SELECT person_id, visits, sessions, labels, test_rows, round(base_rate, 6) + 0.0 AS base_rate, round(gain, 6) + 0.0 AS gain FROM gs JOIN gl USING (person_id) JOIN m USING (person_id) WHERE visits >= 60 AND sessions >= 20 AND labels >= 45""",
}

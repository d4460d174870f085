"""SQL that the queries of :mod:`tidemark.plans.collection` must agree with, written independently of them."""

from __future__ import annotations

from tidemark.plans.oracle import _LB

_VIS = """e AS (SELECT user_id AS person_id, event_id AS visit_id, epoch_us(ts) AS us, event_type AS c, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
v AS (SELECT person_id, visit_id, us, CASE WHEN k % 5 <> 0 THEN lag(visit_id) OVER (PARTITION BY person_id ORDER BY us, visit_id) END AS from_visit,
    CASE c WHEN 'click' THEN 1 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 8 ELSE 0 END AS core, k % 2 = 1 AS chain_end, k > 80 AS hop, k % 7 = 0 AS odd, 'site' || (k % 50) AS site FROM e),
w AS (SELECT max(us) - 20 * 86400000000 AS lo, max(us) AS hi FROM e),
x AS (SELECT v.*, us >= lo AND us <= hi AS inside, odd::INT || site AS url FROM v, w)"""

_SIM = _VIS + """, pg AS (SELECT person_id, url, bool_or(inside AND chain_end AND core <> 3) AS offered FROM x GROUP BY 1, 2 HAVING bool_or(inside)),
f AS (SELECT x.*, offered FROM x JOIN pg USING (person_id, url)),
s AS (SELECT f.*, CASE WHEN NOT f.offered THEN 'api-hidden' WHEN NOT f.inside THEN 'out-of-window' WHEN f.core = 3 THEN 'subframe'
    WHEN f.us - r.us BETWEEN 0 AND 7200000000 THEN 'redirect' WHEN f.odd THEN 'not-web' ELSE 'kept' END AS verdict
    FROM f LEFT JOIN f r ON r.person_id = f.person_id AND r.visit_id = f.from_visit AND r.offered AND f.offered AND f.from_visit <> 0)"""

_VERDICTS = ("api-hidden", "out-of-window", "subframe", "redirect", "not-web", "kept")

# The batch resolution long after the last window: gaps that are still open have no end.
_LATE = _LB.replace("WITH ", "") + """, pq AS (SELECT person_id, category, window_end AS start_us, window_end + 86400000000 AS end_us FROM lb),
sw AS (SELECT person_id, us, category <> 'view' AS o, lag(category <> 'view') OVER (PARTITION BY person_id ORDER BY us, event_id) AS b FROM ev),
gp AS (SELECT person_id, us AS from_us, coalesce((SELECT min(q.us) FROM sw q WHERE q.person_id = sw.person_id AND q.us > sw.us AND q.o), 9000000000000000000) AS to_us FROM sw WHERE NOT o AND coalesce(b, true))"""

ORACLES = {
    "import_verdicts": f"WITH {_SIM} SELECT person_id, verdict, count(*) AS n FROM s GROUP BY 1, 2",
    "import_skips": f"""WITH {_VIS} SELECT x.person_id, CASE WHEN NOT x.inside THEN 'out-of-window' WHEN x.core = 3 THEN 'subframe' WHEN x.us - r.us BETWEEN 0 AND 7200000000 THEN 'redirect'
        WHEN x.odd THEN 'not-web' ELSE 'kept' END AS verdict, count(*) AS n FROM x LEFT JOIN x r ON r.person_id = x.person_id AND r.visit_id = x.from_visit AND x.from_visit <> 0 GROUP BY 1, 2""",
    "import_crosstab": f"""WITH {_SIM} SELECT CASE WHEN hop THEN 'redirect hop' ELSE 'chosen navigation' END AS truth,
        {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.replace('-', '_')}" for v in _VERDICTS)} FROM s GROUP BY 1""",
    "import_comparison": f"""WITH {_SIM}, a AS (SELECT site || '.co.uk' AS d, count(*) AS n FROM s WHERE verdict = 'kept' GROUP BY 1), b AS (SELECT site || '.co.uk' AS d, count(*) AS n FROM x WHERE inside AND NOT odd GROUP BY 1),
        j AS (SELECT coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b ON a.d = b.d)
        SELECT CAST(sum(a) AS BIGINT) AS simulated_events, CAST(sum(b) AS BIGINT) AS exported_events, count(*) FILTER (WHERE a > 0) AS simulated_domains, count(*) FILTER (WHERE b > 0) AS exported_domains,
            count(*) FILTER (WHERE b = 0) AS only_simulated, count(*) FILTER (WHERE a = 0) AS only_exported, CAST(sum(abs(a - b)) AS BIGINT) AS disagreement, round(sum(abs(a - b)) / sum(b), 6) + 0.0 AS disagreement_share FROM j""",
    "redirect_scores": f"""WITH {_VIS}, g AS (SELECT x.hop, x.us - r.us AS gap FROM x LEFT JOIN x r ON r.person_id = x.person_id AND r.visit_id = x.from_visit AND x.from_visit <> 0),
        t AS (SELECT unnest([1, 2, 4, 8, 12, 24, 48]) * 3600000000 AS threshold_us), p AS (SELECT threshold_us, hop, gap IS NOT NULL AS known, coalesce(gap BETWEEN 0 AND threshold_us, false) AS said FROM g, t),
        c AS (SELECT threshold_us, count(*) FILTER (WHERE said AND hop) AS tp, count(*) FILTER (WHERE said AND NOT hop) AS fp, count(*) FILTER (WHERE NOT said AND hop) AS fn, count(*) FILTER (WHERE NOT said AND NOT hop) AS tn,
            round(count(*) FILTER (WHERE hop AND known) / count(*) FILTER (WHERE hop), 6) + 0.0 AS resolvable FROM p GROUP BY 1)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) + 0.0 AS precision, round(tp / nullif(tp + fn, 0), 6) + 0.0 AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) + 0.0 AS f1 FROM c""",
    "stored_events": """SELECT user_id AS person_id, event_id, epoch_us(ts) AS us, CASE WHEN value > 40 THEN 'longest' WHEN value > 20 THEN 'long' ELSE event_type END AS category, json_extract_string(props, '$.k') AS domain FROM events""",
    "stored_counts": """SELECT CASE WHEN value > 40 THEN 'longest' WHEN value > 20 THEN 'long' ELSE event_type END AS category, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1""",
    "streamed_resolution": f"""WITH {_LATE} SELECT person_id, category, start_us, end_us, CASE WHEN EXISTS (SELECT 1 FROM gp WHERE gp.person_id = pq.person_id AND from_us < end_us AND to_us > start_us) THEN 'expired'
        WHEN EXISTS (SELECT 1 FROM ev q WHERE q.person_id = pq.person_id AND q.category = pq.category AND q.us > start_us AND q.us <= end_us) THEN 'hit' ELSE 'miss' END AS outcome FROM pq""",
}

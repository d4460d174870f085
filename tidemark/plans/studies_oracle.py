"""SQL that the queries of :mod:`tidemark.plans.studies` must agree with, written independently of them."""

from __future__ import annotations

from tidemark.plans.oracle import _BLOCK, _ENGAGED, _EV, _FOLD, _FS3, _GRID, _HOURS, _LB, _PRED, _RES, _SS, _TR, _URL, ORACLES as _FIRST
from tidemark.plans.oracle import _r, _sat


def _folds(source: str, order: str) -> str:
    """CTE ``fo`` over a CTE ``lab``: folds of a person's labels in the given order."""
    return f"""{source}, q AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY person_id) AS nl FROM lab),
q2 AS (SELECT *, greatest(CAST(floor(nl * 0.4) AS BIGINT), 5) AS st FROM q WHERE nl >= 20), q3 AS (SELECT *, (nl - st) // 5 AS ch FROM q2),
fo AS (SELECT *, CASE WHEN rn <= st THEN 0 ELSE least((rn - st - 1) // ch + 1, 5) END AS fold FROM q3)"""


def _before(what: str, where: str = "true") -> str:
    return f"(SELECT {what} FROM y x WHERE x.person_id = t.person_id AND x.fold < t.fold AND {where})"


_Y = "y AS (SELECT *, CASE WHEN outcome THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM fo)"
_RIVALS = _FOLD + f""", {_Y}, b AS (SELECT person_id, fold, {_before('avg(x.v)')} AS base_rate FROM (SELECT DISTINCT person_id, fold FROM y WHERE fold > 0) t),
a AS (SELECT t.*, base_rate, {_before('count(*)', '(x.window_end // 21600000000) % 4 = (t.window_end // 21600000000) % 4')} AS n,
    {_before('coalesce(sum(x.v), 0)', '(x.window_end // 21600000000) % 4 = (t.window_end // 21600000000) % 4')} AS pos,
    {_before('arg_max(x.outcome, x.rn)', 'x.category = t.category')} AS last FROM y t JOIN b USING (person_id, fold)),
rv AS (SELECT person_id, category, session_no, fold, v, base_rate, CASE WHEN base_rate > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS majority_class,
    (pos + 5 * base_rate) / (n + 5) AS time_of_day, CASE WHEN last IS NULL THEN base_rate WHEN last THEN 0.95 ELSE 0.05 END::DOUBLE AS same_as_last FROM a)"""
_LONG = " UNION ALL ".join(f"SELECT person_id, '{m}' AS model, {m} AS p, v AS y FROM rv WHERE category <> 'unknown'" for m in ("base_rate", "majority_class", "time_of_day", "same_as_last"))


def _keyed(source: str, order: str, key: str) -> str:
    return _folds(source, order) + f""", {_Y}, k AS (SELECT *, {key} AS key FROM y), c AS (SELECT person_id, key, fold, count(*) AS n, sum(v) AS pos FROM k GROUP BY 1, 2, 3),
b AS (SELECT person_id, fold, {_before('avg(x.v)')} AS base_rate FROM (SELECT DISTINCT person_id, fold FROM y WHERE fold > 0) t),
s AS (SELECT t.*, base_rate, coalesce((SELECT sum(n) FROM c WHERE c.person_id = t.person_id AND c.key = t.key AND c.fold < t.fold), 0) AS kn,
    coalesce((SELECT sum(pos) FROM c WHERE c.person_id = t.person_id AND c.key = t.key AND c.fold < t.fold), 0) AS kp FROM k t JOIN b USING (person_id, fold)),
r AS (SELECT *, (kp + 5 * base_rate) / (kn + 5) AS p FROM s)"""


_COMB = "CASE folds WHEN 5 THEN [1.0, 0.96875, 0.8125, 0.5, 0.1875, 0.03125][wins + 1] END"
_MC = _folds(_TR + ", lab AS (SELECT * FROM (SELECT tr.*, r.us FROM tr JOIN r USING (person_id, event_id)))", "us, event_id") + """,
gm AS (SELECT f.person_id, f.fold, x.to_category, count(*) AS n FROM (SELECT DISTINCT person_id, fold FROM fo WHERE fold > 0) f JOIN fo x ON x.person_id = f.person_id AND x.fold < f.fold GROUP BY 1, 2, 3),
hm AS (SELECT f.person_id, f.fold, x.from_category, x.to_category, count(*) AS n FROM (SELECT DISTINCT person_id, fold FROM fo WHERE fold > 0) f JOIN fo x ON x.person_id = f.person_id AND x.fold < f.fold GROUP BY 1, 2, 3, 4),
m AS (SELECT person_id, fold, arg_min(to_category, (-n, to_category)) AS mode FROM gm GROUP BY 1, 2), ga AS (SELECT *, sum(n) OVER (PARTITION BY person_id, fold) AS al FROM gm),
l AS (SELECT hm.person_id, hm.fold, hm.from_category, arg_min(hm.to_category, (-(hm.n * al + ga.n), hm.to_category)) AS likely FROM hm JOIN ga ON ga.person_id = hm.person_id AND ga.fold = hm.fold AND ga.to_category = hm.to_category GROUP BY 1, 2, 3),
o AS (SELECT t.*, mode, likely, (SELECT arg_min(gm.to_category, (-gm.n, gm.to_category)) FROM gm WHERE gm.person_id = t.person_id AND gm.fold = t.fold AND gm.to_category <> t.from_category) AS con
    FROM fo t JOIN m USING (person_id, fold) LEFT JOIN l USING (person_id, fold, from_category))"""
_CARD = """, sh AS (SELECT person_id, from_category, to_category AS category, event_id FROM tr WHERE to_category <> 'unknown'), bd AS (SELECT person_id, from_category, category, count(*) AS n FROM sh GROUP BY 1, 2, 3),
bo AS (SELECT *, CAST(sum(n) OVER (PARTITION BY person_id, from_category) AS BIGINT) AS denominator, row_number() OVER (PARTITION BY person_id, from_category ORDER BY n DESC, category) AS place FROM bd)"""


def _blocks(kind: str) -> str:
    day = "(us + 19800000000) // 86400000000"
    block = {"day": "day", "weekday": "day - (day + 3) % 7", "weekend": "day - (day + 3) % 7 + 5"}[kind]
    fits = {"day": "true", "weekday": "(day + 3) % 7 < 5", "weekend": "(day + 3) % 7 >= 5"}[kind]
    return f"""WITH {_EV}, d AS (SELECT person_id, {day} AS day FROM ev), b AS (SELECT person_id, {block} AS block, count(*) AS n, count(DISTINCT day) AS a FROM d WHERE {fits} GROUP BY 1, 2),
        e AS (SELECT person_id, min(block) AS lo, max(block) AS hi FROM b GROUP BY 1), s AS (SELECT person_id, lo, hi, unnest(generate_series(lo, hi, {1 if kind == 'day' else 7})) AS block FROM e)
        SELECT person_id, '{kind}' AS kind, block, coalesce(n, 0) AS n, coalesce(a, 0) AS active_days, block > lo AND block < hi AS complete FROM s LEFT JOIN b USING (person_id, block)"""


def _relabel(way: str) -> str:
    """The events' CTE with other categories for the three head domains, and the label CTEs after it."""
    named = {"separate": "'domain:' || e.domain", "merged": "'head'"}[way]
    old = _EV.replace("ev AS", "ev0 AS", 1)
    new = f"""{old}, dn AS (SELECT person_id, domain, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, domain) AS place FROM ev0 WHERE domain IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT e.person_id, event_id, us, CASE WHEN dn.domain IS NULL THEN category ELSE {named} END AS category, e.domain, dwell FROM ev0 e LEFT JOIN dn ON dn.person_id = e.person_id AND dn.domain = e.domain AND place <= 3)"""
    return f"(WITH {_LB.replace(_EV, new, 1)} SELECT '{way}' AS way, count(*) AS n, {_r('avg(outcome::INT)', 'rate')} FROM lb)"


def _definition(name: str, query: str) -> str:
    return f"SELECT '{name}' AS definition, CAST(sum(n_labels) AS BIGINT) AS labels, CAST(sum(n_positive) AS BIGINT) AS positives, count(*) AS persons FROM ({query})"


def _bucketed(hours: int) -> str:
    b = hours * 3_600_000_000
    return f"""WITH {_EV}, b AS (SELECT DISTINCT person_id, category, us // {b} AS bucket FROM ev), o AS (SELECT *, coalesce((SELECT min(x.us) FROM ev x WHERE x.person_id = b.person_id AND x.category = b.category
        AND x.us >= (b.bucket + 1) * {b}) <= (b.bucket + 1) * {b} + 86400000000, false) AS y FROM b) SELECT person_id, count(*) AS n_labels, count(*) FILTER (WHERE y) AS n_positive FROM o GROUP BY 1"""


_BY_SESSION = f"WITH {_LB} SELECT person_id, count(*) AS n_labels, count(*) FILTER (WHERE outcome) AS n_positive FROM lb GROUP BY 1"
_PROXY = _EV + ", dn AS (SELECT person_id, domain, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, domain) AS place FROM ev WHERE domain IS NOT NULL GROUP BY 1, 2)"

ORACLES = {
    "rival_predictions": f"WITH {_RIVALS} SELECT person_id, category, session_no, fold, {_r('base_rate', 'base_rate')}, {_r('majority_class', 'majority_class')}, {_r('time_of_day', 'time_of_day')}, {_r('same_as_last', 'same_as_last')} FROM rv",
    "rival_scores": f"""WITH {_RIVALS}, lg AS ({_LONG}), c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM lg),
        s AS (SELECT person_id, model, count(*) AS n, avg(y) AS rate, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS ll FROM c GROUP BY 1, 2)
        SELECT s.person_id, s.model, s.n, {_r('s.rate', 'rate')}, {_r('s.brier', 'brier')}, {_r('s.ll', 'log_loss')}, {_r('1 - s.brier / nullif(r.brier, 0)', 'skill')} FROM s JOIN s r ON r.person_id = s.person_id AND r.model = 'base_rate'""",
    "domain_rate": f"""WITH {_keyed(f'eng AS ({_ENGAGED}), dom AS (WITH {_EV} SELECT person_id, event_id, domain FROM ev), lab AS (SELECT eng.person_id, event_id, domain, window_end, outcome FROM eng JOIN dom USING (person_id, event_id))', 'window_end, event_id', 'domain')}
        SELECT person_id, event_id, fold, {_r('base_rate', 'base_rate')}, {_r('p', 'p')} FROM r""",
    "presence_rivals": f"""WITH {_keyed(f'lab AS ({_HOURS})', 'hour', '"visitsLastHour" > 0')} SELECT person_id, hour, fold, {_r('p', 'persistence')}, {_r('coalesce("sameHourRate7d", base_rate)', 'rhythm')} FROM r""",
    "threshold_choice": f"""WITH cu AS ({_FIRST['accuracy_coverage']}), c AS (SELECT model, min(threshold) FILTER (WHERE wilson >= 0.6 AND answered >= 20) AS lo, max(threshold) AS hi FROM cu GROUP BY 1)
        SELECT cu.model, threshold, lo IS NOT NULL AS target_met, answered, accuracy, coverage, wilson FROM cu JOIN c ON c.model = cu.model AND threshold = coalesce(lo, hi)""",
    "fold_wins": f"""WITH {_PRED}, f AS (SELECT person_id, fold, avg((p - y) * (p - y)) FILTER (WHERE model = 'category_rate') AS a, avg((p - y) * (p - y)) FILTER (WHERE model = 'base_rate') AS b FROM pr GROUP BY 1, 2),
        w AS (SELECT person_id, count(*) FILTER (WHERE a < b) AS wins, count(*) AS folds FROM f GROUP BY 1) SELECT person_id, wins, folds, ({_COMB})::DOUBLE AS tail FROM w""",
    "worst_cases": f"""WITH {_PRED}, er AS (SELECT *, round((p - y) * (p - y), 9) AS error FROM pr), k AS (SELECT *, row_number() OVER (PARTITION BY person_id, model ORDER BY error DESC, fold, session_no, category) AS place FROM er)
        SELECT person_id, model, fold, session_no, category, {_r('p', 'p')}, y, {_r('error', 'error')} FROM k WHERE place = 1""",
    "category_scores": f"WITH {_PRED} SELECT category, model, count(*) AS n, {_r('avg((p - y) * (p - y))', 'brier')} FROM pr GROUP BY 1, 2 HAVING count(*) >= 20",
    "multiclass_accuracy": f"""WITH {_MC} SELECT person_id, count(*) AS n, {_r('avg((mode = to_category)::INT)', 'global_mode')}, {_r('avg((coalesce(likely, mode) = to_category)::INT)', 'transition_table')},
        {_r('avg((CASE WHEN EXISTS (SELECT 1 FROM gm WHERE gm.person_id = o.person_id AND gm.fold = o.fold AND gm.to_category = previous_category) THEN previous_category ELSE mode END = to_category)::INT)', 'bounce_back')}, {_r('avg((coalesce(con, mode) = to_category)::INT)', 'constrained_mode')} FROM o WHERE fold > 0 GROUP BY 1""",
    "topic_board": f"WITH {_TR}{_CARD} SELECT person_id, from_category, category, n, denominator, {_r('n / denominator', 'share')}, place FROM bo WHERE denominator >= 5",
    "next_category_card": f"""WITH {_TR}{_CARD}, cu AS (SELECT person_id, arg_max(to_category, run) AS cur FROM (SELECT tr.person_id, tr.to_category, r.run FROM tr JOIN r USING (person_id, event_id)) GROUP BY 1),
        t AS (SELECT person_id, count(*) AS total_changes FROM sh GROUP BY 1 HAVING count(*) >= 20), kk AS (SELECT person_id, cur, total_changes, (SELECT count(*) FROM sh WHERE sh.person_id = cu.person_id AND sh.from_category = cur) AS own FROM cu JOIN t USING (person_id)),
        aa AS (SELECT kk.person_id, cur, total_changes, CASE WHEN own >= 10 THEN 'conditional' ELSE 'overall' END AS basis, category FROM kk JOIN sh ON sh.person_id = kk.person_id AND CASE WHEN own >= 10 THEN sh.from_category = cur ELSE category <> cur END),
        nc AS (SELECT person_id, cur AS from_category, basis, total_changes, category, count(*) AS n FROM aa GROUP BY ALL)
        SELECT *, CAST(sum(n) OVER (PARTITION BY person_id) AS BIGINT) AS denominator, {_r('n / sum(n) OVER (PARTITION BY person_id)', 'share')}, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, category) AS place FROM nc""",
    "hub_topic": f"""WITH {_TR}{_CARD}, f AS (SELECT * FROM bo WHERE denominator >= 5 AND place = 1), ld AS (SELECT person_id, category, count(*) AS leads_from FROM f GROUP BY 1, 2), t AS (SELECT person_id, count(*) AS topics FROM f GROUP BY 1)
        SELECT person_id, category, leads_from, topics FROM ld JOIN t USING (person_id) WHERE leads_from * 2 > topics""",
    "board_readiness": f"WITH {_TR}, n AS (SELECT person_id, from_category, count(*) AS n FROM tr WHERE to_category <> 'unknown' GROUP BY 1, 2) SELECT person_id, count(*) FILTER (WHERE n >= 5) AS ready, coalesce(max(n) FILTER (WHERE n < 5), 0) AS closest FROM n GROUP BY 1",
    "scorecard_accuracy": f"""WITH {_RES}, pc AS (SELECT category, avg(outcome::INT) AS p FROM lb GROUP BY 1), j AS (SELECT res.*, p, outcome IN ('hit', 'miss') AS sc, (p > 0.5) = (outcome = 'hit') AS ok FROM res JOIN pc USING (category))
        SELECT person_id, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in ('hit', 'miss', 'pending', 'expired'))}, count(*) FILTER (WHERE sc) AS scored,
        {_r("count(*) FILTER (WHERE outcome = 'hit') / nullif(count(*) FILTER (WHERE sc), 0)", 'outcome_rate')}, {_r('count(*) FILTER (WHERE sc AND ok) / nullif(count(*) FILTER (WHERE sc), 0)', 'accuracy')},
        count(*) FILTER (WHERE sc AND ok) AS correct, count(*) FILTER (WHERE sc AND ok) - count(*) FILTER (WHERE outcome = 'hit') AS ahead_of_always_yes FROM j GROUP BY 1""",
    **{f"blocks_{k}": _blocks(k) for k in ("day", "weekday", "weekend")},
    "block_volume_stats": f"""WITH {_GRID}, b AS (SELECT *, sum(n) OVER (PARTITION BY person_id, category ORDER BY rn) > 0 AS begun FROM grid),
        w AS (SELECT *, array_agg(n) OVER (PARTITION BY person_id, category ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win, row_number() OVER (PARTITION BY person_id, category ORDER BY rn) AS k FROM b WHERE begun),
        j AS (SELECT *, list_median(win) AS med, 2 * len(list_filter(win, lambda x: x > 0)) >= len(win) AS fits FROM w WHERE k > 6)
        SELECT person_id, count(*) FILTER (WHERE fits) AS labels, count(*) FILTER (WHERE fits AND n > med) AS strict, count(*) FILTER (WHERE fits AND n >= med) AS inclusive, count(*) FILTER (WHERE fits AND n = med) AS ties,
        count(*) FILTER (WHERE fits AND med = 0) AS zero_medians, count(DISTINCT category) FILTER (WHERE fits) AS topics, count(DISTINCT category) FILTER (WHERE NOT fits AND NOT EXISTS (SELECT 1 FROM j q WHERE q.person_id = j.person_id AND q.category = j.category AND q.fits)) AS rejected_topics FROM j GROUP BY 1""",
    "absorbed_boundaries": f"""WITH {_SS}, x AS (SELECT *, lag(session_no) OVER w AS ps, lag(category) OVER w AS pc FROM ss WINDOW w AS (PARTITION BY person_id ORDER BY us, event_id))
        SELECT person_id, count(*) AS boundaries, count(*) FILTER (WHERE pc = category) AS absorbed FROM x WHERE ps <> session_no GROUP BY 1""",
    "next_session_floors": f"""WITH sp AS ({_FIRST['session_shape']}), x AS (SELECT person_id, primary_category AS a, lead(primary_category) OVER (PARTITION BY person_id ORDER BY session_no) AS b FROM sp), y AS (SELECT * FROM x WHERE b IS NOT NULL),
        m AS (SELECT person_id, max(k) AS k FROM (SELECT person_id, b, count(*) AS k FROM y GROUP BY 1, 2) GROUP BY 1) SELECT person_id, count(*) AS n, {_r('avg((a = b)::INT)', 'same_rate')}, {_r('any_value(k) / count(*)', 'mode_rate')} FROM y JOIN m USING (person_id) GROUP BY 1""",
    "label_volume_session": _BY_SESSION,
    "label_definitions": " UNION ALL ".join([*(_definition(f"{h}h", _bucketed(h)) for h in (3, 6, 12, 24)), _definition("session", _BY_SESSION)]),
    "proxy_categories": f"WITH {_PROXY} SELECT e.person_id, CASE WHEN place <= 5 THEN e.domain ELSE 'other' END AS category, count(*) AS n FROM ev e LEFT JOIN dn ON dn.person_id = e.person_id AND dn.domain = e.domain GROUP BY 1, 2",
    "counterfactual_labels": f"(WITH {_LB} SELECT 'as_is' AS way, count(*) AS n, {_r('avg(outcome::INT)', 'rate')} FROM lb) UNION ALL {_relabel('separate')} UNION ALL {_relabel('merged')}",
    "unknown_domains": f"WITH {_URL} SELECT domain, count(*) AS n FROM cd WHERE rule IS NULL AND domain IS NOT NULL GROUP BY 1",
    "dwell_histogram": f"""WITH {_EV}, e AS (SELECT category, min(dwell) AS lo, max(dwell) AS hi FROM ev GROUP BY 1), b AS (SELECT category, CASE WHEN hi = lo THEN 0 ELSE least(floor((dwell - lo) / ((hi - lo) / 20)), 19) END::INT AS bin FROM ev JOIN e USING (category) WHERE dwell IS NOT NULL)
        SELECT category, bin, count(*) AS n FROM b GROUP BY 1, 2""",
    "feature_null_shares": f"""WITH fs AS ({_FS3}) SELECT feature, {_r('share', 'share')} FROM (UNPIVOT (SELECT avg(("hoursSinceLastSeen" IS NULL)::INT) AS "hoursSinceLastSeen", avg(("firstSeenSaturation" IS NULL)::INT) AS "firstSeenSaturation",
        {', '.join(f'avg(("{c}" IS NULL)::INT) AS "{c}"' for c in ('eventCount7d', 'eventCount30d', 'daysSeen7d', 'sessionCount7d', 'categoryShare30d', 'priorReturnRate', 'priorSessionRate', 'sessionEventCount', 'sessionCategoryCount', 'categoryEventsInSession', 'hourOfDay', 'dayOfWeek'))} FROM fs)
        ON COLUMNS(*) INTO NAME feature VALUE share)""",
    "domain_shift": f"""WITH {_EV}, e AS (SELECT person_id, min(us) AS lo, max(us) AS hi FROM ev GROUP BY 1), n AS (SELECT person_id, domain, count(*) FILTER (WHERE us - lo <= hi - us) AS a, count(*) FILTER (WHERE us - lo > hi - us) AS b FROM ev JOIN e USING (person_id) WHERE domain IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT *, coalesce(a / nullif(sum(a) OVER (PARTITION BY person_id), 0), 0) AS x, coalesce(b / nullif(sum(b) OVER (PARTITION BY person_id), 0), 0) AS y FROM n)
        SELECT person_id, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared, count(*) FILTER (WHERE a > 0 AND b = 0) AS lost, count(*) FILTER (WHERE a = 0 AND b > 0) AS fresh, {_r('sum(abs(x - y))', 'distance')} FROM s GROUP BY 1""",
    "latest_events": f"WITH {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY us DESC, event_id DESC) AS place FROM ev) SELECT person_id, event_id, us, category, place FROM k WHERE place <= 5",
    "fresh_predictions": f"WITH {_RES} SELECT person_id, category, start_us, end_us FROM res WHERE outcome NOT IN ('hit', 'miss')",
    "rule_summary": f"""WITH {_SS}, ru AS ({_FIRST['association_rules']}), st AS (SELECT person_id, session_no, category FROM ss GROUP BY ALL), mu AS (SELECT person_id, session_no FROM st GROUP BY 1, 2 HAVING count(*) >= 2),
        b AS (SELECT person_id, count(*) AS n_rules, max(lift) AS best_lift FROM ru GROUP BY 1), c AS (SELECT st.person_id, count(DISTINCT session_no) AS covered FROM st JOIN mu USING (person_id, session_no) JOIN (SELECT DISTINCT person_id, antecedent FROM ru) a
        ON a.person_id = st.person_id AND a.antecedent = st.category GROUP BY 1) SELECT b.person_id, n_rules, best_lift, coalesce(covered, 0) AS covered FROM b LEFT JOIN c USING (person_id)""",
}


ORACLES["gap_valley"] = f"""WITH {_EV}, g AS (SELECT person_id, (us - lag(us) OVER (PARTITION BY person_id ORDER BY us, event_id)) / 1000000.0::DOUBLE AS gap FROM ev),
l AS (SELECT person_id, log10(gap) AS x FROM g WHERE gap > 0), b AS (SELECT person_id, count(*) AS n, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
w AS (SELECT *, (hi - lo) / 40 AS width FROM b WHERE n >= 20 AND hi - lo >= 0.5),
k AS (SELECT person_id, least(CAST(floor((x - lo) / width) AS INT), 39) AS i, count(*) AS c FROM l JOIN w USING (person_id) GROUP BY 1, 2),
f AS (SELECT e.person_id, e.i, coalesce(c, 0) AS c FROM (SELECT person_id, unnest(range(40))::INT AS i FROM w) e LEFT JOIN k ON k.person_id = e.person_id AND k.i = e.i),
s AS (SELECT person_id, i, coalesce(lag(c) OVER v, c) + c + coalesce(lead(c) OVER v, c) AS s FROM f WINDOW v AS (PARTITION BY person_id ORDER BY i)),
p AS (SELECT person_id, arg_min(i, (-s, i)) AS a, max(s) AS sa FROM s GROUP BY 1),
q AS (SELECT person_id, any_value(a) AS a, any_value(sa) AS sa, arg_min(i, (-s, i)) AS z, max(s) AS sz FROM s JOIN p USING (person_id) WHERE abs(i - a) >= 5 GROUP BY 1),
m AS (SELECT person_id, i, s, sa, sz, min(s) OVER (PARTITION BY person_id) AS depth FROM s JOIN q USING (person_id) WHERE i BETWEEN least(a, z) AND greatest(a, z)),
t AS (SELECT person_id, any_value(depth) AS depth, any_value(sa) AS sa, any_value(sz) AS sz, list(i ORDER BY i) AS tied FROM m WHERE s = depth GROUP BY 1)
SELECT b.person_id, n AS n_gaps, CASE WHEN 2 * depth < least(sa, sz) THEN round(pow(10.0::DOUBLE, lo + (tied[len(tied) // 2 + 1] + 0.5::DOUBLE) * ((hi - lo) / 40)), 6) + 0.0 END AS valley_seconds
FROM b LEFT JOIN t USING (person_id)"""
_HALF = f"""WITH {_EV}, mi AS (SELECT person_id, (min(us) + max(us)) // 2 AS middle FROM ev GROUP BY 1), h AS (SELECT person_id, domain, us <= middle AS early FROM ev JOIN mi USING (person_id) WHERE domain IS NOT NULL)
SELECT person_id, domain FROM h WHERE early %s SELECT person_id, domain FROM h WHERE NOT early"""
ORACLES["kept_domains"] = _HALF % "INTERSECT"
ORACLES["dropped_domains"] = _HALF % "EXCEPT"
_RATE = _sat("(np / greatest(coalesce(hf / 24, 0), 1))", 1.0)
ORACLES["excursion_share"] = _folds(
    _FS3[: _FS3.index("\nSELECT person_id, category")] + f""", lab AS (SELECT person_id, category, window_end, hl, n30::DOUBLE AS n30, {_RATE} AS rate FROM f)""", "window_end, category"
) + """, u AS (SELECT person_id, fold, unnest(['hoursSinceLastSeen', 'eventCount30d', 'priorSessionRate']) AS feature, unnest([hl, n30, rate]) AS x FROM fo),
r AS (SELECT t.person_id, t.feature, t.fold, min(x.x) AS lo, max(x.x) AS hi FROM (SELECT DISTINCT person_id, feature, fold FROM u WHERE fold > 0) t
    JOIN u x ON x.person_id = t.person_id AND x.feature = t.feature AND x.fold < t.fold GROUP BY 1, 2, 3)
SELECT fold, feature, count(*) AS n, count(*) FILTER (greatest(lo - x, x - hi) > 0) AS outside, round(max(greatest(lo - x, x - hi, 0) / nullif(hi - lo, 0)), 6) + 0.0 AS widest
FROM u JOIN r USING (person_id, feature, fold) WHERE x IS NOT NULL AND lo IS NOT NULL GROUP BY 1, 2"""

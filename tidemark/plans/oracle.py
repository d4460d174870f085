"""SQL that the registered queries must agree with, written independently of them."""

from __future__ import annotations

from tidemark.functions.columns import RULES, SUFFIXES

_EV = """ev AS (SELECT user_id AS person_id, event_id, epoch_us(ts) AS us, event_type AS category, json_extract_string(props, '$.k') AS domain, value AS dwell FROM events)"""
_SS = _EV + """, g AS (SELECT *, us - lag(us) OVER (PARTITION BY person_id ORDER BY us, event_id) AS gap FROM ev),
s0 AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY us, event_id) AS BIGINT) AS session_no FROM g),
ss AS (SELECT *, min(us) OVER (PARTITION BY person_id, session_no) AS session_start FROM s0)"""
_LB = _SS + """, e AS (SELECT *, max(us) OVER (PARTITION BY person_id, session_no) AS window_end, count(*) OVER (PARTITION BY person_id, session_no) AS n_session FROM ss),
p AS (SELECT person_id, session_no, category, any_value(window_end) AS window_end, min(us) AS first_us, count(*) AS n_in, any_value(n_session) AS n_session FROM e GROUP BY 1, 2, 3),
lb AS (SELECT *, count(*) OVER (PARTITION BY person_id, session_no) AS n_categories,
    coalesce((SELECT min(x.us) FROM ev x WHERE x.person_id = p.person_id AND x.category = p.category AND x.us > p.window_end) <= window_end + 86400000000, false) AS outcome FROM p)"""
_TR = _SS + """, c AS (SELECT *, CASE WHEN lag(category) OVER w = category THEN 0 ELSE 1 END AS change FROM ss WINDOW w AS (PARTITION BY person_id ORDER BY us, event_id)),
r0 AS (SELECT *, sum(change) OVER (PARTITION BY person_id ORDER BY us, event_id) AS run FROM c),
r AS (SELECT person_id, run, any_value(category) AS category, count(*) AS n, arg_min(event_id, us) AS event_id, min(us) AS us, min(session_no) AS fs, max(session_no) AS ls FROM r0 GROUP BY 1, 2),
tr AS (SELECT * FROM (SELECT person_id, event_id, lag(category) OVER w AS from_category, category AS to_category, lag(category, 2) OVER w AS previous_category,
    lag(n) OVER w AS from_run_events, lag(ls) OVER w = fs AS within_session, fs AS session_no FROM r WINDOW w AS (PARTITION BY person_id ORDER BY run)) WHERE from_category IS NOT NULL)"""
_TT = _TR + """, n AS (SELECT person_id, from_category, to_category, count(*) AS n FROM tr GROUP BY 1, 2, 3), m AS (SELECT person_id, to_category, count(*) AS m FROM tr GROUP BY 1, 2),
tot AS (SELECT person_id, sum(m) AS t FROM m GROUP BY 1), f AS (SELECT DISTINCT person_id, from_category FROM tr),
tt AS (SELECT person_id, from_category, to_category, coalesce(n, 0) AS n,
    round((coalesce(n, 0) + m / t) / (sum(coalesce(n, 0)) OVER (PARTITION BY person_id, from_category) + 1.0), 6) + 0.0 AS p FROM f JOIN m USING (person_id) JOIN tot USING (person_id) LEFT JOIN n USING (person_id, from_category, to_category))"""
_GRID = _EV + """, d AS (SELECT person_id, us // 86400000000 AS day, category, count(*) AS n FROM ev GROUP BY 1, 2, 3), sp AS (SELECT person_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
cells AS (SELECT sp.person_id, lo, unnest(generate_series(lo + 1, hi - 1)) AS day FROM sp WHERE hi - lo >= 2), cat AS (SELECT DISTINCT person_id, category FROM d),
grid AS (SELECT person_id, category, day, day - lo AS rn, coalesce(n, 0) AS n FROM cells JOIN cat USING (person_id) LEFT JOIN d USING (person_id, day, category))"""
_FOLD = _LB + """, q AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY window_end, category) AS rn, count(*) OVER (PARTITION BY person_id) AS nl FROM lb),
q2 AS (SELECT *, greatest(CAST(floor(nl * 0.4) AS BIGINT), 5) AS st FROM q WHERE nl >= 20), q3 AS (SELECT *, (nl - st) // 5 AS ch FROM q2),
fo AS (SELECT *, CASE WHEN rn <= st THEN 0 ELSE least((rn - st - 1) // ch + 1, 5) END AS fold FROM q3), fold AS (SELECT *, CASE WHEN fold > 0 THEN st + (fold - 1) * ch END AS train_stop FROM fo)"""
_PRED = _FOLD + """, y AS (SELECT person_id, category, session_no, rn, fold, train_stop, CASE WHEN outcome THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM fold),
cum AS (SELECT person_id, fold, sum(sum(y)) OVER w AS pos, sum(count(*)) OVER w AS n FROM y GROUP BY 1, 2 WINDOW w AS (PARTITION BY person_id ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
te AS (SELECT t.*, cum.pos / cum.n AS base_rate, (SELECT coalesce(sum(x.y), 0) FROM y x WHERE x.person_id = t.person_id AND x.category = t.category AND x.fold < t.fold) AS cp,
    (SELECT count(*) FROM y x WHERE x.person_id = t.person_id AND x.category = t.category AND x.fold < t.fold) AS cn FROM y t JOIN cum USING (person_id, fold) WHERE fold > 0),
pr AS (SELECT person_id, category, session_no, fold, y, 'base_rate' AS model, base_rate AS p FROM te UNION ALL SELECT person_id, category, session_no, fold, y, 'category_rate', (cp + 5 * base_rate) / (cn + 5) FROM te)"""
_REL = _PRED + """, b AS (SELECT model, list_sum(list_transform(range(1, 10), lambda k: CASE WHEN p >= k / 10.0::DOUBLE THEN 1 ELSE 0 END))::INTEGER AS bin, p, y FROM pr),
rel AS (SELECT m.model, m.bin, count(p) AS n, avg(p) AS mean_p, avg(y) AS rate FROM (SELECT model, unnest(range(0, 10))::INTEGER AS bin FROM (SELECT DISTINCT model FROM pr)) m LEFT JOIN b ON b.model = m.model AND b.bin = m.bin GROUP BY 1, 2)"""
_JAC = _SS + """, mem AS (SELECT DISTINCT person_id, session_no, domain FROM ss WHERE domain IS NOT NULL), sz AS (SELECT person_id, domain, count(*) AS n FROM mem GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT mem.*, n FROM mem JOIN sz USING (person_id, domain)), jac AS (SELECT x.person_id, x.domain AS a, y.domain AS b, count(*) AS shared, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard
    FROM k x JOIN k y ON x.person_id = y.person_id AND x.session_no = y.session_no AND x.domain < y.domain GROUP BY 1, 2, 3 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.4)"""
_RULE_CASE = "CASE " + " ".join(f"WHEN {'ends_with' if k == 'suffix' else 'contains'}(domain, '{v}') THEN '{c}'" for k, v, c in RULES) + " END"
_URL = f"""u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#\\\\]*)', 1)), '^.*@', '') AS h FROM pages),
v AS (SELECT page_id, regexp_replace(regexp_replace(h, ':[0-9]*$', ''), '\\.+$', '') AS n FROM u), w AS (SELECT page_id, n, string_split(n, '.') AS l FROM v),
dm AS (SELECT page_id, CASE WHEN n = 'localhost' OR ends_with(n, '.localhost') OR regexp_full_match(n, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') OR contains(n, ':') OR starts_with(n, '[') OR len(l) < 2 OR list_contains(l, '') THEN NULL
    WHEN array_to_string(l[-2:], '.') NOT IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) THEN array_to_string(l[-2:], '.') WHEN len(l) >= 3 THEN array_to_string(l[-3:], '.') END AS domain FROM w),
cd AS (SELECT *, {_RULE_CASE} AS rule FROM dm)"""
_RES = _LB.replace("WITH ", "") + """, z AS (SELECT max(us) AS now FROM ev), pq AS (SELECT person_id, category, window_end AS start_us, window_end + 86400000000 AS end_us FROM lb),
sw AS (SELECT person_id, us, category <> 'view' AS o, lag(category <> 'view') OVER (PARTITION BY person_id ORDER BY us, event_id) AS b FROM ev),
gp AS (SELECT person_id, us AS from_us, coalesce((SELECT min(x.us) FROM sw x WHERE x.person_id = sw.person_id AND x.us > sw.us AND x.o), (SELECT now FROM z)) AS to_us FROM sw WHERE NOT o AND coalesce(b, true)),
res AS (SELECT pq.*, CASE WHEN EXISTS (SELECT 1 FROM gp WHERE gp.person_id = pq.person_id AND from_us < end_us AND to_us > start_us) THEN 'expired'
    WHEN (SELECT min(us) FROM ev x WHERE x.person_id = pq.person_id) > start_us THEN 'expired'
    WHEN EXISTS (SELECT 1 FROM ev x WHERE x.person_id = pq.person_id AND x.category = pq.category AND x.us > start_us AND x.us <= end_us) THEN 'hit'
    WHEN end_us >= now THEN 'pending' ELSE 'miss' END AS outcome FROM pq, z)"""


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _sat(x: str, scale: float) -> str:
    return f"({x})::DOUBLE / (({x}) + {scale}::DOUBLE)"


def _rules(sets: str, group: str, confidence: float, lift: float) -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON true"
    both = f"{g}a AS antecedent, b AS consequent, support FROM pp UNION ALL SELECT {g}b, a, support FROM pp"
    return f"""{sets}, it AS (SELECT {g}item, count(*) AS n FROM (SELECT {g}unnest(items) AS item FROM sets) GROUP BY ALL), nn AS (SELECT {g}count(*) AS n_sets FROM sets GROUP BY ALL),
pp AS (SELECT {g}a, b, count(*) AS support FROM (SELECT {g}unnest(items) AS a, items FROM sets) s, LATERAL (SELECT unnest(s.items) AS b) WHERE a < b GROUP BY ALL HAVING count(*) >= 5), dd AS (SELECT {both})
SELECT {g.replace('person_id', 'dd.person_id')}antecedent, consequent, support, x.n AS n_antecedent, y.n AS n_consequent, round(support / x.n, 6) + 0.0 AS confidence, round(support / x.n * n_sets / y.n, 6) + 0.0 AS lift
FROM dd JOIN it x ON x.item = antecedent {'AND x.person_id = dd.person_id' if group else ''} JOIN it y ON y.item = consequent {'AND y.person_id = dd.person_id' if group else ''} JOIN nn {'ON nn.person_id = dd.person_id' if group else on}
WHERE support / x.n >= {confidence} AND support / x.n * n_sets / y.n >= {lift}"""


_A = "PARTITION BY person_id, category"
_ENGAGED = f"""WITH {_SS}, v AS (SELECT *, row_number() OVER w AS n, us // 86400000000 AS day, lag(category) OVER w AS pc, lag(domain) OVER w AS pd, lag(dwell) OVER w AS pw FROM ss WINDOW w AS (PARTITION BY person_id ORDER BY us, event_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY person_id, session_no ORDER BY n) - 1 AS pos, row_number() OVER (PARTITION BY person_id, domain ORDER BY n) - 1 AS dv,
    count(*) OVER (PARTITION BY person_id, domain ORDER BY n RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS dr FROM v),
z AS (SELECT *, array_agg(dwell) OVER ({_A} ORDER BY n ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS win, array_agg(dwell) OVER (PARTITION BY person_id, domain ORDER BY n ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS dwin,
    (SELECT count(DISTINCT o.day) FROM v o WHERE o.person_id = x.person_id AND o.domain = x.domain AND o.n < x.n AND o.day BETWEEN x.day - 6 AND x.day) AS dd FROM x),
t AS (SELECT *, list_median(win) AS th FROM z WHERE len(win) >= 10)
SELECT person_id, event_id, category, session_no, us AS window_end, dwell > th AS outcome, {_r(_sat('th', 30.0), '"dwellLevel"')}, {_r('win[-1] / (th + 1)', '"lastDwellRatio"')}, {_r('list_avg(win) / (th + 1)', '"meanRatio"')},
{_r(_sat('pos', 10.0), '"sessionPosition"')}, (pos = 0)::INT::DOUBLE AS "isSessionStart", coalesce(pc = category, false)::INT::DOUBLE AS "sameAsPrevious",
{_r('sin(2 * pi() * ((us // 3600000000) % 24) / 24)', '"hourSin"')}, {_r('cos(2 * pi() * ((us // 3600000000) % 24) / 24)', '"hourCos"')}, ((day + 3) % 7 >= 5)::INT::DOUBLE AS "isWeekend",
{_r(_sat('dv', 20.0), '"domainVisits"')}, {_r('dr / least(n - 1, 100)', '"domainShare"')}, (dd >= 4)::INT::DOUBLE AS "isDailyDomain",
{_r(_sat('list_median(dwin)', 30.0), '"domainDwellLevel"')}, coalesce(pd = domain, false)::INT::DOUBLE AS "prevSameDomain", {_r('pw / (th + 1)', '"prevDwellRatio"')} FROM t"""
_IN = "FROM ev x WHERE x.person_id = lb.person_id AND x.category = lb.category AND x.us < lb.window_end"
_WEEK, _MONTH = " AND x.us >= lb.window_end - 604800000000", " AND x.us >= lb.window_end - 2592000000000"
_PRIOR = "FROM lb o WHERE o.person_id = lb.person_id AND o.category = lb.category AND o.window_end <= lb.window_end - 86400000000"
_FS3 = f"""WITH {_LB}, f AS (SELECT lb.*, (lb.window_end - (SELECT max(x.us) {_IN})) / 3600000000.0::DOUBLE AS hl, (lb.window_end - (SELECT min(x.us) {_IN})) / 3600000000.0::DOUBLE AS hf,
    (SELECT count(*) {_IN}{_WEEK}) AS n7, (SELECT count(*) {_IN}{_MONTH}) AS n30, (SELECT count(DISTINCT x.us // 86400000000) {_IN}{_WEEK}) AS d7,
    (SELECT count(DISTINCT x.session_no) FROM ss x WHERE x.person_id = lb.person_id AND x.category = lb.category AND x.us < lb.window_end{_WEEK}) AS s7,
    (SELECT count(*) FROM ev x WHERE x.person_id = lb.person_id AND x.us < lb.window_end{_MONTH}) AS a30, (SELECT count(*) {_PRIOR}) AS np,
    (SELECT count(*) {_PRIOR} AND o.outcome AND (SELECT min(x.us) FROM ev x WHERE x.person_id = o.person_id AND x.category = o.category AND x.us > o.window_end) < lb.window_end) AS nr FROM lb)
SELECT person_id, category, session_no, window_end, outcome, {_r('hl', '"hoursSinceLastSeen"')}, {_r(_sat('hf', 168.0), '"firstSeenSaturation"')}, n7::DOUBLE AS "eventCount7d", n30::DOUBLE AS "eventCount30d", d7::DOUBLE AS "daysSeen7d",
s7::DOUBLE AS "sessionCount7d", {_r('n30 / nullif(a30, 0)', '"categoryShare30d"')}, {_r('nr / nullif(np, 0)', '"priorReturnRate"')}, {_r(_sat('(np / greatest(coalesce(hf / 24, 0), 1))', 1.0), '"priorSessionRate"')},
n_session::DOUBLE AS "sessionEventCount", n_categories::DOUBLE AS "sessionCategoryCount", n_in::DOUBLE AS "categoryEventsInSession", ((window_end // 3600000000) % 24)::DOUBLE AS "hourOfDay", ((window_end // 86400000000 + 3) % 7)::DOUBLE AS "dayOfWeek" FROM f"""
_FS2 = _FS3.replace(_r(_sat("hf", 168.0), '"firstSeenSaturation"'), _r("hf", '"hoursSinceFirstSeen"')).replace(
    _r(_sat("(np / greatest(coalesce(hf / 24, 0), 1))", 1.0), '"priorSessionRate"'), 'np::DOUBLE AS "priorSessionCount"'
)
_HOURS = f"""WITH {_EV}, h AS (SELECT person_id, us // 3600000000 AS hour, count(*) AS n, max(us) AS lu FROM ev GROUP BY 1, 2), sp AS (SELECT person_id, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY 1),
gr AS (SELECT person_id, lo, hi, hour, n, lu, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS act FROM (SELECT person_id, lo, hi, unnest(generate_series(lo, hi)) AS hour FROM sp) LEFT JOIN h USING (person_id, hour)),
f AS (SELECT *, max(lu) OVER (PARTITION BY person_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, coalesce(lag(n) OVER (PARTITION BY person_id ORDER BY hour), 0) AS n1,
    coalesce(sum(n) OVER (PARTITION BY person_id ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS n6, avg(act) OVER (PARTITION BY person_id ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS s168,
    (SELECT avg(o.act) FROM gr o WHERE o.person_id = gr.person_id AND o.hour < gr.hour AND o.hour >= gr.hour - 168 AND (gr.hour - o.hour) % 24 = 0) AS same FROM gr)
SELECT person_id, hour, act = 1 AS outcome, {_r('sin(2 * pi() * (hour % 24) / 24)', '"hourSin"')}, {_r('cos(2 * pi() * (hour % 24) / 24)', '"hourCos"')}, ((hour // 24 + 3) % 7 >= 5)::INT::DOUBLE AS "isWeekend",
{_r(_sat('(hour * 3600000000 - last) / 60000000.0::DOUBLE', 60.0), '"minutesSinceLast"')}, {_r(_sat('n1', 5.0), '"visitsLastHour"')}, {_r(_sat('n6', 30.0), '"visitsLastSixHours"')}, {_r('same', '"sameHourRate7d"')}, {_r('s168', '"activeHourShare7d"')} FROM f WHERE hour > lo AND hour < hi"""
_BLOCK = f"""WITH {_GRID}, b AS (SELECT *, sum(n) OVER (PARTITION BY person_id, rn) AS total, sum(n) OVER ({_A} ORDER BY rn) > 0 AS begun FROM grid),
w AS (SELECT *, array_agg(n) OVER (wc ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win, array_agg(total) OVER (wc ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS tw, row_number() OVER wc AS k, lag(n) OVER wc AS prev, lag(total) OVER wc AS pt FROM b WHERE begun WINDOW wc AS ({_A} ORDER BY rn)),
t AS (SELECT *, list_median(win) AS th FROM w), a AS (SELECT *, n > th AS above FROM t),
s AS (SELECT *, lag(above) OVER wc AS pa, max(CASE WHEN NOT coalesce(above, false) THEN k END) OVER (wc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln, max(CASE WHEN above THEN k END) OVER (wc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la,
    len(list_filter(win, lambda x: x > 0)) AS ac FROM a WINDOW wc AS ({_A} ORDER BY rn))
SELECT person_id, category, day, above AS outcome, coalesce(pa, false)::INT::DOUBLE AS "prevAbove", {_r('prev / (th + 1)', '"lastRatio"')}, {_r(_sat('(k - 1 - coalesce(ln, 0))', 3.0), '"streakAbove"')}, {_r(_sat('(k - 1 - la)', 3.0), '"daysSinceAbove"')},
{_r(_sat('th', 5.0), '"medianLevel"')}, {_r('ac / len(win)', '"activeRate10"')}, {_r('coalesce(list_sum(win) / nullif(list_sum(tw), 0), 0)', '"topicShare10"')}, {_r('pt / (list_median(tw) + 1)', '"totalRatio"')},
{_r('sin(2 * pi() * ((day + 3) % 7) / 7)', '"dayOfWeekSin"')}, {_r('cos(2 * pi() * ((day + 3) % 7) / 7)', '"dayOfWeekCos"')} FROM s WHERE k > 6 AND 2 * ac >= len(win)"""
_TOPS = ", ".join(f"round(sum(CASE WHEN place <= {k} THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS top{k}" for k in (1, 3, 5, 10, 20))
_RANKED = _EV + """, dn AS (SELECT person_id, domain, count(*) AS n FROM ev WHERE domain IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER w AS place, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY person_id) AS cs FROM dn WINDOW w AS (PARTITION BY person_id ORDER BY n DESC, domain))"""

_TOPK = _TR + """, x AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY tr.us) AS rn, count(*) OVER (PARTITION BY person_id) AS t FROM (SELECT tr.*, r.us FROM tr JOIN r USING (person_id, event_id)) tr),
tn AS (SELECT * FROM x WHERE rn <= floor(t * 0.6)), o0 AS (SELECT person_id, to_category, count(*) AS m FROM tn GROUP BY 1, 2),
o AS (SELECT person_id, list(to_category ORDER BY m DESC, to_category) AS rk, sum(m) AS al FROM o0 GROUP BY 1),
sy0 AS (SELECT f.person_id, f.from_category, o0.to_category, m, al, (SELECT count(*) FROM tn WHERE tn.person_id = f.person_id AND tn.from_category = f.from_category AND tn.to_category = o0.to_category) AS n
    FROM (SELECT DISTINCT person_id, from_category FROM tn) f JOIN o0 USING (person_id) JOIN o USING (person_id)),
s AS (SELECT person_id, from_category, list(to_category ORDER BY n * al + m DESC, to_category) AS rs FROM sy0 GROUP BY 1, 2),
j AS (SELECT x.*, rk, coalesce(rs, rk) AS rs FROM x JOIN o USING (person_id) LEFT JOIN s USING (person_id, from_category) WHERE rn > floor(t * 0.6))"""


def _volume(bucket: int) -> str:
    return f"""WITH {_EV}, b AS (SELECT DISTINCT person_id, category, us // {bucket} AS bucket FROM ev), o AS (SELECT *, coalesce((SELECT min(x.us) FROM ev x WHERE x.person_id = b.person_id AND x.category = b.category
        AND x.us >= (b.bucket + 1) * {bucket}) <= (b.bucket + 1) * {bucket} + 86400000000, false) AS y FROM b) SELECT person_id, count(*) AS n_labels, count(*) FILTER (WHERE y) AS n_positive FROM o GROUP BY 1"""


ORACLES = {
    "redirect_confusion": f"""WITH {_SS}, t AS (SELECT unnest([1, 2, 4, 8, 12, 24, 48]) * 3600000000 AS threshold_us), c AS (SELECT threshold_us, count(*) FILTER (WHERE gap <= threshold_us AND dwell < 10) AS tp, count(*) FILTER (WHERE gap <= threshold_us AND NOT dwell < 10) AS fp,
        count(*) FILTER (WHERE gap > threshold_us AND dwell < 10) AS fn FROM ss, t WHERE gap IS NOT NULL GROUP BY 1) SELECT *, {_r('tp / nullif(tp + fp, 0)', 'precision')}, {_r('tp / nullif(tp + fn, 0)', 'recall')}, {_r('2 * tp / nullif(2 * tp + fp + fn, 0)', 'f1')} FROM c""",
    "engagement_gate": f"""WITH {_SS}, v AS (SELECT *, count(dwell) OVER ({_A} ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ss WHERE dwell IS NOT NULL), d AS (SELECT person_id, count(*) AS n_dwelled FROM ev WHERE dwell IS NOT NULL GROUP BY 1),
        m AS (SELECT person_id, count(DISTINCT session_no) AS n_sessions, count(*) AS n_labels FROM v WHERE before >= 10 GROUP BY 1) SELECT person_id, n_dwelled, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_labels, 0) AS n_labels,
        n_dwelled >= 60 AND coalesce(n_sessions, 0) >= 15 AND coalesce(n_labels, 0) >= 20 AS passed FROM d LEFT JOIN m USING (person_id)""",
    "label_volume_day": _volume(86_400_000_000),
    "label_volume_window": _volume(21_600_000_000),
    "spearman_dwell": f"""WITH {_EV}, p AS (SELECT category, person_id, count(*) AS n, avg(dwell) AS d FROM ev GROUP BY 1, 2), k AS (SELECT category, rank() OVER (PARTITION BY category ORDER BY n) + (count(*) OVER (PARTITION BY category, n) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY category ORDER BY d) + (count(*) OVER (PARTITION BY category, d) - 1) / 2 AS ry FROM p) SELECT category, count(*) AS n, {_r('corr(rx, ry)', 'rho')} FROM k GROUP BY 1""",
    "top_k_accuracy": f"""WITH {_TOPK} SELECT person_id, count(*) AS n, {_r('avg((rk[1] = to_category)::INT)', 'mode_top1')}, {_r('avg(list_contains(rk[1:2], to_category)::INT)', 'mode_topk')},
        {_r('avg((rs[1] = to_category)::INT)', 'table_top1')}, {_r('avg(list_contains(rs[1:2], to_category)::INT)', 'table_topk')} FROM j GROUP BY 1""",
    "retention_split": f"WITH {_EV}, m AS (SELECT max(us) - 14 * 86400000000 AS cut FROM ev) SELECT person_id, count(*) FILTER (WHERE us >= cut) AS kept, count(*) FILTER (WHERE us < cut) AS deleted FROM ev, m GROUP BY 1",
    "coverage_gaps": f"""WITH {_EV}, a AS (SELECT person_id, us, category <> 'view' AS o, lag(category <> 'view') OVER (PARTITION BY person_id ORDER BY us, event_id) AS b FROM ev)
        SELECT person_id, us AS from_us, (SELECT min(x.us) FROM a x WHERE x.person_id = a.person_id AND x.us > a.us AND x.o) AS to_us FROM a WHERE NOT o AND coalesce(b, true)""",
    "session_boundaries": f"WITH {_SS} SELECT person_id, event_id, session_no, session_start FROM ss",
    "session_shape": f"""WITH {_SS}, c AS (SELECT person_id, session_no, category, count(*) AS n FROM ss GROUP BY 1, 2, 3), h AS (SELECT person_id, session_no, count(*) AS k, arg_min(category, (-n, category)) AS pc,
        -sum(n / t * ln(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY person_id, session_no) AS t FROM c) GROUP BY 1, 2),
        a AS (SELECT person_id, session_no, count(*) AS n, count(DISTINCT domain) AS d, (max(us) - min(us)) / 1e6 AS dur FROM ss GROUP BY 1, 2)
        SELECT person_id, session_no, n AS n_events, k AS n_categories, d AS n_domains, round(dur, 6) + 0.0 AS duration_seconds, pc AS primary_category, {_r(_sat('n', 20.0), '"visitLevel"')}, {_r(_sat('d', 8.0), '"domainLevel"')},
        {_r(_sat('dur / 60', 15.0), '"durationLevel"')}, {_r('1 - d / n', '"repeatRate"')}, {_r('CASE WHEN k < 2 THEN 0 ELSE h / ln(k) END', 'evenness')} FROM a JOIN h USING (person_id, session_no)""",
    "return_labels": f"WITH {_LB} SELECT person_id, category, session_no, window_end, outcome FROM lb",
    "feature_vector_fs3": _FS3,
    "migrated_features": _FS3,
    "feature_vector_fs2": _FS2,
    "category_base_rate": f"WITH {_LB} SELECT category, count(*) AS n, {_r('avg(outcome::INT)', 'rate')} FROM lb GROUP BY 1",
    "visit_engaged": _ENGAGED,
    "browsing_next_hour": _HOURS,
    "calendar_blocks": f"WITH {_GRID} SELECT person_id, category, day, n FROM grid",
    "block_volume": _BLOCK,
    "novelty": f"""WITH {_EV}, v AS (SELECT person_id, domain, us, us // 86400000000 AS day FROM ev WHERE domain IS NOT NULL), f AS (SELECT person_id, day, min(us) AS fa FROM v GROUP BY 1, 2),
        jd AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM v x WHERE x.person_id = f.person_id AND x.us < fa AND x.us >= fa - 7 * 86400000000)),
        nv AS (SELECT jd.person_id, jd.day, count(*) AS n_domains, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.person_id = d.person_id AND x.domain = d.domain AND x.us < fa AND x.us >= fa - 7 * 86400000000)) AS n_new
            FROM jd JOIN (SELECT DISTINCT person_id, domain, day FROM v) d ON d.person_id = jd.person_id AND d.day = jd.day GROUP BY 1, 2) SELECT * FROM nv""",
    "novelty_summary": f"""WITH {_EV}, v AS (SELECT person_id, domain, us, us // 86400000000 AS day FROM ev WHERE domain IS NOT NULL), f AS (SELECT person_id, day, min(us) AS fa FROM v GROUP BY 1, 2),
        jd AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM v x WHERE x.person_id = f.person_id AND x.us < fa AND x.us >= fa - 7 * 86400000000)),
        nv AS (SELECT jd.person_id, jd.day, count(*) AS n_domains, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.person_id = d.person_id AND x.domain = d.domain AND x.us < fa AND x.us >= fa - 7 * 86400000000)) AS n_new
            FROM jd JOIN (SELECT DISTINCT person_id, domain, day FROM v) d ON d.person_id = jd.person_id AND d.day = jd.day GROUP BY 1, 2) SELECT person_id, count(*) AS labels, round(avg((n_new > 0)::INT), 6) + 0.0 AS base_rate, round(avg(n_new), 6) + 0.0 AS mean_new_domains FROM nv GROUP BY 1""",
    "dormancy": f"""WITH {_GRID}, q AS (SELECT *, sum(n) OVER ({_A} ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS quiet, sum(n) OVER ({_A} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM grid)
        SELECT person_id, count(*) AS n_dormant, count(*) FILTER (WHERE n > 0) AS n_returned FROM q WHERE quiet = 0 AND ever > 0 GROUP BY 1""",
    "category_transitions": f"WITH {_TR} SELECT * FROM tr",
    "transition_table": f"WITH {_TT} SELECT person_id, from_category, to_category, n, p FROM tt",
    "next_category_ranking": f"""WITH {_TT}, k AS (SELECT *, row_number() OVER (PARTITION BY person_id, from_category ORDER BY p DESC, to_category) AS place FROM tt)
        SELECT person_id, from_category, string_agg(to_category, ',' ORDER BY place) AS ranking FROM k WHERE place <= 3 GROUP BY 1, 2""",
    "gap_percentiles": f"WITH {_SS} SELECT person_id, count(*) AS n_gaps, {', '.join(_r(f'quantile_cont(gap / 1e6, {p})', f'p{int(100 * p)}', 3) for p in (0.1, 0.5, 0.9))} FROM ss WHERE gap IS NOT NULL GROUP BY 1",
    "gap_histogram": f"WITH {_SS} SELECT person_id, CAST(floor(log10(gap / 1e6) * 4) AS BIGINT) AS bin, count(*) AS n FROM ss WHERE gap > 0 GROUP BY 1, 2",
    "visits_per_day": f"WITH {_EV} SELECT person_id, us // 86400000000 AS day, count(*) AS n FROM ev GROUP BY 1, 2",
    "domain_coverage": f"WITH {_RANKED} SELECT person_id, domain, n, place, {_r('cs', 'cumulative_share')} FROM rk",
    "concentration": f"WITH {_RANKED} SELECT person_id, {_TOPS}, count(*) FILTER (WHERE n = 1) AS seen_once FROM rk GROUP BY 1",
    "session_spread": f"WITH {_SS}, d AS (SELECT person_id, domain, count(DISTINCT session_no) AS s FROM ss GROUP BY 1, 2) SELECT person_id, count(*) AS n_domains, {', '.join(f'count(*) FILTER (WHERE s >= {k}) AS in{k}' for k in (2, 3, 5))} FROM d GROUP BY 1",
    "browsing_summary": f"""WITH {_SS}, t AS (SELECT person_id, count(*) AS n_events, max(session_no) AS n_sessions, count(DISTINCT category) AS n_categories, (max(us) - min(us)) / 86400000000.0::DOUBLE AS d FROM ss GROUP BY 1),
        c AS (SELECT person_id, category, count(*) AS n FROM ss GROUP BY 1, 2) SELECT person_id, category, n, {_r('n / n_events', 'share')}, n_events, n_sessions, n_categories, {_r('d', 'span_days')},
        row_number() OVER (PARTITION BY person_id ORDER BY n DESC, category) AS place FROM c JOIN t USING (person_id)""",
    "day_of_week_rates": f"WITH {_LB} SELECT ((window_end // 86400000000 + 3) % 7)::INT AS weekday, count(*) AS n, {_r('avg(outcome::INT)', 'rate')} FROM lb GROUP BY 1 HAVING count(*) >= 20",
    "url_domains": f"WITH {_URL} SELECT page_id, domain, coalesce(rule, 'unknown') AS category, CASE WHEN rule IS NULL THEN 'unknown' ELSE 'rule' END AS layer FROM cd",
    "unknown_rate": f"WITH {_URL} SELECT {_r('avg((rule IS NULL)::INT)', 'rate')}, count(*) AS n FROM cd",
    "association_rules": _rules(f"WITH {_SS}, sets AS (SELECT person_id, session_no, list_sort(list(DISTINCT category)) AS items FROM ss GROUP BY 1, 2 HAVING count(DISTINCT category) >= 2)", "person_id", 0.3, 1.0),
    "basket_rules": _rules("WITH sets AS (SELECT l_orderkey, list_sort(list(DISTINCT strftime(l_shipdate, '%m'))) AS items FROM lineitem GROUP BY 1 HAVING count(DISTINCT strftime(l_shipdate, '%m')) >= 2)", "", 0.1, 0.5),
    "jaccard_links": f"WITH {_JAC} SELECT person_id, a, b, shared, {_r('jaccard', 'jaccard')} FROM jac",
    "cooccurrence_clusters": f"""WITH RECURSIVE {_JAC}, bo AS (SELECT person_id, a, b FROM jac UNION SELECT person_id, b, a FROM jac),
        re AS (SELECT person_id, a AS domain, a AS cluster FROM bo UNION SELECT re.person_id, bo.b, re.cluster FROM re JOIN bo ON bo.person_id = re.person_id AND bo.a = re.domain) SELECT person_id, domain, min(cluster) AS cluster FROM re GROUP BY 1, 2""",
    "rolling_origin_folds": f"WITH {_FOLD} SELECT person_id, category, session_no, rn, fold, train_stop FROM fold",
    "baseline_predictions": f"WITH {_PRED} SELECT person_id, category, session_no, fold, model, {_r('p', 'p')}, y FROM pr",
    "baseline_scores": f"""WITH {_PRED}, c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM pr), s AS (SELECT person_id, model, count(*) AS n, avg(y) AS rate, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS ll FROM c GROUP BY 1, 2)
        SELECT s.person_id, s.model, s.n, {_r('s.rate', 'rate')}, {_r('s.brier', 'brier')}, {_r('s.ll', 'log_loss')}, {_r('1 - s.brier / nullif(r.brier, 0)', 'skill')} FROM s JOIN s r ON r.person_id = s.person_id AND r.model = 'base_rate'""",
    "reliability_curve": f"WITH {_REL} SELECT model, bin, n, {_r('mean_p', 'mean_p', 5)}, {_r('rate', 'rate', 5)} FROM rel",
    "calibration_errors": f"WITH {_REL} SELECT model, {_r('sum(n * abs(mean_p - rate)) / sum(n)', 'ece', 5)}, {_r('max(abs(mean_p - rate))', 'mce', 5)} FROM rel GROUP BY 1",
    "accuracy_coverage": f"""WITH {_PRED}, t AS (SELECT 0.5::DOUBLE + 0.5::DOUBLE * k / 50 AS threshold FROM range(50) r(k)), a AS (SELECT model, threshold, count(*) FILTER (WHERE greatest(p, 1 - p) >= threshold) AS answered,
        count(*) FILTER (WHERE greatest(p, 1 - p) >= threshold AND (p > 0.5) = (y = 1)) AS correct, count(*) AS n FROM pr, t GROUP BY 1, 2), w AS (SELECT *, correct / nullif(answered, 0) AS acc FROM a)
        SELECT model, round(threshold, 6) AS threshold, answered, correct, {_r('acc', 'accuracy')}, {_r('answered / n', 'coverage')},
        {_r('(acc + 2.706025 / (2 * nullif(answered, 0)) - 1.645 * sqrt(acc * (1 - acc) / nullif(answered, 0) + 2.706025 / (4 * nullif(answered, 0) * nullif(answered, 0)))) / (1 + 2.706025 / nullif(answered, 0))', 'wilson')} FROM w""",
    "prediction_resolution": f"WITH {_RES} SELECT person_id, category, start_us, end_us, outcome FROM res",
    "scorecard": f"WITH {_RES} SELECT person_id, {', '.join(f'''count(*) FILTER (WHERE outcome = '{x}') AS {x}''' for x in ('hit', 'miss', 'pending', 'expired'))} FROM res GROUP BY 1",
    "role_transitions": """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r0 AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
        r AS (SELECT conv_id, run, any_value(role) AS role, count(*) AS n FROM r0 GROUP BY 1, 2), l AS (SELECT role, lag(role) OVER w AS f, lag(n) OVER w AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY run))
        SELECT f AS from_category, role AS to_category, count(*) AS n, CAST(sum(k) AS BIGINT) AS run_events FROM l WHERE f IS NOT NULL GROUP BY 1, 2""",
}

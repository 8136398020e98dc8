"""Independent SQL for the registered queries, over the same tables."""

from __future__ import annotations

from bistrolytics.functions.fixed import (
    ACK_CONTEXT, ACK_TOKENS, BATCH_REASON, CONTEXT_HEADER, NO_MENU_REPLY, RECOMMEND_VERSION,
)
from bistrolytics.operators import leafwise
from bistrolytics.plans.retrain import NOTHING_MESSAGE, UPDATED_MESSAGE

ORACLES: dict[str, str] = {}

AS_OF = "DATE '2001-08-01'"
ITEM_KEY = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Daily series and forecasts

ORACLES["daily_orders"] = """
SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value
FROM orders GROUP BY 2"""

_REVENUE = """
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2"""
ORACLES["daily_revenue"] = _REVENUE

ORACLES["window_scan"] = f"""
SELECT 'all' AS series, CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= {AS_OF} - INTERVAL 365 DAY GROUP BY 2"""

_DAILY_PRIORITY = """
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value
FROM orders GROUP BY 1, 2"""


def _filled(daily: str) -> str:
    return f"""
daily AS ({daily}),
days AS (
  SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM daily GROUP BY series),
filled AS (
  SELECT days.series, days.date, coalesce(daily.value, 0.0) AS value
  FROM days LEFT JOIN daily ON daily.series = days.series AND daily.date = days.date)"""


ORACLES["gap_fill"] = f"WITH {_filled(_REVENUE)} SELECT series, date, value FROM filled"

_LAGS = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in range(1, 8))
ORACLES["forecast_features"] = f"""
WITH {_filled(_DAILY_PRIORITY)},
framed AS (
  SELECT series, date, value, {_LAGS},
    round(avg(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS roll_mean_7,
    round(coalesce(stddev_samp(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0), 6) AS roll_std_7,
    CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend,
    CAST(month(date) AS INT) AS month
  FROM filled WINDOW w AS (PARTITION BY series ORDER BY date))
SELECT * FROM framed WHERE lag_7 IS NOT NULL"""

ORACLES["flat_forecast"] = f"""
WITH daily AS ({_REVENUE}),
base AS (
  SELECT series, avg(value) AS base FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM daily)
  WHERE age <= 7 GROUP BY series)
SELECT series, CAST(day AS INT) AS day, round(base, 2) AS value, round(base * 0.8, 2) AS lower_bound,
       round(base * 1.2, 2) AS upper_bound
FROM base, range(1, 8) AS r(day)"""

ORACLES["forecast_routing"] = """
SELECT o_custkey AS series, count(DISTINCT CAST(o_orderdate AS DATE)) AS observed_days,
       CASE WHEN count(DISTINCT CAST(o_orderdate AS DATE)) < 14 THEN 'flat' ELSE 'model' END AS source
FROM orders GROUP BY 1"""



def _cents(value: str) -> str:
    """Rounded half up by the digits of a double."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,12)), 2) AS DOUBLE)"


# The first tree of each series: 14 times the best split of any leaf, on rank bins and a grid of gains.
_TREE_FEATURES = [(int(f), leafwise.FEATURES[f]) for f in leafwise.TreeSettings().features(0)]


def _split_step(k: int) -> str:
    return f"""
cut{k} AS MATERIALIZED (
  SELECT series, node, feature, bin FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY gain DESC, node, feature, bin) AS place FROM (
      SELECT series, node, feature, bin,
             floor((s * s / c + (total - s) * (total - s) / (n - c) - total * total / n) / unit * 1e9 + 0.5) AS gain
      FROM (
        SELECT series, node, feature, bin, unit, sum(cells) OVER upto AS c, sum(sums) OVER upto AS s,
               sum(cells) OVER leaf AS n, sum(sums) OVER leaf AS total
        FROM (
          SELECT series, node, feature, bin, any_value(unit) AS unit, count(*) AS cells, sum(g) AS sums
          FROM member{k} JOIN placed USING (series, date) GROUP BY 1, 2, 3, 4)
        WINDOW leaf AS (PARTITION BY series, node, feature), upto AS (PARTITION BY series, node, feature ORDER BY bin))
      WHERE c >= 3 AND n - c >= 3)
    WHERE gain > 0)
  WHERE place = 1),
member{k + 1} AS MATERIALIZED (
  SELECT m.series, m.date,
         CASE WHEN c.node IS NULL OR m.node <> c.node THEN m.node WHEN p.bin <= c.bin THEN {2 * k - 1} ELSE {2 * k} END AS node
  FROM member{k} m LEFT JOIN cut{k} c ON c.series = m.series
  LEFT JOIN placed p ON p.series = m.series AND p.date = m.date AND p.feature = c.feature)"""


ORACLES["forecast_first_tree"] = f"""
WITH {_filled(_DAILY_PRIORITY)},
framed AS (
  SELECT series, date, value, {_LAGS},
    round(avg(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 9) AS roll_mean_7,
    round(coalesce(stddev_samp(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0), 9) AS roll_std_7,
    isodow(date) - 1 AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend, month(date) AS month
  FROM filled WINDOW w AS (PARTITION BY series ORDER BY date)),
rested AS (
  SELECT *, value - avg(value) OVER (PARTITION BY series) AS g, count(*) OVER (PARTITION BY series) AS days
  FROM framed WHERE lag_7 IS NOT NULL),
united AS (SELECT *, sum(g * g) OVER (PARTITION BY series) AS unit FROM rested),
cells AS ({" UNION ALL ".join(f"SELECT series, date, g, days, unit, {f} AS feature, CAST({name} AS DOUBLE) AS x FROM united" for f, name in _TREE_FEATURES)}),
placed AS MATERIALIZED (
  SELECT *, CAST((rank() OVER (PARTITION BY series, feature ORDER BY x) - 1) * greatest(1, least(255, days // 3)) // days AS INT) AS bin
  FROM cells),
edges AS (
  SELECT series, feature, bin, (max(x) + lead(min(x)) OVER (PARTITION BY series, feature ORDER BY bin)) / 2 AS threshold
  FROM placed GROUP BY 1, 2, 3),
member1 AS (SELECT series, date, 0 AS node FROM united),
{",".join(_split_step(k) for k in range(1, 15))},
cuts AS ({" UNION ALL ".join(f"SELECT series, {k} AS split, feature, bin FROM cut{k}" for k in range(1, 15))}),
names AS (SELECT unnest({[f for f, _ in _TREE_FEATURES]}) AS feature, unnest({[name for _, name in _TREE_FEATURES]}) AS name)
SELECT series, split, name AS feature, round(threshold, 6) AS threshold
FROM cuts JOIN edges USING (series, feature, bin) JOIN names USING (feature)"""

# Trees cannot be said in SQL; a fixed linear rule takes their place in the same forecast.
_CUSTOMER_DAYS = """
SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS value
FROM orders GROUP BY 1, 2"""
ORACLES["forecast_linear"] = f"""
WITH RECURSIVE every AS ({_CUSTOMER_DAYS}),
routed AS (SELECT *, count(*) OVER (PARTITION BY series) AS days FROM every),
days AS (
  SELECT series, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM routed WHERE days >= 14 GROUP BY series),
filled AS (
  SELECT days.series, days.date, coalesce(every.value, 0.0) AS value
  FROM days LEFT JOIN every ON every.series = days.series AND every.date = days.date),
framed AS (
  SELECT series, date, value, {_LAGS},
    avg(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll_mean,
    coalesce(stddev_samp(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS roll_std
  FROM filled WINDOW w AS (PARTITION BY series ORDER BY date)),
scored AS (
  SELECT *, 4.0 + 0.25 * lag_1 + 0.25 * lag_7 + 0.375 * roll_mean + 0.0625 * roll_std
            + 8.0 * CAST(isodow(date) >= 6 AS INT) + 0.5 * month(date) AS prediction
  FROM framed WHERE lag_7 IS NOT NULL),
start AS (
  SELECT series, max(date) AS last, 1.5 * stddev_pop(value - prediction) AS margin,
    arg_max([value, lag_1, lag_2, lag_3, lag_4, lag_5, lag_6], date) AS week
  FROM scored GROUP BY series),
walk AS (
  SELECT series, last, margin, 0 AS day, CAST(NULL AS DOUBLE) AS value, week FROM start
  UNION ALL
  SELECT series, last, margin, day + 1, v, list_prepend(v, week[1:6]) FROM (
    SELECT *, greatest(0.0, 4.0 + 0.25 * week[1] + 0.25 * week[7] + 0.375 * list_avg(week) + 0.0625 * list_stddev_pop(week)
        + 8.0 * CAST(isodow(last + day + 1) >= 6 AS INT) + 0.5 * month(last + day + 1)) AS v
    FROM walk WHERE day < 9)),
short AS (
  SELECT series, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS base FROM (
    SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM routed WHERE days < 14)
  WHERE age <= 7 GROUP BY series)
SELECT series, CAST(day AS INT) AS day, round(value, 2) AS value, round(greatest(0.0, value - margin), 2) AS lower_bound,
       round(value + margin, 2) AS upper_bound, 'model' AS source
FROM walk WHERE day > 0
UNION ALL
SELECT series, CAST(day AS INT), {_cents("base")}, {_cents("base * 0.8")}, {_cents("base * 1.2")}, 'flat'
FROM short, range(1, 10) AS r(day)"""
ORACLES["forecast_linear_saved"] = ORACLES["forecast_linear"].replace("1.5 * stddev_pop(value - prediction)", "1.5 * 1234.5")

# Click-through counters

_COUNTERS = f"""
SELECT {ITEM_KEY} AS item_id,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS impressions,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"""
ORACLES["ctr_counters"] = _COUNTERS
ORACLES["ctr_stream"] = _COUNTERS
ORACLES["ctr_smoothed"] = f"SELECT item_id, round(clicks / (impressions + 10), 8) AS ctr FROM ({_COUNTERS})"
ORACLES["feedback_processed"] = "SELECT count(*) AS processed FROM events WHERE event_type IN ('view', 'click')"

# Baskets

_MULTI_CTE = """
lines AS (SELECT DISTINCT l_orderkey AS order_id, {item} AS item FROM lineitem JOIN part ON l_partkey = p_partkey{where}),
multi AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM lines GROUP BY 1 HAVING count(*) >= 2)),
n AS (SELECT count(DISTINCT order_id) AS n FROM multi)"""

ORACLES["basket_profile"] = f"""
WITH {_MULTI_CTE.format(item='p_name', where='')}
SELECT (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS raw_rows,
       (SELECT count(DISTINCT order_id) FROM lines) AS unique_orders,
       (SELECT n FROM n) AS multi_item_orders, (SELECT count(DISTINCT item) FROM multi) AS unique_items"""

ORACLES["basket_sizes"] = f"""
WITH {_MULTI_CTE.format(item='p_name', where='')}
SELECT basket_size, count(*) AS orders
FROM (SELECT order_id, count(*) AS basket_size FROM multi GROUP BY 1) GROUP BY 1"""

# Itemsets of up to four of many items, by joins.
_JOINED_SETS = """
f1 AS (SELECT item AS a, count(*) AS freq FROM multi GROUP BY 1),
f2 AS (SELECT x.item AS a, y.item AS b, count(*) AS freq FROM multi x JOIN multi y
       ON x.order_id = y.order_id AND x.item < y.item GROUP BY 1, 2),
c2 AS (SELECT a, b FROM f2, n WHERE freq >= ceil(0.001 * n)),
f3 AS (SELECT c2.a, c2.b, z.item AS c, count(*) AS freq FROM c2
       JOIN multi x ON x.item = c2.a JOIN multi y ON y.order_id = x.order_id AND y.item = c2.b
       JOIN multi z ON z.order_id = x.order_id AND z.item > c2.b GROUP BY 1, 2, 3),
c3 AS (SELECT a, b, c FROM f3, n WHERE freq >= ceil(0.001 * n)),
f4 AS (SELECT c3.a, c3.b, c3.c, w.item AS d, count(*) AS freq FROM c3
       JOIN multi x ON x.item = c3.a JOIN multi y ON y.order_id = x.order_id AND y.item = c3.b
       JOIN multi z ON z.order_id = x.order_id AND z.item = c3.c
       JOIN multi w ON w.order_id = x.order_id AND w.item > c3.c GROUP BY 1, 2, 3, 4),
c4 AS (SELECT a, b, c, d FROM f4, n WHERE freq >= ceil(0.001 * n)),
f5 AS (SELECT c4.a, c4.b, c4.c, c4.d, v.item AS e, count(*) AS freq FROM c4
       JOIN multi x ON x.item = c4.a JOIN multi y ON y.order_id = x.order_id AND y.item = c4.b
       JOIN multi z ON z.order_id = x.order_id AND z.item = c4.c
       JOIN multi w ON w.order_id = x.order_id AND w.item = c4.d
       JOIN multi v ON v.order_id = x.order_id AND v.item > c4.d GROUP BY 1, 2, 3, 4, 5),
sets AS (SELECT freq FROM f1 UNION ALL SELECT freq FROM f2 UNION ALL SELECT freq FROM f3
         UNION ALL SELECT freq FROM f4 UNION ALL SELECT freq FROM f5)"""

ORACLES["support_sweep"] = f"""
WITH {_MULTI_CTE.format(item='p_name', where='')}, {_JOINED_SETS}
SELECT CAST(s AS DOUBLE) AS min_support, (SELECT count(*) FROM sets, n WHERE freq >= ceil(CAST(s AS DOUBLE) * n)) AS itemsets
FROM (VALUES (0.05), (0.03), (0.01), (0.005), (0.001)) AS v(s)"""

# All itemsets over a small vocabulary, by testing every subset.
_SUBSETS = """
vocabulary AS (SELECT list(item ORDER BY item) AS v FROM (SELECT DISTINCT item FROM multi)),
subsets AS (
  SELECT list_filter(v, lambda x: (m >> (list_position(v, x) - 1)) & 1 = 1) AS items
  FROM vocabulary, range(1, (SELECT (1 << len(v)) FROM vocabulary)) AS r(m)),
masks AS (
  SELECT m, count(*) AS baskets FROM (
    SELECT order_id, sum(1 << (list_position(v, item) - 1)) AS m FROM multi, vocabulary GROUP BY order_id) GROUP BY 1),
sets AS (
  SELECT items, CAST(sum(baskets) AS BIGINT) AS freq FROM (
    SELECT items, list_sum(list_transform(items, lambda x: 1 << (list_position(v, x) - 1))) AS want FROM subsets, vocabulary)
  JOIN masks ON (CAST(m AS BIGINT) & CAST(want AS BIGINT)) = CAST(want AS BIGINT) GROUP BY 1),
frequent AS (SELECT items, freq FROM sets, n WHERE freq >= ceil({support} * n)),
rules AS (
  SELECT ac.items, a.items AS antecedent, list_filter(ac.items, lambda x: NOT list_contains(a.items, x)) AS consequent,
         ac.freq, a.freq AS freq_a
  FROM frequent ac JOIN frequent a ON len(a.items) < len(ac.items) AND list_has_all(ac.items, a.items)),
scored AS (
  SELECT r.items, r.antecedent, r.consequent, r.freq, r.freq / r.freq_a AS confidence,
         CAST(r.freq * n.n AS DOUBLE) / (r.freq_a * c.freq) AS lift
  FROM rules r JOIN frequent c ON c.items = r.consequent, n WHERE r.freq / r.freq_a >= {confidence}),
combos AS (
  SELECT row_number() OVER (ORDER BY lift DESC, confidence DESC, items) AS rank, items, confidence, lift FROM (
    SELECT *, row_number() OVER (PARTITION BY items ORDER BY lift DESC, confidence DESC) AS best FROM scored WHERE lift > 1)
  WHERE best = 1)"""


def _small_vocabulary(item: str, support: float, confidence: float, where: str = "") -> str:
    return f"WITH {_MULTI_CTE.format(item=item, where=where)}, " + _SUBSETS.format(support=support, confidence=confidence)


ORACLES["frequent_itemsets"] = _small_vocabulary("p_type", 0.05, 0.1) + """
SELECT array_to_string(items, ',') AS items, freq, round(freq / n, 6) AS support FROM frequent, n"""

ORACLES["association_rules"] = _small_vocabulary("p_type", 0.05, 0.1) + """
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, freq,
       round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM scored"""

# The support halves from 0.05 until some pair reaches it; larger sets need a reached pair.
ORACLES["combos_adaptive"] = f"""
WITH {_MULTI_CTE.format(item='p_name', where='')}, {_JOINED_SETS},
steps AS (SELECT 0.05 / (1 << i) AS s FROM range(0, 6) AS r(i)),
chosen AS (SELECT max(s) AS s FROM steps, n WHERE (SELECT max(freq) FROM f2) >= ceil(s * n)),
frequent AS (
  SELECT items, freq FROM (
    SELECT [a] AS items, freq FROM f1 UNION ALL SELECT [a, b], freq FROM f2
    UNION ALL SELECT [a, b, c], freq FROM f3 UNION ALL SELECT [a, b, c, d], freq FROM f4), n, chosen
  WHERE freq >= ceil(s * n)),
rules AS (
  SELECT ac.items, a.items AS antecedent, list_filter(ac.items, lambda x: NOT list_contains(a.items, x)) AS consequent,
         ac.freq, a.freq AS freq_a
  FROM frequent ac JOIN frequent a ON len(a.items) < len(ac.items) AND list_has_all(ac.items, a.items)),
scored AS (
  SELECT r.items, r.freq / r.freq_a AS confidence, CAST(r.freq * n.n AS DOUBLE) / (r.freq_a * c.freq) AS lift
  FROM rules r JOIN frequent c ON c.items = r.consequent, n WHERE r.freq / r.freq_a >= 0.01),
best AS (
  SELECT *, row_number() OVER (PARTITION BY items ORDER BY lift DESC, confidence DESC) AS best FROM scored WHERE lift > 1)
SELECT row_number() OVER (ORDER BY lift DESC, confidence DESC, items) AS rank,
       array_to_string(items, ',') AS combo_items,
       round(confidence, 4) AS confidence_score, round(lift, 4) AS lift_score
FROM best WHERE best = 1 ORDER BY rank LIMIT 20"""

_ATTRIBUTE_LINES = """
lines AS (SELECT DISTINCT l_orderkey AS order_id, unnest([p_type, 'flag ' || l_returnflag, 'line ' || l_linestatus]) AS item
          FROM lineitem JOIN part ON l_partkey = p_partkey{where}),
multi AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM lines GROUP BY 1 HAVING count(*) >= 2)),
n AS (SELECT count(DISTINCT order_id) AS n FROM multi)"""
_TRAINED = f"WITH {_ATTRIBUTE_LINES.format(where='')}, " + _SUBSETS.format(support=0.03, confidence=0.5)
ORACLES["combo_rules_train"] = _TRAINED + """
SELECT rank, array_to_string(items, ',') AS combo_items, round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM combos WHERE rank <= 50"""
ORACLES["combos_saved"] = _TRAINED + """
SELECT rank, array_to_string(items, ',') AS combo_items, round(confidence, 4) AS confidence_score, round(lift, 4) AS lift_score
FROM combos WHERE rank <= 50 AND round(confidence, 4) >= 0.7 ORDER BY rank LIMIT 20"""

_RECENT = f" WHERE l_shipdate >= {AS_OF} - INTERVAL 365 DAY"
ORACLES["combos_window"] = (
    f"WITH {_ATTRIBUTE_LINES.format(where=_RECENT)}, " + _SUBSETS.format(support=0.05, confidence=0.6) + """
SELECT rank, array_to_string(items, ',') AS combo_items, round(confidence, 4) AS confidence_score,
       round(lift, 4) AS lift_score FROM combos WHERE rank <= 20"""
)

ORACLES["window_itemsets"] = """
WITH lines AS (
  SELECT DISTINCT l_orderkey AS order_id, p_type AS item, year(CAST(o_orderdate AS DATE)) AS year
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
multi AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM lines GROUP BY 1 HAVING count(*) >= 2)),
vocabulary AS (SELECT list(item ORDER BY item) AS v FROM (SELECT DISTINCT item FROM multi)),
subsets AS (
  SELECT list_filter(v, lambda x: (m >> (list_position(v, x) - 1)) & 1 = 1) AS items, CAST(m AS BIGINT) AS want
  FROM vocabulary, range(1, (SELECT (1 << len(v)) FROM vocabulary)) AS r(m)),
masks AS (
  SELECT year, m, count(*) AS baskets FROM (
    SELECT order_id, year, CAST(sum(1 << (list_position(v, item) - 1)) AS BIGINT) AS m FROM multi, vocabulary GROUP BY 1, 2) GROUP BY 1, 2),
windows AS (SELECT DISTINCT year AS window_end FROM multi),
n AS (SELECT window_end, sum(baskets) AS n FROM windows JOIN masks ON year BETWEEN window_end - 2 AND window_end GROUP BY 1),
sets AS (
  SELECT window_end, items, CAST(sum(baskets) AS BIGINT) AS freq
  FROM windows JOIN masks ON year BETWEEN window_end - 2 AND window_end JOIN subsets ON (m & want) = want GROUP BY 1, 2)
SELECT CAST(window_end AS INT) AS window_end, array_to_string(items, ',') AS items, freq
FROM sets JOIN n USING (window_end) WHERE freq >= ceil(0.05 * n)"""

# The rules and series that have enough data, named in the job's message.
_DAYS = f"SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate >= {AS_OF} - INTERVAL 365 DAY"
ORACLES["retrain_job"] = f"WITH {_ATTRIBUTE_LINES.format(where=_RECENT)}, " + _SUBSETS.format(support=0.03, confidence=0.5) + f""",
saved AS (
  SELECT concat_ws(', ', CASE WHEN (SELECT count(*) FROM combos) > 0 THEN 'combo_rules' END,
    CASE WHEN ({_DAYS}) >= 14 THEN 'forecast_orders' END,
    CASE WHEN ({_DAYS} AND o_orderstatus = 'F') >= 14 THEN 'forecast_revenue' END) AS names)
SELECT 'job-1' AS job_id, 'COMPLETED' AS status,
       CASE WHEN names = '' THEN {quoted(NOTHING_MESSAGE)} ELSE {quoted(UPDATED_MESSAGE)} || names END AS message FROM saved"""

# Kitchen

_TASKS = f"""
tasks AS (
  SELECT event_type || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS station, event_id AS task_id, {ITEM_KEY} AS menu_item_id,
         1 + event_id % 2 AS quantity,
         epoch(CAST(ts AS DATE) + INTERVAL 12 HOUR) AS now,
         CASE WHEN {ITEM_KEY} % 10 = 3 THEN epoch(CAST(ts AS DATE) + INTERVAL 12 HOUR) ELSE floor(epoch(ts)) END AS created,
         CASE WHEN {ITEM_KEY} % 10 = 7 THEN 600 ELSE 300 + 60 * ({ITEM_KEY} % 10) END AS cook
  FROM events),
scored AS (
  SELECT station, menu_item_id, count(*) AS tasks, CAST(sum(quantity) AS BIGINT) AS total_quantity,
         CAST(min(created) AS BIGINT) AS oldest,
         CAST(2 * greatest(0, least(60, trunc((max(now) - min(created)) / 60))) + 5 * count(*)
              - 15 * greatest(0, sum(quantity) - 5) AS BIGINT) AS score,
         round(least(15.0, (count(*) - 1) * avg(cook) / 60), 1) AS estimated_saving_minutes,
         array_to_string(list(task_id ORDER BY task_id), ',') AS task_ids
  FROM tasks GROUP BY 1, 2 HAVING count(*) >= 2)"""
ORACLES["kitchen_scores"] = f"WITH {_TASKS} SELECT * EXCLUDE (task_ids) FROM scored"
ORACLES["kitchen_batches"] = f"""
WITH {_TASKS},
placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score DESC, menu_item_id) AS place FROM scored WHERE score > 0)
SELECT station, menu_item_id, task_ids, score, estimated_saving_minutes, {quoted(BATCH_REASON)} AS reason
FROM placed WHERE place <= 5"""
ORACLES["lenient_timestamps"] = f"WITH {_TASKS} SELECT task_id, CAST(created AS BIGINT) AS created FROM tasks"

# Vector neighbours

_PAIRS = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.v, i.v), 12) AS score
  FROM vecs q, vecs i)"""


def _top(k: int, where: str = "") -> str:
    return f"""
WITH {_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs {where})
SELECT query_id, item_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""


ORACLES["cosine_topk"] = _top(10)
ORACLES["cosine_topk_cells"] = _top(10)
ORACLES["neighbour_lists_kept"] = """
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 50 = 2 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings WHERE vec_id % 50 <> 3),
pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.v, i.v), 12) AS score
  FROM vecs q JOIN vecs i ON i.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5"""
ORACLES["cosine_pq_recall"] = "SELECT count(*) AS indexed, true AS recall_reached FROM embeddings"
ORACLES["cosine_topk_excluding"] = _top(5, "WHERE item_id NOT IN (query_id, query_id + 1)")

ORACLES["embed_batch_custom"] = r"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars,
       CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents"""

# Keyword and hybrid retrieval


def _tokens(text: str) -> str:
    clean = f"regexp_replace(lower(coalesce({text}, '')), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {clean} = '' THEN ['_pad_'] ELSE string_split_regex({clean}, '\\s+') END"


ORACLES["tokenised"] = f"""
SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"""

def _cells(source: str, key: str, text: str) -> str:
    """weights(key, cell, weight): hashed token counts of unit length, by the first 32 bits of MD5."""
    return f"""
hashed AS (
  SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS cell
  FROM (SELECT {key}, unnest({_tokens(text)}) AS w FROM {source})),
counted AS (SELECT {key}, cell, count(*) AS n FROM hashed GROUP BY 1, 2),
weights AS (
  SELECT {key}, CAST(cell AS INT) AS cell,
         round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE), 5) AS weight FROM counted)"""


ORACLES["embed_batch"] = f"WITH {_cells('documents', 'doc_id', 'text')} SELECT doc_id, cell, weight FROM weights"

_CORPUS = f"""
toks AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
tf AS (SELECT doc_id, w, count(*) AS f FROM (SELECT doc_id, unnest(t) AS w FROM toks) GROUP BY 1, 2),
dl AS (SELECT doc_id, len(t) AS l FROM toks),
total AS (SELECT count(*) AS n, avg(l) AS avgdl FROM dl),
idf AS (SELECT w, ln(n - c + 0.5) - ln(c + 0.5) AS idf FROM (SELECT w, count(*) AS c FROM tf GROUP BY 1), total),
mean AS (SELECT avg(idf) AS m, count(*) AS v FROM idf)"""

ORACLES["corpus_statistics"] = f"""
WITH {_CORPUS} SELECT n AS docs, round(avgdl, 6) AS mean_length, v AS vocabulary, round(m, 6) AS mean_idf FROM total, mean"""


def _keyword(queries: str, depth: int) -> str:
    """CTEs up to ``keyword``: the best ``depth`` documents per query, unmatched documents at score 0."""
    return f"""
{_CORPUS},
asked AS ({queries}),
qt AS (SELECT query_id, w, count(*) AS qn FROM (SELECT query_id, unnest({_tokens('text')}) AS w FROM asked) GROUP BY 1, 2),
hits AS (
  SELECT query_id, tf.doc_id,
         sum(qn * (CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score
  FROM qt JOIN tf USING (w) JOIN idf USING (w) JOIN dl ON dl.doc_id = tf.doc_id, total, mean GROUP BY 1, 2),
listed AS (
  SELECT a.query_id, d.doc_id, coalesce(h.score, 0.0) AS score
  FROM asked a CROSS JOIN dl d LEFT JOIN hits h ON h.query_id = a.query_id AND h.doc_id = d.doc_id),
keyword AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) DESC, doc_id) AS rank FROM listed)
  WHERE rank <= {depth})"""


_BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"
ORACLES["bm25_topk"] = f"WITH {_keyword(_BENCHMARK, 20)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM keyword"
ORACLES["bm25_topk_shuffled"] = ORACLES["bm25_topk"]
ORACLES["bm25_indexed"] = ORACLES["bm25_topk"]


def _hybrid(queries: str, vectors: str, k: int, where: str = "") -> str:
    """CTEs up to ``best``: the fused top k. ``vectors`` maps query_id to a vector id."""
    depth = max(3 * k, 20)
    return f"""
{_keyword(queries, depth)},
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qvec AS (SELECT q.query_id, v FROM ({vectors}) q JOIN vecs ON vecs.vec_id = q.vec_id),
dense AS (
  SELECT * FROM (
    SELECT query_id, d.vec_id AS doc_id,
           row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qvec.v, d.v), 12) DESC, d.vec_id) AS rank
    FROM qvec, vecs d WHERE d.vec_id IN (SELECT doc_id FROM documents))
  WHERE rank <= {depth}),
fused AS (
  SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score
  FROM (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM keyword) {where} GROUP BY 1, 2),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e12 + 0.5) DESC, doc_id) AS rank FROM fused)
  WHERE rank <= {k})"""


_BENCH_VECTORS = "SELECT item_id AS query_id, item_id AS vec_id FROM benchmark"
ORACLES["hybrid_rrf"] = f"""
WITH {_hybrid(_BENCHMARK, _BENCH_VECTORS, 5)} SELECT query_id, doc_id, rank, round(score, 8) AS score FROM best"""
ORACLES["hybrid_rrf_excluding"] = f"""
WITH {_hybrid(_BENCHMARK, _BENCH_VECTORS, 10, 'WHERE doc_id <> query_id')}
SELECT query_id, doc_id, rank, round(score, 8) AS score FROM best"""

# Recommendation

_FALLBACK_CARTS = """
SELECT DISTINCT l_orderkey AS cart_id FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN embeddings ON vec_id = l_partkey)"""

ORACLES["recommend_fallback"] = f"""
SELECT cart_id, 'fallback' AS source, '{RECOMMEND_VERSION}' AS model_version FROM ({_FALLBACK_CARTS})"""

ORACLES["recommend_carts"] = f"""
WITH {_PAIRS},
counters AS ({_COUNTERS}),
cart AS (SELECT DISTINCT l_orderkey AS cart_id, l_partkey AS item_id, label FROM lineitem JOIN embeddings ON vec_id = l_partkey),
near AS (
  SELECT c.cart_id, p.item_id, row_number() OVER (PARTITION BY c.cart_id, c.item_id ORDER BY p.score DESC, p.item_id) AS rank
  FROM cart c JOIN pairs p ON p.query_id = c.item_id
  WHERE NOT EXISTS (SELECT 1 FROM cart o WHERE o.cart_id = c.cart_id AND o.item_id = p.item_id)),
fused AS (SELECT cart_id, item_id, sum(1.0 / (60 + rank)) AS rrf FROM near WHERE rank <= 15 GROUP BY 1, 2),
blended AS (
  SELECT f.cart_id, f.item_id, (0.6 * rrf / max(rrf) OVER (PARTITION BY f.cart_id) + 0.4 * coalesce(clicks / (impressions + 10), 0))
           * CASE WHEN held.label IS NULL THEN 1.0 ELSE 0.5 END AS blend, held.label IS NOT NULL AS same_category
  FROM fused f JOIN vecs ON vecs.vec_id = f.item_id
  LEFT JOIN counters ON counters.item_id = f.item_id
  LEFT JOIN (SELECT DISTINCT cart_id, label FROM cart) held ON held.cart_id = f.cart_id AND held.label = vecs.label),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY floor(blend * 1e12 + 0.5) DESC, item_id) AS rank FROM blended)
SELECT cart_id, CAST(rank AS INT) AS rank, item_id AS menu_item_id,
       CAST(round(CAST(blend AS DECIMAL(18,12)), 4) AS DOUBLE) AS score,
       CASE WHEN same_category THEN 'similar' ELSE 'combo+popularity' END AS reason, 'model' AS source,
       '{RECOMMEND_VERSION}' AS model_version
FROM ranked WHERE rank <= 5
UNION ALL
SELECT cart_id, 0, -1, 0.0, '', 'fallback', '{RECOMMEND_VERSION}' FROM ({_FALLBACK_CARTS})"""

ORACLES["recommend_large_carts"] = ORACLES["recommend_carts"].replace("l_orderkey", "l_suppkey")

# Chat

_TURNS = """
turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, turn + 10000, 'user', 'Ok !!' FROM conversations WHERE role = 'user' AND turn > 0 AND conv_id % 5 = 0)"""
_ACK_LIST = ", ".join(quoted(t) for t in ACK_TOKENS)
_IS_ACK = f"regexp_replace(lower(trim(text, ' \t\n\r')), '[.!?,;:]+$', '') IN ({_ACK_LIST})"

ORACLES["ack_flags"] = f"WITH {_TURNS} SELECT conv_id, turn, {_IS_ACK} AS is_ack FROM turns"

_USER_TURNS = f"""
SELECT conv_id || ':' || turn AS query_id, text FROM turns WHERE role = 'user' AND NOT {_IS_ACK}"""
_USER_VECTORS = f"""
SELECT conv_id || ':' || turn AS query_id, conv_id AS vec_id FROM turns WHERE role = 'user' AND NOT {_IS_ACK}"""
_RAG = f"""
{_TURNS}, {_hybrid(_USER_TURNS, _USER_VECTORS, 5)},
blocks AS (
  SELECT query_id, count(*) AS n_hits, {quoted(CONTEXT_HEADER)} || chr(10) || string_agg(
    '  ID: ' || b.doc_id || ' | ' || source || ' | Giá: ' || format('{{:,}}', n_chars) || 'đ | ' || lang
    || ' | Đặc tính: ' || lang || ', ' || source, chr(10) ORDER BY rank) AS context
  FROM best b JOIN documents d ON d.doc_id = b.doc_id GROUP BY 1)"""
_RAG_ROWS = f"""
SELECT conv_id, turn, {_IS_ACK} AS is_ack, CAST(coalesce(n_hits, 0) AS INT) AS n_hits,
       CASE WHEN {_IS_ACK} THEN {quoted(ACK_CONTEXT)} ELSE coalesce(context, '') END AS context,
       CASE WHEN NOT {_IS_ACK} AND n_hits IS NULL THEN {quoted(NO_MENU_REPLY)} ELSE '' END AS reply
FROM turns LEFT JOIN blocks ON query_id = conv_id || ':' || turn WHERE role = 'user'"""
ORACLES["rag_context"] = f"WITH {_RAG} {_RAG_ROWS}"
ORACLES["rag_context_indexed"] = ORACLES["rag_context"]

_POSITIONS = f"""
{_TURNS},
positions AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
  FROM turns WHERE role IN ('user', 'assistant'))"""
ORACLES["prompt_history"] = f"""
WITH {_POSITIONS} SELECT conv_id, turn, position, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role,
       text AS content FROM positions"""
_ALL_POSITIONS = _POSITIONS.replace(_TURNS, "")
ORACLES["prompt_messages"] = f"""
WITH {_RAG}, answered AS ({_RAG_ROWS}) {_ALL_POSITIONS},
to_answer AS (
  SELECT p.conv_id, p.turn, p.position, p.text, a.context FROM positions p JOIN answered a ON a.conv_id = p.conv_id AND a.turn = p.turn
  WHERE p.role = 'user' AND a.reply = '')
SELECT conv_id, turn, CAST(0 AS BIGINT) AS place, 'system' AS role, 'Menu: ' || context || '.' AS content FROM to_answer
UNION ALL
SELECT p.conv_id, a.turn, p.position + 1, p.role, p.text FROM positions p JOIN to_answer a ON a.conv_id = p.conv_id
WHERE p.position <= a.position"""

ORACLES["response_parse"] = """
WITH calls AS (
  SELECT *, CASE WHEN conv_id % 7 IN (2, 3) THEN 0 ELSE 1 END AS calls,
         CASE WHEN turn % 4 = 3 THEN 'show_menu' ELSE 'add_to_cart' END AS name,
         CASE WHEN conv_id % 7 = 1 THEN '{}' ELSE '{"menu_item_id":' || conv_id || ',"quantity":' || turn || '}' END AS arguments
  FROM conversations)
SELECT conv_id, turn, text AS reply_text, calls, CASE WHEN calls = 0 THEN '' ELSE name || '=' || arguments END AS tool_calls
FROM calls"""
ORACLES["tool_actions"] = """
SELECT conv_id, turn, CASE WHEN conv_id % 7 IN (1, 2, 3) OR turn % 4 = 3 THEN ''
       ELSE 'ADD_ITEM:' || conv_id || ':' || greatest(turn, 1) END AS actions FROM conversations"""
ORACLES["response_parse_google"] = """
SELECT conv_id, turn, text || role AS reply_text, 1 AS calls, 'ADD_ITEM:' || conv_id || ':' || greatest(turn, 1) AS actions
FROM conversations"""

# Catalog

_CATALOG = """
items AS (
  SELECT p_partkey AS menu_item_id, p_name AS name, p_retailprice AS price, p_type AS category,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE 'size ' || p_size END AS description,
         CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_brand, p_type] END AS tags
  FROM part)"""
ORACLES["catalog_full_text"] = f"""
WITH {_CATALOG}
SELECT menu_item_id, 'Tên: ' || name || ', Giá: ' || price || ', Mô tả: ' || description || ', Danh mục: ' || category
       || ', Đặc tính: ' || array_to_string(tags, ', ') AS full_text FROM items"""
ORACLES["catalog_payload"] = f"""
WITH {_CATALOG}
SELECT menu_item_id, 'vec_' || menu_item_id AS vector_id, name, price, description, category,
       array_to_string(tags, '|') AS tags FROM items"""
ORACLES["float_texts"] = """
SELECT DISTINCT l_extendedprice, CAST(l_extendedprice AS VARCHAR) AS price_text FROM lineitem"""

_LATEST = """
latest AS (
  SELECT * FROM (
    SELECT l_partkey AS menu_item_id, l_extendedprice AS price, l_returnflag = 'R' AND l_quantity > 45 AS gone, row_number() OVER (
      PARTITION BY l_partkey
      ORDER BY l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS age
    FROM lineitem) WHERE age = 1)"""
ORACLES["catalog_upsert"] = f"""
WITH {_LATEST}
SELECT coalesce(menu_item_id, p_partkey) AS menu_item_id, coalesce(price, p_retailprice) AS price
FROM part FULL JOIN latest ON menu_item_id = p_partkey"""
ORACLES["catalog_delete"] = """
SELECT p_partkey AS menu_item_id, p_retailprice AS price FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"""
ORACLES["catalog_changes"] = f"""
WITH {_LATEST}
SELECT coalesce(menu_item_id, p_partkey) AS menu_item_id, coalesce(price, p_retailprice) AS price
FROM part FULL JOIN latest ON menu_item_id = p_partkey WHERE NOT coalesce(gone, false)"""
ORACLES["catalog_stream_state"] = ORACLES["catalog_changes"]
ORACLES["catalog_bucket_changes"] = ORACLES["catalog_changes"]
ORACLES["catalog_stream_changes"] = ORACLES["catalog_changes"]
_FULL_TEXT = """'Tên: ' || name || ', Giá: ' || price || ', Mô tả: ' || description || ', Danh mục: ' || category
       || ', Đặc tính: ' || array_to_string(tags, ', ')"""
_EMBEDDED = f"""
described AS (SELECT *, {_FULL_TEXT} AS full_text FROM items),
{_cells('described', 'menu_item_id', 'full_text')},
vectors AS (
  SELECT menu_item_id, string_agg(cell || ':' || weight, ',' ORDER BY cell) AS vector FROM weights GROUP BY 1),
rows AS (
  SELECT menu_item_id, 'vec_' || menu_item_id AS vector_id, name, price, description, category,
         array_to_string(tags, '|') AS tags, full_text, vector FROM described JOIN vectors USING (menu_item_id))"""
ORACLES["catalog_get_by_ids"] = f"""
WITH {_CATALOG}, {_EMBEDDED} SELECT * FROM rows WHERE menu_item_id IN (SELECT vec_id FROM embeddings)"""
_VALID = "p_size % 4 <> 3 AND p_size % 10 <> 5"
ORACLES["catalog_sync"] = f"""
WITH {_CATALOG.replace("items AS", "kept AS", 1)},
items AS (
  SELECT p_partkey AS menu_item_id, p_name AS name, CASE WHEN p_size % 10 = 6 THEN 0.0 ELSE p_retailprice END AS price,
         p_type AS category, p_brand AS description, [p_brand] AS tags FROM part WHERE {_VALID}
  UNION ALL
  SELECT menu_item_id, name, price, category, description, tags FROM kept
  WHERE menu_item_id IN (SELECT p_partkey FROM part WHERE NOT ({_VALID}))), {_EMBEDDED}
SELECT * FROM rows"""
ORACLES["catalog_sync_counts"] = f"""
SELECT count(*) AS records, count(*) FILTER (WHERE NOT ({_VALID})) AS rejected,
       count(*) FILTER (WHERE {_VALID}) AS synced_count FROM part"""
ORACLES["catalog_scan"] = "SELECT vec_id AS item_id, label AS category FROM embeddings"
ORACLES["seed_if_empty"] = "SELECT p_partkey AS menu_item_id, p_retailprice AS price FROM part"
ORACLES["malformed_items"] = """
SELECT p_partkey AS menu_item_id, p_name AS name, CASE WHEN p_size % 10 = 6 THEN 0.0 ELSE p_retailprice END AS price,
       p_brand AS description, p_type AS category, p_brand AS tags
FROM part WHERE p_size % 4 <> 3 AND p_size % 10 <> 5"""
ORACLES["canonicalise"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_partkey AS item_id FROM lineitem
WHERE l_orderkey <> 0 AND (l_linenumber % 2 = 0 OR l_partkey <> 0)"""
ORACLES["canonical_payments"] = """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ts,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS amount
FROM orders WHERE o_orderstatus IN ('F', 'O')"""
ORACLES["export_read"] = 'SELECT o_orderkey AS "orderId", o_orderstatus AS status, o_totalprice AS total FROM orders'

# Jobs and access log

ORACLES["job_states"] = """
WITH log AS (
  SELECT user_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id, ts, event_id,
         CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
         props AS message FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS age FROM log),
started AS (
  SELECT job_id, max(ts) FILTER (WHERE status = 'PENDING') AS started_at,
         max(ts) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS ended FROM log GROUP BY 1)
SELECT job_id, status, message, epoch_us(started_at) AS started_at,
       coalesce(CASE WHEN ended >= started_at THEN epoch_us(ended) END, 0) AS completed_at
FROM last JOIN started USING (job_id)
WHERE age = 1 AND started_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR"""

_BUCKETS = """
WITH RECURSIVE log AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS secs,
         CASE WHEN event_type = 'click' THEN 1.0 ELSE 2.0 END AS cap,
         CASE WHEN event_type = 'click' THEN CAST(1 AS DOUBLE) / 172800 ELSE CAST(1 AS DOUBLE) / 86400 END AS refill,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT event_id, user_id, event_type, i, secs, CAST(cap - 1 AS DOUBLE) AS tokens, true AS allowed FROM log WHERE i = 1
  UNION ALL
  SELECT l.event_id, l.user_id, l.event_type, l.i, l.secs,
         least(l.cap, w.tokens + (l.secs - w.secs) * l.refill)
           - CASE WHEN least(l.cap, w.tokens + (l.secs - w.secs) * l.refill) >= 1 THEN 1 ELSE 0 END,
         least(l.cap, w.tokens + (l.secs - w.secs) * l.refill) >= 1
  FROM walk w JOIN log l ON l.user_id = w.user_id AND l.event_type = w.event_type AND l.i = w.i + 1)"""
ORACLES["token_bucket"] = f"{_BUCKETS} SELECT event_id AS request_id, allowed FROM walk"
ORACLES["token_bucket_stream"] = ORACLES["token_bucket"]

"""The registered queries in DuckDB SQL, over the same driver tables.

Costs are summed as DECIMAL(28,12) and rounded as decimals, so both engines agree
on ties; counts and sums are cast to the types Spark returns.
"""

from __future__ import annotations


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _money(x: str = "cost_usd") -> str:
    return f"sum(CAST({x} AS DECIMAL(28,12)))"


def _r(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,12)), {places}) AS DOUBLE)"


def _i(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _pct(part: str, whole: str, places: int) -> str:
    return _r(f"100.0 * CAST({part} AS DOUBLE) / nullif({whole}, 0)", places)


TOKENS = "CAST(sum(input_tokens + output_tokens) AS BIGINT)"
CALLS = "count(*) FILTER (WHERE event_name = 'api_request')"
PROMPTS = "count(*) FILTER (WHERE event_name = 'user_prompt')"
PROMPT_LEN = "CASE WHEN event_name = 'user_prompt' THEN prompt_length END"
AVG_COST = _r(f"{_d(_money())} / nullif(count(cost_usd), 0)", 6)

EVENTS = r"""
raw AS (
  SELECT event_id, date_trunc('millisecond', ts) AS event_ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *(-?\d+)', 1) AS INTEGER) AS k
  FROM events),
e AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    epoch_ms(event_ts) AS "timestamp",
    strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_timestamp,
    event_ts,
    CASE event_type WHEN 'purchase' THEN 'api_request' WHEN 'view' THEN 'user_prompt'
      WHEN 'click' THEN 'tool_decision' WHEN 'signup' THEN 'tool_result'
      WHEN 'error' THEN 'api_error' ELSE event_type END AS event_name,
    'org-1' AS organization_id,
    CASE WHEN k <> 99 THEN user_id || '-' || strftime(event_ts, '%Y-%m-%d') END AS session_id,
    CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN k = 98 THEN '' WHEN k <> 97 THEN 'u' || user_id || '@example.org' END AS user_email,
    CASE WHEN k <> 96 THEN c_mktsegment END AS user_practice,
    'profile-' || (user_id % 3) AS user_profile,
    CASE user_id % 4 WHEN 0 THEN 'vscode' WHEN 1 THEN 'iterm' WHEN 2 THEN 'tmux' END
      AS terminal_type,
    CASE WHEN event_type IN ('purchase', 'error') AND k % 7 <> 6 THEN 'model-' || (k % 7) END
      AS model,
    CASE WHEN event_type = 'purchase' AND k % 11 <> 10 THEN k * 37 + event_id % 101 END
      AS input_tokens,
    CASE WHEN event_type = 'purchase' THEN k * 11 + event_id % 53 END AS output_tokens,
    CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN CAST(k * 2 AS BIGINT) END
      AS cache_creation_tokens,
    CASE WHEN event_type = 'purchase' AND k % 3 = 0 THEN CAST(k * 5 AS BIGINT) END
      AS cache_read_tokens,
    CASE WHEN event_type = 'purchase' THEN value END AS cost_usd,
    CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 1009 END AS duration_ms,
    CASE WHEN event_type = 'view' THEN CAST(k * 3 AS BIGINT) END AS prompt_length,
    CASE WHEN event_type IN ('click', 'signup') THEN 'tool-' || (k % 6) END AS tool_name,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 50 = 0 THEN 'reject' ELSE 'accept' END
      END AS decision,
    CASE WHEN event_type = 'click' THEN 'config' END AS decision_source,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 20 = 0 THEN 'false' ELSE 'true' END
      END AS success,
    'host-' || (user_id % 5) AS host_name, 'linux' AS os_type, '1.0.0' AS service_version
  FROM raw LEFT JOIN customer ON user_id = c_custkey)"""

EMPLOYEES = """
m AS (
  SELECT 'u' || c_custkey || CASE WHEN c_custkey % 13 = 12 THEN '@example.com' ELSE '@example.org' END
           AS email, c_name AS full_name,
         c_mktsegment AS practice, 'L' || (c_custkey % 10 + 1) AS "level", n_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

JOINED = f"{EVENTS},{EMPLOYEES}, j AS (SELECT e.*, m.* FROM e JOIN m ON e.user_email = m.email)"

SESSION_WHO = """
who AS (
  SELECT session_id, user_practice, user_email FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts,
             user_practice NULLS LAST, user_email NULLS LAST) AS pick
    FROM e WHERE session_id IS NOT NULL) WHERE pick = 1)"""

USER_WHO = """
who AS (
  SELECT user_email, user_practice FROM (
    SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY event_ts,
             user_practice NULLS LAST) AS pick
    FROM e WHERE user_email <> '') WHERE pick = 1)"""

MINUTES = "(epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / 6e7"

DURATIONS = f"""
d AS (
  SELECT session_id, user_practice, duration_min FROM (
    SELECT session_id, {_r(MINUTES, 2)} AS duration_min
    FROM e WHERE session_id IS NOT NULL GROUP BY session_id)
  JOIN who USING (session_id) WHERE duration_min > 0)"""

SESSION_SQL = f"""
SELECT session_id, user_practice, user_email, session_start, session_end, prompts, api_calls,
       tool_decisions, session_cost_usd, session_tokens
FROM (SELECT session_id, min(event_timestamp) AS session_start,
             max(event_timestamp) AS session_end, {PROMPTS} AS prompts, {CALLS} AS api_calls,
             count(*) FILTER (WHERE event_name = 'tool_decision') AS tool_decisions,
             {_r(_money(), 6)} AS session_cost_usd, {TOKENS} AS session_tokens
      FROM e WHERE session_id IS NOT NULL GROUP BY session_id)
JOIN who USING (session_id)"""

USER_SQL = f"""
SELECT user_email, user_practice, sessions, total_cost, total_tokens, api_calls, prompts,
       avg_prompt_len
FROM (SELECT user_email, count(DISTINCT session_id) AS sessions,
             coalesce({_d(_money())}, 0) AS total_cost, coalesce({TOKENS}, 0) AS total_tokens,
             {CALLS} AS api_calls, {PROMPTS} AS prompts,
             coalesce(avg({PROMPT_LEN}), 0) AS avg_prompt_len
      FROM e WHERE user_email <> '' GROUP BY user_email)
JOIN who USING (user_email)"""

KPI = f"""
SELECT count(DISTINCT session_id) AS total_sessions, count(DISTINCT user_id) AS total_users,
       count(DISTINCT user_practice) AS total_practices,
       coalesce({_d(_money())}, 0) AS total_cost_usd, coalesce({TOKENS}, 0) AS total_tokens,
       {CALLS} AS total_api_calls, {PROMPTS} AS total_prompts FROM e"""

BY_MODEL = f"""
SELECT model, count(*) AS api_calls, {TOKENS} AS total_tokens,
       {_r(_money(), 4)} AS total_cost_usd, {_r('avg(duration_ms)', 0)} AS avg_duration_ms
FROM e WHERE event_name = 'api_request' AND model IS NOT NULL GROUP BY model"""

BY_PRACTICE = f"""
SELECT user_practice, count(*) AS api_calls, {_i('sum(input_tokens)')} AS input_tokens,
       {_i('sum(output_tokens)')} AS output_tokens,
       {_i('sum(cache_read_tokens)')} AS cache_read_tokens, {TOKENS} AS total_tokens,
       {_r(_money(), 4)} AS total_cost_usd, {AVG_COST} AS avg_cost_per_call
FROM e WHERE event_name = 'api_request' AND user_practice IS NOT NULL GROUP BY user_practice"""

ACCEPT = "count(*) FILTER (WHERE decision = 'accept')"
DECISIONS = "event_name = 'tool_decision' AND tool_name IS NOT NULL"

TOOL_USE = f"""
SELECT tool_name, count(*) AS total_uses, {ACCEPT} AS accepted,
       count(*) FILTER (WHERE decision = 'reject') AS rejected,
       {_pct(ACCEPT, 'count(*)', 1)} AS accept_rate_pct
FROM e WHERE {DECISIONS} GROUP BY tool_name"""

TOOL_BY_PRACTICE = f"""
SELECT user_practice, tool_name, count(*) AS uses, {_pct(ACCEPT, 'count(*)', 1)} AS accept_rate_pct
FROM e WHERE {DECISIONS} AND user_practice IS NOT NULL GROUP BY user_practice, tool_name"""

TOOL_BY_LEVEL = f"""
SELECT "level", tool_name, count(*) AS uses, {_pct(ACCEPT, 'count(*)', 1)} AS accept_rate_pct
FROM j WHERE {DECISIONS} GROUP BY "level", tool_name"""

BY_LOCATION = f"""
SELECT location, count(DISTINCT user_email) AS users, {_r(_money(), 4)} AS total_cost_usd,
       {TOKENS} AS total_tokens, {CALLS} AS api_calls
FROM j WHERE location IS NOT NULL GROUP BY location"""

PRACTICE_LEVEL = f"""
SELECT practice, "level",
       {_r(f"{_d(_money())} / count(DISTINCT user_email)", 4)} AS avg_cost_per_user
FROM j WHERE event_name = 'api_request' GROUP BY practice, "level" """

TERMINALS = """
SELECT terminal_type, count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS users
FROM e WHERE terminal_type IS NOT NULL GROUP BY terminal_type"""

CORRELATION = f"""
pairs AS (
  SELECT session_id, avg({PROMPT_LEN}) AS x,
         {_d(_money("CASE WHEN event_name = 'api_request' THEN cost_usd END"))} AS y
  FROM e WHERE session_id IS NOT NULL GROUP BY session_id),
c AS (SELECT corr(x, y) AS r, count(*) AS n FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)"""

CORRELATION_SQL = f"""
SELECT {_r('r', 4)} AS correlation, n,
  CASE WHEN r > 0.7 THEN 'Strong positive' WHEN r > 0.4 THEN 'Moderate positive'
       WHEN r > 0.1 THEN 'Weak positive' WHEN r > -0.1 THEN 'Negligible'
       ELSE 'Negative' END AS interpretation
FROM c"""

# Two-sided tail of Student's t as the finite trigonometric sum: each term is the
# one before times a known ratio, with an own start for even and odd degrees.
P_VALUE_SQL = f"""
SELECT {_r('p', 6)} AS p_value, n FROM (
  SELECT n, 1 - CASE WHEN (n - 2) % 2 = 0 THEN s * total
                     ELSE 2 / pi() * (asin(s) + s * sqrt(1 - r * r) * total) END AS p
  FROM (SELECT r, n, abs(r) AS s, sum(term) AS total FROM (
          SELECT r, n, i, exp(sum(CASE WHEN i = 0 THEN 0 WHEN (n - 2) % 2 = 0
                   THEN ln((2 * i - 1) / (2.0 * i) * (1 - r * r))
                   ELSE ln(2 * i / (2.0 * i + 1) * (1 - r * r)) END) OVER (ORDER BY i)) AS term
          FROM c, generate_series(0, (n - 2 - 2 - (n - 2) % 2) // 2) AS g(i))
        GROUP BY r, n))"""


def _daily(total: str, kept: str) -> str:
    return f"""
daily AS (
  SELECT "date", total, CAST("date" - min("date") OVER () AS BIGINT) AS x FROM (
    SELECT CAST(event_ts AS DATE) AS "date", {total} AS total
    FROM e WHERE event_name = 'api_request' AND {kept} GROUP BY 1)),
fit AS (SELECT regr_slope(total, x) AS slope, regr_intercept(total, x) AS intercept,
               regr_r2(total, x) AS r2, max(x) AS last_x, max("date") AS last_date, count(*) AS days
        FROM daily)"""


COST_DAILY = _daily(_d(_money()), "cost_usd IS NOT NULL")
TOKEN_DAILY = _daily("CAST(sum(input_tokens + output_tokens) AS DOUBLE)", "TRUE")


def _forecast(name: str, days: int) -> str:
    line = _r("greatest(0, intercept + slope * (last_x + i))", 4)
    return f"""
SELECT strftime("date", '%Y-%m-%d') AS "date", {_r('total', 4)} AS {name}, 'actual' AS "type"
FROM daily
UNION ALL
SELECT strftime(last_date + CAST(i AS INTEGER), '%Y-%m-%d'), {line}, 'forecast'
FROM fit, generate_series(1, {days}) AS g(i)"""


def _share(report: str, label: str, measure: str) -> str:
    return f"""
SELECT {label}, {measure},
       {_r(f"100.0 * {measure} / sum({measure}) OVER ()", 2)} AS share_pct FROM ({report})"""


HISTOGRAM = f"""
SELECT bin, {_r('(lo + (hi - lo) * (bin - 1) / 50.0) / 100', 4)} AS from_min,
       {_r('(lo + (hi - lo) * bin / 50.0) / 100', 4)} AS to_min, user_practice,
       count(*) AS sessions
FROM (SELECT *, CAST(least((h - lo) * 50 // (hi - lo), 49) + 1 AS INTEGER) AS bin
      FROM (SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi
            FROM (SELECT user_practice, CAST(round(duration_min * 100) AS BIGINT) AS h FROM d)))
GROUP BY bin, lo, hi, user_practice"""

LEVELS = [f"L{i}" for i in range(1, 11)]


def _segments(k: int = 4) -> str:
    """K-means in whole numbers: hashed k-means++ draws, then rounds until no centre moves."""
    inputs = ("sessions", "api_calls", "prompts", "total_cost", "avg_prompt_len")
    figures = ", ".join(
        f"min({c}) AS lo{j}, max({c}) AS hi{j}, CAST(format('{{:.5e}}', stddev_pop({c})) AS DOUBLE) AS sd{j}"
        for j, c in enumerate(inputs, 1)
    )
    whole = ", ".join(
        f"CASE WHEN lo{j} = hi{j} THEN 0 ELSE"
        f" CAST(floor((CAST({c} AS DOUBLE) - CAST(lo{j} AS DOUBLE)) / sd{j} * 1024.0) AS BIGINT) END"
        for j, c in enumerate(inputs, 1)
    )
    away = "list_transform(c, lambda x: " + " + ".join(f"(x[{j}] - z[{j}]) * (x[{j}] - z[{j}])" for j in range(1, 6)) + ")"
    shift = " + ".join(f"(following[j][{i}] - c[j][{i}]) * (following[j][{i}] - c[j][{i}])" for i in range(1, 6))
    mean = ", ".join(f"CAST(sum(z[{j}]) // count(*) AS BIGINT)" for j in range(1, 6))
    draw = "-ln((CAST(CAST('0x' || md5((42 + r) || ':' || step || ':' || user_email)[1:13] AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"
    return f"""
u AS MATERIALIZED (SELECT user_email, user_practice, {", ".join(inputs)} FROM ({USER_SQL})),
p AS MATERIALIZED (SELECT user_email, [{whole}] AS z FROM u, (SELECT {figures} FROM u)),
drawn AS (
  SELECT CAST(r AS BIGINT) AS r, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[][]) AS c FROM range(10) AS g(r)
  UNION ALL
  SELECT r, step + 1, list_append(c, coalesce(arg_min(z, run), any_value(c[1]))) FROM (
    SELECT r, step, c, z, CASE WHEN step = 0 THEN {draw}
             WHEN list_min({away}) > 0 THEN {draw} / CAST(list_min({away}) AS DOUBLE) END AS run
    FROM drawn, p WHERE step < {k})
  GROUP BY r, step, c),
moved AS (
  SELECT r, CAST(0 AS BIGINT) AS t, c FROM drawn WHERE step = {k}
  UNION ALL
  SELECT r, t + 1, following FROM (
    SELECT r, t, c, list_transform(range(1, {k + 1}), lambda j:
             coalesce(list_extract(list_filter(list(new), lambda e: e.i = j), 1).v, c[j])) AS following
    FROM (
      SELECT r, t, c, {{'i': i, 'v': [{mean}]}} AS new
      FROM (SELECT r, t, c, z, list_position({away}, list_min({away})) AS i FROM moved, p)
      GROUP BY r, t, c, i)
    GROUP BY r, t, c)
  WHERE t < 299 AND list_sum(list_transform(range(1, {k + 1}), lambda j: {shift})) > 104),
best AS (
  SELECT c FROM (SELECT r, t, c, sum(list_min({away})) AS total FROM moved, p GROUP BY r, t, c)
  ORDER BY total, r, t LIMIT 1),
clustered AS (
  SELECT u.*, CAST(CASE WHEN (SELECT count(*) FROM u) >= {k} THEN len(list_filter(range(1, {k + 1}), lambda j:
           c[j][4] > c[i][4] OR (c[j][4] = c[i][4] AND j < i))) ELSE 0 END AS INTEGER) AS cluster
  FROM (SELECT user_email, c, list_position({away}, list_min({away})) AS i FROM best, p)
  JOIN u USING (user_email))"""


def _recursive(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def analytics_sql() -> dict[str, str]:
    """Queries over the mapped events and employees."""
    one = {
        "kpi_summary": KPI,
        "token_usage_by_practice": BY_PRACTICE,
        "token_usage_by_model": BY_MODEL,
        "cost_over_time_hour": f"""
SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:00') AS period,
       {_r(_money(), 6)} AS cost_usd, {TOKENS} AS total_tokens, count(*) AS api_calls
FROM e WHERE event_name = 'api_request' GROUP BY 1""",
        "cost_over_time_day": f"""
SELECT strftime(event_ts, '%Y-%m-%d') AS period, {_r(_money(), 6)} AS cost_usd,
       {TOKENS} AS total_tokens, count(*) AS api_calls
FROM e WHERE event_name = 'api_request' GROUP BY 1""",
        "peak_usage_by_hour": f"""
SELECT CAST(hour(event_ts) AS INTEGER) AS hour_of_day, count(*) AS event_count,
       {_r(_money(), 4)} AS cost_usd FROM e GROUP BY 1""",
        "peak_usage_by_weekday": f"""
SELECT dayname(event_ts) AS weekday, CAST(dayofweek(event_ts) AS VARCHAR) AS weekday_num,
       count(*) AS event_count, {_r(_money(), 4)} AS cost_usd FROM e GROUP BY 1, 2""",
        "tool_usage_stats": TOOL_USE,
        "tool_accept_by_practice": TOOL_BY_PRACTICE,
        "tool_result_performance": f"""
SELECT tool_name, count(*) AS executions,
       count(*) FILTER (WHERE success = 'true') AS successes,
       {_pct("count(*) FILTER (WHERE success = 'true')", 'count(*)', 1)} AS success_rate_pct,
       {_r('avg(duration_ms)', 0)} AS avg_duration_ms
FROM e WHERE event_name = 'tool_result' AND tool_name IS NOT NULL GROUP BY tool_name""",
        "prompt_length_distribution": f"""
SELECT user_practice, {_r('avg(prompt_length)', 0)} AS avg_prompt_length,
       min(prompt_length) AS min_prompt_length, max(prompt_length) AS max_prompt_length,
       count(*) AS prompt_count
FROM e WHERE event_name = 'user_prompt' AND prompt_length IS NOT NULL GROUP BY user_practice""",
        "terminal_type_distribution": TERMINALS,
        "cost_efficiency_by_model": f"""
SELECT *, CAST(round_even(total_tokens / total_cost_usd, 0) AS BIGINT) AS tokens_per_dollar,
       {_d("round_even(CAST(total_cost_usd / total_tokens * 1000 AS DECIMAL(28,12)), 6)")}
         AS cost_per_1k_tokens
FROM (SELECT model, count(*) AS api_calls, {TOKENS} AS total_tokens,
             {_r(_money(), 6)} AS total_cost_usd, {_r('avg(duration_ms)', 0)} AS avg_latency_ms
      FROM e WHERE event_name = 'api_request' AND model IS NOT NULL AND cost_usd > 0
      GROUP BY model)""",
        "cache_efficiency": f"""
SELECT user_practice, {_i('sum(input_tokens)')} AS total_input_tokens,
       coalesce({_i('sum(cache_read_tokens)')}, 0) AS cache_read_tokens,
       coalesce({_i('sum(cache_creation_tokens)')}, 0) AS cache_creation_tokens,
       {_pct('coalesce(sum(cache_read_tokens), 0)', 'sum(input_tokens)', 2)} AS cache_hit_rate_pct
FROM e WHERE event_name = 'api_request' AND user_practice IS NOT NULL GROUP BY user_practice""",
        "api_error_analysis": f"""
SELECT *, {_pct('api_errors', '(api_requests + api_errors)', 2)} AS error_rate_pct
FROM (SELECT user_practice, model, {CALLS} AS api_requests,
             count(*) FILTER (WHERE event_name = 'api_error') AS api_errors
      FROM e WHERE event_name IN ('api_request', 'api_error') AND user_practice IS NOT NULL
      GROUP BY user_practice, model) WHERE api_requests + api_errors > 5""",
        "tool_practice_heatmap": f"SELECT tool_name, user_practice, accept_rate_pct FROM ({TOOL_BY_PRACTICE})",
        "cost_share_by_model": _share(BY_MODEL, "model", "total_cost_usd"),
        "session_share_by_terminal": _share(TERMINALS, "terminal_type", "sessions"),
        "tokens_long": f"""
SELECT user_practice, kind, n FROM ({BY_PRACTICE}) UNPIVOT INCLUDE NULLS
  (n FOR kind IN (input_tokens, output_tokens, cache_read_tokens))""",
        "decisions_long": f"""
SELECT tool_name, kind, n FROM ({TOOL_USE}) UNPIVOT (n FOR kind IN (accepted, rejected))""",
        "kpi_header": f"""
SELECT total_sessions, total_users, total_api_calls, total_cost_usd, total_tokens FROM ({KPI})""",
        "model_table": f"""
SELECT model AS "Model", api_calls AS "API Calls", total_tokens AS "Total Tokens",
       total_cost_usd AS "Cost (USD)", avg_duration_ms AS "Avg Latency (ms)" FROM ({BY_MODEL})""",
    }
    sql = {name: _with(EVENTS, body) for name, body in one.items()}

    staff = {
        "cost_by_level": f"""
SELECT "level", count(DISTINCT session_id) AS sessions, count(DISTINCT user_email) AS users,
       {_r(_money(), 4)} AS total_cost_usd, {AVG_COST} AS avg_cost_per_call,
       {TOKENS} AS total_tokens
FROM j WHERE event_name = 'api_request' AND "level" IS NOT NULL GROUP BY "level" """,
        "cost_by_location": BY_LOCATION,
        "tool_acceptance_by_level": TOOL_BY_LEVEL,
        "avg_cost_per_user_by_practice_level": PRACTICE_LEVEL,
        "level_tool_heatmap": f'SELECT "level", tool_name, accept_rate_pct FROM ({TOOL_BY_LEVEL})',
        "cost_share_by_location": _share(BY_LOCATION, "location", "total_cost_usd"),
        "practice_level_pivot": "SELECT practice, "
        + ", ".join(
            f"""coalesce(max(avg_cost_per_user) FILTER (WHERE "level" = '{v}'), 0) AS {v}"""
            for v in LEVELS
        )
        + f" FROM ({PRACTICE_LEVEL}) GROUP BY practice",
    }
    sql |= {name: _with(JOINED, body) for name, body in staff.items()}

    by_session = f"{EVENTS},{SESSION_WHO}"
    durations = f"{by_session},{DURATIONS}"
    sql |= {
        "session_stats": _with(by_session, SESSION_SQL),
        "top_sessions": _with(
            by_session, f"{SESSION_SQL} ORDER BY session_cost_usd DESC NULLS LAST, session_id LIMIT 50"
        ),
        "session_features": _with(
            by_session,
            f"""
SELECT session_id, user_email, user_practice, total_cost, total_tokens, api_calls, prompts,
       avg_prompt_len, duration_min
FROM (SELECT session_id, coalesce({_d(_money())}, 0) AS total_cost,
             coalesce({TOKENS}, 0) AS total_tokens, {CALLS} AS api_calls, {PROMPTS} AS prompts,
             coalesce(avg({PROMPT_LEN}), 0) AS avg_prompt_len, {_r(MINUTES, 1)} AS duration_min
      FROM e WHERE session_id IS NOT NULL GROUP BY session_id)
JOIN who USING (session_id)""",
        ),
        "session_durations": _with(durations, "SELECT session_id, user_practice, duration_min FROM d"),
        "session_duration_stats": _with(
            durations,
            "SELECT "
            + ", ".join(
                f"{_r(x, 2)} AS {n}"
                for n, x in {
                    "mean": "avg(duration_min)",
                    "median": "quantile_cont(duration_min, 0.5)",
                    "std": "stddev_samp(duration_min)",
                    "p25": "quantile_cont(duration_min, 0.25)",
                    "p75": "quantile_cont(duration_min, 0.75)",
                    "p90": "quantile_cont(duration_min, 0.9)",
                    "p95": "quantile_cont(duration_min, 0.95)",
                    "max": "max(duration_min)",
                }.items()
            )
            + ', count(*) AS "count" FROM d',
        ),
        "duration_histogram": _with(durations, HISTOGRAM),
        "duration_box": _with(
            durations,
            "SELECT user_practice, "
            + ", ".join(
                f"{_r(f'quantile_cont(duration_min, {p})', 4)} AS {n}"
                for n, p in {"min": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1}.items()
            )
            + ", count(*) AS sessions FROM d GROUP BY user_practice",
        ),
        "prompt_cost_correlation": _with(f"{EVENTS},{CORRELATION}", CORRELATION_SQL),
        "correlation_p_value": _with(f"{EVENTS},{CORRELATION}", P_VALUE_SQL),
        "user_features": _with(f"{EVENTS},{USER_WHO}", USER_SQL),
        "user_engagement_clusters": _recursive(
            f"{EVENTS},{USER_WHO},{_segments()}", "SELECT * FROM clustered"
        ),
        "cluster_summary": _recursive(
            f"{EVENTS},{USER_WHO},{_segments()}",
            """
SELECT cluster, count(*) AS users, round_even(avg(total_cost), 2) AS avg_cost,
       round_even(avg(sessions), 2) AS avg_sessions, round_even(avg(api_calls), 2) AS avg_api_calls,
       round_even(avg(prompts), 2) AS avg_prompts
FROM clustered GROUP BY cluster""",
        ),
        "top_users_by_cost": _with(
            f"{EVENTS},{USER_WHO}",
            f"""
SELECT user_email, user_practice, sessions, total_cost_usd, total_tokens, prompts
FROM (SELECT user_email, count(DISTINCT session_id) AS sessions,
             {_r(_money(), 4)} AS total_cost_usd, {TOKENS} AS total_tokens, {PROMPTS} AS prompts
      FROM e WHERE user_email <> '' GROUP BY user_email)
JOIN who USING (user_email)
ORDER BY total_cost_usd DESC NULLS LAST, user_email LIMIT 20""",
        ),
        "cost_forecast": _with(f"{EVENTS},{COST_DAILY}", _forecast("cost_usd", 7)),
        "token_forecast": _with(f"{EVENTS},{TOKEN_DAILY}", _forecast("total_tokens", 7)),
        "cost_forecast_fit": _with(
            f"{EVENTS},{COST_DAILY}",
            f"SELECT {_r('r2', 4)} AS r2, {_r('slope', 6)} AS slope_per_day, "
            f"{_r('intercept', 6)} AS intercept FROM fit WHERE days >= 3",
        ),
        "cost_forecast_document": _with(
            f"{EVENTS},{COST_DAILY}, f AS ({_forecast('cost_usd', 7)})",
            f"""
SELECT CAST(to_json({{'meta': (SELECT {{'r2': {_r('r2', 4)}, 'slope_per_day': {_r('slope', 6)},
                                      'intercept': {_r('intercept', 6)}}} FROM fit),
                     'data': list(f ORDER BY "date")}}) AS VARCHAR) AS value FROM f""",
        ),
        "tool_usage_records": _with(
            EVENTS, f"SELECT CAST(to_json(t) AS VARCHAR) AS value FROM ({TOOL_USE}) AS t"
        ),
        "token_forecast_fit": _with(
            f"{EVENTS},{TOKEN_DAILY}", f"SELECT {_r('r2', 4)} AS r2 FROM fit WHERE days >= 3"
        ),
    }
    return sql


# --- ingest: the same events after a round trip through damaged log files -------
# g is the number of the envelope an event is sent in.

ENVELOPES = "g AS (SELECT DISTINCT event_id // 4 AS g FROM events)"

STORED = """
SELECT id, "timestamp", event_timestamp, event_name, organization_id, session_id, user_id,
       user_email, user_practice, user_profile, terminal_type, model, input_tokens, output_tokens,
       cache_creation_tokens, cache_read_tokens, cost_usd, duration_ms, prompt_length, tool_name,
       decision, decision_source, success, host_name, os_type, service_version
FROM e"""

SUMMARY = """
SELECT (SELECT count(*) FROM g) + (SELECT count(*) FROM g WHERE g % 50 = 1)
         + (SELECT count(*) FROM g WHERE g % 40 = 3) + (SELECT count(*) FROM g WHERE g % 60 = 5)
         + (SELECT count(*) FROM g WHERE g % 30 = 7) AS lines_processed,
       (SELECT count(*) FROM events) + (SELECT count(*) FROM g WHERE g % 45 = 4)
         + (SELECT count(*) FROM events WHERE event_id // 4 % 30 = 7)
         + (SELECT count(*) FROM g WHERE g % 30 = 7 AND g % 45 = 4) AS events_inserted,
       (SELECT count(*) FROM g WHERE g % 40 = 3) + (SELECT count(*) FROM g WHERE g % 35 = 2)
         + (SELECT count(*) FROM g WHERE g % 30 = 7 AND g % 35 = 2) AS events_skipped"""

QUARANTINE = """
SELECT 'line is not a JSON object' AS reason, CAST(NULL AS VARCHAR) AS id, count(*) AS n
FROM g WHERE g % 40 = 3 HAVING count(*) > 0
UNION ALL
SELECT 'event cannot be read', 'bad-' || g, CAST(1 + (g % 30 = 7)::INT AS BIGINT)
FROM g WHERE g % 35 = 2"""


def ingest_sql() -> dict[str, str]:
    """Queries over the loaded tables."""
    stored = _with(EVENTS, STORED)
    sessions = _with(f"{EVENTS},{SESSION_WHO}", SESSION_SQL)
    return {
        "ingest_events": stored,
        "ingest_in_two_loads": stored,
        "stream_ingest": stored,
        "stream_ingest_with_state": stored,
        "ingest_summary": _with(ENVELOPES, SUMMARY),
        "ingest_quarantine": _with(ENVELOPES, QUARANTINE),
        "ingest_after_compaction": stored,
        "ingest_stamps": _with(
            EVENTS, "SELECT event_name, count(*) AS n, count(*) AS stamped FROM e GROUP BY event_name"
        ),
        "ingest_limited": _with(
            ENVELOPES,
            f"SELECT least(150, lines_processed) AS lines_processed, lines_processed AS all_lines "
            f"FROM ({SUMMARY})",
        ),
        "rolled_cost_by_hour": analytics_sql()["cost_over_time_hour"],
        "rolled_cost_by_day": analytics_sql()["cost_over_time_day"],
        "rolled_session_stats": sessions,
        "sketched_kpis": f"""
SELECT total_cost_usd, total_tokens, total_api_calls, total_prompts, true AS total_sessions_near,
       true AS total_users_near, true AS total_practices_near
FROM ({analytics_sql()["kpi_summary"]})""",
        "employees_figures": _with(EMPLOYEES, "SELECT count(*) AS rows_inserted FROM m"),
        "employees_upsert": _with(EMPLOYEES, "SELECT * FROM m"),
        "stream_cost_by_hour": analytics_sql()["cost_over_time_hour"],
        "stream_session_rollup": sessions,
    }

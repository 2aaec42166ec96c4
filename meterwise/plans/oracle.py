"""For each query the SQL that DuckDB runs on the same parquet tables.

A query names the common table expressions it starts from; those bring the ones they
need. Whole-unit time differences use epochs, sums of integers are cast back from the
engine's wider type, and rounding adds the same nudge as on the Spark side.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "DATE '2024-01-31'"
MONTH = "DATE '2024-01-01'"


def r(value: str, places: int) -> str:
    return f"round({value} + sign({value}) * greatest(1e-9, abs({value}) * 1e-13), {places})"


def whole(value: str) -> str:
    return f"CAST(floor({value} + 0.5 + 1e-9) AS BIGINT)"


def dollars(value: str) -> str:
    return f"'$' || format('{{:,}}', {whole(value)})"


def days(n: int) -> str:
    return f"({TODAY} - {n})"


# Inputs derived from the driver tables.
CTES = {
    "usage": """
        SELECT CAST(l_suppkey % 4 AS VARCHAR) AS workspace_id,
               CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 25 AS VARCHAR) END AS job_id,
               DATE '2024-01-30' - CAST((l_orderkey + 31 * l_linenumber) % 200 AS INT) AS usage_date,
               CAST(DATE '2024-01-30' - CAST((l_orderkey + 31 * l_linenumber) % 200 AS INT) AS TIMESTAMP)
                 + to_hours(CAST(l_suppkey % 24 AS INT)) AS usage_start_time,
               l_returnflag AS sku_name, l_linestatus AS cloud,
               CASE WHEN l_linenumber = 7 THEN 'SQL' ELSE 'JOBS' END AS billing_origin_product,
               CASE WHEN l_linenumber <= 2 THEN CAST(l_partkey % 3 AS VARCHAR) END AS team_tag,
               l_quantity AS usage_quantity
        FROM lineitem""",
    "list_prices": """
        SELECT sku_name, cloud, w.price_start_time, w.price_end_time,
               w.base + (ascii(sku_name) % 4) / 100.0E0 AS unit_price
        FROM (SELECT DISTINCT l_returnflag AS sku_name, l_linestatus AS cloud FROM lineitem),
             (VALUES (TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-10-15 00:00:00', 0.10E0),
                     (TIMESTAMP '2023-10-15 00:00:00', TIMESTAMP '2024-01-15 00:00:00', 0.12E0),
                     (TIMESTAMP '2024-01-15 00:00:00', CAST(NULL AS TIMESTAMP), 0.15E0))
               AS w(price_start_time, price_end_time, base)""",
    "jobs": f"""
        SELECT CAST(p_partkey % 4 AS VARCHAR) AS workspace_id, CAST(p_partkey % 25 AS VARCHAR) AS job_id,
               p_name AS name, {AS_OF} - to_seconds((p_partkey * 7919) % 15552000) AS change_time
        FROM part""",
    "clusters": f"""
        SELECT CAST(p_partkey % 20 AS VARCHAR) AS cluster_id, CAST(p_partkey % 4 AS VARCHAR) AS workspace_id,
               p_name AS cluster_name, CASE WHEN p_partkey % 3 = 0 THEN 'UI' ELSE 'JOB' END AS cluster_source,
               p_type AS worker_node_type,
               greatest(1, CAST(floor(p_size / 4) AS INT)) AS min_workers, p_size AS max_workers,
               {AS_OF} - to_seconds(((p_partkey % 20) * 2 + (p_partkey * 7) % 45) * 86400 + p_partkey % 86400)
                 AS change_time,
               CASE WHEN p_partkey % 7 = 0 THEN {AS_OF} END AS delete_time
        FROM part""",
    "node_timeline": """
        SELECT CAST(user_id % 20 AS VARCHAR) AS cluster_id, CAST(user_id % 4 AS VARCHAR) AS workspace_id,
               user_id AS instance_id, CAST(user_id % 3 AS VARCHAR) AS node_type, ts AS start_time,
               least(100.0E0, value * (1 + user_id % 20) / 20.0E0) AS cpu_user_percent,
               CAST((event_id * 37) % 70 AS DOUBLE) AS mem_used_percent
        FROM events""",
    "job_run_timeline": f"""
        SELECT CAST(o_custkey % 4 AS VARCHAR) AS workspace_id, CAST(o_custkey % 25 AS VARCHAR) AS job_id,
               o_orderkey AS run_id,
               {AS_OF} - to_seconds((1 + o_orderkey % 1000) * 3600 - p * 1200) AS period_start_time,
               {AS_OF} - to_seconds((1 + o_orderkey % 1000) * 3600 - p * 1200)
                 + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 1200
                     + CASE WHEN o_custkey % 25 = 3 THEN 5400 ELSE 0 END
                     + CASE WHEN o_orderkey % 1000 < 48 AND o_custkey % 3 = 0 THEN 9000 ELSE 0 END)
                 AS period_end_time,
               CASE WHEN p < o_custkey % 3 OR o_orderkey % 20 = 1 THEN NULL
                    WHEN o_orderkey % (3 + o_custkey % 7) = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS result_state
        FROM (SELECT *, unnest(range(o_custkey % 3 + 1)) AS p FROM orders)""",
    "job_task_run_timeline": """
        SELECT workspace_id, job_id, run_id, CAST(run_id % 20 AS VARCHAR) AS compute_id, period_start_time,
               CASE WHEN run_id % 20 <> 1 THEN period_end_time END AS period_end_time
        FROM job_run_timeline""",
    "agent_action_log": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS action_id,
               {AS_OF} - to_seconds((1 + c_custkey % 2000) * 3600) AS action_timestamp,
               (['cost_spike_alert', 'cluster_right_sizing', 'wasteful_compute_detector', 'budget_forecast'])
                 [c_custkey % 4 + 1] AS skill_name,
               (['alert', 'recommendation', 'auto_remediation'])[c_custkey % 3 + 1] AS action_type,
               CAST(c_custkey % 4 AS VARCHAR) AS workspace_id, CAST(c_custkey % 25 AS VARCHAR) AS target_id,
               c_name AS target_name, c_mktsegment AS description, c_acctbal AS projected_savings,
               (['approved', 'applied', 'rejected', 'proposed', 'proposed'])[c_custkey % 5 + 1] AS status,
               CASE WHEN c_custkey % 50 = 0 THEN '{{bad' ELSE '{{"k": 1}}' END AS details
        FROM customer""",
    "agent_conversation": """
        SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS turn, role, text AS content
        FROM conversations""",
    "knowledge_docs": f"""
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat_ws(' ', lang, source) AS title, text AS content, source,
               concat_ws(',', lang, source) AS tags, {AS_OF} - INTERVAL 1 DAY AS updated_at
        FROM documents""",
    "new_documents": f"""
        SELECT k.doc_id, title, content, source,
               concat_ws(',', tags, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END) AS tags, {AS_OF} AS updated_at
        FROM knowledge_docs k JOIN labels l ON k.doc_id = CAST(l.doc_id AS VARCHAR)
        UNION ALL
        SELECT 'bench-' || item_id, 'benchmark item', text, 'benchmark', 'benchmark', {AS_OF} FROM benchmark""",
}

# Intermediate results.
CTES |= {
    "latest_jobs": """
        SELECT workspace_id, job_id, name AS job_name FROM jobs
        QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC, name DESC) = 1""",
    "latest_clusters": """
        SELECT * FROM clusters
        QUALIFY row_number() OVER (
          PARTITION BY cluster_id, workspace_id
          ORDER BY change_time DESC, cluster_name DESC, cluster_source DESC, worker_node_type DESC,
                   min_workers DESC, max_workers DESC, delete_time DESC NULLS LAST) = 1""",
    "live_clusters": "SELECT * FROM latest_clusters WHERE delete_time IS NULL",
    "priced_usage": """
        SELECT u.*, p.unit_price, u.usage_quantity * p.unit_price AS cost_usd
        FROM usage u JOIN list_prices p
          ON p.cloud = u.cloud AND p.sku_name = u.sku_name AND p.price_start_time <= u.usage_start_time
         AND u.usage_start_time < coalesce(p.price_end_time, TIMESTAMP '9999-01-01 00:00:00')""",
    "month_usage": f"SELECT * FROM priced_usage WHERE usage_date BETWEEN {MONTH} AND {TODAY}",
    "hourly": f"""
        SELECT cluster_id, workspace_id, date_trunc('hour', start_time) AS hour_window,
               avg(cpu_user_percent) AS avg_cpu_pct, max(cpu_user_percent) AS peak_cpu_pct,
               avg(mem_used_percent) AS avg_mem_pct, max(mem_used_percent) AS peak_mem_pct,
               count(DISTINCT instance_id) AS node_count, count(DISTINCT node_type) AS node_type_count
        FROM node_timeline WHERE start_time BETWEEN {days(30)} AND {AS_OF}
        GROUP BY ALL""",
    "week_hours": f"SELECT * FROM hourly WHERE hour_window BETWEEN {days(7)} AND {AS_OF}",
    "two_days": f"SELECT * FROM hourly WHERE hour_window BETWEEN {days(2)} AND {AS_OF}",
    "daily_cost": f"""
        SELECT c.workspace_id, c.job_id, j.job_name, c.usage_date, c.daily_cost_usd
        FROM (SELECT workspace_id, job_id, usage_date, sum(cost_usd) AS daily_cost_usd FROM priced_usage
              WHERE job_id IS NOT NULL AND usage_date BETWEEN {days(60)} AND {TODAY} GROUP BY ALL) c
        LEFT JOIN latest_jobs j USING (workspace_id, job_id)""",
    "trend": """
        SELECT *, avg(daily_cost_usd) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS rolling_14d_avg,
               daily_cost_usd / nullif(avg(daily_cost_usd) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) - 1
                 AS cost_growth_pct
        FROM daily_cost WINDOW w AS (PARTITION BY workspace_id, job_id ORDER BY usage_date)""",
    "trend4": f"""
        SELECT * REPLACE ({r('daily_cost_usd', 4)} AS daily_cost_usd, {r('rolling_14d_avg', 4)} AS rolling_14d_avg,
                          {r('cost_growth_pct', 4)} AS cost_growth_pct) FROM trend""",
    "month_trend": f"SELECT * FROM trend WHERE usage_date BETWEEN {MONTH} AND {TODAY}",
    "collapsed": f"""
        SELECT workspace_id, job_id, run_id, min(period_start_time) AS run_start, max(period_end_time) AS run_end,
               max(result_state) AS result_state
        FROM job_run_timeline WHERE period_start_time BETWEEN {days(30)} AND {AS_OF} GROUP BY ALL""",
    "completed": """
        SELECT *, CAST(floor(epoch(run_end - run_start)) AS BIGINT) AS duration_secs FROM collapsed
        WHERE result_state IS NOT NULL AND run_end >= run_start""",
    "health": f"""
        SELECT h.workspace_id, h.job_id, j.job_name, h.total_runs, h.failed_runs,
               {r('h.failed_runs / nullif(h.total_runs, 0)', 4)} AS failure_rate,
               h.avg_duration_secs, h.stddev_duration, h.max_duration_secs
        FROM (SELECT workspace_id, job_id, count(*) AS total_runs,
                     count(*) FILTER (result_state = 'FAILED') AS failed_runs,
                     avg(duration_secs) AS avg_duration_secs, stddev_samp(duration_secs) AS stddev_duration,
                     CAST(max(duration_secs) AS DOUBLE) AS max_duration_secs
              FROM completed GROUP BY ALL) h
        LEFT JOIN latest_jobs j USING (workspace_id, job_id)""",
    "week_runs": f"""
        SELECT workspace_id, job_id, run_id, min(period_start_time) AS run_start,
               CAST(floor(epoch(max(period_end_time) - min(period_start_time))) AS BIGINT) AS latest_secs
        FROM job_run_timeline WHERE period_start_time BETWEEN {days(7)} AND {AS_OF}
        GROUP BY ALL HAVING max(result_state) IS NOT NULL AND max(period_end_time) >= min(period_start_time)""",
    "slow": """
        SELECT h.*, l.latest_secs, h.avg_duration_secs + 2 * h.stddev_duration AS threshold_secs,
               (l.latest_secs - h.avg_duration_secs) / nullif(h.stddev_duration, 0) AS z
        FROM health h
        JOIN (SELECT * FROM week_runs QUALIFY row_number() OVER (
                PARTITION BY workspace_id, job_id ORDER BY run_start DESC, run_id DESC) = 1) l
          USING (workspace_id, job_id)
        WHERE h.stddev_duration > 0 AND l.latest_secs > h.avg_duration_secs + 2 * h.stddev_duration""",
    "spikes": f"""
        SELECT * FROM trend WHERE usage_date BETWEEN {days(3)} AND {TODAY} AND cost_growth_pct > 0.25""",
    "reconfigured": f"""
        SELECT t.workspace_id, t.job_id, c.cluster_id, c.cluster_name, c.change_time, c.worker_node_type,
               c.min_workers, c.max_workers
        FROM (SELECT DISTINCT workspace_id, job_id, compute_id FROM job_task_run_timeline) t
        JOIN clusters c ON c.workspace_id = t.workspace_id AND c.cluster_id = t.compute_id
        WHERE c.change_time BETWEEN {days(7)} AND {AS_OF}
        QUALIFY row_number() OVER (
          PARTITION BY t.workspace_id, t.job_id
          ORDER BY c.change_time DESC, c.cluster_id, c.cluster_name, c.worker_node_type, c.min_workers,
                   c.max_workers) = 1""",
    "grown": f"""
        SELECT *, (this_week_dbus - last_week_dbus) / last_week_dbus * 100 AS growth_pct
        FROM (SELECT workspace_id, job_id,
                     sum(usage_quantity) FILTER (usage_date >= {days(7)}) AS this_week_dbus,
                     sum(usage_quantity) FILTER (usage_date < {days(7)}) AS last_week_dbus
              FROM usage WHERE job_id IS NOT NULL AND usage_date BETWEEN {days(14)} AND {TODAY} GROUP BY ALL)
        WHERE this_week_dbus <> 0 AND last_week_dbus > 0
          AND (this_week_dbus - last_week_dbus) / last_week_dbus * 100 > 10""",
    "interactive": f"""
        SELECT DISTINCT workspace_id, job_id FROM job_task_run_timeline t
        WHERE period_start_time BETWEEN {days(7)} AND {AS_OF}
          AND EXISTS (FROM clusters c WHERE c.workspace_id = t.workspace_id AND c.cluster_id = t.compute_id
                        AND c.cluster_source = 'UI')""",
    "explained": f"""
        SELECT workspace_id, job_id, usage_date, target_name, daily_cost_usd, cost_growth_pct, root_causes,
               'Job ''' || target_name || ''' cost ' || {whole('cost_growth_pct * 100')} || '% more this week ($'
                 || {whole('daily_cost_usd')} || '/day). Root cause(s): ' || root_causes AS explanation
        FROM (
          SELECT s.*, coalesce(nullif(s.job_name, ''), 'job_' || s.job_id) AS target_name,
                 coalesce(nullif(concat_ws('; ',
                   'Cluster ''' || c.cluster_name || ''' was reconfigured on '
                     || strftime(c.change_time, '%Y-%m-%d %H:%M:%S') || ' — node type: ' || c.worker_node_type
                     || ', workers: ' || c.min_workers || '-' || c.max_workers,
                   'DBU consumption increased ' || {whole('g.growth_pct')} || '% (' || {whole('g.last_week_dbus')}
                     || ' → ' || {whole('g.this_week_dbus')} || ' DBUs week-over-week)',
                   CASE WHEN i.job_id IS NOT NULL THEN 'Job is running on ALL-PURPOSE compute (higher DBU rate) — '
                     || 'migrating to job compute would reduce cost' END), ''),
                   'No specific root cause identified — review job configuration manually') AS root_causes
          FROM spikes s
          LEFT JOIN reconfigured c USING (workspace_id, job_id)
          LEFT JOIN grown g USING (workspace_id, job_id)
          LEFT JOIN interactive i ON i.workspace_id = s.workspace_id AND i.job_id = s.job_id)""",
    "low_rows": """
        SELECT cluster_id, workspace_id, hour_window, avg_cpu_pct, avg_mem_pct, node_count,
               CAST(count(*) FILTER (avg_cpu_pct < 30 AND avg_mem_pct < 40) OVER (
                 PARTITION BY cluster_id, workspace_id ORDER BY hour_window
                 ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS consecutive_low_hours
        FROM two_days""",
    "overprovisioned": f"""
        SELECT l.*, c.cluster_name, c.cluster_source, c.worker_node_type, c.min_workers, c.max_workers
        FROM (SELECT cluster_id, workspace_id, {r('avg(avg_cpu_pct)', 1)} AS avg_cpu,
                     {r('avg(avg_mem_pct)', 1)} AS avg_mem, {r('avg(node_count)', 1)} AS avg_nodes,
                     max(consecutive_low_hours) AS max_consec_low_hours
              FROM low_rows GROUP BY ALL HAVING max(consecutive_low_hours) >= 5) l
        JOIN latest_clusters c USING (cluster_id, workspace_id)""",
    "current_size": """
        SELECT *, CAST(coalesce(nullif(min_workers, 0), 1) AS BIGINT) AS current_min,
               CAST(coalesce(nullif(max_workers, 0), floor(avg_nodes)) AS BIGINT) AS current_max
        FROM overprovisioned""",
    "right_sized": """
        SELECT *, reduction_pct * current_max * 720 * 0.15E0 AS estimated_monthly_savings
        FROM (SELECT *, greatest(1, optimal_max // 2) AS optimal_min,
                     (current_max - optimal_max) / current_max AS reduction_pct
              FROM (SELECT *, greatest(1, CAST(floor(current_max * (greatest(avg_cpu, avg_mem) / 60)) AS BIGINT))
                             AS optimal_max FROM current_size))
        WHERE reduction_pct > 0""",
    "wrong_compute": f"""
        SELECT p.workspace_id, p.job_id, j.job_name, p.cluster_id, p.cluster_name, p.cluster_source, p.recent_runs
        FROM (SELECT DISTINCT workspace_id, job_id, cluster_id, cluster_name, cluster_source, recent_runs
              FROM (SELECT t.workspace_id, t.job_id, c.cluster_id, c.cluster_name, c.cluster_source,
                           count(DISTINCT t.run_id) OVER (PARTITION BY t.workspace_id, t.job_id) AS recent_runs
                    FROM job_task_run_timeline t
                    JOIN latest_clusters c ON c.workspace_id = t.workspace_id AND c.cluster_id = t.compute_id
                    WHERE c.cluster_source = 'UI' AND t.period_start_time BETWEEN {days(7)} AND {AS_OF})) p
        LEFT JOIN latest_jobs j USING (workspace_id, job_id)""",
    "idle": f"""
        SELECT c.cluster_id, c.workspace_id, c.cluster_name, a.last_active_hour, {r('a.cpu', 1)} AS recent_cpu,
               CAST(floor(epoch({AS_OF} - a.last_active_hour) / 3600) AS BIGINT) AS idle_hours
        FROM live_clusters c
        LEFT JOIN (SELECT cluster_id, workspace_id, max(hour_window) AS last_active_hour, avg(avg_cpu_pct) AS cpu
                   FROM hourly WHERE hour_window BETWEEN {days(1)} AND {AS_OF} GROUP BY ALL) a
          USING (cluster_id, workspace_id)
        WHERE a.cpu < 5 OR a.last_active_hour IS NULL OR a.last_active_hour < {AS_OF} - INTERVAL 2 HOUR""",
    "no_tasks": f"""
        SELECT cluster_id, workspace_id, cluster_name, CAST(0 AS BIGINT) AS active_tasks FROM live_clusters c
        WHERE NOT EXISTS (FROM job_task_run_timeline t
                          WHERE t.compute_id = c.cluster_id AND t.workspace_id = c.workspace_id
                            AND t.period_end_time IS NULL
                            AND t.period_start_time BETWEEN {AS_OF} - INTERVAL 4 HOUR AND {AS_OF})""",
    "waste": """
        SELECT 'wrong_compute' AS category, target,
               'Migrate ''' || target || ''' from all-purpose to job compute (' || recent_runs || ' runs/week)'
                 AS description,
               recent_runs * 5.0E0 AS weekly_savings, workspace_id, job_id AS target_id, cluster_id
        FROM (SELECT *, coalesce(nullif(job_name, ''), 'job_' || job_id) AS target FROM wrong_compute)
        UNION ALL
        SELECT 'idle_cluster', target, 'Terminate idle cluster ''' || target || ''' (idle ' || hours || 'h)',
               hours * 0.5E0 * 7, workspace_id, cluster_id, cluster_id
        FROM (SELECT *, coalesce(nullif(cluster_name, ''), cluster_id) AS target,
                     coalesce(nullif(idle_hours, 0), 2) AS hours FROM idle)
        UNION ALL
        SELECT 'zero_tasks', target,
               'Cluster ''' || target || ''' is running with 0 active tasks — consider auto-terminate',
               20.0E0, workspace_id, cluster_id, cluster_id
        FROM (SELECT *, coalesce(nullif(cluster_name, ''), cluster_id) AS target FROM no_tasks)""",
    "top_waste": f"""
        SELECT row_number() OVER (ORDER BY weekly_savings DESC, p, target_id, workspace_id, description, cluster_id) AS rank,
               category, target, description, weekly_savings, workspace_id, target_id, cluster_id,
               {r('weekly_savings * 4.3E0', 2)} AS projected_savings
        FROM (SELECT *, list_position(['wrong_compute', 'idle_cluster', 'zero_tasks'], category) AS p FROM waste)
        ORDER BY rank LIMIT 5""",
    "daily_spend": """
        SELECT workspace_id, usage_date, sum(cost_usd) AS daily_cost_usd FROM month_usage GROUP BY ALL""",
    "mtd": """
        SELECT workspace_id, sum(daily_cost_usd) AS mtd, avg(daily_cost_usd) AS per_day, count(*) AS days_elapsed
        FROM daily_spend GROUP BY ALL""",
    "projection": f"""
        SELECT workspace_id, {r('mtd', 2)} AS mtd_spend, {r('per_day', 2)} AS avg_daily_spend, days_elapsed,
               CAST(31 AS BIGINT) AS days_in_month, {r('per_day * 31', 2)} AS projected_eom_spend,
               {r('mtd + per_day * (31 - days_elapsed)', 2)} AS linear_projection
        FROM mtd""",
    "budget_use": """
        SELECT *, linear_projection / budget * 100 AS budget_pct
        FROM (SELECT *, CASE workspace_id WHEN '0' THEN 9000.0E0 WHEN '1' THEN 10000.0E0 ELSE 50000.0E0 END AS budget
              FROM projection)""",
    "guardrail": """
        SELECT *, CASE WHEN budget_pct > 100 THEN 'critical' ELSE 'warning' END AS severity
        FROM budget_use WHERE budget_pct >= 90""",
    "drivers": f"""
        SELECT workspace_id, row_number() OVER w AS rank, job_name, mtd_cost
        FROM (SELECT workspace_id, job_name, {r('sum(daily_cost_usd)', 2)} AS mtd_cost FROM month_trend
              WHERE workspace_id IN (SELECT workspace_id FROM guardrail) GROUP BY ALL)
        WINDOW w AS (PARTITION BY workspace_id ORDER BY mtd_cost DESC, job_name NULLS FIRST)
        QUALIFY rank <= 3""",
    "budget_alerts": f"""
        SELECT g.*, 'Workspace ' || g.workspace_id || ': projected EOM spend $'
                 || format('{{:,}}', {whole('linear_projection')}) || ' (' || {whole('budget_pct')} || '% of $'
                 || format('{{:,}}', {whole('budget')}) || ' budget). MTD: $' || format('{{:,}}', {whole('mtd_spend')})
                 || ', avg $' || format('{{:,}}', {whole('avg_daily_spend')}) || '/day. Top drivers: '
                 || coalesce(d.names, 'N/A') || '.' AS description
        FROM guardrail g
        LEFT JOIN (SELECT workspace_id, string_agg(coalesce(job_name, 'None') || ' ($' || mtd_cost || ')', ', '
                            ORDER BY rank) AS names FROM drivers GROUP BY ALL) d USING (workspace_id)""",
    "trajectory": f"""
        SELECT usage_date, daily_spend, sum(daily_spend) OVER (ORDER BY usage_date) AS cumulative_spend,
               avg(daily_spend) OVER (ORDER BY usage_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d_avg
        FROM (SELECT usage_date, {r('sum(cost_usd)', 2)} AS daily_spend FROM month_usage GROUP BY ALL)""",
    "month_log": f"""
        SELECT * FROM agent_action_log
        WHERE action_timestamp BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {AS_OF}""",
    "digest": f"""
        SELECT count(*) AS total_actions, count(*) FILTER (status = 'applied') AS applied,
               {r('sum(projected_savings)', 0)} AS total_savings, count(DISTINCT target_id) AS unique_targets,
               count(DISTINCT skill_name) AS skills_used
        FROM month_log""",
    "over_provisioned": f"""
        SELECT h.cluster_id, h.workspace_id, c.cluster_name, c.worker_node_type, c.min_workers, c.max_workers,
               {r('h.cpu', 1)} AS avg_cpu_7d, {r('h.mem', 1)} AS avg_mem_7d, {r('h.nodes', 1)} AS avg_nodes
        FROM (SELECT cluster_id, workspace_id, avg(avg_cpu_pct) AS cpu, avg(avg_mem_pct) AS mem,
                     avg(node_count) AS nodes FROM week_hours GROUP BY ALL) h
        LEFT JOIN latest_clusters c USING (cluster_id, workspace_id)
        WHERE h.cpu < 30 AND h.mem < 40""",
    "top_names": f"""
        SELECT job_name, workspace_id, {r('sum(daily_cost_usd)', 2)} AS mtd_cost,
               {r('avg(daily_cost_usd)', 2)} AS avg_daily_cost, {r('max(cost_growth_pct) * 100', 1)} AS max_growth_pct
        FROM month_trend GROUP BY ALL ORDER BY mtd_cost DESC, job_name NULLS FIRST, workspace_id LIMIT 10""",
}


def action(source: str, skill: str, kind: str, target: str, name: str, text: str, savings: str, *identity: str) -> str:
    parts = ", ".join([f"'{skill}'", "workspace_id", target, "'2024-01-31'", *[f"CAST({i} AS VARCHAR)" for i in identity]])
    return f"""
        SELECT sha256(concat_ws('|', {parts})) AS action_id, {AS_OF} AS action_timestamp, '{skill}' AS skill_name,
               '{kind}' AS action_type, workspace_id, {target} AS target_id, {name} AS target_name,
               {text} AS description, {r(savings, 2)} AS projected_savings, 'proposed' AS status
        FROM {source}"""


SIZING_TEXT = f"""'Cluster ''' || cluster_name || ''' is over-provisioned (CPU: ' || avg_cpu || '%, MEM: ' || avg_mem
                 || '%). Recommend: ' || current_min || '-' || current_max || ' → ' || optimal_min || '-' || optimal_max
                 || ' workers (~' || {whole('reduction_pct * 100')} || '% reduction, est. $'
                 || {whole('estimated_monthly_savings')} || '/mo savings).'"""

CTES |= {
    "spike_actions": action(
        "explained", "cost_spike_alert", "alert", "job_id", "target_name", "explanation",
        "daily_cost_usd * cost_growth_pct * 30", "usage_date",
    ),
    "sizing_actions": action(
        "right_sized", "cluster_right_sizing", "recommendation", "cluster_id", "cluster_name", SIZING_TEXT,
        "estimated_monthly_savings",
    ),
    "waste_actions": action(
        "top_waste", "wasteful_compute_detector", "recommendation", "target_id", "target", "description",
        "weekly_savings * 4.3E0", "category", "target", "cluster_id",
    ),
    "budget_actions": action(
        "budget_alerts", "budget_forecast", "alert", "workspace_id", "'Workspace ' || workspace_id", "description",
        "0.0E0",
    ),
    "all_actions": """
        FROM spike_actions UNION ALL FROM sizing_actions UNION ALL FROM waste_actions UNION ALL FROM budget_actions""",
    # Documents and vectors.
    "merged_docs": """
        FROM new_documents UNION ALL
        FROM knowledge_docs k WHERE NOT EXISTS (FROM new_documents n WHERE n.doc_id = k.doc_id)""",
    "centroids": """
        SELECT CAST(label AS BIGINT) AS query_id, position, avg(CAST(x AS DOUBLE)) AS x
        FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding) AS x FROM embeddings)
        GROUP BY ALL""",
    "hits": f"""
        SELECT query_id, doc_id, {r('score', 6)} AS score, rank
        FROM (SELECT query_id, doc_id, score,
                     row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
              FROM (SELECT q.query_id, e.vec_id AS doc_id,
                           list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS score
                    FROM (SELECT query_id, list(x ORDER BY position) AS v FROM centroids GROUP BY ALL) q, embeddings e))
        WHERE rank <= 4""",
    "numbered_turns": """
        SELECT n.session_id, n.role, n.content,
               CAST(coalesce(l.turn, -1) + row_number() OVER (PARTITION BY n.session_id ORDER BY n.turn) AS INT) AS turn
        FROM agent_conversation n
        LEFT JOIN (SELECT session_id, max(turn) AS turn FROM agent_conversation GROUP BY ALL) l USING (session_id)""",
    # Reconciliation.
    "last_day_hours": f"SELECT * FROM hourly WHERE hour_window BETWEEN {days(1)} AND {AS_OF}",
    "last_day_nodes": f"SELECT * FROM node_timeline WHERE start_time BETWEEN {days(1)} AND {AS_OF}",
    "busiest": """
        SELECT cluster_id, workspace_id, CAST(sum(node_count) AS BIGINT) AS node_hours, max(hour_window) AS latest_hour,
               avg(avg_cpu_pct) AS fea_cpu, avg(avg_mem_pct) AS fea_mem
        FROM last_day_hours GROUP BY ALL ORDER BY node_hours DESC, cluster_id, workspace_id LIMIT 5""",
    "dearest": f"""
        SELECT workspace_id, job_id, max(job_name) AS job_name FROM month_trend GROUP BY ALL
        ORDER BY {r('sum(daily_cost_usd)', 6)} DESC, workspace_id, job_id LIMIT 5""",
    "job_spots": f"""
        SELECT *, abs(src_runs - fea_runs) / greatest(src_runs, 1) < 0.02
                    AND abs(src_failed - fea_failed) <= greatest(1.0E0, src_failed * 0.05E0)
                    AND abs(src_avg_secs - fea_avg_secs) < 30 AS agrees
        FROM (SELECT d.workspace_id, d.job_id, d.job_name, coalesce(s.n, 0) AS src_runs,
                     coalesce(h.total_runs, 0) AS fea_runs, coalesce(s.failed, 0) AS src_failed,
                     coalesce(h.failed_runs, 0) AS fea_failed, coalesce(s.secs, 0) AS src_avg_secs,
                     coalesce(CAST({r('h.avg_duration_secs', 0)} AS BIGINT), 0) AS fea_avg_secs
              FROM dearest d
              LEFT JOIN (SELECT workspace_id, job_id, count(*) AS n,
                                count(*) FILTER (result_state = 'FAILED') AS failed,
                                CAST({r('avg(duration_secs)', 0)} AS BIGINT) AS secs
                         FROM completed GROUP BY ALL) s USING (workspace_id, job_id)
              LEFT JOIN health h USING (workspace_id, job_id))""",
    "cluster_spots": f"""
        SELECT *, abs(src_nodes - fea_nodes) <= 1 AND abs(src_avg_cpu - fea_avg_cpu) < 3 AS agrees
        FROM (SELECT b.cluster_id, b.workspace_id, b.latest_hour, coalesce(s.n, 0) AS src_nodes,
                     coalesce(h.node_count, 0) AS fea_nodes, coalesce(s.cpu, 0) AS src_avg_cpu,
                     coalesce({r('h.avg_cpu_pct', 1)}, 0) AS fea_avg_cpu
              FROM busiest b
              LEFT JOIN (SELECT n.cluster_id, n.workspace_id, date_trunc('hour', n.start_time) AS hour,
                                count(DISTINCT n.instance_id) AS n, {r('avg(n.cpu_user_percent)', 1)} AS cpu
                         FROM last_day_nodes n GROUP BY ALL) s
                ON s.cluster_id = b.cluster_id AND s.workspace_id = b.workspace_id AND s.hour = b.latest_hour
              LEFT JOIN hourly h
                ON h.cluster_id = b.cluster_id AND h.workspace_id = b.workspace_id AND h.hour_window = b.latest_hour)""",
    "cost_spots": f"""
        SELECT *, abs(src_usd - fea_usd) / greatest(src_usd, 1) < 0.01 AS agrees
        FROM (SELECT d.workspace_id, d.job_id, d.job_name, coalesce(s.usd, 0) AS src_usd,
                     coalesce({r('t.daily_cost_usd', 2)}, 0) AS fea_usd
              FROM dearest d
              LEFT JOIN (SELECT workspace_id, job_id, {r('sum(cost_usd)', 2)} AS usd FROM priced_usage
                         WHERE usage_date = {days(1)} GROUP BY ALL) s USING (workspace_id, job_id)
              LEFT JOIN (FROM trend WHERE usage_date = {days(1)}) t USING (workspace_id, job_id))""",
}


def check(check_id: str, severity: str, measured: str, passes: str, tolerance: float, summary: str, source: str) -> str:
    return f"""
        SELECT '{check_id}' AS check_id, '{severity}' AS severity,
               CASE WHEN m {passes} {tolerance} THEN 'PASS' ELSE 'FAIL' END AS status,
               {r('m', 6)} AS measured, CAST({tolerance} AS DOUBLE) AS tolerance, '{summary}' AS summary
        FROM (SELECT CAST({measured} AS DOUBLE) AS m FROM {source})"""


OUTSIDE = "(week AND {0} NOT BETWEEN 0 AND 100)"
UTILIZATION_BAD = " + ".join(
    f"count(*) FILTER ({OUTSIDE.format(c)})" for c in ("avg_cpu_pct", "peak_cpu_pct", "avg_mem_pct", "peak_mem_pct")
)
CHECKS = {
    "C1": check("C1", "high", "abs(src - fea) / greatest(src, 1)", "<", 0.02, "hourly row count against source",
                "(SELECT (SELECT count(*) FROM (SELECT DISTINCT cluster_id, workspace_id, date_trunc('hour', start_time)"
                " FROM last_day_nodes)) AS src, (SELECT count(*) FROM last_day_hours) AS fea)"),
    "C2": check("C2", "high", f"{UTILIZATION_BAD} + count(*) FILTER (week AND node_count < 0)"
                " + count(*) FILTER (week AND node_type_count > node_count)", "<=", 0, "utilisation within bounds",
                f"(SELECT *, hour_window BETWEEN {days(7)} AND {AS_OF} AS week FROM hourly)"),
    "C3": check("C3", "medium", "CASE WHEN count(*) > 0 THEN 0 END", "<", 60, "minutes since utilisation refresh",
                "hourly"),
    "C4": check("C4", "high", "count(*) FILTER (cluster_id IS NULL) + count(*) FILTER (workspace_id IS NULL)"
                " + count(*) FILTER (hour_window IS NULL)", "<=", 0, "no null utilisation keys", "hourly"),
    "C5": check("C5", "high", "max(greatest(abs(s.cpu - b.fea_cpu), abs(s.mem - b.fea_mem)))", "<", 2,
                "busiest cluster means against source",
                "(FROM busiest ORDER BY node_hours DESC, cluster_id, workspace_id LIMIT 1) b JOIN (SELECT cluster_id,"
                " workspace_id, avg(cpu_user_percent) AS cpu, avg(mem_used_percent) AS mem FROM last_day_nodes"
                " GROUP BY ALL) s USING (cluster_id, workspace_id)"),
    "J1": check("J1", "critical", "abs(src - fea) / greatest(src, 1)", "<", 0.005, "yesterday''s cost against source",
                f"(SELECT (SELECT coalesce(sum(cost_usd), 0) FROM priced_usage WHERE job_id IS NOT NULL AND usage_date ="
                f" {days(1)}) AS src, (SELECT coalesce(sum(daily_cost_usd), 0) FROM trend WHERE usage_date ="
                f" {days(1)}) AS fea)"),
    "J2": check("J2", "critical", "coalesce(max(n), 0)", "<=", 1, "one row per job and day",
                "(SELECT count(*) AS n FROM trend GROUP BY workspace_id, job_id, usage_date)"),
    "J3": check("J3", "high", "count(*) FILTER (daily_cost_usd < 0) + count(*) FILTER (rolling_14d_avg < 0)", "<=", 0,
                "no negative cost", "trend"),
    "J4": check("J4", "medium", f"{TODAY} - max(usage_date)", "<=", 2, "days since last cost", "trend"),
    "J5": check("J5", "high", f"count(*) FILTER (usage_date BETWEEN {days(30)} AND {TODAY} AND rolling_14d_avg > 0"
                " AND abs(cost_growth_pct) > 10)", "<=", 0, "rows with extreme growth", "trend"),
    "H1": check("H1", "high", "coalesce(max(n), 0)", "<=", 1, "one row per job",
                "(SELECT count(*) AS n FROM health GROUP BY workspace_id, job_id)"),
    "H2": check("H2", "critical", "abs(src - fea) / greatest(src, 1)", "<", 0.001, "total runs against source",
                "(SELECT (SELECT count(*) FROM completed) AS src, (SELECT sum(total_runs) FROM health) AS fea)"),
    "H3": check("H3", "critical", "abs(src - fea)", "<=", 1, "failed runs against source",
                "(SELECT (SELECT count(*) FROM completed WHERE result_state = 'FAILED') AS src,"
                " (SELECT sum(failed_runs) FROM health) AS fea)"),
    "H4": check("H4", "high", "count(*) FILTER (failure_rate NOT BETWEEN 0 AND 1)"
                " + count(*) FILTER (failed_runs > total_runs) + count(*) FILTER (avg_duration_secs < 0)"
                " + count(*) FILTER (max_duration_secs < avg_duration_secs)"
                " + count(*) FILTER (stddev_duration < 0)", "<=", 0, "health within bounds", "health"),
    "H5": check("H5", "high", "count(*) FILTER (avg_duration_secs > 86400)", "<=", 0,
                "jobs with mean duration above a day", "health"),
    "H6": check("H6", "medium", "CASE WHEN count(*) > 0 THEN 0 END", "<", 60, "minutes since health refresh", "health"),
    "A1": check("A1", "high", "count(*) FILTER (status IS NULL OR status NOT IN ('proposed', 'approved', 'applied',"
                " 'rejected'))", "<=", 0, "rows with an unknown status", "agent_action_log"),
    "A2": check("A2", "high", f"count(*) FILTER (projected_savings < 0) + count(*) FILTER (action_timestamp > {AS_OF})"
                " + count(*) FILTER (action_id IS NULL OR target_id IS NULL)", "<=", 0, "actions within bounds",
                "agent_action_log"),
    "A3": check("A3", "medium", "count(*) FILTER (details IS NOT NULL AND NOT json_valid(details))", "<=", 0,
                "rows whose details are not JSON", "agent_action_log"),
    "S1": check("S1", "critical", "count(*) FILTER (NOT agrees)", "<=", 0, "dearest jobs against run source",
                "job_spots"),
    "S2": check("S2", "high", "count(*) FILTER (NOT agrees)", "<=", 0, "busiest clusters against node source",
                "cluster_spots"),
    "S3": check("S3", "critical", "count(*) FILTER (NOT agrees)", "<=", 0, "dearest jobs against usage source",
                "cost_spots"),
    "X1": check("X1", "high", "coalesce(sum(total_runs), 0)", ">", 0, "runs of the dearest job",
                "health WHERE (job_name, workspace_id) IN (SELECT (job_name, workspace_id) FROM top_names"
                " ORDER BY mtd_cost DESC, job_name NULLS FIRST, workspace_id LIMIT 1)"),
    "X2": check("X2", "medium", "count(*) FILTER (avg_cpu_7d > 30 OR avg_mem_7d > 40)", "<=", 0,
                "over-provisioned clusters above a threshold", "over_provisioned"),
}
CTES["all_checks"] = " UNION ALL ".join(CHECKS.values())

TREND = "workspace_id, job_id, job_name, usage_date, daily_cost_usd, rolling_14d_avg, cost_growth_pct"
HOURLY = f"""cluster_id, workspace_id, hour_window, {r('avg_cpu_pct', 4)} AS avg_cpu_pct,
             {r('peak_cpu_pct', 4)} AS peak_cpu_pct, {r('avg_mem_pct', 4)} AS avg_mem_pct,
             {r('peak_mem_pct', 4)} AS peak_mem_pct, node_count, node_type_count"""


def minutes(column: str) -> str:
    return r(f"{column} / 60", 1)


# The queries.
SQL = {
    "latest_jobs": "FROM latest_jobs",
    "latest_clusters": "FROM latest_clusters",
    "live_clusters": "FROM live_clusters",
    "last_undeleted_clusters": """
        SELECT * FROM clusters WHERE delete_time IS NULL
        QUALIFY row_number() OVER (
          PARTITION BY cluster_id, workspace_id
          ORDER BY change_time DESC, cluster_name DESC, cluster_source DESC, worker_node_type DESC,
                   min_workers DESC, max_workers DESC) = 1""",
    "priced_usage": f"""
        SELECT * REPLACE ({r('unit_price', 4)} AS unit_price, {r('cost_usd', 4)} AS cost_usd) FROM priced_usage""",
    "cluster_hourly_utilization": f"SELECT {HOURLY} FROM hourly",
    "job_daily_cost": f"SELECT * REPLACE ({r('daily_cost_usd', 4)} AS daily_cost_usd) FROM daily_cost",
    "job_cost_trend": f"SELECT {TREND} FROM trend4",
    "job_cost_trend_calendar": f"""
        SELECT workspace_id, job_id, job_name, usage_date, {r('daily_cost_usd', 4)} AS daily_cost_usd,
               {r('avg(daily_cost_usd) OVER (w RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)', 4)}
                 AS rolling_14d_avg,
               {r('''daily_cost_usd / nullif(avg(daily_cost_usd) OVER (
                    w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) - 1''', 4)}
                 AS cost_growth_pct
        FROM daily_cost WINDOW w AS (PARTITION BY workspace_id, job_id ORDER BY usage_date)""",
    "job_runs_collapsed": "FROM collapsed",
    "job_runs_last_state": f"""
        SELECT workspace_id, job_id, run_id, min(period_start_time) AS run_start, max(period_end_time) AS run_end,
               arg_max(result_state, period_end_time) FILTER (result_state IS NOT NULL) AS result_state
        FROM job_run_timeline WHERE period_start_time BETWEEN {days(30)} AND {AS_OF} GROUP BY ALL""",
    "completed_runs": "FROM completed",
    "job_health": f"""
        SELECT * REPLACE ({r('avg_duration_secs', 3)} AS avg_duration_secs,
                          {r('stddev_duration', 3)} AS stddev_duration) FROM health""",
    "underutilized_clusters": f"""
        SELECT cluster_id, workspace_id, hours_observed, {r('cpu', 1)} AS avg_cpu, {r('mem', 1)} AS avg_mem,
               {r('nodes', 1)} AS avg_nodes, {r('types', 1)} AS avg_node_types
        FROM (SELECT cluster_id, workspace_id, count(*) AS hours_observed, avg(avg_cpu_pct) AS cpu,
                     avg(avg_mem_pct) AS mem, avg(node_count) AS nodes, avg(node_type_count) AS types
              FROM week_hours GROUP BY ALL)
        WHERE cpu < 30 AND mem < 40 ORDER BY cpu, cluster_id, workspace_id LIMIT 20""",
    "top_cost_spikes": f"""
        SELECT workspace_id, job_id, job_name, usage_date, {r('daily_cost_usd', 2)} AS daily_cost,
               {r('rolling_14d_avg', 2)} AS avg_14d, {r('cost_growth_pct * 100', 1)} AS growth_pct
        FROM trend WHERE usage_date BETWEEN {days(7)} AND {TODAY} AND cost_growth_pct > 0.25
        ORDER BY cost_growth_pct DESC, workspace_id, job_id, usage_date LIMIT 20""",
    "unreliable_jobs": f"""
        SELECT workspace_id, job_id, job_name, total_runs, failed_runs,
               {r('failure_rate * 100', 1)} AS failure_rate_pct, {r('avg_duration_secs', 0)} AS avg_duration_s,
               {r('stddev_duration', 0)} AS stddev_s, {r('max_duration_secs', 0)} AS max_duration_s
        FROM health WHERE total_runs >= 5 ORDER BY failure_rate DESC, workspace_id, job_id LIMIT 20""",
    "latest_run_anomalies": f"""
        SELECT workspace_id, job_id, job_name, latest_secs AS latest_duration_s,
               {r('avg_duration_secs', 0)} AS avg_s, {r('threshold_secs', 0)} AS threshold_s
        FROM slow ORDER BY z DESC, workspace_id, job_id LIMIT 20""",
    "cost_spikes": f"""
        SELECT {TREND} FROM trend4 SEMI JOIN spikes USING (workspace_id, job_id, usage_date)""",
    "spike_cause_config": """
        SELECT workspace_id, job_id, usage_date, cluster_name, change_time, worker_node_type, min_workers, max_workers
        FROM spikes JOIN reconfigured USING (workspace_id, job_id)""",
    "spike_cause_volume": f"""
        SELECT workspace_id, job_id, usage_date, this_week_dbus, last_week_dbus, {r('growth_pct', 4)} AS growth_pct
        FROM spikes JOIN grown USING (workspace_id, job_id)""",
    "spike_cause_compute": """
        SELECT workspace_id, job_id, usage_date FROM spikes SEMI JOIN interactive USING (workspace_id, job_id)""",
    "spike_explanations": f"""
        SELECT * REPLACE ({r('daily_cost_usd', 4)} AS daily_cost_usd, {r('cost_growth_pct', 4)} AS cost_growth_pct)
        FROM explained""",
    "cost_spike_actions": "FROM spike_actions",
    "low_utilization_rows": f"""
        SELECT * REPLACE ({r('avg_cpu_pct', 4)} AS avg_cpu_pct, {r('avg_mem_pct', 4)} AS avg_mem_pct) FROM low_rows""",
    "low_utilization_streaks": """
        SELECT cluster_id, workspace_id, min(hour_window) AS streak_start, max(hour_window) AS streak_end,
               count(*) AS streak_hours
        FROM (SELECT *, hour_window - to_hours(CAST(row_number() OVER (
                       PARTITION BY cluster_id, workspace_id ORDER BY hour_window) AS INT)) AS island
              FROM two_days WHERE avg_cpu_pct < 30 AND avg_mem_pct < 40)
        GROUP BY cluster_id, workspace_id, island""",
    "overprovisioned_clusters": "FROM overprovisioned",
    "right_sizing": f"""
        SELECT * REPLACE ({r('reduction_pct', 4)} AS reduction_pct,
                          {r('estimated_monthly_savings', 2)} AS estimated_monthly_savings) FROM right_sized""",
    "right_sizing_p95": f"""
        SELECT c.cluster_id, c.workspace_id, c.cluster_name, {r('p.cpu', 4)} AS p95_cpu, {r('p.mem', 4)} AS p95_mem,
               c.current_max,
               greatest(1, CAST(ceil(c.current_max * (greatest(p.cpu, p.mem) / 100 * 1.25E0) - 1e-9) AS BIGINT))
                 AS optimal_max
        FROM current_size c
        JOIN (SELECT cluster_id, workspace_id, quantile_cont(avg_cpu_pct, 0.95) AS cpu,
                     quantile_cont(avg_mem_pct, 0.95) AS mem FROM two_days GROUP BY ALL) p
          USING (cluster_id, workspace_id)""",
    "right_sizing_actions": "FROM sizing_actions",
    "right_sizing_details": f"""
        SELECT workspace_id, cluster_id AS target_id, CAST(current_min AS BIGINT) AS current_min,
               CAST(current_max AS BIGINT) AS current_max, CAST(optimal_min AS BIGINT) AS recommended_min,
               CAST(optimal_max AS BIGINT) AS recommended_max, avg_cpu AS avg_cpu_pct, avg_mem AS avg_mem_pct,
               {r('reduction_pct * 100', 1)} AS reduction_pct FROM right_sized""",
    "jobs_on_interactive_compute": "FROM wrong_compute",
    "idle_clusters": "FROM idle",
    "zero_task_clusters": "FROM no_tasks",
    "waste_items": "FROM waste",
    "top_waste_actions": "FROM top_waste",
    "waste_actions": "FROM waste_actions",
    "workspace_daily_spend": f"SELECT * REPLACE ({r('daily_cost_usd', 4)} AS daily_cost_usd) FROM daily_spend",
    "budget_projection": "FROM projection",
    "budget_projection_calendar": f"""
        SELECT workspace_id, {r('mtd', 2)} AS mtd_spend, CAST(31 AS BIGINT) AS calendar_days_elapsed,
               CAST(31 AS BIGINT) AS days_in_month, {r('mtd / 31 * 31', 2)} AS calendar_projection FROM mtd""",
    "spend_by_tag": f"""
        SELECT workspace_id, team_tag, {r('sum(cost_usd)', 2)} AS mtd_spend
        FROM month_usage WHERE team_tag IS NOT NULL GROUP BY ALL""",
    "budget_guardrail": f"""
        SELECT workspace_id, linear_projection, budget, {r('budget_pct', 4)} AS budget_pct, severity FROM guardrail""",
    "budget_top_drivers": "FROM drivers",
    "budget_actions": "FROM budget_actions",
    "all_actions": "FROM all_actions",
    "alerts": f"""
        SELECT 'Budget Alert: ' || {whole('budget_pct')} || '% of Budget' AS title, description AS message, severity,
               CAST(json_object('Workspace', workspace_id, 'MTD Spend', {dollars('mtd_spend')},
                                'Projected', {dollars('linear_projection')}, 'Budget', {dollars('budget')}) AS VARCHAR)
                 AS details
        FROM budget_alerts
        UNION ALL
        SELECT 'Wasteful Compute Report',
               'Found ' || n || ' optimization(s). Top 5 save ~$' || {whole('s')} || '/week.', 'warning',
               CAST(json_object('Total items', CAST(n AS VARCHAR), 'Est. weekly savings', '$' || {whole('s')})
                 AS VARCHAR)
        FROM (SELECT (SELECT count(*) FROM waste) AS n, (SELECT sum(weekly_savings) FROM top_waste) AS s)
        WHERE n > 0""",
    "cost_monthly_summary": f"""
        SELECT date_trunc('month', CAST(usage_date AS TIMESTAMP)) AS month, {r('sum(cost_usd)', 2)} AS total_spend_usd,
               count(DISTINCT workspace_id) AS workspaces, count(DISTINCT job_id) AS unique_jobs
        FROM priced_usage WHERE usage_date BETWEEN DATE '2023-07-31' AND {TODAY} GROUP BY ALL""",
    "cost_current_month_trajectory": f"""
        SELECT usage_date, daily_spend, {r('cumulative_spend', 2)} AS cumulative_spend,
               {r('rolling_7d_avg', 4)} AS rolling_7d_avg FROM trajectory""",
    "cost_top_drivers_mtd": "FROM top_names",
    "cost_savings_captured": f"""
        SELECT skill_name, action_type, count(*) AS actions_count,
               count(*) FILTER (status = 'applied') AS applied_count,
               {r('sum(projected_savings)', 2)} AS total_projected_savings FROM month_log GROUP BY ALL""",
    "cost_by_sku": f"""
        SELECT sku_name, billing_origin_product, {r('sum(cost_usd)', 2)} AS mtd_spend,
               {r('sum(usage_quantity)', 0)} AS total_dbus
        FROM month_usage GROUP BY ALL ORDER BY mtd_spend DESC, sku_name, billing_origin_product LIMIT 15""",
    "cluster_utilization_heatmap": f"""
        SELECT cluster_id, CAST(hour_window AS DATE) AS day, CAST(hour(hour_window) AS INT) AS hour_of_day,
               {r('avg(avg_cpu_pct)', 1)} AS avg_cpu, {r('avg(avg_mem_pct)', 1)} AS avg_mem
        FROM week_hours GROUP BY ALL""",
    "cluster_over_provisioned": "FROM over_provisioned",
    "cluster_idle_summary": f"""
        SELECT workspace_id, count(DISTINCT cluster_id) AS total_clusters,
               count(*) FILTER (avg_cpu_pct < 5) AS idle_observations,
               {r('avg(node_count)', 1)} AS avg_nodes_across_all,
               {r('coalesce(sum(node_count) FILTER (avg_cpu_pct < 5), 0) / nullif(sum(node_count), 0) * 100', 1)}
                 AS idle_node_pct
        FROM week_hours GROUP BY ALL""",
    "cluster_size_distribution": """
        SELECT CASE WHEN max_workers <= 2 THEN 'Small (1-2)' WHEN max_workers <= 8 THEN 'Medium (3-8)'
                    WHEN max_workers <= 20 THEN 'Large (9-20)' ELSE 'XLarge (20+)' END AS cluster_size_bucket,
               count(DISTINCT cluster_id) AS cluster_count
        FROM live_clusters GROUP BY ALL""",
    "job_reliability_overall": f"""
        SELECT count(*) AS total_jobs, CAST(sum(total_runs) AS BIGINT) AS total_runs,
               CAST(sum(failed_runs) AS BIGINT) AS total_failures,
               {r('(1 - sum(failed_runs) / nullif(sum(total_runs), 0)) * 100', 2)} AS overall_success_rate_pct,
               {r('avg(failure_rate) * 100', 2)} AS avg_failure_rate_pct
        FROM health""",
    "job_daily_failure_trend": f"""
        SELECT CAST(run_start AS DATE) AS run_date, count(*) AS total_runs,
               count(*) FILTER (result_state = 'FAILED') AS failures,
               {r("count(*) FILTER (result_state = 'FAILED') * 100 / count(*)", 2)} AS failure_rate_pct
        FROM collapsed WHERE result_state IS NOT NULL GROUP BY ALL""",
    "job_most_unreliable": f"""
        SELECT job_name, workspace_id, total_runs, failed_runs, {r('failure_rate * 100', 1)} AS failure_rate_pct,
               {minutes('avg_duration_secs')} AS avg_duration_min, {minutes('max_duration_secs')} AS max_duration_min
        FROM health WHERE total_runs >= 5 ORDER BY failure_rate DESC, workspace_id, job_id LIMIT 15""",
    "job_sla_breaches": f"""
        SELECT job_name, workspace_id, total_runs, {minutes('avg_duration_secs')} AS avg_duration_min,
               {minutes('max_duration_secs')} AS max_duration_min, total_runs AS est_sla_breaches
        FROM health WHERE avg_duration_secs > 3600 ORDER BY avg_duration_secs DESC, workspace_id, job_id LIMIT 15""",
    "job_sla_breach_runs": """
        SELECT workspace_id, job_id, count(*) AS total_runs, count(*) FILTER (duration_secs > 3600) AS sla_breaches
        FROM completed GROUP BY ALL HAVING count(*) FILTER (duration_secs > 3600) > 0""",
    "job_duration_anomalies": f"""
        SELECT job_name, workspace_id, {minutes('latest_secs')} AS latest_duration_min,
               {minutes('avg_duration_secs')} AS avg_duration_min, {minutes('threshold_secs')} AS threshold_min,
               {r('z', 1)} AS z_score
        FROM slow ORDER BY z DESC, workspace_id, job_id LIMIT 15""",
    "agent_activity_mtd": f"""
        SELECT skill_name, action_type, count(*) AS total_actions, count(*) FILTER (status = 'applied') AS applied,
               count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'rejected') AS rejected,
               {r('sum(projected_savings)', 2)} AS total_projected_savings
        FROM month_log GROUP BY ALL""",
    "agent_monthly_savings_trend": f"""
        SELECT date_trunc('month', action_timestamp) AS month, {r('sum(projected_savings)', 2)} AS total_savings,
               count(*) AS total_actions, count(*) FILTER (status = 'applied') AS applied_actions
        FROM agent_action_log GROUP BY ALL""",
    "agent_recent_actions": f"""
        SELECT action_timestamp, skill_name, action_type, target_name, description,
               {r('projected_savings', 2)} AS savings, status
        FROM agent_action_log ORDER BY action_timestamp DESC, action_id LIMIT 50""",
    "agent_savings_by_skill": f"""
        SELECT skill_name, {r('sum(projected_savings)', 2)} AS total_savings, count(*) AS action_count
        FROM month_log GROUP BY ALL""",
    "monthly_digest": "FROM digest",
    "monthly_digest_text": """
        SELECT CASE WHEN total_actions > 0 THEN
                 'This month, ' || total_actions || ' actions were recorded across ' || unique_targets
                 || ' resources using ' || skills_used || ' skills. ' || applied
                 || ' action(s) were applied. Projected savings: $'
                 || format('{:,}', CAST(coalesce(total_savings, 0) AS BIGINT))
               ELSE 'No agent actions recorded this month yet.' END AS digest
        FROM digest""",
    "month_over_month_to_date": f"""
        SELECT workspace_id, {r('a', 2)} AS this_month_spend, {r('b', 2)} AS last_month_spend,
               {r('(a / nullif(b, 0) - 1) * 100', 1)} AS change_pct
        FROM (SELECT workspace_id, sum(cost_usd) FILTER (usage_date >= {MONTH}) AS a,
                     sum(cost_usd) FILTER (usage_date < {MONTH}) AS b
              FROM priced_usage WHERE usage_date BETWEEN DATE '2023-12-01' AND {TODAY} GROUP BY ALL)""",
    "cumulative_vs_budget": f"""
        SELECT usage_date, {r('cumulative_spend', 2)} AS cumulative_spend, 50000.0E0 AS budget,
               {r('cumulative_spend / 50000.0E0 * 100', 1)} AS budget_used_pct,
               {r('50000.0E0 - cumulative_spend', 2)} AS remaining
        FROM trajectory""",
    "workspace_spend_rank": f"""
        SELECT workspace_id, {r('sum(daily_cost_usd)', 2)} AS mtd_spend FROM daily_spend GROUP BY ALL""",
    "cluster_resizes": f"""
        SELECT cluster_id, workspace_id, cluster_name, change_time, old_min, old_max, min_workers AS new_min,
               max_workers AS new_max
        FROM (SELECT *, lag(min_workers) OVER w AS old_min, lag(max_workers) OVER w AS old_max,
                     lag(1) OVER w AS has_old
              FROM clusters WHERE change_time <= {AS_OF} WINDOW w AS (
                PARTITION BY cluster_id, workspace_id
                ORDER BY change_time, cluster_name, min_workers, max_workers))
        WHERE change_time >= {days(7)} AND has_old = 1
          AND (old_min IS DISTINCT FROM min_workers OR old_max IS DISTINCT FROM max_workers)""",
    "jobs_above_failure_rate": """
        SELECT workspace_id, job_id, job_name, total_runs, failed_runs, failure_rate FROM health
        WHERE failure_rate > 0.10""",
    "job_duration_percentiles": f"""
        SELECT workspace_id, job_id, count(*) AS total_runs, min(duration_secs) AS min_secs,
               {r('quantile_cont(duration_secs, 0.5)', 2)} AS p50, {r('quantile_cont(duration_secs, 0.9)', 2)} AS p90,
               {r('quantile_cont(duration_secs, 0.95)', 2)} AS p95, {r('quantile_cont(duration_secs, 0.99)', 2)} AS p99,
               max(duration_secs) AS max_secs
        FROM completed GROUP BY ALL""",
    "budget_exhaustion_date": f"""
        SELECT workspace_id, mtd_spend, avg_daily_spend, budget,
               {TODAY} + greatest(0, CAST(ceil((budget - mtd_spend) / nullif(avg_daily_spend, 0)) AS INT))
                 AS exhausted_on
        FROM budget_use""",
    "budget_risk_rank": f"""
        SELECT workspace_id, linear_projection, budget, {r('budget_pct', 1)} AS budget_pct FROM budget_use""",
    "total_waste": f"""
        SELECT category, count(*) AS items, {r('sum(weekly_savings)', 2)} AS weekly_savings
        FROM waste GROUP BY ALL""",
    "cluster_job_profile": f"""
        SELECT h.cluster_id, h.workspace_id, h.avg_cpu, h.avg_mem, h.avg_nodes, t.job_id, j.job_name, t.runs
        FROM (SELECT cluster_id, workspace_id, {r('avg(avg_cpu_pct)', 1)} AS avg_cpu,
                     {r('avg(avg_mem_pct)', 1)} AS avg_mem, {r('avg(node_count)', 1)} AS avg_nodes
              FROM week_hours GROUP BY ALL) h
        JOIN (SELECT workspace_id, job_id, compute_id, count(DISTINCT run_id) AS runs FROM job_task_run_timeline
              WHERE period_start_time BETWEEN {days(7)} AND {AS_OF} GROUP BY ALL) t
          ON t.compute_id = h.cluster_id AND t.workspace_id = h.workspace_id
        LEFT JOIN latest_jobs j ON j.workspace_id = t.workspace_id AND j.job_id = t.job_id""",
    "unreliable_and_expensive": f"""
        SELECT workspace_id, job_id, job_name, failure_rate, {r('cost', 2)} AS mtd_cost,
               {r('cost * failure_rate', 2)} AS failed_cost
        FROM health JOIN (SELECT workspace_id, job_id, sum(daily_cost_usd) AS cost FROM month_trend GROUP BY ALL)
          USING (workspace_id, job_id)
        WHERE total_runs >= 5 ORDER BY failed_cost DESC, workspace_id, job_id LIMIT 20""",
    "workspace_comparison": f"""
        SELECT workspace_id, {r('spend', 2)} AS mtd_spend, {r('cpu', 1)} AS avg_cpu, {r('mem', 1)} AS avg_mem,
               CAST(runs AS BIGINT) AS total_runs, CAST(failed AS BIGINT) AS failed_runs,
               {r('failed / nullif(runs, 0) * 100', 2)} AS failure_rate_pct
        FROM (SELECT workspace_id, sum(daily_cost_usd) AS spend FROM daily_spend GROUP BY ALL)
        FULL JOIN (SELECT workspace_id, avg(avg_cpu_pct) AS cpu, avg(avg_mem_pct) AS mem FROM week_hours GROUP BY ALL)
          USING (workspace_id)
        FULL JOIN (SELECT workspace_id, sum(total_runs) AS runs, sum(failed_runs) AS failed FROM health GROUP BY ALL)
          USING (workspace_id)""",
    "applied_ratio": f"""
        SELECT applied, proposed, {r('applied / nullif(proposed, 0)', 4)} AS applied_to_proposed
        FROM (SELECT count(*) FILTER (status = 'applied') AS applied,
                     count(*) FILTER (status = 'proposed') AS proposed FROM agent_action_log)""",
    **{f"recon_{check_id.lower()}": text for check_id, text in CHECKS.items()},
    "recon_summary": """
        SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed,
               count(*) FILTER (status = 'FAIL') AS failed,
               count(*) FILTER (status = 'FAIL' AND severity = 'critical') AS critical_failed
        FROM all_checks""",
    "job_spot_check": "FROM job_spots",
    "cluster_spot_check": "FROM cluster_spots",
    "job_cost_spot_check": "FROM cost_spots",
    "long_running_jobs": f"""
        SELECT workspace_id, job_id, job_name, {r('avg_duration_secs / 3600', 1)} AS avg_hours FROM health
        WHERE avg_duration_secs > 3600 ORDER BY avg_duration_secs DESC, workspace_id, job_id LIMIT 20""",
    "assign_turns": "FROM numbered_turns",
    "append_turns": f"""
        SELECT session_id, turn, role, content, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_args,
               CAST(NULL AS VARCHAR) AS tool_result, CAST(NULL AS VARCHAR) AS user_id, {AS_OF} AS ts
        FROM numbered_turns""",
    "recent_turns": """
        SELECT * FROM agent_conversation
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4""",
    "recent_actions_filtered": """
        SELECT * FROM agent_action_log WHERE skill_name = 'budget_forecast'
        ORDER BY action_timestamp DESC, action_id LIMIT 20""",
    "upsert_documents": "FROM merged_docs",
    "changed_documents": """
        SELECT doc_id, title, content, source, tags FROM merged_docs m
        WHERE NOT EXISTS (FROM knowledge_docs k WHERE k.doc_id = m.doc_id AND k.title = m.title
                            AND k.content = m.content AND k.source = m.source AND k.tags = m.tags)""",
    "documents_by_tag": """
        SELECT * FROM knowledge_docs WHERE source = 'src1' AND list_contains(string_split(tags, ','), 'en')""",
    "label_centroids": f"SELECT query_id, CAST(position AS INT) AS position, {r('x', 6)} AS x FROM centroids",
    "semantic_topk": "FROM hits",
    "semantic_search": """
        SELECT h.*, k.title, k.content, k.source, k.tags
        FROM hits h LEFT JOIN knowledge_docs k ON k.doc_id = CAST(h.doc_id AS VARCHAR)""",
    "stream_hourly_utilization": f"""
        SELECT {HOURLY} FROM (
          SELECT cluster_id, workspace_id, date_trunc('hour', start_time) AS hour_window,
                 avg(cpu_user_percent) AS avg_cpu_pct, max(cpu_user_percent) AS peak_cpu_pct,
                 avg(mem_used_percent) AS avg_mem_pct, max(mem_used_percent) AS peak_mem_pct,
                 count(DISTINCT instance_id) AS node_count, count(DISTINCT node_type) AS node_type_count
          FROM node_timeline GROUP BY ALL)""",
    "stream_runs_collapsed": """
        SELECT workspace_id, job_id, run_id, min(period_start_time) AS run_start, max(period_end_time) AS run_end,
               max(result_state) AS result_state FROM job_run_timeline GROUP BY ALL""",
    "stream_changed_documents": "SELECT doc_id, title, content, source, tags FROM knowledge_docs",
}

STALE = CHECKS["C3"].replace("count(*) > 0 THEN 0", "count(*) > 0 THEN 1440")
SQL |= {
    "recon_damaged": " UNION ALL ".join(
        [
            CHECKS["C1"].replace("FROM last_day_hours", "FROM last_day_hours WHERE cluster_id <> '3'"),
            STALE,
            CHECKS["J1"].replace("sum(daily_cost_usd)", "sum(daily_cost_usd * 1.5E0)"),
            CHECKS["H2"].replace("sum(total_runs)", "sum(total_runs * 2)"),
            check("X2", "medium", "count(*) FILTER (cpu IS NULL OR cpu > 30 OR mem > 40)", "<=", 0,
                  "over-provisioned clusters above a threshold",
                  "(SELECT DISTINCT cluster_id, workspace_id FROM hourly) LEFT JOIN (SELECT cluster_id, workspace_id,"
                  " avg(avg_cpu_pct) AS cpu, avg(avg_mem_pct) AS mem FROM week_hours GROUP BY ALL)"
                  " USING (cluster_id, workspace_id)"),
        ]
    ),
    "stored_trend": f"SELECT {TREND}, {AS_OF} AS updated_at FROM trend4",
    "stored_checks": f"""
        SELECT *, 'fast' AS mode, {AS_OF} AS checked_at FROM all_checks
        WHERE check_id IN ('C2', 'C3', 'C4', 'J2', 'J3', 'J4', 'H1', 'H4', 'H6', 'A1', 'A2', 'A3')""",
    "days_of_utilization": SQL["cluster_hourly_utilization"],
    "days_of_trend": SQL["job_cost_trend"],
    "stored_findings": SQL["all_actions"],
    "stored_actions": f"""
        SELECT sha256(concat_ws('|', skill_name, workspace_id, target_id, '2024-01-31', action_type, description))
                 AS action_id,
               {AS_OF} AS action_timestamp, * EXCLUDE (action_id, action_timestamp)
               REPLACE ({r('projected_savings', 2)} AS projected_savings)
        FROM agent_action_log""",
    "stored_turns": """
        SELECT session_id, CAST(t + batch * n AS INT) AS turn, role, content
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS t,
                     count(*) OVER (PARTITION BY session_id) AS n FROM agent_conversation), range(2) AS b(batch)""",
    "stored_documents": SQL["upsert_documents"],
    "stored_index_search": SQL["semantic_topk"],
    "stored_search": SQL["semantic_search"].replace("knowledge_docs", "merged_docs"),
    "stored_report": SQL["cost_by_sku"],
}


def _names_in(text: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", text)) & CTES.keys()


def with_inputs(text: str) -> str:
    """``text`` after the common table expressions it reaches, each after its own."""
    ordered: list[str] = []

    def place(name: str) -> None:
        if name not in ordered:
            for needed in sorted(_names_in(CTES[name]) - {name}):
                place(needed)
            ordered.append(name)

    for name in sorted(_names_in(text)):
        place(name)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {head}\n{text}"


def oracle_sql() -> dict[str, str]:
    return {name: with_inputs(text) for name, text in SQL.items()}

"""DuckDB oracle SQL for every registered query that SQL can express."""

from __future__ import annotations

from vigil.plans.views import with_views

SQL: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str):
    SQL[name] = with_views(sql, *views)


STATUS_NAME = ("case {c} when 0 then 'Ok' when 1 then 'Warning' when 2 then 'Critical' "
               "when 4 then 'Pending' else 'CheckError' end")

oracle("check_status_all", f"""
select g.check_name, g.passive,
  case when l.status is null then 'Check still needs to be executed' else l.output end output,
  case when l.status is null then 'Pending' else {STATUS_NAME.format(c='l.status')} end status,
  l.timestamp, g.mute notifications_muted, g.mute_until notifications_muted_until
from resolved g left join (
  select * from (select *, row_number() over (partition by check_name
                 order by timestamp desc, status desc, output desc) rn from stored) where rn = 1
) l using (check_name)""", "resolved", "stored")

oracle("status_code_to_name", f"""
select event_id, status_code, {STATUS_NAME.format(c='status_code')} status_name from results""", "results")

oracle("status_name_to_code", f"""
select event_id, {STATUS_NAME.format(c='status_code')} status_name,
  case when status_code in (0, 1, 2, 4) then status_code else 3 end stored_code from results""", "results")

oracle("output_text", """
select event_id, check_name, split_part(output, '|', 1) text from results""", "results")

oracle("perf_long", """
select check_name, timestamp, pos, perf_key, perf_value, parse_ok from metrics""", "metrics")

oracle("perf_parse_warnings", """
select check_name, count(*) filter (where not parse_ok) n_warnings, count(*) n_metrics
from metrics group by check_name""", "metrics")

oracle("latest_one", """
select check_name, timestamp, cast(status as int) status, output from stored
where check_name = 'check-7' order by timestamp desc limit 1""", "stored")

oracle("latest_all", """
select check_name, timestamp, cast(status as int) status, output from (
  select *, row_number() over (partition by check_name order by timestamp desc, status desc, output desc) rn
  from stored) where rn = 1""", "stored")

_HISTORY = """
select check_name, timestamp, count(*) n_metrics, string_agg(perf_key, ',' order by perf_key) perf_keys,
  max(case when perf_key = 'value' then perf_value end) metric_value,
  max(case when perf_key = 'k' then perf_value end) metric_k
from metrics {where} group by check_name, timestamp"""

oracle("perf_history_one", _HISTORY.format(where="where check_name = 'check-7'"), "metrics")
oracle("perf_history_all", _HISTORY.format(where=""), "metrics")
oracle("perf_history_row_local", _HISTORY.format(where=""), "metrics")

oracle("check_list", """
select check_name, passive, check_interval interval from resolved""", "resolved")

oracle("check_count", "select count(*) n_checks from registry", "registry")

oracle("result_rejects_unknown", """
select event_id, check_name from results where check_name not in (select check_name from resolved)""",
       "results", "resolved")

oracle("registry_fold", """
select check_name, seq, changed_at, passive, check_interval, script_ref,
  array_to_string(channel_refs, ',') channel_refs, array_to_string(secret_refs, ',') secret_refs, mute, mute_until from (
  select *, row_number() over (partition by check_name order by seq desc) rn from spec_feed)
where rn = 1 and op <> 'Remove'""", "spec_feed")

oracle("check_spec_rejects", """
select check_name, reason from (
  select check_name, 'missing_name' reason, check_name is null bad from registry_spec
  union all select check_name, 'active_without_script_or_interval',
    not coalesce(passive, false) and (script_ref is null or check_interval is null) from registry_spec
  union all select check_name, 'negative_interval', coalesce(check_interval < 0, false) from registry_spec)
where bad""", "registry_spec")

oracle("script_spec_rejects", """
select script_name, reason from (
  select script_name, 'missing_language' reason, language is null bad from scripts
  union all select script_name, 'bad_language', language is not null and language not in ('Python', 'Bash') from scripts
  union all select script_name, 'missing_content', content is null from scripts)
where bad""", "scripts")

oracle("resolve_scripts", "select * from res_scripts", "res_scripts")
oracle("resolve_channels", "select * from res_channels", "res_channels")
oracle("resolve_bot_tokens", "select * from channel_tokens", "channel_tokens")
oracle("merge_secrets", "select * from merged_secrets", "merged_secrets")
oracle("unresolved_refs", "select * from unresolved", "unresolved")

for _name, _f in (("resolved_checks", ""), ("resolved_from_feed", "feed_")):
    oracle(_name, f"""
select g.check_name, g.passive, g.check_interval, s.script_content,
  case when g.secret_refs is not null then coalesce(m.n, 0) end n_secrets,
  case when g.secret_refs is not null then coalesce(m.keys, '') end secret_keys,
  coalesce(c.n, 0) n_channels, coalesce(c.chat_ids, '') chat_ids, g.mute, g.mute_until
from {_f}registry g
left join {_f}res_scripts s using (check_name)
left join (select check_name, count(*) n, string_agg(chat_id, ',' order by pos) chat_ids
           from {_f}res_channels group by check_name) c using (check_name)
left join (select check_name, count(*) n, string_agg(key, ',' order by key) keys
           from {_f}merged_secrets group by check_name) m using (check_name)
where g.check_name not in (select check_name from {_f}unresolved)""", f"{_f}registry", f"{_f}res_scripts",
           f"{_f}res_channels", f"{_f}merged_secrets", f"{_f}unresolved")

oracle("channel_spec_rejects", """
select channel_name, 'missing_bot_token_ref' reason from channels where bot_token_ref is null
union all select channel_name, 'missing_chat_id' from channels where chat_id is null""", "channels")

oracle("impact_script", """
select s.script_name name, g.check_name from registry g
join (select distinct script_name from scripts) s on g.script_ref = s.script_name""", "registry", "scripts")

oracle("impact_secret", """
select distinct x.name, x.check_name from (select unnest(secret_refs) name, check_name from registry) x
join (select distinct secret_name from secrets) s on x.name = s.secret_name""", "registry", "secrets")

oracle("impact_channel", """
select distinct x.name, x.check_name from (select unnest(channel_refs) name, check_name from registry) x
join (select distinct channel_name from channels) s on x.name = s.channel_name""", "registry", "channels")

_ACCEPTED_CMDS = """(select * from mute_commands
  where check_name in (select check_name from resolved) and not (op = 'mute' and bad_until))"""

oracle("mute_state", f"""
with acc as {_ACCEPTED_CMDS},
rows as (
  select check_name, seq, case when op = 'unmute' then null else until_ts end u
  from acc where op = 'unmute' or until_ts is not null
  union all
  select check_name, -9223372036854775808, mute_until from resolved where mute_until is not null)
select g.check_name,
  case when l.op is null then g.mute else l.op = 'mute' end muted,
  u.u muted_until, coalesce(n.n, 0) n_commands
from resolved g
left join (select check_name, op from (select *, row_number() over (partition by check_name order by seq desc) rn
           from acc) where rn = 1) l using (check_name)
left join (select check_name, u from (select *, row_number() over (partition by check_name order by seq desc) rn
           from rows) where rn = 1) u using (check_name)
left join (select check_name, count(*) n from acc group by check_name) n using (check_name)""",
       "resolved", "mute_commands")

oracle("mute_rejects", """
select seq, check_name, case when check_name not in (select check_name from resolved) then 'unknown_check'
  else 'bad_until' end reason
from mute_commands
where check_name not in (select check_name from resolved) or (op = 'mute' and bad_until)""",
       "resolved", "mute_commands")

_RESOLVED = "(select * from registry where check_name not in (select check_name from unresolved))"

oracle("submission_enriched", f"""
select s.submission_id, s.check_name, s.received_at, {STATUS_NAME.format(c='s.status')} status_name,
  split_part(s.output, '|', 1) text, cast(len(g.channel_refs) as bigint) n_channels, g.mute, g.mute_until
from submissions s join {_RESOLVED} g using (check_name)""", "submissions", "registry", "unresolved")

oracle("submission_rejects", f"""
select submission_id, check_name from submissions
where check_name not in (select check_name from {_RESOLVED})""", "submissions", "registry", "unresolved")

_SEND = "status_code not in (0, 4) and (not coalesce({m}, false) or coalesce({u} <= {t}, false))"

oracle("alertable", f"""
select r.event_id, r.check_name, r.ts timestamp, {STATUS_NAME.format(c='r.status_code')} status_name
from results r join resolved g using (check_name)
where {_SEND.format(m='g.mute', u='g.mute_until', t='r.ts')}""", "results", "resolved")

oracle("alert_routes", f"""
select r.event_id, r.check_name, r.ts timestamp, c.pos, c.chat_id
from results r join {_RESOLVED} g using (check_name) join res_channels c using (check_name)
where {_SEND.format(m='g.mute', u='g.mute_until', t='r.ts')}""", "results", "registry", "unresolved",
       "res_channels")

_ESC = ("replace(replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        "'\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')")
_B64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"

oracle("alert_outbox", f"""
select s.submission_id, s.check_name, c.pos, c.chat_id,
  case when ok then 'photo' else 'text' end kind,
  case when ok then concat(s.check_name, '.jpg') end attachment,
  case when ok then cast(octet_length(from_base64(image_jpg_base64)) as bigint) end image_size,
  image_jpg_base64 is not null and not ok image_error,
  concat('<b>Date</b>: ', strftime(s.received_at, '%Y-%m-%d %H:%M:%S'), ' +00:00', chr(10),
         '<b>Check name</b>: ', s.check_name, ' ', chr(10), '<b>Status</b>: ',
         {STATUS_NAME.format(c='s.status')}, chr(10), '<b>Output</b>', chr(10), '<pre>',
         {_ESC.format(x="split_part(s.output, '|', 1)")}, '</pre>') message
from (select *, status status_code, coalesce(regexp_full_match(image_jpg_base64, '{_B64}'), false) ok
      from submissions) s
join {_RESOLVED} g using (check_name) join res_channels c using (check_name)
where {_SEND.format(m='g.mute', u='g.mute_until', t='s.received_at')}""",
       "submissions", "registry", "unresolved", "res_channels")

oracle("mute_asof", f"""
select r.event_id, r.check_name, r.ts timestamp, v.version_seq, v.mute muted, v.mute_until muted_until,
  {_SEND.format(m='v.mute', u='v.mute_until', t='r.ts')} send
from results r asof left join versions v on r.check_name = v.check_name and r.ts >= v.valid_from""",
       "results", "versions")

_BROKEN = ("(event_id % 23 = 0 or event_id % 29 = 0 or event_id % 31 = 0 or event_id % 41 = 0 "
           "or event_id % 43 = 0)")
_REASON = ("case when event_id % 23 = 0 then 'invalid_json' when event_id % 29 = 0 then 'bad_output' "
           "when event_id % 31 = 0 then 'bad_check_name' else 'bad_channels' end")

oracle("decode_results", f"""
select event_id msg_id, check_name, output, {STATUS_NAME.format(c='status_code')} status, ts timestamp
from results where not {_BROKEN}""", "results")

oracle("decode_rejects", f"""
select event_id msg_id, {_REASON} reason from results where {_BROKEN}""", "results")

_PLAN_OF = """(select check_name, k run_index, timestamp '2024-01-01 00:00:00' + to_seconds(k * check_interval) run_at
  from (select check_name, check_interval,
               unnest(range(1, cast(floor(3600 / check_interval) as bigint) + 1)) k
        from {checks} where not coalesce(passive, false) and check_interval > 0))"""
_PLAN = _PLAN_OF.format(checks=_RESOLVED)

oracle("schedule_plan_feed", f"""
select * from {_PLAN_OF.format(checks="(select * from feed_registry where check_name not in (select check_name from feed_unresolved))")}""",
       "feed_registry", "feed_unresolved")

oracle("schedule_plan", f"select * from {_PLAN}", "registry", "unresolved")
oracle("due_runs", f"select check_name, run_at from {_PLAN} where run_at <= timestamp '2024-01-01 00:30:00'",
       "registry", "unresolved")
oracle("next_due", f"select check_name, run_at from {_PLAN} order by run_at, check_name limit 20",
       "registry", "unresolved")

oracle("task_payloads", f"""
select p.check_name, p.run_at, g.passive, g.check_interval interval, s.script_content,
  array_to_string(v.python_requirements, ',') requirements, array_to_string(g.secret_refs, ',') secret_refs,
  cast(len(g.channel_refs) as bigint) n_channels, g.mute,
  strftime(g.mute_until, '%Y-%m-%dT%H:%M:%S.%fZ') mute_until
from {_PLAN} p join {_RESOLVED} g using (check_name)
left join res_scripts s using (check_name)
left join valid_scripts v on v.script_name = g.script_ref
where p.run_at <= timestamp '2024-01-01 00:30:00'""", "registry", "unresolved", "res_scripts", "valid_scripts")

_REPLAYED = """(select event_id arrival, ts, check_name, status_code, output from results
  union all
  select event_id - 1000000000, ts, check_name, status_code, concat(output, ',k=0') from results
  where status_code = 1)"""

oracle("result_dedup", f"""
select arrival, check_name, ts timestamp, case when status_code in (0, 1, 2, 4) then status_code else 3 end status,
  split_part(output, '|', 1) output
from (select *, row_number() over (partition by check_name, ts order by arrival) rn from {_REPLAYED})
where rn = 1""", "results")

oracle("result_duplicates", f"""
select arrival, check_name, ts timestamp
from (select *, row_number() over (partition by check_name, ts order by arrival) rn from {_REPLAYED})
where rn > 1""", "results")

oracle("perf_dedup", f"""
with kept as (select * from (select *, row_number() over (partition by check_name, ts order by arrival) rn
                             from {_REPLAYED}) where rn = 1),
toks as (select *, unnest(toks) tok, unnest(range(len(toks))) pos0
         from (select *, list_filter(string_split(case when strpos(output, '|') > 0
                 then substr(output, strpos(output, '|') + 1) else '' end, ','),
                 lambda x: strpos(x, '=') > 0) toks from kept)),
m as (select ts, check_name, arrival, cast(pos0 as int) pos, trim(split_part(tok, '=', 1)) perf_key,
        cast(coalesce(try_cast(trim(substr(tok, strpos(tok, '=') + 1)) as float), 0.0) as double) perf_value
      from toks)
select ts timestamp, check_name, pos, perf_key, perf_value from (
  select *, row_number() over (partition by arrival, perf_key order by pos) r from m) where r > 1""",
       "results")

oracle("retention_rows", """
select check_name, timestamp, cast(status as int) status, output from stored
where timestamp >= timestamp '2024-01-31 00:00:00' - interval 7 day""", "stored")

oracle("retention_chunks", """
select chunk_id, timestamp '1970-01-01 00:00:00' + to_seconds(chunk_id * 604800) chunk_start,
  timestamp '1970-01-01 00:00:00' + to_seconds((chunk_id + 1) * 604800) chunk_end, count(*) n_rows,
  timestamp '1970-01-01 00:00:00' + to_seconds((chunk_id + 1) * 604800)
    <= timestamp '2024-01-31 00:00:00' - interval 7 day dropped
from (select cast(floor(epoch(timestamp) / 604800) as bigint) chunk_id from stored)
group by chunk_id""", "stored")

oracle("ingest_stream", f"""
select check_name, ts timestamp, case when status_code in (0, 1, 2, 4) then status_code else 3 end status,
  split_part(output, '|', 1) output
from results where not {_BROKEN}""", "results")

SQL["compacted_stored"] = SQL["result_dedup_stream"] = SQL["ingest_stream"]
SQL["submission_stream"] = SQL["alert_outbox"]

oracle("status_stream", f"""
select g.check_name, g.passive,
  case when l.status is null then 'Check still needs to be executed' else l.output end output,
  case when l.status is null then 'Pending' else {STATUS_NAME.format(c='l.status')} end status,
  l.timestamp, g.mute notifications_muted, g.mute_until notifications_muted_until
from resolved g left join (
  select * from (select *, row_number() over (partition by check_name
                 order by timestamp desc, status desc, output desc) rn from ({SQL["ingest_stream"]})) where rn = 1
) l using (check_name)""", "resolved", "results")

SQL["mute_asof_stream"] = SQL["mute_asof"]
SQL["resolution_stream"] = SQL["resolved_checks"]
SQL["registry_bootstrap"] = SQL["registry_fold"]
SQL["mute_stream"] = SQL["mute_state"]
SQL["mute_stream_rejects"] = SQL["mute_rejects"]

oracle("ingest_metrics", f"""
select check_name, timestamp, perf_key, perf_value from (
  select *, row_number() over (partition by check_name, timestamp, perf_key order by pos) rn
  from metrics join (select check_name, ts timestamp, event_id from results) using (check_name, timestamp)
  where not {_BROKEN}) where rn = 1""", "metrics")

oracle("ingest_outbox", f"""
select event_id msg_id, check_name, ts timestamp, cast(0 as int) pos, concat('-100', user_id % 10) chat_id,
  concat('<b>Date</b>: ', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' +00:00', chr(10),
         '<b>Check name</b>: ', check_name, ' ', chr(10), '<b>Status</b>: ',
         {STATUS_NAME.format(c='status_code')}, chr(10), '<b>Output</b>', chr(10), '<pre>',
         {_ESC.format(x="split_part(output, '|', 1)")}, '</pre>') message
from results join (select event_id, user_id from events) using (event_id)
where not {_BROKEN} and status_code not in (0, 4) and user_id % 2 = 0""", "results")

oracle("ingest_quarantine", f"""
select event_id msg_id, {_REASON} reason from results where {_BROKEN}
union all select event_id, {_REASON} from results where {_BROKEN} and event_id % 37 = 0
union all select event_id, 'duplicate' from results where not {_BROKEN} and event_id % 37 = 0""", "results")

oracle("submission_stored", f"""
select check_name, timestamp, case when status in (0, 1, 2, 4) then status else 3 end status, output from (
  select s.check_name, s.received_at timestamp, s.status, split_part(s.output, '|', 1) output,
    row_number() over (partition by s.check_name, s.received_at order by submission_id) rn
  from submissions s join {_RESOLVED} g using (check_name)) where rn = 1""", "submissions", "registry", "unresolved")

SQL["latest_one_stored"] = SQL["latest_one"]
oracle("history_stored", _HISTORY.format(
    where="where check_name = 'check-7' and timestamp >= timestamp '2024-01-10 00:00:00'"), "metrics")

oracle("retention_dropped", """
select cast(timestamp as date) event_date, count(*) n_rows from stored
where cast(timestamp as date) + interval 1 day > timestamp '2024-01-31 00:00:00' - interval 7 day
group by 1""", "stored")

oracle("chunks_dropped", """
select chunk_id, count(*) n_rows
from (select cast(floor(epoch(timestamp) / 604800) as bigint) chunk_id from stored)
where timestamp '1970-01-01 00:00:00' + to_seconds((chunk_id + 1) * 604800)
    > timestamp '2024-01-31 00:00:00' - interval 7 day
group by chunk_id""", "stored")

oracle("registry_stream", """
select check_name, seq, changed_at, passive, check_interval, script_ref,
  array_to_string(channel_refs, ',') channel_refs, array_to_string(secret_refs, ',') secret_refs, mute, mute_until from (
  select *, row_number() over (partition by check_name order by seq desc) rn from spec_feed)
where rn = 1 and op <> 'Remove'""", "spec_feed")

oracle("layout_compacted", """
select cast(timestamp as date) event_date, count(*) n_rows, count(distinct check_name) n_checks
from stored group by 1""", "stored")

_RETURNS = """(select l_suppkey, count(*) n, count(*) filter (where l_returnflag = 'R') r from lineitem group by l_suppkey)"""
_RET_STATUS = "case when r * 100 >= n * 35 then 'Critical' when r * 100 >= n * 33 then 'Warning' else 'Ok' end"

for _name in ("checks_sql", "checks_python"):
    oracle(_name, f"""
select concat('supplier-returns-', l_suppkey) check_name, {_RET_STATUS} status_name,
  concat('returns ', r, '/', n) text, false is_error, cast(r as double) metric_returned, cast(n as double) metric_total
from {_RETURNS}""")

oracle("checks_errors", f"""
select concat('supplier-returns-', l_suppkey) check_name,
  case when r % 7 = 0 then 'CheckError' else {_RET_STATUS} end status_name, r % 7 = 0 is_error
from {_RETURNS}""")

for _name in ("decode_tasks", "tasks_stream"):   # decoding the published tasks gives the same rows
    SQL[_name] = SQL["task_payloads"]

oracle("publish_results", f"""
select concat('check-', l_suppkey) check_name, {_RET_STATUS} status,
  concat('returns ', r, '/', n, '|returned=', r, ',total=', n) output,
  timestamp '2024-01-31 00:00:00' timestamp, cast(coalesce(len(g.channel_refs), 0) as bigint) n_channels, g.mute
from {_RETURNS} left join resolved g on g.check_name = concat('check-', l_suppkey)""", "resolved")

_SCRIPTED = f"""
select g.check_name, try_cast(substr(g.script_ref, 8) as int) k, n, r, {_RET_STATUS} ret_status,
  case when g.secret_refs is null then 0 else coalesce(m.n_secrets, 0) end n_secrets
from {_RETURNS} join resolved g on g.check_name = concat('check-', l_suppkey)
left join (select check_name, count(*) n_secrets from merged_secrets group by check_name) m
  on m.check_name = g.check_name
where g.script_ref is not null"""

oracle("checks_by_script", f"""
select check_name, case when k >= 20 then 'Ok' when k % 2 = 0 then ret_status when n >= 600 then 'Warning' else 'Ok' end status_name,
  case when k >= 20 then 'fine' when k % 2 = 0 then concat('returns ', r, '/', n) else concat('lines ', n) end text,
  cast(case when k < 20 and k % 2 = 0 then 3 else 0 end as bigint) n_metrics
from ({_SCRIPTED}) where k < 20 or (k < 24 and r % 5 > 2)""", "resolved", "merged_secrets")

oracle("checks_failures", f"""
select check_name, case when k is null or k >= 24 then 'no_script' when r % 5 = 0 then 'ValueError' when r % 5 = 1 then 'no_exit_code'
  else 'not_utf8' end error
from ({_SCRIPTED}) where k is null or k >= 24 or (k >= 20 and r % 5 <= 2)""", "resolved", "merged_secrets")

_TASKS = f"""
select p.check_name, p.run_at, s.script_content, cast(len(g.channel_refs) as bigint) n_channels, g.mute
from {_PLAN} p join {_RESOLVED} g using (check_name) left join res_scripts s using (check_name)
where p.run_at <= timestamp '2024-01-01 00:30:00'"""

oracle("runner_stream", f"""
select cast(epoch(run_at) as bigint) msg_id, check_name,
  case when k % 7 = 0 then 'Ok' when k % 2 = 0 then ret_status when n >= 600 then 'Warning' else 'Ok' end status,
  case when k % 7 = 0 then 'fine'
    when k % 2 = 0 then concat('returns ', r, '/', n, '|returned=', r, ',total=', n, ',secrets=', n_secrets)
    else concat('lines ', n) end output,
  timestamp '2024-01-31 00:00:00' as timestamp, n_channels, mute
from (select t.*, length(t.script_content) k, c.n, c.r, c.ret_status, c.n_secrets
      from ({_TASKS}) t join ({_SCRIPTED}) c using (check_name) where t.script_content is not null)
where k % 7 <> 0 or r % 5 > 2""", "registry", "unresolved", "res_scripts", "valid_scripts", "resolved", "merged_secrets")

# Records read back from their files give the same rows.
for _name in ("check_list", "mute_state", "submission_rejects"):
    SQL[f"{_name}_read"] = SQL[_name]

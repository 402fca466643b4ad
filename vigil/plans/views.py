"""DuckDB text of the fixture views (same rows as ``vigil.sources.fixtures``).

Used only by the correctness oracle: each oracle query is prefixed with the
CTEs it needs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _view(name: str, sql: str, deps: tuple[str, ...] = ()):
    VIEWS[name] = (sql.strip(), deps)


_view("results", """
select event_id, ts, concat('check-', user_id) check_name,
  cast(case event_type when 'view' then 0 when 'click' then 1 when 'error' then 2
       when 'purchase' then 7 when 'signup' then 4 end as int) status_code,
  case when event_id % 11 = 0 then event_type
       when event_id % 13 = 0 then concat(event_type, '|k=', event_id % 100, '|z=1')
       when event_id % 7 = 0 then concat(event_type, ' <b>|value=oops, k = ', event_id % 100, ' ,junk')
       else concat(event_type, '|value=', cast(cast(round(value * 100) as bigint) as varchar), ',k=', event_id % 100)
  end output
from events""")

_view("registry_spec", """
select concat('check-', c_custkey) check_name, c_custkey % 5 = 0 passive,
  cast(case when c_custkey % 5 = 0 then null when c_acctbal < 0 then null
       else 60 * (1 + c_custkey % 10) end as bigint) check_interval,
  case when c_custkey % 5 = 0 then null
       when c_mktsegment = 'MACHINERY' and c_acctbal < 1000 then concat('script-retired-', c_custkey % 25)
       else concat('script-', c_custkey % 25) end script_ref,
  list_filter([case when c_custkey % 4 <> 0 then concat('channel-', c_custkey % 8) end,
               case when c_custkey % 3 = 0 then case when c_mktsegment = 'AUTOMOBILE' then 'channel-legacy'
                    else concat('channel-', c_custkey % 7) end end], lambda x: x is not null) channel_refs,
  case when c_mktsegment <> 'HOUSEHOLD' then [concat('secret-', c_custkey % 6), concat('secret-', c_custkey % 9)] end secret_refs,
  case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end mute,
  case when c_custkey % 6 = 0 then timestamp '2024-01-15 00:00:00' end mute_until
from customer""")

_view("registry", """
select * from registry_spec
where check_name is not null
  and (passive or (script_ref is not null and check_interval is not null))
  and coalesce(check_interval >= 0, true)""", ("registry_spec",))

_view("scripts", """
select concat('script-', p_partkey) script_name,
  case when p_size % 10 = 0 then 'Ruby' when p_size % 3 = 0 then 'Bash' else 'Python' end language,
  p_name content,
  case when not (p_size % 10 = 0) and not (p_size % 3 = 0) and p_size % 5 = 0
       then ['requests', concat('lib-', p_size)] end python_requirements
from part""")

_view("valid_scripts", """
select *, lower(language) language_label from scripts where language in ('Python', 'Bash') and content is not null""",
      ("scripts",))

_view("channels", """
select concat('channel-', s_suppkey) channel_name, concat('-100', s_suppkey) chat_id,
  case when s_suppkey % 50 <> 49 then concat('secret-', s_nationkey % 6) end bot_token_ref
from supplier""")

_view("valid_channels", """
select * from channels where chat_id is not null and bot_token_ref is not null""", ("channels",))

_view("secrets", """
select concat('secret-', n_nationkey % 6) secret_name, concat('KEY_', cast(floor(n_nationkey / 6) as int)) key,
  n_name value, n_nationkey <> 23 value_valid
from nation
union all
select concat('secret-', r_regionkey), 'botToken', concat('token-', r_name), true from region""")

_view("mute_commands", """
select o_orderkey seq, concat('check-', o_custkey) check_name,
  case when o_orderpriority = '1-URGENT' then 'unmute' else 'mute' end op,
  case when o_orderpriority = '1-URGENT' then null
       when o_orderstatus = 'F' then strftime(o_orderdate + interval 28 year, '%Y-%m-%dT%H:%M:%SZ')
       when o_orderstatus = 'P' and o_orderpriority = '2-HIGH' then 'not-a-date'
       when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM'
         then strftime(o_orderdate + interval 28 year, '%Y-%m-%dT%H:%M:%S+02:00') end until_text,
  case when o_orderpriority = '1-URGENT' then null
       when o_orderstatus = 'F' then o_orderdate + interval 28 year
       when o_orderstatus = 'P' and o_orderpriority = '3-MEDIUM'
         then o_orderdate + interval 28 year - interval 2 hour end until_ts,
  o_orderstatus = 'P' and o_orderpriority = '2-HIGH' bad_until
from orders""")

_view("versions", """
select concat('check-', o_custkey) check_name, o_orderkey version_seq,
  timestamp '2024-01-01 00:00:00' + to_seconds((o_orderkey * 17) % 2592000) valid_from,
  o_orderpriority in ('1-URGENT', '2-HIGH') mute,
  case when o_orderstatus = 'F' then o_orderdate + interval 28 year end mute_until
from orders""")

_view("spec_feed", """
select o_orderkey seq, case when o_orderstatus = 'P' then 'Remove' else 'AddOrUpdate' end op,
  concat('check-', o_custkey) check_name,
  timestamp '2024-01-01 00:00:00' + to_seconds(o_orderkey * 60) changed_at,
  o_orderpriority = '5-LOW' passive,
  cast(case when o_orderpriority = '5-LOW' then null else 60 * (1 + o_orderkey % 10) end as bigint) check_interval,
  case when o_orderpriority <> '5-LOW' then concat('script-', o_orderkey % 30) end script_ref,
  case when o_orderpriority <> '3-MEDIUM' then [concat('secret-', o_orderkey % 6), concat('secret-', o_custkey % 9)] end secret_refs,
  case when o_orderkey % 4 <> 0 then [concat('channel-', o_orderkey % 8)] else [] end channel_refs,
  o_orderpriority = '2-HIGH' mute,
  case when o_orderstatus = 'F' then o_orderdate + interval 28 year end mute_until
from orders""")

# The registry as the change feed leaves it, under the rules of declared checks.
_view("feed_registry", """
select check_name, passive, check_interval, script_ref, channel_refs, secret_refs, mute, mute_until from (
  select *, row_number() over (partition by check_name order by seq desc) rn from spec_feed)
where rn = 1 and op <> 'Remove' and (passive or (script_ref is not null and check_interval is not null))""",
      ("spec_feed",))

_view("submissions", """
select event_id submission_id, ts received_at, check_name, output, status_code status,
  case when event_id % 5 = 0 then to_base64(encode(props)) when event_id % 17 = 0 then 'not*base64' end image_jpg_base64
from (select r.*, e.props from results r join events e using (event_id))""", ("results",))

# Stored result rows and metric rows (display text, normalised code).
_view("stored", """
select ts timestamp, check_name,
  cast(case when status_code in (0, 1, 2, 4) then status_code else 3 end as smallint) status,
  split_part(output, '|', 1) output
from results""", ("results",))

_view("status_names", """
select * from (values (0, 'Ok'), (1, 'Warning'), (2, 'Critical'), (3, 'CheckError'), (4, 'Pending')) t(code, name)""")

# Metric tokens: text after the first '|', split on ',', keep tokens with '='.
_view("metric_tokens", """
select *, unnest(toks) tok, unnest(range(len(toks))) pos0
from (select *, list_filter(string_split(
        case when strpos(output, '|') > 0 then substr(output, strpos(output, '|') + 1) else '' end, ','),
        lambda x: strpos(x, '=') > 0) toks from results)""", ("results",))

_view("metrics", """
select ts timestamp, check_name, cast(pos0 as int) pos, perf_key,
  cast(coalesce(try_cast(vtext as float), 0.0) as double) perf_value,
  try_cast(vtext as float) is not null parse_ok
from (select *, trim(split_part(tok, '=', 1)) perf_key,
             trim(substr(tok, strpos(tok, '=') + 1)) vtext from metric_tokens)""", ("metric_tokens",))


# Reference resolution (D1-D4) over the valid registry.
_view("res_scripts", """
select g.check_name, g.script_ref, s.content script_content, s.language_label,
  g.script_ref is null or s.content is not null script_found
from registry g left join valid_scripts s on g.script_ref = s.script_name""", ("registry", "valid_scripts"))

_view("channel_tokens", """
select c.channel_name, c.chat_id, c.bot_token_ref, t.secret_name is not null token_found
from valid_channels c left join (select secret_name from secrets where key = 'botToken') t
  on c.bot_token_ref = t.secret_name""", ("valid_channels", "secrets"))

_view("res_channels", """
select r.check_name, cast(r.pos as int) pos, r.channel_ref, ct.chat_id, ct.chat_id is not null channel_found,
  coalesce(ct.token_found, false) token_found
from (select check_name, unnest(channel_refs) channel_ref, unnest(range(len(channel_refs))) pos from registry) r
left join channel_tokens ct on r.channel_ref = ct.channel_name""", ("registry", "channel_tokens"))

_view("merged_secrets", """
select check_name, key, max(case when rn = 1 and value_valid then value end) value, bool_and(value_valid) all_valid
from (select r.check_name, s.key, s.value, s.value_valid,
        row_number() over (partition by r.check_name, s.key order by r.pos desc) rn
      from (select check_name, unnest(secret_refs) secret_name, unnest(range(len(secret_refs))) pos from registry) r
      join secrets s using (secret_name))
group by check_name, key""", ("registry", "secrets"))

_view("unresolved", """
select distinct * from (
  select check_name, 'script' ref_kind, script_ref ref_name from res_scripts where not script_found
  union all select check_name, 'channel', channel_ref from res_channels where not channel_found
  union all select check_name, 'bot_token', channel_ref from res_channels where channel_found and not token_found
  union all select check_name, 'secret_utf8', key from merged_secrets where not all_valid)""",
      ("res_scripts", "res_channels", "merged_secrets"))


# The same resolution over the registry that the feed leaves.
for _name in ("res_scripts", "res_channels", "merged_secrets", "unresolved"):
    _sql, _deps = VIEWS[_name]
    for _d in ("registry", "res_scripts", "res_channels", "merged_secrets"):
        _sql = re.sub(rf"\b{_d}\b", f"feed_{_d}", _sql)
    _view(f"feed_{_name}", _sql, tuple(f"feed_{d}" if d in (
        "registry", "res_scripts", "res_channels", "merged_secrets") else d for d in _deps))

_view("resolved", """
select * from registry where check_name not in (select check_name from unresolved)""", ("registry", "unresolved"))


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (and their dependencies)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][0]}\n)" for n in order)
    body = sql.strip()
    if not order:
        return body
    if body[:15].lower() == "with recursive ":   # recursive: the keyword leads the list
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":   # merge the query's own CTEs after ours
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

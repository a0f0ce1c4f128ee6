"""Views derived from the given tables. One SQL text serves both engines, as FIXTURES.md states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW_TABLES = {
    "log_events": "events", "log_lines": "events", "packets": "lineitem", "assets": "events",
    "ioc_feed": "events",
}

VIEW_SQL = {
    "log_events": r"""
select event_id, ts, user_id, severity, source, user_name, source_ip, host, status_code, latency_ms, event_type,
 concat(event_type, ' user=', user_name, ' source_ip=', source_ip, ' host=', host) as raw_log,
 concat(replace(substr(cast(ts as string),1,19),' ','T'),'Z [',severity,'] service=',source,' user=',user_name,
  ' ip=',source_ip,' host=',host,' status=',status_code,' latency_ms=',cast(latency_ms as string),
  ' event="',event_type,'"') as line
from (
 select event_id, ts, user_id,
  case when event_type='error' then
        case when event_id%20<2 then 'EMERGENCY' when event_id%20<5 then 'CRITICAL'
             when event_id%20<9 then 'HIGH' when event_id%20<12 then 'ALERT' else 'ERROR' end
       when event_type='click' and event_id%5=0 then 'WARN'
       when event_type='view' and event_id%4=0 then 'DEBUG'
       when event_type='signup' and event_id%6=0 then 'WARNING'
       else 'INFO' end as severity,
  split_part('auth-svc|db-primary|web-gateway|wazuh-agent|security|file-server','|',cast(user_id%6 as int)+1) as source,
  case when event_id%50=0 then 'admin' when event_id%61=0 then 'svc-reports'
       else concat('user',cast(user_id as string)) end as user_name,
  case when user_id%3=1 then concat('185.',cast(44+user_id%5 as string),'.',cast(user_id%200 as string),'.',cast(1+user_id%250 as string))
       when user_id%3=0 then concat('10.0.',cast(user_id%256 as string),'.',cast(1+user_id%200 as string))
       else concat('192.168.',cast(user_id%256 as string),'.',cast(1+user_id%200 as string)) end as source_ip,
  concat('srv-',cast(user_id%12 as string)) as host,
  case when event_type='error' then split_part('401|403|500|503','|',cast(event_id%4 as int)+1)
       when event_type='click' and event_id%5=0 then '302' else '200' end as status_code,
  cast(floor(value*10) as bigint) as latency_ms,
  case when event_type='error' then split_part('Excessive login failures|Account lockout triggered|Replication lag exceeded threshold|Primary database unavailable|Suspicious privilege escalation detected|Unauthorized admin role assignment|Potential ransomware activity detected|File encryption spike detected|Failed login invalid credentials|Access denied permission denied|powershell.exe -enc aGVsbG8= windowstyle hidden|psexec net use admin share|whoami /priv executed|reg add HKCU run key|wmic /node:srv-1 process call create|curl -F upload file','|',cast(event_id%16 as int)+1)
       else split_part('Service startup complete|Session opened|Page rendered|schtasks /create nightly backup|Cache warmed|Config reloaded','|',cast(event_id%6 as int)+1) end as event_type
 from events) e
""",
    "log_lines": r"""
select event_id, ts, user_id, fmt, case fmt
  when 'iso_pipe' then concat(t,'.000Z ERROR | AUTH-SVC | ',event_type,' by u',u)
  when 'space_pipe' then concat(replace(t,'T',' '),'.000Z WARN | DB-PRIMARY | ',event_type,' by u',u)
  when 'comma_ms' then concat(replace(t,'T',' '),',000 INFO [app] ',event_type,' by u',u)
  when 'sev_pipe' then concat('HIGH | SECURITY | ',event_type,' by u',u)
  when 'space_plain' then concat(replace(t,'T',' '),' ERROR gateway ',event_type,' by u',u)
  when 'syslog' then concat('<',cast(event_id%192 as string),'>Jan ',cast(cast(substr(t,9,2) as int) as string),' ',substr(t,12,8),' srv-',u,' app[',cast(event_id as string),']: ',event_type)
  when 'clf' then concat('10.0.0.',cast(user_id%256 as string),' - u',u,' [',substr(t,9,2),'/Jan/2024:',substr(t,12,8),' +0000] "GET /',event_type,' HTTP/1.1" 200 ',cast(event_id as string))
  when 'iis' then concat(replace(t,'T',' '),' GET /',event_type,' q=1 u',u,' 10.0.0.',cast(user_id%256 as string))
  when 'wazuh' then concat(replace(t,'T',' '),' WARN agent [x] ',event_type,' by u',u)
  else concat(t,'Z [ERROR] service=app user=u',u,' ip=10.0.0.',cast(user_id%256 as string),' status=403 latency_ms=',cast(event_id%1000 as string),' event="',event_type,'"') end as line
from (select event_id, ts, user_id, event_type, cast(user_id as string) as u,
  replace(substr(cast(ts as string),1,19),' ','T') as t,
  split_part('iso_pipe|space_pipe|comma_ms|sev_pipe|space_plain|syslog|clf|iis|wazuh|kv','|',cast(event_id%10 as int)+1) as fmt
 from events) e
""",
    "packets": r"""
select l_orderkey*10+l_linenumber as packet_id, cast(l_orderkey%3600 as double) as ts_s,
 concat('10.1.',cast(l_suppkey%4 as string),'.',cast(l_suppkey%100 as string)) as src_ip,
 concat('203.0.113.',cast(l_partkey%250 as string)) as dst_ip,
 case when l_orderkey%10=0 then 'ICMP' when l_orderkey%10<4 then 'UDP' else 'TCP' end as protocol,
 cast(1024+l_partkey%60000 as int) as src_port,
 cast(split_part('80|443|53|4444|3389|22|445','|',cast(l_partkey%7 as int)+1) as int) as dst_port,
 case when l_orderkey%10<4 then null else cast(split_part('2|18|24|4|1','|',cast(l_partkey%5 as int)+1) as int) end as tcp_flags_int,
 case when l_orderkey%10=0 then cast(split_part('0|8|13','|',cast(l_partkey%3 as int)+1) as int) else null end as icmp_type,
 case when l_orderkey%10 in (1,2,3) then concat('h',cast(l_partkey%50 as string),'.example',split_part('.com|.org|.xyz|.top|.net|.tk|.ml|.io','|',cast(l_partkey%8 as int)+1)) else null end as dns_query,
 case when l_orderkey%10 in (4,5) then split_part('Mozilla/5.0|curl/8.0|python-requests/2.31|Wget/1.21|Nikto/2.5|Chrome/120','|',cast(l_partkey%6 as int)+1) else null end as http_user_agent,
 40+cast(floor(l_quantity) as int)*29 as length
from lineitem
""",
    "assets": r"""
select distinct concat('srv-',cast(user_id%12 as string)) as asset_name,
 split_part('domain_controller|database_server|file_server|web_server|application_server|workstation|user_endpoint|network_device|printer','|',cast((user_id%12)%9 as int)+1) as asset_type
from events
""",
    "ioc_feed": r"""
select distinct concat('185.',cast(44+user_id%5 as string),'.',cast(user_id%200 as string),'.',cast(1+user_id%250 as string)) as indicator, 'ip' as kind
from events where user_id%3=1 and user_id%7=1
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    base = VIEW_TABLES[name]
    text = VIEW_SQL[name].replace(f"from {base}", f"from {{{base}}}")
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def with_views(names: tuple[str, ...], sql: str) -> str:
    """Check SQL headed by the derived views it reads."""
    from trailhound.plans.oracle_views import ORACLE_VIEWS, ORDER, closure

    texts = {**VIEW_SQL, **ORACLE_VIEWS}
    needed = closure(names)
    wanted = [n for n in ORDER if n in needed]
    if not wanted:
        return sql.strip()
    heads = ",\n".join(f"{n} as (\n{texts[n].strip()}\n)" for n in wanted)
    return f"with {heads}\n{sql.strip()}"

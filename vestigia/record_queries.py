"""More registered queries of the record operators: risk rules over paths, times, lookups, totals and text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import fixed, text, times
from .operators import iocs, lookups, risk, timeline, totals
from .sources import binaries, texts

#: Folders and files of which events make Windows paths, so that rules meet every pair of them.
DIRS = ("\\Windows\\System32\\", "\\Temp\\", "\\Users\\Public\\", "\\Users\\a\\AppData\\Local\\Temp\\", "\\ProgramData\\", "\\Users\\a\\Downloads\\", "\\Users\\a\\Desktop\\")
FILES = ("svchost.exe", "pwsh.exe -Enc QQ", "psexec.exe", "mimikatz.ps1", "a.scr", "cmd.exe /c dir", "chrome.exe", "ProcDump.exe", "run.bat", "mstsc.msc", "lsass.exe", "WINWORD.EXE")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(map(_sql_text, words)) + "]"


def _any(col: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_text(w)})" for w in words) + ")"


def _told(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN {_sql_text(name)} END" for name, cond in rules) + ")"


PATHS = f"""SELECT event_id, event_id % 5 AS start_type, low, f, lower(f) AS lf, regexp_extract(low, '[^.].*\\.([^.]+)$', 1) AS ext FROM (SELECT event_id, lower('C:' || d || f) AS low, f FROM (
    SELECT event_id, list_extract({_sql_list(DIRS)}, (event_id % {len(DIRS)} + 1)::INT) AS d, list_extract({_sql_list(FILES)}, ((event_id // {len(DIRS)}) % {len(FILES)} + 1)::INT) AS f FROM events))"""


def _pick(values: Iterable, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _paths(spark, sf_dir) -> DataFrame:
    at = F.expr(f"event_id div {len(DIRS)}") % len(FILES)
    name = _pick(FILES, at)
    path = F.concat(F.lit("C:"), _pick(DIRS, F.col("event_id") % len(DIRS)), name)
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("start_type"), path.alias("path"), name.alias("name"))


def _indicators(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("event_id", F.concat_ws(",", found).alias("indicators"))


@query(f"""SELECT event_id, {_told(("suspicious_path", _any("low", fixed.BAM_PATHS)), ("script_host_execution", _any("low", fixed.RUN_HOSTS)),
    ("remote_execution_tool", _any("low", fixed.BAM_REMOTE)), ("potential_hack_tool", _any("low", fixed.BAM_TOOLS)))} AS indicators FROM ({PATHS})""")
def risk_background_activity(spark, sf_dir):
    return _indicators(_paths(spark, sf_dir), risk.background_activity(F.col("path")))


@query(f"""SELECT event_id, {_told(("suspicious_path", _any("low", fixed.MUI_PATHS)), ("script_host", _any("low", fixed.RUN_HOSTS)), ("remote_execution_tool", _any("low", fixed.MUI_REMOTE)),
    ("potential_hack_tool", _any("low", fixed.MUI_TOOLS)), ("unusual_extension", "regexp_extract(low, '[^/.][^/]*\\.([^./]+)$', 1) NOT IN ('', 'exe', 'msc', 'cpl', 'dll')"))} AS indicators FROM ({PATHS})""")
def risk_shown_program(spark, sf_dir):
    return _indicators(_paths(spark, sf_dir), risk.shown_program(F.col("path")))


@query(f"""SELECT event_id, {_told(("suspicious_path", _any("low", fixed.RECENT_PATHS)), ("script_host", _any("low", fixed.RUN_HOSTS)),
    ("remote_tool", _any("low", fixed.RECENT_REMOTE)), ("potential_hack_tool", _any("low", fixed.RECENT_TOOLS)))} AS indicators FROM ({PATHS})""")
def risk_recent_app(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    return _indicators(rows, risk.recent_app(F.when(even, F.col("path")), F.col("path")))


@query(f"""SELECT event_id, {_told(("suspicious_path", _any("low", fixed.CACHE_PATHS)), ("script_file", "regexp_matches(lf, '\\.(ps1|bat|cmd|vbs|js|hta)$')"),
    ("suspicious_executable", _any("low", fixed.CACHE_PATHS) + " AND ends_with(lf, '.exe')"), ("potential_hack_tool", _any("low", fixed.CACHE_TOOLS)))} AS indicators FROM ({PATHS})""")
def risk_cached_file(spark, sf_dir):
    return _indicators(_paths(spark, sf_dir), risk.cached_file(F.col("path"), F.col("name")))


CODES, KINDS, MODULES = ("0xC0000005", "c0000409", "0x1", "", "C00000FD"), ("BEX", "APPCRASH", "BEX64"), ("Flash.ocx", "ntdll.dll", "AcroRd32 Reader.dll", "jvm-java.dll")


@query(f"""SELECT event_id, {_told(("suspicious_exception", "replace(lower(code), '0x', '') IN ('c0000005', 'c00000fd', 'c000001d', 'c0000096', 'c0000409', '80000003')"), ("buffer_overflow", "kind IN ('BEX', 'BEX64')"),
    *((name, _any("low", words)) for name, words in fixed.CRASH_APPS.items()), ("vulnerable_component", _any("lower(module)", fixed.CRASH_MODULES)))} AS indicators
    FROM (SELECT *, list_extract({_sql_list(CODES)}, (event_id % 5 + 1)::INT) AS code, list_extract({_sql_list(KINDS)}, (event_id % 3 + 1)::INT) AS kind, list_extract({_sql_list(MODULES)}, (event_id % 4 + 1)::INT) AS module FROM ({PATHS}))""")
def risk_crash(spark, sf_dir):
    i = F.col("event_id")
    return _indicators(_paths(spark, sf_dir), risk.crash(_pick(KINDS, i % 3), _pick(CODES, i % 5), F.col("path"), _pick(MODULES, i % 4)))


CONSUMERS = ("ActiveScriptEventConsumer", "CommandLineEventConsumer")
SCRIPTS = ("", "x.DownloadString('u')", "msgbox 1", "IEX y")
ASKED = ("SELECT * FROM __InstanceCreationEvent WHERE TargetInstance ISA 'Win32_Process'", "SELECT * FROM __InstanceCreationEvent", "SELECT * FROM Win32_LogonSession", "", "SELECT Win32_Process")


@query(f"""SELECT event_id, indicators, CASE WHEN indicators = '' THEN 'low' WHEN contains(indicators, ',') THEN 'high' ELSE 'medium' END AS risk_level FROM (
    SELECT event_id, {_told(("script_consumer", "kind = 'ActiveScriptEventConsumer'"), ("suspicious_path", _any("low", fixed.WMI_PATHS)), ("powershell_execution", _any("low", fixed.POWERSHELL_NAMES)),
    ("encoded_command", "contains(low, '-enc')"), ("lolbin_execution", _any("low", fixed.WMI_TOOLS)), ("download_execution", _any("lower(script)", fixed.WMI_DOWNLOADS)),
    ("process_trigger", "contains(lower(asked), '__instancecreationevent') AND contains(lower(asked), 'win32_process')"), ("startup_trigger", _any("lower(asked)", fixed.WMI_STARTUP)))} AS indicators
    FROM (SELECT *, list_extract({_sql_list(CONSUMERS)}, (event_id % 2 + 1)::INT) AS kind, list_extract({_sql_list(SCRIPTS)}, (event_id % 4 + 1)::INT) AS script, list_extract({_sql_list(ASKED)}, (event_id % 5 + 1)::INT) AS asked FROM ({PATHS})))""")
def risk_wmi(spark, sf_dir):
    i = F.col("event_id")
    found = risk.wmi(_pick(CONSUMERS, i % 2), F.col("path"), F.lit(None).cast("string"), _pick(SCRIPTS, i % 4), _pick(ASKED, i % 5))
    return _paths(spark, sf_dir).select("event_id", F.concat_ws(",", found).alias("indicators"), risk.wmi_level(found).alias("risk_level"))


@query(f"""SELECT event_id, CASE WHEN told <> '' AND start_type IN (0, 1, 2) THEN told || ',auto_start_suspicious' ELSE told END AS indicators FROM (SELECT event_id, start_type, {_told(
    ("suspicious_path", _any("low", fixed.SERVICE_PATHS)), ("powershell_service", _any("low", fixed.POWERSHELL_NAMES)), ("cmd_service", "contains(low, 'cmd.exe') OR contains(low, 'cmd /c')"),
    ("script_host_service", _any("low", fixed.SCRIPT_HOSTS)), ("encoded_command", "contains(low, '-enc')"),
    ("unusual_extension", "NOT regexp_matches(low, '\\.(exe|sys|dll)( |$)')"))} AS told FROM ({PATHS}))""")
def risk_service_paths(spark, sf_dir):
    return _indicators(_paths(spark, sf_dir), risk.service(F.col("path"), F.col("start_type")))


@query("""SELECT event_id, concat_ws(',', CASE WHEN i % 2 = 0 AND i // 2 % 2 = 0 AND i // 4 % 2 = 0 THEN 'allow_all_inbound' END, CASE WHEN i % 2 = 0 AND i // 2 % 2 = 0 AND i // 8 % 3 < 2 THEN 'dangerous_port_open' END,
    CASE WHEN i % 2 = 0 AND i // 16 % 2 = 0 AND i // 32 % 2 = 0 THEN 'public_profile_allow' END, CASE WHEN i // 64 % 2 = 0 THEN 'edge_traversal' END) AS indicators FROM (SELECT event_id, event_id AS i FROM events)""")
def risk_firewall_rules(spark, sf_dir):
    """Action, direction, address, port, profile, state and traversal each vary with one digit of the id."""
    i = F.col("event_id")
    bit = lambda n, k=2: F.expr(f"event_id div {n}") % k
    rule = {
        "action": _pick(("Allow", "Block"), i % 2),
        "direction": _pick(("In", "Out"), bit(2)),
        "remote_address": _pick(("*", "10.0.0.0/8"), bit(4)),
        "remote_port": F.lit("*"),
        "local_port": _pick(("445", "80,3389", "8080"), bit(8, 3)),
        "profile": _pick(("Domain,Public", "Private"), bit(16)),
        "enabled": bit(32) == 0,
        "edge": bit(64) == 0,
        "application": F.lit("C:\\Windows\\a.exe"),
    }
    return _indicators(table(spark, sf_dir, "events"), risk.firewall(rule))


@query("""SELECT o_orderkey, us AS filetime_text, us AS filetime_hex, us AS mozilla, us // 1000000 * 1000000 AS unix, us // 1000000 * 1000000 AS ole, us // 1000 * 1000 AS systemtime,
    us // 86400000000 * 86400000000 AS day, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2100 THEN us END AS plausible, us AS iso
    FROM (SELECT o_orderkey, o_orderdate, epoch_us(o_orderdate::TIMESTAMP) + o_orderkey % 86400 * 1000000 + o_orderkey % 1000 * 1000 AS us FROM orders)""")
def time_formats(spark, sf_dir):
    """Times written in each format and read again, as microseconds."""
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400 * 1000000 + F.col("o_orderkey") % 1000 * 1000
    rows = table(spark, sf_dir, "orders").select("o_orderkey", us.alias("us"), F.timestamp_micros(us).alias("at"))
    ticks = F.col("us") * 10 + times.EPOCH_1601
    second = F.expr("us div 1000000")
    part = lambda f: f(F.col("at"))
    milli = F.expr("pmod(us div 1000, 1000)")
    shown = {
        "filetime_text": times.from_filetime_text(ticks.cast("string")),
        "filetime_hex": times.from_filetime_hex(F.concat(F.lit("0x"), F.lower(F.hex(ticks)))),
        "mozilla": times.from_mozilla(F.col("us")),
        "unix": times.from_unix(second),
        "ole": times.from_ole(second / 86400 + 25569),
        "systemtime": times.from_systemtime(*(part(f) for f in (F.year, F.month, F.day, F.hour, F.minute, F.second)), milli),
        "day": times.from_day(F.date_format("at", "yyyyMMdd")),
        "plausible": times.plausible(F.col("at"), "syscache"),
        "iso": times.from_filetime_text(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
    }
    return rows.select("o_orderkey", *(F.unix_micros(v).alias(k) for k, v in shown.items()))


@query("""SELECT c_custkey, coalesce(n_name, '') AS handler FROM customer LEFT JOIN (SELECT max_by(n_name, n_nationkey) AS n_name, n_regionkey AS k FROM nation GROUP BY n_regionkey) ON c_nationkey = k""")
def join_last_handler(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_nationkey", "n_name")
    return lookups.last_of(table(spark, sf_dir, "customer"), nation, F.col("c_nationkey"), "k", "n_nationkey", "n_name").select("c_custkey", F.col("n_name").alias("handler"))


@query("""SELECT doc_id, i::INT AS i, url, seen FROM (SELECT doc_id, unnest(ws) AS url, generate_subscripts(ws, 1) - 1 AS i, ws FROM (SELECT doc_id, string_split(text, chr(10)) AS ws FROM documents WHERE text IS NOT NULL))
    LEFT JOIN (SELECT doc_id AS d, n_chars AS seen FROM documents WHERE n_chars % 2 = 0) ON d = doc_id AND i = 0""")
def join_positional(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    urls = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "url"))
    ats = docs.where("n_chars % 2 = 0").select("doc_id", F.lit(0).alias("i"), F.col("n_chars").alias("seen"))
    return urls.join(ats, ["doc_id", "i"], "left").select("doc_id", "i", "url", "seen")


@query("""SELECT a.page_id, min(b.page_id) AS target FROM pages a JOIN pages b ON sha256(a.html) = sha256(b.html) GROUP BY 1""")
def join_first_by_hash(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return lookups.first_by_hash(pages, "page_id", "html")


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 17).select("doc_id", "source", "n_chars")


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS record_index FROM events""")
def record_index(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", (F.row_number().over(order) - 1).cast("long").alias("record_index"))


@query("""SELECT source, n, seen FROM (SELECT source, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY 1) ORDER BY n DESC, seen LIMIT 5""")
def ranked_by_count(spark, sf_dir):
    """The five most frequent values, of equals the one seen first."""
    found = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("occurrence_count"), F.min("doc_id").alias("first_ord"))
    return iocs.ranked(found, 5).select("source", F.col("occurrence_count").alias("n"), F.col("first_ord").alias("seen"))


@query("""SELECT count(*) AS rules, count_if(event_id % 2 = 0) AS enabled, count_if(event_type = 'click') AS inbound, count_if(event_type = 'view') AS outbound, count_if(event_id % 3 = 0) AS allowed, count_if(event_id % 3 = 1) AS blocked FROM events""")
def totals_by_condition(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    return totals.conditions(table(spark, sf_dir, "events"), "rules", enabled=i % 2 == 0, inbound=kind == "click", outbound=kind == "view", allowed=i % 3 == 0, blocked=i % 3 == 1)


@query("""SELECT (SELECT count(*) FROM pages) AS notifications, (SELECT count(*) FROM documents) AS handlers, (SELECT string_agg(a, ' ' ORDER BY a) FROM (SELECT DISTINCT a FROM (SELECT lang AS a FROM documents UNION SELECT source FROM documents) WHERE a IS NOT NULL ORDER BY a LIMIT 20)) AS apps""")
def totals_of_two_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    apps = docs.select(F.explode(F.array("lang", "source")).alias("a")).where("a is not null").distinct().orderBy("a").limit(20)
    told = apps.agg(F.concat_ws(" ", F.array_sort(F.collect_list("a"))).alias("apps"))  # 20 rows
    both = table(spark, sf_dir, "pages").agg(F.count("*").alias("notifications")).join(docs.agg(F.count("*").alias("handlers")), F.lit(True))
    return both.join(told, F.lit(True))


@query("""SELECT l_orderkey, strftime(max(l_shipdate::DATE + (l_linenumber % 3 * 10)::INT), '%Y-%m-%d') AS best FROM lineitem GROUP BY 1""")
def best_of_times(spark, sf_dir):
    """The latest of several times over the items of a record, kept as an array."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_shipdate").cast("date"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_linenumber") % 3 * 10).cast("int")))).alias("items"))
    return items.select("l_orderkey", F.date_format(F.array_max(F.flatten("items")), "yyyy-MM-dd").alias("best"))


@query("""SELECT source, hits, misses, CASE WHEN hits + misses = 0 THEN 0.0 ELSE round(hits / (hits + misses), 6) END AS hit_rate FROM (SELECT source, count_if(n_chars > 1500) AS hits, count_if(n_chars <= 1500) AS misses FROM documents GROUP BY 1)""")
def hit_rates(spark, sf_dir):
    found = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 1500).alias("hits"), F.count_if(F.col("n_chars") <= 1500).alias("misses"))
    return found.withColumn("hit_rate", F.round(totals.rate(F.col("hits"), F.col("misses")), 6))


@query("""SELECT count(*) AS files, sum(n_chars)::BIGINT AS size_bytes, count_if(n_chars > 100000) = 0 AS success FROM documents""")
def totals_of_collection(spark, sf_dir):
    return totals.collected(table(spark, sf_dir, "documents"), F.col("n_chars"), F.when(F.col("n_chars") > 100000, "too large"))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS records FROM documents WHERE text IS NOT NULL""")
def non_blank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", totals.lines(F.col("text")).alias("records"))


@query("""SELECT source, sha256(string_agg(doc_id || sha256(text), '' ORDER BY doc_id::VARCHAR)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def directory_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return totals.directory_hash(docs, "source", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256))


@query("""SELECT o_orderkey, o_totalprice::DOUBLE AS size FROM (SELECT *, sum(o_totalprice::DOUBLE) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS reached FROM orders WHERE o_orderstatus = 'P') WHERE reached <= 0.8 * 1e7""")
def evict_least_recent(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("size"))
    return totals.within_budget(rows, "size", ["o_orderdate", "o_orderkey"], 1e7).select("o_orderkey", "size")


@query("""SELECT page_id, concat_ws(' ', url, html, 'l' || page_id, 'm') AS content FROM pages""")
def nested_text(spark, sf_dir):
    """All text of a nested record in the order of its fields; numbers and inner lists are left out."""
    data = F.struct(F.col("url"), F.struct("html", F.col("page_id").alias("n")).alias("in"), F.array(F.concat(F.lit("l"), F.col("page_id").cast("string")), F.lit("m")).alias("list"), F.array(F.array(F.lit("no"))).alias("deep"))
    rows = table(spark, sf_dir, "pages").select("page_id", data.alias("data"))
    return rows.select("page_id", text.all_text(F.col("data"), rows.schema["data"].dataType).alias("content"))


@query(f"""SELECT event_id, string_split(string_split(low, chr(92))[-1], ' ')[1] AS program, 'a' AS user_name, 'p_' || event_id || '!App' AS app, 'None:' || event_id AS record_id, upper(lpad(to_hex(event_id), 8, '0')) AS hex8 FROM ({PATHS})""")
def text_helpers(spark, sf_dir):
    i = F.col("event_id").cast("string")
    return _paths(spark, sf_dir).select(
        "event_id",
        text.program(F.lower("path")).alias("program"),
        text.user_of(F.concat(F.lit("/c/Users/a/x/"), i)).alias("user_name"),
        F.concat(text.package_of(F.concat(F.lit("Win_p_"), i, F.lit("!App"))), F.lit("!App")).alias("app"),
        text.record_id(F.lit(None).cast("string"), i).alias("record_id"),
        text.hex8(F.col("event_id")).alias("hex8"),
    )


@query("""SELECT page_id, url, regexp_extract(url, '://([^/:]+)', 1) AS domain FROM pages""")
def typed_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", text.typed_domain(F.col("url")).alias("domain"))


@query("""SELECT c AS ioc_type, value, count(*) AS n FROM (SELECT 'url' AS c, url AS value FROM pages WHERE url <> '' UNION ALL SELECT 'domain', d FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS d FROM pages) WHERE d <> '' AND length(d) >= 4)
    GROUP BY 1, 2""")
def ioc_visits(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.explode(iocs.of_visits(F.col("url"), F.col("page_id").cast("string"))).alias("m")).select("m.*")
    return found.groupBy("ioc_type", "value").agg(F.count("*").alias("n"))


@query("""SELECT value, context, tag, count(*) AS n FROM (SELECT '8.8.' || event_id % 7 || '.1' AS value, 'EventID:' || e AS context, CASE WHEN e IN (4624, 4625) THEN 'network_logon' END AS tag FROM (SELECT event_id, 4623 + event_id % 4 AS e FROM events WHERE event_id % 5 <> 0)) GROUP BY 1, 2, 3""")
def ioc_event_addresses(spark, sf_dir):
    i = F.col("event_id")
    address = F.when(i % 5 == 0, F.concat(F.lit("10.0.0."), (i % 7).cast("string"))).otherwise(F.concat(F.lit("8.8."), (i % 7).cast("string"), F.lit(".1")))
    found = table(spark, sf_dir, "events").select(F.explode(iocs.of_events(address, 4623 + i % 4)).alias("m")).select("m.*")
    return found.groupBy("value", "context", "tag").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT p.*, ts FROM ({PATHS}) p JOIN events USING (event_id)) SELECT record_id, source, event_type, description, target, action, severity, tags FROM (
    SELECT event_id::VARCHAR AS record_id, 'usnjrnl' AS source, 'file_activity' AS event_type, 'File change: ' || f || ' (CREATE, CLOSE)' AS description, f AS target, 'CREATE, CLOSE' AS action, 'info' AS severity, 'file' AS tags FROM e
    UNION ALL SELECT event_id::VARCHAR, 'lnk', 'file_access', 'Shortcut accessed: ' || f, f, 'shortcut_access', 'info', 'user_activity' FROM e
    UNION ALL SELECT event_id::VARCHAR, 'services', 'persistence', 'Service: ' || f, f, 'persistence', CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'info' END, CASE WHEN event_id % 2 = 0 THEN 'persistence,x' ELSE 'persistence' END FROM e
    UNION ALL SELECT event_id::VARCHAR, 'srum', 'activity', 'Activity from srum', NULL, NULL, 'info', '' FROM e)""")
def timeline_more(spark, sf_dir):
    rows = _paths(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    name = F.col("name")
    found = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    all_of = timeline.merged(
        timeline.changes(rows, "event_id", "ts", name, F.array(F.lit("CREATE"), F.lit("CLOSE"))),
        timeline.shortcuts(rows, "event_id", "ts", name),
        timeline.persistence(rows, "event_id", "ts", "services", name, found),
        timeline.activities(rows, "event_id", "ts", "srum"),
    )
    return all_of.select("record_id", "source", "event_type", "description", "target", "action", "severity", F.concat_ws(",", "tags").alias("tags"))


@query("""SELECT doc_id, line_number, command, username FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line_number, trim(unnest(ls)) AS command, source AS username FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE command <> ''""")
def scan_command_history(spark, sf_dir):
    """Documents as shell histories of users named like their sources."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.concat(F.lit("C:\\Users\\"), "source", F.lit("\\x\\"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    found = texts.command_history(rows)
    return found.select(F.substring_index("path", "\\", -1).cast("long").alias("doc_id"), "line_number", "command", "username")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'BEX' ELSE 'APPCRASH' END AS event_type, CASE WHEN event_id % 2 = 0 THEN 'Buffer Overflow' ELSE 'Application Crash' END AS event_type_name, 'a=' || event_id AS application_name,
    event_id * 1000000 AS us, CASE WHEN event_id % 2 = 0 THEN 'suspicious_exception,buffer_overflow,browser_crash' ELSE 'suspicious_exception,browser_crash' END AS risk FROM events""")
def scan_error_reports(spark, sf_dir):
    i = F.col("event_id").cast("string")
    ticks = (F.col("event_id") * 10000000 + times.EPOCH_1601).cast("string")
    kind = F.when(F.col("event_id") % 2 == 0, "BEX").otherwise("APPCRASH")
    content = F.concat(F.lit("Version=1\r\nEventType="), kind, F.lit("\r\nEventTime="), ticks, F.lit("\r\nAppName = a="), i, F.lit("\r\nAppPath=C:\\chrome.exe\r\nSig[6].Value=c0000005\r\n[x]\r\n"))
    found = texts.error_reports(table(spark, sf_dir, "events").select(i.alias("path"), F.encode(content, "UTF-16LE").alias("content")))
    return found.select(F.col("path").cast("long").alias("event_id"), "event_type", "event_type_name", "application_name", F.unix_micros("timestamp").alias("us"), F.concat_ws(",", "risk_indicators").alias("risk"))


@query("""SELECT event_id, unnest([0, 1, 2]) AS entry_index, unnest(['detection', 'scan', 'info']) AS entry_type, unnest(['X' || event_id, '', '']) AS threat_name, unnest(['C:\\a b', '', '']) AS file_path, unnest([true, false, false]) AS is_detection FROM events""")
def scan_protection_log(spark, sf_dir):
    i = F.col("event_id").cast("string")
    content = F.concat(F.lit("2024-01-02T03:04:05.678Z Threat: X"), i, F.lit(", Action: none\n  file: C:\\a b \n2024-01-02T03:04:06.1Z Scan done\n\n\nmisc\n"))
    found = texts.protection_log(table(spark, sf_dir, "events").select(i.alias("path"), content.cast("binary").alias("content")))
    return found.select(F.col("path").cast("long").alias("event_id"), F.col("entry_index").cast("int").alias("entry_index"), "entry_type", "threat_name", "file_path", "is_detection")


def _le(value: Column, size: int) -> Column:
    """A number as hexadecimal digits, the low byte first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


@query("""SELECT event_id, '$I' || event_id AS filename, 1 + event_id % 2 AS version, 'C:' || chr(92) || 'f' || event_id || '.txt' AS original_path, event_id * 7 AS file_size, event_id * 1000000 AS us, 'S-1-5-21-' || event_id % 9 AS user_sid FROM events""")
def scan_recycled(spark, sf_dir):
    i = F.col("event_id")
    name = F.concat(F.lit("C:\\f"), i.cast("string"), F.lit(".txt\0"))
    wide = F.hex(F.encode(name, "UTF-16LE"))
    head = F.concat(_le(1 + i % 2, 8), _le(i * 7, 8), _le(i * 10000000 + times.EPOCH_1601, 8))
    content = F.unhex(F.when(i % 2 == 0, F.concat(head, wide)).otherwise(F.concat(head, _le(F.length(wide) / 2, 4), wide)))
    path = F.concat(F.lit("/$Recycle.Bin/S-1-5-21-"), (i % 9).cast("string"), F.lit("/$I"), i.cast("string"))
    found = texts.recycled(table(spark, sf_dir, "events").select(path.alias("path"), content.alias("content")))
    return found.select(F.substr("filename", F.lit(3)).cast("long").alias("event_id"), "filename", "version", "original_path", "file_size", F.unix_micros("deleted_time").alias("us"), "user_sid")


@query("""SELECT event_id AS usn, 'f' || lpad(event_id::VARCHAR, 9, '0') AS filename, event_id * 3 AS file_record_number, event_id % 5 AS file_sequence_number, event_id % 2 = 1 AS is_directory,
    CASE event_id % 3 WHEN 0 THEN 'FILE_CREATE' WHEN 1 THEN 'DATA_OVERWRITE,CLOSE' ELSE 'RENAME_NEW_NAME,CLOSE' END AS reasons, event_id * 1000000 AS us FROM events""")
def scan_change_journal(spark, sf_dir):
    """Journals of up to 500 entries each."""
    i = F.col("event_id")
    name = F.hex(F.encode(F.concat(F.lit("f"), F.lpad(i.cast("string"), 9, "0")), "UTF-16LE"))
    reason = F.when(i % 3 == 0, F.lit(0x100)).when(i % 3 == 1, F.lit(0x80000001)).otherwise(F.lit(0x80002000))
    numbers = ((F.lit(80), 4), (F.lit(2), 2), (F.lit(0), 2), (i * 3 + F.shiftleft(i % 5, 48), 8), (F.lit(5), 8), (i, 8), (i * 10000000 + times.EPOCH_1601, 8), (reason, 4), (F.lit(0), 4), (F.lit(0), 4), (i % 2 * 16, 4), (F.lit(20), 2), (F.lit(60), 2))
    entry = F.concat(*(_le(v, n) for v, n in numbers), name)
    parts = table(spark, sf_dir, "events").select(i, F.floor(i / 500).cast("string").alias("path"), entry.alias("entry")).groupBy("path")
    content = F.unhex(F.concat(F.repeat(F.lit("0"), 8192), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "entry"))), lambda x: x["entry"]), "")))
    found = binaries.change_journal(parts.agg(content.alias("content")))
    return found.select("usn", "filename", "file_record_number", "file_sequence_number", "is_directory", F.concat_ws(",", "reason_flags").alias("reasons"), F.unix_micros("timestamp").alias("us"))


@query("""SELECT event_id AS record_number, event_type AS first_string, event_id * 1000000 AS us FROM events""")
def scan_event_log(spark, sf_dir):
    """Event logs of one chunk of up to 200 records each."""
    i = F.col("event_id")
    body = F.concat(F.lit("0F010100"), F.hex(F.encode(F.rpad("event_type", 16, " "), "UTF-16LE")))
    size = F.length(body) / 2 + 28
    record = F.concat(F.lit("2A2A0000"), _le(size, 4), _le(i, 8), _le(i * 10000000 + times.EPOCH_1601, 8), body, _le(size, 4))
    parts = table(spark, sf_dir, "events").select(i, F.floor(i / 200).cast("string").alias("path"), record.alias("record")).groupBy("path")
    records = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "record"))), lambda x: x["record"]), "")
    zeros = lambda n: F.repeat(F.lit("00"), n)
    head = F.concat(F.hex(F.lit("ElfFile\0")), zeros(4088))
    chunk = F.concat(F.hex(F.lit("ElfChnk\0")), zeros(40), _le(F.length("records") / 2 + 512, 4), zeros(460), "records")
    logs = parts.agg(records.alias("records")).select("path", F.unhex(F.concat(head, chunk)).alias("content"))
    found = binaries.event_log(logs)
    return found.select("record_number", F.trim(F.get("extracted_strings", F.lit(0))).alias("first_string"), F.unix_micros("timestamp").alias("us"))

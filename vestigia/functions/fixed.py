"""Values that results depend on; each must stay exactly as it is."""

# Indicator patterns.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
IPV6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|"
    r"\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
)
TLDS = "com|net|org|edu|gov|mil|int|io|co|uk|de|fr|jp|cn|ru|br|au|in|info|biz|xyz|online|site|tech|app|dev|cloud|ai|me|tv|cc|ws|tk|ml|ga|cf|gq"
DOMAIN = rf"(?i)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+(?:{TLDS})\b"
URL = r"""(?i)\bhttps?://[^\s<>"']+\b"""
EMAIL = r"(?i)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
SHA1 = r"\b[a-fA-F0-9]{40}\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"

# Addresses and names that are no indicators.
PRIVATE = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.|169\.254\.)"
EXCLUDED_DOMAINS = ("localhost", "localhost.localdomain", "example.com", "example.org", "example.net", "test.com", "schema.org")
EXCLUDED_MAIL = ("@localhost", "@example.com", "@test.com")
URL_TAIL = ".,;:\"')"

# Event ids, their types, descriptions and severities.
EVENTS = {
    4624: ("logon", "User Logon", "medium"),
    4625: ("failed_logon", "Failed Logon", "high"),
    4634: ("logoff", "User Logoff", "medium"),
    4648: ("explicit_logon", "Explicit Credential Logon", "high"),
    4672: ("privilege_use", "Special Privileges Assigned", "high"),
    4688: ("process_create", "Process Creation", "medium"),
    4689: ("process_exit", "Process Exit", "medium"),
    4697: ("service_install", "Service Installed", "high"),
    4698: ("scheduled_task", "Scheduled Task Created", "high"),
    4699: ("scheduled_task", "Scheduled Task Deleted", "info"),
    4700: ("scheduled_task", "Scheduled Task Enabled", "info"),
    4701: ("scheduled_task", "Scheduled Task Disabled", "info"),
    4702: ("scheduled_task", "Scheduled Task Updated", "info"),
    4720: ("account", "User Account Created", "high"),
    4722: ("account", "User Account Enabled", "medium"),
    4725: ("account", "User Account Disabled", "medium"),
    4726: ("account", "User Account Deleted", "high"),
    4732: ("group", "Member Added to Security Group", "medium"),
    4733: ("group", "Member Removed from Security Group", "medium"),
    7045: ("service_install", "Service Installed", "high"),
}
NO_USER = ("-", "SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE")
NO_ADDRESS = ("-", "::1", "127.0.0.1", "")

# Words of the risk rules, in rule order.
POWERSHELL = {
    "encoded_command": ("-encodedcommand", "-enc "),
    "download_activity": ("invoke-webrequest", "iwr ", "wget ", "curl ", "downloadstring", "downloadfile", "net.webclient", "start-bitstransfer"),
    "execution_policy_bypass": ("bypass", "unrestricted"),
    "credential_access": ("get-credential", "convertto-securestring", "mimikatz", "invoke-mimikatz", "sekurlsa", "lsadump"),
    "ad_reconnaissance": ("get-aduser", "get-adcomputer", "get-adgroup", "get-netuser", "get-netcomputer", "get-netgroup", "get-domainuser"),
    "persistence_mechanism": ("new-scheduledtask", "register-scheduledjob", "new-service", "set-itemproperty.*run", "wmi ", "invoke-wmimethod"),
    "lateral_movement": ("invoke-command", "enter-pssession", "new-pssession", "invoke-wmimethod", "invoke-psexec", "invoke-smbexec"),
    "defense_evasion": ("set-mppreference", "add-mppreference", "-disablerealtimemonitoring", "amsi", "invoke-obfuscation"),
}
SEARCH = {
    "sensitive_search": ("password", "credential", "secret", "private", "ssh", "vpn", "bitcoin", "wallet"),
    "hack_tool_search": ("mimikatz", "metasploit", "nmap", "wireshark", "hashcat", "john", "burp", "sqlmap"),
}
RUN_MRU = {
    "powershell_execution": ("powershell",),
    "cmd_execution": ("cmd",),
    "network_command": ("net ", "netsh", "ipconfig"),
    "remote_access": ("mstsc", "psexec", "\\\\", "wmic"),
}
SERVICE_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\", "\\programdata\\", "\\users\\public\\")
SCRIPT_HOSTS = ("wscript", "cscript", "mshta")
OPEN_PORTS = ("445", "3389", "22", "23", "5985", "5986")
APP_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\", "\\downloads\\")
JOB_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\public\\", "\\programdata\\")
JOB_EXTENSIONS = (".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs", ".js", ".hta", ".scr", ".msi")
JOB_SHARES = ("pastebin.com", "paste.ee", "hastebin.com", "transfer.sh", "file.io", "anonfiles.com", "mega.nz", "mediafire.com")
TYPED_SHARES = ("pastebin", "paste.ee", "hastebin", "transfer.sh", "file.io", "mega.nz", "mediafire", "anonfiles", "dropbox")
TYPED_TLDS = (".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top")

# Artifacts that a collection knows: type, category, priority, paths, file pattern.
LOGS = "Windows/System32/winevt/Logs"
HIVES = "Windows/System32/config"
LOCAL = "Users/*/AppData/Local"
RECENT = "Users/*/AppData/Roaming/Microsoft/Windows/Recent"
ARTIFACTS = (
    ("evtx_security", "authentication", 1, (f"{LOGS}/Security.evtx",), None),
    ("evtx_system", "logs", 1, (f"{LOGS}/System.evtx",), None),
    ("evtx_application", "logs", 2, (f"{LOGS}/Application.evtx",), None),
    ("evtx_powershell", "execution", 1, (f"{LOGS}/Microsoft-Windows-PowerShell%4Operational.evtx", f"{LOGS}/Windows PowerShell.evtx"), None),
    ("evtx_sysmon", "execution", 1, (f"{LOGS}/Microsoft-Windows-Sysmon%4Operational.evtx",), None),
    ("prefetch", "execution", 1, ("Windows/Prefetch",), "*.pf"),
    ("amcache", "execution", 1, ("Windows/appcompat/Programs/Amcache.hve",), None),
    ("registry_sam", "authentication", 1, (f"{HIVES}/SAM",), None),
    ("registry_system", "registry", 1, (f"{HIVES}/SYSTEM",), None),
    ("registry_software", "registry", 1, (f"{HIVES}/SOFTWARE",), None),
    ("registry_ntuser", "user_activity", 2, ("Users/*/NTUSER.DAT",), None),
    ("mft", "file_system", 2, ("$MFT",), None),
    ("usnjrnl", "file_system", 2, ("$Extend/$UsnJrnl:$J",), None),
    ("browser_chrome", "user_activity", 2, (f"{LOCAL}/Google/Chrome/User Data/Default/History", f"{LOCAL}/Google/Chrome/User Data/Default/Cookies"), None),
    ("browser_edge", "user_activity", 2, (f"{LOCAL}/Microsoft/Edge/User Data/Default/History",), None),
    ("scheduled_tasks", "persistence", 1, ("Windows/System32/Tasks",), None),
    ("lnk_files", "user_activity", 2, (RECENT, "Users/*/Desktop/*.lnk"), "*.lnk"),
    ("jump_lists", "user_activity", 2, (f"{RECENT}/AutomaticDestinations", f"{RECENT}/CustomDestinations"), None),
)
# Presets of a collection: categories, artifact types, largest file in MB.
SCOPES = {
    "minimal": (("execution", "authentication"), ("evtx_security", "prefetch", "amcache"), 100),
    "standard": (("execution", "persistence", "authentication", "logs"), (), 100),
    "comprehensive": ((), (), 500),
    "malware": (
        ("execution", "persistence", "file_system"),
        ("prefetch", "shimcache", "amcache", "services", "scheduledtasks", "evtx_security", "evtx_system", "evtx_powershell"),
        100,
    ),
    "lateral_movement": (("authentication", "network"), ("evtx_security", "evtx_rdp", "firewall", "dns_cache"), 100),
    "data_exfiltration": (("file_system", "network", "user_activity"), ("usnjrnl", "mft", "browser_history", "recent_files", "shellbags"), 100),
}

# Words and paths of the risk rules by artifact; fixed values.
POWERSHELL_NAMES = ("powershell", "pwsh")
ENCODED = ("-enc", "-encodedcommand")
WMI_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\", "\\programdata\\")
WMI_TOOLS = ("cmd.exe", "wscript", "cscript", "mshta", "regsvr32")
WMI_DOWNLOADS = ("downloadstring", "invoke-expression", "iex", "webclient", "downloadfile")
WMI_STARTUP = ("win32_logonsession", "startup", "logon")
RUN_HOSTS = ("powershell", "cmd.exe", "wscript", "cscript", "mshta")
BAM_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\public\\", "\\downloads\\", "\\users\\public\\")
BAM_REMOTE = ("psexec", "paexec", "winrm", "wmic")
BAM_TOOLS = ("mimikatz", "procdump", "rubeus", "lazagne", "bloodhound")
MUI_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\public\\", "\\downloads\\", "\\desktop\\")
MUI_REMOTE = ("psexec", "winrm", "wmic", "mstsc")
MUI_TOOLS = ("mimikatz", "procdump", "lazagne", "rubeus")
MUI_EXTENSIONS = ("exe", "msc", "cpl", "dll")
RECENT_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\downloads\\", "\\public\\")
RECENT_REMOTE = ("psexec", "mstsc", "wmic", "winrm")
RECENT_TOOLS = ("mimikatz", "procdump", "lazagne", "rubeus", "bloodhound")
CRASH_CODES = ("c0000005", "c00000fd", "c000001d", "c0000096", "c0000409", "80000003")
CRASH_APPS = {
    "system_process_crash": ("lsass.exe", "csrss.exe", "services.exe", "svchost.exe", "winlogon.exe"),
    "security_software_crash": ("defender", "antivirus", "antimalware", "security"),
    "browser_crash": ("chrome", "firefox", "edge", "iexplore", "opera"),
    "office_crash": ("winword", "excel", "powerpnt", "outlook"),
}
CRASH_MODULES = ("flash", "java", "silverlight", "acrobat", "reader")
CACHE_PATHS = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\users\\public\\", "\\programdata\\")
CACHE_SCRIPTS = (".ps1", ".bat", ".cmd", ".vbs", ".js", ".hta")
CACHE_TOOLS = ("mimikatz", "procdump", "psexec", "lazagne")
#: Columns shown for records of a kind when none are named; fixed values.
SHOWN_COLUMNS = {"event_id": ("timestamp", "event_id", "provider_name", "channel", "computer"), "run_count": ("timestamp", "executable_name", "run_count"), "key_path": ("timestamp", "key_path", "value_name")}

#: The columns that are shown of records whose data has the field.
SHOWN_COLUMNS = {
    "event_id": ("timestamp", "data.event_id", "data.channel", "data.record_number"),
    "executable_name": ("timestamp", "data.executable_name", "data.run_count", "data.last_run_time"),
    "key_path": ("data.key_path", "data.value_name", "data.value_type", "data.value_data"),
}

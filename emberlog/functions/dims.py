"""Rule vocabularies: word lists, lookup tables, patterns and messages, as Python text."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Fixed values. Everything from here to the end mark must be exactly this for right results.

STAGE_WORDS = {
    "reconnaissance": ("scan", "nmap", "enumerat", "probe", "discovery", "recon"),
    "initial_access": ("login failed", "brute", "phish", "exploit", "public-facing", "webshell", "valid account"),
    "execution": ("powershell", "cmd.exe", "bash", "exec", "spawn", "script", "payload"),
    "persistence": ("scheduled task", "cron", "service install", "registry run", "startup", "backdoor"),
    "privilege_escalation": ("sudo", "uac", "privilege", "root", "administrator", "setuid", "token"),
    "defense_evasion": ("disable", "clear log", "tamper", "obfuscat", "encodedcommand", "bypass"),
    "credential_access": ("credential", "password", "hash", "lsass", "mimikatz", "secrets", "token"),
    "discovery": ("whoami", "hostname", "net user", "ipconfig", "ifconfig", "systeminfo", "ldap"),
    "lateral_movement": ("rdp", "ssh", "psexec", "winrm", "smb", "remote service", "lateral"),
    "collection": ("archive", "collect", "compress", "staging", "clipboard", "screenshot"),
    "command_and_control": ("c2", "beacon", "callback", "dns tunnel", "tor", "command and control"),
    "exfiltration": ("exfil", "upload", "mega", "dropbox", "s3", "ftp", "data transfer"),
    "impact": ("encrypt", "ransom", "wipe", "delete shadow", "ddos", "deface", "destruct"),
}
SERVICE_WORDS = {
    "ssh": ("ssh", "sshd", "port 22"),
    "rdp": ("rdp", "mstsc", "port 3389"),
    "http": ("http", "apache", "nginx", "iis", "port 80"),
    "https": ("https", "tls", "ssl", "port 443"),
    "dns": ("dns", "bind", "port 53"),
    "smb": ("smb", "samba", "port 445"),
    "database": ("mysql", "postgres", "mssql", "mongodb", "redis", "database"),
    "email": ("smtp", "imap", "pop3", "exchange", "mail"),
    "kubernetes": ("kubernetes", "kubectl", "kubelet", "pod"),
    "aws": ("aws", "cloudtrail", "ec2", "iam", "s3"),
}
IOC_PATTERNS = {
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b",
    "domain": r"\b(?:[a-zA-Z0-9-]+\.)+[A-Za-z]{2,}\b",
    "url": r"https?://[^\s,;\]')\"]+",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "sha256": r"\b[A-Fa-f0-9]{64}\b",
    "sha1": r"\b[A-Fa-f0-9]{40}\b",
    "md5": r"\b[A-Fa-f0-9]{32}\b",
    "file_path": r"(?:[A-Za-z]:\\[^\s,;]+|/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+)",
}
CVE_PATTERN = r"\bCVE-\d{4}-\d{4,7}\b"
MALFORMED_CVE_PATTERN = r"\bCVE-\d{4}-\d{1,3}\b|\bCVE-\d{2,3}-\d{4,7}\b"
TECHNIQUE_PATTERN = r"\bT\d{4}(?:\.\d{3})?\b"
ASSET_PATTERNS = (
    r"\b(?:host|hostname|src_host|dst_host|asset|server|endpoint|node|workstation|instance|pod)[:= ]+([A-Za-z0-9._:@/-]+)",
    r"\b(?:user|account|principal|username)[:= ]+([A-Za-z0-9._@/-]+)",
)
TRIMMED = ".,;()[]{}'"

CRITICAL_WORDS = ("critical", "ransom", "exfil", "domain admin", "root compromise")
HIGH_STAGES = ("lateral_movement", "credential_access", "impact")
MEDIUM_WORDS = ("warning", "failed", "denied", "suspicious")
SUMMARY_CHARS = 240
NO_EVENTS = "No log events supplied."

TECHNIQUES = {
    "initial_access": ("T1190", "Exploit Public-Facing Application"),
    "execution": ("T1059", "Command and Scripting Interpreter"),
    "persistence": ("T1053", "Scheduled Task/Job"),
    "privilege_escalation": ("T1068", "Exploitation for Privilege Escalation"),
    "defense_evasion": ("T1070", "Indicator Removal"),
    "credential_access": ("T1003", "OS Credential Dumping"),
    "discovery": ("T1087", "Account Discovery"),
    "lateral_movement": ("T1021", "Remote Services"),
    "command_and_control": ("T1071", "Application Layer Protocol"),
    "exfiltration": ("T1041", "Exfiltration Over C2 Channel"),
    "impact": ("T1486", "Data Encrypted for Impact"),
    "reconnaissance": ("T1595", "Active Scanning"),
}
MITIGATIONS = {
    "initial_access": ("Patch exposed services", "Restrict ingress to trusted networks"),
    "execution": ("Constrain script interpreters", "Enable command-line logging"),
    "credential_access": ("Reset exposed credentials", "Enable LSASS protection and MFA"),
    "lateral_movement": ("Disable unnecessary remote services", "Segment affected networks"),
    "command_and_control": ("Block known C2 indicators", "Add DNS/HTTP egress monitoring"),
    "exfiltration": ("Throttle and inspect outbound transfers", "Preserve proxy and NetFlow evidence"),
    "impact": ("Isolate impacted hosts", "Restore from known-good immutable backups"),
}
DETECTION_RULES = {
    "ssh": ("Alert on repeated SSH failures from one source",),
    "rdp": ("Alert on anomalous RDP source geolocation",),
    "http": ("Detect exploit strings and webshell uploads in web logs",),
    "https": ("Inspect rare JA3/SNI combinations for egress beacons",),
    "dns": ("Detect high-entropy DNS queries and tunneling volume",),
    "smb": ("Alert on PsExec-like service creation over SMB",),
    "aws": ("Alert on unusual IAM policy changes and S3 bulk reads",),
}
PROMPT_LINES = (
    "Structured security context for incident response:",
    "- Incident: {incident_id} severity={severity}",
    "- Assets: {assets}",
    "- Services: {services}",
    "- CVEs: {cves}",
    "- MITRE ATT&CK context: {techniques}",
    "- Recommended mitigations/rules: {advice}",
    "- KG facts: {nodes} nodes, {edges} edges",
)

ACTION_WORDS = {
    "containment": ("isolate", "block", "disable", "quarantine", "contain", "disconnect", "deny", "sinkhole"),
    "evidence_acquisition": ("image", "capture", "collect", "preserve", "export", "snapshot", "forensic", "memory", "disk"),
    "eradication": ("remove", "delete", "eradicate", "clean", "patch", "rotate", "revoke", "terminate", "kill"),
    "recovery": ("restore", "rebuild", "recover", "reimage", "redeploy", "restart", "resynchronize"),
    "investigation": ("analyze", "inspect", "review", "query", "hunt", "scan", "triage", "correlate", "verify"),
    "notification": ("notify", "escalate", "report", "contact", "open ticket", "inform"),
    "monitoring": ("monitor", "watch", "alert", "log", "baseline", "detect"),
}
TARGET_PATTERNS = (
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:host|server|workstation|endpoint|vm|container|pod|node|account|user|service|database|bucket|subnet|vlan|firewall|router|switch|domain|url|process|file)[:= ]+[A-Za-z0-9._:/@-]+",
    r"\b[A-Za-z]:\\[^\s,;]+",
    r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+",
    r"\b[a-zA-Z0-9][a-zA-Z0-9._-]{1,}\.(?:exe|dll|sh|py|conf|log|service)\b",
)
QUOTED_COMMAND_PATTERN = r"`([^`]+)`"
COMMAND_PATTERN = r"\b(?:sudo\s+)?(?:iptables|ufw|netsh|systemctl|service|kubectl|docker|aws|az|gcloud|ssh|scp|rsync|dd|volatility|tcpdump|tshark|yara|grep|find|chmod|chown|rm|mv|cp|kill|pkill|passwd|usermod|auditctl|journalctl|wevtutil|powershell|Get-[A-Za-z]+|Set-[A-Za-z]+|New-[A-Za-z]+|Remove-[A-Za-z]+)\b[^.;\n]*"
ITEM_FIELDS = {
    "source_action": ("action", "response", "plan", "command", "text"),
    "source_explanation": ("explanation", "rationale", "reason"),
    "action_type": ("action_type", "type", "category"),
    "target": ("target", "targets", "asset", "assets", "host", "hosts"),
    "command": ("command", "commands"),
    "evidence": ("evidence", "artifacts", "logs"),
    "precondition": ("precondition", "preconditions"),
    "risk": ("risk", "risks"),
    "rollback": ("rollback", "backout", "revert"),
}
EVIDENCE_WORDS = ("evidence", "log", "image", "snapshot", "pcap", "netflow", "audit", "forensic")
PRECONDITION_WORDS = ("before", "after confirming", "if ", "provided", "only when", "ensure")
RISK_WORDS = ("risk", "impact", "downtime", "disrupt", "data loss", "false positive")
ROLLBACK_WORDS = ("rollback", "revert", "restore", "undo", "back out")

EXECUTABLES = (
    "auditctl", "aws", "az", "chmod", "chown", "cp", "dd", "docker", "find", "gcloud", "grep", "iptables", "journalctl", "kubectl", "kill", "mv", "netsh",
    "passwd", "pkill", "powershell", "rm", "rsync", "scp", "service", "ssh", "sudo", "systemctl", "tcpdump", "tshark", "ufw", "usermod", "volatility", "wevtutil", "yara",
)
EXECUTABLE_PREFIXES = ("get-", "set-", "new-", "remove-")
HIGH_RISK_PATTERNS = (
    (r"\brm\s+-rf\s+/(?:\s|$)", "recursive deletion of filesystem root"),
    (r"\bdd\b[^\n;]*\bof=/dev/(?:sd|nvme|xvd|vd)", "raw disk overwrite"),
    (r"\bmkfs(?:\.[a-z0-9]+)?\b", "filesystem formatting"),
    (r"\bshutdown\b|\breboot\b", "host shutdown or reboot"),
    (r"\biptables\s+-F\b|\bufw\s+disable\b", "firewall policy flush or disable"),
    (r"\bkill\s+-9\s+1\b", "terminating init/system process"),
)
DESTRUCTIVE_TYPES = ("eradication", "recovery")
FIRST_CVE_YEAR = 1999
MESSAGES = {
    "malformed_cve": "Malformed CVE identifier.",
    "cve_year": "CVE year is outside the plausible public CVE range.",
    "unknown_cve": "CVE was not present in KG-RAG context or allow-list; verify before using it as evidence.",
    "unreadable_command": "Command cannot be parsed safely: {error}.",
    "empty_command": "Command is empty after parsing.",
    "unknown_executable": "Command executable is not in the known incident-response command allow-list.",
    "high_risk": "Blocked high-risk operation: {reason}.",
    "no_rollback": "Destructive or recovery actions must include an explicit rollback/backout plan.",
    "no_evidence": "Destructive or recovery actions should cite evidence before execution.",
    "foreign_technique": "Referenced ATT&CK technique is not linked to the incident KG path.",
    "silent_path": "Generated action does not reference the KG-RAG attack stage or ATT&CK path.",
    "summary": "Post-processing {status}: {total} action(s), {blocked} blocked, {errors} error(s), {warnings} warning(s).",
}
VALIDATION_MESSAGES = {
    "relations": "missing KG relations: [{names}]",
    "no_incident": "KG context is missing incident node",
    "no_prompt": "KG context is missing prompt_context",
}
INPUT_MESSAGES = {
    "not_records": "Evaluation input must be a JSON object, array of objects, or JSONL objects.",
    "no_generation": "Each evaluation record must contain one of {names}.",
    "ratio": "test_ratio must be greater than 0 and less than 1.",
    "too_few": "At least two examples are required to create non-empty train and test sets.",
    "unequal": "Baseline and candidate files must contain the same number of records.",
    "unpaired": "Record {index} is not paired: baseline ID {baseline!r} != candidate ID {candidate!r}.",
}
EVALUATION_KEYS = ("generation", "generated_response", "response", "actions")
CONTEXT_KEYS = ("kg_context", "security_context")
ID_KEYS = ("id", "record_id", "incident_id", "prompt_id")
ENRICHMENT_PREAMBLE = "Use the following preprocessed structured incident JSON and KG-RAG security context when producing the response plan."
RELATIONS = (("cves", "mentions_cve"), ("assets", "affects_asset"), ("services", "involves_service"), ("iocs", "has_ioc"), ("attack_stages", "has_attack_stage"))
TEST_RATIO, SPLIT_SEED = 0.2, 99125

# End of the fixed values.
# ---------------------------------------------------------------------------------------------


def least(words: tuple[str, ...]) -> tuple[str, ...]:
    """Without words that hold another one of the group: a text with them has the other as well."""
    return tuple(w for w in words if not any(o != w and o in w for o in words))

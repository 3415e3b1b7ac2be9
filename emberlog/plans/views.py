"""Views that derive log lines and generated responses from the test tables.

The SQL is plain enough for Spark and DuckDB to read it alike (chr() where their string literals
differ); @name stands for a table. Every view is a narrow projection of one table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from emberlog.runtime import dealt

LOG_LINES = """
SELECT concat('inc-', user_id, '-', cast(cast(ts AS date) AS string)) AS incident_id, event_id AS line_no,
  CASE event_type
    WHEN 'error' THEN concat('  login failed for user=u', user_id, ' from src=203.0.113.', event_id % 250, ' host=web-', user_id % 7, ' service=sshd port 22 CVE-2023-', 1000 + event_id % 9000, ' and cve-2023-', 1000 + event_id % 9000)
    WHEN 'click' THEN concat('powershell payload from https://c2.example', event_id % 9, '/p/', event_id % 50, '?a=1; account=alice', user_id % 5, '. md5 ', md5(cast(event_id AS string)))
    WHEN 'purchase' THEN concat('warning: upload to http://files', event_id % 4, '.example:8080/x/', event_id % 30, ', hash ', md5(cast(event_id AS string)), md5(cast(user_id AS string)), ' at 12:34:', 10 + event_id % 50, ' by bob', user_id % 3, '@mail.example')
    WHEN 'signup' THEN concat('Server was started, cmd.exe /c run in /opt/app-', user_id % 11, '/bin/start.sh with fe80:1:2:', event_id % 9, ' asset: [db-', user_id % 6, '].')
    ELSE CASE WHEN event_id % 3 = 0 THEN '   ' WHEN event_id % 97 = 0 THEN concat('CRITICAL ransom note on endpoint=', md5(cast(user_id AS string))) ELSE concat('page view ', event_id % 100, ' ok') END
  END AS line
FROM @events
"""

RECORDS = """
SELECT m.model, o.o_orderkey AS record_index, o.o_orderkey % 40 AS n, concat('r', o.o_orderkey) AS record_id,
  CASE WHEN m.model = 'baseline' THEN o.o_orderkey % 12 ELSE (o.o_orderkey * 5 + o.o_custkey) % 12 END AS k,
  CASE WHEN o.o_custkey % 4 = 0 THEN concat('Exploit attempt CVE-2023-', 1000 + o.o_orderkey % 40, ' on host=web-', o.o_orderkey % 40, ' http service')
       WHEN o.o_custkey % 4 = 1 THEN concat('ssh login failed from 198.51.100.', o.o_orderkey % 40, ' node: db-', o.o_orderkey % 40)
       WHEN o.o_custkey % 4 = 2 THEN 'page view ok'
       ELSE concat('powershell payload, credential dump and cve-2024-', 2000 + o.o_orderkey % 40, ' user=eve') END AS line
FROM @orders o CROSS JOIN (SELECT 'baseline' AS model UNION ALL SELECT 'candidate' AS model) m
"""

GENERATIONS = f"""
SELECT model, record_index, record_id, line,
  CASE k
    WHEN 0 THEN concat('{{"Action": "Capture traffic with `tcpdump -i eth0 host 10.0.0.', n, '` on server web-', n, ' before changes.", "Explanation": "Preserve evidence for CVE-2023-', 1000 + n, ' and T1190. Rollback is not needed."}}')
    WHEN 1 THEN concat('{{"Action": "Delete files with `rm -rf / ` now.", "Explanation": "Remove the backdoor CVE-2999-1234, see T9999 and node-', n, '."}}')
    WHEN 2 THEN concat('{{"Action": "Run `frobnicate --all` on host db-', n, '; notify the owner."}}')
    WHEN 3 THEN concat('[{{"action": "Isolate host web-', n, '", "command": "iptables -F; systemctl restart sshd; iptables -F", "rollback": "restore rules"}}, {{"action_type": "eradication", "target": "a-', n, ', b-', n, '", "command": "kill -9 1", "evidence": "disk image, netflow"}}]')
    WHEN 4 THEN concat('{{"actions": [{{"plan": "Monitor alerts and review logs.", "rationale": "If risk grows, escalate."}}, {{"text": "Block 198.51.100.', n, ' with `ufw deny from 198.51.100.', n, '`.', chr(92), 'nRestore access later."}}]}}')
    WHEN 5 THEN concat('Quarantine server mail-', n, ' and revoke tokens for user=bob-', n, '. Ensure backups exist before restart. Downtime is a risk! Use systemctl stop postfix; review /etc/ssh/sshd_config, auth.log and ops', n, '@mail.example.')
    WHEN 6 THEN concat('Explanation follows: {{"Action": "Reimage workstation ws-', n, '; CVE-23-12345 and cve-2023-12.", "Explanation": "Revert by snapshot."}} Thanks.')
    WHEN 7 THEN concat('{{"Action": "Run `grep ', chr(39), 'x-', n, '` today"}}')
    WHEN 8 THEN '[]'
    WHEN 9 THEN concat('{{"Action": "Use sudo -u admin cat /var/log/auth.log on vm=app', n, '", "Explanation": "t1059 and CVE-1998-0001 noted for lateral movement."}}')
    WHEN 10 THEN concat('{{"Action": "Get-Process and `dd if=/dev/zero of=/dev/sda', n, '` then shutdown", "risk": "high", "evidence": ""}}')
    ELSE concat('{{"action": null, "response": "ignored ', n, '", "Explanation": "Restore the database from backup: verify image."}}')
  END AS generation
FROM ({RECORDS}) r
"""

EXAMPLES = f"SELECT record_index AS source_index, line AS instruction, generation AS answer FROM ({GENERATIONS}) g WHERE model = 'baseline'"

_NAME = re.compile(r"@(events|orders|customer|documents|pages)\b")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows in Spark; its tables are registered under names of their own.

    The tables' rows are dealt before the view makes texts of them, when only the columns it reads go along.
    """
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]

    def named(m: re.Match) -> str:
        name = f"emberlog_{tag}_{m[1]}"
        dealt(spark.read.parquet(f"{sf_dir}/{m[1]}.parquet")).createOrReplaceTempView(name)
        return name

    return spark.sql(_NAME.sub(named, sql))


def plain(sql: str) -> str:
    """The SQL for an engine in which the tables have their own names."""
    return _NAME.sub(lambda m: m[1], sql)

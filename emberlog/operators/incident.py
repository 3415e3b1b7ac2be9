"""Incidents from log lines: indicators, CVEs, assets, services, attack stages, severity.

All extraction is narrow: one projection per text. Lines of an incident meet in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import dims
from emberlog.functions.textfx import contains_any, distinct_values, extract_all, groups_present, guarded, java, let, strip
from emberlog.runtime import by_key

#: A text that lacks all of these has no match of the pattern. Patterns of hashes fail quickly by themselves.
_GUARDS = {"ipv4": (".",), "ipv6": (":",), "domain": (".",), "url": ("://",), "email": ("@",), "sha256": (), "sha1": (), "md5": (), "file_path": ("/", ":\\")}
#: type, pattern, guards, in the order of results.
IOC_RULES = tuple((kind, java(p), _GUARDS[kind]) for kind, p in dims.IOC_PATTERNS.items())
CVE = java(dims.CVE_PATTERN, True)
ASSETS = tuple(java(p, True) for p in dims.ASSET_PATTERNS)
IOC_TYPE = "array<struct<type:string,value:string>>"


def _found(text: Column, pattern: str, guards: tuple[str, ...]) -> Column:
    values = distinct_values(extract_all(text, pattern))
    return guarded(contains_any(text, guards), values) if guards else values


def ioc_arrays(text: Column) -> dict[str, Column]:
    """Of each indicator type the distinct values, in order of appearance, before domains are sifted."""
    return {kind: _found(text, pattern, guards) for kind, pattern, guards in IOC_RULES}


def url_hosts(urls: Column) -> Column:
    """What stands between the scheme and the first slash, lower-cased; ports and queries stay."""
    return F.transform(urls, lambda u: F.lower(F.substring_index(F.regexp_replace(u, "^https?://", ""), "/", 1)))


def email_hosts(emails: Column) -> Column:
    return F.transform(emails, lambda m: F.lower(F.regexp_extract(m, "(?s)^[^@]*@(.*)$", 1)))


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def with_iocs(df: DataFrame, text_col: str = "text", into: str = "iocs") -> DataFrame:
    """df with an array of (type, value); domains that URLs or e-mail addresses name are left out."""
    names = {kind: f"__ioc_{kind}" for kind, _, _ in IOC_RULES}
    found = df.withColumns({names[k]: c for k, c in ioc_arrays(F.col(f"`{text_col}`")).items()})
    taken = F.array_union(url_hosts(F.col(names["url"])), email_hosts(F.col(names["email"])))
    found = found.withColumn("__taken", taken)
    kept = {k: F.col(n) for k, n in names.items()} | {"domain": let(F.col("__taken"), lambda taken: F.filter(names["domain"], lambda d: ~F.array_contains(taken, F.lower(d))))}
    return found.withColumn(into, F.concat(*[_typed(k, kept[k]) for k, _, _ in IOC_RULES])).drop(*names.values(), "__taken")


def extract_cves(text: Column) -> Column:
    return distinct_values(F.transform(extract_all(text, CVE), F.upper))


def extract_assets(text: Column) -> Column:
    """Host-like fields first, then user-like ones."""
    return distinct_values(F.concat(*[extract_all(text, p, 1) for p in ASSETS]))


def infer_services(lowered: Column) -> Column:
    return groups_present(lowered, dims.SERVICE_WORDS)


def infer_stages(lowered: Column) -> Column:
    return groups_present(lowered, dims.STAGE_WORDS)


def infer_severity(lowered: Column, cves: Column, stages: Column) -> Column:
    """Graded: critical words; any CVE or a grave stage; warning words; any text; nothing."""
    grave = F.arrays_overlap(stages, F.array(*map(F.lit, dims.HIGH_STAGES)))
    return (
        F.when(contains_any(lowered, dims.CRITICAL_WORDS), "critical")
        .when((F.size(cves) > 0) | grave, "high")
        .when(contains_any(lowered, dims.MEDIUM_WORDS), "medium")
        .when(strip(lowered) != "", "low")
        .otherwise("unknown")
    )


def incidents(events: DataFrame, observed_at: str = "", source: str = "log_parser") -> DataFrame:
    """events(incident_id, raw_events: stripped non-empty lines) to incident rows; other columns stay."""
    text = events.withColumn("__text", F.array_join("raw_events", "\n"))
    found = with_iocs(text, "__text").withColumn("__low", F.lower("__text"))
    found = found.withColumns({"cves": extract_cves(F.col("__text")), "assets": extract_assets(F.col("__text")), "services": infer_services(F.col("__low")), "attack_stages": infer_stages(F.col("__low"))})
    head = F.when(F.size("raw_events") > 0, F.substring(F.get("raw_events", 0), 1, dims.SUMMARY_CHARS)).otherwise(dims.NO_EVENTS)
    extra = [c for c in events.columns if c not in ("incident_id", "raw_events")]
    return found.select(
        *extra, "incident_id", F.lit(observed_at).alias("observed_at"), head.alias("summary"), "iocs", "cves", "assets", "services", "attack_stages",
        infer_severity(F.col("__low"), F.col("cves"), F.col("attack_stages")).alias("severity"), F.lit(source).alias("source"), "raw_events",
    )


def parse_lines(lines: DataFrame, observed_at: str = "") -> DataFrame:
    """lines(incident_id, line_no, line) to one incident for each id; blank lines are dropped, order is by line_no.

    Lines are few bytes but costly, so they are dealt by id over many partitions, which Spark doesn't join by their bytes.
    """
    kept = by_key(lines.select("incident_id", "line_no", strip(F.col("line")).alias("line")), "incident_id")
    grouped = kept.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("line_no", "line")))).alias("l"))
    return incidents(grouped.select("incident_id", F.transform("l", lambda x: x["line"]).alias("raw_events")), observed_at)


def parse_texts(texts: DataFrame, id_col: str, text_col: str, observed_at: str = "") -> DataFrame:
    """One incident for each row, whose text is one log entry. Narrow; works on streams."""
    clean = strip(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    events = F.when(clean != "", F.array(clean)).otherwise(F.array().cast("array<string>"))
    return incidents(texts.select(F.col(f"`{id_col}`").alias("incident_id"), events.alias("raw_events")), observed_at)

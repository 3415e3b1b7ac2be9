"""Secrets of any length after key-like words, in logins, and after letters that are not ASCII."""

from emberlog.llm import secrets


def test_short_values_and_logins(spark):
    long = "aZ3kQ9xL2mN8vB5cT7wR1yU4iO6pS0dF2gH1"
    texts = ['password = "S3cr3t!pw"', "db at postgres://admin:Tr0ub4dor&3@db.example.org/x", "api_key: a8f03c9be17d45", f"\u5bc6\u94a5{long} token", "aws_secret_access_key_of_us = 'k9#Lm2!qZ'", "password: required", "token = null and key: value", "the author: Martin wrote at 12:30"]
    frame = spark.createDataFrame([(k, t, "src") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc_id: [(f.value, f.is_secret) for f in r.findings] for r in secrets.scan(frame).collect()}
    assert ("S3cr3t!pw", True) in found[0] and ("Tr0ub4dor&3", True) in found[1] and ("a8f03c9be17d45", True) in found[2]
    assert long in [v for v, _ in found[3]] and ("k9#Lm2!qZ", True) in found[4]
    assert not any(hit for k in (5, 6, 7) for _, hit in found[k])
    clean = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert clean[0] == 'password = "[secret]"' and clean[1] == "db at postgres://admin:[secret]@db.example.org/x" and clean[5] == texts[5]

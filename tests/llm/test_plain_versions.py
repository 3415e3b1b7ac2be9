"""License scans, URL rules and the secrets' forest against plain versions, SQL and held-out findings."""

import re
from collections import Counter

import duckdb
from conftest import SMALL

from emberlog.llm import licenses, secrets, url_rules
from emberlog.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x[1] for x in at}))


def test_licenses_base(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "MIT-License under the (MIT) licenses"), (-4, "Under The MIT License; under the mit license"), (-4, "Under The MIT License; under the mit license"), (-5, "x" * 100_000), (-6, "cc by cc by nc by nc"), (-7, "apache license version 2.0 apache license version 20")]
    every = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    found = licenses.scan_licenses(every).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in every.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in found)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_url_rules_agree_with_sql(spark):
    got = url_rules.report(table(spark, SMALL, "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({url_rules.ORACLE_SQL})").fetchall())
    odd = spark.createDataFrame([(1, "http://a.net/fr/x", "h", 1), (1, "http://a.net/fr/x", "h", 1), (None, None, None, None)], "page_id long, url string, host string, n_tried long")
    assert sorted((r.page_id or 0, r.verdict) for r in url_rules.report(odd).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert url_rules.report(odd.limit(0)).count() == 0


def test_forest_on_held_out_findings(spark):
    """Findings of another seed: the same rules made them, so this tells of the forest, not of the world."""
    trees = secrets.trained_forest(spark)
    held = secrets.labelled_findings(1000, 991)
    frame = spark.createDataFrame([tuple(h.values()) for h in held], "value string, before string, near string, after string, path string, label int")
    scored = frame.select(secrets.features(*[secrets.F.col(c) for c in ("value", "before", "near", "after", "path")]).alias("f"), "label").collect()
    told = [(secrets.vote(trees, [r.f[k] for k in secrets.FEATURES]) >= 0.5, bool(r.label)) for r in scored]
    hit = sum(a and b for a, b in told)
    precision, recall = hit / sum(a for a, _ in told), hit / sum(b for _, b in told)
    print(f"precision {precision:.3f} recall {recall:.3f} of {len(told)}")
    assert precision >= 0.9 and recall >= 0.9

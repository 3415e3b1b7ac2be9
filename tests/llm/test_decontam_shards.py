"""Many shards, long items, nulls and repeats: the same results as with one automaton."""

from pyspark.sql import functions as F

from emberlog.llm import decontam


def test_shards_give_the_same(spark):
    words = [f"w{k}" for k in range(400)]
    items = [(1, " ".join(words[:120])), (2, " ".join(words[200:215])), (3, "short one here"), (None, " ".join(words[300:311])), (5, None), (6, ""), (7, " ".join(words[:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = " ".join(f"c{k}" for k in range(60))
    closing = " ".join([*words[200:207], *words[300:311], *words[207:215]])  # what closes up after a cut is an item again
    texts = [None, "", clean, f"{clean} {' '.join(words[50:62])}", f"{clean} {closing} {clean}", " ".join(words[:100]), f"{clean}. Short, one HERE! {clean}", "same", "same"]
    rows = [(k, t, "en", k, "x") for k, t in enumerate(texts)] + [(None, clean, None, 1, "y"), (2, clean, "en", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans long, items string")
    told = lambda **o: sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination(docs, bench, **o).collect())
    left = lambda **o: sorted((r.doc_id or -1, r.text or "", r.lang or "", r.spans, r.items) for r in decontam.decontaminate(docs, bench, **o).collect())
    assert told() == told(words_per_automaton=40) and len(told()) == len(rows)
    kept = left()
    assert kept == left(words_per_automaton=40)
    by_id = {r[0]: r[1] for r in kept}
    assert 5 not in by_id and by_id[2] == clean and by_id[4].split() == clean.split() * 2 and by_id[3].strip() == clean
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.where(F.lit(False))).count() == len(rows)

"""Each pipeline stage against brute force on its own input, and on rows with nulls, repeats and clashing names."""

import base64
import re

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL

from emberlog.llm import quality, secrets
from emberlog.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def firsts(texts):
    """Of every component of texts (five-word shingles, Jaccard of 0.8 or more) the least id."""
    ids = sorted(texts)
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", texts[k].translate(LOWER)) for k in ids}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if not sets[a] and not sets[b] or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k for k in ids if find(k) == k}


def cleaned(text, windows):
    """The text without what an item holds, scanned until nothing is left; None if more than half of its words go."""
    total, gone = len(WORD.findall(text.translate(LOWER))), 0
    while True:
        at = list(WORD.finditer(text.translate(LOWER)))
        words = [m[0] for m in at]
        hit = {i for size in {len(w) for w in windows} for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in windows for i in range(k, k + size)}
        if not hit:
            return text
        gone += len(hit)
        if gone > 0.5 * total:
            return None
        runs, out, done = [], [], 0
        for i in sorted(hit):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        for a, b in runs:
            out.append(text[done : at[a].start()])
            done = at[b - 1].end()
        text = "".join([*out, text[done:]])


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    kept = pipeline.drop_low_quality(spark, docs, SMALL)
    model = quality.train(docs, table(spark, SMALL, "labels"))
    before = texts_of(docs)
    good = {k: t for k, t in before.items() if model.score(quality.np.array([quality.statistics(t.encode())]))[0] >= 0.7}
    assert texts_of(kept) == good and 0 < len(good) < len(before)

    unique = pipeline.materialize(pipeline.drop_near_duplicates(spark, kept, SMALL), "unique")
    assert texts_of(unique) == {k: good[k] for k in firsts(good)}

    windows = set()
    for r in table(spark, SMALL, "benchmark").collect():
        words = WORD.findall((r.text or "").translate(LOWER))
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    clean = pipeline.cut_benchmark_leaks(spark, unique, SMALL)
    want = {k: c for k, t in texts_of(unique).items() if (c := cleaned(t, windows)) is not None}
    assert texts_of(clean) == want and any(want[k] != good[k] for k in want)

    redacted = pipeline.materialize(pipeline.redact_secrets(spark, clean, SMALL), "redacted")
    told = {r.doc_id: sorted({f.value for f in r.findings if f.is_secret}, key=len, reverse=True) for r in secrets.scan(clean).collect()}
    after = texts_of(redacted)
    for k, text in want.items():
        for value in told[k]:
            text = text.replace(value, "[secret]") if len(value) >= secrets.LEAST else re.sub(rf"(?<![A-Za-z0-9]){re.escape(value)}(?![A-Za-z0-9])", "[secret]", text)
        assert after[k] == text
    assert all(r.n_chars == len(r.text) for r in redacted.collect())

    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    assert all(r.ids == library.encode_ordinary(after[r.doc_id]) for r in pipeline.encode_tokens(spark, redacted, SMALL).collect())


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, name):
    stage = dict(pipeline.STAGES)[name]
    text = "these are some words of a text that nobody has written before and that reads like prose. " * 3
    rows = [(1, text, "en", "s", 5, 1, "x"), (1, text, "en", "s", 5, 1, "x"), (1, "another text of the same id", None, None, None, 2, "y"), (None, None, None, None, None, None, None), (2, None, None, "s", 0, 0, "z"), (3, "", "en", "s", 0, 0, "z"), (None, text, "en", "s", 1, 1, "x"), (4, "x" * 200_000, "en", "s", 1, 1, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, th string")
    made = stage(spark, odd, SMALL)
    got = made.collect()
    if name == "byte-level BPE":
        assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got)
    else:
        assert tuple(made.columns) == pipeline.COLUMNS and len(got) <= len(rows)
    if name == "SimHash near-dedup":
        assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(1, text), (1, "another text of the same id"), (2, ""), (4, "x" * 200_000)])
    assert stage(spark, odd.limit(0), SMALL).collect() == []

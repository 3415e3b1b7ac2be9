"""The ten training-data operators against brute force, other libraries and edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import audio, bpe, decontam, html_text, licenses, quality, secrets, simhash, token_store, url_rules
from emberlog.llm.id_coder import decode_block, encode_block
from emberlog.llm.registry import byte_codec

TEXTS = [None, "", " \n\t ", "a", "word " * 3000, "Ünïcode ﬁ ß İ", "same text here now", "same text here now", "x" * 50_000, "don't  stop\r\n\n  NOW!! 12,5", "tab\tand nbsp  mark", "under the MIT license, all rights reserved", "<|endoftext|> plain", "a word<|startoftext|>.Then (so) \"it's\" e.g. U.S.A, it'll; 3.5 \ue000x =\u0338 e\u0301. <|endoftext|><|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, long words, ties, repeated rows, columns whose names clash."""
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), i, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, 0, "y"), (6, "same text here now", "en", "s", 1, 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@given(st.lists(st.integers(0, 49_407), max_size=3000), st.sampled_from([1, 4, 64]))
@settings(max_examples=25, deadline=None)
def test_coder_round_trip(ids, lanes):
    assert decode_block(encode_block(np.array(ids, dtype="<u4"), 49_408, lanes)).tolist() == ids


def test_coder_finds_damage():
    block = bytearray(encode_block(np.arange(5000, dtype="<u4") % 700, 49_408))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decode_block(bytes(block))


def test_token_store(odd):
    library = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for name, text in sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(tuple(r) for r in token_store.stored(odd, path).collect()) == Counter(want)
    assert token_store.stored(odd.limit(0), path).count() == 0


def test_byte_bpe(odd):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(odd, byte_codec()), byte_codec()).collect()
    assert all(r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in found) and len(found) == len(TEXTS) + 2
    with pytest.raises(KeyError):
        byte_codec().decode([10**6])


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_byte_bpe_any_text(text):
    codec = byte_codec()
    assert codec.decode(codec.encode(text)) == text.encode()
    slots = {codec.hash.slot(k) for k in list(codec.ranks)[:1000]}
    assert len(slots) == 1000


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(str(r.item_id), decontam.alnum_words(r.text.encode())) for r in bench.collect()]
    windows: dict = {}
    for name, w in items:
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    found = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    for r in docs.select("doc_id", "text").collect():
        w, hit, names = decontam.alnum_words(r.text.encode()), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    names |= own
                    hit.update(range(k, k + size))
        got = found[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items, got.items_sha256) == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    small = [r.n_hit for r in decontam.contamination(docs, bench, words_per_automaton=50).orderBy("doc_id").collect()]
    assert small == [found[k].n_hit for k in sorted(found)]
    clean = decontam.decontaminate(docs, bench)
    assert not decontam.contamination(clean, bench).where("contaminated").count()
    assert decontam.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def _components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(values))]


def test_simhash(odd, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    marks = [simhash.fingerprint(r.text.encode()) for r in rows]
    words = re.findall(r"[^\x20\x09-\x0D]+", rows[0].text.translate({i: i + 32 for i in range(65, 91)}))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)]
    assert marks[0] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    want = [rows[k].doc_id for k in _components(marks, lambda a, b: (a ^ b).bit_count() <= 2)]
    for limit in (4096, 2):  # the second sends every larger group to the second level
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, group_limit=limit).collect()}
        assert [got[r.doc_id] for r in rows] == want
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_bit_planes_count_distances():
    rng = np.random.default_rng(0)
    for shape in ((300,), (300, 4)):
        values = rng.integers(0, 1 << 63, shape, dtype=np.uint64)
        values[5:60] = values[4] ^ np.uint64(3)
        for radius in (0, 1, 2, 5, 27):
            i, j = simhash.links_within(values, radius, 64)
            apart = np.bitwise_count(values[:, None] ^ values[None, :]).reshape(300, 300, -1).sum(axis=2)
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(apart <= radius), strict=True) if a < b}


def test_near_copies(spark, odd):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 4000, 300)] for _ in range(12)]
    texts = [" ".join(w) for w in base]
    for k, w in enumerate(base):
        for n in (1, 2, 4):  # two and four changed words stay above 0.8, fifteen don't
            v = list(w)
            for at in rng.choice(len(v), n if n < 4 else 15, replace=False):
                v[at] = f"new{k}x{at}"
            texts.append(" ".join(v))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    want = _components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2048, 2):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(frame, group_limit=limit).collect()}
        assert [got[k] for k in range(len(texts))] == want
    found = simhash.near_copies(odd)
    assert found.count() == odd.count()
    kept = simhash.keep_first(odd, found)
    texts_kept = Counter(r.text for r in kept.collect())
    assert texts_kept["same text here now"] == 1 and texts_kept["null id"] == 1 and kept.columns == odd.columns
    assert simhash.near_copies(odd.limit(0)).count() == 0


def test_secrets(spark, odd):
    texts = ['api_key = "' + "AKIA" + "ABCDEFGHIJKLMNOP" + '"', "commit 3f786850e387550fdab836ed7e6dc881de23001b fixed it", "token: ghp_" + "aZ3kQ9xL2mN8vB5cT7wR1yU4iO6pS0dF2gH1", "a plain_snake_case_identifier_for_tests here", None, ""]
    frame = spark.createDataFrame([(k, t, "src") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert [r.n_secrets for r in secrets.report(frame).orderBy("doc_id").collect()] == [1, 0, 1, 0, 0, 0]
    clean = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert "[secret]" in clean[0] and clean[1] == texts[1] and clean[4] is None
    trees = secrets.trained_forest(spark)
    scored = secrets.scan(frame).where("size(findings) > 0").select(F.explode("findings").alias("f")).select("f.*")
    pieces = frame.select(F.explode(secrets.findings(F.col("text"))).alias("c")).select(secrets.features(*[F.col(f"c.{x}") for x in ("value", "before", "near", "after")], F.lit("src")).alias("f"), F.col("c.value").alias("value")).collect()
    votes = {p.value: secrets.vote(trees, [p.f[k] for k in secrets.FEATURES]) for p in pieces}
    assert all(abs(votes[r.value] - r.score) < 1e-9 for r in scored.collect())
    assert secrets.report(odd).count() == odd.count()


def test_audio(spark):
    rng = np.random.default_rng(1)
    notes = rng.normal(size=60)
    whole = audio.melody(notes)
    cut = whole[2 * 4000 * 2 :]
    frame = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(cut)), (2, bytearray(audio.melody(rng.normal(size=60)))), (50, bytearray(whole)), (3, None), (4, bytearray(b""))], "id long, pcm binary")
    found = {r.id: r for r in audio.matched(audio.fingerprints(frame, "id", "pcm")).collect()}
    assert found[50].class_id == 0 and found[0].n_links == 1 and found[0].match_id == 1 and found[1].match_offset < 0
    assert found[2].n_links == 0 and found[3].class_id == 3 == found[4].class_id


def test_url_rules(spark):
    urls = ["https://EXAMPLE.com/en/x", "http://www.example.com/en/y", "http://a.b.net/fr/1?q", "http://net/es/", "no scheme", None, "http://spam-farm.example.org/x", "http://spam-farm.example.edu/", "http://other.org/ads/banner?x"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in url_rules.report(frame).orderBy("page_id").collect()]
    assert got == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "block")]


def test_licenses(odd):
    found = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert (found[11].base_labels, found[11].labels, found[11].first_word) == ("mit", "all-rights-reserved,mit", 0)
    assert found[0].n_words == 0 and found[0].first_word is None
    t = licenses.Template("x", "a [[ b ]] c {{0-2}} d")
    assert [t.match(w.encode().split(), 0) for w in ("a c d", "a b c d", "a c x y d", "a c x y z d", "a b d")] == [3, 4, 5, -1, -1]


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.judged(docs, labels).join(labels, "doc_id").where("held_out")
    right = found.where("predicted = quality").count()
    assert right >= 0.9 * found.count()
    assert {r.score for r in quality.judged(odd, labels.limit(0)).collect()} == {0.5}


def test_html():
    page = "<html><body><nav><a href=x>Menu</a></nav><div class=sidebar>side</div><article><h1>A &amp; B</h1><p>One  two\n three <a href=y>link</a>.</p><p>More text follows here</article><div id='comments'><p>first!</p></div><footer>foot</footer><script>var x='<p>';</script></body></html>"
    assert html_text.main_text(page) == "A & B\nOne two three link.\nMore text follows here"
    assert html_text.main_text(None) == "" == html_text.main_text("")
    assert html_text.main_text("plain words") == "plain words"


def test_pipeline(spark):
    import corpus_pipeline

    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= before.keys() and all(r.n_tokens == len(r.ids) for r in rows)
    same = sum(byte_codec().decode(r.ids).decode() == before[r.doc_id] for r in rows)
    assert same >= 0.8 * len(rows)
    again = simhash.near_copies(out.select("doc_id", F.lit(None).cast("string").alias("text")).limit(0))
    assert again.count() == 0

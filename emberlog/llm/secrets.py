"""Secret scans: candidates and a random forest, all in DataFrame functions.

A text is cut into runs that may be a secret (20 or more of A-Z a-z 0-9 _ + / -, with trailing =),
values of any length that are assigned to a key-like word or stand as user:value@, and words. Each candidate, with the two words before it, the word after it and the path of its
document, gets numbers: length, character classes and transitions, entropy, dictionary coverage,
hints of neighbours and path. A random forest, trained from labelled findings, separates secrets
from false positives (commit hashes, identifiers, prose, placeholders). The forest is compiled to
nested CASE expressions, so the scan is one narrow projection: no shuffle, no Python on executors.

The labelled findings are a fixed table of generated examples (`labelled_findings`, a bounded
number of rows); their numbers come from the same expressions as in the scan, so training and
scanning cannot differ. The trees are grown on the driver from that table alone.

Edge cases: null and empty texts have no candidates; a null path is the empty path; repeated
candidates are all listed; texts without white space are one run after another. Extra columns pass.
"""

from __future__ import annotations

import base64
import json
import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.textfx import let

LEAST = 20
_RUN = rf"[A-Za-z0-9_+/\-]{{{LEAST},}}+={{0,2}}"
_PRESENT = rf"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{{{LEAST}}}"
#: A word that names a secret (at most 64 characters before its end), what assigns to it, and the value: up to its quote, or up to white space or a bracket.
_NAMING = "key|token|secret|passw|pwd|auth|credential|bearer"
_LETTER = r"[\p{L}\p{N}_]"
_NAMED = rf"(?i:{_NAMING}){_LETTER}{{0,64}}"
_KEYED = rf"(?<!{_LETTER})(?={_LETTER}++[\"'`]?\s{{0,8}}[:=])(?={_LETTER}*?{_NAMED}+(?!{_LETTER}))({_LETTER}++)[\"'`]?\s{{0,8}}(?:=>|:=|[:=])\s{{0,8}}(?:[\"'`]([^\s\"'`]++)(?:[\"'`])|([^\s\"'`<>,;&(){{}}\[\]]*[^\s\"'`<>,;&(){{}}\[\].:=]))"
#: user:password@ with or without a scheme before it.
_LOGIN = r"(?<![A-Za-z0-9.%+\-])((?:[A-Za-z][A-Za-z0-9+.\-]{1,20}://)?[A-Za-z0-9._%+\-]{0,64}:)([^\s\"'`/@:][^\s\"'`/@]*+)@"
_AHEAD = r"(?=[A-Za-z0-9\[])"
#: What every text with such a value holds: tests that cost little where there is none.
_KEYED_HINT = rf"[:=](?<={_NAMED}[\"'`]?\s{{0,8}}[:=])"
_LOGIN_HINT = rf":[^\s\"'`/@:][^\s\"'`/@]*+@{_AHEAD}"
_ALONE = rf"(?<![A-Za-z0-9_+/\-]){_RUN}"
_CANDIDATE = rf"{_LOGIN}{_AHEAD}|{_KEYED}|{_ALONE}"
_BESIDE = 200  # characters before and after a candidate in which its neighbours are looked for
_KEY_WORDS = "key|token|secret|passw|pwd|auth|credential|bearer|api|private|sk_|access|:$"
_HASH_WORDS = "sha|commit|hash|md5|checksum|digest|etag|uuid|guid|integrity|revision|trace|request_?id|build|fingerprint|blob|tree|object"
_PATHS = "test|example|sample|fixture|mock|docs?|lock|vendor|changelog|dist|min"
_PREFIXES = "^(akia|asia|aiza|ghp_|gho_|github_pat|sk_live|sk-|rk_live|xox[bpas]-|eyj|glpat|npm_|pypi-|ya29|sg_)"
_FILLER = "example|xxxx|your|changeme|placeholder|dummy|0000000|1234567|abcdef|aaaa|sample|redacted|todo"
_DICTIONARY = (
    "about after again all and any are author base before build cache call can change check class client code commit config connect "
    "content context control copy count create data default delete dev device document edit element engine enter error event every "
    "example export file filter find first for form format from function get handle have header height hello home host html http "
    "image import index info init input insert install int item java json key label last length level library license line link list "
    "load local log main make manager map master max member message method min mode model module name network new next node not null "
    "number object off open option order other output package page param parent parse password path point post print private process "
    "product project property public query random read record remove replace request reset resource response result return role root "
    "run save schema script search select send server service session set size source spark start state status string style support "
    "system table target task template test text that the their there this time title token tool tree type update upload url user "
    "util value version view was web what when which width will window with word work world write xml year you your "
    "tion ing ent ere ati ter ion her tha ate ver are con est ers pro ess man ive ight ough able ment ness"
)
_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "hex_only", "turns", "kinds", "entropy", "words", "pairs", "vowels",
    "key_before", "hash_before", "key_near", "hash_near", "hash_after", "path_hint", "prefix", "filler", "joints", "longest_run", "paddings",
)


def _hint(text: Column, words: str) -> Column:
    return text.rlike(f"(?i){words}").cast("double")


def _left(text: Column, pattern: str) -> Column:
    """How many characters of text the pattern covers."""
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))).cast("double")


def features(value: Column, before: Column, near: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES for one candidate; `near` is the word before `before`."""
    low, size = F.lower(value), F.length(value).cast("double")
    longest_first = sorted(_DICTIONARY.split(), key=lambda w: (-len(w), w))
    kinds = F.array_distinct(F.split(low, ""))
    share = lambda ch: (size - F.length(F.replace(low, ch, F.lit("")))) / size
    entropy = F.aggregate(kinds, F.lit(0.0), lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(-share(ch) * F.log2(F.greatest(share(ch), F.lit(1e-9)))))
    turns = F.length(F.regexp_replace(F.regexp_replace(value, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[A-Z])(?=[a-z])|(?<=[a-z])(?=[A-Z])", "\u0001"), "[^\u0001]", ""))
    runs = F.transform(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), F.length)
    made = {
        "length": size,
        "digits": _left(value, "[0-9]") / size,
        "uppers": _left(value, "[A-Z]") / size,
        "lowers": _left(value, "[a-z]") / size,
        "others": _left(value, "[^A-Za-z0-9]") / size,
        "hex_only": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "turns": turns.cast("double") / size,
        "kinds": F.size(kinds).cast("double"),
        "entropy": entropy,
        "words": _left(low, "|".join(longest_first)) / size,
        "pairs": _left(low, "|".join(_PAIRS.split())) / size,
        "vowels": _left(low, "[aeiou]") / size,
        "key_before": _hint(before, _KEY_WORDS),
        "hash_before": _hint(before, _HASH_WORDS),
        "key_near": _hint(near, _KEY_WORDS),
        "hash_near": _hint(near, _HASH_WORDS),
        "hash_after": _hint(after, _HASH_WORDS),
        "path_hint": _hint(path, _PATHS),
        "prefix": low.rlike(_PREFIXES).cast("double"),
        "filler": low.rlike(_FILLER).cast("double"),
        "joints": _left(value, "[_/-]"),
        "longest_run": F.coalesce(F.array_max(runs), F.lit(0)).cast("double"),
        "paddings": value.endswith("=").cast("double"),
    }
    return F.struct(*[made[name].alias(name) for name in FEATURES])


def labelled_findings(n: int = 3000, seed: int = 5) -> list[dict]:
    """Generated findings: value, before, near, after, path, label (1: a secret)."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = ["the", "and", "of", "is", "la", "der", "que", "with", "set", "value", "see", "from", "", "el", "une", "und"]
    keys = ["token", "api_key", "secret", "password", "apikey", "access_token", "client_secret", "auth", "TOKEN", "Secret", "SECRET_KEY", "bearer", "private_key", "aws_secret_access_key", "passwd"]
    hashes = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "revision", "hash", "trace_id", "request_id", "Commit", "blob", "build"]
    plain = [w for w in _DICTIONARY.split() if len(w) > 2]
    syllables = [c + v for c in "bcdfghlmnprst" for v in "aeiou"] + [v + c for v in "aeiou" for c in "lnrst"] + ["tion", "ing", "ness", "ed"]
    paths = ["src/main.go", "app/config.py", "deploy/settings.yaml", "notes.md", "lib/io.c", ""]
    aside = ["tests/test_auth.py", "docs/example.md", "package-lock.json", "fixtures/sample.json", "vendor/dist.min.js"]

    def upper_some(x: str) -> str:
        return x.upper() if r.random() < 0.2 else x

    def good() -> tuple:
        made = [
            lambda: upper_some(some(hexes, r.choice([32, 40, 40, 40, 48, 64]))),
            lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
            lambda: "ghp_" + some(alnum, 36),
            lambda: "sk_live_" + some(alnum, 24),
            lambda: "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24),
            lambda: base64.b64encode(r.randbytes(r.choice([24, 30, 32, 48]))).decode(),
            lambda: some(alnum, r.randint(20, 48)),
            lambda: "eyJ" + some(alnum + "_-", r.randint(40, 90)),
        ][min(7, int(r.random() * 8))]()
        strong = r.random() < 0.85
        telling = any(made.startswith(p) for p in ("AKIA", "ghp_", "sk_live_", "xoxb", "eyJ"))
        before = r.choice(keys) if strong or not telling else r.choice(prose)
        if r.random() < 0.1:
            return made, r.choice(["is", "value", "equals"]), r.choice(keys), r.choice(prose), r.choice(paths)
        return made, before, r.choice(prose), r.choice(prose), r.choice(paths + aside[:1])

    def bad() -> tuple:
        kind = int(r.random() * 11)
        at = r.choice(paths + aside)
        near, after = r.choice(prose), r.choice(prose)
        if kind == 0:
            return some(hexes, r.choice([32, 40, 64])), r.choice(hashes), near, after, at
        if kind == 1:
            return "_".join(r.choice(plain) for _ in range(r.randint(3, 7))).ljust(LEAST, "s"), r.choice(prose + keys), near, after, at
        if kind == 2:
            words = [r.choice(plain).title() for _ in range(r.randint(3, 7))]
            return "".join(words).ljust(LEAST, "s"), r.choice(prose + keys[:3]), near, after, at
        if kind == 3:
            return upper_some("".join(r.choice(syllables) for _ in range(r.randint(8, 14)))).ljust(LEAST, "e"), r.choice(prose + ["token", "key"]), near, after, at
        if kind == 4:
            return "/".join(r.choice(plain) for _ in range(r.randint(4, 8))).ljust(LEAST, "s"), r.choice(prose), near, after, at
        if kind == 5:
            filler = r.choice(["your_api_key_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "EXAMPLE_SECRET_KEY_0000", "changeme_changeme_changeme", "abcdefghijklmnopqrstuvwxyz", "1234567890123456789012", "placeholder_token_value_1"])
            return filler + some(hexes, r.choice([0, 0, 4])), r.choice(keys), near, after, at
        if kind == 6:
            return some(string.digits, r.randint(20, 30)), r.choice(prose + ["number", "id"]), near, after, at
        if kind == 7:
            h = some(hexes, 32)
            return "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]]), r.choice(hashes + prose), near, after, at
        if kind == 8:
            return r.choice("-_=a#*")[0].replace("=", "-").replace("#", "-").replace("*", "_") * r.randint(20, 60), r.choice(prose), near, after, at
        if kind == 9:
            return some(hexes, r.choice([32, 40, 64])), r.choice(prose), r.choice(hashes), r.choice(prose + hashes), at
        return some(alnum, r.randint(20, 48)), r.choice(hashes), near, r.choice(prose + hashes), r.choice(aside + [at])

    out = []
    for k in range(n):
        value, before, near, after, path = good() if k % 2 else bad()
        out.append({"value": value, "before": before, "near": near, "after": after, "path": path, "label": k % 2})
    return out + _labelled_values(r, n // 2, keys, prose, plain, syllables, paths)


def _labelled_values(r: random.Random, n: int, keys: list, prose: list, plain: list, syllables: list, paths: list) -> list[dict]:
    """Generated values of any length that a key-like word or user: stands before."""
    alnum, marks = string.ascii_letters + string.digits, "!#$%&*+-.?^_~"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    logins = ["postgres://admin:", "mysql://root:", "amqp://user:", "https://bot:", "admin:", "deploy:"]

    def good() -> str:
        kind = int(r.random() * 5)
        if kind == 0:
            made = list(some(alnum, r.randint(5, 14)) + some(string.digits, 2) + some(marks, r.randint(1, 3)))
            r.shuffle(made)
            return "".join(made)
        if kind == 1:
            word = r.choice(plain)
            for a, b in (("a", "4"), ("e", "3"), ("o", "0"), ("i", "1")):
                word = word.replace(a, b) if r.random() < 0.6 else word
            return word.title() + r.choice(["", "!", "_", "#", "-"]) + some(string.digits, r.randint(2, 4)) + some(marks, r.randint(0, 2)) + some(alnum, r.randint(0, 4))
        if kind == 2:
            return some("0123456789abcdef", r.randint(12, 19))
        if kind == 3:
            return some(alnum, r.randint(8, 19))
        return r.choice(plain) + some(string.digits, r.randint(1, 4)) + r.choice(["", "!", "pw", "x"])

    def bad() -> str:
        kind = int(r.random() * 8)
        if kind == 0:
            return r.choice(["true", "false", "null", "None", "required", "string", "undefined", "nil", "optional", "yes", "no", "*****", "********", "...", "-", "?", "N/A", "%s", "$1", "{}", "1", "0"])
        if kind == 1:
            return some(string.digits, r.randint(1, 10))
        if kind == 2:
            return "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        if kind == 3:
            return r.choice([str.title, str.upper, str.lower])(r.choice(plain))
        if kind == 4:
            return r.choice(["_", ".", "-", "/"]).join(r.choice(plain) for _ in range(r.randint(2, 3)))
        if kind == 5:
            return r.choice(["changeme", "your_password", "xxxxxxxx", "example", "placeholder", "$PASSWORD", "${TOKEN}", "%TOKEN%", "dummy", "sample_key", "redacted", "todo", "[secret]"])
        if kind == 6:
            return "".join(r.choice(syllables) for _ in range(r.randint(2, 4))).title()
        return "".join(r.choice(plain).title() for _ in range(r.randint(2, 3)))

    out = []
    for k in range(n):
        before = r.choice(keys + ["user_password", "db_pwd"]) if r.random() < 0.8 else r.choice(logins)
        out.append({"value": (good if k % 2 else bad)(), "before": before, "near": r.choice(prose), "after": r.choice(prose), "path": r.choice(paths), "label": k % 2})
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 7, least: int = 4, seed: int = 3) -> list:
    """A random forest: each tree, from a bootstrap and random features at each split, is nested (feature, cut, low, high) or a share."""
    rng = np.random.default_rng(seed)
    width = max(1, int(np.sqrt(x.shape[1])) + 1)

    def node(rows: np.ndarray, level: int):
        share = float(y[rows].mean())
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return round(share, 6)
        best = None
        for f in rng.choice(x.shape[1], width, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, labels = x[order, f], y[order]
            n = np.arange(1, len(rows))
            ones = np.cumsum(labels)[:-1]
            total = labels.sum()
            low, high = ones / n, (total - ones) / (len(rows) - n)
            impurity = n * low * (1 - low) + (len(rows) - n) * high * (1 - high)
            impurity[(values[1:] <= values[:-1]) | (n < least) | (len(rows) - n < least)] = np.inf
            k = int(np.argmin(impurity))
            if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
                best = (impurity[k], int(f), float((values[k] + values[k + 1]) / 2))
        if best is None:
            return round(share, 6)
        _, f, cut = best
        goes = x[rows, f] <= cut
        return (f, cut, node(rows[goes], level + 1), node(rows[~goes], level + 1))

    return [node(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]


def vote(trees: list, row) -> float:
    """The forest's mean share for one vector; the expression of `forest_score` gives the same."""
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return total / len(trees)


def forest_score(trees: list, vector: Column) -> Column:
    def case(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, cut, low, high = t
        return F.when(vector[FEATURES[f]] <= F.lit(cut), case(low)).otherwise(case(high))

    total = case(trees[0])
    for t in trees[1:]:
        total = total + case(t)
    return total / F.lit(float(len(trees)))


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, n: int, seed: int) -> tuple:
    schema = "array<struct<value:string,before:string,near:string,after:string,path:string,label:int>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(labelled_findings(n, seed))), schema)))
    vectors = table.select(features(*[F.col(c) for c in ("value", "before", "near", "after", "path")]).alias("f"), "label").collect()
    x = np.array([[r.f[k] for k in FEATURES] for r in vectors])
    return tuple(grow(x, np.array([r.label for r in vectors])))


def trained_forest(spark: SparkSession, n: int = 3000, seed: int = 5) -> list:
    return list(_trained(spark, n, seed))


def findings(text: Column) -> Column:
    """The array of candidates of a text, each with its neighbours; null where there is none.

    Neighbours are words within _BESIDE characters; a candidate that stands there counts as words too. The words
    before a named value are the name and the word before it.
    """
    told = text.rlike(_LOGIN_HINT) | text.rlike(_KEYED_HINT)
    cut = let(F.when(told, F.lit(_CANDIDATE)).otherwise(F.lit(_ALONE)), lambda p: F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, p, -1).alias("gaps")))
    at = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))

    def one(whole: Column, ahead: Column, behind: Column) -> Column:
        words = F.regexp_extract_all(F.right(ahead, F.lit(_BESIDE)), F.lit(rf"{_LETTER}+"), F.lit(0))
        last, other = at(words, F.size(words) - 1), at(words, F.size(words) - 2)
        after = F.regexp_extract(F.left(behind, F.lit(_BESIDE)), rf"{_LETTER}+", 0)
        made = lambda value, before, near: F.struct(value.alias("value"), before.alias("before"), near.alias("near"), after.alias("after"))

        def named(pattern: str, groups: tuple[int, ...]) -> Column:
            """The value, and the runs inside it where it is no run itself."""
            value, name = F.concat(*[F.regexp_extract(whole, pattern, k) for k in groups]), F.regexp_extract(whole, pattern, 1)
            inside = F.when(value.rlike(rf"^{_RUN}$"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(value, F.lit(_RUN), F.lit(0)))
            return F.transform(F.concat(F.array(value), inside), lambda v: made(v, name, last))

        return F.when(whole.rlike(rf"^{_RUN}$"), F.array(made(whole, last, other))).when(whole.rlike(rf"^{_LOGIN}$"), named(_LOGIN, (2,))).otherwise(named(_KEYED, (2, 3)))

    def every(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        return F.flatten(F.transform(found, lambda c, i: one(c, F.concat(at(found, i - 1), F.lit(" "), at(gaps, i)), F.concat(at(gaps, i + 1), F.lit(" "), at(found, i + 1)))))

    looked = let(cut, every)
    return F.when(text.rlike(_PRESENT) | told, looked)


def scan(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", cut: float = 0.5) -> DataFrame:
    """docs with `findings` added: an array of (value, before, near, after, score, is_secret), empty where none."""
    trees = trained_forest(docs.sparkSession)
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pieces = docs.withColumn("__found", findings(text))
    numbered = pieces.withColumn("__found", F.transform("__found", lambda c: F.struct(c.alias("c"), features(c["value"], c["before"], c["near"], c["after"], path).alias("f"))))
    scored = F.transform("__found", lambda c: F.struct(c["c"].alias("c"), forest_score(trees, c["f"]).alias("score")))
    judged = F.transform(scored, lambda c: F.struct(c["c"]["value"].alias("value"), c["c"]["before"].alias("before"), c["c"]["near"].alias("near"), c["c"]["after"].alias("after"), c["score"].alias("score"), (c["score"] >= cut).alias("is_secret")))
    empty = F.array().cast("array<struct<value:string,before:string,near:string,after:string,score:double,is_secret:boolean>>")
    return numbered.withColumn("findings", F.coalesce(judged, empty)).drop("__found")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, top_score and the secrets, each as its SHA-256, in text order."""
    found = scan(docs.select("doc_id", "text", "source"))
    secret = F.filter("findings", lambda c: c["is_secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda c: c["score"])), F.lit(0.0)).alias("top_score"),
        F.array_join(F.transform(secret, lambda c: F.sha2(c["value"], 256)), ",").alias("secrets_sha256"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs with each value judged a secret replaced by mark, wherever it stands; other texts stay as they are."""
    found = scan(docs, text_col, path_col)
    values = F.array_distinct(F.transform(F.filter("findings", lambda c: c["is_secret"]), lambda c: c["value"]))
    # Longer values first: one may be part of another.
    ordered = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    # Shorter ones may be part of other words: they are replaced where they stand by themselves.
    alone = lambda value: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    clean = F.aggregate(ordered, F.col(f"`{text_col}`"), lambda text, value: F.when(F.length(value) >= LEAST, F.replace(text, value, F.lit(mark))).otherwise(F.regexp_replace(text, alone(value), F.lit(mark))))
    return found.withColumn(text_col, F.when(F.size(values) > 0, clean).otherwise(F.col(f"`{text_col}`"))).drop("findings")

"""Text functions over columns, with the Unicode rules of the reference semantics.

Patterns spell out white space and word characters, because Java's classes differ from them.
Patterns are literals, so that Spark compiles each once; guards in front of costly ones are plain
tests that most texts fail quickly.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from re import _parser as parsing

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.dims import TRIMMED, least

#: White space, for use inside a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"[\p{L}\p{N}_]"
#: A word boundary.
B = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_CLASSES = {"d": r"\p{Nd}", "s": WS}
#: The same white space as a text.
WS_CHARS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _starts(part, codes: set[str]) -> bool:
    """Adds the characters with which a match of a parsed pattern can start; False where it can be empty or they are not told."""
    for op, arg in part:
        name = str(op)
        if name == "LITERAL":
            codes.add(chr(arg))
            return True
        if name == "IN":
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    codes.add(chr(x))
                elif str(kind) == "RANGE":
                    codes.update(map(chr, range(x[0], x[1] + 1)))
                elif str(x) == "CATEGORY_DIGIT":
                    codes.add(r"\d")
                else:
                    return False
            return True
        if name == "SUBPATTERN":
            return _starts(arg[-1], codes)
        if name == "BRANCH":
            return all([_starts(x, codes) for x in arg[1]])
        if name != "MAX_REPEAT" or not _starts(arg[2], codes):
            return False
        if arg[0]:
            return True
    return False


def _boundary(rest: str, ignore_case: bool) -> str:
    """The boundary in front of the whole rest of a pattern: a test of the next character that most places fail comes first.

    Where a match can only start with a word character, the boundary is that none stands before.
    """
    codes: set[str] = set()
    try:
        told = _starts(parsing.parse(rest), codes)
    except re.error:
        return B
    plain = {c for c in codes if len(c) == 1}
    if not told or not all(c.isascii() for c in plain):
        return B
    if ignore_case:  # with the two other characters that fold to ASCII letters
        plain |= {x for c in plain for x in (c.lower(), c.upper())} | ({"\u017f"} if plain & set("sS") else set()) | ({"\u212a"} if plain & set("kK") else set())
    listed = "".join(sorted(c if c.isalnum() else f"\\{c}" for c in plain)) + (_CLASSES["d"] if r"\d" in codes else "")
    before = f"(?<!{_WORD})" if all(c.isalnum() or c == "_" for c in plain) else B
    return f"(?-iu:(?=[{listed}])){before}"


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside groups and classes."""
    cuts, depth, inside, i = [-1], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside or c == "[":
            inside = c != "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            cuts.append(i)
        i += 1
    return [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(pattern)], strict=True)]


def java(pattern: str, ignore_case: bool = False) -> str:
    r"""A Python pattern for Java: \b, \d, \s and $ get Python's meaning.

    A repeated class before a literal that it lacks takes all it can at once (possessive), which
    changes no match and keeps long runs linear.
    """
    ways = _alternatives(pattern)
    if len(ways) > 1:
        made = "|".join(java(w) if not ignore_case else java(w, True).removeprefix("(?iu)") for w in ways)
        return f"(?iu){made}" if ignore_case else made
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e == "b":
                out.append(_boundary(pattern[2:], ignore_case) if i == 0 else B)
            elif e in _CLASSES:
                out.append(_CLASSES[e] if inside or e == "d" else f"[{_CLASSES[e]}]")
            else:
                out.append(c + e)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"(?=\n?\z)" if c == "$" and not inside else c)
        i += 1
    made = re.sub(r"(\[[^\]^][^\]]*\]\+)(\\\.|/)", lambda m: m[0] if m[2][-1] in m[1] else f"{m[1]}+{m[2]}", "".join(out))
    return f"(?iu){made}" if ignore_case else made


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row even where lambdas inside body use it.

    The optimizer puts a column's expression where the column stands; inside a lambda it would then
    run for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def held(value: Column) -> Column:
    """value, computed as a whole: its fields are not computed anew wherever one is read."""
    return let(value, lambda x: x)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars)) if chars else c


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct_values(values: Column) -> Column:
    """Cleaned values (white space, then brackets and punctuation off both ends), non-empty, first ones kept, in order."""
    cleaned = F.transform(values, lambda x: F.btrim(strip(x), F.lit(TRIMMED)))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def contains_any(lowered: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is a substring; an OR chain stops at the first hit."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in least(tuple(words))])


def groups_present(lowered: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups with a word in the text, in the groups' order."""
    return F.array_compact(F.array(*[F.when(contains_any(lowered, words), F.lit(name)) for name, words in groups.items()]))


def best_group(lowered: Column, groups: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The group of most words in the text, the earliest of equals."""
    scores = [F.struct(reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words]).alias("score"), F.lit(-k).alias("turn"), F.lit(name).alias("name")) for k, (name, words) in enumerate(groups.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(otherwise))


def sentences(text: Column) -> Column:
    """The text's sentences and lines."""
    return F.split(text, rf"(?=[{WS}])(?:(?<=[.!?])[{WS}]+|\n+)", -1)


def first_sentence_with(lowered: Column, parts: Column, lowered_parts: Column, words: tuple[str, ...]) -> Column:
    """The first of a text's sentences with one of the words, stripped; empty if none. Most texts have none and end at a plain test."""
    hit = F.filter(parts, lambda _, i: contains_any(F.get(lowered_parts, i), words))
    return F.when(contains_any(lowered, words), F.coalesce(strip(F.get(hit, 0)), F.lit(""))).otherwise("")


def guarded(present: Column, values: Column) -> Column:
    """values (an array of texts) where they can be present, else none."""
    return F.when(present, values).otherwise(F.array().cast("array<string>"))


def split_clean(text: Column, pattern: str) -> Column:
    """Stripped, non-empty parts between matches of pattern."""
    parts = F.transform(F.split(text, pattern, -1), strip)
    return F.filter(parts, lambda x: x != "")


def non_empty(value: Column, otherwise: Column | str) -> Column:
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return F.when(value != "", value).otherwise(other)


def filled(template: str, **values: Column) -> Column:
    """A template with {names} filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])


_CONTROLS = {chr(k): f"\\u{k:04x}" for k in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(c: Column) -> Column:
    """A text as a JSON string, non-ASCII characters as they are; null as null."""
    hard = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [("\\", "\\\\"), ('"', '\\"'), *_CONTROLS.items()], c)
    return F.coalesce(F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), hard).otherwise(c), F.lit('"')), F.lit("null"))


def json_block(parts: Column, depth: int, ends: str = "[]") -> Column:
    """JSON values as an array (or members as an object) with one on each line, indented by two blanks a level."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    return F.when(F.size(parts) == 0, F.lit(ends)).otherwise(F.concat(F.lit(ends[0] + inner), F.array_join(parts, "," + inner), F.lit(outer + ends[1])))


_TEXT = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}))*+"'
_MEMBER = rf"{_TEXT}[ \t\n\r]*+:[ \t\n\r]*+(?:{_TEXT}|null)"
#: A JSON object of one or more members whose values are texts or null.
FLAT_OBJECT = rf"\A[ \t\n\r]*+\{{[ \t\n\r]*+{_MEMBER}(?:[ \t\n\r]*+,[ \t\n\r]*+{_MEMBER})*+[ \t\n\r]*+\}}[ \t\n\r]*+\z"

"""The word encoder against the library as loaded: every letter beside marks, odd mixtures, another vocabulary's way."""

import random
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from emberlog.llm.token_store import WordEncoder

DEFINITION = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
PIECES = [*map(chr, range(1, 0x260)), *"İıßſŉǅKÅ’̧̱̇́日चσςΣẞΩ😀 　", "'s", "'LL", "H̱", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", " ", "."]


def held(encoder, texts):
    library = Tokenizer.from_str(DEFINITION)
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        begin = end


def test_every_letter_beside_marks():
    encoder = WordEncoder(DEFINITION)
    assert encoder.latin
    letters = [chr(k) for k in range(0x20, 0x3000)]
    held(encoder, [c + "," for c in letters] + [f"x{c}.y" for c in letters])


def test_odd_mixtures_and_batches():
    encoder, draw = WordEncoder(DEFINITION), random.Random(5)
    held(encoder, ["".join(draw.choices(PIECES, k=draw.randint(0, 30))) for _ in range(5000)])
    held(encoder, ["", "Ünïted " * 5000, "a" * 30_000, "", "\n", "the"])
    ids, ends = encoder.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and len(ends) == 0


def test_merges_are_left_where_they_differ():
    """A vocabulary that keeps capitals apart: the shorter way is not taken."""
    other = Tokenizer.from_str(DEFINITION)
    other.normalizer = None
    assert not WordEncoder(other.to_str()).latin
    other = Tokenizer.from_str(DEFINITION)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("b", "isolated"), other.pre_tokenizer])
    assert not WordEncoder(other.to_str()).latin

"""Token-ID output: documents to ids to a binary file of coded blocks, and back.

Documents are dealt by ranges of doc_id and sorted, so that files and blocks follow ascending
doc_id; each task encodes its documents and writes blocks of whole documents, about
`block_ids` ids each (a longer document has a block to itself). A row of the file is one block:
part, block, offset (ids of the part before it), doc_ids, counts and the coded ids. Every block
decodes by itself, so reading is a narrow pass. Only one total for each written part reaches the
driver (as many numbers as there were tasks), to place the parts one after another.

Texts are cut at blanks, line feeds and between a Latin letter and a full stop, comma or the like
before the tokenizers library sees them, where this vocabulary (white space is dropped, letters and
marks never share a token) always cuts; each word of a batch is encoded once. Words of Latin letters
only need none of the library's normal forms and patterns: they are lower-cased, written in the
vocabulary's letters for bytes and given to its merges. Every worker first holds that way against
the library on a few thousand words, and leaves it if they differ.
The strings of the vocabulary's special tokens have none of these places, so they stay whole and
get the ids that the library gives them.

Edge cases: null and empty texts hold only the end id; null doc_ids come first; equal doc_ids
stay together, ordered by text; an empty table makes an empty file. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import map_rows
from emberlog.llm.id_coder import decode_block, encode_block
from emberlog.runtime import scratch_path

_SCHEMA = "part int, block int, offset long, doc_ids array<bigint>, counts array<int>, coded binary"
_WORKERS: dict[str, WordEncoder] = {}


#: Stands between words that are encoded in one call. The library cuts there before it does anything else.
_BETWEEN = "\ue000"
#: Latin letters whose small form is one letter in every normal form (so without the dotted capital I).
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_MARKS = r'.,;:!?()"*&%$#@/'
_LETTER_MARK, _MARK_LETTER = f"([{_LATIN}])([{_MARKS}])", f"([{_MARKS}])([{_LATIN}])"
_WORD = f"^[{_LATIN}]+$"
_AT_ONCE = 200  # words in one text


def _byte_letters() -> np.ndarray:
    """The letter (UTF-16) that stands for each byte: itself if it can be seen, else the next one from 256 on. The blank stays, it only separates."""
    seen = np.zeros(256, dtype=bool)
    for first, last in (("!", "~"), ("\u00a1", "\u00ac"), ("\u00ae", "\u00ff")):
        seen[ord(first) : ord(last) + 1] = True
    letters = np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype("<u2")
    letters[ord(" ")] = ord(" ")
    return letters


class WordEncoder:
    """Ids of a tokenizers vocabulary that drops white space, one word at a time. It holds nothing from batch to batch."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.tokenizer, self.many, self.merges = (Tokenizer.from_str(definition) for _ in range(3))
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.many.add_tokens([AddedToken(_BETWEEN, special=False, normalized=False)])
        self.between = self.many.token_to_id(_BETWEEN)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        for t in (self.tokenizer, self.many, self.merges):
            if hasattr(t.model, "_resize_cache"):  # words come once
                t.model._resize_cache(0)
        self.letters = _byte_letters()
        #: Whether an id ends a word: told by its string.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.alphabet, dtype=bool)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if suffix:
            for text, k in vocabulary.items():
                self.ends[k] = text.endswith(suffix)
        self.latin = bool(suffix) and self._merges_suffice(vocabulary, suffix)

    def _merges_suffice(self, vocabulary: dict[str, int], suffix: str) -> bool:
        """Whether the merges alone give the library's ids: every Latin letter, and words of the vocabulary in small and capital letters."""
        every = pa.array([chr(k) for k in range(0x250)])
        letters = every.filter(pc.match_substring_regex(every, _WORD)).to_pylist()
        known = sorted(w[: -len(suffix)] for w in vocabulary if w.endswith(suffix) and w[: -len(suffix)].isascii() and w[: -len(suffix)].isalpha())[::16]
        tried = pa.array(letters + [a + b for a, b in zip(letters, letters[7:], strict=False)] + known + [w.capitalize() + w.upper() for w in known])
        (ours, our_sizes), (theirs, their_sizes) = self._latin_words(tried), self._any(tried)
        return np.array_equal(our_sizes, their_sizes) and np.array_equal(ours, theirs)

    @staticmethod
    def _joined(words: pa.Array, between: str) -> list[str]:
        """Texts of some words each."""
        begins = np.append(np.arange(0, len(words), _AT_ONCE), len(words)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(begins), words), between).to_pylist()

    def _latin_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of Latin letters only, and how many each word has: a word ends with the one id in it that ends a word."""
        texts = [t.lower() for t in self._joined(words, " ")]
        spelt = [t if t.isascii() else self.letters[np.frombuffer(t.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le") for t in texts]
        made = self.merges.encode_batch_fast(spelt, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(m.ids, dtype="<u4") for m in made)])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _any(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words, with a mark between them; if one holds the mark itself, one by one."""
        if pc.any(pc.match_substring(words, _BETWEEN)).as_py():
            each = [np.array(m.ids, dtype="<u4") for m in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        made = self.many.encode_batch_fast([t + _BETWEEN for t in self._joined(words, _BETWEEN)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(m.ids, dtype="<u4") for m in made)])
        cuts = np.flatnonzero(ids == self.between)
        return ids[ids != self.between], np.diff(cuts, prepend=-1) - 1

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids start, how many they are)."""
        latin = pc.match_substring_regex(words, _WORD).to_numpy(zero_copy_only=False) & self.latin
        starts, sizes, ids = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int32), []
        first = 0
        for chosen, encode in ((latin, self._latin_words), (~latin, self._any)):
            got, n = encode(words.filter(pa.array(chosen)))
            starts[chosen], sizes[chosen] = first + np.cumsum(n) - n, n
            ids.append(got)
            first += len(got)
        return np.concatenate(ids), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids end)."""
        spaced = pc.replace_substring(texts, "\n", " ")
        for pattern in (_LETTER_MARK, _MARK_LETTER):
            spaced = pc.replace_substring_regex(spaced, pattern, r"\1 \2")
        cut = pc.split_pattern(spaced, " ")
        coded = cut.flatten().dictionary_encode()
        ids, starts, sizes = self._words(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        ends = np.cumsum(counts, dtype=np.int32)  # a batch of Arrow strings is below 2 GiB, and an id takes a byte at least
        at = np.repeat(starts[which] - (ends - counts), counts)
        at += np.arange(len(at), dtype=np.int32)
        words = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return ids[at], np.concatenate([[0], ends])[words]


def write_ids(docs: DataFrame, path: str, definition: str, end_id: int | None = 2, block_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs by a tokenizers definition (JSON text) and write the blocks to path."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    ending = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def rows(batches):
        key = f"{zlib.crc32(shipped.value.encode())}"
        if key not in _WORKERS:
            _WORKERS[key] = WordEncoder(shipped.value)
        encoder = _WORKERS[key]
        part, block, offset = TaskContext.get().partitionId(), 0, 0
        ids, counts, held, size = [], [], [], 0

        def close():
            values = np.frombuffer(b"".join(held), dtype="<u4")
            row = [[part], [block], [offset], [ids], [counts], [encode_block(values, encoder.alphabet)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "offset", "doc_ids", "counts", "coded"])

        for batch in batches:
            every, ends = encoder.encode(batch.column(1))
            begin = 0
            for name, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                packed = every[begin:end].tobytes() + ending
                begin, n = end, len(packed) // 4
                if held and size + n > block_ids:
                    yield close()
                    block, offset = block + 1, offset + size
                    ids, counts, held, size = [], [], [], 0
                ids.append(name)
                counts.append(n)
                held.append(packed)
                size += n
        if held:
            yield close()

    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_rows(dealt, rows, _SCHEMA, limit=8 << 20).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the file: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = blocks.groupBy("part").agg(F.sum(size).alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    shipped = spark.sparkContext.broadcast(starts)

    def rows(batches):
        for batch in batches:
            for part, offset, doc_ids, counts, coded in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = decode_block(coded)
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                if int(ends[-1]) != len(ids):
                    raise ValueError("a block holds another number of ids than its documents")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(begins + offset + shipped.value[part]), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1]).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_rows(blocks.select("part", "offset", "doc_ids", "counts", "coded"), rows, schema)


def stored(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write docs to a new file in the shared folder and read it back, one row for each document."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, Path(tokenizer_file).read_text(encoding="utf-8"))
    return read_ids(docs.sparkSession, path)

"""Token counts: words that are one token are counted, the rest is merged."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm.bpe import NEVER, Memory, merged
from quillmill.llm.tables import batches_mapped

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMORY = 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, all other bytes in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Rules:
    """What a byte-level vocabulary file with word ends says, ready for counting.

    The constructor takes the file's text, and proves two things by asking the library
    itself: which vocabulary strings, as a word of their own, encode as just that token
    (``whole``), and for which characters of the first plane lower case and letter class are
    the same here as there. Texts with any other character, with combining marks to be
    composed or with one of the special strings go to the library as a whole.
    """

    def __init__(self, text: str):
        self.text = text
        tokenizer = Tokenizer.from_str(text)
        spec = json.loads(text)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.end = spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.whole = set()
        for token in spec["model"]["vocab"]:
            if token.endswith(self.end) and len(token) > len(self.end):
                letters = token.removesuffix(self.end)
                try:
                    word = bytes(byte_of[c] for c in letters).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if self.split.findall(word) == [word] and len(tokenizer.model.tokenize(letters)) == 1:
                    self.whole.add(word)
        self.odd = self.odd_characters(tokenizer)

    def odd_characters(self, tokenizer: Tokenizer) -> str:
        """A character class of what is not proved to read the same here as in the library."""
        kinds = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
        odd = []
        for code in range(0x10000):
            c = chr(code)
            if 0xD800 <= code < 0xE000:
                continue
            if c.isascii() and c.isalnum():
                continue
            normal = tokenizer.normalizer.normalize_str(c)
            here = " " if c.isspace() else c.lower()
            kind = [bool(k.match(here[:1])) for k in kinds]
            there = [len(tokenizer.pre_tokenizer.pre_tokenize_str(x)) for x in (f"é{normal}é", f"1{normal}", f"?{normal}?")]
            # a letter joins letters; a blank parts and is dropped; a number stands alone; a sign joins signs
            expected = {(True, False, False): [1, 2, 3], (False, True, False): [3, 2, 3]}.get(
                tuple(kind), [2, 1, 2] if kind[2] else [3, 2, 1]
            )
            if normal != here or len(here) != 1 or there != expected or c.isspace() != kind[2]:
                odd.append(code)
        spans: list[list[int]] = []
        for code in odd:
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
        return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "\U00010000-\U0010ffff]"

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("library", "odd_pattern", "known")}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.text)

    @cached_property
    def odd_pattern(self) -> re.Pattern:
        return re.compile(self.odd)

    @cached_property
    def known(self) -> Memory:
        """Tokens of chunks met before; a worker keeps it from task to task."""
        return Memory(self.chunk_tokens, MEMORY)

    def is_plain(self, text: str) -> bool:
        """True when the text's words are sure to be the library's words."""
        if any(s in text for s in self.specials):
            return False
        if text.isascii() and not self.odd_pattern.search(text):
            return True
        return not self.odd_pattern.search(text) and unicodedata.is_normalized("NFC", text)

    def chunk_tokens(self, chunk: str) -> int:
        """Tokens of a lower-case chunk without blanks."""
        return sum(1 if w in self.whole else self.merged_tokens(w) for w in self.split.findall(chunk))

    def merged_tokens(self, word: str) -> int:
        """Tokens of a word by the merges of the vocabulary."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        return len(merged(parts, lambda a, b: self.ranks.get((a, b), NEVER)))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not self.is_plain(text):
            return len(self.library.encode(text, add_special_tokens=False))
        return sum(map(self.known.__getitem__, text.lower().split()))


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text in ``docs`` (doc_id, text, ...).

    No shuffle: a text is counted where it is read. The rules, whose size is that of the
    vocabulary file, are made once and broadcast. A null text counts as an empty one, which
    has no token; ids may be null or repeat; further columns are not read. ``limit`` is the
    number of tokens beyond which ``over_limit`` is true.
    """
    text = vocabulary_text(path or public_tokenizers.path(VOCABULARY))
    rules = docs.sparkSession.sparkContext.broadcast(Rules(text))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [rules.value.count(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    sized = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = batches_mapped(sized, counts, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

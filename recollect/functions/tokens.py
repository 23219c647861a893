"""Tokens of a real vocabulary as columns: byte pairs, and word pieces.

A vocabulary's content travels with the tasks (well under two megabytes for 100,000 tokens), so executors need no
file; each Python worker builds its coder once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of texts that leave a task at once.
WINDOWS = 1_024
_CODERS: dict[str, object] = {}


def _once(key: str, make):
    if key not in _CODERS:
        _CODERS[key] = make()
    return _CODERS[key]


class BytePairs:
    """A byte-pair vocabulary: the content of a rank file and the pattern that cuts texts."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.key = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def coder(self):
        import tiktoken

        def make():
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}
            return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

        return _once(self.key, make)

    def ids(self, text: Column) -> Column:
        """array<int>; null has none."""

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            coder = self.coder()
            return pd.Series([coder.encode_ordinary(t or "") for t in texts], dtype=object)

        return encode(text)

    def count(self, text: Column) -> Column:
        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            coder = self.coder()
            return pd.Series([len(coder.encode_ordinary(t or "")) for t in texts], dtype="int32")

        return counted(text)

    def text(self, ids: Column) -> Column:
        """The text of ids; a character that they cut is left out."""

        @F.pandas_udf("string")
        def decode(lists: pd.Series) -> pd.Series:
            coder = self.coder()
            return pd.Series([coder.decode_bytes([int(i) for i in x]).decode("utf-8", "ignore") if x is not None else "" for x in lists], dtype=object)

        return decode(ids)

    def windows(self, texts: DataFrame, target: int, step: int) -> DataFrame:
        """doc_id, chunk, content, tokens: each text (doc_id, content) cut into windows; one that fits is its only window, unchanged.

        A text's ids stay in its task, and windows leave it a few at a time, so memory follows the longest text.
        """
        kind = texts.schema["doc_id"].dataType.simpleString()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = self.coder()
            for batch in batches:
                row, chunk, content, size = [], [], [], []

                def made(ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                    out = pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(chunk, pa.int32()), pa.array(content, pa.string()), pa.array(size, pa.int32())], names=["doc_id", "chunk", "content", "tokens"])
                    for x in (row, chunk, content, size):
                        x.clear()
                    return out

                for i, one in enumerate(batch.column(1)):
                    text = one.as_py()
                    ids = coder.encode_ordinary(text)
                    for c, start in enumerate(range(0, max(0, -(-(len(ids) - target) // step)) * step + 1, step)):
                        own = ids[start : start + target]
                        row.append(i)
                        chunk.append(c)
                        content.append(text if len(ids) <= target else coder.decode_bytes(own).decode("utf-8", "ignore"))
                        size.append(len(own))
                        if len(row) == WINDOWS:
                            yield made()
                if row:
                    yield made()

        return texts.filter(F.col("content").isNotNull()).select("doc_id", "content").mapInArrow(cut, f"doc_id {kind}, chunk int, content string, tokens int")

    def truncated(self, text: Column, most: int) -> Column:
        """The first tokens of a text."""

        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            coder, out = self.coder(), []
            for t in texts:
                ids = coder.encode_ordinary(t or "")
                out.append(t if len(ids) <= most else coder.decode_bytes(ids[:most]).decode("utf-8", "ignore"))
            return pd.Series(out, dtype=object)

        return cut(text)


class WordPieces:
    """Word pieces: lower case without marks, cut at white space and punctuation, then the longest piece first."""

    def __init__(self, vocabulary: list[str], *, unknown: str = "[UNK]", most_letters: int = 100):
        self.vocabulary, self.unknown, self.most_letters = tuple(vocabulary), unknown, most_letters

    def ids(self, text: Column, *, most: int | None = None) -> Column:
        words, unknown, letters = self.vocabulary, self.unknown, self.most_letters

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            coder = _pieces(words, unknown, letters)
            found = coder.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return pd.Series([x.ids[:most] for x in found], dtype=object)

        return encode(text)


@lru_cache(maxsize=4)
def _pieces(words: tuple[str, ...], unknown: str, letters: int):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    coder = Tokenizer(models.WordPiece({w: i for i, w in enumerate(words)}, unk_token=unknown, max_input_chars_per_word=letters))
    coder.normalizer = normalizers.BertNormalizer(lowercase=True)
    coder.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return coder

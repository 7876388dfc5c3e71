"""Token counts of whole texts by an unchanged public tokenizer, as lengths only.

Texts are encoded in batches of about ``BATCH_BYTES`` of UTF-8, whatever their number, and a text above ``LONG_CHARS`` is split
where the count cannot change: before a single space between two characters that are not space. No piece of the model
has a space after another character, so nothing is ever merged across such a place, and the space that the library
puts before each text stands for the one left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import read, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BATCH_BYTES = 1 << 20
LONG_CHARS = 1 << 15

COUNTS = "doc_id long, n_bytes long, n_tokens long"


def split_safely(text: str, chars: int) -> list[str]:
    """Parts of about chars characters whose counts add up to that of the text; longer where there is no safe place."""
    parts, start = [], 0
    while len(text) - start > chars:
        at = text.find(" ", start + chars)
        while at > 0 and (at + 1 >= len(text) or text[at - 1] in " ▁" or text[at + 1] in " ▁"):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


class SentencePieceCounter:
    """.model files; splits_safely if no piece of the model has a space after another character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits_safely = not any("\u2581" in p.lstrip("\u2581") for p in pieces) and self.model.encode("a b") == [*self.model.encode("a"), *self.model.encode("b")]

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class JsonCounter:
    """.json files; texts are never split."""

    splits_safely = False

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


_COUNTERS: dict[str, SentencePieceCounter | JsonCounter] = {}


def counter(name: str):
    if name not in _COUNTERS:
        import public_tokenizers

        path = public_tokenizers.path(name)
        _COUNTERS[name] = (JsonCounter if name.endswith(".json") else SentencePieceCounter)(path)
    return _COUNTERS[name]


def _count(name: str, batch_bytes: int, long_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for batch in batches:
            n_bytes, n_tokens = [0] * batch.num_rows, [0] * batch.num_rows
            parts: list[str] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                for row, n in zip(rows, count(parts), strict=True):
                    n_tokens[row] += n
                parts.clear()
                rows.clear()

            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                n_bytes[row] = value.as_buffer().size
                cut = split_safely(text, long_chars) if count.splits_safely and len(text) > long_chars else [text]
                for part in cut:
                    parts.append(part)
                    rows.append(row)
                    held += n_bytes[row] if len(cut) == 1 else len(part.encode())
                    if held >= batch_bytes:
                        flush()
                        held = 0
            if parts:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = MODEL, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are counted like others; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(_count(tokenizer, batch_bytes, long_chars), COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))

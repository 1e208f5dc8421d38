"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tokenizer file of the `tokenizers` library, the same on every executor; never copied into this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The session's setting that names another one.
SETTING = "spark.corpusloom.tokenizer"
#: Characters encoded at once.
BATCH_CHARS = 2_000_000


def _counter(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sizes: list[int] = []
            held: list[str] = []
            chars = 0
            for t in texts:
                held.append(t)
                chars += len(t)
                if chars >= BATCH_CHARS:
                    sizes += [len(e.ids) for e in tokenizer.encode_batch_fast(held, add_special_tokens=False)]
                    held, chars = [], 0
            sizes += [len(e.ids) for e in tokenizer.encode_batch_fast(held, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return work


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, tokens by `tokenizer`, else the session's setting, else TOKENIZER. Null and empty texts have 0 tokens; rows of a null doc_id are left out."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    path = tokenizer or documents.sparkSession.conf.get(SETTING, TOKENIZER)
    return rows.filter("doc_id is not null").mapInArrow(_counter(path), "doc_id long, source string, tokens long")

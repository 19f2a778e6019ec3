"""Corpus encoding with a public byte-level tokenizer (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.bpe import DEFAULT_VOCABULARY, MergeList

_MERGES: dict[int, MergeList] = {}


def share_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Broadcast:
    """The vocabulary file's bytes for all executors. It is fixed (about 1 MB), whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def merges_of(shared: Broadcast) -> MergeList:
    """The merge list, built once in each Python worker."""
    key = hash(shared.value)
    if key not in _MERGES:
        _MERGES.clear()
        _MERGES[key] = MergeList.from_bytes(shared.value)
    return _MERGES[key]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row (id, ids) for each row of df, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts give
    an empty list, a null id stays null, repeated rows are encoded each, an empty table
    gives an empty result and further columns are dropped. No shuffle; a text is encoded
    whole and its transducer holds a constant amount of state, however long it is.
    """
    shared = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(shared)
        for b in batches:
            ends, flat = [0], []
            for text in b.column(1):
                ids = m.encode(text.as_py())
                flat.append(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32))
                ends.append(ends[-1] + len(ids))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), type=pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The inverse of encode_corpus: one row (id, text) for each row; null or empty ids give an empty text."""
    shared = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(shared)
        for b in batches:
            texts = ["".join(m.decode(ids.as_py() or ())) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=[id_col, "text"])

    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, out)


def roundtrip_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens, same) for each row: whether decoding the streamed ids gives the text back, '' for null."""
    shared = share_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(shared)
        for b in batches:
            n, same = [], []
            for cell in b.column(1):
                text = cell.as_py() or ""
                ids = m.encode(text)
                at, ok = 0, True
                for part in m.decode(ids):
                    ok = ok and text.startswith(part, at)
                    at += len(part)
                n.append(len(ids))
                same.append(ok and at == len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(same, type=pa.bool_())], names=[id_col, "n_tokens", "same"])

    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("same", T.BooleanType())])
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)

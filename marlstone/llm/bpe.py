"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first: before a single space with a non-space on either side. There the pattern
always ends one match and begins the next, so the pieces' ids joined are the whole text's ids. A text without such a
place is encoded whole. Ids travel as binary, little-endian unsigned 32-bit integers.

Defined results: a null text counts as empty (no ids, empty bytes); ids that are null decode to empty bytes; null and
repeated doc_ids pass through, a row in and a row out; an empty table gives no rows.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._common import column, flush_batches

#: Characters of a piece of a long text, about.
PIECE = 1 << 16
SAFE = re.compile(r"(?<=\S) (?=\S)")


@cache
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """One encoder per Python worker; no special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """text cut at safe boundaries into parts of about limit characters."""
    at = 0
    while len(text) - at > limit:
        cut = SAFE.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str, enc: tiktoken.Encoding, limit: int = PIECE) -> np.ndarray:
    if len(text) <= limit:
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.asarray(enc.encode_ordinary(x), dtype="<u4") for x in pieces(text, limit)])


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)

        def rows():
            for b in batches:
                texts = b.column(1)
                for i, doc_id in enumerate(b.column(0).to_pylist()):
                    ids = encode_text(texts[i].as_py(), enc)
                    yield doc_id, len(ids), ids.tobytes()

        yield from flush_batches(rows(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows of encoded with a column decoded: the raw bytes that ids stand for."""
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields]
    own = [f"c{k}" for k in range(len(fields))]  # whatever characters the names have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = [enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) if x else b"" for x in part.column(names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, type=pa.binary())], names=[*own, "decoded"])

    schema = StructType([*[StructField(k, f.dataType) for k, f in zip(own, fields)], StructField("decoded", BinaryType())])
    return encoded.select(*[column(n).alias(k) for k, n in zip(own, names)]).mapInArrow(run, schema).toDF(*names, "decoded")

"""Operator 5: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import SLICE_BYTES, small_batches, text_slices, texts_of


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizers BPE model that merges by rank: each way of splitting a token into two known ones is a merge of that token's rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(shown[a], shown[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def byte_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of each id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """Token ids of whole texts.

    Returns id_column, ids (binary: little-endian unsigned 32-bit), n_tokens, with decoded the bytes that the ids decode to, and with offsets
    starts and ends: the code points [start, end) of the text that each token touches. A token that holds part of a character's bytes has that character's place.
    Null and empty texts have no tokens; rows are never dropped, repeated rows are encoded each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType
    fields = [T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded:  # in the same pass, so that the ids need no second Python process
        fields.append(T.StructField("decoded", T.BinaryType()))
    places = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("starts", "ends")] if offsets else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        tokenizer = build_tokenizer(*shared.value)
        token = byte_table(shared.value[0]).__getitem__
        run = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
        for rows, bounds, data in text_slices(batches, limit=SLICE_BYTES // 16):  # an encoding is many times as large as its text
            found = run([t.decode() for t in texts_of(bounds, data)], add_special_tokens=False)
            ids = [np.array(x.ids, "<u4") for x in found]
            out = [rows.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            if decoded:
                out.append(pa.array([b"".join(map(token, x.tolist())) for x in ids], pa.binary()))
            if offsets:
                out += [pa.array([[p[k] for p in x.offsets] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields + places])

    return source.mapInArrow(work, T.StructType(fields + places)).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", carry: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """Bytes of encoded ids, and their text.

    Takes id_column and ids as encode() returns them. Returns id_column, the columns in carry, decoded (binary) and, with text,
    decoded_text: characters that tokens split are joined again, bytes that form no character become U+FFFD. Null ids decode to no bytes.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    source = encoded.select(id_column, "ids", *carry)
    schema = T.StructType([source.schema[id_column], *(source.schema[c] for c in carry), T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = byte_table(shared.value).__getitem__
        for rows in batches:
            raw = rows.column(1).to_pylist()
            out = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in raw]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(rows.column(2 + k) for k in range(len(carry))), pa.array(out, pa.binary())], names=schema.names)

    decoded = source.mapInArrow(work, schema)
    if not text:
        return decoded
    return decoded.withColumn("decoded_text", F.make_valid_utf8(F.col("decoded").cast("string")))


def pieces(ids: bytes, table: list[bytes]) -> list[str]:
    """Text of each token in turn; bytes of a split character are held back until the token that completes it."""
    import codecs

    reader, out = codecs.getincrementaldecoder("utf-8")("replace"), []
    for k in np.frombuffer(ids, "<u4").tolist():
        out.append(reader.decode(table[k]))
    return [*out[:-1], out[-1] + reader.decode(b"", True)] if out else out

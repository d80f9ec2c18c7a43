"""Operator 4: quality classifier from two zstandard dictionaries, one of good and one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.common import bounded_sample, held_out, small_batches, text_slices, texts_of

LEVEL = 3
FEATURES = 6


@dataclass(frozen=True)
class Model:
    """Dictionaries, block length, and the calibration: scale and weights of the features."""

    good: bytes
    bad: bytes
    raw: tuple[bool, bool]
    block: int
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _dictionary(blocks: list[bytes], size: int) -> tuple[bytes, bool]:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    if not blocks:
        return b"", True
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:], True


class Sizes:
    """Compressed sizes of texts, block by block: with the good dictionary, with the bad one, and with none."""

    def __init__(self, good: bytes, bad: bytes, raw: tuple[bool, bool], block: int):
        self.block = block
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.compressors = [zstandard.ZstdCompressor(**options)]
        for content, is_raw in zip((good, bad), raw, strict=True):
            if not content:
                self.compressors.append(self.compressors[0])
                continue
            kind = zstandard.DICT_TYPE_RAWCONTENT if is_raw else zstandard.DICT_TYPE_FULLDICT
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))

    def features(self, text: bytes) -> tuple[float, ...]:
        """The normalised difference of the two sizes, the plain ratio, and their products. An empty text has zeros."""
        blocks = [text[k : k + self.block] for k in range(0, len(text), self.block)]
        if not blocks:
            return (1.0,) + (0.0,) * (FEATURES - 1)
        plain, good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        difference, ratio = (bad - good) / (bad + good), plain / (len(text) + 9 * len(blocks))
        return 1.0, difference, ratio, difference * ratio, difference * difference, ratio * ratio


def _calibrate(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features."""
    center, scale = features.mean(0), features.std(0)
    center[0], scale[scale == 0] = 0.0, 1.0
    a, w = (features - center) / scale, np.zeros(features.shape[1])
    ridge = np.eye(len(w)) * 0.1
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (weights * np.maximum(p * (1 - p), 1e-9))) @ a + ridge, a.T @ (weights * (labels - p)) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", per_class: int = 1200, dictionary_bytes: int = 65536, block: int = 512, longest: int = 1 << 20, sample_bytes: int = 64 << 20) -> Model:
    """Fit the model on a bounded sample: per_class texts of each label at most, none of over `longest` bytes, none of the held-out fold, and
    sample_bytes of text for both labels together, which is what the driver holds.

    Half of the sample makes the dictionaries; the other half calibrates, weighted to the labels' real shares. Labels other than 0 and 1,
    null labels and labels without a document are ignored; repeated labels of one id count once each. With one class or none the
    score is the base rate, with no label at all 0.5.
    """
    own = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1)").distinct()
    own = own.where(~held_out("doc_id"))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sample = bounded_sample(own.withColumn("text", F.lit("")), "label", per_class).drop("text")
    rows = texts.where(F.octet_length("text") <= longest).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "class_size", "text")
    # texts of a label in a fixed random order, as many as the bytes allow
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit("bytes")), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bytes", F.sum(F.octet_length("text") + 1).over(order)).where(F.col("_bytes") <= sample_bytes // 2)
    found = sorted((r.label, r.doc_id, r.text.encode(), r.class_size) for r in rows.collect())
    by = {k: [r for r in found if r[0] == k] for k in (0, 1)}
    (bad, raw_bad), (good, raw_good) = (_dictionary([b for r in by[k][::2] for b in (r[2][i : i + block] for i in range(0, len(r[2]), block)) if len(b) > 8], dictionary_bytes) for k in (0, 1))
    sizes = Sizes(good, bad, (raw_good, raw_bad), block)
    tested = [r for k in (0, 1) for r in (by[k][1::2] or by[k])]
    total = {k: by[k][0][3] if by[k] else 0 for k in (0, 1)}
    if not all(by.values()):
        rate = (total[1] + 0.5) / (total[0] + total[1] + 1)
        weights = np.zeros(FEATURES)
        weights[0] = np.log(rate / (1 - rate))
        return Model(good, bad, (raw_good, raw_bad), block, np.zeros(FEATURES), np.ones(FEATURES), weights)
    used = {k: sum(r[0] == k for r in tested) for k in (0, 1)}
    share = np.array([total[r[0]] / used[r[0]] for r in tested])
    center, scale, w = _calibrate(np.array([sizes.features(r[2]) for r in tested]), np.array([float(r[0]) for r in tested]), share * len(share) / share.sum())
    return Model(good, bad, (raw_good, raw_bad), block, center, scale, w)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's id_column, n_bytes and score from 0 to 1 (higher: label 1 likelier); whole texts, block by block.

    Null and empty texts get the score of a text without features; equal texts get equal scores.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad, m.raw, m.block)
        for rows, bounds, data in text_slices(batches):
            features = np.array([sizes.features(t) for t in texts_of(bounds, data)])
            p = 1 / (1 + np.exp(-np.clip((features - m.center) / m.scale @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)), pa.array(p)], ["id", "n_bytes", "score"])

    schema = T.StructType([source.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_column)

"""Language by compression: a text belongs to the language whose raw-content dictionary compresses it best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlines.llm.common import keep, learn_row

#: Documents sampled for a language at most, and bytes of the piece taken from anywhere in each: every language's dictionary
#: has the same budget of bytes, whatever its script.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 32, 1_500
#: Languages told apart at most: a text is compressed once for each. More raise an error; none is dropped.
MOST_LANGUAGES = 1_000
#: A text is compressed in pieces of so many bytes, so that its own past does not stand in for the dictionary.
PIECE_BYTES = 2_048
#: Below this share saved against the second-best language a prediction is rejected.
MIN_MARGIN = 0.005
#: Level 6 with matches from three bytes: short texts have few longer ones.
LEVEL, MIN_MATCH = 6, 3


def learn_dictionaries(documents: DataFrame, learn_from=learn_row, sample_documents: int = SAMPLE_DOCUMENTS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary of each non-null lang, from its sample_documents learnable documents that come first by hash.

    Of each of them a piece of sample_bytes bytes is taken, from a place drawn by hash
    within the whole text; rows equal in doc_id and text count once. Reruns agree.
    Null texts and texts without a letter are not sampled; without any, there is no dictionary.
    """
    known = documents.where(F.col("lang").isNotNull() & learn_from(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    draw = F.xxhash64("doc_id", "text")
    begin = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(1)), F.greatest(F.length("text") - sample_bytes, F.lit(0)) + 1)
    drawn = known.select("lang", draw.alias("draw"), F.lower(F.substring("text", (begin + 1).cast("int"), F.lit(sample_bytes))).alias("sample"))
    # two steps: the best of each salted part first, then the best of those few; equal rows share a draw
    for keys in (["lang", F.pmod("draw", F.lit(64))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("draw", "sample")
        drawn = drawn.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= sample_documents).drop("place").dropDuplicates(["lang", "draw"])
    kept = keep(drawn, "samples")
    if kept.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to tell apart")
    samples: dict[str, list[bytes]] = {}
    for row in kept.orderBy("lang", "draw", "sample").collect():  # MOST_LANGUAGES times sample_documents at most
        samples.setdefault(row["lang"], []).append(row["sample"].encode()[:sample_bytes])
    return {lang: b"\n".join(pieces) for lang, pieces in sorted(samples.items())}


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, min_match: int = MIN_MATCH):
        import zstandard

        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=PIECE_BYTES, dict_size=max(map(len, dictionaries.values()), default=1), min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1) and margin: the share of bytes the best saves against the second best."""
        raw = (text or "").lower().encode()
        if not self.langs or not any(map(str.isalpha, (text or "")[:256])) and not any(map(str.isalpha, text or "")):
            return "und", 0.0, 0.0
        sizes = np.asarray(self.sizes(raw), float)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = 1.0 if len(sizes) == 1 else float(1 - best / sizes[order[1]])
        weight = np.exp(-40 * (sizes / best - 1))
        return self.langs[order[0]], float(weight[order[0]] / weight.sum()), margin


def identify_languages(documents: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of documents with lang_pred, score, margin and rejected; columns of those names are replaced.

    Every whole text is compressed in lower case, piece by piece. Texts that are null, empty or
    without a letter, and all texts if no language was learnt, give `und`, score 0,
    margin 0 and are rejected; so are margins under min_margin. Ties go to the
    language that comes first by name. Equal rows get equal results.
    """
    out = ["lang_pred", "score", "margin", "rejected"]
    source = documents.drop(*out)
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = CompressionClassifier(dictionaries)
        for batch in batches:
            found = [coder.predict(t.as_py()) for t in batch.column(at)]
            lang, score, margin = (list(x) for x in zip(*found)) if found else ([], [], [])
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
            more.append(pa.array([g == "und" or m < min_margin for g, m in zip(lang, margin, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *out])

    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, k) for n, k in zip(out, kinds, strict=True))])
    return source.mapInArrow(run, schema)

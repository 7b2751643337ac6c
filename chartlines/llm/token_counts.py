"""Token counts of whole texts by a public sentence-piece vocabulary.

Whole-token shortcut: a piece of the vocabulary that the library encodes to
itself is one token wherever it stands as a pre-token. Pre-tokens are cut in
front of each run of blanks that follows another character; no piece holds a
blank after another character (checked when the tokens are proved), so no merge
crosses such a cut and the counts of pre-tokens add up to the count of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.llm.batches import slices

_CUT = re.compile(r" *[^ ]+| +$")
_BLANK = "▁"
#: A worker remembers the counts of merged pre-tokens of up to so many characters, REMEMBERED of them (some 80 MB); it
#: forgets all beyond and never remembers longer ones, which costs time only.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48


def load_model(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def prove_whole_tokens(model_path: str) -> frozenset[str]:
    """Pre-tokens, without the blank in front, that encode alone as their own single token; proved once and sent to the tasks.

    Raises ValueError for a model whose texts can't be cut at blanks.
    """
    model = load_model(model_path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
        raise ValueError("a piece holds a blank inside: its texts can't be cut at blanks")
    probe = "a\tb\n c  éÅＡ "
    if "".join(model.decode(model.encode(probe))) != probe or model.encode("a", out_type=str)[0][0] != _BLANK:
        raise ValueError("the model changes texts before it cuts them")
    named = [p[1:] for p in pieces if p.startswith(_BLANK) and _BLANK not in p[1:] and len(p) > 1]
    return frozenset(w for w, ids in zip(named, model.encode(named), strict=True) if len(ids) == 1 and model.id_to_piece(ids[0]) == _BLANK + w)


class PieceCounter:
    """Counts tokens as the library does, merging only pre-tokens that are not a token by themselves."""

    def __init__(self, model_path: str, whole: frozenset[str] | None = None):
        self.model = load_model(model_path)
        self.whole = prove_whole_tokens(model_path) if whole is None else whole
        self.merged: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens without one blank in front, which the library adds again."""
        text = text.replace(_BLANK, " ")
        if "  " not in text and text[-1:] != " " and text[:1] != " ":
            return text.split(" ") if text else []
        found = _CUT.findall(text)
        return found[:1] + [x[1:] for x in found[1:]]

    def _merge(self, words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, ids in zip(part, self.model.encode(part, num_threads=1), strict=True):
                out[word] = len(ids) if word else 1
        return out

    def count(self, texts: Iterable[str | None]) -> list[int]:
        split = [Counter(self.pre_tokens(t)) if t else Counter() for t in texts]
        rest = [[(w, n) for w, n in c.items() if w not in self.whole] for c in split]
        wanted = {w for r in rest for w, _ in r}
        known = {w: self.merged[w] for w in wanted if w in self.merged}
        fresh = self._merge([w for w in wanted if w not in known])
        out = [c.total() + sum(((known[w] if w in known else fresh[w]) - 1) * n for w, n in r) for c, r in zip(split, rest, strict=True)]
        short = {w: n for w, n in fresh.items() if len(w) <= REMEMBERED_LENGTH}
        if len(self.merged) + len(short) > REMEMBERED:
            self.merged.clear()
        self.merged |= dict(islice(short.items(), REMEMBERED))
        return out


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row, over the whole text.

    Null texts count as empty (0 bytes, 0 tokens); a null doc_id stays; equal
    rows each get a row; an empty table gives an empty one; other columns,
    whatever their names, are not looked at. model_path is read on the
    driver and on every executor, where the vocabulary must be installed.
    """

    whole = documents.sparkSession.sparkContext.broadcast(prove_whole_tokens(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, whole.value)
        for batch in batches:
            column, counts = batch.column(1), []
            for a, b in slices(column):
                counts += counter.count(column.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

"""Token counts without token ids.

The pieces of a pre-token are counted once for each distinct pre-token of a
block of documents and kept while the worker's table has room; a block's
documents bring their pre-token frequencies, and a document's count is the
sum of frequency times pieces over that join. The join stays inside the
block: one over the whole corpus would shuffle a row for each pair of
document and distinct pre-token, more than twice the bytes of the texts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavetable.llm.blocks import groups, narrow
from wavetable.llm.pretokens import LONGEST, REMEMBERED, settled, splitter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512


class Counts:
    """Piece counts under one byte-level tokenizer file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        #: Other kinds of tokenizer are asked text by text.
        self.by_piece = plain and not odd and spec["normalizer"] is None and len(self.special) <= 1
        self.split = splitter(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text, and the special tokens in it."""
        parts = text.split(self.special[0]) if self.special else [text]
        out = Counter(self.split(parts[0]))
        for p in parts[1:]:
            out.update(self.split(p))
        return out, len(parts) - 1

    def block(self, texts: list[str]) -> list[tuple[int, int | None]]:
        """(tokens, distinct pre-tokens) of each text; the latter is None where the text was counted whole."""
        each = [self.frequencies(t) if self.by_piece and settled(t) else None for t in texts]
        distinct = set().union(*(x[0] for x in each if x))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        counted = dict(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        pieces = {p: self.known[p] for p in distinct if p in self.known} | counted
        self.known.update((p, n) for p, n in counted.items() if len(p) <= LONGEST)
        return [(sum([f * pieces[p] for p, f in x[0].items()]) + x[1], len(x[0])) if x else (len(self.library.encode(t, add_special_tokens=False).ids), None) for t, x in zip(texts, each, strict=True)]


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


def _run(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    c = counts(path)
    for part in groups(batches):
        texts = [t or "" for t in part.column("text").to_pylist()]
        n, distinct = zip(*c.block(texts), strict=True)
        size = pa.array([len(t.encode()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(distinct, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "n_distinct"])


def token_counts(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_distinct, over_limit) for each row of ``docs``.

    Only ``doc_id`` and ``text`` are read. Null and empty texts have no bytes
    and no tokens. Repeated rows and repeated or null ids each give their own
    row. ``n_distinct`` is null for texts with unassigned code points, which
    the library counts whole.
    """
    docs = narrow(docs).select(F.col("doc_id").cast("long"), "text")
    out = docs.mapInArrow(lambda it: _run(it, path), "doc_id long, n_bytes long, n_tokens long, n_distinct long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The query: token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality rules of documents, and verdicts on the hosts they come from.

A host's failure rate is shrunk towards the mean of all hosts by a beta prior
fitted to the hosts' rates by the method of moments, so a host with few
documents is not judged by them alone. Hosts over the threshold lose all
their documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetable.llm.blocks import groups, narrow, utf8
from wavetable.session import stable

#: A document fails with fewer words, or with a larger share (of 100) of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8
#: A host goes if its shrunk failure rate is above.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 10_000.0

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
#: Bytes that begin a code point outside white space.
BEGINS = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(document index, word) of all words, in order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, doc = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    there = pc.greater(pc.binary_length(flat), 0)
    return doc[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated(word: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks words in windows that their document has twice or more; exact, by doubling (window: a power of two)."""
    import pandas as pd

    n = len(word)
    covered = np.zeros(n + 1, np.int64)
    if n >= window:
        gram, size = word, 1
        while size < window:
            gram = pd.factorize(gram[:-size] * (gram.max() + 1) + gram[size:])[0].astype(np.int64)
            size *= 2
        at = np.flatnonzero(doc[: len(gram)] == doc[window - 1 :])
        key = pd.factorize(gram[at] * (doc[-1] + 1) + doc[at])[0]
        twice = at[np.bincount(key)[key] > 1] if len(key) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + window, -1)
    return np.cumsum(covered)[:n] > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule figures of each text."""
    n = len(texts)
    raw, off = utf8(texts)
    upto = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[off])
    doc, flat = words(texts)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    of, line = np.repeat(np.arange(n), lines.value_lengths().to_numpy()), lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    of, line = of[full.to_numpy(zero_copy_only=False)], line.filter(full)
    key = codes(line) * n + of
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": upto(BEGINS.astype(np.int64)),
        "n_symbols": upto(SYMBOL),
        "n_dup_lines": np.bincount(of, minlength=n) - np.bincount(np.unique(key) % n, minlength=n),
        "n_repeat_words": np.bincount(doc, weights=repeated(codes(flat), doc), minlength=n).astype(np.int64),
    }


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in groups(batches):
        m = measure(part.column("text"))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(v, pa.int64()) for v in m.values())], names=["doc_id", "host", *m])


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The figures of each row of ``docs``, its ``host``, and ``base_failed``. A null text has no words and fails."""
    out = narrow(docs).select(F.col("doc_id").cast("long"), "text", F.col(host).cast("string").alias("host")).mapInArrow(
        _run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected) of each host; a null host is one host."""
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    mean = mean or 0.0
    weight = min(PRIOR_MAX, max(PRIOR_MIN, mean * (1 - mean) / var - 1)) if var else PRIOR_MAX
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def host_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rule figures of each row of ``docs`` with ``base_failed`` and ``kept``.

    Only ``doc_id``, ``text`` and the host column are read. Null and empty
    texts fail. Repeated rows and repeated or null ids each count and each
    give their own row; null hosts form one host. An empty table gives none.
    The figures are checkpointed (some 80 bytes a document), so texts are
    read once; the verdicts come back by a join that Spark broadcasts only if
    it finds the hosts small, and otherwise shuffles and splits where skewed.
    """
    rules = stable(document_rules(docs, host))
    hosts = host_verdicts(rules, max_rate).withColumnRenamed("host", "_host")
    out = rules.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    """The query: rules and host verdicts of every document."""
    return host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = f"""
WITH t AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT doc_id, host, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws,
         list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM t
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id
), r AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM r
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY host
), p AS (
  SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v > 0 THEN least({PRIOR_MAX}, greatest({PRIOR_MIN}, m * (1 - m) / v - 1)) ELSE {PRIOR_MAX} END AS k FROM p
), j AS (
  SELECT host, (f + m * k) / (n + k) > {MAX_HOST_RATE} AS rejected FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN j ON b.host IS NOT DISTINCT FROM j.host
"""

"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Token counts are summed into cells of source, language and topic. Raking
scales the cells to each dimension's target tokens in turn, no cell over its
tokens, until all marginals hold. A cell's weight over its tokens is the
probability with which its documents are kept; whether one is kept depends on
its id alone, so the sample is the same in every run.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetable.session import stable

DIMS = ("source", "lang", "topic")
#: A dimension's target shares are its token shares to this power, made to sum to 1.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.9}
#: The first pattern that a text contains names its topic.
TOPICS = (("table", "|"), ("licence", "icense"), ("contact", "@"), ("shouting", "!!"), ("symbols", "%%%"))
OTHER = "prose"
#: Share of all tokens to keep, largest relative error of a marginal that ends the raking, and the sample's seed.
BUDGET, TOLERANCE, SEED = 0.7, 1e-9, "7"
#: The raking also ends where the errors of PATIENCE steps have not fallen under FALL of those before: the targets contradict each other.
PATIENCE, FALL = 10, 0.999
#: Weights, before they are cut at the tokens, are so many times these at most, and a part of that at least.
FAR = 1e30
#: Up to so many cells (some 60 bytes each) are broadcast to the documents and raked in one task; more stay distributed.
FEW_CELLS = 100_000
#: Sweeps between two checkpoints of few cells.
STEP = 3
#: Sweeps and rounds that the SQL has; more than any table here needs.
SQL_SWEEPS, SQL_ROUNDS = 60, 20
LOG = logging.getLogger(__name__)
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, rules=TOPICS, other: str = OTHER) -> Column:
    """A text's topic by fixed strings, first match first; null and empty texts have the last one."""
    out = None
    for name, part in rules:
        hit = F.contains(text, F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise(other), F.lit(other))


def weigh(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of each row; tokens are words, none in a null text."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        topic_of(F.col("text")).alias("topic"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def _targets(cells: DataFrame, dim: str, tokens: float, power: float, shares: dict[str, float] | None) -> DataFrame:
    """(dim, to): tokens of each level that sum to ``tokens``, if no level has a target over its own count.

    A level's part is its count to ``power``, or its value in ``shares`` if
    given, which has none for levels that it leaves out.
    """
    part = F.pow("n", F.lit(power))
    if shares is not None:
        part = F.lit(0.0)
        for name, value in shares.items():
            part = F.when(F.col(dim) == _level(F.lit(name)), F.lit(float(value))).otherwise(part)
    levels = stable(cells.groupBy(dim).agg(F.sum("n_tokens").cast("double").alias("n")).withColumn("part", part))
    scale = 0.0
    while True:
        cut = F.lit(scale) * F.col("part") >= F.col("n")
        full, free = levels.agg(F.sum(F.when(cut, F.col("n")).otherwise(0.0)), F.sum(F.when(cut, 0.0).otherwise(F.col("part")))).first()
        after = (tokens - full) / free if free else scale
        if after <= scale * (1 + 1e-12):
            return levels.select(dim, F.least(F.col("n"), F.lit(scale) * F.col("part")).alias(f"to_{dim}"))
        scale = after


def _level(c: Column) -> Column:
    """A level as a value that is never null, so that joins are plain ones."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def _with_sums(cells: DataFrame, key: str, sums: dict[str, Column], few: bool) -> DataFrame:
    """``cells`` with sums over each level: windows where all are in one task, else aggregates that are joined back."""
    if few:
        return cells.withColumns({name: c.over(Window.partitionBy(key)) for name, c in sums.items()})
    return cells.join(cells.groupBy(key).agg(*(c.alias(name) for name, c in sums.items())), key)


def rake(weighed: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, tolerance: float = TOLERANCE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The cells (dimensions, n_tokens, weight, each dimension's target to_*, probability) with tokens; no weight is over n_tokens.

    Weights sum to ``budget`` of all tokens and to the targets in every
    dimension: shares by level from ``targets``, or else token shares to the
    dimension's power. A level whose share of the budget is more than its
    tokens has these as its target, and the others of the dimension share the
    rest in proportion. A sweep takes each dimension's scales to where its
    marginals would hold if no cell became full or free. Sweeps go on until
    the largest relative error is under ``tolerance``, or until errors stop
    falling, as no weights meet targets that contradict each other; what is
    left is logged then and ``marginals`` gives it. Cells are few next to
    documents but not bounded: up to FEW_CELLS they meet in one task, beyond
    that sums of levels are aggregated before they are shuffled and joined
    back. A step's only row for the driver is its errors.
    """
    dims = list(powers)
    keys = [f"_{d}" for d in dims]
    cells = stable(weighed.groupBy(*dims).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0"))
    count, total = cells.agg(F.count("*"), F.sum("n_tokens")).first()
    cells = cells.withColumns({f"_{d}": _level(F.col(d)) for d in dims})
    cells = cells.coalesce(1) if count <= FEW_CELLS else cells
    for d, k in zip(dims, keys, strict=True):
        cells = cells.join(_targets(cells, k, budget * (total or 0), powers[d], (targets or {}).get(d)).withColumnRenamed(f"to_{k}", f"to_{d}"), k)
    few = count <= FEW_CELLS
    held = F.least("weight", "n_tokens")
    full = F.col("weight") >= F.col("n_tokens")
    cells = stable(cells.withColumn("weight", F.lit(float(budget)) * F.col("n_tokens")).withColumn("error", F.lit(1.0)))
    errors: list[tuple[float, float]] = []
    while True:
        before, cells = cells, cells.coalesce(1) if few else cells
        for _ in range(STEP if few else 1):
            error = F.lit(0.0)
            for d, k in zip(dims, keys, strict=True):
                sums = {"_full": F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), "_free": F.sum(F.when(full, 0.0).otherwise(F.col("weight")))}
                to, ratio = F.col(f"to_{d}"), F.col(f"to_{d}") / (F.col("_full") + F.col("_free"))
                scale = F.when((F.col("_full") < to) & (F.col("_free") > 0), (to - F.col("_full")) / F.col("_free")).otherwise(ratio)
                cells = _with_sums(cells, k, sums, few).withColumns({"_scale": scale, f"error_{d}": F.when(to > 0, F.abs(1 / ratio - 1)).otherwise(0.0)})
                bound = F.greatest(F.least(F.col("weight") * F.col("_scale"), F.lit(FAR) * F.col("n_tokens")), F.col("n_tokens") / F.lit(FAR))
                cells = cells.withColumn("weight", bound).drop("_scale", "_full", "_free")
                error = F.greatest(error, F.col(f"error_{d}"))
            cells = cells.withColumn("error", error).drop(*(f"error_{d}" for d in dims))
        cells = stable(cells, before)
        worst, mean = cells.agg(F.max("error"), F.sum(F.col("error") * held)).first()
        errors.append((worst or 0.0, mean or 0.0))
        if errors[-1][0] < tolerance:
            break
        if not _falling(errors):
            LOG.warning("raking ended after %d steps with a marginal %.3g off its target", len(errors), errors[-1][0])
            break
    return cells.withColumn("weight", held).withColumn("probability", F.col("weight") / F.col("n_tokens")).drop("error", *keys)


def _falling(errors: list[tuple[float, float]]) -> bool:
    """Whether the largest or the mean error of the last PATIENCE steps is under FALL of the least before them."""
    old, new = errors[:-PATIENCE], errors[-PATIENCE:]
    return not old or any(min(n) < FALL * min(o) for o, n in zip(zip(*old, strict=True), zip(*new, strict=True), strict=True))


def marginals(cells: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """(dimension, level, target, reached) of each level of the dimensions of raked cells."""
    out = [cells.groupBy(d).agg(F.first(f"to_{d}").alias("target"), F.sum("weight").alias("reached")).select(F.lit(d).alias("dimension"), F.col(d).alias("level"), "target", "reached") for d in dims]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = SEED, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, sampled) of each row of ``docs``.

    Only ``doc_id``, ``text``, ``source`` and ``lang`` are read. ``targets``
    may give a dimension's shares by level in place of its power. Texts
    without words belong to no cell with tokens unless others share it; alone
    they get probability 1, as they cost no tokens. Null sources and languages
    are values like others. Repeated rows and ids share their draw; null ids
    all have one. An empty table gives an empty table.
    """
    weighed = stable(weigh(docs))
    out = _with_probability(weighed, rake(weighed, powers, budget, targets=targets), powers)
    return out.withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("probability"))


def _with_probability(weighed: DataFrame, cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    cells = cells.select(*(F.col(d).alias(f"_{d}") for d in powers), F.col("probability").alias("_p"))
    if cells.count() <= FEW_CELLS:
        cells = F.broadcast(cells)
    out = weighed.join(cells, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in powers], "left").drop(*(f"_{d}" for d in powers))
    return out.withColumn("_p", F.coalesce("_p", F.lit(1.0))).withColumnRenamed("_p", "probability")


def sample(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = SEED, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, all columns as they are."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    columns = {"source": F.col("row.source").cast("string"), "lang": F.col("row.lang").cast("string"), "topic": topic_of(F.col("row.text"))}
    cells = rake(stable(weigh(docs)), powers, budget, targets=targets)
    out = _with_probability(packed.withColumns(columns), cells, powers)
    return out.where(draw(F.col("row.doc_id"), seed) < F.col("probability")).select("row.*")


def op10_mixture(spark, sf_dir: str) -> DataFrame:
    """The query: every document's probability, to four places, and whether it is in the sample."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("probability", F.round("probability", 4))


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN contains(text, '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{OTHER}' END"
    parts = [
        f"w AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda s: s <> '')) AS BIGINT) AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM w GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d, p in POWERS.items():
        parts.append(f"l_{d} AS MATERIALIZED (SELECT {d}, sum(n) AS n, pow(sum(n), {p}) AS part FROM c GROUP BY {d})")
        parts.append(f"{d}0 AS (SELECT 0.0::DOUBLE AS scale)")
        cut = "scale * part >= n"
        for i in range(SQL_ROUNDS):
            parts.append(f"{d}{i + 1} AS MATERIALIZED (SELECT greatest(max(scale), coalesce(({BUDGET} * sum(n) - sum(CASE WHEN {cut} THEN n ELSE 0 END)) / nullif(sum(CASE WHEN {cut} THEN 0 ELSE part END), 0), 0)) AS scale FROM l_{d}, {d}{i})")
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, least(n, scale * part) AS goal FROM l_{d}, {d}{SQL_ROUNDS})")
    joined = "c" + "".join(f" JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in POWERS)
    step = "SELECT * FROM s"
    for d in POWERS:
        full, free = (f"sum(CASE WHEN weight >= n THEN {x} ELSE {y} END) OVER (PARTITION BY {d})" for x, y in (("n", "0.0"), ("0.0", "weight")))
        scale = f"CASE WHEN {full} < to_{d} AND {free} > 0 THEN (to_{d} - {full}) / {free} ELSE to_{d} / ({full} + {free}) END"
        step = f"SELECT * REPLACE (greatest(least(weight * ({scale}), {FAR} * n), n / {FAR}) AS weight) FROM ({step})"
    parts.append(
        f"s AS (SELECT 0 AS k, c.source, c.lang, c.topic, c.n, {', '.join(f't_{d}.goal AS to_{d}' for d in POWERS)}, {BUDGET}::DOUBLE * c.n AS weight FROM {joined}"
        f" UNION ALL SELECT * REPLACE (k + 1 AS k) FROM ({step}) WHERE k < {SQL_SWEEPS})"
    )
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, weight / n) AS probability FROM s WHERE k = {SQL_SWEEPS})")
    u = f"('0x' || substr(md5(coalesce(w.doc_id::VARCHAR, '') || ':{SEED}'), 1, 12))::BIGINT / {16**12}.0::DOUBLE"
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT w.*, round(coalesce(p.probability, 1.0), 4) AS probability, {u} < coalesce(p.probability, 1.0) AS sampled FROM w LEFT JOIN p"
        " ON w.source IS NOT DISTINCT FROM p.source AND w.lang IS NOT DISTINCT FROM p.lang AND w.topic IS NOT DISTINCT FROM p.topic"
    )


SQL = _sql()

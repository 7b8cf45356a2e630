"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells of source, language and topic; the cells' token weights are raked to the target marginals
of one column after the other; then each document is drawn with its cell's calibrated probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laminar.llm.common import fresh, written

#: Rounds of raking, the power that flattens observed marginals into targets, and the seed of the draw.
ROUNDS, POWER, SEED = 6, 0.5, "mix-1"
MARGINALS = ("source", "lang", "topic")
#: Cells up to this many are broadcast to the documents; more of them meet the documents in a shuffled join.
BROADCAST_CELLS = 50_000
DIGITS = 9


def topic(text="text"):
    """A document's form, from its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit("|")), "table").when(F.contains(t, F.lit("@")), "contact").when(F.length(t) < 500, "note").when(F.length(t) < 5000, "article").otherwise("book")


def n_tokens(text="text"):
    """Blank-separated runs, counted by the blanks after them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.length(t) - F.length(F.translate(t, " \n", "")) + F.when(F.length(t) > 0, 1).otherwise(0)).cast("long")


def uniform(seed: str = SEED):
    """A number in [0, 1) that depends on seed and doc_id alone, so a lost task draws the same again."""
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def raked(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, power: float = POWER) -> DataFrame:
    """Cells with their weight (raked share over own share) and probability (the weight, 1 at most).

    targets: by marginal, a table (value, share); where there is none, the observed shares to `power`, made to sum to 1.
    A value without a target keeps its observed share; a cell without tokens has weight 0 and its rows are kept."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARGINALS[:2]]
    sums = docs.select(*columns, topic().alias("topic"), n_tokens().alias("n")).groupBy(*MARGINALS).agg(F.sum("n").alias("n"))
    cells = written(sums, "mix-cells")
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    cells = cells.withColumn("own", F.col("n") / F.lit(total)) if total else cells.limit(0).withColumn("own", F.lit(0.0))
    for c in MARGINALS:
        shares = cells.groupBy(c).agg(F.sum("n").alias("m"))
        if targets and c in targets:
            given = targets[c].select(F.col("value").cast("string").alias(c), F.col("share").cast("double").alias("share"))
            shares = shares.join(given, c, "left").withColumn("t", F.coalesce("share", F.col("m") / F.lit(total or 1.0)))
        else:
            shares = shares.withColumn("t", F.pow(F.col("m").cast("double"), F.lit(power)))
        whole = float(shares.agg(F.sum("t")).first()[0] or 1)
        cells = cells.join(shares.select(c, F.round(F.col("t") / F.lit(whole), DIGITS).alias(f"t_{c}")), c)
    cells = cells.withColumn("w", F.col("own"))
    for _ in range(rounds):
        for c in MARGINALS:
            have = F.sum("w").over(Window.partitionBy(c))
            cells = cells.withColumn("w", F.when(have > 0, F.round(F.col("w") * F.col(f"t_{c}") / have, 12)).otherwise(F.lit(0.0)))
    cells = cells.withColumn("weight", F.when(F.col("own") > 0, F.round(F.col("w") / F.col("own"), DIGITS)).otherwise(F.lit(0.0)))
    cells = written(cells.select(*MARGINALS, "weight"), "mix-weights")
    return cells.select(*MARGINALS, "weight", F.when(F.col("weight") < 1, F.col("weight")).otherwise(F.lit(1.0)).alias("probability"))


def drawn(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = SEED, into: str = "mix") -> DataFrame:
    """Every row of docs and, after its own columns, one struct of topic, tokens, weight, probability, repeats and kept; it is
    called `into`, with underscores after it where docs has such a column.

    Over-represented cells are thinned with probability = weight, no other is: kept documents stand for `repeats` (weight over
    probability) of their kind, so that kept tokens times repeats meet the targets in expectation. `sampled` gives rows that
    meet them as they are. Nulls of a marginal form a value of their own, "". Empty texts
    are drawn like the rest of their cell, and kept where the cell holds nothing else; rows that share an id share the draw; an empty table stays empty. Cells
    are broadcast only up to BROADCAST_CELLS rows; beyond, AQE splits the partitions of a hot cell."""
    into, own = fresh(docs, into), docs.columns
    cells = raked(docs, targets)
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    cells = cells.select(F.col("source").alias("_mix_source"), F.col("lang").alias("_mix_lang"), F.col("topic").alias("_mix_topic"), F.col("weight").alias("_mix_weight"), F.col("probability").alias("_mix_probability"))
    left = docs.select(*own, topic().alias("_mix_t"), n_tokens().alias("_mix_n"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_mix_s"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_mix_l"))
    on = (F.col("_mix_s") == F.col("_mix_source")) & (F.col("_mix_l") == F.col("_mix_lang")) & (F.col("_mix_t") == F.col("_mix_topic"))
    met = left.join(F.broadcast(cells) if small else cells, on, "left")
    w = F.coalesce("_mix_weight", F.lit(0.0))
    p = F.when(w > 0, F.col("_mix_probability")).otherwise(F.lit(1.0))
    repeats = F.when(w > 0, F.round(w / p, DIGITS)).otherwise(F.lit(1.0))
    said = {"topic": F.col("_mix_t"), "tokens": F.col("_mix_n"), "weight": w, "probability": p, "repeats": repeats, "kept": uniform(seed) < p}
    return met.select(*own, F.struct(*[c.alias(k) for k, c in said.items()]).alias(into))


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = SEED) -> DataFrame:
    """A sample of docs, with its own columns, whose tokens meet the targets as it stands.

    A row stands as often as its cell's weight says: its whole part, and once more with the rest as probability. So
    over-represented cells are thinned and under-represented ones repeated, and the sample has about as many tokens as docs. Drawing
    with weight over the largest weight instead would throw away what the rarest cell weighs more than the others."""
    found = drawn(docs, targets, seed)
    mix = found.columns[-1]
    w = F.when(F.col(f"{mix}.weight") > 0, F.col(f"{mix}.weight")).otherwise(F.lit(1.0))
    times = (F.floor(w) + F.when(uniform(seed) < w - F.floor(w), 1).otherwise(0)).cast("int")
    one = fresh(docs, "_mix_one")
    return found.select(*docs.columns, F.explode(F.when(times > 0, F.array_repeat(F.lit(0), times))).alias(one)).select(*docs.columns)


def _oracle() -> str:
    topic_sql = "CASE WHEN contains(t, '|') THEN 'table' WHEN contains(t, '@') THEN 'contact' WHEN length(t) < 500 THEN 'note' WHEN length(t) < 5000 THEN 'article' ELSE 'book' END"
    ctes = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"e AS (SELECT doc_id, source, lang, {topic_sql} AS topic, length(t) - length(replace(replace(t, ' ', ''), chr(10), '')) + CASE WHEN length(t) > 0 THEN 1 ELSE 0 END AS n FROM d)",
        "c AS (SELECT source, lang, topic, sum(n) AS n, sum(n)::DOUBLE / (SELECT sum(n) FROM e) AS own FROM e GROUP BY ALL)",
    ]
    for c in MARGINALS:
        ctes.append(f"m_{c} AS (SELECT {c}, round(power(sum(n)::DOUBLE, {POWER}) / sum(power(sum(n)::DOUBLE, {POWER})) OVER (), {DIGITS}) AS t_{c} FROM c GROUP BY {c})")
    ctes.append("r0 AS (SELECT c.*, t_source, t_lang, t_topic, own AS w FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))")
    k = 0
    for _ in range(ROUNDS):
        for c in MARGINALS:
            ctes.append(f"r{k + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {c}) > 0 THEN round(w * t_{c} / sum(w) OVER (PARTITION BY {c}), 12) ELSE 0 END AS w) FROM r{k})")
            k += 1
    ctes.append(f"f AS (SELECT source, lang, topic, CASE WHEN own > 0 THEN round(w / own, {DIGITS}) ELSE 0 END AS weight FROM r{k})")
    ctes.append("p AS (SELECT *, CASE WHEN weight > 0 THEN least(weight, 1) ELSE 1 END AS probability FROM f)")
    u = f"(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0)"
    return f"WITH {', '.join(ctes)} SELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(weight, 6)::DOUBLE AS weight, round(probability, 6)::DOUBLE AS probability, round(CASE WHEN weight > 0 THEN weight / probability ELSE 1 END, 6)::DOUBLE AS repeats, {u} < probability AS kept FROM e JOIN p USING (source, lang, topic)"


ORACLE = _oracle()

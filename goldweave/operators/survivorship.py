"""Golden records: which value of a cluster survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from goldweave.operators.normalize import SOURCE

# Fixed value: trust of a source nobody rated.
DEFAULT_TRUST = 0.5

RECENCY, SOURCE_PRIORITY, COMPLETENESS, MINIMUM, MAXIMUM = (
    "Recency", "Source Priority", "Completeness", "Min Value", "Max Value")
STRATEGIES = (RECENCY, SOURCE_PRIORITY, COMPLETENESS, MINIMUM, MAXIMUM)
FOLLOW_GLOBAL = "Follow Global"
MANUAL_REVIEW = "Manual Review"


def trust_of(trust: dict[str, float], source: str = SOURCE, default: float = DEFAULT_TRUST) -> Column:
    """Trust score of the record's source from a short mapping."""
    if not trust:
        return F.lit(float(default))
    scores = F.create_map(*[x for s, t in trust.items() for x in (F.lit(s), F.lit(float(t)))])
    return F.coalesce(F.try_element_at(scores, F.col(source)), F.lit(float(default)))


def percent_trust(score: Column) -> Column:
    """Trust entered on a 1–100 scale as a ratio."""
    return score / 100.0


def trust_level(score: Column) -> Column:
    """Fixed values on the 1–100 scale: from 80 high, from 50 medium, else low."""
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def descending(df: DataFrame, column: str) -> Column:
    """A key whose largest value belongs to the smallest ``column``: numbers are negated, texts
    become negated code points with an end mark above them all."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return -F.col(column)
    if isinstance(kind, StringType):
        codes = F.transform(F.split(F.col(column), ""), lambda ch: -F.ascii(ch))
        return F.concat(codes, F.array(F.lit(1)))
    return -F.unix_micros(F.col(column).cast("timestamp"))


def filled_fields(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def golden_rows(df: DataFrame, cluster: str, record_id: str, trust: str | None = None,
                recency: str | None = None, completeness: list[str] | None = None,
                lowest: list[str] | None = None) -> DataFrame:
    """The best record per cluster: trust, then recency, then filled fields, then lowest values,
    then smallest record id.

    One aggregate with map-side combine: a cluster that holds a third of the records reaches
    the shuffle as one row per task, and no task sorts a whole cluster.
    """
    keys = [F.col(c) for c in (trust, recency) if c]
    if completeness:
        keys.append(filled_fields(completeness))
    keys += [descending(df, c) for c in [*(lowest or []), record_id]]
    others = [c for c in df.columns if c != cluster]
    best = F.max_by(F.struct(*others), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return df.groupBy(cluster).agg(best.alias("_best")).select(cluster, *[F.col(f"_best.{c}").alias(c) for c in others])


def _strategy_key(df: DataFrame, strategy: str, attribute: str, trust: str | None, recency: str | None) -> Column:
    if strategy == RECENCY and recency:
        return F.col(recency)
    if strategy == SOURCE_PRIORITY and trust:
        return F.col(trust)
    if strategy == COMPLETENESS:
        return F.length(F.col(attribute).cast("string"))
    if strategy == MAXIMUM:
        return F.col(attribute)
    if strategy == MINIMUM:
        return descending(df, attribute)
    raise ValueError(f"strategy {strategy!r} is unknown or lacks its column; known: {STRATEGIES}")


def _ranking(df: DataFrame, attribute: str, rule: dict, trust: str | None, recency: str | None) -> list[Column]:
    chain = [rule["primary"]]
    if rule.get("fallback") and rule["fallback"] != MANUAL_REVIEW:
        chain.append(rule["fallback"])
    return [_strategy_key(df, s, attribute, trust, recency) for s in chain]


def _rules(attributes: list[str], global_rule: dict, overrides: list[dict] | None) -> dict[str, dict]:
    rules = {a: global_rule for a in attributes}
    for o in overrides or []:
        if o["attr"] not in rules:
            raise ValueError(f"override for an unknown attribute {o['attr']!r}")
        if o["primary"] != FOLLOW_GLOBAL:
            rules[o["attr"]] = o
    return rules


def golden_fields(df: DataFrame, cluster: str, record_id: str, attributes: list[str], global_rule: dict,
                  overrides: list[dict] | None = None, trust: str | None = None, recency: str | None = None,
                  source: str | None = None) -> DataFrame:
    """The best non-null value per attribute and cluster.

    A rule is ``{primary, fallback}``; ties end at the smallest record id. With the fallback
    ``Manual Review`` a tie between different values yields null and ``<attr>_review`` true.
    With ``source`` set, ``<attr>_record`` and ``<attr>_source`` name the supplier of the value.
    All attributes share one shuffle, whatever their rules.
    """
    aggregates: list[Column] = []
    result: list[Column] = [F.col(cluster)]
    for attr, rule in _rules(attributes, global_rule, overrides).items():
        ranking = [k.alias(f"r{i}") for i, k in enumerate(_ranking(df, attr, rule, trust, recency))]
        known = F.col(attr).isNotNull()
        key = F.when(known, F.struct(*ranking, descending(df, record_id).alias("id")))
        payload = [F.col(attr).alias("value"), F.col(record_id).alias("record")]
        if source:
            payload.append(F.col(source).alias("source"))
        aggregates.append(F.max_by(F.struct(*payload), key).alias(f"_w_{attr}"))
        value = F.col(f"_w_{attr}.value")
        if rule.get("fallback") == MANUAL_REVIEW:
            # Largest and smallest value among the top-ranked records differ: a tie to look at.
            top = F.max(F.when(known, F.struct(*ranking, F.col(attr).alias("value"))))
            low = F.max_by(attr, F.when(known, F.struct(*ranking, descending(df, attr).alias("value"))))
            aggregates += [top["value"].alias(f"_t_{attr}"), low.alias(f"_l_{attr}")]
            tied = F.coalesce(F.col(f"_t_{attr}") != F.col(f"_l_{attr}"), F.lit(False))
            result += [F.when(~tied, value).alias(attr), tied.alias(f"{attr}_review")]
        else:
            result.append(value.alias(attr))
        if source:
            result += [F.col(f"_w_{attr}.record").alias(f"{attr}_record"),
                       F.col(f"_w_{attr}.source").alias(f"{attr}_source")]
    return df.groupBy(cluster).agg(*aggregates).select(*result)


def golden_lineage(df: DataFrame, cluster: str, record_id: str, attributes: list[str], global_rule: dict,
                   overrides: list[dict] | None = None, trust: str | None = None, recency: str | None = None,
                   source: str = SOURCE) -> DataFrame:
    """Which record supplied each golden value: ``cluster, attribute, value, record_id, source``."""
    wide = golden_fields(df, cluster, record_id, attributes, global_rule, overrides, trust, recency, source)
    cells = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"),
                      F.col(f"{a}_record").alias(record_id), F.col(f"{a}_source").alias("source")) for a in attributes]
    return wide.select(cluster, F.inline(F.array(*cells))).filter(F.col(record_id).isNotNull())


def golden_preview(df: DataFrame, cluster: str, record_id: str, attributes: list[str], global_rule: dict,
                   overrides: list[dict] | None = None, trust: str | None = None, recency: str | None = None,
                   source: str = SOURCE) -> DataFrame:
    """Attribute by source: each source's best value and whether it wins in the cluster.

    The per-source values are reduced first; the winner comes from the same reduction one
    level up, so nothing grows with the records of a cluster but the partial aggregates.
    """
    both = df.withColumn("_cs", F.struct(cluster, source))
    by_source = golden_fields(both, "_cs", record_id, attributes, global_rule, overrides, trust, recency, source)
    cells = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"),
                      F.col(f"{a}_record").alias("_record")) for a in attributes]
    long = by_source.select(F.col(f"_cs.{cluster}").alias(cluster), F.col(f"_cs.{source}").alias(source),
                            F.inline(F.array(*cells))).filter(F.col("_record").isNotNull())
    winners = golden_lineage(df, cluster, record_id, attributes, global_rule, overrides, trust, recency, source)
    won = winners.select(cluster, "attribute", F.col(record_id).alias("_record"), F.lit(True).alias("_won"))
    return (long.join(won, [cluster, "attribute", "_record"], "left")
            .select(cluster, "attribute", source, "value", F.coalesce("_won", F.lit(False)).alias("is_winner")))


def compose(df: DataFrame, choices: DataFrame, cluster: str, record_id: str, attributes: list[str],
            source: str = SOURCE) -> DataFrame:
    """A steward's golden record: per attribute the chosen source's value.

    ``choices`` has ``cluster, attribute, source``. An attribute without a choice takes the
    cluster's first record; a chosen source without a value yields null. The first record per
    source is reduced before sources are put side by side, so a cluster is as wide as its
    sources, not as its records.
    """
    first = F.min_by(F.struct(*attributes), F.col(record_id))
    # A record without a source can be the cluster's first record, but nobody can choose it by source.
    per_source = df.groupBy(cluster, source).agg(first.alias("r"), F.min(record_id).alias("first_id"))
    named = F.when(F.col(source).isNotNull(), F.struct(F.col(source), F.col("r")))
    wide = per_source.groupBy(cluster).agg(
        F.map_from_entries(F.collect_list(named)).alias("by_source"),
        F.min_by(F.col("r"), F.col("first_id")).alias("first"))
    picked = choices.groupBy(cluster).agg(
        *[F.max(F.when(F.col("attribute") == a, F.col(source))).alias(f"_c_{a}") for a in attributes])
    out = wide.join(picked, cluster, "left")
    values = [F.when(F.col(f"_c_{a}").isNull(), F.col(f"first.{a}"))
              .otherwise(F.try_element_at("by_source", F.col(f"_c_{a}"))[a]).alias(a) for a in attributes]
    return out.select(cluster, *values)

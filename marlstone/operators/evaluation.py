"""Metrics per caption, scorecards, and the gate against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from marlstone.functions import text as T
from marlstone.functions import vocab as V
from marlstone.operators.contradiction import with_contradictions


def coverage(final: Column, raw_tags: Column, expected: Column) -> Column:
    """struct<recall, hits, total, missed>; null without expected tags."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(final, F.lit("")), F.coalesce(raw_tags, F.lit(""))))
    missed = F.filter(expected, lambda t: ~T.tag_present(t, hay))
    hits, total = F.size(expected) - F.size(missed), F.size(expected)
    return F.when(total > 0, F.struct((hits / total).alias("recall"), hits.alias("hits"), total.alias("total"), missed.alias("missed")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds metric columns to caption results (raw_tags, raw_prose, caption_variants, final_caption, removed_phrases).

    Optional columns: target_backend, token_budget_override, expected_tags,
    image_vector and text_vector, error. Adds checked, count, rate, details, budget,
    tokens_/over_ training and zeroshot, any_over, removed, kept, redundancy,
    coverage, clip.
    """
    has = set(df.columns)
    backend = F.coalesce(F.col("target_backend"), F.lit("")) if "target_backend" in has else F.lit("")
    override = F.col("token_budget_override") if "token_budget_override" in has else F.lit(None).cast("int")
    df = with_contradictions(df).withColumn("budget", T.budget_of(backend, override))
    for v in ("training", "zeroshot"):
        df = df.withColumn(f"tokens_{v}", T.tokens(F.coalesce(F.try_element_at("caption_variants", F.lit(v)), F.lit("")), backend))
        df = df.withColumn(f"over_{v}", F.col(f"tokens_{v}") > F.col("budget"))
    kept, removed = F.size(T.tag_list(F.col("final_caption"))), F.size("removed_phrases")
    expected = F.col("expected_tags") if "expected_tags" in has else V.empty()
    clip = cosine(F.col("image_vector"), F.col("text_vector")) if {"image_vector", "text_vector"} <= has else F.lit(None).cast("double")
    return df.select(
        "*", (F.col("over_training") | F.col("over_zeroshot")).alias("any_over"),
        removed.alias("removed"), kept.alias("kept"), F.when(removed + kept > 0, removed / (removed + kept)).otherwise(0.0).alias("redundancy"),
        coverage(F.col("final_caption"), F.col("raw_tags"), expected).alias("coverage"), clip.alias("clip"),
    )


def scorecard(metrics: DataFrame) -> DataFrame:
    """One row: means and shares over rows without error; counts of rows, labelled rows and errors."""
    ok = F.col("error").isNull() if "error" in metrics.columns else F.lit(True)
    if "error" not in metrics.columns:
        metrics = metrics.withColumn("error", F.lit(None).cast("string"))

    def pct(c: str | Column) -> Column:
        return F.avg(F.when(ok, F.col(c).cast("int") if isinstance(c, str) else c.cast("int")))

    return metrics.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.col("coverage.recall")).alias("n_labelled"), F.count("error").alias("n_errors"),
        F.avg(F.when(ok, F.col("rate"))).alias("contradiction_rate_mean"), F.sum(F.when(ok, F.col("count"))).alias("contradiction_total"),
        pct(F.col("count") > 0).alias("items_with_contradiction_pct"), pct("over_training").alias("over_budget_pct_training"),
        pct("over_zeroshot").alias("over_budget_pct_zeroshot"), F.avg(F.when(ok, F.col("redundancy"))).alias("redundancy_mean"),
        F.avg(F.when(ok, F.col("coverage.recall"))).alias("coverage_recall_mean"), F.avg(F.when(ok, F.col("clip"))).alias("clip_mean"),
    )


def flattened(card: DataFrame) -> DataFrame:
    """A recorded scorecard with nested metrics (``over_budget_pct.training``) as columns (``over_budget_pct_training``).

    Metrics may stand in a struct ``aggregates``; what isn't a number is null.
    """
    if "aggregates" in card.columns and isinstance(card.schema["aggregates"].dataType, Ty.StructType):
        card = card.select("aggregates.*")

    def leaves(of: Ty.StructType, path: tuple[str, ...] = ()) -> list[Column]:
        out = []
        for f in of.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, Ty.StructType):
                out += leaves(f.dataType, at)
            else:
                number = isinstance(f.dataType, (Ty.NumericType, Ty.BooleanType))
                value = F.col(".".join(f"`{x}`" for x in at)) if number else F.lit(None)
                out.append(value.cast("double").alias("_".join(at)))
        return out

    return card.select(leaves(card.schema))


def long_form(card: DataFrame) -> DataFrame:
    """(metric, value) of the gate's metrics in a scorecard."""
    have = [m for m in V.GATE if m in card.columns]
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in have)
    return card.selectExpr(f"stack({len(have)}, {pairs}) as (metric, value)")


def compare(card: DataFrame, baseline: DataFrame, tolerance: float = V.TOLERANCE) -> DataFrame:
    """(metric, value, baseline, delta, regressed, improved) for metrics that both have."""
    met = long_form(card).join(long_form(baseline).withColumnRenamed("value", "baseline"), "metric").filter("value is not null and baseline is not null")
    delta = F.col("value") - F.col("baseline")
    worse = F.when(V.lookup(V.GATE, F.col("metric")) == "lower", delta).otherwise(-delta)
    return met.select("metric", "value", "baseline", delta.alias("delta"), (worse > tolerance).alias("regressed"), (worse < -tolerance).alias("improved"))


def passes(card: DataFrame, baseline: DataFrame | None = None, tolerance: float = V.TOLERANCE) -> bool:
    """False if every row failed, or a metric got worse than the baseline by more than the tolerance."""
    n, errors = card.select("n", "n_errors").first()
    if n == errors:
        return False
    return baseline is None or compare(card, baseline, tolerance).filter("regressed").isEmpty()


def report(card: DataFrame) -> DataFrame:
    """(line) of a readable scorecard."""
    return long_form(card).select(F.format_string("%-32s %s", "metric", F.coalesce(F.format_string("%.3f", "value"), F.lit("n/a"))).alias("line"))


def comparison_report(compared: DataFrame) -> DataFrame:
    """(pos, line): a readable comparison with a baseline, metrics in the gate's order, the verdict last."""
    order = F.lit(list(V.GATE))
    mark = F.when(F.col("regressed"), "\u2717").when(F.col("improved"), "\u2713").otherwise(" ")
    text = F.format_string("  %s %s: %.3f \u2192 %.3f (%+.3f)", mark, "metric", "baseline", "value", "delta")
    lines = compared.select(F.array_position(order, F.col("metric")).alias("pos"), text.alias("line"))
    verdict = F.when(F.coalesce(F.bool_or("regressed"), F.lit(False)), "  verdict: REGRESSED").otherwise("  verdict: OK")
    return lines.unionByName(compared.agg(verdict.alias("line")).select(F.lit(len(V.GATE) + 1).cast("bigint").alias("pos"), "line"))

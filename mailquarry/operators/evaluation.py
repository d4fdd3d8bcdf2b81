"""Scores of predictions against labels; duplicates and leaks between evaluation and training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("phishing", "legitimate", "review", "error", "missing")


def matched(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """labels left-joined to predictions by id; what is not predicted is ``missing``, an unknown value ``error``."""
    p = predictions.select("id", "prediction")
    value = F.when(F.col("prediction").isNull(), "missing").when(F.col("prediction").isin(*OUTCOMES), F.col("prediction")).otherwise("error")
    return labels.select("id", "label").join(p, "id", "left").withColumn("outcome", value)


def rejected_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, reason) of predictions without a label or given twice."""
    unknown = predictions.join(labels.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("reason")).distinct()
    twice = predictions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("reason"))
    return unknown.unionByName(twice)


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """A row for each label, a column for each outcome; zeros stay."""
    return pairs.groupBy("label").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def metrics(pairs: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy, recall, precision and false positive rate; null where nothing can be divided by.

    Review, error and missing count in the denominators.
    """
    n = lambda label, outcome=None: F.count_if((F.col("label") == label) & (F.lit(True) if outcome is None else F.col("outcome") == outcome)).cast("double")
    counts = pairs.agg(n("phishing").alias("p"), n("legitimate").alias("l"), n("phishing", "phishing").alias("tp"), n("legitimate", "phishing").alias("fp"), n("legitimate", "legitimate").alias("tn"))
    ratio = lambda a, b: F.try_divide(a, b)
    recall, specificity = ratio(F.col("tp"), F.col("p")), ratio(F.col("tn"), F.col("l"))
    return counts.select(
        ratio(F.col("tp") + F.col("tn"), F.col("p") + F.col("l")).alias("accuracy"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        recall.alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("fp"), F.col("l")).alias("false_positive_rate"),
    )


def field_correctness(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Share of right values for each semantic field: (field, correct, total, share) from (id, field, value) rows."""
    both = expected.join(got.withColumnRenamed("value", "_got"), ["id", "field"], "left")
    return both.groupBy("field").agg(F.count_if(F.col("value").eqNullSafe(F.col("_got"))).alias("correct"), F.count("*").alias("total")).withColumn("share", F.col("correct") / F.col("total"))


def latency(predictions: DataFrame) -> DataFrame:
    """Median seconds of the predictions that took any, and how many did: counts by value, then the middle of them."""
    t = predictions.where(F.col("seconds") > 0).groupBy("seconds").count()
    return t.agg(F.expr("percentile(seconds, 0.5, count)").alias("median_seconds"), F.coalesce(F.sum("count"), F.lit(0)).alias("timed"))


def grounded_rate(quotations: DataFrame) -> DataFrame:
    """Share of quotations that stand in their text: (quoted, grounded, share) of (quotation, text) rows; empty ones don't count."""
    from mailquarry.functions.text import evidence_form

    q = quotations.where(F.length(F.trim("quotation")) > 0)
    hit = F.contains(evidence_form(F.col("text")), evidence_form(F.col("quotation")))
    return q.agg(F.count("*").alias("quoted"), F.count_if(hit).alias("grounded")).withColumn("share", F.try_divide(F.col("grounded").cast("double"), F.col("quoted")))


def duplicates(rows: DataFrame, exact: Column, folded: Column, order: Column) -> DataFrame:
    """duplicate_of: the first row with the same bytes, else the first with the same folded content; null for firsts."""
    out = rows.withColumn("_e", exact).withColumn("_f", folded).withColumn("_o", order)
    for key, first in (("_e", "_fe"), ("_f", "_ff")):  # partial minima, so that a common text is never one task
        least = out.groupBy(key).agg(F.min("_o").alias(first), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        out = out.join(least, key, "left")
    kind = F.when(F.col("_fe") < F.col("_o"), "exact").when(F.col("_ff") < F.col("_o"), "content")
    return out.withColumn("duplicate_kind", kind).withColumn("duplicate_of", F.when(kind == "exact", F.col("_fe")).when(kind == "content", F.col("_ff"))).drop("_e", "_f", "_o", "_fe", "_ff")


def contained(passages: DataFrame, texts: DataFrame, least: int = 120, words: int = 4) -> DataFrame:
    """(item_id, doc_id) of texts that hold a passage of ``least`` characters or more word for word.

    Wherever a passage stands, its words but the first and the last stand
    between the same white space, so the text has the hash of its second to
    fifth word: an equi join, and only what it finds is compared in full. A
    passage with fewer than six words is compared with every text.
    """
    p = passages.where(F.length("text") >= least).select("item_id", F.col("text").alias("passage"), F.split("text", r"\s+").alias("w"))
    t = texts.where(F.length("text") >= least).select("doc_id", "text")
    many = p.where(F.size("w") >= words + 2).select("item_id", "passage", F.xxhash64(*(F.get("w", F.lit(k + 1)) for k in range(words))).alias("h"))
    w = F.split("text", r"\s+")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(words))))
    pairs = t.withColumn("w", w).where(F.size("w") >= words).select("doc_id", F.explode(F.array_distinct(grams)).alias("h")).join(many.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    found = pairs.join(t, "doc_id").join(many.select("item_id", "passage"), "item_id")  # texts travel once for each pair, not with each gram
    few = p.where(F.size("w") < words + 2).select("item_id", "passage", F.xxhash64(F.left("passage", F.lit(least))).alias("h"))
    asked = few.limit(1).count()
    hit = found.where(F.contains("text", "passage")).select("item_id", "doc_id")
    if not asked:
        return hit.distinct()
    # a passage of few words is long words: its first ``least`` characters stand somewhere in the text
    starts = F.transform(F.sequence(F.lit(1), F.length("text") - least + 1), lambda i: F.xxhash64(F.substring("text", i, F.lit(least))))
    near = t.select("doc_id", F.explode(F.array_distinct(starts)).alias("h")).join(few.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    rest = near.join(t, "doc_id").join(few.select("item_id", "passage"), "item_id").where(F.contains("text", "passage"))
    return hit.unionByName(rest.select("item_id", "doc_id")).distinct()


def performance_summary(calls: DataFrame, by: str = "msg_id") -> DataFrame:
    """Calls, generated tokens and seconds of each message's model calls; nulls count as 0."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))

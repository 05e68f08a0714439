"""Registered queries for ticket text and relabelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultcast.operators import text as tx
from faultcast.operators.metrics import binary_metrics, category_shift, confidence_bands, resolution_breakdown
from faultcast.operators.splits import stratified_folds
from faultcast.plans.queries import query
from faultcast.sources import fixtures as fx

# Fixed values of the fixture run: keyword rules on the stand-in texts, scope and threshold.
FX_RULES = [("lich", "C1"), ("ción", "C2")]
FX_SCOPE = ["C1", "C2", fx.GENERIC]
FX_CATEGORIES = ["C1", "C2", "C3", fx.GENERIC]
FX_PROBS = {c: f"p_{c}" for c in fx.PROB_CLASSES}
THRESHOLD = 0.8


def classified(spark, sf_dir):
    """M5 decision stage on FX9 (given probabilities)."""
    return tx.classify_tickets(fx.ticket_probs(spark, sf_dir), FX_PROBS, scope=FX_SCOPE, rules=FX_RULES,
                               generic=fx.GENERIC, threshold=THRESHOLD)


@query("combine_text")
def q_combine_text(spark, sf_dir):
    """both text columns joined with one space (NULL -> ''), as its length and a digest."""
    t = fx.ticket_text(spark, sf_dir)
    c = tx.combine_text("text", "text2")
    return t.select("ticket_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


@query("keyword_rules")
def q_keyword_rules(spark, sf_dir):
    """First matching keyword rule per ticket."""
    t = fx.ticket_text(spark, sf_dir)
    kw = tx.keyword_rules(tx.combine_text("text", "text2"), FX_RULES)
    return t.select("ticket_id", kw["label"].alias("keyword_label"), kw["confidence"].alias("keyword_confidence"))


@query("row_argmax")
def q_row_argmax(spark, sf_dir):
    """Most probable class and its probability (first wins ties)."""
    t = fx.ticket_probs(spark, sf_dir)
    p = tx.row_argmax(FX_PROBS)
    return t.select("ticket_id", p["label"].alias("model_label"), p["confidence"].alias("model_confidence"))


@query("resolve_label")
def q_resolve_label(spark, sf_dir):
    """final unit and confidence for every ticket."""
    t = fx.ticket_probs(spark, sf_dir)
    kw = tx.keyword_rules(tx.combine_text("text", "text2"), FX_RULES)
    r = tx.resolve_label(F.col("unit"), kw, tx.row_argmax(FX_PROBS), fx.GENERIC, THRESHOLD)
    return t.select("ticket_id", r["label"].alias("final_unit"), r["confidence"].alias("final_confidence"))


@query("explain")
def q_explain(spark, sf_dir):
    """the note written next to each decision."""
    t = fx.ticket_probs(spark, sf_dir)
    kw = tx.keyword_rules(tx.combine_text("text", "text2"), FX_RULES)
    return t.select("ticket_id", tx.explain(F.col("unit"), kw, tx.row_argmax(FX_PROBS), fx.GENERIC).alias("details"))


@query("update_subset")
def q_update_subset(spark, sf_dir):
    """P11 (the whole M5 decision stage): in-scope rows relabelled, others untouched."""
    return classified(spark, sf_dir).select("ticket_id", "unit_before", "unit", "confidence", "details",
                                            "keyword_label", "model_label", "model_confidence")


def _in_scope(spark, sf_dir):
    return classified(spark, sf_dir).filter(F.col("unit_before").isin(FX_SCOPE))


@query("category_shift")
def q_category_shift(spark, sf_dir):
    """A6 (+F22): category counts before and after relabelling."""
    return category_shift(_in_scope(spark, sf_dir), "unit_before", "unit", FX_CATEGORIES)


@query("confidence_bands")
def q_confidence_bands(spark, sf_dir):
    """Confidence bands over all in-scope tickets and over generic ones."""
    return confidence_bands(_in_scope(spark, sf_dir), "confidence", F.col("unit_before") == fx.GENERIC)


@query("resolution_breakdown")
def q_resolution_breakdown(spark, sf_dir):
    """How generic tickets were resolved."""
    return resolution_breakdown(_in_scope(spark, sf_dir), "unit_before", "unit", "keyword_label", fx.GENERIC)


@query("tfidf")
def q_tfidf(spark, sf_dir):
    """M1: TF-IDF (top 5000 terms, smoothed idf, L2 norm) over every ticket's whole text."""
    t = fx.ticket_text(spark, sf_dir)
    return tx.tfidf(t, "ticket_id", tx.combine_text("text", "text2"), 5000)


def specific_folds(spark, sf_dir):
    t = fx.ticket_probs(spark, sf_dir).filter(F.col("unit").isin(list(fx.SPECIFIC)))
    return stratified_folds(t, "ticket_id", "unit", 5)


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    """M3: class-balanced fold ids of the specific tickets."""
    return specific_folds(spark, sf_dir).select("ticket_id", "unit", "fold")


@query("binary_metrics")
def q_binary_metrics(spark, sf_dir):
    """Per class one-vs-rest precision/recall/F1 over the 5 folds (prediction = p >= 0.5)."""
    f = specific_folds(spark, sf_dir)
    stacked = f.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col("unit") == c).cast("int").alias("y"),
                 (F.col(f"p_{c}") >= 0.5).cast("int").alias("y_pred")) for c in fx.PROB_CLASSES])).alias("s"))
    return binary_metrics(stacked.select("fold", "s.*"), keys=["class"])

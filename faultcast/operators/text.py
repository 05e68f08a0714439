"""Ticket text operators (F15-F20, M1) and the relabelling decision.

Everything is a built-in expression; the only per-row work is regex
tokenisation inside the JVM. TF-IDF counts words once for a vocabulary of
bounded size and then weighs every document for itself, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultcast.functions.scalars import round_even

DEFAULT_THRESHOLD = 0.8
# Token pattern equivalent to two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def combine_text(*cols) -> Column:
    """join with one space, NULL -> '' (the separator is kept even when a part is NULL)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def keyword_rules(text: Column, rules) -> Column:
    """Case-insensitive substring rules, first hit wins -> struct(label, confidence)."""
    low = F.lower(text)
    label = None
    for kw, lab in rules:
        cond = F.contains(low, F.lit(kw.lower()))
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
    return F.struct(label.alias("label"), F.when(label.isNotNull(), F.lit(1.0)).alias("confidence"))


def row_argmax(prob_cols: dict[str, str]) -> Column:
    """T4 (+F20): name and value of the largest probability; the first column wins ties.

    ``prob_cols`` maps label -> column, in priority order.
    """
    best = F.greatest(*[F.col(c) for c in prob_cols.values()])
    label = None
    for lab, c in prob_cols.items():
        cond = F.col(c) == best
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
    return F.struct(label.alias("label"), best.alias("confidence"))


def resolve_label(unit: Column, kw: Column, pred: Column, generic: str,
                  threshold: float = DEFAULT_THRESHOLD) -> Column:
    """keep specific units (confidence 1); generic -> keyword rule, else the model label when
    its probability >= threshold, else stay generic with the model's probability."""
    label = (F.when(unit != generic, unit)
             .when(kw["label"].isNotNull(), kw["label"])
             .when(pred["confidence"] >= threshold, pred["label"])
             .otherwise(F.lit(generic)))
    conf = (F.when(unit != generic, F.lit(1.0))
            .when(kw["label"].isNotNull(), kw["confidence"])
            .otherwise(pred["confidence"]))
    return F.struct(label.alias("label"), conf.alias("confidence"))


def explain(unit: Column, kw: Column, pred: Column, generic: str) -> Column:
    """'' for specific units, the rule hit, or the model label with its probability in percent."""
    pct = F.format_string("%.1f%%", round_even(pred["confidence"] * 100.0, 1))
    return (F.when(unit != generic, F.lit(""))
            .when(kw["label"].isNotNull(), F.concat(F.lit("keyword rule: "), kw["label"]))
            .otherwise(F.concat(F.lit("model: "), pred["label"], F.lit(" ("), pct, F.lit(")"))))


def classify_tickets(df: DataFrame, prob_cols: dict[str, str], rules, generic: str, unit_col: str = "unit",
                     text_cols=("text", "text2"), scope=None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """M5 decision stage on scored tickets: F15 -> F17 -> T4 -> F18 -> F19 -> P11, one pass.

    Rows in ``scope`` (the specific units plus the generic one) get the new
    unit, a confidence and a note; the others keep their unit with NULL
    confidence and an empty note. The original unit is kept as ``unit_before``.
    """
    from faultcast.operators.columns import update_subset

    scope = list(scope) if scope is not None else [*prob_cols.keys(), generic]
    u = F.col(unit_col)
    kw = keyword_rules(combine_text(*text_cols), rules)
    pred = row_argmax(prob_cols)
    res = resolve_label(u, kw, pred, generic, threshold)
    staged = df.select("*", u.alias("unit_before"), kw.alias("_kw"), pred.alias("_pred"), res.alias("_res"))
    in_scope = F.col("unit_before").isin(scope)
    out = update_subset(
        staged, in_scope,
        {unit_col: F.col("_res.label"), "confidence": F.col("_res.confidence"),
         "details": explain(F.col("unit_before"), F.col("_kw"), F.col("_pred"), generic),
         "keyword_label": F.col("_kw.label"), "model_label": F.col("_pred.label"),
         "model_confidence": F.col("_pred.confidence")},
        {"confidence": F.lit(None).cast("double"), "details": F.lit(""), "keyword_label": F.lit(None).cast("string"),
         "model_label": F.lit(None).cast("string"), "model_confidence": F.lit(None).cast("double")})
    return out.drop("_kw", "_pred", "_res")


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased word tokens of two or more characters (whole text, no truncation)."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def vocabulary(df: DataFrame, text: Column, max_features: int = 5000) -> tuple[int, list[tuple[str, int]]]:
    """Number of rows, and (term, rows that hold it) of the ``max_features`` terms with the highest corpus count.

    One pass, one shuffle by term with map-side combine: each row gives out its
    sorted tokens, marking the first of equal ones, and one NULL for itself.
    The list is bounded by ``max_features``; term text breaks ties.
    """
    t = df.select(F.array_sort(tokens(text)).alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).alias("opens")))
    row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(False).alias("opens")))
    c = t.select(F.inline(F.concat(row, marked))).groupBy("term").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("opens").alias("df"))
    top = c.orderBy(F.col("term").isNull().desc(), F.col("total").desc(), F.col("term").asc()).limit(max_features + 1).collect()
    if not top:
        return 0, []
    return top[0]["total"], [(r["term"], r["df"]) for r in top[1:]]


def tfidf(df: DataFrame, id_col: str, text: Column, max_features: int = 5000) -> DataFrame:
    """M1: TF-IDF with smoothed idf = ln((1+n)/(1+df)) + 1 and L2 norm, long form (doc, term, tfidf).

    Two passes: :func:`vocabulary`, then every row for itself: token counts
    against the vocabulary (a hashed look-up in the JVM), weights and norm as one
    sparse vector, exploded at the end. Nothing is shuffled by document and
    nothing but the vocabulary (at most ``max_features`` terms) leaves the tasks.
    """
    import math

    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    n, terms = vocabulary(df, text, max_features)
    if not terms:
        return df.select(F.col(id_col), F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).filter(F.lit(False))
    idf = Vectors.dense([math.log((n + 1) / (d + 1)) + 1.0 for _, d in terms])
    x = df.select(F.col(id_col), tokens(text).alias("_tokens"))
    x = CountVectorizerModel.from_vocabulary([t for t, _ in terms], inputCol="_tokens", outputCol="_tf").transform(x)
    x = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w").transform(x)
    x = Normalizer(p=2.0, inputCol="_w", outputCol="_unit").transform(x)
    v = F.unwrap_udt("_unit")
    names = F.array(*[F.lit(t) for t, _ in terms])
    return x.select(id_col, F.inline(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("w")))).select(
        id_col, F.get(names, F.col("i")).alias("term"), F.col("w").alias("tfidf"))

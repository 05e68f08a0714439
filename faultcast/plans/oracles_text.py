"""SQL oracles for ticket text and relabelling."""

from __future__ import annotations

from faultcast.operators.metrics import CONF_BANDS
from faultcast.plans.oracles import oracle, r6, with_
from faultcast.plans.queries_text import FX_CATEGORIES, FX_RULES, FX_SCOPE, THRESHOLD
from faultcast.sources import fixtures as fx

G = fx.GENERIC


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def cte_fx5():
    return ("fx5", f"""SELECT d.doc_id AS ticket_id,
  CASE WHEN l.toxic = 1 THEN 'C3' WHEN l.quality = 1 THEN 'C1' WHEN l.quality = 0 THEN 'C2' ELSE {_q(G)} END AS unit,
  d.text, d.source AS text2
FROM documents d LEFT JOIN labels l USING (doc_id)""")


def hash_unit_sql(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5({key}::VARCHAR || '|{salt}'), 1, 8))::BIGINT % 1000) / 1000.0)"


def cte_fx9():
    probs = ", ".join(f"{hash_unit_sql('ticket_id', c)} AS p_{c}" for c in fx.PROB_CLASSES)
    return [cte_fx5(), ("fx9", f"SELECT *, {probs} FROM fx5")]


COMBINED = "concat_ws(' ', coalesce(text, ''), coalesce(text2, ''))"


def kw_sql(text: str) -> str:
    parts = " ".join(f"WHEN contains(lower({text}), {_q(k.lower())}) THEN {_q(lab)}" for k, lab in FX_RULES)
    return f"CASE {parts} END"


def cte_cls():
    cls = [c for c in fx.PROB_CLASSES]
    best = f"greatest({', '.join('p_' + c for c in cls)})"
    arg = "CASE " + " ".join(f"WHEN p_{c} = best THEN '{c}'" for c in cls[:-1]) + f" ELSE '{cls[-1]}' END"
    scope = ", ".join(_q(s) for s in FX_SCOPE)
    base = f"SELECT * EXCLUDE (unit), unit AS u0, {kw_sql(COMBINED)} AS kw, {best} AS best FROM fx9"
    pct = "printf('%.1f%%', round_even((best * 100.0) * 10.0, 0) / 10.0)"
    body = f"""SELECT ticket_id, u0 AS unit_before, text, text2, p_C1, p_C2, p_C3, kw, best, pl,
  CASE WHEN u0 IN ({scope}) THEN
    CASE WHEN u0 != {_q(G)} THEN u0 WHEN kw IS NOT NULL THEN kw WHEN best >= {THRESHOLD} THEN pl ELSE {_q(G)} END
  ELSE u0 END AS unit,
  CASE WHEN u0 IN ({scope}) THEN CASE WHEN u0 != {_q(G)} THEN 1.0 WHEN kw IS NOT NULL THEN 1.0 ELSE best END END AS confidence,
  CASE WHEN u0 IN ({scope}) THEN
    CASE WHEN u0 != {_q(G)} THEN '' WHEN kw IS NOT NULL THEN 'keyword rule: ' || kw ELSE 'model: ' || pl || ' (' || {pct} || ')' END
  ELSE '' END AS details,
  CASE WHEN u0 IN ({scope}) THEN kw END AS keyword_label,
  CASE WHEN u0 IN ({scope}) THEN pl END AS model_label,
  CASE WHEN u0 IN ({scope}) THEN best END AS model_confidence
FROM (SELECT *, {arg} AS pl FROM ({base}) a) b"""
    return cte_fx9() + [("cls", body), ("insc", f"SELECT * FROM cls WHERE unit_before IN ({scope})")]


oracle("combine_text", with_([cte_fx5()], f"SELECT ticket_id, length({COMBINED}) AS n_chars, md5({COMBINED}) AS digest FROM fx5"))

oracle("keyword_rules", with_([cte_fx5()], f"""SELECT ticket_id, {kw_sql(COMBINED)} AS keyword_label,
  CASE WHEN {kw_sql(COMBINED)} IS NOT NULL THEN 1.0 END AS keyword_confidence FROM fx5"""))

oracle("row_argmax", with_(cte_cls(), f"SELECT ticket_id, pl AS model_label, {r6('best')} AS model_confidence FROM cls"))

oracle("resolve_label", with_(cte_cls(), f"""SELECT ticket_id,
  CASE WHEN unit_before != {_q(G)} THEN unit_before WHEN kw IS NOT NULL THEN kw WHEN best >= {THRESHOLD} THEN pl ELSE {_q(G)} END AS final_unit,
  {r6(f"CASE WHEN unit_before != {_q(G)} THEN 1.0 WHEN kw IS NOT NULL THEN 1.0 ELSE best END")} AS final_confidence FROM cls"""))

oracle("explain", with_(cte_cls(), f"""SELECT ticket_id,
  CASE WHEN unit_before != {_q(G)} THEN '' WHEN kw IS NOT NULL THEN 'keyword rule: ' || kw
  ELSE 'model: ' || pl || ' (' || printf('%.1f%%', round_even((best * 100.0) * 10.0, 0) / 10.0) || ')' END AS details FROM cls"""))

oracle("update_subset", with_(cte_cls(), f"""SELECT ticket_id, unit_before, unit, {r6('confidence')} AS confidence, details,
  keyword_label, model_label, {r6('model_confidence')} AS model_confidence FROM cls"""))

_cats = ", ".join(f"({_q(c)}, {i})" for i, c in enumerate(FX_CATEGORIES))
oracle("category_shift", with_(cte_cls() + [
    ("cats", f"SELECT * FROM (VALUES {_cats}) v(category, ord)"),
    ("agg", """SELECT category, sum(orig)::BIGINT AS original_n, sum(fin)::BIGINT AS final_n, sum(nw)::BIGINT AS new_n FROM (
  SELECT unit_before AS category, 1 AS orig, 0 AS fin, 0 AS nw FROM insc
  UNION ALL SELECT unit AS category, 0, 1, (unit != unit_before)::INTEGER FROM insc) s GROUP BY 1"""),
    ("tot", "SELECT count(*) AS total FROM insc")],
    f"""SELECT c.category, coalesce(final_n, 0) AS final_n, {r6('coalesce(final_n, 0) / total * 100.0')} AS final_pct,
  coalesce(original_n, 0) AS original_n, coalesce(new_n, 0) AS new_n, coalesce(final_n, 0) - coalesce(original_n, 0) AS net_change
FROM cats c LEFT JOIN agg USING (category) CROSS JOIN tot"""))

_band = "CASE " + " ".join(f"WHEN confidence >= {lo} AND confidence < {hi} THEN {_q(lab)}" for lab, lo, hi in CONF_BANDS) + " END"
_bl = ", ".join(f"({_q(lab)}, {i})" for i, (lab, _, _) in enumerate(CONF_BANDS))
oracle("confidence_bands", with_(cte_cls() + [
    ("bx", f"SELECT {_band} AS band, unit_before = {_q(G)} AS g FROM insc"),
    ("bagg", "SELECT band, count(*) AS n_all, count_if(g) AS n_generic FROM bx GROUP BY 1"),
    ("btot", "SELECT count(*) AS t_all, count_if(g) AS t_generic FROM bx"),
    ("blist", f"SELECT * FROM (VALUES {_bl}) v(band, ord)"),
    ("bj", "SELECT * FROM blist LEFT JOIN bagg USING (band) CROSS JOIN btot")],
    f"""SELECT 'all' AS scope, band, coalesce(n_all, 0) AS n, {r6('coalesce(n_all, 0) / t_all * 100.0')} AS pct FROM bj
UNION ALL SELECT 'generic', band, coalesce(n_generic, 0), {r6('CASE WHEN t_generic = 0 THEN NULL ELSE coalesce(n_generic, 0) / t_generic * 100.0 END')} FROM bj"""))

oracle("resolution_breakdown", with_(cte_cls() + [
    ("ra", f"""SELECT count_if(keyword_label IS NOT NULL) AS keyword,
  count_if(keyword_label IS NULL AND unit != {_q(G)}) AS model, count_if(unit = {_q(G)}) AS unresolved, count(*) AS total
FROM insc WHERE unit_before = {_q(G)}""")],
    f"""SELECT 'keyword' AS outcome, keyword AS n, {r6('keyword / total * 100.0')} AS pct FROM ra
UNION ALL SELECT 'model', model, {r6('model / total * 100.0')} FROM ra
UNION ALL SELECT 'unresolved', unresolved, {r6('unresolved / total * 100.0')} FROM ra"""))

oracle("tfidf", with_([cte_fx5(),
    ("tok", f"SELECT ticket_id, unnest(regexp_extract_all(lower({COMBINED}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM fx5"),
    ("tf", "SELECT ticket_id, term, count(*) AS tf FROM tok GROUP BY 1, 2"),
    ("vocab", "SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term ASC LIMIT 5000"),
    ("nd", "SELECT count(*) AS n_docs FROM fx5"),
    ("w", "SELECT ticket_id, term, tf * (ln((n_docs + 1) / (df + 1)) + 1.0) AS w FROM tf JOIN vocab USING (term) CROSS JOIN nd")],
    f"SELECT ticket_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY ticket_id))')} AS tfidf FROM w"))

_spec = ", ".join(_q(c) for c in fx.SPECIFIC)
_folds = ("folds", f"""SELECT *, ((row_number() OVER (PARTITION BY unit ORDER BY md5(ticket_id::VARCHAR), ticket_id) - 1) % 5)::BIGINT AS fold
FROM fx9 WHERE unit IN ({_spec})""")
oracle("stratified_folds", with_(cte_fx9() + [_folds], "SELECT ticket_id, unit, fold FROM folds"))

_st = " UNION ALL ".join(f"SELECT '{c}' AS class, fold, (unit = '{c}')::INTEGER AS y, (p_{c} >= 0.5)::INTEGER AS yp FROM folds"
                         for c in fx.PROB_CLASSES)
oracle("binary_metrics", with_(cte_fx9() + [_folds, ("st", _st),
    ("per", """SELECT class, fold, count_if(y = 1 AND yp = 1) AS tp, count_if(y = 0 AND yp = 1) AS fp,
  count_if(y = 1 AND yp = 0) AS fn FROM st GROUP BY 1, 2"""),
    ("pr", """SELECT class, fold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM per"""),
    ("pf", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr")],
    f"""SELECT class, count(*) AS n_folds, {r6('avg(precision)')} AS precision_mean, {r6('stddev_pop(precision)')} AS precision_std,
  {r6('avg(recall)')} AS recall_mean, {r6('stddev_pop(recall)')} AS recall_std,
  {r6('avg(f1)')} AS f1_mean, {r6('stddev_pop(f1)')} AS f1_std FROM pf GROUP BY class"""))

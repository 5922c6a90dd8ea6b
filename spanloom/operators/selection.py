"""Selections, templates and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import close_matches

#: The longest texts a fill may give.
MAX_PURPOSE, MAX_LABEL, MAX_NOTE = 240, 120, 240


def apply_selection_log(changes: DataFrame) -> DataFrame:
    """(instance, id, deep) after all changes (instance, change_no, op, id, deep); op is set, add, remove or clear.

    In one change, clear and set come first, then removals, then additions; a later addition updates deep.
    """
    cleared = changes.filter("op IN ('clear', 'set')").groupBy("instance").agg(F.max("change_no").alias("_from"))
    order = F.struct("change_no", F.when(F.col("op") == "remove", 0).otherwise(1))
    live = changes.filter("op <> 'clear'").join(cleared, "instance", "left").filter("_from IS NULL OR change_no >= _from")
    last = live.groupBy("instance", "id").agg(F.max_by(F.struct("op", "deep"), order).alias("l"))
    return last.filter("l.op <> 'remove'").select("instance", "id", "l.deep")


def template_status(templates: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """templates (template_id, id, deep) with status and up to three suggestions for ids that are missing."""
    if catalogue is None:
        return templates.withColumns({"status": F.lit("unknown"), "suggestions": F.array().cast("array<string>")})
    known = catalogue.select("id", F.lit(True).alias("_known")).distinct()
    missing = templates.select("id").distinct().join(known, "id", "left_anti")
    near = close_matches(missing, catalogue.select("id")).groupBy(F.col("word").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "match"))), lambda s: s["match"]).alias("suggestions"))
    out = templates.join(known, "id", "left").join(near, "id", "left")
    return out.withColumns({"status": F.when(F.col("_known"), "ok").otherwise("missing"), "suggestions": F.coalesce("suggestions", F.array().cast("array<string>"))}).drop("_known")


def expand_template(templates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """templates (template_id, functions array<struct<id, deep>>) -> (template_id, id, deep, resolved); unknown ids are passed on."""
    known = catalogue.select("id", F.lit(True).alias("_known")).distinct()
    rows = templates.select("template_id", F.inline("functions"))
    return rows.join(known, "id", "left").select("template_id", "id", "deep", F.coalesce("_known", F.lit(False)).alias("resolved"))


def selection_diff(current: DataFrame, applied: DataFrame) -> DataFrame:
    """(id, change): added, removed or mode_changed; no row means that nothing is dirty."""
    a, b = current.select("id", F.col("deep").alias("_new"), F.lit(True).alias("_a")), applied.select("id", F.col("deep").alias("_old"), F.lit(True).alias("_b"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_new") != F.col("_old"), "mode_changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).dropna(subset=["change"])


def validate_fills(skeleton: DataFrame, fills: DataFrame) -> DataFrame:
    """(function_id, problem) of fills (function_id, body_hash, purpose, step_id, label, note) against skeleton (function_id, body_hash, step_id, ...)."""
    known = skeleton.select("function_id", F.col("body_hash").alias("_hash")).distinct()
    heads = fills.select("function_id", "body_hash", "purpose").distinct().join(known, "function_id", "left")
    steps = fills.filter("step_id IS NOT NULL").join(skeleton.select("function_id", "step_id", F.lit(True).alias("_k")).distinct(), ["function_id", "step_id"], "left")
    problem = lambda df, cond, text: df.filter(cond).select("function_id", text.alias("problem"))
    out = problem(heads, F.col("_hash").isNull(), F.lit("function_id does not match"))
    out = out.union(problem(heads, F.col("_hash").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("body_hash")), F.lit("body_hash does not match the current code (stale fill)")))
    out = out.union(problem(heads, F.length("purpose") > MAX_PURPOSE, F.lit(f"purpose must be text up to {MAX_PURPOSE} characters")))
    out = out.union(problem(steps, F.col("_k").isNull(), F.concat(F.lit("unknown step id '"), "step_id", F.lit("' (the structure is locked)"))))
    for key, most in (("label", MAX_LABEL), ("note", MAX_NOTE)):
        out = out.union(problem(steps, F.col("_k") & (F.length(key) > most), F.concat(F.lit("step "), "step_id", F.lit(f": {key} must be text up to {most} characters"))))
    return out


def merge_fills(skeleton: DataFrame, fills: DataFrame) -> DataFrame:
    """skeleton (function_id, body_hash, step_id, text, doc) with label, note, purpose and fill_status; a fill with a problem is not used."""
    bad = validate_fills(skeleton, fills).select("function_id").distinct().withColumn("_bad", F.lit(True))
    per = fills.groupBy("function_id").agg(F.max("purpose").alias("_purpose")).join(bad, "function_id", "left")
    steps = fills.filter("step_id IS NOT NULL").groupBy("function_id", "step_id").agg(F.max("label").alias("_label"), F.max("note").alias("_note"))
    j = skeleton.join(per.withColumn("_has", F.lit(True)), "function_id", "left").join(steps, ["function_id", "step_id"], "left")
    use = F.col("_has") & F.col("_bad").isNull()
    status = F.when(use, "filled").when(F.col("_has"), "stale").otherwise("deterministic")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    out = j.withColumns({"label": F.coalesce(F.when(use, blank("_label")), F.col("text")), "note": F.when(use, blank("_note")), "purpose": F.coalesce(F.when(use, blank("_purpose")), F.col("doc"), F.lit("")), "fill_status": status})
    return out.drop("_has", "_bad", "_purpose", "_label", "_note")

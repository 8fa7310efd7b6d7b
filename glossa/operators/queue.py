"""The review queue: text types, candidate resolution, gates before a model is asked, and the outcome of its answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as tx

#: Words of a key that tell what kind of text it has; the first kind with a word wins.
HINTS = {
    "dialog_title": "dialog_title alert_title modal_title", "dialog_body": "dialog_body dialog_message alert_message modal_body", "notification_title": "notification_title", "notification_body": "notification_body push_body",
    "snackbar": "snackbar toast flash_message", "button": "button btn cta submit save cancel", "subtitle": "subtitle sub_title caption", "title": "title heading header", "helper_text": "helper hint instruction details description note", "form_label": "label field name",
}
PROTECTED = r"^([A-Z]{2,}|[A-Z]?[a-z]+[A-Z]\w*)$"


def text_type(key: Column, value: Column) -> Column:
    """By the key's tokens (and neighbouring pairs of them), else by the text's shape."""

    def of(t: Column) -> Column:
        out = None
        for kind, words in HINTS.items():
            hit = reduce(lambda a, b: a | b, [t.contains(f"_{w}_") for w in words.split()])
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out.otherwise(tx.let(tx.shape(value), lambda s: F.when(s == "sentence_like", "message").when(s == "short_label", "label").otherwise("unknown")))

    return tx.let(F.concat(F.lit("_"), tx.joined_tokens(key), F.lit("_")), of)


def technical_key(key: Column) -> Column:
    k = F.lower(key)
    starts = reduce(lambda a, b: a | b, [k.startswith(p) for p in ("zone", "error_code", "uuid", "setup", "config")])
    return starts | k.contains("_id") | k.contains("_url") | k.rlike("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def protected_lost(old: Column, new: Column) -> Column:
    """Whether an acronym or a mixed-case name of the old text lacks in the new one."""
    words = F.regexp_extract_all(old, F.lit(r"\w+"), 0)
    after = F.regexp_extract_all(new, F.lit(r"\w+"), 0)
    return F.exists(words, lambda w: w.rlike(PROTECTED) & ~F.array_contains(after, w))


def resolve_candidate(old: Column, new: Column) -> Column:
    """(decision, reason): empty, identical, structure, protected token, appended text, else a suggested fix."""
    structure = lambda c: F.array(*[F.size(F.regexp_extract_all(c, F.lit(rx), 0)) for rx in (r"\{[^{}]*\}", "<[^>]+>", r"%[sd]")])
    d = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("reason"))
    return F.when(tx.is_blank(new), d("none", "empty")).when(new == old, d("none", "identical")).when(structure(old) != structure(new), d("conflict", "structure")).when(protected_lost(old, new), d("veto", "protected_token")).when(new.startswith(F.concat(old, F.lit(" "))), d("veto", "appended")).otherwise(d("suggested_fix", "safe"))


def quality_class(decision: Column, severity: Column, risk: Column) -> Column:
    return F.when(decision.isin("veto", "conflict"), "blocked").when(severity.isin("critical", "high"), "review_required").when((decision == "suggested_fix") & risk.isin("whitespace", "case", "punctuation", "typo"), "safe_auto_projected").otherwise("suggestion_only")


def ask_model(found: DataFrame) -> DataFrame:
    """(seq, ask, reason) for findings (seq, issue_type, old, new): the first reason to skip, else why to ask."""
    t = F.col("issue_type")
    n = F.size(tx.words(F.col("old")))
    reason = F.when(t.isin("unused_en", "unused_ar", "key_naming"), "non_linguistic").when(t.isin("missing_placeholder", "whitespace", "spacing"), "format_only").when(t == "duplicate_value", "deterministic").when(t.isin("spelling") & (F.col("new") != ""), "auto_safe").when(t.startswith("missing_") | t.startswith("empty_"), "missing").when(n <= 1, "short_ambiguous").otherwise("semantic_repair")
    return found.select("seq", reason.isin("missing", "semantic_repair").alias("ask"), reason.alias("reason"))


def batches(found: DataFrame, size: int) -> DataFrame:
    """(key, batch, issues, messages): one row a key, numbered into batches of ``size`` within its hash bucket; so no task sorts all keys."""
    g = found.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("issue_type")), ",").alias("issues"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("seq", "message"))), lambda x: x["message"]), " | ").alias("messages"))
    bucket = F.ascii(F.substring(F.sha2("key", 256), 1, 1))
    k = F.row_number().over(Window.partitionBy(bucket).orderBy("key"))
    return g.select("key", F.concat(F.chr(bucket), F.lit("-"), F.floor((k - 1) / size).cast("string")).alias("batch"), "issues", "messages")


def outcome(status: Column) -> Column:
    """(decision, allow_apply, needs_review) of a gate's verdict."""
    d = lambda a, b, c: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("allow_apply"), F.lit(c).alias("needs_review"))
    return F.when(status == "accept", d("accepted", True, False)).when(status == "suspicious", d("review", False, True)).otherwise(d("rejected", False, False))


def error_class(message: Column) -> Column:
    """Of a provider's error: rate_limit, auth, timeout or other."""
    m = F.lower(message)
    return F.when(m.rlike("429|rate.?limit|quota"), "rate_limit").when(m.rlike("401|403|api key|unauthori"), "auth").when(m.rlike("time.?out|timed out|504"), "timeout").otherwise("other")


def relevant_terms(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(key, terms): the glossary's terms that a text contains, whatever their case."""
    hit = texts.join(glossary, F.contains(F.lower("en"), F.lower("term_en")))
    return hit.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(F.concat("term_en", F.lit("="), "approved"))), ",").alias("terms"))

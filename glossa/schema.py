"""The data model: catalog entries, findings, severities and issue codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = "locale string, key string, value string, value_type string, ord bigint, src_file string"
FINDINGS = "source string, key string, locale string, issue_type string, severity string, message string, old string, new string, seq bigint"

SEVERITIES = tuple("critical high medium low info".split())

#: Severity by source and issue type; "*" is the source's default.
SEVERITY = {
    "localization": {"critical": "missing_in_both confirmed_missing_key", "high": "missing_in_ar missing_in_en empty_ar empty_en", "medium": "needs_manual_review context_sensitive_term_conflict role_entity_misalignment in_ar_not_en in_en_not_ar", "low": "unused_ar unused_en confirmed_unused_key", "info": "*"},
    "locale_qc": {"high": "placeholder_mismatch key_naming", "medium": "grammar ui_wording", "info": "duplicate_value", "low": "*"},
    "ar_locale_qc": {"high": "forbidden_term", "medium": "context_sensitive_term_conflict role_entity_misalignment inconsistent_translation", "info": "long_ui_string similar_phrase_variation exclamation_style suspicious_literal_translation", "low": "*"},
    "ar_semantic_qc": {"medium": "sentence_shape_mismatch message_label_mismatch possible_meaning_loss", "info": "context_sensitive_meaning", "low": "*"},
    "grammar": {"medium": "grammar style uncategorized", "low": "*"},
    "terminology": {"high": "forbidden_term", "low": "soft_terminology_drift", "medium": "*"},
    "placeholders": {"high": "missing_in_ar missing_in_en count_mismatch format_mismatch", "medium": "renamed_placeholder mixed_placeholder_style", "low": "order_mismatch", "info": "*"},
    "icu_message_audit": {"high": "icu_syntax_error icu_branch_incomplete icu_literal_text_only", "medium": "icu_branch_mismatch icu_placeholder_mismatch", "info": "icu_suspicious_variation", "low": "*"},
}

#: Issue codes and the issue types they stand for.
CODES = {
    "MISSING_KEY": "missing_in_both",
    "MISSING_KEY_AR": "missing_ar missing_in_ar in_en_not_ar",
    "MISSING_KEY_EN": "missing_en missing_in_en in_ar_not_en",
    "UNUSED_KEY": "unused_ar unused_en confirmed_unused_key",
    "EMPTY_TRANSLATION": "empty_ar empty_en",
    "PLACEHOLDER_MISMATCH": "placeholder placeholder_mismatch",
    "TERMINOLOGY_VIOLATION": "terminology terminology_violation",
    "ICU_SYNTAX_ERROR": "icu_error icu_syntax_error",
    "GRAMMAR_ERROR": "grammar grammar_error",
    "AR_QC": "ar_qc ar_locale_qc camel_mixed_script camel_unknown_token",
    "AR_SEMANTIC": "ar_semantic ar_semantic_qc",
    "AI_SUGGESTION": "ai_suggestion",
    "NEEDS_MANUAL_REVIEW": "needs_manual_review suspicious_usage",
    "DYNAMIC_INFERRED_USAGE": "dynamic_inferred_usage dynamic_inferred_ar dynamic_inferred_en",
}


def case(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The key of table whose blank-separated list has the value."""
    out = None
    for k, names in table.items():
        hit = value.isin(*names.split())
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out.otherwise(F.lit(None) if default is None else default)


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 99 for others."""
    return F.when(severity.isin(*SEVERITIES), F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1).otherwise(99)


def normalize_severity(severity: Column, fallback: str = "info") -> Column:
    s = F.lower(F.trim(F.coalesce(F.nullif(severity, F.lit("")), F.lit(fallback))))
    return F.when(s == "warning", "medium").when(s.isin(*SEVERITIES), s).otherwise(fallback)


def severity_of(source: Column, issue_type: Column) -> Column:
    """The severity that a source gives an issue type."""
    out = None
    for name, table in SEVERITY.items():
        default = next(k for k, v in table.items() if v == "*")
        value = case(issue_type, {k: v for k, v in table.items() if v != "*"}, F.lit(default))
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise("info")


def issue_code(issue_type: Column) -> Column:
    return case(issue_type, CODES, F.lit("OTHER"))

"""Rules over records of findings, review rows and runs: locale, filters, projections, first or last wins, counters, contracts.

Joins are equi joins; first- and last-wins are aggregations with map-side combine, in a stated order; counters are one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators.findings import first_of

SOURCE_LOCALE = {"locale_qc": "en", "grammar": "en", "ar_locale_qc": "ar", "ar_semantic_qc": "ar", "terminology": "ar"}
#: What makes two findings of an audit the same.
SAME = {"placeholders": ["key", "issue_type", "message"], "locale_qc": ["key", "issue_type", "message", "old", "new"], "ar_locale_qc": ["key", "issue_type", "message", "old", "new"], "icu_message_audit": ["key", "issue_type", "message", "old", "new"], "terminology": ["key", "issue_type", "new", "old"], "grammar": ["key", "issue_type", "message", "old", "new"]}
#: The order of an audit's report.
ORDER = {"placeholders": ["severity", "key", "issue_type"], "locale_qc": ["issue_type", "key", "message"], "ar_locale_qc": ["issue_type", "key", "message", "old"], "icu_message_audit": ["severity", "key", "issue_type", "message"], "review_queue": ["locale", "key", "issue_type"]}
GRAMMAR = [("can not", "cannot", "style"), ("is mismatch", "do not match", "grammar"), ("is failed", "failed", "grammar"), ("is cancelled", "was cancelled", "grammar"), ("contact with", "contact", "grammar"), ("talk with", "talk to", "grammar"), ("api", "API", "capitalization"), ("everyday", "every day", "grammar"), ("2hours", "2 hours", "spacing"), ("allmost", "almost", "spelling"), ("varification", "verification", "spelling"), ("ratting", "rating", "spelling"), ("pont", "point", "spelling"), ("canot", "cannot", "spelling")]
KEY_NAMES = [("ratting", "rating"), ("pont", "point"), ("canot", "cannot")]


def _some(c: Column) -> Column:
    """c without blanks at the ends; null where nothing is left."""
    return F.nullif(tx.strip(c), F.lit(""))


def resolve_locale(locale: Column, source: Column, key: Column, path: Column, code: Column, details: Column) -> Column:
    """(locale, by): as given, else by source, the key's first part, the path, the code, the details; nulls where none tells."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    head = F.lower(F.element_at(F.split(F.coalesce(key, F.lit("")), r"\."), 1))
    by_source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_LOCALE.items() for x in kv]), F.lower(tx.strip(F.coalesce(source, F.lit("")))))
    by_path = F.when(p.contains("/ar/") | p.endswith("ar.json"), "ar").when(p.contains("/en/") | p.endswith("en.json"), "en")
    ways = [("explicit", _some(locale)), ("source_mapping", by_source), ("key_prefix", F.when(head.isin("ar", "en"), head)), ("file_path", by_path), ("code_fallback", F.when(code == "AI_SUGGESTION", "ar")), ("details_context", _some(details))]
    return F.struct(F.coalesce(*[v for _, v in ways]).alias("locale"), F.coalesce(*[F.when(v.isNotNull(), n) for n, v in ways]).alias("by"))


def key_names(entries: DataFrame) -> DataFrame:
    """(key, bad, new) for each misspelling in the name of a key."""
    found = F.array(*[F.when(F.col("key").contains(b), F.struct(F.lit(b).alias("bad"), F.replace("key", F.lit(b), F.lit(g)).alias("new"))) for b, g in KEY_NAMES])
    return entries.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("key", "x.*")


def grammar(entries: DataFrame) -> DataFrame:
    """(key, issue_type, rule, old, new) for each grammar rule that a text (key, value) breaks, whatever its case."""
    v = F.col("value")
    found = F.array(*[F.when(v.rlike(tx.whole_word(p)), F.struct(F.lit(t).alias("issue_type"), F.lit(p).alias("rule"), F.regexp_replace(v, tx.whole_word(p), r).alias("new"))) for p, r, t in GRAMMAR])
    return entries.select("key", v.alias("old"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("key", "x.issue_type", "x.rule", "old", "x.new")


def lower_start(entries: DataFrame) -> DataFrame:
    """(key, new): sentences of two words at least that begin with a small letter, and the text with a capital; no technical texts, mark-up or placeholders."""
    s = tx.strip(F.col("value"))
    bad = s.rlike(r"^\p{Ll}") & (F.size(F.regexp_extract_all(s, F.lit("[A-Za-z][A-Za-z']*"), 0)) >= 2) & s.rlike("[.?!]") & ~tx.is_technical(s) & ~s.rlike("[<>{}%$]")
    return entries.where(bad).select("key", F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000_000)).alias("new"))


def dedupe_by_audit(found: DataFrame) -> DataFrame:
    """The first finding (by seq) of those that its audit counts as the same; all of other sources."""
    part = F.lit(None)
    for source, cols in SAME.items():
        part = F.when(F.col("source") == source, F.to_json(F.array(*cols))).otherwise(part)
    d = found.withColumn("_same", F.coalesce(part, F.to_json(F.array(*[F.col(c).cast("string") for c in ("seq", "key")]))))
    return first_of(d, ["source", "_same"]).drop("_same")


def report(found: DataFrame, source: str) -> DataFrame:
    """The rows of an audit in the order of its report."""
    d = found if source == "review_queue" else found.where(F.col("source") == source)
    return d.orderBy(*ORDER[source])


def audit_summary(found: DataFrame) -> DataFrame:
    """(source, keys, findings, issue_types): one row an audit; issue_types is a map of counts as text, by name."""
    g = found.groupBy("source", "issue_type").agg(F.count("*").alias("n"))
    keys = found.groupBy("source").agg(F.count_distinct("key").alias("keys"))
    by = g.groupBy("source").agg(F.sum("n").alias("findings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_type", "n"))), lambda x: F.concat(x["issue_type"], F.lit("="), x["n"].cast("string"))), " ").alias("issue_types"))
    return by.join(keys, "source")


def merge_signals(*signals: DataFrame) -> DataFrame:
    """(key, style, grammar, literal, rules, sources) of signals (key, style, grammar, literal, rule, source): counts summed, flags joined, names as sorted sets."""
    d = signals[0]
    for s in signals[1:]:
        d = d.unionByName(s)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",").alias(c + "s")
    return d.groupBy("key").agg(F.sum("style").alias("style"), F.sum("grammar").alias("grammar"), F.bool_or("literal").alias("literal"), names("rule"), names("source"))


def with_signals(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """pairs with the signals of their key; 0, false and '' where there are none."""
    return pairs.join(signals, "key", "left").withColumn("style", F.coalesce("style", F.lit(0))).withColumn("grammar", F.coalesce("grammar", F.lit(0))).withColumn("literal", F.coalesce("literal", F.lit(False)))


def term_flags(en: Column, ar: Column, roles: tuple[str, ...], english: tuple[str, ...] = (), arabic: tuple[str, ...] = ()) -> Column:
    """en:<term>, ar_person:<role> and ar_entity:<term> for the roles and entities that stand in either text, each list by name."""
    low = F.lower(en)
    flags = [F.when(low.contains(t), f"en:{t}") for t in sorted({*roles, *english})] + [F.when(ar.contains(t), f"ar_person:{t}") for t in sorted(roles)] + [F.when(ar.contains(t), f"ar_entity:{t}") for t in sorted(arabic)]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def dominant(hints: Column) -> Column:
    """The first by name of the hints that say something; generic if there is none."""
    return F.coalesce(F.array_min(F.filter(hints, lambda x: (x != "") & ~x.isin("generic", "unknown"))), F.lit("generic"))


def meaningful(rows: DataFrame) -> DataFrame:
    """Review rows (suggested, old, notes, provenance) with a new suggestion, a conflict or a safety gate, or a morphological check."""
    new = (F.coalesce("suggested", F.lit("")) != "") & ~F.col("suggested").eqNullSafe(F.col("old"))
    notes = F.coalesce("notes", F.lit(""))
    return rows.where(new | notes.contains("[CONFLICT:") | notes.contains("safety_gate") | F.coalesce("provenance", F.lit("")).contains("camel_validation"))


def human_queue(rows: DataFrame) -> DataFrame:
    """What a reviewer sees: no rows of the morphological check; old and suggested under the names of the workbook."""
    d = rows.where(~F.coalesce("provenance", F.lit("")).contains("camel_validation"))
    return d.select("key", "locale", "issue_type", F.col("old").alias("current_value"), F.col("suggested").alias("candidate_value"), F.col("notes").alias("review_note"))


def payload_counts(rows: DataFrame) -> DataFrame:
    """(critical, safe, review, blocked, total) of review rows (severity, needs_review, notes), in one pass."""
    n = lambda c: F.count_if(c)
    return rows.agg(n(F.col("severity").isin("critical", "high")).alias("critical"), n(F.col("needs_review") == "No").alias("safe"), n(F.col("needs_review") == "Yes").alias("review"), n(F.coalesce("notes", F.lit("")).contains("[DQ:BLOCKED]")).alias("blocked"), F.count("*").alias("total"))


def decision_metrics(traces: DataFrame) -> DataFrame:
    """(invoked, skipped, accepted, suspicious, rejected) of traces (invoked BOOLEAN, outcome)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return traces.agg(n(F.col("invoked")).alias("invoked"), n(~F.col("invoked")).alias("skipped"), *[n(F.col("outcome") == o).alias(o) for o in ("accepted", "suspicious", "rejected")])


def of_stage(rows: DataFrame, stage_route: str, enabled: bool = True) -> DataFrame:
    """The rows that a stage takes: those of its route, and those without one; all if routing is off."""
    return rows.where(F.coalesce("route", F.lit(stage_route)) == stage_route) if enabled else rows


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each combination of keys; of the same order the one with the greater text."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.to_json(F.struct(*rest)))).alias("_x")).select(*keys, "_x.*").select(*rows.columns)


def with_staged(candidates: DataFrame, staged: DataFrame) -> DataFrame:
    """(key, locale, value, origin): the staged translation where there is one, else the first candidate (by seq)."""
    s = staged.select("key", "locale", "value", F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("seq"), F.lit("staged").alias("origin"))
    c = candidates.select("key", "locale", "value", F.lit(1).alias("p"), F.col("seq").cast("bigint").alias("seq"), F.lit("candidate").alias("origin"))
    return s.unionByName(c).groupBy("key", "locale").agg(F.min_by(F.struct("value", "origin"), F.struct("p", "seq", "value")).alias("x")).select("key", "locale", "x.*")


def update_master(master: DataFrame, frozen: DataFrame) -> DataFrame:
    """master with approved and status of frozen (plan_id, seq, approved, status), the first row of each plan; others keep their own."""
    f = frozen.where(F.coalesce("plan_id", F.lit("")) != "").groupBy("plan_id").agg(F.min_by(F.struct("approved", "status"), "seq").alias("_f"))
    return master.join(f, "plan_id", "left").withColumn("approved", F.when(F.col("_f").isNotNull(), F.col("_f.approved")).otherwise(F.col("approved"))).withColumn("status", F.when(F.col("_f").isNotNull(), F.col("_f.status")).otherwise(F.col("status"))).drop("_f")


def contract(rows: DataFrame, marker: str, value: str, required: list[str]) -> DataFrame:
    """(rule, bad): rows without the marker, and rows whose required field is empty."""
    rules = [(marker, ~F.col(marker).eqNullSafe(F.lit(value)))] + [(c, tx.is_blank(F.col(c).cast("string"))) for c in required]
    counts = rows.agg(*[F.count_if(bad).alias(f"_{i}") for i, (_, bad) in enumerate(rules)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("bad")) for i, (n, _) in enumerate(rules)])).alias("x")).select("x.*")


def safety_pass(entries: DataFrame) -> DataFrame:
    """(key, kind, new): texts that trimming, single blanks or a safe replacement put right, each on its own."""
    v = F.col("value")
    kinds = [("trim", tx.strip(v)), ("collapse", tx.collapse(v)), ("replacement", tx.safe_replace(v))]
    found = F.array(*[F.when(new != v, F.struct(F.lit(k).alias("kind"), new.alias("new"))) for k, new in kinds])
    return entries.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("key", "x.*")


def context_text(*fields: Column) -> Column:
    """The first field that isn't blank; '' if there is none."""
    return F.coalesce(*[_some(f) for f in fields], F.lit(""))


def trace(rows: DataFrame) -> DataFrame:
    """(plan_id, outcome, detail): one entry a processed row (plan_id, reason, approved): applied with its value, or rejected with its reason."""
    ok = F.col("reason") == "accepted"
    return rows.select("plan_id", F.when(ok, "applied").otherwise("rejected").alias("outcome"), F.when(ok, F.col("approved")).otherwise(F.col("reason")).alias("detail"))

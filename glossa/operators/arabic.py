"""Quality rules of the Arabic locale. All are row-local column expressions over one text, so a run is one scan without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.functions.mask import MARK, mask, masked, tokens, unmask  # noqa: F401

LATIN_ALLOWED = tuple("api otp sms gps pin id qr pdf url faq wifi whatsapp google apple facebook instagram youtube tiktok ios android bkash flutterwave liqpay mercadopago paymob paypal paytabs paytm razorpay senangpay sslcommerz stripe".split())
EXCLAMATIONS = ("الآن", "ابدأ", "اضغط", "سارع", "هيا", "ابدئي", "ابدأوا")
#: (phrase, words of which one has to stand in the text too)
LITERAL = [("لحظة من فضلك", ("انتظر", "جاري", "يرجى", "لحظة")), ("قم ب", ("قم ب", "الرجاء")), ("قم بالضغط", ("اضغط", "هنا", "للمتابعة", "للاستمرار"))]
STOPWORDS = tuple("في من على إلى عن بعد قبل مع هذا هذه ذلك تلك تم لا لن لم يرجى الرجاء ثم أو و".split())
MIXED = [(",", "،"), (";", "؛"), ("?", "؟")]
LONG = 120
_ISSUE = "array<struct<issue_type:string,severity:string,new:string,related:string,fix_mode:string>>"


def _issue(when: Column, kind: str | Column, severity: str | Column, new: Column | None = None, related: Column | None = None, fix: str = "review_required") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    blank = F.lit("")
    return F.when(when, F.struct(lit(kind).alias("issue_type"), lit(severity).alias("severity"), (blank if new is None else new).alias("new"), (blank if related is None else related).alias("related"), F.lit(fix).alias("fix_mode")))


def _there(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_risky(c: Column, found: Column) -> Column:
    """Whether runs of blanks may carry a meaning: line ends, mark-up, ICU, placeholders, technical text."""
    return c.rlike(r"[\n\r\t]") | tx.has_html(c) | tx.has_icu(c) | (F.size(found) > 0) | tx.is_technical(c)


def spacing(c: Column) -> Column:
    """whitespace, spacing, punctuation_spacing, bracket_spacing and slash_spacing, each with the text put right."""
    before_mark, open_, close = r"(?U)\s+([،؛؟:!])", r"(?U)([(\[{])\s+", r"(?U)\s+([)\]}])"
    fix = "auto_safe"

    def issues(m: Column, found: Column) -> Column:
        back = lambda x: unmask(x, found)
        brackets = F.regexp_replace(F.regexp_replace(m, open_, "$1"), close, "$1")
        return _there(
            _issue(tx.strip(m) != m, "whitespace", "low", back(tx.strip(m)), fix=fix),
            _issue(m.contains("  ") & ~is_risky(c, found), "spacing", "low", back(tx.collapse(m)), fix=fix),
            _issue(m.rlike(before_mark), "punctuation_spacing", "low", back(F.regexp_replace(m, before_mark, "$1")), fix=fix),
            _issue(m.rlike(open_) | m.rlike(close), "bracket_spacing", "low", back(brackets), fix=fix),
            _issue(m.contains(" / "), "slash_spacing", "low", back(F.regexp_replace(m, r"(?U)\s*/\s*", "/")), fix=fix),
        )

    return masked(c, issues)


def punctuation(c: Column, exclamations: bool = True) -> Column:
    """english_punctuation, mixed_punctuation, repeated_punctuation and exclamation_style; none for technical texts, mark-up and ICU."""
    repeated = r"([!؟?,،؛:])\1+"

    def issues(m: Column, found: Column) -> Column:
        comma = F.when(m.contains(","), F.regexp_replace(m, r"(?<!\d),(?!\d)", "،")).otherwise(m)
        arabic = F.translate(comma, ";?", "؛؟")
        swaps = F.array_join(_there(F.when(comma != m, F.lit(", -> ،")), F.when(m.contains(";"), F.lit("; -> ؛")), F.when(m.contains("?"), F.lit("? -> ؟"))), ", ")
        mixed = [F.when(m.contains(e) & m.contains(a) & (~m.rlike(r"\d,\d") if e == "," else F.lit(True)), f"{e} and {a}") for e, a in MIXED]
        bare = tx.strip(m)
        short = m.contains("!") & (F.length(bare) + 7 * F.size(found) <= 12) & reduce(lambda x, y: x | y, [m.contains(t) for t in EXCLAMATIONS])
        return _there(
            _issue(tx.has_arabic(m) & (arabic != m), "english_punctuation", "low", unmask(arabic, found), swaps, "auto_safe"),
            _issue(F.coalesce(*mixed).isNotNull(), "mixed_punctuation", "medium", related=F.coalesce(*mixed)),
            _issue(m.rlike(repeated), "repeated_punctuation", "medium", unmask(F.regexp_replace(m, repeated, "$1"), found)),
            _issue(F.lit(exclamations) & (m.contains("!!") | short), "exclamation_style", "info"),
        )

    return F.when(~(tx.is_technical(c) | tx.has_html(c) | tx.has_icu(c)), masked(c, issues)).otherwise(F.array().cast(_ISSUE))


def latin_words(c: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Latin words that a translation shouldn't have: no addresses, placeholders, brands or short capitals."""
    plain = F.regexp_replace(F.regexp_replace(mask(c), r"(?i)(https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", ""), MARK, " ")
    known = F.array(*map(F.lit, (*LATIN_ALLOWED, *(a.lower() for a in allowed))))
    return F.filter(F.regexp_extract_all(plain, F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9._+-]*\b"), 0), lambda w: ~F.array_contains(known, F.lower(w)) & ~w.rlike("^[A-Z]{2,4}$"))


def scripts(key: Column, c: Column, allowed: tuple[str, ...] = ()) -> Column:
    """untranslated_english without any Arabic, mixed_script beside it; none if the text is the key itself."""
    letters = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", ""))

    def issues(words: Column) -> Column:
        some = (F.size(words) > 0) & ~((letters(key) != "") & (letters(key) == letters(c)))
        return _there(
            _issue(some & ~tx.has_arabic(c), "untranslated_english", "high"),
            _issue(tx.has_arabic(c) & some, "mixed_script", "medium", related=F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 8), ", ")),
        )

    return F.when(tx.has_latin(c), tx.let(latin_words(c, allowed), issues)).otherwise(F.array().cast(_ISSUE))


def compared(c: Column) -> Column:
    """White space, and blanks about punctuation, brackets and slashes, made uniform."""
    s = F.regexp_replace(F.regexp_replace(tx.strip(c), r"(?U)\s+", " "), r"\s+([،؛؟:!])", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"([(\[{])\s+", "$1"), r"\s+([)\]}])", "$1"), r"\s*/\s*", "/")


def literal(c: Column) -> Column:
    """suspicious_literal_translation for each phrase of the short list that stands with one of its words."""
    issues = lambda n: _there(*[_issue(n.contains(p) & reduce(lambda x, y: x | y, [n.contains(w) for w in ws]), "suspicious_literal_translation", "info", related=F.lit(p)) for p, ws in LITERAL])
    return F.when(tx.has_arabic(c), tx.let(compared(c), issues)).otherwise(F.array().cast(_ISSUE))


def weak(c: Column) -> Column:
    """empty_string, placeholder_text or weak_text: nothing, a stand-in, or no word."""

    def issues(s: Column) -> Column:
        stand_in = s.rlike(r"(?i)^(todo|tbd|xxx+|lorem ipsum|placeholder|translation|test)$")
        return _there(_issue(s == "", "empty_string", "high"), _issue((s != "") & stand_in, "placeholder_text", "high"), _issue((s != "") & ~stand_in & s.rlike(r"^[^\p{L}\p{N}]+$"), "weak_text", "medium"))

    return tx.let(tx.strip(c), issues)


def long(c: Column, most: int = LONG) -> Column:
    return tx.let(F.length(tx.strip(c)), lambda n: _there(_issue(n > most, "long_ui_string", "info", related=F.concat(n.cast("string"), F.lit(" chars")))))


def first_word(c: Column) -> Column:
    """The first Arabic word that isn't a stopword; else the first one; '' without any."""
    words = F.regexp_extract_all(c, F.lit("[؀-ۿ]+"), 0)
    return F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), F.lit(0)), F.get(words, F.lit(0)), F.lit(""))


def preview(c: Column, most: int = 120) -> Column:
    """Without vowel marks and tatweel, one alef, ha for ta marbuta, ya for alef maksura, Western digits, single blanks; compatibility forms aren't folded."""
    s = F.translate(F.regexp_replace(c, "[ً-ٰٟـ]", ""), "أإآٱةى٠١٢٣٤٥٦٧٨٩", "ااااهي0123456789")
    return F.substring(tx.strip(F.regexp_replace(s, r"(?U)\s+", " ")), 1, most)


def is_status(c: Column) -> Column:
    """Whether a text tells of an outcome, so that no verb may be put before it."""
    return c.rlike(r"(?U)تم\s|بنجاح|فشل|خطأ\b|لا\s+يمكن|غير\s+متاح")


def _core(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^(ال|ل|ب|ك|و|ف)", ""), "[اويية]", "")


def fuzzy_contains(text: Column, term: Column) -> Column:
    """Whether a term stands in an Arabic text, whatever prefix and weak letters, in a word whose core is three letters longer at most."""
    core = _core(term)
    near = lambda w: (w != "") & F.contains(_core(w), core) & (F.abs(F.length(_core(w)) - F.length(core)) <= 3)
    return (term != "") & (text != "") & (F.contains(text, term) | ((F.length(core) >= 2) & F.exists(F.split(text, r"(?U)[^\w؀-ۿ]+"), near)))


def candidate(en: Column, ar: Column, missing: Column, verbs: dict[str, str], allowed: Column | None = None) -> Column:
    """The text with the verb that it lacks put first: only if exactly one lacks, it isn't there in that form, and the text is no status; else ''."""
    verb = F.element_at(F.create_map(*[F.lit(x) for k in sorted(verbs) for x in (k, verbs[k].split()[0])]), F.get(missing, F.lit(0)))
    s = tx.strip(ar)
    stop = F.when(tx.is_sentence_like(en) & ~s.rlike(r"[.!?؟…]$"), ".").otherwise("")
    ok = (F.size(missing) == 1) & verb.isNotNull() & ~F.contains(ar, verb) & ~is_status(ar)
    return F.when(ok if allowed is None else ok & allowed, F.concat(F.trim(F.concat(verb, F.lit(" "), s)), stop)).otherwise("")


def issues(key: Column, c: Column, allowed: tuple[str, ...] = (), exclamations: bool = True, long_texts: bool = True, literals: bool = True) -> Column:
    """Array of the issues of all rules of a text; none of a null one."""
    rules = [weak(c), spacing(c), punctuation(c, exclamations), scripts(key, c, allowed)] + [literal(c)] * literals + [long(c)] * long_texts
    return F.flatten(F.array(*rules))


def findings(pairs: DataFrame, allowed: tuple[str, ...] = (), exclamations: bool = True, long_texts: bool = True, literals: bool = True) -> DataFrame:
    """(key, issue_type, severity, old, new, related, fix_mode) of all rules over pairs (key, ar), each rule looking at the text once.

    A null text has no finding, a blank one empty_string and perhaps whitespace. Copies of a row give copies of its findings.
    """
    c = F.col("ar")
    d = pairs.where(c.isNotNull()).select("key", c.alias("old"), F.explode(issues(F.col("key"), c, allowed, exclamations, long_texts, literals)).alias("x"))
    return d.select("key", "x.issue_type", "x.severity", "old", "x.new", "x.related", "x.fix_mode")

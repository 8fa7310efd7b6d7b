"""Text-shape predicates and string functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Misspellings and wordings that are put right without review.
SAFE_WORDS = {"almost": "allmost", "verification": "varification", "rating": "ratting", "point": "pont", "2 hours": "2hours", "every day": "everyday", "API": "api"}
SAFE_REPLACEMENTS = {wrong: right for right, wrong in SAFE_WORDS.items()} | {"can not": "cannot", "canot": "cannot"} | {w + "t": w + "'t" for w in ("don", "won", "can", "shouldn", "wouldn", "couldn", "doesn", "isn", "aren", "weren", "wasn", "haven", "hasn", "hadn")}

#: (issue type, pattern, replacement, message) of the English wording rules that concern single words and phrases.
WORDING = [
    ("spelling", "allmost", "almost", "misspelt"),
    ("spelling", "canot", "cannot", "misspelt"),
    ("spelling", "varification", "verification", "misspelt"),
    ("spelling", "ratting", "rating", "misspelt"),
    ("spelling", "pont", "point", "misspelt"),
    ("spacing", "2hours", "2 hours", "space missing"),
    ("style", "everyday", "every day", "adverb is two words"),
    ("grammar", "contact with", "Contact", "no preposition after contact"),
    ("grammar", "talk with", "Talk to", "talk takes to"),
    ("grammar", "you can not", "You cannot", "cannot is one word"),
    ("grammar", "your payment is failed", "Your payment failed", "tense"),
    ("grammar", "your payment is cancelled", "Your payment was cancelled", "tense"),
    ("grammar", "enter valid email", "Enter a valid email", "article missing"),
    ("grammar", "please fill all the field", "Please fill all the fields", "plural"),
    ("ui_wording", "customer bided", "Customer placed a bid", "verb form"),
    ("ui_wording", "your trip is accepted", "Your trip has been accepted", "tense"),
    ("grammar", "password is mismatch", "Passwords do not match", "verb form"),
    ("grammar", "your payment is successfully done", "Your payment was successful", "tense"),
    ("grammar", "enter valid email address", "Enter a valid email address", "article missing"),
    ("grammar", "didn't customer arrived?", "Has the customer arrived?", "question form"),
    ("grammar", "didn’t customer arrived?", "Has the customer arrived?", "question form"),
    ("grammar", "you are not reached destination", "You have not reached the destination", "tense and article"),
    ("grammar", "try few minute latter", "Try again in a few minutes", "plural"),
    ("grammar", "typically the support team send you any feedback in", "Typically, the support team sends you feedback within", "agreement"),
    ("grammar", "searching a car to go your destination?", "Looking for a car to reach your destination?", "preposition"),
    ("grammar", "your car is arrived be ready for your trip", "Your car has arrived. Be ready for your trip.", "tense"),
    ("grammar", "enjoy your ride ! & travel your destination everyday", "Enjoy your ride and travel to your destination every day.", "two sentences run together"),
    ("grammar", "your have to reach your pickup point in counting time", "You have to reach your pickup point within the countdown time", "pronoun"),
    ("grammar", "for feel better experience", "For a better experience", "verb after a preposition"),
    ("grammar", "end this trip is", "End this trip at", "preposition"),
    ("grammar", "to get request, must stay in our coverage area.", "To receive requests, you must stay within our coverage area.", "subject missing"),
    ("grammar", "here a list of numbers that you may contact.", "Here is a list of numbers you may contact.", "verb missing"),
    ("grammar", "you will be logout from your panel.", "You will be logged out from your panel.", "verb form"),
    ("grammar", "identification content need verification first.", "Identification information needs verification first.", "agreement"),
    ("grammar", "until wow you can't solve your safety issue", "If your safety issue is not resolved", "conjunction"),
    ("grammar", "until wow you can’t solve your safety issue", "If your safety issue is not resolved", "conjunction"),
    ("ui_wording", "customer are surrounding you", "Customers are nearby", "plural"),
    ("ui_wording", "stay online mode to get more ride", "Stay online to get more rides", "plural"),
]

_WORD = r"[A-Za-z؀-ۿ0-9]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row: a column that is used several times is otherwise written out, and computed, as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, by Unicode's idea of white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one."""
    return F.regexp_replace(c, " {2,}", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def has_html(c: Column) -> Column:
    return c.contains("<") & c.rlike("<[^>]+>")


def has_icu(c: Column) -> Column:
    return c.contains("{") & c.rlike(r"(?i)\{[^{}]+,\s*(?:selectordinal|plural|select)\s*,")


def is_technical(c: Column) -> Column:
    """URLs, addresses, paths, flags, code, commands and brands. A pattern runs only where the text has the characters that it can't do without."""
    patterns = [(".", r"(?i)www\.\S+"), ("@", r"(?i)[\w.%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?!\w)"), ("/", r"(^|[(\s])~?/\S+"), ("--", r"(^|[(\s])--\w"), ("`", "`[^`]+`")]
    words = [r"(?U)(^|\s)(cargo|cat|cd|composer|git|ls|node|npm|npx|pip|pnpm|python|yarn)(?!\w)", r"(?U)(?<!\w)([a-z]+[A-Z]|iPhone|iPad|macOS|GitHub)"]
    return reduce(lambda a, b: a | b, [c.contains("://"), c.contains("\\"), *[c.contains(x) & c.rlike(p) for x, p in patterns], *[c.rlike(p) for p in words]])


def has_arabic(c: Column) -> Column:
    return c.rlike(r"[؀-ۿ]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD), 0)


def is_sentence_like(c: Column) -> Column:
    s = strip(c)
    return (F.size(words(s)) >= 7) | s.contains("\n") | s.rlike(r"[.!?؟]$")


def is_short_label(c: Column) -> Column:
    s = strip(c)
    n = F.size(words(s))
    return (n > 0) & (n <= 3) & ~s.rlike(r"[.!?؟]$")


def shape(c: Column) -> Column:
    """empty, sentence_like, short_label or phrase."""

    def of(s: Column) -> Column:
        n = lambda k: F.when(k == 0, "phrase").when(k <= 3, "short_label").otherwise("phrase")
        some = let(F.size(words(s)), lambda k: F.when(k >= 7, "sentence_like").otherwise(n(k)))
        return F.when(s.isNull() | (s == ""), "empty").when(s.contains("\n") | s.rlike(r"[.!?؟]$"), "sentence_like").otherwise(some)

    return let(strip(c), of)


def csv_guard(c: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "(.)([A-Z][a-z][a-z]*)", "$1_$2"), "(?<=[0-9a-z])(?=[A-Z])", "_"))


def joined_tokens(c: Column) -> Column:
    """The tokens of a key in lower case, a low line between them."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_"), r"[\W_]+", "_"))


def key_tokens(c: Column) -> Column:
    return F.filter(F.split(joined_tokens(c), "_"), lambda t: t != "")


def is_small_change(old: Column, new: Column) -> Column:
    """Both there and different, of 12 words at most, and of about the same length."""
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))
    gap = F.greatest(F.lit(10), F.floor(F.length(old) / 2).cast("int"))
    return (old != "") & (new != "") & (old != new) & (n(old) <= 12) & (n(new) <= 12) & (F.abs(F.length(old) - F.length(new)) <= gap)


def safe_replace(c: Column) -> Column:
    """All safe replacements, the longest first."""
    for wrong in sorted(SAFE_REPLACEMENTS, key=len, reverse=True):
        c = F.replace(c, F.lit(wrong), F.lit(SAFE_REPLACEMENTS[wrong]))
    return c


def whole_word(phrase: str) -> str:
    return rf"(?i)(?U)(?<!\w)\Q{phrase}\E(?!\w)"


def wording_issues(c: Column) -> Column:
    """Array of (issue_type, message, new) for each wording rule that a text breaks; none for technical texts or mark-up."""
    any_of = r"(?i)(?U)(?<!\w)(?:" + "|".join(rf"\Q{p}\E" for _, p, _, _ in WORDING) + r")(?!\w)"  # most texts break none: one pattern tells
    found = [F.when(c.rlike(whole_word(p)), F.struct(F.lit(t).alias("issue_type"), F.lit(m).alias("message"), F.regexp_replace(c, whole_word(p), r).alias("new"))) for t, p, r, m in WORDING]
    plain = c.rlike(any_of) & ~c.rlike("[<>]") & ~is_technical(c)
    return F.when(plain, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<issue_type:string,message:string,new:string>>"))


def is_title_case(c: Column) -> Column:
    """At least four words, all with a capital."""
    w = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0)
    return (F.size(w) >= 4) & F.forall(w, lambda x: x.rlike("^[A-Z]"))


def sentence_case(c: Column) -> Column:
    s = F.lower(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000_000))


def doubled_punctuation(c: Column) -> Column:
    return c.rlike(r"([!?,:;.؟،])\1")


def normalize_arabic(c: Column) -> Column:
    """Without vowel marks, one alef, and ha for ta marbuta."""
    return F.translate(F.regexp_replace(c, r"[ً-ٰٟ]", ""), "أإآٱة", "ااااه")


def normalize_for_compare(c: Column) -> Column:
    """White space, and blanks about punctuation, made uniform."""
    s = F.regexp_replace(strip(c), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(s, r" ([,.;:!?،؛؟)\]])", "$1"), r"([(\[]) ", "$1")


def without_punctuation(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))


def html_tags(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("<[^>]+>"), 0)))


def line_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def plan_id(*parts: Column) -> Column:
    """16 digits of the hash of the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16)


def low_risk_edit(old: Column, new: Column) -> Column:
    """equal, whitespace, case, punctuation, typo (one word, at most two edits) or none."""
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    a, b = F.split(old, " "), F.split(new, " ")
    changed = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] != p["y"])
    one = (F.size(a) == F.size(b)) & (F.size(changed) == 1) & (F.levenshtein(F.element_at(F.transform(changed, lambda p: p["x"]), 1), F.element_at(F.transform(changed, lambda p: p["y"]), 1)) <= 2)
    return F.when(old == new, "equal").when(plain(old) == plain(new), "whitespace").when(F.lower(old) == F.lower(new), "case").when(without_punctuation(old) == without_punctuation(new), "punctuation").when(one, "typo").otherwise("none")

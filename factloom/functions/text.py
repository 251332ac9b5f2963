"""Text functions of the store as Column expressions.

Everything stays in the JVM. Unicode compatibility folding (NFKC) and stripping of diacritics have no
built-in; :func:`nfkc` and :func:`strip_marks` are vectorised and meant to be applied once, at ingest.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no content, English and romanised Hindi.
STOPWORDS = frozenset(
    """
    a about above after again all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has
    have having he her here hers him his how i if in into is it its just like me more most my no nor
    not now of off on once only or other our out over own remind same she should so some such than
    that the their them then there these they this those through to too under until up us very was
    we were what when where which while who whom why will with would you your yours hey hi hello
    please tell know want need get got let say said
    hai hain ho hoon hun tha thi the ka ki ke ko se me mein mai main mujhe mera meri mere tum tumhe
    aap aapka kya kaun kaise kab kahan kyun kyu aur ya par pe bhi toh to ye yeh woh wo is us isko usko
    nahi nahin na hi tha thi hoga hogi karo kar karna kiya kuch koi
    """.split()
)
# Words that the terms of a reflective question leave out.
QUESTION_WORDS = frozenset(
    """the and for with what when where which who how does did its this that from about into
    your our their have has had was were""".split()
)
# Words of a turn that says nothing.
ACKNOWLEDGEMENTS = frozenset(
    """ok okay k kk thanks thank thx you yes yep yeah no nope nah hi hello hey cool nice great sure hmm
    done go on continue please bro haan nahi theek hai acha accha shukriya dhanyavad""".split()
)
# Predicates that hold one value at a time, and prefixes of such.
SINGLE_VALUED = (
    "memory_provider", "default_model", "active_model", "current_model", "current_provider", "primary_provider", "lives_in", "located_in",
    "works_at", "employer", "job_title", "timezone", "primary_language", "preferred_language", "phone_model",
)
SINGLE_VALUED_PREFIXES = ("current_", "default_", "primary_", "active_", "preferred_")
# What counts as a secret and is never stored.
SENSITIVE = (
    r"(?i)\b(?:password|passwd|pwd|api[_ -]?key|secret|access[_ -]?token|refresh[_ -]?token|auth[_ -]?token|session[_ -]?cookie|client[_ -]?secret)\s*[:=]\s*\S+",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{30,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\bya29\.[A-Za-z0-9_-]{20,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{20,}",
)

TOKEN = r"[\p{L}\p{N}_]++(?:[@.+:/-]++[\p{L}\p{N}_]++)*+"  # marks stand inside a word only


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _case_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def sort_key(name: Column | str) -> Column:
    """What names are ordered by, whatever their case and compatibility forms."""
    return _case_folded(name)


@F.pandas_udf(T.StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """Lower case without combining marks, the folding of the lexical index."""
    return texts.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn"), na_action="ignore")


def words_array(words) -> Column:
    return F.array(*map(F.lit, sorted(words)))


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column | str) -> Column:
    """What two facts must share to be one: lower case with single spaces. NFKC is applied at ingest."""
    return F.lower(collapse(text))


def ingested_key(text: Column | str) -> Column:
    """:func:`normalize` of text that comes from outside, compatibility forms folded first."""
    return normalize(nfkc(text))


def tokenize(text: Column | str) -> Column:
    """Words with inner ``. : / - + @ _``; such marks at the ends are dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords_of(tokens: Column | str, limit: int = 16) -> Column:
    """The first distinct tokens of two characters or more that aren't stopwords; maybe none."""
    return F.slice(F.filter(F.array_except(tokens, words_array(STOPWORDS)), lambda t: F.length(t) >= 2), 1, limit)


def keywords(text: Column | str, limit: int = 16) -> Column:
    return keywords_of(tokenize(text), limit)


def question_terms(text: Column | str, limit: int = 12) -> Column:
    stop = words_array(QUESTION_WORDS)
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_.+#-]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))), 1, limit)


def stem(term: Column) -> Column:
    return F.when((F.length(term) > 4) & F.endswith(term, F.lit("s")), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def prefix_overlap(terms: Column, text: Column | str) -> Column:
    """How many terms begin some word of the text, or begin with one of four characters or more.

    Only the terms lose a final s; the words of the text don't.
    """
    none = F.array().cast("array<string>")

    def hit(words: Column, s: Column) -> Column:
        """words: those of the text with a space before and after each; so what begins one is found by a plain search."""
        ends = F.when(F.length(s) > 4, F.sequence(F.lit(4), F.length(s) - 1))
        whole = F.exists(ends, lambda k: F.contains(words, F.concat(F.lit(" "), F.substring(s, F.lit(1), k), F.lit(" "))))
        near = F.contains(words, F.concat(F.lit(" "), F.substring(s, 1, 4)))  # else neither
        return ~F.contains(s, F.lit(" ")) & near & (F.contains(words, F.concat(F.lit(" "), s)) | F.coalesce(whole, F.lit(False)))

    stems = F.transform(terms, stem)
    found = F.coalesce(tokenize(text), none)
    spaced = F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).otherwise(""))
    return F.transform(spaced, lambda words: F.size(F.filter(stems, lambda s: hit(words, s))))[0]


def looks_sensitive(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for pattern in SENSITIVE:
        out = out | column.rlike(pattern)
    return out


def is_trivial(user: Column | str) -> Column:
    """No words, a leading slash, or up to five words that are all acknowledgements."""
    column = F.col(user) if isinstance(user, str) else user
    words = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = words_array(ACKNOWLEDGEMENTS)
    return (F.size(words) == 0) | F.startswith(F.ltrim(column), F.lit("/")) | ((F.size(words) <= 5) & F.forall(words, lambda w: F.array_contains(known, w)))


def is_single_valued(predicate: Column | str) -> Column:
    p = F.lower(predicate)
    out = p.isin(*SINGLE_VALUED)
    for prefix in SINGLE_VALUED_PREFIXES:
        out = out | F.startswith(p, F.lit(prefix))
    return out


def clamp01(value: Column, default: float = 0.5) -> Column:
    """0 to 1; what is no number gives the default, and NaN gives 0."""
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(default)).when(F.isnan(number), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def clean_name(value: Column) -> Column:
    """A name of 1 to 160 characters without control characters, else null."""
    name = collapse(value)
    return F.when(name.rlike(r"^[^\x00-\x1f\x7f]{1,160}$"), name)


def clean_merged(value: Column) -> Column:
    """One line of up to 400 characters that holds no secret, else null."""
    text = collapse(value)
    ok = ~value.rlike(r"[\r\n]") & (F.length(text) > 0) & (F.length(text) <= 400) & ~looks_sensitive(text)
    return F.when(ok, text)


def valid_event_time(value: Column) -> Column:
    """The text itself if it is up to 64 characters that cast to a timestamp, else null."""
    text = F.trim(value)
    return F.when((F.length(text).between(1, 64)) & text.try_cast("timestamp").isNotNull(), text)


def safe_stem(value: Column, fallback: str) -> Column:
    """A file name of up to 120 characters without characters that file systems or links reserve."""
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r'[\\/:*?"<>|\[\]#^]', "-")
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", ""), r"(?U)\s+", " "), F.lit(" .-"))
    text = F.when((text == "") | F.startswith(text, F.lit(".")), F.lit(fallback)).otherwise(text)
    cut = F.rtrim(F.substring(text, 1, 120), F.lit(" ."))
    return F.when(cut == "", F.lit(fallback)).otherwise(cut)


def safe_display(value: Column) -> Column:
    """One line of up to 240 characters in which link syntax is inert."""
    text = F.substring(collapse(F.regexp_replace(F.coalesce(value, F.lit("")), "\x00", "")), 1, 240)
    return F.replace(F.replace(F.replace(text, F.lit("[["), F.lit("［［")), F.lit("]]"), F.lit("］］")), F.lit("|"), F.lit("¦"))


def quoted(value: Column) -> Column:
    """A JSON string, which is also valid in YAML."""
    text = F.substring(collapse(F.regexp_replace(F.coalesce(value, F.lit("")), "\x00", "")), 1, 2000)
    return F.substring(F.to_json(F.struct(text.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6)


def html_escaped(value: Column) -> Column:
    text = F.replace(F.regexp_replace(value, "\x00", ""), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

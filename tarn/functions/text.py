"""Scalar text functions as columns; all stay inside the JVM.

Null gives null unless a function says otherwise. White space means every Unicode blank (BLANKS), not only ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character, in the words of both regex dialects (Java and RE2).
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A token of the size count: a run of ASCII letters and digits, or another sign that is no white space.
SIZE_TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9" + BLANKS[1:]

# Words without signal for term search, filler before a question. Our own list: words that most entries of such a corpus carry.
STOPWORDS = """a an and are as at be but by can do does for from had has have how i if in into is it its me my of on or should so tell
that the their them then there these they this to was what when where which who will with you your""".split()
QUESTION_PREFIXES = ("what is the", "what are the", "what's the", "whats the", "tell me about", "tell me", "how do i", "how can i", "how much", "please", "can you", "could you")
NOISE_WORDS = """fund funds mutual scheme schemes amc direct growth plan invest investment investments details detail information tell know about
please annual annually current currently latest today now ongoing recurring total""".split()


def squash(text: Column) -> Column:
    """Single blanks, no outer blanks."""
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def content_hash(text: Column) -> Column:
    """sha256 of the text with its white space normalised."""
    return F.sha2(squash(text), 256)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by underscores; `unknown` if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(body == "", F.lit("unknown")).otherwise(body)


def size_tokens(text: Column) -> Column:
    """The whole part of 1.3 times the number of size tokens, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.regexp_count(text, F.lit(SIZE_TOKEN)) * F.lit(1.3))).cast("int")


def blank_tokens(text: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(squash(text), " "), lambda x: x != "")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The text if its size is within the limit, else its first words, each counted by its size plus one."""
    step = lambda s, w: F.struct((s["n"] + size_tokens(w) + 1).alias("n"), F.when(s["n"] + size_tokens(w) + 1 <= limit, s["k"] + 1).otherwise(s["k"]).alias("k"))
    state = F.aggregate(blank_tokens(text), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), step)
    return F.when(size_tokens(text) <= limit, text).otherwise(F.array_join(F.slice(blank_tokens(text), 1, state["k"]), " "))


def without_source_tail(text: Column) -> Column:
    """The text without `Source: <url>` at its end."""
    return F.trim(F.regexp_replace(text, r"(?i)(\s*Source:\s*https?://\S+)*\s*$", ""))


def head_clause(text: Column) -> Column:
    """The leading clause: up to the first full stop, question or exclamation mark within 160 characters, else nothing."""
    return F.trim(F.regexp_extract(squash(text), r"^([^.?!]{0,160})([.?!]|$)", 1))


def mask(value: Column) -> Column:
    """The first two characters and stars; stars alone up to four characters."""
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.length(value) - 2)))


def terms(text: Column) -> Column:
    """Lower-case ASCII words and numbers without stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~F.array_contains(stop, t))


def normalised_question(text: Column) -> Column:
    """Lower case without filler prefixes and punctuation; decimal points and % stay."""
    out = F.lower(squash(text))
    for prefix in QUESTION_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix} *", "")
    out = F.replace(out, F.lit("_"), F.lit(" "))
    out = F.regexp_replace(F.regexp_replace(out, r"(\d)\.(\d)", "$1~$2"), r"(\d)\.(\d)", "$1~$2")
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}%~]+", " "), F.lit("~"), F.lit(".")), " +", " "))


def content_terms(text: Column) -> Column:
    """Terms of the normalised question without noise words; all terms if none is left."""
    every = terms(normalised_question(text))
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    kept = F.filter(every, lambda t: ~F.array_contains(noise, t))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def states_figure(text: Column) -> Column:
    """A currency sign, a percentage, or a number of three digits or more."""
    return F.coalesce(text.rlike(r"[₹$%]|[0-9][0-9,]{2,}"), F.lit(False))


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, without commas, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))))


# Our own list: abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = r"(?i)\b(mr|mrs|ms|dr|vs|etc|no|fig|approx|incl|excl|min|max|rs|inr|cr|asst|mgr|co|ltd|inc|avg)\."


def sentences(text: Column) -> Column:
    """Sentences: abbreviations, decimals and links end none. A blank text has none."""
    body = F.regexp_replace(text, r"https?://\S+", "<URL>")
    body = F.regexp_replace(F.regexp_replace(body, _ABBREVIATIONS, "$1<DOT>"), r"([0-9])\.([0-9])", "$1<DOT>$2")
    marked = F.regexp_replace(body, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def clip_sentences(text: Column, limit: int) -> Column:
    """The first sentences of a text that has more than `limit`."""
    cut = F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.when(F.size(sentences(text)) <= limit, text).otherwise(F.trim(F.array_join(F.slice(cut, 1, limit), " ")))


def collapse_repeats(text: Column, rounds: int = 3) -> Column:
    """Runs of two to six words that stand twice in a row, once."""
    for _ in range(rounds):
        text = F.regexp_replace(text, r"(?i)\b((?:[\w%.'-]+\s+){1,5}[\w%.'-]+)\s+\1\b", "$1")
    return text


def quote(text: Column) -> Column:
    """A line as a sentence: first letter large, full stop at the end, wording unchanged."""
    body = F.regexp_replace(squash(text), r"^[ .\-–—]+|[ .\-–—]+$", "")
    large = F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 1_000_000))
    return F.when(body == "", F.lit("")).otherwise(F.when(large.rlike("[.!?]$"), large).otherwise(F.concat(large, F.lit("."))))


# Fixed value: the form of a line that states a label and its value.
_ROW = r"^(.{2,60}?)\s*[:\-]\s+(.{1,400})$"


def label_half(text: Column) -> Column:
    return F.trim(F.regexp_extract(squash(text), _ROW, 1))


def value_half(text: Column) -> Column:
    return F.trim(F.regexp_extract(squash(text), _ROW, 2))


def is_period(value: Column) -> Column:
    """Only a period selector."""
    return F.coalesce(F.lower(squash(value)).rlike("^(1d|1w|1m|3m|6m|1y|2y|3y|5y|10y|all time|ytd|since inception)$"), F.lit(False))


def is_as_on_only(value: Column) -> Column:
    """Only a date of validity."""
    return F.coalesce(F.lower(squash(value)).rlike(r"^as (on|of|at) [0-9]{1,2} ?[a-z/\-]{3,12}\.?,? ?[0-9]{2,4}\.?$"), F.lit(False))


def is_date_only(value: Column) -> Column:
    """Only a date: a day with a month name or three numbers, or a month name alone."""
    return F.coalesce(F.lower(squash(value)).rlike(r"^[0-9 ]*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ 0-9,'\-/]*$|^[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def is_valueish(text: Column) -> Column:
    """Reads like a value: a currency sign, a digit, a per cent sign or a word for none."""
    return F.coalesce(F.lower(text).rlike("[₹$%0-9★]|^(n\\.?a\\.?|nil|none|zero|low|moderate|high|very high)$"), F.lit(False))


def is_labelish(text: Column) -> Column:
    """Reads like a label: has a letter, begins with none of the digits, is no value."""
    t = F.regexp_replace(squash(text), r"(?i)\(as on[^)]*\)", "")
    return F.coalesce(t.rlike("\\p{L}") & ~t.rlike("^[0-9]") & ~is_valueish(t), F.lit(False))


def redact(text: Column) -> Column:
    """Tax numbers, 12-digit and longer runs and e-mails as [redacted]."""
    return F.regexp_replace(text, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b|[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.]+|[0-9]{12,}", "[redacted]")


def comparable(text: Column) -> Column:
    """A figure by value, not typography."""
    t = F.lower(text)
    for old, new in (("₹", ""), ("rs.", ""), ("rs", ""), (",", ""), ("%", ""), ("cr", " crore ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9. ]+", " "), " +", " "))


def chunk_id(source: Column, section: Column, text: Column) -> Column:
    """{source}__{slug of the section, 40 characters}__{first six of the content hash}."""
    return F.concat_ws("__", source, F.substring(slug(section), 1, 40), F.substring(content_hash(text), 1, 6))


def iso(stamp: Column) -> Column:
    """UTC stamp with milliseconds."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

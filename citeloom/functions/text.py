"""Column expressions over text: tokens, sentences, citation markers, numbers, identifiers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of content tokens.
STOPWORDS = """a an and are as at be been but by for from had has have he her his how i in is it its of on or that the
their there they this to was were what when where which who will with would you your""".split()
# Words that make a text negative. The tokenizer splits at apostrophes, so contractions cannot match.
NEGATIONS = "not no never none neither nor without cannot unable failed declined denied rejected".split()
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc eg ie al inc ltd co corp dept est fig no vol approx u.s u.k e.g i.e a.m p.m".split()


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def strip(c: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words; a blank text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Lower-case ASCII tokens without stopwords, with repeats."""
    stop = strings(STOPWORDS)
    return F.filter(all_tokens(c), lambda t: ~F.array_contains(stop, t))


def token_set(c: Column) -> Column:
    return F.array_distinct(content_tokens(c))


def sentences(c: Column) -> Column:
    """Sentences: cut after ``.!?`` and a blank before a capital, figure or opening mark, unless an abbreviation, a
    single letter or a dotted acronym precedes. One split with bounded look-behind, no state."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = rf"""(?U)(?<=[.!?])(?<!(?:^|\s)[(\["']{{0,3}}(?:(?i:{short})|\p{{L}}|(?i:(?:[a-z]\.){{1,6}}[a-z]))[(\["']{{0,3}}\.)\s+(?=[\p{{Lu}}\p{{Nd}}"'(\[“‘])"""
    return F.filter(F.transform(F.split(c, cut), strip), lambda s: s != "")


MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def marker_numbers(c: Column) -> Column:
    """Numbers of the inline markers ``[1]``, ``[1, 2]``, in order, once each."""
    groups = F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.try_cast("int")))))


def strip_markers(c: Column) -> Column:
    bare = F.regexp_replace(c, MARKER, "")
    tidy = F.regexp_replace(bare, r"(?U)\s+([.,;:!?])", "$1")
    return strip(F.regexp_replace(tidy, r"(?U)\s{2,}", " "))


def normalised(c: Column) -> Column:
    """Lower case, every other character than ``a-z0-9`` a blank, blanks folded."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def covers(answer: Column, aspect: Column) -> Column:
    """Is the aspect in the answer? Figures need whole tokens, words a substring of the normalised answer."""
    a, want = normalised(answer), normalised(aspect)
    return F.when(want == "", False).when(want.rlike("^[0-9 ]+$"), F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), want, F.lit(" ")))).otherwise(F.contains(a, want))


def canonical_number(c: Column) -> Column:
    """``12%``, ``12.0`` and ``012`` are ``12``; done on the digits, so large figures keep their spelling."""
    bare = F.regexp_replace(c, "%$", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    lead = F.regexp_replace(whole, r"^(-?)0+(?=\d)", "$1")
    return F.when(lead == "-0", "0").otherwise(lead)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?%?"), F.lit(0)), canonical_number))


def negated(c: Column) -> Column:
    return F.arrays_overlap(all_tokens(c), strings(NEGATIONS))


def citation_id(url: Column, snippet: Column) -> Column:
    return F.concat(F.lit("c_"), F.left(F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("|"), strip(F.coalesce(snippet, F.lit(""))))), F.lit(12)))


def claim_id(engine: Column, question_id: Column, index: Column, text: Column) -> Column:
    parts = F.concat(F.coalesce(engine, F.lit("")), F.lit("|"), F.coalesce(question_id, F.lit("")), F.lit("|"), index.cast("string"), F.lit("|"), strip(text))
    return F.concat(F.lit("cl_"), F.left(F.sha1(parts), F.lit(12)))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def kappa_reading(c: Column) -> Column:
    return F.when(c < 0.2, "poor").when(c < 0.4, "fair").when(c < 0.6, "moderate").when(c < 0.8, "substantial").otherwise("near-perfect")


def engine_name(kind: str, top_k: int, width: Column) -> Column:
    return F.format_string(f"{kind}-k{top_k}-c%d", width)


# -- figures, names and their surroundings -------------------------------------------------------------------------

FIGURE = r"\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\b"
YEAR = "^(?:1[89][0-9][0-9]|2[01][0-9][0-9]|2200)$"
#: Letters and digits beyond ASCII, as a class that Java and RE2 read alike.
FOREIGN = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def masked(c: Column) -> Column:
    """The text with every foreign letter or digit as ``_``: places stay, and a plain ``\\b`` sees them as parts of words."""
    return F.regexp_replace(c, FOREIGN, "_")


def spots(text: Column, pattern: str) -> Column:
    """``array<struct<before, token, after>>`` of the matches of an ASCII pattern: what stands before, at and after each."""

    def cut(tokens: Column, rests: Column) -> Column:
        # length of what precedes match i: the rests 0..i and the tokens 0..i-1
        upto = lambda i: F.aggregate(F.slice(rests, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(tokens, 1, i), F.lit(0), lambda n, x: n + F.length(x))
        one = lambda t, n: F.struct(F.substring(text, F.lit(1), n).alias("before"), t.alias("token"), F.substring(text, n + F.length(t) + 1, F.length(text)).alias("after"))
        return F.transform(tokens, lambda t, i: let(upto(i), lambda n: one(t, n)))

    return let(masked(text), lambda m: let(F.regexp_extract_all(m, F.lit(pattern), F.lit(0)), lambda t: let(F.split(m, pattern, -1), lambda r: cut(t, r))))


def word_before(before: Column, reach: int) -> Column:
    """The last ASCII word in the ``reach`` characters before a place, in lower case; "" where there is none."""
    return F.lower(F.regexp_extract(F.right(before, F.lit(reach)), "([A-Za-z]+)[^A-Za-z]*$", 1))


def states_figure(source: Column, figure: Column) -> Column:
    """Is the figure in the source as a whole token? A neighbouring digit or point makes it another (so a figure before a
    full stop does not count)."""
    return F.rlike(source, F.concat(F.lit("(?:^|[^0-9.])"), F.replace(figure, F.lit("."), F.lit("[.]")), F.lit("(?:[^0-9.]|$)")))


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` replaced; unchanged if there is none or ``old`` is empty."""
    where = F.instr(text, old)
    return F.when((F.length(old) > 0) & (where > 0), F.concat(F.substring(text, F.lit(1), where - 1), new, F.substring(text, where + F.length(old), F.length(text)))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    return F.when(F.length(part) > 0, F.try_divide(F.length(text) - F.length(F.replace(text, part, F.lit(""))), F.length(part)).cast("int")).otherwise(0)


def grouped_digits(value: Column, model: Column) -> Column:
    """A decimal in the shape of the figure ``model``: thousands grouped as there, a whole value without decimals, others
    with one."""
    whole = value == F.floor(value)
    plain = F.when(whole, F.floor(value).cast("string")).otherwise(F.round(value, 1).cast("decimal(32,1)").cast("string"))
    commas = F.when(whole, F.format_number(F.floor(value), 0)).otherwise(F.format_number(F.round(value, 1), 1))
    return F.when(F.contains(model, F.lit(",")), commas).otherwise(plain)


def draw(*key: Column) -> Column:
    """A number in [0, 1) from a hash of the key: the same on every partitioning and in every engine that has MD5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])), F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))


def drawn(options: Column, u: Column) -> Column:
    """The option that a draw points at; null where there is none."""
    return F.get(options, F.floor(u * F.size(options)).cast("int"))

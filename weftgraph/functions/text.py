"""Column functions on text: keys, normalisers, keyword queries, stems, snippets, blocks of context.

Everything is an expression of built-ins, so it stays inside code generation; the few functions that need a scan with
state or Unicode decomposition are Arrow UDFs in ``weftgraph.functions.pyfuncs``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keyword queries.
KEYWORD_STOPWORDS = "the a an is are was were who what when where why how of to in on for and or about tell me his her their this that with does do did".split()
# Words left out of the content words of a question.
CONTENT_STOPWORDS = (
    "a an the and or but if then than that this these those there here is are was were be been being am do does did done doing have has had having "
    "can could will would shall should may might must of in on at by for with without from to into onto over under about as it its he she they them him his her "
    "our their your my which who whom whose what when where why how not no nor so such own same too very just also one two both each other another any all some none"
).split()
#: Suffixes tried in this order by ``stem``; the first that fits is cut.
STEM_SUFFIXES = ("ations", "ation", "ings", "ing", "edly", "ed", "es")


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    """First 32 hex digits of the SHA-256 of document, index and text joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", document, index.cast("string"), text), 256), 1, 32)


def community_id(members: Column) -> Column:
    return F.concat(F.lit("com-"), F.substring(F.sha1(F.array_join(F.array_sort(members), "|")), 1, 12))


def rel_type(c: Column) -> Column:
    """Upper case with underscores; null becomes RELATED_TO."""
    return F.upper(F.replace(F.coalesce(c, F.lit("RELATED_TO")), F.lit(" "), F.lit("_")))


def safe_rel_type(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def entity_type(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(strip_ws(c)), F.lit("")), F.lit("UNKNOWN"))


def embed_text(name: Column, description: Column) -> Column:
    """``name — description`` without dashes and blanks at its ends."""
    joined = F.concat(F.coalesce(name, F.lit("")), F.lit(" — "), F.coalesce(description, F.lit("")))
    return F.regexp_replace(joined, "^[ —]+|[ —]+$", "")


def snippet(c: Column, most: int = 400) -> Column:
    """Texts above ``most`` characters end in an ellipsis."""
    short = F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(c) > most, short).otherwise(c)


def keyword_terms(c: Column) -> Column:
    """Distinct terms of a question in order: specials blanked, more than two characters, no stopwords."""
    plain = F.regexp_replace(F.lower(c), r'[+\-!(){}\[\]^"~*?:\\/]|&&|\|\|', " ")
    words = F.split(strip_ws(plain), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(KEYWORD_STOPWORDS)))


def keyword_query(c: Column) -> Column:
    return F.array_join(keyword_terms(c), " OR ")


def stem(w: Column) -> Column:
    """Light English stem: plural and verb endings, then a final s, then a final e."""
    n = F.length(w)
    cut = F.when(w.endswith("ies") & (n > 4), F.regexp_replace(w, "ies$", "y"))
    for s in STEM_SUFFIXES:
        cut = cut.when(w.endswith(s) & (n > len(s) + 2), F.regexp_replace(w, f"{s}$", ""))
    cut = cut.otherwise(w)
    cut = F.when(cut.endswith("s") & ~cut.endswith("ss") & (F.length(cut) > 3), F.regexp_replace(cut, "s$", "")).otherwise(cut)
    return F.when(cut.endswith("e") & (F.length(cut) > 4), F.regexp_replace(cut, "e$", "")).otherwise(cut)


def content_words(c: Column) -> Column:
    """Sorted distinct stems of the words of three characters or more that are no stopwords."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) >= 3) & ~w.isin(CONTENT_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(words, stem)))


def same_family(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4)))


def ascii_norm(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores (exact for ASCII names)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9_]", "")


def ascii_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]", " "), " +"), lambda t: t != "")


def token_subsequence(short: Column, long: Column) -> Column:
    """``short`` occurs in ``long`` in order and has fewer tokens."""
    start = F.struct(F.lit(0).alias("i"))
    end = F.aggregate(long, start, lambda s, t: F.struct(F.when(F.get(short, s["i"]) == t, s["i"] + 1).otherwise(s["i"]).alias("i")))
    return (F.size(short) < F.size(long)) & (end["i"] == F.size(short))


def containment(a: Column, b: Column) -> Column:
    """One name holds the other: its tokens in order, or its letters as a beginning of at least 0.6 of the length."""
    na, nb = ascii_norm(a), ascii_norm(b)
    ta, tb = ascii_tokens(a), ascii_tokens(b)
    short, long = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    prefix = long.startswith(short) & (F.length(short) / F.length(long) >= 0.6)
    return (na != nb) & (F.length(short) >= 3) & (token_subsequence(ta, tb) | token_subsequence(tb, ta) | prefix)


def block_keys(c: Column) -> Column:
    """First characters of the tokens and of the normalised name."""
    firsts = F.transform(ascii_tokens(c), lambda t: F.substring(t, 1, 1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(firsts, F.array(F.substring(ascii_norm(c), 1, 1))), lambda k: k != "")))


def clean_names(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, strip_ws), lambda x: x.isNotNull() & (x != "")))


def render_path(nodes: Column, rels: Column, forward: Column) -> Column:
    """``A -[R]-> B <-[S]- C``."""
    arrows = F.zip_with(rels, forward, lambda r, d: F.when(d, F.concat(F.lit(" -["), r, F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), r, F.lit("]- "))))
    steps = F.zip_with(F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))), arrows, lambda n, a: F.concat(a, n))
    return F.concat(F.element_at(nodes, 1), F.array_join(steps, ""))


def facts_found(context: Column, facts: Column) -> Column:
    """The facts that occur in the context, whatever their case, in their order."""
    low = F.lower(context)
    return F.filter(facts, lambda f: F.contains(low, F.lower(f)))

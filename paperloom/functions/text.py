"""Text functions: Column -> Column, all inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in papers, and in general text.
PAPER_STOPWORDS = "a an the and or of in on at to for with from by as is are was were be been being it its that this these those we our they their which such can may also however thus therefore".split()
STOPWORDS = """a an the and or but if then than that this these those of in on at to for with from by as is are was were be been being it its he she they them we you i not no nor so such up out over
under again further once here there all any both each few more most other some only own same too very can will just do does did doing have has had having would could should may might said says say
new news report reports update updates after before amid""".split()

# The token kinds of scientific text in the order in which they are tried.
SCIENCE_PATTERN = "|".join(
    [
        r"p\s*[<>=]\s*\d*\.?\d+",
        r"[<>]=?\s*\d+(?:\.\d+)?%?",
        r"\d+(?:\.\d+)?\s*[eE]\s*[-+]?\d+",
        r"\d+(?:\.\d+)?\^[-+]?\d+",
        r"\d+(?:\.\d+)?%",
        r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]",
        r"[a-z]+(?:[-_][a-z0-9]+)+",
        r"\d+(?:\.\d+)?\s*(?:[kmbgt]|ms|s|m|h|gb|mb|kb|b|px|pt|hz|khz|ghz|nm|um|mm|cm|km|mg|kg|ml|l|k)\b",
        r"\d+\.\d+",
        r"[a-z]+",
        r"\d+",
    ]
)

_LAST = 0x2FFF  # letters with marks, and signs that stand for several letters, lie below


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """From Unicode's own decompositions: characters that fold to one, those that fold to none, and those that fold to several."""
    one, to, none, several = [], [], [], []
    for code in [*range(0x80, _LAST), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Cs"):
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if len(folded) == 1:
            one.append(c)
            to.append(folded)
        elif not folded:
            none.append(c)
        elif code < 0x250 or code in (0x2026, 0x2122) or 0x2153 <= code <= 0x215E or code >= 0xFB00:
            several.append((c, folded))
    return "".join(one) + "".join(none), "".join(to), several


_FROM, _TO, _SEVERAL = _fold_tables()
_SEVERAL_CLASS = "[" + "".join(c for c, _ in _SEVERAL) + "]"


def fold_accents(c: Column) -> Column:
    """The text without accents and compatibility forms. ASCII texts pass through at the cost of one test."""
    several = c
    for char, to in _SEVERAL:
        several = F.replace(several, F.lit(char), F.lit(to))
    expanded = F.when(c.rlike(_SEVERAL_CLASS), several).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(expanded, _FROM, _TO)).otherwise(c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_text(c: Column) -> Column:
    """Lower case, no accents, single blanks; null counts as empty."""
    return squeeze(F.lower(fold_accents(F.coalesce(c, F.lit("")))))


def strip_html(c: Column) -> Column:
    """Tags as blanks, nine entities decoded in order, single blanks."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    # Entities in the order of decoding.
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&ldquo;", '"'), ("&rdquo;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def tokens(c: Column, drop_stopwords: bool = True) -> Column:
    """Words of letters and digits; by default without stopwords and single characters."""
    words = F.regexp_extract_all(normalise_text(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1)) if drop_stopwords else words


def science_tokens(c: Column, drop_stopwords: bool = True, keep_alnum: bool = False) -> Column:
    """Tokens of scientific text: numbers with units, p-values, powers and coded names stay whole. ``keep_alnum`` also keeps names like f1 and co2 whole."""
    pattern = SCIENCE_PATTERN.replace(r"|[a-z]+|\d+", r"|[a-z]+\d+[a-z0-9]*|[a-z]+|\d+") if keep_alnum else SCIENCE_PATTERN
    pattern = pattern.replace("[a-z]+(?:[-_]", "[a-z]++(?:[-_]")  # letters before a hyphen are all or none, so plain words fail at once
    found = F.transform(F.regexp_extract_all(normalise_text(c), F.lit(pattern), F.lit(0)), lambda t: F.replace(t, F.lit(" "), F.lit("")))  # blanks are the only white space here
    long_enough = lambda t: (F.length(t) > 1) | t.rlike(r"^\d$")
    return F.filter(found, lambda t: ~t.isin(PAPER_STOPWORDS) & long_enough(t)) if drop_stopwords else F.filter(found, long_enough)


def slugify(c: Column, most: int = 72) -> Column:
    """Lower-case words joined by hyphens, cut at a word."""
    slug = F.trim(F.regexp_replace(normalise_text(c), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(slug, 1, most)
    cut = F.when(F.length(slug) > most, F.regexp_replace(cut, "-[^-]*$", "")).otherwise(slug)
    return F.when(cut == "", F.lit("item")).otherwise(cut)


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    """At most ``most`` characters with the suffix, cut at a blank."""
    text = F.trim(F.coalesce(c, F.lit("")))
    cut = F.substring(text, 1, max(0, most - len(suffix)))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit(suffix)))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+")).cast("long")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


# Signs of PDF text layers and what they stand for.
_PDF_SEVERAL = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}
_PDF_ONE = {"‘": "'", "’": "'", "“": '"', "”": '"', "\u2212": "-", "\u02c6": "^"}
_PDF_NONE = "\u200b\u200c\u200d\ufeff"
#: Every blank of Unicode but the plain one.
_BLANKS = "".join(chr(k) for k in range(0x80, 0x3001) if unicodedata.category(chr(k)) == "Zs")


def clean_pdf_text(c: Column) -> Column:
    """Ligatures, quotes, signs and blanks made plain, words joined that a hyphen and a line end divide, soft line ends as blanks (not behind the end of a sentence or clause, nor before empty lines, bullets and digits), runs of blanks as one."""
    out = F.translate(F.coalesce(c, F.lit("")), "".join(_PDF_ONE) + _BLANKS + _PDF_NONE, "".join(_PDF_ONE.values()) + " " * len(_BLANKS))
    for char, to in _PDF_SEVERAL.items():
        out = F.replace(out, F.lit(char), F.lit(to))
    out = F.regexp_replace(out, r"(?U)(\w)[-‐‑]\s*\n\s*(\w)", "$1$2")
    out = F.regexp_replace(out, r"(?<![.!?:;])\n(?![\n•*\-\d])", " ")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


# What a full stop does not end a sentence behind, beside a capital and a small letter ("Dr.").
_ABBREVIATIONS = ["e.g", "i.e", "cf", "vs", "Fig", "Eq", "Tab", "Sec", "Ref", "al", "No", "pp", "vol"]
SENTENCE_PATTERN = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')}\.)" for a in _ABBREVIATIONS) + r"(?<![A-Z][a-z]\.)(?<=[.!?])[\s ]+(?=[A-Z“(\[])"


def sentences(c: Column) -> Column:
    """The sentences of a text, not cut behind common abbreviations."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), SENTENCE_PATTERN), lambda s: s != "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the normalised text without tags."""
    return F.sha2(F.encode(normalise_text(strip_html(c)), "UTF-8"), 256)


def file_hash(c: Column) -> Column:
    """SHA-256 of bytes."""
    return F.sha2(c, 256)


def strip_nul(c: Column) -> Column:
    """A text without NUL characters."""
    return F.translate(c, "\u0000", "")


def normalise_brackets(c: Column) -> Column:
    """Lenticular, fullwidth, ornamental and white square brackets as plain ones."""
    return F.translate(c, "【】［］❨❩〚〛", "[][][][]")


# Hyphens and dashes that aren't ASCII.
_DASH = "[\u2010\u2011\u2012\u2013\u2014\u2015]"


def sanitise_output(c: Column) -> Column:
    """Typographic dashes made plain: between digits as "to", at a line's start a hyphen behind the same indent, between blanks a comma, elsewhere a hyphen; a comma behind other punctuation goes."""
    for pattern, to in ((rf"(?<=\d)\s*{_DASH}\s*(?=\d)", " to "), (rf"(?m)^([ \t]*){_DASH}[ \t]+", "$1- "), (rf"[ \t]+{_DASH}[ \t]+", ", "), (_DASH, "-"), (r"([,;:])[ \t]*,[ \t]+", "$1 ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def coerce_json(c: Column) -> Column:
    """A variant from a model's raw answer: the text itself without fences, else its outermost object, else its outermost list; null if none is JSON."""
    bare = F.trim(F.regexp_replace(c, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.coalesce(F.try_parse_json(bare), *(F.try_parse_json(F.regexp_extract(bare, rf"(?s)(\{a}.*\{b})", 1)) for a, b in ("{}", "[]")))


def unwrap_list(c: Column, element: str = "string") -> Column:
    """The list in an answer: the answer itself if it is one, else the first of the usual keys that holds one, else the only list that it holds; else an object with a plain value as a list of one; else an empty list.
    ``element`` is the type of its members in SQL."""
    # Keys under which answers put their list, in the order in which they are tried.
    keys = ["items", "rows", "results", "data", "list", "entries", "records", "articles", "stories", "events", "themes", "entities", "bullets", "output"]
    kind = f"array<{element}>"
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    values = F.map_values(F.try_variant_get(c, "$", "map<string,variant>"))
    lists = F.filter(values, is_list)
    plain = F.exists(values, lambda v: ~F.coalesce(F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)"), F.lit(False)))
    named = [F.when(is_list(F.try_variant_get(c, f"$.{k}", "variant")), F.try_variant_get(c, f"$.{k}", kind)) for k in keys]
    whole = F.when(is_list(c), F.try_variant_get(c, "$", kind))
    only = F.when(F.size(lists) == 1, F.try_variant_get(F.get(lists, F.lit(0)), "$", kind))
    row = F.when(plain, F.array(F.coalesce(F.try_variant_get(c, "$", element), F.to_json(c).cast(element) if element == "string" else F.lit(None).cast(element))))
    return F.coalesce(whole, *named, only, row, F.array().cast(kind))


def highlight(text: Column, query: Column, window: int = 220, most: int = 20) -> Column:
    """Snippets around whole-token hits of the query's terms, cut at blanks: array of (start, snippet). Hits closer than half a window share a snippet.

    Accents are folded one to one before the search, so offsets hold in the text itself.
    """
    folded = F.lower(F.translate(text, _FROM[: len(_TO)], _TO))
    terms = F.filter(F.array_distinct(science_tokens(query)), lambda t: F.length(t) > 1)
    pattern = F.concat(F.lit(r"(?<![a-z0-9])(?:"), F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|"), F.lit(r")(?![a-z0-9])"))
    parts = F.split(folded, pattern)
    ends = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.expr("cast(array() as array<int>)"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p))))
    far = F.aggregate(ends, F.expr("cast(array() as array<int>)"), lambda acc, p: F.when((F.size(acc) == 0) | (p >= F.try_element_at(acc, F.lit(-1)) + window // 2), F.concat(acc, F.array(p))).otherwise(acc))
    start = lambda p: F.greatest(F.lit(0), p - window // 2)
    cut = F.transform(F.slice(far, 1, most), lambda p: F.struct(start(p).alias("start"), F.trim(F.regexp_replace(F.substring(text, start(p) + 1, F.lit(window)), r"^\S*\s|\s\S*$", "")).alias("snippet")))
    return F.when(F.size(terms) > 0, cut).otherwise(F.expr("cast(array() as array<struct<start:int,snippet:string>>)"))


# Identifiers as their registries write them.
ARXIV = r"(?:(?:[a-z-]+(?:\.[a-z]{2})?/)?\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})"
DOI = r"10\.\d{4,9}/\S+"


def identify(c: Column) -> Column:
    """What a pasted identifier is: (kind, id, url) with kind arxiv, doi, url or unknown. An arXiv id keeps its version; a link to arXiv gives the id without one."""
    text = F.trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(text, r"(?i)^arxiv[:\s]*", "")
    linked = F.regexp_extract(text, rf"(?i)arxiv\.org/(?:abs|pdf|html)/({ARXIV})", 1)
    arxiv = F.when(bare.rlike(rf"(?i)^{ARXIV}(?:v\d+)?$"), bare).otherwise(linked)
    doi = F.regexp_extract(text, rf"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?({DOI})$", 1)
    kind = F.when(arxiv != "", "arxiv").when(doi != "", "doi").when(text.rlike("(?i)^https?://[^/]+"), "url").otherwise("unknown")
    ident = F.when(arxiv != "", arxiv).when(doi != "", doi).otherwise(text)
    url = F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).when(kind == "url", text).otherwise(F.lit(""))
    return F.struct(kind.alias("kind"), ident.alias("id"), url.alias("url"))


def safe_filename(c: Column, most: int = 120) -> Column:
    """Letters, digits, hyphens, underscores, dots and blanks of a name, at most ``most`` of them."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9\-_. ]", "")), 1, most)


def grid_to_markdown(grid: Column) -> Column:
    """A grid of cells as a Markdown table: ragged rows padded, bars escaped, the first row as its head."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(pad(r), lambda x: F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(line(grid[0]), rule), F.transform(F.slice(grid, 2, 1 << 30), line)), "\n")).otherwise(F.lit(""))


def grid_to_html(grid: Column) -> Column:
    """A grid of cells as an HTML table: the first row as its head, markup escaped."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))

    def escape(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(pad(r), lambda x: F.concat(F.lit(f"<{tag}>"), escape(F.coalesce(x, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.when(F.size(grid) > 0, F.concat(F.lit("<table>"), row(grid[0], "th"), F.array_join(F.transform(F.slice(grid, 2, 1 << 30), lambda r: row(r, "td")), ""), F.lit("</table>"))).otherwise(F.lit(""))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two titles' sets of words; 0 if either has none."""
    x, y = F.array_distinct(tokens(a, False)), F.array_distinct(tokens(b, False))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

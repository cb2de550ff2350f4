"""Scalar text functions as Columns: stripping, headings, page labels, words, languages, numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, word lists and constants that results depend on ---
NAMED_HEADING = r"(?i)^(?:chapter|part|section|article|appendix|exhibit|schedule)\s+[\w.\-]+"
NUMBERED_HEADING = r"^\d+(?:\.\d+)+\s+\S"
SIMPLE_NUMBERED = r"^\d+\.\s+[A-Z].{0,80}$"
ROMAN_HEADING = r"^[IVXLCM]+\.\s+\S"
ALL_CAPS = r"^[A-Z][A-Z0-9 ,.'-]{8,80}$"
LIST_ITEM = r"^(?:[-*•] |\d+[.)]\s)"
WHOLE_FRACTION = r"(?i)^(?:page\s*)?(\d+)\s*(?:of|/)\s*(\d+)\s*$"
P_FRACTION = r"(?i)^p\.?\s*(\d+)\s*(?:of|/)\s*(\d+)\s*$"
PAGE_FRACTION = r"(?i)^page\s*(\d+)\s*(?:of|/)\s*(\d+)\s*$"
BARE_NUMBER = r"(?i)^\s*(?:page\s*)?(\d{1,4})\s*$"
LABELLED_NUMBER = r"(?i)^\s*(?:(?:page|p\.?)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])\s*$"
TRAILING_LABEL = r"(?is)^(.*\S)\s+((?:page\s*|p\.?\s*)\d+\s*(?:of|/)\s*\d+)\s*$"
STOPWORDS = {
    "en": "the of and to in is that for it as with was on be by are this from or an at not which have has were their they will would there these been shall may",
    "de": "der die und den das ist nicht von mit sich des auf für ein eine dem zu im auch sind wird werden oder bei nach wie aus",
    "fr": "le la les des et est une un du pour dans que qui sur pas par au avec sont ce il elle ou aux cette",
    "es": "el la los las de y en que es por un una para con del se al lo como su más o son está",
    "it": "il la di che e un una per con del della non sono le gli dei nel alla è si da come questo",
    "nl": "de het een en van is dat op te in voor niet met zijn er aan ook als bij door wordt worden",
    "pt": "o a os as de e do da em um uma para com não que se no na por mais dos das é",
}
GENERIC = "that this with from have were been their they will would there these which other into more such than when also some only about over under after before between through each most being both same where while because could should does upon within without total year years page pages table figure note notes section shall article chapter part"
ARTICLE = r"(?i)^(article)\s+([IVXLCDM]+|\d{1,3})\.?(?:\s+|$)"
SECTION_NUMBER = r"(?i)^section\s+(\d{1,3}(?:\.\d{1,3})*)\.?(?:\s+|$)"
OUTLINE = r"^(\d{1,3}(?:\.\d{1,3})*)\.?(?:\s+|$)"
NUMBER = r"\d+(?:\.\d+)?|\.\d+"
CUE = r"(?i)\b(?:probability|chance|likelihood|score|p)\b"
BAND_LABEL = r"(?i)^\s*(?:(?:page|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])\s*$"
MIN_CHARS, MIN_WORDS, MIN_LANGUAGE_WORDS, MIN_LETTERS = 40, 40, 20, 30
# --- end of fixed values ---

IGNORED = sorted({w for s in STOPWORDS.values() for w in s.split() if len(w) >= 4} | set(GENERIC.split()))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: higher-order functions take no part in common subexpressions."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, as Unicode sees it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def stripped_length(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit(""))))


def page_class(text: Column) -> Column:
    """text, mixed or scan, with a confidence, by the length of the text layer."""
    n = stripped_length(text)
    return F.struct(
        F.when(n >= MIN_CHARS, "text").when(n > 0, "mixed").otherwise("scan").alias("page_class"),
        F.when(n >= MIN_CHARS, 0.7).when(n > 0, 0.45).otherwise(0.6).alias("confidence"),
        (n > 0).alias("has_text_ops"),
    )


def split_blocks(text: Column) -> Column:
    """Array of the blocks of a plain text: split at blank lines, or at lines if that leaves nothing."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    parts = F.filter(F.transform(F.split(clean, r"\n\s*\n"), strip), lambda x: x != "")
    lines = F.filter(F.transform(F.split(clean, "\n"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(lines)


def is_heading(text: Column) -> Column:
    return text.rlike(NAMED_HEADING) | text.rlike(NUMBERED_HEADING) | text.rlike(SIMPLE_NUMBERED) | text.rlike(ROMAN_HEADING) | text.rlike(ALL_CAPS)


def block_kind(text: Column, first_of_bundle: Column) -> Column:
    """kind and heading level of a stripped block."""
    one_line = ~text.contains("\n")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    title = first_of_bundle & (F.length(text) < 140) & one_line
    heading = one_line & is_heading(text)
    level = F.least(F.when(text.rlike(r"^\d"), dots + 1).otherwise(F.lit(1)), F.lit(6))
    return F.struct(
        F.when(title, "title").when(heading, "heading").when(text.rlike(LIST_ITEM), "list_item").otherwise("paragraph").alias("kind"),
        F.when(title, 0).when(heading, level).cast("int").alias("heading_level"),
    )


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), strip), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def _pair(text: Column, pattern: str) -> Column:
    number = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    return F.when(text.rlike(pattern), F.struct(number(1).alias("num"), number(2).alias("total")))


def page_fraction(text: Column) -> Column:
    """(num, total) if the first line that isn't blank is a page label as a whole."""
    line = first_line(text)
    return F.coalesce(_pair(line, WHOLE_FRACTION), _pair(line, P_FRACTION))


def keyword_fraction(text: Column) -> Column:
    """(num, total) of a label that says page or p."""
    s = strip(text)
    return F.coalesce(_pair(s, P_FRACTION), _pair(s, PAGE_FRACTION))


def bare_number(text: Column) -> Column:
    return F.when(text.rlike(BARE_NUMBER), F.regexp_extract(text, BARE_NUMBER, 1).try_cast("int"))


def trailing_label(line: Column) -> Column:
    """(body, label) if the line ends in a keyword page label; the shortest such end."""
    s = F.regexp_replace(line, r"(?U)\s+$", "")
    return F.when(s.rlike(TRAILING_LABEL), F.struct(F.regexp_extract(s, TRAILING_LABEL, 1).alias("body"), F.regexp_extract(s, TRAILING_LABEL, 2).alias("label")))


def page_number(blocks: Column) -> Column:
    """(num, total) of a page from its blocks (kind, text): tagged numbers, then furniture and short paragraphs, then the last two blocks."""
    tagged = F.filter(blocks, lambda b: b["kind"] == "page_number")
    from_tag = F.filter(F.transform(tagged, lambda b: F.coalesce(page_fraction(b["text"]), F.when(bare_number(b["text"]).isNotNull(), F.struct(bare_number(b["text"]).alias("num"), F.lit(None).cast("int").alias("total"))))), lambda x: x.isNotNull())
    near = F.filter(blocks, lambda b: b["kind"].isin("page_number", "footer", "header") | ((b["kind"] == "paragraph") & (F.length(b["text"]) <= 40)))
    found = lambda a: F.try_element_at(F.filter(F.transform(a, lambda b: page_fraction(b["text"])), lambda x: x.isNotNull()), F.lit(1))
    last = F.when(F.size(blocks) <= 2, blocks).otherwise(F.slice(blocks, -2, 2))
    return F.coalesce(F.try_element_at(from_tag, F.lit(1)), found(near), found(last))


def _runs(text: Column, least: int = 1) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(text, F.lit(rf"([\p{{L}}\p{{Nl}}\p{{No}}]{{{least},}})"), F.lit(1))


def words_of(text: Column, least: int = 1) -> Column:
    """Runs of letters, lower-cased."""
    return F.transform(_runs(text, least), F.lower)


def _bigrams(text: Column) -> Column:
    """Bigrams of the runs of CJK characters; texts of single bytes have none and aren't searched."""
    runs = F.regexp_extract_all(text, F.lit(r"([぀-ヿ㐀-䶿一-鿿가-힯]{2,})"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: r.substr(k, F.lit(2)))))
    return F.when(F.octet_length(text) > F.length(text), grams).otherwise(F.array().cast("array<string>"))


def content_words(text: Column) -> Column:
    """The content words of a text, repeats included; runs of CJK characters give their bigrams."""
    return F.concat(F.filter(words_of(text, 4), is_content), _bigrams(text))


def content_runs(text: Column) -> Column:
    """What gives the content words once it is lower-cased and those that aren't ``is_content`` are dropped: less work where words become rows."""
    return F.concat(_runs(text, 4), _bigrams(text))


def is_content(word: Column) -> Column:
    return ~word.isin(*IGNORED)


def language_hits(words: Column) -> Column:
    """Array of (hits, lang) for all languages, best first; of equal hits the later name first."""
    hit = lambda stop: F.size(F.filter(words, lambda w: w.isin(*stop)))
    return F.sort_array(F.array(*(F.struct(hit(s.split()).alias("hits"), F.lit(lang).alias("lang")) for lang, s in STOPWORDS.items())), asc=False)


def detect_language(text: Column) -> Column:
    """A careful guess, or null for short or mixed texts; by script first, then by stop words."""
    return let(F.regexp_replace(text, r"[^\p{L}]+", ""), lambda letters: _language(text, letters))


def _language(text: Column, letters: Column) -> Column:
    n = F.length(letters)
    count = lambda cls: n - F.length(F.regexp_replace(letters, f"{cls}+", ""))
    scripts = {"latin": "[\\x00-\\u024f]", "kana": "[\\u3040-\\u30ff]", "han": "[\\u3400-\\u9fff]", "hangul": "[\\uac00-\\ud7af]", "cyrillic": "[\\u0400-\\u04ff]", "greek": "[\\u0370-\\u03ff]", "arabic": "[\\u0600-\\u06ff]", "hebrew": "[\\u0590-\\u05ff]"}
    share = {k: count(v) for k, v in scripts.items()}
    wins = lambda k: share[k] >= 0.6 * n
    best = lambda n_words, h: F.when((n_words >= MIN_LANGUAGE_WORDS) & (h[0]["hits"] >= 0.15 * n_words) & (h[0]["hits"] >= 2 * h[1]["hits"]), h[0]["lang"])
    every = sorted({w for s in STOPWORDS.values() for w in s.split()})
    latin = let(words_of(text), lambda w: let(language_hits(F.filter(w, lambda x: x.isin(*every))), lambda h: best(F.size(w), h)))
    # At most one script can win: the common one is asked for first.
    guess = F.when(wins("latin"), latin).when(wins("kana") | (wins("han") & (share["kana"] >= 0.05 * n)), "ja")
    for k in ("han", "hangul", "cyrillic", "greek", "arabic", "hebrew"):
        guess = guess.when(wins(k), k)
    return F.when(n >= MIN_LETTERS, guess)


def same_language(a: Column, b: Column) -> Column:
    pair = lambda x, y: (a == x) & (b == y)
    return F.coalesce(a.isNull() | b.isNull() | (a == "") | (b == "") | (a == b) | pair("ja", "han") | pair("han", "ja"), F.lit(True))


def edge_key(line: Column) -> Column:
    """A line with one space between words and # for numbers, lower-cased."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(line)), r"(?U)\s+", " "), r"\d+", "#")


def footer_key(line: Column) -> Column:
    words = F.size(F.regexp_extract_all(line, F.lit("([A-Za-z]{2,})"), F.lit(1)))
    return F.when((F.length(line) > 80) | (words < 2), "").otherwise(edge_key(line))


def fold(text: Column, limit: int) -> Column:
    return F.substring(F.regexp_replace(text, "\n", " "), 1, limit)


def truncate_two_places(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x * 100)).otherwise(F.ceil(x * 100)) / 100


def roman(text: Column) -> Column:
    """The value of a roman numeral of 1 to 999 in its usual form; null otherwise."""
    t = F.upper(text)
    values = F.transform(F.split(t, ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000).otherwise(0))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.try_element_at(values, i + 2), F.lit(0)), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda s, v: s + v)
    return F.when(t.rlike(r"^(?=[CDILVXM])(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def numbering(heading: Column) -> Column:
    """(depth, parts, token) of an outline number at the start of a heading's first line; null without one.

    Decimal outlines keep their digits as written ("1.01" isn't "1.1"); a first part above 99 is a year or an amount.
    Articles count 1 to 999, arabic or roman, are of depth 1 and have no parts.
    """
    line = F.split(heading, "\n")[0]
    word, value = (F.regexp_extract(line, ARTICLE, k) for k in (1, 2))
    counts = F.coalesce(value.try_cast("int"), roman(value)).between(1, 999)
    article = F.when(counts, F.struct(F.lit(1).alias("depth"), F.lit(None).cast("array<string>").alias("parts"), F.concat(word, F.lit(" "), value).alias("token")))
    number = F.coalesce(F.nullif(F.regexp_extract(line, SECTION_NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract(line, OUTLINE, 1), F.lit("")))
    parts = F.split(number, r"\.")
    decimal = F.when(parts[0].try_cast("int") <= 99, F.struct(F.size(parts).alias("depth"), parts.alias("parts"), number.alias("token")))
    return F.when(line.rlike(ARTICLE), article).otherwise(decimal)


def sentence_probability(text: Column) -> Column:
    """The one number in a sentence as a probability: no minus, no percent; without a point it needs a cue word."""
    one = F.size(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))) == 1
    before, token, after = (F.regexp_extract(text, f"(?s)^(.*?)({NUMBER})(.*)$", k) for k in (1, 2, 3))
    refused = before.rlike(r"(?U)[-\u2212]\s*$") | after.rlike(r"(?iU)^\s*(?:%|percent\b|per cent\b)")
    value = token.try_cast("double")
    return F.when(one & ~refused & (token.contains(".") | text.rlike(CUE)) & value.between(0, 1), value)


def one_space(text: Column) -> Column:
    """Words joined by one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))

"""Text and markdown functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a query's tokens leave out (fixed values).
STOP_WORDS = (
    "a an and are about as at be by can could did do does for from had has have how i in is it its know me my of on or our"
    " should so that the their them there they this to us was we were what when where which who why will with would you your"
).split()


def tokens(text: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS), least: int = 2) -> Column:
    """Lower-case runs of letters and digits of ASCII, without stop words and shorter ones; hyphens and underscores split."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    listed = F.array(*[F.lit(x) for x in stop])
    return F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(listed, t))


def exploded_tokens(rows: DataFrame, text: str = "text", stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS), least: int = 2) -> DataFrame:
    """``rows`` without ``text``, one for each of its ``tokens`` as ``term``: stop words are a set that compiled code asks."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    each = rows.select(*[c for c in rows.columns if c != text], F.explode(found).alias("term"))
    return each.where((F.length("term") >= least) & ~F.col("term").isin(list(stop)))


def match_expression(text: Column, style: str = "prefix") -> Column:
    """The full-text query of a text: ``bare`` words, ``prefix`` terms joined by AND, or ``quoted``; null if no token is left."""
    found = tokens(text)
    if style == "bare":
        joined = F.array_join(found, " ")
    elif style == "quoted":
        joined = F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")
    else:
        joined = F.array_join(F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " AND ")
    return F.when(F.size(found) > 0, joined)


def split_words(text: Column) -> Column:
    """Runs between white space, none empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """0 for no words, else 1.3 tokens a word rounded down, 1 at least."""
    n = F.size(split_words(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.3)).cast("int")))


def truncate_tokens(text: Column, most: int) -> Column:
    """The text if it has at most ``most / 1.3`` words, else so many of its words and a mark."""
    words, n = split_words(text), int(most / 1.3)
    return F.when(F.size(words) <= n, text).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" ... [truncated]")))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words with single spaces between; what is behind them isn't read."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^((?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{0,{n}}}+)", 1)
    return F.array_join(F.slice(split_words(head), 1, n), " ")


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def heading_slug(text: Column, most: int = 60) -> Column:
    """A slug of ASCII letters and digits, cut to ``most`` characters without a hyphen at its end."""
    return F.regexp_replace(F.left(slugify(text), F.lit(most)), "-+$", "")


def kebab_case(name: Column) -> Column:
    """Camel case split, spaces, dots and underscores to hyphens, other signs dropped, all lower."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), r"[\s_.]+", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(split), "[^a-z0-9-]", ""), "-{2,}", "-"), F.lit("-"))


def title_key(title: Column) -> Column:
    """The form in which titles are compared: without ``.md``, lower case, runs of spaces, hyphens and underscores as one hyphen."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\.md$", ""), r"[-_\s]+", "-"), F.lit("-"))


def display_name(stem: Column) -> Column:
    """A name to show: hyphens and underscores as spaces, each word's first letter upper."""
    spaced = F.btrim(F.regexp_replace(stem, r"[-_\s]+", " "))
    return F.array_join(F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def frontmatter(text: Column) -> Column:
    """The block between leading ``---`` lines, null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1), F.lit(""))


def frontmatter_map(text: Column) -> Column:
    """Flat ``key: value`` lines as a map, later keys first of all; quotes around a value go."""
    lines = F.filter(F.split(F.coalesce(frontmatter(text), F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.btrim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.btrim(F.regexp_replace(x, r"^[^:]+:", ""), F.lit(" \t\"'")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def with_frontmatter(text: Column, fields: dict[str, Column]) -> Column:
    """The text under a block of these fields, in their order, in place of any that it has; the title stands in quotes, a null value is empty.

    Quotes in a title are marked, line feeds in values become spaces, and blank lines before the body go. A null text is empty.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    shown = lambda name, c: F.concat(F.lit(f'{name}: "'), F.replace(flat(c), F.lit('"'), F.lit('\\"')), F.lit('"')) if name == "title" else F.concat(F.lit(f"{name}: "), flat(c))
    body = F.ltrim(without_frontmatter(F.coalesce(text, F.lit(""))), F.lit(" \t\r\n"))
    return F.concat(F.lit("---\n"), *[F.concat(shown(name, c), F.lit("\n")) for name, c in fields.items()], F.lit("---\n\n"), body)


#: Marks around the body of an e-book of Project Gutenberg (fixed patterns).
BOOK_STARTS, BOOK_ENDS = r"(?i)\*\*\*\s*START OF (?:THE |THIS )?PROJECT GUTENBERG.*?\*\*\*", r"(?i)\*\*\*\s*END OF (?:THE |THIS )?PROJECT GUTENBERG.*?\*\*\*"


def book_body(text: Column) -> Column:
    """What stands between the first marks of an e-book's start and, behind it, end; all of a text without them, and to its bounds where one lacks."""
    after = F.when(text.rlike(BOOK_STARTS), F.array_join(F.slice(F.split(text, BOOK_STARTS, 2), F.lit(2), F.lit(1)), "")).otherwise(text)
    return F.btrim(F.get(F.split(after, BOOK_ENDS, 2), F.lit(0)), F.lit(" \t\r\n"))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and those without, by what Unicode makes of them."""
    import unicodedata

    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, UNMARKED = _plain_letters()


def folded(text: Column) -> Column:
    """Letters without their marks, so that a word is one with and without accents; combining marks go."""
    return F.regexp_replace(F.translate(text, MARKED, UNMARKED), "[\u0300-\u036f]", "")


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", "")


def snippet(text: Column, n: int = 300) -> Column:
    """The first ``n`` characters behind a leading block of metadata."""
    parts = F.split(text, "---", 3)
    body = F.when(F.startswith(text, F.lit("---")) & (F.size(parts) == 3), F.btrim(F.element_at(parts, -1), F.lit(" \t\r\n"))).otherwise(text)
    return F.left(body, F.lit(n))


def extract_title(text: Column, stem: Column) -> Column:
    """The metadata's title, else the first heading of level 1 to 3 under 200 characters (links as their text), else the file's name."""
    heading = F.regexp_extract(without_frontmatter(text), r"(?m)^#{1,3}[ \t]+(.+?)[ \t]*$", 1)
    shown = F.regexp_replace(heading, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.coalesce(
        F.nullif(F.try_element_at(frontmatter_map(text), F.lit("title")), F.lit("")),
        F.when((F.length(shown) > 0) & (F.length(shown) < 200), shown), F.nullif(display_name(stem), F.lit("")), F.lit("Untitled"),
    )


def clean_markdown(text: Column) -> Column:
    """Line ends, badges, links in HTML, comments, images and inline tags out; four and more line feeds become three."""
    steps = [
        (r"\r\n?", "\n"),
        (r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"),
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)<img\b[^>]*>", ""),
        (r"(?i)</?(?:b|i|em|strong|span|div|p|br|sup|sub|center|u|font|small|details|summary)\b[^>]*>", ""),
        (r"\n{4,}", "\n\n\n"),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.concat(F.btrim(text, F.lit(" \t\n")), F.lit("\n"))


def split_sections(text: Column, marks: str = "##") -> Column:
    """(heading, body) of each part before and under ``marks`` headings, empty bodies dropped."""
    parts = F.split(text, rf"(?m)^{marks} ")
    made = F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("")).otherwise(F.btrim(F.substring_index(p, "\n", 1))).alias("heading"),
        F.btrim(F.when(i == 0, p).when(F.contains(p, F.lit("\n")), F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).otherwise(F.lit("")), F.lit(" \t\r\n")).alias("body")))
    return F.filter(made, lambda s: s["body"] != "")


def chunk_text(text: Column, size: int) -> Column:
    """(seq, pos, text) chunks of ``size`` characters; blank ones dropped, ``seq`` without gaps."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int"))
    made = F.filter(F.transform(starts, lambda i: F.struct((i * size).alias("pos"), F.substring(text, i * size + 1, F.lit(size)).alias("text"))), lambda c: F.btrim(c["text"]) != "")
    return F.transform(made, lambda c, i: F.struct(i.alias("seq"), c["pos"].alias("pos"), c["text"].alias("text")))


def claims(text: Column) -> Column:
    """(pos, text, score) of sentences: capitalised words and modal ones at 0.6, over the words, eight at least."""
    parts = F.split(F.btrim(text), r"(?<=[.!?])\s+(?=[A-Z])")
    words = lambda s: F.greatest(F.size(split_words(s)), F.lit(8))
    score = lambda s: (F.regexp_count(s, F.lit(r"\b[A-Z][a-z]+")) + 0.6 * F.regexp_count(s, F.lit(r"(?i)\b(?:must|will|shall|always|never|is|are)\b"))) / words(s)
    return F.transform(F.filter(parts, lambda s: F.length(F.btrim(s)) > 0), lambda s, i: F.struct(i.alias("pos"), s.alias("text"), score(s).alias("score")))


def json_score(text: Column, key: str = "score") -> Column:
    """The number under ``key`` in the first flat JSON object of a text, between 0 and 1; null if there is none."""
    found = F.get_json_object(F.regexp_extract(text, r"(\{[^{}]*\})", 1), f"$.{key}").try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def sanitise_prompt(text: Column, most: int = 1000) -> Column:
    """Role marks out, line feeds to spaces, at most ``most`` characters."""
    plain = F.regexp_replace(text, r"(?i)<\|?/?(?:system|user|assistant|im_start|im_end)\|?>|\b(?:system|assistant|user)\s*:", "")
    return F.left(F.btrim(F.regexp_replace(plain, r"\s*[\r\n]+\s*", " ")), F.lit(most))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters, lower-case; a shorter text is its own. The characters are split once a text."""

    def runs(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - (n - 1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), "")))

    return F.element_at(F.transform(F.array(F.split(F.lower(text), "")), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct values; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def finite(x: Column) -> Column:
    """0 for what is not a number or not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

"""Text functions as Column expressions: they stay inside the JVM and work on any string column."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from terms (emoticons, symbols and pictographs, transport, flags, supplemental
# symbols, dingbats, the two variation selectors, the zero-width joiner).
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}"
    r"\x{2702}-\x{27B0}\x{FE0F}\x{FE0E}\x{200D}]+"
)
# Marks that may lead a list item.
LIST_MARKS = r"(?:[-•·*▪▸◦‣⁃]|\d+[.)]|[a-z][.)]|[ivxlcdm]+[.)])"
# Forms of a line that belongs to a table of contents or is a page number (where two stand together,
# both must be met).
CONTENTS_LINES = (
    r"\.{5,}",
    (r"^\s*\d+(?:\.\d+)*\s+.*?\s+\d+\s*$", r"[\s.]{3,}\d+\s*$"),
    r"^\s*\.+\s*\d+\s*$",
    r"^\s*\d+(?:\.\d+)*\s+.*?\.{3,}",
    r"(?i)^\s*page\s+\d+\s*(?:of|/)\s*\d+\s*$",
    r"^\s*\d+\s*(?:of|/)\s*\d+\s*$",
    r"(?i)^\s*page\s+\d+\s*$",
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$",
)
# Fixed value: the mark of a cut text.
TRUNCATED = "\n\n[... truncated to fit token limit ...]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def normalize_term(term: Column) -> Column:
    """A term's key: lower case, no emoji, no parentheses, no leading list marks, single spaces, no outer hyphens.

    Hyphens are stripped before blanks are, so a hyphen behind a trailing blank goes and one before it stays.
    """
    steps = (
        (EMOJI, ""),
        (r"(?U)\s*\([^)]*\)", ""),
        (rf"(?U)^(?:\s*{LIST_MARKS}\s*)+", ""),
        (r"(?U)\s+", " "),
        (r"^-+|-+$", ""),
    )
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, *map(F.lit, step)), steps, F.lower(term)))


def count_words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def count_substring(text: Column, part: Column) -> Column:
    """Occurrences of part in text that don't overlap; an empty part occurs before each character and at the end."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise((gone / F.greatest(F.length(part), F.lit(1))).cast("int")).cast("long")


def whole_word(term: Column) -> Column:
    """A pattern that finds a term (lower-cased) between word boundaries."""
    return F.concat(F.lit(r"(?U)\b\Q"), F.replace(F.lower(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))


def term_positions(term: Column, text: Column) -> Column:
    """Starts (from 0) of the whole-word occurrences of a term in a text, ignoring case."""
    size = F.length(F.lower(term))
    parts = F.split(F.lower(text), whole_word(term), F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        at = s["at"] + F.length(part)
        return F.struct((at + size).alias("at"), F.concat(s["found"], F.array(at)).alias("found"))

    found = F.aggregate(parts, start, step)["found"]
    return F.slice(found, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def proximity_weight(a: Column, b: Column) -> Column:
    """exp(-d / 100), but at least 0.1, for the least distance d of two arrays of positions; 0 if either is empty."""
    # in one order, told apart by the last bit, the nearest two of different arrays are neighbours
    both = F.array_sort(F.concat(F.transform(a, lambda x: x * 2), F.transform(b, lambda y: y * 2 + 1)))

    def least(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.array_min(F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(1) == 1, F.shiftright(y, 1) - F.shiftright(x, 1))))

    return let(let(both, least), lambda d: F.when(d.isNull(), 0.0).otherwise(F.greatest(F.exp(-d / 100), F.lit(0.1))))


def join_hyphen_breaks(text: Column) -> Column:
    """Words that a hyphen parts at a line's end become one."""
    return F.regexp_replace(text, r"([a-zA-Z]+)-\n([a-zA-Z]+)", "$1$2")


def drop_contents_lines(text: Column) -> Column:
    """Lines of tables of contents and page numbers go."""
    lines = F.split(text, "\n", -1)

    def listed(line: Column) -> Column:
        forms = [f if isinstance(f, tuple) else (f,) for f in CONTENTS_LINES]
        return reduce(or_, (reduce(and_, (line.rlike(p) for p in form)) for form in forms))

    return F.array_join(F.filter(lines, lambda x: ~listed(x)), "\n")


def contents_summary(text: Column) -> Column:
    """`Sections: ...` of the first ten markdown headers: level one as is, level two indented, at most eight; or ''."""
    marks = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^#{1,3}\s+.+$"))
    heads = F.transform(marks, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,3}\s+(.+)$", 1)).alias("title")))
    heads = F.slice(F.filter(heads, lambda h: F.length(h["title"]) < 100), 1, 10)

    def step(parts: Column, h: Column) -> Column:
        second = F.concat(parts, F.array(F.concat(F.lit("  - "), h["title"])))
        return F.when(h["level"] == 1, F.concat(parts, F.array(h["title"]))).when((h["level"] == 2) & (F.size(parts) < 8), second).otherwise(parts)

    parts = F.aggregate(heads, F.array().cast("array<string>"), step)
    return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.lit("Sections: "), F.array_join(F.slice(p, 1, 8), "; "))).otherwise(""))


def tidy_markdown(text: Column) -> Column:
    """Runs of blank lines become one, ends of lines and of the text are stripped; table rows and fences stay as they are."""
    kept = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.contains("|") | x.rlike(r"^\s*```"), x).otherwise(F.regexp_replace(x, r"(?U)\s+$", "")))

    def step(out: Column, x: Column) -> Column:
        return F.when((x == "") & (F.element_at(out, -1) == ""), out).otherwise(F.concat(out, F.array(x)))

    first = F.slice(kept, 1, 1)
    lines = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), first, step)
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)(?:\n[^\S\n]*)+\z", "")


def estimate_tokens(encoding_file: str, pattern: str = r"\s*\S+|\s+"):
    """A column function: the number of byte-pair tokens of a text under a file of ranks (0 for an empty or null one).

    The file holds a line per token: its bytes in base 64 and its rank. Texts are cut by the pattern before they are
    merged, as the vocabulary was trained to.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        encoding = _encoding(encoding_file, pattern)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return counted


@lru_cache(4)
def _encoding(file: str, pattern: str):
    import base64

    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def truncate(text: Column, max_tokens: int) -> Column:
    """Texts of more than four characters a token lose their rest and get a mark (the result may exceed the limit)."""
    size = max_tokens * 4
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, max(0, size - 20)), F.lit(TRUNCATED)))


def excerpt(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fixed_slices(text: Column, size: int = 500) -> Column:
    """A text in pieces of size characters (none for an empty text)."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


# --- tables: array<array<string>>, the first row being the header ---------------------------------------------------


def _cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def html_table(data: Column) -> Column:
    """HTML of a table; cells are escaped unless they are tables themselves; rows get the header's width."""

    def escaped(c: Column) -> Column:
        plain = F.replace(F.replace(F.replace(_cell(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(_cell(c).startswith("<table"), _cell(c)).otherwise(plain)

    def tagged(cells: Column, tag: str) -> Column:
        return F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"      <{tag}>"), escaped(c), F.lit(f"</{tag}>\n"))), "")

    def row(cells: Column, tag: str) -> Column:
        return F.concat(F.lit("    <tr>\n"), tagged(cells, tag), F.lit("    </tr>\n"))

    width = F.size(data[0])
    fitted = F.transform(F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0))), lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get(r, i)))
    body = F.concat(F.lit("  <tbody>\n"), F.array_join(F.transform(fitted, lambda r: row(r, "td")), ""), F.lit("  </tbody>\n"))
    head = F.concat(F.lit('<table border="1" cellpadding="4" cellspacing="0">\n  <thead>\n'), row(data[0], "th"), F.lit("  </thead>\n"))
    return F.when(F.size(data) < 1, "").otherwise(F.concat(head, F.when(F.size(data) > 1, body).otherwise(""), F.lit("</table>")))


def ascii_table(data: Column, columns: Column) -> Column:
    """Columns of blanks-padded cells, two blanks apart, with a blank line after the header."""
    widths = F.transform(F.sequence(F.lit(0), columns - 1), lambda i: F.coalesce(F.array_max(F.transform(data, lambda r: F.length(_cell(F.get(r, i))))), F.lit(0)))

    def line(r: Column, w: Column) -> Column:
        return F.array_join(F.transform(w, lambda n, i: F.rpad(_cell(F.get(r, i)), n, F.lit(" "))), "  ")

    def whole(w: Column) -> Column:
        lines = F.transform(data, lambda r: line(r, w))
        return F.when(F.size(data) > 1, F.concat_ws("\n", lines[0], F.lit(""), F.array_join(F.slice(lines, F.lit(2), F.size(data) - 1), "\n"))).otherwise(lines[0])

    return F.when(F.size(data) < 1, "").otherwise(let(F.when(columns > 0, widths).otherwise(F.array().cast("array<int>")), whole))


def markdown_table(data: Column) -> Column:
    """Markdown of a table; pipes are escaped in the body only; '' without a header."""
    width = F.size(data[0])

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def whole() -> Column:
        head = row(F.transform(data[0], _cell))
        rule = row(F.transform(data[0], lambda c: F.lit("---")))
        rest = F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0)))
        body = F.transform(rest, lambda r: row(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.replace(_cell(F.get(r, i)), F.lit("|"), F.lit("\\|")))))
        return F.array_join(F.concat(F.array(head, rule), body), "\n")

    return F.when((F.size(data) < 1) | (width < 1), "").otherwise(whole())


def raw_text(text: Column, tables: Column) -> Column:
    """A page's text followed by its tables (array of struct with data and columns) as plain text."""
    return F.concat(text, F.array_join(F.transform(tables, lambda t: F.concat(F.lit("\n"), ascii_table(t["data"], t["columns"]), F.lit("\n"))), ""))

"""Text functions on columns: slugs, excerpts, counts, progress, templates and paragraph clean-up.

White space is Unicode's and the separators U+001C to U+001F; letters are those of ``\\p{L}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of this module are fixed values: results depend on them as they are.
_WORD_GAP = r"(?U)[\s\x1C-\x1F]+"
WORDS_A_MINUTE = 250


def slugify(text: Column, length: int = 80) -> Column:
    """Lower case; only letters, digits, ``_`` and single ``-``; cut at ``length`` (it may then end in ``-``)."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\p{L}\p{N}_\s-]", "")
    joined = F.regexp_replace(kept, r"(?U)[-\s]+", "-")
    return F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, length)


def section_slug(prefix: Column, heading: Column, length: int = 60) -> Column:
    """``prefix-`` and the heading in ASCII; one longer than ``length`` is cut back to its last dash."""
    plain = F.translate(F.lower(heading), "—–'’", "--")
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"[^a-z0-9\s-]", "")), r"\s+", "-")
    plain = F.regexp_replace(plain, "-+", "-")
    cut = F.substring(plain, 1, length)
    back = F.when(F.instr(cut, "-") > 0, F.regexp_extract(cut, "^(.*)-", 1)).otherwise(cut)
    return F.concat(prefix, F.lit("-"), F.when(F.length(plain) > length, back).otherwise(plain))


def excerpt(text: Column) -> Column:
    """Up to a sentence's end, first the last full stop, then ``!``, then ``?``, within 52 to 200 characters; else to a word's end."""
    head = F.substring(text, 1, 250)
    ends = [F.nullif(F.regexp_extract(head, rf"(?s)^(.{{51,199}}{c})", 1), F.lit("")) for c in (r"\.", "!", r"\?")]
    word = F.regexp_extract(head, r"(?s)^(.{51,199}) ", 1)
    long = F.when((F.length(head) > 200) & (word != ""), F.concat(word, F.lit("...")))
    rest = F.concat(F.substring(head, 1, 200), F.when(F.length(text) > 200, "...").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.coalesce(*ends, long, rest))


def excerpt_words(text: Column, length: int = 200) -> Column:
    """The first ``length`` characters up to their last space, with an ellipsis in any case."""
    head = F.substring(text, 1, length)
    return F.concat(F.when(F.instr(head, " ") > 0, F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head), F.lit("..."))


def excerpt_short(text: Column, length: int = 150, least: int = 100) -> Column:
    """As it is up to ``length``; else cut at the last space beyond ``least``, with an ellipsis."""
    head = F.substring(text, 1, length)
    back = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.when(F.length(back) > least, back).otherwise(head), F.lit("...")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _WORD_GAP), lambda w: w != ""))


def reading_minutes(words: Column) -> Column:
    """At least 1; halves go to the even minute."""
    return F.greatest(F.lit(1), F.bround(words / WORDS_A_MINUTE, 0).cast("int"))


def reading_minutes_floor(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / WORDS_A_MINUTE).cast("int"))


def progress_percent(index: Column, total: Column) -> Column:
    """Halves go to the even number; 0 where there is no total."""
    return F.when(total > 0, F.bround(index / total * 100, 0).cast("int")).otherwise(0)


def progress_percent_half_up(index: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(index / total * 100 + 0.5).cast("int")).otherwise(0)


def progress_text(index: Column, total: Column) -> Column:
    return F.concat(F.lit("Post "), index.cast("string"), F.lit(" of "), total.cast("string"))


def with_campaign(url: Column, source: str, medium: str = "email", campaign: str = "drip") -> Column:
    """The URL with campaign parameters; an empty or null one gives an empty string."""
    tail = f"utm_source={source}&utm_medium={medium}&utm_campaign={campaign}"
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(url, F.when(F.instr(url, "?") > 0, "&").otherwise("?"), F.lit(tail)))


def unsubscribe_url(app_url: str, subscription: Column) -> Column:
    return F.concat(F.lit(f"{app_url}/unsubscribe?sid="), subscription.cast("string"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Replaces ``{{name}}`` by each value in turn, so a value may bring in placeholders that come later."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), template)


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WORD_GAP, " "))


def clean_scan(text: Column, fixes: dict[str, str] | None = None) -> Column:
    """Without page-number lines, distribution banners and runs of blank lines; then literal ``fixes``."""
    t = F.regexp_replace(text, r"\n\s*-\s*\d+\s*-\s*\n", "\n")
    t = F.regexp_replace(t, r"FOR PRIVATE (?:DISTRIBUTION|CIRCULATION)(?: ONLY)?\s*\n?", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    for bad, good in (fixes or {}).items():
        t = F.replace(t, F.lit(bad), F.lit(good))
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def escape_html(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)


def paragraphs_html(text: Column) -> Column:
    """Blank-line-separated paragraphs as escaped ``<p>`` elements, one a line."""
    trimmed = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    filled = F.filter(trimmed, lambda p: p != "")
    return F.array_join(F.transform(filled, lambda p: F.concat(F.lit("<p>"), F.regexp_replace(F.replace(escape_html(p), F.lit("\n"), F.lit(" ")), "  +", " "), F.lit("</p>"))), "\n")


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\(\d{1,3}(?:\s*[,–—\-]\s*\d{1,3})*\)", "")


def straight_quotes(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), "  +", " ")


def _wrapped(p: Column) -> Column:
    joined = F.regexp_replace(p, r"(?<![.\n])\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)(\w)-\s+(\w)", "$1$2"), r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column, headers: tuple[str, ...] = ()) -> Column:
    """Paragraphs of wrapped text: joined lines, no hyphenation, and no captions, numbers, part headers or chart data."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    found = F.transform(F.split(lines, r"\n\s*\n"), _wrapped)

    def kept(p: Column) -> Column:
        bad = p.rlike(r"(?i)^(?:Figure|Table|Picture|Box)\s+\d") | p.rlike(r"^\d{1,3}$") | p.startswith("DOI:") | p.rlike(r"^PART\s+[IVX]+") | p.rlike(r"^[\d\s.,<>%]+$")
        for h in headers:
            bad = bad | p.startswith(h)
        return (F.length(p) >= 20) & ~bad

    return F.filter(found, kept)


def without_page_headers(text: Column, titles: list[str], imprint: str = "", press: str = "") -> Column:
    """Lines of page headers left out: a title with a number before or after it, capitals with a number, DOI and imprint lines."""
    number_title = "^(?i:" + "|".join(t.replace(".", r"\.") for t in titles) + ")$" if titles else "(?!)"

    def header(line: Column) -> Column:
        s = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        before = s.rlike(r"^\d{1,3}\s+[A-Z]") & F.regexp_replace(s, r"^\d{1,3}\s+", "").rlike(number_title)
        after = s.rlike(r"^[A-Z].*\s+\d{1,3}$") & F.regexp_replace(s, r"\s+\d{1,3}$", "").rlike(number_title)
        marks = s.startswith("DOI:")
        if imprint:
            marks = marks | s.startswith(imprint)
        if press:
            marks = marks | (s.contains(press) & (s.contains("DOI:") | s.contains("©")))
        return before | after | s.rlike(r"^[A-Z][A-Z\s’—\-,]+\d{1,3}$") | marks

    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~header(x)), "\n")


def rejoin_capitals(text: Column) -> Column:
    """A line of one or two characters that starts in upper case is joined with a next line that starts in lower case."""
    lines = F.split(text, "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, line: Column) -> Column:
        s, nxt = F.trim(acc["last"]), F.trim(line)
        joins = acc["last"].isNotNull() & (F.length(s) <= 2) & s.rlike(r"^\p{Lu}") & nxt.rlike(r"^\p{Ll}")
        flushed = F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"]))
        return F.when(joins, F.struct(F.array_append(acc["done"], F.concat(s, nxt)).alias("done"), F.lit(None).cast("string").alias("last"))).otherwise(F.struct(flushed.alias("done"), line.alias("last")))

    return F.array_join(F.aggregate(lines, start, step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["last"]))), "\n")


def title_part(title: Column, mark: str) -> Column:
    """What stands before the first ``mark``, trimmed."""
    return F.trim(F.substring_index(title, mark, 1))


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def display_name(key: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key) if names else key


def address(name: Column, email: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(email)


def url_component(text: Column) -> Column:
    """Percent-encoding as browsers do it: ``!'()*~`` stay and a space is ``%20``."""
    pairs = [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), pairs, F.url_encode(text))


def detail_lines(details: Column) -> Column:
    """``key: value`` of each entry of a map that isn't null, one a line."""
    return F.array_join(F.transform(F.filter(F.map_entries(details), lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit("<b>"), e["key"], F.lit(":</b> "), e["value"])), "<br>")


def subject_cut(head: Column, markers: list[str], publications: list[str]) -> Column:
    """A heading up to its earliest marker that is followed by a publication's name within 45 characters."""

    def quoted(x: str) -> str:
        return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-" else c for c in x)

    follow = "|".join(f".{{0,{45 - len(p)}}}{quoted(p)}" for p in publications)
    found = F.regexp_instr(head, F.lit(f"(?s)(?:{'|'.join(map(quoted, markers))})(?={follow})"))
    cut = F.when(found > 0, F.substring(head, F.lit(1), found - 1)).otherwise(head)
    return F.regexp_replace(F.regexp_replace(cut, r"^[ .:]+|[ .:]+$", ""), r"(?U)(\w)\(", "$1 (")


def byline(text: Column, names: list[str]) -> Column:
    """A line that is one name, or two joined by AND or OR, in title case; else null."""
    own = "|".join(names)
    return F.when(text.rlike(rf"^(?:{own})(?:\s+(?:AND|OR)\s+(?:{own}))?$"), F.replace(F.replace(F.initcap(text), F.lit(" And "), F.lit(" and ")), F.lit(" Or "), F.lit(" or ")))

"""Text, path and date functions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.trim(_col(text), F.lit(" \t\n\r\x0b\x0c"))


def tokenize(text: Column | str) -> Column:
    """Lower-case words between runs of Unicode white space; an empty text has none."""
    words = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)[\s\x1c-\x1f]+")
    return F.filter(words, lambda w: w != "")


def word_counts(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words: each distinct one, sorted, with how often it occurs.

    Equal words stand side by side once they are sorted, so a text is counted by itself, in its own row.
    """

    def runs(w: Column) -> Column:
        last = F.size(w) - 1
        ends = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: ~F.get(w, i).eqNullSafe(F.get(w, i + 1)))
        return _bound(ends, lambda e: F.transform(e, lambda at, k: F.struct(F.get(w, at).alias("term"), (at - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("tf"))))

    return _bound(F.array_sort(words), runs)


def clean_markdown(text: Column | str) -> Column:
    """Plain text of Markdown: links to their labels, no heading marks, emphasis, code marks or line ends."""
    steps = (
        (r"\[\[([^\]]+)\]\]", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"#+\s*", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"`([^`]+)`", "$1"),
        (r"\n+", " "),
    )
    return strip(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, _col(text)))


def inline_tags(text: Column | str) -> Column:
    """Distinct #tags of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit("#([A-Za-z0-9_-]+)"), F.lit(1))))


def description(text: Column | str) -> Column:
    """A text of up to 150 characters whole; else its first 150 cut after the last full stop.

    A stop in the first half leaves nothing; without any stop the cut is at the last blank, with dots.
    """
    c = strip(text)
    head = F.substring(c, 1, 150)
    stop = F.when(F.locate(".", head) > 0, F.lit(151) - F.locate(".", F.reverse(head))).otherwise(0)
    blank = F.when(F.locate(" ", head) > 0, F.lit(151) - F.locate(" ", F.reverse(head))).otherwise(0)
    return (
        F.when(F.length(c) <= 150, c)
        .when(stop > 76, F.substring(c, F.lit(1), stop))
        .when(stop > 0, F.lit(""))
        .when(blank > 0, F.concat(F.substring(c, F.lit(1), blank - 1), F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def snippet(text: Column | str, query: str, width: int = 150, slack: int = 30) -> Column:
    """A window of the text around the first query word of three letters or more; its head if there is none.

    A cut end moves to a blank that is less than `slack` characters away, and gets dots.
    """
    c = F.coalesce(_col(text), F.lit(""))
    n = F.length(c)
    head = F.concat(strip(F.substring(c, 1, width)), F.when(n > width, "...").otherwise(""))
    words = [w for w in query.lower().split() if len(w) >= 3]
    if not words:
        return head if query else F.substring(c, 1, width)
    hits = [F.nullif(F.locate(w, F.lower(c)), F.lit(0)) for w in words]
    at = (hits[0] if len(hits) == 1 else F.least(*hits)) - 1

    def window(at: Column) -> Column:
        wanted = F.greatest(F.lit(0), at - width // 2)
        start = F.when(wanted + width >= n, F.greatest(F.lit(0), n - width)).otherwise(wanted)
        return F.when(at.isNotNull(), _bound(start, from_start))

    def from_start(start: Column) -> Column:
        raw = F.substring(c, start + 1, F.least(n - start, F.lit(width)))
        return _bound(raw, lambda raw: _bound(open_cut(raw, start), lambda opened: close_cut(opened, start)))

    def open_cut(raw: Column, start: Column) -> Column:
        lead = F.locate(" ", raw) - 1
        rest = F.when((lead > 0) & (lead < slack), F.substring(raw, lead + 1, F.length(raw))).otherwise(raw)
        return F.when(start > 0, F.concat(F.lit("..."), rest)).otherwise(raw)

    def close_cut(opened: Column, start: Column) -> Column:
        blank = F.when(F.locate(" ", opened) > 0, F.length(opened) - F.locate(" ", F.reverse(opened))).otherwise(-1)
        shut = F.when(blank > F.length(opened) - slack, F.substring(opened, F.lit(1), blank)).otherwise(opened)
        return strip(F.when(start + width < n, F.concat(shut, F.lit("..."))).otherwise(opened))

    return F.coalesce(_bound(at, window), head)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    return F.when(F.locate("/", _col(path)) > 0, F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def stem(path: Column | str) -> Column:
    name = base_name(path)
    short = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(short != "", short).otherwise(name)


def percent_encode(c: Column | str) -> Column:
    """Percent-encoding that keeps letters, digits and `_.-~/`."""
    out = F.url_encode(_col(c))
    for a, b in (("%2F", "/"), (r"\+", "%20"), ("%7E", "~"), (r"\*", "%2A")):
        out = F.regexp_replace(out, a, b)
    return out


def without_md(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\.md$", "")


def deep_link(vault: str, path: Column | str) -> Column:
    return F.concat(F.lit(f"obsidian://vault/{vault}/"), percent_encode(without_md(path)))


def wiki_link(title: Column | str) -> Column:
    return F.concat(F.lit("[["), _col(title), F.lit("]]"))


def note_date(path: Column | str, created: Column | None = None, modified: Column | None = None) -> Column:
    """The date in the path, else the given creation date (three formats), else that of the last change."""
    found = [F.try_to_date(F.regexp_extract(_col(path), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")]
    if created is not None:
        found += [F.try_to_date(created, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy")]
    if modified is not None:
        found.append(modified.cast("date"))
    return F.coalesce(*found)


def finite(score: Column | str) -> Column:
    """A number as it is; NaN and the infinities are null."""
    c = _col(score)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def valid_text(raw: Column | str) -> Column:
    """A string of bytes in which whatever is not UTF-8 became the replacement character."""
    return F.make_valid_utf8(_col(raw))


def json_list(text: Column | str) -> Column:
    """The strings of a JSON array; none for anything else."""
    return F.coalesce(F.from_json(_col(text), "array<string>"), F.array().cast("array<string>"))


def estimated_tokens(text: Column | str) -> Column:
    return F.floor(F.length(_col(text)) / 4).cast("long")

"""Text expressions: trimming, snippets, ids, normalisation, regex helpers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Everything a Unicode-aware trim removes; Spark's own trim() only drops blanks.
WHITESPACE = (
    " \t\n\x0b\x0c\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# One whitespace character in that sense, as a regex class.
BLANK = "[" + r"\s\x0b" + WHITESPACE[6:] + "]"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def computed(df, columns: dict[str, Column]):
    """Add columns that later filters must not work out a second time.

    A filter on an ordinary derived column is pushed below it with the whole
    expression copied in, and copies inside a lambda run once per element.
    Columns that come out of a generator stay where they are.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(made)))


def or_default(c: Column, default: str) -> Column:
    """The default for null and for the empty string alike."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def squash(c: Column) -> Column:
    """Trim and turn every whitespace run into one blank."""
    return F.regexp_replace(strip(c), BLANK + "+", " ")


def snippet(c: Column, n: int) -> Column:
    """Whitespace-squashed text of at most n characters, the last three dots.

    Squashing the beginning is mostly enough: once that alone is longer than
    n, the rest cannot change the result.  Otherwise the whole text is taken.
    """

    def cut(flat: Column) -> Column:
        return F.concat(F.left(flat, F.lit(n - 3)), F.lit("..."))

    head, flat = squash(F.left(strip(c), F.lit(4 * n))), squash(c)
    return F.when(F.length(head) > n, cut(head)).when(F.length(flat) > n, cut(flat)).otherwise(flat)


def preview(c: Column, n: int) -> Column:
    """The first n characters, with dots appended when the text was longer."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def round_half_up(c: Column, digits: int = 3) -> Column:
    """Round half towards plus infinity (Spark's round() goes away from zero)."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def slug(c: Column) -> Column:
    """Wing name from a folder name."""
    return F.regexp_replace(F.lower(c), r"[\s-]", "_")


def agent_wing(c: Column) -> Column:
    return F.concat(F.lit("wing_"), F.replace(F.lower(c), F.lit(" "), F.lit("_")))


def entity_id(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_id(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def namespace_id(c: Column) -> Column:
    """Fact namespace: base name without extension, squeezed to [a-z0-9_]."""
    base = basename(F.replace(c, F.lit("\\"), F.lit("/")))
    base = F.regexp_replace(base, r"\.[^.]+$", "")
    base = F.regexp_replace(base, r"[^a-zA-Z0-9_]+", "_")
    return or_default(F.lower(F.regexp_replace(base, r"^_+|_+$", "")), "default")


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a string, computed in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def point_id(original_id: Column, prefix: str = "loci.") -> Column:
    """Storage key of a drawer; the prefix keeps id spaces apart."""
    return uuid5(F.concat(F.lit(prefix), original_id))


def short_md5(c: Column, n: int) -> Column:
    return F.left(F.md5(c), F.lit(n))


def mined_drawer_id(wing: Column, room: Column, path: Column, index: Column) -> Column:
    key = short_md5(F.concat(path, index.cast("string")), 16)
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), key)


@pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """NFKD with the combining marks U+0300-U+036F dropped."""
    return s.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII words separated by single blanks."""
    folded = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.btrim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def count_substring(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return F.when(
        F.length(needle) > 0,
        ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"),
    ).otherwise(F.lit(0))


_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java_pattern(pattern: str) -> str:
    """Pin \\b to ASCII words: Java 17 treats accented letters as word characters."""
    head = pattern
    out = ""
    if head.startswith(r"\b"):
        out, head = r"(?<![A-Za-z0-9_])", head[2:]
        if not re.match(r"[A-Za-z0-9_(\\]", head):
            out = _BOUNDARY
    return out + re.sub(r"(?<=[A-Za-z0-9])\\b$", r"(?![A-Za-z0-9_])", head).replace(r"\b", _BOUNDARY)


def required_text(pattern: str) -> str:
    """The longest plain text every match of a pattern contains ('' if unknown)."""
    flat = re.sub(r"\([^()]*\)[?*+]?", "\x00", pattern)
    flat = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]|[.^$|+{}]", "\x00", flat)
    return max(flat.split("\x00"), key=len)


def _signs(pattern: str) -> list[list[str]]:
    """Plain texts that go with every match of a lower-case pattern: one of each list."""
    if len(_alternatives(pattern)) > 1:
        return [[required_text(pattern)]] if len(required_text(pattern)) > 1 else []
    flat = re.sub(r"\([^()]*\)[?*+]?", "\x00", pattern)
    flat = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]|[.^$|+{}]", "\x00", flat)
    signs = [[t] for t in flat.split("\x00") if len(t) > 1]
    # A group of plain words, with the text right before and after it.
    group = re.search(r"(?<![\\a-z' ])([a-z' ]*)\(([a-z' |]+)\)(?![?*+{])([a-z' ]*)([?*{]?)", pattern.replace(r"\b", "\x00"))
    if group:
        before, words, after, cut = group.groups()
        signs.append([before + w + (after[:-1] if cut else after) for w in words.split("|")])
    return [s for s in signs if all(len(t) > 1 for t in s)]


def regexp_hits(text: Column, patterns) -> Column:
    """Total matches of all patterns in a text.

    A pattern is only run where the texts it cannot do without are there, which
    are far cheaper to look for.
    """
    total = F.lit(0)
    for p in patterns:
        hits = F.regexp_count(text, F.lit(java_pattern(p)))
        may = None
        for texts in _signs(p):
            found = F.contains(text, F.lit(texts[0]))
            for t in texts[1:]:
                found = found | F.contains(text, F.lit(t))
            may = found if may is None else may & found
        if may is not None:
            # Without a text, only a pattern that has a longer text of its own says 0.
            hits = F.when(may, hits).when(F.lit(len(required_text(p)) > 1) | text.isNotNull(), 0)
        total = total + hits
    return total


def matches_any(text: Column, patterns) -> Column:
    return F.rlike(text, F.lit("|".join(f"(?:{java_pattern(p)})" for p in patterns)))


def quote_regex(c: Column) -> Column:
    r"""A value made safe inside a Java pattern (\Q...\E)."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


_NAME = "{name}"


def _needs(pattern: str) -> list[str]:
    """Plain lower-case texts one of which every match of a pattern contains; [''] if there is none to tell."""
    found = [required_text(p.replace(_NAME, "\x00").replace(r"\b", "\x00")).lower() for p in _alternatives(pattern)]
    return found if all(found) else [""]


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside of brackets."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _name_pattern(pattern: str, flags: str) -> str:
    # A boundary before the name stays general: the name may start with
    # something that is no word character.
    p = java_pattern(pattern.replace(_NAME, "\x00")).replace(r"(?<![A-Za-z0-9_])" + "\x00", _BOUNDARY + "\x00")
    # Comparing the first letters is far cheaper than a boundary, so they are tried first.
    heads = [re.match(r"\\b([a-z]+)([?*{]?)", part) for part in _alternatives(pattern)]
    if p.startswith(_BOUNDARY + "\x00"):
        p = "(?=\x00)" + p
    elif all(heads):
        p = "(?=" + "|".join(h[1][:-1] if h[2] else h[1] for h in heads) + f")(?:{p})"
    return f"(?{flags})" + p.replace("\x00", _NAME)


def name_patterns(patterns, flags: str = "i") -> Column:
    """Pattern texts, ready for Java, as one literal array; {name} still in them."""
    return F.array(*[F.lit(_name_pattern(p, flags)) for p in patterns])


def needed_texts(patterns) -> Column:
    """array<array<string>>: what a lower-cased text must contain one of, for each pattern to match it."""
    return F.array(*[F.array(*[F.lit(n) for n in _needs(p)]) for p in patterns])


def may_match(lowered: Column, patterns) -> Column:
    """array<boolean>: which patterns can match a lower-cased text at all, whatever the name."""
    return F.transform(needed_texts(patterns), lambda some: F.exists(some, lambda n: F.contains(lowered, n)))


def _beside(pattern: str) -> list[str]:
    """What follows the name in every match of a pattern, as plain lower-case texts one of which is there; [''] if unknown."""
    found = []
    for part in _alternatives(pattern):
        m = re.match(r"\\([.])|([-:])|\[([-:a-z]+)\]", part.partition(_NAME)[2])
        found += list(next(g for g in m.groups() if g)) if m and part.count(_NAME) == 1 else [""]
    return found if all(found) else [""]


def beside_name(lowered: Column, patterns, name: Column) -> Column:
    """array<boolean>: which patterns can match a lower-cased text by what follows a name there."""
    low, plain = F.lower(name), F.rlike(name, F.lit(r"\A\p{ASCII}*\z"))
    after = F.array(*[F.array(*[F.lit(x) for x in _beside(p)]) for p in patterns])
    return F.transform(after, lambda some: ~plain | F.exists(some, lambda x: (x == "") | F.contains(lowered, F.concat(low, x))))


def count_named(text: Column, patterns: Column, name: Column, possible: Column | None = None) -> Column:
    """array<int>: matches of each pattern with the name filled in.

    One short lambda instead of one expression per pattern keeps the generated
    code small.  Patterns that ``possible`` (see ``may_match``) rules out are not run.
    """
    quoted = quote_regex(name)

    def hits(p: Column) -> Column:
        return F.regexp_count(text, F.replace(p, F.lit(_NAME), quoted))

    if possible is None:
        return F.transform(patterns, hits)
    return F.zip_with(patterns, possible, lambda p, some: F.when(some, hits(p)).when(text.isNotNull(), F.lit(0)))


def match_named(text: Column, patterns: Column, name: Column) -> Column:
    """How many of the patterns match with the name filled in."""
    quoted = quote_regex(name)
    return F.size(F.filter(patterns, lambda p: F.rlike(text, F.replace(p, F.lit(_NAME), quoted))))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_groups(lines: Column, size: int) -> Column:
    """Consecutive groups of `size` lines, each joined and trimmed."""
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(size))
    return F.transform(starts, lambda i: strip(F.array_join(F.slice(lines, i, F.lit(size)), "\n")))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda p: p != "")

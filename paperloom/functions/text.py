"""Column helpers for text: whitespace rules, substring tests, regex spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiline mode in which only LF ends a line, so offsets agree with other engines.
LINES = "(?md)"
LINES_NOCASE = "(?mdi)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters the reference semantics treat as white space (Python's str.isspace).
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_BLANK_RUN = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def strip(c: Column | str) -> Column:
    """Trim all whitespace, line ends included (Spark's trim only removes spaces)."""
    return F.btrim(col(c), F.lit(BLANKS))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(col(c), _BLANK_RUN, " "))


def left(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def slice_text(c: Column | str, start: Column, end: Column) -> Column:
    """Characters [start, end), 0-based."""
    return F.substring(col(c), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def contains_any(c: Column | str, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(col(c), F.lit(word))
    return out


def first_contained(c: Column | str, words: list[str]) -> Column:
    """The first word of the list found inside the text, else null."""
    return F.coalesce(*[F.when(F.contains(col(c), F.lit(w)), F.lit(w)) for w in words])


def rlike(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; empty when there is none."""
    return F.regexp_extract(col(c), pattern, group)


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def literal_map(pairs) -> Column:
    """A constant lookup table inside an expression (one parsed literal, so plans stay quick to build)."""
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in pairs for x in pair) + ")")


def text_array(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(w) for w in words) + ")")


def is_json(text: Column) -> Column:
    """Whether a text is one complete JSON value. The parser stops at the end of the first value, so
    the text is tested inside a list and inside an object: nothing can follow it in both."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(listed.isNotNull() & keyed.isNotNull() & one, F.lit(False))


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it many times inside an expression."""
    return F.transform(F.array(value), body)[0]


# Characters that no text may hold; they stand around matches for a moment.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def find_spans(text: Column, pattern: str, before: int = 0, after: int = 0, shape=None) -> Column:
    """All non-overlapping matches of a pattern, in order: (idx, gap, hit, pre, post).

    One pass of the pattern marks the matches; a split at the marks gives the pieces of the text between
    and inside them in turn. `gap` is the length of the piece before the match, so an offset is a running
    sum over (gap, hit) lengths. `pre`/`post` hold that many characters of context on either side (patterns
    must not match the empty text). `shape` arranges the five columns; the default is a struct of them.
    """
    shape = shape or (lambda **c: F.struct(*[v.alias(k) for k, v in c.items()]))

    def around(pieces: Column, i: Column, pre: bool) -> Column:
        reach = before if pre else after
        if not reach:
            return F.lit("")

        def near(count: int) -> Column:
            if pre:
                first = F.greatest(2 * i + 2 - count, F.lit(1))
                part = F.transform(F.slice(pieces, first, 2 * i + 2 - first), lambda p: F.right(p, F.lit(reach)))
                return F.right(F.array_join(part, ""), F.lit(reach))
            part = F.transform(F.slice(pieces, 2 * i + 3, F.lit(count)), lambda p: left(p, reach))
            return left(F.array_join(part, ""), reach)

        # The neighbouring piece mostly suffices, a few pieces nearly always, 2 * reach + 2 always, as no match is empty.
        beside = F.get(pieces, 2 * i) if pre else F.get(pieces, 2 * i + 2)
        more = let(near(6), lambda few: F.when(F.length(few) >= reach, few).otherwise(near(2 * reach + 2)))
        return F.when(F.length(beside) >= reach, F.right(beside, F.lit(reach)) if pre else left(beside, reach)).otherwise(more)

    def spans(pieces: Column) -> Column:
        places = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: shape(
            idx=i, gap=F.length(F.get(pieces, 2 * i)), hit=F.get(pieces, 2 * i + 1), pre=around(pieces, i, True), post=around(pieces, i, False)))

    marked = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)
    # A text that does hold the marks is cut by two passes of the pattern instead.
    twice = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("h"))
    woven = let(twice, lambda s: F.flatten(F.zip_with(s["g"], s["h"], lambda g, h: F.when(h.isNull(), F.array(g)).otherwise(F.array(g, h)))))
    return let(F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_SHUT)), woven).otherwise(marked), spans)

"""Heading and title lines of a text, found from their words.

A pattern tried at every position of a text costs far more than the few lines that can match. So the word that a
match needs ("Item", or a line that is a title) is found first, and the pattern runs from the start of that line
only. Matches, their order and their offsets are those of a plain scan with the pattern (`text.find_spans`).

What a candidate tells is read off the match while it is at hand, so no pattern runs on a match again and neither the
match nor the text around it leaves the text's row.
"""

from __future__ import annotations

import re

import pyarrow as pa

from paperloom.functions import fixed
from paperloom.functions.text import BLANKS

_BLANK = " \t\n\r\x0b\x0c"
_ITEM = re.compile("ITEM|Item")
_HEADINGS = [re.compile(p, re.M | re.A) for p in fixed.HEADING_PATTERNS]


def _run_start(text: str, at: int, run: str) -> int:
    while at > 0 and text[at - 1] in run:
        at -= 1
    return at


def _matches(text: str, pattern: re.Pattern, anchors: list[tuple[int, int]]):
    """The pattern's matches, leftmost first and not overlapping. An anchor is where a match's first word
    stands, and where the run of noise before it begins; a match starts at a line's start or end in that run."""
    done = 0
    for word, run in anchors:
        low = max(run, done)
        if low > word:
            continue
        if low > 0 and text[low - 1] != "\n":
            low = text.find("\n", low, word)
            if low < 0:
                continue
        found = pattern.match(text, low)
        if found:
            done = found.end()
            yield found


def _item_anchors(text: str) -> list[tuple[int, int]]:
    return [(m.start(), _run_start(text, m.start(), _BLANK)) for m in _ITEM.finditer(text)
            if m.start() == 0 or text[m.start() - 1] in _BLANK]


def _title_anchors(text: str, titles: dict[str, tuple[str, int, int]]) -> list[tuple[int, int]]:
    out, at, noise = [], 0, _BLANK + "|"
    for line in text.split("\n"):
        bare = line.lstrip(noise)
        if bare and bare.rstrip(noise) in titles:
            word = at + len(line) - len(bare)
            out.append((word, _run_start(text, word, noise)))
        at += len(line) + 1
    return out


_BLANKS_RUN = re.compile(f"[{BLANKS}]+")
_PAGE_AT_END = re.compile(r"\.{2,}\s*\d{1,4}\Z", re.A)
_NUMBER_AT_END = re.compile(r"\s\d{1,4}\Z", re.A)
_DIGITS = frozenset("0123456789")
_WORD_AT_END = re.compile(r"[a-z]{3}\Z")
_NOISE_AT_END = re.compile(r"\n[\s|]*\Z", re.A)


_PREFIXES = {n: title.lower()[:20] for _, n, title in fixed.ITEMS}


def title_score(item: str, title: str) -> float:
    """How well a heading's (stripped) title fits its item number."""
    if not title:
        return 0.55
    low = title.lower()
    if any(variant in low for variant in fixed.TITLE_VARIANTS.get(item, ())):
        return 0.95
    return 0.90 if item in _PREFIXES and _PREFIXES[item] in low else 0.5


def looks_like_toc(snippet: str) -> bool:
    """Dot leaders or a trailing page number, or a caption: the look of a contents line."""
    body = snippet.strip(BLANKS)
    if body[-1:] in _DIGITS:
        flat = _BLANKS_RUN.sub(" ", body)
        if _PAGE_AT_END.search(flat) or len(flat) < 140 and _NUMBER_AT_END.search(flat):
            return True
    return "table of contents" in snippet[:200].lower()


_PLAIN = ("kind", "idx", "gap", "hit", "pre", "post", "base")
_READ = ("kind", "idx", "gap", "len", "base", "item_number", "heading_text", "rank", "case_rank", "toc_like", "toc_near", "mid_sentence", "score")


def _read_heading(text: str, found: re.Match) -> tuple:
    start, end = found.span()
    near = text[max(0, start - 40):min(start + 200, end + 200)]
    item, name = found[1].upper(), found[2].strip(BLANKS)
    return 0, item, name, None, None, looks_like_toc(found[0]), looks_like_toc(near), None, title_score(item, name)


def _read_title(text: str, found: re.Match, last: int, titles: dict[str, tuple[str, int, int]]) -> tuple:
    start, before = found.start(), text[max(0, found.start() - 80):found.start()]
    # The whitespace run before a title belongs to it even when the previous hit took it.
    run = _NOISE_AT_END.search(before) if start == last > 0 else None
    name = found[0].strip(_BLANK + "|")
    item, rank, case = titles[name]
    return -len(run[0]) if run else 0, item, name, rank, case, None, None, _WORD_AT_END.search(before.strip(BLANKS)) is not None, None


def line_spans(texts: pa.Array, layout: list[tuple[str, str]], heading: bool, title: str | None, titles: dict[str, tuple[str, int, int]],
               read: bool = True) -> pa.Array:
    """Per text the candidates of kind heading0..3 and title, as a list of structs of `layout` (none for a null text).

    `titles` gives the item, rank and letter case of a title. A match stands behind the gaps and lengths up to it, moved by `base`. Without
    `read` the rows are those of a plain scan: matches with the gaps and the text around them, and nothing read off them.
    """
    offsets, rows, titled = [], [], re.compile(title, re.M | re.A) if title else None

    def add(text: str, kind: str, spans):
        last, heads = 0, kind != "title"
        for idx, found in enumerate(spans):
            start, end = found.span()
            if read:
                rows.append((kind, idx, start - last, end - start, *(_read_heading(text, found) if heads else _read_title(text, found, last, titles))))
            else:
                rows.append((kind, idx, start - last, found[0], text[max(0, start - (40 if heads else 80)):start], text[end:end + (200 if heads else 0)], 0))
            last = end

    for text in texts.to_pylist():
        offsets.append(len(rows))
        if text is None:
            continue
        if heading:
            anchors = _item_anchors(text)
            for n, pattern in enumerate(_HEADINGS):
                add(text, f"heading{n}", _matches(text, pattern, anchors))
        if titled:
            add(text, "title", _matches(text, titled, _title_anchors(text, titles)))
    kinds, names = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}, _READ if read else _PLAIN
    given = dict(zip(names, zip(*rows) if rows else ((),) * len(names)))
    columns = [pa.array(given[n], kinds[t]) if n in given else pa.nulls(len(rows), kinds[t]) for n, t in layout]
    made = pa.StructArray.from_arrays(columns, [n for n, _ in layout])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(rows)], pa.int32()), made)

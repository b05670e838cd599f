"""Page content that needs the document tree: paragraphs, fields, listings, data blocks, errors, answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions.text import collapse, contains_any, extract, left, let, rlike, strip
from paperloom.operators.intents import any_paragraph_request, is_static, selected, site_of
from paperloom.session import ship_package


def _per_page(pages: DataFrame, rows_of, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run a page -> rows function in Arrow batches; the page key comes first in every row."""
    ship_package(pages.sparkSession)
    names = ["page_id"] + re.findall(r"(?:^|,)\s*(\w+)\s", schema)

    def run(batches):
        for pdf in batches:
            out = []
            for values in zip(pdf["page_id"], pdf["html"], *[pdf[c] for c in extra]):
                out += [(values[0], *row) for row in rows_of(values[1] or "", *values[2:])]
            yield pd.DataFrame(out, columns=names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html", *extra).mapInPandas(run, f"page_id {kind}, {schema}")


def tightened(text: Column) -> Column:
    """No blanks before closing and after opening punctuation; runs of blanks are one."""
    close = F.regexp_replace(text, r"(?U)\s+([,.;:!?)\]])", "$1")
    return strip(F.regexp_replace(F.regexp_replace(close, r"(?U)([(\[])\s+", "$1"), r"(?U)\s{2,}", " "))


def _numbered(found: list[tuple[bool, str]], direct: int | None, below: int) -> list[tuple[int, str]]:
    """Direct children longer than `direct`; if there are none, any paragraph longer than `below`."""
    own = [t for child, t in found if child and direct is not None and len(t) > direct]
    return list(enumerate(own or [t for _, t in found if len(t) > below], start=1))


def page_paragraphs(pages: DataFrame, container: str | None = None) -> DataFrame:
    """Numbered body paragraphs: direct children longer than 80, else any below longer than 40."""
    def rows(html):
        from paperloom.functions.markup import body_paragraphs, parse

        root = parse(html)
        box = (root.find(container) if container else root.find("article") or root.find("main") or root.find("body")) or root
        return _numbered(body_paragraphs(box), 80, 40)

    return _per_page(pages, rows, "n int, text string").withColumn("text", tightened(F.col("text")))


def site_paragraphs(pages: DataFrame, lead_chars: int | None = None) -> DataFrame:
    """Paragraphs by each site's own rules (`site` column): article pages, docs pages, repository pages.
    A repository page without paragraphs gives its whole text as number 0 (`lead_chars` of it, if given)."""
    def rows(html, site):
        from paperloom.functions.markup import body_paragraphs, parse

        root = parse(html)
        articles = lambda cls: next((n for n in root.find_all("article") if cls in n.classes), None)
        if site == "wikipedia.org":
            outer = root.find(id_="mw-content-text")
            box = outer and outer.find(cls="mw-parser-output")
            return _numbered(body_paragraphs(box), 80, 40) if box else []
        if site == "developer.mozilla.org":
            main = root.find("main")
            box = articles("main-page-content") or (main and main.find("article")) or main
            return _numbered(body_paragraphs(box), None, 40) if box else []
        box = articles("markdown-body") if site == "github.com" else None
        if not box:
            return []
        found = [t for child, t in body_paragraphs(box) if child and len(t) > 40]
        whole = box.text()[:lead_chars]
        return list(enumerate(found, start=1)) or ([(0, whole)] if len(whole) > 80 else [])

    return _per_page(pages, rows, "n int, text string", ("site",)).withColumn(
        "text", F.when(F.col("n") > 0, tightened(F.col("text"))).otherwise(F.col("text")))


#: Where a site keeps what a page says about its subject: site, part, tag, class (None: the whole element).
_PARTS = [("arxiv.org", "title", "h1", "title"), ("arxiv.org", "author", "div", "authors"), ("arxiv.org", "abstract", "blockquote", "abstract"),
          ("pypi.org", "name", "h1", "package-header__name"), ("pypi.org", "summary", "p", "package-description__summary"), ("pypi.org", "side", "aside", None)]


def page_parts(pages: DataFrame) -> DataFrame:
    """One row per page of a known site: its named parts as text, a line per string (map part -> text)."""
    def rows(html, site):
        from paperloom.functions.markup import parse

        wanted = [(part, tag, cls) for s, part, tag, cls in _PARTS if s == site]
        if not wanted:
            return []
        root = parse(html)
        found = ((part, root.find(tag, cls) or (root if part == "side" else None)) for part, tag, cls in wanted)
        return [({part: node.text("\n") if node else "" for part, node in found},)]

    return _per_page(pages, rows, "parts map<string,string>", ("site",))


def page_fields(pages: DataFrame) -> DataFrame:
    """Long table (page_id, field, value) of paper pages and package pages (`site` column)."""
    part = lambda n: F.coalesce(F.col("parts")[n], F.lit(""))
    line = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    labelled = lambda n, label: F.regexp_replace(strip(F.regexp_replace(line(part(n)), "^" + label, "")), r"(?U)\s{2,}", " ")
    words = F.filter(F.split(part("name"), r"(?U)\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    versioned = (F.size(words) >= 2) & F.coalesce(last.rlike(r"^\p{Nd}"), F.lit(False))
    title = F.array_join(F.when(versioned, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words), " ")
    # The side column names a fact on one line and tells it there or on the next.
    told = lambda label, stop: strip(extract(part("side"), label + r"\s*\n?\s*([^\n]+?)" + stop, 1))
    spelled, plain = told(r"License\s+Expression:", r"(?:\n|$)"), told("License:", r"(?:\n|$)")
    license_ = let(F.when(part("side").rlike(r"License\s+Expression:\s*\n?\s*[^\n]"), spelled).otherwise(plain), lambda x: F.when(F.upper(x) != "UNKNOWN", x))
    summary = line(part("summary"))
    paper = F.array(*[F.struct(F.lit(f).alias("field"), labelled(f, label).alias("value")) for f, label in (
        ("title", "Title:"), ("author", "Authors:"), ("abstract", "Abstract:"))])
    package = F.when((title != "") | (summary != ""), F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(v, F.lit("")).alias("value")) for f, v in (
        ("title", title), ("version", F.when(versioned, last)), ("description", summary), ("license", license_),
        ("author", told("Author:?", r"(?:\n|Maintainer|$)")))]))
    return page_parts(pages).join(pages.select("page_id", "site").distinct(), "page_id").select(
        "page_id", F.explode(F.when(F.col("site") == "arxiv.org", paper).otherwise(package)).alias("f")).select("page_id", "f.*").filter("value <> ''")


def extract_fields(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requested fields per task, or the default set for a general request (tasks carry `page_id`, `site`)."""
    defaults = F.when(F.col("site") == "arxiv.org", F.array(F.lit("title"), F.lit("abstract"))).otherwise(
        F.array(F.lit("title"), F.lit("version"), F.lit("description")))
    known = F.array(*[F.lit(f) for f in ("title", "author", "abstract", "version", "license", "description")])

    def choose(asked: Column) -> Column:
        paper = (F.col("site") == "arxiv.org") & any_paragraph_request() & ~F.col("wants_summary")
        return F.when(F.size(asked) > 0, asked).when(paper, F.array(F.lit("abstract"))).when(F.col("wants_summary"), defaults)

    wanted = tasks.withColumn("_f", let(F.array_intersect(F.col("requested_fields"), known), choose))
    return wanted.select("task_id", "page_id", F.explode("_f").alias("field")).join(page_fields(pages), ["page_id", "field"])


def listing_rows(pages: DataFrame) -> DataFrame:
    """Rows of listing pages in order: title, link and the line below."""
    def rows(html):
        from paperloom.functions.markup import Node, parse

        out, after, last = [], {}, {}
        rows_ = list(parse(html).find_all("tr"))
        for row in reversed(rows_):  # the next row with the same parent, found from the end
            after[id(row)] = last.get(id(row.parent))
            last[id(row.parent)] = row
        for row in rows_:
            if "athing" not in row.classes:
                continue
            span = row.find("span", "titleline")
            link = next((c for c in span.children if isinstance(c, Node) and c.tag == "a"), None) if span else None
            below = after[id(row)]
            out.append((len(out) + 1, link.text("") if link else "", link.attrs.get("href", "") if link else "", below.text() if below else ""))
        return out

    return _per_page(pages, rows, "n int, title string, url string, subline string")


def listing_top_n(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """The first n rows for each task (one by default); nothing if a requested number is missing in row 1."""
    number = lambda word: extract("subline", rf"(?i)(\d+)\s*{word}", 1).try_cast("int")
    rows = listing_rows(pages).withColumn("points", number("points?")).withColumn("comments", number("comments?"))
    wanted = tasks.select("task_id", "page_id", F.when(F.col("top_n") > 1, F.col("top_n")).otherwise(1).alias("top"),
                          F.array_contains("requested_fields", "points").alias("want_points"),
                          F.array_contains("requested_fields", "comments").alias("want_comments"))
    hits = wanted.join(rows, "page_id").filter((F.col("n") <= F.col("top")) & (F.col("title") != ""))
    bad = hits.groupBy("task_id", "page_id").agg(F.min_by(
        (F.col("want_points") & F.col("points").isNull()) | (F.col("want_comments") & F.col("comments").isNull()), "n").alias("bad"))
    return hits.join(bad.filter("not bad").select("task_id", "page_id"), ["task_id", "page_id"], "left_semi").select(
        "task_id", "page_id", "n", "title", "url", F.when(F.col("want_points"), F.col("points")).alias("points"),
        F.when(F.col("want_comments"), F.col("comments")).alias("comments"))


#: A value cell or list entry is at most this long; what is longer holds other blocks.
SHORT_BLOCK = 4000


def page_blocks(pages: DataFrame, short: int = SHORT_BLOCK) -> DataFrame:
    """Candidate data blocks: info boxes, tables, and short elements that hold a number (with the text
    around them). All texts are slices of one list of the page's strings."""
    def rows(html):
        from paperloom.functions.markup import Strings, parse

        root = parse(html)
        strings, out = Strings(root), []
        for n in root.walk():
            if "infobox" in n.classes or "infobox-data" in n.classes or (
                    n.attrs.get("role") == "region" and "info" in n.attrs.get("aria-label", "").lower()):
                out.append((0, len(out), strings.text(n), strings.text(n)))
            if n.tag == "table":
                out.append((1, len(out), strings.text(n), strings.text(n)))
            if n.tag in ("th", "td", "dt", "dd", "li", "span", "div") and strings.size(n) <= short:
                text = strings.text(n)
                if re.search(r"\d{2,}", text):
                    near = n.parent is not None and strings.size(n.parent) <= short
                    out.append((2, len(out), text, strings.text(n.parent) if near else text))
        return out

    return _per_page(pages, rows, "kind int, ord int, text string, context string")


def extract_blocks(pages: DataFrame, tasks: DataFrame, chars: int | None = None) -> DataFrame:
    """tasks(task_id, page_id, description) -> the best block: info box, matching table, matching element
    (`chars` of it, if given). Words of at least four letters are looked for.

    Blocks are chosen by page, kind and place; the chosen block's text is joined afterwards.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("description"), r"\W+"), lambda w: F.length(w) >= 4))
    wanted = tasks.select("task_id", "page_id", words.alias("keywords"))
    blocks = page_blocks(pages)
    hit = (F.col("kind") == 0) | F.exists("keywords", lambda k: F.contains(F.lower("text"), k))
    best = wanted.join(blocks.select("page_id", "kind", "ord", "text"), "page_id").filter(hit).groupBy("task_id", "page_id").agg(
        F.min(F.struct("kind", "ord")).alias("b")).select("task_id", "page_id", "b.*")
    chosen = best.join(blocks.drop("text"), ["page_id", "kind", "ord"])
    kind = F.when(F.col("kind") == 0, "extract_infobox").when(F.col("kind") == 1, "extract_table").otherwise("extract_kv")
    text = F.col("context") if chars is None else left("context", chars)
    return wanted.select("task_id", "page_id").join(chosen, ["task_id", "page_id"], "left").select(
        "task_id", "page_id", F.when(F.col("kind").isNull(), "extract_no_match").otherwise(kind).alias("kind"), text.alias("text"))


def page_errors(pages: DataFrame, per_page: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Texts of error-looking elements, selector by selector (at most `per_page` per page and only texts
    under `max_chars`, where given)."""
    def rows(html):
        from paperloom.functions.markup import parse

        nodes, out = list(parse(html).walk()), []
        by_class: dict[str, list] = {}
        for n in nodes:
            for cls in dict.fromkeys(n.classes):
                by_class.setdefault(cls, []).append(n)
        order = fixed.ERROR_CLASSES[:4] + [None] + fixed.ERROR_CLASSES[4:]
        for cls in order:
            found = by_class.get(cls, []) if cls else [n for n in nodes if n.attrs.get("role") == "alert"]
            out += [t for t in (n.text().strip() for n in found) if t and (max_chars is None or len(t) < max_chars)]
        return list(enumerate(out[:per_page], start=1))

    return _per_page(pages, rows, "n int, message string")


def error_counts(pages: DataFrame) -> DataFrame:
    host = F.lower(extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    found = page_errors(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("errors"))
    return pages.select("page_id", host.alias("host")).join(found, "page_id", "left").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("errors", F.lit(0))).alias("errors"),
        F.count("errors").alias("pages_with_errors"))


def page_text(pages: DataFrame) -> DataFrame:
    """All text of a page, blank-separated."""
    def rows(html):
        from paperloom.functions.markup import parse

        return [(parse(html).text(),)]

    return _per_page(pages, rows, "text string")


def answer_static(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """Tasks x stored pages, end to end: (task_id, site, answer, status).

    tasks(task_id, task, target_url + intent columns) join pages(page_id, url, html) on the URL; each
    page is parsed once per kind of content, however many tasks ask about it.
    """
    site = site_of(F.col("target_url"))
    low = F.lower("task")
    path = F.btrim(extract("target_url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"))
    parts = F.split(path, "/")
    repo_root = (F.size(parts) >= 2) & ~parts[0].isin(fixed.REPO_HOST_RESERVED_OWNERS) & ~F.coalesce(F.get(parts, F.lit(2)).isin(fixed.REPO_HOST_SUBPATHS), F.lit(False))
    ask = any_paragraph_request()
    fields = lambda *f: F.arrays_overlap("requested_fields", F.array(*[F.lit(x) for x in f]))
    eligible = (
        F.when(F.col("site") == "wikipedia.org", F.contains("target_url", F.lit("/wiki/")) & ~contains_any(low, fixed.INFOBOX_TERMS) & ask)
        .when(F.col("site") == "arxiv.org", F.contains("target_url", F.lit("/abs/")) & (fields("title", "author", "abstract") | ask))
        .when(F.col("site") == "news.ycombinator.com", F.array_contains("requested_fields", "headline") | F.col("top_n").isNotNull() | F.contains(low, F.lit("story")))
        .when(F.col("site") == "developer.mozilla.org", ask)
        .when(F.col("site") == "pypi.org", F.contains("target_url", F.lit("/project/")) & (fields("title", "version", "author", "license", "description") | F.col("wants_summary")))
        .when(F.col("site") == "github.com", ask & repo_root).when(F.col("site") == "example.com", True).otherwise(False)
    )
    asked = tasks.drop("page_id").filter(is_static(F.col("task"))).withColumn("site", site).filter(F.col("site").isNotNull()).filter(eligible)
    routed = asked.join(pages.select("page_id", F.col("url").alias("target_url")), "target_url")
    used = routed.select("page_id", "site").distinct()
    stored = pages.join(used, "page_id")

    prose = stored.filter(F.col("site").isin("wikipedia.org", "developer.mozilla.org", "github.com"))
    packed = site_paragraphs(prose).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("_s"))
    by_text = routed.join(packed, "page_id").withColumn("_lead", F.when(F.col("_s")[0]["n"] == 0, F.col("_s")[0]["text"])) \
        .withColumn("answer", F.coalesce("_lead", selected(F.transform(F.filter("_s", lambda x: x["n"] > 0), lambda x: x["text"]))))

    values = extract_fields(stored.filter(F.col("site").isin("arxiv.org", "pypi.org")), routed.filter(F.col("site").isin("arxiv.org", "pypi.org")))
    names = {"arxiv.org": [("title", "Title"), ("author", "Authors"), ("abstract", "Abstract")],
             "pypi.org": [("title", "Title"), ("version", "Version"), ("author", "Author"), ("license", "License"), ("description", "Description")]}
    order = F.coalesce(*[F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(("title", "version", "author", "abstract", "license", "description"))])
    general = routed.select("task_id", "site", (F.size(F.array_intersect("requested_fields", F.array(*[F.lit(f) for f, _ in names["pypi.org"]]))) == 0).alias("_general"))
    titled = values.join(general, "task_id")
    label = F.when((F.col("site") == "pypi.org") & F.col("_general"), F.when(F.col("field") == "title", "Package").when(
        F.col("field") == "version", "Version").otherwise("Summary"))
    for s, pairs in names.items():
        for f, text in pairs:
            label = label.when((F.col("site") == s) & (F.col("field") == f), text)
    by_field = titled.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        order.alias("o"), F.concat(label, F.lit(": "), F.col("value")).alias("t")))), lambda x: x["t"]), "\n").alias("answer"))

    top = listing_top_n(stored.filter(F.col("site") == "news.ycombinator.com"), routed.filter(F.col("site") == "news.ycombinator.com"))
    many = Window.partitionBy("task_id")
    lines = top.withColumn("_many", F.count(F.lit(1)).over(many) > 1).withColumn("_n", F.row_number().over(many.orderBy("n"))).withColumn("_l", F.concat_ws(
        "\n", F.concat(F.when(F.col("_many"), F.concat(F.col("_n").cast("string"), F.lit(". "))).otherwise("Top story: "), F.col("title")),
        F.concat(F.lit("   URL: "), F.col("url")), F.concat(F.lit("   Points: "), F.col("points").cast("string")),
        F.concat(F.lit("   Comments: "), F.col("comments").cast("string"))))
    by_list = lines.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "_l"))), lambda x: x["_l"]), "\n").alias("answer"))

    blurb = page_text(stored.filter(F.col("site") == "example.com"))
    plain = routed.filter(F.col("site") == "example.com").join(blurb, "page_id").withColumn("answer", F.when(
        contains_any(F.lower("task"), fixed.PLACEHOLDER_TERMS), F.lit(fixed.PLACEHOLDER_ANSWER)).when(F.length("text") > 40, F.col("text")))
    answers = by_text.select("task_id", "answer").unionByName(by_field.select("task_id", "answer")).unionByName(
        by_list.select("task_id", "answer")).unionByName(plain.select("task_id", "answer"))
    out = tasks.select("task_id", "target_url").withColumn("site", site).join(answers, "task_id", "left")
    text = strip(F.coalesce("answer", F.lit("")))
    return out.select("task_id", F.coalesce("site", F.lit("")).alias("site"), F.when(text != "", F.col("answer")).alias("answer"),
                      F.when(text == "", "unanswered").when(F.startswith(F.lower(text), F.lit("not_found:")), "not_found").otherwise("success").alias("status"))


def static_shares(answers: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return answers.groupBy("site").agg(
        n.alias("tasks"), F.count_if(F.col("status") != "unanswered").alias("hits"), F.count_if(F.col("status") == "not_found").alias("not_found"),
        (F.count_if(F.col("status") != "unanswered") / n).alias("hit_share"))

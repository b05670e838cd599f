"""Rules, URLs, revisits, packing, mixing: meanings by hand, round trips, small brute force."""

import itertools
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import mixing, packing, rules, url_filters, warc
from tests.llm.helpers import awkward, prose


def plain_measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l1\nl2\nl1\n \n \nl1", "# $ | <>", prose(500, 3), "é 中 \U0001f600\n" * 3, "a\x0bb\x0cc d\x1ce"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.measured(df).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_rules_plan_has_no_python(spark):
    df = rules.judge(awkward(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and df.filter("kept").count() >= 1
    assert rules.judge(awkward(spark)).filter("kept").select("row.*").columns == awkward(spark).columns


PATTERNS = ["||ads.", "/login^", "|http-start", "swf|", "||example.net/en/", "*banner*", "a*b^c", "||x.org^", "track", "/p/*/q/"]
URLS = ["http://ads.example.com/", "https://my.ads.net/x", "http://bads.net/", "http://h/login", "http://h/login?x", "http://h/login2", "http://h/a.swf", "http://h/a.swf?x",
        "http://EXAMPLE.net/en/1", "http://sub.example.net/en/", "http://example.net/de/", "http://h/xbannery", "http://h/a1b/c", "http://x.org", "http://x.org.uk/", "http://h/tracker",
        "http://h/p/1/q/", "http://h/p/q/", None, "none", "http://h/p/a/b/q/z"]


def plain_regex(pattern):
    head = "^(?:[^/?#]*\\.)?" if pattern.startswith("||") else "^" if pattern.startswith("|") else ""
    tail = "$" if pattern.endswith("|") else ""
    return head + "".join("(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else "[\\s\\S]*" if c == "*" else re.escape(c) for c in pattern.strip("|")) + tail


def test_patterns_against_every_rule(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2, "page_id long, url string")
    for pattern in PATTERNS:
        got = {r["page_id"]: r["verdict"] == "block" for r in url_filters.judge(pages, [url_filters.Rule(pattern, pattern, "block")]).collect()}
        want = {}
        for i, u in enumerate(URLS):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0]
            want[i] = bool(re.search(plain_regex(pattern), host.lower() + rest[len(host):])) and bool(u)
        assert got == want, pattern
    assert url_filters.judge(pages, []).filter("verdict <> 'allow' or rule is not null").count() == 0


def test_rules_native_and_longest(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x", "h"), (2, "http://example.net/e", "h"), (3, "http://net", "h"), (None, "http://net/", "h")], "page_id long, url string, host string")
    listed = [url_filters.host_rule("net/", "block"), url_filters.host_rule("example.net/en/", "allow")]
    df = url_filters.judge(pages, listed)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=str) == [
        (0, "net", "/", "net/", "block"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/e", "net/", "block"), (3, "net", "", None, "allow")]


def test_revisits_by_hand(spark):
    rows = [
        (1, "http://H/a/", 10, "response", {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}), (2, "https://h/a#x", 20, "revisit", {"etag": 'W/"1"', "x": "new", "Content-Type": "no"}),
        (3, "http://h/a?utm_source=q", 30, "response", {"etag": '"2"'}), (4, "http://h:80/a", 30, "revisit", {"ETAG": '"1"'}), (5, "http://h/a", 31, "revisit", {"etag": '"1"'}),
        (6, "http://h/a", 5, "revisit", None), (7, None, 5, "revisit", None), (8, "http://h/a", None, "revisit", None), (9, "http://h/b?y=2&x=1", 1, "response", {"last-modified": "d"}),
        (10, "http://h/b?x=1&y=2", 2, "revisit", {"Last-Modified": "d"}), (11, "http://h/b?x=1&y=2", 3, "revisit", {"Date": "d"}), (12, "http://h/a", 40, "request", None),
        (None, "http://h/c", 1, "response", {"etag": "z"}), (13, "http://h/c", 2, "revisit", {"etag": "z"}), (13, "http://h/c", 2, "revisit", {"etag": "z"})]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "record_id long, url string, captured_at long, record_type string, headers map<string,string>, part string, at long")
    got = sorted(((r["record_id"], r["outcome"], r["response_id"], r["h"]) for r in warc.resolve(df).withColumn("h", warc.header_text(warc.F.col("headers"))).collect()), key=str)
    assert got == sorted([
        (2, "resolved", 1, 'content-type: text/html\netag: W/"1"\nx: new'), (4, "resolved", 1, 'content-type: text/html\netag: "1"\nx: old'), (5, "mismatch", 3, None), (6, "no_response", None, None),
        (7, "no_url", None, None), (8, "no_time", None, None), (10, "resolved", 9, "last-modified: d"), (11, "no_validator", 9, None), (13, "resolved", None, "etag: z"), (13, "resolved", None, "etag: z")], key=str)


def test_revisits_of_one_hot_url(spark):
    rows = [(i, "http://hot/", i // 2, "response" if i % 3 == 0 else "revisit", {"etag": f'"{i - i % 3}"'}) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, captured_at long, record_type string, headers map<string,string>")
    got = {r["record_id"]: r["response_id"] for r in warc.resolve(df.repartition(6)).collect()}
    full = [(at, i) for i, _, at, kind, _ in rows if kind == "response"]
    assert got == {i: max(((a, j) for a, j in full if a < at), default=(None, None))[1] for i, _, at, kind, _ in rows if kind == "revisit"}


def plain_best_fit(lengths, window):
    room, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            at = room.index(min(fits))
            room[at] -= lengths[i]
        else:
            room.append(window - lengths[i])
    return len(room), sorted(room)


@pytest.mark.parametrize("window", [7, 64, 1000])
def test_best_fit_against_a_plain_scan(window):
    lengths = np.random.default_rng(window).integers(1, window + 1, 300)
    numbers, offsets = packing.best_fit_decreasing(lengths, window)
    used = np.bincount(numbers, weights=lengths).astype(int)
    n, room = plain_best_fit(lengths.tolist(), window)
    assert len(used) == n and sorted((window - used).tolist()) == room
    for w in range(n):  # gapless from 0
        inside = sorted((int(offsets[i]), int(lengths[i])) for i in np.flatnonzero(numbers == w))
        assert [o for o, _ in inside] == [0, *itertools.accumulate(x for _, x in inside)][:-1]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = awkward(spark)
    want = []
    for r in docs.collect():
        ids = [*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"] or 0, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= 1024
    assert packing.pack(docs, shard=3).select("sequence_id", "offset").distinct().count() == len(rows)


def test_ranks_and_rules_file_agree():
    from tokenizers import Tokenizer

    import public_tokenizers as P

    exact, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.default_encoder()
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(chr(c) for c in rng.choice([*range(32, 127), *range(160, 0x250), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x0660, 0x1F600, 0x301, 0xAD], 40))
        assert fast(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_targets_share_the_excess():
    got = mixing.targets({"a": 10, "b": 100, None: 100, "c": 100}, (5, 2, 1), 1.5, 2)
    assert got["a"] == 20.0 and got[None] == got["a"] + 0 or sum(got.values()) == pytest.approx(465)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 100, None: 100, "c": 100}.items()) and got["b"] == pytest.approx(2 * got["c"])
    assert mixing.targets({"a": 0, "b": 0}, (5, 2, 1), 1.5, 2) == {"a": 0.0, "b": 0.0} and mixing.targets({}, (1,), 1.5, 2) == {}


def plain_flow(capacity, members, quotas, repeats):
    """The best total and its least cost by trying every integer flow."""
    options = []
    for c, m in zip(capacity, members):
        options.append([x for x in itertools.product(*[range(min(repeats * c, quotas[s]) + 1) for s in m]) if sum(x) <= repeats * c])
    best = (-1, 0)
    for choice in itertools.product(*options):
        into = [0] * len(quotas)
        for m, x in zip(members, choice):
            for s, n in zip(m, x):
                into[s] += n
        if any(a > q for a, q in zip(into, quotas)):
            continue
        cost = 0
        for c, x in zip(capacity, choice):
            left = sum(x)
            for k in range(repeats):
                cost += k * min(left, c)
                left -= min(left, c)
        best = max(best, (sum(into), -cost))
    return best


def test_flow_against_every_flow():
    rng = np.random.default_rng(4)
    for _ in range(25):
        sources, repeats = 2, int(rng.integers(1, 3))
        members = [sorted(rng.choice(sources, rng.integers(1, sources + 1), replace=False).tolist()) for _ in range(3)]
        capacity, quotas = rng.integers(0, 4, 3).tolist(), rng.integers(0, 6, sources).tolist()
        flow = mixing.min_cost_flow(capacity, members, quotas, repeats)
        cost = sum(k * min(max(sum(f.values()) - k * c, 0), c) for c, f in zip(capacity, flow) for k in range(repeats))
        assert (sum(sum(f.values()) for f in flow), -cost) == plain_flow(capacity, members, quotas, repeats)


def test_mix_overlapping_sources(spark):
    rows = [(i, prose(10, i), ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else [None]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got = mixing.mix(docs, sources=mixing.F.col("sources")).collect()
    assert len(got) == 90 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert abs(sum(r["taken"] for r in got) - 1350) <= 20
    again = mixing.mix(docs.repartition(7), sources=mixing.F.col("sources")).collect()
    key = lambda r: (r["row"]["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(awkward(spark, True)).count() == 0
    sizes = sum(plain_measures(r["text"])[0] for r in out.collect())
    assert sizes == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_mix_splits_equal_rows(spark, tmp_path):
    """A thousand equal rows of one identifier, and a thousand without one: near the target, as the SQL has it."""
    from paperloom.llm import oracle, queries
    from tests.llm.helpers import duck, same

    one = [(7, "a", "one two three four five six seven eight nine ten")] * 1000 + [(i, "b", "w " * (i % 9)) for i in range(300)]
    none = [(None, "a", "one two three four five")] * 1000 + [(None, None, "x y")] * 37 + [(5, "c", "p q")] * 3
    for name, rows in (("one", one), ("none", none)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        assert same(queries.mixed_sources(spark, folder), duck({"documents": docs.toArrow()}), oracle.ORACLE["op10_source_mixing"]) == len(rows)
        sums = queries.mixed_sources(spark, folder).groupBy("target").agg({"taken": "sum", "size": "max"}).collect()
        assert all(abs(r["target"] - r["sum(taken)"]) <= r["max(size)"] for r in sums)


def test_mix_of_very_many_sources(spark):
    many = spark.range(mixing.MAX_PATTERNS + 5).selectExpr("id AS doc_id", "concat('s', id) AS source", "'a b c' AS text")
    assert {r["copies"] for r in mixing.mix(many).select("copies").distinct().collect()} <= {1, 2} and mixing.mix(many).count() == mixing.MAX_PATTERNS + 5


def test_mix_where_workers_cannot_import_the_package(tmp_path):
    """A session started elsewhere, whose workers see neither the repository nor its folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {root!r})
from paperloom.llm import mixing
assert mixing.mix(spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)

"""Each operator against brute force, with null, empty, long, tied and repeated rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemascope.llm import exact, html_runs, jaccard, lengths, mixing, packing, quality, queries, sharding, tokens, url_cascade, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 30, 80, 200)))) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(40):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        made.append(" ".join(w))
    made += [made[10].upper(), made[10] + "\n", " " + made[10], made[11], made[11], None, None, "", " \t\n", "x" * 5000]
    made += [" ".join(rng.choice(vocabulary) for _ in range(30_000)), "a b c d e f g h " * 10, "line one here\nline one here\n \n\nline two\u00a0x", "w\u0085w w\u001cw", "日本語 テキスト", "### %%% a"]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", 3) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "a null id and some words", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_packing_holds_every_piece_once(spark, docs):
    got = packing.pack(docs).collect()
    encode = tokens.Encoder(tokens.default_tokenizer())
    want = collections.Counter()
    for key, text in rows_of(docs):
        ids = np.append(encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[key, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= math.ceil(sum(r.length for r in got) / 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(4096, rng.lognormal(5.5 + seed / 2, 1.2, 30_000).astype(int) + 1)
    plan = packing.Plan(dict(zip(*[x.tolist() for x in np.unique(sizes, return_counts=True)], strict=True)))
    large = (sizes > 2048).sum()
    assert plan.sequences <= max(large, math.ceil(sizes.sum() / 4096)) * 1.01 + 1
    assert plan.fitted > 0


def test_nnls_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((5, 4)), rng.random(5)
        best = min(
            (np.linalg.norm(a @ x - b) for m in range(16) for x in [np.zeros(4)] for at in [[i for i in range(4) if m >> i & 1]] if not at or ((s := np.linalg.lstsq(a[:, at], b, rcond=None)[0]) >= 0).all() and x.__setitem__(at, s) is None),
        )
        assert np.linalg.norm(a @ packing.nnls(a, b) - b) == pytest.approx(best, abs=1e-8)


def test_lengths(spark, docs):
    got = {r.length: r for r in lengths.context_totals(lengths.length_histogram(docs)).collect()}
    encode = tokens.Encoder(tokens.default_tokenizer())
    sizes = [len(encode.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows_of(docs)]
    assert sorted(got) == sorted(set(sizes))
    for n, r in got.items():
        assert (r.n_docs, r.docs_up_to, r.docs_longer) == (sizes.count(n), sum(x <= n for x in sizes), sum(x > n for x in sizes))
        assert r.tokens_up_to == sum(x for x in sizes if x <= n) and r.tokens_longer == sum(x for x in sizes if x > n)
        assert r.tokens_truncated == sum(min(x, n) for x in sizes)
    table = lengths.context_totals(lengths.length_histogram(docs)).cache()
    for limit in (1, 17, 100, 4096, 10**6):
        assert lengths.truncated_at(table, limit) == sum(min(x, limit) for x in sizes)
    assert lengths.quantile(table, 0.5) == sorted(sizes)[math.ceil(len(sizes) / 2) - 1]


def figures(text):
    words = WORD.findall(text or "")
    found = collections.defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i : i + 8])].append(i)
    marked = {j for places in found.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality_figures_and_cascade(spark, docs):
    got = quality.judge(docs)
    assert got.columns.count("kept") == 1 and got.schema["kept"].dataType.simpleString() == "boolean"
    base = {}
    for r in got.collect():
        n = figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
        base[r.doc_id] = r.kept
    rules = quality.default_rules()
    for order in (list(rules), list(rules)[::-1]):
        assert {r.doc_id: r.kept for r in quality.judge(docs, order=order).collect()} == base
    order = quality.ordered_rules(docs, rules)
    assert sorted(x[0] for x in order) == sorted(rules)
    gains = [share / cost for _, cost, share in order]
    assert all(a * 2 >= b for i, a in enumerate(gains) for b in gains[i + 1 :])


def test_quality_order_repeats_and_columns_stay(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("word", "other", "thing", "###" if i % 5 == 0 else "plain", "LOUD" if i % 3 == 0 else "calm")) + str(rng.randrange(40)) for _ in range(150))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_meta", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("Kept", F.lit("old")).cache()
    orders = {tuple(x[0] for x in quality.ordered_rules(docs, {k: quality.default_rules()[k] for k in ("symbols", "few_letters", "capitals")})) for _ in range(3)}
    assert len(orders) == 1
    got = quality.judge(docs, order=["symbols"])
    assert got.columns[:5] == ["doc_id", "text", "_meta", "_text", "a.b"] and got.columns.count("kept") == 1 and "Kept" not in got.columns
    assert {r["_text"] for r in got.select("_text").collect()} == {"x"}


def test_exact_groups(spark, docs):
    got = exact.exact_groups(docs, block=64).collect()
    groups = collections.defaultdict(list)
    for key, text in rows_of(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key or 0, key))
    want = collections.Counter()
    for plain, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(plain.encode()).hexdigest()
        for m in members:
            want[m[3], keep, len(members), sha] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def shingle_set(text, k):
    words = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def near(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return collections.Counter((key, len(sets[i]), key if not sets[i] else least.get(root(i))) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent,few,block", [(3, 90, 8, 1 << 20), (5, 80, 3, 900), (5, 80, 8, 1 << 20), (3, 90, 2, 700), (5, 80, 2, 1 << 20)])
def test_near_classes(spark, docs, k, percent, few, block):
    got = jaccard.near_classes(docs, words=k, percent=percent, few=few, block=block).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near(rows_of(docs), k, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_cross_links_against_all_pairs(percent):
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 3, 1 << 18).astype(np.uint8)
    for _ in range(30):
        base = rng.integers(0, 2**63, 120).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(120) > rng.choice([0, 0.05, 0.15])], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(40)]
        labels = rng.integers(0, rng.integers(1, 12), 40).tolist()
        want, got = jaccard._Sets(labels), jaccard._Sets(labels)
        for i in range(40):
            for j in range(i):
                if (100 + percent) * len(np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j])):
                    want.join(i, j)
        found = jaccard.cross_links(sets, labels, levels, percent)
        assert all(got.join(i, j) for i, j in found)
        assert [got.root(i) for i in range(40)] == [want.root(i) for i in range(40)]


def test_drop_near_keeps_one_of_each(spark, docs):
    kept = jaccard.drop_near(docs)
    assert kept.columns == docs.columns
    rows = rows_of(docs)
    want = near(rows, 5, 80)
    classes = {(c if n else (key, "empty")) for key, n, c in want}
    assert kept.where("doc_id is not null").count() == len([c for c in classes if c is not None])


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (2, "one two three four five six", "b"), (3, "quite another text than that", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({"__key": F.col("key"), "row": F.lit(1), "sig": F.lit(2), "cid": F.lit(3), "a.b": F.lit(4)})
    for kept in (exact.dedup(docs), jaccard.drop_near(docs)):
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.key, r["__key"], r["a.b"]) for r in kept.collect()) == [(1, "a", "a", 4), (3, "c", "c", 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(rng.choice((40, 70, 130)))]
    up = list(range(120))
    for _ in range(120):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = dict(jaccard.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: up[x] for x in nodes}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(jaccard.components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_many_links(spark):
    rng = random.Random(5)
    links = spark.createDataFrame([(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(20)], "a long, b long")
    assert dict(jaccard.components(links, few=0).collect()) == dict(jaccard.components(links).collect())


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    jaccard.components(links)
    jobs = len(context.statusTracker().getJobIdsForGroup("few links"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 6


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_classes_without_broadcasts(spark, docs, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    seen, marked = [], jaccard._marked
    monkeypatch.setattr(jaccard, "_marked", lambda wanted: seen.append(1) or marked(wanted))
    got = jaccard.near_classes(docs, words=k, percent=percent).collect()
    assert seen and collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near(rows_of(docs), k, percent)


def test_marked_has_the_places_of_all_that_is_wanted(spark):
    wanted = spark.createDataFrame([(i * 7919, -i) for i in range(300)] + [(None, 5)], "doc_id long, text_hash long")
    places = {r[0] for r in wanted.select(jaccard._place()).collect()}
    assert set(np.flatnonzero(np.unpackbits(jaccard._marked(wanted), bitorder="little")).tolist()) == places


def test_sharding_law_rows(spark, docs):
    for frame in (docs, docs.limit(3), docs.limit(0)):
        got = sharding.shard(frame).collect()
        n = frame.count()
        assert len(got) == n
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by.get(s, ())) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    want = collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows_of(docs))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in sharding.shard(docs).collect()) == want


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i // 4}") for i in range(4000)] + [(10_000 + i, "hot") for i in range(2000)] + [(20_000 + i, f"single {i}") for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().merge(__import__("pandas").DataFrame(rows, columns=["doc_id", "text"]))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    cut = (got[got.doc_id < 4000].groupby("text").shard.nunique() > 1).mean()
    assert cut < 0.15, cut


@pytest.mark.parametrize("singles", [2000, 0])
def test_sharding_with_a_hot_group_joins_the_others(spark, singles):
    rng, rows = random.Random(4), [(i, "hot") for i in range(6800)]
    while len(rows) < 20_000 - singles:
        rows += [(len(rows) + i, f"text {len(rows)}") for i in range(rng.choice((2, 3, 5, 10, 40)))]
    rows += [(len(rows) + i, f"single {i}") for i in range(singles)]
    text = dict(rows)
    by, sizes = collections.defaultdict(set), collections.Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by[text[r.doc_id]].add(r.shard)
        sizes[r.shard] += 1
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len(by.pop("hot")) == 3
    cut = sum(len(s) > 1 for s in by.values())
    assert cut <= 16, (cut, len(by))


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def test_url_rules(spark):
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "a.net", "x.org", "a.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1?q", "/fr/#a", "?x=/en/", "#y", "/a/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.com/"]
    got = url_cascade.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)), RULES).collect()

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        return host, path, rule, RULES.get(rule, "allow")

    assert {r.page_id: tuple(r)[1:] for r in got} == {i: want(u) for i, u in enumerate(urls)}


def test_cascade_is_exact():
    rng = random.Random(2)
    universe = {f"key{rng.random()}" for _ in range(20_000)}
    listed = set(list(universe)[:300])
    first = url_cascade.Cascade.first(listed, len(universe))
    wrong = {k for k in universe - listed if k in first}
    assert wrong
    cascade = url_cascade.Cascade.build(first, listed, wrong)
    assert len(cascade.levels) > 2
    assert {k for k in universe if k in cascade} == listed


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <article> -->
<div class="ad">buy</div><article><h1>Head &amp; line</h1><p>One <b>two</b>
 three.<br><p>Four&nbsp;five&#33;<div class="comments"><p>me too</p></div><aside>side</aside><form>f<input></form></p></article><footer>&copy; foot</footer>"""


def test_html_articles(spark):
    got = html_runs.extract(spark.createDataFrame([(1, "http://a.b/", PAGE, "x"), (2, None, None, "y"), (3, "http://a.b/", "", "z"), (4, "u", "<p>", ""), (1, "http://a.b/", PAGE, "x")], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 5
    assert by == {1: "Head & line\nOne two three.\nFour five!", 2: "", 3: "", 4: ""}


@pytest.mark.parametrize("chunk", [1000, 2])
def test_html_without_articles_drops_what_pages_of_a_host_repeat(spark, chunk):
    notice = "all rights reserved by the owners of this site since long ago"
    rows = [(i, "http://h.com/" + str(i), f"<div>{notice}</div><p>page {i} says its own words number {i * 7} here</p><p>{notice}</p>") for i in range(9)] + [(20, "http://other.com/", f"<p>{notice}</p>")]
    got = {r.page_id: r.text for r in html_runs.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=chunk).collect()}
    assert got == {i: f"page {i} says its own words number {i * 7} here" for i in range(9)} | {20: notice}


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>t</title><body><p>real text</p>", "real text"),
        ('<article><p class="ad">buy<div>real text</div><h2>more</h2></article>', "real text\nmore"),
        ('<article><p class="share price">a b</p><div class="related work">c d</div></article>', "a b\nc d"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table>x<ul><li>one<li>two <i>i</i></ul></article>", "a\nb\nc\nx\none\ntwo i"),
        ("<article><p title=it's>ok</p><p class=\"x>text</p></article>", "ok\ntext"),
        ("<main>1 < 2 &lt; 3 &amp<!-- no --> 4<script>if (a < b) '</p>'</script></main>", "1 < 2 < 3 & 4"),
        ("<p>open <b>tags <p>never end", "open tags\nnever end"),
        ('<nav class=x><ul><li>menu</ul></nav><div role="banner">b</div><p>text</p><footer>f', "text"),
    ],
)
def test_html_blocks(page, text):
    blocks = html_runs.blocks_of(page)
    wanted = html_runs.ARTICLE if any(r == html_runs.ARTICLE for r, _ in blocks) else html_runs.UNKNOWN
    assert "\n".join(t for r, t in blocks if r == wanted) == text


@pytest.mark.parametrize("unit", ["<a", '<a "', "<!--", "<p>", '<a b="', "</", "<script>", "<", "<div>", "<li>", "<td>"])
def test_html_time_is_linear(unit):
    import time

    began = time.perf_counter()
    html_runs.blocks_of(unit * 100_000 + "</p>" * 50_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("chunk", [1000, 4])
def test_html_hosts_against_brute_force(spark, chunk):
    """Generated hosts, some pages with an article; runs counted by brute force over all windows."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefgh")
    line = lambda n: " ".join(word() for _ in range(n))
    rows, wanted, streams = [], {}, collections.defaultdict(list)
    for host in range(6):
        notice, offer, shared = line(9), line(7), line(25)
        for k in range(rng.choice((1, 2, 5, 16))):
            body = [line(rng.randint(3, 30)), shared if k < 2 else line(12), line(4)]
            marked, key = rng.random() < 0.3, len(rows)
            blocks = [notice, *body, offer] if rng.random() < 0.8 else body
            main = f"<article>{''.join(f'<p>{b}' for b in body)}</article>" if marked else "".join(f"<p>{b}" for b in body)
            page = "<head><title>t</title><body><nav><ul><li>go home now</ul></nav>" + (f"<div>{notice}</div>{main}<div>{offer}</div>" if len(blocks) > 3 else main) + "<footer>foot</footer>"
            rows.append((key, f"http://h{host}.org/{k}", page))
            streams[host].append((key, marked, ["go home now", *([notice, offer] if marked and len(blocks) > 3 else [] if marked else blocks), "foot"], body))
    for pages in streams.values():
        need = max(3, math.ceil(len(pages) / 5))
        windows = collections.defaultdict(set)
        for key, _, blocks, _ in pages:
            t = " ".join(blocks).split()
            for i in range(len(t) - 5):
                windows[tuple(t[i : i + 6])].add(key)
        for key, marked, blocks, body in pages:
            t = " ".join(blocks).split()
            starts = [i for i in range(len(t) - 5) if len(windows[tuple(t[i : i + 6])]) >= need]
            every, kept, at = {j for i in starts for j in range(i, i + 6)}, [], 0
            for b in blocks:
                n = len(b.split())
                inside = {j for i in starts if at <= i and i + 6 <= at + n for j in range(i, i + 6)}
                gone = set(range(at, at + n)) if set(range(at, at + n)) <= every else inside
                kept.append(" ".join(t[j] for j in range(at, at + n) if j not in gone))
                at += n
            wanted[key] = "\n".join(body) if marked else "\n".join(x for x in kept[1:-1] if x)
    got = {r.page_id: r.text for r in html_runs.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=chunk).collect()}
    assert got == wanted


@pytest.mark.parametrize("chunk", [1000, 4])
def test_html_runs_decide_where_every_page_marks_its_article(spark, chunk):
    """Repeated tokens are counted on hosts of articles only too, against all windows; articles that hold them stay whole."""
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefgh")
    line = lambda n: " ".join(word() for _ in range(n))
    rows, wanted, streams = [], {}, collections.defaultdict(list)
    for host in range(5):
        notice, offer, copied = line(9), line(7), line(20)
        for k in range((1, 3, 4, 15, 22)[host]):
            around = [notice if rng.random() < 0.7 else line(8), offer if rng.random() < 0.3 else line(6)]
            body = [line(rng.randint(1, 20)), copied, *([notice] if k == 0 else [])]
            rows.append((len(rows), f"http://m{host}.org/{k}", f"<div>{around[0]}</div><article>{''.join(f'<p>{b}' for b in body)}</article><div class=ad>{around[1]}</div>"))
            streams[host].append((len(rows) - 1, " ".join(around).split(), " ".join(body).split(), body))
    for pages in streams.values():
        windows = collections.defaultdict(set)
        for key, outside, _, _ in pages:
            for i in range(len(outside) - 5):
                windows[tuple(outside[i : i + 6])].add(key)
        for key, outside, inside, body in pages:
            covered = [{j for i in range(len(t) - 5) if len(windows.get(tuple(t[i : i + 6]), ())) >= max(3, math.ceil(len(pages) / 5)) for j in range(i, i + 6)} for t in (outside, inside)]
            wanted[key] = ("\n".join(body), sum(map(len, covered)))
    got = html_runs.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=chunk)
    assert {r.page_id: (r.text, r.n_repeated) for r in got.collect()} == wanted and sum(n > 0 for _, n in wanted.values()) > 20


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 60, 200):
        x = rng.integers(0, 3, n)
        order, shared = html_runs.suffix_array(x)
        suffixes = [tuple(x[i:]) for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        for k in range(1, n):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            assert shared[k] == next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é x\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "WARC/1.0\r\n\r\n"), (7, "u", "same"), (7, "u", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("bytes", F.lit(1))
    bundles = warc.write_bundles(df, bundle=1000, frame=100)
    got = warc.read_bundles(bundles).collect()
    by = collections.defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in pages:
        data, best = (h or "").encode(), max(by[h or ""])
        want[i, len(data), warc.digest(data), "response" if i == best else "revisit", None if i == best else best] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    stored = {r.bundle: bytes(r.bytes) for r in bundles.collect()}
    places = {(r.page_id, r.bundle, r.frame, r.frame_offset) for r in got}
    for r in warc.index_of(bundles).collect():
        assert (r.page_id, r.bundle, r.frame, r.frame_offset) in places
        headers, _, _ = warc.read_record(stored[r.bundle], r.frame, r.frame_offset, r.length)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (None, None, None)], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_bundles(warc.write_bundles(odd)).collect()}
    assert got == {(None, "response", None, 4), (3, "response", None, 4), (None, "response", None, 0)}


def test_warc_files_are_read_through_the_index(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"page {i} " * (i * 7 % 40)) for i in range(60)]
    bundles = warc.write_bundles(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), bundle=4000, frame=700)
    folder = tmp_path.as_uri() + "/out"
    files = {r.bundle: (r.path, r.size) for r in warc.export_bundles(bundles, folder).collect()}
    assert sorted(files) == sorted(p.name for p in (tmp_path / "out").iterdir()) and len(files) > 3
    whole = {}
    for name, (path, size) in files.items():
        data = open(path, "rb").read()
        assert len(data) == size
        # any reader of the format sees the frames one after the other
        whole[name] = warc.zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole[name].startswith(b"WARC/1.0")
    assert sum(len(list(warc.parse(x))) for x in whole.values()) == 60
    for r in warc.index_of(bundles).collect():
        headers, _, payload = warc.read_from_file(folder, r.bundle, r.frame, r.frame_offset, r.length)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
        if headers["WARC-Type"] == "response":
            assert payload.decode() == pages[r.page_id][2]


def mixing_docs(spark, n=1200):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(["clean", "toxic", "junk"], [7, 2, 1])[0]
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 200))]
        if kind == "toxic":
            words[3], words[9] = "nasty", "rude"
        if kind == "junk":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, kind))
    return spark.createDataFrame(rows, "doc_id long, text string, rate string"), labels


def test_mixing_meets_targets_and_classifies(spark):
    docs, labels = mixing_docs(spark)
    known = spark.createDataFrame(labels[:600], "doc_id long, domain string")
    got = mixing.mix(docs, known, weights={"clean": 0.9, "toxic": 0.04, "junk": 0.06}).toPandas()
    total = got.tokens.sum()
    for d, w in (("clean", 0.9), ("toxic", 0.04), ("junk", 0.06)):
        assert (got.rate * got.tokens * got[f"p_{d}"]).sum() == pytest.approx(w * total, rel=0.02)
    assert (got.rate >= 0).all()
    truth = dict(labels)
    held = got[got.doc_id >= 600]
    said = held[["p_clean", "p_toxic", "p_junk"]].idxmax(axis=1).str[2:]
    assert (said == held.doc_id.map(truth)).mean() > 0.95
    assert np.allclose(got[["p_clean", "p_toxic", "p_junk"]].sum(axis=1), 1)


def test_mixing_posteriors_on_held_out_labels(spark):
    """Half of the supplied labels fit, the other half judges: accuracy, and each domain's share of the tokens."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    domains = queries.domain_labels(labels)
    fit, held = (domains.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k) for k in (0, 1))
    got = mixing.mix(docs, fit, weights={}).join(held, "doc_id").toPandas()
    names = [c for c in got.columns if c.startswith("p_")]
    right = (got[names].idxmax(axis=1).str[2:] == got.domain).mean()
    assert right > 0.08 + got.domain.value_counts(normalize=True).max()
    shares = got[names].mul(got.tokens, axis=0).sum() / got.tokens.sum()
    for name in names:
        assert abs(shares[name] - got.tokens[got.domain == name[2:]].sum() / got.tokens.sum()) < 0.06


def test_classifier_looks_up_a_texts_words_once(spark, monkeypatch):
    """The words a text shares with the vocabulary are found once for each text, not once for each word of the vocabulary."""
    docs, labels = mixing_docs(spark, 200)
    plans = []
    monkeypatch.setattr(mixing, "stage", lambda df, name, stage=mixing.stage: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stage(df, name))
    mixing.fit_domains(docs, spark.createDataFrame(labels, "doc_id long, domain string"))
    plan = dict(plans)["vectors"]
    assert plan.count("array_intersect(") == 1 and plan.index("array_intersect(") < plan.index("lambdafunction(")


def test_mixing_rows_keeps_clashing_columns(spark):
    docs, labels = mixing_docs(spark, 200)
    docs = docs.withColumn("_tokens", F.lit(1)).withColumn("p", F.lit("p")).withColumn("x", F.lit(3)).withColumn("row", F.lit(4))
    known = spark.createDataFrame(labels + [(0, "zzz")], "doc_id long, domain string")
    got = mixing.mix_rows(docs, known, totals={"toxic": 0.0})
    assert sorted(got.columns) == ["_tokens", "doc_id", "p", "rate", "row", "text", "x"] and got.schema["rate"].dataType.simpleString() == "double"
    rows = got.toPandas()
    assert len(rows) == 200 and set(rows["_tokens"]) == {1} and set(rows.p) == {"p"} and set(rows["row"]) == {4}
    kinds = dict(labels)
    toxic = rows.doc_id.map(kinds) == "toxic"
    assert rows.rate[toxic].mean() < 0.2 and rows.rate[~toxic].mean() > 0.95
    times = got.select("doc_id", "rate", mixing.copies(F.col("rate"), F.col("doc_id"), 0.1).alias("times")).toPandas()
    assert (times.times[(times.rate - 1).abs() < 0.1] == 1).all()


def test_mixing_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.rate for r in mixing.mix(docs, none).collect()} == {1.0}
    some = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "b")], "doc_id long, domain string")
    assert mixing.mix(docs, some).count() == docs.count()
    assert mixing.mix(docs.limit(0), some).count() == 0


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    assert packing.pack(empty).count() == 0
    assert lengths.context_totals(lengths.length_histogram(empty)).count() == 0
    assert quality.judge(empty).count() == 0
    assert exact.exact_groups(empty).count() == 0
    assert exact.dedup(empty).count() == 0
    assert jaccard.near_classes(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_runs.extract(pages).count() == 0
    assert url_cascade.judge_urls(pages, RULES).count() == 0


def test_encoder_gives_the_librarys_ids():
    rng = random.Random(1)
    letters = "abcXYZ 019'’.,!?#<>|&%éÀßñŒĲıİſŁ́ \u0085\x1c\n\t日本Σσςµ²½Ⅳ😀​'S'll'Re "
    texts_ = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> a", "don't WE'LL I'M x's'T", "a" * 3000, None, ""]
    encode = tokens.Encoder(tokens.default_tokenizer(), limit=300)
    assert encode.simple
    for _ in range(2):
        for t, x in zip(texts_, encode(texts_), strict=True):
            assert encode.tokenizer.encode(t or "", add_special_tokens=False).ids == x.tolist()


def test_encoder_keeps_frequent_words_when_its_dictionary_is_full():
    """Words that come again and again are merged once, in any case and with or without a closing mark, however many new ones pass."""
    encode = tokens.Encoder(tokens.default_tokenizer(), limit=400)
    names = ["".join(x) for x in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou", "rstvz")]
    often, rare = names[:100], names[100:]
    merge, merged = encode.merge, collections.Counter()
    encode.merge = lambda part: merged.update([part]) or merge(part)
    texts_ = [" ".join([*often, *(w.title() + "," for w in often), *rare[i : i + 50]]) for i in range(0, len(rare), 50)]
    for t, x in zip(texts_, encode(texts_), strict=True):
        assert encode.tokenizer.encode(t, add_special_tokens=False).ids == x.tolist()
    assert len(encode.words) <= 400 and {merged[w] for w in often} == {1}


def test_encoder_lower_cases_before_composing_only_where_it_is_the_same():
    marks = ["\u0331", "\u0308", "\u030a", "\u030c", "\u0307", "\u0301", "\u0344"]
    texts_ = [f"{a}{m}{b} Abc. {a}{b}, Z" for a in "HTWYJIEKhtwyjiek\u212a\u00c4\u00d7\u00f7" for m in marks for b in ("", "a", ".", "...", "\u00c9.", "'S.", "\u00d7.")]
    texts_ += [t.replace(m, "") for t in texts_ for m in marks[:1]] + ["<|ENDOFTEXT|> Ab.", "A<|endoftext|>. B", "\u00e9. \u00c9; \u00f7. \u00d7, \u00bb. \u00aa. \u0178. a.\x1cB.\x0b."]
    encode = tokens.Encoder(tokens.default_tokenizer(), limit=50)
    for t, x in zip(texts_, encode(texts_), strict=True):
        assert encode.tokenizer.encode(t, add_special_tokens=False).ids == x.tolist(), t


@pytest.mark.parametrize("percent", [80, 90])
def test_filters_lose_no_link(percent):
    rng = np.random.default_rng(7)
    levels = rng.integers(0, 3, 1 << 18).astype(np.uint8)
    links = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        other = np.concatenate([base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1])], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])
        x, y = np.unique(base), np.unique(other)
        both = len(np.intersect1d(x, y))
        if not len(y) or (100 + percent) * both < percent * (len(x) + len(y)):
            continue
        links += 1
        for order in range(3):
            a, b = (jaccard._keyed(z, levels, percent, order) for z in (x, y))
            assert jaccard.may_link(*[jaccard.short_keys(z, levels, percent, order) for z in (x, y)], len(x), len(y), percent)
            p, q = next((int(np.flatnonzero(a[0] == t)[0]), int(np.flatnonzero(b[0] == t)[0])) for t in a[0] if t in b[0])
            assert (100 + percent) * (1 + min(len(x) - p - 1, len(y) - q - 1)) >= percent * (len(x) + len(y))
    assert links > 50

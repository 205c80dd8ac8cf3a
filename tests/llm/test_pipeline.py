"""The pipeline's stages on a small corpus, and its registration."""

import collections
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from schemascope.llm import mixing, queries, tokens

from .test_operators import figures, near

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == docs.count() or k == 3
            sizes.append(docs.count())
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    assert set(packed.doc_id) == {r.doc_id for r in spark.read.parquet(str(tmp_path / "3")).collect()}


def test_quality_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    long_enough = docs.where("size(split(trim(text), '\\\\s+')) >= 20").join(labels, "doc_id", "left_semi")
    lost = long_enough.join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.02 * long_enough.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_mixing_stage_keeps_clean_documents_and_drops_toxic_ones(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).write.parquet(str(tmp_path / "kept"))
    docs = spark.read.parquet(str(tmp_path / "kept"))
    labels = queries.domain_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    mixed = corpus_pipeline.mixing_to_targets(spark, docs, sf).select("doc_id").toPandas().doc_id
    assert mixed.is_unique
    mixed = set(mixed)
    for domain, least, most in (("clean", 0.99, 1.0), ("toxic", 0.0, 0.05)):
        ids = [r.doc_id for r in docs.join(labels.where(labels.domain == domain), "doc_id", "left_semi").select("doc_id").collect()]
        assert len(ids) > 100
        assert least <= sum(i in mixed for i in ids) / len(ids) <= most, domain


def test_readme_lists_the_queries_without_sql():
    readme = (Path(entry.__file__).parent / "README.md").read_text()
    line = next((x for x in readme.splitlines() if x.startswith("Queries without SQL:")), "")
    assert set(re.findall(r"`(\w+)`", line)) == set(entry.queries()) - set(entry.oracle_sql())


def rejected(text):
    """The default quality rules by brute force."""
    n, chars, symbols, dup, repeat = figures(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in text or "" if c.isalpha()]
    large = sum(not c.islower() for c in letters)
    return (
        n < 20 or 100 * repeat > 30 * n or 10 * symbols > n or chars < 3 * n or chars > 10 * n or 10 * dup > 3 * len(lines)
        or 10 * sum(any(c.isalpha() for c in w) for w in words) < 8 * n or 10 * large > 5 * len(letters) or 100 * len(set(words)) < 25 * min(n, 400)
    )


def pieces_of(rows, limit=4096):
    encode, want = tokens.Encoder(tokens.default_tokenizer()), collections.Counter()
    for key, text in rows:
        ids = np.append(encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), limit)):
            want[key, k, at, len(ids[at : at + limit]), zlib.crc32(ids[at : at + limit].tobytes())] += 1
    return want


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against plain Python over all of it."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = queries.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        if name == "quality_rules":
            want = collections.Counter(x for x in rows if not rejected(x[1]))
        elif name == "exact_dedup":
            best = {}
            for key, text in rows:
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key, text))
            want = collections.Counter((key, text) for _, key, text in map(min, best.values()))
        elif name == "near_dedup":
            kept = {key for key, n, c in near(rows, 5, 80) if c == key}
            want = collections.Counter(x for x in rows if x[0] in kept)
        elif name == "mixing":
            rates = mixing.mix(docs, labels, totals=corpus_pipeline.MIX_TOTALS).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id"))
            times = {r.doc_id: r.times for r in rates.select("doc_id", mixing.copies(F.col("rate"), F.struct("doc_id", "text"), corpus_pipeline.MIX_SLACK).alias("times")).collect()}
            want = collections.Counter({x: times[x[0]] for x in rows if times[x[0]]})
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "best_fit_packing":
            assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()) == pieces_of(rows)
        else:
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert collections.Counter(rows) == want, name


def test_mixing_meets_its_totals(spark, tmp_path):
    """Expected tokens of each domain after copies, against the fitted rates."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = queries.domain_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    rates = mixing.mix(docs, labels, totals=corpus_pipeline.MIX_TOTALS).toPandas().set_index("doc_id")
    left = corpus_pipeline.mixing_to_targets(spark, docs, sf).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].reindex(rates.index, fill_value=0)
    whole = rates.tokens.sum()
    for c in [c for c in rates.columns if c.startswith("p_")]:
        fitted, got = (rates.rate * rates.tokens * rates[c]).sum(), (left * rates.tokens * rates[c]).sum()
        assert abs(fitted - got) < 0.01 * whole, c


def odd_documents(spark, n=60):
    words = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions".split()
    rows = [(i, " ".join(words[(i * j) % len(words)] + str(j % 7 + i) for j in range(40)), "en", "s", 1, "x", "y", 9) for i in range(n)]
    rows += [(None, rows[0][1] + " and more words at the end", None, None, None, None, None, None), (n, None, None, None, None, None, None, None), (n + 1, "", "en", "s", 0, "x", "y", 9), (n + 2, " \t\n", "en", "s", 0, "x", "y", 9)]
    rows += [rows[3], rows[3], (n + 3, rows[4][1].upper(), "en", "s", 1, "x", "y", 9), (n + 4, " ".join(f"long{i % 900}" for i in range(30_000)), "en", "s", 1, "x", "y", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, rate string, _tokens int")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names; and the empty table."""
    step, docs = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    got = step(spark, docs, SF)
    rows = got.collect()
    assert step(spark, docs.limit(0), SF).count() == 0
    if name == "best_fit_packing":
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(list(texts.elements()))
        return
    assert got.columns == columns
    kept = collections.Counter((r.doc_id, r.text) for r in rows)
    if name == "quality_rules":
        assert kept == collections.Counter({x: m for x, m in texts.items() if not rejected(x[1])})
    elif name == "mixing":
        assert set(kept) <= set(texts) and all(kept[x] % texts[x] == 0 for x in kept)
    else:
        assert set(kept) <= set(texts) and set(kept.values()) == {1}
        assert sum(not (t or "").strip() for _, t in kept) == (1 if name == "exact_dedup" else 3)


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op7_sharding", "op8_token_counts"])
def test_queries_against_brute_force(spark, name):
    """The registered query itself, over the whole table."""
    got = queries.QUERIES[name](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    if name == "op1_best_fit_packing":
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_of(docs)
        ends = collections.defaultdict(list)
        for r in got:
            ends[r.sequence_id].append((r.offset, r.offset + r.length))
        assert all(sorted(x)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(x), sorted(x)[1:], strict=False)) and max(x)[1] <= 4096 for x in ends.values())
        assert len(ends) <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1
    elif name == "op7_sharding":
        assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for k, t in docs)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        sizes = collections.Counter(sum(n for (_, _, _, n, _), m in pieces_of([x], 1 << 40).items() for _ in range(m)) for x in docs)
        assert {r.length: r.n_docs for r in got} == dict(sizes)
        assert all(r.tokens_truncated == sum(min(n, r.length) * m for n, m in sizes.items()) for r in got)

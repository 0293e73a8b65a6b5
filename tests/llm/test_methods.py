"""Methods against brute force, and input beyond former limits."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from folia.llm import _store, decontaminate, html_extract, license_scan, near_dup, ngram_lm, token_counts, warc
from tests.llm.test_ops_small import brute_classes, brute_kn_of, edited, pages, prose


def test_long_sequences_equal_the_library():
    import sentencepiece

    path, r = P.path("piece_bpe_32k.model"), random.Random(3)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.table(path)
    long = ["a" * 5000, "ab" * 3000, "the" * 900, "".join(r.choice("etaoinshrdlu") for _ in range(4000)), "".join(r.choice("éß中a·") for _ in range(600)), "x" * 257, "aab" * 100 + "b" * 300]
    for x in [*long, " ".join(long)]:
        cut, feeds = token_counts.pre_tokens(t, x)
        assert feeds + int(t.counts([c.replace(" ", token_counts.SPACE) for c in cut]).sum()) == len(sp.encode(x)), x[:20]


def test_leaks_equal_all_windows(spark, frame):
    r = random.Random(8)
    items = [(i, prose(r.randint(6, 30), r)) for i in range(12)]
    docs = [(k, prose(r.randint(0, 60), r) + " " + edited(items[k % 12][1], 0.04 * (k % 3), r) + " " + prose(r.randint(0, 60), r)) for k in range(36)]
    index = decontaminate.Items([], 5, 0.8)
    bags = {i: decontaminate._weigh(*index.shingles(*index.of(t))) for i, t in items}
    want = set()
    for d, text in docs:
        h, s = index.of(text)
        for i, t in items:
            n = len(near_dup.plain_words(t))
            if any(decontaminate.weighted_similarity(bags[i], decontaminate._weigh(*index.shingles(h[k : k + n], s[k : k + n]))) >= 0.8 for k in range(max(1, len(h) - n + 1))):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(frame(docs), bench).collect()} == want and want


def test_captures_are_merged_from_several_runs(spark):
    r = random.Random(2)
    rows = [(i, f"http://h{r.randrange(5)}.org/{r.randrange(4)}", "x" * i) for i in range(60)]
    df = pages(spark, rows).selectExpr("*", "pmod(hash(page_id), 7) as at")
    runs = warc.write_archives(df.repartition(4), ts_col="at")
    got = [(x.url_key, x.ts, x.page_id) for x in warc.merge_index(runs, run_rows=10).collect()]
    assert sorted(got) == sorted((warc.url_key(u), x.at, i) for (i, u, _), x in zip(rows, df.orderBy("page_id").collect(), strict=True))
    listed = [(k, t, i, "f", 0, 1) for k, t, i in got]
    shuffled = [listed[k::3] for k in range(3)]
    assert [len(x) for x in warc.natural_runs([y for x in shuffled for y in sorted(x, key=warc._order)])] and len(warc.natural_runs([y for x in shuffled for y in sorted(x, key=warc._order)])) >= 2
    batches = [warc.batch(warc.INDEX, *zip(*sorted(x, key=warc._order), strict=True)) for x in shuffled * 4]
    for fan_in in (2, 256):
        merged = [y for x in warc._merged(iter(batches), 25, fan_in) for y in x]
        assert merged == sorted((y for x in shuffled * 4 for y in x), key=warc._order)


def test_near_families_below_the_threshold_equal_brute_force(spark, frame):
    """A crowd at similarity 0.6 to 0.8 shares buckets without being linked, past every level."""
    r = random.Random(21)
    base = prose(150, r)
    docs = [(k, edited(base, 0.02 + 0.004 * (k % 8), r)) for k in range(90)]
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(frame(docs), many=10).collect()}
    want = {}
    for (i, _), c in zip(docs, brute_classes(docs), strict=True):
        want.setdefault(c, []).append(i)
    assert got == {i: min(ids) for ids in want.values() for i in ids}


def test_helper_columns_never_clash(spark):
    names = "doc_id long, text string, near_row long, near_id string, near_fp int, near_bands string"
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x", 6, "y"), (2, "a b c d e f", 7, "z", 8, "w")], names)
    got = near_dup.one_of_each(df)
    assert got.columns == df.columns and [tuple(x) for x in got.collect()] == [(1, "a b c d e f", 5, "x", 6, "y")]
    assert _store.unused(["A", "_a"], "a") == ["__a"]


def test_language_model_dealt_in_rounds(spark, frame):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 25)))) for i in range(40)]
    model = ngram_lm.fit(frame(docs[:30]).repartition(3), order=3, fan=2)
    want = brute_kn_of(3, [t for _, t in docs[:30]], [t for _, t in docs])
    assert {x.doc_id: round(x.score, 6) for x in ngram_lm.score(frame(docs), model).collect()} == {i: round(x, 6) for (i, _), x in zip(docs, want, strict=True)}


def test_sorted_hashes_find_all_and_only_what_is_there(tmp_path):
    g = np.random.default_rng(1)
    for n in (1, 1000, 40_000):
        keys = np.unique(g.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        a, b = g.integers(0, 2000, len(keys)), g.integers(0, 3, len(keys))
        ngram_lm._save(f"file://{tmp_path}", f"k{n}", keys, a, b)
        have = ngram_lm.SortedHashes(f"{tmp_path}/k{n}")
        hit, values = have.look(np.concatenate([keys, keys + np.uint64(1)]))
        assert (hit == np.arange(len(keys))).all() and (values == np.stack([a, b], axis=1)).all()


def test_extraction_keeps_headlines_and_what_follows_open_elements(spark):
    t = prose(30)
    rows = [(1, "a", f"<article><div class='article-header'><h1>The headline</h1></div><p class='side-by-side'>{t}</p><div class='share-buttons'>x</div></article>"), (2, None, f"<article><p>Before</p><video src=x><p>{t}</p></article>")]
    rows += [(3, "b", "<p>" + "long " * 100_000), (4, "b", f"<article><p>{t}<p>unclosed")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert got[1] == f"The headline\n{t}" and got[2] == f"Before\n{t}"
    assert got[3] == " ".join(["long"] * 100_000) and got[4] == f"{t}\nunclosed"


def test_extraction_keeps_quotations_in_articles(spark):
    """A run on pages of many hosts is text; the same number of pages of one host make it boilerplate."""
    quote, notice = prose(12), prose(12)
    rows = [(i, f"http://h{i}.org/", f"<article><p>{prose(40)}</p><p>{quote}</p></article>") for i in range(4)]
    rows += [(10 + i, f"http://h0.org/{i}", f"<article><p>{prose(40)}</p><p>{notice}</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert all(quote in got[i] for i in range(4)) and not any(notice in got[10 + i] for i in range(4))


def test_repeats_equal_brute_force(spark):
    """Open text loses just the words of 8-token runs that two pages of a host share."""
    r = random.Random(17)
    words = [prose(1, r) for _ in range(3)]
    rows = [(i, f"http://h{i % 2}.org/", "<div>" + " ".join(r.choice(words) for _ in range(40)) + " own" + str(i) + "</div>") for i in range(40)]
    texts = {i: h[5:-6].split() for i, _, h in rows}
    where = {}
    for i, w in texts.items():
        for k in range(len(w) - 7):
            where.setdefault((i % 2, *w[k : k + 8]), set()).add(i)
    want = {}
    for i, w in texts.items():
        gone = {j for k in range(len(w) - 7) if len(where[(i % 2, *w[k : k + 8])]) > 1 for j in range(k, k + 8)}
        want[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    for chunk in (1_000_000, 100):
        got = {x.page_id: x.text for x in html_extract.extract_main_text(pages(spark, rows).repartition(3), chunk_tokens=chunk).collect()}
        assert got == want and any(want[i] != " ".join(texts[i]) for i in want)


def test_licenses_equal_brute_force(spark, frame):
    r = random.Random(4)
    names = ["mit", "isc", "agpl", "cc0-notice", "apache-2.0-notice"]
    docs = [(k, prose(40, r) + " " + edited(license_scan.TEMPLATES[names[k % 5]], 0.015 * (k % 3), r) + " " + prose(40, r)) for k in range(30)]
    import re

    shingles = lambda t: [tuple(w[i : i + 3]) for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for i in range(len(w) - 2)]
    want = set()
    for d, t in docs:
        h = shingles(t)
        for name, template in license_scan.TEMPLATES.items():
            s = set(shingles(template))
            n = len(shingles(template)) + license_scan.SIZES["long"] * license_scan.BLOCK
            if any(len(s & set(h[k : k + n])) / len(s) >= 0.8 for k in range(max(1, len(h) - n + 1))):
                want.add((d, name))
    got = {(x.doc_id, x.license) for x in license_scan.scan(frame(docs)).collect()}
    assert want <= got and len(got - want) <= 1


@pytest.mark.parametrize("name", ["op2_token_counts", "op6_warc", "op7_quality_rules", "op9_quality_classifier"])
def test_registered_queries_give_a_row_for_each(spark, name):
    from folia.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    table = spark.read.parquet(f"{sf}/{'pages' if name == 'op6_warc' else 'documents'}.parquet")
    assert got.count() == table.count()
    if name == "op6_warc":
        import duckdb

        db = duckdb.connect()
        db.sql(f"create view pages as select * from '{sf}/pages.parquet'")
        want = db.sql(queries.OP6_SQL)
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(x[c] for c in want.columns)) for x in got.collect())

"""Each operator on small fixtures: nulls, empty tables, ties, repeats, long texts, clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from folia.llm import decontaminate, html_extract, license_scan, line_crf, near_dup, ngram_lm, packing, quality_rules, token_counts, warc

ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "a b c d e f g " * 3000), (5, "ünï <s> <|endoftext|> ▁ x\n\ty  z")]
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_token_counts(spark, frame):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(frame(ODD), path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in ODD)
    assert token_counts.count_tokens(frame([]), path).count() == 0


def test_token_counts_of_awkward_strings():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.table(path)
    bits = [" ", "  ", "\n", "a", "the", "ing", "é", "中", "😀", "\t", "<s>", "<0x0A>", "▁", "12", "***", "st", "\x00", "ab" * 40, "a" * 300]
    for _ in range(300):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        cut, feeds = token_counts.pre_tokens(t, x)
        assert feeds + int(t.counts([c.replace(" ", token_counts.SPACE) for c in cut]).sum()) == len(sp.encode(x)), repr(x)


def test_packing_round_trip(spark, frame):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(frame(ODD).repartition(3), path, length=64).collect()
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or s == max(sequences)
    whole = Counter()
    for doc in {i for i, _ in ODD}:
        pieces = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc)
        whole[doc] = sum(n for _, n, _ in pieces)
    assert whole == Counter({doc: sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in ODD if i == doc) for doc in {i for i, _ in ODD}})
    assert packing.pack(frame([]), path).count() == 0


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, seen = Tokenizer.from_file(path), packing.ChunkIds(path)
    bits = [" ", "\n", "a", "B", "The", "'s", "don't", "é", "É", "ß", "İ", "中", "😀", "\t", "<|endoftext|>", "...", "***", "12", "́", "\xa0", "|", ",", "ﬁ"]
    for _ in range(300):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        cut = packing.chunks(x)
        seen.learn(set(cut))
        assert np.frombuffer(b"".join(seen[c] for c in cut), dtype="<u4").tolist() == tok.encode(x, add_special_tokens=False).ids, repr(x)


def brute_kn(train, docs):
    tok = lambda t: [w for w in (t or "").encode().lower().split()] + [b"\n"]
    texts = [tok(t) for t in train]
    c = Counter(w for t in texts for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in texts for p in zip([b"S", *t[:-1]], t, strict=True))
    off = lambda counts: ngram_lm._discounts([sum(x == k for x in counts) for k in (1, 2, 3, 4)])
    ends = Counter(w for _, w in pairs)
    d, e, types = off(pairs.values()), off(ends.values()), len(pairs)
    seen, gamma = Counter(), Counter()
    for (a, _), x in pairs.items():
        seen[a] += x
        gamma[a] += d[min(x, 3)]
    left = sum(e[min(x, 3)] for x in ends.values()) / types if types else 1.0

    def p(a, w):
        low = max(ends[w] - e[min(ends[w], 3)], 0) / max(types, 1) + left / (v + 1)
        return low if not seen[a] else max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) / seen[a] + gamma[a] / seen[a] * low

    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(p(a, w)) for a, w in zip([b"S", *t[:-1]], t, strict=True))) for t in map(tok, docs)]


def test_language_model(spark, frame):
    docs = ODD + [(100 + i, prose(60).upper() if i % 3 else prose(5)) for i in range(60)]
    df = frame(docs)
    model = ngram_lm.fit(df.where(~ngram_lm.held_out("doc_id")))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    want = brute_kn([t for i, t in docs if not held(i)], [t for _, t in docs])
    want = sorted((str(i), held(i), a, b, c, round(x, 6), round(y, 6)) for (i, _), (a, b, c, x, y) in zip(docs, want, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.score(df, model).collect())
    assert got == want
    empty = ngram_lm.fit(frame([]))
    assert ngram_lm.score(frame([(1, "a")]), empty).first().score == 0.0


def brute_kn_of(order, train, docs):
    """Probabilities by recursion over dictionaries of word tuples."""
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = [Counter() for _ in range(order + 1)]
    for t in map(tok, train):
        x = [b"S"] * (order - 1) + t
        counts[order].update(tuple(x[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    vocabulary = len({w for t in train for w in tok(t)})
    off = [None, *(ngram_lm._discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for c in counts[1:])]

    def p(g):
        k = len(g)
        after = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        total, taken = sum(after.values()), sum(off[k][min(c, 3)] for c in after.values())
        if k == 1:
            own = max(after.get(g, 0) - off[1][min(after.get(g, 0), 3)], 0) / max(total, 1)
            return own + (taken / total if total else 1.0) / (vocabulary + 1)
        return p(g[1:]) if not total else max(after.get(g, 0) - off[k][min(after.get(g, 0), 3)], 0) / total + taken / total * p(g[1:])

    return [sum(math.log10(p(tuple(([b"S"] * (order - 1) + t)[i : i + order]))) for i in range(len(t))) for t in map(tok, docs)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order(spark, frame, order):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abcdeF") for _ in range(r.randint(0, 25)))) for i in range(30)] + [(40, None), (41, "a b zzz a b c")]
    train, df = docs[:20], frame(docs)
    model = ngram_lm.fit(frame(train).repartition(3), order=order)
    want = dict(zip([i for i, _ in docs], brute_kn_of(order, [t for _, t in train], [t for _, t in docs]), strict=True))
    assert {x.doc_id: round(x.score, 6) for x in ngram_lm.score(df, model).collect()} == {i: round(x, 6) for i, x in want.items()}


def test_language_model_in_production_has_trigrams(spark, tmp_path, monkeypatch):
    from folia.llm import queries

    seen, fit = [], ngram_lm.fit
    monkeypatch.setattr(ngram_lm, "fit", lambda *a, **b: seen.append(b.get("order", 2)) or fit(*a, **b))
    spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op3_lm_scoring(spark, str(tmp_path)).count() == 5 and min(seen) >= 3


def test_license_scan(spark, frame):
    mit = license_scan.TEMPLATES["mit"].replace("\n", " ")
    docs = ODD + [(10, prose(50) + "\nReleased under the MIT license\n" + prose(50)), (11, prose(30) + " " + mit + " " + prose(30)), (12, mit.replace("software", "thing", 1)), (13, "licensed under the"), (14, prose(200))]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(frame(docs)).collect()}
    assert set(got) == {(10, "mit-notice"), (11, "mit"), (12, "mit")}
    assert got[10, "mit-notice"].first_word == 50
    assert got[11, "mit"].containment == 1.0 and 0.8 <= got[12, "mit"].containment < 1
    assert license_scan.scan(frame([])).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(frame([]), {"x": "too short"})


def test_license_behind_an_earlier_mention(spark, frame):
    filler = " ".join(f"filler{i}" for i in range(60))
    early = {"mit-notice": "under the MIT terms", "apache-2.0-notice": "licensed under the Apache rules", "gpl-3.0-notice": "the GNU General Public spirit"}
    docs = [(k, f"{prose(9)} {mention} {filler} {mention} {filler} {license_scan.TEMPLATES[name]} {filler}") for k, (name, mention) in enumerate(early.items())]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(frame(docs)).collect()}
    for k, (name, mention) in enumerate(early.items()):
        assert got[k, name].containment == 1.0
        assert got[k, name].first_word == 9 + 2 * (len(mention.split()) + 60)


def test_license_bands_use_all_shingles(spark):
    """A shingle with a negative hash wins no more bands than others."""
    rows = license_scan.template_bands(spark, {"mit-notice": license_scan.TEMPLATES["mit-notice"]}).collect()
    constants = spark.range(1).select(license_scan._constants().alias("c")).first().c
    assert len({r.value ^ constants[r.band] for r in rows}) > 1


def test_license_scan_plan_has_no_python(spark, frame):
    plan = license_scan.scan(frame(ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


PAGES = [(1, "http://a.org/x", "<p>" + "y" * 200), (2, "http://a.org/x", "<p>" + "y" * 200), (3, None, None), (4, "http://b.org/", ""), (5, "http://a.org/x#f", "é" * 80), (6, "http://a.org/é y", "é" * 80), (7, "u", "short"), (8, "u", "short"), (None, "u", "<p>" + "y" * 200)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    df = pages(spark, PAGES)
    index = warc.merge_index(warc.write_archives(df.repartition(3)), run_rows=2)
    got = {(r.page_id, r.payload_bytes): r for r in warc.read_archives(index).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        r = got[i, len(data)]
        first = min((j for j, _, h in PAGES if h == html and j is not None), default=None) if len(data) >= 100 else None
        assert (r.record_type, r.refers_to) == (("response", None) if first is None or first == i else ("revisit", first))
        assert r.record_type == "revisit" or r.payload == data
    keys = [(r.url_key, r.ts, r.page_id if r.page_id is not None else -1) for r in index.collect()]
    assert len(keys) == len(PAGES)
    assert warc.read_archives(warc.merge_index(warc.write_archives(pages(spark, [])))).count() == 0


def test_loser_tree():
    for k in range(1, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        got = [x[0] for x in warc.LoserTree([iter([(x,) for x in r]) for r in runs], lambda x: x[0])]
        assert got == sorted(x for r in runs for x in r)
    assert warc.url_key("http://User@B.a.org:80/p/q?x=1#f") == "org,a,b)/p/q?x=1"


def test_extraction(spark):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>Cookies</div><article><h1>T &amp; U</h1><p><b>One<br><p>Two&nbsp; x</p><aside>no</aside><form>no</form></article><div id=comments><p>me too</p></div><footer>&copy;</footer></body></html>"
    boiler = "Read more about our wonderful offers on this very site today and tomorrow"
    open_pages = [(10 + i, "http://h.org/%d" % i, f"<body><div>{boiler}</div><p>{prose(30)}</p></body>") for i in range(3)]
    rows = [(1, "http://h.org/", page), (2, None, None), (3, "http://h.org/", ""), (4, "x", "<nav>only</nav>"), *open_pages]
    got = {r.page_id: r for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert got[1].text == "T & U\nOne\nTwo x" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[4].text == ""
    for i, _, h in open_pages:
        assert got[i].text == h.partition("<p>")[2].partition("</p>")[0]
    assert html_extract.extract_main_text(pages(spark, [])).count() == 0


def test_extraction_keeps_text_in_wrappers(spark):
    t, menu = prose(40), "our menu of pages that every page of the host has in it"
    rows = [(1, "a", f"<div id=page class='has-sidebar'><article><p>{t}</p></article></div>"), (2, "b", f"<form id=aspnetForm><div>{t}</div></form>"), (3, "c", f"<form><main><p>{t}</p><form>search</form></main></form>")]
    rows += [(4, "d", f"<div class='header-fixed'><p>{t}</p><nav>x</nav></div>"), (5, "e", f"<article><p>{t}</p><div class=comments><p>{prose(80)}</p></div></article><div class=ad>buy</div>"), (6, "f", f"<p><a href=/>{t}</a></p>")]
    rows += [(7 + i, "g", f"<div>{menu} own{i}</div>") for i in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows)).collect()}
    assert all(got[i] == t for i in range(1, 7))
    assert got[7] == "own0" and got[8] == "own1"


def test_extraction_decides_by_repetition_in_and_beside_articles(spark):
    share = "Please share this story with all your friends on every network you use"
    own = [prose(40) for _ in range(4)]
    copy = prose(50)
    rows = [(i, "http://h.org/%d" % i, f"<body><article><p>{t}</p><p>{share}</p></article><div>{t.split()[0]} beside it</div></body>") for i, t in enumerate(own)]
    rows += [(10 + i, "http://h.org/c%d" % i, f"<body><article><p>{copy}</p></article></body>") for i in range(2)]
    rows += [(20, "http://other.org/", f"<article>{share}</article>")]
    for chunk in (400_000, 60):  # repeated in a chunk and across chunks
        got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(spark, rows).repartition(2), chunk_tokens=chunk).collect()}
        assert all(got[i] == f"{t}\n{t.split()[0]} beside it" for i, t in enumerate(own))
        assert got[10] == got[11] == copy and got[20] == share


def test_prefix_groups_equal_brute_force():
    for _ in range(50):
        sizes = [rng.randrange(0, 12) for _ in range(4)]
        page = np.repeat(np.arange(4), sizes)
        tokens = np.array([rng.randrange(3) for _ in page], dtype=np.uint64)
        g = html_extract.same_prefix_groups(tokens, page, 5)
        for i in range(len(tokens)):
            own = tuple(tokens[i : i + 5])
            whole = i + 5 <= len(tokens) and page[i] == page[i + 4]
            assert (g[i] >= 0) == whole
            if whole:
                same = {j for j in range(len(tokens) - 4) if g[j] == g[i]}
                assert same == {j for j in range(len(tokens) - 4) if page[j] == page[j + 4] and tuple(tokens[j : j + 5]) == own}


def test_word_statistics():
    def slow(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        hit = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    for t in ["", "a", "a a a a", "x y z\nx y z\n\nx y z", "é# *$ %&|<>\x85\xa0b", *(" ".join(rng.choice("abc") for _ in range(30)) for _ in range(50))]:
        assert quality_rules.text_stats(t)[:5] == slow(t), t


def labelled(spark, n=240):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, "\n".join(" ".join(w + ("###" if bad else "") for w in prose(15).split()) for _ in range(6))))
        labels.append((i, 0 if bad else 1, 0))
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark, frame):
    docs, labels = labelled(spark)
    df = frame(docs + ODD)
    rules = quality_rules.fit(df, labels)
    assert rules
    got = {r.doc_id: r for r in quality_rules.judge(df, rules).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i, _ in docs if i > 5)
    assert not got[1].kept and got[1].base_failed and got[2].n_words == 0
    kept = quality_rules.kept_rows(df, rules)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id > 5} == {i for i, _ in docs if i > 5 and i % 4}
    assert quality_rules.fit(df, labels.where("false")) == []
    assert quality_rules.judge(frame([]), rules).count() == 0


def test_line_crf(spark, frame):
    docs, labels = labelled(spark)
    df = frame(docs + ODD)
    model = line_crf.fit(df, labels)
    got = line_crf.classify(df, model).collect()
    assert len(got) == len(docs) + len(ODD)
    held = [r for r in got if r.doc_id is not None and r.doc_id > 5 and r.held_out]
    assert held and all(r.predicted == (r.doc_id % 4 != 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    assert line_crf.kept_rows(df, model).columns == df.columns
    assert line_crf.fit(df, labels.where("false")) is None
    assert {r.score for r in line_crf.classify(df, None).collect()} == {0.5}


def test_forward_backward_equals_enumeration():
    import itertools

    g = np.random.default_rng(3)
    for n in (1, 2, 5):
        u, t = g.normal(size=n), g.normal(size=(2, 2))
        p, pairs = line_crf.forward_backward(u, np.array([n]), t)
        w = {y: math.exp(sum((1 if k else -1) * u[i] / 2 for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(w.values())
        assert np.allclose(p, [sum(x for y, x in w.items() if y[i]) / z for i in range(n)])
        want = np.zeros((2, 2))
        for y, x in w.items():
            for a, b in zip(y, y[1:], strict=False):
                want[a, b] += x / z
        assert np.allclose(pairs, want)


def test_decontamination(spark, frame):
    items = [(i, prose(rng.randint(15, 50))) for i in range(20)] + [(90, None), (91, ""), (92, "tiny item")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    one = items[3][1].split()
    one[7] = "edited"
    docs = ODD + [(10, prose(80) + " " + items[0][1].upper() + ". " + prose(80)), (11, prose(300)), (12, " ".join(one)), (13, "so tiny, item!"), (14, " ".join(items[5][1].split()[:8]))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(docs), bench).collect()}
    assert (10, 0) in got and got[10, 0].similarity == 1.0 and got[10, 0].start == 80
    index = decontaminate.Items(items, 5, 0.0)
    h, s = index.of(" ".join(one))
    exact = decontaminate.weighted_similarity(decontaminate._weigh(*index.shingles(*index.of(items[3][1]))), decontaminate._weigh(*index.shingles(h, s)))
    assert ((12, 3) in got) == (exact >= 0.8)
    assert {d for d, _ in got} - {12} == {10, 13}
    kept = decontaminate.clean_rows(frame(docs), bench)
    assert kept.columns == frame([]).columns and kept.count() == len(docs) - len({d for d, _ in got})
    assert decontaminate.find_leaks(frame(docs), bench.where("false")).count() == 0


def _print_of(index, text):
    g, w = index.shingles(*index.of(text))
    return decontaminate.simhashes(g, w, np.array([0]), np.array([len(g)])), decontaminate._weigh(g, w)


def test_decontamination_finds_items_with_a_long_word_changed():
    r, found = random.Random(9), 0
    for _ in range(60):
        words = ["".join(r.choice("abcdefgh") for _ in range(32)), *prose(49, r).split()]
        index = decontaminate.Items([(1, " ".join(words))], 5, 0.8)
        words[0] = "".join(r.choice("ijklmnop") for _ in range(32))
        if decontaminate.weighted_similarity(index.groups[50][2][0], _print_of(index, " ".join(words))[1]) >= 0.8:
            found += 1
            assert index.search(" ".join(words))
    assert found


def test_prints_follow_similarity(spark):
    """Variants of items at a similarity of 0.8 or more are within the radius, unrelated windows aren't."""
    r = random.Random(3)
    items = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect() if x.text]
    vocabulary = sorted({w for t in items for w in near_dup.plain_words(t)})
    near = lost = 0
    for t in items:
        words, index = near_dup.plain_words(t), decontaminate.Items([(1, t)], 5, 0.8)
        own, bag = _print_of(index, t)
        for _ in range(100):
            x = list(words)
            for _ in range(r.randint(1, 3)):
                k = r.choice([0, len(x) - 1, r.randrange(len(x))])
                x[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [x[k], r.choice(vocabulary)]])
            if len(x) >= 5:
                other, bag_ = _print_of(index, " ".join(x))
                if 0.8 <= decontaminate.weighted_similarity(bag, bag_) < 1:
                    near += 1
                    lost += int(decontaminate.distances(own, other)[0]) > decontaminate.RADIUS
    assert near > 300 and lost <= 0.002 * near
    unrelated = np.concatenate([_print_of(index, prose(r.randint(20, 60), r))[0] for _ in range(400)])
    d = decontaminate.distances(unrelated[:200, None], unrelated[None, 200:])
    assert (d <= decontaminate.RADIUS).mean() < 0.001


def test_prints_of_pieces_equal_prints_of_the_whole(monkeypatch):
    g = np.random.default_rng(6)
    h, w = g.integers(0, 2**63, 500).astype(np.uint64), g.integers(1, 60, 500)
    starts = np.arange(0, 400, 7)
    want = np.concatenate([decontaminate.simhashes(h[k : k + 60], w[k : k + 60], np.array([0]), np.array([60])) for k in starts])
    monkeypatch.setattr(decontaminate, "SIGNED", 11)
    assert (decontaminate.simhashes(h, w, starts, starts + 60) == want).all()


def test_long_text_with_items_at_both_ends():
    import subprocess
    import sys

    code = """
import resource
from folia.llm import decontaminate
item = " ".join(f"item{i}" for i in range(40))
long = " ".join([item, *(f"w{i % 5003}" for i in range(3_500_000)), item])
index = decontaminate.Items([(1, item)], 5, 0.8)
assert len(long) > 19_000_000 and index.search(long) == [(1, 1.0, 0, 40)]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500, out.stdout


def test_multi_index_misses_nothing(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 1000)
    g = np.random.default_rng(5)
    items = g.integers(0, 2**63, (200, decontaminate.BITS // 64)).astype(np.uint64)

    def flipped(k):
        bits = np.unpackbits(items.view(np.uint8), axis=1, bitorder="little")
        for row in bits:
            row[g.choice(decontaminate.BITS, k, replace=False)] ^= 1
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    asked = np.concatenate([flipped(k) for k in (0, 1, 24, 47, 48, 70)])
    a, b = decontaminate.MultiIndex(items).near(asked)
    d = decontaminate.distances(asked[:, None], items[None])
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= decontaminate.RADIUS)), strict=True))
    assert len(a) == 800


def edited(text, share, r):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def brute_classes(docs):
    words = lambda t: near_dup.plain_words(t or "")

    def bag(t):
        w = words(t)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    bags, up = [bag(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            total = sum((bags[i] | bags[j]).values())
            if (docs[i][1] or "") == (docs[j][1] or "") or total and both / total >= 0.8:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(docs))]


@pytest.mark.parametrize("many", [near_dup.MANY, 3])
def test_near_duplicates_equal_brute_force(spark, frame, many):
    r = random.Random(11)
    docs = [(1, None), (2, ""), (3, "one"), (4, "One!"), (5, "a b c d e f g " * 300)]
    for g in range(6):
        base = prose(120, r)
        docs += [(100 * g + 20 + k, edited(base, 0.012 * (k % 5), r)) for k in range(24)]
    docs += [(1000 + k, docs[40][1]) for k in range(5)] + [(2000 + k, prose(60, r)) for k in range(20)]
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(frame(docs), many=many).collect()}
    want = {}
    for (i, _), c in zip(docs, brute_classes(docs), strict=True):
        want.setdefault(c, []).append(i)
    assert got == {i: min(ids) for ids in want.values() for i in ids}


def test_one_of_each(spark, frame):
    docs = [(7, "same text here and there again"), (7, "same text here and there again"), (8, "same text here and there again"), (9, "other words in this one here"), (None, "x y"), (None, "x y"), (10, None), (11, "")]
    df = frame(docs)
    got = near_dup.one_of_each(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([docs[0], docs[3], docs[4], docs[6]])
    assert near_dup.one_of_each(frame([])).count() == 0


def test_dart_signature_is_consistent():
    g = np.random.default_rng(2)
    e, w = g.integers(1, 2**62, 400).astype(np.uint64), g.integers(1, 4, 400).astype(float)
    e2 = e.copy()
    e2[:60] = g.integers(1, 2**62, 60).astype(np.uint64)
    order, order2 = np.argsort(e), np.argsort(e2)
    want = near_dup.similarity((e[order], w[order]), (e2[order2], w[order2]))
    same = np.mean([(near_dup.dart_signature(e, w, 256, s) == near_dup.dart_signature(e2, w, 256, s)).mean() for s in range(12)])
    assert abs(same - want) < 0.04
    assert (near_dup.dart_signature(e, w, 64) == near_dup.dart_signature(e[::-1].copy(), w[::-1].copy(), 64)).all()

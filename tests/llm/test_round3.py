"""The filter audit, k-d sharding and periodic runs against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folia.llm import filter_audit, kd_shards, periodic_runs
from folia.llm import queries as Q

SF = "/root/testdata/sf0.001"
W = re.compile("[^\x20\x09-\x0d]+")
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = W.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = of
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, k] = [len(left), len(gone), sum(f in d[1] for d in of) - len(gone), sum(d[1] == {f} for d in of), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_equals_brute_force(spark):
    same = prose(250)
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (4, same, "en"), (5, same, "de"), (5, same, "de"), (4, same, "en"), (None, same, "de"), (None, "x | y", None), (6, "A B C " * 100, "en"), (7, "é ü A", "fr"), (8, prose(300) + " 100% & more", "en"), (9, prose(199), "en"), (10, prose(200), "en"), (11, "w " * 700_000, "en")]
    rows += [(100 + k, rng.choice([prose(rng.randint(150, 260)), same, "AB " + prose(60), "a b " * 80 + "#"]), rng.choice(["en", "de", "xx", None])) for k in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(1, 9), *range(100, 200), 4, None]]
    docs = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, part string, failed int, good int, digest int").repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_filter_audit_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    names = ["part", "filter_order", "step", *COLUMNS]
    got = sorted(tuple(r[c] for c in names) for r in Q.op11_filter_audit(spark, SF).collect())
    assert got == sorted(db.sql(f"select {', '.join(names)} from ({Q.OP11_SQL})").fetchall())


def test_words_of_long_texts(monkeypatch):
    text = ("é x  b\x0bc\x1cd " * 50 + prose(300)).encode()
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "PIECE", 10)
    w = W.findall(text.decode())
    assert filter_audit.word_counts(text) == whole == (len(w), len(set(w)))


def brute_runs(s):
    """Every maximal stretch with a smallest period that fits twice, by comparing all distances."""
    n, out = len(s), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i >= p:
                part = s[i : j + p]
                if all(any(x != y for x, y in zip(part, part[q:])) for q in range(1, p)):
                    out.add((i, j - i + p, p))
            i = max(j, i + 1)
    return out


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        n, k = r.randint(0, 40), r.randint(1, 4)
        s = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.4:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 6)
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
        got = list(zip(*(x.tolist() for x in periodic_runs.runs(np.array(s, dtype=np.int64))), strict=True))
        assert len(got) == len(set(got)) and set(got) == brute_runs(s), s


def test_each_step_of_the_method():
    """Blocks are the longest earlier parts, every kind of square gets a mark, and links drop one symbol."""
    r = random.Random(8)
    for _ in range(300):
        s = np.append(np.array([r.randrange(3) for _ in range(r.randint(2, 24))], dtype=np.int64), 9)
        text, n = s.tolist(), len(s)
        ahead, back = periodic_runs.Extensions(s), periodic_runs.Extensions(s[::-1].copy())
        tree = periodic_runs.SuffixTree(s, ahead)
        before = periodic_runs.longest_before(tree, n)
        assert before.tolist() == [max([next(k for k in range(n) if i + k == n or text[j + k] != text[i + k]) for j in range(i)], default=0) for i in range(n)]
        start, half = periodic_runs.leftmost_cover(s, ahead, back, periodic_runs.blocks(before))
        assert all(text[i : i + k] == text[i + k : i + 2 * k] for i, k in zip(start.tolist(), half.tolist(), strict=True))
        kinds = periodic_runs.vocabulary(s, tree, start, half, before)
        squares = {tuple(text[i : i + 2 * k]) for k in range(1, n) for i in range(n - 2 * k + 1) if text[i : i + k] == text[i + k : i + 2 * k]}
        marked = [tuple(text[tree.least[v] : tree.least[v] + 2 * k]) for v, k in kinds]
        assert len(marked) == len(set(marked)) and set(marked) == squares


def brute_periodic(i, t):
    words = W.findall(t or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    got = sorted(((s, m, q) for s, m, q in brute_runs(words) if m >= max(6, 4 * q)), key=lambda x: (x[0], x[2]))
    drop = {k for s, m, q in got for k in range(s + q, s + m)}
    best = max(got, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if got else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in got)
    return (i, len(got), *best, 1000 * best[1] // best[2] if got else None, sha(lines), sha(kept)), (lines, kept)


PERIODIC = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_equal_brute_force(spark, monkeypatch):
    r = random.Random(11)
    bits = [lambda: "a " * r.randint(1, 9), lambda: (prose(r.randint(1, 4), r) + "\t\n") * r.randint(1, 7), lambda: prose(r.randint(1, 30), r) + " ", lambda: "é\x0bü " * r.randint(2, 6)]
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, "w"), (4, " \n"), (5, "a b " * 4), (5, "a b " * 4), (6, "a " * 5), (7, "a " * 6 + "b " * 6), (8, "a a a a b " * 5), (9, "x y x y x y x y z " * 4)]
    rows += [(100 + k, "".join(r.choice(bits)() for _ in range(r.randint(1, 8)))) for k in range(150)]
    docs = spark.createDataFrame([(*x, "en", 1, "y") for x in rows], "doc_id long, text string, lang string, period int, runs string").repartition(3)
    want = Counter(brute_periodic(*x)[0] for x in rows)
    got = periodic_runs.find_runs(docs, plant=True).collect()
    assert Counter(tuple(x[c] for c in PERIODIC) for x in got) == want
    texts = {brute_periodic(*x)[0]: brute_periodic(*x)[1] for x in rows}
    assert all((x.runs, x.collapsed) == texts[tuple(x[c] for c in PERIODIC)] for x in got)
    assert periodic_runs.find_runs(docs.limit(0), plant=True).count() == 0


def test_periodic_runs_of_the_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()]
    want = Counter(brute_periodic(*x)[0] for x in rows)
    docs = {x[0] for x in rows}
    assert Counter(tuple(x) for x in Q.op13_periodic_runs(spark, SF).collect() if x.doc_id in docs) == want


def test_a_very_long_periodic_text(spark):
    unit = [f"w{k}" for k in range(20_000)]
    docs = spark.createDataFrame([(2, " ".join(unit * 9 + ["end"] * 7))], "doc_id long, text string")
    got = periodic_runs.find_runs(docs).first()
    assert got.runs == "0,180000,20000\n180000,7,1\n" and got.exponent_milli == 9000 and got.collapsed == " ".join([*unit, "end"])


def brute_tree(pts, shards):
    """Shard of each point (coordinates, tie, size) by sorting every node whole."""
    out = {}

    def cut(mine, k, first):
        if k == 1 or not mine:
            out.update(dict.fromkeys(mine, first))
            return
        dims = range(len(pts[0][0]))
        span = [max(pts[i][0][d] for i in mine) - min(pts[i][0][d] for i in mine) for d in dims]
        d = span.index(max(span))
        key = lambda i: (pts[i][0][d], pts[i][1])
        need = sum(pts[i][2] for i in mine) * (k // 2) / k
        sums, at = {}, 0
        for i in mine:
            sums[key(i)] = sums.get(key(i), 0) + pts[i][2]
        for x in sorted(sums):
            if at + sums[x] >= need:
                last = (x, True) if at + sums[x] - need <= need - at else (x, False)
                break
            at += sums[x]
        left = [i for i in mine if key(i) < last[0] or key(i) == last[0] and last[1]]
        cut(left, k // 2, first)
        cut(sorted(set(mine) - set(left)), k - k // 2, first + k // 2)

    cut(list(range(len(pts))), shards, 0)
    return out


def test_tree_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(k % 90 if r.random() < 0.9 else None, prose(r.randint(0, 40)) if r.random() < 0.7 else "the same", r.choice(["en", "en", "de", None]), r.choice(["https://x/a", "https://x/b", "https://y", None])) for k in range(400)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, source string, size int").repartition(4)
    raw = kd_shards.staged(kd_shards.measured(docs, "doc_id", "text", kd_shards.DIMENSIONS), "t-raw")
    got = kd_shards.staged(kd_shards.points(raw, kd_shards.scales(raw, 4)), "t-points")
    pts = [((x.c0, x.c1, x.c2, x.c3), x.tie, x["size"]) for x in got.collect()]
    for shards in (1, 2, 7, 40):
        tree = kd_shards.fit(got, 4, shards, 0)
        want = brute_tree(pts, shards)
        at = tree.route(np.array([p[0] for p in pts]).T, np.array([p[1] for p in pts]))
        assert [tree.shards()[v] for v in at] == [want[i] for i in range(len(pts))]


def test_scaled_values_keep_their_order():
    for values in (["", "a", "ab", "abcdefghi", "abcdefghij", "b", "é"], ["https://x/a", "https://x/b", "https://x/bb"], [-5.0, 0.0, 1e-9, 3.0, 1e18], ["same"], [2.0]):
        scale = kd_shards.Scale.of(min(values), max(values))
        got = scale.numbers(pa.array([None, *values])).tolist()
        assert got == sorted(got) and got[0] == 0 < got[1] and got[-1] < 1 << 32


def checked_shards(rows, shards, slack):
    """Every row once, slots without gaps, and bytes of the shards within ``slack`` of their mean."""
    size, slots = Counter(), {}
    for x in rows:
        size[x.shard] += x["size"]
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert all(abs(size[k] - mean) <= slack for k in range(shards)), size
    return size


def test_shards(spark):
    r = random.Random(4)
    hot = prose(30)
    rows = [(None, None), (1, ""), (1, ""), (2, "é"), *[(7, hot)] * 900, *[(10 + k, hot) for k in range(600)], *[(5000 + k, prose(r.randint(1, 60))) for k in range(1500)], (9, "long " * 1000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 3, 0, 0) for i, t in rows], "doc_id long, text string, lang string, source string, shard int, slot int, id int").repartition(6)
    got = kd_shards.shard(docs, shards=16).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total = sum(x["size"] for x in got)
    checked_shards(got, 16, 6000)
    by_size = kd_shards.shard(docs, target_bytes=total // 5 + 1).collect()
    assert len(checked_shards(by_size, 5, 6000)) == 5
    one = kd_shards.shard(docs.limit(1), shards=40).collect()
    assert len(one) == 1 and one[0].slot == 0
    assert kd_shards.shard(docs.limit(0), shards=40).count() == 0
    assert kd_shards.shard(docs.limit(0), target_bytes=10).count() == 0


def test_sharding_of_the_table(spark):
    got = Q.op12_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in docs)
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    checked_shards(got, 40, max(x["size"] for x in got))


def _crf():
    from folia.llm import line_crf

    rng = np.random.default_rng(1)
    texts = ["\n".join(" ".join(rng.choice(list("abcdefgh!#"), rng.integers(1, 9))) for _ in range(rng.integers(0, 40))) for _ in range(200)]
    raw, sizes = line_crf.line_features([*texts, None, "", " \n "])
    return line_crf.train(raw, sizes, rng.integers(0, 2, len(sizes))), raw, sizes, texts


def test_line_scores_equal_brute_force():
    """Potentials from the design row by row, marginals by summing over all labellings."""
    from itertools import product

    model, raw, sizes, _ = _crf()
    u = model.design(raw, sizes) @ model.weights
    ends = np.cumsum(sizes)
    quality = model.quality(raw, sizes)
    seen = 0
    for k in np.flatnonzero((sizes > 0) & (sizes < 9)):
        own, want = u[ends[k] - sizes[k] : ends[k]], np.zeros(sizes[k])
        total = 0.0
        for y in product((0, 1), repeat=int(sizes[k])):
            weight = np.exp(sum(own[i] * (y[i] - 0.5) for i in range(len(y))) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            want += weight * np.array(y)
        w = np.expm1(raw[ends[k] - sizes[k] : ends[k], 0].astype(float))
        assert abs(quality[k] - (w * want / total).sum() / w.sum()) < 1e-5
        seen += 1
    assert seen > 20


def test_long_texts_score_as_short_ones(monkeypatch):
    from folia.llm import line_crf

    model, _, _, texts = _crf()
    every = [*texts[:40], "\n".join(texts), None, ""]
    want = model.scores(every)
    monkeypatch.setattr(line_crf, "LONG_TEXT", 100)
    monkeypatch.setattr(line_crf, "LONG_CHAIN", 5)
    monkeypatch.setattr(line_crf, "BLOCK_LINES", 7)
    assert np.abs(model.scores(every) - want).max() < 1e-6


@pytest.mark.parametrize("name", ["notice", "alert alert-info", "site-notice", "article-comments", "user-comments", "fb-comments", "google-ad", "ad-slot-3", "newsletter-signup-v2", "hidden", "commentList"])
def test_names_inside_articles_that_say_no_text(spark, name):
    from folia.llm import html_extract

    html = f'<body><nav>menu</nav><article class="post"><h1>Title</h1><p>one two</p><div class="{name}"><p>inner words</p></div><div id="{name}">more</div><p>four</p></article></body>'
    got = html_extract.extract_main_text(spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string")).first()
    assert got.text == "Title\none two\nfour"


@pytest.mark.parametrize("name", ["article-body", "article-header", "side-note", "noticeable-facts", "lead", "post-content", "comment-on-law", "image-caption", "alert-levels-of-volcanoes"])
def test_names_inside_articles_that_hold_text(name):
    from folia.llm import html_extract

    html = f'<article><h1>Title</h1><div class="{name}"><p>inner words</p></div></article>'
    assert [t for k, t in html_extract.blocks(html) if k == html_extract.MAIN] == ["Title", "inner words"]


def test_one_row_of_each_class_is_kept(spark):
    from folia.llm import near_dup

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    text = " ".join(words)
    docs = [(1, text), (1, text), (1, near), (2, text), (3, near), (None, "some other text that has no id at all"), (None, "some other text that has no id at all"), (4, None), (4, ""), (5, "alone here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted((d or 0, {2: 1, 3: 1}.get(d, d) or 0) for d, _ in docs)
    assert Counter(r.doc_id for r in got if r.is_kept) == {1: 1, None: 1, 4: 1, 5: 1}
    assert sorted(x.doc_id or 0 for x in near_dup.one_of_each(df).collect()) == [0, 1, 4, 5]
    assert near_dup.near_duplicates(df.where("false")).count() == 0


def test_near_copies_are_never_broadcast(spark, frame, monkeypatch):
    """Staged tables look small to Spark: at 0.5 GB the exploded bands of all texts went through the driver's memory."""
    from folia.llm import components, near_dup

    plans = []

    def noted(step):
        def run(df, *more):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return step(df, *more)

        return run

    for module, name in ((near_dup, "staged"), (near_dup, "by_chunk"), (components, "staged")):
        monkeypatch.setattr(module, name, noted(getattr(module, name)))
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[: 40 + i % 3], *(f"x{i}y{k}" for k in range(i % 20))])) for i in range(80)]
    got = near_dup.near_duplicates(frame(docs))
    plans.append(got._jdf.queryExecution().sparkPlan().toString())
    assert got.count() == 80 and near_dup.one_of_each(frame(docs)).count() == got.where("is_kept").count()
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]

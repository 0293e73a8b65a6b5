"""Near-duplicate classes by DartMinHash signatures, banding and exact checks.

A text is the weighted set of its runs of five words (weight: how often the run
occurs).  DartMinHash throws hashed darts at each element's weight region; the
darts arrive in rank order as a Poisson process, each dart names one coordinate,
and the earliest dart of each coordinate is the signature, so two texts agree in
a coordinate with the probability of their weighted Jaccard similarity.

Rows are staged once with a number and their signature; whatever needs their
texts or keeps some of them finds them by that number in one more pass, so no
join ever shuffles whole rows.  Exact copies are folded first, and of buckets of
banded signatures with the same texts one stands for all.  Within a bucket every
text is compared with the bucket's leader only, never all with all.  Where that
leaves a bucket in several components, the texts outside its largest one are
compared with the rest in blocks of bounded size, which give links and no pairs.
Where they are very many, the bucket's texts are signed again with fresh, more
selective bands; what is still mixed after the last level is compared in blocks,
however much it is.  So the links that matter for the classes are found at every
size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._store import by_chunk, dropped, marked, row_numbers, shuffle_joined, staged, unused
from folia.llm._text import WordHashes, batch, mapped, mix, plain_words, shingle_hashes
from folia.llm.components import components

#: Where more texts than this stand outside a bucket's largest component, they are signed again.
MANY = 4096
#: Such texts and all texts of the bucket that one block compares.
MINOR_BLOCK, OTHER_BLOCK = 64, 1024
#: (bands, rows) by level: a pair at similarity 0.8 shares a bucket with probability over 0.999 at each.
LEVELS = ((24, 6), (64, 10), (160, 14), (380, 18), (900, 22))

_STEP = np.uint64(0xD1342543DE82EF95)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for a weighted set.

    ``elements`` are distinct 64-bit hashes, ``weights`` positive numbers.  The
    region of an element is cut into unit cells; darts fall on a cell at ranks
    with exponential gaps, all drawn from hashes of (seed, element, cell), and a
    dart in a partial last cell counts only if it lies under the weight.
    """
    cells = np.ceil(weights).astype(np.int64)
    who = np.repeat(np.arange(len(elements)), cells)
    place = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
    base = mix(elements[who] ^ mix(place.astype(np.uint64) + np.uint64(seed * int(_STEP) % (1 << 64))))
    share = np.minimum(weights[who] - place, 1.0)
    bound = k * (np.log(k) + 2.0) / max(float(weights.sum()), 1e-9)
    while True:
        # the first darts of all cells at once, then more of the cells that go on
        ahead = int(bound + 2 * np.sqrt(bound)) + 1
        live, rank, number, found = np.arange(len(base)), np.zeros(len(base)), 0, []
        while len(live):
            j = np.arange(number + 1, number + ahead + 1, dtype=np.uint64)[:, None]
            dart = mix(base[live] + j * _STEP)
            ranks = rank + np.cumsum(-np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=0)
            at = np.flatnonzero(ranks.ravel() < bound)
            found.append((ranks.ravel()[at], dart.ravel()[at], live[at % len(live)]))
            go = ranks[-1] < bound
            live, rank, number, ahead = live[go], ranks[-1][go], number + ahead, max(1, ahead // 2)
        r, d, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        more = mix(d)
        under = (more >> np.uint64(40)).astype(np.float64) * 2.0**-24 < share[cell]
        r, d, more = r[under], d[under], more[under]
        c = ((more & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-r, kind="stable")  # the earliest is written last and stays
        out, filled = np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=bool)
        out[c[order]] = d[order]
        filled[c] = True
        if filled.all():
            return out
        bound *= 2


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature.reshape(bands, rows)
    h = mix(np.arange(bands, dtype=np.uint64))
    for c in range(rows):
        h = mix(h ^ s[:, c])
    return h.view(np.int64)


def weighted_set(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(words, n), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two weighted sets with sorted elements."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][ia], b[1][ib]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _bands_of(level: int, n: int):
    bands, rows = LEVELS[min(level, len(LEVELS) - 1)]

    def sign(words: WordHashes, text: str) -> np.ndarray:
        e, w = weighted_set(words.of(plain_words(text)), n)
        return band_hashes(dart_signature(e, w.astype(np.float64), bands * rows, level), bands, rows) if len(e) else np.zeros(0, dtype=np.int64)

    return sign


def _signed(texts: DataFrame, level: int, n: int) -> DataFrame:
    """bucket, uid of the texts (uid, text)."""
    out = pa.schema([("bucket", pa.int64()), ("uid", pa.int64())])

    def run(batches):
        words, sign = WordHashes(), _bands_of(level, n)
        for b in batches:
            for uid, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = sign(words, text)
                yield batch(out, h, np.full(len(h), uid))

    return mapped(texts.select("uid", "text"), run, "bucket bigint, uid bigint")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` similar, staged."""
    rows = shuffle_joined(pairs, texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    rows = shuffle_joined(rows, texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        words, known = WordHashes(), {}

        def of(uid: int, text: str):
            got = known.get(uid)
            if got is None:
                if len(known) >= 64:
                    known.clear()
                got = known[uid] = weighted_set(words.of(plain_words(text)), n)
            return got

        for b in batches:
            hits = [(a, o) for a, o, ta, to in zip(*(c.to_pylist() for c in b.columns), strict=True) if similarity(of(a, ta), of(o, to)) >= threshold]
            if hits:
                yield batch(out, *zip(*hits, strict=True))

    return staged(mapped(rows, run, "a bigint, b bigint"), "near-links")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, uid, comp, minor, n_minor, size of the buckets that hold two components or more, staged.

    A bucket's largest component (of equals the least) is its major one; minor
    are the texts outside it, of which the bucket has n_minor.
    """
    members = shuffle_joined(members, labels, "uid", "left").select("bucket", "uid", F.coalesce("comp", "uid").alias("comp"))
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    major = sizes.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("comp")).alias("c"))).alias("m"), F.sum("n").alias("size"), F.count("*").alias("comps"))
    major = staged(major.where("comps > 1").select("bucket", (-F.col("m.c")).alias("major"), (F.col("size") - F.col("m.n")).alias("n_minor"), "size"), "near-majors")
    mixed = staged(shuffle_joined(members, major, "bucket").select("bucket", "uid", "comp", (F.col("comp") != F.col("major")).alias("minor"), "n_minor", "size"), "near-mixed")
    dropped(major)
    return mixed


def _settled(mixed: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links (a, b) between components of a bucket: its minor texts against all, in blocks, staged.

    A block holds some MINOR_BLOCK minor texts and OTHER_BLOCK texts of a bucket,
    whatever its size, and gives only the links that it finds, one for each text
    and component.
    """
    place = lambda size, per, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.ceil(size / per)).cast("int")
    all_of = lambda size, per: F.sequence(F.lit(0), F.ceil(size / per).cast("int") - 1)
    others = mixed.select("bucket", "uid", "comp", F.lit(False).alias("asks"), F.explode(all_of(F.col("n_minor"), MINOR_BLOCK)).alias("i"), place(F.col("size"), OTHER_BLOCK, 1).alias("j"))
    asks = mixed.where("minor").select("bucket", "uid", "comp", F.lit(True).alias("asks"), place(F.col("n_minor"), MINOR_BLOCK, 2).alias("i"), F.explode(all_of(F.col("size"), OTHER_BLOCK)).alias("j"))
    rows = shuffle_joined(others.unionByName(asks), texts, "uid").select("bucket", "i", "j", "uid", "comp", "asks", "text")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(table: pa.Table) -> pa.Table:
        words, sets, ask, other = WordHashes(), {}, [], []
        for uid, comp, asks, text in zip(*(table[c].to_pylist() for c in ("uid", "comp", "asks", "text")), strict=True):
            if uid not in sets:
                sets[uid] = weighted_set(words.of(plain_words(text)), n)
            (ask if asks else other).append((uid, comp, int(sets[uid][1].sum())))
        links = set()
        for x, cx, wx in sorted(ask):
            joined = {cx}
            for y, cy, wy in sorted(other):
                # sizes bound the similarity
                if cy not in joined and min(wx, wy) >= threshold * max(wx, wy) and similarity(sets[x], sets[y]) >= threshold:
                    joined.add(cy)
                    links.add((min(x, y), max(x, y)))
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=out)

    return staged(rows.groupBy("bucket", "i", "j").applyInArrow(block, "a bigint, b bigint").distinct(), "near-links")


def _rows(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, list[str]]:
    """``docs`` staged with four more columns, and their names: row number, doc_id, fingerprint (MD5) and bands."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    names = unused(docs.columns, "near_row", "near_id", "near_fp", "near_bands")
    at = docs.columns.index(text_col)
    docs = docs.withColumn(names[1], F.col(id_col).cast("long")).withColumn(names[2], F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))))
    added = StructType([StructField(names[0], LongType()), StructField(names[3], ArrayType(LongType()))])
    types, schema = to_arrow_schema(added).types, StructType([*docs.schema.fields, *added.fields])

    def run(batches):
        words, sign = WordHashes(), _bands_of(0, n)
        for b, number in row_numbers(batches):
            bands = [sign(words, t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, types[0]), pa.array(bands, types[1])], names=[*b.schema.names, names[0], names[3]])

    return staged(mapped(docs, run, schema), "near-rows"), names


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, many: int):
    """The staged rows with the names of their helper columns, the distinct texts
    (fp, rep, lead, n, uid: least doc_id and first row of each) and the
    components (uid, comp) of those that are near to another."""
    rows, names = _rows(docs, id_col, text_col, n)
    row, doc_id, fp, bands = map(F.col, names)
    # copies of a text meet in one row per task before the shuffle
    lead = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), row.alias("row")))
    folded = rows.groupBy(fp.alias("fp")).agg(lead.alias("lead"), F.count("*").alias("n"), F.first(bands).alias("bands"))
    folded = staged(folded.select("fp", F.col("lead.doc_id").alias("rep"), F.col("lead.row").alias("lead"), "n", "bands", F.monotonically_increasing_id().alias("uid")), "near-texts")

    level, labels, links, texts = 0, None, None, None
    entries = folded.select("uid", F.explode("bands").alias("bucket"))
    while True:
        # every text of a bucket against its leader; of buckets with the same texts one stays
        same = [F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
        leaders = entries.groupBy("bucket").agg(F.min("uid").alias("leader"), F.count("*").alias("size"), *same).where("size > 1")
        leaders = leaders.groupBy("leader", "size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "leader")
        members = staged(shuffle_joined(entries, leaders, "bucket").select("bucket", "uid", "leader"), "near-members")
        pairs = members.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
        if level:  # texts of one component need no link
            of = lambda c: labels.select(F.col("uid").alias(c), F.col("comp").alias("c" + c))
            pairs = shuffle_joined(shuffle_joined(pairs, of("a"), "a", "left"), of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        else:
            texts = _texts(rows, names, text_col, folded, members)
        links, labels = _linked(links, labels, _verified(pairs, texts, n, threshold))
        mixed = _mixed(members.select("bucket", "uid"), labels)
        last = level + 1 == len(LEVELS)
        links, labels = _linked(links, labels, _settled(mixed if last else mixed.where(F.col("n_minor") <= many), texts, n, threshold))
        left = None if last else mixed.where(F.col("n_minor") > many).select("uid").distinct()
        dropped(members)
        if level:
            dropped(entries)
        if left is None or left.isEmpty():
            dropped(mixed, links, texts)
            return rows, names, folded, labels
        level += 1
        entries = staged(_signed(shuffle_joined(texts, left, "uid", "left_semi"), level, n), "near-entries")
        dropped(mixed)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, many: int = MANY) -> DataFrame:
    """doc_id, fp, class_id of each row; fp is the MD5 of the text.

    Rows with equal texts are one class (null counts as empty).  Texts of fewer
    than ``n`` words are one run; texts without words are near to nothing else.
    class_id is the least doc_id of the class, null if none of its rows has one.
    """
    rows, (_, doc_id, fp, _), folded, labels = _grouped(docs.select(id_col, text_col), id_col, text_col, n, threshold, many)
    named = _named(folded, labels)
    dropped(labels, folded)
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))
    return shuffle_joined(rows, named, "fp", "left").select("doc_id", "fp", F.coalesce("class_id", "doc_id").alias("class_id"))


def _named(folded: DataFrame, labels: DataFrame) -> DataFrame:
    """fp, class_id of the texts that aren't alone: the least doc_id of each component, else of the text."""
    owner = staged(shuffle_joined(labels, folded.select("uid", "rep"), "uid").groupBy("comp").agg(F.min("rep").alias("class_id")), "near-owners")
    named = shuffle_joined(folded, shuffle_joined(labels, owner, "comp").select("uid", "class_id", "comp"), "uid", "left").select("fp", F.coalesce("class_id", "rep").alias("class_id"), "n", "comp")
    named = staged(named.where("n > 1 or comp is not null").select("fp", "class_id"), "near-named")
    dropped(owner)
    return named


def _linked(links: DataFrame | None, labels: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with those found, and the components of all."""
    if links is None:
        return found, components(found)
    if found.isEmpty():
        dropped(found)
        return links, labels
    both = staged(links.unionByName(found), "near-links")
    dropped(links, found, labels)
    return both, components(both)


def _texts(rows: DataFrame, names: list[str], text_col: str, folded: DataFrame, members: DataFrame) -> DataFrame:
    """uid, text of the texts that share a bucket, staged: found in the staged rows by number."""
    wanted = shuffle_joined(folded, members.select("uid").distinct(), "uid", "left_semi").select(F.col("lead").alias("row"), F.col("uid").alias("value"))
    folder, out = by_chunk(wanted, "near-wanted"), pa.schema([("uid", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            at, uid = marked(folder, b.column(0).to_numpy())
            if len(at):
                yield batch(out, uid, b.column(1).take(pa.array(at)))

    got = staged(mapped(rows.select(names[0], F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "uid bigint, text string"), "near-compared")
    dropped(folder)
    return got


def _kept(folded: DataFrame, labels: DataFrame) -> str:
    """The folder of marks of one row of each class: of the least doc_id, then fingerprint, the first."""
    best = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp", "lead"))
    of_class = shuffle_joined(labels, folded.select("uid", "rep", "fp", "lead"), "uid").groupBy("comp").agg(best.alias("best")).select(F.col("best.lead").alias("row"))
    alone = shuffle_joined(folded, labels.select("uid"), "uid", "left_anti").select(F.col("lead").alias("row"))
    return by_chunk(of_class.unionByName(alone).select("row", F.lit(1).cast("long").alias("value")), "near-kept")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, many: int = MANY) -> DataFrame:
    """doc_id, class_id, is_kept of each row.  One row of each class is kept, the one ``one_of_each`` keeps: rows that
    repeat its doc_id aren't, and a class without ids keeps one row too."""
    rows, names, folded, labels = _grouped(docs.select(id_col, text_col), id_col, text_col, n, threshold, many)
    folder, named = _kept(folded, labels), _named(folded, labels)
    dropped(labels, folded)
    plain = rows.select(F.col(names[1]).alias("doc_id"), F.col(names[2]).alias("fp"), F.col(names[0]).alias("row"))
    schema = plain.drop("row").schema.add("is_kept", "boolean")

    def run(batches):
        for b in batches:
            kept = np.zeros(b.num_rows, dtype=bool)
            kept[marked(folder, b.column(2).to_numpy())[0]] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept)], names=["doc_id", "fp", "is_kept"])

    return shuffle_joined(mapped(plain, run, schema), named, "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "is_kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, many: int = MANY) -> DataFrame:
    """The rows of ``docs`` without all but one row of each class, all columns as they were.

    Of a class the row with the least doc_id stays (rows without one come last);
    among rows with that doc_id the one with the least fingerprint, and of rows
    equal in both any one.
    """
    rows, names, folded, labels = _grouped(docs, id_col, text_col, n, threshold, many)
    folder = _kept(folded, labels)
    dropped(labels, folded)

    def run(batches):
        for b in batches:
            at, _ = marked(folder, b.column(b.num_columns - 1).to_numpy())
            if len(at):
                kept = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return mapped(rows.select(*docs.columns, names[0]), run, docs.schema)

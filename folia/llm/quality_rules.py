"""Quality rules: a learned decision list over document statistics.

Sequential covering on labelled documents grows one conjunction of threshold
tests at a time on two thirds of the sample (by information gain), prunes it on
the other third, keeps it if it is precise there, removes what it covers and
goes on.  The result is an ordered list that reads as text and is emitted as one
``CASE WHEN`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folia.llm._text import kept_where, with_columns

#: The symbol characters and the base thresholds of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks", "n_long_words")
COUNTS = BASE + MORE
#: name -> (numerator, denominator); what the rules may test
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "letter_share": ("n_letters", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "long_word_share": ("n_long_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

_flags: np.ndarray | None = None


def _char_flags() -> np.ndarray:
    """For each code point: 1 letter, 2 upper-case, 4 digit, 8 punctuation mark ! ? ; :"""
    global _flags
    if _flags is None:
        f = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                f[c] = 3 if s.isupper() else 1
            elif s.isdigit():
                f[c] = 4
        for s in "!?;:":
            f[ord(s)] = 8
        _flags = f
    return _flags


def repeated_words(codes: np.ndarray, m: int) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    n = len(codes)
    if n < 3:
        return 0
    pair = codes[:-2] * m + codes[1:-1]
    if m > 2_000_000:  # keep the products within 64 bits
        _, pair = np.unique(pair, return_inverse=True)
    tri = pair * m + codes[2:]
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k : n - 2 + k] |= again
    return int(cover.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for a whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits at ASCII white space, as the contract's words do
    if not words:
        return (0,) * len(COUNTS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    index = dict.fromkeys(words)
    for i, w in enumerate(index):
        index[w] = i
    codes = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
    flags = np.bincount(_char_flags()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=9)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return (
        len(words),
        len(text) - spaces,
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(codes, len(index)),
        len(lines),
        len(index),
        int(flags[3]),
        int(flags[1] + flags[3]),
        int(flags[4]),
        int(flags[8]),
        int(sum(len(w) > 20 for w in words)),
    )


PREFIX = "__stat_"
#: The fields and how they are had from a list of texts.
_STATS = ([(PREFIX + c, LongType()) for c in COUNTS], lambda x: zip(*map(text_stats, x[0]), strict=True))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``__stat_<count>`` appended."""
    return with_columns(docs, [text_col], *_STATS)


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    value: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def column(self) -> Column:
        num, den = RATIOS[self.feature]
        f = F.col(PREFIX + num).cast("double") / F.greatest(F.col(PREFIX + den), F.lit(1))
        return f >= F.lit(self.value) if self.at_least else f <= F.lit(self.value)


Rule = tuple[Test, ...]


def features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a].astype(float) / np.maximum(counts[b], 1) for k, (a, b) in RATIOS.items()}


def _cover(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    got = np.ones(n, dtype=bool)
    for t in rule:
        got &= t.on(x)
    return got


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_cover: int = 5, max_tests: int = 4, max_rules: int = 40, cuts: int = 48) -> list[Rule]:
    """The decision list, most useful rules first; ``x`` and ``bad`` in any fixed order.

    A rule must reach ``min_precision`` on the pruning third and cover at least
    ``min_cover`` bad documents of the whole sample.
    """
    n = len(bad)
    prune_rows = np.arange(n) % 3 == 2
    left, rules = np.ones(n, dtype=bool), []
    while len(rules) < max_rules:
        grow, prune = left & ~prune_rows, left & prune_rows
        if bad[grow].sum() < 2:
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_tests:
            p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
            if not n0 or not p0:
                break
            base, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
            for name, v in x.items():
                vi = v[inside]
                order = np.argsort(vi, kind="stable")
                vs, ys = vi[order], bad[inside][order]
                edges = np.unique(np.quantile(vs, np.linspace(0, 1, cuts)))
                mids = np.unique((edges[1:] + edges[:-1]) / 2)
                at = np.searchsorted(vs, mids)
                cp = np.concatenate([[0], np.cumsum(ys)])
                for at_least, p, m in ((True, p0 - cp[at], len(vs) - at), (False, cp[at], at)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / m) - base), -1)
                    if len(gain) and gain.max() > best:
                        best, pick = gain.max(), Test(name, at_least, float(mids[gain.argmax()]))
            if pick is None:
                break
            rule += (pick,)
            inside &= pick.on(x)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray) -> tuple[float, int]:
            c = _cover(r, x, n) & rows
            p, m = bad[c].sum(), (~bad[c]).sum()
            return ((p - m) / (p + m) if p + m else -1.0), int(p)

        kept = rule
        while len(kept) > 1:  # leave out tests while the pruning rows don't object
            shorter = max((kept[:i] + kept[i + 1 :] for i in range(len(kept))), key=lambda r: worth(r, prune))
            if worth(shorter, prune) < worth(kept, prune):
                break
            kept = shorter
        hit = _cover(kept, x, n) & left
        held = hit & prune_rows
        precise = bad[held].mean() if held.any() else bad[hit].mean() if hit.any() else 0
        if precise < min_precision or bad[hit].mean() < min_precision or bad[hit].sum() < min_cover:
            break
        rules.append(kept)
        left &= ~hit
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        cond = rules[i][0].column()
        for t in rules[i][1:]:
            cond = cond & t.column()
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    n = F.col(PREFIX + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(PREFIX + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000) -> list[Rule]:
    """Rules for label 0, from at most ``max_train`` labelled documents.

    The sample are the labelled ids with the least hashes, so it is the same in
    every run.  Null ids and labels are left out; of an id that repeats in the
    labels the least label counts, and rows that repeat an id count as documents of
    the sample, in a fixed order.  Without both labels there are no rules.
    """
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    got = with_stats(rows).drop("text").orderBy("id", *(PREFIX + c for c in COUNTS)).limit(max_train).toPandas()
    if got.empty or got["label"].nunique() < 2:
        return []
    ok = (got[PREFIX + "n_words"] >= MIN_WORDS) & (100 * got[PREFIX + "n_repeat_words"] <= MAX_REPEAT_PERCENT * got[PREFIX + "n_words"])
    got = got[ok]
    counts = {c: got[PREFIX + c].to_numpy() for c in COUNTS}
    return learn_rules(features(counts), (got["label"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, rule (number of the first that holds), kept.

    A null text counts as empty: no words, so it fails the base test.  Each row
    gives a row, repeated or not, and texts of any length are counted whole.
    """
    rows = with_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.drop("text").withColumn("base_failed", base_failed()).withColumn("rule", rule_column(rules))
    return rows.select("doc_id", *(F.col(PREFIX + c).alias(c) for c in BASE), "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def kept_rows(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base tests and the rules keep, all columns as they were."""
    return kept_where(docs, text_col, *_STATS, ~base_failed() & rule_column(rules).isNull())

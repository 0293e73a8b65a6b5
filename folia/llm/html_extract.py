"""Main text of web pages: page structure, then a host suffix array.

Each page is cut into blocks.  Blocks inside menus, footers, adverts and the
like are boilerplate and go, blocks inside an article or main element are text,
and all others are open.  What repeats is found over the blocks that are left:
their token streams are concatenated, a suffix array (prefix doubling up to
``min_tokens``) groups the suffixes that share a long prefix, and groups that
hold distinct pages of one host mark the substrings they cover.  Open blocks keep
their unique runs.  An article loses a repeated run if most of it is on that host
alone; a run that other hosts have as well is text that sites quote, and an
article at least half of which would go is a copy and stays whole.

The array is built over chunks of pages, and only over what may repeat at all: of
the runs of ANCHOR tokens in a substring of ``min_tokens`` the one with the least
hash is its anchor, equal substrings have equal anchors, and a first pass deals
the anchors to find those on two pages of a host.  Substrings with such an anchor
are dealt whole, the repeated ones come back as one file per chunk in the shared
folder, and workers look them up there: the same repeated substrings as one array
per host would find, but a host's pages are never needed in one task.
"""

from __future__ import annotations

import html as _html
import re
import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._arrays import groups, packed, steps, unpacked
from folia.llm._store import filesystem, new_folder, publish, staged
from folia.llm._text import WordHashes, batch, mapped, mix

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript iframe noembed noframes xmp svg math object canvas audio video select".split())
#: Of these what follows is no text even if they are never closed; any other that is left open ends at once.
ENDLESS = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav aside footer form menu dialog head button search".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " sidebar side nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar skip social share sharing sharebar comment comments commentlist disqus"
    " reply replies respond discussion newsletter subscribe subscription signup login related recommended recommendations widget widgets pagination pager hidden copyright".split()
)

#: In an article these name its own parts, or stand beside other words in names that say nothing.
NOT_IN_ARTICLES = frozenset("header side banner masthead skip".split())
#: Words that a telling name may have beside it.
BESIDE = frozenset(
    "area bar block box buttons container content group inner items item links list module outer panel posts post row section site slot stories text title top bottom unit wrap wrapper footer form"
    " article body center danger error facebook fb float full google info inline large left main message middle page primary right secondary sheet small sticky success user users view visitor warning".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NUMBER = re.compile(r"[vV]?[0-9]+")


#: WEAK: dropped for a name or a form only, which may be a wrapper of the whole page.
MAIN, OPEN, DROP, WEAK = 1, 0, -1, -2
#: Tokens of an anchor.
ANCHOR = 4
#: Pages of a host that a run must be on to go from an article, and their share of the host's pages.
ARTICLE_PAGES, ARTICLE_SHARE = 3, 0.1
#: Input bytes for each part that anchors and substrings are dealt to, and the least number of parts.
PART_BYTES, LEAST_PARTS = 16 << 20, 16


def _tag_end(s: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends, past quoted attribute values."""
    i, n = at, len(s)
    while True:
        close = s.find(">", i)
        if close < 0:
            return n
        inside = s[i:close]
        q = next((c for c in inside if c in "\"'"), None)
        if q is None or "=" not in s[at:close]:
            return close + 1
        first = i + inside.index(q)
        end = s.find(q, first + 1)
        if end < 0:
            return close + 1
        i = end + 1


def _says_no_text(names: str, in_article: bool) -> bool:
    """Whether a class or id names something beside the text.

    Around an article any word of a name tells (the caller keeps wrappers of the
    whole page); within one all words of the name must, but for numbers and versions.
    """
    for name in names.split():
        parts = {x.lower() for x in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name) if x and not _NUMBER.fullmatch(x)}
        if not in_article and parts & NOT_TEXT_NAMES or in_article and parts & (NOT_TEXT_NAMES - NOT_IN_ARTICLES) and parts <= NOT_TEXT_NAMES | BESIDE:
            return True
    return False


def _kind(tag: str, attrs: str, above: int) -> int:
    """What an element makes of the text in it."""
    if above == DROP or tag in DROPPED:
        return WEAK if tag == "form" and above in (OPEN, WEAK) else DROP
    if tag == "header" and above != MAIN:
        return DROP
    if attrs:
        got = {}
        for k, v in _ATTR.findall(attrs):
            got.setdefault(k.lower(), v.strip("\"'"))
        role = got.get("role", "").lower()
        if role in NOT_TEXT_ROLES and (role != "form" or above == MAIN) or "hidden" in got or got.get("aria-hidden", "").lower() == "true":
            return DROP
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
            return DROP
        if tag not in ("html", "body", "article", "main"):
            names = f"{got.get('class', '')} {got.get('id', '')}"
            if names.strip() and role not in ("main", "article") and _says_no_text(names, above == MAIN):
                return DROP if above == MAIN else WEAK
        elif tag == "article" and NOT_TEXT_NAMES & {"comment", "comments", "reply", "related", "promo"} & set(re.split(r"[^a-z0-9]+", got.get("class", "").lower())):
            return DROP
        if role in ("main", "article"):
            return MAIN
        if role == "form":
            return WEAK
    return MAIN if tag in ("article", "main") else above


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order.

    On pages without article text, blocks dropped for a wrapper's name or a form are
    open if they hold most of the page's words.
    """
    s = html or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, buf, i, n = OPEN, [], 0, len(s)

    def flush() -> None:
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            if text:
                out.append((kind, text))
            buf.clear()

    while i < n:
        lt = s.find("<", i)
        if lt < 0:
            lt = n
        if lt > i:
            buf.append(s[i:lt])
        if lt >= n:
            break
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 4)
            i = n if end < 0 else end + 3
            continue
        if s.startswith(("<!", "<?"), lt):
            end = s.find(">", lt)
            i = n if end < 0 else end + 1
            continue
        closing = s.startswith("</", lt)
        m = _NAME.match(s, lt + 1 + closing)
        if not m:
            buf.append("<")
            i = lt + 1
            continue
        tag, end = m.group().lower(), _tag_end(s, m.end())
        attrs = s[m.end() : end - 1]
        i = end
        if closing:
            if tag in BLOCKS:
                flush()
            if any(t == tag for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    if t == tag:
                        break
                kind = stack[-1][1] if stack else OPEN
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = None if attrs.rstrip().endswith("/") else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, i)
            i = end.end() if end else n if tag in ENDLESS and not attrs.rstrip().endswith("/") else i
            buf.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            # a block ends an open paragraph, and with it the inline elements left open in it
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in BLOCKS), -1)
            if at >= 0 and stack[at][0] == "p":
                del stack[at:]
                kind = stack[-1][1] if stack else OPEN
        elif tag in ("br", "wbr"):
            buf.append(" " if tag == "br" else "")
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        below = _kind(tag, attrs, kind)
        if below != kind and tag not in BLOCKS and buf:
            flush()
        stack.append((tag, below))
        kind = below
    flush()
    if any(k == WEAK for k, _ in out):
        words = {x: sum(len(t.split()) for k, t in out if k == x) for x in (MAIN, OPEN, WEAK)}
        as_ = OPEN if not words[MAIN] and words[WEAK] >= words[OPEN] else DROP
        out = [(as_ if k == WEAK else k, t) for k, t in out]
    return out


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def same_prefix_groups(tokens: np.ndarray, page: np.ndarray, depth: int) -> np.ndarray:
    """Group number of each suffix by its first ``depth`` tokens, -1 where its page ends before.

    ``tokens`` is the concatenation of the pages' streams and ``page`` the page of
    each token.  This is the suffix array's prefix doubling, stopped at ``depth``:
    suffixes in one group are neighbours in the array with a common prefix of at
    least that length.
    """
    n = len(tokens)
    if n < depth:
        return np.full(n, -1, dtype=np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - step] = rank[step:]
        rank = np.unique(rank * np.int64(n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    whole = np.zeros(n, dtype=bool)
    whole[: n - depth + 1] = page[: n - depth + 1] == page[depth - 1 :]
    return np.where(whole, rank, -1)


PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("in_article", pa.list_(pa.bool_())), ("texts", pa.list_(pa.string())), ("n_boilerplate", pa.int64())])


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, chunk_tokens: int) -> DataFrame:
    """page_id, url, host, the number of the page's chunk and its place there, its blocks that may be text, and how many others it has."""

    def run(batches):
        chunk, place, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = blocks(html)
                left = [(k == MAIN, t) for k, t in got if k != DROP]
                rows.append((page, url, host_of(url), chunk, place, [k for k, _ in left], [t for _, t in left], len(got) - len(left)))
                held, place = held + sum(t.count(" ") + 1 for _, t in left), place + 1
                if held >= chunk_tokens:
                    chunk, place, held = chunk + 1, 0, 0
            yield batch(PARSED, *zip(*rows, strict=True))

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return mapped(picked, run, "page_id bigint, url string, host string, chunk bigint, place bigint, in_article array<boolean>, texts array<string>, n_boilerplate bigint")


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` tokens from each place on that has so many."""
    m = max(0, len(hashes) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n if m else 0):
        h = mix(h ^ hashes[k : m + k])
    return h


def anchors(tokens: np.ndarray, min_tokens: int, bits: int = 63) -> np.ndarray:
    """The anchor of the substring of ``min_tokens`` from each place on, its first ``bits`` bits."""
    short = gram_hashes(tokens, min(ANCHOR, min_tokens))
    m = max(0, len(tokens) - min_tokens + 1)
    out = short[:m].copy()
    for k in range(1, len(short) - m + 1 if m else 0):
        np.minimum(out, short[k : m + k], out=out)
    return out >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Pages:
    """Pages of a chunk: their tokens in one array, the place of each page, its host's hash and where it begins."""

    tokens: np.ndarray
    place: np.ndarray
    host: np.ndarray
    starts: np.ndarray

    def anchored(self, min_tokens: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, token, anchor) of each substring of ``min_tokens`` that lies in a page."""
        a = anchors(self.tokens, min_tokens, bits)
        page = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.tokens))))
        at = np.flatnonzero(page[: len(a)] == page[min_tokens - 1 :]) if len(a) else np.empty(0, dtype=np.int64)
        return page[at], at, a[at]


BLOBS, BLOBS_DDL = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())]), "part bigint, chunk bigint, data binary"
FOUND = pa.schema([("chunk", pa.int64()), ("data", pa.binary())])


def _by_chunk(parsed: DataFrame, fold, part_of) -> DataFrame:
    """Blobs of what ``fold(chunk, pages)`` makes of a chunk, or of as much as a task reads
    of it: None or arrays of one length, the first sorted keys, and arrays that all blobs
    have.  ``part_of`` says where a key goes."""

    def run(batches):
        words, now, held = WordHashes(500_000), None, []

        def blobs():
            place, host, streams = zip(*held, strict=True)
            sizes = np.array([len(x) for x in streams])
            pages = Pages(np.concatenate(streams), np.array(place), np.array([xxhash.xxh3_64_intdigest(h) for h in host], dtype=np.uint64), np.cumsum(sizes) - sizes)
            got = fold(now, pages)
            if got is None or not len(got[0][0]):
                return
            got, all_have = got
            part = part_of(got[0])
            order = np.argsort(part, kind="stable")
            cut = np.append(groups(part[order]), len(order)).tolist()
            data = [packed(steps(got[0][order[lo:hi]]), *(x[order[lo:hi]] for x in got[1:]), *all_have) for lo, hi in zip(cut, cut[1:], strict=False)]
            yield batch(BLOBS, part[order[cut[:-1]]], np.full(len(data), now), data)

        for b in batches:
            for host, chunk, place, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now and held:
                    yield from blobs()
                    held = []
                now = chunk
                held.append((place, host, words.of(" ".join(texts).split())))
        if held:
            yield from blobs()

    return mapped(parsed.select("host", "chunk", "place", "texts"), run, BLOBS_DDL)


def _saved(blobs: DataFrame, merge, folder: str) -> None:
    """Writes what ``merge`` makes of a part's (chunk, arrays) as a file per chunk."""

    def merged(table: pa.Table) -> pa.Table:
        got = [(c, x) for c, x in merge([(c, unpacked(d)) for c, d in zip(table["chunk"].to_pylist(), table["data"].to_pylist(), strict=True)]) if len(x)]
        return pa.table([[c for c, _ in got], [np.unique(x).astype("<u8").tobytes() for _, x in got]], schema=FOUND)

    def save(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        with tempfile.NamedTemporaryFile() as f:
            f.write(np.unique(np.frombuffer(b"".join(table["data"].to_pylist()), dtype="<u8")).tobytes())
            f.flush()
            publish(folder, str(chunk), f.name)
        return pa.table([[chunk]], schema=pa.schema([("chunk", pa.int64())]))

    blobs.groupBy("part").applyInArrow(merged, "chunk bigint, data binary").groupBy("chunk").applyInArrow(save, "chunk bigint").count()


@lru_cache(maxsize=8)
def _of_chunk(folder: str, chunk: int) -> np.ndarray:
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base}/{chunk}").type != pafs.FileType.File:
        return np.empty(0, dtype=np.uint64)
    with fs.open_input_file(f"{base}/{chunk}") as f:
        return np.frombuffer(f.read(), dtype="<u8").astype(np.uint64)


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), dtype=bool)


def shared_anchors(parsed: DataFrame, min_tokens: int, parts: int, bits: int) -> str:
    """The folder with a file for each chunk that has some: twice each anchor that two
    pages of a host have, plus 1 if that is no reason to take it from an article, sorted."""
    folder = new_folder(parsed.sparkSession, "html-anchors")

    def fold(chunk: int, pages: Pages):
        page, _, anchor = pages.anchored(min_tokens, bits)
        # hosts by their number in the chunk: few, so that they compress
        table, of, n = np.unique(pages.host >> np.uint64(32), return_inverse=True, return_counts=True)
        rank = np.argsort(-n, kind="stable")
        back = np.empty(len(rank), dtype=np.int64)
        back[rank] = np.arange(len(rank))
        host = back[of][page]
        order = np.lexsort((page, host, anchor))
        page, host, anchor = page[order], host[order], anchor[order]
        once = groups(anchor, host, page)
        host, anchor = host[once], anchor[once]
        first = groups(anchor, host)
        return (anchor[first], host[first], np.diff(np.append(first, len(anchor)))), (table[rank], n[rank])

    def merge(blobs: list):
        anchor = np.concatenate([np.cumsum(x[0].astype(np.uint64), dtype=np.uint64) for _, x in blobs])
        host = np.concatenate([x[3][x[1]].astype(np.uint64) for _, x in blobs])
        n = np.concatenate([x[2] for _, x in blobs]).astype(np.int64)
        source = np.repeat(np.arange(len(blobs)), [len(x[0]) for _, x in blobs])
        hosts, of = np.unique(np.concatenate([x[3] for _, x in blobs]).astype(np.uint64), return_inverse=True)
        pages_of = np.bincount(of, np.concatenate([x[4] for _, x in blobs]).astype(np.float64))
        order = np.lexsort((host, anchor))
        a, h = anchor[order], host[order]
        own = groups(a, h)
        by_anchor, spread = groups(a), lambda x, first: np.repeat(x, np.diff(np.append(first, len(a))))
        here, all_ = spread(np.add.reduceat(n[order], own), own), spread(np.add.reduceat(n[order], by_anchor), by_anchor)
        again, foreign = here > 1, (2 * here <= all_) | (here < np.maximum(ARTICLE_PAGES, ARTICLE_SHARE * pages_of[np.searchsorted(hosts, h)]))
        back = np.empty(len(a), dtype=np.int64)
        back[order] = np.arange(len(a))
        again, foreign = again[back], foreign[back]
        for i, (chunk, _) in enumerate(blobs):
            mine = (source == i) & again
            yield chunk, (anchor[mine] << np.uint64(1)) | foreign[mine].astype(np.uint64)

    _saved(_by_chunk(parsed, fold, lambda a: ((a >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)), merge, folder)
    return folder


def repeats(parsed: DataFrame, anchored: str, min_tokens: int, parts: int, bits: int) -> str:
    """The folder with a file for each chunk that has some: where substrings of
    ``min_tokens`` tokens begin that distinct pages of a host share.

    The numbers are the page's place << 32, plus the token's place in the page << 1,
    plus 1 if an article may lose it.
    """
    folder = new_folder(parsed.sparkSession, "html-repeats")

    def fold(chunk: int, pages: Pages):
        known = _of_chunk(anchored, chunk)
        if not len(known):
            return None
        page, at, anchor = pages.anchored(min_tokens, bits)
        may = _in(known >> np.uint64(1), anchor)
        if not may.any():
            return None
        page, at, own = page[may], at[may], ~_in(known, (anchor[may] << np.uint64(1)) | np.uint64(1))
        # the array is built over the tokens of such substrings only; pieces are what lies together in a page
        inside = np.zeros(len(pages.tokens) + 1, dtype=np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + min_tokens, -1)
        left = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        of = np.searchsorted(pages.starts, left, side="right") - 1
        piece = np.cumsum((np.diff(left, prepend=left[0]) > 1) | (np.diff(of, prepend=of[0]) > 0))
        # equal words of two hosts are different tokens
        tokens = pages.tokens[left] ^ pages.host[of]
        group, gram = same_prefix_groups(tokens, piece, min_tokens), gram_hashes(tokens, min_tokens)
        here = np.searchsorted(left, at)
        group, gram = group[here], gram[here]
        order = np.lexsort((page, group))
        first = groups(group[order])
        sizes = np.diff(np.append(first, len(order)))
        many = np.repeat(page[order[first]] < page[order[np.cumsum(sizes) - 1]], sizes)
        place = ((pages.place[page] << 32) | ((at - pages.starts[page]) << 1) | own).astype(np.uint64)[order]
        gram = gram[order]
        by = np.argsort(gram, kind="stable")
        return (gram[by], many[by].astype(np.uint8), place[by] >> np.uint64(32), place[by] & np.uint64(0xFFFFFFFF)), ()

    def merge(blobs: list):
        """A substring of two blobs is in two pages: chunks, and what tasks read of one, have no page in common."""
        grams = [np.cumsum(x[0].astype(np.uint64), dtype=np.uint64) for _, x in blobs]
        everything = np.sort(np.concatenate([np.unique(g) for g in grams]))
        again = np.unique(np.concatenate([everything[1:][everything[1:] == everything[:-1]], *(g[x[1] > 0] for g, (_, x) in zip(grams, blobs, strict=True))]))
        for g, (chunk, x) in zip(grams, blobs, strict=True):
            hit = _in(again, g)
            yield chunk, (x[2][hit].astype(np.uint64) << np.uint64(32)) | x[3][hit].astype(np.uint64)

    _saved(_by_chunk(parsed, fold, lambda g: ((g >> np.uint64(13)) % np.uint64(parts)).astype(np.int64)), merge, folder)
    return folder


def settle(in_article: list[bool], texts: list[str], starts: np.ndarray, own: np.ndarray, min_tokens: int) -> str:
    """The text of a page, given the places of repeated substrings in its stream and which of them are mostly on the host."""
    words = [t.split() for t in texts]
    total, starts = sum(map(len, words)), np.asarray(starts, dtype=np.int64)

    def covered(at: np.ndarray) -> list[np.ndarray]:
        cover = np.zeros(total + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, np.minimum(at + min_tokens, total), -1)
        return np.split(np.cumsum(cover)[:total] > 0, np.cumsum([len(w) for w in words])[:-1])

    if not len(starts):
        return "\n".join(texts)
    # runs: substrings that touch; if most of one is mostly on the host, all of it is boilerplate
    run = np.cumsum(np.diff(starts, prepend=starts[0]) > min_tokens)
    hosts_own = 2 * np.bincount(run, np.asarray(own, dtype=np.float64)) > np.bincount(run)
    everywhere, here = covered(starts), covered(starts[hosts_own[run]])
    article = [c for k, c in zip(in_article, here, strict=True) if k]
    # most of an article isn't boilerplate: it is a copy
    copy = 2 * sum(int(c.sum()) for c in article) >= sum(map(len, article))
    out, spare = [], []
    for k, t, w, a, b in zip(in_article, texts, words, here, everywhere, strict=True):
        c = a if k else b
        if k and copy or not c.any():
            out.append(t)
        elif c.all():
            spare.append(t)
        else:
            out.append(" ".join(x for x, y in zip(w, c, strict=True) if not y))
    return "\n".join(out if out else spare)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 8, chunk_tokens: int = 1_000_000) -> DataFrame:
    """page_id, url, text, n_chars, host, n_boilerplate per row of ``pages``.

    Null or empty html, and pages of boilerplate only, give an empty text; a null
    url is a host without a name.  Repeated rows each give a row, and rows of one
    page count as distinct pages.  Html of any length is read whole; elements left
    open end with the page, but audio, video and the like, which hold no text, end
    at once.  A page all of whose open text is repeated elsewhere keeps it: it is
    a copy, not boilerplate.
    """
    # the planner's estimate; without one it is huge and LEAST_PARTS holds
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    # an anchor meets another by chance once in thousands of times, which costs a second look
    bits = min(63, size.bit_length() + 12) if size else 63
    parsed = staged(parse_pages(pages, id_col, url_col, html_col, chunk_tokens), "html-parsed", zstd_level=9)
    anchored = shared_anchors(parsed, min_tokens, parts, bits)
    folder = repeats(parsed, anchored, min_tokens, parts, bits)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("n_boilerplate", pa.int64())])

    def finish(batches):
        for b in batches:
            rows = []
            for page, url, host, chunk, place, in_article, texts, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                marks = _of_chunk(folder, chunk)
                marks = marks[np.searchsorted(marks, np.uint64(place << 32)) : np.searchsorted(marks, np.uint64((place + 1) << 32))]
                at = ((marks & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.int64)
                rows.append((page, url, host, settle(in_article, texts, at, (marks & np.uint64(1)).astype(bool), min_tokens), n))
            yield batch(out, *zip(*rows, strict=True))

    both = mapped(parsed, finish, "page_id bigint, url string, host string, text string, n_boilerplate bigint")
    return both.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host", "n_boilerplate")

"""Main text of pages: the page's own structure, and suffix arrays over the streams of a host for the runs it repeats."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import join_groups, whole_text, written
from panelyard.llm.minhash import mixed

#: Words of a repeated run at least.
RUN = 8
#: A run is boilerplate when so many pages of the host carry it, and this share of its pages.
PAGES, SHARE = 10, 0.5
#: Windows of a host that meet in one group, and words of its repeated stretches that one slice of its array holds.
PART_WINDOWS, SLICE_WORDS = 500_000, 1_000_000
#: Window prints that a task gathers before it passes them on.
GATHERED = 2_000_000
_KEPT = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Elements whose content is never text, and those that are not the main text (fixed by HTML's meaning).
SILENT = frozenset("script style template noscript head title svg math iframe object canvas select option datalist textarea button".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset(["article", "main"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these closes an open one.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Words in class, id or role that mark what is not the main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices newsletter subscribe popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget footer masthead topbar header share sharing social related recommended comment comments disqus "
    "reply replies login signup form search paywall alert complementary contentinfo hidden skip toolbar pagination pager".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>/])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}


def _marked(tag: str, in_main: bool) -> bool:
    """Whether class, id or role name other things; inside the main part a header is its own."""
    for groups in _MARKED.findall(tag):
        if any(word in MARKS and not (in_main and word == "header") for word in _PART.split("".join(groups).lower())):
            return True
    return bool(_HIDDEN.search(tag))


def blocks(html: str) -> list[tuple[str, int]]:
    """Visible blocks in page order with their standing: 2 in the main part, 1 outside it, 0 in a container of other things.

    Character references are decoded, white space becomes one space. Markup
    may be unclosed or cut anywhere. A mark on the main part itself, on html
    or on body says nothing.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # element, standing inside
    text: list[str] = []
    standing = 1

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, standing))

    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.match(html, at)
        piece, at = token[0], token.end()
        if piece[0] != "<" or piece == "<":
            text.append(piece)
            continue
        name = _NAME.match(piece)
        if not name:
            if piece.startswith("<![CDATA["):
                text.append(entities.escape(piece[9:-3]))
            continue
        tag = name[1].lower()
        if piece[1] == "/":
            if tag == "br":
                text.append(" ")
                continue
            if any(t == tag for t, _ in stack):
                if tag in BLOCKS:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                standing = stack[-1][1] if stack else 1
            elif tag in BLOCKS:
                flush()
            continue
        if tag in SILENT and tag in _RAW and not piece.endswith("/>"):
            close = _RAW[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            standing = stack[-1][1] if stack else 1
        if tag in VOID or piece.endswith("/>"):
            continue
        inside = standing
        if tag in SILENT:
            inside = -1
        elif standing > 0:
            if tag in MAIN:
                inside = 2
            elif tag in ASIDE and not (tag == "header" and standing == 2):
                inside = 0
            elif tag not in ("html", "body") and _marked(piece, standing == 2):
                inside = 0
        if inside != standing and text:
            flush()
        stack.append((tag, inside))
        standing = inside
    flush()
    return [(line, s) for line, s in out if s >= 0]


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _KEPT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_hashes = _Hashes()


def main_blocks(html: str) -> list[list[list[str]]]:
    """The words of the blocks that are in no container of other things: those of the main part, of what stands before it and of what stands behind.

    The main part reaches from the first to the last block of an article or main
    element; on a page without one it is all. A page with text in containers
    of other things only, like one whole form, is its own main part.
    """
    found = blocks(html)
    given = [(line.split(" "), s) for line, s in found if s > 0] or [(line.split(" "), 2) for line, _ in found]
    inner = [k for k, (_, s) in enumerate(given) if s == 2]
    low, high = (inner[0], inner[-1] + 1) if inner else (0, len(given))
    words = [block for block, _ in given]
    return [words[low:high], words[:low], words[high:]]


def word_codes(main: list[list[str]]) -> np.ndarray:
    words = [w for block in main for w in block]
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def core(codes: np.ndarray, run: int) -> int:
    """The least window hash of the middle half: copies and most near copies of a page agree in it, so they count as one page."""
    n = len(codes)
    middle = codes[n // 4 : n - n // 4]
    width = min(run, len(middle))
    if not width:
        return 0
    out = np.full(len(middle) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * _ODD + middle[k : k + len(out)])
    return int(out.astype(np.int64).min())


def without(main: list[list[str]], head: int, tail: int) -> list[str]:
    """The blocks without the first ``head`` and the last ``tail`` words; what is left of a block stays."""
    end = sum(map(len, main)) - tail
    out, at = [], 0
    for words in main:
        left = words[max(0, head - at) : max(0, end - at)]
        at += len(words)
        if left:
            out.append(" ".join(left))
    return out


def window_names(codes: np.ndarray, run: int) -> np.ndarray:
    """Names of 64 bits for the windows of ``run`` words at every place of a stream but the last ``run`` - 1."""
    width = max(0, len(codes) - run + 1)
    out = np.zeros(width, dtype=np.uint64)
    for k in range(run):
        out = out * _ODD + codes[k : k + width]
    return mixed(out)


def _windows(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word codes of the texts one after the other, where each text starts, and the window names at all places.

    A window that reaches into the next text has a name, too; callers leave it out.
    """
    words = [t.split() for t in texts]
    starts = np.cumsum([0] + [len(w) for w in words])
    codes = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(starts[-1]))
    return codes, starts, window_names(codes, run)


def _prints(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(32)).astype(np.uint32)


def packed(ordered: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, first bytes first: differences are small, so most high bytes are 0 and compress."""
    steps = np.diff(ordered, prepend=ordered[:1] * 0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes in their order, and how many tokens each shares with the one before it (0 for the first).

    Built by prefix doubling: a rank stands for the next 1, 2, 4, ... tokens,
    until all ranks differ. The ranks of all widths are kept, and the shared
    prefix of two neighbours is added up from them, widest first. The last
    token must occur once.
    """
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while n and ranks[-1].max() < n - 1:
        rank = ranks[-1]
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - width] = rank[width:] + 1
        ranks.append(np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in reversed(range(len(ranks))):
        same = ranks[level][a] == ranks[level][b]
        shared[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, shared


def array_runs(stretches: list[np.ndarray], heads: np.ndarray, tails: np.ndarray, run: int) -> list[tuple[int, int, int, int, int]]:
    """(stretch, side, words, number, place) of the repeated runs that a suffix array over distinct stretches finds at page heads and tails.

    A page's head is a start sign before the stretch, its tail an end sign
    behind it, and a sign that occurs once closes every stretch. Runs at the head
    are what suffixes from a start sign on share; runs at the tail are equal
    suffixes up to an end sign. Stretches that carry the same run get the same
    number; of runs with the same stretches only the longest is given.
    Other repeated runs of the array touch neither sign: they are quotations.
    ``place`` is where the run starts in its stretch.
    """
    sizes = np.array([len(w) for w in stretches])
    words = np.unique(np.concatenate(stretches), return_inverse=True)[1].reshape(-1) + 2
    spans = sizes + heads + tails + 1
    first = np.cumsum(np.concatenate([[0], spans]))
    of = np.repeat(np.arange(len(sizes)), spans)
    inside = np.arange(first[-1]) - first[of] - heads[of]  # place in the stretch; -1 is a start sign
    tokens = np.where(inside < 0, 0, 1)
    tokens[(inside >= 0) & (inside < sizes[of])] = words
    ends = first[1:] - 1
    tokens[ends] = words.max() + 1 + np.arange(len(sizes))
    order, shared = suffix_array(tokens)
    out = []

    m = int(heads.sum())  # the start sign is the least token
    if m:
        who, alike = of[order[:m]], shared[1:m] - 1
        for w in np.unique(np.concatenate([alike[alike >= run], sizes[who]])).tolist():
            group = np.cumsum(np.concatenate([[True], alike < w]))
            members = np.bincount(group)
            least = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(least, group[1:][alike >= w], alike[alike >= w])
            given = (least[group] == w) | ((members[group] == 1) & (sizes[who] == w))
            out += [(c, 0, w, len(tokens) + w * m + g, 0) for c, g in zip(who[given].tolist(), group[given].tolist())]

    left = sizes[of[order]] - inside[order]
    asked = (tails[of[order]] > 0) & (inside[order] >= 0) & (left >= run)
    group = np.cumsum((shared < left + 1) | ~asked)[asked]
    if len(group):
        at = order[asked]
        before = np.where(inside[at] == 0, -1 - at, tokens[at - 1])
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        many = np.diff(np.concatenate([starts, [len(group)]]))
        differ = np.minimum.reduceat(before, starts) != np.maximum.reduceat(before, starts)
        given = np.repeat(differ | ((many == 1) & (before[starts] < 0)), many)
        columns = (of[at], left[asked], group, inside[at])
        out += [(c, 1, w, g, p) for c, w, g, p in zip(*(x[given].tolist() for x in columns))]
    return out


def _sides(found: DataFrame) -> DataFrame:
    """One row per page: the words of its head (side 0) and of its tail (side 1)."""
    found = found.groupBy("key").pivot("side", [0, 1]).agg(F.max("words"))
    return found.select("key", F.coalesce("0", F.lit(0)).alias("head"), F.coalesce("1", F.lit(0)).alias("tail"))


def _met_windows(asked: DataFrame, run: int) -> DataFrame:
    """(site, prints): 32-bit prints of the windows, at whatever place, that ``need`` pages of the site may carry.

    Every window of every page is counted, once per page. Prints of a task go
    out ordered and packed, in parts of a site by their value. Windows that
    share a print count together, so none that enough pages carry is lost.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(held: dict) -> Iterator:
            out = []
            for (site, parts, need), gathered in held.items():
                ordered = np.sort(np.concatenate(gathered))
                ends = np.searchsorted((ordered.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
                out += [(site, k, need, packed(ordered[x:y])) for k, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if y > x]
            for at in range(0, len(out), 500):
                columns = [pa.array(c, k) for c, k in zip(zip(*out[at : at + 500]), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["site", "part", "need", "prints"])

        held: dict = {}
        n = 0
        for batch in batches:
            codes, starts, names = _windows(batch.column(3).to_pylist(), run)
            for *site, a, b in zip(*(c.to_pylist() for c in batch.columns[:3]), starts[:-1].tolist(), starts[1:].tolist()):
                own = np.unique(_prints(names[a : b - run + 1]))
                held.setdefault(tuple(site), []).append(own)
                n += len(own)
            if n >= GATHERED:
                yield from passed(held)
                held, n = {}, 0
        yield from passed(held)

    def meet(table):
        import pyarrow as pa

        prints, pages = np.unique(np.concatenate([unpacked(p) for p in table["prints"].to_pylist()]), return_counts=True)
        found = prints[pages >= table["need"][0].as_py()]
        return pa.table({"site": table["site"].slice(0, 1), "prints": pa.array([found.tobytes()], pa.binary())})

    dealt = asked.select("site", "parts", "need", "text").mapInArrow(cut, "site long, part int, need long, prints binary")
    found = dealt.groupBy("site", "part").applyInArrow(meet, "site long, prints binary").filter(F.length("prints") > 0)
    return found.groupBy("site").agg(F.collect_list("prints").alias("prints"))


def _stretches(asked: DataFrame, met: DataFrame, run: int) -> DataFrame:
    """(key, site, core, stretch, head, tail, codes): the longest stretches of each page whose windows are all in ``met``.

    A run that enough pages carry lies in one stretch. ``stretch`` names the
    word codes, signs and site in 64 bits.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            codes, starts, names = _windows(batch.column(3).to_pylist(), run)
            prints = _prints(names)
            rows = zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(4), starts[:-1].tolist(), starts[1:].tolist())
            for key, site, page, lists, a, b in rows:
                if site not in known:
                    if len(known) >= 100:
                        known.clear()
                    known[site] = np.sort(np.frombuffer(b"".join(lists.as_py()), dtype=np.uint32))
                own = prints[a : b - run + 1]
                at = np.minimum(np.searchsorted(known[site], own), len(known[site]) - 1)
                hit = np.concatenate([[False], known[site][at] == own, [False]])
                edges = np.flatnonzero(hit[1:] != hit[:-1])
                for x, y in zip(edges[::2].tolist(), (edges[1::2] + run - 1).tolist()):
                    held, head, tail = codes[a + x : a + y].astype("<u8").tobytes(), x == 0, a + y == b
                    name = xxhash.xxh3_64_intdigest(held, seed=(site * 4 + 2 * head + tail) % 2**64)
                    out.append((key, site, page, name - 2**64 if name >= 2**63 else name, head, tail, held))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "site", "core", "stretch", "head", "tail", "codes"])

    near = asked.select("key", "site", "core", "text").join(met, "site").select("key", "site", "core", "text", "prints")
    return near.mapInArrow(cut, "key string, site long, core long, stretch long, head boolean, tail boolean, codes binary")


def _host_arrays(distinct: DataFrame, run: int, slice_words: int) -> DataFrame:
    """(stretch, found): the runs at page heads and tails of each distinct stretch, from one suffix array per host.

    A host with more than ``slice_words`` words in distinct stretches has its
    array in slices: suffixes go by the name of their first ``run`` words, and a
    slice holds the stretches of its suffixes, so what suffixes share is seen
    whole. Only the suffixes of a stretch that ends a page are asked in several
    slices; any other stretch goes to that of its first suffix.
    """

    def owners(codes: bytes, tail: bool, slices: int) -> list[int]:
        if slices == 1:
            return [0]
        words = np.frombuffer(codes, dtype="<u8")
        return np.unique(window_names(words if tail else words[:run], run) % np.uint64(slices)).tolist()

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = [owners(*row) for row in zip(*(batch[c].to_pylist() for c in ("codes", "tail", "slices")))]
            at = np.repeat(np.arange(len(own)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array([k for o in own for k in o], pa.int32())], names=[*batch.schema.names, "slice"])

    def sorted_slice(table):
        import pyarrow as pa

        codes = [np.frombuffer(c, dtype="<u8") for c in table["codes"].to_pylist()]
        heads, tails = (np.array(table[c].to_pylist(), dtype=np.int64) for c in ("head", "tail"))
        slices, this = table["slices"][0].as_py(), table["slice"][0].as_py()
        out = array_runs(codes, heads, tails, run)
        if slices > 1:
            firsts = [int(window_names(codes[c][p : p + run], run)[0]) for c, _, _, _, p in out]
            out = [row for row, name in zip(out, firsts) if name % slices == this]
        c, side, words, number, _ = zip(*out) if out else [()] * 5
        site = table["site"][0].as_py()
        columns = [pa.array([site] * len(out), pa.int64()), pa.array([this] * len(out), pa.int32()), table["stretch"].take(pa.array(c, pa.int64()))]
        return pa.table([*columns, pa.array(side, pa.int8()), pa.array(words, pa.int32()), pa.array(number, pa.int64())], names=["site", "slice", "stretch", "side", "words", "number"])

    sizes = distinct.groupBy("site").agg(F.ceil(F.sum(F.length("codes") / 8) / slice_words).cast("int").alias("slices"))
    columns = "site long, stretch long, head boolean, tail boolean, codes binary, slices int"
    rows = distinct.join(sizes, "site").select("site", "stretch", "head", "tail", "codes", "slices").mapInArrow(dealt, f"{columns}, slice int")
    found = rows.groupBy("site", "slice").applyInArrow(sorted_slice, "site long, slice int, stretch long, side tinyint, words int, number long")
    name = F.xxhash64("site", "slice", "side", "number").alias("run")
    return found.groupBy("stretch").agg(F.collect_list(F.struct("side", "words", name)).alias("found"))


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least_pages: int = PAGES, share: float = SHARE,
    part_windows: int = PART_WINDOWS, slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """Every row with ``text``: its blocks of main text, joined by two line feeds.

    The page's own structure comes first: menus, headers, footers, sidebars,
    notices, adverts, forms and comments are no main text. What is left of a page
    with an article or main element has three streams, the main part and what
    stands before and behind it; any other page is one. Of a stream's words,
    those go that the host repeats at the head or the tail of such streams: the
    longest run of ``run`` words or more, from the first word on or up to the
    last, that ``least_pages`` pages of the host and the ``share`` of its pages
    with such a stream carry there. The rest of a block stays, so words beside an article stay unless the
    host repeats them. A main part of which such runs are more than half keeps
    all, since it does not differ otherwise. A run further inside, or on fewer
    pages, is a quotation and stays.

    Runs come from a suffix array over the whole streams of a host, with a sign
    before and behind every one. Suffixes whose first ``run`` words too few
    pages carry are left out before it is sorted, since no run starts there: the
    windows at every place of every page are counted first. What is left of a
    page are stretches; equal ones are folded, and the array sorts the
    distinct ones. The pages that carry a run are counted from their stretches.
    Pages that agree in the least window of the middle half of their main part,
    copies above all, count as one.

    Pages are read once and their streams written; of all other steps only
    prints, stretches and counts leave the pages. Null and empty pages give the
    empty text; a null URL is a host of its own. Every row gives one row,
    repeated ids too; other columns are ignored.
    """

    streams = "array<struct<part int, words int, text string>>"

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            out = []
            for html in batch.column(4).to_pylist():
                parts = main_blocks(html)
                held = [{"part": k, "words": sum(map(len, part)), "text": "\n\n".join(map(" ".join, part))} for k, part in enumerate(parts) if part]
                out.append((core(word_codes(parts[0]), run), held))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), kind))]
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["id", "url", "key", "site", "core", "streams"])

    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), r"://([^/?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), whole_text(html_col).alias("html"))
    rows = rows.withColumns({"site": F.xxhash64("host"), "key": F.md5(F.concat_ws("\n", "host", "html"))}).select("id", "url", "key", "site", "html")
    kind = rows.schema["id"].dataType.simpleString()
    texts = written(rows.mapInArrow(read, f"id {kind}, url string, key string, site long, core long, streams {streams}"), "texts", "zstd")

    # every stream is read like a page, and those beside a main part like pages of another host
    asked = texts.select("key", "site", "core", F.inline("streams")).filter(F.col("words") >= run)
    asked = asked.withColumns({"key": F.concat("key", "part"), "site": F.when(F.col("part") == 0, F.col("site")).otherwise(F.xxhash64("site", "part"))})
    sizes = asked.groupBy("site", "core").agg(F.sum("words").alias("words")).groupBy("site").agg(F.count(F.lit(1)).alias("of"), F.sum("words").alias("words"))
    need = F.greatest(F.lit(least_pages).cast("long"), F.ceil(F.lit(share) * F.col("of")))
    sizes = sizes.filter(F.col("of") >= least_pages).select("site", need.alias("need"), F.ceil(F.col("words") / part_windows).cast("int").alias("parts"))
    sizes = written(sizes, "sites")
    met = written(_met_windows(asked.join(sizes, "site"), run), "met")
    held = written(_stretches(asked, met, run), "stretches", "zstd")
    firsts = [F.first(c).alias(c) for c in ("site", "head", "tail", "codes")]
    distinct = written(held.groupBy("stretch").agg(*firsts, F.count(F.lit(1)).alias("pages")), "distinct", "zstd")
    arrays = _host_arrays(distinct, run, slice_words).join(distinct.select("stretch", "pages"), "stretch")
    arrays = written(arrays, "arrays")
    carried = join_groups(held.filter("head or tail").select("key", "site", "core", "stretch"), arrays, "stretch", "pages", held.count())
    carried = written(carried.select("key", "site", "core", F.inline("found")), "carried")
    counts = carried.select("site", "run", "core").distinct().groupBy("site", "run").agg(F.count(F.lit(1)).alias("carriers"))
    shared = written(counts.join(sizes, "site").filter(F.col("carriers") >= F.col("need")).select("run", "carriers"), "shared")
    longest = join_groups(carried.select("key", "side", "words", "run"), shared, "run", "carriers", carried.count())
    cuts = _sides(longest).withColumns({"part": F.substring("key", 33, 1).cast("int"), "key": F.substring("key", 1, 32)})
    cuts = written(cuts.groupBy("key").agg(F.collect_list(F.struct("part", "head", "tail")).alias("cuts")), "cuts")

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for held, cut in zip(*(c.to_pylist() for c in batch.columns[2:])):
                gone = {c["part"]: (c["head"], c["tail"]) for c in cut or ()}
                lines = []
                # the main part comes first among the streams, but second in the page
                for h in sorted(held, key=lambda h: (1, 0, 2)[h["part"]]):
                    head, tail = gone.get(h["part"], (0, 0))
                    if head + tail and (h["part"] or 2 * (head + tail) <= h["words"]):
                        lines += without([block.split(" ") for block in h["text"].split("\n\n")], head, tail)
                    else:
                        lines.append(h["text"])
                out.append("\n\n".join(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=["id", "url", "text"])

    out = texts.join(cuts, "key", "left").select("id", "url", "streams", "cuts").mapInArrow(finish, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")

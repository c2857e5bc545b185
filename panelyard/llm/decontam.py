"""Benchmark passages in documents, also with other numbers, names or units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from panelyard.llm.common import whole_text, written

#: Template words of a window, and how many literal words a stretch needs whose slots differ.
WIDTH, LITERALS = 8, 5
#: Share of an item's windows that make a document contaminated.
SHARE = 0.5
#: Matching template words in a row that do so too, single changed words between them aside, and the words around a window that are looked at.
ROW, AROUND = 13, 10
#: Bits of the map of window hashes that tasks hold: 2 MB, whatever the benchmark holds.
MAP_BITS = 24
_KEPT = 200_000

#: Words that stand for a quantity's unit.
UNITS = frozenset(
    "mm cm m km inch inches feet foot ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz "
    "ml l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours hr day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kmh mph watt watts volt volts joule joules".split()
)
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
_QUANTITY = re.compile(r"([+-]?\d+(?:[.,]\d+)*)([a-zµ°%]+)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: A passage that more items than this hold, whose templates differ, is a common one: by itself it does not make a leak.
FEW = 3
NUM, UNIT, NAME, QUANTITY = (np.uint64(8 * k) for k in (1, 2, 3, 4))
_CAPITAL, _ENDS, _HASH = np.uint64(1), np.uint64(2), (1 << 64) - 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE, _MIX = pow(_BASE, -1, 1 << 64), np.uint64(0xD6E8FEB86659FD93)


def core(chunk: str) -> str:
    """The chunk without signs around it, lower-cased."""
    bare = chunk.strip(_SIGNS)
    return (bare if bare.isalnum() else _EDGE.sub("", chunk)).lower()


class _Codes(dict):
    """Chunk -> code: 0 for no word, else kind or word hash with marks for a capital and a sentence end."""

    def __missing__(self, chunk: str) -> int:
        letters = chunk.isalpha()
        bare = chunk if letters else chunk.strip(_SIGNS)
        if letters or bare.isalpha():  # most words; the other cases need patterns
            word = bare.lower()
            if word in UNITS:
                code = int(UNIT)
            else:
                code = xxh3_64_intdigest(word) & _HASH | 1 << 63
                if word != bare and bare[0].isupper() and bare[1:].islower():
                    code |= 1
            if not letters and (chunk[-1] in ".!?:;" or chunk[-2:-1] in (".", "!", "?")):
                code |= 2
        else:
            code = self._other(chunk)
        if len(self) >= _KEPT:
            self.clear()
        if len(chunk) <= 48:
            self[chunk] = code
        return code

    def _other(self, chunk: str) -> int:
        word = core(chunk)
        if not word:
            code = 0
        else:
            if _NUMBER.fullmatch(word):
                code = int(NUM)
            elif word in UNITS:
                code = int(UNIT)
            elif (q := _QUANTITY.fullmatch(word)) and (q[2] in UNITS or q[2] in "%°"):
                code = int(QUANTITY)
            else:
                code = xxh3_64_intdigest(word) & _HASH | 1 << 63
                bare = _EDGE.sub("", chunk)
                code |= int(bare[0].isupper() and bare[1:].islower())
            code |= int(_ENDS) * (chunk[-1] in ".!?:;" or chunk[-2:-1] in (".", "!", "?"))
        return code


_codes = _Codes()


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Template words, which of them are names, which may be names at a sentence start, and the chunks they come from.

    Numbers, units and quantities are typed placeholders. A capital letter
    before small ones inside a sentence makes a name; at its start it may. Names
    keep their word here, so that all readings can be tried.
    """
    chunks = text.split()
    code = np.fromiter(map(_codes.__getitem__, chunks), dtype=np.uint64, count=len(chunks))
    keep = code != 0
    if not keep.all():
        chunks = [chunks[i] for i in np.flatnonzero(keep)]
        code = code[keep]
    starts = np.concatenate([[True], (code[:-1] & _ENDS) != 0]) if len(code) else keep
    capital = (code & _CAPITAL) != 0
    return code & ~np.uint64(7), capital & ~starts, capital & starts, chunks


def readings(words: np.ndarray, names: np.ndarray, heads: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes): all windows with names as words, those that hold a name with names as slots, those that hold a sentence's capital with that as slot too."""
    n = len(words) - width + 1
    if n < 1:
        return
    yield np.arange(n), window_hashes(words, width)
    for asked, slots in ((names, names), (heads, names | heads)):
        if asked.any():
            total = np.concatenate([[0], np.cumsum(asked)])
            at = np.flatnonzero(total[width:] > total[:-width])
            yield at, window_hashes(np.where(slots, NAME, words), width, at)


_powers = [np.ones(1, dtype=np.uint64)] * 2


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def window_hashes(words: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows, or of those at these places: a polynomial in an odd base modulo 2**64, so a window is a difference of two prefix sums."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers_to(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * down[:n] if at is None else (sums[at + width] - sums[at]) * down[at]
    out += np.uint64(width)
    out ^= out >> np.uint64(29)
    return out * _MIX


def _cells(start: int, end: int, words: np.ndarray, capital: np.ndarray, chunks: list[str]) -> list[str]:
    """The words of these places behind a sign of their kind: a digit for slots, n for capitals, w for others; empty outside the text."""
    out = []
    for i in range(start, end):
        if not 0 <= i < len(chunks):
            out.append("")
            continue
        kind = str(int(words[i]) >> 3) if words[i] < 64 else "n" if capital[i] else "w"
        out.append(kind + core(chunks[i]))
    return out


WINDOWS = "id long, at int, width int, hash long, cells array<string>, windows int"


def _windows(rows: DataFrame, width: int, shared=None, widths: tuple[int, ...] = ()) -> DataFrame:
    """Windows of (id, text) rows: all of benchmark items, else those whose hash is in the map."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, names, heads, chunks = template(text)
                for w in widths or (min(width, len(words)),):
                    for at, found in readings(words, names, heads, w) if w else ():
                        if shared is not None:
                            asked = _held(shared.value, found)
                            at, found = at[asked], found[asked]
                        for p, h in zip(at.tolist(), found.astype(np.int64).tolist()):
                            out.append((i, p, w, h, _cells(p - AROUND, p + w + AROUND, words, names | heads, chunks), len(words) - w + 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return rows.mapInArrow(cut, WINDOWS)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - MAP_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _hash_map(windows: DataFrame) -> np.ndarray:
    """One bit per slot of the hash space, 2**MAP_BITS of them."""
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    cells = windows.select(F.shiftrightunsigned(slot, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))").alias("bit"))
    table = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, dtype=np.uint64)
    bits[table["cell"].to_numpy()] = table["bits"].to_numpy().astype(np.uint64)
    return bits


def _same(a: str, b: str) -> bool:
    """Whether two cells hold one template word: the same word, or slots of one kind."""
    return a[1:] == b[1:] if a[0] in "nw" and b[0] in "nw" and a[1:] == b[1:] else a[0] == b[0] != "w"


def _joined(old: dict[str, str], pairs: list[tuple[str, str]]) -> dict[str, str] | None:
    """The mapping of item slots to document slots with these pairs, or nothing where one value would become two."""
    new = dict(old)
    return new if all(new.setdefault(a, b) == b for a, b in pairs) else None


class Stretch:
    """Windows of one diagonal in a row whose slot values map from item to document as a function."""

    def __init__(self) -> None:
        self.pairs: dict[str, str] = {}
        self.cells: dict[int, tuple[str, str]] = {}
        self.equal: dict[int, bool] = {}
        self.around: dict[int, tuple[str, str]] = {}

    def fits(self, at: int) -> bool:
        a, b = self.around.get(at, ("", ""))
        return bool(a and b) and _same(a, b) and (a[0] == "w" or b[0] == "w" or self.pairs.get(a, b) == b)

    def rows(self, width: int, words: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, matching words) of the runs of windows that count, grown over matching words and single changed ones.

        Behind a changed word two words must match, or one at the item's end.
        With few literal words, slots must be equal and no word changed.
        """
        places = sorted(at for at, _ in self.hits())
        for k, start in enumerate(places):
            if k and places[k - 1] + width >= start:
                continue
            ends, matched, first = [], set(), start
            for step, at in ((-1, start - 1), (1, start)):
                last = at - step
                while 0 <= at < words:
                    after = [x for x in (at + step, at + 2 * step) if 0 <= x < words]
                    if self.fits(at):
                        matched.add(at)
                        last = at
                    elif at - step != last or not after or not all(map(self.fits, after)):
                        break
                    at += step
                ends.append(last)
            equal = [x for x in sorted(matched) if self.around[x][0][1:] == self.around[x][1][1:]]
            if sum(self.around[x][0][0] in "nw" for x in equal) >= LITERALS:
                yield ends[0], ends[1] + 1, len(matched)
                continue
            for at, x in enumerate(equal):
                first = first if at and equal[at - 1] == x - 1 else x
                if equal[at + 1 : at + 2] != [x + 1]:
                    yield first, x + 1, x + 1 - first

    def literals(self) -> int:
        return sum(a[0] in "nw" and a[1:] == b[1:] for a, b in self.cells.values())

    def hits(self) -> list[tuple[int, bool]]:
        """Place of each window that counts, and whether its slots are equal; they must be where the stretch has few literal words."""
        enough = self.literals() >= LITERALS
        return [(at, equal) for at, equal in self.equal.items() if enough or equal]


def stretches(met: list[tuple[int, list[str], list[str]]]) -> list[Stretch]:
    """Cuts the windows (place, item cells, document cells, each with those around) of a diagonal where a slot value becomes another one.

    A window that is inconsistent by itself is no hit.
    """
    out: list[Stretch] = []
    for at, item, doc in sorted({at: (at, item, doc) for at, item, doc in met}.values()):
        around = {at - AROUND + k: c for k, c in enumerate(zip(item, doc))}
        both = list(zip(item, doc))[AROUND:-AROUND]
        pairs = [(a, b) for a, b in both if a[0] != "w" and b[0] != "w"]
        own = _joined({}, pairs)
        if own is None or not all(_same(a, b) for a, b in both):
            continue
        pairs_now = _joined(out[-1].pairs, pairs) if out else None
        if pairs_now is None:
            out.append(Stretch())
            pairs_now = own
        out[-1].pairs = pairs_now
        out[-1].cells |= {at + k: c for k, c in enumerate(both)}
        out[-1].around |= around
        out[-1].equal[at] = all(a[1:] == b[1:] for a, b in both)
    return out


def _judged(row: int):
    """Adds hits, and start and end in item places of rows long enough: ``row`` words, or all but one of a shorter item, with a window that few items hold."""

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("at", pa.int32()), ("equal", pa.bool_()), ("rare", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            found = []
            for windows, width, met in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
                words, out = windows + width - 1, []
                rare = {m["at"] for m in met if m["rare"]}
                for part in stretches([(m["at"], m["item_cells"], m["doc_cells"]) for m in met]):
                    hits = part.hits()
                    own = [at for at, _ in hits if at in rare]
                    long = [(x, y) for x, y, n in part.rows(width, words) if n >= min(row, max(width, words - 1)) and any(x <= at < y for at in own)]
                    for at, equal in hits:
                        first, last = next(((x, y) for x, y in long if x <= at < y), (None, None))
                        out.append({"at": at, "equal": equal, "rare": at in rare, "first": first, "last": last})
                found.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, kind)], names=["doc", "item", "diagonal", "windows", "width", "hits"])

    return judge


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    row: int = ROW, few: int = FEW,
) -> DataFrame:
    """One row per document and benchmark item it holds: hits, windows, start and end in words.

    Texts become templates; windows of ``width`` template words of a document
    meet those of the items by hash. Tasks first ask a bit map of fixed size,
    so only windows that may match are shuffled. On each diagonal (document
    place less item place) an item's slot value must stay one value of the
    document; where it becomes another, a new stretch begins. In stretches with
    few literal words in all only windows with equal slots count. Names, also
    those that begin a sentence, are read both as slots and as words. A document
    holds an item when ``share`` of the item's windows are hit, or when ``row``
    template words in a row match, all but one of a shorter item, with single
    changed words between them. A window is common when more than ``few``
    items of different templates hold it, like the instruction that many
    questions begin with; both rules ask for a window that is not, unless all
    windows of the item are hit.

    An item of fewer than ``width`` words is one window of all its words and,
    with fewer literal words than asked, must agree in its slots. Null, empty
    and wordless texts hold nothing and are never held. Repeated ids count as
    one document; rows with a null id are ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), whole_text(item_text).alias("text")).filter("id is not null").dropDuplicates()
    wanted = written(_windows(items, width), "items")
    # at most ``width`` different widths
    widths = tuple(sorted(r["width"] for r in wanted.select("width").distinct().collect()))
    shared = docs.sparkSession.sparkContext.broadcast(_hash_map(wanted))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).filter("id is not null")
    if not widths:
        return _empty(docs, id_col, item_col)
    found = written(_windows(rows, width, shared, widths), "found")
    d = found.select(F.col("id").alias("doc"), F.col("at").alias("doc_at"), "hash", "width", F.col("cells").alias("doc_cells"))
    marked = written(wanted.join(_rare(wanted, few), ["hash", "width"]), "marked")
    i = marked.select(F.col("id").alias("item"), "at", "hash", "width", F.col("cells").alias("item_cells"), "windows", "rare")
    met = d.join(i, ["hash", "width"]).withColumn("diagonal", F.col("doc_at") - F.col("at"))
    # a diagonal meets each window of the item once in each reading, so its lists are no longer than the item
    line = met.groupBy("doc", "item", "diagonal", "windows", "width").agg(F.collect_list(F.struct("at", "item_cells", "doc_cells", "rare")).alias("met"))
    kinds = "doc long, item long, diagonal int, windows int, width int, hits array<struct<at:int,equal:boolean,rare:boolean,first:int,last:int>>"
    hits = written(line.mapInArrow(_judged(row), kinds), "hits").withColumn("h", F.explode("hits"))
    once = hits.groupBy("doc", "item", "windows", "width", F.col("h.at").alias("at")).agg(
        F.min(F.col("diagonal") + F.coalesce("h.first", "h.at")).alias("first"),
        F.max(F.col("diagonal") + F.coalesce(F.col("h.last"), F.col("h.at") + F.col("width"))).alias("last"),
        F.max(F.col("h.equal")).alias("equal"), F.max(F.col("h.rare")).alias("rare"), F.max(F.col("h.first").isNotNull()).alias("long"),
    )
    out = once.groupBy("doc", "item", "windows").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("equal").cast("long")).alias("equal_hits"), F.min("first").alias("start"), F.max("last").alias("end"), F.max("long").alias("long"), F.max("rare").alias("rare")
    )
    whole = F.col("hits") >= F.col("windows")
    out = out.filter((F.col("hits") >= share * F.col("windows")) & (F.col("rare") | whole) | F.col("long"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "hits", "equal_hits", F.col("windows").cast("long").alias("windows"), "start", "end")


def _rare(windows: DataFrame, few: int) -> DataFrame:
    """(hash, width, rare) of the items' windows; items that hold the same windows count once."""
    print_of = windows.groupBy("id").agg(F.xxhash64(F.sort_array(F.collect_set("hash"))).alias("print"))
    return windows.join(print_of, "id").groupBy("hash", "width").agg((F.count_distinct("print") <= few).alias("rare"))


def _empty(docs: DataFrame, id_col: str, item_col: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"{id_col} long, {item_col} long, hits long, equal_hits long, windows long, start int, end int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns that hold no benchmark item; rows with a null id stay."""
    gone = written(leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("_gone")).distinct(), "leaks")
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")

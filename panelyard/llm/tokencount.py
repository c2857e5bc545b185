"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import CACHE_CHARS, CACHE_ENTRIES, whole_text

_MARK = "▁"
_UNIT = re.compile(" ( *[^ ]*)")


class WholeTokens(dict):
    """Costs in tokens of the units of a text.

    A unit is a run of blanks with the word behind it; it is named without its
    first blank, since the library puts one before every text. When no
    vocabulary string holds a blank behind another letter, no merge crosses
    units, so the tokens of a text are the sum over its units. ``proven`` holds
    the units that are one token: every vocabulary string is encoded alone once
    and kept when it comes back as itself. Other units are merged by the
    library; their costs are kept in a bounded table.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        plain = rules.name == "identity" and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        words = [(i, p.piece) for i, p in enumerate(spec.pieces) if p.type in (1, 4)]
        inner = any(_MARK in word.lstrip(_MARK) for _, word in words)
        special = any(p.type == 4 for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix
        self.separate = plain and not inner and not special and spec.trainer_spec.model_type == 2
        self.proven = {}
        if self.separate:
            alone = [(i, word[1:].replace(_MARK, " ")) for i, word in words if word.startswith(_MARK) and word != _MARK]
            for (i, unit), ids in zip(alone, self.library.encode([u for _, u in alone], num_threads=1)):
                if ids == [i]:
                    self.proven[unit] = 1
            # one blank at the end of a text
            self.proven[""] = len(self.library.encode("a ")) - len(self.library.encode("a"))
            self.update(self.proven)

    def __missing__(self, unit: str) -> int:
        n = len(self.library.encode(unit))
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.proven)
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separate:
            return len(self.library.encode(text))
        if _MARK in text:  # the vocabulary writes blanks with this sign
            text = text.replace(_MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            units = _UNIT.findall(" " + text)
        else:
            units = text.split(" ")
        return sum(map(self.__getitem__, units))


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_bytes`` and ``n_tokens`` of every row's whole text.

    Null and empty texts have 0 of both. Every row gives one row, also repeated
    ids; other columns are ignored. ``model`` is the path of a sentencepiece
    file that all executors have.
    """

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = whole_tokens(model)
        for batch in batches:
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)

"""Token counts of whole texts with a SentencePiece model: encode in Arrow batches, return lengths only.

A text is cut at its safe boundaries: a single space between two characters that are neither white space nor the
word-start mark U+2581 itself. The model turns such a space into that mark, no piece has it after another character,
and the model puts the same mark before the first word; so the counts of the parts add up to the count of the text.
This holds for any model that adds the mark before a text, normalises nothing else and has no piece with an inner
mark; ``check_model`` reads this from the model and refuses others. Parts are counted once each and kept in a bounded memo; new parts go to the library in
batches balanced by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_texts, safe_parts

#: Parts that a Python worker remembers at most; beyond that it starts anew.
MEMO_PARTS = 300_000
#: Longer parts are counted but not remembered.
MEMO_CHARS = 48
_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def check_model(processor) -> None:
    """Raise ValueError if texts can't be cut at single spaces with this model."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {i} has an inner word mark: {piece!r}")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(processor.serialized_model_proto())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError(f"the model changes texts by its normalisation ({rules.name})")
    if not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model does not start each text as it starts a word")


MARKED_SPACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def parts_of(text: str) -> list[str]:
    """``text`` cut at its safe boundaries."""
    return MARKED_SPACE.split(text) if "▁" in text else safe_parts(text)


def make_counter(model_path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; one for each worker process."""
    if model_path in _counters:
        return _counters[model_path]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
    check_model(processor)
    memo: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        cut = [parts_of(t) for t in texts]
        new = list(set().union(*cut).difference(memo))
        if len(memo) + len(new) > MEMO_PARTS:
            memo.clear()
            new = list(set().union(*cut))
        for a, b in by_bytes(new):
            memo.update(zip(new[a:b], map(len, processor.encode(new[a:b], num_threads=1)), strict=True))
        counts = [sum(map(memo.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return counts

    _counters[model_path] = count
    return count


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Columns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each row of ``docs``.

    No begin, end or other special tokens are added; special strings inside texts are ordinary text, as is the
    library's default. Null text counts as empty: 0 tokens. Rows with a null or repeated id keep a row each.
    Extra columns are ignored. An empty table gives an empty result.
    """

    def make():
        count = make_counter(model_path)
        return lambda texts: [[len(t.encode()) for t in texts], count(texts)]

    counted = map_texts(docs, text_col, "n_bytes long, n_tokens long", make, [id_col])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Token counts: batch encoding in an Arrow function that returns lengths only.

The tokenizer never sees a whole batch of unknown size. Texts are cut at safe boundaries (a space between two other
characters, where no piece of the vocabulary can reach across), the pieces are gathered into encoder calls of about
equal bytes, and only the number of tokens of each text goes back to Spark, so neither ids nor pieces leave the worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import whole_text

CALL_CHARS = 1 << 18  # characters of one encoder call
PIECE_CHARS = 1 << 12  # texts longer than this are cut at safe boundaries


def locate(model: str) -> str:
    """A path is taken as it is; a bare file name is looked up among the installed public vocabularies of the worker."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def cuts_before_space(pieces: list[str]) -> bool:
    """Whether no vocabulary piece holds a space mark after another character: a cut before a word then loses no merge."""
    return not any("▁" in p.lstrip("▁") for p in pieces)


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Cut a text so that the tokens of the pieces are the tokens of the text.

    A cut swallows one space that stands between two characters other than a space or the space mark: the encoder puts
    the mark that stood for this space in front of the next piece by itself. A stretch without such a place stays whole.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = text.find(" ", at + size)
        while cut != -1 and (cut + 1 >= n or text[cut - 1] in " ▁" or text[cut + 1] in " ▁"):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def piece_lengths(model: str) -> Callable[[list[str]], list[int]]:
    """Encoder of the vocabulary file: texts to numbers of tokens, without special tokens, padding or truncation."""
    path = locate(model)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def can_cut(model: str) -> bool:
    """Only vocabularies that prove it are cut; the others encode every text whole."""
    path = locate(model)
    if not path.endswith(".model"):
        return False
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = sp.encode("a b", out_type=str) == sp.encode("a", out_type=str) + sp.encode("b", out_type=str)
    return plain and cuts_before_space([sp.id_to_piece(i) for i in range(sp.get_piece_size())])


def count_batch(texts: list[str], lengths: Callable[[list[str]], list[int]], cut: bool, piece: int = PIECE_CHARS, call: int = CALL_CHARS) -> list[int]:
    totals, pieces, owner, held = [0] * len(texts), [], [], 0

    def flush():
        nonlocal held
        for i, n in zip(owner, lengths(pieces)):
            totals[i] += n
        pieces.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in safe_pieces(text, piece) if cut else (text,):
            pieces.append(part)
            owner.append(i)
            held += len(part)
            if held >= call:
                flush()
    if pieces:
        flush()
    return totals


def token_length(text: Column, model: str, piece: int = PIECE_CHARS, call: int = CALL_CHARS) -> Column:
    """Number of tokens of each text as a column; NULL counts as empty."""

    @F.arrow_udf("long")
    def lengths_only(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths, cut = piece_lengths(model), can_cut(model)
        for batch in batches:
            out: list[int] = []
            for start in range(0, len(batch), 256):  # Python strings of a few rows at a time
                out += count_batch(batch.slice(start, 256).to_pylist(), lengths, cut, piece, call)
            yield pa.array(out, pa.int64())

    return lengths_only(whole_text(text))


def token_counts(docs: DataFrame, model: str, limit: int, text: str = "text", piece: int = PIECE_CHARS, call: int = CALL_CHARS) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens); one row in, one row out.

    NULL and empty texts have 0 bytes and the tokens of an empty text. Repeated rows are counted each by itself; an
    empty table gives an empty table; other columns pass through (a column with one of the three names is replaced).
    """
    whole = whole_text(text)
    counted = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_length(F.col(text), model, piece, call)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""Token counts without token ids.

A text is cut before each run of white space that follows something else.  For byte-level BPE no pre-token crosses
such a cut, so each piece is made of whole pre-tokens and its token count does not depend on its neighbours.  Pieces
are counted once per distinct piece; a document's count is the sum over its piece frequencies.

Within a task, the distinct pieces of each group of documents are counted once and joined to the documents' piece
frequencies.  Counts of short pieces are remembered for the groups that follow (one table for each Python worker,
emptied at ``cache_pieces`` of them), so neither the pieces of all documents nor any ids are ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

PIECE = re.compile(r"\s*\S+|\s+")
#: White space for Python only: such texts are not cut.
ODD = re.compile(r"[\x1c-\x1f]")
#: Documents whose pieces are counted together, pieces sent to the library at once, characters of a remembered piece.
GROUP = 256
SENT = 4096
SHORT = 64
_loaded: dict = {}


def load(name: str):
    """The tokenizer of a ``.json`` vocabulary file given by name or path; kept for the worker's life."""
    if name not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if os.path.sep not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        else:
            path = name
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[name] = (tok, {})
    return _loaded[name]


def pieces_of(text: str, specials: tuple[str, ...]) -> list[str]:
    """Parts of a text that can be tokenized on their own."""
    if ODD.search(text) or any(s in text for s in specials):
        return [text]
    return PIECE.findall(text)


def count_tokens(texts: list[str], name: str, cache_pieces: int) -> list[int]:
    tok, known = load(name)
    specials = tuple(x.content for x in tok.get_added_tokens_decoder().values())
    out: list[int] = []
    for at in range(0, len(texts), GROUP):
        freqs = [Counter(pieces_of(x, specials)) for x in texts[at : at + GROUP]]
        new = list({p for f in freqs for p in f if p not in known})
        long_: list[str] = []
        for i in range(0, len(new), SENT):
            part = new[i : i + SENT]
            known.update((p, len(e)) for p, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)))
            long_ += [p for p in part if len(p) > SHORT]
        out += [sum(map(int.__mul__, map(known.__getitem__, f), f.values())) for f in freqs]
        for p in long_:
            del known[p]
        if len(known) > cache_pieces:
            known.clear()
    return out


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, cache_pieces: int = 400_000
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have none; special strings inside texts count as the library has them by default.  Repeated
    rows and ids keep a row each, null ids stay null, other columns are left out.  An empty table gives no rows.  Very long
    texts are counted whole; one with a special string is a single piece.
    """

    def run(values: pa.Array) -> list[pa.Array]:
        texts = [x or "" for x in values.to_pylist()]
        return [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(count_tokens(texts, tokenizer, cache_pieces), pa.int64())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return append_columns(df, text_col, fields, run, [id_col]).withColumn("over_limit", F.col("n_tokens") > limit)

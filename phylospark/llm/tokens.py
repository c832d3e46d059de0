"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read once by the driver and sent to the executors, which need the tokenizer's library but not its files.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


def pattern_of(folder: str) -> str | None:
    """The pattern by which texts are cut for the .tiktoken vocabularies of a folder: what its __init__.py assigns to PATTERN, read without running it."""
    import ast

    path = os.path.join(folder, "__init__.py")
    if not os.path.exists(path):
        return None
    with open(path) as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and any(getattr(t, "id", None) == "PATTERN" for t in node.targets):
                return ast.literal_eval(node.value)
    return None


def encoder(name: str, data: bytes, pattern: str | None) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to their lists of token ids."""
    if name.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(x) for x in texts]
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: sp.encode(list(texts), num_threads=1)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(data.decode())
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch(list(texts), add_special_tokens=False)]


#: By the broadcast's number, the encoder of this Python worker.
_encoders: dict[int, Callable[[list[str]], list[list[int]]]] = {}


def _of(known: Broadcast) -> Callable[[list[str]], list[list[int]]]:
    key = hash(known.value[:2])
    if key not in _encoders:
        _encoders.clear()
        name, pattern, data = known.value
        _encoders[key] = encoder(name, data, pattern)
    return _encoders[key]


def token_count(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """Number of tokens of each text, 0 for empty ones, null for null. Only the driver reads the folder."""
    with open(os.path.join(folder, name), "rb") as f:
        data = f.read()
    known = SparkSession.active().sparkContext.broadcast((f"{folder}/{name}", pattern_of(folder), data))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        some = texts.notna().to_numpy()
        n = np.zeros(len(texts), dtype=np.int64)
        n[some] = [len(x) for x in _of(known)(texts[some].tolist())]
        return pd.Series(pd.arrays.IntegerArray(n, ~some))

    return count(text)

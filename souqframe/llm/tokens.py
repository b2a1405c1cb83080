"""Document sizes in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter everywhere, never copied.
TOKENIZER_DIR = os.environ.get("SOUQFRAME_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def with_token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, batch_chars: int = 1 << 20) -> DataFrame:
    """``keep`` columns and ``n_tokens``; NULL and empty texts have 0 tokens. Whole texts are encoded."""
    path = f"{tokenizer_dir}/{vocabulary}"
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for b in batches:
            texts, sizes, run, chars = b["_text"].fillna("").tolist(), [], [], 0
            for t in texts:
                run.append(t)
                chars += len(t)
                if chars > batch_chars:
                    sizes += [len(e.ids) for e in tok.encode_batch_fast(run, add_special_tokens=False)]
                    run, chars = [], 0
            if run:
                sizes += [len(e.ids) for e in tok.encode_batch_fast(run, add_special_tokens=False)]
            yield b.drop(columns="_text").assign(n_tokens=sizes)

    src = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*src.drop("_text").schema.fields, T.StructField("n_tokens", T.LongType())])
    return src.mapInPandas(count, schema)

"""Texts packed into sequences of one fixed token capacity.

Method: cost-balanced packing. A text of n tokens costs `LINEAR * n + QUADRATIC * n * n`, as attention does. Texts in
descending order go to the sequence of lowest cost that has room left. A text longer than the capacity is cut into
full sequences and a rest that is packed like any other text; no other text is split.

Texts are dealt to shards by a hash, each shard with about `SHARD_TOKENS` tokens whatever the size of the collection,
and every shard is packed by one task on its own. The number of sequences of a shard is what its tokens need; only a
text that fits nowhere opens another one. The space lost to shards is under one sequence a shard.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut, ship, spread

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens of a shard, so a task holds about this many tokens' worth of (id, length) rows.
SHARD_TOKENS = 4_000_000
#: Where the public vocabularies lie.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """Text -> number of tokens, by the vocabulary file at `path` (.tiktoken ranks, .json, or a sentencepiece .model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(own.encode_ordinary(t))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False))
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(piece.encode(t, num_threads=1))


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """`doc_id, n_tokens` of every row; null and empty texts have 0."""
    rows = df.select(F.col(doc_id).alias("__d"), F.col(text).alias("__t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = counter(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({doc_id: pdf["__d"], "n_tokens": np.fromiter((size(t) if t else 0 for t in pdf["__t"]), np.int64, len(pdf))})

    return spread(rows).mapInPandas(count, f"`{doc_id}` {rows.schema['__d'].dataType.simpleString()}, n_tokens long")


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each text, all lengths between 1 and `capacity` and in descending order."""
    n = len(lengths)
    where = np.zeros(n, np.int64)
    if not n:
        return where
    open_ = max(1, -(-int(lengths.sum()) // capacity))
    cost, room = np.zeros(2 * open_ + 64), np.zeros(2 * open_ + 64, np.int64)
    room[:open_] = capacity
    for i, size in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(room[:open_] >= size, cost[:open_], np.inf)))
        if room[at] < size:
            if open_ == len(cost):
                cost, room = (np.concatenate([a, np.zeros(len(a), a.dtype)]) for a in (cost, room))
            at = open_
            room[at] = capacity
            open_ += 1
        where[i] = at
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return where


def pack_texts(sizes: DataFrame, doc_id: str, n_tokens: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """`doc_id, piece, token_start, n_tokens, sequence_id, slot`: where each text, or each piece of an over-long one, goes.

    `piece` counts from 0; `token_start` is the piece's first token in its text; `slot` is its place in the sequence.
    Texts without tokens (0 or null) take no room and are left out. Rows that share an id are packed as several texts.
    An empty table gives no rows.
    """
    ship(sizes.sparkSession)
    rows = sizes.select(F.col(doc_id).alias("__d"), F.col(n_tokens).cast("long").alias("__n")).where(F.col("__n") > 0)
    total = rows.agg(F.sum("__n").alias("t")).first()["t"] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    whole = rows.select("__d", F.explode(F.sequence(F.lit(0), ((F.col("__n") - 1) / capacity).cast("int"))).alias("piece"), "__n")
    pieces = whole.select("__d", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("__n") - F.col("piece").cast("long") * capacity).alias("n_tokens"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("__d", "piece"), F.lit(shards)).cast("int"))
    d_type = rows.schema["__d"].dataType.simpleString()

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "__d", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        n = pdf["n_tokens"].to_numpy()
        full = n == capacity
        where = np.zeros(len(n), np.int64)
        where[full] = np.arange(full.sum())
        where[~full] = full.sum() + assign(n[~full], capacity, linear, quadratic)
        slot = pd.Series(where).groupby(where).cumcount()
        return pd.DataFrame({doc_id: pdf["__d"], "piece": pdf["piece"], "token_start": pdf["token_start"], "n_tokens": n, "sequence_id": where * shards + int(key[0]), "slot": slot.astype(np.int32)})

    return dealt.groupBy("shard").applyInPandas(pack, f"`{doc_id}` {d_type}, piece int, token_start long, n_tokens long, sequence_id long, slot int")


def pack_documents(df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Texts sized in tokens of a public tokenizer and packed; see `pack_texts`. Sizes are computed once and kept in the checkpoint folder."""
    return pack_texts(cut(token_counts(df, doc_id, text, tokenizer)), doc_id, "n_tokens", capacity, shard_tokens)


def sequence_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`n_sequences, n_pieces, used_tokens, fill, max_tokens` of a packing, one row; zeros for an empty one."""
    per = packed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("p"))
    return per.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("used_tokens"),
        F.coalesce(F.sum("t") / (F.count(F.lit(1)) * F.lit(float(capacity))), F.lit(0.0)).alias("fill"),
        F.coalesce(F.max("t"), F.lit(0)).alias("max_tokens"),
    )

"""Byte-level BPE over overlapping chunks.

A document is cut into chunks that overlap.  Chunks are pre-tokenised and encoded in parallel, each
from its own start, so the first pre-tokens of a chunk may be wrong.  Neighbours are stitched at the
first character offset where both put a pre-token boundary: the pattern looks at nothing before a
match, so two scans that share one boundary agree from there on.  Every overlap reaches past a letter
that is followed by another kind of character; every scan breaks after such a letter, so a shared
boundary always exists, and a run without one stays within one chunk.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import MEMORIES, id_text, mapped

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from one chunk start to the next, and characters that neighbours share at least.
STRIDE, OVERLAP = 32_768, 512
#: Characters after a pre-token that may still decide it ('re needs two, white space one).
LOOKAHEAD = 3
#: Pieces remembered by a Python worker; a full memory starts anew.
MEMORY = 60_000

_PATTERN = regex.compile(public_tokenizers.PATTERN)
_BREAK = regex.compile(r"\p{L}(?=\P{L})")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pieces(dict):
    """Token ids of a pre-token as little-endian 32-bit bytes, merged on first use."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        # One match for the whole input: a pre-token is never split again.
        self.merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(path), special_tokens={})
        MEMORIES.append(self)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = np.array(self.merger.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PATTERN.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return tokens_of(self.path).decode(ids)


class Tokens(list):
    """The bytes of every token, by rank."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        super().__init__([b""] * (max(ranks.values()) + 1))
        for token, rank in ranks.items():
            self[rank] = token
        self.lengths = np.array([len(t) for t in self], dtype=np.int64)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def chunks_of(text: str, stride: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk; an end reaches past a certain break behind the next start."""
    out, start = [], 0
    while True:
        following = start + stride
        sure = _BREAK.search(text, following) if following < len(text) else None
        end = max(following + overlap, sure.end() + LOOKAHEAD) if sure else len(text)
        out.append((start, min(end, len(text))))
        if end >= len(text):
            return out
        start = following


def encoded_chunk(codec: Pieces, text: str, start: int, prev_end: int, next_start: int, last: bool) -> tuple:
    """Ids of one chunk, and (character offset, tokens before it) of its boundaries within both overlaps."""
    found = _PATTERN.findall(text)
    ids = [codec[p] for p in found]
    at = start + np.concatenate([[0], np.cumsum([len(p) for p in found], dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
    head = at <= prev_end
    tail = (at >= next_start) & (at <= start + len(text) - LOOKAHEAD) & (not last)
    return b"".join(ids), at[head].tolist(), before[head].tolist(), at[tail].tolist(), before[tail].tolist()


def stitched(parts: list[dict]) -> bytes:
    """Ids of a document from its chunks in order."""
    out, cut = [], 0
    for here, following in zip(parts, [*parts[1:], None]):
        if following is None:
            out.append(here["ids"][4 * cut:])
            break
        heads = following["head_at"]
        for offset, before in zip(here["tail_at"], here["tail_before"]):
            i = bisect_left(heads, offset)
            if i < len(heads) and heads[i] == offset:
                out.append(here["ids"][4 * cut:4 * before])
                cut = following["head_before"][i]
                break
        else:
            raise ValueError("neighbouring chunks share no boundary")
    return b"".join(out)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian 32-bit) of every row of ``docs``.

    A null text counts as empty and gives no ids.  Repeated rows and ids give a row each; other
    columns are ignored.  A text within one chunk is encoded where it is read; only the chunks of longer
    ones are dealt out, a row each, and meet again as ids.  ``path`` must exist on every executor.
    """
    path, schema = path or public_tokenizers.path(DEFAULT_RANKS), "doc_id long, n_tokens int, ids binary"
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def whole(cols: dict[str, list]) -> Iterator[tuple]:
        codec = pieces_of(path)
        for doc, text in zip(cols["doc_id"], cols["text"]):
            ids = codec.encode(text)
            yield doc, len(ids) // 4, ids

    def split(cols: dict[str, list]) -> Iterator[tuple]:
        for doc, tag, text in zip(cols["doc_id"], cols["tag"], cols["text"]):
            spans = chunks_of(text, stride, overlap)
            for k, (lo, hi) in enumerate(spans):
                yield doc, tag, k, lo, spans[k - 1][1] if k else 0, lo + stride, k == len(spans) - 1, text[lo:hi]

    def chunk(cols: dict[str, list]) -> Iterator[tuple]:
        codec = pieces_of(path)
        for doc, tag, k, lo, prev_end, next_start, last, text in zip(*cols.values()):
            yield (doc, tag, k, *encoded_chunk(codec, text, lo, prev_end, next_start, last))

    def join(cols: dict[str, list]) -> Iterator[tuple]:
        for doc, times, parts in zip(cols["doc_id"], cols["times"], cols["parts"]):
            ids = stitched(parts)
            for _ in range(times):
                yield doc, len(ids) // 4, ids

    long = F.length("text") > stride + overlap
    short = mapped(texts.where(~long), whole, schema)
    pieces = mapped(texts.where(long).select("doc_id", F.sha2("text", 256).alias("tag"), "text"), split,
                    "doc_id long, tag string, chunk int, start long, prev_end long, next_start long, last boolean, text string")
    # A chunk is a task's worth of work by itself: dealt by its own key, not by the document.
    encoded = mapped(pieces.repartition(F.col("tag"), F.col("chunk")), chunk,
                     "doc_id long, tag string, chunk int, ids binary, head_at array<long>, head_before array<long>, "
                     "tail_at array<long>, tail_before array<long>")
    # Repeated rows send the same chunks; one of each stays and the document is given as often as it came.
    once = (encoded.groupBy("doc_id", "tag", "chunk")
            .agg(F.count("*").alias("times"), F.first(F.struct("chunk", "ids", "head_at", "head_before", "tail_at", "tail_before")).alias("part"))
            .groupBy("doc_id", "tag").agg(F.max("times").alias("times"), F.array_sort(F.collect_list("part")).alias("parts")))
    return short.unionByName(mapped(once, join, schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded``: the raw bytes of the tokens, one after the other."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    def run(cols: dict[str, list]) -> Iterator[tuple]:
        codec = tokens_of(path)
        for doc, n, ids in zip(cols["doc_id"], cols["n_tokens"], cols["ids"]):
            yield doc, n, ids, codec.decode(ids)

    return mapped(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens int, ids binary, decoded binary")

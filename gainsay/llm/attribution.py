"""Token counts of sections: documents are encoded once, tokens are joined to sections by their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from gainsay.llm.bpe import DEFAULT_RANKS, pieces_of, tokens_of
from gainsay.llm.common import id_text, mapped

#: How a token that crosses a boundary is allocated: to the section of its first or last byte, or by its share of bytes.
RULES = ("first", "last", "share")


def section_counts(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross a boundary.

    ``starts`` and ``ends`` are the byte spans of the tokens; ``sections`` holds the first byte of each
    section and then the end of the text.  Both sides are sorted, so the interval join is a merge.
    """
    n = len(sections) - 1
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "share":
        counts = np.bincount(first[~crossing], minlength=n).astype(float)
        for lo, hi, a, b in zip(starts[crossing], ends[crossing], first[crossing], last[crossing]):
            for s in range(a, b + 1):
                counts[s] += (min(hi, sections[s + 1]) - max(lo, sections[s])) / (hi - lo)
    else:
        counts = np.bincount(first if rule == "first" else last, minlength=n).astype(float)
    owner = last if rule == "last" else first
    return counts, np.bincount(owner[crossing], minlength=n)


def attribute(docs: DataFrame, rule: str = "first", path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
              separator: str = "\n") -> DataFrame:
    """``doc_id``, ``section`` (from 0), ``start``, ``end`` (code points), ``n_tokens`` and ``n_crossing`` of each section.

    Sections are the parts of a text between separators; a separator belongs to the part before it.
    Every token is counted once: the sections of a document add up to the tokens of its whole text.  Null
    and empty texts have no section.  Repeated rows and ids give their sections again.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    def run(cols: dict[str, list]) -> Iterator[tuple]:
        codec, lengths = pieces_of(path), tokens_of(path).lengths
        for doc, text in zip(cols["doc_id"], cols["text"]):
            if not text:
                continue
            parts = text.split(separator)
            parts = [p + separator for p in parts[:-1]] + parts[-1:] * bool(parts[-1])
            chars = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            sections = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])])
            ends = np.cumsum(lengths[np.frombuffer(codec.encode(text), dtype="<u4")])
            counts, crossing = section_counts(np.concatenate([[0], ends[:-1]]), ends, sections, rule)
            for s, (lo, hi, n, c) in enumerate(zip(chars[:-1].tolist(), chars[1:].tolist(), counts.tolist(), crossing.tolist())):
                yield doc, s, lo, hi, n, c

    return mapped(id_text(docs, id_col, text_col), run, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")

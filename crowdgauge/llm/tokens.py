"""Byte-level BPE ids of whole texts, equal to the tokenizer file's, each distinct word encoded once.

The vocabulary is ``byte_bpe_50k.json``; its rank file holds the same one for a faster library. A
text is cut before white space that follows something else, where the tokenizer always splits, so
the pieces can be encoded apart. A chunk's distinct pieces are joined and encoded in one call, and
the ids of every text are gathered from them. The file's added tokens are no part of the rank file;
where asked for, texts are cut at them first, as the tokenizer does.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from crowdgauge.llm import text as X

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text whose pieces are encoded together.
CHUNK = 1 << 20


@lru_cache(maxsize=2)
def encoder(ranks: str | None = None):
    """(encoding, bytes per id). ``ranks`` is the path of a rank file."""
    import public_tokenizers as P
    import tiktoken

    table = {}
    with open(ranks or P.path(RANKS), "rb") as lines:
        for line in lines:
            word, rank = line.split()
            table[base64.b64decode(word)] = int(rank)
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for word, rank in table.items():
        sizes[rank] = len(word)
    return tiktoken.Encoding("bpe", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={}), sizes


@lru_cache(maxsize=1)
def added_tokens() -> dict[bytes, int]:
    """The ids of the tokenizer file's added tokens, which it finds in plain text."""
    import public_tokenizers as P

    with open(P.path(TOKENIZER), "rb") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"an added token of {TOKENIZER} is not matched literally")
    return {t["content"].encode(): t["id"] for t in added}


def _surely_solid(raw: np.ndarray) -> np.ndarray:
    """Last bytes of characters that are no white space: ASCII, and two bytes from U+00C0 on."""
    solid = X._SOLID[raw] & (raw < 128)
    solid[1:] |= (raw[1:] >= 128) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    return solid


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Begins of pieces: documents, and ASCII white space after a character that is surely none."""
    begin = np.zeros(len(raw), bool)
    begin[1:] = ~X._SOLID[raw[1:]] & _surely_solid(raw)[:-1]
    begin[starts[:-1][starts[:-1] < len(raw)]] = True
    return np.flatnonzero(begin)


def _encode_pieces(raw: np.ndarray, starts: np.ndarray, ranks: str | None):
    """(ids, number of ids of each document) of a chunk of documents."""
    coder, sizes = encoder(ranks)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
    begin = _cuts(raw, starts)
    end = np.append(begin[1:], len(raw))
    hashes = X.span_hashes(raw, begin, end, X._BYTES)
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    b, e = begin[at], end[at]
    # pieces that do not start with white space, or may end with it, could grow together: apart
    joins = ~X._SOLID[raw[b]] & _surely_solid(raw)[e - 1]
    ids, counts = [], np.zeros(len(at), np.int64)
    many = np.flatnonzero(joins)
    if len(many):
        size = (e - b)[many]
        ends = np.cumsum(size)
        source = np.arange(ends[-1]) + np.repeat(b[many] - (ends - size), size)
        found = coder.encode_to_numpy(raw[source].tobytes().decode(), allowed_special=set(), disallowed_special=())
        stops = np.searchsorted(np.cumsum(sizes[found]), ends) + 1
        counts[many] = np.diff(stops, prepend=0)
        ids.append(found.astype(np.uint32))
    few = np.flatnonzero(~joins)
    for i in few:
        one = coder.encode_ordinary(raw[b[i] : e[i]].tobytes().decode())
        counts[i] = len(one)
        ids.append(np.array(one, np.uint32))
    order = np.concatenate([many, few])
    at_id = np.zeros(len(at), np.int64)
    at_id[order] = np.cumsum(counts[order]) - counts[order]
    pool = np.concatenate(ids)
    each = counts[back]
    ends = np.cumsum(each)
    gathered = pool[np.arange(ends[-1]) + np.repeat(at_id[back] - (ends - each), each)]
    totals = np.concatenate([[0], ends])[np.searchsorted(begin, starts)]
    return gathered, np.diff(totals)


def _encode_around(raw: np.ndarray, starts: np.ndarray, ranks: str | None, added: dict[bytes, int]):
    """``_encode_pieces`` of texts that are cut at the literals of added tokens, whose ids stand there."""
    data = raw.tobytes()
    literal = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    if not added or not literal.search(data):
        return _encode_pieces(raw, starts, ranks)
    found = [m for a, b in zip(starts, starts[1:]) for m in literal.finditer(data, a, b)]
    begins = np.array([m.start() for m in found], np.int64)
    borders = np.unique(np.concatenate([starts, begins, np.array([m.end() for m in found], np.int64)]))
    ids, counts = _encode_pieces(raw, borders, ranks)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for at, m in zip(np.searchsorted(borders, begins), found, strict=True):
        parts[at] = np.array([added[m.group()]], np.uint32)
    before = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return np.concatenate(parts), np.diff(before[np.searchsorted(borders, starts)])


def encode(column: pa.Array, ranks: str | None = None, added: dict[bytes, int] | None = None) -> Iterator[np.ndarray]:
    """The ids of every text of a string column, in order; null has none.

    The literals of ``added`` get their ids; without it they are plain text, as with the tokenizer's
    ``encode_special_tokens``.
    """
    for _, _, raw, starts in X.chunks(column, CHUNK):
        ids, counts = _encode_around(raw, starts, ranks, added or {})
        yield from np.split(ids, np.cumsum(counts)[:-1])

"""Merge-type piece vocabularies: whole texts to ids and back, each new word merged once.

A word starts as its characters. Its agenda holds every adjacent pair of symbols whose joined text is a
piece, ordered by the piece's score, then from the left. The first pair is merged, the pairs that it
touched are replaced, until the agenda is empty. Short words of a chunk share a matrix whose rows are
agendas, so that one step advances all of them; long ones have a heap each.

Texts are cut between two characters that no piece holds side by side: no merge can cross such a place,
so the words between them are independent and the ids of a text are those of its words in order. A worker
remembers words by hash; that the ids spell the text is compared, byte for byte, for every chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdgauge.llm import text as X

MODEL = "piece_bpe_32k.model"
#: Fixed value: the character that stands for a blank in pieces.
BLANK = "▁"
#: Words of more symbols have a heap; shorter ones share matrices of these widths.
WIDTHS = (2, 4, 8, 16, 32)
#: Rows of a matrix, and bytes of text whose words are merged together.
ROWS, CHUNK = 16_384, 1 << 21
#: Words that a worker remembers between chunks, about 40 bytes each.
KNOWN = 1_000_000
#: Bytes of text that the library checks in one call.
CHECKED = 1 << 20
_NONE = np.iinfo(np.int64).max
_OTHER = 128  # all characters beyond ASCII


class Pieces:
    """The vocabulary of a model file as tables."""

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path or P.path(MODEL))
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, byte_ids)) or any(map(sp.is_unused, range(size))):
            raise ValueError("the vocabulary needs a piece for each byte and must have no unused pieces")
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {names[i]: i for i in plain}
        probe = sp.encode("a  b ")
        if "".join(names[i] for i in probe).replace(BLANK, " ") != " a  b " or sp.encode(""):
            raise ValueError("the model must keep texts as they are, behind one blank")
        self.size, self.byte_ids = size, np.array(byte_ids, np.int32)
        self.singles = np.full(0x110000, -1, np.int32)
        #: order of scores: the higher score first, equal scores alike
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        together = np.zeros((_OTHER + 1, _OTHER + 1), bool)
        together[_OTHER, _OTHER] = True
        pairs = {}
        for name, i in ids.items():
            kinds = [32 if c == BLANK else min(ord(c), _OTHER) for c in name]
            for a, b in pairwise(kinds):
                together[a, b] = True
            if len(name) == 1:
                self.singles[ord(name)] = i
            for cut in range(1, len(name)):
                left, right = ids.get(name[:cut]), ids.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
            if len(name) > 1 and any(c not in ids for c in name):
                raise ValueError(f"a character of {name!r} is no piece")
        self.singles[32] = self.singles[ord(BLANK)]
        self.cut = ~together
        self.keys = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        # what each id is decoded to; a byte piece is its byte
        parts = [b"" if sp.is_control(i) else names[i].replace(BLANK, " ").encode() for i in range(size)]
        for b, i in enumerate(byte_ids):
            parts[i] = bytes([b])
        for i in range(size):
            if sp.is_unknown(i):
                parts[i] = sp.decode([i]).encode()
        self.parts = parts
        self.part_size = np.array([len(p) for p in parts], np.int64)
        self.part_at = np.cumsum(self.part_size) - self.part_size
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[byte_ids] = True
        self.memory: dict[bool, Memory] = {}
        #: texts that begin with these keep their first blank
        self.keeps_blank = self.is_byte | np.array([sp.is_unknown(i) for i in range(size)])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1; negative symbols make none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.into[at], -1)


class Memory:
    """Ids of the words that a worker has met, by hash; at most ``KNOWN`` and those of one chunk."""

    def __init__(self):
        self.hashes, self.at, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def learn(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, new: np.ndarray) -> None:
        """Add the words ``hashes[new]``; beyond the limit only words of ``hashes`` are kept."""
        if len(self.hashes) + len(new) > KNOWN:
            kept = self.places(hashes)
            kept = kept[kept >= 0]
            self.pool, _ = self.take(kept)
            self.hashes, self.counts = self.hashes[kept], self.counts[kept]
            self.at = np.cumsum(self.counts) - self.counts
        at = len(self.pool) + np.cumsum(counts) - counts
        into = np.searchsorted(self.hashes, hashes[new])
        self.hashes = np.insert(self.hashes, into, hashes[new])
        self.at, self.counts = np.insert(self.at, into, at), np.insert(self.counts, into, counts)
        self.pool = np.concatenate([self.pool, ids])

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the words at ``places``."""
        counts = self.counts[places]
        return self.pool[_ragged(counts, self.at[places])], counts


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path)


def merge_rows(v: Pieces, symbols: np.ndarray) -> np.ndarray:
    """Merge every row of a matrix of symbols, padded with -1; merged symbols leave -1 behind.

    Each row has its agenda in a row of another matrix: the order of the pair that starts at a place,
    then the place. The least entry is the pair to merge.
    """
    rows, width = symbols.shape
    done = np.full((rows, width), -1, np.int32)
    where = np.arange(rows)
    # a last column stands for "no neighbour"
    symbol = np.full((rows, width + 1), -1, np.int32)
    symbol[:, :width] = symbols
    after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
    before = np.broadcast_to(np.concatenate([[width], np.arange(width)]), (rows, width + 1)).copy()
    into = np.full((rows, width + 1), -1, np.int32)
    agenda = np.full((rows, width + 1), _NONE)
    into[:, : width - 1] = v.merged(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
    places = np.arange(width + 1)
    there = into >= 0
    agenda[there] = (v.order[into[there]] << 8) + np.broadcast_to(places, into.shape)[there]

    def renew(r: np.ndarray, at: np.ndarray) -> None:
        found = v.merged(symbol[r, at], symbol[r, after[r, at]])
        into[r, at] = found
        agenda[r, at] = np.where(found >= 0, (v.order[found] << 8) + at, _NONE)

    while len(where):
        first = agenda.argmin(axis=1)
        live = agenda[np.arange(len(where)), first] < _NONE
        if not live.all():
            over = ~live
            done[where[over]] = symbol[over, :width]
            symbol, after, before, into, agenda = (m[live] for m in (symbol, after, before, into, agenda))
            where, first = where[live], first[live]
            if not len(where):
                break
        r = np.arange(len(where))
        gone = after[r, first]
        symbol[r, first] = into[r, first]
        symbol[r, gone] = -1
        agenda[r, gone] = _NONE
        behind = after[r, gone]
        after[r, first] = behind
        before[r, behind] = first  # the last column's entry is never read
        renew(r, first)
        renew(r, before[r, first])  # of a first symbol: the last column, which has no pair
    return done


def merge_long(v: Pieces, symbols: list[int]) -> list[int]:
    """Merge one long word with a heap of (order, place); pairs that changed are passed over."""
    n = len(symbols)
    symbol = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []

    def offer(at: int) -> None:
        right = after[at]
        if right < n:
            found = v.pairs.get(symbol[at] * v.size + symbol[right])
            if found is not None:
                heapq.heappush(agenda, (int(v.order[found]), at, right, symbol[at], symbol[right], found))

    for at in range(n - 1):
        offer(at)
    while agenda:
        _, at, right, a, b, found = heapq.heappop(agenda)
        if symbol[at] != a or after[at] != right or symbol[right] != b:
            continue
        symbol[at], symbol[right] = found, -1
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [s for s in symbol if s >= 0]


def _ragged(sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places begins[i] .. begins[i] + sizes[i] - 1 for each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _symbols(v: Pieces, raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first symbols, their number in each word) of words of ``counts`` bytes one after the other.

    A character that is no piece is its bytes' pieces, which nothing merges with.
    """
    lead = (raw & 0xC0) != 0x80
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(lead)
    size = np.diff(np.append(at, len(raw)))
    single = v.singles[codes]
    each = np.where(single >= 0, 1, size)
    out = np.repeat(single, each)
    strange = np.repeat(single < 0, each)
    out[strange] = v.byte_ids[raw[_ragged(size[single < 0], at[single < 0])]]
    before = np.concatenate([[0], np.cumsum(each)])
    words = np.concatenate([[0], np.cumsum(counts)])
    return out, np.diff(before[np.searchsorted(at, words)])


def merge_words(v: Pieces, raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of words of ``counts`` bytes one after the other."""
    symbols, lengths = _symbols(v, raw, counts)
    begins = np.cumsum(lengths) - lengths
    parts, sizes = [], lengths.copy()
    which = []
    low = 1
    few = np.flatnonzero(lengths <= 1)
    which.append(few)
    parts.append(symbols[_ragged(lengths[few], begins[few])])
    for width in WIDTHS:
        bucket = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for i in range(0, len(bucket), ROWS):
            part = bucket[i : i + ROWS]
            matrix = np.full((len(part), width), -1, np.int32)
            matrix[np.arange(width) < lengths[part][:, None]] = symbols[_ragged(lengths[part], begins[part])]
            merged = merge_rows(v, matrix)
            left = merged >= 0
            which.append(part)
            sizes[part] = left.sum(axis=1)
            parts.append(merged[left])
    for word in np.flatnonzero(lengths > low):
        found = merge_long(v, symbols[begins[word] : begins[word] + lengths[word]].tolist())
        which.append(np.array([word]))
        sizes[word] = len(found)
        parts.append(np.array(found, np.int32))
    # back to the order of the words
    order, pool = np.concatenate(which), np.concatenate(parts)
    at = np.zeros(len(lengths), np.int64)
    at[order] = np.cumsum(sizes[order]) - sizes[order]
    return pool[_ragged(sizes, at)], sizes


def _prefixed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind one blank each, unless empty, with the blank character as a blank."""
    data = raw.tobytes()
    mark = BLANK.encode()
    if mark in data:
        texts = [data[a:b].replace(mark, b" ") for a, b in pairwise(starts.tolist())]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    full = np.diff(starts) > 0
    raw = np.insert(raw, starts[:-1][full], np.uint8(32))
    return raw, starts + np.concatenate([[0], np.cumsum(full)])


def encode_chunk(v: Pieces, raw: np.ndarray, starts: np.ndarray, check: bool):
    """(ids, number of ids of each text) of a chunk of texts."""
    raw, starts = _prefixed(raw, starts)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(starts) - 1, np.int64)
    kind = np.minimum(raw, _OTHER)
    begin = np.zeros(len(raw), bool)
    begin[1:] = v.cut[kind[:-1], kind[1:]]
    begin[starts[:-1][starts[:-1] < len(raw)]] = True
    b = np.flatnonzero(begin)
    e = np.append(b[1:], len(raw))
    hashes, first, back = np.unique(X.span_hashes(raw, b, e, X._BYTES), return_index=True, return_inverse=True)
    memory = v.memory.setdefault(check, Memory())
    place = memory.places(hashes)
    new = np.flatnonzero(place < 0)
    if len(new):
        memory.learn(hashes, *_merged(v, raw, b[first[new]], e[first[new]], check), new)
        place = memory.places(hashes)
    ids, each = memory.take(place[back])
    if v.part_bytes[_ragged(v.part_size[ids], v.part_at[ids])].tobytes() != raw.tobytes():
        ids, each = _merged(v, raw, b, e, check)  # two words share a hash
    total = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(b, starts)]
    return ids, np.diff(total)


def _merged(v: Pieces, raw: np.ndarray, b: np.ndarray, e: np.ndarray, check: bool):
    """(ids, number of ids of each word) of the words at [b, e)."""
    words = raw[_ragged(e - b, b)]
    ids, counts = merge_words(v, words, e - b)
    if check:
        _compare(v, words, e - b, ids, counts)
    return ids, counts


def _compare(v: Pieces, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
    """Hold the ids of words against the library's; those that begin with a blank stand for themselves."""
    ends = np.cumsum(sizes)
    stops = np.cumsum(counts)
    blank = raw[ends - sizes] == 32
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - sizes[low] + CHECKED, side="right")))
        asked = low + np.flatnonzero(blank[low:high])
        # the library puts the blank itself
        texts = [raw[ends[i] - sizes[i] + 1 : ends[i]].tobytes().decode() for i in asked]
        for i, text, own in zip(asked, texts, v.library.encode(texts, num_threads=1), strict=True):
            if text and ids[stops[i] - counts[i] : stops[i]].tolist() != own:
                raise ValueError(f"other ids than the library's for {text[:200]!r}")
        low = high


def decode_chunk(v: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of rows of ``counts`` ids each: pieces joined, without the blank that encoding put.

    Bytes that make no character become U+FFFD each, as in the library.
    """
    size = v.part_size[ids]
    data = v.part_bytes[_ragged(size, v.part_at[ids])].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    out = []
    low = 0
    for row, (a, b) in enumerate(pairwise(ends.tolist())):
        mine = data[a:b]
        try:
            whole = mine.decode()
        except UnicodeDecodeError:
            whole = _mend(v, ids[low : low + counts[row]].tolist())
        low += int(counts[row])
        out.append(whole[1:] if whole[:1] == " " and not v.keeps_blank[ids[low - counts[row]]] else whole)
    return out


def _mend(v: Pieces, ids: list[int]) -> str:
    """Pieces whose bytes are not all characters: each run of byte pieces apart, strange bytes one by one."""
    out, run = [], b""
    for i in [*ids, None]:
        if i is not None and v.is_byte[i]:
            run += v.parts[i]
            continue
        while run:
            for n in (4, 3, 2, 1):
                try:
                    one = run[:n].decode()
                except UnicodeDecodeError:
                    continue
                if len(one) == 1:
                    out.append(one)
                    run = run[n:]
                    break
            else:
                out.append("�")
                run = run[1:]
        if i is not None:
            out.append(v.parts[i].decode())
    return "".join(out)


def _code(keep: list[str], model: str | None, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model)
        for batch in X.small(batches, size=CHUNK):
            column = batch.column("text")
            for low, high, raw, starts in X.chunks(column, CHUNK):
                ids, counts = encode_chunk(v, raw, starts, check)
                texts = decode_chunk(v, ids, counts)
                if check:
                    _compare_texts(v, ids, counts, texts)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(low, high - low) for c in keep),
                        pa.array(counts, pa.int64()),
                        lists.cast(pa.list_(pa.int32())),
                        pa.array(texts, pa.string()),
                    ],
                    names=[*keep, "n_tokens", "ids", "decoded"],
                )

    return run


def _compare_texts(v: Pieces, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> None:
    rows = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    if v.library.decode(rows, num_threads=1) != texts:
        raise ValueError("other texts than the library's")


def encode(docs: DataFrame, model: str | None = None, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs(doc_id, text)``.

    ``ids`` are those of the sentencepiece library for the whole text, without begin and end ids;
    ``decoded`` is what they decode to. A null or empty text has no ids and decodes to an empty text.
    Rows are coded each for itself, so repeated rows, ties and a null doc_id stay as they are; an
    empty table gives an empty one; other columns, of any name, are ignored. ``model`` is the path of
    a merge-type model file with byte pieces; without it the public vocabulary is used, and a model
    that this way cannot code raises an error. With ``check``, each Arrow batch is held against the
    library: the ids of each distinct word, and the decoded texts; a difference raises an error.

    A task holds one chunk of texts and its distinct words, or one longer text. There is no shuffle.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(
        _code(["doc_id"], model, check), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
    )

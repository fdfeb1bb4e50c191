"""Token counts of whole texts by a whole-token shortcut.

A text becomes pre-tokens: every run of spaces with the characters after it, and
every newline. No piece of the vocabulary spans such a cut (checked when the
vocabulary is read), so the merges inside a pre-token never depend on its
neighbours, and a text has as many tokens as its pre-tokens together.

Offline, the merges are run once over every string of the vocabulary; those that
end as one piece are whole tokens. A pre-token that is a whole token counts 1 by
one look-up. Only the other pre-tokens are merged, each distinct one once per
chunk of texts: always the pair whose piece has the best score, the leftmost of
equal ones. A character without a piece counts its UTF-8 bytes.

Strings are looked up by 64-bit hashes. Texts are cut into chunks of whole texts;
a longer text is a chunk of its own.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null id is kept;
U+2581 in a text is a space, as for the library; the strings of special tokens
are ordinary text; repeated rows are counted alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import released
from actlens.llm.shingles import _buffers, _powers, mix64

MODEL_NAME = "piece_bpe_32k.model"
SPACE = "▁"
MAX_TOKENS = 4096
CHUNK_BYTES = 1 << 21
#: pre-tokens of more characters are merged one by one, by a priority queue
LONG = 64
_R = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(7)) * _R)
_NEVER = np.iinfo(np.int64).max


@dataclass
class MergeTable:
    """The vocabulary for counting; plain arrays, so it can be broadcast.

    Symbols are the pieces and, after them, characters that only occur inside
    pieces. ``pair_key`` is left symbol * n + right symbol, sorted."""

    n: int
    chars: np.ndarray           # sorted code points that are symbols
    char_symbol: np.ndarray
    pair_key: np.ndarray
    pair_rank: np.ndarray       # smaller is merged first
    pair_symbol: np.ndarray
    cost: np.ndarray            # tokens of a symbol: 1, or the bytes of a character without a piece
    whole: np.ndarray           # sorted hashes of the strings that encode alone as one token

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, symbol) by pair, for single look-ups; made on first use."""
        return dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_symbol.tolist())))


def _hash_parts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of every part (start, size) of the bytes; the parts cover ``data``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(start, size)
    code = _BYTE[data]
    code *= _powers(int(size.max()))[place]
    return mix64(np.add.reduceat(code, start) + size.astype(np.uint64))


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key among sorted ``keys``, else -1."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def load_merges(model_file: str) -> MergeTable:
    """Reads a BPE vocabulary with byte fallback and proves its whole tokens."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    symbol, score, cost = {}, {}, []
    for i in range(n):
        piece = model.id_to_piece(i)
        cost.append(1)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            symbol[piece], score[piece] = i, model.get_score(i)
    _check(model, symbol)
    for c in sorted({c for p in symbol for c in p} - set(symbol)):
        symbol[c] = len(cost)
        cost.append(len(c.encode()))
    rank = {p: r for r, p in enumerate(sorted(score, key=lambda p: -score[p]))}
    pairs = sorted((symbol[p[:k]] * len(cost) + symbol[p[k:]], rank[p], symbol[p]) for p in score
                   for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
    chars = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
    table = MergeTable(len(cost), np.array([c for c, _ in chars], np.int64), np.array([s for _, s in chars], np.int64),
                       *(np.array([p[k] for p in pairs], np.int64) for k in range(3)),
                       np.array(cost, np.int64), np.zeros(0, np.uint64))
    strings = sorted(score)
    tokens = merged_counts(table, np.array([ord(c) for p in strings for c in p], np.int64),
                           np.array([len(p) for p in strings], np.int64))
    proven = [p.replace(SPACE, " ").encode() for p, t in zip(strings, tokens) if t == 1]
    size = np.array([len(p) for p in proven], np.int64)
    table.whole = np.sort(_hash_parts(np.frombuffer(b"".join(proven), np.uint8), np.cumsum(size) - size, size))
    return table


def _check(model, pieces: dict[str, int]) -> None:
    """Refuses vocabularies that these cuts and merges would not count right."""
    spans = [p for p in pieces if SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n")]
    probe = "ﬁ  ①\t a"
    if spans or model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("a piece spans the start of a word, or the model rewrites texts")
    if sum(model.is_byte(i) for i in model.encode("\U000f0000")) != 4:
        raise ValueError("the model has no byte fallback")


def _pair(table: MergeTable, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row of the pair table, -1 where the two symbols make no piece; a symbol may be -1."""
    at = _lookup(table.pair_key, left * table.n + right)
    return np.where((left >= 0) & (right >= 0), at, -1)


def merged_counts(table: MergeTable, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens of pre-tokens given by their code points, one after the other."""
    at = _lookup(table.chars, codes)
    symbol = np.where(at >= 0, table.char_symbol[at], -1)
    # characters that are no symbol count their bytes and never merge
    bare = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    start = np.cumsum(length) - length
    out = np.zeros(len(length), np.int64)
    short = np.flatnonzero((length > 0) & (length <= LONG))
    for i in np.flatnonzero(length > LONG).tolist():
        part = slice(int(start[i]), int(start[i] + length[i]))
        left = _merge_one(table, symbol[part])
        out[i] = sum(int(table.cost[s]) if s >= 0 else int(bare[part][k]) for k, s in left)
    if len(short):
        size = length[short]
        take = np.arange(int(size.sum())) + np.repeat(start[short] - (np.cumsum(size) - size), size)
        out[short] = _merge_all(table, symbol[take], bare[take], size)
    return out


def _merge_all(table: MergeTable, symbol: np.ndarray, bare: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One merge a round in every pre-token that still has a pair."""
    n = len(symbol)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[start + size - 1], before[start] = -1, -1
    symbol = symbol.copy()
    alive = np.ones(n, bool)
    # of each place: the pair with the next one as rank * n + place, and its row
    row = np.full(n, -1)
    inside = np.flatnonzero(after >= 0)
    row[inside] = _pair(table, symbol[inside], symbol[inside + 1])
    bid = np.where(row >= 0, table.pair_rank[row] * n + np.arange(n), _NEVER) if len(table.pair_rank) else \
        np.full(n, _NEVER)
    # the places of the pre-tokens that still merge, one pre-token after the other
    places, heads = np.arange(n), start
    while len(heads):
        best = np.minimum.reduceat(bid[places], heads)
        go = best != _NEVER
        if not go.all():
            keep = np.repeat(go, np.diff(np.append(heads, len(places))))
            sizes = np.diff(np.append(heads, len(places)))[go]
            places, heads, best = places[keep], np.cumsum(sizes) - sizes, best[go]
            if not len(heads):
                break
        i = best % n
        j = after[i]
        symbol[i] = table.pair_symbol[row[i]]
        alive[j], bid[j] = False, _NEVER
        after[i] = after[j]
        k = after[i]
        before[k[k >= 0]] = i[k >= 0]
        for a, b in ((i, k), (before[i], i)):
            ok = (a >= 0) & (b >= 0)
            hit = _pair(table, symbol[a[ok]], symbol[b[ok]])
            row[a[ok]] = hit
            bid[a[ok]] = np.where(hit >= 0, table.pair_rank[hit] * n + a[ok], _NEVER)
        bid[i[k < 0]] = _NEVER
        if alive[places].sum() * 2 < len(places):
            left = alive[places]
            sizes = np.add.reduceat(left.astype(np.int64), heads)
            places, heads = places[left], np.cumsum(sizes) - sizes
    cost = np.where(symbol >= 0, table.cost[symbol], bare) * alive
    return np.bincount(owner, cost, len(size)).astype(np.int64)


def _merge_one(table: MergeTable, symbol: np.ndarray) -> list[tuple[int, int]]:
    """(place, symbol) of what is left of one long pre-token, in n log n steps."""
    pairs, n, s = table.pairs, len(symbol), symbol.tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and s[i] >= 0 and s[j] >= 0 and (hit := pairs.get(s[i] * table.n + s[j])):
            heapq.heappush(queue, (hit[0], i, s[i], s[j], hit[1]))
    queue: list[tuple[int, int, int, int, int]] = []
    gone = bytearray(n)
    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, a, b, new = heapq.heappop(queue)
        j = after[i]
        if gone[i] or j < 0 or s[i] != a or s[j] != b:
            continue        # one of the two has changed since
        s[i], gone[j], after[i] = new, 1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [(i, s[i]) for i in range(n) if not gone[i]]


def _pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token; ``offsets`` are the texts' borders."""
    space, newline = data == 32, data == 10
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | newline[1:] | newline[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _count_chunk(table: MergeTable, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a chunk; every text has its space in front."""
    start = _pre_tokens(data, offsets)
    size = np.diff(np.append(start, len(data)))
    key = _hash_parts(data, start, size)
    number, distinct = pd.factorize(key)
    seen = np.empty(len(distinct), np.int64)
    seen[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    tokens = np.ones(len(distinct), np.int64)
    rest = np.flatnonzero(_lookup(table.whole, distinct) < 0)
    if len(rest):
        begin, wide = start[seen[rest]], size[seen[rest]]
        edge = np.cumsum(wide) - wide
        blob = data[np.repeat(begin - edge, wide) + np.arange(int(wide.sum()))]
        codes = np.frombuffer(blob.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[codes == 32] = ord(SPACE)
        tokens[rest] = merged_counts(table, codes, np.add.reduceat((blob & 0xC0) != 0x80, edge, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(tokens[number])])
    firsts = np.searchsorted(start, offsets)
    return sums[firsts[1:]] - sums[firsts[:-1]]


def token_counts(table: MergeTable, texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Number of tokens of every text of a column."""
    texts = texts.cast(pa.large_string()).fill_null("")
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    spaced = pc.replace_substring(texts, SPACE, " ")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string()))
    data, offsets = _buffers(spaced)
    out, row = np.zeros(len(texts), np.int64), 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        out[row:stop] = _count_chunk(table, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop
    out[empty] = 0
    return out


def count_tokens(docs: DataFrame, table: MergeTable, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(token_counts(t, texts))],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)

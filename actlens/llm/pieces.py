"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text becomes "_" + text with every space as "_" (U+2581). The lattice of all
ways to spell it with vocabulary pieces is filtered forwards (the total weight
of all spellings of every prefix) and sampled backwards (from the end, each
piece with its share of that weight). Random numbers are hashes of the row key,
the place in the text and the step, so a row's segmentation is reproducible.

No piece spans the start of a run of spaces or a newline, so the lattice falls
apart exactly at these cuts. The filter therefore runs once for every distinct
segment of a chunk of texts, for all segments of one length together, and the
sampler steps through all occurrences at once.

The vocabulary file is a BPE model, whose scores are negative merge ranks; the
lattice needs probabilities, and takes Zipf's law over the rank. A character
without a piece becomes its UTF-8 bytes; a U+2581 in the text itself is such a
character, so decoding (pieces to bytes, first space off) restores every text.

Defined cases: a null text gives null pieces, an empty text no pieces; a null
key samples as key 0; equal rows get equal segmentations; very long texts are
worked on in one chunk each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from actlens.llm.common import released
from actlens.llm.shingles import _BYTE_CODE, _buffers, _powers, mix64

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
NONE, PREFIX = -1, -2


@dataclass
class PieceTable:
    """The vocabulary as arrays; plain data, so it can be broadcast."""

    size: int
    byte_ids: np.ndarray        # id of the piece of each byte
    max_len: int
    log_weight: np.ndarray      # by id
    keys: list[np.ndarray]      # two hash tables: key by slot
    ids: list[np.ndarray]       # id by slot
    out_bytes: np.ndarray       # bytes of all pieces, decoded, one after the other
    out_start: np.ndarray       # by id, one more at the end


def _slot(h: np.ndarray, table: int) -> np.ndarray:
    return (mix64(h + np.uint64(table)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def load_pieces(model_file: str = MODEL_FILE, alpha: float = 1.0, offset: float = 10.0) -> PieceTable:
    """Reads the vocabulary. The hash tables hold every prefix of a piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    byte_ids, out, rank, spelled = np.zeros(256, np.int32), [], 0, {}
    log_weight = np.full(n, -np.inf)
    for i in range(n):
        piece = model.id_to_piece(i).replace(SPACE, " ")
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            out.append(b"")
        else:
            rank += 1
            log_weight[i] = -alpha * np.log(rank + offset)
            out.append(piece.encode())
            spelled[piece] = i
    prefixes = {p[:k]: PREFIX for p in spelled for k in range(1, len(p) + 1)} | spelled
    # the hash of a prefix is that of the prefix before it and one character more
    chars = np.array(sorted({c for p in spelled for c in p}))
    code = dict(zip(chars.tolist(), mix64(np.array([ord(c) for c in chars], np.uint64) + np.uint64(1)).tolist()))
    powers = _powers(64)[:64].tolist()
    names = sorted(prefixes, key=len)
    hashes: dict[str, int] = {"": 0}
    for name in names:
        hashes[name] = (hashes[name[:-1]] + code[name[-1]] * powers[len(name) - 1]) % (1 << 64)
    keys = [np.zeros(1 << _TABLE_BITS, np.uint64) for _ in range(2)]
    ids = [np.full(1 << _TABLE_BITS, NONE, np.int32) for _ in range(2)]
    left = np.array([hashes[name] for name in names], np.uint64)
    value = np.array([prefixes[name] for name in names], np.int32)
    for t in range(2):
        slot, at = np.unique(_slot(left, t), return_index=True)
        keys[t][slot], ids[t][slot] = left[at], value[at]
        rest = np.setdiff1d(np.arange(len(left)), at)
        left, value = left[rest], value[rest]
    if len(left):
        raise ValueError("two pieces share both slots; raise the table size")
    start = np.zeros(n + 1, np.int64)
    start[1:] = np.cumsum([len(b) for b in out])
    return PieceTable(n, byte_ids, max(map(len, spelled)), log_weight, keys, ids,
                      np.frombuffer(b"".join(out), np.uint8), start)


def _find(table: PieceTable, h: np.ndarray) -> np.ndarray:
    """Piece ids of spelling hashes, ``PREFIX`` for the beginning of a piece, else ``NONE``."""
    s = _slot(h, 0)
    found = np.where(table.keys[0][s] == h, table.ids[0][s], NONE)
    rest = np.flatnonzero(found == NONE)
    s = _slot(h[rest], 1)
    found[rest] = np.where(table.keys[1][s] == h[rest], table.ids[1][s], NONE)
    return found


@dataclass
class Lattice:
    """Incoming pieces of every node of every distinct segment.

    Node ``base[s] + e`` is the end of the first ``e`` characters of segment
    ``s``; its pieces are ``first[node]`` up to ``first[node + 1]``."""

    base: np.ndarray
    length: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    back: np.ndarray        # length of the piece in characters
    upto: np.ndarray        # cumulative probability within the node
    spare: list[bytes]      # bytes of the characters without a piece


def build_lattice(table: PieceTable, codes: np.ndarray, length: np.ndarray) -> Lattice:
    """The lattice of segments given by their code points (one after the other)
    and their lengths."""
    start = np.cumsum(length) - length
    base = start + np.arange(len(length))
    offset = np.arange(len(codes)) - np.repeat(start, length)
    # positions by their offset inside the segment: the filter's order of work
    at = np.argsort(offset.astype(np.int32 if len(codes) else np.int64), kind="stable")
    node = at + np.repeat(np.arange(len(length)), length)[at]     # node before the character
    left = (np.repeat(length, length) - offset)[at]
    offset = offset[at]
    char = mix64(codes.astype(np.uint64) + np.uint64(1))
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []     # by piece length: offset, node before, id
    spare: list[bytes] = []
    live, h = np.arange(len(at)), np.zeros(len(at), np.uint64)
    for k in range(1, table.max_len + 1):
        h = h + char[at[live] + k - 1] * _powers(64)[k - 1]
        found = _find(table, h)
        hit = np.flatnonzero(found >= 0)
        ids = found[hit]
        if k == 1:
            lone = np.flatnonzero(found < 0)
            distinct, number = np.unique(codes[at[lone]], return_inverse=True)
            spare = [chr(int(c)).encode() for c in distinct]
            who = np.concatenate([hit, lone])
            ids = np.concatenate([ids, (table.size + number).astype(np.int32)])
            order = np.argsort(offset[who], kind="stable")
            hits.append((offset[who][order], node[who][order], ids[order]))
        else:
            hits.append((offset[live[hit]], node[live[hit]], ids))
        go = (found != NONE) & (left[live] > k)
        live, h = live[go], h[go]
        if not len(live):
            break

    log_weight = np.concatenate([table.log_weight, [-np.log(table.size) * len(b) for b in spare]])
    n_nodes = len(codes) + len(length)
    total = np.full(n_nodes, -np.inf)
    total[base] = 0.0
    weights = [log_weight[ids] for _, _, ids in hits]
    longest = int(length.max(initial=0))
    bounds = [np.searchsorted(o, np.arange(longest + 1)) for o, _, _ in hits]
    for o in range(longest):
        for k, (_, before, _) in enumerate(hits, start=1):
            a, b = bounds[k - 1][o], bounds[k - 1][o + 1]
            if b > a:
                into = before[a:b] + k
                total[into] = np.logaddexp(total[into], total[before[a:b]] + weights[k - 1][a:b])

    count = np.zeros(n_nodes, np.int64)
    for k, (_, before, _) in enumerate(hits, start=1):
        count[before + k] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    piece, back = np.empty(first[-1], np.int32), np.empty(first[-1], np.int16)
    upto, free, mass = np.empty(first[-1]), first[:-1].copy(), np.zeros(n_nodes)
    for k in range(len(hits), 0, -1):           # long pieces first: they are the likelier ones
        _, before, ids = hits[k - 1]
        into = before + k
        mass[into] += np.exp(total[before] + weights[k - 1] - total[into])
        slot = free[into]
        piece[slot], back[slot], upto[slot] = ids, k, mass[into]
        free[into] += 1
    upto[first[1:][count > 0] - 1] = 2.0        # the last piece of a node ends every walk
    return Lattice(base, length, first, piece, back, upto, spare)


def sample(lattice: Lattice, segment: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all occurrences, in order, and their number per occurrence."""
    n = len(segment)
    alive = np.flatnonzero(lattice.length[segment] > 0)
    end = lattice.length[segment[alive]].copy()
    base = lattice.base[segment[alive]]
    key = seed[alive]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(n, np.int64)
    step = 0
    while len(alive):
        step += 1
        u = (mix64(key + np.uint64(step * int(_R) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        at = lattice.first[base + end]
        late = np.flatnonzero(u >= lattice.upto[at])
        while len(late):
            at[late] += 1
            late = late[u[late] >= lattice.upto[at[late]]]
        steps.append((alive, lattice.piece[at]))
        count[alive] += 1
        end = end - lattice.back[at]
        go = end > 0
        alive, end, base, key = alive[go], end[go], base[go], key[go]
    stop = np.cumsum(count)
    out = np.empty(int(stop[-1]) if n else 0, np.int32)
    for k, (who, ids) in enumerate(steps):
        out[stop[who] - 1 - k] = ids
    return out, count


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts (each with its space in front) into segments.

    Returns the number of every segment among the distinct ones, the distinct
    segments as code points and lengths, and per text the index of its first
    segment."""
    space, newline = data == 32, data == 10
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | newline[1:] | newline[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    code = _BYTE_CODE[data]
    code *= _powers(int(size.max()))[place]
    del place, cut, space, newline
    key = mix64(np.add.reduceat(code, start) + size.astype(np.uint64))
    number, distinct = pd.factorize(key)
    seen = np.empty(len(distinct), np.int64)
    seen[number[::-1]] = np.arange(len(number))[::-1]
    size, begin = size[seen], start[seen]
    edge = np.cumsum(size) - size
    blob = data[np.repeat(begin - edge, size) + np.arange(int(size.sum()))]
    codes = np.frombuffer(blob.tobytes().decode().encode("utf-32-le"), np.uint32)
    return number, codes, np.add.reduceat((blob & 0xC0) != 0x80, edge, dtype=np.int64), \
        np.searchsorted(start, offsets)


def encode_texts(table: PieceTable, texts: pa.Array, keys: np.ndarray, seed: int = 0,
                 chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids of these rows, number of ids per row)."""
    empty = pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()),
                                         texts.cast(pa.large_string()).fill_null(""),
                                         pa.scalar("", pa.large_string()))
    data, offsets = _buffers(spaced)
    row_seed = mix64(keys.astype(np.int64).view(np.uint64) * _R + np.uint64(seed))
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        part = offsets[row:stop + 1] - offsets[row]
        number, codes, length, firsts = _segments(data[offsets[row]:offsets[stop]], part)
        lattice = build_lattice(table, codes, length)
        per_row = np.diff(firsts)
        nth = np.arange(len(number)) - np.repeat(firsts[:-1], per_row)
        key = mix64(np.repeat(row_seed[row:stop], per_row) + nth.astype(np.uint64) * _powers(2)[1])
        ids, count = sample(lattice, number, key)
        # characters without a piece become byte pieces
        spare = np.flatnonzero(ids >= table.size)
        if len(spare):
            wide = np.ones(len(ids), np.int64)
            sizes = np.array([len(b) for b in lattice.spare])
            wide[spare] = sizes[ids[spare] - table.size]
            owner = np.repeat(np.arange(len(number)), count)
            count = np.bincount(owner, wide, len(number)).astype(np.int64)
            at = np.cumsum(wide) - wide
            grown = np.repeat(ids, wide)
            offset = np.arange(len(grown)) - np.repeat(at, wide)
            flat = np.frombuffer(b"".join(lattice.spare), np.uint8)
            begin = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(grown >= table.size)
            grown[hit] = table.byte_ids[flat[begin[grown[hit] - table.size] + offset[hit]]]
            ids = grown
        sums = np.concatenate([[0], np.cumsum(count)])
        n_ids = sums[firsts[1:]] - sums[firsts[:-1]]
        gone = empty[row:stop]
        if gone.any():
            ids = ids[np.repeat(~gone, n_ids)]
            n_ids = np.where(gone, 0, n_ids)
        yield row, stop, ids, n_ids
        row = stop


def decode_ids(table: PieceTable, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (the space in front taken off) and their row offsets."""
    size = (table.out_start[1:] - table.out_start[:-1])[ids]
    stop = np.cumsum(size)
    place = np.arange(int(stop[-1]) if len(ids) else 0) - np.repeat(stop - size, size)
    data = table.out_bytes[np.repeat(table.out_start[ids], size) + place]
    edge = np.concatenate([[0], np.cumsum(n_ids)])
    ends = np.concatenate([[0], stop])[edge]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][n_ids > 0]] = False
    return data[keep], np.concatenate([[0], np.cumsum(np.diff(ends) - (n_ids > 0))])


def encode_documents(docs: DataFrame, table: PieceTable, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces (array of ids), lossless (decoded equals the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1)
            keys = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False)
            absent = texts.is_null().to_numpy(zero_copy_only=False)
            for a, b, ids, n_ids in encode_texts(t, texts, keys, seed):
                data, ends = decode_ids(t, ids, n_ids)
                source, offsets = _buffers(texts.slice(a, b - a))
                same = np.diff(ends) == np.diff(offsets)
                if same.all() and len(data):
                    wrong = np.flatnonzero(data != source)
                    same[np.searchsorted(offsets, wrong, side="right") - 1] = False
                elif not same.all():
                    same = np.array([data[ends[i]:ends[i + 1]].tobytes() == source[offsets[i]:offsets[i + 1]].tobytes()
                                     for i in range(b - a)])
                gone = pa.array(absent[a:b])
                edge = np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids), mask=gone)
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(a, b - a).cast(pa.int64()), pc.if_else(gone, None, pa.array(n_ids, pa.int64())),
                     pieces, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "pieces", "lossless"])

    return (docs.select("doc_id", "text")
            .mapInArrow(released(run), "doc_id long, n_pieces long, pieces array<int>, lossless boolean"))

"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is read from a SentencePiece model of merge type (BPE); the
segmentation is done here. A unit (a run of spaces and what follows up to the
next space) starts as characters. Its agenda holds the candidate merges, best
score first, leftmost among equals; a candidate taken from the agenda is
skipped when its keyed hash falls under ``dropout``. Without dropout the pieces are SentencePiece's own.

The hash is keyed by the seed, the document's id, the copy number where a
document is repeated, the unit with its position in the document, and the
candidate: its place in the unit and the sizes of its two parts. So every
occurrence of a unit is dealt its own segmentation, and reruns are alike.

Nothing is kept from unit to unit but the table of pairs that merge: the units
of a block are segmented together, a row of a matrix each, and every step takes
the best candidate of every row. Longer units go through a heap one by one.
Characters without a piece become bytes, and the space mark in a text itself
too, so decoding gives back the exact text.

Null text has no pieces and decodes to null; the empty text has none either
and decodes to "". Rows without id are keyed by the hash of nothing. Rows that
repeat with their id (and copy number, if there is one) give equal rows. Every row is on its own: no shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm import hashing

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
DROPOUT = 0.1
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48)  # of the matrices; longer units are on their own
BLOCK_CHARS, BLOCK_UNITS = 1_000_000, 100_000

_MARK = "▁"
_NONE = float("-inf")
_64 = (1 << 64) - 1
_A = 0x9E3779B97F4A7C15


@dataclass
class Pairs:
    """Symbols are pieces and single characters of pieces; 0 is any other character. Pairs of symbols that merge are in an open hash table."""

    of_char: np.ndarray  # symbol by code point
    ids: np.ndarray  # piece id by symbol, -1 for characters without a piece
    sizes: np.ndarray  # characters by symbol
    keys: np.ndarray  # first << 32 | second, or -1
    merged: np.ndarray  # the symbol of both, beside keys
    ranks: np.ndarray  # by score, equal scores alike, beside keys
    probes: int  # cells that a search has to look at

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Cells of the pairs, -1 for those that do not merge."""
        key = first << 32 | second
        cell = _cell(key, len(self.keys))
        out = np.where(self.keys[cell] == key, cell, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[cell] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (cell[open_] + step) & (len(self.keys) - 1)
            out[open_] = np.where(self.keys[at] == key[open_], at, -1)
            open_ = open_[(out[open_] < 0) & (self.keys[at] >= 0)]
        return out


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(_A)) >> np.uint64(40)).astype(np.int64) & (cells - 1)


def _pairs(packed: dict[str, bytes], scores: dict[str, float]) -> Pairs:
    symbols = {p: k for k, p in enumerate([*packed, *({c for p in packed for c in p} - packed.keys())], start=1)}
    of_char = np.zeros(0x110000, np.int32)
    for c, k in symbols.items():
        if len(c) == 1:
            of_char[ord(c)] = k
    place = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
    rows = [(symbols[p[:k]] << 32 | symbols[p[k:]], symbols[p], place[scores[p]]) for p in scores for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
    cells = 1 << max(4, (4 * len(rows)).bit_length())
    keys, merged, ranks = np.full(cells, -1, np.int64), np.zeros(cells, np.int64), np.zeros(cells, np.int32)
    probes = 1
    for (key, symbol, rank), at in zip(rows, _cell(np.array([x[0] for x in rows], np.int64), cells).tolist() if rows else (), strict=True):
        n = 1
        while keys[at] >= 0:
            at, n = (at + 1) & (cells - 1), n + 1
        keys[at], merged[at], ranks[at] = key, symbol, rank
        probes = max(probes, n)
    ids = [-1, *(int(np.frombuffer(packed[p], np.uint16)[0]) if p in packed else -1 for p in symbols)]
    return Pairs(of_char, np.array(ids, np.int32), np.array([1, *map(len, symbols)], np.int64), keys, merged, ranks, probes)


@dataclass
class Vocabulary:
    """Pieces with spaces in place of the model's space marks."""

    packed: dict[str, bytes]  # ids, 16 bits each
    scores: dict[str, float]
    raw: list[bytes]  # what each id decodes to
    packed_bytes: list[bytes]  # ids of the 256 bytes
    pairs: Pairs


def vocabulary(model: bytes) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if sp.vocab_size() > 1 << 16:
        raise ValueError("more than 65,536 pieces")
    packed, scores, raw, byte_ids = {}, {}, [], [b""] * 256
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[1:-1], 16)
            byte_ids[value] = np.uint16(i).tobytes()
            raw.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            plain = piece.replace(_MARK, " ")
            if " " in plain.lstrip(" ") or "\n" in plain:
                raise ValueError(f"piece {piece!r} spans units")
            packed[plain], scores[plain] = np.uint16(i).tobytes(), sp.get_score(i)
            raw.append(plain.encode())
    if not all(byte_ids):
        raise ValueError("the model has no byte fallback")
    return Vocabulary(packed, scores, raw, byte_ids, _pairs(packed, scores))


def _mix(x: int) -> int:
    """As hashing.mix, of one number."""
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & _64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _64
    return x ^ x >> 29


def _code(left: int, first: int, size: int) -> int:
    """Of the candidate that joins the ``first`` characters at ``left`` with what follows, to ``size`` characters."""
    return (left << 32 | first << 16 | size) * _A & _64


def _skipped(key: int, code: int, limit: int) -> bool:
    """Whether a candidate is skipped: 16 bits of a hash of its code and of its unit's key."""
    return _mix(key + code & _64) >> 48 < limit


def _hash(unit: str) -> int:
    return sum(_mix(ord(c) + k * _A & _64) for k, c in enumerate(unit)) & _64


def _base(seed: int, variant: int) -> int:
    return _mix(seed * 1_000_003 + variant & _64)


def _key(unit: str, *, seed: int, variant: int, at: int = 0) -> int:
    """Of the unit number ``at`` of a document; ``variant`` is the document's number."""
    return _mix((_base(seed, variant) + at * _A & _64) ^ _hash(unit))


def _merge_long(unit: str, scores: dict[str, float], key: int, limit: int) -> list[str]:
    """Agenda as a heap: n log n steps however long the unit."""
    n = len(unit)
    text: list = list(unit)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    agenda = [(-scores[p], i, p) for i in range(n - 1) if (p := unit[i : i + 2]) in scores]
    heapq.heapify(agenda)
    while agenda:
        _, i, piece = heapq.heappop(agenda)
        left = text[i]
        if left is None or (j := after[i]) >= n or len(left) + len(text[j]) != len(piece) or left + text[j] != piece:
            continue  # one of the two has been merged meanwhile
        if limit and _skipped(key, _code(i, len(left), len(piece)), limit):
            continue
        text[i], text[j] = piece, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := piece + text[k]) in scores:
                heapq.heappush(agenda, (-scores[p], i, p))
        if (h := before[i]) >= 0 and (p := text[h] + piece) in scores:
            heapq.heappush(agenda, (-scores[p], h, p))
    return [t for t in text if t is not None]


def _merge_short(unit: str, scores: dict[str, float], key: int, limit: int) -> list[str]:
    """Agenda as the list of the neighbours' scores, searched for its best: one unit by the steps of ``_merge_all``."""
    parts, at, get = list(unit), list(range(len(unit))), scores.get
    agenda = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while agenda and (best := max(agenda)) != _NONE:
        i = agenda.index(best)
        piece = parts[i] + parts[i + 1]
        if limit and _skipped(key, _code(at[i], len(parts[i]), len(piece)), limit):
            agenda[i] = _NONE
            continue
        parts[i] = piece
        del parts[i + 1], at[i + 1], agenda[i]
        if i < len(agenda):
            agenda[i] = get(piece + parts[i + 1], _NONE)
        if i:
            agenda[i - 1] = get(parts[i - 1] + piece, _NONE)
    return parts


def _ids(parts: list[str], vocab: Vocabulary) -> bytes:
    packed = vocab.packed
    try:
        return b"".join([packed[t] for t in parts])
    except KeyError:
        return b"".join([packed[t] if t in packed else b"".join([vocab.packed_bytes[x] for x in t.encode()]) for t in parts])


def _merge_all(symbols: np.ndarray, keys: np.ndarray, pairs: Pairs, limit: int) -> None:
    """Segments units, a column of ``symbols`` each (0 below their ends), in place: merged symbols at their first characters, -1 at the others.

    ``agenda`` has the candidate that begins at a character, as rank << 6 | character: the least is the best, and
    leftmost among equals. ``after`` and ``before`` link the characters at which parts begin.
    """
    width, n = symbols.shape
    none = np.int32(np.iinfo(np.int32).max)
    agenda = np.full((width, n), none, np.int32)
    cells = pairs.find(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width - 1, n)
    agenda[:-1] = np.where(cells >= 0, pairs.ranks[cells] << 6 | np.arange(width - 1, dtype=np.int32)[:, None], none)
    after = np.repeat(np.arange(1, width + 1), n).reshape(width, n)
    before = np.repeat(np.arange(-1, width - 1), n).reshape(width, n)
    flat, agenda_, after_, before_ = symbols.reshape(-1), agenda.reshape(-1), after.reshape(-1), before.reshape(-1)

    def meet(left: np.ndarray, right: np.ndarray, unit: np.ndarray) -> None:
        """The candidates of neighbouring parts at ``left`` and ``right``."""
        cell = pairs.find(flat[left * n + unit], flat[right * n + unit])
        agenda_[left * n + unit] = np.where(cell >= 0, pairs.ranks[cell] << 6 | left.astype(np.int32), none)

    while True:
        best = agenda.min(axis=0)
        unit = np.flatnonzero(best != none)
        if not len(unit):
            return
        i = (best[unit] & 63).astype(np.int64)
        at = i * n + unit
        j = after_[at]
        first = flat[at]
        piece = pairs.merged[pairs.find(first, flat[j * n + unit])]
        if limit:
            code = (i << 32 | pairs.sizes[first] << 16 | pairs.sizes[piece]).astype(np.uint64) * np.uint64(_A)
            skip = (hashing.mix(keys[unit] + code) >> np.uint64(48)) < limit
            agenda_[at[skip]] = none
            go = ~skip
            unit, i, at, j, piece = unit[go], i[go], at[go], j[go], piece[go]
        gone = j * n + unit
        k = after_[gone]
        flat[at], flat[gone], agenda_[gone], agenda_[at] = piece, -1, none, none
        after_[at] = k
        more = k < width
        before_[k[more] * n + unit[more]] = i[more]
        meet(i[more], k[more], unit[more])
        h = before_[at]
        more = h >= 0
        meet(h[more], i[more], unit[more])


def _segment(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bases: np.ndarray, places: np.ndarray, vocab: Vocabulary, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all units, number of pieces of each): units by start and size in ``chars``, with their documents' bases and their places there."""
    pairs = vocab.pairs
    owner = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    own = chars[starts[owner] + inside]
    hashes = np.add.reduceat(hashing.mix(own.astype(np.uint64) + inside.astype(np.uint64) * np.uint64(_A)), np.cumsum(sizes) - sizes)
    keys = hashing.mix((bases + places * np.uint64(_A)) ^ hashes)
    counts = np.zeros(len(starts), np.int64)
    held = []  # unit, what goes before its pieces in the unit, piece ids
    least = 0
    for width in WIDTHS:
        units = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        if not len(units):
            continue
        places_ = np.arange(width)[:, None]
        there = places_ < sizes[units]
        at = np.where(there, starts[units] + places_, 0)
        symbols = np.where(there, pairs.of_char[chars[at]], 0).astype(np.int64)
        _merge_all(symbols, keys[units], pairs, limit)
        unit, place = np.nonzero((there & (symbols >= 0)).T)
        ids = pairs.ids[symbols[place, unit]]
        n = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        code = chars[at[place[bare], unit[bare]]]
        n[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        if len(bare):
            spread = np.repeat(ids, n)
            low = np.concatenate([np.frombuffer(b"".join([vocab.packed_bytes[x] for x in chr(c).encode()]), np.uint16) for c in code.tolist()])
            spread[np.repeat(ids < 0, n)] = low
            unit, ids = np.repeat(unit, n), spread
        counts[units] = np.bincount(unit, minlength=len(units))
        held.append((units, unit, ids))
    for k in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
        text = chars[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-32-le")
        ids = np.frombuffer(_ids(_merge_long(text, vocab.scores, int(keys[k]), limit), vocab), np.uint16)
        counts[k] = len(ids)
        held.append((np.array([k]), np.zeros(len(ids), np.int64), ids))
    out, begin = np.zeros(counts.sum(), np.uint16), np.cumsum(counts) - counts
    for units, unit, ids in held:
        mine = counts[units]
        out[begin[units][unit] + np.arange(len(unit)) - (np.cumsum(mine) - mine)[unit]] = ids
    return out, counts


def encode_all(texts: Iterable[str | None], variants: Iterable[int], vocab: Vocabulary, *, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, number of pieces of each), with the customary space before a text."""
    limit = round(dropout * (1 << 16))
    texts = list(texts)
    total = np.zeros(len(texts), np.int64)
    flat: list[np.ndarray] = []

    def block(some: list[tuple[int, str, int]]) -> None:
        """Units begin where a text does, where newlines begin or end, and at the first of a run of spaces."""
        chars = np.frombuffer("".join(t for _, t, _ in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = np.cumsum([0] + [len(t) for _, t, _ in some])
        line, space = chars == 10, chars == 32
        begins = np.ones(len(chars), bool)
        begins[1:] = (line[1:] != line[:-1]) | (space[1:] & ~space[:-1])
        begins[heads[:-1]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(chars)))
        edges = np.searchsorted(starts, heads)
        text = np.repeat(np.arange(len(some)), np.diff(edges))
        places = (np.arange(len(starts)) - edges[text]).astype(np.uint64)
        bases = np.array([b for _, _, b in some], np.uint64)[text]
        for a in range(0, len(starts), BLOCK_UNITS):
            part = slice(a, a + BLOCK_UNITS)
            ids, counts = _segment(chars, starts[part], sizes[part], bases[part], places[part], vocab, limit)
            flat.append(ids)
            np.add.at(total, np.array([k for k, _, _ in some])[text[part]], counts)

    held, size = [], 0
    for k, (text, variant) in enumerate(zip(texts, variants, strict=True)):
        if text:
            held.append((k, " " + text, _base(seed, variant)))
            size += len(text)
        if size >= BLOCK_CHARS:
            block(held)
            held, size = [], 0
    if held:
        block(held)
    return np.concatenate([*flat, np.zeros(0, np.uint16)]), total


def encode(text: str, vocab: Vocabulary, *, seed: int, variant: int, dropout: float) -> np.ndarray:
    """Piece ids of one text; ``variant`` is the document's number."""
    return encode_all([text], [variant], vocab, seed=seed, dropout=dropout)[0]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text whose pieces these are."""
    return b"".join(map(vocab.raw.__getitem__, ids.tolist())).decode()[1:]


_VOCABULARIES: dict[int, Vocabulary] = {}


def _vocabulary_of(model: bytes) -> Vocabulary:
    """One per worker and model; what it keeps depends on nothing else."""
    key = xxhash.xxh3_64_intdigest(model)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = vocabulary(model)
    return _VOCABULARIES[key]


def _variant(doc_id: int | None, copy: int) -> int:
    """A document's number: of its id, and of which of its copies it is."""
    return xxhash.xxh3_64_intdigest(b"" if doc_id is None else str(doc_id).encode(), copy)


def encode_documents(docs: DataFrame, *, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT, copy: str | None = None) -> DataFrame:
    """doc_id, pieces (array of ids) of every document. ``copy``: the column with the copy numbers of repeated documents.

    ``model`` is read by the driver and sent along (its size is fixed).
    """
    proto = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary_of(proto)
        for b in batches:
            variants = map(_variant, b.column(0).to_pylist(), b.column(2).to_pylist())
            flat, counts = encode_all(b.column(1).to_pylist(), variants, vocab, seed=seed, dropout=dropout)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            pieces = pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32)), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), pieces], ["doc_id", "pieces"])

    number = F.coalesce(F.col(copy).cast("long"), F.lit(0)) if copy else F.lit(0)
    return docs.select(F.col("doc_id").cast("long"), "text", number.cast("long").alias("copy")).mapInArrow(run, "doc_id long, pieces array<int>")


def decode_documents(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, pieces, text: the texts that the pieces spell."""
    proto = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary_of(proto)
        for b in batches:
            texts = [None if p is None else decode(np.asarray(p.values, np.uint16), vocab) for p in _lists(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "pieces", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, pieces array<int>, text string")


def _lists(column: pa.ListArray) -> Iterator:
    for x in column:
        yield x if x.is_valid else None


def query(docs: DataFrame) -> DataFrame:
    """op9: digests of the pieces and of the text they decode to, beside the text's own."""
    decoded = decode_documents(encode_documents(docs))
    ids = F.concat_ws(",", F.transform("pieces", lambda x: x.cast("string")))
    return decoded.select("doc_id", F.coalesce(F.size(F.col("pieces")), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("pieces_sha256"), F.sha2("text", 256).alias("text_sha256"))

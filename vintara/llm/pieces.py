"""SentencePiece encoding and decoding: a forward pass over a trie of the distinct marked words.

A text is cut into marked words (a run of marks and what follows it; a line break apart), which no piece
crosses. The distinct words of a slice are sorted, which makes them the depth-first order of their trie:
a word keeps the forward states of the prefix it shares with the word before and works out the rest.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). For a BPE model it
is the last piece alone: exactly one piece that ends there is compatible with the state before it,
where two pieces are compatible if merging their concatenation by rank gives just these two. So the
same pass gives the library's ids for either kind of model, and maximal scores are not needed for BPE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vintara.llm.common import ragged, slices

MARK = "▁"
SLICE = 6 << 20
#: Compatible pairs that a Python worker remembers before it starts afresh.
REMEMBERED = 2_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass
class Pieces:
    """What a model file says: pieces, scores, kinds, and how a text is marked."""

    names: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    prefix: bool
    line_breaks: bool  # whether a piece holds a line break
    ids: dict[str, int] = field(init=False)
    bytes_of: list[int] = field(init=False)
    unknown: int = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        found = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE}
        self.bytes_of = [found[f"<0x{b:02X}>"] for b in range(256)] if found else []
        self.unknown = self.kinds.index(UNKNOWN)


def load(model_path: str) -> Pieces:
    """Read a model file; refuses what the marking here doesn't cover."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        proto.ParseFromString(file.read())
    n, names = proto.normalizer_spec, [p.piece for p in proto.pieces]
    kinds = [p.type for p in proto.pieces]
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models of identity normalisation with marks before words are covered")
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or 4 in kinds or 5 in kinds or any(MARK in p.lstrip(MARK) for p in names):
        raise ValueError("only unigram and BPE models without user-defined pieces, whose pieces don't cross words, are covered")
    return Pieces(names, [p.score for p in proto.pieces], kinds, proto.trainer_spec.model_type, n.add_dummy_prefix, any("\n" in p for p in names))


# --- marked words --------------------------------------------------------------------------------


def marked_words(text: str, pieces: Pieces) -> list[str]:
    """The words of a text as keys: a plain key lacks its single mark, a key after NUL is whole.

    The plain way holds for texts of single spaces; others go through a pattern.
    """
    if not text:
        return []
    if pieces.prefix and not pieces.line_breaks and text[0] != " " and not any(x in text for x in ("  ", " \n", MARK, "\0")):
        return text.replace("\n", " \n").split(" ")
    marked = (MARK if pieces.prefix else "") + text.replace(" ", MARK)
    pattern = f"{MARK}*[^{MARK}]+|{MARK}+" if pieces.line_breaks else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
    return ["\0" + w for w in re.findall(pattern, marked)]


def _whole(key: str) -> str:
    return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else MARK + key


# --- the forward pass ----------------------------------------------------------------------------


class Forward:
    """States of the prefixes of the current word, kept while the next word shares them."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.trie: dict = {}
        for piece, i in pieces.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.worst = min((pieces.scores[i] for i in pieces.ids.values()), default=0.0) - 10
        self.compatible: dict[tuple[int, int], bool] = {}

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys one after the other, and how many each has."""
        words = sorted((_whole(key), n) for n, key in enumerate(keys))
        found: list[list[int]] = [[]] * len(keys)
        bpe = self.p.model == BPE
        before, live = "", [[]]  # live[i]: pieces under way after i characters
        last, begin, best = [0], [0], [0.0]  # of the best path to i: last piece, where it begins, score
        for word, n in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del live[same + 1 :], last[same + 1 :], begin[same + 1 :], best[same + 1 :]
            for i in range(same, len(word)):
                c = word[i]
                on = [(j, child) for j, node in live[i] if (child := node.get(c)) is not None]
                if (child := self.trie.get(c)) is not None:
                    on.append((i, child))
                live.append(on)
                candidates = [(node[""], j) for j, node in on if "" in node]
                if not candidates or candidates[-1][1] != i:
                    candidates.append((-1 - ord(c), i))  # a character that is no piece
                if bpe:
                    for piece, j in candidates:
                        if j == 0 or self._fit(last[j], piece):
                            break
                    score = 0.0
                else:
                    score, piece, j = max((best[j] + (self.p.scores[piece] if piece >= 0 else self.worst), piece, j) for piece, j in candidates)
                last.append(piece), begin.append(j), best.append(score)
            before, path, i = word, [], len(word)
            while i:
                path.append(last[i])
                i = begin[i]
            found[n] = self._known(path[::-1])
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        return np.array([i for ids in found for i in ids], np.int32), np.array(list(map(len, found)), np.int64)

    def _known(self, path: list[int]) -> list[int]:
        if min(path) >= 0:
            return path
        if not self.p.bytes_of:  # neighbouring unknown characters are one unknown piece
            return [i for k, x in enumerate(path) if (i := x if x >= 0 else self.p.unknown) != self.p.unknown or not k or path[k - 1] >= 0]
        return [i for x in path for i in ([x] if x >= 0 else [self.p.bytes_of[b] for b in chr(-1 - x).encode()])]

    def _fit(self, left: int, right: int) -> bool:
        fits = self.compatible.get((left, right))
        if fits is None:
            a, b = (self.p.names[i] if i >= 0 else chr(-1 - i) for i in (left, right))
            fits = self.compatible[left, right] = self._merged(a + b) == [a, b]
        return fits

    def _merged(self, text: str) -> list[str]:
        """Merge by rank, leftmost first; short texts only."""
        parts, ids, scores = list(text), self.p.ids, self.p.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Decoder:
    def __init__(self, pieces: Pieces):
        name = lambda i: bytes([int(pieces.names[i][3:5], 16)]) if pieces.kinds[i] == BYTE else " ⁇ ".encode() if pieces.kinds[i] == UNKNOWN else pieces.names[i].replace(MARK, " ").encode() if pieces.kinds[i] == NORMAL else b""
        texts = [name(i) for i in range(len(pieces.names))]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array(list(map(len, texts)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.prefix = pieces.prefix

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of several id sequences that lie one after the other."""
        return [t[1:] if self.prefix and t[:1] == " " else t for t in self.pieces(ids, ends)]

    def pieces(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The same with the mark before the first word."""
        data = ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends]).astype(np.int64)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


# --- DataFrames ----------------------------------------------------------------------------------


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array of int), ``n_tokens``, ``exact`` (the ids decode to the text).

    Ids are the library's, without begin and end. A null text counts as empty and has no ids; a
    text that holds the mark itself decodes to spaces and isn't exact. Null and repeated
    ids stay, row by row; other columns are not read. The model (its pieces) is sent to the tasks whole:
    its size is that of the file. Rows leave a task in slices of some megabytes of text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model_path))
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        forward, decoder = Forward(pieces), Decoder(pieces)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices([range(n or 0) for n in pc.binary_length(column).to_pylist()], SLICE):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                ids, ends, exact = _encoded(texts, pieces, forward, decoder)
                for a, b in _pages(ends):
                    offsets = np.concatenate([[0], ends])[a : b + 1]
                    lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(ids[offsets[0] : offsets[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, b - a), lists, pa.array(np.diff(offsets), pa.int64()), pa.array(exact[a:b], pa.bool_())], ["id", "ids", "n_tokens", "exact"])

    schema = f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens bigint, exact boolean"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _pages(ends: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Stretches of rows of about ``limit`` ids."""
    cuts = np.flatnonzero(np.diff(ends // limit, prepend=0)) + 1
    edges = sorted({0, len(ends), *cuts.tolist()})
    return list(zip(edges[:-1], edges[1:]))


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _encoded(texts: list[str], pieces: Pieces, forward: Forward, decoder: Decoder) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Ids of the texts one after the other, where each ends, and whether its ids decode to it.

    Ids decode piece by piece, so a text's do if those of each of its words do; a mark of its own decodes to a space.
    """
    numbers, flat, counts = _Numbered(), [], []
    for text in texts:
        before = len(flat)
        flat.extend(map(numbers.__getitem__, marked_words(text, pieces)))
        counts.append(len(flat) - before)
    if not flat:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), [MARK not in t for t in texts]
    words = list(numbers)
    ids, lengths = forward.encode(words)
    wrong = np.array([d != _whole(w).replace(MARK, " ") for d, w in zip(decoder.pieces(ids, np.cumsum(lengths)), words)])
    at, last = np.array(flat, np.int64), np.cumsum(counts)
    total = lambda x: np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], last])]
    exact = [n == 0 and MARK not in t for n, t in zip(np.diff(total(wrong.astype(np.int64))).tolist(), texts)]
    return ragged(ids, (np.cumsum(lengths) - lengths)[at], lengths[at]), total(lengths)[1:], exact


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per sequence: id and ``text``. Null ids (the sequence or one of its items) decode to nothing."""
    sent = rows.sparkSession.sparkContext.broadcast(load(model_path))
    kept = rows.select(rows[id_col].alias("id"), rows[ids_col].cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            sequences = [[i for i in s or () if i is not None] for s in batch.column(1).to_pylist()]
            texts = decoder.decode(np.array([i for s in sequences for i in s], np.int64), np.cumsum(list(map(len, sequences))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    schema = f"id {kept.schema['id'].dataType.simpleString()}, text string"
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)

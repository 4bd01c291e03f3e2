"""Merge-type sentence pieces, encoded by backtracking instead of by a queue of merges.

A text's escaped form is cut before each run of space marks: no piece has a mark after another character, so no merge
crosses such a cut (checked against the vocabulary when it is loaded). In a part, Aho-Corasick gives the pieces that
start at each position; the longest is taken first. A piece may follow another if merging the characters of both again
leaves just these two; then the whole sequence is what merging leaves. Where no piece may follow, the position is struck
from a bitfield and the piece before is shortened. Runs of marks have pieces of equal score, for which agreement of
neighbours doesn't settle the order, and so parts with two or more marks are merged outright. Characters outside the
vocabulary are barriers that become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import small_batches

MARK = "▁"
PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
ENTRIES = 700_000  # of a worker's table of parts


class Parts(dict):
    """(ids joined by commas, decoded text) of parts, worked out when first asked for."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> tuple[str, str]:
        ids = self.pieces.encode_part(part)
        known = self[part] = (",".join(map(str, ids)), self.pieces.decode(ids, False))
        return known


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        probe = "a  BÄﬁ　\t"
        if any(MARK in p.lstrip(MARK) for p in self.ids) or model.normalize(probe) != MARK + probe.replace(" ", MARK) or len(self.bytes) != 256:
            raise ValueError(f"{path}: only merge-type pieces with byte pieces, a leading mark and no normalisation are handled")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts = Parts(self)

    def merged(self, text: str) -> list[str]:
        """What merging the best pair again and again leaves of text."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand right after a (a < 0: at a beginning)."""
        key = (a + 1) * 1_000_003 + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            y = self.text[b]
            known = self.pairs[key] = self.merged(y) == [y] if a < 0 else self.merged(self.text[a] + y) == [self.text[a], y]
        return known

    def backtrack(self, part: str, out: list[int]) -> None:
        n = len(part)
        starts: list[list[int]] = [[] for _ in range(n)]  # pieces by start, shorter ones first
        for end, (i, size) in self.automaton.iter(part):
            starts[end - size + 1].append(i)
        text, follows = self.text, self.follows
        at = 0
        while at < n:
            if not starts[at]:
                out.extend(self.bytes[b] for b in part[at].encode())
                at += 1
                continue
            stop = at + 1  # up to the next barrier
            while stop < n and starts[stop]:
                stop += 1
            open_ = (1 << (stop - at + 1)) - 1  # bit k: position at + k may still be reached
            took: list[int] = []
            rank: list[int] = []
            pos, k, last = at, len(starts[at]) - 1, -1
            while pos < stop:
                while k >= 0:
                    i = starts[pos][k]
                    end = pos + len(text[i])
                    if end <= stop and open_ >> (end - at) & 1 and follows(-1, i) and (last < 0 or follows(last, i)):
                        break
                    k -= 1
                if k >= 0:
                    took.append(i)
                    rank.append(k)
                    pos, last = end, i
                    if pos < stop:
                        k = len(starts[pos]) - 1
                    continue
                open_ &= ~(1 << (pos - at))
                if not took:
                    raise AssertionError("no sequence of pieces")
                pos -= len(text[took.pop()])
                k = rank.pop() - 1
                last = took[-1] if took else -1
            out.extend(took)
            at = stop

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        if MARK * 2 in part:
            for p in self.merged_long(part):
                i = self.ids.get(p)
                out.extend([i] if i is not None else [self.bytes[b] for b in p.encode()])
        else:
            self.backtrack(part, out)
        return out

    def merged_long(self, part: str) -> list[str]:
        """merged() in order n log n, for long runs of marks."""
        import heapq

        piece, left, right = list(part), list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(piece[a] + piece[b])) is not None:
                heapq.heappush(queue, (-s, a, piece[a] + piece[b]))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while queue:
            _, a, both = heapq.heappop(queue)
            b = right[a]
            if not piece[a] or b < 0 or piece[a] + piece[b] != both:
                continue
            piece[a], piece[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in piece if p]

    def encode(self, text: str) -> list[int]:
        return [i for part in PART.findall(MARK + text.replace(" ", MARK)) for i in self.encode_part(part)] if text else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; at the beginning of a text the leading space goes."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(loose(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.text[i].replace(MARK, " "))
        if run:
            out.append(loose(bytes(run)))
        said = "".join(out)
        return said[1:] if first and said.startswith(" ") else said


def loose(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that can't be read."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[k : k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded; with digests instead n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty, with no ids. Null ids and repeated rows stay; whole texts of any length are encoded; an
    empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            a, b, c = [], [], []
            if len(p.parts) > ENTRIES:
                p.parts.clear()
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                rows = list(map(p.parts.__getitem__, PART.findall(MARK + text.replace(" ", MARK)))) if text else []
                said = ",".join([r[0] for r in rows])
                back = "".join([r[1] for r in rows])[1:]
                if digests:
                    a.append(said.count(",") + 1 if said else 0)
                    b.append(hashlib.sha256(said.encode()).hexdigest())
                    c.append(hashlib.sha256(back.encode()).hexdigest())
                else:
                    a.append([int(x) for x in said.split(",")] if said else [])
                    b.append(back)
            cols = [pa.array(a, pa.int64()), pa.array(b), pa.array(c, pa.string())] if digests else [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row's ids. Null ids give null; a null among them raises."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            out = [None if ids is None else p.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    part = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, text string")

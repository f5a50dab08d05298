"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds every piece of a given model. It reads a text once; at each position the output
links name the pieces that end there, longest first, and each relaxes the best score of that position
from the one at its start. Characters that no piece covers fall back to bytes.

No piece continues behind a space mark that follows other characters, so a text's best segmentation
is that of its words in order; each worker remembers the words it has met.

The encoding is lossless: decode(encode(text)) is the text, a literal space mark (U+2581) included.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Memo, rows_of, slices, tool

MARK = "▁"
#: Bytes of the memo table of a worker, and moves by failure links that its automaton remembers.
MEMO_BYTES, MOST_MOVES = 150 << 20, 400_000


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so not every text has an encoding")
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        self.unknown = min(self.score.values()) - 10.0
        self.text = [self.piece.get(i, "").replace(MARK, " ") for i in every]
        self.whole_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.piece.values())
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._build()
        self.memo = Memo(lambda w: array("i", self.viterbi(w)[0]).tobytes(), MEMO_BYTES)

    def _build(self) -> None:
        """Goto and failure functions; ends[s] are the pieces that end in s, longest first: its own and those that its output links lead to."""
        self.goto: list[dict[str, int]] = [{}]
        self.out: list[tuple[int, float, int] | None] = [None]
        for i, piece in self.piece.items():
            state = 0
            for c in piece:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.out.append(None)
                state = self.goto[state][c]
            self.out[state] = (len(piece), self.score[i], i)
        self.fail, self.link, self.added = [0] * len(self.goto), [0] * len(self.goto), 0
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, to in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[to] = self.goto[back].get(c, 0)
                self.link[to] = self.fail[to] if self.out[self.fail[to]] else self.link[self.fail[to]]
                queue.append(to)
        self.ends = []
        for own, at in zip(self.out, self.link, strict=True):
            found = [own] if own else []
            while at:
                found.append(self.out[at])
                at = self.link[at]
            self.ends.append(tuple(found))

    def _step(self, state: int, c: str) -> int:
        """The state after a letter that ``state`` doesn't lead on by: by failure links, remembered as a move of its own."""
        back = state
        while back and c not in self.goto[back]:
            back = self.fail[back]
        to = self.goto[back].get(c, 0)
        if self.added < MOST_MOVES:
            self.goto[state][c] = to
            self.added += 1
        return to

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The ids and the score of the best segmentation of a marked text; ties go to the longer piece."""
        goto, ends, unknown = self.goto, self.ends, self.unknown
        best, chosen, state = [0.0], [None], 0
        for end, c in enumerate(text, 1):
            to = goto[state].get(c)
            state = self._step(state, c) if to is None else to
            top, how = best[-1] + unknown, None
            for piece in ends[state]:
                if (value := best[end - piece[0]] + piece[1]) > top:
                    top, how = value, piece
            best.append(top)
            chosen.append(how)
        ids: list[int] = []
        end = len(text)
        while end:
            how = chosen[end]
            if how is None:
                ids += [self.bytes[b] for b in reversed(text[end - 1].encode())]
                end -= 1
            else:
                ids.append(how[2])
                end -= how[0]
        return ids[::-1], best[-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: a mark stands before it and for every space."""
        if not text:
            return np.empty(0, np.int32)
        if MARK in text:  # spelt in bytes, so that it isn't taken for a space
            mark = [self.bytes[b] for b in MARK.encode()]
            ids: list[int] = []
            for n, part in enumerate(text.split(MARK)):
                ids += mark * (n > 0) + self.viterbi((MARK if not n else "") + part.replace(" ", MARK))[0]
            return np.asarray(ids, np.int32)
        marked = MARK + text.replace(" ", MARK)
        if not self.whole_words:
            return np.asarray(self.viterbi(marked)[0], np.int32)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, WORDS.findall(marked))), np.int32)

    def decode(self, ids: list[int]) -> str:
        parts = [self.text[i] for i in ids]
        if any(i in self.byte_of for i in ids):
            raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in zip(ids, parts, strict=True))
            text = raw.decode("utf-8", "replace")
        else:
            text = "".join(parts)
        return text[1:] if text[:1] == " " else text


WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def pieces(path: str) -> Pieces:
    return tool(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of (doc_id, text): null and empty texts have no ids.

    Null ids and repeated rows are encoded like others, very long texts whole; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    path = model or default_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in slices(batches):
            ids = [p.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=["doc_id", "ids"])

    return rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) → doc_id, text. Null ids give an empty text."""
    path = model or default_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows_of(encoded, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, lossless of every row: encoded and decoded again in one pass.

    Odd rows are treated as by :func:`encode`.
    """
    path = model or default_model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [p.encode(t) for t in texts]
            decoded = [p.decode(i.tolist()) for i in ids]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(decoded, pa.string()), pa.array([d == t for d, t in zip(decoded, texts, strict=True)])],
                names=["doc_id", "n_ids", "ids", "decoded", "lossless"],
            )

    made = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded string, lossless boolean")
    return made.select("doc_id", "n_ids", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")

"""Token ids of whole texts, from a given tokenizer file, one memo table a worker.

The tokenizer splits at white space before anything else, so the ids of a text are those of its
white-space chunks in order. Chunks repeat, so each worker keeps the packed ids of those it has
met. New ones are merged by a rank table of byte strings where :meth:`ChunkEncoder.ranks` proves that it
must give the file's own merges, else by the tokenizer. Texts with characters whose treatment depends on
their neighbours (combining marks, rare spaces, special tokens) go through the tokenizer as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np

from quire.llm.common import Memo, tool

#: Characters that are their own NFC form, lower-case one by one and are plain white space if any.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿĀ-įĲ-ňŊ-ž«»“”‘’–—…¿¡€£§°]*")

#: Bytes of the memo table of a worker, and chunks that reach the tokenizer in one call.
MEMO_BYTES, CALL = 40 << 20, 16_384
#: The pieces of a chunk in plain characters, as the file's own pattern splits it.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a word; no byte of UTF-8.
END = b"\xff"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        ranks = self.ranks(json.loads(self.tokenizer.to_str()))
        self.merged = None if ranks is None else _merger(ranks)
        self.memo = Memo(self.whole if ranks is None else self.quick, MEMO_BYTES)

    @staticmethod
    def ranks(file: dict) -> dict[bytes, int] | None:
        """The id of every token as bytes, if merging whatever adjacent parts make the token of least id gives the file's merges.

        That holds where ids of merged tokens rise in the order of the merges and every token, merged by the
        rules before its own, comes to the two parts of its own rule: what tiles a token in some word then
        has come to those parts too. None for files of another kind.
        """
        model, vocab = file["model"], file["model"]["vocab"]
        splits = [p for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or [p["pattern"] for p in splits] != [{"Regex": PATTERN}] or kinds != ["NFC", "Replace", "Lowercase"]:
            return None
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letter = {chr(b): bytes([b]) for b in printed} | {chr(256 + n): bytes([b]) for n, b in enumerate(b for b in range(256) if b not in printed)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rule = {pair: n for n, pair in enumerate(pairs)}
        ids = [vocab.get(a + b, -1) for a, b in pairs]
        base = [*letter, *(c + "</w>" for c in letter)]
        if any(c not in vocab for c in base) or any(x >= y for x, y in zip([max(vocab[c] for c in base), *ids], ids)) or max(vocab[c] for c in letter) >= min(vocab[c + "</w>"] for c in letter):
            return None
        for n, (a, b) in enumerate(pairs):
            word = a + b
            parts = [*word[:-5], word[-5] + "</w>"] if word.endswith("</w>") else [*word]
            while len(parts) > 1:
                best, at = min((rule.get(pair, n), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if best >= n:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if parts != [a, b]:
                return None
        spelt = lambda token: b"".join(letter[c] for c in token.removesuffix("</w>")) + END * token.endswith("</w>")
        return {spelt(t): vocab[t] for t in [*base, *(a + b for a, b in pairs)]}

    def quick(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one piece
            return array("I", self.merged(chunk.encode() + END)).tobytes()
        ids = array("I")
        for piece in PIECE.findall(chunk):
            ids.extend(self.merged(piece.encode() + END))
        return ids.tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids of chunks, many in a call: the tokenizer tells which of them an id is from."""
        rest = iter(chunks)
        while some := list(islice(rest, CALL)):
            made = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.asarray(made.ids, dtype="<u4").tobytes(), np.asarray(made.word_ids, dtype=np.int64)
            ends = 4 * np.searchsorted(of, np.arange(len(some) + 1))
            for chunk, start, end in zip(some, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                self.memo.keep(chunk, ids[start:end])

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not self.specials.search(text):
            return b"".join(map(self.memo.__getitem__, text.lower().split()))
        return self.whole(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; where the tokenizer has to be asked, all chunks that are new to this worker in one call."""
        chunks = [text.lower().split() if PLAIN.fullmatch(text) and not self.specials.search(text) else None for text in texts]
        if self.merged is None:
            self.learn({c for c in set().union(*filter(None, chunks)).difference(self.memo) if len(c) <= Memo.LONGEST})
        get = self.memo.__getitem__
        return [self.whole(text) if cs is None else b"".join(map(get, cs)) for text, cs in zip(texts, chunks, strict=True)]


def _merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """Ids of a piece: adjacent parts are merged, that to the least id first."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def encoder(path: str) -> ChunkEncoder:
    return tool(("tokens", path), lambda: ChunkEncoder(path))

"""Exact, memoised encoding with the tokenizers library.

A text is cut where no merge can cross, each distinct piece goes through the library once
per worker process (up to MEMO pieces), and the ids of a text are the concatenation. Cuts are
made before ASCII white space that follows something else, so pre-tokenisation, case
folding and normalisation see nothing across a cut. Texts with white space outside ASCII are
given to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

#: Most pieces that a worker process remembers unless it is told otherwise; others are encoded each time.
MEMO = 100_000
#: UTF-8 of the white space outside ASCII (the 0x80 block is covered by its prefix).
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: In a text with one of these, pieces are cut by the slower exact pattern.
UNUSUAL = (b"  ", b" \n", b"\n\n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
CUT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
GROUP = 2000


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, equal to the library's."""

    def __init__(self, path: str, lossless: bool, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.lossless = lossless
        self.most = most
        self.memo: dict[bytes, bytes] = {}
        self.exact: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for k, v in vocab.items():
            self.tokens[v] = k.encode()
        self.token_chars = np.zeros(len(self.tokens), dtype=np.int64)
        for k, v in vocab.items():
            self.token_chars[v] = len(k)
        if not lossless:
            mark = self.tok.encode("\x00", add_special_tokens=False).ids
            assert len(mark) == 1
            self.mark = mark[0]

    def whole(self, text: bytes) -> bytes:
        """By one call of the library."""
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _many(self, raw: list[bytes]) -> list[bytes]:
        """ids of each piece; neighbours share a call where their ids can be told apart afterwards."""
        out: list[bytes] = [b""] * len(raw)
        if self.lossless:
            shared = [i for i, p in enumerate(raw) if p[:1] in b" \n\t\r\x0b\x0c" and p.strip() and len(p) < 4096]
        else:
            shared = [i for i, p in enumerate(raw) if b"\x00" not in p and len(p) < 4096]
        rest = set(range(len(raw))).difference(shared)
        for at in range(0, len(shared), GROUP):
            part = shared[at : at + GROUP]
            texts = [raw[i] for i in part]
            joined = b"".join(texts) if self.lossless else b" \x00 ".join(texts)
            ids = np.array(self.tok.encode_batch_fast([joined.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.lossless:
                ends = np.searchsorted(np.cumsum(self.token_chars[ids]), np.cumsum([len(p) for p in texts])) + 1
                starts = np.concatenate([[0], ends[:-1]])
            else:
                marks = np.flatnonzero(ids == self.mark)
                starts, ends = np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(ids)]])
            blob = ids.tobytes()
            for i, s, e in zip(part, (starts * 4).tolist(), (ends * 4).tolist()):
                out[i] = blob[s:e]
        for i in rest:
            out[i] = self.whole(raw[i])
        return out

    def _cut(self, text: bytes) -> tuple[list[bytes], bool] | None:
        """Pieces and whether they are keys of the common memo; None for texts that stay whole."""
        if any(x in text for x in WIDE_SPACE):
            return None
        if not self.lossless:
            return text.split(), True
        if text[:1] in b" \n\t\r\x0b\x0c" or text[-1:] in b" \n" or any(x in text for x in UNUSUAL):
            return CUT.findall(text), False
        # the key of a piece is what follows its space; one that follows a line break keeps that; the first has a zero byte in front
        keys = text.replace(b"\n", b" \n").split(b" ")
        keys[0] = b"\x00" + keys[0]
        return keys, b"\x00" not in text

    def _raw(self, key: bytes) -> bytes:
        if not self.lossless or key[:1] == b"\n":
            return key
        return key[1:] if key[:1] == b"\x00" else b" " + key

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text; each piece that isn't remembered goes through the library once for all texts."""
        out: list[bytes] = [b""] * len(texts)
        usual: tuple[list[bytes], list[tuple[int, int]]] = ([], [])
        unusual: tuple[list[bytes], list[tuple[int, int]]] = ([], [])
        for i, text in enumerate(texts):
            cut = self._cut(text) if text else ([], True)
            if cut is None or (self.lossless and cut[1] is False and cut[0] and cut[0][0][:1] == b"\x00"):
                out[i] = self.whole(text)
                continue
            keys, owners = usual if cut[1] else unusual
            owners.append((i, len(keys)))
            keys += cut[0]
        for (keys, owners), memo, raw in ((usual, self.memo, self._raw), (unusual, self.exact, lambda k: k)):
            found = list(map(memo.get, keys))
            missing = [j for j, ids in enumerate(found) if ids is None]
            if missing:
                lost = dict.fromkeys([keys[j] for j in missing])
                lost.update(zip(list(lost), self._many([raw(k) for k in lost])))
                for j in missing:
                    found[j] = lost[keys[j]]
                room = self.most - len(memo)
                if room > 0:
                    memo.update(lost if len(lost) <= room else islice(lost.items(), room))
            ends = [at for _, at in owners[1:]] + [len(keys)]
            for (i, at), end in zip(owners, ends):
                out[i] = b"".join(found[at:end])
        return out

    def decode(self, ids: bytes) -> bytes:
        """As the library's decode(ids, skip_special_tokens=False) of a vocabulary without a decoder: tokens with spaces between."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_open: dict[tuple[str, bool, int], PieceEncoder] = {}


def encoder(path: str, lossless: bool, most: int = MEMO) -> PieceEncoder:
    """This process's encoder of a vocabulary file."""
    if (path, lossless, most) not in _open:
        _open[path, lossless, most] = PieceEncoder(path, lossless, most)
    return _open[path, lossless, most]

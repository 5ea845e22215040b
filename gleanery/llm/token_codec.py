"""Byte-level BPE ids for whole texts, with the ids of each word made once per worker.

``tokenizers`` does the encoding. The split in front of it is exact: byte-level BPE
never lets a token cross from a non-space character to a space or line break, so text
is cut there, each distinct piece is encoded by the library once, and the ids are
gathered with numpy. Texts with runs of white space, unusual white space or control
characters go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.shared import take_cache

#: Production tokenizer file; a parameter of every operator that encodes.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"

_SEPARATOR = "\x00"
#: RE2: runs of white space, NUL, white space other than space and line break, or a
#: point or comma that ends a word but follows no letter or digit.
_ODD = r"[ \n][ \n]|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]$|[^\pL\pN][.,][ \n]|^[.,][ \n]"
#: Where even texts are cut: (found, put in its place), in this order.
_CUTS = [(f"{p}{w}", f"{_SEPARATOR}{p}{w}") for p in ".," for w in " \n"] + [(" ", f"{_SEPARATOR} "), ("\n", f"{_SEPARATOR}\n{_SEPARATOR}")]


def tokenizer_path(name_or_path: str = DEFAULT_TOKENIZER) -> str:
    """A path stays as it is; a bare name is a file of the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


class PieceEncoder:
    """Ids of texts; at most ``keep`` pieces are remembered (a bound on memory, not on texts)."""

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(tokenizer_path(path))
        self.library.encode_special_tokens = True
        #: For lists of words, each of which is one unit for the merges: no pattern is matched.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.opens[[v for k, v in vocabulary.items() if k.startswith("\u0120")]] = True
        self.keep, self.known = keep, {}
        self.line = self.whole("\n")[0]
        self.exact = self.whole("a\n b, c") == [i for x in ("a", "\n", " b", ",", " c") for i in self.whole(x)]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        known, width = self.known, self.kind.itemsize
        spaced = [x for x in new if x[:1] == " " and x[1:].isalpha()]
        if spaced:
            ids = np.array(self.words.encode_batch_fast(["\n".join(spaced)], add_special_tokens=False)[0].ids, self.kind)
            cut = (np.flatnonzero(self.opens[ids]) * width).tolist()
            if len(cut) == len(spaced):
                raw = ids.tobytes()
                known.update(zip(spaced, [raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)])]))
        if mixed := [x for x in new if x not in known and x.strip()]:
            ids = np.array(self.whole("\n".join(mixed)), self.kind)
            cut = (np.flatnonzero(ids == self.line) * width).tolist()
            if len(cut) == len(mixed) - 1:
                raw = ids.tobytes()
                known.update(zip(mixed, [raw[a:b] for a, b in zip([0, *(x + width for x in cut)], [*cut, len(raw)])]))
        for x in new:
            if x not in known:
                known[x] = np.array(self.whole(x), self.kind).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        if new := [x for x in pieces if x not in known]:
            self._learn(new)
        return [known[x] for x in pieces]

    def _gather(self, raw: bytes, sizes: np.ndarray, codes: np.ndarray, wide: int = 8) -> np.ndarray:
        """Ids of the pieces ``codes``; pieces lie one after another in ``raw``, in rows of ``wide`` here."""
        rows = -(-sizes // wide)
        first = np.cumsum(rows) - rows
        filled = np.full(int(rows.sum()), wide, np.int8)
        some = rows > 0
        filled[(first + rows - 1)[some]] = (sizes - (rows - 1) * wide)[some]
        inside = np.arange(wide, dtype=np.int8) < filled[:, None]
        pool = np.zeros(inside.shape, self.kind)
        pool[inside] = np.frombuffer(raw, self.kind)
        if len(rows) and (rows.max() > 1 or not some.all()):
            each = rows[codes]
            ends = np.cumsum(each)
            codes = np.repeat(first[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pool[codes][inside[codes]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets: text i has ids[offsets[i]:offsets[i + 1]])."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.exact else np.ones(n, bool)
        out: list[np.ndarray | None] = [None] * n
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.whole(texts[int(i)].as_py()), self.kind)
        even = np.flatnonzero(~odd)
        if len(even):
            cut = texts.take(pa.array(even))
            for found, put in _CUTS:
                cut = pc.replace_substring(cut, found, put)
            lists = pc.split_pattern(cut, _SEPARATOR)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            del cut, lists
            raw = self._pieces(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
            at = np.concatenate(([0], np.cumsum(sizes[codes])))[bounds]
            ids = self._gather(b"".join(raw), sizes, codes)
            if len(even) == n:
                return ids, at
            for k, i in enumerate(even):
                out[i] = ids[at[k] : at[k + 1]]
        offsets = np.zeros(n + 1, np.int64)
        offsets[1:] = np.cumsum([len(x) for x in out])
        return (np.concatenate(out) if n else np.zeros(0, self.kind)), offsets


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    take_cache(f"encoder {path}", _encoders[path].known.clear)
    return _encoders[path]

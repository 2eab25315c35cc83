"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pretoken there is exactly one token that ends its encoding. Tokens that
are suffixes of the prefix come from an automaton over the vocabulary; one of them is the last
token when it may stand after the last token of the prefix that it leaves. Following these
back-pointers gives the ids. Only pretokens not met before are worked out."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import table

#: White space as the byte-level pre-tokenizer sees it, and its pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Pieces that one cache of a worker remembers, and their greatest length: together they bound its
#: bytes (some 60 MB). Longer pieces are worked out each time.
CACHE_ENTRIES = 100_000
CACHED_LENGTH = 48
#: Texts are encoded together up to this many bytes; a longer one is encoded alone.
SLICE_BYTES = 8 << 20
#: Below this code point a text of letters is one run of the pattern, whatever the Unicode version.
LATIN = "\u0250"
FAR = 1 << 60


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible bytes stand for themselves,
    the others for the code points from 256 on, in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    symbols = byte_symbols()
    return {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items()}


class Pieces(dict):
    """Text piece -> packed ids, worked out when first asked for. Two generations bound the
    memory: when the young one is full it becomes the old one, and what is used again moves back."""

    def __init__(self, work):
        self.work, self.old = work, {}

    def __missing__(self, piece):
        if len(piece) > CACHED_LENGTH:
            return self.work(piece)
        out = self.old.get(piece)
        if out is None:
            out = self.work(piece)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Uneven(Exception):
    """A blank touches other white space or an end of the text."""


class PieceCodec:
    """Cuts texts at added tokens and at blanks; :meth:`split` encodes what lies between.

    A blank before a visible character always begins a pretoken, so the parts between single
    blanks can be encoded (and remembered) one by one. Other texts go to :meth:`split` whole."""

    def __init__(self, spec: dict):
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.at_start = Pieces(lambda piece: self._even(piece, ""))
        self.after_blank = Pieces(lambda piece: self._even(piece, " "))

    def split(self, text: str) -> bytes:
        raise NotImplementedError

    def _even(self, piece: str, before: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Uneven
        return self.split(before + piece)

    def _plain_text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.at_start[first] + b"".join(map(self.after_blank.__getitem__, rest))
        except Uneven:
            return self.split(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of added tokens are those tokens."""
        text = text or ""
        if self.cut is None or not self.cut.search(text):
            return self._plain_text(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain_text(text[at : m.start()]), pack([self.added[m[0]]])]
            at = m.end()
        return b"".join([*out, self._plain_text(text[at:])])


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and are ``n`` long, one run after another."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class ByteBpe(PieceCodec):
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__(spec)
        self.bytes_of, vocab = token_bytes(spec), spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), (n, made))
            self.made_of.setdefault(made, (n, a, b))
        self.sound: dict[int, bool] = {}
        #: Only tokens that their own bytes encode to can end an encoding.
        self.id_of = {b.decode("latin-1"): i for i, b in self.bytes_of.items() if self.whole(i)}
        #: Token -> token before it -> whether it may follow that one; and how many such pairs are known.
        self.after: dict[int, dict[int, bool]] = {i: {} for i in self.id_of.values()}
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t, (len(t), i, self.after[i]))
        self.automaton.make_automaton()
        for t, i in self.added.items():
            self.bytes_of.setdefault(i, t.encode())
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        #: All tokens' bytes in a row, and where each token's begin and how many they are.
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)), np.uint8)
        self.size = np.array([self.length.get(i, 0) for i in range(max(self.bytes_of) + 1)], np.int32)
        self.at = np.cumsum(self.size, dtype=np.int32) - self.size
        self.pretokens = Pieces(self._ids)

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``."""
        known = self.after[b].get(a)
        if known is None:
            if self.pairs >= 2 * CACHE_ENTRIES:
                for seen in self.after.values():
                    seen.clear()
                self.pairs = 0
            self.after[b][a] = known = (a, b) not in self.rank and self._holds(a, b)
            self.pairs += 1
        return known

    def _holds(self, a: int, b: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that build
        them. Walks both tokens' pieces at the border from bytes upwards, in merge order; of
        equal ranks the one further left comes first."""
        left, right, i, j = self._border(a, 2), self._border(b, 1), 0, 0
        while True:
            x, up_x = left[i]
            y, up_y = right[j]
            if up_x == up_y == FAR:
                return True
            across = self.rank.get((x, y))
            if across and across[0] < up_x and across[0] <= up_y:
                return False
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces of a token at one border from its byte to itself, each with the rank of
        the merge that takes it up."""
        out, up = [], FAR
        while True:
            out.append((token, up))
            made = self.made_of.get(token)
            if made is None:
                return out[::-1]
            up, token = made[0], made[side]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        known = self.sound.get(token)
        if known is None:
            made = self.made_of.get(token)
            known = made is None or self.whole(made[1]) and self.whole(made[2]) and self._holds(made[1], made[2])
            self.sound[token] = known
        return known

    def _ids(self, pretoken: str) -> bytes:
        data = pretoken if pretoken.isascii() else pretoken.encode("utf-8").decode("latin-1")
        if (token := self.id_of.get(data)) is not None:
            return pack([token])
        # the token that ends the encoding of each prefix, by the place of its last byte
        last, fits = [-1] * len(data), self.fits
        for end, (n, token, after) in self.automaton.iter(data):
            if last[end] < 0:
                if n > end:
                    last[end] = token
                elif (before := last[end - n]) >= 0:
                    known = after.get(before)
                    if known or known is None and fits(before, token):
                        last[end] = token
        out, at, length = [], len(data) - 1, self.length
        while at >= 0:
            if (token := last[at]) < 0:
                raise ValueError("the vocabulary lacks a token for a byte")
            out.append(token)
            at -= length[token]
        out.reverse()
        return pack(out)

    def _even(self, piece: str, before: str) -> bytes:
        # such a piece is one pretoken, which the cache of pieces remembers
        if piece.isascii() and piece.isalpha():
            return self._ids(before + piece)
        return super()._even(piece, before)

    def split(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, PRETOKEN.findall(text)))

    def _unit(self, piece: str, before: str) -> bytes | None:
        """The ids of a piece between single blanks; none where white space touches its ends."""
        if piece.isalpha():
            return self.pretokens[before + piece] if max(piece) < LATIN else self.split(before + piece)
        return None if not piece or piece[0].isspace() or piece[-1].isspace() else self.split(before + piece)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """:meth:`encode` of each text. Pieces between blanks that texts share are encoded once for
        all texts of a slice, and each text's ids are gathered from them."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(ends, SLICE_BYTES + (ends[at - 1] if at else 0), "right"))
            stop = max(stop, at + 1)
            yield from self._slice(texts[at:stop])
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        parts = pc.split_pattern(texts, " ")
        row_of = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
        pieces = pc.list_flatten(parts).dictionary_encode()
        units = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = pieces.dictionary.to_pylist()
        # a text begins without a blank, so its first piece is a unit of its own
        begins = np.searchsorted(row_of, np.arange(len(texts) + 1))
        firsts, place = np.unique(units[begins[:-1]], return_inverse=True)
        packed = [self._unit(w, " ") for w in words] + [self._unit(words[k], "") for k in firsts]
        units[begins[:-1]] = len(words) + place
        uneven = np.zeros(len(texts), bool)
        uneven[row_of[np.array([p is None for p in packed])[units]]] = True
        for t in self.added:
            uneven |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        n = np.array([len(p or b"") // 4 for p in packed])
        first, ids = np.cumsum(n) - n, np.frombuffer(b"".join(p or b"" for p in packed), "<u4")
        for k in range(len(texts)):
            if uneven[k]:
                yield self.encode(texts[k].as_py())
            else:
                here = units[begins[k] : begins[k + 1]]
                yield ids[_ragged(first[here], n[here])].tobytes()

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        return self.flat[_ragged(self.at[ids], self.size[ids])].tobytes().decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One codec for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and
    ``ids`` (little-endian unsigned 32-bit) unless ``with_ids`` is off.

    A map over Arrow batches without a shuffle: memory is one batch, one slice's pieces and caches of bounded bytes.
    Null text counts as empty (no tokens). Whole texts are encoded, however long; repeated rows
    and ids give a row each; an empty table gives no rows; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for packed in bpe.encode_all(batch.column(1)):
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(packed).encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(packed)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)

"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of its last 32 bytes says so. Each distinct chunk is
encoded once a worker (chunks that documents share are met again by their digest), and the
joins are repaired: from the last sure boundary of the left chunk to the first of the right
one the text is encoded anew, and the stretch grows until its ends agree with what the
chunks hold. A boundary is sure between a non-blank and a blank: the byte-level
pre-tokenizer never joins across it, whatever else surrounds it, and no token or special
token spans it.

The memory of chunks is bounded and gives up the least recently used, so a worker's memory
does not grow with the input; the scan has no shuffle. The vocabulary file's path is a parameter,
read on each executor.

Defined cases: null texts are empty; the empty text has no tokens; special tokens' strings
in a text become special tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common as C
from .substring_dedup import cut_points

#: Fixed value: the characters of Unicode's property White_Space, the blanks of the pre-tokenizer.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first and the last sure boundary of a text: between a non-blank and a blank.
FIRST = re.compile(f"[^{BLANKS}](?=[{BLANKS}])")
LAST = re.compile(f".*[^{BLANKS}](?=[{BLANKS}])", re.DOTALL)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Piece(NamedTuple):
    """An encoded stretch: how many ids, their decimals joined by commas, the bytes they decode to."""

    count: int
    decimals: bytes
    decoded: bytes


def joined(pieces: list[Piece]) -> Piece:
    full = [p for p in pieces if p[0]]
    if not full:
        return Piece(0, b"", b"")
    count, decimals, decoded = zip(*full)
    return Piece(sum(count), b",".join(decimals), b"".join(decoded))


class ChunkCodec:
    """Encodes and decodes texts with a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, chunk_memory: int = 4_000):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbols, vocabulary = byte_of_symbol(), file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        of_special = set(self.special.values())
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *of_special]))
        for token, i in [*vocabulary.items(), *self.special.items()]:
            self.bytes[i] = token.encode() if i in of_special else bytes(symbols[c] for c in token)
        self.decimals = [str(i) for i in range(len(self.bytes))]
        self.fast = self.rank_encoder(file)
        self.chunks: OrderedDict[bytes, list] = OrderedDict()  # least recently used first
        self.chunk_memory = chunk_memory
        self.encoded_chunks = self.met_chunks = 0

    @cached_property
    def tokenizer(self):
        """The library's own encoder, only loaded where it is needed."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def rank_encoder(self, file: dict):
        """The same encoding by merge ranks, several times as fast; None where the file asks for more than it can do."""
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        tokens = [t for t in file.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if not plain or not level or tokens or file.get("normalizer") or merged != sorted(merged):
            return None
        import tiktoken

        special = set(self.special.values())
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def library_ids(self, strings: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return [self.fast.encode(s, allowed_special="all") if any(t in s for t in self.special) else self.fast.encode_ordinary(s) for s in strings]

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text as UTF-8; bytes that are no UTF-8 become replacement characters, as in the library."""
        return self.raw(ids).decode("utf-8", "replace").encode()

    def cut(self, text: bytes):
        """The chunks of a text as [head, inner, tail]: head ends at the first sure boundary inside, tail begins at the last.

        inner is a Piece, or text that is to be encoded. A chunk without a sure boundary is all head, its inner None.
        """
        last = 0
        for at in cut_points(text, shortest=512, bits=9, longest=8192):
            while at < len(text) and text[at] & 0xC0 == 0x80:  # not inside a character
                at += 1
            if at <= last:
                continue
            chunk, last = text[last:at], at
            key = xxhash.xxh3_128_digest(chunk)
            got = self.chunks.get(key)
            self.met_chunks += 1
            if got is None:
                if len(self.chunks) >= self.chunk_memory:
                    self.chunks.popitem(last=False)
                s = chunk.decode()
                first = FIRST.search(s)
                if first is None:
                    got = [s, None, ""]
                else:
                    i, j = first.end(), LAST.match(s).end()
                    got = [s[:i], s[i:j], s[j:]]
                self.chunks[key] = got
                self.encoded_chunks += 1
            else:
                self.chunks.move_to_end(key)
            yield got

    def encode_pieces(self, texts: list[bytes]) -> list[Piece]:
        """The encoding of each text. What is new in all of them goes to the library at once."""
        plans, new = [], {}
        for text in texts:
            plan: list = []  # strings to encode, and chunks whose inner is known or among those
            open_ = ""  # text since the last sure boundary
            for chunk in self.cut(text):
                open_ += chunk[0]
                if chunk[1] is None:
                    continue  # no sure boundary yet: the stretch grows
                # Repair: the stretch across the join is encoded anew between two sure boundaries.
                plan += [open_, chunk]
                new[open_] = None
                if isinstance(chunk[1], str):
                    new[chunk[1]] = None
                open_ = chunk[2]
            if open_:
                plan.append(open_)
                new[open_] = None
            plans.append(plan)
        strings = list(new)
        decimal = self.decimals.__getitem__
        for s, ids in zip(strings, self.library_ids(strings)):
            new[s] = Piece(len(ids), ",".join(map(decimal, ids)).encode(), self.raw(ids))
        out = []
        for plan in plans:
            pieces = []
            for x in plan:
                if isinstance(x, str):
                    pieces.append(new[x])
                else:
                    if isinstance(x[1], str):
                        x[1] = new[x[1]]
                    pieces.append(x[1])
            out.append(joined(pieces))
        return out

    def encode(self, text: bytes) -> list[int]:
        decimals = self.encode_pieces([text])[0].decimals
        return list(map(int, decimals.split(b","))) if decimals else []


_codecs: dict[str, ChunkCodec] = {}


def codec_of(path: str) -> ChunkCodec:
    """A worker's codec: its memories outlive a task, so that later tasks meet known chunks."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with texts, also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for piece in codec.encode_pieces(C.texts_of(part.column(1))):
                    back = piece.decoded.decode("utf-8", "replace")
                    n.append(piece.count)
                    ids_sha.append(hashlib.sha256(piece.decimals).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if texts:
                        all_ids.append(list(map(int, piece.decimals.split(b","))) if piece.count else [])
                        decoded.append(back)
                cols = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.record_batch(cols | ({"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())} if texts else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")
    return C.id_text(docs).mapInArrow(C.lean_map(run), schema)

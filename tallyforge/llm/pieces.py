"""SentencePiece encoding and decoding with byte offsets into the original text.

A text is normalised by longest-prefix matching in the character map that is
compiled into the model (a double-array trie whose leaves point at replacement
strings). Each normalised byte remembers the original byte it came from, so
each piece of the encoding projects to a span of original bytes.

Where the map is empty and no vocabulary piece has a space mark after another
character, no merge crosses the start of a run of spaces. Then the words of a
text are encoded apart, and a bounded cache in each Python worker keeps the
words already seen.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, tokenizer_path

SPACE = "▁"
#: Words of each of a worker's two generations: a full one becomes the older, and what is met again moves to the younger.
CACHE_WORDS = 200_000


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes, and the replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at a byte, or None."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = self._base(unit)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_len(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Text to normalised bytes, with the original offset of each of them."""

    def __init__(self, charmap: CharMap, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.charmap, self.dummy_prefix, self.squeeze = charmap, dummy_prefix, squeeze
        self.space = SPACE.encode() if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes; for each of them and for the end, an offset in the input."""
        steps, at = [], 0
        while at < len(text):
            hit = self.charmap.longest(text, at)
            size, new = hit or (_char_len(text[at]), None)
            steps.append((at, text[at : at + size] if new is None else new))
            at += size
        if self.squeeze:
            while steps and steps[0][1].strip(b" ") == b"":
                steps.pop(0)
        out, origin = bytearray(), []
        first = steps[0][0] if steps else len(text)
        if self.dummy_prefix and steps:
            out += self.space
            origin += [first] * len(self.space)
        after_space = self.squeeze
        for source, new in steps:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            for k in range(len(new)):
                put = self.space if new[k] == 0x20 else new[k : k + 1]
                out += put
                origin += [source] * len(put)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
        end = len(text)
        if self.squeeze:
            while out.endswith(self.space):
                end = origin[len(out) - len(self.space)]
                del out[-len(self.space) :], origin[-len(self.space) :]
        return bytes(out), [*origin, end]


class Codec:
    """One model in one worker: ids and spans of texts, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            blob = f.read()
        model = pb.ModelProto.FromString(blob)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = model.normalizer_spec
        self.normalize = Normalizer(CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.by_word = model.trainer_spec.byte_fallback and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix and not any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces) and all(p.type != pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        self.byte_ids = {i for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
        self.names = [p.piece.encode() for p in model.pieces]
        self.mark = self.lib.piece_to_id(SPACE)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, text: str) -> list[tuple[int, bytes]]:
        """Id and normalised bytes of each piece, as the library cuts them."""
        return [(p.id, p.piece.encode()) for p in self.lib.encode(text, return_type="proto").pieces]

    def project(self, text: bytes, pieces: list[tuple[int, bytes]]) -> tuple[list[int], list[int]]:
        """Begin and end in the original bytes of each piece. Of the byte pieces that stand for one character, the last holds its span."""
        norm, origin = self.normalize(text)
        begins, ends, at, i = [], [], 0, 0
        while i < len(pieces):
            size = _char_len(norm[at]) if pieces[i][0] in self.byte_ids else len(pieces[i][1])
            copies = size if pieces[i][0] in self.byte_ids else 1
            begins += [origin[at]] * copies
            ends += [origin[at]] * (copies - 1) + [origin[at + size]]
            at += size
            i += copies
        return begins, ends

    def learn(self, words: list[str]) -> None:
        """Encode words that follow a space and keep their ids and the original bytes under each piece, the space's included."""
        for word, ids in zip(words, self.lib.encode(words, num_threads=1), strict=True):
            if not word:
                ids = [self.mark]
            if not self.byte_ids.isdisjoint(ids):
                begins, ends = self.project(word.encode(), self.pieces(word))
                sizes = [b - a for a, b in zip(begins, ends, strict=True)]
                sizes[0] += 1
            else:  # identity map: a piece is as long as its name, but the mark is one byte
                sizes = [len(n := self.names[x]) - 2 * n.count(b"\xe2\x96\x81") for x in ids]
            self.cache[word] = np.array(ids, np.int32).tobytes(), np.array(sizes, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the original bytes under each piece; spans follow one another without gaps."""
        plain = [self.by_word and SPACE not in t for t in texts]
        words = [_words(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        wanted = set().union(*words).difference(self.cache)
        if len(self.cache) + len(wanted) > CACHE_WORDS:  # what these texts need is learnt or fetched, however much it is
            self.older, self.cache = self.cache, {}
            wanted = set().union(*words)
        known = wanted.intersection(self.older)
        self.cache.update((w, self.older[w]) for w in known)
        self.learn(list(wanted - known))
        out = []
        for text, own, p in zip(texts, words, plain, strict=True):
            if p and text:
                found = [self.cache[w] for w in own]
                ids = np.frombuffer(b"".join([x for x, _ in found]), np.int32)
                sizes = np.frombuffer(b"".join([x for _, x in found]), np.int32).copy()
                sizes[0] -= 1  # the mark before a text stands for no byte of it
                out.append((ids, sizes))
            else:
                pieces = self.pieces(text)
                begins, ends = self.project(text.encode(), pieces)
                out.append((np.array([x for x, _ in pieces], np.int32), np.array(ends, np.int32) - np.array(begins, np.int32)))
        return out


def _words(text: str) -> list[str]:
    """The text cut before each run of spaces; each word has lost one of them, the first had none."""
    if "  " not in text and not text.startswith(" "):
        return text.split(" ")
    return [w[1:] for w in re.findall(r" +[^ ]*", f" {text}")]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns the id column, `ids array<int>`, `ends array<int>` (the byte of the
    original UTF-8 text where each piece ends; it begins where the one before
    ended, the first at 0) and `decoded string`, a row for each row given. A
    null text is the empty text: no ids, decoded to the empty text. Repeated
    rows are encoded each; empty tables give empty tables; a text that is one
    long word is encoded whole.
    """
    path = tokenizer_path(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, limit=1 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            coded = c.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x, _ in coded])]).astype(np.int32)
            ends = np.concatenate([np.cumsum(s, dtype=np.int32) for _, s in coded])
            decoded = c.lib.decode([x.tolist() for x, _ in coded], num_threads=1)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (np.concatenate([x for x, _ in coded]), ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "ends", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, ends array<int>, decoded string")


def piece_digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of encoded documents: number of ids, SHA-256 of the ids and of the decoded text, and the bytes that the spans cover."""
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("span_bytes"),
    )

"""Token counts and SentencePiece against the libraries on whole texts."""

import hashlib
import struct

import public_tokenizers
import pytest

from tallyforge.llm.common import fresh_path
from tallyforge.llm.pieces import CharMap, Codec, Normalizer, encode_pieces, piece_digests
from tallyforge.llm.tokens import count_tokens, read_cache

ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b", "  two\n\nlines \t tab ", "x" * 5000, "▁mark▁", "中文 字 🙂🙂  é é", "a\x00b", "<|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "it's don't we'll 123 45.6 ñandú", "one one one", "one one one", "  　 ﬁ Ω İı K", "<s> </s> <unk> <0x41>", "\r\n\r\n \x0b\x0c end"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"e{i}", 1) for i, t in enumerate(ODD)] + [(None, "null id", None, 2), (15, "one one one", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, content string, ids int")


def test_pieces_match_library(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = odd.select("doc_id", "text", "content").unionByName(more, allowMissingColumns=True)
    rows = encode_pieces(docs).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert len(rows) == len(texts)
    by_ids = {}
    for t in texts:
        proto = lib.encode(t, return_type="proto")
        by_ids[tuple(p.id for p in proto.pieces), lib.decode(lib.encode(t))] = [p.end for p in proto.pieces]
    for r in rows:
        assert by_ids[tuple(r.ids), r.decoded] == r.ends


def test_piece_digests(spark, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(tuple(r) for r in piece_digests(encode_pieces(odd.filter("doc_id is not null"))).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(x := lib.encode(t or "")), sha(",".join(map(str, x))), sha(lib.decode(x)), len((t or "").encode())) for i, t in [*enumerate(ODD), (15, "one one one")])
    assert got == want
    assert piece_digests(encode_pieces(odd.limit(0))).count() == 0


def _trie(entries: dict[bytes, bytes]) -> bytes:
    """A double-array trie of the compiled form, built by placing each node's children at a base that is free."""
    units, used, pool = {0: 0}, {0}, bytearray()

    def place(pos, prefix):
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        base = next(b for b in range(1, 1 << 16) if (pos ^ b) not in used and all((pos ^ b ^ x) not in used for x in labels))
        node = pos ^ base
        used.update([node] if leaf or labels else [], (node ^ x for x in labels))
        units[pos] |= base << 10 | (leaf << 8)
        if leaf:
            units[node] = 0x80000000 | len(pool)
            pool.extend(entries[prefix] + b"\0")
        for x in labels:
            units[node ^ x] = x
        for x in labels:
            place(node ^ x, prefix + bytes([x]))

    place(0, b"")
    size = max(units) + 1
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + bytes(pool)


def test_longest_prefix_and_alignment():
    charmap = CharMap(_trie({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "　".encode(): b" ", b"q": b""}))
    assert charmap.longest(b"zabcd", 1) == (3, b"YZ")
    assert charmap.longest(b"abd", 0) == (2, b"X")
    assert charmap.longest(b"b", 0) is None
    norm, origin = Normalizer(charmap, False, False, False)("ﬁabcqd".encode())
    assert norm == b"fiYZd" and origin == [0, 0, 3, 3, 7, 8]
    norm, origin = Normalizer(charmap, True, True, True)("　 a  b　".encode())
    assert norm.decode() == "▁a▁b" and origin == [4, 4, 4, 4, 5, 5, 5, 7, 8]


def test_cache_can_overflow(monkeypatch):
    import tallyforge.llm.pieces as pieces

    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    c = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a b c d e f", "f g h a", "x"]
    for some in (texts, texts[::-1], ["a b"], ["b c d e f g h i j k l"], texts):
        assert [x.tolist() for x, _ in c.encode(some)] == c.lib.encode(some)


def test_a_text_with_more_words_than_the_cache():
    c = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["0 1 2", " ".join(map(str, range(320_000)))]
    c.encode(texts[:1])
    assert [x.tolist() for x, _ in c.encode(texts)] == c.lib.encode(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_match_library(spark, odd, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(lib.encode(t))
    else:
        lib = Tokenizer.from_file(path)
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    docs = odd.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    cache = fresh_path(spark, "cache")
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in count_tokens(docs, cache, name).collect())
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), count(r.text or "")) for r in docs.collect())
    assert got == want
    n = read_cache(spark, cache).count()
    again = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in count_tokens(docs, cache, name).collect())
    assert again == want and read_cache(spark, cache).count() == n  # nothing was missing


def test_counts_of_an_empty_table(spark, odd):
    assert count_tokens(odd.limit(0), fresh_path(spark, "cache")).count() == 0

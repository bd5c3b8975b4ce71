import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_rows import make_docs, odd_rows  # noqa: F401

from shelfwise.llm import pieces, token_files
from shelfwise.llm.common import scratch

PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "it's", "<|endoftext|>", "<|EndOfText|>", "<|", "é", "É", "é", "́",
         "İ", "ß", "ſ", "½", "1", "23", "²", ",", ".", "&&&", " ", "　", "中", "文", "🙂", "ª", "×", "ǅ", "\x00", "\x01", "_",
         "-", "Σ", "ς", "ﬁ", "▁", "</w>", "​", "|>", "<", "don't", "\r\n", "x" * 300]


def strange_rows():
    r = random.Random(3)
    return [(1000 + i, "".join(r.choices(PARTS, k=r.randint(0, 30))), "en", "s", 1) for i in range(3000)] + odd_rows()


def order(row):
    return (row[0] is not None, row[0] or 0)


def test_token_files_equal_the_library(make_docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = strange_rows()
    got = token_files.token_file_digest(make_docs(rows, clashing=True), P.path("word_bpe_49k.json")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for key, found in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == key) == sorted(found), key
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_one_document_and_the_ids(make_docs, spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i, f"document number {i} of a few", "en", "s", 1) for i in range(20)]
    folder = scratch(spark, "token-test")
    manifest = token_files.write_shards(make_docs(rows), P.path("word_bpe_49k.json"), folder, shards=1)
    shard = manifest.collect()[0]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for _, t, *_ in rows]
    assert token_files.read_document(folder, shard.file, 7).tolist() == want[7]
    assert shard.tokens == sum(map(len, want)) and shard.documents == 20
    read = token_files.read_shards(manifest, folder).collect()
    assert [r.ids for r in sorted(read, key=lambda r: r.start)] == want


def test_no_documents(make_docs):
    assert token_files.token_file_digest(make_docs([]), P.path("word_bpe_49k.json")).collect() == []


def test_pieces_equal_the_library(make_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = strange_rows() + [(-1, "a  b", "", "", 1), (-2, " a ", "", "", 1), (-3, "▁a▁▁b", "", "", 1)]
    got = pieces.piece_digest(make_docs(rows, clashing=True), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, text, *_ in rows:
        ids = sp.encode(text or "")
        want.setdefault(i, []).append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                       hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    for key, found in want.items():
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == key) == sorted(found), key


def test_piece_columns_and_empty_table(make_docs):
    model = P.path("piece_bpe_32k.model")
    docs = make_docs(odd_rows(), clashing=True)
    out = pieces.decode(pieces.encode(docs, model), model)
    assert sorted(out.columns) == sorted(docs.columns) and out.schema["ids"].dataType.simpleString() == "array<int>"
    assert out.filter("text is null").select("ids", "decoded").distinct().collect() == [([], "")]
    assert pieces.piece_digest(make_docs([]), model).collect() == []


def test_slices_of_a_batch_do_not_matter():
    """Every slice is an array that begins inside another's buffers."""
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    from shelfwise.llm import chunks
    texts = [t for _, t, *_ in strange_rows()] + ["Some Plain words, 12 of them", None, "É été ÀB"] * 50
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    encode, table = token_files.WordEncoder(P.path("word_bpe_49k.json")), chunks.ChunkTable(lambda c: sp.encode(c, num_threads=1))
    whole = pa.array(["before", *texts])
    for a, b in chunks.slices(whole, 700):
        flat, counts = encode(whole.slice(a, b - a))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in whole.slice(a, b - a).to_pylist()]
        assert flat.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
        if not any("▁" in (t or "") for t in whole.slice(a, b - a).to_pylist()):
            flat, counts = chunks.encode_texts(whole.slice(a, b - a), table, sp.encode)
            want = [sp.encode(t or "") for t in whole.slice(a, b - a).to_pylist()]
            assert flat.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_a_full_table_begins_anew(monkeypatch):
    import pyarrow as pa

    from shelfwise.llm import chunks
    monkeypatch.setattr(chunks, "TABLE_ENTRIES", 3)
    table = chunks.ChunkTable(lambda cs: [[len(c)] * 2 for c in cs])
    for text in ("a bb ccc", "dddd a", "bb eeeee a", "a"):
        flat, counts = chunks.encode_texts(pa.array([text, None]), table)
        assert flat.tolist() == [len(w) for w in text.split() for _ in range(2)] + [0, 0]
        assert counts.tolist() == [2 * len(text.split()), 2]


def test_models_whose_pieces_cross_spaces_are_refused(monkeypatch):
    import sentencepiece

    class Crossing:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces._processor("another")


def test_a_worker_encodes_every_distinct_part_once(monkeypatch):
    """Parts known from an earlier slice are not encoded again; a full table is begun anew."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    encode, asked = token_files.WordEncoder(path), []
    lines = encode.lines
    encode.known_parts.encode = lambda parts: asked.extend(parts.to_pylist()) or lines(parts)
    first, second = ["one lamp, 12 shades", None, "it's one"], ["one lamp, 13 shades", "lamp", "twelve, shades"]
    for limit, texts in ((1000, first), (1000, second), (4, first), (4, second + first)):
        monkeypatch.setattr(token_files, "TABLE_ENTRIES", limit)
        ids, counts = encode(pa.array(texts, pa.large_string()))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
        if limit == 1000 and texts is second:
            assert len(asked) == len(set(asked)) and "twelve" in asked

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import awkward, empty
from tokenizers import Tokenizer

from tokenlake.llm import token_ids as ti
from tokenlake.llm.common import read_table
from tokenlake.llm.queries import tokenizer_path


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_coding_round_trip(ranks):
    control, data = ti.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert ti.decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_frequent_ranks_take_one_byte():
    assert len(ti.encode_ranks(np.arange(256, dtype=np.uint32))[1]) == 256


TOKENIZER = Tokenizer.from_file(tokenizer_path())
ENCODER = ti.PieceEncoder(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t'aBs1.,é\u00a0\u2003")) | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_pieces_tokenize_like_the_whole(text):
    assert ENCODER.encode([text, ""])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def direct(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids))):
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(docs):
    rows = ti.read_token_files(*ti.write_token_files(docs, tokenizer_path())).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


def test_given_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").repartition(5)
    assert result(docs) == direct([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert result(docs) == direct([(r.doc_id, r.text) for r in docs.collect()])
    assert result(empty(docs)) == []


def test_ties_do_not_depend_on_the_input_order(spark):
    """Rows of one doc_id and length go by their ids."""
    rows = [(1, t) for t in ("a b", "c d", "e f", "g h", "c d")] + [(None, "x y"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = result(docs.coalesce(1))
    assert result(docs.repartition(4)) == first == result(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3))
    assert [r[1] for r in first] == [3 * i for i in range(7)]


def test_documents_are_coded_together_like_one_by_one():
    docs = [np.array(x, np.uint32) for x in ([1, 300, 70_000, 1 << 24, 5], [], [0xFFFFFFFF], [255, 256, 65_535, 65_536])]
    counts = np.array([len(x) for x in docs])
    coded = ti.encode_many(np.concatenate(docs), counts)
    assert coded == [ti.encode_ranks(x) for x in docs]
    assert ti.decode_many([c for c, _ in coded], [d for _, d in coded], counts).tolist() == np.concatenate(docs).tolist()


def test_a_worker_keeps_what_it_has_learnt(monkeypatch):
    encoder = ti.worker_encoder(tokenizer_path())
    assert ti.worker_encoder(tokenizer_path()) is encoder
    texts = ["one two three, four. ", "five  six\nseven", ""]
    want = [x.tolist() for x in ENCODER.encode(texts)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(encoder, "_learn", lambda pieces: 1 / 0)
    assert [x.tolist() for x in encoder.encode(texts)] == want  # nothing to learn
    try:
        encoder.encode(["never seen before"])
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert [x.tolist() for x in encoder.encode(["never seen before", *texts])][1:] == want


def test_a_doubtful_place_does_not_change_the_cuts_elsewhere():
    """A text with one doubtful cut used to be cut at single spaces throughout, so " four." was a piece of its own."""
    encoder = ti.PieceEncoder(tokenizer_path())
    encoder.encode(["one four.", " two", "five"])
    learnt, real = [], encoder._learn
    encoder._learn = lambda pieces: learnt.extend(pieces) or real(pieces)
    text = "five,, four. two  one"
    assert encoder.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert learnt and not any(b"four" in bytes(p, "utf-8") if isinstance(p, str) else b"four" in p for p in learnt)


def test_cuts_are_where_the_rules_say():
    def pieces(*texts):
        raw = [t.encode() for t in texts]
        begin = np.cumsum([0, *map(len, raw)])[:-1]
        flat = b"".join(raw)
        at = ti.cut_places(np.frombuffer(flat + b"\0", np.uint8)[:-1], begin)
        return [flat[a:b].decode() for a, b in zip(at, [*at[1:], len(flat)], strict=False)]

    assert pieces("one two.\nthree", "é. x× , ,.") == ["one", " two", ".", "\n", "three", "é", ".", " x×", " ,", " ,."]
    assert pieces("a  b", "a\n\nb", "a \nb") == ["a", "  b", "a", "\n\nb", "a", " \nb"]
    assert pieces("a\u00a0 b", "a \u2003b", "a\u3000\nb", "a\n\u1680b") == ["a\u00a0 b", "a", " \u2003b", "a\u3000\nb", "a", "\n\u1680b"]
    assert pieces("\n", "a\n", "b") == ["\n", "a", "\n", "b"] and pieces("") == []


def test_pieces_that_differ_late_or_share_a_slot(monkeypatch):
    """Pieces are compared whole: of 7, 8, 15 and 16 bytes and more, with zero bytes, and where the table grows and slots are shared."""
    words = ["x" * k + y for k in (1, 6, 7, 8, 13, 14, 15, 16, 200) for y in ("", "a", "b", "\0", "\0\0")]
    texts = [" ".join(words), " ".join(words[::-1]), "", *words, " ".join(f"w{k * k}" for k in range(3000))]
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = ti.PieceEncoder(tokenizer_path())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == want
    encoder._forget()
    encoder.table = np.zeros((2, 3), np.uint64)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(ti, "mixed", lambda h: h & np.uint64(7))  # nearly all share a slot
    encoder._forget()
    assert [x.tolist() for x in encoder.encode(texts[:-1])] == want[:-1]
    monkeypatch.undo()
    monkeypatch.setattr(ti, "MAX_PIECES", 5)
    monkeypatch.setattr(ti, "BYTES_AT_ONCE", 64)  # many portions, each begins with a new memory
    assert [x.tolist() for x in encoder.encode(texts)] == want

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tokenlake.llm import chat

tricky = st.text(st.sampled_from(list("<|>\\ae\n")) | st.characters(exclude_categories=["Cs"]), max_size=12) | st.sampled_from(
    ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<|nl|>", "a<", "<|im_end|>\n<|im_start|>user\nx", "\n", "<\\\\|"]
)


@given(st.lists(st.tuples(tricky, tricky), max_size=4))
def test_round_trip(turns):
    written = "".join(chat.render(*chat.round_trip(r, t)) for r, t in turns)
    assert chat.parse(written) == turns


@given(tricky)
def test_escaped_text_has_no_control_string(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


def test_plain_text_is_not_escaped():
    assert chat.round_trip("user", "a <| b") == ("user", "a <| b")


def test_conversations(spark, monkeypatch):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", "x<|im_end|>"), (None, 3, "assistant", "é"),
        (3, 0, "assistant", "z"), (3, 0, "assistant", "z"), (4, 0, "user", "long " * 300_000), (4, 1, "assistant", "long " * 300_000),
        (4, 2, "sys\ntem", "\\"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
    assert max(r.part for r in formatted.collect() if r.conv_id == 4) > 0  # a long conversation comes in parts
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render(*chat.round_trip(r, t))) for r, t in turns)
    assert chat.digest_conversations(chat.format_conversations(df.filter("false"))).count() == 0

"""What the store of known words costs, and words between punctuation."""

from lexigraft.llm import queries, tokens


def test_words_of_letters_are_not_looked_at_for_punctuation(monkeypatch):
    coder = tokens.WordEncoder(queries.tokenizer("word_bpe_49k.json"))
    seen = []
    parted = tokens.parted
    monkeypatch.setattr(tokens, "parted", lambda w: seen.append(w) or parted(w))
    text = b'The the (the) "The," a.b ...the... \'\' --x-- (\xc3\x89t\xc3\xa9) -a-a- (\xe2\x80\x9cq\xe2\x80\x9d)'
    assert coder.encode_all([text, b"", b"the The"]) == coder.whole([text, b"", b"the The"])
    assert seen and not any(w.isalpha() for w in seen)


def test_parts_of_words():
    assert tokens.parted(b"--Ab-ab--") == (b"--", b"ab-ab", b"--")
    assert tokens.parted(b"(\xc3\x89t\xc3\xa9)") == (b"(", b"\xc3\x89t\xc3\xa9".lower(), b")")
    assert [tokens.parted(w) for w in (b"ab", b"...", b"(<|x|>)", b"(1a)", b"(a1)", b"a-b")] == [None] * 6

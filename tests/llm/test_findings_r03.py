"""A test for each finding of round 3 on training text that held: each fails on the code before its change."""

from types import SimpleNamespace

from webgrain.llm import registry, wordpiece


def test_pieces_are_looked_up_once_and_letters_kept_apart():
    """op2: "word", "word," and "Word." ask the model once for the letters, as each piece did before."""
    enc, asked = wordpiece.PieceEncoder(registry.vocabulary("word_bpe_49k.json")), []
    model = enc.model
    enc.model = SimpleNamespace(tokenize=lambda run: asked.append(run) or model.tokenize(run))
    text = "word word, Word. (word) été, Été word"
    assert enc.encode(text) == enc._ids(text) and asked.count("word") == 1 and sum(a.startswith("Ã") for a in asked) == 1

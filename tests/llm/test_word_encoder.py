"""The word encoder of packing: words kept from task to task, and given to the tokenizer in parts."""

import pyarrow as pa
from tokenizers import Tokenizer

from iqlake.llm import tokens
from iqlake.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_words_are_met_once_by_a_worker(monkeypatch):
    """Tasks that a worker runs one after another share one encoder; results are the same."""
    met = []
    learn = tokens.WordEncoder._learn
    monkeypatch.setattr(tokens.WordEncoder, "_learn", lambda self, words, keys: (met.extend(words), learn(self, words, keys))[1])
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "_text": ["sharedonce sharedtwice sharedonce", "sharedtwice"]})
    run = tokens.pieces_of(PATH, 2048, "id", "_text")
    one, two = ([b.to_pydict() for b in run(iter([batch]))] for _ in range(2))
    assert one == two and sorted(met) == [b"sharedonce", b"sharedtwice"]


def test_many_new_words_at_once(monkeypatch):
    """The tokenizer gets new words a few at a time; ids are those of whole texts."""
    monkeypatch.setattr(tokens, "AT_ONCE", 3)
    tok = Tokenizer.from_file(PATH)
    text = "one two three four five six seven, eight! nine ten"
    flat, _ = tokens.WordEncoder(PATH).encode([text.encode()])
    assert flat.tolist() == tok.encode(text, add_special_tokens=False).ids + [0]

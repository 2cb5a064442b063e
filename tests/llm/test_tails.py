"""Marks after a word: their runs are encoded once, and ids stay the library's."""

import numpy as np
from tokenizers import Tokenizer

from tickforge.llm import tokens


def test_runs_of_marks_are_encoded_once(monkeypatch):
    path = tokens.default_path("byte_bpe_50k.json")
    e, calls = tokens.Encoder(path, "byte"), []
    whole = e._library
    monkeypatch.setattr(e, "_library", lambda t: calls.append(t) or whole(t))
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    ends = ["", ",", "###", "***,", "!?", ".)", "\"'", "'s,", "é.", "1;", "<|endoftext|>", "ß###", "~", "''", "-x-"]
    texts = [" ".join(w + ends[(i + k) % len(ends)] for i, w in enumerate(words)) + "\n" + "\n".join(w + "$$$" for w in words[k::9]) for k in range(3)]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for text, ids in zip(texts, e.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, e.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    plain = ("###", "***,", "!?", ".)", "$$$", "~")
    assert not [t for t in calls if t.strip().endswith(plain) and t.strip().rstrip("#*,!?.)$~").isascii() and t.strip().rstrip("#*,!?.)$~").isalpha()]

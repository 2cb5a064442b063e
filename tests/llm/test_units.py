"""Words and the marks that end them are units of their own: each is encoded once, and ids stay the library's."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickforge.llm import packing, token_store, tokens

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_a_word_is_learned_once_whatever_marks_follow(kind, monkeypatch):
    e, learned = tokens.Encoder(tokens.default_path(FILES[kind]), kind), []
    plain = e._learn_all
    monkeypatch.setattr(e, "_learn_all", lambda units: learned.extend(units) or plain(units))
    marks = ["", ",", ".", "...", "###", "?!", ")", '",']
    e.encode([" ".join(f"x abc{m} café{m} 12{m}" for m in marks).encode(), b"x abc;"])
    assert len(learned) == len(set(learned))
    for word in (b"abc", b"caf\xc3\xa9", b"12"):
        assert [u for u in learned if u.startswith(word)] == [word]


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_ids_around_marks_are_the_librarys(kind):
    path, rng = tokens.default_path(FILES[kind]), random.Random(3)
    bodies = ["a", "Word", "é", "ÉtÉ", "×", "÷", "İ", "ſ", "ŉ", "ǅ", "Σ", "é", "中", "7", "٢", "it's", "'s", "…", "¿", "ª", "٭", "a.b", "x-y", "\U0001d54f", ""]
    marks = ["", ".", ",,", "'", ".'", "'.", "###", "[", "{|}~", "@", "’", "!?…", "<|endoftext|>", "_"]
    texts = ["".join(rng.choice(bodies) + rng.choice(marks) + rng.choice([" ", " ", " ", "\n", "", "\t", "  "]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts += [b + m for b in bodies for m in marks] + [b + m + "\n" + m + b + m for b in bodies for m in marks] + [m + " " + m for m in marks]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    e = tokens.Encoder(path, kind)
    for _ in range(2):  # new units, then known ones
        for t, ids in zip(texts, e.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, e.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_windows_take_the_best_that_fits():
    """As down the full order of scores, sorted; scores tie often."""

    class Index:
        def scores(self, seed):
            return np.random.default_rng(seed).integers(0, 5, len(ids)).astype(float)

    def plain(ids, window):
        left, begin, out = [len(x) for x in ids], [0] * len(ids), []
        for seed in range(len(ids)):
            if not left[seed]:
                continue
            taken, space = [(seed, begin[seed], left[seed])], window - left[seed]
            begin[seed], left[seed] = begin[seed] + left[seed], 0
            score = Index().scores(seed)
            order = sorted((r for r in range(len(ids)) if left[r]), key=lambda r: (-score[r], r))
            for r in order if space else []:
                if left[r] <= space:
                    taken.append((r, begin[r], left[r]))
                    space, begin[r], left[r] = space - left[r], begin[r] + left[r], 0
                if not space:
                    break
            for r in [r for r in order if left[r]][:1] if space else []:
                taken.append((r, begin[r], space))
                begin[r], left[r] = begin[r] + space, left[r] - space
            out.append(taken)
        return out

    for case in range(20):
        rng = np.random.default_rng(case)
        ids = [np.zeros(n, np.uint16) for n in rng.integers(1, 40, 60)]
        assert packing.fill(ids, Index(), 40) == plain(ids, 40)


def test_upper_case_latin_words_go_to_the_model(monkeypatch):
    path, calls = tokens.default_path(FILES["word"]), []
    e = tokens.Encoder(path, "word")
    whole = e._library
    monkeypatch.setattr(e, "_library", lambda t: calls.append(t) or whole(t))
    words = [f"{c}a{c.lower()}" for c in map(chr, range(0xC0, 0xDF)) if c.isalpha()]
    library = Tokenizer.from_file(path)
    for w, ids in zip(words, e.encode([w.encode() for w in words])):
        assert np.frombuffer(ids, e.dtype).tolist() == library.encode(w, add_special_tokens=False).ids
    assert calls == []


def test_chunks_do_not_depend_on_the_documents_beside():
    rng = np.random.default_rng(1)
    blobs = [rng.integers(0, 1000, n).astype("<u2").tobytes() for n in rng.integers(0, 6000, 40)]
    alone = [token_store.chunk_ends([x], np.dtype("<u2"))[0] for x in blobs]
    assert token_store.chunk_ends(blobs, np.dtype("<u2")) == alone == [e for i in range(0, 40, 7) for e in token_store.chunk_ends(blobs[i : i + 7], np.dtype("<u2"))]

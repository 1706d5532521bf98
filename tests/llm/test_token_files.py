import itertools
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["", "word", "Élan", "a×b", "×", "÷ez", "ɏa", "ɐb", "Жук", "中文", "'s", "it's", "3", "x2", ".", "!?", "…", "\n", "\n\n", "\t", " ", "-", "_", "$$$", ",***", "'", "<|", "|>", " "]


def test_words_are_cut_as_the_tokenizer_cuts():
    sys.modules.pop("_tessera_kept", None)
    tok, run = Tokenizer.from_file(PATH), token_files.word_ids(PATH)
    words = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.islice(itertools.product(PARTS, repeat=n), 0, None, (1, 1, 7, 97)[n - 1])]
    words += ["".join(x) for x in itertools.product(["stem", "È", ""], [",", ".", ""], ["\n", "\n\n", ""], ["next", "ǆ", ""], ["?", "?!", ""])]
    # each alone, as a head and behind words, and all in one text
    texts = [*words, *(f"{w} {w}" for w in words), *(f"so {w} on" for w in words), " ".join(words), None]
    for column in (pa.array(texts), pa.array(texts)):  # the second time from what is remembered
        ids, n = run(column)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [y for x in want for y in x]
    assert [len(x) for x in run(pa.array([], pa.string()))] == [0, 0]
    sys.modules.pop("_tessera_kept", None)


def test_stems_are_encoded_once():
    sys.modules.pop("_tessera_kept", None)
    r = np.random.default_rng(1)
    stems = ["".join(x) for x in r.choice([*"etaoinshr"], (300, 6))]
    words = [a + s + t for a in stems for s in ("", ",", ".", "?") for t in ("", "\nThen", "\nThen,")]
    token_files.word_ids(PATH)(pa.array([" ".join(words)]))
    kept = sys.modules.pop("_tessera_kept")
    assert len(kept.texts) < len(stems) + 20 < len(words) / 10


def test_coder_of_uneven_blocks():
    r = np.random.default_rng(5)
    blocks = [(r.zipf(1.3, n) % hi).astype(np.uint16) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 300, 301, 999) for hi in (1, 2, 1000, 65536)]
    blocks += [r.integers(0, 65536, 2000).astype(np.uint16) for _ in range(40)] + [np.full(2000, x, np.uint16) for x in (0, 65535)]
    words = token_files.encode(blocks)
    back = token_files.decode(words, np.array([len(b) for b in blocks]))
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    head, got = token_files._opened(token_files._payload(blocks, words))
    assert head[:, 0].tolist() == [len(b) for b in blocks] and all((a == b).all() for a, b in zip(words, got, strict=True))


def test_damaged_words_end():
    r = np.random.default_rng(6)
    blocks = [r.integers(0, 5000, 500).astype(np.uint16) for _ in range(8)]
    words = [r.integers(0, 1 << 24, len(w)).astype(np.uint32) for w in token_files.encode(blocks)]
    with np.errstate(all="ignore"):
        assert [len(b) for b in token_files.decode(words, np.full(8, 500))] == [500] * 8

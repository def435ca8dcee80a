import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditweave.llm import bpe as bpe_module
from auditweave.llm.bpe import SpeculativeBpe, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "Hello  Wörld's 123 foo!!\n日本 <|endoftext|> a", "<|startoftext|><|endoftext|>", "a\x1cb\x85c\xa0d", "ΣΑΣ İstanbul é ﬁ", "x" * 3000, "!" * 5000,
    "it's we're I'll they'd 's", "​﻿ emoji 👩‍👩‍👧 ok", "ab<|endoftext|", "\x00\x01", "ÀÉÎ ñandú straße ſ K", "à́ b", "<<|endoftext|>>",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, t):
    ids = library.encode(t, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_matches_library_on_odd_texts(library):
    assert SpeculativeBpe(PATH).encode_batch(TEXTS) == [expected(library, t) for t in TEXTS]


def test_matches_library_on_random_words(library):
    rnd = random.Random(5)
    alphabet = "aeinrstlohd" * 3 + "bcfgkmpuvwxyzéüßñ'0!#.,- "
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(3000)]
    bpe = SpeculativeBpe(PATH)
    assert bpe.encode_batch(texts) == [expected(library, t) for t in texts]
    assert 0 < bpe.merged_exactly < len(bpe.words.young)


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_module, "MEMORY", 40)
    monkeypatch.setattr(bpe_module, "PAIR_CACHE", 10)
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abehiort", k=rnd.randint(1, 70))) for _ in range(120)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(200)]
    bpe = SpeculativeBpe(PATH)
    assert [x for i in range(0, 200, 7) for x in bpe.encode_batch(texts[i : i + 7])] == [expected(library, t) for t in texts]


def test_greedy_cut_is_longest_match_from_the_left():
    bpe, rnd = SpeculativeBpe(PATH), random.Random(9)
    words = ["".join(rnd.choices("aehinorstl'", k=rnd.randint(1, 14))).encode() for _ in range(500)]
    ids, owner = bpe.greedy(words)
    covered = 0
    for k, w in enumerate(words):
        s, want = "".join(bpe.letters[c] for c in w) + "</w>", []
        while s:
            n = max(n for n in range(1, len(s) + 1) if s[:n] in bpe.vocab and (n == len(s) or n <= len(s) - 5))
            want.append(bpe.vocab[s[:n]])
            s = s[n:]
        got = ids[owner == k].tolist()
        assert got in (want, [])  # a word that the automaton leaves a gap in is merged exactly
        covered += got == want
    assert covered > 450


def test_query_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "a b", "x"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        n, ids, decoded = expected(library, t or "")
        want.append((-1 if i is None else i, n, sha(ids), sha(decoded)))
    assert got == sorted(want)
    assert bpe_round_trip(df.limit(0)).count() == 0
    kept = bpe_round_trip(df, keep_ids=True, keep_decoded=True).filter("doc_id = 2").first()
    assert kept.ids == library.encode(TEXTS[2], add_special_tokens=False).ids

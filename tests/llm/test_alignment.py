"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
from collections import Counter

import pytest

from trencher.llm import alignment
from trencher.llm.tokens import _letters, default_tokenizer

DOCS = "doc_id long, text string, n_a long, row string, key int"
TEXTS = [None, "", " ", "a", "Hello world", "Hello world", "  two  spaces \n\n and\tmore ", "naïve café 日本語 \U0001f600", "a ▁ b", "<|endoftext|> </s> <s> x", "aaaaaaaaaaaab",
         "it's WE'LL 1234567 ...!!", "x y z　w", "\x00 \x01 a", "tokenization " * 300, "x" * 3000, "Strange wordings unhyphenated antidisestablishmentarianism"]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, byte = Tokenizer.from_file(default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces()), _letters()
    a.encode_special_tokens = True
    word_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    word_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ranges = []
        for ids, word in ((ids_a, word_a), (ids_b, word_b)):
            end, own = 0, []
            for i in ids:
                own.append((end, end + len(word(i)), i))
                end += len(word(i))
            ranges.append(own)
        if not t or not b"".join(map(word_a, ids_a)) == b"".join(map(word_b, ids_b)) == (" " + t).encode():
            docs.append((0, 0, [], []))
            continue
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, start = [], 0
        for e in ends:
            groups.append([[i for s, f, i in own if start <= s and f <= e] for own in ranges])
            start = e
        links = [(i, j) for s, e, i in ranges[0] for f, g, j in ranges[1] if s < g and f < e]
        docs.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(p for _, _, _, links in docs for p in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    for n_a, n_b, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        yield (n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("hot", [None, 0, 20])
def test_alignment(spark, hot):
    texts = TEXTS[:-2] + [TEXTS[-1]] if hot is None else TEXTS[3:12]
    given = spark.createDataFrame([(None if i == 4 else i, t, 7, "r", 1) for i, t in enumerate(texts)], DOCS)
    found = alignment.alignment(given, hot=hot).collect()
    assert Counter(tuple(r)[1:] for r in found) == Counter(plain(texts))
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [i for i in range(len(texts)) if i != 4]


def test_long_texts_and_chunks_that_are_forgotten(spark, monkeypatch):
    import random

    rng = random.Random(3)
    letters = "abcdeé  \n.'s日"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 120))) for _ in range(150)] + ["x" * 2000]
    monkeypatch.setattr(alignment, "REMEMBER", 5)
    monkeypatch.setattr(alignment, "CHARACTERS", 300)
    aligner = alignment.Aligner(default_tokenizer(), alignment.default_pieces())
    own = list(plain(texts))
    for at in range(0, len(texts), 10):
        numbers, digests, ends, keys, n = aligner.align(texts[at:at + 10])
        for k in range(len(digests)):
            assert (*numbers[k].tolist(), digests[k]) == (*own[at + k][:4], own[at + k][-1])
            assert n[ends[k]:ends[k + 1]].sum() == own[at + k][3]


def test_empty_table(spark):
    given = spark.createDataFrame([], DOCS)
    assert alignment.alignment(given).collect() == []
    given = spark.createDataFrame([(1, None, 0, "", 0), (2, "", 0, "", 0)], DOCS)
    assert [tuple(r)[1:] for r in alignment.alignment(given).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2

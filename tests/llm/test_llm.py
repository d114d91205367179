"""The training-data operators against brute force and round trips on small frames."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trencher.llm import chat, class_lm, components, decontaminate, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, token_shards
from trencher.llm.tokens import Encoder, default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700}" for i in range(5000))
TEXTS = [None, "", "a", " \n\t ", "one two three", "one two three", LONG, LONG + " more", "Été <|endoftext|> x  y", "x " * 3000, "\U0001d400 café è"]


def docs(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", 0) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["a  b", " a", "a ", "x\n y", "a　 b", "it's WE'LL", "\r\n\r\n a"]
    for _ in range(2):
        found = Encoder().encode(texts)
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("counts", [{}, {5: 3}, {2048: 2, 1: 7}, {1000: 5, 600: 9, 48: 40, 1: 100}, {i: i % 7 + 1 for i in range(1, 2049, 13)}])
def test_plan_places_every_piece_once(counts):
    room, ranks = {}, Counter()
    for length, rank, n, first, at, per in packing.plan(counts):
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            room.setdefault(first + k // per, []).append((at + k % per * length, length))
    assert ranks == Counter(counts)
    for places in room.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 2048
    assert not counts or len(room) <= math.ceil(sum(k * v for k, v in counts.items()) / 2048) * 1.25 + 1


def test_packing(spark):
    rows = packing.pack(packing.token_pieces(docs(spark, ids=[None, *range(10)]))).collect()
    assert Counter(r["doc_id"] for r in rows)[5] == 1 + (len(np.frombuffer(Encoder().encode([LONG])[0], "<u4")) // 2048)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 and sorted(v)[0][0] == 0 for v in by.values())
    assert packing.pack(packing.token_pieces(docs(spark, []))).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "### x</turn>\\"), (1, 1, "assistant", "### x</turn>\\"), (2, None, None, None),
             (None, 3, "a: b\\", "\n"), (3, 0, "user", "hi")]
    given = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(given)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert found[c]["n_turns"] == len(own)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    written = {(r["conv_id"], r["example"]): r for r in chat.example_texts(chat.format_turns(given)).collect()}
    assert set(written) == {(1, 0), (1, 1)} and written[1, 1]["text"].startswith(written[1, 0]["text"])
    assert chat.format_turns(given.limit(0)).count() == 0


def test_quality_features(spark):
    texts = [*TEXTS, "a b c a b c a b", "l\nl\n\n \nl x"]
    rows = quality_rules.judged(docs(spark, texts), keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        words = t.encode().split()
        grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(hit), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_simhash_links_are_all_found(spark):
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 40)]
    prints = set(centre)
    for c in centre:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                x = c & (2**64 - 1)
                for b in rng.choice(64, n, replace=False):
                    x ^= 1 << int(b)
                prints.add(x - 2**64 if x >= 2**63 else x)
    prints |= {0, -1}
    expected = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    for fine_above in (256, 1):
        assert {tuple(r) for r in simhash.links(frame, fine_above).collect()} == expected


def test_simhash_components(spark):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, [None, "", " ", "a b", "A b", LONG, LONG], [5, 4, None, 3, 2, 1, 0])).collect()}
    assert found[5]["component_id"] == 4 and found[5]["fingerprint"] == 0 and found[None]["component_id"] == 4
    assert found[3]["component_id"] == 2 and found[1]["component_id"] == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    found = dict(components.roots(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100}


def test_class_model(spark):
    texts = [f"the cat {v} the mat" if k % 2 else f"der hund {v} die matte" for k, v in enumerate(["sat", "lief"] * 40)] + [None, "", "unseen words here"]
    rows = class_lm.scores(docs(spark, texts), classes=4, core=8).collect()
    train = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").split(), None])
    n, v = sum(train.values()), len(train)
    for r in rows:
        own = [*(texts[r["doc_id"]] or "").split(), None]
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(train[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own))
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 3]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert class_lm.scores(docs(spark, []), classes=4, core=8).count() == 0


def test_decontamination(spark):
    items = [(1, " ".join(f"B{i}" for i in range(20))), (2, "short one"), (3, None), (4, "..."), (None, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "x " * 30 + items[0][1] + " y", " ".join(f"b{i}" for i in range(12)), "a SHORT-one b short", " ".join(f"b{i}" for i in range(13))]
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert [found[i]["n_hit"] for i in range(6)] == [0, 0, 20, 0, 2, 13]
    assert found[2]["items"] == ["1"] and found[4]["items"] == ["", "2"] and not found[3]["contaminated"]
    assert decontaminate.contamination(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def test_line_dedup(spark):
    texts = [f"page {i}\n  footer \nend {i}" for i in range(20)] + [None, "footer", ""]
    given = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(texts)], DOCS).withColumn("lines", F.lit(7))
    found = {r["doc_id"]: r for r in line_dedup.without_boilerplate(given).collect()}
    assert found[0]["text"] == "page 0\nend 0" and found[0]["lines"] == 7 and found[20]["text"] is None and found[21]["text"] == "" and found[22]["lines_dropped"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(token_shards.permuted(np.arange(n), n).tolist()) == list(range(n))


def test_token_shards(spark):
    seqs = token_shards.sequences(docs(spark), length=64).cache()
    rows = token_shards.records(token_shards.shards(seqs, 64, 16), 0, 64, 16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(seqs.count()))
    assert Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in rows) == Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in seqs.collect())
    assert token_shards.shards(token_shards.sequences(docs(spark, []))).count() == 0


def test_shards_fit(spark):
    texts = ["x" * (i % 90) for i in range(400)] + ["y" * 5000, None] + ["z" * 50] * 200
    ids = [*range(400), 1000, None] + [77] * 200
    rows = sharding.assigned(docs(spark, texts, ids), limit=1000).collect()
    total, n = Counter(), Counter()
    for r in rows:
        total[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    assert len(rows) == len(texts) and all(total[r["shard"]] == r["shard_bytes"] for r in rows)
    assert all(b <= 1000 or n[s] == 1 for s, b in total.items())
    assert not any(a != b and b.startswith(a) for a in total for b in total)
    assert sharding.assigned(docs(spark, [])).count() == 0


def test_classifier(spark):
    texts = [f"plain good text number {i} about gardens" if i % 4 else f"you stupid moron number {i} about gardens" for i in range(200)]
    given = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_classifier.judged(given, labels).collect()}
    assert len(rows) == 202 and all(rows[i]["kept"] == bool(i % 4) for i in range(200))
    assert quality_classifier.judged(given, labels.limit(0)).where("NOT kept").count() == 0
    assert quality_classifier.judged(given.limit(0), labels).count() == 0


def test_the_sample_is_bounded_and_order_does_not_count(spark):
    rows = [(i % 2, f"text {i} " + "word " * (i % 9), "en", "s", 1) for i in range(400)] + [(5, "both", "en", "s", 1), (6, "both", "en", "s", 1)]
    fitting = lambda own: spark.createDataFrame([(t, i % 2, i % 3) for i, t, *_ in own], "text string, low_quality int, toxic int")
    found = [sorted(map(tuple, quality_classifier._bounded(fitting(own), 20).select("text", "low_quality", "toxic").collect())) for own in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 20
    both = quality_classifier._bounded(fitting(rows), 1000).where("text = 'both'").collect()
    assert [(r["low_quality"], r["toxic"]) for r in both] == [(1, 2)]


def test_reading_back_needs_the_escapes(spark, monkeypatch):
    rows = [(1, 0, "user", "a</turn>\n### assistant: not said"), (1, 1, "assistant", "b \\ c\n### d: e"), (2, 0, "user: x", "f"), (2, 1, "assistant", "")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(given)).collect()}
    for conv in (1, 2):
        own = [r[2:] for r in rows if r[0] == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert found[conv] == (2, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    monkeypatch.setattr(chat, "ESCAPES", [])
    broken = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(given)).collect()}
    assert broken[1][0] == 3 and broken[1] != found[1]


def test_examples_are_written_out_with_their_contexts(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a\n"), (None, 2, "user", "r"), (None, 3, "assistant", ""), (None, 4, "user", "s"), (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = Counter((r["conv_id"], r["until"], r["example"]) for r in chat.expanded(turns).collect())
    assert found == {(None, 1, 0): 2, (None, 3, 1): 4, (None, 4, None): 5, (2, 0, None): 1, (3, 0, 0): 1, (3, 1, 1): 2}
    read = {(r["conv_id"], r["until"]): (r["n_turns"], r["learned"]) for r in chat.read_examples(chat.expanded(turns)).collect()}
    assert read == {(None, 1): (2, "a\n"), (None, 3): (4, ""), (None, 4): (5, None), (2, 0): (1, None), (3, 0): (1, "x"), (3, 1): (2, "x")}
    # A part that an example lacks shows in what is read back from it.
    short = chat.read_examples(chat.expanded(turns).where("NOT (conv_id IS NULL AND until = 3 AND position = 1)"))
    assert {r["until"]: r["n_turns"] for r in short.where("conv_id IS NULL").collect()} == {1: 2, 3: 3, 4: 5}

"""The whole pipeline against a plain version of its stages, on a table with planted cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from trencher.llm import line_dedup, quality_classifier
from trencher.llm.tokens import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOOTER, NOTICE = "  follow this site for more \t", "this site uses cookies"


def planted():
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in ("gar", "mel", "tor", "vin", "sol", "par", "lun") for b in ("den", "ody", "ent", "ery", "stice", "ade", "acy", "ing", "age", "our")]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    item = " ".join(f"Quiz{i}" for i in range(30))
    good = [(i, f"{prose(40)}\n{prose(30)}" + (f"\n{FOOTER}" if i % 3 == 0 else f"\n{NOTICE}" if i in (1, 4, 7, 10, 13) else ""), "en", f"s{i % 3}", 1) for i in range(90)]
    toxic = [(100 + i, f"you stupid moron {prose(1 + 5 * (i % 15))} stupid moron", "en", f"s{i % 3}", 1) for i in range(30)]
    short = [(300 + i, prose(i % 6), "en", f"s{i % 3}", 1) for i in range(60)]
    long = prose(4000)
    edited = good[11][1].split(" ")
    edited[30] = "edited"
    other = [(200, good[4][1], "en", "s2", 1), (201, good[4][1].upper(), "fr", "s1", 1), (202, good[4][1], None, None, None), (3, good[3][1], "en", "s0", 1),
             (None, good[5][1], "en", "s2", 1), (210, long, "en", "s1", 1), (211, long + " more", "en", "s2", 1),
             (220, f"{prose(50)} {item.lower().replace(' ', ', ')} {prose(20)}", "en", "s1", 1), (221, prose(700) + " " + item, "en", "s1", 1),
             (230, None, "en", "s1", None), (231, "", "en", "s1", 0), (232, "short", "de", "s2", 5), (233, FOOTER, "en", "s0", 30), (240, " ".join(edited), "en", "s0", 1)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(20)] + [(300 + i, 1, 0) for i in range(60)]
    return good + short + toxic + other, labels, [(7, item), (8, None), (9, "")]


def without_lines(rows):
    split = lambda t: [] if t is None else t.split("\n")
    pages = Counter(r[3] for r in rows)
    found = Counter((r[3], x) for r in rows for x in {x.strip(line_dedup.SPACE) for x in split(r[1])} if x)
    gone = {k for k, n in found.items() if n >= 5 and n > 0.01 * pages[k[0]]}
    assert gone == {("s0", FOOTER.strip()), ("s1", NOTICE)}
    out = []
    for doc, text, _, host, _ in rows:
        left = "\n".join(x for x in split(text) if (host, x.strip(line_dedup.SPACE)) not in gone)
        out.append((doc, text if text is None or 2 * len(left) < len(text) else left))
    return out


def shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def one_of_each(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for k, (doc, _) in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (True, 0, 1 << 62)), (doc is None, doc or 0, k))
    return [rows[k] for _, _, k in best.values()]


def clean(rows, bench):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(w[i:i + 13]) for w in map(words, (t for _, t in bench)) if w for i in range(max(1, len(w) - 12))}
    out = []
    for doc, text in rows:
        w = words(text)
        hit = {i + k for x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i:i + len(x)]) == x for k in range(len(x))}
        if not hit or 20 * len(hit) < len(w):
            out.append((doc, text))
    return out


def pieces(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    for doc, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids), 2048), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels, bench = planted()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline(spark, folder):
    rows, _, bench = planted()
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    judged = quality_classifier.judged(read("documents"), read("labels"), keep=["doc_id", "text"]).collect()
    rejected = Counter((r["doc_id"], r["text"]) for r in judged if not r["kept"])
    assert {doc for doc, _ in rejected} == set(range(100, 130))
    rows = without_lines([r for r in rows if (r[0], r[1]) not in rejected])
    kept = clean(one_of_each(rows), bench)
    ids = {doc for doc, _ in kept}
    assert not ids & {200, 201, 202, 211, 220, 231, 240, None} and ids >= {*range(90), 210, 221, 232, 233}
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(pieces(kept))
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

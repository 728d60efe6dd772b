"""Operators against plain versions of the whole method, and the pipeline on clashing names."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import common, fingerprint, language_id, near_dup, ppm, quality, spans, token_file

ODD = ["", " x", "a  b\n\n c \t d", "it's 'tis 's <|endoftext|> q<|endoftext|>z  ", "a×. b÷! é. ñ?ß:Ω. ж, x²", "a\x1cb​c　d", "日本 語　x", "123 456!!  ??", None]


def test_token_ids_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "a", "bc", "'s", "é", "日", ".", ",", "!", "12", "<|endoftext|>", "\x85", "﻿"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)] + ["word " * 5000, "x" * 9000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    library, want, at = Tokenizer.from_file(path), {}, 0
    for d, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    out = common.scratch_path(spark, "test")
    token_file.write(docs, path, out)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_file.digests(token_file.read(spark, out)).collect()} == want


def test_base_rules(spark):
    texts = [" ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "a b c " * 40, "#a *b $ %&|<>" * 10, "", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in quality.judged(docs, None).collect():
        words = common.WORDS.findall(texts[r.doc_id] or "")
        assert r.n_symbols == sum(c in quality.SYMBOLS for c in texts[r.doc_id] or "")
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert r.kept == (not r.base_failed) and r.llr == 0


def test_fingerprint_likeness():
    rng = random.Random(8)
    off = []
    for n in (20, 100, 400, 2000):
        for share in (0.0, 0.5, 0.9):
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            other = words[: int(n * share)] + [f"u{rng.randrange(10**6)}" for _ in range(n - int(n * share))]
            a, b = (set(map(int, fingerprint.shingle_hashes(w))) for w in (words, other))
            off.append(fingerprint.likeness(fingerprint.bins(words), fingerprint.bins(other)) - len(a & b) / len(a | b))
            assert (fingerprint.unpacked(fingerprint.packed(fingerprint.bins(words))) == fingerprint.bins(words)).all()
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.05


def plain_ppm(train: list[str], text: str) -> float:
    """Method C with exclusion over all counts, byte by byte."""
    counts: dict[bytes, collections.Counter] = collections.defaultdict(collections.Counter)
    padded = lambda t: ppm.START * ppm.ORDER + t.encode() + ppm.END
    for t in train:
        raw = padded(t)
        for i in range(ppm.ORDER, len(raw)):
            for order in range(ppm.ORDER + 1):
                counts[raw[i - order : i]][raw[i]] += 1
    raw, total = padded(text), 0.0
    for i in range(ppm.ORDER, len(raw)):
        gone: set[int] = set()
        for order in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in counts.get(raw[i - order : i], {}).items() if s not in gone}
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total += math.log10(seen[raw[i]] / (n + kinds))
                break
            total += math.log10(kinds / (n + kinds))
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_language_model_scores(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "then", "there", "of", "öl", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(24)]
    train = [t for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    for r in ppm.scored(docs, 400).collect():
        assert r.score == pytest.approx(plain_ppm(train, texts[r.doc_id]), rel=1e-4, abs=1e-3)


def test_language_id_accuracy(spark):
    rng = random.Random(3)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(200)] for lang, letters in (("aa", "abcdeioln"), ("bb", "xyzuvwkst"), ("cc", "éèàuoinrst"))}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(40)), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identified(docs, language_id.train(language_id.training_sample(docs))).join(docs, "doc_id").filter(language_id.held_out()).collect()
    right = [r.score for r in got if r.lang_pred == r.lang]
    assert len(got) > 40 and len(right) > 0.98 * len(got) and abs(sum(right) / len(right) - 1) < 0.1


def plain_clauses(text: str) -> list[str]:
    """Sentences of ASCII texts by hand: after a mark and white space, at line feeds, after 12 words."""
    out, now = [], ""
    for i, c in enumerate(text):
        now += c
        ends = i + 1 < len(text) and not text[i + 1].isspace() and c.isspace()
        if ends and now.strip() and (now.rstrip()[-1] in ".!?,;:" or "\n" in now[len(now.rstrip()) :] or len(now.split()) == spans.MOST):
            out.append(now)
            now = ""
    return out + [now] if now else out


def test_sentences_and_runs():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word", "a"]) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "; "]) for _ in range(rng.randint(1, 60))).strip()
        got = [text[a:b] for a, b in spans.sentences(text)]
        assert "".join(got) == text and all(len(s.split()) <= spans.MOST for s in got)
        assert [s.strip() for s in got] == [s.strip() for s in plain_clauses(text)]
        for at, n, _ in spans.runs(text):
            assert n >= spans.RUN and sum(len(s.split()) for s in got[at : at + n]) >= spans.RUN_WORDS


def test_near_duplicates_branch(spark, monkeypatch):
    """Small leaves, so that nodes branch, are chunked and met in blocks; the same components as by brute force."""
    monkeypatch.setattr(near_dup, "LEAF", 20)
    rng = random.Random(9)
    common_part, rows = [f"c{i}" for i in range(25)], []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(6):
            text = list(base)
            text[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(common_part + text)))
    sets = [set(map(int, near_dup.shingle_set(t, 4))) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 4, 80).collect()}
    least = {x: min(i for i, y in enumerate(label) if y == x) for x in label}
    assert got == {i: least[x] for i, x in enumerate(label)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = ["n_words", "kept", "llr", "covered", "copies", "cut", "c", "label", "leaf", "node", "tie", "d", "h"]
    rng = random.Random(6)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    first = say(120)
    rows = [(0, first), (1, first + " more"), (2, first), (3, "short"), (4, None), (5, say(100)), (6, say(80)), (6, say(70))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(x).alias(x) for x in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = common.written(stage(spark, at, str(tmp_path)), "test")
        assert at.columns == docs.columns and all(r[x] == x for r in at.collect() for x in names)
    assert sorted(r.doc_id for r in at.collect()) == [0, 5, 6, 6]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4

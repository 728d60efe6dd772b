"""Operators against plain versions on a small table with nulls, empty and long texts, copies and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import byte_bpe, common, fingerprint, language_id, mixing, near_dup, ppm, quality, spans, suffixes, token_file

SCHEMA = "doc_id long, text string, lang string, source string, k long, size string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    shared = " ".join(line(9) for _ in range(8))
    out = []
    for i in range(60):
        text = "\n".join(line(rng.randint(2, 12)) for _ in range(rng.randint(1, 20)))
        out.append((i, text + (" " + shared if i % 7 == 0 else ""), "en" if i % 2 else "fr", f"s{i % 4}" if i % 9 else None))
    out += [(100 + i, out[i][1], "en", "s0") for i in range(5)]
    out += [(200 + i, out[i + 10][1] + " extra", "en", "s0") for i in range(5)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", "s1"), (303, line(4000), "fr", "s2"), (None, line(30), "en", "s2"), (5, out[5][1], "fr", out[5][3])]
    return [(*r, 1, "x") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = collections.Counter((r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) for r in quality.judged(docs, labels).collect())
    want = collections.Counter()
    for d, text, *_ in rows:
        w = common.WORDS.findall(text or "")
        c = collections.Counter(zip(w, w[1:], w[2:]))
        lines = [x for x in (text or "").split("\n") if common.WORDS.search(x)]
        covered = {q for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        want[d, len(w), len(covered), len(lines) - len(set(lines)), sum(map(len, w))] += 1
    assert got == want
    assert quality.judged(empty, labels).count() == 0


def test_bpe(docs, rows, empty):
    import base64

    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.spark_digests(docs, path, pattern).collect())
    want = []
    for _, text, *_ in rows:
        ids = e.encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.spark_digests(empty, path, pattern).count() == 0
    decoded = byte_bpe.spark_decode(byte_bpe.spark_encode(docs, path, pattern), path, pattern)
    assert sorted(bytes(r.bytes) for r in decoded.collect()) == sorted((r[1] or "").encode() for r in rows)


def test_token_file(spark, docs, rows, empty):
    import public_tokenizers

    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1, 3, 4], "<u4")
    assert (token_file.unpack(*token_file.pack(v), len(v)) == v).all()
    for table in (docs, empty):
        out = common.scratch_path(spark, "test")
        token_file.write(table, public_tokenizers.path("byte_bpe_50k.json"), out)
        got = sorted(token_file.digests(token_file.read(spark, out)).collect(), key=lambda r: r.start)
        assert len(got) == table.count()
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert ids == sorted(ids)


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprint.edited_neighbours(docs.filter("doc_id IS NULL OR doc_id <> 5"), 4000).collect()
    order = [r for r in order if r[0] != 5]
    by = {r.doc_id: r for r in got}
    assert len(got) == len(order)
    for (d, a, *_), (_, b, *_) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        half = len(a) // 2
        assert by[d].edited_sha256 == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
    assert by[100].fingerprint == by[0].fingerprint
    assert fingerprint.edited_neighbours(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values()) and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_language_id(docs, empty):
    model = language_id.train(language_id.training_sample(docs))
    out = language_id.identified(docs, model).collect()
    assert {r.lang_pred for r in out if r.doc_id in (300, 301, 302)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.train(language_id.training_sample(empty)).predict("some text") == ("und", 0.0)


def test_language_model(docs, rows, empty):
    got = {r.doc_id: r for r in ppm.scored(docs, 3000).collect()}
    known = collections.Counter(w for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in ppm.tokens_of(t or ""))
    n, v = sum(known.values()), len(known)
    for d, t, *_ in rows:
        tokens = ppm.tokens_of(t or "")
        assert got[d].train_tokens == n and got[d].n_tokens == len(tokens) and got[d].n_known == sum(known[w] > 0 for w in tokens)
        assert got[d].base_score == pytest.approx(sum(np.log10((known[w] + 1) / (n + v + 1)) for w in tokens))
        assert got[d].score < 0
    assert ppm.scored(empty).count() == 0


def test_spans(docs, rows, empty):
    got = spans.deduplicated(docs)
    assert got.columns == [*docs.columns, "__removed"]
    first, want = {}, []
    unique = sorted({(d if d is not None else -1, t) for d, t, *_ in rows if t is not None})
    for d, t in unique:
        for at, _, h in spans.runs(t):
            first.setdefault(h, (d, at))
    for d, t, *_ in rows:
        want.append(None if t is None else spans.without(t, [(at, n) for at, n, h in spans.runs(t) if first[h] != (d if d is not None else -1, at)])[0])
    assert sorted(map(str, want)) == sorted(str(r.text) for r in got.collect())
    assert spans.deduplicated(empty).count() == 0


def test_suffixes(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for t in texts:
        runs = suffixes.merged([(i, i + 200) for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1])
        want.append((len(t), [tuple(x) for x in runs]))
    got = [(r.n_bytes, [tuple(x) for x in r.spans]) for r in suffixes.removed(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.removed(empty).count() == 0


def test_near_duplicates(docs, rows, empty):
    sets = [set(map(int, near_dup.shingle_set(r[1], 4))) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted((str(r[0]), str(least.get(find(i)))) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_dup.near_duplicates(docs, 4, 80).collect()) == want
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.kept_rows(docs).columns == docs.columns


def test_near_duplicates_spared_work(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), "id")
    names = keys.filter("id % 10 = 0").select("key")
    for bits in (8, 24):  # a full bitmap keeps all, a wide one little else
        left = {r["id"] for r in near_dup.maybe_in(keys, names, bits).collect()}
        assert left >= set(range(0, 4000, 10))
        assert bits == 8 or len(left) < 410
    assert near_dup.maybe_in(keys, names.limit(0)).count() == 0
    sets = {1: "ab", 2: "ab", 3: "abc", 4: "cd", 5: "e"}
    placed = spark.createDataFrame([(k, bytearray(c.encode())) for k, cs in sets.items() for c in cs], "leaf long, c binary")
    assert {r["leaf"] for r in near_dup.distinct_leaves(placed).collect()} == {1, 3, 4}


def test_near_duplicates_dense(spark):
    """A star: 2400 edited copies are each like the original, and hardly like each other; and a group with a common part only."""
    rng = random.Random(5)
    first = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(first))]
    for i in range(1, 2400):
        text = list(first)
        for at in range(10 + i % 3, 190, 45):
            text[at + rng.randrange(40)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    part = [f"p{i}" for i in range(130)]
    for i in range(700):
        rows.append((10_000 + i, " ".join(part + [f"y{i}x{j}" for j in range(70)])))
    sets = [set(map(int, near_dup.shingle_set(t, 4))) for _, t in rows]
    assert all(100 * len(s & sets[0]) >= 80 * len(s | sets[0]) for s in sets[:2400])
    assert not 100 * len(sets[2400] & sets[2401]) >= 80 * len(sets[2400] | sets[2401])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 4, 80).collect()}
    assert got == {d: d if d >= 10_000 else 0 for d, _ in rows}


def test_near_duplicates_blocks(spark):
    names = {i: bytes([i // 256, i % 256]) for i in range(1500)}
    labels = {names[i]: names[0] for i in range(700)} | {names[i]: names[700] for i in range(700, 710)}
    dense = spark.createDataFrame([(7, bytearray(c)) for c in names.values()], "leaf long, c binary")
    known = spark.createDataFrame([(bytearray(c), bytearray(x)) for c, x in labels.items()], "c binary, label binary")
    leaves = collections.defaultdict(list)
    for r in near_dup.blocks(dense, known)[0].collect():
        leaves[r.leaf].append((bytes(r.c), r.side))
    met = {(min(a, b), max(a, b)) for at in leaves.values() for i, (a, x) in enumerate(at) for b, y in at[:i] if x != y or x == 0}
    all_names = sorted(names.values())
    assert {(a, b) for i, b in enumerate(all_names) for a in all_names[:i] if labels.get(a, a) != labels.get(b, b)} <= met
    assert max(map(len, leaves.values())) < 3 * near_dup.LEAF
    assert near_dup.blocks(dense, known.unionByName(dense.join(known, "c", "left_anti").select("c", F.lit(bytearray(names[0])).alias("label"))).withColumn("label", F.lit(bytearray(names[0]))))[0].count() == 0


def test_near_duplicates_rounds(spark):
    """Likelier pairs fail until a round confirms nothing; the link of the lowest estimate is judged still."""
    same = [f"w{i}" for i in range(60)]
    texts = [" ".join(same), " ".join([*same, "more"]), " ".join(f"y{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    # coordinates in which some differ from the others: of 512, a-c and b-d differ in 88, a-d, b-c and c-d in 92, a-b in 108
    split = [(0,)] * 44 + [(1,)] * 44 + [(2,)] * 36 + [(3,)] * 36 + [(0, 2)] * 12 + [(0, 3)] * 8
    sigs = [np.array([i in x for x in split] + [0] * (512 - len(split)), np.uint8) for i in range(4)]
    ties = {r.doc_id: r.tie for r in docs.select("doc_id", F.xxhash64("text").alias("tie")).collect()}
    made = [(bytearray(b"abcd"[i : i + 1]), (i, ties[i]), 57, bytearray(sigs[i].tobytes())) for i in range(4)]
    classes = spark.createDataFrame(made, "c binary, rep struct<d: long, tie: long>, n long, sig binary")
    placed = common.written(classes.select(F.lit(1).cast("long").alias("leaf"), "c"), "leaves")
    judged, labels = near_dup.linked(docs, classes, placed, None, 4, 80)
    assert {bytes(r.c) for r in labels.collect()} == {b"a", b"b"}
    assert judged.count() == 6


def test_quality_shares(spark):
    """Clean documents of a language, or of a source with its own words, that the target has less of than the corpus stay."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        lang, source = ("de", "s0") if i % 4 == 0 else ("en", "s1") if i % 4 == 1 else ("en", "s0")
        text = " ".join(f"{lang}{source}{rng.randrange(9)}" for _ in range(200))
        junk = i % 40 in (3, 8)
        rows.append((i, " ".join(f"{lang}{source}{rng.randrange(9)} #{rng.randrange(9)}" for _ in range(100)) if junk else text, lang, source, junk))
        if not junk and (i % 4 > 1 or i % 20 < 2):
            labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    out = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all((r.llr >= quality.THRESHOLD) != r.junk for r in out)  # some repeat too much for the base rules


def test_spans_short_runs(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    two, one = f"{say(30)}. {say(30)}.", f"{say(60)}."
    far = "".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(90)) + "\u3002" for _ in range(2))
    rows = []
    for i in range(6):
        mark = "\u3002" if i > 3 else ". "
        rows.append((i, f"{say(8)}{mark}{(two, one, far)[i // 2]}{'' if i > 3 else ' '}{say(9)}"))
    got = {r.doc_id: r for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, part in ((1, two), (3, one), (5, far)):
        assert got[i - 1].text == rows[i - 1][1] and part in rows[i][1]
        assert got[i]["__removed"] == (5 if part == one else 6) and part[:20] not in got[i].text


def test_spans_shuffle_hashes_only(spark):
    """Of runs that don't repeat little more than a 64-bit hash is shuffled; those that do repeat are found all the same."""

    def text(d):
        return " ".join(f"w{d * 1000 + i}{'.' if i % 8 == 7 else ''}" for i in range(400))

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        each = sc.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    rows = [(d, text(d)) for d in range(1, 400)] + [(400, text(7) + " " + text(400)), (401, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    n, before = sum(len(spans.runs(t)) for _, t in rows), shuffled()
    gone = {r.d: {(c["at"], c["n"]) for c in r.covered} for r in spans.repeated(docs).collect()}
    assert shuffled() - before < 28 * n
    assert set(gone) == {400, 401} and gone[401] == {(at, k) for at, k, _ in spans.runs(text(7))} == gone[400]

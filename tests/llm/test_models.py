"""Language, quality and tokens: held-out accuracy, exact code lengths, round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from refloom.llm import byte_bpe, ppm_language, zstd_quality
from refloom.llm.common import bounded_sample

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(NAME))


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_that_of_the_ranks(docs, texts, ranks, oracle):
    found = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(found) == len(texts)
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(t or "")
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = bytes(r.decoded).decode()
        assert text in by[r.doc_id] and ids == oracle.encode_ordinary(text) and r.n_tokens == len(ids)
        for k, a, b in zip(ids, r.starts, r.ends, strict=True):
            assert oracle.decode_single_token_bytes(k) in text[a:b].encode()


def test_bpe_merges_as_the_ranks_do(ranks, oracle):
    tokenizer, rng = byte_bpe.build_tokenizer(ranks, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(3000):
        alphabet = rng.choice(["ab", "aàé", "thes ", " \n\t", "0 1a", "ん日本語a", "!?-.=*", "'s't're", "🙂é "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert tokenizer.encode(text, add_special_tokens=False).ids == oracle.encode_ordinary(text)


def test_decode(spark, ranks, oracle):
    ids = np.array(oracle.encode_ordinary("naïve 🙂 漢"), "<u4")
    rows = [(1, ids.tobytes()), (2, None), (3, b""), (4, ids[:-1].tobytes())]
    found = {r.doc_id: r for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), ranks).collect()}
    assert found[1].decoded_text == "naïve 🙂 漢" and bytes(found[2].decoded) == bytes(found[3].decoded) == b""
    parts = byte_bpe.pieces(ids.tobytes(), byte_bpe.byte_table(ranks))
    assert len(parts) == len(ids) and "".join(parts) == "naïve 🙂 漢"


def test_empty_tables(no_docs, ranks, spark):
    assert byte_bpe.encode(no_docs, ranks, public_tokenizers.PATTERN).count() == 0
    model = ppm_language.learn(no_docs)
    assert model.languages == [] and ppm_language.identify(no_docs, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert zstd_quality.score(no_docs, zstd_quality.learn(no_docs, labels)).count() == 0


def test_without_anything_learned(docs, texts, no_docs, spark):
    found = ppm_language.identify(docs, ppm_language.learn(no_docs)).collect()
    assert len(found) == len(texts) and {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    labels = spark.createDataFrame([(10, None), (11, 1), (999, 0)], "doc_id long, quality int")
    found = zstd_quality.score(docs, zstd_quality.learn(docs, labels)).collect()
    assert len({r.score for r in found}) == 1 and 0 <= found[0].score <= 1


def plain_bits(model_counts, language, text):
    """Code length by the definition, context by context."""
    counts = {}
    for lang, gram, n in model_counts:
        if lang == language:
            length = gram >> 40
            run = (gram & 0xFFFFFFFF).to_bytes(4, "big")[4 - length :]
            counts.setdefault(run[:-1], {})[run[-1]] = n
    seen = {(gram & 255) for _, gram, _ in model_counts if gram >> 40 == 1}

    def distribution(context):
        below = dict.fromkeys(range(256), 1 / 256) if not context else distribution(context[1:])
        own = counts.get(context)
        if not own:
            return below
        n, d = sum(own.values()), len(own)
        spare = sum(p for s, p in below.items() if s not in own)
        return {s: own[s] / (n + d) if s in own else d / (n + d) * p / spare for s, p in below.items()} if spare > 0 else {s: own.get(s, 0) / n for s in below}

    known = {g[:-1] for g in (((gram & 0xFFFFFFFF).to_bytes(4, "big")[4 - (gram >> 40) :]) for _, gram, _ in model_counts)}
    total = 0.0
    for k, byte in enumerate(text):
        context = text[max(0, k - 3) : k]
        while context not in known or not set(context) <= seen:
            context = context[1:]
        total -= np.log2(distribution(context)[byte])
    return total


def test_code_lengths_are_exact():
    rng = random.Random(2)
    corpus = {"x": "".join(rng.choice("abc ") for _ in range(400)).encode(), "y": "".join(rng.choice("abd ") for _ in range(300)).encode()}
    counts = {}
    for lang, text in corpus.items():
        for length in range(1, 5):
            for k in range(len(text) - length + 1):
                key = lang, int.from_bytes(text[k : k + length], "big") | length << 40
                counts[key] = counts.get(key, 0) + 1
    rows = [(lang, gram, n) for (lang, gram), n in counts.items()]
    lang, gram, n = zip(*rows, strict=True)
    for cells in (1 << 20, 0):  # as a matrix, and as differences along the tree
        model = ppm_language.build(list(lang), np.array(gram), np.array(n), cells)
        assert model.languages == ["x", "y"] and (model.matrix is None) == (cells == 0)
        cases = [b"", b"a", b"ab", b"abc cab", b"zq! abd", corpus["y"][:50], b"", corpus["x"][:300] + bytes(range(256))]
        expected = [[plain_bits(rows, lang, text) for lang in "xy"] for text in cases]
        data, bounds = np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0, *map(len, cases)])
        for block in (1 << 20, 28):
            assert ppm_language.code_lengths(model, bounds, data, block) == pytest.approx(np.array(expected), rel=1e-4, abs=1e-3)


def test_sample_is_bounded_in_bytes(spark):
    rows = [(k, "ab"[k % 2], "x" * 100) for k in range(200)] + [(900, "c", "x" * 5000)]
    found = bounded_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "lang", 80, total_bytes=3000)
    assert {r.lang: r["count"] for r in found.groupBy("lang").count().collect()} == {"a": 10, "b": 10, "c": 1}


def test_languages_of_held_out_rows(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "mo", "ri", "tsu"], "bb": ["str", "ung", "che", "ver"], "cc": ["ción", "los", "que", "ar"]}
    rows = [(k, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(3, 60))), lang) for k in range(600) for lang in [rng.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "cc"), (1003, "karimo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in ppm_language.identify(docs, ppm_language.learn(docs, per_language=60)).collect()}
    assert [found[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and found[1002].score == 0
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([found[k].lang_pred == lang for k, _, lang in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_quality_of_held_out_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for k in range(800):
        good = rng.random() < 0.7
        text = " ".join(rng.choices(words, k=rng.randint(40, 200)))
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((k, int(good)))
    rows += [(900, None), (901, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r.score for r in zstd_quality.score(docs, zstd_quality.learn(docs, marks, per_class=120)).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(found[k] >= 0.3) == bool(y) for k, y in held]) >= 0.95
    assert found[900] == found[901] and all(0 <= s <= 1 for s in found.values())


def test_bounded_sample(spark):
    rows = [(k, "big" if k % 10 else "small", "t") for k in range(2000)] + [(None, "big", "t"), (5000, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = {r.lang: r["count"] for r in bounded_sample(docs, "lang", 50).groupBy("lang").count().collect()}
    assert counts == {"big": 50, "small": 50}
    first = {r.doc_id for r in bounded_sample(docs, "lang", 50).collect()}
    assert first == {r.doc_id for r in bounded_sample(docs.repartition(7), "lang", 50).collect()}


def test_three_hundred_languages(spark):
    """No language is left out, whatever their number, and the tables stay small; more than the bound are an error."""
    rng = random.Random(8)
    rows = []
    for k in range(300):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)]
        rows += [(8 * k + j, " ".join(rng.choices(syllables, k=25)), f"l{k:03d}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm_language.learn(docs)
    assert len(model.languages) == 300 and sum(x.nbytes for x in vars(model).values() if isinstance(x, np.ndarray)) < 150 << 20
    found = {r.doc_id: r.lang_pred for r in ppm_language.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([found[i] == lang for i, _, lang in held]) >= 0.95
    with pytest.raises(ValueError, match="classes"):
        ppm_language.learn(docs, max_languages=299)


def test_without_a_shared_folder(spark, monkeypatch):
    """On a cluster no machine's own folder stands in for the shared one; temporary tables go, kept ones stay."""
    from pathlib import Path

    from refloom.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster())
    with common.temporary(spark) as keep:
        gone = common.cut(spark.range(3))
        stays = keep(gone.where("id > 0"))
    assert stays.count() == 2
    assert not any(Path(f.removeprefix("file:")).exists() for f in gone.inputFiles())


def test_scores_by_a_plain_loop(spark):
    """Every score against sizes that are taken one block after the other, by the definition of the model's features; long texts included."""
    import zstandard

    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = [(k, " ".join((w.upper() if k % 3 else w) for w in rng.choices(words, k=rng.choice([1, 5, 60, 300])))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "漢字🙂" * 300), (403, " ".join(rng.choices(words, k=200_000))), rows[5], (None, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int")
    m = zstd_quality.learn(docs, marks, per_class=80)
    options = {"level": zstd_quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    kinds = [zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT for raw in m.raw]
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=k), **options) for d, k in zip((m.good, m.bad), kinds, strict=True))
    plain = zstandard.ZstdCompressor(**options)

    def expected(text):
        raw = (text or "").encode()
        blocks = [raw[k : k + m.block] for k in range(0, len(raw), m.block)]
        g, b, p = (sum(len(c.compress(x)) for x in blocks) for c in (good, bad, plain))
        d, r = ((b - g) / (b + g), p / (len(raw) + 9 * len(blocks))) if blocks else (0.0, 0.0)
        z = sum(w * (f - c) / s for w, f, c, s in zip(m.weights, (1, d, r, d * r, d * d, r * r), m.center, m.scale, strict=True))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

    found = zstd_quality.score(docs, m).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert len(found) == len(rows)
    for r in found:
        assert any(r.score == pytest.approx(expected(t), abs=1e-9) and r.n_bytes == len((t or "").encode()) for t in texts[r.doc_id])


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(k, ("good words here " if k % 2 else "BAD!! ") * 500) for k in range(400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(zstd_quality, "_dictionary", lambda blocks, size: (seen.append(sum(map(len, blocks))) or b"".join(blocks)[-size:], True))
    found = {r.doc_id: r.score for r in zstd_quality.score(docs, zstd_quality.learn(docs, marks, sample_bytes=100_000)).collect()}
    assert sum(seen) <= 100_000 and min(seen) > 10_000
    assert all((found[k] > 0.5) == bool(k % 2) for k in range(400))


def test_tokens_with_several_splits(ranks, oracle):
    """Random runs of pieces of long tokens: what tokenizers merges by pairs is what the ranks alone decide."""
    rng = random.Random(15)
    tokenizer = byte_bpe.build_tokenizer(ranks, public_tokenizers.PATTERN)
    long = [t.decode() for t in ranks if 4 <= len(t) <= 12 and t.isalpha() and t.isascii()]
    several = [t for t in long if sum(t[:i].encode() in ranks and t[i:].encode() in ranks for i in range(1, len(t))) > 2]
    assert len(several) > 1000
    for _ in range(4000):
        words = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(several)
            i, j = sorted(rng.choices(range(len(t) + 1), k=2))
            words.append(rng.choice([t + t[:i], t[i:] + rng.choice(several), t[i:j] + t, t[:j] + rng.choice(long)[i:], t]))
        text = rng.choice(["", " "]) + rng.choice([" ", ""]).join(words)
        assert tokenizer.encode(text, add_special_tokens=False).ids == oracle.encode_ordinary(text)

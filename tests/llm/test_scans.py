"""Secrets, shards, sketches, benchmark passages and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from refloom.llm import decontaminate, fingerprint, queries, secret_scan, sharding
from tests.llm.test_dedup import split

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def random_key(rng, n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def secret_texts():
    rng = random.Random(9)
    pieces = ["password: token: abcdefgh", "Token == 'x1y2z3w4'", "api_key=short", "APIKEY\": \"" + random_key(rng, 30), "AKIA" + random_key(rng, 16, "ABCDEFGH2345"), "AKIAAKIA", "deadbeef" * 4, "DEADBEEF" * 4, "0123456789abcdef0123456", "é🙂 secret = " + "z" * 6, "passwd:::=abc", "plain words only"]
    out = [(k, p) for k, p in enumerate(pieces)]
    out += [(100 + k, " ".join(rng.choices(pieces + ["lorem", "ipsum", "ünï"], k=rng.randint(0, 12)))) for k in range(40)]
    return [*out, (200, None), (201, ""), (202, "token=abcdefg " * 400)]


def test_base_spans(spark):
    rows = secret_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in docs.transform(lambda d: secret_scan.scan(d).selectExpr("doc_id", f"{secret_scan.listed('base')} AS base", f"{secret_scan.listed('found')} AS found")).collect():
        expected = base_spans(dict(rows)[r.doc_id] or "")
        assert r.base == ",".join(expected)
        assert not Counter(expected) - Counter(r.found.split(","))


def test_randomness(spark):
    """Random keys are found, words, paths, numbers and repeats are not."""
    rng = random.Random(3)
    keys = [random_key(rng, n) for n in (24, 32, 40, 64) for _ in range(25)] + [random_key(rng, 40, "0123456789ABCDEF") for _ in range(20)]
    plain = ["internationalization2024report", "home/users/documents/reports/final2023", "aaaaaaaaaaaa1111111111111111", "abcdefghijklmnopqrstuvwxyz0123456789", "20240101_20240202_20240303_20240404", "the_quick_brown_fox_jumps_over_13_lazy_dogs"]
    docs = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(keys + plain)], "doc_id long, text string")
    found = {r.doc_id: r.n for r in secret_scan.scan(docs).selectExpr("doc_id", "size(filter(found, x -> x.kind = 'random')) AS n").collect()}
    assert sum(found[k] for k in range(len(keys))) >= 0.85 * len(keys)
    assert sum(found[k] for k in range(len(keys), len(keys) + len(plain))) == 0


SYLLABLES = "the in re on ti er an de le que ung sch ver con tion mar ta lo es en vo ra mi pre cal ste por ment ous ing".split()


def ordinary(rng):
    """A name, path or slug of words and numbers, as they stand in text."""
    while True:
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(2, 8))]
        for _ in range(rng.randint(1, 3)):
            words.insert(rng.randint(1, len(words)), rng.choice([str(rng.randint(1990, 2030)), str(rng.randint(0, 99)), f"2{rng.randint(0, 999):03d}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"v{rng.randint(1, 9)}", str(rng.randint(0, 999999))]))
        style = rng.randrange(5)
        token = "".join(w.capitalize() for w in words) if style == 0 else ("_", "-", "/", "")[style - 1].join(words)
        if len(token) >= 20 and re.search("[0-9]", token):
            return token


def test_false_discoveries_and_recall_by_length(spark):
    """Of what is reported among many ordinary tokens, a twentieth at most is ordinary; long keys are all found, short ones as far as the tests can tell them."""
    rng = random.Random(21)
    alphabets = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    keys = [(n, a, "1k" + random_key(rng, n - 2, a) if a[0] == "0" and "z" in a else "A2" + random_key(rng, n - 2, a)) for n in (20, 24, 32, 40, 64) for a in alphabets for _ in range(40)]
    tokens_ = [k for _, _, k in keys] + [ordinary(rng) for _ in range(3000)]
    tokens_.append("x9Kq2LmZp8Rt4Wv7Yb1Nc6Hd")
    order = rng.sample(range(len(tokens_)), len(tokens_))
    lines = [(k // 7, tokens_[i]) for k, i in enumerate(order)]
    docs = spark.createDataFrame([(g, "\n".join(t for h, t in lines[7 * g : 7 * g + 7])) for g in range(-(-len(lines) // 7))], "doc_id long, text string")
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    found = {texts_of[r.doc_id][x.start : x.end] for r in secret_scan.scan(docs).collect() for x in r.found if x.kind == "random"}
    plain = set(tokens_[len(keys) : -1])
    assert len(found & plain) <= 0.05 * len(found) and tokens_[-1] in found
    recall = {(n, k): sum(t in found for m, a, t in keys if (m, a) == (n, alphabets[k])) / 40 for n in (20, 24, 32, 40, 64) for k in range(len(alphabets))}
    assert all(recall[64, k] >= 0.9 for k in range(5)) and all(recall[n, k] >= 0.9 for n in (32, 40) for k in (0, 1)) and all(recall[24, k] >= 0.6 for k in (0, 1))
    assert all(recall[20, k] < recall[40, k] for k in range(5))


def test_nothing_is_found_among_ordinary_tokens(spark):
    rng = random.Random(22)
    docs = spark.createDataFrame([(k, ordinary(rng)) for k in range(1500)], "doc_id long, text string")
    assert secret_scan.scan(docs).selectExpr("sum(size(filter(found, x -> x.kind = 'random'))) AS n").first().n <= 3


def test_many_candidates_in_one_text(spark):
    """Ten thousand keys and as many base secrets in one text: work grows little faster than their number."""
    import time

    rng = random.Random(23)
    text = " ".join(f"{random_key(rng, 30)} token={random_key(rng, 8)}" for _ in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = secret_scan.scan(docs).selectExpr("size(base) AS b", "size(found) AS f").first()
    assert row.b == 10_000 and row.f > 19_000 and time.perf_counter() - began < 60
    redacted = secret_scan.redact(docs).first().text
    assert redacted.count("[SECRET]") == row.f and "token=" not in redacted


def test_redaction(spark):
    rows = [(1, "a token=abcdef1 b", 7), (2, "clean", 5), (3, None, 0), (4, "secret: " + "0123456789abcdef" * 2, 1), (5, "password=abcdefgh", 1)]
    done = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, found int")).collect()}
    assert done == {1: "a [SECRET] b", 2: "clean", 3: None, 4: "[SECRET]", 5: "[SECRET]"}


def test_scan_handles_any_rows(docs, texts, no_docs):
    assert secret_scan.scan(docs).count() == len(texts) and secret_scan.scan(no_docs).count() == 0


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(docs, texts, law):
    found = sharding.shards(docs, 4, law, rows_per_range=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for k in range(4):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    rows = Counter(r.shard for r in found)
    if law == "rows":
        assert max(rows.values()) - min(rows.values()) <= 1
    else:
        total = sum(r.size for r in found)
        sizes = [sum(r.size for r in found if r.shard == k) for k in range(4)]
        assert max(abs(s - total / 4) for s in sizes) <= max(r.size for r in found)


def test_many_copies_are_spread(spark):
    docs = spark.createDataFrame([(k, "copy" if k % 3 else f"text {k}") for k in range(3000)], "doc_id long, text string")
    found = sharding.shards(docs, 8, rows_per_range=20).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 20
    alone = {}
    for r in found:
        alone.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in alone.values()) <= 1  # the copies, which are more than a shard holds


def test_small_groups_beside_a_hot_text_stay_whole(spark):
    rows = [(k, "copy of a text that half of all rows have") for k in range(3000)] + [(3000 + k, f"group {k % 600} with five copies of this text") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for per in (5, 20, 100):
        places = {}
        for r in sharding.shards(docs, 8, rows_per_range=per).collect():
            places.setdefault(r.text_crc32, set()).add(r.shard)
        assert sorted(len(p) for p in places.values())[-2] == 1 and max(map(len, places.values())) >= 4


def test_shards_of_nothing(no_docs):
    assert sharding.shards(no_docs).count() == 0


def shingles(text):
    w = split(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits(docs, texts):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = Counter()
    near = {}
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected[i, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        near[i, edited] = likeness(shingles(text), shingles(edited)), likeness(shingles(text), shingles(after))
    found = fingerprint.compare_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in found) == expected
    by_text = {}
    for r in found:
        assert [r.near_edited, r.near_next] == pytest.approx(near[r.doc_id, r.edited], abs=0.25)
        assert by_text.setdefault(r.text, r.sketch) == r.sketch
        assert r.n_shingles == pytest.approx(len(shingles(r.text)), rel=0.35, abs=1)


def test_next_row_across_buckets(spark):
    rows = [(k * k - 50, f"t{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for per in (1, 7, 1000):
        found = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"], rows_per_bucket=per).collect()}
        assert found == {i: rows[(k + 1) % 40][1] for k, (i, _) in enumerate(rows)}


def test_next_row_whatever_the_ids(spark):
    """Ids far apart, null ids and one id for many rows: the next row is right, and no range holds much more than its share."""
    rng = random.Random(31)
    rows = [(k, f"a{k}") for k in range(300)] + [(10**15, "far"), (-(10**15), "near")] + [(None, f"{rng.random():.9f}") for _ in range(500)] + [(77, f"{rng.random():.9f}") for _ in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    found = fingerprint.with_next(docs, ["text"], rows_per_bucket=20, draws=1000)
    assert {(r.doc_id, r.text): r.next_text for r in found.collect()} == {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    key = "struct(doc_id IS NOT NULL AS known, coalesce(doc_id, 0) AS id, substring(text, 1, 12) AS head)"
    keys = docs.selectExpr(f"{key} AS k")
    splitters = fingerprint._splitters(keys.select("k.*"), len(rows), len(rows) // 20, 1000)
    sizes = keys.groupBy(fingerprint._bucket_of(keys.k, splitters).alias("b")).count().collect()
    assert len(sizes) == len(rows) // 20 and max(r["count"] for r in sizes) <= 25


def test_merged_sketches(spark):
    docs = spark.createDataFrame([(k % 2, " ".join(f"w{k}_{j}" for j in range(60))) for k in range(10)], "g int, text string")
    parts = docs.select("g", fingerprint.sketch(docs.text, 32).alias("sketch"))
    whole = {r.g: r.sketch for r in fingerprint.merge(parts, ["g"], keep=32).collect()}
    for g in (0, 1):
        every = sorted({h for r in docs.where(f"g = {g}").select(fingerprint.shingle_hashes(docs.text).alias("h")).collect() for h in r.h})
        assert whole[g] == every[:32]


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def leaks(rows, items):
    out = set()
    for i, t in rows:
        d = tokens(t)
        for item, text in items:
            w = tokens(text)
            n = min(13, len(w))
            for shift in range(-len(w) + 1, len(d)) if w else ():
                equal = [0 <= j + shift < len(d) and d[j + shift] == x for j, x in enumerate(w)]
                if any(5 * sum(equal[k : k + n]) >= 4 * n for k in range(len(w) - n + 1)):
                    out.add((i, item))
    return out


def leaky_rows(rng, lengths, count):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(lengths)]
    rows = []
    for k in range(count):
        passage = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(passage) - 13))
        part = passage[a : a + rng.choice([10, 13, 18, 40])]
        for _ in range(rng.randint(0, max(1, len(part) // 4))):
            part[rng.randrange(len(part))] = word()
        rows.append((k, " ".join([*(word() for _ in range(rng.randint(0, 30))), ", ".join(part).upper(), *(word() for _ in range(rng.randint(0, 9)))])))
    return rows, items


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_passages_with_replaced_tokens(spark, monkeypatch, broadcast):
    """Items of 1 to 13 tokens and more, with tokens replaced; with seeds broadcast and shuffled; with chunks of few alignments."""
    rng = random.Random(11)
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    monkeypatch.setattr(decontaminate, "CHUNK", 2)
    rows, items = leaky_rows(rng, [*range(1, 14), 5, 9, 10, 11, 12, 14, 20, 40, 13, 20], 150)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (None, rows[3][1]), (1003, items[19][1]), (1003, word()), (1004, " ".join([items[19][1]] * 3)), (1005, " ".join(items[20][1].split()[3:16]))]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (50, None), (51, ""), (52, items[19][1]), items[19], (None, items[18][1])], "item_id long, text string")
    expected = leaks([r for r in rows if r[0] is not None], [*items, (52, items[19][1])])
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark).collect()}
    assert found == expected and len({i for _, i in expected}) > 20
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, benchmark, shortest=9).collect()} == {(d, i) for d, i in expected if len(tokens(dict([*items, (52, items[19][1])])[i])) >= 9}
    bad = {t for i, t in rows if t and leaks([(i, t)], [x for x in items if len(tokens(x[1])) >= 5])}
    kept = decontaminate.clean(docs, benchmark)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if t not in bad)


def test_every_pattern_of_replaced_tokens(spark):
    """All ways to replace as many tokens as the rule allows, for items of each length up to 13."""
    from itertools import combinations

    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 14)]
    rows = []
    for n, text in items:
        words = text.split()
        for gone in combinations(range(n), n - -(-4 * n // 5)):
            rows.append((len(rows), n, "before " + " ".join("other" if k in gone else w for k, w in enumerate(words)) + " after"))
    docs = spark.createDataFrame(rows, "doc_id long, n long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, n) for i, n, _ in rows}


def test_leaks_sql_agrees(spark, tmp_path):
    """The oracle and the operator, on items of all lengths."""
    import duckdb
    import pandas as pd

    rows, items = leaky_rows(random.Random(12), [*range(1, 14), 9, 10, 11, 12, 25], 120)
    documents, benchmark = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])
    for name, frame in (("documents", documents), ("benchmark", benchmark)):
        spark.createDataFrame(frame).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ["doc_id", "item_id", "n_tokens", "n_equal", "share"]
    expected = {tuple(r[k] for k in names) for r in duckdb.sql(queries.ORACLE_SQL["op10_decontaminate"]).df().to_dict("records")}
    assert {tuple(r[k] for k in names) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect()} == expected and len(expected) > 60


def test_leaks_among_any_rows(spark, docs, texts, no_docs):
    """Null and empty texts, null ids, repeated rows, long texts, clashing names and empty tables on both sides."""
    items = spark.createDataFrame([(1, texts[30][1]), (2, None), (3, " ".join(texts[45][1].split()[5:40]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert found == leaks([r for r in texts if r[0] is not None], [(1, texts[30][1]), (3, " ".join(texts[45][1].split()[5:40]))])
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and decontaminate.clean(docs, items.limit(0)).count() == len(texts)
    assert decontaminate.overlaps(no_docs, items).count() == decontaminate.clean(no_docs, items).count() == decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_masks_hit_any_two_replacements():
    from itertools import combinations

    reads = [[k for k, bit in enumerate(m) if bit == "1"] for m in decontaminate.MASKS]
    for gone in combinations(range(13), 2):
        assert any(not {a + k for k in r} & set(gone) for r in reads for a in range(13 - decontaminate.SPAN + 1))


def test_pipeline(spark, docs, texts, no_docs, tmp_path):
    benchmark = spark.createDataFrame([(1, texts[40][1] + " one more word for the end of it all in the text of this item")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, rows, str(tmp_path))
        assert made.columns == rows.columns and made.dtypes == rows.dtypes, name
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
        rows = made.cache()
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter(ids) == Counter(r.doc_id for r in rows.collect())
    assert not {1, 2} & set(ids) and 3 in ids  # no letter, one letter
    assert len([i for i in ids if i in (82, 83)]) <= 1


def test_pipeline_keeps_texts_when_no_language_is_known(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)


def test_secrets_sql_agrees(spark):
    """The oracle's battery and the operator's, on random keys beside other runs of symbols."""
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    rows = [(k, " ; ".join(random_key(rng, rng.randint(20, 70), rng.choice(["0123456789ABCDEF", "abcdefghij0123456789+/-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "aabbccdd11223344", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])) for _ in range(rng.randint(0, 5)))) for k in range(150)]
    documents = pd.DataFrame(rows + secret_texts()[:12], columns=["doc_id", "text"])  # noqa: F841  the SQL reads it by name
    documents["doc_id"] = range(len(documents))
    expected = {tuple(r[k] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")) for r in duckdb.sql(queries.ORACLE_SQL["op1_secret_scan"]).df().to_dict("records")}
    frame = spark.createDataFrame(documents)
    import tempfile

    folder = tempfile.mkdtemp()
    frame.write.parquet(f"{folder}/documents.parquet")
    found = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_random) for r in queries.op1_secret_scan(spark, folder).collect()}
    assert found == expected and sum(r[-1] for r in found) > 50

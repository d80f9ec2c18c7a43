"""Alignment against a plain loop in the order of the entries."""

import difflib
import random
import re

import pytest

from refloom.operators import align

ITEMS = "doc_id long, seq long, raw string, formatted string, title string, doi string"


def solid(text):
    return re.sub("[^0-9a-z가-힣一-鿿]", "", (text or "").lower())


def plain(items, lines):
    """(doc, seq, pos, rounded score): each entry in turn takes the best line that is still free, the first of equals, if it reaches 0.45."""
    out, used = [], set()
    for doc, seq, _, formatted, title, doi in sorted(items):
        a, t, d = solid(formatted), solid(title), (doi or "").lower().strip()
        best, at = 0.0, None
        for other, pos, text in sorted(lines):
            if other != doc or (doc, pos) in used:
                continue
            score = difflib.SequenceMatcher(None, a, solid(text), autojunk=False).ratio()
            if d and d in text.lower():
                score = max(score, 0.99)
            if len(t) >= 8 and t in solid(text):
                score = max(score, 0.90)
            if score > best:
                best, at = score, pos
        if at is not None and best >= 0.45:
            used.add((doc, at))
            out.append((doc, seq, at, round(best, 3)))
    return sorted(out)


def lists(rng, n_lists, n):
    stock = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    items, lines = [], []
    for doc in range(n_lists):
        titles = [" ".join(rng.choices(stock, k=rng.randint(1, 5))) for _ in range(n)]
        for k, t in enumerate(titles):
            items.append((doc, k * 3, "r", f"Author {k % 3} (20{k % 20:02d}). {t}. Journal", rng.choice([t, ""]), f"10.5/{doc}.{k}" if k % 5 == 0 else ""))
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                text = rng.choice([f"Author {k % 3} (20{k % 20:02d}). {t}. Journal", f"{t}", f"A. {k}. {t} Jour. {rng.randint(1, 99)}", f"x 10.5/{doc}.{k}", "".join(rng.choice(stock) for _ in range(6))])
                lines.append((doc, rng.randint(0, 10**6), text))
    items += [(0, 10**6, "", "", "", ""), (0, 10**6 + 1, "", "!!", "", ""), (99, 1, "lone", "lone entry", "", "")]
    lines += [(0, -5, "---"), (0, -4, ""), (98, 1, "lone line")]
    return items, [*{(d, p): (d, p, t) for d, p, t in lines}.values()]


def pairs(spark, items, lines):
    found = align.align(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, "doc_id long, pos long, text string")).collect()
    assert len([r for r in found if r.kind != "published_only"]) == len(items) and len([r for r in found if r.kind != "agent_only"]) == len(lines)
    return sorted((r.doc_id, r.seq, r.pos, r.sim) for r in found if r.kind == "pair")


@pytest.mark.parametrize(("tile", "seed"), [(1000, 1), (5, 2), (5, 3)])
def test_equals_a_plain_loop(spark, monkeypatch, tile, seed):
    """Lists whose entries compete: equal and like lines, lost ones, titles and DOIs inside lines, empty strings; tiles smaller than a list."""
    monkeypatch.setattr(align, "TILE", tile)
    monkeypatch.setattr(align, "STRONG_TILE", tile)
    items, lines = lists(random.Random(seed), 3, 18)
    assert pairs(spark, items, lines) == plain(items, lines)


def test_an_early_weak_match_takes_a_later_exact_one(spark):
    items = [(1, 1, "", "abcdefgh ijkl 1999 xx", "", ""), (1, 2, "", "abcdefgh ijkl 2000 yyyy zzzz", "", ""), (1, 3, "", "wholly other words 77", "", "")]
    lines = [(1, 1, "abcdefgh ijkl 2000 yyyy zzzz"), (1, 2, "other words, wholly 77")]
    assert pairs(spark, items, lines) == plain(items, lines) and plain(items, lines)[0][:3] == (1, 1, 1)


def test_without_rows(spark):
    assert pairs(spark, [(1, 1, "", "abc", "", "")], [(2, 1, "abc")]) == []


def test_whole_lists_are_shuffled_once(spark, monkeypatch):
    """Lists that a task holds whole need no joins and no tables on the way; long ones among them and null ids give the same rows as a plain loop."""
    items, lines = lists(random.Random(4), 4, 12)
    frames = spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, "doc_id long, pos long, text string")
    plan = align.align(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "FileScan" not in plan
    assert pairs(spark, items, lines) == plain(items, lines)
    sizes = sorted(sum(r[0] == d for r in lines) for d in range(4))
    monkeypatch.setattr(align, "LIST_ROWS", (sizes[1] + sizes[2]) // 2)
    assert pairs(spark, items, lines) == plain(items, lines)
    nobody = align.align(frames[0].selectExpr("CAST(NULL AS LONG) AS doc_id", "seq", "raw", "formatted", "title", "doi").limit(3), frames[1])
    assert nobody.where("kind = 'agent_only'").count() == 3

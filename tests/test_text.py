import random
import time

import pandas as pd
from pyspark.sql import functions as F

from folioscope.functions import literals, text
from folioscope.operators import layout


def test_normalize_collapses_white_space_only(one):
    assert one(text.normalize(F.lit("  Ø\t 50  "))) == "Ø 50"
    assert one(text.normalize(F.lit("a 　b\x1cc"))) == "a b c"
    assert one(text.normalize(F.lit(None).cast("string"))) == ""


def test_distance_counts_code_points(one):
    assert one(text.edit_distance(F.lit("Ø"), F.lit("∅"))) == 1


def test_critical_edits(one):
    assert tuple(one(text.edit_counts(F.lit("Ø 12"), F.lit("∅ 12")))) == (1, 1)
    assert tuple(one(text.edit_counts(F.lit(""), F.lit("ab")))) == (2, 0)
    assert tuple(one(text.edit_counts(F.lit("+-"), F.lit("")))) == (2, 2)


def plain_edit_counts(a, b):
    best = {(0, 0): (0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = []
                k = int(i > 0 and a[i - 1] in text.CRITICAL)
                if i and j:
                    d, c = best[i - 1, j - 1]
                    ways.append((d + (a[i - 1] != b[j - 1]), c + (a[i - 1] != b[j - 1]) * k))
                if i:
                    d, c = best[i - 1, j]
                    ways.append((d + 1, c + k))
                if j:
                    d, c = best[i, j - 1]
                    ways.append((d + 1, c))
                best[i, j] = min(ways, key=lambda w: w[0])
    return best[len(a), len(b)]


def test_critical_edits_against_plain_matrix(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab1.+-Ø±") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_counts("a", "b").alias("e")).collect()
    assert all(tuple(r["e"]) == plain_edit_counts(r["a"], r["b"]) for r in got)


def test_alignment_in_blocks(monkeypatch):
    rng = random.Random(5)
    for bits in (text.KEPT_BITS, 8, 40):  # few bits: the way back computes block after block anew
        monkeypatch.setattr(text, "KEPT_BITS", bits)
        for _ in range(300):
            a, b = ("".join(rng.choice("ab1.+-Ø±中\U0001f600") for _ in range(rng.randint(0, 25))) for _ in "ab")
            assert text.aligned(a, b) == plain_edit_counts(a, b)


def test_alignment_of_many_turns_takes_few_steps():
    rng = random.Random(6)
    a, b = (pd.Series(["".join(rng.choice("abcdefghij .-") for _ in range(400)) for _ in range(600)]) for _ in "ab")
    began = time.process_time()
    counts = text._edit_counts.func(a, b)
    assert time.process_time() - began < 2.5
    assert tuple(counts.iloc[7]) == plain_edit_counts(a[7], b[7])


def test_widths(one):
    assert one(text.character_width(F.lit("a 中."), 10.0, 0.5)) == 5 + 2.8 + 10 + 4.2
    assert one(text.line_width(F.lit("中"), 10.0, 0.5)) == 10 * 1.06
    assert one(text.wrapped_lines(F.lit(""), 5.0, 10.0, 0.5)) == 1


def test_secrets_links_and_digests(one):
    assert one(text.has_secret(F.lit("x AKIA" + "A" * 16)))
    assert not one(text.has_secret(F.lit("AKIA")))
    assert one(text.markdown_links(F.lit('[a](<b.md> "t") ![c](d.png)'))) == ["b.md", "d.png"]
    assert one(text.is_digest(F.lit("0" * 64))) and not one(text.is_digest(F.lit("0" * 64 + "\n")))


def spans(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs])


def test_literals_round_trip(one):
    source = "Diameter Ø12 ±0.10 mm"
    plan = literals.protect(F.lit(source), spans((9, len(source))))
    back = literals.restore(plan, F.replace(plan["request"], F.lit("Diameter"), F.lit("Bore")))
    assert tuple(one(back)) == ("Bore Ø12 ±0.10 mm", True)
    for spoiled in (F.lit("x"), F.concat(plan["request"], plan["request"]), F.replace(plan["request"], F.lit("_0_"), F.lit("_1_"))):
        assert tuple(one(literals.restore(plan, spoiled))) == (source, False)


def test_literal_errors(one):
    assert one(literals.protect(F.lit("abcdef"), spans((0, 3), (2, 5))))["error"]
    assert one(literals.protect(F.lit("abc"), spans((1, 1))))["error"]
    assert one(literals.protect(F.lit("__LITERAL_0_0123456789AB__ x"), spans((27, 28))))["error"].startswith("source collides")
    swapped = literals.protect(F.lit("ab cd"), spans((0, 2), (3, 5)))
    turned = F.concat(swapped["tokens"][1], F.lit(" "), swapped["tokens"][0])
    assert one(literals.restore(swapped, turned)["ok"]) is False
    assert tuple(one(literals.restore(swapped, turned, True))) == ("cd ab", True)


def test_line_breaks():
    assert layout.broken("a b", 1, 10, 0.5) == "a b"
    assert layout.broken("中文字符五", 2, 10, 0.5) == "中文字\n符五"
    assert layout.broken("word", 3, 10, 0.5) == "word"
    assert layout.broken("aaaa bbbb cc\ndd", 3, 10, 0.5).count("\n") == 2


def test_balanced_words_against_all_cuts():
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(60):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(2, 7))]
        k = rng.randint(2, 4)
        width = lambda ws: sum(layout._width(w, 10, 0.5) for w in ws) + 2.8 * (len(ws) - 1)
        n = min(k, len(words))
        best = min(max(width(words[a:b]) for a, b in zip((0, *c), (*c, len(words)))) for c in combinations(range(1, len(words)), n - 1))
        got = layout.balanced_words(" ".join(words), k, 10, 0.5).split("\n")
        assert len(got) == n and abs(max(width(g.split()) for g in got) - best) < 1e-9


def test_copy_fit(spark):
    boxes = spark.createDataFrame([(1, "DN 50", 100.0, 20.0, 12.0), (2, "LONGUNBROKENTOKEN" * 10, 10.0, 5.0, 12.0)], "id int, text string, width_pt double, height_pt double, base_size double")
    for fit in (layout.copy_fit_single(boxes), layout.copy_fit(boxes)):
        good, bad = fit.orderBy("id").collect()
        assert good["fits"] and good["text"] == "DN 50" and good["font_size"] == 12 and good["width_scale"] == 1
        assert not bad["fits"] and bad["font_size"] >= 11.5 and bad["required_width_pt"] == 0


def test_copy_fit_uses_more_lines(spark):
    boxes = spark.createDataFrame([(1, "alpha beta gamma delta", 70.0, 60.0, 12.0, 1, 3)], "id int, text string, width_pt double, height_pt double, base_size double, expected_lines int, max_lines int")
    (fit,) = layout.copy_fit(boxes).collect()
    assert fit["fits"] and fit["line_count"] == 2 and fit["text"] == "alpha beta\ngamma delta"

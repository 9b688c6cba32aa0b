"""Quality rules and mixing against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from cellspan.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "é ü é ü é ü é", "x\ny\nx\n \n \nx", "# * $ % & | < > !",
    "one two three four one two three five " * 3, "a\x0bb\x0cc\rd", "nbsp here stays one", "w " * 4000, " ".join(str(i % 700) for i in range(5000)),
]


def test_features_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c"), (3, "a")]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.features(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, w int, n_words int")).collect()
    assert sorted(((r["id"], *(r[c] for c in names)) for r in got), key=str) == sorted(((i, *brute_features(t)) for i, t in rows), key=str)


def test_windows_that_share_a_hash_are_told_apart_by_their_words(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 2, 3, 7, 30, 200)] + ["a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window_hash in ("xxhash64(w[i], w[i + 1], w[i + 2])", "0L", "cast(w[i] = 'a' as bigint)"):
        got = quality_rules.features(df, window_hash=window_hash).collect()
        assert {r["id"]: r["n_repeat_words"] for r in got} == {i: brute_features(t)[4] for i, t in enumerate(texts)}


def good(i):
    rng = random.Random(i)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(90)]
    return ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, 90, 9)) + "."


def test_rules_part_good_from_bad(spark):
    rows = [(i, good(i)) for i in range(200)]
    rows += [(1000 + i, " ".join(f"{x}***" for x in good(i).split())) for i in range(12)]
    rows += [(2000 + i, "!! ".join(good(i).upper().split())) for i in range(12)]
    rows += [(3000 + i, " | ".join(good(i).split())) for i in range(12)]
    rows += [(4000, None), (4001, ""), (4002, "too short"), (4003, "again and again " * 60), (None, good(5))]
    judged = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r["id"] for r in judged if r["kept"]}
    assert kept == {*range(200), None}
    assert {r["id"] for r in judged if r["base_failed"]} == {4000, 4001, 4002, 4003}


def test_expectation_maximisation_matches_a_plain_one(spark):
    """The same rounds, row by row in Python."""
    rows = [(i, good(i)) for i in range(60)] + [(100 + i, "!! ".join(good(i).upper().split())) for i in range(9)] + [(200 + i, " | ".join(good(i).split())) for i in range(5)]
    voted = quality_rules.votes(quality_rules.features(spark.createDataFrame(rows, "doc_id long, text string")))
    n_rules = len(quality_rules.RULES)
    data = [[r[f"v{k}"] for k in range(n_rules)] for r in voted.collect()]
    prior, chance = 0.1, [{1: (0.5, 0.01), -1: (0.3, 0.9)} for _ in range(n_rules)]
    for _ in range(30):
        post = []
        for v in data:
            odds = math.log(prior / (1 - prior)) + sum(math.log(c[x][0] / c[x][1]) for c, x in zip(chance, v, strict=True) if x)
            post.append(1 / (1 + math.exp(-odds)))
        bad, n, new = sum(post), len(data), []
        for k in range(n_rules):
            rate = {}
            for x in (1, -1):
                hit = [p for p, v in zip(post, data, strict=True) if v[k] == x]
                rate[x] = [(sum(hit) + 1) / (bad + 3), (len(hit) - sum(hit) + 1) / (n - bad + 3)]
            rate[1][0], rate[-1][0] = max(rate[1]), min(rate[-1])
            new.append({x: (round(a, 9), round(b, 9)) for x, (a, b) in rate.items()})
        after = round(min(0.5, (bad + 1) / (n + 2)), 9)
        moved = max([abs(after - prior), *(abs(new[k][x][j] - chance[k][x][j]) for k in range(n_rules) for x in (1, -1) for j in (0, 1))])
        prior, chance = after, new
        if moved < 1e-4:
            break
    model = quality_rules.fit(voted)
    assert model.prior_bad == pytest.approx(prior, abs=1e-6)
    assert [x for c in model.chance for k in (1, -1) for x in c[k]] == pytest.approx([x for c in chance for k in (1, -1) for x in c[k]], abs=1e-6)


def test_keep_good_keeps_columns(spark):
    df = spark.createDataFrame([(1, good(1), 5), (2, "bad", 6), (1, good(1), 5)], "doc_id long, text string, id int")
    got = quality_rules.keep_good(df)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == [5, 5]
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    """By resharing, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in over}


def mixed(spark, rows):
    return mixing.mix_sources(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, key string")).collect()


ROWS = [(i, "w " * (1 + i * 7 % 90), "big" if i % 3 == 0 else f"s{i % 11}") for i in range(400)]
ROWS += [(1000, None, "s1"), (1001, "", "s2"), (1002, "a b", None), (1003, "tiny one", "tiny"), (1003, "tiny one", "tiny"), (None, "no id at all", "s3"), (1004, "x " * 3000, "s4"), (1005, None, "none")]


def test_targets_and_sizes(spark):
    got = mixed(spark, ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3


def test_taken_words_come_near_the_targets_and_reruns_agree(spark):
    got = mixed(spark, ROWS)
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert sum(taken.values()) <= sum(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest[s] + max(longest.values()) * target[s] / sum(target.values()) * len(target) for s in target)
    assert sorted(map(tuple, mixed(spark, ROWS[::-1])), key=str) == sorted(map(tuple, got), key=str)


def test_the_queue_is_that_of_a_plain_one(spark):
    """Weighted fair queueing, item by item."""
    rows = [r for r in ROWS if r[0] is not None and r[0] != 1003]
    got = {r["doc_id"]: r["copies"] for r in mixed(spark, rows)}
    sizes, target = defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    items = []
    for s in sizes:
        own = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, x in rows if x == s)
        at = 0
        for turn in range(3):
            for key, i, n in own:
                at += n
                if n:
                    items.append((at / target[s], s is None, s or "", key, i, n, turn))
    want, total = Counter(), 0
    for *_, i, n, _turn in sorted(items):
        total += n
        if total > sum(sizes.values()):
            break
        want[i] += 1
    assert got == {r[0]: want[r[0]] for r in rows}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")], [(1, "one", "a")]])
def test_mixing_of_next_to_nothing(spark, rows):
    got = mixed(spark, rows)
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)

"""LM scores, classifiers, decontamination, token counts and HTML extraction."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellspan.llm import backoff, decontaminate, factorisation, html_text, labelled, token_counts, toxicity


def docs_of(spark, rows):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, 1, "k", 2.0) for i, t in rows], "doc_id long, text string, id int, block string, score double")


# Language-model scores


def brute_backoff(texts, order, alpha):
    words = [(t or "").encode().lower().split() for t in texts]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every = sum(grams, Counter())
    total = sum(map(len, words))
    out = []
    for w, own in zip(words, grams, strict=True):
        log = full = backed = new = 0
        for i in range(len(w)):
            reach = min(order, i + 1)
            for n in range(reach, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = every[g] - own[g]
                if c > 0:
                    base = every[g[:-1]] - own[g[:-1]] if n > 1 else total - len(w)
                    log += math.log(c / base) + math.log(alpha) * (reach - n)
                    full += n == reach
                    backed += n < reach
                    break
            else:
                log += math.log(0.5 / max(1, total - len(w))) + math.log(alpha) * (reach - 1)
                new += 1
        out.append((len(w), pytest.approx(log, abs=1e-6), full, backed, new))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_matches_brute_force(spark, order):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "the", "of", "cat", "Ünder", "dog"]) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", " \n\t ", "once\x0bupon\x0ca\rtime", "w" * 9000 + " of", "w" * 9001 + " of", texts[0], "the " * 3000]
    df = docs_of(spark, list(enumerate(texts)))
    got = backoff.stupid_backoff(df, order=order).collect()
    got = {r["doc_id"]: (r["n_words"], r["log_score"], r["n_full"], r["n_backed_off"], r["n_unseen"]) for r in got}
    assert [got[i] for i in range(len(texts))] == brute_backoff(texts, order, 0.4)


def test_backoff_in_rounds_sends_no_row_an_ngram(spark):
    """Many small parts, counted in rounds of the hash space, give the same scores, and n-grams leave their blocks in arrays."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "of", "cat", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = docs_of(spark, list(enumerate(texts))).repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["log_score"], r["n_full"], r["n_backed_off"], r["n_unseen"]) for r in backoff.stupid_backoff(df, part=100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_backoff(texts, 3, 0.4)
    blocks = backoff.in_blocks(df.selectExpr("doc_id id", "xxhash64(text) th", "1 m", "text"))
    counts = backoff.block_counts(blocks, 3, 2, 0, 4)
    assert counts.count() <= 4 * blocks.count() < 60 < counts.selectExpr("sum(size(h))").first()[0]


def test_backoff_of_repeated_rows(spark):
    """Rows alike in id and text are documents of their own: each sees the others."""
    texts = ["a b c a", "a b c a", "a b", "c"]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    got = sorted((r["n_words"], round(r["log_score"], 6), r["n_full"], r["n_backed_off"], r["n_unseen"]) for r in backoff.stupid_backoff(df).collect())
    assert got == sorted((a, round(b.expected, 6), c, d, e) for a, b, c, d, e in brute_backoff(texts, 3, 0.4))


def test_backoff_of_an_empty_table_and_null_ids(spark):
    assert backoff.stupid_backoff(docs_of(spark, [])).collect() == []
    assert len(backoff.stupid_backoff(docs_of(spark, [(None, "a b"), (None, "a b"), (1, None)])).collect()) == 3


# Decontamination


def brute_best(item, text):
    """Fewest edits of the whole item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, c = rng.randrange(len(out)), rng.choice("abcdefgh")
        match rng.randrange(3):
            case 0:
                out[k] = c
            case 1:
                del out[k]
            case _:
                out.insert(k, c)
    return "".join(out)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(rng.randint(8, 30)) for _ in range(8)] + ["Short item!", "tiny", "it is", "?!", None, "", "Ängström über alles; " + prose(6)]
    texts = [prose(60) for _ in range(6)]
    for t in [x for x in items if x and len(x) > 20]:
        for n in (0, 1, 4, 9, 20, 60):
            texts.append(f"{prose(20)}\n{edited(rng, t, n)}\n{prose(15)}")
    texts += [items[0], items[1][5:], f"{items[2]}\n{items[2]} {items[3].upper()}", None, "", "short  item", prose(4000) + " " + items[4], "a tiny, one", "tinyish", "is it ok? no", "so it is, ok", "TINY"]
    got = decontaminate.leaks(docs_of(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), block_chars=400)
    got = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    norm = decontaminate.normalise
    index = decontaminate.GramIndex(list(range(len(items))), [decontaminate._chars(norm(x)) for x in items], 8, 0.1)
    want = {}
    for i, x in enumerate(items):
        if len(norm(x)) >= 8:
            for d, t in enumerate(texts):
                if (n := brute_best(norm(x), norm(t))) <= index.budget[i]:
                    want[d, i] = n
        elif norm(x):  # a short one as whole words
            want |= {(d, i): 0 for d, t in enumerate(texts) if f" {norm(x)} " in f" {norm(t)} "}
    assert {k: r["edits"] for k, r in got.items()} == want
    assert len(want) > 30
    for (d, i), r in got.items():
        assert norm(items[i])[:3] in norm(texts[d].lower()[r["start"] : r["end"]]) or r["edits"]


def test_alignment_matches_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))
        text = "".join(rng.choice("abc") for _ in range(4)) + edited(rng, item, rng.randint(0, 3)) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        budget, best = rng.randint(0, 4), brute_best(item, text)
        got = decontaminate.align(decontaminate._chars(item), decontaminate._chars(text), budget)
        assert (got[0] if got else None) == (best if best <= budget else None)


def test_drop_leaks_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    rows = [(1, "He said: The quick, brown fox jumps over the lazy dog and runs."), (1, "nothing of the kind"), (None, None), (2, "")]
    got = decontaminate.drop_leaks(docs_of(spark, rows), bench)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(rows[1:], key=str)
    assert decontaminate.leaks(docs_of(spark, []), bench).collect() == []
    assert decontaminate.drop_leaks(docs_of(spark, rows), bench.where("false")).count() == 4


# Token counts


def test_token_counts_add_up_and_follow_the_rule(spark):
    texts = ["Hello world\nsecond line  \n\n  indented", "", None, "naïve café\nüber 日本語\n", "x" * 3000 + "\n" + "y z " * 3000, "\n\n"]
    got = token_counts.section_tokens(docs_of(spark, list(enumerate(texts))), fields=("block", "text")).collect()
    enc, _ = token_counts._encoder(token_counts.VOCABULARY)
    for d, t in enumerate(texts):
        whole = "k\n" + (t or "")
        ids = enc.encode_ordinary(whole)
        assert enc.decode(ids) == whole
        rows = sorted((r for r in got if r["doc_id"] == d), key=lambda r: (r["field"] == "text", r["section"]))
        owner, entering, at = Counter(), Counter(), 0
        ends, n = [], 0
        for part in whole.split("\n"):
            n += len(part.encode()) + 1
            ends.append(n)
        section = lambda byte: next((k for k, e in enumerate(ends) if byte < e), len(ends) - 1)  # noqa: E731, B023
        for i in ids:
            size = len(enc.decode_single_token_bytes(i))
            owner[section(at)] += 1
            if section(at + size - 1) > section(at):
                entering[section(at + size - 1)] += 1
            at += size
        assert [(r["n_tokens"], r["n_entering"]) for r in rows] == [(owner[k], entering[k]) for k in range(len(ends))]
        assert all(r["doc_tokens"] == len(ids) for r in rows)
        own = [r for r in rows if r["field"] == "text"]
        assert "".join((t or "")[r["start"] : r["end"]] for r in own) == (t or "")
    assert token_counts.section_tokens(docs_of(spark, [])).collect() == []


def test_runs_of_white_space_are_cut(spark):
    for text in (" " * 3_000_000, "a" + "\n" * 1_500_000 + "b", "x" * 100_000):
        spans = token_spans_of(text)
        assert spans[0] == 0 and spans[-1] == len(text.encode()) and (np.diff(spans) > 0).all()
    short = "a" + " " * 1000 + "b  c"
    assert token_spans_of(short).tolist() == np.concatenate([[0], np.cumsum([len(x) for x in pieces_of(short)])]).tolist()
    rows = [(1, "a  b\n" * 3), (1, "a  b\n" * 3), (2, "\t" * 100_000)]
    got = token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 + 4 + 1 and len(set(map(tuple, got))) == 5
    assert token_counts.section_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def token_spans_of(text):
    return token_counts.token_spans(text)


def pieces_of(text):
    enc, _ = token_counts._encoder(token_counts.VOCABULARY)
    return enc.decode_tokens_bytes(enc.encode_ordinary(text))


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="%s"><h1>A title</h1><p>First  paragraph with <b>bold &amp; <i>nested</b> text</i>,&nbsp;and more words in it.
<p>Second paragraph, not closed, has some more words in it too<br>and a break<!-- comment -->
<div class="advert">Buy this now, it is the best there is, we promise you that!</div>
<ul><li>first item of a list<li>second item of a list</ul>
<blockquote>Quoted words &lt;here&gt; go on for a while.</blockquote><form><p>Sign up for more of these</p><input></form></div>
<aside><p>Other pages</p></aside><section id="comments"><p>I did not like this page at all, says a reader who goes on and on for long.</p></section>
<div class="cookie-notice">We use cookies.</div><footer>&copy; someone</footer></body></html>"""
TEXT = "A title\nFirst paragraph with bold & nested text, and more words in it.\nSecond paragraph, not closed, has some more words in it too and a break\nfirst item of a list\nsecond item of a list\nQuoted words <here> go on for a while."


@pytest.mark.parametrize("kind", ["post", "content body", "x"])
def test_main_text(kind):
    assert html_text.main_text(PAGE % kind) == TEXT
    assert html_text.main_text((PAGE % kind).replace('<div class="%s">' % kind, "<article>").replace("</form></div>", "</form></article>")) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>one<p>two", "one\ntwo"), ("<script>x", ""), ("a < b <<c", "a < b <<c"), ("<div><", "<"), ("</p></div>x", "x"),
    ("<!-- never closed", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p title='a>b'>q</p>", "q"), ("<nav>only a menu</nav>", ""),
])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p data-x=it's>Four five six.</p>", "Four five six."), ("<div title=it's><p>Seven eight.</p></div>", "Seven eight."),
    ("<p title='The hidden cost of x'>shown</p>", "shown"), ("<p hidden>on request</p><p>shown</p>", "on request\nshown"),
    ("<article><p>One is here.</p><p aria-hidden=true>Two is here.</p><p style='display:none'>Three is here.</p></article>", "One is here.\nTwo is here.\nThree is here."),
    ("<div class='content no-sidebar'><p>One is here.</p><p>Two is here.</p></div>", "One is here.\nTwo is here."),
    ("<div class=elementor-widget><p>One is here.</p><p>Two is here.</p></div>", "One is here.\nTwo is here."),
    ("<article><p>The first half of it.</p><div class='related-work'><p>The second half of it.</p></div></article>", "The first half of it.\nThe second half of it."),
    ("<article><p>The first half of it.</p><div class='search notice-text'><p>The second half of it.</p></div></article>", "The first half of it.\nThe second half of it."),
    ("<article><p>All of it.</p><div class=ad>An advert that is longer than the text is by far.</div></article>", "All of it."),
    ("<p>a <i>b <b>c</i> d</b> e</p>", "a b c d e"), ("<body><p>x<br/>y &lt;z&gt;</p>", "x y <z>"),
])
def test_attributes_names_and_nesting(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><b>" * 50_000, "<div>" * 100_000, "<!--" * 100_000, "<table><tr><td>" * 30_000, "<header>" * 50_000,
    "< " * 300_000, "<div class=related>" * 50_000, "<div class='x-comment'>text " * 20_000, "<a href='" * 100_000, "<p>" + "word " * 400_000,
])
def test_time_is_linear_in_hostile_and_long_pages(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 15


def brute_densest(page):
    """The largest sum of densities by the formulas, with whole subtrees counted anew for each node."""
    body = html_text.measure(html_text.parse(page))
    below = lambda n: [x for k in n.kids if not isinstance(k, str) for x in (k, *below(k))]
    chars = lambda n: sum(len(k.strip()) if isinstance(k, str) else chars(k) for k in n.kids)
    links = lambda n: chars(n) if n.tag == "a" else sum(links(k) for k in n.kids if not isinstance(k, str))

    def density(n):
        c, lc, t, lt = chars(n), links(n), max(len(below(n)), 1), sum(x.tag == "a" for x in below(n))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + links(body) / max(chars(body), 1) * c + math.e)
        return max(0.0, c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-12) / math.log(base) if base > 1 + 1e-9 else c / t)

    total = {id(n): sum(density(k) for k in n.kids if not isinstance(k, str)) for n in (body, *below(body))}
    return body, [(n, density(n), total[id(n)]) for n in (body, *below(body))]


def test_densities_match_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(["<div>", "</div>", "<p>" + "word " * rng.randint(1, 30) + "</p>", "<a href=x>link here</a>", "<section>", "</section>"]))
        body, nodes = brute_densest("<body>" + "".join(parts))
        assert all(abs(n.density - d) < 1e-9 and abs(n.total - t) < 1e-9 for n, d, t in nodes)


def test_extract_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE % "c", "k"), (1, "u", PAGE % "c", "k"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert dict(got.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]


# Classifiers


def test_sample_respects_the_fold_and_the_bound(spark):
    docs = docs_of(spark, [(i, f"t{i}") for i in range(300)] + [(5, "another"), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (7, None), (999, 1), (None, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 3, 1, 50).collect()
    import zlib

    assert len(got) == len({r["id"] for r in got}) == 50 and all(zlib.crc32(str(r["id"]).encode()) % 3 != 1 for r in got)


def auc(rows):
    rows = sorted(rows)
    ones = sum(y for _, y in rows)
    rank = sum(k for k, (_, y) in enumerate(rows) if y)
    return (rank - ones * (ones - 1) / 2) / max(1, ones * (len(rows) - ones))


@pytest.mark.parametrize("name, label", [("op6_factorisation", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    from cellspan.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf)
    assert [c for c, _ in got.dtypes][:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([(s, y) for s, y, _ in held]) > 0.8
    assert np.mean([p == y for _, y, p in held]) > 0.9


def test_machine_scores_pairs_by_the_identity():
    fm = factorisation.FactorisationMachine.fresh(32, 4, 0.3)
    fm.w = np.random.default_rng(1).normal(size=fm.w.shape)
    index, value = factorisation.vector("some words of a text\nand some more", 32)
    pairs = sum(fm.v[index[i]] @ fm.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    y = 0.3 + fm.w[index] @ value + pairs
    assert fm.probability([(index, value)])[0] == pytest.approx(1 / (1 + math.exp(-y)))


@pytest.mark.parametrize("module, label", [(factorisation, "quality"), (toxicity, "toxic")])
def test_scores_without_labels_nulls_and_repeats(spark, module, label):
    docs = docs_of(spark, [(1, None), (2, ""), (2, ""), (None, "x " * 50000)])
    got = module.score(docs, spark.createDataFrame([], f"doc_id long, {label} int")).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None)], f"doc_id long, {label} int")
    assert len(module.score(docs, one).collect()) == 4
    assert module.score(docs_of(spark, []), one).collect() == []


def test_masked_words_are_found():
    of = toxicity.Featurizer({"=idiot": 3.0, "=stupid": 3.0, "=moron": 3.0})
    at = toxicity.NAMES.index("masked_hits")
    assert all(of(x)[at] > 0 for x in ("such an 1d1ot", "st*pid thing", "a m0r0n.", "you i d i o t"))
    assert all(of(x)[at] == 0 for x in ("a clean text", "1984 was 50% off", None, "a.b.c."))


def test_masked_words_of_long_runs():
    import time

    began = time.process_time()
    assert toxicity.masked_words("!" * 500_000 + " " + "a" * 100_000) == []
    assert toxicity.masked_words("sh1t a$$hole b*d abc 123 (d4mn! x_y1z" + " " + "1" * 60 + "a") == ["sh1t", "a$$hole", "b*d", "d4mn", "1" * 60 + "a"]
    assert time.process_time() - began < 5


def test_arrow_types_are_kept(spark):
    df = spark.createDataFrame([("a", "some text"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"] for r in backoff.stupid_backoff(df).collect()} == {"a", None}
    assert isinstance(df.toArrow(), pa.Table)


@pytest.mark.parametrize("chars", [8, 10, 13, 15, 20, 23, 30, 31, 40])
def test_short_items_have_the_edits_of_their_length(chars):
    """One budget holds for all lengths: a part with that many edits, spread as far as they go, is found, one more is not."""
    import random

    rng = random.Random(chars)
    letters = "abcdefghijklmnopqrstuvw"
    for _ in range(20):
        item = "".join(rng.choice(letters) for _ in range(chars))
        k = int(chars * 0.1 + 1e-9)
        index = decontaminate.Indexes(["i"], [item], 8, 0.1)
        for n in (k, k + 1):
            part = list(item)
            for e in range(n):
                part[(2 * e + 1) * chars // (2 * n)] = "z"
            got = index.search(["xx " + "".join(part) + " yy"])
            assert bool(got) == (n <= k) and (n > k or got[0, 0][0] == k)


def test_many_short_items_take_little_room():
    import random
    import tracemalloc

    rng = random.Random(4)
    items = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(40_000)]
    index = decontaminate.Indexes(list(range(len(items))), items, 8, 0.1)
    texts = [" ".join(rng.choice(items) for _ in range(3)) for _ in range(300)]
    tracemalloc.start()
    got = index.search(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len({d for d, _ in got}) == 300 and most < 100_000_000


def test_items_come_in_blocks(spark):
    rows = [(i, f"passage number {'abcdefghij'[i]} is held here and nowhere else in the world") for i in range(10)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t[8:]) for i, t in rows], "item_id long, text string")
    one = decontaminate.leaks(docs, items)
    many = decontaminate.leaks(docs, items, block_chars=90)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() >= 10

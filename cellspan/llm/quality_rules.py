"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation finds how far each can be trusted.

DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import SPACE, checkpoint, matching, materialize, text_hash, words

#: Fixed values: (name, feature, a vote for bad where, a vote for good where). A rule that finds nothing wrong says nothing
#: of what it does not look at, so most abstain unless they vote for bad; two general ones vote both ways.
RULES = (
    ("odd_spots", "1.0 * n_odd / n_words", "x > 0.3", "x <= 0.1"),
    ("symbols", "1.0 * n_symbols / n_words", "x > 0.1", "x <= 0.02"),
    ("shouting", "1.0 * n_shouted / n_words", "x > 0.4", "false"),
    ("exclamations", "1.0 * n_exclaim / n_words", "x > 0.25", "false"),
    ("long_words", "1.0 * word_chars / n_words", "x > 16", "false"),
    ("repeated_lines", "1.0 * n_dup_lines / greatest(n_word_lines, 1)", "x > 0.35", "false"),
    ("repeated_words", "1.0 * n_repeat_words / n_words", "x > 0.4", "false"),
)

#: Runs of what is neither letter, space nor mark, or of two marks and more; runs of capitals.
ODD = r"[^\p{L}\s\p{P}]+|\p{P}{2,}"
SHOUTED = r"\p{Lu}{2,}"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_hash: str = "xxhash64(w[i], w[i + 1], w[i + 2])") -> DataFrame:
    """(id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines, n_odd, n_shouted, n_exclaim),
    th the text's hash, the rest longs, for every row of docs. A null text has none of anything.

    Repeated three-word windows are found inside the row: the windows' hashes, with the position in their low bits, are
    sorted as plain longs; neighbours with equal upper bits are repeats if their words are equal. Where some are not, so
    that two windows share a hash by chance, the row's windows are sorted by their words instead."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), text.alias("t"), words(F.col(text_col)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    rows = rows.withColumns({"lines": lines, "k": F.length(F.bin(F.size("w")))})
    hashes = f"transform(sequence(0, size(w) - 3), i -> shiftleft({window_hash}, k) | cast(i as bigint))"
    rows = rows.withColumn("h", F.expr(f"case when size(w) >= 3 then sort_array({hashes}) else cast(array() as array<bigint>) end"))
    # where a window's hash equals the one before it
    twins = "filter(sequence(1, size(h) - 1), j -> shiftright(h[j - 1] ^ h[j], k) = 0)"
    rows = rows.withColumn("j", F.expr(f"case when size(h) >= 2 then {twins} else cast(array() as array<int>) end"))
    at = "transform(j, x -> cast(h[x - {}] & (shiftleft(1L, k) - 1) as int))"
    rows = rows.withColumns({"a": F.expr(at.format(1)), "b": F.expr(at.format(0))})
    by_hash = "sort_array(array_union(a, b))"
    apart = "exists(zip_with(a, b, (x, y) -> w[x] != w[y] or w[x + 1] != w[y + 1] or w[x + 2] != w[y + 2]), z -> z)"
    # no word holds a space, so joined windows are equal only if their words are
    windows = "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('s', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))"
    same = "filter(sequence(1, size(s) - 1), j -> s[j - 1].s = s[j].s)"
    by_words = f"transform(array({windows}), s -> transform(array({same}), j -> sort_array(array_union(transform(j, x -> s[x - 1].i), transform(j, x -> s[x].i))))[0])[0]"
    rows = rows.withColumn("p", F.expr(f"case when {apart} then {by_words} else {by_hash} end"))
    covered = "aggregate(transform(p, (x, i) -> case when i < size(p) - 1 then least(3, p[i + 1] - x) else 3 end), 0L, (acc, x) -> acc + x)"
    return rows.select(
        "id",
        "th",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_word_lines"),
        F.regexp_count("t", F.lit(ODD)).cast("long").alias("n_odd"),
        F.regexp_count("t", F.lit(SHOUTED)).cast("long").alias("n_shouted"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
    )


def votes(rows: DataFrame) -> DataFrame:
    """Adds v0, v1, ...: 1 for bad, -1 for good, 0 to abstain. Texts without a word abstain throughout."""
    cols = {}
    for i, (_, feature, bad, good) in enumerate(RULES):
        x = f"cast({feature} as double)"
        case = f"case when n_words = 0 then 0 when {bad} then 1 when {good} then -1 else 0 end"
        cols[f"v{i}"] = F.expr(case.replace("x ", f"{x} "))
    return rows.withColumns(cols)


class VoteModel:
    """The share of bad documents and, for each rule, how often it casts a vote in bad and in good ones."""

    def __init__(self, prior_bad: float, chance: list[dict[int, tuple[float, float]]]):
        self.prior_bad, self.chance = prior_bad, chance

    def p_bad(self) -> Column:
        """The posterior. An abstention is no evidence."""
        odds = F.lit(math.log(self.prior_bad / (1 - self.prior_bad)))
        for i, by_vote in enumerate(self.chance):
            for vote, (bad, good) in by_vote.items():
                odds = odds + F.when(F.col(f"v{i}") == vote, math.log(bad / good)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


#: What a round of expectation-maximisation knows: bp and gp are a rule's rates of votes for bad in bad and in good
#: documents, bn and gn those of its votes for good.
RATE = "struct<bp: double, gp: double, bn: double, gn: double>"
STATE = f"struct<prior: double, rates: array<{RATE}>, moved: double>"


def round_sql(smooth: float) -> str:
    """SQL for the state after s, from pats, an array of (v, n), and their total."""
    add = "0D, (a, x) -> a + x"
    evidence = "zip_with(p.v, s.rates, (v, r) -> case v when 1 then ln(r.bp / r.gp) when -1 then ln(r.bn / r.gn) else 0D end)"
    q = f"transform(pats, p -> p.n / (1 + exp(-(ln(s.prior / (1 - s.prior)) + aggregate({evidence}, {add})))))"
    part = lambda vote, x: f"aggregate(zip_with(pats, q, (p, y) -> if(p.v[k] = {vote}, {x}, 0D)), {add})"
    in_bad = lambda vote: f"({part(vote, 'y')} + {smooth}D) / (bad + {3 * smooth}D)"
    in_good = lambda vote: f"({part(vote, 'p.n - y')} + {smooth}D) / (total - bad + {3 * smooth}D)"
    rate = f"transform(sequence(0, {len(RULES) - 1}), k -> named_struct('bp', {in_bad(1)}, 'gp', {in_good(1)}, 'bn', {in_bad(-1)}, 'gn', {in_good(-1)}))"
    # a vote for bad is never a sign of good nor the reverse, whatever else may part two classes
    rate = f"transform({rate}, r -> named_struct('bp', round(greatest(r.bp, r.gp), 9), 'gp', round(r.gp, 9), 'bn', round(least(r.bn, r.gn), 9), 'gn', round(r.gn, 9)))"
    prior = f"round(least(0.5D, (bad + {smooth}D) / (total + {2 * smooth}D)), 9)"
    apart = "array_max(zip_with(rates, s.rates, (x, y) -> greatest(abs(x.bp - y.bp), abs(x.gp - y.gp), abs(x.bn - y.bn), abs(x.gn - y.gn))))"
    after = f"named_struct('prior', prior, 'rates', rates, 'moved', greatest(abs(prior - s.prior), {apart}))"
    # one-element arrays give what is used more than once a name
    for name, value in (("rates", rate), ("prior", prior), ("bad", f"aggregate(q, {add})"), ("q", q)):
        after = f"transform(array({value}), {name} -> {after})[0]"
    return after


def fit(voted: DataFrame, rounds: int = 30, smooth: float = 1.0, tol: float = 1e-4) -> VoteModel:
    """Expectation-maximisation over all rows of voted. Rows only differ by their votes, so the rounds run over the counts
    of each pattern of votes: at most 3 ** len(RULES), however large the corpus. They fit one row, in which all rounds
    are one expression; rounds after one that moves no rate by tol change nothing."""
    names = [f"v{i}" for i in range(len(RULES))]
    patterns = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), "n"))).alias("pats"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))
    first = f"array_repeat(named_struct('bp', 0.5D, 'gp', 0.01D, 'bn', 0.3D, 'gn', 0.9D), {len(RULES)})"
    first = f"cast(named_struct('prior', 0.1D, 'rates', {first}, 'moved', 1D) as {STATE})"
    step = f"(s, i) -> if(s.moved < {tol}D, s, cast({round_sql(smooth)} as {STATE}))"
    s = checkpoint(one).select(F.expr(f"aggregate(sequence(1, {rounds}), {first}, {step})").alias("s")).first()["s"]
    return VoteModel(s["prior"], [{1: (r["bp"], r["gp"]), -1: (r["bn"], r["gn"])} for r in s["rates"]])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of every row of docs with base_failed, p_good and kept.

    base_failed: under 50 words, or over half of the words in three-word windows that occur twice. kept: not base_failed,
    and the posterior of good is at least one half. Null, empty and blank texts have 0 words and fail. Rows are judged one
    by one; repeated rows and ties change nothing but the fitted rates. Columns other than id and text are not read. An
    empty table gives an empty table. Texts are read once: the rates are fitted on the written features."""
    voted = materialize(votes(features(docs, id_col, text_col)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "p_good": 1 - fit(voted).p_bad()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*[f"v{i}" for i in range(len(RULES))])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    return matching(docs, judge(docs, id_col, text_col).where("kept").select("id", "th").distinct(), "left_semi", id_col, text_col)

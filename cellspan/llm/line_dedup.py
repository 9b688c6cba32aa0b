"""Line dedup over the whole corpus, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.llm.common import SPACE, ascii_lower, free, materialize, quoted, skewed_join


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough. Keys travel as two independent 64-bit hashes: 128 bits keep
    chance collisions out of reach at any corpus size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("id", "th", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _common(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper, times) of the keys that enough documents hold: keeper is the largest id, times the lines."""
    holders = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("c"))
    keys = holders.groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keeper"), F.sum("c").alias("times"))
    return materialize(keys.where(F.col("n") >= min_docs).drop("n"))


def _gone(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The lines that go."""
    return skewed_join(lines, common, ["h1", "h2"], lines.count()).where(~F.col("id").eqNullSafe(F.col("keeper")))


def _without(lines: Column, dropped: Column) -> Column:
    """lines without the (sorted, 0-based) positions in dropped, by slices between them: linear in both."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(dropped, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(dropped, k), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of docs but those named n_lines, n_dropped and kept_text in any case, then these three: lines before dropping (long), lines
    dropped (long), and the text that stays, its lines joined by \\n.

    A key of at least min_chars code points that at least min_docs documents (distinct ids) hold loses all its lines
    except in the largest id. A null or empty text is one empty line. Rows that share an id are one document. A null id
    counts as no document, so such a row loses every line that goes elsewhere. Repeated lines of the document that keeps
    a key all stay. An empty table gives an empty table. Texts cross the network once, in the last join, where they
    stream past a hash table of the positions and are not sorted; all before it moves hashes, pre-aggregated on the map
    side, and lines that very many documents hold are joined where they are."""
    lines = materialize(_lines(docs, id_col, text_col, min_chars))
    gone = _gone(lines, _common(lines, min_docs))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    of_id, of_th, at, own_id, own_th, whole = free(docs, "of_id", "of_th", "gone_at", "own_id", "own_th", "whole_text")
    gone = gone.groupBy(F.col("id").alias(of_id), F.col("th").alias(of_th)).agg(F.sort_array(F.collect_set("pos")).alias(at))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*quoted(kept), F.col(id_col).alias(own_id), text.alias(whole), F.xxhash64(text).alias(own_th))
    rows = rows.join(gone.hint("shuffle_hash"), F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_th) == F.col(of_th)), "left")
    gone_or_none = F.coalesce(at, F.array().cast("array<int>"))
    # transform over a one-element array names the split once; a plain alias would be split again for each slice
    out = F.when(F.size(gone_or_none) == 0, F.col(whole)).otherwise(
        F.get(F.transform(F.array(F.split(whole, "\n")), lambda x: F.array_join(_without(x, gone_or_none), "\n")), F.lit(0))
    )
    n_lines = F.length(whole) - F.length(F.replace(F.col(whole), F.lit("\n"), F.lit(""))) + 1
    return rows.select(*quoted(kept), n_lines.cast("long").alias("n_lines"), F.size(gone_or_none).cast("long").alias("n_dropped"), out.alias("kept_text"))

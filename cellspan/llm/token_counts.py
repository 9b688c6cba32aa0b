"""Token counts by offset mapping: whole documents are encoded once, tokens then go to the sections their characters lie in."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellspan.llm.common import pieces

#: Where the vocabulary lies, unless the setting or a parameter names another; the driver sends the file to the executors.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.cellspan.vocabulary"
#: Fixed value: how byte-level BPE cuts text before it merges bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The tokenizer's stack does not hold longer runs of white space: the text is cut after so many of them.
RUN = 1 << 15
LONG_RUN = re.compile(rf"\s{{{RUN}}}")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The byte at which each token of the UTF-8 text begins, and the end. Tokens are strings of bytes, so their lengths
    add up to the text's."""
    enc, lengths = _encoder(path)
    cuts = [0, *(m.end() for m in LONG_RUN.finditer(text)), len(text)]
    ids = np.concatenate([np.asarray(enc.encode_ordinary(text[a:b]), np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return np.concatenate([[0], np.cumsum(lengths[ids])])


def attribute(starts: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that reach in from the section before) of each section, starts being the sections' first bytes.

    Both sides are in order, so the interval join is a merge. The rule: a token belongs to the section of its first
    byte; so a character's bytes stay together, and the sections' tokens add up to the text's."""
    first, end = spans[:-1], spans[1:]
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    n = np.bincount(owner, minlength=len(starts))
    return n, np.bincount(last[last > owner], minlength=len(starts))


def section_tokens(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), vocabulary: str | None = None) -> DataFrame:
    """For every row of docs a row for each section: id_col, field, section (from 0), start and end (characters in the
    field, the line's \\n included), n_tokens, n_entering (tokens begun before it), doc_tokens (of all fields together).

    The fields of a row, joined by \\n, are encoded as one text, so a token may cross from line to line or field to field;
    it belongs to the section of its first byte. Sections are the fields' lines, each with the \\n that ends it. A null or
    empty field is one empty section. Repeated rows give repeated results; other columns are not read; an empty table gives
    an empty table. A run of more than 32,768 white-space characters is cut after each 32,768: no token crosses the cuts."""
    spark = docs.sparkSession
    path = vocabulary or spark.conf.get(SETTING, VOCABULARY)
    spark.sparkContext.addFile(path)
    file = path.rsplit("/", 1)[-1]
    long = [T.StructField(c, T.LongType()) for c in ("start", "end", "n_tokens", "n_entering", "doc_tokens")]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("section", T.IntegerType()), *long])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row: list[np.ndarray] = []
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            texts = [c.to_pylist() for c in batch.columns[1:]]
            for r in range(batch.num_rows):
                parts = [x[r] or "" for x in texts]
                whole = "\n".join(parts).encode()
                raw = np.frombuffer(whole, np.uint8)
                starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                field = np.repeat(np.arange(len(parts)), [p.count("\n") + 1 for p in parts])
                spans = token_spans(whole.decode(), SparkFiles.get(file))
                n, entering = attribute(starts, spans)
                char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                begin, end = char[starts], np.concatenate([char[starts[1:]], [char[-1]]])
                offset = begin[np.searchsorted(field, np.arange(len(parts)))][field]
                row.append(np.full(len(starts), r))
                section = np.arange(len(starts)) - np.searchsorted(field, field)
                for k, x in enumerate((field, section, begin - offset, end - offset, n, entering, np.full(len(starts), len(spans) - 1))):
                    out[k].append(x)
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, *out)]
            names = pa.array([fields[k] for k in cols[1]], pa.string())
            arrays = [batch.column(0).take(pa.array(cols[0])), names, pa.array(cols[2].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, *fields).mapInArrow(run, schema)

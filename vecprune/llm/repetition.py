"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Every text is measured as a whole, in numpy over Arrow batches, with rolling hashes: a prefix
sum over the words gives the hash of every window of any length.  No shuffle is needed.

Defined results: a NULL or empty text has no words and fails the base rule; repeated rows and
ids are judged one by one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.llm.text import Words, add_columns, chunks, covered, mix, repeats, span_hash
from vecprune.session import ship_package

MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
# Most percent of the characters in words that may lie in a later copy of an n-gram, by n.
GRAM_PERCENT = {5: 15, 7: 13, 10: 10}
# The same for lines that are equal to an earlier line.
LINE_PERCENT = 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The numbers of each text and the two verdicts."""
    words = Words(column)
    chars = words.chars()
    n_words, word_chars = words.count.astype(np.int64), words.per_text(chars)
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=symbols[1:])
    salt = mix(np.arange(len(n_words), dtype=np.uint64) + np.uint64(1))

    def window_words(n: int) -> tuple[np.ndarray, np.ndarray]:
        at, grams = words.grams(n)
        twice, later = repeats(mix(grams ^ salt[words.owner[at]]))
        return covered(len(chars), at[twice], n), covered(len(chars), at[later], n)

    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.diff(symbols[words.offsets]),
    }
    out["n_dup_lines"], dup_line_chars = _lines(words, chars, salt)
    out["n_repeat_words"] = words.per_text(window_words(BASE_WINDOW)[0])
    bad = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    kept = ~bad & (100 * dup_line_chars <= LINE_PERCENT * word_chars)
    extra = {"dup_line_chars": dup_line_chars}
    for n, percent in GRAM_PERCENT.items():
        extra[f"dup_chars_{n}"] = words.per_text(chars * window_words(n)[1])
        kept &= 100 * extra[f"dup_chars_{n}"] <= percent * word_chars
    return out | {"base_failed": bad, "kept": kept} | extra


def _lines(words: Words, chars: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines equal to an earlier one of their text, and the characters in their words."""
    ends = np.flatnonzero(words.data == 10)
    # A line ends at a newline or at the end of its text.
    start = np.concatenate([words.offsets[:-1], ends + 1])
    order = np.argsort(start, kind="stable")
    owner = np.concatenate(
        [np.arange(len(salt)), np.searchsorted(words.offsets, ends, side="right") - 1]
    )[order]
    start = start[order]
    # The next line of the same text begins after a newline; the last line ends with the text.
    end = np.append(start[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = words.offsets[1:][owner[last]]
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = b > a
    owner, start, end, a, b = owner[full], start[full], end[full], a[full], b[full]
    _, later = repeats(mix(span_hash(words.prefix, start, end) ^ salt[owner]))
    before = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=before[1:])
    count, size = np.zeros(len(salt), np.int64), np.zeros(len(salt), np.int64)
    np.add.at(count, owner[later], 1)
    np.add.at(size, owner[later], (before[b] - before[a])[later])
    return count, size


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                yield add_columns(part, [id_col], **measures(part.column(text_col)))

    id_type = docs.schema[id_col].dataType.simpleString()
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_PERCENT)]
    schema = ", ".join(
        [f"`{id_col}` {id_type}", *(f"{c} long" for c in numbers)]
        + ["base_failed boolean", "kept boolean", *(f"{c} long" for c in extra)]
    )
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                yield part.filter(pa.array(measures(part.column(text_col))["kept"]))

    return docs.mapInArrow(kernel, docs.schema)


def op1_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _gram_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"lead(w, {i}) OVER o" for i in range(n))
    return f"""
g{n} AS (SELECT doc_id, pos, {gram} AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r{n} AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice,
  gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS later FROM g{n}),
c{n} AS (SELECT doc_id, pos, max(twice::INT) OVER o AS twice, max(later::INT) OVER o AS later FROM r{n}
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


WORD = r"'[^\x20\x09-\x0D]+'"
_GRAMS = list(GRAM_PERCENT)
OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(text, {WORD}) AS ws FROM docs),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lists),
split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
full_lines AS (SELECT doc_id, line, list_sum(list_transform(regexp_extract_all(line, {WORD}), lambda x: length(x))) AS size,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM lines WHERE regexp_matches(line, {WORD})),
by_line AS (SELECT doc_id, count(*) AS n_dup_lines, sum(size)::BIGINT AS dup_line_chars FROM full_lines WHERE nth > 1 GROUP BY doc_id),
{",".join(_gram_sql(n) for n in [BASE_WINDOW, *_GRAMS])},
by_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(c{BASE_WINDOW}.twice)::BIGINT AS n_repeat_words,
  {", ".join(f"sum(length(w) * c{n}.later)::BIGINT AS dup_chars_{n}" for n in _GRAMS)}
  FROM words {" ".join(f"JOIN c{n} USING (doc_id, pos)" for n in [BASE_WINDOW, *_GRAMS])} GROUP BY doc_id),
whole AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars,
  {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in _GRAMS)}
  FROM docs LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
  AND {" AND ".join(f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in GRAM_PERCENT.items())} AS kept,
  dup_line_chars, {", ".join(f"dup_chars_{n}" for n in _GRAMS)}
FROM judged"""

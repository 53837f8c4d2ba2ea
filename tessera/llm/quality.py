"""Line-first quality rules.

Each line is judged by itself, and failing lines are removed; a document that then has lost more than `MOST_LOST` of its
words is rejected. A line fails

- punctuation: if it doesn't end in a terminal mark (closing quotes and brackets may follow), if more than `NOISY` of its
  words hold one of #*$%&|<>, or if it has three words or more and more than `LOUD` of its cased letters are capitals;
- navigation: if it has two separators (| » • >) or more and less than `PER_LINK` words for each;
- boilerplate: if it has at most `SHORT` words and holds one of the customary phrases below.

A document also fails by base rules: fewer than `LEAST_WORDS` words, or more than half of its words in 3-word windows
that occur twice or more in it.

Defined results: a null text is an empty one: all counts 0, base_failed. Lines are parted by newlines; blank ones neither
fail nor count. Repeated rows and null doc_ids are judged like any other. An empty table gives no rows. Columns besides
text pass unread; `clean` changes text and n_chars alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .words import WHITE_SPACE, Words, annotate, translated

LEAST_WORDS, MOST_LOST = 50, 0.5
NOISY, LOUD, PER_LINK, SHORT = 0.3, 0.7, 4, 12
_TERMINAL = r"[.!?…。！？։।؟][\"'”’»)\]]*$"
# Phrases of page furniture.
_BOILERPLATE = r"(?i)(?:all rights reserved|privacy policy|terms of (?:use|service)|cookie|javascript|sign (?:in|up)|log ?in|subscribe|newsletter|read more|click here|share this|skip to|back to top|powered by|lorem ipsum|copyright)"
_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_kept_words long"


def _sum(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers, exact below 2**53."""
    return np.bincount(at, weights=weights, minlength=n).astype(np.int64)


def repeated_windows(word: np.ndarray, n_distinct: int, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A flag for each 3-word window: its document has it twice or more."""
    a, b, c = (word[starts + i] for i in range(3))
    if n_distinct < 1 << 21:
        order = np.lexsort(((a * n_distinct + b) * n_distinct + c, doc))
    else:
        order = np.lexsort((c, b, a, doc))
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in (a, b, c, doc):
        x = x[order]
        same &= x[1:] == x[:-1]
    flags = np.zeros(len(order), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return flags


def judge(texts: pa.Array, with_text: bool = False) -> list[pa.Array]:
    """The columns in `_ADDED`, and by choice the text without failing lines."""
    n = len(texts)
    cut = pc.split_pattern(translated(texts, None).cast(pa.large_string()), "\n")
    n_lines = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, doc_of = pc.list_flatten(cut), np.repeat(np.arange(n), n_lines)
    words = Words(lines, WHITE_SPACE)
    line, word = words.doc, words.word
    doc = doc_of[line]
    distinct = words.distinct.cast(pa.large_string())

    def of_words(values: pa.Array) -> np.ndarray:
        return values.to_numpy(zero_copy_only=False).astype(np.int64)[word]

    chars, symbols = of_words(pc.utf8_length(distinct)), of_words(pc.count_substring_regex(distinct, r"[#*$%&|<>]"))
    in_line = words.lengths
    n_words = np.bincount(doc, minlength=n).astype(np.int64)

    # base counts
    coded = lines.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    filled = in_line > 0
    unique = np.unique(doc_of[filled] * (len(coded.dictionary) + 1) + code[filled])
    n_dup = np.bincount(doc_of[filled], minlength=n) - np.bincount(unique // (len(coded.dictionary) + 1), minlength=n)
    begins = np.cumsum(n_words) - n_words
    n_windows = np.maximum(n_words - 2, 0)
    starts = np.arange(int(n_windows.sum())) + np.repeat(begins - (np.cumsum(n_windows) - n_windows), n_windows)
    flagged = starts[repeated_windows(word, len(distinct), starts, doc[starts])]
    covered = np.zeros(len(word) + 2, bool)
    for i in range(3):
        covered[flagged + i] = True
    n_repeat = np.bincount(doc[covered[: len(doc)]], minlength=n)
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 50 * n_words)

    # lines
    n_line = len(lines)
    noisy = _sum(line, symbols > 0, n_line)
    upper, cased = (_sum(line, of_words(pc.count_substring_regex(distinct, p)), n_line) for p in (r"\p{Lu}", r"[\p{Lu}\p{Ll}]"))
    links = _sum(line, of_words(pc.match_substring_regex(distinct, r"^[|»•>]+$")), n_line)
    terminal = np.zeros(n_line, bool)
    last = np.cumsum(in_line)[filled] - 1
    terminal[filled] = pc.match_substring_regex(distinct, _TERMINAL).to_numpy(zero_copy_only=False)[word[last]]
    furniture = pc.match_substring_regex(coded.dictionary, _BOILERPLATE).to_numpy(zero_copy_only=False)[code]
    failed = ~terminal | (noisy > NOISY * in_line) | ((in_line >= 3) & (upper > LOUD * cased)) | ((links >= 2) & (in_line - links < PER_LINK * links)) | (furniture & (in_line <= SHORT))
    failed &= filled
    n_kept = n_words - _sum(doc_of, np.where(failed, in_line, 0), n)
    kept = ~base_failed & (n_kept >= (1 - MOST_LOST) * n_words)
    out = [pa.array(x) for x in (n_words, _sum(doc, chars, n), _sum(doc, symbols, n), n_dup.astype(np.int64), n_repeat.astype(np.int64), base_failed, kept, n_kept)]
    if with_text:
        held = lines.to_pylist()
        ends = np.cumsum(n_lines)
        whole = np.add.reduceat(failed, ends - n_lines) == 0 if n else np.zeros(0, bool)
        given = texts.to_pylist()
        out.append(pa.array([given[i] if whole[i] or not kept[i] else "\n".join(held[k] for k in range(e - m, e) if not failed[k]) for i, (e, m) in enumerate(zip(ends.tolist(), n_lines.tolist()))], pa.string()))
    return out


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`row`, a struct of the columns in `keep` (all), with the counts and verdicts."""
    return annotate(docs, keep or docs.columns, lambda: judge, _ADDED)


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of `docs`: failing lines are gone from text, and n_chars, if there is such a
    column, counts what is left."""
    others = [c for c in docs.columns if c != "text"]
    found = annotate(docs, others, lambda: lambda texts: judge(texts, True), _ADDED + ", cleaned string").filter("kept")
    new = {"text": "cleaned", "n_chars": "cast(char_length(cleaned) as long)"}
    return found.selectExpr(*(f"{new[c]} as `{c}`" if c in new else f"row.`{c}`" for c in docs.columns))


def op8_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs))),
counts AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM words GROUP BY r),
windows AS (SELECT r, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lines AS (SELECT r, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
filled AS (SELECT *, CAST(len(ws) AS BIGINT) AS n FROM lines WHERE len(ws) > 0),
judged AS (
  SELECT r, line, n,
         NOT regexp_matches(ws[-1], '{_TERMINAL.replace("'", "''")}')
         OR len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>]'))) > {NOISY} * n
         OR n >= 3 AND len(regexp_extract_all(line, '\\p{{Lu}}')) > {LOUD} * len(regexp_extract_all(line, '[\\p{{Lu}}\\p{{Ll}}]'))
         OR len(list_filter(ws, lambda w: regexp_matches(w, '^[|»•>]+$'))) >= 2 AND n - len(list_filter(ws, lambda w: regexp_matches(w, '^[|»•>]+$'))) < {PER_LINK} * len(list_filter(ws, lambda w: regexp_matches(w, '^[|»•>]+$')))
         OR n <= {SHORT} AND regexp_matches(line, '{_BOILERPLATE}') AS failed
  FROM filled),
by_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (WHERE NOT failed), 0) AS BIGINT) AS n_kept_words FROM judged GROUP BY r),
found AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_kept_words, 0) AS n_kept_words
  FROM docs LEFT JOIN counts USING (r) LEFT JOIN repeats USING (r) LEFT JOIN by_line USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= {1 - MOST_LOST} * n_words AS kept
FROM found
"""

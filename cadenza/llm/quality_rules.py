"""Line-first quality rules: judge lines, remove the failing ones, then judge what the document lost.

A line with a word fails if any of these holds:

* punctuation: its last character is not one of END_MARKS and it has less than one full stop before a
  space for every STOP_WORDS words;
* symbols: SYMBOLS characters number more than one for every SYMBOL_WORDS words;
* shouting: ``!!`` occurs at more than one for every SHOUT_WORDS words;
* navigation: it holds a navigation mark (``»``, ``›``) or NAV_BARS bars or more;
* boilerplate: its lower-cased (A-Z) text holds one of BOILERPLATE;
* repetition: it has REPEAT_LEAST words or more and fewer than one distinct word in REPEAT_WORDS;
* copy: it equals an earlier line.

A document is kept if the base rules pass and at least KEEP_SHARE percent of its words are in lines that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import hash_words, small_batches, window_hashes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
END_MARKS = (".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "”", "’", "»")
_END_BYTES = tuple(m.encode() for m in END_MARKS)
SYMBOL_WORDS, SHOUT_WORDS, NAV_BARS, REPEAT_LEAST, REPEAT_WORDS, STOP_WORDS, KEEP_SHARE = 4, 4, 3, 8, 4, 25, 50
BOILERPLATE = ("all rights reserved", "cookie", "javascript", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "click here", "sign up", "log in", "licensed under")
_BOILERPLATE_BYTES = tuple(p.encode() for p in BOILERPLATE)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words lying in a ``window``-word window whose words occur as a window twice or more."""
    if len(words) <= window:
        return 0
    h = window_hashes(hash_words(words), window)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + len(h)] |= twice
    return int(covered.sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    if not words[-1].endswith(_END_BYTES) and line.count(b". ") * STOP_WORDS < n:
        return True
    if (len(line) - len(line.translate(None, SYMBOLS))) * SYMBOL_WORDS > n or line.count(b"!!") * SHOUT_WORDS > n:
        return True
    if line.count(b"|") >= NAV_BARS or "»".encode() in line or "›".encode() in line:
        return True
    if n >= REPEAT_LEAST and len(set(words)) * REPEAT_WORDS < n:
        return True
    low = line.lower()
    return any(p in low for p in _BOILERPLATE_BYTES)


def judge(text: bytes | None, words: list[bytes] | None = None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words.

    ``words``: an empty list that gets the text's words, for callers that go on with them.
    """
    text = text or b""
    words = [] if words is None else words
    seen: set[bytes] = set()
    dup = stay = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        words += own
        if line in seen:
            dup += 1
            continue
        seen.add(line)
        if not line_fails(line, own):
            stay += len(own)
    n = len(words)
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    return n, len(text.translate(None, SPACE + _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, failed, not failed and 100 * stay >= KEEP_SHARE * n, stay


def cleaned(text: bytes) -> bytes:
    """The text without the lines that fail (blank lines stay)."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        own = line.split()
        if own and (line in seen or line_fails(line, own)):
            continue
        seen.add(line)
        out.append(line)
    return b"\n".join(out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs`` with the base figures, the verdict and the words that stay.

    A null text counts as empty (n_words 0: base_failed).  Ids may be null or repeat; other columns are
    not read.  With ``with_text`` the cleaned text is added.  Row by row: no shuffle, no state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            n, chars, symbols, dup, repeat, failed, kept, stay = list(zip(*map(judge, texts))) or [()] * 8
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, chars, symbols, dup, repeat)), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(stay, pa.int64())]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if with_text:
                cols.append(pa.array([None if t is None else cleaned(t).decode() for t in texts], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", clean_text string" if with_text else ""))


def _sql_list(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


_W, _S = r"'[^\x20\x09-\x0D]+'", r"'[\x20\x09-\x0D]+'"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_W}) AS words FROM d),
li AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lw AS (SELECT *, regexp_extract_all(line, {_W}) AS lwords FROM li),
lj AS (
  SELECT r, len(lwords) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS dup,
    (NOT list_contains([{_sql_list(END_MARKS)}], right(lwords[len(lwords)], 1)) AND ((length(line) - length(replace(line, '. ', ''))) // 2) * {STOP_WORDS} < len(lwords))
    OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * {SYMBOL_WORDS} > len(lwords)
    OR ((length(line) - length(replace(line, '!!', ''))) // 2) * {SHOUT_WORDS} > len(lwords)
    OR length(line) - length(replace(line, '|', '')) >= {NAV_BARS} OR contains(line, '»') OR contains(line, '›')
    OR (len(lwords) >= {REPEAT_LEAST} AND len(list_distinct(lwords)) * {REPEAT_WORDS} < len(lwords))
    OR {" OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in BOILERPLATE)} AS fails
  FROM lw WHERE len(lwords) > 0),
la AS (SELECT r, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(n) FILTER (NOT dup AND NOT fails), 0)::BIGINT AS kept_words FROM lj GROUP BY r),
p AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT r, i, CASE WHEN i <= len(words) - 2 THEN words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS g FROM p),
tw AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM t),
tc AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM tw),
rp AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM tc GROUP BY r),
f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, {_S}, '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM w LEFT JOIN la USING (r) LEFT JOIN rp USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_words >= {KEEP_SHARE} * n_words AS kept
FROM f
"""

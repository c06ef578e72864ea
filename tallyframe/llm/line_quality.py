"""Quality rules with cross-document line frequency.

One pass over the texts takes, per document, the base figures and the hashes of
its normalised lines (A-Z in lower case, white space collapsed, the host in front).
Lines are then counted per host over all documents. Copies must not make a line
look like boilerplate, so what is counted is not rows but distinct documents: those with the
same set of normalised lines, known by a 128-bit digest of it, count once.
A line is above the limits when at least ``min_documents`` distinct documents of its host hold
it and these are more than ``max_share`` of the host's distinct documents. Such
lines are removed, and a document that loses more than ``max_removed`` of its
words is depleted and rejected. :func:`line_quality` gives the verdicts,
:func:`frequent_lines_removed` the kept documents without those lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices, uncollected
from .scratch import Scratch
from .words import window_hashes, word_hashes

#: Rows up to which a table of lines is broadcast: 16 bytes each.
BROADCAST_ROWS = 100_000
_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
STATS = "doc_id bigint, host string, key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, d0 bigint, d1 bigint, line array<bigint>, line_words array<int>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = window_hashes(word_hashes(words), width)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    repeated = np.isin(windows, twice)
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : k + len(windows)] |= repeated
    return int(inside.sum())


def normalise_line(line: str) -> bytes:
    """A-Z in lower case, white space collapsed and trimmed."""
    return b" ".join(line.encode().lower().split())


def host_key(host: str | None) -> str:
    """A host's name as a key; rows without one form a host of their own, other than the empty name."""
    return "" if host is None else "=" + host


def line_hash(line: str, host: str) -> int:
    """Hash of the normalised line within its host, given by its key."""
    return xxhash.xxh3_64_intdigest(host.encode() + b"\n" + normalise_line(line)) - 2**63


def text_figures(text: str, host: str) -> tuple:
    """Base figures, the digest of the set of lines, line hashes and their words in the text."""
    words = text.encode().split()
    seen: set[str] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in text.split("\n"):
        if not line.strip(_BLANK):
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        h = line_hash(line, host)
        lines[h] = lines.get(h, 0) + len(line.encode().split())
    digest = xxhash.xxh3_128_intdigest(np.sort(np.fromiter(lines, np.int64, len(lines))).tobytes())
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANK)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeated_words(words),
        (digest >> 64) - 2**63,
        (digest & 2**64 - 1) - 2**63,
        list(lines),
        list(lines.values()),
    )


def _key(docs: DataFrame, host_col: str) -> Column:
    """What a verdict depends on, text and host, as one hash: with ``doc_id`` it finds the row again."""
    return F.xxhash64(docs["text"], docs[host_col].cast("string")).alias("key")


def figures(docs: DataFrame, host_col: str) -> DataFrame:
    """One row of figures and line hashes per document."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "d0", "d1")], ("line", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])
        for b in slices(batches):
            with uncollected():
                hosts = [host_key(h) for h in b.column(2).to_pylist()]
                rows = [text_figures(t or "", h) for t, h in zip(b.column(1).to_pylist(), hosts, strict=True)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[3:], strict=True)]
            yield pa.record_batch([b.column(0), pa.array(hosts, pa.string()), b.column(3), *columns], schema=schema)

    return docs.select("doc_id", "text", F.col(host_col).cast("string").alias("host"), _key(docs, host_col)).mapInArrow(run, STATS)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _judged(
    docs: DataFrame,
    scratch: Scratch,
    *,
    host_col: str = "source",
    min_words: int = 50,
    max_repeat: int = 50,
    min_documents: int = 20,
    max_share: float = 0.05,
    max_removed: float = 0.8,
) -> DataFrame:
    """Figures, verdict, key and the hashes of the lines above the limits (``gone``, null if none) of every document."""
    stats = scratch.keep(figures(docs, host_col).withColumn("uid", F.monotonically_increasing_id()), "figures")
    each = stats.select("uid", "host", "d0", "d1", F.inline(F.arrays_zip("line", "line_words")))
    # Rows are an upper bound on distinct documents: only lines in enough rows need the finer count.
    often = scratch.keep(each.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("line"), "often")
    n_often = often.count()
    counted = (
        each.join(_small(often, n_often), "line")
        .select("line", "host", "d0", "d1")
        .distinct()
        .groupBy("line", "host")
        .agg(F.count("*").alias("n"))
    )
    hosts = stats.select("host", "d0", "d1").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    above = counted.filter(F.col("n") >= min_documents).join(hosts, "host").filter(F.col("n") > max_share * F.col("docs")).select("line")
    above = scratch.keep(above, "above")
    removed = (
        each.select("uid", "line", "line_words")
        .join(_small(above, above.count()), "line")
        .groupBy("uid")
        .agg(F.sum("line_words").alias("n_removed_words"), F.collect_list("line").alias("gone"))
    )
    out = stats.drop("line", "line_words").join(removed, "uid", "left").na.fill(0, ["n_removed_words"])
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = F.col("n_removed_words") > max_removed * F.col("n_words")
    return out.select("*", base.alias("base_failed"), (~base & ~depleted).alias("kept"))


def line_quality(docs: DataFrame, **limits) -> DataFrame:
    """Figures and verdict of every document; ``limits`` are those of :func:`_judged`.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words``. Null text counts as empty and fails the base rule; null hosts form a host of their
    own. Texts of any length are read whole. Repeated rows are judged and returned once each; extra columns are not read; an empty
    table gives no rows.
    """
    return _judged(docs, Scratch(docs.sparkSession, "lines"), **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words",
    )


def without_lines(text: str, host: str, gone: list[int]) -> str:
    """The text without the lines of those hashes; blank lines stay."""
    drop = set(gone)
    return "\n".join(line for line in text.split("\n") if not line.strip(_BLANK) or line_hash(line, host) not in drop)


def frequent_lines_removed(docs: DataFrame, *, host_col: str = "source", **limits) -> DataFrame:
    """The kept rows, all their columns, with the lines above the limits taken out of ``text``.

    Every row is judged for itself, also where rows share an id or have none; ``limits`` are those of
    :func:`_judged`. Texts without such lines stay as they are.
    """
    scratch, columns = Scratch(docs.sparkSession, "cleaned"), docs.columns
    judged = _judged(docs, scratch, host_col=host_col, **limits).filter(~F.col("kept") | F.col("gone").isNotNull())
    # Rows of one id, text and host have one verdict. Rows that are kept whole need no mark.
    marks = judged.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.first("kept").alias("_kept"), F.first("gone").alias("_gone"))
    marks = scratch.keep(marks.withColumn("_gone", F.when(F.col("_kept"), F.col("_gone"))), "marks")
    size = marks.agg(F.count("*") + F.coalesce(F.sum(F.greatest(F.size("_gone"), F.lit(0))), F.lit(0))).first()[0]
    same = docs["doc_id"].eqNullSafe(marks["_id"]) & (_key(docs, host_col) == marks["_key"])
    left = docs.join(_small(marks, size), same, "left").filter(F.coalesce("_kept", F.lit(True)))
    at = columns.index("text")

    def run(batches):
        for b in slices(batches):
            texts, hosts, gone = (b.column(k).to_pylist() for k in (at, -2, -1))
            texts = [t if g is None else without_lines(t, host_key(h), g) for t, h, g in zip(texts, hosts, gone, strict=True)]
            kept = [pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(columns))]
            yield pa.record_batch(kept, columns)

    return left.select(*[docs[c] for c in columns], docs[host_col].cast("string").alias("_host"), "_gone").mapInArrow(run, docs.schema)


def line_quality_sql() -> str:
    """DuckDB SQL of :func:`line_quality` with its default limits."""
    words = lambda c: f"regexp_extract_all({c}, '[^\\x20\\x09-\\x0D]+')"
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words('t')} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT uid, i FROM win QUALIFY count(*) OVER (PARTITION BY uid, k) > 1),
rep AS (SELECT uid, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) x(o) GROUP BY uid),
each AS (SELECT uid, host, array_to_string({words(lower('l'))}, ' ') AS line, len({words('l')}) AS n FROM (SELECT uid, host, unnest(lines) AS l FROM w)),
ls AS (SELECT uid, host, line, CAST(sum(n) AS BIGINT) AS n FROM each GROUP BY ALL),
sets AS (SELECT w.uid, w.host, coalesce(md5(string_agg(line, chr(10) ORDER BY line)), '') AS s FROM w LEFT JOIN ls ON w.uid = ls.uid GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT s) AS docs FROM sets GROUP BY 1),
above AS (SELECT ls.host, line FROM ls JOIN sets USING (uid) JOIN hosts ON hosts.host = ls.host GROUP BY ls.host, line, docs HAVING count(DISTINCT s) >= 20 AND count(DISTINCT s) > 0.05::DOUBLE * docs),
gone AS (SELECT uid, CAST(sum(n) AS BIGINT) AS n FROM ls SEMI JOIN above USING (host, line) GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words FROM w LEFT JOIN rep USING (uid) LEFT JOIN gone USING (uid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.8::DOUBLE * n_words AS kept FROM f"""

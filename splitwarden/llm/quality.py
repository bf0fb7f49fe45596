"""Quality rules: text statistics, and boilerplate found by cross-document line frequency.

Lines are normalised and hashed; distinct documents are counted for each host and line; lines seen in too many are removed,
and documents that little is left of are rejected. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, unused

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "removed_words", "kept")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _digest(text: Column) -> Column:
    """SHA-256 as binary: texts of one digest are taken for equal. It is declared never null, so that joins on it add no filter, and
    plans that differ by such a filter only can share an exchange."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(bytearray()))


def _low_bits(n: Column) -> Column:
    """A mask of the bits that positions under ``n`` need."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1


def _ranked_windows(words: Column, n: Column, low: Column, hashed=F.xxhash64) -> Column:
    """The 3-word windows, sorted by a hash and then by position, which share one long: positions take the bits of ``low``."""
    window = lambda i: hashed(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    return F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _neighbours(size: Column, same) -> Column:
    """The places j whose successor is the same."""
    return F.when(size > 1, F.filter(F.sequence(F.lit(0), size - 2), same)).otherwise(F.array().cast("array<int>"))


def _covered(places: Column, position) -> Column:
    """How many words the windows at ``places`` and their successors cover."""
    both = F.flatten(F.transform(places, lambda j: F.array(position(j), position(j + 1))))
    return F.size(F.array_distinct(F.flatten(F.transform(both, lambda p: F.array(p, p + 1, p + 2))))).cast("long")


def _repeat_words(words: Column, n: Column, ranked: Column, low: Column, alike: Column) -> Column:
    """How many words lie in 3-word windows that another window equals.

    ``alike`` has the places in ``ranked`` whose successor has the same hash. Where such a pair differs in a word, windows of
    different words share a hash, and could stand between equal ones; such a text's windows are sorted as strings instead.
    """
    position = lambda j: F.get(ranked, j).bitwiseAND(low).cast("int")
    differ = lambda p, q: (F.get(words, p) != F.get(words, q)) | (
        F.get(words, p + 1) != F.get(words, q + 1)
    ) | (F.get(words, p + 2) != F.get(words, q + 2))
    collide = F.exists(alike, lambda j: differ(position(j), position(j + 1)))
    spelled = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("at"))
        )
    )
    exact = _covered(_neighbours(n - 2, lambda j: F.get(spelled, j)["w"] == F.get(spelled, j + 1)["w"]), lambda j: F.get(spelled, j)["at"])
    return F.when(F.size(alike) == 0, F.lit(0).cast("long")).when(collide, exact).otherwise(_covered(alike, position))


def text_statistics(docs: DataFrame, text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts have zero everywhere and fail. Columns of these names are replaced. ``hashed`` only sorts: equal
    windows are found by their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.drop(*RESULT)
    names = unused(base, "__words", "__lines", "__low", "__ranked", "__alike", "__counts")
    words, lines, low, ranked, alike = (F.col(n) for n in names[:5])
    n = F.size(words)
    out = base.withColumns({names[0]: words_of(text), names[1]: F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))}).withColumn(names[2], _low_bits(n))
    out = out.withColumn(names[3], _ranked_windows(words, n, low, hashed))
    same_hash = lambda j: F.get(ranked, j).bitwiseAND(F.bitwise_not(low)) == F.get(ranked, j + 1).bitwiseAND(F.bitwise_not(low))
    out = out.withColumn(names[4], _neighbours(F.size(ranked), same_hash))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words, n, ranked, low, alike).alias("n_repeat_words"),
    )
    # A generator of one row: a filter on the counts stays above it, and is not rewritten into their nested definitions.
    out = out.select(*[F.col(f"`{c}`") for c in base.columns], F.explode(F.array(counts)).alias(names[5]))
    out = out.select(*[F.col(f"`{c}`") for c in base.columns], F.col(f"{names[5]}.*"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, single spaces, no outer space."""
    return F.btrim(F.lower(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def frequent_lines(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = 20, count: str = "documents", with_lines: bool = False
) -> DataFrame:
    """(host, text, removed_lines, removed_words) of every distinct text that holds boilerplate; host and text are known by SHA-256,
    and so are lines. ``with_lines`` adds the digests of its boilerplate lines.

    A line of any length is boilerplate where more than ``max_docs`` documents of its host hold it. With ``count="texts"`` the
    copies of a text count as one. Rows are first aggregated to (host, text, line), so that neither a hot host nor a
    hot line meets in one task; the text itself is not shuffled.
    """
    if count not in ("documents", "texts"):
        raise ValueError("count is 'documents' or 'texts'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")
    each = F.sort_array(F.transform(normal, lambda x: F.struct(_digest(x).alias("line"), F.size(F.split(x, " ")).alias("words"))))
    rows = docs.select(F.col(host_col).alias("host"), _digest(text).alias("text"), each.alias("each"))
    first = lambda x, k: (k == 0) | (F.get(F.col("each"), k - 1)["line"] != x["line"])
    rows = rows.select(
        "host", "text",
        F.explode(
            F.transform("each", lambda x, k: F.struct(x["line"].alias("line"), x["words"].alias("words"), first(x, k).cast("int").alias("first")))
        ).alias("x")
    )
    rows = rows.groupBy("host", "text", "x.line").agg(F.sum("x.first").alias("copies"), F.count("*").alias("times"), F.max("x.words").alias("words"))
    rows = rows.where("copies > 0 and times > 0 and words > 0")  # always so; keeps the columns, so that both readers share one exchange
    often = rows.groupBy("host", "line").agg(
        (F.sum("copies") if count == "documents" else F.sum(F.sign("copies").cast("long"))).alias("n")
    ).where(F.col("n") > max_docs)
    often = often.select(F.col("host").alias("often_host"), F.col("line").alias("often_line"))
    hit = rows.join(often, (F.col("line") == F.col("often_line")) & F.col("host").eqNullSafe(F.col("often_host")))
    each_time = (F.col("times") / F.col("copies")).cast("long")  # copies of a text hold a line equally often
    found = [F.sum(each_time).alias("removed_lines"), F.sum(each_time * F.col("words")).alias("removed_words")]
    return hit.groupBy("host", "text").agg(*found, *([F.collect_set("line").alias("lines")] if with_lines else []))


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = 20, least_share: float = 0.3, clean: bool = False, count: str = "documents"
) -> DataFrame:
    """``docs`` with the statistics, ``removed_lines``, ``removed_words`` and ``kept``; with ``clean`` also ``clean_text``.

    ``kept`` is false where base_failed, or where under ``least_share`` of the words are left without boilerplate
    lines. Null text counts as empty (fails); a null host is a host of its own; repeated rows are judged alike, and each counts as a
    document (``count="texts"``: one for each distinct text); an empty table gives an empty result. Columns with a result's name are replaced.
    """
    lost = frequent_lines(docs, text_col, host_col, max_docs, count, with_lines=clean)
    base = docs.drop("clean_text")
    host, text, lines, digest = unused(base, "__host", "__text", "__lines", "__digest")
    lost = lost.withColumnsRenamed({"host": host, "text": text, "lines": lines})
    own = F.coalesce(F.col(text_col), F.lit(""))
    out = text_statistics(base, text_col).withColumn(digest, _digest(own))
    out = out.join(lost, (F.col(digest) == F.col(text)) & F.col(host_col).eqNullSafe(F.col(host)), "left")
    for name in ("removed_lines", "removed_words"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_share * F.col("n_words")))
    if clean:
        left = F.filter(F.split(own, "\n"), lambda x: ~F.array_contains(F.col(lines), _digest(normal_line(x))))
        out = out.withColumn("clean_text", F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return out.drop(host, text, lines, digest)


#: DuckDB SQL for the columns of the contract; takes max_docs and least_share.
ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls from d),
tri as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
tri2 as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from tri),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri2) where n > 1),
cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by 1),
full_lines as (select doc_id, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as fl from w),
base as (
  select w.doc_id, w.source, w.t, cast(len(ws) as bigint) as n_words,
    cast(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(fl) - len(list_distinct(fl)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w join full_lines using (doc_id) left join cov using (doc_id)),
lines as (select doc_id, source, t, line, len(string_split(line, ' ')) as words from (select doc_id, source, t, trim(lower(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) as line from (select doc_id, source, t, unnest(ls) as l from w)) where line <> ''),
often as (select source, line from lines group by 1, 2 having count(distinct doc_id) > {max_docs}),
lost as (select doc_id, sum(words) as removed_words from lines l join often f on l.line = f.line and l.source is not distinct from f.source group by 1)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and (n_words - coalesce(removed_words, 0) >= {least_share} * n_words) as kept
from base b left join lost l using (doc_id)
"""

"""Divergence of sources within a language, by a two-pass vocabulary automaton.

The first pass counts in how many documents of a language each term stands, exactly, and keeps the terms of enough documents.
The second pass finds the kept terms again in texts whose terms are padded by blanks, with an Aho-Corasick automaton
of " term " patterns, and counts them for each source. A task reads its texts in slices of bounded size, and a slice's automaton holds
only those of the slice's terms that a Bloom filter of fixed size lets through; counts of terms that aren't kept fall out when they
meet the kept ones. So no task and no driver ever holds a vocabulary.

Sources are compared by sparse postings: a sum over all kept terms is what two sources without any term would give, plus what
the terms of one or the other add, counted by a histogram of its shares, plus a correction for each term they share. Tasks add up
the corrections of blocks of sources, so pairs leave them as sums, not term by term.
"""

from __future__ import annotations

from collections import defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, materialise, slices

#: Characters of text in a slice, sources in a block, and bits of the filter as a power of two.
SLICE_BYTES, BLOCK, FILTER_BITS = 24 << 20, 512, 26
#: ASCII letters become lower case, other ASCII characters blanks; bytes of other characters stay.
TABLE = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))


def terms_of(texts: list[str]) -> tuple[bytes, pa.Array, np.ndarray]:
    """The terms of texts, each followed by a blank: as one string of bytes, as an array, and how many each text has."""
    blobs = [t.encode().translate(TABLE) for t in texts]
    raw = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    blank = raw == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # of a row of blanks the first one, unless it leads
    data = raw[keep]
    ends = np.flatnonzero(data == 32) + 1
    borders = np.cumsum([len(b) + 1 for b in blobs])
    counts = np.diff(np.r_[0, np.searchsorted(ends, np.cumsum(keep)[borders - 1], "right")]) if len(blobs) else np.zeros(0, np.int64)
    data = data.tobytes()
    terms = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(data)])
    return data, terms, counts


def _by_language(batches, slice_bytes: int):
    """{lang: {source: texts}} of slices of the rows; a row without a source has None."""
    held, size = defaultdict(lambda: defaultdict(list)), 0
    for batch in slices(batches):
        columns = [c.to_pylist() for c in batch.columns]
        for lang, *source, t in zip(*columns):
            held[lang][source[0] if source else None].append(t)
            size += len(t)
            if size > slice_bytes:
                yield held
                held, size = defaultdict(lambda: defaultdict(list)), 0
    yield held


def _rows(lang: str, source: str | None, terms: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """(lang[, source], term, n) of the terms that have a count."""
    at = np.flatnonzero(counts)
    text = pc.binary_slice(terms.take(pa.array(at)).cast(pa.binary()), 0, -1).cast(pa.string())  # without the blank
    keys = {"lang": lang} | ({} if source is None else {"source": source})
    arrays = {k: pa.array([v], pa.string()).take(pa.array(np.zeros(len(at), np.int64))) for k, v in keys.items()}
    return pa.RecordBatch.from_pydict(arrays | {"term": text, "n": pa.array(counts[at], pa.int64())})


def _document_terms(slice_bytes: int):
    """(lang, term, n): in how many documents of a slice a term stands."""

    def run(batches):
        for held in _by_language(batches, slice_bytes):
            for lang, sources in held.items():
                _, terms, counts = terms_of(sources[None])
                coded = terms.dictionary_encode()
                size = max(1, len(coded.dictionary))
                pairs = np.sort(np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy())
                pairs = pairs[np.diff(pairs, prepend=-1) != 0]
                yield _rows(lang, None, coded.dictionary, np.bincount(pairs % size, minlength=len(coded.dictionary)))

    return run


def filter_places(lang: str, terms: list[bytes], bits: int) -> np.ndarray:
    """2 x terms: the bits that kept terms set in a filter of ``bits`` bits, a power of two, as ``_filter`` computes them."""
    lead, digest = b"%b " % lang.encode(), xxhash.xxh64_intdigest
    h = np.array([digest(lead + t, 42) for t in terms], np.uint64)
    return np.stack([h, h >> np.uint64(32)]) & np.uint64(bits - 1)


def _filter(kept: DataFrame, log_bits: int) -> np.ndarray:
    """The filter's words of 64 bits: 2^log_bits bits, whatever the number of terms."""
    h, most = F.xxhash64(F.concat("lang", F.lit(" "), "term")), F.lit((1 << log_bits) - 1).cast("long")
    places = kept.select(F.explode(F.array(h.bitwiseAND(most), F.shiftrightunsigned(h, 32).bitwiseAND(most))).alias("at"))
    words = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << log_bits - 6, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _recount(shared, slice_bytes: int):
    """(lang, source, term, n) of the terms that the filter lets through, as a slice's automaton finds them in its texts."""

    def run(batches):
        import ahocorasick

        words = shared.value
        for held in _by_language(batches, slice_bytes):
            for lang, sources in held.items():
                found = {source: terms_of(texts)[:2] for source, texts in sources.items()}
                own = pa.chunked_array([terms for _, terms in found.values()]).unique()
                at = filter_places(lang, [t[:-1] for t in own.to_pylist()], 64 * len(words))
                own = own.filter(pa.array((words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)))
                if not len(own):
                    continue
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for k, term in enumerate(own.to_pylist()):
                    automaton.add_word(f" {term.decode()}", k)
                automaton.make_automaton()
                for source, (data, _) in found.items():
                    hits = np.fromiter(map(itemgetter(1), automaton.iter(f" {data.decode()}")), np.int64)
                    yield _rows(lang, source, own, np.bincount(hits, minlength=len(own)))

    return run


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches):
    """(lang, a, b, value): what shared terms add to the sum of sources a and b, added up for pairs of blocks of sources."""
    at, total = None, None

    def rows():
        a, b = np.nonzero(total)
        lang, block_a, block_b = at
        columns = [pa.array([lang] * len(a), pa.string()), pa.array(a + BLOCK * block_a), pa.array(b + BLOCK * block_b), pa.array(total[a, b])]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    def flat(column):
        entries = column.flatten()
        return column.offsets.to_numpy() - column.offsets[0].as_py(), *(entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))

    for batch in slices(batches):
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        (cut_a, a, p, p0), (cut_b, b, q, q0) = flat(batch.column(3)), flat(batch.column(4))
        size_a, size_b = np.diff(cut_a), np.diff(cut_b)
        ends = np.cumsum(size_a * size_b)
        k = 0
        while k < len(keys):  # some terms of one pair of blocks, about a million pairs of sources at a time
            last = int(np.searchsorted(ends, ends[k] + (1 << 20)))
            last = next((m for m in range(k + 1, last) if keys[m] != keys[k]), max(last, k + 1))
            if keys[k] != at:
                if at is not None:
                    yield rows()
                at, total = keys[k], np.zeros((BLOCK, BLOCK), np.int64)
            term = np.repeat(np.arange(k, last), size_a[k:last])  # of each first source
            times = size_b[term]
            one = np.repeat(np.arange(cut_a[k], cut_a[last]), times)
            two = np.arange(len(one)) + np.repeat(cut_b[term] - (np.cumsum(times) - times), times)
            x, x0, y, y0 = p[one], p0[one], q[two], q0[two]
            np.add.at(total, (a[one] % BLOCK, b[two] % BLOCK), excess(x, y) - excess(x, y0) - excess(x0, y) + excess(x0, y0))
            k = last
    if at is not None:
        yield rows()


#: 1 + floor(10^9 (n + 1) / (N + V)), in decimals where longs are too short, and floor((p - q)^2 / q).
SHARE = (
    "case when {n} < 9000000000 then 1 + (1000000000L * ({n} + 1)) div ({total} + v) "
    "else 1 + (cast(1000000000 as decimal(20, 0)) * cast({n} + 1 as decimal(18, 0))) div cast({total} + v as decimal(20, 0)) end"
)
EXCESS = "(({p} - {q}) * ({p} - {q})) div {q}"


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200,
    slice_bytes: int = SLICE_BYTES, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and the terms it has more of.

    Part ``pair`` ranks all other sources of the language by the summed excess; part ``term`` ranks a source's ``top`` terms by their
    excess over the whole language. Null texts, languages and sources are read as ''. A source without terms, a language without kept
    terms (all its values are 0) and a language's only source (no pairs) are defined cases; repeated rows count each time; an
    empty table gives an empty result; other columns are not read. The other parameters are sizes (``filter_bits``: a power of two from 6 on) and
    change no result.
    """
    spark = docs.sparkSession
    texts = docs.select(*(body(F.col(c).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "t"))))
    terms = texts.select("lang", "t").mapInArrow(_document_terms(slice_bytes), "lang string, term string, n long")
    kept = materialise(terms.groupBy("lang", "term").agg(F.sum("n").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term"), "kept")
    shared = spark.sparkContext.broadcast(_filter(kept, filter_bits))
    found = texts.mapInArrow(_recount(shared, slice_bytes), "lang string, source string, term string, n long")
    # one shuffle by term: sums for each source, and the mark of the kept terms
    marked = found.unionByName(kept.select("lang", F.lit(None).cast("string").alias("source"), "term", F.lit(0).cast("long").alias("n"))).repartition("lang", "term")
    summed = marked.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("lang", "term").agg(F.max(F.col("source").isNull()).alias("kept"), F.sum("n").alias("whole"), F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("list"))
    lists = materialise(lists.where("kept").drop("kept"), "postings")
    counts = lists.select("lang", "term", "whole", F.explode("list").alias("at")).select("lang", "term", "whole", "at.source", "at.n")

    # every source of a language: its number in the language, the words it has of kept terms, and the share of a term it lacks
    order = Window.partitionBy("lang").orderBy("source")
    groups = texts.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(lists.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["total", "v"])
    groups = groups.withColumn("number", (F.row_number().over(order) - 1).cast("long"))
    groups = materialise(groups.withColumn("zero", F.when(F.col("v") > 0, F.expr(SHARE.format(n="0L", total="total")))), "groups")
    sums = groups.groupBy("lang").agg(F.sum("total").alias("all_terms"))
    postings = counts.join(groups.join(sums, "lang"), ["lang", "source"]).withColumns(
        {"p": F.expr(SHARE.format(n="n", total="total")), "q": F.expr(SHARE.format(n="whole", total="all_terms"))}
    )
    postings = postings.select("lang", "term", "source", "number", "zero", "p", "q")
    above = postings.where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(EXCESS.format(p="p", q="q")).alias("value"))

    blocks = postings.groupBy("lang", "term", F.expr(f"number div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("number", "p", "zero")).alias("list"))
    left, right = (blocks.select("lang", "term", F.col("block").alias(f"block_{k}"), F.col("list").alias(f"list_{k}")) for k in "ab")
    shared = left.join(right, ["lang", "term"]).select("lang", "block_a", "block_b", "list_a", "list_b").sortWithinPartitions("lang", "block_a", "block_b")
    shared = shared.mapInArrow(_corrections, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("shared"))

    held = postings.groupBy("lang", "number", "zero", "p").agg(F.count("*").alias("m"))
    other = groups.where("v > 0").select("lang", F.col("zero").alias("other")).distinct()
    added = held.join(other, "lang").groupBy("lang", "number", "other").agg(
        *(
            F.sum(F.expr(f"cast(m as decimal(38, 0)) * ({EXCESS.format(p=p, q=q)} - {EXCESS.format(p=p0, q=q0)})")).alias(name)
            for name, p, q, p0, q0 in (("as_first", "p", "other", "zero", "other"), ("as_second", "other", "p", "other", "zero"))
        )
    )
    a = groups.select("lang", "source", F.col("number").alias("a"), F.col("zero").alias("zero_a"), "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("zero").alias("zero_b"))
    pairs = a.join(b, "lang").where("a <> b").join(shared, ["lang", "a", "b"], "left")
    pairs = pairs.join(added.select("lang", F.col("number").alias("a"), F.col("other").alias("zero_b"), "as_first"), ["lang", "a", "zero_b"], "left")
    pairs = pairs.join(added.select("lang", F.col("number").alias("b"), F.col("other").alias("zero_a"), "as_second"), ["lang", "b", "zero_a"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    value = F.expr(f"cast(v as decimal(38, 0)) * ({EXCESS.format(p='zero_a', q='zero_b')})")
    for part in ("as_first", "as_second", "shared"):
        value = value + F.coalesce(F.col(part), zero)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, zero).cast("long").alias("value"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(best)


#: The same by the definition, over all terms of all pairs.
ORACLE = """
    with words as (
      select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
      from (select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents)),
    kept as (select lang, term from words group by all having count(distinct doc) >= {least_docs}),
    counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
    v as (select lang, count(*) as v from kept group by all),
    sources as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from sources left join counts using (lang, source) group by all),
    shares as (
      select lang, source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (total + v) as p
      from totals join v using (lang) join kept using (lang) left join counts using (lang, source, term)),
    whole as (
      select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // ((select sum(total) from totals t where t.lang = s.lang) + any_value(v.v)) as q
      from shares s join v using (lang) group by lang, term),
    pairs as (
      select a.lang, a.source, b.source as item, coalesce(x.value, 0)::bigint as value
      from totals a join totals b on a.lang = b.lang and a.source <> b.source
      left join (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
      ) x on x.lang = a.lang and x.source = a.source and x.item = b.source),
    above as (
      select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from shares join whole using (lang, term) where n > 0 and p > q)
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all
    select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from above
    qualify rank <= {top}"""

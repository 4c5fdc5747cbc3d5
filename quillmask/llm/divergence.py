"""How far the sources of a language differ in their words: a chi-square-like divergence between any two, and the terms that each overuses.

Terms are the runs of letters (A-Z, a-z, and whatever isn't ASCII), A-Z lower-cased. A lookup table over the concatenated UTF-8 of many texts finds their bounds, xxhash groups the slices, and bytes are compared before two are one term. A sparse
matrix of documents by terms gives, summed over the documents of a source, occurrences and numbers of documents. Partial sums are combined within a task, meet by (language, term) in one shuffle, and terms of enough documents of their language are
kept, in a table in the shared folder.

A smoothed share is p = 1 + floor(10^9 (count + 1) / (N + V)), N the occurrences of kept terms in a source or language, V the language's number of kept terms; a divergence is floor((p - q)^2 / q). Terms are dealt into buckets of some
``entries_in_unit`` entries. A unit, one bucket of one language, is a sparse matrix of sources by terms. For each source in turn its shares are laid out by term, all entries are held against them at once, and reduceat sums them by source; terms that
neither source has are counted, not visited. Sums of the units are added by pair. All is integer arithmetic in 64 bits, exact while a language has fewer than 9 * 10^15 occurrences and 2 * 10^9 kept terms.

No task holds more than a unit: its entries, and the totals of its language's sources. What is returned for pairs is the square of the number of a language's sources, by definition. Sources are never broadcast and never visit the driver.

A null text, language or source is ''. A document without terms still makes its source occur, and a language without kept terms gives its pairs with 0. Repeated rows are documents each; ties go by the item, as UTF-8. An empty table gives no rows; very long
texts are read whole. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .slices import byte_table, identify, portions

LETTER = byte_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
#: Bytes of text whose terms are counted at once, and rows of sums that a task combines at once.
PORTION, COMBINED = 4 << 20, 400_000
SCALE = 10**9
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def counts_of(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Over (lang, source, text): each portion's terms by language and source, with occurrences and documents."""
    groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
    for a, b, texts in portions(batch.column(2), PORTION):
        texts.bytes = LOWER[texts.bytes]
        starts, ends, doc = texts.bounds(LETTER)
        if not len(starts):
            continue
        terms, shown = identify(texts.bytes, starts, ends)
        held = groups.slice(a, b - a)
        pairs = pa.table({"lang": held.field(0), "source": held.field(1), "row": np.arange(b - a)}).sort_by([("lang", "ascending"), ("source", "ascending"), ("row", "ascending")])
        lang, source = pairs["lang"].to_numpy(), pairs["source"].to_numpy()
        new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (source[1:] != source[:-1])])
        group = np.empty(b - a, np.int64)
        group[pairs["row"].to_numpy()] = np.cumsum(new) - 1
        width = len(shown)
        cell, n = np.unique(doc * width + terms, return_counts=True)  # documents by terms
        rows, columns = cell // width, cell % width
        order = np.argsort(group[rows] * width + columns, kind="stable")
        key = (group[rows] * width + columns)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums, docs = np.add.reduceat(n[order], first), np.diff(np.concatenate([first, [len(key)]]))
        names = [bytes(texts.bytes[starts[i] : ends[i]]) for i in shown.tolist()]
        of, term = key[first] // width, key[first] % width
        at = np.flatnonzero(new)
        yield pa.table({
            "lang": pa.array(lang[at], pa.string()).take(pa.array(of)), "source": pa.array(source[at], pa.string()).take(pa.array(of)),
            "term": pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(term)), "n": sums, "docs": docs,
        })


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    combine = lambda held: pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])
    held: list[pa.Table] = []
    for batch in batches:
        for part in counts_of(batch):
            held.append(part)
            if sum(len(x) for x in held) >= COMBINED:
                held = [combine(held)]
                if len(held[0]) >= COMBINED // 2:  # little was equal
                    yield from held.pop().combine_chunks().to_batches(20_000)
    if held:
        yield from combine(held).combine_chunks().to_batches(20_000)


def entries(docs: DataFrame, least_documents: int = 3) -> DataFrame:
    """(lang, term, source, n, lang_n, first): occurrences of the kept terms, those in the whole language, and 1 on one row of each term, 0 on its others."""
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, COUNTED).repartition("lang", "term")
    summed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = summed.withColumns({"df": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")})
    return known.where(F.col("df") >= least_documents).select("lang", "term", "source", "n", "lang_n", "first")


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole), digit by digit, so that nothing exceeds 64 bits; count + 1 is whole at most."""
    left, out = np.asarray(count, np.int64) + 1, np.int64(0)
    left, out = left % whole, left // whole
    for _ in range(3):
        left = left * 1000
        left, out = left % whole, out * 1000 + left // whole
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Unit:
    """Sources by terms: entries in the order of their source, and each source's share of a term it lacks."""

    def __init__(self, sources: list[str], totals: np.ndarray, lang_total: int, vocabulary: int, names: list[str], row: np.ndarray, column: np.ndarray, n: np.ndarray, lang_n: np.ndarray):
        order = np.lexsort((column, row))
        self.sources, self.names, self.row, self.column = sources, names, row[order], column[order]
        whole = totals + vocabulary
        self.none = share(np.zeros(len(sources), np.int64), whole)
        self.p = share(n[order], whole[self.row])
        self.q = share(lang_n[order], lang_total + vocabulary)
        self.bounds = np.searchsorted(self.row, np.arange(len(sources) + 1))
        self.present = np.flatnonzero(np.diff(self.bounds))

    def by_source(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sources), np.int64)
        if len(self.present):
            out[self.present] = np.add.reduceat(values, self.bounds[self.present], dtype=np.int64)
        return out

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each source in the part of q, the sums over all terms of the unit with every source in the part of p."""
        q, has = np.empty(len(self.names), np.int64), np.zeros(len(self.names), bool)
        size = np.diff(self.bounds)
        for other in range(len(self.sources)):
            own = slice(self.bounds[other], self.bounds[other + 1])
            q.fill(self.none[other])
            q[self.column[own]] = self.p[own]
            has.fill(False)
            has[self.column[own]] = True
            against, both = q[self.column], has[self.column]
            values, times = np.unique(self.p[own], return_counts=True)
            lacking = np.zeros(len(self.sources), np.int64)
            for at in range(0, len(values), 4096):
                lacking += (apart(self.none[:, None], values[None, at : at + 4096]) * times[at : at + 4096]).sum(1)
            sums = self.by_source(apart(self.p, against)) + lacking - self.by_source(np.where(both, apart(self.none[self.row], against), 0))
            yield other, sums + (len(self.names) - size - size[other] + self.by_source(both)) * apart(self.none, self.none[other])

    def overused(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose share is above the language's, the first ones by value and name of each source, and their values."""
        value = np.where(self.p > self.q, apart(self.p, self.q), -1)
        place = np.empty(len(self.names), np.int64)
        place[sorted(range(len(self.names)), key=lambda i: self.names[i].encode())] = np.arange(len(self.names))
        at = np.flatnonzero(value >= 0)
        at = at[np.lexsort((place[self.column[at]], -value[at], self.row[at]))]
        rank = np.arange(len(at)) - np.searchsorted(self.row[at], self.row[at])
        return at[rank < top], value[at[rank < top]]


def _diverging(top: int):
    """Over (lang, bucket, term, source, n, lang_n, total, lang_total, vocabulary) in the order of lang and bucket; rows without a term tell a source's totals."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.table(batch)
            lang, bucket = rows["lang"].to_numpy(), rows["bucket"].to_numpy()
            turns = [0, *(np.flatnonzero((lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), len(lang)]
            for a, b in zip(turns, turns[1:], strict=False):
                if held and b > a and (held[0]["lang"][0].as_py(), held[0]["bucket"][0].as_py()) != (lang[a], bucket[a]):
                    yield pa.concat_tables(held)
                    held = []
                if b > a:
                    held.append(rows.slice(a, b - a))
        if held:
            yield pa.concat_tables(held)

    def diverging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        for unit in units(batches):
            lang = unit["lang"][0].as_py()
            counted = pa.compute.is_valid(unit["term"])
            sources, cells = unit.filter(pa.compute.invert(counted)), unit.filter(counted)
            terms = cells["term"].combine_chunks().dictionary_encode()
            row = pa.compute.index_in(cells["source"], sources["source"].combine_chunks()).to_numpy().astype(np.int64)
            made = Unit(
                sources["source"].to_pylist(), sources["total"].to_numpy(), sources["lang_total"][0].as_py(), sources["vocabulary"][0].as_py(), terms.dictionary.to_pylist(), row,
                terms.indices.to_numpy().astype(np.int64), cells["n"].to_numpy(), cells["lang_n"].to_numpy(),
            )
            shown, known = pa.array(made.sources, pa.string()), pa.array(made.names, pa.string())
            for other, sums in made.pairs():
                keep = np.flatnonzero((sums > 0) & (np.arange(len(sums)) != other))
                k = len(keep)
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k), shown.take(pa.array(keep)), pa.array(["pair"] * k), pa.array([made.sources[other]] * k), pa.array(sums[keep])], names)
            at, value = made.overused(top)
            k = len(at)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), shown.take(pa.array(made.row[at])), pa.array(["term"] * k), known.take(pa.array(made.column[at])), pa.array(value)], names)

    return diverging


def audit(docs: DataFrame, least_documents: int = 3, top: int = 200, entries_in_unit: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' with each other source of the language, part 'term' with the ``top`` terms that the source uses more than its language does."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut(entries(docs, least_documents))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").cast("bigint").alias("vocabulary"), F.ceil(F.count("*") / entries_in_unit).cast("int").alias("buckets"))
    groups = cut(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint"))))
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    cells = kept.join(of_lang.select("lang", "buckets"), "lang").select("lang", bucket, "term", "source", "n", "lang_n")
    told = groups.where("vocabulary > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "total", "lang_total", "vocabulary")
    units = cells.unionByName(told, allowMissingColumns=True).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    found = cut(units.mapInArrow(_diverging(top), "lang string, source string, part string, item string, value bigint"))
    # pairs whose shares are equal on all terms, or that have none, have no rows among the sums
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    zero = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    summed = found.where("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(of_group))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(of_group)).where(F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
nl as (select lang, count(*) as v, sum(lang_n) as n from kept group by lang),
ng as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
p as (select ng.lang, ng.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (ng.n + nl.v)::hugeint as p, 1 + (1000000000::hugeint * (kept.lang_n + 1)) // (nl.n + nl.v)::hugeint as q
    from ng join kept using (lang) join nl using (lang) left join c on c.lang = ng.lang and c.source = ng.source and c.term = kept.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
u as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from u) x where part = 'pair' or rank <= 200"""
